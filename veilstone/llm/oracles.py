"""DuckDB equivalents of the queries that SQL can express over whole tables."""

from __future__ import annotations

from veilstone.llm import chat, secrets


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NGRAM_JOIN = f"""with recursive w as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ws from documents),
s as (select distinct doc_id, case when len(ws) < 3 then array_to_string(ws, ' ') else array_to_string(ws[i:i+2], ' ') end k from w, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) where len(ws) > 0),
z as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by all),
e as (select a, b from p join z x on x.doc_id = a join z y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
u as (select a, b from e union select b, a from e),
r as (select doc_id a, doc_id b from documents union select r.a, u.b from r join u on r.b = u.a)
select d.doc_id, coalesce(z.n, 0)::bigint n_shingles, m.component_id from documents d left join z using (doc_id) join (select a doc_id, min(b) component_id from r group by 1) m using (doc_id)"""


def _chat() -> str:
    t = chat.Template()

    def escaped(text: str) -> str:
        out = rf"replace({text}, '\', '\\')"
        for c in t.controls():
            out = f"replace({out}, {_quoted(c)}, {_quoted(c[0] + chr(92) + '!' + c[1:])})"
        return out

    size = f"length({escaped('role')}) + {len(t.other.opening + t.named + t.other.closing)}"
    for role, turn in t.roles.items():
        size = f"case when role = {_quoted(role)} then {len(turn.opening + turn.closing)} else {size} end"
    moves = " or ".join(f"(s = {_quoted(s)} and role in ({', '.join(map(_quoted, to))}))" for s, to in t.moves.items())
    loss = ", ".join(_quoted(r) for r, turn in t.roles.items() if turn.loss)
    extra = " union all ".join(f"select -7, {k}, '{role}', '</s>[INST] ok [/INST]'" for k, role in enumerate(("user", "assistant")))
    return f"""with c as (select conv_id, turn, coalesce(role, '') "role", coalesce(text, '') "text" from (select conv_id, turn, role, text from conversations union all {extra})),
x as (select *, coalesce(lag(role) over o, '{chat.START}') s, row_number() over o nth, count(*) over (partition by conv_id) total from c window o as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by nth)) turns_sha256,
coalesce(sum(length(text)) filter (role in ({loss})), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by nth) filter (role in ({loss})), '')) loss_sha256,
sum({size} + length({escaped('text')}))::bigint formatted_chars, bool_and({moves}) and bool_or(nth = total and role in ({', '.join(map(_quoted, t.ends))})) "valid" from x group by conv_id"""


QUALITY = f"""with w as (select doc_id, source, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i+7], ' ') k from w, unnest(range(1, len(ws) - 6)) g(i) where len(ws) >= 8),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) c from win) where c > 1),
cov as (select doc_id, count(distinct i + j) n from dup, range(8) r(j) group by 1),
l as (select doc_id, count(*) - count(distinct line) n from (select doc_id, unnest(string_split(t, chr(10))) line from w) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
f as (select w.doc_id, w.source, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
 coalesce(l.n, 0)::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words from w left join l using (doc_id) left join cov using (doc_id)),
b as (select *, n_words < 20 r1, 100 * n_repeat_words > 30 * n_words r2, 100 * n_symbols > 100 * n_words r3, 100 * n_dup_lines > 20 * n_words r4 from f),
h as (select source, rule, count(*) n, count(*) filter (failed) f from (select source, unnest([1, 2, 3, 4]) "rule", unnest([r1, r2, r3, r4]) failed from b) group by all),
m as (select rule, count(*) k, sum(n) n, sum(f) f, sum(f * f / n) ff, sum(n * n) nn, sum(f - f * f / n) inside from h group by 1),
v as (select rule, f / n rate, (ff - f * f / n) / (k - 1) msb, inside / (n - k) msw, (n - nn / n) / (k - 1) size from m where k > 1 and n > k and f > 0 and f < n),
q as (select rule, rate, case when msb > msw then least(greatest(greatest(msb + (size - 1) * msw, 1e-12) / (msb - msw) - 1, 1), 1000) else 1000 end strength from v),
k as (select source, max((f + coalesce(rate * strength, 1)) / (n + coalesce(strength, 2))) > 0.5 bad from h left join q using (rule) group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 or r2 base_failed, not (r1 or r2) and not bad kept from b join k on b.source is not distinct from k.source"""


def _secrets() -> str:
    parts = []
    for order, r in enumerate(secrets.RULES):
        regex = _quoted(r.regex)
        parts.append(f"""select doc_id, {order} nth, '{r.kind}' kind, list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::bigint st,
 length(m[i]) size, length(c[i]) counted, {r.least} least from (select doc_id, m, g, c, unnest(range(1, len(m) + 1)) i from (select doc_id, regexp_extract_all(text, {regex}) m, regexp_split_to_array(text, {regex}) g, regexp_extract_all(text, {regex}, {r.group}) c from documents) where len(m) > 0)""")
    base = ", ".join(f"'{r.kind}'" for r in secrets.RULES if r.base)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') n_{r.kind}" for r in secrets.RULES if r.base)
    one = "kind || ':' || st || ':' || (st + size)"
    return f"""with s as (select * from ({" union all ".join(parts)}) where counted >= least)
select doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' order by st, nth) filter (kind in ({base})), '')) base_sha256, coalesce(string_agg({one}, ',' order by st, nth), '') spans from documents left join s using (doc_id) group by doc_id"""


DIVERGENCE = """with d as (select row_number() over () k, coalesce(lang, '') "lang", coalesce(source, '') "source", translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
o as (select k, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
kept as (select lang, term from o group by all having count(distinct k) >= 10),
c as (select lang, source, term, count(*) n from o join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select lang, count(term) v from (select distinct lang from g) left join kept using (lang) group by 1),
s as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint total from g left join c using (lang, source) group by all),
p as (select g.lang, g.source, kept.term, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v.v) p
 from g join kept using (lang) join s using (lang, source) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
l as (select lang, term, sum(n) n from p group by all),
q as (select l.lang, l.term, 1 + (1000000000::hugeint * (l.n + 2)) // (u.total + 2 * v.v) q from l join v using (lang) join (select lang, sum(total) total from s group by 1) u using (lang)),
pair as (select a.lang, a.source, b.source item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) "value" from g a join g b on a.lang = b.lang and a.source <> b.source
 left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
term as (select lang, source, term item, ((p - q) * (p - q)) // (p + q) "value" from p join q using (lang, term) where n > 0 and p > q),
r as (select *, 'pair' part, row_number() over (partition by lang, source order by "value" desc, item) rank from pair union all select *, 'term', row_number() over (partition by lang, source order by "value" desc, item) from term)
select lang, source, part, item, "value"::bigint "value", rank::int rank from r where part = 'pair' or rank <= 10"""

_NIBBLES = "0000000100100011010001010110011110001001101010111100110111101111"
WARC = f"""with h as (select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) x from pages),
b as (select *, array_to_string(list_transform(string_split(x, ''), lambda c: substr('{_NIBBLES}', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') bits, min(page_id) over (partition by x, payload_bytes) f from h)
select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, 5 * i + j + 1, 1)::int * (16 >> j)))::int, 1)), '') payload_digest,
case when f is null or page_id = f then 'response' else 'revisit' end record_type, case when page_id = f then null else f end refers_to from b"""

ORACLES = {"op1_ngram_join": NGRAM_JOIN, "op3_chat_formatting": _chat(), "op5_quality_rules": QUALITY, "op10_secret_scans": _secrets(), "op11_source_divergence": DIVERGENCE, "op12_warc": WARC}
