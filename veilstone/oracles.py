"""DuckDB equivalents of the registered queries, for those that SQL can express value by value."""

from __future__ import annotations

from veilstone import fixtures
from veilstone.functions import catalog

_SAFE = ("EMAIL", "PHONE_INTL", "BANK_ACCOUNT", "MAC_ADDRESS", "DRIVERS_LICENSE", "CRYPTO_ADDRESS", "URL_WITH_CREDENTIALS", "DOMAIN")


ALL = tuple(r[0] for r in catalog.RULES)

# Lookarounds and Java's word ends, told in a dialect without them. Both dialects call ASCII letters, digits and "_" word
# characters; Java counts all letters and digits. So where a rule has word ends, letters and digits beyond ASCII are read
# as "_". Where it looks for digits around it, ASCII letters are read as full-width ones: then digits alone are word
# characters, and a word end (or none, in front of a sign or a letter) says what the lookaround says.
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_LOCAL = r"[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
_AROUND = {
    "PHONE": rf"\B\+1[-.\s]?\(?{_LOCAL}\b|\B\({_LOCAL}\b|\b(?:1[-.\s]?\(?)?{_LOCAL}\b",
    "SSN": r"\b(?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9]{2}|6(?:[0-57-9][0-9]|6[0-57-9]))[-\s](?:0[1-9]|[1-9][0-9])[-\s](?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})\b",
    "CREDIT_CARD": r"\b(?:4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]{2}|6(?:011|5[0-9]{2}))(?:[-\s]?[0-9]{4}){2,3}\b",
    "IP_ADDRESS": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
    "ZIP_CODE": r"\b[0-9]{5}(?:-[0-9]{4})?\b",
    "DATE": None,
}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _LETTERS)


def _wide(s: str) -> str:
    return s.translate(str.maketrans(_LETTERS, _WIDE))


def _date() -> str:
    month = "".join(_wide(c) for c in _MONTH)
    days = "|".join(map(_wide, ("st", "nd", "rd", "th")))
    return rf"(?i)(?:\b[0-9]{{1,2}}[/\-.][0-9]{{1,2}}[/\-.][0-9]{{2,4}}|\B{month}\s+[0-9]{{1,2}}(?:{days})?,?\s*[0-9]{{4}}|\b[0-9]{{1,2}}\s+{month}\s+[0-9]{{4}})\b"


def _portable(label: str, pattern: str, flags: str, text: str) -> tuple[str, str]:
    """The regex, and the text that it reads."""
    if label in _AROUND:
        return _AROUND[label] or _date(), f"translate({text}, '{_LETTERS}', '{_WIDE}')"
    regex = ("(?i)" if "i" in flags else "") + pattern
    return regex, rf"regexp_replace({text}, '[^\x00-\x7F]', '_', 'g')" if r"\b" in pattern else text


def _rules(labels, text: str) -> list[tuple]:
    """k, label, category, priority, score, regex and text read of each rule asked for."""
    kept = [r for r in catalog.RULES if r[0] in labels]
    return [(k, label, category, priority, 1.0, *_portable(label, pattern, flags, text)) for k, (label, category, priority, flags, pattern, *_) in enumerate(kept)]


def _scored_rules(text: str) -> list[tuple]:
    by = {r[0]: r for r in catalog.RULES}
    out = []
    for k, (label, category, score, pattern, *more) in enumerate((*catalog.SCORED, *catalog.GENERAL)):
        rule = by[pattern[1:]] if pattern.startswith("=") else None
        read = _portable(rule[0], rule[4], rule[3], text) if rule else _portable("", pattern, more[0], text)
        out.append((k, label, category, 0, score, *read))
    return out


def _quoted(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def _candidates(rules, source: str, keys: str, text: str) -> str:
    """keys, st, neg, ord, label, category, score, value, en of all matches."""
    parts = []
    for k, label, category, priority, score, regex, read in rules:
        r = _quoted(regex)
        parts.append(f"""select {keys}, list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::bigint st,
 {-priority} neg, {k} ord, '{label}' label, '{category}' category, {score}::double score, length(m[i]) size from (select {keys}, m, g, unnest(range(1, len(m) + 1)) i from
 (select {keys}, regexp_extract_all(body, {r}) m, regexp_split_to_array(body, {r}) g from (select {keys}, {read} body from {source})) where len(m) > 0)""")
    found = " union all ".join(parts)
    return f'select x.*, st + size en, substring({text}, st + 1, size) "value" from ({found}) x join {source} using ({keys})'


_SWAP = "when x[1].neg < a[-1].neg then list_concat(a[1:len(a)-1], x)"
_ITEM = "'st': st, 'neg': neg, 'ord': ord, 'label': label, 'category': category, 'score': score, 'en': en"
#: Overlapping spans become one, named after that of highest priority.
_JOIN = "else list_concat(a[1:len(a)-1], [{'st': a[-1].st, " + ", ".join(f"'{n}': case when x[1].neg < a[-1].neg then x[1].{n} else a[-1].{n} end" for n in ("neg", "ord", "label", "category", "score")) + ", 'en': greatest(a[-1].en, x[1].en)}])"


def _kept(rules, source: str = "documents", keys: str = "doc_id", text: str = "text", swap: str = _SWAP + " else a", order: str = "st, neg, ord", where: str = "true", n: str = "", found: str = "") -> str:
    """CTEs c (candidates, or what `found` selects) and k (resolved spans, a row each)."""
    if rules and isinstance(rules[0], str):
        rules = _rules(rules, text)
    return f"""c{n} as (select * from ({found or _candidates(rules, source, keys, text)}) where {where}),
l{n} as (select {keys}, list([{{{_ITEM}}}] order by {order}) ls from c{n} group by all),
e{n} as (select {keys}, list_reduce(ls, lambda a, x: case when x[1].st >= a[-1].en then list_concat(a, x) {swap} end) es from l{n}),
k{n} as (select u.*, substring({text}, st + 1, en - st) "value" from (select {keys}, unnest(es, recursive := true) from e{n}) u join {source} using ({keys}))"""


def _tokens(keys: str = "doc_id") -> str:
    """CTE t: resolved spans with consistent tokens."""
    return f"""f as (select *, min(st) over (partition by {keys}, label, "value") first_at from k),
t as (select *, '[' || label || '_' || dense_rank() over (partition by {keys}, label order by first_at) || ']' token from f)"""


def _rewritten(keys: str = "doc_id", text: str = "text", source: str = "documents", spans: str = "t", n: str = "") -> str:
    """CTE r: keys, the rewritten text, the number of entities, their categories and the entities, of texts that have some."""
    return f"""p{n} as (select *, coalesce(lag(en) over (partition by {keys} order by st), 0) before from {spans}),
r{n} as (select {keys}, string_agg(substring({text}, before + 1, st - before) || token, '' order by st) || substring(any_value({text}), max(en) + 1) red, count(*) n, array_to_string(list_sort(list_distinct(list(category))), ',') cats,
 string_agg(concat_ws(':', label, category, token, st, en), ',' order by st) ents, string_agg(concat_ws(':', label, category, token, st, en, round(score, 3)), ',' order by st) scored from p{n} join {source} using ({keys}) group by {keys})"""


def _redact(labels) -> str:
    return f"with {_kept(labels)}, {_tokens()}, {_rewritten()} "


_FULL = "select doc_id, coalesce(red, text) redacted_text, coalesce(n, 0)::bigint entity_count, coalesce(cats, '') categories, coalesce({}, '') entities from documents left join r using (doc_id)"


def _scored_kept(threshold: float, overrides: dict[str, float], source: str = "documents", text: str = "text", found: str = "") -> str:
    least = "".join(f"when label = '{k}' then {max(v, threshold)} " for k, v in overrides.items())
    return _kept(_scored_rules(text), source, text=text, swap="else a", order="st, -score, ord", where=f"score >= case {least}when true then {threshold} end", found=found)


def _redact_scored(threshold: float, overrides: dict[str, float], source: str = "documents", text: str = "text", more: str = "") -> str:
    """Scores decide, and a value keeps the token of its first place whatever its label."""
    found = _scored_kept(threshold, overrides, source, text)
    return f"""with {more}{found}, f as (select *, min(st) over (partition by doc_id, "value") first_at from k),
g as (select doc_id, "value", label named, st from f where st = first_at),
h as (select doc_id, "value", '[' || named || '_' || row_number() over (partition by doc_id, named order by st) || ']' token from g),
t as (select f.*, token from f join h using (doc_id, "value")), {_rewritten(text=text, source=source)} """ + (_FULL.format("scored") if not more else "")


def _chained(labels, fallback: str = "") -> str:
    """Stages one behind the other; what a stage made is no match of the next. The fallback reads where none found any."""
    ctes, source, text = [], "documents", "text"
    stages = (*labels, *([fallback] if fallback else []))
    for nth, label in enumerate(stages):
        made = rf"regexp_extract_all({text}, '\[[A-Z_]+_[0-9]+\]')"
        gaps = rf"regexp_split_to_array({text}, '\[[A-Z_]+_[0-9]+\]')"
        ctes.append(f"""m{nth} as (select doc_id, list_transform(range(1, len(m) + 1), lambda i: {{'st': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'size': length(m[i])}}) made
 from (select doc_id, {made} m, {gaps} g from {source}))""")
        where = f"not exists (from m{nth} z where z.doc_id = q.doc_id and len(list_filter(made, lambda s: q.st < s.st + s.size and s.st < q.en)) > 0)"
        if nth == len(labels):
            where += f" and exists (from {source} y where y.doc_id = q.doc_id and {' + '.join(f'n{k}' for k in range(nth))} = 0)"
        ctes.append(_kept((label,), source, text=text, where=where, n=str(nth)).replace(") where not exists", ") q where not exists"))
        ctes.append(f"t{nth} as (select *, '[' || label || '_' || row_number() over (partition by doc_id, label order by st) || ']' token from k{nth})")
        ctes.append(_rewritten(source=source, text=text, spans=f"t{nth}", n=str(nth)))
        carried = ", ".join(f"n{k}" for k in range(nth))
        ctes.append(f"s{nth} as (select d.doc_id, coalesce(red, {text}) body, {carried + ', ' if carried else ''}coalesce(n, 0) n{nth} from {source} d left join r{nth} r using (doc_id))")
        source, text = f"s{nth}", "body"
    counts = ", ".join(f"n{k}" for k in range(len(stages)))
    return f"with {', '.join(ctes)} select doc_id, body redacted_text, concat_ws(',', {counts}) counts from {source}"


def _cells(table: str, key: str, columns: tuple[str, ...], others: tuple[str, ...]) -> str:
    """Each string cell redacted on its own."""
    cells = " union all ".join(f"select {key}, '{c}' col, {c} body from {table}" for c in columns)
    keys = f"{key}, col"
    wanted = ", ".join(f"coalesce(max(red) filter (col = '{c}'), max(body) filter (col = '{c}')) {c}" for c in columns)
    return f"""with b as ({cells}), {_kept(ALL, 'b', keys, 'body')}, {_tokens(keys)}, {_rewritten(keys, 'body', 'b')},
w as (select {key}, {wanted} from b left join r using ({keys}) group by 1) select {key}, {', '.join(columns)}, {', '.join(others)} from w join (select {key}, {', '.join(others)} from {table}) using ({key})"""


def _listed(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _fronted(texts) -> str:
    """CTE fx: the documents with the fixture texts in front, and what has to become of these."""
    pairs = [fixtures.unmarked(t) for t in texts]
    at = f"doc_id % {len(pairs)} + 1"
    return f"fx as (select doc_id, ({_listed(p[0] for p in pairs)})[{at}] || {_quoted(fixtures.BREAK)} || text body, ({_listed(p[1] for p in pairs)})[{at}] front from documents), "


_FRONTS = "select doc_id, front, length(coalesce(red, body)) n_chars from fx left join r using (doc_id)"
_RULES_FRONTED = f"{_fronted(fixtures.RULE_TEXTS)}{_kept(ALL, 'fx', text='body')}"

#: Detectors of one's own, and the documents that they fail on.
_YEAR = (2, "YEAR", "CUSTOM", 5, 1.0, r"\b(?:19|20)[0-9]{2}\b", f"translate(text, '{_LETTERS}', '{_WIDE}')")
_SHAME = (3, "SHAME", "CUSTOM", 4, 1.0, r"\*\*\*|%%%", "text")
_FAILED = """select doc_id, 'YEAR' detector, 'ValueError' kind, 'cannot read ###' message from documents where contains(text, '###')
 union all select doc_id, 'SHAME', 'ArithmeticError', length(text) || ' characters' from documents where length(text) % 11 = 0"""
_UNFAILED = f"(doc_id, label) not in (select doc_id, detector from ({_FAILED}))"


def _near() -> str:
    """Scores raised by .05 where a context word stands in a span or the five words in front of it, 200 characters at most."""
    labels = ("SWIFT_BIC", "CRYPTO", "MEDICATION")
    rules = [(k, *r[1:]) for k, r in enumerate(x for x in _scored_rules("body") if x[1] in labels)]
    words = {label: more[-1] for label, _, _, _, *more in catalog.SCORED if label in labels}
    held = " ".join(f"when label = '{k}' then list_bool_or(list_transform({_listed(w)}, lambda w: contains(near, w)))" for k, w in words.items())
    g = "g as (select doc_id, 'wallet ' || repeat('so ', (doc_id % 9)::int) || '0x52908400098527886e0f7030069857d2e4169ee7 and then ' || text body from documents)"
    near = r"array_to_string((regexp_extract_all(substring(lower(body), greatest(st - 200, 0) + 1, least(st, 200)), '[^\x20\x09-\x0D]+'))[-5:], ' ') || ' ' || lower(substring(body, st + 1, size))"
    found = f"select * exclude (near, body) replace (case when case {held} end then least(1, greatest(0.4, score + 0.05)) else score end as score) from (select c0.*, body, {near} near from ({_candidates(rules, 'g', 'doc_id', 'body')}) c0 join g using (doc_id))"
    return f"with {g}, {_scored_kept(catalog.SCORE_THRESHOLD, catalog.SCORE_OVERRIDES, 'g', 'body', found)} select doc_id, st start_at, label, round(score, 6) score from k"


def _span_rows(name: str, labels) -> str:
    return f"{name} as (select doc_id, st start_at, st + size end_at, label from ({_candidates(_rules(labels, 'body'), 'fx', 'doc_id', 'body')}))"


def _increase(seconds: int, step: int, by: str = "") -> str:
    """Every range on its own: CTE o has window_start, n, raw and increase."""
    key = f"{by}, " if by else ""
    return f"""x as (select {key}time_bucket(interval {step} second, ts) - i * interval {step} second window_start, epoch_us(ts) t, round("value" * 100)::bigint v from events, range({seconds // step}) r(i)),
y as (select *, lag(v) over (partition by {key}window_start order by t, v) p from x),
z as (select {key}window_start, count(*) n, sum(case when p is null then 0 when v < p then v else v - p end)::bigint raw, min({{'t': t, 'v': v}}) f, max({{'t': t, 'v': v}}) l from y group by all having count(*) >= 2),
w as (select *, (l.t - f.t)::double sampled, (l.t - f.t)::double / (n - 1) mean, (f.t - epoch_us(window_start))::double a, (epoch_us(window_start) + {seconds * 1_000_000} - l.t)::double b from z),
u as (select *, case when a >= mean * 1.1 then mean / 2 else a end near_a, case when b >= mean * 1.1 then mean / 2 else b end near_b, case when raw > 0 then sampled * (f.v::double / raw) end zero from w),
o as (select {key}window_start, n, raw, case when sampled > 0 then raw * ((sampled + least(near_a, coalesce(zero, near_a)) + near_b) / sampled) else raw end increase from u)"""


def _sliding(by: str, more: str = "") -> str:
    return f"""select m - i * interval 1 minute window_start, {by}sum(n)::bigint n, sum(n) / 300 rate{more} from
 (select {by}time_bucket(interval 1 minute, ts) m, count(*) n, count(*) filter (event_type = 'error') e from events group by all), range(5) r(i) group by all"""


def _histogram(value: str, buckets, source: str, by: str = "") -> str:
    key, group = (f"{by}, ", f" group by {by}") if by else ("", "")
    parts = [f"select {key}{float(b)}::double le, count(*) filter ({value} <= {b}) n from {source}{group}" for b in buckets]
    return " union all ".join([*parts, f"select {key}null::double le, count({value}) n from {source}{group}"])


_EXISTS = {
    "phone": r"(^|[^0-9])(\+?1[-.\s]?)?(\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}($|[^0-9])",
    "credit_card": r"(^|[^0-9])(4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(011|5\d{2}))([-\s]?\d{4}){2,3}($|[^0-9])",
    "ip_address": r"(^|[^0-9])((25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(25[0-5]|2[0-4]\d|[01]?\d\d?)($|[^0-9])",
    "zip_code": r"(^|[^0-9])\d{5}(-\d{4})?($|[^0-9])",
}

_SAMPLES = """s as (select concat_ws('-', u.conv_id, u.turn) sample_id, u.text prompt, nullif(a.text, '') response from conversations u
 left join conversations a on a.conv_id = u.conv_id and a.turn - 1 = u.turn and a.role = 'assistant' where u.role = 'user')"""


def _sample_redact(select: str) -> str:
    both = "(select sample_id, 0 part, prompt body from s union all select sample_id, 1 part, response body from s where response is not null)"
    return f"""with {_SAMPLES}, b as {both}, {_kept(ALL, "b", "sample_id, part", "body")},
o as (select *, part * 1000000000 + st at_all from k), f as (select *, min(at_all) over (partition by sample_id, label, "value") first_at from o),
t as (select *, '[' || label || '_' || dense_rank() over (partition by sample_id, label order by first_at) || ']' token from f),
{_rewritten("sample_id, part", "body", "b")}
select s.sample_id, {select} from s left join r x on x.sample_id = s.sample_id and x.part = 0 left join r y on y.sample_id = s.sample_id and y.part = 1"""


_BREAKER = """with recursive e as (select user_id, ts, event_type != 'error' ok, row_number() over (partition by user_id order by ts, event_type != 'error') i from events),
b as (select user_id, ts, i, case when ok then 'closed' when 1 >= 2 then 'open' else 'closed' end state, case when ok then 0 else 1 end failures, 0 good, null::timestamp opened from e where i = 1
 union all select user_id, ts, i, case when opens then 'open' when closes then 'closed' else seen end, failures, good, case when opens then ts else opened end from
 (select *, not ok and (seen = 'half_open' or failures >= 2) opens, ok and seen = 'half_open' and good >= 3 closes from
 (select e.user_id, e.ts, e.i, e.ok, b.opened, case when ripe then 'half_open' else b.state end seen, case when e.ok then 0 else b.failures + 1 end failures,
 case when ripe then e.ok::int when b.state = 'half_open' then b.good + e.ok::int else b.good end good from
 (select *, state = 'open' and nxt - opened >= interval 1 hour ripe from (select b.*, e.ts nxt from b join e on e.user_id = b.user_id and e.i = b.i + 1)) b join e on e.user_id = b.user_id and e.i = b.i + 1)))
select user_id, ts, state, failures from b"""

_CACHE_HITS = """with l as (select event_type k, list({'t': ts, 'hits': 0::bigint} order by ts) ls from events group by 1)
select k, list_reduce(ls, lambda a, x: case when x.t - a.t <= interval 5 minutes then {'t': a.t, 'hits': a.hits + 1} else {'t': x.t, 'hits': a.hits} end).hits hits, len(ls) total from l"""

_BUCKET_QUANTILE = f"""with h as ({_histogram('"value" / 100', catalog.LATENCY_BUCKETS, "events", "event_type")}),
o as (select *, coalesce(lag(le) over w, 0) low, coalesce(lag(n) over w, 0) below, max(n) over (partition by event_type) * 0.5 rank from h window w as (partition by event_type order by le nulls last))
select event_type, case when le is null then low else low + (le - low) * (rank - below) / greatest(n - below, 1) end "value" from o where n >= rank qualify row_number() over (partition by event_type order by n, le nulls last) = 1"""


ORACLES = {
    "email_redact": _redact(("EMAIL",)) + "select doc_id, coalesce(red, text) redacted_text, coalesce(n, 0)::bigint entity_count from documents left join r using (doc_id)",
    "email_spans": f"with {_kept(('EMAIL',))}, {_tokens()} select doc_id, st start_at, en::bigint end_at, \"value\", token from t",
    "safe_redact": _redact(_SAFE) + "select doc_id, coalesce(red, text) redacted_text, coalesce(n, 0)::bigint entity_count, coalesce(cats, '') categories from documents left join r using (doc_id)",
    "safe_entities": f"with {_kept(_SAFE)}, {_tokens()} select doc_id, st start_at, en::bigint end_at, label, category, \"value\", token from t",
    "safe_entity_counts": f"with {_kept(_SAFE)} select label, category, count(*) n from k group by all",
    "safe_scored_entities": f"with {_kept(_SAFE, swap="else a", order='st, ord')} select doc_id, st start_at, label, \"value\" from k",
    "safe_tokens_each": f"with {_kept(_SAFE)} select doc_id, st start_at, '[' || label || '_' || row_number() over (partition by doc_id, label order by st) || ']' token from k",
    "safe_corpus_tokens": f"with {_kept(_SAFE)}, f as (select label, \"value\", min({{'d': doc_id, 's': st}}) first_at from k group by all) select label, \"value\", '[' || label || '_' || row_number() over (partition by label order by first_at) || ']' token from f",
    "category_filter": _redact(("MAC_ADDRESS", "DOMAIN")) + "select doc_id, coalesce(red, text) redacted_text from documents left join r using (doc_id)",
    "docs_with_label": "select doc_id, " + ", ".join(f"regexp_matches(text, {_quoted(r)}) has_{k}" for k, r in _EXISTS.items()) + " from documents",
    "candidate_counts": f"select label, count(*) n from ({_candidates(_rules(_SAFE, 'text'), 'documents', 'doc_id', 'text')}) group by 1",
    "leak_rate": f"with {_kept(ALL)}, {_tokens()}, {_rewritten()}, x as (select doc_id, bool_or(contains(red, \"value\")) leak from t join r using (doc_id) group by 1) select count(*) total, avg(coalesce(leak, false)::int::double) leak_rate from documents left join x using (doc_id)",
    "redact_once_each": _redact(ALL) + "select doc_id, coalesce(red, text) redacted_text from documents left join r using (doc_id)",
    "dedupe_stats": "select count(*) total, count(distinct sha256(text)) size, count(*) - count(distinct sha256(text)) hits, count(distinct sha256(text)) misses, round((count(*) - count(distinct sha256(text))) / count(*), 4) hit_rate from documents",
    "text_length_histogram": _histogram("length(text)", catalog.LENGTH_BUCKETS, "documents"),
    "redact_documents": _redact(ALL) + _FULL.format("ents"),
    "redact_documents_scored": _redact_scored(catalog.SCORE_THRESHOLD, catalog.SCORE_OVERRIDES),
    "scored_threshold": _redact_scored(0.7, {}),
    "label_filter": _redact([x for x in ALL if x not in ("SWIFT_BIC", "PERSON_FULL")]) + "select doc_id, coalesce(red, text) redacted_text, coalesce(n, 0)::bigint entity_count, coalesce(regexp_matches(cats, 'PII|PHI|FINANCIAL|CREDENTIAL'), false) has_pii from documents left join r using (doc_id)",
    "token_maps": f"with {_kept(ALL)}, {_tokens()} select distinct doc_id, token, \"value\" from t",
    "restored_documents": "select doc_id, text from documents",
    "entity_labels": f"with {_kept(ALL)} select category, array_to_string(list_sort(list_distinct(list(label))), ',') labels, count(*) n from k group by 1",
    "chained_fallback": _chained(("EMAIL", "IP_ADDRESS"), "PERSON_FULL"),
    "event_requests": "select event_type, case when event_type = 'error' then 500 else 200 end::bigint status, count(*) requests, count(*) filter (event_type = 'error') errors from events group by all",
    "event_gauges": "select event_type, max(ts) ts, max(\"value\") filter (ts = m) \"value\" from (select *, max(ts) over (partition by event_type) m from events) group by 1",
    "event_targets": """select n / 86400 throughput, p50, p99, bad / greatest(n, 1) error_rate, n / 86400 > 500 and p50 < 50 and p99 < 500 and bad / greatest(n, 1) < 0.001 met
 from (select count(*) n, count(*) filter (event_type = 'error') bad, quantile_cont("value", 0.5) p50, quantile_cont("value", 0.99) p99 from events)""",
    "label_false_positives": f"with {_kept(ALL)}, d as (select distinct doc_id from k) select count(*) total, count(d.doc_id) false_positives, count(d.doc_id) / count(*) false_positive_rate from documents join labels using (doc_id) left join d using (doc_id) where quality = 1",
    "redact_documents_strict": f"with {_kept(ALL, swap=_JOIN)}, {_tokens()}, {_rewritten()} select doc_id, coalesce(red, text) redacted_text, coalesce(n, 0)::bigint entity_count, coalesce(cats, '') categories from documents left join r using (doc_id)",
    "chained_redact": _chained(("EMAIL", "DRIVERS_LICENSE", "DOMAIN")),
    "golden_rules": f"with {_RULES_FRONTED}, {_tokens()}, {_rewritten(text='body', source='fx')} {_FRONTS}",
    "golden_scored": _redact_scored(catalog.SCORE_THRESHOLD, catalog.SCORE_OVERRIDES, "fx", "body", _fronted(fixtures.SCORED_TEXTS)) + _FRONTS,
    "golden_labels": f"with {_RULES_FRONTED} select label, category, count(*) n from k group by all",
    "redact_with_failures": f"with {_kept([*_rules(('EMAIL', 'DRIVERS_LICENSE'), 'text'), _YEAR, _SHAME], where=_UNFAILED)}, {_tokens()}, {_rewritten()} select doc_id, coalesce(red, text) redacted_text, coalesce(n, 0)::bigint entity_count from documents left join r using (doc_id)",
    "detector_failures": _FAILED,
    "failures_by_kind": f"select detector, kind, count(*) n from ({_FAILED}) group by all",
    "incremental_tokens": f"with {_kept(_SAFE)}, f as (select label, \"value\", min({{'d': doc_id, 's': st}}) first_at from k group by all), n as (select *, row_number() over (partition by label order by first_at) number from f) select label, \"value\", number, '[' || label || '_' || number || ']' token from n",
    "context_near": _near(),
    "spans_without_overlap": f"with {_fronted(fixtures.RULE_TEXTS)}{_span_rows('a', ('DOMAIN', 'PERSON_FULL', 'PHONE'))}, {_span_rows('b', ('EMAIL', 'URL_WITH_CREDENTIALS', 'PERSON', 'PHONE_INTL'))} select * from a where not exists (from b where b.doc_id = a.doc_id and b.start_at < a.end_at and a.start_at < b.end_at)",
    "spans_not_repeated": f"with {_fronted(fixtures.RULE_TEXTS)}{_span_rows('a', ('PHONE', 'ZIP_CODE', 'DATE', 'MEDICAL_CONDITION'))}, {_span_rows('b', ('PHONE_INTL', 'CREDIT_CARD', 'ZIP_CODE', 'SSN'))} select * from a where (doc_id, start_at, end_at) not in (select doc_id, start_at, end_at from b)",
    "redact_event_props": """with t as (select event_id, event_id % 5 k, props, '"[EMAIL_1] and \\"more\\""' mail from events)
select event_id, case k when 0 then '{"user": ' || mail || ', "mail@x.org": 1.50, "deep": [{"p": ' || props || '}, null, "[IP_ADDRESS_1]"]}' when 1 then '[' || mail || ', true, ' || props || ']' when 2 then mail when 3 then props else 'not JSON: [EMAIL_1] ' || props end tree,
 case k when 0 then 2 when 3 then 0 else 1 end::bigint entity_count from t""",
    "event_heavy_users_1h": "select * from (select window_start, user_id, n, row_number() over (partition by window_start order by n desc, user_id) rank from (select time_bucket(interval '1 hour', ts) window_start, user_id, count(*) n from events group by all)) where rank <= 10",
    "event_sketch_quantiles": "select date_trunc('day', ts)::timestamp \"day\", event_type, count(\"value\") n, true p50_within, true p95_within, true p99_within from events group by all",
    "event_sliding_rate": _sliding("event_type, "),
    "event_sliding_errors": _sliding("", ", sum(e)::bigint n_met, sum(e) / sum(n) ratio"),
    "event_counter_increase": f"with {_increase(300, 60)} select window_start, n, raw, round(increase, 4) increase, round(increase / 300, 6) rate from o",
    "event_top_increase_1h": f"with {_increase(3600, 300, 'event_type')} select window_start, event_type, n, raw, round(increase, 4) increase, round(increase / 3600, 6) rate, rank from (select *, row_number() over (partition by window_start order by increase desc, event_type) rank from o) where rank <= 3",
    "sample_redact": _sample_redact("coalesce(x.red, s.prompt) redacted_prompt, coalesce(y.red, s.response) redacted_response, (coalesce(x.n, 0) + coalesce(y.n, 0))::bigint total_entities"),
    "sample_reviewer": _sample_redact("coalesce(x.red, s.prompt) prompt, coalesce(y.red, s.response) response"),
    "qa_sample": "select doc_id, substring(text, 1, 120) head from documents where ('0x' || substring(md5(doc_id::varchar), 1, 8))::bigint % 100 < 5",
    "event_breaker": _BREAKER,
    "event_cache_hits": _CACHE_HITS,
    "event_bucket_quantile": _BUCKET_QUANTILE,
    "validation_status": r"""select case when length(text) between 1 and 20000 and strlen(text) <= 1048576 and regexp_matches(lang, '^[a-z]{2}$') then 200 else 422 end status, count(*) n,
 sum(length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')))::bigint chars from documents group by 1""",
    "redact_cells": _cells("documents", "doc_id", ("text", "lang", "source"), ("n_chars",)),
    "lines_parsed": """select case when event_type = 'view' then event_id::varchar else 'line-' || event_id end sample_id, case when event_type = 'view' then event_type else 'raw ' || event_type end prompt,
 case when event_type = 'view' then props end response, '{}' metadata from events where event_type != 'click'""",
    "registry_rules": f"with {_fronted(fixtures.RULE_TEXTS)}h as (select category, count(*) hits from ({_candidates(_rules(ALL, 'body'), 'fx', 'doc_id', 'body')}) group by 1) select v.*, coalesce(hits, 0)::bigint hits from (values ('CREDENTIAL', 6, 6, 10), ('FINANCIAL', 6, 6, 10), ('NETWORK', 4, 4, 7), ('PHI', 9, 9, 9), ('PII', 15, 15, 10), ('SENSITIVE', 4, 4, 5)) v(category, labels, detectors, top_priority) left join h using (category)",
    "registry_scored": f"with {_fronted(fixtures.SCORED_TEXTS)}{_scored_kept(catalog.SCORE_THRESHOLD, catalog.SCORE_OVERRIDES, 'fx', 'body')} select category, count(distinct label) n, count(*)::bigint hits from k group by 1",
    "event_rate_1m": "select time_bucket(interval '1 minute', ts) window_start, event_type, count(*) / 60 rate from events group by all",
    "event_error_ratio_5m": "select time_bucket(interval '5 minutes', ts) window_start, count(*) filter (event_type = 'error') / count(*) ratio from events group by all",
    "event_quantiles": "select event_type, quantile_cont(\"value\", 0.5) p50, quantile_cont(\"value\", 0.95) p95, quantile_cont(\"value\", 0.99) p99 from events group by all",
    "event_top_users_1h": "select * from (select window_start, user_id, n, row_number() over (partition by window_start order by n desc, user_id) rank from (select time_bucket(interval '1 hour', ts) window_start, user_id, count(*) n from events group by all)) where rank <= 10",
    "event_latency_histogram": _histogram("\"value\" / 100", catalog.LATENCY_BUCKETS, "events", "event_type"),
    "event_batch_histogram": f"with z as (select user_id, count(*) size from events group by 1) {_histogram('size', catalog.BATCH_BUCKETS, 'z')}",
    "event_stats": "select count(*) filter (event_type != 'error') processed, count(*) filter (event_type = 'error') errors, coalesce(round(avg(\"value\") filter (event_type != 'error'), 2), 0) avg_ms, round(count(*) filter (event_type = 'error') / greatest(count(*) filter (event_type != 'error'), 1), 4) error_rate from events",
    "detection_vs_labels": f"with {_kept(ALL)}, d as (select distinct doc_id from k) select quality::bigint quality, count(*) total, count(d.doc_id) detected from labels join documents using (doc_id) left join d using (doc_id) group by 1",
}
