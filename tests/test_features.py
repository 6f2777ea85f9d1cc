"""Failures told as rows, numbering that goes on, sliding ranges, nearness of context, spans against spans, sketches, JSON."""

import datetime as dt
import json
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilstone import tables
from veilstone.functions.registry import Detector, Registry, least_width, rule_registry, scored_registry
from veilstone.functions.spans import Context
from veilstone.operators import metrics, numbering, overlap, ranges, sketches, trees
from veilstone.operators.redact import Options, detect, redact, with_failures
from veilstone.streaming import stream

T0 = dt.datetime(2024, 1, 1)


def failing_detectors():
    """Two detectors that raise on some texts; made here, so that they go to the executors by value."""

    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text\nsecond line")
        return [[(k, k + 1) for k, c in enumerate(t) if c == "Z"] for t in texts]

    def short(texts):
        return [[]] * (len(texts) - 1) if any("few" in t for t in texts) else [[(0, 1)] if t else [] for t in texts]

    return picky, short


def test_failures_become_rows_and_results_are_whole(spark):
    picky, short = failing_detectors()
    registry = Registry((*rule_registry().only(("EMAIL",)).detectors, Detector("ZED", "X", scan=picky), Detector("HEAD", "X", scan=short, priority=1), Detector("BROKEN", "X", "(open")))
    texts = ["é Z a@b.com Z", "bad Z a@b.com", None, "few a@b.com", "", "bad few", "plain"] * 7
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)
    done, failures = with_failures(rows, "id", options=Options(registry=registry))
    got = {r.id: r.redacted_text for r in done.collect()}
    want = {0: "[HEAD_1] [ZED_1] [EMAIL_1] [ZED_1]", 1: "[HEAD_1]ad Z [EMAIL_1]", 2: None, 3: "few [EMAIL_1]", 4: "", 5: "bad few", 6: "[HEAD_1]lain"}
    assert got == {k: want[k % 7] for k in range(len(texts))}
    told = {(r.id, r.detector): (r.kind, r.message) for r in failures.collect()}
    assert all(told.pop((k, "BROKEN"))[0] == "unusable" for k in range(len(texts)))
    assert told == {(k, d): m for k in range(len(texts)) for d, m in (("ZED", ("ValueError", "bad text")), ("HEAD", ("ValueError", "0 results for 1 texts"))) if ("bad" if d == "ZED" else "few") in (texts[k] or "")}
    assert {(r.detector, r.kind): r.n for r in metrics.failures_by_kind(failures).collect()} == {("BROKEN", "unusable"): 49, ("ZED", "ValueError"): 14, ("HEAD", "ValueError"): 14}
    with pytest.raises(Exception, match="bad text"):
        redact(rows, options=Options(registry=Registry((Detector("ZED", "X", scan=picky),)))).collect()


def test_regexes_that_match_nothing_at_all_are_refused(spark):
    for regex in (r"\b", "(?=x)", "x*(?=y)", "a|", "(?:ab)?", r"\z"):
        kept, errors = Registry((Detector("D", "X", regex),)).checked(spark)
        assert errors.keys() == {"D"} and not len(kept), regex
    assert all(least_width(d.regex) for d in rule_registry().detectors) and rule_registry().checked(spark)[1] == {}
    wrong = Detector("F", "X", find=lambda text: F.array(F.struct(F.lit("x").alias("begin"))))
    assert Registry((wrong,)).checked(spark)[1].keys() == {"F"}


def entities(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, start int, label string, value string")


def one_run(rows):
    numbers, out = Counter(), {}
    for _, _, label, value in sorted(rows):
        if (label, value) not in out:
            numbers[label] += 1
            out[label, value] = numbers[label]
    return out


def held(df):
    rows = df.collect()
    assert all(r.token == f"[{r.label}_{r.number}]" for r in rows) and len(rows) == len({(r.label, r.value) for r in rows})
    return {(r.label, r.value): r.number for r in rows}


def test_numbering_goes_on_and_can_be_replayed(spark, tmp_path):
    rng = random.Random(61)
    rows = [(d, s, rng.choice("AB"), f"v{rng.randrange(40)}") for d in range(90) for s in range(3)]
    parts = [[r for r in rows if r[0] // 30 == k] for k in range(3)]
    table = numbering.TokenTable(spark, f"file://{tmp_path}/tokens")
    assert table.state().count() == 0 and table.committed() == -1
    table.compact()
    for k, part in enumerate(parts):
        added = held(table.add(entities(spark, part), ["doc_id", "start"], k))
        assert held(table.add(entities(spark, part), ["doc_id", "start"], k)) == added  # a replay
        assert held(table.state()) == one_run([r for p in parts[: k + 1] for r in p])
        if k == 1:  # a batch that was lost on its way
            os.makedirs(tmp_path / "tokens" / "batch=000000002")
            (tmp_path / "tokens" / "batch=000000002" / "part-0.parquet").write_bytes(b"half")
            assert table.committed() == 1
            table.compact()
            assert table.committed() == 1 and held(table.state()) == one_run(parts[0] + parts[1])
    assert held(table.state(before=2)) == one_run(parts[0] + parts[1])
    assert table.add(entities(spark, parts[0]), ["doc_id", "start"], 0).count() == 0  # known before it was made one
    table.compact()
    table.compact()
    assert held(table.state()) == one_run(rows) and sorted(os.listdir(tmp_path / "tokens")) == ["upto=000000002"]
    known = {(r.doc_id, r.start): r.number for r in table.tokenised(entities(spark, rows)).collect()}
    assert known == {r[:2]: one_run(rows)[r[2:]] for r in rows}


def test_numbering_of_a_stream(spark, tmp_path):
    rng = random.Random(62)
    rows = [(d, s, "A", f"v{rng.randrange(30)}") for d in range(40) for s in range(2)]
    for k in range(4):
        entities(spark, [r for r in rows if r[0] // 10 == k]).coalesce(1).write.parquet(str(tmp_path / "in" / f"n{k}"))
        for f in (tmp_path / "in" / f"n{k}").glob("*.parquet"):
            os.rename(f, tmp_path / "in" / f"{k}.parquet")
            os.utime(tmp_path / "in" / f"{k}.parquet", (1e9 + k, 1e9 + k))
    source = stream.bounded_source(spark, str(tmp_path / "in" / "*.parquet"), "doc_id int, start int, label string, value string", most_files=1)
    seen = []
    for _ in range(2):  # the second run finds nothing new
        q = numbering.numbered_stream(source, f"file://{tmp_path}/tokens", ["doc_id", "start"], str(tmp_path / "cp"), lambda b, n: seen.extend(b.collect()), compact_every=3)
        assert q.awaitTermination(120)
    assert {(r.doc_id, r.start): r.number for r in seen} == {r[:2]: one_run(rows)[r[2:]] for r in rows} and len(seen) == len(rows)
    again = numbering.TokenTable(spark, f"file://{tmp_path}/tokens")
    assert held(again.add(entities(spark, rows), ["doc_id", "start"], 3)) in ({}, {k: n for k, n in held(again.state()).items() if k not in held(again.state(before=3))})
    assert held(again.state()) == one_run(rows)


def increases(samples, seconds, step):
    out = {}
    by = defaultdict(list)
    for k, t, v in samples:
        by[k].append((t, v))
    for k, points in by.items():
        points.sort()
        for start in range(-seconds, 4000, step):
            own = [(t, v) for t, v in points if start <= t < start + seconds]
            if len(own) < 2:
                continue
            raw = sum(b[1] if b[1] < a[1] else b[1] - a[1] for a, b in zip(own, own[1:], strict=False))
            sampled, mean = own[-1][0] - own[0][0], (own[-1][0] - own[0][0]) / (len(own) - 1)
            a, b = own[0][0] - start, start + seconds - own[-1][0]
            a, b = (mean / 2 if x >= mean * 1.1 else x for x in (a, b))
            if raw > 0:
                a = min(a, sampled * own[0][1] / raw)
            out[k, start] = (len(own), raw, raw * (sampled + a + b) / sampled if sampled else raw)
    return out


@pytest.mark.parametrize(("seconds", "step"), [(300, 60), (120, 120), (600, 30)])
def test_increase_of_counters_with_resets(spark, seconds, step):
    rng = random.Random(seconds)
    samples, v = [], 0
    for k in "ab":
        for t in sorted(rng.sample(range(0, 3600), 150)) + [3600, 3600]:
            v = rng.randrange(5) if rng.random() < 0.1 else v + rng.randrange(9)
            samples.append((k, t, v))
    rows = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=t), v) for k, t, v in samples] + [("a", None, 5), ("a", T0, None)], "k string, ts timestamp, v long")
    got = {(r.k, (r.window_start - T0).total_seconds()): (r.n, r.raw, r.increase) for r in ranges.increase(rows, "ts", "v", seconds, step, "k").collect()}
    want = increases(samples, seconds, step)
    assert got.keys() == want.keys() and all(got[x][:2] == want[x][:2] and got[x][2] == pytest.approx(want[x][2]) for x in want)
    counted = {(r.k, (r.window_start - T0).total_seconds()): r.n for r in ranges.sliding_rate(rows.filter("v is not null"), "ts", seconds, step, "k").collect()}
    whole = {(k, s): n for (k, s), n in Counter((k, s) for k, t, _ in samples for s in range(-seconds, 4000, step) if s <= t < s + seconds).items()}
    assert counted == whole
    with pytest.raises(ValueError, match="multiple"):
        ranges.sliding_rate(rows, "ts", 100, 60)


def test_context_counts_by_nearness(spark):
    address = "0x" + "a" * 40
    texts = [f"wallet {'so ' * n}{address} tail" for n in range(8)] + [f"{address} wallet", f"my-wallet: {address}", address, f"wallet{' ' * 220}{address}", f"É WALLET\n{address}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    score = lambda context: [round(r.entities[0].score, 3) for r in detect(rows, options=Options("scored", registry=scored_registry().only(("CRYPTO",)), context=context)).orderBy("id").collect()]
    assert score(Context(0.05, 0.4, 5)) == [0.95] * 5 + [0.9] * 3 + [0.9, 0.95, 0.9, 0.9, 0.95]
    assert score(Context(0.05, 0.4, 2, 1)) == [0.95] * 2 + [0.9] * 6 + [0.95, 0.95, 0.9, 0.9, 0.95]
    assert score(Context(0.05, 0.0, None)) == [0.95] * 10 + [0.9, 0.95, 0.95]
    assert score(Context(5.0, 0.4, 5))[0] == 1.0 and score(Context(0.0, 0.97, 5))[0] == 0.97


@pytest.mark.parametrize("width", [3, 4096])
def test_overlaps_as_rows(spark, width):
    rng = random.Random(width)
    some = lambda n: [(rng.choice([1, 2, 3, None]), a := rng.choice([rng.randrange(60), None, 5]), None if a is None else a + rng.randrange(0, 7), rng.choice("xy")) for _ in range(n)]
    left, right = some(150), some(25)
    schema = "doc int, start int, end int, tag string"
    got = overlap.without_overlap(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "doc", width=width).collect()
    meets = lambda x, y: None not in (*x[:3], *y[:3]) and x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]
    order = lambda rows: sorted(map(str, rows))
    key = lambda r: (r.doc, r.start, r.end, r.tag)
    assert order(map(key, got)) == order(x for x in left if not any(meets(x, y) for y in right))
    equal = overlap.not_repeated(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "doc").collect()
    assert order(map(key, equal)) == order(x for x in left if None in x[:3] or x[:3] not in {y[:3] for y in right})
    assert overlap.without_overlap(spark.createDataFrame(left, schema), spark.createDataFrame([], schema), "doc").count() == len(left)


@pytest.mark.parametrize("tracked", [16, 4096])
def test_heavy_hitters_are_exact(spark, tracked):
    rng = random.Random(tracked)
    rows = [(T0 + dt.timedelta(minutes=rng.randrange(300)), rng.choice([f"heavy{rng.randrange(4)}", f"u{rng.randrange(400)}", None])) for _ in range(4000)]
    rows += [(T0 + dt.timedelta(hours=9, seconds=k), f"only{k % 3}") for k in range(12)] + [(T0 + dt.timedelta(hours=12, seconds=k), f"light{k}") for k in range(300)]
    got = {(r.window_start, r["rank"]): (r.user, r.n) for r in sketches.heavy_hitters(spark.createDataFrame(rows, "ts timestamp, user string").repartition(3), "ts", "1 hour", "user", 6, tracked).collect()}
    want, counts = {}, defaultdict(Counter)
    for t, u in rows:
        if u is not None:
            counts[t.replace(minute=0, second=0)][u] += 1
    for w, c in counts.items():
        for k, (u, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:6]):
            want[w, k + 1] = (u, n)
    assert got == want


def test_quantile_states_merge_to_any_range(spark):
    rng = random.Random(63)
    rows = [(T0 + dt.timedelta(seconds=rng.randrange(7200)), rng.choice("ab"), rng.choice([rng.random() * 100, 7.0, None, float("nan")])) for _ in range(30_000)]
    states = sketches.quantile_states(spark.createDataFrame(rows, "ts timestamp, k string, v double"), "ts", "v", "1 minute", "k")
    for name, by in (("k", ("k",)), ("h", (F.date_trunc("hour", "window_start").alias("h"),)), ("", ())):
        for r in sketches.estimated(sketches.merged(states, *by), (0.01, 0.5, 0.99)).collect():
            own = sorted(v for t, k, v in rows if v is not None and v == v and (name != "k" or k == r.k) and (name != "h" or t.hour == r.h.hour))
            assert r.n == len(own)
            for q, v in ((0.01, r.p1), (0.5, r.p50), (0.99, r.p99)):
                error = 3 * sketches.rank_error()
                assert sum(x < v for x in own) <= (q + error) * len(own) and sum(x <= v for x in own) >= (q - error) * len(own)


def test_json_of_any_shape(spark):
    def walk(x):
        return {k: walk(v) for k, v in x.items()} if isinstance(x, dict) else [walk(v) for v in x] if isinstance(x, list) else x.replace("a@b.com", "[EMAIL_1]") if isinstance(x, str) else x

    trees_in = [{"a@b.com": "a@b.com", "n": 1.50, "t": [True, None, "x\n\"a@b.com\" é\\"]}, ["a@b.com", ["deep", ["a@b.com  "]]], "a@b.com", 12, None, {}, [], {"k": {"k": {"k": "\\"}}}, {"quote\" : ": "a@b.com", "b": "no"}]
    texts = [json.dumps(t) for t in trees_in] + [json.dumps(t, ensure_ascii=False, indent=2) for t in trees_in]
    rows = [*enumerate(texts), (100, '{"n": 1.50, "m": "a@b.com" , "big": 123456789012345678901234567890}'), (101, "not { JSON a@b.com"), (102, None), (103, ""), (104, '{"plain": "\\u0041 \\/ kept"}')]
    got = {r.id: (r.j, r.entity_count) for r in trees.redact_json(spark.createDataFrame(rows, "id int, j string"), "id", "j", Options(labels=("EMAIL",))).collect()}
    for k, t in enumerate(texts):
        assert json.loads(got[k][0]) == walk(json.loads(t)) and got[k][1] == json.dumps(list(walk_values(json.loads(t)))).count("a@b.com")
    assert got[100] == ('{"n": 1.50, "m": "[EMAIL_1]" , "big": 123456789012345678901234567890}', 1)
    assert got[101] == ("not { JSON [EMAIL_1]", 1) and got[102] == (None, 0) and got[103] == ("", 0) and got[104] == (rows[-1][1], 0)
    leaves = trees.string_leaves(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()
    assert sorted(r.value for r in leaves if r.id == 0) == sorted(walk_values(trees_in[0])) and not any(r.id in (101, 102, 103) for r in leaves)


def walk_values(x):
    for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else [x] if isinstance(x, str) else []:
        yield from [v] if isinstance(v, str) else walk_values(v)


def test_gauges_follow_a_stream(spark, tmp_path):
    import time

    rows = [(T0 + dt.timedelta(seconds=k), f"k{k % 5}") for k in range(60)]
    spark.createDataFrame(rows, "ts timestamp, key string").repartition(3).write.parquet(str(tmp_path / "in"))
    gauges = stream.ProgressGauges(500)
    spark.streams.addListener(gauges)
    try:
        source = stream.bounded_source(spark, str(tmp_path / "in"), "ts timestamp, key string", most_files=1)
        q = source.withWatermark("ts", "1 hour").groupBy("key").count().writeStream.format("memory").queryName("gauged").outputMode("complete").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        for _ in range(100):
            if not gauges.active and gauges.samples:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(gauges)
    samples = gauges.to_df(spark).filter("query = 'gauged'")
    told = {r.name: r.s for r in samples.groupBy("name").agg(F.sum("value").alias("s")).collect()}
    latest = {r.name: r.value for r in metrics.gauges(samples).collect()}
    assert told["rows"] == 60 and latest["state_rows"] == 5 and {"rows_in_per_second", "batch_seconds", "state_bytes", "late_rows"} <= latest.keys()
    assert samples.filter("name = 'rows'").agg(F.max("value")).first()[0] < 60 and not gauges.active


def test_intake_is_bounded(spark, tmp_path):
    rows = [(k, f"t{k}") for k in range(230)]
    spark.createDataFrame(rows, "id int, text string").repartition(7).write.parquet(str(tmp_path / "in"))
    seen, sizes = [], []

    def handle(batch, number):
        got = batch.collect()
        sizes.append(len(got))
        seen.extend(r.id for r in got)

    intake = stream.Intake(handle, 25)
    q = stream.fan_out(stream.bounded_source(spark, str(tmp_path / "in"), "id int, text string", most_files=2), [intake], str(tmp_path / "cp"))
    assert q.awaitTermination(240)
    assert sorted(seen) == list(range(230)) and max(sizes) == intake.largest <= 25 and len(intake.batches) == 4 and sum(intake.batches.values()) == 230
    with pytest.raises(ValueError):
        stream.bounded_source(spark, "x", "id int")


def test_memory_sink_holds_the_newest_rows(spark):
    sink = stream.MemorySink(3, "ts")
    for part in ([5, 1, 9], [2, 7, None], [8, 3]):
        sink(spark.createDataFrame([(t,) for t in part], "ts int"), 0)
    assert [r.ts for r in sink.rows] == [7, 8, 9] and sink.seen == 8


@pytest.mark.parametrize("stop", ["spark.stop()", "pass"])
def test_kept_tables_go_with_the_driver(tmp_path, stop):
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
from veilstone import tables
kept = tables.keep(spark.range(50).groupBy("id").count())
assert kept.count() == 50 and spark.conf.get(tables._CLEANUP, "false") == "false"
import os
print("KEPT", len(os.listdir("{tmp_path}/veilstone")))
{stop}
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "KEPT 1" in done.stdout, done.stderr[-2000:]
    import time

    for _ in range(100):
        if not os.listdir(tmp_path / "veilstone"):
            break
        time.sleep(0.1)
    assert os.listdir(tmp_path / "veilstone") == []


def test_kept_tables_are_released_by_scope(spark):
    one, two = tables.keep(spark.range(3), "scope-a"), tables.keep(spark.range(4), "scope-b")
    tables.release(spark, "scope-a")
    assert two.count() == 4
    with pytest.raises(Exception):  # noqa: B017
        one.count()
    tables.discard(two)
