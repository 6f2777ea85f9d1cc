import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from veilstone.operators import cache, metrics
from veilstone.operators.redact import Options
from veilstone.functions.registry import rule_registry
from veilstone.sources import files
from veilstone.streaming import stream

T0 = dt.datetime(2024, 1, 1)
EMAIL = Options(registry=rule_registry().only(["EMAIL"]))


def breaker_model(events, threshold, recovery, half_open):
    state, failures, good, opened, out = "closed", 0, 0, None, []
    for t, ok in events:
        if state == "open" and t - opened >= recovery:
            state, good = "half_open", 0
        if ok:
            failures = 0
            if state == "half_open":
                good += 1
                state = "closed" if good >= half_open else state
        else:
            failures += 1
            if state == "half_open" or failures >= threshold:
                state, opened = "open", t
        out.append((state, failures))
    return out


EVENTS = [(k * 7, k % 5 not in (1, 2, 3)) for k in range(40)]


def events_table(spark):
    return spark.createDataFrame([("a", T0 + dt.timedelta(seconds=t), ok) for t, ok in EVENTS], "key string, ts timestamp, ok boolean")


def test_breaker_equals_the_model(spark):
    got = cache.breaker(events_table(spark), "key", "ts", "ok", 3, 20, 2).orderBy("ts").collect()
    assert [(r.state, r.failures) for r in got] == breaker_model(EVENTS, 3, 20, 2)


def test_cache_expiry(spark):
    times = [0, 100, 300, 301, 302, 700, 1000, 1001]
    rows = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=t)) for t in times] + [("b", T0)], "k string, ts timestamp")
    got = cache.expiring_hits(rows, "k", "ts", 300).orderBy("k", "ts").collect()
    assert [r.hit for r in got] == [False, True, True, False, True, False, True, False, False]


def test_dedupe_runs_once_each(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id int, text string")
    out = cache.once_each(rows, "text", lambda d: d.withColumn("n", F.length("text")))
    assert sorted((r.id, r.n) for r in out.collect()) == [(1, 1), (2, 1), (3, 1), (4, None)]
    stats = cache.dedupe_stats(rows.filter("id < 4")).first()
    assert (stats.total, stats["size"], stats.hits, stats.misses, stats.hit_rate) == (3, 2, 1, 2, 0.3333)


def test_histogram_and_bucket_quantile(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 50)], "v double")
    hist = metrics.histogram(rows, "v", (2, 4, 10))
    assert [(r.le, r.n) for r in hist.collect()] == [(2.0, 2), (4.0, 4), (10.0, 5), (None, 6)]
    assert metrics.bucket_quantile(hist, 0.5).first().value == pytest.approx(3.0)
    assert metrics.bucket_quantile(hist, 1.0).first().value == pytest.approx(10.0)


def test_stats_of_nothing(spark):
    got = metrics.pipeline_stats(spark.createDataFrame([], "ok boolean, ms double")).first()
    assert (got.processed, got.errors, got.avg_ms, got.error_rate) == (0, 0, 0.0, 0.0)
    cases = spark.createDataFrame([("a", True), ("b", False)], "text string, detected boolean")
    assert metrics.detection_rate(cases).first().asDict() == {"total": 2, "rate": 0.5, "misses": ["b"]}


def test_jsonl_lines(spark, tmp_path):
    lines = ['{"id": "a", "prompt": "p", "response": "r", "metadata": {"k": 1}}', "", "plain text", '{"text": "only text"}', "{broken"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    got = {r.sample_id: r for r in files.read_any(spark, str(tmp_path / "x.jsonl")).collect()}
    assert got["a"].prompt == "p" and got["a"].response == "r" and json.loads(got["a"].metadata) == {"k": 1}
    assert got["line-2"].prompt == "plain text" and got["line-3"].prompt == "only text" and got["line-4"].prompt == "{broken"


def test_files_are_redacted(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name,mail\nbob,a@b.com\n")
    out = files.redact_file(spark, str(tmp_path / "x.csv"), EMAIL)
    assert spark.read.csv(out, header=True).first().asDict() == {"name": "bob", "mail": "[EMAIL_1]"}
    (tmp_path / "y.json").write_text(json.dumps({"a": "x@y.com", "n": 3, "deep": {"list": ["u@v.com", "ok"], "n": 1}}))
    row = spark.read.json(files.redact_file(spark, str(tmp_path / "y.json"), EMAIL)).first()
    assert row.a == "[EMAIL_1]" and row.n == 3 and row.deep.list == ["[EMAIL_1]", "ok"]
    for name in ("x.pdf", "x.xlsx"):
        with pytest.raises(NotImplementedError):
            files.read_any(spark, name)
    with pytest.raises(ValueError):
        files.read_any(spark, "x.odd")


def test_stream_equals_batch_and_fans_out(spark, tmp_path):
    rows = [("s1", "a@b.com", "b@c.com"), ("s2", "none", None), ("s3", "c@d.com", "")]
    spark.createDataFrame(rows, "sample_id string, prompt string, response string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("sample_id string, prompt string, response string").parquet(str(tmp_path / "in"))
    seen, failed = [], []

    def broken(batch, number):
        raise ValueError("handler")

    query = stream.fan_out(stream.redact_stream(source, EMAIL), [broken, lambda b, n: seen.extend(b.collect())], str(tmp_path / "cp"), on_error=failed.append)
    assert query.awaitTermination(60)
    batch = stream.redact_stream(spark.read.parquet(str(tmp_path / "in")), EMAIL).collect()
    assert sorted(map(str, seen)) == sorted(map(str, batch)) and len(failed) >= 1


def test_windowed_rate_stream(spark, tmp_path):
    events_table(spark).withColumn("kind", F.lit("x")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, ts timestamp, ok boolean, kind string").parquet(str(tmp_path / "in"))
    q = stream.rate_stream(source, "ts", "1 minute", 60, "1 minute", "kind").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sum(r.rate * 60 for r in spark.table("rates").collect()) == pytest.approx(len(EVENTS))


def test_breaker_stream_equals_the_model(spark, tmp_path):
    events_table(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, ts timestamp, ok boolean").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = stream.breaker_stream(source, threshold=3, recovery_seconds=20, half_open=2)
        q = out.writeStream.format("memory").queryName("breaker").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(r.state, r.failures) for r in spark.table("breaker").orderBy("ts").collect()]
    assert got == breaker_model(EVENTS, 3, 20, 2)


def test_fresh_texts_stream(spark, tmp_path):
    rows = [(T0, "x"), (T0 + dt.timedelta(seconds=1), "x"), (T0, "y")]
    spark.createDataFrame(rows, "ts timestamp, prompt string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, prompt string").parquet(str(tmp_path / "in"))
    q = stream.fresh_texts(source, "ts").writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(r.prompt for r in spark.table("fresh").collect()) == ["x", "y"]


def test_memory_and_print_sinks(spark, tmp_path):
    rows = [(f"s{k}", "x" * 300, None) for k in range(7)]
    spark.createDataFrame(rows, "sample_id string, prompt string, response string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("sample_id string, prompt string, response string").parquet(str(tmp_path / "in"))
    held, lines = stream.MemorySink(3), []
    query = stream.fan_out(stream.redact_stream(source, EMAIL), [held, stream.print_sink(10, 2, lines.append)], str(tmp_path / "cp"))
    assert query.awaitTermination(60)
    assert held.seen == 7 and len(held.rows) == 3 and len(lines) in (2, 4) and "'" + "x" * 10 + "'" in lines[0]


def test_counters_gauges_and_targets(spark):
    requests = spark.createDataFrame([("/a", 200), ("/a", 200), ("/a", 503), ("/b", None)], "endpoint string, status int")
    got = {(r.endpoint, r.status): (r.requests, r.errors) for r in metrics.request_counts(requests).collect()}
    assert got == {("/a", 200): (2, 0), ("/a", 503): (1, 1), ("/b", None): (1, 1)}
    samples = spark.createDataFrame([("q", T0, 1.0), ("q", T0 + dt.timedelta(seconds=1), 5.0), ("r", T0, 2.0)], "name string, ts timestamp, value double")
    assert {r.name: r.value for r in metrics.gauges(samples).collect()} == {"q": 5.0, "r": 2.0}
    cases = spark.createDataFrame([([], ["EMAIL"]), ([], []), (["PHONE"], ["PHONE"]), (None, None)], "expected array<string>, entities array<string>")
    assert metrics.false_positives(cases).first().asDict() == {"total": 3, "false_positives": 1, "false_positive_rate": pytest.approx(1 / 3)}
    served = spark.createDataFrame([(True, 10.0)] * 1200, "ok boolean, ms double")
    assert metrics.service_level(served, 2.0).first().asDict() == {"throughput": 600.0, "p50": 10.0, "p99": 10.0, "error_rate": 0.0, "met": True}
    assert not metrics.service_level(served.withColumn("ok", F.rand(1) > 0.5), 2.0).first().met


@pytest.mark.parametrize("few", [1 << 18, 10])
def test_quantiles_are_exact(spark, monkeypatch, few):
    import random

    monkeypatch.setattr(metrics, "FEW_VALUES", few)

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([1.0, 2.0, rng.random(), None])) for _ in range(400)] + [("c", None), ("d", 7.0)]
    table = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.p50, r.p95) for r in metrics.quantiles(table, "v", (0.5, 0.95), "k").collect()}
    want = {r.k: (r.p50, r.p95) for r in table.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.95)).alias("p95")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in "abd") and got["c"] == (None, None)


def test_settings_from_the_environment():
    from veilstone.settings import Settings

    held = Settings.from_env({"VEILSTONE_PROFILE": "scored", "VEILSTONE_CATEGORIES": "PII, PHI", "VEILSTONE_STRICT": "yes", "VEILSTONE_THRESHOLD": "0.5", "OTHER": "x"})
    assert held.options().categories == ("PII", "PHI") and held.strict and held.options().threshold == 0.5 and held.options().profile == "scored"
    for wrong in ({"VEILSTONE_NOPE": "1"}, {"VEILSTONE_STRICT": "maybe"}, {"VEILSTONE_PROFILE": "x"}):
        with pytest.raises((KeyError, ValueError)):
            Settings.from_env(wrong)
