import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: A few queries of each kind; the driver compares all of them.
CHECKED = ["email_redact", "safe_entities", "safe_corpus_tokens", "sample_redact", "docs_with_label", "event_top_users_1h", "validation_status", "lines_parsed"]


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for table in "documents conversations events labels customer".split():
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    rows = entry.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in rows.collect())
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in found.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
