"""Every query with SQL against DuckDB, on the smallest tables; the others give rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from alertloom.plans.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, sf, name):
    query, sql = QUERIES[name]
    got = query(spark, sf)
    if sql is None:
        assert got.count() > 0
        return
    want = duck.sql(sql)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    pick = [want.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r[i] for i in pick)) for r in want.fetchall())


def test_places_of_findings_whose_scores_tie(spark, tmp_path):
    """Means of four values in hundredths, half of them a tie of the third place; read in one split and in several; without kind, subject or value."""
    c = duckdb.connect(config={"threads": 1})
    value = "CASE WHEN i // 8 = 7 OR i % 97 = 0 THEN NULL ELSE round(hash(i) % 190 / 100.0, 2) END"
    c.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i) AS ts, CASE WHEN i // 8 % 50 > 0 THEN i // 8 % 700 END AS user_id, CASE WHEN i % 31 > 0 THEN ['view', 'click'][i % 2 + 1] END AS event_type, {value} AS value, '{{"k": 1}}' AS props
    FROM (SELECT unnest(range(16000)) AS i)) TO '{tmp_path}/events.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)""")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    query, sql = QUERIES["sorted_findings"]
    want = {(kind, subject): place for kind, subject, place in c.sql(sql).fetchall()}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in (size, "16384b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = {(r["kind"], r["subject"]): r["place"] for r in query(spark, str(tmp_path)).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert got == want
