"""Every query with SQL against DuckDB on the smallest tables, and the streaming census against its batch form."""

import hashlib

import duckdb
import pytest

import __spark_entry__
from lodestrata.plans.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(norm(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_tiling_takes_whole_texts(spark, tmp_path):
    texts = ["é" * 5000, "plain", "", "x" * 4096, "y" * 4097, None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.item_id: (r.digest, r.surfaces) for r in queries()["tile_surfaces"](spark, str(tmp_path)).collect()}
    want = {k: (hashlib.md5(t.encode()).hexdigest(), max(1, -(-len(t.encode()) // 4096))) for k, t in enumerate(texts) if t is not None}
    assert got == want | {5: (None, 1)}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streaming_census(spark, tmp_path):
    from lodestrata.streaming.census import windowed_census

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed_census(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "event_type", "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("census_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM census_out").collect()))
    assert got == sorted(map(tuple, windowed_census(events, "ts", "event_type", "1 day").collect()))
