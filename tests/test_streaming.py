import json
from datetime import datetime, timedelta

from quire.operators import journal as J
from quire.streaming import journal as SJ


def _write(path, rows):
    path.mkdir(exist_ok=True)
    (path / "1.json").write_text("\n".join(json.dumps(r, default=str) for r in rows))


def test_streams_agree_with_batch(spark, tmp_path):
    t = datetime(2025, 1, 1, 12)
    searches = [{"search_id": i, "at": t + timedelta(minutes=i), "origin": "mcp" if i % 2 else "http", "query": "q", "hits": [] if i % 5 == 0 else [i, i + 1], "err": ""} for i in range(20)]
    reads = [{"at": t + timedelta(minutes=i + 7), "origin": "mcp" if i % 2 else "http", "chunk_id": i} for i in range(0, 20, 3)]
    _write(tmp_path / "s", searches + searches[:3])
    _write(tmp_path / "r", reads)
    s = spark.readStream.schema(SJ.SEARCH_SCHEMA).json(str(tmp_path / "s"))
    r = spark.readStream.schema(SJ.READ_SCHEMA).json(str(tmp_path / "r"))
    SJ.to_table(SJ.read_events(s, r), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {x.search_id for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = J.read_searches(spark.read.schema(SJ.SEARCH_SCHEMA).json(str(tmp_path / "s")).distinct(), spark.read.schema(SJ.READ_SCHEMA).json(str(tmp_path / "r")))
    assert got == {x.search_id for x in batch.collect()} and got


def test_repeated_rows(spark, tmp_path):
    _write(tmp_path / "s", [{"search_id": i % 2, "at": datetime(2025, 1, 1, 12), "origin": "mcp"} for i in range(4)])
    s = spark.readStream.schema(SJ.SEARCH_SCHEMA).json(str(tmp_path / "s"))
    SJ.to_table(SJ.distinct_searches(s), str(tmp_path / "o"), str(tmp_path / "k")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_windows(spark, tmp_path):
    t = datetime(2025, 1, 1, 12)
    _write(tmp_path / "s", [{"search_id": i, "at": t + timedelta(minutes=30 * i), "origin": "mcp", "hits": [], "err": "x" if i == 1 else ""} for i in range(4)])
    s = spark.readStream.schema(SJ.SEARCH_SCHEMA).json(str(tmp_path / "s"))
    q = SJ.windowed_usage(s).writeStream.format("memory").queryName("usage_windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.searches, r["empty"], r.failed) for r in spark.table("usage_windows").orderBy("start").collect()] == [(2, 1, 1), (2, 2, 0)]


def test_broadcasts_are_bounded_in_bytes(spark):
    from quire.runtime import maybe_broadcast

    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    wide = spark.range(100).selectExpr("id", "repeat('x', 1000) AS body", "array(id, id) AS ids")
    assert hinted(maybe_broadcast(wide)) and not hinted(maybe_broadcast(wide, max_bytes=50_000)) and not hinted(maybe_broadcast(wide, max_rows=99))


def test_tables_are_cleaned_up(spark):
    from pathlib import Path

    from quire.runtime import clean_up, materialise, shared_dir

    assert materialise(spark.range(5)).count() == 5
    work = Path(shared_dir(spark).removeprefix("file:")) / "quire" / spark.sparkContext.applicationId
    assert list(work.iterdir())
    clean_up(spark)
    assert not work.exists() and materialise(spark.range(3)).count() == 3
