"""A task of the as-of join holds a chunk, not its range."""

import pytest

from pacelake.operators import asof


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_a_task_of_the_asof_join_holds_a_chunk(spark, monkeypatch, direction):
    left = spark.createDataFrame([(k, t, f"{k}-{t}") for k in (1, 2) for t in range(0, 400, 3)], "k long, t long, name string")
    right = spark.createDataFrame([(k, t, k * 1000 + t) for k in (1, 2) for t in (50, 51, 300)], "k long, t long, v long")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(tuple, asof.asof_join(left, right, ["k"], "t", "t", direction).collect()), key=str)
    monkeypatch.setattr(asof, "CHUNK", 8)
    chunks, carried = [], asof._carried
    monkeypatch.setattr(asof, "_carried", lambda ends, ahead: chunks.append({e["part_"] for e in ends}) or carried(ends, ahead))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = sorted(map(tuple, asof.asof_join(left, right, ["k"], "t", "t", direction).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == want and len(chunks[0]) > 20
