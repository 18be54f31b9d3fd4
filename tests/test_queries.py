"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import pandas as pd
import pytest
from conftest import SF_DIR

from strandline.plans import catalogue


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.7g}"
    if isinstance(x, (datetime.datetime, pd.Timestamp)):
        return str(x)[:10]
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.execute(catalogue.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) > 0


@pytest.mark.parametrize("name", ["stream_event_windows", "stream_alert_dedup", "stream_content_dedup"])
def test_streams_read_tables_of_part_files(spark, tmp_path, name):
    for t in ("events", "pages"):
        spark.read.parquet(f"{SF_DIR}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    got, want = (catalogue.QUERIES[name](spark, d).toPandas() for d in (str(tmp_path), SF_DIR))
    assert len(want) > 0
    assert rows(got) == rows(want)


def test_vector_queries_by_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandline.operators import retrieval as R

    v = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").repartition(3)
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    odd = spark.sql("SELECT 9001L AS vec_id, array(1f, 2f) AS embedding, 1 AS label UNION ALL SELECT 9002, NULL, 1 UNION ALL SELECT 9003, array_repeat(0f, 64), 1")
    monkeypatch.setattr(R, "VECTOR_BLOCK", 37)
    both = v.unionByName(odd)
    got = R.dense_blocks(both, "vec_id", "embedding", q, 25)
    assert rows(got.toPandas()) == rows(R.dense(v, "vec_id", "embedding", q, 25).toPandas())
    assert catalogue.QUERIES["vector_topk_cosine_whole"](spark, SF_DIR).select("qid").distinct().count() == q.count() > 3


def test_chunks_match_plain_fold(spark):
    from strandline.operators.documents import chunks, split_text

    texts = [(1, "a b.\n\n" + "word " * 900 + "end. " + "tail " * 50), (2, None), (3, ""), (4, "x\n" * 2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["id"], r["ordinal"]): r["chunk"] for r in chunks(docs, "doc_id", "text").collect()}
    want = {(i, n): c for i, t in texts for n, c in enumerate(split_text(t or "", 1400, 2400))}
    assert got == want


def test_chunks_leave_a_worker_in_slices(spark):
    import pyarrow as pa

    from strandline import runtime

    texts = ["x" * 400_000, None, "", *["é" * 300] * 6000, "y" * 3_000_000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    parts = list(runtime.slices(iter([batch, batch.slice(0, 0)]), 1))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts and [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(texts)))
    sizes = [sum(len((x or "").encode()) for x in p.column(1).to_pylist()) for p in parts]
    assert max(sizes[:-2]) < runtime.SLICE_BYTES + 400_000 and len(parts) > 4


def test_chunks_give_out_a_slice_at_a_time(spark):
    from pyspark.sql import functions as F

    from strandline.operators.documents import chunks

    docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.concat("id", F.lit(" word.\n")), 400).alias("text"))
    got = chunks(docs, "id", "text")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert got.select("id").distinct().count() == 4000
