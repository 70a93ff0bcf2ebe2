"""Stored indexes: what building them shuffles, and what a store holds."""

from collections import Counter

from conftest import DATA
from pyspark.sql import functions as F

from strataframe.functions import vectors as V
from strataframe.operators import index
from strataframe.plans import registry, through_engine
from strataframe.plans.views import Inputs

TEXTS = [(1, "b a B, c C. c zé"), (2, ""), (3, None), (4, " x "), (5, "é é 2 2 2"), (6, "a")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_in_their_row(spark):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    found = index.postings(docs)
    assert "Exchange" not in plan_of(found) and found.dtypes == [("term", "string"), ("id", "bigint"), ("tf", "bigint"), ("dl", "int")]
    words = {1: "b a b c c c zé", 4: "x", 5: "é é 2 2 2", 6: "a"}
    wanted = sorted((t, k, n, len(w.split())) for k, w in words.items() for t, n in Counter(w.split()).items())
    assert sorted(map(tuple, found.collect())) == wanted
    assert index.postings(docs.limit(0)).collect() == []


def test_segments_shuffle_texts_and_not_entries(spark, tmp_path):
    docs = spark.range(500).select("id", F.concat_ws(" ", *(F.concat(F.lit("w"), (F.col("id") * k % 37).cast("string")) for k in range(1, 9))).alias("text"))
    made = index.segments(docs)
    plan = plan_of(made)
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # the texts are below what makes entries
    made.repartition(1).write.parquet(f"{tmp_path}/whole")
    made.write.parquet(f"{tmp_path}/parts")
    totals = index.stats(index.lengths(docs))
    scored = [sorted(map(tuple, index.bm25(spark.read.parquet(f"{tmp_path}/{n}"), totals, ["w1", "w36", "absent"]).collect())) for n in ("whole", "parts")]
    assert scored[0] == scored[1] and len(scored[0]) > 20


def test_a_store_holds_what_its_operations_read(spark, tmp_path):
    """One document by id needs neither postings nor edges; what a later operation reads is added to the same store."""
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    q, run = Inputs(spark, str(tmp_path)), registry.queries()
    assert run["engine_get_by_id"](spark, str(tmp_path)).count() == 1
    store = through_engine.engine_of(q, *through_engine.CONCEPTS).store
    assert {*store.manifest()["tables"]} == {"concept"}
    before = store.manifest()["tables"]["concept"]
    assert run["engine_hubs"](spark, str(tmp_path)).count() > 0
    assert {*store.manifest()["tables"]} == {*through_engine.GRAPH} and store.manifest()["tables"]["concept"] == before


def test_few_tokens_are_remembered(monkeypatch):
    monkeypatch.setattr(V, "_BUCKETS", {})
    many = " ".join(f"t{k}" for k in range(V.REMEMBERED + 1000))
    once = V._hashed(many, 64)
    assert len(V._BUCKETS) <= V.REMEMBERED and (V._hashed(many, 64) == once).all()


def test_hashed_texts_are_arrow_batches(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    found = texts.select("id", V.hashed("text", 32).alias("v"))
    assert "ArrowEvalPython" in plan_of(found)
    assert {r.id: r.v for r in found.collect()} == {k: V._hashed(t, 32).tolist() for k, t in TEXTS}
