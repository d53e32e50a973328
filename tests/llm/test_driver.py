"""What the near-copy stage leaves out of the driver."""

from pyspark.sql import functions as F

from loomrow.llm import components, simhash


def _ran(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_growing_sides_are_not_broadcast(spark, monkeypatch):
    """Sides that grow with the input are joined by shuffles, even where they are small enough to be gathered in the driver."""
    plans = []
    for module in (components, simhash):
        kept = module.checkpoint
        monkeypatch.setattr(module, "checkpoint", lambda df, kept=kept: plans.append(_ran(df)) or kept(df))
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60, 2)] + [(1, 3)], "a long, b long")
    assert {r.node: r.root for r in components.components(links).collect()}[2] == 0
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.lit("one text of some words that occurs again and again number "), (F.col("id") % 5).cast("string")).alias("text"))
    out = simhash.deduplicate(docs, similarity=0.8)
    plans.append(_ran(out))
    assert out.count() >= 1 and len(plans) > 10
    assert not [p for p in plans if "BroadcastExchange" in p]
