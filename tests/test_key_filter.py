"""The key filter, and crawls that move only what changed."""

import pytest
from pyspark.sql import functions as F

from marlpit.operators.key_filter import key_filter
from marlpit.plans import crawl as crawls
from marlpit.sources.store import IndexStore
from tests.test_crawl import RULES, _documents, _rows

KEYS = ["source_id", "path"]


@pytest.mark.parametrize("n,most", [(500, None), (500, 64), (1, None), (0, None)])
def test_holds_every_key_and_few_others(spark, n, most):
    keys = spark.range(n).select(F.concat(F.lit("s"), F.col("id") % 7).alias("source_id"), F.col("id").cast("string").alias("path"))
    table = spark.range(5000).select(F.concat(F.lit("s"), F.col("id") % 7).alias("source_id"), F.col("id").cast("string").alias("path"))
    held = {r.path for r in table.where(key_filter(keys, KEYS, n, most)).collect()}
    assert {str(i) for i in range(n)} <= held
    if most is None:
        assert len(held) <= n + 60


def _listing(spark, n, edited):
    rows = [("s" if i % 3 else "t", f"{i:04}.md", f"text {i}" + (" anew" if i in edited else "")) for i in range(n)]
    return _documents(spark, *rows)


def _plan(spark, n, edited):
    rows = spark.createDataFrame(
        [("s" if i % 3 else "t", f"{i:04}.md", "edited" if i in edited else "skip") for i in range(n)],
        "source_id string, path string, action string",
    )
    return crawls.Plan.of(rows)


@pytest.mark.parametrize("edited", [set(range(0, 600, 40)), set(range(600)) - set(range(0, 600, 40))])
def test_only_what_may_have_changed_meets_a_shuffle(spark, tmp_path, monkeypatch, edited):
    """Above the broadcast bound the filter stands below the exchange, for few and for most documents."""
    monkeypatch.setattr(crawls, "BROADCAST_ROWS", 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _listing(spark, 600, edited).write.parquet(str(tmp_path / "listing"))
        listing = spark.read.parquet(str(tmp_path / "listing"))
        picked = crawls._to_reindex(_plan(spark, 600, edited), listing)
        assert {r.path for r in picked.collect()} == {f"{i:04}.md" for i in edited}
        plan = picked._jdf.queryExecution().executedPlan().toString()
        # Of the rows with contents, an exchange gets those that the filter lets through.
        assert "SortMergeJoin" in plan and "ubquery" in plan
        few = min(len(edited), 600 - len(edited))
        moved = _shuffled_content_rows(picked)
        assert few <= moved <= few + 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _shuffled_content_rows(df):
    """Rows written by the exchanges whose rows carry contents, from the plan's metrics."""
    def nodes(plan):
        yield plan
        if plan.nodeName() == "AdaptiveSparkPlan":
            yield from nodes(plan.executedPlan())
        elif plan.nodeName().endswith("QueryStage"):
            yield from nodes(plan.plan())
        else:
            children = plan.children()
            for i in range(children.size()):
                yield from nodes(children.apply(i))

    total = 0
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        if node.nodeName() == "Exchange" and "content" in node.output().toString():
            total += node.metrics().apply("shuffleRecordsWritten").value()
    return total


def test_crawls_agree_below_and_above_the_bound(spark, tmp_path, registry_of, monkeypatch):
    registry = registry_of({"source_id": "s"}, {"source_id": "t"})
    states = []
    for bound in (200_000, 3):
        monkeypatch.setattr(crawls, "BROADCAST_ROWS", bound)
        store = IndexStore(spark, str(tmp_path / f"index-{bound}"))
        for edited in (set(), set(range(0, 80, 10)), set(range(80)) - {5, 6, 7, 8, 9}):
            crawls.crawl(store, registry, _listing(spark, 80, edited), RULES)
        states.append((_rows(store.files(), "source_id", "path", "content_hash", "n_chunks"), _rows(store.chunks(), "source_id", "path", "text")))
    assert states[0] == states[1]
