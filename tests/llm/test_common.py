from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import common, exact_dedup, jaccard


def test_results_outlive_other_operators(docs, no_docs):
    """Tables belong to their results: one operator's end deletes nothing that another's result reads."""
    first = exact_dedup.exact_dedup(docs)
    second = jaccard.similar_components(docs)
    exact_dedup.exact_dedup(no_docs)
    assert first.count() == second.count() == docs.count()


def test_scopes_delete_what_they_own(spark):
    with common.Staging(spark):
        with common.Staging(spark) as inner:
            kept = inner.keep(common.stage(spark.range(3), "kept"))
            lost = common.stage(spark.range(3), "lost")
            freed = common.stage(spark.range(3), "freed")
            inner.free(freed)
            assert not common.exists(spark, freed.staged_at)
            assert common.exists(spark, lost.staged_at)
        assert not common.exists(spark, lost.staged_at)
        assert kept.count() == 3
    assert not common.exists(spark, kept.staged_at)


def test_a_scope_closes_on_errors(spark):
    with pytest.raises(ZeroDivisionError), common.Staging(spark):
        table = common.stage(spark.range(3), "table")
        raise ZeroDivisionError
    assert not common.exists(spark, table.staged_at)
    assert not common._scopes


def test_settings_of_the_session_stay(spark, docs):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    exact_dedup.exact_dedup(docs).count()
    assert [spark.conf.get(n) for n in names] == before


@pytest.mark.parametrize(("master", "fine"), [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[3,2,3000]", False), ("yarn", False), ("spark://host:7077", False)])
def test_no_temporary_folder_on_a_cluster(master, fine):
    class Context:
        applicationId = f"app-{master}"

    Context.master = master

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    if fine:
        assert common.shared_dir(Session).startswith("file:")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Session)


def test_broadcasts_are_checked_by_rows_and_bytes(spark, monkeypatch):
    def hinted(frame):
        return "broadcast" in frame._jdf.queryExecution().logical().toString().lower()

    small = spark.range(5).select("id", F.lit("x" * 100).alias("name"))
    assert hinted(common.checked(small))
    assert hinted(common.checked(small, 5))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 400)
    assert not hinted(common.checked(small))
    assert not hinted(common.checked(small, 5))
    assert hinted(common.checked(small.select("id"), 5))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 4)
    assert not hinted(common.checked(small.select("id")))


def test_unused_names(spark):
    df = spark.range(1).select(F.col("id").alias("Sha"), F.col("id").alias("_sha"))
    assert common.unused(df, "sha", "other") == ["__sha", "other"]
