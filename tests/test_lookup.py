"""Lookups by id open few row groups and name ids that are absent."""

import pytest
from pyspark.sql import functions as F

from gleaner.sources.lookup import look_up, look_up_all, write_lookup


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookup") / "table")
    rows = spark.range(40_000).select(
        F.concat(F.lit("q-"), F.col("id")).alias("question_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    write_lookup(rows.unionByName(rows.where("question_id = 'q-7'")), path, "question_id", 10_000)
    return path


def scanned(df) -> int:
    """Rows that left the scan of the stored table."""
    df.collect()
    plan, todo, counts = df._jdf.queryExecution().executedPlan(), [], []
    todo.append(plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan)
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            counts.append(node.metrics().apply("numOutputRows").value())
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return sum(counts)


def test_found_rows_and_skipped_row_groups(spark, stored):
    df = look_up(spark, stored, "question_id", ["q-7", "q-39999", "q-7", None])
    assert sorted(r["question_id"] for r in df.collect()) == ["q-39999", "q-7", "q-7"]
    assert df.columns == ["question_id", "text"]
    assert 0 < scanned(look_up(spark, stored, "question_id", ["q-7"])) < 20_000
    assert look_up(spark, stored, "question_id", []).isEmpty()


def test_absent_id_within_the_range_reads_nothing(spark, stored):
    missing = spark.read.parquet(stored).where("question_id = 'q-7x'")
    assert scanned(missing) == 0


def test_unknown_ids_are_errors(spark, stored):
    with pytest.raises(Exception, match="unknown question_id: q-none"):
        look_up(spark, stored, "question_id", ["q-1", "q-none"]).collect()
    asked = spark.createDataFrame([("q-1",), ("q-1",), (None,)], "x string")
    assert look_up_all(asked, spark.read.parquet(stored), "question_id").count() == 1
    with pytest.raises(Exception, match="unknown question_id: q-none"):
        look_up_all(asked.unionByName(spark.createDataFrame([("q-none",)], "x string")),
                    spark.read.parquet(stored), "question_id").collect()
    with pytest.raises(ValueError, match="at most 1000"):
        look_up(spark, stored, "question_id", [f"q-{i}" for i in range(1001)])
