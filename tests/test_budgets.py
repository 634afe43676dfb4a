"""Smallest budgets beyond any fixed bound, against a plain search."""

import duckdb
from pyspark.sql import functions as F

from gleaner.operators import context
from gleaner.suite.oracle import ORACLE
from gleaner.suite.queries import QUERIES
from tests.test_answers import asked, results, tokens

SF = "/root/testdata/sf0.001"


def test_long_questions_keep_their_row(spark):
    question = "w " * 20_000
    must = asked(spark, question).withColumn("must", F.array(F.lit("d0")))
    found = results(spark, ["a" * 9000, "b" * 400])
    got = context.smallest_contrast_budget(found, must, "must").first()
    assert got["budget"] == 100 + len(question) // 4 + tokens("a" * 9000)


def test_budget_equals_a_search_over_all(spark):
    sizes = [400, 1200, 80, 2400, 640]
    for want in ("d0", "d1", "d3", "d4"):
        found = results(spark, ["a" * n for n in sizes])
        got = context.smallest_contrast_budget(found, asked(spark).withColumn("must", F.array(F.lit(want))), "must").first()
        blocks, best = [tokens("a" * n) for n in sizes], None
        for room in range(sum(blocks) + 1):
            left, took = room, []
            for k, b in enumerate(blocks):
                if b <= left:
                    left -= b
                    took.append(f"d{k}")
            if want in took and len(took) < len(blocks):
                best = room + 100 + int(len("What?") * 0.25)
                break
        assert (got and got["budget"]) == best


def test_question_without_a_budget_has_null(spark, tmp_path):
    spark.createDataFrame([(1, "a", "lonely words")], "doc_id long, source string, text string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "lonely")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 0, [1.0])], "vec_id long, label int, embedding array<float>"
                          ).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in QUERIES["smallest_budgets"](spark, str(tmp_path)).collect()] == [("7", None)]


def test_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(con.execute(ORACLE["smallest_budgets"]).fetchall())
    assert sorted(map(tuple, QUERIES["smallest_budgets"](spark, SF).collect())) == want
