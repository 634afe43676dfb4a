"""What a masked line may and may not drop."""

from gleaner.llm import lines


def kept(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["kept_text"] for r in lines.dedup_lines(df, **how).orderBy("doc_id").collect()]


def test_rows_of_numbers_stand_for_themselves(spark):
    tables = ["\n".join(" ".join(str(1000 * d + 10 * row + k) for k in range(6)) for row in range(5)) for d in range(3)]
    assert kept(spark, tables) == tables
    assert kept(spark, ["X: 1 Y: 2 Z: 3", "X: 4 Y: 5 Z: 6"]) == ["X: 1 Y: 2 Z: 3", "X: 4 Y: 5 Z: 6"]
    assert kept(spark, ["1 2 3 4 5 6", "1 2 3  4 5 6\nown words"]) == ["1 2 3 4 5 6", "own words"]


def test_templates_with_words_still_recur(spark):
    logs = ["user 17 logged in from 10.0.0.1 again", "user 18 logged in from 10.0.0.2 again"]
    assert kept(spark, logs) == [logs[0], ""]


def test_short_lines_need_more_documents(spark):
    texts = [f"text{k}\nReleased under the MIT License.\n}}\n" for k in range(6)]
    assert kept(spark, texts) == texts
    assert kept(spark, texts, short_docs=6) == [texts[0]] + [f"text{k}\n}}\n" for k in range(1, 6)]


WHO = ["alice", "bob", "carol", "dave", "erin", "frank"]
HOST = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]


def test_fields_that_are_plain_words(spark):
    logs = [f"own text {'abcdef'[k]} here\nUser {WHO[k]} logged in from host {HOST[k]} today" for k in range(6)]
    assert kept(spark, logs) == [logs[0]] + [t.split("\n")[0] for t in logs[1:]]
    # Two lines make no template, nor do three in two documents.
    assert kept(spark, logs[:2]) == logs[:2]
    assert kept(spark, [logs[0], logs[1] + "\n" + logs[2]]) == [logs[0], logs[1] + "\n" + logs[2]]


def test_changed_words_in_copies_are_no_fields(spark):
    words = "a river runs slowly past seven old mills until it meets the grey sea".split()
    copies = [" ".join(words[:k] + ["xyz" + chr(97 + k)] + words[k + 1:]) for k in range(1, 12)]
    assert kept(spark, copies) == copies


def test_lines_that_share_a_stretch_only_stay(spark):
    texts = [f"The {a} {b} of the town {c} {d} {e}" for a, b, c, d, e in
             zip(WHO, HOST, reversed(WHO), reversed(HOST), ["one", "two", "three", "four", "five", "six"])]
    assert kept(spark, texts) == texts


def test_the_most_general_template_counts(spark):
    logs = [f"Job {WHO[k % 6]} was sent to the {HOST[k // 6]} queue for today" for k in range(36)]
    assert kept(spark, logs) == [logs[0]] + [""] * 35


def test_tree_equals_sql(spark, tmp_path):
    """Random lines over few words, so that leaves, ties and half shares come up often."""
    import random

    import duckdb

    from gleaner.llm.oracle import ORACLE
    from gleaner.llm.queries import QUERIES

    rng = random.Random(5)
    forms = ["User # logged in from host # today", "The # door of # house stays shut", "Job # was sent to the # queue for #", "1 2 # 4 5 6 #"]

    def line():
        return "".join(rng.choice(WHO + HOST[:rng.randint(1, 6)]) if c == "#" else c for c in rng.choice(forms))

    rows = [(k, "\n".join(line() for _ in range(rng.randint(0, 4)))) for k in range(150)] + [(150, None), (151, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE["op8_line_dedup"]).fetchall()
    got = QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert 50 < sum(r[2] for r in want) < sum(r[1] for r in want)


def test_clashing_columns_and_empty_table(spark):
    from pyspark.sql import functions as F

    logs = [(k, f"User {WHO[k]} logged in from host {HOST[k]} today") for k in range(4)] + [(None, None), (9, "")]
    df = spark.createDataFrame(logs, "doc_id long, text string")
    more = df.withColumns({c: F.lit(7) for c in ("id", "key", "line", "general", "tpl", "leaf", "no", "wider", "places", "drop")})
    for rows in (df, more):
        got = {r["doc_id"]: r["n_dropped"] for r in lines.dedup_lines(rows).collect()}
        assert got == {0: 0, 1: 1, 2: 1, 3: 1, None: 0, 9: 0}
    assert lines.dedup_lines(more.limit(0)).count() == 0
