import random
import re
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from gleaner.functions import prepare as prep
from gleaner.functions import text as tx

ALPHABET = ["a", "b", "é", "𝄞", " ", "\t", "\n", "\n", "\r", "\r\n", "\xa0", "\x1c", " ", "#", "."]


def random_texts(n, length, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(length))) for _ in range(n)]


def apply(spark, values, column):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def squeeze_blank(text):
    """Line-by-line restatement of the normalization rules."""
    kept, blanks = [], 0
    for line in re.split("\r\n|\r|\n", text):
        line = line.rstrip()
        blanks = 0 if line else blanks + 1
        if blanks < 3:
            kept.append(line)
    return "\n".join(kept)


def test_normalize_matches_line_rules(spark):
    texts = ["", "\n", "\n\n\n\n", "a\n\n\n\n\nb", "\n\n\n\na", "a\n\n\n\n", "x \t\r\ny"]
    texts += random_texts(600, 24)
    assert apply(spark, texts, tx.normalize_text) == [squeeze_blank(t) for t in texts]


def test_tokenize_and_strip_know_unicode_blanks(spark):
    texts = random_texts(300, 20, seed=3) + ["Rare Term\x1crare", "  "]
    assert apply(spark, texts, tx.tokenize) == [t.lower().split() for t in texts]
    assert apply(spark, texts, tx.strip) == [t.strip() for t in texts]
    assert apply(spark, texts, tx.has_text) == [bool(t.strip()) for t in texts]


def test_preview_cuts_before_it_strips(spark):
    text = "a" * 118 + "\n\nb"
    assert apply(spark, [text], tx.preview) == ["a" * 118]


def test_titles(spark):
    rows = [
        ("x\n  # Head  \nmore", "d/one.md", "markdown"), ("## no", "d/two.tar.md", "markdown"),
        ("# not used", "d/three.txt", "text"), ("#none", ".md", "text"),
    ]
    df = spark.createDataFrame(rows, "raw string, path string, fmt string")
    got = df.select(tx.document_title(F.col("raw"), F.col("path"), F.col("fmt"))).collect()
    assert [r[0] for r in got] == ["Head", "two.tar", "three", ".md"]


@pytest.mark.parametrize("raw, want", [
    ("Hello, World!", "hello-world"), ("  a__b -- c ", "a-b-c"), ("!!!", "doc"),
    ("Ünï Çode_9", "ünï-çode-9"), ("x" * 90, "x" * 80), ("-a-", "a"),
])
def test_slugify(spark, raw, want):
    assert apply(spark, [raw], prep.slugify) == [want]


def test_url_title_follows_urlparse(spark):
    urls = [
        "https://a.b/docs/My-Page_one.HTML?x=1#y", "http://a.b/", "", "a/b%20c+d.md", "//h/p/q.mdx/",
        "https://h/x;v=1", "https://h/50%zz", "mailto:me", "/only/path/",
    ]

    def expected(url):
        parts = [p for p in urlparse(url).path.split("/") if p]
        name = re.sub(r"\.(html?|mdx?)$", "", unquote(parts[-1]), flags=re.I) if parts else ""
        return " ".join(re.sub("[-_]+", " ", name).split())

    # A malformed escape stays as it is in both, but only where nothing else is escaped.
    assert apply(spark, urls, prep.url_title) == [expected(u) for u in urls]


def test_first_h1_skips_fences_and_placeholders(spark):
    texts = [
        "```\n# code\n```\n# Real #\n# Later", "# {{ document.title.text }}\n# Next",
        "    # too deep\n## two", "~~~\n# x", "   #  Three blanks  ##",
    ]
    assert apply(spark, texts, prep.first_h1) == ["Real", "Next", "", "", "Three blanks"]


def test_resolve_title_cascade(spark):
    rows = [
        ("Given ", "# H", "http://h/p", "1"), ("{{document.title.text}}", "# H", "http://h/p", "2"),
        (" ", "no heading", "http://h/the-page.html", "3"), ("", "", "", "4"),
    ]
    df = spark.createDataFrame(rows, "t string, x string, u string, i string")
    got = df.select(prep.resolve_title(*[F.col(c) for c in "txui"]).alias("r")).select("r.*")
    assert [tuple(r) for r in got.collect()] == [
        ("Given", "dataset_title"), ("H", "markdown_h1"), ("the page", "source_url_path"),
        ("4", "original_doc_id"),
    ]


def test_chunk_id_is_a_digest_prefix(spark):
    import hashlib

    df = spark.createDataFrame([("d.md", 7, "té")], "d string, s int, t string")
    got = df.select(tx.chunk_id(F.col("d"), F.col("s"), F.col("t"))).first()[0]
    assert got == hashlib.sha256("d.md:7:té".encode()).hexdigest()[:16]


def test_fixed_decimals_match_python(spark):
    rng = random.Random(5)
    values = [k / 16 for k in range(-40, 40)] + [k / 2000 for k in range(400)] + [0.2125, 1e-9, -1e-9, -0.0, 1234567.0625, 17.00015]
    values += [rng.uniform(-30, 30) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 4):
        rows = df.select("v", tx.fixed(F.col("v"), digits).alias("text")).collect()
        assert [r["text"] for r in rows] == [f"{r['v']:.{digits}f}" for r in rows]


def test_report_rounds_exact_value(spark):
    from gleaner.plans import reports

    report = spark.createDataFrame([(16, 0.0625, 0.2125, 0.3125, 0.4)], (
        "n_questions long, hit_rate double, mrr double, mean_context_precision double, mean_context_recall double"))
    text = reports.eval_report_text(report, 5, "bm25").first()["report"]
    assert [line[-5:] for line in text.split("\n")[2:]] == ["0.062", "0.212", "0.312", "0.400"]
