"""Secret scan: fixed patterns plus character Markov models compared by log-likelihood ratio.

Main path is DataFrame functions only. A match's place is the summed length of the text between
matches and of the matches before it, in code points. The two character models are first-order:
one learns random strings (values that the fixed patterns found), one learns ordinary
identifiers (words); both from a bounded, hash-ordered sample of labelled strings.

Cases: a null text counts as empty and has no spans; repeated rows are scanned each; an empty
table, or one without any base span, gives models that are equal, so no Markov span appears.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, _KEYWORDS)) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"  # runs of 18 and more; a shorter run holds none
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLE_SIZE = 20_000  # labelled strings per class that the models learn from, at most
THRESHOLD = 0.75  # mean log-likelihood ratio per character, natural logarithm


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start, kind_no, end, kind, match>> of leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,match:string>>")
    walked = F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit")),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).alias("start"),
                F.lit(KINDS.index(kind)).alias("kind_no"),
                (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
                F.lit(kind).alias("kind"), x["hit"].alias("match")))).alias("out")),
        lambda acc: acc["out"])
    # Most texts hold no match: they skip the second pass.
    out = F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(none)
    return F.filter(out, keep) if keep else out


def base_spans(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 12
    return F.array_sort(F.concat(spans(text, ASSIGN, "assign", value), spans(text, ACCESS, "access"),
                                 spans(text, HEX, "hex")))


def train(docs: DataFrame, text_col: str = "text", sample_size: int = SAMPLE_SIZE) -> DataFrame:
    """Rows (label, a, b, n): character pair counts of random strings (1) and identifiers (0).

    Labels come from the fixed patterns: values inside base spans are random strings, words of
    six to forty letters are identifiers. At most ``sample_size`` distinct strings of each label,
    the first by hash; identifiers come from as many texts, one word of each.
    """
    text = F.col(text_col)
    randoms = (docs.select(F.explode(base_spans(text)).alias("s"))
               .select(F.regexp_replace(F.col("s.match"), "^.*[:= \"']", "").alias("value")))
    word = F.regexp_extract(text, r"\b([A-Za-z][a-z]{5,39})\b", 1)
    words = docs.select(word.alias("value")).where("value <> ''")

    def sample(df: DataFrame, label: int) -> DataFrame:
        return (df.distinct().orderBy(F.xxhash64("value"), "value").limit(sample_size)
                .select(F.lit(label).alias("label"), "value"))

    rows = sample(randoms, 1).unionByName(sample(words, 0))
    pairs = rows.select("label", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("value") - 1, F.lit(1))),
        lambda i: F.substring("value", i, F.lit(2)))).alias("pair"))
    return (pairs.where(F.length("pair") == 2)
            .groupBy("label", F.substring("pair", 1, 1).alias("a"), F.substring("pair", 2, 1).alias("b"))
            .agg(F.count("*").alias("n")))


def log_ratios(counts: DataFrame) -> list[float]:
    """Ratio of every character pair, row by row of ALPHABET; add-one smoothing. The table has
    at most 2 * 67 * 67 rows whatever the corpus."""
    import math

    n: dict[tuple[int, str, str], int] = {}
    total: dict[tuple[int, str], int] = {}
    for r in counts.where(F.col("a").isin(*ALPHABET) & F.col("b").isin(*ALPHABET)).collect():
        n[r.label, r.a, r.b] = r.n
        total[r.label, r.a] = total.get((r.label, r.a), 0) + r.n
    if {label for label, _, _ in n} != {0, 1}:
        return [0.0] * len(ALPHABET) ** 2

    def logp(label: int, a: str, b: str) -> float:
        return math.log((n.get((label, a, b), 0) + 1) / (total.get((label, a), 0) + len(ALPHABET)))

    return [logp(1, a, b) - logp(0, a, b) for a in ALPHABET for b in ALPHABET]


def markov_spans(text: Column, ratios: list[float], threshold: float = THRESHOLD) -> Column:
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in ratios) + ")")
    found = spans(F.coalesce(text, F.lit("")), CANDIDATE, "markov")
    letters = F.lit(ALPHABET)

    def score(s: Column) -> Column:
        pairs = F.sequence(F.lit(1), F.length(s) - 1)
        step = lambda i: F.element_at(table, (
            (F.instr(letters, F.substring(s, i, F.lit(1))) - 1) * len(ALPHABET)
            + F.instr(letters, F.substring(s, i + 1, F.lit(1)))))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + step(i)) / (F.length(s) - 1)

    return F.filter(found, lambda s: score(s["match"]) > threshold)


def digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, ratios: list[float], text_col: str = "text") -> DataFrame:
    """Adds ``base`` and ``found`` (base and Markov spans, by start, then kind)."""
    text = F.col(text_col)
    return (docs.withColumn("base", base_spans(text))
            .withColumn("found", F.array_sort(F.concat("base", markov_spans(text, ratios)))))
