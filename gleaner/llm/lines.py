"""Line dedup by a tree of log templates of fixed depth.

Tokens with digits, addresses and long hexadecimal or key-like strings become ``<*>``. Masked lines
then go down a tree: token count, leading token, and one of SEGMENTS stretches of the remaining
tokens, whole (a line stands in one leaf per stretch, so lines that differ in fewer fields than
there are stretches meet in some leaf). In a leaf of MIN_VARIANTS masked lines or more, a place
keeps the token that at least half of its lines have (the greater of two) and is a field ``<*>``
otherwise. What that leaves is a template if AGREE percent of its tokens are literal, MIN_WORDS of
them and more than there are fields have a letter, and MIN_VARIANTS masked lines in VARIANT_DOCS
documents fit it. A masked line takes the most general template that it fits (fewest literal
tokens, then the smaller text), else it is its own. So a line with one word changed in a copy is
no template: a field needs three values, none of them in more than half of the lines.

A masked line with ``<*>`` needs MIN_WORDS tokens with a letter, and more of them than fields; a line
short of that (rows of numbers) stands for itself alone, unmasked. A template that stands in
MIN_DOCS documents or more is recurring, a line under MIN_TOKENS tokens from SHORT_DOCS on, unmasked:
its first line (smallest document id, then line) stays, all others go, so that no text is lost altogether.

Cases: null texts stay null and empty ones empty; lines without a letter and under MIN_TOKENS tokens
stay (blank lines, braces, rules); rows equal in id and text are one document for counting and keep or
lose the same lines; an empty table stays empty; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.graph import discard
from gleaner.session import broadcast_if_small, write_and_reread

MIN_DOCS = 2
MIN_TOKENS = 6
MIN_WORDS = 3
SHORT_DOCS = 1_000  # a short sentence recurs by chance
SEGMENTS = 3
MIN_VARIANTS = 3
VARIANT_DOCS = 3
AGREE = 60  # percent
BROADCAST_ROWS = 200_000  # of less than 100 bytes
SEPARATORS = r"[ \t\r\f\x0B]+"
# A whole token, between separators, that holds a digit, @ or ://, or is long and key-like.
VARIABLE = r"(?<![^ \n])(?:[^ \n]*?(?:[0-9@]|://)[^ \n]*|[A-Za-z+/_=-]{24,}(?![^ \n]))"
WORD = r"(?<![^ ])[^ ]*\p{L}[^ ]*"


def spaced(text: Column) -> Column:
    """The text with one space between tokens."""
    return F.regexp_replace(text, SEPARATORS, " ")


def masked(text: Column) -> Column:
    """A spaced text with ``<*>`` for variable tokens."""
    return F.regexp_replace(text, VARIABLE, "<*>")


def _count(line: Column, part: str) -> Column:
    return ((F.length(line) - F.length(F.replace(line, F.lit(part)))) / len(part)).cast("int")


def _wordy(general: Column) -> Column:
    words = F.size(F.regexp_extract_all(general, F.lit(WORD), 0))
    return (words >= MIN_WORDS) & (words > _count(general, "<*>"))


def template(line: Column, general: Column, min_tokens: int = MIN_TOKENS) -> Column:
    """struct<text, short, general> of a spaced line and its masked form; null where the line always stays."""
    short = _count(line, " ") + 1 < min_tokens
    rich = F.when(F.contains(general, F.lit("<*>")), _wordy(general)).otherwise(True)
    made = (F.when(short, F.struct(line.alias("text"), F.lit(True).alias("short"), F.lit(False).alias("general")))
            .when(rich, F.struct(general.alias("text"), F.lit(False).alias("short"), F.lit(True).alias("general")))
            .otherwise(F.struct(line.alias("text"), F.lit(False).alias("short"), F.lit(False).alias("general"))))
    return F.when(~short | line.rlike(r"\p{L}"), made)


def _named(t: Column) -> Column:
    """Two 64-bit hashes of other seeds for a template; a chance collision needs both to agree."""
    return F.struct(F.xxhash64(F.lit(1), t).alias("a"), F.xxhash64(F.lit(2), t).alias("b"), t["short"].alias("short"))


def leaves(general: Column, segments: int = SEGMENTS) -> Column:
    """Hashes of the leaves of a masked line: token count, leading token, one stretch of the others."""
    def of(t: Column) -> Column:
        rest = F.size(t) - 1
        at = [F.floor(rest * k / segments).cast("int") for k in range(segments + 1)]
        return F.array(*(F.xxhash64(F.size(t), t[0], F.lit(k), F.slice(t, at[k] + 2, at[k + 1] - at[k])) for k in range(segments)))

    return F.transform(F.array(F.split(general, " ", -1)), of)[0]


def general_templates(lines: DataFrame) -> DataFrame:
    """(tpl, wider): the template of a leaf for masked lines that fit one; lines(id, tpl, general, leaves)."""
    placed = lines.where("leaves is not null").select("id", "tpl", F.explode("leaves").alias("leaf"))
    # Least and greatest hash are enough to pass leaves of one masked line by; combined before the shuffle.
    shared = write_and_reread(placed.groupBy("leaf").agg(F.min("tpl.a").alias("lo"), F.max("tpl.a").alias("hi"))
                              .where("lo <> hi").select("leaf"), "leaves")
    met = write_and_reread(placed.join(broadcast_if_small(shared, BROADCAST_ROWS), "leaf").distinct(), "met")
    full = met.select("leaf", "tpl").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_VARIANTS)
    held = write_and_reread(met.join(full.select("leaf"), "leaf"), "held")
    wanted = broadcast_if_small(held.select("tpl").distinct(), BROADCAST_ROWS)
    tokens = write_and_reread(lines.where("leaves is not null").select("tpl", "general").join(wanted, "tpl").groupBy("tpl").agg(
        F.min("general").alias("general")).select("tpl", F.split("general", " ", -1).alias("toks")), "tokens")
    members = write_and_reread(held.select("leaf", "tpl").distinct().join(tokens, "tpl"), "variants")
    # By leaf, place and token first: a full leaf is spread over its tokens.
    counted = (members.select("leaf", F.posexplode("toks").alias("place", "token"))
               .groupBy("leaf", "place", "token").agg(F.count("*").alias("n")))
    slots = counted.groupBy("leaf", "place").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("lines")).select(
        "leaf", "place", F.when(2 * F.col("top.n") >= F.col("lines"), F.col("top.token")).otherwise("<*>").alias("token"))
    made = slots.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))),
                                                 lambda x: x["token"]).alias("slots"))
    made = (made.withColumn("wide", F.array_join("slots", " "))
            .withColumn("literals", F.size(F.filter("slots", lambda x: x != "<*>")))
            .where((100 * F.col("literals") >= AGREE * F.size("slots")) & _wordy(F.col("wide"))))
    fits = F.forall(F.zip_with("toks", "slots", lambda a, b: (b == "<*>") | (a == b)), lambda x: F.coalesce(x, F.lit(False)))
    fitting = write_and_reread(members.join(made, "leaf").where(fits).select("leaf", "tpl", "literals", "wide"), "fitting")
    enough = fitting.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_VARIANTS)
    chosen = (fitting.join(enough.select("leaf"), "leaf").groupBy("tpl")
              .agg(F.min(F.struct("literals", "wide")).alias("x")).select("tpl", "x.wide"))
    chosen = write_and_reread(chosen, "chosen")
    often = (held.select("id", "tpl").distinct().join(chosen, "tpl").select("id", "wide").distinct()
             .groupBy("wide").agg(F.count("*").alias("docs")).where(F.col("docs") >= VARIANT_DOCS))
    wider = F.struct(F.col("wide").alias("text"), F.lit(False).alias("short"), F.lit(True).alias("general"))
    result = write_and_reread(chosen.join(often.select("wide"), "wide").select("tpl", _named(wider).alias("wider")), "wider")
    discard(shared, met, held, tokens, members, fitting, chosen)
    return result


def doomed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                 min_tokens: int = MIN_TOKENS, short_docs: int = SHORT_DOCS) -> DataFrame:
    """(id, key, drop): the numbers of the lines that go, per document (key: hash of the text)."""
    # Masking keeps line ends, so both forms have the same lines.
    parted = (docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), spaced(F.col(text_col)).alias("line"))
              .withColumn("general", masked(F.col("line"))))
    both = F.arrays_zip(F.split("line", "\n", -1).alias("line"), F.split("general", "\n", -1).alias("general"))
    found = F.transform(both, lambda x, i: F.struct(i.alias("no"), F.trim(x["general"]).alias("general"), template(
        F.trim(x["line"]), F.trim(x["general"]), min_tokens).alias("t")))
    kept = F.filter(found, lambda x: x["t"].isNotNull())
    named = F.transform(kept, lambda x: F.struct(x["no"].alias("no"), _named(x["t"]).alias("tpl"), F.when(
        x["t"]["general"], x["general"]).alias("general"), F.when(x["t"]["general"], leaves(x["general"])).alias("leaves")))
    # Read several times below, so the templates are stored: parsing the lines is the costly part.
    lines = write_and_reread(parted.select("id", "key", F.explode(named).alias("l")).select("id", "key", "l.*"), "templates")
    wider = broadcast_if_small(general_templates(lines), BROADCAST_ROWS)
    lines = lines.select("id", "key", "no", "tpl").join(wider, "tpl", "left").select(
        "id", "key", "no", F.coalesce("wider", "tpl").alias("tpl"))
    # By template and document first: a very common template is combined before it meets its like.
    seen = lines.groupBy("tpl", "id").agg(F.min(F.struct("no", "key")).alias("first"))
    recurring = (seen.groupBy("tpl").agg(F.count("*").alias("docs"),
                                         F.min(F.struct("id", "first.no", "first.key")).alias("home"))
                 .where(F.col("docs") >= F.when(F.col("tpl.short"), short_docs).otherwise(min_docs)).select("tpl", "home"))
    recurring = write_and_reread(recurring, "recurring")
    gone = lines.join(broadcast_if_small(recurring, BROADCAST_ROWS), "tpl").where(
        ~(F.col("id").eqNullSafe(F.col("home.id")) & (F.col("no") == F.col("home.no")) & (F.col("key") == F.col("home.key"))))
    return gone.groupBy("id", "key").agg(F.collect_set("no").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                min_tokens: int = MIN_TOKENS, short_docs: int = SHORT_DOCS) -> DataFrame:
    """Adds ``kept_text``, ``n_lines`` and ``n_dropped``; all rows and columns stay."""
    drop = doomed_lines(docs, id_col, text_col, min_docs, min_tokens, short_docs).select(
        F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("drop").alias("__drop"))
    held = docs.withColumn("__hash", F.xxhash64(text_col))
    joined = held.join(drop, held[id_col].eqNullSafe(drop["__id"]) & (held["__hash"] == drop["__key"]), "left")
    lines = F.split(text_col, "\n", -1)
    stay = lambda l: F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("__drop"))
    left = F.array_join(F.transform(F.array(lines), lambda l: F.transform(stay(l), lambda i: F.get(l, i)))[0], "\n")
    return (joined.withColumn("kept_text", F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(left))
            .withColumn("n_lines", F.when(F.coalesce(F.length(text_col), F.lit(0)) == 0, 0).otherwise(F.size(lines)).cast("long"))
            .withColumn("n_dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("long"))
            .withColumn("n_dropped", F.when(F.col("__drop").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_dropped")))
            .drop("__drop", "__id", "__key", "__hash"))
