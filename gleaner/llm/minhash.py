"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

Two permutations of DOMAIN places make all signature coordinates: the first deals a shingle its
place, the second, shifted circularly by k, gives coordinate k. Bands of ROWS coordinates make
buckets. Texts of equal words are one representative. Small buckets compare their members; a
larger one is split by size class, since a pair can only link when the smaller set has at least
the given share of the larger one's size. Shingles that one member of large buckets alone holds are in no
intersection there; what is left bounds every similarity, and a member that can reach none of the sizes
around it leaves. In a class, a few leaders at a time meet all members of
other components in their own and the two neighbouring classes and then retire; a class is done when it and
its neighbours are one component. Once a round of leaders finds no link, the members left meet on the
rarest shingles of their sets: shingles that one component alone holds come first and meet nothing, and a
pair meets only where the places of a shingle leave room for a link. So no link between different
components is lost. Every comparison is on full sets. Tables of earlier rounds are deleted.

Cases: null, empty or wordless texts have an empty set, link with nothing and are kept; a
document of fewer than five words has one shingle; repeated ids with equal text are one document;
an empty table gives an empty result; further columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.arrow import batches_of
from gleaner.llm.graph import components, discard
from gleaner.session import write_and_reread

SHINGLE = 5
BANDS, ROWS = 20, 4  # a pair at 0.85 shares no band with probability 4e-7
DOMAIN = 1 << 20
SMALL_BUCKET = 16
BATCH_ROWS = 500  # documents whose sets are in Python at a time
BREAK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), BREAK), lambda w: w != "")


def shingles(w: Column, n: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of the shingles; the words are bound once, not made anew per place."""
    def of(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))),
                           lambda i: F.xxhash64(F.slice(x, i, n)))
        return F.when(F.size(x) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs))

    return F.transform(F.array(w), of)[0]


def permutations(domain: int = DOMAIN, coordinates: int = BANDS * ROWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    place, order = rng.permutation(domain).astype(np.int32), rng.permutation(domain).astype(np.int32)
    return place, np.r_[order, order[:coordinates]]  # the start again: a shift wraps around


def signatures(sets: list[np.ndarray], place: np.ndarray, order: np.ndarray, coordinates: int) -> np.ndarray:
    """(n, coordinates); sets must not be empty."""
    at = place[np.concatenate(sets) & (len(place) - 1)]
    heads = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    return np.stack([np.minimum.reduceat(order[at + k], heads) for k in range(coordinates)], 1)


def with_bands(sets: DataFrame) -> DataFrame:
    """(rep, bands) of non-empty sets."""

    def band(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place, order = permutations()
        for batch in batches:
            out = []
            for a in range(0, len(batch), 200):
                part = [np.asarray(s, np.int64) for s in batch.iloc[a:a + 200]]
                sig = signatures(part, place, order, BANDS * ROWS).astype(np.uint64).reshape(len(part), BANDS, ROWS)
                key = np.zeros(sig.shape[:2], np.uint64)
                for r in range(ROWS):  # a mixing hash of the band's rows, salted by the band
                    key = (key ^ (sig[:, :, r] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(29)
                key += np.arange(BANDS, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
                out += list(key.view(np.int64))
            yield pd.Series(out)

    return sets.withColumn("bands", F.pandas_udf(band, "array<bigint>")("set"))


def size_class(size: Column, percent: int) -> Column:
    """Sets that can link are in the same or in neighbouring classes; the width allows for rounding."""
    return F.floor(F.log(size.cast("double")) / F.lit(np.log(100 / percent) * (1 + 1e-9))).cast("int")


def sizes_fit(x: Column, y: Column, percent: int) -> Column:
    """No intersection is larger than the smaller set, no union smaller than the larger one."""
    return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)


def with_shared(large: DataFrame, texts: DataFrame) -> DataFrame:
    """``large`` with ``shared``: how many shingles of a member some other member of large buckets holds as well."""
    ids = large.select("rep").distinct()
    every = texts.join(ids, "rep", "left_semi").select("rep", F.explode(shingles(words(F.col("text")))).alias("s"))
    alone = every.groupBy("s").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1").groupBy("rep").agg(F.count("*").alias("own"))
    return large.join(alone, "rep", "left").select(*large.columns, (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared"))


def can_link(size: Column, shared: Column, other_size: Column, other_shared: Column, percent: int) -> Column:
    """An intersection holds at most the shared shingles of either set; implies ``sizes_fit``."""
    common = F.least(shared, other_shared)
    return F.lit(100) * common >= F.lit(percent) * (size + other_size - common)


def can_reach(size: Column, shared: Column, least_size: Column, most_shared: Column, percent: int) -> Column:
    """False where a set can link with none of sets of at least that size that share at most so much."""
    common = F.least(shared, most_shared)
    return F.lit(100) * common >= F.lit(percent) * (size + F.greatest(least_size, common) - common)


def rare_pairs(known: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members of different components that meet on a rare shingle and can link.

    Sets are ordered alike, shingles of few members first. The first shingle that two sets share is followed in
    both by all others that they share, so its places bound the intersection. Shingles of one component alone
    are in no such intersection: they only move the others back. At a shingle, members of its most frequent
    component do not meet each other.
    """
    ids = known.select("rep", "size", "c").distinct()
    held = write_and_reread(texts.join(ids, "rep").select(
        "rep", "size", "c", F.explode(shingles(words(F.col("text")))).alias("s")).distinct(), "held")
    common = held.groupBy("s").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("s", "n")
    place = (F.col("size") - F.size("m") + F.col("i")).alias("place")
    rare = (held.join(common, "s").groupBy("rep", "size", "c").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("m"))
            .select("rep", "size", "c", "m", F.posexplode("m").alias("i", "e")).select("rep", "size", "c", F.col("e.s").alias("s"), place)
            .where(F.lit(100) * (F.col("size") - F.col("place")) >= F.lit(percent) * F.col("size")))
    rare = write_and_reread(rare, "rare")
    most = rare.groupBy("s", "c").agg(F.count("*").alias("n")).groupBy("s").agg(F.max_by("c", F.struct("n", "c")).alias("most"))
    x = rare.join(most, "s").where("c <> most").select("s", *(F.col(k).alias(f"x_{k}") for k in ("rep", "size", "c", "place")))
    y = rare.join(most, "s")
    room = F.least(F.col("x_size") - F.col("x_place"), F.col("size") - F.col("place"))
    pairs = (x.join(y, "s").where((F.col("x_c") != F.col("c")) & ((F.col("c") == F.col("most")) | (F.col("x_rep") < F.col("rep")))
                                  & (F.lit(100 + percent) * room >= F.lit(percent) * (F.col("x_size") + F.col("size"))))
             .select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b")).distinct())
    pairs = write_and_reread(pairs, "pairs")
    discard(held, rare)
    return pairs


def verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose full sets reach the similarity, stored in their place.

    Sets are made again for these alone.
    """
    ids = write_and_reread(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "needed")
    sets = write_and_reread(reps.join(ids, "rep", "left_semi").select("rep", shingles(words(F.col("text"))).alias("set")), "sets")
    a, b = (sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    size = F.size(F.array_intersect("set_a", "set_b"))
    links = (pairs.join(a, "a").join(b, "b").withColumn("common", size)
             .where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.size("set_a") + F.size("set_b") - F.col("common")))
             .select("a", "b"))
    links = write_and_reread(links, "links")
    discard(pairs, ids, sets)
    return links


def merged(group: DataFrame, links: DataFrame) -> DataFrame:
    """Components (v, c) joined by new links: those so far as stars, and the links. Both tables are given up."""
    if links.isEmpty():
        return group
    stars = group.select(F.col("v").alias("a"), F.col("c").alias("b")).where("a <> b")
    both = write_and_reread(stars.unionByName(links), "links")
    discard(group, links)
    group = components(both)
    discard(both)
    return group


def near_duplicates(docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per distinct (id, text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The filter reads the text, so that sets are not made a second time for it.
    made = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("w", words(F.col("text")))
    made = made.select("doc_id", F.sha2(F.array_join("w", " "), 256).alias("digest"), shingles(F.col("w")).alias("set"))
    banded = with_bands(made).select("doc_id", F.size("set").cast("long").alias("n_shingles"), "digest", "bands")
    with batches_of(docs.sparkSession, BATCH_ROWS):
        stored = write_and_reread(banded, "bands")
    stored = stored.distinct()
    # The smallest id stands for all documents of equal words; aggregated before the shuffle.
    leads = write_and_reread(stored.groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")
    reps = stored.join(leads, (stored["digest"] == leads["digest"]) & stored["doc_id"].eqNullSafe(leads["rep"]), "left_semi")
    in_buckets = reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket")).distinct()
    sizes = in_buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = write_and_reread(in_buckets.join(sizes, "bucket"), "members")
    one = F.struct("rep", "size")
    small = (members.where(F.col("n") <= SMALL_BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list(one)).alias("m"))
             .select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y"))
             .where((F.col("x.rep") < F.col("y.rep")) & sizes_fit(F.col("x.size"), F.col("y.size"), percent))
             .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")))
    texts = rows.select(F.col("doc_id").alias("rep"), "text").where("rep is not null")
    large = write_and_reread(members.where(F.col("n") > SMALL_BUCKET).select(
        "bucket", "rep", "size", size_class(F.col("size"), percent).alias("cls")), "sized")
    sized, large = large, write_and_reread(with_shared(large, texts), "large")
    discard(sized)
    links = verified(write_and_reread(small.distinct(), "pairs"), texts, percent)
    group, rounds, found = components(links), 0, True
    discard(members, links)
    near = F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1))
    while True:
        known = large.join(group.select(F.col("v").alias("rep"), "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
        # A class can be left when all that its members could link with is in their component, a member
        # when nothing around it is small enough and shares enough.
        mixed = known.groupBy("bucket", "cls").agg(
            F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("size").alias("least"), F.max("shared").alias("most"))
        mixed = mixed.select("bucket", near.alias("cls"), "lo", "hi", "least", "most").groupBy("bucket", "cls").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least").alias("least"), F.max("most").alias("most"))
        known = write_and_reread(
            known.join(mixed.where("lo < hi").drop("lo", "hi"), ["bucket", "cls"])
            .where(can_reach(F.col("size"), F.col("shared"), F.col("least"), F.col("most"), percent)).drop("least", "most"), "open")
        discard(large)
        if known.isEmpty():
            break
        if not found:
            rest = verified(rare_pairs(known, texts, percent), texts, percent)
            group = merged(group, rest)
            break
        # Leaders: per bucket, class and slice, one of the smallest and one of the largest component, and the
        # member with the fewest shingles of its own, which the copies of one text are all near.
        slices = F.pmod(F.xxhash64("rep", F.lit(rounds)), F.lit(1 << min(rounds, 5)))
        pick = F.struct("c", F.xxhash64("rep").alias("h"), "rep", "size", "shared")
        nearest = F.struct(F.col("size") - F.col("shared"), F.xxhash64("rep"))
        leaders = (known.groupBy("bucket", "cls", slices.alias("slice"))
                   .agg(F.min(pick).alias("x"), F.max(pick).alias("y"), F.min_by(pick, nearest).alias("z"))
                   .select("bucket", "cls", F.explode(F.array("x", "y", "z")).alias("l"))
                   .select("bucket", "cls", F.col("l.rep").alias("lead"), F.col("l.c").alias("lead_c"),
                           F.col("l.size").alias("lead_size"), F.col("l.shared").alias("lead_shared")).distinct())
        leaders = write_and_reread(leaders, "leaders")
        met = leaders.select("bucket", near.alias("cls"), "lead", "lead_c", "lead_size", "lead_shared")
        pairs = (known.join(met, ["bucket", "cls"])
                 .where((F.col("c") != F.col("lead_c"))
                        & can_link(F.col("size"), F.col("shared"), F.col("lead_size"), F.col("lead_shared"), percent))
                 .select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct())
        new = verified(write_and_reread(pairs, "pairs"), texts, percent)
        found = not new.isEmpty()
        large = write_and_reread(known.join(leaders.select("bucket", F.col("lead").alias("rep")), ["bucket", "rep"], "left_anti")
                                 .select("bucket", "rep", "size", "cls", "shared"), "large")
        discard(known, leaders)
        group = merged(group, new)
        rounds += 1
    rep_of = leads.join(group.select(F.col("v").alias("rep"), "c"), "rep", "left").select("digest", F.coalesce("c", "rep").alias("component_id"))
    linked = stored.select("doc_id", "n_shingles", "digest").join(rep_of, "digest")
    linked = linked.select("doc_id", "n_shingles", "component_id")
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))  # no text is cut into words again for this
    alone = rows.where(~has_word).select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")).distinct()
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
