"""Large buckets of several size classes: components equal to comparing all pairs."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from gleaner.llm import minhash
from tests.llm.test_graph import plain


def test_families_of_many_lengths(spark):
    """A hundred texts from one base, cut and edited: linked ones, and ones that only share bands."""
    rng = random.Random(5)
    base, data = [f"t{j}" for j in range(260)], []
    for k in range(100):
        w = base[:rng.choice((120, 150, 180, 215, 260))]
        for _ in range(rng.choice((0, 1, 2, 5))):
            w[rng.randrange(len(w))] = f"x{k}"
        data.append((k, " ".join(w)))
    sets = {i: {tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)} for i, t in data}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    group = plain([*links, *((i, i) for i in sets)])
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: group.get(i, i) for i in sets}
    assert len(set(group.values())) > 3


def test_neighbouring_classes_hold_every_pair_that_can_link(spark):
    x, y = F.col("x"), F.col("y")
    pairs = spark.range(1, 1200).select(F.col("id").alias("x")).select(
        "x", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("d")).select("x", (x * 100 / 85 - F.col("d")).cast("long").alias("y")).where("y >= x")
    far = pairs.where(minhash.sizes_fit(x, y, 85) & (F.abs(minhash.size_class(x, 85) - minhash.size_class(y, 85)) > 1))
    assert far.isEmpty() and not pairs.where(minhash.sizes_fit(x, y, 85)).isEmpty()


def test_copies_too_far_from_each_other_are_not_compared(spark, monkeypatch):
    """Edits of one text that share buckets but no link: the shingles of their own rule the pairs out."""
    rng, base, data = random.Random(3), [f"t{j}" for j in range(300)], []
    for k in range(80):
        w = list(base)
        for at in rng.sample(range(0, 300, 6), 9 if k < 70 else 1):
            w[at] = f"x{k}_{at}"
        data.append((k, " ".join(w)))
    seen, whole = [], minhash.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(minhash, "verified", counted)
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: min(k, 70) for k in range(80)}
    assert sum(seen[1:]) < 150 and len(seen) < 5


def test_edits_that_many_copies_share_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies of one text with cuts at few places: no shingle is a member's own, most pairs share buckets but no link."""
    rng, base, data = random.Random(9), [f"t{j}" for j in range(146)], []
    for k in range(120):
        w = list(base)
        for at in rng.sample(range(8, 140, 2), rng.choice((0, 1, 3, 4))):
            w[at] = f"x{at}"
        data.append((k, " ".join(w)))
    sets = {i: {tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)} for i, t in data}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    group = plain([*links, *((i, i) for i in sets)])
    seen, whole = [], minhash.verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(minhash, "verified", counted)
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: group.get(i, i) for i in sets}
    assert len({group.get(i, i) for i in sets}) > 20
    assert len(seen) < 6, seen
