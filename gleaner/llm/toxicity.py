"""Toxicity: a subsequence string kernel, Nystroem features over landmarks, a linear support vector machine.

The kernel of two words sums over common subsequences of ORDER characters, each weighted by
DECAY to the length that it spans in both words, so gapped and inserted characters cost little.
Signs that are neither letters nor digits match nothing and only widen gaps. A unit is a word with
the signs inside it (``i-d-i-o-t``), a run of single characters (``i d i o t``), or an overlapping
WINDOW of a longer word; its start and end are signs, too. A sentence is as toxic as its worst
unit, a document as its worst sentence. All units of a text are scored.

Training: labelled documents give labelled sentences (one that also stands in a clean document is
clean); units that sentences of toxic documents hold far more often are the positive examples,
together with gapped variants of them; units of clean sentences are the negative ones, hard ones
being searched among NEGATIVES, and telling units count as negative for the clean sentences that
hold them (only others get variants). The threshold of a document is set on the sample.

Cases: null and empty texts, and texts without a unit of ORDER characters, get the score of no
unit at all (under 0.5); without toxic or clean labels, or without a telling unit, every score is 0;
repeated rows are scored each; null or repeated labels count for what they say, null ones not at
all; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import write_and_reread

ORDER, DECAY = 3, 0.7
WINDOW = 24
START, END = "\x02", "\x03"
STEEP = 4.0  # of the score over the margin
SAMPLE_DOCS = 1500  # labelled documents per class that are learned from, about and at most twice that
POSITIVES, NEGATIVES = 120, 40_000  # units that the machine learns from
LANDMARKS, LANDMARK_CHARS = 40, 12
KNOWN_UNITS = 400_000  # scores that a Python worker keeps
UNIT = re.compile(r"[^\W_](?:\S*[^\W_])?")
SPELLED = re.compile(r"(?<!\S)[^\W_](?:\s[^\W_](?!\S)){2,}")
SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?](?=\S)[^.!?\n]*)*")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def units(text: str) -> set[str]:
    text = text.lower()
    found = set(UNIT.findall(text))
    found.update(SPELLED.findall(text))
    for long in [u for u in found if len(u) > WINDOW]:
        found.remove(long)
        half = WINDOW // 2
        found.update(long[i:i + WINDOW] for i in range(0, len(long) - half, half))
    return found


def sentences(text: str) -> list[str]:
    return SENTENCE.findall(text)


class Kernel:
    """Normalised subsequence kernel of any units with fixed landmarks."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        marked = [START + w + END for w in landmarks]
        self.signs = {c: i + 1 for i, c in enumerate(sorted({c for w in marked for c in w if Kernel.counts(c)}))}
        self.width = max(map(len, marked))
        hot = np.zeros((len(self.signs) + 1, len(landmarks), self.width), np.float32)
        for m, w in enumerate(marked):
            for j, c in enumerate(w):
                if c in self.signs:
                    hot[self.signs[c], m, j] = DECAY ** 2
        self.hot = hot
        self.norms = np.sqrt(self.own(landmarks))

    @staticmethod
    def counts(sign: str) -> bool:
        return sign.isalnum() or sign in (START, END)

    @staticmethod
    def _spread(width: int) -> np.ndarray:
        j = np.arange(width)
        return np.where(j[None, :] >= j[:, None], DECAY ** np.maximum(j[None, :] - j[:, None], 0.0), 0).astype(np.float32)

    @staticmethod
    def _run(match, steps: int, shape: tuple[int, ...]) -> np.ndarray:
        """The recursion over the characters of the first word, for all prefixes of the second one at a time."""
        spread = Kernel._spread(shape[-1])
        partial = [np.zeros(shape, np.float32) for _ in range(ORDER - 1)]  # for prefixes without their last character
        total = np.zeros(shape[:-1], np.float32)
        for p in range(steps):
            m = match(p)
            total += np.einsum("...j,...j->...", m, partial[-1])
            for i in range(ORDER - 2, -1, -1):
                grown = (m * partial[i - 1] if i else m) @ spread
                partial[i] *= np.float32(DECAY)
                partial[i][..., 1:] += grown[..., :-1]
        return total

    @staticmethod
    def own(words: list[str]) -> np.ndarray:
        """Kernel of each word with itself; 0 for words too short."""
        words = [START + w + END for w in words]
        out, by_length = np.zeros(len(words)), {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            if length < ORDER + 2:
                continue
            for a in range(0, len(at), 4096):
                part = at[a:a + 4096]
                code = np.array([[ord(c) if Kernel.counts(c) else -1 for c in words[i]] for i in part])
                out[part] = Kernel._run(lambda p, c=code: np.where((c[:, p:p + 1] == c) & (c[:, p:p + 1] >= 0), np.float32(DECAY ** 2), np.float32(0)),
                                        length, code.shape)
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        words = [START + w + END for w in words]
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            if length < ORDER + 2:
                continue
            for a in range(0, len(at), 1024):
                part = at[a:a + 1024]
                code = np.array([[self.signs.get(c, 0) for c in words[i]] for i in part])
                out[part] = self._run(lambda p, c=code: self.hot[c[:, p]], length, (len(part), *self.hot.shape[1:]))
        norm = np.sqrt(self.own([w[1:-1] for w in words]))[:, None] * self.norms[None, :]
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class Machine:
    """Support vector machine on Nystroem features.

    On the landmarks' kernel values it is linear, and these are sums over subsequences of three
    characters, so that all landmarks together are one weight per subsequence.
    """

    def __init__(self, kernel: Kernel, weights: np.ndarray, bias: float) -> None:
        self.kernel, self.weights, self.bias = kernel, weights, bias
        self.centre = 0.0  # the margin at which a document's score is a half
        side = len(kernel.signs) + 1
        tensor = np.zeros((side, side, side))
        for word, weight, norm in zip(kernel.landmarks, weights, kernel.norms, strict=True):
            code = np.array([kernel.signs.get(c, 0) for c in START + word + END])
            i, j, k, decay = triples(len(code))
            np.add.at(tensor, (code[i], code[j], code[k]), decay * (weight / norm if norm else 0))
        tensor[0], tensor[:, 0], tensor[:, :, 0] = 0, 0, 0  # signs that no landmark has
        self.tensor = tensor.astype(np.float32).ravel()

    def margins(self, words: list[str]) -> np.ndarray:
        out, signs = np.zeros(len(words)), self.kernel.signs
        side = len(signs) + 1
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            i, j, k, decay = triples(length + 2)
            step = max(1, 400_000 // max(len(i), 1))
            for a in range(0, len(at), step):
                part = at[a:a + step]
                code = np.array([[signs.get(c, 0) for c in START + words[x] + END] for x in part], np.int32)
                out[part] = self.tensor[(code[:, i] * side + code[:, j]) * side + code[:, k]] @ decay
        norm = np.sqrt(Kernel.own(words))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0) + self.bias


def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j < k in a word of ``n`` characters and the decay of their span."""
    if n not in _TRIPLES:
        places = np.array(list(combinations(range(n), ORDER)), np.int32).reshape(-1, ORDER)
        _TRIPLES[n] = (*places.T, (DECAY ** (places[:, -1] - places[:, 0] + 1)).astype(np.float32))
    return _TRIPLES[n]


_TRIPLES: dict[int, tuple] = {}


def fit(landmarks: list[str], words: list[str], signs: np.ndarray, weight: np.ndarray, cost: float = 4.0, rounds: int = 60) -> Machine:
    """Squared hinge loss by Newton steps over the margin violators."""
    kernel = Kernel(landmarks)
    values, vectors = np.linalg.eigh(kernel(landmarks).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # K^-1/2 up to a rotation
    x = np.c_[kernel(words).astype(np.float64) @ root, np.ones(len(words))]
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        bad = signs * (x @ w) < 1
        xb = x[bad] * weight[bad, None]
        new = np.linalg.solve(ridge + cost * xb.T @ x[bad], cost * xb.T @ signs[bad])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return Machine(kernel, (root @ w[:-1]).astype(np.float32), float(w[-1]))


def variants(word: str, rng: np.random.Generator) -> list[str]:
    """Gapped and inserted-character forms of a word."""
    out = [sign.join(word) for sign in (" ", ".", "-", "*")]
    for sign in ("*", "x", "e", "1", "."):
        i = int(rng.integers(1, len(word)))
        out.append(word[:i] + sign + word[i:])
    i = int(rng.integers(0, len(word)))
    return [*(v[:WINDOW] for v in out), word[:i] + word[i] + word[i:]]


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.where("toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    rate = F.when(F.col("toxic") == 1, F.lit(SAMPLE_DOCS / max(counts.get(1, 0), 1))).otherwise(F.lit(SAMPLE_DOCS / max(counts.get(0, 0), 1)))
    chosen = known.where(place < rate * (1 << 20)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).limit(4 * SAMPLE_DOCS)
    return write_and_reread(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id"), "labelled")


def _split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(sentences)


def _units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(lambda s: sorted(units(s)))


def _statistics(sample: DataFrame) -> DataFrame:
    """(unit, toxic, clean): how many documents of each label have the unit in a sentence of that label."""
    split = F.pandas_udf(_split, "array<string>")
    lines = sample.select("doc_id", "toxic", F.explode(split("text")).alias("sentence"))
    lines = lines.groupBy("sentence").agg(F.min("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    # A document counts once for a unit, with those of its sentences that no other document has.
    per_doc = lines.groupBy("doc_id", "toxic").agg(F.array_join(F.collect_list("sentence"), "\n").alias("text"))
    found = per_doc.select("toxic", F.explode(F.pandas_udf(_units, "array<string>")("text")).alias("unit")).where(F.length("unit") >= ORDER)
    return found.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def train(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """A machine from the labelled documents outside the held-out fold; None where they teach nothing."""
    sample = _sampled(docs, labels)
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return None
    stats = write_and_reread(_statistics(sample), "units")
    # Log-likelihood ratio of a unit's sentences against the classes' sizes.
    t, c, share = F.col("toxic"), F.col("clean"), size[1] / (size[0] + size[1])
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((t + c) * F.lit(p)))).otherwise(0.0)
    ranked = stats.withColumn("g", 2 * (part(t, share) + part(c, 1 - share))).where((t >= 2) & (t > 4 * share / (1 - share) * c))
    telling = ranked.orderBy(F.desc("g"), "unit").limit(POSITIVES).toPandas()
    positive = list(telling.loc[telling["g"] > max(10.0, 0.04 * telling["g"].max()), "unit"]) if len(telling) else []
    if not positive:
        return None
    usual = stats.where("clean > 0 and toxic <= clean").orderBy(F.desc("clean"), F.xxhash64("unit"), "unit").limit(NEGATIVES).select("unit", "clean")
    often = dict(usual.toPandas().sort_values("unit").itertuples(index=False))
    negative = [w for w in often if w not in set(positive)]
    if not negative:
        return None
    rng = np.random.default_rng(7)
    clean = telling.set_index("unit").loc[positive, "clean"].to_numpy(float)
    toxic = telling.set_index("unit").loc[positive, "toxic"].to_numpy(float)
    sure = np.minimum(toxic, 20) / 20
    twisted = [(v, k) for w, k, c in zip(positive, sure, clean, strict=True) if not c for v in variants(w, rng)]
    forms = positive + [v for v, _ in twisted]
    weights = np.r_[sure, [k for _, k in twisted]]
    landmarks = spread_out([w for w in positive if len(w) <= LANDMARK_CHARS] or positive, LANDMARKS * 5 // 8)
    used = [negative[i] for i in rng.permutation(len(negative))[:1500]]
    for _ in range(3):
        others = spread_out([w for w in used if len(w) <= LANDMARK_CHARS], LANDMARKS - len(landmarks))
        signs = np.r_[np.ones(len(forms)), -np.ones(len(used) + len(positive))]
        weight = np.r_[weights, [0.5 + min(often[w], 40) / 10 for w in used], np.minimum(clean, 20) / 20]
        machine = fit([*landmarks, *others], [*forms, *used, *positive], signs, weight)
        cost = (machine.margins(negative) + 1) * np.sqrt(1 + np.array([often[w] for w in negative]))
        hard = np.argsort(-cost)[:500]
        used = list(dict.fromkeys([*(negative[i] for i in hard), *used]))
    seen = worst_margins(sample, machine).select("margin", "toxic").toPandas().dropna()
    machine.centre = threshold(seen["margin"].to_numpy(), seen["toxic"].to_numpy() == 1)
    return machine


def threshold(margins: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among those between margins that cost few errors of each class."""
    order = np.argsort(margins)
    m, y = margins[order], toxic[order]
    errors = np.r_[0, np.cumsum(y)] / max(y.sum(), 1) + np.r_[np.cumsum(~y[::-1])[::-1], 0] / max((~y).sum(), 1)
    edges = np.r_[m[:1] - 1, m, m[-1:] + 1]
    near = np.flatnonzero(errors <= errors.min() + 0.01)
    best = near[np.argmax(np.diff(edges)[near])]
    return float((edges[best] + edges[best + 1]) / 2)


def spread_out(words: list[str], n: int, close: float = 0.6) -> list[str]:
    """The first ``n`` words that are no near neighbours of an earlier one."""
    pool = words[:400]
    if not pool or n <= 0:
        return []
    alike, out = Kernel(pool)(pool), []
    for i in range(len(pool)):
        if len(out) < n and all(alike[i, j] < close for j in out):
            out.append(i)
    return [pool[i] for i in out]


def worst_margins(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with ``margin``, the largest of any unit of the text; null without a unit."""

    def worst(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            for a in range(0, len(batch), 100):
                sets = [[u for u in units(t) if len(u) >= ORDER] if t else [] for t in batch.iloc[a:a + 100]]
                new = [u for u in set().union(*sets) if u not in known]
                if len(known) + len(new) > KNOWN_UNITS:
                    known, new = {}, list(set().union(*sets))
                for b in range(0, len(new), 20_000):
                    part = new[b:b + 20_000]
                    known.update(zip(part, machine.margins(part).tolist(), strict=True))
                out += [max(map(known.__getitem__, s), default=None) for s in sets]
            yield pd.Series(out, dtype="float64")

    return docs.withColumn("margin", F.nanvl(F.pandas_udf(worst, "double")("text"), F.lit(None).cast("double")))


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs(doc_id, text)``."""
    if machine is None:
        scored = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        above = F.coalesce("margin", F.lit(machine.centre - 2.0)) - F.lit(machine.centre)
        scored = worst_margins(docs.select("doc_id", "text"), machine).select("doc_id", (1 / (1 + F.exp(F.lit(-STEEP) * above))).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
