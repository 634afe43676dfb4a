"""Language ID: a bidirectional gated recurrent network over bytes.

Texts are lower-cased and cut into windows of WINDOW bytes, all of them; the network labels every
position of a window, and a document's probabilities are the mean over all its positions. It is
trained here in numpy by backpropagation through time.

Cases: null texts and texts without a letter are ``und`` with score 0; ties go to the label that
sorts first; without labelled rows every document is ``und``; repeated rows are judged each;
further columns are ignored.
"""

import base64
import io
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import write_and_reread

WINDOW = 64
HIDDEN = 12
SAMPLE_DOCS = 400  # labelled documents per language that the network learns from, at most
SAMPLE_WINDOWS = 8  # windows of each such document, at even distances over the whole text
EPOCHS = 8
LANES = 2048
CALIBRATION_ROWS = 20  # labelled documents of about a length that a threshold rests on, where there are as many


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (n, WINDOW), which of them are text, and each window's document."""
    n = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n)), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), n)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.repeat(np.cumsum(n) - n, n)
    rest = size[owner] - (np.arange(len(owner)) - first) * WINDOW
    return flat, np.arange(WINDOW) < rest[:, None], owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Parameters per direction: byte table (3H, 256), U (3H, H); then the output (C, 2H) and bias."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
        self.p = {"out": draw(len(labels), 2 * hidden), "bias": np.zeros((len(labels), 1), np.float32)}
        for d in "fb":
            self.p["byte" + d] = (rng.standard_normal((3 * hidden, 256)) * 0.3).astype(np.float32)
            self.p["u" + d] = draw(3 * hidden, hidden)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """x (T, B); hidden states (T, H, B) and, for training, the gates."""
        h_size, table, u = self.h, self.p["byte" + d], self.p["u" + d]
        states = np.empty((len(x), h_size, x.shape[1]), np.float32)
        h, kept = np.zeros((h_size, x.shape[1]), np.float32), {}
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            e = np.take(table, x[t], axis=1)
            zr = _sigmoid(e[: 2 * h_size] + u[: 2 * h_size] @ h)
            z, r = zr[:h_size], zr[h_size:]
            c = np.tanh(e[2 * h_size:] + u[2 * h_size:] @ (r * h))
            if keep:
                kept[t] = (h, z, r, c)
            h = h + z * (c - h)
            states[t] = h
        return states, kept

    def _probs(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        logits = self.p["out"][:, : self.h] @ f + self.p["out"][:, self.h:] @ b + self.p["bias"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def positions(self, flat: np.ndarray) -> np.ndarray:
        """Label probabilities (T, C, B) of windows (B, T)."""
        x = np.ascontiguousarray(flat.T)
        return self._probs(self._run(x, "f", False)[0], self._run(x, "b", False)[0])

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (documents, C); zeros for empty texts."""
        total = np.zeros((len(texts), len(self.labels)))
        flat, valid, owner = _windows(texts)
        for a in range(0, len(flat), LANES):
            probs = self.positions(flat[a:a + LANES])
            np.add.at(total, owner[a:a + LANES], np.einsum("tcb,bt->bc", probs, valid[a:a + LANES].astype(np.float32)))
        return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]

    def gradients(self, flat: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        x, h_size = np.ascontiguousarray(flat.T), self.h
        (f, kf), (b, kb) = self._run(x, "f", True), self._run(x, "b", True)
        probs = self._probs(f, b)
        weight = (valid.T / valid.sum()).astype(np.float32)
        lanes = np.arange(len(y))
        loss = float(-(np.log(probs[:, y, lanes] + 1e-9) * weight).sum())
        delta = probs.copy()
        delta[:, y, lanes] -= 1
        delta *= weight[:, None, :]
        g = {"bias": delta.sum((0, 2))[:, None],
             "out": np.concatenate([np.einsum("tcb,thb->ch", delta, s) for s in (f, b)], 1)}
        for d, kept, cols in (("f", kf, slice(0, h_size)), ("b", kb, slice(h_size, None))):
            u, dh = self.p["u" + d], np.zeros((h_size, len(y)), np.float32)
            du, de = np.zeros_like(u), np.zeros((256, 3 * h_size), np.float32)
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                h, z, r, c = kept[t]
                dh = dh + self.p["out"][:, cols].T @ delta[t]
                dc = dh * z * (1 - c * c)
                drh = u[2 * h_size:].T @ dc
                dz, dr = dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)
                zr = np.concatenate([dz, dr])
                du[: 2 * h_size] += zr @ h.T
                du[2 * h_size:] += dc @ (r * h).T
                np.add.at(de, x[t], np.concatenate([zr, dc]).T)
                dh = dh * (1 - z) + drh * r + u[: 2 * h_size].T @ zr
            g["u" + d], g["byte" + d] = du, de.T
        return loss, g

    def fit(self, flat: np.ndarray, valid: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128,
            rate: float = 0.01, seed: int = 7) -> float:
        rng, step, loss = np.random.default_rng(seed), 0, 0.0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(flat))
            for a in range(0, len(order), batch):
                i = order[a:a + batch]
                loss, g = self.gradients(flat[i], valid[i], y[i])
                step += 1
                for k, v in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    v -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, labels=np.array(self.labels), **self.p)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> "ByteGru":
        with np.load(io.BytesIO(data)) as z:
            model = cls([str(x) for x in z["labels"]], z["uf"].shape[1])
            model.p = {k: z[k] for k in z.files if k != "labels"}
        return model


def _lower_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def noise_windows(n: int, seed: int = 7) -> list[bytes]:
    """Windows without a language: encoded bytes, keys and random letters, whole or in pieces."""
    rng = np.random.default_rng(seed)
    alphabets = [string.hexdigits[:16], string.ascii_uppercase + string.digits, string.ascii_letters,
                 string.ascii_letters + string.digits + "+/_-=", string.digits + " .,;:|-+xXeE"]
    out = []
    for k in range(n):
        kind = k % (len(alphabets) + 1)
        text = (base64.b64encode(rng.bytes(WINDOW)).decode() if kind == len(alphabets)
                else "".join(rng.choice(list(alphabets[kind]), WINDOW)))
        step = int(rng.integers(8, 2 * WINDOW))  # beyond a window: one piece
        text = (" " if k % 2 else "\n").join(text[a:a + step] for a in range(0, len(text), step))
        out.append(_lower_bytes(text)[:WINDOW])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          noise: bool = False) -> ByteGru | None:
    """Learns from documents that are not held out: per language the first SAMPLE_DOCS by a hash of
    the text, SAMPLE_WINDOWS windows of each. With ``noise`` one more label, ``und``, is learned from
    made windows without a language."""
    text = F.col(text_col)
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    rows = rows.where(F.col(lang_col) != "und") if noise else rows
    labels = sorted(r[0] for r in rows.select(lang_col).distinct().collect())  # one row per language
    if not labels:
        return None
    starts = F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1))
    cuts = F.transform(starts, lambda k: F.substring(
        text, (F.length(text) * k / SAMPLE_WINDOWS).cast("int") + 1, F.lit(WINDOW)))
    flat, valid, y = [], [], []
    for n, label in enumerate(labels):
        part = (rows.where(F.col(lang_col) == label).orderBy(F.xxhash64(text_col), id_col).limit(SAMPLE_DOCS)
                .select(F.explode(F.array_distinct(cuts)).alias("cut")))
        texts = [_lower_bytes(r[0])[:WINDOW] for r in part.collect() if r[0]]  # bounded by the sample
        a, b, _ = _windows(texts)
        flat.append(a)
        valid.append(b)
        y.append(np.full(len(a), n))
    if noise:
        a, b, _ = _windows(noise_windows(sum(map(len, y)) // len(labels)))
        labels, flat, valid, y = [*labels, "und"], [*flat, a], [*valid, b], [*y, np.full(len(a), len(labels))]
    model = ByteGru(labels)
    model.fit(np.concatenate(flat), np.concatenate(valid), np.concatenate(y))
    return model


def predict(docs: DataFrame, model: ByteGru | None, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (mean probability of the label over all positions)."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    data = model.dumps()  # some 25 KB

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        gru = ByteGru.loads(data)
        for texts in batches:
            names, scores, part, size = [], [], [], 0
            for k, text in enumerate(texts):
                part.append(_lower_bytes(text or ""))
                size += len(part[-1])
                if size > 1 << 20 or k == len(texts) - 1:
                    probs = gru.documents(part)
                    names += [gru.labels[i] for i in probs.argmax(1)]
                    scores += np.minimum(probs.max(1), 1.0).tolist()
                    part, size = [], 0
            yield pd.DataFrame({"lang": names, "score": scores}, columns=["lang", "score"])

    made = F.pandas_udf(label, "lang string, score double")(F.coalesce(text_col, F.lit("")))
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return (docs.withColumn("__l", made)
            .withColumn("lang_pred", F.when(lettered, F.col("__l.lang")).otherwise("und"))
            .withColumn("score", F.when(lettered, F.col("__l.score")).otherwise(0.0)).drop("__l"))


def with_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that are in a learned language; columns stay.

    A document goes when it has no letter, when ``und`` is its most probable label, or when the pooled
    probability of its language is below what labelled documents of about its length (by powers of two)
    reach. Where no model could be learned, only documents without a letter go.
    """
    model = train(docs, text_col=text_col, lang_col=lang_col, noise=True)
    if model is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    # Read twice, so stored: the network runs once over each text.
    judged = write_and_reread(predict(docs, model, text_col).withColumn(
        "__size", F.floor(F.log2(F.octet_length(text_col) + F.lit(1))).cast("int")), "judged").where("lang_pred <> 'und'")
    lows = (judged.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != "und")).groupBy("__size")
            .agg(F.count("*").alias("n"), F.percentile_approx("score", 0.001, 100_000).alias("low"))
            .orderBy("__size").collect())  # some thirty rows
    least = F.create_map(*[F.lit(x) for k in range(32) for x in (k, threshold(k, lows))])
    return judged.where(F.col("score") >= F.element_at(least, F.col("__size"))).select(*docs.columns)


def threshold(size: int, lows: list) -> float:
    """Nine tenths of the least ``low`` among the nearest sizes that hold CALIBRATION_ROWS rows together."""
    for reach in range(33):
        near = [r for r in lows if abs(r["__size"] - size) <= reach]
        if sum(r["n"] for r in near) >= CALIBRATION_ROWS or reach == 32:
            return 0.9 * min((r["low"] for r in near), default=0.0)
    return 0.0
