"""SentencePiece BPE encoding in vectorised merge rounds, and decoding.

Symbols of many words lie in one flat numpy array. Each round takes every word's smallest pair
rank, merges its leftmost non-overlapping occurrences at once, and compacts; a word without a
pair leaves. Where a merged piece could at once take part in a better-ranked pair, only the
leftmost occurrence merges in that round, so the order is the library's.

Cases: null or empty texts have no ids and decode to an empty string; unknown characters fall
back to bytes; long words only mean more rounds; repeated rows are encoded each; further columns
of the table pass through unchanged.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(1) << 40
SPACE = "▁"
SLICE_CHARS = 1 << 20
CACHE_WORDS = 200_000


class PieceModel:
    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        piece = {sp.id_to_piece(i): i for i in range(size) if not special(i)}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in piece):
            raise ValueError("pieces that cross words are not supported")
        self.size = size
        self.span = size + 0x110000
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.symbol = np.arange(0x110000, dtype=np.int64) + size
        for p, i in piece.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        order = {i: r for r, i in enumerate(sorted(piece.values(), key=lambda i: (-sp.get_score(i), i)))}

        def sym(text: str):
            return int(self.symbol[ord(text)]) if len(text) == 1 else piece.get(text)

        rows = []
        for p, i in piece.items():
            for k in range(1, len(p)):
                left, right = sym(p[:k]), sym(p[k:])
                if left is not None and right is not None:
                    rows.append((left * self.span + right, order[i], left, right))
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.int64)
        self.ranks = np.array([r[1] for r in rows], np.int64)
        self.piece_of_rank = np.array(sorted(order, key=order.get), np.int64)
        best = np.full(self.span, NONE)
        for _, rank, left, right in rows:
            best[left], best[right] = min(best[left], rank), min(best[right], rank)
        self.eager = best[self.piece_of_rank] < np.arange(len(self.piece_of_rank))  # by rank of the merge
        self.text_of = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
                        else b" \xe2\x81\x87 " if sp.is_unknown(i)
                        else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (in which spaces stand as the space mark)."""
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(sym), NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        done_sym, done_word = [], []
        while len(sym):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, head)
            count = np.diff(np.r_[head, len(sym)])
            if (least == NONE).any():
                over = np.repeat(least == NONE, count)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank = sym[~over], word[~over], rank[~over]
                count, least = count[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            p = np.flatnonzero(rank == np.repeat(least, count))
            fresh = np.r_[True, np.diff(p) > 1]  # a pair ranked NONE ends each word, so runs stay inside
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(p)), 0))
            first = np.r_[True, word[p[1:]] != word[p[:-1]]]
            p = p[((np.arange(len(p)) - run) % 2 == 0) & (first | ~self.eager[rank[p]])]
            sym[p] = self.piece_of_rank[rank[p]]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            new = p - np.arange(len(p))
            sym, word, rank = sym[keep], word[keep], rank[keep]
            touched = np.unique(np.r_[new, new[new > 0] - 1])
            nxt = np.minimum(touched + 1, len(sym) - 1)
            inside = (touched + 1 < len(sym)) & (word[nxt] == word[touched])
            rank[touched] = np.where(inside, self._rank(sym[touched], sym[nxt]), NONE)
        if not done_sym:
            return [np.empty(0, np.int64) for _ in words]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        raw = np.flatnonzero(sym >= self.size)
        if len(raw):
            coded = [chr(c).encode("utf-8", "replace") for c in sym[raw] - self.size]
            n = np.ones(len(sym), np.int64)
            n[raw] = [len(c) for c in coded]
            at = np.repeat(sym >= self.size, n)
            sym, word = np.repeat(sym, n), np.repeat(word, n)
            sym[at] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        return np.split(sym, np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def decode(self, ids) -> str:
        out = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    def words(self, text: str) -> list[str]:
        return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        made = self.encode_words(self.words(text)) if text else []
        return np.concatenate(made).tolist() if made else []


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; with ``decoded_col``, the decoded text too."""
    with open(model_path, "rb") as f:
        model = f.read()
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", decoded string" if decoded_col else "")

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe, known = PieceModel(model), {}

        def sha(data: bytes) -> str:
            return hashlib.sha256(data).hexdigest()

        def slices(texts):
            part, size = [], 0
            for t in texts:
                part.append(t or "")
                size += len(part[-1])
                if size >= SLICE_CHARS:
                    yield part
                    part, size = [], 0
            yield part

        for texts in batches:
            rows = []
            for part in slices(texts):
                split = [bpe.words(t) for t in part]
                if len(known) > CACHE_WORDS:
                    known.clear()
                new = list({w for ws in split for w in ws if w not in known})
                for w, ids in zip(new, bpe.encode_words(new)):
                    ids = ids.tolist()
                    known[w] = (len(ids), ",".join(map(str, ids)), b"".join(map(bpe.text_of.__getitem__, ids)))
                for ws in split:
                    found = [known[w] for w in ws]
                    text = b"".join([x[2] for x in found])
                    text = text[1:] if text[:1] == b" " else text
                    row = [sum(x[0] for x in found), sha(",".join([x[1] for x in found]).encode()), sha(text)]
                    rows.append(row + [text.decode("utf-8", "replace")] if decoded_col else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["decoded"] if decoded_col else [])
            yield pd.DataFrame(rows, columns=names)

    udf = F.pandas_udf(encode, fields)
    out = docs.withColumn("__p", udf(F.coalesce(text_col, F.lit(""))))
    added = {"n_tokens": "__p.n_tokens", "ids_sha256": "__p.ids_sha256", "decoded_sha256": "__p.decoded_sha256"}
    if decoded_col:
        added[decoded_col] = "__p.decoded"
    return out.withColumns({k: F.col(v) for k, v in added.items()}).drop("__p")
