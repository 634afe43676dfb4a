"""Token ids in fixed-width bit-packed files.

File: 8-byte magic, then five little-endian int64 (bits per id, ids per block, ids, documents,
offset of the index). Blocks of packed ids follow, each padded to whole bytes, then the index:
document ids, the first token of each document (and the end), and the byte offset of each block.
Any id is reached from its block's offset; a block is unpacked by numpy at once.

Cases: null texts are empty and hold the end id alone; repeated ids stay, in order of text; null
ids come first and are read back as null (a file holds the smallest 64-bit integer, which is no id,
in their place); an empty table writes no file; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import shared_dir, write_and_reread

MAGIC = b"GLNRTOK1"
BLOCK = 1 << 16
ROWS_PER_SHARD_BYTES = 32 << 20  # text bytes that one file aims at
BATCH = 256
NULL_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def _lanes(bits: int):
    """For each of 64 ids that fill ``bits`` words: lane, word, shift, and whether it runs on into the next word."""
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        yield lane, word, np.uint64(shift), shift + bits > 64


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Id k takes bits k * bits and following, the lowest first; 64 ids fill ``bits`` words of 64 bits."""
    groups = -(-len(ids) // 64)
    wide = np.zeros(groups * 64, np.uint64)
    wide[: len(ids)] = ids
    wide, out = wide.reshape(groups, 64), np.zeros((groups, bits), "<u8")
    for lane, word, shift, runs_on in _lanes(bits):
        out[:, word] |= wide[:, lane] << shift
        if runs_on:
            out[:, word + 1] |= wide[:, lane] >> (np.uint64(64) - shift)
    return out.tobytes()[: (len(ids) * bits + 7) // 8]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    groups = -(-n // 64)
    words = np.frombuffer(data.ljust(groups * bits * 8, b"\0"), "<u8").reshape(groups, bits)
    out, mask = np.empty((groups, 64), np.uint32), np.uint64((1 << bits) - 1)
    for lane, word, shift, runs_on in _lanes(bits):
        ids = words[:, word] >> shift
        if runs_on:
            ids = ids | words[:, word + 1] << (np.uint64(64) - shift)
        out[:, lane] = ids & mask
    return out.ravel()[:n]


def qualified(spark, folder: str) -> str:
    """The folder's URI as Spark resolves it, so that tasks write where Spark would."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return re.sub("^file:/+", "file:///", files.makeQualified(path).toString())


def _open(uri: str):
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


class Writer:
    """Streams ids into one file; memory is one block and the index."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.body = self.fs.open_output_stream(self.path)
        self.bits, self.block, self.at = bits, block, 0
        self.docs, self.starts, self.offsets, self.rest, self.n = [], [0], [], np.empty(0, np.uint32), 0

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        self.docs += [NULL_ID if d is None else int(d) for d in doc_ids]
        for x in ids:
            self.n += len(x)
            self.starts.append(self.n)
        self.rest = np.concatenate([self.rest, *ids])
        while len(self.rest) >= self.block:
            self._put(self.rest[: self.block])
            self.rest = self.rest[self.block:]

    def _put(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        data = pack(ids, self.bits)
        self.body.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        for x in (self.docs, self.starts, self.offsets):
            self.body.write(np.asarray(x, np.int64).tobytes())
        self.body.write(MAGIC + np.array([self.bits, self.block, self.n, len(self.docs), self.at], "<i8").tobytes())
        self.body.close()


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(48, size - 48)
        if tail[:8] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.bits, self.block, self.n, n_docs, at = (int(x) for x in np.frombuffer(tail[8:], "<i8"))
        index = np.frombuffer(self.file.read_at(size - 48 - at, at), "<i8")
        self.docs, self.starts, self.offsets = index[:n_docs], index[n_docs:2 * n_docs + 1], index[2 * n_docs + 1:]

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        out = []
        for b in range(first, last + 1):
            n = min(self.block, self.n - b * self.block)
            out.append(unpack(self.file.read_at((n * self.bits + 7) // 8, int(self.offsets[b])), n, self.bits))
        return np.concatenate(out)[start - first * self.block: end - first * self.block]


class ChunkEncoder:
    """Encodes texts by chunks, each distinct chunk once.

    A byte-level tokenizer never lets a piece run from a visible character into white space, so a
    text may be cut before every run of white space. New chunks are encoded many at a time,
    joined; the byte lengths of the ids tell where each chunk ends. Two generations of chunks are
    remembered: what was met since the last change outlives the next one. Tokenizers of another
    make get whole texts.
    """

    PLAIN = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
    ODD = re.compile(r"[^\S \t-\r]")  # white space beyond ASCII: it may join a run
    BREAK = re.compile(r"(?<=\S)(?=[ \t-\r])")
    JOINED = 100_000  # characters encoded at a time
    KNOWN_CHARS = 6 << 20  # of the chunks of one generation

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok, made = Tokenizer.from_str(spec), json.loads(spec)
        first = made.get("pre_tokenizer") or {}
        self.by_chunk = (first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
                         and not made.get("normalizer") and not made.get("truncation") and not made.get("padding")
                         and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                                     for t in made.get("added_tokens") or ()))
        # A character of a byte-level token is one byte; added tokens are ASCII here.
        self.width = np.array([len(self.tok.id_to_token(i) or "") for i in range(self.tok.get_vocab_size())], np.int64)
        self.known, self.older, self.chars = {}, {}, 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, text: str) -> list[str]:
        return self.BREAK.split(text) if self.ODD.search(text) else self.PLAIN.findall(text)

    def _joined(self, chunks: list[str]) -> list[bytes]:
        ids = self._whole(["".join(chunks)])[0]
        ends = np.cumsum([len(c.encode()) for c in chunks])
        at = np.cumsum(self.width[ids])
        cut = np.searchsorted(at, ends) + 1
        if not np.array_equal(at[np.minimum(cut, len(at)) - 1], ends):  # a token of unknown width
            return [x.tobytes() for x in self._whole(chunks)]
        data, cut = ids.tobytes(), (4 * cut).tolist()
        return [data[a:b] for a, b in zip([0, *cut], cut)]

    def _learn(self, chunks: list[str]) -> None:
        apart = [c for c in chunks if c[0] not in " \t\n\v\f\r"]  # a text's first word
        self.known.update(zip(apart, (x.tobytes() for x in self._whole(apart))))
        part, size = [], 0
        for c in chunks:
            if c[0] in " \t\n\v\f\r":
                part.append(c)
                size += len(c)
                if size >= self.JOINED:
                    self.known.update(zip(part, self._joined(part)))
                    part, size = [], 0
        if part:
            self.known.update(zip(part, self._joined(part)))
        self.chars += sum(map(len, chunks))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_chunk:
            return self._whole(texts)
        if self.chars > self.KNOWN_CHARS:
            self.known, self.older, self.chars = {}, self.known, 0
        cut = [self._chunks(t) for t in texts]
        made = [list(map(self.known.get, part)) for part in cut]
        lacking = [k for k, ids in enumerate(made) if None in ids]
        if lacking:
            new = {c for k in lacking for c, ids in zip(cut[k], made[k]) if ids is None}
            met = {c: self.older[c] for c in new & self.older.keys()}
            self.known.update(met)
            self.chars += sum(map(len, met))
            self._learn(list(new - met.keys()))
            for k in lacking:
                made[k] = map(self.known.__getitem__, cut[k])
        return [np.frombuffer(b"".join(ids), np.uint32) for ids in made]


@functools.lru_cache(maxsize=1)
def _encoder(spec: str) -> ChunkEncoder:
    """One per Python worker, so that its tasks share what is known."""
    return ChunkEncoder(spec)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; returns their manifest (shard, uri, n_docs, n_tokens)."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()  # bounded by the vocabulary
    bits = bits_for(Tokenizer.from_str(spec).get_vocab_size())
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = qualified(docs.sparkSession, folder)
    shards = max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // ROWS_PER_SHARD_BYTES)
    # Bounds come from a sample of ids alone; texts order repeated ids inside their partition.
    dealt = narrow.repartitionByRange(int(shards), "id").sortWithinPartitions("id", "text")

    def encode(batches):
        import os

        import pandas as pd
        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok, out = _encoder(spec), None
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"  # a repeated task writes another file
        for pdf in batches:
            for a in range(0, len(pdf), BATCH):
                part = pdf.iloc[a:a + BATCH]
                out = out or Writer(uri, bits)
                made = tok.encode(part["text"].tolist())
                end = np.array([end_id], np.uint32)
                out.add([None if pd.isna(d) else d for d in part["id"]], [np.concatenate([ids, end]) for ids in made])
        if out:
            out.close()
            yield pd.DataFrame({"shard": [shard], "uri": [uri], "n_docs": [len(out.docs)], "n_tokens": [out.n]})

    return write_and_reread(dealt.mapInPandas(encode, "shard int, uri string, n_docs long, n_tokens long"), "tokens")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    sizes = sorted((r.shard, r.n_tokens) for r in manifest.select("shard", "n_tokens").collect())  # a row per file
    starts, at = [], 0
    for shard, n in sizes:
        starts.append((shard, at))
        at += n
    spark = manifest.sparkSession
    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    placed = manifest.join(F.broadcast(spark.createDataFrame(starts, "shard int, base long")), "shard").repartition(
        len(starts), "shard")

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for uri, base in zip(pdf["uri"], pdf["base"]):
                r = Reader(uri)
                for a in range(0, len(r.docs), BATCH):
                    lim = r.starts[a:a + BATCH + 1]
                    ids = r.ids(int(lim[0]), int(lim[-1])).astype("<u4")
                    off = lim - lim[0]
                    crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(off[:-1], off[1:])]
                    docs = pd.array(r.docs[a:a + BATCH], "Int64")
                    docs[docs == NULL_ID] = pd.NA
                    yield pd.DataFrame({"doc_id": docs, "start": base + lim[:-1],
                                        "n_tokens": np.diff(lim), "ids_crc32": crc})

    return placed.select("uri", "base").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
