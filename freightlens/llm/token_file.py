"""Token ids as fixed-width bit-packed blocks, and the reader.

A token file is a folder of Parquet files with one row per block.  A block holds
whole documents: their ids and token counts, the first id's place in its shard, the
bit width, and the payload, in which id i takes bits [i * width, (i + 1) * width),
least significant first.  The width is the least that holds the vocabulary.  Blocks
unpack by numpy without touching others; a document is found by its block's document
list and the running sum of its counts.

Shards are ranges of doc_id in order, so concatenating shards and blocks gives the
ids in ascending doc_id order.

A text is cut before single white space between two other characters, after such a
line end, and between an ASCII letter and a stop: no token of the byte-level BPE
crosses these places.  Each distinct piece is encoded once per worker, which keeps a
bounded table of the pieces used most.
"""

from __future__ import annotations

import os
import sys
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from ..session import new_path
from . import words as W
from .joins import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_IDS = 1 << 16
#: Distinct pieces a worker keeps; beyond it the half used in most slices stays.
PIECES = 1_000_000
LETTERS = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
STOPS = np.isin(np.arange(256), [ord(c) for c in ",.;:!?"])
SCHEMA = "shard int, block int, width int, n_ids long, at long, doc_ids array<bigint>, counts array<bigint>, payload binary"


def bit_width(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive little-endian fields of ``width`` bits."""
    ids = np.asarray(ids, np.uint32)
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for lo in range(0, len(ids), 1 << 16):  # a multiple of 8 ids ends on a byte
        part = ids[lo : lo + (1 << 16)]
        bits = (part[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        out.append(np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a payload, touching only their bytes."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(payload, f"<u{size}", stop - start, start * size).astype(np.uint32)
    lo = start * width // 8
    raw = np.frombuffer(payload, np.uint8, (stop * width + 7) // 8 - lo, lo)
    bits = np.unpackbits(raw, bitorder="little")[start * width - lo * 8 :][: (stop - start) * width].reshape(-1, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class PieceEncoder:
    """Ids of texts through a table of encoded pieces."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.forget()

    def forget(self):
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.used, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def shrink(self):
        """Keep the half of the table that most slices used."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: PIECES // 2])
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes, dtype=np.int64)
        self.flat = self.flat[np.arange(ends[-1]) - np.repeat(ends - sizes - self.starts[keep], sizes)]
        self.keys, self.starts, self.sizes, self.used = self.keys[keep], ends - sizes, sizes, self.used[keep] // 2

    def _learn(self, keys: np.ndarray, pieces: list[str]):
        # few at a time: an encoding holds much more than its ids
        ids = [e.ids for lo in range(0, len(pieces), 2048) for e in self.tokenizer.encode_batch_fast(pieces[lo : lo + 2048], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), self.flat.dtype, int(sizes.sum()))
        starts = np.cumsum(sizes, dtype=np.int64) - sizes + len(self.flat)
        allk = np.concatenate([self.keys, keys])
        order = np.argsort(allk, kind="stable")
        self.keys, self.starts, self.sizes = allk[order], np.concatenate([self.starts, starts])[order], np.concatenate([self.sizes, sizes])[order]
        self.used = np.concatenate([self.used, np.zeros(len(keys), np.int32)])[order]
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each text)."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        white = W.SPACES[raw]
        first = np.zeros(n, bool)
        first[1:-1] = white[1:-1] & ~white[:-2] & ~white[2:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        first[inner - 1] = False  # the next character belongs to another text
        first[inner] = False  # so does the one before
        first[1:] |= first[:-1] & (raw[:-1] < 32) & (raw[1:] < 128) & white[:-1]  # a lone line end or tab before ASCII is a piece
        first[1:] |= LETTERS[raw[:-1]] & STOPS[raw[1:]]
        first[inner] = True
        first[0] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(CODES[raw] * W.powers(W.BASE, n), out=sums[1:])
        keys = W.mix((sums[ends] - sums[starts]) * W.powers(W.INVERSE, n)[starts])
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > PIECES:
            self.shrink()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        ok = at < len(self.keys)
        known[ok] = self.keys[at[ok]] == distinct[ok]
        if not known.all():
            data = raw.tobytes()
            new = where[~known]
            self._learn(distinct[~known], [data[a:b].decode() for a, b in zip(starts[new], ends[new])])
            at = np.searchsorted(self.keys, distinct)
        self.used[at] += 1
        begin, size = self.starts[at][back], self.sizes[at][back].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(total[-1]) - np.repeat(total[:-1] - begin, size)]
        return ids, np.diff(total[np.searchsorted(starts, offsets, "left")])


#: As the word codes, but telling cases apart.
CODES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _encoder(tokenizer_json: str) -> PieceEncoder:
    state, key = W.worker_state(), ("encoder", zlib.crc32(tokenizer_json.encode()))
    if key not in state:
        state[key] = PieceEncoder(tokenizer_json)
    return state[key]


def write_tokens(docs: DataFrame, tokenizer_json: str, end_id: int, path: str, vocabulary: int | None = None) -> int:
    """Write the ids of every text of ``docs`` (doc_id, text) to ``path``; returns the bit width.

    Null texts are empty; each document ends with ``end_id``.  Rows go in ascending
    doc_id order, null ids first, rows of one id by their text.  An empty table
    writes an empty folder of the schema.
    """
    from tokenizers import Tokenizer

    bounded_batches(docs.sparkSession)
    width = bit_width(max(vocabulary or Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def row(shard, block, at, ids, doc_ids, counts):
        payload = np.concatenate(ids)
        values = [[shard], [block], [width], [len(payload)], [at], [doc_ids], [counts], [pack(payload, width)]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["shard", "block", "width", "n_ids", "at", "doc_ids", "counts", "payload"])

    def run(batches):
        encoder, shard = _encoder(shared.value), TaskContext.get().partitionId()
        ids, doc_ids, counts, held, at, block = [], [], [], 0, 0, 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for lo, raw, offsets in W.slices(batch.column("text"), 1 << 18):
                flat, sizes = encoder.encode(raw, offsets)
                ends = np.cumsum(sizes)
                for i, (stop, size) in enumerate(zip(ends, sizes)):
                    ids += [flat[stop - size : stop], np.array([end_id], np.uint32)]
                    doc_ids.append(names[lo + i])
                    counts.append(int(size) + 1)
                    held += int(size) + 1
                    if held >= BLOCK_IDS:
                        yield row(shard, block, at, ids, doc_ids, counts)
                        at, block = at + held, block + 1
                        ids, doc_ids, counts, held = [], [], [], 0
        if held:
            yield row(shard, block, at, ids, doc_ids, counts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(path)
    return width


def read_documents(spark, path: str) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids_crc32, unpacked from its payload."""
    bounded_batches(spark)
    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("s"))
    before = totals.withColumn("before", F.sum("s").over(Window.orderBy("shard")) - F.col("s")).select("shard", "before")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.array(r["counts"], np.int64)
                ids = unpack(r["payload"], r["width"], 0, r["n_ids"]).astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(crc), r["shard"], np.int32)), pa.array(r["doc_ids"], pa.int64()), pa.array(ends - counts + r["at"]), pa.array(counts), pa.array(crc, pa.int64())],
                    ["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = blocks.mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer_json: str, end_id: int = 2) -> DataFrame:
    """Write a token file of ``docs`` in the shared folder and read its documents back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, tokenizer_json, end_id, path)
    return read_documents(spark, path)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The text of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op4(spark, sf_dir: str) -> DataFrame:
    """Places, counts and checksums of all ``documents`` in a token file."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
