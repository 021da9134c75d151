"""Token sequences of a fixed length by bounded-space best-fit packing."""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import pieces, table, text_buffers

LENGTH = 4096
#: The id that ends each document.
END_ID = 1
#: Open bins of a packer. With 64 the sequences are half a percent more than the tokens need at least.
OPEN_BINS = 64
PACKER_ROWS = 131_072
#: Words whose ids a task keeps at most.
CACHE_WORDS = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, run string, at long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class _Index(dict):
    """Numbers words as they are looked up; `new` are those since it was last emptied."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class WordIds:
    """Token ids of texts through ids of their words.

    The tokenizer ends a word at white space, so the ids of a text are those of its ASCII-space-separated words, one
    after the other; each distinct word is tokenized once. ASCII letters can be lowered first, as the tokenizer lowers
    all letters itself, except where a special token's marker is in the text.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.sizes, self.begins, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def add_new(self) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in self.index.new], add_special_tokens=False)]
        first, last = len(self.index) - len(encoded), len(self.index)
        while last > len(self.sizes):
            self.sizes, self.begins = np.concatenate([self.sizes, np.zeros_like(self.sizes)]), np.concatenate([self.begins, np.zeros_like(self.begins)])
        n = np.fromiter(map(len, encoded), np.int64, len(encoded))
        more = int(n.sum())
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + more] = np.fromiter(chain.from_iterable(encoded), np.uint32, more)
        self.sizes[first:last], self.begins[first:last] = n, self.used + np.cumsum(n) - n
        self.used += more
        self.index.new = []

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text without the end id."""
        words = [t.split() if b"<|" in t else t.lower().split() for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.clear()
        counts = [len(w) for w in words]
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, sum(counts))
        if self.index.new:
            self.add_new()
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins[at] - (ends - sizes), sizes)
        all_ids = self.flat[where]
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *counts])]
        return [all_ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_made: dict[int, WordIds] = {}


def word_ids(tokenizer_json: str) -> WordIds:
    """One table for all tasks of a Python worker."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _made:
        _made.clear()
        _made[key] = WordIds(tokenizer_json)
    return _made[key]


def best_fit(lengths: list[int], capacity: int = LENGTH, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, taken in the given order.

    Bit f of `free` says that an open bin has f tokens free; the lowest bit at or above a length is its best fit, and of
    bins with as much room the one that was filled last. With no fit and all bins in use the fullest is closed for a
    new one. Full bins close; so does, as it is, what is open at the end.
    """
    bins, offsets, fill = [0] * len(lengths), [0] * len(lengths), []
    by_free: dict[int, list[int]] = {}
    free, count = 0, 0

    def taken(f: int) -> int:
        nonlocal free
        b = by_free[f].pop()
        if not by_free[f]:
            free ^= 1 << f
        return b

    for i, n in enumerate(lengths):
        fits = free >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = taken(f)
        else:
            if count == open_bins:
                taken((free & -free).bit_length() - 1)
                count -= 1
            b, f = len(fill), capacity
            fill.append(0)
            count += 1
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if f > n:
            by_free.setdefault(f - n, []).append(b)
            free |= 1 << (f - n)
        else:
            count -= 1
    return bins, offsets


def cut(docs: DataFrame, tokenizer_json: str, length: int = LENGTH, run: Column | None = None, at: Column | None = None) -> DataFrame:
    """The pieces of each document, with the run of documents that they are packed with and their place in it."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = [x.split()[0] for x in PIECES.split(", ")]

    def pieces_of(batches):
        words = word_ids(shared.value)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            rows: list[tuple[int, int, int, int, int]] = []
            for i, j in pieces(offsets):
                for r, ids in enumerate(words.ids([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]), i):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    rows += [(r, k, s, len(p := ids[s : s + length]), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), length))]
            r, k, s, n, crc = np.array(rows, np.int64).reshape(-1, 5).T
            take = pa.array(r)
            columns = [batch.column(0).cast(pa.int64()).take(take), pa.array(k.astype(np.int32)), pa.array(s), pa.array(n), pa.array(crc), batch.column(2).take(take), batch.column(3).take(take)]
            yield pa.RecordBatch.from_arrays(columns, names)

    if run is None:
        packers = max(1, docs.select("doc_id").count() // PACKER_ROWS)
        run, at = F.pmod(F.xxhash64("doc_id"), F.lit(packers)).cast("string"), F.xxhash64(F.col("doc_id"), F.lit(1))
    # numbers for the sequences: the scan's splits and rows give each piece its own, in a repeated task the same
    return docs.select("doc_id", "text", run.cast("string").alias("run"), at.cast("long").alias("at")).mapInArrow(pieces_of, PIECES).withColumn("number", F.monotonically_increasing_id())


def _pack(length: int, open_bins: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "doc_id", "piece", "ids_crc32", "number"], kind="stable").reset_index(drop=True)
        bins, offsets = best_fit(rows["length"].tolist(), length, open_bins)
        # a sequence has the number of its first piece, which no other sequence has
        begins = rows["number"].to_numpy()[np.unique(bins, return_index=True)[1]] if len(rows) else np.zeros(0, np.int64)
        rows["sequence_id"], rows["offset"] = begins[np.array(bins, np.int64)], np.array(offsets, np.int64)
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return pack


def pack_sequences(docs: DataFrame, tokenizer_json: str, length: int = LENGTH, run: Column | None = None, at: Column | None = None, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text and END_ID; one longer than `length` is cut into pieces of that length, the
    last may be shorter. Packers of about PACKER_ROWS documents each fill their sequences on their own, in seeded
    order, or one for each value of `run`, in the order of `at`. Null texts count as empty: one id. Repeated rows are
    packed as often as they come, null ids keep their rows; extra columns are not read; an empty table gives an empty
    result.
    """
    return cut(docs, tokenizer_json, length, run, at).groupBy("run").applyInPandas(_pack(length, open_bins), PACKED)


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON, which tasks get by broadcast: its size is fixed."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"), read_tokenizer(tokenizer_path()))
