"""Similarity join of documents on word n-grams: rare-first prefixes, pairs until all is connected, one verification a pair."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import ROW, components, flat_lists, materialise, mix, row_ids, shingle_sets, table

WIDTH = 5
#: The postings of a prefix n-gram are dealt into blocks of about so many, and each two blocks meet in a group.
BLOCK = 2048
#: Groups of at most so many sets give all their pairs at once; larger ones those with one member first.
SMALL = 8
#: Pairs that one group verifies, about.
CELL_PAIRS = 1 << 16
#: Sets of one component that a task compares with so many others, to count links.
COUNT_BLOCK = 1024
#: Sets of which one has more than 1.25 times the other's size never link, so bands of this ratio meet their neighbours only.
BAND = 1.26
SLICE = 1 << 12
#: Documents are counted in 2^RARITY_BITS n-gram buckets at most, and wanted rows marked in 2^WANTED_BITS bits.
RARITY_BITS, WANTED_BITS = 24, 28

_L, _I = T.LongType(), T.IntegerType()
_schema = lambda **kinds: T.StructType([T.StructField(k, v) for k, v in kinds.items()])
DIGEST = _schema(doc_id=_L, handle=_L, n=_I, sk=_L, alt=_L, least=_L, odd0=_L, odd1=_L, slice=_I, counts=T.BinaryType())
POSTING = _schema(token=_L, sk=_L, n=_I, pos=_I, side=_I)
FOUND = _schema(kind=_I, x=_L, y=_L, n=_I, pos=_I, side=_I)
PAIR = _schema(x=_L, y=_L)


def least_overlap(na, nb):
    """The smallest intersection for which 5 * intersection >= 4 * union."""
    return -(-4 * (na + nb) // 9)


def probe_prefix(n):
    """An overlap with any partner is at least 4n/5, so one common n-gram is among so many first ones."""
    return n - -(-4 * n // 5) + 1


def index_prefix(n):
    """For a partner that isn't smaller the overlap is at least 8n/9."""
    return n - -(-8 * n // 9) + 1


_M = (1 << 64) - 1


def _mixed(x: int) -> int:
    """The finaliser of splitmix64 for one number."""
    x &= _M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M
    return x ^ x >> 31


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Keys:
    """Names sets of n-grams, so that equal sets are one vertex of the join.

    A name is 64 bits of a 128-bit hash. Where sets with different hashes share them, as `clash` lists, all 128 bits go
    into the name. `bits` leaves fewer bits, for tests.
    """

    def __init__(self, clash: frozenset[int] = frozenset(), bits: int = 64):
        self.clash, self.bits = clash, bits

    def both(self, s: np.ndarray, mixed: np.ndarray) -> tuple[int, int]:
        """The 64 bits, and the name to take where they clash; mixed: mix(s)."""
        first = _mixed(int(s.sum(dtype=np.uint64)) + len(s) * 0xD6E8FEB86659FD93 ^ int(np.bitwise_xor.reduce(mixed)))
        second = int(mixed.sum(dtype=np.uint64))
        return _signed(first >> (64 - self.bits)), _signed(_mixed(first ^ second * 9))

    def __call__(self, s: np.ndarray) -> int:
        name, other = self.both(s, mix(s))
        return other if name in self.clash else name


def parities(mixed: np.ndarray) -> np.ndarray:
    """For 128 ranges of hashes whether a set has an odd number in each: sets differ in at least as many elements as bits."""
    odd = np.bincount((mixed >> np.uint64(57)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8")


def _digest(width: int, bits: int, keys: Keys):
    """Of each row its set's size, names, least n-gram and parities; of each task the documents with each n-gram bucket."""

    def run(batches):
        counts = np.zeros(1 << bits, np.int32)
        shift = np.uint64(64 - bits)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int32)
            rest = np.zeros((5, batch.num_rows), np.int64)
            held: list[np.ndarray] = []
            for r, s in shingle_sets(batch.column(1), width):
                n[r] = len(s)
                if len(s):
                    mixed = mix(s)
                    rest[:2, r], rest[2, r], rest[3:, r] = keys.both(s, mixed), s[:1].view(np.int64)[0], parities(mixed)
                    held.append((s >> shift).astype(np.int32))
                if held and (r + 1 == batch.num_rows or len(held) == 256):
                    np.add.at(counts, np.concatenate(held), 1)
                    held = []
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), *[pa.array(x) for x in rest], none.cast(pa.int32()), none.cast(pa.binary())], DIGEST.names)
        size = min(SLICE, len(counts))
        for i in np.flatnonzero(counts.reshape(-1, size).any(1)):
            none = pa.nulls(1).cast(pa.int64())
            c = counts[i * size : (i + 1) * size]
            packed = zlib.compress(c.astype(np.uint8 if c.max() < 256 else np.int32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([none, none, none.cast(pa.int32()), *[none] * 5, pa.array([i], pa.int32()), pa.array([packed], pa.binary())], DIGEST.names)

    return run


def _sum_slices(batches):
    """Adds up the counts of each slice as rows stream by; a task holds its own slices only."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = zlib.decompress(x)
            c = np.frombuffer(raw, np.uint8 if len(raw) <= SLICE else np.int32).astype(np.int64)
            total[i] = total[i] + c if i in total else c
    # half powers of two are enough for an order from rare to frequent
    rank = [np.round(2 * np.log2(c + 1.0)).astype(np.uint8).tobytes() for c in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rank, pa.binary())], ["slice", "counts"])


def rarity(digest: DataFrame, bits: int) -> np.ndarray:
    """For each n-gram bucket the doubled logarithm of its document count: 2^bits bytes, 2^RARITY_BITS at most."""
    parts = digest.where("slice is not null").select("slice", "counts").repartition("slice")
    out = np.zeros(1 << bits, np.uint8)
    size = min(SLICE, len(out))
    for i, x in parts.mapInArrow(_sum_slices, _schema(slice=_I, counts=T.BinaryType())).collect():
        out[i * size : (i + 1) * size] = np.frombuffer(x, np.uint8)
    return out


def _postings(width: int, bits: int, ranks, keys: Keys):
    """The prefix n-grams of each distinct set of a task, in an order from rare to frequent that all documents share.

    The bucket of an n-gram tells about how many postings it may have. Those of a frequent one go, by their sets' sizes
    and keys, to one group for each two blocks of each two neighbouring bands. side: bit 0 for the upper band of the
    group, and 2 or 4 where two different blocks meet.
    """

    def run(batches):
        seen: set[int] = set()
        shift, low = np.uint64(64 - bits), np.uint64((1 << 56) - 1)
        for batch in batches:
            tokens, names, sizes = [], [], []
            for _, s in shingle_sets(batch.column(0), width):
                if len(s) == 0 or (k := keys(s)) in seen:
                    continue
                seen.add(k)
                p = probe_prefix(len(s))
                order = (ranks.value[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s & low)
                tokens.append(np.sort(np.partition(order, p - 1)[:p] if p < len(s) else order).view(np.int64))
                names.append(k)
                sizes.append(len(s))
            p = np.array([len(t) for t in tokens], np.int64)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(p) - p, p)
            sk, n = np.repeat(np.array(names, np.int64), p), np.repeat(np.array(sizes, np.int64), p)
            blocks = np.ceil(2.0 ** ((flat.view(np.uint64) >> np.uint64(56)).astype(float) / 2) / BLOCK).astype(np.int64)
            few = blocks <= 1
            yield _posted(flat[few], sk[few], n[few], pos[few], np.ones(few.sum(), np.int32))
            for b in np.unique(blocks[~few]):
                i = np.flatnonzero(blocks == b)
                band = np.floor(np.log(n[i]) / np.log(BAND)).astype(np.int64)
                own = (mix(sk[i].view(np.uint64)) % np.uint64(b)).astype(np.int64)
                for up in (0, 1):
                    for other in range(b):
                        lo, hi = np.minimum(own, other), np.maximum(own, other)
                        with np.errstate(over="ignore"):
                            spot = (((band + up) * b + lo) * b + hi).astype(np.uint64)
                            group = mix(mix(flat[i].view(np.uint64)) + spot * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                        yield _posted(group, sk[i], n[i], pos[i], (1 - up) + np.where(lo == hi, 0, np.where(own == lo, 2, 4)))

    return run


def _posted(token, sk, n, pos, side) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(sk), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(side.astype(np.int32))], POSTING.names)


def _passes(n1, pos1, n2, pos2):
    """Length, prefix and position filters for a common n-gram of a set and one that is at least as large."""
    need = least_overlap(n1, n2)
    return (5 * n1 >= 4 * n2) & (pos1 < index_prefix(n1)) & (1 + np.minimum(n1 - 1 - pos1, n2 - 1 - pos2) >= need)


def _gather(batches) -> list[np.ndarray]:
    """A partition's columns as arrays; the number of partitions bounds them."""
    parts = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []


def _distinct_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new]


def _found(kind: int, x, y, n=None, pos=None, side=None) -> pa.RecordBatch:
    zero = np.zeros(len(x), np.int32)
    more = [pa.array(zero if c is None else c.astype(np.int32)) for c in (n, pos, side)]
    return pa.RecordBatch.from_arrays([pa.array(zero + np.int32(kind)), pa.array(x, pa.int64()), pa.array(y, pa.int64()), *more], FOUND.names)


class _Groups:
    """A partition's postings by group, each group in the order of its sets' sizes."""

    def __init__(self, columns: list[np.ndarray]):
        token, sk, n, pos, side, *root = columns
        order = np.lexsort((sk, n, token))
        new = np.ones(len(token), bool)
        new[1:] = (token[order][1:] != token[order][:-1]) | (sk[order][1:] != sk[order][:-1])
        order = order[new]
        self.token, self.sk, self.side = token[order], sk[order], side[order]
        self.n, self.pos = n[order].astype(np.int64), pos[order].astype(np.int64)
        self.root = root[0][order] if root else None
        self.begins = np.flatnonzero(np.concatenate(([True], self.token[1:] != self.token[:-1])))
        self.sizes = np.diff(np.append(self.begins, len(self.token)))

    def met(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs (i the smaller set) pass the filters and aren't another group's of the same n-gram."""
        half = self.side >> 1
        mine = (((self.side[i] | self.side[j]) & 1) == 1) & ((half[i] == 0) | (half[i] != half[j]))
        return mine & _passes(self.n[i], self.pos[i], self.n[j], self.pos[j])


def _first_pairs(batches):
    """Kind 0: all pairs of small groups, and of large ones each member with the one where the n-gram comes first.

    Kind 1: the postings of large groups, for the pairs that are still open once those links are known.
    """
    columns = _gather(batches)
    if not columns:
        return
    g = _Groups(columns)
    small = np.repeat(g.sizes <= SMALL, g.sizes)
    xs, ys = [], []
    for d in range(1, SMALL):
        i = np.flatnonzero((g.token[d:] == g.token[:-d]) & small[d:])
        i = i[g.met(i, i + d)]
        xs.append(g.sk[i])
        ys.append(g.sk[i + d])
    large = np.flatnonzero(~small)
    if len(large):
        # the text that others were changed from has the fewest rare n-grams, so the common ones come first in it; groups
        # of different n-grams with much the same members choose the same hub
        by_pos = np.lexsort((g.sk, g.pos, g.token))
        hub = np.repeat(by_pos[g.begins], g.sizes)[large]
        near = g.met(np.minimum(large, hub), np.maximum(large, hub)) & (large != hub)
        xs.append(g.sk[large[near]])
        ys.append(g.sk[hub[near]])
    yield _found(0, *_distinct_pairs(np.concatenate(xs), np.concatenate(ys)))
    yield _found(1, g.token[large], g.sk[large], g.n[large], g.pos[large], g.side[large])


def _open_pairs(batches):
    """All pairs of each group that pass the filters and whose sets aren't known to be connected."""
    columns = _gather(batches)
    if not columns:
        return
    g = _Groups(columns)
    xs, ys, held = [], [], 0
    for begin, size in zip(g.begins, g.sizes, strict=True):
        for i in range(begin, begin + size - 1):
            if g.pos[i] < index_prefix(g.n[i]):
                j = np.arange(i + 1, begin + int(np.searchsorted(g.n[begin : begin + size], 5 * g.n[i] // 4, "right")))
                j = j[g.root[j] != g.root[i]]
                j = j[g.met(np.full(len(j), i), j)]
                xs.append(np.full(len(j), g.sk[i]))
                ys.append(g.sk[j])
                held += len(j)
        if held > 1 << 20:
            yield _found(0, *_distinct_pairs(np.concatenate(xs), np.concatenate(ys)))
            xs, ys, held = [], [], 0
    if xs:
        yield _found(0, *_distinct_pairs(np.concatenate(xs), np.concatenate(ys)))


def _sets(width: int, wanted, keys: Keys):
    """(set key, set) for the rows whose handle is in the bitmap, each once a task; a few others may come too."""

    def run(batches):
        bits, seen = wanted.value, set()
        for batch in batches:
            at = (mix(np.asarray(batch.column(1)).view(np.uint64)) % np.uint64(len(bits) * 8)).astype(np.int64)
            keep = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            names, sets = [], []
            for _, s in shingle_sets(batch.column(0).take(pa.array(keep)), width) if len(keep) else ():
                if len(s) and (k := keys(s)) not in seen:
                    seen.add(k)
                    names.append(k)
                    sets.append(s.view(np.int64))
            for a in range(0, len(names), 256):
                yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 256], pa.int64()), flat_lists(sets[a : a + 256], pa.int64())], ["sk", "grams"])

    return run


def _bitmap(bits: int):
    """Each task's ids as positions in one bitmap of 2^bits bits."""

    def run(batches):
        out = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = (mix(np.asarray(batch.column(0)).view(np.uint64)) % np.uint64(1 << bits)).astype(np.int64)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for i in range(0, len(out), SLICE):
            if out[i : i + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(out[i : i + SLICE].tobytes(), 1)], pa.binary())], ["slice", "counts"])

    return run


def _or_slices(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c = np.frombuffer(zlib.decompress(x), np.uint8)
            total[i] = total[i] | c if i in total else c
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])


def overlap(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether two sorted sets share `need` elements."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) >= need


def _verify(batches):
    """Rows come sorted by group, the group's sets before the pairs of them."""
    group, sets, xs, ys = None, {}, [], []
    for batch in batches:
        groups, kinds, x, y = (np.asarray(batch.column(i)) for i in range(4))
        grams = batch.column(4)
        at, flat = np.asarray(grams.offsets), np.asarray(grams.values)
        for r in range(batch.num_rows):
            if group != groups[r]:
                group, sets = groups[r], {}
            if kinds[r] == 0:
                sets[x[r]] = np.sort(flat[at[r] : at[r + 1]])
            else:
                a, b = sets[x[r]], sets[y[r]]
                if overlap(a, b, least_overlap(len(a), len(b))):
                    xs.append(x[r])
                    ys.append(y[r])
        if len(xs) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["a", "b"])
            xs, ys = [], []
    yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["a", "b"])


def _linked_copies(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each set the copies of those sets that link with it: of sides 1 and 2 those on the other side, of side 0 all.

    The sets share most of their elements, so all intersections come from products of 0/1 matrices, some columns at a
    time; elements of one set alone don't count.
    """
    n = np.array([len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)[times[at] > 1]
    place = (np.cumsum(times > 1) - 1)[at[times[at] > 1]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
    shared = np.zeros((len(left), len(right)), np.float32)
    step = max(64, (1 << 22) // len(sets))
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        i, j = np.searchsorted(place, [a, a + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[i:j], place[i:j] - a] = 1
        shared += m[left] @ m[right].T
    linked = 9 * shared >= 4 * (n[left][:, None] + n[right])
    linked &= left[:, None] != right
    out = np.zeros(len(sets), np.int64)
    out[left] += linked @ copies[right]
    if side.any():
        out[right] += copies[left] @ linked
    return out


def _count_links(batches):
    """Rows come sorted by group: a component, or two blocks of one. Gives each set's linked copies in the group."""

    def counted(held):
        names, copies, side, sets = zip(*held, strict=True)
        n = _linked_copies(list(sets), np.array(copies), np.array(side))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n)], ["sk", "n"])

    group, held = None, []
    for batch in batches:
        groups, names, copies, side = (np.asarray(batch.column(i)) for i in range(4))
        grams = batch.column(4)
        at, flat = np.asarray(grams.offsets), np.asarray(grams.values)
        for r in range(batch.num_rows):
            if group != groups[r]:
                if held:
                    yield counted(held)
                group, held = groups[r], []
            held.append((names[r], copies[r], side[r], flat[at[r] : at[r + 1]]))
    if held:
        yield counted(held)


def _wanted_sets(docs: DataFrame, first: DataFrame, asked: DataFrame, width: int, rows: int, keys: Keys) -> DataFrame:
    """(sk, grams), written once, of the sets in asked(sk)."""
    bits = int(min(WANTED_BITS, max(12, np.ceil(np.log2(max(rows, 1))) + 4)))
    ids = first.join(asked.hint("merge"), "sk", "left_semi").select("handle").mapInArrow(_bitmap(bits), _schema(slice=_I, counts=T.BinaryType())).repartition("slice")
    wanted = np.zeros(1 << (bits - 3), np.uint8)
    for i, x in ids.mapInArrow(_or_slices, _schema(slice=_I, counts=T.BinaryType())).collect():  # 2^bits bits at most
        wanted[i : i + SLICE] |= np.frombuffer(x, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    return materialise(docs.select("text", "handle").mapInArrow(_sets(width, shared, keys), _schema(sk=_L, grams=T.ArrayType(_L))))


def _links(pairs: DataFrame, first: DataFrame, grams: DataFrame, parts: int) -> DataFrame:
    """Those distinct pairs(x, y) of set keys that link.

    First the suffix filter: sets whose parities differ in more places than linked sets differ in elements go, before
    any set moves. The others go by the least n-grams of their sets, which near copies mostly share, into groups of
    about CELL_PAIRS; a set is sent once to each group that has a pair of it.
    """
    known = first.select("sk", "least", "n", "odd0", "odd1")
    named = pairs.join(known.toDF("x", "lx", "nx", "x0", "x1").hint("merge"), "x").join(known.toDF("y", "ly", "ny", "y0", "y1").hint("merge"), "y")
    apart = F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))) + F.bit_count(F.col("x1").bitwiseXOR(F.col("y1")))
    near = apart <= F.expr("nx + ny - 2 * ((4 * (nx + ny) + 8) div 9)")
    named = materialise(named.where(near).select("x", "y", F.xxhash64(F.least("lx", "ly"), F.greatest("lx", "ly")).alias("cell")))
    sides = named.groupBy("cell").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / CELL_PAIRS)).cast("int").alias("sides"))
    salted = lambda c: F.pmod(F.xxhash64(c), F.col("sides"))
    grouped = materialise(named.join(sides.hint("merge"), "cell").select(F.xxhash64("cell", salted("x"), salted("y")).alias("group"), "x", "y"))
    members = grouped.select("group", F.explode(F.array("x", "y")).alias("sk")).distinct()
    sent = members.join(grams.hint("merge"), "sk").select("group", F.lit(0).alias("kind"), F.col("sk").alias("x"), F.col("sk").alias("y"), "grams")
    rows = sent.unionByName(grouped.select("group", F.lit(1).alias("kind"), "x", "y", F.array().cast("array<long>").alias("grams")))
    dealt = rows.repartition(parts, "group").sortWithinPartitions("group", "kind")
    return materialise(dealt.mapInArrow(_verify, _schema(a=_L, b=_L)))


def _linked(links: DataFrame, roots: DataFrame, first: DataFrame, grams: DataFrame, parts: int) -> DataFrame:
    """(sk, linked): the copies of other sets that link with each set.

    Links never leave a component. Of two sets the link is known; the sets of larger components are compared with each
    other in one group, or in one for each two blocks of COUNT_BLOCK sets, which gives counts, no pairs.
    """
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    member = materialise(roots.withColumnRenamed("node", "sk").join(sizes.hint("merge"), "root").join(first.select("sk", "copies").hint("merge"), "sk"))
    ends = links.select(F.col("a").alias("sk"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("sk"), F.col("a").alias("other")))
    pair = ends.join(member.where("members = 2").select(F.col("sk").alias("other"), "copies").hint("merge"), "other").select("sk", F.col("copies").alias("n"))
    large = member.where("members > 2").withColumn("blocks", F.ceil(F.col("members") / COUNT_BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("sk"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    large = large.select("sk", "copies", side.alias("side"), F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("group"))
    sent = large.join(grams.hint("merge"), "sk").select("group", "sk", "copies", "side", "grams")
    counted = sent.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_count_links, _schema(sk=_L, n=_L))
    return pair.unionByName(counted).groupBy("sk").agg(F.sum("n").alias("linked"))


def similar_components(docs: DataFrame, width: int = WIDTH, count: bool = True, key_bits: int = 64) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id and, unless count is false, n_links.

    Sets of `width`-word shingles link at a Jaccard similarity of 0.8 or more. Equal sets are one vertex. Every
    document emits its prefix of rarest shingles; the order comes from counts over all documents, in hash buckets.
    Pairs that meet in a prefix and pass the length, position and suffix filters are verified on the whole sets, each
    once. Groups of a frequent prefix shingle, which are dealt into salted blocks by size band, are first linked through
    one member each; then all pairs of sets that aren't connected yet are made, so no possible link between components
    is left out. n_links counts the other rows that a row is linked to, those with an equal set among them.

    Null, empty or blank texts: 0 shingles, no links, a component of their own. Fewer than `width` words: one shingle.
    Null ids: a component's smallest id is one that isn't null, if it has any. Repeated doc_ids stay rows of their own,
    linked by their texts. Extra columns are not read. An empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("handle"))
    rows = docs.select("doc_id").count()
    bits = int(min(RARITY_BITS, max(12, np.ceil(np.log2(max(rows, 1))) + 6)))
    digest = materialise(docs.select("doc_id", "text", "handle").mapInArrow(_digest(width, bits, Keys(bits=key_bits)), DIGEST))
    sets = digest.where("slice is null")
    # expected are rows^2 / 2^65 of them
    shared = sets.where("n > 0").groupBy("sk").agg(F.min("alt").alias("lo"), F.max("alt").alias("hi")).where("lo <> hi").select("sk")
    keys = Keys(frozenset(r[0] for r in shared.collect()), key_bits)
    name = F.when(F.col("sk").isin(*keys.clash), F.col("alt")).otherwise(F.col("sk")) if keys.clash else F.col("sk")
    sets = sets.withColumn("sk", name)
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranks = spark.sparkContext.broadcast(rarity(digest, bits))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // 5_000_000))
    each = [F.min(c).alias(c) for c in ("handle", "n", "least", "odd0", "odd1")]
    first = materialise(sets.where("n > 0").groupBy("sk").agg(*each, F.count(F.lit(1)).alias("copies")))

    postings = docs.select("text").mapInArrow(_postings(width, bits, ranks, keys), POSTING)
    found = materialise(postings.repartition(parts, "token").mapInArrow(_first_pairs, FOUND))
    pairs = found.where("kind = 0").select("x", "y").distinct()
    late = found.where("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("sk"), "n", "pos", "side")
    asked = found.select(F.explode(F.when(F.col("kind") == 0, F.array("x", "y")).otherwise(F.array("y"))).alias("sk")).distinct()
    grams = _wanted_sets(docs, first, asked, width, rows, keys)
    links = _links(pairs, first, grams, parts)
    roots = components(links)
    if not late.isEmpty():
        rooted = late.join(roots.withColumnRenamed("node", "sk").hint("merge"), "sk", "left").select("token", "sk", "n", "pos", "side", F.coalesce("root", "sk").alias("root"))
        mixed = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
        still = rooted.join(mixed.hint("merge"), "token", "left_semi").select("token", "sk", "n", "pos", "side", "root")
        more = still.repartition(parts, "token").mapInArrow(_open_pairs, FOUND).select("x", "y").distinct()
        more = materialise(more.join(pairs.hint("merge"), ["x", "y"], "left_anti"))
        if not more.isEmpty():
            links = links.unionByName(_links(more, first, grams, parts))
            roots = components(links)
    named = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sk")).alias("sk"))
    named = named.join(roots.withColumnRenamed("node", "sk").hint("merge"), "sk", "left").withColumn("root", F.coalesce("root", "sk"))
    smallest = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest.hint("merge"), "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    if not count:
        return named.select("doc_id", "n_shingles", "component_id")
    linked = first.select("sk", "copies").join(_linked(links, roots, first, grams, parts).hint("merge"), "sk", "left")
    counts = linked.select("sk", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    named = named.join(counts.hint("merge"), "sk", "left")
    return named.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row, that of the smallest doc_id (null ids last), of each group of near copies.

    Rows are told apart by more than their ids: a null id loses no row, and a repeated one keeps no copy. Columns of
    any name pass through; an empty table gives an empty result.
    """
    rows = row_ids(docs)
    groups = similar_components(rows.select(F.col(ROW).alias("doc_id"), "text"), count=False)
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias(ROW))
    return rows.join(keep.hint("merge"), ROW, "left_semi").select(*docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::varchar[] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, component_id, coalesce(k.n, 0) AS n_links FROM s JOIN c ON c.x = doc_id LEFT JOIN k ON k.x = doc_id
"""
