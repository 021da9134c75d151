"""Phrases that many texts share and whose words belong together: Toivonen mining of frequent phrases, and their scores.

A sample proposes phrases; one pass over all texts counts these and their negative border. A phrase of the border that
turns out to be frequent sends another pass over all that it may be a part of. These passes count by 64-bit keys, which
never gives a phrase too few; a last one counts the phrases whose keys are frequent by their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartolith.llm.common import chain, materialise, pieces, table, text_buffers, word_hashes, words_of

#: Words of the longest phrase, and the fewest occurrences of a frequent one.
LONGEST, FREQUENT = 5, 100
#: One document in SAMPLE is sampled; frequent in the sample is SLACK of what FREQUENT occurrences would leave there.
SAMPLE, SLACK = 8, 0.35
#: Bits of the table of known phrases: BITS_A_PHRASE for each, in powers of two between these. A fuller table lets more
#: phrases be counted than need be; all counts stay exact.
BITS_A_PHRASE, FEWEST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28
ROWS = "lang string, words int, phrase string, n long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True


@dataclass
class Words:
    """The words of some texts: lower-cased bytes with a space after each word, where each begins and ends in them, its
    hash, a number that equal words share, and how many words its piece has from it on."""

    flat: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    left: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = _LOWER[data]
    gap = _BREAK[low]
    full = ~(gap | _SPACE[low])
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    begins, stops = full.copy(), full.copy()
    begins[1:] &= ~full[:-1] | cut[1:-1]
    stops[:-1] &= ~full[1:] | cut[1:-1]
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = word_hashes(low, a, b)
    piece = np.cumsum(gap)[a] + np.searchsorted(offsets, a, "right")
    sizes = b - a
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    flat = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    flat[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(a)), sizes)] = low[full]
    ids = _word_ids(flat, starts, sizes, hashes)
    left = np.searchsorted(piece, piece, "right") - np.arange(len(a))
    return Words(flat, starts, ends, hashes, ids, left)


def _word_ids(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers that equal words share and others don't: hashes find them and bytes confirm it."""
    if not len(starts):
        return np.zeros(0, np.int64)
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[ids]
    if np.array_equal(sizes[like], sizes):
        at = np.arange(len(flat)) + np.repeat(starts[like] - starts, sizes + 1)
        if np.array_equal(flat[at], flat):
            return ids.astype(np.int64)
    seen: dict[bytes, int] = {}
    raw = flat.tobytes()
    return np.array([seen.setdefault(raw[s : s + n], len(seen)) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)], np.int64)


def slices(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings flat[start:end]."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat[at])]).cast(pa.string())


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a table for each key."""
    mask = np.uint64(bits - 1)
    return keys & mask, (keys >> np.uint64(32)) & mask


def known(table_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the table may hold each key; it never denies one that it holds."""
    out = np.ones(len(keys), bool)
    for at in _places(keys, len(table_) * 64):
        out &= (table_[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def phrase_keys(hashes: np.ndarray, at: np.ndarray, words: int, lang: str) -> np.ndarray:
    """Keys of the phrases of `words` words that begin with the words numbered `at`; the lowest bits tell how many."""
    tag = word_hashes(np.frombuffer(lang.encode() or b"\0", np.uint8), np.zeros(1, np.int64), np.array([max(1, len(lang.encode()))]))
    return chain([np.broadcast_to(tag, at.shape), *[hashes[at + k] for k in range(words)]]) & ~np.uint64(15) | np.uint64(words)


def phrases_of(w: Words, lang: str, now: np.ndarray | None, before: np.ndarray | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, keys, where each phrase begins first, counts), length by length, of the phrases that are candidates.

    Single words are. A longer phrase is one if both parts of it that are a word shorter are known: held by the table
    `now`, or not counted so far but a candidate of this pass. What has been counted, as both its parts were in the table
    `before`, isn't given again; of it only what `now` holds leads on to longer phrases.
    """
    ids, at = w.ids, np.arange(len(w.ids))  # ids[i]: number of the phrase at word at[i]
    fresh = np.full(len(at), before is None)  # not counted before
    for words in range(1, longest + 1):
        if not len(at):
            return
        number, first, ids = np.unique(ids, return_index=True, return_inverse=True)
        begin, new = at[first], fresh[first]
        keys = phrase_keys(w.hashes, begin, words, lang)
        show = np.flatnonzero(new)
        if len(show):
            yield words, keys[show], begin[show], np.bincount(ids, minlength=len(number))[show]
        if now is None or words == longest:
            return
        good = known(now, keys)
        # the table may hold a phrase by chance: only one that was counted led on to longer ones
        old = known(before, keys) & ~new if before is not None else np.zeros(len(number), bool)
        if before is not None:
            good |= new
        # the phrase at word i meets the one at word i + 1
        here = np.full(len(w.ids) + 1, -1, np.int64)
        here[at] = np.where(good[ids], ids, -1)
        at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0) & (w.left > words))
        fresh = ~(old[here[at]] & old[here[at + 1]])
        ids = here[at] * np.int64(len(number)) + here[at + 1]


def _runs(batches) -> Iterator[tuple[str, Words]]:
    """The words of each run of about 512 KB of texts of one language."""
    for batch in batches:
        langs = batch.column("lang")
        for lang in langs.unique().to_pylist():
            texts = batch.column("text").filter(pa.compute.equal(langs, lang))
            data, offsets = text_buffers(texts)
            for i, j in pieces(offsets, 1 << 19):
                yield lang, read_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def counted(docs: DataFrame, now=None, before=None, longest: int = LONGEST, shortest: int = 1) -> DataFrame:
    """(key, n): how often the candidates of at least `shortest` words come; see phrases_of.

    `now` and `before` are broadcast tables. Phrases that share a key are counted together, so n is never too small.
    """

    def run(batches):
        for lang, w in _runs(batches):
            for words, keys, _, n in phrases_of(w, lang, now and now.value, before and before.value, longest):
                if words >= shortest:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return docs.select("lang", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def counted_texts(docs: DataFrame, now, longest: int) -> DataFrame:
    """(lang, words, phrase, n) of the phrases that the table `now` holds, with all their parts; exact, by their texts. A
    row of 0 words has the number of all words of a language."""

    def run(batches):
        for lang, w in _runs(batches):
            found = [(0, pa.array([""]), np.array([len(w.ids)]))]
            for words, keys, begin, n in phrases_of(w, lang, now.value, None, longest):
                held = np.flatnonzero(known(now.value, keys))
                found.append((words, slices(w.flat, w.starts[begin[held]], w.ends[begin[held] + words - 1]), n[held]))
            for words, phrases, n in found:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), words, np.int32)), phrases, pa.array(n.astype(np.int64))], ["lang", "words", "phrase", "n"])

    return docs.select("lang", "text").mapInArrow(run, ROWS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def known_table(keys: DataFrame, bits: int) -> np.ndarray:
    """A table of rows(key): its words are put together by Spark, 8 bytes for each of at most MOST_BITS / 64 of them."""

    def run(batches):
        for batch in batches:
            for at in _places(batch.column("key").to_numpy().view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int32))], ["at", "bit"])

    marks = keys.select("key").mapInArrow(run, "at long, bit int")
    got = marks.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return out


def unknown(keys: DataFrame, now) -> DataFrame:
    """The rows(key) that the table doesn't have."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~known(now.value, batch.column("key").to_numpy().view(np.uint64))))

    return keys.select("key").mapInArrow(run, "key long")


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def sampled_keys(docs: DataFrame, frequent: int, longest: int, sample: int, slack: float) -> DataFrame:
    """(key) of the phrases that are frequent in a sample, level by level: those of k + 1 words are looked for where two of
    k words meet."""
    context = docs.sparkSession.sparkContext
    chosen = materialise(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0).select("lang", "text"))
    least = max(2, math.ceil(slack * frequent / sample))
    found, now = [], None
    for words in range(1, longest):
        found.append(materialise(counted(chosen, now, None, words, words).where(F.col("n") >= least).select("key")))
        if words + 1 == longest or found[-1].isEmpty():
            break
        every = _together(found)
        now = context.broadcast(known_table(every, table_bits(every.count())))
    return _together(found)


def table_bits(phrases: int) -> int:
    return min(MOST_BITS, max(FEWEST_BITS, 1 << math.ceil(math.log2(max(1, phrases) * BITS_A_PHRASE))))


def frequent_phrases(docs: DataFrame, frequent: int = FREQUENT, longest: int = LONGEST, sample: int = SAMPLE, slack: float = SLACK) -> tuple[DataFrame, int]:
    """(lang, words, phrase, n) of all phrases of 1 to longest words that docs(doc_id, lang, text) have `frequent` times
    or more in a language, with a row of 0 words for each language's number of words; and the number of passes before
    the one by texts.

    The sample's frequent phrases are marked in a table of bounded size. The first pass counts the single words, and each
    phrase whose two parts of one word less are in the table: the sample's phrases and their negative border, and a few
    more as the table may hold too much. If a phrase of the border turns out to be frequent, longer ones may have been
    missed: it is added to the table, and the next pass counts what its parts now allow, at every length at once. Such
    passes go on until no frequent phrase is outside what was counted with its extensions, which the second one ensures.
    Counts are exact whatever the sample.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    proposed = sampled_keys(docs, frequent, longest, sample, slack)
    bits = table_bits(proposed.count())
    marks = known_table(proposed, bits)
    now = context.broadcast(marks)
    tables = [materialise(counted(docs, now, None, longest).where(F.col("n") >= frequent))]
    # phrases of most words are part of none
    failed = materialise(unknown(tables[0].where((F.col("key").bitwiseAND(F.lit(15))) < longest), now))
    if not failed.isEmpty():
        wider = context.broadcast(marks | known_table(failed, bits))
        tables.append(materialise(counted(docs, wider, now, longest).where(F.col("n") >= frequent)))
    found = _together(tables)
    final = context.broadcast(known_table(found, table_bits(found.count())))
    exact = counted_texts(docs, final, longest).where((F.col("n") >= frequent) | (F.col("words") == 0))
    return materialise(exact), len(tables)


def scored(counts: DataFrame, cover: int = 100) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of the phrases of two or more words in frequent_phrases' rows.

    A phrase cut in two has l and r occurrences of its parts and the score floor(1000 a n / (l r)); the cut with the
    lowest score counts, the earliest of equal ones. Phrases inside a longer one that has at least cover % of their
    occurrences are left out: it is enough to look at those one word longer, as counts only fall with length.
    """
    total = counts.where("words = 0").select("lang", F.col("n").alias("total"))
    single = counts.where("words > 0").select("lang", "phrase", "n")
    cand = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    longer = cand.where("words > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    cand = cand.join(longer.hint("merge"), ["lang", "phrase"], "left").where(f"most is null or 100 * cast(most as decimal(20,0)) < {cover} * cast(a as decimal(20,0))").drop("most")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.size("w"))})
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")).hint("merge"), ["lang", "first"])
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")).hint("merge"), ["lang", "rest"])
    cuts = cuts.join(total.hint("merge"), "lang").withColumnRenamed("total", "n")
    wide = lambda c: f"cast({c} as decimal(18,0))"
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000 * a as decimal(18,0)) * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.words", "b.a", "b.l", "b.r", "b.n", "b.score")


def top_phrases(docs: DataFrame, top: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language of docs(doc_id, lang, text), by score and
    count descending, then by their bytes.

    A null lang counts as `und`, null and empty texts have no words; repeated rows and copies count each time; a word may
    have any length; extra columns aren't read; an empty table gives none.
    """
    counts, _ = frequent_phrases(docs, **options)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(counts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_phrases(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0b\f\r]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::bigint AS n FROM w GROUP BY 1),
k AS (SELECT unnest(range(1, 6)) AS k),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, k WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c l WHERE l.lang = c.lang AND l.k > c.k AND 100 * l.a >= 100 * c.a AND contains(' ' || l.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT kept.*, unnest(range(1, k)) AS j FROM kept),
s AS (SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n.n, j, ((1000::hugeint * a * n.n) // (x.f::hugeint * y.f))::bigint AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[j + 1:], ' ') JOIN n ON n.lang = cuts.lang),
b AS (SELECT lang, phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""
