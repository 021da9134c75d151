"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartolith.llm.common import held_out, materialise, pieces, table, text_buffers

#: Grams of each order that the models of all languages hold together, at most: each language's most frequent ones.
MODEL_GRAMS = 1 << 21
CALIBRATION_ROWS = 4000
_SPACE = 32
_codes: dict[str, np.ndarray] = {}


def _fold() -> np.ndarray:
    """For each code point its 16-bit code: letters keep (or hash) their own, all else is a space."""
    if "fold" not in _codes:
        table = np.full(0x110000, _SPACE, np.uint64)
        letters = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.int64)
        table[letters] = (letters ^ ((letters >> 16) * 0x9E37)) & 0xFFFF
        _codes["fold"] = table
    return _codes["fold"]


def grams(text: str) -> np.ndarray:
    """The 4-grams of a text as 64-bit numbers, 16 bits a character; runs of other characters count as one space."""
    codes = _fold()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    codes = codes[(codes != _SPACE) | np.concatenate(([True], codes[:-1] != _SPACE))] if len(codes) else codes
    if not len(codes) or (len(codes) == 1 and codes[0] == _SPACE):
        return np.zeros(0, np.uint64)
    c = np.concatenate((np.full(3, _SPACE, np.uint64), codes, np.full(1, _SPACE, np.uint64)))
    return (c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:]


def _texts(column: pa.Array):
    data, offsets = text_buffers(column)
    for i, j in pieces(offsets):
        for r in range(i, j):
            yield r, data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")


def _count(batches):
    """(lang, gram, n) of a task, merged now and then so that only distinct grams are held."""
    held: dict[str, list] = {}

    def merged(parts):
        keys, n = (np.concatenate(z) for z in zip(*parts, strict=True))
        keys, back = np.unique(keys, return_inverse=True)
        return keys, np.bincount(back, n).astype(np.int64)

    for b in batches:
        langs = b.column(0).to_pylist()
        for r, text in _texts(b.column(1)):
            if len(g := grams(text)):
                parts = held.setdefault(langs[r], [])
                parts.append((g, np.ones(len(g))))
                if sum(len(k) for k, _ in parts[1:]) > 1 << 20:
                    held[langs[r]] = [merged(parts)]
    for lang, parts in held.items():
        keys, n = merged(parts)
        for i in range(0, len(keys), 1 << 15):
            k = keys[i : i + (1 << 15)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n[i : i + (1 << 15)])], ["lang", "gram", "n"])


class Sorted:
    """A value for some pairs of a 64-bit key and a language: sorted keys, and the languages and values of each."""

    def __init__(self, lang: np.ndarray, key: np.ndarray, value: np.ndarray):
        order = np.lexsort((lang, key))
        self.lang, self.value = lang[order].astype(np.int16), value[order].astype(np.float32)
        self.keys, begins = np.unique(key[order], return_index=True)
        self.ends = np.append(begins, len(key))

    def fill(self, out: np.ndarray, at: np.ndarray) -> np.ndarray:
        """out[row, language] = the value of at[row], where there is one."""
        if len(self.keys) and len(at):
            i = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
            row = np.flatnonzero(self.keys[i] == at)
            i = i[row]
            n = self.ends[i + 1] - self.ends[i]
            where = np.arange(int(n.sum())) + np.repeat(self.ends[i] - (np.cumsum(n) - n), n)
            out[np.repeat(row, n), self.lang[where]] = self.value[where]
        return out


class KneserNey:
    """One model per language, with interpolated probabilities of 1- to 4-grams and back-off weights of their contexts.

    `orders` has for each order, from 1 on, languages (numbers), keys, counts less the discount, and the sum of the
    counts behind each key's context, whether its grams are all in the model or not: what the discount and the missing
    grams leave of a context's probability goes to the shorter gram, so probabilities sum to one after pruning too.
    """

    def __init__(self, langs: list[str], floor: np.ndarray, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.langs, self.floor = langs, floor
        self.grams: list[Sorted] = []
        self.back: list[Sorted] = []
        for k, (lang, key, less, sums) in enumerate(orders):
            context = key >> np.uint64(16)
            order = np.lexsort((lang, context))
            first = np.ones(len(order), bool)
            first[1:] = (context[order][1:] != context[order][:-1]) | (lang[order][1:] != lang[order][:-1])
            begins = np.flatnonzero(first)
            kept = np.add.reduceat(less[order] / sums[order], begins) if len(begins) else np.zeros(0)
            back = Sorted(lang[order][begins], context[order][begins], 1 - np.minimum(kept, 1))
            p = np.zeros(len(key))
            for a in range(0, len(key), 1 << 14):
                s = slice(a, a + (1 << 14))
                rows = np.arange(len(key[s]))
                weight = back.fill(np.ones((len(rows), len(langs))), context[s])[rows, lang[s]]
                p[s] = less[s] / sums[s] + weight * self._p(key[s] & np.uint64((1 << (16 * k)) - 1), k - 1)[rows, lang[s]]
            self.back.append(back)
            self.grams.append(Sorted(lang, key, p))

    def _p(self, at: np.ndarray, k: int) -> np.ndarray:
        """Probabilities of (k + 1)-grams in each language; those not in the model back off."""
        if k < 0:
            return np.tile(self.floor, (len(at), 1))
        shorter, back = np.unique(at & np.uint64((1 << (16 * k)) - 1), return_inverse=True)
        out = self._p(shorter, k - 1)[back] * self.back[k].fill(np.ones((len(at), len(self.langs))), at >> np.uint64(16))
        return self.grams[k].fill(out, at)

    def entropies(self, g: np.ndarray) -> np.ndarray:
        """Cross-entropy for each language in nats a character."""
        keys, n = np.unique(g, return_counts=True)
        return -(n @ np.log(np.maximum(self._p(keys, 3), 1e-300))) / n.sum()


def discount(once: int, twice: int) -> float:
    return min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)


def train(docs: DataFrame, most: int = MODEL_GRAMS) -> KneserNey:
    """Models from the counts over all of docs(lang, text).

    Counts of 4-grams, of the distinct grams behind each shorter one, discounts and contexts' sums are all of the whole
    table; only then each language's rarest grams of an order go, where all languages together have more than `most`.
    """
    counts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    level = materialise(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    every = level.withColumn("k", F.lit(4))
    for k in (3, 2, 1):  # lower orders count the distinct grams that end so
        level = materialise(level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        every = every.unionByName(level.withColumn("k", F.lit(k)))
    size = F.when(F.col("n") <= 64, F.col("n")).otherwise(64 + F.floor(16 * F.log2(F.col("n") / 64)) + 1).cast("int")
    sizes = every.groupBy("lang", "k", size.alias("size")).agg(F.count(F.lit(1)).alias("c")).collect()  # a thousand for a language at most
    langs = sorted({r["lang"] for r in sizes})
    if not langs:
        return KneserNey([], np.zeros(0), [])
    known = {(r["lang"], r["k"], r["size"]): r["c"] for r in sizes}
    cut, less = {}, {}
    for lang in langs:
        for k in (1, 2, 3, 4):
            less[lang, k] = discount(known.get((lang, k, 1), 0), known.get((lang, k, 2), 0))
            mine = sorted(((z, c) for (w, o, z), c in known.items() if (w, o) == (lang, k)), reverse=True)
            room, cut[lang, k] = most // len(langs), (0, 1.0)
            for z, c in mine:
                if c > room:  # of equally frequent grams those with the smallest hashes stay, by a share that fits
                    cut[lang, k] = (z, max(room - 3 * room**0.5, 0) / c)
                    break
                room -= c
    rules = docs.sparkSession.createDataFrame([(w, k, langs.index(w), *cut[w, k], less[w, k]) for w, k in cut], "lang string, k int, number int, least int, part double, less double")
    sums = F.sum("n").over(W.partitionBy("lang", "k", F.shiftrightunsigned("gram", 16)))
    rows = every.withColumn("sums", sums).withColumn("size", size).join(F.broadcast(rules), ["lang", "k"]).where("size > least or (size = least and pmod(xxhash64(gram), 1000000) < part * 1000000)")
    got = rows.select("k", "number", "gram", (F.col("n") - F.col("less")).alias("less"), F.col("sums").cast("double").alias("sums")).toArrow()  # at most 4 * `most` rows
    at, number, key, kept, total = (np.asarray(got.column(c)) for c in ("k", "number", "gram", "less", "sums"))
    orders = [(number[o], key[o].view(np.uint64), np.maximum(kept[o], 0), total[o]) for k in (1, 2, 3, 4) for o in [np.flatnonzero(at == k)]]
    letters = [sum(c for (w, o, _), c in known.items() if (w, o) == (lang, 1)) for lang in langs]
    return KneserNey(langs, 1.0 / (np.array(letters) + 2), orders)


def _predict(model: KneserNey, column: pa.Array):
    """(language or None, entropy, margin to the second) of each row."""
    out: list = [None] * len(column)
    nulls = np.asarray(column.is_null())
    for r, text in _texts(column):
        if not nulls[r] and model.langs and len(g := grams(text)):
            e = model.entropies(g)
            best = int(e.argmin())
            rest = np.delete(e, best)
            out[r] = (model.langs[best], e[best], float(rest.min() - e[best]) if len(rest) else 1.0)
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a weak prior."""
    a, b = 5.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, [((y - p) * x).sum() - 0.1 * (a - 5), ((y - p)).sum() - 0.1 * b])
        a, b = float(np.clip(a + step[0], 0.1, 500)), float(np.clip(b + step[1], -20, 20))
    return a, b


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, held_out, lang_pred, score, entropy, rejected.

    Learns from the documents that aren't held out: most give the counts, a twentieth calibrates score (the probability
    that the prediction is right, from the entropy margin) and rejection (an entropy that hardly any of them has).
    Predictions depend on the text alone. A null text or one without letters: `und`, score 0, rejected; so is all
    without any labelled text. Repeated rows stay; extra columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    learn = docs.where(~held_out(F.col("doc_id")))
    aside = F.coalesce(F.xxhash64("doc_id") % 20 == 0, F.lit(False))
    model = train(learn.where(~aside))
    shared = spark.sparkContext.broadcast(model)

    def check(batches):
        for b in batches:
            rows = [(p[1], p[2], float(p[0] == lang)) for p, lang in zip(_predict(shared.value, b.column(1)), b.column(0).to_pylist(), strict=True) if p]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(3)], ["e", "m", "y"])

    known = learn.where(aside & F.col("lang").isNotNull()).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").select("lang", "text").limit(CALIBRATION_ROWS)
    got = known.mapInArrow(check, "e double, m double, y double").toArrow().to_pandas()
    a, b = _logistic(got["m"].to_numpy(), got["y"].to_numpy()) if len(got) else (20.0, 0.0)
    limit = float(got["e"].quantile(0.999)) * 1.05 if len(got) else float("inf")

    @F.arrow_udf("struct<lang_pred string, score double, entropy double>")
    def predict(text: pa.Array) -> pa.Array:
        rows = _predict(shared.value, text)
        score = [1 / (1 + np.exp(-np.clip(a * p[2] + b, -30, 30))) if p else 0.0 for p in rows]
        return pa.StructArray.from_arrays([pa.array([p[0] if p else "und" for p in rows]), pa.array(score, pa.float64()), pa.array([p[1] if p else None for p in rows], pa.float64())], ["lang_pred", "score", "entropy"])

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text").cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.entropy", F.coalesce(F.col("p.entropy") > limit, F.lit(True)).alias("rejected"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
