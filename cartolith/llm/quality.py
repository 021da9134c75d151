"""Document quality from preference pairs: a Bradley-Terry model with a threshold at a score quantile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import held_out, pieces, table, text_buffers, word_hashes, words_of

#: At most so many labelled documents of each label are learned from: those with the smallest hashes.
LEARN_ROWS = 4000

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b"#*$%&@^~=+", b"|<>{}[]\\/_", b".,;:'\"()-", b"\n"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 9
FEATURES = 24


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers for each whole text."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(offsets) - 1, FEATURES))
    for i, j in pieces(offsets):
        d = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        starts, stops, rows, low = words_of(d, at)
        h = word_hashes(low, starts, stops)
        kinds = _CLASS[d]
        doc = np.repeat(np.arange(j - i), np.diff(at))
        n = np.bincount(doc * 10 + kinds, minlength=(j - i) * 10).reshape(-1, 10).astype(float)
        size, words = np.maximum(n.sum(1), 1), np.bincount(rows, minlength=j - i).astype(float)
        per = np.maximum(words, 1)
        again = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        repeats = np.bincount(rows[1:][again], minlength=j - i) / per
        order = np.lexsort((h, rows))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        distinct = np.bincount(rows[order][new], minlength=j - i) / per
        last = d[stops - 1] if len(stops) else d[:0]
        marked = np.bincount(rows[(_CLASS[last] >= 4) & (_CLASS[last] <= 6)], minlength=j - i) / per
        bare = np.bincount(rows[(stops - starts == 1) & (_CLASS[last] >= 3) & (_CLASS[last] < 9)], minlength=j - i) / per
        letters = np.maximum(n[:, 1] + n[:, 2], 1)
        shares = np.stack([n[:, 1] / letters, n[:, 3] / size, n[:, 4] / size, n[:, 5] / size, n[:, 6] / size, n[:, 7] / size, n[:, 8] / per, repeats, marked, bare], 1)
        more = np.stack([np.log1p(size) / 10, np.minimum(np.bincount(rows, stops - starts, j - i) / per, 40) / 10, distinct, distinct * np.log1p(words)], 1)
        out[i:j] = np.concatenate([shares, np.log(shares + 0.002), more], 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, steps: int = 400, seed: int = 3) -> dict:
    """Weights w by logistic loss on the feature differences of (better, worse) pairs; threshold at the score quantile
    with the best balanced accuracy; slope so that the score is calibrated there. Without both labels all is 0.5."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"mean": np.zeros(x.shape[1]), "scale": np.ones(x.shape[1]), "w": np.zeros(x.shape[1]), "cut": 0.0, "slope": 1.0}
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        g = -(d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(0) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    s = z @ w
    cuts = np.quantile(s, np.linspace(0.005, 0.995, 199))
    gain = [(s[good] >= c).mean() + (s[bad] < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(gain) >= max(gain) - 1e-9)
    cut = float(cuts[best[0]] + cuts[best[-1]]) / 2
    u, slope = s - cut, 1.0
    weight = np.where(y == 1, 0.5 / len(good), 0.5 / len(bad))
    for _ in range(200):  # a one-parameter logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * u, -30, 30)))
        slope = float(np.clip(slope + (weight * (y - p) * u).sum() / ((weight * p * (1 - p) * u * u).sum() + 1e-3), 0.05, 5.0))
    return {"mean": mean, "scale": scale, "w": w, "cut": cut, "slope": slope}


def learn(docs: DataFrame, labels: DataFrame, most: int = LEARN_ROWS) -> dict:
    """A model from at most `most` labelled documents of each label that aren't held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("quality = 0").orderBy(*order).limit(most).unionByName(known.where("quality = 1").orderBy(*order).limit(most))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def run(batches):
        for b in batches:
            x = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["y", "x"])

    got = rows.mapInArrow(run, "y int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, FEATURES)
    order = np.lexsort(x.T)  # the order of arrival doesn't matter
    return fit(x[order], np.asarray(got.column("y"), float)[order])


def scorer(model: dict):
    """A column function: text to score."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        s = ((features(text) - model["mean"]) / model["scale"]) @ model["w"] - model["cut"]
        return pa.array(1 / (1 + np.exp(-np.clip(model["slope"] * s, -30, 30))))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Every whole text is scored; null counts as empty. Labels other than 0 and 1 are ignored; a doc_id with both counts
    as 1. Without labels of both kinds each score is 0.5. Repeated rows stay; extra columns are not read; an empty
    table gives an empty result.
    """
    score = scorer(learn(docs, labels))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects."""
    score: Column = scorer(learn(docs, labels))(F.col("text"))
    return docs.where(score >= 0.5).select(*docs.columns)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
