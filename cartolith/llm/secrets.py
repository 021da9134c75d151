"""Secret scans: candidate strings, and random forests that remove false positives."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import held_out, materialise, pieces, table, text_buffers

#: At most so many findings of each label are learned from: those with the smallest hashes.
LEARN_FINDINGS = 4000
DICTIONARY_WORDS = 5000
#: Bytes before and after a candidate that count as its neighbourhood.
BEFORE, AFTER = 64, 24

_WORDS = rb"pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
_ASSIGNED = re.compile(rb"(?i)(?:" + _WORDS + rb")\w*[\"']?[ \t]*(?::=|=>|[:=])[ \t]*(?:\"([^\"\n]{4,})\"|'([^'\n]{4,})'|([^\s\"']{4,}))")
_RUN = re.compile(rb"(?<![A-Za-z0-9+/_\-])(?:(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{8,}|[A-Za-z+/_\-]{24,})={0,2}(?![A-Za-z0-9+/_\-])")
_BLOCK = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.DOTALL)
_KEY = re.compile(rb"(?i)(?:" + _WORDS + rb")\w*[\"']?[ \t]*(?::=|=>|[:=])?[ \t]*[\"']?$")
_ASSIGN = re.compile(rb"(?::=|=>|[:=])[ \t]*[\"']?$")
#: Formats of issued keys.
_ISSUED = re.compile(rb"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}")
_HEX = re.compile(rb"(?=[^0-9]*[0-9])(?=[^a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}")
_PATH = re.compile(rb"[\w.\-]*[/.@]$")
_LETTERS = re.compile(rb"[a-z]{3,}")
_CLASSES = bytes(0 if 48 <= c < 58 else 1 if 65 <= c < 91 else 2 if 97 <= c < 123 else 3 for c in range(256))
_VOWELS = bytes(c in b"aeiouAEIOU" for c in range(256))

#: What a value says of itself and its place, and what stands beside it. Each forest gets its labels from the other view.
VALUE = ("length", "digits", "upper", "lower", "signs", "changes", "vowel_changes", "entropy", "distinct", "hex", "covered", "path", "after_known")
BESIDE = ("key_near", "assigned", "quoted", "path", "before_known", "after_known")


def changes(x: bytes) -> float:
    return sum(a != b for a, b in zip(x, x[1:], strict=False)) / len(x)


def coverage(low: bytes, known: set[bytes]) -> float:
    """The share of the bytes that words of the dictionary cover, taken greedily in each run of letters."""
    covered = 0
    for m in _LETTERS.finditer(low):
        run, i = m.group(), 0
        while i + 3 <= len(run):
            k = next((k for k in range(min(12, len(run) - i), 2, -1) if run[i : i + k] in known), 0)
            covered += k
            i += k or 1
    return covered / len(low)


def entropy_of(value: bytes) -> float:
    counts = np.bincount(np.frombuffer(value, np.uint8))
    p = counts[counts > 0] / len(value)
    return float(-(p * np.log2(p)).sum())


def describe(value: bytes, before: bytes, after: bytes, known: set[bytes]) -> tuple[list[float], list[float]]:
    """The numbers of VALUE and BESIDE: length, character transitions, dictionary coverage, path and neighbouring words."""
    n, low = len(value), value.lower()
    kinds = value.translate(_CLASSES)
    path = float(bool(_PATH.search(before)) or after[:1] in (b"@", b"/") or (after[:1] == b"." and after[1:2].isalnum()))
    last = re.findall(rb"[a-z]+", _ASSIGN.sub(b"", before.rstrip(b"\"' ")).lower())[-1:]
    following = re.findall(rb"[a-z]+", after.lower())[:1]
    after_known = float(bool(following) and following[0] in known)
    own = [
        math.log2(n), *[kinds.count(k) / n for k in range(4)], changes(kinds), changes(value.translate(_VOWELS)), entropy_of(value), len(set(value)) / n,
        float(all(c in b"0123456789abcdef" for c in low)), coverage(low, known), path, after_known,
    ]
    beside = [float(bool(_KEY.search(before))), float(bool(_ASSIGN.search(before))), float(before[-1:] in (b'"', b"'")), path, float(bool(last) and last[0] in known), after_known]
    return own, beside


def label_beside(before: bytes) -> int | None:
    """A label by what stands beside a value, for the forest that sees the value: 1 where it is assigned to a name that
    speaks of secrets, 0 where no such name is near, None between."""
    if _KEY.search(before) and _ASSIGN.search(before):
        return 1
    return None if re.search(rb"(?i)" + _WORDS, before) else 0


def label_value(value: bytes, known: set[bytes]) -> int | None:
    """A label by the value, for the forest that sees what stands beside it: 1 for issued formats, long hexadecimal and
    other random values, 0 for numbers, addresses and words, None between."""
    if _ISSUED.fullmatch(value) or _HEX.fullmatch(value) or value.startswith(b"-----BEGIN"):
        return 1
    kinds = set(value.translate(_CLASSES))
    if len(value) >= 20 and {0, 1, 2} <= kinds and entropy_of(value) >= 4:
        return 1
    return 0 if 1 not in kinds and 2 not in kinds or coverage(value.lower(), known) >= 0.8 else None


def candidates_of(text: bytes) -> list[tuple[int, int]]:
    """(start, end) of what may be a secret: private key blocks, values assigned to a name that speaks of secrets, and runs
    of 8 or more letters, digits and + / _ - with a digit, or of 24 or more without. Of overlapping ones the first rule's."""
    taken = [m.span() for m in _BLOCK.finditer(text)]
    taken += [m.span(m.lastindex) for m in _ASSIGNED.finditer(text)]
    taken += [m.span() for m in _RUN.finditer(text)]
    out, end = [], -1
    for a, b in sorted(dict.fromkeys(taken), key=lambda s: (s[0], -s[1])):
        if a >= end:
            out.append((a, b))
            end = b
    return out


def _scan(known, label: bool):
    names = ["doc_id", "learn", "start", "length", "by_beside", "by_value", "own", "beside"]

    def lists(x: list, width: int):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dtype=np.int32) * width), pa.array(np.array(x, float).reshape(-1)))

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            learn = b.column(2).to_pylist()
            rows: list[tuple] = []
            own, beside = [], []
            for i, j in pieces(offsets):
                for r in range(i, j):
                    text = data[offsets[r] : offsets[r + 1]].tobytes()
                    for begin, end in candidates_of(text):
                        value, before = text[begin:end], text[max(0, begin - BEFORE) : begin]
                        x, y = describe(value, before, text[end : end + AFTER], known.value)
                        own.append(x)
                        beside.append(y)
                        rows.append((r, begin, end - begin, *((label_beside(before), label_value(value, known.value)) if label and learn[r] else (None, None))))
            r, start, size, one, two = zip(*rows, strict=True) if rows else [()] * 5
            at = pa.array(r, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(at), b.column(2).take(at), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(one, pa.int32()), pa.array(two, pa.int32()), lists(own, len(VALUE)), lists(beside, len(BESIDE))], names)

    return run


def candidates(docs: DataFrame, known: set[bytes], label: bool = False) -> DataFrame:
    """doc_id, learn (whether its document isn't held out), start, length, the weak labels of those by both views if asked
    for, and the numbers of both."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # DICTIONARY_WORDS words at most
    rows = docs.select("doc_id", F.col("text").cast("string"), (~held_out(F.col("doc_id"))).alias("learn"))
    return rows.mapInArrow(_scan(shared, label), "doc_id long, learn boolean, start long, length long, by_beside int, by_value int, own array<double>, beside array<double>")


def dictionary(docs: DataFrame) -> set[bytes]:
    """The words of three to twelve letters that most documents have, of all documents that aren't held out."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))
    counted = docs.where(~held_out(F.col("doc_id"))).select(F.explode(words).alias("w")).where("length(w) between 3 and 12").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r[0].encode() for r in counted.orderBy(F.desc("n"), "w").limit(DICTIONARY_WORDS).collect()}


def _forest(learn: DataFrame, label: str, x, trees: int, depth: int):
    """A function that adds a probability, learned from at most LEARN_FINDINGS different rows of each label, each with
    the weight of its number."""
    rows = learn.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label"), x.alias("x")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    chosen = [r for k in (0, 1) for r in rows.where(F.col("label") == k).orderBy(F.xxhash64("x"), "x").limit(LEARN_FINDINGS).collect()]
    labels = {r["label"] for r in chosen}
    if len(labels) < 2:
        return lambda found, name: found.withColumn(name, F.lit(float(sum(labels))))
    frame = learn.sparkSession.createDataFrame([(float(r["label"]), list(r["x"]), r["weight"]) for r in chosen], "label double, x array<double>, weight double")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, featuresCol="features", labelCol="label", weightCol="weight")
    model = forest.fit(frame.select("label", "weight", array_to_vector("x").alias("features")))

    def score(found: DataFrame, name: str) -> DataFrame:
        out = model.transform(found.withColumn("features", array_to_vector(x)))
        return out.withColumn(name, F.element_at(vector_to_array("probability"), 2)).select(*found.columns, name)

    return score


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, trees: int = 20, depth: int = 6) -> DataFrame:
    """One row per candidate string in docs(doc_id, text): doc_id, start, length (bytes), score, is_secret.

    `findings`(doc_id, start, label) are labelled candidates: one forest learns from all features of theirs. Without
    them two forests stand in, of which one sees the value and learns from labels by what stands beside it, the other
    sees what stands beside it and learns from labels by the value; neither sees what made its labels. A candidate is
    a secret unless both say no: 1 - (1 - p)(1 - q). is_secret is true from 0.5 on. Held-out documents are never
    learned from. start is a byte offset in the UTF-8 text, and no length of candidates is left out.

    Null and empty texts have no candidates; null and repeated doc_ids and repeated rows are scanned as often as they
    come; columns of other names, such as start or label, are not read; an empty table gives an empty result. Without
    labels of both kinds a forest's score is the labels' mean, or 0.
    """
    docs = docs.select("doc_id", "text")
    known = dictionary(docs)
    # written once: both forests learn from it, and score it
    every = materialise(candidates(docs, known, findings is None))
    learn, found = every.where("learn"), every.select("doc_id", "start", "length", "own", "beside")
    if findings is not None:
        learn = learn.join(findings.select("doc_id", "start", "label").hint("merge"), ["doc_id", "start"])
        scored = _forest(learn, "label", F.concat("own", "beside"), trees, depth)(found, "score")
    else:
        scored = _forest(learn, "by_beside", F.col("own"), trees, depth)(found, "p")
        scored = _forest(learn, "by_value", F.col("beside"), trees, depth)(scored, "q")
        scored = scored.withColumn("score", 1 - (1 - F.col("p")) * (1 - F.col("q")))
    return scored.select("doc_id", "start", "length", "score", (F.col("score") >= 0.5).alias("is_secret"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
