import hashlib
import random

import pytest
from cartolith.llm import fingerprints as fp
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, block int"


def digests(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {hashlib.md5(b" ".join(w[i : i + 5])).hexdigest()[:16] for i in range(max(1, len(w) - 4))}


def sketch(text):
    every = sorted(digests(text))
    below = [h for h in every if h < "1" + "0" * 15]
    return below if len(below) >= 16 else every[:16]


def near(a, b):
    if a == b:
        return 1.0
    top = lambda s: "~" if len(s) < 16 else max("1" + "0" * 15, s[-1])
    to = min(top(a), top(b))
    a, b = {h for h in a if h <= to}, {h for h in b if h <= to}
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def brute(rows):
    out = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        a, b = sketch(text), sketch(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), near(a, b), near(a, sketch(following))))
    return sorted(out, key=repr)


def text_of(rng, most):
    return " ".join(rng.choice(["ein", "Wort", "Äpfel", "漢字", "the", "of", "x" * 40]) + str(rng.randrange(50)) for _ in range(rng.randrange(0, most)))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", 7) for i, t in rows], DOCS)


@pytest.mark.parametrize("block", [1, 40])
def test_against_brute_force(spark, monkeypatch, block):
    """Whatever the blocks: each text meets the next one by descending id."""
    monkeypatch.setattr(fp, "FEWEST_ROWS", block)
    rng = random.Random(block)
    rows = [(i * 3 - 50, text_of(rng, rng.choice([3, 9, 60, 900]))) for i in range(90)]
    rows[5] = (rows[5][0], None)
    rows[6] = (rows[6][0], " \t")
    rows[7] = (rows[7][0], "word " * 30_000)
    mixed = rows[:]
    rng.shuffle(mixed)
    got = sorted((tuple(r) for r in fp.compare_with_next(frame(spark, mixed).repartition(4)).collect()), key=repr)
    assert got == brute(sorted(rows, key=lambda r: -r[0]))


def test_null_and_repeated_ids(spark, monkeypatch):
    """Every row once; rows with one id in order of their texts' hashes, null ids last."""
    monkeypatch.setattr(fp, "FEWEST_ROWS", 3)
    rows = [(None, f"text {i % 4} of {i}") for i in range(20)] + [(5, "same"), (5, "same"), (5, "other"), (9, "last"), (5, None)]
    docs = frame(spark, rows)
    order = [(r.doc_id, r.text) for r in docs.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in fp.compare_with_next(docs).collect()), key=repr)
    assert got == brute(order)


def test_few_rows(spark):
    assert fp.compare_with_next(frame(spark, [])).count() == 0
    one = fp.compare_with_next(frame(spark, [(1, "one text that is its own next, of some ten words")])).first()
    assert one.near_next == 1.0 and one.n_chars == 48


def test_containment_and_merging(spark):
    """A part of a text is contained in it, the reverse isn't; merging equals the fingerprint of both; columns equal the
    plain form."""
    rng = random.Random(4)
    long = [f"{rng.randrange(10**6)} {rng.randrange(10**6)}" for _ in range(3000)]
    part, other = " ".join(long[500:1100]), " ".join(str(rng.randrange(10**6)) for _ in range(800))
    rows = spark.createDataFrame([(1, " ".join(long), part), (2, " ".join(long), other), (3, part, "short text"), (4, "", ""), (5, "", part), (6, "a b", "a b")], "i int, a string, b string")
    got = rows.select("*", fp.fingerprint(F.col("a")).alias("x"), fp.fingerprint(F.col("b")).alias("y")).select("*", fp.containments(F.col("x"), F.col("y")).alias("c"), fp.merged(F.col("x"), F.col("y")).alias("m"))
    by = {r.i: r for r in got.collect()}
    assert abs(by[1].c.in_b - len(digests(part)) / len(digests(by[1].a))) < 0.08 and by[1].c.in_a == 1.0
    assert by[2].c.likeness == 0.0 and by[4].c.likeness == 1.0 and by[5].c.likeness == 0.0 and by[6].c.likeness == 1.0
    for r in by.values():
        assert r.c.likeness == near(sketch(r.a), sketch(r.b))
        both = sorted(digests(r.a) | digests(r.b))
        below = [h for h in both if h < fp.BOUND]
        assert r.m == "".join(below if len(below) >= 16 else both[:16])


def test_pools(spark):
    """The fingerprint of a group is that of all its shingles; rows are held against it hash by hash."""
    rng = random.Random(9)
    texts = [" ".join(str(rng.randrange(3000)) for _ in range(400)) for _ in range(12)]
    rows = spark.createDataFrame([(i, t, "big" if i < 8 else "small") for i, t in enumerate(texts)] + [(99, "few words", "tiny")], "doc_id long, text string, source string").withColumn("fingerprint", fp.fingerprint(F.col("text")))
    pools = {(r.source, r.hash) for r in fp.pooled(rows, "source").collect()}
    for source, mine in (("big", texts[:8]), ("small", texts[8:]), ("tiny", ["few words"])):
        every = sorted(set().union(*map(digests, mine)))
        below = [h for h in every if h < fp.BOUND]
        assert {h for s, h in pools if s == source} == set(below if len(below) >= 16 else every[:16])
    held = {r.doc_id: r.contained for r in fp.contained_in(rows, fp.pooled(rows, "source").where("source = 'big'")).collect()}
    assert all(held[i] == 1.0 for i in range(8)) and all(held[i] < 0.2 for i in range(8, 12))
