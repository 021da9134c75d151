import hashlib
import random
import zlib

import pytest
from cartolith.llm import merkle
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf_of(doc_id, text, lang, source, n_chars):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return h(*parts)


def ways(leaves):
    """(root, for each leaf its sibling runs: (place, others)) of one tree, by plain recursion over levels."""
    out = [[] for _ in leaves]
    at, now = list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for i in range(len(leaves)):
            run = now[at[i] // 8 * 8 : at[i] // 8 * 8 + 8]
            out[i].append((at[i] % 8, run[: at[i] % 8] + run[at[i] % 8 + 1 :]))
            at[i] //= 8
        now = [h(*now[k : k + 8]) for k in range(0, len(now), 8)]
    return now[0], out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf_of(*r), r) for r in rows if r[2] == lang), key=lambda x: x[:3])
        trees[lang] = (mine, *ways([m[2] for m in mine]))
    root, crown = ways([trees[lang][1] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        mine, subroot, steps = trees[lang]
        for (_, _, leaf, r), way in zip(mine, steps, strict=True):
            way = way + crown[k]
            d = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                d = leaf_of(r[0], lower(r[1]), *r[2:])
            for place, others in way:
                d = h(*others[:place], d, *others[place:])
            out.append((r[0], leaf, subroot, root, h(*[x for _, o in way for x in o]), d, d == root))
    return sorted(out, key=repr)


def odd_rows():
    rows = [(i, f"Text Number {i}" if i % 2 else f"plain {i}", "de" if i % 3 else "en", f"s{i % 4}", i) for i in range(700)]
    rows += [(7, "again", "de", None, None), (7, "again", "de", None, None), (None, None, "de", "s", 1), (None, "", None, None, 2), (9000, "Ä" * 70_000, None, "s", 1), (1, "x", "Ω", "é", -5), (-3, "Y", "fr", "s", 0)]
    return rows


@pytest.fixture(scope="module")
def few_leaves():
    """Blocks of 64 leaves, so that small trees have many."""
    old = merkle.BLOCK_LEVELS, merkle.BLOCK, merkle.WIDE_LEVEL
    merkle.BLOCK_LEVELS, merkle.BLOCK, merkle.WIDE_LEVEL = 2, 64, 4
    yield
    merkle.BLOCK_LEVELS, merkle.BLOCK, merkle.WIDE_LEVEL = old


def op12(docs, monkeypatch):
    monkeypatch.setattr(merkle, "table", lambda *_: docs)
    return sorted((tuple(r) for r in merkle.op12_merkle_manifest(docs.sparkSession, "").collect()), key=repr)


def test_odd_rows(spark, monkeypatch, few_leaves):
    rows = odd_rows()
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("clash")).withColumn("pos", F.lit(-1)).withColumn("tree", F.lit(None))
    got = op12(docs, monkeypatch)
    assert got == brute(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [0, 1, 65])
def test_sizes(spark, monkeypatch, few_leaves, n):
    rows = [(i, f"T{i}", "en", "s", 1) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    assert op12(docs, monkeypatch) == (brute(rows) if n else [])


def test_proofs_of_some_leaves(spark, few_leaves):
    """Whatever leaves are asked for, steps lead to the root, and a block fetches no node that it could derive."""
    docs = spark.createDataFrame(odd_rows(), DOCS)
    m = merkle.manifest_of(docs)
    wanted = m.rows.select("doc_id", "tree", "pos", "size", "depth", "digest").where("doc_id % 7 < 2")
    proved = merkle.prove(m, wanted)
    ok = proved.select("doc_id", "root", merkle.fold(F.col("digest"), F.col("steps")).alias("folded"))
    rows = ok.collect()
    assert len(rows) == wanted.count() and all(r.root == r.folded for r in rows) and len({r.root for r in rows}) == 1
    wrong = proved.select(merkle.fold(F.sha2(F.lit(b"other"), 256), F.col("steps")).alias("f"), "root").where("f = root")
    assert wrong.count() == 0


def test_requests_are_minimal():
    import numpy as np

    rng = random.Random(5)
    for size in (1, 7, 8, 9, 64, 65, 300):
        levels = len([k for k in range(9) if 8**k < size])
        wanted = {rng.randrange(size) for _ in range(rng.randrange(1, 12))}
        got = {(level, int(p)) for level, ps in merkle.path_requests(np.array(sorted(wanted)), size, levels) for p in ps}
        known, count, want = set(wanted), size, set()
        for level in range(levels):
            children = {c for p in known for c in range(p // 8 * 8, min(p // 8 * 8 + 8, count))}
            want |= {(level, c) for c in children - known}
            known, count = {p // 8 for p in known}, -(-count // 8)
        assert got == want
