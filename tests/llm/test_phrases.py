import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cartolith.llm import phrases

DOCS = "doc_id long, text string, lang string, score string, words int, n long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, " ".join(w[i : i + k])] += 1
    return f, n


def brute_top(rows, frequent, top=2000):
    f, n = brute_counts(rows)
    cand = {key: v for key, v in f.items() if v >= frequent and " " in key[1]}
    out = []
    for lang, phrase in cand:
        a = cand[lang, phrase]
        if any(o == lang and len(p.split(" ")) > len(phrase.split(" ")) and b >= a and f" {phrase} " in f" {p} " for (o, p), b in cand.items()):
            continue
        w = phrase.split(" ")
        cuts = [(1000 * a * n[lang] // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, phrase, a, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], n[lang], score))
    got = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        got += [(o[0], r, *o[1:]) for r, o in enumerate(mine[:top], 1)]
    return sorted(got)


def make(seed, n=160):
    rng = random.Random(seed)
    vocab = ["a", "B", "the", "Ärger", "x" * 50, "漢字", "of", "it's", "z-z", "q"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab[: rng.randrange(2, 11)]) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words)
        if i % 9 == 0:
            text = "one set phrase that stays, " * rng.randrange(1, 4)
        rows.append((i, text, rng.choice(["en", "de", None]), "clash", -1, -1))
    return [*rows, (None, None, "en", "", 0, 0), (None, "", None, "", 0, 0), (3, rows[3][1], rows[3][2], "", 0, 0), (900, "only spaces \t ", "fr", "", 0, 0)]


@pytest.mark.parametrize("frequent, sample, slack", [(3, 2, 1.0), (8, 40, 3.0), (5, 1, 1.0)])
def test_all_counts_and_ranks(spark, frequent, sample, slack):
    """Exact whatever the sample proposes: far too little (several passes), or all."""
    rows = make(frequent)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    counts, passes = phrases.frequent_phrases(docs, frequent, 5, sample, slack)
    f, n = brute_counts(rows)
    got = {(r.lang, r.phrase): r.n for r in counts.where("words > 0").collect()}
    assert got == {k: v for k, v in f.items() if v >= frequent}
    assert {r.lang: r.n for r in counts.where("words = 0").collect() if r.n} == {k: v for k, v in n.items() if v}
    assert counts.count() == counts.select("lang", "words", "phrase").distinct().count()
    assert passes == (1 if sample == 1 else 2)
    top = phrases.top_phrases(docs, frequent=frequent, sample=sample, slack=slack)
    assert sorted(tuple(r) for r in top.collect()) == brute_top(rows, frequent)


def test_full_table_only_costs_time(spark, monkeypatch):
    """Where the table of known phrases is too small nothing is lost."""
    monkeypatch.setattr(phrases, "FEWEST_BITS", 64)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    rows = make(11, 60)
    top = phrases.top_phrases(spark.createDataFrame(rows, DOCS), top=20, frequent=4, sample=3)
    assert sorted(tuple(r) for r in top.collect()) == brute_top(rows, 4, 20)


def test_no_rows(spark):
    assert phrases.top_phrases(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.top_phrases(spark.createDataFrame([(1, None, None, "", 0, 0)], DOCS), frequent=1).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000
    rows = [("en", 0, "", big * 7), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big // 3)]
    got = phrases.scored(spark.createDataFrame(rows, phrases.ROWS)).first()
    assert got.score == 1000 * (big // 3) * big * 7 // (big * (big - 1))


def test_words_with_equal_hashes_stay_apart():
    data = np.frombuffer(b"ab cd ab ef", np.uint8)
    w = phrases.read_words(data, np.array([0, 11]))
    forced = phrases._word_ids(w.flat, w.starts, w.ends - w.starts, np.zeros(4, np.uint64))
    assert forced[0] == forced[2] and len(set(forced.tolist())) == 3
    assert phrases.slices(w.flat, w.starts[:3], w.ends[[1, 1, 3]]).equals(pa.array(["ab cd", "cd", "ab ef"]))


def test_phrases_the_table_holds_by_chance_are_counted_once():
    """A table with random marks holds phrases whose parts it lacks: two passes still give each phrase, and none twice."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        text = np.frombuffer(" ".join(rng.choice(list("abcdefgh"), 80)).encode(), np.uint8)
        w = phrases.read_words(text, np.array([0, len(text)]))
        full = np.full(1, 2**64 - 1, np.uint64)
        before = np.array([rng.integers(0, 2**64 - 1, dtype=np.uint64) | rng.integers(0, 2**64 - 1, dtype=np.uint64)])
        keys = lambda now, old: [k for _, ks, *_ in phrases.phrases_of(w, "en", now, old, 5) for k in ks.tolist()]
        assert sorted(keys(before, None) + keys(full, before)) == sorted(keys(full, None))
