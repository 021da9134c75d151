"""Toxic documents by a gap-weighted subsequence kernel on the words of sentences, Nystroem landmarks and a linear SVM."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.common import held_out, materialise, pieces, shingle_sets, table, text_buffers

#: At most so many labelled documents are learned from: those with the smallest hashes.
LEARN_TOXIC, LEARN_CLEAN = 3000, 6000
#: Landmarks: words, and pairs of words that toxic sentences have beyond chance, and plain words that look like them.
LANDMARKS, PAIR_LANDMARKS, PLAIN_LANDMARKS = 256, 64, 128
#: Sentences of a labelled document, and of all clean ones the most toxic ones, that are learned from at most; the letters
#: of a word that may become a landmark.
SENTENCES, CLEAN_SENTENCES, WORD_LETTERS = 8, 12_000, 64
#: Words that a task remembers at most.
CACHE_WORDS = 600_000
DECAY, GAPS = 0.6, (1, 2, 3)
#: The word kernel is this power of the similarity, and none below a similarity of NEAR.
POWER, NEAR = 4, 0.45
#: Words that add less than this to a sentence, about a sixth of what an insult adds, add nothing.
LEAST_GAIN = 0.3
_LEET = str.maketrans("013457@$!", "oieastasi")
_OTHER = re.compile(r"[^\w]|[\d_]")
#: What is cut off a word's ends; the marks that end sentences are among them, so a word is the same before and after.
_ENDS = ".,;:!?\"'()[]{}<>|\u3002\uff01\uff1f"
_RUN = re.compile(r"(?<!\S)(?:\S ){3,}\S")
_SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
_SENTENCE = re.compile(r"[.!?\n\u3002\uff01\uff1f]+(?=\s|$)")


def plain(word: str) -> str:
    """Letters only, digits and signs that stand for letters read as such, without the punctuation at the ends."""
    if word.isalpha():
        return word
    word = word.strip(_ENDS)
    return _OTHER.sub("", word.translate(_LEET) if any(c.isalpha() for c in word) else word)


def words(text: str) -> set[str]:
    """The distinct lower-case words of a text, and what its sentences' runs of single characters spell.

    These are, but for marks at their ends, the words that `sentences` gives: nothing that is scored isn't looked up.
    """
    low = text.lower()
    out = set(low.split())
    if _RUN.search(low):
        for part in _SENTENCE.split(low):
            out.update(m.group().replace(" ", "") for m in _SPACED.finditer(part))
    return out


def sentences(text: str) -> list[list[str]]:
    """The plain words of each sentence of a text, and what a sentence's runs of single characters spell, behind them."""
    out = []
    for part in _SENTENCE.split(text.lower()):
        spelt = [m.group().replace(" ", "") for m in _SPACED.finditer(part)]
        if own := [p for w in [*part.split(), *spelt] if len(p := plain(w)) >= 3]:
            out.append(own)
    return out


def subsequences(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, feature, weight) of all three-letter subsequences with gaps of at most two: weight DECAY^span.

    An item's ends count as letters.
    """
    items = [f"^{x}$" for x in items]
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    codes = np.frombuffer("".join(items).encode("utf-32-le", "replace"), np.uint32).astype(np.int64) & 1023
    owner = np.repeat(np.arange(len(items)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the word's end
    at, keys, weights = [], [], []
    for a in GAPS:
        for b in GAPS:
            i = np.flatnonzero(left > a + b)
            at.append(owner[i])
            keys.append((codes[i] << 20) | (codes[i + a] << 10) | codes[i + a + b])
            weights.append(np.full(len(i), DECAY ** (a + b + 1)))
    return np.concatenate(at), np.concatenate(keys), np.concatenate(weights)


def exact_norms(items: list[str]) -> np.ndarray:
    """The square root of each item's kernel with itself."""
    at, keys, w = subsequences(items)
    u, back = np.unique((at << 30) | keys, return_inverse=True)
    total = np.bincount(back, w, len(u))
    return np.sqrt(np.bincount(u >> 30, total * total, len(items)))


class _Sparse:
    """A table's entries row by row: a subsequence is part of few landmarks."""

    def __init__(self, table: np.ndarray):
        self.width = table.shape[1]
        row, self.column = np.nonzero(table)
        self.value = table[row, self.column]
        self.ends = np.searchsorted(row, np.arange(len(table) + 1))


class Kernel:
    """The word kernel with fixed landmarks, as a table from subsequences to landmarks."""

    def __init__(self, landmarks: list[str]):
        at, keys, w = subsequences(landmarks)
        self.keys, back = np.unique(keys, return_inverse=True)
        self.table = np.zeros((len(self.keys), len(landmarks)))
        np.add.at(self.table, (back, at), w)
        self.table /= np.maximum(exact_norms(landmarks), 1e-12)
        self.whole = _Sparse(self.table)
        self.look_for(np.ones(len(landmarks), bool))

    def look_for(self, wanted: np.ndarray) -> None:
        """From now on near() gives the items that are similar to one of these landmarks."""
        self.wanted = wanted
        self.narrow = _Sparse(self.table[:, wanted])
        self.bound = self.table[:, wanted].max(1, initial=0.0)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys[self.bound > 0] % 1_048_573] = True

    def __call__(self, items: list[str]) -> np.ndarray:
        out = self.similarity(items, self.whole)
        return np.where(out >= NEAR, out, 0.0) ** POWER

    def similarity(self, items: list[str], table: _Sparse) -> np.ndarray:
        out = np.zeros((len(items), table.width))
        for s in range(0, len(items), 2048):
            part = items[s : s + 2048]
            at, keys, w = subsequences(part)
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[i] == keys)
            row, n = i[hit], table.ends[i[hit] + 1] - table.ends[i[hit]]
            where = np.arange(int(n.sum())) + np.repeat(table.ends[row] - (np.cumsum(n) - n), n)
            spot = np.repeat(at[hit], n) * table.width + table.column[where]
            total = np.bincount(spot, np.repeat(w[hit], n) * table.value[where], len(part) * table.width)
            out[s : s + 2048] = total.reshape(len(part), -1) / np.maximum(exact_norms(part), 1e-12)[:, None]
        return out

    def near(self, items: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """The landmarks that each item is similar to, and how much; items without any that is looked for are left out.

        An item's similarity to any of those is at most the sum of its subsequences' largest weights over its least
        possible norm, so items for which that is less than NEAR needn't be compared.
        """
        at, keys, w = subsequences(items)
        hit = np.flatnonzero(self.maybe[keys % 1_048_573])
        i = np.minimum(np.searchsorted(self.keys, keys[hit]), len(self.keys) - 1)
        ok = self.keys[i] == keys[hit]
        top = np.bincount(at[hit[ok]], self.bound[i[ok]] * w[hit[ok]], len(items))
        low = np.sqrt(np.bincount(at, w * w, len(items)))
        close = [items[k] for k in np.flatnonzero(top >= NEAR * np.maximum(low, 1e-12) * (1 - 1e-9))]
        close = [close[k] for k in np.flatnonzero((self.similarity(close, self.narrow) >= NEAR * (1 - 1e-9)).any(1))]
        values = self(close)
        return {close[r]: (c, values[r, c]) for r in np.flatnonzero(values[:, self.wanted].any(1)) for c in [np.flatnonzero(values[r])]}


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600, ridge: float = 1e-4, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss; start: weights and bias to begin with."""
    w, b, m, v = np.zeros(x.shape[1] + 1) if start is None else start, 0.0, 0.0, 0.0
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ w))
        g = -2 * ((weight * y * slack) @ x) + 2 * ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    b = float(w[-1])
    return w[:-1], b


class Scorer:
    """Decision values of sentences. The sentence kernel sums the word kernel over the words of both sentences.

    A landmark is a sentence of one word, or of two: then the kernel is the product of the words' over the neighbouring
    words, with at most one word between. `first` and `second` are the word landmarks of each pair.
    """

    def __init__(self, words: list[str], pairs: list[tuple[str, str]]):
        self.names = sorted(set(words) | {w for p in pairs for w in p})
        at = {w: k for k, w in enumerate(self.names)}
        self.kernel = Kernel(self.names or ["aaa"])
        self.single = np.array([at[w] for w in words], np.int64)
        self.first, self.second = (np.array([at[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.size = len(words) + len(pairs)
        self.weights, self.bias, self.slope, self.shift = np.zeros(self.size), -1.0, 0.0, 0.0
        self.word_weights = np.ones(len(self.names))
        self.clear()

    def clear(self) -> None:
        """Forget the words met; a Python worker keeps them between its tasks."""
        self.met: set[str] = set()
        self.hot: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # plain words near a landmark
        self.gain: dict[str, float] = {}  # what they add to a sentence on their own
        self.raising: set[str] = set()  # those that can raise a sentence
        self.marked: set[str] = set()  # words as written whose plain form is one of those

    def use(self, weights: np.ndarray, bias: float) -> None:
        """Take these weights. Words add to a sentence if they are near a landmark with a positive weight, or one of a pair."""
        self.weights, self.bias = weights, bias
        self.word_weights = np.zeros(len(self.names))
        np.add.at(self.word_weights, self.single, weights[: len(self.single)])
        wanted = self.word_weights > 0
        wanted[self.first] = wanted[self.second] = True
        self.kernel.look_for(wanted)
        self.clear()

    def look_up(self, plains: set[str]) -> set[str]:
        """Add what is near a landmark; those of them that can raise a sentence."""
        near = self.kernel.near(sorted(plains))
        self.hot |= near
        gain = {w: float(v @ self.word_weights[at]) for w, (at, v) in near.items()}
        self.gain |= (gain := {w: g if abs(g) >= LEAST_GAIN else 0.0 for w, g in gain.items()})
        paired = set(self.first) | set(self.second)
        return {w for w, g in gain.items() if g > 0 or not paired.isdisjoint(near[w][0].tolist())}

    def value(self, sentence: list[str]) -> float:
        """The sentence's decision value."""
        total = self.bias + sum(self.gain.get(w, 0.0) for w in sentence)
        if len(self.first) and (v := self.values(sentence)) is not None:
            total += float(v[len(self.single) :] @ self.weights[len(self.single) :])
        return total

    def values(self, sentence: list[str]) -> np.ndarray | None:
        """The sentence kernel with each landmark; None if no word is near one."""
        where = [k for k, w in enumerate(sentence) if w in self.hot]
        if not where:
            return None
        rows = np.zeros((len(where), len(self.names)))
        for r, k in enumerate(where):
            rows[r, self.hot[sentence[k]][0]] = self.hot[sentence[k]][1]
        both = np.zeros(len(self.first))
        for r, k in enumerate(where):
            for q in range(r + 1, len(where)):
                if where[q] - k > 2:
                    break
                both += rows[r, self.first] * rows[q, self.second]
        return np.concatenate([rows.sum(0)[self.single], both])

    def documents(self, column: pa.Array):
        """(row, sentence) of all sentences of the texts that hold a word which can raise one."""
        data, offsets = text_buffers(column)
        for i, j in pieces(offsets) if self.size else ():
            texts = [data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in range(i, j)]
            own = [words(t) for t in texts]
            if len(self.met) > CACHE_WORDS:
                self.clear()
            new = set().union(*own) - self.met
            self.met |= new
            fresh = {w: p for w in new if len(p := plain(w)) >= 3}
            if fresh:
                self.raising |= self.look_up(set(fresh.values()) - self.gain.keys())
                self.marked |= {w for w, p in fresh.items() if p in self.raising}
            for r, (mine, text) in enumerate(zip(own, texts, strict=True), i):
                if not mine.isdisjoint(self.marked):
                    for sentence in sentences(text):
                        yield r, sentence

    def texts(self, column: pa.Array) -> np.ndarray:
        """The largest decision value among each text's sentences, and at least that of one without any landmark."""
        out = np.full(len(column), self.bias)
        for r, sentence in self.documents(column):
            out[r] = max(out[r], self.value(sentence))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.texts(column) - self.shift), -30, 30)))


_ROWS = "doc_id long, toxic int, text string, m0 long, m1 long, m2 long, words array<string>, pairs array<string>"


def _rows(batches):
    """Per document min-hashes, which near copies share, its distinct plain words and its sentences' pairs of neighbours."""
    for b in batches:
        marks: list[list[int]] = [[] for _ in range(b.num_rows)]
        for r, s in shingle_sets(b.column(2), 3):
            marks[r] = [int((s * np.uint64(2 * k + 1) * np.uint64(0x9E3779B97F4A7C15)).min() >> np.uint64(1)) if len(s) else -1 - r for k in range(3)]
        own, two = [], []
        for text in b.column(2).to_pylist():
            parts = [[w for w in part if len(w) <= WORD_LETTERS] for part in sentences(text or "")]
            own.append(sorted({w for part in parts for w in part}))
            two.append(sorted({f"{x} {y}" for part in parts for x, y in zip(part, part[1:], strict=False)}))
        kinds = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), b.column(2), *[pa.array([m[k] for m in marks], pa.int64()) for k in range(3)], pa.array(own, kinds), pa.array(two, kinds)], ["doc_id", "toxic", "text", "m0", "m1", "m2", "words", "pairs"])


def _beyond_chance(made: DataFrame, column: str, share: float, most: int) -> list[str]:
    """The items that toxic documents have beyond chance, the most frequent first.

    df documents of which a share is toxic hold `bad` toxic ones or more with a probability of at most
    exp(-df * KL(bad / df, share)), whatever df is; times the number of items as frequent, it has to be below 0.05.
    """
    counts = materialise(made.select("toxic", F.explode(column).alias("item")).groupBy("item").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("df")))
    many = {r[0]: r[1] for r in counts.groupBy(F.least("df", F.lit(100)).alias("df")).count().collect()}
    rate = F.col("bad") / F.col("df")
    rest = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / F.lit(1 - share))).otherwise(F.lit(0.0))
    tail = F.col("df") * (rate * F.log(rate / F.lit(share)) + rest)
    found = counts.where((F.col("bad") >= 2) & (rate > max(share, 0.8))).withColumn("tail", tail).orderBy(F.desc("tail"), "item").limit(20_000).collect()
    as_frequent = {d: sum(c for k, c in many.items() if k >= d) for d in range(1, 101)}
    kept = [r for r in found if math.exp(-r["tail"]) * as_frequent[min(r["df"], 100)] < 0.05]
    return [r["item"] for r in sorted(kept, key=lambda r: (-r["bad"], r["item"]))[:most]]


def _with_gap(word: str) -> list[str]:
    return [word[:k] + "x" + word[k:] for k in (1, len(word) // 2)]


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A multiple-instance SVM on sentences: of a toxic document the sentence that looks most toxic is its example, of a
    clean one all of its sentences are. Landmarks are the words and pairs that toxic documents have beyond chance, and
    the plain words most like them."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(LEARN_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(LEARN_CLEAN))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.col("text").cast("string"))
    made = materialise(rows.mapInArrow(_rows, _ROWS))
    for k in range(3):  # one of each group of near copies
        made = made.groupBy(f"m{k}").agg(F.min(F.struct("doc_id", *[c for c in made.columns if c not in ("doc_id", f"m{k}")])).alias("r")).select(f"m{k}", "r.*")
    made = materialise(made)
    n = {r[0]: r[1] for r in made.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Scorer([], [])
    share = n[1] / (n[0] + n[1])
    insults = _beyond_chance(made, "words", share, LANDMARKS)
    taken = set(insults)
    pairs = [p for x in _beyond_chance(made, "pairs", share, 4 * PAIR_LANDMARKS) if taken.isdisjoint(p := tuple(x.split(" ")))][:PAIR_LANDMARKS]
    if not insults and not pairs:
        return Scorer([], [])
    scorer = Scorer(insults + [_with_gap(w)[1] for w in insults[:64]], pairs)
    plain_words = _most_alike(made.where("toxic = 0"), scorer)
    scorer = Scorer(insults + [_with_gap(w)[1] for w in insults[:64]] + plain_words, pairs)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def values_of(batches):
        for b in batches:
            best: dict[int, list[np.ndarray]] = {}
            for r, sentence in shared.value.documents(b.column(2)):
                if (v := shared.value.values(sentence)) is not None:
                    best.setdefault(r, []).append(v)
            rows = [(r, v) for r, own in best.items() for v in sorted(own, key=lambda v: -v.sum())[:SENTENCES]]
            ids, toxic = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = [np.flatnonzero(v) for _, v in rows]
            yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r, _ in rows], pa.int64()), pa.array([toxic[r] for r, _ in rows], pa.int32()), pa.array([a.tolist() for a in at], pa.list_(pa.int32())), pa.array([v[a].tolist() for a, (_, v) in zip(at, rows, strict=True)], pa.list_(pa.float64()))], ["doc_id", "toxic", "at", "v"])

    # at most SENTENCES rows for each of the labelled documents
    got = made.select("doc_id", "toxic", "text").mapInArrow(values_of, "doc_id long, toxic int, at array<int>, v array<double>").toArrow().to_pandas()
    got = got.sort_values(["doc_id"], kind="stable").reset_index(drop=True)
    x = np.zeros((len(got), scorer.size))
    for r, (at, v) in enumerate(zip(got["at"], got["v"], strict=True)):
        x[r, np.asarray(at, np.int64)] = v
    _fit(scorer, x, got["toxic"].to_numpy(), got["doc_id"].to_numpy(), insults)
    fitted = docs.sparkSession.sparkContext.broadcast(scorer)

    def scored(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fitted.value.texts(b.column(1)))], ["y", "v"])

    got = made.select("toxic", "text").mapInArrow(scored, "y int, v double").toArrow().to_pandas()  # a number a labelled document
    _calibrate(scorer, got["v"].to_numpy(), got["y"].to_numpy())
    return scorer


def _fit(scorer: Scorer, x: np.ndarray, toxic: np.ndarray, doc: np.ndarray, insults: list[str]) -> None:
    """Weights and bias from the sentences' kernel values."""
    words = scorer.kernel(scorer.names)
    gram = np.zeros((scorer.size, scorer.size))
    k = len(scorer.single)
    gram[:k, :k] = words[np.ix_(scorer.single, scorer.single)]
    gram[k:, k:] = words[np.ix_(scorer.first, scorer.first)] * words[np.ix_(scorer.second, scorer.second)]
    values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(scorer.size))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    # sentences of one insult with an inserted character, and a sentence without any landmark
    gaps = [g for w in insults for g in _with_gap(w)]
    made = np.concatenate([scorer.kernel(gaps)[:, scorer.single], np.zeros((len(gaps), scorer.size - k))], 1) if gaps else np.zeros((0, scorer.size))
    clean, bags = x[toxic == 0], x[toxic == 1]
    clean = clean[np.argsort(-clean[:, : len(insults)].sum(1), kind="stable")[:CLEAN_SENTENCES]]
    owner = doc[toxic == 1]
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(owner))
    score = bags.sum(1)
    start = None
    for steps in (200, 200, 200, 400):  # the sentence that a toxic document stands for is the most toxic one so far
        best = np.array([b + int(score[b:e].argmax()) for b, e in zip(begins, ends, strict=True)], np.int64)
        positive = np.concatenate([bags[best], made])
        data = np.concatenate([positive, clean, np.zeros((1, scorer.size))]) @ root
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(clean) + 1)])
        weight = np.concatenate([np.ones(len(best)) / max(len(best), 1), np.full(len(made), 0.25 / max(len(made), 1)), np.full(len(clean), 0.5 / max(len(clean), 1)), [0.75]])
        w, bias = fit_svm(data, y, weight, steps, start=start)
        start = np.append(w, bias)
        score = bags @ (root @ w)
    weights = root @ w
    own = len(insults) + len(insults[:64])
    weights[own:k] = np.minimum(weights[own:k], 0)  # plain landmarks only take away
    scorer.use(weights, bias)


def _calibrate(scorer: Scorer, v: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift of the score from the labelled documents' values."""
    # the cut with the fewest errors, clean documents weighing more, in the middle of its gap; a score of 0.7 lies on it
    cuts = np.quantile(v, np.linspace(0, 1, 2001))
    errors = np.array([(v[y == 1] < c).mean() + 4 * (v[y == 0] >= c).mean() for c in cuts])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    cut = (cuts[best[0]] + cuts[best[-1]]) / 2
    if best[0] and cuts[best[0]] > cuts[best[0] - 1]:
        cut = (cut + cuts[best[0] - 1]) / 2
    scorer.slope = 6.0 / max(v[y == 1].std() + v[y == 0].std(), 0.2)
    scorer.shift = float(cut - math.log(0.7 / 0.3) / scorer.slope)


def _most_alike(clean: DataFrame, scorer: Scorer) -> list[str]:
    """Words of clean documents that are most like the insults, frequent ones before rare ones."""
    shared = clean.sparkSession.sparkContext.broadcast(scorer.kernel)
    counts = clean.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def values(batches):
        for b in batches:
            near = shared.value.near(b.column(0).to_pylist())
            rows = [(w, d, float(near[w][1].max())) for w, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if w in near]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["word", "df", "v"])

    scored = counts.mapInArrow(values, "word string, df long, v double")
    known = set(scorer.names)
    worst = scored.orderBy(F.desc(F.col("v") * F.log1p("df")), "word").limit(PLAIN_LANDMARKS + len(known))
    return [r["word"] for r in worst.collect() if r["word"] not in known][:PLAIN_LANDMARKS]


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from 0.7 on).

    A document is as toxic as the sentence in it that is most like the toxic sentences learned, with gaps, inserted
    characters, digits for letters and letters set apart. Whole texts are scored; null counts as empty and gets the
    lowest score. Labels other than 0 and 1 are ignored; a doc_id with both counts as 1; without labels of both kinds
    each score is 0.5. Repeated rows stay; extra columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(text))

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
