"""Quality classifier from weak labels.

Nine heuristic labellers vote good, bad or undecided on every document long enough for them. Expectation-maximisation over the
counts of all vote patterns (at most 4^9, so bounded whatever the corpus) estimates the share of good
documents and, for either class, how each labeller votes. The posterior of a document's pattern is its label; a
bounded sample of documents so labelled trains a logistic scorer over hashed word shapes and hashed
measures, and that scorer judges every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, boxed, slices, table

#: Documents that train the scorer (expected; drawn by a hash of doc_id and text), hashed features, passes
SAMPLE, BUCKETS, EPOCHS, KEEP = 6_000, 1 << 14, 6, 0.5

#: Common words of some languages (fixed values)
STOP = frozenset(
    """the of and to in is that for with was on as are it be by this from at or an not
    der die das und ist von den mit zu ein eine dem nicht auf für als auch des im
    le la les de des et un une est que qui dans pour par sur pas au avec du
    el los las y en es un una que por con para del se no al su
    il che di per non sono een het van en voor niet o a os um uma não""".split()
)

#: Per word: characters, symbols, capitals, letters, ends a sentence, is common, exclamation marks
_FIELDS = 7
#: Least and most of each measure that votes good, and what votes bad below or above; (name, bad below, good from, good to, bad above)
LABELLERS = (
    ("symbols", -1.0, 0.0, 0.02, 0.10),
    ("capitals", -1.0, 0.0, 0.10, 0.50),
    ("distinct", 0.35, 0.50, 1.0, 2.0),
    ("runs", -1.0, 0.0, 0.05, 0.15),
    ("lines", -1.0, 0.0, 0.35, 0.60),
    ("ends", 0.004, 0.02, 0.35, 0.60),
    ("common", 0.02, 0.08, 0.60, 0.90),
    ("length", 2.5, 3.5, 6.2, 9.0),
    ("shouts", -1.0, 0.0, 0.05, 0.40),
)
#: Words below which a labeller is not applicable
LEAST = {"distinct": 40, "runs": 5, "ends": 30, "common": 25, "length": 8, "symbols": 1, "capitals": 4, "lines": 1, "shouts": 1}


_PUNCTUATION, _SYMBOLS = ".,;:!?\"'()", frozenset("#*$%&|<>@\\^~=_{}[]")


def _collapse(shape: str) -> str:
    """Runs of one character as one."""
    return shape if len(shape) < 2 else "".join(c for c, d in zip(shape, "\0" + shape, strict=False) if c != d)


#: Hashed features of the measures, by labeller and step
_STEPS = (0.003, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 2.5, 4, 6.5, 9)
_MEASURED = np.array([[zlib.crc32(f"{name}={step}".encode()) % BUCKETS for step in range(len(_STEPS) + 1)] for name, *_ in LABELLERS], np.int32)


class Words:
    """Numbers words and remembers what is counted of them; forgets all beyond a bound."""

    MOST = 200_000

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.fields = np.zeros((self.MOST + 1, _FIELDS), np.float32)
        self.shape = np.zeros(self.MOST + 1, np.int32)
        self.hashes: dict[str, int] = {}

    def _add(self, word: bytes) -> int:
        k = self.number[word] = len(self.number)
        w = word.decode("utf-8", "replace")
        core = w.strip(_PUNCTUATION)
        if core.isalpha() and (core.islower() or core.isupper() or core.istitle()):
            # the usual words, without a look at every letter
            before, after = w[: w.index(core)], w[w.index(core) + len(core) :]
            capitals = 0 if core.islower() else 1 if core.istitle() else len(core)
            middle = "a" if not capitals else "A" if core.isupper() else "Aa"
            symbols, letters, shape = 0, len(core), _collapse(before) + middle + _collapse(after)
        else:
            symbols, capitals, letters = sum(c in _SYMBOLS for c in w), sum(c.isupper() for c in w), sum(c.isalpha() for c in w)
            shape = _collapse("".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if c < "\x7f" else "?" for c in w))
        self.fields[k] = (len(w), symbols, capitals, letters, w[-1] in ".!?", core.lower() in STOP, w.count("!"))
        if shape not in self.hashes:
            if len(self.hashes) > 50_000:
                self.hashes.clear()
            self.hashes[shape] = zlib.crc32(shape.encode()) % BUCKETS
        self.shape[k] = self.hashes[shape]
        return k

    def measure(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """The labellers' measures, the hashed features (one for each word, then the measures') and the number of words."""
        words = text.split()
        n = len(words)
        if not n:
            return np.zeros(len(LABELLERS)), np.zeros(0, np.int32), 0
        total, shapes = np.zeros(_FIELDS), []
        for a in range(0, n, 1 << 16):  # so that a document of any length finds room
            some = words[a : a + (1 << 16)]
            if len(self.number) + len(some) > self.MOST:
                self.number.clear()
            get = self.number.get
            ids = np.fromiter((k if (k := get(w)) is not None else self._add(w) for w in some), np.int64, len(some))
            total += self.fields[ids].sum(0, dtype=np.float64)
            shapes.append(self.shape[ids])
        size, symbols, capitals, letters, ends, common, shouts = total
        lines = [x for x in text.split(b"\n") if x]
        m = np.array([symbols / n, capitals / max(1.0, letters), len(set(words)) / n, sum(map(eq, words, islice(words, 1, None))) / n, 1 - len(set(lines)) / max(1, len(lines)), ends / n, common / n, size / n, shouts / n])
        # a long text repeats words as such: distinct words are judged against their usual growth
        m[2] = min(1.0, m[2] * max(1.0, n / 400) ** 0.25)
        own = _MEASURED[np.arange(len(LABELLERS)), np.searchsorted(_STEPS, m, "right")]
        return m, np.concatenate([*shapes, own]), n


def votes(measures: np.ndarray, n: int) -> list[int]:
    """1 good, 0 bad, 2 undecided, 3 not applicable (too few words)."""
    out = []
    for x, (name, low, good, to, high) in zip(measures.tolist(), LABELLERS, strict=True):
        out.append(3 if n < LEAST[name] else 0 if x < low or x > high else 1 if good <= x <= to else 2)
    return out


def _code(v: list[int]) -> int:
    return sum(x * 4**j for j, x in enumerate(v))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, seen = Words(), {}
    for b in slices(batches, "text"):
        for text in as_bytes(b.column("text")):
            m, _, n = words.measure(text or b"")
            c = _code(votes(m, n))
            seen[c] = seen.get(c, 0) + 1
    yield pa.record_batch([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])


class LabelModel:
    """Class share and vote tables, fitted to pattern counts; posterior of every pattern."""

    def __init__(self, counts: dict[int, int], rounds: int = 60) -> None:
        codes = np.array(sorted(counts) or [_code([3] * len(LABELLERS))], np.int64)
        n = np.array([counts.get(int(c), 0) for c in codes], np.float64)
        v = codes[:, None] // 4 ** np.arange(len(LABELLERS)) % 4
        # start from the majority of votes, ties and silence leaning to good
        bad, good = (v == 0).sum(1), (v == 1).sum(1)
        post = np.where(bad > good, 0.1, np.where(bad > 0, 0.5, 0.9))
        # patterns x labellers x {bad, good, undecided}; a labeller that a short text silences says nothing about the class
        one = np.eye(4)[v][:, :, :3]
        self.history = []
        for _ in range(rounds):
            g, b = n * post, n * (1 - post)
            self.share = (g.sum() + 9.0) / (n.sum() + 10.0)
            # smoothed: a labeller is more often right than wrong
            right, wrong = np.array([0.5, 2.0, 1.0]), np.array([2.0, 0.5, 1.0])
            tables = [np.tensordot(w, one, (0, 0)) + p for w, p in ((g, right), (b, wrong))]
            tables = [t / t.sum(1, keepdims=True) for t in tables]
            like = [(one * np.log(t)).sum((1, 2)) for t in tables]
            odds = np.log(self.share) - np.log1p(-self.share) + like[0] - like[1]
            post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            self.history.append(float((n * np.logaddexp(np.log(self.share) + like[0], np.log1p(-self.share) + like[1])).sum()))
        self.tables = tables
        self.posterior = dict(zip(codes.tolist(), post.tolist(), strict=True))

    def accuracies(self) -> list[float]:
        """Of each labeller, where it votes."""
        good, bad = self.tables
        hit = self.share * good[:, 1] + (1 - self.share) * bad[:, 0]
        return (hit / (self.share * (good[:, 0] + good[:, 1]) + (1 - self.share) * (bad[:, 0] + bad[:, 1]))).tolist()


def _examples(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches, "text"):
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text")), strict=True):
                m, f, n = words.measure(text or b"")
                if n:
                    k, c = np.unique(f[:n], return_counts=True)
                    rows.append((i, shared.value.posterior[_code(votes(m, n))], np.concatenate([k, f[n:]]).tolist(), np.concatenate([c / n, np.ones(len(f) - n)]).tolist()))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.float64()))], names=["doc_id", "target", "at", "value"])

    return run


def fit_scorer(examples: list[tuple[float, list[int], list[float]]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the hashed features, then the constant: AdaGrad on the cross-entropy with the posterior labels."""
    w, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-4)
    data = [(t, np.array([*at, BUCKETS]), np.array([*value, 1.0])) for t, at, value in examples]
    for _ in range(epochs):
        for target, at, value in data:
            g = (target - 1 / (1 + np.exp(-np.clip(w[at] @ value, -30, 30)))) * value - 1e-5 * w[at]
            np.add.at(squares, at, g * g)
            np.add.at(w, at, 0.2 * g / np.sqrt(squares[at]))
    return w


class QualityModel:
    def __init__(self, labels: LabelModel, weights: np.ndarray) -> None:
        self.labels, self.weights = labels, weights


def train(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Vote counts over all of docs, then the scorer on about `sample` of them."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = {r["pattern"]: r["n"] for r in rows.select("text").mapInArrow(_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    labels = LabelModel(counts)
    share = min(1.0, sample / max(1, sum(counts.values())))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    shared = docs.sparkSession.sparkContext.broadcast(labels)
    got = drawn.mapInArrow(_examples(shared), "doc_id long, target double, at array<int>, value array<double>").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"] or 0, r["at"]))
    return QualityModel(labels, fit_scorer([(r["target"], r["at"], r["value"]) for r in got]))


def judge(words: Words, model: QualityModel, text: bytes | None) -> tuple[int, float, float]:
    """Words, score (0 to 1) and posterior of the votes; a text without words scores 0."""
    m, f, n = words.measure(text or b"")
    if not n:
        return 0, 0.0, 0.0
    w = model.weights
    odds = w[f[:n]].sum() / n + w[f[n:]].sum() + w[BUCKETS]
    return n, float(1 / (1 + np.exp(-np.clip(odds, -30, 30)))), model.labels.posterior.get(_code(votes(m, n)), model.labels.share)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), shared.value
        for b in slices(batches, "text"):
            got = [judge(words, model, x) for x in as_bytes(b.column("text"))]
            n, score, post = zip(*got, strict=True)
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(score, pa.float64()), pa.array(post, pa.float64()), pa.array([s >= KEEP for s in score])], names=["doc_id", "n_words", "score", "posterior", "kept"])

    return run


def _filter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), shared.value
        for b in slices(batches, "text"):
            keep = pa.array([judge(words, model, x)[1] >= KEEP for x in as_bytes(b.column("text"))], pa.bool_())
            yield b.filter(keep).select(["row"])

    return run


def score(docs: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """doc_id, n_words, score, posterior, kept for every row of docs; null and empty texts score 0 and are not kept.

    Repeated rows score alike; a score of exactly KEEP is kept; an empty table gives no rows; texts of any length are read whole and
    columns beyond doc_id and text not at all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_score(shared), "doc_id long, n_words long, score double, posterior double, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """The rows of docs that the scorer keeps, all their columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    own = boxed(docs, text=F.col("text").cast("string"))
    return own.mapInArrow(_filter(shared), own.select("row").schema).select("row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
