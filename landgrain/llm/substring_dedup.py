"""Exact removal of passages that repeat across documents, by seed and extend.

Seeds are the words' 16-grams that winnowing selects: of every window of 50 words the rightmost
16-gram with the least hash. The choice depends on the window's words alone, so two documents that
share a window share its seed. An *occurrence* is a seed with the run of consecutive windows that
selected it; extending a match of two occurrences of one seed to the left and to the right means
finding which windows of the runs are equal on both sides of the seed.

* Occurrences whose seed no other document has are dropped.
* Occurrences with the same words over the whole run form a class, described by one row. In any
  document but the first of its class, the whole run repeats an earlier document.
* Only where a seed has several classes (matches that end inside the run) are the windows themselves
  compared, once per class, from the class's first document. No pairs of documents are ever formed.

Maximal repeats are the unions of the repeated windows of a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, materialise, slices, text_tag

WINDOW, SEED = 50, 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hashes(dict):
    """128-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_128_digest(word, 7)
        return h


class _Powers:
    """Powers of the rolling hash's base and of its inverse, as long as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            m = max(n + 1, 1 << 16)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, _INVERSE)]), dtype=np.uint64)
        return self.up, self.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words:
    """Rolling hashes over the words of several texts laid end to end, from either half of the words' hashes."""

    def __init__(self, texts: list[bytes], hashes: _Hashes, powers: _Powers) -> None:
        lists = [(t or b"").split() for t in texts]
        self.lengths = np.array([len(x) for x in lists], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        n = int(self.lengths.sum())
        up, self.down = powers.get(n)
        w = np.frombuffer(b"".join([hashes[x] for words in lists for x in words]), np.uint64).reshape(n, 2)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(w[:, half] * up[:n], dtype=np.uint64)]) for half in (0, 1)]

    def hash(self, start: np.ndarray, length: np.ndarray | int, half: int = 0) -> np.ndarray:
        return _mix((self.sums[half][start + length] - self.sums[half][start]) * self.down[start])

    def both(self, start: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes: 128 bits that stand for the words, whatever the size of the corpus."""
        return tuple(self.hash(start, length, half).view(np.int64) for half in (0, 1))


def _rightmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every i, the position of the rightmost least of values[i : i + width]."""
    at = np.arange(len(values))
    have = 1

    def join(at: np.ndarray, step: int) -> np.ndarray:
        left, right = at[:-step], at[step:]
        return np.where(values[right] <= values[left], right, left)

    while 2 * have <= width:
        at = join(at, have)
        have *= 2
    return join(at, width - have) if width > have else at


def occurrences(texts: list[bytes], hashes: _Hashes, powers: _Powers, window: int, seed: int) -> dict[str, np.ndarray]:
    """Columns of one row per run of windows with one seed: text's index, first window, windows, seed's offset, seed, words of the run."""
    words = _Words(texts, hashes, powers)
    n = int(words.lengths.sum())
    none = np.zeros(0, np.int64)
    if n < window:
        return {k: none for k in ("row", "start", "len", "off", "seed", "run", "run2")}
    grams = words.hash(np.arange(n - seed + 1), seed)
    anchor = _rightmost_least(grams, window - seed + 1)
    row = np.repeat(np.arange(len(texts)), np.maximum(words.lengths - window + 1, 0))
    first = np.cumsum(np.maximum(words.lengths - window + 1, 0)) - np.maximum(words.lengths - window + 1, 0)
    at = np.arange(len(row)) - first[row] + words.starts[row]  # every window's first word
    anchor = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])) if len(at) else none
    count = np.diff(np.append(new, len(at)))
    start, seeds = at[new], anchor[new]
    run, run2 = words.both(start, count + window - 1)
    return {"row": row[new], "start": start - words.starts[row[new]], "len": count, "off": seeds - start, "seed": grams[seeds].view(np.int64), "run": run, "run2": run2}


def _occurrences(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = _Hashes(), _Powers()
        for b in slices(batches, "text", 1 << 20):
            found = occurrences(as_bytes(b.column("text")), hashes, powers, window, seed)
            row = pa.array(found["row"])
            yield pa.record_batch(
                [b.column("doc_id").take(row), b.column("tag").take(row), *(pa.array(found[k].astype(t)) for k, t in (("start", np.int32), ("len", np.int32), ("off", np.int32), ("seed", np.int64), ("run", np.int64), ("run2", np.int64)))],
                names=["doc_id", "tag", "start", "len", "off", "seed", "run", "run2"],
            )

    return run


def _windows(window: int):
    """Hashes of the requested windows: class, doc_id, the window's place in the run, hash (two halves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = _Hashes(), _Powers()
        for b in slices(batches, "text", 1 << 20):
            words = _Words(as_bytes(b.column("text")), hashes, powers)
            ids, runs = b.column("doc_id").to_pylist(), b.column("runs").to_pylist()
            asked = [(i, r["start"], r["len"], r["class"], r["run2"]) for i, own in enumerate(runs) for r in own]
            if not asked:
                continue
            i, start, n, kind, kind2 = (np.array(x) for x in zip(*asked, strict=True))
            k = np.repeat(np.arange(len(i)), n)
            place = np.arange(len(k)) - (np.cumsum(n) - n)[k]
            h, h2 = words.both(words.starts[i[k]] + start[k] + place, window)
            yield pa.record_batch([pa.array(kind[k]), pa.array(kind2[k]), pa.array(np.array(ids)[i[k]]), pa.array(place.astype(np.int32)), pa.array(h), pa.array(h2)], names=["class", "run2", "doc_id", "place", "hash", "hash2"])

    return run


def _cut(window: int):
    """Remove the words under repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n_words, n_removed, kept, digests = [], [], [], []
            for text, runs in zip(as_bytes(b.column("text")), b.column("runs").to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if runs:
                    edges = np.zeros(len(words) + 1, np.int32)
                    for r in runs:
                        starts = r["start"] + np.flatnonzero(np.unpackbits(np.array([r["mask"]], np.int64).view(np.uint8), bitorder="little"))
                        np.add.at(edges, starts, 1)
                        np.add.at(edges, starts + window, -1)
                    stay = np.cumsum(edges[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                left = b" ".join(words)
                n_removed.append(n_words[-1] - len(words))
                kept.append(left)
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def repeated_runs(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, tag, runs (start, mask: bit i is set if window start + i repeats a document with a smaller doc_id).

    docs: doc_id, tag, text. Rows without a doc_id have no order and take no part.
    """
    if not 0 <= window - seed < 63:
        raise ValueError("a run of windows must fit a 63-bit mask")
    fields = "doc_id long, tag long, start int, len int, off int, seed long, run long, run2 long"
    every = materialise(docs.where("doc_id is not null").mapInArrow(_occurrences(window, seed), fields), "occurrences")
    # aggregates are written before they are joined: Spark splits a hot key of a join only where both sides are shuffled for the join itself
    shared = materialise(every.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("seed"), "seeds")
    # a class: the words of the run, by 128 bits of hash, and where its seed lies
    own = materialise(every.join(shared, "seed", "left_semi").withColumn("class", F.xxhash64("seed", "off", "len", "run")), "shared")
    kind = ["class", "run2"]
    classes = own.groupBy(*kind).agg(F.min(F.struct("doc_id", "tag", "start", "len", "seed")).alias("f"))
    classes = materialise(classes.select(*kind, "f.*"), "classes")
    # several classes of one seed: compare windows
    several = materialise(classes.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"), "several")
    asked = classes.join(several, "seed", "left_semi").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "len", *kind)).alias("runs"))
    # requests grow with the documents, so they are never broadcast
    windows = docs.join(materialise(asked, "asked").hint("merge"), ["doc_id", "tag"]).select("doc_id", "text", "runs")
    windows = materialise(windows.mapInArrow(_windows(window), "class long, run2 long, doc_id long, place int, hash long, hash2 long"), "windows")
    least = materialise(windows.groupBy("hash", "hash2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash", "hash2", "lo"), "least")
    early = windows.join(least, ["hash", "hash2"]).where("lo < doc_id").select(*kind, "place").distinct()
    early = early.groupBy(*kind).agg(F.sum(F.expr("shiftleft(1L, place)")).alias("early"))
    decided = materialise(classes.select(*kind, F.col("doc_id").alias("first")).join(early, kind, "left"), "decided")
    full = F.expr("shiftleft(1L, len) - 1")
    masks = own.join(decided, kind).withColumn("mask", F.when(F.col("doc_id") > F.col("first"), full).otherwise(F.coalesce("early", F.lit(0))))
    return masks.where("mask <> 0").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "mask")).alias("runs"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row of docs.

    A word goes if a window of `window` words over it also starts in a document with a smaller doc_id.
    A null or empty text has no words; rows without a doc_id keep all theirs; rows that repeat a doc_id
    never shorten each other. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_tag().alias("tag"))
    runs = materialise(repeated_runs(rows, window, seed), "runs")
    return rows.join(runs, ["doc_id", "tag"], "left").select("doc_id", "text", "runs").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
