"""Benchmark decontamination with a distributed positional inverted index.

The index is document-partitioned: a row of the index table is a segment of documents (about
SEGMENT bytes of text) with, for every term in them, the ascending positions at which it occurs. A position
counts the words of a segment; documents are GAP positions apart, so that no match crosses them. It holds all terms,
is written once, and answers any number of benchmarks or blocks of one.

A phrase is answered segment by segment, rarest term first: the postings of the window's rarest term there, less
the term's offset, are the candidate starts, and each further list, adjusted by its own offset, is
intersected with what is left. A proximity match asks that all terms of a window, in any order, lie within SPAN
consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, boxed, materialise, slices, table, text_tag

WINDOW, SPAN, GAP = 10, 20, 64
SEGMENT = 2 << 20
#: Text bytes of the items that are sent to the index together: their windows are what is broadcast, under 100 MB
BLOCK_BYTES = 2 << 20

#: A-Z to a-z; other ASCII but digits and letters to a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text, A-Z lower-cased; none of null."""
    return (text or b"").translate(_FOLD).split()


class Queries:
    """The windows of a block of items: term numbers, a row for each window, filled up with -1."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW) -> None:
        vocabulary: dict[bytes, int] = {}
        number = vocabulary.setdefault
        exact: dict[tuple[int, ...], set] = {}
        near: dict[tuple[int, ...], set] = {}
        for item, text in items:
            t = [number(w, len(vocabulary)) for w in terms(None if text is None else text.encode())]
            if not t:
                continue
            for i in range(max(1, len(t) - window + 1)):
                exact.setdefault(tuple(t[i : i + window]), set()).add(item)
                near.setdefault(tuple(sorted(set(t[i : i + window]))), set()).add(item)
        self.vocabulary = list(vocabulary)
        self.exact, self.near = self._rows(exact, window), self._rows(near, window)

    @staticmethod
    def _rows(windows: dict[tuple[int, ...], set], window: int) -> tuple[np.ndarray, list[list[int]]]:
        rows = np.full((len(windows), window), -1, np.int32)
        for row, k in zip(rows, windows, strict=True):
            row[: len(k)] = k
        return rows, [sorted(i for i in v if i is not None) for v in windows.values()]


def _u4(a: np.ndarray) -> bytes:
    return a.astype("<u4").tobytes()


def _index(segment: int):
    """Segments: documents' ids, tags, keys and word counts; terms; list lengths and gaps between positions, 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", segment, 1 << 14):
            folded = pa.array([(t or b"").translate(_FOLD) for t in as_bytes(b.column("text"))], pa.large_binary()).cast(pa.large_string())
            split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(folded))
            words = split.flatten()
            filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # an empty text is split to one empty word
            n = np.diff(np.concatenate([[0], np.cumsum(filled)])[split.offsets.to_numpy()])
            numbered = words.filter(pa.array(filled)).dictionary_encode()
            term = numbered.indices.to_numpy()
            starts = np.cumsum(n + GAP) - n - GAP
            position = np.arange(len(term)) + np.repeat(starts - (np.cumsum(n) - n), n)
            many = np.bincount(term, minlength=len(numbered.dictionary))
            p = position[np.argsort(term, kind="stable")]
            first = (np.cumsum(many) - many)[many > 0]
            gaps = np.diff(p, prepend=0)
            gaps[first] = p[first]
            one = lambda c: pa.array([b.column(c).to_pylist()], pa.list_(pa.int64()))
            own = pa.ListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary.cast(pa.binary()))
            yield pa.record_batch([one("doc_id"), one("tag"), one("key"), pa.array([n.tolist()], pa.list_(pa.int64())), own, pa.array([_u4(many)], pa.binary()), pa.array([_u4(gaps)], pa.binary())], names=["ids", "tags", "keys", "counts", "terms", "lengths", "gaps"])

    return run


class Segment:
    """Postings of one row of the index, decoded; terms are numbered as in a vocabulary."""

    def __init__(self, terms: pa.Array, lengths: bytes, gaps: bytes, vocabulary: pa.Array) -> None:
        n, g = (np.frombuffer(x, "<u4").astype(np.int64) for x in (lengths, gaps))
        total = np.cumsum(g)
        ends = np.cumsum(n)
        starts = ends - n
        before = np.where(starts > 0, total[np.maximum(starts - 1, 0)], 0) if len(total) else starts
        self.positions = total - np.repeat(before, n)
        place = pc.fill_null(pc.index_in(vocabulary, value_set=terms), -1).to_numpy().astype(np.int64)
        here = place >= 0
        self.start, self.end = np.zeros(len(vocabulary) + 1, np.int64), np.zeros(len(vocabulary) + 1, np.int64)
        self.start[:-1][here], self.end[:-1][here] = starts[place[here]], ends[place[here]]

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.start[term] : self.end[term]]

    def rarest_first(self, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The windows whose terms all occur here: row, and its columns by falling rarity."""
        many = (self.end - self.start)[windows]  # -1 is the entry beyond the vocabulary
        filled = windows >= 0
        alive = np.flatnonzero(((many > 0) | ~filled).all(1))
        order = np.argsort(np.where(filled[alive], many[alive], 1 << 60), axis=1, kind="stable")
        for w, o, k in zip(alive.tolist(), order, filled[alive].sum(1).tolist(), strict=True):
            yield w, o[:k]

    def phrase(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of a phrase whose terms come rarest first."""
        at = self.postings(terms[0]) - offsets[0]
        for t, o in zip(terms[1:], offsets[1:], strict=True):
            if not len(at):
                break
            p = self.postings(t)
            i = np.searchsorted(p, at + o)
            at = at[p[np.minimum(i, len(p) - 1)] == at + o]
        return at

    def together(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Occurrences of the first term that lie with all others in `span` consecutive words."""
        at = self.postings(terms[0])
        for t in terms[1:]:  # all others near
            if not len(at):
                return at
            p = self.postings(t)
            i = np.searchsorted(p, at - span + 1)
            at = at[(i < len(p)) & (p[np.minimum(i, len(p) - 1)] < at + span)]
        starts = at[:, None] - np.arange(span)
        found = np.ones(starts.shape, bool)
        for t in terms[1:]:  # and all in one place
            p = self.postings(t)
            i = np.searchsorted(p, starts)
            found &= (i < len(p)) & (p[np.minimum(i, len(p) - 1)] < starts + span)
        return at[found.any(1)]


def _match(shared, every: bool):
    """Per document: words, merged spans of exact matches [a, b), items matched exactly, items near; without `every`, only of documents with any."""
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        vocabulary = pa.array(queries.vocabulary, pa.binary())
        for b in batches:
            column = dict(zip(b.schema.names, b.columns, strict=True))
            for r in range(b.num_rows):
                s = Segment(column["terms"].slice(r, 1).flatten(), column["lengths"][r].as_py(), column["gaps"][r].as_py(), vocabulary)
                n = np.array(column["counts"][r].as_py(), np.int64)
                starts = np.cumsum(n + GAP) - n - GAP
                edges = np.zeros(int(n.sum()) + GAP * len(n) + 1, np.int32)
                items: dict[int, set] = {}
                near: dict[int, set] = {}

                def name(at: np.ndarray, whose: list[int], found: dict[int, set]) -> None:
                    for d in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
                        found.setdefault(d, set()).update(whose)

                windows, whose = queries.exact
                for w, o in s.rarest_first(windows):
                    if len(at := s.phrase(windows[w][o], o)):
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + len(o), -1)
                        name(at, whose[w], items)
                windows, whose = queries.near
                for w, o in s.rarest_first(windows):
                    if len(at := s.together(windows[w][o], SPAN)):
                        name(at, whose[w], near)
                flips = np.flatnonzero(np.diff(np.cumsum(edges) > 0, prepend=False))
                spans: dict[int, list] = {}
                for a, z in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True):
                    d = int(np.searchsorted(starts, a, "right")) - 1
                    spans.setdefault(d, []).append({"a": a - int(starts[d]), "b": z - int(starts[d])})
                k = list(range(len(n))) if every else sorted({*spans, *items, *near})
                of = lambda c: column[c].slice(r, 1).flatten().take(pa.array(k, pa.int64()))  # noqa: E731, B023
                yield pa.record_batch(
                    [of("ids"), of("tags"), of("keys"), of("counts"), pa.array([spans.get(d, []) for d in k], pa.list_(span)), pa.array([sorted(items.get(d, ())) for d in k], pa.list_(pa.int64())), pa.array([sorted(near.get(d, set()) - items.get(d, set())) for d in k], pa.list_(pa.int64()))],
                    names=["doc_id", "tag", "key", "n_words", "spans", "items", "near"],
                )

    return run


def build_index(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The positional index of docs (doc_id, text), written to the shared folder; a row of docs has one key in it."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_tag().alias("tag"), F.monotonically_increasing_id().alias("key"))
    fields = "ids array<long>, tags array<long>, keys array<long>, counts array<long>, terms array<binary>, lengths binary, gaps binary"
    return materialise(rows.mapInArrow(_index(segment), fields), "index")


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list]:
    """The items in runs of about `size` text bytes; an item beyond that is a run of its own; at least one run."""
    some, held, any_ = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        n = len((r[1] or "").encode())
        if some and held + n > size:
            yield some
            some, held, any_ = [], 0, True
        some.append((r[0], r[1]))
        held += n
    if some or not any_:
        yield some


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, tag, n_words, spans (merged, in words), items (exact), near (items by proximity only) per row of the indexed table."""
    spark = index.sparkSession
    parts = []
    for items in _blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(Queries(items, window))
        parts.append(index.mapInArrow(_match(shared, not parts), "doc_id long, tag long, key long, n_words long, spans array<struct<a:long,b:long>>, items array<long>, near array<long>"))
    if len(parts) == 1:
        return parts[0].drop("key")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    merged = every.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("tag").alias("tag"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return merged.withColumn("spans", F.expr(_MERGE)).withColumn("near", F.array_sort(F.array_except("near", "items"))).drop("key")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_BYTES) -> DataFrame:
    """search() in an index of docs.

    Null and empty texts have no words, items without words no windows; a null item_id takes part without being
    named. Repeated rows of docs each have their row, repeated items are found alike. An empty table of documents gives no
    rows, an empty benchmark no matches. A text of any length is one segment. Other columns of docs are not read.
    """
    return search(build_index(docs), benchmark, window, block)


#: Sorted spans into disjoint ones
_MERGE = """aggregate(spans, cast(array() as array<struct<a:bigint,b:bigint>>), (m, s) ->
  if(size(m) = 0 or s.a > element_at(m, -1).b, array_append(m, s),
     array_append(slice(m, 1, size(m) - 1), named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, s.b)))))"""


def proximity(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The counts and the digests of matches(), exact and near, per row of docs."""
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ","), 256)
    return matches(docs, benchmark).select(
        "doc_id", "tag", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        digest("items").alias("items_sha256"), F.size("near").cast("long").alias("n_near_items"), digest("near").alias("near_items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """proximity() without the digest of the near items."""
    return proximity(docs, benchmark).drop("near_items_sha256")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an exact match, with docs' own columns; repeated rows stay or go together."""
    hit = materialise(scan(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("tag").alias("hit_tag")).distinct(), "contaminated")
    own = boxed(docs, doc_id=F.col("doc_id").cast("long"), tag=text_tag())
    return own.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("tag") == F.col("hit_tag")), "left_anti").select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tag", "n_near_items")


def op8_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_decontaminate, which its SQL fixes, and those of the proximity matches."""
    return proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tag")


#: The same by joining the ten-word windows of both sides; without the proximity matches.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, p.n AS n, s FROM p JOIN i USING (x)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
