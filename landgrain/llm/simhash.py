"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into a block of 31 and one of 33. Two fingerprints at distance 4 or less
differ in at most 2 bits of the first block or at most 1 of the second. The anchors of a block
are the words of a perfect Hamming code of length 31 (the two further bits of the second block
are kept as they are), so every block value has a *home* anchor within the covering radius 1.
A fingerprint is replicated to every anchor within covering radius plus threshold (1 + 2, 1 + 1);
the home anchor of one of a linked pair is therefore always among the replicas of the other, and
comparing homes with replicas anchor by anchor loses no link.

Equal fingerprints are one vertex, so exact copies never meet as pairs. Before anchors are compared,
clusters of many near fingerprints shrink to one label each: fingerprints are sorted within equal parts
of their bits, and neighbours in such an order are linked if they are near. A dense cluster thus costs as
many chain links as it has members, and the anchors add only links between different clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, boxed, materialise, slices, text_tag

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: (first bit, code bits, further bits, threshold of the block)
BLOCKS = ((0, 31, 0, 2), (31, 31, 2, 1))
RADIUS = 1
#: (first bit, bits) that neighbours of a chain have in common
CHAINS = ((0, 31), (31, 33), (0, 16), (16, 16), (32, 16), (48, 16))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text; 0 where it has no words."""
    words = text.lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    if n == 1:
        hashes = [digest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, np.uint64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        fps = [fingerprint(x or b"") for x in as_bytes(b.column("text"))]
        yield pa.record_batch([b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), b.column("tag")], names=["doc_id", "fp", "tag"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64 bits), tag of the text, of every row; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_tag().alias("tag")).mapInArrow(_fingerprints, "doc_id long, fp long, tag long")


def _patterns(code: int, further: int, within: int) -> list[tuple[int, int]]:
    """(syndrome, error pattern) of all patterns of so many bits at most."""
    out = []
    for k in range(within + 1):
        for bits in combinations(range(code + further), k):
            syndrome = 0
            for b in bits:
                if b < code:
                    syndrome ^= b + 1
            out.append((syndrome, sum(1 << b for b in bits)))
    return out


def _syndrome(block: Column, code: int) -> Column:
    """Position (from 1) of the bit that leads to the nearest code word; 0 for a code word."""
    s = F.lit(0)
    for j in range(code.bit_length()):
        mask = sum(1 << b for b in range(code) if (b + 1) >> j & 1)
        s = s + (F.bit_count(block.bitwiseAND(F.lit(mask))) % 2) * (1 << j)
    return s.cast("int")


def chains(fps: DataFrame) -> DataFrame:
    """a, b: from the first fingerprint of every run of near neighbours in the orders of CHAINS to each other one of the run.

    As many as orders times fingerprints at most. A run is a star and not a path, so that its label needs no rounds of jumps.
    """
    masks = [((1 << bits) - 1) << first for first, bits in CHAINS]
    masks = [m - ((m >> 63) << 64) for m in masks]
    orders = F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("same"), F.col("fp").bitwiseAND(F.lit(~m)).alias("rest")) for n, m in enumerate(masks)])
    order = Window.partitionBy("o.n", "o.same").orderBy("o.rest")
    rows = fps.select("fp", F.explode(orders).alias("o"))
    near = F.coalesce(F.bit_count(F.col("fp").bitwiseXOR(F.lag("fp").over(order))) <= THRESHOLD, F.lit(False))
    runs = rows.withColumn("start", F.when(~near, F.col("fp")))
    head = F.last("start", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return runs.select(head.alias("a"), F.col("fp").alias("b")).where("a <> b")


def links(fps: DataFrame) -> DataFrame:
    """a, b: labels of different clusters with a pair of fingerprints at THRESHOLD bits or fewer. fps: distinct `fp`, its cluster `c`.

    Rows grow as a constant (174) times the number of different fingerprints; the join on the anchor
    can be split by Spark where an anchor is hot, and no replica goes into it that meets its own cluster only.
    """
    spark = fps.sparkSession
    homes, replicas = [], []
    for n, (first, code, further, near) in enumerate(BLOCKS):
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << (code + further)) - 1))
        # a fixed table: 4,992 patterns for the first block, 562 for the second
        patterns = spark.createDataFrame(_patterns(code, further, RADIUS + near), "s int, e long")
        at = fps.select("fp", "c", value.alias("v"), _syndrome(value, code).alias("s"))
        tag = F.lit(n << 40)
        home = F.col("v").bitwiseXOR(F.when(F.col("s") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, s - 1)")))
        homes.append(at.select((home + tag).alias("anchor"), F.col("fp").alias("x"), F.col("c").alias("cx")))
        replicas.append(at.join(F.broadcast(patterns), "s").select((F.col("v").bitwiseXOR(F.col("e")) + tag).alias("anchor"), F.col("fp").alias("y"), F.col("c").alias("cy")))
    # either of a pair is a replica at the other's home, so one direction will do; replicas go on only where an
    # anchor is the home of a smaller cluster: a dense cluster does not meet itself
    home = materialise(homes[0].unionAll(homes[1]), "homes")
    held = materialise(home.groupBy("anchor").agg(F.min("cx").alias("lo")), "anchors")
    others = replicas[0].unionAll(replicas[1]).join(held, "anchor").where("lo < cy").select("anchor", "y", "cy")
    others = materialise(others, "replicas")
    near = (F.col("cx") < F.col("cy")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= THRESHOLD)
    return home.join(others, "anchor").where(near).select(F.col("cx").alias("a"), F.col("cy").alias("b")).distinct()


def clusters(fps: DataFrame) -> DataFrame:
    """fp, root: the least fingerprint reachable by links, for every one of the distinct `fp`."""
    chained = components(chains(fps)).withColumnRenamed("v", "fp")
    named = materialise(fps.join(chained, "fp", "left").select("fp", F.coalesce("root", "fp").alias("c")), "chained")
    joined = components(links(named)).withColumnRenamed("v", "c")
    return named.join(joined, "c", "left").select("fp", F.coalesce("root", "c").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex reachable, for every vertex of edges (a, b).

    Minimum labels with pointer jumping; each round is written out, so the plan stays short and a lost
    executor repeats one round at most. Nothing but the count of changes comes to the driver.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # edges are computed once
    both = materialise(edges.select(F.explode(ways).alias("e")).select("e.*"), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        lower = labels.join(seen, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("further"))
        stepped = materialise(lower.join(jump, "root").select("v", "old", F.least("root", "further").alias("root")), "labels")
        labels = stepped.select("v", "root")
        if stepped.where("root <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id, n_copies for every row of docs.

    component_id is the smallest doc_id reachable by links, the row's own included. Rows without a
    doc_id get a fingerprint and belong to components, but never name one (null where no other does).
    Repeated rows are vertices like others. An empty table gives no rows.
    """
    return _grouped(docs).select("doc_id", "fp", "component_id", "n_copies")


def _grouped(docs: DataFrame) -> DataFrame:
    """The columns of near_duplicates(), the text's tag, and root: the component, as components can share a smallest doc_id."""
    rows = materialise(fingerprints(docs), "fingerprints")
    named = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies")), "vertices")
    inside = materialise(named.join(clusters(named.select("fp")), "fp"), "clusters")
    # written first: Spark splits a hot root only where both sides are shuffled for the join itself
    least = materialise(inside.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return rows.join(inside.join(least, "root").select("fp", "root", "component_id", "n_copies"), "fp")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of every component, with docs' own columns.

    Where a component has several texts of that doc_id, the one with the smallest tag stays; a doc_id that is the smallest
    of several components stays in each. Copies in doc_id and text stay once; rows without a doc_id all stay.
    """
    found = _grouped(docs).where("doc_id = component_id").groupBy("root", F.col("doc_id").alias("least_id")).agg(F.min("tag").alias("least_tag"))
    keep = materialise(found.select("least_id", "least_tag").distinct(), "kept")
    own = boxed(docs, doc_id=F.col("doc_id").cast("long"), tag=text_tag())
    kept = own.join(keep, (F.col("doc_id") == F.col("least_id")) & (F.col("tag") == F.col("least_tag")))
    return kept.dropDuplicates(["doc_id", "tag"]).unionByName(own.where("doc_id is null"), True).select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")
