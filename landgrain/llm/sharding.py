"""Shards along a Hilbert curve over metadata, by DataFrame operations alone.

Several metadata dimensions are quantised, a row's cell becomes its index along the Hilbert curve, rows are
sorted by that index, and the sorted run is cut into shards of equal counts (law `rows`: at most one apart).
Neighbouring files hold neighbouring cells, so a reader with a predicate on any of the dimensions skips most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, materialise, table, text_tag

SHARDS, BITS = 8, 5


def size_of(text: Column | str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long") + 1


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Position along the Hilbert curve of a cell with coordinates 0 to 2^bits - 1.

    The coordinates are reflected and exchanged bit by bit, from the highest, then Gray-coded; the index reads
    their bits in turn, highest first.
    """
    n = len(axes)
    x = F.array(*[a.cast("long") for a in axes])
    # one step for every bit and axis: where the axis has the bit, flip the lower bits of the first axis, else swap them with it
    steps = F.array(*[F.struct(F.lit((1 << b) - 1).cast("long").alias("low"), F.lit(b).alias("bit"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def one(x: Column, s: Column) -> Column:
        first, own = x[0], F.element_at(x, s["i"] + 1)
        has = own.bitwiseAND(s["low"] + 1) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(s["low"])
        return F.transform(x, lambda v, j: F.when(has, F.when(j == 0, v.bitwiseXOR(s["low"])).otherwise(v)).when((j == 0) | (j == s["i"]), v.bitwiseXOR(F.when(s["i"] == 0, F.lit(0).cast("long")).otherwise(swap))).otherwise(v))

    turned = F.aggregate(steps, x, one)
    # Gray code across the axes, then the parity of the last axis's higher bits on all
    gray = F.aggregate(F.sequence(F.lit(2), F.lit(n)), F.slice(turned, 1, 1), lambda g, i: F.array_append(g, F.element_at(g, -1).bitwiseXOR(F.element_at(turned, i)))) if n > 1 else turned
    last = lambda g: F.element_at(g, -1)
    parity = lambda g: F.aggregate(F.sequence(F.lit(1), F.lit(bits - 1)), F.lit(0).cast("long"), lambda t, b: F.when(F.call_function("getbit", last(g), b) == 1, t.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1)).otherwise(t))
    mixed = F.element_at(F.transform(F.array(gray), lambda g: F.element_at(F.transform(F.array(parity(g)), lambda t: F.transform(g, lambda v: v.bitwiseXOR(t))), 1)), 1)
    order = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(i + 1).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.element_at(F.transform(F.array(mixed), lambda g: F.aggregate(order, F.lit(0).cast("long"), lambda h, s: h * 2 + F.call_function("getbit", F.element_at(g, s["i"]), s["bit"]))), 1)


def cells(docs: DataFrame, bits: int = BITS) -> list[Column]:
    """Quantised dimensions: the logarithm of the size, the language and the source (their hashes' bits; null has its own).

    Only a row's own values decide, so a row keeps its cell whatever else the table holds.
    """
    top = (1 << bits) - 1
    size = F.least(F.lit(top), F.floor(F.log2(size_of()) * top / 24)).cast("long")
    name = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("\x00")).cast("binary")), F.lit(top + 1))
    return [size, *(name(c) if c in docs.columns else F.lit(0).cast("long") for c in ("lang", "source"))]


def place_rows(rows: DataFrame, *order: str, shards: int = SHARDS) -> DataFrame:
    """rows with `shard` and `slot`: sorted by `order`, cut into runs whose counts are at most one apart.

    Written once in that order; a row's place is its partition's offset plus its place in the partition.
    Nothing but a count for each partition is gathered. The names at, part, before, whole and place are taken.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "curve")
    counts = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # a row for each partition that Spark made of the sort: as few as its tasks
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("whole"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    small, more = F.expr(f"whole div {shards}"), F.col("whole") % shards
    cut = (small + 1) * more
    index = F.when(F.col("place") < cut, F.floor(F.col("place") / (small + 1))).otherwise(more + F.floor((F.col("place") - cut) / F.greatest(small, F.lit(1))))
    start = F.col("shard") * small + F.least(F.col("shard").cast("long"), more)
    placed = ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part").withColumn("place", place).withColumn("shard", index.cast("int"))
    return placed.withColumn("slot", F.col("place") - start).drop("at", "part", "before", "whole", "place")


#: Along the curve, then by the text's hash, so that equal texts of a cell are neighbours, then by doc_id
ORDER = ("hilbert", "tie", "doc_id")


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """docs with `hilbert`, `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard), columns of these names replaced.

    The first `rows mod shards` shards hold one row more. Equal cells are ordered by text hash and doc_id, so equal
    texts of one cell are neighbours; rows equal in all of these are interchangeable. Null and empty texts have size 1, nulls of
    the other dimensions a cell of their own. A table with fewer rows than shards leaves the last shards empty, an empty one all.
    """
    own = docs.drop("hilbert", "shard", "slot")
    keyed = boxed(own, hilbert=hilbert_index(cells(own, bits), bits), tie=text_tag(), doc_id=F.col("doc_id"))
    return place_rows(keyed, *ORDER, shards=shards).select("row.*", "hilbert", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 32) -> None:
    """shard(docs) as Parquet folders, one a shard, each in about `files` files of consecutive slots.

    A file is a run of the curve, so that its statistics bound every dimension and a reader skips most files.
    """
    placed = shard(docs, shards)
    placed.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard() of whole documents by the law `rows`; the text itself need not travel: its size, checksum and hash stand for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").cast("string").alias("text"))
    keyed = docs.select("doc_id", hilbert_index(cells(docs), BITS).alias("hilbert"), text_tag().alias("tie"), size_of().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return place_rows(keyed, *ORDER).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
