"""Cluster profiles, assignment to centres, special assets, sweep diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, clip01, quantile
from ..functions.text import flags


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def assign(rows: DataFrame, centers: list[tuple[int, list[float]]], vector: str = "vector") -> DataFrame:
    """rows with the nearest centre's id, the distance to it, and 1 less its ratio to the second nearest.

    centers are literals: as many as clusters.
    """
    table = F.array(*[F.struct(F.lit(k).alias("id"), F.array(*[F.lit(float(x)) for x in c]).alias("at")) for k, c in centers])
    ranked = F.array_sort(F.transform(table, lambda c: F.struct(distance(F.col(vector), c["at"]).alias("d"), c["id"].alias("id"))))
    out = rows.withColumn("__r", ranked).withColumns({"assigned_cluster": F.col("__r")[0]["id"], "cluster_center_distance_raw": F.col("__r")[0]["d"]})
    second = F.col("__r")[1]["d"] if len(centers) > 1 else F.lit(None).cast("double")
    return out.withColumn("cluster_confidence", clip01(1 - F.col("cluster_center_distance_raw") / F.greatest(second, F.lit(1e-6)))).drop("__r")


def normalise_distance(rows: DataFrame) -> DataFrame:
    """distance_to_cluster_center: by the upper quartile of the cluster's distances."""
    scale = rows.groupBy("assigned_cluster").agg(F.greatest(quantile("cluster_center_distance_raw", 0.75), F.lit(1e-6)).alias("scale"))
    return rows.join(F.broadcast(scale), "assigned_cluster").withColumn("distance_to_cluster_center", F.col("cluster_center_distance_raw") / F.col("scale")).drop("scale")


def profiles(train: DataFrame) -> DataFrame:
    """Per cluster: size, distance scale, mean confidence and quartiles of value, with those of all rows where it has none."""
    q = [(f"cluster_total_value_{n}", p) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]
    value = F.when(F.col("tong_gia") > 0, F.col("tong_gia"))
    own = train.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_sample_count"), F.greatest(quantile("cluster_center_distance_raw", 0.75), F.lit(1e-6)).alias("cluster_distance_scale"), F.avg("cluster_confidence").alias("cluster_mean_confidence"), *[quantile(value, p).alias(n) for n, p in q])
    every = train.agg(*[quantile(value, p).alias(f"all_{n}") for n, p in q])
    return own.join(F.broadcast(every)).withColumns({n: F.coalesce(n, f"all_{n}") for n, _ in q}).drop(*[f"all_{n}" for n, _ in q])


def attach_profiles(rows: DataFrame, table: DataFrame) -> DataFrame:
    out = rows.join(F.broadcast(table.withColumnRenamed("cluster", "__c")), F.col("assigned_cluster") == F.col("__c"), "left").drop("__c")
    return out.withColumns({"distance_to_cluster_center": F.col("cluster_center_distance_raw") / F.greatest(F.coalesce("cluster_distance_scale", F.lit(1.0)), F.lit(1e-6)), "cluster_sample_count": F.coalesce("cluster_sample_count", F.lit(0)).cast("int")})


#: Weights of the signals of a special asset
SIGNALS = {"confidence": 0.28, "distance": 0.22, "neighbors": 0.15, "rarity": 0.12, "density": 0.10, "heterogeneity": 0.08, "access": 0.13}


def special_assets(rows: DataFrame) -> DataFrame:
    """Score, class and reasons; columns that rows lacks count as their defaults."""
    col = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in rows.columns else F.lit(d)
    signal = {
        "confidence": 1 - clip01(col("cluster_confidence")), "distance": clip01(col("distance_to_cluster_center") / 1.5), "neighbors": 1 - clip01(col("neighbor_count_1000m") / 8),
        "rarity": clip01(0.6 * col("pho_rare") + 0.4 * col("phuong_rare")), "density": 1 - clip01(col("local_embedding_density")),
        "heterogeneity": clip(col("segment_heterogeneity_score"), 0.0, 1.5) / 1.5, "access": 1 - clip01(col("access_score", 0.5)),
    }
    score = clip01(sum((w * signal[k] for k, w in SIGNALS.items()), F.lit(0.0)))
    out = rows.withColumn("special_asset_score", score)
    s = F.col("special_asset_score")
    has = lambda c, d: F.col(c) if c in rows.columns else F.lit(d)
    reasons = flags(LOW_CLUSTER_CONFIDENCE=has("cluster_confidence", 1.0) < 0.35, CLUSTER_EDGE_POINT=has("distance_to_cluster_center", 0.0) > 1.15, LOW_LOCAL_DENSITY=has("local_embedding_density", 1.0) < 0.18, LOW_SPATIAL_NEIGHBOR_COUNT=has("neighbor_count_1000m", 0) <= 1, RARE_STREET_PATTERN=has("pho_rare", 0) == 1, HETEROGENEOUS_SEGMENT=has("segment_heterogeneity_flag", "") == "HETEROGENEOUS_HIGH")
    return out.withColumns({"special_asset_flag": F.when(s >= 0.70, "SPECIAL_HIGH").when(s >= 0.45, "SPECIAL_MEDIUM").otherwise("MAIN_MARKET"), "special_asset_reasons": reasons})


def segment_shares(rows: DataFrame) -> DataFrame:
    """Per cluster: the share of its rows that are of its commonest segment."""
    counts = rows.groupBy("cluster", "segment_key").agg(F.count(F.lit(1)).alias("k"))
    return counts.withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy("cluster"))).groupBy("cluster").agg(F.max("share").alias("dominant_segment_share"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """Per cluster: rows, median and median absolute deviation of log1p of the value, share of its commonest segment.

    price_ratio, of all clusters: the deviation of their medians against the mean deviation within, weighted by rows;
    price_score brings it into 0 to 1.
    """
    logs = rows.withColumn("__log", F.log1p("tong_gia"))
    m = logs.groupBy("cluster").agg(quantile("__log", 0.5).alias("median_log"), F.count(F.lit(1)).alias("n"))
    mad = logs.join(F.broadcast(m), "cluster").groupBy("cluster").agg(quantile(F.abs(F.col("__log") - F.col("median_log")), 0.5).alias("mad_log"))
    own = m.join(mad, "cluster")
    ratio = own.agg((F.stddev_pop("median_log") / F.greatest(F.sum(F.col("mad_log") * F.col("n")) / F.sum("n"), F.lit(1e-6))).alias("price_ratio"))
    return own.join(segment_shares(rows), "cluster").join(F.broadcast(ratio)).withColumn("price_score", F.tanh(F.col("price_ratio") / 2))
