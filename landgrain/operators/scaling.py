"""Median imputation and robust scaling with interpolated quartiles; location components of one-hot names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantile

CORE = ("log_dien_tich", "mat_tien_m", "chieu_dai_m", "so_mat_tien_tiep_giap", "chi_so_hinhdang", "chi_so_loithe", "ti_le_mat_tien", "mat_tien_x_so_mat_tien")
ACCESS = ("log_khoang_cach", "log_do_rong_ngo", "lt_chuan", "ngo_x_lt")


def fit_scaling(train: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: of each column the median (0 where it has none) and the scale: the quartile distance after imputation, 1 where that is 0."""
    medians = train.agg(*[F.coalesce(quantile(F.col(c).cast("double"), 0.5), F.lit(0.0)).alias(f"m_{c}") for c in columns])
    filled = train.join(F.broadcast(medians)).select(*[F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}")).alias(c) for c in columns])
    spread = filled.agg(*[(quantile(c, 0.75) - quantile(c, 0.25)).alias(f"s_{c}") for c in columns])
    return medians.join(F.broadcast(spread)).select(*[f"m_{c}" for c in columns], *[F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0).alias(f"s_{c}") for c in columns])


def scale(rows: DataFrame, fitted: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """rows with `name`: the scaled vector; missing values stand at the median, so at 0."""
    vector = F.array(*[(F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}")) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in columns])
    return rows.join(F.broadcast(fitted)).withColumn(name, vector).drop(*fitted.columns)


#: Components kept of each level
LEVELS = {"quan_norm": 2, "phuong_norm": 4, "pho_canonical_norm": 16}


def fit_location(train: DataFrame) -> DataFrame:
    """level, key, component, scale: the leading components of the one-hot matrix of each level.

    The columns of a one-hot matrix are orthogonal with squared lengths equal to the counts, so the j-th right singular
    vector is the j-th most frequent name's indicator. The quartile distance of an indicator is 0 or 1; 0 scales by 1.
    """
    out = None
    for level, most in LEVELS.items():
        counted = train.groupBy(F.col(level).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        ranked = counted.withColumn("component", F.row_number().over(Window.orderBy(F.col("n").desc(), "key"))).withColumn("names", F.count(F.lit(1)).over(Window.partitionBy())).withColumn("all", F.sum("n").over(Window.partitionBy()))
        # a level with one name is one column of zeros
        kept = ranked.where((F.col("names") > 1) & (F.col("component") <= F.least(F.lit(most), F.col("names") - 1, F.col("all") - 1)))
        # values are 0 and 1: the median is 1 if over half the rows have the name
        one = kept.select(F.lit(level).alias("level"), "key", "component", F.when(2 * F.col("n") > F.col("all"), 1.0).when(2 * F.col("n") == F.col("all"), 0.5).otherwise(0.0).alias("center"))
        out = one if out is None else out.unionByName(one)
    return out


def location_vector(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """rows with `location`: centred indicators of their names' components, level by level; unknown names are in none."""
    out = rows
    for level, most in LEVELS.items():
        one = fitted.where(F.col("level") == level)
        centers = one.agg(F.map_from_entries(F.collect_list(F.struct("component", "center"))).alias("__c"))  # `most` entries at most
        own = one.select(F.col("key").alias(level), F.col("component").alias("__k"))
        out = out.join(F.broadcast(own), level, "left").join(F.broadcast(centers))
        out = out.withColumn(f"__{level}", F.transform(F.sequence(F.lit(1), F.lit(most)), lambda j: F.coalesce((F.col("__k") == j).cast("double"), F.lit(0.0)) - F.coalesce(F.element_at("__c", j), F.lit(0.0)))).drop("__k", "__c")
    return out.withColumn("location", F.concat(*[F.col(f"__{level}") for level in LEVELS])).drop(*[f"__{level}" for level in LEVELS])
