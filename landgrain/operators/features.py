"""Engineered features and segment price statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clip, clip01, quantile


def frequencies(train: DataFrame) -> DataFrame:
    """level, key, n: rows of train by street segment, ward and district, from one scan."""
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(c).alias("key")) for k, c in (("segment", "segment_key"), ("phuong", "phuong_norm"), ("quan", "quan_norm"))]))
    return train.select(levels.alias("x")).select("x.*").groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"))


def engineer(rows: DataFrame, freq: DataFrame, rare_street: int = 15, rare_ward: int = 10) -> DataFrame:
    """Logs, ratios, access band and score, counts and rarity."""
    of = lambda level, key, name: freq.where(F.col("level") == level).select(F.col("key").alias(key), F.col("n").alias(name))
    out = rows.join(of("segment", "segment_key", "pho_count_train"), "segment_key", "left").join(of("phuong", "phuong_norm", "phuong_count_train"), "phuong_norm", "left").fillna(0, ["pho_count_train", "phuong_count_train"])
    lt, alley, dist = F.col("lt_chuan"), F.col("do_rong_ngo_nho_nhat_m"), F.col("khoang_cach_den_duong_chinh_m")
    band = F.when((lt >= 4) | ((alley >= 8) & (dist <= 60)), "mat_tien").when((lt >= 3) | (alley >= 6) | (dist <= 30), "hem_lon").when((lt >= 2) | (alley >= 4), "hem_trung_binh").otherwise("hem_nho_sau")
    score = clip01(0.5 * (F.coalesce(lt, F.lit(1.0)) - 1) / 3 + 0.3 * clip01(F.coalesce(alley, F.lit(0.0)) / 8) + 0.2 * (1 - clip01(F.coalesce(dist, F.lit(300.0)) / 250)))
    depth = F.when(F.col("chieu_dai_m") != 0, F.col("chieu_dai_m"))
    return out.withColumns({
        "log_dien_tich": F.log1p(clip(F.col("dien_tich_m2"), 0.0)), "log_khoang_cach": F.log1p(clip(dist, 0.0)), "log_do_rong_ngo": F.log1p(clip(alley, 0.0)),
        "ti_le_mat_tien": F.col("mat_tien_m") / depth, "mat_tien_x_so_mat_tien": F.col("mat_tien_m") * F.col("so_mat_tien_tiep_giap"), "ngo_x_lt": alley * lt,
        "access_band": band, "access_score": score, "pho_rare": (F.col("pho_count_train") < rare_street).cast("int"), "phuong_rare": (F.col("phuong_count_train") < rare_ward).cast("int"),
    })


PENALTIES = {"STABLE_SEGMENT": 1.0, "HETEROGENEOUS_MEDIUM": 0.88, "HETEROGENEOUS_HIGH": 0.75, "LOW_SAMPLE_SEGMENT": 0.82}
HETEROGENEITY = ("segment_sample_count_train", "segment_price_cv", "segment_price_iqr_ratio", "segment_heterogeneity_score", "segment_heterogeneity_penalty")


def unit_price(clean: DataFrame) -> DataFrame:
    """clean with unit_price: the given one, or total by area where the table has none at all."""
    any_given = clean.agg(F.max(F.col("don_gia").isNotNull()).alias("given"))
    area = F.when(F.col("dien_tich_m2") != 0, F.col("dien_tich_m2"))
    return clean.join(F.broadcast(any_given)).withColumn("unit_price", F.when(F.coalesce("given", F.lit(False)), F.col("don_gia")).otherwise(F.col("tong_gia") / area)).drop("given")


def heterogeneity(clean: DataFrame) -> DataFrame:
    """Per segment: unit price statistics, dispersion score, flag and penalty."""
    p = unit_price(clean)
    s = p.groupBy("segment_key").agg(F.count(F.lit(1)).alias("segment_sample_count_train"), F.avg("unit_price").alias("mean"), quantile("unit_price", 0.5).alias("median"), F.stddev_samp("unit_price").alias("std"), quantile("unit_price", 0.25).alias("p25"), quantile("unit_price", 0.75).alias("p75"), F.min("phuong_norm").alias("phuong_norm"), F.min("quan_norm").alias("quan_norm"))
    over = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(1e-6)))
    s = s.withColumns({"segment_price_cv": F.col("std") / over("mean"), "segment_price_iqr_ratio": (F.col("p75") - F.col("p25")) / over("median")})
    enough = F.col("segment_sample_count_train") >= 3
    of = lambda c, q: quantile(F.when(enough, F.col(c)), q)
    cuts = s.agg(of("segment_price_cv", 0.75).alias("a"), of("segment_price_cv", 0.90).alias("b"), of("segment_price_iqr_ratio", 0.75).alias("c"), of("segment_price_iqr_ratio", 0.90).alias("d"))
    cuts = cuts.select(F.coalesce("a", F.lit(0.25)).alias("cv75"), F.coalesce("b", F.greatest(F.coalesce("a", F.lit(0.25)), F.lit(0.35))).alias("cv90"), F.coalesce("c", F.lit(0.35)).alias("iqr75"), F.coalesce("d", F.greatest(F.coalesce("c", F.lit(0.35)), F.lit(0.5))).alias("iqr90"))
    s = s.join(F.broadcast(cuts))
    cv, iqr = F.col("segment_price_cv"), F.col("segment_price_iqr_ratio")
    score = clip(0.6 * F.coalesce(cv, "cv75") / F.greatest("cv90", F.lit(1e-6)) + 0.4 * F.coalesce(iqr, "iqr75") / F.greatest("iqr90", F.lit(1e-6)), 0.0, 2.0)
    flag = F.when(~enough, "LOW_SAMPLE_SEGMENT").when((cv > F.col("cv90")) | (iqr > F.col("iqr90")), "HETEROGENEOUS_HIGH").when((cv > F.col("cv75")) | (iqr > F.col("iqr75")), "HETEROGENEOUS_MEDIUM").otherwise("STABLE_SEGMENT")
    penalty = F.coalesce(F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])[F.col("segment_heterogeneity_flag")], F.lit(0.85))
    return s.withColumns({"segment_heterogeneity_score": score, "segment_heterogeneity_flag": flag}).withColumn("segment_heterogeneity_penalty", penalty)


def heterogeneity_templates(table: DataFrame) -> DataFrame:
    """level, key and the measures for wards and districts (means, most frequent flag) and for all segments (medians)."""
    wide = table.withColumns({"segment_price_cv": F.coalesce("segment_price_cv", "cv75"), "segment_price_iqr_ratio": F.coalesce("segment_price_iqr_ratio", "iqr75")})
    most = F.mode("segment_heterogeneity_flag", True).alias("segment_heterogeneity_flag")
    out = None
    for level, key in (("phuong", "phuong_norm"), ("quan", "quan_norm")):
        one = table.groupBy(F.col(key).alias("key")).agg(*[F.avg(c).alias(c) for c in HETEROGENEITY], most).select(F.lit(level).alias("level"), "*")
        out = one if out is None else out.unionByName(one)
    every = wide.agg(*[quantile(F.col(c).cast("double"), 0.5).alias(c) for c in HETEROGENEITY], most).select(F.lit("global").alias("level"), F.lit("").alias("key"), "*")
    return out.unionByName(every)


def attach_heterogeneity(rows: DataFrame, table: DataFrame, templates: DataFrame) -> DataFrame:
    """Each row's measures from its segment, else its ward, its district, or all; with the source."""
    cols = [*HETEROGENEITY, "segment_heterogeneity_flag"]
    out = rows.join(table.select(F.col("segment_key"), F.struct(*cols).alias("s")), "segment_key", "left")
    for p, level, key in (("w", "phuong", "phuong_norm"), ("d", "quan", "quan_norm")):
        out = out.join(templates.where(F.col("level") == level).select(F.col("key").alias(key), F.struct(*cols).alias(p)), key, "left")
    out = out.join(F.broadcast(templates.where("level = 'global'").select(F.struct(*cols).alias("g"))), how="left")
    source = F.when(F.col("s").isNotNull(), "SEGMENT_LOOKUP").when(F.col("w").isNotNull(), "PHUONG_TEMPLATE").when(F.col("d").isNotNull(), "QUAN_TEMPLATE").otherwise("GLOBAL_TEMPLATE")
    return out.withColumn("segment_heterogeneity_source", source).withColumns({c: F.coalesce(f"s.{c}", f"w.{c}", f"d.{c}", f"g.{c}") for c in cols}).drop("s", "w", "d", "g")


def segment_band(clean: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per segment: quartiles of total value, its most frequent cluster with that cluster's quartiles, and a confidence."""
    qs = lambda p: [quantile("tong_gia", q).alias(f"{p}_p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    seg = clean.groupBy("segment_key").agg(F.count(F.lit(1)).alias("segment_value_count"), *qs("segment_value"), F.mode(cluster, True).alias("dominant_cluster"))
    groups = clean.groupBy(F.col(cluster).alias("dominant_cluster")).agg(*qs("cluster_value"))
    width = (F.col("segment_value_p75") - F.col("segment_value_p25")) / F.greatest("segment_value_p50", F.lit(1.0))
    confidence = clip01(0.6 * clip01(F.col("segment_value_count") / 10) + 0.4 * clip01(1 - width))
    return seg.join(groups, "dominant_cluster", "left").withColumn("segment_band_confidence", confidence)
