"""The comparable search over all pairs of a pool, as a plain reference: filters, scores, best pairs and bands as windows over the pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landgrain.config import Config
from landgrain.functions.geo import haversine_m
from landgrain.functions.stats import clip, clip01, weighted_quantiles
from landgrain.functions.text import flags
from landgrain.operators.clusters import distance
from landgrain.operators.comparables import SOURCE_SCORE, WEIGHTS


def cascade(pairs: DataFrame, config: Config = Config()) -> DataFrame:
    """The pairs that the filters leave, and the query's area, relaxations in `cascade_flags`.

    Purpose, class, access band and area (20, 35, 50 %): a filter holds only where enough of a query's pairs pass.
    """
    w = Window.partitionBy("q_row_id")
    least = max(3, config.min_comparables - 1)
    alive, out, relaxed = F.lit(True), pairs, {}
    for i, (column, needed, name) in enumerate((("muc_dich_su_dung_dat", least, "PURPOSE_MATCH_RELAXED"), ("phan_loai_kho", least, "PROPERTY_TYPE_RELAXED"), ("access_band", max(3, config.min_comparables - 2), "ACCESS_MATCH_RELAXED"))):
        same = F.coalesce(F.col(f"q_{column}") == F.col(f"c_{column}"), F.lit(False))
        out = out.withColumn(f"__k{i}", F.count_if(alive & same).over(w) >= needed)
        out = out.withColumn(f"__a{i}", alive & (~F.col(f"__k{i}") | same))
        alive, relaxed[name] = F.col(f"__a{i}"), ~F.col(f"__k{i}")
    # whether a filter holds is one decision for a query: pairs can go before the next window
    out = out.where(alive)
    own = F.when((F.col("q_dien_tich_m2") > 0) & ~F.isnan("q_dien_tich_m2"), F.col("q_dien_tich_m2"))
    out = out.withColumn("q_area", F.coalesce(own, F.percentile("c_dien_tich_m2", F.lit(0.5)).over(w)))
    near = lambda share: F.coalesce(F.col("c_dien_tich_m2").between(F.col("q_area") * (1 - share), F.col("q_area") * (1 + share)), F.lit(False))
    out = out.withColumns({f"__n{int(s * 100)}": F.count_if(near(s)).over(w) >= 3 for s in (0.2, 0.35, 0.5)})
    keep = F.when(F.col("__n20"), near(0.2)).when(F.col("__n35"), near(0.35)).when(F.col("__n50"), near(0.5)).otherwise(True)
    relaxed["AREA_MATCH_RELAXED"] = ~F.col("__n20") & F.col("__n35")
    relaxed["AREA_MATCH_STRONGLY_RELAXED"] = ~F.col("__n20") & ~F.col("__n35") & F.col("__n50")
    return out.withColumn("cascade_flags", flags(**relaxed)).where(keep).drop("__k0", "__k1", "__k2", "__a0", "__a1", "__a2", "__n20", "__n35", "__n50")


def score(pairs: DataFrame, config: Config = Config()) -> DataFrame:
    """Similarities, source, reliability, score and band weight of every pair."""
    w = Window.partitionBy("q_row_id")
    q, c = (lambda x: F.col(f"q_{x}")), (lambda x: F.col(f"c_{x}"))
    out = pairs
    for name, column in (("front", "mat_tien_m"), ("deep", "chieu_dai_m")):
        own = F.when(q(column) > 0, q(column))
        middle = F.percentile(c(column), F.lit(0.5)).over(w)
        out = out.withColumn(f"q_{name}", F.coalesce(own, F.when(middle > 0, middle), F.lit(1.0)))
    ratio = lambda column, of, floor: F.abs(F.log((c(column) + 1e-6) / (F.greatest(of, F.lit(1e-6)) if floor else of + 1e-6)))
    same = lambda x: F.coalesce(q(x) == c(x), F.lit(False))
    km = F.coalesce(haversine_m(q("segment_lat_for_model"), q("segment_lon_for_model"), c("segment_lat_for_model"), c("segment_lon_for_model")), F.when(same("segment_key"), F.lit(0.0)))
    out = out.withColumns({
        "distance_m": km, "same_cluster": same("cluster").cast("int"), "same_access_band": same("access_band").cast("int"), "same_segment": same("segment_key").cast("int"),
        "feature_similarity": 1 / (1 + distance(q("core"), c("core"))), "access_similarity": 1 / (1 + distance(q("access"), c("access"))), "__area": ratio("dien_tich_m2", F.col("q_area"), True),
        "__front": F.exp(-ratio("mat_tien_m", F.col("q_front"), False)), "__depth": F.exp(-ratio("chieu_dai_m", F.col("q_deep"), False)), "__gap": F.abs(F.coalesce(c("special_asset_score"), F.lit(0.0)) - F.coalesce(q("special_asset_score"), F.lit(0.0))),
        "location_similarity": F.when(same("segment_key") & (q("segment_key") != ""), 1.0).when(same("pho_canonical_norm") & (q("pho_canonical_norm") != ""), 0.9).when(same("phuong_norm"), 0.6).when(same("quan_norm"), 0.4).otherwise(0.2),
    })
    out = out.withColumns({
        "area_similarity": F.exp(-F.col("__area")), "spatial_similarity": F.coalesce(F.exp(-F.col("distance_m") / config.sigma_spatial_m), F.lit(0.0)),
        "comparable_source": F.when((F.col("same_segment") == 1) & (q("segment_key") != ""), "same_segment").when(F.col("distance_m") <= 1000, "nearby_segment").when(F.col("same_cluster") == 1, "same_cluster").when(same("phuong_norm"), "same_phuong").otherwise("fallback"),
    })
    source = F.create_map(*[F.lit(x) for kv in SOURCE_SCORE.items() for x in kv])[F.col("comparable_source")]
    access = F.when(F.col("same_access_band") == 1, 1.0).otherwise(0.7)
    reliability = 0.30 * clip(F.coalesce(c("pho_count_train"), F.lit(0)) / 10, 0.3, 1.0) + 0.25 * source + 0.25 * clip(F.coalesce(c("cluster_confidence"), F.lit(0.3)), 0.2, 1.0) + 0.20 * access
    out = out.withColumn("candidate_reliability", clip01(reliability * F.coalesce(c("segment_heterogeneity_penalty"), F.lit(0.85)) * (1 - 0.08 * clip01(F.coalesce(c("special_asset_score"), F.lit(0.0))))))
    part = {"access": F.col("access_similarity"), "feature": F.col("feature_similarity"), "frontage": F.coalesce("__front", F.lit(0.0)), "area": F.coalesce("area_similarity", F.lit(0.0)), "depth": F.coalesce("__depth", F.lit(0.0)), "reliability": F.col("candidate_reliability"), "location": F.col("location_similarity"), "spatial": F.col("spatial_similarity"), "cluster": F.col("same_cluster")}
    total: Callable[[str], Column] = lambda k: sum((w * part[x] for x, w in WEIGHTS[k].items()), F.lit(0.0))
    base = F.when(F.col("comparable_source") == "same_segment", total("same_segment")).when(F.col("comparable_source") == "nearby_segment", total("nearby_segment")).otherwise(total("other"))
    mismatch = 1 - F.col("same_access_band")
    off = 0.06 * F.coalesce(clip01(F.col("distance_m") / 2000), F.lit(1.0)) + 0.05 * F.coalesce(clip01(F.col("__area")), F.lit(1.0)) + 0.04 * clip01(F.col("__gap")) + 0.04 * mismatch
    off = off + 0.04 * F.when(F.coalesce(q("segment_heterogeneity_flag") == "HETEROGENEOUS_HIGH", F.lit(False)), mismatch).otherwise(0)
    out = out.withColumn("similarity_score", base - off)
    return out.withColumn("band_weight", F.greatest("similarity_score", F.lit(0.0)) * (0.55 + 0.45 * F.col("candidate_reliability"))).drop("__area", "__front", "__depth", "__gap", "q_front", "q_deep")


def top(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """The best pairs of each query: score, then distance, then the candidate's id."""
    order = Window.partitionBy("q_row_id").orderBy(F.col("similarity_score").desc(), F.col("distance_m").asc_nulls_last(), "c_row_id")
    return scored.withColumn("comparable_rank", F.row_number().over(order)).where(F.col("comparable_rank") <= config.top_k)


def band_pool(scored: DataFrame, config: Config = Config()) -> DataFrame:
    order = Window.partitionBy("q_row_id").orderBy(F.col("band_weight").desc(), F.col("distance_m").asc_nulls_last(), "c_row_id")
    return scored.withColumn("band_rank", F.row_number().over(order)).where(F.col("band_rank") <= max(config.top_k, config.band_top_k))


def summary(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per query: weighted quartiles of value, ratios, confidences and flags over the band pool."""
    band = band_pool(scored, config)
    n = F.count(F.lit(1))
    share = lambda c: F.avg(c.cast("double"))
    s = band.groupBy("q_row_id").agg(
        n.cast("int").alias("n"), F.first("used_radius").alias("max_search_radius_m"), share(F.col("same_cluster")).alias("same_cluster_ratio"), share(F.col("same_access_band")).alias("access_band_match_ratio"),
        share(F.coalesce(F.col("c_special_asset_score") >= 0.45, F.lit(False))).alias("special_comparable_ratio"), F.avg("candidate_reliability").alias("mean_candidate_reliability"), share(F.col("same_segment")).alias("same_segment_ratio"),
        share(F.coalesce(F.col("c_segment_heterogeneity_flag").isin("HETEROGENEOUS_MEDIUM", "HETEROGENEOUS_HIGH"), F.lit(False))).alias("heterogeneous_comparable_ratio"), F.avg(F.greatest("similarity_score", F.lit(0.0))).alias("strength"),
        F.first("cascade_flags").alias("cascade_flags"), F.first("pool_source").alias("pool_source"), F.first("near_segments").alias("near_segments"), F.first("near_inside").alias("near_inside"),
    )
    s = s.join(weighted_quantiles(band, ["q_row_id"], "c_tong_gia", "band_weight", {"total_value_band_p25": 0.25, "total_value_band_median": 0.5, "total_value_band_p75": 0.75}, "c_row_id"), "q_row_id", "left")
    full = F.least(F.lit(1.0), F.col("n") / config.band_top_k)
    width = (F.col("total_value_band_p75") - F.col("total_value_band_p25")) / F.greatest("total_value_band_median", F.lit(1.0))
    s = s.withColumn("weighted_band_width_ratio", width).withColumns({
        "comparable_count": F.least(F.col("n"), F.lit(config.top_k)),
        "comparable_confidence": clip01(0.45 * full + 0.35 * F.col("strength") + 0.20 * (1 - F.least(F.lit(1.0), F.col("max_search_radius_m") / config.max_radius_m))),
        "band_confidence": clip01(0.35 * full + 0.25 * F.col("mean_candidate_reliability") + 0.20 * F.col("access_band_match_ratio") + 0.10 * F.col("strength") + 0.10 * (1 - F.least(F.lit(1.0), F.coalesce("weighted_band_width_ratio", F.lit(1.0))))),
    })
    far, served = F.col("near_inside") == 0, F.col("pool_source").isin("segment", "near")
    first = flags(FAR_FROM_KNOWN_SEGMENTS=far, OUT_OF_TRAIN_AREA=far, FALLBACK_RADIUS_USED=served & (F.col("max_search_radius_m") > 1000), LOW_NEIGHBOR_COUNT=F.col("near_segments") < config.min_comparables, MISSING_SEGMENT_GEO=F.col("pool_source") == "all", LOW_CONFIDENCE_PREDICTION=~served)
    last = flags(LOW_COMPARABLE_COUNT=F.col("comparable_count") < config.min_comparables, ACCESS_MISMATCH_POOL=F.col("access_band_match_ratio") < 0.5, ACCESS_CONTEXT_WEAK=F.col("access_band_match_ratio") < 0.4, HETEROGENEOUS_COMPARABLE_POOL=F.col("heterogeneous_comparable_ratio") > 0.6, WIDE_PRICE_BAND=F.col("weighted_band_width_ratio") > 1.2)
    return s.withColumn("comparable_flags", F.concat(first, "cascade_flags", last)).drop("cascade_flags", "n", "strength", "pool_source", "near_segments", "near_inside").withColumnRenamed("q_row_id", "row_id")
