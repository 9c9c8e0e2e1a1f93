"""Confidence, warnings, explanations and errors of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clip01
from ..functions.text import format_money, render_flags

WEIGHTS = {"geocode": 0.18, "location": 0.13, "neighbors": 0.12, "count": 0.18, "area": 0.09, "price": 0.10, "cluster": 0.10, "access": 0.08, "band": 0.08, "reliability": 0.07, "road": 0.10}
CASE_PENALTY = {"CASE_2_NEW_SEGMENT_WITH_COORD": 0.08, "CASE_3_LOCATION_FALLBACK": 0.18}
HETEROGENEITY_PENALTY = {"HETEROGENEOUS_HIGH": 0.10, "HETEROGENEOUS_MEDIUM": 0.05, "LOW_SAMPLE_SEGMENT": 0.06}
#: Any of the flags costs the amount, once
FLAG_PENALTIES = (
    (("WARD_COORD_OUTLIER", "MISSING_SEGMENT_GEO"), 0.15),
    (("LOW_COMPARABLE_COUNT",), 0.10),
    (("LOW_CONFIDENCE_PREDICTION",), 0.10),
    (("ACCESS_MISMATCH_POOL", "ACCESS_CONTEXT_WEAK"), 0.08),
    (("HETEROGENEOUS_COMPARABLE_POOL",), 0.06),
    (("WIDE_PRICE_BAND",), 0.06),
)


def _map(values: dict[str, float], key: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(0.0))


def add_confidence(rows: DataFrame, legacy_area_score: bool = True) -> DataFrame:
    """rows with warning_flags and confidence_score; missing columns count as their neutral values.

    legacy_area_score: only the milder of the two area relaxations costs anything.
    """
    num = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in rows.columns else F.lit(d)
    arr = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in rows.columns else F.array().cast("array<string>")
    has = lambda a, f: F.array_contains(a, f)
    base = F.concat(arr("coord_flags"), arr("location_flags"), arr("target_flags"), arr("inference_flags"))
    out = rows.withColumn("warning_flags", F.array_distinct(F.concat(base, arr("comparable_flags"))))
    loc, comp, w = arr("location_flags"), arr("comparable_flags"), F.col("warning_flags")
    relaxed = has(comp, "AREA_MATCH_RELAXED") if legacy_area_score else has(comp, "AREA_MATCH_RELAXED") | has(comp, "AREA_MATCH_STRONGLY_RELAXED")
    mid = F.col("total_value_band_median") if "total_value_band_median" in rows.columns else F.lit(None).cast("double")
    spread = F.when(mid.isNotNull(), (F.col("total_value_band_p75") - F.col("total_value_band_p25")) / F.greatest(mid, F.lit(1.0))) if "total_value_band_median" in rows.columns else mid
    part = {
        "geocode": F.when(F.size(arr("coord_flags")) == 0, 1.0).otherwise(0.25),
        "location": F.when(has(loc, "MISSING_STREET_NAME") & (F.size(loc) == 1), 0.2).when(has(loc, "STREET_ALIAS_MERGED"), 0.85).otherwise(1.0),
        "neighbors": F.least(F.lit(1.0), num("neighbor_count_1000m") / 8), "count": F.least(F.lit(1.0), num("comparable_count") / 5), "area": F.when(relaxed, 0.7).otherwise(1.0),
        "price": clip01(1 - F.coalesce(spread, F.lit(1.5))), "cluster": num("same_cluster_ratio"), "access": num("access_band_match_ratio"), "band": num("band_confidence"), "reliability": num("mean_candidate_reliability"), "road": num("road_evidence_confidence"),
    }
    total = sum((k * part[n] for n, k in WEIGHTS.items()), F.lit(0.0))
    case = F.col("case_type") if "case_type" in rows.columns else F.lit("")
    het = F.col("segment_heterogeneity_flag") if "segment_heterogeneity_flag" in rows.columns else F.lit("")
    off = _map(CASE_PENALTY, case) + _map(HETEROGENEITY_PENALTY, het) + 0.10 * num("special_asset_score")
    for names, amount in FLAG_PENALTIES:
        off = off + F.when(F.arrays_overlap(w, F.array(*[F.lit(n) for n in names])), amount).otherwise(0.0)
    return out.withColumn("confidence_score", clip01(total - off))


def confidence_group(score: Column) -> Column:
    return F.when(score.isNull() | F.isnan(score), "unknown").when(score >= 0.8, "high").when(score >= 0.6, "medium_high").when(score >= 0.4, "medium").otherwise("low")


BUCKETS = ((-0.001, 0.4, "low"), (0.4, 0.7, "medium"), (0.7, 1.0, "high"))


def confidence_bucket(score: Column) -> Column:
    """Open to the left, closed to the right."""
    out = None
    for low, high, name in BUCKETS:
        inside = (score > low) & (score <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def explain(rows: DataFrame) -> DataFrame:
    """rows with a one-line explanation."""
    two = lambda c: F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0)))
    parts = [
        F.coalesce(F.nullif("pho_canonical", F.lit("")), F.lit("Missing street")), F.coalesce("case_type", F.lit("UNKNOWN_CASE")),
        F.concat(F.lit("cluster "), F.coalesce(F.col("assigned_cluster").cast("string"), F.lit("-1")), F.lit(" by "), F.coalesce("assigned_cluster_method", F.lit("NA"))), F.concat(F.lit("access "), F.coalesce("access_band", F.lit("unknown"))),
        F.concat(F.lit("band P25/Med/P75 "), F.concat_ws("/", *[format_money(F.col(f"total_value_band_{x}")) for x in ("p25", "median", "p75")])),
        F.concat(F.coalesce(F.col("comparable_count").cast("string"), F.lit("0")), F.lit(" comparable(s) within "), F.coalesce(F.col("max_search_radius_m").cast("string"), F.lit("0")), F.lit("m")),
        F.concat(F.lit("band_conf "), two("band_confidence")), F.concat(F.lit("hetero "), F.coalesce("segment_heterogeneity_flag", F.lit("NA"))),
        F.concat(F.lit("special "), F.coalesce("special_asset_flag", F.lit("NA")), F.lit(" ("), two("special_asset_score"), F.lit(")")), F.concat(F.lit("confidence "), two("confidence_score")), F.concat(F.lit("warnings "), render_flags(F.col("warning_flags"))),
    ]
    return rows.withColumn("explanation_text", F.concat_ws(" | ", *parts))


def add_errors(rows: DataFrame, actual: str = "tong_gia", predicted: str = "predicted") -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    return rows.withColumns({"abs_error": F.abs(a - p), "ape": F.when(a > 0, F.abs(a - p) / a), "log_error": F.when((a > 0) & (p > 0), F.log(p) - F.log(a))})
