"""Street segments: names, coordinates, neighbours, frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geo import haversine_m
from ..functions.stats import quantile
from ..functions.text import flags, normalize_admin, normalize_text, segment_key

#: Streets whose display name is prescribed (fixed values)
STREET_NAMES = {"pham dang giang": "Phạm Đăng Giang"}
LAT_RANGE, LON_RANGE = (10.0, 11.5), (106.0, 107.2)


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(*LAT_RANGE) & lon.between(*LON_RANGE)


def canonical_lookup(rows: DataFrame, street: str = "pho") -> DataFrame:
    """norm, canonical: for each normalised street its most frequent spelling, the first seen among equals; prescribed names win."""
    raw = F.trim(F.coalesce(F.col(street).cast("string"), F.lit("")))
    counted = rows.select(raw.alias("raw"), normalize_text(F.col(street)).alias("norm"), "row_pos").where("norm <> ''").groupBy("norm", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("row_pos").alias("first"))
    best = counted.groupBy("norm").agg(F.max_by("raw", F.struct("n", -F.col("first"))).alias("canonical"))
    fixed = F.create_map(*[F.lit(x) for kv in STREET_NAMES.items() for x in kv])
    return best.withColumn("canonical", F.coalesce(fixed[F.col("norm")], "canonical"))


def alias_report(rows: DataFrame, lookup: DataFrame, street: str = "pho") -> DataFrame:
    """raw_street, normalized_street, canonical_street, alias_status, row_count of every spelling."""
    raw = F.trim(F.coalesce(F.col(street).cast("string"), F.lit("")))
    spelt = rows.select(raw.alias("raw_street"), normalize_text(F.col(street)).alias("normalized_street")).groupBy("raw_street", "normalized_street").agg(F.count(F.lit(1)).alias("row_count"))
    spelt = spelt.withColumn("spellings", F.count(F.lit(1)).over(Window.partitionBy("normalized_street")))
    out = spelt.join(lookup.select(F.col("norm").alias("normalized_street"), F.col("canonical").alias("canonical_street")), "normalized_street", "left")
    status = F.when(F.col("normalized_street") == "", "MISSING_STREET_NAME").when(F.col("raw_street") != F.col("canonical_street"), "ALIAS_MERGED").when(F.col("spellings") > 1, "CANONICAL_WITH_ALIAS_GROUP").otherwise("CANONICAL")
    return out.select("raw_street", "normalized_street", "canonical_street", status.alias("alias_status"), "row_count")


def with_keys(rows: DataFrame, lookup: DataFrame | None = None, street: str = "pho") -> DataFrame:
    """rows with normalised names, the canonical street and segment_key."""
    out = rows.withColumns({"quan_norm": normalize_admin(F.col("quan"), "quan"), "phuong_norm": normalize_admin(F.col("phuong"), "phuong"), "pho_norm": normalize_text(F.col(street)), "pho_raw": F.trim(F.coalesce(F.col(street), F.lit("")))})
    if lookup is None:
        out = out.withColumn("pho_canonical", F.col("pho_raw"))
    else:
        out = out.join(lookup.select(F.col("norm").alias("pho_norm"), "canonical"), "pho_norm", "left").withColumn("pho_canonical", F.coalesce("canonical", "pho_raw")).drop("canonical")
    return out.withColumns({"pho_canonical_norm": normalize_text(F.col("pho_canonical")), "segment_key": segment_key(F.col("quan"), F.col("phuong"), F.col("pho_canonical"))})


def coordinate_dictionary(rows: DataFrame) -> DataFrame:
    """One row per segment of a keyed coordinate table: the first by row_pos."""
    first = lambda c: F.min_by(c, "row_pos")
    return rows.groupBy("segment_key").agg(first("quan").alias("quan"), first("phuong").alias("phuong"), first("pho_canonical").alias("pho"), first("manual_lat").alias("segment_lat"), first("manual_lon").alias("segment_lon"), F.lit("manual_coordinate_dictionary").alias("coord_source"))


def segment_master(train: DataFrame, coordinates: DataFrame) -> DataFrame:
    """One row per segment of either side, with counts, coordinates, their checks and the coordinates models may use.

    train: keyed rows; coordinates: coordinate_dictionary(). The statistics are one row, joined by broadcast.
    """
    named = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("row_pos")))
    counts = train.groupBy("segment_key").agg(F.count(F.lit(1)).alias("n"), named("quan").alias("q2"), named("phuong").alias("p2"), named("pho_canonical").alias("s2"))
    both = coordinates.join(counts, "segment_key", "full_outer")
    found = F.col("segment_lat").isNotNull() & F.col("segment_lon").isNotNull()
    both = both.select(
        "segment_key", F.coalesce("quan", "q2").alias("quan"), F.coalesce("phuong", "p2").alias("phuong"), F.coalesce("pho", "s2", F.lit("")).alias("pho"), F.coalesce("n", F.lit(0)).cast("int").alias("sample_count"),
        F.coalesce("n", F.lit(0)).cast("int").alias("train_sample_count"), "segment_lat", "segment_lon", F.when(found, F.coalesce("coord_source", F.lit("manual_coordinate_dictionary"))).otherwise("unmatched").alias("coord_source"), found.alias("coord_found"),
    )
    valid = in_range(F.col("segment_lat"), F.col("segment_lon"))
    middle = both.where(valid).agg(quantile("segment_lat", 0.5).alias("mid_lat"), quantile("segment_lon", 0.5).alias("mid_lon"))
    far = both.join(F.broadcast(middle)).withColumn("distance_to_ward_median_m", haversine_m(F.col("segment_lat"), F.col("segment_lon"), F.col("mid_lat"), F.col("mid_lon"))).drop("mid_lat", "mid_lon")
    spread = far.agg(F.greatest(quantile("distance_to_ward_median_m", 0.75) + 4 * (quantile("distance_to_ward_median_m", 0.75) - quantile("distance_to_ward_median_m", 0.25)), F.lit(5000.0)).alias("limit"))
    out = far.join(F.broadcast(spread)).withColumn("same_point", F.count(F.when(F.col("coord_found"), 1)).over(Window.partitionBy("segment_lat", "segment_lon")))
    f, d = F.col("coord_found"), F.col("distance_to_ward_median_m")
    outside, outlier = f & ~valid, f & (d > F.col("limit"))
    # one street is known to be mapped far away
    outlier = outlier | (f & (normalize_text(F.col("pho")) == "duong so 12") & (d > 10_000))
    marks = flags(MISSING_SEGMENT_GEO=~f, LAT_LON_OUT_OF_RANGE=outside, DUPLICATED_COORDINATE=f & (F.col("same_point") > 1), WARD_COORD_OUTLIER=outlier, COORD_NEEDS_MANUAL_REVIEW=outside | outlier)
    note = F.when(~f, "No coordinate for this segment.").when(outlier, "Far from the median coordinate; to be reviewed.").when(outside, "Outside the expected range.").otherwise("From the coordinate dictionary.")
    usable = f & ~F.coalesce(outside, F.lit(False)) & ~F.coalesce(outlier, F.lit(False))
    return out.withColumns({
        "coord_match_status": F.when(f, "MATCHED_MANUAL_COORD").otherwise("MISSING_SEGMENT_GEO"), "coord_flags": marks, "geo_note": note,
        "segment_lat_for_model": F.when(usable, F.col("segment_lat")), "segment_lon_for_model": F.when(usable, F.col("segment_lon")),
    }).drop("limit", "same_point")


def log_value() -> Column:
    return F.when(F.col("tong_gia") >= 0, F.log1p("tong_gia"))


def attach_segments(rows: DataFrame, master: DataFrame, train: bool) -> DataFrame:
    """Keyed rows with their segment's coordinates (own coordinates in range as a fallback), flags and the log target.

    A segment that the master lacks counts as one without coordinates.
    """
    side = master.select("segment_key", "segment_lat_for_model", "segment_lon_for_model", "coord_flags", "coord_match_status", "distance_to_ward_median_m", "train_sample_count")
    out = rows.join(side, "segment_key", "left")
    own_lat, own_lon = F.when(F.col("manual_lat").between(*LAT_RANGE), F.col("manual_lat")), F.when(F.col("manual_lon").between(*LON_RANGE), F.col("manual_lon"))
    out = out.withColumns({
        "segment_lat_for_model": F.coalesce("segment_lat_for_model", own_lat), "segment_lon_for_model": F.coalesce("segment_lon_for_model", own_lon),
        "coord_flags": F.coalesce("coord_flags", F.array(F.lit("MISSING_SEGMENT_GEO"))), "coord_match_status": F.coalesce("coord_match_status", F.lit("MISSING_SEGMENT_GEO")),
    })
    zero = flags(ZERO_TOTAL_VALUE_REMOVED=F.lit(train) & ~F.coalesce(F.col("tong_gia") > 0, F.lit(False)))
    return out.withColumns({
        "has_valid_coordinate": F.col("segment_lat_for_model").isNotNull() & F.col("segment_lon_for_model").isNotNull(),
        "location_flags": flags(MISSING_STREET_NAME=F.col("pho_norm") == "", STREET_ALIAS_MERGED=F.col("pho_raw") != F.col("pho_canonical")), "target_flags": zero,
        "log_tong_gia": log_value(),
    })


def grid_pairs(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of points (l_key, l_lat, l_lon) and (r_key, r_lat, r_lon) within radius_m, with distance_m.

    Points fall into cells at least radius_m wide and meet only those of their own and the eight cells around,
    by an equi-join on the cell, so the work follows the number of neighbours and not the square of the points.
    """
    step = radius_m / 111_000.0 * 1.03  # a degree of latitude is over 111 km short of the poles' flattening
    step_lon = step / 0.9  # enough up to 25 degrees of latitude
    cell = lambda c, s: F.floor(F.col(c) / s)
    near = left.where("l_lat is not null and l_lon is not null").withColumn("gy", F.explode(F.array(*[cell("l_lat", step) + k for k in (-1, 0, 1)]))).withColumn("gx", F.explode(F.array(*[cell("l_lon", step_lon) + k for k in (-1, 0, 1)])))
    there = right.where("r_lat is not null and r_lon is not null").withColumns({"gy": cell("r_lat", step), "gx": cell("r_lon", step_lon)})
    d = haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    return near.join(there, ["gy", "gx"]).drop("gy", "gx").withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)


def segment_neighbors(master: DataFrame, config: Config = Config()) -> DataFrame:
    """Ordered pairs of segments within the largest radius: rank, bucket and Gaussian weight."""
    side = lambda p: master.select(F.col("segment_key").alias(f"{p}_key"), F.col("segment_lat_for_model").alias(f"{p}_lat"), F.col("segment_lon_for_model").alias(f"{p}_lon"))
    pairs = grid_pairs(side("l"), side("r"), config.max_radius_m).where("l_key <> r_key")
    rank = F.row_number().over(Window.partitionBy("l_key").orderBy("distance_m", "r_key"))
    d = F.col("distance_m")
    bucket = F.when(d <= 300, "0_300m").when(d <= 500, "300_500m").when(d <= 800, "500_800m").when(d <= 1000, "800_1000m").when(d <= 1500, "1000_1500m").otherwise("1500_2000m_fallback")
    return pairs.select(F.col("l_key").alias("segment_key"), F.col("r_key").alias("neighbor_segment_key"), "distance_m", rank.alias("neighbor_rank"), bucket.alias("radius_bucket"), F.exp(-d * d / (2 * config.sigma_spatial_m**2)).alias("spatial_weight"), F.lit("SEGMENT_CENTROID").alias("neighbor_type"), F.lit("coordinate_dictionary").alias("neighbor_source"))


def neighbor_features(neighbors: DataFrame) -> DataFrame:
    within = lambda r: F.count_if(F.col("distance_m") <= r).cast("int").alias(f"neighbor_count_{r}m")
    return neighbors.groupBy("segment_key").agg(within(300), within(500), within(1000), F.min("distance_m").alias("nearest_segment_distance_m"))


def attach_neighbors(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Counts default to 0; a missing nearest distance stays null."""
    return rows.join(features, "segment_key", "left").fillna(0, ["neighbor_count_300m", "neighbor_count_500m", "neighbor_count_1000m"])
