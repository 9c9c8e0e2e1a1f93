"""Representation of rows to appraise: known segments, new segments with a coordinate, and the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geo import EARTH_M, haversine_m
from ..functions.text import flags
from ..sources.staging import staged
from .clusters import assign


def segment_embedding(train: DataFrame, spectral: list[str]) -> DataFrame:
    """Per train segment: names, model coordinates, mean coordinates of the embedding, commonest cluster, rows."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("row_pos"))).alias(c)
    return train.groupBy("segment_key").agg(*[first(c) for c in ("quan_norm", "phuong_norm", "pho_canonical", "segment_lat_for_model", "segment_lon_for_model")], F.count(F.lit(1)).alias("train_sample_count"), *[F.avg(c).alias(c) for c in dict.fromkeys((*spectral, "cluster_confidence", "distance_to_cluster_center", "local_embedding_density"))], F.mode("cluster", True).alias("cluster")).withColumn("segment_found_in_train", F.lit(True))


def location_templates(embedding: DataFrame, columns: list[str]) -> DataFrame:
    """level, key and means of columns over segments: by ward, by district, and over all."""
    out = None
    for level, key in (("phuong", F.col("phuong_norm")), ("quan", F.col("quan_norm")), ("global", F.lit(""))):
        one = embedding.groupBy(key.alias("key")).agg(*[F.avg(c).alias(c) for c in columns], F.mode("cluster", True).alias("cluster")).select(F.lit(level).alias("level"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _cells(rows: DataFrame, lat: str, lon: str, width_m: float) -> DataFrame:
    """rows with the cube (cx, cy, cz) of space, width_m wide, that holds their point of the sphere."""
    y, x = F.radians(lat), F.radians(lon)
    xyz = {"cx": F.cos(y) * F.cos(x), "cy": F.cos(y) * F.sin(x), "cz": F.sin(y)}
    return rows.withColumns({k: F.floor(v * EARTH_M / width_m) for k, v in xyz.items()})


def _within(places: DataFrame, seg: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of a place and a segment at most radius_m apart: points meet those of their own and the 26 cubes around."""
    around = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    p = _cells(places, "segment_lat_for_model", "segment_lon_for_model", radius_m).withColumn("o", F.explode(around))
    p = p.withColumns({"cx": F.col("cx") + F.col("o.x"), "cy": F.col("cy") + F.col("o.y"), "cz": F.col("cz") + F.col("o.z")}).drop("o")
    d = haversine_m(F.col("segment_lat_for_model"), F.col("segment_lon_for_model"), F.col("y"), F.col("x"))
    pairs = p.join(_cells(seg, "y", "x", radius_m), ["cx", "cy", "cz"]).withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)
    return pairs.select("segment_lat_for_model", "segment_lon_for_model", "near_key", "distance_m")


def nearest_segments(rows: DataFrame, embedding: DataFrame, config: Config = Config()) -> DataFrame:
    """For new segments with a coordinate (row_id, segment_lat_for_model, segment_lon_for_model): the train segments used.

    The radius is the first of the ladder with enough segments, else the largest; where even that is empty the nearest
    top_k stand in. Places meet segments by equi-joins on cells. Only places with an empty ladder look further, in cells
    four times as wide each time, until they have top_k segments or the cells span the earth.
    """
    place = ["segment_lat_for_model", "segment_lon_for_model"]
    seg = embedding.where("segment_lat_for_model is not null and segment_lon_for_model is not null").select(F.col("segment_key").alias("near_key"), F.col("segment_lat_for_model").alias("y"), F.col("segment_lon_for_model").alias("x"))
    places = staged(rows.select(*place).where("segment_lat_for_model is not null and segment_lon_for_model is not null").distinct(), "places")  # rows of one place share their work
    last, w = config.max_radius_m, Window.partitionBy(*place)
    used = F.coalesce(*[F.when(F.count_if(F.col("distance_m") <= r).over(w) >= config.min_comparables, F.lit(r)) for r in config.radii_m], F.lit(last))
    near = staged(_within(places, seg, last).withColumn("used_radius_m", used).where("distance_m <= used_radius_m").withColumn("n_inside", F.count(F.lit(1)).over(w)), "near")
    rest, radius = places.join(near.select(*place).distinct(), place, "left_anti"), float(last)
    while radius < 4 * EARTH_M and not (rest := staged(rest, "far")).isEmpty():
        radius *= 4
        found = staged(_within(rest, seg, radius).withColumn("rank", F.row_number().over(w.orderBy("distance_m", "near_key"))).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("rank") <= config.top_k), "found")
        whole = found if radius >= 4 * EARTH_M else found.where(F.col("n") >= config.top_k)
        near = near.unionByName(whole.select(*place, "near_key", "distance_m", F.lit(last).alias("used_radius_m"), F.lit(0).cast("long").alias("n_inside")))
        rest = rest.join(whole.select(*place).distinct(), place, "left_anti")
    return near.withColumn("weight", F.exp(-F.col("distance_m") / config.sigma_spatial_m))


def predict_cluster(rows: DataFrame, centers: list[tuple[int, list[float]]], spectral: list[str]) -> DataFrame:
    """Represented rows with the cluster that their spectral coordinates are nearest to, its distance and confidence.

    The confidence of the location fallback is halved.
    """
    out = assign(rows.drop("assigned_cluster", "cluster_confidence", "cluster_center_distance_raw").withColumn("__v", F.array(*spectral)), centers, "__v").drop("__v")
    half = F.when(F.col("case_type").startswith("CASE_3"), 0.5).otherwise(1.0)
    return out.withColumns({"cluster": F.col("assigned_cluster"), "cluster_confidence": F.col("cluster_confidence") * half})


def represent(rows: DataFrame, embedding: DataFrame, neighbor_features: DataFrame, templates: DataFrame, columns: list[str], config: Config = Config()) -> DataFrame:
    """rows with case_type, the embedding columns, neighbour counts and flags, by the first case that applies."""
    known = embedding.select("segment_key", F.struct(*columns).alias("k1"))
    out = rows.join(known, "segment_key", "left").join(neighbor_features.select("segment_key", F.struct("neighbor_count_300m", "neighbor_count_500m", "neighbor_count_1000m", "nearest_segment_distance_m").alias("n1")), "segment_key", "left")
    place = ["segment_lat_for_model", "segment_lon_for_model"]
    new = out.where(F.col("k1").isNull() & F.col("has_valid_coordinate"))
    near = nearest_segments(new, embedding, config).join(embedding.select(F.col("segment_key").alias("near_key"), *columns), "near_key")
    mean = lambda c: (F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c)
    within = lambda r: F.count_if(F.col("distance_m") <= r).cast("int").alias(f"neighbor_count_{r}m")
    near = near.groupBy(*place).agg(F.struct(*[mean(c) for c in columns]).alias("k2"), F.struct(within(300), within(500), within(1000), F.min("distance_m").alias("nearest_segment_distance_m")).alias("n2"), F.first("used_radius_m").alias("used_radius_m"), F.first("n_inside").alias("n_inside"))
    out = out.join(near, place, "left")
    for p, level, key in (("w", "phuong", "phuong_norm"), ("d", "quan", "quan_norm")):
        out = out.join(templates.where(F.col("level") == level).select(F.col("key").alias(key), F.struct(*columns).alias(p)), key, "left")
    out = out.join(F.broadcast(templates.where("level = 'global'").select(F.struct(*columns).alias("g"))), how="left")
    one, two = F.col("k1").isNotNull(), F.col("k1").isNull() & F.col("k2").isNotNull() & F.col("has_valid_coordinate")
    three = ~one & ~two
    pick = lambda c: F.when(one, F.col(f"k1.{c}")).when(two, F.col(f"k2.{c}")).otherwise(F.coalesce(f"w.{c}", f"d.{c}", f"g.{c}"))
    count = lambda c: F.when(one, F.coalesce(f"n1.{c}", F.lit(0))).when(two, F.col(f"n2.{c}")).otherwise(0)
    confidence = pick("cluster_confidence") * F.when(three, 0.5).otherwise(1.0)
    return out.withColumns({
        "case_type": F.when(one, "CASE_1_SEGMENT_IN_TRAIN").when(two, "CASE_2_NEW_SEGMENT_WITH_COORD").otherwise("CASE_3_LOCATION_FALLBACK"),
        "assigned_cluster_method": F.when(one, "SEGMENT_LOOKUP").when(two, "KNN_WEIGHTED_SPATIAL").otherwise("LOCATION_FALLBACK"), "segment_found_in_train": one,
        **{c: pick(c) for c in columns if c != "cluster_confidence"}, "cluster_confidence": confidence, **{f"neighbor_count_{r}m": count(f"neighbor_count_{r}m") for r in (300, 500, 1000)},
        "nearest_segment_distance_m": F.when(one, F.col("n1.nearest_segment_distance_m")).when(two, F.col("n2.nearest_segment_distance_m")),
        "inference_flags": flags(FAR_FROM_KNOWN_SEGMENTS=two & (F.col("n_inside") == 0), OUT_OF_TRAIN_AREA=two & (F.col("n_inside") == 0), FALLBACK_RADIUS_USED=two & (F.col("used_radius_m") > 1000), LOW_NEIGHBOR_COUNT=two & (F.greatest("n_inside", F.when(F.col("n_inside") == 0, config.top_k)) < config.min_comparables), MISSING_SEGMENT_GEO=three, LOW_CONFIDENCE_PREDICTION=three),
    }).drop("k1", "k2", "n1", "n2", "w", "d", "g", "used_radius_m", "n_inside")
