"""Road evidence: roads around a property, clipped to a circle and matched by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geo import chord, mercator_x, mercator_y
from ..functions.stats import clip01
from ..functions.text import flags, normalize_text

#: Names under which inputs carry a road's name and id (fixed values)
NAME_COLUMNS, ID_COLUMNS = ("road_name", "name", "street", "full_name"), ("road_osm_id", "osmid", "osm_id", "id")


def text_of(df: DataFrame, column: str):
    """A value as text; lists become ' | ' joined, blanks and nulls ''."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("array"):
        items = F.filter(F.transform(F.col(column), lambda x: x.cast("string")), lambda x: x.isNotNull() & (F.trim(x) != ""))
        return F.coalesce(F.array_join(items, " | "), F.lit(""))
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def standardise(roads: DataFrame) -> DataFrame:
    """road_id, road_name, points (lon, lat): the first name and id column there is; roads of fewer than two points go."""
    pick = lambda names, other: next((text_of(roads, c) for c in names if c in roads.columns), other)
    return roads.select(pick(ID_COLUMNS, F.lit("")).alias("road_id"), pick(NAME_COLUMNS, F.lit("")).alias("road_name"), "points").where(F.size(F.coalesce("points", F.array().cast("array<struct<lon:double,lat:double>>"))) >= 2)


def evidence(inputs: DataFrame, roads: DataFrame, config: Config = Config(), true_metres: bool = False) -> DataFrame:
    """A row for each input and road within the buffer: clipped length, distance, match and whether it counts.

    inputs: row_id, pho_canonical, lat, lon. Road pieces fall into Mercator cells of the buffer's width and meet only inputs
    of the same or a neighbouring cell. true_metres corrects the projection's stretch at the input's latitude.
    """
    r = config.evidence_buffer_m
    at = inputs.where("lat is not null and lon is not null").select("row_id", F.col("pho_canonical").alias("input_street"), mercator_x(F.col("lon")).alias("px"), mercator_y(F.col("lat")).alias("py"), (F.cos(F.radians("lat")) if true_metres else F.lit(1.0)).alias("stretch"))
    xy = F.transform("points", lambda p: F.struct(mercator_x(p["lon"]).alias("x"), mercator_y(p["lat"]).alias("y")))
    pieces = roads.withColumn("xy", xy).select("road_id", "road_name", F.explode(F.zip_with(F.slice("xy", 1, F.size("xy") - 1), F.slice("xy", 2, F.size("xy") - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))).alias("s")).select("road_id", "road_name", "s.*")
    reach = 2 * r  # cells wide enough for the buffer in stretched metres
    cell = lambda c: F.floor(c / reach).cast("int")
    across = lambda a, b: F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b)))
    placed = pieces.withColumn("gx", F.explode(across(F.col("ax"), F.col("bx")))).withColumn("gy", F.explode(across(F.col("ay"), F.col("by"))))
    around = at.withColumn("gx", F.explode(F.array(*[cell(F.col("px")) + k for k in (-1, 0, 1)]))).withColumn("gy", F.explode(F.array(*[cell(F.col("py")) + k for k in (-1, 0, 1)])))
    met = around.join(placed, ["gx", "gy"]).dropDuplicates(["row_id", "road_id", "ax", "ay", "bx", "by"])
    inside, nearest = chord(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("px"), F.col("py"), r)
    met = met.withColumns({"inside": inside * F.col("stretch"), "near": nearest * F.col("stretch")})
    whole = met.groupBy("row_id", "road_id").agg(F.first("road_name").alias("road_name"), F.first("input_street").alias("input_street"), F.sum("inside").alias("clipped_length_m"), F.min("near").alias("distance_m")).where("clipped_length_m > 0")
    a, b, d = normalize_text(F.col("road_name")), normalize_text(F.col("input_street")), F.col("distance_m")
    named = (a != "") & (b != "")
    kind = F.when(named & (a == b), "NAME_EXACT").when(named & (a.contains(b) | b.contains(a)), "NAME_PARTIAL").when(d <= 15, "POINT_ON_ROAD").when(d <= 40, "ROAD_NEAR_NOTE").otherwise("NO_MATCH")
    out = whole.withColumn("match_type", kind)
    m = F.col("match_type")
    out = out.withColumn("match_confidence", F.when(m == "NAME_EXACT", 1.0).when(m == "NAME_PARTIAL", 0.85).when(m == "POINT_ON_ROAD", 0.8).when(m == "ROAD_NEAR_NOTE", 0.6).otherwise(0.0))
    matched, long = F.col("match_confidence") >= 0.6, F.col("clipped_length_m") > config.max_clipped_road_m
    return out.withColumns({"matched": matched, "included": matched & ~long, "exclusion_reason": F.when(long, "EXCLUDED_CLIPPED_ROAD_TOO_LONG").when(~matched, "NO_ROAD_NOTE_MATCH").otherwise("")})


def summarise(inputs: DataFrame, roads: DataFrame) -> DataFrame:
    """Per input: roads, included and excluded ones, mean confidence of the included, and the evidence's confidence."""
    s = roads.groupBy("row_id").agg(F.count(F.lit(1)).alias("road_count"), F.count_if("included").alias("included_roads"), F.count_if(~F.col("included")).alias("excluded_roads"), F.coalesce(F.avg(F.when(F.col("included"), F.col("match_confidence"))), F.lit(0.0)).alias("mean_match_confidence"), F.sum(F.when(F.col("included"), F.col("clipped_length_m")).otherwise(0.0)).alias("included_length_m"))
    inc, exc = F.col("included_roads"), F.col("excluded_roads")
    c = clip01(0.45 * F.least(F.lit(1.0), inc / 5) + 0.35 * F.col("mean_match_confidence") + 0.20 * (inc > 0).cast("double") - 0.10 * (exc > inc).cast("double"))
    out = inputs.select("row_id").join(s.withColumn("road_evidence_confidence", c), "row_id", "left").fillna(0, ["road_count", "included_roads", "excluded_roads"]).fillna(0.0, ["mean_match_confidence", "included_length_m", "road_evidence_confidence"])
    return out.withColumn("road_flags", flags(NO_ROAD_NOTE_MATCH=F.col("included_roads") == 0))
