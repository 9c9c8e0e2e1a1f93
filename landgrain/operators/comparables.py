"""Comparable search: pools by progressive radius, relaxing filters, similarity, top-k and weighted bands.

Radii and the filters on purpose, class and access band are decided at the grain of cells (segment, purpose, class, band),
where counts are few. Queries that draw from the same cells then meet those cells' candidates in one task, which finds the
area's bounds in sorted order, scores what is within and passes on one row a query: no pair is written.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geo import EARTH_M
from ..functions.stats import clip01
from ..functions.text import flags
from ..sources.staging import staged, staged_parts
from .inference import nearest_segments
from .segments import grid_pairs

#: Queries that meet their candidates in one task; pairs that it scores at a time
QUERIES, PAIRS = 8_192, 150_000
#: Rounds at most in which rows are shuffled, and the bundles that a round has at least; each round reads the rows again
ROUNDS, BUNDLES = 2, 8


def radius_table(embedding: DataFrame, config: Config = Config()) -> DataFrame:
    """segment_key, reach_key, distance_m: train segments within the largest radius, itself (0) always included."""
    side = lambda p: embedding.select(F.col("segment_key").alias(f"{p}_key"), F.col("segment_lat_for_model").alias(f"{p}_lat"), F.col("segment_lon_for_model").alias(f"{p}_lon"))
    others = grid_pairs(side("l"), side("r"), config.max_radius_m).where("l_key <> r_key").select(F.col("l_key").alias("segment_key"), F.col("r_key").alias("reach_key"), "distance_m")
    return others.unionByName(embedding.select("segment_key", F.col("segment_key").alias("reach_key"), F.lit(0.0).alias("distance_m")))


def search_radius(queries: DataFrame, reach: DataFrame, candidates: DataFrame, config: Config = Config(), exclude_self: bool = True) -> DataFrame:
    """queries with used_radius and n_pool: the first radius of 0 and the ladder with enough candidates, else the largest.

    A query that is itself a candidate needs one more where it is excluded. Counts are made at segment grain.
    """
    return _radius(queries.withColumn("itself", _itself(exclude_self)), reach, candidates.withColumn("n", F.lit(1)), config).drop("itself")


def _radius(queries: DataFrame, reach: DataFrame, counted: DataFrame, config: Config) -> DataFrame:
    """search_radius of queries with `itself`, among candidates or groups of `n` of them."""
    counts = counted.groupBy(F.col("segment_key").alias("reach_key")).agg(F.sum("n").alias("n"))
    ladder = (0, *config.radii_m)
    near = reach.join(counts, "reach_key").groupBy("segment_key").agg(*[F.coalesce(F.sum(F.when(F.col("distance_m") <= r, F.col("n"))), F.lit(0)).alias(f"n_{r}") for r in ladder])
    own, less = queries.join(near, "segment_key", "left"), F.col("itself")
    used = F.coalesce(*[F.when(F.col(f"n_{r}") - less >= config.min_comparables, F.lit(r)) for r in ladder], F.lit(config.max_radius_m))
    return own.withColumns({"used_radius": used, "n_pool": F.coalesce(*[F.when(used == r, F.col(f"n_{r}") - less) for r in ladder], F.lit(0))}).drop(*[f"n_{r}" for r in ladder])


def _itself(exclude_self: bool) -> Column:
    """1 where a query is a candidate that must be left out."""
    return F.when(F.coalesce(F.col("tong_gia") > 0, F.lit(False)) & F.lit(exclude_self), 1).otherwise(0)


#: What a query and a candidate bring to the comparison
CARRIED = ("segment_key", "phuong_norm", "quan_norm", "pho_canonical_norm", "muc_dich_su_dung_dat", "phan_loai_kho", "access_band", "dien_tich_m2", "mat_tien_m", "chieu_dai_m", "cluster", "core", "access", "segment_lat_for_model", "segment_lon_for_model", "special_asset_score", "segment_heterogeneity_flag")
PLACE = ["segment_lat_for_model", "segment_lon_for_model"]
#: Columns of the filters and the rows that each needs, less the least number of comparables
FILTERS = {"muc_dich_su_dung_dat": (1, "PURPOSE_MATCH_RELAXED"), "phan_loai_kho": (1, "PROPERTY_TYPE_RELAXED"), "access_band": (2, "ACCESS_MATCH_RELAXED")}


def _served(queries: DataFrame, counted: DataFrame, embedding: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries, which have `itself` (1 where they are candidates and must be left out), with the pool they draw from; reach; nearest segments.

    counted: candidates, or groups of `n` of them. Of what comes back, `itself` is 0 where the pool never holds the query.
    """
    reach, less = staged(radius_table(embedding, config), "reach"), F.col("itself")
    q = _radius(queries, reach, counted, config)
    for key, n in (("phuong_norm", "n_ward"), ("quan_norm", "n_district")):
        q = q.join(counted.groupBy(key).agg(F.sum("n").alias(n)), key, "left")
    q = q.join(embedding.select("segment_key", F.lit(True).alias("known")).distinct(), "segment_key", "left")
    rows_of = counted.groupBy(F.col("segment_key").alias("near_key")).agg(F.sum("n").alias("n"))
    nearest = nearest_segments(q.where("known is null and segment_lat_for_model is not null and segment_lon_for_model is not null"), embedding, config)
    served = nearest.join(rows_of, "near_key", "left").groupBy(*PLACE).agg(F.sum("n").alias("n_near"), F.count(F.lit(1)).alias("near_segments"), F.first("n_inside").alias("near_inside"), F.first("used_radius_m").alias("near_radius"))
    q = q.join(served, PLACE, "left").withColumn("near_segments", F.when(F.col("known").isNull(), F.col("near_segments")))
    source = F.when(F.col("n_pool") > 0, "segment").when(F.col("near_segments").isNotNull() & (F.col("n_near") > 0), "near").when(F.col("n_ward") > less, "ward").when(F.col("n_district") > less, "district").otherwise("all")
    q = q.withColumn("pool_source", source).withColumn("used_radius", F.when(F.col("pool_source") == "segment", F.col("used_radius")).when(F.col("pool_source") == "near", F.col("near_radius")).otherwise(config.max_radius_m))
    q = q.select(*queries.drop("itself").columns, F.when(F.col("pool_source") == "near", 0).otherwise(less).alias("itself"), "used_radius", "pool_source", *[F.when(F.col("pool_source") == "near", F.col(x)).alias(x) for x in ("near_segments", "near_inside")])
    return q, reach, nearest


def _key(mark: str, x: Column) -> Column:
    return F.concat(F.lit(mark), F.coalesce(x, F.lit("")))


def _drawn(q: DataFrame, reach: DataFrame, nearest: DataFrame) -> DataFrame:
    """q with a row for each `key` (segment within reach or nearest, ward, district, all) that a query draws from."""
    near = reach.select(F.col("segment_key").alias("q_segment_key"), _key("s:", F.col("reach_key")).alias("key"), F.col("distance_m").alias("__d"))
    drawn = q.where("pool_source = 'segment'").join(near, "q_segment_key").where(F.col("__d") <= F.col("used_radius")).drop("__d")
    named = F.when(F.col("pool_source") == "ward", _key("w:", F.col("q_phuong_norm"))).when(F.col("pool_source") == "district", _key("d:", F.col("q_quan_norm"))).otherwise("*")
    places = nearest.select(*[F.col(x).alias(f"q_{x}") for x in PLACE], _key("s:", F.col("near_key")).alias("key"))
    drawn = drawn.unionByName(q.where("pool_source = 'near'").join(places, [f"q_{x}" for x in PLACE]))
    return drawn.unionByName(q.where("pool_source not in ('segment', 'near')").withColumn("key", named))


def _offered(rows: DataFrame, prefix: str = "") -> DataFrame:
    """Candidates, or groups of them, with a row for each `key` that they belong to."""
    of = lambda x: F.col(prefix + x)
    return rows.withColumn("key", F.explode(F.array(_key("s:", of("segment_key")), _key("w:", of("phuong_norm")), _key("d:", of("quan_norm")), F.lit("*"))))


def pool(queries: DataFrame, candidates: DataFrame, embedding: DataFrame, config: Config = Config(), exclude_self: bool = True) -> DataFrame:
    """Query-candidate pairs (columns q_*, c_*), `used_radius`, `pool_source`, and for source 'near' the numbers of segments used and within the radius.

    Queries of known segments draw from the segments within reach, those of new segments with a coordinate from the
    nearest_segments() ('near'). The others, and those that no such segment serves, take their ward's candidates, else
    their district's, else all; a query never meets itself there either.
    """
    asking = queries.select("row_id", *CARRIED, _itself(exclude_self).alias("itself"))
    q, reach, nearest = _served(asking, candidates.withColumn("n", F.lit(1)), embedding, config)
    q = q.select("used_radius", "pool_source", "near_segments", "near_inside", *[F.col(x).alias(f"q_{x}") for x in ("row_id", *CARRIED)])
    c = candidates.select(F.col("row_id").alias("c_row_id"), F.col("tong_gia").alias("c_tong_gia"), *[F.col(x).alias(f"c_{x}") for x in (*CARRIED, "pho_count_train", "cluster_confidence", "segment_heterogeneity_penalty")])
    pairs = _drawn(q, reach, nearest).join(_offered(c, "c_"), "key").drop("key")
    return pairs.where(F.col("q_row_id") != F.col("c_row_id")) if exclude_self else pairs


#: Weights of a candidate's score by where it comes from
WEIGHTS = {
    "same_segment": {"access": 0.24, "feature": 0.20, "frontage": 0.16, "area": 0.12, "depth": 0.10, "reliability": 0.10, "location": 0.08},
    "nearby_segment": {"spatial": 0.24, "access": 0.18, "feature": 0.16, "location": 0.12, "cluster": 0.10, "reliability": 0.10, "area": 0.10},
    "other": {"spatial": 0.18, "location": 0.16, "access": 0.16, "feature": 0.15, "cluster": 0.10, "reliability": 0.10, "area": 0.08, "frontage": 0.07},
}
SOURCE_SCORE = {"same_segment": 1.0, "nearby_segment": 0.9, "same_cluster": 0.75, "same_phuong": 0.68, "fallback": 0.55}
SOURCES = tuple(SOURCE_SCORE)
_OFFERED = ("pho_count_train", "cluster_confidence", "segment_heterogeneity_penalty")
#: Measures of a query's band, and the fields of its best pairs
_BAND = ("same_cluster_ratio", "access_band_match_ratio", "special_comparable_ratio", "mean_candidate_reliability", "same_segment_ratio", "heterogeneous_comparable_ratio", "strength", "total_value_band_p25", "total_value_band_median", "total_value_band_p75")
_BEST = {"comparable_source": "string", "same_cluster": "int", "same_access_band": "int", "distance_m": "double", "feature_similarity": "double", "access_similarity": "double", "area_similarity": "double", "candidate_reliability": "double", "similarity_score": "double"}


class Meeting(NamedTuple):
    """Queries by bundle and part, the candidates that their requests want, and the number of bundles."""

    left: DataFrame
    right: DataFrame
    bundles: int

    @property
    def rounds(self) -> int:
        return max(1, min(ROUNDS, self.bundles // BUNDLES))


def search(queries: DataFrame, candidates: DataFrame, embedding: DataFrame, config: Config = Config(), exclude_self: bool = True) -> DataFrame:
    """One row for every query with a candidate that the filters leave: the measures of its band pool and its `best` pairs."""
    return found(meeting(queries, candidates, embedding, config, exclude_self), config, exclude_self)


def measures(met: Meeting, config: Config = Config(), exclude_self: bool = True) -> DataFrame:
    """The rows of found() without their `best` pairs, written. Bundles meet in rounds, so that only a round's rows are in shuffles."""
    of = lambda rows, name, k: rows.where(F.pmod(F.col(name), F.lit(met.rounds)) == k)
    return staged_parts((found(Meeting(of(met.left, "bundle", k), of(met.right, "for_bundle", k), met.bundles), config, exclude_self).drop("best") for k in range(met.rounds)), "measures")


def meeting(queries: DataFrame, candidates: DataFrame, embedding: DataFrame, config: Config = Config(), exclude_self: bool = True) -> Meeting:
    """Who meets whom.

    Purpose, class, access band and area (20, 35, 50 %): a filter holds only where enough of a query's pool passes. The
    first three are decided at the grain of cells, for kinds of queries. Queries that draw from the same cells are a request;
    bundles of requests, or parts of a large one, of about QUERIES queries meet the candidates that pass in one task. Rows
    are shuffled for that meeting, and for nothing else where the written tables of kinds and cells can be broadcast.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    home, own = ["segment_key", "phuong_norm", "quan_norm", *FILTERS], [f"q_{x}" for x in FILTERS]
    cells = staged(candidates.groupBy(*home).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", F.monotonically_increasing_id()), "cells")
    alone = [*home, *PLACE, "alone"]
    queries = queries.select("row_id", *CARRIED, _itself(exclude_self).alias("alone"))
    kinds = staged(queries.groupBy(*alone).agg(F.count(F.lit(1)).alias("asks")), "kinds")
    q, reach, nearest = _served(kinds.withColumn("itself", F.col("alone")), cells, embedding, config)
    q = q.select("asks", "alone", "itself", "used_radius", "pool_source", "near_segments", "near_inside", *[F.col(x).alias(f"q_{x}") for x in (*home, *PLACE)])
    at = F.concat_ws("|", *[text(f"q_{x}") for x in PLACE])
    drawing = F.when(F.col("pool_source") == "segment", F.concat_ws("|", F.lit("s"), F.col("used_radius"), F.col("q_segment_key"))).when(F.col("pool_source") == "near", F.concat(F.lit("n|"), at))
    q = staged(q.withColumn("pool", drawing.when(F.col("pool_source") == "ward", _key("w|", F.col("q_phuong_norm"))).when(F.col("pool_source") == "district", _key("d|", F.col("q_quan_norm"))).otherwise("*")), "served")
    drawn = _drawn(q.select("pool", "pool_source", "used_radius", "q_segment_key", "q_phuong_norm", "q_quan_norm", *[f"q_{x}" for x in PLACE]).distinct(), reach, nearest)
    members = staged(drawn.select("pool", "key").distinct().join(_offered(cells), "key").select("pool", "cell", "n", *FILTERS).distinct(), "members")

    # what each kind of query asks of its pool, and whether the filters hold: few rows, as cells are
    asked = q.groupBy("pool", "itself", *own).agg(F.sum("asks").alias("asks"))
    same = [F.coalesce(F.col(f"q_{x}") == F.col(x), F.lit(False)) for x in FILTERS]
    alike = {a: F.sum(F.when(all_of(s for s, k in zip(same, a) if k == "1"), F.col("n")).otherwise(0)).alias(f"n{a}") for a in ("100", "010", "110", "001", "101", "011", "111")}
    asked = asked.join(members, "pool").groupBy("pool", "itself", "asks", *own).agg(*alike.values())
    for i, (x, (less, _)) in enumerate(FILTERS.items()):
        passing = F.lit(0)
        for a in alike:
            if a[i] == "1" and "1" not in a[i + 1 :]:
                passing = F.when(all_of(F.col(f"k{j}") == F.lit(a[j] == "1") for j in range(i)), F.col(f"n{a}")).otherwise(passing)
        asked = asked.withColumn(f"k{i}", passing - F.when(F.col(f"q_{x}").isNotNull(), F.col("itself")).otherwise(0) >= max(3, config.min_comparables - less))
    held = [F.when(F.col(f"k{i}"), F.col(f"q_{x}")).alias(f"r_{x}") for i, x in enumerate(FILTERS)]
    asked = staged(asked.select("pool", "itself", *own, "asks", "k0", "k1", "k2", *held), "asked")
    kind = ["pool", "k0", "k1", "k2", *[f"r_{x}" for x in FILTERS]]
    requests = staged(asked.groupBy(*kind).agg(F.sum("asks").alias("asks")).withColumn("request", F.monotonically_increasing_id()), "requests")
    bundles, = requests.agg(F.coalesce(F.ceil(F.sum("asks") / QUERIES), F.lit(1))).first()
    requests = requests.withColumns({"parts": F.ceil(F.col("asks") / QUERIES).cast("int"), "bundle": F.pmod(F.xxhash64("request"), F.lit(bundles))}).drop("asks")

    on = lambda a, b, names: all_of(a[x].eqNullSafe(b[x]) for x in names)
    placed = asked.alias("a").join(requests.alias("r"), all_of(F.col(f"a.{x}").eqNullSafe(F.col(f"r.{x}")) for x in kind)).select(*[F.col(f"a.{x}") for x in ("pool", "itself", *own, "k0", "k1", "k2")], "request", "parts", "bundle")
    placed = q.join(placed, on(q, placed, ["pool", "itself", *own])).drop(*[placed[x] for x in ("pool", "itself", *own)]).select(*[F.col(f"q_{x}").alias(x) for x in (*home, *PLACE)], "alone", "used_radius", "pool_source", "near_segments", "near_inside", "k0", "k1", "k2", "request", "parts", "bundle")
    placed = staged(placed, "placed")
    wanted = requests.join(members, "pool").where(all_of(~F.col(f"k{i}") | F.coalesce(F.col(f"r_{x}") == F.col(x), F.lit(False)) for i, x in enumerate(FILTERS)))
    wanted = staged(wanted.select("cell", F.col("request").alias("for_request"), F.col("bundle").alias("for_bundle"), "parts").join(cells.drop("n"), "cell").drop("cell"), "wanted")
    carried = [x for x in CARRIED if x not in ("muc_dich_su_dung_dat", "phan_loai_kho")]
    left = queries.join(placed, on(queries, placed, alone)).drop(*[placed[x] for x in alone])
    left = left.select("bundle", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int").alias("part"), "request", "used_radius", "pool_source", "near_segments", "near_inside", "k0", "k1", "k2", F.col("row_id").alias("q_row_id"), *[F.col(x).alias(f"q_{x}") for x in carried])
    c = candidates.join(wanted, on(candidates, wanted, home)).drop(*[wanted[x] for x in home]).withColumn("for_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = c.select("for_bundle", "for_part", "for_request", F.col("row_id").alias("c_row_id"), F.col("tong_gia").cast("double").alias("c_tong_gia"), *[F.col(x).alias(f"c_{x}") for x in (*carried, *_OFFERED)])
    return Meeting(left, right, bundles)


def found(met: Meeting, config: Config = Config(), exclude_self: bool = True) -> DataFrame:
    """What the queries of a meeting find, a row a query; see search()."""
    left, right = met.left, met.right
    id_q, id_c = dict(left.dtypes)["q_row_id"], dict(right.dtypes)["c_row_id"]
    best = f"array<struct<c_row_id: {id_c}, c_segment_key: string, c_tong_gia: double, {', '.join(f'{k}: {v}' for k, v in _BEST.items())}>>"
    schema = f"q_row_id {id_q}, used_radius int, pool_source string, near_segments long, near_inside long, k0 boolean, k1 boolean, k2 boolean, area_step int, n int, {', '.join(f'{x} double' for x in _BAND)}, best {best}"
    # like rows side by side compress better on their way
    left, right = left.sortWithinPartitions("bundle", "part", "request", "q_segment_key", "q_dien_tich_m2"), right.sortWithinPartitions("for_bundle", "for_part", "for_request", "c_segment_key", "c_dien_tich_m2")
    got = left.groupBy("bundle", "part").cogroup(right.groupBy("for_bundle", "for_part")).applyInArrow(lambda a, b: _compare(a, b, config, exclude_self), schema)
    step = F.col("area_step")
    relaxed = {name: ~F.col(f"k{i}") for i, (_, name) in enumerate(FILTERS.values())} | {"AREA_MATCH_RELAXED": step == 1, "AREA_MATCH_STRONGLY_RELAXED": step == 2}
    return got.withColumn("cascade_flags", flags(**relaxed)).drop("k0", "k1", "k2", "area_step")


def all_of(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """As doubles, with NaN for null."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if not isinstance(column, pa.ChunkedArray) else column.cast(pa.float64()).to_numpy()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().reshape(len(column), -1)


def _codes(q: pa.ChunkedArray, c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where two values are; -1 and -2 for nulls of q and c, which equal nothing."""
    both = pa.chunked_array(q.chunks + c.chunks, q.type).combine_chunks().dictionary_encode()
    both = both.indices if isinstance(both, pa.DictionaryArray) else both.combine_chunks().indices
    codes = pc.fill_null(both, -1).to_numpy(zero_copy_only=False)
    a, b = codes[: len(q)], codes[len(q) :]
    return a, np.where(b < 0, -2, b)


def _metres(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """haversine_m of two columns of places, all with all."""
    y1, x1, y2, x2 = lat1[:, None], lon1[:, None], lat2[None], lon2[None]
    h = np.sin(np.radians(y2 - y1) / 2) ** 2 + np.cos(np.radians(y1)) * np.cos(np.radians(y2)) * np.sin(np.radians(x2 - x1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def _places(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different places and each row's number among them."""
    names, at = np.unique(np.where(np.isnan(lat) | np.isnan(lon), np.nan, lat) + 1j * np.where(np.isnan(lat), 0, lon), return_inverse=True)
    return names.real, names.imag, at.reshape(-1)


def _middle(values: np.ndarray) -> float:
    values = values[~np.isnan(values)]
    return float(np.median(values)) if len(values) else np.nan


def _leading(key: np.ndarray, far: np.ndarray, order: np.ndarray, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest keys; ties by distance (unknown last), then by order."""
    key = np.where(alive, np.where(np.isnan(key), -1e300, key), -np.inf)
    if key.shape[1] > k:
        alive = alive & (key >= np.partition(key, key.shape[1] - k, axis=1)[:, -k, None])
    r, c = np.nonzero(alive)
    o = np.lexsort((order[r, c], np.nan_to_num(far[r, c], nan=np.inf), -key[r, c], r))
    r, c = r[o], c[o]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first]


def _quartiles(r: np.ndarray, value: np.ndarray, weight: np.ndarray, order: np.ndarray, rows: int) -> list[np.ndarray]:
    """weighted_quantiles of the values of each row."""
    use = np.isfinite(value) & (weight > 0)
    r, value, weight, order = r[use], value[use], weight[use], order[use]
    o = np.lexsort((order, -weight, value, r))
    r, value, weight = r[o], value[o], weight[o]
    at = np.arange(len(r)) - np.searchsorted(r, r)
    wide = int(at.max()) + 1 if len(at) else 1
    v, w = np.full((rows, wide), np.nan), np.zeros((rows, wide))
    v[r, at], w[r, at] = value, weight
    n, total = np.bincount(r, minlength=rows), np.cumsum(w, axis=1)
    p = np.where(np.arange(wide) < n[:, None], (total - w / 2) / np.where(total[:, -1:] > 0, total[:, -1:], 1), np.inf)
    out, each = [], np.arange(rows)
    for q in (0.25, 0.5, 0.75):
        low = np.sum(p <= q, axis=1) - 1  # the last midpoint at or below q
        a, b = np.clip(low, 0, wide - 1), np.clip(low + 1, 0, wide - 1)
        between = (low >= 0) & (low + 1 < n)
        with np.errstate(invalid="ignore", divide="ignore"):
            inner = v[each, a] + (q - p[each, a]) / (p[each, b] - p[each, a]) * (v[each, b] - v[each, a])
        out.append(np.where(n == 0, np.nan, np.where(between, inner, v[each, a])))
    return out


def _compare(q: pa.Table, c: pa.Table, config: Config, exclude_self: bool) -> pa.Table:
    """A row for each query (q_*) that any candidate (c_*) of its request is left for; all of those pass its first three filters."""
    if not len(q) or not len(c):
        empty = {"c_row_id": c["c_row_id"].type, "c_segment_key": pa.string(), "c_tong_gia": pa.float64()} | {k: {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[v] for k, v in _BEST.items()}
        kinds = {"q_row_id": q["q_row_id"].type, "used_radius": pa.int32(), "pool_source": pa.string(), "near_segments": pa.int64(), "near_inside": pa.int64(), "k0": pa.bool_(), "k1": pa.bool_(), "k2": pa.bool_(), "area_step": pa.int32(), "n": pa.int32()} | {x: pa.float64() for x in _BAND} | {"best": pa.list_(pa.struct(empty))}
        return pa.schema(kinds).empty_table()
    # a request's candidates are a slice, in order of area, those without one last; its queries are a slice too
    q = q.take(pc.sort_indices(q, sort_keys=[("request", "ascending")])).combine_chunks()
    c = c.take(pc.sort_indices(c, sort_keys=[("for_request", "ascending"), ("c_dien_tich_m2", "ascending")])).combine_chunks()
    area, size, total = _numbers(c["c_dien_tich_m2"]), _numbers(q["q_dien_tich_m2"]), len(c)
    size = np.where(size > 0, size, np.nan)
    low, high, step, mine = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), 3), np.full(len(q), -1)
    asked, offered = q["request"].to_numpy(), c["for_request"].to_numpy()
    names, starts = np.unique(asked, return_index=True)
    for start, end, first, last in zip(starts, [*starts[1:], len(q)], np.searchsorted(offered, names, "left"), np.searchsorted(offered, names, "right")):
        here, own = slice(start, end), area[first:last]
        if exclude_self:
            found = pc.index_in(q["q_row_id"].slice(start, end - start), value_set=c["c_row_id"].slice(first, last - first))
            mine[here] = pc.fill_null(pc.add(found.cast(pa.int64()), int(first)), -1).to_numpy()
        for i in start + np.flatnonzero(np.isnan(size[here])):
            size[i] = _middle(np.delete(own, mine[i] - first) if mine[i] >= 0 else own)
        low[here], high[here] = first, last
        # the narrowest range of areas with enough candidates
        valued = own[~np.isnan(own)]
        for k, share in ((2, 0.5), (1, 0.35), (0, 0.2)):
            a, b = (first + np.searchsorted(valued, size[here] * x, side) for x, side in ((1 - share, "left"), (1 + share, "right")))
            enough = b - a - ((mine[here] >= a) & (mine[here] < b)) >= 3
            low[here], high[here], step[here] = np.where(enough, a, low[here]), np.where(enough, b, high[here]), np.where(enough, k, step[here])

    codes = {x: _codes(q[f"q_{x}"], c[f"c_{x}"]) for x in ("segment_key", "phuong_norm", "quan_norm", "pho_canonical_norm", "access_band", "cluster")}
    named = {x: pc.fill_null(pc.not_equal(q[f"q_{x}"], ""), False).to_numpy() for x in ("segment_key", "pho_canonical_norm")}
    place_q, place_c = ([_numbers(t[f"{p}_{x}"]) for x in PLACE] for t, p in ((q, "q"), (c, "c")))
    (*names_q, at_q), (*names_c, at_c) = _places(*place_q), _places(*place_c)
    metres = _metres(*names_q, *names_c)
    vectors = {x: (_matrix(q[f"q_{x}"]), _matrix(c[f"c_{x}"]).T.copy()) for x in ("core", "access")}
    width, depth, special, value = (_numbers(c[f"c_{x}"]) for x in ("mat_tien_m", "chieu_dai_m", "special_asset_score", "tong_gia"))
    q_width, q_depth, q_special = (_numbers(q[f"q_{x}"]) for x in ("mat_tien_m", "chieu_dai_m", "special_asset_score"))
    order = np.empty(total, np.int64)
    order[pc.sort_indices(c["c_row_id"].combine_chunks()).to_numpy()] = np.arange(total)
    trust = _numbers(c["c_cluster_confidence"])
    trust = 0.25 * np.clip(np.where(np.isnan(trust), 0.3, trust), 0.2, 1.0)
    seen = 0.30 * np.clip(np.nan_to_num(_numbers(c["c_pho_count_train"]), nan=0.0) / 10, 0.3, 1.0)
    penalty = _numbers(c["c_segment_heterogeneity_penalty"])
    penalty = np.where(np.isnan(penalty), 0.85, penalty)
    plain = np.nan_to_num(special, nan=0.0)
    calm = 1 - 0.08 * np.clip(plain, 0.0, 1.0)
    mixed = pc.fill_null(pc.is_in(c["c_segment_heterogeneity_flag"], value_set=pa.array(["HETEROGENEOUS_MEDIUM", "HETEROGENEOUS_HIGH"])), False).to_numpy()
    wild = pc.fill_null(pc.equal(q["q_segment_heterogeneity_flag"], "HETEROGENEOUS_HIGH"), False).to_numpy()
    odd = special >= 0.45
    scores = np.array([SOURCE_SCORE[x] for x in SOURCES])

    def part(rows: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray], pa.Array]:
        """The kept rows, their measures, and their best pairs: offsets and fields."""
        span = high[rows] - low[rows]
        at = low[rows, None] + np.arange(span.max())
        alive = (at < high[rows, None]) & (at != mine[rows, None])
        at = np.minimum(at, total - 1)
        same = {x: a[rows, None] == b[at] for x, (a, b) in codes.items()}

        def ratio(values: np.ndarray, of: np.ndarray) -> np.ndarray:
            x = (values[at] + 1e-6) / of[:, None]
            return np.abs(np.log(np.where(x > 0, x, np.nan)))

        def usual(own: np.ndarray, values: np.ndarray) -> np.ndarray:
            own = own[rows].copy()
            for i in np.flatnonzero(~(own > 0)):
                middle = _middle(values[at[i][alive[i]]])
                own[i] = middle if middle > 0 else 1.0
            return own

        far = metres[at_q[rows, None], at_c[at]]
        far = np.where(np.isnan(far) & same["segment_key"], 0.0, far)
        near = {}
        for x, (a, b) in vectors.items():
            d = np.zeros(at.shape)
            for i in range(a.shape[1]):
                d += (a[rows, i, None] - b[i][at]) ** 2
            near[x] = 1 / (1 + np.sqrt(d))
        unlike = ratio(area, np.fmax(size[rows], 1e-6))
        gap = np.abs(plain[at] - np.nan_to_num(q_special[rows], nan=0.0)[:, None])
        location = np.select([same["segment_key"] & named["segment_key"][rows, None], same["pho_canonical_norm"] & named["pho_canonical_norm"][rows, None], same["phuong_norm"], same["quan_norm"]], [1.0, 0.9, 0.6, 0.4], 0.2)
        source = np.select([same["segment_key"] & named["segment_key"][rows, None], far <= 1000, same["cluster"], same["phuong_norm"]], [0, 1, 2, 3], 4)
        sure = np.clip((seen[at] + 0.25 * scores[source] + trust[at] + 0.20 * np.where(same["access_band"], 1.0, 0.7)) * penalty[at] * calm[at], 0.0, 1.0)
        alike = np.exp(-unlike)
        parts = {
            "access": near["access"], "feature": near["core"], "frontage": np.nan_to_num(np.exp(-ratio(width, usual(q_width, width) + 1e-6)), nan=0.0), "area": np.nan_to_num(alike, nan=0.0),
            "depth": np.nan_to_num(np.exp(-ratio(depth, usual(q_depth, depth) + 1e-6)), nan=0.0), "reliability": sure, "location": location, "spatial": np.nan_to_num(np.exp(-far / config.sigma_spatial_m), nan=0.0), "cluster": same["cluster"].astype(float),
        }
        base = np.select([source == 0, source == 1], [_total("same_segment", parts), _total("nearby_segment", parts)], _total("other", parts))
        mismatch = 1.0 - same["access_band"]
        off = 0.06 * np.where(np.isnan(far), 1.0, np.clip(far / 2000, 0.0, 1.0)) + 0.05 * np.where(np.isnan(unlike), 1.0, np.clip(unlike, 0.0, 1.0)) + 0.04 * np.clip(gap, 0.0, 1.0) + 0.04 * mismatch
        off = off + 0.04 * np.where(wild[rows, None], mismatch, 0.0)
        score = base - off
        strength = np.nan_to_num(np.fmax(score, 0.0), nan=0.0)
        weight = strength * (0.55 + 0.45 * sure)

        r, k = _leading(weight, far, order[at], alive, max(config.top_k, config.band_top_k))
        n, j = np.bincount(r, minlength=len(rows)), at[r, k]
        mean = lambda x: np.bincount(r, x, len(rows)) / np.maximum(n, 1)
        band = [mean(same["cluster"][r, k]), mean(same["access_band"][r, k]), mean(odd[j]), mean(sure[r, k]), mean(same["segment_key"][r, k]), mean(mixed[j]), mean(strength[r, k]), *_quartiles(r, value[j], weight[r, k], order[j], len(rows))]
        kept = n > 0
        r, k = _leading(score, far, order[at], alive, config.top_k)
        j = at[r, k]
        fields = {"at": j, "comparable_source": source[r, k], "same_cluster": same["cluster"][r, k], "same_access_band": same["access_band"][r, k], "distance_m": far[r, k], "feature_similarity": near["core"][r, k], "access_similarity": near["access"][r, k], "area_similarity": alike[r, k], "candidate_reliability": sure[r, k], "similarity_score": score[r, k]}
        return rows[kept], {"n": n[kept]} | {x: v[kept] for x, v in zip(_BAND, band)}, fields, np.bincount(r, minlength=len(rows))[kept]

    done, span = [], high - low
    turn, i = np.argsort(span, kind="stable"), 0
    while i < len(turn):
        j = min(len(turn), i + max(1, PAIRS // max(1, int(span[turn[i]]))))
        while j - i > 1 and (j - i) * int(span[turn[j - 1]]) > 2 * PAIRS:
            j = i + (j - i) // 2
        if span[turn[j - 1]] > 0:
            done.append(part(turn[i:j]))
        i = j
    if not done:
        return _compare(q[:0], c, config, exclude_self)
    rows = np.concatenate([d[0] for d in done])
    measures = {x: np.concatenate([d[1][x] for d in done]) for x in done[0][1]}
    fields = {x: np.concatenate([d[2][x] for d in done]) for x in done[0][2]}
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([d[3] for d in done]))]).astype(np.int32)
    number = lambda x: pa.array(x, pa.float64(), from_pandas=True)
    taken = c.select(["c_row_id", "c_segment_key", "c_tong_gia"]).take(pa.array(fields.pop("at"))).combine_chunks()
    best = {x: taken[x].combine_chunks() for x in taken.column_names}
    best |= {"comparable_source": pa.DictionaryArray.from_arrays(pa.array(fields["comparable_source"].astype(np.int32)), pa.array(SOURCES)).cast(pa.string())}
    best |= {x: pa.array(fields[x].astype(np.int32)) if v == "int" else number(fields[x]) for x, v in _BEST.items() if v != "string"}
    out = {x: q[x].take(pa.array(rows)) for x in ("q_row_id", "used_radius", "pool_source", "near_segments", "near_inside", "k0", "k1", "k2")}
    out |= {"area_step": pa.array(step[rows].astype(np.int32)), "n": pa.array(measures["n"].astype(np.int32))} | {x: number(measures[x]) for x in _BAND}
    return pa.table(out | {"best": pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([best[x] for x in best], list(best)))})


def _total(kind: str, parts: dict[str, np.ndarray]) -> np.ndarray:
    out = 0.0
    for x, w in WEIGHTS[kind].items():
        out = out + w * parts[x]
    return out


def top(found: DataFrame) -> DataFrame:
    """The best pairs of each query: score, then distance, then the candidate's id."""
    return found.select("q_row_id", F.posexplode("best").alias("comparable_rank", "b")).select("q_row_id", "b.*", (F.col("comparable_rank") + 1).alias("comparable_rank"))


def summary(found: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per query: weighted quartiles of value, ratios, confidences and flags over the band pool."""
    full = F.least(F.lit(1.0), F.col("n") / config.band_top_k)
    width = (F.col("total_value_band_p75") - F.col("total_value_band_p25")) / F.greatest("total_value_band_median", F.lit(1.0))
    s = found.drop("best").withColumnRenamed("used_radius", "max_search_radius_m").withColumn("weighted_band_width_ratio", width).withColumns({
        "comparable_count": F.least(F.col("n"), F.lit(config.top_k)),
        "comparable_confidence": clip01(0.45 * full + 0.35 * F.col("strength") + 0.20 * (1 - F.least(F.lit(1.0), F.col("max_search_radius_m") / config.max_radius_m))),
        "band_confidence": clip01(0.35 * full + 0.25 * F.col("mean_candidate_reliability") + 0.20 * F.col("access_band_match_ratio") + 0.10 * F.col("strength") + 0.10 * (1 - F.least(F.lit(1.0), F.coalesce("weighted_band_width_ratio", F.lit(1.0))))),
    })
    far, served = F.col("near_inside") == 0, F.col("pool_source").isin("segment", "near")
    first = flags(FAR_FROM_KNOWN_SEGMENTS=far, OUT_OF_TRAIN_AREA=far, FALLBACK_RADIUS_USED=served & (F.col("max_search_radius_m") > 1000), LOW_NEIGHBOR_COUNT=F.col("near_segments") < config.min_comparables, MISSING_SEGMENT_GEO=F.col("pool_source") == "all", LOW_CONFIDENCE_PREDICTION=~served)
    last = flags(LOW_COMPARABLE_COUNT=F.col("comparable_count") < config.min_comparables, ACCESS_MISMATCH_POOL=F.col("access_band_match_ratio") < 0.5, ACCESS_CONTEXT_WEAK=F.col("access_band_match_ratio") < 0.4, HETEROGENEOUS_COMPARABLE_POOL=F.col("heterogeneous_comparable_ratio") > 0.6, WIDE_PRICE_BAND=F.col("weighted_band_width_ratio") > 1.2)
    return s.withColumn("comparable_flags", F.concat(first, "cascade_flags", last)).drop("cascade_flags", "n", "strength", "pool_source", "near_segments", "near_inside").withColumnRenamed("q_row_id", "row_id")
