"""Fitting and applying an appraisal, end to end."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import clusters, comparables, confidence, features, graph, inference, model, scaling, segments
from ..sources.staging import staged

CONTEXT = ["cluster_confidence", "distance_to_cluster_center", "local_embedding_density"]


def _spectral(embedding: DataFrame) -> list[str]:
    return [c for c in embedding.columns if c.startswith("spectral_")]


def fit(train: DataFrame, coordinates: DataFrame, config: Config = Config(), starts: int = 5) -> tuple[dict[str, DataFrame], PipelineModel]:
    """Everything that appraising needs, from typed, keyed train rows and keyed coordinates."""
    t = {"master": segments.segment_master(train, segments.coordinate_dictionary(coordinates)), "frequencies": features.frequencies(train)}
    t["neighbor_features"] = segments.neighbor_features(segments.segment_neighbors(t["master"], config))
    clean = train.where("tong_gia > 0")
    t["heterogeneity"] = features.heterogeneity(clean)
    t["templates"] = features.heterogeneity_templates(t["heterogeneity"])
    t = {k: staged(v, k) for k, v in t.items()}
    rows = staged(_described(train, t, True), "located")
    t["core"], t["access"] = scaling.fit_scaling(rows, scaling.CORE), scaling.fit_scaling(rows, scaling.ACCESS)
    t["components"] = scaling.fit_location(rows)
    t |= {k: staged(t[k], k) for k in ("core", "access", "components")}
    rows = staged(_scaled(rows, t), "vectors")
    rows, report, t["centers"] = clustered(rows, t["components"], config, starts)
    rows = staged(rows, "clustered")
    t["graph_report"], t["profiles"] = report, staged(clusters.profiles(rows), "profiles")
    rows = staged(clusters.special_assets(clusters.attach_profiles(rows, t["profiles"])), "scaled")
    names = _spectral(rows)
    t["embedding"] = staged(inference.segment_embedding(rows, names), "embedding")
    t["location"] = staged(inference.location_templates(t["embedding"], names + CONTEXT), "location")
    t["bands"] = staged(features.segment_band(rows.where("tong_gia > 0")), "bands")
    t["candidates"] = rows.where("tong_gia > 0")
    pairs = comparables.search(rows, t["candidates"], t["embedding"], config)
    fitted = model.fit(rows.join(comparables.summary(pairs, config).drop("comparable_flags"), "row_id", "left"), model.feature_sets()["model_5"], config)
    return t, fitted


def vectors(rows: DataFrame, components: DataFrame) -> DataFrame:
    """What the similarity graphs compare: i, core, access, location, lat, lon."""
    out = scaling.location_vector(rows, components)
    return staged(out.select(F.col("row_id").alias("i"), "core", "access", "location", F.col("segment_lat_for_model").alias("lat"), F.col("segment_lon_for_model").alias("lon")), "compared")


def clustered(rows: DataFrame, components: DataFrame, config: Config = Config(), starts: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scaled rows with spectral columns, cluster, confidence, raw distance and density; the graphs' report; the centres."""
    v = vectors(rows, components)
    graphs = graph.hybrid(v, config)
    graphs["final"] = staged(graphs["final"], "final")
    x = staged(graph.spectral(graphs["final"], config.spectral_dim), "spectral")
    dim = x.select(F.size("vector")).first()[0]
    segments_seen, = rows.agg(F.count_distinct("segment_key")).first()
    centers = graph.centers(graph.kmeans(x, graph.cluster_count(max(segments_seen, 3)), starts, config.seed))
    x = clusters.assign(x, centers).join(graph.local_density(graphs["final"]).withColumnRenamed("density", "local_embedding_density"), "i", "left")
    x = x.select(F.col("i").alias("row_id"), *[F.col("vector")[k].alias(f"spectral_{k + 1}") for k in range(dim)], "assigned_cluster", F.col("assigned_cluster").alias("cluster"), "cluster_confidence", "cluster_center_distance_raw", "local_embedding_density")
    report = staged(graph.hybrid_report(graphs, v, dim, config), "report")
    return rows.join(x, "row_id"), report, staged(rows.sparkSession.createDataFrame(centers, "cluster int, center array<double>"), "centers")


def _described(rows: DataFrame, t: dict[str, DataFrame], train: bool) -> DataFrame:
    out = features.engineer(segments.attach_segments(rows, t["master"], train), t["frequencies"])
    out = features.attach_heterogeneity(out, t["heterogeneity"], t["templates"])
    return segments.attach_neighbors(out, t["neighbor_features"]) if train else out


def _scaled(rows: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    return scaling.scale(scaling.scale(rows, t["core"], scaling.CORE, "core"), t["access"], scaling.ACCESS, "access")


def apply(rows: DataFrame, t: dict[str, DataFrame], fitted: PipelineModel, config: Config = Config()) -> DataFrame:
    """Predictions with bands, confidence and explanations; nothing is fitted, and no row depends on another."""
    names = _spectral(t["embedding"])
    out = inference.represent(_described(rows, t, False), t["embedding"], t["neighbor_features"], t["location"], names + CONTEXT, config)
    centers = [(r["cluster"], list(r["center"])) for r in t["centers"].orderBy("cluster").collect()]  # a row for each cluster
    out = clusters.attach_profiles(inference.predict_cluster(out, centers, names), t["profiles"])
    out = staged(_scaled(clusters.special_assets(out), t), "represented")
    pairs = comparables.search(out, t["candidates"], t["embedding"], config, exclude_self=False)
    out = model.predict(fitted, out.join(comparables.summary(pairs, config), "row_id", "left"))
    return confidence.explain(confidence.add_errors(confidence.add_confidence(out.join(t["bands"], "segment_key", "left"))))
