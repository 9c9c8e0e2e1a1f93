"""Every operator as a query over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import weighted_quantiles
from ..functions.text import normalize_admin, normalize_text, parse_coordinate, render_flags
from ..operators import clusters, comparables, confidence, diagnostics, features, graph, inference, model, roads, scaling, segments
from ..sources.staging import staged, staged_parts
from . import appraisal
from .frames import Frames, frames


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(normalize_text(F.col("text"))).alias("text_md5"), normalize_admin(F.col("source"), "quan").alias("admin"))


def coordinates_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = frames(spark, sf_dir).raw
    typed = F.when(F.col("row_id") % 3 == 0, F.round(F.col("manual_lat") * 1e6).cast("long").cast("string")).when(F.col("row_id") % 3 == 1, F.col("manual_lat").cast("string")).otherwise("n/a")
    return raw.select("row_id", F.round(parse_coordinate(typed), 6).alias("lat"))


def alias_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = frames(spark, sf_dir).raw
    return segments.alias_report(raw, segments.canonical_lookup(raw, "pho_input"), "pho_input")


def canonical_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.canonical_lookup(frames(spark, sf_dir).raw, "pho_input")


def segment_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frames(spark, sf_dir).master
    return m.select("segment_key", "quan", "phuong", "pho", "train_sample_count", "coord_source", "coord_found", "coord_match_status", render_flags(F.col("coord_flags")).alias("coord_warning_flag"), *_r("segment_lat", "segment_lon", "segment_lat_for_model", "segment_lon_for_model"), *_r("distance_to_ward_median_m", digits=3))


def segment_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).neighbors.select("segment_key", "neighbor_segment_key", "neighbor_rank", "radius_bucket", *_r("distance_m", digits=3), *_r("spatial_weight"))


def neighbor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).neighbor_features.select("segment_key", "neighbor_count_300m", "neighbor_count_500m", "neighbor_count_1000m", *_r("nearest_segment_distance_m", digits=3))


def located_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.located(f.keyed).select("row_id", "segment_key", "has_valid_coordinate", render_flags(F.col("coord_flags")).alias("coord_warning_flag"), render_flags(F.col("target_flags")).alias("target_flag"), *_r("segment_lat_for_model", "segment_lon_for_model", "log_tong_gia"))


def segment_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).frequencies


def engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.engineered(f.keyed).select("row_id", "access_band", "pho_count_train", "phuong_count_train", "pho_rare", "phuong_rare", *_r("log_dien_tich", "log_khoang_cach", "log_do_rong_ngo", "ti_le_mat_tien", "mat_tien_x_so_mat_tien", "ngo_x_lt", "access_score"))


def segment_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = frames(spark, sf_dir).heterogeneity
    return h.select("segment_key", "segment_sample_count_train", "segment_heterogeneity_flag", "segment_heterogeneity_penalty", *_r("mean", "median", "std", "p25", "p75", digits=3), *_r("segment_price_cv", "segment_price_iqr_ratio", "segment_heterogeneity_score"))


def heterogeneity_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).templates.select("level", "key", "segment_heterogeneity_flag", *_r(*features.HETEROGENEITY))


def property_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    out = features.attach_heterogeneity(f.keyed, f.heterogeneity, f.templates)
    return out.select("row_id", "segment_heterogeneity_flag", "segment_heterogeneity_source", *_r("segment_price_cv", "segment_heterogeneity_score", "segment_heterogeneity_penalty"))


def segment_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    b = features.segment_band(f.clustered(f.clean))
    return b.select("segment_key", "dominant_cluster", "segment_value_count", *_r("segment_value_p25", "segment_value_p50", "segment_value_p75", "cluster_value_p25", "cluster_value_p50", "cluster_value_p75", digits=4), *_r("segment_band_confidence"))


def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    rows = f.clean.withColumn("weight", (F.col("row_id") % 6).cast("double"))
    return weighted_quantiles(rows, ["segment_key"], "tong_gia", "weight", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, "row_id").select("segment_key", *_r("p25", "p50", "p75", digits=7))


def cluster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return clusters.profiles(f.clustered(f.train)).select("cluster", "cluster_sample_count", *_r("cluster_distance_scale", "cluster_mean_confidence"), *_r("cluster_total_value_p25", "cluster_total_value_median", "cluster_total_value_p75", digits=4))


def property_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    out = clusters.attach_profiles(f.clustered(f.keyed), clusters.profiles(f.clustered(f.train)))
    return out.select("row_id", "cluster_sample_count", *_r("distance_to_cluster_center"), *_r("cluster_total_value_median", digits=4))


def cluster_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return clusters.diagnostics(f.clustered(f.clean)).select("cluster", "n", *_r("median_log", "mad_log", "dominant_segment_share", "price_ratio", "price_score"))


def special_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.described(f.keyed).select("row_id", "special_asset_flag", render_flags(F.col("special_asset_reasons")).alias("special_asset_reason"), *_r("special_asset_score"))


def segment_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames(spark, sf_dir).embedding
    return e.select("segment_key", "quan_norm", "phuong_norm", "train_sample_count", "cluster", *_r("segment_lat_for_model"), *_r("spectral_1", "spectral_2", "cluster_confidence", digits=9))


def location_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.location_templates(frames(spark, sf_dir).embedding, ["spectral_1", "cluster_confidence"]).select("level", "key", "cluster", *_r("spectral_1", "cluster_confidence"))


def inference_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    cols = ["spectral_1", "spectral_2", "cluster_confidence"]
    out = inference.represent(f.located(f.keyed), f.embedding, f.neighbor_features, inference.location_templates(f.embedding, cols), cols, f.config)
    return out.select("row_id", "case_type", "assigned_cluster_method", render_flags(F.col("inference_flags")).alias("inference_flag"), "neighbor_count_500m", "neighbor_count_1000m", *_r("nearest_segment_distance_m", digits=3), *_r("spectral_1", "spectral_2", "cluster_confidence", digits=9))


def inference_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters predicted again for represented rows, with three fixed centres."""
    f = frames(spark, sf_dir)
    cols = ["spectral_1", "spectral_2", "cluster_confidence"]
    out = inference.represent(f.located(f.keyed), f.embedding, f.neighbor_features, inference.location_templates(f.embedding, cols), cols, f.config)
    out = inference.predict_cluster(out, [(0, [0.44, 0.37]), (1, [0.49, 0.41]), (2, [0.47, 0.46])], cols[:2])
    return out.select("row_id", "case_type", "assigned_cluster", *_r("cluster_confidence", "cluster_center_distance_raw"))


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).scaled.select("row_id", *[F.round(F.col("core")[i], 6).alias(f"core_{i}") for i in range(8)], *[F.round(F.col("access")[i], 6).alias(f"access_{i}") for i in range(4)])


def location_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    out = scaling.location_vector(f.keyed, scaling.fit_location(f.train))
    return out.select("row_id", *[F.col("location")[i].alias(f"location_{i}") for i in range(10)])


def comparable_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return comparables.search_radius(f.train, comparables.radius_table(f.embedding, f.config), f.clean, f.config).select("row_id", "segment_key", "used_radius")


def comparable_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(comparables.top(frames(spark, sf_dir).compared))


def comparable_test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comparable_results of the test rows, which has the rows of new segments."""
    return _results(comparables.top(frames(spark, sf_dir).compared_test))


def _results(t: DataFrame) -> DataFrame:
    return t.select(F.col("q_row_id").alias("input_id"), F.col("c_row_id").alias("comparable_row_id"), F.col("c_segment_key").alias("comparable_segment_key"), "comparable_source", "same_cluster", "same_access_band", *_r("distance_m", digits=3), *_r("feature_similarity", "access_similarity", "candidate_reliability", "similarity_score"), *_r("area_similarity", digits=4), F.col("c_tong_gia").alias("comparable_total_value"))


def comparable_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(frames(spark, sf_dir).summaries)


def comparable_test_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(frames(spark, sf_dir).summaries_test)


def _summaries(s: DataFrame) -> DataFrame:
    return s.select("row_id", "comparable_count", "max_search_radius_m", render_flags(F.col("comparable_flags")).alias("comparable_warning_flag"), *_r("total_value_band_p25", "total_value_band_median", "total_value_band_p75", digits=3), *_r("comparable_confidence", "same_cluster_ratio", "access_band_match_ratio", "special_comparable_ratio", "band_confidence", "mean_candidate_reliability", "same_segment_ratio", "heterogeneous_comparable_ratio", "weighted_band_width_ratio"))


def comparable_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = diagnostics.comparable_quality(frames(spark, sf_dir).judged)
    return q.select("row_id", "comparable_count", "max_search_radius_m", *_r("comparable_confidence", "band_confidence", "weighted_band_width_ratio"))


def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames(spark, sf_dir).judged
    return c.select("row_id", confidence.confidence_group(F.col("confidence_score")).alias("confidence_group"), confidence.confidence_bucket(F.col("confidence_score")).alias("confidence_bucket"), *_r("confidence_score", "ape", "log_error"), *_r("abs_error", digits=3))


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.explain(frames(spark, sf_dir).judged).select("row_id", "explanation_text")


_METRICS = ("mae", "rmse", "mape", "median_ae", "mean_abs_log_error")


def group_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = frames(spark, sf_dir).judged.withColumn("confidence_group", confidence.confidence_group(F.col("confidence_score")))
    e = diagnostics.error_reports(j, ("nam", "segment_key", "assigned_cluster", "access_band", "special_asset_flag", "segment_heterogeneity_flag", "confidence_group", "case_type"))
    return e.select("group_name", "group_value", "n", *_r(*_METRICS, digits=4))


def overall_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames(spark, sf_dir).judged.withColumn("everything", F.lit("all"))
    return diagnostics.group_metrics(e, "everything", extra=("confidence_score",)).select("group_name", "n", *_r(*_METRICS, "mean_confidence_score", digits=4))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.calibration(frames(spark, sf_dir).judged).select("bucket", "n", *_r("mean_confidence", "mean_ape", "median_ape", "band_coverage"))


def workflow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    w = diagnostics.workflow_metrics(f.judged, f.master)
    return w.select("n_rows", "rows_missing_geo", "rows_heterogeneous", "n_segments", "segment_outliers", "segments_missing_geo", *_r("coordinate_match_rate"))


def focus_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the firsts of parts, so that a part's rows are in shuffles at a time."""
    firsts = (diagnostics.focus_row(part.select("row_id", "confidence_score", "warning_flags")) for part in frames(spark, sf_dir).judged_parts())
    return diagnostics.focus_row(staged_parts(firsts, "focus")).select("row_id", *_r("confidence_score"))


def map_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.map_inputs(frames(spark, sf_dir).judged).select("row_id", *_r("confidence_score"))


def _evidence(f: Frames) -> tuple[DataFrame, DataFrame]:
    inputs = f.master.where("segment_lat_for_model is not null").select(F.col("segment_key").alias("row_id"), F.col("pho").alias("pho_canonical"), F.col("segment_lat_for_model").alias("lat"), F.col("segment_lon_for_model").alias("lon"))
    return inputs, roads.evidence(inputs, roads.standardise(f.roads), f.config)


def road_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = _evidence(frames(spark, sf_dir))
    return e.select("row_id", "road_id", "match_type", "match_confidence", "included", "exclusion_reason", *_r("clipped_length_m", "distance_m", digits=3))


def road_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = _evidence(frames(spark, sf_dir))
    return roads.summarise(i, e).select("row_id", "road_count", "included_roads", "excluded_roads", render_flags(F.col("road_flags")).alias("road_flag"), *_r("mean_match_confidence", "road_evidence_confidence"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.affinity(graph.knn(_vectors(spark, sf_dir), 10)).select("i", "j", *_r("w"))


def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.local_density(graph.affinity(graph.knn(_vectors(spark, sf_dir), 10))).select("i", *_r("density"))


def boosted_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph blended with its label-boosted copy, normalised by degrees."""
    v = _vectors(spark, sf_dir)
    near = graph.affinity(graph.knn(v, 10))
    g = graph.blend({"feature": near, "access": graph.boost_same(near, v.select("i", "label"))}, {"feature": 0.7, "access": 0.3}, nodes=v)
    return graph.normalise(g).select("i", "j", *_r("w"))


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    train = frames(spark, sf_dir).scaled.where("split = 'train'")
    v = appraisal.vectors(train, scaling.fit_location(train))
    return v, graph.hybrid(v, frames(spark, sf_dir).config)


def hybrid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend of the feature, access, location and spatial graphs of all train rows."""
    return _hybrid(spark, sf_dir)[1]["final"].select("i", "j", *_r("w"))


def hybrid_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, graphs = _hybrid(spark, sf_dir)
    return graph.hybrid_report(graphs, v, frames(spark, sf_dir).config.spectral_dim, frames(spark, sf_dir).config)


def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.report(graph.affinity(graph.knn(_vectors(spark, sf_dir), 10))).select("edges", "nodes", *_r("total_weight", digits=4))


def cluster_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment to four fixed centres: the axes' ends in the first two dimensions."""
    centers = [(k, [x if d == k // 2 else 0.0 for d in range(64)]) for k, x in enumerate((1.0, -1.0, 1.0, -1.0))]
    out = clusters.normalise_distance(clusters.assign(_vectors(spark, sf_dir), centers))
    return out.select(F.col("i").alias("vec_id"), "assigned_cluster", *_r("cluster_center_distance_raw", "cluster_confidence", "distance_to_cluster_center"))


def spectral_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph.spectral(graph.affinity(graph.knn(_vectors(spark, sf_dir), 10)))
    return clusters.assign(s, graph.centers(graph.kmeans(s, 8))).select("i", "assigned_cluster", "cluster_confidence")


def cluster_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice of a number of clusters over the spectral vectors; labels stand in for segments, a function of the id for the value."""
    v = _vectors(spark, sf_dir)
    s = graph.spectral(graph.affinity(graph.knn(v, 10))).join(v.select("i", F.col("label").cast("string").alias("segment_key")), "i")
    return graph.sweep(s.withColumn("tong_gia", (F.col("i") % 37 + 1) * 1e8))


def _modelled(f: Frames) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with their comparable features."""
    rows = f.scaled.drop("core", "access")
    train = staged(rows.where("split = 'train'").join(f.summaries.drop("comparable_flags"), "row_id", "left"), "modelled")
    test = rows.where("split = 'test'").join(f.summaries_test.drop("comparable_flags"), "row_id", "left")
    return train, test


def value_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    train, test = _modelled(f)
    return model.predict(model.fit(train, model.feature_sets()["model_5"], f.config), test).select("row_id", "tong_gia", "predicted")


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return model.ablation(*_modelled(f), f.config)


def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)

    def rebuild(train: DataFrame, rows: DataFrame, exclude_self: bool) -> DataFrame:
        pairs = comparables.search(rows, train, f.embedding, f.config, exclude_self)
        return staged(rows.join(comparables.summary(pairs, f.config).drop("comparable_flags"), "row_id", "left"), "folded")

    train = f.scaled.where("split = 'train' and tong_gia > 0")
    return model.out_of_fold(train, model.feature_sets()["model_5"], rebuild, f.config).select("row_id", "fold", "tong_gia", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        text_normalize, coordinates_parse, canonical_streets, alias_report, segment_master, segment_neighbors, neighbor_features, located_properties, segment_frequencies, engineered_features,
        segment_heterogeneity, heterogeneity_templates, property_heterogeneity, segment_bands, value_quantiles, cluster_profiles, property_clusters, cluster_diagnostics, special_assets,
        segment_embedding, location_templates, inference_cases, inference_clusters, scaled_features, location_features, comparable_radius, comparable_results, comparable_summaries, comparable_test_results, comparable_test_summaries, comparable_quality, confidence_scores, explanations,
        group_errors, overall_errors, calibration, workflow_metrics, focus_row, map_inputs, road_evidence, road_summary, knn_graph, graph_density, boosted_graph, hybrid_graph, hybrid_report, graph_report, cluster_assignment, spectral_clusters,
        cluster_sweep, value_model, out_of_fold, ablation,
    )
}
