"""Queries against their SQL on the smallest tables, and invariants."""

import os

import duckdb
import pytest

from landgrain.plans.oracles_search import ORACLE_SQL
from landgrain.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
FAST = ["text_normalize", "coordinates_parse", "canonical_streets", "alias_report", "segment_master", "segment_neighbors", "neighbor_features", "segment_frequencies", "segment_heterogeneity", "heterogeneity_templates", "value_quantiles", "cluster_profiles", "cluster_assignment", "location_features", "cluster_diagnostics", "segment_embedding", "inference_cases", "inference_clusters", "knn_graph", "graph_density", "boosted_graph", "graph_report"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem documents embeddings".split():
        c.execute(f"create view {n} as select * from '{DATA}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, duck, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    key = [c for c in cols if a[c].dtype == object or "int" in str(a[c].dtype)] or cols
    a, b = (x[cols].sort_values(key).reset_index(drop=True) for x in (a, b))
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_neighbors_are_symmetric(spark):
    rows = {(r["segment_key"], r["neighbor_segment_key"]): r["distance_m"] for r in QUERIES["segment_neighbors"](spark, DATA).collect()}
    assert rows and all(rows[b, a] == d and d <= 2000 for (a, b), d in rows.items())


def test_new_segments_take_near_ones(spark):
    """Test rows of new segments with a coordinate against brute force over the train segments."""
    from landgrain.functions.geo import haversine_m
    from landgrain.operators import comparables
    from landgrain.plans.frames import frames
    from pyspark.sql import functions as F

    f = frames(spark, DATA)
    seg = f.embedding.where("segment_lat_for_model is not null").select("segment_key", F.col("segment_lat_for_model").alias("y"), F.col("segment_lon_for_model").alias("x"))
    new = f.scaled.where("split = 'test' and has_valid_coordinate").join(f.embedding.select("segment_key"), "segment_key", "left_anti")
    known = f.scaled.where("split = 'test'").join(f.embedding.select("segment_key"), "segment_key").limit(1)
    first = new.limit(3).collect()
    if not first:  # the tables have none: a known place under a new name, and one far off
        new = known.withColumn("segment_key", F.lit("quan x|phuong y|new"))
    far = new.limit(1).withColumns({"row_id": F.lit("far") if dict(new.dtypes)["row_id"] == "string" else F.lit(-1).cast(dict(new.dtypes)["row_id"]), "segment_lat_for_model": F.col("segment_lat_for_model") + 20})
    queries = new.limit(3).unionByName(far)
    queries = spark.createDataFrame(queries.collect(), queries.schema)
    candidates = f.scaled.where("split = 'train' and tong_gia > 0")
    dist = {}
    for r in queries.crossJoin(seg.withColumnRenamed("segment_key", "near")).select("row_id", "near", haversine_m(F.col("segment_lat_for_model"), F.col("segment_lon_for_model"), F.col("y"), F.col("x")).alias("d")).collect():
        dist.setdefault(r["row_id"], []).append((r["d"], r["near"]))
    rows = {}
    for r in candidates.select("row_id", "segment_key").collect():
        rows.setdefault(r["segment_key"], set()).add(r["row_id"])
    want = {}
    for q, d in dist.items():
        inside = next((x for x in ([k for k in d if k[0] <= r] for r in f.config.radii_m) if len(x) >= 5), [k for k in d if k[0] <= 2000])
        want[q] = {c for _, k in (inside or sorted(d)[:5]) for c in rows.get(k, ())}
    got = {}
    pairs = comparables.search(queries, candidates, f.embedding, f.config, exclude_self=False)
    for r in comparables.pool(queries, candidates, f.embedding, f.config, exclude_self=False).select("q_row_id", "c_row_id", "pool_source").collect():
        assert r["pool_source"] == "near" or not want[r["q_row_id"]]
        if r["pool_source"] == "near":
            got.setdefault(r["q_row_id"], set()).add(r["c_row_id"])
    assert got and got == {q: c for q, c in want.items() if c}
    flags = {r["row_id"]: set(r["comparable_flags"]) for r in comparables.summary(pairs).collect()}
    assert {"FAR_FROM_KNOWN_SEGMENTS", "OUT_OF_TRAIN_AREA", "FALLBACK_RADIUS_USED"} <= flags[far.first()["row_id"]]


def test_models_run_the_whole_job(spark, monkeypatch):
    """The registered model queries use the defaults and all features; out_of_fold rebuilds those of its fold."""
    from dataclasses import replace

    from landgrain.config import Config
    from landgrain.operators import model

    seen, real = [], model.fit

    def fit(train, numbers, config=Config(), seed=None):
        assert config == Config() and set(model.COMPARABLE) <= set(train.columns) and numbers[-1] == model.COMPARABLE[-1]
        seen.append({r["row_id"]: r["total_value_band_median"] for r in train.collect()})
        return real(train, numbers, replace(config, model_iterations=2), seed)

    monkeypatch.setattr(model, "fit", fit)
    oof = QUERIES["out_of_fold"](spark, DATA).select("row_id", "fold").collect()
    assert len(seen) == Config().folds == len({r["fold"] for r in oof})
    held = {r["row_id"]: r["fold"] for r in oof}
    assert all(set(s) == {i for i, k in held.items() if k != n} for n, s in enumerate(seen))
    both = set(seen[0]) & set(seen[1])
    assert any(seen[0][i] != seen[1][i] for i in both)  # each fold's own comparables
    seen.clear()
    got = QUERIES["value_model"](spark, DATA).count()
    assert len(seen) == 1 and got > 0


def test_choice_of_a_cluster_count(spark):
    """Three well separated groups: their number is found, and the figures are those of plain code."""
    import random
    import statistics
    from math import log1p, tanh

    from landgrain.operators import graph

    assert list(graph.candidate_counts(500, 10, 12)) == [3, 4, 5, 6, 7] and list(graph.candidate_counts(10, 1, 12)) == [3]
    r = random.Random(5)
    rows = [(i, [10.0 * (i % 3) + r.gauss(0, 0.1), r.gauss(0, 0.1)], f"s{i % 6}", 1e8 * 4 ** (i % 3) * r.uniform(0.9, 1.1)) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, vector array<double>, segment_key string, tong_gia double")
    report = {x["n_clusters"]: x for x in graph.sweep(df, starts=3).collect()}
    best = report[3]
    assert best["selected"] and sum(x["selected"] for x in report.values()) == 1 and sorted(report) == [3, 4]
    logs = [[log1p(x[3]) for x in rows if x[0] % 3 == k] for k in range(3)]
    middle = [statistics.median(x) for x in logs]
    within = statistics.fmean(statistics.median(abs(v - m) for v in x) for x, m in zip(logs, middle, strict=True))
    assert best["price_separation_score"] == pytest.approx(tanh(statistics.pstdev(middle) / within / 2))
    assert (best["min_cluster_size"], best["median_cluster_size"], best["max_cluster_size"]) == (40, 40, 40) and best["dominant_segment_share_mean"] == pytest.approx(0.5)
    assert best["cluster_score"] == pytest.approx(0.32 * (best["silhouette_score"] + 1) / 2 + 0.28 * best["price_separation_score"] + 0.18 * best["mean_cluster_confidence"] + 0.12 + 0.10 * 0.5)
    assert graph.sweep(df.limit(4)).collect()[0]["n_clusters"] == 2


def test_hybrid_graph_is_the_blend_of_four(spark):
    """The four graphs and their blend against numpy, over several blocks."""
    import numpy as np

    from landgrain.config import Config
    from landgrain.operators import graph

    r, n = np.random.default_rng(3), 90
    core, access, location = r.normal(size=(n, 8)), r.integers(0, 3, (n, 4)).astype(float), r.integers(0, 2, (n, 6)).astype(float)
    at = [None if i % 10 == 0 else (10.8 + r.uniform(0, 0.02), 106.6 + r.uniform(0, 0.02)) for i in range(n)]
    rows = [(i, core[i].tolist(), access[i].tolist(), location[i].tolist(), *(at[i] or (None, None))) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, core array<double>, access array<double>, location array<double>, lat double, lon double")

    def affinity(x, ids, k):
        m, near = np.zeros((n, n)), []
        for a in range(len(ids)):
            d = sorted((float(np.sqrt(((x[a] - x[b]) ** 2).sum())), ids[b]) for b in range(len(ids)) if b != a)[:k]
            near += [(ids[a], b, v) for v, b in d]
        sigma = np.median([v for _, _, v in near if v > 0])
        for a, b, v in near:
            m[a, b] = np.exp(-v * v / (2 * sigma**2))
        return (m + m.T) / 2

    has = [i for i in range(n) if at[i]]
    middle = np.median([at[i][0] for i in has])
    plane = np.array([(at[i][0] * 110_540, at[i][1] * 111_320 * np.cos(np.radians(middle))) for i in has])
    want = {"feature": affinity(core, range(n), 25), "access": affinity(access, range(n), 20), "location": affinity(location, range(n), 20), "spatial": affinity(plane, has, 25)}
    alpha = Config().alpha
    want["final"] = sum(alpha[k] * m for k, m in want.items()) + np.eye(n) * 1e-3
    old, graph.BLOCK_ROWS = graph.BLOCK_ROWS, 40
    try:
        got = graph.hybrid(df)
    finally:
        graph.BLOCK_ROWS = old
    for name, m in want.items():
        g = np.zeros((n, n))
        for e in got[name].collect():
            g[e["i"], e["j"]] = e["w"]
        assert np.allclose(g, m, atol=1e-9), name
    report = graph.hybrid_report(got, df, 6).first()
    assert report["train_rows"] == n and report["final_edges"] == np.count_nonzero(want["final"]) // 2 and report["n_neighbors_access"] == 20 and len(report) == 15
    # the distributed embedding spans the same vectors as the dense one
    a, b = ({x["i"]: x["vector"] for x in graph.spectral(got["final"], 4, dense).collect()} for dense in (1000, 10))
    assert all(np.allclose(a[i], b[i], atol=1e-5) for i in range(n))


def test_fit_save_load_apply_and_stream(spark, tmp_path):
    """Train rows are clustered and fitted, everything is saved and loaded, test rows are appraised, in a batch and as a stream."""
    from dataclasses import replace

    from landgrain.config import Config
    from landgrain.operators import graph
    from landgrain.plans import appraisal
    from landgrain.plans.frames import frames
    from landgrain.sources import artifacts
    from landgrain.streaming import appraise

    config = replace(Config(), model_iterations=2)
    f = frames(spark, DATA)
    tables, fitted = appraisal.fit(f.train, f.keyed, config, starts=2)
    k = graph.cluster_count(f.train.select("segment_key").distinct().count())
    assert tables["centers"].count() == k == tables["profiles"].count()
    assert tables["candidates"].where("cluster_confidence is null or spectral_2 is null or local_embedding_density is null").isEmpty()
    artifacts.save(str(tmp_path / "saved"), tables, fitted, config)
    tables, fitted, config = artifacts.load(spark, str(tmp_path / "saved"))
    test = f.keyed.where("split = 'test'")
    done = appraisal.apply(test, tables, fitted, config)
    rows = {r["row_id"]: r for r in done.select("row_id", "predicted", "cluster", "cluster_confidence", "confidence_score", "explanation_text").collect()}
    assert len(rows) == test.count() and all(r["predicted"] > 0 and 0 <= r["cluster"] < k and 0 <= r["confidence_score"] <= 1 and r["explanation_text"] for r in rows.values())
    test.repartition(1).write.parquet(str(tmp_path / "incoming"))
    stream = spark.readStream.schema(test.schema).parquet(str(tmp_path / "incoming"))
    q = appraise.start(stream, tables, fitted, str(tmp_path / "out"), str(tmp_path / "state"), config)
    q.processAllAvailable()
    q.stop()
    streamed = {r["row_id"]: r["predicted"] for r in spark.read.parquet(str(tmp_path / "out")).select("row_id", "predicted").collect()}
    assert streamed.keys() == rows.keys() and all(streamed[i] == pytest.approx(rows[i]["predicted"]) for i in rows)
