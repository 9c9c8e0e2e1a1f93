"""Scalar rules against values worked out by hand."""

import math

from pyspark.sql import functions as F

from landgrain.config import load_config
from landgrain.functions import geo, stats, text
from landgrain.sources.properties import clean_headers, schema_report, typed


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    for raw, want in {"Đường Số 12 ": "duong so 12", "Q.5": "quan 5", "q 5": "quan 5", "P.3": "phuong 3", "  a--b/ç ": "a b/c", None: "", "": ""}.items():
        assert one(spark, text.normalize_text(F.lit(raw).cast("string"))) == want
    assert one(spark, text.normalize_admin(F.lit("Quận 5"), "quan")) == "quan 5"
    assert one(spark, text.normalize_admin(F.lit("5"), "quan")) == "quan 5"
    assert one(spark, text.segment_key(F.lit("Q.5"), F.lit("P.3"), F.lit(None).cast("string"))) == "quan 5|phuong 3|"


def test_flags_and_coordinates(spark):
    assert one(spark, text.render_flags(F.array(F.lit("A"), F.lit("OK"), F.lit("B"), F.lit("A"), F.lit(None).cast("string")))) == "A|B"
    assert one(spark, text.render_flags(F.array().cast("array<string>"))) == "OK"
    assert one(spark, text.parse_coordinate(F.lit("10801234"))) == 10.801234
    assert one(spark, text.parse_coordinate(F.lit("x"))) is None
    assert one(spark, text.format_money(F.lit(1234567.5))) == "1,234,568"


def test_geometry(spark):
    a = [F.lit(x) for x in (10.8, 106.6, 10.81, 106.61)]
    d = one(spark, geo.haversine_m(*a))
    assert abs(d - 1558.0) < 5 and d == one(spark, geo.haversine_m(a[2], a[3], a[0], a[1]))
    assert one(spark, geo.haversine_m(a[0], a[1], F.lit(None).cast("double"), a[3])) is None
    inside, near = geo.chord(*[F.lit(x) for x in (-5.0, 3.0, 5.0, 3.0, 0.0, 0.0)], 5.0)
    assert one(spark, inside) == 8.0 and one(spark, near) == 3.0
    inside, near = geo.chord(*[F.lit(x) for x in (-5.0, 5.0, 5.0, 5.0, 0.0, 0.0)], 5.0)
    assert one(spark, inside) == 0.0 and one(spark, near) == 5.0


def test_clip_keeps_null(spark):
    assert one(spark, stats.clip01(F.lit(None).cast("double"))) is None
    assert one(spark, stats.clip01(F.lit(2.0))) == 1.0


def test_weighted_quantile(spark):
    rows = [("a", 1, 10.0, 1.0), ("a", 2, 20.0, 1.0), ("a", 3, 30.0, 2.0), ("a", 4, 99.0, 0.0), ("b", 5, 7.0, 3.0), ("c", 6, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, id int, v double, w double")
    got = {r["k"]: r for r in stats.weighted_quantiles(df, ["k"], "v", "w", {"lo": 0.05, "mid": 0.5, "hi": 0.9}, "id").collect()}
    # midpoints at 1/8, 3/8, 3/4
    assert got["a"]["lo"] == 10.0 and math.isclose(got["a"]["mid"], 20 + 10 / 3) and got["a"]["hi"] == 30.0
    assert got["b"]["mid"] == 7.0 and "c" not in got


def test_config_precedence(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"top_k": 7, "folds": 3}')
    c = load_config(str(p), folds=4)
    assert (c.top_k, c.folds, c.seed) == (7, 4, 42)


def test_headers_and_types(spark):
    df = clean_headers(spark.createDataFrame([("Q1", None, "b", "10801234", "nan")], "`﻿Quận` string, lat string, latitude string, longitude string, `Tổng giá trị` string"))
    assert df.columns == ["quan", "manual_lat", "manual_lon", "tong_gia"] and df.first()["manual_lat"] == "b"
    assert schema_report(["quan"], "coordinates")["status"] == "ERROR"
    full = spark.createDataFrame([("1", "2", "s", "10.8", "106.6")], "quan string, phuong string, pho string, manual_lat string, manual_lon string")
    t = typed(full, "coordinates").first()
    assert t["manual_lat"] == 10.8 and t["tong_gia"] is None and t["row_id"].startswith("coordinates_")
