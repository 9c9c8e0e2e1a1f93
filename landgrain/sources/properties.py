"""Property tables: from CSV files, from other Parquet tables, and a stand-in made of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_coordinate

#: Accepted headers of the input files and their canonical columns (fixed values)
HEADERS = {
    "Quận": "quan",
    "district": "quan",
    "Phường": "phuong",
    "ward": "phuong",
    "duong_pho_clean": "pho",
    "street": "pho",
    "Phố": "pho_input",
    "Tổng giá trị": "tong_gia",
    "Đơn giá": "don_gia",
    "Diện tích (m2)": "dien_tich_m2",
    "Kích thước mặt tiền (m)": "mat_tien_m",
    "Kích thước chiều dài": "chieu_dai_m",
    "Số mặt tiền tiếp giáp": "so_mat_tien_tiep_giap",
    "Khoảng cách đến đường chính (m)": "khoang_cach_den_duong_chinh_m",
    "Độ rộng ngõ/ngách nhỏ nhất": "do_rong_ngo_nho_nhat_m",
    "LT_chuan": "lt_chuan",
    "Chi_so_hinhdang": "chi_so_hinhdang",
    "Chi_so_loithe": "chi_so_loithe",
    "Phân loại kho": "phan_loai_kho",
    "Mục đích sử dụng đất": "muc_dich_su_dung_dat",
    "Năm": "nam",
    "manual_lat": "manual_lat",
    "lat": "manual_lat",
    "latitude": "manual_lat",
    "manual_lon": "manual_lon",
    "lon": "manual_lon",
    "longitude": "manual_lon",
}

TEXT = ("quan", "phuong", "pho", "pho_input", "phan_loai_kho", "muc_dich_su_dung_dat")
NUMBERS = ("tong_gia", "don_gia", "dien_tich_m2", "mat_tien_m", "chieu_dai_m", "so_mat_tien_tiep_giap", "khoang_cach_den_duong_chinh_m", "do_rong_ngo_nho_nhat_m", "lt_chuan", "chi_so_hinhdang", "chi_so_loithe")
REQUIRED = {
    "train": ("quan", "phuong", "pho", "tong_gia", "dien_tich_m2", "mat_tien_m", "chieu_dai_m", "so_mat_tien_tiep_giap", "khoang_cach_den_duong_chinh_m", "do_rong_ngo_nho_nhat_m", "lt_chuan"),
    "test": ("quan", "phuong", "pho", "dien_tich_m2", "mat_tien_m", "chieu_dai_m", "so_mat_tien_tiep_giap", "khoang_cach_den_duong_chinh_m", "do_rong_ngo_nho_nhat_m", "lt_chuan"),
    "coordinates": ("quan", "phuong", "pho", "manual_lat", "manual_lon"),
}


def clean_headers(df: DataFrame) -> DataFrame:
    """Canonical column names; several headers of one column become their first non-null value, left to right."""
    groups: dict[str, list[str]] = {}
    for i, c in enumerate(df.columns):
        name = c.replace("﻿", "").strip()
        groups.setdefault(HEADERS.get(name, name), []).append(f"__{i}")
    return df.toDF(*[f"__{i}" for i in range(len(df.columns))]).select(*[F.coalesce(*[F.col(x) for x in own]).alias(k) for k, own in groups.items()])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with headers, all text, with canonical names."""
    return clean_headers(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def schema_report(columns: list[str], kind: str) -> dict:
    missing = [c for c in REQUIRED[kind] if c not in columns]
    return {"kind": kind, "missing": missing, "has_target": "tong_gia" in columns, "status": "ERROR" if missing else "OK"}


def typed(df: DataFrame, kind: str) -> DataFrame:
    """Declared types, absent optional columns as typed nulls, a row_pos where there is none; fails on missing required columns."""
    report = schema_report(df.columns, kind)
    if report["missing"]:
        raise ValueError(f"{kind}: missing columns {', '.join(report['missing'])}")
    get = lambda c, t: (F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    cols = {c: get(c, "string") for c in TEXT} | {c: finite(get(c, "double")) for c in NUMBERS} | {"nam": get("nam", "double").cast("int")}
    cols |= {c: parse_coordinate(F.col(c)) if c in df.columns else F.lit(None).cast("double") for c in ("manual_lat", "manual_lon")}
    own = [c for c in ("row_id", "row_pos") if c in df.columns]
    out = df.select(*own, *[v.alias(k) for k, v in cols.items()])
    if "row_pos" not in own:
        out = out.withColumn("row_pos", F.monotonically_increasing_id())
    if "row_id" not in own:
        out = out.withColumn("row_id", F.format_string(f"{kind}_%04d", F.col("row_pos") + 1))
    return out


#: One SQL text for the stand-in, in the common part of the SQL dialects
PROPERTIES_SQL = """
SELECT o.o_orderkey AS row_id, o.o_orderkey AS row_pos, r.r_name AS quan, n.n_name AS phuong, c.c_mktsegment AS pho,
  CASE o.o_orderkey % 3 WHEN 0 THEN lower(c.c_mktsegment) WHEN 1 THEN c.c_mktsegment ELSE concat(' ', c.c_mktsegment) END AS pho_input,
  CASE WHEN o.o_orderkey % 97 = 0 THEN 0e0 ELSE o.o_totalprice END AS tong_gia, CAST(NULL AS DOUBLE) AS don_gia, li.q AS dien_tich_m2,
  CAST(2 + o.o_orderkey % 9 AS DOUBLE) AS mat_tien_m, CAST(5 + o.o_custkey % 20 AS DOUBLE) AS chieu_dai_m, CAST(1 + o.o_orderkey % 2 AS DOUBLE) AS so_mat_tien_tiep_giap,
  CAST((o.o_orderkey * 37) % 300 AS DOUBLE) AS khoang_cach_den_duong_chinh_m, CAST(o.o_orderkey % 12 AS DOUBLE) AS do_rong_ngo_nho_nhat_m, CAST(1 + o.o_orderkey % 4 AS DOUBLE) AS lt_chuan,
  CAST(o.o_orderkey % 7 AS DOUBLE) / 7e0 AS chi_so_hinhdang, CAST(o.o_custkey % 5 AS DOUBLE) / 5e0 AS chi_so_loithe,
  o.o_orderstatus AS phan_loai_kho, o.o_orderpriority AS muc_dich_su_dung_dat, CAST(year(o.o_orderdate) AS INT) AS nam,
  CASE WHEN (n.n_nationkey * 5 + s.sg) % 31 = 7 THEN NULL ELSE 10.78e0 + CAST((n.n_nationkey * 7 + s.sg * 3) % 23 AS DOUBLE) * 0.002e0 END AS manual_lat,
  CASE WHEN (n.n_nationkey * 5 + s.sg) % 31 = 7 THEN NULL ELSE 106.58e0 + CAST((n.n_nationkey * 11 + s.sg * 5) % 29 AS DOUBLE) * 0.002e0 END AS manual_lon,
  CASE WHEN o.o_orderkey % 5 = 0 OR (n.n_nationkey % 13 = 5 AND s.sg = 2) THEN 'test' ELSE 'train' END AS split
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
JOIN (SELECT 'AUTOMOBILE' AS name, 0 AS sg UNION ALL SELECT 'BUILDING', 1 UNION ALL SELECT 'FURNITURE', 2 UNION ALL SELECT 'HOUSEHOLD', 3 UNION ALL SELECT 'MACHINERY', 4) s ON s.name = c.c_mktsegment
LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
"""


def star_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in property table: an order is a property, its customer's region, nation and market segment its address."""
    names = ("orders", "customer", "nation", "region", "lineitem")
    return spark.sql(PROPERTIES_SQL, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
