"""The queries' answers in DuckDB SQL, written on their own from the definitions."""

from __future__ import annotations

from ..sources.properties import PROPERTIES_SQL


def norm(x: str) -> str:
    t = f"strip_accents(replace(lower(coalesce(CAST({x} AS VARCHAR), '')), 'đ', 'd'))"
    t = rf"regexp_replace(regexp_replace(trim({t}), '\bq(\.\s*|\s+)', 'quan ', 'g'), '\bp(\.\s*|\s+)', 'phuong ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({t}, '[^0-9a-z/ ]+', ' ', 'g'), '\s+', ' ', 'g'))"


def admin(x: str, prefix: str) -> str:
    return f"CASE WHEN {norm(x)} = '' OR starts_with({norm(x)}, '{prefix} ') THEN {norm(x)} ELSE '{prefix} ' || {norm(x)} END"


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL AND {d} IS NOT NULL THEN 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))) END)"


def clip01(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x})::DOUBLE)) END)"


def flag_text(*pairs: tuple[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs)
    return f"coalesce(nullif(array_to_string(list_filter([{items}], lambda f: f IS NOT NULL), '|'), ''), 'OK')"


PROPS = PROPERTIES_SQL.format(orders="orders", customer="customer", nation="nation", region="region", lineitem="lineitem")

#: Common table expressions by name; each lists what it needs before it
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "props": ((), PROPS),
    "keyed": (("props",), f"""SELECT *, qn || '|' || pn || '|' || sn AS segment_key, qn AS quan_norm, pn AS phuong_norm, sn AS pho_norm
        FROM (SELECT *, {admin('quan', 'quan')} AS qn, {admin('phuong', 'phuong')} AS pn, {norm('pho')} AS sn FROM props)"""),
    "train": (("keyed",), "SELECT * FROM keyed WHERE split = 'train'"),
    "clean": (("train",), "SELECT * FROM train WHERE tong_gia > 0"),
    "coords": (("keyed",), "SELECT * FROM (SELECT segment_key, quan, phuong, pho, manual_lat AS segment_lat, manual_lon AS segment_lon, row_number() OVER (PARTITION BY segment_key ORDER BY row_pos) AS k FROM keyed) WHERE k = 1"),
    "m0": (("coords", "train"), """SELECT segment_key, c.quan, c.phuong, c.pho, coalesce(t.n, 0)::INT AS n, segment_lat, segment_lon, segment_lat IS NOT NULL AND segment_lon IS NOT NULL AS found
        FROM coords c FULL JOIN (SELECT segment_key, count(*) AS n FROM train GROUP BY 1) t USING (segment_key)"""),
    "mid": (("m0",), "SELECT quantile_cont(segment_lat, 0.5) AS la, quantile_cont(segment_lon, 0.5) AS lo FROM m0 WHERE segment_lat BETWEEN 10.0 AND 11.5 AND segment_lon BETWEEN 106.0 AND 107.2"),
    "m1": (("m0", "mid"), f"SELECT m0.*, {hav('segment_lat', 'segment_lon', 'la', 'lo')} AS d FROM m0, mid"),
    "master": (("m1",), """SELECT *, CASE WHEN found AND NOT outlier AND NOT outside THEN segment_lat END AS lat, CASE WHEN found AND NOT outlier AND NOT outside THEN segment_lon END AS lon FROM (
        SELECT m1.*, coalesce(d > lim, false) AS outlier, found AND NOT (segment_lat BETWEEN 10.0 AND 11.5 AND segment_lon BETWEEN 106.0 AND 107.2) AS outside, count(*) FILTER (found) OVER (PARTITION BY segment_lat, segment_lon) AS same
        FROM m1, (SELECT greatest(quantile_cont(d, 0.75) + 4 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)), 5000) AS lim FROM m1))"""),
    "nb": (("master",), f"SELECT * FROM (SELECT a.segment_key AS segment_key, b.segment_key AS neighbor_segment_key, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM master a JOIN master b ON a.segment_key <> b.segment_key) WHERE d <= 2000"),
    "nf": (("nb",), "SELECT segment_key, count(*) FILTER (d <= 300)::INT AS n300, count(*) FILTER (d <= 500)::INT AS n500, count(*) FILTER (d <= 1000)::INT AS n1000, min(d) AS nearest FROM nb GROUP BY 1"),
    "located": (("keyed", "master"), "SELECT k.*, coalesce(m.lat, k.manual_lat) AS lat, coalesce(m.lon, k.manual_lon) AS lon, m.outlier, m.found, m.same, m.outside FROM keyed k LEFT JOIN master m USING (segment_key)"),
    "eng": (("located", "train"), f"""SELECT *, (pc < 15)::INT AS pho_rare, (wc < 10)::INT AS phuong_rare,
        CASE WHEN lt_chuan >= 4 OR (do_rong_ngo_nho_nhat_m >= 8 AND khoang_cach_den_duong_chinh_m <= 60) THEN 'mat_tien' WHEN lt_chuan >= 3 OR do_rong_ngo_nho_nhat_m >= 6 OR khoang_cach_den_duong_chinh_m <= 30 THEN 'hem_lon' WHEN lt_chuan >= 2 OR do_rong_ngo_nho_nhat_m >= 4 THEN 'hem_trung_binh' ELSE 'hem_nho_sau' END AS access_band,
        {clip01(f"0.5::DOUBLE * (coalesce(lt_chuan, 1) - 1) / 3 + 0.3::DOUBLE * {clip01('coalesce(do_rong_ngo_nho_nhat_m, 0) / 8')} + 0.2::DOUBLE * (1 - {clip01('coalesce(khoang_cach_den_duong_chinh_m, 300) / 250')})")} AS access_score,
        ln(1 + CASE WHEN dien_tich_m2 IS NOT NULL THEN greatest(dien_tich_m2, 0) END) AS log_dien_tich, ln(1 + greatest(khoang_cach_den_duong_chinh_m, 0)) AS log_khoang_cach, ln(1 + greatest(do_rong_ngo_nho_nhat_m, 0)) AS log_do_rong_ngo, mat_tien_m / nullif(chieu_dai_m, 0) AS ti_le_mat_tien,
        mat_tien_m * so_mat_tien_tiep_giap AS mat_tien_x_so_mat_tien, do_rong_ngo_nho_nhat_m * lt_chuan AS ngo_x_lt
        FROM (SELECT l.*, coalesce(a.n, 0) AS pc, coalesce(b.n, 0) AS wc FROM located l LEFT JOIN (SELECT segment_key, count(*) AS n FROM train GROUP BY 1) a USING (segment_key) LEFT JOIN (SELECT phuong_norm, count(*) AS n FROM train GROUP BY 1) b USING (phuong_norm))"""),
    "h0": (("clean",), """SELECT *, std / greatest(mean, 1e-6) AS cv, (p75 - p25) / greatest(median, 1e-6) AS iqr FROM (SELECT segment_key, min(phuong_norm) AS phuong_norm, min(quan_norm) AS quan_norm, count(*) AS n, avg(u) AS mean, quantile_cont(u, 0.5) AS median, stddev_samp(u) AS std,
        quantile_cont(u, 0.25) AS p25, quantile_cont(u, 0.75) AS p75 FROM (SELECT *, tong_gia / nullif(dien_tich_m2, 0) AS u FROM clean) GROUP BY 1)"""),
    "h1": (("h0",), "SELECT quantile_cont(cv, 0.75) AS cv75, quantile_cont(cv, 0.9) AS cv90, quantile_cont(iqr, 0.75) AS i75, quantile_cont(iqr, 0.9) AS i90 FROM h0 WHERE n >= 3"),
    "het": (("h0", "h1"), """SELECT *, CASE flag WHEN 'STABLE_SEGMENT' THEN 1.0::DOUBLE WHEN 'HETEROGENEOUS_MEDIUM' THEN 0.88 WHEN 'HETEROGENEOUS_HIGH' THEN 0.75 ELSE 0.82 END AS penalty FROM (
        SELECT h0.*, h1.*, greatest(0, least(2, 0.6::DOUBLE * coalesce(cv, cv75) / greatest(cv90, 1e-6) + 0.4::DOUBLE * coalesce(iqr, i75) / greatest(i90, 1e-6))) AS score,
        CASE WHEN n < 3 THEN 'LOW_SAMPLE_SEGMENT' WHEN cv > cv90 OR iqr > i90 THEN 'HETEROGENEOUS_HIGH' WHEN cv > cv75 OR iqr > i75 THEN 'HETEROGENEOUS_MEDIUM' ELSE 'STABLE_SEGMENT' END AS flag FROM h0, h1)"""),
    "tpl": (("het",), """SELECT 'phuong' AS level, a.key AS key, n, cv, iqr, score, penalty, flag FROM (SELECT phuong_norm AS key, avg(n) AS n, avg(cv) AS cv, avg(iqr) AS iqr, avg(score) AS score, avg(penalty) AS penalty FROM het GROUP BY 1) a
        JOIN (SELECT key, flag FROM (SELECT phuong_norm AS key, flag, row_number() OVER (PARTITION BY phuong_norm ORDER BY count(*) DESC, flag) AS k FROM het GROUP BY 1, 2) WHERE k = 1) b ON a.key = b.key
        UNION ALL SELECT 'quan', a.key, n, cv, iqr, score, penalty, flag FROM (SELECT quan_norm AS key, avg(n) AS n, avg(cv) AS cv, avg(iqr) AS iqr, avg(score) AS score, avg(penalty) AS penalty FROM het GROUP BY 1) a
        JOIN (SELECT key, flag FROM (SELECT quan_norm AS key, flag, row_number() OVER (PARTITION BY quan_norm ORDER BY count(*) DESC, flag) AS k FROM het GROUP BY 1, 2) WHERE k = 1) b ON a.key = b.key
        UNION ALL SELECT 'global', '', n, cv, iqr, score, penalty, flag FROM (SELECT quantile_cont(n::DOUBLE, 0.5) AS n, quantile_cont(coalesce(cv, cv75), 0.5) AS cv, quantile_cont(coalesce(iqr, i75), 0.5) AS iqr, quantile_cont(score, 0.5) AS score, quantile_cont(penalty, 0.5) AS penalty FROM het),
        (SELECT flag FROM het GROUP BY 1 ORDER BY count(*) DESC, flag LIMIT 1)"""),
    "ph": (("keyed", "het", "tpl"), """SELECT k.row_id, coalesce(h.flag, w.flag, d.flag, g.flag) AS flag, CASE WHEN h.flag IS NOT NULL THEN 'SEGMENT_LOOKUP' WHEN w.flag IS NOT NULL THEN 'PHUONG_TEMPLATE' WHEN d.flag IS NOT NULL THEN 'QUAN_TEMPLATE' ELSE 'GLOBAL_TEMPLATE' END AS source,
        coalesce(h.cv, w.cv, d.cv, g.cv) AS cv, coalesce(h.score, w.score, d.score, g.score) AS score, coalesce(h.penalty, w.penalty, d.penalty, g.penalty) AS penalty
        FROM keyed k LEFT JOIN het h USING (segment_key) LEFT JOIN tpl w ON w.level = 'phuong' AND w.key = k.phuong_norm LEFT JOIN tpl d ON d.level = 'quan' AND d.key = k.quan_norm LEFT JOIN tpl g ON g.level = 'global'"""),
    "desc0": (("eng", "ph", "nf"), """SELECT e.*, ph.flag AS hflag, ph.score AS hscore, ph.penalty AS hpenalty, coalesce(n1000, 0) AS n1000, (row_id % 4)::INT AS cluster, (row_id % 10) / 10.0::DOUBLE AS conf, (row_id % 13) / 8.0::DOUBLE AS dist, (row_id % 6) / 5.0::DOUBLE AS dens
        FROM eng e JOIN ph USING (row_id) LEFT JOIN nf USING (segment_key)"""),
    "described": (("desc0",), f"""SELECT *, CASE WHEN special >= 0.70 THEN 'SPECIAL_HIGH' WHEN special >= 0.45 THEN 'SPECIAL_MEDIUM' ELSE 'MAIN_MARKET' END AS sflag FROM (SELECT *, {clip01(f"0.28::DOUBLE * (1 - {clip01('conf')}) + 0.22::DOUBLE * {clip01('dist / 1.5::DOUBLE')} + 0.15::DOUBLE * (1 - {clip01('n1000 / 8.0::DOUBLE')}) + 0.12::DOUBLE * {clip01('0.6::DOUBLE * pho_rare + 0.4::DOUBLE * phuong_rare')} + 0.10::DOUBLE * (1 - {clip01('dens')}) + 0.08::DOUBLE * least(greatest(hscore, 0), 1.5) / 1.5::DOUBLE + 0.13::DOUBLE * (1 - {clip01('access_score')})")} AS special FROM desc0)"""),
    "emb0": (("located", "nf"), "SELECT l.*, (row_id % 4)::INT AS cluster, (row_id % 10) / 10.0::DOUBLE AS conf, (row_id % 17) / 17.0::DOUBLE AS s1, (row_id % 5) / 5.0::DOUBLE AS s2 FROM located l WHERE split = 'train'"),
    "emb": (("emb0",), """SELECT * FROM (SELECT segment_key, min(quan_norm) AS quan_norm, min(phuong_norm) AS phuong_norm, min(lat) AS lat, min(lon) AS lon, count(*) AS n, avg(s1) AS s1, avg(s2) AS s2, avg(conf) AS conf FROM emb0 GROUP BY 1)
        JOIN (SELECT segment_key, cluster FROM (SELECT segment_key, cluster, row_number() OVER (PARTITION BY segment_key ORDER BY count(*) DESC, cluster) AS k FROM emb0 GROUP BY 1, 2) WHERE k = 1) USING (segment_key)"""),
}


def with_ctes(*names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for x in CTE[n][0]:
            add(x)
        order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round(({x})::DOUBLE, {digits}) AS {name}"


def _quartiles(value: str, keys: str, source: str) -> str:
    return f"SELECT {keys}, quantile_cont({value}, 0.25) AS p25, quantile_cont({value}, 0.5) AS p50, quantile_cont({value}, 0.75) AS p75, count(*) AS n FROM {source} GROUP BY ALL"


_WQ = """, b AS (SELECT segment_key, tong_gia AS v, w, row_id, sum(w) OVER (PARTITION BY segment_key ORDER BY tong_gia, w DESC, row_id ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY segment_key) AS s, row_number() OVER (PARTITION BY segment_key ORDER BY tong_gia, w DESC, row_id) AS k
  FROM (SELECT *, (row_id % 6)::DOUBLE AS w FROM clean) WHERE w > 0),
p AS (SELECT segment_key, v, (c - w / 2) / s AS p, k FROM b),
q AS (SELECT *, lead(p) OVER (PARTITION BY segment_key ORDER BY k) AS p2, lead(v) OVER (PARTITION BY segment_key ORDER BY k) AS v2 FROM p)
SELECT segment_key, """ + ", ".join(f"round(coalesce(max(CASE WHEN p <= {x} AND p2 > {x} THEN v + ({x} - p) / (p2 - p) * (v2 - v) END), max(CASE WHEN k = 1 AND p > {x} THEN v END), max(CASE WHEN p2 IS NULL AND p <= {x} THEN v END)), 7) AS {n}" for n, x in (("p25", "0.25::DOUBLE"), ("p50", "0.5::DOUBLE"), ("p75", "0.75::DOUBLE"))) + " FROM q GROUP BY segment_key"

_MASTER_FLAGS = flag_text(("MISSING_SEGMENT_GEO", "NOT found"), ("LAT_LON_OUT_OF_RANGE", "outside"), ("DUPLICATED_COORDINATE", "found AND same > 1"), ("WARD_COORD_OUTLIER", "outlier"), ("COORD_NEEDS_MANUAL_REVIEW", "outlier OR outside"))

_CASES = f""", seg AS (SELECT segment_key AS k, lat AS y, lon AS x, s1, s2, conf FROM emb WHERE lat IS NOT NULL AND lon IS NOT NULL),
pl AS (SELECT DISTINCT l.lat AS lat, l.lon AS lon FROM located l LEFT JOIN emb e USING (segment_key) WHERE e.n IS NULL AND l.lat IS NOT NULL AND l.lon IS NOT NULL),
pr AS (SELECT pl.lat, pl.lon, seg.*, {hav('pl.lat', 'pl.lon', 'y', 'x')} AS d FROM pl, seg),
us AS (SELECT lat, lon, CASE WHEN count(*) FILTER (d <= 300) >= 5 THEN 300 WHEN count(*) FILTER (d <= 500) >= 5 THEN 500 WHEN count(*) FILTER (d <= 1000) >= 5 THEN 1000 WHEN count(*) FILTER (d <= 1500) >= 5 THEN 1500 ELSE 2000 END AS used FROM pr GROUP BY 1, 2),
pu AS (SELECT pr.*, used, count(*) FILTER (d <= used) OVER (PARTITION BY pr.lat, pr.lon) AS inside, row_number() OVER (PARTITION BY pr.lat, pr.lon ORDER BY d, k) AS rk FROM pr JOIN us USING (lat, lon)),
n2 AS (SELECT lat, lon, any_value(used) AS used, any_value(inside) AS inside, sum(s1 * exp(-d / 700)) / sum(exp(-d / 700)) AS s1, sum(s2 * exp(-d / 700)) / sum(exp(-d / 700)) AS s2, sum(conf * exp(-d / 700)) / sum(exp(-d / 700)) AS conf,
  count(*) FILTER (d <= 500)::INT AS n500, count(*) FILTER (d <= 1000)::INT AS n1000, min(d) AS nearest FROM pu WHERE d <= used OR (inside = 0 AND rk <= 5) GROUP BY 1, 2),
tw AS (SELECT phuong_norm, avg(s1) AS s1, avg(s2) AS s2, avg(conf) AS conf FROM emb GROUP BY 1), td AS (SELECT quan_norm, avg(s1) AS s1, avg(s2) AS s2, avg(conf) AS conf FROM emb GROUP BY 1), tg AS (SELECT avg(s1) AS s1, avg(s2) AS s2, avg(conf) AS conf FROM emb)
SELECT l.row_id, CASE WHEN e.n IS NOT NULL THEN 'CASE_1_SEGMENT_IN_TRAIN' WHEN n2.s1 IS NOT NULL THEN 'CASE_2_NEW_SEGMENT_WITH_COORD' ELSE 'CASE_3_LOCATION_FALLBACK' END AS case_type,
  CASE WHEN e.n IS NOT NULL THEN 'SEGMENT_LOOKUP' WHEN n2.s1 IS NOT NULL THEN 'KNN_WEIGHTED_SPATIAL' ELSE 'LOCATION_FALLBACK' END AS assigned_cluster_method,
  CASE WHEN e.n IS NOT NULL THEN 'OK' WHEN n2.s1 IS NOT NULL THEN {flag_text(('FAR_FROM_KNOWN_SEGMENTS', 'n2.inside = 0'), ('OUT_OF_TRAIN_AREA', 'n2.inside = 0'), ('FALLBACK_RADIUS_USED', 'n2.used > 1000'), ('LOW_NEIGHBOR_COUNT', 'n2.inside BETWEEN 1 AND 4'))} ELSE 'MISSING_SEGMENT_GEO|LOW_CONFIDENCE_PREDICTION' END AS inference_flag,
  CASE WHEN e.n IS NOT NULL THEN coalesce(nf.n500, 0) WHEN n2.s1 IS NOT NULL THEN n2.n500 ELSE 0 END AS neighbor_count_500m, CASE WHEN e.n IS NOT NULL THEN coalesce(nf.n1000, 0) WHEN n2.s1 IS NOT NULL THEN n2.n1000 ELSE 0 END AS neighbor_count_1000m,
  round(CASE WHEN e.n IS NOT NULL THEN nf.nearest WHEN n2.s1 IS NOT NULL THEN n2.nearest END, 3) AS nearest_segment_distance_m,
  {r('CASE WHEN e.n IS NOT NULL THEN e.s1 WHEN n2.s1 IS NOT NULL THEN n2.s1 ELSE coalesce(tw.s1, td.s1, tg.s1) END', 'spectral_1', 9)}, {r('CASE WHEN e.n IS NOT NULL THEN e.s2 WHEN n2.s1 IS NOT NULL THEN n2.s2 ELSE coalesce(tw.s2, td.s2, tg.s2) END', 'spectral_2', 9)},
  {r('CASE WHEN e.n IS NOT NULL THEN e.conf WHEN n2.s1 IS NOT NULL THEN n2.conf ELSE coalesce(tw.conf, td.conf, tg.conf) * 0.5::DOUBLE END', 'cluster_confidence', 9)}
FROM located l LEFT JOIN emb e USING (segment_key) LEFT JOIN nf USING (segment_key) LEFT JOIN n2 ON e.n IS NULL AND n2.lat = l.lat AND n2.lon = l.lon LEFT JOIN tw ON tw.phuong_norm = l.phuong_norm LEFT JOIN td ON td.quan_norm = l.quan_norm, tg"""


def _cluster_cases() -> str:
    """The cases' rows with the nearest of three fixed centres."""
    ctes, last = _CASES.replace(", 9)", ", 15)").rsplit("\nSELECT l.row_id", 1)
    at = ((0, 0.44, 0.37), (1, 0.49, 0.41), (2, 0.47, 0.46))
    d = ", ".join(f"{{'d': sqrt(pow(spectral_1 - {x}::DOUBLE, 2) + pow(spectral_2 - {y}::DOUBLE, 2)), 'id': {k}}}" for k, x, y in at)
    near = f"cs AS (SELECT l.row_id{last}), nr AS (SELECT row_id, case_type, list_sort([{d}]) AS c FROM cs)"
    confidence = f"{clip01('1 - c[1].d / greatest(c[2].d, 1e-6)')} * CASE WHEN starts_with(case_type, 'CASE_3') THEN 0.5::DOUBLE ELSE 1 END"
    return f"{ctes},\n{near}\nSELECT row_id, case_type, c[1].id::INT AS assigned_cluster, {r(confidence, 'cluster_confidence')}, {r('c[1].d', 'cluster_center_distance_raw')} FROM nr"


ORACLE_SQL: dict[str, str] = {
    "text_normalize": f"SELECT doc_id, md5({norm('text')}) AS text_md5, {admin('source', 'quan')} AS admin FROM documents",
    "coordinates_parse": with_ctes("props") + "SELECT row_id, CASE WHEN row_id % 3 = 2 THEN NULL WHEN row_id % 3 = 0 THEN round(round(manual_lat * 1000000) / 1000000, 6) ELSE round(manual_lat, 6) END AS lat FROM props",
    "canonical_streets": with_ctes("props") + f"SELECT norm, raw AS canonical FROM (SELECT norm, raw, row_number() OVER (PARTITION BY norm ORDER BY count(*) DESC, min(row_pos)) AS k FROM (SELECT {norm('pho_input')} AS norm, trim(pho_input) AS raw, row_pos FROM props) GROUP BY 1, 2) WHERE k = 1",
    "alias_report": with_ctes("props") + f""", s AS (SELECT {norm('pho_input')} AS norm, trim(pho_input) AS raw, row_pos FROM props), g AS (SELECT norm, raw, count(*) AS n, min(row_pos) AS f FROM s GROUP BY 1, 2),
        b AS (SELECT norm, arg_max(raw, (n, -f)) AS canonical, count(*) AS k FROM g GROUP BY 1)
        SELECT raw AS raw_street, norm AS normalized_street, canonical AS canonical_street, CASE WHEN norm = '' THEN 'MISSING_STREET_NAME' WHEN raw <> canonical THEN 'ALIAS_MERGED' WHEN k > 1 THEN 'CANONICAL_WITH_ALIAS_GROUP' ELSE 'CANONICAL' END AS alias_status, n AS row_count FROM g JOIN b USING (norm)""",
    "segment_master": with_ctes("master") + f"""SELECT segment_key, quan, phuong, pho, n AS train_sample_count, CASE WHEN found THEN 'manual_coordinate_dictionary' ELSE 'unmatched' END AS coord_source, found AS coord_found, CASE WHEN found THEN 'MATCHED_MANUAL_COORD' ELSE 'MISSING_SEGMENT_GEO' END AS coord_match_status,
        {_MASTER_FLAGS} AS coord_warning_flag, {r('segment_lat', 'segment_lat')}, {r('segment_lon', 'segment_lon')}, {r('lat', 'segment_lat_for_model')}, {r('lon', 'segment_lon_for_model')}, {r('d', 'distance_to_ward_median_m', 3)} FROM master""",
    "segment_neighbors": with_ctes("nb") + f"""SELECT segment_key, neighbor_segment_key, row_number() OVER (PARTITION BY segment_key ORDER BY d, neighbor_segment_key)::INT AS neighbor_rank,
        CASE WHEN d <= 300 THEN '0_300m' WHEN d <= 500 THEN '300_500m' WHEN d <= 800 THEN '500_800m' WHEN d <= 1000 THEN '800_1000m' WHEN d <= 1500 THEN '1000_1500m' ELSE '1500_2000m_fallback' END AS radius_bucket, {r('d', 'distance_m', 3)}, {r('exp(-d * d / (2 * 700.0::DOUBLE * 700))', 'spatial_weight')} FROM nb""",
    "neighbor_features": with_ctes("nf") + f"SELECT segment_key, n300 AS neighbor_count_300m, n500 AS neighbor_count_500m, n1000 AS neighbor_count_1000m, {r('nearest', 'nearest_segment_distance_m', 3)} FROM nf",
    "located_properties": with_ctes("located") + f"SELECT row_id, segment_key, lat IS NOT NULL AND lon IS NOT NULL AS has_valid_coordinate, {_MASTER_FLAGS} AS coord_warning_flag, CASE WHEN tong_gia > 0 THEN 'OK' ELSE 'ZERO_TOTAL_VALUE_REMOVED' END AS target_flag, {r('lat', 'segment_lat_for_model')}, {r('lon', 'segment_lon_for_model')}, {r('ln(1 + tong_gia)', 'log_tong_gia')} FROM located",
    "segment_frequencies": with_ctes("train") + "SELECT 'segment' AS level, segment_key AS key, count(*) AS n FROM train GROUP BY 2 UNION ALL SELECT 'phuong', phuong_norm, count(*) FROM train GROUP BY 2 UNION ALL SELECT 'quan', quan_norm, count(*) FROM train GROUP BY 2",
    "engineered_features": with_ctes("eng") + "SELECT row_id, access_band, pc AS pho_count_train, wc AS phuong_count_train, pho_rare, phuong_rare, " + ", ".join(r(c, c) for c in ("log_dien_tich", "log_khoang_cach", "log_do_rong_ngo", "ti_le_mat_tien", "mat_tien_x_so_mat_tien", "ngo_x_lt", "access_score")) + " FROM eng",
    "segment_heterogeneity": with_ctes("het") + f"SELECT segment_key, n AS segment_sample_count_train, flag AS segment_heterogeneity_flag, penalty AS segment_heterogeneity_penalty, {', '.join(r(c, c, 3) for c in ('mean', 'median', 'std', 'p25', 'p75'))}, {r('cv', 'segment_price_cv')}, {r('iqr', 'segment_price_iqr_ratio')}, {r('score', 'segment_heterogeneity_score')} FROM het",
    "heterogeneity_templates": with_ctes("tpl") + f"SELECT level, key, flag AS segment_heterogeneity_flag, {r('n', 'segment_sample_count_train')}, {r('cv', 'segment_price_cv')}, {r('iqr', 'segment_price_iqr_ratio')}, {r('score', 'segment_heterogeneity_score')}, {r('penalty', 'segment_heterogeneity_penalty')} FROM tpl",
    "property_heterogeneity": with_ctes("ph") + f"SELECT row_id, flag AS segment_heterogeneity_flag, source AS segment_heterogeneity_source, {r('cv', 'segment_price_cv')}, {r('score', 'segment_heterogeneity_score')}, {r('penalty', 'segment_heterogeneity_penalty')} FROM ph",
    "segment_bands": with_ctes("clean") + f""", s AS ({_quartiles('tong_gia', 'segment_key', 'clean')}), c AS ({_quartiles('tong_gia', 'row_id % 4 AS cluster', 'clean')}),
        d AS (SELECT segment_key, cluster FROM (SELECT segment_key, row_id % 4 AS cluster, row_number() OVER (PARTITION BY segment_key ORDER BY count(*) DESC, row_id % 4) AS k FROM clean GROUP BY 1, 2) WHERE k = 1)
        SELECT segment_key, cluster::INT AS dominant_cluster, s.n AS segment_value_count, {r('s.p25', 'segment_value_p25', 4)}, {r('s.p50', 'segment_value_p50', 4)}, {r('s.p75', 'segment_value_p75', 4)}, {r('c.p25', 'cluster_value_p25', 4)}, {r('c.p50', 'cluster_value_p50', 4)}, {r('c.p75', 'cluster_value_p75', 4)},
        {r(clip01(f"0.6::DOUBLE * {clip01('s.n / 10.0::DOUBLE')} + 0.4::DOUBLE * {clip01('1 - (s.p75 - s.p25) / greatest(s.p50, 1)')}"), 'segment_band_confidence')} FROM s JOIN d USING (segment_key) JOIN c USING (cluster)""",
    "value_quantiles": with_ctes("clean") + _WQ,
    "cluster_profiles": with_ctes("train") + f""", t AS (SELECT (row_id % 4)::INT AS cluster, (row_id % 13) / 8.0::DOUBLE AS d, (row_id % 10) / 10.0::DOUBLE AS conf, CASE WHEN tong_gia > 0 THEN tong_gia END AS v FROM train)
        SELECT cluster, count(*) AS cluster_sample_count, {r('greatest(quantile_cont(d, 0.75), 1e-6)', 'cluster_distance_scale')}, {r('avg(conf)', 'cluster_mean_confidence')}, {r('quantile_cont(v, 0.25)', 'cluster_total_value_p25', 4)}, {r('quantile_cont(v, 0.5)', 'cluster_total_value_median', 4)}, {r('quantile_cont(v, 0.75)', 'cluster_total_value_p75', 4)} FROM t GROUP BY 1""",
    "property_clusters": with_ctes("train") + f""", t AS (SELECT row_id % 4 AS cluster, count(*) AS n, greatest(quantile_cont((row_id % 13) / 8.0::DOUBLE, 0.75), 1e-6) AS scale, quantile_cont(CASE WHEN tong_gia > 0 THEN tong_gia END, 0.5) AS m FROM train GROUP BY 1)
        SELECT row_id, n::INT AS cluster_sample_count, {r('(row_id % 13) / 8.0::DOUBLE / scale', 'distance_to_cluster_center')}, {r('m', 'cluster_total_value_median', 4)} FROM keyed JOIN t ON t.cluster = row_id % 4""",
    "cluster_diagnostics": with_ctes("clean") + f""", t AS (SELECT (row_id % 4)::INT AS cluster, segment_key, ln(1 + tong_gia) AS x FROM clean), m AS (SELECT cluster, count(*) AS n, quantile_cont(x, 0.5) AS med FROM t GROUP BY 1),
        a AS (SELECT cluster, quantile_cont(abs(x - med), 0.5) AS mad FROM t JOIN m USING (cluster) GROUP BY 1), p AS (SELECT stddev_pop(med) / greatest(sum(mad * n) / sum(n), 1e-6) AS ratio FROM m JOIN a USING (cluster)),
        s AS (SELECT cluster, max(k)::DOUBLE / sum(k) AS share FROM (SELECT cluster, segment_key, count(*) AS k FROM t GROUP BY 1, 2) GROUP BY 1)
        SELECT cluster, n, {r('med', 'median_log')}, {r('mad', 'mad_log')}, {r('share', 'dominant_segment_share')}, {r('ratio', 'price_ratio')}, {r('(exp(ratio) - 1) / (exp(ratio) + 1)', 'price_score')} FROM m JOIN a USING (cluster) JOIN s USING (cluster), p""",
    "special_assets": with_ctes("described") + f"""SELECT row_id, sflag AS special_asset_flag, {flag_text(('LOW_CLUSTER_CONFIDENCE', 'conf < 0.35'), ('CLUSTER_EDGE_POINT', 'dist > 1.15'), ('LOW_LOCAL_DENSITY', 'dens < 0.18'), ('LOW_SPATIAL_NEIGHBOR_COUNT', 'n1000 <= 1'), ('RARE_STREET_PATTERN', 'pho_rare = 1'), ('HETEROGENEOUS_SEGMENT', "hflag = 'HETEROGENEOUS_HIGH'"))} AS special_asset_reason, {r('special', 'special_asset_score')} FROM described""",
    "segment_embedding": with_ctes("emb") + f"SELECT segment_key, quan_norm, phuong_norm, n AS train_sample_count, cluster, {r('lat', 'segment_lat_for_model')}, {r('s1', 'spectral_1', 9)}, {r('s2', 'spectral_2', 9)}, {r('conf', 'cluster_confidence', 9)} FROM emb",
    "location_templates": with_ctes("emb") + ", u AS (SELECT 'phuong' AS level, phuong_norm AS key, * FROM emb UNION ALL SELECT 'quan', quan_norm, * FROM emb UNION ALL SELECT 'global', '', * FROM emb), c AS (SELECT level, key, cluster FROM (SELECT level, key, cluster, row_number() OVER (PARTITION BY level, key ORDER BY count(*) DESC, cluster) AS k FROM u GROUP BY 1, 2, 3) WHERE k = 1)"
        + f" SELECT u.level AS level, u.key AS key, any_value(c.cluster) AS cluster, {r('avg(s1)', 'spectral_1')}, {r('avg(conf)', 'cluster_confidence')} FROM u JOIN c ON c.level = u.level AND c.key = u.key GROUP BY 1, 2",
    "inference_cases": with_ctes("located", "emb", "nf") + _CASES,
    "inference_clusters": with_ctes("located", "emb", "nf") + _cluster_cases(),
}
