"""DuckDB SQL of comparables, confidence, diagnostics, roads and graphs."""

from __future__ import annotations

from .oracles import CTE, ORACLE_SQL, clip01, flag_text, hav, norm, r, with_ctes

_CORE = ("log_dien_tich", "mat_tien_m", "chieu_dai_m", "so_mat_tien_tiep_giap", "chi_so_hinhdang", "chi_so_loithe", "ti_le_mat_tien", "mat_tien_x_so_mat_tien")
_ACCESS = ("log_khoang_cach", "log_do_rong_ngo", "lt_chuan", "ngo_x_lt")
_D = "::DOUBLE"


def _sum(weights: str) -> str:
    return " + ".join(f"{w}{_D} * {x}" for w, x in (p.split("*") for p in weights.split()))


def _norm2(columns: tuple[str, ...]) -> str:
    return "sqrt(" + " + ".join(f"pow(q.z_{c} - c.z_{c}, 2)" for c in columns) + ")"


CTE |= {
    "med": (("described",), "SELECT " + ", ".join(f"coalesce(quantile_cont({c}::DOUBLE, 0.5), 0) AS m_{c}" for c in _CORE + _ACCESS) + " FROM described WHERE split = 'train'"),
    "spr": (("described", "med"), "SELECT " + ", ".join(f"quantile_cont(coalesce({c}::DOUBLE, m_{c}), 0.75) - quantile_cont(coalesce({c}::DOUBLE, m_{c}), 0.25) AS s_{c}" for c in _CORE + _ACCESS) + " FROM described, med WHERE split = 'train'"),
    "scaled": (("described", "med", "spr"), "SELECT d.*, " + ", ".join(f"(coalesce({c}::DOUBLE, m_{c}) - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END AS z_{c}" for c in _CORE + _ACCESS) + " FROM described d, med, spr"),
    "reach": (("emb",), f"SELECT segment_key AS a, segment_key AS b, 0::DOUBLE AS d FROM emb UNION ALL SELECT * FROM (SELECT x.segment_key AS a, y.segment_key AS b, {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS d FROM emb x JOIN emb y ON x.segment_key <> y.segment_key) WHERE d <= 2000"),
    "rc": (("reach", "clean"), "SELECT a, " + ", ".join(f"coalesce(sum(n) FILTER (d <= {x}), 0) AS n{x}" for x in (0, 300, 500, 1000, 1500, 2000)) + " FROM reach JOIN (SELECT segment_key AS b, count(*) AS n FROM clean GROUP BY 1) USING (b) GROUP BY 1"),
    "rad": (("train", "rc"), "SELECT row_id, segment_key, (CASE " + " ".join(f"WHEN n{x} - (tong_gia > 0)::INT >= 5 THEN {x}" for x in (0, 300, 500, 1000, 1500, 2000)) + " ELSE 2000 END)::INT AS used FROM train LEFT JOIN rc ON rc.a = train.segment_key"),
    # the stand-in's train rows all have a known segment with candidates within reach: the test of the query asserts it
    "p0": (("scaled", "rad", "reach"), f"""SELECT q.row_id AS q, c.row_id AS c, rad.used AS used, q.dien_tich_m2 AS qa, c.dien_tich_m2 AS ca, q.mat_tien_m AS qf, c.mat_tien_m AS cf, q.chieu_dai_m AS qd, c.chieu_dai_m AS cd, c.tong_gia AS v, c.segment_key AS cseg,
        coalesce(q.muc_dich_su_dung_dat = c.muc_dich_su_dung_dat, false) AS f1, coalesce(q.phan_loai_kho = c.phan_loai_kho, false) AS f2, coalesce(q.access_band = c.access_band, false) AS f3,
        (q.cluster = c.cluster)::INT AS sc, (q.segment_key = c.segment_key)::INT AS ss, q.sn = c.sn AS street, q.phuong_norm = c.phuong_norm AS ward, q.quan_norm = c.quan_norm AS district, {_norm2(_CORE)} AS dc, {_norm2(_ACCESS)} AS da,
        coalesce({hav('q.lat', 'q.lon', 'c.lat', 'c.lon')}, CASE WHEN q.segment_key = c.segment_key THEN 0 END) AS dist, c.special AS cs, q.special AS qs, c.hflag AS ch, q.hflag AS qh, c.pc AS cpc, c.conf AS cconf, c.hpenalty AS cpen
        FROM scaled q JOIN rad USING (row_id) JOIN reach ON reach.a = q.segment_key AND reach.d <= rad.used JOIN scaled c ON c.segment_key = reach.b WHERE q.split = 'train' AND c.split = 'train' AND c.tong_gia > 0 AND q.row_id <> c.row_id"""),
    "p1": (("p0",), "SELECT *, count(*) FILTER (f1) OVER (PARTITION BY q) >= 4 AS k1 FROM p0"),
    "p2": (("p1",), "SELECT *, count(*) FILTER (f2) OVER (PARTITION BY q) >= 4 AS k2 FROM p1 WHERE NOT k1 OR f1"),
    "p3": (("p2",), "SELECT *, count(*) FILTER (f3) OVER (PARTITION BY q) >= 3 AS k3 FROM p2 WHERE NOT k2 OR f2"),
    "p4": (("p3",), "SELECT *, CASE WHEN qa > 0 THEN qa ELSE quantile_cont(ca, 0.5) OVER (PARTITION BY q) END AS area FROM p3 WHERE NOT k3 OR f3"),
    "p5": (("p4",), "SELECT *, count(*) FILTER (ca BETWEEN area * (1 - 0.2::DOUBLE) AND area * (1 + 0.2::DOUBLE)) OVER (PARTITION BY q) >= 3 AS n20, count(*) FILTER (ca BETWEEN area * (1 - 0.35::DOUBLE) AND area * (1 + 0.35::DOUBLE)) OVER (PARTITION BY q) >= 3 AS n35, count(*) FILTER (ca BETWEEN area * (1 - 0.5::DOUBLE) AND area * (1 + 0.5::DOUBLE)) OVER (PARTITION BY q) >= 3 AS n50 FROM p4"),
    "p6": (("p5",), "SELECT *, quantile_cont(cf, 0.5) OVER (PARTITION BY q) AS mf, quantile_cont(cd, 0.5) OVER (PARTITION BY q) AS md FROM p5 WHERE CASE WHEN n20 THEN coalesce(ca BETWEEN area * (1 - 0.2::DOUBLE) AND area * (1 + 0.2::DOUBLE), false) WHEN n35 THEN coalesce(ca BETWEEN area * (1 - 0.35::DOUBLE) AND area * (1 + 0.35::DOUBLE), false) WHEN n50 THEN coalesce(ca BETWEEN area * (1 - 0.5::DOUBLE) AND area * (1 + 0.5::DOUBLE), false) ELSE true END"),
    "p7": (("p6",), """SELECT *, 1 / (1 + dc) AS fs, 1 / (1 + da) AS acs, abs(ln((ca + 1e-6) / greatest(area, 1e-6))) AS la, exp(-abs(ln((cf + 1e-6) / (CASE WHEN qf > 0 THEN qf WHEN mf > 0 THEN mf ELSE 1 END + 1e-6)))) AS fr, exp(-abs(ln((cd + 1e-6) / (CASE WHEN qd > 0 THEN qd WHEN md > 0 THEN md ELSE 1 END + 1e-6)))) AS de,
        CASE WHEN ss = 1 THEN 1.0::DOUBLE WHEN street THEN 0.9 WHEN ward THEN 0.6 WHEN district THEN 0.4 ELSE 0.2 END AS lo, coalesce(exp(-dist / 700), 0) AS sp, CASE WHEN ss = 1 THEN 'same_segment' WHEN dist <= 1000 THEN 'nearby_segment' WHEN sc = 1 THEN 'same_cluster' WHEN ward THEN 'same_phuong' ELSE 'fallback' END AS src FROM p6"""),
    "p8": (("p7",), f"""SELECT *, {clip01("(0.30::DOUBLE * least(greatest(cpc / 10.0::DOUBLE, 0.3), 1) + 0.25::DOUBLE * CASE src WHEN 'same_segment' THEN 1.0::DOUBLE WHEN 'nearby_segment' THEN 0.9 WHEN 'same_cluster' THEN 0.75 WHEN 'same_phuong' THEN 0.68 ELSE 0.55 END + 0.25::DOUBLE * least(greatest(cconf, 0.2), 1) + 0.20::DOUBLE * CASE WHEN f3 THEN 1 ELSE 0.7::DOUBLE END) * cpen * (1 - 0.08::DOUBLE * least(greatest(cs, 0), 1))")} AS rel, coalesce(exp(-la), 0) AS ar FROM p7"""),
    "p9": (("p8",), f"""SELECT *, CASE src WHEN 'same_segment' THEN {_sum('0.24*acs 0.20*fs 0.16*fr 0.12*ar 0.10*de 0.10*rel 0.08*lo')} WHEN 'nearby_segment' THEN {_sum('0.24*sp 0.18*acs 0.16*fs 0.12*lo 0.10*sc 0.10*rel 0.10*ar')} ELSE {_sum('0.18*sp 0.16*lo 0.16*acs 0.15*fs 0.10*sc 0.10*rel 0.08*ar 0.07*fr')} END
        - 0.06::DOUBLE * coalesce(least(dist / 2000, 1), 1) - 0.05::DOUBLE * coalesce(least(la, 1), 1) - 0.04::DOUBLE * least(abs(cs - qs), 1) - 0.04::DOUBLE * (1 - f3::INT) - 0.04::DOUBLE * (qh = 'HETEROGENEOUS_HIGH' AND NOT f3)::INT AS score FROM p8"""),
    "pairs": (("p9",), "SELECT *, greatest(score, 0) * (0.55::DOUBLE + 0.45::DOUBLE * rel) AS bw FROM p9"),
    "band": (("pairs",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bw DESC, dist NULLS LAST, c) AS br FROM pairs) WHERE br <= 12"),
    "wq0": (("band",), "SELECT q, v, (sum(bw) OVER (PARTITION BY q ORDER BY v, bw DESC, c ROWS UNBOUNDED PRECEDING) - bw / 2) / sum(bw) OVER (PARTITION BY q) AS p, row_number() OVER (PARTITION BY q ORDER BY v, bw DESC, c) AS k FROM band WHERE bw > 0"),
    "wq": (("wq0",), "SELECT q, " + ", ".join(f"coalesce(max(CASE WHEN p <= {x} AND p2 > {x} THEN v + ({x} - p) / (p2 - p) * (v2 - v) END), max(CASE WHEN k = 1 AND p > {x} THEN v END), max(CASE WHEN p2 IS NULL AND p <= {x} THEN v END)) AS {n}" for n, x in (("b25", "0.25::DOUBLE"), ("b50", "0.5::DOUBLE"), ("b75", "0.75::DOUBLE"))) + " FROM (SELECT *, lead(p) OVER (PARTITION BY q ORDER BY k) AS p2, lead(v) OVER (PARTITION BY q ORDER BY k) AS v2 FROM wq0) GROUP BY q"),
    "su0": (("band", "wq"), """SELECT b.*, b25, b50, b75, (b75 - b25) / greatest(b50, 1) AS width FROM (SELECT q, count(*) AS n, any_value(used) AS used, avg(sc) AS scr, avg(f3::INT) AS acr, avg((cs >= 0.45)::INT) AS spr, avg(rel) AS rel, avg(ss) AS ssr, avg((ch IN ('HETEROGENEOUS_MEDIUM', 'HETEROGENEOUS_HIGH'))::INT) AS her, avg(greatest(score, 0)) AS st,
        any_value(k1) AS k1, any_value(k2) AS k2, any_value(k3) AS k3, any_value(n20) AS n20, any_value(n35) AS n35, any_value(n50) AS n50 FROM band GROUP BY q) b LEFT JOIN wq USING (q)"""),
    "summ": (("su0",), f"""SELECT *, least(n, 5)::INT AS cnt, {clip01('0.45::DOUBLE * least(1, n / 12.0::DOUBLE) + 0.35::DOUBLE * st + 0.20::DOUBLE * (1 - least(1, used / 2000.0::DOUBLE))')} AS cc, {clip01('0.35::DOUBLE * least(1, n / 12.0::DOUBLE) + 0.25::DOUBLE * rel + 0.20::DOUBLE * acr + 0.10::DOUBLE * st + 0.10::DOUBLE * (1 - least(1, coalesce(width, 1)))')} AS bc FROM su0"""),
    "judged": (("described", "summ"), f"""SELECT d.*, s.*, coalesce(0.18::DOUBLE * CASE WHEN found AND same < 2 AND NOT outlier AND NOT outside THEN 1 ELSE 0.25::DOUBLE END + 0.13::DOUBLE + 0.12::DOUBLE * least(1, n1000 / 8.0::DOUBLE) + 0.18::DOUBLE * least(1, coalesce(cnt, 0) / 5.0::DOUBLE) + 0.09::DOUBLE * CASE WHEN NOT n20 AND n35 THEN 0.7::DOUBLE ELSE 1 END
        + 0.10::DOUBLE * {clip01('1 - coalesce(width, 1.5)')} + 0.10::DOUBLE * coalesce(scr, 0) + 0.08::DOUBLE * coalesce(acr, 0) + 0.08::DOUBLE * coalesce(bc, 0) + 0.07::DOUBLE * coalesce(rel, 0)
        - CASE hflag WHEN 'HETEROGENEOUS_HIGH' THEN 0.10::DOUBLE WHEN 'HETEROGENEOUS_MEDIUM' THEN 0.05 WHEN 'LOW_SAMPLE_SEGMENT' THEN 0.06 ELSE 0 END - 0.10::DOUBLE * special - CASE WHEN NOT found OR outlier THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN cnt < 5 THEN 0.10::DOUBLE ELSE 0 END
        - CASE WHEN acr < 0.5 THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN her > 0.6 THEN 0.06::DOUBLE ELSE 0 END - CASE WHEN width > 1.2 THEN 0.06::DOUBLE ELSE 0 END, 0) AS raw FROM described d LEFT JOIN summ s ON s.q = d.row_id WHERE d.split = 'train'"""),
    "jd": (("judged",), f"SELECT *, {clip01('raw')} AS cscore, abs(tong_gia - b50) AS ae, CASE WHEN tong_gia > 0 THEN abs(tong_gia - b50) / tong_gia END AS ape, CASE WHEN tong_gia > 0 AND b50 > 0 THEN ln(b50) - ln(tong_gia) END AS le FROM judged"),
    "jg": (("jd",), "SELECT *, CASE WHEN cscore >= 0.8 THEN 'high' WHEN cscore >= 0.6 THEN 'medium_high' WHEN cscore >= 0.4 THEN 'medium' WHEN cscore IS NULL THEN 'unknown' ELSE 'low' END AS cgroup, CASE WHEN cscore > -0.001 AND cscore <= 0.4 THEN 'low' WHEN cscore <= 0.7 THEN 'medium' WHEN cscore <= 1 THEN 'high' END AS cbucket FROM jd"),
    "rin": (("master",), f"SELECT segment_key, {norm('pho')} AS street, 6378137.0::DOUBLE * radians(lon) AS px, 6378137.0::DOUBLE * ln(tan(radians(45) + radians(lat) / 2)) AS py, lat, lon, (length(segment_key) * 7) % 5 - 2 AS k FROM master WHERE lat IS NOT NULL"),
    "rp": (("rin",), """SELECT segment_key AS road, street AS rname, 6378137.0::DOUBLE * radians(x1) AS ax, 6378137.0::DOUBLE * ln(tan(radians(45) + radians(y1) / 2)) AS ay, 6378137.0::DOUBLE * radians(x2) AS bx, 6378137.0::DOUBLE * ln(tan(radians(45) + radians(y2) / 2)) AS b_y FROM (
        SELECT segment_key, street, lon - 0.012::DOUBLE AS x1, lat - 0.003::DOUBLE * k AS y1, lon + 0.0005::DOUBLE * k AS x2, lat + 0.0001::DOUBLE AS y2 FROM rin UNION ALL SELECT segment_key, street, lon + 0.0005::DOUBLE * k, lat + 0.0001::DOUBLE, lon + 0.009::DOUBLE, lat + 0.004::DOUBLE * k FROM rin)"""),
    "rx": (("rin", "rp"), """SELECT segment_key, road, any_value(street) AS street, any_value(rname) AS rname, sum(CASE WHEN a > 0 AND disc > 0 AND least(1, (-b + sqrt(greatest(disc, 0))) / a) > greatest(0, (-b - sqrt(greatest(disc, 0))) / a) THEN (least(1, (-b + sqrt(greatest(disc, 0))) / a) - greatest(0, (-b - sqrt(greatest(disc, 0))) / a)) * sqrt(a) ELSE 0 END) AS len,
        min(sqrt(pow(fx + greatest(0, least(1, -b / a)) * dx, 2) + pow(fy + greatest(0, least(1, -b / a)) * dy, 2))) AS near FROM (SELECT *, b * b - a * (fx * fx + fy * fy - 1000000.0::DOUBLE) AS disc FROM (SELECT *, dx * dx + dy * dy AS a, fx * dx + fy * dy AS b FROM (SELECT i.segment_key, street, road, rname, bx - ax AS dx, b_y - ay AS dy, ax - px AS fx, ay - py AS fy FROM rin i, rp))) GROUP BY 1, 2 HAVING len > 0"""),
    "ev": (("rx",), """SELECT *, CASE kind WHEN 'NAME_EXACT' THEN 1.0::DOUBLE WHEN 'NAME_PARTIAL' THEN 0.85 WHEN 'POINT_ON_ROAD' THEN 0.8 WHEN 'ROAD_NEAR_NOTE' THEN 0.6 ELSE 0 END AS conf FROM (SELECT *, CASE WHEN street <> '' AND street = rname THEN 'NAME_EXACT' WHEN street <> '' AND rname <> '' AND (contains(street, rname) OR contains(rname, street)) THEN 'NAME_PARTIAL' WHEN near <= 15 THEN 'POINT_ON_ROAD' WHEN near <= 40 THEN 'ROAD_NEAR_NOTE' ELSE 'NO_MATCH' END AS kind FROM rx)"""),
    "vec": ((), "SELECT vec_id AS i, embedding::DOUBLE[] AS v, label FROM embeddings"),
    "kn": (("vec",), "SELECT i, j, d FROM (SELECT a.i AS i, b.i AS j, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.i ORDER BY list_distance(a.v, b.v), b.i) AS k FROM vec a JOIN vec b ON a.i <> b.i) WHERE k <= 10"),
    "kw": (("kn",), "SELECT i, j, exp(-d * d / (2 * s * s)) AS w FROM kn, (SELECT quantile_cont(d, 0.5) AS s FROM kn WHERE d > 0)"),
    "gr": (("kw",), "SELECT i, j, sum(w) / 2 AS w FROM (SELECT i, j, w FROM kw UNION ALL SELECT j, i, w FROM kw) GROUP BY 1, 2"),
}

_CASCADE = (("PURPOSE_MATCH_RELAXED", "NOT k1"), ("PROPERTY_TYPE_RELAXED", "NOT k2"), ("ACCESS_MATCH_RELAXED", "NOT k3"), ("AREA_MATCH_RELAXED", "NOT n20 AND n35"), ("AREA_MATCH_STRONGLY_RELAXED", "NOT n20 AND NOT n35 AND n50"))
_SUMMARY_FLAGS = flag_text(("FALLBACK_RADIUS_USED", "used > 1000"), *_CASCADE, ("LOW_COMPARABLE_COUNT", "cnt < 5"), ("ACCESS_MISMATCH_POOL", "acr < 0.5"), ("ACCESS_CONTEXT_WEAK", "acr < 0.4"), ("HETEROGENEOUS_COMPARABLE_POOL", "her > 0.6"), ("WIDE_PRICE_BAND", "width > 1.2"))
_ERRORS = f"count(*) AS n, {r('avg(ae)', 'mae', 4)}, {r('sqrt(avg(ae * ae))', 'rmse', 4)}, {r('avg(CASE WHEN tong_gia <> 0 THEN ae / abs(tong_gia) END) * 100', 'mape', 4)}, {r('quantile_cont(ae, 0.5)', 'median_ae', 4)}, {r('avg(abs(le))', 'mean_abs_log_error', 4)}"
_GROUPS = (("nam", "nam"), ("segment_key", "segment_key"), ("assigned_cluster", "cluster"), ("access_band", "access_band"), ("special_asset_flag", "sflag"), ("segment_heterogeneity_flag", "hflag"), ("confidence_group", "cgroup"), ("case_type", "'CASE_1_SEGMENT_IN_TRAIN'"))
_LEVELS = (("quan_norm", 2), ("phuong_norm", 4), ("pho_norm", 16))


def _location() -> str:
    ctes, cols, joins, at = [], [], [], 0
    for n, (level, most) in enumerate(_LEVELS):
        ctes.append(f"l{n} AS (SELECT {level} AS key, row_number() OVER (ORDER BY count(*) DESC, {level}) AS k, count(*) AS n, count(*) OVER () AS names, sum(count(*)) OVER () AS al FROM train GROUP BY 1), u{n} AS (SELECT *, CASE WHEN 2 * n > al THEN 1.0::DOUBLE WHEN 2 * n = al THEN 0.5 ELSE 0 END AS c FROM l{n} WHERE names > 1 AND k <= least({most}, names - 1))")
        joins.append(f"LEFT JOIN u{n} ON u{n}.key = keyed.{level}")
        for j in range(1, most + 1):
            if at < 10:
                cols.append(f"coalesce((u{n}.k = {j})::INT::DOUBLE, 0) - coalesce((SELECT c FROM u{n} WHERE k = {j}), 0) AS location_{at}")
            at += 1
    return with_ctes("keyed", "train") + ", " + ", ".join(ctes) + f" SELECT row_id, {', '.join(cols)} FROM keyed {' '.join(joins)}"


_CENTERS = [f"sqrt(list_sum(list_transform(v, lambda x: x * x)) - 2 * {s} * v[{d}] + 1)" for d, s in ((1, 1), (1, -1), (2, 1), (2, -1))]

ORACLE_SQL |= {
    "scaled_features": with_ctes("scaled") + "SELECT row_id, " + ", ".join([r(f"z_{c}", f"core_{i}") for i, c in enumerate(_CORE)] + [r(f"z_{c}", f"access_{i}") for i, c in enumerate(_ACCESS)]) + " FROM scaled",
    "location_features": _location(),
    "comparable_radius": with_ctes("rad") + "SELECT row_id, segment_key, used AS used_radius FROM rad",
    "comparable_results": with_ctes("pairs") + f"""SELECT q AS input_id, c AS comparable_row_id, cseg AS comparable_segment_key, src AS comparable_source, sc AS same_cluster, f3::INT AS same_access_band, {r('dist', 'distance_m', 3)}, {r('fs', 'feature_similarity')}, {r('acs', 'access_similarity')}, {r('exp(-la)', 'area_similarity', 4)}, {r('rel', 'candidate_reliability')}, {r('score', 'similarity_score')}, v AS comparable_total_value
        FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, dist NULLS LAST, c) AS k FROM pairs) WHERE k <= 5""",
    "comparable_summaries": with_ctes("summ") + f"""SELECT q AS row_id, cnt AS comparable_count, used AS max_search_radius_m, {_SUMMARY_FLAGS} AS comparable_warning_flag, {r('b25', 'total_value_band_p25', 3)}, {r('b50', 'total_value_band_median', 3)}, {r('b75', 'total_value_band_p75', 3)}, {r('cc', 'comparable_confidence')}, {r('scr', 'same_cluster_ratio')}, {r('acr', 'access_band_match_ratio')},
        {r('spr', 'special_comparable_ratio')}, {r('bc', 'band_confidence')}, {r('rel', 'mean_candidate_reliability')}, {r('ssr', 'same_segment_ratio')}, {r('her', 'heterogeneous_comparable_ratio')}, {r('width', 'weighted_band_width_ratio')} FROM summ""",
    "comparable_quality": with_ctes("judged") + f"SELECT row_id, cnt AS comparable_count, used AS max_search_radius_m, {r('cc', 'comparable_confidence')}, {r('bc', 'band_confidence')}, {r('width', 'weighted_band_width_ratio')} FROM judged",
    "confidence_scores": with_ctes("jg") + f"SELECT row_id, cgroup AS confidence_group, cbucket AS confidence_bucket, {r('cscore', 'confidence_score')}, {r('ape', 'ape')}, {r('le', 'log_error')}, {r('ae', 'abs_error', 3)} FROM jg",
    "group_errors": with_ctes("jg") + " UNION ALL ".join(f"SELECT '{g}' AS group_name, CAST({c} AS VARCHAR) AS group_value, {_ERRORS} FROM jg GROUP BY {c}" if "'" not in c else f"SELECT '{g}', {c}, {_ERRORS} FROM jg" for g, c in _GROUPS),
    "overall_errors": with_ctes("jg") + f"SELECT 'everything' AS group_name, {_ERRORS}, {r('avg(cscore)', 'mean_confidence_score', 4)} FROM jg",
    "calibration": with_ctes("jg") + f"SELECT b.bucket AS bucket, count(cscore) AS n, {r('avg(cscore)', 'mean_confidence')}, {r('avg(ape)', 'mean_ape')}, {r('quantile_cont(ape, 0.5)', 'median_ape')}, {r('avg(CASE WHEN cscore IS NOT NULL THEN coalesce(tong_gia BETWEEN b25 AND b75, false)::INT END)', 'band_coverage')} FROM (SELECT unnest(['low', 'medium', 'high']) AS bucket) b LEFT JOIN jg ON jg.cbucket = b.bucket GROUP BY 1",
    "workflow_metrics": with_ctes("jg") + f"SELECT count(*) AS n_rows, count(*) FILTER (NOT found) AS rows_missing_geo, count(*) FILTER (hflag IN ('HETEROGENEOUS_HIGH', 'HETEROGENEOUS_MEDIUM')) AS rows_heterogeneous, (SELECT count(*) FROM master) AS n_segments, (SELECT count(*) FROM master WHERE outlier) AS segment_outliers, (SELECT count(*) FROM master WHERE NOT found) AS segments_missing_geo, {r('avg(found::INT)', 'coordinate_match_rate')} FROM jg",
    "map_inputs": with_ctes("jg") + f"SELECT row_id, {r('cscore', 'confidence_score')} FROM (SELECT * FROM jg ORDER BY cscore NULLS LAST, row_id LIMIT 10)",
    "road_evidence": with_ctes("ev") + f"SELECT segment_key AS row_id, road AS road_id, kind AS match_type, conf AS match_confidence, conf >= 0.6 AND len <= 3000 AS included, CASE WHEN len > 3000 THEN 'EXCLUDED_CLIPPED_ROAD_TOO_LONG' WHEN conf < 0.6 THEN 'NO_ROAD_NOTE_MATCH' ELSE '' END AS exclusion_reason, {r('len', 'clipped_length_m', 3)}, {r('near', 'distance_m', 3)} FROM ev",
    "road_summary": with_ctes("ev") + f""", s AS (SELECT segment_key, count(*) AS n, count(*) FILTER (conf >= 0.6 AND len <= 3000) AS inc, count(*) FILTER (NOT (conf >= 0.6 AND len <= 3000)) AS exc, coalesce(avg(conf) FILTER (conf >= 0.6 AND len <= 3000), 0) AS mc FROM ev GROUP BY 1)
        SELECT segment_key AS row_id, coalesce(n, 0) AS road_count, coalesce(inc, 0) AS included_roads, coalesce(exc, 0) AS excluded_roads, CASE WHEN coalesce(inc, 0) = 0 THEN 'NO_ROAD_NOTE_MATCH' ELSE 'OK' END AS road_flag, {r('coalesce(mc, 0)', 'mean_match_confidence')}, {r(clip01('0.45::DOUBLE * least(1, coalesce(inc, 0) / 5.0::DOUBLE) + 0.35::DOUBLE * coalesce(mc, 0) + 0.20::DOUBLE * (coalesce(inc, 0) > 0)::INT - 0.10::DOUBLE * (coalesce(exc, 0) > coalesce(inc, 0))::INT'), 'road_evidence_confidence')} FROM rin LEFT JOIN s USING (segment_key)""",
    "knn_graph": with_ctes("gr") + f"SELECT i, j, {r('w', 'w')} FROM gr",
    "graph_density": with_ctes("gr") + f"SELECT i, {r(clip01('avg(w)'), 'density')} FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS k FROM gr) WHERE k <= 8 GROUP BY i",
    "boosted_graph": with_ctes("gr", "vec") + f""", bo AS (SELECT g.i, g.j, g.w * CASE WHEN a.label = b.label THEN 1.2::DOUBLE ELSE 1 END AS w FROM gr g JOIN vec a ON a.i = g.i JOIN vec b ON b.i = g.j), bl AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w * 0.7::DOUBLE AS w FROM gr UNION ALL SELECT i, j, w * 0.3::DOUBLE FROM bo UNION ALL SELECT i, i, 0.001::DOUBLE FROM vec) GROUP BY 1, 2),
        dg AS (SELECT i, sum(w) AS d FROM bl GROUP BY 1) SELECT bl.i AS i, bl.j AS j, {r('w / sqrt(a.d) / sqrt(b.d)', 'w')} FROM bl JOIN dg a ON a.i = bl.i JOIN dg b ON b.i = bl.j""",
    "graph_report": with_ctes("gr") + f"SELECT count(*) FILTER (i < j) AS edges, count(DISTINCT i) AS nodes, {r('sum(w)', 'total_weight', 4)} FROM gr",
    "cluster_assignment": with_ctes("vec") + f""", d AS (SELECT i, list_sort([{', '.join(f"{{'d': {c}, 'id': {k}}}" for k, c in enumerate(_CENTERS))}]) AS s FROM vec), a AS (SELECT i, s[1].id::INT AS k, s[1].d AS d1, s[2].d AS d2 FROM d), q AS (SELECT k, greatest(quantile_cont(d1, 0.75), 1e-6) AS sc FROM a GROUP BY 1)
        SELECT i AS vec_id, k AS assigned_cluster, {r('d1', 'cluster_center_distance_raw')}, {r(clip01('1 - d1 / greatest(d2, 1e-6)'), 'cluster_confidence')}, {r('d1 / sc', 'distance_to_cluster_center')} FROM a JOIN q USING (k)""",
}
