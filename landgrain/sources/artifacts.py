"""Saved tables, models and settings of a fitted appraisal, and its reports."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..config import Config


def save(folder: str, tables: dict[str, DataFrame], model: PipelineModel | None, config: Config) -> None:
    """Every table as Parquet, the model with its preprocessing, the settings as a one-row table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/tables/{name}")
        spark = df.sparkSession
    spark.createDataFrame([(json.dumps(asdict(config)), json.dumps(sorted(tables)))], "config string, tables string").write.mode("overwrite").json(f"{folder}/settings")
    if model:
        model.write().overwrite().save(f"{folder}/model")


def load(spark: SparkSession, folder: str, with_model: bool = True) -> tuple[dict[str, DataFrame], PipelineModel | None, Config]:
    """What save() wrote; nothing is fitted again."""
    settings = spark.read.schema("config string, tables string").json(f"{folder}/settings").first()
    values = json.loads(settings["config"])
    values["radii_m"] = tuple(values["radii_m"])
    tables = {n: spark.read.parquet(f"{folder}/tables/{n}") for n in json.loads(settings["tables"])}
    return tables, PipelineModel.load(f"{folder}/model") if with_model else None, Config(**values)


def write_csv(df: DataFrame, path: str) -> None:
    """A report for spreadsheets; arrays become 'a|b'."""
    from pyspark.sql import functions as F

    flat = [F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes if not t.startswith(("array<double", "map", "struct"))]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


class PhaseLog:
    """Ordered audit of the phases of a run."""

    def __init__(self) -> None:
        self.phases: list[dict] = []

    def add(self, name: str, **facts) -> None:
        self.phases.append({"order": len(self.phases) + 1, "phase": name, **facts})

    def json(self) -> str:
        return json.dumps(self.phases, ensure_ascii=False, indent=1, default=str)

    def markdown(self) -> str:
        return "\n".join(f"{p['order']}. **{p['phase']}**: " + ", ".join(f"{k} {v}" for k, v in p.items() if k not in ("order", "phase")) for p in self.phases)


def radar(scores: dict[str, float]) -> tuple[str, str]:
    """Six scores as JSON and as an SVG polygon."""
    import math

    n = max(1, len(scores))
    at = [(150 + 120 * v * math.sin(2 * math.pi * i / n), 150 - 120 * v * math.cos(2 * math.pi * i / n)) for i, v in enumerate(scores.values())]
    marks = "".join(f'<text x="{150 + 135 * math.sin(2 * math.pi * i / n):.0f}" y="{150 - 135 * math.cos(2 * math.pi * i / n):.0f}" font-size="9">{k}</text>' for i, k in enumerate(scores))
    svg = f'<svg xmlns="http://www.w3.org/2000/svg" width="300" height="300"><circle cx="150" cy="150" r="120" fill="none" stroke="#999"/><polygon points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in at)}" fill="#2a78" stroke="#257"/>{marks}</svg>'
    return json.dumps(scores), svg


def map_html(focus: dict, roads: list[dict], points: list[dict]) -> str:
    """A self-contained page: the focus property, its roads (kept green, others grey) and points, as an SVG in local metres."""
    import math

    k = math.cos(math.radians(focus["lat"]))
    xy = lambda lat, lon: (500 + (lon - focus["lon"]) * 111_320 * k * 0.4, 500 - (lat - focus["lat"]) * 110_540 * 0.4)
    lines = "".join(f'<polyline fill="none" stroke="{"#2a2" if r["included"] else "#999"}" points="{" ".join("%.1f,%.1f" % xy(lat, lon) for lon, lat in r["points"])}"/>' for r in roads)
    dots = "".join('<circle cx="%.1f" cy="%.1f" r="4" fill="#c52"><title>%s</title></circle>' % (*xy(p["lat"], p["lon"]), p["label"]) for p in points)
    return f'<!DOCTYPE html><html><body><svg width="1000" height="1000"><circle cx="500" cy="500" r="400" fill="none" stroke="#ccc"/>{lines}{dots}<circle cx="500" cy="500" r="6" fill="#25c"/></svg></body></html>'
