"""Column functions and small frames for statistics with null-safe rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float | None = None) -> Column:
    """c within [low, high]; null stays null (greatest and least alone would skip it)."""
    inner = F.greatest(c, F.lit(low))
    return F.when(c.isNotNull(), inner if high is None else F.least(inner, F.lit(high)))


def clip01(c: Column) -> Column:
    return clip(c, 0.0, 1.0)


def quantile(c: Column | str, q: float) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(c, F.lit(q))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, qs: dict[str, float], tie: str) -> DataFrame:
    """keys and one column for each of qs: the weighted quantiles of value, per group.

    Rows without a finite value or with a weight of 0 or less are ignored. Values in order stand at the midpoints of
    their weights' shares; between midpoints values are interpolated, beyond the first and last they are held.
    Ties in value go by falling weight, then by `tie`.
    """
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    usable = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (w > 0))
    order = Window.partitionBy(*keys).orderBy(v, w.desc(), tie)
    whole = F.sum(w).over(Window.partitionBy(*keys))
    at = (F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, 0)) - w / 2) / whole
    laid = usable.select(*keys, v.alias("__v"), at.alias("__p"), F.lead(v).over(order).alias("__v2"), F.row_number().over(order).alias("__n"))
    laid = laid.withColumn("__p2", F.lead("__p").over(Window.partitionBy(*keys).orderBy("__n")))
    out = []
    for name, q in qs.items():
        between = F.when((F.col("__p") <= q) & (F.col("__p2") > q), F.col("__v") + (q - F.col("__p")) / (F.col("__p2") - F.col("__p")) * (F.col("__v2") - F.col("__v")))
        low = F.when((F.col("__n") == 1) & (F.col("__p") > q), F.col("__v"))
        high = F.when(F.col("__p2").isNull() & (F.col("__p") <= q), F.col("__v"))
        out.append(F.max(F.coalesce(between, low, high)).alias(name))
    return laid.groupBy(*keys).agg(*out)


def error_metrics(actual: str, predicted: str) -> dict[str, Column]:
    """MAE, RMSE, MAPE (actual not 0), median absolute error, mean absolute log error (both above 0), as aggregates."""
    a, p = F.col(actual), F.col(predicted)
    e = F.abs(a - p)
    return {
        "n": F.count(F.lit(1)),
        "mae": F.avg(e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mape": F.avg(F.when(a != 0, e / F.abs(a))) * 100,
        "median_ae": quantile(e, 0.5),
        "mean_abs_log_error": F.avg(F.when((a > 0) & (p > 0), F.abs(F.log(a) - F.log(p)))),
    }
