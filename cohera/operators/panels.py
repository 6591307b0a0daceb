"""One table of panels (panel, position, symbol, feature, coding) and the views that other steps read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def panel_table(ranked: DataFrame, panel: str, symbol: str, feature: str, order: list, coding: Column, size: int) -> DataFrame:
    """panel, position (from 1), symbol, feature, coding: each panel's first `size` rows by order. Only those are kept while ranks are made."""
    w = Window.partitionBy(panel).orderBy(*order)
    top = ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= size)
    return top.select(F.col(panel).alias("panel"), "position", F.col(symbol).alias("symbol"), F.col(feature).alias("feature"), F.coalesce(coding, F.lit(False)).alias("coding"))


def members(panels: DataFrame, critical: int | None = None, coding_only: bool = False) -> DataFrame:
    """The core panels, or their `critical` first members; then those that code alone."""
    out = panels if critical is None else panels.where(F.col("position") <= critical)
    return out.where("coding") if coding_only else out


def sizes(panels: DataFrame, kind: str = "panel") -> DataFrame:
    """panel, size, label ("7-gene panel")."""
    return panels.groupBy("panel").agg(F.count("*").alias("size")).withColumn("label", F.concat(F.col("size").cast("string"), F.lit(f"-gene {kind}")))


def directions(panels: DataFrame, effects: DataFrame, effect: str) -> DataFrame:
    """panel, symbol, direction: up or down by the sign of the feature's effect (feature, effect), null where it has none or 0."""
    e = effects.select("feature", F.col(effect).alias("_e"))
    sign = F.when(F.col("_e") > 0, "up").when(F.col("_e") < 0, "down")
    return panels.join(e, "feature", "left").select("panel", "symbol", sign.alias("direction"))


def register(panels: DataFrame, effects: DataFrame, effect: str, critical: int, prefix: str = "panel") -> list[str]:
    """Names of temporary views for SQL: members, critical members, sizes and directions."""
    views = {
        f"{prefix}_members": panels,
        f"{prefix}_critical": members(panels, critical),
        f"{prefix}_sizes": sizes(panels),
        f"{prefix}_directions": directions(panels, effects, effect),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
