"""Evidence bullets: one row for each text item of a facility's claim fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import geo, text
from factloom.sources.tables import require_columns

FIELDS = ["capability", "procedure", "equipment"]


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the order given."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("factloom_rank", rank).where("factloom_rank = 1").drop("factloom_rank")


def explode_bullets(facilities: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """bullet_id, facility_*, source_field, position (counted after blank and other items have gone), text, text_norm."""
    fields = fields or FIELDS
    require_columns(facilities, ["unique_id", *fields], "facilities")
    optional = {c: F.col(c) if c in facilities.columns else F.lit(None) for c in ("name", "address_city", "address_stateOrRegion", "latitude", "longitude")}
    items = F.explode(F.array(*[F.struct(F.lit(f).alias("source_field"), text.json_strings(F.col(f)).alias("items")) for f in fields]))
    named = facilities.select(
        F.col("unique_id").cast("string").alias("facility_id"),
        optional["name"].cast("string").alias("facility_name"),
        optional["address_city"].cast("string").alias("facility_city"),
        optional["address_stateOrRegion"].cast("string").alias("facility_state"),
        geo.number(optional["latitude"]).alias("facility_latitude"),
        geo.number(optional["longitude"]).alias("facility_longitude"),
        items.alias("f"),
    )
    rows = named.select("*", F.col("f.source_field"), F.posexplode("f.items").alias("position", "text")).drop("f")
    rows = rows.withColumn("bullet_id", text.bullet_id(F.col("facility_id"), F.col("source_field"), F.col("position"), F.col("text")))
    return rows.withColumn("text_norm", text.normalize("text"))


def cross_facility_duplicates(bullets: DataFrame, least_chars: int = 80, least_tokens: int = 10) -> DataFrame:
    """text_norm and the sorted facilities of detailed texts that several facilities have."""
    detailed = bullets.where((F.length("text_norm") >= least_chars) & (F.size(F.split("text_norm", " ")) >= least_tokens))
    return detailed.groupBy("text_norm").agg(F.array_sort(F.collect_set("facility_id")).alias("duplicate_facility_ids")).where(F.size("duplicate_facility_ids") > 1)
