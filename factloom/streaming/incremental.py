"""Bullets and their capability map as new facility files arrive: the per-bullet part of the pipeline on a stream.

What needs the whole corpus (texts shared by facilities, readiness) is computed from the stored tables by the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.bullets import explode_bullets
from factloom.operators.mapping import match_texts


def stream_bullets(spark: SparkSession, source: str, schema, out: str, checkpoint: str, rules: list[dict]) -> StreamingQuery:
    """Each micro-batch writes out/bullets/batch=N and out/matches/batch=N; a batch that is run again replaces its own folders."""

    def store(batch: DataFrame, n: int) -> None:
        bullets = explode_bullets(batch).persist()
        bullets.write.mode("overwrite").parquet(f"{out}/bullets/batch={n}")
        match_texts(bullets, rules).write.mode("overwrite").parquet(f"{out}/matches/batch={n}")
        bullets.unpersist()

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
