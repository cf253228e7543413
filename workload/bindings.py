"""The test tables seen as gauge data. Everything reads whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # Zone-less times of the tables are read as UTC, like the checking SQL reads them.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def observations(spark: SparkSession, sf: str, key: str = "event_type") -> DataFrame:
    """Events as observations; the series is the event type or the user."""
    return table(spark, sf, "events").select(
        F.col(key).cast("string").alias("series_key"),
        F.col("event_id").cast("string").alias("source_record_id"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("value").alias("water_level_m"),
        F.lit("normal").alias("quality_flag"),
    )


def daily_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a daily series per priority; the order key breaks ties within a day."""
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_key"),
        F.col("o_orderkey").cast("string").alias("source_record_id"),
        F.col("o_orderdate").cast("timestamp").alias("observed_at"),
        F.col("o_totalprice").alias("water_level_m"),
        F.col("o_orderkey").alias("row_position"),
    )


def prop(column: str = "props") -> Column:
    return F.get_json_object(F.col(column), "$.k").cast("int")


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events written back as raw text, with the flaws of real files decided by ``props.k``."""
    k = F.col("k")
    stamp = F.col("ts").cast("timestamp")
    events = table(spark, sf, "events").withColumn("k", prop())
    return events.select(
        F.col("event_type").alias("series_key"),
        F.when(k < 3, F.lit("  "))
        .when(k == 3, F.lit("\t\u3000"))
        .when(k == 12, F.concat(F.lit("\t"), F.col("user_id").cast("string"), F.lit("-12\u3000")))
        .otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("-"), k.cast("string")))
        .alias("z_id"),
        F.when(k == 7, F.lit("2024-01-01 25:00:00"))
        .when(k == 8, F.date_format(stamp, "yyyy-MM-dd"))
        .when(k == 9, F.date_format(stamp, "yyyy/MM/dd HH:mm:ss"))
        .when(k == 10, F.date_format(stamp, "yyyyMMdd HHmmss"))
        .when(k == 11, F.concat(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit("+00")))
        .otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
        .alias("time_d"),
        F.when(k == 20, F.lit(""))
        .when(k == 21, F.lit("n/a"))
        .when(k == 22, F.lit("NaN"))
        .when(k == 23, F.lit("Infinity"))
        .otherwise(F.col("value").cast("string"))
        .alias("up_water_level"),
        F.col("event_id").alias("row_position"),
    )


def rain_points(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly sums per event type as gridded points; small ``k`` only counts as precipitation."""
    amount = F.col("value").cast("decimal(18,4)")
    return (
        table(spark, sf, "events")
        .withColumn("k", prop())
        .groupBy(
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("observed_at"),
            F.col("event_type").alias("point_id"),
        )
        .agg(
            F.sum(amount).cast("double").alias("precipitation_mm"),
            F.sum(F.when(F.col("k") >= 10, amount).otherwise(F.lit(0).cast("decimal(18,4)")))
            .cast("double")
            .alias("rain_mm"),
        )
    )


def shaped(df: DataFrame) -> DataFrame:
    """Zone-less times, six decimals and long integers, as the checking SQL returns them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # The offset takes exact halves off the rounding edge; adding zero drops a sign.
            c = F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
