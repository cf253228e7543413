"""Landed service responses: nested hourly archives and paged listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import finite
from tidemark.schemas import ARCHIVE_RESPONSE


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, strictly typed."""
    return (
        spark.read.schema(ARCHIVE_RESPONSE).option("multiLine", True).option("mode", "FAILFAST").json(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )


def _stamps(times: Column) -> Column:
    return F.transform(times, lambda t: t.try_cast("timestamp"))


def response_violations(
    responses: DataFrame, variables: Sequence[str] = ("precipitation", "rain")
) -> DataFrame:
    """Responses that must be refused, with the reason.

    All checks look into the arrays of one response; no ordering across rows is needed.
    """
    times = F.col("hourly.time")
    stamps = _stamps(times)
    last = F.size(stamps) - F.lit(1)
    # Missing list elements compare as NULL and are caught by the unparsable check first.
    unordered = F.when(
        last >= 1,
        F.exists(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: F.get(stamps, i) <= F.get(stamps, i - 1),
        ),
    )
    reason = F.when(times.isNull(), F.lit("missing_time")).when(
        F.exists(stamps, lambda t: t.isNull()), F.lit("unparsable_time")
    )
    for v in variables:
        reason = reason.when(F.col(f"hourly.{v}").isNull(), F.lit(f"missing_{v}")).when(
            F.size(f"hourly.{v}") != F.size(times), F.lit(f"length_{v}")
        )
    reason = reason.when(unordered, F.lit("time_not_increasing"))
    return responses.withColumn("violation", reason).filter(F.col("violation").isNotNull())


def response_rows(
    responses: DataFrame,
    attributes: Sequence[str],
    variables: Sequence[str] = ("precipitation", "rain"),
) -> DataFrame:
    """Hourly rows: the parallel arrays zipped, the point's attributes repeated.

    A variable that was not requested is NULL.
    """
    known = ("precipitation", "rain")
    unknown = [v for v in variables if v not in known]
    if unknown:
        raise ValueError(f"unsupported variable(s): {', '.join(unknown)}")
    arrays = [F.col("hourly.time").alias("time"), *[F.col(f"hourly.{v}").alias(v) for v in variables]]
    lines = responses.select(*attributes, F.inline(F.arrays_zip(*arrays)))
    measures = [
        (finite(F.col(v)) if v in variables else F.lit(None).cast("double")).alias(f"{v}_mm") for v in known
    ]
    return lines.select(*attributes, F.col("time").try_cast("timestamp").alias("observed_at"), *measures)


def paged_rows(
    pages: DataFrame,
    dataset: Sequence[str] = ("dataset_id",),
    page: str = "page",
    total: str = "total",
    data: str = "data",
) -> DataFrame:
    """Rows of landed pages: nothing after the first empty page, never more than the total.

    The running row count is computed on one small row per page (without its data) and joined
    back to the pages.
    """
    on = [*dataset, page]
    sizes = pages.select(*on, total, F.size(data).alias("_size"))
    order = Window.partitionBy(*dataset).orderBy(page)
    counted = sizes.select(
        *on,
        F.min(F.when(F.col("_size") == 0, F.col(page))).over(order).alias("_empty"),
        F.coalesce(
            F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    ).filter(F.col("_empty").isNull())
    lines = pages.join(counted, on).select(
        *on, total, "_before", F.posexplode(data).alias("position", "row")
    )
    return lines.filter(F.col("_before") + F.col("position") < F.col(total)).select(
        *on, "position", "row"
    )
