"""Raw files, grids, feature tables, predictions and artifacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from tidemark.functions.text import boolean_text
from tidemark.functions.timeline import HOUR_US, shift_steps
from tidemark.operators.quality import expected_grid, no_rows_expected
from tidemark.schemas import PREDICTION_ARTIFACT, PREDICTION_FILE, RAIN_POINTS, RAW

# Accepted raw file types, and how a prediction file is named.
RAW_SUFFIXES = (".csv", ".json", ".parquet")
#: Bytes that no JSON holds, as its strings have no bare control characters, and the largest file that is one record.
NO_JSON = "\u0000\u0001one record a file\u0001\u0000"
RECORD_BYTES = 1 << 28
PREDICTION_PATH = r"([^/]+)/([A-Za-z0-9]+)_h(\d+)_([a-z]+)\.csv(?:/[^/]+)?$"


def _with_origin(df: DataFrame) -> DataFrame:
    """Input position: the file, its block and the order inside the block.

    ``_pos`` counts up within a task that reads one block in order, so (file, block, position)
    restores the line order of a file.
    """
    return df.withColumns(
        {
            "_file": F.col("_metadata.file_path"),
            "_block_start": F.col("_metadata.file_block_start"),
            "_pos": F.monotonically_increasing_id(),
        }
    )


def input_position():
    """Ordering of raw rows as they were read: file name, then place in the file."""
    return F.struct("_file", "_block_start", "_pos")


def _as_text(c: Column, kind: DataType) -> Column:
    """Text of a value; whole numbers kept as doubles are spelt without exponent or fraction."""
    if not isinstance(kind, (DoubleType, FloatType)):
        return c.cast("string")
    whole = c.try_cast("decimal(38,0)")
    return F.when(whole.cast("double") == c.cast("double"), whole.cast("string")).otherwise(c.cast("string"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw records by file suffix, every value as text, nothing cleaned."""
    lower = path.lower()
    suffix = next((s for s in RAW_SUFFIXES if lower.endswith(s)), None)
    if suffix is None:
        raise ValueError(f"no reader for {path}: its name should end in {' or '.join(RAW_SUFFIXES)}")
    if suffix == ".json":
        return read_json_records(spark, path)
    if suffix == ".csv":
        rows = spark.read.option("header", True).csv(path)
        return _with_origin(rows)
    rows = spark.read.parquet(path)
    text = [_as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema]
    return _with_origin(rows).select(*text, "_file", "_block_start", "_pos")


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects per file, every key as text; anything else fails the read.

    The first sign of each file is checked before. Files of usual size are read as one record each: the other reader opens
    a file again for every number in it, to have its digits as they stand.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"),
        F.trim("value").alias("_line"), F.monotonically_increasing_id().alias("_at"),
    )
    begins = lines.where("_line <> ''").groupBy("_file").agg(F.min_by("_line", "_at").alias("_line"), F.max("_size").alias("_size"))
    found = begins.agg(F.min(F.when(~F.startswith("_line", F.lit("[")), F.col("_file"))), F.max("_size")).first()
    if found[0] is not None:
        raise ValueError(f"not a JSON array of records: {found[0]}")
    reader = spark.read.option("primitivesAsString", True).option("columnNameOfCorruptRecord", "_broken")
    if (found[1] or 0) <= RECORD_BYTES:
        reader = reader.option("lineSep", NO_JSON)
    else:
        reader = reader.option("multiLine", True)
    rows = reader.json(path)
    names = [part.split()[0] for part in RAW.split(", ")]
    if "_broken" in rows.columns:
        raise ValueError(f"a record is not an object in {path}")
    nested = (ArrayType, MapType, StructType)
    kept = [
        F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string").alias(f.name)
        for f in rows.schema
    ]
    absent = [F.lit(None).cast("string").alias(n) for n in names if n not in rows.columns]
    return _with_origin(rows).select(*kept, *absent, "_file", "_block_start", "_pos")


def read_rain_points(spark: SparkSession, directory: str) -> DataFrame:
    """All rainfall files below a directory.

    The header of every file is compared with the schema while it is read; a file that lacks
    a column fails the read and is named in the error.
    """
    rows = (
        spark.read.schema(RAIN_POINTS)
        .option("header", True)
        .option("enforceSchema", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(directory)
    )
    return rows.withColumn("_file", F.col("_metadata.file_path")).withColumn(
        "point_id", F.trim("point_id")
    )


def read_levels(spark: SparkSession, path: str, schema: str, kind: str | None = None) -> DataFrame:
    """A stored grid or feature table (CSV or Parquet) with times restored as instants.

    ``kind`` is ``csv`` or ``parquet``; by default the path's suffix decides. Boolean text of
    a CSV round trip is coerced; a spelling outside the contract fails.
    """
    stored_as = kind or ("parquet" if path.lower().rstrip("/").endswith(".parquet") else "csv")
    if stored_as == "parquet":
        names = [part.split()[0] for part in schema.split(", ")]
        rows = spark.read.parquet(path)
        missing = [n for n in names if n not in rows.columns]
        if missing:
            raise ValueError(f"{path} lacks column(s) {', '.join(missing)}")
        return rows
    fields = [part.split() for part in schema.split(", ")]
    text = ", ".join(f"{name} {'string' if kind == 'boolean' else kind}" for name, kind in fields)
    rows = (
        spark.read.schema(text).option("header", True).option("mode", "FAILFAST")
        .option("enforceSchema", False).csv(path)
    )
    flags = {}
    for name, kind in fields:
        if kind == "boolean":
            wrong = F.raise_error(F.concat(F.lit(f"{name} is not a boolean: "), F.coalesce(F.col(name), F.lit("null"))))
            value = boolean_text(F.col(name))
            flags[name] = F.when(value.isNotNull(), value).otherwise(wrong)
    return rows.withColumns(flags) if flags else rows


def require_segments(features: DataFrame) -> DataFrame:
    """A feature table must hold all three segments."""
    wanted = expected_grid(features.sparkSession, segment=["train", "validation", "test"])
    absent = wanted.join(features.select("segment").distinct(), "segment", "left_anti")
    no_rows_expected(absent, "segments missing from the feature table")
    return features


def read_predictions(
    spark: SparkSession,
    directory: str,
    *,
    experiments: Sequence[str],
    models: Sequence[str],
    horizons: Sequence[int] = (1, 3, 6),
    segments: Sequence[str] = ("train", "validation", "test"),
    series_key: str = "",
) -> DataFrame:
    """Prediction files ``<experiment>/<model>_h<h>_<segment>.csv`` as long forecasts.

    A file may be a folder of parts with that name. The listing is compared with the expected set before any row is
    read; missing files are named. A header in another order, or a
    segment other than the file's, fails the read. ``observed_at`` is the
    anchor, so the target is the anchor plus the horizon.
    """
    names = [f"{m}_{e}" for e in experiments for m in models]
    expected = expected_grid(spark, model=names, horizon=list(horizons), segment=list(segments))
    keys = ["model", "horizon", "segment"]
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(directory)
    place = lambda i: F.regexp_extract("path", PREDICTION_PATH, i)
    cells = listing.select(
        F.concat(place(2), F.lit("_"), place(1)).alias("model"), place(3).try_cast("int").alias("horizon"), place(4).alias("segment")
    )
    no_rows_expected(expected.join(cells.distinct(), keys, "left_anti"), "prediction files missing")
    rows = (
        spark.read.schema(PREDICTION_FILE).option("header", True).option("recursiveFileLookup", True)
        .option("mode", "FAILFAST").option("enforceSchema", False).csv(directory)
    )
    named = rows.withColumn("_path", F.col("_metadata.file_path"))
    part = lambda i: F.regexp_extract("_path", PREDICTION_PATH, i)
    found = named.select(
        F.lit(series_key).alias("series_key"),
        F.concat(part(2), F.lit("_"), part(1)).alias("model"),
        part(3).try_cast("int").alias("horizon"),
        F.when(F.col("segment") == part(4), part(4))
        .otherwise(F.raise_error(F.concat(F.lit("segment differs from the one named by the file: "), F.col("_path"))))
        .alias("segment"),
        F.col("observed_at").try_cast("timestamp").alias("anchor"),
        "observed",
        "prediction",
    )
    return found.join(F.broadcast(expected), keys, "left_semi").withColumn(
        "target", shift_steps(F.col("anchor"), F.col("horizon"), HOUR_US)
    )


def read_artifacts(
    spark: SparkSession, directory: str, priorities: Mapping[str, int], keys: Mapping[str, str]
) -> DataFrame:
    """Prediction artifacts with their candidate priority (by file name) and series keys.

    Malformed files are skipped, as a lookup must still be able to fall back.
    """
    rows = (
        spark.read.schema(PREDICTION_ARTIFACT + ", _corrupt_record string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .json(directory)
        .withColumn("_name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    )
    order = F.create_map(*[F.lit(v) for pair in priorities.items() for v in pair])
    times = F.transform(
        "points",
        lambda p: F.struct(
            p["horizon"].alias("horizon"),
            p["target_at"].try_cast("timestamp").alias("target_at"),
            p["water_level_m"].alias("water_level_m"),
        ),
    )
    return rows.filter(F.col("_corrupt_record").isNull()).select(
        *[F.lit(v).alias(k) for k, v in keys.items()],
        "model",
        F.coalesce("model_version", F.lit("unknown")).alias("model_version"),
        F.col("as_of").try_cast("timestamp").alias("as_of"),
        F.col("anchor_at").try_cast("timestamp").alias("anchor_at"),
        F.try_element_at(order, F.col("_name")).alias("priority"),
        times.alias("points"),
    ).filter(F.col("as_of").isNotNull() & F.col("anchor_at").isNotNull() & F.col("priority").isNotNull())


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """A table written in sorted order, with ``place``: the number of each row in that order, from 1.

    A row's place is its number in its own file plus the rows of the files before it, which are counted in a table with
    one row for each file.
    """
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(before, "_file").select(*rows.columns, (F.col("_before") + F.col("_row") + 1).alias("place"))
