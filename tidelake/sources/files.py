"""Catalogue, state and log files; CSV trees; sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidelake.functions import schemas
from tidelake.functions.scalars import timeframe_of_folder, valid_date
from tidelake.workspace import listed

META = "map<string,struct<decimalFactor:int,startHourForTicks:string,startDayForMinuteCandles:string,startMonthForHourlyCandles:string,name:string,description:string>>"


def parse_instruments(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Instruments of JSON catalogues {key: meta}, and the entries without any start date.

    Symbols are upper case, a missing factor is 1, start dates map tick, m1 and h1 to dates.
    """
    rows = texts.select(F.explode(F.from_json(column, META)).alias("key", "m"))
    dates = F.create_map(F.lit("tick"), F.try_to_date(F.substring("m.startHourForTicks", 1, 10)), F.lit("m1"), F.try_to_date(F.substring("m.startDayForMinuteCandles", 1, 10)), F.lit("h1"), F.try_to_date(F.substring("m.startMonthForHourlyCandles", 1, 10)))
    out = rows.select(F.upper("key").alias("symbol"), F.coalesce("m.decimalFactor", F.lit(1)).alias("decimal_factor"), F.map_filter(dates, lambda k, v: v.isNotNull()).alias("start_dates"), F.col("m.name").alias("name"), F.col("m.description").alias("description"))
    good = F.size("start_dates") > 0
    return out.where(good), out.where(~good)


def scan_instruments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_instruments(spark.read.text(path, wholetext=True))


def parse_checkpoints(texts: DataFrame, column: str = "value") -> DataFrame:
    """Checkpoints of JSON {symbol: {timeframe: date}}; reserved names that begin with `_` are no symbols."""
    outer = texts.select(F.explode(F.from_json(column, "map<string,map<string,string>>")).alias("symbol", "m")).where(~F.col("symbol").startswith("_"))
    return outer.select("symbol", F.explode("m").alias("timeframe", "d")).select("symbol", "timeframe", valid_date(F.col("d")).alias("last_date"))


def parse_ticker_list(texts: DataFrame, column: str = "value") -> DataFrame:
    """Symbols of JSON {"tickers": [...]}, upper case, each once; anything but a list raises an error."""
    found = F.from_json(column, "struct<tickers:array<string>>")["tickers"]
    checked = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit("tickers must be a list")).cast("array<string>"))
    return texts.select(F.explode(checked).alias("s")).select(F.upper("s").alias("symbol")).distinct()


def parse_failures(lines: DataFrame, file: str = "file", number: str = "line_no", column: str = "value") -> DataFrame:
    """Failure records of log lines `time | symbol | timeframe | date | message`.

    A line that does not begin with a date goes on with the message of the line before. A log file is read in order,
    so it is one group: logs are files per run.
    """
    head = F.col(column).rlike(r"^\d{4}-\d{2}-\d{2} ")
    group = F.sum(head.cast("int")).over(Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, 0))
    whole = lines.withColumn("_g", group).where("_g > 0").groupBy(file, "_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, column))), lambda x: x[column]), "\n").alias("t"))
    part = F.split("t", r" \| ", 5)
    return whole.select(*(F.trim(F.get(part, F.lit(i))).alias(n) for i, n in enumerate(("ts", "symbol", "timeframe", "dt", "message"))))


def failure_lines(failures: DataFrame) -> DataFrame:
    return failures.select(F.concat_ws(" | ", "ts", "symbol", "timeframe", "dt", "message").alias("value"))


def append_failures(failures: DataFrame, path: str) -> None:
    """Appends failures (ts, symbol, timeframe, dt, message) to a log folder, in the order of `ts` within a file."""
    failure_lines(failures.sortWithinPartitions("ts")).write.mode("append").text(path)


def scan_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure records of all log files below a folder."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return parse_failures(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("line_no")))


def factor_conflicts(rows: DataFrame) -> DataFrame:
    """Symbols whose rows or files name more than one decimal factor, with how many and the extremes."""
    known = rows.where("decimal_factor IS NOT NULL").select("symbol", "decimal_factor").distinct()
    return known.groupBy("symbol").agg(F.count("*").alias("factors"), F.min("decimal_factor").alias("low"), F.max("decimal_factor").alias("high")).where("factors > 1")


def path_parts(path: Column) -> tuple[Column, Column]:
    """Symbol and timeframe of `.../SYMBOL/folder/file.csv`; null where the path is too short or the folder unknown."""
    end = F.substring_index(path, "/", -3)
    symbol, rest = F.substring_index(end, "/", 1), F.substring_index(end, "/", -2)
    whole = path.endswith(".csv") & ~path.endswith("/.csv") & rest.contains("/") & (F.length(end) > F.length(rest))
    return F.when(whole & (symbol != ""), F.upper(symbol)), F.when(whole, timeframe_of_folder(F.nullif(F.substring_index(rest, "/", 1), F.lit(""))))


def scan_csv_tree(spark: SparkSession, base: str, timeframe: str, symbol: str | None = None, text: bool = False) -> DataFrame:
    """Rows of the CSV files of one timeframe below a folder, with file, symbol and timeframe; (block, row) is their order within a file.

    With `text` all cells are texts, and `malformed` is the line of a row with another number of cells.
    """
    schema = schemas.TICK_CSV if timeframe == "tick" else schemas.BAR_CSV
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    if text:
        cells = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        reader = reader.option("columnNameOfCorruptRecord", "malformed").schema(cells.add("malformed", T.StringType()))
    else:
        reader = reader.schema(schema)
    with listed(spark):
        rows = reader.csv(base)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    sym, frame = path_parts(F.col("file"))
    out = rows.withColumns({"symbol": sym, "timeframe": frame}).where(F.col("timeframe") == timeframe)
    return out if symbol is None else out.where(F.col("symbol") == symbol.upper())


def arrow_file(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The Arrow file system and the name there of a path as Spark gives it."""
    uri = unquote(uri)
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:", "file://", 1))


def append_parquet(df: DataFrame, path: str, parts: tuple[str, ...] = ("symbol", "month")) -> None:
    """Appends a chunk: new files only, atomic by the commit protocol, ZSTD level 1."""
    df.write.mode("append").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").partitionBy(*parts).parquet(path)


def append_csv(df: DataFrame, path: str, parts: tuple[str, ...] = ("symbol", "month")) -> None:
    df.write.mode("append").option("header", True).partitionBy(*parts).csv(path)


def finalize_csv(spark: SparkSession, path: str, schema: str, out: str, keys: tuple[str, ...] = ("symbol", "timestamp"), parts: tuple[str, ...] = ("symbol", "month")) -> None:
    """Writes the rows of an appended CSV table of bars to `out` with one row per key, the last one appended, in order.

    Ticks are not deduplicated in CSV tables, so this is for bars only. Files count in the order in which they were
    written, rows in their order within them.
    """
    when = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = spark.read.schema(schema).option("header", True).csv(path)
    best = rows.withColumn("_at", when).groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), "_at").alias("_row"))
    last = best.select(*(k for k in keys), "_row.*").select(*rows.columns)
    last.repartitionByRange(*parts, *keys).sortWithinPartitions(*parts, *keys).write.option("header", True).partitionBy(*parts).csv(out)


def with_metadata(df: DataFrame, **facts: object) -> DataFrame:
    """`timestamp` with facts (decimal_factor, symbol, timeframe, source) as column metadata, which Parquet keeps."""
    return df.withMetadata("timestamp", {**df.schema["timestamp"].metadata, **facts})


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, schema, facts) of the Parquet files below a folder, from their footers, read where Arrow reaches them by the tasks.

    `facts` are the column metadata of `timestamp` as text; a file that is not Parquet has a null schema.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                system, local = arrow_file(name)
                try:
                    schema = pq.read_schema(local, filesystem=system)
                    row = json.loads((schema.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata", b"{}"))
                    facts = next((f["metadata"] for f in row.get("fields", []) if f["name"] == "timestamp"), {})
                    out.append((name, "; ".join(f"{f.name} {f.type}" for f in schema), [(k, str(v)) for k, v in facts.items()]))
                except pa.ArrowInvalid:
                    out.append((name, None, []))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.string()), pa.array(list(cols[2]), pa.map_(pa.string(), pa.string()))], names=["path", "schema", "facts"])

    with listed(spark):
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return listing.select("path").mapInArrow(run, "path string, schema string, facts map<string,string>")


def lake_facts(found: DataFrame, fact: str = "decimal_factor") -> DataFrame:
    """One row of the facts of all `footers`: each from the first file (by path) that has it; files that differ in `fact` raise an error."""
    each = found.select("path", F.explode("facts").alias("name", "value"))
    first = each.groupBy("name").agg(F.min_by("value", "path").alias("value"), F.count_distinct("value").alias("n"))
    checked = F.when((F.col("name") == fact) & (F.col("n") > 1), F.raise_error(F.concat(F.lit(f"files differ in {fact}: "), F.col("n").cast("string")))).otherwise(F.col("value"))
    return first.select("name", checked.cast("string").alias("value"))


def tolerant_scan(spark: SparkSession, path: str, timeframe: str, extra: str = "", lenient: bool = False, places: bool = False) -> DataFrame:
    """All rows of a lake in the columns of a timeframe (and those in `extra`, a DDL list), whatever the types in its files, with the partition columns.

    Files are grouped by the schema in their footers; each group is read with its own, its columns selected and cast, and all are
    united. Columns beyond these are dropped; a missing one or a value that does not fit raises an error, or is
    null if `lenient`. With `places` each row has its `file` and its place there as `row`. The driver
    holds the paths, as Spark's own list of files does.
    """
    fields = [*schemas.of(timeframe).fields, *(T.StructType.fromDDL(extra).fields if extra else [])]
    groups = footers(spark, path).where("schema IS NOT NULL").groupBy("schema").agg(F.collect_list("path").alias("paths")).orderBy("schema").collect()
    out = None
    for g in groups:
        with listed(spark):
            rows = spark.read.option("basePath", path).parquet(*map(unquote, g["paths"]))
        lost = [f.name for f in fields if f.name not in rows.columns]
        if lost and not lenient:
            raise ValueError(f"{len(g['paths'])} files lack {', '.join(lost)}, such as {min(g['paths'])}")
        known = {c.split(" ")[0] for c in g["schema"].split("; ")}
        parts = [c for c in rows.columns if c not in known]  # from the folders
        typed = [F.lit(None).cast(f.dataType).alias(f.name) if f.name in lost else (F.col(f.name).try_cast(f.dataType) if lenient else F.col(f.name).cast(f.dataType)).alias(f.name) for f in fields]
        part = rows.select(*parts, *typed, *((F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")) if places else ()))
        out = part if out is None else out.unionByName(part)
    if out is None:
        where = [T.StructField("file", T.StringType()), T.StructField("row", T.LongType())] if places else []
        return spark.createDataFrame([], T.StructType([*fields, *where]))
    return out


def lake_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of a lake by format, from listings only."""
    with listed(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    kind = F.regexp_extract("path", r"\.([a-z0-9]+)$", 1)
    return files.where(F.col("length") > 0).groupBy(kind.alias("format")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
