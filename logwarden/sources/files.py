"""Batch sources: CSV, text and directory scans, labelled sets, text blobs."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import rules
from logwarden.functions.formats import DEFAULT_FORMATS, Formats
from logwarden.functions.text import CASED, first_match, message, strip_text
from logwarden.session import work_folder

TEXT_GLOB = "*.{log,txt}"
CSV_GLOB = "*.csv"


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Fail while the plan is built if columns are missing."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def file_stem() -> Column:
    """Name of the file a row came from, without its suffix.

    Spark gives the name in URL encoding, which leaves ``+`` as it is.
    """
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"\.[^.]+$", "")


def line_order() -> Column:
    """Place of a line in its file: offset of the split, then position within the split.

    Stands in for ``log_id`` where reports need "first seen". A number rather
    than a struct, so that its minimum can be kept by hash aggregation.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    split = F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(11,0)")
    return (split + row.cast("decimal(11,0)")).cast("decimal(38,0)")


def file_count(df: DataFrame) -> int:
    """Number of input files, from the planner's listing."""
    return len(df._jdf.inputFiles())


def clean_utf8(value: str) -> Column:
    """The text without bytes that are not UTF-8."""
    text = F.col(value)
    return F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), "\ufffd", ""))


#: Different column names of all files of a scan, at most.
MOST_COLUMNS = 1024


def file_headers(spark: SparkSession, path: str | list[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """``file, header``: the column names of every CSV file that has a line, one row per file; written down.

    A file is a task of its own that stops after its first line, so of each file the beginning is read. Names can be
    quoted, but not over a line's end.
    """
    own = spark.newSession()  # its settings give every file a task and hand on every line at once
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        own.conf.set(name, "1")
    # read as whole lines: by a separator that no header holds, without quotes, a file undivided
    reader = own.read.option("multiLine", True).option("sep", "\u0001").option("quote", "").option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    lines = reader.schema("line string").csv(path).select(F.col("_metadata.file_path").alias("file"), "line")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            file = batch.column("file")[0].as_py() if batch.num_rows else seen
            if file == seen and seen is not None:
                return
            if batch.num_rows:
                seen = file
                cells = next(csv.reader([(batch.column("line")[0].as_py() or "").rstrip("\r\n")]), [])
                header = pa.array([[c or None for c in cells]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([file]), header], ["file", "header"])

    folder = work_folder(spark, "headers")
    lines.mapInArrow(first, "file string, header array<string>").write.parquet(folder)
    named = F.transform("header", lambda x, i: F.coalesce(x, F.concat(F.lit("_c"), i.cast("string"))))
    return spark.read.schema("file string, header array<string>").parquet(folder).withColumn("header", named)


def scan_csv(
    spark: SparkSession, path: str | list[str], multiline: bool = True, recursive: bool = False,
    glob: str | None = None, ordered: bool = False, keep_file: bool = False,
    needed: tuple[str, ...] = ("log_message",), source: str | None = None,
) -> DataFrame:
    """CSV lines with a header, every column a string; ``source`` defaults to the file's stem (or to the text handed in).

    Every file is read by its own header; a column that a file lacks is NULL in
    its rows, and each must have the columns ``needed``. Where headers differ the
    files are read together by position, and each row finds its columns through
    its file's header, a table joined to the rows. ``multiline`` keeps quoted
    line breaks whole. Where the data has none, pass False: Spark then splits
    big files over many tasks. ``ordered`` adds ``line_order``, ``keep_file`` the
    file's path as ``file``. With multiline Spark does not find files whose names
    hold glob characters.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    reader = reader.option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    origin = F.lit(source) if source else file_stem()
    more = [line_order().alias("line_order")] if ordered else []
    more += [F.col("_metadata.file_path").alias("file")] if keep_file else []
    several = file_count(spark.read.option("recursiveFileLookup", recursive).options(**({"pathGlobFilter": glob} if glob else {})).text(path)) > 1
    headers = file_headers(spark, path, recursive, glob) if several else None
    if headers is None or headers.select("header").distinct().limit(2).count() < 2:
        df = require_columns(reader.csv(path), list(needed))
        names = [F.col(f"`{c}`") for c in df.columns]
        return df.select(*names, *([] if "source" in df.columns else [origin.alias("source")]), *more)

    for name in needed:
        lacking = headers.where(~F.array_contains("header", name)).first()
        if lacking:
            raise ValueError(f"missing required columns: {[name]} in {lacking.file}")
    places = headers.select(F.posexplode("header").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
    found = places.orderBy("at", "name").limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} different columns in {path}")
    width = headers.agg(F.max(F.size("header"))).first()[0]
    cells = [f"_c{i}" for i in range(width)]
    rows = reader.schema(", ".join(f"{c} string" for c in cells)).csv(path)
    rows = rows.select(F.array(*cells).alias("_cells"), F.col("_metadata.file_path").alias("_file"), origin.alias("_source"), *more)
    headers = headers.withColumnsRenamed({"file": "_file", "header": "_header"})
    rows = rows.join(F.broadcast(headers) if headers.count() <= 10_000 else headers, "_file")

    def cell(name: str) -> Column:
        value = F.get("_cells", F.array_position("_header", name).cast("int") - 1)
        return F.when(F.array_contains("_header", name), value).otherwise(F.col("_source")) if name == "source" else value

    names = [r.name for r in found]
    columns = [cell(c).alias(c) for c in names] + ([] if "source" in names else [F.col("_source").alias("source")])
    return rows.select(*columns, *[c for c, on in (("line_order", ordered), ("file", keep_file)) if on])


def scan_text(
    spark: SparkSession, path: str | list[str], source: str | None = None, formats: Formats = DEFAULT_FORMATS,
    recursive: bool = False, glob: str | None = None, keep_file: bool = False,
) -> DataFrame:
    """Text lines, stripped, blank ones dropped, with the format of their file.

    Bytes that are not UTF-8 are dropped. ``log_type`` is detected per file from
    its first non-blank line: every split offers its first candidate, the one
    with the lowest offset wins. Files are many fewer than lines, and their
    table is broadcast only if the planner's file list says it is short.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path)
    lines = raw.select(
        (F.lit(source) if source else file_stem()).alias("source"),
        strip_text(clean_utf8("value")).alias("log_message"),
        line_order().alias("line_order"),
        F.col("_metadata.file_path").alias("_file"),
    ).filter(F.col("log_message") != "")
    types = formats.batch_types(lines, ["_file"], ["line_order"])
    if file_count(raw) <= 10_000:
        types = F.broadcast(types)
    kept = [F.col("_file").alias("file")] if keep_file else []
    return lines.join(types, "_file").select("source", "log_message", "log_type", "line_order", *kept)


def scan_directory(spark: SparkSession, path: str, recursive: bool = False, keep_file: bool = False) -> DataFrame:
    """``source, log_message, line_order`` of all .log, .txt and .csv files of a folder.

    ``keep_file`` adds ``file``, the path: files of the same name in two folders
    share their source, not their path, so reports per input go by that.
    """
    columns = ["source", "log_message", "line_order", *(["file"] if keep_file else [])]
    listing = spark.read.option("recursiveFileLookup", recursive)
    parts = []
    if file_count(listing.option("pathGlobFilter", TEXT_GLOB).text(path)):
        parts.append(scan_text(spark, path, recursive=recursive, glob=TEXT_GLOB, keep_file=keep_file).select(*columns))
    if file_count(listing.option("pathGlobFilter", CSV_GLOB).text(path)):
        parts.append(scan_csv(spark, path, recursive=recursive, glob=CSV_GLOB, ordered=True, keep_file=keep_file).select(*columns))
    if not parts:
        raise ValueError(f"no .log, .txt or .csv files in {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def blob_lines(df: DataFrame, blob: str, keys: list[str], source: str = "raw_input") -> DataFrame:
    """Split pasted text into stripped non-blank lines; ``line_no`` keeps their order."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(blob), "\n")).alias("line_no", "_line"))
    lines = lines.select(*keys, "line_no", strip_text(F.col("_line")).alias("log_message"))
    return lines.filter(F.col("log_message") != "").withColumn("source", F.lit(source))


# --- labelled sets ----------------------------------------------------------


def scan_labelled(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Labelled CSV: ``source, log_message, target_label``; source defaults to 'unknown'. Files go by their own headers."""
    df = scan_csv(spark, path, multiline, needed=("log_message", "target_label"), source="unknown")
    return df.select("source", "log_message", "target_label")


def label_hdfs(lines: DataFrame, text: str = "log_message", keys: tuple[str, ...] = ()) -> DataFrame:
    """Label HDFS lines by their level."""
    line = strip_text(message(text))
    level = F.regexp_extract(line, CASED + "^" + rules.HDFS_LABEL_LINE, 4)
    label = first_match(
        [(level == name, F.lit(lab)) for name, lab in rules.HDFS_LEVEL_LABELS], F.lit(rules.HDFS_DEFAULT_LABEL)
    )
    out = lines.select(*keys, F.lit("HDFS").alias("source"), line.alias("log_message"), label.alias("target_label"))
    return out.filter(F.col("log_message") != "")


def label_alerts(lines: DataFrame, source: str, text: str = "log_message", keys: tuple[str, ...] = ()) -> DataFrame:
    """Label lines whose first token is ``-`` (normal, token cut off) or an alert code."""
    line = strip_text(message(text))
    normal = line.startswith("- ") | line.startswith("-\t")
    out = lines.select(
        *keys,
        F.lit(source).alias("source"),
        F.when(normal, strip_text(F.substring(line, 3, 2**31 - 1))).otherwise(line).alias("log_message"),
        F.when(normal, rules.ALERT_FILE_NORMAL).otherwise(rules.ALERT_FILE_ALERT).alias("target_label"),
        (line != "").alias("_some"),
    )
    return out.filter("_some").drop("_some")


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(clean_utf8("value").alias("log_message"))


DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "synthetic": scan_labelled,
    "hdfs": lambda spark, path: label_hdfs(_text_lines(spark, path)),
    "bgl": lambda spark, path: label_alerts(_text_lines(spark, path), "BGL"),
    "thunderbird": lambda spark, path: label_alerts(_text_lines(spark, path), "Thunderbird"),
}


def load_dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A labelled set by its name, in any case."""
    if name.lower() not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(DATASETS)}")
    return DATASETS[name.lower()](spark, path)
