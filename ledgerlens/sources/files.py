"""Finding, reading and writing tables as files.

Reading a raw CSV means guessing its header row and its encoding; both guesses
look at the first lines only (or at one cheap scan for bad bytes), and the data
itself is always read by Spark's CSV reader as text columns.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import vocabulary as v
from ledgerlens.functions import scalars as s

SUPPORTED = ("csv", "parquet")
HEADER_LINES = 3
# Bytes 0x80 to 0x9F of Windows-1252, and those without a meaning there.
FROM_1252 = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
TO_1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
UNDEFINED_1252 = "\x81\x8d\x8f\x90\x9d"
MIN_RECOGNISED = 5


class LoadError(Exception):
    """Input that cannot be loaded, with a message for the user."""


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """Path and size of the files in a folder; contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def find_dataset(spark: SparkSession, folder: str, filename: str | None = None) -> str:
    """The named file, or else the largest supported one; lock files are ignored."""
    if not _exists(spark, folder):
        raise LoadError(f"The data folder does not exist: {folder}")
    if filename:
        path = f"{folder.rstrip('/')}/{filename}"
        if not _exists(spark, path):
            raise LoadError(f"The configured file was not found: {path}")
        return path
    base = F.element_at(F.split("path", "/"), -1)
    pattern = r"(?i)\.(" + "|".join(SUPPORTED) + r")$"
    best = (
        _listing(spark, folder).filter(base.rlike(pattern) & ~base.startswith("~$"))
        .orderBy(F.desc("length"), "path").limit(1).first()
    )
    if best is None:
        raise LoadError(f"No dataset in {folder}; expected one of: {', '.join(SUPPORTED)}")
    return best["path"]


def recognised(names) -> int:
    return sum(str(n).strip().strip('"') in v.SOURCE_HEADERS for n in names)


def split_header(line: str) -> list[str]:
    """Cells of one CSV line, blank ones kept."""
    return [cell.strip() for cell in next(csv.reader([line]), [])]


def detect_header(rows: list[list[str]]) -> int:
    """Index of the row with the most known column names; the first one when none is known."""
    scores = [recognised(cells) for cells in rows]
    return scores.index(max(scores)) if scores and max(scores) > 0 else 0


def inspect(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, quoted line breaks?) from one scan of the lines.

    Bytes 0x80 to 0x9F that are not UTF-8 mean Windows-1252, unless one without a
    meaning there occurs; otherwise what is not UTF-8 is ISO-8859-1, which both share.
    """
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    row = spark.read.text(path).agg(
        F.bool_or(~F.is_valid_utf8("value")), F.bool_or(latin.rlike("[\\x80-\\x9F]")), F.bool_or(latin.rlike(f"[{UNDEFINED_1252}]")), F.bool_or(quotes % 2 == 1)).first()
    return ("windows-1252" if row[1] and not row[2] else "ISO-8859-1") if row[0] else "UTF-8", bool(row[3])


def _reader(spark: SparkSession, encoding: str, multi_line: bool, **options):
    stored = "UTF-8" if encoding == "UTF-8" else "ISO-8859-1"  # one byte, one character; decoded below
    return spark.read.options(encoding=stored, multiLine=multi_line, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
                              enforceSchema=True, escape='"', **options)


def _decoded(df: DataFrame, encoding: str) -> DataFrame:
    if encoding != "windows-1252":
        return df
    return df.select(*[F.translate(F.col(f"`{c}`"), FROM_1252, TO_1252).alias(c) for c in df.columns])


def _schema(names: list[str]) -> T.StructType:
    """Text columns; blank and repeated names get the number of their column."""
    seen: set[str] = set()
    fields = []
    for i, n in enumerate(names, start=1):
        n = f"column_{i}" if not n or n in seen else n
        seen.add(n)
        fields.append(T.StructField(n, T.StringType()))
    return T.StructType(fields)


def _below(rows: DataFrame, at: int) -> DataFrame:
    """The rows after row ``at`` of each file, by position and not by content.

    A file's first rows are those of the split that starts at byte 0; numbers
    rise along a partition, so they are counted from the least one of the file.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_place", F.monotonically_increasing_id())
    first = placed.where("_block = 0").groupBy("_file").agg(F.min("_place").alias("_first"))
    joined = placed.join(F.broadcast(first), "_file")  # one row a file
    return joined.where(f"_block > 0 OR _place - _first > {at}").select(*rows.columns)


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """All columns as text, below the detected header; also how the file was read.

    With the header in the first line Spark's reader skips it.  Below a banner
    the header's place is found once, from the first records, and everything up
    to it is dropped by position.  Line breaks inside quotes make a file
    unsplittable, so it is read that way only when a line holds an open quote.
    """
    encoding, multi_line = inspect(spark, path)
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(HEADER_LINES)
    stored = "UTF-8" if encoding == "UTF-8" else "ISO-8859-1"
    lines = _decoded(raw.select(F.decode(F.col("value").cast("binary"), stored).alias("value")), encoding).collect()
    if not lines:
        raise LoadError(f"{path} holds no data.")
    if multi_line:  # a record may be several lines: let the reader find the first ones
        wide = _schema([""] * max(r[0].count(",") + 1 for r in lines))
        found = _decoded(_reader(spark, encoding, True).csv(path, schema=wide, header=False).limit(HEADER_LINES), encoding).collect()
        used = max((i + 1 for r in found for i, x in enumerate(r) if x is not None), default=1)
        rows = [["" if x is None else x for x in r][:used] for r in found]
    else:
        rows = [split_header(r[0]) for r in lines]
    rows[0][0] = rows[0][0].lstrip("\ufeff")
    at = detect_header(rows)
    names = [n.strip() for n in rows[at]]
    if at == 0:
        data = _reader(spark, encoding, multi_line).csv(path, schema=_schema(names), header=True)
    else:
        data = _below(_reader(spark, encoding, multi_line).csv(path, schema=_schema(names), header=False), at).na.drop("all")
    return _decoded(data, encoding), {"encoding": encoding, "header_row": at, "columns_recognised": recognised(names), "multi_line": multi_line}


def load_raw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(data, one metadata row): the file as stored, with the checks a loader owes its user."""
    if not _exists(spark, path):
        raise LoadError(f"File not found: {path}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    info = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in SUPPORTED:
        raise LoadError(f"Unsupported format '{suffix}'; supported: {', '.join(SUPPORTED)}")
    if info.isDirectory() and suffix == "csv":
        raise LoadError(f"Expected a file but got a folder: {path}")
    if not info.isDirectory() and info.getLen() == 0:
        raise LoadError(f"{path} is empty (0 bytes).")
    if suffix == "csv":
        data, how = read_csv(spark, path)
    else:
        data, how = spark.read.parquet(path), {"encoding": None, "header_row": None, "columns_recognised": None, "multi_line": None}
        how["columns_recognised"] = recognised(data.columns)
    if data.limit(1).count() == 0:
        raise LoadError(f"{path} contains no data rows.")
    row = Row(path, suffix, info.getLen(), how["encoding"], how["header_row"], how["columns_recognised"],
              (how["columns_recognised"] or 0) >= MIN_RECOGNISED, how["multi_line"])
    schema = ("source_path string, source_format string, size_bytes long, encoding string, header_row int, "
              "columns_recognised int, looks_expected boolean, multi_line boolean")
    return data, spark.createDataFrame([row], schema)


def snake_case(header: str) -> str:
    """Safe identifier for an unknown header."""
    flat = re.sub(r"[ \-./\\()\[\]:;,_]+", "_", str(header).strip().lower())
    return flat.strip("_") or "unnamed_column"


def normalise_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Known headers get their canonical name, unknown ones are snake_cased, kept and reported."""
    trimmed = [c.strip() for c in df.columns]
    unknown = [c for c in trimmed if c not in v.SOURCE_HEADERS]
    return df.toDF(*[v.SOURCE_HEADERS.get(c) or snake_case(c) for c in trimmed]), unknown


def save(df: DataFrame, path: str) -> str:
    """Parquet, or CSV when the path says so; partition and file sizes are left to the writer."""
    writer = df.write.mode("overwrite")
    if path.rstrip("/").endswith(".csv"):
        flat = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        df = s.project(df, {c: f"to_json({s.name(c)})" for c in flat}) if flat else df
        df.write.mode("overwrite").csv(path, header=True)
    else:
        writer.parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``save``."""
    if not _exists(spark, path):
        raise LoadError(f"{path} does not exist; run the pipeline first.")
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str) -> str:
    """Every row of the selection, with a header in each part file."""
    return save(df, path if path.endswith(".csv") else f"{path}.csv")
