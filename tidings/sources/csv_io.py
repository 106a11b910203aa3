"""CSV input and result sinks.

Reading and writing use the same quoting rules (RFC-4180 style: fields with
commas, quotes or newlines are quoted, quotes doubled), so a result file
written here reads back unchanged, and files written by pandas read too.
"""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidings.operators.tag import require_headline

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    # Cells are written as they are: blanks stay, and an empty text ("") differs
    # from a missing cell (nothing between the commas).
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "",
    "emptyValue": '""',
}
# The reader turns an empty quoted cell into this mark (the empty text itself
# would equal ``nullValue`` and become null), and the mark becomes the empty text.
_EMPTY = "\u0002"
READ_OPTIONS = CSV_OPTIONS | {"emptyValue": _EMPTY}


#: Holds the text of a record whose number of cells isn't that of its header.
_RECORD = "__record"
#: In this order, the first type that all filled cells of a column have.
_INFERRED = ("int", "bigint", "double", "date", "timestamp", "boolean")


def _lines(spark: SparkSession, path) -> DataFrame:
    """file, block, at, value: all lines, numbered in order within a block of a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("at"), "value")


def csv_headers(spark: SparkSession, path) -> list[tuple[tuple[str, ...], list[str]]]:
    """(column names, files) of every distinct header, by its first file. One pass over
    the lines; the driver gets a line and the names of its files per header. A header
    is one line; a repeated name is numbered (``name.1``)."""
    first = _lines(spark, path).filter(F.col("block") == 0).groupBy("file").agg(F.min_by("value", "at").alias("header"))
    found = first.groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()
    out = []
    for row in sorted(found, key=lambda r: r["files"][0]):
        names, seen = [], {}
        for cell in next(csv.reader([row["header"].removeprefix("\ufeff")]), []):
            n = seen.get(cell, 0)
            seen[cell] = n + 1
            names.append(f"{cell}.{n}" if n else cell)
        out.append((tuple(names), [unquote(f) for f in row["files"]]))
    return out


def _typed(rows: DataFrame, schema: StructType | None) -> DataFrame:
    if schema is None:
        tests = [F.count(F.col(f"`{c}`").try_cast(t)).alias(f"{i}_{t}") for i, c in enumerate(rows.columns) for t in _INFERRED]
        filled = [F.count(F.when(F.trim(f"`{c}`") != "", 1)).alias(f"{i}_n") for i, c in enumerate(rows.columns)]
        found = rows.agg(*tests, *filled).first() if rows.columns else None

        def kind(i: int) -> str:
            n = found[f"{i}_n"]
            return next((t for t in _INFERRED if n and found[f"{i}_{t}"] == n), "string")

        return rows.select(*[F.col(f"`{c}`").try_cast(kind(i)).alias(c) if kind(i) != "string" else F.col(f"`{c}`") for i, c in enumerate(rows.columns)])
    have = set(rows.columns)
    return rows.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _by_header(spark: SparkSession, path, text_col: str, multi_line: bool) -> tuple[DataFrame, DataFrame]:
    """All records as text columns (by name), and which of them have more cells than
    their header: rows with ``_RECORD`` and the file they are in."""
    headers = csv_headers(spark, path)
    lacking = [files[0] for names, files in headers if text_col not in names]
    if lacking or not headers:
        raise ValueError(f"input must have a column named {text_col!r}; not in {lacking[0] if lacking else path}")
    whole = None
    for names, files in headers:
        schema = StructType([StructField(n, StringType()) for n in (*names, _RECORD)])
        rows = (spark.read.options(**READ_OPTIONS).option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", _RECORD).option("columnPruning", "false").schema(schema).csv(files))
        cells = ", ".join(f"c{i} string" for i in range(len(names) + 1))
        extra = F.from_csv(F.col(_RECORD), cells, {k: v for k, v in READ_OPTIONS.items() if k != "header"})[f"c{len(names)}"]
        given = [F.when(F.col(f"`{n}`") == _EMPTY, F.lit("")).otherwise(F.col(f"`{n}`")).alias(n) for n in names]
        # The parser refuses queries that read the record alone (a count): read no characters of a cell too.
        record = F.concat(F.col(_RECORD), F.substring(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), 1, 0))
        rows = rows.select(*given, F.when(extra.isNotNull(), record).alias(_RECORD), F.col("_metadata.file_path").alias("__file"))
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    return whole, whole.filter(F.col(_RECORD).isNotNull()).select(F.col("__file").alias("file"), F.col(_RECORD).alias("record"))


def read_headlines_csv(spark: SparkSession, path, schema: StructType | None = None,
                       text_col: str = "Headline", multi_line: bool = True) -> DataFrame:
    """Read headline CSVs, a file or a folder; every column passes through, ``Headline``
    must exist in every file. Columns are matched by name, so files may order
    theirs differently or lack some (null). A record with fewer cells than its
    header has nulls at the end; one with more fails the job that reads it (see
    ``read_headlines_folder``).

    One pass over the lines finds the headers; without a schema the types are inferred
    (one more). Fields with line breaks make each file
    one task; pass ``multi_line=False`` where no field has any, and a file of
    any size is split. Files written here are bounded (``max_records``).
    """
    rows, _ = _by_header(spark, path, text_col, multi_line)
    message = F.concat(F.lit("more cells than columns in "), F.col("__file"), F.lit(": "), F.col(_RECORD))
    sound = rows.filter(F.when(F.col(_RECORD).isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return require_headline(_typed(sound.drop(_RECORD, "__file"), schema), text_col)


def read_headlines_folder(spark: SparkSession, path, schema: StructType | None = None,
                          text_col: str = "Headline", multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """As ``read_headlines_csv``, with the records that have more cells than their
    header set aside: (rows, rejected), rejected being file, line (of the record's
    first line, from 1) and record."""
    rows, bad = _by_header(spark, path, text_col, multi_line)
    good = rows.filter(F.col(_RECORD).isNull()).drop(_RECORD, "__file")
    return require_headline(_typed(good, schema), text_col), _located(spark, path, bad)


def _located(spark: SparkSession, path, bad: DataFrame) -> DataFrame:
    """bad (file, record) with line numbers: the lines of the files with bad
    records are counted per block, and a record is met by its first line (of equal
    ones, each has one of the lines)."""
    bad = bad.withColumn("head", F.regexp_extract("record", r"^([^\r\n]*)", 1))
    lines = _lines(spark, path).join(bad.select("file").distinct(), "file", "left_semi")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    heads = bad.select("file", "head").distinct()
    met = (lines.join(heads, (lines["value"] == heads["head"]) & (lines["file"] == heads["file"])).select(lines["file"], "block", "at", "head")
           .join(blocks, ["file", "block"]).select("file", "head", (F.col("ahead") + F.col("at") - F.col("first") + 1).alias("line")))
    k = F.row_number().over(Window.partitionBy("file", "head").orderBy("line"))
    j = F.row_number().over(Window.partitionBy("file", "head").orderBy("record"))
    return (bad.withColumn("k", j).join(met.withColumn("k", k), ["file", "head", "k"], "left").select("file", "line", "record"))


def write_results_csv(df: DataFrame, path: str, mode: str = "errorifexists", max_records: int = 1_000_000) -> None:
    """All columns and rows, with a header, in files of at most ``max_records`` rows."""
    df.write.mode(mode).options(**CSV_OPTIONS).option("maxRecordsPerFile", max_records).csv(path)


def write_results_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
