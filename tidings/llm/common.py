"""Small helpers shared by the corpus operators.

Conventions that hold for every operator in this subpackage:

* An operator selects the few columns it needs by name first, so extra
  columns (even ones named like its own outputs) change nothing.
* Text is handled as UTF-8 bytes (``cast("binary")``): no decoding, exact
  offsets, and C-speed ``bytes`` methods.
* Python runs inside ``mapInArrow`` tasks over Arrow batches; batches are cut
  further into pieces of about ``PIECE`` bytes, so memory is bounded whatever
  the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.session import fresh_path

#: Bytes of text handled by one numpy pass.
PIECE = 1 << 19
#: Bytes of text turned into Python objects at a time.
SMALL = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared work folder and read back: the lineage is
    cut, and a lost executor re-reads files instead of recomputing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A binary column as ``bytes`` values; null becomes ``b""``."""
    return [v or b"" for v in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batch: pa.RecordBatch, name: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes in a binary or string column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def small(batches: Iterator[pa.RecordBatch], name: str = "text", size: int = SMALL) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` bytes of text."""
    for batch in batches:
        yield from slices(batch, name, size)


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text cut after the last space before each ``size`` bytes (at ``size``
    where there is none). Depends on this text alone."""
    start = 0
    while len(text) - start > size:
        cut = text.rfind(b" ", start, start + size) + 1
        if cut <= start:
            cut = start + size
        yield text[start:cut]
        start = cut
    yield text[start:]


def packs(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[list[int], list[bytes]]]:
    """The pieces of many texts in groups of about ``size`` bytes: the text's
    number in ``texts`` and the piece."""
    rows: list[int] = []
    parts: list[bytes] = []
    total = 0
    for i, text in enumerate(texts):
        for part in pieces(text, size):
            if parts and total + len(part) > size:
                yield rows, parts
                rows, parts, total = [], [], 0
            rows.append(i)
            parts.append(part)
            total += len(part)
    if parts:
        yield rows, parts


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def running_total(df: DataFrame, key: str, chunk: str, order: list, value: str, out: str, number: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the earlier rows of the
    same key, and ``number``, the row's number within (key, chunk). Two levels,
    so a key with a third of all rows is spread over its chunks.

    Rows are ordered by (chunk, *order); key and chunk must not be null.
    """
    inside = Window.partitionBy(key, chunk).orderBy(*order)
    rows = df.withColumns({
        number: F.row_number().over(inside),
        "__in": F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    ahead = Window.partitionBy("__key").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (df.groupBy(F.col(key).alias("__key"), F.col(chunk).alias("__chunk")).agg(F.sum(value).alias("__sum"))
              .select("__key", "__chunk", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__before")))
    return (rows.join(before, (rows[key] == before["__key"]) & (rows[chunk] == before["__chunk"]))
            .withColumn(out, F.col("__before") + F.col("__in")).drop("__in", "__key", "__chunk", "__before"))
