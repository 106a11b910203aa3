"""Operator 1, SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that
differ in at most two bits have a segment that differs in at most one bit, and
the candidates fall into three disjoint cases, each an equality join on an
index key followed by a check of the bit distance:

* same upper segment: key = upper, the lower ones differ in 1 or 2 bits;
* same lower segment: key = lower, the upper ones differ in 1 or 2 bits;
* one bit in each: key = the upper segment with one wildcard bit (32 variants a
  fingerprint), joined between the two values of the wildcard bit; the lower
  ones differ in 1 bit.

Copies collapse first (one index row per distinct fingerprint, by a partial
aggregate), so a group of exact copies never meets itself. A key with more than
``pairs_up_to`` fingerprints isn't joined pair by pair: there the other segment
is indexed too, with all its one- or two-wildcard variants; fingerprints
that share such a key are linked to the least of them (at most four share one).
That is exact as well and grows with the key's size, not its square; it keeps
which fingerprints are connected, which is what is asked for.

Links between fingerprints are merged by ``components``; a document's component
is the least doc_id of any document with a fingerprint of its component.

Defined results: null, empty and word-free texts have fingerprint zero and are
linked like any other; null ids take part, and a component of null ids only has
a null component_id; repeated rows each get their row; extra columns are
ignored; an empty table gives no rows. Texts are read whole, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import column_bytes, small, stored, table
from tidings.llm.components import components

_LOW = (1 << 32) - 1


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, block: int = 1 << 15) -> int:
    """Unsigned fingerprint of one text."""
    return int(fingerprints([text], shingle, seed, block)[0])


def fingerprints(texts: list[bytes], shingle: int = 3, seed: int = 42, block: int = 1 << 15) -> np.ndarray:
    """One unsigned fingerprint per text. ``bytes.lower`` folds A-Z only and
    ``bytes.split`` splits at the six ASCII white space bytes."""
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    owner: list[int] = []
    hashes: list[int] = []
    digest = xxhash.xxh64_intdigest

    def add_up() -> None:
        if not hashes:
            return
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = np.array(owner)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        np.add.at(ones, own[first], np.add.reduceat(bits, first, axis=0, dtype=np.int64))
        np.add.at(total, own[first], np.diff(np.append(first, len(own))))
        owner.clear()
        hashes.clear()

    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) <= shingle:
            found = [digest(b" ".join(words), seed)]
            owner.append(i)
            hashes.extend(found)
        else:
            for a in range(0, len(words) - shingle + 1, block):
                part = words[a : a + block + shingle - 1]
                found = [digest(b" ".join(s), seed) for s in zip(*(part[k:] for k in range(shingle)))]
                owner.extend([i] * len(found))
                hashes.extend(found)
                if len(hashes) >= block:
                    add_up()
    add_up()
    set_bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def work(batches):
        for batch in small(batches):
            fp = fingerprints(column_bytes(batch, "text"), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(work, f"doc_id {kind}, fp long")


def _segments(prints: DataFrame) -> DataFrame:
    return prints.select("fp", F.shiftrightunsigned("fp", 32).alias("hi"), F.col("fp").bitwiseAND(F.lit(_LOW)).alias("lo"))


def _clear(value, bit):
    """``value`` with the bit whose mask is ``bit`` set to 0."""
    return value.bitwiseAND(F.bitwise_not(bit))


def _masks(count: int) -> F.Column:
    return F.array(*[F.lit(1 << i).cast("long") for i in range(count)])


def _double_masks(count: int) -> F.Column:
    return F.array(*[F.lit((1 << i) | (1 << j)).cast("long") for i in range(count) for j in range(i)])


def _starred(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Links of the members of each key (a handful) to the least of them."""
    low = F.min("fp").over(Window.partitionBy(*keys))
    return keyed.withColumn("b", low).filter(F.col("b") != F.col("fp")).select(F.col("fp").alias("a"), "b")


def _equal_segment(prints: DataFrame, key: str, other: str, pairs_up_to: int) -> DataFrame:
    """Links between fingerprints with one segment equal."""
    many = prints.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = prints.join(many, key)  # a fingerprint alone in its key is gone here
    small = members.filter(F.col("n") <= pairs_up_to).select(F.col("fp").alias("a"), key, F.col(other).alias("x"))
    right = small.select(F.col("a").alias("b"), key, F.col("x").alias("y"))
    pairs = (small.join(right, key).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2)).select("a", "b"))
    large = members.filter(F.col("n") > pairs_up_to)
    wild = large.withColumn("mask", F.explode(_double_masks(32))).withColumn("rest", _clear(F.col(other), F.col("mask")))
    return pairs.unionByName(_starred(wild.select("fp", key, "mask", "rest"), [key, "mask", "rest"]))


def _one_bit_each(prints: DataFrame, pairs_up_to: int) -> DataFrame:
    """Links between fingerprints that differ in one bit of either segment."""
    variants = (prints.withColumn("wild", F.explode(_masks(32)))
                .select("fp", "lo", F.col("hi").bitwiseAND(F.col("wild")).alias("side"),
                        # one long: the remaining 31 bits above the wildcard's number
                        (F.shiftleft(_clear(F.col("hi"), F.col("wild")), 6) + F.bit_count(F.col("wild") - 1)).alias("key")))
    # A key with one side only links nothing; both sides are needed.
    sides = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == 0).alias("zero")).filter("zero > 0 and zero < n")
    members = variants.join(sides.select("key", "n"), "key")
    small = members.filter(F.col("n") <= pairs_up_to)
    zero = small.filter("side = 0").select("key", F.col("fp").alias("a"), F.col("lo").alias("x"))
    one = small.filter("side <> 0").select("key", F.col("fp").alias("b"), F.col("lo").alias("y"))
    pairs = zero.join(one, "key").filter(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) == 1).select("a", "b")
    large = members.filter(F.col("n") > pairs_up_to)
    wild = large.withColumn("mask", F.explode(_masks(32))).withColumn("rest", _clear(F.col("lo"), F.col("mask")))
    return pairs.unionByName(_starred(wild.select("fp", "key", "mask", "rest"), ["key", "mask", "rest"]))


def links_within_two(prints: DataFrame, pairs_up_to: int = 512) -> DataFrame:
    """a, b: links that connect all distinct fingerprints at 2 or fewer bits."""
    cut = _segments(prints)
    return (_equal_segment(cut, "hi", "lo", pairs_up_to).unionByName(_equal_segment(cut, "lo", "hi", pairs_up_to))
            .unionByName(_one_bit_each(cut, pairs_up_to)))


def near_duplicates(docs: DataFrame, shingle: int = 3, pairs_up_to: int = 512) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the component), component_id
    of every row (maximum bit distance 2)."""
    prints = stored(with_fingerprints(docs, shingle), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = stored(nodes, "nodes")
    roots = components(links_within_two(nodes.select("fp"), pairs_up_to))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(heads, "root").select(F.col("fp").alias("fp_"), "root", "component_id")
    return prints.join(named, F.col("fp") == F.col("fp_")).select("doc_id", "fp", "root", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Pipeline stage: of each component one row stays, all columns unchanged: that
    of the least id (null last), then fingerprint, then hash of all columns. Rows that
    share an id but not their text are different documents. Reruns agree.

    A row whose id occurs once is found by its id: the text is shuffled once. Rows
    that share an id, or have none, are told apart by their fingerprint, made again
    in the tasks; equal ones are reduced before the shuffle.
    """
    found = stored(near_duplicates(docs.select("doc_id", "text"), shingle).select("doc_id", "fp", "root"), "found")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("least")
    heads = stored(found.groupBy("root").agg(least).select("least.doc_id", "least.fp"), "heads")
    shared = stored(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull())
                    .select(F.col("doc_id").alias("shared")), "shared-ids")
    own = [f"__{c}" for c in docs.columns]
    rows = docs.toDF(*own)
    once = heads.join(shared, F.col("doc_id").eqNullSafe(F.col("shared")), "left_anti").select(F.col("doc_id").alias("__doc_id"))
    kept = rows.join(once, "__doc_id", "left_semi").select(own)
    if shared.isEmpty():
        return kept.toDF(*docs.columns)
    at = docs.columns.index("text")

    def mark(batches):
        for batch in small(batches, "__text"):
            fp = fingerprints([(t or "").encode() for t in batch.column(at).to_pylist()], shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*own, "fp"])

    kinds = T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())])
    head = heads.join(shared, F.col("doc_id").eqNullSafe(F.col("shared"))).select(F.col("doc_id").alias("head_id"), F.col("fp").alias("head_fp"))
    several = rows.join(shared, F.col("__doc_id").eqNullSafe(F.col("shared")), "left_semi").mapInArrow(mark, kinds)
    others = (several.join(head, F.col("__doc_id").eqNullSafe(F.col("head_id")) & (F.col("fp") == F.col("head_fp")))
              .groupBy("__doc_id", "fp").agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("row")))
    return kept.unionByName(others.select("row.*").select(own)).toDF(*docs.columns)
