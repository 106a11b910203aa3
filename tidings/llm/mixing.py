"""Operator 8, mixing sources to target weights.

Each source's words, document after document, are packed into blocks of
``block`` words. Every output shard has ``slots`` slots and draws how many of
them each source fills: the whole part of the expected number, and a
multinomial draw of what is left over. A source's slots, numbered through all
shards, are mapped through a pseudorandom permutation of its block numbers
(a Feistel network, another one for each pass over the source), and slots and
blocks are joined by (source, block). No word is copied anywhere: a document's
``taken`` is the sum over its blocks of the words it has there, times the slots
that drew the block.

Targets: sources in code point order, null last, weigh 1, 2, 3, repeating, and
share all words by weight; a target stops at ``most`` times its source's size
and the excess is reshared by weight until none is above. No block is drawn
more than ``most`` times, so no document exceeds ``most`` times its size.

What the driver and the tasks hold is one row per source (``max_sources``, the
documented bound, is checked); everything per document, block or slot stays
distributed, and the offsets are two-level prefix sums, so a source with a
third of all rows is spread over many tasks.

Defined results: null or word-free texts have size 0 and nothing taken; null
source is a source of its own; repeated rows are documents of their own (equal
ones are interchangeable); null ids are kept; extra columns are ignored; an
empty table gives no rows, and one without any word has all targets 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import mix64, running_total, stored, table

WORD = r"[^\x20\x09-\x0D]+"


def targets_of(sizes: dict, most: float = 3.0, cycle: int = 3) -> dict:
    """Target per source. sizes: words per source (None: null source)."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: float(i % cycle + 1) for i, s in enumerate(names)}
    total = float(sum(sizes.values()))
    free, target = list(names), {}
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > most * sizes[s]]
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: most * sizes[s] for s in full})
        free = [s for s in free if s not in set(full)]
    return target


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 applied to ``index``: a four-round
    Feistel network on the least even number of bits that holds ``size``, walked
    on until the value is below it."""
    half = max(1, math.ceil(max(1, (size - 1).bit_length()) / 2))
    mask = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(key & (2**63 - 1)) * np.uint64(8))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (over := out >= np.uint64(size)).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def draw_counts(spark, plan: list[tuple[int, float]], shards: int, slots: int, total: int, seed: int) -> DataFrame:
    """shard, source_no, n: how many of the shard's slots each source fills.

    plan: (source number, expected slots in all shards together)."""
    share = np.array([q for _, q in plan]) / max(sum(q for _, q in plan), 1e-300)
    number = np.array([s for s, _ in plan], np.int32)

    def work(batches):
        for batch in batches:
            cols = [[], [], []]
            for shard in batch.column(0).to_pylist():
                here = min(slots, total - shard * slots)
                expected = here * share
                whole = np.floor(expected).astype(np.int64)
                left = here - int(whole.sum())
                if left > 0:
                    part = expected - whole
                    p = part / part.sum() if part.sum() > 0 else share
                    whole += np.random.default_rng([seed, shard]).multinomial(left, p)
                some = np.flatnonzero(whole)
                cols[0].append(np.full(len(some), shard, np.int64))
                cols[1].append(number[some])
                cols[2].append(whole[some])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["shard", "source_no", "n"])

    return spark.range(shards).mapInArrow(work, "shard long, source_no int, n long")


def slot_blocks(starts: DataFrame, blocks: dict[int, int], most: int, seed: int) -> DataFrame:
    """source_no, shard, block: one row per filled slot. A source's slots beyond
    ``most`` passes stay empty."""
    step = 1 << 16

    def work(batches):
        for batch in batches:
            for shard, source, n, start in zip(*(batch.column(c).to_pylist() for c in ("shard", "source_no", "n", "start"))):
                size = blocks[source]
                for a in range(start, min(start + n, most * size), step):
                    slot = np.arange(a, min(a + step, start + n, most * size), dtype=np.int64)
                    turn = slot // size
                    out = np.empty(len(slot), np.int64)
                    for t in np.unique(turn):
                        at = turn == t
                        out[at] = permuted(slot[at] % size, size, (seed * 1_000_003 + source) * 8 + int(t))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(slot), source, np.int32)), pa.array(np.full(len(slot), shard, np.int64)), pa.array(out)],
                        names=["source_no", "shard", "block"])

    # A few numbers become many rows here: as many tasks as the slots need.
    tasks = max(1, -(-sum(blocks.values()) // 200_000))
    return starts.select("shard", "source_no", "n", "start").repartition(tasks, "source_no", "shard").mapInArrow(work, "source_no int, shard long, block long")


def mix(docs: DataFrame, block: int = 128, slots: int = 4096, most: int = 3, seed: int = 8, max_sources: int = 200_000,
        rows_per_chunk: int = 1000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken."""
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                               F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources: weights by source need the source table in memory")
    sizes = {r["source"]: r["size"] for r in per_source}
    target = targets_of(sizes, float(most))
    names = list(target)
    names.sort(key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    blocks = {number[s]: -(-sizes[s] // block) for s in names}
    # A source's blocks hold size / blocks words on average, the last one being short.
    plan = [(number[s], target[s] * blocks[number[s]] / sizes[s]) for s in names if sizes[s] > 0]
    total = round(sum(q for _, q in plan))
    shards = -(-total // slots)
    sources = spark.createDataFrame([(s, number[s], sizes[s], float(target[s])) for s in names],
                                    "source_ string, source_no int, source_size long, target double")
    chunks = max(1, sum(r["docs"] for r in per_source) // rows_per_chunk)
    placed = stored(running_total(
        sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
        .withColumns({"spot": F.xxhash64("doc_id"), "chunk": F.pmod(F.xxhash64("doc_id"), F.lit(chunks))}),
        "source_no", "chunk", ["spot", "doc_id", "size"], "size", "start", "row"), "mix-placed")
    drawn = draw_counts(spark, plan, shards, slots, total, seed).withColumn("chunk", F.floor(F.col("shard") / 1024))
    starts = stored(running_total(drawn, "source_no", "chunk", ["shard"], "n", "start", "row"), "mix-starts")
    # Estimated sizes come from the few numbers above, so the join is named.
    times = (slot_blocks(starts, blocks, most, seed).groupBy(F.col("source_no").alias("s_"), F.col("block").alias("b_"))
             .agg(F.count(F.lit(1)).alias("times")))
    end = F.col("start") + F.col("size")
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))
    parts = (placed.withColumn("block", F.explode_outer(spans))
             .withColumn("words", F.coalesce(F.least(end, (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block), F.lit(0))))
    return (parts.hint("merge").join(times, (F.col("source_no") == F.col("s_")) & (F.col("block") == F.col("b_")), "left")
            .groupBy("source_no", "chunk", "row", "doc_id", "source", "size", "source_size", "target")
            .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
            .select("doc_id", "source", "size", "source_size", "target", "taken"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
