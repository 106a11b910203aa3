"""Operator 7, suffix-array dedup by bucket-pointer refinement.

Removes each byte covered by a ``length``-byte string that also starts earlier
(smaller doc_id, or the same document and an earlier start). Positions are put
into buckets that are refined step by step; a bucket with one member is settled,
and only what is not settled is refined again:

1. Initial q-gram buckets. Every ``length``-byte string contains one sampled
   q-gram, the one with the least hash (leftmost of equals): the choice depends
   on the string alone, so equal strings sample equal q-grams at equal offsets.
   Consecutive strings that sample the same occurrence form a run; the q-gram's
   identifier is the run's bucket. One row in about 30 positions.
2. A bucket is refined by the identifier of the bytes around the q-gram, to the
   offsets that its run reaches before and after it. Runs equal in both
   identifiers hold the same strings: all but the first are removed whole, and
   the first stands for them from here on.
3. First runs that share a q-gram bucket with a different run are cut into
   blocks of ``step`` strings; a block's new bucket is the identifier of the
   bytes that all its strings share. Blocks alone in their bucket are settled.
4. The strings of the other blocks are told apart by the few bytes before and
   after the shared ones, taken literally; all but the first of equals go.

Identifiers are 64-bit rolling hashes; two strings count as equal when two (in
step 4: one, and the literal bytes) of them agree.

Scale: step 1 ships one row of five numbers for 30 bytes of text. Within each
group of documents (``GROUP`` bytes) equal runs are merged and runs of a bucket
with several contexts are passed on to step 3 at once, so a bucket has at most
one row per group in the shuffle, however many copies there are. Step 4 counts each bucket
first; a bucket over ``hot`` rows takes a path that aggregates partially and
joins back, so no task gathers it. Texts are shuffled once, compressed, and a
second time only where step 4 has a say.

Defined results: null text has no bytes; texts under ``length`` bytes lose
nothing; null ids come after all others; rows that share an id are ordered by a
hash of their text; a repeated row (same id and text) is the same document again: the
rows get the same result and don't remove each other; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.llm.common import PIECE, column_bytes, mix64, small, stored, table

Q = 32
_BYTE = np.random.default_rng(70).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RATIO = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PIECE + 1024, _RATIO, np.uint64)]))
_BACK = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PIECE + 1024, pow(_RATIO, -1, 1 << 64), np.uint64)]))
_INDEX = np.uint64((1 << 21) - 1)

#: Bytes of text whose runs are settled together before the shuffle.
GROUP = 8 << 20

MARK, ASK, FIRST, SEEN = 0, 1, 2, 3
RUNS = "kind byte, key long, ctx long, doc long, sub long, at long"


class Rolling:
    """Identifiers of any byte range of one buffer (at most PIECE + 1024 bytes)."""

    def __init__(self, buf: np.ndarray):
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _POWER[: len(buf)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * _BACK[start])


def sampled_runs(buf: np.ndarray, ends: np.ndarray, length: int):
    """Runs of the strings of a buffer of joined texts (``ends``: where each
    ends): q-gram identifier, context identifier, first start, number of
    strings, q-gram position."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    roll = Rolling(buf)
    at = np.arange(n - Q + 1)
    gram = roll.of(at, at + Q)
    low = (gram & ~_INDEX) | at.astype(np.uint64)  # least hash, then leftmost
    span, width = length - Q + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    strings = n - length + 1
    low = np.minimum(low[:strings], low[span - width : span - width + strings])
    pick = (low & _INDEX).astype(np.int64)
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    start = np.flatnonzero(np.arange(strings) + length <= end[:strings])
    if not len(start):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    pick = pick[start]
    new = np.concatenate([[True], (pick[1:] != pick[:-1]) | (start[1:] != start[:-1] + 1)])
    head = np.flatnonzero(new)
    first, count = start[head], np.diff(np.append(head, len(start)))
    spot = pick[head]
    ctx = mix64(roll.of(first, first + count + length - 1) + ((spot - first) * 4096 + count).astype(np.uint64))
    return gram[spot], ctx, first, count, spot


def _chunks(texts: list[bytes], length: int):
    """Buffers of joined texts: (text numbers, offset of the part in its text,
    ends in the buffer, bytes). A long text is cut into parts that overlap by
    ``length - 1`` bytes, so that every string is in one part."""
    rows, offsets, ends, parts, total = [], [], [], [], 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for a in range(0, len(text) - length + 1, PIECE // 2):
            part = text[a : a + PIECE // 2 + length - 1]
            if parts and total + len(part) > PIECE:
                yield rows, offsets, np.array(ends), b"".join(parts)
                rows, offsets, ends, parts, total = [], [], [], [], 0
            rows.append(i)
            offsets.append(a)
            parts.append(part)
            total += len(part)
            ends.append(total)
    if parts:
        yield rows, offsets, np.array(ends), b"".join(parts)


def _key(docs: DataFrame):
    """Columns doc (orders documents, null last) and sub (tells rows with one
    id apart; 0 throughout where no id repeats)."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    repeated = docs.select(doc.alias("d")).groupBy("d").count().filter("count > 1").limit(1).count() > 0
    return doc, F.xxhash64("text") if repeated else F.lit(0).cast("long")


def _runs_batch(docs: np.ndarray, subs: np.ndarray, texts: list[bytes], length: int):
    """Step 1 and what can be settled within one batch: columns of RUNS."""
    keys, ctxs, doc, sub, first, lead, count = [], [], [], [], [], [], []
    for rows, offsets, ends, joined in _chunks(texts, length):
        key, ctx, start, number, spot = sampled_runs(np.frombuffer(joined, np.uint8), ends, length)
        part = np.searchsorted(ends, start, side="right")
        begin = np.concatenate([[0], ends[:-1]])[part]
        row = np.array(rows)[part]
        keys.append(key.view(np.int64))
        ctxs.append(ctx.view(np.int64))
        doc.append(docs[row])
        sub.append(subs[row])
        first.append(start - begin + np.array(offsets)[part])
        lead.append(spot - start)
        count.append(number)
    if not keys:
        return None
    key, ctx, doc, sub, first, lead, count = map(np.concatenate, (keys, ctxs, doc, sub, first, lead, count))
    order = np.lexsort((first, sub, doc, ctx, key))
    key, ctx, doc, sub, first, lead, count = (c[order] for c in (key, ctx, doc, sub, first, lead, count))
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new_ctx = new_key | np.concatenate([[True], ctx[1:] != ctx[:-1]])
    # A repeated row is the same document: not a later copy of itself.
    same = ~new_ctx & np.concatenate([[False], (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (first[1:] == first[:-1])])
    group = np.cumsum(new_key) - 1
    contexts = np.bincount(group, weights=new_ctx)[group]
    kind = np.full(len(key), MARK, np.int8)
    kind[new_ctx] = FIRST
    kind[new_ctx & (contexts > 1)] = ASK
    kind[new_key & (contexts > 1)] = SEEN  # asked for as well, and stands for its bucket
    keep = ~same
    return tuple(c[keep] for c in (kind, key, ctx, doc, sub, first, lead, count))


def _pack(first, lead, count):
    return (first << 20) + (lead << 12) + count


def _unpack(at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.asarray(at, np.int64)
    return v >> 20, (v >> 12) & 255, v & 4095


def _merged(doc, sub, start, stop):
    """Ranges merged where they touch; inputs and result ordered by document."""
    order = np.lexsort((start, sub, doc))
    doc, sub, start, stop = (c[order] for c in (doc, sub, start, stop))
    if not len(doc):
        return doc, sub, start, stop
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])])
    group = np.cumsum(other)
    reach = np.maximum.accumulate(stop + group * np.int64(1 << 40)) - group * np.int64(1 << 40)
    new = other | np.concatenate([[True], start[1:] > reach[:-1]])
    head = np.flatnonzero(new)
    return doc[head], sub[head], start[head], reach[np.append(head[1:], len(doc)) - 1]


def runs(keyed: DataFrame, length: int) -> DataFrame:
    """Rows of RUNS. ``at`` packs first start, q-gram offset and number of
    strings (see ``_pack``). MARK rows
    (strings to remove) and ASK rows (go on to step 3) carry a key of their own
    document, so that the shuffle by key spreads them."""

    def work(batches):
        for batch in small(batches, "text", GROUP):
            made = _runs_batch(batch.column(0).to_numpy(), batch.column(1).to_numpy(), column_bytes(batch, "text"), length)
            if made is None:
                continue
            kind, key, ctx, doc, sub, first, lead, count = made
            gone = kind == MARK
            d, s, a, b = _merged(doc[gone], sub[gone], first[gone], first[gone] + count[gone])
            rest, asked = ~gone, (kind == ASK) | (kind == SEEN)
            # A long stretch is cut so that its number of strings fits below 4096.
            pieces = -(-(b - a) // 4095)
            which = np.repeat(np.arange(len(a)), pieces)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            ma = a[which] + nth * 4095
            mn = np.minimum(b[which] - ma, 4095)
            stay = rest & (kind != ASK)
            cols = [
                np.concatenate([np.full(len(ma), MARK, np.int8), np.full(int(asked.sum()), ASK, np.int8), kind[stay]]),
                np.concatenate([d[which] * 31 + nth, doc[asked] * 31 + first[asked], key[stay]]),
                np.concatenate([np.zeros(len(ma) + int(asked.sum()), np.int64), ctx[stay]]),
                np.concatenate([d[which], doc[asked], doc[stay]]),
                np.concatenate([s[which], sub[asked], sub[stay]]),
                np.concatenate([_pack(ma, 0, mn), _pack(first[asked], lead[asked], count[asked]), _pack(first[stay], lead[stay], count[stay])]),
            ]
            for i in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in cols], names=["kind", "key", "ctx", "doc", "sub", "at"])

    return keyed.select("doc", "sub", "text").mapInArrow(work, RUNS)


def settle_runs(rows: DataFrame) -> DataFrame:
    """Steps 1 and 2 over all batches: doc, sub, at, mark (else: go on). One
    shuffle by bucket, with at most one bucket row per batch."""
    own = F.col("kind") >= FIRST
    bucket = Window.partitionBy("key", own)
    inner = bucket.orderBy("ctx", "doc", "sub", "at")
    seen = rows.withColumns({
        "later": own & F.coalesce(F.lag("ctx").over(inner) == F.col("ctx"), F.lit(False)),
        "twin": own & F.coalesce((F.lag("ctx").over(inner) == F.col("ctx")) & (F.lag("doc").over(inner) == F.col("doc")) & (F.lag("sub").over(inner) == F.col("sub"))
                                 & (F.lag("at").over(inner) == F.col("at")), F.lit(False)),
        # Another context in the bucket, or in a batch whose first run stands for several.
        "several": own & ((F.min("ctx").over(bucket) != F.max("ctx").over(bucket)) | (F.max("kind").over(bucket) == SEEN))})
    mark = (F.col("kind") == MARK) | (F.col("later") & ~F.col("twin"))
    go_on = (F.col("kind") == ASK) | ((F.col("kind") == FIRST) & F.col("several") & ~F.col("later"))
    return seen.filter(mark | go_on).select("doc", "sub", "at", mark.alias("mark"))


BLOCKS = "core long, doc long, sub long, at long, around binary"


def block_rows(text: bytes, asked: list[int], length: int, step: int):
    """Step 3 for one document: bucket, packed place, bytes around the shared ones.

    Blocks are counted from the sampled q-gram, whose offset in a string is what
    equal strings have in common: string j of block b starts at
    q-gram - b * step - j. Place packs the start of string 0, the first asked
    string and their number."""
    first, lead, count = _unpack(asked)
    out = []
    for region in np.unique(first // (PIECE // 2)).tolist():
        here = first // (PIECE // 2) == region
        base = max(0, region * (PIECE // 2) - 2 * step)
        part = text[base : (region + 1) * (PIECE // 2) + 2 * length + 2 * step]
        padded = np.frombuffer(b"\0" * step + part + b"\0" * step, np.uint8)
        roll = Rolling(padded)
        f, k_high = first[here] - base, lead[here]
        spot, k_low = f + k_high, k_high - (count[here] - 1)
        blocks = k_high // step - k_low // step + 1
        row = np.repeat(np.arange(len(f)), blocks)
        b = (k_low // step)[row] + np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        k0 = b * step
        lo, hi = np.maximum(k0, k_low[row]), np.minimum(k0 + step - 1, k_high[row])
        begin = spot[row] - k0  # where string 0 starts, and what all strings of the block share
        end = begin - (step - 1) + length
        core = mix64(roll.of(begin + step, end + step) + (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        side = np.arange(step - 1)
        left = padded[(begin + 1)[:, None] + side]  # the step - 1 bytes before ``begin``
        right = padded[np.minimum((end + step)[:, None] + side, len(padded) - 1)]
        out.append((core.view(np.int64), ((begin + base) << 10) + ((lo - k0) << 5) + (hi - lo + 1), np.concatenate([left, right], axis=1)))
    return tuple(np.concatenate(c) for c in zip(*out))


def later_strings(pending: DataFrame, length: int, step: int, hot: int) -> DataFrame:
    """Steps 3 and 4: doc, sub, starts (of strings that occur earlier)."""
    width = 2 * (step - 1)

    def work(batches):
        for batch in small(batches, "z"):
            doc, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, (z, asked) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                core, at, around = block_rows(zstandard.decompress(z), asked, length, step)
                n = len(core)
                offsets = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32))
                data = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(around))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core), pa.array(np.full(n, doc[i])), pa.array(np.full(n, sub[i])), pa.array(at), data],
                    names=["core", "doc", "sub", "at", "around"])

    blocks = pending.select("doc", "sub", "z", "asks").mapInArrow(work, BLOCKS)
    # At most rows / hot buckets: a small table by construction.
    large = stored(blocks.groupBy("core").count().filter(F.col("count") > hot).select("core"), "hot-cores")

    def strings(rows: DataFrame) -> DataFrame:
        low = F.shiftright("at", 5).bitwiseAND(F.lit(31)).cast("int")
        high = low + F.col("at").bitwiseAND(F.lit(31)).cast("int") - 1
        return rows.withColumn("j", F.explode(F.sequence(low, high))).select(
            "core", "j", F.expr(f"substring(around, {step} - j, {step - 1})").alias("rest"),
            F.struct("doc", "sub", (F.shiftright("at", 10) - F.col("j")).alias("start")).alias("place"))

    alone = Window.partitionBy("core")
    equal = Window.partitionBy("core", "j", "rest")
    usual = (strings(blocks.join(F.broadcast(large), "core", "left_anti").withColumn("n", F.count(F.lit(1)).over(alone)).filter("n > 1"))
             .withColumn("first", F.min("place").over(equal)).filter(F.col("place") > F.col("first")).select("place"))
    most = strings(blocks.join(F.broadcast(large), "core", "left_semi"))
    firsts = most.groupBy("core", "j", "rest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = (most.join(firsts, ["core", "j", "rest"]).filter(F.col("place") > F.col("first")).select("place"))
    return (usual.unionByName(crowded).groupBy(F.col("place.doc").alias("doc"), F.col("place.sub").alias("sub"))
            .agg(F.collect_list("place.start").alias("starts")))


def cut(text: bytes, marks, starts, length: int) -> tuple[bytes, int]:
    """The bytes that stay, and the number of removed runs."""
    change = np.zeros(len(text) + 1, np.int64)
    first, _, count = _unpack(marks if marks is not None else [])
    np.add.at(change, first, 1)
    np.add.at(change, first + count + length - 1, -1)
    if starts is not None and len(starts):
        first = np.asarray(starts, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs_gone = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return (np.frombuffer(text, np.uint8)[~gone].tobytes() if runs_gone else text), runs_gone


#: What ``dedup`` can return of the bytes that stay: column, type, and how it is made.
KEPT = {
    "bytes": ("kept", T.BinaryType(), pa.binary(), bytes),
    "text": ("kept", T.StringType(), pa.string(), lambda kept: kept.decode("utf-8", "ignore")),
    "sha256": ("kept_sha256", T.StringType(), pa.string(), lambda kept: hashlib.sha256(kept).hexdigest()),
}


def dedup(docs: DataFrame, length: int = 100, step: int = 16, hot: int = 50_000, kept: str = "bytes") -> DataFrame:
    """All columns of ``docs`` but text, and: n_bytes, n_removed, n_spans, and
    of the bytes that stay what ``kept`` names: the bytes, the text (halves of
    a character cut in two are left out), or their sha256."""
    if not Q <= length <= 255 or not 2 <= step <= 31:
        raise ValueError("length must be 32 to 255, step 2 to 31")
    rest = [c for c in docs.columns if c != "text"]
    names = [f"r{i}" for i in range(len(rest))]
    doc, sub = _key(docs)
    text = F.col("text").cast("binary")
    settled = stored(settle_runs(runs(docs.select(doc.alias("doc"), sub.alias("sub"), text.alias("text")), length)), "runs")
    todo = settled.groupBy("doc", "sub").agg(F.collect_list(F.when(F.col("mark"), F.col("at"))).alias("marks"),
                                             F.collect_list(F.when(~F.col("mark"), F.col("at"))).alias("asks"))
    wide = docs.select(doc.alias("doc"), sub.alias("sub"), *[F.col(c).alias(n) for c, n in zip(rest, names)], text.alias("z"))

    def pack(batches):  # texts travel compressed
        for batch in small(batches, "z"):
            z = [zstandard.compress(t, 1) for t in column_bytes(batch, "z")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z, pa.binary())], names=batch.schema.names)

    joined = wide.mapInArrow(pack, wide.schema).join(todo, ["doc", "sub"], "left").select(*wide.columns, "marks", "asks")
    result = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField(KEPT[kept][0], KEPT[kept][1])])
    kind, show = KEPT[kept][2:]

    def finished(batch, starts, final):
        """The columns of ``result``; null for rows that are not final yet."""
        out = [[], [], [], []]
        for z, marks, more, done in zip(batch.column("z").to_pylist(), batch.column("marks").to_pylist(), starts, final):
            if not done:
                row = (None, None, None, None)
            else:
                whole = zstandard.decompress(z)
                left, spans = cut(whole, marks, more, length)
                row = (len(whole), len(whole) - len(left), spans, show(left))
            for column, value in zip(out, row):
                column.append(value)
        return [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), kind))]

    def first_pass(batches):
        for batch in small(batches, "z"):
            final = [not a for a in batch.column("asks").to_pylist()]
            z = pa.array([None if f else v for v, f in zip(batch.column("z").to_pylist(), final)], pa.binary())
            made = finished(batch, [None] * len(final), final)
            columns = [z if n == "z" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*batch.schema.names, *result.names])

    def second_pass(batches):
        for batch in small(batches, "z"):
            made = finished(batch, batch.column("starts").to_pylist(), [True] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], names=[*names, *result.names])

    once = stored(joined.mapInArrow(first_pass, T.StructType([*joined.schema.fields, *result.fields])), "cut")
    waiting = once.filter(F.col("z").isNotNull())
    last = (waiting.select("doc", "sub", *names, "z", "marks").join(later_strings(waiting, length, step, hot), ["doc", "sub"], "left")
            .mapInArrow(second_pass, T.StructType([*[joined.schema[n] for n in names], *result.fields])))
    both = once.filter(F.col("z").isNull()).select(*names, *result.names).unionByName(last)
    return both.select(*[F.col(n).alias(c) for c, n in zip(rest, names)], *result.names)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, kept="sha256").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Pipeline stage: ``docs`` with the bytes that stay as text (halves of a
    character cut in two are left out) and n_chars, if there is one, counted
    anew; other columns, and the number of rows, stay."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    safe = [f"c{i}" for i in range(len(others))]  # no clash with dedup's own columns
    out = dedup(docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in zip(others, safe)]), length, kept="text")
    back = out.select("doc_id", *safe, "kept").toDF("doc_id", *others, "text")
    if "n_chars" in others:
        back = back.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back.select(*docs.columns)
