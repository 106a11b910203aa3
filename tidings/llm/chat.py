"""Operator 10, chat formatting (DataFrame functions only).

Cumulative-snapshot collapse: a chat log often holds a conversation several
times, each snapshot a few turns longer than the one before. Rolling hashes of
the turn prefixes identify logged conversations that prefix longer ones;
anti-joins keep the maximal conversations, which are then rendered.

* Turn hash: two 64-bit hashes of (position, role, text) with different seeds.
* Positions: turns are ordered by turn number, role and text. Only rows that
  share turn number and role with another need their texts for that; those are
  sorted by ranges and numbered. Then the hashes of all turns are sorted by
  ranges of (conversation, turn, role, that number), which are distinct, so a
  conversation with a third of all rows, whatever its turn numbers, is spread
  over many ranges ("runs"). Rows whose texts share their first 64 characters,
  too, are sorted in one task (on disk).
* Rolling prefix hash: running xor over the turns. Position salts each hash,
  so the xor depends on the order. Positions and running values are computed in
  two levels (within a run, then over the totals of the runs).
* A conversation goes when its whole hash is the hash of a proper prefix of
  another one (anti-join), or when another one with a smaller id is equal.
  Both sides are grouped by hash first (partial aggregates), so a prefix shared
  by a third of all conversations is one row in the join.
* Rendering is per part of ``chunk`` turn numbers (part 0 for any conversation
  of ordinary length) and piece: a turn's piece is the number of whole
  ``row_bytes`` that the turns before it in the part fill. One definition for every
  size: a part of up to ``row_bytes`` is piece 0, a larger one (many rows of one
  turn number, or very long texts) is several rows, so no row gathers an
  unbounded group.

Defined results: a null role reads ``unknown``, a null text is empty; rows with
null conv_id form one conversation with null id; null turn numbers come last;
exact repeats of a row count once; rows with the same turn number are ordered by
role, then text; markers inside a text are defused (``<|`` becomes ``< |``);
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import stored, table

#: Bytes of turns after which a part goes on in another row.
ROW_BYTES = 16 << 20


def turns_of(conversations: DataFrame, chunk: int) -> DataFrame:
    """conv, turn, role, text, part, t1, t2 (hashes of the text)."""
    rows = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    part = F.coalesce(F.floor(F.col("turn") / chunk), F.lit((1 << 62)))
    return rows.withColumns({"part": part, "t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(11), "text")})


def same(left: DataFrame, right: DataFrame, nullable: list[str], others: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, of which ``nullable`` match null too; left's are kept."""
    names = {c: c + "_" for c in nullable + others}
    right = right.withColumnsRenamed(names)
    on = [F.col(c).eqNullSafe(F.col(c + "_")) for c in nullable] + [F.col(c) == F.col(c + "_") for c in others]
    return left.join(right, on, how).drop(*names.values())


def ties(slim: DataFrame, turns: DataFrame, runs: int | None) -> DataFrame:
    """conv, turn, role, t1, t2, seq of the turns that only their text orders
    (seq: a number that grows with the text)."""
    hashes = F.struct("t1", "t2")
    tied = (slim.groupBy("conv", "turn", "role").agg(F.min(hashes).alias("a"), F.max(hashes).alias("b"))
            .filter(F.col("a") != F.col("b")).drop("a", "b"))
    texts = (same(turns.select("conv", "turn", "role", "text", "t1", "t2"), tied, ["conv", "turn"], ["role"])
             .groupBy("conv", "turn", "role", "t1", "t2").agg(F.first("text").alias("text")))
    keys = ["conv", "turn", "role", F.substring("text", 1, 64)]
    ranges = texts.repartitionByRange(runs, *keys) if runs else texts.repartitionByRange(*keys)
    ordered = ranges.sortWithinPartitions("conv", "turn", "role", "text").withColumn("seq", F.monotonically_increasing_id())
    return stored(ordered.select("conv", "turn", "role", "t1", "t2", "seq"), "chat-ties")


def placed_turns(turns: DataFrame, runs: int | None = None) -> DataFrame:
    """conv, turn, role, part, t1, t2, size (bytes), run and at (the order in
    the run) of the distinct turns. Only hashes of texts are shuffled, but for
    turns that share their number and role."""
    # Four hashes stand for a row: two for identity, and they leave the text behind.
    size = F.octet_length("text") + F.octet_length("role") + 24
    slim = (turns.select("conv", "part", "turn", "role", "t1", "t2", size.cast("long").alias("size"))
            .groupBy("conv", "part", "turn", "role", "t1", "t2").agg(F.max("size").alias("size")))
    rows = slim.join(ties(slim, turns, runs).withColumnsRenamed({c: c + "_" for c in ("conv", "turn", "role", "t1", "t2")}),
                     F.col("conv").eqNullSafe(F.col("conv_")) & F.col("turn").eqNullSafe(F.col("turn_")) & (F.col("role") == F.col("role_"))
                     & (F.col("t1") == F.col("t1_")) & (F.col("t2") == F.col("t2_")), "left")
    order = ["conv", F.col("turn").asc_nulls_last(), "role", "seq"]
    rows = rows.select("conv", "part", "turn", "role", "t1", "t2", "size", F.coalesce("seq", F.lit(0)).alias("seq"))
    ranges = rows.repartitionByRange(runs, *order) if runs else rows.repartitionByRange(*order)
    ordered = ranges.sortWithinPartitions(*order).withColumns({"run": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    return stored(ordered.drop("seq"), "chat-turns")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """conv, k (1-based position), h1, h2 (hash of the first k turns), n (turns
    in all)."""
    whole = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (placed.groupBy("conv", "run").agg(F.count(F.lit(1)).alias("n_in"))
            .withColumn("before", F.coalesce(F.sum("n_in").over(whole), F.lit(0)))
            .withColumn("n", F.sum("n_in").over(Window.partitionBy("conv"))))
    inside = Window.partitionBy("conv", "run").orderBy("at")
    numbered = (placed.withColumn("r", F.row_number().over(inside))
                .join(runs.select("conv", "run", "before", "n").withColumnsRenamed({"conv": "conv_", "run": "run_"}),
                      F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("run") == F.col("run_")))
                .select("conv", "run", "r", "n", (F.col("before") + F.col("r")).alias("k"), "role", "t1", "t2"))
    hashed = numbered.select("conv", "run", "r", "n", "k", F.xxhash64("k", "role", "t1").alias("a"), F.xxhash64(F.lit(29), "k", "role", "t2").alias("b"))
    upto = Window.partitionBy("conv", "run").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({"x1": F.bit_xor("a").over(upto), "x2": F.bit_xor("b").over(upto)})
    carry = (hashed.groupBy("conv", "run").agg(F.bit_xor("a").alias("ca"), F.bit_xor("b").alias("cb"))
             .select(F.col("conv").alias("conv_"), F.col("run").alias("run_"),
                     F.coalesce(F.bit_xor("ca").over(whole), F.lit(0)).alias("c1"),
                     F.coalesce(F.bit_xor("cb").over(whole), F.lit(0)).alias("c2")))
    return (rolled.join(carry, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("run") == F.col("run_")))
            .select("conv", "k", "n", F.col("x1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("c2")).alias("h2")))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv, n and copies (equal conversations, itself included) of the
    conversations that prefix no other one."""
    whole = (prefixes.filter(F.col("k") == F.col("n")).groupBy("n", "h1", "h2")
             .agg(F.min(F.struct(F.col("conv").isNull().alias("none"), F.col("conv"))).alias("first"), F.count(F.lit(1)).alias("copies")))
    proper = (prefixes.filter(F.col("k") < F.col("n")).select(F.col("k").alias("n"), "h1", "h2").distinct())
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select(F.col("first.conv").alias("conv"), F.col("n").alias("n_turns"), "copies")


def cut_by_size(placed: DataFrame, row_bytes: int) -> DataFrame:
    """conv, part, turn, role, t1, t2, at, piece: the turns of the parts over
    ``row_bytes``, and the piece each is rendered in."""
    large = placed.groupBy("conv", "part").agg(F.sum("size").alias("size")).filter(F.col("size") > row_bytes).select("conv", "part")
    rows = same(placed, large, ["conv"], ["part"])
    before = Window.unboundedPreceding, -1
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("conv", "part", "run").orderBy("at").rowsBetween(*before)), F.lit(0))
    runs = (rows.groupBy("conv", "part", "run").agg(F.sum("size").alias("size_"))
            .select("conv", "part", "run",
                    F.coalesce(F.sum("size_").over(Window.partitionBy("conv", "part").orderBy("run").rowsBetween(*before)), F.lit(0)).alias("ahead")))
    joined = rows.withColumn("inside", inside).join(runs.withColumnsRenamed({c: c + "_" for c in ("conv", "part", "run")}),
                                                    F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")) & (F.col("run") == F.col("run_")))
    return stored(joined.select("conv", "part", "turn", "role", "t1", "t2", "at",
                                F.floor((F.col("ahead") + F.col("inside")) / F.lit(row_bytes)).alias("piece")), "chat-cuts")


def rendered(turns: DataFrame, placed: DataFrame, kept: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row per kept conversation, part and piece, in ChatML."""
    body = F.concat(F.lit("<|im_start|>"), F.replace(F.col("role"), F.lit("<|"), F.lit("< |")), F.lit("\n"),
                    F.replace(F.col("text"), F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))
    kept = kept.withColumnRenamed("conv", "conv_")
    known = kept.join(placed.select("conv", "part").distinct(), F.col("conv_").eqNullSafe(F.col("conv"))).drop("conv_")
    by_size = cuts.select("conv", "part").distinct()
    cut = not cuts.isEmpty()
    usual = known
    if cut:
        large = by_size.withColumnsRenamed({"conv": "conv_", "part": "part_"})
        usual = known.join(large, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")), "left_anti")
    usual = usual.withColumnsRenamed({"conv": "conv_", "part": "part_"})
    parts = (turns.join(usual, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")))
             .groupBy("conv", "part", "n_turns", "copies").agg(
                 F.collect_set(F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "text", body.alias("body"))).alias("turns")))
    whole = F.concat_ws("", F.transform(F.array_sort("turns"), lambda t: t["body"])).alias("chat")
    out = parts.select("conv", "part", F.lit(0).cast("long").alias("piece"), "n_turns", "copies", whole)
    if not cut:
        return out
    texts = (same(turns, by_size, ["conv"], ["part"]).groupBy("conv", "part", "turn", "role", "t1", "t2").agg(F.first("text").alias("text")))
    key = ["conv", "part", "turn", "role", "t1", "t2"]
    long = texts.join(cuts.withColumnsRenamed({c: c + "__" for c in key}),
                      F.col("conv").eqNullSafe(F.col("conv__")) & F.col("turn").eqNullSafe(F.col("turn__")) & (F.col("part") == F.col("part__"))
                      & (F.col("role") == F.col("role__")) & (F.col("t1") == F.col("t1__")) & (F.col("t2") == F.col("t2__")))
    long = (long.join(kept, F.col("conv").eqNullSafe(F.col("conv_"))).groupBy("conv", "part", "piece", "n_turns", "copies")
            .agg(F.collect_list(F.struct("at", body.alias("body"))).alias("turns")))
    return out.unionByName(long.select("conv", "part", "piece", "n_turns", "copies", whole))


def format_chats(conversations: DataFrame, chunk: int = 1024, row_bytes: int = ROW_BYTES, runs: int | None = None) -> DataFrame:
    """conv_id, part (chunk of turn numbers), piece (its text by ``row_bytes``: how many
    whole pieces the turns before a turn fill), n_turns and copies of the whole
    conversation, chat (rendered text of the piece). ``runs``: ranges the turns
    are sorted in (the session's shuffle partitions)."""
    turns = turns_of(conversations, chunk)
    placed = placed_turns(turns, runs)
    out = rendered(turns, placed, maximal(prefix_hashes(placed)), cut_by_size(placed, row_bytes))
    return out.select(F.col("conv").alias("conv_id"), "part", "piece", "n_turns", "copies", "chat")


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


#: For tables without nulls: lists of whole turns compared as they are.
OP10_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), convs AS MATERIALIZED (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn, role, text) AS l FROM turns GROUP BY conv_id
), firsts AS MATERIALIZED (
  SELECT min(conv_id) AS conv_id, n, l, count(*) AS copies FROM convs GROUP BY n, l
), prefixes AS (
  SELECT DISTINCT k AS n, list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM firsts)
), kept AS (
  SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.n = f.n AND p.l = f.l)
)
SELECT k.conv_id, t.part, t.piece, k.n AS n_turns, k.copies,
       string_agg('<|im_start|>' || replace(t.role, '<|', '< |') || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10),
                  '' ORDER BY t.turn, t.role, t.text) AS chat
FROM kept k JOIN (
  SELECT *, turn // 1024 AS part, CAST(coalesce(sum(strlen(text) + strlen(role) + 24) OVER (
    PARTITION BY conv_id, turn // 1024 ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 16777216 AS BIGINT) AS piece
  FROM turns) t ON t.conv_id = k.conv_id
GROUP BY k.conv_id, t.part, t.piece, k.n, k.copies
"""
