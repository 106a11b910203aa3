"""Operator 5, benchmark decontamination.

Prefix-filtered set join. Every window of ``window`` consecutive words of a
benchmark item (a shorter item is one window) is a set of one-word shingles
that a document must contain whole. Shingles are ordered by rarity, counted over
all documents; since all of a window's shingles are necessary, its prefix is the
rarest one. Document words are joined with the prefix tokens by hash; a match at
document word j with a prefix token at offset o of a window proposes start
j - o; the positional bound (j - o >= 0) and the length bound (the window ends
within the document) go first, then the window's words are compared in order.

The index (windows and their prefix tokens) is broadcast in blocks of at most
``index_bytes`` of benchmark text: the size is measured first, and a larger
benchmark is joined in several passes whose results are merged by document, so
nothing unbounded is broadcast and no item is left out.

Defined results: null and word-free texts have no words and no hits; null items
and items without words have no windows; items with a null id hit words but are
not listed; equal items are all listed, an id once; repeated documents are each
reported; extra columns are ignored; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import column_bytes, small, table

#: A-Z to a-z; digits, a-z and every byte of a non-ASCII character stay; the rest separates.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def windows_of(words: list[bytes], window: int) -> list[tuple]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def corpus_counts(docs: DataFrame, vocabulary: frozenset) -> dict[bytes, int]:
    """Occurrences over all documents of the words in ``vocabulary`` (the index
    bound holds for it); counts are summed per batch, then per word."""

    def work(batches):
        for batch in small(batches):
            seen: Counter = Counter()
            for text in column_bytes(batch, "text"):
                seen.update(filter(vocabulary.__contains__, words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(work, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r["w"]): r["n"] for r in rows.collect()}


def build_index(items: list[tuple], window: int, counts: dict[bytes, int]) -> tuple[dict, list]:
    """prefix token -> [(offset, window words, window number)], and the item
    ids of each window. items: (id or None, words)."""
    owners: dict[tuple, set] = {}
    for item, words in items:
        for w in windows_of(words, window):
            owners.setdefault(w, set()).update(() if item is None else (str(item),))
    index: dict[bytes, list] = {}
    for number, w in enumerate(owners):
        at = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
        index.setdefault(w[at], []).append((at, list(w), number))
    return index, list(owners.values())


def find_hits(words: list[bytes], index: dict) -> tuple[bytearray, set]:
    """Flags of the words inside any occurrence of a window, and the numbers of
    the windows that occur."""
    n, flags, found = len(words), bytearray(len(words)), set()
    for j, word in enumerate(words):
        if word in index:
            for at, wanted, number in index[word]:
                start = j - at
                end = start + len(wanted)
                if start >= 0 and end <= n and words[start:end] == wanted:
                    flags[start:end] = b"\x01" * (end - start)
                    found.add(number)
    return flags, found


def match_block(docs: DataFrame, index: dict, owners: list, positions: bool) -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_hit, hits (word numbers, only
    if ``positions``), items."""

    def work(batches):
        for batch in small(batches):
            out = [[], [], [], []]
            for text in column_bytes(batch, "text"):
                words = words_of(text)
                flags, found = find_hits(words, index)
                out[0].append(len(words))
                out[1].append(sum(flags))
                out[2].append([i for i, f in enumerate(flags) if f] if positions else [])
                out[3].append(sorted({i for number in found for i in owners[number]}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.string()))],
                names=["doc_id", "th", "n_words", "n_hit", "hits", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text")).mapInArrow(
        work, f"doc_id {kind}, th long, n_words long, n_hit long, hits array<int>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, index_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids of items with
    occurring windows), contaminated."""
    docs = docs.select("doc_id", "text")
    bench = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).filter(F.col("text").isNotNull())
    total = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // index_bytes))
    results = []
    for b in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        items = [(r["item_id"], words_of(bytes(r["text"]))) for r in part.collect()]
        counts = corpus_counts(docs, frozenset(w for _, words in items for w in words))
        results.append(match_block(docs, *build_index(items, window, counts), positions=blocks > 1))
    if blocks == 1:
        out = results[0].select("doc_id", "n_words", "n_hit", F.array_sort("items").alias("items"))
    else:
        every = results[0].withColumn("copy", F.lit(1))
        for more in results[1:]:
            every = every.unionByName(more.withColumn("copy", F.lit(0)))
        merged = every.groupBy("doc_id", "th", "n_words").agg(
            F.sum("copy").alias("copies"), F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        out = (merged.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
               .select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with no benchmark window, columns unchanged.

    The decision is made in the pass that reads the text: a row-wise filter
    against the broadcast index, no join. A benchmark above the index bound is
    filtered in several passes."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("text")).filter(F.col("text").isNotNull())
    return filter_clean(docs, bench)


def filter_clean(docs: DataFrame, bench: DataFrame, window: int = 10, index_bytes: int = 16 << 20) -> DataFrame:
    total = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // index_bytes))
    out, at = docs, docs.columns.index("text")
    for b in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        items = [(r["item_id"], words_of(bytes(r["text"]))) for r in part.collect()]
        index, _ = build_index(items, window, corpus_counts(docs, frozenset(w for _, words in items for w in words)))

        def work(batches, index=index):
            for batch in small(batches):
                clean = [not find_hits(words_of((t or "").encode()), index)[1] for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(work, docs.schema)
    return out


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS MATERIALIZED (
  SELECT DISTINCT item_id, CASE WHEN len(w) >= 10 THEN list_slice(w, i, i + 9) ELSE w END AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len(x) AS n FROM win), texts AS (SELECT DISTINCT x FROM win),
occ AS MATERIALIZED (
  SELECT p.rid, p.i, p.n, p.x
  FROM (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, w, list_slice(w, i, i + n - 1) AS x FROM d, lens WHERE len(w) >= n) p
  JOIN texts t ON t.x = p.x
), hits AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM occ) GROUP BY rid
), ids AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
  FROM (SELECT DISTINCT o.rid, CAST(win.item_id AS VARCHAR) AS s FROM occ o JOIN win ON win.x = o.x WHERE win.item_id IS NOT NULL) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.l, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h USING (rid) LEFT JOIN ids i USING (rid)
"""
