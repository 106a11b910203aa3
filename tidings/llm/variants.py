"""Operator 11, spelling variants by permuterm rotations.

A word with a terminator, ``word$``, has one rotation per position. Take the
rotation ``b$a`` of a word ``ab``: a word ``acb`` with one character more has the
rotation ``b$ac``, so it lies in the prefix range ``b$a``; a word ``adb`` lies in
the same range one character long. Skipping the edited (last) character, all
words that agree outside one position meet under one prefix:

* a word's rotations themselves (it may be the shorter side of an indel),
* its rotations without the last character (a replacement, or the longer side).

Rotations are dealt by prefix, sorted by (prefix, last character) and scanned
once. A prefix holds at most one whole rotation and one shortened rotation per
letter of the alphabet (90 letters), so no group grows with the data: a hot word
has no more rotations than any other. A replacement pair meets under exactly one
prefix; an indel inside a run of equal letters meets under several, of which the
first place of the run counts. So near words are counted by sums, and only one
row per word and prefix (its best neighbour there) leaves the scan.

Words over ``LONG`` code points have too many and too long rotations to write
out: theirs are 124-bit polynomial fingerprints of the same strings, found from
prefix sums, and every pair found is checked on the words themselves.

Forms lead to a word at least ``ratio`` times as frequent, so a chain has at most
19 words, and pointer doubling reaches every root in 5 joins.

Defined results: null texts have no words; a null id counts as an empty one;
repeated rows count again; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import column_bytes, small, stored, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
END = "$"
#: Longer words (code points) are handled by fingerprints of their rotations.
LONG = 96
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HELD = 300_000  # distinct words gathered before a task hands them on
_ROWS = 60_000  # rotations in an output batch


def misspelt(run: str, code: int, every: int) -> str:
    """The run, without one code point where ``every`` divides ``code``."""
    if code % every:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, every: int | None = None, shortest: int = 7, least: int = 2) -> DataFrame:
    """word, n: lower-cased letter runs of whole texts. ``every``: where it
    divides the crc32 of ``<doc_id>:<run>``, the run loses a code point first."""

    def work(batches):
        held: Counter = Counter()
        for batch in small(batches):
            ids = column_bytes(batch, "id")
            for doc, text in zip(ids, column_bytes(batch, "text")):
                start = zlib.crc32(doc + b":")
                for run, n in Counter(RUN.findall(text.translate(_LOWER).decode("utf-8", "replace"))).items():
                    if len(run) < shortest:
                        continue
                    word = misspelt(run, zlib.crc32(run.encode(), start), every) if every else run
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= _HELD:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    rows = docs.select(F.col("doc_id").cast("string").cast("binary").alias("id"), F.col("text").cast("binary").alias("text"))
    return (rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


# -- rotations as strings ------------------------------------------------------

def rotations(words: DataFrame) -> DataFrame:
    """prefix, last, n: every rotation as a prefix (last empty), and without its
    last character (which the prefix skips)."""

    def work(batches):
        for batch in batches:
            prefix, last, n = [], [], []
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, letter in enumerate(word):
                    prefix += (word[i:] + END + word[:i], word[i + 1:] + END + word[:i])
                    last += ("", letter)
                prefix.append(END + word)
                last.append("")
                n += [count] * (2 * len(word) + 1)
                if len(prefix) >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(last), pa.array(n, pa.int64())], names=["prefix", "last", "n"])
                    prefix, last, n = [], [], []
            if prefix:
                yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(last), pa.array(n, pa.int64())], names=["prefix", "last", "n"])

    return words.filter(F.length("word") <= LONG).select("word", "n").mapInArrow(work, "prefix string, last string, n long")


def _word(prefix: str, last: str) -> str:
    tail, _, head = prefix.partition(END)
    return head + last + tail


def scan_range(prefix: str, last: list[str], n: list[int]):
    """(word, near words here, n of the best of them, the best) of every member
    of one prefix range; members sorted by last, the whole rotation first."""
    letters = sorted((-c, x) for x, c in zip(last, n) if x)
    whole = n[0] if last[0] == "" else None
    # An indel counts at the first place of a run of equal letters only.
    joins = [(c, x) for c, x in letters if whole is not None and x != prefix[-1]]
    for c, x in letters:
        near = len(letters) - 1
        other = []
        if near:
            size, letter = letters[1] if letters[0][1] == x else letters[0]
            other.append((size, _word(prefix, letter)))
        if whole is not None and x != prefix[-1]:
            near += 1
            other.append((-whole, _word(prefix, "")))
        if near:
            size, word = min(other)
            yield _word(prefix, x), near, -size, word
    if joins:
        yield _word(prefix, ""), len(joins), -joins[0][0], _word(prefix, joins[0][1])


def _near_short(words: DataFrame) -> DataFrame:
    """word, near, best_n, best: one row per word and prefix range with company."""

    def work(batches):
        rest = None  # the last range of a batch may go on in the next
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if rest is not None:
                now = pa.concat_tables([rest, now]).combine_chunks()
            if not now.num_rows:
                continue
            ends = pc.run_end_encode(now.column("prefix").combine_chunks()).run_ends.to_numpy()
            begin = int(ends[-2]) if len(ends) > 1 else 0
            rest = now.slice(begin)
            yield _scanned(now, ends[:-1])
        if rest is not None and rest.num_rows:
            yield _scanned(rest.combine_chunks(), np.array([rest.num_rows]))

    rows = rotations(words)
    return (rows.repartition("prefix").sortWithinPartitions("prefix", "last")
            .mapInArrow(work, "word string, near long, best_n long, best string"))


def _scanned(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1].astype(np.int64)]) if len(ends) else np.zeros(0, np.int64)
    shared = np.flatnonzero(ends - starts > 1)
    out = []
    if len(shared):
        sizes = (ends - starts)[shared].astype(np.int64)
        take = np.repeat(starts[shared] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        part = rows.take(pa.array(take))
        prefix, last, n = (part.column(c).to_pylist() for c in ("prefix", "last", "n"))
        at = 0
        for size in sizes.tolist():
            out.extend(scan_range(prefix[at], last[at:at + size], n[at:at + size]))
            at += size
    word, near, best_n, best = zip(*out) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())],
                                      names=["word", "near", "best_n", "best"])


# -- rotations as fingerprints (long words) -------------------------------------

_MODULI = ((2147483647, 1_000_003), (2147483629, 998_244_353), (2147483587, 1_000_000_007), (2147483579, 715_827_883))


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), modulus)) % np.uint64(modulus)])
    return out[:n]


def rotation_codes(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 62-bit codes and the skipped code point (0: none) of every rotation
    of ``word``, in whole and without the last character."""
    letter = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = len(letter)
    found = []
    for modulus, base in _MODULI:
        m = np.uint64(modulus)
        up, down = _powers(base, modulus, size + 2), _powers(pow(base, -1, modulus), modulus, size + 2)
        head = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter * up[:size] % m) % m])
        end = np.uint64(ord(END))

        def code(tail_from: np.ndarray, head_to: np.ndarray) -> np.ndarray:
            length = size - tail_from
            tail = (head[size] + m - head[tail_from]) % m * down[tail_from] % m
            return (tail + end * up[length] % m + head[head_to] * up[length + 1] % m) % m

        i = np.arange(size + 1)
        found.append(np.concatenate([code(i, i), code(i[1:], i[:-1])]))
    last = np.concatenate([np.zeros(size + 1, np.int64), letter.astype(np.int64)])
    pair = [(a << np.uint64(31) | b).astype(np.int64) for a, b in (found[:2], found[2:])]
    return pair[0], pair[1], last


def _near_long(words: DataFrame) -> DataFrame:
    """As ``_near_short``, for pairs with a word over ``LONG``: one row per pair and side."""

    def work(batches):
        for batch in batches:
            for word, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b, last = rotation_codes(word)
                for at in range(0, len(a), _ROWS):
                    part = slice(at, at + _ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), pa.array(last[part]), pa.array(np.full(len(a[part]), code))],
                                                     names=["a", "b", "last", "id"])

    # >= LONG: a word of that length may neighbour one of LONG + 1.
    some = words.filter(F.length("word") >= LONG).select("word", "n", F.xxhash64("word").alias("id"))
    codes = some.select("word", "id").mapInArrow(work, "a long, b long, last long, id long")
    left, right = codes, codes.select("a", "b", F.col("last").alias("last2"), F.col("id").alias("id2"))
    pairs = (left.join(right, ["a", "b"]).filter(F.col("id") != F.col("id2"))
             .filter((F.col("last") != 0) | (F.col("last2") != 0)).select("id", "id2").distinct())
    other = some.select(F.col("word").alias("best"), F.col("n").alias("best_n"), F.col("id").alias("id2"))
    return (pairs.join(some, "id").join(other, "id2")
            .filter((F.length("word") > LONG) | (F.length("best") > LONG))
            .filter(F.levenshtein("word", "best", 1) == 1)
            .select("word", F.lit(1).cast("long").alias("near"), "best_n", "best"))


# -- forms and roots -------------------------------------------------------------

def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n of every word with a near word."""
    rows = _near_short(words).unionByName(_near_long(words))
    top = F.min(F.struct((-F.col("best_n")).alias("size"), F.col("best")))
    return (rows.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("top"))
            .select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.size")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms, by pointer doubling."""
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                              F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """words: word, n (one row a word). word, n, n_near, form, form_n, root."""
    words = stored(words.select("word", "n"), "words")
    near = near_words(words).select(F.col("word").alias("w"), "n_near", "best", "best_n")
    known = words.join(near, F.col("word") == F.col("w"), "left").drop("w")
    is_form = F.col("best_n") >= F.lit(ratio) * F.col("n")
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "variants")
    ends = roots(known.filter(F.col("form").isNotNull()))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    counts = word_counts(table(spark, sf_dir, "documents"), every=31)
    return spelling_variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 is spelt out (DuckDB has none): a table of 256 remainders made by rule,
#: then one step a byte.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS b))),
runs AS (
  SELECT id, run, count(*) AS c FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
coded AS (
  SELECT run, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(id || ':' || run, ''), lambda x:
      CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))),
    lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) AS h
  FROM runs, crc),
spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c
  FROM coded),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
turned AS (
  SELECT word, n, substr(word, CAST(i AS INTEGER) + 2) || '$' || substr(word, 1, CAST(i AS INTEGER)) AS prefix, true AS cut
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
  UNION ALL
  SELECT word, n, substr(word, CAST(i AS INTEGER) + 1) || '$' || substr(word, 1, CAST(i AS INTEGER)), false
  FROM (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
  FROM turned a JOIN turned b ON a.prefix = b.prefix AND a.word <> b.word AND (a.cut OR b.cut)),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS now, form AS next FROM known
  UNION ALL
  SELECT c.word, k.word, k.form FROM chain c JOIN known k ON c.next = k.word)
SELECT k.word, k.form, c.now AS root, k.n, CAST(k.n_near AS BIGINT) AS n_near, CAST(k.form_n AS BIGINT) AS form_n
FROM known k JOIN chain c ON c.word = k.word AND c.next IS NULL
"""
