"""Operator 12, phrase collocations by direct-address tiling.

Words that reach the least count are ranked by frequency; a pair of neighbours is
then a cell of the matrix (rank, rank). The matrix is cut into square tiles.
Because ranks fall with frequency, the pairs of a text run crowd into the tiles
near the origin: a tile with many pairs is counted by ``np.bincount`` over all its
cells (direct addresses, no hashing or sorting), the pairs of all other tiles are
kept as a sorted list of coordinates (COO) and counted by run lengths. Spark adds
up the cells of all text runs. The pairs that reach the least count are ranked in
turn, and the same step runs on them: two pairs that overlap in a word are a
phrase of three, two such phrases one of four. A phrase can only be frequent if
both its overlapping parts are, so nothing is lost.

A phrase of three words is a pair of ranked pairs that overlap in a word, one of four
a pair of ranked pairs side by side (whose middle pair has a rank too): one more
run of the same step counts both.

How ids reach the texts without a dictionary on every worker: a task reads texts
into *chunks* (one language, a bounded number of words) of local item numbers. The
distinct items of a chunk and their counts are dealt over *tasks tiles* by a hash
of the item, one packed row per chunk and tile. The task of a tile adds its items
up over all chunks, ranks the frequent ones, and answers every chunk with the ranks
of the items it sent; the answers come back by a cogroup on the chunk's number.
No row is made per word or pair. The rank of an item is (place by frequency in its
tile) x tiles + tile: dense, and by falling frequency but for the chance of the
hash. A chunk that ends inside a piece hands its last three words on as
context, so no phrase is lost at the cut and none counted twice.

Spread: the number of tiles grows with the table. A chunk holds an item once, so a
word or pair that makes up a third of all text is one entry per chunk, and a tile
holds a hashed share of all items. Reports take the first rows per language before
the shuffle.

Defined results: null texts have no words, a null language is ``und`` and one with
the literal value; repeated rows count again; a table without a frequent pair gives
no rows; extra columns are ignored. Counts are longs; scores are computed in
38-digit decimals.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.common import column_bytes, mix64, small, stored, table

#: Words gathered by a task before its chunks are handed on.
CHUNK = 1 << 21
#: Side of a tile, and how many tiles from the origin may be dense.
SIDE = 1024
BANDS = 16
_DENSE = SIDE * SIDE // 16  # pairs from which a tile is counted by address
#: Words of the table per tile that items are dealt over.
TILE_WORDS = 1 << 22
_CONTEXT = 3  # words handed on to the next chunk of a text
_PART = 1 << 20  # bytes of text split at a time
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


# -- texts to chunks ---------------------------------------------------------------

class _Numbers(dict):
    """Item numbers in order of appearance; 0 is the end of a piece, 1 nothing."""

    def __missing__(self, key):
        self[key] = len(self)
        return len(self) - 1


def _parts(text: bytes, size: int = _PART):
    """A folded text cut behind a blank or end of piece, about ``size`` bytes each."""
    start = 0
    while len(text) - start > size:
        cut = max(text.rfind(b" ", start, start + size), text.rfind(b"\n", start, start + size)) + 1
        if cut <= start:
            ahead = [at for at in (text.find(b" ", start + size), text.find(b"\n", start + size)) if at >= 0]
            if not ahead:
                break
            cut = min(ahead) + 1
        yield text[start:cut]
        start = cut
    yield text[start:]


class _Run:
    """The words of one language that a task has gathered so far."""

    def __init__(self, context: list[bytes] = ()):
        self.numbers = _Numbers({b"\n": 0, b"": 1})
        self.codes: list[np.ndarray] = []
        self.size = 0
        self.last = list(context)
        if context:
            self._add(list(context))

    def _add(self, tokens: list[bytes]) -> None:
        found = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
        found = found[found != 1]
        self.codes.append(found)
        self.size += len(found)

    def read(self, part: bytes) -> None:
        tokens = part.replace(b"\n", b" \n ").split(b" ")
        self._add(tokens)
        tail = [t for t in tokens[-64:] if t][-_CONTEXT:]
        if len(tail) < _CONTEXT:
            tail = [t for t in tokens if t][-_CONTEXT:]
        self.last = (self.last + tail)[-_CONTEXT:]

    def chunk(self, number: int, lang: str, inside: bool, tiles: int) -> list[tuple]:
        """The chunk's rows; ``inside``: the text goes on, so the last words are
        context only and start no phrase here."""
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int32)
        own = len(codes) - len(self.last) if inside else len(codes)
        if own <= 0:
            return []
        words = pa.array(list(self.numbers)[2:], pa.binary())
        codes = np.where(codes == 0, -1, codes - 2)  # an end of piece is -1
        mine = codes[:own]
        n = np.bincount(mine[mine >= 0], minlength=len(words))
        # Items are numbered by tile, then by word.
        start = zlib.crc32(lang.encode() + b"\t")
        tile = np.array([zlib.crc32(w, start) % tiles for w in self.numbers], np.int64)[2:]
        by = pc.sort_indices(words).to_numpy()
        by = by[np.argsort(tile[by], kind="stable")]
        place = np.empty(len(by) + 1, np.int64)
        place[by], place[-1] = np.arange(len(by)), -1
        rows = [(number, "codes", 0, 0, own, len(codes), _packed_codes(place[codes]))]
        words, n, tile = words.take(pa.array(by)), n[by], tile[by]
        for t, first, last in _runs(tile):
            raw = lang.encode() + b"\n" + b"\n".join(words[first:last].to_pylist())
            data = _planes(n[first:last]) + raw
            rows.append((number, "words", t, first, last - first, len(data), pa.compress(data, codec="zstd", asbytes=True)))
        return rows


def _runs(sorted_values: np.ndarray):
    """(value, first, last + 1) of every run of equal values."""
    edge = np.flatnonzero(np.diff(sorted_values)) + 1
    for first, last in zip([0, *edge.tolist()], [*edge.tolist(), len(sorted_values)]):
        if last > first:
            yield int(sorted_values[first]), first, last


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte (all lowest bytes first): the many zero bytes lie together."""
    return np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(data, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T).reshape(-1).view(np.int64)


def _packed(first: np.ndarray, *others: np.ndarray) -> bytes:
    """Equally long columns of whole numbers, the first as differences."""
    return pa.compress(b"".join([_planes(np.diff(first, prepend=0)), *(_planes(c) for c in others)]), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = pa.decompress(data, decompressed_size=8 * n * columns, codec="zstd", asbytes=True)
    found = [_unplaned(raw[8 * n * c:8 * n * (c + 1)], n) for c in range(columns)]
    return [np.cumsum(found[0]), *found[1:]]


def _packed_codes(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _codes(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * size, codec="zstd", asbytes=True), np.int32)


#: Rows of chunks: the item numbers of all its words (kind ``codes``: count is
#: the number of words it owns), and per tile the items that go there.
_ROWS = "chunk long, kind string, tile long, first int, count int, size int, data binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "kind", "tile", "first", "count", "size", "data"])


def word_chunks(docs: DataFrame, tiles: int, chunk: int = CHUNK) -> DataFrame:
    """docs: lang, text. The chunks' rows, items of kind ``words``."""

    def work(batches):
        part_of = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        made, gathered, runs = 0, 0, {}

        def flush(open_lang):
            nonlocal made, gathered, runs
            kept = {}
            for lang, run in runs.items():
                rows = run.chunk(part_of + made, lang, lang == open_lang, tiles)
                made += 1
                if lang == open_lang:
                    kept[lang] = _Run(run.last)
                if rows:
                    yield _batch(rows)
            runs, gathered = kept, sum(r.size for r in kept.values())

        for batch in small(batches):
            langs = batch.column(0).to_pylist()
            for lang, text in zip(langs, column_bytes(batch, "text")):
                for part in _parts(text.translate(_FOLD)):
                    run = runs.setdefault(lang, _Run())
                    gathered -= run.size
                    run.read(part)
                    gathered += run.size
                    if gathered >= chunk:
                        yield from flush(lang)
                if lang in runs:
                    runs[lang].read(b"\n")
        yield from flush(None)

    return (docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(work, _ROWS))


# -- pairs of ranked items, counted by tiles -------------------------------------------

def tile_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a, b) with their counts, and the number of each given pair.

    Tiles near the origin with many pairs are counted by address, all others as
    one sorted list of coordinates.
    """
    code = np.full(len(a), -1, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    total = 0
    band_a, band_b = a // SIDE, b // SIDE
    near = np.flatnonzero((band_a < BANDS) & (band_b < BANDS))
    tile = band_a[near] * BANDS + band_b[near]
    for t in np.flatnonzero(np.bincount(tile, minlength=BANDS * BANDS) >= _DENSE):
        rows = near[tile == t]
        cell = (a[rows] % SIDE) * SIDE + b[rows] % SIDE
        count = np.bincount(cell, minlength=SIDE * SIDE)
        filled = np.flatnonzero(count)
        place = np.empty(SIDE * SIDE, np.int64)
        place[filled] = np.arange(total, total + len(filled))
        code[rows] = place[cell]
        found.append((filled // SIDE + t // BANDS * SIDE, filled % SIDE + t % BANDS * SIDE, count[filled]))
        total += len(filled)
    rows = np.flatnonzero(code < 0)
    if len(rows):
        x, y = a[rows], b[rows]
        width = int(y.max()) + 1
        order = np.argsort(x * width + y, kind="stable") if int(x.max()) < (1 << 62) // width else np.lexsort((y, x))
        x, y = x[order], y[order]
        head = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        start = np.flatnonzero(head)
        code[rows[order]] = total + np.cumsum(head) - 1
        found.append((x[start], y[start], np.diff(np.append(start, len(x)))))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (code,)
    return (*(np.concatenate(c) for c in zip(*found)), code)


def _tile_of(a: np.ndarray, b: np.ndarray, tiles: int) -> np.ndarray:
    mixed = mix64(mix64(a.astype(np.uint64)) + b.astype(np.uint64))
    return (mixed % np.uint64(tiles)).astype(np.int64)


def _pair_rows(chunk: int, own: int, ids: np.ndarray, kind: str, tiles: int) -> list[tuple]:
    """Rows of the pairs in a chunk's ranks (-1: none): of ``pairs`` and ``threes`` the
    neighbours, of ``fours`` those with one between, which has a rank too."""
    ahead = 2 if kind == "fours" else 1
    known = ids >= 0
    starts = known[:len(ids) - ahead] & known[ahead:]
    if ahead == 2:
        starts &= known[1:-1]
    at = np.flatnonzero(starts)
    a, b, n, code = tile_counts(ids[at], ids[at + ahead])
    middle = np.zeros(len(a), np.int64)
    if ahead == 2:
        middle[code] = ids[at + 1]
    # Phrases that start behind the chunk's own words are counted by the next chunk.
    late = code[np.searchsorted(at, own):]
    n = n - np.bincount(late, minlength=len(n))
    tile = _tile_of(a, b, tiles)
    by = np.argsort(tile.astype(np.uint16) if tiles <= 1 << 16 else tile, kind="stable")
    rows = []
    if kind == "pairs":  # these go on: their numbers become the chunk's codes
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        codes = np.full(len(ids), -1, np.int64)
        codes[at] = place[code]
        rows.append((chunk, "codes", 0, 0, own, len(codes), _packed_codes(codes)))
    else:
        by = by[n[by] > 0]
    a, b, middle, n, tile = (c[by] for c in (a, b, middle, n, tile))
    for t, first, last in _runs(tile):
        here = slice(first, last)
        rows.append((chunk, kind, t, first, last - first, 0, _packed(a[here], b[here], middle[here], n[here])))
    return rows


def pair_chunks(codes: DataFrame, ranks: DataFrame, kinds: tuple[str, ...], tiles: int) -> DataFrame:
    """The next level's rows: codes (chunk rows of kind ``codes``) with the ranks
    (chunk, count, data) of their items."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():  # one: a chunk has one row
            code = _codes(row["data"], row["size"])
            rank = np.full(max(int(code.max(initial=-1)), -1) + 2, -1, np.int64)  # code -1 reads the last cell
            for answer in right.to_pylist():
                item, found = _unpacked(answer["data"], answer["count"], 2)
                rank[item] = found
            ids = rank[code]
            for kind in kinds:
                out += _pair_rows(row["chunk"], row["count"], ids, kind, tiles)
        return pa.Table.from_batches([_batch(out)])

    # A new name for the right side's key: both sides read the same table.
    right = ranks.select(F.col("chunk").alias("of"), "count", "data").groupBy("of")
    left = codes.select("chunk", "count", "size", "data").groupBy("chunk")
    return left.cogroup(right).applyInArrow(work, _ROWS)


#: What a tile finds: one row ``found`` with its frequent items, one row ``ranks``
#: per chunk (item numbers and ranks), and for words a row ``total`` per language.
_FOUND = ("chunk long, kind string, tile long, count int, data binary, lang array<string>, word array<string>, "
          "a array<long>, b array<long>, m array<long>, f array<long>, id array<long>")
_FOUND_SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("tile", pa.int64()), ("count", pa.int32()), ("data", pa.binary()),
                           *((c, pa.list_(pa.string())) for c in ("lang", "word")), *((c, pa.list_(pa.int64())) for c in ("a", "b", "m", "f", "id"))])


def _summed(number: np.ndarray, n: np.ndarray, distinct: int) -> np.ndarray:
    order = np.argsort(number, kind="stable")
    head = np.searchsorted(number[order], np.arange(distinct))
    return np.add.reduceat(n[order], head) if distinct else np.zeros(0, np.int64)


def tile_reducer(least: int, tiles: int):
    """All rows of one (kind, tile) -> ``_FOUND`` rows."""

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        kind, tile = rows[0]["kind"], rows[0]["tile"]
        counts = np.array([r["count"] for r in rows])
        extra = {}
        if kind == "words":
            n, words = [], []
            for r in rows:
                raw = pa.decompress(r["data"], decompressed_size=r["size"], codec="zstd", asbytes=True)
                n.append(_unplaned(raw[:8 * r["count"]], r["count"]))
                found = raw[8 * r["count"]:].split(b"\n")  # the language, which may hold any character, then the words
                lang = b"\n".join(found[:-r["count"]]) + b"\t"
                words += [lang + w for w in found[-r["count"]:]]
            n = np.concatenate(n)
            keys = pa.array(words, pa.binary()).dictionary_encode()
            number, keys = keys.indices.to_numpy(), keys.dictionary
            order = np.empty(len(keys), np.int64)
            order[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
        else:
            a, b, m, n = (np.concatenate(c) for c in zip(*(_unpacked(r["data"], r["count"], 4) for r in rows)))
            x, y, _, number = tile_counts(a, b)
            middle = np.empty(len(x), np.int64)
            middle[number] = m
            order = np.empty(len(x), np.int64)
            order[np.lexsort((y, x))] = np.arange(len(x))
        f = _summed(number, n, len(order))
        often = np.flatnonzero(f >= least)
        often = often[np.lexsort((order[often], -f[often]))]
        rank = np.full(len(order), -1, np.int64)
        rank[often] = np.arange(len(often)) * tiles + tile
        if kind == "words":
            langs, words = zip(*(k.decode("utf-8", "replace").rsplit("\t", 1) for k in keys.take(pa.array(often)).to_pylist())) if len(often) else ((), ())
            extra = {"lang": langs, "word": words}
        else:
            extra = {"a": x[often], "b": y[often], "m": middle[often]}
        out = [{"kind": f"found-{kind}", "tile": tile, "f": f[often], "id": rank[often], **extra}]
        if kind == "words":
            owner = [k.rsplit(b"\t", 1)[0].decode("utf-8", "replace") for k in keys.to_pylist()]
            totals: dict[str, int] = {}
            for lang, size in zip(owner, f.tolist()):
                totals[lang] = totals.get(lang, 0) + size
            out.append({"kind": "total", "lang": list(totals), "f": list(totals.values())})
        if kind in ("words", "pairs"):
            ranks, at = rank[number], 0
            for r, size in zip(rows, counts.tolist()):
                here = np.flatnonzero(ranks[at:at + size] >= 0)
                if len(here):
                    out.append({"chunk": r["chunk"], "kind": "ranks", "tile": tile, "count": len(here), "data": _packed(here + r["first"], ranks[at + here])})
                at += size
        return pa.Table.from_pylist(out, schema=_FOUND_SCHEMA)

    return work


def _reduced(rows: DataFrame, least: int, tiles: int, name: str) -> DataFrame:
    return stored(rows.filter(F.col("kind") != "codes").groupBy("kind", "tile").applyInArrow(tile_reducer(least, tiles), _FOUND), name)


def _items(found: DataFrame, kind: str, *columns: str) -> DataFrame:
    rows = found.filter(F.col("kind") == kind).select(F.explode(F.arrays_zip(*columns)).alias("item"))
    return rows.select(*(F.col("item")[c].alias(c) for c in columns))


def phrase_levels(docs: DataFrame, least: int = 30, chunk: int = CHUNK, tile_words: int = TILE_WORDS) -> dict[str, DataFrame]:
    """``totals`` (lang, n: all words), ``words`` (lang, word, f, id), ``pairs``
    (a, b, f, id) of word ids, ``threes`` and ``fours`` (a, b, m, f, id) of pair ids:
    all items that occur ``least`` times."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tiles = 1 + int(size) // (6 * tile_words)  # about six bytes a word
    one = stored(word_chunks(docs, tiles, chunk), "chunks-1")
    words = _reduced(one, least, tiles, "tiles-1")

    def of(rows: DataFrame, kind: str) -> DataFrame:
        return rows.filter(F.col("kind") == kind)

    two = stored(pair_chunks(of(one, "codes"), of(words, "ranks"), ("pairs",), tiles), "chunks-2")
    pairs = _reduced(two, least, tiles, "tiles-2")
    more = _reduced(pair_chunks(of(two, "codes"), of(pairs, "ranks"), ("threes", "fours"), tiles), least, tiles, "tiles-3")
    return {"totals": _items(words, "total", "lang", "f").groupBy("lang").agg(F.sum("f").alias("n")),
            "words": _items(words, "found-words", "lang", "word", "f", "id"),
            "pairs": _items(pairs, "found-pairs", "a", "b", "f", "id"),
            "threes": _items(more, "found-threes", "a", "b", "f", "id"),
            "fours": _items(more, "found-fours", "a", "b", "m", "f", "id")}


# -- scores and report ---------------------------------------------------------------

def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 a / (left + right)), exact."""
    wide = F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(20,0)")
    both = left.cast("decimal(20,0)") + right.cast("decimal(20,0)")
    return F.call_function("div", wide, both)


def _cut(k: int, a: Column, left: Column, right: Column) -> Column:
    return F.struct(_score(a, left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def collocations(docs: DataFrame, least: int = 30, cover_percent: int = 80, first: int = 2000, chunk: int = CHUNK,
                 tile_words: int = TILE_WORDS) -> DataFrame:
    """docs: lang, text. lang, rank, phrase, a, l, r, n, score: each language's
    ``first`` phrases by score, a (both falling) and phrase."""
    level = phrase_levels(docs.select("lang", "text"), least, chunk, tile_words)
    f = F.col("f")

    def side(lower: DataFrame, name: str) -> DataFrame:
        return lower.select(*(F.col(c).alias(name if c == "id" else f"{name}_{c}") for c in lower.columns))

    words, pairs = level["words"], level["pairs"]
    two = stored(pairs.join(side(words, "a"), "a").join(side(words, "b"), "b").select(
        "id", "f", F.col("a_lang").alias("lang"), F.array("a_word", "b_word").alias("words"),
        F.col("a_f").alias("fa"), F.col("b_f").alias("fb"), F.array(_cut(1, f, F.col("a_f"), F.col("b_f"))).alias("cuts")), "phrases-2")
    # Of the parts only what a cut needs: words, counts of the pair and of its two words.
    part = two.select("id", "lang", "words", "f", "fa", "fb")
    three = stored(level["threes"].join(side(part, "a"), "a").join(side(part, "b"), "b").select(
        "id", "a", "b", "f", F.col("a_lang").alias("lang"), F.concat("a_words", F.slice("b_words", 2, 1)).alias("words"),
        F.array(_cut(1, f, F.col("a_fa"), F.col("b_f")), _cut(2, f, F.col("a_f"), F.col("b_fb"))).alias("cuts")), "phrases-3")
    # The first three words are the phrase of pairs (a, m), the last three that of (m, b).
    head = three.select(F.col("a"), F.col("b").alias("m"), F.col("f").alias("head_f"), F.col("id").alias("head"))
    tail = three.select(F.col("a").alias("m"), F.col("b"), F.col("f").alias("tail_f"), F.col("id").alias("tail"))
    four = (level["fours"].join(head, ["a", "m"]).join(tail, ["m", "b"]).join(side(part, "a"), "a").join(side(part, "b"), "b").select(
        "id", "head", "tail", "f", F.col("a_lang").alias("lang"), F.concat("a_words", "b_words").alias("words"),
        F.array(_cut(1, f, F.col("a_fa"), F.col("tail_f")), _cut(2, f, F.col("a_f"), F.col("b_f")),
                _cut(3, f, F.col("head_f"), F.col("b_fb"))).alias("cuts")))
    four = stored(four, "phrases-4")

    def uncovered(grams: DataFrame, above: DataFrame, *parts: str) -> DataFrame:
        """Phrases without one word more around them in nearly all their places. A
        phrase longer by two is no more frequent than the one between."""
        top = (above.select(F.explode(F.array(*parts)).alias("id"), F.col("f").alias("above"))
               .groupBy("id").agg(F.max("above").alias("above")))
        more = F.col("above").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * cover_percent
        return grams.join(top, "id", "left").filter(~F.coalesce(more, F.lit(False)))

    shown = ["lang", "words", "f", "cuts"]
    kept = (uncovered(two, three, "a", "b").select(*shown).unionByName(uncovered(three, four, "head", "tail").select(*shown))
            .unionByName(four.select(*shown)))
    worst = kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.array_min("cuts").alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = (worst.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
           .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first))
    return top.join(level["totals"], "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
counts AS (
  SELECT lang, phrase, k, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k)))
  GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS above
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS m) WHERE m < k)
  GROUP BY ALL),
kept AS (
  SELECT o.* FROM worst o LEFT JOIN inside i ON i.lang = o.lang AND i.phrase = o.phrase
  WHERE i.above IS NULL OR 100 * i.above < 80 * o.a)
SELECT kept.lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) kept
JOIN totals ON totals.lang = kept.lang
WHERE rank <= 2000
"""
