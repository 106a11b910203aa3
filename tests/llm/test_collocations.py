"""Phrase collocations against plain counting, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidings.llm import collocations as C


def plain(rows, least, cover, first):
    """The report from dictionaries of all phrases, in exact integers."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        above = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    above[p[i:i + m]] = max(above[p[i:i + m]], a)
        kept = []
        for p, a in cand.items():
            if 100 * above[p] >= cover * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts(seed, n, words=12):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" if i % 3 else f"é{i}" for i in range(words)]
    fixed = ["w1 w2 w4 w5", "é0 w1", "w7 w7 w7 w7 w7"]
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else vocabulary[int(rng.expovariate(0.4)) % words])
            parts.append(rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "!?"]))
        yield rng.choice(["en", "en", "d\ne\t", None, "und"]), "".join(parts)


@pytest.mark.parametrize("chunk", [7, 64, 5000])
def test_phrases_against_plain_counting(spark, chunk):
    rows = [*texts(1, 150), ("en", None), (None, ""), ("de", " . , "), ("fr", "only one"), *[("en", "Ab Cd ef gh ij")] * 9]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "lang string, text string, phrase string, n int").repartition(3)
    assert found(C.collocations(df, least=4, cover_percent=80, first=25, chunk=chunk, tile_words=chunk)) == plain(rows, 4, 80, 25)


def test_long_text_is_cut_without_loss(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("en", " ".join(rng.choice("abcd") for _ in range(3000))), ("en", "a" * 5000 + " " + "b" * 5000 + " " + "a" * 5000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(C.collocations(df, least=10, first=500, chunk=100)) == plain(rows, 10, 80, 500)
    text = b"ab cd\nefghijklmnop q  r " * 5 + b"x" * 90
    assert b"".join(C._parts(text, 16)) == text and all(p[-1:] in b" \nx" for p in C._parts(text, 16))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "lang string, text string, rank int")
    assert C.collocations(df).count() == 0
    assert C.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


@pytest.mark.parametrize("top", [40, 3000, 1 << 40])
def test_tiles_count_like_a_dictionary(monkeypatch, top):
    monkeypatch.setattr(C, "_DENSE", 500)
    rng = np.random.default_rng(4)
    a, b = (np.minimum(rng.zipf(1.3, 20_000), top).astype(np.int64) for _ in "ab")
    x, y, n, code = C.tile_counts(a, b)
    assert Counter(zip(a.tolist(), b.tolist())) == dict(zip(zip(x.tolist(), y.tolist()), n.tolist()))
    assert len(set(zip(x.tolist(), y.tolist()))) == len(x)
    assert (x[code] == a).all() and (y[code] == b).all()


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    a = 5 * 10**17 + 3
    left, right = 10**18 + 9, 7 * 10**18
    got = spark.range(1).select(C._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()["s"]
    assert got == 2_000_000 * a // (left + right)


def test_ranks_are_dense_and_by_frequency_within_tiles(spark):
    rows = [("en", " . ".join(f"w{i:03d}" for i in range(300) for _ in range(2 + i % 7)))] * 3
    level = C.phrase_levels(spark.createDataFrame(rows, "lang string, text string"), 9, 400, 200)
    got = level["words"].orderBy("id").collect()
    assert {r["word"]: r["f"] for r in got} == {f"w{i:03d}": 3 * (2 + i % 7) for i in range(300) if 3 * (2 + i % 7) >= 9}
    tiles = 1 + sum(len(t) for _, t in rows) // 1200
    assert tiles > 5 and len({r["id"] for r in got}) == len(got)
    for t in range(tiles):
        here = [r for r in got if r["id"] % tiles == t]
        assert [r["id"] // tiles for r in here] == list(range(len(here)))
        assert [(-r["f"], r["word"]) for r in here] == sorted((-r["f"], r["word"]) for r in here)
    assert level["totals"].first()["n"] == sum(3 * (2 + i % 7) for i in range(300)) and level["pairs"].count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    columns = [np.sort(rng.integers(0, 1 << 40, 100)), rng.integers(0, 1 << 62, 100), np.arange(100)]
    assert all((x == y).all() for x, y in zip(columns, C._unpacked(C._packed(*columns), 100, 3)))


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = found(C.op12_collocations(spark, sf))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.sql(C.OP12_SQL).fetchall()) and got
