"""Spelling variants against plain pairwise comparison."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidings.llm import variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts):
    """word -> (form, root, n, n_near, form_n) by comparing all pairs."""
    near = {w: sorted((-counts[v], v) for v in counts if one_edit(w, v)) for w in counts}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 10 * counts[w] else None for w in counts}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_small_alphabet_against_all_pairs(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé÷") for _ in range(rng.randint(1, 6))): rng.choice([2, 3, 20, 200, 2000]) for _ in range(400)}
    words |= {"aaaaaaa": 5, "aaaaaa": 50, "aaaaaaaa": 500, "x" * 7: 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert found(variants.spelling_variants(df)) == plain(words)


def test_long_words_meet_across_the_limit(spark):
    base = "ab" * ((variants.LONG + 1) // 2)
    size = variants.LONG
    words = {base[:size]: 9, base[:size] + "c": 100, "c" + base[:size]: 3, base[:size - 1]: 7, base[:5] + "z" + base[6:size]: 4,
             base[:size] + "cd": 1000, "q" * 5000: 8, "q" * 5001: 90, "q" * 4000 + "r" + "q" * 1000: 3, "b" + "q" * 5001: 900}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(variants.spelling_variants(df)) == plain(words)


def test_rotation_codes_are_those_of_the_strings():
    a, b, last = variants.rotation_codes("abcabca")
    words = {}
    for x, y, z in zip(a.tolist(), b.tolist(), last.tolist()):
        words.setdefault((x, y), []).append(z)
    assert len(words) == 15  # 8 whole rotations and 7 shortened ones, all different
    other = variants.rotation_codes("abcaca")  # one letter less
    shared = set(words) & set(zip(other[0].tolist(), other[1].tolist()))
    assert len(shared) == 1 and words[shared.pop()] == [ord("b")]


def plain_counts(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def test_counts_with_deletions_and_edges(spark):
    rng = random.Random(5)
    stems = ["Understanding", "straßenbahn", "ÉLÉPHANTS", "collections", "abcdefg", "short"]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(40)) + " 7×8 naïveté-naïveté") for i in range(120)]
    rows += [(None, "Collections collections"), (7, None), (8, ""), (9, "x" * 30000 + " " + "x" * 30000), (9, "x" * 30000)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r["word"]: r["n"] for r in variants.word_counts(docs, every=31).collect()}
    assert got == plain_counts(rows)
    assert any(len(w) == len("understanding") - 1 and w.startswith("u") for w in got)
    empty = docs.filter("false")
    assert variants.spelling_variants(variants.word_counts(empty, 31)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_against_sql(spark, sf):
    import duckdb

    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.op11_spelling_variants(spark, sf).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(variants.OP11_SQL).fetchall()
    assert got == set(want) and len(got) == len(want) > 100
