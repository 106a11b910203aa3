import hashlib
import random

import pytest

from tidings.llm import suffix as S


def plain(rows, length=100):
    """{id: (bytes, removed, runs, sha256)} by a dictionary of all strings."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(3)
    parts = ["".join(rng.choice("abé cd") for _ in range(rng.randint(60, 400))) for _ in range(20)]
    rows = [(None, parts[0] * 2), (1000, None), (1001, ""), (1002, "a" * 700), (1003, "ab" * 500 + "x" + "ab" * 90), (1004, "z" * 99), (1005, "z" * 100), (1006, "z" * 100)]
    for i in range(120):
        rows.append((i, "".join(rng.choice([rng.choice(parts), "".join(rng.choice("xyz w") for _ in range(rng.randint(1, 90)))])
                                for _ in range(rng.randint(1, 7)))))
    return rows + [(2000 + i, rows[20 + i % 3][1]) for i in range(20)]


@pytest.mark.parametrize("step,hot", [(16, 50_000), (16, 3), (5, 20)])
def test_matches_brute_force(spark, step, hot):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "kept", 1) for d, t in rows], "doc_id long, text string, kept_from string, at int").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.dedup(docs, step=step, hot=hot, kept="sha256").collect()}
    assert got == plain(rows)


def test_long_text_over_several_pieces(spark, monkeypatch):
    rng = random.Random(8)
    unit = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows = [(1, "".join(rng.choice("klmnop") for _ in range(1_200_000))), (2, "x" + unit), (3, unit + "y" * 200 + unit)]
    rows.append((4, rows[0][1][500_000:700_000] + "!" + unit[:150]))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string"), kept="sha256").collect()}
    assert got == plain(rows)


def test_repeated_rows_and_ids(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(500))
    docs = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in S.dedup(docs, kept="sha256").collect()), key=str)
    first = plain([(1, t)])[1][1]
    assert got == sorted([(1, first), (1, first), (2, 500), (None, 500), (None, 0)], key=str)


def test_stage_keeps_rows_and_columns(spark):
    t = "é" * 120 + "".join(chr(97 + i * 7 % 26) for i in range(130))
    docs = spark.createDataFrame([(1, t, "en", "s", 5, {"a": 1}), (2, "x" + t, "en", None, None, None), (3, None, None, None, 0, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept map<string,int>")
    out = S.cut_repeats(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[3]["text"] == "" and rows[2]["lang"] == "en" and rows[1]["kept"] == {"a": 1}
    assert rows[2]["text"].startswith("x") and len(rows[2]["text"]) < 20 and rows[2]["n_chars"] == len(rows[2]["text"])
    assert S.cut_repeats(docs.limit(0)).collect() == []


def test_query_against_brute_force_on_the_small_table(spark):
    from conftest import SF_SMALL
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.op7_suffix_dedup(spark, SF_SMALL).collect()}
    assert got == plain(rows)
