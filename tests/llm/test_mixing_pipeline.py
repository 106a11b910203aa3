import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL

import corpus_pipeline as P
from tidings.llm import mixing as M


def plain_targets(sizes, most=3.0):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, None: 10}, {"a": 1, "b": 1000, "c": 3, "d": 0}, {"é": 5, "z": 50, "Z": 500}, {"a": 0}, {}])
def test_targets(sizes):
    got, want = M.targets_of(sizes), plain_targets(sizes) if sizes else {}
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_permutations_are_permutations():
    for size in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (0, 5, 10**15):
            assert sorted(M.permuted(np.arange(size), size, key).tolist()) == list(range(size))
    a, b = M.permuted(np.arange(1000), 1000, 1), M.permuted(np.arange(1000), 1000, 2)
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.2


def _check(rows, docs):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((d, s, count(t)) for d, t, s in docs)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += count(t)
    target = plain_targets(dict(sizes))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
    return sizes, target, taken


def test_mix_small_blocks_edges_and_reruns(spark):
    docs = [(i, " ".join(["w"] * (i % 40)), f"s{i % 5}" if i % 7 else None) for i in range(400)]
    docs += [(1000, None, "s1"), (1001, "", "only-empty"), (1002, "x" * 50_000 + " y" * 900, "tiny"), (1002, "x" * 50_000 + " y" * 900, "tiny"), (None, "a b c", "s0")]
    df = spark.createDataFrame([(d, t, s, 7) for d, t, s in docs], "doc_id long, text string, source string, size int").repartition(3)
    rows = M.mix(df, block=4, slots=64, rows_per_chunk=50).collect()
    sizes, target, taken = _check(rows, docs)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], 40)
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(M.mix(df.repartition(5), block=4, slots=64, rows_per_chunk=50).collect(), key=key)
    assert M.mix(df.limit(0)).collect() == []
    empty = M.mix(df.filter("doc_id = 1001")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)]


def test_query_reaches_its_targets(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    out = M.op8_mix_sources(spark, SF_SMALL)
    assert [c for c in ("doc_id", "size", "source_size", "target", "taken") if c not in out.columns] == []
    _, target, taken = _check(out.collect(), docs)
    assert sum(abs(taken[s] - target[s]) for s in target) / sum(target.values()) < 0.05


def test_pipeline_stages_one_by_one(spark):
    from test_simhash import plain_components, plain_print
    from test_suffix import plain as plain_cut
    from test_texts import plain_hits

    docs = P.table(spark, SF_SMALL, "documents")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    good = P.stored(P.quality(spark, docs, SF_SMALL), "t1")
    kept = {r["doc_id"] for r in good.collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert good.columns == columns and np.mean([(d in kept) == bool(labels[d]) for d in held]) > 0.85

    single = P.stored(P.near_duplicates(spark, good, SF_SMALL), "t2")
    rows = [(r["doc_id"], plain_print(r["text"])) for r in good.collect()]
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(set(plain_components(rows).values()))

    cut = P.stored(P.repeated_passages(spark, single, SF_SMALL), "t3")
    before = {r["doc_id"]: r for r in single.collect()}
    after = {r["doc_id"]: r for r in cut.collect()}
    want = plain_cut([(d, r["text"]) for d, r in before.items()])
    assert cut.columns == columns and set(after) == set(before)
    for d, r in after.items():
        n, gone, _, _ = want[d]
        assert r["lang"] == before[d]["lang"] and r["n_chars"] == len(r["text"])
        assert 0 <= n - gone - len(r["text"].encode()) <= 3 * 2 * 50 and (gone or r["text"] == before[d]["text"])

    clean = P.stored(P.decontamination(spark, cut, SF_SMALL), "t4")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {h[0]: h[5] for h in plain_hits([(d, r["text"]) for d, r in after.items()], bench)}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {d for d, h in hits.items() if not h}

    mixed = P.mixing(spark, clean, SF_SMALL).collect()
    _check(mixed, [(r["doc_id"], r["text"], r["source"]) for r in clean.collect()])
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "mixing"] and P.ORACLE_SQL is None


def test_mix_cuts_its_plan(spark, monkeypatch):
    """The running totals are written before blocks and slots meet: the last plan has none of their windows."""
    written = []
    keep = M.stored
    monkeypatch.setattr(M, "stored", lambda df, name: (written.append(name), keep(df, name))[1])
    docs = [(i, " ".join(["w"] * (i % 40)), f"s{i % 5}") for i in range(200)]
    out = M.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), block=8, slots=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert written == ["mix-sizes", "mix-placed", "mix-starts"] and "Window" not in plan
    _check(out.collect(), [(d, t, s) for d, t, s in docs])


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, clashing names: no stage crashes, columns stay."""
    rows = [(None, None, None, None, None, None), (1, "", "en", "s", 0, 1), (2, "some plain words here", None, None, 21, 2),
            (2, "some plain words here", None, None, 21, 2), (3, "x" * 30_000, "en", "s", 30_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int")
    for name, stage in P.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, SF_SMALL)
            assert out.columns == docs.columns and out.count() <= frame.count(), name
    assert len(P.mixing(spark, docs, SF_SMALL).collect()) == 5 and P.mixing(spark, docs.limit(0), SF_SMALL).collect() == []
