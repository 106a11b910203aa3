import random

import xxhash
from pyspark.sql import functions as F

from tidings.llm import simhash as S
from tidings.llm.components import components


def plain_print(text, k=3):
    if text is None:
        return 0
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint); component = least id reachable."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        r = find(f)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return {(d, f): least.get(find(f)) for d, f in rows}


TEXTS = ["", None, "a", "A b", "x y z", "Éa B\tc\n d e f", "one two three four " * 50, "q" * 5000, "　 wide"]


def test_fingerprints_match_plain_version():
    assert [int(x) for x in S.fingerprints([(t or "").encode() for t in TEXTS])] == [plain_print(t) for t in TEXTS]
    long = " ".join(f"w{i % 977}" for i in range(70_000))  # several blocks
    assert int(S.fingerprints([long.encode()], block=1000)[0]) == S.fingerprint(long.encode()) == plain_print(long)


def test_xxhash64_agrees_with_spark(spark):
    row = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert row & (2**64 - 1) == xxhash.xxh64(b"a b c", seed=42).intdigest()


def _ball(seed, centres, around):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(around):
            f = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            out.add(f)
    return sorted(out)


def _signed(f):
    return f - (1 << 64) if f >= 1 << 63 else f


def test_links_connect_what_brute_force_connects_on_both_paths(spark):
    prints = _ball(5, 6, 150) + [0, 3, (1 << 64) - 1, (1 << 64) - 2, 1 << 63]
    rows = list(enumerate(prints))
    want = plain_components(rows)
    df = spark.createDataFrame([(_signed(f),) for f in prints], "fp long")
    from tidings.llm.components import components
    for limit in (512, 2):
        roots = {r["node"]: r["root"] for r in components(S.links_within_two(df, limit)).collect()}
        groups, plain = {}, {}
        for d, f in rows:
            groups.setdefault(roots.get(_signed(f), _signed(f)), set()).add(d)
            plain.setdefault(want[(d, f)], set()).add(d)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def _docs(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    rows += [(20, base, "x"), (21, base, "x"), (22, base.replace("word30", "other"), "x"), (20, base, "x"), (None, base, "x"), (None, "lonely text here", "y"),
             (None, "lonely text here", "z"), (30, "q " * 20000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string")


def test_query_columns_edges_and_brute_force(spark):
    docs = _docs(spark)
    rows = [(r["doc_id"], plain_print(r["text"])) for r in docs.collect()]
    want = plain_components(rows)
    got = S.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=str) == sorted(((d, f, want[(d, f)]) for d, f in rows), key=str)
    assert S.near_duplicates(docs.limit(0)).collect() == []


def test_keep_one_leaves_one_row_a_component(spark):
    docs = _docs(spark)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], plain_print(r["text"])) for r in docs.collect()]
    heads = {c for c in plain_components(rows).values()}
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(c for c in heads if c is not None)
    assert [r["text"] for r in kept.filter("doc_id is null").collect()] == ["lonely text here"]


def test_keep_one_keeps_unlike_texts_of_one_id(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve thirteen"
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "x"), (2, a, "y"), (3, b, "z"), (4, "something else entirely here now", "w"),
            (5, a + " ", "k"), (6, "lone words of another row", "m"), (6, "lone words of another row", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = sorted(tuple(r) for r in S.keep_one(docs).collect())
    assert [r[:2] for r in kept] == [(1, a), (1, b), (4, rows[5][1]), (6, rows[7][1])]
    assert kept == sorted(tuple(r) for r in S.keep_one(docs.repartition(2)).collect())


def test_query_against_brute_force_on_the_small_table(spark):
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], plain_print(r["text"])) for r in docs]
    want = {(d, f"{f:016x}", c) for (d, f), c in plain_components(rows).items()}
    got = S.op1_simhash(spark, SF_SMALL)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {tuple(r) for r in got.collect()} == want


def test_components_with_hubs_against_union_find(spark):
    import random

    rng = random.Random(3)
    links = [(0, i) for i in range(1, 400)] + [(900 + i, 399) for i in range(300)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(250)]
    links += [(5000 + i, 5001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}


def test_components_stop_when_the_links_are_stars(spark, monkeypatch):
    """No round is run only to see that nothing changes: each costs the driver seven plans."""
    from tidings.llm import components as C

    written = []
    keep = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: (written.append(name), keep(df, name))[1])
    stars = [(1, 2), (1, 3), (4, 1), (10, 11)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 11: 10} and len(written) == 1 + 4
    for links in ([], [(7, 7)]):
        assert components(spark.createDataFrame(links, "a long, b long")).collect() == []
    chain = [(i, i + 1) for i in range(20)] + [(i + 1, i) for i in range(5)]
    assert {(r["node"], r["root"]) for r in components(spark.createDataFrame(chain, "a long, b long")).collect()} == {(i, 0) for i in range(1, 21)}


def test_keep_one_joins_components_once(spark, monkeypatch):
    written = []
    keep = S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: (written.append((name, df.columns)), keep(df, name))[1])
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "quite another text here"), (3, "a third one of the same id")]
    out = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 3]
    assert ("found", ["doc_id", "fp", "root"]) in written
