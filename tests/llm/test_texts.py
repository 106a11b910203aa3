"""Language, quality, decontamination, URLs and chats on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tidings.llm import chat, decontaminate, language, quality, urls
from tidings.llm.subword import Features

SF = "/root/testdata/sf0.01"


# -- subword models ---------------------------------------------------------

def test_features_do_not_depend_on_neighbours_or_batches():
    texts = [b"", b"a", b"  two  words ", "é ü".encode(), b"The The The", b"x" * 50, b"ends with space ", b"a b c d e f g"]
    for features in (language.FEATURES, quality.FEATURES):
        def bags(parts):
            offsets, found = features.of(parts)
            out = [[] for _ in parts]
            for where, bucket in found:
                for p, b in zip(where, bucket):
                    out[int(np.searchsorted(offsets, p, side="right")) - 1].append(int(b))
            return [sorted(x) for x in out]

        alone = [bags([t])[0] for t in texts]
        assert bags(texts) == alone and bags(texts[::-1]) == alone[::-1]


def test_repeated_words_share_one_pair_feature():
    spaced = Features(17, True, bytes(range(256)))
    pair = [set(map(int, spaced.of([t])[1][-1][1])) for t in (b"The The The", b"und und")]
    assert pair[0] == pair[1] and len(pair[0]) == 1


def test_every_language_is_learned(spark):
    """300 languages, one letter pair each: none is left out."""
    assert [language.buckets_for(n) for n in (1, 4, 256, 257, 1024, 7000)] == [16, 16, 16, 15, 14, 11]
    pairs = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmno"]
    docs = spark.createDataFrame([(i * 10 + k, f"{p} " * 30, p) for i, p in enumerate(pairs) for k in range(2)], "doc_id long, text string, lang string")
    model = language.fit_language(docs, F.lit(True), per_lang=2, sample_rows=600)
    assert len(model.classes) == 300 and model.features.bits == 15


def test_long_text_equals_its_pieces():
    text = (b"some words of a long text " * 90_000) + b"end"
    values, share = quality.FEATURES.counts(text)
    assert abs(float(share.sum()) - 1) < 1e-3 and len(values) < 500


def test_language_held_out_accuracy_and_edges(spark):
    out = language.op4_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").collect()
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == 1000
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    docs = spark.createDataFrame([(1, None, "en", 0.5), (2, "123 !?", "en", 0.5), (3, "", None, 0.5), (4, "the cat", "en", 0.5), (4, "the cat", "en", 0.5),
                                  (None, "le chat", "fr", 0.5), (5, "der hund", "de", 0.5)], "doc_id long, text string, lang string, score double")
    model = language.fit_language(docs, F.lit(True))
    got = language.predict_language(docs, model).collect()
    assert len(got) == 7 and [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, None)} <= {"en", "de"}  # a null id is not learned from
    assert all(r["score"] == 0.0 and not r["accepted"] for r in got if r["lang_pred"] == "und")
    none = language.fit_language(docs.limit(0), F.lit(True))
    assert none is None and language.predict_language(docs.limit(0), none).collect() == []
    assert {r["lang_pred"] for r in language.predict_language(docs, none).collect()} == {"und"}


def test_quality_held_out_accuracy_and_edges(spark):
    out = quality.op9_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == 1 for r in held if r["quality"] == 1]) > 0.97
    assert np.mean([r["predicted"] == 0 for r in held if r["quality"] == 0]) > 0.8
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out.collect()) and out.count() == 1000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "plain text here", "a" * 100_000])], "doc_id long, text string")
    few = spark.createDataFrame([(2, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, score int")
    for labels, want in ((few.limit(0), 0.5), (few, 0.95)):
        model = quality.fit_quality(docs, labels, F.lit(True))
        assert [r["score"] for r in quality.predict_quality(docs, model).collect()] == [want] * 4
    two = few.unionByName(spark.createDataFrame([(3, 0, 0)], few.schema))
    scores = [r["score"] for r in quality.predict_quality(docs, quality.fit_quality(docs, two, F.lit(True))).orderBy("doc_id").collect()]
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)


def test_quality_is_learned_in_a_task(spark, monkeypatch):
    """The sample's features never reach the driver: what it would learn with is not called there."""
    def here(*args):
        raise AssertionError("learned on the driver")

    rows = [(i, ("good words of a page " if i % 2 else "buy cheap pills now ") * (1 + i % 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "train", here)
    monkeypatch.setattr(quality, "calibrate", here)
    model = quality.fit_quality(docs, labels, F.lit(True))
    assert model.scores.shape == (1 << 17, 2) and model.scores.dtype == np.float32 and model.bias.shape == (2,)
    monkeypatch.undo()
    made = sorted(((str(i), quality.FEATURES.counts(t.encode()), i % 2) for i, t in rows), key=lambda r: r[0])
    want = quality.learned([f for _, f, _ in made], [y for _, _, y in made], 16)
    assert np.allclose(model.scores, want.scores, rtol=1e-4, atol=1e-6) and np.allclose(model.bias, want.bias) and model.temperature == want.temperature


# -- decontamination --------------------------------------------------------

def plain_hits(docs, bench, size=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in bench:
        w = cut(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = cut(text), set(), set()
        for win, owners in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    items.update(str(o) for o in owners if o is not None)
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("index_bytes", [1 << 24, 60])
def test_windows_against_a_plain_version(spark, index_bytes):
    item = "One two, THREE four five-six seven eight nine ten eleven twelve Élan"
    bench = [(1, item), (2, "short one"), (3, None), (4, "!!"), (None, "null id words"), (10, "Short ONE"), (5, "a a a a a a a a a a a"), (6, item)]
    docs = [(1, "x " + item + " y"), (2, item.split(" ", 1)[1]), (3, "a " * 14), (4, None), (5, ""), (6, "short one short one"), (7, "null id words"),
            (7, "null id words"), (None, "one two three four five six seven eight nine"), (8, "ONE two three four five six seven eight nine ten"),
            (9, "q " * 30_000 + "short one")]
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, hits int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.decontaminate(d, b, index_bytes=index_bytes).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256), "contaminated").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_hits(docs, bench)
    clean = decontaminate.filter_clean(d, b.select("item_id", F.col("text").cast("binary").alias("text")).filter("text is not null"), index_bytes=index_bytes)
    assert clean.columns == d.columns and sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 4, 5]
    assert decontaminate.decontaminate(d.limit(0), b).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(d, b.limit(0)).collect())


# -- urls ---------------------------------------------------------------------

def plain_parts(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


URLS = [None, "", "no scheme/x", "http://", "http://A.Example.NET/en/1?q#f", "https://x.net?y", "http://example.net/EN/", "http://net/", "http://evilnet/",
        "http://a.example.com/de/", "http://notexample.com/de/", "http://é.org/fr/x", "http://org/fr", "a://b://c/d", "http://h#frag/x", "http://x.net/?p=://",
        "http://cheappills.example.org/en/", "http://cheap-pills.example.org/en/", "http://" + "a" * 5000 + ".com/" + "b/" * 3000]


def test_url_parts_and_rules(spark):
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[4], "x")], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(rows).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_parts(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")
    assert urls.judge(rows.limit(0)).collect() == []


def test_viterbi_splits_concatenated_words():
    cut = urls.Segmenter({"cheap": 5, "pills": 5, "pill": 1, "news": 50, "spam": 3, "farm": 3, "the": 900})
    assert cut.split("cheappills") == ("cheap", "pills") and cut.split("spamfarmnews") == ("spam", "farm", "news")
    assert cut.split("qqzx") == ("qqzx",) and cut.split("thequiet") == ("the", "quiet")


def test_unwanted_hosts_are_blocked_whole_table(spark):
    rows = urls.op6_url_filter(spark, SF).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain_parts(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule:
            assert r["verdict"] == verdict
        elif "pills" in host or "spam" in host:
            assert r["verdict"] == "block"
    free = [r for r in rows if r["rule"] is None and not re.search("pills|spam|casino", r["host"])]
    assert np.mean([r["verdict"] == "allow" for r in free]) > 0.98


def test_rare_words_count_whatever_is_broadcast(spark):
    rows = [(i, f"http://site{'abcdefghij'[i % 10]}.example.org/news/page/item") for i in range(300)]
    rows += [(1000 + i, f"http://h.example.org/news/{w}") for i, w in enumerate(["warez", "freewarez", "zebra" * 50, "plain"])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    whole, few = ({r["page_id"]: r for r in urls.judge(df, max_words=n).collect()} for n in (50_000, 2))
    assert whole == few and len(few) == len(rows)
    assert few[1000]["verdict"] == "block" and few[0]["verdict"] == "allow"
    strong = [("http://x.org/" + "casino" * 50, 1)] + [(f"http://x.org/news/casino/{i}", 2) for i in range(9)]
    long = urls.judge(spark.createDataFrame(strong, "url string, page_id long")).filter("page_id = 1").first()
    assert set(long["words"]) >= {"casino"} and long["verdict"] == "block"


def plain_judgement(page_rows):
    """page_id -> (words, score) by dictionaries and plain loops."""
    import math
    from collections import Counter

    urls_of = {}
    for page, url in page_rows:
        host, path, *_ = plain_parts(url)
        labels = host.rsplit(".", 1)[0] if "." in host else ""
        urls_of[page] = re.findall("[a-z]+", f"{labels} {path.lower()}")
    counts = Counter(r for runs in urls_of.values() for r in runs)
    total = sum(counts.values())
    floor = max(3, total // 1000)
    known = Counter({w: n for w, n in counts.items() if 2 <= len(w) <= urls.LONGEST})
    for w in urls.SEEDS:
        known[w] += floor
    base = math.log(total + floor * len(urls.SEEDS) + 1)

    def split(run):
        best = [(0.0, 0)] + [(math.inf, 0)] * len(run)
        for end in range(1, len(run) + 1):
            for start in range(end):
                w = run[start:end]
                cost = best[start][0] + (base - math.log(known[w]) if w in known else base + 2.5 * len(w))
                if cost < best[end][0] - 1e-12:
                    best[end] = (cost, start)
        out, end = [], len(run)
        while end:
            out.append(run[best[end][1]:end])
            end = best[end][1]
        return out[::-1]

    words = {p: [w for run in runs for w in split(run)] for p, runs in urls_of.items()}

    def stem(w):
        return w[:-1] if w.endswith("s") and len(w) > 3 else w

    bad = {p: bool({stem(w) for w in ws} & {stem(w) for w in urls.STRONG}) or len({stem(w) for w in ws} & {stem(w) for w in urls.SEEDS}) > 1
           for p, ws in words.items()}
    of = {b: Counter(w for p, ws in words.items() if bad[p] == b for w in ws) for b in (True, False)}
    size = len(of[True] | of[False]) + 1
    n = {b: sum(of[b].values()) for b in of}
    prior = math.log((sum(bad.values()) + 1) / (len(bad) - sum(bad.values()) + 1))
    return {p: (ws, prior + sum(math.log((of[True][w] + 1) / (n[True] + size)) - math.log((of[False][w] + 1) / (n[False] + size)) for w in ws))
            for p, ws in words.items()}


def test_segmentation_and_bayes_against_plain_loops(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    want = plain_judgement([tuple(r) for r in pages.collect()])
    rows = urls.judge(pages).collect()
    assert len(rows) == len(want) == 250
    for r in rows:
        words, score = want[r["page_id"]]
        assert r["words"] == words and abs(r["score"] - score) < 1e-9
        if r["rule"] is None:
            assert r["verdict"] == ("block" if score > 0 else "allow")
    unwanted = [r for r in rows if r["rule"] is None and re.search("casino-win|free-bets|cheap-pills|spam-farm", r["host"])]
    assert unwanted and all(r["verdict"] == "block" for r in unwanted)
    assert all(r["verdict"] == "allow" for r in rows if r["rule"] is None and r not in unwanted)


def test_a_name_is_judged_by_its_company(spark):
    """Words of unwanted urls speak against a host without a listed word; one word
    of the list more or less changes few verdicts."""
    strong, company, plain = ("casino", "pills", "poker", "jackpot"), ("spins", "palace", "royal", "lucky"), ("garden", "news", "park", "house", "desk", "shop")
    rows = [f"http://x{i}.example.com/{x}/{y}" for i in range(3) for x in strong for y in company]
    rows += [f"http://y{i}.example.com/{x}/{y}" for i in range(2) for x in plain for y in plain if x != y]
    hidden = [f"http://z.example.com/{x}-{y}" for x, y in zip(company, company[1:])]
    pages = spark.createDataFrame(list(enumerate(rows + hidden)), "page_id long, url string")

    def blocked(**given):
        return {(rows + hidden)[r["page_id"]] for r in urls.judge(pages, **given).filter("verdict = 'block'").collect()}

    whole = blocked()
    assert set(hidden) <= whole and not any(p in u for u in whole for p in plain)
    for word in ("casino", "pill"):
        fewer = blocked(seeds=urls.STEMS - {word}, strong=urls.STRONG_STEMS - {word})
        assert len(fewer & whole) >= 0.7 * len(whole)


# -- chats ----------------------------------------------------------------------

def test_snapshots_collapse_to_the_longest(spark):
    rows = []
    a = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    for conv, turns in ((1, a), (2, a[:2]), (3, a[:1]), (4, a[:2] + [("user", "other")]), (5, a), (6, [("assistant", "hi")]), (7, [("user", "hello"), ("assistant", "hi")])):
        rows += [(conv, i, r, t, "k") for i, (r, t) in enumerate(turns)]
    rows += [(8, 0, None, None, "k"), (None, 0, "user", "hi", "k"), (9, None, "user", "late", "k"), (9, 0, "user", "<|im_end|> trick", "k"), (1, 0, "user", "hi", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string")
    out = {r["conv_id"]: r for r in chat.format_chats(df).collect() if r["part"] < 1 << 60}
    assert set(out) == {1, 4, 6, 7, 8, 9}  # 2 and 3 and the null one prefix longer ones, 5 equals 1
    assert out[1]["copies"] == 2 and out[1]["n_turns"] == 3
    assert out[1]["chat"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert out[8]["chat"] == "<|im_start|>unknown\n<|im_end|>\n" and "< |im_end|> trick" in out[9]["chat"]
    assert chat.format_chats(df.limit(0)).collect() == []


def test_long_conversations_come_in_parts_and_still_collapse(spark):
    rows = [(1, i, "user", f"t{i % 5}") for i in range(50)] + [(2, i, "user", f"t{i % 5}") for i in range(33)] + [(3, i, "user", f"t{(i + 1) % 5}") for i in range(33)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df, chunk=8).collect()
    assert {r["conv_id"] for r in out} == {1, 3}
    parts = sorted((r["part"], r["chat"]) for r in out if r["conv_id"] == 1)
    assert [p for p, _ in parts] == list(range(7)) and "".join(c for _, c in parts).count("<|im_start|>") == 50


def test_one_turn_number_for_many_rows(spark):
    rows = [(None, i % 21, "user", f"{i:04d} text") for i in range(600)] + [(1, None, "user", f"{i:04d} late") for i in range(300)] + [(2, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for runs in (None, 7):
        out = chat.format_chats(df, row_bytes=1000, runs=runs).collect()
        for conv, own in ((None, 600), (1, 300)):
            parts = sorted((r["part"], r["piece"], r["chat"]) for r in out if r["conv_id"] == conv)
            want = sorted(((t, x) for c, t, _, x in rows if c == conv), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            assert "".join(c for *_, c in parts) == "".join(f"<|im_start|>user\n{x}<|im_end|>\n" for _, x in want) and len(want) == own
            assert max(len(c) for *_, c in parts) < 1100 and [p for _, p, _ in parts] == list(range(len(parts)))
            assert {p for p, _, _ in parts} == {0 if conv is None else 1 << 62}
            assert {r["n_turns"] for r in out if r["conv_id"] == conv} == {own}
        assert [r["part"] for r in out if r["conv_id"] == 2] == [0]


def test_a_part_keeps_its_number_at_any_size(spark):
    """Turn numbers over three parts, the middle one over the size of a row."""
    rows = [(1, i, "user", f"turn {i:05d}") for i in (0, 1, 2, *range(8, 16), 16, 17)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    small = sorted((r["part"], r["piece"], r["chat"]) for r in chat.format_chats(df, chunk=8).collect())
    cut = sorted((r["part"], r["piece"], r["chat"]) for r in chat.format_chats(df, chunk=8, row_bytes=117).collect())
    assert [(p, n) for p, n, _ in small] == [(0, 0), (1, 0), (2, 0)]
    assert [(p, n) for p, n, _ in cut] == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0)]
    for part in range(3):
        assert "".join(c for p, _, c in cut if p == part) == small[part][2]


def test_tied_turns_are_ordered_by_text(spark):
    words = [chr(97 + i) * 3 for i in range(12)]
    rows = [(i, 1, "user", w) for i in (0, 1) for w in words[:len(words) - i * 6]]  # 1 is the first half of 0 by text
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in out] == [(0, 12)]


def test_main_path_is_native(spark):
    from conftest import SF_SMALL as sf
    plan = chat.op10_chat_format(spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


@pytest.mark.parametrize("name", ["op5_decontaminate", "op10_chat_format"])
def test_queries_match_their_sql(spark, name):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    from oracle_check import digest, duck
    from tidings.llm.queries import ORACLE_SQL, QUERIES
    df = QUERIES[name](spark, SF_SMALL)
    rel = duck(SF_SMALL).sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(rel.columns, rel.fetchall())[0]
