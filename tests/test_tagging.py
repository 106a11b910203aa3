"""Row-level tagging rules: goldens, edge cases and a plain-Python restatement."""

import re

from pyspark.sql import functions as F

from tidings import config as C
from tidings.functions.text import strip
from tidings.operators.tag import (company_dimension, keyword_counts, require_headline, tag, ranked_names, tag_by_join, tag_from_table,
                                   with_matched_keywords)
from tidings.sources.news import news_items

GOLDENS = [
    (1, "Tata Power commissions 500MW solar plant", "Tata Power", True, False),
    (2, "ONGC reports record quarterly profit", "ONGC", False, False),
    (3, "Tata Power commissions 500MW solar plant, targets net zero by 2045", "Tata Power", True, False),
    (4, "ONGC reports record profits from fossil fuel expansion", "ONGC", False, False),
    (5, "every level", None, True, False),
    (6, "JSW Energy beats Tata Power", "Tata Power", False, False),
    (7, "Abigail speaks", "GAIL", False, False),
    (8, "Stocks in News: Sensex ends flat", None, False, True),
    (9, "ſolar plant opens", None, True, False),
    (10, "", None, False, False),
]


def test_goldens(spark, headlines):
    df = headlines([(i, h) for i, h, *_ in GOLDENS])
    got = {r.doc_id: (r.company, r.esg_flag, r.noise_flag) for r in tag(df).collect()}
    for i, _, company, esg, noise in GOLDENS:
        assert got[i] == (company, esg, noise), i


def test_null_headline_never_drops(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, Headline string")
    rows = {r.doc_id: r for r in tag(df).collect()}
    assert len(rows) == 2
    assert rows[1].company is None and rows[1].esg_flag is False and rows[1].noise_flag is False


def test_required_column_is_case_exact(spark):
    df = spark.createDataFrame([("a",)], ["headline"])
    try:
        require_headline(df)
    except ValueError:
        pass
    else:
        raise AssertionError("lower-case 'headline' must be rejected")


def test_strip_matches_python(spark, headlines):
    values = ["\t text  ", "　x　", "  ", "a b"]
    df = headlines(list(enumerate(values)))
    got = {r.doc_id: r.s for r in df.select("doc_id", strip("Headline").alias("s")).collect()}
    assert got == {i: v.strip() for i, v in enumerate(values)}


def _python_tags(h):
    """Independent plain-Python statement of the tagging rules."""
    if h is None:
        return None, False, False
    low = h.lower()
    company = next((c for c in C.COMPANIES if c.lower() in low), None)
    esg = re.search("|".join(C.ESG_KEYWORDS), h, re.IGNORECASE) is not None
    noise = any(p in low for p in C.NOISE_PHRASES)
    return company, esg, noise


def test_reference_semantics_on_news(spark):
    news = news_items(spark, "/root/testdata/sf0.001")
    rows = tag(news).select("Headline", "company", "esg_flag", "noise_flag").collect()
    assert len(rows) == 200
    for r in rows:
        assert (r.company, r.esg_flag, r.noise_flag) == _python_tags(r.Headline)


def test_matched_keywords_agree_with_flag(spark):
    news = news_items(spark, "/root/testdata/sf0.001")
    df = with_matched_keywords(tag(news))
    bad = df.filter((F.size("matched_keywords") > 0) != F.col("esg_flag")).count()
    assert bad == 0
    counts = {r.keyword: r.n_docs for r in keyword_counts(news).collect()}
    assert counts["EV"] > 0


def test_dictionary_table_equals_the_fixed_list(spark):
    news = news_items(spark, "/root/testdata/sf0.001")
    dim = company_dimension(spark)
    joined = sorted(tag_from_table(news, dim).select("doc_id", "company", "category").collect())
    plain = tag(news).select("doc_id", "company")
    assert sorted((r.doc_id, r.company) for r in joined) == sorted((r.doc_id, r.company) for r in plain.collect())
    for gram in (1, 4, 9):
        assert sorted(tag_by_join(news, ranked_names(dim), gram=gram).select("doc_id", "company", "category").collect()) == joined


def test_dictionaries_of_any_size_equal_a_plain_scan(spark, headlines):
    """17, 600 and 5,000 names, with empty and null ones, short ones, repeats,
    overlaps and an integer carry column, by the automaton and by the join."""
    from tidings.config import COMPANIES

    texts = ["Tata Power and NTPC", "", None, "abigail x", "tataTata power energy", "no hit (here)", "zz filler 17 zz filler 4999", "İstanbul ENERGY", "a"]
    df = headlines(list(enumerate(texts)))
    for size, extra in ((17, []), (600, [(None, 5)]), (5000, [("", 9)])):
        names = (list(COMPANIES) + ["Tata", "Energy", "gy", "POWER", "Tata"] + [f"zz filler {i}" for i in range(size)])[:max(size, 17)]
        rows = [(i, n, i * 7) for i, n in enumerate(names)] + [(size + 10, n, k) for n, k in extra]
        dim = spark.createDataFrame(rows, "priority int, company string, number int")
        for limit in (None, 1):  # the automaton, and the join where it is too large
            got = {r.doc_id: (r.company, r.number) for r in tag_from_table(df, dim, carry=("number",), max_bytes=limit).collect()}
            for i, t in enumerate(texts):
                hit = next(((n, k) for _, n, k in rows if n is not None and t is not None and n.lower() in t.lower()), (None, None))
                assert got[i] == hit, (size, limit, t, got[i], hit)
    assert [c for c in tag_from_table(df, dim, carry=("number",)).columns] == ["doc_id", "Headline", "company", "number"]


def test_fifty_thousand_names_equal_a_plain_scan(spark, headlines):
    import random

    from tidings.operators.automaton import tag_by_automaton

    rng = random.Random(4)
    names = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 9))) for _ in range(50_000)]
    texts = ["".join(rng.choice("abcdeé  ") for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None]
    dim = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "priority int, company string, category string")
    df = headlines(list(enumerate(texts))).repartition(3)
    out = tag_by_automaton(df, ranked_names(dim))
    got = {r.doc_id: r.company for r in out.collect()}
    assert got == {i: next((n for n in names if t is not None and n in t), None) for i, t in enumerate(texts)}
    assert tag_by_automaton(df, ranked_names(dim), max_bytes=1000) is None and tag_by_automaton(df, ranked_names(dim), max_names=1000) is None


def test_matched_keywords_follow_the_flag_on_unicode_letters(spark, headlines):
    df = headlines([(1, "ſolar plant"), (2, "bİofuel clımate"), (3, "hYDRO wınd"), (4, "none")])
    rows = {r.doc_id: r for r in with_matched_keywords(tag(df)).collect()}
    for r in rows.values():
        assert r.esg_flag == (len(r.matched_keywords) > 0), r
    assert rows[1].matched_keywords == ["SOLAR"] and rows[2].matched_keywords == ["BIOFUEL", "CLIMATE"]


def test_configured_noise_phrases_may_have_capitals(spark, headlines):
    import dataclasses

    from tidings.config import DEFAULT

    mine = dataclasses.replace(DEFAULT, noise_phrases=("Market Wrap",))
    assert tag(headlines([(1, "the market wrap today")]), settings=mine).first().noise_flag
