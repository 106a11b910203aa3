import html
import re

from tidings.llm import html_text as H


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><!-- ad --><div class="ad">Buy, now.</div>
    <div class="cookie-notice">We use cookies.</div><article><header><h1>Title &amp; more</h1></header><p>First  para&shy;graph,
    with <b>bold</b>&nbsp;text.<p>Second<br>line<form><input>Mail</form><aside>Side, note.</aside><table><tr><td>1<td>2</table>
    <section class="comments"><p>Great, I like it. Really.</section></article><div id="left-sidebar">More, links.</div><footer>&copy; x</footer>"""
    assert H.main_text(page) == "Title & more First para\xadgraph, with bold text. Second line 1 2"


def test_a_head_without_end_tag_ends_at_the_body():
    article = "<article><p>Some text, and more.</p></article>"
    for start in ("<html><head><title>T</title><body>", "<head><meta charset=x><title>T</title><style>p{}</style>", "<head><title>T</title>\n<div>",
                  "<html><head><noscript><img src=x></noscript></head><body>", "<head><noscript><img src=x><body>", "<head></head>"):
        assert H.main_text(start + article) == "Some text, and more.", start
    assert H.main_text("<head><title>T</title>Plain, text.") == "Plain, text."


def test_names_made_from_titles_stay_in_an_article():
    page = """<article><h1>On ads</h1><p>The first paragraph, with some text.</p><section id="related-work"><h2 id="related">Related work</h2>
    <p>Others, before us, did this.</p></section><div class="x" id="ad-hoc-networks"><p>Networks, made ad hoc, are these.</p></div>
    <h2 id="share-price">Share price</h2><p>It rose, and fell.</p><a class="share-link" href=x>Share this, and that, with all your friends, please.</a><div class="share-buttons"><a href=x>Share</a> <a href=y>Post</a></div>
    <ul class="related"><li><a href=z>Next, please</a></ul><div id="comment-list"><p>I, too, like this very much.</p></div></article>"""
    assert H.main_text(page) == ("On ads The first paragraph, with some text. Related work Others, before us, did this. Networks, made ad hoc, are these. "
                                 "Share price It rose, and fell.")


def test_unmarked_page_uses_path_ratios():
    page = ("<body><div class=top>Home</div><div class=post><h2>Head</h2><p>Some text, long enough to count. And more of it, here.</p>"
            "<p>Another paragraph, with marks; and words.</p><p>Short</p></div><div class=links><a href=x>one</a> <a href=y>two</a></div></body>")
    assert H.main_text(page) == "Head Some text, long enough to count. And more of it, here. Another paragraph, with marks; and words. Short"


def test_edges(spark):
    assert [H.main_text(p) for p in (None, "", "<article></article><p>outside", "plain, text", "<a <b \"x")] == ["", "", "", "plain, text", ""]
    assert H.main_text("<article><p>cut off &am") == "cut off &am"
    assert H.main_text("<script>" + "x" * 100) == ""
    assert len(H.main_text("<article>" + "<p>word, and word.</p>" * 20_000)) == 20_000 * 16 - 1
    rows = spark.createDataFrame([(1, None, None, "a"), (1, None, None, "a"), (None, "u", "<p>x, y</p>", "b")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in H.extract(rows).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "x, y", 4)], key=str)
    assert H.extract(rows.limit(0)).collect() == []


def test_query_against_a_plain_version(spark):
    from conftest import SF_SMALL
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}

    def plain(page):
        body = page.partition("<article>")[2].partition("</article>")[0]
        return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>|</?p>|</h1>", " ", body))).split())

    out = H.op2_html_text(spark, SF_SMALL)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert {r["page_id"]: r["text"] for r in rows} == {k: plain(v) for k, v in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_attributes_of_any_length_and_deep_nesting():
    import time

    long = "a > b " * 200_000
    for q in "\"'":
        page = f"<html><body><article><p>Before, it.</p><img alt={q}{long}{q}><p title={q}{long}{q}>After, that.</p></article></body></html>"
        assert H.main_text(page) == "Before, it. After, that."
    took = []
    for depth in (4000, 16000):
        start = time.perf_counter()
        page = "<html><body><article>" + "<div>" * depth + "<p>Deep text, here.</p>" + "</div>" * depth + "</article></body></html>"
        assert H.main_text(page) == "Deep text, here."
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 0.5
