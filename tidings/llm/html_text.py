"""Operator 2, HTML extraction by tag-path ratios.

Per page: the markup is cut into blocks of text, each with its root-to-leaf tag
path (inline tags fused into the block around them). Per path the text length
outside links and the punctuation are added up and divided by the path's number
of nodes. The two ratios are fused by multiplication, smoothed over neighbouring
blocks in page order, and a threshold on the smoothed value selects content
paths. The content is what lies below the parents of the selected paths, so a
short heading or a last line next to selected paragraphs is kept.

Before the ratios are taken, elements that can't be article text are left out:
scripts, styles, navigation, page headers and footers, sidebars, forms, adverts,
notices and reader comments (by element, by role and by class or id names). If
a page marks its article (``article`` or ``main``), only text in there competes,
and a class or id there is no proof by itself, as ids are made from titles
(``related-work``): headings aren't judged by it, and other elements are left out
if their text falls below the threshold, too, or if the name speaks of reader
comments and nothing else.

Pages are independent: one pass over the rows, no shuffle. A page is held whole
in one task, as its structure needs it; the tokenizer is linear in its length.

Defined results: null or empty html and pages without article text give an empty
text of length 0; unclosed and misnested elements are closed by their parents,
an open head by the first tag or text that can't stand in it;
markup cut off at the end counts as far as it goes; repeated rows and null ids
are extracted row by row; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from tidings.llm.common import small, table

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、！？]")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
                   "sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style noscript template nav footer aside form button select option textarea iframe object svg canvas audio "
                  "video dialog menu title noembed noframes".split())
UNWANTED = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
                     "breadcrumb breadcrumbs sidebar footer header masthead cookie cookies notice notices consent gdpr popup modal newsletter "
                     "subscribe signup login comment comments respond reply replies disqus share sharing social related recommended widget "
                     "toolbar pagination pager copyright complementary contentinfo search alert dialog".split())
#: Reader comments are text like the article's: only names tell them. The other words may go with those.
COMMENTS = frozenset("comment comments respond reply replies disqus".split())
BESIDE = frozenset("area block body box container content entry form item list section thread title wrapper wrap".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag that ends an open element of these names (up to the nearest container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
#: What may stand in a head; any other start tag or text ends it (its end tag is optional).
HEADED = frozenset("html head base basefont bgsound link meta noscript script style template title".split())
HOLDS = frozenset("html body article main section div ul ol dl table td th blockquote header footer nav aside form".split())


def unwanted(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element can't hold article text, and whether its name only
    makes that likely (the threshold decides)."""
    if tag in NEVER or tag == "header" and not in_article:
        return True, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    likely = False
    for kind, a, b, c in _NAMES.findall(attributes):
        for name in (a or b or c).lower().split():
            words = [w for w in re.split(r"[-_]+", name) if w]
            if not words or words[0] in ("has", "with", "no"):
                continue
            if words[0] in UNWANTED or words[-1] in UNWANTED:
                if in_article and "header" in (words[0], words[-1]):
                    continue
                if not in_article or kind.lower() == "role" or COMMENTS.intersection(words) and COMMENTS.union(BESIDE).issuperset(words):
                    return True, False
                likely = tag not in HEADINGS
    return False, likely


def blocks_of(page: str) -> tuple[list[tuple[str, str, int, bool, int]], bool]:
    """Blocks (tag path, text, characters inside links, lies in article or
    main, number of the innermost element around it whose name is unwanted, or 0), and
    whether the page marks an article at all."""
    out: list[tuple[str, str, int, bool, int]] = []
    doubted: list[tuple[int, int]] = []  # depth and number of open elements with such a name
    doubts = 0
    stack: list[tuple[str, str, bool]] = []  # tag, path step, left out
    opened: Counter = Counter()  # how often each tag is on the stack
    hidden = inside = 0
    marked = link = False
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if whole:
                out.append((">".join(step for _, step, _ in stack), whole, min(linked, len(whole)), inside > 0,
                            doubted[-1][1] if doubted else 0))
        linked = 0

    def pop() -> None:
        nonlocal hidden, inside
        tag, _, out_of = stack.pop()
        opened[tag] -= 1
        if doubted and doubted[-1][0] > len(stack):
            doubted.pop()
        hidden -= out_of
        inside -= tag in ("article", "main")

    def leave_head() -> None:
        while opened["head"]:
            pop()

    def add(piece: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and piece and not piece.isspace():
            leave_head()
        if piece and not hidden:
            text.append(piece)
            if link:
                linked += len(piece)

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "a":
                link = False
            if opened[tag]:
                flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag not in INLINE:
                flush()
            continue
        if tag not in HEADED and not (opened["noscript"] or opened["template"]) or tag in ("body", "frameset"):
            leave_head()
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag not in NEVER:
                flush()
                add(page[at : end.start() if end else size])
                flush()
            at = end.end() if end else size
            continue
        if tag in VOID:
            add(" ")
            if tag == "hr":
                flush()
            continue
        bad, likely = unwanted(tag, attributes, inside > 0)
        if tag in INLINE and not bad and not likely:
            link = link or tag == "a"
            continue
        flush()
        if tag in INLINE:
            link = link or tag == "a" and likely
        else:
            link = False
            if opened["p"]:  # a block ends an open paragraph
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in HOLDS:
                        break
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(tag, ()):
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in HOLDS and stack[k][0] not in ("td", "th"):
                    break
        if attributes.rstrip().endswith("/") and tag not in HOLDS and tag != "p":
            continue
        names = _NAMES.search(attributes) if tag == "div" else None
        stack.append((tag, tag + ("." + (names[2] or names[3] or names[4] or "").lower() if names else ""), bad))
        opened[tag] += 1
        hidden += bad
        if likely:
            doubts += 1
            doubted.append((len(stack), doubts))
        if tag in ("article", "main"):
            inside += 1
            marked = marked or not hidden
    flush()
    return out, marked


def _fused(n: float, length: float, marks: float) -> float:
    return (length / n) * (1.0 + marks / n)


def path_values(blocks: list[tuple[str, str, int, bool, int]]) -> dict[str, float]:
    """Fused and smoothed value of every tag path."""
    nodes: dict[str, list[float]] = {}
    for path, text, linked, *_ in blocks:
        sums = nodes.setdefault(path, [0.0, 0.0, 0.0])
        sums[0] += 1
        sums[1] += len(text) - linked
        sums[2] += len(_PUNCTUATION.findall(text))
    fused = {p: _fused(*sums) for p, sums in nodes.items()}
    line = [fused[b[0]] for b in blocks]
    kernel = (0.25, 0.5, 0.25)
    smooth = [sum(w * line[min(max(i + d, 0), len(line) - 1)] for d, w in zip((-1, 0, 1), kernel)) for i in range(len(line))]
    of_path: dict[str, list[float]] = {}
    for b, s in zip(blocks, smooth):
        of_path.setdefault(b[0], []).append(s)
    return {p: math.sqrt(fused[p] * (sum(v) / len(v))) for p, v in of_path.items()}


def content_blocks(blocks: list[tuple[str, str, int, bool, int]], marked: bool, share: float = 0.2) -> list[str]:
    """The texts of the content blocks, in page order."""
    if marked:
        blocks = [b for b in blocks if b[3]]
    sure = [b for b in blocks if not b[4]]
    if sure and len(sure) < len(blocks):
        limit = share * max(path_values(sure).values())
        sums: dict[int, list[float]] = {}
        for _, text, linked, _, doubt in blocks:
            of = sums.setdefault(doubt, [0.0, 0.0, 0.0])
            of[0] += 1
            of[1] += len(text) - linked
            of[2] += len(_PUNCTUATION.findall(text))
        blocks = [b for b in blocks if not b[4] or _fused(*sums[b[4]]) >= limit]
    if not blocks:
        return []
    value = path_values(blocks)
    limit = share * max(value.values())
    chosen = {p for p, v in value.items() if v >= limit}
    # Content containers: the parents of chosen paths; in a marked article, the article.
    articles = {p[: m.end()] for p in chosen if (m := re.match(r"(?:.*?>)?(?:article|main)(?=>|$)", p))}
    above = {p.rpartition(">")[0] for p in chosen} | articles
    return [b[1] for b in blocks if b[0] in chosen or any(b[0] == a or b[0].startswith(a + ">") for a in above if a)]


def main_text(page: str | None) -> str:
    return " ".join(content_blocks(*blocks_of(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row."""

    def work(batches):
        for batch in small(batches, "html"):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
