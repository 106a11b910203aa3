"""Tagging expressions: company, ESG keyword flag, noise flag, matched keywords.

All three tags read the lower-cased text, which callers compute once as a
column (``with_lowered``) and pass in, so a 17-way CASE does not lower-case a
long text 17 times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.config import COMPANIES, ESG_KEYWORDS, NOISE_PHRASES
from tidings.functions.text import col_, let


def with_lowered(text: Column | str, build) -> Column:
    """Evaluate ``build(lowered)`` with ``lower(text)`` computed once per row.

    The lowered text is bound as a lambda variable, so the expression stays
    one ``lower`` call even when the optimizer inlines it, e.g. when a filter
    on a tag is pushed below the projection that made it.
    """
    return let(F.lower(col_(text)), build)


def first_match(lowered: Column, names: Sequence[str], values: Sequence | None = None) -> Column:
    """Value of the first name (in list order) that occurs in ``lowered``.

    Case-insensitive raw substring test, no word boundary, so "Abigail"
    matches GAIL; list order, not text order, decides between two hits.
    Null when nothing matches.
    """
    values = list(names) if values is None else list(values)
    expr = None
    for name, value in zip(names, values):
        cond = lowered.contains(name.lower())
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr if expr is not None else F.lit(None).cast("string")


def company(lowered: Column, companies: Sequence[str] = COMPANIES) -> Column:
    return first_match(lowered, companies)


def esg_flag(text: Column | str, keywords: Sequence[str] = ESG_KEYWORDS) -> Column:
    """Keyword alternation, case-insensitive (Unicode), no word boundaries.

    "EV" therefore fires on "every" and "level". Null text gives false.
    """
    pattern = "(?iu)" + "|".join(keywords)
    return F.coalesce(col_(text).rlike(pattern), F.lit(False))


def noise_flag(lowered: Column, phrases: Sequence[str] = NOISE_PHRASES) -> Column:
    expr = F.lit(False)
    for p in phrases:
        expr = expr | lowered.contains(p.lower())
    return F.coalesce(expr, F.lit(False))


def matched_keywords(text: Column | str, keywords: Sequence[str] = ESG_KEYWORDS) -> Column:
    """The keyword alternatives that occur in the text, in keyword order.

    The four characters that case-insensitive matching equates with an ASCII
    letter without lower-casing to it are replaced first, so a keyword is
    listed exactly when it alone would raise the flag.
    """
    arr = F.array(*[F.lit(k) for k in keywords])
    plain = F.translate(col_(text), "\u017f\u212a\u0130\u0131", "skii")
    return with_lowered(plain, lambda lowered: F.filter(arr, lambda k: lowered.contains(F.lower(k))))
