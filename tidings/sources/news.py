"""News items built from the ``documents`` table.

The raw documents never mention a tracked company or a market-noise phrase,
so on their own they leave the dictionary rules unexercised. Each news item
is therefore a lead line followed by the whole document body::

    Headline = lead(doc_id) || '\\n' || documents.text

``lead(doc_id) = companies20[doc_id % 20] || ' ' || phrases[(doc_id / 20) % 8]``
where ``companies20`` is the tracked list followed by three untracked names.
Some ids get other headlines, so that every rule meets the input it is for:
``doc_id % 97`` = 13 no headline, 14 an empty one, 15 a blank one, 16 one with
blanks of several kinds around it, 17 one that starts with a letter that only
case folding makes an ``s``, 18 the bare document text.

The body is kept whole, so every operator works over the full text and the
work grows with the table. The DuckDB oracle builds the same view
(``catalog.NEWS_SQL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.config import COMPANIES, EXTRA_COMPANIES, LEAD_PHRASES
from tidings.sources.tables import read_table

LEAD_COMPANIES = COMPANIES + EXTRA_COMPANIES


def lead_line(doc_id: F.Column) -> F.Column:
    names = F.array(*[F.lit(c) for c in LEAD_COMPANIES])
    phrases = F.array(*[F.lit(p) for p in LEAD_PHRASES])
    name = F.element_at(names, (F.pmod(doc_id, F.lit(len(LEAD_COMPANIES))) + 1).cast("int"))
    phrase = F.element_at(
        phrases,
        (F.pmod(F.floor(doc_id / F.lit(len(LEAD_COMPANIES))), F.lit(len(LEAD_PHRASES))) + 1).cast("int"),
    )
    return F.concat(name, F.lit(" "), phrase)


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, Headline, lang, source): lang and source pass through."""
    return news_from_documents(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]))


def news_from_documents(docs: DataFrame) -> DataFrame:
    """The news projection of any documents frame, batch or streaming."""
    line = F.concat(lead_line(F.col("doc_id")), F.lit("\n"), F.col("text"))
    case = F.pmod(F.col("doc_id"), F.lit(97))
    headline = (F.when(case == 13, F.lit(None).cast("string")).when(case == 14, F.lit("")).when(case == 15, F.lit(" \t\n"))
                .when(case == 16, F.concat(F.lit("\t "), line, F.lit("\u00a0\u3000")))
                .when(case == 17, F.concat(F.lit("\u017folar plant "), F.col("text"))).when(case == 18, F.col("text")).otherwise(line))
    return docs.select(
        "doc_id",
        headline.alias("Headline"),
        "lang",
        "source",
    )
