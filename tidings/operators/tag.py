"""Tagging operators: company / ESG / noise flags, dictionary tables, funnel.

All tags are Column expressions in one projection: no UDF, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.config import DEFAULT, Settings, company_category_rows
from tidings.functions import tagging


def require_headline(df: DataFrame, text_col: str = "Headline", compat_nan: bool = False) -> DataFrame:
    """Fail before any job when the exact column name is missing; cast to string.

    Spark resolves names case-insensitively by default, so the check is made
    on the exact spelling in ``df.columns``. By default a missing headline
    stays null (flags false, neutral fallback). ``compat_nan=True`` turns it
    into the text ``'nan'``, as a pandas ``astype(str)`` of a missing cell
    does.
    """
    if text_col not in df.columns:
        raise ValueError(f"input must have a column named {text_col!r}; found {df.columns}")
    text = F.col(text_col).cast("string")
    if compat_nan:
        text = F.coalesce(text, F.lit("nan"))
    return df.withColumn(text_col, text)


def tag(df: DataFrame, text_col: str = "Headline", settings: Settings = DEFAULT) -> DataFrame:
    """Add ``company``, ``esg_flag`` and ``noise_flag``. Rows are never dropped.

    Company and noise read the lower-cased text, computed once per row and
    shared; the keyword flag is a case-insensitive regex on the text itself.
    """
    tags = "__tags"
    both = tagging.with_lowered(text_col, lambda lowered: F.struct(
        tagging.company(lowered, settings.companies).alias("company"),
        tagging.noise_flag(lowered, settings.noise_phrases).alias("noise_flag")))
    return (
        df.withColumn(tags, both)
        .withColumn("company", F.col(f"{tags}.company"))
        .withColumn("esg_flag", tagging.esg_flag(text_col, settings.esg_keywords))
        .withColumn("noise_flag", F.col(f"{tags}.noise_flag"))
        .drop(tags)
    )


def with_matched_keywords(df: DataFrame, text_col: str = "Headline", settings: Settings = DEFAULT) -> DataFrame:
    """Add ``matched_keywords``: which alternatives of the ESG pattern fired."""
    return df.withColumn("matched_keywords", tagging.matched_keywords(text_col, settings.esg_keywords))


def keyword_counts(df: DataFrame, text_col: str = "Headline", settings: Settings = DEFAULT) -> DataFrame:
    """(keyword, n_docs): rows in which each keyword occurs. Partial aggregation
    map-side, so a hot keyword costs one row per task in the shuffle."""
    hits = with_matched_keywords(df.select(text_col), text_col, settings)
    return (hits.select(F.explode("matched_keywords").alias("keyword"))
            .groupBy("keyword").agg(F.count(F.lit(1)).alias("n_docs")))


def filter_funnel(tagged: DataFrame) -> DataFrame:
    """Counts through the documented funnel: noise -> company -> keyword.

    One pass; the row-level filters are in ``funnel_rows``.
    """
    clean = ~F.col("noise_flag")
    named = clean & F.col("company").isNotNull()
    esg = named & F.col("esg_flag")
    return tagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(clean).alias("after_noise"),
        F.count_if(named).alias("after_company"),
        F.count_if(esg).alias("after_keyword"),
    )


def funnel_rows(tagged: DataFrame) -> DataFrame:
    return tagged.filter(~F.col("noise_flag") & F.col("company").isNotNull() & F.col("esg_flag"))


# ---------------------------------------------------------------------------
# Dictionary tables (large-dictionary path of the company tag, categories)
# ---------------------------------------------------------------------------

DIMENSION_SCHEMA = T.StructType([
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("company", T.StringType(), False),
    T.StructField("category", T.StringType(), True),
])


def company_dimension(spark: SparkSession) -> DataFrame:
    """(priority, company, category) from the fixed company list."""
    return spark.createDataFrame(company_category_rows(), DIMENSION_SCHEMA)


def _grams(text: Column, places: list[str]) -> Column:
    """Every run of ``len(places)`` characters of ``text`` that match the
    patterns of their places (a zero-width match at each position, so one
    linear scan)."""
    if not places:
        return F.array(F.lit(""))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({''.join(places)}))"), 1)


def _key_places(keyed: DataFrame, gram: int) -> list[list[str]]:
    """Per key length, a character class for each place: the characters that
    the keys have there. Collects at most gram + 1 rows of distinct characters."""
    sets = [F.array_sort(F.collect_set(F.substring("key", i, 1))).alias(f"p{i}") for i in range(1, gram + 1)]
    rows = keyed.groupBy(F.length("key").alias("n")).agg(*sets).orderBy("n").collect()
    return [["[" + "".join(f"\\x{{{ord(c):x}}}" for c in r[f"p{i}"]) + "]" for i in range(1, r["n"] + 1)] for r in rows]


def ranked_names(dim: DataFrame, name_col: str = "company", order_col: str = "priority", carry: tuple[str, ...] = ("category",)) -> DataFrame:
    """low, rank, hit: one row per lower-cased name, its first entry in dictionary order."""
    hit = F.struct(F.col(name_col).alias(name_col), *[F.col(c).alias(c) for c in carry])
    rank = F.struct(F.col(order_col).isNull().alias("none"), F.col(order_col).alias("order"), F.col(name_col).alias("name"))
    return (dim.filter(F.col(name_col).isNotNull()).select(F.lower(F.col(name_col)).alias("low"), rank.alias("rank"), hit.alias("hit"))
            .groupBy("low").agg(F.min("rank").alias("rank"), F.min_by("hit", "rank").alias("hit")))


def _keyed(names: DataFrame, gram: int) -> DataFrame:
    """``names`` with the name's rarest gram in the dictionary as its key (a name
    shorter than ``gram`` is its own key)."""
    pieces = names.select("low", F.explode(F.when(F.length("low") < gram, F.array("low")).otherwise(
        F.array_distinct(_grams(F.col("low"), ["."] * gram)))).alias("key"))
    rarity = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = (pieces.join(rarity, "key").groupBy(F.col("low").alias("low_"))
            .agg(F.min(F.struct("n", "key")).alias("best")).select("low_", F.col("best.key").alias("key")))
    return names.join(keys, F.col("low") == F.col("low_")).select("key", "low", "rank", "hit")


def tag_from_table(df: DataFrame, dim: DataFrame, text_col: str = "Headline",
                   name_col: str = "company", order_col: str = "priority",
                   carry: tuple[str, ...] = ("category",), max_bytes: int | None = None) -> DataFrame:
    """First dictionary hit (lowest ``order_col``) for each row, plus the
    ``carry`` columns of the matching dictionary row.

    Same definition as ``tag``: raw substring, lower-cased on both sides, dictionary
    order decides. An empty name occurs in every text; a null name in none. The
    texts are scanned once by a broadcast automaton of the names (``automaton``); a
    dictionary too large to broadcast, by its measured size, is joined (``tag_by_join``).
    """
    from tidings.operators import automaton

    names = ranked_names(dim, name_col, order_col, carry)
    tagged = automaton.tag_by_automaton(df, names, text_col, automaton.MAX_AUTOMATON if max_bytes is None else max_bytes)
    return tagged if tagged is not None else tag_by_join(df, names, text_col)


def tag_by_join(df: DataFrame, names: DataFrame, text_col: str = "Headline", gram: int = 4) -> DataFrame:
    """``tag_from_table`` for a dictionary of any size, ``names`` of ``ranked_names``; of it
    only the sets of characters in its keys' places reach the driver. Each
    name is keyed by its rarest ``gram`` characters, the keys are equi-joined
    with the distinct grams of the distinct texts that have a key's characters in its
    places (the planner broadcasts the keys only if their size allows), and the few candidates of a text are joined back by
    the text's hash and verified with ``contains``. Copies of a text share a key; the
    adaptive planner splits their side of the join.
    """
    own, columns = df.columns, names.schema["hit"].dataType.names
    keyed = _keyed(names, gram)
    low = F.lower(F.col(text_col))
    text = df.select(F.xxhash64(low).alias("th"), low.alias("low_text")).filter(F.col("low_text").isNotNull())
    parts = [_grams(F.col("low_text"), places) for places in _key_places(keyed, gram)] or [F.array().cast("array<string>")]
    grams = text.select("th", F.explode(F.array_distinct(F.concat(*parts))).alias("key"))
    near = (grams.join(keyed, "key").dropDuplicates(["th", "low"])
            .groupBy(F.col("th").alias("__th")).agg(F.collect_list(F.struct("rank", "low", "hit")).alias("__near")))

    def first(lowered: Column) -> Column:
        found = F.filter("__near", lambda c: lowered.contains(c["low"]))
        ranked = F.array_sort(found, lambda a, b: F.when(a["rank"] < b["rank"], F.lit(-1)).when(a["rank"] > b["rank"], F.lit(1)).otherwise(F.lit(0)))
        return F.try_element_at(ranked, F.lit(1))["hit"]

    # A row without a text has no candidates: any number is its key, so such rows share no task.
    key = F.when(low.isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(low))
    joined = df.withColumn("__key", key).join(near, F.col("__key") == F.col("__th"), "left")
    hit = joined.withColumn("__hit", tagging.with_lowered(text_col, first))
    return hit.select(*own, *[F.col("__hit")[c].alias(c) for c in columns])


def with_category(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Left-join the category by company name. The planner broadcasts the
    dimension if its measured size allows, so the large side isn't shuffled by
    company (a hot key); otherwise AQE splits skewed partitions."""
    return df.join(dim.select("company", "category"), on="company", how="left")
