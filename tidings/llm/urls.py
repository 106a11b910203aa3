"""Operator 6, URL filters.

Rules first: a rule ``host/path`` fits its host and every subdomain when the
url's path starts with the rule's path; the longest fitting rule wins. Where no
rule fits, the method decides: host labels and path tokens are split into words
by a unigram Viterbi pass (``cheappills`` -> ``cheap pills``), and multinomial
naive Bayes scores the words.

Both models are counted over all rows by partial aggregates and stay whole, as
tables: the unigrams are the delimiter-separated tokens of every url plus the
seed words; the classes of naive Bayes are weak labels, a url being of the
unwanted class when one of its words is a strong seed word, or two are seed words
(in either number). The verdict is the model's: other words of unwanted urls speak
against a url as well, and a seed word alone need not. Every distinct run of
letters is split once: its substrings of up to ``LONGEST`` letters (a longer
word counts as an unknown piece in a split) are joined by equality to the counts;
each url's runs are joined to their splits, and its words to their log odds.
The ``max_words`` most frequent keys of a table, and all words of up to three
letters, are broadcast: a common key's rows then stay where they are. How many
are broadcast changes no result.

Defined results: null url or one without ``://`` has empty host and path, no
rule, and the method's verdict on no words (the prior: allow unless most urls
are unwanted); repeated rows and null ids are judged row by row; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import stored, table

#: (verdict, rule), fixed by the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words that make a url an example of the unwanted class.
SEEDS = ("adult bet betting bonus casino cheap click crypto dating debt drugs escort farm free gambling jackpot loan loans "
         "lottery malware mortgage payday pharma pharmacy phishing pills poker porn replica sex slots spam viagra warez "
         "win winner xxx").split()
#: Seed words that say enough by themselves.
STRONG = frozenset("casino escort gambling jackpot malware payday phishing pills poker porn spam viagra warez xxx".split())

#: The same without the plural ending, which words are compared without.
STEMS = frozenset(w[:-1] if w.endswith("s") and len(w) > 3 else w for w in SEEDS)
STRONG_STEMS = frozenset(w[:-1] if w.endswith("s") and len(w) > 3 else w for w in STRONG)

_TOKEN = "[a-z]+"
#: Letters of the longest word that a split looks for.
LONGEST = 24
#: Keys longer than this are not broadcast.
_HEAD_LETTERS = 256


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict."""
    found = verdict = F.lit(None).cast("string")
    for word, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return found, verdict


class Segmenter:
    """Unigram Viterbi: the split of a lower-case run with the least cost.

    A word costs ``-log(count / total)``. An unknown piece of length k costs
    ``log(total) + 2.5 k``: cheaper as one piece than letter by letter, dearer
    than a split into known words of three letters or more.
    """

    def __init__(self, counts: dict[str, int], longest: int = LONGEST, total: int | None = None):
        self.base = math.log((sum(counts.values()) if total is None else total) + 1)
        self.cost = self.costs(counts)
        self.longest = longest
        self.split = lru_cache(maxsize=1 << 14)(self._split)

    def costs(self, counts: dict[str, int]) -> dict[str, float]:
        return {w: self.base - math.log(n) for w, n in counts.items() if len(w) > 1 and n > 0}

    def split_with(self, run: str, more: dict[str, int]) -> tuple[str, ...]:
        """The split when ``more`` words, none of them in ``counts``, are known too."""
        if not more:
            return self._split(run)
        self.cost.update(self.costs(more))
        words = self._split(run)
        for w in more:
            self.cost.pop(w, None)
        return words

    def _split(self, run: str) -> tuple[str, ...]:
        n = len(run)
        best = [0.0] + [math.inf] * n
        back = [0] * (n + 1)
        far, far_start = math.inf, 0  # the best start of an unknown piece longer than any known word
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                cost = best[start] + self.cost.get(run[start:end], self.base + 2.5 * (end - start))
                if cost < best[end]:
                    best[end], back[end] = cost, start
            start = end - self.longest - 1
            if start >= 0:
                if best[start] - 2.5 * start < far:
                    far, far_start = best[start] - 2.5 * start, start
                cost = far + self.base + 2.5 * end
                if cost < best[end]:
                    best[end], back[end] = cost, far_start
        words = []
        while n:
            words.append(run[back[n]:n])
            n = back[n]
        return tuple(reversed(words))


def runs_of(host: Column, path: Column) -> Column:
    """The runs of letters in the host's labels but the last (the public
    suffix), and in the path."""
    labels = F.substring(host, F.lit(1), F.length(host) - F.length(F.substring_index(host, ".", -1)) - 1)
    return F.regexp_extract_all(F.concat_ws(" ", labels, F.lower(path)), F.lit("(" + _TOKEN + ")"))


def looked_up(items: DataFrame, by: DataFrame, key: str, head: int) -> DataFrame:
    """items joined to ``by`` (key, n, ...) on the key, the ``head`` most
    frequent keys by broadcast."""
    top = F.broadcast(by.filter(F.length(key) <= _HEAD_LETTERS).orderBy(F.desc("n"), key).limit(head))
    return items.join(top, key).unionByName(items.join(top.select(key), key, "left_anti").join(by, key))


def splits(urls: DataFrame, max_words: int) -> DataFrame:
    """run, n (how often it occurs), split: every distinct run of ``urls``."""
    runs = stored(urls.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("rid", F.monotonically_increasing_id()), "url-runs")
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    floor = max(3, total // 1000)
    seeds = runs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in SEEDS])).alias("w"), F.lit(floor).cast("long").alias("n"))
    # A token over LONGEST letters adds to the total only.
    counts = (runs.filter(F.length("run").between(2, LONGEST)).select(F.col("run").alias("w"), "n").unionByName(seeds)
              .groupBy("w").agg(F.sum("n").alias("n")))
    top = counts.filter(F.length("w") > 3).orderBy(F.desc("n"), "w").limit(max_words)
    head = {r["w"]: r["n"] for r in counts.filter(F.length("w") <= 3).unionByName(top).collect()}
    total += floor * len(SEEDS)

    def substrings(batches):
        for batch in batches:
            rids, subs = [], []
            for rid, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in range(0, len(run), 4096):
                    found = {run[a:b] for a in range(at, min(at + 4096, len(run))) for b in range(a + 4, min(a + LONGEST, len(run)) + 1)}
                    found = [w for w in found if w not in head]
                    rids.extend([rid] * len(found))
                    subs.extend(found)
                    if len(subs) > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(subs, pa.string())], names=["rid", "w"])
                        rids, subs = [], []
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(subs, pa.string())], names=["rid", "w"])

    known = (runs.select("rid", "run").mapInArrow(substrings, "rid long, w string").join(counts, "w")
             .groupBy("rid").agg(F.collect_set(F.struct("w", "n")).alias("known")))

    def work(batches):
        cut = Segmenter(head, total=total)
        for batch in batches:
            words = [cut.split_with(run, {k["w"]: k["n"] for k in more or ()})
                     for run, more in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["run", "n", "split"])

    return stored(runs.join(known, "rid", "left").select("run", "n", "known").mapInArrow(work, "run string, n long, split array<string>"), "url-splits")


def segmented(urls: DataFrame, max_words: int) -> DataFrame:
    """urls (row, runs, ...) with a column ``words`` in place of ``runs``."""
    each = looked_up(urls.select("row", F.posexplode("runs").alias("at", "run")), splits(urls, max_words), "run", max_words)
    found = (each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "split"))).alias("s"))
             .select("row", F.flatten(F.transform("s", lambda x: x["split"])).alias("words")))
    none = F.array().cast("array<string>")
    return stored(urls.drop("runs").join(found, "row", "left").withColumn("words", F.coalesce("words", none)), "url-words")


def weak_label(words: Column, seeds=STEMS, strong=STRONG_STEMS) -> Column:
    """Whether a url's words make it an example of the unwanted class."""
    stems = F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))

    def found(listed) -> Column:
        return F.size(F.array_intersect(stems, F.array(*[F.lit(w) for w in sorted(listed)]).cast("array<string>")))

    return (found(strong) > 0) | (found(seeds) > 1)


def fit_bayes(words: DataFrame, seeds=STEMS, strong=STRONG_STEMS) -> tuple[float, DataFrame]:
    """Prior log odds of the unwanted class; w, n and log odds of every word.

    Counts are of all urls: words exploded, one partial aggregate per word.
    """
    bad = weak_label(F.col("words"), seeds, strong).cast("long")
    each = words.select(bad.alias("bad"), "words")
    n = each.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    counts = stored(each.select("bad", F.explode("words").alias("w")).groupBy("w")
                    .agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")), "url-bayes")
    sums = counts.agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    size = sums["size"] + 1
    odds = (F.log((F.col("bad") + 1) / F.lit(float(sums["bad"] + size)))
            - F.log((F.col("n") - F.col("bad") + 1) / F.lit(float(sums["n"] - sums["bad"] + size))))
    return math.log((n["bad"] + 1) / (n["n"] - n["bad"] + 1)), counts.select("w", "n", odds.alias("odds"))


def judge(pages: DataFrame, rules=RULES, max_words: int = 50_000, seeds=STEMS, strong=STRONG_STEMS) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score (log odds). ``seeds`` and
    ``strong`` are the weak labels' words, without plural endings."""
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    urls = stored(urls.select("*", runs_of(F.col("host"), F.col("path")).alias("runs"), F.monotonically_increasing_id().alias("row")), "urls")
    words = segmented(urls, max_words)
    prior, odds = fit_bayes(words, seeds, strong)
    # Added in the order of the words: the sum doesn't depend on partitions.
    sums = (looked_up(words.select("row", F.posexplode("words").alias("at", "w")), odds, "w", max_words)
            .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "odds"))).alias("s"))
            .select("row", F.aggregate("s", F.lit(0.0), lambda total, x: total + x["odds"]).alias("sum")))
    scored = words.join(sums, "row", "left").withColumn("score", F.lit(prior) + F.coalesce("sum", F.lit(0.0)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "words", "score")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
