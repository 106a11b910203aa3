"""Constants and settings.

The first block holds fixed values that must equal the behaviour being
re-implemented (dictionary order, keyword alternation, phrase list, anchor
sentence, thresholds, category table). They are written out plainly and in
their natural order on purpose: changing the order of COMPANIES changes
which company a headline is tagged with.

The second block holds values that belong to this project only: the
stand-in lexicon scorer, the tokenisation rules, and the lead lines used to
turn the ``documents`` table into news items.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference behaviour; keep order and spelling)
# ---------------------------------------------------------------------------

COMPANIES = (
    "Tata Power", "Adani Green Energy", "JSW Energy", "NHPC", "SJVN",
    "ONGC", "Indian Oil Corporation", "BPCL", "GAIL",
    "VA Tech Wabag", "Ion Exchange India", "Antony Waste Handling Cell",
    "Tata Motors", "Olectra Greentech", "Exide Industries",
    "Sterling and Wilson Renewable Energy", "Inox Wind",
)

ESG_KEYWORDS = (
    "CARBON", "NET ZERO", "RENEWABLE", "EMISSIONS", "DECARBONIZATION", "GREEN HYDROGEN",
    "BIOFUEL", "EV", "SOLAR", "WIND", "HYDRO", "CLEAN", "POLLUTION", "WASTE", "SPILL", "FLY ASH",
    "EFFLUENT", "CLIMATE", "BIODIVERSITY", "ECOLOGY", "SUSTAINABILITY", "METHANE",
    "SEQUESTRATION", "AMMONIA",
)

NOISE_PHRASES = (
    "stocks in news", "sensex", "nifty", "top losers", "top gainers",
    "should you buy", "market news", "closing bell", "opening bell",
    "technical view", "stock pick", "brokerage view",
)

ESG_ANCHOR = "Renewable energy, solar power, carbon reduction, and sustainability."

POSITIVE_THRESHOLD = 0.5
NEGATIVE_THRESHOLD = -0.5

# Sentiment sees this many leading characters of a headline.
SENTIMENT_CHAR_LIMIT = 512
# Mini-batch sizes of the two model calls.
SENTIMENT_BATCH_SIZE = 16
ENCODER_BATCH_SIZE = 32

# Fallback scores when the sentiment model fails.
FALLBACK_SCORES = (0.0, 0.0, 1.0)  # positive, negative, neutral

# Coverage categories (documentation table; 17 companies in 5 groups).
COMPANY_CATEGORIES = (
    ("Renewable Energy", ("Tata Power", "Adani Green Energy", "JSW Energy", "NHPC", "SJVN")),
    ("Oil and Gas (Energy Transition)", ("ONGC", "Indian Oil Corporation", "BPCL", "GAIL")),
    ("Environmental Services", ("VA Tech Wabag", "Ion Exchange India", "Antony Waste Handling Cell")),
    ("EV and Clean Mobility", ("Tata Motors", "Olectra Greentech", "Exide Industries")),
    ("Green Infrastructure", ("Sterling and Wilson Renewable Energy", "Inox Wind")),
)

SENTIMENT_LABELS = ("Positive", "Neutral", "Negative")
# Stacking order of the company x sentiment chart.
STACK_ORDER = ("Negative", "Neutral", "Positive")
NOT_DETECTED = "Not Detected"
ESG_LABEL = "Environmental"
NON_ESG_LABEL = "Non-ESG"

PREVIEW_COLUMNS = (
    "Headline", "company", "esg_flag", "sentiment",
    "cumulative_score", "materiality_score",
    "esg_adjusted_score", "positive", "negative", "neutral",
)
RAW_PREVIEW_ROWS = 20
RESULT_PREVIEW_ROWS = 100
TOP_COMPANIES = 8
TOP_PIVOT_COMPANIES = 6
HISTOGRAM_BINS = 20
ABBREVIATE_AT = 100

# ---------------------------------------------------------------------------
# Project values (stand-ins and rules of this repository)
# ---------------------------------------------------------------------------

# Stand-in lexicon for the default sentiment scorer (whole lower-case words).
POSITIVE_WORDS = ("profit", "growth", "strong", "gains", "wins", "approval", "record")
NEGATIVE_WORDS = ("loss", "penalty", "probe", "decline", "weak", "fall", "triggers")

# Lexical tokens for the lexicon and bag-of-words scorers: runs of ASCII
# letters and digits in the lower-cased text. Same rule in Spark and DuckDB.
LEXICAL_TOKEN = "[a-z0-9]+"
# Words (attribution players are runs of words): split on ASCII blanks.
WORD_TOKEN = "[^ \t\n\r]+"

# Lead lines that turn each document into a news item (see sources/news.py).
EXTRA_COMPANIES = ("Acme Retail", "Midland Bank", "Northern Foods")
LEAD_PHRASES = (
    "reports record profit and strong growth on solar expansion",
    "posts loss as effluent spill triggers penalty",
    "announces board meeting",
    "wins approval with gains in net zero plan",
    "faces probe and decline after fly ash pollution",
    "stocks in news: sensex and nifty close flat",
    "shares fall on weak results and loss",
    "signs green hydrogen deal with Tata Power, profit up",
)

# Exact Shapley enumeration is used up to this many players.
MAX_EXACT_PLAYERS = 10


def company_category_rows() -> list[tuple[int, str, str]]:
    """(priority, company, category) in dictionary order."""
    category = {c: cat for cat, members in COMPANY_CATEGORIES for c in members}
    return [(i, c, category.get(c)) for i, c in enumerate(COMPANIES)]


@dataclass(frozen=True)
class Settings:
    """Knobs of one run; defaults follow the fixed values above."""

    companies: tuple[str, ...] = COMPANIES
    noise_phrases: tuple[str, ...] = NOISE_PHRASES
    esg_keywords: tuple[str, ...] = ESG_KEYWORDS
    anchor: str = ESG_ANCHOR
    positive_threshold: float = POSITIVE_THRESHOLD
    negative_threshold: float = NEGATIVE_THRESHOLD
    sentiment_chars: int = SENTIMENT_CHAR_LIMIT
    histogram_bins: int = HISTOGRAM_BINS
    attribution_players: int = 8
    # Per-group rows (e.g. histogram bounds) up to this many measured bytes are
    # broadcast; above it the join shuffles and AQE splits skewed partitions.
    max_broadcast_bytes: int = 32 << 20


DEFAULT = Settings()
