"""Dictionary tags by one linear scan: an Aho-Corasick automaton of all names.

The names are ranked in Spark, the automaton is built once on the driver, its
pickled size is measured, and it goes to the workers as a broadcast variable.
Each text is read once, whatever the number of names; nothing is shuffled.
A dictionary whose text, or whose automaton, is over its limit is not collected or not
shipped: the caller joins instead (``tag.tag_by_join``).
"""

from __future__ import annotations

import pickle

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measured bytes of a pickled automaton that is still broadcast.
MAX_AUTOMATON = 128 << 20
#: Bytes of names and carried columns that are still collected to build one.
MAX_NAMES = 16 << 20


def dictionary_bytes(names: DataFrame) -> int:
    """What the names and the columns they carry would take on the driver, about."""
    size = F.octet_length("low") + F.octet_length(F.to_json(F.struct("hit"))) + F.lit(64)
    return int(names.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])


def build_automaton(names: DataFrame) -> tuple[bytes, list[tuple]]:
    """names: low, rank, hit. The pickled automaton, which maps a name to its
    place in the dictionary, and the hits by place. Collects the names."""
    rows = names.orderBy("rank").select("low", "hit").collect()
    automaton = ahocorasick.Automaton()
    for place, row in enumerate(rows):
        if row["low"]:
            automaton.add_word(row["low"], place)
    if len(automaton):
        automaton.make_automaton()
    # An empty name occurs in every text.
    always = next((i for i, r in enumerate(rows) if r["low"] == ""), len(rows))
    return pickle.dumps((automaton, always)), [tuple(r["hit"]) for r in rows]


def scan(df: DataFrame, text_col: str, payload: bytes, hits: list[tuple], hit_type: T.StructType) -> DataFrame:
    """``df`` with the columns of the first hit in dictionary order (null: none)."""
    hit_type = T.StructType([T.StructField(f.name, f.dataType, True) for f in hit_type])  # a text may have none
    shared = df.sparkSession.sparkContext.broadcast((payload, hits))
    held = {}

    def first(lowered: pd.Series) -> pd.DataFrame:
        if "automaton" not in held:  # once per worker
            blob, found = shared.value
            held["automaton"], held["always"] = pickle.loads(blob)
            held["hits"] = [*found, (None,) * len(hit_type)]
        automaton, always, rows = held["automaton"], held["always"], held["hits"]
        none, usable = len(rows) - 1, len(automaton) > 0
        places = []
        for text in lowered:
            best = none
            if isinstance(text, str):
                best = min(always, none)
                for _, place in automaton.iter(text) if usable else ():
                    if place < best:
                        best = place
            places.append(best)
        return pd.DataFrame({f.name: pd.Series([rows[p][i] for p in places], dtype=object) for i, f in enumerate(hit_type)})

    tagged = df.withColumn("__hit", F.pandas_udf(first, hit_type)(F.lower(F.col(text_col))))
    return tagged.select(*df.columns, *[F.col("__hit")[f.name].alias(f.name) for f in hit_type])


def tag_by_automaton(df: DataFrame, names: DataFrame, text_col: str = "Headline", max_bytes: int = MAX_AUTOMATON,
                     max_names: int = MAX_NAMES) -> DataFrame | None:
    """``df`` with the hit of each row, or None where the dictionary is over a limit."""
    if dictionary_bytes(names) > max_names:
        return None
    payload, hits = build_automaton(names)
    if len(payload) > max_bytes:
        return None
    return scan(df, text_col, payload, hits, names.schema["hit"].dataType)
