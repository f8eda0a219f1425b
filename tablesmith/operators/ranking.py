"""Relevance of catalog entries to messages, by keywords.

A small catalog is configuration handed over as Python values. It becomes part of the
column expressions, so scoring and ranking run where the message is: no join and
no exchange, whatever the number of messages. A catalog of any size is a table: its keywords become one automaton
that is walked over the messages, and what it finds is joined with the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.operators.automaton import occurrences

# Points per whole-word keyword, per partial keyword and per shared word.
WHOLE, PARTIAL, SHARED = 3.0, 1.0, 0.5
_BLANKS = r"(?U)\s+"  # any blank of Unicode


@dataclass(frozen=True)
class Entry:
    name: str
    keywords: tuple[str, ...]
    when_to_use: str = ""


def _prepared(messages: DataFrame, text: str) -> DataFrame:
    """Lower-case text and distinct words, worked out once per message."""
    low = messages.withColumn("_low", F.lower(text))
    return low.withColumn("_words", F.array_distinct(F.split("_low", _BLANKS)))


def _scores(catalog: Sequence[Entry]) -> Column:
    """All entries with their score, as an array in catalog order."""
    text, words = F.col("_low"), F.col("_words")
    scored = []
    for position, entry in enumerate(catalog):
        score = F.lit(0.0)
        for keyword in entry.keywords:
            key = F.lit(keyword.lower())
            score = score + F.when(F.array_contains(words, key), WHOLE).when(text.contains(key), PARTIAL).otherwise(0.0)
        use = sorted(set(entry.when_to_use.lower().split()))
        if use:
            shared = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in use])))
            score = score + shared * SHARED
        scored.append(F.struct((-score).alias("_order"), F.lit(position).alias("_position"), F.lit(entry.name).alias("entry"), score.alias("score")))
    return F.array(*scored)


def keyword_scores(messages: DataFrame, text: str, catalog: Sequence[Entry], keep: Sequence[str]) -> DataFrame:
    """The score of every entry for every message."""
    rows = _prepared(messages, text).select(*keep, F.explode(_scores(catalog)).alias("_s"))
    return rows.select(*keep, "_s.entry", "_s.score")


def keyword_topk(
    messages: DataFrame, text: str, catalog: Sequence[Entry], keep: Sequence[str], k: int = 3, minimum: float = 1.0
) -> DataFrame:
    """The best entries per message with at least the minimum score; ties keep catalog order."""
    enough = F.filter(_scores(catalog), lambda s: s["score"] >= minimum)
    best = F.slice(F.array_sort(enough), 1, k)
    rows = _prepared(messages, text).select(*keep, F.posexplode(best).alias("_p", "_s"))
    return rows.select(*keep, (F.col("_p") + 1).alias("place"), "_s.entry", "_s.score")


def catalog_scores(messages: DataFrame, text: str, catalog: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, entry, score) of the entries with any point, for a catalog of any size.

    ``catalog`` has rows of (entry, keyword, shared): a keyword, or with ``shared`` a word of the text on when to use the entry. ``keep`` tells
    messages apart. Words of the catalog are collected once to build the automaton.
    """
    plain = catalog.select("entry", F.lower("keyword").alias("keyword"), "shared").where("keyword <> ''").distinct()
    words = [r.keyword for r in plain.select("keyword").distinct().collect()]
    low = messages.select(*keep, F.lower(text).alias("_low"))
    found = occurrences(low, "_low", words, keep).withColumnRenamed("pattern", "keyword")
    whole = F.col("whole") & ~F.col("keyword").rlike(_BLANKS)  # what holds a blank is no word
    points = F.when(F.col("shared"), F.when(whole, SHARED).otherwise(0.0)).otherwise(F.when(whole, WHOLE).otherwise(PARTIAL))
    return found.join(plain, "keyword").groupBy(*keep, "entry").agg(F.sum(points).alias("score")).where("score > 0")


def catalog_topk(messages: DataFrame, text: str, catalog: DataFrame, keep: Sequence[str], k: int = 3, minimum: float = 1.0) -> DataFrame:
    """(keep, place, entry, score): the best entries per message with at least the minimum score; ties go to the smaller name."""
    order = Window.partitionBy(*keep).orderBy(F.col("score").desc(), "entry")
    scored = catalog_scores(messages, text, catalog, keep).where(F.col("score") >= minimum)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(*keep, "place", "entry", "score")
