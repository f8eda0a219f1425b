"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, so
its size follows the text's, sketches of parts merge by union, and the share of one
sketch found in another estimates containment however unequal the texts are. A text too
short to have a hash below the threshold keeps its smallest one. That merges too: the
smallest of all stays only while no hash lies below the threshold.

Defined cases: a null text is an empty one, whose sketch is empty; two empty sketches
are alike (1.0), an empty one and another are not (0.0). A text of fewer words than a
shingle is one shingle. Null ids sort first; rows that share an id sort by a digest of
the text; rows that repeat wholly follow each other. Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import let, numbered, repeated

SHINGLE = 5
#: One in so many hashes is kept.
SCALE = 8


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """A hash for each shingle, in order of the text; none for a text without words."""
    tokens = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda t: t != "")

    def shingles(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - (words - 1), F.lit(1))
        joined = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashes, i, words)))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(joined)

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), shingles)


def sketch(text: Column, words: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct hashes below ``2**64 / scale``, or the smallest one."""
    limit = (1 << 64) // scale

    def below(hashes: Column) -> Column:
        kept = F.filter(hashes, lambda h: h.between(0, limit - 1))
        least = F.coalesce(F.array_min(F.filter(hashes, lambda h: h >= 0)), F.array_min(hashes))
        smallest = F.when(F.size(hashes) > 0, F.array(least)).otherwise(hashes)
        return let(kept, lambda k: F.when(F.size(k) > 0, F.array_sort(F.array_distinct(k))).otherwise(smallest))

    return let(shingle_hashes(text, words), below)


def merged(first: Column, second: Column, scale: int = SCALE) -> Column:
    """The sketch of two shingle sets together, from their sketches."""
    both = F.array_sort(F.array_union(first, second))
    below = F.filter(both, lambda h: h.between(0, (1 << 64) // scale - 1))
    least = F.coalesce(F.array_min(F.filter(both, lambda h: h >= 0)), F.array_min(both))
    return F.when((F.size(below) > 0) | (F.size(both) == 0), below).otherwise(F.array(least))


def containment(first: Column, second: Column) -> Column:
    """The estimated share of the smaller shingle set that the other one has."""
    smaller = F.least(F.size(first), F.size(second))
    larger = F.greatest(F.size(first), F.size(second))
    share = F.size(F.array_intersect(first, second)) / F.nullif(smaller, F.lit(0))
    return F.when(larger == 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def digits(hashes: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def edited_fingerprints(docs: DataFrame, words: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Each text's sketch against that of its edited text and that of the next document.

    The edited text has its last quarter replaced by as much of the start of the next
    document by id; after the last comes the first. Texts are shuffled once: that one
    exchange serves as the side that gives its start and as the side that takes it.
    """
    text = F.coalesce("text", F.lit(""))
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    keyed = docs.select("doc_id", text.alias("text"), F.md5(named.cast("binary")).alias("key"))
    narrow = keyed.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first(F.char_length("text")).alias("n_chars").cast("bigint"), F.count("*").alias("copies")
    )
    placed = numbered(narrow, [F.col("doc_id").asc_nulls_first(), F.col("key")])
    rows = placed.count()
    following = placed.select(F.col("key").alias("source"), F.pmod(F.col("place") - 1, F.lit(max(rows, 1))).alias("place"))
    to_next = placed.join(following, "place").select("key", "doc_id", "n_chars", F.lit(1).cast("bigint").alias("times"), "source")
    to_copy = placed.where("copies > 1").select("key", "doc_id", "n_chars", (F.col("copies") - 1).alias("times"), F.col("key").alias("source"))
    takes = to_next.unionByName(to_copy)

    texts = keyed.select("key", "text", sketch(F.col("text"), words, scale).alias("hashes")).dropDuplicates(["key"])
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    given = (
        texts.withColumnRenamed("key", "source")
        .join(takes, "source")
        .select("key", "doc_id", "n_chars", "times", F.substring(F.col("text"), F.lit(1), quarter).alias("start"), F.col("hashes").alias("next_hashes"))
    )
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.col("start"))
    joined = texts.join(given, "key").select("doc_id", "n_chars", "times", "hashes", "next_hashes", edited.alias("edited"))
    scored = joined.withColumn("edited_hashes", sketch(F.col("edited"), words, scale)).select(
        "doc_id",
        "n_chars",
        "times",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digits(F.col("hashes")).alias("fingerprint"),
        digits(F.col("edited_hashes")).alias("edited_fingerprint"),
        containment(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        containment(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
    return repeated(scored, "times")
