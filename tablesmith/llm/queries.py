"""One registered query per operator, with its parameters for production, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm import archives, backoff, bpe, chat, importance, mixing, passages, repair, secrets, simhash, sketches, topk, whitening
from tablesmith.llm.registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled sketches of each text, its edited text and the next document."""
    return sketches.edited_fingerprints(table(spark, sf_dir, "documents"))


@query()
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by rules and by Markov models trained on what the rules label."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@query()
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    return mixing.taken(table(spark, sf_dir, "documents"))


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling takes, with their log ratios."""
    taken = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return taken.select("doc_id", "log_ratio", "noisy_ratio")


@query()
def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit of a text that occurs earlier, with its place and the earliest document."""
    return passages.repeats(table(spark, sf_dir, "documents"))


@query()
def op6_passages_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated units: how many went, and the length and digest of the rest."""
    rest = passages.cleaned(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return rest.select("doc_id", F.size("removed").cast("bigint").alias("n_removed"), F.char_length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


@query(
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 50 = 0
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """
)
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every fiftieth vector with all others."""
    return topk.largest_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    """
    WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
    o AS (
        SELECT *, row_number() OVER w - 1 AS place, list({'r': role, 't': text}) OVER w AS upto
        FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST)
    ),
    p AS (SELECT conv_id, place, role, text, md5(CAST(upto AS VARCHAR)) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
    f AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS snapshots FROM p WHERE place + 1 = n GROUP BY prefix, n),
    k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = f.prefix AND p.place + 1 < p.n))
    SELECT p.conv_id, p.place, k.n AS n_turns, k.snapshots,
        '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
    FROM p JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id
    """
)
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that none continues, a rendered row per turn."""
    return chat.rendered(table(spark, sf_dir, "conversations"))


@query()
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests, by the ranks of a public vocabulary."""
    codec = bpe.Codec(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, sf_dir, "documents"), codec)


@query(
    """
    WITH w AS (
        SELECT doc_id, list_filter(
            string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
        FROM documents
    ),
    t AS (
        SELECT doc_id, i, words[i] AS word, CASE WHEN i > 1 THEN words[i - 1] END AS before
        FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)
    ),
    one AS (SELECT word, count(*) AS n FROM t GROUP BY word),
    two AS (SELECT before, word, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY before, word),
    s AS (
        SELECT t.doc_id, CASE
            WHEN t.before IS NULL THEN ln(u.n) - ln((SELECT sum(n) FROM one))
            WHEN b.n >= 2 THEN ln(b.n) - ln(p.n)
            ELSE ln(0.4) + ln(u.n) - ln((SELECT sum(n) FROM one)) END AS score
        FROM t JOIN one u USING (word)
        LEFT JOIN two b ON b.before = t.before AND b.word = t.word
        LEFT JOIN one p ON p.word = t.before
    )
    SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, round(coalesce(sum(s.score), 0), 4) AS log_score,
        round(sum(s.score) / nullif(len(w.words), 0), 6) AS mean_log_score
    FROM w LEFT JOIN s USING (doc_id)
    GROUP BY w.doc_id, len(w.words)
    """
)
def op1_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents, with counts from all of them."""
    scored = backoff.scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


@query()
def op1_backoff_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents with up to two words of context; the query above has one, as its SQL."""
    scored = backoff.scores(table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the four strongest components of all, each with variance one."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query(
    """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
    )
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
        CASE WHEN n < 1000 OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN n < 1000 OR page_id = last THEN NULL ELSE last END AS refers_to
    FROM p
    """
)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as legacy archives, converted to WARC and read back."""
    found = archives.through_archives(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations and the cheapest edits that mend their structure."""
    turns = table(spark, sf_dir, "conversations")
    return repair.report(turns, repair.damaged(turns))
