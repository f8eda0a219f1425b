"""Secrets in texts by fixed rules and by character Markov models, with DataFrame functions only.

Two models give the chance of a character after the one before it: one of random strings,
one of ordinary identifiers. A run of identifier characters whose likelihood ratio passes
a threshold is a secret. The samples that train the models are labelled by the rules: what
a rule finds is random, other identifiers are ordinary. Each model is mixed with even
chances, so that a pair never seen decides nothing alone.

Offsets count code points, with the end excluded. A rule's matches are found leftmost first
without overlap. Spark tells the matches and the pieces between them but no offsets, so
offsets are sums of the lengths before.

Defined cases: a null text is an empty one and has no secrets; rows that repeat keep their own
result; null ids stay null; an empty table trains even models and gives an empty result. Other
columns stay as they are in ``redacted``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import carried, fresh, let

# The rules, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
IDENTIFIER = r"[A-Za-z0-9+/_=-]"
#: Shortest identifiers to train on and to judge.
TRAIN_LENGTH, JUDGE_LENGTH = 8, 20
#: The models are fitted on about this many documents, chosen by a digest of the id.
SAMPLE_DOCS = 20_000
#: Weight of the samples against even chances, for random and for ordinary strings.
TRUST_RANDOM, TRUST_ORDINARY = 0.5, 0.99
#: A secret is at least exp(THRESHOLD) times likelier as a random string.
THRESHOLD = 16.0
SCALE = 1000
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Structs (start, kind, end, value) of the matches; ``keep`` is an array of booleans along them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)

    def located(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)

        def after(at: Column, pair: Column) -> Column:
            return at + F.char_length(pair["0"]) + F.char_length(pair["1"])

        def span(at: Column, pair: Column) -> Column:
            start = at + F.char_length(pair["0"])
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), after(at, pair).alias("end"), pair["1"].alias("value"))

        # the last piece follows the last match
        pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("0"), found.alias("1"))
        spans = let(pairs, lambda p: carried(p, F.lit(0).cast("bigint"), after, span, SPAN))
        kept = spans if keep is None else F.transform(F.filter(F.arrays_zip(spans.alias("s"), keep.alias("k")), lambda z: z["k"]), lambda z: z["s"])
        return F.when(F.size(found) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(kept)

    return let(matches, located)


def _last_before(spans: Column, place: Column) -> Column:
    """How many of the spans, which are in order, start before ``place``; by halving."""
    steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    near = F.filter(steps, lambda s: s <= F.size(spans))
    return F.aggregate(near, F.lit(0), lambda at, s: F.when(F.get(spans, at + s - 1)["start"] < place, at + s).otherwise(at))


def _by_rule(text: Column) -> list[Column]:
    """The matches of each rule; those of one rule don't overlap."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), 2)
    assign = _spans(text, ASSIGN, 0, F.transform(values, lambda v: F.char_length(v) >= LEAST["assign"]))
    # a run too short for its kind can't hide a longer match inside, so these rules may ask for the length
    access = _spans(text, f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", 1)
    digits = _spans(text, f"[0-9a-f]{{{LEAST['hex']},}}", 2)
    return [assign, access, digits]


def rule_spans(text: Column) -> Column:
    """All matches of the rules, by start and then kind."""
    return F.array_sort(F.concat(*_by_rule(text)))


def _codes(value: Column) -> Column:
    """Places in the alphabet, from 0."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def samples(docs: DataFrame, documents: int = SAMPLE_DOCS) -> DataFrame:
    """(value, random): labelled strings from about ``documents`` documents."""
    share = min(1.0, documents / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))).select(F.coalesce("text", F.lit("")).alias("text"))
    found = chosen.select("text", rule_spans(F.col("text")).alias("spans"), F.regexp_extract_all("text", F.lit(ASSIGN), 2).alias("values"))
    secret = F.concat(
        F.filter("values", lambda v: F.char_length(v) >= LEAST["assign"]),
        F.transform(F.filter("spans", lambda s: s["kind"] != 0), lambda s: s["value"]),
    )
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|[0-9a-f]{{{LEAST['hex']},}}", " ")
    plain = F.regexp_extract_all(rest, F.lit(f"{IDENTIFIER}{{{TRAIN_LENGTH},}}"), 0)
    labelled = F.concat(_labelled(secret, True), _labelled(plain, False))
    values = found.select(F.explode(labelled).alias("one")).select("one.*")
    return values.withColumn("value", F.regexp_replace("value", "[^A-Za-z0-9+/_=-]", ""))


def _labelled(values: Column, random: bool) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(random).alias("random")))


def fit(labelled: DataFrame) -> list[float]:
    """Log likelihood ratios by pair of characters, random against ordinary, from (value, random)."""
    size = len(ALPHABET)
    codes = labelled.select("random", _codes(F.col("value")).alias("codes")).where(F.size("codes") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("codes") - 1), lambda i: F.col("codes")[i - 1] * size + F.col("codes")[i])
    counts = codes.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()  # two alphabets squared at most
    seen = {True: [0.0] * size**2, False: [0.0] * size**2}
    for random, pair, count in counts:
        seen[random][pair] += count

    def chance(random: bool, pair: int, trust: float) -> float:
        first = pair - pair % size
        total = sum(seen[random][first : first + size])
        learned = seen[random][pair] / total if total else 1 / size
        return trust * learned + (1 - trust) / size

    return [math.log(chance(True, p, TRUST_RANDOM) / chance(False, p, TRUST_ORDINARY)) for p in range(size**2)]


def likelihood_ratio(value: Column, model: list[float]) -> Column:
    """How much likelier, as a logarithm, ``value`` is as a random string; characters outside the alphabet must not occur."""
    table = F.split(F.lit(",".join(str(round(x * SCALE)) for x in model)), ",").cast("array<int>")

    def total(codes: Column) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.size(codes) - 1, F.lit(1)))
        score = F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, i: s + F.get(table, F.get(codes, i - 1) * len(ALPHABET) + F.get(codes, i)))
        return F.when(F.size(codes) > 1, score / SCALE).otherwise(F.lit(0.0))

    return let(_codes(value), total)


def spans(text: Column, model: list[float], threshold: float = THRESHOLD, length: int = JUDGE_LENGTH) -> Column:
    """Matches of the rules and further random strings, by start and then kind."""
    candidates = _spans(text, f"{IDENTIFIER}{{{length},}}", 3)

    def apart(rule: Column, span: Column) -> Column:
        """No match of a rule overlaps the span: the last one that starts before the span's end is over by its start."""
        last = F.get(rule, _last_before(rule, span["end"]) - 1)
        return F.coalesce(last["end"] <= span["start"], F.lit(True))

    def joined(rules: Column) -> Column:
        parts = [rules[f"r{i}"] for i in range(3)]
        more = F.filter(
            candidates, lambda c: apart(parts[0], c) & apart(parts[1], c) & apart(parts[2], c) & (likelihood_ratio(c["value"], model) >= threshold)
        )
        return F.array_sort(F.concat(*parts, more))

    return let(F.struct(*[c.alias(f"r{i}") for i, c in enumerate(_by_rule(text))]), joined)


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """Counts, a digest of the rules' spans and all spans of each text."""
    model = fit(samples(docs)) if model is None else model
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", spans(F.col("text"), model).alias("found"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    counts = [_count(kind) for kind in range(3)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, model: list[float] | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The documents with ``mask`` for each secret, overlapping ones as one, and ``n_chars`` after that."""
    model = fit(samples(docs)) if model is None else model

    def masked(found: Column) -> Column:
        """Blocks of spans, each with the text from the end of those before, so that places are sought in a block's text only."""
        text, width = F.col("text"), 256

        def cut(state: Column, span: Column) -> Column:
            at = state["at"] - state["base"]
            before = F.substring(state["rest"], (at + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
            return F.struct(
                state["base"].alias("base"),
                state["rest"].alias("rest"),
                F.greatest(state["at"], span["end"]).alias("at"),
                F.when(span["start"] >= state["at"], F.concat(state["out"], F.array(before, F.lit(mask)))).otherwise(state["out"]).alias("out"),
            )

        def block(state: Column, first: Column) -> Column:
            mine = F.slice(found, first, width)
            # no match of a block reaches further than the farthest end
            reach = F.array_max(F.transform(mine, lambda s: s["end"]))
            rest = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(reach - state["at"], F.lit(0)).cast("int"))
            zero = F.struct(state["at"].alias("base"), rest.alias("rest"), state["at"].alias("at"), F.array().cast("array<string>").alias("out"))
            return let(
                F.aggregate(mine, zero, cut),
                lambda one: F.struct(one["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(one["out"], ""))).alias("out")),
            )

        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
        rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text)))
        firsts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(width))
        return F.when(F.size(found) == 0, text).otherwise(F.aggregate(firsts, start, block, rest))

    clean = F.when(F.col("text").isNull(), F.col("text")).otherwise(let(spans(F.col("text"), model), masked))
    name = fresh(docs, "clean")
    changed = docs.withColumn(name, clean)
    if "n_chars" in docs.columns:
        same = F.col(name).eqNullSafe(F.col("text"))
        changed = changed.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.char_length(name).cast(docs.schema["n_chars"].dataType)))
    return changed.withColumn("text", F.col(name)).drop(name)
