"""Rules over rows: any number of predicates in one pass, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import SEVERITIES, severity_rank


@dataclass(frozen=True)
class Rule:
    flag: str
    severity: str
    when: Column
    detail: Column | str = ""


def flag_rows(
    df: DataFrame, rules: Sequence[Rule], keep: Sequence[str], keep_unflagged: bool = False
) -> DataFrame:
    """One row per row and rule that holds; a null predicate does not hold.

    ``keep_unflagged`` leaves one row with null findings where no rule holds.
    """
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    rule.when,
                    F.struct(
                        F.lit(rule.flag).alias("flag"),
                        F.lit(rule.severity).alias("severity"),
                        (F.lit(rule.detail) if isinstance(rule.detail, str) else rule.detail).alias("detail"),
                    ),
                )
                for rule in rules
            ]
        )
    )
    explode = F.explode_outer if keep_unflagged else F.explode
    return df.select(*keep, explode(found).alias("_f")).select(*keep, "_f.*")


def severity_summary(flags: DataFrame) -> DataFrame:
    """Number of findings for each of the four severities, zeros included."""
    counts = flags.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.unpivot([], list(SEVERITIES), "severity", "findings")


def at_least(flags: DataFrame, severity: str) -> DataFrame:
    """Findings of the given severity or worse."""
    return flags.where(severity_rank("severity") <= SEVERITIES.index(severity) + 1)


def risk_level(flags: DataFrame, by: Sequence[str]) -> DataFrame:
    """CRITICAL for more than three HIGH findings, HIGH for any, else LOW."""
    high = F.count_if(F.col("severity") == "HIGH")
    level = F.when(F.col("high") > 3, "CRITICAL").when(F.col("high") > 0, "HIGH").otherwise("LOW")
    return flags.groupBy(*by).agg(high.alias("high")).withColumn("risk_level", level)
