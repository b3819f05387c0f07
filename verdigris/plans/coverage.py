"""How often each rule matches, in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.registry import FunctionRegistry
from verdigris.model import Ruleset
from verdigris.plans.evaluation import Effects, effects, lowered
from verdigris.plans.lowering import column


@dataclass(frozen=True)
class RuleCoverage:
    rule_id: str
    match_count: int
    first_match_count: int
    match_rate: float
    dead: bool
    suspiciously_broad: bool


@dataclass(frozen=True)
class CoverageReport:
    total_rows: int
    no_match_count: int
    error_count: int
    rules: tuple[RuleCoverage, ...]
    no_match_rows: DataFrame

    @property
    def match_counts(self) -> dict[str, int]:
        return {r.rule_id: r.match_count for r in self.rules}

    @property
    def first_match_distribution(self) -> dict[str, int]:
        return {r.rule_id: r.first_match_count for r in self.rules}

    @property
    def dead_rule_ids(self) -> tuple[str, ...]:
        return tuple(r.rule_id for r in self.rules if r.dead)

    @property
    def suspiciously_broad_rule_ids(self) -> tuple[str, ...]:
        return tuple(r.rule_id for r in self.rules if r.suspiciously_broad)


def _effects(df: DataFrame, ruleset: Ruleset, registry: FunctionRegistry | None, prefix: str) -> Effects:
    if not isinstance(prefix, str) or not prefix.strip():
        raise ValueError("column_prefix must be a non-empty string.")
    if clash := [c for c in df.columns if c.casefold().startswith(f"{prefix}_".casefold())]:
        raise ValueError(f"input columns clash with the report's own: {clash}")
    return effects(df, lowered(df, ruleset, registry, prefix))


def _counts(found: Effects, rules: int) -> DataFrame:
    """Flags are counted as they are; rows are reduced to one per first match in every task."""
    first, failed = found.number_of_first(rules), F.lit(False) if found.failed is None else found.failed.isNotNull()
    flags = [] if found.first is not None else [F.coalesce(found.effective[k], F.lit(False)).alias(f"m{k}") for k in range(rules)]
    rows = found.df.select(F.when(~failed, first).alias("first"), failed.alias("failed"), *flags)
    some = rows.groupBy("first", "failed").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"m{k}") & ~F.col("failed")).alias(f"m{k}") for k in range(rules) if flags])

    def total(test: Column, of: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(of))), F.lit(0)).cast("bigint")

    out = [total(F.lit(True)).alias("total"), total(F.col("first").isNull() & ~F.col("failed")).alias("no_match"), total(F.col("failed")).alias("error")]
    for k in range(rules):
        is_first = F.col("first") == k
        out += [(total(F.lit(True), f"m{k}") if flags else total(is_first)).alias(f"m{k}"), total(is_first).alias(f"f{k}")]
    return some.agg(*out)


def _no_match(df: DataFrame, found: Effects, rules: int) -> DataFrame:
    failed = F.lit(False) if found.failed is None else found.failed.isNotNull()
    return found.df.filter(found.number_of_first(rules).isNull() & ~failed).select(*[column(c) for c in df.columns])


def coverage_counts(df: DataFrame, ruleset: Ruleset, registry: FunctionRegistry | None = None, prefix: str = "coverage") -> DataFrame:
    """One row: total, no_match, error, and m<i>/f<i> for the i-th active rule."""
    return _counts(_effects(df, ruleset, registry, prefix), len(ruleset.active_rules()))


def no_match_rows(df: DataFrame, ruleset: Ruleset, registry: FunctionRegistry | None = None, prefix: str = "coverage") -> DataFrame:
    """The rows of ``df`` that no rule matched and none failed on."""
    return _no_match(df, _effects(df, ruleset, registry, prefix), len(ruleset.active_rules()))


def coverage(df: DataFrame, ruleset: Ruleset, registry: FunctionRegistry | None = None, *, broad_match_threshold: float = 0.40, column_prefix: str = "coverage") -> CoverageReport:
    """Counts per active rule; an empty table has rate 0 everywhere. ``no_match_rows`` stays lazy."""
    if not 0 <= broad_match_threshold <= 1:
        raise ValueError("broad_match_threshold must be between 0 and 1.")
    active = ruleset.active_rules()
    found = _effects(df, ruleset, registry, column_prefix)
    row = _counts(found, len(active)).first()
    total, rules = row["total"], []
    for i, rule in enumerate(active):
        rate = row[f"m{i}"] / total if total else 0.0
        rules.append(RuleCoverage(rule.rule_id, row[f"m{i}"], row[f"f{i}"], rate, row[f"m{i}"] == 0, total > 0 and rate >= broad_match_threshold))
    return CoverageReport(total, row["no_match"], row["error"], tuple(rules), _no_match(df, found, len(active)))
