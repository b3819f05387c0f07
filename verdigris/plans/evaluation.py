"""Row decisions of a ruleset over a DataFrame: one lazy plan, two projections."""

from __future__ import annotations

import operator as py
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris import __version__
from verdigris.errors import ValidationFailed
from verdigris.functions.registry import FunctionRegistry
from verdigris.functions.standard import standard_registry
from verdigris.model import Ruleset
from verdigris.plans.audit import ASSIGNMENT_EVENT, RULE_TRACE, Audit
from verdigris.plans.lowering import TEMPORARY, Lowering, as_column, column, outcome
from verdigris.plans.simple_sql import sql_literal
from verdigris.plans.typing import check_against_schema
from verdigris.sources.ruleset_export import content_hash

COMPACT_FIELDS = ("error", "matched", "matched_rule_ids", "assign")
AUDIT_FIELDS = ("matched_rules", "assignment_results")
IDENTITY_FIELDS = ("ruleset", "engine_version")
#: The start of the message with which a failed row raises.
FAILURE = "Row evaluation failed with "
_IDS = T.ArrayType(T.StringType(), False)


def result_field_names(full_audit: bool = False) -> tuple[str, ...]:
    """Names of the decision fields, without prefix."""
    return COMPACT_FIELDS + (AUDIT_FIELDS if full_audit else ())


class Evaluation:
    """The decisions of one ruleset over one DataFrame; nothing runs before an action."""

    def __init__(self, plan: DataFrame, source_columns: list[str], keys: tuple[str, ...], prefix: str, targets: dict[str, T.DataType], full_audit: bool):
        self._plan, self._source, self._keys, self._prefix, self.targets = plan, source_columns, keys, prefix, targets
        self._results = [f"{prefix}_{n}" for n in (*result_field_names(full_audit), *IDENTITY_FIELDS)]

    @property
    def attached_df(self) -> DataFrame:
        """All input columns with the decision columns."""
        return self._plan

    @property
    def results_df(self) -> DataFrame:
        """Key columns and decision columns."""
        return self._plan.select(*[column(k) for k in self._keys], *[column(r) for r in self._results])

    def apply_assignments(self) -> DataFrame:
        """The input with assignments applied: existing targets in place, new ones behind, in ruleset order."""
        assign = column(f"{self._prefix}_assign")

        def value(target: str, otherwise: Column) -> Column:
            part = assign.getField(target)
            return F.when(part.getField("applied"), part.getField("value")).otherwise(otherwise).alias(target)

        kept = [value(c, column(c)) if c in self.targets else column(c) for c in self._source]
        new = [value(t, F.lit(None).cast(kind)) for t, kind in self.targets.items() if t not in self._source]
        return self._plan.select(*kept, *new)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Evaluation:
        self._plan.persist(level)
        return self

    def unpersist(self, blocking: bool = False) -> Evaluation:
        self._plan.unpersist(blocking)
        return self


def _keys(df: DataFrame, wanted: Sequence[str] | None, targets: set[str]) -> tuple[str, ...]:
    if wanted is None:
        return tuple(df.columns)
    if isinstance(wanted, str | bytes) or not isinstance(wanted, Sequence):
        raise TypeError("key_columns must be a sequence of column names.")
    if not wanted:
        raise ValueError("key_columns cannot be empty.")
    if not all(isinstance(k, str) and k.strip() for k in wanted):
        raise TypeError("key_columns must hold non-empty strings.")
    folded = Counter(k.casefold() for k in wanted)
    if max(folded.values()) > 1:
        raise ValueError("key_columns cannot name a column twice, whatever the case.")
    if missing := [k for k in wanted if k not in df.columns]:
        raise ValueError(f"key_columns are not in the input: {missing}")
    if changed := [k for k in wanted if k in targets]:
        raise ValueError(f"key_columns cannot be assignment targets: {changed}")
    return tuple(wanted)


def lowered(df: DataFrame, ruleset: Ruleset, registry: FunctionRegistry | None, column_prefix: str, keyed: bool = False, full_audit: bool = False, include_error_traceback: bool = False) -> Lowering:
    """The checked ruleset over the schema of ``df``, ready to be attached; raises for findings and clashing names."""
    registry = registry or standard_registry()
    doubled = [n for n, k in Counter(c.casefold() for c in df.columns).items() if k > 1]
    if doubled and keyed:
        raise ValueError(f"input columns are ambiguous: {doubled}")
    reserved = {f"{column_prefix}_{n}".casefold() for n in (*result_field_names(True), *IDENTITY_FIELDS)}
    result, typed = check_against_schema(ruleset, df.schema, registry)
    if clash := [c for c in [*df.columns, *(typed.targets if typed else ())] if c.casefold() in reserved]:
        raise ValueError(f"columns are reserved for results: {clash}")
    if not result.passed or typed is None:
        raise ValidationFailed(result)
    if doubled:
        raise ValueError(f"input columns are ambiguous: {doubled}")
    return Lowering(typed, registry, full_audit, include_error_traceback)


def evaluate(
    df: DataFrame,
    ruleset: Ruleset,
    registry: FunctionRegistry | None = None,
    *,
    key_columns: Sequence[str] | None = None,
    column_prefix: str = "rules",
    fail_on_error: bool = True,
    include_error_traceback: bool = False,
    full_audit: bool = False,
) -> Evaluation:
    """Decide every row of ``df``; also works on streaming DataFrames.

    A row whose rules fail gets the error's text, or raises at the first action with ``fail_on_error``. Rows are
    independent: nulls, empty and very long texts, repeated rows and empty tables need no special care, and
    input columns that aren't read may have any name but those of the decision columns. Tracebacks exist for
    Python functions only.
    """
    for name, flag in (("fail_on_error", fail_on_error), ("include_error_traceback", include_error_traceback), ("full_audit", full_audit)):
        if not isinstance(flag, bool):
            raise TypeError(f"{name} must be a bool, not {type(flag).__name__}.")
    if not isinstance(column_prefix, str) or not column_prefix.strip():
        raise ValueError("column_prefix must be a non-empty string.")
    low = lowered(df, ruleset, registry, column_prefix, key_columns is not None, full_audit, include_error_traceback)
    typed = low.typed
    keys = _keys(df, key_columns, set(typed.targets))
    plan = _decide(df, low, column_prefix, fail_on_error, full_audit)
    identity = F.struct(F.lit(ruleset.ruleset_id).alias("id"), F.lit(ruleset.version).alias("version"), F.lit(content_hash(ruleset)).alias("content_hash"))
    plan = plan.withColumns({f"{column_prefix}_ruleset": identity, f"{column_prefix}_engine_version": F.lit(__version__)})
    shown = [f"{column_prefix}_{n}" for n in (*result_field_names(full_audit), *IDENTITY_FIELDS)]
    plan = plan.select(*[column(c) for c in df.columns], *[column(s) for s in shown])
    return Evaluation(plan, df.columns, keys, column_prefix, typed.targets, full_audit)


@dataclass
class Effects:
    """Which rules took effect, as columns of ``df``: one flag per rule (``effective``), the first of them, and the error."""

    df: DataFrame
    effective: Mapping[int, Column] | _Equal
    failed: Column | None
    first: Column | None  # where the number of the first match says it all

    def number_of_first(self, rules: int) -> Column:
        if self.first is not None:
            return self.first
        found = [F.when(self.effective[k], F.lit(k)) for k in range(rules)]
        return F.coalesce(*found, F.lit(None).cast("int"))


def effects(df: DataFrame, low: Lowering) -> Effects:
    """The flags of all rules, in one plan over ``df``."""
    df = low.attach(df)
    failed: Column | None = None
    if low.first is not None:
        return Effects(df, _Equal(low.first), None, low.first)
    stop = low.stopped_at()
    if stop is not None:
        df = df.select("*", stop.alias(f"{TEMPORARY}stop"))
        at = F.col(f"{TEMPORARY}stop")
        for k, rule in sorted(low.lowered.items()):
            if rule.error is not None:
                failed = F.when(at == k, rule.error) if failed is None else failed.when(at == k, rule.error)
        effective = {k: r.match & F.coalesce(at >= k, F.lit(True)) for k, r in sorted(low.lowered.items())}
    else:
        effective = {k: r.match for k, r in sorted(low.lowered.items())}
    if failed is not None:
        df = df.select("*", failed.alias(f"{TEMPORARY}error"))
        failed = F.col(f"{TEMPORARY}error")
    return Effects(df, effective, failed, None)


def _decide(df: DataFrame, low: Lowering, prefix: str, fail_on_error: bool, full_audit: bool) -> DataFrame:
    found = effects(df, low)
    df, effective, failed = found.df, found.effective, found.failed
    targets = low.typed.targets
    if low.first is not None:
        texts = [sql_literal(r.rule_id) for r in low.rules]
        ids = F.expr(f"array({', '.join(texts)})") if None not in texts else F.array(*[F.lit(r.rule_id) for r in low.rules])
        matched = low.first.isNotNull()
        rule_ids = F.when(matched, F.array(F.coalesce(F.get(ids, low.first), F.lit("")))).otherwise(F.array().cast(_IDS))
    else:
        matched = reduce(py.or_, effective.values()) if effective else F.lit(False)
        hits = [F.when(test, low.rules[k].rule_id) for k, test in effective.items()]
        rule_ids = F.array_compact(F.array(*hits)) if hits else F.array().cast(_IDS)
    fine = F.lit(True)
    if failed is not None:
        fine = failed.isNull()
        if fail_on_error:
            message = F.concat(F.lit(FAILURE), failed)
            fine = F.when(failed.isNull(), True).otherwise(F.raise_error(message).cast("boolean"))

    def guarded(value: Column, otherwise: Column) -> Column:
        return value if failed is None else F.when(fine, value).otherwise(otherwise)

    parts = []
    for target, kind in targets.items():
        writers = [(k, i) for k, r in sorted(low.lowered.items(), reverse=True) for i, a in enumerate(r.rule.assignments) if a.target == target]
        nothing = outcome(False, F.lit(None).cast(kind))
        chain = None
        if low.first is not None and _constants(low, writers):
            values = {k: low.lowered[k].values[i] for k, i in writers}
            numbers = range(len(low.rules))
            if all(isinstance(v, str) for v in values.values()):
                table = F.expr(f"array({', '.join(values.get(k, 'null') for k in numbers)})").cast(T.ArrayType(kind))
            else:
                table = F.array(*[as_column(values[k]) if k in values else F.lit(None).cast(kind) for k in numbers])
            flags = F.expr(f"array({', '.join('true' if k in values else 'false' for k in numbers)})")
            chain = F.struct(F.coalesce(F.get(flags, low.first), F.lit(False)).alias("applied"), F.get(table, low.first).alias("value"))
        else:
            for k, i in writers:
                part = outcome(True, as_column(low.lowered[k].values[i]))
                chain = F.when(effective[k], part) if chain is None else chain.when(effective[k], part)
            chain = chain.otherwise(nothing)
        parts.append(guarded(chain, nothing).alias(target))
    assign = F.struct(*parts) if parts else F.struct()
    fields = {
        "error": (failed if failed is not None else F.lit(None).cast("string")) if not (failed is not None and fail_on_error) else F.when(fine, F.lit(None).cast("string")),
        "matched": F.coalesce(guarded(matched, F.lit(False)), F.lit(False)),
        "matched_rule_ids": guarded(rule_ids, F.array().cast(_IDS)),
        "assign": assign,
    }
    if full_audit:
        audit = Audit(low)
        fields["matched_rules"] = guarded(audit.matched_rules(effective), F.array().cast(T.ArrayType(RULE_TRACE, False)))
        fields["assignment_results"] = guarded(audit.assignment_results(effective), F.array().cast(T.ArrayType(ASSIGNMENT_EVENT, False)))
    return df.select("*", *[c.alias(f"{prefix}_{n}") for n, c in fields.items()])


class _Equal:
    """Rule k took effect where the first match is k; built only where it is asked for."""

    def __init__(self, first: Column):
        self.first = first

    def __getitem__(self, k: int) -> Column:
        return self.first == k


def _constants(low: Lowering, writers: list[tuple[int, int]]) -> bool:
    """Whether all values of a target are literals, so that a lookup by rule number gives them."""
    from verdigris.model import Literal

    return all(isinstance(low.rules[k].assignments[i].value, Literal) for k, i in writers)
