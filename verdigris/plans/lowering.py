"""Rules as Spark columns.

Every operand becomes a typed value with its error as data, every condition a three-valued comparison, every rule
a match flag and an error. Rules that read assigned values sit in a later layer than the rules that
assign them; all else shares one layer. Which rules took effect follows from the first rule that stopped
the row or failed, so no rule waits for another one's columns.
"""

from __future__ import annotations

import operator as py
from collections.abc import Mapping
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.compare import compare
from verdigris.functions.expr import INTEGRAL, WIDE, Val, error, first_error, is_binary, is_integral, is_number, is_temporal, is_text, is_time, literal, not_finite, number, shown, text, trace_text
from verdigris.functions.registry import FunctionRegistry
from verdigris.functions.standard import EXACT_ARGUMENTS, STEPS, Unsupported, exact
from verdigris.functions.udf import guarded_udf
from verdigris.model import OPERANDS, Assignment, AssignedRef, Call, Condition, FieldRef, Group, Literal, Rule, all_operands, rule_operands
from verdigris.plans.describe import assignment_text, condition_text
from verdigris.plans.simple_sql import assigned_sql, group_sql
from verdigris.plans.typing import TypedRuleset

TEMPORARY = "__verdigris_"


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(x: Column | str) -> Column:
    """A column, given as such or as SQL text."""
    return F.expr(x) if isinstance(x, str) else x


def coerce(v: Val, t: T.DataType) -> tuple[Column, Column | None]:
    """The value as it is stored in a target of type ``t``, and why it can't be."""
    if v.type is None and isinstance(t, T.ArrayType) and v.items is not None:
        parts = [coerce(i, t.elementType) for i in v.items]
        return F.array(*[p[0] for p in parts]).cast(t), first_error(*[p[1] for p in parts])
    if v.type is None and isinstance(v.value if v.is_literal else None, Mapping) and isinstance(t, T.StructType):
        names = {str(k): x for k, x in v.value.items()}
        parts = [coerce(literal(names.get(f.name)), f.dataType) for f in t.fields]
        return F.struct(*[p[0].alias(f.name) for p, f in zip(parts, t.fields, strict=True)]).cast(t), first_error(*[p[1] for p in parts])
    if v.type is None:
        return F.lit(None).cast(t), None
    known = v.col.isNotNull()
    if is_text(t):
        return trace_text(v), None
    if is_integral(t):
        if v.type == t:
            return v.col, None
        if isinstance(v.type, T.BooleanType):
            return F.lit(None).cast(t), F.when(known, error("TypeError", "Boolean assignment values are not integers."))
        d = number(v)
        whole = d == F.floor(d)
        out = F.when(whole, d).try_cast(t)
        if is_integral(v.type) and INTEGRAL[type(v.type)] <= INTEGRAL[type(t)]:
            return v.col.cast(t), None
        lossy = error("ValueError", "Assignment value ", shown(v), " cannot be converted to an integer without losing its fractional component.")
        wide = error("OverflowError", "Assignment value ", shown(v), f" is outside the range for {t.simpleString()}.")
        return out, F.when(known & out.isNull(), F.when(F.coalesce(whole, F.lit(False)), wide).otherwise(lossy))
    if is_binary(t):
        out = v.col.try_cast("double") if not isinstance(v.type, T.BooleanType) else v.col.cast("int").cast("double")
        if is_integral(v.type) or isinstance(v.type, T.DecimalType | T.BooleanType):
            return out.cast(t), None
        bad = F.isnan(out) | (F.abs(out) == float("inf")) | out.isNull()
        return F.when(~bad, out).cast(t), F.when(known & bad, error("ValueError", "Floating-point assignment values must be finite."))
    if isinstance(t, T.DecimalType):
        d = number(v)
        out = d.try_cast(t)
        fits = F.coalesce(out == d, F.lit(False))
        if isinstance(v.type, T.DecimalType) and v.type.scale <= t.scale and v.type.precision - v.type.scale <= t.precision - t.scale:
            return v.col.cast(t), None
        return F.when(fits, out), F.when(known & ~fits, error("ValueError", "Assignment value ", shown(v), f" does not fit {t.simpleString()} without rounding or overflow."))
    if isinstance(t, T.BooleanType):
        if isinstance(v.type, T.BooleanType):
            return v.col, None
        word = F.lower(text(v)) if is_text(v.type) else F.lit(None).cast("string")
        out = F.when(word == "true", True).when(word == "false", False)
        return out, F.when(known & out.isNull(), error("TypeError", "Assignment value ", shown(v), " is not a boolean or a canonical 'true'/'false' string."))
    if is_temporal(t):
        if is_text(v.type):
            out = v.col.try_cast(t)
            return out, F.when(known & out.isNull(), error("ValueError", "Invalid isoformat string: ", shown(v)))
        return (v.col.cast(t) if is_temporal(v.type) else F.lit(None).cast(t)), None
    if isinstance(t, T.ArrayType) and isinstance(v.type, T.ArrayType):
        if v.type == t:
            return v.col, None
        item = v.type.elementType
        bad = None
        if coerce(Val(F.lit(None).cast(item), item), t.elementType)[1] is not None:
            bad = F.get(F.filter(F.transform(v.col, lambda x: coerce(Val(x, item), t.elementType)[1]), lambda e: e.isNotNull()), F.lit(0))
        return F.transform(v.col, lambda x: coerce(Val(x, item), t.elementType)[0]), bad
    if isinstance(t, T.StructType) and isinstance(v.type, T.StructType):
        has = {f.name: f.dataType for f in v.type.fields}
        parts = [coerce(Val(v.col.getField(f.name), has[f.name]), f.dataType) if f.name in has else (F.lit(None).cast(f.dataType), None) for f in t.fields]
        out = F.struct(*[p[0].alias(f.name) for p, f in zip(parts, t.fields, strict=True)])
        return F.when(known, out), first_error(*[F.when(known, p[1]) for p in parts if p[1] is not None])
    return v.col.cast(t), None


def unfused(name: str) -> Column:
    """Always null, and never part of whole-stage code.

    A projection of very many expressions becomes one method too long for the JIT when it is fused with its
    neighbours; on its own, its code is split into short methods. An expression that has no generated
    code, here a filter over an array made from the column ``name``, keeps the projection apart.
    """
    return F.get(F.filter(F.array(column(name).isNull().cast("int")), lambda x: x > 1), F.lit(0))


#: Conditions of one layer from which its projection is kept out of whole-stage code.
WIDE_LAYER = 40


@dataclass
class LoweredRule:
    rule: Rule
    match: Column | str  # never null
    error: Column | None
    values: list[Column | str]  # SQL text where that is enough
    passes: dict[int, tuple[Column, Column]] | None = None  # by id of the condition: (comparison, passed)


class Lowering:
    """Adds the columns of a typed ruleset to a DataFrame."""

    def __init__(self, typed: TypedRuleset, registry: FunctionRegistry | None, full_audit: bool, keep_traceback: bool = False):
        self.typed, self.registry, self.full_audit, self.keep_traceback = typed, registry, full_audit, keep_traceback
        self.rules = typed.rules
        self.lowered: dict[int, LoweredRule] = {}
        self.udfs: list[list[Column]] = []
        self._calls: dict[tuple[int, int], Val] = {}
        self._python_depth: dict[int, int] = {}
        self._count = 0
        self._stops: list[Column] = []

    # ---- operands

    def operand(self, op: Any, at: int) -> Val:
        """The value of an operand as rule ``at`` sees it, with its default."""
        raw = self.raw(op, at)
        if op.default is None:
            return raw
        return self._with_default(op, raw)

    def _with_default(self, op: Any, raw: Val) -> Val:
        default = self.literal(op.default, raw.type)
        if raw.type is None or raw.is_literal and raw.value is None:
            return default.failing(raw.err) if raw.err is not None else default
        if raw.is_literal:
            return raw
        if default.type is None and isinstance(raw.type, T.ArrayType):
            default = Val(F.array().cast(raw.type), raw.type)
        same = default.type == raw.type
        if not same:
            cast, _ = coerce(default, raw.type)
            default = Val(cast, raw.type)
        return Val(F.coalesce(raw.col, default.col.cast(raw.type)), raw.type, raw.err)

    def literal(self, op: Literal, beside: T.DataType | None = None) -> Val:
        t = self.typed.base_type(op)
        if op.value is None:
            return literal(None, t)
        found = literal(op.value, t if isinstance(op.value, Mapping | list | tuple | set) or t is None else None)
        if op.hint and t is not None and found.type != t and not isinstance(op.value, list | tuple | set | Mapping):
            return Val(found.col.cast(t), t, value=op.value)
        return found

    def raw(self, op: Any, at: int) -> Val:
        if isinstance(op, FieldRef):
            t = self.typed.source[op.name]
            return Val(column(op.name), None if isinstance(t, T.NullType) else t)
        if isinstance(op, Literal):
            return self.literal(op)
        if isinstance(op, AssignedRef):
            return self.state(op.target, at)
        return self.call(op, at)

    def state(self, target: str, at: int) -> Val:
        """The value last committed to ``target`` before rule ``at``."""
        t = self.typed.targets.get(target)
        chain, _ = self._last(target, at)
        return Val(chain if chain is not None else F.lit(None).cast(t or "string"), t)

    def _writers(self, target: str, before: int) -> list[tuple[int, int]]:
        return [(j, i) for j in range(before) for i, a in enumerate(self.rules[j].assignments) if a.target == target]

    def _last(self, target: str, at: int) -> tuple[Column | None, list[tuple[int, int]]]:
        writers = self._writers(target, at)[::-1]
        out = None
        for j, i in writers:
            test, value = F.col(f"{TEMPORARY}m{j}"), F.col(f"{TEMPORARY}v{j}_{i}")
            out = F.when(test, value) if out is None else out.when(test, value)
        return out, writers

    def argument(self, value: Any, at: int) -> Val:
        """A function argument; lists with operands in them keep their items."""
        if isinstance(value, OPERANDS):
            return self.operand(value, at)
        if isinstance(value, list | tuple | set) and any(isinstance(o, OPERANDS) for o in all_operands(value)):
            items = tuple(self.argument(v, at) for v in value)
            t = self.typed.argument_type(value)
            problems = first_error(*[i.err for i in items])
            if isinstance(t, T.ArrayType):
                return Val(F.array(*[i.col.cast(t.elementType) for i in items]), t, problems, items=items)
            return Val(F.lit(None), None, problems, items=items)
        return literal(value)

    def call(self, op: Call, at: int) -> Val:
        if (id(op), at) in self._calls:
            return self._calls[id(op), at]
        spec = self.registry.get_spec(op.function)
        bound = spec.bind_args(op.args)
        native = self.registry.native(op.function)
        args = {name: self.argument(value, at) for name, value in bound.items()}
        out = None
        if native is not None:
            depth = max((self._depth(v) for v in bound.values()), default=0)
            try:
                own = {name: self._exact_column(name, v, depth) if name in EXACT_ARGUMENTS.get(op.function, ()) and self._is_standard(op) else v for name, v in args.items()}
                named = any(own[n] is not args[n] for n in args)
                if self._is_standard(op) and op.function in STEPS:
                    first = depth + named
                    out = native(**own, bind=lambda level, col: self._named(col, first + level))
                    named += STEPS[op.function]
                else:
                    out = native(**own)
            except Unsupported:
                out = None
            if out is not None and (out.check is not None or named):
                value = self._named(out.col, depth + named)
                self._python_depth[id(op)] = depth + named + 1
                out = Val(value, out.type, first_error(out.err, out.check(value) if out.check else None))
        if out is None:
            out = self._python_call(op, bound, args, at)
        self._calls[id(op), at] = out
        return out

    def _is_standard(self, op: Call) -> bool:
        return self.registry.get_spec(op.function).implementation_reference == f"verdigris.functions.standard.{op.function}"

    def _named(self, col: Column, depth: int) -> Column:
        """The expression as a column of the layer ``depth``, computed once."""
        while len(self.udfs) <= depth:
            self.udfs.append([])
        self._count += 1
        name = f"{TEMPORARY}u{self._count}"
        self.udfs[depth].append(col.alias(name))
        return F.col(name)

    def _exact_column(self, label: str, v: Val, depth: int) -> Val:
        if v.is_literal or not (is_binary(v.type) or is_text(v.type)):
            return v
        value, bad = exact(v, label)
        failed = None if bad is None else F.when(v.col.isNotNull(), bad)
        return Val(self._named(value, depth), WIDE, first_error(v.err, failed))

    def _depth(self, value: Any) -> int:
        return max((self._python_depth.get(id(o), 0) for o in all_operands(value)), default=0)

    def _python_call(self, op: Call, bound: dict, args: dict[str, Val], at: int) -> Val:
        """One Arrow UDF column per call and row, in a layer below the columns that use it."""
        t = self.typed.call_type(op, self.typed.assigned) or T.StringType()
        udf, inputs = guarded_udf(self.registry.get_implementation(op.function), t, args, self.keep_traceback, self._unreached(at))
        depth = max((self._depth(v) for v in bound.values()), default=0)
        self._python_depth[id(op)] = depth + 1
        arguments_failed = first_error(*[a.err for a in args.values()])
        result = self._named(udf(*inputs), depth)
        return Val(result.getField("value"), t, first_error(arguments_failed, result.getField("error")))

    # ---- conditions

    def condition(self, c: Condition, at: int) -> tuple[Column, Column | None]:
        """(comparison result with nulls, error); an inactive condition is never true."""
        if not c.active:
            return F.lit(False), None
        left = self.operand(c.left, at)
        right = None if c.right is None else self.operand(c.right, at)
        result, bad = compare(left, c.operator, right, c.tolerance, c.error_on_null)
        failed = first_error(left.err, right.err if right is not None else None)
        return result, first_error(failed, bad) if failed is None or bad is None else F.coalesce(failed, bad)

    def group(self, group: Group, at: int, passes: dict) -> tuple[Column, list[Column]]:
        """(three-valued result, errors in order). Nulls act as false in and/or trees once the root is told so."""
        parts, errors = [], []
        for c in group.conditions:
            result, bad = self.condition(c, at)
            passes[id(c)] = (result, F.coalesce(result, F.lit(False)))
            parts.append(result)
            errors += [] if bad is None else [bad]
        for g in group.groups:
            result, bad = self.group(g, at, passes)
            parts.append(result)
            errors += bad
        if not parts:
            return F.lit(group.logic == "all"), errors
        return reduce(py.and_ if group.logic == "all" else py.or_, parts), errors

    def rule(self, k: int, apart: Column | None = None) -> LoweredRule:
        rule, passes = self.rules[k], {}
        plain = None if self.full_audit else group_sql(rule.when, self.typed.source)
        if plain is not None:
            match: Column | str = f"coalesce({plain}, false)"
            errors = []
            if apart is not None:
                match = F.coalesce(F.expr(plain), apart > 0, F.lit(False))
        else:
            result, errors = self.group(rule.when, k, passes)
            match = F.coalesce(result, *([apart > 0] if apart is not None else []), F.lit(False))
        values = []
        for a in rule.assignments:
            if (text_value := assigned_sql(a.value, self.typed.targets.get(a.target))) is not None:
                values.append(text_value)
                continue
            v = self.operand(a.value, k)
            t = self.typed.targets.get(a.target, T.StringType())
            stored, bad = coerce(v, t)
            values.append(stored.cast(t) if v.type is None else stored)
            failed = first_error(v.err, bad)
            if failed is not None:
                errors.append(F.when(as_column(match), failed))
        return LoweredRule(rule, match, first_error(*errors), values, passes)

    # ---- layers

    def strata(self) -> list[list[int]]:
        """Rules by layer: one past the rules that assign what a rule reads."""
        of: list[int] = []
        for k, rule in enumerate(self.rules):
            read = {o.target for o in rule_operands(rule, active_only=not self.full_audit) if isinstance(o, AssignedRef)}
            below = [of[j] for j in range(k) if any(a.target in read for a in self.rules[j].assignments)]
            of.append(1 + max(below) if below else 0)
        return [[k for k in range(len(of)) if of[k] == s] for s in range(max(of, default=-1) + 1)]

    def read_later(self) -> set[str]:
        return {o.target for r in self.rules for o in rule_operands(r, active_only=False) if isinstance(o, AssignedRef)}

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with a match flag and, where needed, an error and values of every rule."""
        later = self.read_later()
        strata = self.strata()
        if len(strata) == 1 and self._one_pass(df):
            return self._attached
        for number, members in enumerate(strata):
            calling = [k for k in members if self._calls_python(self.rules[k])]
            plain = [k for k in members if k not in calling]
            df = self._attach_rules(df, plain, later)
            if plain and (calling or number + 1 < len(strata)):
                # which rule has stopped a row so far is known before any Python function of a later rule runs
                if (stop := self._first_stop(plain)) is not None:
                    df = df.select("*", stop.alias(f"{TEMPORARY}s{number}"))
                    self._stops.append(F.col(f"{TEMPORARY}s{number}"))
            df = self._attach_rules(df, calling, later)
        return df

    def _attach_rules(self, df: DataFrame, members: list[int], later: set[str]) -> DataFrame:
        if not members:
            return df
        self.udfs = []
        made = []
        apart = (self.full_audit or self._conditions(members) >= WIDE_LAYER) and bool(df.columns)
        for k in members:
            low = self.rule(k, unfused(df.columns[0]) if apart and k == members[0] else None)
            self.lowered[k] = low
            made.append(as_column(low.match).alias(f"{TEMPORARY}m{k}"))
            if low.error is not None:
                made.append(low.error.alias(f"{TEMPORARY}e{k}"))
                low.error = F.col(f"{TEMPORARY}e{k}")
            for i, a in enumerate(low.rule.assignments):
                if a.target in later or self.full_audit:
                    made.append(as_column(low.values[i]).alias(f"{TEMPORARY}v{k}_{i}"))
                    low.values[i] = F.col(f"{TEMPORARY}v{k}_{i}")
            low.match = F.col(f"{TEMPORARY}m{k}")
        for layer in self.udfs:
            df = df.select("*", *layer)
        return df.select("*", *made)

    def _calls_python(self, rule: Rule) -> bool:
        operands = rule_operands(rule, active_only=not self.full_audit)
        return any(isinstance(o, Call) and self.registry.native(o.function) is None for root in operands for o in all_operands(root))

    def _first_stop(self, members: list[int]) -> Column | None:
        """The first of these rules that stopped the row or failed."""
        ends = []
        for k in sorted(members):
            low = self.lowered[k]
            test = [t for t in (low.error.isNotNull() if low.error is not None else None, low.match if low.rule.stop_on_match else None) if t is not None]
            if test:
                ends.append(F.when(reduce(py.or_, test), F.lit(k)))
        return F.coalesce(*ends) if ends else None

    def _unreached(self, at: int) -> Column | None:
        """Whether a rule before ``at`` is known to have stopped the row."""
        if not self._stops:
            return None
        return F.coalesce((F.least(*self._stops) if len(self._stops) > 1 else self._stops[0]) < at, F.lit(False))

    def _one_pass(self, df: DataFrame) -> bool:
        """First-match rulesets whose rules can't fail need no flags: the first match's number says it all."""
        stops = all(r.stop_on_match for r in self.rules[:-1])
        if self.full_audit or not stops or len(self.rules) < 2:
            return False
        self.udfs = []
        lowered = [self.rule(k) for k in range(len(self.rules))]
        self.lowered = dict(enumerate(lowered))
        if self.udfs or any(low.error is not None for low in lowered):
            # the rules are lowered again, layer by layer: nothing of this attempt may be referred to
            self.lowered, self._calls, self._python_depth = {}, {}, {}
            return False
        # chunks keep each generated method small
        chunks = []
        for low in range(0, len(lowered), 20):
            part = list(enumerate(lowered[low : low + 20], low))
            if all(isinstance(r.match, str) for _, r in part):
                chunks.append(F.expr("coalesce(" + ", ".join(f"CASE WHEN {r.match} THEN {k} END" for k, r in part) + ")"))
            else:
                chunks.append(F.coalesce(*[F.when(as_column(r.match), F.lit(k)) for k, r in part]))
        wide = self._conditions(range(len(lowered))) >= WIDE_LAYER and bool(df.columns)
        self._attached = df.select("*", F.coalesce(*chunks, *([unfused(df.columns[0])] if wide else [])).alias(f"{TEMPORARY}first"))
        self.first = F.col(f"{TEMPORARY}first")
        return True

    first: Column | None = None

    def _conditions(self, members) -> int:
        return sum(1 for k in members for _ in self.rules[k].when.walk())

    # ---- results

    def stopped_at(self) -> Column | None:
        """The first rule that stopped the row or failed."""
        return self._first_stop(list(self.lowered))

    def outcome_type(self) -> T.StructType:
        return T.StructType([T.StructField(t, T.StructType([T.StructField("applied", T.BooleanType(), False), T.StructField("value", kind, True)]), False) for t, kind in self.typed.targets.items()])


def outcome(applied: bool, value: Column) -> Column:
    return F.struct(F.lit(applied).alias("applied"), value.alias("value"))


__all__ = ["Assignment", "Decimal", "LoweredRule", "Lowering", "assignment_text", "coerce", "column", "condition_text", "is_number", "is_time", "not_finite", "replace"]
