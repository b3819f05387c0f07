"""Full-audit columns: traces of matched rules and the history of every assignment."""

from __future__ import annotations

import operator as py
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.expr import Val, text, trace_text
from verdigris.model import OPERANDS, AssignedRef, Call, FieldRef, Group, Literal, all_operands
from verdigris.plans.describe import assignment_text, condition_text
from verdigris.plans.lowering import TEMPORARY, Lowering, as_column, column

_S, _B, _L = T.StringType(), T.BooleanType(), T.LongType()
_NAMES = T.ArrayType(_S, False)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


#: The exact shapes of the audit columns.
OPERAND_TRACE = _struct(
    ("kind", _S, True), ("column", _S, True), ("target_field", _S, True), ("original_value", _S, True), ("value", _S, True), ("value_type", _S, True), ("default_if_null", _S, True), ("default_applied", _B, False),
    ("function_name", _S, True), ("produced_by_rule_id", _S, True), ("produced_by_assignment_id", _S, True), ("source_columns", _NAMES, True), ("arguments", T.MapType(_S, _S, True), True),
)
CONDITION_TRACE = _struct(
    ("condition_id", _S, False), ("condition_group_id", _S, False), ("condition_group_operator", _S, False), ("active_flag", _B, False), ("columns", _NAMES, True), ("left", OPERAND_TRACE, True), ("right", OPERAND_TRACE, True),
    ("operator", _S, True), ("comparison_result", _B, True), ("passed", _B, True), ("tolerance_abs", _S, True),
)
RULE_TRACE = _struct(("rule_id", _S, True), ("rule_name", _S, True), ("rule_order", _L, True), ("explanation", _S, True), ("assignments_applied", _NAMES, True), ("conditions", T.ArrayType(CONDITION_TRACE, False), True))
ASSIGNMENT_EVENT = _struct(
    ("assignment_id", _S, True), ("rule_id", _S, True), ("rule_name", _S, True), ("rule_order", _L, True), ("target_field", _S, True), ("authored_expression", _S, False), ("old_value", _S, True), ("proposed_value", _S, True),
    ("changed", _B, False), ("overridden_by_rule_id", _S, True), ("overridden_by_assignment_id", _S, True), ("effective", _B, False), ("final_winning_rule_id", _S, False), ("final_winning_assignment_id", _S, False),
)


def _text(value: Any) -> Column:
    return F.lit(value).cast("string")


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in dict.fromkeys(names)]) if names else F.array().cast(_NAMES)


def _columns(op: Any) -> list[str]:
    return [o.name for o in all_operands(op) if isinstance(o, FieldRef)]


def literal_text(value: Any) -> str | None:
    """The trace text of a literal."""
    from decimal import Decimal

    if value is None:
        return None
    if isinstance(value, Decimal):
        return format(value, "f")
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, dict):
        return ", ".join(f"{k}={literal_text(v)}" for k, v in value.items())
    if isinstance(value, list | tuple | set):
        return "[" + ", ".join(literal_text(v) or "" for v in (sorted(value, key=repr) if isinstance(value, set) else value)) + "]"
    return str(value)


class Audit:
    """Builds the audit columns of a lowered ruleset."""

    def __init__(self, lowering: Lowering):
        self.low = lowering

    def _value_text(self, v: Val, op: Any = None) -> Column:
        if v.is_literal:
            return _text(literal_text(v.value))
        return trace_text(v) if v.type is not None else _text(None)

    def _summary(self, value: Any, at: int) -> Column:
        """A resolved argument in few words."""
        if not isinstance(value, OPERANDS):
            return F.coalesce(self._value_text(self.low.argument(value, at)), F.lit("null"))
        v = self.low.operand(value, at)
        shown = F.coalesce(self._value_text(v), F.lit("null"))
        if isinstance(value, FieldRef):
            return F.concat(F.lit(f"{value.name}="), shown)
        if isinstance(value, AssignedRef):
            return F.concat(F.lit(f"assigned({value.target})="), shown)
        if isinstance(value, Literal):
            return shown
        args = self.low.registry.get_spec(value.function).bind_args(value.args)
        inner = [F.concat(F.lit(f"{k}="), self._summary(v, at)) for k, v in args.items()]
        return F.concat(F.lit(f"{value.function}("), F.concat_ws(", ", *inner), F.lit(")="), shown)

    def operand(self, op: Any, at: int, active: bool) -> Column:
        default = None if op.default is None else literal_text(op.default.value)
        before = value = _text(None)
        applied = F.lit(False)
        rule_id = assignment_id = arguments = None
        kind = {FieldRef: "field", AssignedRef: "assigned", Literal: "literal", Call: "custom_function"}[type(op)]
        if isinstance(op, Literal):
            before = value = _text(literal_text(op.value))
        if active:
            raw, full = self.low.raw(op, at), self.low.operand(op, at)
            before, value = self._value_text(raw), self._value_text(full)
            missing = F.lit(raw.value is None) if raw.is_literal else raw.col.isNull() if raw.type is not None else F.lit(True)
            applied = missing if op.default is not None else F.lit(False)
            if isinstance(op, AssignedRef):
                _, writers = self.low._last(op.target, at)
                for j, i in writers:
                    a, test = self.low.rules[j].assignments[i], F.col(f"{TEMPORARY}m{j}")
                    rule_id = F.when(test, self.low.rules[j].rule_id) if rule_id is None else rule_id.when(test, self.low.rules[j].rule_id)
                    assignment_id = F.when(test, a.assignment_id) if assignment_id is None else assignment_id.when(test, a.assignment_id)
            if isinstance(op, Call):
                args = self.low.registry.get_spec(op.function).bind_args(op.args)
                if args:
                    arguments = F.create_map(*[x for k, v in args.items() for x in (F.lit(k), self._summary(v, at))])
        fields = {
            "kind": F.lit(kind),
            "column": _text(op.name if isinstance(op, FieldRef) else None),
            "target_field": _text(op.target if isinstance(op, AssignedRef) else None),
            "original_value": before,
            "value": value,
            "value_type": _text(op.hint if isinstance(op, Literal) else None),
            "default_if_null": _text(default),
            "default_applied": applied,
            "function_name": _text(op.function if isinstance(op, Call) else None),
            "produced_by_rule_id": rule_id if rule_id is not None else _text(None),
            "produced_by_assignment_id": assignment_id if assignment_id is not None else _text(None),
            "source_columns": _names(_columns(op)),
            "arguments": arguments if arguments is not None else F.lit(None).cast("map<string,string>"),
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    def condition(self, group: Group, c: Any, at: int, passes: dict) -> Column:
        result, passed = passes[id(c)]
        fields = {
            "condition_id": F.lit(c.condition_id),
            "condition_group_id": F.lit(group.group_id),
            "condition_group_operator": F.lit(group.logic),
            "active_flag": F.lit(c.active),
            "columns": _names(_columns(c.left) + (_columns(c.right) if c.right is not None else [])),
            "left": self.operand(c.left, at, c.active),
            "right": self.operand(c.right, at, c.active) if c.right is not None else F.lit(None).cast(OPERAND_TRACE),
            "operator": F.lit(c.operator),
            "comparison_result": result if c.active else F.lit(None).cast("boolean"),
            "passed": passed,
            "tolerance_abs": _text(format(c.tolerance, "f") if c.tolerance else None),
        }
        return F.struct(*[x.alias(n) for n, x in fields.items()])

    def explanation(self, group: Group, passes: dict, nested: bool = False) -> tuple[Column, Column, Column]:
        """(passed, text of the passed branches or null, number of parts in it)."""
        parts = [(passes[id(c)][1], F.when(passes[id(c)][1], F.lit(condition_text(c)))) for c in group.conditions]
        for g in group.groups:
            passed, words, _ = self.explanation(g, passes, True)
            parts.append((passed, F.when(passed, words)))
        if not parts:
            return F.lit(group.logic == "all"), _text(None), F.lit(0)
        passed = reduce(py.and_ if group.logic == "all" else py.or_, [p for p, _ in parts])
        count = reduce(py.add, [w.isNotNull().cast("int") for _, w in parts])
        words = F.concat_ws(" AND " if group.logic == "all" else " OR ", *[w for _, w in parts])
        if nested:
            words = F.when(count > 1, F.concat(F.lit("("), words, F.lit(")"))).otherwise(words)
        return passed, F.when(passed & (count > 0), words), count

    def matched_rules(self, effective: dict[int, Column]) -> Column:
        traces = []
        for k, test in effective.items():
            low = self.low.lowered[k]
            conditions = [self.condition(g, c, k, low.passes) for g, c in low.rule.when.walk()]
            fields = {
                "rule_id": F.lit(low.rule.rule_id),
                "rule_name": F.lit(low.rule.rule_name),
                "rule_order": F.lit(low.rule.order).cast("bigint"),
                "explanation": self.explanation(low.rule.when, low.passes)[1],
                "assignments_applied": _names([a.target for a in low.rule.assignments]),
                "conditions": F.array(*conditions) if conditions else F.array().cast(T.ArrayType(CONDITION_TRACE, False)),
            }
            traces.append(F.when(test, F.struct(*[x.alias(n) for n, x in fields.items()]).cast(RULE_TRACE)))
        return F.array_compact(F.array(*traces)) if traces else F.array().cast(T.ArrayType(RULE_TRACE, False))

    def assignment_results(self, effective: dict[int, Column]) -> Column:
        events = []
        listed = [(k, i, a) for k in effective for i, a in enumerate(self.low.rules[k].assignments)]
        for at, (k, i, a) in enumerate(listed):
            rule, t = self.low.rules[k], self.low.typed.targets[a.target]
            later = [(j, b) for j, _, b in listed[at + 1 :] if b.target == a.target]
            next_rule = next_id = last_rule = last_id = None
            for j, b in later:
                next_rule = F.when(effective[j], self.low.rules[j].rule_id) if next_rule is None else next_rule.when(effective[j], self.low.rules[j].rule_id)
                next_id = F.when(effective[j], b.assignment_id) if next_id is None else next_id.when(effective[j], b.assignment_id)
            for j, b in reversed(later):
                last_rule = F.when(effective[j], self.low.rules[j].rule_id) if last_rule is None else last_rule.when(effective[j], self.low.rules[j].rule_id)
                last_id = F.when(effective[j], b.assignment_id) if last_id is None else last_id.when(effective[j], b.assignment_id)
            overridden = reduce(py.or_, [effective[j] for j, _ in later]) if later else F.lit(False)
            source = self.low.typed.source.get(a.target)
            input_value = column(a.target).cast(t) if source is not None else F.lit(None).cast(t)
            chain, _ = self.low._last(a.target, k)
            old = chain.otherwise(input_value) if chain is not None else input_value
            new = as_column(self.low.lowered[k].values[i])
            fields = {
                "assignment_id": F.lit(a.assignment_id),
                "rule_id": F.lit(rule.rule_id),
                "rule_name": F.lit(rule.rule_name),
                "rule_order": F.lit(rule.order).cast("bigint"),
                "target_field": F.lit(a.target),
                "authored_expression": F.lit(assignment_text(a)),
                "old_value": trace_text(Val(old, t)),
                "proposed_value": trace_text(Val(new, t)),
                "changed": ~old.eqNullSafe(new),
                "overridden_by_rule_id": next_rule if next_rule is not None else _text(None),
                "overridden_by_assignment_id": next_id if next_id is not None else _text(None),
                "effective": ~overridden,
                "final_winning_rule_id": F.coalesce(last_rule, F.lit(rule.rule_id)) if last_rule is not None else F.lit(rule.rule_id),
                "final_winning_assignment_id": F.coalesce(last_id, F.lit(a.assignment_id)) if last_id is not None else F.lit(a.assignment_id),
            }
            events.append(F.when(effective[k], F.struct(*[x.alias(n) for n, x in fields.items()]).cast(ASSIGNMENT_EVENT)))
        return F.array_compact(F.array(*events)) if events else F.array().cast(T.ArrayType(ASSIGNMENT_EVENT, False))


__all__ = ["ASSIGNMENT_EVENT", "Audit", "RULE_TRACE", "text"]
