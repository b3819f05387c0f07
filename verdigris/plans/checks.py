"""Checks of a ruleset that need no schema; each has a stable name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping
from decimal import Decimal
from typing import Any

from verdigris.errors import RegistryError
from verdigris.functions.registry import SEQUENCE_HINTS, FunctionRegistry
from verdigris.model import OPERANDS, OPERATORS, PAIRED, TOLERANT, UNARY, AssignedRef, Call, Condition, FieldRef, Group, Literal, Rule, Ruleset, ValidationResult, all_operands, inner_operands, rule_operands

Finding = tuple[str, str, str, Any]


def _text(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _flag(value: Any) -> bool:
    return isinstance(value, bool)


def _whole(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _when(bad: bool, check: str, message: str, kind: str, name: Any) -> Iterator[Finding]:
    if bad:
        yield check, message, kind, name


def _repeats(pairs: Iterator[tuple[Any, str]], check: str, what: str, kind: str) -> Iterator[Finding]:
    seen = set()
    for value in pairs:
        if not isinstance(value, str | int):
            continue
        if value in seen:
            yield check, f"{what} {value!r} is used more than once.", kind, value
        seen.add(value)


def _ruleset(r: Ruleset) -> Iterator[Finding]:
    for name, check in (("ruleset_id", "RULESET_ID_INVALID"), ("ruleset_name", "RULESET_NAME_INVALID"), ("owner", "RULESET_OWNER_REQUIRED"), ("owner_department", "RULESET_OWNER_DEPARTMENT_REQUIRED")):
        yield from _when(not _text(getattr(r, name)), check, f"{name} must be a non-empty string.", "ruleset", r.ruleset_id)
    yield from _when(not r.rules, "RULESET_RULE_REQUIRED", "A ruleset needs at least one rule.", "ruleset", r.ruleset_id)
    yield from _when(bool(r.rules) and not any(x.active is True for x in r.rules), "RULESET_ACTIVE_RULE_REQUIRED", "A ruleset needs at least one active rule.", "ruleset", r.ruleset_id)
    yield from _repeats((x.rule_id for x in r.rules), "RULE_ID_DUPLICATE", "rule_id", "rule")
    yield from _repeats((x.order for x in r.rules if _whole(x.order)), "RULE_ORDER_DUPLICATE", "rule_order", "rule")
    groups = [g for x in r.rules if isinstance(x.when, Group) for g in x.when.all_groups()]
    yield from _repeats((g.group_id for g in groups), "CONDITION_GROUP_ID_DUPLICATE", "condition_group_id", "condition_group")
    yield from _repeats((c.condition_id for g in groups for c in g.conditions), "CONDITION_ID_DUPLICATE", "condition_id", "condition")
    yield from _repeats((a.assignment_id for x in r.rules for a in x.assignments), "ASSIGNMENT_ID_DUPLICATE", "assignment_id", "assignment")


def _producers(r: Ruleset) -> Iterator[Finding]:
    made: set[str] = set()
    for rule in sorted((x for x in r.rules if x.active is True and _whole(x.order)), key=lambda x: x.order):
        if isinstance(rule.when, Group):
            for operand in rule_operands(rule):
                if isinstance(operand, AssignedRef) and _text(operand.target) and operand.target not in made:
                    yield "ASSIGNED_VALUE_PRIOR_PRODUCER_REQUIRED", f"Assigned value {operand.target!r} must be produced by an active rule with a lower rule_order.", "rule", rule.rule_id
        made |= {a.target for a in rule.assignments if isinstance(a.target, str)}


def _rule(rule: Rule, registry: FunctionRegistry | None) -> Iterator[Finding]:
    name = rule.rule_id
    for ok, check, what in (
        (_text(rule.rule_id), "RULE_ID_INVALID", "rule_id must be a non-empty string."),
        (_text(rule.rule_name), "RULE_NAME_INVALID", "rule_name must be a non-empty string."),
        (_whole(rule.order), "RULE_ORDER_INVALID", "rule_order must be an integer."),
        (_flag(rule.active), "RULE_ACTIVE_FLAG_INVALID", "active_flag must be a boolean."),
        (_flag(rule.stop_on_match), "RULE_STOP_ON_MATCH_INVALID", "stop_on_match must be a boolean."),
        (isinstance(rule.when, Group), "RULE_CONDITION_GROUP_INVALID", "A rule needs a condition group."),
        (bool(rule.assignments), "RULE_ASSIGNMENT_REQUIRED", "A rule needs at least one assignment."),
    ):
        yield from _when(not ok, check, what, "rule", name)
    yield from _repeats((a.target for a in rule.assignments), "ASSIGNMENT_TARGET_DUPLICATE_WITHIN_RULE", "target_field", "assignment")
    for a in rule.assignments:
        yield from _when(not _text(a.assignment_id), "ASSIGNMENT_ID_INVALID", "assignment_id must be a non-empty string.", "assignment", a.assignment_id)
        yield from _when(not _text(a.target), "ASSIGNMENT_TARGET_FIELD_INVALID", "target_field must be a non-empty string.", "assignment", a.assignment_id)
        yield from _operand(a.value, registry, "assignment", a.assignment_id)
    for group in rule.when.all_groups() if isinstance(rule.when, Group) else ():
        yield from _when(not _text(group.group_id), "CONDITION_GROUP_ID_INVALID", "condition_group_id must be a non-empty string.", "condition_group", group.group_id)
        yield from _when(group.logic not in ("all", "any"), "LOGICAL_OPERATOR_INVALID", "A group is all or any.", "condition_group", group.group_id)
        yield from _when(not group.conditions and not group.groups, "CONDITION_GROUP_EMPTY", "A group needs at least one member.", "condition_group", group.group_id)
        for condition in group.conditions:
            yield from _condition(condition, registry)


def _condition(c: Condition, registry: FunctionRegistry | None) -> Iterator[Finding]:
    at = ("condition", c.condition_id)
    known, tolerance = c.operator in OPERATORS, c.tolerance
    numeric = isinstance(tolerance, Decimal) and tolerance.is_finite()
    yield from _when(not _text(c.condition_id), "CONDITION_ID_INVALID", "condition_id must be a non-empty string.", *at)
    yield from _when(not known, "CONDITION_OPERATOR_INVALID", "operator must be a comparison operator.", *at)
    if not numeric:
        yield "TOLERANCE_INVALID", "tolerance_abs must be a finite Decimal.", *at
    elif tolerance < 0:
        yield "TOLERANCE_NEGATIVE", "tolerance_abs must be non-negative.", *at
    elif tolerance and known and c.operator not in TOLERANT:
        yield "BETWEEN_TOLERANCE_FORBIDDEN" if c.operator in PAIRED else "TOLERANCE_OPERATOR_FORBIDDEN", f"tolerance_abs must be 0 for {c.operator} operators.", *at
    yield from _when(not _flag(c.error_on_null), "ERROR_ON_NULL_INVALID", "error_on_null must be a boolean.", *at)
    yield from _when(not _flag(c.active), "CONDITION_ACTIVE_FLAG_INVALID", "active_flag must be a boolean.", *at)
    yield from _when(c.error_on_null is True and c.operator in UNARY, "ERROR_ON_NULL_UNARY_FORBIDDEN", "error_on_null is not valid for is_null or is_not_null.", *at)
    yield from _operand(c.left, registry, *at)
    if c.right is not None:
        yield from _operand(c.right, registry, *at)
    if not known:
        return
    yield from _when(c.operator in UNARY and c.right is not None, "UNARY_OPERATOR_RIGHT_FORBIDDEN", f"Operator {c.operator} must not define a right operand.", *at)
    yield from _when(c.operator not in UNARY and c.right is None, "BINARY_OPERATOR_RIGHT_REQUIRED", f"Operator {c.operator} requires a right operand.", *at)
    if isinstance(c.right, Literal):
        value, shape = c.right.value, OPERATORS[c.operator]
        yield from _when(shape == "collection" and not isinstance(value, list | tuple | set), "IN_OPERATOR_COLLECTION_REQUIRED", f"Operator {c.operator} requires a collection literal on the right side.", *at)
        yield from _when(shape == "pair" and not (isinstance(value, list | tuple) and len(value) == 2), "BETWEEN_OPERATOR_PAIR_REQUIRED", f"Operator {c.operator} requires exactly two literal values.", *at)


def _collides(value: Any) -> bool:
    if isinstance(value, Literal):
        return _collides(value.value)
    if isinstance(value, Call):
        return _collides(value.args)
    if isinstance(value, Mapping):
        return len({str(k) for k in value}) < len(value) or any(map(_collides, value.values()))
    return isinstance(value, list | tuple | set) and any(map(_collides, value))


def _operand(root: Any, registry: FunctionRegistry | None, kind: str, name: Any) -> Iterator[Finding]:
    if not isinstance(root, OPERANDS):
        yield "OPERAND_INVALID", "An operand must be a field, an assigned value, a literal or a function call.", kind, name
        return
    yield from _when(_collides(root), "MAPPING_KEY_NORMALIZATION_COLLISION", "Two mapping keys have one text.", kind, name)
    for operand in all_operands(root):
        if operand.default is not None:
            yield from _when(not isinstance(operand.default, Literal), "DEFAULT_IF_NULL_INVALID", "default_if_null must be a literal.", kind, name)
            yield from _when(isinstance(operand.default, Literal) and operand.default.value is None, "DEFAULT_IF_NULL_NULL_FORBIDDEN", "default_if_null cannot be null.", kind, name)
        if isinstance(operand, FieldRef):
            yield from _when(not _text(operand.name), "FIELD_NAME_INVALID", "field must be a non-empty string.", kind, name)
        elif isinstance(operand, AssignedRef):
            yield from _when(not _text(operand.target), "ASSIGNED_TARGET_FIELD_INVALID", "assigned must be a non-empty string.", kind, name)
        elif isinstance(operand, Literal):
            yield from _when(operand.hint is not None and not _text(operand.hint), "LITERAL_VALUE_TYPE_INVALID", "value_type must be a non-empty string when provided.", kind, name)
        else:
            yield from _call(operand, registry, kind, name)


def _call(call: Call, registry: FunctionRegistry | None, kind: str, name: Any) -> Iterator[Finding]:
    yield from _when(not _text(call.function), "CUSTOM_FUNCTION_NAME_INVALID", "A function name must be a non-empty string.", kind, name)
    yield from _when(not all(map(_text, call.args)), "CUSTOM_FUNCTION_ARG_NAME_INVALID", "Argument names must be non-empty strings.", kind, name)
    if registry is None:
        yield "CUSTOM_FUNCTION_REGISTRY_REQUIRED", "A function registry is required where functions are used.", kind, name
        return
    if not registry.has_spec(call.function):
        yield "CUSTOM_FUNCTION_UNKNOWN", f"Unknown custom function: {call.function}", kind, name
        return
    spec = registry.get_spec(call.function)
    yield from _when(not spec.active, "CUSTOM_FUNCTION_INACTIVE", f"Custom function is inactive: {call.function}", kind, name)
    yield from _when(kind == "assignment" and not spec.allowed_in_assignment, "CUSTOM_FUNCTION_ASSIGNMENT_FORBIDDEN", f"Custom function is not allowed in assignments: {call.function}", kind, name)
    yield from _when(kind != "assignment" and not spec.allowed_in_condition, "CUSTOM_FUNCTION_CONDITION_FORBIDDEN", f"Custom function is not allowed in conditions: {call.function}", kind, name)
    try:
        args = spec.bind_args(call.args)
    except RegistryError as exc:
        yield "CUSTOM_FUNCTION_ARGS_MISMATCH", str(exc), kind, name
        args = {k: v for k, v in call.args.items() if k in {a.name for a in spec.arguments}}
    for key, value in args.items():
        arg = spec.argument(key)
        static, effective = static_value(value)
        where = f"Argument {key!r} for {call.function!r}"
        yield from _when(arg.literal_only and not static, "CUSTOM_FUNCTION_ARG_LITERAL_REQUIRED", f"{where} must be a literal value.", kind, name)
        fits = effective is None and not arg.required or fits_hint(effective if static else value, arg.type_hint)
        yield from _when(not fits, "CUSTOM_FUNCTION_ARG_TYPE_MISMATCH", f"{where} must have type {arg.type_hint!r}.", kind, name)
        allowed = arg.allowed_values is None or not static or effective in arg.allowed_values
        yield from _when(not allowed, "CUSTOM_FUNCTION_ARG_VALUE_INVALID", f"{where} has a value outside its allowed values.", kind, name)


def static_value(value: Any) -> tuple[bool, Any]:
    """(whether an argument holds literals only, the plain value then)."""
    if isinstance(value, Literal):
        return static_value(value.default.value if value.value is None and value.default is not None else value.value)
    if isinstance(value, OPERANDS):
        return False, None
    if isinstance(value, Mapping):
        parts = {k: static_value(v) for k, v in value.items()}
        return all(p[0] for p in parts.values()), {k: p[1] for k, p in parts.items()}
    if isinstance(value, list | tuple | set):
        parts = [static_value(v) for v in value]
        return all(p[0] for p in parts), type(value)(p[1] for p in parts) if all(p[0] for p in parts) else None
    return True, value


_HINT_TESTS: dict[str, Callable[[Any], bool]] = {
    "any": lambda v: True,
    "string": lambda v: isinstance(v, str),
    "boolean": _flag,
    "integer": _whole,
    "number": lambda v: isinstance(v, int | float | Decimal) and not isinstance(v, bool),
    "date": lambda v: isinstance(v, dt.date) and not isinstance(v, dt.datetime),
    "timestamp": lambda v: isinstance(v, dt.datetime),
    "mapping": lambda v: isinstance(v, Mapping),
}
_ITEM_HINTS = dict(zip(SEQUENCE_HINTS, ("any", "string", "integer", "date"), strict=True))


def fits_hint(value: Any, hint: str) -> bool:
    """Whether what is known of an argument allows its hint; operands are checked against the schema later."""
    if isinstance(value, Literal):
        return fits_hint(value.value, hint)
    if isinstance(value, OPERANDS):
        return True
    if hint in _ITEM_HINTS:
        return isinstance(value, list | tuple | set) and all(v is None or fits_hint(v, _ITEM_HINTS[hint]) for v in value)
    return value is not None and _HINT_TESTS[hint](value) or hint == "any"


def check_ruleset(ruleset: Ruleset, registry: FunctionRegistry | None = None) -> ValidationResult:
    """All findings of the checks that need no schema."""
    result = ValidationResult()
    findings = [*_ruleset(ruleset), *_producers(ruleset)]
    for rule in ruleset.rules:
        findings += _rule(rule, registry)
    for check, message, kind, name in findings:
        result.add(check, message, kind, name)
    return result


__all__ = ["check_ruleset", "fits_hint", "inner_operands", "static_value"]
