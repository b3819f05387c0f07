"""Rulesets as immutable trees, and validation results."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

#: Comparison operators, by the shape of their right side.
OPERATORS = {
    "eq": "any", "ne": "any", "gt": "any", "ge": "any", "lt": "any", "le": "any", "in": "collection", "not_in": "collection", "between": "pair",
    "not_between": "pair", "like": "any", "not_like": "any", "contains": "any", "not_contains": "any", "starts_with": "any", "ends_with": "any", "is_null": "none", "is_not_null": "none",
}
#: Operators that accept an absolute tolerance.
TOLERANT = {"eq", "ne", "gt", "ge", "lt", "le", "in", "not_in"}
UNARY = {"is_null", "is_not_null"}
PAIRED = {"between", "not_between"}
MEMBERSHIP = {"in", "not_in"}
#: Type hints of literals and arguments, by their canonical name.
HINTS = {
    "str": "string", "string": "string", "int": "integer", "integer": "integer", "long": "integer", "decimal": "decimal", "double": "double", "float": "double",
    "number": "double", "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz",
}


@dataclass(frozen=True)
class Literal:
    value: Any
    hint: str | None = None
    default: Literal | None = None


@dataclass(frozen=True)
class FieldRef:
    name: str
    default: Literal | None = None


@dataclass(frozen=True)
class AssignedRef:
    target: str
    default: Literal | None = None


@dataclass(frozen=True)
class Call:
    function: str
    args: Mapping[str, Any] = field(default_factory=dict)
    default: Literal | None = None


Operand = Literal | FieldRef | AssignedRef | Call
OPERANDS = (Literal, FieldRef, AssignedRef, Call)


@dataclass(frozen=True)
class Condition:
    condition_id: str
    left: Operand
    operator: str
    right: Operand | None = None
    tolerance: Decimal = Decimal(0)
    error_on_null: bool = False
    active: bool = True


@dataclass(frozen=True)
class Group:
    group_id: str
    logic: str
    conditions: tuple[Condition, ...] = ()
    groups: tuple[Group, ...] = ()

    def walk(self) -> Iterator[tuple[Group, Condition]]:
        """Conditions in the order of evaluation: a group's own before those of its nested groups."""
        for condition in self.conditions:
            yield self, condition
        for group in self.groups:
            yield from group.walk()

    def all_groups(self) -> Iterator[Group]:
        yield self
        for group in self.groups:
            yield from group.all_groups()


@dataclass(frozen=True)
class Assignment:
    assignment_id: str
    target: str
    value: Operand


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_name: str
    order: int
    when: Group
    assignments: tuple[Assignment, ...]
    active: bool = True
    stop_on_match: bool = False
    description: str | None = None


@dataclass(frozen=True)
class Ruleset:
    ruleset_id: str
    ruleset_name: str
    version: str
    rules: tuple[Rule, ...]
    description: str | None = None
    owner: str | None = None
    owner_department: str | None = None

    def active_rules(self) -> list[Rule]:
        return sorted((r for r in self.rules if r.active), key=lambda r: r.order)


def inner_operands(value: Any) -> Iterator[Operand]:
    """Operands that stand in an argument, at any depth of lists and mappings; a call is not entered."""
    if isinstance(value, OPERANDS):
        yield value
    elif isinstance(value, Mapping):
        for item in value.values():
            yield from inner_operands(item)
    elif isinstance(value, list | tuple | set | frozenset):
        for item in value if not isinstance(value, set | frozenset) else sorted(value, key=repr):
            yield from inner_operands(item)


def all_operands(value: Any) -> Iterator[Operand]:
    """Like :func:`inner_operands`, with the operands inside calls after the call itself."""
    for operand in inner_operands(value):
        yield operand
        if isinstance(operand, Call):
            for item in operand.args.values():
                yield from all_operands(item)


def rule_operands(rule: Rule, active_only: bool = True) -> Iterator[Operand]:
    """Every operand a rule can evaluate, in order."""
    for _, condition in rule.when.walk():
        if condition.active or not active_only:
            yield from all_operands(condition.left)
            if condition.right is not None:
                yield from all_operands(condition.right)
    for assignment in rule.assignments:
        yield from all_operands(assignment.value)


def required_columns(ruleset: Ruleset, with_targets: bool = False) -> list[str]:
    """Input columns the active rules read, in the order of evaluation."""
    names: dict[str, None] = {}
    for rule in ruleset.active_rules():
        names |= {o.name: None for o in rule_operands(rule) if isinstance(o, FieldRef)}
        if with_targets:
            names |= {a.target: None for a in rule.assignments}
    return list(names)


@dataclass(frozen=True)
class Issue:
    check_name: str
    message: str
    object_type: str
    object_id: str
    details: dict | None = None


@dataclass
class ValidationResult:
    issues: list[Issue] = field(default_factory=list)

    def add(self, check: str, message: str, kind: str, name: Any, **details: Any) -> None:
        self.issues.append(Issue(check, message, kind, str(name), details or None))

    @property
    def passed(self) -> bool:
        return not self.issues

    def names(self) -> list[str]:
        return [i.check_name for i in self.issues]

    def to_text(self) -> str:
        if self.passed:
            return "Validation passed with no issues."
        lines = [f"[ERROR] {i.check_name}: {i.message}" + (f" | details={i.details}" if i.details else "") for i in self.issues]
        return "\n".join([f"Validation failed with {len(lines)} issue(s):", *lines])
