"""Rulesets back into documents: YAML text, canonical JSON and its hash.

One generic writer walks the tree; :data:`LAYOUT` says how each kind of node is laid out.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from decimal import Decimal
from pathlib import Path
from typing import Any

import yaml

from verdigris.model import OPERANDS, Assignment, AssignedRef, Call, Condition, FieldRef, Group, Literal, Rule, Ruleset, all_operands
from verdigris.sources.ruleset_yaml import TUPLE_TAG, compile_payload

#: The keys of a typed envelope in stored JSON.
TYPE_KEY, VALUE_KEY = "$type", "value"


def _default(value: Literal) -> Any:
    return to_plain(value) if value.hint is not None or isinstance(value.value, Mapping) else to_plain(value.value)


#: Per kind of node: (key, value of the node, whether an absent value leaves the key out).
LAYOUT: dict[type, Callable[[Any], list[tuple[str, Any, bool]]]] = {
    Ruleset: lambda r: [("ruleset_id", r.ruleset_id, False), ("ruleset_name", r.ruleset_name, False), ("version", r.version, False), ("description", r.description, True), ("owner", r.owner, True), ("owner_department", r.owner_department, True), ("rules", list(r.rules), False)],
    Rule: lambda r: [("rule_id", r.rule_id, False), ("rule_name", r.rule_name, False), ("rule_order", r.order, False), ("active_flag", r.active, False), ("stop_on_match", r.stop_on_match, False), ("description", r.description, True), ("when", r.when, False), ("assign", list(r.assignments), False)],
    Group: lambda g: [("condition_group_id", g.group_id, False), (g.logic, [*g.conditions, *g.groups], False)],
    Condition: lambda c: [("condition_id", c.condition_id, False), ("left", c.left, False), ("operator", c.operator, False), ("right", c.right, True), ("tolerance_abs", format(c.tolerance, "f"), False), ("error_on_null", c.error_on_null or None, True), ("active_flag", c.active, False)],
    Assignment: lambda a: [("assignment_id", a.assignment_id, False), ("target_field", a.target, False), ("value", a.value, False)],
    FieldRef: lambda o: [("field", o.name, False), ("default_if_null", o.default, True)],
    AssignedRef: lambda o: [("assigned", o.target, False), ("default_if_null", o.default, True)],
    Literal: lambda o: [("literal", o.value, False), ("value_type", o.hint, True), ("default_if_null", o.default, True)],
    Call: lambda o: [("custom_function", {"name": o.function, "args": dict(o.args)}, False), ("default_if_null", o.default, True)],
}


def to_plain(node: Any) -> Any:
    """A node, and all below it, as mappings, lists and scalars."""
    if type(node) in LAYOUT:
        out = {}
        for key, value, leave_out in LAYOUT[type(node)](node):
            if value is None and leave_out:
                continue
            out[key] = _default(value) if key == "default_if_null" else to_plain(value)
        return out
    if isinstance(node, Mapping):
        texts = [str(k) for k in node]
        if len(set(texts)) < len(texts):
            raise ValueError(f"Mapping keys {sorted(map(repr, node))} don't stay apart as text.")
        return {str(k): to_plain(v) for k, v in node.items()}
    if isinstance(node, list | tuple | set):
        return type(node)(to_plain(v) for v in node)
    return node


class _Dumper(yaml.SafeDumper):
    """Safe dumper with exact decimals."""


_Dumper.add_representer(Decimal, lambda d, v: d.represent_scalar("tag:yaml.org,2002:float", text if "." in (text := format(v, "f")) else f"{text}.0"))


def export_yaml(ruleset: Ruleset, path: str | Path | None = None, tuple_tag: str = TUPLE_TAG) -> str:
    """YAML text of a ruleset, also written to ``path`` if given."""
    dumper = type("_TaggedDumper", (_Dumper,), {})
    dumper.add_representer(tuple, lambda d, v: d.represent_sequence(tuple_tag, v))
    text = yaml.dump(to_plain(ruleset), Dumper=dumper, sort_keys=False, allow_unicode=True)
    if path is not None:
        Path(path).write_text(text, encoding="utf-8")
    return text


# ---- canonical JSON


@dataclass(frozen=True)
class Wrapped:
    """A kind of value that JSON lacks: what it holds inside its envelope, and how it is made from that again."""

    holds: type
    inside: Callable[[Any], Any]
    outside: Callable[[Any], Any]


#: By the name in the envelope.
WRAPPED = {
    "date": Wrapped(str, dt.date.isoformat, dt.date.fromisoformat),
    "datetime": Wrapped(str, dt.datetime.isoformat, dt.datetime.fromisoformat),
    "tuple": Wrapped(list, list, tuple),
    "set": Wrapped(list, list, set),
    "mapping": Wrapped(dict, dict, dict),
}
_KINDS = {dt.datetime: "datetime", dt.date: "date", tuple: "tuple", set: "set", frozenset: "set"}


class CanonicalJson:
    """Sorted JSON without blanks that keeps decimals exact and puts what JSON lacks into envelopes.

    An envelope is an object of just ``type_key`` and ``value_key``. Documents written elsewhere may use other keys.
    """

    def __init__(self, type_key: str = TYPE_KEY, value_key: str = VALUE_KEY):
        self.type_key, self.value_key = type_key, value_key

    def write(self, value: Any) -> str:
        if isinstance(value, float | Decimal) and not math.isfinite(value):
            raise ValueError(f"{value} can't be stored: a number must be finite.")
        if isinstance(value, Decimal):
            text = str(value)
            return text if set(text) & set(".eE") else text + "e0"  # stays a fraction when read again
        kind = _KINDS.get(type(value), "mapping" if isinstance(value, Mapping) and self.type_key in value else None)
        if kind is not None:
            body = self._body(WRAPPED[kind].inside(value), sort=kind == "set")
            return f'{{"{self.type_key}":"{kind}","{self.value_key}":{body}}}'
        return self._body(value)

    def _body(self, value: Any, sort: bool = False) -> str:
        if isinstance(value, Mapping):
            return "{" + ",".join(f"{json.dumps(k)}:{self.write(v)}" for k, v in sorted((str(k), v) for k, v in value.items())) + "}"
        if isinstance(value, list):
            items = [self.write(v) for v in value]
            return "[" + ",".join(sorted(items) if sort else items) + "]"
        return json.dumps(value)

    def read(self, text: str) -> Any:
        return self._opened(json.loads(text, parse_float=Decimal))

    def _opened(self, value: Any) -> Any:
        if isinstance(value, list):
            return [self._opened(v) for v in value]
        if not isinstance(value, dict):
            return value
        if value.keys() != {self.type_key, self.value_key}:
            return {k: self._opened(v) for k, v in value.items()}
        kind, body = value[self.type_key], value[self.value_key]
        wrapped = WRAPPED.get(kind) if isinstance(kind, str) else None
        try:
            if wrapped is None or not isinstance(body, wrapped.holds):
                raise TypeError(f"{type(body).__name__} in it")
            # the members of a mapping are opened one by one: as a whole it may look like an envelope again
            return wrapped.outside({k: self._opened(v) for k, v in body.items()} if wrapped.holds is dict else self._opened(body))
        except (TypeError, ValueError) as exc:
            raise ValueError(f"No value of kind {kind!r} in a stored envelope: {exc}") from exc


def canonical_json(value: Any, type_key: str = TYPE_KEY) -> str:
    """See :class:`CanonicalJson`."""
    return CanonicalJson(type_key).write(value)


def payload_json(ruleset: Ruleset, type_key: str = TYPE_KEY) -> str:
    """The stored document of a ruleset."""
    return canonical_json(to_plain(ruleset), type_key)


def content_hash(ruleset: Ruleset, type_key: str = TYPE_KEY) -> str:
    """SHA-256 of the stored document."""
    return hashlib.sha256(payload_json(ruleset, type_key).encode()).hexdigest()


def read_payload(text: str, type_key: str = TYPE_KEY) -> Ruleset:
    """A ruleset from its stored document."""
    return compile_payload(CanonicalJson(type_key).read(text))


def summary_counts(ruleset: Ruleset) -> dict[str, int]:
    """Counts of rules, conditions, assignments and function calls at any depth."""
    conditions = [c for r in ruleset.rules for _, c in r.when.walk()]
    roots = [o for c in conditions for o in (c.left, c.right) if o is not None] + [a.value for r in ruleset.rules for a in r.assignments]
    return {
        "rule_count": len(ruleset.rules),
        "condition_count": len(conditions),
        "assignment_count": sum(len(r.assignments) for r in ruleset.rules),
        "custom_function_count": sum(isinstance(o, Call) for root in roots for o in all_operands(root)),
    }


__all__ = ["OPERANDS", "canonical_json", "content_hash", "export_yaml", "payload_json", "read_payload", "summary_counts", "to_plain"]
