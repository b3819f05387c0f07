"""SQL text of plain conditions and literals.

A column built call by call costs the driver a round trip per node, which adds up over hundreds of rules. What
compares a field with a literal of its own kind can't fail and means in SQL what it means in a rule, so it
is written as text and parsed at once. Everything else is built by the typed lowering.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark.sql import types as T

from verdigris.functions.expr import is_integral, is_text
from verdigris.model import Condition, FieldRef, Group, Literal

_SIGNS = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
_CALLS = {"starts_with": "startswith", "ends_with": "endswith", "contains": "contains"}


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_literal(value: Any) -> str | None:
    """A text, whole number, flag or date as SQL; None for other kinds."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L" if -(2**63) < value < 2**63 else None
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if "\0" not in value else None
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return f"DATE'{value.isoformat()}'"
    return None


def _alike(t: T.DataType | None, value: Any) -> bool:
    """Whether values of type ``t`` compare with ``value`` in SQL as in Python."""
    if isinstance(value, bool):
        return isinstance(t, T.BooleanType)
    if isinstance(value, int):
        return is_integral(t)
    if isinstance(value, str):
        return is_text(t)
    return isinstance(value, dt.date) and not isinstance(value, dt.datetime) and isinstance(t, T.DateType)


def condition_sql(c: Condition, source: Mapping[str, T.DataType]) -> str | None:
    """A plain active condition; null where its field is."""
    if not c.active:
        return "false"
    if not isinstance(c.left, FieldRef) or c.left.default is not None or c.error_on_null or c.tolerance:
        return None
    name, t = sql_name(c.left.name), source.get(c.left.name)
    if c.operator in ("is_null", "is_not_null"):
        return f"({name} {c.operator.replace('_', ' ')})"
    if not isinstance(c.right, Literal) or c.right.default is not None or c.right.hint is not None:
        return None
    value, base = c.right.value, c.operator.removeprefix("not_")
    no = "" if base == c.operator else "NOT "
    if base == "in" and isinstance(value, list | tuple):
        items = [sql_literal(v) if _alike(t, v) else None for v in value if v is not None]
        return f"({no}({name} IN ({', '.join(items)})))" if items and None not in items else None
    text = sql_literal(value) if _alike(t, value) else None
    if text is None:
        return None
    if base in _CALLS and is_text(t):
        return f"({no}{_CALLS[base]}({name}, {text}))"
    ordered = base in ("gt", "ge", "lt", "le")
    if base in _SIGNS and not (ordered and (is_text(t) or isinstance(t, T.BooleanType))):
        return f"({name} {_SIGNS[base]} {text})"
    return None


def group_sql(group: Group, source: Mapping[str, T.DataType]) -> str | None:
    """A group of plain conditions only, in three-valued logic."""
    parts = [condition_sql(c, source) for c in group.conditions] + [group_sql(g, source) for g in group.groups]
    if None in parts:
        return None
    return "(" + (" AND " if group.logic == "all" else " OR ").join(parts) + ")" if parts else ("true" if group.logic == "all" else "false")


def assigned_sql(op: Any, t: T.DataType) -> str | None:
    """A literal assignment whose value has just the target's type."""
    plain = isinstance(op, Literal) and op.hint is None and op.default is None and _alike(t, op.value) and (not is_integral(t) or isinstance(t, T.LongType))
    return sql_literal(op.value) if plain else None
