"""A small row-at-a-time evaluator of rulesets in plain Python, written apart from the library's lowering."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal, InvalidOperation

from verdigris.model import AssignedRef, FieldRef, Literal

GUIDE = "Operators in/not_in require a collection-valued right operand. Use contains/not_contains for substring checks."
DATES = "Date comparisons require two dates and timestamp comparisons require two timestamps. Use to_date for explicit conversion."


class RowError(Exception):
    pass


def numeric(v):
    return isinstance(v, int | float | Decimal) and not isinstance(v, bool)


def dec(v):
    if isinstance(v, bool):
        return None
    try:
        d = Decimal(str(v))
    except (InvalidOperation, ValueError):
        return None
    if not d.is_finite():
        raise RowError("ValueError: Numeric comparison values must be finite.")
    return d


def temporal(v):
    return "timestamp" if isinstance(v, dt.datetime) else "date" if isinstance(v, dt.date) else None


def same(a, b, tol):
    if numeric(a) or numeric(b):
        x, y = dec(a), dec(b)
        if x is not None and y is not None:
            return abs(x - y) <= tol
    if temporal(a) or temporal(b):
        if temporal(a) != temporal(b):
            raise RowError(f"TypeError: {DATES}")
    return a == b


def order(a, b):
    if temporal(a) or temporal(b):
        if temporal(a) != temporal(b):
            raise RowError(f"TypeError: {DATES}")
        return a, b
    out = []
    for v in (a, b):
        try:
            d = Decimal(str(v))
        except InvalidOperation:
            raise RowError(f"ValueError: Ordered comparison requires numeric or matching temporal operands; found {v!r}.") from None
        if not d.is_finite():
            raise RowError(f"ValueError: Numeric comparison values must be finite; found {v!r}.")
        out.append(d)
    return out


def like(text, pattern):
    import re

    return re.fullmatch("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in pattern), text, re.DOTALL) is not None


def compare(a, op, b, tol, strict):
    if op in ("is_null", "is_not_null"):
        return (a is None) == (op == "is_null")
    if a is None or b is None:
        if strict:
            raise RowError("ValueError: Null operand encountered with error_on_null=true.")
        return None
    base = op.removeprefix("not_")
    if base in ("eq", "ne"):
        out = same(a, b, tol)
    elif base in ("gt", "ge", "lt", "le"):
        x, y = order(a, b)
        t = dt.timedelta(0) if temporal(a) else tol
        out = {"gt": lambda: x > y + t, "ge": lambda: x >= y - t, "lt": lambda: x < y - t, "le": lambda: x <= y + t}[base]()
    elif base == "in":
        if not isinstance(b, list | tuple | set):
            raise RowError(f"TypeError: {GUIDE}")
        out = any(same(a, i, tol) for i in b)
    elif base == "between":
        low, x = order(b[0], a)
        y, high = order(a, b[1])
        out = low <= x and y <= high
    else:
        l, r = str(a), str(b)
        out = {"contains": lambda: r in l, "starts_with": lambda: l.startswith(r), "ends_with": lambda: l.endswith(r), "like": lambda: like(l, r)}[base]()
    return not out if base != op or op == "ne" else out


def decide(ruleset, row):
    """(error, ids, assigned values) of one row."""
    state, ids = {}, []

    def value(op, committed):
        v = row.get(op.name) if isinstance(op, FieldRef) else committed.get(op.target) if isinstance(op, AssignedRef) else op.value
        assert isinstance(op, FieldRef | AssignedRef | Literal)
        return op.default.value if v is None and op.default is not None else v

    def group(g):
        parts = []
        for c in g.conditions:
            if not c.active:
                parts.append(False)
                continue
            left, right = value(c.left, state), None if c.right is None else value(c.right, state)
            parts.append(compare(left, c.operator, right, c.tolerance, c.error_on_null) is True)
        parts += [group(x) for x in g.groups]
        return all(parts) if g.logic == "all" else any(parts)

    try:
        for rule in ruleset.active_rules():
            if group(rule.when):
                ids.append(rule.rule_id)
                state |= {a.target: value(a.value, dict(state)) for a in rule.assignments}
                if rule.stop_on_match:
                    break
    except RowError as exc:
        return str(exc), [], {}
    return None, ids, state
