"""The comparison operators over typed values, with Python's equality and exact decimal order."""

from __future__ import annotations

import operator as py
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.expr import Val, error, first_error, is_binary, is_integral, is_number, is_numeric_text, is_temporal, is_text, is_time, literal, not_finite, number, shown, text

FINITE = "Numeric comparison values must be finite."
DATES = "Date comparisons require two dates and timestamp comparisons require two timestamps. Use to_date for explicit conversion."
_ORDERS = {"gt": py.gt, "ge": py.ge, "lt": py.lt, "le": py.le}


def _constant(v: Val) -> Decimal | None:
    if v.is_literal and isinstance(v.value, int | Decimal) and not isinstance(v.value, bool):
        return Decimal(v.value)
    return None


def _round_trips(d: Decimal) -> bool:
    """Whether a binary number stands for exactly this decimal; then order among them is the same."""
    return Decimal(repr(float(d))) == d


def _both(l: Val, r: Val) -> Column:
    return l.col.isNotNull() & r.col.isNotNull()


def _finite_error(*vals: Val) -> Column | None:
    return first_error(*[F.when(bad, error("ValueError", FINITE)) for v in vals if (bad := not_finite(v)) is not None])


def _fits(d: Column) -> Column:
    """Narrow enough that a sum or difference keeps every digit."""
    return d.try_cast(T.DecimalType(37, 18))


def _ordered_numbers(l: Val, op, r: Val, shift: Decimal) -> Column:
    """``op(l, r + shift)`` in exact decimals; beyond 38 digits in doubles."""
    for one, other, sign in ((l, r, 1), (r, l, -1)):
        bound = _constant(other)
        if is_binary(one.type) and bound is not None:
            bound = bound + sign * shift
            if _round_trips(bound):
                x, c = one.col.cast("double"), F.lit(float(bound))
                return op(x, c) if one is l else op(c, x)
    if is_binary(l.type) and is_binary(r.type) and not shift:
        return op(l.col.cast("double"), r.col.cast("double"))
    if is_integral(l.type) and is_integral(r.type) and not shift:
        return op(l.col, r.col)
    left, right = number(l), number(r)
    exact = op(left, right) if not shift else op(_fits(left), _fits(right) + literal(shift).col)
    if is_integral(l.type) or is_integral(r.type) or isinstance(l.type, T.DecimalType) and isinstance(r.type, T.DecimalType):
        if not (is_binary(l.type) or is_binary(r.type) or is_text(l.type) or is_text(r.type)) and not shift:
            return exact
    return F.coalesce(exact, op(l.col.try_cast("double"), r.col.try_cast("double") + F.lit(float(shift))))


def _times(l: Val, r: Val) -> tuple[Column, Column] | None:
    """The two sides as comparable times, if they are of one kind."""
    if isinstance(l.type, T.DateType) and isinstance(r.type, T.DateType) or l.type == r.type:
        return l.col, r.col
    if is_time(l.type) and is_time(r.type) and not (l.is_literal or r.is_literal):
        return l.col.cast("timestamp_ntz"), r.col.cast("timestamp_ntz")
    return None


def equals(l: Val, r: Val, tolerance: Decimal = Decimal(0)) -> tuple[Column, Column | None]:
    """(equal, error); both only matter where neither side is null."""
    a, b = l.type, r.type
    if a is None or b is None:
        return F.lit(False), None
    if is_number(a) or is_number(b):
        if (is_number(a) or is_text(a)) and (is_number(b) or is_text(b)):
            bad = _finite_error(l, r)
            if tolerance:
                low, high = _ordered_numbers(l, py.ge, r, -tolerance), _ordered_numbers(l, py.le, r, tolerance)
                return F.coalesce(low & high, F.lit(False)), bad
            if is_text(a) or is_text(b):
                string = l if is_text(a) else r
                return is_numeric_text(string) & F.coalesce(_ordered_numbers(l, py.eq, r, Decimal(0)), F.lit(False)), bad
            return F.coalesce(_ordered_numbers(l, py.eq, r, Decimal(0)), F.lit(False)), bad
        for flag, other in ((l, r), (r, l)):
            if isinstance(flag.type, T.BooleanType) and is_number(other.type):
                return flag.col.cast("int").cast("double") == other.col.cast("double"), _finite_error(other)
    if is_temporal(a) or is_temporal(b):
        if tolerance:
            return F.lit(False), error("ValueError", "Date and timestamp comparisons require tolerance_abs=0.")
        pair = _times(l, r)
        return (pair[0] == pair[1], None) if pair else (F.lit(False), error("TypeError", DATES))
    if a == b or (isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType) and a.elementType == b.elementType):
        return F.coalesce(l.col.eqNullSafe(r.col), F.lit(False)), None
    return F.lit(False), None


def ordered(l: Val, name: str, r: Val, tolerance: Decimal = Decimal(0)) -> tuple[Column, Column | None]:
    """(result, error) of gt, ge, lt or le."""
    op = _ORDERS[name]
    if is_temporal(l.type) or is_temporal(r.type):
        if tolerance:
            return F.lit(False), error("ValueError", "Date and timestamp comparisons require tolerance_abs=0.")
        pair = _times(l, r)
        return (op(*pair), None) if pair else (F.lit(False), error("TypeError", DATES))
    problems = []
    for v in (l, r):
        where = "Ordered comparison requires numeric or matching temporal operands; found "
        if is_number(v.type) or is_text(v.type):
            if (bad := not_finite(v)) is not None:
                problems.append(F.when(bad, error("ValueError", "Numeric comparison values must be finite; found ", shown(v), ".")))
            if is_text(v.type):
                problems.append(F.when(~is_numeric_text(v), error("ValueError", where, shown(v), ".")))
        else:
            problems.append(error("ValueError", where, shown(v) if v.type is not None else F.lit("None"), "."))
    bad = first_error(*problems)
    if not all(is_number(v.type) or is_text(v.type) for v in (l, r)):
        return F.lit(False), bad
    shift = {"gt": tolerance, "le": tolerance, "ge": -tolerance, "lt": -tolerance}[name]
    return F.coalesce(_ordered_numbers(l, op, r, shift), F.lit(False)), bad


def _member(l: Val, r: Val, tolerance: Decimal) -> tuple[Column, Column | None]:
    if r.items is not None:
        hits, problems, before = [], [], None
        constants = [i.value for i in r.items]
        if not tolerance and is_text(l.type) and all(isinstance(c, str) for c in constants) and constants:
            return l.col.isin(constants), None
        for item in r.items:
            if item.type is None or item.value is None:
                hit, bad = F.lit(False), error("TypeError", DATES) if is_temporal(l.type) else None
            else:
                hit, bad = equals(l, item, tolerance)
            if bad is not None:
                problems.append(bad if before is None else F.when(~before, bad))
            hits.append(hit)
            before = hit if before is None else before | hit
        return (reduce(py.or_, hits) if hits else F.lit(False)), first_error(*problems)
    if isinstance(r.type, T.ArrayType):
        item_type = r.type.elementType
        probe = equals(l, Val(F.lit(None).cast(item_type), item_type), tolerance)[1]
        hit = F.exists(r.col, lambda x: F.coalesce(equals(l, Val(x, item_type), tolerance)[0], F.lit(False)))
        bad = None
        if probe is not None:
            bad = F.get(F.filter(F.transform(r.col, lambda x: equals(l, Val(x, item_type), tolerance)[1]), lambda e: e.isNotNull()), F.lit(0))
        return hit, bad
    guide = "Operators in/not_in require a collection-valued right operand. Use contains/not_contains for substring checks."
    return F.lit(False), error("TypeError", guide)


def _between(l: Val, r: Val) -> tuple[Column, Column | None]:
    if r.items is not None and len(r.items) == 2 or isinstance(r.type, T.ArrayType) and r.items is None:
        low, high = r.items or tuple(Val(F.get(r.col, F.lit(i)), r.type.elementType) for i in (0, 1))
        size = None
        if r.items is None:
            size = F.when(F.size(r.col) != 2, error("TypeError", "Operators between/not_between require a two-item list or tuple right operand, found ", text(r), "."))
        problems, parts = [size], []
        for one, other in ((low, l), (l, high)):
            bound = low if one is low else high
            inside, bad = ordered(one, "le", other)
            kind = error("TypeError", DATES) if is_temporal(l.type) else error("ValueError", "Ordered comparison requires numeric or matching temporal operands; found None.")
            problems += [F.when(bound.col.isNull(), kind) if not bound.is_literal or bound.value is None else None, bad]
            parts.append(inside)
        return F.coalesce(parts[0] & parts[1], F.lit(False)), first_error(*problems)
    return F.lit(False), error("TypeError", "Operators between/not_between require a two-item list or tuple right operand, found ", shown(r) if r.type is not None else repr(r.value), ".")


def _pattern(l: Val, r: Val) -> Column:
    return F.expr("true") if l is r else text(l).like(r.value.replace("\\", "\\\\")) if r.is_literal and isinstance(r.value, str) else F.call_function("like", text(l), F.replace(text(r), F.lit("\\"), F.lit("\\\\")))


_TEXTUAL = {
    "contains": lambda l, r: F.contains(text(l), text(r)),
    "starts_with": lambda l, r: F.startswith(text(l), text(r)),
    "ends_with": lambda l, r: F.endswith(text(l), text(r)),
    "like": _pattern,
}


def compare(l: Val, name: str, r: Val | None, tolerance: Decimal, error_on_null: bool) -> tuple[Column, Column | None]:
    """(comparison result: true, false or null; error). Null sides give null, or an error if asked for."""
    if name in ("is_null", "is_not_null"):
        null = F.lit(l.value is None) if l.items is not None else l.col.isNull()
        return (null if name == "is_null" else ~null), None
    base = name.removeprefix("not_")
    negated = base != name or name == "ne"
    if base in ("eq", "ne"):
        result, bad = equals(l, r, tolerance)
    elif base in _ORDERS:
        result, bad = ordered(l, base, r, tolerance)
    elif base == "in":
        result, bad = _member(l, r, tolerance)
    elif base == "between":
        result, bad = _between(l, r)
    else:
        result, bad = _TEXTUAL[base](l, r), None
    known = _known(l) if r is None else _conjunction(_known(l), _known(r))
    result = ~result if negated else result
    null_error = error("ValueError", "Null operand encountered with error_on_null=true.") if error_on_null else None
    if known is None:
        return result, bad
    bad = None if bad is None and null_error is None else F.when(known, bad if bad is not None else F.lit(None).cast("string")).otherwise(null_error if null_error is not None else F.lit(None).cast("string"))
    return F.when(known, result), bad


def _known(v: Val) -> Column | None:
    """Not null, or None if that is certain."""
    if v.is_literal:
        return F.lit(False) if v.value is None else None
    return v.col.isNotNull()


def _conjunction(a: Column | None, b: Column | None) -> Column | None:
    return a & b if a is not None and b is not None else a if a is not None else b
