"""Python versions of the standard functions for arguments that Spark expressions can't treat exactly.

They run as Arrow UDFs and only where a Spark expression can't say the same: patterns and scales from columns,
patterns without a safe form in Java, groups that may take no part in a match, lists of several types.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import ROUND_CEILING, ROUND_DOWN, ROUND_FLOOR, ROUND_HALF_DOWN, ROUND_HALF_EVEN, ROUND_HALF_UP, ROUND_UP, Context, Decimal, InvalidOperation

_MODES = {"half_up": ROUND_HALF_UP, "half_even": ROUND_HALF_EVEN, "half_down": ROUND_HALF_DOWN, "up": ROUND_UP, "down": ROUND_DOWN, "ceiling": ROUND_CEILING, "floor": ROUND_FLOOR}
_WIDE = Context(prec=76)


def regex_extract(value, pattern, group=1):
    found = None if value is None else re.search(pattern, str(value))
    if found is None:
        return None
    if not 0 <= group <= found.re.groups:
        raise ValueError(f"Regex group does not exist: {group!r}")
    return found[int(group)]


def regex_replace(value, pattern, replacement):
    return value if value is None else re.sub(pattern, replacement, str(value))


def regex_match(value, pattern):
    return value if value is None else bool(re.search(pattern, str(value)))


def coalesce(values):
    for item in values or ():
        if item is not None:
            return item
    return None


def _number(value, label):
    if value is None:
        return None
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation as exc:
        raise ValueError(f"{label} must be decimal-compatible: {value!r}") from exc
    if not number.is_finite():
        raise ValueError(f"{label} must be a finite decimal.")
    return number


def _quotient(numerator, denominator, scale, rounding_mode, at_zero):
    top, bottom = _number(numerator, "numerator"), _number(denominator, "denominator")
    if top is None or bottom is None:
        return None
    if not bottom:
        return at_zero()
    if scale is None or scale != int(scale) or not -38 <= scale <= 18:
        raise ValueError("scale must be between -38 and 18.")
    return _WIDE.divide(top, bottom).quantize(Decimal(1).scaleb(-int(scale)), _MODES[rounding_mode], _WIDE)


def _fail():
    raise ZeroDivisionError("denominator cannot be zero.")


def decimal_divide(numerator, denominator, scale=18, rounding_mode="half_up"):
    return _quotient(numerator, denominator, scale, rounding_mode, _fail)


def decimal_safe_divide(numerator, denominator, scale=18, rounding_mode="half_up"):
    return _quotient(numerator, denominator, scale, rounding_mode, lambda: None)


# ---- lists of several types


def _listed(values, label):
    if not isinstance(values, list | tuple | set | frozenset):
        raise TypeError(f"{label} must be an array.")
    return list(values)


def _plain_text(value):
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, str | int | float):
        return str(value)
    raise ValueError(f"Cannot convert value to string: {value!r}")


def concat_ws(values, separator, skip_nulls=True):
    if values is None:
        return None
    items = _listed(values, "values")
    kept = [item for item in items if item is not None]
    return separator.join(map(_plain_text, kept)) if skip_nulls or len(kept) == len(items) else None


array_join = concat_ws


def text_contains_any(value, candidates):
    if value is None or candidates is None:
        return None
    return any(c is not None and str(c) in str(value) for c in _listed(candidates, "candidates"))


def _hits(values, candidates):
    """For each candidate whether the list holds it; None where a list is missing."""
    if values is None or candidates is None:
        return None
    items = _listed(values, "values")
    return [c in items for c in _listed(candidates, "candidates")]


def array_contains_any(values, candidates):
    hits = _hits(values, candidates)
    return hits if hits is None else any(hits)


def array_contains_all(values, candidates):
    hits = _hits(values, candidates)
    return hits if hits is None else all(hits)


def _day(value, label):
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if isinstance(value, str) and not value.strip():
        return None
    if isinstance(value, str) and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value.strip()):
        return dt.date.fromisoformat(value.strip())
    raise ValueError(f"Cannot convert value to date; expected ISO YYYY-MM-DD: {value!r}")


def _open_days(value, holidays, weekend_days):
    day = None if value is None else _day(value, "value")
    if day is None:
        return None
    closed = {None if h is None else _day(h, "holidays") for h in _listed(holidays, "holidays")}
    if None in closed:
        raise ValueError("holidays cannot contain null or blank values.")
    if any(not 1 <= w <= 7 for w in weekend_days):
        raise ValueError("weekend_days must contain ISO weekdays from 1 through 7.")
    if len(set(weekend_days)) == 7:
        raise ValueError("weekend_days cannot mark every weekday as a weekend.")
    month = [day.replace(day=1) + dt.timedelta(n) for n in range(31)]
    days = [d for d in month if d.month == day.month and d.isoweekday() not in weekend_days and d not in closed]
    if not days:
        raise ValueError("The month contains no available business day.")
    return days


def first_business_day_of_month(value, holidays, weekend_days=(6, 7)):
    days = _open_days(value, holidays, weekend_days)
    return days and days[0]


def last_business_day_of_month(value, holidays, weekend_days=(6, 7)):
    days = _open_days(value, holidays, weekend_days)
    return days and days[-1]
