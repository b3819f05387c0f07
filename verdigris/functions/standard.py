"""The 58 standard functions as Spark expressions.

Each builder takes typed arguments by name and gives a typed value whose failures are data. Non-text values go
through Python's text, whole-number arguments must be whole, dates may be ISO text, and decimals are exact.
"""

from __future__ import annotations

import operator as py
import re
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from re._parser import parse_template

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.expr import INTEGRAL, WHITESPACE, WIDE, Val, error, first_error, is_binary, is_integral, is_number, is_numeric_text, is_temporal, is_text, is_time, literal, not_finite, number, plain_decimal, shown, text, trace_text
from verdigris.functions.patterns import JavaPattern, Untranslatable
from verdigris.functions.registry import ArgSpec, FunctionRegistry, FunctionSpec

STRING, LONG, BOOL, DATE = T.StringType(), T.LongType(), T.BooleanType(), T.DateType()
#: Rounding modes and calendar parts.
ROUNDING_MODES = ("half_up", "half_even", "half_down", "up", "down", "ceiling", "floor")
DATE_PARTS = ("year", "quarter", "month", "day", "day_of_week", "day_of_year")
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")

_BUILDERS: dict[str, tuple[FunctionSpec, Callable]] = {}


class Unsupported(Exception):
    """The arguments need the Python implementation."""


def A(name: str, hint: str = "any", **options) -> ArgSpec:  # noqa: N802
    return ArgSpec(name, type_hint=hint, **options)


def optional(name: str, hint: str, default, **options) -> ArgSpec:
    return ArgSpec(name, False, default, hint, **options)


ON_ERROR = optional("on_error", "string", "error", allowed_values=("error", "null"), literal_only=True)
ROUNDING = optional("rounding_mode", "string", "half_up", allowed_values=ROUNDING_MODES, literal_only=True)
VALUE = A("value")


def standard(returns: str, description: str, *arguments: ArgSpec):
    """Register the builder under its own name, without the leading ``f_``."""

    def keep(build: Callable) -> Callable:
        name = build.__name__.removeprefix("f_")
        spec = FunctionSpec(name, f"verdigris.functions.standard.{name}", tuple(arguments), return_type_hint=returns, description=description, version="1")
        _BUILDERS[name] = (spec, build)
        return build

    return keep


# ---- arguments


def whole(v: Val, label: str) -> tuple[Column, Column | None]:
    """A whole number argument as bigint; null and fractions are errors."""
    if isinstance(v.type, T.BooleanType):
        return F.lit(None).cast("bigint"), error("TypeError", f"{label} must be an integer, not a boolean.")
    if v.is_literal and isinstance(v.value, int):
        return F.lit(v.value).cast("bigint"), None
    d = number(v)
    n = F.when(d == F.floor(d), d).try_cast("bigint")
    return n, F.when(n.isNull(), error("ValueError", f"{label} must be an integer: ", shown(v)))


def array(v: Val, label: str) -> tuple[Val, Column | None]:
    if isinstance(v.type, T.ArrayType):
        return v, None
    if v.items is not None and not v.items:
        return Val(F.array().cast("array<string>"), T.ArrayType(STRING), value=v.value, items=()), None
    if v.items is not None:  # a literal list without a common type, or of nulls only
        if all(i.value is None for i in v.items):
            return Val(F.array(*[F.lit(None).cast("string") for _ in v.items]), T.ArrayType(STRING), value=v.value, items=v.items), None
        raise Unsupported
    return Val(F.lit(None).cast("array<string>"), T.ArrayType(STRING)), F.when(v.col.isNotNull(), error("TypeError", f"{label} must be an array."))


def day(v: Val, label: str = "value") -> tuple[Column, Column | None]:
    """A date argument; ISO text is read, a time gives its own day."""
    out = to_day(v)
    bad = error("ValueError", "Cannot convert value to date; expected ISO YYYY-MM-DD: ", shown(v)) if v.type is not None else None
    blank = F.btrim(v.col, F.lit(WHITESPACE)) == "" if is_text(v.type) else F.lit(False)
    if is_temporal(v.type) or v.type is None:
        return out, None
    return out, F.when(v.col.isNotNull() & out.isNull() & ~blank, bad)


def to_day(v: Val) -> Column:
    if isinstance(v.type, T.DateType):
        return v.col
    if is_time(v.type):
        return v.col.cast("date")
    if is_text(v.type):
        trimmed = F.btrim(v.col, F.lit(WHITESPACE))
        return F.when(F.regexp_like(trimmed, F.lit(r"^\d{4}-\d{2}-\d{2}$")), trimmed).try_cast("date")
    return F.lit(None).cast("date")


def exact(v: Val, label: str) -> tuple[Column, Column | None]:
    """A decimal argument."""
    if isinstance(v.type, T.BooleanType):
        return F.lit(None).cast(WIDE), F.when(v.col.isNotNull(), error("TypeError", f"{label} must be decimal-compatible, not boolean."))
    problems = []
    if (bad := not_finite(v)) is not None:
        problems.append(F.when(bad, error("ValueError", f"{label} must be a finite decimal.")))
    wrong = error("ValueError", f"{label} must be decimal-compatible: ", shown(v)) if v.type is not None else None
    if is_text(v.type):
        problems.append(F.when(~is_numeric_text(v), wrong))
    elif v.type is not None and not is_number(v.type):
        problems.append(F.when(v.col.isNotNull(), wrong))
    return number(v), first_error(*problems)


def _val(col: Column, kind, args: tuple[Val, ...], *errors: Column | None) -> Val:
    """A result behind its arguments' errors; own errors only count where ``value`` isn't null unless they say so."""
    return Val(col, kind, first_error(*[a.err for a in args], *errors))


def _if_known(v: Val, *errors: Column | None) -> list[Column]:
    return [F.when(v.col.isNotNull(), e) for e in errors if e is not None]


# ---- text


@standard("string", "Part of a text from a position counted from 1, up to a given length.", VALUE, A("start", "integer"), optional("length", "integer", None))
def f_substring(value, start, length):
    first, bad = whole(start, "start")
    first = F.greatest(first, F.lit(1))
    if length.is_literal and length.value is None:
        count, bad2 = F.lit(2**31 - 1), None
    else:
        count, bad2 = whole(length, "length")
        count, bad2 = F.when(length.col.isNull(), F.lit(2**31 - 1)).otherwise(F.greatest(count, F.lit(0))), F.when(length.col.isNotNull(), bad2) if bad2 is not None else None
    clip = lambda c: F.least(c, F.lit(2**31 - 1)).cast("int")
    return _val(F.substr(text(value), clip(first), clip(count)), STRING, (value, start, length), *_if_known(value, bad, bad2))


@standard("string", "The first characters of a text.", VALUE, A("length", "integer"))
def f_left(value, length):
    n, bad = whole(length, "length")
    return _val(F.left(text(value), F.least(F.greatest(n, F.lit(0)), F.lit(2**31 - 1)).cast("int")), STRING, (value, length), *_if_known(value, bad))


@standard("string", "The last characters of a text.", VALUE, A("length", "integer"))
def f_right(value, length):
    n, bad = whole(length, "length")
    return _val(F.right(text(value), F.least(F.greatest(n, F.lit(0)), F.lit(2**31 - 1)).cast("int")), STRING, (value, length), *_if_known(value, bad))


def _simple(name: str, kind, description: str, hint: str, build: Callable[[Column], Column]) -> None:
    def f(value):
        return _val(build(text(value)), kind, (value,))

    f.__name__ = name
    standard(hint, description, VALUE)(f)


_simple("trim", STRING, "The text without blanks at either end.", "string", lambda t: F.btrim(t, F.lit(WHITESPACE)))
_simple("ltrim", STRING, "The text without blanks at its start.", "string", lambda t: F.ltrim(t, F.lit(WHITESPACE)))
_simple("rtrim", STRING, "The text without blanks at its end.", "string", lambda t: F.rtrim(t, F.lit(WHITESPACE)))
_simple("upper", STRING, "The text in capital letters.", "string", F.upper)
_simple("lower", STRING, "The text in small letters.", "string", F.lower)
_simple("normalize_whitespace", STRING, "The text with each run of blanks as one space and none at the ends.", "string", lambda t: F.regexp_replace(F.btrim(t, F.lit(WHITESPACE)), "[" + re.escape(WHITESPACE) + "]+", " "))
_simple("text_length", LONG, "How many characters a text has.", "integer", lambda t: F.length(t).cast("bigint"))
_simple("is_blank", BOOL, "True for null and for a text of blanks only.", "boolean", lambda t: t.isNull() | (F.btrim(t, F.lit(WHITESPACE)) == ""))


def _required_text(v: Val, message: str) -> Column | None:
    return None if v.is_literal and v.value is not None else F.when(v.col.isNull(), error("TypeError", message))


@standard("string", "The text with every occurrence of one string exchanged for another.", VALUE, A("old", "string"), A("new", "string"))
def f_replace(value, old, new):
    t = text(value)
    between = F.regexp_replace(t, F.lit(""), F.regexp_replace(new.col, F.lit(r"([\\$])"), F.lit(r"\\$1")))
    out = F.when(old.col == "", between).otherwise(F.replace(t, old.col, new.col))
    return _val(out, STRING, (value, old, new), *_if_known(value, _required_text(old, "replace() argument 1 must be str, not None"), _required_text(new, "replace() argument 2 must be str, not None")))


@standard("string", "The n-th piece of a text cut at a delimiter, counted from 1.", VALUE, A("delimiter", "string"), A("part", "integer"))
def f_split_part(value, delimiter, part):
    n, bad = whole(part, "part")
    empty = F.when(delimiter.col == "", error("ValueError", "delimiter must be non-empty."))
    low = F.when(n < 1, error("ValueError", "part must be at least 1."))
    parts = F.split(text(value), F.concat(F.lit(r"\Q"), F.replace(delimiter.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E")), -1)
    out = F.when((delimiter.col != "") & (n >= 1), F.get(parts, F.least(n - 1, F.lit(2**31 - 1)).cast("int")))
    return _val(out, STRING, (value, delimiter, part), *_if_known(value, empty, bad, low))


def _pad(value, length, pad, left: bool):
    n, bad = whole(length, "length")
    width = F.least(F.greatest(n, F.lit(0)), F.lit(2**31 - 1)).cast("int")
    t, none = text(value), F.when(pad.col == "", error("ValueError", "pad must be non-empty."))
    if left:
        out = F.when(F.length(t) >= width, F.right(t, width)).otherwise(F.lpad(t, width, pad.col))
    else:
        out = F.when(F.length(t) >= width, F.left(t, width)).otherwise(F.rpad(t, width, pad.col))
    return _val(F.when(pad.col != "", out), STRING, (value, length, pad), *_if_known(value, bad, none))


@standard("string", "The text brought to a width: filled up at its start, or cut.", VALUE, A("length", "integer"), optional("pad", "string", " "))
def f_pad_left(value, length, pad):
    return _pad(value, length, pad, True)


@standard("string", "The text brought to a width: filled up at its end, or cut.", VALUE, A("length", "integer"), optional("pad", "string", " "))
def f_pad_right(value, length, pad):
    return _pad(value, length, pad, False)


_JOIN_ARGS = (A("values", "sequence"), A("separator", "string"), optional("skip_nulls", "boolean", True, literal_only=True))


def scalar_text(v: Val) -> Column | None:
    """Text of a scalar as ``to_string`` gives it; None for collections."""
    if isinstance(v.type, T.BooleanType):
        return F.when(v.col, "true").when(~v.col, "false")
    if isinstance(v.type, T.ArrayType | T.StructType | T.MapType):
        return None
    return trace_text(v)


def _join(values, separator, skip_nulls):
    if values.items is not None and any(not i.is_literal or i.value is not None for i in values.items):
        items = values.items  # each in its own type
        if any(scalar_text(i) is None for i in items):
            raise Unsupported
        listed = F.array(*[scalar_text(i).cast("string") for i in items])
        bad, present = None, F.lit(True)
    else:
        listed_val, bad = array(values, "values")
        inner = listed_val.type.elementType
        if isinstance(inner, T.ArrayType | T.StructType | T.MapType):
            raise Unsupported
        listed = F.transform(listed_val.col, lambda x: scalar_text(Val(x, inner)))
        present = listed_val.col.isNotNull()
    joined = F.call_function("array_join", listed, separator.col)
    out = joined if skip_nulls.value else F.when(~F.exists(listed, lambda x: x.isNull()), joined)
    return _val(F.when(present, out), STRING, (values, separator), bad)


@standard("string", "Items put together with a separator; nulls are skipped or make the result null.", *_JOIN_ARGS)
def f_concat_ws(values, separator, skip_nulls):
    return _join(values, separator, skip_nulls)


@standard("string", "A list's items as one text with a separator; nulls are skipped or make the result null.", *_JOIN_ARGS)
def f_array_join(values, separator, skip_nulls):
    return _join(values, separator, skip_nulls)


def _literal_pattern(pattern: Val) -> JavaPattern:
    if not pattern.is_literal or not isinstance(pattern.value, str):
        raise Unsupported
    try:
        return JavaPattern(pattern.value)
    except Untranslatable as exc:
        raise Unsupported from exc


@standard("string", "What a group of a pattern caught in a text, null without a match.", VALUE, A("pattern", "string"), optional("group", "integer", 1))
def f_regex_extract(value, pattern, group):
    if not group.is_literal or isinstance(group.value, bool) or not isinstance(group.value, int):
        raise Unsupported
    found, t = _literal_pattern(pattern), text(value)
    if not 0 <= group.value <= found.groups:
        return _val(F.lit(None).cast("string"), STRING, (value,), *_if_known(value, F.when(F.regexp_like(t, F.lit(found.text)), error("ValueError", f"Regex group does not exist: {group.value!r}"))))
    if group.value not in found.always:
        raise Unsupported  # a group may take no part, which Spark can't tell from empty
    return _val(F.when(F.regexp_like(t, F.lit(found.text)), F.regexp_extract(t, found.text, group.value)), STRING, (value,))


@standard("string", "The text with what a pattern matches exchanged for a replacement.", VALUE, A("pattern", "string"), A("replacement", "string"))
def f_regex_replace(value, pattern, replacement):
    found = _literal_pattern(pattern)
    if not replacement.is_literal or not isinstance(replacement.value, str) or found.may_be_empty:
        raise Unsupported  # empty matches beside others are counted differently
    try:
        template = parse_template(replacement.value, re.compile(pattern.value))
    except (re.error, IndexError) as exc:
        raise Unsupported from exc
    parts = []
    for part in template:
        if isinstance(part, str):
            if parts and parts[-1].startswith("$") and part[:1].isdecimal():
                raise Unsupported  # Java would read the digit as part of the group's number
            parts.append(re.sub(r"([\\$])", r"\\\1", part))
        elif part in found.always:
            parts.append(f"${part}")
        else:
            raise Unsupported
    return _val(F.regexp_replace(text(value), found.text, "".join(parts)), STRING, (value,))


@standard("boolean", "True where a pattern is found somewhere in the text.", VALUE, A("pattern", "string"))
def f_regex_match(value, pattern):
    return _val(F.regexp_like(text(value), F.lit(_literal_pattern(pattern).text)), BOOL, (value,))


@standard("boolean", "True where at least one of the candidates stands in the text.", VALUE, A("candidates", "string_sequence"))
def f_text_contains_any(value, candidates):
    t = text(value)
    if candidates.items is not None and all(i.is_literal and (i.value is None or isinstance(i.value, str)) for i in candidates.items):
        hits = [F.contains(t, i.col) for i in candidates.items if i.value is not None]
        return _val(reduce(py.or_, hits) if hits else F.when(t.isNotNull(), F.lit(False)), BOOL, (value,))
    listed, bad = array(candidates, "candidates")
    out = F.when(t.isNotNull() & listed.col.isNotNull(), F.exists(listed.col, lambda c: c.isNotNull() & F.contains(t, c)))
    return _val(out, BOOL, (value, candidates), *_if_known(value, bad))


@standard("same_as:value", "The value, or null where it equals the other one.", VALUE, A("compare_to"))
def f_null_if(value, compare_to):
    a, b = value, compare_to
    if a.type is None or b.type is None:
        return _val(a.col, a.type, (a, b))
    if a.type == b.type or is_number(a.type) and is_number(b.type):
        same = a.col.eqNullSafe(b.col)
    elif isinstance(a.type, T.BooleanType) and is_number(b.type) or is_number(a.type) and isinstance(b.type, T.BooleanType):
        same = a.col.cast("double").eqNullSafe(b.col.cast("double"))
    else:
        same = F.lit(False)
    return _val(F.when(~same, a.col), a.type, (a, b))


@standard("common_type:values", "The first item that isn't null.", A("values", "sequence"))
def f_coalesce(values):
    if values.items is not None:
        if isinstance(values.type, T.ArrayType):
            return _val(F.coalesce(*[i.col.cast(values.type.elementType) for i in values.items]), values.type.elementType, (values,))
        if all(i.value is None for i in values.items if i.is_literal) and all(i.is_literal for i in values.items):
            return _val(F.lit(None).cast("string"), STRING, (values,))
        raise Unsupported
    listed, bad = array(values, "values")
    return _val(F.get(F.filter(listed.col, lambda x: x.isNotNull()), F.lit(0)), listed.type.elementType, (values,), bad)


# ---- conversion


def _converted(value: Val, on_error: Val, out: Column, kind, ok: Column, message: str) -> Val:
    if on_error.value == "null":
        return _val(F.when(ok, out), kind, (value,))
    return _val(F.when(ok, out), kind, (value,), *_if_known(value, F.when(~ok, error("ValueError", f"{message}: ", shown(value)))) if value.type is not None else ())


def _blank(v: Val) -> Column:
    return F.btrim(v.col, F.lit(WHITESPACE)) == "" if is_text(v.type) else F.lit(False)


@standard("string", "A single value as text.", VALUE, ON_ERROR)
def f_to_string(value, on_error):
    out = scalar_text(value)
    ok = F.lit(out is not None)
    return _converted(value, on_error, out if out is not None else F.lit(None).cast("string"), STRING, ok, "Cannot convert value to string")


@standard("decimal", "A single value as an exact decimal.", VALUE, ON_ERROR)
def f_to_decimal(value, on_error):
    d = number(value).try_cast(WIDE) if value.type is not None else F.lit(None).cast(WIDE)
    return _converted(value, on_error, d, WIDE, d.isNotNull() | _blank(value) | value.col.isNull(), "Cannot convert value to decimal")


@standard("integer", "A single value as a whole number, without losing a fraction.", VALUE, ON_ERROR)
def f_to_integer(value, on_error):
    d = number(value)
    n = F.when(d == F.floor(d), d).try_cast("bigint")
    return _converted(value, on_error, n, LONG, n.isNotNull() | _blank(value) | value.col.isNull(), "Cannot convert value to integer")


@standard("boolean", "True or false from the words and digits that stand for them.", VALUE, ON_ERROR)
def f_to_boolean(value, on_error):
    if isinstance(value.type, T.BooleanType):
        return _val(value.col, BOOL, (value,))
    word = F.lower(F.btrim(text(value), F.lit(WHITESPACE)))
    out = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    return _converted(value, on_error, out, BOOL, out.isNotNull() | _blank(value) | value.col.isNull(), "Cannot convert value to boolean")


@standard("date", "A date from its ISO form, year first.", VALUE, ON_ERROR)
def f_to_date(value, on_error):
    out = to_day(value)
    return _converted(value, on_error, out, DATE, out.isNotNull() | _blank(value) | value.col.isNull(), "Cannot convert value to date; expected ISO YYYY-MM-DD")


_ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?"


@standard("timestamp", "An instant from an ISO time with an offset, in UTC.", VALUE, ON_ERROR)
def f_to_timestamp(value, on_error):
    out = F.lit(None).cast("timestamp")
    if is_text(value.type):
        trimmed = F.btrim(value.col, F.lit(WHITESPACE))
        out = F.when(F.regexp_like(trimmed, F.lit(_ISO_TIME + r"(Z|[+-]\d{2}:?\d{2})$")), F.regexp_replace(trimmed, r"([+-]\d{2})(\d{2})$", "$1:$2")).try_cast("timestamp")
    elif isinstance(value.type, T.TimestampType) and value.is_literal:
        out = value.col
    return _converted(value, on_error, out, T.TimestampType(), out.isNotNull() | value.col.isNull(), "Cannot convert value to timestamp")


@standard("timestamp_ntz", "A wall-clock time from an ISO time without an offset.", VALUE, ON_ERROR)
def f_to_timestamp_ntz(value, on_error):
    out = F.lit(None).cast("timestamp_ntz")
    if is_text(value.type):
        trimmed = F.btrim(value.col, F.lit(WHITESPACE))
        out = F.when(F.regexp_like(trimmed, F.lit(_ISO_TIME + "$")), trimmed).try_cast("timestamp_ntz")
    elif is_time(value.type) and not (value.is_literal and isinstance(value.type, T.TimestampType)):
        out = value.col.cast("timestamp_ntz")
    return _converted(value, on_error, out, T.TimestampNTZType(), out.isNotNull() | value.col.isNull(), "Cannot convert value to timestamp_ntz")


# ---- decimals

TOO_WIDE = "The decimal result exceeds 38 digits with 18 of them after the point."


def _fitted(out: Column, known: Column, args: tuple[Val, ...], *errors: Column | None) -> Val:
    """A decimal(38,18) result, with an error where the exact one doesn't fit."""
    made = _val(out, WIDE, args, *errors)
    return replace(made, check=lambda value: F.when(known & value.isNull(), error("ValueError", TOO_WIDE)))


def _lossless(x: Column, precision: int, scale: int) -> Column:
    narrow = x.try_cast(T.DecimalType(precision, scale))
    if scale == WIDE.scale:  # no digit after the point can be lost, and what overflows is null
        return narrow
    return F.when(narrow.try_cast(WIDE) == x.try_cast(WIDE), narrow)  # compared in one type: a common one may round


def _two(left: Val, right: Val, names: tuple[str, str], combine: Callable[[Column, Column], Column]) -> Val:
    (a, bad_a), (b, bad_b) = exact(left, names[0]), exact(right, names[1])
    known = left.col.isNotNull() & right.col.isNotNull() & a.isNotNull() & b.isNotNull()
    errors = [F.when(v.col.isNotNull(), e) for v, e in ((left, bad_a), (right, bad_b)) if e is not None]
    return _fitted(F.when(known, combine(a, b)), known, (left, right), *errors)


def _sum(sign: int):
    def combine(a: Column, b: Column) -> Column:
        # one digit is left for the carry; wider sums are beyond decimal(38,18) or need their own digits
        x, y = _lossless(a, 37, 18), _lossless(b, 37, 18)
        return F.try_add(x, y).try_cast(WIDE) if sign > 0 else F.try_subtract(x, y).try_cast(WIDE)

    return combine


def _product(a: Column, b: Column) -> Column:
    """Exact: nearly all factors fit types whose product can't lose digits; the others are multiplied in parts.

    The parts are worked out inside a lambda, which is interpreted, so that the common way stays short enough to be compiled.
    """
    plain = (_lossless(a, 19, 9) * _lossless(b, 18, 9)).try_cast(WIDE)
    parts = F.transform(F.array(F.struct(a.try_cast(WIDE).alias("a"), b.try_cast(WIDE).alias("b"))), lambda f: _product_in_parts(f.getField("a"), f.getField("b")))
    return F.coalesce(plain, F.get(parts, F.lit(0)))


def _product_in_parts(a: Column, b: Column) -> Column:
    """The exact product of two decimal(38,18), or null where it doesn't fit one.

    Each factor is a whole number and a fraction in units of the 18th place; all products of these are whole numbers.
    """

    def halves(x: Column) -> tuple[Column, Column]:
        size = F.abs(x)
        return F.floor(size).try_cast(T.DecimalType(20, 0)), ((size % F.lit(1)).cast(T.DecimalType(18, 18)) * _power(18)).cast(T.DecimalType(18, 0))

    (whole_a, part_a), (whole_b, part_b) = halves(a), halves(b)
    high = F.try_multiply(F.try_multiply(whole_a, whole_b).try_cast(T.DecimalType(20, 0)), _power(18))
    middle = F.try_add(F.try_multiply(whole_a, part_b), F.try_multiply(part_a, whole_b))
    low = part_a * part_b
    carried = ((low - low % _power(18)) / _power(18)).try_cast(T.DecimalType(18, 0))
    total = F.when(low % _power(18) == 0, F.try_add(F.try_add(high, middle), carried)).try_cast(T.DecimalType(38, 0))
    sign = F.when((a < 0) != (b < 0), "-").otherwise("")
    return F.concat(sign, plain_decimal(total), F.lit("E-18")).try_cast(WIDE)


def _declared(v: Val) -> T.DecimalType | None:
    """The decimal type a number is declared with."""
    if isinstance(v.type, T.DecimalType):
        return v.type
    return T.DecimalType(len(str(2 ** INTEGRAL[type(v.type)])), 0) if is_integral(v.type) else None


@standard("decimal", "A decimal without its sign.", VALUE)
def f_decimal_abs(value):
    a, bad = exact(value, "value")
    return _fitted(F.abs(a).try_cast(WIDE), a.isNotNull(), (value,), *_if_known(value, bad))


@standard("decimal", "The sum of two decimals.", A("left"), A("right"))
def f_decimal_add(left, right):
    return _two(left, right, ("left", "right"), _sum(1))


@standard("decimal", "The first decimal less the second.", A("left"), A("right"))
def f_decimal_subtract(left, right):
    return _two(left, right, ("left", "right"), _sum(-1))


@standard("decimal", "The product of two decimals.", A("left"), A("right"))
def f_decimal_multiply(left, right):
    p, q = _declared(left), _declared(right)
    if p is not None and q is not None and p.precision + q.precision < 38 and p.scale + q.scale <= WIDE.scale:
        return _two(left, right, ("left", "right"), lambda a, b: (a.cast(p) * b.cast(q)).try_cast(WIDE))
    return _two(left, right, ("left", "right"), _product)


@standard("decimal", "The lesser of two decimals.", A("left"), A("right"))
def f_decimal_min(left, right):
    return _two(left, right, ("left", "right"), lambda a, b: F.least(a.try_cast(WIDE), b.try_cast(WIDE)))


@standard("decimal", "The greater of two decimals.", A("left"), A("right"))
def f_decimal_max(left, right):
    return _two(left, right, ("left", "right"), lambda a, b: F.greatest(a.try_cast(WIDE), b.try_cast(WIDE)))


def _power(places: int) -> Column:
    return F.lit("1" + "0" * places).cast(T.DecimalType(places + 1, 0))


def _quotient(a: Column, b: Column, scale: int, mode: str, bind: Callable[[int, Column], Column]) -> Column:
    """a / b rounded to ``scale`` places, by whole numbers: quotient, rest, and what the rest says of the next digit.

    ``bind`` makes a column of each step, so that no step is computed twice.
    """
    whole38 = T.DecimalType(38, 0)
    if scale < 0:
        raise Unsupported
    pairs = []
    for digits in (9, 4, 0, 18):  # both sides as whole numbers of 10**-digits
        if digits + scale > 36:
            continue
        top = (_lossless(a, 38 - scale, digits) * _power(digits + scale)).try_cast(whole38) if digits + scale else _lossless(a, 38, 0)
        bottom = (_lossless(b, 19 + digits, digits) * _power(digits)).try_cast(whole38) if digits else _lossless(b, 37, 0)
        pairs.append(F.struct(top.alias("t"), bottom.alias("b")))
    pair = bind(0, F.coalesce(*[F.when(p.getField("t").isNotNull() & p.getField("b").isNotNull(), p) for p in pairs]))
    top, bottom = pair.getField("t"), pair.getField("b")
    rest = bind(1, top % bottom)
    truncated = bind(2, F.try_divide(top - rest, bottom).try_cast(whole38))
    # halves compare by the rest and what is missing to the divisor, which stay within its digits
    size, part = F.abs(bottom), F.abs(rest)
    over, tie = part > size - part, part == size - part
    negative = (top < 0) != (bottom < 0)
    away = {
        "half_up": over | tie,
        "half_down": over,
        "half_even": over | (tie & (truncated % 2 != 0)),
        "up": part > 0,
        "down": F.lit(False),
        "ceiling": (part > 0) & ~negative,
        "floor": (part > 0) & negative,
    }[mode]
    rounded = bind(3, truncated + F.when(away, F.when(negative, -1).otherwise(1)).otherwise(0))
    return F.concat(plain_decimal(rounded), F.lit(f"E{-scale}")).try_cast(WIDE)


def _divide(numerator, denominator, scale, rounding_mode, bind, safe: bool):
    if not scale.is_literal or isinstance(scale.value, bool) or not isinstance(scale.value, int):
        raise Unsupported
    (a, bad_a), (b, bad_b) = exact(numerator, "numerator"), exact(denominator, "denominator")
    errors = [F.when(numerator.col.isNotNull(), e) for e in (bad_a,) if e is not None] + [F.when(denominator.col.isNotNull(), e) for e in (bad_b,) if e is not None]
    both = a.isNotNull() & b.isNotNull()
    if not -38 <= scale.value <= 18:
        return _val(F.lit(None).cast(WIDE), WIDE, (numerator, denominator), *errors, F.when(both & (b != 0), error("ValueError", "scale must be between -38 and 18.")))
    known = both & (b != 0)
    zero = None if safe else F.when(both & (b == 0), error("ZeroDivisionError", "denominator cannot be zero."))
    out = F.when(known, _quotient(a, F.nullif(b, F.lit(0).cast("decimal(1,0)")), scale.value, rounding_mode.value, bind))
    return _fitted(out, known, (numerator, denominator), *errors, zero)


_DIVIDE_ARGS = (A("numerator"), A("denominator"), optional("scale", "integer", 18), ROUNDING)


@standard("decimal", "A rounded quotient of decimals; a divisor of zero fails the row.", *_DIVIDE_ARGS)
def f_decimal_divide(numerator, denominator, scale, rounding_mode, bind=lambda level, col: col):
    return _divide(numerator, denominator, scale, rounding_mode, bind, False)


@standard("decimal", "A rounded quotient of decimals; a divisor of zero gives null.", *_DIVIDE_ARGS)
def f_decimal_safe_divide(numerator, denominator, scale, rounding_mode, bind=lambda level, col: col):
    return _divide(numerator, denominator, scale, rounding_mode, bind, True)


def round_to(x: Column, places: int, mode: str) -> Column:
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    if places >= 18:
        return x
    if mode == "half_up":
        return F.round(x, places)
    if mode == "half_even":
        return F.bround(x, places)
    if mode in ("floor", "ceiling"):
        return F.floor(x, F.lit(places)) if mode == "floor" else F.ceil(x, F.lit(places))
    size = F.abs(x)
    if mode == "half_down":
        half = F.lit(f"5E-{places + 1}" if places >= 0 else f"5E{-places - 1}").cast(WIDE)
        size = F.greatest(F.ceil(F.try_subtract(_lossless(size, 37, 18), _lossless(half, 37, 18)).try_cast(WIDE), F.lit(places)).cast(WIDE), F.lit(0).cast(WIDE))
        return size * sign
    return (F.ceil(size, F.lit(places)) if mode == "up" else F.floor(size, F.lit(places))) * sign


@standard("decimal", "A decimal rounded to a number of places in a named way.", VALUE, A("scale", "integer"), ROUNDING)
def f_decimal_round(value, scale, rounding_mode):
    a, bad = exact(value, "value")
    a, mode = a.try_cast(WIDE), rounding_mode.value
    n, wrong = whole(scale, "scale")
    if scale.is_literal and isinstance(scale.value, int) and not isinstance(scale.value, bool):
        out = round_to(a, scale.value, mode).try_cast(WIDE) if -38 <= scale.value <= 18 else F.lit(None).cast(WIDE)
    else:
        out = F.coalesce(*[F.when(n == k, round_to(a, k, mode).try_cast(WIDE)) for k in range(-20, 19)])
    outside = F.when((n < -38) | (n > 18), error("ValueError", "scale must be between -38 and 18."))
    return _fitted(out, a.isNotNull(), (value, scale), *_if_known(value, bad, wrong, outside))


@standard("decimal", "A decimal, or the bound it lies beyond.", VALUE, A("minimum"), A("maximum"))
def f_decimal_clamp(value, minimum, maximum):
    parts = [exact(v, n) for v, n in ((value, "value"), (minimum, "minimum"), (maximum, "maximum"))]
    x, low, high = (p[0].try_cast(WIDE) for p in parts)
    known = x.isNotNull() & low.isNotNull() & high.isNotNull()
    errors = [F.when(v.col.isNotNull(), p[1]) for v, p in zip((value, minimum, maximum), parts, strict=True) if p[1] is not None]
    crossed = F.when(known & (low > high), error("ValueError", "minimum cannot be greater than maximum."))
    return _val(F.when(known, F.least(F.greatest(x, low), high)), WIDE, (value, minimum, maximum), *errors, crossed)


# ---- calendar


def _calendar(name: str, description: str, kind, hint: str, build: Callable[[Column], Column]) -> None:
    def f(value):
        d, bad = day(value)
        return _val(build(d), kind, (value,), bad)

    f.__name__ = name
    standard(hint, description, VALUE)(f)


_calendar("month_start", "The first day of the date's month.", DATE, "date", lambda d: F.trunc(d, "MM"))
_calendar("month_end", "The last day of the date's month.", DATE, "date", F.last_day)
_calendar("quarter_start", "The first day of the date's quarter.", DATE, "date", lambda d: F.trunc(d, "QUARTER"))
_calendar("quarter_end", "The last day of the date's quarter.", DATE, "date", lambda d: F.last_day(F.add_months(F.trunc(d, "QUARTER"), 2)))
_calendar("year_start", "The first day of the date's year.", DATE, "date", lambda d: F.trunc(d, "YEAR"))
_calendar("year_end", "The last day of the date's year.", DATE, "date", lambda d: F.add_months(F.trunc(d, "YEAR"), 11) + F.expr("interval 30 days"))


def _moved(value: Val, by: Val, label: str, per: int, unit: str) -> Val:
    d, bad = day(value)
    n, wrong = whole(by, label)
    months = n * per
    months_from_zero = F.year(d) * 12 + F.month(d) - 1 + months
    if unit == "days":
        ok = (F.datediff(F.lit("9999-12-31").cast("date"), d) >= n) & (F.datediff(F.lit("0001-01-01").cast("date"), d) <= n)
        out = F.when(ok, F.date_add(d, F.when(F.abs(n) < 4_000_000, n).cast("int")))
        shown_by = n
    else:
        ok = (months_from_zero >= 12) & (months_from_zero < 120_000)
        out = F.when(ok, F.add_months(d, F.when(F.abs(months) < 120_000, months).cast("int")))
        shown_by = months
    outside = F.when(d.isNotNull() & n.isNotNull() & ~ok, error("ValueError", "Adding ", shown_by.cast("string"), f" {unit} to ", F.date_format(d, "yyyy-MM-dd"), " exceeds the date range."))
    return _val(out, DATE, (value, by), bad, F.when(d.isNotNull(), wrong) if wrong is not None else None, outside)


@standard("date", "The date some days later, or earlier.", VALUE, A("days", "integer"))
def f_date_add_days(value, days):
    return _moved(value, days, "days", 1, "days")


@standard("date", "The date some months later, on the month's last day where its own is missing.", VALUE, A("months", "integer"))
def f_date_add_months(value, months):
    return _moved(value, months, "months", 1, "months")


@standard("date", "The date some years later, on 28 February where the 29th is missing.", VALUE, A("years", "integer"))
def f_date_add_years(value, years):
    return _moved(value, years, "years", 12, "months")


def _between(start: Val, end: Val, build: Callable[[Column, Column], Column]) -> Val:
    (a, bad_a), (b, bad_b) = day(start), day(end)
    return _val(build(a, b).cast("bigint"), LONG, (start, end), bad_a, bad_b)


def _completed(per: int):
    def build(a: Column, b: Column) -> Column:
        low, high = F.least(a, b), F.greatest(a, b)
        months = (F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low) if per == 1 else F.year(high) - F.year(low)
        months = months - F.when(F.add_months(low, months * per) > high, 1).otherwise(0)
        return F.when(a.isNotNull() & b.isNotNull(), F.when(b < a, -months).otherwise(months))

    return build


@standard("integer", "Days from the first date to the second.", A("start"), A("end"))
def f_date_diff_days(start, end):
    return _between(start, end, lambda a, b: F.datediff(b, a))


@standard("integer", "Full months from the first date to the second.", A("start"), A("end"))
def f_date_diff_months(start, end):
    return _between(start, end, _completed(1))


@standard("integer", "Full years from the first date to the second.", A("start"), A("end"))
def f_date_diff_years(start, end):
    return _between(start, end, _completed(12))


_PARTS = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "day_of_week": lambda d: F.weekday(d) + 1, "day_of_year": F.dayofyear}


@standard("integer", "One part of a date by name.", VALUE, A("part", "string", allowed_values=DATE_PARTS, literal_only=True))
def f_date_part(value, part):
    d, bad = day(value)
    return _val(_PARTS[part.value](d).cast("bigint"), LONG, (value,), bad)


_BUSINESS_ARGS = (VALUE, A("holidays", "sequence"), optional("weekend_days", "integer_sequence", (6, 7), literal_only=True))


def _business_day(value: Val, holidays: Val, weekend_days: Val, last: bool) -> Val:
    d, bad = day(value)
    known = d.isNotNull()
    listed, wrong = array(holidays, "holidays")
    missing = F.when(listed.col.isNull(), error("TypeError", "holidays must be an array.")) if wrong is None and not listed.is_literal else None
    inner = listed.type.elementType
    days = F.transform(listed.col, lambda x: to_day(Val(x, inner)))
    unread = F.get(F.filter(F.transform(listed.col, lambda x: day(Val(x, inner))[1] if day(Val(x, inner))[1] is not None else F.lit(None).cast("string")), lambda e: e.isNotNull()), F.lit(0))
    empty = F.when(F.exists(days, lambda x: x.isNull()), error("ValueError", "holidays cannot contain null or blank values."))
    weekends = sorted({int(w) for w in weekend_days.value})
    static = None
    if any(w < 1 or w > 7 for w in weekends):
        static = error("ValueError", "weekend_days must contain ISO weekdays from 1 through 7.")
    elif len(weekends) == 7:
        static = error("ValueError", "weekend_days cannot mark every weekday as a weekend.")
    every = F.sequence(F.trunc(d, "MM"), F.last_day(d), F.expr("interval 1 day"))
    open_days = F.filter(every, lambda x: (~(F.weekday(x) + 1).isin(weekends) if weekends else F.lit(True)) & ~F.coalesce(F.array_contains(F.filter(days, lambda h: h.isNotNull()), x), F.lit(False)))
    out = F.try_element_at(open_days, F.lit(-1 if last else 1))
    none = F.when(out.isNull(), error("ValueError", "The month contains no available business day."))
    return _val(out, DATE, (value, holidays), bad, *[F.when(known, e) for e in (wrong, missing, unread, empty, static, none) if e is not None])


@standard("date", "The month's first day that is neither at a weekend nor a holiday.", *_BUSINESS_ARGS)
def f_first_business_day_of_month(value, holidays, weekend_days):
    return _business_day(value, holidays, weekend_days, False)


@standard("date", "The month's last day that is neither at a weekend nor a holiday.", *_BUSINESS_ARGS)
def f_last_business_day_of_month(value, holidays, weekend_days):
    return _business_day(value, holidays, weekend_days, True)


# ---- arrays


@standard("integer", "How many items a list has.", A("values", "sequence"))
def f_array_size(values):
    if values.items is not None:
        return _val(F.lit(len(values.items)).cast("bigint"), LONG, (values,))
    listed, bad = array(values, "values")
    return _val(F.array_size(listed.col).cast("bigint"), LONG, (values,), bad)


def _contains(values: Val, candidates: Val, every: bool) -> Val:
    (a, bad_a), (b, bad_b) = array(values, "values"), array(candidates, "candidates")
    alike = a.type.elementType == b.type.elementType or is_number(a.type.elementType) and is_number(b.type.elementType)
    empty = [v.items is not None and not any(i.value is not None or not i.is_literal for i in v.items) for v in (a, b)]
    if alike or any(empty):
        match = (lambda c, i: c.isNull() & i.isNull()) if not alike else (lambda c, i: c.eqNullSafe(i))
    else:
        match = lambda c, i: c.isNull() & i.isNull()
    test = F.forall if every else F.exists
    out = F.when(a.col.isNotNull() & b.col.isNotNull(), test(b.col, lambda c: F.exists(a.col, lambda i: match(c, i))))
    return _val(out, BOOL, (values, candidates), *[F.when(values.col.isNotNull() & candidates.col.isNotNull(), e) for e in (bad_a, bad_b) if e is not None])


_ARRAY_ARGS = (A("values", "sequence"), A("candidates", "sequence"))


@standard("boolean", "True where at least one of the candidates is in the list.", *_ARRAY_ARGS)
def f_array_contains_any(values, candidates):
    return _contains(values, candidates, False)


@standard("boolean", "True where every candidate is in the list.", *_ARRAY_ARGS)
def f_array_contains_all(values, candidates):
    return _contains(values, candidates, True)


#: Functions whose decimal arguments stand in the expression many times: each gets a column of its own first.
EXACT_ARGUMENTS = {"decimal_add": ("left", "right"), "decimal_subtract": ("left", "right"), "decimal_multiply": ("left", "right"), "decimal_min": ("left", "right"), "decimal_max": ("left", "right"), "decimal_divide": ("numerator", "denominator"), "decimal_safe_divide": ("numerator", "denominator"), "decimal_round": ("value",), "decimal_clamp": ("value", "minimum", "maximum"), "decimal_abs": ("value",)}


#: Functions that compute in steps, each step a column of its own.
STEPS = {"decimal_divide": 4, "decimal_safe_divide": 4}


def standard_specs() -> list[FunctionSpec]:
    return [spec for spec, _ in _BUILDERS.values()]


def standard_rows() -> list[dict]:
    """The contracts as rows of the function table."""
    return [spec.to_row() for spec in standard_specs()]


def register_standard(registry: FunctionRegistry) -> FunctionRegistry:
    """Add all standard functions to ``registry``."""
    from verdigris.functions import fallback

    for name, (spec, build) in _BUILDERS.items():
        registry.register(spec, getattr(fallback, name, None), build)
    return registry


def standard_registry() -> FunctionRegistry:
    """A registry with the standard functions."""
    return register_standard(FunctionRegistry())
