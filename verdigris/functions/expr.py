"""Typed column expressions with errors as data, and Python's view of Spark values.

A :class:`Val` holds a column that never throws, its Spark type and, where it can fail, a column with the text of
the error or null. Rules see values as Python does: ``text`` is ``str(value)`` and ``number`` is
``Decimal(str(value))``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters Python's str.isspace accepts.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WIDE = T.DecimalType(38, 18)
INTEGRAL = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
_NO_LITERAL = object()


def is_integral(t) -> bool:
    return type(t) in INTEGRAL


def is_number(t) -> bool:
    return is_integral(t) or isinstance(t, T.DecimalType | T.FloatType | T.DoubleType)


def is_binary(t) -> bool:
    return isinstance(t, T.FloatType | T.DoubleType)


def is_time(t) -> bool:
    return isinstance(t, T.TimestampType | T.TimestampNTZType)


def is_temporal(t) -> bool:
    return isinstance(t, T.DateType) or is_time(t)


def is_text(t) -> bool:
    return isinstance(t, T.StringType)


@dataclass(frozen=True)
class Val:
    col: Column
    type: T.DataType | None
    err: Column | None = None
    value: Any = _NO_LITERAL
    items: tuple[Val, ...] | None = None
    check: Callable[[Column], Column] | None = None  # error that shows in the value itself, once it has a column

    @property
    def is_literal(self) -> bool:
        return self.value is not _NO_LITERAL

    def failing(self, *errors: Column | None) -> Val:
        """The same value with further errors behind its own."""
        return replace(self, err=first_error(self.err, *errors))


def first_error(*errors: Column | None) -> Column | None:
    found = [e for e in errors if e is not None]
    return F.coalesce(*found) if len(found) > 1 else found[0] if found else None


def error(kind: str, *parts: str | Column) -> Column:
    """``"Kind: text"`` from literal and computed parts; a null part shows as None."""
    shown = [F.coalesce(p, F.lit("None")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(F.lit(f"{kind}: "), *shown)


def common_type(a, b):
    """The type that holds both exactly, or None; text never stands in for anything else."""
    if a is None or b is None or a == b:
        return a or b if a != b or a is None else a
    if is_integral(a) and is_integral(b):
        return a if INTEGRAL[type(a)] >= INTEGRAL[type(b)] else b
    if is_number(a) and is_number(b):
        if is_binary(a) or is_binary(b):
            return None if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType) else T.DoubleType()
        parts = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else ({7: 3, 15: 5, 31: 10, 63: 19}[INTEGRAL[type(t)]], 0) for t in (a, b)]
        whole, scale = max(p[0] for p in parts), max(p[1] for p in parts)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = common_type(a.elementType, b.elementType)
        return None if inner is None else T.ArrayType(inner, True)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.fieldNames() == b.fieldNames():
        inner = [common_type(x.dataType, y.dataType) for x, y in zip(a.fields, b.fields, strict=True)]
        return None if None in inner else T.StructType([T.StructField(n, t, True) for n, t in zip(a.fieldNames(), inner, strict=True)])
    return None


def literal_type(value: Any):
    """The smallest Spark type that holds a literal exactly; None if there's none (nulls, mixed lists)."""
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType() if -(2**63) <= value < 2**63 else T.DecimalType(38, 0) if abs(value) < 10**38 else None
    if isinstance(value, Decimal):
        _, digits, exponent = value.normalize().as_tuple()
        scale = max(0, -exponent)
        precision = max(len(digits) + max(0, exponent), scale, 1)
        return T.DecimalType(precision, scale) if precision <= 38 else None
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, dt.datetime):
        return T.TimestampType() if value.tzinfo is not None else T.TimestampNTZType()
    if isinstance(value, dt.date):
        return T.DateType()
    if isinstance(value, list | tuple | set | frozenset):
        kinds = [literal_type(v) for v in value if v is not None]
        if not kinds or None in kinds:
            return None
        inner = reduce(lambda x, y: None if x is None else common_type(x, y), kinds)
        return None if inner is None else T.ArrayType(inner, True)
    if isinstance(value, Mapping):
        kinds = {str(k): literal_type(v) for k, v in value.items()}
        return None if None in kinds.values() or not kinds else T.StructType([T.StructField(k, kinds[k], True) for k in sorted(kinds)])
    return None


def in_order(value) -> list:
    return sorted(value, key=repr) if isinstance(value, set | frozenset) else list(value)


def literal(value: Any, wanted=None) -> Val:
    """A literal; lists keep their items, so that mixed ones can still be compared item by item."""
    kind = wanted or literal_type(value)
    if value is None:
        return Val(F.lit(None) if kind is None else F.lit(None).cast(kind), kind, value=None)
    if isinstance(value, list | tuple | set | frozenset):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else None
        items = tuple(literal(v, inner if v is None or inner is not None else None) for v in in_order(value))
        col = F.array(*[i.col.cast(inner) for i in items]).cast(kind) if inner is not None else F.lit(None)
        return Val(col, kind, value=value, items=items)
    if isinstance(value, Mapping):
        names = {str(k): v for k, v in value.items()}
        if not isinstance(kind, T.StructType):
            return Val(F.lit(None), None, value=value)
        return Val(F.struct(*[literal(names.get(f.name), f.dataType).col.cast(f.dataType).alias(f.name) for f in kind.fields]), kind, value=value)
    if isinstance(value, Decimal):
        return Val(F.lit(format(value, "f")).cast(kind if isinstance(kind, T.DecimalType) else literal_type(value)), kind, value=value)
    if isinstance(value, dt.datetime):
        text = value.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f") + "Z" if value.tzinfo else value.isoformat(sep=" ")
        return Val(F.lit(text).cast(kind), kind, value=value)
    if isinstance(value, dt.date):
        return Val(F.lit(value.isoformat()).cast("date"), kind, value=value)
    if isinstance(value, int) and not isinstance(value, bool):
        return Val(F.lit(str(value)).cast(kind) if abs(value) >= 2**63 else F.lit(value).cast(kind), kind, value=value)
    return Val(F.lit(value), kind, value=value)


# ---- Python's text


def _binary_text(x: Column) -> Column:
    """Python's shortest form from Java's; before Java 19 a few numbers, such as 5e-324, come with a digit more."""
    raw = x.cast("string")
    sign = F.when(raw.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(raw, "^-", "")
    power = F.regexp_extract(body, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"E.*$", ""), r"\.0$", ""), r"\.", "")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    wide = F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0")
    large = F.concat(F.substr(wide, F.lit(1), power + 1), F.lit("."), F.when(F.length(wide) > power + 1, F.substr(wide, power + 2)).otherwise("0"))
    point = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), "0"))
    scientific = F.concat(F.substr(digits, F.lit(1), F.lit(1)), point, F.lit("e"), exponent)
    plain = F.when(power.isNull(), body).when((power < 0) & (power >= -4), small).when((power > 0) & (power < 16), large).otherwise(scientific)
    near = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7) | (x == 0)  # written without exponent on either side
    return F.when(near, raw).when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, plain))


def plain_decimal(x: Column) -> Column:
    """Without exponent, all digits of the scale."""
    return x.cast("string")


def _decimal_text(x: Column, scale: int) -> Column:
    plain = plain_decimal(x)
    if scale <= 6:
        return plain
    digits = F.ltrim(F.regexp_replace(plain, r"[^0-9]", ""), F.lit("0"))
    digits = F.when(digits == "", "0").otherwise(digits)
    power = F.length(digits) - 1 - scale
    point = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    return F.when(power < -6, F.concat(sign, F.substr(digits, F.lit(1), F.lit(1)), point, F.lit("E"), power.cast("string"))).otherwise(plain)


def _time_text(x: Column, between: str) -> Column:
    base = F.date_format(x, f"yyyy-MM-dd'{between}'HH:mm:ss" if between != " " else "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format(x, "SSSSSS")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def text(v: Val) -> Column:
    """``str(value)``; null stays null."""
    t, x = v.type, v.col
    if v.is_literal and isinstance(v.value, Decimal):
        return F.lit(str(v.value))  # with the zeros it was written with
    if t is None:
        return F.lit(None).cast("string")
    if is_text(t):
        return x
    if isinstance(t, T.BooleanType):
        return F.when(x, "True").when(~x, "False")
    if isinstance(t, T.DecimalType):
        return _decimal_text(x, t.scale)
    if is_binary(t):
        return F.when(x.isNotNull(), _binary_text(x.cast("double")))
    if isinstance(t, T.DateType):
        return F.date_format(x, "yyyy-MM-dd")
    if is_time(t):
        return _time_text(x, " ")
    if isinstance(t, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(x, lambda i: F.coalesce(shown(Val(i, t.elementType)), F.lit("None"))), ", "), F.lit("]"))
    return x.cast("string")


def shown(v: Val) -> Column:
    """``repr(value)``."""
    t, x = v.type, v.col
    if is_text(t):
        slashed = x
        for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            slashed = F.replace(slashed, F.lit(plain), F.lit(escaped))
        quote = F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), '"').otherwise("'")
        return F.when(x.isNotNull(), F.concat(quote, slashed, quote))
    if isinstance(t, T.DecimalType):
        return F.concat(F.lit("Decimal('"), text(v), F.lit("')"))  # text keeps a literal's zeros
    if isinstance(t, T.DateType):
        return F.concat(F.lit("datetime.date("), F.concat_ws(", ", F.year(x).cast("string"), F.month(x).cast("string"), F.dayofmonth(x).cast("string")), F.lit(")"))
    return text(v)


def trace_text(v: Val) -> Column:
    """Text as it stands in assignments to text and in audit columns: ISO times, plain decimals, ``k=v`` mappings."""
    t, x = v.type, v.col
    if v.is_literal and isinstance(v.value, Decimal):
        return F.lit(format(v.value, "f"))
    if isinstance(t, T.DecimalType):
        return plain_decimal(x)
    if is_time(t):
        return _time_text(x, "T")
    if isinstance(t, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(x, lambda i: F.coalesce(trace_text(Val(i, t.elementType)), F.lit(""))), ", "), F.lit("]"))
    if isinstance(t, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}="), F.coalesce(trace_text(Val(x.getField(f.name), f.dataType)), F.lit("None"))) for f in t.fields]
        return F.when(x.isNotNull(), F.concat_ws(", ", *parts))
    return text(v)


# ---- Python's numbers

_NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NOT_FINITE = r"(?i)^[+-]?(s?nan\d*|inf|infinity)$"


def _number_text(x: Column) -> Column:
    return F.replace(F.btrim(x, F.lit(WHITESPACE)), F.lit("_"), F.lit(""))


def not_finite(v: Val) -> Column | None:
    """True where the value is NaN or infinite, also as text."""
    if is_binary(v.type):
        return F.isnan(v.col) | (F.abs(v.col) == float("inf"))
    if is_text(v.type):
        return F.regexp_like(_number_text(v.col), F.lit(_NOT_FINITE))
    return None


def number(v: Val) -> Column:
    """``Decimal(str(value))``, null where that isn't a number or exceeds 38 digits."""
    t, x = v.type, v.col
    if is_integral(t):
        return x.cast(T.DecimalType(20, 0))
    if isinstance(t, T.DecimalType):
        return x
    if is_binary(t):
        return x.cast("double").cast("string").try_cast(WIDE)
    if is_text(t):
        cleaned = _number_text(x)
        return F.when(F.regexp_like(cleaned, F.lit(_NUMERIC)), cleaned).try_cast(WIDE)
    return F.lit(None).cast(WIDE)


def is_numeric_text(v: Val) -> Column:
    return F.regexp_like(_number_text(v.col), F.lit(_NUMERIC))
