"""User functions as Arrow UDFs that return a value or the text of its error."""

from __future__ import annotations

import datetime as dt
import math
import traceback
from collections.abc import Callable, Mapping
from decimal import Decimal
from typing import Any

from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.errors import RegistryError
from verdigris.functions.expr import INTEGRAL, Val


def fit(value: Any, t: T.DataType) -> Any:
    """A Python result as a value of Spark type ``t``; raises where it doesn't fit."""
    if value is None:
        return None
    if isinstance(t, T.StringType):
        return value if isinstance(value, str) else format(value, "f") if isinstance(value, Decimal) else value.isoformat() if isinstance(value, dt.date) else str(value)
    if type(t) in INTEGRAL:
        if isinstance(value, bool):
            raise TypeError("Boolean values are not integers.")
        number = int(value)
        if number != Decimal(str(value)):
            raise ValueError(f"Value {value!r} cannot be converted to an integer without losing its fractional component.")
        if not -(2 ** INTEGRAL[type(t)]) <= number < 2 ** INTEGRAL[type(t)]:
            raise OverflowError(f"Value {value!r} is outside the range for {t.simpleString()}.")
        return number
    if isinstance(t, T.DecimalType):
        number = Decimal(str(value))
        fitted = round(number, t.scale) if abs(number) < Decimal(10) ** (t.precision - t.scale) else None
        if fitted is None or fitted != number:
            raise ValueError(f"Value {value!r} does not fit {t.simpleString()} without rounding or overflow.")
        return fitted
    if isinstance(t, T.FloatType | T.DoubleType):
        if not math.isfinite(float(value)):
            raise ValueError("Floating-point values must be finite.")
        return float(value)
    if isinstance(t, T.BooleanType):
        if isinstance(value, bool):
            return value
        raise TypeError(f"Value {value!r} is not a boolean.")
    if isinstance(t, T.TimestampNTZType | T.TimestampType):
        return dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    if isinstance(t, T.DateType):
        return value.date() if isinstance(value, dt.datetime) else dt.date.fromisoformat(value) if isinstance(value, str) else value
    if isinstance(t, T.ArrayType):
        return [fit(v, t.elementType) for v in (sorted(value, key=repr) if isinstance(value, set) else value)]
    if isinstance(t, T.StructType):
        return {f.name: fit(value.get(f.name), f.dataType) for f in t.fields}
    return value


def _plan(v: Val, inputs: list[Column]) -> Callable[[tuple], Any]:
    """How to get an argument from the UDF's inputs."""
    if v.is_literal:
        return lambda row, value=v.value: value
    if v.items is not None:
        parts = [_plan(i, inputs) for i in v.items]
        return lambda row: [p(row) for p in parts]
    at = len(inputs)
    inputs.append(v.col)
    if isinstance(v.type, T.StructType):
        return lambda row: row[at].asDict(recursive=True) if hasattr(row[at], "asDict") else row[at]
    return lambda row: row[at]


def _check_travels(function: Callable) -> None:
    """Raises where a function can't be sent to the workers, before any job starts."""
    try:
        CloudPickleSerializer().dumps(function)
    except Exception as exc:  # noqa: BLE001 - pickling may fail with anything
        raise RegistryError(f"The function {getattr(function, '__name__', function)!r} can't be sent to workers: {type(exc).__name__}: {exc}") from exc


def guarded_udf(function: Callable, t: T.DataType, args: Mapping[str, Val], keep_traceback: bool = False, unreached: Column | None = None):
    """(UDF, its input columns). It isn't called where an argument has already failed or the rule is known not to be reached.

    The result is marked as nondeterministic only so that Spark never duplicates a call; functions should be
    deterministic.
    """
    _check_travels(function)
    inputs: list[Column] = []
    plans = {name: _plan(v, inputs) for name, v in args.items()}
    failed = [v.err.isNotNull() for v in args.values() if v.err is not None]
    guard = F.lit(False) if unreached is None else unreached
    for f in failed:
        guard = guard | f
    inputs.append(guard)

    def run(*row):
        if row[-1]:
            return None, None
        try:
            return fit(function(**{name: plan(row) for name, plan in plans.items()}), t), None
        except Exception as exc:  # noqa: BLE001 - becomes the row's error
            note = f"{type(exc).__name__}: {exc}"
            return None, f"{note}\n{traceback.format_exc()}" if keep_traceback else note

    schema = T.StructType([T.StructField("value", t, True), T.StructField("error", T.StringType(), True)])
    return F.udf(run, schema, useArrow=True).asNondeterministic(), inputs
