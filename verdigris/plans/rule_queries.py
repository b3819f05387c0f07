"""Driver queries of the rule operators, one per operator or function, each with an independent SQL twin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.standard import standard_registry
from verdigris.model import Ruleset
from verdigris.plans.coverage import coverage_counts, no_match_rows
from verdigris.plans.evaluation import evaluate
from verdigris.sources.ruleset_yaml import compile_payload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ALWAYS = {"all": [{"left": {"literal": 1}, "operator": "eq", "right": {"literal": 1}}]}


def ruleset(*rules: dict) -> Ruleset:
    named = [{"rule_id": f"r{i}", "rule_name": f"Rule {i}", **r} for i, r in enumerate(rules, 1)]
    return compile_payload({"ruleset_id": "driver", "ruleset_name": "Driver", "version": "1", "owner": "tests", "owner_department": "tests", "rules": named})


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def flat(df: DataFrame, rules: Ruleset, keys: list[str], **options: Any) -> DataFrame:
    """Keys with the decision's fields as plain columns."""
    out = evaluate(df, rules, key_columns=keys, column_prefix="d", fail_on_error=False, **options)
    targets = [c for t in out.targets for c in (F.col(f"d_assign.{t}.applied").alias(f"{t}_applied"), F.col(f"d_assign.{t}.value").alias(t))]
    return out.results_df.select(*keys, F.col("d_error").alias("error"), F.col("d_matched").alias("matched"), F.array_join("d_matched_rule_ids", ",").alias("ids"), *targets)


def query(name: str, sql: str | None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return keep


KEYS = {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "part": ["p_partkey"], "customer": ["c_custkey"], "events": ["event_id"], "source_rows": ["row_id", "loaded_at"]}


# ---- comparisons: one condition, the rows with their verdict


def comparison(name: str, table: str, left: Any, operator: str, right: Any, sql: str, **more: Any) -> None:
    operand = lambda v: v if isinstance(v, dict) else {"field": v}
    condition = {"left": operand(left), "operator": operator, **({"right": right} if right is not None else {}), **more}
    keys = KEYS[table]

    def build(spark: SparkSession, folder: str) -> DataFrame:
        return flat(read(spark, folder, table), ruleset({"when": {"all": [condition]}, "assign": {"hit": True}}), keys).select(*keys, "matched")

    query(f"cmp_{name}", f"select {', '.join(keys)}, coalesce({sql}, false) as matched from {table}")(build)


lit = lambda v, t=None: {"literal": v} | ({"value_type": t} if t else {})
comparison("eq", "lineitem", "l_returnflag", "eq", lit("R"), "l_returnflag = 'R'")
comparison("eq_number_text", "source_rows", "balance_text", "eq", {"field": "amount"}, "try_cast(case when regexp_full_match(replace(trim(balance_text), '_', ''), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then replace(trim(balance_text), '_', '') end as decimal(38,18)) = amount")
comparison("ne", "source_rows", "status", "ne", lit("OPEN"), "status <> 'OPEN'")
comparison("gt", "lineitem", "l_quantity", "gt", lit(40), "l_quantity > 40")
comparison("ge", "orders", "o_totalprice", "ge", lit("150000.5", "decimal"), "o_totalprice >= 150000.5")
comparison("lt", "source_rows", "amount", "lt", lit(100), "amount < 100")
comparison("le", "lineitem", "l_shipdate", "le", lit("1997-06-30T00:00:00", "timestamp_ntz"), "l_shipdate <= timestamp '1997-06-30'")
comparison("in", "customer", "c_mktsegment", "in", lit(["BUILDING", "FURNITURE", None]), "c_mktsegment in ('BUILDING', 'FURNITURE')")
comparison("not_in", "source_rows", "bucket", "not_in", lit(["north", None]), "bucket <> 'north'")
comparison("in_column", "source_rows", lit("watch"), "in", {"field": "tags"}, "list_contains(tags, 'watch')")
comparison("between", "part", "p_size", "between", lit([10, 20]), "p_size between 10 and 20")
comparison("not_between", "source_rows", "funded_date", "not_between", lit(["2018-01-01", "2020-12-31"], "date"), "not (funded_date between date '2018-01-01' and date '2020-12-31')")
comparison("like", "part", "p_name", "like", lit("%l_ w%"), "p_name like '%l_ w%'")
comparison("not_like", "orders", "o_orderpriority", "not_like", lit("_-H%"), "o_orderpriority not like '_-H%'")
comparison("contains", "events", "props", "contains", lit("7"), "contains(props, '7')")
comparison("not_contains", "source_rows", "balance_text", "not_contains", lit("."), "not contains(balance_text, '.')")
comparison("starts_with", "source_rows", "account", "starts_with", lit("AC-00"), "starts_with(account, 'AC-00')")
comparison("ends_with", "part", "p_brand", "ends_with", lit("3"), "ends_with(p_brand, '3')")
comparison("is_null", "source_rows", "maturity_date", "is_null", None, "maturity_date is null")
comparison("is_not_null", "source_rows", "status", "is_not_null", None, "status is not null")
comparison("tolerance", "lineitem", "l_discount", "eq", lit("0.05", "decimal"), "l_discount between 0.04 and 0.06", tolerance_abs="0.01")
comparison("tolerance_fields", "lineitem", "l_discount", "le", {"field": "l_tax"}, "cast(l_discount as decimal(18,6)) <= cast(l_tax as decimal(18,6)) + 0.02", tolerance_abs="0.02")
comparison("field_field", "source_rows", "maturity_date", "lt", {"field": "funded_date"}, "maturity_date < funded_date")


# ---- logic and flow


@query(
    "rules_size_band",
    """select l_orderkey, l_linenumber, l_quantity > 40 or l_returnflag = 'R' as matched, case when l_quantity > 40 then 'r1' when l_returnflag = 'R' then 'r2' else '' end as ids,
       l_quantity > 40 or l_returnflag = 'R' as size_band_applied, case when l_quantity > 40 then 'large' when l_returnflag = 'R' then 'returned' end as size_band from lineitem""",
)
def rules_size_band(spark: SparkSession, folder: str) -> DataFrame:
    rules = ruleset(
        {"when": {"all": [{"left": {"field": "l_quantity"}, "operator": "gt", "right": lit(40)}]}, "assign": {"size_band": "large"}, "stop_on_match": True},
        {"when": {"all": [{"left": {"field": "l_returnflag"}, "operator": "eq", "right": lit("R")}]}, "assign": {"size_band": "returned"}},
    )
    return flat(read(spark, folder, "lineitem"), rules, KEYS["lineitem"]).drop("error")


def flow(name: str, table: str, rules: list[dict], sql: str, columns: list[str]) -> None:
    keys = KEYS[table]

    def build(spark: SparkSession, folder: str) -> DataFrame:
        return flat(read(spark, folder, table), ruleset(*rules), keys).select(*keys, *columns)

    query(name, sql)(build)


def cond(left: Any, operator: str, right: Any = None, **more: Any) -> dict:
    return {"left": left if isinstance(left, dict) else {"field": left}, "operator": operator, **({} if right is None else {"right": right if isinstance(right, dict) else lit(right)}), **more}


flow(
    "all_any_nested",
    "orders",
    [{"when": {"all": [cond("o_totalprice", "gt", 100000), {"any": [cond("o_orderstatus", "eq", "F"), {"all": [cond("o_orderpriority", "like", "1%"), cond("o_custkey", "lt", 500)]}]}]}, "assign": {"x": 1}}],
    "select o_orderkey, o_totalprice > 100000 and (o_orderstatus = 'F' or (o_orderpriority like '1%' and o_custkey < 500)) as matched from orders",
    ["matched"],
)
flow(
    "inactive_condition",
    "orders",
    [{"when": {"any": [cond("o_orderstatus", "eq", "F", active_flag=False), cond("o_orderstatus", "eq", "O")]}, "assign": {"x": 1}}],
    "select o_orderkey, o_orderstatus = 'O' as matched from orders",
    ["matched"],
)
flow(
    "multi_match_merge",
    "orders",
    [
        {"when": {"all": [cond("o_totalprice", "gt", 50000)]}, "assign": {"band": "mid", "seen": True}},
        {"when": {"all": [cond("o_totalprice", "gt", 150000)]}, "assign": {"band": "high"}},
        {"when": {"all": [cond("o_orderstatus", "eq", "P")]}, "assign": {"band": "pending"}},
    ],
    """select o_orderkey, concat_ws(',', case when o_totalprice > 50000 then 'r1' end, case when o_totalprice > 150000 then 'r2' end, case when o_orderstatus = 'P' then 'r3' end) as ids,
       case when o_orderstatus = 'P' then 'pending' when o_totalprice > 150000 then 'high' when o_totalprice > 50000 then 'mid' end as band,
       o_totalprice > 50000 as seen_applied, case when o_totalprice > 50000 then true end as seen from orders""",
    ["ids", "band", "seen_applied", "seen"],
)
flow(
    "stop_on_match",
    "orders",
    [
        {"when": {"all": [cond("o_orderstatus", "eq", "F")]}, "assign": {"a": 1}},
        {"when": {"all": [cond("o_totalprice", "gt", 100000)]}, "assign": {"a": 2}, "stop_on_match": True},
        {"when": {"all": [cond("o_custkey", "ge", 0)]}, "assign": {"a": 3}},
    ],
    """select o_orderkey, concat_ws(',', case when o_orderstatus = 'F' then 'r1' end, case when o_totalprice > 100000 then 'r2' else 'r3' end) as ids,
       cast(case when o_totalprice > 100000 then 2 else 3 end as bigint) as a from orders""",
    ["ids", "a"],
)
flow(
    "assigned_chain",
    "source_rows",
    [
        {"when": {"all": [cond("amount", "gt", 100)]}, "assign": {"stage": "big"}},
        {"when": {"all": [cond({"assigned": "stage"}, "eq", "big"), cond("status", "eq", "OPEN")]}, "assign": {"stage": "open", "note": {"custom_function": {"name": "concat_ws", "args": {"values": [{"assigned": "stage"}, {"field": "account"}], "separator": ":"}}}}},
        {"when": {"all": [cond({"assigned": "stage"}, "eq", "open")]}, "assign": {"done": True}},
    ],
    """select row_id, loaded_at, case when amount > 100 and status = 'OPEN' then 'open' when amount > 100 then 'big' end as stage,
       case when amount > 100 and status = 'OPEN' then concat_ws(':', 'big', account) end as note, coalesce(amount > 100 and status = 'OPEN', false) as done_applied from source_rows""",
    ["stage", "note", "done_applied"],
)
flow(
    "atomic_snapshot",
    "orders",
    [{"when": ALWAYS, "assign": {"a": "one", "b": "two"}}, {"when": ALWAYS, "assign": {"a": {"assigned": "b"}, "b": {"assigned": "a"}}}],
    "select o_orderkey, 'two' as a, 'one' as b from orders",
    ["a", "b"],
)
flow(
    "default_if_null",
    "source_rows",
    [{"when": {"all": [cond({"field": "status", "default_if_null": "NONE"}, "eq", "NONE")]}, "assign": {"amount_or_zero": {"field": "amount", "default_if_null": 0}, "copied": {"field": "status"}}}],
    "select row_id, loaded_at, coalesce(status, 'NONE') = 'NONE' as matched, case when coalesce(status, 'NONE') = 'NONE' then coalesce(amount, 0) end as amount_or_zero, coalesce(status, 'NONE') = 'NONE' as copied_applied, case when status = 'NONE' then status end as copied from source_rows",
    ["matched", "amount_or_zero", "copied_applied", "copied"],
)
flow(
    "error_quarantine",
    "source_rows",
    [{"when": ALWAYS, "assign": {"a": 1}}, {"when": {"all": [cond("status", "eq", "OPEN", error_on_null=True)]}, "assign": {"a": 2}}],
    """select row_id, loaded_at, case when status is null then 'ValueError: Null operand encountered with error_on_null=true.' end as error, status is not null as matched,
       case when status is null then '' when status = 'OPEN' then 'r1,r2' else 'r1' end as ids, status is not null as a_applied, cast(case when status is null then null when status = 'OPEN' then 2 else 1 end as bigint) as a from source_rows""",
    ["error", "matched", "ids", "a_applied", "a"],
)
flow(
    "explicit_null_assign",
    "orders",
    [{"when": {"all": [cond("o_orderstatus", "eq", "F")]}, "assign": [{"target_field": "note", "value": lit(None, "string")}]}],
    "select o_orderkey, o_orderstatus = 'F' as note_applied, cast(null as varchar) as note from orders",
    ["note_applied", "note"],
)


@query(
    "apply_assignments",
    """select o_orderkey, o_custkey, case when o_totalprice > 200000 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       case when o_totalprice > 200000 then 'large' end as band from orders""",
)
def apply_assignments(spark: SparkSession, folder: str) -> DataFrame:
    rules = ruleset({"when": {"all": [cond("o_totalprice", "gt", 200000)]}, "assign": {"o_orderstatus": "X", "band": "large"}})
    return evaluate(read(spark, folder, "orders"), rules).apply_assignments()


@query(
    "struct_assign",
    "select o_orderkey, o_orderstatus = 'F' as applied, case when o_orderstatus = 'F' then 'f' end as code, cast(case when o_orderstatus = 'F' then 7 end as bigint) as level from orders",
)
def struct_assign(spark: SparkSession, folder: str) -> DataFrame:
    rules = ruleset({"when": {"all": [cond("o_orderstatus", "eq", "F")]}, "assign": {"box": lit({"level": 7, "code": "f"})}})
    out = evaluate(read(spark, folder, "orders"), rules, key_columns=["o_orderkey"], column_prefix="d").results_df
    return out.select("o_orderkey", F.col("d_assign.box.applied").alias("applied"), F.col("d_assign.box.value.code").alias("code"), F.col("d_assign.box.value.level").alias("level"))


# ---- functions: one call, its value per row


def function(name: str, table: str, args: dict, sql: str, suffix: str = "", decimal: bool = False) -> None:
    keys = KEYS[table]
    call = {"custom_function": {"name": name, "args": args}}

    def build(spark: SparkSession, folder: str) -> DataFrame:
        return flat(read(spark, folder, table), ruleset({"when": ALWAYS, "assign": {"out": call}}), keys).select(*keys, "out")

    query(f"fn_{name}{suffix}", f"select {', '.join(keys)}, {f'cast({sql} as decimal(38,18))' if decimal else sql} as out from {table}")(build)


f = lambda n: {"field": n}
P, S = "p_name", "balance_text"
function("substring", "part", {"value": f(P), "start": 2, "length": 4}, "substring(p_name, 2, 4)")
function("substring", "part", {"value": f(P), "start": -3}, "p_name", "_clamped")
function("left", "part", {"value": f(P), "length": 3}, "left(p_name, 3)")
function("right", "part", {"value": f(P), "length": 3}, "right(p_name, 3)")
function("trim", "source_rows", {"value": f(S)}, "trim(balance_text, ' \t\n\r')")
function("ltrim", "source_rows", {"value": f(S)}, "ltrim(balance_text, ' \t\n\r')")
function("rtrim", "source_rows", {"value": f(S)}, "rtrim(balance_text, ' \t\n\r')")
function("upper", "part", {"value": f(P)}, "upper(p_name)")
function("lower", "customer", {"value": f("c_name")}, "lower(c_name)")
function("normalize_whitespace", "source_rows", {"value": f(S)}, "regexp_replace(trim(balance_text, ' \t\n\r'), '\\s+', ' ', 'g')")
function("text_length", "part", {"value": f(P)}, "length(p_name)")
function("replace", "part", {"value": f(P), "old": "widget", "new": "gadget"}, "replace(p_name, 'widget', 'gadget')")
function("split_part", "part", {"value": f(P), "delimiter": " ", "part": 2}, "string_split(p_name, ' ')[2]")
function("pad_left", "part", {"value": f(P), "length": 8, "pad": "*"}, "case when length(p_name) >= 8 then right(p_name, 8) else lpad(p_name, 8, '*') end")
function("pad_right", "part", {"value": f(P), "length": 14, "pad": "ab"}, "rpad(p_name, 14, 'ab')")
function("concat_ws", "source_rows", {"values": [f("status"), f("bucket"), f("amount")], "separator": "|"}, "concat_ws('|', status, bucket, cast(amount as varchar))")
function("regex_extract", "part", {"value": f("p_brand"), "pattern": "Brand#(\\d)(\\d*)", "group": 2}, "case when regexp_matches(p_brand, 'Brand#\\d') then regexp_extract(p_brand, 'Brand#(\\d)(\\d*)', 2) end")
function("regex_replace", "part", {"value": f("p_brand"), "pattern": "([A-Z])\\w+#", "replacement": "\\1-"}, "regexp_replace(p_brand, '([A-Z])\\w+#', '\\1-', 'g')")
function("regex_match", "part", {"value": f(P), "pattern": "^[a-m].*t$"}, "regexp_matches(p_name, '^[a-m].*t$')")
function("text_contains_any", "part", {"value": f(P), "candidates": ["cold", "small", None]}, "contains(p_name, 'cold') or contains(p_name, 'small')")
function("is_blank", "source_rows", {"value": f(S)}, "balance_text is null or trim(balance_text, ' \t\n\r') = ''")
function("null_if", "orders", {"value": f("o_orderstatus"), "compare_to": "F"}, "nullif(o_orderstatus, 'F')")
function("coalesce", "source_rows", {"values": [f("status"), f("bucket"), "none"]}, "coalesce(status, bucket, 'none')")
function("to_string", "source_rows", {"value": f("source_timestamp")}, "case when microsecond(source_timestamp) % 1000000 = 0 then strftime(source_timestamp, '%Y-%m-%dT%H:%M:%S') else strftime(source_timestamp, '%Y-%m-%dT%H:%M:%S.%f') end")
NUMERIC_SQL = "case when regexp_full_match(replace(trim(balance_text), '_', ''), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(replace(trim(balance_text), '_', '') as decimal(38,18)) end"
function("to_decimal", "source_rows", {"value": f(S), "on_error": "null"}, NUMERIC_SQL)
function("to_integer", "source_rows", {"value": f(S), "on_error": "null"}, f"cast(case when {NUMERIC_SQL} = floor({NUMERIC_SQL}) then {NUMERIC_SQL} end as bigint)")
function("to_boolean", "source_rows", {"value": f("status"), "on_error": "null"}, "case when lower(trim(status)) in ('true','t','yes','y','1') then true when lower(trim(status)) in ('false','f','no','n','0') then false end")
function("to_date", "orders", {"value": f("o_orderdate")}, "cast(o_orderdate as date)")
function("to_timestamp_ntz", "events", {"value": f("ts")}, "ts")
PRICE, DISC, QTY = f("l_extendedprice"), f("l_discount"), f("l_quantity")
D = lambda c: f"cast({c} as decimal(18,4))"
function("decimal_abs", "customer", {"value": f("c_acctbal")}, "abs(cast(c_acctbal as decimal(18,4)))", decimal=True)
function("decimal_add", "lineitem", {"left": PRICE, "right": DISC}, f"{D('l_extendedprice')} + {D('l_discount')}", decimal=True)
function("decimal_subtract", "lineitem", {"left": DISC, "right": PRICE}, f"{D('l_discount')} - {D('l_extendedprice')}", decimal=True)
function("decimal_multiply", "lineitem", {"left": PRICE, "right": DISC}, f"{D('l_extendedprice')} * {D('l_discount')}", decimal=True)
DIVIDED = "cast((2 * cast(round(l_extendedprice * 100) as hugeint) * 10000 + cast(round(l_quantity) as hugeint) * 100) // (2 * cast(round(l_quantity) as hugeint) * 100) as decimal(38,0)) * 0.0001"
function("decimal_divide", "lineitem", {"numerator": PRICE, "denominator": QTY, "scale": 4}, DIVIDED, decimal=True)
function("decimal_safe_divide", "lineitem", {"numerator": f("l_linenumber"), "denominator": {"literal": 0}}, "null", decimal=True)
function("decimal_round", "lineitem", {"value": PRICE, "scale": 1, "rounding_mode": "half_even"}, "(case when cast(round(l_extendedprice * 100) as bigint) % 10 = 5 then (cast(round(l_extendedprice * 100) as bigint) // 10 + (cast(round(l_extendedprice * 100) as bigint) // 10) % 2) else (cast(round(l_extendedprice * 100) as bigint) + 5) // 10 end) * cast(0.1 as decimal(2,1))", decimal=True)
function("decimal_clamp", "lineitem", {"value": QTY, "minimum": 10, "maximum": 30}, "cast(greatest(least(l_quantity, 30), 10) as decimal(18,4))", decimal=True)
function("decimal_min", "lineitem", {"left": DISC, "right": f("l_tax")}, "cast(least(l_discount, l_tax) as decimal(18,4))", decimal=True)
function("decimal_max", "lineitem", {"left": DISC, "right": f("l_tax")}, "cast(greatest(l_discount, l_tax) as decimal(18,4))", decimal=True)
FD, MD = f("funded_date"), f("maturity_date")
function("date_add_days", "source_rows", {"value": FD, "days": 45}, "cast(funded_date + 45 as date)")
function("date_add_months", "source_rows", {"value": FD, "months": 13}, "cast(funded_date + interval 13 month as date)")
function("date_add_years", "source_rows", {"value": FD, "years": -4}, "cast(funded_date - interval 48 month as date)")
function("date_diff_days", "source_rows", {"start": FD, "end": MD}, "date_diff('day', funded_date, maturity_date)")
_months = lambda a, b: f"(date_diff('month', {a}, {b}) - case when cast({a} + to_months(cast(date_diff('month', {a}, {b}) as integer)) as date) > {b} then 1 else 0 end)"
_years = lambda a, b: f"(date_diff('year', {a}, {b}) - case when cast({a} + to_months(cast(12 * date_diff('year', {a}, {b}) as integer)) as date) > {b} then 1 else 0 end)"
function("date_diff_months", "source_rows", {"start": FD, "end": MD}, f"case when maturity_date >= funded_date then {_months('funded_date', 'maturity_date')} else -{_months('maturity_date', 'funded_date')} end")
function("date_diff_years", "source_rows", {"start": FD, "end": MD}, f"case when maturity_date >= funded_date then {_years('funded_date', 'maturity_date')} else -{_years('maturity_date', 'funded_date')} end")
for part, expr in {"year": "year(funded_date)", "quarter": "quarter(funded_date)", "month": "month(funded_date)", "day": "day(funded_date)", "day_of_week": "isodow(funded_date)", "day_of_year": "dayofyear(funded_date)"}.items():
    function("date_part", "source_rows", {"value": FD, "part": part}, expr, f"_{part}")
function("month_start", "source_rows", {"value": FD}, "cast(date_trunc('month', funded_date) as date)")
function("month_end", "source_rows", {"value": FD}, "last_day(funded_date)")
function("quarter_start", "source_rows", {"value": FD}, "cast(date_trunc('quarter', funded_date) as date)")
function("quarter_end", "source_rows", {"value": FD}, "cast(date_trunc('quarter', funded_date) + interval 3 month - interval 1 day as date)")
function("year_start", "source_rows", {"value": FD}, "cast(date_trunc('year', funded_date) as date)")
function("year_end", "source_rows", {"value": FD}, "make_date(year(funded_date), 12, 31)")
HOLIDAYS = ["2020-01-01", "2020-01-02", "2019-12-31"]
_open = "list_filter(list_transform(range(0, day(last_day(funded_date))), lambda i: cast(date_trunc('month', funded_date) + to_days(cast(i as integer)) as date)), lambda d: isodow(d) < 6 and d not in (date '2020-01-01', date '2020-01-02', date '2019-12-31'))"
function("first_business_day_of_month", "source_rows", {"value": FD, "holidays": HOLIDAYS}, f"{_open}[1]")
function("last_business_day_of_month", "source_rows", {"value": FD, "holidays": HOLIDAYS}, f"{_open}[-1]")
function("array_size", "source_rows", {"values": f("tags")}, "len(tags)")
function("array_contains_any", "source_rows", {"values": f("tags"), "candidates": ["watch", "bulk"]}, "list_has_any(tags, ['watch', 'bulk'])")
function("array_contains_all", "source_rows", {"values": f("tags"), "candidates": ["watch", "manual"]}, "list_has_all(tags, ['watch', 'manual'])")
function("array_join", "source_rows", {"values": f("tags"), "separator": "+"}, "case when tags is not null then coalesce(array_to_string(tags, '+'), '') end")

KEYS["ruleset_versions"] = ["ruleset_id", "version", "published_at"]
_OFFSET = "regexp_full_match(trim(published_at), '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})')"


@query("fn_to_timestamp", f"select ruleset_id, version, published_at, case when {_OFFSET} then epoch_us(cast(trim(published_at) as timestamptz)) end as out from ruleset_versions")
def fn_to_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    call = {"custom_function": {"name": "to_timestamp", "args": {"value": f("published_at"), "on_error": "null"}}}
    keys = KEYS["ruleset_versions"]
    return flat(read(spark, folder, "ruleset_versions"), ruleset({"when": ALWAYS, "assign": {"out": call}}), keys).select(*keys, F.unix_micros("out").alias("out"))


# ---- user functions, reports, audit, scale


@query("user_function", "select o_orderkey, cast(length(o_orderpriority) * 2 as bigint) as out from orders")
def user_function(spark: SparkSession, folder: str) -> DataFrame:
    from verdigris.functions.registry import ArgSpec, FunctionSpec

    registry = standard_registry()
    registry.register(FunctionSpec("double_length", "driver.double_length", (ArgSpec("value"),), return_type_hint="integer"), lambda value: 2 * len(value))
    rules = ruleset({"when": ALWAYS, "assign": {"out": {"custom_function": {"name": "double_length", "args": {"value": f("o_orderpriority")}}}}})
    return flat(read(spark, folder, "orders"), rules, KEYS["orders"], registry=registry).select("o_orderkey", "out")


COVERED = ruleset(
    {"when": {"all": [cond("o_totalprice", "gt", 150000)]}, "assign": {"x": 1}},
    {"when": {"all": [cond("o_orderstatus", "eq", "F")]}, "assign": {"x": 2}, "stop_on_match": True},
    {"when": {"all": [cond("o_orderstatus", "eq", "nothing")]}, "assign": {"x": 3}},
)


@query(
    "coverage_report",
    """select count(*) total, count(*) filter (not (o_totalprice > 150000 or o_orderstatus = 'F')) no_match, cast(0 as bigint) as error, count(*) filter (o_totalprice > 150000) m0, count(*) filter (o_totalprice > 150000) f0,
       count(*) filter (o_orderstatus = 'F') m1, count(*) filter (o_orderstatus = 'F' and o_totalprice <= 150000) f1, cast(0 as bigint) m2, cast(0 as bigint) f2 from orders""",
)
def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    return coverage_counts(read(spark, folder, "orders"), COVERED)


@query("coverage_no_match", "select o_orderkey from orders where not (o_totalprice > 150000 or o_orderstatus = 'F')")
def coverage_no_match(spark: SparkSession, folder: str) -> DataFrame:
    return no_match_rows(read(spark, folder, "orders"), COVERED).select("o_orderkey")


AUDITED = ruleset(
    {"when": {"all": [cond("o_totalprice", "gt", 50000)]}, "assign": {"o_orderstatus": "A"}},
    {"when": {"any": [cond("o_totalprice", "gt", 150000), cond({"assigned": "o_orderstatus"}, "is_null")]}, "assign": {"o_orderstatus": "B"}},
)


@query(
    "audit_assignment_results",
    """select o_orderkey, 'r1' rule_id, o_orderstatus old_value, 'A' proposed_value, o_orderstatus <> 'A' changed, case when o_totalprice > 150000 then 'r2' end overridden_by_rule_id,
         o_totalprice <= 150000 effective, case when o_totalprice > 150000 then 'r2' else 'r1' end final_winning_rule_id from orders where o_totalprice > 50000
       union all select o_orderkey, 'r2', case when o_totalprice > 50000 then 'A' else o_orderstatus end, 'B', case when o_totalprice > 50000 then true else o_orderstatus <> 'B' end, null, true, 'r2' from orders where o_totalprice > 150000 or o_totalprice <= 50000""",
)
def audit_assignment_results(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate(read(spark, folder, "orders"), AUDITED, column_prefix="d", full_audit=True).attached_df
    event = F.explode("d_assignment_results").alias("e")
    return out.select("o_orderkey", event).select("o_orderkey", *[F.col(f"e.{c}") for c in ("rule_id", "old_value", "proposed_value", "changed", "overridden_by_rule_id", "effective", "final_winning_rule_id")])


@query(
    "audit_matched_rules",
    """select o_orderkey, 'r1' rule_id, 'o_totalprice > 50000' explanation, cast(1 as bigint) n_conditions from orders where o_totalprice > 50000
       union all select o_orderkey, 'r2', case when o_totalprice > 150000 then 'o_totalprice > 150000' else 'assigned(o_orderstatus) is null' end, 2 from orders where o_totalprice > 150000 or o_totalprice <= 50000""",
)
def audit_matched_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate(read(spark, folder, "orders"), AUDITED, column_prefix="d", full_audit=True).attached_df
    return out.select("o_orderkey", F.explode("d_matched_rules").alias("m")).select("o_orderkey", "m.rule_id", "m.explanation", F.size("m.conditions").cast("bigint").alias("n_conditions"))


N_RULES = 141
MANY = ruleset(*[{"when": {"all": [cond("l_linenumber", "eq", 1 + i % 7), cond("l_suppkey", "eq", i)]}, "assign": {"band": f"b{i}"}, "stop_on_match": True} for i in range(N_RULES)])


@query(
    "rules_141_first_match",
    f"select l_orderkey, l_linenumber, case when l_suppkey < {N_RULES} and l_linenumber = 1 + l_suppkey % 7 then 'r' || cast(l_suppkey + 1 as varchar) else '' end as ids, case when l_suppkey < {N_RULES} and l_linenumber = 1 + l_suppkey % 7 then 'b' || cast(l_suppkey as varchar) end as band from lineitem",
)
def rules_141_first_match(spark: SparkSession, folder: str) -> DataFrame:
    return flat(read(spark, folder, "lineitem"), MANY, KEYS["lineitem"]).select("l_orderkey", "l_linenumber", "ids", "band")


__all__ = ["Decimal", "QUERIES", "SQL", "dt"]
