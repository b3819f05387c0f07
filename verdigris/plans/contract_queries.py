"""Driver queries of the operators around the rules: documents, checks, options, temporal comparisons, coercion, traces.

Queries over documents and contracts read no table: their rows say what the library made of authored rulesets, and
the SQL twin states the expected rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.errors import RulesError
from verdigris.functions.standard import standard_registry, standard_rows
from verdigris.model import Ruleset
from verdigris.plans.checks import check_ruleset
from verdigris.plans.describe import authoring_manifest, describe_rules
from verdigris.plans.evaluation import evaluate, result_field_names
from verdigris.plans.rule_queries import ALWAYS, AUDITED, COVERED, KEYS, MANY, cond, f, flat, lit, read, ruleset
from verdigris.plans.typing import check_against_schema
from verdigris.session import materialise, shared_folder
from verdigris.sources.ruleset_export import content_hash, export_yaml, payload_json, read_payload, summary_counts
from verdigris.sources.ruleset_yaml import compile_payload, compile_yaml
from verdigris.sources.store import RulesetStore
from verdigris.streaming.decisions import windowed_coverage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], SQL[name] = build, sql
        return build

    return keep


def flow(name: str, table: str, rules: list[dict], columns: list[str], sql: str) -> None:
    keys = KEYS[table]
    QUERIES[name] = lambda spark, folder: flat(read(spark, folder, table), ruleset(*rules), keys).select(*keys, *columns)
    SQL[name] = f"select {', '.join(keys)}, {sql} from {table}"


def call(name: str, **args: Any) -> dict:
    return {"custom_function": {"name": name, "args": args}}


# ---- comparisons of dates and times

flow("cmp_date_field_order", "source_rows", [{"when": {"all": [cond("maturity_date", "ge", f("funded_date")), cond("funded_date", "gt", lit("2017-06-30", "date"))]}, "assign": {"x": 1}}], ["matched"],
     "coalesce(maturity_date >= funded_date and funded_date > date '2017-06-30', false) as matched")
flow("cmp_date_in", "orders", [{"when": {"all": [cond(call("to_date", value=f("o_orderdate")), "in", lit(["1998-10-03", "1997-05-28", "1999-01-16"], "date"))]}, "assign": {"x": 1}}], ["matched"],
     "cast(o_orderdate as date) in (date '1998-10-03', date '1997-05-28', date '1999-01-16') as matched")
flow("cmp_timestamp_between", "events", [{"when": {"all": [cond("ts", "between", lit(["2024-01-02T00:00:00", "2024-01-03T12:30:00.5"], "timestamp_ntz"))]}, "assign": {"x": 1}}], ["matched"],
     "ts between timestamp '2024-01-02' and timestamp '2024-01-03 12:30:00.5' as matched")
flow("cmp_timestamp_fields", "source_rows", [{"when": {"all": [cond("loaded_at", "gt", f("source_timestamp"))]}, "assign": {"x": 1}}], ["matched"], "coalesce(loaded_at > source_timestamp, false) as matched")
flow("cmp_numeric_text_order", "source_rows", [{"when": {"all": [cond(call("to_decimal", value=f("balance_text"), on_error="null"), "lt", lit("250.5", "decimal"))]}, "assign": {"x": 1}}], ["matched"],
     "coalesce(case when regexp_full_match(replace(trim(balance_text), '_', ''), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(replace(trim(balance_text), '_', '') as decimal(38,18)) end < 250.5, false) as matched")
SQL["cmp_ordered_error"] = "select row_id, loaded_at, status is not null as failed, false as matched from source_rows"
QUERIES["cmp_ordered_error"] = lambda spark, folder: flat(read(spark, folder, "source_rows"), ruleset({"when": {"all": [cond("status", "gt", 5)]}, "assign": {"x": 1}}), KEYS["source_rows"]).select(*KEYS["source_rows"], F.col("error").isNotNull().alias("failed"), "matched")

# ---- regular expressions whose classes, dots and line ends differ between engines

_EDGES = "concat(o_orderpriority, chr(13), '&x', chr(10))"


def edges(name: str, args: dict, sql: str) -> None:
    def build(spark: SparkSession, folder: str) -> DataFrame:
        made = read(spark, folder, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit("\r&x\n")).alias("edge"))
        return flat(made, ruleset({"when": ALWAYS, "assign": {"out": call(name, value=f("edge"), **args)}}), ["o_orderkey"]).select("o_orderkey", "out")

    QUERIES[f"fn_{name}_edges"], SQL[f"fn_{name}_edges"] = build, f"select o_orderkey, {sql} as out from orders"


edges("regex_match", {"pattern": r"^\d-[^\W\d_]+.[a&&b]x$"}, rf"regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$')")
edges("regex_extract", {"pattern": r"([A-Z]+).(?P<tail>[&[]\w)\s\Z", "group": 2}, "'&x'")
edges("regex_replace", {"pattern": r"(\w)-(?=[HLM])|[\s[]+$", "replacement": "<>"}, f"replace(replace(regexp_replace({_EDGES}, '^[0-9]-([HLM])', '<>\\1'), chr(10), '<>'), chr(0), '')")

# ---- coercion into existing targets, defaults, and rulesets of the shape that is shipped

flow("coerce_into_targets", "orders",
     [{"when": ALWAYS, "assign": {"o_totalprice": {"literal": 7}, "o_orderstatus": f("o_orderpriority"), "o_custkey": call("text_length", value=f("o_orderpriority"))}}],
     ["o_totalprice", "o_orderstatus", "o_custkey"], "cast(7 as double) as o_totalprice, o_orderpriority as o_orderstatus, length(o_orderpriority) as o_custkey")
SHAPED = [
    {"when": {"all": [cond("status", "in", ["LIVE", "QUEUED"]), cond("account", "starts_with", "AC-00-0000")]}, "assign": {"leaf": lit({"level_1": "live", "level_2": None})}, "stop_on_match": True},
    {"when": {"all": [cond("status", "ne", "ENDED"), {"any": [cond("bucket", "eq", "north"), {"all": [cond("account", "not_like", "%7"), cond("balance_text", "contains", ".")]}]}]}, "assign": {"leaf": lit({"level_1": "open", "level_2": "mixed"})}, "stop_on_match": True},
    {"when": {"any": [cond("status", "eq", "ENDED"), cond("status", "is_null")]}, "assign": {"leaf": lit({"level_1": None, "level_2": "rest"})}, "stop_on_match": True},
]


@query(
    "rules_shipped_shape",
    """with r as (select row_id, loaded_at, case when status in ('LIVE', 'QUEUED') and starts_with(account, 'AC-00-0000') then 1
         when status <> 'ENDED' and (coalesce(bucket = 'north', false) or coalesce(account not like '%7' and contains(balance_text, '.'), false)) then 2 when status = 'ENDED' or status is null then 3 end k from source_rows)
       select row_id, loaded_at, coalesce('r' || k, '') ids, case k when 1 then 'live' when 2 then 'open' end level_1, case k when 2 then 'mixed' when 3 then 'rest' end level_2 from r""",
)
def rules_shipped_shape(spark: SparkSession, folder: str) -> DataFrame:
    out = flat(read(spark, folder, "source_rows"), ruleset(*SHAPED), KEYS["source_rows"])
    return out.select(*KEYS["source_rows"], "ids", F.col("leaf.level_1").alias("level_1"), F.col("leaf.level_2").alias("level_2"))


# ---- options of the evaluation


@query("results_persisted", "select o_orderkey, o_totalprice > 150000 or o_orderstatus = 'F' as matched from orders")
def results_persisted(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions read from a persisted plan."""
    return evaluate(read(spark, folder, "orders"), COVERED, key_columns=["o_orderkey"], column_prefix="d").persist().results_df.select("o_orderkey", F.col("d_matched").alias("matched"))


@query("results_default_keys", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'driver' as ruleset_id, '1' as version, 64 as hash_length from orders")
def results_default_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Without named keys all input columns are keys; the ruleset's identity stands beside the decision."""
    out = evaluate(read(spark, folder, "orders"), COVERED, column_prefix="d").results_df
    return out.select(*read(spark, folder, "orders").columns, F.col("d_ruleset.id").alias("ruleset_id"), F.col("d_ruleset.version").alias("version"), F.length("d_ruleset.content_hash").alias("hash_length"))


def _raises(action: Callable[[], Any]) -> str:
    try:
        action()
    except (RulesError, TypeError, ValueError) as exc:
        return type(exc).__name__
    return "nothing"


@query(
    "option_errors",
    """select * from (values ('empty keys', 'ValueError'), ('key twice', 'ValueError'), ('key that is a target', 'ValueError'), ('keys as text', 'TypeError'), ('missing key', 'ValueError'), ('flag as number', 'TypeError'),
       ('blank prefix', 'ValueError'), ('sound', 'nothing'), ('missing field', 'ValidationFailed')) as t(option, raised)""",
)
def option_errors(spark: SparkSession, folder: str) -> DataFrame:
    df = read(spark, folder, "orders")
    plain = ruleset({"when": ALWAYS, "assign": {"o_orderstatus": "X"}})
    tries = {
        "empty keys": {"key_columns": []}, "key twice": {"key_columns": ["o_orderkey", "O_ORDERKEY"]}, "key that is a target": {"key_columns": ["o_orderstatus"]}, "keys as text": {"key_columns": "o_orderkey"},
        "missing key": {"key_columns": ["nope"]}, "flag as number": {"full_audit": 1}, "blank prefix": {"column_prefix": " "}, "sound": {},
    }
    rows = [(name, _raises(lambda options=options: evaluate(df, plain, **options))) for name, options in tries.items()]
    rows.append(("missing field", _raises(lambda: evaluate(df, ruleset({"when": {"all": [cond("nope", "eq", 1)]}, "assign": {"x": 1}})))))
    return spark.createDataFrame(rows, "option string, raised string")


@query("result_fields", "select * from (values (0, 'error'), (1, 'matched'), (2, 'matched_rule_ids'), (3, 'assign'), (4, 'matched_rules'), (5, 'assignment_results')) as t(place, name)")
def result_fields(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(result_field_names(True))), "place int, name string")


# ---- documents and contracts

_NAMED = {"audited": AUDITED, "covered": COVERED, "many": MANY, "shaped": ruleset(*SHAPED)}


@query("ruleset_round_trips", "select name, true as yaml_same, true as json_same, true as hash_same from (values ('audited'), ('covered'), ('many'), ('shaped')) as t(name)")
def ruleset_round_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Rulesets written as YAML and as stored JSON come back equal, with the same hash."""
    rows = [(n, compile_yaml(export_yaml(r)) == r, read_payload(payload_json(r)) == r, content_hash(read_payload(payload_json(r))) == content_hash(compile_payload(json.loads(payload_json(r))))) for n, r in _NAMED.items()]
    return spark.createDataFrame(rows, "name string, yaml_same boolean, json_same boolean, hash_same boolean")


@query("ruleset_summaries", "select * from (values ('audited', 2, 3, 2, 0), ('covered', 3, 3, 3, 0), ('many', 141, 282, 141, 0), ('shaped', 3, 8, 3, 0)) as t(name, rule_count, condition_count, assignment_count, custom_function_count)")
def ruleset_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(n, *summary_counts(r).values()) for n, r in _NAMED.items()], "name string, rule_count int, condition_count int, assignment_count int, custom_function_count int")


@query(
    "ruleset_descriptions",
    """select * from (values ('r1', 'status in [''LIVE'', ''QUEUED''] AND account starts with ''AC-00-0000''', 'leaf = {level_1: ''live'', level_2: null}'),
       ('r2', 'status != ''ENDED'' AND (bucket == ''north'' OR (account not like ''%7'' AND balance_text contains ''.''))', 'leaf = {level_1: ''open'', level_2: ''mixed''}'),
       ('r3', 'status == ''ENDED'' OR status is null', 'leaf = {level_1: null, level_2: ''rest''}')) as t(rule_id, rule_logic, match_payload)""",
)
def ruleset_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(r["rule_id"], r["rule_logic"], r["match_payload"]) for r in describe_rules(ruleset(*SHAPED))], "rule_id string, rule_logic string, match_payload string")


@query("authoring_counts", "select * from (values ('argument_type_hints', 12), ('functions', 58), ('logical_operators', 2), ('operand_kinds', 4), ('operators', 18), ('return_type_hints', 17)) as t(part, entries)")
def authoring_counts(spark: SparkSession, folder: str) -> DataFrame:
    manifest = authoring_manifest(standard_registry())
    return spark.createDataFrame([(k, len(v)) for k, v in manifest.items() if k != "value_type_hints"], "part string, entries int")


_BROKEN = {
    "two rules of one id": ruleset({"when": ALWAYS, "assign": {"x": 1}, "rule_id": "q"}, {"when": ALWAYS, "assign": {"y": 1}, "rule_id": "q"}),
    "no producer": ruleset({"when": {"all": [cond({"assigned": "z"}, "eq", 1)]}, "assign": {"x": 1}}),
    "tolerance": ruleset({"when": {"all": [cond("o_custkey", "like", "x", tolerance_abs="1")]}, "assign": {"x": 1}}),
    "unknown function": ruleset({"when": ALWAYS, "assign": {"x": call("nope")}}),
    "missing field": ruleset({"when": {"all": [cond("nope", "eq", 1)]}, "assign": {"x": 1}}),
    "text into number": ruleset({"when": ALWAYS, "assign": {"o_totalprice": "x"}}),
    "date with text": ruleset({"when": {"all": [cond("o_orderdate", "eq", "1998-01-01")]}, "assign": {"x": 1}}),
    "sound": COVERED,
}


@query(
    "validation_findings",
    """select * from (values ('two rules of one id', 'RULE_ID_DUPLICATE'), ('no producer', 'ASSIGNED_VALUE_PRIOR_PRODUCER_REQUIRED'), ('tolerance', 'TOLERANCE_OPERATOR_FORBIDDEN'), ('unknown function', 'CUSTOM_FUNCTION_UNKNOWN'),
       ('missing field', 'SPARK_CONDITION_FIELD_MISSING'), ('text into number', 'SPARK_ASSIGNMENT_TARGET_TYPE_INCOMPATIBLE'), ('date with text', 'SPARK_CONDITION_TEMPORAL_MISMATCH'), ('sound', '')) as t(name, finding)""",
)
def validation_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The first finding of every broken ruleset, with and without a schema."""
    schema, registry, rows = read(spark, folder, "orders").schema, standard_registry(), []
    for name, rules in _BROKEN.items():
        found = check_ruleset(rules, registry).names() or check_against_schema(rules, schema, registry)[0].names()
        rows.append((name, next(iter(found), "")))
    return spark.createDataFrame(rows, "name string, finding string")


# ---- traces

TRACED = ruleset(
    {"when": {"all": [cond("amount", "gt", 100), cond(call("left", value={"field": "status", "default_if_null": "none"}, length=2), "ne", "EN")]}, "assign": {"amount": call("date_part", value=f("funded_date"), part="year"), "maturity_date": f("funded_date")}},
)
_HIT = "amount > 100 and left(coalesce(status, 'none'), 2) <> 'EN'"


def _traced(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate(read(spark, folder, "source_rows"), TRACED, column_prefix="d", full_audit=True).attached_df


@query(
    "audit_value_texts",
    f"""select row_id, loaded_at, 'amount' target_field, 'amount = date_part(value=funded_date, part=''year'')' authored_expression, cast(amount as varchar) old_value, cast(year(funded_date) as varchar) proposed_value, amount is distinct from year(funded_date) changed from source_rows where {_HIT}
        union all select row_id, loaded_at, 'maturity_date', 'maturity_date = funded_date', strftime(maturity_date, '%Y-%m-%d'), strftime(funded_date, '%Y-%m-%d'), maturity_date is distinct from funded_date from source_rows where {_HIT}""",
)
def audit_value_texts(spark: SparkSession, folder: str) -> DataFrame:
    out = _traced(spark, folder).select("row_id", "loaded_at", F.explode("d_assignment_results").alias("e"))
    return out.select("row_id", "loaded_at", *[F.col(f"e.{c}") for c in ("target_field", "authored_expression", "old_value", "proposed_value", "changed")])


@query(
    "audit_argument_summaries",
    f"""select row_id, loaded_at, left(coalesce(status, 'none'), 2) as value, 'status=' || coalesce(status, 'none') as value_argument, '2' as length_argument, 'status' as columns from source_rows where {_HIT}""",
)
def audit_argument_summaries(spark: SparkSession, folder: str) -> DataFrame:
    left = F.col("d_matched_rules")[0].conditions[1].left
    hit = _traced(spark, folder).filter("d_matched")
    return hit.select("row_id", "loaded_at", left.value.alias("value"), left.arguments["value"].alias("value_argument"), left.arguments["length"].alias("length_argument"), F.array_join(left.source_columns, ",").alias("columns"))


@query(
    "coverage_by_window",
    """select time_bucket(interval 1 day, ts) window_start, time_bucket(interval 1 day, ts) + interval 1 day window_end, count(*) n_rows, count(*) filter (not (value > 50 or event_type = 'error')) n_unmatched, cast(0 as bigint) n_errors from events group by 1""",
)
def coverage_by_window(spark: SparkSession, folder: str) -> DataFrame:
    rules = ruleset({"when": {"any": [cond("value", "gt", 50), cond("event_type", "eq", "error")]}, "assign": {"x": 1}})
    decided = evaluate(read(spark, folder, "events"), rules, fail_on_error=False).attached_df
    return windowed_coverage(decided, "ts", "1 day", "1 hour")


# ---- the store of published versions, in a database of its own that is dropped again


def _stored(spark: SparkSession, rows_of: Callable[[RulesetStore], DataFrame]) -> DataFrame:
    database = f"verdigris_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_folder(spark)}/{database}'")
    try:
        store = RulesetStore(spark, f"{database}.versions", f"{database}.functions", "parquet")
        store.create_tables()
        return materialise(rows_of(store), "stored-rows")
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def _version(number: str, rules: Ruleset) -> Ruleset:
    return replace(rules, version=number)


@query(
    "store_versions",
    """select * from (values ('1', 'retired', 2, 3, 'me', 'you', true, 64), ('2', 'published', 2, 3, 'me', null, true, 64)) as t(version, status, rule_count, condition_count, published_by, retired_by, loads, hash_length)""",
)
def store_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions are published, the first is retired, the second is what loads."""

    def rows(store: RulesetStore) -> DataFrame:
        for number in ("1", "2"):
            store.publish(_version(number, AUDITED), "me")
        store.retire("driver", "1", "you")
        same = store.load("Driver") == _version("2", AUDITED)
        versions = spark.table(store.versions_table)
        return versions.select("version", "status", "rule_count", "condition_count", "published_by", "retired_by", F.lit(same).alias("loads"), F.length("content_hash").alias("hash_length"))

    return _stored(spark, rows)


@query("store_refusals", "select * from (values ('create again', 'StoreError'), ('load nothing', 'StoreError'), ('publish again', 'StoreError'), ('retire again', 'StoreError'), ('retire nothing', 'StoreError'), ('unsafe name', 'ValueError')) as t(action, raised)")
def store_refusals(spark: SparkSession, folder: str) -> DataFrame:
    def rows(store: RulesetStore) -> DataFrame:
        store.publish(AUDITED)
        store.retire("driver", "1")
        tries = {
            "create again": store.create_tables, "load nothing": lambda: store.load("Driver"), "publish again": lambda: store.publish(AUDITED), "retire again": lambda: store.retire("driver", "1"),
            "retire nothing": lambda: store.retire("driver", "7"), "unsafe name": lambda: RulesetStore(spark, "a; drop table b"),
        }
        return spark.createDataFrame([(name, _raises(action)) for name, action in tries.items()], "action string, raised string")

    return _stored(spark, rows)


@query("store_functions", "select * from (values ('changed', 1), ('kept', 57), ('new', 1)) as t(state, functions)")
def store_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The standard functions are stored, then one is changed and one is added."""

    def rows(store: RulesetStore) -> DataFrame:
        store.save_functions(standard_rows())
        store.save_functions([{**standard_rows()[0], "description": "changed"}, {**standard_rows()[0], "function_name": "another", "description": "new"}])
        state = F.when(F.col("description").isin("changed", "new"), F.col("description")).otherwise("kept")
        return store.functions().groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("functions"))

    return _stored(spark, rows)
