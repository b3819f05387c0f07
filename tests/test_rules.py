"""Rule semantics against the row-at-a-time evaluator, and the contracts around them."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rowwise import decide

from verdigris import compile_payload, coverage, evaluate
from verdigris.errors import CompileError, RegistryError, ValidationFailed
from verdigris.functions.expr import literal_type
from verdigris.functions.registry import ArgSpec, FunctionRegistry, FunctionSpec
from verdigris.functions.standard import standard_registry
from verdigris.plans.audit import ASSIGNMENT_EVENT, RULE_TRACE
from verdigris.plans.checks import check_ruleset
from verdigris.plans.describe import authoring_manifest, describe_rule, describe_rules, matched_explanation
from verdigris.plans.evaluation import result_field_names
from verdigris.model import Literal, required_columns
from verdigris.plans.typing import check_against_schema, given_by, takes
from verdigris.sources.ruleset_export import CanonicalJson, canonical_json, content_hash, export_yaml, payload_json, read_payload, summary_counts
from verdigris.sources.ruleset_yaml import compile_yaml

BASE = {"ruleset_id": "r", "ruleset_name": "R", "version": "1", "owner": "o", "owner_department": "d"}
ALWAYS = {"all": [{"left": {"literal": 1}, "operator": "eq", "right": {"literal": 1}}]}


def rules(*items, **more):
    return compile_payload({**BASE, "rules": [{"rule_id": f"r{i}", "rule_name": f"n{i}", **r} for i, r in enumerate(items, 1)], **more})


def cond(left, op, right=None, **more):
    return {"left": left if isinstance(left, dict) else {"field": left}, "operator": op, **({} if right is None else {"right": right if isinstance(right, dict) else {"literal": right}}), **more}


SCHEMA = "id int, s string, t string, i int, l bigint, d decimal(12,3), f double, b boolean, day date, ts timestamp_ntz, tags array<string>, nums array<int>"
POOL = {
    "s": [None, "", "a", "A", "7", "007", " 7 ", "7.50", "1e1", "bad", "a_b%", "NaN", "1_0", "x\ny", "-0.001"],
    "t": [None, "a", "7", "b"],
    "i": [None, 0, 1, 7, -3, 10],
    "l": [None, 7, 10, 2**53 + 1],
    "d": [None, Decimal("7.000"), Decimal("7.500"), Decimal("0.001"), Decimal("-3.000")],
    "f": [None, 0.0, 7.0, 7.5, 0.1, 1e20, 1e-7, -3.0],
    "b": [None, True, False],
    "day": [None, dt.date(2024, 2, 29), dt.date(2023, 12, 31)],
    "ts": [None, dt.datetime(2024, 2, 29, 1, 2, 3), dt.datetime(2024, 2, 29, 1, 2, 3, 500)],
    "tags": [None, [], ["a", "b"], ["7", None]],
    "nums": [None, [], [7, 1], [None, 10]],
}


def make_rows(rng, n):
    return [(k, *[rng.choice(v) for v in POOL.values()]) for k in range(n)]


SCALARS = ["s", "t", "i", "l", "d", "f", "b"]


def random_condition(rng):
    kind = rng.random()
    if kind < 0.12:
        return cond(rng.choice(list(POOL)), rng.choice(["is_null", "is_not_null"]))
    if kind < 0.22:
        op = rng.choice(["eq", "ne", "gt", "ge", "lt", "le"])
        name, literal = rng.choice([("day", {"literal": "2024-02-29", "value_type": "date"}), ("ts", {"literal": "2024-02-29T01:02:03", "value_type": "timestamp_ntz"})])
        return cond(name, op, rng.choice([literal, {"field": name}]))
    if kind < 0.35:
        items = rng.choice([["a", "7", None], [7, 10], [Decimal("7.5"), 1], ["bad", 7, True], [None], []])
        return cond(rng.choice(SCALARS), rng.choice(["in", "not_in"]), rng.choice([{"literal": items}, {"field": rng.choice(["tags", "nums"])}]))
    if kind < 0.45:
        return cond(rng.choice(["i", "l", "d", "f", "s"]), rng.choice(["between", "not_between"]), {"literal": rng.choice([[0, 8], [Decimal("0.1"), Decimal("7.5")], ["-3", "7"]])})
    if kind < 0.6:
        return cond(rng.choice(["s", "t", "i", "d", "b", "day", "ts"]), rng.choice(["contains", "not_contains", "starts_with", "ends_with", "like", "not_like"]), rng.choice([{"literal": x} for x in ("7", "a%", "_", "%7%", "Tr", "2024-", "")] + [{"field": "t"}]))
    op = rng.choice(["eq", "ne", "gt", "ge", "lt", "le"])
    more = {"tolerance_abs": rng.choice(["0.5", "0.001"])} if rng.random() < 0.2 else {}
    if rng.random() < 0.1:
        more["error_on_null"] = True
    if rng.random() < 0.1:
        more["active_flag"] = False
    left = {"field": rng.choice(SCALARS)}
    if rng.random() < 0.15:
        left = {"field": rng.choice(["s", "t"]), "default_if_null": "7"}
    right = rng.choice([{"literal": v} for v in (7, "7", "a", Decimal("7.50"), True, Decimal("0.1"), 0)] + [{"field": n} for n in SCALARS])
    return cond(left, op, right, **more)


def random_ruleset(rng):
    made = []
    for k in range(rng.randint(3, 6)):
        members = [random_condition(rng) for _ in range(rng.randint(1, 2))]
        if rng.random() < 0.4:
            members.append({rng.choice(["all", "any"]): [random_condition(rng)]})
        if k and rng.random() < 0.4:
            members.append(cond({"assigned": "x"}, rng.choice(["eq", "is_null", "ne"]), None if (op := rng.random()) < 0 else "v0") if False else cond({"assigned": "x"}, "eq", "v0"))
        value = rng.choice([{"literal": f"v{k}"}, {"field": "t"}] + ([{"assigned": "x", "default_if_null": "none"}] if k else []))
        made.append({"when": {rng.choice(["all", "any"]): members}, "assign": [{"assignment_id": f"x{k}", "target_field": "x", "value": value}, {"assignment_id": f"y{k}", "target_field": "y", "value": {"field": "i"}}], "stop_on_match": rng.random() < 0.2})
    return rules(*made)


@pytest.mark.parametrize("seed", range(14))
def test_decisions_match_the_rowwise_evaluator(spark, seed):
    rng = random.Random(seed)
    rows = make_rows(rng, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    ruleset = random_ruleset(rng)
    while not check_against_schema(ruleset, df.schema, standard_registry())[0].passed:
        ruleset = random_ruleset(rng)
    out = evaluate(df, ruleset, key_columns=["id"], fail_on_error=False).results_df.collect()
    names = [f.name for f in df.schema.fields]
    for r in out:
        error, ids, state = decide(ruleset, dict(zip(names, rows[r.id], strict=True)))
        got = r.rules_assign.asDict(recursive=True)
        assert (r.rules_error, r.rules_matched_rule_ids) == (error, ids), (rows[r.id], describe_rules(ruleset))
        assert got == {t: {"applied": t in state, "value": state.get(t)} for t in got}
        assert r.rules_matched == bool(ids)


@pytest.mark.parametrize(("fold", "n"), [(True, 60), (False, 60), (True, 3)])
def test_first_match_forms_agree(spark, fold, n):
    made = [{"when": {"all": [cond("i", "eq", k % 12)] + ([] if fold else [cond({"field": "s", "default_if_null": "q"}, "ne", "zz")])}, "assign": {"band": f"b{k}"}, "stop_on_match": True} for k in range(n)]
    df = spark.createDataFrame([(k, str(k)) for k in range(14)] + [(None, None)], "i int, s string")
    ruleset = rules(*made)
    got = {r.i: (r.rules_matched_rule_ids, r.rules_assign.band.value) for r in evaluate(df, ruleset).attached_df.collect()}
    for i in [*range(14), None]:
        _, ids, state = decide(ruleset, {"i": i, "s": None if i is None else str(i)})
        assert got[i] == (ids, state.get("band"))


def test_no_python_in_plans_without_user_functions(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    ruleset = rules({"when": {"all": [cond({"custom_function": {"name": "upper", "args": {"value": {"field": "s"}}}}, "eq", "A")]}, "assign": {"x": {"custom_function": {"name": "decimal_divide", "args": {"numerator": {"field": "i"}, "denominator": 3}}}}})
    plan = evaluate(df, ruleset, full_audit=True).attached_df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fail_on_error_is_lazy_and_raises(spark):
    df = spark.createDataFrame([("bad",)], "v string")
    ruleset = rules({"when": {"all": [cond("v", "gt", 1)]}, "assign": {"x": 1}})
    lazy = evaluate(df, ruleset)
    for columns in ("rules_matched", "rules_assign.x.value"):
        with pytest.raises(Exception, match="Row evaluation failed with ValueError: Ordered comparison"):
            lazy.results_df.select(columns).collect()
    row = evaluate(df, ruleset, fail_on_error=False).results_df.first()
    assert row.rules_error.startswith("ValueError") and row.rules_matched is False and row.rules_assign.x.applied is False


def test_keys_prefixes_and_reserved_names(spark):
    df = spark.createDataFrame([(1, "a")], "id int, `risk.score` string")
    ruleset = rules({"when": {"all": [cond("risk.score", "eq", "a")]}, "assign": {"out": {"field": "risk.score"}}})
    got = evaluate(df, ruleset, key_columns=["id"], column_prefix="p")
    assert got.results_df.columns == ["id", *[f"p_{n}" for n in (*result_field_names(), "ruleset", "engine_version")]]
    assert got.apply_assignments().first().asDict() == {"id": 1, "risk.score": "a", "out": "a"}
    assert got.results_df.first().p_ruleset.content_hash == content_hash(ruleset)
    for bad, kind in ((["nope"], ValueError), ("id", TypeError), ([], ValueError), (["id", "ID"], ValueError), ([1], TypeError)):
        with pytest.raises(kind):
            evaluate(df, ruleset, key_columns=bad)
    with pytest.raises(ValueError):
        evaluate(df.withColumnRenamed("id", "RULES_Matched_Rules"), ruleset)
    with pytest.raises(ValueError):
        evaluate(df, ruleset, column_prefix=" ")
    with pytest.raises(TypeError):
        evaluate(df, ruleset, full_audit=1)
    assert evaluate(df.limit(0), ruleset).results_df.count() == 0
    assert required_columns(ruleset) == ["risk.score"] and required_columns(ruleset, True) == ["risk.score", "out"]


def test_apply_keeps_nulls_types_and_order(spark):
    df = spark.createDataFrame([("clear", "orig", 1), ("set", "orig", 2), ("keep", "orig", 3)], "action string, status string, n int")
    ruleset = rules({"when": {"all": [cond("action", "eq", "clear")]}, "assign": {"status": {"literal": None}, "extra": {"literal": None, "value_type": "decimal"}}}, {"when": {"all": [cond("action", "eq", "set")]}, "assign": {"status": "new", "n": 7}})
    out = evaluate(df, ruleset).apply_assignments()
    assert out.columns == ["action", "status", "n", "extra"] and out.schema["n"].dataType == T.IntegerType()
    assert [tuple(r) for r in out.collect()] == [("clear", None, 1, None), ("set", "new", 7, None), ("keep", "orig", 3, None)]
    parts = {r.action: r.rules_assign for r in evaluate(df, ruleset).attached_df.collect()}
    assert parts["clear"].status.applied and parts["clear"].status.value is None and not parts["keep"].status.applied


def test_audit_tells_the_whole_story(spark):
    df = spark.createDataFrame([(1, "orig"), (2, "orig")], "id int, target string")
    ruleset = rules(
        {"when": ALWAYS, "assign": [{"assignment_id": "a1", "target_field": "target", "value": {"literal": "orig"}}]},
        {"when": {"any": [cond("id", "eq", 1), {"all": [cond({"assigned": "target", "default_if_null": "none"}, "eq", "x"), cond("id", "gt", 0, active_flag=False)]}]}, "assign": [{"assignment_id": "a2", "target_field": "target", "value": {"custom_function": {"name": "upper", "args": {"value": {"assigned": "target"}}}}}]},
    )
    got = evaluate(df, ruleset, full_audit=True).attached_df
    assert got.schema["rules_matched_rules"].dataType == T.ArrayType(RULE_TRACE, False) and not got.schema["rules_matched_rules"].nullable
    assert got.schema["rules_assignment_results"].dataType == T.ArrayType(ASSIGNMENT_EVENT, False)
    one, two = sorted(got.collect(), key=lambda r: r.id)
    first, second = one.rules_assignment_results
    assert (first.old_value, first.proposed_value, first.changed, first.overridden_by_assignment_id, first.effective, first.final_winning_rule_id) == ("orig", "orig", False, "a2", False, "r2")
    assert (second.old_value, second.proposed_value, second.changed, second.effective, second.authored_expression) == ("orig", "ORIG", True, True, "target = upper(value=assigned(target))")
    trace = one.rules_matched_rules[1]
    assert trace.explanation == "id == 1" and trace.assignments_applied == ["target"] and len(trace.conditions) == 3
    assert trace.conditions[1].left.produced_by_assignment_id == "a1" and trace.conditions[1].passed is False
    assert trace.conditions[2].active_flag is False and trace.conditions[2].comparison_result is None
    assert [e.effective for e in two.rules_assignment_results] == [True]


def test_user_functions_run_once_per_row_and_report_errors(spark):
    calls = spark.sparkContext.accumulator(0)

    def risky(value, factor=2):
        calls.add(1)
        if value == "bad":
            raise ValueError("no good")
        return Decimal(len(value)) * factor

    registry = standard_registry()
    registry.register(FunctionSpec("risky", "tests.risky", (ArgSpec("value"), ArgSpec("factor", False, 2, "integer")), return_type_hint="decimal"), risky)
    call = {"custom_function": {"name": "risky", "args": {"value": {"field": "v"}}}}
    ruleset = rules({"when": {"all": [cond(call, "gt", 3)]}, "assign": {"x": call, "y": {"custom_function": {"name": "decimal_add", "args": {"left": call, "right": 1}}}}})
    df = spark.createDataFrame([("good",), ("bad",), ("a",)], "v string").coalesce(1)
    got = {r.v: r for r in evaluate(df, ruleset, registry, fail_on_error=False).attached_df.collect()}
    assert got["good"].rules_assign.x.value == 8 and got["good"].rules_assign.y.value == 9
    assert got["bad"].rules_error == "ValueError: no good" and got["a"].rules_matched is False
    assert calls.value <= 9
    with pytest.raises(Exception, match="no good"):
        evaluate(df, ruleset, registry).results_df.collect()


def test_user_functions_are_not_called_behind_a_stop(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(value):
        calls.add(1)
        return value

    registry = standard_registry()
    registry.register(FunctionSpec("seen", "tests.seen", (ArgSpec("value"),), return_type_hint="same_as:value"), seen)
    call = {"custom_function": {"name": "seen", "args": {"value": {"field": "v"}}}}
    early = {"when": {"all": [cond("v", "lt", 90)]}, "assign": {"x": 0}, "stop_on_match": True}
    df = spark.createDataFrame([(i,) for i in range(100)], "v int").coalesce(1)
    out = evaluate(df, rules(early, {"when": {"all": [cond(call, "ge", 0)]}, "assign": {"x": 1}}), registry).apply_assignments()
    assert sum(r.x for r in out.collect()) == 10 and calls.value == 10
    chain = rules(early, {"when": {"all": [cond({"assigned": "x"}, "is_null"), cond(call, "ge", 95)]}, "assign": {"y": call}})
    assert sum(r.y is not None for r in evaluate(df, chain, registry).apply_assignments().collect()) == 5
    assert calls.value == 10 + 20


def test_functions_that_cannot_travel_fail_before_any_job(spark):
    import threading

    lock = threading.Lock()
    registry = standard_registry()
    registry.register(FunctionSpec("locked", "tests.locked", (ArgSpec("value"),), return_type_hint="string"), lambda value: str(lock) + value)
    call = {"custom_function": {"name": "locked", "args": {"value": {"field": "v"}}}}
    with pytest.raises(RegistryError, match="sent to workers"):
        evaluate(spark.createDataFrame([("a",)], "v string"), rules({"when": ALWAYS, "assign": {"x": call}}), registry)


@pytest.mark.parametrize("stops", [False, True])
def test_coverage_counts_what_evaluation_decides(spark, stops):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice([None, 1, 2, 3, 9]), rng.choice(["a", "b", None])) for _ in range(200)], "i int, s string")
    error = {"error_on_null": True} if not stops else {}
    ruleset = rules(*[{"when": {"any": [cond("i", "eq", k, **(error if k == 2 else {})), cond("s", "eq", "b")]} if k != 3 else {"all": [cond("i", "gt", 5)]}, "assign": {"x": k}, "stop_on_match": stops or k == 3} for k in (1, 2, 3, 4)])
    report = coverage(df, ruleset, broad_match_threshold=0.3)
    decided = evaluate(df, ruleset, fail_on_error=False).attached_df.collect()
    fine = [r for r in decided if r.rules_error is None]
    assert (report.total_rows, report.error_count, report.no_match_count) == (200, 200 - len(fine), sum(not r.rules_matched for r in fine))
    assert report.match_counts == {f"r{k}": sum(f"r{k}" in r.rules_matched_rule_ids for r in fine) for k in (1, 2, 3, 4)}
    assert report.first_match_distribution == {f"r{k}": sum(r.rules_matched_rule_ids[:1] == [f"r{k}"] for r in fine) for k in (1, 2, 3, 4)}
    assert sorted(map(str, report.no_match_rows.collect())) == sorted(str(r)[: str(r).index(", rules_")] + ")" for r in fine if not r.rules_matched)


def test_coverage(spark):
    df = spark.createDataFrame([(1, 740), (2, 690), (3, 600)], "loan_id bigint, fico bigint")
    ruleset = rules({"when": {"all": [cond("fico", "ge", 680)]}, "assign": {"x": 1}}, {"when": {"all": [cond("fico", "gt", 700)]}, "assign": {"x": 2}}, {"when": {"all": [cond("fico", "gt", 900)]}, "assign": {"x": 3}})
    report = coverage(df, ruleset, broad_match_threshold=0.6)
    assert report.match_counts == {"r1": 2, "r2": 1, "r3": 0} and report.first_match_distribution == {"r1": 2, "r2": 0, "r3": 0}
    assert (report.total_rows, report.no_match_count, report.error_count) == (3, 1, 0)
    assert report.dead_rule_ids == ("r3",) and report.suspiciously_broad_rule_ids == ("r1",)
    assert [r.loan_id for r in report.no_match_rows.collect()] == [3]
    assert coverage(df.limit(0), ruleset).rules[0].match_rate == 0.0
    with pytest.raises(ValueError):
        coverage(df, ruleset, broad_match_threshold=2)
    with pytest.raises(ValueError):
        coverage(df.withColumn("coverage_x", F.lit(1)), ruleset)


# ---- documents


@pytest.mark.parametrize(
    "text",
    [
        "a: 1\na: 2",
        "ruleset_id: r",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [], extra: 1}",
        "{ruleset_id: r, ruleset_name: n, version: 1, rules: []}",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [{rule_name: a, when: {all: []}}]}",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [{rule_name: a, when: {all: [], any: []}, assign: {x: 1}}]}",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [{rule_name: a, when: {all: [{left: {field: a}, operator: is, right: {literal: 1}}]}, assign: {x: 1}}]}",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [{rule_name: a, when: {all: [{left: {field: a, literal: 1}, operator: eq}]}, assign: {x: 1}}]}",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [{rule_name: a, rule_order: '1', when: {all: []}, assign: {x: 1}}]}",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [{rule_name: a, when: {all: []}, assign: {x: {literal: 1.5, value_type: integer}}}]}",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [{rule_name: a, when: {all: []}, assign: {x: {literal: .nan}}}]}",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [{rule_name: a, when: {all: []}, assign: {x: {literal: '2024-2-1', value_type: date}}}]}",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [{rule_name: a, when: {all: []}, assign: {x: {literal: '2024-02-01T00:00:00', value_type: timestamp}}}]}",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [{rule_name: a, when: {all: []}, assign: {x: {literal: {1: a, '1': b}}}}]}",
        "{ruleset_id: r, ruleset_name: n, version: '1', rules: [{rule_name: a, when: {all: []}, assign: {x: {field: a, default_if_null: null}}}]}",
        "[1]",
        "a: [",
    ],
)
def test_broken_documents_are_rejected(text):
    with pytest.raises(CompileError):
        compile_yaml(text)


FULL = rules(
    {"when": {"any": [cond("a", "eq", Decimal("1.50"), tolerance_abs="0.1"), {"all": [cond("b", "is_null", active_flag=False)]}]}, "assign": {"x": {"literal": {"k": (1, Decimal(2)), "d": dt.date(2024, 1, 2)}}, "y": {"field": "c", "default_if_null": {"literal": "q", "value_type": "string"}}}, "description": "first"},
    {"when": {"all": [cond({"assigned": "x"}, "in", {"literal": [{"$type": "odd", "value": 3}]})]}, "assign": {"z": {"custom_function": {"name": "coalesce", "args": {"values": [{"field": "a"}, {"custom_function": {"name": "trim", "args": {"value": "s"}}}]}}}}, "stop_on_match": True},
    description="whole",
)


def test_round_trips():
    assert compile_yaml(export_yaml(FULL)) == FULL
    assert read_payload(payload_json(FULL)) == FULL and content_hash(read_payload(payload_json(FULL))) == content_hash(FULL)
    assert summary_counts(FULL) == {"rule_count": 2, "condition_count": 3, "assignment_count": 3, "custom_function_count": 2}
    with pytest.raises(ValueError):
        read_payload('{"$type":"what","value":1}')
    assert compile_yaml(export_yaml(FULL, tuple_tag="!other/tuple"), "!other/tuple") == FULL
    assert read_payload(payload_json(FULL, "$other"), "$other") == FULL and content_hash(FULL, "$other") != content_hash(FULL)


ENVELOPES = [dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 1, 2, 3), (1, (2, "x")), {1, 2}, {"$type": "date", "value": "x"}, {"$type": {"$type": 1}}, Decimal("1.50"), Decimal(7), -3, "\u00e9\n", None, True, [{"b": [], "a": {}}]]


@pytest.mark.parametrize("value", ENVELOPES, ids=repr)
def test_stored_values_come_back(value):
    read = CanonicalJson().read(canonical_json(value))
    assert read == value and type(read) is type(value) and canonical_json(read) == canonical_json(value)


@pytest.mark.parametrize("text", ['{"$type":"date","value":1}', '{"$type":"date","value":"2024-13-01"}', '{"$type":"tuple","value":{}}', '{"$type":"set","value":[[1]]}', '{"$type":["set"],"value":[1]}', '{"$type":"mapping","value":[]}'])
def test_broken_envelopes_are_rejected(text):
    with pytest.raises(ValueError):
        CanonicalJson().read(text)


@pytest.mark.parametrize("options", [{"name": " "}, {"name": 3}, {"required": 1}, {"literal_only": "no"}, {"type_hint": "text"}, {"default": 2}, {"required": False, "allowed_values": ["a"]}])
def test_broken_arguments_are_rejected(options):
    with pytest.raises(RegistryError):
        ArgSpec(**{"name": "a"} | options)


CHOICE = ArgSpec("mode", False, "a", "string", ("a", "b"), True)


@pytest.mark.parametrize(
    "options",
    [
        {"function_name": ""}, {"implementation_reference": None}, {"arguments": [CHOICE]}, {"arguments": ("x",)}, {"active": None}, {"allowed_in_condition": 1}, {"return_type_hint": " "}, {"return_type_hint": "text"},
        {"arguments": (ArgSpec("a"), ArgSpec("a"))}, {"return_type_hint": "same_as:z"}, {"return_type_hint": "like:mode"}, {"return_type_hint": "common_type:mode"}, {"arguments": (ArgSpec("a", allowed_values=(), literal_only=True),)},
        {"arguments": (ArgSpec("a", allowed_values=(1,)),)}, {"arguments": (ArgSpec("a", False, 3, allowed_values=(1,), literal_only=True),)}, {"arguments": (ArgSpec("a", False, object()),)},
    ],
)
def test_broken_contracts_are_rejected(options):
    with pytest.raises(RegistryError):
        FunctionSpec(**{"function_name": "f", "implementation_reference": "m.f", "arguments": (CHOICE,)} | options)


def test_registry_binds_and_lists():
    spec = FunctionSpec("f", "m.f", (ArgSpec("v"), CHOICE, ArgSpec("days", False, (6, 7), "integer_sequence"), ArgSpec("bag", False, frozenset({"y", "x"}))), return_type_hint="SAME_AS:v")
    assert list(spec.bind_args({"mode": "b", "v": 1}).items()) == [("v", 1), ("mode", "b"), ("days", (6, 7)), ("bag", frozenset({"x", "y"}))]
    for authored in ({}, {"v": 1, "w": 2}):
        with pytest.raises(RegistryError):
            spec.bind_args(authored)
    assert spec.to_payload()["arguments"][1:] == [{"name": "mode", "required": False, "type_hint": "string", "literal_only": True, "default": "a", "allowed_values": ["a", "b"]}, {"name": "days", "required": False, "type_hint": "integer_sequence", "literal_only": False, "default": [6, 7]}, {"name": "bag", "required": False, "type_hint": "any", "literal_only": False, "default": ["x", "y"]}]
    assert json.loads(spec.to_row()["arg_contract_payload_json"]) == {"arguments": spec.to_payload()["arguments"]}
    registry = FunctionRegistry()
    registry.register(spec)
    registry.register(FunctionSpec("e", "m.e"), len)
    assert [s.function_name for s in registry.specs()] == ["e", "f"] and registry.get_implementation("e") is len and registry.native("f") is None
    for broken in (lambda: registry.register(spec), lambda: registry.get_spec("g"), lambda: registry.get_implementation("f"), lambda: registry.register(FunctionSpec("h", "m.h"), 3)):
        with pytest.raises(RegistryError):
            broken()


D, L, NUM = T.DecimalType, T.LongType(), {"b": T.ByteType(), "s": T.ShortType(), "i": T.IntegerType(), "l": T.LongType(), "f": T.FloatType(), "d": T.DoubleType()}


@pytest.mark.parametrize(
    ("target", "given", "want"),
    [
        *[(NUM[b], NUM[a], "bsil".find(a) <= "bsil".find(b)) for a in "bsil" for b in "bsil"],
        *[(NUM[b], NUM[a], True) for a in "bsil" for b in "fd"], *[(NUM[b], NUM[a], False) for a in "fd" for b in "bsil"],
        (NUM["d"], NUM["f"], True), (NUM["f"], NUM["d"], False), (D(38, 18), NUM["d"], False), (NUM["d"], D(3, 0), False), (L, D(3, 0), False),
        (D(3, 0), NUM["b"], True), (D(2, 0), NUM["b"], False), (D(5, 0), NUM["s"], True), (D(4, 0), NUM["s"], False), (D(12, 2), NUM["i"], True), (D(11, 2), NUM["i"], False), (D(19, 0), L, True), (D(18, 0), L, False),
        (D(14, 4), D(10, 2), True), (D(10, 2), D(14, 4), False), (D(12, 4), D(10, 1), False), (D(38, 38), D(38, 38), True),
        (T.StringType(), T.StringType(), True), (T.StringType(), L, False), (T.DateType(), T.TimestampType(), False), (L, None, True),
    ],
)
def test_what_types_take(target, given, want):
    assert takes(target, given) is want


KV = T.StructType([T.StructField("k", T.ByteType()), T.StructField("v", T.StringType())])


@pytest.mark.parametrize(
    ("target", "literal", "want"),
    [
        (NUM["b"], 127, True), (NUM["b"], 128, False), (NUM["b"], -128, True), (D(3, 1), 99, True), (D(3, 1), 100, False), (D(3, 1), Decimal("99.90"), True), (D(3, 1), Decimal("9.99"), False), (D(5, 2), Decimal("1E+2"), True),
        (L, Decimal(1), False), (NUM["d"], Decimal(1), False), (NUM["f"], 0.1, True), (D(9, 4), 0.5, False), (T.BooleanType(), True, True), (L, True, False), (T.StringType(), "x", True), (L, "x", False), (L, None, True),
        (KV, {"k": 7, "v": None}, True), (KV, {"k": 700, "v": "x"}, False), (T.StructType(KV.fields[:1]), {"k": 7, "v": "x"}, False),
    ],
)
def test_what_types_take_of_literals(target, literal, want):
    assert takes(target, given_by(Literal(literal), literal_type(literal))) is want


def test_words_and_manifest():
    row = describe_rules(FULL)[0]
    assert row["rule_logic"] == "a == 1.50 (tolerance_abs=0.1) OR [inactive] b is null" and row["match_payload"].endswith("y = default_if_null(c, 'q')")
    manifest = authoring_manifest(standard_registry())
    assert len(manifest["operators"]) == 18 and len(manifest["functions"]) == 58


def test_explanations_of_passed_branches():
    rule = rules({"when": {"all": [cond("a", "eq", 1, condition_id="c1"), {"any": [cond("b", "eq", 2, condition_id="c2"), cond("c", "is_null", condition_id="c3"), {"all": []}]}]}, "assign": {"x": 1}, "active_flag": False}).rules[0]
    assert matched_explanation(rule, {"c1", "c2", "c3"}) == "a == 1 AND (b == 2 OR c is null)"
    assert matched_explanation(rule, ["c1"]) == "a == 1" and matched_explanation(rule, {"c2"}) is None
    assert describe_rule(rule)["rule_logic"].startswith("[inactive rule] a == 1")


def names(ruleset, schema=None):
    registry = standard_registry()
    return set((check_ruleset(ruleset, registry) if schema is None else check_against_schema(ruleset, T._parse_datatype_string(schema), registry)[0]).names())


def one(condition=None, value=None, **more):
    return rules({"when": {"all": [condition or cond("a", "eq", 1)]}, "assign": {"x": value if value is not None else 1}}, **more)


@pytest.mark.parametrize(
    ("ruleset", "schema", "check"),
    [
        (one(owner=None), None, "RULESET_OWNER_REQUIRED"),
        (rules(), None, "RULESET_RULE_REQUIRED"),
        (rules({"when": ALWAYS, "assign": {"x": 1}, "active_flag": False}), None, "RULESET_ACTIVE_RULE_REQUIRED"),
        (rules({"when": ALWAYS, "assign": {"x": 1}, "rule_id": "q"}, {"when": ALWAYS, "assign": {"y": 1}, "rule_id": "q"}), None, "RULE_ID_DUPLICATE"),
        (rules({"when": {"all": []}, "assign": {"x": 1}}), None, "CONDITION_GROUP_EMPTY"),
        (rules({"when": ALWAYS, "assign": []}), None, "RULE_ASSIGNMENT_REQUIRED"),
        (one(cond({"assigned": "z"}, "eq", 1)), None, "ASSIGNED_VALUE_PRIOR_PRODUCER_REQUIRED"),
        (one(cond("a", "eq", 1, tolerance_abs="-1")), None, "TOLERANCE_NEGATIVE"),
        (one(cond("a", "between", [1, 2], tolerance_abs="1")), None, "BETWEEN_TOLERANCE_FORBIDDEN"),
        (one(cond("a", "like", "x", tolerance_abs="1")), None, "TOLERANCE_OPERATOR_FORBIDDEN"),
        (one(cond("a", "is_null", 1)), None, "UNARY_OPERATOR_RIGHT_FORBIDDEN"),
        (one(cond("a", "is_null", error_on_null=True)), None, "ERROR_ON_NULL_UNARY_FORBIDDEN"),
        (one(cond("a", "eq")), None, "BINARY_OPERATOR_RIGHT_REQUIRED"),
        (one(cond("a", "in", "x")), None, "IN_OPERATOR_COLLECTION_REQUIRED"),
        (one(cond("a", "between", [1])), None, "BETWEEN_OPERATOR_PAIR_REQUIRED"),
        (one(value={"custom_function": {"name": "nope", "args": {}}}), None, "CUSTOM_FUNCTION_UNKNOWN"),
        (one(value={"custom_function": {"name": "trim", "args": {}}}), None, "CUSTOM_FUNCTION_ARGS_MISMATCH"),
        (one(value={"custom_function": {"name": "to_date", "args": {"value": "x", "on_error": "maybe"}}}), None, "CUSTOM_FUNCTION_ARG_VALUE_INVALID"),
        (one(value={"custom_function": {"name": "date_part", "args": {"value": "x", "part": {"field": "a"}}}}), None, "CUSTOM_FUNCTION_ARG_LITERAL_REQUIRED"),
        (one(value={"custom_function": {"name": "left", "args": {"value": "x", "length": "3"}}}), None, "CUSTOM_FUNCTION_ARG_TYPE_MISMATCH"),
        (one(), "b int", "SPARK_CONDITION_FIELD_MISSING"),
        (one(), "a int, A int", "SPARK_CONDITION_FIELD_AMBIGUOUS"),
        (one(value={"field": "q"}), "a int", "SPARK_ASSIGNMENT_SOURCE_FIELD_MISSING"),
        (one(), "a int, X int", "SPARK_ASSIGNMENT_TARGET_CASE_COLLISION"),
        (one(), "a int, x string", "SPARK_ASSIGNMENT_TARGET_TYPE_INCOMPATIBLE"),
        (one(value={"literal": 300}), "a int, x tinyint", "SPARK_ASSIGNMENT_TARGET_TYPE_INCOMPATIBLE"),
        (one(value={"field": "d"}), "a int, d decimal(18,4), x decimal(18,2)", "SPARK_ASSIGNMENT_TARGET_TYPE_INCOMPATIBLE"),
        (rules({"when": ALWAYS, "assign": {"x": 1}}, {"when": ALWAYS, "assign": {"x": "a"}}), "a int", "SPARK_ASSIGNMENT_TYPE_CONFLICT"),
        (one(value={"literal": None}), "a int", "SPARK_ASSIGNMENT_NULL_TYPE_REQUIRED"),
        (one(value={"literal": [], "value_type": "list"}), "a int", "SPARK_ASSIGNMENT_VALUE_TYPE_UNSUPPORTED"),
        (one(value={"literal": {"k": None}}), "a int", "SPARK_ASSIGNMENT_TYPE_UNRESOLVED"),
        (one(cond("a", "eq", "2024-01-01")), "a date", "SPARK_CONDITION_TEMPORAL_MISMATCH"),
        (one(cond("a", "eq", {"field": "a"}, tolerance_abs="1")), "a date", "SPARK_CONDITION_TEMPORAL_TOLERANCE_FORBIDDEN"),
        (one(cond("a", "in", {"field": "a"})), "a string", "SPARK_CONDITION_MEMBERSHIP_COLLECTION_REQUIRED"),
        (one(cond({"field": "a", "default_if_null": "x"}, "eq", 1)), "a int", "SPARK_DEFAULT_IF_NULL_TYPE_INCOMPATIBLE"),
        (one(value={"custom_function": {"name": "left", "args": {"value": "x", "length": {"field": "a"}}}}), "a string", "SPARK_CUSTOM_FUNCTION_ARG_TYPE_INCOMPATIBLE"),
        (one(value={"custom_function": {"name": "coalesce", "args": {"values": [{"field": "a"}, "s"]}}}), "a int", "SPARK_CUSTOM_FUNCTION_COMMON_TYPE_CONFLICT"),
    ],
)
def test_check_names(ruleset, schema, check):
    assert check in names(ruleset, schema)


def test_sound_rulesets_have_no_findings(spark):
    assert not names(one(), "a int") and not names(one(value={"field": "d"}), "a int, d decimal(10,2), x decimal(14,4)")
    with pytest.raises(ValidationFailed):
        evaluate(spark.createDataFrame([(1,)], "b int"), one())
