"""Lifecycle of stored versions, the service, and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import verdigris
from verdigris import RulesService, RulesetStore
from verdigris.errors import StoreError, ValidationFailed
from verdigris.functions.standard import standard_rows
from verdigris.plans import rule_queries
from verdigris.session import materialise, shared_folder
from verdigris.sources.store import FUNCTIONS, VERSIONS, quoted
from verdigris.streaming.decisions import decide_stream, windowed_coverage, write_decisions

TEXT = """
ruleset_id: s1
ruleset_name: Stored
version: "{version}"
owner: o
owner_department: d
rules:
- rule_name: first
  when: {{all: [{{left: {{field: v}}, operator: gt, right: {{literal: 1.5}}}}]}}
  assign: {{band: high}}
"""


@pytest.fixture
def service(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS rules_test")
    made = RulesService.from_schema(spark, "rules_test")
    made.create_tables("overwrite")
    yield made
    spark.sql("DROP DATABASE rules_test CASCADE")


def test_lifecycle(spark, service):
    for mode in ("error", "errorifexists"):
        with pytest.raises(StoreError):
            service.create_tables(mode)
    service.create_tables("ignore")
    published = service.publish_yaml_text(TEXT.format(version="1"), "me")
    assert service.load_published("Stored") == published
    with pytest.raises(StoreError):
        service.publish_yaml_text(TEXT.format(version="1"))
    with pytest.raises(StoreError):
        service.publish_yaml_text(TEXT.format(version="1").replace("s1", "s2"))
    service.publish_yaml_text(TEXT.format(version="2"))
    with pytest.raises(StoreError, match="ambiguous"):
        service.load_published("Stored")
    service.retire("s1", "1", "you")
    assert service.load_published("Stored").version == "2"
    rows = {r.version: r for r in spark.table("rules_test.ruleset_versions").collect()}
    assert (rows["1"].status, rows["1"].retired_by, rows["2"].status, rows["1"].rule_count) == ("retired", "you", "published", 1)
    assert spark.table("rules_test.ruleset_versions").columns == VERSIONS.fieldNames() and json.loads(rows["1"].payload_json)["version"] == "1"
    for wrong in (("s1", "1"), ("s1", "9")):
        with pytest.raises(StoreError):
            service.retire(*wrong)
    with pytest.raises(StoreError):
        service.load_published("Stored", "1")
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert [r.band for r in service.evaluate(df, ruleset_name="Stored").apply_assignments().collect()] == [None, "high", None]
    assert service.coverage(df, ruleset_name="Stored").match_counts == {"rule:1": 1}
    assert service.describe_rules(ruleset_name="Stored")[0]["rule_logic"] == "v > 1.5"
    broken = TEXT.format(version="3").replace("owner: o", "owner: ''")
    with pytest.raises(ValidationFailed):
        service.publish_yaml_text(broken)
    assert spark.table("rules_test.ruleset_versions").count() == 2


@pytest.mark.parametrize("crash", ["new written", "old aside", "new named", None])
def test_a_crash_inside_a_replacement_loses_nothing(spark, service, crash, monkeypatch):
    service.publish_yaml_text(TEXT.format(version="1"))
    store, steps = service.store, {"new written": 1, "old aside": 2, "new named": 3, None: 99}
    real, done = type(spark).sql, []

    def sql(self, text, *args, **kwargs):
        if text.startswith(("DROP TABLE", "ALTER TABLE")):
            done.append(text)
            if len(done) > steps[crash]:
                raise RuntimeError("crash")
        return real(self, text, *args, **kwargs)

    monkeypatch.setattr(type(spark), "sql", sql)
    if crash is None:
        store.retire("s1", "1")
    else:
        with pytest.raises(RuntimeError):
            store.retire("s1", "1")
    monkeypatch.undo()
    assert store.recover() == (["rules_test.ruleset_versions"] if crash == "old aside" else [])
    rows = spark.table("rules_test.ruleset_versions").collect()
    assert [(r.ruleset_id, r.status) for r in rows] == [("s1", "retired" if crash in ("new named", None) else "published")]
    assert store.recover() == [] and not spark.catalog.tableExists("rules_test.ruleset_versions_before")
    assert service.table_names == {"versions": "rules_test.ruleset_versions", "functions": "rules_test.function_registry"}


def test_function_table(spark, service):
    service.save_standard_functions()
    assert service.store.functions().count() == 58
    row = {**standard_rows()[0], "description": "changed"}
    service.save_functions([row], update_existing=False)
    assert service.store.functions().filter("description = 'changed'").count() == 0
    service.save_functions([row, {**row, "function_name": "new_one"}])
    assert service.store.functions().count() == 59 and service.store.functions().filter("description = 'changed'").count() == 2
    assert service.store.functions().columns == FUNCTIONS.fieldNames()
    service.save_functions([])
    with pytest.raises(StoreError):
        service.save_functions([row, row])


def test_names_and_missing_tables(spark):
    for bad in ("", "a.b.c.d", "a b", "a;drop", "1a", None):
        with pytest.raises(ValueError):
            quoted(bad)
    with pytest.raises(StoreError):
        RulesetStore(spark, "no_such_table").load("x")
    with pytest.raises(ValueError):
        RulesService().load_published("x")
    with pytest.raises(ValueError):
        RulesService().evaluate(spark.range(1))


def test_streams_decide_like_batches(spark, tmp_path):
    rules = verdigris.compile_yaml(TEXT.format(version="1"))
    at = dt.datetime(2024, 1, 1)
    rows = [(k, float(k % 4) if k % 5 else None, at + dt.timedelta(minutes=7 * k)) for k in range(40)]
    batch = spark.createDataFrame(rows, "k int, v double, ts timestamp")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    decided = decide_stream(stream, rules)
    assert decided.isStreaming
    query = write_decisions(decided, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    want = verdigris.evaluate(batch, rules).attached_df
    key = F.col("k"), F.col("rules_matched"), F.col("rules_assign.band.value")
    assert sorted(map(tuple, out.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    counts = windowed_coverage(decided, "ts", "1 hour", "10 minutes")
    query = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sum(r.n_rows for r in spark.table("windows").collect()) == 40


def test_materialised_tables_live_in_the_shared_folder(spark):
    df = materialise(spark.range(5).selectExpr("id", "id % 2 = 0 as even"), "probe")
    assert df.count() == 5 and shared_folder(spark)


@pytest.mark.parametrize("name", ["rules_size_band", "cmp_in_column", "assigned_chain", "error_quarantine", "fn_decimal_multiply", "user_function", "coverage_report"])
def test_driver_queries_run(spark, data, name):
    out = rule_queries.QUERIES[name](spark, data)
    assert out.count() > 0 and (name in rule_queries.SQL)


def test_llm_package_stands_apart():
    import pathlib

    root = pathlib.Path(verdigris.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "verdigris.llm" not in path.read_text(encoding="utf-8"), path
