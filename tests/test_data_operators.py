"""Shredding, orphan references and heavy keys against plain Python on small inputs."""

import datetime as dt
import json
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from verdigris import session
from verdigris.operators import heavy_keys, orphans, shred
from verdigris.operators.skew import join_by_key
from verdigris.plans import data_queries


def plain_entities(doc):
    """Independent recursive reading of the same documents."""
    out = []

    def operand(x, path, parent):
        if isinstance(x, dict) and isinstance(x.get("custom_function"), dict) and not {"field", "assigned", "literal"} & set(x):
            call(x["custom_function"], path + "/custom_function", parent)

    def call(x, path, parent):
        out.append(("call", path, parent))
        if isinstance(x.get("args"), dict):
            for k, v in x["args"].items():
                argument(v, f"{path}/args/{k}", path)

    def argument(v, path, parent):
        if isinstance(v, dict):
            if {"field", "assigned", "literal", "custom_function"} & set(v):
                operand(v, path, parent)
            else:
                for k, w in v.items():
                    argument(w, f"{path}/{k}", parent)
        elif isinstance(v, list):
            for i, w in enumerate(v):
                argument(w, f"{path}/{i}", parent)

    def member(x, path, parent):
        if not isinstance(x, dict):
            return
        if "all" in x or "any" in x:
            out.append(("group", path, parent))
            for side in ("all", "any"):
                for i, m in enumerate(x.get(side) or []):
                    member(m, f"{path}/{side}/{i}", path)
        else:
            out.append(("condition", path, parent))
            for side in ("left", "right"):
                operand(x.get(side), f"{path}/{side}", path)

    for i, rule in enumerate(doc.get("rules") or []):
        if rule is None:
            continue
        at = f"rules/{i}"
        out.append(("rule", at, ""))
        member(rule.get("when"), at + "/when", at)
        assign = rule.get("assign")
        pairs = assign.items() if isinstance(assign, dict) else enumerate(assign or [])
        for k, v in pairs:
            if v is None:
                continue
            here = f"{at}/assign/{k}"
            out.append(("assignment", here, at))
            operand(v, here, here) if isinstance(assign, dict) else operand(v.get("value"), here + "/value", here)
    return out


def plain_read(text):
    try:
        value = json.loads(text)
        return json.loads(value) if isinstance(value, str) else value
    except (TypeError, ValueError):
        return None


def test_links_match_a_plain_reading_of_all_versions(spark, data):
    rows = data_queries.table(spark, data, "ruleset_versions").select("ruleset_id", "version", "payload_json").collect()
    want = {(r[0], r[1], *e) for r in rows if (d := plain_read(r[2])) for e in plain_entities(d)}
    got = [tuple(r) for r in data_queries.p2_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want


DOC = {
    "rules": [
        None,
        {"rule_id": "r1", "rule_order": 2, "when": {"all": [None, {"any": []}, {"left": {"custom_function": {"name": "f", "args": {"literal": {"custom_function": {"name": "g"}}, "x": [1, {"hi": {"custom_function": {"name": "h", "args": {}}}}]}}}, "operator": "eq"}]}, "assign": {"t": 5, "u": None, "v": {"custom_function": {"name": "k"}}}},
        {"rule_id": None, "assign": [None, {"target_field": "w", "value": {"literal": {"custom_function": {"name": "data"}}}}]},
    ]
}


def tables(df, entities=None):
    return shred.shredded(df, ["id"], "doc", entities=entities)


def test_shred_edges(spark):
    text = json.dumps(DOC)
    rows = [("a", text), ("a", json.dumps(text)), ("b", text[:-9]), ("c", None), ("d", ""), ("e", "[]"), ("f", "7"), (None, text), ("g", '{"rules": null}')]
    df = spark.createDataFrame(rows, "id string, doc string").withColumn("label", F.lit("clash"))
    records = tables(df)
    links = shred.entity_links(records, ["id"]).collect()
    assert {tuple(r)[1:] for r in links if r.id == "a"} == set(plain_entities(DOC)) and len(links) == 2 * len(plain_entities(DOC))
    assert {r.id for r in links} == {"a", None}
    calls = shred.entity_table(records, ["id"], "call", {"name": "string"}).filter("id = 'a'").collect()
    assert sorted(r.name for r in calls) == ["f", "g", "h", "k"]
    wanted = {"rule_id": "string", "rule_order": "int"}
    narrow = shred.entity_records(shred.adjacency(df, ["id"], "doc", entities={"rule": wanted}), ["id"], {"rule": wanted})
    for source in (records, narrow):
        rules = shred.entity_table(source, ["id"], "rule", wanted).filter("id = 'a'").collect()
        assert sorted((r.node_path, r.ordinal, r.rule_id, r.rule_order) for r in rules) == [("rules/1", 1, "r1", 2), ("rules/2", 2, None, None)]
    assert tables(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shred.adjacency(df, ["label"], "doc")


def test_scoped_tables_are_removed(spark):
    df = spark.createDataFrame([("a", json.dumps(DOC))], "id string, doc string")
    kept = tables(df)
    with session.scope():
        inner = tables(df)
        paths = inner.inputFiles()
    assert paths and not any(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in paths)
    assert kept.count() == len(plain_entities(DOC))


def test_adjacency_holds_every_node_and_can_be_put_together_again(spark):
    df = spark.createDataFrame([("a", json.dumps(DOC))], "id string, doc string")
    nodes = {r.node: r for r in shred.adjacency(df, ["id"], "doc").collect()}
    below = defaultdict(list)
    for r in sorted(nodes.values(), key=lambda r: r.ordinal):
        below[r.parent].append(r)

    def build(node, kind, scalar):
        if kind == "object":
            return {r.label: build(r.node, r.json_kind, r.scalar) for r in below[node]}
        if kind == "array":
            return [build(r.node, r.json_kind, r.scalar) for r in below[node]]
        return scalar if kind in ("string", "null") else json.loads(scalar)

    assert build(shred.ROOT, "object", None) == DOC


def test_broken_surrogates_are_replaced(spark):
    text = '{"rules": [{"rule_id": "x\\ud800y", "assign": {"\\udfff": 1, "\\ud83d\\ude00": 2}}]}'
    records = tables(spark.createDataFrame([("a", text)], "id string, doc string"))
    assert {r.node_path for r in shred.entity_links(records, ["id"]).collect()} == {"rules/0", "rules/0/assign/\ufffd", "rules/0/assign/\U0001f600"}
    assert shred.entity_table(records, ["id"], "rule", {"rule_id": "string"}).first()["rule_id"] == "x\ufffdy"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2021-04-06T07:16:47.000000Z", dt.datetime(2021, 4, 6, 7, 16, 47)),
        ("2022-07-12 16:42:16+05:30", dt.datetime(2022, 7, 12, 11, 12, 16)),
        ("2025-01-10T16:05:46-07:00", dt.datetime(2025, 1, 10, 23, 5, 46)),
        ("2025-01-10 16:05", dt.datetime(2025, 1, 10, 16, 5)),
        ("2025-13-10 16:05", None),
        ("n/a", None),
        ("", None),
        (None, None),
    ],
)
def test_instants(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(orphans.instant(F.col("t"))).first()[0] == want


def plain_orphans(spark, data):
    t = lambda n: data_queries.table(spark, data, n).collect()
    when = {}
    for r in data_queries.table(spark, data, "ruleset_versions").select("ruleset_id", "version", orphans.instant(F.col("published_at")).alias("p")).collect():
        when[r[0], r[1]] = max(filter(None, [when.get((r[0], r[1])), r.p]), default=None)
    history = defaultdict(set)
    for r in t("registry_changes"):
        history[r.function_name].add((r.changed_at, r.change_kind))
    listed = {r.function_name for r in t("function_registry")}
    active = {r.function_name for r in t("function_registry") if r.active_flag}
    out = set()
    for r in t("ruleset_versions"):
        doc = plain_read(r.payload_json)
        for kind, path, _ in plain_entities(doc) if doc else []:
            if kind != "call":
                continue
            node = doc
            for step in path.split("/"):
                node = node[int(step)] if isinstance(node, list) else node[step]
            name, at = node["name"], when[r.ruleset_id, r.version]
            if at is None:
                ok = name in listed
            elif history[name]:
                before = [h for h in history[name] if h[0] <= at]
                ok = bool(before) and max(before)[1] in ("registered", "reactivated")
            else:
                ok = name in active
            if not ok:
                out.add((r.ruleset_id, r.version, name))
    return out


def test_orphans_match_a_plain_search(spark, data):
    assert {tuple(r) for r in data_queries.p3_found(spark, data).collect()} == plain_orphans(spark, data)


def test_orphans_split_gives_what_one_join_gives(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    history = spark.createDataFrame([(1, "hot", "registered", day(5)), (1, "hot", "registered", day(5)), (2, "hot", "removed", day(9)), (3, "hot", "reactivated", day(9)), (4, "x", "removed", day(1)), (None, None, None, None)], "change_id int, name string, kind string, at timestamp_ntz")
    registry = spark.createDataFrame([("x", True), ("y", True), ("y", True), ("z", False), (None, True)], "name string, active boolean")
    refs = spark.createDataFrame([("hot", day(d), d) for d in range(1, 20)] + [("x", day(3), 0), ("y", day(3), 0), ("z", day(3), 0), ("z", None, 1), ("q", None, 1), (None, day(1), 0), ("y", day(3), 0)], "key string, period timestamp_ntz, valid_from int")
    intervals = orphans.validity(history, "name", "kind", "at", ["registered", "reactivated"], "change_id")
    always, listed = orphans.present_keys(history, registry, "name", "active")
    want = {("hot", d) for d in range(1, 5)} | {("x", 0), ("z", 0), ("q", 1)}
    for share, bound in ((0.01, 100), (0.01, 1), (0.5, 100), (0.5, 0), (1.0, 100)):  # broadcast, cut by time, one join
        got = [(r.key, r.valid_from) for r in orphans.orphans(refs, intervals, always, listed, share, bound).collect()]
        assert sorted(got) == sorted(want)
    report = {r.month: (r.table_name, r.orphan_references, r.missing_keys) for r in orphans.orphan_report(refs, intervals, always, listed, "t").collect()}
    assert report == {"2024-01": ("t", 6, 3), None: ("t", 1, 1)}
    assert orphans.orphans(refs.limit(0), intervals, always, listed).count() == 0
    assert orphans.orphans(refs, intervals.limit(0), always.limit(0), listed.limit(0)).count() == 24


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_joins_by_hot_keys_give_what_one_join_gives(spark, how):
    rows = [("hot", 1, i) for i in range(60)] + [(None, 2, i) for i in range(30)] + [(f"k{i}", None, i) for i in range(10)]
    left = spark.createDataFrame(rows, "a string, b int, v int")
    right = spark.createDataFrame([("hot", 1, "x"), (None, 2, "y"), ("k3", None, "z"), ("none", 1, "q")], "a string, b int, w string")
    want = sorted((a or "", b or 0, v, *([w] if how == "inner" else [])) for a, b, v in rows for c, d, w in (("hot", 1, "x"), (None, 2, "y"), ("k3", None, "z")) if (a, b) == (c, d))
    for least, bound in ((5, 1), (1000, 1), (5, 100)):  # hot keys apart, one shuffle, one broadcast
        got = join_by_key(left, right, ["a", "b"], how, 0.1, least, bound)
        assert got.columns == ["a", "b", "v", *(["w"] if how == "inner" else [])]
        assert sorted((a or "", b or 0, *rest) for a, b, *rest in got.collect()) == want
    assert join_by_key(left.limit(0), right, ["a", "b"], how).count() == 0


def test_heavy_keys_match_counters(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", None if i % 5 == 0 else f"w{i % 7}", i % 2 == 0, None) for i in range(3000)]
    rows += rows[:500] + [(None, "hot", "w", True, True)] * 3
    df = spark.createDataFrame(rows, "id long, a string, b string, f boolean, g boolean").withColumn("n_records", F.lit(1))
    got = {(r.field_name, r.key_value): (r.n_records, r.n_f, r.n_g) for r in heavy_keys.key_figures(df, "id", ["a", "b"], ["f", "g"]).collect()}
    n, f = Counter(), Counter()
    for i, a, b, flag, _ in {r for r in rows if r[0] is not None}:
        for key in (("a", a), ("b", b)):
            if key[1] is not None:
                n[key] += 1
                f[key] += flag
    assert got == {k: (v, f[k], 0) for k, v in n.items()}
    assert heavy_keys.key_figures(df.limit(0), "id", ["a", "b"], ["f"]).count() == 0
    shares = heavy_keys.with_shares(heavy_keys.key_figures(df, "id", ["a"], [])).filter("key_value = 'hot'").first()
    assert (shares.n_records, shares.total_records) == (2000, 3000)


def test_nesting_beyond_the_parsers_depth():
    deep = 60_000
    text = '{"rules": [{"when": ' + '{"all": [' * deep + '{"left": {"custom_function": {"name": "f"}}}' + "]}" * deep + "}]}"
    with pytest.raises(RecursionError):
        json.loads(text)
    for wrapped in (text, json.dumps(text)):
        node, levels = shred.read_document(wrapped)["rules"][0]["when"], 0
        while "all" in node:
            node, levels = node["all"][0], levels + 1
        assert levels == deep and node == {"left": {"custom_function": {"name": "f"}}}
    assert shred.read_document(text[:-1]) is None and shred.read_document(text + "x") is None


@pytest.mark.parametrize("text", ["", " ", "{}", "[]", " [ ] ", "[1, 2.5, -3e2, null, true, NaN]", '{"a": 1, "b": {"a": [[], {}]}, "a": "x\\n"}', '"s"', "[1,]", "[,1]", "[1 2]", '{"a"}', '{"a":}', '{"a": 1,}', "{1: 2}", "[1}", "]", "[", '{"a": [1', "1 2", "[\f1]"])
def test_deep_parser_reads_like_the_other(text):
    def read(parse):
        try:
            return repr(parse(text))
        except ValueError:
            return "unreadable"

    assert read(shred._parse_deep) == read(json.loads)
