"""Deeply nested documents as an adjacency table, and entity tables pivoted from it.

A document becomes one row per node: node, parent, label, ordinal, kind and scalar text. A node is the 64-bit hash
of its path from the root, so that copies of a document in other layouts have the same nodes; two paths of one
document share a hash once in some 10**13 documents of a thousand nodes. A grammar names the nodes that are
entities (here those of a rule set) and gives each its path and that of the nearest enclosing entity, so that
children keep the link to their parent. Entity tables come from joining object nodes with their scalar children
on (document, parent) and pivoting the labels into columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from verdigris.session import bounded, materialise

#: One row of the adjacency table, after the key columns. Paths stand with entities only.
NODE_FIELDS = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("parent", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("json_kind", T.StringType()),
        T.StructField("scalar", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("node_path", T.StringType()),
        T.StructField("entity_parent", T.StringType()),
    ]
)
#: The node of every document's root, which has no row of its own.
ROOT = 0

#: Nodes that leave a worker in one batch.
ROWS_AT_ONCE = 20_000

_BLANKS = re.compile(r"[ \t\n\r]*")
#: Reads one string, number or constant at a place.
_SCANNER = json.JSONDecoder().scan_once

OPERAND_KEYS = ("field", "assigned", "literal", "custom_function")


def read_document(text: str | None):
    """The document in ``text``, or None if it can't be read.

    A JSON string that holds a document's text is opened, however often it was wrapped. Cut-off text and
    text that isn't JSON are unreadable.
    """
    value = text
    try:
        while isinstance(value, str):
            try:
                value = json.loads(value)
            except RecursionError:
                value = _parse_deep(value)
    except ValueError:
        return None
    return value


def _parse_deep(text: str):
    """What ``json.loads`` gives, without recursion, for nesting beyond its depth."""

    def skip(at: int) -> int:
        return _BLANKS.match(text, at).end()

    def scalar(at: int) -> tuple:
        try:
            return _SCANNER(text, at)
        except StopIteration:
            raise ValueError(f"no value at {at}") from None

    root: list = []  # its only member is the document
    opened: list = [root]
    key, at = None, skip(0)
    while True:
        mark = text[at : at + 1]
        if mark in ("{", "["):
            value, at = ({} if mark == "{" else []), skip(at + 1)
        else:
            value, at = scalar(at)
        if isinstance(opened[-1], dict):
            opened[-1][key] = value
        else:
            opened[-1].append(value)
        fresh = mark in ("{", "[")
        if fresh:
            opened.append(value)
        while True:  # close what ends here, up to the next member
            at = skip(at)
            if len(opened) == 1:
                if at < len(text):
                    raise ValueError(f"more text at {at}")
                return root[0]
            inside = isinstance(opened[-1], dict)
            if text[at : at + 1] == ("}" if inside else "]"):
                opened.pop()
                fresh, at = False, at + 1
                continue
            if not fresh:
                if text[at : at + 1] != ",":
                    raise ValueError(f"no comma at {at}")
                at = skip(at + 1)
            break
        if inside:
            if text[at : at + 1] != '"':
                raise ValueError(f"no key at {at}")
            key, at = scalar(at)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = skip(at + 1)


def ruleset_grammar(state: str, label: str, value, container) -> tuple[str, str | None]:
    """State and entity of a child in a rule-set document.

    ``state`` is the parent's state and ``container`` the parent. An unknown state "data" has no entities
    below it: what stands inside a literal, a default or a plain argument is data.
    """
    if state == "root":
        return ("rules", None) if label == "rules" else ("data", None)
    if state == "rules":
        return ("rule", "rule") if isinstance(value, dict) and isinstance(container, list) else ("data", None)
    if state == "rule":
        if label == "when" and isinstance(value, dict):
            return _member(value)
        return ("assigns", None) if label == "assign" else ("data", None)
    if state == "group":
        return ("members", None) if label in ("all", "any") and isinstance(value, list) else ("data", None)
    if state == "members":
        return _member(value) if isinstance(value, dict) else ("data", None)
    if state == "condition":
        return ("operand", None) if label in ("left", "right") else ("data", None)
    if state == "assigns":
        if value is None:
            return "data", None
        if isinstance(container, dict):  # target field -> value
            return "operand", "assignment"
        return ("assignment", "assignment") if isinstance(value, dict) else ("data", None)
    if state == "assignment":
        return ("operand", None) if label == "value" else ("data", None)
    if state == "operand":
        if label == "custom_function" and isinstance(value, dict):
            return "call", "call"
        return "data", None
    if state == "call":
        return ("args", None) if label == "args" else ("data", None)
    if state in ("args", "plain"):  # the names in args are argument names, never operand kinds
        if isinstance(value, dict):
            return ("operand" if any(k in value for k in OPERAND_KEYS) else "plain"), None
        return ("plain", None) if isinstance(value, list) else ("data", None)
    return "data", None


#: States in which a member that is a scalar can be an entity.
ruleset_grammar.scalar_entities = frozenset({"assigns"})


def _member(value: dict) -> tuple[str, str]:
    return ("group", "group") if "all" in value or "any" in value else ("condition", "condition")


def _scalar(value) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    if isinstance(value, str):
        return "string", value
    return "number", json.dumps(value)


def walk(document, grammar: Callable, add: Callable[[tuple], None], kinds: frozenset | None = None, labels: frozenset = frozenset()) -> None:
    """Hands the nodes of one document to ``add``, a node's members together and in order, without recursion.

    With ``kinds``, only entities of these kinds and their scalar children named in ``labels`` are given.
    """
    every, scalar_entities = kinds is None, grammar.scalar_entities
    stack = [(document, ROOT, "", "root", None, "")]
    while stack:
        value, node, path, state, entity, inner = stack.pop()
        attributes = not every and entity in kinds
        scalars_are_plain = state not in scalar_entities
        below = []
        for ordinal, (label, child) in enumerate(value.items() if isinstance(value, dict) else enumerate(value)):
            if not isinstance(label, str):
                label = str(label)
            nested = isinstance(child, dict | list)
            if not nested and scalars_are_plain:  # most nodes
                if every or (attributes and child is not None and label in labels):
                    kind, scalar = ("string", child) if type(child) is str else _scalar(child)
                    add((xxh64_intdigest(label.encode("utf-8", "surrogatepass"), node), node, label, ordinal, kind, scalar, None, None, None))
                continue
            child_state, kind_of = ("data", None) if state == "data" else grammar(state, label, child, value)
            own = xxh64_intdigest(label.encode("utf-8", "surrogatepass"), node)
            open_below = nested and child and (every or child_state != "data")
            here = (f"{path}/{label}" if path else label) if kind_of or open_below else None
            if open_below:
                below.append((child, own, here, child_state, kind_of, here if kind_of else inner))
            kind, scalar = (("object" if isinstance(child, dict) else "array"), None) if nested else _scalar(child)
            if every or kind_of in kinds or (attributes and scalar is not None and label in labels):
                add((own, node, label, ordinal, kind, scalar, kind_of, here if kind_of else None, inner if kind_of else None))
        stack.extend(reversed(below))


def _arrow(values: tuple, kind: T.DataType) -> pa.Array:
    if isinstance(kind, T.LongType):
        return pa.array(np.array(values, np.uint64).view(np.int64))
    if isinstance(kind, T.IntegerType):
        return pa.array(values, pa.int32())
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # halves of surrogate pairs, which UTF-8 can't hold
        return pa.array([v if v is None else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], pa.string())


def adjacency(df: DataFrame, keys: list[str], payload: str, grammar: Callable = ruleset_grammar, entities: dict[str, dict] | None = None) -> DataFrame:
    """One row per node of every readable document, in one pass without a shuffle.

    Unreadable, empty and null documents give no rows; documents delivered again give their nodes again
    (the entity tables below count copies once). A key named like a column of the adjacency table is an error.
    Null members are nodes of kind ``null`` and no entities; halves of surrogate pairs become U+FFFD. Columns of ``df`` other than ``keys`` and
    ``payload`` are not read. ``entities`` (attributes by entity, as in :data:`RULESET_ENTITIES`) leaves out the
    nodes that the tables of these entities don't need.
    """
    if clash := set(keys) & set(NODE_FIELDS.fieldNames()):
        raise ValueError(f"key columns have names of the adjacency table: {sorted(clash)}")
    schema = T.StructType([*(df.select(*[F.col(f"`{k}`") for k in keys]).schema.fields), *NODE_FIELDS.fields])
    kinds = None if entities is None else frozenset(entities)
    labels = frozenset(label for attributes in (entities or {}).values() for label in attributes)
    width = len(keys)

    def made(batch: pa.RecordBatch, rows: list[tuple], origin: list[int]) -> pa.RecordBatch:
        index = pa.array(origin, pa.int32())
        columns = [_arrow(c, f.dataType) for c, f in zip(zip(*rows, strict=True), NODE_FIELDS.fields, strict=True)]
        return pa.RecordBatch.from_arrays([*[batch.column(i).take(index) for i in range(width)], *columns], names=schema.names)

    def pieces(batch: pa.RecordBatch, rows: list[tuple], origin: list[int]) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(rows), ROWS_AT_ONCE):  # one document may have any number of nodes
            yield made(batch, rows[low : low + ROWS_AT_ONCE], origin[low : low + ROWS_AT_ONCE])

    def split(batches):
        for batch in bounded(batches):
            rows, origin = [], []
            for row in range(batch.num_rows):
                document = read_document(batch.column(width)[row].as_py())
                if not isinstance(document, dict | list):
                    continue
                walk(document, grammar, rows.append, kinds, labels)
                origin += [row] * (len(rows) - len(origin))
                if len(rows) >= ROWS_AT_ONCE:
                    yield from pieces(batch, rows, origin)
                    rows, origin = [], []
            yield from pieces(batch, rows, origin)

    return df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{payload}`")).mapInArrow(split, schema)


def entity_records(nodes: DataFrame, keys: list[str], entities: dict[str, dict]) -> DataFrame:
    """Every entity node joined with its scalar children, whose labels become columns.

    Columns: the keys, node_kind, node_path, parent_path, ordinal, and one text column ``a_<label>`` per label of
    any entity; a node is either an entity or an attribute. A missing or null attribute is null. Copies of a
    document count once; where they differ in an attribute, the greatest text is taken. Nodes and children meet in
    one shuffle on (node, document), each node's children reduced to one row before it.
    """
    here = [F.col(f"`{k}`") for k in keys]
    labels = sorted({label for attributes in entities.values() for label in attributes})
    is_node = F.coalesce(F.col("entity").isin(*entities), F.lit(False))
    # the children of other nodes come along and go once their group turns out to hold no entity node
    wanted = nodes.filter(is_node | (F.col("label").isin(*labels) & F.col("scalar").isNotNull()))
    owner = F.when(is_node, F.col("node")).otherwise(F.col("parent"))

    def picked(test: Column, column: str) -> Column:
        return F.max(F.when(test, F.col(column)))

    # the node comes first: sorting by a number is far cheaper than by the texts of the keys
    grouped = wanted.groupBy(owner.alias("node"), *here).agg(
        picked(is_node, "entity").alias("node_kind"),
        picked(is_node, "node_path").alias("node_path"),
        picked(is_node, "entity_parent").alias("parent_path"),
        picked(is_node, "ordinal").alias("ordinal"),
        *[picked(~is_node & (F.col("label") == name), "scalar").alias(f"a_{name}") for name in labels],
    )
    return grouped.filter("node_kind is not null").select(*here, "node_kind", "node_path", "parent_path", "ordinal", *[f"a_{n}" for n in labels])


def entity_table(records: DataFrame, keys: list[str], entity: str, attributes: dict[str, str]) -> DataFrame:
    """The flat table of one entity; ``attributes`` maps a label to a Spark type. A scalar that doesn't convert is null."""
    here = [F.col(f"`{k}`") for k in keys]
    return records.filter(F.col("node_kind") == entity).select(*here, "node_path", "parent_path", "ordinal", *[F.col(f"a_{n}").try_cast(t).alias(n) for n, t in attributes.items()])


def entity_links(records: DataFrame, keys: list[str]) -> DataFrame:
    """Every entity node with its kind and nearest enclosing entity."""
    return records.select(*[F.col(f"`{k}`") for k in keys], "node_kind", "node_path", "parent_path")


#: Attributes of each entity of a rule set.
RULESET_ENTITIES = {
    "rule": {"rule_id": "string", "rule_name": "string", "rule_order": "bigint", "active_flag": "boolean", "stop_on_match": "boolean", "description": "string"},
    "group": {"condition_group_id": "string"},
    "condition": {"condition_id": "string", "operator": "string", "tolerance_abs": "string", "error_on_null": "boolean", "active_flag": "boolean"},
    "assignment": {"assignment_id": "string", "target_field": "string"},
    "call": {"name": "string"},
}


def shredded(df: DataFrame, keys: list[str], payload: str, grammar: Callable = ruleset_grammar, entities: dict[str, dict] | None = None) -> DataFrame:
    """The stored entity records of documents, from their stored adjacency table."""
    entities = RULESET_ENTITIES if entities is None else entities
    nodes = materialise(adjacency(df, keys, payload, grammar), "adjacency")
    return materialise(entity_records(nodes, keys, entities), "entities")


def ruleset_tables(df: DataFrame, keys: list[str], payload: str) -> dict[str, DataFrame]:
    """All entity tables of rule-set documents."""
    records = shredded(df, keys, payload)
    return {entity: entity_table(records, keys, entity, attributes) for entity, attributes in RULESET_ENTITIES.items()}
