"""Driver queries of the general data-processing operators (problems 2, 3 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import heavy_keys, orphans, shred
from verdigris.plans import data_sql

VERSION = ["ruleset_id", "version"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity node of every version with a readable payload, from the entity tables."""
    return shred.entity_links(shred.shredded(table(spark, folder, "ruleset_versions"), VERSION, "payload_json"), VERSION)


def _flat(spark: SparkSession, folder: str, kind: str, attributes: dict[str, str]) -> DataFrame:
    """The table of one entity, from the nodes it needs."""
    nodes = shred.adjacency(table(spark, folder, "ruleset_versions"), VERSION, "payload_json", entities={kind: attributes})
    return shred.entity_table(shred.entity_records(nodes, VERSION, {kind: attributes}), VERSION, kind, attributes)


def _entity(kind: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _flat(spark, folder, kind, shred.RULESET_ENTITIES[kind])

    query.__doc__ = f"Flat table of the {kind} nodes with the link to their parent."
    return query


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    versions = table(spark, folder, "ruleset_versions")
    named = _flat(spark, folder, "call", {"name": "string"}).filter("name is not null").select(*VERSION, F.col("name").alias("key")).distinct()
    published = versions.groupBy(*VERSION).agg(F.max(orphans.instant(F.col("published_at"))).alias("period"))  # copies name one instant
    same = [named[c].eqNullSafe(published[c]) for c in VERSION]
    refs = named.join(published, same[0] & same[1]).select(named["ruleset_id"], named["version"], "key", "period")
    history, registry = table(spark, folder, "registry_changes"), table(spark, folder, "function_registry")
    intervals = orphans.validity(history, "function_name", "change_kind", "changed_at", ["registered", "reactivated"], "change_id")
    return refs, intervals, *orphans.present_keys(history, registry, "function_name", "active_flag")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Functions named by a version that were not available when it was published."""
    return orphans.orphans(*_references(spark, folder)).select("ruleset_id", "version", F.col("key").alias("function_name")).distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table and month of publishing."""
    return orphans.orphan_report(*_references(spark, folder), "ruleset_versions")


KEYS, FLAGS = ["rule_id", "final_winning_rule_id"], ["changed", "effective"]


def _figures(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys.with_shares(heavy_keys.key_figures(table(spark, folder, "assignment_results"), "result_id", KEYS, FLAGS))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that hold at least one fiftieth of the distinct results."""
    return _figures(spark, folder).filter("n_records * 50 >= total_records").select("field_name", F.col("key_value").alias("rule_id")).distinct()


def p4_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of every rule in either role."""
    return _figures(spark, folder).select("field_name", F.col("key_value").alias("rule_id"), "n_records", "n_changed", "n_effective", "total_records")


QUERIES = {
    "p2_found": p2_found,
    **{f"p2_{k}s": _entity(k) for k in shred.RULESET_ENTITIES},
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_figures": p4_figures,
}

SQL = {
    "p2_found": data_sql.LINKS,
    **{f"p2_{k}s": data_sql.entity_sql(k, attributes) for k, attributes in shred.RULESET_ENTITIES.items()},
    "p3_found": data_sql.ORPHANS,
    "p3_report": data_sql.ORPHAN_REPORT,
    "p4_found": data_sql.HEAVY,
    "p4_figures": data_sql.FIGURES,
}
