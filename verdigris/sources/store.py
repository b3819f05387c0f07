"""Published ruleset versions and function contracts in catalog tables.

Delta tables are used where Delta is installed; otherwise parquet tables, whose updates rewrite the table beside it
and swap names; :meth:`RulesetStore.recover` puts right what a crash in between leaves. Neither way is atomic across two
writers: publish from one place at a time.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterable, Mapping
from importlib.util import find_spec
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.errors import StoreError
from verdigris.model import Ruleset
from verdigris.sources.ruleset_export import payload_json, read_payload, summary_counts


def _schema(*fields: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "b": T.BooleanType()}
    parts = [f.split(":") for f in fields]
    return T.StructType([T.StructField(n, kinds[k[0]], not k.endswith("!")) for n, k in parts])


#: The columns of both tables ("!" marks columns that are never null).
VERSIONS = _schema(
    "ruleset_id:s!", "ruleset_name:s!", "version:s!", "status:s!", "description:s", "payload_json:s!", "content_hash:s!", "rule_count:i!", "condition_count:i!", "assignment_count:i!",
    "custom_function_count:i!", "owner:s", "owner_department:s", "published_by:s", "published_at:s", "retired_by:s", "retired_at:s",
)
FUNCTIONS = _schema(
    "function_name:s!", "implementation_reference:s!", "arg_contract_payload_json:s!", "return_type_hint:s", "allowed_in_condition_flag:b!", "allowed_in_assignment_flag:b!", "active_flag:b!", "description:s", "version:s",
)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def quoted(table: str) -> str:
    """A table name of one to three plain parts, each in backticks."""
    parts = table.split(".") if isinstance(table, str) else []
    if not 1 <= len(parts) <= 3 or not all(_NAME.fullmatch(p) for p in parts):
        raise ValueError(f"Unsafe table name: {table!r}")
    return ".".join(f"`{p}`" for p in parts)


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


class RulesetStore:
    """Lifecycle of ruleset versions: published once, retired once, never changed."""

    def __init__(self, spark: SparkSession, versions_table: str = "ruleset_versions", functions_table: str = "function_registry", table_format: str | None = None):
        self.spark = spark
        self.versions_table, self.functions_table = versions_table, functions_table
        quoted(versions_table), quoted(functions_table)
        self.format = table_format or ("delta" if find_spec("delta") else "parquet")
        self._tables = ((versions_table, VERSIONS), (functions_table, FUNCTIONS))

    def create_tables(self, mode: str = "error") -> None:
        """Create both tables. ``mode``: error (or errorifexists), ignore, overwrite (drop and create)."""
        if mode not in ("error", "errorifexists", "ignore", "overwrite"):
            raise ValueError(f"Unsupported mode: {mode!r}")
        there = {name for name, _ in self._tables if self.spark.catalog.tableExists(name)}
        if there and mode in ("error", "errorifexists"):
            raise StoreError(f"Tables already exist: {sorted(there)}")
        for name, schema in self._tables:
            if name in there and mode == "ignore":
                continue
            if name in there:
                self.spark.sql(f"DROP TABLE {quoted(name)}")
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {quoted(name)} ({columns}) USING {self.format.upper()}")

    def _table(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            raise StoreError(f"Table does not exist: {name}")
        return self.spark.table(quoted(name))

    def _append(self, name: str, schema: T.StructType, rows: list[Mapping[str, Any]]) -> None:
        data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
        self.spark.createDataFrame(data, schema).coalesce(1).write.format(self.format).mode("append").saveAsTable(quoted(name))

    def _replace(self, name: str, df: DataFrame) -> None:
        """Put ``df``, which reads the table, in its place.

        At every moment a whole table stands under ``name``, under ``name_before`` or both, so that a crash loses nothing:
        the new table is complete before the old one gives up its name, which goes only once the new one has it.
        """
        head, _, own = name.rpartition(".")
        side, before = (".".join(filter(None, [head, part])) for part in (f"swap_{uuid.uuid4().hex}", f"{own}_before"))
        df.write.format(self.format).saveAsTable(quoted(side))
        self.spark.sql(f"DROP TABLE IF EXISTS {quoted(before)}")
        self.spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(before)}")
        self.spark.sql(f"ALTER TABLE {quoted(side)} RENAME TO {quoted(name)}")
        self.spark.sql(f"DROP TABLE {quoted(before)}")

    def recover(self) -> list[str]:
        """Give tables back their names after a crash inside a replacement; the names of those that needed it."""
        found = []
        for name, _ in self._tables:
            before = f"{name}_before"
            if self.spark.catalog.tableExists(before):
                if not self.spark.catalog.tableExists(name):
                    self.spark.sql(f"ALTER TABLE {quoted(before)} RENAME TO {quoted(name)}")
                    found.append(name)
                else:
                    self.spark.sql(f"DROP TABLE {quoted(before)}")
        return found

    def _find(self, **where: str) -> list:
        found = self._table(self.versions_table)
        for column, value in where.items():
            found = found.filter(F.col(column) == F.lit(value))
        return found.limit(2).collect()

    def publish(self, ruleset: Ruleset, published_by: str | None = None) -> dict[str, Any]:
        """Append a version; its (id, version) and (name, version) must be new, whatever their status."""
        for label, where in (("id", {"ruleset_id": ruleset.ruleset_id}), ("name", {"ruleset_name": ruleset.ruleset_name})):
            if self._find(**where, version=ruleset.version):
                raise StoreError(f"A ruleset version with this {label} already exists: {where}, version {ruleset.version!r}")
        import hashlib

        payload = payload_json(ruleset)
        row = {
            "ruleset_id": ruleset.ruleset_id, "ruleset_name": ruleset.ruleset_name, "version": ruleset.version, "status": "published", "description": ruleset.description, "payload_json": payload,
            "content_hash": hashlib.sha256(payload.encode()).hexdigest(), **summary_counts(ruleset), "owner": ruleset.owner, "owner_department": ruleset.owner_department, "published_by": published_by, "published_at": _now(),
        }
        self._append(self.versions_table, VERSIONS, [row])
        return row

    def retire(self, ruleset_id: str, version: str, retired_by: str | None = None) -> None:
        """Mark a published version as retired."""
        rows = self._find(ruleset_id=ruleset_id, version=version)
        if len(rows) != 1:
            raise StoreError(f"{'No' if not rows else 'More than one'} ruleset version {ruleset_id!r} {version!r}")
        if rows[0]["status"] != "published":
            raise StoreError(f"Ruleset version is not published: {ruleset_id!r} {version!r}")
        if self.format == "delta":
            sql = f"UPDATE {quoted(self.versions_table)} SET status = 'retired', retired_by = :who, retired_at = :at WHERE ruleset_id = :id AND version = :version AND status = 'published'"
            self.spark.sql(sql, args={"who": retired_by, "at": _now(), "id": ruleset_id, "version": version})
        else:
            table = self._table(self.versions_table)
            mine = (F.col("ruleset_id") == F.lit(ruleset_id)) & (F.col("version") == F.lit(version)) & (F.col("status") == "published")
            changed = {"status": "retired", "retired_by": retired_by, "retired_at": _now()}
            self._replace(self.versions_table, table.withColumns({c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in changed.items()}))
        after = self._find(ruleset_id=ruleset_id, version=version)
        if len(after) != 1 or after[0]["status"] != "retired":
            raise StoreError(f"Ruleset version could not be retired: {ruleset_id!r} {version!r}")

    def load(self, ruleset_name: str, version: str | None = None) -> Ruleset:
        """The published version of that name; without ``version`` there must be just one."""
        where = {"ruleset_name": ruleset_name, "status": "published"} | ({"version": version} if version is not None else {})
        rows = self._find(**where)
        if not rows:
            raise StoreError(f"No published ruleset {ruleset_name!r}" + (f" version {version!r}" if version else ""))
        if len(rows) > 1:
            raise StoreError(f"Published ruleset {ruleset_name!r} is {'stored twice' if version else 'ambiguous; name a version'}")
        return read_payload(rows[0]["payload_json"])

    def save_functions(self, rows: Iterable[Mapping[str, Any]], update_existing: bool = True) -> None:
        """Add function contracts; known names are updated, or left as they are."""
        rows = list(rows)
        names = [r["function_name"] for r in rows]
        if len(set(names)) < len(names):
            raise StoreError("Function names must be unique in one call.")
        if not rows:
            return
        new = self.spark.createDataFrame([tuple(r.get(f.name) for f in FUNCTIONS.fields) for r in rows], FUNCTIONS)
        table = self._table(self.functions_table)
        if self.format == "delta":
            view = f"new_functions_{uuid.uuid4().hex}"
            new.createOrReplaceTempView(view)
            sets = ", ".join(f"t.{f.name} = s.{f.name}" for f in FUNCTIONS.fields)
            columns, values = ", ".join(FUNCTIONS.fieldNames()), ", ".join(f"s.{n}" for n in FUNCTIONS.fieldNames())
            update = f"WHEN MATCHED THEN UPDATE SET {sets} " if update_existing else ""
            try:
                self.spark.sql(f"MERGE INTO {quoted(self.functions_table)} t USING {view} s ON t.function_name = s.function_name {update}WHEN NOT MATCHED THEN INSERT ({columns}) VALUES ({values})")
            finally:
                self.spark.catalog.dropTempView(view)
            return
        kept, added = (table.join(new, "function_name", "left_anti"), new) if update_existing else (table, new.join(table, "function_name", "left_anti"))
        self._replace(self.functions_table, kept.select(FUNCTIONS.fieldNames()).unionByName(added.select(FUNCTIONS.fieldNames())))

    def functions(self) -> DataFrame:
        return self._table(self.functions_table)
