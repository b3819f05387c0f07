"""One entry point over compiling, checking, publishing, evaluating and reporting."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from verdigris.errors import ValidationFailed
from verdigris.functions.registry import FunctionRegistry
from verdigris.functions.standard import standard_registry, standard_rows
from verdigris.model import Ruleset, ValidationResult
from verdigris.plans import coverage as reports
from verdigris.plans.checks import check_ruleset
from verdigris.plans.describe import authoring_manifest, describe_rules
from verdigris.plans.evaluation import Evaluation, evaluate
from verdigris.plans.typing import check_against_schema
from verdigris.sources.ruleset_yaml import compile_yaml, compile_yaml_file
from verdigris.sources.store import RulesetStore


class RulesService:
    """Rulesets by object, by YAML or by stored name; an object given with a name wins."""

    def __init__(self, store: RulesetStore | None = None, registry: FunctionRegistry | None = None):
        self.store, self.registry = store, registry or standard_registry()

    @classmethod
    def from_schema(cls, spark: SparkSession, schema: str, versions_table: str = "ruleset_versions", functions_table: str = "function_registry", registry: FunctionRegistry | None = None) -> RulesService:
        return cls(RulesetStore(spark, f"{schema}.{versions_table}", f"{schema}.{functions_table}"), registry)

    @property
    def table_names(self) -> dict[str, str]:
        """The tables of versions and of functions."""
        return {"versions": self._stored().versions_table, "functions": self._stored().functions_table}

    def create_tables(self, mode: str = "error") -> None:
        self._stored().create_tables(mode)

    def save_standard_functions(self, update_existing: bool = True) -> None:
        self._stored().save_functions(standard_rows(), update_existing)

    def save_functions(self, rows: Iterable[Mapping[str, Any]], update_existing: bool = True) -> None:
        self._stored().save_functions(rows, update_existing)

    def compile_yaml_text(self, text: str) -> Ruleset:
        return compile_yaml(text)

    def compile_yaml_path(self, path: str | Path) -> Ruleset:
        return compile_yaml_file(path)

    def validate(self, ruleset: Ruleset, df: DataFrame | None = None) -> ValidationResult:
        """Findings without a schema, or with that of ``df`` as well; starts no job."""
        return check_ruleset(ruleset, self.registry) if df is None else check_against_schema(ruleset, df.schema, self.registry)[0]

    def publish(self, ruleset: Ruleset, published_by: str | None = None) -> Ruleset:
        """Store a version that has no findings; otherwise nothing is written."""
        result = check_ruleset(ruleset, self.registry)
        if not result.passed:
            raise ValidationFailed(result)
        self._stored().publish(ruleset, published_by)
        return ruleset

    def publish_yaml_text(self, text: str, published_by: str | None = None) -> Ruleset:
        return self.publish(compile_yaml(text), published_by)

    def publish_yaml_path(self, path: str | Path, published_by: str | None = None) -> Ruleset:
        return self.publish(compile_yaml_file(path), published_by)

    def load_published(self, ruleset_name: str, version: str | None = None) -> Ruleset:
        return self._stored().load(ruleset_name, version)

    def retire(self, ruleset_id: str, version: str, retired_by: str | None = None) -> None:
        self._stored().retire(ruleset_id, version, retired_by)

    def describe_rules(self, ruleset: Ruleset | None = None, ruleset_name: str | None = None, version: str | None = None) -> list[dict[str, str]]:
        return describe_rules(self._resolve(ruleset, ruleset_name, version))

    def authoring_manifest(self) -> dict[str, Any]:
        return authoring_manifest(self.registry)

    def evaluate(self, df: DataFrame, ruleset: Ruleset | None = None, *, ruleset_name: str | None = None, version: str | None = None, key_columns: Sequence[str] | None = None, **options: Any) -> Evaluation:
        return evaluate(df, self._resolve(ruleset, ruleset_name, version), self.registry, key_columns=key_columns, **options)

    def coverage(self, df: DataFrame, ruleset: Ruleset | None = None, *, ruleset_name: str | None = None, version: str | None = None, **options: Any) -> reports.CoverageReport:
        return reports.coverage(df, self._resolve(ruleset, ruleset_name, version), self.registry, **options)

    def _stored(self) -> RulesetStore:
        if self.store is None:
            raise ValueError("this service has no store")
        return self.store

    def _resolve(self, ruleset: Ruleset | None, name: str | None, version: str | None) -> Ruleset:
        if ruleset is not None:
            return ruleset
        if not name:
            raise ValueError("either a ruleset or a ruleset_name is needed")
        return self.load_published(name, version)
