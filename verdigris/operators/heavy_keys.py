"""Per-key figures where a few keys hold most rows.

No stage is split by key before it has been reduced: records are spread by record id, every such equal
split encodes its keys in a dictionary and adds its figures up in dense arrays (numpy bincount), and only the
split's arrays travel on, in blocks by hash of the key, to be added up by the same code. A key that holds
any share of the rows then costs one array cell per split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.session import materialise


class DenseAccumulator:
    """Dense figure arrays over a growing dictionary of keys."""

    def __init__(self, figures: int):
        self.codes: dict = {}
        self.cells = np.zeros((figures, 1024), np.int64)

    def add(self, keys: pa.Array, weights: list[np.ndarray]) -> None:
        """Add ``weights`` (one array per figure, aligned with ``keys``) to the cells of the keys; null keys are left out."""
        encoded = keys.dictionary_encode()
        values = encoded.dictionary.to_pylist()
        if not values:
            return
        mapped = np.fromiter((self.codes.setdefault(v, len(self.codes)) for v in values), np.int64, len(values))
        while len(self.codes) > self.cells.shape[1]:
            self.cells = np.concatenate([self.cells, np.zeros_like(self.cells)], axis=1)
        local = encoded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)
        for at, weight in enumerate(weights):
            # whole numbers below 2**53 add up exactly in bincount's doubles; a batch holds far fewer
            self.cells[at, mapped] += np.bincount(local, weight, len(values) + 1)[:-1].astype(np.int64)


def _accumulate(fields: list[str], figures: int, wide: bool):
    """Arrow stage: rows (key columns, weights) or partial rows (field, key, weights) into partial rows."""

    def stage(batches):
        sums = {name: DenseAccumulator(figures) for name in fields}
        for batch in batches:
            if wide:
                weights = [batch.column(len(fields) + i).to_numpy(zero_copy_only=False) for i in range(figures)]
                for at, name in enumerate(fields):
                    sums[name].add(batch.column(at), weights)
                continue
            owner = batch.column(0).to_numpy(zero_copy_only=False)
            for name in fields:
                index = np.flatnonzero(owner == name)
                if len(index):
                    taken = pa.array(index)
                    sums[name].add(batch.column(1).take(taken), [batch.column(2 + i).take(taken).to_numpy(zero_copy_only=False) for i in range(figures)])
        for name in fields:
            keys, cells = list(sums[name].codes), sums[name].cells
            for low in range(0, len(keys), 50_000):
                part = keys[low : low + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(part), pa.string()), pa.array(part, pa.string()), *[pa.array(cells[i, low : low + len(part)]) for i in range(figures)]],
                    names=["field_name", "key_value", *[f"f{i}" for i in range(figures)]],
                )

    return stage


def key_figures(df: DataFrame, record_id: str, key_columns: list[str], flags: list[str]) -> DataFrame:
    """Per key column and value: ``n_records`` and, for each flag, the records in which it is true.

    A record delivered again with the same counted columns counts once; a record id with different contents
    counts once for each. Rows without a record id and null key values are not counted; null flags are
    false. Other columns of ``df`` are not read. Columns: field_name, key_value, n_records, n_<flag>.
    """
    records = df.filter(F.col(f"`{record_id}`").isNotNull()).select(
        F.col(f"`{record_id}`").alias("id"),
        *[F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(key_columns)],
        *[F.coalesce(F.col(f"`{f}`").cast("boolean"), F.lit(False)).alias(f"b{i}") for i, f in enumerate(flags)],
    )
    # the shuffle by record id both finds copies and cuts the rows into equal splits, whatever the keys
    even = records.distinct().select(*[f"k{i}" for i in range(len(key_columns))], F.lit(1).cast("bigint").alias("w"), *[F.col(f"b{i}").cast("bigint").alias(f"w{i}") for i in range(len(flags))])
    figures = 1 + len(flags)
    schema = T.StructType([T.StructField("field_name", T.StringType()), T.StructField("key_value", T.StringType()), *[T.StructField(f"f{i}", T.LongType()) for i in range(figures)]])
    partial = even.mapInArrow(_accumulate(key_columns, figures, True), schema)
    blocks = partial.repartition("field_name", "key_value").mapInArrow(_accumulate(key_columns, figures, False), schema)
    names = ["n_records", *[f"n_{f}" for f in flags]]
    return blocks.select("field_name", "key_value", *[F.col(f"f{i}").alias(n) for i, n in enumerate(names)])


def with_shares(figures: DataFrame) -> DataFrame:
    """Figures with ``total_records`` of their field and each key's share of it."""
    kept = materialise(figures, "key-figures")
    totals = kept.groupBy("field_name").agg(F.sum("n_records").alias("total_records"))  # a row per key column
    return kept.join(F.broadcast(totals), "field_name").withColumn("share", F.col("n_records") / F.col("total_records"))
