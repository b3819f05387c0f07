"""How often items occur together, against a fitted null that honours item frequency and basket size.

Pair counts are exact: baskets are reduced to distinct sorted items, pairs come from generators and are added
up by hash before the shuffle. The null is the bipartite configuration model of each group: basket i holds
item a with probability x_i y_a / (1 + x_i y_a), where expected basket sizes and item counts equal the
observed ones. Baskets of one size share x and items of one count share y, so fitting needs two histograms,
however many baskets there are; each group is fitted once. Under the null a pair's count is a sum of independent
trials (Poisson-binomial), whose upper tail gives the surprise; Benjamini-Hochberg over all possible pairs of a
group gives q-values. Pairs of equal counts have one tail, so tails and ranks are computed per distinct
combination of counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.skew import join_by_key
from verdigris.session import materialise

#: Combinations of counts of one group that are tested in one task.
CELLS_PER_TASK = 20_000
#: Numbers held at once by the transforms of one batch of tails.
BATCH_NUMBERS = 1 << 20


def null_weights(sizes: np.ndarray, n_baskets: np.ndarray, degrees: np.ndarray, n_items: np.ndarray, tolerance: float = 1e-9, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """The weights x of basket sizes and y of item counts.

    Items in every basket and baskets with every item are certain: their weight is infinite and they leave the
    fit, which is then a fixed-point iteration of the maximum-likelihood equations. A size or count that is
    used up by what is certain has weight zero.
    """
    sizes, n_baskets, degrees, n_items = (np.asarray(v, float) for v in (sizes, n_baskets, degrees, n_items))
    x, y = np.zeros(len(sizes)), np.zeros(len(degrees))
    row_left, col_left = sizes.copy(), degrees.copy()
    rows, cols = np.ones(len(sizes), bool), np.ones(len(degrees), bool)
    while True:  # peel what is certain
        full_cols = cols & (col_left >= n_baskets[rows].sum() - 1e-9)
        if rows.any() and full_cols.any():
            y[full_cols] = np.inf
            row_left[rows] -= n_items[full_cols].sum()
            cols &= ~full_cols
            continue
        full_rows = rows & (row_left >= n_items[cols].sum() - 1e-9)
        if cols.any() and full_rows.any():
            x[full_rows] = np.inf
            col_left[cols] -= n_baskets[full_rows].sum()
            rows &= ~full_rows
            continue
        break
    rows &= row_left > 1e-9
    cols &= col_left > 1e-9
    if rows.any() and cols.any():
        k, nb, d, ni = row_left[rows], n_baskets[rows], col_left[cols], n_items[cols]
        total = (k * nb).sum()
        u, v = k / np.sqrt(total), d / np.sqrt(total)
        for _ in range(rounds):
            u = k / (ni * v / (1 + np.outer(u, v))).sum(1)
            z = 1 + np.outer(u, v)
            v = d / ((nb * u)[:, None] / z).sum(0)
            q = np.outer(u, v) / (1 + np.outer(u, v))
            if np.max(np.abs(q @ ni - k) / k) < tolerance:
                break
        x[rows], y[cols] = u, v
    return x, y


def membership(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Probabilities by (basket, item) from their weights."""
    certain = np.isinf(x)[:, None] | np.isinf(y)[None, :]
    z = np.outer(np.where(np.isinf(x), 0.0, x), np.where(np.isinf(y), 0.0, y))
    return np.where(certain, 1.0, z / (1 + z))


def fit_null(sizes: np.ndarray, n_baskets: np.ndarray, degrees: np.ndarray, n_items: np.ndarray) -> np.ndarray:
    """Membership probabilities by (basket size class, item count class)."""
    return membership(*null_weights(sizes, n_baskets, degrees, n_items))


def log_tail(counts: np.ndarray, q: np.ndarray, n_baskets: np.ndarray) -> np.ndarray:
    """log P(X >= count) for sums of ``n_baskets[k]`` trials with probabilities ``q[pair, k]``.

    The distribution is tilted so that its mean is the count, the tilted one comes from a discrete Fourier transform
    of its characteristic function around the count, and the tilt is taken back term by term. What is cut off
    or folded back lies 8 standard deviations and 16 away, so that a tail is right to about 10 digits
    however small it is and however many baskets there are.
    """
    counts, n = np.asarray(counts, float), np.asarray(n_baskets, float)
    certain, trials = (q >= 1 - 1e-12) @ n, (q > 0) @ n
    out = np.zeros(len(counts))
    out[counts > trials] = -np.inf
    inside = (counts > certain) & (counts <= trials)
    at_end = inside & (counts >= trials)
    with np.errstate(divide="ignore"):
        out[at_end] = np.where(q[at_end] > 0, np.log(np.maximum(q[at_end], 1e-300)), 0.0) @ n
    do = np.flatnonzero(inside & ~at_end)
    if len(do):
        mean = q[do] @ n
        tilt = np.where(counts[do] > mean, _tilt(counts[do], q[do], n), 0.0)
        e = q[do] * np.exp(tilt)[:, None]
        r = e / (1 - q[do] + e)
        spread = np.sqrt((r * (1 - r)) @ n)
        length = 2 ** np.ceil(np.log2(16 * spread + 32)).astype(int)
        centre = np.where(tilt > 0, counts[do], np.rint(mean))
        scale = np.log1p(q[do] * np.expm1(tilt)[:, None]) @ n - counts[do] * tilt
        for size in np.unique(length).tolist():
            of_size = np.flatnonzero(length == size)
            for low in range(0, len(of_size), max(1, BATCH_NUMBERS // size)):
                at = of_size[low : low + max(1, BATCH_NUMBERS // size)]
                mass = _mass(r[at], n, centre[at], size)
                offset = np.arange(size) - np.where(np.arange(size) < size // 2, 0, size)  # distance from the centre
                above = (centre[at, None] + offset >= counts[do[at], None]) & (centre[at, None] + offset >= 0)
                total = np.where(above, mass * np.exp(-tilt[at, None] * np.where(above, centre[at, None] + offset - counts[do[at], None], 0)), 0.0).sum(1)
                out[do[at]] = np.log(np.maximum(total, 1e-300)) + scale[at]
    return np.minimum(out, 0.0)


def _tilt(counts: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """About the s for which trials with odds multiplied by exp(s) have mean ``counts``; how near doesn't matter."""
    s = np.clip(np.log(counts / np.maximum(q @ n, 1e-300)), -50, 50)
    low, high = np.full(len(counts), -60.0), np.full(len(counts), 700.0)
    for _ in range(60):  # Newton inside a shrinking bracket
        e = q * np.exp(np.minimum(s, 600))[:, None]
        r = e / (1 - q + e)
        gap, slope = r @ n - counts, np.maximum((r * (1 - r)) @ n, 1e-300)
        if np.all(np.abs(gap) <= 0.01 * np.sqrt(slope) + 1e-9):
            break
        high, low = np.where(gap > 0, s, high), np.where(gap > 0, low, s)
        step = s - gap / slope
        s = np.where((step > low) & (step < high), step, (low + high) / 2)
    return np.maximum(s, 0.0)


def _mass(r: np.ndarray, n: np.ndarray, centre: np.ndarray, size: int) -> np.ndarray:
    """P(X = centre + j) modulo ``size``, for j = 0, 1, ..., -2, -1, of sums of trials with probabilities ``r[pair, k]``."""
    angle = 2 * np.pi * np.arange(size // 2 + 1) / size
    # a sum of variance v has a characteristic function of at most exp(-v (1 - cos)); beyond exp(-45) it adds nothing
    angle = angle[((r * (1 - r)) @ n).min() * (1 - np.cos(angle)) <= 45]
    cos, sin = np.cos(angle), np.sin(angle)
    size_log, turn = np.zeros((len(r), len(angle))), np.outer(-(centre % size), angle)
    for k, times in enumerate(n):
        p = r[:, k : k + 1]
        size_log += 0.5 * times * np.log(np.maximum(1 - 2 * p * (1 - p) * (1 - cos), 1e-300))
        turn += times * np.arctan2(p * sin, 1 - p + p * cos)
    spectrum = np.zeros((len(r), size // 2 + 1), complex)
    spectrum[:, : len(angle)] = np.exp(size_log) * (np.cos(turn) - 1j * np.sin(turn))
    return np.maximum(np.fft.irfft(spectrum, size, axis=1), 0.0)


def over_groups(df: DataFrame, keys: list[str], order: list[str], function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``function`` over the rows of each key, in as many tasks as the session shuffles into.

    Partitions are sorted by key and streamed, so that thousands of small keys cost one call of Python's worker, and a
    worker holds one key at a time. Keys hold no nulls.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def stage(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            if not table.num_rows:
                continue
            same = [pc.equal(table.column(k), table.column(k)[-1]) for k in keys]
            whole = int(pc.index(reduce(pc.and_, same), True).as_py())  # the last key may go on in the next batch
            held = table.slice(whole).combine_chunks().to_batches()
            yield from _each(table.slice(0, whole))
        if held:
            yield from _each(pa.Table.from_batches(held))

    def _each(table: pa.Table):
        if not table.num_rows:
            return
        table = table.combine_chunks()
        new = reduce(pc.or_, [pc.not_equal(table.column(k).slice(1), table.column(k).slice(0, table.num_rows - 1)) for k in keys])
        starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), table.num_rows]
        made = [function(table.slice(low, high - low)) for low, high in zip(starts, starts[1:])]
        yield from pa.concat_tables([m for m in made if m.num_rows] or made[:1]).to_batches()

    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(stage, schema)


def _fit_group(null: pa.Table) -> pa.Table:
    """The rows of one group's null with their weights."""
    level, n = (null.column(c).to_numpy().astype(float) for c in ("level", "n"))
    is_size = null.column("is_size").to_numpy()
    weight = np.zeros(len(level))
    weight[is_size], weight[~is_size] = null_weights(level[is_size], n[is_size], level[~is_size], n[~is_size])
    return null.append_column("weight", pa.array(weight))


_NULL_ROW = "group_key string, is_size boolean, level bigint, n bigint, weight double"
_CELL_COUNTS = ["n_ab", "n_low", "n_high", "n_pairs"]
_CELL = "group_key string, n_ab bigint, n_low bigint, n_high bigint, n_pairs bigint, n bigint, n_items bigint, expected double, log_p double"


def _test_cells(rows: pa.Table) -> pa.Table:
    """Expected count and tail of combinations of counts of one group, or of a slice of them, behind the rows of its null."""
    weight = rows.column("weight")
    is_null_row = weight.is_valid().to_numpy()
    null, cells = rows.filter(pa.array(is_null_row)), rows.filter(pa.array(~is_null_row))
    level, n, weight = (null.column(c).to_numpy() for c in ("level", "n", "weight"))
    is_size = null.column("is_size").to_numpy()
    of_size = n[is_size].astype(float)
    order = np.argsort(level[~is_size])
    degrees = level[~is_size][order]
    p = membership(weight[is_size], weight[~is_size][order])
    counts, low_count, high_count, _ = (cells.column(c).to_numpy() for c in _CELL_COUNTS)
    a, b = np.searchsorted(degrees, low_count), np.searchsorted(degrees, high_count)
    expected, tail = np.empty(len(counts)), np.empty(len(counts))
    for low in range(0, len(counts), 4096):
        part = slice(low, low + 4096)
        q = (p[:, a[part]] * p[:, b[part]]).T
        expected[part] = q @ of_size
        tail[part] = log_tail(counts[part], q, of_size)
    same = [pa.array(np.full(len(counts), value, np.int64)) for value in (int(of_size.sum()), int(n[~is_size].sum()))]
    columns = [cells.column(c) for c in ("group_key", *_CELL_COUNTS)] + same + [pa.array(expected), pa.array(np.maximum(tail, -1e300))]
    return pa.table(columns, names=[part.split()[0] for part in _CELL.split(", ")])


def marked_counts(df: DataFrame, record: str, group: str | None, items: str) -> DataFrame:
    """Exact counts in one pass over the baskets: (group_key, item_a, item_b, n_ab).

    A pair of one item is its own count. Rows without ``item_a`` count the baskets of the size in ``item_b``.
    """
    key = F.col(f"`{group}`") if group else F.lit("all")
    rows = df.filter(F.col(f"`{record}`").isNotNull()).select(F.col(f"`{record}`").alias("record"), key.cast("string").alias("group_key"), F.array_sort(F.array_distinct(F.array_compact(F.col(f"`{items}`")))).alias("items"))
    baskets = rows.filter("group_key is not null and size(items) > 0").distinct()
    firsts = baskets.select("group_key", "items", F.posexplode("items").alias("at", "item_a"))
    # the first item also gives a null partner, which stands for the basket itself
    partners = F.concat(F.slice("items", F.col("at") + 1, F.size("items") - F.col("at")), F.when(F.col("at") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    pairs = firsts.select("group_key", F.col("item_a").cast("string").alias("item"), F.size("items").cast("string").alias("size"), F.explode(partners).alias("partner"))
    both = pairs.select("group_key", F.when(F.col("partner").isNotNull(), F.col("item")).alias("item_a"), F.coalesce("partner", "size").alias("item_b"))
    return both.groupBy("group_key", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab"))


def pair_counts(df: DataFrame, record: str, group: str | None, items: str) -> tuple[DataFrame, DataFrame]:
    """(baskets by group and size, exact counts by group and pair, where a pair of one item is its own count).

    A record counts once however often it was delivered, an item once per record. Records without an id, a
    group (where one is named) or any item are left out, null items too. A record id with different contents
    counts once for each.
    """
    counts = marked_counts(df, record, group, items)
    sizes = counts.filter("item_a is null").select("group_key", F.col("item_b").cast("bigint").alias("level"), F.col("n_ab").alias("n"))
    return sizes, counts.filter("item_a is not null")


def surprising_pairs(df: DataFrame, record: str, group: str | None, items: str, min_support: int = 1) -> DataFrame:
    """Every pair of items with at least ``min_support`` common records, its null expectation and surprise.

    Columns: group_key, item_a < item_b, n_ab, n_a, n_b, n (records of the group), n_items, expected, log_p and log_q
    (natural logarithms of the tail and its false-discovery value), lift. ``min_support`` only chooses the
    pairs that are given; all pairs are tested and ranked. An empty table gives no rows.
    """
    kept = materialise(marked_counts(df, record, group, items), "pair-counts")
    own = kept.filter("item_a = item_b").select("group_key", F.col("item_a").alias("item"), F.col("n_ab").alias("n_item"))
    sizes = kept.filter("item_a is null").select("group_key", F.lit(True).alias("is_size"), F.col("item_b").cast("bigint").alias("level"), F.col("n_ab").alias("n"))
    degrees = own.groupBy("group_key", F.lit(False).alias("is_size"), F.col("n_item").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    fitted = materialise(over_groups(sizes.unionByName(degrees), ["group_key"], [], _fit_group, _NULL_ROW), "fitted-null")
    together = kept.filter("item_a != item_b")
    for side in ("a", "b"):
        together = join_by_key(together, own.select("group_key", F.col("item").alias(f"item_{side}"), F.col("n_item").alias(f"n_{side}")), ["group_key", f"item_{side}"])
    together = materialise(together.withColumns({"n_low": F.least("n_a", "n_b"), "n_high": F.greatest("n_a", "n_b")}), "pairs")
    tested = tested_cells(together.groupBy("group_key", "n_ab", "n_low", "n_high").agg(F.count(F.lit(1)).alias("n_pairs")), fitted)
    ranked = materialise(with_false_discovery(tested).drop("n_pairs"), "ranked-cells")
    out = join_by_key(together.filter(F.col("n_ab") >= min_support), ranked, ["group_key", "n_ab", "n_low", "n_high"])
    columns = ["group_key", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", "n_items", "expected", "log_p", "log_q"]
    return out.select(*columns, (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"))


def tested_cells(cells: DataFrame, fitted: DataFrame) -> DataFrame:
    """The combinations of counts with expectation and tail; a group's combinations are cut into slices by hash."""
    cells = materialise(cells, "cells")
    slices = cells.groupBy("group_key").agg(F.ceil(F.count(F.lit(1)) / CELLS_PER_TASK).cast("int").alias("slices"))
    cells = cells.join(slices, "group_key").withColumn("slice", F.pmod(F.xxhash64("n_ab", "n_low", "n_high"), F.col("slices")).cast("int")).drop("slices")
    null = fitted.join(slices.select("group_key", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")), "group_key")
    both = null.unionByName(cells, allowMissingColumns=True)
    return over_groups(both, ["group_key", "slice"], [F.col("weight").isNull()], _test_cells, _CELL)


def with_false_discovery(tested: DataFrame, per_unit: int = 8) -> DataFrame:
    """Benjamini-Hochberg values over the ``n_items`` choose 2 possible pairs of each group.

    ``tested`` has a row per combination of counts with ``n_pairs`` pairs. Ranks come from numbers of pairs per coarse
    step of log p plus a rank inside each step, so that no task sorts a whole group. Equal tails share the highest of
    their ranks. A tail of one can't be a discovery and isn't ranked.
    """
    step = F.floor(F.greatest(F.col("log_p"), F.lit(-1e15)) * per_unit)
    # near the top many pairs have log p of about 0; finer steps there keep every step small
    fine = F.when(F.col("log_p") > -1, F.floor(F.exp("log_p") * 4096)).otherwise(F.lit(0))
    stored = materialise(tested.withColumn("step", step).withColumn("fine", fine), "tested-cells")
    kept = stored.filter("log_p < 0")
    counts = kept.groupBy("group_key", "step", "fine").agg(F.sum("n_pairs").alias("n_step"))
    ordered = Window.partitionBy("group_key").orderBy("step", "fine")
    before = counts.withColumn("before", F.sum("n_step").over(ordered.rowsBetween(Window.unboundedPreceding, -1))).drop("n_step")
    inside = Window.partitionBy("group_key", "step", "fine").orderBy("log_p").rangeBetween(Window.unboundedPreceding, 0)
    tests = F.log(F.greatest(F.col("n_items") * (F.col("n_items") - 1) / 2, F.lit(1.0)))
    rank = F.coalesce(F.col("before"), F.lit(0)) + F.sum("n_pairs").over(inside)
    raw = kept.join(before, ["group_key", "step", "fine"]).withColumn("raw", F.col("log_p") + tests - F.log(rank))
    least = raw.groupBy("group_key", "step", "fine").agg(F.min("raw").alias("least"))
    later = least.withColumn("later", F.min("least").over(ordered.rowsBetween(1, Window.unboundedFollowing))).drop("least")
    after = Window.partitionBy("group_key", "step", "fine").orderBy(F.desc("log_p")).rangeBetween(Window.unboundedPreceding, 0)
    value = F.least(F.min("raw").over(after), F.coalesce("later", F.lit(0.0)), F.lit(0.0))
    ranked = raw.join(later, ["group_key", "step", "fine"]).withColumn("log_q", value)
    return ranked.select(*tested.columns, "log_q").unionByName(stored.filter("log_p >= 0").select(*tested.columns, F.lit(0.0).alias("log_q")))
