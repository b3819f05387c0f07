"""Texts into containers of fixed token capacity with little room left.

Sizes are whole numbers up to the capacity, so the packing is planned on the histogram of sizes, whose length
is bounded by the capacity however many texts there are. The plan is hierarchical: sizes are routed to
tiers, tiers are packed from the longest down, and the gaps that long windows leave are filled from all shorter
tiers before these open containers of their own. Containers either have one capacity for all tiers or each tier's own
window length. The plan lists patterns of sizes with their multiplicity; a text then finds its container from the rank it
has among texts of its size. Step groups deal the containers out by length and fill, so that each group gets a
like share of long and short, full and less full ones.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.session import bounded, materialise

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern that belongs to the byte-level vocabulary.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of one size that are ranked in one task; a size that more texts share is cut into parts by hash.
RANKED_AT_ONCE = 100_000
#: Containers of one step group.
STEP_CONTAINERS = 64


def load_tokenizer(path: str):
    """The byte-level tokenizer whose ranks stand in ``path``."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("byte-level", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """(doc_id, n_tokens) of every row; null texts have no token."""

    def count(batches):
        encoding = load_tokenizer(tokenizer)
        for batch in bounded(batches):
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`")).mapInArrow(count, "doc_id bigint, n_tokens bigint")


class Plan:
    """Containers of one layout, as runs of equal containers.

    ``tiers`` are the upper bounds of the shorter tiers. A tier opens containers of ``capacity`` or, with
    ``own_windows``, of its own bound. ``slices[size]`` lists (first rank, last rank + 1, first container): the texts of that size with these
    ranks go to consecutive containers. ``fills`` has (first container, count, tokens, capacity) of every run.
    """

    def __init__(self, capacity: int, histogram: dict[int, int], tiers: list[int] | None = None, own_windows: bool = False):
        self.slices: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.containers = 0
        self._rooms: dict[int, list[tuple[int, int, int]]] = {}
        self._sizes: list[int] = []
        self._done: dict[int, int] = defaultdict(int)
        bounds = sorted({t for t in (tiers or []) if t < capacity} | {capacity})
        tier_of = {size: bisect.bisect_left(bounds, size) for size in histogram if size > 0}
        left = {size: histogram[size] for size in sorted(tier_of, reverse=True)}
        for tier in reversed(range(len(bounds))):  # longest first: a tier opens its windows, then all shorter ones fill their gaps
            for size in (s for s in left if tier_of[s] == tier):
                left[size] = self._place(size, left[size], bounds[tier] if own_windows else capacity)
            for size in (s for s in left if tier_of[s] < tier):
                left[size] = self._place(size, left[size], None)
        self.fills = sorted((first, count, window - room, window) for room, runs in self._rooms.items() for first, count, window in runs)
        if histogram.get(0, 0):  # texts without tokens take no room; they are dealt out over all containers
            self.containers = self.containers or 1
            self.fills = self.fills or [(0, 1, 0, bounds[0] if own_windows else capacity)]

    def _give(self, room: int, first: int, count: int, window: int) -> None:
        if room not in self._rooms:
            self._rooms[room] = []
            bisect.insort(self._sizes, room)
        self._rooms[room].append((first, count, window))

    def _place(self, size: int, left: int, window: int | None) -> int:
        """Place texts of one size, the fullest containers first; the number of those left over if no ``window`` may be opened."""
        while left:
            at = bisect.bisect_left(self._sizes, size)
            if at < len(self._sizes):  # the fullest containers with room
                room = self._sizes[at]
                first, count, length = self._rooms[room].pop()
                if not self._rooms[room]:
                    del self._rooms[room]
                    self._sizes.pop(at)
                used = min(count, left)
                if used < count:
                    self._give(room, first + used, count - used, length)
            elif window is None:
                break
            else:
                room = length = window
                first, used = self.containers, -(-left // (window // size))
                self.containers += used
            rank = self._done[size]
            self.slices[size].append((rank, rank + used, first))
            self._done[size] += used
            self._give(room - size, first, used, length)
            left -= used
        return left

    def place(self, size: int, ranks: np.ndarray) -> np.ndarray:
        """The containers of texts of one size, by rank."""
        if size == 0:
            return ranks % max(1, self.containers)
        table = np.array(self.slices[size], np.int64)
        at = np.searchsorted(table[:, 0], ranks, "right") - 1
        return table[at, 2] + ranks - table[at, 0]

    def steps(self, per_step: int, full: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(runs as rows of ``fills``, ordinal of each run's first container by falling length and fill, number of groups).

        ``full`` counts the containers of full parts, which come before all planned ones.
        """
        runs = np.array(self.fills or [(0, 0, 0, 0)], np.int64)
        order = np.lexsort((-runs[:, 2], -runs[:, 3]))
        before = np.zeros(len(runs), np.int64)
        before[order] = full + np.cumsum(runs[order, 1]) - runs[order, 1]
        return runs, before, max(1, -(-(self.containers + full) // per_step))


def dealt(ordinal, groups):
    """The step group of a container by its ordinal, to and fro over the groups."""
    turn, place = ordinal // groups, ordinal % groups
    return np.where(turn % 2 == 0, place, groups - 1 - place)


def pack(sizes: DataFrame, limits: dict[str, int], step_containers: int = STEP_CONTAINERS) -> DataFrame:
    """Every row of ``sizes`` (doc_id, n_tokens) in containers of each limit.

    Columns: limit_name, container_id, step_id, doc_id, part, start_token, n_tokens, filled_tokens (of its
    container), capacity. A text larger than the capacity is split into full parts with containers of their own
    and a rest that is packed like a text; other texts are never split. Texts without tokens are placed
    too. Rows with equal ids are placed each. The limits below a capacity are its shorter tiers. A step group has at most
    ``step_containers`` containers of one limit.
    """
    return _packed(sizes, {name: (capacity, sorted(limits.values()), False) for name, capacity in limits.items()}, step_containers)


def pack_tiers(sizes: DataFrame, limits: dict[str, int], step_containers: int = STEP_CONTAINERS) -> DataFrame:
    """Every row of ``sizes`` once, in one layout with windows of every limit; columns as in :func:`pack`.

    A text goes to the shortest tier that holds it; windows of a tier have its length, and gaps of longer windows take
    shorter texts first. Step groups mix windows of all lengths in like shares.
    """
    return _packed(sizes, {"tiers": (max(limits.values()), sorted(limits.values()), True)}, step_containers)


def _packed(sizes: DataFrame, layouts: dict[str, tuple[int, list[int], bool]], step_containers: int) -> DataFrame:
    sizes = materialise(sizes, "token-counts")
    spark = sizes.sparkSession
    limit = F.explode(F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(layout[0]).cast("bigint").alias("capacity")) for n, layout in layouts.items()]))
    rows = sizes.select("doc_id", "n_tokens", limit.alias("l")).select("doc_id", "n_tokens", "l.*")
    full = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("bigint")
    rows = rows.withColumn("full", full).withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity"))
    placed, long = rows.filter("rest > 0 or full = 0"), rows.filter("full > 0")
    histograms: dict[str, dict[int, int]] = {n: {} for n in layouts}
    n_full, n_long = dict.fromkeys(layouts, 0), 0
    either = placed.select("limit_name", "rest", F.lit(0).cast("bigint").alias("full")).unionByName(long.select("limit_name", F.lit(None).cast("bigint").alias("rest"), "full"))
    for r in either.groupBy("limit_name", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect():  # at most capacity + 2 rows a limit
        if r["rest"] is None:
            n_full[r["limit_name"]], n_long = r["full"], max(n_long, r["n"])
        else:
            histograms[r["limit_name"]][r["rest"]] = r["n"]
    plans = {n: Plan(capacity, histograms[n], tiers, own) for n, (capacity, tiers, own) in layouts.items()}
    steps = {n: p.steps(step_containers, n_full[n]) for n, p in plans.items()}
    most = max((n for h in histograms.values() for n in h.values()), default=0)
    ranked = _ranked(placed, ["limit_name", "rest"], F.lit(1), most)
    shared = spark.sparkContext.broadcast({n: (p, steps[n]) for n, p in plans.items()})  # bounded by the capacities

    def containers(frames):
        for frame in frames:
            frame = frame.reset_index(drop=True)
            container, step, fill, window = (np.zeros(len(frame), np.int64) for _ in range(4))
            for (name, size), part in frame.groupby(["limit_name", "rest"]):
                plan, (runs, before, groups) = shared.value[name]
                at = part.index.to_numpy()
                c = plan.place(int(size), part["rank"].to_numpy())
                run = np.searchsorted(runs[:, 0], c, "right") - 1
                container[at], fill[at], window[at] = c, runs[run, 2], runs[run, 3]
                step[at] = dealt(before[run] + c - runs[run, 0], groups)
            yield pd.DataFrame({"limit_name": frame.limit_name, "container": container, "step_id": step, "doc_id": frame.doc_id, "part": frame.full, "start_token": frame.full * frame.capacity, "n_tokens": frame.rest, "filled_tokens": fill, "capacity": window})

    schema = "limit_name string, container bigint, step_id bigint, doc_id bigint, part bigint, start_token bigint, n_tokens bigint, filled_tokens bigint, capacity bigint"
    rest = ranked.select("limit_name", "rest", "rank", "doc_id", "full", "capacity").mapInPandas(containers, schema)
    rest = rest.withColumn("container_id", F.concat_ws("-", "limit_name", F.col("container").cast("string")))
    # a full part fills its container: it needs no plan, and its rank among the full parts gives its step group
    parts = _ranked(long, ["limit_name"], F.col("full"), n_long)
    parts = parts.withColumn("copy", F.monotonically_increasing_id()).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
    groups = F.create_map(*[x for n in layouts for x in (F.lit(n), F.lit(steps[n][2]).cast("bigint"))])
    parts = parts.withColumn("rank", F.col("rank") + F.col("part")).withColumn("groups", groups[F.col("limit_name")]).withColumn("place", F.expr("rank % groups"))
    split = parts.select(
        "limit_name",
        F.concat_ws("-", "limit_name", F.lit("full"), "doc_id", F.col("copy").cast("string"), F.col("part").cast("string")).alias("container_id"),
        F.expr("if((rank div groups) % 2 = 0, place, groups - 1 - place)").alias("step_id"),
        "doc_id", "part", (F.col("part") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"), F.col("capacity").alias("filled_tokens"), "capacity",
    )
    columns = ["limit_name", "container_id", "step_id", "doc_id", "part", "start_token", "n_tokens", "filled_tokens", "capacity"]
    return rest.select(columns).unionByName(split.select(columns))


def _ranked(rows: DataFrame, keys: list[str], weight: Column, most: int) -> DataFrame:
    """``rows`` with ``rank``: the weights of the rows before each within its key. No task ranks more than a part of a key.

    ``most`` is the number of rows of the largest key; from it follows how many parts keys are cut into.
    """
    parts = max(1, -(-most // RANKED_AT_ONCE))
    inside = Window.partitionBy(*keys, "bucket").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(parts))).withColumn("weight", weight.cast("bigint"))
    own = rows.withColumn("rank", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
    if parts == 1:
        return own.drop("bucket", "weight")
    counts = materialise(rows.groupBy(*keys, "bucket").agg(F.sum("weight").alias("n")), "part-weights")
    ahead = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = materialise(counts.select(*keys, "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead")), "part-offsets")
    # every part is small, so a plain join on (key, part) has no hot key
    return own.join(before, [*keys, "bucket"]).withColumn("rank", F.col("rank") + F.col("ahead")).drop("bucket", "weight", "ahead")


def fill_report(packed: DataFrame) -> DataFrame:
    """One row per limit (and window length): containers, tokens, the least possible number of containers and the fill."""
    by_limit = packed.groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    figures = by_limit.groupBy("limit_name", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest"))
    return figures.withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity"))).withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
