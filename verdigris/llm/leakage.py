"""Passages of held-out items inside documents, by spaced-seed hashing.

Words are compared in the consistent form of look-alike characters and in lower case. Fixed masks of eight words
ignore some positions; the masked windows of items and documents are hashed and joined, and every
hit is verified along its diagonal: exact runs of eight or more words, and windows that agree but for a few
substituted words. Windows that occur in two or more items seed nothing and count nothing; a window of one item
seeds under every mask, also where its masked form occurs in other items.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.lookalike import Rewriter
from verdigris.operators.skew import join_by_key
from verdigris.session import bounded, materialise

#: Words of the shortest run that counts.
RUN = 8
#: Spaced seeds over a run's words (1: compared). Each fits in a run and every own window is seeded, so that no exact run
#: is missed; together they hit a tolerant window wherever its two substituted words stand (all 66 placements).
MASKS = ("11100101", "10110011")
#: A tolerant window has this many words, of which at least ``TOLERANT_HITS`` agree in place.
TOLERANT_WINDOW, TOLERANT_HITS = 12, 10
#: Items with at most this many words in all go to every task (about 90 bytes a word there, 500 while the driver builds
#: the index); more are joined by a shuffle.
BROADCAST_WORDS = 500_000
#: Bits of the filter that keeps windows of documents without a seed out of that shuffle: 16 a seed, within these bounds.
#: A fuller filter lets more windows through and loses none.
FILTER_BITS = (1 << 20, 1 << 29)
_BLOCK_BITS = 1 << 18
#: Candidate items that a document meets at once.
ITEMS_AT_ONCE = 256
#: Words of items that are compared at once.
VERIFIED_WORDS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
#: Fixed odd multipliers of the window hash, one per position.
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3) + 0x632BE59BD9B4E019 * i) | 1 for i in range(RUN)], object) % (1 << 64)
FACTORS = _FACTORS.astype(np.uint64)


def words(text: str | None, form: Rewriter) -> list[str]:
    """The words of a text: runs of letters and digits in the consistent form, in lower case."""
    return _WORD.findall(form(text).lower()) if text else []


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """One hash per window of ``RUN`` word ids; positions the mask ignores add nothing."""
    n = len(ids) - RUN + 1
    out = np.zeros(max(n, 0), np.uint64)
    for at, bit in enumerate(mask):
        if n > 0 and bit == "1":
            mixed = ids[at : at + n].astype(np.uint64) * FACTORS[at]
            out += (mixed ^ (mixed >> np.uint64(29))) * FACTORS[-1 - at]
    return out


def covered(equal: np.ndarray, allowed: np.ndarray, window: int, least: int) -> np.ndarray:
    """Positions of ``equal`` that agree inside a window with ``least`` agreements that starts at an allowed position."""
    if len(equal) < window:
        return np.zeros(len(equal), bool)
    total = np.concatenate([[0], np.cumsum(equal)])
    sums = total[window:] - total[:-window]
    starts = (sums >= least) & allowed[: len(sums)]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(len(equal), bool)
    inside = np.zeros(len(equal) + 1, np.int64)
    inside[at] += 1
    inside[at + window] -= 1
    return (np.cumsum(inside[:-1]) > 0) & equal


class ItemIndex:
    """The seeds of all items, sorted by hash.

    ``items`` has a row per text; rows of one item id own their windows together. ``own`` tells which windows are
    their item's own where other items than these count too.
    """

    def __init__(self, items: list[tuple[int, list[str]]], own: list[np.ndarray] | None = None):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
        self.own = own if own is not None else self._own()
        # places where a run may start, and those where a tolerant window holds an own window somewhere in it
        starts = [np.concatenate([own, np.zeros(len(ws) - len(own), bool)]) for ws, own in zip(self.words, self.own, strict=True)]
        near = [np.convolve(s, np.ones(TOLERANT_WINDOW - RUN + 1), "full")[TOLERANT_WINDOW - RUN :] > 0 if len(s) else s for s in starts]
        near = [n & (np.arange(len(n)) <= len(n) - TOLERANT_WINDOW) for n in near]
        none = np.zeros(0, bool)
        self.lengths = np.array([len(ws) for ws in self.words], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat, self.flat_starts, self.flat_near = np.concatenate([none.astype(np.int64), *self.words]), np.concatenate([none, *starts]), np.concatenate([none, *near])
        places = [np.flatnonzero(own) for own in self.own]
        owner = np.repeat(np.arange(len(items)), [len(p) for p in places])
        p = np.concatenate([np.zeros(0, np.int64), *places])
        self.seeds = []
        for mask in MASKS:
            h = np.concatenate([np.zeros(0, np.uint64), *[seed_hashes(ws, mask)[own] for ws, own in zip(self.words, self.own, strict=True)]])
            order = np.argsort(h, kind="stable")
            self.seeds.append((mask, h[order], owner[order], p[order]))

    def _own(self) -> list[np.ndarray]:
        """Which windows of every row occur in no other item."""
        keys = [[tuple(ws[j : j + RUN]) for j in range(len(ws) - RUN + 1)] for ws in (w.tolist() for w in self.words)]
        owners: dict[tuple, int | None] = {}
        for item, mine in zip(self.ids, keys, strict=True):
            for key in set(mine):
                if owners.setdefault(key, item) != item:
                    owners[key] = None
        return [np.array([owners[key] is not None for key in mine], bool) for mine in keys]

    def encode(self, document: list[str]) -> np.ndarray:
        look = self.vocabulary.get
        return np.fromiter((look(w, 0) for w in document), np.int64, len(document))

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """(item, place in the words, place - item place) of every seed hit."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, hashes, owner, place in self.seeds:
            if len(ids) < RUN or not len(hashes):
                continue
            known = ids > 0
            inside = np.ones(len(ids) - RUN + 1, bool)
            for i, bit in enumerate(mask):
                if bit == "1":
                    inside &= known[i : len(inside) + i]
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            h = seed_hashes(ids, mask)[at]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            times = high - low
            if times.any():
                start = np.repeat(at, times)
                seed = np.repeat(low, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
                found.append(np.stack([owner[seed], start, start - place[seed]], axis=1))
        return np.concatenate(found)

    def search(self, documents: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(document, item id, exact words, tolerant words) over a batch of encoded documents.

        The documents are looked up as one row of words, with gaps that no window crosses.
        """
        gap = np.zeros(RUN, np.int64)
        starts = np.cumsum([0, *[len(d) + RUN for d in documents]])
        row = np.concatenate([x for d in documents for x in (d, gap)] or [gap])
        found = self.hits(row)
        owner = np.searchsorted(starts, found[:, 1], "right") - 1
        diagonals = np.unique(np.stack([owner, found[:, 0], found[:, 2]], axis=1), axis=0)
        return self.verify(row, starts, diagonals)

    def verify(self, row: np.ndarray, starts: np.ndarray, diagonals: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item id, words in exact runs, words in tolerant windows) of diagonals (document, item, shift in ``row``).

        All diagonals of a batch are laid out behind each other and compared at once; no window crosses from one to
        the next, for none may start where it would leave its item.
        """
        exact: dict[tuple[int, int], np.ndarray] = {}
        tolerant: dict[tuple[int, int], np.ndarray] = {}
        ends = np.cumsum(self.lengths[diagonals[:, 1]])
        low = 0
        while low < len(diagonals):  # so many diagonals at once that their words fit in a bounded array
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + VERIFIED_WORDS, "right")))
            part = diagonals[low:high]
            length = self.lengths[part[:, 1]]
            begin = np.cumsum(length) - length
            inner = np.arange(length.sum()) - np.repeat(begin, length)
            mine = np.repeat(self.offsets[part[:, 1]], length) + inner
            theirs = np.repeat(part[:, 2], length) + inner
            inside = (theirs >= np.repeat(starts[part[:, 0]], length)) & (theirs < np.repeat(starts[part[:, 0] + 1] - RUN, length))
            equal = inside & (self.flat[mine] == row[np.where(inside, theirs, 0)])
            runs, near = covered(equal, self.flat_starts[mine], RUN, RUN), covered(equal, self.flat_near[mine], TOLERANT_WINDOW, TOLERANT_HITS)
            for at in np.flatnonzero(np.add.reduceat(runs | near, begin) if len(begin) else begin).tolist():
                doc, item, _ = part[at].tolist()
                own = slice(begin[at], begin[at] + length[at])
                exact[doc, item] = exact.get((doc, item), False) | runs[own]
                tolerant[doc, item] = tolerant.get((doc, item), False) | near[own]
            low = high
        return [(doc, self.ids[item], int(exact[doc, item].sum()), int((exact[doc, item] | tolerant[doc, item]).sum())) for doc, item in exact]


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, exact_words, tolerant_words, item_words) for documents with a verified seed hit.

    ``exact_words`` are the item's words that stand in the document in runs of at least ``RUN`` of them that
    occur in no other item; ``tolerant_words`` adds those in windows with substituted words. Items with
    equal texts share all their runs and match nothing. Null ids and texts are left out; empty texts match nothing.
    """
    form = Rewriter()
    documents = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("doc_id is not null and text is not null")
    held_out = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("item_text")).filter("item_id is not null and item_text is not null").distinct()
    # scripts without blanks count by length, ten characters a word
    size = held_out.agg(F.coalesce(F.sum(F.greatest(F.regexp_count("item_text", F.lit(r"\S+")), F.ceil(F.length("item_text") / 10))), F.lit(0)).alias("n")).first()["n"]
    if size > broadcast_words:
        return _joined_leaks(documents, held_out, form)
    index = ItemIndex([(r["item_id"], words(r["item_text"], form)) for r in held_out.collect()])  # checked above

    def search(batches):
        for batch in bounded(batches):
            encoded = [index.encode(words(batch.column(1)[at].as_py(), form)) for at in range(batch.num_rows)]
            rows = [(batch.column(0)[at].as_py(), *r) for at, *r in index.search(encoded)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "item_id", "exact_words", "tolerant_words"])

    return documents.mapInArrow(search, "doc_id bigint, item_id bigint, exact_words bigint, tolerant_words bigint").filter("tolerant_words > 0").distinct()


def _word_hashes(text: str | None, form: Rewriter) -> np.ndarray:
    import xxhash

    ws = words(text, form)
    return np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in ws), np.int64, len(ws))


def _bits(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each seed in a filter of ``bits``, a power of two."""
    u = seeds.astype(np.int64).view(np.uint64)
    return (u & np.uint64(bits - 1)).astype(np.int64), ((u * FACTORS[0]) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


class SeedFilter:
    """A Bloom filter: tells windows that may hold a seed from those that hold none."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits = bits
        self.cells = np.zeros(bits // 8, np.uint8)
        for block, cells in blocks.items():
            self.cells[block * _BLOCK_BITS // 8 : (block + 1) * _BLOCK_BITS // 8] = np.frombuffer(cells, np.uint8)

    def may_hold(self, seeds: np.ndarray) -> np.ndarray:
        one, other = _bits(seeds, self.bits)
        return ((self.cells[one >> 3] >> (one & 7)) & (self.cells[other >> 3] >> (other & 7)) & 1).astype(bool)


def seed_filter(seeds: DataFrame) -> SeedFilter:
    """The filter over the column ``seed``, put together from blocks that are built apart; its size is bounded."""
    bits = 1 << max(FILTER_BITS[0], min(FILTER_BITS[1], 16 * seeds.count())).bit_length() - 1

    def places(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_bits(batch.column(0).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at // _BLOCK_BITS).astype(np.int32)), pa.array((at % _BLOCK_BITS).astype(np.int32))], names=["block", "place"])

    def block(rows: pa.Table) -> pa.Table:
        cells = np.zeros(_BLOCK_BITS, np.uint8)
        cells[rows.column("place").to_numpy()] = 1
        return pa.table({"block": rows.column("block").slice(0, 1), "cells": pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())})

    made = seeds.select("seed").mapInArrow(places, "block int, place int").distinct().groupBy("block").applyInArrow(block, "block int, cells binary")
    return SeedFilter(bits, {r["block"]: bytes(r["cells"]) for r in made.collect()})  # FILTER_BITS[1] bits at most


def _joined_leaks(documents: DataFrame, held_out: DataFrame, form: Rewriter) -> DataFrame:
    """The same for item sets too large for every task: seeds meet in a shuffle join, candidates are verified in pairs.

    Words are 63-bit hashes here. Whether a window is an item's own is counted over all items first. An item's
    texts are rows of their own, for an id delivered with several texts has different windows in each. Of the
    documents' windows only those that pass a filter of the seeds are shuffled.
    """
    held_out = materialise(held_out.withColumn("text_row", F.monotonically_increasing_id()), "item-texts")

    def windows(batches):
        for batch in bounded(batches):
            for at in range(batch.num_rows):
                ids = _word_hashes(batch.column(1)[at].as_py(), form)
                full = seed_hashes(ids, "1" * RUN)
                n = len(full)
                for number, mask in enumerate(MASKS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[at].as_py()] * n, pa.int64()), pa.array([number] * n, pa.int32()), pa.array(seed_hashes(ids, mask).view(np.int64)), pa.array(full.view(np.int64)), pa.array(np.arange(n, dtype=np.int32))],
                        names=["id", "mask", "seed", "full", "place"],
                    )

    own = materialise(held_out.select("text_row", "item_text").mapInArrow(windows, "id bigint, mask int, seed bigint, full bigint, place int"), "item-windows")
    owners = held_out.select(F.col("text_row").alias("id"), "item_id")
    once = own.filter("mask = 0").join(owners, "id").groupBy("full").agg(F.count_distinct("item_id").alias("n")).filter("n = 1").select("full")
    own = materialise(own.join(once, "full", "left_semi"), "own-windows")
    seeds = materialise(own.select("mask", "seed", F.col("id").alias("text_row")).distinct(), "seeds")
    shared = documents.sparkSession.sparkContext.broadcast(seed_filter(seeds.select("seed").distinct()))

    def passing(batches):
        for batch in bounded(batches, 256):
            rows, numbers, found = [], [], []
            for at in range(batch.num_rows):
                ids = _word_hashes(batch.column(1)[at].as_py(), form)
                for number, mask in enumerate(MASKS):
                    mine = np.unique(seed_hashes(ids, mask).view(np.int64))
                    mine = mine[shared.value.may_hold(mine)]
                    rows.append(np.full(len(mine), at))
                    numbers.append(np.full(len(mine), number, np.int32))
                    found.append(mine)
            index = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), pa.array(np.concatenate(numbers) if rows else np.zeros(0, np.int32)), pa.array(np.concatenate(found) if rows else np.zeros(0, np.int64))], names=["doc_id", "mask", "seed"])

    theirs = documents.mapInArrow(passing, "doc_id bigint, mask int, seed bigint")
    pairs = materialise(theirs.join(seeds, ["mask", "seed"]).select("doc_id", "text_row").distinct(), "candidates")
    places = own.filter("mask = 0").groupBy("id").agg(F.collect_list("place").alias("places")).withColumnRenamed("id", "text_row")  # one text's windows
    texts = materialise(held_out.join(places, "text_row"), "candidate-items")
    # a document meets its candidates in blocks, so that its words are read once for many items, never for all of any number
    blocks = materialise(pairs.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / ITEMS_AT_ONCE).cast("int").alias("blocks")), "candidate-blocks")
    pairs = join_by_key(pairs, blocks, ["doc_id"]).withColumn("block", F.pmod(F.xxhash64("text_row"), F.col("blocks"))).drop("blocks")
    pairs = join_by_key(materialise(pairs, "blocked-candidates"), texts, ["text_row"], broadcast_rows=0)  # texts have no bound in bytes; those of hot items are at most a hundred
    met = pairs.groupBy("doc_id", "block").agg(F.collect_list(F.struct("item_id", "item_text", "places")).alias("candidates"))
    joined = met.join(documents, "doc_id").select("doc_id", "text", "candidates")

    def verify(batches):
        for batch in bounded(batches, 16):
            rows = []
            for at in range(batch.num_rows):
                items, owned = [], []
                for candidate in batch.column(2)[at].as_py():
                    item_words = words(candidate["item_text"], form)
                    mine = np.zeros(max(0, len(item_words) - RUN + 1), bool)
                    mine[np.asarray(candidate["places"], int)] = True
                    items.append((candidate["item_id"], item_words))
                    owned.append(mine)
                index = ItemIndex(items, owned)
                rows += [(batch.column(0)[at].as_py(), *r) for _, *r in index.search([index.encode(words(batch.column(1)[at].as_py(), form))])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "item_id", "exact_words", "tolerant_words"])

    return joined.mapInArrow(verify, "doc_id bigint, item_id bigint, exact_words bigint, tolerant_words bigint").filter("tolerant_words > 0").distinct()
