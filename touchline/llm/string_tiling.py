"""Benchmark decontamination by greedy string tiling.

A test item is found in a document as a set of tiles: longest common word runs that do not overlap on either side,
each of at least `LEAST` words. Tiles may stand in any order, so reordered passages count; an item is leaked if its
tiles cover at least `COVERAGE` of its words.

1. Every run of `LEAST` item words is a seed. Documents keep the stretches that seeds cover; no tile lies outside.
2. The seeds that documents hold are joined to item positions; (document, item) pairs whose shared seeds cannot
   reach the coverage go.
3. Each remaining pair is tiled: for falling lengths, Karp-Rabin hashes of all unmarked windows find common ones, they
   are extended, and the longest are marked first.

Words are runs of letters and digits in lower case. Items are taken in blocks of about `BLOCK_WORDS` words, one pass
over the documents for each, so what a task holds does not grow with the benchmark. Items with fewer than `LEAST`
words, null items and null or empty documents have no tiles. Repeated rows are found each; repeated items are found
under each id. A document of any length is read whole, one row at a time.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow_rows, written

LEAST = 5
COVERAGE = 0.5
BLOCK_WORDS = 1_000_000
BROADCAST_IDS = 200_000

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def _powers(n: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    out[1:] = BASE
    return np.multiply.accumulate(out)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2^64) of each window of `size` codes, from running sums of code * base^place."""
    n = len(codes)
    if n < size:
        return np.empty(0, np.uint64)
    power = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:n], dtype=np.uint64)])
    return (sums[size:] - sums[:-size]) * power[n - size::-1][:n - size + 1]  # all scaled to the last place


def _free_runs(free: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _common_windows(item, text, item_marked, text_marked, size):
    """Left-maximal pairs of equal, unmarked windows."""
    def unmarked(marked, n):
        total = np.concatenate([[0], np.cumsum(marked)])
        return np.flatnonzero(total[size:] == total[:n - size + 1])
    a, b = unmarked(item_marked, len(item)), unmarked(text_marked, len(text))
    if not len(a) or not len(b):
        return
    ha, hb = window_hashes(item, size)[a], _scaled(text, size, len(item))[b]
    order = np.argsort(ha, kind="stable")
    keys = ha[order]
    lo, hi = np.searchsorted(keys, hb, "left"), np.searchsorted(keys, hb, "right")
    hit = hi > lo
    for j, l, h in zip(b[hit].tolist(), lo[hit].tolist(), hi[hit].tolist()):
        for i in a[order[l:h]].tolist():
            if i and j and item[i - 1] == text[j - 1] and not item_marked[i - 1] and not text_marked[j - 1]:
                continue
            if (item[i:i + size] == text[j:j + size]).all():
                yield i, j


def _scaled(text: np.ndarray, size: int, item_length: int) -> np.ndarray:
    """Window hashes of the text on the item's scale: both count places from the end."""
    own = window_hashes(text, size)
    gap = item_length - len(text)
    if gap == 0:
        return own
    power = _powers(abs(gap))[abs(gap)]
    return own * (power if gap > 0 else np.uint64(pow(int(power), -1, 1 << 64)))


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(item place, text place, length) of the greedy tiling, longest first; of equal ones the first in item, then text."""
    item_marked, text_marked = np.zeros(len(item), bool), np.zeros(len(text), bool)
    found, size = [], min(len(item), len(text))
    while size >= least:
        heap = []
        for i, j in _common_windows(item, text, item_marked, text_marked, size):
            n = min(len(item) - i, len(text) - j)
            stop = (item[i:i + n] != text[j:j + n]) | item_marked[i:i + n] | text_marked[j:j + n]
            run = int(np.argmax(stop)) if stop.any() else n
            heap.append((-run, i, j))
        heapq.heapify(heap)
        while heap:
            run, i, j = heapq.heappop(heap)
            free = ~(item_marked[i:i - run] | text_marked[j:j - run])
            if free.all():
                item_marked[i:i - run] = text_marked[j:j - run] = True
                found.append((i, j, -run))
            else:
                for s, e in _free_runs(free):
                    if e - s >= size:
                        heapq.heappush(heap, (s - e, i + s, j + s))
        size = size // 2 if size // 2 > least else least if size > least else 0
    return found


class Block:
    """Items of one pass: their words as codes, and the sorted hashes of their seeds."""

    def __init__(self, rows, least: int):
        self.items = []
        for r in rows:
            words = words_of(r["text"])
            if len(words) >= least:
                self.items.append((r["item_id"], words))
        self.words = {w: _code(w) for _, words in self.items for w in words}
        self.codes = [np.array([self.words[w] for w in words], np.uint64) for _, words in self.items]
        seeds = [(self.seeds(c, least), n) for n, c in enumerate(self.codes)]
        self.table = [(int(h) - (1 << 64) if h >= 1 << 63 else int(h), n, p) for hs, n in seeds for p, h in enumerate(hs.tolist())]
        self.sorted = np.unique(np.concatenate([hs for hs, _ in seeds])) if seeds else np.empty(0, np.uint64)

    @staticmethod
    def seeds(codes: np.ndarray, least: int) -> np.ndarray:
        """Place-independent hash of each run of `least` codes."""
        n = len(codes) - least + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(least):
            out = out * BASE + codes[k:k + n]
        return out

    def hits(self, text: str | None, least: int):
        """Distinct seed hashes of a text and the codes of the stretches they cover, zeros between; None if it has none."""
        words = words_of(text)
        known = self.words
        if len(words) < least:
            return None
        codes = np.fromiter((known.get(w, 0) for w in words), np.uint64, len(words))
        seen = codes != 0
        total = np.concatenate([[0], np.cumsum(seen)])
        at = np.flatnonzero(total[least:] - total[:-least] == least)
        if not len(at):
            return None
        hashes = self.seeds(codes, least)[at]
        place = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        hit = self.sorted[place] == hashes
        if not hit.any():
            return None
        covered = np.zeros(len(words) + 1, np.int64)
        np.add.at(covered, at[hit], 1)
        np.add.at(covered, at[hit] + least, -1)
        inside = np.cumsum(covered)[:-1] > 0
        keep = inside | np.concatenate([[False], inside[:-1]])
        return np.unique(hashes[hit]).view(np.int64).tolist(), np.where(inside, codes, 0)[keep].view(np.int64).tolist()


def _block_leaks(docs: DataFrame, rows: list, least: int, coverage: float) -> DataFrame | None:
    spark = docs.sparkSession
    block = Block(rows, least)
    if not block.items:
        return None
    shared = spark.sparkContext.broadcast((block.words, block.sorted))
    held = spark.sparkContext.broadcast([(i, c) for (i, _), c in zip(block.items, block.codes)])

    def stretches(source):
        view = Block.__new__(Block)
        view.words, view.sorted = shared.value
        for ident, text in source:
            found = view.hits(text, least)
            if found:
                yield ident, *found

    hits = arrow_rows(docs.select("doc_id", "text"), "doc_id long, seeds array<long>, codes array<long>", stretches)
    hits = written(hits.withColumn("row", F.monotonically_increasing_id()), "seed-hits")
    seeds = spark.createDataFrame(block.table, "seed long, item int, place int")
    lengths = spark.createDataFrame([(n, len(c)) for n, c in enumerate(block.codes)], "item int, n_words int")
    pairs = (hits.select("row", F.explode("seeds").alias("seed")).join(F.broadcast(seeds), "seed")
             .groupBy("row", "item").agg(F.count("*").alias("n_seeds")).join(F.broadcast(lengths), "item")
             .where(F.least(F.col("n_seeds") * least, F.col("n_words")) >= F.col("n_words") * coverage))
    # One row has at most as many items as the block.
    chosen = pairs.groupBy("row").agg(F.collect_list("item").alias("items"))
    placed = hits.select("row", "doc_id", "codes").join(chosen, "row")

    def tiled(source):
        items = held.value
        for ident, codes, wanted in source:
            text = np.array(codes, np.int64).view(np.uint64)
            for n in sorted(wanted):
                item_id, item = items[n]
                runs = [t[2] for t in tiles(item, text, least)]
                if sum(runs) >= coverage * len(item):
                    yield ident, item_id, len(item), sum(runs), len(runs), max(runs), sum(runs) / len(item)

    return arrow_rows(placed.select("doc_id", "codes", "items"),
                      "doc_id long, item_id long, item_words int, covered_words int, n_tiles int, longest_tile int, coverage double", tiled)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row and item whose tiles cover enough of the item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))
    found = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        part = _block_leaks(docs, sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"])), least, coverage)
        found = part if found is None else found if part is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame(
        [], "doc_id long, item_id long, item_words int, covered_words int, n_tiles int, longest_tile int, coverage double")


def row_key() -> Column:
    """Name of a row by its id and text, null in either or not; rows equal in both share it."""
    return F.xxhash64("doc_id", "text")


def joined_by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """left_anti or left_semi join of documents with row keys (one column, doc_id). The keys are sent to all tasks if they
    are few (checked), else joined by a shuffle."""
    keys = keys.distinct().select(F.col("doc_id").alias("named_row"))
    few = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys, row_key() == keys["named_row"], how)


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose row key is not among `keys`."""
    return joined_by_key(docs, keys, "left_anti")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents, all columns as they are, less the rows that hold a test item, whether their id is null, repeated or neither."""
    marked = docs.select(row_key().alias("doc_id"), "text")
    return without(docs, written(leaks(marked, benchmark).select("doc_id"), "leaks"))
