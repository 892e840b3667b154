"""N-gram Jaccard join over a count-vector R-tree.

A document is the set of its distinct word shingles. Two documents link when 100 * |A & B| >= 80 * |A | B|. The join gives
each document the smallest id it can reach by links.

* Equal sets are one class (a 64-bit sum of shingle hashes names it), so exact copies cost one row each.
* Two linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each in any fixed order (prefix rule).
  The order puts shingles last that occur in many documents, by counts over all of them in a fixed table of slots;
  any order is right, this one keeps the buckets of common passages out. Classes meet in the buckets of their
  prefix shingles.
* At the first shingle that two sets share, at places i and j of their orders, no more than min(n - i, m - j) shingles can be common. So
  a pair is looked at only where that reaches the overlap it needs, which its first shared shingle always does if it links; the
  shorter set stands there within its first ninth, and buckets without such a place are dropped before anything else is read.
* Each class is a point: its shingles are hashed into `GROUPS` groups and counted. The sum of coordinate minima bounds the
  overlap from above. A bucket's points are packed into an R-tree; a node's largest coordinates and least size bound
  every point below it. A pair that passes is bounded once more in the task by a map of `BITS` hashed places: a place that only one set
  fills holds a shingle of its own. Only pairs that pass are looked at further.
* Star passes take from each bucket, for every point, the one survivor of another component that comes first in a fixed
  random order. These pairs are bounded once more by `FINE` groups, verified on the full sets, and give components. A group of
  copies costs rows in proportion to its size. They end when the pairs left across components are few, or when a pass no longer
  halves them: what is left then are buckets of texts that do not link, which only the last pass can settle.
* The last pass takes buckets that still hold several components: every survivor pair across components is verified. With
  it no link between components is lost; pairs inside one component need no row. Large buckets are dealt to several
  tasks in blocks in all passes.

Hashes have 64 bits, 48 where two sets are compared; that two shingles or sets fall together there is taken as impossible. Words are split at
ASCII white space after lower-casing A-Z. Fewer than five words are one shingle; null, empty and blank texts have none
and link with nothing. Repeated rows each get their row. A null doc_id takes part in links; a component without any id is
null. Other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow_rows, mapped, written
from touchline.llm.components import components
from touchline.llm.shingles import MIX1, MIX2, WordHasher, mixed, shingle_sets
from touchline.llm.string_tiling import joined_by_key, row_key, without

GROUPS = 128
LEAF = 16            # points of a leaf, and children of a node
ORDERS = 4           # random orders of the star passes
STARS = 4            # most star passes
WORTH = 8            # pairs for each row of a bucket above which another star pass is made
BITS = 1536          # places of the map of a set, beside its counts
FINE = 1024          # groups of the second bound, on pairs
BLOCK = 4096         # most points of a bucket in one tree
SLOTS = 1 << 20      # of the table of shingle counts
COMMON = 1 << 16     # most slots that the order sets apart
SENT = 200_000       # most class names that are sent to all tasks


def set_name(shingles: np.ndarray) -> int:
    """64-bit name of a set, signed; 0 for the empty set."""
    if not len(shingles):
        return 0
    return int(mixed(mixed(shingles ^ MIX2).sum(dtype=np.uint64)[None] + np.uint64(len(shingles))).view(np.int64)[0])


def vector(shingles: np.ndarray) -> np.ndarray:
    """Counts by group, cut at 255, which stands for any larger count."""
    return np.minimum(np.bincount((shingles >> np.uint64(57)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8)


def needed(a, b):
    """Least overlap at which sets of sizes a and b link: 9 * overlap >= 4 * (a + b)."""
    return (4 * (a + b) + 8) // 9


def prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Map of hashed places that the set fills."""
    bits = np.zeros(BITS, np.uint8)
    bits[((shingles >> np.uint64(30)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits)


def _apart(n, m, x, y):
    """Largest overlap that two maps of sets of n and m shingles allow."""
    only_x = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
    only_y = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
    return np.minimum(n - only_x, m - only_y)


def _wide(v: np.ndarray) -> np.ndarray:
    """Vectors for bounds: a cut count may be any larger one."""
    return np.where(v == 255, np.int32(1 << 20), v.astype(np.int32))


class CountTree:
    """R-tree over count vectors, packed by size and the widest coordinates. `rooms` are the shingles from the bucket's place on, `maps` the maps."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rooms: np.ndarray, maps: np.ndarray):
        self.points, self.sizes, self.rooms, self.maps = points, sizes, rooms, maps
        spread = points.std(axis=0)
        c1, c2 = np.argsort(spread)[-2:]
        n = len(sizes)
        slab = max(LEAF, int(LEAF * max(1, n // LEAF) ** (2 / 3)))
        order = np.argsort(sizes, kind="stable")
        tile = np.arange(n) // slab
        order = order[np.lexsort((points[order, c1], tile))]
        strip = np.arange(n) // max(LEAF, slab // 4)
        self.order = order[np.lexsort((points[order, c2], strip))]
        self.levels = []  # from the leaves up: (largest coordinates, least size)
        top, least = points[self.order], sizes[self.order]
        while True:
            starts = np.arange(0, len(least), LEAF)
            top, least = np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(least, starts)
            self.levels.append((top, least))
            if len(least) == 1:
                break

    def survivors(self, query: np.ndarray, size: np.ndarray, room: np.ndarray, maps: np.ndarray):
        """(query place, point place) of all pairs whose bounds reach the overlap they need."""
        q, node = np.arange(len(size)), np.zeros(len(size), np.int64)
        for top, least in reversed(self.levels):
            keep = self._reaches(query, size, room, q, top, least, node)
            q, node = q[keep], node[keep]
            width = len(self.order) if top is self.levels[0][0] else None
            child = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            q = np.repeat(q, LEAF)
            limit = width if width is not None else len(self._below(top))
            inside = child < limit
            q, node = q[inside], child[inside]
        found = self.order[node]
        keep = pairs_fit((query, size, room, maps), q, (self.points, self.sizes, self.rooms, self.maps), found)
        return q[keep], found[keep]

    def _below(self, top):
        at = next(i for i, level in enumerate(self.levels) if level[0] is top)
        return self.levels[at - 1][1]

    @staticmethod
    def _reaches(query, size, room, q, points, sizes, at):
        keep = np.zeros(len(q), bool)
        for s in range(0, len(q), 20_000):
            i, j = q[s:s + 20_000], at[s:s + 20_000]
            bound = np.minimum(query[i], points[j]).sum(axis=1)
            n = size[i]
            m = np.maximum(sizes[j], (4 * n + 4) // 5)  # every point below has at least its least size, and one that can link at least 0.8 n
            keep[s:s + 20_000] = np.minimum(bound, room[i]) >= needed(n, m)
        return keep


def pairs_fit(left: tuple, i: np.ndarray, right: tuple, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows i and j of two sets of (points, sizes, rooms, maps) can link: by place, by counts, then by maps."""
    (points, n, room, maps), (others, m, space, charts) = left, right
    need = needed(n[i], m[j])
    keep = np.minimum(room[i], space[j]) >= need
    at = np.flatnonzero(keep)
    for s in range(0, len(at), 20_000):
        x = at[s:s + 20_000]
        keep[x] = np.minimum(points[i[x]], others[j[x]]).sum(axis=1) >= need[x]
    at = np.flatnonzero(keep)
    for s in range(0, len(at), 20_000):
        x = at[s:s + 20_000]
        keep[x] = _apart(n[i[x]], m[j[x]], maps[i[x]], charts[j[x]]) >= need[x]
    return keep


def described(docs: DataFrame, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set_id, n, point, carried long columns) of all rows, and the slots of shingles that many documents hold with a level 1..15."""
    names = ["kind", "doc_id", "set_id", "n", "point", *carried]

    def batches(source):
        hasher, slots = WordHasher(), np.zeros(SLOTS, np.int64)
        for batch in source:
            ids, others, rows = batch.column(0), batch.columns[2:], []
            for s in shingle_sets(batch.column(1), hasher):
                rows.append((set_name(s), len(s), vector(s).tobytes() + bitmap(s).tobytes() if len(s) else None))
                np.add.at(slots, (s & np.uint64(SLOTS - 1)).astype(np.int64), 1)
            a, n, v = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), ids.cast(pa.int64()), pa.array(a, pa.int64()),
                                              pa.array(n, pa.int64()), pa.array(v, pa.binary()), *others], names=names)
        # shingles of one task that stand out of the mean slot by far
        mean = slots.mean()
        at = np.flatnonzero(slots > mean + 8 * np.sqrt(mean) + 4)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.nulls(len(at), pa.int64()), pa.array(at),
                                          pa.array(slots[at] - int(mean)), pa.nulls(len(at), pa.binary()),
                                          *(pa.nulls(len(at), pa.int64()) for _ in carried)], names=names)

    both = written(mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(c).cast("long") for c in carried)),
        batches, ", ".join(["kind int, doc_id long, set_id long, n long, point binary", *(f"{c} long" for c in carried)])), "sets")
    common = (both.where("kind = 1").groupBy(F.col("set_id").alias("slot")).agg(F.sum("n").alias("n"))
              .orderBy(F.desc("n"), "slot").limit(COMMON))
    return both.where("kind = 0").drop("kind"), common


def _keys(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(key, set_id, sized): the prefix shingles of all rows, once for each class and task. `sized` holds the set's size and the key's place."""
    level = np.zeros(SLOTS, np.uint64)
    for slot, n in common.collect():  # at most COMMON rows; only the order depends on them
        level[slot] = min(15, max(1, int(n).bit_length() - 2))
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def batches(source):
        hasher, level, seen = WordHasher(), shared.value, set()
        low = np.uint64(4)
        for batch in source:
            keys, names, sizes = [], [], []
            for s in shingle_sets(batch.column(0), hasher):
                name = set_name(s)
                if len(s) < 4 or name in seen:  # a set of fewer links with its equals only
                    continue
                if len(seen) > 50_000:
                    seen.clear()
                seen.add(name)
                p = prefix(len(s))
                rank = (level[(s & np.uint64(SLOTS - 1)).astype(np.int64)] << np.uint64(60)) | (s >> low)
                first = np.argpartition(rank, p - 1)[:p] if p < len(s) else np.arange(len(s))
                keys.append(s[first[np.argsort(rank[first])]])
                names.append(name)
                sizes.append(len(s))
            if keys:
                counts = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), counts)),
                                                  pa.array(np.repeat(np.array(sizes, np.int64) << 32, counts) + np.concatenate([np.arange(c) for c in counts]))],
                                                 names=["key", "set_id", "sized"])

    return mapped(docs.select(F.col("text").cast("string")), batches, "key long, set_id long, sized long")


def _inner() -> Column:
    """Whether a place can be that of the shorter set of a pair: its needed overlap with an equally large set fits behind it."""
    n, place = F.shiftright("sized", 32), F.col("sized").bitwiseAND(0xFFFFFFFF)
    return 9 * (n - place) >= 8 * n


def _met(rows: DataFrame) -> DataFrame:
    """(key, set_id, n, room) of keys that two or more classes share, one of them at an inner place, without repeats. Rows stream by in key order,
    inner ones first; one is held back."""
    def batches(source):
        held, same, lead = None, False, False  # the last row so far, whether it has met another class, whether its key has an inner row
        for batch in source:
            k, s, z = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held is not None:
                k, s, z = (np.concatenate([[h], c]) for h, c in zip(held, (k, s, z)))
            if not len(k):
                continue
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
            k, s, z = k[new], s[new], z[new]
            after = np.concatenate([k[1:] == k[:-1], [False]])
            before = np.concatenate([[same and held is not None], k[1:] == k[:-1]])
            begin = np.concatenate([[True], k[1:] != k[:-1]])
            n = z >> 32
            inner = 9 * (n - (z & 0xFFFFFFFF)) >= 8 * n
            if held is not None:
                inner[0] = lead
            leads = inner[np.maximum.accumulate(np.where(begin, np.arange(len(k)), 0))]
            keep = (after | before) & leads
            held, same, lead = (k[-1], s[-1], z[-1]), bool(before[-1]), bool(leads[-1])
            keep[-1] = False
            if keep.any():
                yield _met_batch(k[keep], s[keep], z[keep])
        if held is not None and same and lead:
            yield _met_batch(*(np.array([h], np.int64) for h in held))

    return mapped(rows.repartition("key").sortWithinPartitions("key", _inner().desc(), "set_id"), batches, "key long, set_id long, n int, room int")


def _met_batch(key, name, sized) -> pa.RecordBatch:
    n = sized >> 32
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(name), pa.array(n.astype(np.int32)), pa.array((n - (sized & 0xFFFFFFFF)).astype(np.int32))],
                                      names=["key", "set_id", "n", "room"])


def _runs(source, width: int):
    """Columns of one run of equal leading values (the first `width` columns) at a time; the frame is sorted by them.
    A run never has more rows than a block, as large buckets are dealt to blocks."""
    held = None
    for batch in source:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        if not len(columns[0]):
            continue
        changed = np.zeros(len(columns[0]) - 1, bool)
        for c in columns[:width]:
            changed |= c[1:] != c[:-1]
        edges = np.concatenate([[0], np.flatnonzero(changed) + 1])
        yield columns, edges
        held = [c[edges[-1]:] for c in columns]
    if held is not None:
        yield held, np.array([0, len(held[0])])


def _points(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count vectors and maps of a column of points."""
    both = np.frombuffer(b"".join(column), np.uint8).reshape(-1, GROUPS + BITS // 8)
    return _wide(both[:, :GROUPS]), np.ascontiguousarray(both[:, GROUPS:]).view(np.uint64)


def _counts_only(column: np.ndarray) -> np.ndarray:
    return _wide(np.frombuffer(b"".join(column), np.uint8).reshape(-1, GROUPS))


def _pairs_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _star_pairs(rows: DataFrame) -> DataFrame:
    """For each point of a bucket the first survivor of another component, over (key, block, set_id, n, room, point, component)."""
    def batches(source):
        for (key, block, name, n, room, point, component), edges in _runs(source, 2):
            n, room = n.astype(np.int64), room.astype(np.int64)
            points = _counts_only(point)
            maps = np.zeros((len(key), 1), np.uint64)  # one pair a point leaves a star pass, so counts are enough
            every = (points, n, room, maps)
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
            order = mixed(name.view(np.uint64) + (key.view(np.uint64) % np.uint64(ORDERS)) * MIX1)
            first, partner = np.full(len(key), np.iinfo(np.uint64).max), np.full(len(key), -1)
            end = np.zeros(len(key), np.int64)  # of small buckets
            for s, e in spans:
                if e - s <= LEAF:
                    end[s:e] = e
            for d in range(1, LEAF):  # all pairs of each small bucket, d places apart
                i = np.flatnonzero(np.arange(len(key)) + d < end)
                if not len(i):
                    break
                x = i[component[i] != component[i + d]]
                x = x[pairs_fit(every, x, every, x + d)]
                for one, other in ((x, x + d), (x + d, x)):
                    better = order[other] < first[one]
                    first[one[better]], partner[one[better]] = order[other[better]], other[better]
            for s, e in spans:
                if e - s <= LEAF:
                    continue
                tree = CountTree(points[s:e], n[s:e], room[s:e], maps[s:e])
                for at in range(s, e, 256):
                    upto = min(e, at + 256)
                    q, found = tree.survivors(points[at:upto], n[at:upto], room[at:upto], maps[at:upto])
                    q, found = q + at, found + s
                    apart = component[q] != component[found]
                    q, found = q[apart], found[apart]
                    best = np.lexsort((order[found], q))
                    head = best[np.unique(q[best], return_index=True)[1]]
                    partner[q[head]] = found[head]
            has = np.flatnonzero(partner >= 0)
            if len(has):
                yield _pairs_batch([name[has]], [name[partner[has]]])

    return mapped(rows.repartition("key", "block").sortWithinPartitions("key", "block"), batches, "a long, b long").distinct()


def _rest_pairs(rows: DataFrame) -> DataFrame:
    """Pass 2 over (key, block, set_id, n, room, point, component, builds): survivors across components between the points that build a
    block's tree and all points of the bucket. Rows that build come first in each run."""
    def batches(source):
        run, tree, built, a, b = None, None, [], [], []

        def search(name, n, room, points, maps, component):
            own, *_, own_component = built
            q, found = tree.survivors(points, n, room, maps)
            keep = component[q] != own_component[found]
            if keep.any():
                a.append(name[q[keep]])
                b.append(own[found[keep]])

        for batch in source:
            key, block, name, n, room, point, component, builds = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            n, room = n.astype(np.int64), room.astype(np.int64)
            points, maps = _points(point)
            changed = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (builds[1:] != builds[:-1])) + 1
            for s, e in zip([0, *changed.tolist()], [*changed.tolist(), len(key)]):
                here = (key[s], block[s])
                if run != here:
                    run, tree, built = here, None, []
                part = tuple(c[s:e] for c in (name, n, room, points, maps, component))
                if builds[s]:
                    built = part if not built else tuple(np.concatenate(x) for x in zip(built, part))
                    tree = None
                if built:
                    tree = tree or CountTree(built[3], built[1], built[2], built[4])
                    for at in range(0, e - s, 256):
                        search(*(c[at:at + 256] for c in part))
            if a:
                yield _pairs_batch(a, b)
                a, b = [], []

    return mapped(rows.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("builds")), batches, "a long, b long").distinct()


def _ends(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """(a, b, x, y): pairs with a column of both their sets. Pairs are sent to all tasks if they are few (checked), so that only what they
    need is shuffled."""
    few = pairs.limit(SENT + 1).count() <= SENT
    sent = F.broadcast if few else (lambda df: df)
    right = sets.select(F.col("set_id").alias("b"), F.col(column).alias("y")).join(sent(pairs), "b")
    left = sets.select(F.col("set_id").alias("a"), F.col(column).alias("x")).join(sent(pairs.select("a").distinct()), "a", "left_semi")
    return right.join(left, "a").select("a", "b", "x", "y")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets link."""
    def bounded(source):
        for a, b, x, y in source:
            x, y = (np.frombuffer(v, np.uint8) for v in (x, y))
            n, m = (int.from_bytes(v[-8:].tobytes(), "little") for v in (x, y))
            x, y = _wide(x[:-8]), _wide(y[:-8])
            if min(int(np.minimum(x, y).sum()), n, m) >= needed(n, m):
                yield a, b

    def rows(source):
        for a, b, x, y in source:
            x, y = _unpacked(x), _unpacked(y)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                yield a, b

    near = written(arrow_rows(_ends(pairs, sets, "fine"), "a long, b long", bounded), "near")
    return arrow_rows(_ends(near, sets, "shingles"), "a long, b long", rows)


def _packed(shingles: np.ndarray) -> bytes:
    return shingles.view(np.uint16).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    parts = np.zeros((len(data) // 6, 4), np.uint16)
    parts[:, :3] = np.frombuffer(data, np.uint16).reshape(-1, 3)
    return parts.view(np.uint64).ravel()


def _fine(shingles: np.ndarray) -> bytes:
    """Counts by the groups of the second bound, cut at 255, and the size."""
    counts = np.bincount(((shingles >> np.uint64(20)) % np.uint64(FINE)).astype(np.int64), minlength=FINE)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + len(shingles).to_bytes(8, "little")


def _sets_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(set_id, fine, shingles) of chosen classes (set_id, member), from one document each. The chosen are sent to all tasks if they
    are few (checked), else texts are joined to them by a shuffle."""
    def batches(source):
        hasher = WordHasher()
        for batch in source:
            wanted = batch.column(0).to_pylist()
            # another row may carry the same id with another text
            found = [(w, _fine(s), _packed(s)) for w, s in zip(wanted, shingle_sets(batch.column(1), hasher)) if set_name(s) == w]
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["set_id", "fine", "shingles"])

    few = chosen.limit(SENT + 1).count() <= SENT
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = held.join(F.broadcast(chosen) if few else chosen, held["doc_id"].eqNullSafe(F.col("member"))).select("set_id", "text")
    return mapped(joined, batches, "set_id long, fine binary, shingles binary")


def _dealt(rows: DataFrame, crowded: DataFrame, n_crowded: int) -> DataFrame:
    """A block number for each row, so that a bucket of many points is several runs. `crowded` (key, size) are the buckets of more than a
    block; they are sent to all tasks if they are few (checked)."""
    if not n_crowded:
        return rows.withColumn("block", F.lit(0))
    blocks = F.ceil(F.coalesce(F.col("size"), F.lit(1)) / BLOCK).cast("int")
    return (rows.join(F.broadcast(crowded) if n_crowded <= SENT else crowded, "key", "left")
            .withColumn("block", F.pmod(F.xxhash64("key", "set_id"), blocks * 2).cast("int") * (blocks > 1).cast("int")).drop("size"))


def joined(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id of each row, and the carried long columns."""
    described_rows, common = described(docs, carried)
    classes = (described_rows.where("n > 0").groupBy("set_id")
               .agg(F.min("doc_id").alias("member"), F.min("n").cast("int").alias("size"), F.min("point").alias("point")))
    met = written(_met(_keys(docs, common)), "met")
    points, members = classes.select("set_id", "point"), classes.select("set_id", "member")

    def members_of(pairs):
        return pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()

    sets = links = None

    def verified(pairs):
        """Links among pairs; sets that were not needed so far are fetched."""
        nonlocal sets, links
        wanted = members_of(pairs).join(members, "set_id")
        if sets is not None:
            wanted = wanted.join(sets.select("set_id").distinct(), "set_id", "left_anti")
        wanted = written(wanted, "unseen")
        if sets is None or not wanted.isEmpty():
            more = written(_sets_of(docs, wanted), "shingles")
            sets = more if sets is None else sets.unionByName(more)
        found = written(_verified(pairs, sets), "links")
        links = found if links is None else links.unionByName(found)

    n_rows = met.count()
    crowded = written(met.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), "crowded")
    n_crowded = crowded.count()
    rows = met.withColumn("component", F.col("set_id"))
    before = math.inf
    for _ in range(STARS):
        verified(written(_star_pairs(_dealt(rows, crowded, n_crowded).join(points.withColumn("point", F.substring("point", 1, GROUPS)), "set_id").select(
            "key", "block", "set_id", "n", "room", "point", "component")), "pairs"))
        grouped = written(components(links), "grouped")
        links = grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))  # the same classes, already as stars
        named = written(met.join(grouped, met["set_id"] == grouped["node"], "left")
                        .select("key", "set_id", "n", "room", F.coalesce("component", "set_id").alias("component")), "named")
        mixed_keys = written(named.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(
            F.sum("m").alias("size"), F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("most"))
            .where(F.col("most") < F.col("size")), "mixed")
        # pairs that buckets with a large component would still give; buckets of unrelated texts give hardly any
        left = mixed_keys.where(F.col("most") > LEAF).agg(F.sum((F.col("size") - F.col("most")).cast("double") * F.col("size"))).first()[0] or 0
        if left <= WORTH * n_rows or 2 * left > before:
            break
        before = left
        rows = named.join(mixed_keys.select("key"), "key", "left_semi")
    blocks = F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int")
    rest = (named.join(mixed_keys.withColumn("blocks", blocks), "key")
            .withColumn("own", F.when(F.col("component") != F.col("main"), F.pmod(F.xxhash64("key", "set_id"), "blocks").cast("int")))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(points, "set_id"))
    verified(written(_rest_pairs(rest.select("key", "block", "set_id", "n", "room", "point", "component", F.coalesce(F.col("own") == F.col("block"), F.lit(False)).alias("builds"))), "pairs"))
    final = components(links)
    reach = (classes.select("set_id", "member").join(final, F.col("set_id") == F.col("node"), "left")
             .withColumn("component", F.coalesce("component", "set_id")))
    least = reach.groupBy("component").agg(F.min("member").alias("component_id"))
    labels = reach.join(least, "component").select(F.col("set_id").alias("label_of"), "component_id")
    rows = described_rows.select("doc_id", *carried, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
    return (rows.join(labels, F.col("set_id") == F.col("label_of"), "left")
            .select("doc_id", *carried, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents, all columns as they are, of which one row of each linked group stays: the one with the smallest id, null
    last. Rows count by id and text together, so null and repeated ids are rows like others. Of rows equal in both one stays,
    also where the text has no words."""
    marked = docs.select(row_key().alias("doc_id"), "text", F.col("doc_id").cast("long").alias("own_id"))
    keys = written(joined(marked, ("own_id",)).groupBy("doc_id", "own_id", "component_id").agg(F.count("*").alias("n")), "row-keys")
    first = F.min(F.struct(F.col("own_id").isNull().alias("last"), "own_id", "doc_id"))["doc_id"]
    stay = keys.groupBy("component_id").agg(first.alias("stays")).select(F.col("stays").alias("doc_id"))
    gone = written(keys.join(stay, "doc_id", "left_anti").select("doc_id"), "copies")
    repeated = written(keys.where("n > 1").join(gone, "doc_id", "left_anti").select("doc_id"), "repeats")
    left = without(docs, gone.unionByName(repeated))
    if repeated.isEmpty():
        return left
    again = joined_by_key(docs, repeated, "left_semi").groupBy(row_key().alias("key")).agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return left.unionByName(again)
