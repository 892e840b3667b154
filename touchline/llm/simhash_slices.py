"""SimHash near-duplicates by bit-sliced comparison.

A text's words between ASCII white space, A-Z lower-cased, give shingles of three; a bit of the fingerprint is 1 if over half the 64-bit
hashes of the shingles have it. Fingerprints at `RADIUS` or fewer differing bits are linked.

Equal fingerprints are one node. Four bands of 16 bits give each node four buckets: two nodes that differ in three bits agree on one
band. A bucket of more than `BUCKET` nodes is cut again by the four quarters of the bits that it leaves free, by the same argument, up
to `LEVELS` times; then 49 bits are fixed and 2^15 distinct nodes are the most a bucket can hold, so no bucket needs a cap. Inside
buckets the nodes stand as vertical bit planes, 64 nodes to a machine word. For a node and a word of others, three planes at a time go
through a carry-save adder into counters that overflow beyond the radius; a word whose 64 lanes have all overflowed is abandoned. Links of
a bucket are joined in the task and leave it as one link per node at most; components of all buckets' links give the classes.

A null or empty text, or one without words, has fingerprint zero and is linked like any other; fewer than three words are one shingle.
Repeated rows get a row each. Rows of a null id take part in links; a class of null ids only has a null component. An empty table gives an empty result.
Very long texts are hashed in pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_rows, mapped, written
from touchline.llm.components import components

SHINGLE, SEED = 3, 42
RADIUS = 3
BUCKET = 1024
LEVELS = 5
PIECE = 1 << 20       # bytes of a text that are hashed at a time
PAIRS = 1 << 15       # pairs of a node and a word of 64 others that are compared at a time
ROWS = 1 << 16        # rows of whole buckets that are compared together
SENT = 200_000        # most keys of large buckets that are sent to all tasks
SPACE = re.compile(rb"[\x20\x09-\x0D]")
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints

def _pieces(raw: bytes):
    """Lists of words of consecutive pieces of a text; pieces end at white space."""
    at = 0
    while at < len(raw):
        upto = at + PIECE
        if upto < len(raw):
            found = SPACE.search(raw, upto)
            upto = found.start() if found else len(raw)
        yield raw[at:upto].lower().split()  # of bytes: A-Z only, ASCII white space only
        at = upto


def fingerprint(raw: bytes) -> int:
    """64 bits of a text in UTF-8."""
    ones, n, last = np.zeros(64, np.int64), 0, []
    for words in _pieces(raw):
        words = last + words
        if len(words) >= SHINGLE:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            hashes = [xxhash.xxh64_intdigest(line[b:e], SEED) for b, e in zip(begins[:1 - SHINGLE].tolist(), ends[SHINGLE - 1:].tolist())]
            ones += _bits(np.array(hashes, np.uint64)).sum(axis=0, dtype=np.int64)
            n += len(hashes)
        last = words[1 - SHINGLE:]
    if not n and last:
        ones += _bits(np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], np.uint64))[0]
        n = 1
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def _bits(values: np.ndarray) -> np.ndarray:
    """One row of 64 bits for each value, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) of every row, the 64 bits as a signed long."""
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def batches(source):
        for batch in source:
            raw = batch.column(1).cast(pa.large_binary())
            found = np.array([fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in raw], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fingerprint"])

    return mapped(rows, batches, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint long")


# --- buckets

def _masks(levels: int) -> list[list[int]]:
    """For each level the masks of fixed bits; those of children of mask i are 4i to 4i+3."""
    out, now = [], [0]
    for _ in range(levels):
        parts = []
        for mask in now:
            free = [b for b in range(64) if not mask >> b & 1]
            cuts = [round(i * len(free) / (RADIUS + 1)) for i in range(RADIUS + 2)]
            parts += [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]
        out.append(now := parts)
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _cut(rows: DataFrame, level: int, masks: list[int]) -> DataFrame:
    """Each row once for each child of its bucket: path (the mask's number) and the fixed bits."""
    table = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    parts = RADIUS + 1
    children = F.transform(F.array(*[F.lit(i) for i in range(parts)]), lambda i: F.col("path") * parts + i)
    return (rows.withColumn("path", F.explode(children))
            .withColumn("value", F.col("fingerprint").bitwiseAND(F.element_at(table, F.col("path") + 1))).withColumn("level", F.lit(level)))


def bucketed(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """nodes (fingerprint, ...) with level, path and value; every pair within the radius shares a bucket."""
    rows, done = nodes.withColumn("path", F.lit(0)), None
    key = ["path", "value"]
    for level, masks in enumerate(_masks(LEVELS)):
        rows = _cut(rows, level, masks)
        if level < LEVELS - 1:
            large = written(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > bucket).select(*key), "large-buckets")
            sent = bounded_rows(large, SENT)
        if level == LEVELS - 1 or sent == []:
            return rows if done is None else done.unionByName(rows)
        large = F.broadcast(large) if sent else large
        small = rows.join(large, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = rows.join(large, key, "left_semi")
    return done


# --- comparison

def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 values to a word."""
    bits = np.zeros((64, -(-len(values) // 64) * 64), np.uint8)
    bits[:, :len(values)] = _bits(values).T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _add(counters: list[np.ndarray], over: np.ndarray, carry: np.ndarray, at: int) -> None:
    """Add a plane of weight 2^at to the counters of all lanes; what passes the last one overflows."""
    for k in range(at, len(counters)):
        counters[k], carry = counters[k] ^ carry, counters[k] & carry
    over |= carry


def close(slices: np.ndarray, values: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int = RADIUS):
    """Pairs (query, place) within the radius: queries against the lanes given of the words given."""
    width = max(2, radius.bit_length())
    spare = (1 << width) - 1 - radius  # counters start there, so that they overflow just beyond the radius
    counters = [np.full(len(query), FULL if spare >> k & 1 else 0, np.uint64) for k in range(width)]
    over = ~lanes
    bits = _bits(values)

    def differing(b):
        return slices[b][word] ^ (bits[query, b].astype(np.uint64) * FULL)

    for b in range(0, 63, 3):
        x, y, z = (differing(b + i) for i in range(3))
        half = x ^ y
        _add(counters, over, half ^ z, 0)
        _add(counters, over, (x & y) | (z & half), 1)
        if b % 6 == 3:
            go = np.flatnonzero(over != FULL)
            if len(go) < 0.8 * len(over):
                query, word, over, counters = query[go], word[go], over[go], [c[go] for c in counters]
    _add(counters, over, differing(63), 0)
    row, lane = np.nonzero(_bits(~over))
    return query[row], word[row] * 64 + lane


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; a label is the least place of its class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def classes(values: np.ndarray, first: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For values in buckets that begin at `first`: the least place of each one's class inside its bucket."""
    n = len(values)
    label = np.arange(n)
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    query = np.flatnonzero(end - label > 1)
    low, count = (query + 1) // 64, (end[query] - 1) // 64 - (query + 1) // 64 + 1
    slices, upto = planes(values), np.cumsum(count)
    for at in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
        number = np.arange(at, min(at + PAIRS, int(upto[-1])))
        k = np.searchsorted(upto, number, side="right")
        q, word = query[k], low[k] + number - (upto[k] - count[k])
        begin = np.clip(q + 1 - word * 64, 0, 64).astype(np.uint64)
        stop = np.clip(end[q] - word * 64, 0, 64).astype(np.uint64)
        _merge(label, *close(slices, values, q, word, _below(stop) & ~_below(begin), radius))
    return label


def _below(lane: np.ndarray) -> np.ndarray:
    """Words whose lanes under `lane` (0 to 64) are 1."""
    return np.where(lane >= 64, FULL, (np.uint64(1) << (lane & np.uint64(63))) - np.uint64(1))


def linked(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between nodes of `rows` (level, path, value, fingerprint, node), each bucket's classes as stars."""
    dealt = (rows.select("level", "path", "value", "fingerprint", F.col("node.none").alias("none"), F.col("node.id").alias("id"))
             .repartition("level", "path", "value").sortWithinPartitions("level", "path", "value", "fingerprint"))

    def batches(source):
        held, size = [], 0
        for batch in source:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                keep = int(_first(table)[-1])
                if keep:
                    yield from _links(table.slice(0, keep), radius)
                held, size = table.slice(keep).to_batches(), table.num_rows - keep
        if held:
            yield from _links(pa.Table.from_batches(held).combine_chunks(), radius)

    found = mapped(dealt, batches, f"none boolean, id {dict(rows.select('node.id').dtypes)['id']}, none_b boolean, id_b {dict(rows.select('node.id').dtypes)['id']}")
    return found.select(F.struct("none", "id").alias("a"), F.struct(F.col("none_b").alias("none"), F.col("id_b").alias("id")).alias("b"))


def _first(table: pa.Table) -> np.ndarray:
    """Places where a bucket begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in ("level", "path", "value"):
        v = table.column(name).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _links(table: pa.Table, radius: int):
    if table.num_rows:
        label = classes(table.column("fingerprint").to_numpy().astype(np.int64).view(np.uint64), _first(table), radius)
        tied = np.flatnonzero(label != np.arange(len(label)))
        if len(tied):
            a, b = table.select(["none", "id"]).take(tied), table.select(["none", "id"]).take(label[tied])
            yield from pa.Table.from_arrays([*a.columns, *b.columns], names=["none", "id", "none_b", "id_b"]).to_batches()


def classified(df: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component) of every row: component is the smallest id that links reach."""
    if radius > RADIUS:
        raise ValueError(f"buckets hold pairs of {RADIUS} or fewer differing bits")
    docs = written(fingerprints(df, id, text), "fingerprints")
    kind = docs.schema["id"].dataType
    nodes = written(docs.groupBy("fingerprint").agg(F.min("id").alias("id")).select(
        "fingerprint", F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.col("fingerprint").cast(kind)).alias("id")).alias("node")), "nodes")
    least = components(linked(bucketed(nodes), radius))
    named = nodes.join(least, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component"))
    return docs.join(named, "fingerprint").select("id", "fingerprint", F.when(~F.col("component.none"), F.col("component.id")).alias("component"))


def digest(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 lowercase hex digits, component_id."""
    return classified(df).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                                 F.col("component").alias("component_id"))
