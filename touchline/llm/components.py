"""Connected components of a link table: links contracted in tasks, then alternating large and small stars over DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import mapped, written

CHUNK = 1 << 14  # links that a task contracts at a time


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some links, and the least node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if np.array_equal(low, high):
            return nodes, nodes[label]
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def _contracted(links: DataFrame, roots: bool = False) -> DataFrame:
    """Links (a, b) of the same components: in each task, each node of a chunk of links to the least it reaches there, also
    the least ones to themselves if `roots`."""
    def chunk(held):
        a, b = _least(*(np.concatenate(c) for c in zip(*held)))
        keep = a >= b if roots else a > b
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    def batches(source):
        held, size = [], 0
        for batch in source:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                size += batch.num_rows
            if size >= CHUNK:
                yield chunk(held)
                held, size = [], 0
        if held:
            yield chunk(held)

    return mapped(links, batches, "a long, b long")


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b. Large star: each node ties its larger neighbours to its least one; small star:
    its smaller ones. A node's neighbours never meet in one row: the least comes from an aggregate, then a join."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another: component is the least node it can reach. Null ends and
    links of a node to itself are left out. Links of long ids are first contracted in tasks; if what is left fits one chunk (checked),
    it is contracted once more and done. Else, and for nodes of other types, rounds of stars follow, each written to the shared folder,
    so lineage stays short; rounds grow with the logarithm of the longest path."""
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") > F.col("b"))
    if all(f.dataType == T.LongType() for f in links.schema):
        links = written(_contracted(links), "links")
        if links.count() < CHUNK:
            found = written(_contracted(links.coalesce(1), roots=True), "links")
            return found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    else:
        links = written(links.distinct(), "links")
    mark = None
    while True:
        links = written(_stars(_stars(links, True), False).distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now
