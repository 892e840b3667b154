"""Divergence of sources inside each language, counted by Arrow kernels.

Tasks lower A-Z (`ascii_lower`), split texts (`split_pattern_regex`), encode the terms (`dictionary_encode`) and count them by hash
`group_by`; what leaves a task are partial counts by language, source and term. Spark adds them up, keeps the terms that stand in enough
documents of their language, a row each with its counts by source, and deals each language's terms to shards of about `SHARD` counts.
A shard is columnar again: runs of counts for each source, from which the shard's share of every divergence follows, and its candidates for the leading terms. Shares are
added and ranked by Spark.

With p and q scaled to whole numbers by `SCALE`, the divergence of p from q adds floor((p-q)^2 / q) over terms. A source pair costs its counts
above zero and the distinct counts of the other source, not the vocabulary: terms that a source lacks all have one p. Scaled shares are
taken in three steps of 1000, so no product passes a long below 9*10^15 counts.

Null text, language or source is read as ''. Groups without any term and languages without kept terms are there, with sums of 0; of
equal values the item first in UTF-8 order leads. Repeated rows are documents of their own; an empty table gives an empty result. Long texts
are counted in slices; a slice holds at least one whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import mapped, written

GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
DOCUMENTS = 3          # of a language that a kept term stands in
TOP = 200
STEP, STEPS = 1000, 3  # SCALE is STEP ** STEPS
SCALE = STEP ** STEPS
SHARD = 100_000        # counts of a shard
SLICE = 4_000_000      # bytes of text split at a time
HELD = 500_000         # partial counts that a task holds before it hands them on

KEY = ["lang", "source", "term"]


# --- counting

def _slices(batches, most: int):
    """The rows of Arrow batches in pieces of about `most` bytes of text, one row at least. Pieces are copies: `ascii_lower` reads wrong
    bytes where an array's values do not begin at its buffer's start."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
        at, before = 0, 0
        while at < len(ends):
            upto = max(at + 1, int(np.searchsorted(ends, before + most - size, side="right")))
            held.append(batch.take(pa.array(np.arange(at, upto))))
            size += int(ends[upto - 1]) - before
            before, at = int(ends[upto - 1]), upto
            if size >= most or at < len(ends):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n (occurrences), docs (rows that have the term); a row's group stands once with a null term."""
    lang, source, text = (pc.fill_null(c.cast(pa.large_string()), "") for c in batch.columns)
    words = pc.split_pattern_regex(pc.ascii_lower(text), GAP)
    row, term = pc.list_parent_indices(words), pc.list_flatten(words)
    some = pc.not_equal(term, "")
    row, term, lang, source = row.filter(some), term.filter(some).dictionary_encode(), lang.dictionary_encode(), source.dictionary_encode()
    pairs = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    codes = pa.table({"lang": lang.indices.take(pairs["row"].combine_chunks()), "source": source.indices.take(pairs["row"].combine_chunks()),
                      "term": pairs["term"], "n": pairs["count_all"]}).group_by(KEY, use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    groups = pa.table({"lang": lang.indices, "source": source.indices}).group_by(KEY[:2], use_threads=False).aggregate([])
    none, zero = pa.nulls(groups.num_rows, pa.int32()), pa.array(np.zeros(groups.num_rows, np.int64))
    codes = pa.concat_tables([codes, pa.table({"lang": groups["lang"], "source": groups["source"], "term": none, "n_sum": zero, "count_all": zero})])
    return pa.table({k: c.dictionary.take(codes[k].combine_chunks()) for k, c in zip(KEY, (lang, source, term))} | {"n": codes["n_sum"], "docs": codes["count_all"]})


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Counts of several pieces added up, by the dictionary codes of their keys."""
    if len(tables) == 1:
        return tables[0]
    table = pa.concat_tables(tables)
    keys = {k: table[k].combine_chunks().dictionary_encode() for k in KEY}
    out = pa.table({k: c.indices for k, c in keys.items()} | {k: table[k] for k in ("n", "docs")}).group_by(KEY, use_threads=False).aggregate(
        [("n", "sum"), ("docs", "sum")])
    return pa.table({k: c.dictionary.take(out[k].combine_chunks()) for k, c in keys.items()} | {"n": out["n_sum"], "docs": out["docs_sum"]})


def counts(df: DataFrame, size_of_slice: int = SLICE, most_held: int = HELD) -> DataFrame:
    """Counts by lang, source and term over all rows."""
    schema = pa.schema([(k, pa.string()) for k in KEY] + [("n", pa.int64()), ("docs", pa.int64())])

    def partial(batches):
        held, size = [], 0
        for part in _slices(batches, size_of_slice):
            held.append(_counted(part))
            size += held[-1].num_rows
            if size > most_held:
                held = [_merged(held)]
                size = held[0].num_rows
                if size > most_held // 2:
                    yield from held[0].cast(schema).to_batches(20_000)
                    held, size = [], 0
        if held:
            yield from _merged(held).cast(schema).to_batches(20_000)

    rows = mapped(df.select("lang", "source", "text"), partial, "lang string, source string, term string, n long, docs long")
    return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- shards

def scaled_share(count, total, terms: int):
    """1 + floor(SCALE * (count + 1) / (total + terms)), by long division in base STEP; arrays or numbers."""
    rest, out = np.asarray(count, np.int64) + 1, np.int64(0)
    whole = np.asarray(total, np.int64) + terms
    for _ in range(STEPS):
        digit, rest = np.divmod(rest * STEP, whole)
        out = out * STEP + digit
    return out + 1


def _distance(p, q):
    return (p - q) ** 2 // q


def _shard(rows: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Shares of all pairs and leading terms of one shard. rows: term, lang_n and the term's counts by source; groups: every source of the
    language with its total, and the language's terms and total."""
    groups = groups.sort_by("source")
    names, total = groups["source"].combine_chunks(), groups["total"].to_numpy()
    v, lang_total = groups["terms"][0].as_py(), groups["lang_total"][0].as_py()
    out = {"source": [], "part": [], "item": [], "value": []}
    if rows.num_rows:
        counted, terms = rows["counts"].combine_chunks(), rows["term"].to_pylist()
        t, cells = pc.list_parent_indices(counted).to_numpy(), pc.list_flatten(counted)
        s, n = pc.index_in(cells.field("source"), names).to_numpy(), cells.field("n").to_numpy()
        by = np.argsort(s, kind="stable")
        s, t, n = s[by], t[by], n[by]
        p, p0 = scaled_share(n, total[s], v), scaled_share(np.zeros_like(total), total, v)
        first = np.flatnonzero(np.diff(s, prepend=-1))
        bounds = np.searchsorted(s, np.arange(len(names) + 1))
        q = scaled_share(rows["lang_n"].to_numpy(), lang_total, v)[t]
        value = _distance(p, q)
        for g in range(len(names)):
            at = np.arange(bounds[g], bounds[g + 1])
            at = at[p[at] > q[at]]
            if len(at) > top:
                at = at[value[at] >= np.partition(value[at], len(at) - top)[len(at) - top]]
            lead = sorted(at.tolist(), key=lambda i: (-int(value[i]), terms[t[i]].encode()))[:top]
            out["source"] += [names[g].as_py()] * len(lead)
            out["part"] += ["term"] * len(lead)
            out["item"] += [terms[t[i]] for i in lead]
            out["value"] += [int(value[i]) for i in lead]
    for g in range(len(names)):
        if rows.num_rows:
            other = np.full(len(terms), p0[g])
            other[t[bounds[g]:bounds[g + 1]]] = p[bounds[g]:bounds[g + 1]]
            levels, times = np.unique(other, return_counts=True)
            sums = np.zeros(len(names), np.int64)
            for at in range(0, len(levels), 256):  # as if no source had any term here
                sums += (_distance(p0[:, None], levels[None, at:at + 256]) * times[None, at:at + 256]).sum(axis=1)
            sums[s[first]] += np.add.reduceat(_distance(p, other[t]) - _distance(p0[s], other[t]), first)
        else:
            sums = np.zeros(len(names), np.int64)
        rest = [i for i in range(len(names)) if i != g]
        out["source"] += [names[i].as_py() for i in rest]
        out["part"] += ["pair"] * len(rest)
        out["item"] += [names[g].as_py()] * len(rest)
        out["value"] += sums[rest].tolist()
    lang = groups["lang"][0].as_py()
    return pa.table({"lang": pa.array([lang] * len(out["value"]), pa.string()), **{k: pa.array(x, pa.string()) for k, x in out.items() if k != "value"},
                     "value": pa.array(out["value"], pa.int64())})


def audit(df: DataFrame, documents: int = DOCUMENTS, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """lang, source, part, item, value, rank: divergences from every other source of the language (`pair`), and the terms that the
    source has more of than its language (`term`, the first `top`)."""
    found = written(counts(df), "term-counts")
    terms = found.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = written(terms.where(F.col("docs") >= documents).drop("docs"), "kept-terms")
    langs = written(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"),
                                             F.ceil(F.sum(F.size("counts")) / shard).cast("int").alias("shards")), "languages")
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    groups = (found.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total")],
                      F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1)).alias("shard")))
    rows = kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.hash("term"), "shards")).drop("shards")

    def merge(left, right):
        return _shard(left, right, top)

    parts = rows.groupBy("lang", "shard").cogroup(groups.groupBy("lang", "shard")).applyInArrow(
        merge, "lang string, source string, part string, item string, value long")
    parts = written(parts, "divergence-shards")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    leading = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(leading).select("lang", "source", "part", "item", "value", "rank")
