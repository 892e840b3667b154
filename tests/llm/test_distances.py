"""Centroid clustering, source divergences and bit-sliced SimHash against plain versions and in odd cases."""
import hashlib
import math
import random
import re
from collections import Counter

import cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from touchline.llm import centroid_walk, simhash_slices, source_divergence
from touchline.llm.components import components

# --- centroid clustering


def plain_nearest(x, centroids):
    d = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("n,k,dims,spread", [(300, 8, 64, 400), (200, 100, 3, 6), (200, 40, 1, 5), (50, 1, 4, 100), (120, 300, 6, 50)])
def test_walk_finds_the_nearest_and_of_ties_the_smaller(n, k, dims, spread):
    rng = np.random.default_rng(n + k)
    x, c = rng.integers(-spread, spread, (n, dims)), rng.integers(-spread, spread, (k, dims))
    c[k // 2:] = c[:k - k // 2]  # every centroid twice
    number, distance = centroid_walk.Lists(c).nearest(x)
    want, best = plain_nearest(x, c)
    assert number.tolist() == want.tolist() and distance.tolist() == best.tolist()


def test_walk_leaves_far_centroids_unread(monkeypatch):
    c = np.array([[0, 0, 0]] + [[10_000 + i] * 3 for i in range(500)])
    lists, reads = centroid_walk.Lists(c), []
    monkeypatch.setattr(lists, "_gaps", lambda x, low, high, f=lists._gaps: reads.append(len(x)) or f(x, low, high))
    assert lists.nearest(np.array([[1, 2, 3]]))[0].tolist() == [0] and len(reads) == 2


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], "vec_id long, embedding array<float>, id string, cluster int")


def plain_clusters(rows, k, rounds, dims):
    keep = [(i, [math.floor(float(np.float32(x)) * 1024) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(keep, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    x, c = np.array([v for _, v in keep]), np.array([v for _, v in order[:k]])
    for _ in range(rounds):
        number, _ = plain_nearest(x, c)
        c = np.array([[int(t) // int((number == j).sum()) for t in x[number == j].sum(axis=0)] if (number == j).any() else c[j] for j in range(len(c))])
    number, distance = plain_nearest(x, c)
    total = Counter()
    for j, d in zip(number, distance):
        total[int(j)] += int(d)
    return sorted(((i if i is not None else -1), int(j), int(d), total[int(j)], sum(total.values()),
                   hashlib.sha256(",".join(str(t) for t in c[j]).encode()).hexdigest()) for (i, _), j, d in zip(keep, number, distance))


def got_clusters(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, *list(r)[1:]) for r in df.collect())


def test_clusters_equal_the_plain_version_with_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 5, 1.0) for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (100, None), (101, []), (102, [1.0] * 3), (103, [1.0, None, 1.0, 1.0]), (104, [math.nan] * 4),
             (105, [math.inf, 0.0, 0.0, 0.0]), (None, [0.25, 0.5, 0.75, 1.0]), (106, [1e-30, -1e-30, 0.0, -0.0])]
    got = got_clusters(centroid_walk.digest(vectors(spark, rows), k=6, rounds=4, dims=4))
    assert got == plain_clusters(rows, 6, 4, 4)


def test_clusters_of_few_equal_and_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    got = got_clusters(centroid_walk.digest(vectors(spark, rows), dims=2))
    assert got == plain_clusters(rows, 8, 10, 2) and {r[1] for r in got} == {0}
    none = centroid_walk.digest(vectors(spark, []), dims=2)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0


def test_components_too_large_for_a_long_are_named(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        centroid_walk.digest(vectors(spark, [(1, [1e9, 0.0])]), dims=2).collect()


# --- source divergences

def plain_audit(rows, documents=3, top=200):
    rows = [((g or ""), (s or ""), re.findall("[a-z\\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for g, s, t in rows]
    out = []
    for lang in {g for g, _, _ in rows}:
        own = [(s, w) for g, s, w in rows if g == lang]
        docs = Counter(t for _, w in own for t in set(w))
        keep = sorted(t for t in docs if docs[t] >= documents)
        n = {s: Counter() for s, _ in own}
        for s, w in own:
            n[s].update(t for t in w if docs[t] >= documents)
        all_n = sum(n.values(), Counter())

        def p(c, t):
            return 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(keep))

        for s in n:
            parts = {"pair": [(o, sum((p(n[s], t) - p(n[o], t)) ** 2 // p(n[o], t) for t in keep)) for o in n if o != s],
                     "term": [(t, (p(n[s], t) - p(all_n, t)) ** 2 // p(all_n, t)) for t in keep if n[s][t] and p(n[s], t) > p(all_n, t)]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def texts(spark, rows):
    return spark.createDataFrame([(g, s, t, "clash", 3, 4) for g, s, t in rows], "lang string, source string, text string, term string, n int, shard int")


def some_texts(seed, n=90):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "日本", "A", "a", "o'b"]
    return [(rng.choice(["en", "de", None, ""]), rng.choice(["x", "y", "z", None, "é"]), " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(n)]


@pytest.mark.parametrize("shard,top", [(100_000, 200), (9, 5)])
def test_divergences_equal_the_plain_version(spark, shard, top):
    rows = some_texts(1) + [("en", "x", None), ("xx", "only", ""), ("xx", "other", "1 2 3"), ("yy", "one", "a b c"), ("yy", "one", "a b c")]
    got = sorted(tuple(r) for r in source_divergence.audit(texts(spark, rows), top=top, shard=shard).collect())
    assert got == plain_audit(rows, top=top)


def test_divergences_count_long_texts_whole(spark):
    rows = [("en", s, f"{a} " * 70_000 + "Common " * 5) for s, a in (("x", "left"), ("y", "right"), ("x", "left"), ("x", "left"), ("y", "right"), ("y", "right"))]
    got = sorted(tuple(r) for r in source_divergence.audit(texts(spark, rows * 2)).collect())
    assert got == plain_audit(rows * 2) and any(r[3] == "left" for r in got)


def test_partial_counts_of_small_slices(spark):
    """Slices of a batch and early hand-ons count like one pass; texts with characters of several bytes."""
    rows = [(g, s, t * 3) for g, s, t in some_texts(2, 300)] + [("en", "x", "É日本 " * 500)]
    got = {(r.lang, r.source, r.term): (r.n, r.docs) for r in source_divergence.counts(texts(spark, rows).coalesce(1), 500, 20).collect()}
    n, docs = Counter(), Counter()
    for g, s, t in rows:
        w = re.findall("[a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        n.update((g or "", s or "", x) for x in w)
        docs.update((g or "", s or "", x) for x in set(w))
        n[(g or "", s or "", None)] = docs[(g or "", s or "", None)] = 0
    assert got == {k: (n[k], docs[k]) for k in n}


def test_divergences_of_nothing(spark):
    got = source_divergence.audit(texts(spark, []))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0


def test_scaled_share_is_exact_for_large_counts():
    for c, total, v in ((10 ** 12, 9 * 10 ** 14, 10 ** 7), (0, 8 * 10 ** 15, 5), (3, 7, 2), (0, 0, 1)):
        assert int(source_divergence.scaled_share(c, total, v)) == 1 + 10 ** 9 * (c + 1) // (total + v)


# --- SimHash

def plain_fingerprint(t):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(values):
    label, changed = list(range(len(values))), True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(i):
                if label[i] != label[j] and bin(values[i] ^ values[j]).count("1") <= 3:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def close_values(seed, centres=6, each=25):
    rng = random.Random(seed)
    out = [0, 1, 7, 15, (1 << 64) - 1, (1 << 64) - 8]
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            v = c
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            out.append(v)
    return sorted(set(out), key=lambda v: rng.random())


def test_fingerprints_are_those_of_the_engine_hash(spark):
    texts = [*cases.ODD, "A b\u000bC d", "É É é É", "one two", "x y z w"]
    got = {r.id: r.fingerprint & (1 << 64) - 1 for r in simhash_slices.fingerprints(cases.documents(spark, texts)).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    one = spark.range(1).select(F.xxhash64(F.lit("one two"))).first()[0] & (1 << 64) - 1
    assert plain_fingerprint("one two") == one


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(3)
    t = " ".join(rng.choice(["aa", "b", "CCCC", "é"]) + str(rng.randrange(50)) for _ in range(2000))
    for piece in (1, 7, 64, 5000):
        monkeypatch.setattr(simhash_slices, "PIECE", piece)
        assert simhash_slices.fingerprint(t.encode()) == plain_fingerprint(t)
    assert simhash_slices.fingerprint(b"x" * 100_000) == plain_fingerprint("x" * 100_000)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_sliced_comparison_finds_all_and_only_close_pairs(radius):
    values = close_values(radius)
    q = np.repeat(np.arange(len(values)), -(-len(values) // 64))
    w = np.tile(np.arange(-(-len(values) // 64)), len(values))
    a = np.array(values, np.uint64)
    x, y = simhash_slices.close(simhash_slices.planes(a), a, q, w, np.full(len(q), simhash_slices.FULL), radius)
    got = {(i, j) for i, j in zip(x.tolist(), y.tolist()) if j < len(values)}
    assert got == {(i, j) for i in range(len(values)) for j in range(len(values)) if bin(values[i] ^ values[j]).count("1") <= radius}


def test_classes_of_many_buckets_stay_apart(monkeypatch):
    monkeypatch.setattr(simhash_slices, "PAIRS", 11)
    groups = [close_values(s, 2, n) for s, n in ((1, 40), (2, 0), (3, 70), (4, 1))]
    values, first, want = [], [], []
    for g in groups:
        first.append(len(values))
        want += [len(values) + k for k in plain_classes(g)]
        values += g
    assert simhash_slices.classes(np.array(values, np.uint64), np.array(first)).tolist() == want


@pytest.mark.parametrize("bucket", [1024, 3])
def test_buckets_lose_no_link(spark, bucket):
    """With 3 nodes to a bucket most are cut again, up to the last level."""
    values = close_values(9, 8, 30)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, (False, i)) for i, v in enumerate(values)], "fingerprint long, node struct<none boolean, id long>")
    got = {r.node.id: r.component.id for r in components(simhash_slices.linked(simhash_slices.bucketed(nodes, bucket))).collect()}
    assert [got.get(i, i) for i in range(len(values))] == plain_classes(values)


def test_near_duplicates_with_odd_rows(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = [*cases.ODD, " ".join(base), " ".join(base).upper().replace("W", "w"), " ".join([*base[:200], "new", *base[201:]]), " ".join(base), "  "]
    df = cases.documents(spark, texts)
    df = df.unionByName(df.limit(3))  # repeated rows
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_slices.digest(df).collect()}
    values = [plain_fingerprint(t) for t in texts]
    assert got == {i: (f"{v:016x}", c) for (i, v), c in zip(enumerate(values), plain_classes(values))} and simhash_slices.digest(df).count() == df.count()
    assert simhash_slices.digest(df.limit(0)).count() == 0
    alone = simhash_slices.digest(cases.with_null_id(df)).where("doc_id is null").collect()
    assert len(alone) == 1 and alone[0].component_id is None
