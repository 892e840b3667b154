"""Jaccard join, quality rules, quotation linking, archives, licences, pipeline: against SQL or plain versions."""
import math
import os
import random
import re

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import components, count_tree_join, license_diagonals, quote_linking, risk_rules, shingles, warc_archive
from touchline.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, sf, name):
    columns, want = cases.oracle(sf, ORACLE[name])
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(tuple(map(norm, r)) for r in got) == sorted(tuple(map(norm, r)) for r in want)


# --- Jaccard join

def plain_join(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    least = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                common = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * common >= 80 * len(sets[i] | sets[j]) and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    return [(len(s), c) for s, c in zip(sets, least)]


def near_copies(seed):
    rng = random.Random(seed)
    texts = []
    for size, copies, edits in ((60, 40, 2), (30, 25, 1), (12, 6, 1), (200, 12, 4), (5, 3, 0), (4, 3, 1), (3, 2, 0)):
        base = [f"w{rng.randrange(9000)}" for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(size)] = f"e{rng.randrange(9000)}"
            texts.append(" ".join(own))
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"u{i}_{k}" for k in range(rng.randrange(5, 90))) for i in range(30)]
    rng.shuffle(texts)
    return texts + cases.ODD


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, seed):
    texts = near_copies(seed)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in count_tree_join.joined(cases.documents(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == plain_join(texts)


def test_join_with_small_blocks_and_one_of_each(spark, monkeypatch):
    texts = near_copies(3)
    monkeypatch.setattr(count_tree_join, "BLOCK", 8)
    want = plain_join(texts)
    rows = {r.doc_id: r.component_id for r in count_tree_join.joined(cases.documents(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [c for _, c in want]
    docs = cases.with_null_id(cases.documents(spark, texts))
    kept = count_tree_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, *(i for i, (_, c) in enumerate(want) if c == i)}
    assert count_tree_join.joined(docs.limit(0)).count() == 0


def test_tree_keeps_all_pairs_that_can_link():
    rng = np.random.default_rng(1)
    base = rng.poisson(2.5, (40, count_tree_join.GROUPS))
    points = np.repeat(base, 6, axis=0) + rng.integers(0, 2, (240, count_tree_join.GROUPS)) * (rng.random((240, 1)) < 0.5)
    sizes = points.sum(axis=1)
    none = np.zeros((240, 1), np.uint64)
    tree = count_tree_join.CountTree(points.astype(np.int32), sizes, sizes, none)
    got = set(zip(*(x.tolist() for x in tree.survivors(points.astype(np.int32), sizes, sizes, none))))
    want = {(i, j) for i in range(240) for j in range(240) if min(np.minimum(points[i], points[j]).sum(), sizes[i], sizes[j]) >= count_tree_join.needed(sizes[i], sizes[j])}
    assert got == want


def test_word_hashes_are_those_of_the_words():
    texts = ["", None, "One two  THREE\tone", "É é é x\x00y", "a" * 50, "b c"] * 3
    hasher = shingles.WordHasher()
    found = [x.tolist() for x in hasher.texts(pa.array(texts))]
    names = {}
    for t, h in zip(texts, found):
        words = WORD.findall((t or "").translate(LOWER))
        assert len(words) == len(h)
        for w, x in zip(words, h):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    long = " ".join(f"w{i}" for i in range(900_000))
    assert np.array_equal(next(iter(hasher.texts(pa.array([long])))), np.concatenate(list(hasher.texts(pa.array(long.split(" "))))))


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_small_link_tables_need_no_rounds_and_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, None), (9, 9)]
    least = {}
    for a, b in links:
        if b is not None and a != b:
            x, y = least.get(a, a), least.get(b, b)
            least |= {n: min(x, y) for n in (a, b, *(k for k, v in least.items() if v in (x, y)))}
    stars, rounds = components._stars, []
    monkeypatch.setattr(components, "_stars", lambda links, large: rounds.append(large) or stars(links, large))
    table = spark.createDataFrame(links, "a long, b long").repartition(5)
    for chunk in (components.CHUNK, 16):
        monkeypatch.setattr(components, "CHUNK", chunk)
        rows = components.components(table).collect()
        assert len(rows) == len(least) and {r.node: r.component for r in rows} == least
        assert bool(rounds) == (chunk == 16)
    nodes = table.select(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(False).alias("none"), F.col(c).alias("id"))).alias(c) for c in ("a", "b")))
    assert {r.node.id: r.component.id for r in components.components(nodes).collect()} == least


def test_star_passes_end_when_they_no_longer_help(spark, monkeypatch):
    """Copies of one text and a loose family of it that links with nothing share buckets that no star pass can settle."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(260)]
    texts = []
    for edits in [1] * 40 + [9] * 40:
        own = list(base)
        for at in rng.sample(range(260), edits):
            own[at] = f"e{rng.randrange(90000)}"
        texts.append(" ".join(own))
    written, passes = count_tree_join.written, []
    monkeypatch.setattr(count_tree_join, "written", lambda df, name: passes.append(name) or written(df, name))
    monkeypatch.setattr(count_tree_join, "WORTH", 0)
    rows = {r.doc_id: r.component_id for r in count_tree_join.joined(cases.documents(spark, texts)).collect()}
    assert [rows[i] for i in range(80)] == [c for _, c in plain_join(texts)]
    assert passes.count("pairs") == 3  # two star passes, the second without effect, and the last pass


@pytest.mark.parametrize("seed", range(3))
def test_bounds_keep_every_pair_that_links(seed):
    """Place, counts and map of random sets around the limit, at their first shared shingle in a common order."""
    rng = np.random.default_rng(seed)
    for _ in range(300):
        n = int(rng.integers(4, 400))
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        drop = int(rng.integers(0, max(2, n // 4)))
        x, y = np.sort(base[:n]), np.sort(np.concatenate([base[drop:n], base[n:n + int(rng.integers(0, max(2, n // 5)))]]))
        common = np.intersect1d(x, y)
        if not len(y) or 100 * len(common) < 80 * (len(x) + len(y) - len(common)):
            continue
        i, j = np.searchsorted(x, common[0]), np.searchsorted(y, common[0])
        assert i < count_tree_join.prefix(len(x)) and j < count_tree_join.prefix(len(y))
        rows = [(count_tree_join._wide(count_tree_join.vector(v)[None]), np.array([len(v)]), np.array([len(v) - k]),
                 count_tree_join.bitmap(v)[None].view(np.uint64)) for v, k in ((x, i), (y, j))]
        zero = np.array([0])
        assert count_tree_join.pairs_fit(rows[0], zero, rows[1], zero).all()
        assert any(9 * (len(v) - k) >= 8 * len(v) for v, k in ((x, i), (y, j)))  # one of them is at an inner place


def test_pairs_of_a_loose_family_grow_with_it(spark, monkeypatch):
    """Texts that share seven tenths with each other link with none: what the passes write must not grow with the square of the family."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(9000)}" for _ in range(260)]

    def family(size):
        out = []
        for _ in range(size):
            own = list(base)
            for at in rng.sample(range(260), 9):
                own[at] = f"e{rng.randrange(90000)}"
            out.append(" ".join(own))
        return out

    written, made = count_tree_join.written, []

    def counted(df, name):
        out = written(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(count_tree_join, "written", counted)
    totals = []
    for size in (100, 500):
        made.clear()
        texts = family(size)
        rows = {r.doc_id: r.component_id for r in count_tree_join.joined(cases.documents(spark, texts)).collect()}
        if size == 100:
            assert [rows[i] for i in range(size)] == [c for _, c in plain_join(texts)]
        totals.append(sum(made))
    assert totals[1] <= 10 * max(totals[0], 50), totals


# --- quality rules

def test_exact_binomial_and_cutoffs(spark):
    tail = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    rows = spark.createDataFrame([(k, n) for n in (50, 400, 3000) for k in (0, 1, 3, 7)], "k long, n long")
    for r in rows.withColumn("p", risk_rules.binomial_tail(F.col("k"), F.col("n"), 0.01)).collect():
        assert r.p == 1.0 if r.k >= r.n * 0.01 else abs(r.p - tail(r.k, r.n, 0.01)) < 1e-9
    clean, junk = "plain words of a quiet text that goes on without any marks for a while and ends there at last good", "#w " * 25
    texts = [f"{clean} number{i}" for i in range(1500)] + [junk + " ".join(f"*{i}x{k}" for k in range(20)) for i in range(3)] + cases.ODD
    docs = cases.documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1400)] + [(None, 1, 0), (1, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in risk_rules.judged(docs, labels).collect()}
    assert all(rows[i].kept for i in range(1500)) and not any(rows[i].kept for i in range(1500, 1503)) and "symbols_per_word" in rows[1501].rejected_by
    few = {r.doc_id: r.kept for r in risk_rules.judged(docs, labels.limit(100)).collect()}
    assert few[1501] == (not rows[1501].base_failed)  # too few labels: no cutoff passes
    assert rows[1503].n_words == 0 and rows[1503].base_failed and risk_rules.judged(docs.limit(0), labels).count() == 0


# --- quotation linking

def test_quotes_link_messages_and_leave_the_text(spark):
    talk = [(1, 0, "user", "Where is   the map?\nI lost it."), (1, 1, "assistant", "> where is the map?\nOn the table."), (1, 2, "user", "Thanks a lot."),
            (1, 3, "user", ">> Where is the map?\n> On the table.\nWhich table?"), (1, 4, "assistant", "> Thanks a lot.\n>\n> nobody said this\nAny time <|end|>"),
            (2, 0, "user", "> Where is the map?\nnot here"), (2, 1, None, None), (None, 5, "user", "> Thanks a lot."), (2, None, "user", "hi"), (1, 2, "user", "Thanks a lot.")]
    rows = quote_linking.formatted(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))).collect()
    assert len(rows) == len(talk)
    by = {(r.conv_id, r.turn): r for r in rows}
    assert {k: (r.reply_to, r.thread) for k, r in by.items() if k[0] == 1} == {(1, 0): (None, 0), (1, 1): (0, 0), (1, 2): (None, 2), (1, 3): (1, 0), (1, 4): (2, 2)}
    assert [r.turn for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.place)] == [0, 1, 3, 2, 2, 4]
    assert by[1, 3].quote_level == 2 and by[1, 3].n_quotes == 2 and by[1, 3].chat == "<|user|>\nWhich table?\n<|end|>\n"
    assert by[1, 4].chat == "<|assistant|>\nAny time < |end|>\n<|end|>\n" and by[2, 1].chat == "<|unknown|>\n\n<|end|>\n" and by[2, 0].reply_to is None
    assert quote_linking.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_nested_quotes_link_where_no_lower_level_does(spark):
    talk = [(1, 0, "user", "Where is the map?"), (1, 1, "assistant", "On the table."), (1, 2, "user", "It is not there at all."),
            (1, 3, "user", ">> Where is the map?\nGone."), (1, 4, "user", "> nobody said this\n> > On the table.\n>>> Where is the map?\nNo."),
            (1, 5, "user", ">>> It is not there at all.\n> Gone.\nOh."), (1, 6, "user", ">> nobody\nbye")]
    rows = quote_linking.formatted(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.reply_to, r.thread) for r in rows} == {0: (None, 0), 1: (None, 1), 2: (None, 2), 3: (0, 0), 4: (1, 1), 5: (3, 0), 6: (None, 6)}
    assert [r.turn for r in sorted(rows, key=lambda r: r.place)] == [0, 3, 5, 1, 4, 2, 6]


def test_long_thread(spark):
    talk = [(7, i, "user", f"line {i}" + (f"\n> line {i - 1}" if i else "")) for i in range(50)]
    rows = quote_linking.formatted(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()
    assert {r.thread for r in rows} == {0} and all(r.place == r.turn for r in rows)


def test_no_task_places_a_whole_conversation(spark, monkeypatch):
    chain = [(7, i, "user", f"line {i}" + (f"\n> line {i - 1}" if i else "")) for i in range(3000)]
    talk = chain + [(8, None, "user", f"note {i:04}") for i in range(1500)] + [(None, i % 3, "user", f"stray {i:04}") for i in range(1500)]
    messages = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    parts, real = [], quote_linking.written

    def kept(df, name):
        out = real(df, name)
        if name == "placed":
            parts.extend(out.groupBy("conv_id").agg(F.countDistinct("part").alias("parts"), F.count("*").alias("n")).collect())
        return out

    monkeypatch.setattr(quote_linking, "written", kept)
    monkeypatch.setattr(quote_linking, "threads", lambda links: links.withColumn("thread", F.lit(0).cast("long")))  # one chain from turn 0
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        rows = quote_linking.formatted(messages).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.conv_id: r.n for r in parts} == {7: 3000, 8: 1500, None: 1500} and min(r.parts for r in parts) >= 3
    order = lambda c, key: [key(r) for r in sorted((r for r in rows if r.conv_id == c), key=lambda r: r.place)]
    assert order(7, lambda r: (r.place, r.turn)) == [(i, i) for i in range(3000)]
    assert order(8, lambda r: (r.place, r.chat.split("\n")[1])) == [(i, f"note {i:04}") for i in range(1500)]
    assert order(None, lambda r: (r.turn, r.chat)) == sorted(order(None, lambda r: (r.turn, r.chat))) and {r.place for r in rows if r.conv_id is None} == {*range(1500)}


# --- archives

def test_ranges_own_each_record_once(spark, tmp_path):
    rng = random.Random(4)
    html = [None, "", "x" * 70000, "ü" * 30, *["same"] * 5, *("".join(chr(rng.randrange(32, 0x2FF)) for _ in range(rng.randrange(3000))) for _ in range(40))]
    pages = spark.createDataFrame([(i, f"http://h/{i} x", t, "clash") for i, t in enumerate(html)] + [(None, None, "same", ""), (4, "again", "same", "")], "page_id long, url string, html string, size string")
    manifest = warc_archive.write(pages.repartition(3), str(tmp_path))
    want = None
    for step in (97, 5000, 1 << 22):
        rows = warc_archive.read(manifest, step, payloads=True).collect()
        assert len(rows) == len(html) + 2 and all(r.digest_holds for r in rows)
        got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in rows)
        want = want or got
        assert got == want
    by = {r.page_id: r for r in rows}
    assert by[0].record_type == "response" and (by[1].record_type, by[1].refers_to) == ("revisit", 0) and by[2].payload == b"x" * 70000
    assert (by[8].refers_to, by[8].payload_bytes, by[8].payload) == (4, 4, None) and by[None].refers_to == 4
    assert warc_archive.read(warc_archive.write(pages.limit(0), str(tmp_path))).count() == 0


def test_magic_bytes_that_are_no_record(tmp_path):
    path = os.path.join(tmp_path, "a.gz")
    good = warc_archive.record(1, "u", b"payload", "D", 7, None, False)
    import gzip
    with open(path, "wb") as f:
        f.write(b"\x1f\x8b\x08junk" + gzip.compress(b"no record") + good + b"\x1f\x8b\x08" + good[:40])
    size = os.path.getsize(path)
    assert [b.endswith(b"payload") for s in range(0, size, 10) for _, b in warc_archive.records_in(path, size, s, min(size, s + 10))] == [True]


# --- licences

def plain_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts = {label: [i for i in range(len(w)) if w[i:i + len(p.split())] == p.split()] for p, label in license_diagonals.BASE}
    found = sorted(i for s in starts.values() for i in s)
    return len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(k for k, s in starts.items() if s))


def test_license_base_columns(spark, sf):
    texts = {r[0]: r[1] for r in cases.table(sf, "documents").fetchall()}
    for r in license_diagonals.scanned(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_license(texts[r.doc_id]) and 0 <= r.score <= 1
        for line, label in (("Apache License, Version 2.0", "apache-2.0"), ("Released under the MIT License", "mit"), ("CC BY-NC 4.0", "cc-by-nc-4.0")):
            assert (label in r.labels.split(",")) == (f"{line}." in texts[r.doc_id])


def test_license_spans_with_edits_repeats_and_look_alikes(spark):
    mit = license_diagonals.TEMPLATES[4][1]
    words = mit.split()
    edited = " ".join(words[:12] + ["kindly"] + words[12:30] + words[31:])
    texts = [*cases.ODD, mit, "x y " + edited, mit + " z " * 40 + mit, " ".join(words[:12]), " ".join(sorted(words)), "CC BY cc by all rights reserved. General Public License"]
    rows = {r.doc_id: r for r in license_diagonals.scanned(cases.with_null_id(cases.documents(spark, texts))).collect()}
    n = len(cases.ODD)
    assert [rows[n + i].labels for i in range(6)] == ["mit", "mit", "mit", "", "", "cc-by,gpl,reserved"]
    assert rows[n + 5].n_base == 4 and (rows[n + 5].first_word, rows[n + 5].last_word) == (0, 7) and rows[0].n_words == 0 and rows[0].score == 0
    assert license_diagonals.spans(cases.documents(spark, texts)).where(F.col("template") == 4).count() == 4
    assert license_diagonals.scanned(cases.documents(spark, [])).count() == 0 and len(rows) == len(texts) + 1


# --- pipeline

def test_stages_take_rows_without_an_own_id(spark):
    from touchline.llm import string_tiling
    words = lambda k, n=30: " ".join(f"{k}{i}" for i in range(n))
    item = words("item", 40)
    rows = [(None, item), (1, item + " x"), (1, words("clean")), (1, words("other")), (None, None), (2, item), (2, item)]
    docs = lambda r: spark.createDataFrame([(i, t, "en", "s") for i, t in r], "doc_id long, text string, lang string, named_row string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    left = string_tiling.decontaminated(docs(rows), bench)
    assert left.columns == docs(rows).columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, words("clean")), (1, words("other")), (None, None)], key=str)
    a, b, c, d, e = map(words, "abcde")
    near = d[:-3] + "end"
    rows = [(None, a), (5, a), (None, b), (None, b), (None, b), (7, c), (7, c), (7, e), (9, d), (9, near), (None, near), (8, None), (8, None), (None, ""), (4, e + "x")]
    kept = count_tree_join.one_of_each(docs(rows))
    assert kept.columns == docs(rows).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    fixed = [(5, a), (None, b), (7, c), (8, None), (None, ""), (4, e + "x")]
    assert got in [sorted([*fixed, (9, t)], key=str) for t in (d, near)]


def test_pipeline_takes_out_what_it_should(spark, tmp_path):
    import corpus_pipeline
    item = [f"b{i}" for i in range(40)]
    text = [f"t{i}" for i in range(60)]
    texts = ["you idiot scum " + " ".join(f"c{i}_{k}" for k in range(9)) for i in range(20)] + [" ".join(f"n{i}_{k}" for k in range(30)) for i in range(60)]
    texts += [" ".join(text), " ".join(text[:-1] + ["end"]), "before " + " ".join(item) + " after", "secret=hunter22222 " + " ".join(text[::-1]), None, ""]
    docs = cases.documents(spark, texts).drop("text_hash")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 20)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == {*range(20, 81), 83, 84, 85}
    from touchline.llm import piece_codec
    vocab = piece_codec.vocabulary(piece_codec.MODEL)
    assert vocab.decode(rows[83].ids).startswith("[assign] t59") and rows[84].ids == [] and vocab.decode(rows[20].ids) == texts[20]
    stage = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns


def test_a_range_is_a_task_under_adaptive_execution(spark, tmp_path):
    from pyspark.sql import Row
    pages = spark.createDataFrame([Row(page_id=i, url=f"u{i}", html=f"page {i} " * 400) for i in range(200)])
    manifest = warc_archive.write(pages, str(tmp_path))
    ranges = sum(-(-r["size"] // 2000) for r in manifest.collect())
    read = warc_archive.read(manifest, 2000)
    assert ranges > 8 and read.withColumn("task", F.spark_partition_id()).count() == 200 and read.rdd.getNumPartitions() == ranges


def test_copies_of_a_labelled_row_are_one_trial(spark):
    """Twenty good documents prove nothing, however often their rows stand in the table."""
    rows = [(i, "en", " ".join(f"w{i}x{k}" for k in range(30))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    copies = docs.crossJoin(spark.range(200).select(F.col("id").alias("copy"))).drop("copy")
    found = risk_rules.cutoffs(risk_rules.measured(copies), labels).collect()
    assert [r.n_good for r in found] == [20] and all(r[f"cut_{rule}"] is None for r in found for rule in risk_rules.RULES)
