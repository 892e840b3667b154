"""Registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from touchline.llm import (centroid_walk, count_tree_join, license_diagonals, ordinal_toxicity, piece_codec, quote_linking, risk_rules,
                           secret_scan, simhash_slices, source_divergence, string_tiling, warc_archive, zstd_language)
from touchline.llm.common import table


def op1_secret_scan(spark, sf_dir):
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op2_piece_codec(spark, sf_dir):
    return piece_codec.encoded_documents(table(spark, sf_dir, "documents"))


def op3_ordinal_toxicity(spark, sf_dir):
    return ordinal_toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_string_tiling(spark, sf_dir):
    return string_tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_count_tree_join(spark, sf_dir):
    return count_tree_join.joined(table(spark, sf_dir, "documents"))


def op6_quote_linking(spark, sf_dir):
    return quote_linking.formatted(table(spark, sf_dir, "conversations"))


def op7_risk_rules(spark, sf_dir):
    return risk_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc_archive(spark, sf_dir):
    return warc_archive.round_trip(table(spark, sf_dir, "pages"))


def op9_zstd_language(spark, sf_dir):
    return zstd_language.identified(table(spark, sf_dir, "documents"))


def op10_license_diagonals(spark, sf_dir):
    return license_diagonals.scanned(table(spark, sf_dir, "documents"))


def op11_centroid_walk(spark, sf_dir):
    return centroid_walk.digest(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark, sf_dir):
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_simhash_slices(spark, sf_dir):
    return simhash_slices.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_piece_codec, op3_ordinal_toxicity, op4_string_tiling, op5_count_tree_join,
                                   op6_quote_linking, op7_risk_rules, op8_warc_archive, op9_zstd_language, op10_license_diagonals, op11_centroid_walk, op12_source_divergence,
                                   op13_simhash_slices)}
#: Lower-cased words of each document, and each document's distinct shingles, for the SQL below.
_SHINGLES = r"""
words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id)"""

def _risk_sql() -> str:
    rules = risk_rules.RULES
    values = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {k} AS place, {r}::DOUBLE AS v FROM measures" for k, r in enumerate(rules))
    grid = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, cuts in rules.items() for i, c in enumerate(cuts))
    p = risk_rules.RISK / len(rules)
    return rf"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM w, unnest(range(1, len(w) - 6)) u(i)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id),
counts AS (SELECT w.doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capitals,
    length(t) - length(regexp_replace(t, '[^\p{{L}}\p{{N}}\s]', '', 'g')) AS n_marks FROM w LEFT JOIN covered USING (doc_id)),
measures AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeated_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS repeated_lines,
    CASE WHEN word_chars > 0 THEN n_capitals / word_chars ELSE 0 END AS capitals_share, CASE WHEN word_chars > 0 THEN n_marks / word_chars ELSE 0 END AS marks_share,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS characters_per_word FROM counts),
stats AS ({values}),
grid(rule, i, c) AS (VALUES {grid}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
trials AS (SELECT stratum, doc_id, rule, max(v) AS v FROM stats JOIN good USING (doc_id) GROUP BY ALL),
tests AS (SELECT stratum, s.rule, i, c, count(*) AS n, count(*) FILTER (WHERE v >= c) AS k FROM trials s JOIN grid g ON g.rule = s.rule GROUP BY ALL),
passed AS (SELECT *, CASE WHEN k >= n * {p} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1)
    - CASE WHEN j = n THEN 0 ELSE lgamma(n - j + 1) END + j * ln({p}) + (n - j) * ln(1 - {p})))) END
    <= {risk_rules.DELTA} / ((SELECT count(DISTINCT stratum) FROM measures) * {len(rules)}) AS ok FROM tests),
held AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY i) AS holds FROM passed),
chosen AS (SELECT stratum, rule, min(c) AS cut FROM held WHERE holds GROUP BY stratum, rule),
rejected AS (SELECT doc_id, string_agg(rule, ',' ORDER BY place) AS rejected_by FROM stats JOIN chosen USING (stratum, rule) WHERE v >= cut GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM measures LEFT JOIN rejected USING (doc_id)"""


def _centroid_sql(k: int = 8, rounds: int = 10) -> str:
    ctes = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM v ORDER BY c LIMIT {k})"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, min((d, c)) AS best FROM (SELECT r, c, list_sum(list_transform(list_zip(v.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            ctes.append(f"""s{i} AS (SELECT best[2] AS c, j, sum(v.v[j]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) u(j) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{i} GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
    (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c = best[2]"""


#: Every count of every term with every other source, as the definition reads.
_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
vocabulary AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY lang),
groups AS (SELECT lang, source, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sizes USING (lang)),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN vocabulary USING (lang, term) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, g.v, y.term, coalesce(c.n, 0) AS n, y.n AS lang_n FROM groups g JOIN vocabulary y USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = y.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 1)) // (sum(lang_n) OVER (PARTITION BY lang, source) + v) AS q FROM full_c),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


ORACLE: dict[str, str] = {
    "op11_centroid_walk": _centroid_sql(),
    "op12_source_divergence": _DIVERGENCE,
    "op8_warc_archive": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, size, min(page_id) OVER (PARTITION BY h, size) AS first, array_to_string(list_transform(range(0, 8), lambda g:
    array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + g * 5, 5))::INTEGER >> s) & 31), 1)), '')), '') AS digest FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to, true AS digest_holds FROM d""",
    "op7_risk_rules": _risk_sql(),
    "op5_count_tree_join": f"""WITH RECURSIVE {_SHINGLES},
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)""",
}
