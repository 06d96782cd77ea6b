"""DuckDB twins of the queries that SQL can express."""

from kinespark.llm import quality_rules as Q

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * k >= 80 * (len(p.s) + len(q.s) - k)),
walk AS (SELECT doc_id AS d, doc_id AS r FROM s UNION SELECT link.b, walk.r FROM walk JOIN link ON link.a = walk.d)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r) AS component_id FROM s JOIN walk ON d = s.doc_id GROUP BY s.doc_id, s.s
"""

OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, '~'))), 1, 15))::BIGINT AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(k - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_w,
             coalesce(sum(cap) OVER before, 0) AS filled, coalesce(sum(weight) OVER before, 0) AS past, cap / weight AS ratio FROM w
      WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - filled) / (all_w - past) AS level FROM r),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), 1e300)) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.source, digest, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY digest) AS upto, any_value(target - whole * source_size) AS rest
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source GROUP BY d.source, digest),
e AS (SELECT source, digest, upto, rest, coalesce(lag(upto) OVER (PARTITION BY source ORDER BY digest), 0) AS low FROM c),
g AS (SELECT source, max(digest) AS cut FROM e WHERE rest > 0 AND (upto < rest OR (low < rest AND upto >= rest AND upto - rest <= rest - low)) GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN digest <= cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source
"""

_GRID = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, cs in Q.GRID.items() for i, c in enumerate(cs))
_RISK, _TESTS = Q.RISK / len(Q.GRID), len(Q.GRID)

OP5 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '~') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS row FROM documents),
g AS (SELECT row, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY row),
m AS (
  SELECT w.row, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (row)),
x AS (SELECT *, {{'symbols': n_symbols / greatest(n_words, 1), 'dup_lines': n_dup_lines / greatest(n_lines, 1), 'repeats': n_repeat_words / greatest(n_words, 1),
                 'word_length': word_chars / greatest(n_words, 1)}} AS ratios, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (SELECT *, CASE rule WHEN 'symbols' THEN ratios.symbols WHEN 'dup_lines' THEN ratios.dup_lines WHEN 'repeats' THEN ratios.repeats ELSE ratios.word_length END AS value
      FROM x, (VALUES {_GRID}) AS grid(rule, step, cut)),
truth AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
tally AS (
  SELECT stratum, rule, step, cut, count(*) FILTER (held AND good) AS n, count(*) FILTER (held AND good AND value > cut) AS k,
         count(*) FILTER (NOT held AND good AND value > cut) AS good_out, count(*) FILTER (NOT held AND NOT good AND value > cut) AS bad_out
  FROM (SELECT v.*, good, ('0x' || substr(md5(v.doc_id::VARCHAR), 1, 15))::BIGINT % 2 = 1 AS held FROM v JOIN truth USING (doc_id)) GROUP BY ALL),
p AS (
  SELECT *, CASE WHEN n = 0 OR k > n * {_RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
           lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK})))) END AS p FROM tally),
f AS (SELECT *, p > {Q.DELTA} / greatest(1, {_TESTS} * (SELECT count(DISTINCT stratum) FROM m)) AS failed, bad_out - {Q.COST} * good_out AS gain FROM p),
cuts AS (
  SELECT stratum, rule, arg_max(cut, gain * 1000 - step) AS cut FROM f
  WHERE gain > 0 AND step < coalesce((SELECT min(step) FROM f h WHERE h.failed AND h.stratum = f.stratum AND h.rule = f.rule), 1000000) GROUP BY stratum, rule),
over_cut AS (SELECT DISTINCT row FROM v JOIN cuts USING (stratum, rule) WHERE value > cuts.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND over_cut.row IS NULL AS kept FROM x LEFT JOIN over_cut USING (row)
"""

OP11 = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT row, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS p FROM twice),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
         FROM (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w) ANTI JOIN gone USING (row, p) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (row)
"""

OP13 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label = e.label AS same, e.vec_id AS b, list_dot_product(a.v, e.v)::BIGINT AS s FROM e a JOIN e ON e.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INTEGER AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND n.s <= p.s QUALIFY rank <= 5
"""

ORACLES: dict[str, str] = {"op2_ngram_join": OP2, "op3_source_mix": OP3, "op5_quality_rules": OP5, "op11_substring_dedup": OP11, "op13_hard_negatives": OP13}
