"""DuckDB twins of the queries that SQL can express."""

from roadpulse.llm import urls


def _strings(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


OP3 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS t
  FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (SELECT unnest(range(5)) AS o) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
failed AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits
  FROM measured)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM failed
"""

OP10 = f"""
WITH cut AS (
  SELECT page_id, lower(coalesce(url, '')) AS u,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, u, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h, coalesce(rest, '') AS rest FROM cut),
named AS (
  SELECT page_id, u, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts),
rules(verdict, rh, rp) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)}),
fitting AS (
  SELECT page_id, rh || rp AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
  FROM named JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp)),
terms(term, strict) AS (
  SELECT unnest([{_strings(urls.STRICT)}]), 1 UNION ALL SELECT unnest([{_strings(urls.SOFT)}]), 0),
hits AS (
  SELECT page_id, sum(strict)::BIGINT AS n_strict, sum(1 - strict)::BIGINT AS n_soft
  FROM named JOIN terms ON regexp_matches(u, '(^|[^\\pL\\pN])' || term || '($|[^\\pL\\pN])')
  GROUP BY page_id)
SELECT named.page_id, host, path, rule, coalesce(n_strict, 0)::BIGINT AS n_strict,
  coalesce(n_soft, 0)::BIGINT AS n_soft,
  coalesce(verdict, CASE WHEN n_strict > 0 OR n_soft >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN (SELECT * FROM fitting WHERE k = 1) USING (page_id) LEFT JOIN hits USING (page_id)
"""


OP12 = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
starts AS (
  SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
counts AS (
  SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM starts GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE s > 1),
cuts AS (SELECT *, unnest(range(1, s)) AS k FROM candidates),
scores AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, k,
    (1000 * c.a::HUGEINT * n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, s - z + 2)) AS i FROM (SELECT *, unnest(range(2, s)) AS z FROM candidates))
  GROUP BY ALL),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def all_sql() -> dict[str, str]:
    return {
        "op3_quality_ledger": OP3,
        "op10_url_vocabulary": OP10,
        "op12_misra_gries_phrases": OP12,
        "op13_bond_hard_negatives": OP13,
    }
