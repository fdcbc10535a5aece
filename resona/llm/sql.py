"""DuckDB SQL beside the registered queries."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
_SPACE_WORD = "[^\\x20\\x09-\\x0D]+"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = {
    "op3_curriculum_mixing": """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][kind + 1] AS weight, 3 * source_size AS cap, (SELECT sum(source_size) FROM per)::BIGINT AS total FROM per),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY source_size / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
targets AS (
  SELECT source, source_size, kind, total, CASE WHEN cap <= level * weight THEN cap::DOUBLE
    ELSE (SELECT max(level) FROM levels WHERE cap > level * weight) * weight END AS target FROM levels),
placed AS (
  SELECT d.*, t.source_size, t.kind, t.total, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
repeated AS (
  SELECT *, CASE WHEN size > 0 THEN whole + (2 * place + size <= 2 * (target - whole * source_size))::BIGINT ELSE 0 END AS epochs
  FROM placed),
shared AS (SELECT *, least((place + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS share FROM repeated),
timed AS (
  SELECT *, CASE kind
    WHEN 0 THEN least(CASE WHEN share <= 0 THEN 0 ELSE 2 * share / (1.5 + sqrt(2.25::DOUBLE - 2 * share)) END, 1)
    WHEN 1 THEN least(2 * share / (1 + sqrt(1.0::DOUBLE)), 1)
    ELSE CASE WHEN share <= 0.375 THEN 2 * share / (0.5 + sqrt(0.25::DOUBLE + 2 * share))
         ELSE least(0.5 + 2 * (share - 0.375) / (1 + sqrt(1.0::DOUBLE + 2 * (share - 0.375))), 1) END END AS moment
  FROM shared)
SELECT doc_id, size, source_size, target, (size * epochs)::BIGINT AS taken,
       CASE WHEN epochs > 0 THEN round(moment * total, 3) END AS first_position
FROM timed
""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, list_slice(w, s, s + 9) AS g, len(list_slice(w, s, s + 9)) AS m
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, s, m, list_slice(w, s, s + m - 1) AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hits AS (SELECT doc_id, s, grams.m, item FROM grams JOIN windows USING (g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_ngram_join": f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_SPACE_WORD}') AS w FROM documents),
grams AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, s, s + 4), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, q) AS (SELECT r, r FROM words UNION SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.q)
SELECT words.doc_id, any_value(coalesce(sizes.n, 0))::BIGINT AS n_shingles, min(other.doc_id) AS component_id
FROM words JOIN reach USING (r) JOIN words other ON other.r = reach.q LEFT JOIN sizes ON sizes.r = words.r
GROUP BY words.r, words.doc_id
""",
    "op4_line_dedup": """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS content
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
numbered AS (
  SELECT doc_id, line, content, dense_rank() OVER (ORDER BY content) AS id, count(*) OVER (PARTITION BY content) AS uses,
         len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines),
stretches AS (
  SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS stretch FROM numbered WHERE uses > 1),
listed AS (
  SELECT doc_id, min(line) AS base, list(id ORDER BY line) AS ids, list(words ORDER BY line) AS words
  FROM stretches GROUP BY doc_id, stretch),
starts AS (SELECT *, unnest(range(1, len(ids) + 1)) AS s FROM listed),
runs AS (SELECT *, unnest(range(s, len(ids) + 1)) AS e FROM starts),
passages AS (
  SELECT doc_id, base + s - 1 AS first_line, base + e - 1 AS last_line, list_slice(ids, s, e) AS run
  FROM runs WHERE list_sum(list_slice(words, s, e)) >= 50),
ordered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first_line) AS copy FROM passages),
gone AS (SELECT DISTINCT doc_id, unnest(range(first_line, last_line + 1)) AS line FROM ordered WHERE copy > 1),
kept AS (
  SELECT doc_id, string_agg(content, chr(10) ORDER BY line) FILTER (gone.line IS NULL) AS text,
         count(*) AS n_lines, count(gone.line) AS n_deleted
  FROM lines LEFT JOIN gone USING (doc_id, line) GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_deleted::BIGINT AS n_deleted, md5(coalesce(text, '')) AS text_md5 FROM kept
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
WHERE rank <= 3
""",
    "op12_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM listed, range(1, 5) AS sizes(m) WHERE len(w) >= m) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE m = 1 GROUP BY lang),
frequent AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM phrases WHERE f >= 30),
inner_ AS (
  SELECT lang, phrase, max(f) AS longest FROM (
    SELECT lang, f, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase
    FROM (SELECT lang, f, w, k, unnest(range(1, m - k + 2)) AS s FROM frequent, range(2, 4) AS sizes(k) WHERE m > k)) GROUP BY ALL),
kept AS (
  SELECT lang, phrase, m, f AS a, w FROM frequent LEFT JOIN inner_ USING (lang, phrase)
  WHERE m > 1 AND (longest IS NULL OR 100 * longest::HUGEINT < 80 * f::HUGEINT)),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, m), ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, 2000000 * a::HUGEINT // (x.f::HUGEINT + y.f::HUGEINT) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.head JOIN frequent y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest JOIN totals USING (lang))
WHERE rank <= 2000
""",
}
