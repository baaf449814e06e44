"""DuckDB SQL of the registered queries that SQL can express."""

#: Words: runs of characters other than space, tab, line feed, vertical tab, form feed and return.
WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {WORDS.format('text')} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
),
win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid
),
f AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(ln) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM d LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND 100 * n_upper <= 40 * word_chars
       AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 100 * n_dup_lines <= 50 * n_lines AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
"""

OP8 = r"""
WITH ln AS (
  SELECT DISTINCT coalesce(text, '') AS copy, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
),
tok AS (
  SELECT copy, line, list_filter(string_split_regex(regexp_replace(line, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'),
                                                    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
leaf AS (SELECT copy, line, w, (len(w), w[1:3])::VARCHAR AS leaf FROM tok),
leaves AS (SELECT leaf, count(DISTINCT copy) AS texts FROM leaf GROUP BY leaf HAVING count(DISTINCT copy) >= 5),
busy AS (SELECT DISTINCT copy, leaf, texts, w FROM leaf JOIN leaves USING (leaf)),
-- the wording of a leaf after its prefix: words in 5 texts and in a tenth of the leaf's texts
fixed AS (
  SELECT leaf, i, w[i] AS x FROM (SELECT copy, leaf, texts, w, unnest(range(4, len(w) + 1)) AS i FROM busy)
  WHERE w[i] <> '<*>' GROUP BY leaf, i, w[i], texts HAVING count(DISTINCT copy) >= greatest(5, 0.1 * texts)
),
gen AS (
  SELECT leaf, w, list((i, x) ORDER BY i) AS tpl
  FROM (SELECT DISTINCT leaf, w FROM busy) JOIN fixed USING (leaf) WHERE w[i] = x GROUP BY leaf, w
),
good AS (SELECT leaf, w, (leaf, tpl)::VARCHAR AS tpl FROM gen WHERE len(tpl) >= 0.6 * (len(w) - 3)),
often AS (SELECT tpl FROM busy JOIN good USING (leaf, w) GROUP BY tpl HAVING count(DISTINCT copy) >= 5),
-- and lines that recur by themselves
same AS (
  SELECT w FROM (SELECT copy, w, CASE WHEN len(w) > 3 THEN w[4:] ELSE w END AS judged FROM busy)
  WHERE len(list_filter(judged, lambda x: x <> '<*>')) >= 0.6 * len(judged) GROUP BY w HAVING count(DISTINCT copy) >= 5
),
gone AS (SELECT DISTINCT w FROM good WHERE tpl IN (SELECT tpl FROM often) UNION SELECT w FROM same),
pos AS (
  SELECT rid, doc_id, text, k, string_split(text, chr(10))[k] AS line
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents))
),
flag AS (
  SELECT pos.*, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word,
         list_filter(string_split_regex(regexp_replace(line, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'),
                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') IN (SELECT w FROM gone) AS drop
  FROM pos
),
done AS (
  SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT (has_word AND drop)), '') AS text,
         count(*) FILTER (has_word) AS n_lines, count(*) FILTER (has_word AND drop) AS n_dropped
  FROM flag GROUP BY rid
)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE done.text END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines,
       coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents) d LEFT JOIN done USING (rid)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS.format('text')})::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
),
-- the level at which the sources under their caps share what the capped ones leave
l AS (
  SELECT *, 2 * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
         row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS k
  FROM s
  WINDOW before AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (
  SELECT source, source_size, least(cap, weight * (SELECT min_by(level, k) FROM l WHERE level * weight <= cap)) AS target FROM l
),
o AS (
  SELECT doc_id, size, source_size, target::DOUBLE AS target, floor(target)::BIGINT AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS LAST, size
                         ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM o
"""

OP7 = r"""
WITH iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, w AS whole, array_to_string(w[k:k + 4], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM iw)
),
n AS (SELECT item_id, whole, count(*) AS n_item FROM i GROUP BY ALL),
dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
),
d AS (
  SELECT DISTINCT rid, doc_id, array_to_string(w[k:k + 4], ' ') AS g
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM dw)
),
hit AS (
  SELECT rid, doc_id, i.item_id, i.whole, count(*) AS n_shared FROM d JOIN i USING (g) GROUP BY ALL
),
best AS (
  SELECT doc_id, hit.item_id, n_shared, n_item, n_shared / n_item AS containment
  FROM hit JOIN n ON hit.item_id IS NOT DISTINCT FROM n.item_id AND hit.whole = n.whole
  WHERE n_shared >= 0.8 * n_item - 1e-9
)
SELECT * FROM best
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY containment DESC, n_shared DESC) = 1
"""

OP10 = r"""
WITH RECURSIVE
rules(v, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
-- targets of canonical links and meta refreshes
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^>]*>')) AS t FROM p WHERE contains(url, '://')),
refs AS (
  SELECT url, regexp_replace(regexp_replace(regexp_extract(t, '(?i)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))'),
                                            '(?i)^\s*href\s*=\s*["'']?', ''), '["'']$', '') AS link
  FROM tags WHERE regexp_matches(t, '(?i)^<link\s') AND regexp_matches(t, '(?i)\srel\s*=\s*["'']?\s*canonical["''\s>/]')
  UNION ALL
  SELECT url, regexp_extract(t, '(?i)[;,]\s*url\s*=\s*''?([^"''>]*)', 1) AS link
  FROM tags WHERE regexp_matches(t, '(?i)^<meta\s') AND regexp_matches(t, '(?i)\shttp-equiv\s*=\s*["'']?\s*refresh["''\s>/]')
),
-- character references: by number first, & itself in the last pass
numbered AS (
  SELECT url, list_reduce(list_distinct(regexp_extract_all(link, '&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});')), lambda t, r:
    CASE WHEN (CASE WHEN regexp_matches(r, '^&#[xX]') THEN ('0x' || r[4:-2])::BIGINT ELSE r[3:-2]::BIGINT END) BETWEEN 1 AND 1114111 AND (CASE WHEN regexp_matches(r, '^&#[xX]') THEN ('0x' || r[4:-2])::BIGINT ELSE r[3:-2]::BIGINT END) NOT BETWEEN 55296 AND 57343 AND (CASE WHEN regexp_matches(r, '^&#[xX]') THEN ('0x' || r[4:-2])::BIGINT ELSE r[3:-2]::BIGINT END) <> 38
         THEN replace(t, r, chr((CASE WHEN regexp_matches(r, '^&#[xX]') THEN ('0x' || r[4:-2])::BIGINT ELSE r[3:-2]::BIGINT END)::INT)) ELSE t END, trim(link)) AS link
  FROM refs WHERE trim(link) <> ''
),
links AS (
  SELECT DISTINCT url, regexp_replace(replace(replace(replace(replace(link, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)),
                                      '&(?:amp|#0*38|#[xX]0*26);', '&', 'g') AS link
  FROM numbered
),
parts AS (
  SELECT url, link, split_part(url, '://', 1) || '://' AS scheme, regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*') AS host,
         regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) AS path
  FROM links
),
joined AS (
  SELECT url, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN scheme[:-3] || link
    WHEN starts_with(link, '/') THEN scheme || host || link
    WHEN starts_with(link, '?') OR starts_with(link, '#') THEN scheme || host || path || link
    ELSE scheme || host || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || link END AS whole
  FROM parts
),
cut AS (
  SELECT url, regexp_extract(whole, '^(.*?://[^/?#]*)', 1) AS head, regexp_extract(whole, '^.*?://[^/?#]*(/[^?#]*)', 1) AS path,
         regexp_extract(whole, '^.*?://[^/?#]*(?:/[^?#]*)?(.*)$', 1) AS tail
  FROM joined
),
segments AS (SELECT *, string_split(path[2:], '/') AS seg FROM cut),
-- . and .. resolved, segment by segment
edges AS (
  SELECT url AS a, head || CASE WHEN NOT regexp_matches(path, '/\.\.?(?:/|$)') THEN path ELSE
    '/' || array_to_string(list_concat(
      list_reduce(list_transform(seg, lambda x: [x]), lambda kept, x: CASE WHEN x[1] = '..' THEN kept[:-2] WHEN x[1] = '.' THEN kept
                                                                            ELSE list_concat(kept, x) END, []::VARCHAR[]),
      CASE WHEN seg[-1] IN ('.', '..') THEN [''] ELSE [] END), '/') END || tail AS b
  FROM segments
),
-- every URL: host, path, node and the verdict of the longest rule
u AS (SELECT url FROM p UNION SELECT a FROM edges UNION SELECT b FROM edges),
v AS (
  SELECT url, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM (SELECT url, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM u)
),
j AS (
  SELECT url, host, path, host || CASE WHEN tail = '' THEN '/' ELSE tail END AS node, best[1] AS verdict, best[2] AS rule
  FROM (SELECT *, (SELECT max_by([r.v, rh || rp], length(rh || rp)) FROM rules r
                   WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM v)
),
e AS (SELECT x.node AS a, y.node AS b FROM edges JOIN j x ON edges.a = x.url JOIN j y ON edges.b = y.url),
reach AS (
  SELECT a AS node, a AS other FROM e UNION SELECT b, b FROM e
  UNION
  SELECT reach.node, z.b FROM reach JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) z ON reach.other = z.a
),
decided AS (
  SELECT reach.node, bool_or(j.verdict = 'block') AND NOT coalesce(bool_or(j.verdict = 'allow'), false) AS blocked
  FROM reach JOIN j ON reach.other = j.node
  WHERE j.url IN (SELECT a FROM edges UNION SELECT b FROM edges)
  GROUP BY reach.node
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM p JOIN j USING (url) LEFT JOIN decided USING (node)
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
),
i AS (
  SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
  FROM benchmark
),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, n_docs),
s AS (
  SELECT item_id, rid, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w)::BIGINT * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN t USING (term) JOIN d USING (rid), c
  GROUP BY item_id, rid
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM s JOIN d USING (rid) WHERE score > 0
QUALIFY rank <= 50
"""


def _op12(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """One pair of common table expressions (assignment, centroids) for each round."""
    def nearest(turn: int) -> str:
        return f"""
a{turn} AS MATERIALIZED (
  SELECT rid, min_by(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT rid, c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (e.v[i] - m.v[i]) * (e.v[i] - m.v[i])))::BIGINT AS d FROM e, c{turn} m)
  GROUP BY rid
)"""

    def means(turn: int) -> str:
        return f"""
c{turn + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{turn} o LEFT JOIN (
    SELECT c, list(m ORDER BY i) AS v FROM (
      SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m
      FROM (SELECT c, i, sum(e.v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{turn} JOIN e USING (rid), range(1, {dims + 1}) r(i) GROUP BY c, i)
    ) GROUP BY c
  ) n USING (c)
)"""

    steps = [nearest(0)] + [step for turn in range(rounds) for step in (means(turn), nearest(turn + 1))]
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM e) ORDER BY h, v LIMIT {k}
),{",".join(steps)}
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN e USING (rid) JOIN c{rounds} m USING (c)
"""


OP12 = _op12()

OP13 = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.rid ORDER BY list_distance(q.v, e.v), e.vec_id NULLS LAST)::INT AS rank,
       e.vec_id, list_distance(q.v, e.v) AS score
FROM (SELECT * FROM e WHERE vec_id % 100 = 0) q JOIN e ON len(q.v) = len(e.v) AND q.rid <> e.rid
QUALIFY rank <= 10
"""

ORACLE = {
    "op11_lexical_search": OP11,
    "op12_centroid_clusters": OP12,
    "op13_nearest_neighbours": OP13,
    "op7_benchmark_decontamination": OP7,
    "op10_url_filters": OP10,
    "op8_line_templates": OP8,
    "op9_source_mixing": OP9,
    "op1_quality_rules": OP1,
}
