"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

import textwrap

TYPES = ("REPLY_TO", "SAME_ARTICLE", "SIMILARITY", "SAME_GROUP", "SAME_COMMENT", "TEMPORAL")
SHORT = {"reply_to": "REPLY_TO", "same_article": "SAME_ARTICLE", "similarity": "SIMILARITY", "same_group": "SAME_GROUP", "same_comment": "SAME_COMMENT", "temporal": "TEMPORAL"}

RAW = """
raw AS (
  SELECT conv_id * 16 + turn + 1 AS id, conv_id AS article_id, 'c' || conv_id || '_' || turn AS comment_id, role AS username,
    1704067200000000 + (conv_id * 600 + turn * 137) * 1000000 + turn * 250000 AS micros, text,
    CASE WHEN turn <> 0 AND turn % 3 <> 2 THEN 'c' || conv_id || '_' || (turn - 1) END AS reply_to,
    nullif(length(text) % 7, 0) AS upvotes, length(text) % 3 AS downvotes,
    CASE WHEN role = 'assistant' THEN length(text) % 5 END AS likes, nullif(turn % 4, 0) AS recommended
  FROM conversations
), comments AS (
  SELECT r.*, a.id AS reply_to_id, row_number() OVER (ORDER BY r.id) - 1 AS c_idx
  FROM raw r LEFT JOIN raw a ON r.reply_to = a.comment_id AND r.article_id = a.article_id
)"""


def sentences(source: str, key: str) -> str:
    return rf"""
pos AS (SELECT {key} AS k, text, unnest(range(2, length(text) + 1)) AS p FROM {source}),
cuts AS (
  SELECT k, p FROM pos
  WHERE regexp_matches(substr(text, p, 1), '[\s\x0b\x1c-\x1f\x85\p{{Z}}]') AND substr(text, p - 1, 1) IN ('.', '?')
    AND NOT (p > 4 AND regexp_matches(substr(text, p - 4, 4), '^[\p{{L}}\p{{N}}_]\.[\p{{L}}\p{{N}}_].$'))
    AND NOT (p > 3 AND regexp_matches(substr(text, p - 3, 3), '^[A-Z][a-z]\.$'))
  UNION ALL SELECT {key}, 0 FROM {source}
), seg AS (
  SELECT c.k, c.p, row_number() OVER w - 1 AS nth, substr(s.text, c.p + 1, coalesce(lead(c.p) OVER w, length(s.text) + 1) - c.p - 1) AS sentence
  FROM cuts c JOIN {source} s ON s.{key} = c.k WINDOW w AS (PARTITION BY c.k ORDER BY c.p)
), spans AS (
  SELECT k, row_number() OVER w - 1 AS s_idx, sentence, coalesce(sum(length(sentence) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
  FROM seg WHERE length(sentence) >= 10 WINDOW w AS (PARTITION BY k ORDER BY p)
)"""


NODES = RAW + "," + sentences("comments", "c_idx") + """,
nodes AS (SELECT c.c_idx, s_idx, c.id, c.article_id, s, s + length(sentence) AS e FROM spans JOIN comments c ON c.c_idx = k)"""

ENDS = "src_c, src_s, tgt_c, tgt_s"
PAIR = "a.c_idx AS src_c, a.s_idx AS src_s, b.c_idx AS tgt_c, b.s_idx AS tgt_s"

EDGES = {
    "SAME_ARTICLE": f"SELECT {PAIR}, 1.0::DOUBLE AS w FROM nodes a JOIN nodes b ON a.article_id = b.article_id AND a.c_idx < b.c_idx WHERE a.s_idx = 0 AND b.s_idx = 0",
    "SAME_COMMENT": f"SELECT {PAIR}, 1.0::DOUBLE AS w FROM nodes a JOIN nodes b ON a.c_idx = b.c_idx AND a.s_idx + 1 = b.s_idx",
    "REPLY_TO": f"""SELECT {PAIR}, 1.0::DOUBLE AS w FROM (
        SELECT DISTINCT least(x.c_idx, y.c_idx) AS lo, greatest(x.c_idx, y.c_idx) AS hi FROM comments x JOIN comments y ON x.reply_to_id = y.id WHERE x.c_idx <> y.c_idx
      ) JOIN nodes a ON a.c_idx = lo JOIN nodes b ON b.c_idx = hi WHERE a.s_idx = 0 AND b.s_idx = 0""",
    "TEMPORAL": f"""SELECT {PAIR}, w FROM (
        SELECT x.c_idx AS lo, y.c_idx AS hi, 1 - (CASE WHEN x.micros > y.micros THEN (x.micros - y.micros) / 1e6 ELSE floor((y.micros - x.micros) / 1e6) END) / 1000 AS w
        FROM comments x JOIN comments y ON x.c_idx < y.c_idx
        WHERE (CASE WHEN x.micros > y.micros THEN (x.micros - y.micros) / 1e6 ELSE floor((y.micros - x.micros) / 1e6) END) < 1000
      ) JOIN nodes a ON a.c_idx = lo JOIN nodes b ON b.c_idx = hi
      UNION ALL SELECT {PAIR}, 1.0::DOUBLE AS w FROM nodes a JOIN nodes b ON a.c_idx = b.c_idx AND a.s_idx < b.s_idx""",
}
VECTORS = "v AS MATERIALIZED (SELECT vec_id AS c_idx, embedding::DOUBLE[] AS e, sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])) AS n FROM embeddings)"
COSINES = f"""{VECTORS},
cosines AS MATERIALIZED (
  SELECT x.c_idx AS c_a, y.c_idx AS c_b, CASE WHEN a.e IS NULL OR b.e IS NULL THEN 0 WHEN a.n = 0 AND b.n = 0 THEN 1 WHEN a.n = 0 OR b.n = 0 THEN 0
    ELSE list_dot_product(a.e, b.e) / (a.n * b.n) END AS cos
  FROM comments x JOIN comments y ON x.c_idx < y.c_idx LEFT JOIN v a ON a.c_idx = x.c_idx LEFT JOIN v b ON b.c_idx = y.c_idx
)"""
EDGES["SIMILARITY"] = f"SELECT {PAIR}, (1 - cos) / 0.25 * 0.1 AS w FROM cosines JOIN nodes a ON a.c_idx = c_a JOIN nodes b ON b.c_idx = c_b WHERE cos < 0.75 AND a.s_idx = 0 AND b.s_idx = 0"


def graph(*kinds: str) -> str:
    """WITH ... nodes, edges (E) of the given generators."""
    parts = " UNION ALL ".join(f"SELECT {ENDS}, {', '.join('w AS ' + t if t == k else 'NULL::DOUBLE AS ' + t for t in TYPES)} FROM ({EDGES[k]})" for k in kinds)
    sums = ", ".join(f"max({t}) AS {t}" for t in TYPES)
    extra = "," + COSINES if "SIMILARITY" in kinds else ""
    return f"WITH RECURSIVE {NODES}{extra}, E AS MATERIALIZED (SELECT {ENDS}, {sums} FROM ({parts}) GROUP BY ALL)"


CHAINS = graph("SAME_COMMENT")
STRUCTURAL = graph("SAME_ARTICLE", "SAME_COMMENT", "REPLY_TO")
FOUR = graph("SAME_ARTICLE", "SAME_COMMENT", "REPLY_TO", "TEMPORAL")
SIMILAR = graph("SIMILARITY").replace("E AS MATERIALIZED", "E AS MATERIALIZED", 1)
DIGEST = f"src_c, tgt_c, count(*) AS n, sum(src_s * 1000 + tgt_s)::BIGINT AS places, sum((src_s * 1000 + tgt_s) * (src_s * 1000 + tgt_s))::BIGINT AS squares, {', '.join(f'round(sum({t}), 6) AS {t.lower()}' for t in TYPES)}"
PLAIN = f"{ENDS}, {', '.join(f'round({t}, 6) AS {t.lower()}' for t in TYPES)}"
VOTES = "coalesce(upvotes, 0) + coalesce(likes, 0) + coalesce(recommended, 0)"


def toxicity(text: str, window: int = 125) -> str:
    normal = f"""regexp_replace(regexp_replace({text}, '([''".()!?\\-\\\\/,])', ' \\1 ', 'g'), '[;:|\\n]', ' ', 'g')"""
    found = f"list_filter(regexp_split_to_array({normal}, '[ \\t\\n\\x0b\\f\\r]+'), lambda t: t <> '')"
    return f"(SELECT CASE WHEN len(l) = 0 THEN 0 ELSE len(list_filter(l, lambda t: regexp_matches(t, '[A-Z!?]'))) / len(l) END FROM (SELECT ({found})[-{window}:] AS l))"


def pagerank(kind: str, iterations: int, digits: int, tolerance: float | None = None, damping: float = 0.85) -> str:
    """CTEs up to ``ranks`` (c_idx, s_idx, pr)."""
    stop = "k = (SELECT max(k) FROM x)" if tolerance is None else f"k = (SELECT coalesce(min(k) FILTER (WHERE d <= {tolerance}), max(k)) FROM change)"
    change = "" if tolerance is None else ", change AS (SELECT b.k, sqrt(sum((b.r - a.r) * (b.r - a.r))) AS d FROM x a JOIN x b ON a.c = b.c AND a.s = b.s AND b.k = a.k + 1 GROUP BY b.k)"
    return f"""
used AS MATERIALIZED (SELECT {ENDS}, {kind} AS w FROM E WHERE {kind} <> 0),
outs AS MATERIALIZED (SELECT src_c, src_s, sum(w) AS r FROM used GROUP BY ALL),
share AS MATERIALIZED (SELECT {ENDS}, w / r AS p FROM used JOIN outs USING (src_c, src_s)),
base AS MATERIALIZED (SELECT c_idx AS c, s_idx AS s, r IS NOT NULL AS gives, count(*) OVER () AS n FROM nodes LEFT JOIN outs ON src_c = c_idx AND src_s = s_idx),
x(k, c, s, gives, n, r) AS (
  SELECT 0, c, s, gives, n, 1.0::DOUBLE / n FROM base
  UNION ALL
  (WITH i AS (SELECT tgt_c, tgt_s, sum(p * r) AS got FROM share JOIN x ON src_c = c AND src_s = s GROUP BY ALL),
        t AS (SELECT coalesce(sum(r) FILTER (WHERE gives), 0) AS g, coalesce(sum(r) FILTER (WHERE NOT gives), 0) AS l FROM x)
   SELECT k + 1, c, s, gives, n, {damping} * coalesce(got, 0) + ((1 - {damping}) * g / (g + l) + l / (g + l)) / n
   FROM x CROSS JOIN t LEFT JOIN i ON tgt_c = c AND tgt_s = s WHERE k < {iterations})
){change},
last AS MATERIALIZED (SELECT * FROM x WHERE {stop}),
ranks AS MATERIALIZED (SELECT c AS c_idx, s AS s_idx, round(r / (SELECT sum(r) FROM last), 12) AS pr FROM last)"""


def node_weights(name: str, kinds: str) -> tuple[str, str]:
    """(CTEs, table of c_idx, s_idx, w)."""
    if name == "SIZE":
        return "", "(SELECT c_idx, s_idx, (e - s)::DOUBLE AS w FROM nodes)"
    if name == "VOTES":
        return "", f"(SELECT c_idx, s_idx, ({VOTES} + coalesce(downvotes, 0))::DOUBLE AS w FROM nodes JOIN comments USING (c_idx))"
    if name == "RECENCY":
        return "", "(SELECT c_idx, s_idx, (micros - (SELECT min(micros) FROM comments)) / 1e6 AS w FROM nodes JOIN comments USING (c_idx))"
    if name == "TOXICITY":
        return "", f"(SELECT c_idx, s_idx, {toxicity('text')} AS w FROM nodes JOIN comments USING (c_idx))"
    if name == "DEGREE_CENTRALITY":
        return "", f"(SELECT c_idx, s_idx, coalesce(k, 0)::DOUBLE AS w FROM nodes LEFT JOIN (SELECT c, z, count(*) AS k FROM (SELECT DISTINCT {ENDS}, src_c AS c, src_s AS z FROM E UNION SELECT {ENDS}, tgt_c, tgt_s FROM E) GROUP BY ALL) ON c = c_idx AND z = s_idx)"
    return "," + pagerank("SAME_COMMENT", 10, 9), "(SELECT c_idx, s_idx, pr AS w FROM ranks)"


def groups(condition: str) -> str:
    """Connected components of small groups: (c_idx, s_idx, rep_c, rep_s)."""
    return f"""
near AS MATERIALIZED (SELECT src_c * 1048576 + src_s AS a, tgt_c * 1048576 + tgt_s AS b FROM E WHERE {condition}),
both_ AS MATERIALIZED (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(a, b) AS (SELECT c_idx * 1048576 + s_idx, c_idx * 1048576 + s_idx FROM nodes UNION SELECT r.a, n.b FROM reach r JOIN both_ n ON n.a = r.b),
least_ AS MATERIALIZED (SELECT a, min(b) AS m FROM reach GROUP BY a)
"""


GROUPED = "SELECT a // 1048576 AS c_idx, a % 1048576 AS s_idx, m // 1048576 AS rep_c, m % 1048576 AS rep_s FROM least_"
# One comment's sentences, in an order in which the first of a level that isn't the asker's is the nearest.
ADDED = f"""
alone AS MATERIALIZED (SELECT n.* FROM N n WHERE NOT EXISTS (FROM K e WHERE (e.src_c = n.c_idx AND e.src_s = n.s_idx) OR (e.tgt_c = n.c_idx AND e.tgt_s = n.s_idx))),
new AS (
  SELECT c_idx AS src_c, s_idx AS src_s, c_idx AS tgt_c, 0::BIGINT AS tgt_s FROM alone WHERE s_idx > 0
  UNION ALL
  SELECT src_c, src_s, b.c, b.s FROM (
    SELECT a.c_idx AS src_c, a.s_idx AS src_s, arg_min(struct_pack(c := o.c_idx, s := o.s_idx), struct_pack(d := abs(a.w - o.w), c := o.c_idx, s := o.s_idx)) AS b
    FROM alone a JOIN N o ON o.c_idx <> a.c_idx WHERE a.s_idx = 0 GROUP BY ALL)
)"""

URLS = """(SELECT page_id, (['https://www.sueddeutsche.de/', 'zeit.de/', 'https://www.welt.de/', 'welt.de/', 'https://m.faz.net/', 'http://www.spiegel.de/', 'https://taz.de/', 'https://www.tagesschau.de/', 'https://example.org/'])[page_id % 9 + 1]
  || page_id || CASE WHEN page_id % 2 = 0 THEN '?a=1#c#d' ELSE '' END AS url FROM pages)"""
PLATFORM = r"""CASE WHEN regexp_matches(url, '^(https?://)?(www\.)?sueddeutsche\.de/') THEN 'SueddeutscheScraper' WHEN regexp_matches(url, '^(https?://)?(www\.)?zeit\.de/') THEN 'ZONScraper'
  WHEN regexp_matches(url, '^https?://(www\.)?welt\.de/') THEN 'WeltScraper' WHEN regexp_matches(url, '^(https?://)?(www\.)?tagesschau\.de/') THEN 'TagesschauScraper'
  WHEN regexp_matches(url, '^(https?://)?(www\.)?(m\.)?faz\.net/') THEN 'FAZScraper' WHEN regexp_matches(url, '^(https?://)?(www\.)?spiegel\.de/') THEN 'SPONScraper'
  WHEN regexp_matches(url, '^(https?://)?(www\.)?taz\.de/') THEN 'TAZScraper' END"""


def words(source: str, key: str) -> str:
    return f"(SELECT {key} AS doc, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '[^a-zа-яё0-9\\-'']+'), lambda t: t <> '')) AS token FROM {source})"


def bins(table: str, width: int) -> str:
    """(id, bin) of a table with id and micros."""
    return f"(SELECT id, floor((micros - min(micros) OVER ()) / (max(micros) OVER () - min(micros) OVER ())::DOUBLE * {width // 5} + 0.5)::BIGINT AS bin FROM {table})"


POLYGON = [(10.0, 10.0), (80.0, 20.0), (60.0, 90.0), (20.0, 70.0)]
INSIDE = " + ".join(f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < ({x2 - x1}) * (y - {y1}) / ({y2 - y1}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True))
LASSO = f"(SELECT id, bool_or(({INSIDE}) % 2 = 1) AS selected FROM (SELECT id, (c_idx * 37 % 100)::DOUBLE AS x, ((s_idx * 53 + c_idx) % 100)::DOUBLE AS y FROM nodes) GROUP BY id)"
CAST = "(SELECT 1 AS vote_id, id, s_idx, 1 AS vote FROM nodes WHERE (id + s_idx) % 3 = 0 UNION ALL SELECT 2, id, s_idx, -1 FROM nodes WHERE (id * 7 + s_idx) % 4 = 0)"
TOTALS = f"(SELECT *, min(votes) OVER () AS least, max(votes) OVER () AS most FROM (SELECT id, sum(vote)::BIGINT AS votes FROM (SELECT DISTINCT vote_id, id, vote FROM {CAST}) GROUP BY id))"


STRIPPED = r"regexp_replace(regexp_replace(text, '^[\s\x0b\x1c-\x1f\x85\xa0]+', ''), '[\s\x0b\x1c-\x1f\x85\xa0]+$', '')"
INGEST_TURNS = f"""WITH t AS (
  SELECT conv_id, turn, role, text, {STRIPPED} AS stripped, lpad((turn % 60)::VARCHAR, 2, '0') AS minute, 'c' || turn AS comment_id,
    row_number() OVER w - 1 AS k, lag(turn) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)"""
ANSWERS = "CASE WHEN k % 2 = 1 THEN 'c' || before END AS reply_to"
AT = "epoch(('{day} {hour}:' || minute || ':00')::TIMESTAMP)::BIGINT AS at"
INGEST = {
    # Threads come from the last one back, each with its answer behind it.
    "ingest_taz": f"""{INGEST_TURNS} SELECT 'https://taz.de/a/' || conv_id AS url, comment_id, {STRIPPED.replace('text', 'role')} AS username, '/u/' || role AS user_id, {AT.format(day='2024-01-01', hour='09')},
      stripped AS text, {ANSWERS}, (row_number() OVER (PARTITION BY conv_id ORDER BY k // 2 DESC, k) - 1)::BIGINT AS place FROM t""",
    "ingest_faz": f"""{INGEST_TURNS} SELECT 'https://www.faz.net/a/' || conv_id AS url, comment_id, role AS username, 'u' || turn AS user_id, {AT.format(day='2024-03-02', hour='11')},
      'T' || turn || ' ' || text AS text, {ANSWERS}, turn * 3 AS recommended, k AS place FROM t""",
    "ingest_zeit": f"""{INGEST_TURNS} SELECT 'https://www.zeit.de/a/' || conv_id AS url, comment_id, role AS username, CASE WHEN role = 'user' THEN '/p/' || role END AS user_id,
      {AT.format(day='2024-03-07', hour='09')}, stripped || chr(10) || chr(10) || 'end' AS text, {ANSWERS}, turn % 4 AS leseempfehlungen, k AS place FROM t""",
    "ingest_tagesschau": f"""{INGEST_TURNS} SELECT 'https://www.tagesschau.de/a/' || conv_id AS url, comment_id, role AS username, {AT.format(day='2023-12-24', hour='18')},
      stripped AS text, 'Title ' || turn AS title, k // 2 AS place FROM t WHERE k % 2 = 0""",
    "ingest_spiegel": f"""{INGEST_TURNS} SELECT conv_id::VARCHAR AS url, 'n' || turn AS comment_id, role AS username, epoch_ms(('2024-01-01 08:' || minute || ':30.5')::TIMESTAMP) AS at, text,
      'n' || before AS reply_to, turn AS upvotes, 0::BIGINT AS love, k + 2 AS depth FROM t WHERE turn % 5 <> 4""",
    "ingest_spiegel_paged": """SELECT conv_id::VARCHAR AS url, 'n' || turn AS comment_id, role AS username, text, turn // 2 AS page,
      row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) - 1 AS place FROM conversations""",
    "ingest_disqus": r"""SELECT conv_id::VARCHAR AS url, 'd' || turn AS comment_id, role AS username, epoch(('2024-01-0' || (1 + turn % 9) || ' 10:00:00')::TIMESTAMP)::BIGINT AS at,
      regexp_replace(regexp_replace(text || ' end', '[ \t\n\x0b\f\r]+', ' ', 'g'), ' +', ' ', 'g') AS text, CASE WHEN turn > 0 THEN 'd' || (turn - 1) END AS reply_to FROM conversations""",
    "ingest_articles": """WITH h AS (SELECT * FROM (VALUES
        (0, 'www.sueddeutsche.de', 'SueddeutscheScraper'), (1, 'www.zeit.de', 'ZONScraper'), (2, 'www.welt.de', 'WeltScraper'), (3, 'www.tagesschau.de', 'TagesschauScraper'),
        (4, 'www.faz.net', 'FAZScraper'), (5, 'www.spiegel.de', 'SPONScraper'), (6, 'taz.de', 'TAZScraper')) v(k, host, scraper))
      SELECT 'https://' || host || '/' || page_id AS url,
        CASE k WHEN 0 THEN 'Over Title ' || page_id WHEN 4 THEN 'Over - Title ' || page_id WHEN 5 THEN 'Title ' || page_id || ' - Over' ELSE 'Title ' || page_id END AS title,
        CASE WHEN k = 3 THEN 'Over' END AS subtitle, 'Sum' AS summary, CASE WHEN k = 1 THEN 'Ann, Bo' ELSE 'Ann' END AS author,
        CASE WHEN k = 0 THEN 'a b part ' || page_id ELSE 'a b' || chr(10) || chr(10) || 'part ' || page_id END AS text,
        epoch(('2024-02-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0') || ' 10:00:00')::TIMESTAMP)::BIGINT AS at, scraper, NULL::VARCHAR AS problem
      FROM pages JOIN h ON page_id % 7 = k""",
    "example_stories": """WITH a AS (SELECT DISTINCT conv_id AS id, 'https://www.zeit.de/a/' || conv_id AS url FROM conversations)
      SELECT (id % 40)::VARCHAR AS title, string_agg(url || '=' || CASE WHEN id % 3 <> 1 THEN id::VARCHAR ELSE '-' END, ';' ORDER BY url) AS sources FROM a GROUP BY 1""",
    "text_vectors": rf"""WITH {RAW}, w AS (SELECT c_idx, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS word FROM comments),
      k AS (SELECT DISTINCT word, (length(word) * 31 + ascii(word)) % 500 AS vec_id FROM w WHERE length(word) % 5 <> 4),
      e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
      m AS (SELECT c_idx, {', '.join(f'avg(v[{i + 1}] / l) AS m{i}' for i in (0, 1, 31, 63))} FROM w JOIN k USING (word) JOIN e USING (vec_id) WHERE l > 0 GROUP BY c_idx)
      SELECT c_idx, {', '.join(f'round(coalesce(m{i}, 0), 5) AS v{i}' for i in (0, 1, 31, 63))} FROM comments LEFT JOIN m USING (c_idx)""",
    "preprocess_text": r"""WITH t AS (SELECT conv_id, turn, list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]'),
        lambda x: regexp_full_match(x, '[\p{L}\p{M}]+') AND lower(x) NOT IN ('the', 'und', 'de', 'of')), lambda x: lower(x)) AS l FROM conversations)
      SELECT conv_id, turn, len(l)::BIGINT AS n, md5(array_to_string(l, ' ')) AS h FROM t""",
}


def modularity(kind: str, generator: str) -> str:
    """Greedy modularity over the edges of a kind, a join of two communities at each step; numbered by size, then by first node."""
    return f"""{graph(generator)}, K AS MATERIALIZED (
      SELECT DISTINCT least(src_c * 1048576 + src_s, tgt_c * 1048576 + tgt_s) AS a, greatest(src_c * 1048576 + src_s, tgt_c * 1048576 + tgt_s) AS b FROM E WHERE {kind} <> 0
    ), M AS MATERIALIZED (SELECT count(*) AS m FROM K),
    G AS MATERIALIZED (SELECT node, count(*) AS d FROM (SELECT a AS node FROM K UNION ALL SELECT b FROM K) GROUP BY node),
    s(step, node, d, label) AS (
      SELECT 0, node, d, node FROM G
      UNION ALL
      (WITH own AS (SELECT label, sum(d) AS d FROM s GROUP BY label),
       near AS (SELECT least(x.label, y.label) AS v, greatest(x.label, y.label) AS w, count(*) AS c FROM K JOIN s x ON x.node = a JOIN s y ON y.node = b WHERE x.label <> y.label GROUP BY ALL),
       best AS (SELECT v, w FROM near JOIN own p ON p.label = v JOIN own q ON q.label = w, M WHERE 2 * m * c > p.d * q.d ORDER BY 2 * m * c - p.d * q.d DESC, v, w LIMIT 1)
       SELECT step + 1, node, d, CASE WHEN label = w THEN v ELSE label END FROM s, best)
    ), last AS (SELECT node, label FROM s WHERE step = (SELECT max(step) FROM s)),
    every AS (SELECT c_idx, s_idx, coalesce(label, c_idx * 1048576 + s_idx) AS label FROM nodes LEFT JOIN last ON node = c_idx * 1048576 + s_idx),
    named AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS id FROM every GROUP BY label)
    SELECT c_idx, s_idx, id::DOUBLE AS CLUSTER_ID FROM every JOIN named USING (label)"""


def first_cut(kind: str, generator: str) -> str:
    """The first split by betweenness of a graph whose edges lead from a node to later ones, each with one such edge: a forest, in
    which an edge lies on as many shortest paths as its two sides have pairs, so the first one removed splits its tree."""
    return f"""{graph(generator)}, K AS MATERIALIZED (SELECT src_c * 1048576 + src_s AS a, tgt_c * 1048576 + tgt_s AS b FROM E WHERE {kind} <> 0),
    up(node, top) AS (SELECT b, a FROM K UNION ALL SELECT node, a FROM up JOIN K ON b = top),
    named AS MATERIALIZED (SELECT c_idx, s_idx, key, coalesce(min(top), key) AS root FROM (SELECT c_idx, s_idx, c_idx * 1048576 + s_idx AS key FROM nodes) LEFT JOIN up ON node = key GROUP BY c_idx, s_idx, key),
    total AS (SELECT root, count(*) AS n FROM named GROUP BY root), below AS (SELECT top, 1 + count(*) AS n FROM up GROUP BY top),
    cut AS (SELECT b FROM K JOIN named ON key = b JOIN total t USING (root) LEFT JOIN below w ON w.top = b ORDER BY coalesce(w.n, 1) * (t.n - coalesce(w.n, 1)) DESC, a, b LIMIT 1),
    sides AS (SELECT c_idx, s_idx, CASE WHEN key IN (FROM cut) OR key IN (SELECT node FROM up WHERE top IN (FROM cut)) THEN (FROM cut) ELSE root END AS side FROM named)
    SELECT c_idx, s_idx, (dense_rank() OVER (ORDER BY side) - 1)::DOUBLE AS CLUSTER_ID FROM sides"""


def labels(condition: str) -> str:
    """Connected components of groups of any size, by the least label among neighbours until none changes: CTE ``labelled`` (v, m)."""
    return f"""
near AS MATERIALIZED (SELECT src_c * 1048576 + src_s AS a, tgt_c * 1048576 + tgt_s AS b FROM E WHERE {condition}),
lab(k, v, m, moved) AS (
  SELECT 0, c_idx * 1048576 + s_idx, c_idx * 1048576 + s_idx, true FROM nodes
  UNION ALL
  (WITH least_near AS (SELECT v, min(m) AS m FROM (SELECT a AS v, l.m FROM near JOIN lab l ON l.v = b UNION ALL SELECT b, l.m FROM near JOIN lab l ON l.v = a) GROUP BY v)
   SELECT k + 1, l.v, least(l.m, n.m), coalesce(n.m < l.m, false) FROM lab l LEFT JOIN least_near n ON n.v = l.v WHERE (SELECT bool_or(moved) FROM lab))
),
labelled AS MATERIALIZED (SELECT v, m FROM lab WHERE k = (SELECT max(k) FROM lab))
"""


LABELLED = "SELECT v // 1048576 AS c_idx, v % 1048576 AS s_idx, m // 1048576 AS rep_c, m % 1048576 AS rep_s FROM labelled"
ALL_SENTENCES = EDGES["SIMILARITY"].replace(" AND a.s_idx = 0 AND b.s_idx = 0", "")
ALL_OF_COMMENT = EDGES["SAME_COMMENT"].replace("a.s_idx + 1 = b.s_idx", "a.s_idx < b.s_idx")


def config_sweep() -> str:
    """The benchmark's configurations, each after its own definition; generators and ranks are worked out once for each part."""
    from .plans.config import MODIFIERS, resolve
    from .plans.sweeps import TYPES as KINDS
    from .plans.sweeps import sweeps

    prefix = {name: name[:-10] for name in ("SameCommentComparator", "SameArticleComparator", "ReplyToComparator", "TemporalComparator", "SimilarityComparator")}
    short = {"SameComment": "SC", "SameArticle": "SA", "ReplyTo": "RT", "Temporal": "T", "Similarity": "S"}
    parts: dict[str, list[str]] = {}
    alone = []
    for k, (label, overrides) in enumerate(sweeps()):
        own = {name: settings for name, settings in resolve(overrides).items() if settings is not None}
        generator = next(name for name in own if name in prefix)
        kind = KINDS[short[prefix[generator]]]
        edges = graph(kind)
        if kind == "SIMILARITY":
            edges = edges.replace(EDGES[kind], ALL_SENTENCES)
        if own[generator].get("only_consecutive") is False:
            edges = edges.replace(EDGES[kind], ALL_OF_COMMENT)
        steps = [(name, settings) for name, settings in own.items() if name in MODIFIERS]
        row = f"{k}::BIGINT AS config_id, '{label}' AS description"
        name, settings = steps[-1]
        if name.endswith("Merger"):
            alone.append(f"{edges}, {labels(f'{kind} >= ' + str(settings['threshold']))} SELECT {row}, (SELECT count(*) FROM E) AS kept, (SELECT count(*) FROM E) AS n, (SELECT count(DISTINCT m) FROM labelled) AS groups")
        elif name.endswith("Clusterer") and settings["algorithm"] == "gmc":
            alone.append(f"{edges} SELECT {row}, (SELECT count(*) FROM E) AS kept, (SELECT count(*) FROM E) AS n, (SELECT count(DISTINCT CLUSTER_ID) FROM ({modularity(kind, kind)})) AS groups")
        elif name.endswith("Clusterer"):  # the first split makes one more of the components
            alone.append(f"{edges}, {labels(f'{kind} <> 0')} SELECT {row}, (SELECT count(*) FROM E) AS kept, (SELECT count(*) FROM E) AS n, (SELECT count(DISTINCT m) + 1 FROM labelled) AS groups")
        else:
            ranker, by = steps[0]
            more, ranked = "", ""
            if ranker == "PageRanker":
                more, ranked = "," + pagerank(kind, by["num_iterations"], 12, 1e-6, by["d"]), "(SELECT c_idx, s_idx, pr AS w FROM ranks)"
            elif ranker == "RecencyRanker" and by["use_yongest"]:
                ranked = "(SELECT c_idx, s_idx, ((SELECT max(micros) FROM comments) - micros) / 1e6 AS w FROM nodes JOIN comments USING (c_idx))"
            else:
                ranked = node_weights({"CentralityDegreeCalculator": "DEGREE_CENTRALITY", "ToxicityRanker": "TOXICITY", "VotesRanker": "VOTES", "SizeRanker": "SIZE", "RecencyRanker": "RECENCY"}[ranker], "")[1]
            if name.endswith("BottomFilter"):
                chosen = f"(SELECT c_idx, s_idx FROM N ORDER BY w {'DESC' if settings['descending_order'] else 'ASC'}, c_idx, s_idx LIMIT {settings['top_k']})"
            else:
                chosen = f"(SELECT c_idx, s_idx FROM N WHERE w {'<=' if settings['smaller_as'] else '>='} {settings['threshold']})"
            glue = "AND" if settings["strict"] or not name.endswith("BottomFilter") else "OR"
            kept = f"(SELECT count(*) FROM E WHERE (src_c, src_s) IN {chosen} {glue} (tgt_c, tgt_s) IN {chosen})"
            parts.setdefault(f"{edges}{more}, N AS MATERIALIZED (FROM {ranked})", []).append(f"SELECT {row}, {kept} AS kept, (SELECT count(*) FROM E) AS n, NULL::BIGINT AS groups")
    blocks = [f"SELECT * FROM ({start} {' UNION ALL '.join(rows)})" for start, rows in parts.items()] + [f"SELECT * FROM ({one})" for one in alone]
    return f"SELECT config_id, description, kept AS remaining_edges, n - kept AS removed_edges, groups FROM ({' UNION ALL '.join(blocks)})"


def oracle_sql() -> dict[str, str]:
    w = f"WITH {NODES}"
    o: dict[str, str] = {}
    o["sc_sb_top50"] = f"{CHAINS}, top AS (SELECT c_idx, s_idx FROM nodes ORDER BY e - s DESC, c_idx, s_idx LIMIT 50) SELECT {ENDS}, SAME_COMMENT FROM E WHERE (src_c, src_s) IN (FROM top) OR (tgt_c, tgt_s) IN (FROM top)"
    o["sentence_split"] = f"WITH {sentences('documents', 'doc_id')} SELECT k AS doc_id, nth AS k, sentence FROM seg"
    o["split_spans"] = f"{w} SELECT c_idx, s_idx, s, e FROM nodes"
    o["split_spans_documents"] = f"WITH {sentences('documents', 'doc_id')} SELECT k AS doc_id, s_idx, s, s + length(sentence) AS e FROM spans"
    o["split_text"] = f"{w} SELECT c_idx, s_idx, substr(text, (s + 1)::INT, (e - s)::INT) AS cut FROM nodes JOIN comments USING (c_idx)"
    o["ui_split_text"] = f"{w} SELECT c_idx, s_idx, substr(text, (s + 1)::INT, e::INT) AS cut FROM nodes JOIN comments USING (c_idx)"
    normal = """regexp_replace(regexp_replace(text, '([''".()!?\\-\\\\/,])', ' \\1 ', 'g'), '[;:|\\n]', ' ', 'g')"""
    o["normalize_text"] = f"SELECT doc_id, md5({normal}) AS h FROM documents"
    o["token_window"] = f"SELECT doc_id, CASE WHEN len(l) >= 20 THEN array_to_string(l[-20:], ' ') ELSE array_to_string(l || [('') FOR i IN range(20 - len(l))], ' ') END AS last FROM (SELECT doc_id, list_filter(regexp_split_to_array({normal}, '[ \\t\\n\\x0b\\f\\r]+'), lambda t: t <> '') AS l FROM documents)"
    o["reply_resolve"] = f"WITH {RAW} SELECT id, article_id, reply_to, reply_to_id FROM comments"
    o["article_nest"] = f"WITH {RAW} SELECT article_id AS id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM raw GROUP BY article_id"
    o["article_lookup"] = """WITH a AS (SELECT DISTINCT conv_id AS id, 'https://www.zeit.de/a/' || conv_id AS url FROM conversations)
      SELECT url, id FROM a UNION ALL SELECT url || '/x', NULL FROM a"""
    o |= INGEST
    for name in ("reply_to", "same_article", "same_comment"):
        o[f"cluster_{name}_gmc"] = modularity(SHORT[name], SHORT[name])
    for name in ("reply_to", "same_comment"):
        o[f"cluster_{name}_gn"] = first_cut(SHORT[name], SHORT[name])
    o["cluster_same_group_gn"] = first_cut("SAME_GROUP", "SAME_COMMENT")
    o["cluster_same_group_gmc"] = modularity("SAME_GROUP", "SAME_COMMENT")  # no generator makes such edges
    o["merge_ids_reply_to"] = f"""{graph('REPLY_TO')}, K AS MATERIALIZED (
      SELECT src_c * 1048576 + src_s AS a, tgt_c * 1048576 + tgt_s AS b, row_number() OVER (ORDER BY {ENDS}) AS rn FROM E WHERE REPLY_TO >= 0.5
    ), s(step, node, cl, following) AS (
      SELECT 0, node, NULL::BIGINT, 0::BIGINT FROM (SELECT a AS node FROM K UNION SELECT b FROM K)
      UNION ALL
      (WITH e AS (SELECT a, b, x.cl AS x, y.cl AS y FROM K JOIN s x ON x.node = a AND rn = x.step + 1 JOIN s y ON y.node = b)
       SELECT step + 1, node, CASE WHEN x IS NULL AND y IS NULL AND node IN (a, b) THEN following WHEN x IS NULL AND node = a THEN y WHEN y IS NULL AND node = b THEN x WHEN x <> y AND cl = y THEN x ELSE cl END,
         following + (x IS NULL AND y IS NULL)::INT FROM s, e)
    ), last AS (SELECT node, cl FROM s WHERE step = (SELECT max(step) FROM s))
    SELECT c_idx, s_idx, coalesce(cl, -row_number() OVER (PARTITION BY cl IS NULL ORDER BY c_idx, s_idx))::DOUBLE AS MERGE_ID FROM nodes LEFT JOIN last ON node = c_idx * 1048576 + s_idx"""
    o["scraper_dispatch"] = f"SELECT page_id, {PLATFORM} AS platform FROM {URLS}"
    o["url_normalize"] = f"SELECT page_id, CASE {PLATFORM} WHEN 'WeltScraper' THEN split_part(url, '#', 1) WHEN 'FAZScraper' THEN replace(split_part(url, '#', 1), 'https://m.', 'https://') ELSE CASE WHEN {PLATFORM} IS NOT NULL THEN url END END AS prepared FROM {URLS}"
    o["ingest_welt"] = """
      WITH r AS (SELECT conv_id::VARCHAR AS url, turn AS page, 'w' || turn % 5 AS comment_id, role AS username, text, length(text) AS likes, epoch_us(('2024-01-0' || (1 + turn % 9) || ' 10:00:00')::TIMESTAMP) AS micros FROM conversations)
      SELECT url, comment_id, arg_max(username, page) AS username, arg_max(text, page) AS text, arg_max(likes, page) AS likes, arg_max(micros, page) AS micros, min(page) AS page FROM r GROUP BY url, comment_id"""
    o["backfill_urls"] = "SELECT trim(url) AS url FROM pages WHERE page_id % 3 <> 0"
    o["delete_article"] = f"""WITH {RAW}, a AS (SELECT DISTINCT conv_id AS id FROM conversations), gone AS (SELECT conv_id AS id FROM conversations GROUP BY conv_id HAVING count(*) > 6)
      SELECT 'article' AS kind, id FROM a WHERE id NOT IN (FROM gone) UNION ALL SELECT 'comment', id FROM raw WHERE article_id NOT IN (FROM gone)
      UNION ALL SELECT 'graph', id FROM a WHERE id NOT IN (FROM gone) AND id + 1 NOT IN (FROM gone)"""
    long_ = "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 6"
    urls = "SELECT DISTINCT conv_id AS id, 'https://www.zeit.de/a/' || conv_id AS url FROM conversations"
    o["store_versions"] = f"""WITH {RAW}, a AS ({urls}), gone AS ({long_}),
      rows_ AS (
        SELECT 'articles' AS kind, id, length(url) AS chars, id % 3 + 1 AS since, id IN (FROM gone) AS goes FROM a
        UNION ALL SELECT 'comments', id, length(text), article_id % 3 + 1, article_id IN (FROM gone) FROM raw
        UNION ALL SELECT 'graphs', id, length('[' || id || ', ' || (id + 1) || ']'), 4, id IN (FROM gone) OR id + 1 IN (FROM gone) FROM a
      )
      SELECT v.version::BIGINT AS version, k.kind, count(id) AS n, sum(id)::BIGINT AS ids, sum(chars)::BIGINT AS chars
      FROM range(1, 6) v(version) CROSS JOIN (VALUES ('articles'), ('comments'), ('graphs')) k(kind)
      LEFT JOIN rows_ r ON r.kind = k.kind AND r.since <= v.version AND NOT (r.goes AND v.version = 5) GROUP BY ALL"""
    o["graph_lookup"] = f"WITH a AS ({urls}), gone AS ({long_}) SELECT id AS first_id, CASE WHEN id NOT IN (FROM gone) AND id + 1 NOT IN (FROM gone) THEN id END AS graph_id FROM a"
    o["graph_cache"] = f"{STRUCTURAL} SELECT {PLAIN}, 'before' AS stored FROM E UNION ALL SELECT {PLAIN}, 'after' FROM E WHERE REPLY_TO IS NOT NULL"
    o["article_cache"] = f"""WITH {RAW}, a AS ({urls}), k AS (SELECT url, CASE WHEN url = (SELECT min(url) FROM a) THEN 1000000 ELSE 0 END AS shift, id FROM a)
      SELECT url, article_id + shift AS article_id, raw.id + shift AS id, md5(text) AS h FROM raw JOIN k ON k.id = article_id"""
    o["graph_document"] = graph_document_sql()
    o["embedding_cosine"] = f"WITH {VECTORS} SELECT a.c_idx AS vec_id, round(CASE WHEN a.n = 0 AND b.n = 0 THEN 1 WHEN a.n = 0 OR b.n = 0 THEN 0 ELSE list_dot_product(a.e, b.e) / (a.n * b.n) END, 6) AS cos FROM v a JOIN v b ON b.c_idx = a.c_idx + 1"
    o["edges_similarity"] = f"WITH {RAW}, {COSINES} SELECT c_a, c_b, round((1 - cos) / 0.25 * 0.1, 6) AS weight FROM cosines WHERE cos < 0.75"
    o["edges_same_comment"] = f"{w} SELECT {ENDS}, w AS SAME_COMMENT FROM ({EDGES['SAME_COMMENT']})"
    o["edges_same_comment_all"] = f"{w} SELECT {PAIR}, 1.0::DOUBLE AS SAME_COMMENT FROM nodes a JOIN nodes b ON a.c_idx = b.c_idx AND a.s_idx < b.s_idx"
    o["edges_same_article"] = f"{w} SELECT {ENDS}, w AS SAME_ARTICLE FROM ({EDGES['SAME_ARTICLE']})"
    o["edges_same_article_all"] = f"{w} SELECT src_c, tgt_c, count(*) AS n, sum(src_s * 1000 + tgt_s)::BIGINT AS places FROM (SELECT {PAIR} FROM nodes a JOIN nodes b ON a.article_id = b.article_id AND (a.c_idx, a.s_idx) < (b.c_idx, b.s_idx)) GROUP BY ALL"
    o["edges_reply_to"] = f"{w} SELECT {ENDS}, w AS REPLY_TO FROM ({EDGES['REPLY_TO']})"
    o["edges_reply_to_all"] = f"{w} SELECT {ENDS}, w AS REPLY_TO FROM ({EDGES['REPLY_TO'].replace('WHERE a.s_idx = 0 AND b.s_idx = 0', '')})"
    o["edges_temporal"] = f"{graph('TEMPORAL')} SELECT {DIGEST} FROM E GROUP BY src_c, tgt_c"
    o["edges_assembled"] = f"{FOUR} SELECT {DIGEST} FROM E GROUP BY src_c, tgt_c"
    for name, column in (("rank_size", "(e - s)::DOUBLE"), ("rank_votes", f"({VOTES} + coalesce(downvotes, 0))::DOUBLE"), ("rank_votes_up_only", f"({VOTES})::DOUBLE"), ("rank_recency", "round((micros - min(micros) OVER ()) / 1e6, 6)"), ("rank_recency_youngest", "round((max(micros) OVER () - micros) / 1e6, 6)")):
        source = "nodes JOIN comments USING (c_idx)" if "recency" not in name else "nodes JOIN (SELECT c_idx, " + column + " AS r FROM comments) USING (c_idx)"
        o[name] = f"{w} SELECT c_idx, s_idx, {'r' if 'recency' in name else column} AS weight FROM {source}"
    o["rank_degree"] = f"{FOUR} SELECT c_idx, s_idx, w AS weight FROM {node_weights('DEGREE_CENTRALITY', '')[1]}"
    o["rank_toxicity_stub"] = f"{w} SELECT c_idx, s_idx, round({toxicity('text')}, 6) AS weight FROM nodes JOIN comments USING (c_idx)"
    o["rank_toxicity_split"] = f"{w} SELECT c_idx, s_idx, round({toxicity('substr(text, (s + 1)::INT, (e - s)::INT)')}, 6) AS weight FROM nodes JOIN comments USING (c_idx)"
    o["rank_pagerank"] = f"{FOUR}, {pagerank('TEMPORAL', 10, 9)} SELECT c_idx, s_idx, round(pr, 9) AS weight FROM ranks"
    o["rank_pagerank_same_comment"] = f"{CHAINS}, {pagerank('SAME_COMMENT', 10, 9)} SELECT c_idx, s_idx, round(pr, 9) AS weight FROM ranks"
    o["rank_pagerank_exact"] = f"{STRUCTURAL}, {pagerank('SAME_ARTICLE', 250, 9)} SELECT c_idx, s_idx, round(pr, 9) AS weight FROM ranks"
    bases = {"similarity": SIMILAR, "temporal": FOUR}
    for name, kind in SHORT.items():
        base = bases.get(name, STRUCTURAL)
        o[f"filter_edge_{name}"] = f"{base} SELECT {DIGEST} FROM E WHERE {kind} <> 0 AND {kind} >= {0.08 if name == 'similarity' else 0.5} GROUP BY src_c, tgt_c"
        o[f"bottom_edge_{name}"] = _edge_top(base, kind, "DESC")
        if name in ("reply_to", "same_comment", "same_article", "same_group"):
            o[f"merge_{name}"] = f"{base}, {groups(kind + ' >= 0.5')} {GROUPED}"
    o["filter_edge_temporal_smaller"] = f"{FOUR} SELECT {DIGEST} FROM E WHERE TEMPORAL <> 0 AND TEMPORAL <= 0.2 GROUP BY src_c, tgt_c"
    o["bottom_edge_temporal_ascending"] = _edge_top(FOUR, "TEMPORAL", "ASC")
    o["filter_edge_or"] = f"{FOUR} SELECT {DIGEST} FROM E WHERE REPLY_TO > 0.5 OR SAME_COMMENT > 0.5 OR (TEMPORAL > 0 AND TEMPORAL < 0.3) GROUP BY src_c, tgt_c"
    limits = {"size": ">= 60", "degree": ">= 3", "recency": ">= 20000", "votes": ">= 4", "toxicity": "<= 0.1", "pagerank": ">= 0.0003"}
    for name, kind in {"size": "SIZE", "degree": "DEGREE_CENTRALITY", "recency": "RECENCY", "votes": "VOTES", "toxicity": "TOXICITY", "pagerank": "PAGERANK"}.items():
        more, table = node_weights(kind, "")
        start = f"{STRUCTURAL}{more}, N AS MATERIALIZED (FROM {table})"
        o[f"filter_node_{name}"] = f"{start} SELECT {PLAIN} FROM E SEMI JOIN (SELECT c_idx AS src_c, s_idx AS src_s FROM N WHERE w {limits[name]}) USING (src_c, src_s) SEMI JOIN (SELECT c_idx AS tgt_c, s_idx AS tgt_s FROM N WHERE w {limits[name]}) USING (tgt_c, tgt_s)"
        for how, glue in (("strict", "AND"), ("any", "OR")):
            o[f"bottom_node_{name}_{how}"] = f"{start}, top AS MATERIALIZED (SELECT c_idx, s_idx FROM N ORDER BY w DESC, c_idx, s_idx LIMIT 200) SELECT {PLAIN} FROM E WHERE (src_c, src_s) IN (FROM top) {glue} (tgt_c, tgt_s) IN (FROM top)"
    o["bottom_node_size_ascending"] = o["bottom_node_size_any"].replace("w DESC", "w ASC")
    o["merge_temporal"] = f"{FOUR}, {labels('TEMPORAL >= 0.5')} {LABELLED}"
    every = graph("SIMILARITY").replace(EDGES["SIMILARITY"], ALL_SENTENCES)
    o["merge_similarity"] = f"{every}, {labels('SIMILARITY >= 0.11')} {LABELLED}"
    o["edges_similarity_all"] = f"{every} SELECT {DIGEST} FROM E GROUP BY src_c, tgt_c"
    o["filter_edge_similarity_all"] = f"{every} SELECT {DIGEST} FROM E WHERE SIMILARITY >= 0.08 GROUP BY src_c, tgt_c"
    o["bottom_edge_similarity_all"] = _edge_top(every, "SIMILARITY", "DESC")
    o["filter_edge_similarity"], o["bottom_edge_similarity"] = o["filter_edge_similarity_all"], o["bottom_edge_similarity_all"]
    o["config_sweep"] = config_sweep()
    o["merge_multi_or"] = f"{STRUCTURAL}, {groups('REPLY_TO >= 0.5 OR SAME_COMMENT >= 0.5')} {GROUPED}"
    o["merge_multi_and"] = f"{STRUCTURAL}, {groups('REPLY_TO >= 0.5 AND SAME_ARTICLE >= 0.5')} {GROUPED}"
    recency = node_weights("RECENCY", "")[1]
    o["add_single_edges"] = f"""{CHAINS}, N AS MATERIALIZED (FROM {recency}), Z AS (SELECT c_idx, s_idx FROM nodes WHERE e - s >= 60), K AS MATERIALIZED (SELECT * FROM E SEMI JOIN (SELECT c_idx AS src_c, s_idx AS src_s FROM Z) USING (src_c, src_s) SEMI JOIN (SELECT c_idx AS tgt_c, s_idx AS tgt_s FROM Z) USING (tgt_c, tgt_s)), {ADDED}
      SELECT {ENDS}, SAME_COMMENT AS same_comment, NULL::DOUBLE AS temporal FROM K UNION ALL SELECT {ENDS}, NULL, 0.1 FROM new"""
    default = f"""{FOUR}, {pagerank('TEMPORAL', 100, 9, 1e-6)}, N AS MATERIALIZED (FROM {recency}), voted AS MATERIALIZED (SELECT c_idx, s_idx FROM {node_weights('VOTES', '')[1]} WHERE w >= 2),
      top AS MATERIALIZED (SELECT c_idx, s_idx FROM ranks ORDER BY pr DESC, c_idx, s_idx LIMIT 200),
      K AS MATERIALIZED (SELECT * FROM E WHERE (src_c, src_s) IN (FROM voted) AND (tgt_c, tgt_s) IN (FROM voted) AND (src_c, src_s) IN (FROM top) AND (tgt_c, tgt_s) IN (FROM top))"""
    o["default_pipeline_edges"] = f"{default}, {ADDED} SELECT {PLAIN} FROM K UNION ALL SELECT {ENDS}, NULL, NULL, NULL, NULL, NULL, 0.1 FROM new"
    o["default_pipeline_nodes"] = f"""{default}, {groups('REPLY_TO >= 0.5').replace('FROM E WHERE', 'FROM K WHERE')}
      SELECT c_idx, s_idx, z.w AS SIZE, round(pr, 9) AS PAGERANK, d.w AS DEGREE_CENTRALITY, round(r.w, 6) AS RECENCY, v.w AS VOTES, rep_c, rep_s
      FROM {node_weights('SIZE', '')[1]} z JOIN ranks USING (c_idx, s_idx) JOIN {node_weights('DEGREE_CENTRALITY', '')[1]} d USING (c_idx, s_idx) JOIN N r USING (c_idx, s_idx)
      JOIN {node_weights('VOTES', '')[1]} v USING (c_idx, s_idx) JOIN ({GROUPED}) USING (c_idx, s_idx)"""
    o["search_tfidf"] = f"""WITH hits AS (SELECT doc, q.term, count(*) AS tf FROM {words('documents', 'doc_id')} JOIN (VALUES ('the'), ('that')) q(term) ON starts_with(token, q.term) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM hits GROUP BY term)
      SELECT doc AS doc_id, round(sum(tf * (1 + ln((SELECT count(*) FROM documents) / (1 + df)))), 6) AS score FROM hits JOIN df USING (term) GROUP BY doc HAVING count(*) = 2"""
    o["search_exact_index"] = f"SELECT token AS term, doc AS item_id, count(*) AS tf FROM {words('benchmark', 'item_id')} GROUP BY ALL"
    o["search_substrings"] = f"""WITH hits AS (SELECT doc, q.term, sum((length(token) - length(replace(token, q.term, ''))) // length(q.term)) AS tf FROM {words('benchmark', 'item_id')} JOIN (VALUES ('he'), ('nt')) q(term) ON contains(token, q.term) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM hits GROUP BY term)
      SELECT doc AS item_id, round(sum(tf * (1 + ln((SELECT count(*) FROM benchmark) / (1 + df)))), 6) AS score FROM hits JOIN df USING (term) GROUP BY doc HAVING count(*) = 2"""
    o["time_histogram"] = f"WITH {RAW} SELECT bin, count(*) AS n FROM {bins('comments', 400)} GROUP BY bin"
    o["event_histogram"] = f"SELECT bin, count(*) AS n FROM {bins('(SELECT event_id AS id, epoch_us(ts) AS micros FROM events)', 800)} GROUP BY bin"
    o["brush_range"] = f"WITH {RAW} SELECT id FROM {bins('comments', 400)} WHERE bin BETWEEN 10 AND 40"
    o["lasso_select"] = f"{w} FROM {LASSO}"
    o["visible_comments"] = f"{w}, t AS (SELECT id FROM {bins('comments', 400)} WHERE bin BETWEEN 10 AND 40), l AS (SELECT id FROM {LASSO} WHERE selected) SELECT id, id IN (FROM t) AS f_timeRange, id IN (FROM l) AS f_lasso, false AS f_search, id IN (FROM t) AND id IN (FROM l) AS visible FROM comments"
    o["visible_counter"] = f"SELECT count_if(visible)::BIGINT AS n_visible, count(*) AS n_total FROM ({o['visible_comments']})"
    o["vote_totals"] = f"{w} FROM {TOTALS}"
    o["vote_totals_split"] = f"{w} SELECT *, min(votes) OVER () AS least, max(votes) OVER () AS most FROM (SELECT id, s_idx, sum(vote)::BIGINT AS votes FROM {CAST} GROUP BY ALL)"
    o["vote_colour"] = f"{w} SELECT id, round(CASE WHEN least = 0 AND most = 0 THEN 0.5 ELSE (votes + abs(least)) / (abs(least) + most) END, 6) AS colour FROM {TOTALS}"
    o["cluster_rebucket"] = f"{w} SELECT c_idx, s_idx, CASE WHEN count(*) OVER (PARTITION BY article_id) < 20 THEN (c_idx * 31 + s_idx) % 15 + 4 ELSE article_id END::DOUBLE AS CLUSTER_ID FROM nodes"
    o["cluster_centroid"] = f"{STRUCTURAL} SELECT article_id::DOUBLE AS CLUSTER_ID, c_idx, s_idx FROM nodes JOIN {node_weights('DEGREE_CENTRALITY', '')[1]} USING (c_idx, s_idx) QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY w DESC, c_idx, s_idx) = 1"
    strength = " + ".join(f"coalesce({t}, 0)" for t in TYPES)
    o["link_strength"] = f"{STRUCTURAL} SELECT {ENDS}, round({strength}, 6) AS strength, 1.0::DOUBLE AS stroke FROM E"
    o["node_radius"] = f"{CHAINS}, {pagerank('SAME_COMMENT', 10, 9)} SELECT c_idx, s_idx, round(CASE WHEN c_idx % 2 = 0 THEN 100 ELSE 50 END * sqrt(pr), 5) AS radius FROM ranks"
    o["group_index"] = f"WITH {RAW} SELECT article_id % 7 AS grp_id, string_agg(id, ',' ORDER BY id) AS ids FROM comments GROUP BY 1"
    o["source_counts"] = "SELECT CASE WHEN conv_id % 2 = 0 THEN 'Zeit Online' ELSE 'TAZScraper' END AS label, count(DISTINCT conv_id) AS n_articles, count(*) AS n_comments FROM conversations GROUP BY 1"
    o["links_resolved"] = f"{STRUCTURAL} SELECT {ENDS}, a.id AS src_id, b.id AS tgt_id FROM E JOIN nodes a ON a.c_idx = src_c AND a.s_idx = src_s JOIN nodes b ON b.c_idx = tgt_c AND b.s_idx = tgt_s"
    o["chronological"] = f"WITH {RAW} SELECT id, micros FROM comments"
    return {name: textwrap.dedent(sql) for name, sql in o.items()}


def graph_document_sql(per_part: int = 100) -> str:
    return f"""{STRUCTURAL}, items AS (
        SELECT 'comments' AS kind, row_number() OVER (ORDER BY c_idx) - 1 AS place,
          '{{"c_idx":' || c_idx || ',"id":' || any_value(id) || ',"splits":[' || string_agg('{{"s_idx":' || s_idx || ',"s":' || s || ',"e":' || e || ',"wgts":{{}}}}', ',' ORDER BY s_idx) || ']}}' AS item
        FROM nodes GROUP BY c_idx
        UNION ALL SELECT 'edges', row_number() OVER (ORDER BY {ENDS}) - 1,
          '{{"ord":[' || concat_ws(',', {ENDS}) || '],"src":{{"src_c":' || src_c || ',"src_s":' || src_s || '}},"tgt":{{"tgt_c":' || tgt_c || ',"tgt_s":' || tgt_s
          || '}},"wgts":{{' || concat_ws(',', {', '.join(f"""'"{t}":' || {t}::DOUBLE""" for t in TYPES)}) || '}}}}' FROM E
      ), parts AS (
        SELECT kind, place // {per_part} AS part, CASE WHEN min(place) = 0 THEN '[' ELSE ',' END || string_agg(item, ',' ORDER BY place) AS json FROM items GROUP BY ALL
      ), closed AS (
        FROM parts UNION ALL SELECT k.kind, coalesce(max(part) + 1, 0), CASE WHEN count(part) = 0 THEN '[]' ELSE ']' END FROM (VALUES ('comments'), ('edges')) k(kind) LEFT JOIN parts p ON p.kind = k.kind GROUP BY k.kind
      )
      SELECT kind, part, coalesce(sum(strlen(json)) OVER (PARTITION BY kind ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, strlen(json) AS bytes, md5(json) AS h FROM closed"""


def _edge_top(base: str, kind: str, direction: str) -> str:
    return f"""{base}, ends AS (SELECT DISTINCT * FROM (SELECT *, src_c AS c, src_s AS s FROM E UNION ALL SELECT *, tgt_c, tgt_s FROM E)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY c, s ORDER BY coalesce({kind}, 0) {direction}, {ENDS}) AS rn FROM ends),
      picked AS (SELECT {ENDS}, min(struct_pack(c := c, s := s, rn := rn)) AS o FROM ranked WHERE rn <= 2 GROUP BY ALL)
      SELECT {ENDS}, o.c || ',' || o.s || ',' || o.rn AS ord FROM picked"""
