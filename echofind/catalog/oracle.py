"""The same results in SQL over the same tables, for checking."""

from __future__ import annotations

from echofind.functions.text import SPACE
from echofind.schemas import DIMENSION

DIST = "round(greatest(list_cosine_distance({a}, {b}), 0), 9)"


def _dist(a: str, b: str) -> str:
    return DIST.format(a=a, b=b)


def _decode(x: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def _service(x: str) -> str:
    return _collapse(f"regexp_replace({_decode(x)}, '<[^>]*>|https?://[^{SPACE}]+', ' ', 'g')")


def _pipeline(x: str) -> str:
    plain = f"regexp_replace({_decode(x)}, '<[^>]+>', ' ', 'g')"
    return _collapse(f"regexp_replace({plain}, 'https?://[^{SPACE}]+|www\\.[^{SPACE}]+', ' ', 'g')")


VECTORS = "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def _embedded(name: str, source: str, key: str, text: str, dim: int = DIMENSION) -> str:
    """CTEs that hash the words of ``text`` into ``name``(key, v)."""
    return f"""
{name}_words AS (
  SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}),
{name}_counts AS (
  SELECT {key}, w, count(*) AS n FROM {name}_words GROUP BY ALL),
{name}_slots AS (
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS b,
         sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN n ELSE -n END)::DOUBLE AS x
  FROM {name}_counts GROUP BY ALL),
{name}_norms AS (
  SELECT {key}, sqrt(sum(x * x)) AS norm FROM {name}_slots GROUP BY ALL),
{name}_all AS (
  SELECT k.{key}, d.b FROM (SELECT {key} FROM {source}) k, (SELECT range AS b FROM range({dim})) d),
{name} AS (
  SELECT a.{key}, list((CASE WHEN norm > 0 THEN coalesce(x, 0) / norm ELSE 0 END)::FLOAT::DOUBLE ORDER BY a.b) AS v
  FROM {name}_all a LEFT JOIN {name}_slots s ON a.{key} = s.{key} AND a.b = s.b
  LEFT JOIN {name}_norms n ON a.{key} = n.{key} GROUP BY a.{key})"""


DOCUMENTS = (
    f"cleaned AS (SELECT doc_id AS id, {_service('''text || '. ' ''')} AS cleaned_text, lang, source FROM documents),"
    f"recleaned AS (SELECT id, {_service('cleaned_text')} AS t FROM cleaned)," + _embedded("doc_vectors", "recleaned", "id", "t")
)


def _ivf(vectors: str, lists: int = 16, iterations: int = 2) -> str:
    """CTEs from ``vectors``(id, v) to centroids c{iterations}(list_id, c) and ``assigned``(id, list_id)."""
    sql = f"""
first_ids AS (SELECT id, v FROM {vectors} ORDER BY md5(id::VARCHAR), id LIMIT {lists * 8}),
seed_vectors AS (SELECT v, min(md5(id::VARCHAR) || id) AS o FROM first_ids GROUP BY v),
c0 AS (SELECT row_number() OVER (ORDER BY o) - 1 AS list_id, v AS c FROM seed_vectors ORDER BY o LIMIT {lists})"""
    for i in range(iterations):
        sql += f""",
a{i} AS (
  SELECT id, v, list_id FROM (SELECT id, v, list_id, row_number() OVER (PARTITION BY id ORDER BY {_dist('v', 'c')}, list_id) AS r
  FROM {vectors}, c{i}) WHERE r = 1),
e{i} AS (
  SELECT list_id, d, avg(x / norm) AS x FROM (
    SELECT list_id, unnest(v) AS x, generate_subscripts(v, 1) AS d, sqrt(list_dot_product(v, v)) AS norm FROM a{i})
  GROUP BY ALL),
m{i} AS (SELECT list_id, list(x ORDER BY d) AS c FROM e{i} GROUP BY list_id),
c{i + 1} AS (SELECT c{i}.list_id, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.list_id = m{i}.list_id)"""
    return (
        sql
        + f""",
ranked_lists AS (
  SELECT id, list_id, row_number() OVER (PARTITION BY id ORDER BY {_dist('v', 'c')}, list_id) AS list_rank
  FROM {vectors}, c{iterations}),
assigned AS (SELECT id, list_id FROM ranked_lists WHERE list_rank = 1)"""
    )


GROWN = f"""even AS (SELECT * FROM vectors WHERE id % 2 = 0), {_ivf('even')},
ranked_all AS (
  SELECT id, list_id, {_dist('v', 'c')} AS d, row_number() OVER (PARTITION BY id ORDER BY {_dist('v', 'c')}, list_id) AS list_rank
  FROM vectors, c2),
assigned_all AS (SELECT id, list_id, d FROM ranked_all WHERE list_rank = 1)"""
GROWN_PAIRS = f"""SELECT l.id AS query_id, a.id, {_dist('q.v', 'r.v')} AS d FROM ranked_all l
  JOIN assigned_all a ON l.list_id = a.list_id AND l.list_rank <= 4 AND l.id <> a.id
  JOIN vectors q ON q.id = l.id JOIN vectors r ON r.id = a.id"""


def _tree(vectors: str, lists: int = 4, width: int = 5, top_probes: int = 2, probes: int = 4) -> str:
    """CTEs of two-level lists: ``in_leaf``(id, list_id, leaf) and ``probed_leaves``(id, leaf)."""
    return f"""{_ivf(vectors, lists, 1)},
members AS (SELECT id, list_id, v FROM assigned JOIN {vectors} USING (id)),
leaf_seeds AS (SELECT list_id, v, min(md5(id::VARCHAR) || id) AS o FROM members WHERE list_dot_product(v, v) > 0 GROUP BY list_id, v),
leaf_0 AS (
  SELECT list_id, list_id * {width} + i AS leaf, v AS c FROM
  (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY o) - 1 AS i FROM leaf_seeds) WHERE i < {width}),
joined_0 AS (
  SELECT id, v, leaf FROM (SELECT id, v, leaf, row_number() OVER (PARTITION BY id ORDER BY {_dist('v', 'c')}, leaf) AS r
  FROM members JOIN leaf_0 USING (list_id)) WHERE r = 1),
leaf_sums AS (
  SELECT leaf, d, avg(x / norm) AS x FROM (
    SELECT leaf, unnest(v) AS x, generate_subscripts(v, 1) AS d, sqrt(list_dot_product(v, v)) AS norm FROM joined_0) GROUP BY ALL),
leaf_means AS (SELECT leaf, list(x ORDER BY d) AS c FROM leaf_sums GROUP BY leaf),
leaves AS (SELECT l.list_id, l.leaf, coalesce(m.c, l.c) AS c FROM leaf_0 l LEFT JOIN leaf_means m ON m.leaf = l.leaf),
in_leaf AS (
  SELECT id, list_id, leaf FROM (SELECT id, list_id, leaf, row_number() OVER (PARTITION BY id ORDER BY {_dist('v', 'c')}, leaf) AS r
  FROM members JOIN leaves USING (list_id)) WHERE r = 1),
probed_leaves AS (
  SELECT id, leaf FROM (SELECT k.id, l.leaf, row_number() OVER (PARTITION BY k.id ORDER BY {_dist('q.v', 'l.c')}, l.leaf) AS r
  FROM ranked_lists k JOIN leaves l ON l.list_id = k.list_id AND k.list_rank <= {top_probes} JOIN {vectors} q ON q.id = k.id) WHERE r <= {probes})"""


TREE_PAIRS = f"""SELECT p.id AS query_id, a.id, {_dist('q.v', 'r.v')} AS d FROM probed_leaves p JOIN in_leaf a ON a.leaf = p.leaf AND a.id <> p.id
  JOIN vectors q ON q.id = p.id JOIN vectors r ON r.id = a.id"""


def _graph(degree: int = 8, rounds: int = 2, shortcuts: int = 4) -> str:
    """CTEs of the neighbour graph of ``vectors``: graph_nodes(id, v, place) and ``graph``(v, u)."""

    def nearest(pairs: str) -> str:
        return f"""(SELECT a, b, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM (
      SELECT p.a, p.b, {_dist('x.v', 'y.v')} AS d FROM ({pairs}) p JOIN graph_nodes x ON x.id = p.a JOIN graph_nodes y ON y.id = p.b)) WHERE r <= {degree})"""

    def both_ways(edges: str) -> str:
        return f"""SELECT a AS v, b AS u FROM {edges} UNION SELECT b, a FROM (
      SELECT *, row_number() OVER (PARTITION BY b ORDER BY d, a) AS r FROM {edges}) WHERE r <= {degree}"""

    first = f"""SELECT DISTINCT x.id AS a, y.id AS b FROM graph_nodes x, range({degree}) s(j), graph_nodes y
      WHERE y.place = (x.place + (1 << j)) % (SELECT count(*) FROM graph_nodes) AND x.id <> y.id"""
    sql = f"""
graph_nodes AS MATERIALIZED (
  SELECT id, v, row_number() OVER (ORDER BY md5(id::VARCHAR), id) - 1 AS place FROM (
    SELECT min(id) AS id, v FROM vectors WHERE list_dot_product(v, v) > 0 GROUP BY v)),
edges_0 AS MATERIALIZED {nearest(first)}"""
    for i in range(rounds):
        met = f"SELECT DISTINCT x.u AS a, y.u AS b FROM meet_{i} x JOIN meet_{i} y ON x.v = y.v AND x.u <> y.u"
        sql += f""",
meet_{i} AS MATERIALIZED ({both_ways(f'edges_{i}')} UNION SELECT id, id FROM graph_nodes),
edges_{i + 1} AS MATERIALIZED {nearest(met)}"""
    return sql + f""",
ways AS (
  SELECT x.id AS v, y.id AS u FROM graph_nodes x, range({shortcuts}) s(j), graph_nodes y
  WHERE y.place = (x.place + (1 << j)) % (SELECT count(*) FROM graph_nodes) AND x.id <> y.id),
graph AS MATERIALIZED ({both_ways(f'edges_{rounds}')} UNION SELECT v, u FROM ways UNION SELECT u, v FROM ways)"""


def _walk(name: str, ef: int, rounds: int = 4, entries: int = 32, k: int = 10) -> str:
    """CTEs of the walk over ``graph``, ending in ``name``(query_id, rank, id, d)."""
    sql = f"""
{name}_0 AS MATERIALIZED (
  SELECT q.id AS query_id, n.id AS node, {_dist('q.v', 'n.v')} AS d, false AS opened FROM vectors q, graph_nodes n WHERE n.place < {entries})"""
    for i in range(rounds):
        near = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node) <= {ef} AS near FROM {name}_{i}"
        sql += f""",
{name}_near_{i} AS MATERIALIZED ({near}),
{name}_new_{i} AS MATERIALIZED (
  SELECT DISTINCT f.query_id, g.u AS node FROM {name}_near_{i} f JOIN graph g ON g.v = f.node WHERE near AND NOT opened),
{name}_{i + 1} AS MATERIALIZED (
  SELECT query_id, node, d, opened OR near AS opened FROM {name}_near_{i} UNION ALL
  SELECT w.query_id, w.node, {_dist('q.v', 'n.v')} AS d, false FROM {name}_new_{i} w
  JOIN vectors q ON q.id = w.query_id JOIN graph_nodes n ON n.id = w.node
  WHERE NOT EXISTS (SELECT 1 FROM {name}_{i} o WHERE o.query_id = w.query_id AND o.node = w.node))"""
    hits = f"""SELECT s.query_id, r.id, s.d FROM {name}_{rounds} s JOIN graph_nodes n ON n.id = s.node JOIN vectors r ON r.v = n.v WHERE r.id <> s.query_id"""
    return sql + f", {name} AS MATERIALIZED {_top(hits, k)}"


def _whole_walk(name: str, ef: int = 80, entries: int = 32, k: int = 10) -> str:
    """The same without a bound on rounds: a query walks on until its ``ef`` best are open."""
    hits = f"""SELECT s.query_id, r.id, s.d FROM {name}_end s JOIN graph_nodes n ON n.id = s.node JOIN vectors r ON r.v = n.v WHERE r.id <> s.query_id"""
    return f"""
{name}_rounds(round, query_id, node, d, opened) AS (
  SELECT 0, q.id, n.id, {_dist('q.v', 'n.v')}, false FROM vectors q, graph_nodes n WHERE n.place < {entries}
  UNION ALL (
  WITH near AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node) <= {ef} AS near FROM {name}_rounds),
  going AS (
    SELECT DISTINCT query_id FROM near WHERE near AND NOT opened),
  new AS (
    SELECT DISTINCT f.round, f.query_id, g.u AS node FROM near f JOIN graph g ON g.v = f.node WHERE f.near AND NOT f.opened)
  SELECT round + 1, query_id, node, d, opened OR near FROM near SEMI JOIN going USING (query_id) UNION ALL
  SELECT w.round + 1, w.query_id, w.node, {_dist('q.v', 'n.v')}, false FROM new w
  JOIN vectors q ON q.id = w.query_id JOIN graph_nodes n ON n.id = w.node
  WHERE NOT EXISTS (SELECT 1 FROM near o WHERE o.query_id = w.query_id AND o.node = w.node))),
{name}_end AS (
  SELECT query_id, node, d FROM (SELECT *, max(round) OVER (PARTITION BY query_id) AS last FROM {name}_rounds) WHERE round = last),
{name} AS MATERIALIZED {_top(hits, k)}"""


def _top(pairs: str, k: int) -> str:
    """Rank (query_id, id, d) rows."""
    return f"""(SELECT query_id, rank, id, d FROM (
  SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM ({pairs})) WHERE rank <= {k})"""


EXACT_PAIRS = f"SELECT q.id AS query_id, r.id, {_dist('q.v', 'r.v')} AS d FROM vectors q JOIN vectors r ON q.id <> r.id"


def _ivf_pairs(vectors: str, probes: int) -> str:
    return f"""SELECT l.id AS query_id, r.id, {_dist('q.v', 'r.v')} AS d
  FROM ranked_lists l JOIN assigned a ON l.list_id = a.list_id AND l.list_rank <= {probes} AND l.id <> a.id
  JOIN {vectors} q ON q.id = l.id JOIN {vectors} r ON r.id = a.id"""


RANKED = "SELECT query_id, rank, id, round(d, 5) AS distance FROM "
JOIN_SQL = f"WITH {VECTORS} {RANKED}{_top(EXACT_PAIRS, 10)}"

def _compared(ctes: str, pairs: str | None) -> str:
    """Up to ``per_query``: the share of the true neighbours that ``pairs`` (or a CTE ``actual``) finds at each cutoff."""
    return f"""
WITH {VECTORS}, {ctes},
truth AS {_top(EXACT_PAIRS, 10)},
{f"actual AS {_top(pairs, 10)}," if pairs else ""}
both_ranks AS (
  SELECT t.query_id, t.rank AS tr, greatest(t.rank, a.rank) AS m, a.rank IS NOT NULL AS found
  FROM truth t LEFT JOIN actual a ON t.query_id = a.query_id AND t.id = a.id),
per_query AS (
  SELECT query_id, """ + ", ".join(
        f"(count(*) FILTER (found AND m <= {n}))::DOUBLE / count(*) FILTER (tr <= {n}) AS f{n}" for n in (1, 5, 10)
    ) + " FROM both_ranks GROUP BY query_id) "


COMPARED = _compared(_ivf("vectors"), _ivf_pairs("vectors", 4))
TRUE_RECALL = (
    "SELECT count(*) AS queries_evaluated, "
    + ", ".join(f"round(avg(f{n}), 5) AS true_recall_at_{n}" for n in (1, 5, 10))
    + " FROM per_query"
)

PAIRS = "SELECT least(query_id, id) AS id_a, greatest(query_id, id) AS id_b, max(round(1 - d, 5)) AS similarity FROM {hits} WHERE round(1 - d, 5) >= {least} GROUP BY 1, 2"

def _lsh(tables: int, flips: int) -> str:
    """CTEs from ``vectors`` to shared(query_id, id): pairs with a common 8-bit bucket."""
    return f"""
planes AS (
  SELECT t, b, list(CASE WHEN md5(t || ':' || b || ':' || d)[1] < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS p
  FROM (SELECT range AS t FROM range({tables})), (SELECT range AS b FROM range(8)), (SELECT range AS d FROM range(64)) GROUP BY t, b),
margins AS (SELECT id, t, b, list_dot_product(v, p) AS m FROM vectors, planes),
buckets AS (SELECT id, t, sum(CASE WHEN m >= 0 THEN 1 << b ELSE 0 END)::BIGINT AS s FROM margins GROUP BY ALL),
closest AS (SELECT id, t, b FROM (SELECT id, t, b, row_number() OVER (PARTITION BY id, t ORDER BY abs(m), b) AS r FROM margins) WHERE r <= {flips}),
probed AS (
  SELECT id, t, s FROM buckets UNION
  SELECT k.id, k.t, xor(k.s, (1 << c.b)::BIGINT) FROM buckets k JOIN closest c ON k.id = c.id AND k.t = c.t),
shared AS (SELECT DISTINCT p.id AS query_id, k.id FROM probed p JOIN buckets k ON p.t = k.t AND p.s = k.s AND p.id <> k.id)"""


SHARED_PAIRS = f"SELECT s.query_id, s.id, {_dist('q.v', 'r.v')} AS d FROM shared s JOIN vectors q ON q.id = s.query_id JOIN vectors r ON r.id = s.id"

def _groups(vectors: str, least: float) -> str:
    """Every id with the smallest id it reaches over pairs of enough similarity, and its number of pairs."""
    return f"""
linked AS (
  SELECT q.id AS a, r.id AS b FROM {vectors} q JOIN {vectors} r ON q.id <> r.id
  WHERE list_dot_product(q.v, q.v) > 0 AND list_dot_product(r.v, r.v) > 0 AND {_dist('q.v', 'r.v')} <= {1 - least:.9f}),
reached AS (SELECT a AS id, b AS other FROM linked UNION SELECT r.id, l.b FROM reached r JOIN linked l ON l.a = r.other)
SELECT v.id, least(v.id, coalesce(m.least_id, v.id)) AS group_id, coalesce(n.links, 0)::BIGINT AS links
FROM {vectors} v LEFT JOIN (SELECT id, min(other) AS least_id FROM reached GROUP BY id) m ON m.id = v.id
LEFT JOIN (SELECT a, count(*) AS links FROM linked GROUP BY a) n ON n.a = v.id"""


RAW = r"""
raw AS (
  SELECT doc_id, doc_id % 5 AS kind,
    CASE doc_id % 5 WHEN 0 THEN ' ' || doc_id || ' ' WHEN 1 THEN doc_id || '.0' WHEN 2 THEN 'x' || doc_id
      WHEN 3 THEN doc_id || '.5' ELSE doc_id::VARCHAR END AS bug_id,
    CASE WHEN source <> 'src7' THEN source ELSE '' END AS summary,
    CASE WHEN source = 'src7' AND lang = 'en' THEN '' ELSE text END AS description,
    CASE lang WHEN 'de' THEN 'DUPLICATE' WHEN 'fr' THEN 'FIXED' ELSE 'UNRESOLVED' END AS resolution_status,
    CASE lang WHEN 'es' THEN '' WHEN 'en' THEN 'Linux' ELSE 'Unknown' END AS operating_system,
    CASE WHEN lang <> 'fr' THEN 'x86_64' ELSE 'Unknown' END AS architecture,
    CASE WHEN source <> 'src0' THEN source ELSE 'General' END AS component_type
  FROM documents)""" + f""",
clean AS (
  SELECT doc_id AS bug_id, summary, {_pipeline('description')} AS description, resolution_status, operating_system,
    architecture, component_type, kind FROM raw),
accepted AS (
  SELECT * EXCLUDE (kind), {_pipeline("summary || '. ' || description")} AS embedding_text
  FROM clean WHERE kind NOT IN (2, 3) AND (summary <> '' OR description <> ''))"""

STORED = f"""
WITH uploads AS (
  SELECT doc_id, CASE WHEN lang <> 'es' THEN md5(text) END AS external_id, lang AS product, source AS component,
    {_service("text || '. '")} AS cleaned_text FROM documents),
kept AS (
  SELECT * FROM uploads QUALIFY external_id IS NULL OR row_number() OVER (PARTITION BY external_id ORDER BY doc_id) = 1)
SELECT row_number() OVER (ORDER BY doc_id) AS id, external_id, product, component, 'UNRESOLVED' AS resolution_status,
  md5(cleaned_text) AS text_md5, {DIMENSION}::BIGINT AS dimensions FROM kept"""

TEXT_PAIRS = f"""SELECT q.item_id AS query_id, r.id, {_dist('q.v', 'r.v')} AS d
  FROM query_vectors q JOIN doc_vectors r ON true JOIN cleaned c ON c.id = r.id
  WHERE q.item_id % 2 <> 0 OR c.lang = 'en'"""

SAMPLED = f"""
WITH {DOCUMENTS}, {_ivf('doc_vectors')},
sample AS (SELECT id FROM doc_vectors ORDER BY md5(id::VARCHAR), id LIMIT 20),
truth AS {_top(f"SELECT q.id AS query_id, r.id, {_dist('q.v', 'r.v')} AS d FROM sample s JOIN doc_vectors q ON s.id = q.id JOIN doc_vectors r ON q.id <> r.id", 10)},
actual AS {_top(f"SELECT * FROM ({_ivf_pairs('doc_vectors', 1)}) WHERE query_id IN (SELECT id FROM sample)", 10)},
both_ranks AS (
  SELECT t.query_id, greatest(t.rank, a.rank) AS m, a.rank IS NOT NULL AS found
  FROM truth t LEFT JOIN actual a ON t.query_id = a.query_id AND t.id = a.id),
per_query AS (SELECT query_id, min(m) FILTER (found) AS m FROM both_ranks GROUP BY query_id)
SELECT count(*) AS queries_evaluated, """ + ", ".join(
    f"round(avg(CASE WHEN m <= {n} THEN 1.0 ELSE 0.0 END), 5) AS recall_at_{n}" for n in (1, 5, 10)
) + " FROM per_query"

BAND = "CASE WHEN {p} >= 90 THEN 'Very high' WHEN {p} >= 75 THEN 'High' WHEN {p} >= 55 THEN 'Moderate' ELSE 'Low' END"

ALL = {
    "knn_exact": f"""WITH {VECTORS}
SELECT r.id, round({_dist('q.v', 'r.v')}, 5) AS distance FROM vectors q JOIN vectors r ON q.id = 0 AND r.id <> 0
ORDER BY {_dist('q.v', 'r.v')}, r.id LIMIT 10""",
    "knn_join": JOIN_SQL,
    "knn_join_cells": JOIN_SQL,
    "knn_join_pruned": JOIN_SQL,
    "stream_match": JOIN_SQL,
    "knn_hybrid_filter": f"""WITH {VECTORS}
SELECT r.id, r.label, round({_dist('q.v', 'r.v')}, 5) AS distance FROM vectors q JOIN vectors r ON q.id = 0 AND r.label = 3
ORDER BY {_dist('q.v', 'r.v')}, r.id LIMIT 5""",
    **dict.fromkeys(
        ("hybrid_ivf", "hybrid_hashed"),
        f"""WITH {VECTORS}
SELECT r.id, r.label, round({_dist('q.v', 'r.v')}, 5) AS distance FROM vectors q JOIN vectors r ON q.id = 0 AND r.label = 3
ORDER BY {_dist('q.v', 'r.v')}, r.id LIMIT 5""",
    ),
    "hybrid_two_filters": f"""WITH {DOCUMENTS}
SELECT r.id, c.lang AS product, c.source AS component, round({_dist('q.v', 'r.v')}, 5) AS distance
FROM doc_vectors q JOIN doc_vectors r ON q.id = 0 JOIN cleaned c ON c.id = r.id AND c.lang = 'en' AND c.source = 'src3'
ORDER BY {_dist('q.v', 'r.v')}, r.id LIMIT 10""",
    "search_exclude_self": f"""WITH {VECTORS}
SELECT t.query_id, t.rank, t.id, label::VARCHAR AS product, round(1 - d, 5) AS similarity FROM
{_top(f"SELECT q.id AS query_id, r.id, {_dist('q.v', 'r.v')} AS d FROM vectors q JOIN vectors r ON (q.id <> r.id OR q.id = 0) AND (q.label >= 5 OR q.label = r.label)", 10)} t
JOIN vectors r ON r.id = t.id""",
    "text_search": f"""WITH {DOCUMENTS},
query_text AS (SELECT item_id, {_service('text')} AS t FROM benchmark), {_embedded('query_vectors', 'query_text', 'item_id', 't')}
SELECT t.query_id, t.rank, t.id, c.lang AS product, c.source AS component, round(1 - t.d, 5) AS similarity
FROM {_top(TEXT_PAIRS, 5)} t JOIN cleaned c ON c.id = t.id""",
    "ivf_assign": f"WITH {VECTORS}, {_ivf('vectors')} SELECT id, list_id FROM assigned",
    "ivf_index_table": f"WITH {VECTORS}, {_ivf('vectors')} SELECT list_id, count(*) AS reports FROM assigned GROUP BY list_id",
    "ivf_search": f"WITH {VECTORS}, {_ivf('vectors')} {RANKED}{_top(_ivf_pairs('vectors', 4), 10)}",
    "ivf_candidates": f"""WITH {VECTORS}, {_ivf('vectors')}
SELECT l.id AS query_id, count(*) AS candidates FROM ranked_lists l JOIN assigned a ON l.list_id = a.list_id
WHERE list_rank <= 4 GROUP BY l.id""",
    "ivf_search_stored": f"WITH {VECTORS}, {_ivf('vectors')} {RANKED}{_top(_ivf_pairs('vectors', 4), 10)}",
    "ivf_append": f"WITH {VECTORS}, {GROWN} {RANKED}{_top(GROWN_PAIRS, 10)}",
    "ivf_drift": f"""WITH {VECTORS}, {GROWN}
SELECT id % 2 AS load, list_id, count(*) AS reports, round(avg(d), 5) AS mean_distance FROM assigned_all GROUP BY ALL""",
    "ivf_merge_split": JOIN_SQL,
    "lsh_search_stored": f"WITH {VECTORS}, {_lsh(8, 2)} {RANKED}{_top(SHARED_PAIRS, 10)}",
    # of its buckets of 40 bits only copies share one, so all others are searched exactly
    "lsh_search_complete": f"WITH {VECTORS} {RANKED}{_top(EXACT_PAIRS + ' WHERE q.id % 20 = 0', 10)}",
    "ivf_tree_assign": f"WITH {VECTORS}, {_tree('vectors')} SELECT id, list_id, leaf FROM in_leaf",
    "ivf_tree_search": f"WITH {VECTORS}, {_tree('vectors')} {RANKED}{_top(TREE_PAIRS, 10)}",
    "graph_edges": f"WITH {VECTORS}, {_graph()} SELECT v, u FROM graph",
    "graph_search": f"WITH RECURSIVE {VECTORS}, {_graph()}, {_whole_walk('walk')} {RANKED}walk",
    "recall_graph": " UNION ALL ".join(
        f"SELECT * FROM ({_compared(_graph() + ',' + _walk('actual', ef), None)}{TRUE_RECALL.replace('SELECT ', f'SELECT {ef}::BIGINT AS ef, ', 1)})"
        for ef in (40, 80)
    ),
    "hybrid_ivf_few_probes": f"""WITH {VECTORS}, kinds AS (SELECT *, CASE WHEN id % 97 = 0 THEN 'rare' ELSE label::VARCHAR END AS kind FROM vectors)
{RANKED}{_top(f"SELECT q.id AS query_id, r.id, {_dist('q.v', 'r.v')} AS d FROM kinds q JOIN kinds r ON q.id <> r.id AND (q.id % 3 = 2 OR r.kind = CASE q.id % 3 WHEN 0 THEN 'rare' ELSE q.kind END)", 10)}""",
    "lsh_search": f"WITH {VECTORS}, {_lsh(8, 2)} {RANKED}{_top(SHARED_PAIRS, 10)}",
    "duplicate_pairs_hashed": f"WITH {VECTORS}, {_lsh(16, 0)} {PAIRS.format(hits=_top(SHARED_PAIRS, 10), least=0.3)}",
    "duplicate_pairs": f"WITH {VECTORS} {PAIRS.format(hits=_top(EXACT_PAIRS, 10), least=0.3)}",
    "duplicate_reports": f"WITH {DOCUMENTS}, {_ivf('doc_vectors')} {PAIRS.format(hits=_top(_ivf_pairs('doc_vectors', 2), 5), least=0.9)}",
    "duplicate_groups": f"WITH RECURSIVE {DOCUMENTS}, {_groups('doc_vectors', 0.9)}",
    "duplicate_groups_vectors": f"WITH RECURSIVE {VECTORS}, {_groups('vectors', 0.45)}",
    "recall_hit_rate": COMPARED
    + "SELECT count(*) AS queries_evaluated, "
    + ", ".join(f"round(avg(CASE WHEN f{n} > 0 THEN 1.0 ELSE 0.0 END), 5) AS recall_at_{n}" for n in (1, 5, 10))
    + " FROM (SELECT query_id, "
    + ", ".join(f"count(*) FILTER (found AND m <= {n}) AS f{n}" for n in (1, 5, 10))
    + " FROM both_ranks GROUP BY query_id)",
    "recall_true": COMPARED + TRUE_RECALL,
    "recall_tree": _compared(_tree("vectors"), TREE_PAIRS) + TRUE_RECALL,
    "benchmark_sample": SAMPLED,
    "sample_reports": "SELECT doc_id AS id, source FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 20",
    "latency_summary": """SELECT event_type, count(*) AS queries_evaluated, round(avg(value), 5) AS average_latency_ms,
  round(quantile_cont(value, 0.95), 5) AS p95_latency_ms FROM events GROUP BY event_type""",
    "benchmark_history": """SELECT id, index_type, created_at, queries_evaluated, average_latency_ms, p95_latency_ms FROM (
  SELECT ascii(event_type)::BIGINT AS id, date_trunc('day', ts)::TIMESTAMP AS created_at,
    CASE WHEN event_type IN ('click', 'view') THEN 'hnsw' WHEN event_type IN ('error', 'signup') THEN 'ivfflat' ELSE 'exact' END AS index_type,
    count(*) AS queries_evaluated, round(avg(value), 5) AS average_latency_ms, round(quantile_cont(value, 0.95), 5) AS p95_latency_ms
  FROM events GROUP BY event_type, date_trunc('day', ts)) ORDER BY created_at DESC, id DESC LIMIT 50""",
    "vector_audit": "SELECT count(*) AS total_rows, count(*) FILTER (len(embedding) = 64) AS valid_vectors FROM embeddings",
    "clean_service": f"SELECT page_id, {_service('html')} AS cleaned FROM pages",
    "clean_pipeline": f"SELECT page_id, {_pipeline('html')} AS cleaned FROM pages",
    "normalize_clean": f"WITH {RAW} SELECT * FROM accepted",
    "normalize_rejects": f"""WITH {RAW}
SELECT r.bug_id, CASE r.kind WHEN 3 THEN 'bug_id is fractional' WHEN 2 THEN 'bug_id is not a number' ELSE 'summary and description are empty' END AS reason
FROM raw r WHERE r.kind IN (2, 3) OR (r.summary = '' AND r.description = '')""",
    "clean_dataset": f"WITH {RAW} SELECT bug_id, resolution_status, component_type, embedding_text FROM accepted",
    "jsonl_export": f"""WITH {RAW} SELECT bug_id, resolution_status, component_type, {DIMENSION}::BIGINT AS dimensions, 1.0::DOUBLE AS norm FROM accepted""",
    "embed_hash": f"""WITH {_embedded('doc_vectors', 'documents', 'doc_id', 'text')}
SELECT doc_id, len(v) AS dimensions, md5('[' || array_to_string(list_transform(v, lambda x: printf('%.8f', x)), ',') || ']') AS vector_md5 FROM doc_vectors""",
    "l2_normalize": """SELECT vec_id, generate_subscripts(v, 1) - 1 AS position, round(unnest(v) / norm, 5) AS value FROM (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings))""",
    "vector_text_roundtrip": """SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS vector_text,
  len(embedding) AS dimensions, 0.0::DOUBLE AS distance FROM embeddings""",
    "seed_vectors": f"SELECT doc_id AS id, lang, {DIMENSION}::BIGINT AS embedding_dimensions FROM documents ORDER BY doc_id LIMIT 3",
    "similarity_band": f"""WITH {VECTORS}
SELECT query_id, id, round(least(greatest((1 - d) * 100, 0), 100), 3) AS percent, {BAND.format(p='(2 * (1 - d) * 100)')} AS band FROM {_top(EXACT_PAIRS, 10)}""",
    "status_class": """SELECT doc_id, s AS status, CASE s WHEN 'RESOLVED' THEN 'resolved' WHEN 'closed' THEN 'resolved' WHEN 'DUPLICATE' THEN 'neutral' ELSE 'open' END AS status_class
FROM (SELECT doc_id, ['UNRESOLVED', 'RESOLVED', 'New', 'closed', 'Reopened', 'DUPLICATE'][doc_id % 6 + 1] AS s FROM documents)""",
    "validate_rejects": r"""SELECT doc_id, CASE WHEN lang = 'de' OR length(text) < 1 THEN 'summary is empty'
  WHEN length(split_part(text, chr(10), 1)) > 120 THEN 'component is longer than 120'
  WHEN length(split_part(text, '.', 1)) > 80 THEN 'architecture is longer than 80' END AS reason FROM documents""",
    "vector_rejects": """SELECT vec_id, CASE WHEN label = 3 THEN 'embedding holds NULL' ELSE 'embedding has not 64 values' END AS reason
FROM embeddings WHERE label % 2 = 1""",
    "request_rejects": """SELECT conv_id, turn, CASE WHEN role <> 'user' OR length(text) < 2 THEN 'query is too short'
  WHEN conv_id % 120 NOT BETWEEN 1 AND 100 THEN 'k is out of bounds' WHEN conv_id % 4 = 3 THEN 'unknown index_type' END AS reason
FROM conversations""",
    "run_rejects": """SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown index_type'
  WHEN event_id % 3 < 2 THEN 'k must be positive' END AS reason FROM events""",
    "known_keys": """SELECT DISTINCT md5(text) AS external_id FROM documents WHERE md5(text) IN
  (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)
UNION SELECT DISTINCT md5(text) FROM benchmark WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)""",
    **dict.fromkeys(("import_counts", "import_counts_keyed"), """WITH u AS (SELECT CASE WHEN lang <> 'es' THEN md5(text) END AS e FROM documents)
SELECT 0::BIGINT AS upload, count(DISTINCT e) + count(*) FILTER (e IS NULL) AS imported, count(e) - count(DISTINCT e) AS rejected FROM u
UNION ALL SELECT 1, count(*) FILTER (e IS NULL), count(e) FROM u"""),
    "latency_with_gaps": """SELECT event_type, count(*) AS queries_evaluated, round(avg(ms), 5) AS average_latency_ms,
  round(quantile_cont(ms, 0.95), 5) AS p95_latency_ms
FROM (SELECT event_type, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 > 0 THEN value END
  WHEN event_type <> 'click' THEN value END AS ms FROM events) GROUP BY event_type""",
    "csv_by_header": """SELECT doc_id, text AS summary, CASE WHEN doc_id % 3 < 2 THEN lang END AS product,
  CASE WHEN doc_id % 3 = 1 THEN source END AS component FROM documents""",
    "dedupe_external_id": """SELECT doc_id, external_id, external_id IS NOT NULL AND row_number() OVER (PARTITION BY external_id ORDER BY doc_id) > 1 AS is_repeat
FROM (SELECT doc_id, CASE WHEN lang <> 'es' THEN md5(text) END AS external_id FROM documents)""",
    **dict.fromkeys(("stream_dedupe", "stream_dedupe_keyed"), """SELECT doc_id, external_id, 'external_id is not unique' AS reason
FROM (SELECT doc_id, md5(text) AS external_id FROM documents WHERE lang <> 'es')
QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY doc_id) > 1"""),
    "alias_columns": """SELECT doc_id, CASE WHEN lang = 'en' THEN source || '-' || doc_id ELSE doc_id::VARCHAR END AS external_id, text AS summary,
  '' AS description, NULL::VARCHAR AS product, CASE WHEN lang = 'fr' THEN lang ELSE source END AS component,
  CASE WHEN lang = 'de' THEN 'UNRESOLVED' ELSE upper(lang) END AS resolution_status,
  NULL::VARCHAR AS operating_system, NULL::VARCHAR AS architecture FROM documents""",
    "upsert_latest": """WITH s AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'assistant' ELSE 'user' END AS status FROM labels),
n AS (SELECT conv_id AS id, arg_max(role, turn) AS status FROM conversations GROUP BY conv_id)
SELECT coalesce(s.id, n.id) AS id, coalesce(n.status, s.status) AS status,
  CASE WHEN s.id IS NULL THEN TIMESTAMP '2025-01-01' ELSE TIMESTAMP '2024-01-01' END AS created_at,
  CASE WHEN s.id IS NULL OR n.status <> s.status THEN TIMESTAMP '2025-01-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at
FROM s FULL JOIN n ON s.id = n.id""",
    "assign_report_ids": "SELECT doc_id, source, 100 + row_number() OVER (ORDER BY source, doc_id) AS id FROM documents",
    "csv_roundtrip": "SELECT doc_id, text AS summary, lang AS product, NULL::VARCHAR AS component FROM documents",
    "bulk_load": STORED,
    "stream_ingest": STORED,
    "stream_watermark": """SELECT DISTINCT user_id || '-' || event_type AS external_id FROM events WHERE event_type <> 'error'
UNION ALL SELECT NULL FROM events WHERE event_type = 'error'""",
    "stream_upsert": """SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
}
