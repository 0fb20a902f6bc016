"""SQL of this package's queries."""

P2 = r"""
WITH RECURSIVE page AS (
  SELECT lower(trim(repo)) AS repo, arg_max(struct_pack(f := nullif(lower(trim(full_name)), ''), p := CASE WHEN fork THEN nullif(lower(trim(parent_full_name)), '') END), coalesce(fetched_at, TIMESTAMP '0001-01-01')) AS r
  FROM github_cache WHERE status = 'ok' AND repo IS NOT NULL GROUP BY 1),
proper AS (
  SELECT lower(trim(repo)) AS repo, list_sort(list_distinct(list_filter(list_transform(ids, lambda x: lower(x)), lambda x: regexp_full_match(x, '[0-9a-f]{40}')))) AS ids, fetched_at
  FROM repo_refs_cache WHERE error IS NULL AND repo IS NOT NULL),
sets AS (SELECT repo, arg_max(ids, coalesce(fetched_at, TIMESTAMP '0001-01-01')) AS ids FROM proper WHERE len(ids) > 0 GROUP BY 1),
flat AS (SELECT repo, len(ids) AS n, unnest(ids) AS id FROM sets),
held AS (SELECT x.repo AS a, y.repo AS b FROM flat x JOIN flat y ON x.id = y.id AND x.repo < y.repo
         GROUP BY x.repo, y.repo, x.n, y.n HAVING count(*) >= 2 AND count(*) >= 0.9 * least(x.n, y.n) - 1e-9),
edge AS (SELECT repo AS a, r.f AS b FROM page WHERE r.f IS NOT NULL UNION SELECT repo, r.p FROM page WHERE r.p IS NOT NULL UNION SELECT a, b FROM held),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
recorded AS (SELECT DISTINCT lower(trim(repo)) AS repo FROM (SELECT repo FROM github_cache UNION ALL SELECT repo FROM repo_refs_cache) WHERE trim(repo) <> ''),
reach(root, node) AS (SELECT repo, repo FROM recorded UNION SELECT r.root, e.b FROM reach r JOIN both_ways e ON e.a = r.node),
found AS (SELECT r.root AS repo, min(r.node) AS group_id, count(*) AS n FROM reach r WHERE r.node IN (SELECT repo FROM recorded) GROUP BY 1)
SELECT repo, group_id FROM found WHERE n > 1
"""

_P3 = r"""
WITH RECURSIVE move AS (
  SELECT lower(trim(repo)) AS src, arg_max(lower(trim(full_name)), coalesce(fetched_at, TIMESTAMP '0001-01-01')) AS dst
  FROM github_cache WHERE status = 'ok' AND full_name IS NOT NULL GROUP BY 1),
rec AS (
  SELECT DISTINCT ON (rec_id) rec_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(repo, '^\s+|\s+$', '', 'g')), '^https://git\.example/', ''), '/+$', ''), '\.git$', '') AS slug,
         regexp_replace(title, '^\s+|\s+$', '', 'g') AS title, stargazers, fetched_at
  FROM dependency_repo_aggregates ORDER BY rec_id, fetched_at DESC NULLS LAST),
walk(start, name, k) AS (SELECT DISTINCT slug, slug, 0 FROM rec UNION ALL SELECT w.start, m.dst, k + 1 FROM walk w JOIN move m ON m.src = w.name AND m.dst <> w.name WHERE k < 200),
ends AS (SELECT start, arg_max(name, k) AS current_name FROM walk GROUP BY 1),
ranked AS (
  SELECT e.current_name, r.*, row_number() OVER (PARTITION BY e.current_name ORDER BY fetched_at DESC NULLS LAST, rec_id DESC) AS rank,
         title IS NOT NULL AND title <> '' AND NOT regexp_full_match(title, '[^\p{L}\p{N}]+') AND lower(title) <> split_part(slug, '/', -1)
           AND lower(title) NOT IN ('untitled', 'null', 'none', '(none)', 'n/a', 'na', 'nan', 'nil', 'tbd', 'todo', 'unknown', 'undefined', 'no title', '(untitled)', '(null)', 'placeholder') AS says
  FROM rec r JOIN ends e ON e.start = r.slug),
best AS (
  SELECT current_name, count(*) AS records, arg_min(title, rank) FILTER (says) AS title,
         coalesce(arg_min(stargazers, rank) FILTER (stargazers >= 0 AND stargazers <> 10000), max(stargazers) FILTER (stargazers = 10000)) AS stargazers
  FROM ranked GROUP BY 1)
"""

P3 = _P3 + "SELECT current_name, title, stargazers FROM best WHERE records > 1 AND title IS NOT NULL AND stargazers IS NOT NULL"

P3_RECORDS = (
    _P3
    + """, rep AS (SELECT current_name, says::int AS t, CASE WHEN stargazers IS NULL OR stargazers < 0 THEN 0 WHEN stargazers = 10000 THEN 1 ELSE 2 END AS s, min(rank) AS r
     FROM (SELECT * REPLACE (coalesce(says, false) AS says) FROM ranked) GROUP BY ALL),
chain(current_name, t, s, r, n) AS (SELECT *, 1 FROM rep UNION ALL SELECT y.*, n + 1 FROM chain x JOIN rep y ON y.current_name = x.current_name AND x.t >= y.t AND x.s >= y.s AND x.r < y.r),
deep AS (SELECT current_name, CAST(max(n) AS integer) AS layers FROM chain GROUP BY 1)
SELECT current_name, title, stargazers, records, layers FROM best JOIN deep USING (current_name) WHERE records > 1 AND title IS NOT NULL AND stargazers IS NOT NULL"""
)


def _clean(t: str, key: str, items: str, time: str) -> str:
    return rf"""SELECT {key} AS id, list_sort(list_distinct(list_filter(list_transform(coalesce({items}, []), lambda x: lower(trim(x, E' \t\n\r'))), lambda x: x <> ''))) AS s
      FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {time} DESC NULLS LAST) AS rn FROM {t}) WHERE rn = 1"""


P4 = rf"""
WITH sets AS (SELECT 'topics' AS tab, * FROM ({_clean('topics', 'record_id', 'topics', 'fetched_at')})
        UNION ALL SELECT 'shared_stargazers', * FROM ({_clean('shared_stargazers', 'edge_id', 'members', 'found_at')})),
flat AS (SELECT tab, id, len(s) AS n, unnest(s) AS x FROM sets)
SELECT a.tab, a.id AS id_a, b.id AS id_b FROM flat a JOIN flat b ON a.tab = b.tab AND a.x = b.x AND a.id < b.id
GROUP BY a.tab, a.id, b.id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9
"""

_P6 = rf"""
WITH sets AS (SELECT * FROM ({_clean('topics', 'record_id', 'topics', 'fetched_at')}) WHERE len(s) > 0),
n AS (SELECT count(*) AS n FROM sets), flat AS (SELECT id, unnest(s) AS x FROM sets), c AS (SELECT x, count(*) AS c FROM flat GROUP BY x),
pair AS (SELECT a.x AS a, b.x AS b, count(*) AS n_ab FROM flat a JOIN flat b ON a.id = b.id AND a.x < b.x GROUP BY ALL HAVING count(*) >= 5)
"""
P6 = _P6 + "SELECT a AS topic_a, b AS topic_b FROM pair JOIN c ca ON ca.x = a JOIN c cb ON cb.x = b, n WHERE n_ab * n.n >= 3 * ca.c * cb.c"

_P7 = r"""
WITH big AS (SELECT repo FROM (SELECT lower(trim(repo)) AS repo, arg_max(coalesce(stargazers, -1), coalesce(loaded_at, TIMESTAMP '0001-01-01')) AS stars FROM repo_aggregates WHERE repo IS NOT NULL GROUP BY 1) WHERE stars >= 500),
edge AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY found_at DESC NULLS LAST) AS rn FROM shared_stargazers) WHERE rn = 1),
ends AS (SELECT lower(trim(a)) AS repo, members FROM edge UNION ALL SELECT lower(trim(b)), members FROM edge),
held AS (SELECT DISTINCT repo, m FROM (SELECT repo, lower(trim(unnest(members), E' \t\n\r')) AS m FROM ends WHERE repo IN (SELECT repo FROM big)) WHERE m <> ''),
size AS (SELECT repo, count(*) AS n FROM held GROUP BY 1),
pair AS (SELECT x.repo AS a, y.repo AS b, count(*) AS common FROM held x JOIN held y ON x.m = y.m AND x.repo < y.repo GROUP BY ALL)
"""
P7 = _P7 + "SELECT a AS repo_a, b AS repo_b FROM pair JOIN size sa ON sa.repo = a JOIN size sb ON sb.repo = b WHERE common >= 0.35 * least(sa.n, sb.n)"
P7_ALL = _P7 + "SELECT a, b, common, sa.n AS size_a, sb.n AS size_b FROM pair JOIN size sa ON sa.repo = a JOIN size sb ON sb.repo = b"

P5 = r"""
WITH v AS (SELECT vec_id AS id, CAST(embedding AS double[]) AS e FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC NULLS LAST) AS rn FROM repo_text_embeddings WHERE vec_id IS NOT NULL)
  WHERE rn = 1 AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
r AS (SELECT x.id AS a, y.id AS b, row_number() OVER (PARTITION BY x.id ORDER BY round(list_cosine_similarity(x.e, y.e), 6) DESC, y.id) AS k FROM v x JOIN v y ON x.id <> y.id)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE k <= 5
"""

P5_ALL = P5[: P5.index("SELECT DISTINCT least")] + "SELECT a AS id, b AS other, cos, CAST(k AS integer) AS rank FROM r WHERE k <= 5"
P5_ALL = P5_ALL.replace("r AS (SELECT x.id AS a, y.id AS b,", "r AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.e, y.e), 6) AS cos,")

P10 = r"""
WITH w AS (SELECT doc_id, i - 1 AS s, substr(text, i, 200) AS t FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
h AS (SELECT t FROM w GROUP BY t HAVING min(doc_id) < max(doc_id)), m AS (SELECT doc_id, s FROM w WHERE t IN (SELECT t FROM h)),
g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 200 THEN 1 ELSE 0 END AS new FROM m), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g)
SELECT doc_id, min(s) AS start_char, max(s) + 200 AS end_char FROM r GROUP BY doc_id, run
"""
P10_SHARE = f"""WITH sp AS ({P10}), p AS (SELECT doc_id, sum(end_char - start_char) AS c FROM sp GROUP BY 1)
SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(c, 0) AS shared_chars, CASE WHEN coalesce(length(text), 0) > 0 THEN coalesce(c, 0) / length(text) ELSE 0.0 END AS shared_fraction FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id"""

ORACLES = {"p5_found": P5, "p5_nearest": P5_ALL, "p10_found": P10, "p10_share": P10_SHARE, "p2_found": P2, "p3_found": P3, "p3_records": P3_RECORDS, "p4_found": P4, "p6_found": P6, "p7_found": P7, "p7_overlaps": P7_ALL}
