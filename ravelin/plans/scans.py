"""Sources, projections and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text, uris
from ..functions.uris import short_predicate
from ..operators import resolve
from ..runtime import latest, table
from ..sources import caches, exports, texts, triples
from . import data

Q, SQL = {}, {}


def query(sql=None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query("SELECT line_no, s, p, o, kind FROM semrepo_nt WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND kind IS NOT NULL")
def s1_parse_triples(spark, d):
    """Every triple without nulls, written with escapes and parsed back."""
    t = table(spark, d, "semrepo_nt")
    lines = t.select("line_no", triples.render(F.col("s"), F.col("p"), F.col("o"), F.col("kind"), escaped=True).alias("value"))
    return triples.parse(lines, escaped=True).select("line_no", "s", "p", "o", "kind")


@query(
    f"""SELECT c.repo, count(*) AS triples FROM (SELECT lower(regexp_replace(s, '^https?://semrepo.example/repository/', '')) AS k FROM semrepo_nt) t
    JOIN (SELECT lower(repo) AS k, min(repo) AS repo FROM repo_aggregates WHERE repo IS NOT NULL GROUP BY 1) c ON c.k = t.k GROUP BY 1"""
)
def s2_cohort_scan(spark, d):
    t = table(spark, d, "semrepo_nt").select(F.regexp_replace("s", "^http://", "https://").alias("s"))
    return triples.of_cohort(t, table(spark, d, "repo_aggregates"), "https://semrepo.example/repository/").groupBy("repo").agg(F.count("*").alias("triples"))


@query("SELECT line_no, s, p, o FROM semrepo_nt WHERE regexp_matches(p, 'hasTotal|dc/terms/title')")
def s3_predicate_filter(spark, d):
    return triples.with_predicates(table(spark, d, "semrepo_nt"), "hasTotal|dc/terms/title").select("line_no", "s", "p", "o")


@query(
    """SELECT 'https://semrepo.example/repository/' || regexp_extract(o, 'issue/(.*)/[^/]+$', 1) AS s, count(*) AS n FROM semrepo_nt
    WHERE kind = 'uri' AND regexp_matches(o, '^https://semrepo.example/issue/[^/]+/[^/]+/[^/]+$') GROUP BY 1"""
)
def s4_subject_rewrite(spark, d):
    """Issue URIs as references of the repository they name."""
    t = table(spark, d, "semrepo_nt").where("kind = 'uri' and o rlike '^https://semrepo.example/issue/[^/]+/[^/]+/[^/]+$'")
    refs = t.select(F.replace("o", F.lit("/issue/"), F.lit("/contributorreference/")).alias("s"))
    return triples.referenced(refs).groupBy("s").agg(F.count("*").alias("n"))


@query(
    """SELECT event_type, CASE WHEN event_id % 3 = 0 THEN 'absent' WHEN event_id % 3 = 1 THEN 'resolved' ELSE 'failed' END AS state, count(*) AS n FROM events GROUP BY ALL"""
)
def s5_lookup_states(spark, d):
    """Cached documents, marked absences and broken documents told apart."""
    e = table(spark, d, "events")
    doc = F.when(F.col("event_id") % 3 == 0, '{"_404": true}').when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    return e.select("event_type", caches.lookup_state(doc).alias("state")).groupBy("event_type", "state").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS key, p_size AS size, p_retailprice AS price FROM part")
def s6_keyed_table(spark, d):
    """{key: row} documents read as maps and exploded."""
    p = table(spark, d, "part")
    doc = F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))))
    return p.select(F.explode(caches.keyed_table(doc, "struct<size:int,price:double>")).alias("key", "row")).select(F.col("key").cast("long").alias("key"), "row.size", "row.price")


@query("SELECT p_partkey, p_name AS package, p_brand || ' ' || p_type AS description, p_brand AS version FROM part")
def s7_stanzas(spark, d):
    p = table(spark, d, "part")
    doc = F.format_string("\n\nPackage: %s\nVersion: old\nDescription: %s\n\t%s\nno key here\nVersion: %s\n   \n\n", "p_name", "p_brand", "p_type", "p_brand")
    s = p.select("p_partkey", F.explode(texts.stanzas(doc)).alias("f"))
    return s.select("p_partkey", F.col("f")["Package"].alias("package"), F.col("f")["Description"].alias("description"), F.col("f")["Version"].alias("version"))


@query("SELECT p_partkey, p_type AS name, CAST(p_size AS varchar) AS value FROM part")
def s8_commented_lines(spark, d):
    p = table(spark, d, "part")
    lines = F.array(F.format_string("  %s \t %d # %s", "p_type", "p_size", "p_name"), F.lit("# nothing"), F.lit("only-one"), F.lit("one two three"))
    return p.select("p_partkey", F.explode(F.transform(lines, lambda x: texts.commented(x))).alias("f")).where("f is not null").select("p_partkey", F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).alias("value"))


@query("SELECT c_custkey, c_name AS node, 'https://git.example/' || c_mktsegment AS origin FROM customer")
def s9_tab_separated(spark, d):
    c = table(spark, d, "customer")
    line = F.concat_ws("\t", "c_name", F.concat(F.lit("https://git.example/"), "c_mktsegment"))
    return c.select("c_custkey", F.from_csv(line, F.lit("node string, origin string"), {"sep": "\t"}).alias("r")).select("c_custkey", "r.node", "r.origin")


@query("SELECT doc_id, split_part(path, '/', -1) IN ('go.mod','package.json') AS is_manifest, len(string_split(path, '/')) - 1 AS depth FROM documents WHERE path IS NOT NULL")
def s10_manifest_kinds(spark, d):
    t = table(spark, d, "documents").where("path is not null")
    return t.select("doc_id", F.coalesce(paths.ecosystem(paths.manifest_kind(F.col("path"))).isin("go", "js"), F.lit(False)).alias("is_manifest"), paths.fetch_key(F.col("path"))["depth"].alias("depth"))


@query(
    """SELECT repo, CASE WHEN p THEN pv ELSE fv END AS value, CASE WHEN p THEN 'primary' ELSE 'fallback' END AS origin FROM
    (SELECT coalesce(a.k, b.k) AS repo, a.k IS NOT NULL AS p, a.v AS pv, b.v AS fv FROM
      (SELECT lower(repo) AS k, max(CASE WHEN status = 'ok' THEN full_name END) AS v FROM github_cache WHERE repo IS NOT NULL GROUP BY 1) a FULL JOIN
      (SELECT lower(repo) AS k, max(url) AS v FROM repo_refs_cache WHERE repo IS NOT NULL GROUP BY 1) b ON a.k = b.k)"""
)
def s11_preferred_source(spark, d):
    a = table(spark, d, "github_cache").where("repo is not null").groupBy(F.lower("repo").alias("repo")).agg(F.max(F.when(F.col("status") == "ok", F.col("full_name"))).alias("value"))
    b = table(spark, d, "repo_refs_cache").where("repo is not null").groupBy(F.lower("repo").alias("repo")).agg(F.max("url").alias("value"))
    return caches.preferred(a, b, ["repo"], "value")


@query("SELECT status, coalesce(regexp_matches(lower(status), '502|early eof'), false) AS again, count(*) AS n FROM github_cache GROUP BY ALL")
def s12_fetch_outcomes(spark, d):
    """How lookups ended, and whether a failure is worth another try."""
    return table(spark, d, "github_cache").select("status", caches.is_retryable(F.col("status")).alias("again")).groupBy("status", "again").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def s14_base64_text(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    enc = F.base64(F.encode("text", "UTF-8"))
    return t.select("doc_id", F.md5(text.decoded_base64(enc).cast("binary")).alias("digest"))


@query(f"SELECT '[\"' || a || '\",\"' || b || '\",' || w || ']' AS value FROM {data.STAR_EDGES} WHERE w >= 3")
def k1_edge_json(spark, d):
    return exports.edge_lines(data.star_edges(spark, d).where("w >= 3").drop("members"))


@query("SELECT r_name AS key, '{\"r_regionkey\":' || r_regionkey || '}' AS value FROM region")
def k2_keyed_json(spark, d):
    return exports.keyed_lines(table(spark, d, "region"), "r_name")


@query("SELECT line_no, '<' || s || '> <' || p || '> ' || CASE kind WHEN 'uri' THEN '<' || o || '>' ELSE '\"' || o || '\"' END || ' .' AS value FROM semrepo_nt WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
def k3_triple_lines(spark, d):
    t = table(spark, d, "semrepo_nt")
    return t.select("line_no", triples.render(F.col("s"), F.col("p"), F.col("o"), F.col("kind")).alias("value")).where("value is not null")


@query(
    f"""WITH al AS (SELECT repo AS alias, lower(full_name) AS canon FROM {data.PAGES} WHERE lower(full_name) <> repo), own AS (SELECT DISTINCT lower(repo) AS k FROM repo_aggregates WHERE repo IS NOT NULL),
    via AS (SELECT alias AS key, min(canon) AS node FROM al WHERE canon IN (SELECT k FROM own) GROUP BY 1), look AS (SELECT k AS key, k AS node FROM own WHERE k NOT IN (SELECT key FROM via) UNION ALL SELECT * FROM via),
    ids AS (SELECT rec_id AS pos, lower(trim(repo)) AS repo FROM dependency_repo_aggregates)
    SELECT coalesce(l.node, i.repo) AS repo, min(pos) AS pos FROM ids i LEFT JOIN look l ON l.key = i.repo GROUP BY 1"""
)
def k4_rewritten_list(spark, d):
    ids = table(spark, d, "dependency_repo_aggregates").select(F.lower(F.trim("repo")).alias("repo"), F.col("rec_id").alias("pos"))
    return resolve.rewritten_list(ids, resolve.lookup(*_nodes(spark, d)))


def _nodes(spark, d):
    nodes = table(spark, d, "repo_aggregates").select(F.lower("repo").alias("node"))
    al = data.pages(spark, d).where("lower(full_name) <> repo").select(F.col("repo").alias("alias"), F.lower("full_name").alias("canon"))
    return nodes, al


@query(f"WITH e AS (SELECT * FROM {data.STAR_EDGES}), n AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS id FROM (SELECT a AS x FROM e UNION SELECT b FROM e)) SELECT p.id AS a_id, q.id AS b_id, w FROM e JOIN n p ON p.x = a JOIN n q ON q.x = b")
def k5_interned_edges(spark, d):
    return exports.interned(data.star_edges(spark, d))[1]


@query(f"SELECT topic, list_sort(list(repo)) AS holders FROM {data.REPO_TOPICS} GROUP BY 1")
def k5_topic_index(spark, d):
    return exports.inverted(data.repo_topics(spark, d), "topic", "repo")


@query(
    f"""SELECT lang, n, round(100.0 * n / (SELECT count(DISTINCT doc_id) FROM documents), 1) AS percent FROM (SELECT lang, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1) ORDER BY n DESC, lang LIMIT 15"""
)
def k6_summary(spark, d):
    return exports.summary(table(spark, d, "documents"), "lang", "doc_id")


@query("SELECT regexp_extract(split_part(p, '/', -1), '([^#]*)$', 1) AS predicate, count(*) AS n FROM semrepo_nt WHERE p IS NOT NULL GROUP BY 1")
def p1_short_predicates(spark, d):
    return table(spark, d, "semrepo_nt").where("p is not null").groupBy(short_predicate(F.col("p")).alias("predicate")).agg(F.count("*").alias("n"))


Q["short_predicates"], SQL["short_predicates"] = Q.pop("p1_short_predicates"), SQL.pop("p1_short_predicates")


@query("SELECT line_no, CASE WHEN s LIKE 'https://semrepo.example/repository/%' THEN substr(s, 36) ELSE s END AS name FROM semrepo_nt WHERE s IS NOT NULL")
def subject_names(spark, d):
    return table(spark, d, "semrepo_nt").where("s is not null").select("line_no", uris.subject_name(F.col("s"), "https://semrepo.example/repository/").alias("name"))


_KIND = """SELECT CASE WHEN x LIKE 'person/%' THEN 'person' WHEN x LIKE 'issue/%' OR x LIKE '%/issue/%' THEN 'issue' ELSE 'other' END AS type, count(*) AS n, count(DISTINCT x) AS labels
    FROM (SELECT replace(o, 'https://semrepo.example/', '') AS x FROM semrepo_nt WHERE kind = 'uri' AND o IS NOT NULL) {} GROUP BY 1"""


@query(_KIND.format(""))
def object_kinds(spark, d):
    t = table(spark, d, "semrepo_nt").where("kind = 'uri' and o is not null")
    kind, label = uris.object_kind(F.col("o"), "https://semrepo.example/")
    return t.select(kind.alias("type"), label.alias("label")).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


@query(_KIND.format("WHERE x NOT LIKE 'person/%'"))
def without_persons(spark, d):
    return object_kinds(spark, d).where("type <> 'person'")


@query("SELECT c_custkey, c_custkey % 7 NOT IN (0, 1, 2) AS person FROM customer")
def person_filter(spark, d):
    """Ghosts, bots and paths are no persons."""
    k = F.col("c_custkey") % 7
    name = F.when(k == 0, "ghost").when(k == 1, F.concat("c_name", F.lit("[bot]"))).when(k == 2, F.concat(F.lit("x/"), "c_name")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", resolve.is_person(name).alias("person"))


@query("SELECT p_partkey, p_partkey % 4 = 1 AS vendored, p_partkey % 4 <> 1 AND p_partkey % 4 <> 3 AS module FROM part")
def path_rules(spark, d):
    """Vendored directories and a project's own modules; the file's name never counts as a directory."""
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, "src/app/vendor").when(k == 1, "a/vendor/b/go.mod").when(k == 2, "src/main/pom.xml").otherwise("core/src/integrationTest/pom.xml")
    return table(spark, d, "part").select("p_partkey", paths.is_vendored(path).alias("vendored"), paths.is_project_module(path).alias("module"))


@query("SELECT rec_id, contains(split_part(repo, '/', 1), '.') AS forge FROM dependency_repo_aggregates WHERE repo IS NOT NULL")
def forge_nodes(spark, d):
    return table(spark, d, "dependency_repo_aggregates").where("repo is not null").select("rec_id", uris.is_forge_node(F.col("repo")).alias("forge"))


@query(
    """SELECT rec_id, coalesce(nullif(origin, ''), CASE WHEN contains(split_part(repo, '/', 1), '.') THEN 'https://' || repo ELSE 'https://github.com/' || repo END) AS url FROM dependency_repo_aggregates WHERE repo IS NOT NULL"""
)
def origin_urls(spark, d):
    return table(spark, d, "dependency_repo_aggregates").where("repo is not null").select("rec_id", uris.origin_url(F.col("repo"), F.col("origin")).alias("url"))


@query("SELECT repo, error, regexp_matches(lower(error), 'early eof|connection timed out|the remote end hung up') AS again FROM repo_refs_cache WHERE error IS NOT NULL")
def retryable_errors(spark, d):
    return table(spark, d, "repo_refs_cache").where("error is not null").select("repo", "error", caches.is_retryable(F.col("error")).alias("again"))


@query("SELECT record_id, topics IS NULL OR len(topics) = 0 AS empty FROM topics")
def empty_values(spark, d):
    return table(spark, d, "topics").select("record_id", caches.is_empty(F.col("topics"), "array").alias("empty"))


@query(
    """SELECT repo, n, CASE WHEN node THEN 'node' WHEN forge AND n >= 5 THEN 'admitted' WHEN n >= 5 THEN 'later' ELSE 'refused' END AS state FROM (
    SELECT lower(trim(repo)) AS repo, count(*) AS n, lower(trim(repo)) IN (SELECT lower(repo) FROM repo_aggregates WHERE repo IS NOT NULL) AS node, contains(split_part(lower(trim(repo)), '/', 1), '.') AS forge
    FROM dependency_repo_aggregates WHERE repo IS NOT NULL GROUP BY 1)"""
)
def node_admission(spark, d):
    c = table(spark, d, "dependency_repo_aggregates").where("repo is not null").groupBy(F.lower(F.trim("repo")).alias("repo")).agg(F.count("*").alias("n"))
    nodes = table(spark, d, "repo_aggregates").where("repo is not null").select(F.lower("repo").alias("_k"), F.lit(True).alias("_is")).distinct()
    j = c.join(nodes, c["repo"] == nodes["_k"], "left")
    return resolve.admitted(j, F.coalesce("_is", F.lit(False)), uris.is_forge_node(F.col("repo")), F.col("n")).select("repo", "n", "state")


@query(
    """SELECT repo, stargazers, forks, origin FROM (SELECT lower(repo) AS repo, max(stargazers) AS stargazers, max(forks) AS forks, 'dump' AS origin FROM repo_aggregates WHERE repo IS NOT NULL GROUP BY 1) WHERE stargazers IS NOT NULL
    UNION ALL SELECT a.* FROM (SELECT lower(trim(repo)) AS repo, max(stargazers) AS stargazers, max(forks) AS forks, 'api' AS origin FROM dependency_repo_aggregates WHERE provider = 'api' AND repo IS NOT NULL GROUP BY 1) a
    WHERE repo NOT IN (SELECT lower(repo) FROM repo_aggregates WHERE repo IS NOT NULL AND stargazers IS NOT NULL)"""
)
def row_sources(spark, d):
    agg = lambda t, k: t.where("repo is not null").groupBy(k.alias("repo")).agg(F.max("stargazers").alias("stargazers"), F.max("forks").alias("forks"))
    dump = agg(table(spark, d, "repo_aggregates"), F.lower("repo"))
    api = agg(table(spark, d, "dependency_repo_aggregates").where("provider = 'api'"), F.lower(F.trim("repo")))
    return resolve.row_of_either(dump, api, "repo", "stargazers", ["stargazers", "forks"])


@query(
    """SELECT repo, title, stargazers FROM (SELECT *, row_number() OVER (PARTITION BY lower(repo) ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST, stargazers DESC NULLS LAST) AS rn FROM repo_aggregates WHERE repo IS NOT NULL)
    SELECT lower(repo) AS repo, title, stargazers WHERE rn = 1""".replace("SELECT repo, title, stargazers FROM (SELECT *", "FROM (SELECT *")
)
def latest_rows(spark, d):
    t = table(spark, d, "repo_aggregates").where("repo is not null")
    return latest(t, [F.lower("repo").alias("repo")], [F.col("loaded_at"), F.col("title"), F.col("stargazers")], ["title", "stargazers"])


QUERIES, ORACLES = Q, SQL
