"""Scalar functions and manifest parsers. Texts are rendered from whole tables and parsed back, so the SQL states the expected parts directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import manifests, names, text, uris
from ..operators import labels, resolve
from ..runtime import table
from . import data

Q, SQL = {}, {}


def query(sql=None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _part(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.replace("p_name", F.lit(" "), F.lit("-")).alias("n"), F.lower("p_type").alias("t"))


_PART = "(SELECT *, replace(p_name, ' ', '-') AS n, lower(p_type) AS t FROM part)"


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents WHERE text IS NOT NULL")
def f1_content_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("SELECT c_custkey, 'person-' || substr(sha256('salt:' || c_name), 1, 12) AS person FROM customer")
def f2_pseudonym_sha(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.pseudonym_sha(F.col("c_name"), "salt").alias("person"))


@query()
def f2_pseudonym(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.pseudonym(F.col("c_name"), "salt").alias("person"))


@query(
    f"""SELECT p_partkey, r AS reading, CASE WHEN r = 'pypi' THEN CASE p_size % 4 WHEN 0 THEN n || '/' || t WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE NULL END WHEN r = 'python' THEN CASE p_size % 4 WHEN 0 THEN n || '/' || t WHEN 1 THEN n || '/' || t ELSE NULL END
    WHEN r IN ('npm', 'maven') THEN CASE p_size % 4 WHEN 3 THEN 'orgs/' || t ELSE n || '/' || t END ELSE CASE p_size % 4 WHEN 0 THEN n || '/' || t WHEN 3 THEN 'orgs/' || t END END AS repo FROM {_PART}, (SELECT unnest(['pypi', 'python', 'npm', 'maven', 'debian']) AS r)"""
)
def f3_repo_of_url(spark, d):
    """The five readings of repository URLs, which differ in tails, places and refused owners."""
    k = F.col("p_size") % 4
    u = F.when(k == 0, F.format_string(" https://github.com/%s/%s.git/ ", "n", "t")).when(k == 1, F.format_string("https://github.com/%s/%s?tab=readme", "n", "t")).when(k == 2, F.format_string("git+ssh://git@github.com:%s/%s.git#v1", "n", "t")).otherwise(F.format_string("http://github.com/orgs/%s", "t"))
    rows = F.array(*[F.struct(F.lit(r).alias("reading"), uris.repo_of_url(F.col("u"), **kw).alias("repo")) for r, kw in uris.URL_READINGS.items()])
    return _part(spark, d).withColumn("u", u).select("p_partkey", F.explode(rows).alias("x")).select("p_partkey", "x.reading", "x.repo")


@query(f"SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'real/' || t WHEN 1 THEN 'other/' || t WHEN 2 THEN 'home/' || t END AS repo FROM {_PART}")
def f4_package_repo(spark, d):
    k = F.col("p_size") % 4
    gh = lambda o: F.concat(F.lit(f"https://github.com/{o}/"), "t")
    urls = F.when(k == 0, F.create_map(F.lit("Docs"), gh("docs"), F.lit(" SOURCE CODE "), gh("real"), F.lit("Home"), gh("late"))).when(k == 1, F.create_map(F.lit("Docs"), F.lit("https://x.example"), F.lit("Tracker"), gh("other")))
    home = F.when(k == 2, gh("home")).when(k == 1, gh("home"))
    return _part(spark, d).select("p_partkey", uris.package_repo(urls, home, F.lit("https://x.example/a.tgz")).alias("repo"))


@query("SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', '_.-') || '.X', '[-_.]+', '-', 'g')) AS name FROM part")
def f5_normalized(spark, d):
    return table(spark, d, "part").select("p_partkey", names.normalized(F.concat(F.replace("p_name", F.lit(" "), F.lit("_.-")), F.lit(".X"))).alias("name"))


@query(f"SELECT p_partkey, [n, 'pkg'] AS found FROM {_PART}")
def f6_requirement_names(spark, d):
    t = F.format_string("%s[socks]>=%d # c\n-r x.txt\nhttps://h/a.whl\n# only\n\npkg @ https://h/a.whl\r\n", "n", "p_size")
    return _part(spark, d).select("p_partkey", names.requirement_lines(t).alias("found"))


@query(f"SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CAST([] AS varchar[]) ELSE [n, 'extra', t] END AS found FROM {_PART}")
def f7_pyproject(spark, d):
    t = F.format_string('[project]\nname="x"\ndependencies=["%s>=1", "-bad"]\n[project.optional-dependencies]\ndev=["no"]\nfull=["extra[a]==2"]\n[dependency-groups]\nx=["no2"]\n[tool.poetry.dependencies]\npython="^3"\n%s="*"\n', "n", "t")
    t = F.when(F.col("p_size") % 5 == 0, F.lit("[broken")).otherwise(t)
    return _part(spark, d).select("p_partkey", manifests.pyproject(t).alias("found"))


@query(f"SELECT p_partkey, unnest([n, 'c', 'real', 'w', 'u']) AS name, unnest([NULL, 'o/' || t, NULL, NULL, NULL]) AS repo FROM {_PART}")
def f9_cargo(spark, d):
    t = F.format_string(
        '[dependencies]\n%s = "1"\nb = {path="x"}\nc = {git="https://github.com/o/%s"}\nd = {package="real", version="1"}\ne = {git="https://gl.example/x"}\n[dev-dependencies]\nz="1"\n[workspace.dependencies]\nw="2"\n[target."cfg(unix)".dependencies]\nu={version="1", optional=true}\n',
        "n",
        "t",
    )
    return _part(spark, d).select("p_partkey", F.explode(manifests.cargo(t)).alias("x")).select("p_partkey", "x.name", "x.repo")


@query(f"SELECT p_partkey, [n, 'github.com/a/' || t] AS found FROM {_PART}")
def f10_go_mod(spark, d):
    t = F.format_string("module x\nrequire %s v1.0.0\nrequire q/r v1 // Indirect\nrequire (\n\tgithub.com/a/%s v1\n\t// note v1\n\n\tx/y v1 // indirect\n)\nreplace a => b v1\n", "n", "t")
    return _part(spark, d).select("p_partkey", manifests.go_mod(t).alias("found"))


@query(f"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN n || '/' || t END AS direct, CASE p_size % 3 WHEN 1 THEN n || '/' || t END AS vanity FROM {_PART}")
def f11_go_module(spark, d):
    k = F.col("p_size") % 3
    path = F.when(k == 0, F.format_string("github.com/%s/%s/v2/config", "n", "t")).when(k == 1, F.format_string("go.example/%s/%s", "n", "t")).otherwise(F.format_string("github.com/%s", "n"))
    page = F.when(k == 1, F.format_string('<html><META name="go-import"\n content="go.example/x git https://github.com/%s/%s.git"></html>', "n", "t")).otherwise('<meta name="go-import" content="x git">')
    return _part(spark, d).select("p_partkey", uris.module_repo(path).alias("direct"), uris.go_import_repo(page).alias("vanity"))


@query(f"SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CAST([] AS varchar[]) ELSE list_sort([n, t || '-x']) END AS found FROM {_PART}")
def f12_package_json(spark, d):
    t = F.format_string('{"name":"x","dependencies":{"%s":"^1","%s-x":"2"},"devDependencies":{"no":"1"}}', "n", "t")
    t = F.when(F.col("p_size") % 5 == 0, F.lit("[1, 2]")).otherwise(t)
    return _part(spark, d).select("p_partkey", F.array_sort(manifests.package_json(t)).alias("found"))


_POM = """<project xmlns="http://maven.example/POM"><parent><groupId>up.%s</groupId></parent><artifactId>%s</artifactId><dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>m</artifactId></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId> g.%s </groupId><artifactId>a</artifactId></dependency><dependency><groupId>t</groupId><artifactId>t</artifactId><scope>test</scope></dependency><dependency><groupId>${p}</groupId><artifactId>x</artifactId></dependency>
<dependency><groupId>g</groupId><artifactId>o</artifactId><optional>true</optional></dependency></dependencies></project>"""


@query(f"SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'g.' || t || ':a,g:o' END AS deps, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'up.' || n || ':' || t END AS own FROM {_PART}")
def f13_pom(spark, d):
    t = F.when(F.col("p_size") % 5 == 0, F.lit("<project><broken>")).otherwise(F.format_string(_POM, "n", "t", "t"))
    p = _part(spark, d).select("p_partkey", manifests.pom(t).alias("x"), manifests.pom_own(t).alias("own"))
    coord = lambda c: F.concat(c["group"], F.lit(":"), c["artifact"])
    return p.select("p_partkey", F.array_join(F.transform("x", coord), ",").alias("deps"), coord(F.col("own")).alias("own"))


@query(f"SELECT p_partkey, n || ':' || t || ',h:b' AS deps FROM {_PART}")
def f15_gradle(spark, d):
    t = F.format_string("plugins {\n  id 'x'\n}\ndependencies {\n  // implementation 'no:no:1'\n  implementation \"%s:%s:1\"\n  testImplementation \"g:t:1\"\n  constraints {\n  }\n  api group: 'h', name: 'b', version: '2'\n}\nimplementation 'z:z:1'\n", "n", "t")
    return _part(spark, d).select("p_partkey", F.array_join(F.transform(manifests.gradle(t), lambda c: F.concat(c["group"], F.lit(":"), c["artifact"])), ",").alias("deps"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '2.' || p_size WHEN 1 THEN '9.' || p_size END AS version FROM part")
def f16_maven_latest(spark, d):
    k = F.col("p_size") % 3
    t = F.when(k == 0, F.format_string("<m><versioning><release>2.%d</release><latest>3</latest><versions><version>1</version></versions></versioning></m>", "p_size")).when(k == 1, F.format_string("<m><versions><version>1</version><version>9.%d</version></versions></m>", "p_size")).otherwise("<m/>")
    return _part(spark, d).select("p_partkey", manifests.maven_latest(t).alias("version"))


@query(f"SELECT p_partkey, unnest(['third/' || n, 'b', 'c']) AS label, unnest(['o/' || n, 'own/foo', 'x/foo']) AS repo FROM {_PART}")
def f17_gitmodules(spark, d):
    t = F.format_string(
        '[submodule "a"]\n\tpath = third/%s\n\turl = https://github.com/o/%s.git\n[submodule "b"]\n\turl = ../foo.git\n[submodule "c"]\n\turl=../../x/foo.git\n[submodule "d"]\n\turl = ../../../x.git\n[submodule "e"]\n\turl = https://gl.example/x/y\n[submodule "f"]\n\tpath = f\n', "n", "n"
    )
    return _part(spark, d).select("p_partkey", F.explode(manifests.gitmodules(t, F.lit("own/repo"))).alias("x")).select("p_partkey", "x.label", "x.repo")


@query(f"SELECT p_partkey, ['fmt', n, 'q', 'f1'] AS found FROM {_PART}")
def f18_vcpkg(spark, d):
    t = F.format_string('{"dependencies":["fmt","%s",{"name":"z","host":true},"vcpkg-cmake",{"name":"q"},7],"features":{"a":{"dependencies":["f1"]},"b":3}}', "n")
    return _part(spark, d).select("p_partkey", manifests.vcpkg(t).alias("found"))


@query(f"SELECT p_partkey, [n, 'zlib'] AS txt, ['boost', n, 'fmt'] AS py FROM {_PART}")
def f19_conan(spark, d):
    a = F.format_string("[generators]\ncmake\n[Requires]\n%s/1.0 # note\nzlib/1.2@u/c\n[tool_requires]\nno/1\n", "n")
    b = F.format_string("class X:\n    requires = \"%s/1.0\", 'fmt/9'\n    tool_requires = 'no/1'\n    def requirements(self):\n        self.requires('boost/1.8')\n", "n")
    return _part(spark, d).select("p_partkey", manifests.conan_txt(a).alias("txt"), manifests.conan_py(b).alias("py"))


@query(f"SELECT p_partkey, ['lib' || t, n] AS found FROM {_PART}")
def f20_depends(spark, d):
    t = F.format_string("lib%s (>= 1.2) | libalt, %s [amd64],, ${shlibs:Depends}, UPPER", "t", "n")
    return _part(spark, d).select("p_partkey", names.depends_names(t).alias("found"))


@query("SELECT p_partkey, p_size || '.41' AS plain, '1.' || p_size AS packed FROM part")
def f21_upstream_versions(spark, d):
    return table(spark, d, "part").select("p_partkey", names.upstream_version(F.format_string("1:%d.41-12", "p_size")).alias("plain"), names.upstream_version(F.format_string("1.%d+dfsg1~x-3", "p_size")).alias("packed"))


@query("SELECT p_partkey, '10.' || (p_size + 100) AS glued, '8.' || (p_size + 100) || '.1' AS underscored, '2.' || (p_size + 100) || '.3' AS dashed, '20240702' AS dated FROM part")
def f22_version_candidates(spark, d):
    core = lambda f: names.version_core(F.format_string(f, F.col("p_size") + 100))
    dated = names.version_candidates(F.lit("2024-07-02"))
    return table(spark, d, "part").select("p_partkey", core("pcre2-10.%d").alias("glued"), core("curl-8_%d_1").alias("underscored"), core("VER-2-%d-3").alias("dashed"), F.element_at(dated, -1).alias("dated"))


@query(f"SELECT p_partkey, 'sourceware.example/' || n AS node, 'gl.example/a/' || t AS deep FROM {_PART}")
def f23_forge_nodes(spark, d):
    return _part(spark, d).select("p_partkey", uris.forge_node(F.format_string("https://sourceware.example/git/%s.git", "n")).alias("node"), uris.forge_node(F.format_string("http://gl.example/a/%s/", "t")).alias("deep"))


@query()
def f24_first_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_paragraph(F.col("text")).alias("paragraph"))


@query("SELECT p_partkey, p_name || ' for x' AS text FROM part")
def f25_without_formulas(spark, d):
    return table(spark, d, "part").select("p_partkey", text.without_formulas(F.concat(F.lit("[Venue 2024] Official PyTorch implementation of:  "), "p_name", F.lit("  for x"))).alias("text"))


@query()
def f26_subject_texts(spark, d):
    topics = data.repo_topics(spark, d).groupBy("repo").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    p = data.pages(spark, d).select("repo", "description")
    docs = table(spark, d, "documents").where("repo is not null and text is not null")
    para = docs.groupBy(F.lower("repo").alias("repo")).agg(F.min_by(text.first_paragraph(F.col("text")), "doc_id").alias("paragraph"))
    first = resolve.first_n(docs.where("lower(source) = 'issue'").withColumn("repo", F.lower("repo")), ["repo"], [F.col("doc_id")], 20)
    titles = first.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.substring_index("text", "\n", 1).alias("t")))).alias("i"))
    j = p.join(topics, "repo", "left").join(para, "repo", "left").join(titles, "repo", "left")
    return j.select("repo", text.subject_text(F.col("description"), F.col("topics"), F.col("paragraph"), F.transform("i", lambda x: x["t"])).alias("text"))


@query(
    """SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9]{2,}'), lambda x: lower(x)), lambda w: w NOT IN ("""
    + ",".join(f"'{w}'" for w in text.STOPWORDS)
    + """))) AS n FROM documents WHERE text IS NOT NULL"""
)
def f28_tokens(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


_TERMS = (
    """WITH w AS (SELECT source AS class, lower(unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9]{2,}'))) AS term FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
    c AS (SELECT class, term, count(*) AS c FROM w WHERE term NOT IN ("""
    + ",".join(f"'{w}'" for w in text.STOPWORDS)
    + """) GROUP BY ALL), s AS (SELECT class, sum(c) AS n FROM c GROUP BY 1), a AS (SELECT avg(n) AS a FROM s), t AS (SELECT term, sum(c) AS t FROM c GROUP BY 1),
    x AS (SELECT c.class, c.term, c.c / s.n * ln(1 + a.a / t.t) AS score FROM c JOIN s ON s.class = c.class JOIN t ON t.term = c.term, a),
    r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, term DESC) AS rank FROM x QUALIFY rank <= 8)"""
)


@query(_TERMS + " SELECT class, term, round(score, 6) AS score, rank FROM r")
def a20_class_terms(spark, d):
    t = labels.class_terms(table(spark, d, "documents").select(F.col("source").alias("class"), "text"), "class", "text")
    return t.select("class", "term", F.round("score", 6).alias("score"), "rank")


@query(_TERMS + " SELECT class, string_agg(upper(term[1]) || term[2:], ' ' ORDER BY rank) AS label FROM r WHERE rank <= 3 GROUP BY 1")
def f29_labels(spark, d):
    docs = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("class"), "text")
    return labels.labels(labels.class_terms(docs, "class", "text"), docs, "class")


@query("SELECT DISTINCT event_type, upper(event_type[1]) || event_type[2:] AS label FROM events")
def f29_sanitized(spark, d):
    raw = F.concat(F.lit('\n  "'), F.initcap("event_type"), F.lit('`. \nsecond'))
    return table(spark, d, "events").select("event_type").distinct().select("event_type", text.sanitized_label(raw).alias("label"))


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS double[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS double[])), 6) AS cos FROM embeddings")
def f32_cosine(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(one).select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("q")), 6).alias("cos"))


QUERIES, ORACLES = Q, SQL
