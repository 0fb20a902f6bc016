import pytest
from pyspark.sql import functions as F

from ravelin.functions import manifests as M
from ravelin.functions import names, paths, text, uris
from ravelin.operators import eav, resolve
from ravelin.sources import caches, exports, texts, triples


def values(spark, fn, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_triples(spark):
    lines = ['<s> <p> "a \\"b\\"" .', "<s> <p> <o>", '<s> <p> <o> .', '  <s> <p> "x"@en . ', '<s> <p> "1"^^<t> .', "junk .", None]
    got = triples.parse(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, value string"))
    assert sorted((r.line_no, r.o, r.kind) for r in got.collect()) == [(0, 'a \\"b\\"', "literal"), (2, "o", "uri"), (3, "x", "literal"), (4, "1", "literal")]


def test_triples_come_back_from_their_lines(spark):
    texts_ = ['"284"', "a\\", "\\n", "x\ny\r\tz", 'q"@en', '\\"', " ", "", "\\\\t"]
    t = spark.createDataFrame([(i, "s", "p", o, "literal") for i, o in enumerate(texts_)] + [(99, "s", "p", "u", "uri")], "line_no int, s string, p string, o string, kind string")
    lines = t.select("line_no", triples.render(F.col("s"), F.col("p"), F.col("o"), F.col("kind"), escaped=True).alias("value"))
    assert not any(c in r.value for r in lines.collect() for c in "\n\r")
    assert sorted(map(tuple, triples.parse(lines, escaped=True).select(t.columns).collect())) == sorted(map(tuple, t.collect()))
    broken = spark.createDataFrame([('<s> <p> ""284"" .',)], "value string")
    assert triples.parse(broken).count() == 0


def test_uri_parts(spark):
    assert values(spark, uris.short_predicate, "http://purl.org/dc/terms/title", "http://x/y#type") == ["title", "type"]
    assert values(spark, uris.is_forge_node, "gitlab.freedesktop.org/xorg/lib/libx11", "psf/black") == [True, False]
    assert values(spark, uris.forge_node, "https://sourceware.org/git/elfutils.git", "http://h.example") == ["sourceware.org/elfutils", "h.example"]
    assert values(spark, uris.module_repo, "github.com/aws/aws-sdk-go-v2/config", "github.com/x") == ["aws/aws-sdk-go-v2", None]
    assert values(spark, uris.reference_subject, "https://h/contributorreference/a/b/12") == ["https://h/repository/a/b"]
    rel = lambda u: uris.relative_repo(u, F.lit("o/r"))
    assert values(spark, rel, "../foo.git", "../../x/foo.git", "../../../x.git", "./sub") == ["o/foo", "x/foo", None, None]


def test_url_readings(spark):
    read = lambda k: lambda c: uris.repo_of_url(c, **uris.URL_READINGS[k])
    assert values(spark, read("pypi"), "https://github.com/a/b.git", "https://github.com/sponsors/x", "https://github.com/a/b/tree/main", "https://github.com/a/b#readme", "see https://github.com/a/b") == ["a/b", None, None, "a/b", None]
    assert values(spark, read("npm"), "a/b", "github:a/b", "git@github.com:a/b.git", "https://x/y") == ["a/b", "a/b", "a/b", None]
    assert values(spark, read("debian"), "https://github.com/a/b.git", "git@github.com:a/b") == ["a/b", None]


def test_names(spark):
    assert values(spark, names.normalized, "Typing_Extensions", "a.-_b") == ["typing-extensions", "a-b"]
    assert values(spark, names.requirement_name, "requests[socks]>=2 # c", "-r x.txt", "https://h/a.whl", "pkg @ https://h/a.whl", "") == ["requests", None, None, "pkg", None]
    assert values(spark, names.depends_names, "libfoo (>= 1.2) | libalt, libbar") == [["libfoo", "libbar"]]
    assert values(spark, names.upstream_version, "1:2.41-12", "1.2+dfsg-3") == ["2.41", "1.2"]
    got = values(spark, names.version_candidates, "pcre2-10.46", "curl-8_14_1", "VER-2-13-3", "2024-07-02", None)
    assert "10.46" in got[0] and "8.14.1" in got[1] and "2.13.3" in got[2] and "20240702" in got[3] and got[4] == []
    assert values(spark, names.name_variants, "libfoo-dev", "python3-x") == [["libfoo-dev", "libfoo", "foo-dev", "foo"], ["python3-x", "x"]]


def test_paths(spark):
    assert values(spark, paths.is_vendored, "vendor/a/go.mod", "vendor", "src/build/pom.xml", "a/target.txt") == [True, False, True, False]
    assert values(spark, paths.is_project_module, "a/pom.xml", "gradle/x/build.gradle", "x/src/integrationTest/pom.xml", "buildSrc/build.gradle") == [True, False, False, False]
    assert values(spark, paths.manifest_kind, "a/go.mod", "a/b") == ["go.mod", None]


def test_copied_manifests(spark):
    f = spark.createDataFrame([("r1", "x/requirements.txt", "h"), ("r2", "y/requirements.txt", "h"), ("r3", "requirements.txt", "h"), ("r1", "z/go.mod", "k")], "repo string, path string, hash string")
    assert sorted((r.repo, r.path) for r in resolve.own_manifests(f).collect()) == [("r1", "z/go.mod"), ("r3", "requirements.txt")]


def test_people(spark):
    assert values(spark, resolve.is_person, "ghost", "x[bot]", "https://h/bot/y", "ann") == [False, False, False, True]


def test_parsers():
    assert M.pyproject_specs("[broken") == [] and M.cargo_specs("x = [") == []
    got = M.cargo_specs('[dependencies]\na="1"\nb={path="x"}\nc={git="https://github.com/o/r"}\nd={package="real",version="1"}')
    assert [(g["package"], g["git"]) for g in got] == [("a", None), ("c", "https://github.com/o/r"), ("real", None)]
    assert M.go_requires("require (\ngithub.com/a/b v1\nx/y v1 // indirect\n)\nrequire z/w v2\n") == ["github.com/a/b", "z/w"]
    pom = "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency><dependency><groupId>t</groupId><artifactId>t</artifactId><scope>test</scope></dependency></dependencies></project>"
    assert M.pom_dependencies(pom) == [{"group": "g", "artifact": "a"}] and M.pom_dependencies("<x") == [] and M.pom_coordinate(pom) == []
    gradle = "dependencies {\n implementation \"g:a:1\"\n testImplementation \"g:t:1\"\n api group: 'h', name: 'b'\n}\nimplementation 'no:no:1'"
    assert [(d["group"], d["artifact"]) for d in M.gradle_dependencies(gradle)] == [("g", "a"), ("h", "b")]
    assert M.gradle_dependencies("dependencies {}\napi 'a:b:1'") == []
    assert M.vcpkg_names('["x"]') == [] and M.vcpkg_names('{"dependencies":["fmt",{"name":"z","host":true},"vcpkg-cmake",{"name":"q"}]}') == ["fmt", "q"]
    assert M.conan_txt_names("[requires]\nfmt/1 # x\n[options]\na/1") == ["fmt"]
    assert M.conan_py_names('requires = "a/1", "b/2"\nself.requires("c/3")') == ["c", "a", "b"]
    assert M.submodules("") == [] and M.maven_versions("<a/>") == []


def test_requirements_and_priority(spark):
    df = spark.createDataFrame([("r", "d", "pyproject.toml", []), ("r", "d", "requirements.txt", ["a"]), ("r", "e", "pyproject.toml", ["b"]), ("r", "e", "requirements.txt", ["c"])], "repo string, dir string, kind string, deps array<string>")
    got = resolve.by_priority(df.where(F.size("deps") > 0), ["repo", "dir"], paths.kind_priority(F.col("kind")))
    assert sorted((r.dir, r.deps[0]) for r in got.collect()) == [("d", "a"), ("e", "b")]


def test_prose(spark):
    md = "# Title\n[![b](x)](y)\n\nshort line\n\n```\ncode here\n```\nThis is **the** [first](http://x) real paragraph of\n## not a break\nprose, with enough plain words.\n\nOther."
    assert values(spark, text.first_paragraph, md, None, "a | b | c | d e f g h i j k l") == ["This is the first real paragraph of prose, with enough plain words.", "", ""]
    assert values(spark, text.without_formulas, "[EMNLP 2024] Official PyTorch implementation of: Fast Things") == ["Fast Things"]
    assert values(spark, text.tokens, "The Fast v2 GPU-lib for it lib") == [["fast", "gpu", "lib", "lib"]]
    assert values(spark, text.sanitized_label, '"A label."\nmore', " ", "x" * 60) == ["A label", None, None]
    df = spark.createDataFrame([([],), (["foo", "bAR", "baz", "q"],), (None,)], "t array<string>")
    assert [r.l for r in df.select(text.heuristic_label(F.col("t")).alias("l")).collect()] == ["Miscellaneous", "Foo Bar Baz", "Miscellaneous"]
    import hashlib

    assert values(spark, lambda c: text.pseudonym(c, "s"), "ann", None) == ["person-" + hashlib.blake2b(b"s:ann", digest_size=16).hexdigest()[:12], None]


def test_caches(spark):
    assert values(spark, caches.lookup_state, '{"_404": true}', '{"a": 1}', "{bad", None, "{}") == ["absent", "resolved", "failed", "failed", "absent"]
    assert values(spark, caches.is_retryable, "fatal: early EOF", "repository not found", None) == [True, False, False]
    a = spark.createDataFrame([("x", None), ("y", "p")], "k string, v string")
    b = spark.createDataFrame([("x", "f"), ("z", "g")], "k string, v string")
    assert sorted((r.k, r.v, r.origin) for r in caches.preferred(a, b, ["k"], "v").collect()) == [("x", None, "primary"), ("y", "p", "primary"), ("z", "g", "fallback")]


def test_text_files(spark, tmp_path):
    (tmp_path / "list").write_text("a b # c\n# only\nx y\nlone\n")
    got = texts.read_commented(spark, str(tmp_path / "list"), ["k", "v"])
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", "b"), ("x", "y")]
    (tmp_path / "index").write_text("Package: a\nDepends: b,\n c\n\nPackage: d\n")
    rows = texts.read_stanzas(spark, str(tmp_path / "index")).collect()
    assert sorted(r.fields["Package"] for r in rows) == ["a", "d"] and rows[0].fields["Depends"] == "b, c"
    (tmp_path / "t.tsv").write_text("n\thttps://x\n")
    assert texts.read_tsv(spark, str(tmp_path / "t.tsv"), "node string, origin string").first().origin == "https://x"
    t = spark.createDataFrame([("s", "p", "o", "uri"), ("s", "p", "l", "literal")], "s string, p string, o string, kind string")
    triples.write_lines(t, str(tmp_path / "nt"))
    back = triples.parse(triples.read_lines(spark, str(tmp_path / "nt")))
    assert sorted((r.o, r.kind) for r in back.collect()) == [("l", "literal"), ("o", "uri")]
    e = spark.createDataFrame([("a", "b", 2, ["m"])], "a string, b string, w long, members array<string>")
    assert [r.value for r in exports.edge_lines(e).collect()] == ['["a","b",2,["m"]]']
    exports.write_tier(e, e, str(tmp_path / "tier"))
    assert spark.read.parquet(str(tmp_path / "tier/pruned")).count() == 1


@pytest.mark.parametrize("raw,want", [("1,395", 1395), ("17,730,731", 17730731), ("+3", 3), ('"2"', 2), ("9.0", 9), ("5^^http://x#integer", 5), ('"7"^^<t>', 7), (" 12 ", 12), ("1e3", 1000), ("1.5e1", 15), ("-0", 0), ("00012", 12), ("-1", None), ("3.7", None), ("1.2.3", None), ("10k+", None), ("", None), (" ", None), ("NaN", None), ("99999999999999999999", None), ("1,23", None), (None, None)])
def test_whole_numbers(spark, raw, want):
    assert values(spark, eav.whole_number, raw) == [want]


def test_wide_rows(spark):
    sch = "line_no long, s string, p string, o string, kind string, loaded_at long, repo string, stargazers long"
    b, q = "https://h/repository/", "https://h/property/"
    rows = [
        (1, b + "A/x", q + "hasTotalStargazers", "5", "literal", 1, "r", 0),
        (9, b + "a/X/", q + "hasTotalStargazers", "many", "literal", 1, "r", 0),
        (4, "http://h/repository/a/x", "http://n#hasTotalStargazers", "7", "literal", 1, "r", 0),
        (4, "http://h/repository/a/x", "http://n#hasTotalStargazers", "7", "literal", 1, "r", 0),
        (5, b + "a/x", q + "hasTotalStargazersLastYear", "9", "literal", 1, "r", 0),
        (6, b + "a/x", q + "hasTotalForks", "1", "uri", 1, "r", 0),
        (7, "https://h/issue/a/x/1", q + "hasTotalForks", "1", "literal", 1, "r", 0),
        (8, b + "b/y", q + "hasTotalOpenIssues", "0.0", "literal", None, "r", 0),
        (10, None, q + "hasTotalForks", "1", "literal", 1, "r", 0),
        (11, b + "a/x", None, "1", "literal", 1, "r", 0),
    ]
    df = spark.createDataFrame(rows, sch)
    got = {r.repo: tuple(r)[1:] for r in eav.repo_counts(df).collect()}
    assert got == {"a/x": (7, None, None, None), "b/y": (None, None, None, 0)}
    assert eav.repo_counts(df.where("line_no < 0")).count() == 0
    assert sorted((r.repo, r.field, r.value) for r in eav.cells(eav.repo_counts(df), "repo", ["stargazers", "open_issues"]).collect()) == [("a/x", "stargazers", 7), ("b/y", "open_issues", 0)]
