from codeloom.operators import dependencies, pyfacts, stats
from codeloom.sources import logs


def names(df, kind):
    return sorted(r["name"] for r in df.collect() if r["kind"] == kind)


def test_js(corpus):
    files = corpus({"a.ts": (
        "import a from 'x'; import {\n b\n} from 'multi';\nimport 'side'; const q = require('x');\n"
        "function f (a) {} const g = function (x) {}; o = { h: function() {} }; const k = (a) => 1;\n"
        "const f = (z) => 2; class C {} class C {}\n"
        "export { a, b , c }; export { d }\nexport {e}\nmodule.exports = f\nexport const z = 1"
    )})
    found = stats.declarations(files, "javascript")
    assert names(found, "function") == ["f", "g", "h", "k"]
    assert names(found, "class") == ["C", "C"]
    assert names(found, "import") == ["side", "x"]
    # The braces pattern: its first match has a comma, so the others are dropped.
    assert names(found, "export") == ["a", "b", "c", "f", "z"]


def test_js_exports_without_comma_keep_blanks(corpus):
    files = corpus({"a.js": "export { solo }\nexport { a, b }"})
    assert names(stats.declarations(files, "javascript"), "export") == ["a, b ", "solo "]


def test_csharp_method_quirk(corpus):
    files = corpus({"a.cs": (
        "using System.Linq;\npublic sealed class A { int P { get; set; }\n interface I {}\n"
        "public static int M(int x) { if (x) { return Add(x); } else if (y) { } } }"
    )})
    found = stats.declarations(files, "csharp")
    assert names(found, "method") == ["Add", "M", "if"]
    assert names(found, "property") == ["P"]
    assert names(found, "using") == ["System.Linq"]
    row = stats.file_stats(files, "csharp").first()
    assert (row["class_count"], row["interface_count"], row["method_count"], row["loc"]) == (1, 1, 3, 4)


def test_java(corpus):
    files = corpus({"A.java": (
        "import java.util.*;\nimport static a.B.c;\nclass A { private int n = 1;\n"
        "void m() throws X, Y { return x; } else if (z) { } void abstractOne(); }"
    )})
    found = stats.declarations(files, "java")
    assert names(found, "method") == ["if", "m"]
    assert names(found, "field") == ["n", "x"]
    assert names(found, "import") == ["a.B.c", "java.util.*"]


def test_go_imports(corpus):
    files = corpus({"a.go": (
        'package p\nimport "fmt"\nimport q "aliased"\nimport (\n "os"\n x "net/http" // "c"\n "open\n)\n'
        "func (r *T) Do(a int) {}\nfunc Run() {}\ntype T struct {}\ntype I interface {}\n"
    )})
    found = stats.declarations(files, "go")
    assert names(found, "import") == ["c", "fmt", "net/http", "os"]
    assert names(found, "function") == ["Do", "Run"]


def test_import_edges_keep_empty_js_and_java_only(corpus):
    files = corpus({p: "" for p in ("a.js", "B.java", "c.cs", "d.go", "e.py")})
    edges = dependencies.import_edges(files, pyfacts.python_facts(files)).collect()
    assert sorted((r["path"], r["target"]) for r in edges) == [("B.java", None), ("a.js", None)]


def test_module_map_quirk(corpus):
    files = corpus({"src/pylib/x.py": "", "pkg/__init__.py": ""})
    modules = {r["path"]: r["module"] for r in dependencies.module_map(files).collect()}
    assert modules == {"src/pylib/x.py": "srclib.x", "pkg/__init__.py": "pkg.__init__"}
    strict = {r["path"]: r["module"] for r in dependencies.module_map(files, strict=True).collect()}
    assert strict["src/pylib/x.py"] == "src.pylib.x"


def test_internal_edges_stay_inside_a_repository(corpus):
    files = corpus([
        (1, "a.py", "import lib.b\nfrom lib import b, c\n"), (1, "lib/b.py", ""),
        (2, "lib/c.py", ""), (2, "a.py", "import lib.b"),
    ])
    edges = dependencies.internal_edges(files, pyfacts.python_facts(files)).collect()
    assert [(r["repo_id"], r["source_file"], r["target_file"]) for r in edges] == [(1, "a.py", "lib/b.py")]


def test_top_imports_ties_by_name(corpus):
    files = corpus({"a.js": "require('b'); require('a')", "b.js": "require('b'); require('c')"})
    best = dependencies.top_imports(dependencies.pattern_import_edges(files), 2).orderBy("rank").collect()
    assert [(r["target"], r["importers"]) for r in best] == [("b", 2), ("a", 1)]


def test_dependency_totals(corpus):
    files = corpus({"package.json": '{"dependencies": {"x": "1", "y": "1"}}', "a.js": "require('z')"})
    row = dependencies.dependency_totals(files, pyfacts.python_facts(files)).first()
    assert (row["total_dependencies"], row["total_packages"]) == (1, 2)


def test_valid_files(spark, corpus):
    files = corpus([
        (1, "a.py", "x = ("), (1, "b.py", "x = 1"), (1, "c.js", "function ("), (1, "d.cs", ""),
        (2, "d.cs", ""), (1, "E.java", ""), (1, "f.go", ""),
    ])
    lines = spark.createDataFrame(
        [(1, "dotnet", 1, "error CS1"), (1, "gradle", 1, "error: x"), (1, "go vet", 1, "bad")],
        "repo_id long, tool string, line_no long, line string",
    )
    rows = stats.valid_files(files, logs.build_errors(lines), pyfacts.python_facts(files)).collect()
    assert {(r["repo_id"], r["language"]): (r["total_files"], r["valid_files"]) for r in rows} == {
        (1, "python"): (2, 1), (1, "javascript"): (1, 1), (1, "csharp"): (1, 0),
        (2, "csharp"): (1, 1), (1, "java"): (1, 0), (1, "go"): (1, 1),
    }
