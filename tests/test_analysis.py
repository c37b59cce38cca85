import os

import pytest

from codeloom import rules
from codeloom.plans import analysis


FILES = {
    "a.py": "import os\ndef f(x):\n    return eval(x) if x else 1\n", "p/b.js": "const f = () => { if (a) {} }",
    "C.cs": "using X; class C { }", "D.java": "package d; class DFactory {}", "e.go": "package e\nfunc F() {}",
    "package.json": '{"dependencies": {"react": "1"}}', "go.mod": "require a/b v1.0.0",
}


@pytest.mark.parametrize("language", list(rules.LANGUAGE_SCANS))
def test_every_analysis_of_every_language(corpus, language):
    results = analysis.analyse(corpus(FILES), language, [*rules.ANALYSIS_TYPES, "unknown"])
    assert list(results) == list(rules.ANALYSIS_TYPES)
    for tables in results.values():
        for table in tables.values():
            assert "repo_id" in table.columns
            table.collect()
    assert results["complexity_analysis"]["file_complexity"].count() == 1


def test_request_end_to_end(spark, corpus, tmp_path):
    written = analysis.run_request(
        corpus(FILES), ["python", "ts", "cobol"], ["syntax_analysis", "security_analysis"], str(tmp_path))
    shown = sorted(os.path.relpath(w, tmp_path) for w in written)
    assert "python/security_analysis/findings" in shown and "polyglot/cross_language/report" in shown
    assert not [s for s in shown if s.startswith("go")]
    report = spark.read.parquet(str(tmp_path / "polyglot/cross_language/report")).first()
    assert report["languages"] == 5 and report["architecture_style"] == "microservices"
    assert spark.read.parquet(str(tmp_path / "python/security_analysis/findings")).count() == 1


def test_a_request_parses_a_file_once(spark, corpus, tmp_path):
    """What several tables are made of is stored and read."""
    seen = []

    def keep(table, name):
        seen.append(name)
        table.write.parquet(str(tmp_path / f"{name}{len(seen)}"))
        return spark.read.schema(table.schema).parquet(str(tmp_path / f"{name}{len(seen)}"))

    for language in ("python", "go"):
        results = analysis.analyse(corpus(FILES), language, rules.ANALYSIS_TYPES, keep=keep)
        tables = {n: t for group in ("syntax_analysis", "complexity_analysis", "security_analysis") for n, t in results[group].items()}
        plans = {n: t._jdf.queryExecution().executedPlan().toString() for n, t in tables.items()}
        assert not [n for n, p in plans.items() if "MapInPandas" in p]
        assert "aggregate(" not in plans["functions"]
    assert seen == ["facts", "scored"]


def test_build_errors_give_valid_files(spark, corpus):
    errors = spark.createDataFrame([(1, "go build", 1, "build: x")], "repo_id long, tool string, line_no long, message string")
    tables = analysis.analyse(corpus(FILES), "go", ["syntax_analysis"], errors)["syntax_analysis"]
    assert tables["errors"].count() == 1 and [r["valid_files"] for r in tables["valid_files"].collect()] == [0]
    assert {r["name"] for r in tables["declarations"].collect()} >= {"F"}


def test_one_language_has_no_cross_language_rows(spark, corpus):
    files = corpus([
        (1, "a.py", "@app.route('/x')\ndef f(): pass\n"), (1, "Dockerfile", "FROM x"),
        (2, "a.py", "@app.route('/x')\ndef f(): pass\n"), (2, "b.go", "package b"), (2, "Dockerfile", "FROM x"),
    ])
    tables = analysis.cross_language(files)
    for name in ("http_apis", "build_dependencies"):
        assert {r["repo_id"] for r in tables[name].collect()} == {2}, name
    assert {r["repo_id"] for r in tables["message_queues"].collect()} <= {2}
