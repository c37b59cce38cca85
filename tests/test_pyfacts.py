import ast

from codeloom.operators import pyfacts, security
from codeloom.sources.corpus import from_bytes

SOURCE = '''
import os, os.path as p
from a.b import c, d as e
from . import sibling
from ..up import *

class A:
    def m(self, x):
        if x and y or z:
            pass
        elif x:
            for i in x:
                while i: pass
        def inner():
            try:
                with x as f: open(f)
            except E:
                pass
        return [i for i in x if i]

async def skipped():
    if x: eval("1")

os.exec(x)
compile("x")
'''


def facts(corpus, texts):
    return pyfacts.python_facts(corpus(texts)).cache()


def test_counts_imports_and_dependencies(corpus):
    files = corpus({"s.py": SOURCE})
    found = pyfacts.python_facts(files)
    row = pyfacts.file_stats(files, found).first()
    assert (row["class_count"], row["function_count"], row["import_count"]) == (1, 2, 4)
    names = sorted(r["name"] for r in found.filter("fact = 'import_name'").collect())
    assert names == [".sibling", "a.b.c", "a.b.d", "os", "os.path", "up.*"]
    targets = sorted(r["target"] for r in pyfacts.import_edges(found).collect())
    assert targets == ["a.b", "a.b.c", "a.b.d", "os", "os.path", "sibling", "up", "up.*"]


def walk_complexity(source):
    out = {}
    for function in ast.walk(ast.parse(source)):
        if isinstance(function, ast.FunctionDef):
            score = 1
            for node in ast.walk(function):
                score += isinstance(node, (ast.If, ast.While, ast.For, ast.Try, ast.With))
                score += len(node.values) - 1 if isinstance(node, ast.BoolOp) else 0
            out[function.name] = score
    return out


def test_complexity_counts_nested_functions_twice(corpus):
    scored = {r["name"]: r["complexity"] for r in
              pyfacts.function_complexity(facts(corpus, {"s.py": SOURCE})).collect()}
    assert scored == walk_complexity(SOURCE) == {"m": 9, "inner": 3}


def test_dangerous_calls_by_bare_name(corpus):
    found = pyfacts.dangerous_calls(facts(corpus, {"s.py": SOURCE})).orderBy("line").collect()
    assert [(r["rule_id"], r["line"], r["code"]) for r in found] == [
        ("py_open", 16, None), ("py_eval", 22, None), ("py_compile", 25, None),
    ]


def test_errors_do_not_stop_the_job(spark):
    rows = [(1, "bad.py", b"x = (\n"), (1, "nul.py", b"x\x00"), (1, "latin.py", b"# \xe9\n"),
            (1, "deep.py", b"(" * 5000 + b")" * 5000), (1, "ok.py", b"x = 1"), (1, "warn.py", b"'\\d'")]
    files = from_bytes(spark.createDataFrame(rows, "repo_id long, path string, bytes binary"))
    found = pyfacts.python_facts(files)
    errors = {r["path"]: r for r in pyfacts.errors(found).collect()}
    assert set(errors) == {"bad.py", "nul.py", "latin.py", "deep.py"}
    assert errors["bad.py"]["line"] == 1 and "was never closed" in errors["bad.py"]["message"]
    assert {r["path"] for r in pyfacts.parsed_files(found).collect()} == {"ok.py", "warn.py"}


def test_findings_of_all_languages(corpus):
    files = corpus({
        "a.js": "x.INNERHTML = 1; eval (y)\n\n  setTimeout( 'z')  ",
        "b.cs": 'var Password = "a"; system.io.file.delete(x);\npassword = b;',
        "C.java": "new Random(); new random();\nnew FileInputStream(\nx)",
        "d.go": 'fmt.Printf("%s", x)\nfmt.Print(a, "%s")\nexec.Command ("x")',
        "e.py": "eval('1')\n",
    })
    rows = security.findings(files, pyfacts.python_facts(files)).collect()
    found = sorted((r["path"], r["line"], r["rule_id"], r["code"]) for r in rows)
    assert found == [
        ("C.java", 1, "java_random", "new Random(); new random();"),
        ("a.js", 1, "js_eval", "x.INNERHTML = 1; eval (y)"),
        ("a.js", 1, "js_inner_html", "x.INNERHTML = 1; eval (y)"),
        ("a.js", 3, "js_timeout_string", "setTimeout( 'z')"),
        ("b.cs", 1, "cs_file_delete", 'var Password = "a"; system.io.file.delete(x);'),
        ("b.cs", 1, "cs_password", 'var Password = "a"; system.io.file.delete(x);'),
        ("d.go", 1, "go_printf", 'fmt.Printf("%s", x)'),
        ("d.go", 3, "go_command", 'exec.Command ("x")'),
        ("e.py", 1, "py_eval", None),
    ]
    assert {r["severity"] for r in rows} == {"medium"}
    totals = {r["language"]: r["total_issues"] for r in
              security.totals(security.findings(files, pyfacts.python_facts(files))).collect()}
    assert totals == {"javascript": 3, "csharp": 2, "java": 1, "go": 2, "python": 1}
