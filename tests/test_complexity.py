"""Function bodies and complexity against a direct scan of the text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom import rules
from codeloom.operators import complexity, pyfacts

PIECES = {
    "javascript": ["function f(a) {", "g: function(x) {", "h = function () {", "k = (a, b) => {",
                   "a = function b(c = {}) {", "if (x) ", "? y : z", "?\n w\n:", "&& ", "|| ",
                   "{", "}", "}", "}", "\n", "'}'", "é", "for(", "switch (a) {", "catch (e) {"],
    "csharp": ["public static int F(int x) {", "void G()\n{", "if (x) {", "foreach (a) {", "? a",
               "??", "?.b", "{", "}", "}", "}", "\n", " while (x) ", "&&", "||", "override int H (a) {"],
    "java": ["public static int f(int x) throws E, F {", "void g() {", "else if (y) {", "for (;;) {",
             "x ? y : z;", "{", "}", "}", "}", "\n", "&&", "||", "catch (E e) {", "@A void h(){"],
    "go": ["func f(a int) int {", "func (r *T) g() (int, error) {", "if x {", "for i := range y {",
           "case 1:", "select {", "switch x {", "{", "}", "}", "}", "\n", "&&", "||", "func h(x"],
}
SUFFIX = {"javascript": "js", "csharp": "cs", "java": "java", "go": "go"}


def expected(language, content):
    """(name, type, complexity) of each function, by walking the characters."""
    rows = []
    for header, kind in rules.FUNCTION_HEADERS[language]:
        for match in re.finditer(header.text, content):
            start, depth, end = match.end() - 1, 0, None
            for place in range(start, len(content)):
                depth += {"{": 1, "}": -1}.get(content[place], 0)
                if depth == 0:
                    end = place
                    break
            if language == "csharp":
                body = "" if end is None else content[start + 1 : end]
            else:
                body = content[start : (start + 1 if end is None else end) + 1]
            marks = sum(len(re.findall(p.text, body)) for p in rules.DECISIONS[language])
            rows.append((match.group(1), kind, 1 + marks))
    return sorted(rows)


@pytest.mark.parametrize("language", list(PIECES))
def test_random_sources(spark, corpus, language):
    rng = random.Random(language)
    texts = {
        f"f{i}.{SUFFIX[language]}": "".join(rng.choices(PIECES[language], k=rng.randint(0, 60)))
        for i in range(300)
    }
    got: dict = {}
    for row in complexity.brace_function_complexity(corpus(texts), language).collect():
        got.setdefault(row["path"], []).append((row["name"], row["fn_type"], row["complexity"]))
    for path, content in texts.items():
        assert sorted(got.get(path, [])) == expected(language, content), content


def test_all_languages_in_one_pass(corpus):
    texts = {f"f.{SUFFIX[n]}": "".join(p) for n, p in PIECES.items()}
    rows = complexity.brace_function_complexity(corpus(texts)).collect()
    for language in PIECES:
        path = f"f.{SUFFIX[language]}"
        got = sorted((r["name"], r["fn_type"], r["complexity"]) for r in rows if r["path"] == path)
        assert got == expected(language, texts[path])


def test_large_file(corpus):
    count = 3000
    content = "".join(f"function f{i}(a) {{ if (a) {{ a && b; }} }}\n" for i in range(count))
    found = complexity.brace_function_complexity(corpus({"big.js": content}), "javascript")
    assert found.groupBy("complexity").count().collect() == [(3, count)]


def test_roll_ups(corpus):
    files = corpus({
        "a.js": "function f() { if (a) {} }", "b.js": "", "c.py": "def f():\n    pass\n", "d.py": "x = (",
    })
    facts = pyfacts.python_facts(files)
    totals = {r["path"]: r["total_complexity"] for r in
              complexity.file_complexity(files, facts).collect()}
    assert totals == {"a.js": 3, "b.js": 1, "c.py": 2}
    repo = {r["language"]: r["total_complexity"] for r in
            complexity.repo_complexity(files, facts).collect()}
    assert repo == {"javascript": 4, "python": 2}


def test_buckets_and_threshold(spark):
    scored = spark.createDataFrame(
        [("x", n) for n in (1, 5, 6, 10, 11, 40)], "language string, complexity long"
    )
    rows = complexity.complexity_buckets(scored).filter("bucket IS NOT NULL").collect()
    assert {r["bucket"]: r["functions"] for r in rows} == {
        "Low (1-5)": 2, "Medium (6-10)": 2, "High (11+)": 2,
    }
    assert complexity.high_complexity(scored).agg(F.min("complexity")).first()[0] == 11
