import json

from codeloom.sources import corpus as C
from codeloom.sources import logs, manifests


def packages(df):
    return sorted(r["package"] for r in df.collect())


def test_trees_keep_hidden_names_and_bad_bytes(spark, tmp_path):
    root = tmp_path / "repo"
    for name, data in {
        "src/__init__.py": b"x = 1\r\ny = 2\r",
        "src/_private.py": b"",
        ".env": b"PORT=1\n",
        "Dockerfile": b"FROM x\n",
        "bad.go": b"package ma\xffin\n",
        "venv/lib/skip.py": b"z = 1\n",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    roots = spark.createDataFrame([(5, str(root))], "repo_id long, root string")
    files = {r["path"]: r for r in C.read_trees(spark, roots).collect()}
    assert set(files) == {
        "src/__init__.py", "src/_private.py", ".env", "Dockerfile", "bad.go", "venv/lib/skip.py",
    }
    assert files["src/__init__.py"]["content"] == "x = 1\ny = 2\n"
    assert files["bad.go"]["content"] == "package main\n"
    assert not files["bad.go"]["is_utf8"] and files["src/_private.py"]["is_utf8"]
    assert files[".env"]["content"] is None  # no analysis reads its text
    tree = C.read_trees(spark, roots)
    scanned = {r["path"] for r in C.analysed_files(tree).collect()}
    assert scanned == {"src/__init__.py", "src/_private.py"}
    everything = {r["path"] for r in C.analysed_files(tree, readable_only=False).collect()}
    assert everything == scanned | {"bad.go"}


def test_scans_and_discovery(corpus):
    files = corpus({
        p: "" for p in (
            "a.h", "b.c", "c.hpp", "x.mjs", "node_modules/n.js", "deep/bin/z.cs", "bin.cs",
            "target/T.java", "vendor/v.go", "w.py", "env/e.py", "envs/f.py", "notes.txt", ".py",
        )
    })
    found = {r["path"]: r["language"] for r in C.discovered_files(files).collect()}
    assert found == {
        "a.h": "cpp", "b.c": "c", "c.hpp": "cpp", "x.mjs": "javascript", "bin.cs": "csharp",
        "vendor/v.go": "go", "w.py": "python", "env/e.py": "python", "envs/f.py": "python",
        ".py": "python",
    }
    scanned = {r["path"]: r["language"] for r in C.analysed_files(files).collect()}
    assert scanned == {
        "x.mjs": "javascript", "bin.cs": "csharp", "w.py": "python", "envs/f.py": "python",
        ".py": "python",
    }
    assert {r["path"] for r in C.analysed_files(files, "go", "java").collect()} == set()


def test_resources_are_not_pruned(corpus):
    files = corpus({p: "" for p in (".env", "node_modules/a.json", "d.sql", "e.txt", "f.config")})
    kinds = {r["path"]: r["resource_type"] for r in C.resource_files(files).collect()}
    assert kinds == {
        ".env": "configuration", "node_modules/a.json": "configuration", "d.sql": "data",
        "f.config": "configuration",
    }


def test_npm(corpus):
    good = {"dependencies": {"a": "1"}, "devDependencies": {"b": "1", "a": "2"},
            "peerDependencies": {"c": "*"}, "other": {"d": "1"}}
    files = corpus([
        (1, "package.json", json.dumps(good)), (2, "package.json", "{oops"),
        (3, "web/package.json", json.dumps(good)), (4, "package.json", "{}"),
    ])
    assert [(r["repo_id"], r["package"]) for r in
            manifests.npm_packages(files).orderBy("package").collect()] == [(1, "a"), (1, "b"), (1, "c")]


def test_nuget_tree_and_fallback(corpus):
    files = corpus({
        "a.csproj": '<Project><!-- <PackageReference Include="C"/> --><Choose><When>'
                    "<PackageReference Version='2' Include='D&amp;E'/></When></Choose></Project>",
        "b.csproj": '<Project><PackageReference Include="Bad"></Project>',
        "c.csproj": '<Project xmlns="http://x"><PackageReference Include="Spaced"/></Project>',
        "d.csproj": '<Project></Project><PackageReference Include="After"',
        "e.sln": 'x <PackageReference   Include="Sln"',
        "f.txt": '<PackageReference Include="No"/>',
    })
    assert packages(manifests.nuget_packages(files)) == ["After", "Bad", "D&E", "Sln"]


def test_maven(corpus):
    ns = 'xmlns="http://maven.apache.org/POM/4.0.0"'
    body = ("<dependencies><dependency><artifactId>a</artifactId><groupId>g</groupId>"
            "<version>1</version><exclusions><exclusion><groupId>x</groupId></exclusion></exclusions>"
            "</dependency><dependency><groupId>h</groupId><artifactId>b</artifactId></dependency>"
            "<dependency><groupId>only</groupId></dependency></dependencies>")
    files = corpus([
        (1, "pom.xml", f"<project {ns}><profiles>{body}</profiles></project>"),
        (2, "pom.xml", f"<project>{body}</project>"),
        (3, "pom.xml", f"<project {ns}>{body}"),
        (4, "sub/pom.xml", f"<project {ns}>{body}</project>"),
    ])
    assert packages(manifests.maven_packages(files)) == ["g:a:1", "h:b"]


def test_gradle_prefix_quirk(corpus):
    files = corpus({"build.gradle": "implementation 'a:b:1'\nxapi \"c\"\nruntimeOnly 'd'\ntestCompile 'e'"})
    assert packages(manifests.gradle_packages(files)) == ["a:b:1", "c"]


def test_go_mod_block_quirk(corpus):
    text = "module m\n\ngo 1.20\n\nrequire x/y v1.0.0\nrequire (\n\ta/b v1.2.3\n\tc/d v0.1.0 // indirect\n)\n"
    files = corpus({"go.mod": text})
    assert packages(manifests.go_modules(files)) == ["(@a/b", "x/y@v1.0.0"]
    assert packages(manifests.go_modules(files, strict=True)) == [
        "a/b@v1.2.3", "c/d@v0.1.0", "x/y@v1.0.0",
    ]


def test_build_logs(spark):
    rows = [
        ("tsc", " a.ts(1,1): error TS1: x "), ("tsc", "error CS1"), ("dotnet", "error CS1"),
        ("maven", "[ERROR] x"), ("maven", "error"), ("gradle", "A: Error: b"), ("gradle", "errors"),
        ("go build", "# pkg"), ("go build", "  "), ("go build", " x.go:1: bad "), ("go vet", "v"),
    ]
    lines = spark.createDataFrame(
        [(1, t, i, line) for i, (t, line) in enumerate(rows)],
        "repo_id long, tool string, line_no long, line string",
    )
    got = [r["message"] for r in logs.build_errors(lines).orderBy("line_no").collect()]
    assert got == ["a.ts(1,1): error TS1: x", "error CS1", "[ERROR] x", "A: Error: b",
                   "build: x.go:1: bad", "vet: v"]


def test_log_folder(spark, tmp_path):
    folder = tmp_path / "repo_id=3" / "tool=tsc"
    folder.mkdir(parents=True)
    (folder / "a.log").write_text("ok\nx error TS9\n")
    found = logs.build_errors(logs.read_logs(spark, str(tmp_path))).collect()
    assert [(r["repo_id"], r["tool"], r["message"]) for r in found] == [(3, "tsc", "x error TS9")]


def test_log_line_numbers_count_inside_a_file(spark, tmp_path):
    folder = tmp_path / "repo_id=3" / "tool=tsc"
    folder.mkdir(parents=True)
    (folder / "a.log").write_text("one\ntwo\n")
    (folder / "b.log").write_bytes(b"three\r\n\r\nfour")
    got = logs.read_logs(spark, str(tmp_path)).collect()
    assert sorted((r["log_file"][-5:], r["line_no"], r["line"]) for r in got) == [
        ("a.log", 1, "one"), ("a.log", 2, "two"), ("b.log", 1, "three"), ("b.log", 2, ""), ("b.log", 3, "four"),
    ]


def test_package_json_is_read_strictly(spark, corpus):
    texts = {
        1: "{'dependencies': {'a': '1'}}",
        2: '{"dependencies": {"b": "1"}} x',
        3: '{"dependencies": {"c": "1"}, "devDependencies": {"d": "1"',
        4: '{"dependencies": ["q"], "devDependencies": {"e": "1"}}',
        5: '{"dependencies": null, "devDependencies": {"f": "1"}}',
        6: '["dependencies"]',
        7: '{"dependencies": {"g": "1"}, "devDependencies": 3, "peerDependencies": {"h": "1"}}',
        8: '{"dependencies": {"i": "1"}, "devDependencies": {"react": "1", "i": "2"}, "peerDependencies": {"j": "1"}}',
        9: "",
        10: '{"dependencies": {"k": NaN}}',
    }
    files = corpus([(k, "package.json", t) for k, t in texts.items()])
    got = sorted((r["repo_id"], r["package"]) for r in manifests.npm_packages(files).collect())
    assert got == [(7, "g"), (8, "i"), (8, "j"), (8, "react"), (10, "k")]
    stacks = {r["repo_id"]: sorted(r["stack"]) for r in manifests.package_json(files).collect()}
    assert {k: v for k, v in stacks.items() if v} == {8: ["i", "react"], 10: ["k"]}


def test_kinds(spark, corpus):
    from pyspark.sql import functions as F

    names = {
        "a/b.py": "python", "x.tsx": "javascript", "m.go": "go", "c.rs": "rust", "d.h": "cpp", "package.json": "manifest",
        "s/App.csproj": "manifest", "conf/x.json": "configuration", ".env": "configuration", "d.csv": "data",
        "README": "other", "Dockerfile": "other",
    }
    files = corpus(dict.fromkeys(names, ""))
    assert {r["path"]: r["kind"] for r in files.select("path", F.col("kind")).collect()} == names


def test_one_language_reads_its_partition_only(spark, tmp_path, corpus):
    """The kind of a stored corpus is a partition column."""
    from codeloom.operators import complexity

    corpus({"a.py": "x = 1", "b.go": "package b", "c.js": "let x", "package.json": "{}"}).write.partitionBy("kind").parquet(
        str(tmp_path / "files")
    )
    stored = spark.read.schema("repo_id long, path string, content string, is_utf8 boolean, kind string").parquet(
        str(tmp_path / "files")
    )
    for frame in (manifests.npm_packages(stored), manifests.go_modules(stored), complexity.brace_function_complexity(stored, "javascript")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(kind" in plan or "PartitionFilters: [kind" in plan, plan
