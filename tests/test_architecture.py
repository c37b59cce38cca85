import json

from codeloom.operators import architecture as A


def first(df):
    return df.first().asDict()


def test_mvc_names_may_be_in_different_files(corpus):
    files = corpus([(1, "Model.py", ""), (1, "x/views.py", ""), (1, "CONTROLLER.py", ""),
                    (2, "model.py", ""), (2, "view/x.py", ""), (2, "controller.js", "")])
    got = {r["repo_id"]: r["mvc_pattern"] for r in A.mvc_by_name(files).collect()}
    assert got == {1: True, 2: False}


def test_package_structure_leaves_out_the_root(corpus):
    rows = A.package_structure(corpus({"a.py": "", "x/b.py": "", "x/y/c.js": "", "x/d.py": ""})).collect()
    assert sorted((r["language"], r["dir"], r["files"]) for r in rows) == [
        ("javascript", "x/y", 1), ("python", "x", 2)]


def test_js_stack_order_and_peers(corpus):
    def stack(document):
        row = A.js_stack(corpus({"package.json": json.dumps(document)})).first()
        return row["framework"], row["testing_framework"], row["build_tool"]

    assert stack({"dependencies": {"express": "1", "vue": "1"}, "devDependencies": {
        "rollup": "1", "vite": "1", "mocha": "1"}}) == ("Vue.js", "Mocha", "Vite")
    assert stack({"peerDependencies": {"react": "1"}, "dependencies": {"@angular/core": "1"}}) == (
        "Angular", None, None)
    assert stack({}) == (None, None, None)


def test_module_system_looks_at_ten_files(corpus):
    files = {f"f{i:02}.js": "" for i in range(10)}
    assert first(A.js_module_system(corpus({**files, "g.js": "require('x')"})))["module_system"] is None
    files["f07.js"] = "module.exports = 1"
    files["f09.js"] = "import x"
    assert first(A.js_module_system(corpus(files)))["module_system"] == "CommonJS"
    files["f01.js"] = "require('x'); import y"
    assert first(A.js_module_system(corpus(files)))["module_system"] == "ES6 Modules"


def test_csharp_marks_fold_over_files(corpus):
    files = corpus({"a.cs": "namespace A.B { } namespace A.B {}", "b.cs": "class XRepository", "c.cs": "interface I"})
    row = first(A.csharp_arch(files))
    assert (row["mvc_pattern"], row["repository_pattern"], row["dependency_injection"]) == (False, True, False)
    assert first(A.csharp_namespaces(files))["files"] == 2


def test_java(corpus):
    files = corpus([
        (1, "pom.xml", ""), (1, "build.gradle", ""), (1, "src/A.java", "package a.b; package c;\n@ControllerAdvice"),
        (1, "src/B.java", "import jakarta.servlet.X; class WidgetFactory"), (2, "build.gradle", ""),
        (2, "A.java", ""), (3, "pom.xml", ""),
    ])
    got = sorted((r["repo_id"], r["feature"], r["value"]) for r in A.java_arch(files).collect())
    assert got == [
        (1, "build_tool", "Maven"), (1, "design_pattern", "Factory Pattern"),
        (1, "framework", "Java Servlets"), (1, "spring_annotation", "Controller"),
        (2, "build_tool", "Gradle"),
    ]
    assert [r["package"] for r in A.java_packages(files).collect()] == ["a.b"]


def test_go(corpus):
    files = corpus([
        (1, "go.mod", ""), (1, "k8s.yml", ""), (1, "cmd/a.go", "package main\n// GRPC"), (1, "b_test.go", "package b"),
        (2, "x/go.mod", ""), (2, "x/Dockerfile", ""), (2, "a.go", "gin.New() // docker"),
    ])
    rows = {r["repo_id"]: r.asDict() for r in A.go_arch(files).collect()}
    assert rows[1] == {"repo_id": 1, "go_modules": True, "http_server": False, "grpc_service": True,
                       "containerized": False, "kubernetes_ready": True, "main_packages": 1, "test_coverage": True}
    assert rows[2] == {"repo_id": 2, "go_modules": False, "http_server": True, "grpc_service": False,
                       "containerized": True, "kubernetes_ready": False, "main_packages": 0, "test_coverage": False}
    assert {(r["repo_id"], r["package"]) for r in A.go_packages(files).collect()} == {(1, "main"), (1, "b")}
