"""Calls, implements and inherits edges."""

from __future__ import annotations

from codeloom.operators import bridges, symbols


def edges(corpus, files):
    return {(r.src, r.dst, r.type) for r in symbols.symbol_edges(corpus(files)).collect()}


def test_java_packages_imports_and_generics(corpus):
    files = {
        "p/Base.java": "package p;\nabstract class Base { }\ninterface Sized { }\ninterface Big extends Sized { }",
        "q/Base.java": "package q;\nclass Base { }",
        "q/Item.java": "package q;\nimport p.Base;\nimport p.*;\n// class No extends Base { }\n"
                       "class Item<T extends Comparable<T>> extends Base implements Sized, java.io.Closeable { }",
        "r/Lost.java": "package r;\nclass Lost extends Base { }\nclass Far implements Big { }",
    }
    assert edges(corpus, files) == {
        ("java:p/Base.java#Big", "java:p/Base.java#Sized", "inherits"),
        # Two imports give p.Base, the folder's own Base comes after them.
        ("java:q/Item.java#Item", "java:p/Base.java#Base", "inherits"),
        ("java:q/Item.java#Item", "java:p/Base.java#Sized", "implements"),
        # Base is ambiguous for r, Big is not.
        ("java:r/Lost.java#Far", "java:p/Base.java#Big", "implements"),
    }


def test_csharp_namespaces(corpus):
    files = {
        "a.cs": "namespace N.One { public interface IPart { } public class Root : IPart { } }",
        "x/b.cs": "namespace N.Two { public interface IPart { } }",
        "y/c.cs": "using N.One;\nclass Leaf : Root, IPart where T : class { }\nstruct S : IPart { }",
        "z/d.cs": "using N.One;\nusing N.Two;\nclass Both : IPart { }",
    }
    assert edges(corpus, files) == {
        ("csharp:a.cs#Root", "csharp:a.cs#IPart", "implements"),
        ("csharp:y/c.cs#Leaf", "csharp:a.cs#Root", "inherits"),
        ("csharp:y/c.cs#Leaf", "csharp:a.cs#IPart", "implements"),
        ("csharp:y/c.cs#S", "csharp:a.cs#IPart", "implements"),
    }


def test_python_modules_relative_imports_and_strings(corpus):
    files = {
        "pkg/base.py": "class Node:\n    pass\n\ndef total(x):\n    return x\n\nasync def only(x):\n    return total(x)\n",
        "pkg/sub/use.py": "from ..base import Node, total\n\nclass Leaf(Node, dict, metaclass=Meta):\n    def run(self):\n"
                          "        return total(1) + len(\"only(\") + self.only(2)  # only(3)\n",
        "other.py": "from pkg.base import only\n\ndef total(x):\n    return only(x)\n",
        "lone/c.py": "total(4)\nonly(5)\n",
    }
    assert edges(corpus, files) == {
        ("python:pkg/base.py", "python:pkg/base.py#total", "calls"),
        ("python:pkg/sub/use.py#Leaf", "python:pkg/base.py#Node", "inherits"),
        ("python:pkg/sub/use.py", "python:pkg/base.py#total", "calls"),
        ("python:other.py", "python:pkg/base.py#only", "calls"),
        ("python:lone/c.py", "python:pkg/base.py#only", "calls"),
    }


def test_javascript_and_go(corpus):
    files = {
        "web/u.ts": "export class View { }\nexport function paint(a) { return a; }\nexport interface Shape { }\n",
        "web/lib/index.ts": "export function paint(a) { return a; }\n",
        "web/sub/v.ts": "import { View, paint } from '../u';\nclass Panel extends View implements Shape { }\nfunction go() { return paint(go()); }\n",
        "web/sub/w.ts": "const { paint } = require('../lib');\npaint(1);\n",
        "g/a.go": "package g\n\nfunc Load(x int) int { return x }\nfunc (p *T) Save(x int) { Load(x) }\n",
        "h/a.go": "package h\n\nfunc Load(x int) int { return x }\nfunc Save() { fmt.Println(Load(2)) }\n",
        "g/b.go": "package g\n\nfunc use() { Load(1); fmt.Save(2) }\n",
    }
    assert edges(corpus, files) == {
        ("javascript:web/sub/v.ts#Panel", "javascript:web/u.ts#View", "inherits"),
        ("javascript:web/sub/v.ts#Panel", "javascript:web/u.ts#Shape", "implements"),
        ("javascript:web/sub/v.ts", "javascript:web/u.ts#paint", "calls"),
        ("javascript:web/sub/v.ts", "javascript:web/sub/v.ts#go", "calls"),
        ("javascript:web/sub/w.ts", "javascript:web/lib/index.ts#paint", "calls"),
        ("go:g/a.go", "go:g/a.go#Load", "calls"),
        ("go:h/a.go", "go:h/a.go#Load", "calls"),
        ("go:g/b.go", "go:g/a.go#Load", "calls"),
    }


def test_names_of_other_repositories_and_languages_are_not_seen(corpus):
    files = [(1, "a.py", "class Base:\n    pass\n"), (2, "b.py", "class Leaf(Base):\n    pass\n"), (1, "C.java", "class C extends Base { }"),
             (3, "empty.py", "")]
    assert edges(corpus, files) == set()


def test_typed_graph_takes_symbols(spark, corpus):
    files = corpus({"a.py": "def f():\n    return 1\n\nf()\n"})
    imports = spark.createDataFrame(
        [(1, "x.py", "python", "a.py", "python", "import")],
        "repo_id long, source_file string, source_language string, target_file string, target_language string, dependency_type string",
    )
    cross = spark.createDataFrame([], "repo_id long, src string, dst string, type string")
    found = {tuple(r) for r in bridges.typed_graph(imports, cross, symbols.symbol_edges(files)).collect()}
    assert found == {(1, "python:x.py", "python:a.py", "import"), (1, "python:a.py", "python:a.py#f", "calls")}
