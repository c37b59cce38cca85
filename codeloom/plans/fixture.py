"""Code corpora derived from the star-schema tables.

The given tables hold no source code, so the corpus is an SQL projection of
them: same text for Spark and for the SQL oracles.  Every row of the four
tables becomes one file:

* ``part``      -> a source file in one of the five analysed languages,
* ``customer``  -> a manifest, build or configuration file,
* ``documents`` -> the whole prose text, as a file of another language,
* ``pages``     -> the whole web page, as a PHP file.

One third of the source files fall into repository 0, which is thus a hot key.
``~k~ ~s~ ~name~`` and the like stand for columns, ``~n~ ~q~ ~t~ ~d~`` for the
characters newline, single quote, tab and dollar.
"""

from __future__ import annotations

# language number -> ((condition or None, text), ...)
_PYTHON = (
    (None, "import os~n~import json, sys~n~# part ~name~~n~"),
    ("s % 2 = 0", "from lib.mod~m~ import helper_~s~ as h, other~n~"),
    ("s % 5 = 0", "from . import local_~s~~n~from ..up import thing~n~"),
    ("s % 7 = 0", "import pkg.sub~m~ as alias, pkg.other~n~"),
    (None, "import part_~j~, src.part_~j~, srclib.part_~j~ as near, lib.part_~i~~n~from app.models import part_~i~~n~"),
    (None, "~n~class Part~k~:~n~    \"\"\"Doc of ~name~.\"\"\"~n~~n~    def total(self, qty):~n~        if qty > ~s~ and qty < 100 or qty == 0:~n~            return qty~n~        for i in range(qty):~n~            while i > 3 and qty and i:~n~                i -= 1~n~        return 0~n~"),
    ("s % 3 = 0", "~n~async def fetch_~k~(url):~n~    if url:~n~        return requests.get(\"http://localhost:80~s~/items/~k~\")~n~"),
    ("s % 4 = 0", "~n~@app.route(~q~/api/parts/~s~~q~)~n~def handler_~k~(req):~n~    with open(\"config.json\") as f:~n~        try:~n~            data = eval(f.read())~n~        except ValueError:~n~            data = None~n~    def inner(x):~n~        if x:~n~            return x or data or 1~n~    os.exec(data)~n~    return inner(data)~n~"),
    ("s > 45", "~n~def big_~k~(a, b):~n~    if a: b = 1~n~    elif b: a = 2~n~    if a and b and a > b: pass~n~    for x in a:~n~        while x:~n~            if x or b or a:~n~                x = input()~n~    with a as c:~n~        if c and a: pass~n~    try:~n~        pass~n~    finally:~n~        pass~n~"),
    ("s % 6 = 1", "PORT = 80~s~~n~DATABASE_URL = \"postgres://db~s~/main\"~n~"),
    ("s % 11 = 3", "REPORT=~s~~n~API_KEY = ~q~key-~k~~q~~n~settings = load(~q~settings.yaml~q~)~n~"),
    ("s % 19 = 1", "import ctypes~n~"),
    ("s % 13 = 5", "client.publish(\"topic-~s~\", exec(\"x\"))~n~"),
    ("s % 17 = 0", "def broken_~k~(:~n~    pass~n~"),
)
_JAVASCRIPT = (
    (None, "// part ~name~~n~"),
    ("s % 2 = 0", "import React, { useState } from ~q~react~q~;~n~import \"./style-~m~.css\";~n~"),
    ("s % 2 = 1", "const fs = require(~q~fs~q~);~n~const lib~m~ = require( \"./lib/mod~m~\" );~n~"),
    (None, "~n~class Part~k~ extends Base {}~n~~n~function load_~k~(id) {~n~  if (id > ~s~ && id < 10 || !id) {~n~    return id ? fetch(`/api/parts/~d~{id}`) : null;~n~  }~n~  for (let i = 0; i < id; i++) { while (i) { i--; } }~n~}~n~"),
    ("s % 3 = 0", "const handlers = {~n~  onLoad~s~: function (e) { switch (e) { case 1: break; } },~n~  load_~k~: function () {}~n~};~n~"),
    ("s % 4 = 0", "let calc_~k~ = function inner_~k~(a, b) {~n~  try { return a || b; } catch (e) { return \"}\"; }~n~};~n~"),
    ("s % 5 = 0", "const arrow_~k~ = (a, b) => {~n~  const nested = (c) => { if (c) { return a?.b ?? c; } };~n~  return nested;~n~};~n~const short = (x) => x + 1;~n~"),
    ("s % 7 = 0", "document.getElementById(\"p\").innerHTML = eval(\"~s~\"); el.INNERHTML = 1;~n~setTimeout(\"go()\", 1);~n~  setInterval( ~q~tick()~q~, 5);~n~"),
    ("s % 9 = 0", "const h = crypto.createHash(\"md5\"); document.write(Math.random());~n~child.exec(\"ls\");~n~<div dangerouslySetInnerHTML={x} />~n~"),
    ("s > 45", "function big_~k~(a) {~n~  if (a) { if (a) { if (a && a) { } } }~n~  for (;;) { while (a) { if (a || a || a) { } } }~n~  return a ? 1 : a ? 2 : 3; catch (e)~n~}~n~"),
    ("s % 6 = 1", "export default function main_~k~() { return process.env.PORT=~s~; }~n~export { load_~k~, main_~k~ , x };~n~export {y}~n~"),
    ("s % 6 = 2", "module.exports = load_~k~;~n~export const one = 1;~n~export {solo }~n~"),
    ("s % 8 = 0", "app.get(~q~/v1/parts/~s~~q~, h);~n~app.post(\"/orders\", h);~n~const cfg = require(\"./config.json\"); load(\"app.config\");~n~fetch(\"http://127.0.0.1:30~s~/x\");~n~"),
    ("s % 11 = 0", "function open_~k~(a) {~n~  if (a) { return \"{\";~n~"),
)
_CSHARP = (
    (None, "using System;~n~using System.Linq;~n~// part ~name~~n~namespace Shop.Mod~m~~n~{~n~"),
    ("s % 2 = 0", "    using var x = Open();~n~    public interface IPart~k~ { int Size { get; set; } }~n~"),
    (None, "    public abstract class Part~k~Controller : Base~n~    {~n~        private static int Count { get; }~n~        public string Name~s~ {~n~            get { return name; } }~n~        public static int Total(int qty)~n~        {~n~            if (qty > ~s~ && qty != 0) { return Add(qty); }~n~            else if (qty == 1) { foreach (var i in items) { qty++; } }~n~            return a ?? b?.c ?? 1;~n~        }~n~"),
    ("s % 3 = 0", "        protected override void Run~s~() { switch (x) { default: break; } try { } catch (Exception e) { } }~n~"),
    ("s % 4 = 0", "        [Route(\"api/parts/~s~\")]~n~        public void Del~k~(string p) { System.IO.File.Delete(p); System.Diagnostics.Process.Start(p); }~n~"),
    ("s % 5 = 0", "        string Password = \"secret-~k~\"; var connectionString = \"Server=db~s~;\";~n~        var asm = System.Reflection.Assembly.Load(x); EVAL (x);~n~"),
    ("s % 7 = 0", "        // Repository for services.AddScoped<IRepository>(); innerHTML = x~n~"),
    ("s > 45", "        internal virtual int Big~k~(int a) {~n~            if (a > 1) { if (a > 2) { while (a > 0) { for (;;) { a--; } } } }~n~            return a > 1 ? a : b ? c : d && e || f && g;~n~        }~n~"),
    ("s % 6 = 1", "        HttpClient.GetAsync(\"/api/parts/~k~\"); Load(\"config.json\"); queue = \"parts-~s~\";~n~        const string DATABASE_URL = \"mysql://db~s~\";~n~"),
    ("s % 11 <> 0", "    }~n~"),
    (None, "}~n~"),
)
_JAVA = (
    ("s % 10 <> 0", "package com.shop.mod~m~;~n~~n~"),
    (None, "import java.util.List;~n~import static org.junit.Assert.*;~n~// part ~name~~n~"),
    ("s % 2 = 0", "import org.springframework.stereotype.Service;~n~~n~@Service~n~@RequestMapping(\"/v2/parts/~s~\")~n~"),
    ("s % 3 = 0", "import com.fasterxml.jackson.databind.ObjectMapper;~n~import javax.servlet.http.HttpServlet;~n~"),
    ("s % 7 = 0", "@RestController~n~interface Store~k~ extends Repo {}~n~"),
    (None, "public final class Part~k~Factory {~n~    private static final int SIZE = ~s~;~n~    private String name;~n~    public static int total(int qty) throws IOException {~n~        if (qty > ~s~ && qty != 0 || qty == 7) {~n~            return qty;~n~        } else if (qty == 1) {~n~            for (int i = 0; i < qty; i++) { while (i > 0) { i--; } }~n~        }~n~        int r = qty > 3 ? 1 : 2;~n~        return r;~n~    }~n~"),
    ("s % 4 = 0", "    void run~s~() {~n~        Process p = Runtime.getRuntime().exec(\"ls\"); new ProcessBuilder(\"x\");~n~        Random r = new Random(); Class.forName(\"x~s~\");~n~    }~n~"),
    ("s % 5 = 0", "    protected byte[] hash~k~(String in) {~n~        try { MessageDigest.getInstance(\"MD5\"); MessageDigest.getInstance( \"SHA1\"); }~n~        catch (Exception e) { System.getProperty(\"user.home\"); }~n~        new FileInputStream(in); new FileOutputStream (in, true);~n~        c.setHostnameVerifier(SSL.ALLOW_ALL);~n~        return null;~n~    }~n~"),
    ("s > 45", "    int big~k~(int a) {~n~        if (a > 1) { if (a > 2) { while (a > 0) { for (;;) { a--; } } } }~n~        switch (a) { case 1: break; }~n~        return a > 1 ? a : b > 2 ? c : d && e || f && g || h;~n~    }~n~"),
    ("s % 19 = 3", "    static { System.loadLibrary (\"part~s~\"); }~n~"),
    ("s % 8 = 0", "    String own = \"/api/parts/~s~\";~n~"),
    ("s % 6 = 1", "    String url = \"http://localhost:90~s~/v1/parts\"; String f = \"settings.yaml\";~n~    String REDIS_URL = \"redis://cache~s~\"; class Part~k~Builder { }~n~"),
    ("s % 11 <> 0", "}~n~"),
)
_GO = (
    ("s % 4 <> 0", "package mod~m~~n~~n~"),
    ("s % 4 = 0", "package main~n~~n~"),
    ("s % 2 = 0", "import (~n~\t\"fmt\"~n~\t\"net/http\"~n~\talias~s~ \"shop/mod~m~\"~n~)~n~"),
    ("s % 2 = 1", "import \"os\"~n~import q \"quiet\"~n~import \"crypto/md5\"~n~// part ~name~~n~"),
    (None, "type Part~k~ struct {~n~\tid int~n~}~n~~n~type Store~s~ interface {~n~\tGet(id int) error~n~}~n~~n~func (p *Part~k~) Total(qty int) int {~n~\tif qty > ~s~ && qty != 0 {~n~\t\treturn qty~n~\t}~n~\tfor i := 0; i < qty; i++ {~n~\t\tswitch i {~n~\t\tcase 1:~n~\t\t\tcontinue~n~\t\tcase 2:~n~\t\t}~n~\t}~n~\treturn 0~n~}~n~"),
    ("s % 3 = 0", "func Load~k~(id int) (int, error) { select { case <-c: } ; return id || 0, nil }~n~"),
    ("s % 4 = 0", "func main() {~n~\thttp.ListenAndServe(\":80~s~\", nil)~n~\thttp.Get(\"http://localhost:80~s~/api\")~n~\texec.Command(\"ls\")~n~}~n~"),
    ("s % 5 = 0", "func show~s~() { fmt.Printf(\"%s\", x); os.Getenv(\"SECRET\"); fmt.Print(\"a%v\") }~n~var u = unsafe.Pointer(x); r := math/rand.Int()~n~"),
    ("s % 7 = 0", "var t = http.DefaultTransport; cfg := TLSClientConfig{InsecureSkipVerify: true}~n~// deployed with Docker on Kubernetes via gRPC~n~"),
    ("s % 19 = 2", "import \"C\"~n~"),
    ("s > 45", "func big~k~(a int) {~n~\tif a { if a { if a && b && c { } } }~n~\tfor a { for b { } }~n~\tswitch a { case 1: case 2: case 3: }~n~\tselect { case x: }~n~}~n~"),
    ("s % 6 = 1", "var api = \"/api/parts/~k~\"; f := \"config.json\"; API_KEY=\"k~s~\"~n~"),
    ("s % 11 = 0", "func open~k~() {~n~\tif x {~n~"),
)

_LANGUAGES = (
    (_PYTHON, ".py"), (_JAVASCRIPT, None), (_CSHARP, ".cs"), (_JAVA, ".java"), (_GO, None),
)

# Directory of a source file, by s % 12; some are skipped by some scans.
_DIRECTORIES = (
    "", "src/", "src/pylib/", "lib/", "node_modules/dep~k~/", "venv/lib~m~/", "bin/",
    "build/out/", "vendor/x/", "services/svc~m~/", "target/", "app/models/",
)

# One file per customer; kind = customer number % 15.
_MANIFESTS = (
    ("package.json", (
        ("s % 5 = 0", "{\"name\": \"repo~r~\", \"dependencies\": {\"react\": \"^18\", \"dep~s~\": \"1\"}, \"devDependencies\": {\"jest\": \"1\", \"vite\": \"2\"}, \"peerDependencies\": {\"peer~r~\": \"1\", \"react\": \"*\"}}"),
        ("s % 5 = 1", "{\"dependencies\": {\"express\": \"4\", \"dep~s~\": \"1\"}, \"devDependencies\": {\"mocha\": \"1\", \"rollup\": \"2\", \"webpack\": \"5\"}}"),
        ("s % 5 = 2", "{\"devDependencies\": {\"@angular/core\": \"17\", \"cypress\": \"9\"}, \"peerDependencies\": {\"vue\": \"3\"}}"),
        ("s % 10 = 3", "{\"name\": \"bare~r~\", \"dependencies\": {}}"),
        # Not valid, or with a section that is no object.
        ("s % 10 = 8", "{\"dependencies\": {\"react\": \"1\"}, \"devDependencies\": null, \"peerDependencies\": {\"never~s~\": \"1\"}}"),
        ("s % 30 = 4", "{\"dependencies\": {\"broken\": "),
        ("s % 30 = 9", "{~q~dependencies~q~: {~q~single~s~~q~: ~q~1~q~}}"),
        ("s % 30 = 14", "{\"dependencies\": {\"trailing~s~\": \"1\"}} x"),
        ("s % 30 = 19", "{\"dependencies\": {\"first~s~\": \"1\"}, \"devDependencies\": {\"cut~s~\": \"1\""),
        ("s % 30 = 24", "{\"dependencies\": [\"listed~s~\"], \"devDependencies\": {\"late~s~\": \"1\"}}"),
        ("s % 30 = 29", "[{\"dependencies\": {\"inner~s~\": \"1\"}}]"),
    )),
    ("src/App~k~.csproj", (
        ("s % 4 <> 0", "<Project Sdk=\"Microsoft.NET.Sdk\">~n~  <ItemGroup>~n~    <PackageReference Include=\"Serilog\" Version=\"2\" />~n~    <PackageReference Include=\"Pkg~s~\" Version=\"1\" />~n~  </ItemGroup>~n~</Project>~n~"),
        ("s % 4 = 0", "<Project>~n~  <ItemGroup>~n~    <PackageReference Include=\"Broken~s~\" />~n~    <PackageReference   Include=\"Serilog\"~n~</Project>~n~"),
    )),
    ("App.sln", ((None, "Microsoft Visual Studio Solution File~n~<PackageReference Include=\"FromSln~s~\" />~n~"),)),
    ("build.gradle", ((None, "dependencies {~n~  implementation ~q~com.shop:core~s~:1.0~q~~n~  testImplementation \"org.junit:junit:4\"~n~  xapi ~q~odd:match:~s~~q~~n~  compile \"old:lib:1\"~n~  runtimeOnly \"not:this:1\"~n~}~n~"),)),
    ("go.mod", (
        ("s % 2 = 0", "module shop~n~~n~require github.com/a/mod~s~ v1.~s~.0~n~require github.com/b/b v0.1.0~n~"),
        ("s % 2 = 1", "module shop~n~~n~require (~n~\tgithub.com/c/first v1.0.0~n~\tgithub.com/c/second v2.0.0~n~)~n~"),
    )),
    ("config.json", ((None, "{\"port\": 80~s~, \"PORT\": \"PORT=~s~\"}~n~"),)),
    ("deploy/settings.yaml", ((None, "queue: \"q~s~\"~n~"),)),
    (".env", ((None, "PORT=80~s~~n~API_KEY=~q~k~k~~q~~n~"),)),
    ("Dockerfile", ((None, "FROM scratch~n~# ~k~~n~"),)),
    ("deploy/docker-compose.yml", ((None, "services: {}~n~# ~k~~n~"),)),
    ("requirements.txt", ((None, "requests==2.~s~~n~"),)),
    ("pom.xml", (
        ("s % 3 = 0", "<project xmlns=\"http://maven.apache.org/POM/4.0.0\">~n~  <dependencies>~n~    <dependency><groupId>org.a</groupId><artifactId>a~s~</artifactId><version>1.~s~</version></dependency>~n~    <dependency><groupId>org.b</groupId><artifactId>b</artifactId><exclusions><exclusion><groupId>x</groupId></exclusion></exclusions></dependency>~n~    <dependency><groupId>org.c</groupId></dependency>~n~  </dependencies>~n~</project>~n~"),
        ("s % 3 = 1", "<project>~n~  <dependency><groupId>org.n</groupId><artifactId>none</artifactId></dependency>~n~</project>~n~"),
        ("s % 3 = 2", "<project xmlns=\"http://maven.apache.org/POM/4.0.0\">~n~  <dependency><groupId>org.z</groupId><artifactId>z</artifactId></dependency>~n~"),
    )),
    ("web/app.config", ((None, "<configuration/>~n~"),)),
    ("data/rows~k~.csv", ((None, "a,b~n~1,~s~~n~"),)),
    ("node_modules/dep/package.json", ((None, "{\"dependencies\": {\"nested~k~\": \"1\"}}"),)),
)


def _literal(text: str) -> str:
    assert "'" not in text and "\\" not in text.replace("\t", "")
    return "'" + text.replace("\t", "~t~") + "'"


def _case(branches, otherwise: str = "''") -> str:
    whens = " ".join(f"WHEN {when} THEN {then}" for when, then in branches)
    return f"CASE {whens} ELSE {otherwise} END"


def _snippets(snippets) -> str:
    parts = [
        _literal(text) if when is None else _case([(when, _literal(text))])
        for when, text in snippets
    ]
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _filled(text: str, **columns: str) -> str:
    marks = {**columns, "n": "chr(10)", "q": "chr(39)", "t": "chr(9)", "d": "chr(36)"}
    for mark, value in marks.items():
        text = f"replace({text}, '~{mark}~', {value})"
    return text


def _as_text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def _code_sql(table: str) -> str:
    language = (
        "CASE repo_id % 6 WHEN 1 THEN 0 WHEN 2 THEN k % 2 "
        "WHEN 3 THEN CAST(floor(k / 3) AS BIGINT) % 3 ELSE k % 5 END"
    )
    keys = dict(k=_as_text("k"), s=_as_text("s"), m=_as_text("s % 10"),
                i=_as_text("abs(k - 1)"), j=_as_text("abs(k - 15)"))
    content = _filled(
        _case([(f"lang = {i}", _snippets(t)) for i, (t, _) in enumerate(_LANGUAGES)]),
        **keys, name="name",
    )
    suffix = _case([
        ("lang = 0", "'.py'"),
        ("lang = 1", _case([("s % 5 = 0", "'.tsx'"), ("s % 5 = 1", "'.jsx'"),
                            ("s % 5 = 2", "'.ts'"), ("s % 5 = 3", "'.mjs'")], "'.js'")),
        ("lang = 2", "'.cs'"),
        ("lang = 3", "'.java'"),
        ("lang = 4", _case([("s % 9 = 0", "'_test.go'")], "'.go'")),
    ])
    base = _case([
        ("s % 10 = 1", "concat('model_', ~k~)"), ("s % 10 = 2", "concat('View', ~k~)"),
        ("s % 10 = 3", "concat('controller', ~k~)"), ("s % 10 = 4", "concat('d', ~k~, '/main')"),
        ("s % 10 = 5", "concat('lib/mod', ~s~, '/d', ~k~, '/main')"),
    ], "concat('part_', ~k~)").replace("~k~", _as_text("k")).replace("~s~", _as_text("s"))
    directory = _filled(
        _case([(f"s % {len(_DIRECTORIES)} = {i}", _literal(d)) for i, d in enumerate(_DIRECTORIES)]),
        **keys,
    )
    return f"""
SELECT repo_id, concat({directory}, {base}, {suffix}) AS path, {content} AS content
FROM (SELECT *, {language} AS lang FROM (
  SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, p_name AS name,
         CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(floor(p_partkey / 20) AS BIGINT) END AS repo_id
  FROM {table}) parts) code"""


def _manifest_sql() -> str:
    kind = f"k % {len(_MANIFESTS)}"
    keys = dict(k=_as_text("k"), s=_as_text("s"), r=_as_text("repo_id"))
    path = _filled(
        _case([(f"{kind} = {i}", _literal(p)) for i, (p, _) in enumerate(_MANIFESTS)]), **keys
    )
    content = _filled(
        _case([(f"{kind} = {i}", _snippets(t)) for i, (_, t) in enumerate(_MANIFESTS)]), **keys
    )
    return f"""
SELECT repo_id, {path} AS path, {content} AS content
FROM (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS s,
             CAST(floor(c_custkey / {len(_MANIFESTS)}) AS BIGINT) AS repo_id FROM customer) manifests"""


_PROSE_SQL = """
SELECT CASE WHEN doc_id % 2 = 0 THEN 0 ELSE CAST(floor(doc_id / 10) AS BIGINT) * 3 END AS repo_id,
       concat('notes/n', CAST(doc_id AS STRING),
              CASE doc_id % 5 WHEN 0 THEN '.rb' WHEN 1 THEN '.rs' WHEN 2 THEN '.h' WHEN 3 THEN '.c' ELSE '.cpp' END) AS path,
       text AS content
FROM documents
UNION ALL
SELECT CAST(floor(page_id / 5) AS BIGINT) * 4 AS repo_id,
       concat('site/p', CAST(page_id AS STRING), '.php') AS path, html AS content
FROM pages"""


def files_sql(parts: str = "part") -> str:
    """``repo_id, path, content`` of the whole corpus."""
    return f"{_code_sql(parts)}\nUNION ALL{_manifest_sql()}\nUNION ALL{_PROSE_SQL}"


def previous_files_sql() -> str:
    """An earlier snapshot: parts had another size, some files did not exist yet."""
    older = """(SELECT p_partkey, p_name,
      CASE WHEN p_partkey % 4 = 1 AND p_size > 12 THEN p_size - 12 ELSE p_size END AS p_size FROM part)"""
    return files_sql(older)


# One schema or generated file per part; file number % 8 is its kind, and the
# eight files of a group, ``~b~``, belong together.
_SCHEMAS = (
    ("api/shop~b~.proto", (
        (None, "syntax = \"proto3\"; // message No { int32 x = 1; }~n~package shop.v~m~;~n~/* message Never {~n~ int32 x = 1; } */~n~option java_package = \"com.{shop}\";~n~message Part~b~ {~n~  option deprecated = 5;~n~  int32 id = 1;~n~  string name = 2 [deprecated = true];~n~"),
        ("s % 3 <> 0", "  message Line {~n~    oneof kind { string a = 2; string b = 3; }~n~    message Deep { map<string, int32> m = 1; }~n~    int32 qty = 1;~n~  }~n~  repeated Line lines = 3;~n~"),
        ("s % 4 = 0", "  enum State { A = 0; B = 1; }~n~  reserved 7, 8;~n~  State state = 6;~n~"),
        (None, "}~n~message Empty {}~n~service Parts { rpc Get (Part~b~) returns (Empty) {} }~n~"),
        ("s % 11 = 0", "message Open~b~ { int32 x = 1; message In { int32 y = 1; "),
    )),
    ("gen/shop~b~.pb.go", ((None, "// Code generated by protoc-gen-go. DO NOT EDIT.~n~package shop~n~type Part~b~ struct {~n~}~n~type Part~b~_Line struct {}~n~type Part~b~_Line_Deep struct {}~n~type Gone struct {}~n~"),)),
    ("gen/shop~b~_pb2.py", ((None, "# Generated by the protocol buffer compiler.~n~Part = DESCRIPTOR.message_types_by_name[~q~Part~b~~q~]~n~Empty = DESCRIPTOR.message_types_by_name[~q~Empty~q~]~n~"),)),
    ("java/d~k~/Line.java", ((None, "// Generated by the protocol buffer compiler.~n~public final class Line extends~n~    com.google.protobuf.GeneratedMessageV3 {}~n~"),)),
    ("cs/Part~b~.cs", (
        ("s % 2 = 0", "// Generated by the protocol buffer compiler.~n~"),
        (None, "public sealed partial class Part~b~ : pb::IMessage<Part~b~> {}~n~"),
    )),
    ("web/shop~b~_pb.js", (
        (None, "// Generated by protoc~n~proto.shop.v1.Part~b~ = function(opt) {};~n~proto.shop.v2.Part~b~.Line = function(opt) {};~n~"),
        ("s % 2 = 1", "proto.shop.v3.Empty = function(opt) {};~n~"),
    )),
    ("idl/base~b~.thrift", ((None, "namespace py shop.base~n~# struct No { 1: i32 x }~n~struct Item~b~ { 1: required i32 id, 2: optional string name = \"}\" }~n~union Any { 1: Item~b~ item; }~n~exception Lost { }~n~service S { Any get(1: i32 id) throws (1: Lost x) }~n~const map<i32, i32> M = { 1: 2 }~n~"),)),
    ("gen-py/b~b~/ttypes.py", (
        (None, "# Autogenerated by Thrift Compiler~n~class Item~b~(object):~n~    pass~n~"),
        ("s % 5 = 0", "# Autogenerated by hand~n~class Lost(Exception):~n~    pass~n~"),
    )),
)


# One file per part that defines or calls routes with parameters; file number % 8 is
# its kind, and the eight files of a group are one service.
_ROUTED = (
    ("svc/a~k~.py", (
        (None, "@app.route(~q~/api/shops/<int:shop>/parts/~s~~q~)~n~def part(shop): pass~n~"),
        ("s % 3 = 0", "@app.route(~q~/api/files~m~/<path:rest>~q~)~n~def rest(rest): pass~n~"),
        ("s % 4 = 1", "@app.route(~q~/api/files~m~/a/<name>/raw~q~)~n~def raw(name): pass~n~"),
    )),
    ("web/r~k~.js", (
        (None, "app.get(~q~/api/shops/:shop/parts/:part~q~, h);~n~app.post(\"/api/parts/:id?\", h);~n~"),
        ("s % 4 = 0", "app.put(~q~/api/users~m~/me~q~, h);~n~"),
    )),
    ("cs/C~k~.cs", (
        (None, "[Route(\"api/shops/{shop:int}/orders/{order}\")]~n~"),
        ("s % 5 = 0", "[Route(\"api/orders~m~/{*rest}\")]~n~"),
    )),
    ("java/J~k~.java", ((None, "String a = \"/api/shops/~s~/parts/~s~\"; String b = \"/api/parts/~k~\"; String c = \"/api/shops/x~s~/parts/~s~\";~n~"),)),
    ("web/c~k~.ts", ((None, "fetch(`/api/shops/~d~{id}/parts/~k~`); fetch(\"/api/files~m~/a/b~k~?x=1\"); fetch(\"/api/files~m~/a/b~s~/raw\"); fetch(\"/api/parts/\");~n~"),)),
    ("go/g~k~.go", ((None, "http.Get(\"http://localhost:8080/api/shops/7/orders/o~s~\")~n~var u = \"/api/users~m~/me\"; v := \"/api/users~m~/~k~\"~n~"),)),
    ("svc/b~k~.py", ((None, "requests.get(f\"http://127.0.0.1:80/api/orders~m~/~k~/lines\")~n~NONE = \"/v1/none/~s~\"~n~"),)),
    ("web/u~k~.js", ((None, "app.get(\"/api/users~m~/:name\", h);~n~call(\"/api/users~m~/ann~s~\");~n~"),)),
)


# One file per part that declares or uses symbols; the ten files of a group use each other.
_SYMBOLS = (
    ("java/p~b~/Base~b~.java", ((None, "package shop.p~b~;~n~public abstract class Base~b~ { }~n~interface Sized { }~n~interface Big~b~ extends Sized { }~n~"),)),
    ("java/q~b~/Item~b~.java", (
        (None, "package shop.q~b~;~n~import shop.p~b~.Base~b~;~n~"),
        ("s % 3 = 0", "import shop.p~b~.*;~n~"),
        (None, "// class No~b~ extends Base~b~ { }~n~public class Item~b~<T extends Comparable<T>> extends Base~b~ implements Sized, Other {~n~}~n~"),
    )),
    ("cs/m/R~k~.cs", ((None, "namespace Shop.M~m~ {~n~public interface IPart { }~n~public class Root~b~ : IPart { }~n~}~n~"),)),
    ("cs/n~b~/L~k~.cs", ((None, "using Shop.M~m~;~n~class Leaf~k~ : Root~b~, IPart { }~n~"),)),
    ("py/g~b~/base.py", ((None, "class Node~b~:~n~    pass~n~~n~def total(x):~n~    return x~n~~n~async def only~b~(x):~n~    return total(x)~n~"),)),
    ("py/g~b~/sub/use.py", (
        ("s % 3 = 0", "from ..base import Node~b~, total~n~"),
        ("s % 3 = 1", "from py.g~b~.base import total~n~"),
        (None, "~n~class Leaf(Node~b~, dict):~n~    def run(self):~n~        return total(1) + len(\"only~b~(\") + self.only~b~(2)~n~# only~b~(3)~n~"),
        ("s % 2 = 0", "only~b~(4)~n~"),
    )),
    ("web/u~b~.ts", ((None, "export class View~b~ { }~n~export function paint(a) { return a; }~n~export interface Shape { }~n~"),)),
    ("web/sub/v~b~.ts", (
        ("s % 2 = 0", "import { paint } from ~q~../u~b~~q~;~n~"),
        (None, "class Panel~b~ extends View~b~ implements Shape { }~n~function helper~b~() { return paint(helper~b~()); }~n~"),
    )),
    ("go/d~m~/a~k~.go", ((None, "package d~n~~n~func Load~b~(x int) int { return x }~n~func same(x int) int { return x }~n~"),)),
    ("go/d~m~/b~k~.go", ((None, "package d~n~~n~func use~k~() { Load~b~(same(1)); fmt.Println(2) }~n~"),)),
)


def _grouped_sql(kinds, m: str) -> str:
    """One file of ``kinds`` per part by its number; a third of the groups in repository 0."""
    number = f"p_partkey % {len(kinds)}"
    keys = dict(k=_as_text("p_partkey"), b=_as_text(f"p_partkey - {number}"), s=_as_text("p_size"), m=_as_text(m))
    kinds = [(p, [(w and w.replace("s ", "p_size ", 1), t) for w, t in text]) for p, text in kinds]
    path = _filled(_case([(f"{number} = {i}", _literal(p)) for i, (p, _) in enumerate(kinds)]), **keys)
    content = _filled(_case([(f"{number} = {i}", _snippets(t)) for i, (_, t) in enumerate(kinds)]), **keys)
    group = f"CAST(floor((p_partkey - {number}) / {len(kinds)}) AS BIGINT)"
    return f"""
SELECT CASE WHEN {group} % 3 = 0 THEN 0 ELSE CAST(floor({group} / 6) AS BIGINT) END AS repo_id,
       {path} AS path, {content} AS content FROM part"""


def schema_files_sql() -> str:
    """Schemas and generated files."""
    return _grouped_sql(_SCHEMAS, "CAST(p_size AS BIGINT) % 4")


def route_files_sql() -> str:
    """Definitions of routes and calls of them."""
    return _grouped_sql(_ROUTED, "CAST(p_size AS BIGINT) % 7")


def symbol_files_sql() -> str:
    """Declarations of types and functions, and files that use them."""
    return _grouped_sql(_SYMBOLS, "CAST(p_size AS BIGINT) % 4")


def cycle_files_sql() -> str:
    """Python modules that import each other: chains of 60 with ways back, between
    chains, and short circles; repositories of 600 modules."""
    def imports(when: str, target: str) -> str:
        return f"CASE WHEN {when} THEN concat('import pkg.m', CAST({target} AS STRING), chr(10)) ELSE '' END"

    lines = ", ".join([
        imports("p_partkey % 60 <> 0 OR p_partkey % 180 = 0", "p_partkey + 1"),
        imports("p_partkey % 60 = 0", "p_partkey - 59 + CAST(floor(p_partkey / 60) AS BIGINT) % 5 * 11"),
        imports("p_partkey % 60 = 24", "p_partkey + 9"),
        imports("p_partkey % 240 = 37", "p_partkey - 3"),
        imports("p_partkey % 420 = 400", "p_partkey - 150"),
        imports("p_size = 7", "p_partkey"),
    ])
    return f"""
SELECT CAST(floor(p_partkey / 600) AS BIGINT) AS repo_id, concat('pkg/m', CAST(p_partkey AS STRING), '.py') AS path,
       concat('import os', chr(10), {lines}) AS content FROM part"""


LOG_SQL = """
SELECT repo_id, tool, line_no,
  CASE WHEN tool = 'tsc' AND hot THEN concat('  src/a.ts(', CAST(n AS STRING), ',1): error TS2304: x ')
       WHEN tool = 'dotnet' AND hot THEN concat('A.cs(', CAST(n AS STRING), ',5): error CS1002: ; expected')
       WHEN tool = 'maven' AND hot THEN concat('[ERROR] COMPILATION ERROR ', CAST(n AS STRING))
       WHEN tool = 'gradle' AND hot THEN concat('A.java:', CAST(n AS STRING), ': Error: missing')
       WHEN tool = 'go build' AND hot THEN concat('./main.go:', CAST(n AS STRING), ': undefined: x  ')
       WHEN tool = 'go vet' AND hot THEN concat('# shop/mod', CAST(n AS STRING))
       WHEN tool IN ('go build', 'go vet') THEN CASE WHEN n = 1 THEN '   ' ELSE '' END
       WHEN n = 2 THEN concat('warning: line ', CAST(line_no AS STRING))
       ELSE concat('info ', CAST(line_no AS STRING)) END AS line
FROM (SELECT l_suppkey AS repo_id, l_orderkey * 10 + l_linenumber AS line_no, CAST(l_linenumber AS BIGINT) AS n,
        CASE l_orderkey % 6 WHEN 0 THEN 'tsc' WHEN 1 THEN 'dotnet' WHEN 2 THEN 'maven' WHEN 3 THEN 'gradle'
             WHEN 4 THEN 'go build' ELSE 'go vet' END AS tool,
        l_suppkey % 3 = 0 AND l_returnflag = 'R' AND l_linenumber > 5 AS hot
      FROM lineitem) logs"""

JOB_EVENT_SQL = """
SELECT user_id AS job_id, event_id, ts,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed'
            WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
       CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 10 WHEN 'click' THEN 80
            WHEN 'purchase' THEN 100 END AS progress,
       CASE WHEN event_type = 'error' THEN concat('failed: ', props) END AS error_message
FROM events"""

# One analysis request per order; languages as written by the user.
REQUEST_SQL = """
SELECT o_orderkey AS job_id, o_custkey AS repository_id, o_orderdate AS requested_at,
       CASE o_orderkey % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'python,js' WHEN 2 THEN 'c#'
            WHEN 3 THEN 'typescript,go,java' WHEN 4 THEN 'ts,js' WHEN 5 THEN 'cobol' ELSE 'csharp,rust' END AS languages,
       'syntax_analysis,security_analysis' AS analysis_types
FROM orders"""
