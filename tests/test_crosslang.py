import random

import pytest

from codeloom import rules
from codeloom.operators import crosslang as X
from codeloom.sources.corpus import discovered_files


def scan(corpus, texts, *wanted):
    return X.scan(corpus(texts), *wanted)


def test_endpoints_keep_backticks_and_duplicates(corpus):
    text = "get('/api/x') GET(\"/API/y\") `/v2/z` localhost:80/a\" 127.0.0.1:9 '/api/x' '/vx/n'"
    rows = X.api_endpoints(scan(corpus, {"a.rb": text}, "endpoints")).collect()
    assert sorted(r["endpoint"] for r in rows) == [
        "/API/y", "/api/x", "/api/x", "127.0.0.1:9", "`/v2/z`", "localhost:80/a",
    ]


def test_config_lines(corpus):
    text = "  REPORT=12  \nport = 7\nAPI_KEY =\n 'k'\nDATABASE_URL=\"\"\nredis_url: `x`\n"
    rows = X.config_deps(scan(corpus, {"a.py": text}, "configs")).collect()
    assert sorted((r["config_type"], r["config_value"], r["line_context"]) for r in rows) == [
        ("api_key_config", "k", ""), ("port_config", "12", "REPORT=12"), ("port_config", "7", "REPORT=12"),
    ]


def test_routes_and_queues(corpus):
    files = corpus([
        (1, "a.py", "@app.route('/x') POST \"/y\" app.Delete(`/z`) [Route('r' )]"),
        (1, "b.js", "Kafka"), (2, "c.rb", "subTopic"), (3, "d.rs", "none"),
    ])
    rows = X.http_apis(X.scan(files, "routes")).collect()
    assert sorted((r["pattern_id"], r["method"], r["route"]) for r in rows) == [
        (1, None, 'POST "/y"'), (2, None, "/x"), (3, "Delete", "/z"), (4, None, "r"),
    ]
    queues = {(r["repo_id"], r["pattern"]) for r in X.mq_usage(X.scan(files, "queues")).collect()}
    assert queues == {(1, rules.QUEUE_PATTERNS[0].text), (2, rules.QUEUE_PATTERNS[1].text)}


NAMES = [".env", "a.json", "app.json", "my app.json", "app.json.config", "x.env", "tsconfig.json",
         "b.yaml", "d'e.ini", "é.toml", "config.yml", "onfig.yml", "z" * 200 + ".json", ".json"]
PARTS = NAMES + ["/", " ", "'", "x", "app", ".js", "process.env", ".yaml", "\n", "my", "z" * 90, "nfig.yml"]


def test_shared_resources_equal_substring_search(spark, corpus):
    rng = random.Random(3)
    suffixes = [s for options in rules.DISCOVERY_SUFFIXES.values() for s in options]
    rows = []
    for repo in range(40):
        for i in range(rng.randint(1, 6)):
            rows.append((repo, f"s{i}{rng.choice(suffixes)}", "".join(rng.choices(PARTS, k=rng.randint(0, 14)))))
        for i, name in enumerate(rng.sample(NAMES, rng.randint(0, 6))):
            rows.append((repo, f"d{i}/{name}", ""))
    rows.append((99, "a.py", (".yml" * 300) + "x.ini"))
    rows.append((99, "b.go", "q" + (".yml" * 40)))
    rows.append((99, "conf/" + ".yml" * 40, ""))
    files = corpus(rows)
    languages = {(r["repo_id"], r["path"]): r["language"] for r in discovered_files(files).collect()}
    expected = set()
    for repo, path, _ in rows:
        name = path.rsplit("/", 1)[-1]
        if name.endswith(rules.CONFIG_SUFFIXES):
            users = {languages[r, p] for r, p, text in rows
                     if r == repo and (r, p) in languages and name in text}
            expected |= {(repo, path, language) for language in users if len(users) > 1}
    found = X.shared_resources(files, X.scan(files, "name_ends")).collect()
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert len(expected) > 40


def test_build_files(corpus):
    files = corpus([
        (1, "a.py", ""), (1, "b.go", ""), (1, "node_modules/package.json", ""), (1, "Dockerfile", ""),
        (1, "x/setup.py", ""), (1, "dockerfile", ""), (1, "CMakeLists.txt", ""),
    ])
    present = X.languages_present(discovered_files(files))
    rows = sorted((r["build_system"], r["language"] or "") for r in X.build_deps(files, present).collect())
    assert rows == [("cmake", ""), ("docker", "go"), ("docker", "python"), ("npm", ""), ("pip", "python")]


def edges_with_degrees(spark, degrees):
    rows = [(1, f"go:f{d}", f"api:{d}-{i}", "api_call") for d in degrees for i in range(d)]
    return spark.createDataFrame(rows, "repo_id long, src string, dst string, type string")


def test_hotspot_thresholds(spark):
    found = {r["component"]: r["severity"] for r in
             X.hotspots(edges_with_degrees(spark, (5, 6, 10, 11))).collect()}
    assert found == {"go:f6": "medium", "go:f10": "medium", "go:f11": "high"}


def test_graph_merges_equal_names(corpus):
    files = corpus({"x/a.py": "'/api/u' '/api/u'", "y/a.py": "'/api/u' conf.json", "b.go": "conf.json", "conf.json": ""})
    extracts = X.Extracts(files)
    assert sorted((r["src"], r["dst"]) for r in extracts.edges().collect()) == [
        ("go:component", "resource:conf.json"), ("python:a.py", "api:/api/u"),
        ("python:component", "resource:conf.json"),
    ]
    row = X.graph_metrics(extracts.edges()).first()
    assert (row["total_nodes"], row["total_edges"], row["strongly_connected_components"]) == (5, 3, 5)
    assert row["density"] == pytest.approx(3 / 20)


@pytest.mark.parametrize("languages, files, links, talk, expected", [
    (2, 10, 0, 0, ("hybrid", "loose", "low", 70)),
    (3, 10, 0, 6, ("monolithic", "loose", "medium", 60)),
    (4, 10, 0, 0, ("microservices", "loose", "low", 85)),
    (4, 100, 9, 11, ("microservices", "moderate", "high", 45)),
    (5, 10, 1, 11, ("microservices", "tight", "high", 35)),
])
def test_insights(spark, languages, files, links, talk, expected):
    counts = spark.createDataFrame(
        [(1, languages, files, links, 0, 0, 0, talk, 0)],
        "repo_id long, languages long, total_files long, api_dependencies long, shared_resources long,"
        "configuration_dependencies long, build_dependencies long, http_apis long, message_queues long",
    )
    row = X.insights(counts).first()
    assert (row["architecture_style"], row["coupling_level"], row["communication_complexity"],
            row["maintainability_score"]) == expected


def test_single_language_repository(corpus):
    extracts = X.Extracts(corpus({"a.py": "'/api/x' PORT=1", "Makefile": ""}))
    assert extracts.edges().count() == 0 and X.polyglot_rows(extracts).count() == 0
    assert X.insights(extracts.counts()).count() == 0
    advice = X.recommendations(extracts.counts(), extracts.edges()).collect()
    assert [r["recommendation"] for r in advice] == [rules.SINGLE_LANGUAGE_MESSAGE]
    row = X.polyglot_report(extracts).first()
    assert (row["languages"], row["total_files"], row["recommendations"]) == (1, 1, 1)
    assert row["api_dependencies"] is None and row["architecture_style"] is None


def test_report_agrees_with_its_parts(corpus):
    texts = {f"s{i}.js": " ".join(f"'/api/{j}'" for j in range(12)) for i in range(2)}
    texts |= {"a.py": "PORT=1 queue", "b.go": "x", "Dockerfile": ""}
    extracts = X.Extracts(corpus(texts))
    row = X.polyglot_report(extracts).first()
    advice = X.recommendations(extracts.counts(), extracts.edges())
    assert row["recommendations"] == advice.count() == 7
    assert row["high_hotspots"] == 2 and row["hotspots"] == 2
    assert (row["coupling_level"], row["maintainability_score"]) == ("tight", 50)


def test_names_of_any_length_are_found(spark, corpus):
    long = "n" * 300 + ".json"
    files = corpus({
        f"conf/{long}": "{}", "a.py": f"open('{long}')", "b.go": f'Read("x/{long}")', "c.js": "n.json",
        ".env": "", "d.py": "'.env'", "e.js": "'.env'", "x.ini": "", "f.py": "ax.ini", "g.go": "x.ini.env.json",
    })
    found = X.shared_resources(files, X.scan(files, "name_ends")).collect()
    assert sorted((r["resource_path"], r["language"]) for r in found) == sorted(
        [(f"conf/{long}", "python"), (f"conf/{long}", "go"), ("x.ini", "python"), ("x.ini", "go"),
         (".env", "python"), (".env", "javascript"), (".env", "go")]
    )


def test_ends_are_smaller_than_the_text(spark, corpus):
    from pyspark.sql import functions as F

    text = "".join(f"res{i % 50}.json(x); cfg.config.initialize();\n" for i in range(1000))
    row = X.scan(corpus({"a.js": text}), "name_ends").select(F.char_length(F.array_join("name_ends", ""))).first()
    assert row[0] < len(text) / 20


def test_bridge_edges_name_callers_and_definitions(spark, corpus):
    from codeloom.operators import bridges

    files = corpus({
        "srv.py": "@app.get('/api/items')\ndef f(): pass\n", "web.js": "fetch('/api/items')\n", "other.js": "fetch('/api/none')\n",
    })
    scanned = X.scan(files, "endpoints", "routes")
    found = bridges.bridge_edges(X.http_apis(scanned), X.api_endpoints(scanned)).collect()
    assert sorted((r["src"], r["dst"], r["type"]) for r in found) == [
        ("javascript:web.js", "route:/api/items", "calls"), ("route:/api/items", "python:srv.py", "implements"),
    ]
