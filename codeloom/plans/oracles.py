"""The registered queries as DuckDB SQL over the same tables.

These are written for checking, not for speed: they use the plain patterns (RE2
needs no linear forms), walk texts character by character where Spark uses array
functions, and join on substrings where Spark uses keys.
"""

from __future__ import annotations

from codeloom import rules
from codeloom.operators import schemas
from codeloom.plans import fixture


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _opt(p: rules.Pattern) -> str:
    return "'i'" if p.ignore_case else "'c'"


def _all(text: str, p: rules.Pattern, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {_q(p.text)}, {group}, {_opt(p)})"


def _hit(text: str, p: rules.Pattern) -> str:
    return f"regexp_matches({text}, {_q(p.text)}, {_opt(p)})"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def _suffix(text: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({text}, {_q(s)})" for s in suffixes) + ")"


def _concat(lists) -> str:
    return "flatten([" + ", ".join(lists) + "])"


_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def _strip(text: str) -> str:
    return f"trim({text}, {_BLANKS})"


_DIRS = "list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1)"
_BASE = "list_extract(string_split({0}, '/'), -1)"


def _base(path: str) -> str:
    return _BASE.format(path)


def _scan_test(language: str) -> str:
    suffixes, skipped = rules.LANGUAGE_SCANS[language]
    return f"({_suffix('path', suffixes)} AND NOT list_has_any({_DIRS}, {_list(skipped)}))"


_LANGUAGE = "CASE " + " ".join(
    f"WHEN {_scan_test(name)} THEN {_q(name)}" for name in rules.LANGUAGE_SCANS
) + " END"
_DISCOVERED = "CASE " + " ".join(
    f"WHEN {_suffix('path', suffixes)} THEN {_q(name)}"
    for name, suffixes in rules.DISCOVERY_SUFFIXES.items()
) + " END"

_FILES = f"""files AS MATERIALIZED (
  SELECT repo_id, path, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content
  FROM ({fixture.files_sql()}) corpus)"""
_SRC = f"""src AS MATERIALIZED (
  SELECT * FROM (SELECT *, {_LANGUAGE} AS language FROM files) scanned WHERE language IS NOT NULL)"""
_POLY = f"""poly AS MATERIALIZED (
  SELECT * FROM (SELECT *, {_DISCOVERED} AS language FROM files
                 WHERE NOT list_has_any({_DIRS}, {_list(rules.DISCOVERY_SKIP)})) found
  WHERE language IS NOT NULL)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _code(*more: str) -> str:
    return _with(_FILES, _SRC, *more)


def _cross(*more: str) -> str:
    return _with(_FILES, _POLY, *more)


def _route_matches() -> str:
    """All definitions as regular expressions against all calls of the repository."""
    plain = "replace(replace(replace({0}, chr(39), ''), chr(34), ''), '`', '')"
    called = f"regexp_replace(regexp_replace({plain}, '^[^/]*', ''), '[?#].*$|/+$', '', 'g')"
    defined = f"trim(regexp_replace({plain.format('route')}, '^(GET|POST|PUT|DELETE|PATCH)\\s+', '', 'i'), '/')"
    kind = """CASE WHEN i = len(steps) AND regexp_full_match(s, '\\{\\*.*\\}|<path:\\w+>|\\*.*|:\\w+[*+]') THEN 3
        WHEN regexp_full_match(s, '<int:\\w+>|\\{\\w+:int\\??\\}') THEN 1
        WHEN regexp_matches(s, '^:\\w|^\\*|<\\w+(:\\w+)?>|\\{.*\\}') THEN 2 ELSE 0 END"""
    corpus = _cross(_ENDPOINTS, _ROUTES).replace(fixture.files_sql(), fixture.route_files_sql())
    return corpus.rstrip() + f""",
      defined AS MATERIALIZED (SELECT DISTINCT repo_id, source_file, {called.format('route')} AS called, string_split({defined}, '/') AS steps,
          regexp_matches({plain.format('route')}, '/(:\\w+|\\{{[\\w:]+)\\?\\}}?$') AS optional FROM routes),
      kinds AS MATERIALIZED (SELECT *, list_transform(steps, lambda s, i: {kind}) AS kind FROM defined),
      pieces AS MATERIALIZED (SELECT *, list_transform(steps, lambda s, i: CASE kind[i] WHEN 0 THEN s WHEN 1 THEN '{{int}}' WHEN 2 THEN '{{}}' ELSE '{{*}}' END) AS shown,
          list_transform(steps, lambda s, i: CASE kind[i] WHEN 0 THEN regexp_escape(s) WHEN 1 THEN '([0-9]+|[^/]*\\{{[^/]*)' WHEN 2 THEN '[^/]+' ELSE '.+' END) AS expression FROM kinds),
      ends AS (SELECT *, unnest(CASE WHEN optional THEN [len(steps), len(steps) - 1] ELSE [len(steps)] END) AS n FROM pieces),
      patterns AS MATERIALIZED (SELECT repo_id, array_to_string(kind[:n], '') AS rank, '/' || array_to_string(shown[:n], '/') AS pattern,
          '/' || array_to_string(expression[:n], '/') AS expression, count(DISTINCT source_file) AS definitions FROM ends GROUP BY ALL),
      calls AS MATERIALIZED (SELECT repo_id, called AS route, count(DISTINCT source_file) AS callers
        FROM (SELECT repo_id, source_file, {called.format('endpoint')} AS called FROM endpoints) e
        WHERE called <> '' AND (repo_id, source_file, called) NOT IN (SELECT (repo_id, source_file, called) FROM defined) GROUP BY ALL),
      best AS (SELECT c.repo_id, c.route, c.callers, p.*, row_number() OVER (PARTITION BY c.repo_id, c.route ORDER BY p.rank) AS place
        FROM calls c JOIN patterns p ON p.repo_id = c.repo_id AND regexp_full_match(c.route, p.expression))
      SELECT repo_id, route, pattern, len(replace(rank, '0', ''))::BIGINT AS parameters, callers, definitions FROM best WHERE place = 1"""


def _symbol_edges() -> str:
    """Symbols of the derived corpus, each looked for scope by scope."""
    declared = (
        ("python", "type", "class", r"(?m)^class\s+(\w+)"), ("python", "function", "function", r"(?m)^(?:async )?def\s+(\w+)"),
        ("javascript", "type", "class", r"\bclass\s+(\w+)"), ("javascript", "type", "interface", r"\binterface\s+(\w+)"),
        ("javascript", "function", "function", r"\bfunction\s+(\w+)"), ("csharp", "type", "class", r"\bclass\s+(\w+)"),
        ("csharp", "type", "interface", r"\binterface\s+(\w+)"), ("java", "type", "class", r"\bclass\s+(\w+)"),
        ("java", "type", "interface", r"\binterface\s+(\w+)"), ("go", "function", "function", r"(?m)^func\s+(\w+)"),
    )
    brace = r"\b(class|interface)\s+(\w+)\s+extends\s+([\w.]+)"
    listed = r"\b(class)\s+(\w+)(?:\s+extends\s+[\w.]+)?\s+implements\s+([\w., ]+?)\s*\{"
    bases = (
        ("python", "extends", r"(?m)^(class)\s+(\w+)\(([^()]*)\):"), ("javascript", "extends", brace), ("java", "extends", brace),
        ("javascript", "implements", listed), ("java", "implements", listed),
        ("csharp", "extends", r"\b(class|interface)\s+(\w+)\s*:\s*([\w., ]+?)\s*\{"),
    )
    imports = (
        ("java", r"\bimport\s+([\w.]+(?:\.\*)?);", r"regexp_replace(n, '\.[^.]*$', '')", "nullif(regexp_extract(n, '[^.]*$'), '*')"),
        ("csharp", r"\busing\s+([\w.]+);", "n", "NULL"),
        ("python", r"from (\w[\w.]*) import", "n", "NULL"),
        ("python", r"from \.\.(\w+) import", "array_to_string(parts[:len(parts) - 2], '.') || '.' || n", "NULL"),
        ("javascript", r"from '\.\./(\w+)'", "array_to_string(parts[:len(parts) - 2], '/') || '/' || n", "NULL"),
    )
    names = "\nUNION ALL ".join(
        f"SELECT repo_id, path, language, {_q(w)} AS what, {_q(k)} AS kind, unnest(regexp_extract_all(plain, {_q(p)}, 1)) AS name FROM code WHERE language = {_q(n)}"
        for n, w, k, p in declared)
    heads = "\nUNION ALL ".join(
        f"SELECT repo_id, path, language, {_q(how)} AS how, unnest(regexp_extract_all(plain, {_q(p)}, 1)) AS owner_kind, unnest(regexp_extract_all(plain, {_q(p)}, 2)) AS owner, unnest(regexp_extract_all(plain, {_q(p)}, 3)) AS names FROM code WHERE language = {_q(n)}"
        for n, how, p in bases)
    opened = "\nUNION ALL ".join(
        f"SELECT repo_id, path, 'import:' || {scope} AS scope, 1 AS level, {only} AS only FROM (SELECT repo_id, path, parts, unnest(regexp_extract_all(content, {_q(p)}, 1)) AS n FROM code WHERE language = {_q(n)}) i"
        for n, p, scope, only in imports)
    bare = r"regexp_replace(replace(plain, '(', '( '), '\b(def|func|function|class|new)\s+\w+', '', 'g')"
    return f"""WITH code AS MATERIALIZED (SELECT *, string_split(path, '/') AS parts, regexp_replace(path, '\\.[^./]*$', '') AS stem,
        CASE regexp_extract(path, '[^.]*$') WHEN 'py' THEN 'python' WHEN 'ts' THEN 'javascript' WHEN 'cs' THEN 'csharp' ELSE regexp_extract(path, '[^.]*$') END AS language,
        regexp_replace(regexp_replace(regexp_replace(content, '"[^"\\n]*"|//[^\\n]*|#[^\\n]*', '', 'g'), '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g') AS plain
      FROM ({fixture.symbol_files_sql()}) corpus),
      declared AS MATERIALIZED ({names}),
      refs AS MATERIALIZED (SELECT DISTINCT repo_id, path, language, 'type' AS what, how, owner_kind, owner, trim(unnest(string_split(names, ','))) AS name FROM ({heads}) h
        UNION ALL SELECT DISTINCT repo_id, path, language, 'function', 'calls', '', '', unnest(regexp_extract_all({bare}, '(?:^|[^\\w.])(\\w+)\\s*\\(', 1)) FROM code WHERE language IN ('python', 'javascript', 'go')),
      looks AS MATERIALIZED (SELECT repo_id, path, 'file:' || path AS scope, 0 AS level, NULL AS only FROM code
        UNION ALL SELECT repo_id, path, 'folder:' || array_to_string(parts[:len(parts) - 1], '/'), 2, NULL FROM code
        UNION ALL SELECT repo_id, path, 'repository', 3, NULL FROM code UNION ALL {opened}),
      scopes AS MATERIALIZED (SELECT repo_id, path, scope FROM looks WHERE level <> 1
        UNION ALL SELECT repo_id, path, 'import:' || CASE language WHEN 'python' THEN replace(stem, '/', '.') WHEN 'javascript' THEN stem
          WHEN 'java' THEN regexp_extract(content, 'package ([\\w.]+)', 1) ELSE regexp_extract(content, 'namespace ([\\w.]+)', 1) END FROM code WHERE language <> 'go'),
      places AS MATERIALIZED (SELECT d.*, s.scope FROM declared d JOIN scopes s ON s.repo_id = d.repo_id AND s.path = d.path),
      hits AS (SELECT r.repo_id, r.path, r.language, r.what, r.how, r.owner_kind, r.owner, r.name, l.level, count(DISTINCT p.path) AS n, min(p.path) AS target, max(p.kind) AS kind
        FROM refs r JOIN looks l ON l.repo_id = r.repo_id AND l.path = r.path AND (l.only IS NULL OR l.only = r.name)
        JOIN places p ON p.repo_id = r.repo_id AND p.language = r.language AND p.scope = l.scope AND p.what = r.what AND p.name = r.name
        GROUP BY ALL),
      seen AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, what, how, owner_kind, owner, name ORDER BY level) AS place FROM hits)
      SELECT DISTINCT repo_id, language || ':' || path || CASE what WHEN 'type' THEN '#' || owner ELSE '' END AS src,
        language || ':' || target || '#' || name AS dst,
        CASE WHEN how = 'calls' THEN 'calls' WHEN how = 'implements' OR (kind = 'interface' AND owner_kind <> 'interface') THEN 'implements' ELSE 'inherits' END AS type
      FROM seen WHERE place = 1 AND n = 1"""


# ------------------------------------------------------------- python facts

_PY = """py AS MATERIALIZED (
  SELECT *, contains(content, 'def broken_') AS broken FROM src WHERE language = 'python'),
pyline AS MATERIALIZED (
  SELECT repo_id, path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS ln,
         unnest(string_split(content, chr(10))) AS text FROM py WHERE NOT broken),
pyimp AS MATERIALIZED (
  SELECT repo_id, path, module, split_part(unnest(names), ' as ', 1) AS name FROM (
    SELECT repo_id, path,
      CASE WHEN starts_with(text, 'from ') THEN ltrim(regexp_extract(text, '^from (\\S+) import', 1), '.') END AS module,
      string_split(CASE WHEN starts_with(text, 'from ') THEN regexp_extract(text, ' import (.*)$', 1)
                        ELSE substr(text, 8) END, ', ') AS names
    FROM pyline WHERE regexp_matches(text, '^(import|from) ')) stmts),
pydep AS (
  SELECT DISTINCT repo_id, path, 'python' AS language, target FROM (
    SELECT repo_id, path, module AS target FROM pyimp WHERE module <> ''
    UNION ALL
    SELECT repo_id, path, CASE WHEN module <> '' THEN module || '.' || name ELSE name END FROM pyimp) deps)"""

_PY_FUNCTIONS = """pydef AS (
  SELECT repo_id, path, ln, regexp_extract(text, '^ *def (\\w+)', 1) AS name,
         len(text) - len(ltrim(text)) AS indent
  FROM pyline WHERE regexp_matches(text, '^ *def ')),
pyend AS (
  SELECT d.repo_id, d.path, d.ln, d.name, min(e.ln) AS stop FROM pydef d LEFT JOIN pyline e
    ON e.repo_id = d.repo_id AND e.path = d.path AND e.ln > d.ln
   AND trim(e.text) <> '' AND len(e.text) - len(ltrim(e.text)) <= d.indent
  GROUP BY ALL),
pyfn AS (
  SELECT d.repo_id, d.path, 'python' AS language, d.name, 'function' AS fn_type,
         CAST(1 + sum(CASE WHEN regexp_matches(b.text, '^\\s*(if|elif|while|for|try|with)\\b') THEN 1 ELSE 0 END
             + len(regexp_extract_all(b.text, '\\b(and|or)\\b'))) AS BIGINT) AS complexity
  FROM pyend d JOIN pyline b ON b.repo_id = d.repo_id AND b.path = d.path
   AND b.ln >= d.ln AND (d.stop IS NULL OR b.ln < d.stop)
  GROUP BY d.repo_id, d.path, d.ln, d.name)"""

# --------------------------------------------------------------- declarations


def _js_functions(text: str = "content") -> str:
    return f"list_distinct({_concat(_all(text, p, 1) for p in rules.JS_FUNCTIONS)})"


def _js_imports(text: str = "content") -> str:
    return f"list_distinct({_concat(_all(text, p, 1) for p in rules.JS_IMPORTS)})"


def _js_exports() -> str:
    def of(p: rules.Pattern) -> str:
        names = _all("content", p, 1)
        return (
            f"CASE WHEN contains({names}[1], ',') THEN "
            f"list_transform(string_split({names}[1], ','), lambda n: {_strip('n')}) ELSE {names} END"
        )

    return f"list_distinct({_concat(of(p) for p in rules.JS_EXPORTS)})"


def _go_imports() -> str:
    block = _all("content", rules.GO_IMPORT, 1)
    single = _all("content", rules.GO_IMPORT, 2)
    quoted = "regexp_extract_all(l, '\"([^\"]+)\"', 1)"
    lines = (
        f"flatten(list_transform({block}, lambda b: "
        f"flatten(list_transform(string_split(b, chr(10)), lambda l: {quoted}))))"
    )
    return f"list_concat({lines}, list_filter({single}, lambda s: s <> ''))"


def _kind_rows(language: str, kinds: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT repo_id, path, language, {_q(kind)} AS kind, unnest({names}) AS name "
        f"FROM src WHERE language = {_q(language)}"
        for kind, names in kinds.items()
    )


_KINDS = {
    "javascript": {"function": _js_functions(), "class": _all("content", rules.JS_CLASS, 1),
                   "import": _js_imports(), "export": _js_exports()},
    "csharp": {**{k: _all("content", p, 1) for k, p in rules.CSHARP_DECLARATIONS.items()},
               "using": _all("content", rules.CSHARP_USING, 1)},
    "java": {**{k: _all("content", p, 1) for k, p in rules.JAVA_DECLARATIONS.items()},
             "import": _all("content", rules.JAVA_IMPORT, 1)},
    "go": {**{k: _all("content", p, 1) for k, p in rules.GO_DECLARATIONS.items()},
           "import": _go_imports()},
}


def _declared(language: str, *kinds: str) -> str:
    chosen = {k: v for k, v in _KINDS[language].items() if not kinds or k in kinds}
    return _code() + _kind_rows(language, chosen)


def _loc(language: str) -> str:
    mark = _q(rules.LINE_COMMENT[language])
    return (
        f"len(list_filter(string_split(content, chr(10)), lambda l: {_strip('l')} <> '' "
        f"AND NOT starts_with({_strip('l')}, {mark})))"
    )


_LOC = "CASE language " + " ".join(
    f"WHEN {_q(name)} THEN {_loc(name)}" for name in rules.LINE_COMMENT
) + " END"


def _file_stats(language: str) -> str:
    counts = ", ".join(
        f"CAST(len({names}) AS BIGINT) AS {kind}_count" for kind, names in _KINDS[language].items()
    )
    return _code() + (
        f"SELECT repo_id, path, language, CAST({_loc(language)} AS BIGINT) AS loc, {counts} "
        f"FROM src WHERE language = {_q(language)}"
    )


def _fields(language: str) -> str:
    return ", ".join(f"'{name}': {name}" for name in ["loc", *[f"{kind}_count" for kind in _KINDS[language]]])


_IMPORTS = "edges AS MATERIALIZED (" + "\nUNION ALL\n".join([
    f"SELECT f.repo_id, f.path, f.language, i.target FROM src f LEFT JOIN (SELECT repo_id, path, unnest({_js_imports()}) AS target FROM src WHERE language = 'javascript') i ON i.repo_id = f.repo_id AND i.path = f.path WHERE f.language = 'javascript'",
    f"SELECT DISTINCT f.repo_id, f.path, f.language, i.target FROM src f LEFT JOIN (SELECT repo_id, path, unnest({_KINDS['java']['import']}) AS target FROM src WHERE language = 'java') i ON i.repo_id = f.repo_id AND i.path = f.path WHERE f.language = 'java'",
    f"SELECT DISTINCT repo_id, path, language, unnest({_KINDS['csharp']['using']}) FROM src WHERE language = 'csharp'",
    f"SELECT DISTINCT repo_id, path, language, unnest({_go_imports()}) FROM src WHERE language = 'go'",
    "SELECT * FROM pydep",
]) + ")"

# ------------------------------------------------------------------ manifests

def _npm_fine(section: str) -> str:
    """The section is absent or an object."""
    return f"coalesce(json_type(doc, '$.{section}'), 'OBJECT') = 'OBJECT'"


def _npm_keys(section: str, *before: str) -> str:
    fine = " AND ".join(_npm_fine(s) for s in (*before, section))
    return f"CASE WHEN {fine} THEN coalesce(json_keys(doc, '$.{section}'), []) ELSE [] END"


_NPM_KEYS = "flatten([" + ", ".join(
    _npm_keys(s, *rules.NPM_SECTIONS[:k]) for k, s in enumerate(rules.NPM_SECTIONS)
) + "])"
_NPM_DOC = """npm AS (
  SELECT repo_id, path, CASE WHEN json_type(parsed) = 'OBJECT' THEN parsed ELSE CAST('{}' AS JSON) END AS doc
  FROM (SELECT repo_id, path, CASE WHEN json_valid(content) THEN CAST(content AS JSON) ELSE CAST('{}' AS JSON) END AS parsed
        FROM files WHERE path = 'package.json') tested)"""
_NPM = f"SELECT DISTINCT repo_id, 'javascript' AS language, path AS manifest, unnest({_NPM_KEYS}) AS package FROM npm"
# All references of the corpus are written plainly, so the pattern finds them in
# well-formed files too; the malformed one with more blanks also matches it.
_NUGET = f"""SELECT DISTINCT repo_id, 'csharp' AS language, path AS manifest,
  unnest({_all('content', rules.NUGET_REFERENCE, 1)}) AS package
FROM files WHERE ends_with(path, '.csproj') OR ends_with(path, '.sln')"""
_MAVEN = """SELECT DISTINCT repo_id, 'java' AS language, path AS manifest, g || ':' || a || CASE WHEN v <> '' THEN ':' || v ELSE '' END AS package
FROM (SELECT repo_id, path, regexp_extract(d, '<groupId>([^<]*)</groupId><artifactId>', 1) AS g,
        regexp_extract(d, '<artifactId>([^<]*)<', 1) AS a, regexp_extract(d, '<version>([^<]*)<', 1) AS v
      FROM (SELECT repo_id, path, unnest(regexp_extract_all(content, '<dependency>.*</dependency>')) AS d
            FROM files WHERE path = 'pom.xml' AND contains(content, '<project xmlns') AND contains(content, '</project>')) blocks) coords
WHERE g <> '' AND a <> ''"""
_GRADLE = f"""SELECT DISTINCT repo_id, 'java' AS language, path AS manifest,
  unnest({_concat(_all('content', p, 1) for p in rules.GRADLE_PATTERNS)}) AS package
FROM files WHERE path = 'build.gradle'"""
_GOMOD = f"""SELECT DISTINCT repo_id, 'go' AS language, path AS manifest,
  unnest(list_transform(list_zip({_all('content', rules.GO_REQUIRE, 1)}, {_all('content', rules.GO_REQUIRE, 2)}),
         lambda z: z[1] || '@' || z[2])) AS package
FROM files WHERE path = 'go.mod'"""
_PACKAGES = f"""packages AS MATERIALIZED (
  SELECT DISTINCT repo_id, language, package FROM (
    {_NPM} UNION ALL {_NUGET} UNION ALL {_MAVEN} UNION ALL {_GRADLE} UNION ALL {_GOMOD}) listed)"""

_ERRORS = f"""errors AS MATERIALIZED (
  SELECT repo_id, tool, line_no,
    CASE tool WHEN 'go build' THEN 'build: ' WHEN 'go vet' THEN 'vet: ' ELSE '' END || {_strip('line')} AS message
  FROM ({fixture.LOG_SQL}) logs
  WHERE CASE tool WHEN 'tsc' THEN contains(line, 'error TS') WHEN 'dotnet' THEN contains(line, 'error CS')
        WHEN 'maven' THEN contains(line, 'ERROR') WHEN 'gradle' THEN contains(lower(line), 'error:')
        ELSE {_strip('line')} <> '' AND NOT starts_with(line, '#') END)"""

# ------------------------------------------------------------------ complexity


def _header_rows(language: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT repo_id, path, language, {_q(kind)} AS fn_type, k, n[k] AS name,
  list_sum(list_transform(p[1:k], lambda x: len(x))) + list_sum(list_transform(m[1:k], lambda x: len(x))) AS open_pos
FROM (SELECT *, unnest(generate_series(1, len(m))) AS k FROM (
  SELECT repo_id, path, language, {_all('content', h)} AS m, {_all('content', h, 1)} AS n,
         string_split_regex(content, {_q(h.text)}) AS p
  FROM src WHERE language = {_q(language)}) cut) numbered"""
        for h, kind in rules.FUNCTION_HEADERS[language]
    )


def _decisions(language: str) -> str:
    return "1 + " + " + ".join(f"len({_all('body', p)})" for p in rules.DECISIONS[language])


def _functions(*languages: str) -> str:
    wanted = languages or ("javascript", "csharp", "java", "go")
    heads = "\nUNION ALL\n".join(_header_rows(name) for name in wanted)
    cases = " ".join(f"WHEN {_q(name)} THEN {_decisions(name)}" for name in wanted)
    return f"""head AS MATERIALIZED ({heads}),
brace AS (
  SELECT repo_id, path, pos, ch, sum(CASE ch WHEN '{{' THEN 1 ELSE -1 END)
           OVER (PARTITION BY repo_id, path ORDER BY pos) AS depth
  FROM (SELECT repo_id, path, unnest(generate_series(1, len(content))) AS pos,
               unnest(string_split(content, '')) AS ch
        FROM src WHERE language IN ({', '.join(_q(n) for n in wanted)})) chars
  WHERE ch IN ('{{', '}}')),
pair AS (
  SELECT repo_id, path, pos, ch, lead(pos) OVER (
    PARTITION BY repo_id, path, CASE ch WHEN '{{' THEN depth ELSE depth + 1 END ORDER BY pos) AS close_pos
  FROM brace),
body AS (
  SELECT h.repo_id, h.path, h.language, h.name, h.fn_type, h.open_pos,
    CASE WHEN h.language = 'csharp' THEN
           CASE WHEN b.close_pos IS NULL THEN '' ELSE substr(f.content, CAST(h.open_pos + 1 AS BIGINT), CAST(b.close_pos - h.open_pos - 1 AS BIGINT)) END
         WHEN b.close_pos IS NULL THEN substr(f.content, CAST(h.open_pos AS BIGINT), 2)
         ELSE substr(f.content, CAST(h.open_pos AS BIGINT), CAST(b.close_pos - h.open_pos + 1 AS BIGINT)) END AS body
  FROM head h JOIN src f ON f.repo_id = h.repo_id AND f.path = h.path
  JOIN pair b ON b.repo_id = h.repo_id AND b.path = h.path AND b.pos = h.open_pos AND b.ch = '{{'),
fn AS MATERIALIZED (
  SELECT repo_id, path, language, name, fn_type, body,
         CAST(CASE language {cases} END AS BIGINT) AS complexity FROM body)"""


_FN_COLUMNS = "repo_id, path, language, name, fn_type, complexity"
_ALL_FN = f"""allfn AS MATERIALIZED (
  SELECT {_FN_COLUMNS} FROM fn UNION ALL SELECT {_FN_COLUMNS} FROM pyfn)"""
_FILE_COMPLEXITY = """filecx AS MATERIALIZED (
  SELECT s.repo_id, s.path, s.language, CAST(1 + coalesce(sum(f.complexity), 0) AS BIGINT) AS total_complexity,
         count(f.complexity) AS functions
  FROM src s LEFT JOIN allfn f ON f.repo_id = s.repo_id AND f.path = s.path
  WHERE NOT (s.language = 'python' AND contains(s.content, 'def broken_'))
  GROUP BY s.repo_id, s.path, s.language)"""


def _complexity(select: str) -> str:
    return _code(_PY, _PY_FUNCTIONS, _functions(), _ALL_FN, _FILE_COMPLEXITY) + select


_BUCKET = "CASE " + " ".join(
    f"WHEN complexity >= {lowest} THEN {_q(name)}" for name, lowest in rules.COMPLEXITY_BUCKETS
) + " END"

# -------------------------------------------------------------------- security

_LINES = """line AS MATERIALIZED (
  SELECT repo_id, path, language, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line,
         unnest(string_split(content, chr(10))) AS text FROM src WHERE language <> 'python')"""
_PATTERN_FINDINGS = "\nUNION ALL\n".join(
    f"SELECT repo_id, path, language, line, {_q(r.rule_id)} AS rule_id, {_q(r.issue)} AS issue, "
    f"{_q(rules.SEVERITY)} AS severity, {_strip('text')} AS code "
    f"FROM line WHERE language = {_q(language)} AND {_hit('text', r.pattern)}"
    for language, rule_set in rules.SECURITY_RULES.items()
    for r in rule_set
)
_PY_CALLS = "|".join(rules.PYTHON_DANGEROUS_CALLS)
_PY_FINDINGS = f"""SELECT repo_id, path, 'python' AS language, ln AS line, 'py_' || name AS rule_id,
  {_q(rules.PYTHON_CALL_ISSUE)} || name AS issue, {_q(rules.SEVERITY)} AS severity, CAST(NULL AS VARCHAR) AS code
FROM (SELECT repo_id, path, ln, unnest(regexp_extract_all(text, '(?:^|[^.\\w])({_PY_CALLS})\\(', 1)) AS name FROM pyline) calls"""
_FINDINGS = f"findings AS MATERIALIZED ({_PATTERN_FINDINGS}\nUNION ALL\n{_PY_FINDINGS})"


def _security(select: str) -> str:
    return _code(_PY, _LINES, _FINDINGS) + select


# ---------------------------------------------------------------- architecture


def _first_label(table, keys: str) -> str:
    return "CASE " + " ".join(
        f"WHEN list_has_any({keys}, {_list(packages)}) THEN {_q(title)}" for title, packages in table
    ) + " END"


_STACK_KEYS = "CASE WHEN " + " AND ".join(_npm_fine(s) for s in rules.JS_STACK_SECTIONS) + " THEN flatten([" + ", ".join(
    f"coalesce(json_keys(doc, '$.{s}'), [])" for s in rules.JS_STACK_SECTIONS
) + "]) ELSE [] END"


def _java_features() -> str:
    rows = [
        f"SELECT repo_id, 'framework' AS feature, {_q(t)} AS value FROM src WHERE language = 'java' AND {_any('content', w)}"
        for t, w in rules.JAVA_FRAMEWORKS
    ]
    rows += [
        f"SELECT repo_id, 'design_pattern', {_q(t)} FROM src WHERE language = 'java' AND {_hit('content', p)}"
        for t, p in rules.JAVA_DESIGN_PATTERNS
    ]
    rows += [
        f"SELECT repo_id, 'spring_annotation', {_q(n)} FROM src WHERE language = 'java' AND contains(content, {_q('@' + n)})"
        for n in rules.SPRING_ANNOTATIONS
    ]
    rows.append(
        """SELECT repo_id, 'build_tool', CASE WHEN bool_or(path = 'pom.xml') THEN 'Maven' ELSE 'Gradle' END
        FROM files WHERE path IN ('pom.xml', 'build.gradle')
          AND repo_id IN (SELECT repo_id FROM src WHERE language = 'java') GROUP BY repo_id"""
    )
    return _code() + "SELECT DISTINCT * FROM (" + "\nUNION ALL\n".join(rows) + ") features"


def _module_label() -> str:
    return "CASE " + " ".join(
        f"WHEN {_any('content', words)} THEN {_q(title)}" for title, words in rules.JS_MODULE_SYSTEMS
    ) + " END"


# -------------------------------------------------------------- cross-language

_ENDPOINTS = f"""endpoints AS MATERIALIZED (
  SELECT repo_id, path AS source_file, language AS source_language, trim(e, '''"') AS endpoint
  FROM (SELECT repo_id, path, language, unnest({_concat(_all('content', p) for p in rules.ENDPOINT_PATTERNS)}) AS e FROM poly) hits)"""
_CONFIGS = "configs AS MATERIALIZED (" + "\nUNION ALL\n".join(
    f"""SELECT repo_id, path AS source_file, language AS source_language, {_q(kind)} AS config_type,
  unnest({_all('content', p, 1)}) AS config_value,
  coalesce({_strip(f"list_filter(string_split(content, chr(10)), lambda l: {_hit('l', p)})[1]")}, '') AS line_context FROM poly"""
    for kind, p in rules.CONFIG_PATTERNS
) + ")"
_ROUTES = "routes AS MATERIALIZED (" + "\nUNION ALL\n".join(
    f"""SELECT repo_id, path AS source_file, language AS source_language, CAST({i} AS BIGINT) AS pattern_id,
  {'CAST(NULL AS VARCHAR)' if method is None else f"unnest({_all('content', p, method)})"} AS method,
  unnest({_all('content', p, route)}) AS route FROM poly"""
    for i, (p, method, route) in enumerate(rules.HTTP_PATTERNS, 1)
) + ")"
_QUEUES = "queues AS MATERIALIZED (" + "\nUNION ALL\n".join(
    f"SELECT DISTINCT repo_id, {_q(p.text)} AS pattern FROM poly WHERE {_hit('content', p)}"
    for p in rules.QUEUE_PATTERNS
) + ")"
_SHARED = f"""refs AS (
  SELECT DISTINCT c.repo_id, c.path AS resource_path, s.language
  FROM (SELECT repo_id, path, {_base('path')} AS name FROM files WHERE {_suffix('path', rules.CONFIG_SUFFIXES)}) c
  JOIN poly s ON s.repo_id = c.repo_id AND contains(s.content, c.name)),
shared AS MATERIALIZED (
  SELECT * FROM refs WHERE (repo_id, resource_path) IN (
    SELECT (repo_id, resource_path) FROM refs GROUP BY repo_id, resource_path HAVING count(*) > 1))"""
_SYSTEM = "CASE " + " ".join(
    f"WHEN {_base('path')} IN ({', '.join(_q(n) for n in names)}) THEN {_q(title)}"
    for title, names in rules.BUILD_FILES.items()
) + " END"
_AFFECTS = "CASE build_system " + " ".join(
    f"WHEN {_q(title)} THEN {_list(names or rules.DISCOVERY_SUFFIXES)}"
    for title, names in rules.BUILD_LANGUAGES.items()
) + " END"
_BUILDS = f"""builds AS MATERIALIZED (
  SELECT * FROM (SELECT repo_id, path AS build_file, {_SYSTEM} AS build_system FROM files) named
  WHERE build_system IS NOT NULL)"""
_LANGS = """langs AS MATERIALIZED (
  SELECT repo_id, count(DISTINCT language) AS languages, count(*) AS total_files FROM poly GROUP BY repo_id),
multi AS (SELECT repo_id FROM langs WHERE languages > 1)"""
_EDGES = f"""edges AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT repo_id, source_language || ':' || {_base('source_file')} AS src, 'api:' || endpoint AS dst, 'api_call' AS type FROM endpoints
    UNION ALL
    SELECT repo_id, language || ':component', 'resource:' || {_base('resource_path')}, 'shared_resource' FROM shared) e
  WHERE repo_id IN (SELECT repo_id FROM multi)),
degrees AS MATERIALIZED (
  SELECT repo_id, node, count(*) AS degree FROM (
    SELECT repo_id, src AS node FROM edges UNION ALL SELECT repo_id, dst FROM edges) ends GROUP BY repo_id, node)"""
_METRICS = """metrics AS MATERIALIZED (
  SELECT n.repo_id, n.total_nodes, e.total_edges,
    CASE WHEN n.total_nodes <= 1 THEN 0.0 ELSE e.total_edges / (n.total_nodes * (n.total_nodes - 1)) END AS density
  FROM (SELECT repo_id, count(*) AS total_nodes FROM degrees GROUP BY repo_id) n
  JOIN (SELECT repo_id, count(*) AS total_edges FROM edges GROUP BY repo_id) e USING (repo_id))"""
_COUNTS = """counts AS MATERIALIZED (
  SELECT l.*, coalesce(a.n, 0) AS api_dependencies, coalesce(s.n, 0) AS shared_resources,
    coalesce(c.n, 0) AS configuration_dependencies, coalesce(b.n, 0) AS build_dependencies,
    coalesce(h.n, 0) AS http_apis, coalesce(q.n, 0) AS message_queues
  FROM langs l
  LEFT JOIN (SELECT repo_id, count(*) AS n FROM endpoints GROUP BY repo_id) a USING (repo_id)
  LEFT JOIN (SELECT repo_id, count(DISTINCT resource_path) AS n FROM shared GROUP BY repo_id) s USING (repo_id)
  LEFT JOIN (SELECT repo_id, count(*) AS n FROM configs GROUP BY repo_id) c USING (repo_id)
  LEFT JOIN (SELECT repo_id, count(*) AS n FROM builds GROUP BY repo_id) b USING (repo_id)
  LEFT JOIN (SELECT repo_id, count(*) AS n FROM routes GROUP BY repo_id) h USING (repo_id)
  LEFT JOIN (SELECT repo_id, count(*) AS n FROM queues GROUP BY repo_id) q USING (repo_id))"""
_INSIGHTS = """insights AS MATERIALIZED (
  SELECT *, greatest(0, least(100, 70
      - CASE coupling_level WHEN 'tight' THEN 20 WHEN 'moderate' THEN 10 ELSE 0 END
      - CASE communication_complexity WHEN 'high' THEN 15 WHEN 'medium' THEN 10 ELSE 0 END
      + CASE WHEN architecture_style = 'microservices' AND coupling_level = 'loose' THEN 15 ELSE 0 END))::BIGINT AS maintainability_score
  FROM (SELECT repo_id, languages, total_files, cross_dependencies, communication_marks,
      CASE WHEN languages > 3 THEN 'microservices' WHEN languages = 2 THEN 'hybrid' ELSE 'monolithic' END AS architecture_style,
      CASE WHEN cross_dependencies = 0 THEN 'loose' WHEN cross_dependencies / total_files < 0.1 THEN 'moderate' ELSE 'tight' END AS coupling_level,
      CASE WHEN communication_marks > 10 THEN 'high' WHEN communication_marks > 5 THEN 'medium' ELSE 'low' END AS communication_complexity
    FROM (SELECT *, api_dependencies + shared_resources + configuration_dependencies + build_dependencies AS cross_dependencies,
            http_apis + message_queues AS communication_marks FROM counts WHERE languages >= 2) sums) labels)"""
_A = rules.RECOMMENDATIONS
_ADVICE = "advice AS MATERIALIZED (" + "\nUNION ALL\n".join(
    [f"SELECT repo_id, 0::BIGINT AS ord, '' AS component, {_q(rules.SINGLE_LANGUAGE_MESSAGE)} AS recommendation FROM counts WHERE languages < 2"]
    + [
        f"SELECT repo_id, {o}::BIGINT, '', {_q(_A[key])} FROM insights WHERE {test}"
        for o, test, key in [
            (1, "coupling_level = 'tight'", "tight_interfaces"),
            (2, "coupling_level = 'tight'", "tight_events"),
            (3, "architecture_style = 'monolithic' AND languages > 2", "monolith"),
            (5, "communication_complexity = 'high'", "chatty_versioning"),
            (6, "communication_complexity = 'high'", "chatty_gateway"),
            (7, "maintainability_score < 60", "low_refactor"),
            (8, "maintainability_score < 60", "low_testing"),
        ]
    ]
    + [f"SELECT repo_id, 4::BIGINT, node, {_q(_A['hotspot_prefix'])} || node || {_q(_A['hotspot_suffix'])} FROM degrees WHERE degree > 10"]
) + ")"


def _graph(select: str) -> str:
    return _cross(_ENDPOINTS, _SHARED, _LANGS, _EDGES, _METRICS) + select


def _report(select: str) -> str:
    return _cross(
        _ENDPOINTS, _SHARED, _LANGS, _EDGES, _METRICS, _CONFIGS, _ROUTES, _QUEUES, _BUILDS,
        _COUNTS, _INSIGHTS, _ADVICE,
    ) + select


_LISTS = ("api_dependencies", "shared_resources", "configuration_dependencies",
          "build_dependencies", "http_apis", "message_queues")

# ------------------------------------------------------------- jobs, retrieval

_REPOS = "repos AS (SELECT o_orderkey AS repository_id, o_custkey AS user_id FROM orders)"
_JOBS = f"""ev AS MATERIALIZED ({fixture.JOB_EVENT_SQL}),
jobs AS MATERIALIZED (
  SELECT job_id, arg_max(status, (ts, event_id)) AS status,
    CAST(arg_max(progress, (ts, event_id)) FILTER (progress IS NOT NULL) AS BIGINT) AS progress,
    arg_max(error_message, (ts, event_id)) FILTER (error_message IS NOT NULL) AS error_message,
    min(ts) AS started_at, max(ts) FILTER (status = 'completed') AS completed_at
  FROM ev GROUP BY job_id)"""
_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _stamp(column: str) -> str:
    return f"{_STAMP.format(column)} AS {column}"


def _topk(k: int, where: str = "true", name: str = "hits") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS id,
      list_sum(list_transform(list_zip(q.embedding, c.embedding),
            lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance
    FROM (SELECT e.* FROM embeddings e JOIN benchmark b ON b.item_id = e.vec_id) q, embeddings c
    WHERE {where}) d) ranked WHERE rank <= {k})"""


def _aliases() -> str:
    pairs = ", ".join(f"({_q(a)}, {_q(t)})" for a, t in rules.LANGUAGE_ALIASES.items())
    return f"alias(name, analyser) AS (VALUES {pairs})"


_OF_MESSAGES = ", ".join(_q(kind) for kind in schemas.MESSAGES)
_MESSAGES = f"""schema_files AS ({fixture.schema_files_sql()}),
tokens AS (
  SELECT repo_id, path, schema, package, unnest(found) AS token, generate_subscripts(found, 1) AS place
  FROM (SELECT repo_id, path, regexp_extract(path, {_q(schemas.SCHEMA_FILE)}, 1) AS schema,
          regexp_extract(body, {_q(schemas.SCHEMA_PACKAGE)}, 1) AS package, regexp_extract_all(body, {_q(schemas.SCHEMA_TOKEN)}) AS found
        FROM (SELECT repo_id, path, regexp_replace(content, {_q(schemas.SCHEMA_NOISE)}, ' ', 'g') AS body
              FROM schema_files WHERE regexp_matches(path, {_q(schemas.SCHEMA_FILE)})) b) t),
levelled AS (
  SELECT *, suffix(token, '{{') AS opens,
    coalesce(sum(CASE WHEN suffix(token, '{{') THEN 1 WHEN token = '}}' THEN -1 ELSE 0 END)
      OVER (PARTITION BY repo_id, path ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level
  FROM tokens),
blocks AS MATERIALIZED (
  SELECT *, regexp_extract(token, '^(\\w+)\\s', 1) AS kind, regexp_extract(token, '^\\w+\\s+(\\w+)', 1) AS name
  FROM levelled WHERE opens),
held AS MATERIALIZED (
  SELECT t.repo_id, t.path, t.place, max(b.place) AS holder
  FROM levelled t LEFT JOIN blocks b ON b.repo_id = t.repo_id AND b.path = t.path AND b.place < t.place AND b.level = t.level - 1
  GROUP BY ALL),
outward(repo_id, path, place, outer_block, name) AS (
  SELECT repo_id, path, place, holder, name FROM blocks JOIN held USING (repo_id, path, place) WHERE kind IN ({_OF_MESSAGES})
  UNION ALL
  SELECT o.repo_id, o.path, o.place, h.holder, CASE WHEN b.kind IN ({_OF_MESSAGES}) THEN b.name || '.' || o.name ELSE o.name END
  FROM outward o JOIN blocks b ON b.repo_id = o.repo_id AND b.path = o.path AND b.place = o.outer_block
  JOIN held h ON h.repo_id = o.repo_id AND h.path = o.path AND h.place = o.outer_block),
fields AS (
  SELECT t.repo_id, t.path, CASE WHEN b.kind = 'oneof' THEN u.holder ELSE h.holder END AS place, count(*) AS n
  FROM levelled t JOIN held h USING (repo_id, path, place)
  JOIN blocks b ON b.repo_id = t.repo_id AND b.path = t.path AND b.place = h.holder
  JOIN held u ON u.repo_id = t.repo_id AND u.path = t.path AND u.place = h.holder
  WHERE NOT t.opens AND regexp_matches(t.token, '^=|:$') GROUP BY ALL),
messages AS (
  SELECT o.repo_id, o.path, b.schema, b.package, o.name AS message, coalesce(f.n, 0) AS n_fields
  FROM outward o JOIN blocks b USING (repo_id, path, place) LEFT JOIN fields f USING (repo_id, path, place) WHERE o.outer_block IS NULL)"""


def _symbols(c: schemas.Convention) -> str:
    form = {
        "last": "regexp_extract(m.message, '(\\w+)$', 1)", "underscore": "replace(m.message, '.', '_')",
        "package": "concat_ws('.', nullif(m.package, ''), m.message)",
    }[c.form]
    stem = "''" if "()" in c.file else "regexp_extract(m.path, '([^/]+)\\.\\w+$', 1)"
    return f"""SELECT m.repo_id, m.message, m.n_fields, m.path AS schema_file, {_q(c.name)} AS convention, g.path AS generated_file
      FROM (SELECT *, {stem} AS stem, {form} AS symbol FROM messages m WHERE schema = {_q(c.schema)}
        QUALIFY count(*) OVER (PARTITION BY repo_id, {stem}, {form}) = 1) m JOIN (
        SELECT DISTINCT repo_id, path, regexp_extract(path, {_q(c.file)}, 1) AS stem, unnest(regexp_extract_all(content, {_q(c.symbol)}, 1)) AS symbol
        FROM schema_files WHERE contains(content, {_q(schemas.GENERATED)}) AND regexp_matches(path, {_q(c.file)})) g
      ON g.repo_id = m.repo_id AND g.stem = m.stem AND g.symbol = m.symbol"""


def _sql() -> dict[str, str]:
    o: dict[str, str] = {}
    # sources
    o["scan_by_language"] = _code() + "SELECT repo_id, path, language FROM src"
    o["files_analyzed"] = _code() + "SELECT repo_id, language, count(*) AS files FROM src GROUP BY ALL"
    o["discover_languages"] = _cross() + "SELECT repo_id, language, count(*) AS files FROM poly GROUP BY ALL"
    o["resource_scan"] = _with(_FILES) + f"""SELECT * FROM (SELECT repo_id, path, {_base('path')} AS basename,
      CASE WHEN {_suffix('path', rules.CONFIG_SUFFIXES)} THEN 'configuration'
           WHEN {_suffix('path', rules.DATA_SUFFIXES)} THEN 'data' END AS resource_type FROM files) t WHERE resource_type IS NOT NULL"""
    o["npm_packages"] = _with(_FILES, _NPM_DOC) + _NPM
    o["nuget_packages"] = _with(_FILES) + _NUGET
    o["maven_packages"] = _with(_FILES) + _MAVEN
    o["gradle_packages"] = _with(_FILES) + _GRADLE
    o["go_modules"] = _with(_FILES) + _GOMOD
    o["build_log_errors"] = _with(_ERRORS) + "SELECT * FROM errors"
    # statistics
    o["loc_by_language"] = _code() + f"SELECT repo_id, path, language, CAST({_LOC} AS BIGINT) AS loc FROM src"
    o["js_declarations"] = _declared("javascript", "function", "class")
    o["js_imports"] = _declared("javascript", "import")
    o["js_exports"] = _declared("javascript", "export")
    o["csharp_declarations"] = _declared("csharp", *rules.CSHARP_DECLARATIONS)
    o["csharp_usings"] = _declared("csharp", "using")
    o["java_declarations"] = _declared("java", *rules.JAVA_DECLARATIONS)
    o["java_imports"] = _declared("java", "import")
    o["go_declarations"] = _declared("go", *rules.GO_DECLARATIONS)
    o["go_imports"] = _declared("go", "import")
    for name, short in (("javascript", "js"), ("csharp", "csharp"), ("java", "java"), ("go", "go")):
        o[f"{short}_file_stats"] = _file_stats(name)
    o["py_file_stats"] = _code(_PY) + f"""SELECT repo_id, path, language, CAST({_loc('python')} AS BIGINT) AS loc,
      len(regexp_extract_all(content, '(?m)^ *class '))::BIGINT AS class_count,
      len(regexp_extract_all(content, '(?m)^ *def '))::BIGINT AS function_count,
      len(regexp_extract_all(content, '(?m)^(import|from) '))::BIGINT AS import_count FROM py WHERE NOT broken"""
    o["py_declarations"] = _code(_PY) + """SELECT repo_id, path, 'class' AS kind, regexp_extract(text, '^ *class (\\w+)', 1) AS name, ln::BIGINT AS line FROM pyline WHERE regexp_matches(text, '^ *class ')
      UNION ALL SELECT repo_id, path, 'function', regexp_extract(text, '^ *def (\\w+)', 1), ln::BIGINT FROM pyline WHERE regexp_matches(text, '^ *def ')"""
    o["py_syntax_errors"] = _code(_PY) + """SELECT repo_id, path, ln::BIGINT AS line FROM (
      SELECT repo_id, path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS ln,
             unnest(string_split(content, chr(10))) AS text FROM py WHERE broken) l WHERE starts_with(text, 'def broken_')"""
    o["valid_files"] = _code(_PY, _ERRORS) + """SELECT t.repo_id, t.language, t.total_files,
      CASE t.language WHEN 'python' THEN t.total_files - t.broken WHEN 'javascript' THEN t.total_files
           ELSE CASE WHEN e.repo_id IS NULL THEN t.total_files ELSE 0 END END::BIGINT AS valid_files
    FROM (SELECT repo_id, language, count(*) AS total_files,
            sum(CASE WHEN language = 'python' AND contains(content, 'def broken_') THEN 1 ELSE 0 END) AS broken
          FROM src GROUP BY ALL) t
    LEFT JOIN (SELECT DISTINCT repo_id, CASE tool WHEN 'dotnet' THEN 'csharp' WHEN 'go build' THEN 'go' ELSE 'java' END AS language
               FROM errors WHERE tool IN ('dotnet', 'maven', 'gradle', 'go build')) e
      ON e.repo_id = t.repo_id AND e.language = t.language"""
    # dependencies
    o["py_import_edges"] = _code(_PY) + "SELECT * FROM pydep"
    o["module_map"] = _code() + "SELECT repo_id, path, replace(replace(path, '/', '.'), '.py', '') AS module FROM src WHERE language = 'python'"
    o["import_edges"] = _code(_PY, _IMPORTS) + "SELECT * FROM edges"
    o["package_inventory"] = _with(_FILES, _NPM_DOC, _PACKAGES) + "SELECT * FROM packages"
    o["dependency_totals"] = _code(_PY, _IMPORTS, _NPM_DOC, _PACKAGES) + """SELECT coalesce(e.repo_id, p.repo_id) AS repo_id, coalesce(e.language, p.language) AS language,
      coalesce(total_dependencies, 0) AS total_dependencies, coalesce(total_packages, 0) AS total_packages
    FROM (SELECT repo_id, language, count(target) AS total_dependencies FROM edges GROUP BY ALL) e
    FULL JOIN (SELECT repo_id, language, count(*) AS total_packages FROM packages GROUP BY ALL) p
      ON e.repo_id = p.repo_id AND e.language = p.language"""
    o["internal_edges"] = _code(_PY) + """SELECT d.repo_id, d.path AS source_file, 'python' AS source_language, m.path AS target_file,
      'python' AS target_language, 'import' AS dependency_type
    FROM pydep d JOIN (SELECT repo_id, path, replace(replace(path, '/', '.'), '.py', '') AS module FROM src WHERE language = 'python') m
      ON m.repo_id = d.repo_id AND m.module = d.target"""
    o["top_imports"] = _code(_PY, _IMPORTS) + """SELECT * FROM (SELECT language, target, importers,
        row_number() OVER (PARTITION BY language ORDER BY importers DESC, target) AS rank
      FROM (SELECT language, target, count(*) AS importers FROM edges WHERE target IS NOT NULL GROUP BY ALL) c) r WHERE rank <= 10"""
    # complexity
    o["function_spans"] = _code(_functions()) + "SELECT repo_id, path, language, name, fn_type, len(body) AS body_length, md5(body) AS body_md5 FROM fn"
    for name, short in (("javascript", "js"), ("csharp", "csharp"), ("java", "java"), ("go", "go")):
        o[f"{short}_complexity"] = _code(_functions(name)) + f"SELECT {_FN_COLUMNS} FROM fn"
    o["py_complexity"] = _code(_PY, _PY_FUNCTIONS) + "SELECT * FROM pyfn"
    o["file_complexity"] = _complexity("SELECT * FROM filecx")
    o["repo_complexity"] = _complexity("SELECT repo_id, language, count(*) AS files, sum(total_complexity)::BIGINT AS total_complexity FROM filecx GROUP BY ALL")
    o["high_complexity"] = _complexity("SELECT * FROM allfn WHERE complexity > 10")
    o["complexity_buckets"] = _complexity(f"SELECT language, bucket, count(*) AS functions FROM (SELECT language, {_BUCKET} AS bucket FROM allfn) b GROUP BY ROLLUP (language, bucket)")
    o["language_overview"] = _complexity("SELECT language, count(*) AS files, round(avg(total_complexity), 6) AS mean_complexity FROM filecx GROUP BY language")
    # security
    o["security_findings"] = _security("SELECT * FROM findings")
    o["security_by_rule"] = _security("SELECT language, rule_id, issue, severity, count(*) AS findings, count(DISTINCT repo_id) AS repositories FROM findings GROUP BY ALL")
    o["security_totals"] = _security("SELECT repo_id, language, count(*) AS total_issues FROM findings GROUP BY ALL")
    # architecture
    o["package_structure"] = _code() + f"""SELECT repo_id, language, array_to_string({_DIRS}, '/') AS dir, count(*) AS files
      FROM src WHERE language IN ('python', 'javascript') AND contains(path, '/') GROUP BY ALL"""
    o["mvc_by_name"] = _code() + f"""SELECT repo_id, bool_or(contains(b, 'model')) AND bool_or(contains(b, 'view')) AND bool_or(contains(b, 'controller')) AS mvc_pattern
      FROM (SELECT repo_id, lower({_base('path')}) AS b FROM src WHERE language = 'python') n GROUP BY repo_id"""
    o["js_stack"] = _with(_FILES, _NPM_DOC) + f"""SELECT repo_id, {_first_label(rules.JS_FRAMEWORKS, _STACK_KEYS)} AS framework,
      {_first_label(rules.JS_TEST_FRAMEWORKS, _STACK_KEYS)} AS testing_framework, {_first_label(rules.JS_BUILD_TOOLS, _STACK_KEYS)} AS build_tool FROM npm"""
    o["js_module_system"] = _code() + f"""SELECT repo_id, arg_min(label, rn) FILTER (label IS NOT NULL) AS module_system FROM (
      SELECT repo_id, {_module_label()} AS label, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rn
      FROM src WHERE language = 'javascript') f WHERE rn <= 10 GROUP BY repo_id"""
    o["csharp_namespaces"] = _code() + f"SELECT repo_id, namespace, count(*) AS files FROM (SELECT repo_id, unnest({_all('content', rules.CSHARP_NAMESPACE, 1)}) AS namespace FROM src WHERE language = 'csharp') n GROUP BY ALL"
    o["csharp_arch"] = _code() + f"""SELECT repo_id, bool_or({_any('content', rules.CSHARP_MVC_WORDS)}) AS mvc_pattern,
      bool_or(contains(content, 'Repository')) AND bool_or(contains(content, 'interface')) AS repository_pattern,
      bool_or({_any('content', rules.CSHARP_INJECTION_WORDS)}) AS dependency_injection FROM src WHERE language = 'csharp' GROUP BY repo_id"""
    for name, pattern in (("java", rules.JAVA_PACKAGE), ("go", rules.GO_PACKAGE)):
        o[f"{name}_packages"] = _code() + f"SELECT repo_id, package, count(*) AS files FROM (SELECT repo_id, {_all('content', pattern, 1)}[1] AS package FROM src WHERE language = '{name}') p WHERE package IS NOT NULL GROUP BY ALL"
    o["java_arch"] = _java_features()
    o["go_arch"] = _code() + f"""SELECT g.repo_id, coalesce(go_modules, false) AS go_modules, http_server, grpc_service,
      containerized OR coalesce(dockerfile, false) AS containerized, kubernetes_ready OR coalesce(yaml, false) AS kubernetes_ready, main_packages, test_coverage
    FROM (SELECT repo_id, bool_or({_any('content', ('http.ListenAndServe', 'gin.New'))}) AS http_server,
        bool_or(contains(lower(content), 'grpc')) AS grpc_service, bool_or(contains(lower(content), 'docker')) AS containerized,
        bool_or(contains(lower(content), 'kubernetes')) AS kubernetes_ready,
        count(*) FILTER ({_all('content', rules.GO_PACKAGE, 1)}[1] = 'main') AS main_packages,
        bool_or(ends_with(path, '_test.go')) AS test_coverage FROM src WHERE language = 'go' GROUP BY repo_id) g
    LEFT JOIN (SELECT repo_id, bool_or(path = 'go.mod') AS go_modules, bool_or(path = 'Dockerfile') AS dockerfile,
        bool_or(ends_with(path, '.yaml') OR ends_with(path, '.yml')) AS yaml FROM files WHERE NOT contains(path, '/') GROUP BY repo_id) r ON r.repo_id = g.repo_id"""
    # cross-language
    o["api_endpoints"] = _cross(_ENDPOINTS) + "SELECT * FROM endpoints"
    o["shared_resources"] = _cross(_SHARED) + "SELECT * FROM shared"
    o["config_deps"] = _cross(_CONFIGS) + "SELECT * FROM configs"
    o["build_deps"] = _cross(_BUILDS) + f"""SELECT b.repo_id, b.build_system, b.build_file, l.language FROM builds b
      LEFT JOIN (SELECT DISTINCT repo_id, language FROM poly) l ON l.repo_id = b.repo_id AND list_contains({_AFFECTS}, l.language)"""
    o["http_apis"] = _cross(_ROUTES) + "SELECT * FROM routes"
    o["mq_usage"] = _cross(_QUEUES) + "SELECT * FROM queues"
    o["comm_catalogue"] = _cross() + "SELECT * FROM (" + "\nUNION ALL\n".join(
        f"SELECT repo_id, language, {_q(family)} AS family, {_q(p.text)} AS pattern, sum(len({_all('content', p)}))::BIGINT AS matches, count(*) AS files FROM poly WHERE {_hit('content', p)} GROUP BY repo_id, language"
        for family, patterns in rules.COMMUNICATION_CATALOGUE.items() for p in patterns
    ) + ") c"
    o["graph_edges"] = _graph("SELECT * FROM edges")
    o["graph_nodes"] = _graph("SELECT repo_id, node FROM degrees")
    o["graph_metrics"] = _graph("SELECT repo_id, total_nodes, total_edges, round(density, 6) AS density, total_nodes AS strongly_connected_components FROM metrics")
    o["hotspots"] = _graph("""SELECT repo_id, node AS component, 'high_connectivity' AS issue_type, degree,
      CASE WHEN degree > 10 THEN 'high' ELSE 'medium' END AS severity,
      'Component ' || node || ' has ' || degree || ' connections, indicating potential architectural bottleneck' AS description
      FROM degrees WHERE degree > 5""")
    o["arch_insights"] = _report("SELECT * FROM insights")
    o["recommendations"] = _report("SELECT * FROM advice")
    o["polyglot_rows"] = _cross(_ENDPOINTS, _SHARED, _CONFIGS, _LANGS) + """SELECT repo_id, source_file, source_language, CAST(NULL AS VARCHAR) AS target_file,
        CAST(NULL AS VARCHAR) AS target_language, dependency_type, CAST(metadata AS VARCHAR) AS metadata FROM (
      SELECT repo_id, source_file, source_language, 'api_call' AS dependency_type, to_json({'source_file': source_file,
        'source_language': source_language, 'endpoint': endpoint, 'type': 'api_call'}) AS metadata FROM endpoints
      UNION ALL SELECT repo_id, resource_path, language, 'shared_resource', to_json({'resource_path': resource_path,
        'resource_type': 'configuration', 'referring_languages': list_sort(list(language) OVER (PARTITION BY repo_id, resource_path)),
        'cross_language_usage': true}) FROM shared
      UNION ALL SELECT repo_id, source_file, source_language, 'configuration', to_json({'source_file': source_file,
        'source_language': source_language, 'config_type': config_type, 'config_value': config_value,
        'line_context': line_context}) FROM configs) r
      WHERE repo_id IN (SELECT repo_id FROM multi)"""
    several = ", ".join(f"CASE WHEN c.languages > 1 THEN c.{n} END AS {n}" for n in _LISTS)
    o["polyglot_report"] = _report(f"""SELECT c.repo_id, c.languages, c.total_files, {several},
      CASE WHEN c.languages > 1 THEN coalesce(m.total_nodes, 0) END AS total_nodes,
      CASE WHEN c.languages > 1 THEN coalesce(m.total_edges, 0) END AS total_edges,
      CASE WHEN c.languages > 1 THEN coalesce(h.hotspots, 0) END AS hotspots,
      CASE WHEN c.languages > 1 THEN coalesce(h.high_hotspots, 0) END AS high_hotspots,
      CASE WHEN c.languages > 1 THEN coalesce(m.total_nodes, 0) END AS strongly_connected_components,
      CASE WHEN c.languages > 1 THEN round(coalesce(m.density, 0.0), 6) END AS density,
      i.architecture_style, i.coupling_level, i.communication_complexity, i.maintainability_score, a.recommendations
    FROM counts c LEFT JOIN insights i USING (repo_id) LEFT JOIN metrics m USING (repo_id)
    LEFT JOIN (SELECT repo_id, count(*) AS hotspots, count(*) FILTER (degree > 10) AS high_hotspots FROM degrees WHERE degree > 5 GROUP BY repo_id) h USING (repo_id)
    LEFT JOIN (SELECT repo_id, count(*) AS recommendations FROM advice GROUP BY repo_id) a USING (repo_id)""".replace(
        "a.recommendations\n", "coalesce(a.recommendations, 0) AS recommendations\n"))
    o["ffi_marks"] = _cross() + "\nUNION ALL\n".join(
        f"SELECT repo_id, path, language, {_q(rule)} AS rule_id FROM poly WHERE language IN ({', '.join(_q(n) for n in names)}) AND {_hit('content', p)}"
        for rule, names, _, p in rules.FFI_RULES
    )
    route = "regexp_replace(regexp_replace(regexp_replace({0}, '[''\"`]', '', 'g'), '^[^/]*', ''), '[?#].*$|/+$', '', 'g')"
    o["network_bridges"] = _cross(_ENDPOINTS, _ROUTES) + f"""SELECT repo_id, route, count(*) FILTER (defines) AS definitions,
        count(*) FILTER (NOT defines) AS callers, count(DISTINCT source_language) AS languages
      FROM (SELECT repo_id, route, source_file, source_language, bool_or(defines) AS defines FROM (
          SELECT repo_id, source_file, source_language, {route.format('route')} AS route, true AS defines FROM routes
          UNION ALL SELECT repo_id, source_file, source_language, {route.format('endpoint')}, false FROM endpoints) r
        WHERE route <> '' GROUP BY ALL) f
      GROUP BY repo_id, route HAVING count(*) FILTER (defines) > 0 AND count(*) FILTER (NOT defines) > 0"""
    o["bridge_edges"] = _cross(_ENDPOINTS, _ROUTES) + f"""SELECT f.repo_id, CASE WHEN defines THEN 'route:' || route ELSE source_language || ':' || source_file END AS src,
        CASE WHEN defines THEN source_language || ':' || source_file ELSE 'route:' || route END AS dst,
        CASE WHEN defines THEN 'implements' ELSE 'calls' END AS type
      FROM (SELECT *, bool_or(defines) OVER (PARTITION BY repo_id, route) AND bool_or(NOT defines) OVER (PARTITION BY repo_id, route) AS bridged
        FROM (SELECT repo_id, route, source_file, source_language, bool_or(defines) AS defines FROM (
          SELECT repo_id, source_file, source_language, {route.format('route')} AS route, true AS defines FROM routes
          UNION ALL SELECT repo_id, source_file, source_language, {route.format('endpoint')}, false FROM endpoints) r
        WHERE route <> '' GROUP BY ALL) g) f WHERE bridged"""
    inner = o["internal_edges"].split("SELECT d.repo_id", 1)[1]
    inner = f"inner_edges AS MATERIALIZED (SELECT d.repo_id{inner})"
    o["typed_graph"] = _code(_POLY, _PY, inner, _ENDPOINTS, _SHARED, _LANGS, _EDGES) + """SELECT repo_id, 'python:' || source_file AS src, 'python:' || target_file AS dst, 'import' AS type FROM inner_edges
      UNION ALL SELECT repo_id, src, dst, type FROM edges"""
    o["blast_radius"] = "WITH RECURSIVE " + _code(_PY, inner, f"old AS ({fixture.previous_files_sql()})", """walk(repo_id, path, distance) AS (
        SELECT repo_id, path, 0 FROM files WHERE (repo_id, path, sha256(content)) NOT IN (SELECT (repo_id, path, sha256(content)) FROM old)
        UNION
        SELECT e.repo_id, e.source_file, w.distance + 1 FROM walk w JOIN inner_edges e ON e.repo_id = w.repo_id AND e.target_file = w.path
        WHERE w.distance < 50)""")[len("WITH "):] + "SELECT repo_id, path, min(distance)::BIGINT AS distance FROM walk GROUP BY ALL"
    o["module_cycles"] = f"""WITH RECURSIVE modules AS MATERIALIZED ({fixture.cycle_files_sql()}),
      links AS MATERIALIZED (SELECT DISTINCT a.repo_id, a.path AS a, b.path AS b
        FROM (SELECT repo_id, path, unnest(regexp_extract_all(content, 'import pkg.(m[0-9]+)', 1)) AS name FROM modules) a
        JOIN modules b ON b.repo_id = a.repo_id AND b.path = 'pkg/' || a.name || '.py' WHERE a.path <> b.path),
      reach(repo_id, a, b) AS (SELECT repo_id, a, b FROM links
        UNION SELECT r.repo_id, r.a, l.b FROM reach r JOIN links l ON l.repo_id = r.repo_id AND l.a = r.b)
      SELECT x.repo_id, x.a AS path, min(x.b) AS component, count(*) AS members
      FROM reach x JOIN reach y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a GROUP BY x.repo_id, x.a"""
    o["symbol_edges"] = _symbol_edges()
    o["route_matches"] = _route_matches()
    o["schema_messages"] = f"WITH RECURSIVE {_MESSAGES} SELECT * FROM messages"
    o["schema_bindings"] = f"WITH RECURSIVE {_MESSAGES} " + " UNION ALL ".join(map(_symbols, schemas.CONVENTIONS))
    # catalogue and jobs
    o["repos_by_owner"] = _with(_REPOS) + "SELECT user_id, count(*) AS repositories, max(repository_id) AS newest_repository FROM repos GROUP BY user_id"
    o["repos_of_user"] = _with(_REPOS) + "SELECT repository_id, user_id FROM repos WHERE user_id = 7"
    o["recent_analyses"] = _with(_JOBS, f"req AS ({fixture.REQUEST_SQL})") + f"""SELECT j.job_id, j.status, {_stamp('started_at')}, q.repository_id, q.languages
      FROM (SELECT * FROM jobs ORDER BY started_at DESC, job_id DESC LIMIT 20) j LEFT JOIN req q USING (job_id)"""
    o["job_summaries"] = _code(_JOBS, f"req AS ({fixture.REQUEST_SQL})", _aliases(), """known AS (
        SELECT repo_id, row_number() OVER (ORDER BY repo_id) - 1 AS number, count(*) OVER () AS repositories FROM (SELECT DISTINCT repo_id FROM files) f)""") + f"""SELECT j.job_id, {_stamp('started_at')}, {_stamp('completed_at')},
        a.analyser AS language, coalesce(n.files, 0) AS files_analyzed
      FROM jobs j JOIN (SELECT DISTINCT r.job_id, r.repository_id, a.analyser
          FROM (SELECT job_id, repository_id, unnest(string_split(languages, ',')) AS name FROM req) r JOIN alias a USING (name)) a USING (job_id)
      LEFT JOIN known k ON k.number = a.repository_id % k.repositories
      LEFT JOIN (SELECT repo_id, language, count(*) AS files FROM src GROUP BY ALL) n ON n.repo_id = k.repo_id AND n.language = a.analyser"""
    o["owned_jobs"] = _with(_REPOS) + """SELECT r.user_id, r.job_id FROM (
      SELECT l_orderkey * 10 + l_linenumber AS job_id, l_suppkey AS user_id, l_orderkey AS repository_id FROM lineitem) r
      WHERE EXISTS (SELECT 1 FROM repos p WHERE p.repository_id = r.repository_id AND p.user_id = r.user_id)"""
    o["job_latest"] = _with(_JOBS) + f"SELECT job_id, status, progress, error_message, {_stamp('started_at')}, {_stamp('completed_at')} FROM jobs"
    o["dashboard_totals"] = _with(_JOBS) + "SELECT (SELECT count(*) FROM orders) AS repositories, count(*) AS analyses, count(*) FILTER (status = 'running') AS running FROM jobs"
    o["recent_jobs"] = _with(_JOBS) + f"SELECT job_id, status, progress, {_stamp('started_at')} FROM (SELECT * FROM jobs ORDER BY started_at DESC, job_id DESC LIMIT 20) t"
    o["job_durations"] = _with(_JOBS) + "SELECT job_id, CAST(epoch(date_trunc('second', completed_at)) - epoch(date_trunc('second', started_at)) AS BIGINT) AS seconds FROM jobs WHERE completed_at IS NOT NULL"
    o["job_fanout"] = _with(f"req AS ({fixture.REQUEST_SQL})", _aliases()) + """SELECT DISTINCT r.job_id, r.repository_id, 'analysis_queue' AS queue, a.analyser
      FROM (SELECT job_id, repository_id, unnest(string_split(languages, ',')) AS name FROM req) r JOIN alias a USING (name)
      UNION ALL SELECT job_id, repository_id, 'polyglot_analysis_queue', 'polyglot' FROM req WHERE contains(languages, ',')"""
    o["jobs_per_window"] = _with(_JOBS) + f"SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, status, count(*) AS events FROM ev GROUP BY ALL"
    o["changed_files"] = _with(_FILES, f"old AS ({fixture.previous_files_sql()})") + """SELECT repo_id, path, sha256(content) AS content_hash FROM files
      WHERE (repo_id, path, sha256(content)) NOT IN (SELECT (repo_id, path, sha256(content)) FROM old)"""
    o["file_changes"] = _with(_FILES, f"old AS ({fixture.previous_files_sql()})") + """SELECT coalesce(n.repo_id, o.repo_id) AS repo_id, coalesce(n.path, o.path) AS path, sha256(n.content) AS content_hash,
        CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
      FROM files n FULL JOIN old o ON n.repo_id = o.repo_id AND n.path = o.path
      WHERE n.path IS NULL OR o.path IS NULL OR sha256(n.content) <> sha256(o.content)"""
    # retrieval
    shown = "SELECT query_id, id, round(distance, 6) AS distance, rank FROM hits"
    o["vector_topk"] = _with(_topk(rules.PUBLIC_HITS)) + shown
    o["vector_topk_filtered"] = _with(_topk(rules.CODE_HITS, "c.label = q.label")) + shown
    o["vector_ann_recall"] = f"""SELECT count(*) AS queries, CAST(count(*) * least({rules.PUBLIC_HITS}, (SELECT count(*) FROM embeddings)) AS BIGINT) AS hits,
      true AS recalled FROM embeddings WHERE vec_id % 100 = 0"""
    o["rag_context"] = _with(
        _topk(rules.PUBLIC_HITS, name="public"), _topk(rules.CODE_HITS, "c.label = q.label", name="code"),
    ) + f"""SELECT b.item_id AS query_id, {_q(rules.PROMPT_HEAD)} || coalesce(context, '') || {_q(rules.PROMPT_QUESTION)} || b.text || {_q(rules.PROMPT_TAIL)} AS prompt
    FROM benchmark b LEFT JOIN (
      SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY coll, rank) AS context FROM (
        SELECT p.query_id, 0 AS coll, p.rank, d.text FROM public p JOIN documents d ON d.doc_id = p.id
        UNION ALL SELECT c.query_id, 1, c.rank, 'Result ' || c.id || ' of repository ' || e.label FROM code c JOIN embeddings e ON e.vec_id = c.id) t
      GROUP BY query_id) x ON x.query_id = b.item_id"""
    o["rag_documents"] = _code() + f"""SELECT repo_id, path, chr(10) || 'File: ' || path || chr(10) || 'Language: ' || language || chr(10) || 'Analysis Results: loc=' || {_LOC} || chr(10) AS text,
      CAST(repo_id AS VARCHAR) AS meta_repository, language AS meta_language, 'code_analysis' AS meta_type FROM src"""
    o["rag_doc_ids"] = "SELECT doc_id, 'public_docs_' || (row_number() OVER (ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), CAST(doc_id AS VARCHAR)) - 1) AS id FROM documents"
    o["job_lookup"] = f"SELECT job_id, status, progress, started_at, completed_at FROM ({o['job_latest']}) j WHERE job_id = 7"
    # The counts of a file as a JSON object, without the columns that name it.
    o["stored_results"] = " UNION ALL ".join(
        f"""SELECT path AS file_path, CAST(to_json(counts) AS VARCHAR) AS results, CAST(7 AS BIGINT) AS job_id,
          'syntax_analysis' AS analysis_type, language
        FROM (SELECT path, language, {{{_fields(name)}}} AS counts FROM ({_file_stats(name)}) s) t"""
        for name in ("go", "java")
    )
    o["dependency_map"] = f"""SELECT CAST(to_json({{'repo_id': repo_id, 'src': src, 'dst': dst, 'type': type}}) AS VARCHAR) AS value
      FROM ({o["graph_edges"]}) e"""
    o["impact"] = f"""WITH RECURSIVE imports AS MATERIALIZED ({o["internal_edges"]}),
      bridge AS MATERIALIZED ({o["bridge_edges"]}), shared AS MATERIALIZED ({o["shared_resources"]}),
      seeds AS MATERIALIZED ({o["changed_files"]}),
      links AS MATERIALIZED (SELECT repo_id, 'file:' || source_file AS a, 'file:' || target_file AS b FROM imports
        UNION SELECT repo_id, CASE WHEN type = 'calls' THEN regexp_replace(src, '^[^:]*:', 'file:') ELSE src END,
          CASE WHEN type = 'calls' THEN dst ELSE regexp_replace(dst, '^[^:]*:', 'file:') END FROM bridge
        UNION SELECT repo_id, 'component:' || language, 'file:' || resource_path FROM shared WHERE language IS NOT NULL),
      walk(repo_id, seed, node) AS (SELECT repo_id, path, 'file:' || path FROM seeds
        UNION SELECT w.repo_id, w.seed, l.a FROM walk w JOIN links l ON l.repo_id = w.repo_id AND l.b = w.node)
      SELECT repo_id, seed AS path, count(*) FILTER (starts_with(node, 'file:')) - 1 AS files,
        count(*) FILTER (starts_with(node, 'route:')) AS routes, count(*) FILTER (starts_with(node, 'component:')) AS components
      FROM walk GROUP BY repo_id, seed"""
    return o


def oracle_sql() -> dict[str, str]:
    return _sql()
