"""Rule tables: plain data, no Spark.

Every pattern below is a *fixed value*: results depend on its exact text, so it
is written out in full and in natural order.  ``{`` is escaped because Java
insists on it.

A few patterns start with optional, overlapping pieces (``(?:public)?\\s*...``)
that make a backtracking engine do polynomial work on long runs of blanks or on
minified lines.  For those ``Pattern.scan`` holds an equivalent possessive form
which finds the same names and the same match ends in linear time; Spark runs
``scan``, the SQL oracles run ``text``, and ``tests/test_rules.py`` checks that
the two agree on random input.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """``text`` is the fixed value; ``linear`` an equivalent, faster form."""

    text: str
    linear: str | None = None
    ignore_case: bool = False
    # Lower-case words of which every match holds at least one.  Looking for a
    # word is far cheaper than running an expression, and most texts hold none.
    needles: tuple[str, ...] = ()

    @property
    def scan(self) -> str:
        return self.linear or self.text


@dataclass(frozen=True)
class Rule:
    """A security rule: one finding per (line, rule) whose pattern matches."""

    rule_id: str
    pattern: Pattern
    issue: str


# --------------------------------------------------------------------------
# Languages and scans
# --------------------------------------------------------------------------

# Analysed language -> (file suffixes, directory names that are skipped).
LANGUAGE_SCANS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "python": ((".py",), (".git", "__pycache__", ".pytest_cache", "venv", "env")),
    "javascript": (
        (".js", ".jsx", ".ts", ".tsx", ".mjs"),
        (".git", "node_modules", "dist", "build", ".next"),
    ),
    "csharp": ((".cs",), (".git", "bin", "obj", "packages", ".vs")),
    "java": ((".java",), (".git", "target", "build", ".gradle", "bin")),
    "go": ((".go",), (".git", "vendor", "node_modules")),
}

# Cross-language discovery: the first language whose suffix list fits wins, so
# ``.h`` is always cpp.
DISCOVERY_SUFFIXES: dict[str, tuple[str, ...]] = {
    "python": (".py",),
    "javascript": (".js", ".jsx", ".ts", ".tsx", ".mjs"),
    "csharp": (".cs",),
    "java": (".java",),
    "go": (".go",),
    "rust": (".rs",),
    "php": (".php",),
    "ruby": (".rb",),
    "cpp": (".cpp", ".cxx", ".cc", ".h", ".hpp"),
    "c": (".c", ".h"),
}
DISCOVERY_SKIP = (
    ".git", "node_modules", "bin", "obj", "__pycache__", "target", "build", "dist",
)

CONFIG_SUFFIXES = (".json", ".yaml", ".yml", ".toml", ".ini", ".env", ".config")
DATA_SUFFIXES = (".csv", ".xml", ".sql", ".db", ".sqlite")

BUILD_FILES: dict[str, tuple[str, ...]] = {
    "docker": ("Dockerfile", "docker-compose.yml", "docker-compose.yaml"),
    "make": ("Makefile", "makefile"),
    "gradle": ("build.gradle", "settings.gradle"),
    "maven": ("pom.xml",),
    "npm": ("package.json",),
    "pip": ("requirements.txt", "setup.py", "pyproject.toml"),
    "go": ("go.mod", "go.sum"),
    "cargo": ("Cargo.toml",),
    "cmake": ("CMakeLists.txt",),
}
# None: the build system touches every language present in the repository.
BUILD_LANGUAGES: dict[str, tuple[str, ...] | None] = {
    "docker": None,
    "npm": ("javascript",),
    "pip": ("python",),
    "go": ("go",),
    "cargo": ("rust",),
    "gradle": ("java",),
    "maven": ("java",),
    "make": None,
    "cmake": ("cpp", "c"),
}

# --------------------------------------------------------------------------
# Declarations and imports
# --------------------------------------------------------------------------

LINE_COMMENT = {
    "python": "#", "javascript": "//", "csharp": "//", "java": "//", "go": "//",
}

# Names that are made distinct per file.
JS_FUNCTIONS = (
    Pattern(r"function\s+(\w+)\s*\(", r"function\s++(\w++)\s*+\("),
    Pattern(r"(\w+)\s*:\s*function\s*\(", r"(?<!\w)(\w++)\s*+:\s*+function\s*+\("),
    Pattern(r"(\w+)\s*=\s*function\s*\(", r"(?<!\w)(\w++)\s*+=\s*+function\s*+\("),
    Pattern(
        r"(\w+)\s*=\s*\([^)]*\)\s*=>",
        r"(?<!\w)(\w++)\s*+=\s*+\([^)]*+\)\s*+=>",
    ),
)
JS_CLASS = Pattern(r"class\s+(\w+)")
JS_IMPORTS = (
    Pattern(r"import\s+.*?from\s+['\"]([^'\"]+)['\"]"),
    Pattern(r"import\s+['\"]([^'\"]+)['\"]"),
    Pattern(r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
)
JS_EXPORTS = (
    Pattern(r"export\s+(?:default\s+)?(?:class|function|const|let|var)\s+(\w+)"),
    Pattern(r"export\s*\{\s*([^}]+)\s*\}"),
    Pattern(r"module\.exports\s*=\s*(\w+)"),
)

# kind -> pattern, names kept with duplicates.
CSHARP_DECLARATIONS = {
    "class": Pattern(
        r"(?:public|private|protected|internal)?\s*(?:abstract|sealed)?\s*class\s+(\w+)",
        r"class\s++(\w++)",
    ),
    "interface": Pattern(
        r"(?:public|private|protected|internal)?\s*interface\s+(\w+)",
        r"interface\s++(\w++)",
    ),
    "method": Pattern(
        r"(?:public|private|protected|internal)?\s*(?:static)?\s*(?:virtual|override|abstract)?\s*\w+\s+(\w+)\s*\([^)]*\)",
        r"(?<!\w)\w++\s++(\w++)\s*+\([^)]*+\)",
    ),
    "property": Pattern(
        r"(?:public|private|protected|internal)?\s*(?:static)?\s*\w+\s+(\w+)\s*\{\s*(?:get|set)",
        r"(?<!\w)\w++\s++(\w++)\s*+\{\s*+(?:get|set)",
    ),
}
CSHARP_USING = Pattern(r"using\s+([\w.]+);")

JAVA_DECLARATIONS = {
    "class": Pattern(
        r"(?:public|private|protected)?\s*(?:abstract|final)?\s*class\s+(\w+)",
        r"class\s++(\w++)",
    ),
    "interface": Pattern(
        r"(?:public|private|protected)?\s*interface\s+(\w+)",
        r"interface\s++(\w++)",
    ),
    "method": Pattern(
        r"(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*\w+\s+(\w+)\s*\([^)]*\)\s*(?:throws[^{]*)?\{",
        r"(?<!\w)\w++\s++(\w++)\s*+\([^)]*+\)\s*+(?:throws[^{]*+)?+\{",
    ),
    "field": Pattern(
        r"(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*\w+\s+(\w+)\s*[=;]",
        r"(?<!\w)\w++\s++(\w++)\s*+[=;]",
    ),
}
JAVA_IMPORT = Pattern(r"import\s+(?:static\s+)?([\w.]+(?:\.\*)?);")

GO_DECLARATIONS = {
    "function": Pattern(
        r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(",
        r"func\s++(?:\([^)]*+\)\s++)?+(\w++)\s*+\(",
    ),
    "struct": Pattern(r"type\s+(\w+)\s+struct"),
    "interface": Pattern(r"type\s+(\w+)\s+interface"),
}
GO_IMPORT = Pattern(r"import\s+(?:\(\s*([^)]+)\s*\)|\"([^\"]+)\")")
# Quoted names of an import block, taken line by line.
GO_QUOTED = Pattern(r"\"([^\"\n]+)\"")

# --------------------------------------------------------------------------
# Package manifests and build logs
# --------------------------------------------------------------------------

NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")
NUGET_REFERENCE = Pattern(r"<PackageReference\s+Include=\"([^\"]+)\"")
GRADLE_PATTERNS = (
    Pattern(r"implementation\s+['\"]([^'\"]+)['\"]"),
    Pattern(r"compile\s+['\"]([^'\"]+)['\"]"),
    Pattern(r"testImplementation\s+['\"]([^'\"]+)['\"]"),
    Pattern(r"api\s+['\"]([^'\"]+)['\"]"),
)
GO_REQUIRE = Pattern(r"require\s+([^\s]+)\s+([^\s]+)")

# --------------------------------------------------------------------------
# Function headers and decision points
# --------------------------------------------------------------------------

# language -> ((header, function type), ...); group 1 is the name and the last
# character of a match is the opening brace.
FUNCTION_HEADERS: dict[str, tuple[tuple[Pattern, str], ...]] = {
    "javascript": (
        (Pattern(r"function\s+(\w+)\s*\([^)]*\)\s*\{",
                 r"function\s++(\w++)\s*+\([^)]*+\)\s*+\{"), "function"),
        (Pattern(r"(\w+)\s*:\s*function\s*\([^)]*\)\s*\{",
                 r"(?<!\w)(\w++)\s*+:\s*+function\s*+\([^)]*+\)\s*+\{"), "method"),
        (Pattern(r"(\w+)\s*=\s*function\s*\([^)]*\)\s*\{",
                 r"(?<!\w)(\w++)\s*+=\s*+function\s*+\([^)]*+\)\s*+\{"), "assignment"),
        (Pattern(r"(\w+)\s*=\s*\([^)]*\)\s*=>\s*\{",
                 r"(?<!\w)(\w++)\s*+=\s*+\([^)]*+\)\s*+=>\s*+\{"), "arrow"),
    ),
    "csharp": (
        (Pattern(
            r"(?:public|private|protected|internal)?\s*(?:static)?\s*(?:virtual|override|abstract)?\s*\w+\s+(\w+)\s*\([^)]*\)\s*\{",
            r"(?<!\w)\w++\s++(\w++)\s*+\([^)]*+\)\s*+\{"), "method"),
    ),
    "java": ((JAVA_DECLARATIONS["method"], "method"),),
    "go": (
        (Pattern(r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\([^)]*\)\s*(?:[^{]*)?\{",
                 r"func\s++(?:\([^)]*+\)\s++)?+(\w++)\s*+\([^)]*+\)[^{]*+\{"), "function"),
    ),
}

_BRANCH_WORDS = (
    Pattern(r"\bif\s*\("),
    Pattern(r"\bwhile\s*\("),
    Pattern(r"\bfor\s*\("),
)
_SWITCH_CATCH = (Pattern(r"\bswitch\s*\("), Pattern(r"\bcatch\s*\("))
_AND_OR = (Pattern(r"&&"), Pattern(r"\|\|"))
_TERNARY = Pattern(r"\?\s*.*?\s*:", r"\?\s*+[^:\n]*+\s*+:")

DECISIONS: dict[str, tuple[Pattern, ...]] = {
    "javascript": (*_BRANCH_WORDS, *_SWITCH_CATCH, _TERNARY, *_AND_OR),
    "java": (*_BRANCH_WORDS, *_SWITCH_CATCH, _TERNARY, *_AND_OR),
    "csharp": (
        *_BRANCH_WORDS, Pattern(r"\bforeach\s*\("), *_SWITCH_CATCH,
        Pattern(r"\?\s*"), *_AND_OR,
    ),
    "go": (
        Pattern(r"\bif\s+"),
        Pattern(r"\bfor\s+"),
        Pattern(r"\bswitch\s+"),
        Pattern(r"\bselect\s+"),
        Pattern(r"\bcase\s+"),
        *_AND_OR,
    ),
}
HIGH_COMPLEXITY = 10
# (label, lowest complexity in the bucket), highest first.
COMPLEXITY_BUCKETS = (("High (11+)", 11), ("Medium (6-10)", 6), ("Low (1-5)", 1))

# --------------------------------------------------------------------------
# Security rules
# --------------------------------------------------------------------------

SEVERITY = "medium"


def _ci(text: str, linear: str | None = None, *, needles: tuple[str, ...] = ()) -> Pattern:
    return Pattern(text, linear, ignore_case=True, needles=needles)


def _cs(text: str, *needles: str) -> Pattern:
    return Pattern(text, needles=needles)


SECURITY_RULES: dict[str, tuple[Rule, ...]] = {
    "javascript": (
        Rule("js_eval", _ci(r"eval\s*\("), "Use of eval() - code injection risk"),
        Rule("js_inner_html", _ci(r"innerHTML\s*="), "innerHTML assignment - potential XSS"),
        Rule("js_document_write", _ci(r"document\.write\s*\("), "document.write() - potential XSS"),
        Rule("js_dangerous_html", _ci(r"dangerouslySetInnerHTML"), "dangerouslySetInnerHTML - XSS risk"),
        Rule("js_exec", _ci(r"exec\s*\("), "exec() usage - command injection risk"),
        Rule("js_timeout_string", _ci(r"setTimeout\s*\(\s*['\"]"), "setTimeout with string - code injection"),
        Rule("js_interval_string", _ci(r"setInterval\s*\(\s*['\"]"), "setInterval with string - code injection"),
        Rule("js_md5", _ci(r"crypto\.createHash\s*\(\s*['\"]md5['\"]"), "MD5 hash usage - weak cryptography"),
        Rule("js_random", _ci(r"Math\.random\s*\(\s*\)"), "Math.random() - not cryptographically secure"),
    ),
    "csharp": (
        Rule("cs_process", _ci(r"System\.Diagnostics\.Process\.Start"), "Process execution - potential command injection"),
        Rule("cs_file_delete", _ci(r"System\.IO\.File\.Delete"), "File deletion - ensure proper validation"),
        Rule("cs_assembly_load", _ci(r"System\.Reflection\.Assembly\.Load"), "Dynamic assembly loading - security risk"),
        Rule("cs_eval", _ci(r"eval\s*\("), "Dynamic code evaluation - avoid if possible"),
        Rule("cs_inner_html", _ci(r"innerHTML\s*="), "innerHTML assignment - potential XSS"),
        Rule("cs_password",
             _ci(r"password.*=.*\".*\"", r"password[^=\n]*+=[^\"\n]*+\"[^\"\n]*+\""),
             "Hardcoded password detected"),
        Rule("cs_connection",
             _ci(r"connectionString.*=.*\".*\"", r"connectionString[^=\n]*+=[^\"\n]*+\"[^\"\n]*+\""),
             "Hardcoded connection string"),
    ),
    "java": (
        Rule("java_runtime_exec", Pattern(r"Runtime\.getRuntime\(\)\.exec"), "Runtime.exec() - command injection risk"),
        Rule("java_process", Pattern(r"ProcessBuilder"), "ProcessBuilder - command execution risk"),
        Rule("java_for_name", Pattern(r"Class\.forName"), "Class.forName() - code injection risk"),
        Rule("java_property",
             Pattern(r"System\.getProperty\s*\(\s*\"(?:user\.home|java\.io\.tmpdir)\""),
             "System property access - path traversal risk"),
        Rule("java_file_in", Pattern(r"new\s+FileInputStream\s*\(\s*[^)]*\)"), "FileInputStream - ensure input validation"),
        Rule("java_file_out", Pattern(r"new\s+FileOutputStream\s*\(\s*[^)]*\)"), "FileOutputStream - ensure path validation"),
        Rule("java_md5", Pattern(r"MessageDigest\.getInstance\s*\(\s*\"MD5\""), "MD5 usage - weak cryptography"),
        Rule("java_sha1", Pattern(r"MessageDigest\.getInstance\s*\(\s*\"SHA1\""), "SHA1 usage - weak cryptography"),
        Rule("java_random", Pattern(r"new\s+Random\s*\(\s*\)"), "java.util.Random - not cryptographically secure"),
        Rule("java_hostname", Pattern(r"setHostnameVerifier.*ALLOW_ALL"), "Hostname verification disabled"),
    ),
    "go": (
        Rule("go_command", Pattern(r"exec\.Command\s*\("), "Command execution - potential injection risk"),
        Rule("go_env_secret",
             Pattern(r"os\.Getenv\s*\(\s*\"(?:PASSWORD|SECRET|KEY|TOKEN)\""),
             "Environment variable access - potential secret exposure"),
        Rule("go_printf", Pattern(r"fmt\.Printf?\s*\([^,)]*%[sv]"), "Format string - ensure input validation"),
        Rule("go_unsafe", Pattern(r"unsafe\.Pointer"), "Unsafe pointer usage - memory safety risk"),
        Rule("go_weak_hash", Pattern(r"crypto/md5|crypto/sha1"), "Weak cryptographic hash usage"),
        Rule("go_rand", Pattern(r"math/rand\."), "Non-cryptographic random - use crypto/rand for security"),
        Rule("go_transport", Pattern(r"http\.DefaultTransport"), "Default HTTP transport - consider custom with timeouts"),
        Rule("go_tls", Pattern(r"TLSClientConfig.*InsecureSkipVerify.*true"), "TLS verification disabled"),
    ),
}

# A lower-case word that every match of the rule holds.
SECURITY_NEEDLES = {
    "js_eval": "eval",
    "js_inner_html": "innerhtml",
    "js_document_write": "document.write",
    "js_dangerous_html": "dangerouslysetinnerhtml",
    "js_exec": "exec",
    "js_timeout_string": "settimeout",
    "js_interval_string": "setinterval",
    "js_md5": "crypto.createhash",
    "js_random": "math.random",
    "cs_process": "system.diagnostics.process.start",
    "cs_file_delete": "system.io.file.delete",
    "cs_assembly_load": "system.reflection.assembly.load",
    "cs_eval": "eval",
    "cs_inner_html": "innerhtml",
    "cs_password": "password",
    "cs_connection": "connectionstring",
    "java_runtime_exec": "runtime.getruntime",
    "java_process": "processbuilder",
    "java_for_name": "class.forname",
    "java_property": "system.getproperty",
    "java_file_in": "fileinputstream",
    "java_file_out": "fileoutputstream",
    "java_md5": "messagedigest",
    "java_sha1": "messagedigest",
    "java_random": "random",
    "java_hostname": "sethostnameverifier",
    "go_command": "exec.command",
    "go_env_secret": "os.getenv",
    "go_printf": "fmt.print",
    "go_unsafe": "unsafe.pointer",
    "go_weak_hash": "crypto/",
    "go_rand": "math/rand.",
    "go_transport": "http.defaulttransport",
    "go_tls": "tlsclientconfig",
}

# Calls by bare name that count as a finding in Python sources.
PYTHON_DANGEROUS_CALLS = (
    "eval", "exec", "compile", "__import__", "input", "raw_input", "open",
)
PYTHON_CALL_ISSUE = "Use of potentially dangerous function: "

# --------------------------------------------------------------------------
# Architecture markers
# --------------------------------------------------------------------------

MVC_NAME_PARTS = ("model", "view", "controller")
# (label, package names of which any is enough); the first row that fits wins.
JS_FRAMEWORKS = (
    ("React", ("react",)),
    ("Vue.js", ("vue",)),
    ("Angular", ("angular", "@angular/core")),
    ("Svelte", ("svelte",)),
    ("Express.js", ("express",)),
)
JS_TEST_FRAMEWORKS = (("Jest", ("jest",)), ("Mocha", ("mocha",)), ("Cypress", ("cypress",)))
JS_BUILD_TOOLS = (("Webpack", ("webpack",)), ("Vite", ("vite",)), ("Rollup", ("rollup",)))
JS_STACK_SECTIONS = ("dependencies", "devDependencies")
JS_MODULE_SYSTEMS = (
    ("ES6 Modules", ("import ", "export ")),
    ("CommonJS", ("require(", "module.exports")),
)
JS_MODULE_SAMPLE = 10

CSHARP_NAMESPACE = Pattern(r"namespace\s+([\w.]+)")
CSHARP_MVC_WORDS = ("Controller", "Model", "View")
CSHARP_REPOSITORY_WORDS = ("Repository", "interface")
CSHARP_INJECTION_WORDS = ("IServiceCollection", "AddScoped", "AddTransient")

JAVA_PACKAGE = Pattern(r"package\s+([\w.]+);")
JAVA_FRAMEWORKS = (
    ("Spring Framework", ("org.springframework",)),
    ("Java Servlets", ("javax.servlet", "jakarta.servlet")),
    ("Hibernate", ("org.hibernate",)),
    ("Jackson", ("com.fasterxml.jackson",)),
    ("JUnit", ("org.junit",)),
)
JAVA_DESIGN_PATTERNS = (
    ("Factory Pattern", Pattern(r"class\s+\w*Factory")),
    ("Builder Pattern", Pattern(r"class\s+\w*Builder")),
    ("Singleton Pattern", Pattern(r"class\s+\w*Singleton")),
    ("Observer Pattern", Pattern(r"class\s+\w*Observer")),
)
SPRING_ANNOTATIONS = (
    "Controller", "Service", "Repository", "Component",
    "RestController", "Autowired", "RequestMapping",
)

GO_PACKAGE = Pattern(r"package\s+(\w+)")

# --------------------------------------------------------------------------
# Cross-language analysis
# --------------------------------------------------------------------------

ENDPOINT_PATTERNS = (
    _ci(r"['\"`]/api/[^'\"`\s]+['\"`]", needles=("/api/",)),
    _ci(r"['\"`]/v\d+/[^'\"`\s]+['\"`]", needles=("'/v", '"/v', "`/v")),
    _ci(r"localhost:\d+[^'\"`\s]*", needles=("localhost:",)),
    _ci(r"127\.0\.0\.1:\d+[^'\"`\s]*", needles=("127.0.0.1:",)),
)
CONFIG_PATTERNS = (
    ("port_config", _ci(r"PORT\s*=\s*(\d+)", needles=("port",))),
    ("database_config", _ci(r"DATABASE_URL\s*=\s*['\"`]([^'\"`]+)['\"`]", needles=("database_url",))),
    ("api_key_config", _ci(r"API_KEY\s*=\s*['\"`]([^'\"`]+)['\"`]", needles=("api_key",))),
    ("redis_config", _ci(r"REDIS_URL\s*=\s*['\"`]([^'\"`]+)['\"`]", needles=("redis_url",))),
)
# (pattern, group of the method, group of the path); group 0 is the whole match.
HTTP_PATTERNS = (
    (_ci(r"(?:GET|POST|PUT|DELETE|PATCH)\s+['\"`]/[^'\"`\s]+['\"`]", needles=("'/", '"/', "`/")), None, 0),
    (_ci(r"@app\.route\s*\(\s*['\"`]([^'\"`]+)['\"`]", needles=("@app.route",)), None, 1),
    (_ci(r"app\.(get|post|put|delete)\s*\(\s*['\"`]([^'\"`]+)['\"`]", needles=("app.",)), 1, 2),
    (_ci(r"\[Route\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*\)\]", needles=("[route",)), None, 1),
)
QUEUE_PATTERNS = (
    _ci(r"(?:rabbitmq|kafka|redis|sqs|activemq)", needles=("rabbitmq", "kafka", "redis", "sqs", "activemq")),
    _ci(r"(?:publish|subscribe|queue|topic)", needles=("publish", "subscribe", "queue", "topic")),
)
# Catalogue of communication marks, by family.
COMMUNICATION_CATALOGUE: dict[str, tuple[Pattern, ...]] = {
    "api_calls": (
        _cs(r"fetch\s*\(\s*['\"`]([^'\"`]+)['\"`]", "fetch"),
        _cs(r"requests\.(get|post|put|delete)\s*\(\s*['\"`]([^'\"`]+)['\"`]", "requests."),
        _cs(r"HttpClient\.\w+\s*\(\s*['\"`]([^'\"`]+)['\"`]", "httpclient."),
        _cs(r"curl\s+['\"`]([^'\"`]+)['\"`]", "curl"),
    ),
    "database_connections": (
        _cs(r"(?:postgres|mysql|mongodb|redis)://[^\s'\"`]+", "://"),
        _cs(r"(?:Server|Host|Endpoint)\s*=\s*['\"`]?([^'\"`;\s]+)", "server", "host", "endpoint"),
    ),
    "message_queues": (
        _cs(r"(?:rabbitmq|kafka|redis|sqs)://[^\s'\"`]+", "://"),
        _cs(r"(?:queue|topic|channel)\s*[=:]\s*['\"`]([^'\"`]+)['\"`]", "queue", "topic", "channel"),
    ),
    "file_references": (
        _cs(r"(?:import|require|include)\s+['\"`]([^'\"`]+\.\w+)['\"`]", "import", "require", "include"),
        _cs(r"(?:open|read|write)\s*\(\s*['\"`]([^'\"`]+\.\w+)['\"`]", "open", "read", "write"),
    ),
}

HOTSPOT_DEGREE = 5
HOTSPOT_HIGH_DEGREE = 10
SINGLE_LANGUAGE_MESSAGE = (
    "Repository appears to be single-language. Consider polyglot analysis when "
    "multiple languages are present."
)

# Architecture style, coupling, and score steps.
MICROSERVICES_ABOVE = 3
HYBRID_LANGUAGES = 2
MODERATE_COUPLING_BELOW = 0.1
COMMUNICATION_HIGH_ABOVE = 10
COMMUNICATION_MEDIUM_ABOVE = 5
SCORE_BASE = 70
SCORE_COUPLING = {"tight": -20, "moderate": -10}
SCORE_COMMUNICATION = {"high": -15, "medium": -10}
SCORE_LOOSE_MICROSERVICES = 15
LOW_MAINTAINABILITY = 60

RECOMMENDATIONS = {
    "tight_interfaces": "Consider implementing interface segregation to reduce tight coupling between language components",
    "tight_events": "Evaluate using message queues or event-driven architecture to decouple components",
    "monolith": "Consider migrating to a microservices architecture to better isolate language-specific components",
    "hotspot_prefix": "Refactor ",
    "hotspot_suffix": " to reduce architectural complexity and improve maintainability",
    "chatty_versioning": "Implement API versioning and standardize communication protocols between language components",
    "chatty_gateway": "Consider using API gateways to centralize and manage inter-service communication",
    "low_refactor": "Overall maintainability is low - prioritize architectural refactoring",
    "low_testing": "Implement comprehensive integration testing for cross-language components",
}

# Marks of foreign-function interfaces (own choice, nothing to match here):
# (rule, languages, words of which any must occur, pattern).
FFI_RULES = (
    ("extern_c", ("c", "cpp", "rust"), ("extern",), Pattern(r"extern\s+\"C\"")),
    ("ctypes", ("python",), ("ctypes",), Pattern(r"\bctypes\b")),
    ("cgo", ("go",), ("import",), Pattern(r"import\s+\"C\"")),
    ("jni_native", ("java",), ("System.loadLibrary",), Pattern(r"System\.loadLibrary\s*\(")),
    ("jni_export", ("c", "cpp"), ("JNIEXPORT",), Pattern(r"\bJNIEXPORT\b")),
)

# --------------------------------------------------------------------------
# Jobs and retrieval
# --------------------------------------------------------------------------

ANALYSIS_TYPES = (
    "syntax_analysis", "dependency_analysis", "complexity_analysis",
    "security_analysis", "architecture_analysis",
)
# Accepted spelling in a request -> analyser that handles it.
LANGUAGE_ALIASES = {
    "python": "python",
    "javascript": "javascript", "typescript": "javascript",
    "js": "javascript", "ts": "javascript",
    "csharp": "csharp", "c#": "csharp",
    "java": "java",
    "go": "go",
}
PUBLIC_HITS = 5
CODE_HITS = 3
PROMPT_HEAD = (
    "\nBased on the following context, please answer the user's question about "
    "code analysis and refactoring:\n\nContext:\n"
)
PROMPT_QUESTION = "\n\nUser Question: "
PROMPT_TAIL = (
    "\n\nPlease provide a helpful and accurate response based on the context "
    "provided. If the context doesn't contain enough information to answer the "
    "question, please say so.\n"
)
