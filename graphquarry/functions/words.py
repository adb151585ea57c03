"""Fixed word lists, patterns and catalogues that decide results.  All are values of the data model, in natural order."""

# English stop words.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]

# Words of programming languages that stop-word removal keeps.
CODE_KEYWORDS = [
    "def", "class", "import", "from", "return", "if", "else", "elif", "for", "while", "try", "except", "finally", "with", "as", "async",
    "await", "yield", "lambda", "pass", "break", "continue", "raise", "assert", "global", "nonlocal", "del", "in", "is", "not", "and", "or",
    "true", "false", "none", "self", "super", "init", "main", "function", "var", "let", "const", "new", "this", "null", "undefined",
    "public", "private", "protected", "static", "void", "int", "string", "bool", "float", "double", "char", "interface", "extends",
    "implements",
]

# Topics by keyword, in order of precedence.
TOPICS = {
    "authentication": ["auth", "login", "jwt", "oauth", "token", "password", "session"],
    "database": ["database", "sql", "query", "table", "schema", "migration", "orm"],
    "api": ["api", "endpoint", "route", "request", "response", "rest", "graphql"],
    "ui": ["component", "render", "ui", "interface", "button", "form", "react", "vue"],
    "testing": ["test", "assert", "mock", "spec", "coverage", "pytest", "jest"],
    "deployment": ["deploy", "docker", "kubernetes", "ci", "cd", "pipeline", "build"],
    "config": ["config", "settings", "environment", "env", "yaml", "json"],
    "documentation": ["readme", "doc", "documentation", "guide", "tutorial"],
}

# Patterns that tell a data-flow question, with the groups of its source and sink.
DATAFLOW_PATTERNS = [
    (r"(flow|trace|path)\s+(from|between)\s+(.+?)\s+(to|and)\s+(.+)", 3, 5),
    (r"how\s+(does|do)\s+(.+?)\s+(flow|reach|affect)\s+(.+)", 2, 4),
    (r"(.+?)\s+(flows?|leads?)\s+to\s+(.+)", 1, 3),
    (r"(show|find)\s+data\s*flow\s+from\s+(.+?)\s+to\s+(.+)", 2, 3),
    (r"(.+?)\s+(ile|ve)\s+(.+?)\s+(arasındaki|arasında)\s+(akış|yol)", 1, 3),
    (r"(.+?)\s+(kaynağından|den)\s+(.+?)\s+(hedefine|e)\s+(veri\s+akışı|akış)", 1, 3),
]

# Phrases that make a question one about code.
STRONG_CODE = [
    "vulnerability", "vulnerabilities", "sql injection", "xss", "buffer overflow", "injection", "exploit", "dead code", "unused code",
    "unreachable", "call graph", "recursive", "recursion", "scan for", "find bug", "güvenlik açık", "açık var", "zafiyet", "who calls",
    "callers of", "usage of", "references to", "chain", "calls between", "complexity", "cyclomatic", "ast", "syntax tree", "subclasses",
    "superclasses", "inherits", "extends", "cfg", "pdg", "cdg", "control flow", "dependence", "slice", "slicing", "usage", "variable",
    "identifier", "literal", "hardcoded", "string", "constant", "annotation", "decorator", "import", "dependency", "loop", "if statement",
]
ACTIONS = ["find", "show", "list", "get", "scan", "check", "analyze", "detect"]
CODE_TERMS = ["function", "method", "class", "code", "implementation", "fonksiyon", "metot", "kod"]
SECURITY_TERMS = ["secure", "safe", "güvenli", "security", "güvenlik", "vulnerable"]
CODE_INDICATORS = ["function", "method", "class", "code", "implementation", "fonksiyon", "metot", "sınıf", "kod", "login", "auth"]
EXPLAINING = ["how", "why", "explain", "describe", "nasıl", "neden", "açıkla"]

# Words and patterns that count towards the code confidence.
CODE_WORDS = [
    "function", "method", "class", "code", "implementation", "algorithm", "logic", "file", "module", "vulnerability", "vulnerabilities",
    "security", "secure", "bug", "error", "issue", "flaw", "exploit", "sql injection", "xss", "cross-site", "buffer overflow", "injection",
    "sanitize", "validate", "dead code", "unused", "unreachable", "deprecated", "complexity", "refactor", "optimize", "call graph",
    "dependency", "dependencies", "import", "recursive", "recursion", "loop", "iteration", "fonksiyon", "metot", "sınıf", "kod", "uygulama",
    "güvenlik", "güvenli", "açık", "hata", "sorun", "kullanılmayan", "karmaşıklık", "bağımlılık",
]
CODE_PATTERNS = [
    r"\bfind\s+(sql|xss|buffer|injection|vulnerability)",
    r"\bshow\s+me\s+(function|method|class|code)",
    r"\bis\s+\w+\s+(secure|safe|vulnerable)",
    r"\b(analyze|check|scan)\s+(code|security)",
    r"\w+\s+(açığı|güvenli)\s+mi",
]
CODE_QUESTIONS = [
    r"(is|are)\s+\w+\s+(secure|safe|vulnerable)",
    r"(does|do)\s+\w+\s+(have|contain)\s+(bug|vulnerability)",
    r"(what|which)\s+(function|method|class)",
    r"\w+\s+güvenli\s+mi",
]

# Tools by pattern; the first match wins.
TOOLS = [
    (r"(vulnerability|vulnerabilities|secure|security|injection|xss|exploit|güvenlik|açık)", "security_scan"),
    (r"(dead code|unused|unreachable|kullanılmayan)", "find_dead_code"),
    (r"(call graph|dependency|dependencies|bağımlı)", "analyze_call_graph"),
    (r"(recursion|recursive|recursive calls|cycle|özyineleme)", "analyze_recursion"),
    (r"(usage of|where is|variable|identifier|değişken|nerede)", "find_variable_usages"),
    (r"(slice|slicing|backwards slice|code affecting|dilimle|etkileyen)", "perform_slicing"),
    (r"(literal|hardcoded|string|constant|sabit|metin)", "find_literals"),
    (r"(annotation|decorator|tagged with|annotated|@|dekoratör|etiket)", "find_annotations"),
    (r"(import|dependency|library|uses library|bağımlılık|kütüphane)", "find_imports"),
    (r"(loops in|conditions in|if statements|control structures|döngüler|koşullar)", "analyze_structures"),
    (r"(who calls|callers of|references to|kim çağırıyor|kullanımı)", "analyze_impact"),
    (r"(chain|path from|calls between|zincir|yol)", "analyze_chain"),
    (r"(complexity|cyclomatic|complex|karmaşıklık|zorluk)", "analyze_complexity"),
    (r"(ast|syntax tree|soyut sözdizimi|ağaç)", "get_ast"),
    (r"(subclasses|superclasses|inherits|extends|derived|hierarchy|alt sınıf|türetilmiş|hiyerarşi)", "get_type_hierarchy"),
    (r"(cfg|control flow|akış grafiği)", "get_cfg"),
    (r"(pdg|program dependence|bağımlılık grafiği)", "get_pdg"),
    (r"(cdg|control dependence)", "get_cdg"),
    (r"(ddg|data dependence)", "get_ddg"),
    (r"(show|list|find|get).*(function|method|class|fonksiyon|metot)", "joern_query"),
    (r"(list files|show files|all files|dosyalar)", "list_files"),
    (r"(list packages|show packages|namespaces|paketler)", "list_namespaces"),
    (r"(list types|show types|defined types|tipler)", "list_types"),
    (r"(flow from|data flow|taint analysis|track data|akışı)", "analyze_taint"),
    (r"(parameters of|args of|arguments of|parametreler)", "get_params"),
    (r"(locals of|local variables|variables in|yerel değişkenler)", "get_locals"),
    (r"(comments|todos|fixmes|yorumlar)", "find_comments"),
    (r"(list tags|show tags|etiketler)", "list_tags"),
    (r"(run query|execute query|joern script|custom query|raw query|sorgu çalıştır)", "run_custom_query"),
]
TOOL_TERMS = ["function", "method", "class", "code", "fonksiyon", "metot", "kod"]
FALLBACK_TOOL = "joern_query"

# Beginnings that mark an expansion term as an identifier.
IDENTIFIER_STARTS = ["get_", "set_", "is_", "find_", "calc_", "hesapla", "bul"]

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = [
    "dr", "prof", "mr", "mrs", "ms", "st", "inc", "ltd", "co", "corp", "eg", "ie", "etc", "vs", "jr", "sr",
]

# Words by which sentences are taken apart.
TITLES = ["dr", "prof", "mr", "mrs", "ms"]
OFFICES = ["CEO", "CTO", "CFO"]
LED_BY = ["lead", "leads", "leaded"]
LEADER_TITLES = ["CEO", "President", "CTO"]
LEADING = {"led": "leads", "headed": "heads", "run": "runs"}
FOUNDING = ["founded", "established", "incorporated"]
LAUNCHING = ["released", "launched", "introduced"]
PLACING = ["headquartered", "based", "located", "registered", "incorporated"]
PLACE_PREPOSITIONS = ["in", "at", "on", "near"]
PRODUCT_KINDS = ["flagship", "main", "latest"]
TAIL_PREPOSITIONS = ["to", "for", "with", "in", "at", "on", "from"]
LIST_PREPOSITIONS = ["with", "to", "for", "in", "at", "on", "from", "between", "across", "through"]
NO_CLAUSE_STARTS = [
    "the", "a", "an", "its", "it", "this", "that", "of", "for", "with", "to", "in", "on", "by", "at", "from", "into", "over", "under", "between",
]
PRONOUNS = ["the", "a", "an", "its", "it", "they"]

# File kinds for ranking.
CODE_EXTENSIONS = [".tsx", ".ts", ".js", ".jsx", ".py", ".java", ".go", ".rs", ".rb", ".php", ".cs", ".cpp", ".c", ".h"]
META_NAMES = ["manifest.json", "package.json", "metadata.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"]
CONFIG_EXTENSIONS = [".env", ".env.example", ".env.local", ".env.development"]
CONFIG_NAMES = ["tsconfig.json", "jsconfig.json", "vite.config.ts", "vite.config.js", "next.config.js", ".eslintrc.json", ".prettierrc.json"]

# What the file filter drops.
SKIP_PATTERNS = [
    "__pycache__", ".git", ".pytest_cache", "node_modules", ".venv", "venv", "env", "dist", "build", ".mypy_cache", ".ruff_cache", ".tox",
    "htmlcov", "coverage", ".eggs", "*.egg-info", ".indexing_cache", "graphstore", "test_graphs",
]
SKIP_EXTENSIONS = [".pyc", ".pyo", ".pyd", ".so", ".dylib", ".dll", ".log", ".tmp", ".cache", ".lock", ".swp", ".swo", ".bak", ".orig"]
MAX_FILE_SIZE = 1_000_000

# Files that mark a project's folder.
PROJECT_MARKERS = ["pyproject.toml", "setup.py", "package.json", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Makefile"]

# Languages by extension, and folders that are not code.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".c": "c", ".cpp": "cpp",
    ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp", ".java": "java", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
}
EXCLUDED_FOLDERS = [
    "node_modules", "__pycache__", ".git", ".venv", "venv", "env", "build", "dist", "target", ".pytest_cache", ".tox", "coverage", ".next",
    ".nuxt", "test_graphs",
]
MIN_CODE_FILES, MIN_CODE_LINES = 5, 100

# Documents that a folder's context is lifted from, in order.
LIFTED_NAMES = ["readme.md", "readme.txt", "__init__.py", "package.json", "index.md", "overview.md", "architecture.md"]

# Symbols too common to link.
GENERIC_SYMBOLS = [
    "__init__", "__new__", "__del__", "__repr__", "__str__", "__enter__", "__exit__", "__call__", "__iter__", "__next__", "__getitem__",
    "__setitem__", "__delitem__", "__len__", "__contains__", "__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__", "__hash__",
    "__bool__", "__add__", "__sub__", "__mul__", "__truediv__", "__floordiv__", "__mod__", "__pow__", "__and__", "__or__", "__xor__",
    "__neg__", "__pos__", "__abs__", "__invert__", "__radd__", "__rsub__", "__rmul__", "__rtruediv__", "__iadd__", "__isub__", "__imul__",
    "__itruediv__", "__class__", "__name__", "__module__", "__qualname__", "__dict__", "__slots__", "__weakref__", "__doc__",
    "__init_subclass__", "__set_name__", "__class_getitem__", "__match_args__", "__allow_redefinition__", "run", "_run", "main", "_main",
    "self", "cls", "args", "kwargs", "value", "item", "key", "e", "err", "ex", "exc", "error", "i", "j", "k", "n", "x", "y", "z", "result",
    "output", "data", "info", "msg", "text",
]

# Call targets that say nothing about a program.
SKIPPED_CALLS = [
    "len", "print", "str", "int", "float", "list", "dict", "set", "tuple", "type", "isinstance", "hasattr", "getattr", "setattr", "dir",
    "vars", "range", "enumerate", "zip", "map", "filter", "sorted", "reversed", "any", "all", "min", "max", "sum", "abs", "round", "open",
    "input", "super", "property", "staticmethod", "classmethod", "__import__", "format", "repr", "id", "hash", "callable", "iter", "next",
    "append", "extend", "insert", "remove", "pop", "clear", "items", "keys", "values", "get", "update", "setdefault", "copy", "deepcopy",
    "upper", "lower", "strip", "split", "join", "replace", "startswith", "endswith", "find", "index", "count", "encode", "decode", "json",
    "echo",
]

_WEB = ["request.GET", "request.POST", "request.args", "request.form"]
# Vulnerability kinds in order of precedence, with sources and sinks.
VULNERABILITIES = [
    ("SQL Injection", "CWE-89", "Critical", [*_WEB, "request.COOKIES", "input(", "sys.argv"], ["execute(", "executemany(", ".raw(", ".query(", "cursor.execute", "db.execute"]),
    ("Cross-Site Scripting (XSS)", "CWE-79", "High", [*_WEB, "input("], ["render_template_string(", "mark_safe(", ".innerHTML", "document.write(", "eval(", "Response("]),
    ("Command Injection", "CWE-78", "Critical", [*_WEB, "input(", "sys.argv"], ["os.system(", "subprocess.call(", "subprocess.run(", "subprocess.Popen(", "exec(", "eval(", "shell_exec(", "system("]),
    ("Path Traversal", "CWE-22", "Medium", [*_WEB, "request.FILES"], ["open(", "read(", "write(", "os.path.join(", "Path("]),
    ("XML External Entity (XXE)", "CWE-611", "High", ["request.data", "request.body", "request.FILES"], ["etree.parse(", "ElementTree.parse(", "lxml.parse(", "parseString("]),
    ("Server-Side Request Forgery (SSRF)", "CWE-918", "High", _WEB, ["requests.get(", "requests.post(", "urllib.request(", "http.request(", "fetch("]),
]

# Policies over a code-property graph: name, severity, weakness, label, pattern, pattern on the argument, needs a path from a parameter.
POLICIES = [
    ("NoBufferOverflow", "critical", "CWE-120", "CALL", "^(strcpy|sprintf|gets|strcat)$", "", False),
    ("NoCommandInjection", "critical", "CWE-78", "CALL", "^(system|exec|popen)$", "", True),
    ("NoSQLInjection", "critical", "CWE-89", "CALL", "^(execute|executemany|query|raw)$", "^.*\\{.*\\}.*$", False),
    ("NoHardcodedSecrets", "high", "CWE-798", "LITERAL", "", "^.*(?i)(password|secret|api[_-]?key|token).*=.*$", False),
    ("NoWeakCrypto", "high", "CWE-327", "CALL", "^(MD5|SHA1|DES|RC4)$", "", False),
    ("NoPathTraversal", "high", "CWE-22", "CALL", "^(open|fopen|readFile)$", "", True),
]
