"""Text functions as column expressions: Column -> Column, no Python UDFs.

``\\b`` is written as ASCII look-arounds, for Java's is Unicode-aware; lower-casing follows Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters that separate tokens; hyphen and underscore stay inside them
SEPARATORS = r"""[\s.,;:()\[\]{}|!?"'`~@#$%^&*+=<>/\\]+"""
# fixed values: tools and extensions that become command tags
COMMAND_TOOLS = ("node", "npm", "git", "docker", "curl", "grep", "find", "dotnet", "python", "pip", "powershell")
TAG_EXTENSIONS = ("js", "ts", "py", "cs", "json", "xml", "sh", "ps1", "md")
PROMPT_ACTIONS = ("explore", "search", "investigate", "analyze", "understand", "check", "review", "find", "debug", "trace")
PROMPT_EXTENSIONS = ("js", "ts", "py", "cs", "json", "xml", "md", "yaml")
PATH_EXTENSIONS = "tsx jsx jsonl csproj yaml toml hpp cpp sln bat vue css html json xml js ts py cs sh ps1 md yml rb go rs java c h".split()
SYSTEM_HEADS = ("/", "[system", "system:")
SELF_CALLS = ("save-decision", "save-research", "check-memory", "session-summary")
WORKFLOW_WORDS = ("build", "test", "deploy", "analyze", "download", "fetch", "parse", "log", "timeline", "artifact", "results")


def word(pattern: str) -> str:
    """``pattern`` between ASCII word boundaries."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def default(c: Column, value) -> Column:
    """``c``, or ``value`` where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))


def tokens(text: Column) -> Column:
    """Tokens of a text: camel case is split, then lower case, then cut at separators. Null gives none."""
    split_camel = F.regexp_replace(F.regexp_replace(blank(text), "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(split_camel), SEPARATORS), lambda t: F.length(t) > 0)


def estimate_tokens(text: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(blank(text)) / 4).cast("long")


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(blank(text), F.lit(pattern), F.lit(group))


def command_tags(command: Column) -> Column:
    """Up to five: tools named anywhere in the command, then extensions of files."""
    low = F.lower(blank(command))
    tools = F.filter(F.array(*map(F.lit, COMMAND_TOOLS)), lambda t: F.contains(low, t))
    exts = F.transform(all_matches(command, r"\.\w{1,6}(?![A-Za-z0-9_])"), lambda e: F.lower(F.substr(e, F.lit(2))))
    return F.slice(F.array_distinct(F.concat(tools, F.filter(exts, lambda e: e.isin(*TAG_EXTENSIONS)))), 1, 5)


def file_paths(text: Column) -> Column:
    """Distinct file paths with a known source extension, in order; longer extensions are tried first."""
    found = all_matches(text, rf"(?i)(?:[\w./-]+/)?[\w.-]+\.(?:{'|'.join(PATH_EXTENSIONS)})")
    return F.array_distinct(F.filter(found, lambda p: F.length(p) > 4))


def sanitize_filename(text: Column, max_len: int = 60, fallback: str = "exploration") -> Column:
    s = F.regexp_replace(F.lower(blank(text)), "[^a-z0-9_-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    return default(F.substring(s, 1, max_len), fallback)


def prompt_tags(prompt: Column) -> Column:
    """Up to ten: action words, hyphenated or underscored identifiers, extensions."""
    low = F.lower(blank(prompt))
    actions = F.filter(F.array(*map(F.lit, PROMPT_ACTIONS)), lambda t: F.contains(low, t))
    terms = F.filter(all_matches(prompt, r"(?i)(?<![A-Za-z0-9_])[a-z][a-z0-9]*[-_][a-z0-9]+[-_a-z0-9]*"), lambda t: (F.length(t) > 3) & (F.length(t) < 30))
    exts = F.transform(all_matches(prompt, rf"(?i)\.(?:{'|'.join(PROMPT_EXTENSIONS)})(?![A-Za-z0-9_])"), lambda e: F.substr(e, F.lit(2)))
    return F.slice(F.array_distinct(F.concat(actions, F.transform(F.concat(terms, exts), F.lower))), 1, 10)


def normalize_template(template: Column) -> Column:
    """White space is one space and every parameter the same, for comparison."""
    return F.trim(F.regexp_replace(F.regexp_replace(blank(template), r"\s+", " "), r"\{\{[^}]+\}\}", "{{PARAM}}"))


#: (pattern, replacement), in order
SKELETON = (
    (r"\{\{[^}]+\}\}", "X"),
    (r'"[^"]{30,}"', '"..."'),
    (r"\{[^}]{50,}\}", "{...}"),
    (r'https?://[^\s"]+', "URL"),
    (r"(?i)[0-9a-f]{8,}", "HEX"),
    (r"\d{5,}", "NUM"),
    (r"\s+", " "),
)


def script_skeleton(template: Column) -> Column:
    """Structure of a script without parameters, payloads, addresses and numbers; 200 characters at most."""
    s = blank(template)
    for pattern, to in SKELETON:
        s = F.regexp_replace(s, pattern, to)
    return F.substring(F.trim(s), 1, 200)


def template_only(command: Column) -> Column:
    """The command with ids, quoted paths and long JSON values replaced by unnumbered parameters."""
    s = F.regexp_replace(blank(command), "(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", "{{uuid}}")
    s = F.regexp_replace(s, r"(?i)/(build|log|run|pullrequest|workitem|iteration)s/\d+", "/$1s/{{$1_id}}")
    s = F.regexp_replace(s, r'"(?:[A-Z]:\\[^"]{10,}|/(?:tmp|home|var|usr|opt)/[^"]{10,})"', '"{{file_path}}"')
    return F.regexp_replace(s, r'(?i)"(title|description|name|message|value)":\s*"[^"]{20,}"', '"$1": "{{$1}}"')


def is_trivial(command: Column) -> Column:
    """Too short, or mere looking around."""
    c = F.trim(blank(command))
    looks = c.rlike(r"(?i)^\s*(ls|dir|cat|head|tail|echo|cd|pwd|whoami|date|clear|cls|type|set|env|which|where)(?![A-Za-z0-9_])")
    walks = c.rlike(r"(?i)^\s*(ls|find|dir|tree)\s") & ~c.rlike(r"(?i)\|\s*(node|python|grep)")
    return (F.length(c) < 30) | looks | walks


def is_self_call(command: Column) -> Column:
    c = blank(command)
    out = F.lit(False)
    for s in SELF_CALLS:
        out = out | F.contains(c, F.lit(s))
    return out


def is_system_message(text: Column) -> Column:
    t = F.trim(blank(text))
    low = F.lower(t)
    return t.startswith("/") | low.startswith("[system") | low.startswith("system:") | F.contains(t, F.lit("<system-reminder>"))


# fixed values: what makes a command a reusable script, and what doesn't
SCRIPT_SIGNS = (
    word(r"TOKEN\s*=\s*\$\(").replace("(?![A-Za-z0-9_])", ""), word("Bearer"), word(r"az\s+account"), r"(?i)(?<![A-Za-z0-9_])curl\s.*-X\s*(POST|PUT|PATCH)", r"(?<![A-Za-z0-9_])for\s+\w+\s+in(?![A-Za-z0-9_])",
    word("while"), r"(?<![A-Za-z0-9_])if\s*\[", r'(?<![A-Za-z0-9_])node\s+-e\s*"', r"(?<![A-Za-z0-9_])python[3]?\s+-[ce]\s", r"process\.stdin", r"-d\s*'\{", r"-d\s*'\[", r"\|\s*node(?![A-Za-z0-9_])", r"\|\s*python",
)
ONE_LINER = r'^\s*(?:(?:cat|head|tail|sed|awk|grep|rg|find|ls|wc|diff|sort|uniq|echo|which|type|file|stat|du|test|\[)\s|pwd\s*$|powershell\s+-Command\s+"Get-Content)'


def is_reusable_script(command: Column) -> Column:
    """Ordered rules: length, signs of logic, several statements with a call, then what is a mere one-liner."""
    c = F.trim(blank(command))
    signs = F.lit(False)
    for s in SCRIPT_SIGNS:
        signs = signs | c.rlike(s)
    statements = F.size(F.filter(F.split(c, r"\s*(?:&&|\|\||;)\s*"), lambda s: F.length(F.trim(s)) > 10))
    return (
        F.when(F.length(c) < 100, False)
        .when(signs, True)
        .when((statements >= 2) & c.rlike(word("curl")), True)
        .when(c.rlike(ONE_LINER), False)
        .when(c.rlike(r"^\s*curl\s") & (F.length(c) >= 150), True)
        .otherwise((statements >= 2) & (F.length(c) >= 120))
    )


# fixed values: what makes a shell command exploratory or operational
SAFE_OPERATIONS = (
    r"^\s*(?:mkdir|touch|cp|mv|rm|chmod|chown|ln|echo|printf|npx|cd|pwd)(?![A-Za-z0-9_])", r"^\s*cat\s*>", r"^\s*npm\s+(?:install|ci|run|start|build|test)(?![A-Za-z0-9_])", r"^\s*node\s+[^-]",
    r"^\s*git\s+(?:add|commit|push|pull|checkout|switch|branch|merge|rebase|stash|tag|fetch|clone|init)(?![A-Za-z0-9_])", r"^\s*pip\s+install(?![A-Za-z0-9_])", r"^\s*docker\s+(?:build|run|push|pull|start|stop|rm|exec)(?![A-Za-z0-9_])",
    r"(?i)^\s*curl\s.*-X\s*(?:POST|PUT|PATCH|DELETE)(?![A-Za-z0-9_])",
)
RESEARCH_COMMANDS = (
    r"(?<![A-Za-z0-9_])wget\s", r"\|\s*(?:python|python3|node|jq|grep|awk|sed)(?![A-Za-z0-9_])", word(r"git\s+(?:log|show|blame|diff)"), word("grep"), r"(?<![A-Za-z0-9_])(?:rg|find|tail|head|wc)\s", r"(?<![A-Za-z0-9_])cat\s+[^>]", "api-version=", r"localhost:\d+",
)
FALLBACK_COMMANDS = (r"(?<![A-Za-z0-9_])(?:curl|wget|grep|rg|ag|ack|locate)\s", word(r"git\s+(?:log|show|blame)"), word(r"npm\s+(?:info|search|view)"), word(r"pip\s+(?:show|search)"))
EXPLORING_STEMS = (
    "search", "investigat", "explor", "examin", "inspect", "understand", "analyz", "research", "debug", r"trac(?:e|ing)(?![A-Za-z0-9_])", r"look\s*(?:for|at|into|up)(?![A-Za-z0-9_])", r"find\s+(?:out|where|how|what|why)(?![A-Za-z0-9_])",
    "identif", "determin", r"figure\s+out", "brows", "scan", r"check\s+(?:if|whether|what|how|where|content)", r"what\s+(?:is|are|does)", r"how\s+(?:does|do|is|to)", r"where\s+(?:is|are|does)", r"list\s+(?:all|the|every|content)",
    r"show\s+(?:the|all|me|current)", "read(?![A-Za-z0-9_])", "view",
)
OPERATING_STEMS = (
    "creat", "build", "rebuild", "install", "run(?![A-Za-z0-9_])", "start", "deploy", "push", "commit", "compil", "test", "serv", "clean", "delet", "mov", "copy", "renam", r"set\s*up", "configur", "initializ", "generat", "writ", "mak", "updat", "fix",
    "apply", "execut", "launch", "restart", "stop(?![A-Za-z0-9_])", "kill", "format", "lint", "propagate", "copy.*to(?![A-Za-z0-9_])", "sync",
)


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def _votes(c: Column, stems: tuple[str, ...]) -> Column:
    return sum((c.rlike(rf"(?i)(?<![A-Za-z0-9_]){s}").cast("int") for s in stems), F.lit(0))


def is_exploratory(command: Column, description: Column) -> Column:
    """Layers: safe operations, research commands (but not calls that change things), votes of the description's words, patterns."""
    c, d = blank(command), blank(description)
    mutates = c.rlike(r"(?<![A-Za-z0-9_])curl\s") & c.rlike(r"(?i)(?:(?<=[A-Za-z0-9_]))-X\s*(?:POST|PUT|PATCH|DELETE)(?![A-Za-z0-9_])")
    explore, operate = _votes(d, EXPLORING_STEMS), _votes(d, OPERATING_STEMS)
    return (
        F.when(_any(c, SAFE_OPERATIONS), False)
        .when(~mutates & _any(c, RESEARCH_COMMANDS), True)
        .when((F.length(d) > 5) & (explore > operate), True)
        .when((F.length(d) > 5) & (operate > explore), False)
        .otherwise(_any(c, FALLBACK_COMMANDS))
    )


def workflow_name(step_names: Column) -> Column:
    """Up to three key words of the steps' names (in the order they are met), else the first name."""
    words = F.array(*map(F.lit, WORKFLOW_WORDS))
    found = F.flatten(F.transform(step_names, lambda n: F.filter(words, lambda w: F.contains(F.lower(blank(n)), w))))
    three = F.slice(F.array_distinct(found), 1, 3)
    return F.when(F.size(three) > 0, F.concat(F.array_join(F.transform(three, F.initcap), " + "), F.lit(" Pipeline"))).otherwise(F.concat(F.lit("Workflow: "), blank(F.get(step_names, F.lit(0)))))


def format_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000.0)).when(n >= 1000, F.format_string("%.1fK", n / 1000.0)).otherwise(n.cast("string"))


def format_duration(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%d sec", F.round(seconds).cast("long"))).when(seconds < 3600, F.format_string("%d min", F.round(seconds / 60).cast("long"))).otherwise(F.format_string("%.1f hrs", seconds / 3600.0))


def format_cost(usd: Column) -> Column:
    return F.format_string("$%.2f", usd.cast("double"))


def escape_label(value: Column) -> Column:
    """Backslash, newline and quote escaped, as metric labels need."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(blank(value), r"\\", r"\\\\"), "\n", r"\\n"), '"', r"\\\"")


def parse_since(text: Column) -> Column:
    """Seconds of ``7d``, ``24h``, ``30m`` or ``45s``; null for anything else."""
    n = F.regexp_extract(text, r"^(\d+)([dhms])$", 1)
    unit = F.regexp_extract(text, r"^(\d+)([dhms])$", 2)
    return F.when(n != "", n.cast("long") * F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).otherwise(1))
