"""Predicates and metadata that follow from a repository path alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

STATE_DIRECTORY = ".siftline"

# Names whose files are never read.
BLOCKED_DIRECTORIES = (
    ".git", ".obsidian", STATE_DIRECTORY, "node_modules", ".pnpm-store", "coverage", ".ssh", ".aws", ".azure", ".gcp",
    "private-uploads", "private_uploads",
)
BLOCKED_FILES = (
    ".env", "credentials.json", "secrets.json", "secret.json", "id_rsa", "id_ed25519", "backup.sql", "dump.sql", ".npmrc",
    ".pypirc", ".netrc",
)
BLOCKED_SUFFIX = r"\.(pem|key|p12|pfx|dump)$"
BLOCKED_PREFIX = (
    r"^\.env\.|^(credentials|secrets?)[._-]"
    r"|^(api[-_.]?keys?|access[-_.]?tokens?|refresh[-_.]?tokens?|tokens?|passwords?|cookies|(client[-_.]?)?pii|private[-_.]?(dump|backup))([._-]|$)"
)
DEVICE = r"^(con|prn|aux|nul|com[1-9¹²³]|lpt[1-9¹²³])[ .]*(\.|$)"
ROOT_DOCUMENTS = ("AGENTS.md", "CHANGELOG.md", "CODE_OF_CONDUCT.md", "CONTRIBUTING.md", "README.md", "SECURITY.md")
# Authority by path, first match wins.
AUTHORITY_RULES = (
    ("policy", "root-agents-file", r"^agents\.md$"),
    ("policy", "root-security-file", r"^security\.md$"),
    ("policy", "root-code-of-conduct-file", r"^code_of_conduct\.md$"),
    ("adr", "docs-adr-directory", r"^docs/adr/"),
    ("specification", "docs-specification-directory", r"^docs/specification/"),
    ("contract_schema", "docs-contract-schema-directory", r"^docs/(contracts?|schemas?)/"),
    ("roadmap", "roadmap-file", r"(^docs/roadmap\.md$)|(/roadmap\.md$)"),
    ("generated_summary", "docs-generated-directory", r"^docs/generated/"),
)
# Which files outside the documents are read, by extension, name or pattern.
SOURCE_EXTENSIONS = (
    ".c", ".cc", ".cjs", ".cpp", ".cs", ".css", ".cts", ".go", ".h", ".hpp", ".html", ".java", ".js", ".jsx", ".kt", ".kts", ".md", ".mdx", ".mjs", ".mts",
    ".php", ".ps1", ".py", ".rb", ".rs", ".sh", ".sql", ".swift", ".toml", ".ts", ".tsx", ".vue", ".xml", ".yaml", ".yml",
)
SOURCE_NAMES = (
    ".eslintrc.json", ".stylelintrc.json", "bun.lock", "bun.lockb", "cargo.lock", "composer.json", "composer.lock", "deno.json", "deno.jsonc", "dockerfile",
    "gemfile", "gemfile.lock", "gnumakefile", "jsconfig.json", "justfile", "makefile", "npm-shrinkwrap.json", "package-lock.json", "package.json", "pipfile.lock",
    "pnpm-lock.yaml", "poetry.lock", "procfile", "rakefile", "tsconfig.json", "uv.lock", "yarn.lock",
)
SOURCE_PATTERNS = (
    r"^(ts|js)config(\.[a-z0-9_-]+)*\.json$",
    r"^(dockerfile|containerfile)(\.[a-z0-9_-]+)?$",
    r"^(eslint|prettier|stylelint)\.config\.[cm]?[jt]s$",
    r"^(go\.(mod|sum)|requirements(-[a-z0-9_-]+)?\.txt|pom\.xml|build\.gradle(\.kts)?)$",
)
# Kind of such a file by its path, first match wins; all others are code.
POLICY_FILE = r"(^|/)agents\.md$|^(security|code_of_conduct)\.md$"
KIND_RULES = (
    ("document", POLICY_FILE),
    ("test", r"(^|/)(test|tests|__tests__)(/|$)|\.(test|spec)\.[^./]+$"),
    ("configuration", r"(^|/)(config|configuration)(/|$)|\.(json|toml|ya?ml)$"),
)
METADATA_TERMS, METADATA_CHARS = 32, 128


def _segments(path: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", ""))
    return F.filter(F.split(plain, "/"), lambda s: s != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """The path's directory, empty for a root file."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def is_sensitive(path: Column) -> Column:
    raw = _segments(path)
    clean = F.transform(raw, lambda s: F.regexp_replace(s, "[. ]+$", ""))
    name = F.coalesce(F.element_at(F.when(F.size(clean) > 0, clean), -1), F.lit(""))
    return (
        F.exists(raw, lambda s: s.rlike(r'[<>:"|?*]'))
        | F.exists(clean, lambda s: s.rlike(DEVICE) | s.isin(*BLOCKED_DIRECTORIES))
        | name.isin(*BLOCKED_FILES)
        | name.rlike(BLOCKED_SUFFIX)
        | name.rlike(BLOCKED_PREFIX)
    )


def is_excluded(path: Column, excludes: list[str]) -> Column:
    """Whether the path or one of its ancestors is listed."""
    return F.exists(F.array(*[F.lit(e) for e in excludes]).cast("array<string>"), lambda e: (path == e) | F.startswith(path, F.concat(e, F.lit("/"))))


def within(path: Column, boundaries: Column) -> Column:
    return F.exists(boundaries, lambda b: (path == b) | F.startswith(path, F.concat(b, F.lit("/"))))


def allowed_by_capsule(path: Column, authority: Column, allowed: Column, forbidden: Column) -> Column:
    """Policies always pass; a forbidden prefix removes; a list of allowed prefixes must match if there is one."""
    return (authority == "policy") | (~within(path, forbidden) & ((F.size(allowed) == 0) | within(path, allowed)))


def is_document(path: Column) -> Column:
    return path.isin(*ROOT_DOCUMENTS) | F.lower(path).rlike(r"^docs/.*\.md$")


def is_source_file(path: Column) -> Column:
    """Whether a file outside the document corpus is read, by its name alone."""
    name = F.lower(file_name(F.replace(path, F.lit("\\"), F.lit("/"))))
    out = F.regexp_extract(name, r"(\.[^.]*)$", 1).isin(*SOURCE_EXTENSIONS) | name.isin(*SOURCE_NAMES)
    for pattern in SOURCE_PATTERNS:
        out = out | name.rlike(pattern)
    return out


def is_safe(path: Column) -> Column:
    """Relative, portable and without dot segments."""
    return (
        (path != "")
        & ~path.rlike(r"^/|[\\:\x00-\x1F\x7F]|//|/$")
        & ~F.exists(F.split(path, "/"), lambda s: s.isin(".", "..") | s.rlike(r"[. ]$") | F.lower(s).rlike(DEVICE))
    )


def is_inside_root(path: Column) -> Column:
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)")


def is_task_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~F.lower(value).rlike(DEVICE) & ~value.rlike(r"\.$")


def authority(path: Column) -> Column:
    """struct(authority, basis, rule_id) from the path's conventions."""
    plain = F.lower(F.regexp_replace(path, r"\\", "/"))
    chosen = F.struct(F.lit("implementation_note").alias("authority"), F.lit("default").alias("basis"), F.lit(None).cast("string").alias("rule_id"))
    for name, rule, pattern in reversed(AUTHORITY_RULES):
        match = F.struct(F.lit(name).alias("authority"), F.lit("convention").alias("basis"), F.lit(rule).alias("rule_id"))
        chosen = F.when(plain.rlike(pattern), match).otherwise(chosen)
    return chosen


def _metadata(value: Column, normalise: bool) -> Column:
    bounded = F.transform(text.distinct_terms(value, normalise), lambda t: F.substring(t, 1, METADATA_CHARS))
    return F.array_sort(F.slice(F.array_distinct(bounded), 1, METADATA_TERMS))


def modules(path: Column, normalise: bool = False) -> Column:
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    inner = (F.lower(F.get(parts, F.lit(0))) == "docs") & (F.size(parts) > 2)
    terms = _metadata(F.when(inner, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))), normalise)
    named = F.when(F.size(terms) > 0, F.array(F.substring(F.array_join(terms, "-"), 1, METADATA_CHARS))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) == 1, F.array(F.lit("workspace"))).otherwise(named)


def topics(path: Column, normalise: bool = False) -> Column:
    return _metadata(F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", ""), normalise)


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, with the root as an empty text."""
    parts = F.split(path, "/")
    depths = F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1))
    return F.transform(depths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def kind(path: Column) -> Column:
    """What a repository file outside the documents is, by its path."""
    low = F.lower(path)
    out = F.lit("code")
    for name, pattern in reversed(KIND_RULES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def file_authority(path: Column, of_kind: Column) -> Column:
    """Authority of a file outside the document corpus."""
    return F.when(F.lower(path).rlike(POLICY_FILE), "policy").when(of_kind.isin("test", "configuration"), of_kind).otherwise("source_code")
