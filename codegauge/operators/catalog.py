"""The rule table.

A pattern rule is data: users add rows to ``DEFAULT_RULES`` and pass the list on.
A structural rule has no patterns here; its hits are built in ``structural``.

A pattern row is (tokens, lead, body, trail). ``tokens`` are lower-case literals
that every match contains; patterns with the same first token are skipped
together where a text lacks it, so the rarest shared one comes first. ``lead`` is matched but the report points to the line
where ``body`` begins; ``trail`` is matched after it. In texts ``{text}`` stands
for the captured identifier, ``{number}`` for the measured number and ``{camel}``
for the camel-case form of the identifier.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from codegauge.functions.bytesview import WORD_END, WORD_START


@dataclass(frozen=True)
class Pattern:
    tokens: tuple[str, ...]
    body: str
    lead: str = ""
    trail: str = ""
    message: str | None = None  # overrides the message of the rule
    flags: str = "i"

    def regex(self) -> str:
        return f"(?d{self.flags}){self.lead}{self.body}{self.trail}"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    category: str
    message: str
    fix: str
    patterns: tuple[Pattern, ...] = field(default=())
    on: bool = True

    def message_of(self, pattern_order: int) -> str:
        if self.patterns and self.patterns[pattern_order].message:
            return self.patterns[pattern_order].message
        return self.message


# ---------------------------------------------------------------------------
# Limits, allowed names, rule ids, texts and patterns.
# ---------------------------------------------------------------------------
MAX_FUNCTION_LINES = 50
MAX_FILE_LINES = 500
MAX_COMPLEXITY = 20
MAX_NESTING = 4
INDENT_WIDTH = 4
MAX_LINE_BYTES = 120
DOC_WINDOW = 200
SHORT_NAMES_ALLOWED = ("i", "j", "k", "x", "y", "z")

_SECRET = "Store sensitive data in environment variables."
_Q = "[\"']"
_NQ = "[^\"']"
_INPUT3 = r"\$_(GET|POST|REQUEST)"
_INPUT4 = r"\$_(GET|POST|REQUEST|COOKIE)"

DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        "FUNCTION_TOO_LONG", "major", "complexity",
        "Function '{text}' is too long ({number} lines). Consider breaking it into smaller functions.",
        f"Refactor into smaller, focused functions (recommended max: {MAX_FUNCTION_LINES} lines)",
    ),
    Rule(
        "FILE_TOO_LONG", "major", "complexity",
        "File is too long ({number} lines). Consider splitting into multiple files.",
        f"Break into smaller, focused files (recommended max: {MAX_FILE_LINES} lines)",
    ),
    Rule(
        "HIGH_COMPLEXITY", "major", "complexity",
        "High cyclomatic complexity ({number}). Code may be difficult to test and maintain.",
        "Refactor to reduce complexity by extracting logic into separate functions",
    ),
    Rule(
        "SQL_INJECTION", "critical", "security",
        "Potential SQL Injection vulnerability detected. Use prepared statements instead.",
        "Use PDO prepared statements or mysqli_prepare() to prevent SQL injection.",
        (
            Pattern(("$", "select"), rf"\$\w+\s*=\s*{_Q}SELECT.*?\$\w+.*?{_Q}"),
            Pattern(("$", "insert"), rf"\$\w+\s*=\s*{_Q}INSERT.*?\$\w+.*?{_Q}"),
            Pattern(("$", "update"), rf"\$\w+\s*=\s*{_Q}UPDATE.*?\$\w+.*?{_Q}"),
            Pattern(("$", "delete"), rf"\$\w+\s*=\s*{_Q}DELETE.*?\$\w+.*?{_Q}"),
            Pattern(("$", "mysql_query"), rf"mysql_query\s*\(\s*{_Q}.*?\$\w+"),
            Pattern(("$", "mysqli_query"), rf"mysqli_query\s*\(.*?{_Q}.*?\$\w+"),
        ),
    ),
    Rule(
        "XSS_VULNERABILITY", "critical", "security",
        "Potential XSS vulnerability. User input is echoed without sanitization.",
        "Use htmlspecialchars() or htmlentities() to escape output.",
        (
            Pattern(("$", "$_", "echo"), rf"echo\s+{_INPUT4}\["),
            Pattern(("$", "$_", "print"), rf"print\s+{_INPUT4}\["),
            Pattern(("$", "$_", "?>"), rf"\?>\s*{_INPUT4}\["),
        ),
    ),
    Rule(
        "HARDCODED_SECRET", "critical", "security",
        f"Hardcoded secret detected. {_SECRET}",
        "Move secrets to .env file and use getenv() or $_ENV to access them.",
        (
            Pattern(("=", "password"), rf"password\s*=\s*{_Q}{_NQ}{{3,}}{_Q}",
                    message=f"Hardcoded password detected. {_SECRET}"),
            Pattern(("=", "api", "key"), rf"api[_-]?key\s*=\s*{_Q}{_NQ}{{10,}}{_Q}",
                    message=f"Hardcoded API key detected. {_SECRET}"),
            Pattern(("=", "secret"), rf"secret\s*=\s*{_Q}{_NQ}{{10,}}{_Q}",
                    message=f"Hardcoded secret detected. {_SECRET}"),
            Pattern(("=", "token"), rf"token\s*=\s*{_Q}{_NQ}{{10,}}{_Q}",
                    message=f"Hardcoded token detected. {_SECRET}"),
            Pattern(("=", "private", "key"), rf"private[_-]?key\s*=\s*{_Q}{_NQ}{{10,}}{_Q}",
                    message=f"Hardcoded private key detected. {_SECRET}"),
        ),
    ),
    Rule(
        "INSECURE_RANDOM", "major", "security",
        "Insecure random number generation. Use random_int() or random_bytes() for security-sensitive operations.",
        "Replace rand()/mt_rand() with random_int() for cryptographic purposes.",
        (
            Pattern(("rand",), rf"{WORD_START}rand\s*\("),
            Pattern(("rand", "mt_rand"), rf"{WORD_START}mt_rand\s*\("),
        ),
    ),
    Rule(
        "PATH_TRAVERSAL", "critical", "security",
        "Potential path traversal vulnerability. User input used in file operations.",
        "Validate and sanitize file paths. Use basename() and realpath() to prevent directory traversal.",
        (
            Pattern(("$", "$_", "file_get_contents"), rf"file_get_contents\s*\(\s*{_INPUT3}"),
            Pattern(("$", "$_", "fopen"), rf"fopen\s*\(\s*{_INPUT3}"),
            Pattern(("$", "$_", "include"), rf"include\s+{_INPUT3}"),
            Pattern(("$", "$_", "require"), rf"require\s+{_INPUT3}"),
        ),
    ),
    Rule(
        "COMMAND_INJECTION", "critical", "security",
        "Potential command injection vulnerability. User input used in system command.",
        "Use escapeshellarg() and escapeshellcmd() or avoid shell commands entirely.",
        (
            Pattern(("$", "exec"), rf"exec\s*\(\s*{_Q}.*?\$\w+"),
            Pattern(("$", "shell_exec"), rf"shell_exec\s*\(\s*{_Q}.*?\$\w+"),
            Pattern(("$", "system"), rf"system\s*\(\s*{_Q}.*?\$\w+"),
            Pattern(("$", "passthru"), rf"passthru\s*\(\s*{_Q}.*?\$\w+"),
        ),
    ),
    Rule(
        "FILE_INCLUSION", "critical", "security",
        "Potential file inclusion vulnerability. User input used in include/require.",
        "Never use user input directly in include/require. Use a whitelist of allowed files.",
        (
            Pattern(("$", "$_", "include"), rf"include\s*\(\s*{_INPUT4}"),
            Pattern(("$", "$_", "require"), rf"require\s*\(\s*{_INPUT4}"),
            Pattern(("$", "$_", "include_once"), rf"include_once\s*\(\s*{_INPUT4}"),
            Pattern(("$", "$_", "require_once"), rf"require_once\s*\(\s*{_INPUT4}"),
        ),
    ),
    Rule(
        "NAMING_CONVENTION_FUNCTION", "minor", "style",
        "Function '{text}' uses snake_case. Consider using camelCase for function names.",
        "Rename to camelCase, e.g., '{camel}'",
        (Pattern(("function", "_"), "[a-z]+_[a-z_]+", lead=r"function\s+", trail=r"\s*\("),),
    ),
    Rule(
        "NAMING_CONVENTION_CLASS", "minor", "style",
        "Class '{text}' should use PascalCase naming.",
        "Rename to PascalCase",
        (Pattern(("class",), "[a-z][a-z_]*", lead=r"class\s+", trail=r"\s"),),
    ),
    Rule(
        "SHORT_VARIABLE_NAME", "info", "style",
        "Variable '${text}' is too short. Use descriptive variable names.",
        "Use a more descriptive name that explains the variable's purpose",
        (Pattern(("$",), "[a-z]", lead=r"\$", trail=rf"{WORD_END}(?!\s*=\s*\d)"),),
    ),
    Rule(
        "MISSING_DOCUMENTATION", "minor", "style",
        "Public function '{text}' is missing PHPDoc documentation.",
        "Add a PHPDoc comment describing the function's purpose, parameters, and return value",
    ),
    Rule(
        "MISSING_CLASS_DOCUMENTATION", "minor", "style",
        "Class '{text}' is missing PHPDoc documentation.",
        "Add a PHPDoc comment describing the class's purpose",
    ),
    Rule(
        "INCONSISTENT_INDENTATION", "minor", "style",
        "Inconsistent indentation detected. Mix of tabs and spaces.",
        "Use either spaces or tabs consistently throughout the file (PSR-12 recommends 4 spaces)",
    ),
    Rule(
        "DEEP_NESTING", "major", "complexity",
        "Deep nesting detected (level {number}). Consider refactoring.",
        "Extract nested logic into separate functions to improve readability",
    ),
    Rule(
        "LINE_TOO_LONG", "info", "style",
        f"Line exceeds {MAX_LINE_BYTES} characters ({{number}} characters).",
        "Break long lines into multiple lines for better readability",
    ),
    Rule(
        "MISSING_STRICT_TYPES", "info", "style",
        "Missing strict_types declaration.",
        "Add declare(strict_types=1); at the top of the file to enforce type safety.",
    ),
    Rule(
        "UNUSED_IMPORT", "minor", "style",
        "Unused import: '{text}'.",
        "Remove the unused 'use' statement.",
    ),
    Rule(
        "TRAILING_WHITESPACE", "info", "style",
        "Trailing whitespace detected.",
        "Remove trailing spaces and tabs",
        on=False,
    ),
)


def rules_with(*rule_ids: str, base: tuple[Rule, ...] = DEFAULT_RULES) -> tuple[Rule, ...]:
    """The same table with only the named rules switched on."""
    unknown = set(rule_ids) - {r.rule_id for r in base}
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return tuple(replace(r, on=r.rule_id in rule_ids) for r in base)


def switched(rule_id: str, on: bool, base: tuple[Rule, ...] = DEFAULT_RULES) -> tuple[Rule, ...]:
    return tuple(replace(r, on=on) if r.rule_id == rule_id else r for r in base)
