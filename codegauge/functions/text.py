"""Scalar text functions: names, URLs, redaction, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Hosts, token shapes, markers and keywords.
# ---------------------------------------------------------------------------
HOST_PREFIX = r"(?i)^https?://github\.com/"
CANONICAL_PREFIX = "https://github.com/"
REDACTED_TOKEN = "[REDACTED_TOKEN]"
REDACTED = "[REDACTED]"
TOKEN_PATTERNS = ("ghp_[A-Za-z0-9]{36}", "github_pat_[A-Za-z0-9_]+")
LONG_WORD = r"(?U)\b[a-zA-Z0-9]{40,}\b"
NAMED_VALUE = r'(?iU)(token|key|secret|password|authorization)\s*[:=]\s*[^\s,}"]+'
JSON_VALUE = r'(?iU)"(token|password|client_secret|access_token|refresh_token)"\s*:\s*"[^"]+"'
QUERY_TOKEN = "githubToken=[^&]*"
BODY_LIMIT, BODY_MARKER = 2000, "... [Truncated]"
ERROR_LIMIT, ERROR_MARKER = 200, "..."
CATEGORY_WORDS = (
    ("Security", ("security", "injection", "xss")),
    ("Performance", ("performance", "slow", "optimization")),
    ("Style", ("style", "format", "indentation")),
)
OTHER_CATEGORY = "General"


def snake_to_camel(name: Column) -> Column:
    """Drop underscores, raise the letter after each, lower the very first letter."""
    raised = F.array_join(
        F.transform(
            F.split(name, "_", -1),
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))),
        ),
        "",
    )
    return F.concat(F.lower(F.substring(raised, 1, 1)), F.substr(raised, F.lit(2)))


def sanitize_repo_url(url: Column) -> Column:
    """Trim, drop the host prefix, trailing slashes, then one ``.git``."""
    trimmed = F.regexp_replace(url, r"^\s+|\s+$", "")
    path = F.regexp_replace(trimmed, HOST_PREFIX, "")
    path = F.regexp_replace(path, "/+$", "")
    return F.regexp_replace(path, r"(?i)\.git$", "")


def repo_owner(url: Column) -> Column:
    """Second-to-last part of the sanitized URL; NULL where the URL has one part only."""
    parts = F.split(sanitize_repo_url(url), "/", -1)
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def repo_name(url: Column) -> Column:
    parts = F.split(sanitize_repo_url(url), "/", -1)
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1))


def repo_url_error(url: Column) -> Column:
    """Error code of a URL that names no repository, else NULL."""
    blank = url.isNull() | (F.trim(url) == "")
    return F.when(blank, "MISSING_URL").when(repo_owner(url).isNull(), "INVALID_URL")


def canonical_url(owner: Column, name: Column) -> Column:
    return F.concat(F.lit(CANONICAL_PREFIX), owner, F.lit("/"), name)


def display_repo_name(url: Column) -> Column:
    """Last two URL parts as they are; the URL itself where there is one part, '' for NULL."""
    parts = F.split(url, "/", -1)
    two = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    return F.when(url.isNull(), "").when(F.size(parts) >= 2, two).otherwise(url)


def redact_tokens(text: Column) -> Column:
    for pattern in TOKEN_PATTERNS:
        text = F.regexp_replace(text, pattern, REDACTED_TOKEN)
    return text


def redact_log(text: Column) -> Column:
    """Long words first, then ``name: value`` pairs, then JSON fields."""
    text = F.regexp_replace(text, LONG_WORD, REDACTED)
    text = F.regexp_replace(text, NAMED_VALUE, f"$1: {REDACTED}")
    return F.regexp_replace(text, JSON_VALUE, f'"$1": "{REDACTED}"')


def redact_query(url: Column, first_only: bool = False) -> Column:
    """Hide token parameters: all of them, or only the first."""
    value = f"githubToken={REDACTED}"
    if not first_only:
        return F.regexp_replace(url, QUERY_TOKEN, value)
    return F.regexp_replace(url, f"(?s)^(.*?){QUERY_TOKEN}", f"$1{value}")


def truncate(text: Column, limit: int = BODY_LIMIT, marker: str = BODY_MARKER) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))
    ).otherwise(text)


def run_summary_text(files: Column, score: Column, issues: Column) -> Column:
    return F.format_string(
        "Analyzed %d files. Score: %s/100. Issues: %d",
        files, score.cast("decimal(20,2)").cast("string"), issues,
    )


def score_from_summary(summary: Column) -> Column:
    digits = F.regexp_extract(summary, r"Score: (\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(0))


def shown_score(average: Column, summary: Column) -> Column:
    """The stored average, or the one in the summary text where it is 0 or missing."""
    return F.coalesce(F.nullif(average.cast("double"), F.lit(0.0)), score_from_summary(summary).cast("double"))


def infer_category(message: Column) -> Column:
    lowered = F.lower(message)
    result = F
    for name, words in CATEGORY_WORDS:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(lowered, F.lit(word))
        result = result.when(test, name)
    return result.otherwise(OTHER_CATEGORY)


def short_hash(sha: Column) -> Column:
    return F.substring(sha, 1, 8)


def duration_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def cutoff(now: Column, hours: int = 24) -> Column:
    return now - F.make_dt_interval(F.lit(0), F.lit(hours))


def round2(value: Column) -> Column:
    """Two decimals, half away from zero."""
    return F.round(value, 2)
