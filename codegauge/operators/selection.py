"""Which files are analysed, which requests are accepted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Extensions, folders, limits, error codes.
# ---------------------------------------------------------------------------
ANALYZED_EXTENSIONS = (
    ".php", ".js", ".jsx", ".ts", ".tsx", ".py", ".java", ".c", ".cpp", ".cs",
    ".rb", ".go", ".rs", ".swift", ".kt", ".scala", ".html", ".css", ".vue",
)
IGNORED_PARTS = ("node_modules", "vendor", ".git", "dist", "build", "coverage", ".next", "out")
MAX_FILE_BYTES = 512000
MAX_FILES = 50
BINARY_SAMPLE, BINARY_SHARE = 1024, 0.3
BASE64_MIN, BASE64_SAMPLE, BASE64_SHARE = 50, 100, 0.9
INVALID_REQUEST = "INVALID_REQUEST"
FILE_LIMIT_EXCEEDED = "FILE_LIMIT_EXCEEDED"
FILE_SIZE_EXCEEDED = "FILE_SIZE_EXCEEDED"
INVALID_ENCODING = "INVALID_ENCODING"
MISSING_REQUIRED_FIELD = "MISSING_REQUIRED_FIELD"

# Reasons for leaving a file out.
NO_NAME, IGNORED_FOLDER, OTHER_EXTENSION = "no_name", "ignored_folder", "other_extension"
TOO_LARGE, BINARY = "too_large", "binary"


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; '' without one or with a bare trailing dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def has_extension(path: Column, allowed: Sequence[str] = ANALYZED_EXTENSIONS) -> Column:
    return extension(path).isin(*allowed)


def in_ignored_part(path: Column, ignored: Sequence[str] = IGNORED_PARTS) -> Column:
    """Any part of the path, the file name included, is an ignored name."""
    return F.arrays_overlap(F.split(F.lower(path), "/", -1), F.array(*[F.lit(p) for p in ignored]))


def within_size(size: Column, limit: int | None = None) -> Column:
    """Without a limit every size is within it; so is an unknown size."""
    return F.lit(True) if limit is None else size.isNull() | (size <= limit)


def has_name(path: Column) -> Column:
    return F.coalesce(F.rlike(path, F.lit(r"(?U)\S")), F.lit(False))


def is_binary(content: Column) -> Column:
    """More than the allowed share of control characters in the first characters."""
    sample = F.substring(content, 1, BINARY_SAMPLE)
    control = F.regexp_count(sample, F.lit(r"[\p{Cc}&&[^\n\r\t]]"))
    return has_name(content) & (control / F.length(sample) > BINARY_SHARE)


def is_base64(content: Column) -> Column:
    sample = F.substring(content, 1, BASE64_SAMPLE)
    kept = F.length(F.regexp_replace(sample, r"[^\p{L}\p{Nd}+/=]", ""))
    long_enough = has_name(content) & (F.length(content) >= BASE64_MIN)
    return long_enough & (kept / F.length(sample) > BASE64_SHARE)


def reject_reason(
    path: Column,
    size: Column | None = None,
    limit: int | None = None,
    extensions: Sequence[str] = ANALYZED_EXTENSIONS,
    ignored: Sequence[str] = IGNORED_PARTS,
) -> Column:
    """Why a file is left out, from tests that need no content; NULL where it is kept."""
    reason = (
        F.when(~has_name(path), NO_NAME)
        .when(in_ignored_part(path, ignored), IGNORED_FOLDER)
        .when(~has_extension(path, extensions), OTHER_EXTENSION)
    )
    return reason if size is None or limit is None else reason.when(~within_size(size, limit), TOO_LARGE)


def wanted(path: Column, size: Column | None = None, **options) -> Column:
    """The tests that need no content: name, folders, extension, and size where a limit is given."""
    return reject_reason(path, size, **options).isNull()


def with_reject_reason(files: DataFrame, drop_binary: bool = False, **options) -> DataFrame:
    """Files with ``reject_reason``; the content is only looked at if ``drop_binary`` asks for it."""
    reason = reject_reason(F.col("path"), F.col("size_bytes"), **options)
    if drop_binary:
        reason = F.coalesce(reason, F.when(is_binary(F.col("content")), F.lit(BINARY)))
    return files.withColumn("reject_reason", reason)


def select_files(files: DataFrame, drop_binary: bool = False, **options) -> DataFrame:
    """Files worth analysing; no size limit and no look at the content unless asked for."""
    kept = with_reject_reason(files, drop_binary, **options).where(F.col("reject_reason").isNull())
    return kept.drop("reject_reason")


def rejected_files(files: DataFrame, drop_binary: bool = False, **options) -> DataFrame:
    """The files that ``select_files`` leaves out, with the first reason that holds."""
    return with_reject_reason(files, drop_binary, **options).where(F.col("reject_reason").isNotNull())


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first n files of each run in archive order.

    The rank is cut per task before the shuffle, so a run with very many files
    sends at most n rows from each task.
    """
    order = Window.partitionBy("run_id").orderBy("entry_index", "path")
    ranked = files.withColumn("__rank", F.row_number().over(order))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def validate_batches(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Error code per batch (NULL where valid); the first failing test and file win.

    ``files`` has one row per file of a batch (an empty batch has one row with a
    NULL ``entry_index``). One pre-aggregated grouping; contents stay in the tasks.
    """
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    code = F.when(F.length(content) > max_bytes, FILE_SIZE_EXCEEDED).when(
        ~F.is_valid_utf8(content.cast("string")), INVALID_ENCODING
    )
    checked = files.select("batch_id", "entry_index", code.alias("code"))
    first_bad = F.min(F.when(F.col("code").isNotNull(), F.struct("entry_index", "code")))
    totals = checked.groupBy("batch_id").agg(
        F.count("entry_index").cast("int").alias("n_files"), first_bad.alias("bad")
    )
    return totals.select(
        "batch_id",
        "n_files",
        F.when(F.col("n_files") == 0, INVALID_REQUEST)
        .when(F.col("n_files") > max_files, FILE_LIMIT_EXCEEDED)
        .otherwise(F.col("bad.code"))
        .alias("error_code"),
    )


def request_error(repo_url: Column, branch: Column) -> Column:
    """Error code of a request: the URL is required and must be one, the branch is required."""
    return (
        F.when(~has_name(repo_url), "REPO_URL_REQUIRED")
        .when(~F.rlike(repo_url, F.lit(r"(?i)^(https?|ftp)://")), "REPO_URL_INVALID")
        .when(~has_name(branch), "BRANCH_REQUIRED")
    )


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``error_code``; rows without one are accepted."""
    return requests.withColumn("error_code", request_error(F.col("repo_url"), F.col("branch")))
