"""Queries of the readers and of file selection."""

from __future__ import annotations

import io
import itertools
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.functions.labels import file_class
from codegauge.operators import selection as B
from codegauge.sources import files as A
from codegauge.workspace import shared_folder
from suite.mapping import even_tasks, mapped, with_sql
from suite.registry import query

_EXTS = ", ".join(f"'{e}'" for e in B.ANALYZED_EXTENSIONS)
_PARTS = ", ".join(f"'{p}'" for p in B.IGNORED_PARTS)
_EXT = r"lower(regexp_extract(path, '(\.[^./]+)$', 1))"
_IGNORED = f"list_has_any(string_split(lower(path), '/'), [{_PARTS}])"


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered files packed into zip payloads of at most 40 files each."""
    files = mapped(spark, sf_dir, "code_files").withColumn(
        "archive", F.concat(F.lit("batch-"), F.floor(F.col("entry_index") / 40).cast("string"))
    )

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("root-1/", b"")
            for path, text in zip(batch["path"], batch["content"], strict=True):
                z.writestr(f"root-1/{path}", b"\xef\xbb\xbf" + text.encode())
        return pd.DataFrame({"archive": [batch["archive"].iloc[0]], "content": [out.getvalue()]})

    return (
        files.select("archive", "path", "content")
        .repartition(even_tasks(spark), "archive")
        .groupBy("archive")
        .applyInPandas(pack, "archive string, content binary")
    )


@query(
    "A1", "B1", "B2", "B3", "B4", "J19",
    sql=with_sql("code_files", body=f"""
SELECT concat('batch-', CAST(entry_index // 40 AS VARCHAR)) AS archive, path,
  CAST(strlen(content) AS BIGINT) AS n_bytes, md5(content) AS digest
FROM code_files WHERE {_EXT} IN ({_EXTS}) AND NOT {_IGNORED}"""),
)
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = A.archive_entries(_archives(spark, sf_dir), max_bytes=B.MAX_FILE_BYTES)
    return entries.where("error IS NULL").select(
        "archive",
        "path",
        F.octet_length("content").cast("long").alias("n_bytes"),
        F.md5("content").alias("digest"),
    )


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON requests of 45 and 55 files, some fields missing."""
    files = mapped(spark, sf_dir, "document_files")
    k = F.col("entry_index")
    batch = F.floor(k / 100) * 2 + F.when(k % 100 < 45, 0).otherwise(1)
    file = F.struct(
        k.alias("k"),
        F.when(k % 9 != 0, F.col("path")).alias("path"),
        F.when(k % 13 != 0, F.col("content")).alias("content"),
    )
    listed = files.groupBy(batch.cast("long").alias("batch_id")).agg(
        F.array_sort(F.collect_list(file)).alias("files")
    )
    fields = F.transform("files", lambda f: F.struct(f["path"].alias("path"), f["content"].alias("content")))
    return listed.select("batch_id", F.to_json(F.struct(fields.alias("files"))).alias("body"))


_BATCH_SQL = """
SELECT CAST((entry_index // 100) * 2 + CASE WHEN entry_index % 100 < 45 THEN 0 ELSE 1 END AS BIGINT) AS batch_id,
  CAST(row_number() OVER (PARTITION BY entry_index // 100, entry_index % 100 < 45 ORDER BY entry_index) - 1 AS INT) AS entry_index,
  CASE WHEN entry_index % 9 <> 0 THEN path ELSE 'unknown' END AS path,
  CASE WHEN entry_index % 13 <> 0 THEN content ELSE '' END AS content
FROM document_files"""


@query(
    "A2", "J18",
    sql="""
SELECT page_id, CAST(strlen(html) + 1 AS BIGINT) AS size_bytes, md5(concat(html, chr(10))) AS digest FROM pages""",
)
def loose_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as one text file each (which ends in a newline), read back as files.

    Pages are dealt to the tasks, which write the files where they belong and list and read them:
    a file costs far more than its bytes, so none is moved or known to the driver. Pages of
    one id share a file.
    """
    from codegauge.sources.tables import read_table

    folder = shared_folder(spark, "loose")
    pages = read_table(spark, sf_dir, "pages")
    own = F.concat(F.lit("page_id="), F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    lines = pages.select(own.alias("own"), F.encode(F.concat(F.coalesce("html", F.lit("")), F.lit("\n")), "UTF-8").alias("content"))
    dealt = lines.repartition(even_tasks(spark), "own").sortWithinPartitions("own")
    name = F.format_string("%s/part-%05d.txt", "own", F.spark_partition_id())
    dealt.select(name.alias("path"), "content").foreachPartition(_store(folder, joined=True))
    files = A.read_files(spark, folder, extensions=(".txt",))
    return files.select(
        F.regexp_extract("path", r"^page_id=(\d+)/", 1).cast("long").alias("page_id"),
        "size_bytes",
        F.md5("content").alias("digest"),
    )


@query("A3", "J20", sql=with_sql("document_files", body=_BATCH_SQL))
def request_batch_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.parse_batches(_batches(spark, sf_dir))


@query(
    "B8",
    sql=with_sql("document_files", body=f"""
SELECT batch_id, CAST(count(*) AS INT) AS n_files,
  CASE WHEN count(*) > 50 THEN 'FILE_LIMIT_EXCEEDED'
       WHEN max(strlen(content)) > 60000 THEN 'FILE_SIZE_EXCEEDED' END AS error_code
FROM ({_BATCH_SQL}) GROUP BY 1"""),
)
def batch_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.validate_batches(A.parse_batches(_batches(spark, sf_dir)), B.MAX_FILES, max_bytes=60000)


@query(
    "A4", "B9",
    sql="""
SELECT conv_id * 1000 + turn AS request_id,
  CASE WHEN turn % 2 = 0 THEN concat(role, '.txt') ELSE 'unknown' END AS path,
  CASE WHEN conv_id % 5 = 0 THEN '0' WHEN conv_id % 7 = 0 THEN NULL ELSE text END AS content,
  CASE WHEN conv_id % 5 = 0 OR conv_id % 7 = 0 OR text = '' THEN 'MISSING_REQUIRED_FIELD' END AS error_code
FROM conversations""",
)
def single_snippet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codegauge.sources.tables import read_table

    bodies = read_table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn AS request_id",
        """to_json(named_struct(
             'code', CASE WHEN conv_id % 5 = 0 THEN '0' WHEN conv_id % 7 = 0 THEN NULL ELSE text END,
             'file_path', CASE WHEN turn % 2 = 0 THEN concat(role, '.txt') END)) AS body""",
    )
    return A.parse_snippets(bodies)


@query(
    "B1", "B2", "B3", "B4", "J18",
    sql=with_sql("code_files", body=f"""
SELECT path, {_EXT} AS extension, {_EXT} IN ({_EXTS}) AS allowed, {_IGNORED} AS ignored,
  strlen(content) <= 800 AS small FROM code_files"""),
)
def file_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return mapped(spark, sf_dir, "code_files").select(
        "path",
        B.extension(path).alias("extension"),
        B.has_extension(path).alias("allowed"),
        B.in_ignored_part(path).alias("ignored"),
        B.within_size(F.octet_length("content"), 800).alias("small"),
    )


@query(
    "B1", "B2", "B3", "B4", "B5",
    sql=with_sql("code_files", "page_files", body=f"""
SELECT path, CAST(strlen(content) AS BIGINT) AS size_bytes
FROM (SELECT path, content FROM code_files UNION ALL SELECT path, content FROM page_files)
WHERE {_EXT} IN ({_EXTS}) AND NOT {_IGNORED} AND strlen(content) <= 512000
  AND len(regexp_replace(substr(content, 1, 1024), '[^\\p{{Cc}}]|[\\n\\r\\t]', '', 'g'))
      <= 0.3 * least(1024, len(content))"""),
)
def file_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = mapped(spark, sf_dir, "code_files").select("path", "content")
    pages = mapped(spark, sf_dir, "page_files").select("path", "content")
    files = A.with_size(code.unionByName(pages))
    return B.select_files(files, drop_binary=True, limit=B.MAX_FILE_BYTES).select("path", "size_bytes")


@query(
    "B1", "B2", "B3", "B4", "B5", "B10",
    sql=with_sql("code_files", "page_files", body=f"""
SELECT path, CAST(strlen(content) AS BIGINT) AS size_bytes,
  CASE WHEN {_IGNORED} THEN 'ignored_folder' WHEN NOT {_EXT} IN ({_EXTS}) THEN 'other_extension'
       WHEN strlen(content) > 1500 THEN 'too_large' ELSE 'binary' END AS reject_reason
FROM (SELECT path, content FROM code_files UNION ALL SELECT path, content FROM page_files)
WHERE {_IGNORED} OR NOT {_EXT} IN ({_EXTS}) OR strlen(content) > 1500
  OR len(regexp_replace(substr(content, 1, 1024), '[^\\p{{Cc}}]|[\\n\\r\\t]', '', 'g'))
      > 0.3 * least(1024, len(content))"""),
)
def rejected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that the tests leave out, with the reason."""
    code = mapped(spark, sf_dir, "code_files").select("path", "content")
    pages = mapped(spark, sf_dir, "page_files").select("path", "content")
    files = A.with_size(code.unionByName(pages))
    return B.rejected_files(files, drop_binary=True, limit=1500).select("path", "size_bytes", "reject_reason")


def _store(root: str, joined: bool = False):
    """Writes rows (path, content) as files below a folder; of rows with one path the last stays.

    If they are to be ``joined``, rows of one path that follow one another share a file.
    """

    def write(rows):
        import pyarrow.fs as fs

        system, base = fs.FileSystem.from_uri(root)
        files = itertools.groupby(rows, key=lambda row: row[0]) if joined else ((row[0], [row]) for row in rows)
        for path, same in files:
            place = f"{base}/{path}"
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(place) as out:
                for row in same:
                    out.write(bytes(row[1]))

    return write


def _stored_archives(files: DataFrame) -> DataFrame:
    """Files packed into zips of one source and at most 40 places of it each, so that no source is one group."""
    part = F.floor(F.col("entry_index") / 40).cast("string")
    packed = files.select(F.concat("run_id", F.lit("-"), part, F.lit(".zip")).alias("archive"), "path", "content")

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, text in zip(batch["path"], batch["content"], strict=True):
                z.writestr(f"root/{path}", text.encode())
        return pd.DataFrame({"archive": [batch["archive"].iloc[0]], "content": [out.getvalue()]})

    dealt = packed.repartition(even_tasks(files.sparkSession), "archive")
    return dealt.groupBy("archive").applyInPandas(pack, "archive string, content binary")


@query(
    "A1", "A2", "J18", "J19",
    sql=with_sql("document_files", body="""
SELECT source, path, CAST(strlen(content) AS BIGINT) AS n_bytes, md5(content) AS digest
FROM document_files, (VALUES ('zip'), ('loose')) AS s(source)"""),
)
def stored_file_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as zip archives and as loose files; both readers give paths and texts."""
    files = mapped(spark, sf_dir, "document_files")
    zips, loose = shared_folder(spark, "my archives"), shared_folder(spark, "loose+files")
    packed = _stored_archives(files)

    packed.foreachPartition(_store(zips))
    loose_rows = files.select("path", F.encode("content", "UTF-8").alias("content"))
    loose_rows.repartition(even_tasks(spark), "path").foreachPartition(_store(loose))
    columns = lambda source: [
        F.lit(source).alias("source"), "path", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest")
    ]
    from_zip = A.read_archives(spark, zips, extensions=(".txt",)).where("error IS NULL").select(*columns("zip"))
    return from_zip.unionByName(A.read_files(spark, loose, extensions=(".txt",)).select(*columns("loose")))


@query(
    "B5", "B6",
    sql=with_sql("document_files", body=r"""
SELECT path,
  len(regexp_replace(substr(content, 1, 1024), '[^\p{Cc}]|[\n\r\t]', '', 'g')) / least(1024, len(content)) > 0.3
    AND regexp_matches(content, '\S') AS is_binary,
  len(content) >= 50 AND regexp_matches(content, '\S') AND
    len(regexp_replace(substr(content, 1, 100), '[^\p{L}\p{Nd}+/=]', '', 'g')) / least(100, len(content)) > 0.9
    AS is_base64
FROM document_files"""),
)
def content_sniffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("content")
    return mapped(spark, sf_dir, "document_files").select(
        "path", B.is_binary(content).alias("is_binary"), B.is_base64(content).alias("is_base64")
    )


@query(
    "B7", "G7",
    sql=with_sql("document_files", body="""
SELECT run_id, entry_index, path FROM document_files
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY entry_index, path) <= 30"""),
)
def first_files_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = mapped(spark, sf_dir, "document_files").select("run_id", "entry_index", "path")
    return B.first_files(files, 30)


@query(
    "B10",
    sql=with_sql("repositories", body="""
SELECT id, CASE WHEN url IS NULL OR trim(url) = '' THEN 'REPO_URL_REQUIRED'
  WHEN NOT regexp_matches(url, '(?i)^(https?|ftp)://') THEN 'REPO_URL_INVALID'
  WHEN branch = '' THEN 'BRANCH_REQUIRED' END AS error_code
FROM (SELECT id, CASE WHEN id % 17 = 0 THEN '  ' ELSE clone_url END AS url,
        CASE WHEN id % 19 = 0 THEN '' ELSE 'main' END AS branch FROM repositories)"""),
)
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = mapped(spark, sf_dir, "repositories").selectExpr(
        "id",
        "CASE WHEN id % 17 = 0 THEN '  ' ELSE clone_url END AS repo_url",
        "CASE WHEN id % 19 = 0 THEN '' ELSE 'main' END AS branch",
    )
    return B.checked_requests(requests).select("id", "error_code")


@query(
    "B19",
    sql=with_sql("code_files", "page_files", body="""
SELECT path, CASE WHEN e IN ('js', 'jsx', 'ts', 'tsx') THEN 'script' WHEN e IN ('html', 'css') THEN 'markup'
  WHEN e IN ('json', 'yml', 'yaml', 'xml') THEN 'data' WHEN e = 'php' THEN 'php' WHEN e = 'py' THEN 'python'
  WHEN e IN ('png', 'jpg', 'jpeg', 'svg') THEN 'image' ELSE 'other' END AS class
FROM (SELECT path, lower(list_last(string_split(path, '.'))) AS e
      FROM (SELECT path FROM code_files UNION ALL SELECT path FROM page_files))"""),
)
def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = mapped(spark, sf_dir, "code_files").select("path").unionByName(
        mapped(spark, sf_dir, "page_files").select("path")
    )
    return paths.select("path", file_class(F.col("path")).alias("class"))
