"""The operators over the given tables, one query each, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm.alignment import alignment
from codegauge.llm.bpe import encoded
from codegauge.llm.digest import edited_likeness
from codegauge.llm.jaccard import similar_groups
from codegauge.llm.langid import identify, learn_profiles
from codegauge.llm.lengths import encoded_lengths, length_table
from codegauge.llm.lm import score
from codegauge.llm.packing import pack
from codegauge.llm.quality import rate_quality
from codegauge.llm.spelling import DAMAGED, LEAST_COUNT, LEAST_LETTERS, spelling_variants
from codegauge.llm.tables import fold_of
from codegauge.llm.toxicity import toxicity
from codegauge.llm.urlrules import host_rule, judge_urls, word_rule
from codegauge.llm.winnow import SPAN, contamination
from codegauge.sources.tables import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


@query()
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 10) != 0)


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity(docs, labels, lambda key: fold_of(key, 4) == 2)


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(encoded_lengths(read_table(spark, sf_dir, "documents")))


# Fixed values of the query: rules by host and path, and words of advertising and tracking hosts.
HOST_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
BLOCKED_WORDS = ("ads", "adserver", "banner", "doubleclick", "popup", "tracker", "tracking")

_HOST_SQL = " ".join(
    f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'"
    for r, _ in sorted(HOST_RULES, key=lambda r: -len(r[0]))
)
_WORDS_SQL = "|".join(BLOCKED_WORDS)
OP4_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (SELECT page_id, coalesce(host, '') AS host, path, CASE {_HOST_SQL} END AS rule,
    regexp_extract(concat(host, path), '(?:^|[./])({_WORDS_SQL})(?:[./]|$)', 1) AS word FROM parts)
SELECT page_id, host, path, rule,
    CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in HOST_RULES)} WHEN word <> '' THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


@query(OP4_SQL)
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_rule(r, v) for r, v in HOST_RULES] + [word_rule(w) for w in BLOCKED_WORDS]
    return judge_urls(read_table(spark, sf_dir, "pages"), rules).drop("matched")


@query()
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(read_table(spark, sf_dir, "documents"))


@query()
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read_table(spark, sf_dir, "documents"), size=3, percent=90)


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_quality(read_table(spark, sf_dir, "documents"))


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents"))


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    profiles = learn_profiles(docs.where(~held_out))
    return identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id, {_WORDS} AS w FROM benchmark),
dp AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
ip AS (SELECT r, item_id, least({SPAN}, len(w)) AS s, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM i),
iw AS (SELECT item_id, s, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING) AS ws FROM ip),
items AS (SELECT DISTINCT item_id, s, array_to_string(ws[1:s], ' ') AS win FROM iw WHERE len(ws) >= s),
dw AS (SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING) AS ws FROM dp),
ranges AS (SELECT DISTINCT s FROM items),
f AS (SELECT r, p, s, item_id FROM (SELECT r, p, s, array_to_string(ws[1:s], ' ') AS win FROM dw, ranges WHERE len(ws) >= s) JOIN items USING (s, win)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + s)) AS q FROM f) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM f WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""


@query(OP11_SQL)
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query()
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read_table(spark, sf_dir, "documents"))


def _crc32_table() -> list[int]:
    """What crc32 makes of each byte, by its rule: eight shifts, with the polynomial where a bit falls out."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


_BYTES = "list_transform(range(1, octet_length(b) + 1), lambda i: (instr('0123456789ABCDEF', hex(b)[2*i-1]) - 1) * 16 + instr('0123456789ABCDEF', hex(b)[2*i]) - 1)"
OP13_SQL = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT run, c, {_BYTES} AS bs FROM (SELECT run, c, encode(concat(doc_id::VARCHAR, ':', run)) AS b FROM counted)),
hashed AS (SELECT run, c, xor(list_reduce(list_concat([4294967295::BIGINT], bs),
    lambda a, x: xor(a >> 8, ({_crc32_table()}::BIGINT[])[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes),
words AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word,
    sum(c)::BIGINT AS n FROM hashed GROUP BY 1 HAVING sum(c) >= {LEAST_COUNT} AND length(word) >= {LEAST_LETTERS}),
cut AS (SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS (SELECT x.word AS word, y.word AS other FROM cut x JOIN cut y ON x.rest = y.rest AND x.k = y.k AND x.word <> y.word
    UNION SELECT x.word, w.word FROM cut x JOIN words w ON w.word = x.rest
    UNION SELECT w.word, x.word FROM cut x JOIN words w ON w.word = x.rest),
ranked AS (SELECT near.word, other, w.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS k FROM near JOIN words w ON w.word = other),
forms AS (SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
    FROM words LEFT JOIN ranked ON ranked.word = words.word AND k = 1),
path(word, last_word) AS (SELECT word, word FROM forms UNION ALL SELECT path.word, form FROM path JOIN forms ON forms.word = path.last_word WHERE form IS NOT NULL)
SELECT forms.word, forms.n, forms.n_near, forms.form, forms.form_n, path.last_word AS root
FROM forms JOIN path ON path.word = forms.word JOIN forms stop ON stop.word = path.last_word AND stop.form IS NULL"""


@query(OP13_SQL)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))
