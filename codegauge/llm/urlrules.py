"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names the literal tokens that any URL it matches must hold. The tokens are
counted over all URLs, each rule is filed under its rarest one, the tokens of a URL fetch
the rules filed under them, and only those rules run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.llm.tables import written

BROADCAST_RULES = 20_000
LONGEST_PATTERN = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is searched in host + path; every match holds all ``literals`` as whole tokens.

    Tokens are runs of a-z and 0-9 in the lower-cased host and path. Of the rules that match,
    the one with the highest weight decides, then the name that sorts last.
    """

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    weight: int
    shown: bool = True


def host_rule(rule: str, verdict: str) -> UrlRule:
    """``example.com/en/``: that host and its subdomains, paths that begin so; longest wins."""
    host, _, path = rule.partition("/")
    host, path = host.translate(str.maketrans(UPPER, LOWER)), "/" + path
    tokens = re.findall("[a-z0-9]+", host)
    # the last token of a path that ends inside a token may go on in the url
    inside = re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return UrlRule(rule, verdict, pattern, tuple(dict.fromkeys(tokens + inside)), 1000 + len(rule))


def word_rule(word: str, verdict: str = "block") -> UrlRule:
    """URLs that hold ``word`` as a whole label of the host or segment of the path."""
    return UrlRule(word, verdict, rf"(?:^|[./]){re.escape(word)}(?:[./]|$)", (word,), len(word), shown=False)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    then up to ``?``, ``#`` or the end. Both empty for null or without ``://``."""
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow") -> DataFrame:
    """Judges every URL of ``pages`` (page_id, url).

    Returns (page_id, host, path, rule, verdict, matched): ``matched`` is the name of the rule
    that decided, ``rule`` the same where the rule is a shown one, ``verdict`` that rule's or
    ``default``. Rules without literals would have to run on every URL and are refused. URLs
    that are null or have no ``://`` have empty parts and get the default. Repeated rows are
    answered one by one; other columns are not looked at.
    """
    spark = pages.sparkSession
    for r in rules:
        if not r.literals:
            raise ValueError(f"rule {r.name} has no literal token")
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        none = F.lit(None).cast("string")
        return parts.select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"), none.alias("matched"))
    # equal addresses are judged once
    urls = written(parts.groupBy("host", "path").count().drop("count"), "urls")
    tokens = F.array_distinct(F.expr("regexp_extract_all(lower(concat(host, path)), '([a-z0-9]+)', 1)"))
    held = urls.select("host", "path", F.explode(tokens).alias("token"))
    table = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, list(r.literals), r.weight, r.shown) for i, r in enumerate(rules)],
        "rule_no int, name string, verdict string, pattern string, literals array<string>, weight int, shown boolean",
    )
    small = len(rules) <= BROADCAST_RULES and all(len(r.pattern) <= LONGEST_PATTERN for r in rules)
    sized = F.broadcast if small else (lambda frame: frame)  # larger tables of rules are shuffled
    words = table.select(F.explode("literals").alias("token")).distinct()
    counts = held.join(sized(words), "token").groupBy("token").agg(F.count("*").alias("n"))
    filed = table.select("*", F.explode("literals").alias("token")).join(counts, "token", "left")
    index = filed.groupBy("rule_no").agg(
        F.min_by(F.struct("token", "name", "verdict", "pattern", "weight", "shown"), F.struct(F.coalesce("n", F.lit(0)), "token")).alias("r")
    ).select("r.*")
    hits = held.join(sized(index), "token").where(F.expr("rlike(concat(host, path), pattern)"))
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.struct("name", "verdict", "shown"), F.struct("weight", "name")).alias("best")
    )
    return parts.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.shown"), F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.name").alias("matched"),
    )
