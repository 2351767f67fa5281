"""Metric samples as text lines, and keep/replace rules on their labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_line(name: Column, labels: Column, value: Column) -> Column:
    """``name{label="v",...} value``; without braces where there are no labels."""
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)),
        lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')),
    )
    braces = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
    return F.concat(name, F.coalesce(braces, F.lit("")), F.lit(" "), value)


def to_text(samples: DataFrame, help_texts: Mapping[str, str], types: Mapping[str, str]) -> DataFrame:
    """Samples (name, labels, value as text) to lines with HELP and TYPE lines first.

    Rows carry (name, part, line); sorted by all three they form the document.
    """
    lines = samples.select(
        "name", F.lit(2).alias("part"), sample_line(F.col("name"), F.col("labels"), F.col("value")).alias("line")
    )
    names = samples.select("name").distinct()

    def described(texts: Mapping[str, str]) -> Column:
        column = F
        for name, text in texts.items():
            column = column.when(F.col("name") == name, text)
        return column.otherwise("")

    heads = names.select(
        "name",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), F.concat(F.lit("# HELP "), "name", F.lit(" "), described(help_texts)).alias("line")),
                F.struct(F.lit(1).alias("part"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), described(types)).alias("line")),
            )
        ).alias("h"),
    ).select("name", "h.part", "h.line")
    return heads.unionByName(lines)


def write_text(lines: DataFrame, folder: str) -> None:
    """The document as one sorted text; its size follows the number of label sets."""
    lines.orderBy("name", "part", "line").select("line").coalesce(1).write.mode("overwrite").text(folder)


def keep_names(samples: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """Samples whose name fully matches a pattern."""
    return samples.where(F.rlike(F.col(column), F.lit(f"^(?:{pattern})$")))


def relabel(
    samples: DataFrame,
    action: str,
    sources: Sequence[str],
    pattern: str = "(.*)",
    target: str | None = None,
    replacement: str = "$1",
    separator: str = ";",
) -> DataFrame:
    """One relabel step on the labels map: keep, drop or replace.

    The source label values (missing ones are empty) are joined by the separator
    and must fully match the pattern.
    """
    values = [F.coalesce(F.col("labels")[s], F.lit("")) for s in sources]
    joined = F.concat_ws(separator, *values)
    whole = f"^(?:{pattern})$"
    matched = F.rlike(joined, F.lit(whole))
    if action == "keep":
        return samples.where(matched)
    if action == "drop":
        return samples.where(~matched)
    if action != "replace" or target is None:
        raise ValueError("action is keep, drop, or replace with a target")
    new = F.regexp_replace(joined, whole, replacement)
    others = F.map_filter("labels", lambda k, _: k != target)
    return samples.withColumn(
        "labels",
        F.when(matched, F.map_concat(others, F.create_map(F.lit(target), new))).otherwise(
            F.col("labels")
        ),
    )
