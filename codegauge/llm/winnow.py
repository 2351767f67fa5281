"""Benchmark passages in training texts, found by winnowed fingerprints.

A passage counts as shared when ``SPAN`` words in a row are equal, or all words of a shorter
item. Of every ``SPAN - GRAM + 1`` grams in a row, which is what such a passage holds, the
one with the least hash is a fingerprint, in items and documents alike, so each shared passage
has a fingerprint in common. Fingerprints of documents that a bit table of the items' ones
(of fixed size) lets through are joined with those of the items; a hit is then extended by
every passage-long window around it, which is joined with the items' windows. A window that
many items hold is one row until the last step, which names the items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegauge.llm.bpe import id_type
from codegauge.llm.tables import drop_written, in_batches, key_and_text, written
from codegauge.llm.wordbytes import ByteWords, runs

SPAN = 10  # words that a passage has at least
BITS = 1 << 24
NONE = np.uint64(np.iinfo(np.uint64).max)


def letters() -> np.ndarray:
    """A-Z count as a-z; these, digits and every byte of other characters are words."""
    out = np.full(256, -1)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or c.isdigit() or "a" <= c <= "z":
            out[b] = b
        elif "A" <= c <= "Z":
            out[b] = ord(c.lower())
    return out


def gram_of(span: int) -> int:
    """Words of a fingerprint for passages of ``span`` words; the others are its window."""
    return (span + 1) // 2


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the grams that are the least of some ``window`` in a row."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for k in range(1, window):
        np.minimum(least, grams[k : k + n], out=least)
    most = np.zeros(len(grams), np.uint64)  # the greatest of the minima of the windows around a gram
    for k in range(window):
        np.maximum(most[k : k + n], least, out=most[k : k + n])
    return np.flatnonzero((most == grams) & (grams != NONE))


def fingerprints(hashes: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of texts laid after one another: place of the first word, hash, and all windows.

    ``ends`` says where each text's words end. Grams and windows that run over an end have no
    hash (``NONE``), so fingerprints beside an end are a few more than needed.
    """
    gram = gram_of(span)
    out = []
    for length in (gram, span):
        got = runs(hashes, length)
        starts = np.unique(np.concatenate([[0], ends]))
        for k in range(1, length):
            at = starts[1:-1] - k  # the first k words of a run lie before an end
            got[at[(at >= 0) & (at < len(got))]] = NONE
        out.append(got)
    grams, windows = out
    at = winnowed(grams, span - gram + 1)
    return at, grams[at], windows


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(item_id, span, window, prints) of every window of every item, repeated ones included.

    ``prints`` are the fingerprints of the window. An item of fewer words than ``span`` is one
    window with the span of its length; one without words has none.
    """
    source = key_and_text(benchmark, item, text)

    def run(batches):
        words = ByteWords(letters())
        for batch in batches:
            hashes, ends = words.of(batch.column(1))
            rows: list[list] = [[], [], [], []]
            for key, a, b in zip(batch.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                own = min(span, b - a)
                if not own:
                    continue
                at, prints, windows = fingerprints(hashes[a:b], np.array([b - a]), own)
                reach = own - gram_of(own) + 1  # a window holds the prints at its first so many places
                for k, w in enumerate(windows):
                    held = prints[np.searchsorted(at, k) : np.searchsorted(at, k + reach)]
                    for to, value in zip(rows, (key, own, w.view(np.int64), held.view(np.int64).tolist()), strict=True):
                        to.append(value)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.list_(pa.int64())]
            names = ["item_id", "span", "window", "prints"]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    return in_batches(source, run, f"item_id {id_type(benchmark, item)}, span int, window long, prints array<long>")


def bit_table(values: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A table of ``bits`` bits, those of the column's longs set; at most ``bits / 64`` rows are collected."""
    low = F.col(column).bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (low % 64).cast("int"))
    found = values.select((low / 64).cast("int").alias("word"), one.alias("b")).groupBy("word").agg(F.bit_or("b").alias("b"))
    table = np.zeros(bits // 64, np.int64)
    for r in found.collect():
        table[r["word"]] = r["b"]
    return table


def suspicious(docs: DataFrame, spans: list[int], table: np.ndarray) -> DataFrame:
    """(row_no, doc_id, n_words, hits) of every document.

    ``hits`` are the fingerprints that the bit table lets through, each with its span, its
    hash, and start and hash of the windows that hold it.
    """
    sent = docs.sparkSession.sparkContext.broadcast((spans, table))
    hit = "array<struct<span:int,print:long,at:array<int>,windows:array<long>>>"
    hit_type = pa.struct([("span", pa.int32()), ("print", pa.int64()), ("at", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64()))])

    def run(batches):
        spans, table = sent.value
        words = ByteWords(letters())
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            hashes, ends = words.of(batch.column(1))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            for span in spans:
                if len(hashes) < span:
                    continue
                at, prints, windows = fingerprints(hashes, ends, span)
                low = (prints & np.uint64(len(table) * 64 - 1)).astype(np.int64)
                passed = (table[low >> 6] >> (low & 63)) & 1 == 1
                at, prints = at[passed], prints[passed].view(np.int64)
                texts = np.searchsorted(ends, at, side="right")
                back = span - gram_of(span)
                for k, value, text in zip(at.tolist(), prints.tolist(), texts.tolist(), strict=True):
                    a = max(k - back, int(starts[text]))
                    around = windows[a : max(a, min(k, int(ends[text]) - span) + 1)]
                    begin = a - int(starts[text])
                    found[text].append(
                        {"span": span, "print": value, "at": list(range(begin, begin + len(around))), "windows": around.view(np.int64).tolist()}
                    )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(number, number + batch.num_rows), pa.int64()), batch.column(0),
                    pa.array((ends - starts).astype(np.int64)), pa.array(found, pa.list_(hit_type)),
                ],
                ["row_no", "doc_id", "n_words", "hits"],
            )
            number += batch.num_rows

    return in_batches(key_and_text(docs), run, f"row_no long, doc_id {id_type(docs)}, n_words long, hits {hit}")


def shared_passages(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What documents share with benchmark items, as three tables.

    The documents (row_no, doc_id, n_words, …), one row each; the windows found in them
    (row_no, start, span, window), one row per place; the items' windows (window, span,
    item_id), one row per item and window. Null texts are empty ones and have no words;
    repeated rows of documents are answered one by one, repeated items are one; columns other
    than the id and the text are not looked at. Exact up to equal 64-bit hashes of different
    passages.
    """
    items = written(item_windows(benchmark, span=span), "windows")
    prints = written(items.select("span", F.explode("prints").alias("print")).distinct(), "prints")
    spans = sorted(r["span"] for r in prints.select("span").distinct().collect())  # at most `span` rows
    read = written(suspicious(docs, spans, bit_table(prints, "print")), "suspicious")
    hits = read.select("row_no", F.explode("hits").alias("h")).select(
        "row_no", F.col("h.span").alias("span"), F.col("h.print").alias("print"), F.col("h.at").alias("at"), F.col("h.windows").alias("windows")
    )
    shared = hits.join(prints, ["span", "print"], "left_semi")
    around = shared.select("row_no", "span", F.explode(F.arrays_zip("at", "windows")).alias("w"))
    around = around.select("row_no", "span", F.col("w.at").alias("start"), F.col("w.windows").alias("window"))
    known = items.select("span", "window").distinct()
    found = written(around.join(known, ["span", "window"], "left_semi").distinct(), "found")
    drop_written([prints])
    return read.drop("hits"), found, items.select("window", "span", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    ``n_hit`` counts the words inside any shared window, ``n_items`` the items with such a
    window, ``items_sha256`` is the hash of their ids, sorted as strings and joined by commas
    (of the empty string without any). An item with a null id marks words but is not counted.
    An empty benchmark hits nothing; an empty table gives no rows.
    """
    read, found, windows = shared_passages(docs, benchmark, span)
    # words in the union of the windows: each adds what lies behind the ends of those before it
    ordered = Window.partitionBy("row_no").orderBy("start", "span").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("span")
    behind = F.greatest("start", F.coalesce(F.max(end).over(ordered), F.lit(0)))
    hit = found.select("row_no", F.greatest(end - behind, F.lit(0)).alias("new")).groupBy("row_no").agg(F.sum("new").cast("long").alias("n_hit"))
    # each window once per document, then each item once
    named = found.select("row_no", "span", "window").distinct().join(windows, ["span", "window"])
    named = named.where(F.col("item_id").isNotNull()).select("row_no", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("row_no").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("ids"))
    rows = read.join(hit, "row_no", "left").join(named, "row_no", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
