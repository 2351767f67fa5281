"""Quality rules from tokeniser fertility.

A public vocabulary that was made from ordinary text spends few tokens on ordinary text.
Characters per token, the share of tokens that spell single bytes, and the entropy of the
document's tokens fall outside a band where a text is noise, a broken encoding or one
thing over and over. Bands belong to a language or, failing that, to a script.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.llm.bpe import Cache, vocabulary
from codegauge.llm.tables import in_batches, once_in_worker, written

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "
ASCII_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Band:
    """What a clean text of one language or script keeps to; entropy counts in bits."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float


# Scripts by their first and last code point, and the bands by script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF),),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "indic": ((0x900, 0xDFF),),
    "han": ((0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
BANDS = {
    "latin": Band(1.6, 8.0, 0.25, 3.5),
    "greek": Band(0.6, 8.0, 0.5, 3.0),
    "cyrillic": Band(1.0, 8.0, 0.3, 3.5),
    "hebrew": Band(0.4, 8.0, 0.9, 3.0),
    "arabic": Band(0.4, 8.0, 0.9, 3.0),
    "indic": Band(0.2, 8.0, 1.0, 3.0),
    "han": Band(0.25, 8.0, 1.0, 3.0),
    "hangul": Band(0.25, 8.0, 1.0, 3.0),
    "other": Band(0.2, 8.0, 1.0, 3.0),
}
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string"
)
# Corpus bands: reach in deviations, least deviation as a share of the median, the number of
# texts whose weight the fixed band of the script has beside them, bands sent to all tasks.
WIDTH, LEAST, PRIOR, SENT = 5.0, 0.02, 100, 20_000


@once_in_worker
def pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = np.flatnonzero([model.is_byte(i) for i in range(model.get_piece_size())])
    return model, spelled, Cache(150_000)


def word_tokens(words: set[bytes], path: str) -> dict[bytes, bytes]:
    """Ids of each word as little-endian 32-bit numbers, cached in the worker."""
    model, _, cache = pieces(path)
    known, missing = {}, []
    for w in words:
        got = cache.new.get(w)
        if got is None and (got := cache.old.get(w)) is not None:
            cache.put(w, got)
        if got is None:
            missing.append(w)
        else:
            known[w] = got
    ids = model.encode([w.decode() for w in missing], num_threads=1) if missing else []
    for w, i in zip(missing, ids, strict=True):
        known[w] = array("I", i).tobytes()
        if len(w) <= 64:
            cache.put(w, known[w])
    return known


_EDGES = sorted({e for ranges in SCRIPTS.values() for a, b in ranges for e in (a, b + 1)})
_OWNER = [next((s for s, ranges in SCRIPTS.items() if any(a <= e <= b for a, b in ranges)), "other") for e in _EDGES]


def script_of(text: str) -> str:
    """The script with most of the text's letters; ``other`` where none of the listed has one.

    Of equal scripts the first listed is taken; ASCII marks and digits belong to none.
    """
    plain = text.encode("ascii", "ignore")
    counts = dict.fromkeys(SCRIPTS, 0)
    counts["latin"] += len(plain) - len(plain.translate(None, ASCII_LETTERS))
    if len(plain) < len(text):
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        at = np.searchsorted(_EDGES, code[code > 0x7F], side="right") - 1
        for k, n in enumerate(np.bincount(at, minlength=len(_EDGES))):
            if _OWNER[k] in counts:
                counts[_OWNER[k]] += int(n)
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words found at least twice."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 20:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1]
        key = np.unique(pair * distinct + ids[2:], return_inverse=True)[1]
    order = key.argsort()
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key), np.bool_)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marked = np.zeros(len(ids), np.bool_)
    for k in range(3):
        marked[k : k + len(twice)] |= twice
    return int(marked.sum())


def measure(text: str, words: list[bytes], tokens: dict[bytes, bytes], spelled: np.ndarray) -> tuple:
    """One row of ``MEASURES`` for a text."""
    n = len(words)
    word_chars = len(text) - sum(text.count(b) for b in BLANKS)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    index: dict[bytes, int] = {}
    for w in words:
        if w not in index:
            index[w] = len(index)
    repeated = repeated_words(np.array([index[w] for w in words], np.int64), max(1, len(index)))
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    found = np.frombuffer(b"".join([tokens[w] for w in words]), "<u4")
    counts = np.bincount(found, minlength=1 + int(spelled[-1]))
    share = counts[counts > 0] / max(1, len(found))
    entropy = float(-(share * np.log2(share)).sum()) + 0.0 if len(found) else 0.0
    by_token = word_chars / len(found) if len(found) else 0.0
    by_byte = float(counts[spelled].sum()) / max(1, len(found))
    symbols = sum(text.count(s) for s in SYMBOLS)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, failed, len(found), by_token, by_byte, entropy, script_of(text)


def measured(docs: DataFrame, columns: list[str] | None = None, path: str | None = None) -> DataFrame:
    """A struct ``row`` of the given columns (all, if left out) and ``MEASURES`` of every whole text.

    Words are runs of anything but blank, tab, newline, vertical tab, form feed and return.
    A null or empty text has no words. Extra columns, whatever their names, only travel in
    ``row``. ``band`` is the language where the table names one, else the script. A text that
    is in ``row`` is read from there, so that it is sent to the workers once.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    columns = docs.columns if columns is None else columns
    held = [k for k, c in enumerate(columns) if c.lower() == "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    rows = docs.select(row, lang.alias("lang"), *([] if held else [F.col("text").alias("text")]))
    names = [c.split()[0] for c in MEASURES.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64()] + [pa.float64()] * 3 + [pa.string()]

    def run(batches):
        place = path or vocabulary("piece_bpe_32k.model")
        spelled = pieces(place)[1]
        for batch in batches:
            sent = batch.column(0).field(held[0]) if held else batch.column(2)
            texts = [t or "" for t in sent.to_pylist()]
            words = [t.encode().split() for t in texts]
            tokens = word_tokens(set().union(*words), place)
            got = [measure(t, w, tokens, spelled) for t, w in zip(texts, words, strict=True)]
            arrays = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]
            band = pa.array([g or m[-1] for g, m in zip(batch.column(1).to_pylist(), got, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, band], ["row", *names, "band"])

    return in_batches(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, {MEASURES}, band string")


def corpus_bands(rows: DataFrame) -> DataFrame:
    """(band, n, low_chars, high_chars, low_entropy) of every language or script, from its n texts.

    A band reaches ``WIDTH`` robust deviations (from the quartiles) to either side of the
    median over all texts that pass the base rule; equal values count once, so that copies of
    one text do not narrow it, and a deviation is at least ``LEAST`` of the median.
    """
    distinct = rows.where(~F.col("base_failed")).select("band", "chars_per_token", "token_entropy").distinct()
    quart = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = distinct.groupBy("band").agg(F.count("*").alias("n"), quart("chars_per_token").alias("c"), quart("token_entropy").alias("e"))

    def reach(q: str, a: int, b: int):
        return WIDTH * F.greatest((F.col(q)[b] - F.col(q)[a]) / 0.6745, LEAST * F.col(q)[1])

    return got.select(
        "band",
        "n",
        (F.col("c")[1] - reach("c", 0, 1)).alias("low_chars"),
        (F.col("c")[1] + reach("c", 1, 2)).alias("high_chars"),
        (F.col("e")[1] - reach("e", 0, 1)).alias("low_entropy"),
    )


def with_verdict(rows: DataFrame, fixed: dict[str, Band] | None = None) -> DataFrame:
    """Adds ``kept`` to the rows of ``measured``, which should be a written table.

    A text is kept if it passes the base rule and lies in the fixed band of its script and in
    its own: the limits of its language's or script's corpus band and those of the fixed band,
    averaged with weights n and ``PRIOR``. Few texts thus narrow the fixed band little, and no
    number of texts switches from one to the other. Up to ``SENT`` bands are sent to the
    tasks, so no text is shuffled; more are joined.
    """
    fixed = fixed or BANDS
    limit = {name: F.lit(None).cast("double") for name in Band.__dataclass_fields__}
    for script, b in fixed.items():
        limit = {k: F.when(F.col("script") == script, F.lit(getattr(b, k))).otherwise(c) for k, c in limit.items()}
    low, high, least = limit["min_chars_per_token"], limit["max_chars_per_token"], limit["min_entropy"]
    weight = F.coalesce(F.col("n_band") / (F.col("n_band") + PRIOR), F.lit(0.0))

    def between(own: str, given: Column) -> Column:
        return weight * F.coalesce(own, F.lit(0.0)) + (1 - weight) * given

    good = F.col("chars_per_token").between(low, high) & (F.col("token_entropy") >= least)
    good &= F.col("byte_share") <= limit["max_byte_share"]
    good &= F.col("chars_per_token").between(between("low_chars", low), between("high_chars", high))
    good &= F.col("token_entropy") >= between("low_entropy", least)
    bands = written(corpus_bands(rows).withColumnRenamed("n", "n_band"), "bands")
    if bands.count() <= SENT:
        bands = F.broadcast(bands)
    joined = rows.join(bands, "band", "left")
    kept = ~F.col("base_failed") & F.coalesce(good, F.lit(False))
    return joined.withColumn("kept", kept).drop("n_band", "low_chars", "high_chars", "low_entropy")


def rate_quality(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, measures, band, kept) of every document; repeated rows are answered one by one."""
    rows = written(measured(docs, ["doc_id"], path), "quality")
    return with_verdict(rows).select(F.col("row.doc_id").alias("doc_id"), "*").drop("row")


def good_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents that are kept, with all their columns."""
    rows = written(measured(docs, None, path), "quality-docs")
    return with_verdict(rows).where("kept").select("row.*")
