"""Document fingerprints from improbable features.

Every window of ``WINDOW`` bytes has an entropy; entropies that are rare among all windows
of the corpus make a window improbable. A window that is the most improbable of its
neighbourhood often enough is a feature. Features go into Bloom filters, a new one being
chained on whenever one is full, and two chains are compared by the overlap of their bits
beyond what chance gives.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.bpe import id_type
from codegauge.llm.tables import in_batches, key_and_text

WINDOW = 64  # bytes of a feature, and windows of a neighbourhood
VOTES = 16  # neighbourhoods that a feature must win
LEVELS = 1000  # entropies are told apart in so many steps
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
PIECE = 1 << 17  # bytes looked at together
MARGIN = 4 * WINDOW
BUCKET_ROWS = 500
MOST_BUCKETS = 100_000
EDGE_STEPS = 10  # an edge may lie off by such a part of a bucket, which changes no row

_SCALE = 1 << 16
_MASS = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_GAIN = np.diff(_MASS).astype(np.int32)
_FULL = int(_MASS[WINDOW])


def entropies(text: np.ndarray) -> np.ndarray:
    """Entropy level (0 to LEVELS) of every window of the bytes.

    A window's entropy follows from the one before by the byte that leaves and the one that
    comes; how often those two occur among the bytes between is counted for all windows at
    once, distance by distance. Whole numbers throughout: equal windows have equal levels.
    """
    n = len(text) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    before, after = np.zeros(len(text), np.uint8), np.zeros(len(text), np.uint8)
    for d in range(1, WINDOW):
        same = (text[d:] == text[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    mass = np.empty(n, np.int64)
    mass[0] = _MASS[np.bincount(text[:WINDOW])].sum()
    mass[1:] = _GAIN[before[WINDOW:]] - _GAIN[after[: n - 1]]
    np.cumsum(mass, out=mass)
    return (_FULL - mass) * LEVELS // _FULL


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes after one another, and where each text ends."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def spans(size: int):
    """Pieces of a buffer with the bytes around them: (from, to, from with margin, to with margin)."""
    for a in range(0, size, PIECE):
        b = min(size, a + PIECE)
        yield a, b, max(0, a - MARGIN), min(size, b + MARGIN)


def inside(ends: np.ndarray, a: int, n: int) -> np.ndarray:
    """Which of the n windows from a on lie in one text."""
    at = np.arange(a, a + n)
    return ends[np.minimum(np.searchsorted(ends, at, side="right"), len(ends) - 1)] - at >= WINDOW


def level_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy level."""
    counts = np.zeros(LEVELS + 1, np.int64)
    buffer, ends = joined(texts)
    for a, b, lo, hi in spans(len(buffer)):
        level = entropies(buffer[lo:hi])
        good = inside(ends, lo, len(level))
        good[: a - lo] = False
        good[b - lo :] = False
        counts += np.bincount(level[good], minlength=LEVELS + 1)
    return counts


def features(buffer: np.ndarray, ends: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Places of the features: windows that win at least ``VOTES`` neighbourhoods."""
    found = []
    none = np.iinfo(np.int64).max
    for a, b, lo, hi in spans(len(buffer)):
        level = entropies(buffer[lo:hi])
        if not len(level):
            continue
        good = inside(ends, lo, len(level))
        least = np.where(good, rarity[level] << 20 | np.arange(len(level)), none)
        least = np.concatenate([least, np.full(WINDOW, none)])
        width = 1
        while width < WINDOW:  # the least of 1, 2, 4, ... windows from each on
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        won = least[: len(level)][good] & ((1 << 20) - 1)
        if len(won):
            start = np.flatnonzero(np.append(True, won[1:] != won[:-1]))
            votes = np.diff(np.append(start, len(won)))
            at = won[start][votes >= VOTES] + lo
            found.append(at[(at >= a) & (at < b)])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def mixed(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of 64-bit words."""
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h ^= words[:, k] * np.uint64(0xBF58476D1CE4E5B9)
        h = (h << np.uint64(29) | h >> np.uint64(35)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def fingerprints(texts: list[bytes], rarity: np.ndarray) -> list[np.ndarray]:
    """Each text's chain of filters, a row of bytes per filter.

    A text without a feature (under a few dozen bytes, say) enters its whole as the only one;
    an empty text has no filter.
    """
    buffer, ends = joined(texts)
    at = features(buffer, ends, rarity)
    hashes = np.zeros(0, np.uint64)
    if len(at):
        view = np.lib.stride_tricks.sliding_window_view(buffer, WINDOW)
        hashes = np.concatenate([mixed(view[at[k : k + 65536]].copy().view("<u8")) for k in range(0, len(at), 65536)])
    cut = np.searchsorted(at, ends)
    chains = []
    for k, text in enumerate(texts):
        own = hashes[cut[k - 1] if k else 0 : cut[k]]
        if not len(own):
            if not text:
                chains.append(np.zeros((0, FILTER_BITS // 8), np.uint8))
                continue
            own = np.frombuffer(hashlib.sha256(text).digest()[:8], "<u8")
        which = np.arange(len(own)) // FILTER_FEATURES * FILTER_BITS
        bits = np.zeros((which[-1] // FILTER_BITS + 1) * FILTER_BITS, np.uint8)
        for j in range(HASHES):
            bits[which + (own >> np.uint64(11 * j) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
        chains.append(np.packbits(bits).reshape(-1, FILTER_BITS // 8))
    return chains


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: mean over the shorter chain of the best overlap with a filter of the other.

    The overlap of two filters is their common bits beyond those that chance gives, as a share
    of the most that could be. Equal chains are 1 alike, also empty ones; an empty and another 0.
    """
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    best_a, best_b = np.zeros(len(a)), np.zeros(len(b))
    right = np.unpackbits(b, axis=1).astype(np.float32)
    n_b = right.sum(1)
    for k in range(0, len(a), 256):
        left = np.unpackbits(a[k : k + 256], axis=1).astype(np.float32)
        n_a = left.sum(1)[:, None]
        chance = n_a * n_b / FILTER_BITS
        most = np.minimum(n_a, n_b)
        share = np.clip((left @ right.T - chance) / np.maximum(most - chance, 1e-6), 0, 1)
        best_a[k : k + 256] = share.max(1)
        best_b = np.maximum(best_b, share.max(0))
    return float(best_a.mean()) if len(a) < len(b) else float((best_a.mean() + best_b.mean()) / 2)


def shown(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def chain_of(fingerprint: str) -> np.ndarray:
    """The filters of a fingerprint, for ``likeness``."""
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, FILTER_BITS // 8)


def learn_rarity(docs: DataFrame) -> list[int]:
    """The place of each entropy level among all levels, rarest first, over all windows of the texts.

    Of equally frequent levels the lower comes first.
    """

    def count(batches):
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            total += level_counts([t.encode() for t in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(range(LEVELS + 1), pa.int32()), pa.array(total)], ["level", "n"])

    counts = in_batches(key_and_text(docs).select("text"), count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    found = dict.fromkeys(range(LEVELS + 1), 0) | {r["level"]: r["n"] for r in counts.collect()}  # LEVELS rows
    order = sorted(found, key=lambda k: (found[k], k))
    place = [0] * (LEVELS + 1)
    for p, k in enumerate(order):
        place[k] = p
    return place


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a null text is empty."""
    rarity = learn_rarity(docs)

    def run(batches):
        table = np.array(rarity, np.int64)
        for batch in batches:
            got = fingerprints([t.encode() for t in batch.column(1).to_pylist()], table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shown(c) for c in got], pa.string())], ["doc_id", "fingerprint"])

    return in_batches(key_and_text(docs), run, f"doc_id {id_type(docs)}, fingerprint string")


def with_successor(docs: DataFrame, fn, schema: str) -> DataFrame:
    """Runs ``fn`` over batches of (bucket, guest, doc_id, text) in which each document is followed by the next.

    Documents are ordered by id, then text; nulls come first. They are cut into buckets of
    neighbouring ids, and the first document of each bucket is also sent, as a guest, behind
    the last one of the bucket before (the very first behind the very last).
    """
    rows = key_and_text(docs).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    n = rows.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    edges = []
    if buckets > 1:
        # one constant, however many buckets: percentile_approx takes no computed list
        shares = F.split(F.lit(",".join(str(k / buckets) for k in range(1, buckets))), ",").cast("array<double>")
        edges = rows.agg(F.percentile_approx("key", shares, EDGE_STEPS * buckets).alias("e")).first()["e"] or []
    edges = sorted(set(edges))

    @F.pandas_udf("int")
    def bucket_of(key):
        import pandas as pd

        return pd.Series(np.searchsorted(np.array(edges, np.int64), key.to_numpy(), side="right").astype(np.int32))

    rows = rows.withColumn("bucket", bucket_of("key") if edges else F.lit(0))
    first = {r["bucket"]: r["key"] for r in rows.groupBy("bucket").agg(F.min("key").alias("key")).collect()}  # a row per bucket
    filled = sorted(first)
    host = {b: filled[k - 1] for k, b in enumerate(filled)}  # the bucket before; before the first, the last
    guests = docs.sparkSession.createDataFrame([(first[b], host[b]) for b in filled], "first_key long, host int")
    own = rows.select("bucket", F.lit(False).alias("guest"), "doc_id", "text", "key")
    sent = rows.join(F.broadcast(guests), rows["key"] == guests["first_key"]).select(
        F.col("host").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text", "key"
    )
    dealt = own.unionByName(sent).repartition("bucket").sortWithinPartitions("bucket", "guest", "key", "text")
    return in_batches(dealt.drop("key"), fn, schema)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by the
    first as many (or all) of the next document. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty; rows with
    equal ids follow one another by text; a single document follows itself.
    """
    rarity = learn_rarity(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    id_kind = id_type(docs)

    def run(batches):
        table = np.array(rarity, np.int64)
        last: list[tuple] = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            prints = fingerprints([t.encode() for t in columns[3]], table)
            rows = last + list(zip(*columns, prints, strict=True))
            last = rows[-1:]
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0] and not x[1]]
            texts = [(x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2]).encode() for x, y in pairs]
            edited = fingerprints(texts, table)
            out = [
                (x[2], len(x[3]), hashlib.sha256(t).hexdigest(), shown(x[4]), shown(e), likeness(x[4], e), likeness(x[4], y[4]))
                for (x, y), t, e in zip(pairs, texts, edited, strict=True)
            ]
            kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    schema = f"doc_id {id_kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successor(docs, run, schema)
