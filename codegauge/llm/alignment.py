"""Alignment of two tokenizers over a corpus: which tokens end together, and how often.

Texts are cut before blanks at which neither tokenizer joins, so most of them are repeated
words whose tokens and groups are looked up. What the words link is counted outside memory.
Each task sorts its (pair of ids, document) records and radix-partitions them by the second
tokenizer's id into compressed runs. The runs' pair counts are merged with a heap, side by
side in the order of that id, so an id's pairs and their maximum are complete together. Then
the runs' records stream past the merged counts of their partition and what they earn goes
back to their documents. A partition with many records is spread over several tasks, each of
which gets its counts; runs are merged ``FAN`` at a time, in as many levels as they need.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.bpe import SPACE, Cache, byte_bpe, id_type, vocabulary
from codegauge.llm.tables import drop_written, in_batches, key_and_text, written

PARTS = 64  # partitions by the low bits of the second id
RECORDS = 1_000_000  # a run is written when it has so many records
FAN = 64  # runs merged together
SHARE = 64 << 20  # bytes of runs that one task streams
CACHED, CACHED_LETTERS = 200_000, 48
ID_BITS, DOC_BITS = 22, 19
ID_MASK, DOC_MASK = (1 << ID_BITS) - 1, (1 << DOC_BITS) - 1
RADIX_BITS = PARTS.bit_length() - 1


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as compressed 64-bit numbers; the first, ascending one as steps."""
    first, *rest = (np.asarray(a, np.int64) for a in arrays)
    parts = [np.diff(first, prepend=0), *rest]
    # bytes of equal weight lie together, so the many zeros cost next to nothing
    data = b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(-1, 8).T).tobytes() for p in parts)
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    """The ``n`` arrays of ``packed``."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = len(raw) // (8 * n)
    out = [np.ascontiguousarray(raw[8 * size * k : 8 * size * (k + 1)].reshape(8, size).T).view(np.int64).ravel() for k in range(n)]
    return [np.cumsum(out[0]), *out[1:]]


def pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number per pair of ids: first the radix of b, then the rest of b, then a."""
    side = (b & (PARTS - 1)) << (ID_BITS - RADIX_BITS) | b >> RADIX_BITS
    return side << ID_BITS | a


class Aligner:
    """Both encoders, and a bounded cache of cut-out words with their tokens and groups."""

    def __init__(self, first: str, second: str) -> None:
        import sentencepiece

        self.first = byte_bpe(first)
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        size = self.second.get_piece_size()
        names = [self.second.id_to_piece(i) for i in range(size)]
        self.pieces = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)
        ]
        self.sizes_a = np.array(list(map(len, self.first.tokens)), np.int64)
        self.sizes_b = np.array(list(map(len, self.pieces)), np.int64)
        #: an id of A before a comma and before a bar, of B before a comma and before a semicolon
        self.signs = [f"{i}{sign}".encode() for ids, end in ((self.first.tokens, "|"), (self.pieces, ";")) for i in range(len(ids)) for sign in (",", end)]
        self.signs_b = 2 * len(self.first.tokens)
        self.blank = self.second.piece_to_id("▁")
        #: no piece goes on over a blank, so texts may be cut before one
        self.cuts = all("▁" not in p[1:] or not p.strip("▁") for p in names)
        self.cache = Cache(CACHED)
        self._odd = re.compile(rf"\A |[{SPACE}] | \Z")
        self._cut = re.compile(rf"(?<=[^{SPACE}])(?= )")

    def cut(self, text: str) -> list[str]:
        """A blank and the text, cut before blanks that follow no white space."""
        if not self.cuts:
            return [" " + text]
        if self._odd.search(text):
            return self._cut.split(" " + text)
        return [" " + p for p in text.split(" ")]

    def aligned(self, pieces: list[str]) -> list[tuple | None]:
        """Per piece: its groups as text, tokens of both, and its links; None if bytes are not kept."""
        if not pieces:
            return []
        words = [self.first.words(p) for p in pieces]
        order = list({w for some in words for w in some})
        ids = dict(zip(order, self.first.merge([w.encode() for w in order]), strict=True))
        ours = [ids[some[0]] if len(some) == 1 else b"".join([ids[w] for w in some]) for some in words]
        theirs = self.second.encode([p[1:] for p in pieces], num_threads=1)
        theirs = [[self.blank] if p == " " else x for p, x in zip(pieces, theirs, strict=True)]
        data = [p.encode() for p in pieces]
        kept = [
            k for k, (d, x, y) in enumerate(zip(data, ours, theirs, strict=True))
            if b"".join(map(self.first.tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) == d == b"".join(map(self.pieces.__getitem__, y))
        ] if not self._same(data, ours, theirs) else range(len(pieces))
        out: list[tuple | None] = [None] * len(pieces)
        for k, found in zip(kept, self._align([ours[k] for k in kept], [theirs[k] for k in kept]), strict=True):
            out[k] = found
        return out

    def _same(self, data: list[bytes], ours: list[bytes], theirs: list[list[int]]) -> bool:
        """Whether the tokens of all pieces together spell them, and each has as many bytes as its piece."""
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        flat_a, flat_b = np.frombuffer(b"".join(ours), "<u4"), np.fromiter(itertools.chain.from_iterable(theirs), np.int64)
        ends = np.cumsum(sizes)
        for flat, each, lengths, table in (
            (flat_a, [len(x) // 4 for x in ours], self.sizes_a, self.first.tokens), (flat_b, list(map(len, theirs)), self.sizes_b, self.pieces)
        ):
            if not np.array_equal(np.cumsum(lengths[flat])[np.cumsum(each) - 1], ends) or 0 in each:
                return False
            if b"".join(map(table.__getitem__, flat.tolist())) != b"".join(data):
                return False
        return True

    def _align(self, ours: list[bytes], theirs: list[list[int]]) -> Iterator[tuple]:
        """All pieces at once: they end together, so their tokens' ends are compared as one text's."""
        if not ours:
            return
        a, b = np.frombuffer(b"".join(ours), "<u4").astype(np.int64), np.fromiter(itertools.chain.from_iterable(theirs), np.int64)
        n_a, n_b = [len(x) // 4 for x in ours], list(map(len, theirs))
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last_a, last_b = shared[group_a] == ends_a, shared[group_b] == ends_b
        code = pair_code(a[last_a], b[last_b]).tobytes()
        # the groups' text: tokens in order of group and side, each with the sign that follows it
        where = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        signs = np.concatenate([2 * a + last_a, self.signs_b + 2 * b + last_b])[where]
        text = list(map(self.signs.__getitem__, signs.tolist()))
        stops_a, stops_b = np.cumsum(n_a), np.cumsum(n_b)
        groups = (group_a[stops_a - 1] + 1).tolist()
        tokens = (stops_a + stops_b).tolist()
        start = first = 0
        for x, y, stop, end in zip(n_a, n_b, tokens, groups, strict=True):
            yield b"".join(text[start:stop]), x, y, code[8 * first : 8 * end]
            start, first = stop, end

    def texts(self, texts: list[str]) -> tuple[list[tuple[int, int, int, str]], np.ndarray, np.ndarray]:
        """Per text (n_a, n_b, n_links, groups_sha256); and each link's text and pair code."""
        cut = [self.cut(t) if t else [] for t in texts]
        known: dict[str, tuple | None] = {}
        new, old = self.cache.new, self.cache.old
        missing = []
        for piece in set().union(*cut):
            got = new.get(piece)
            if got is None:
                got = old.get(piece)
                if got is None:
                    missing.append(piece)
                    continue
                self.cache.put(piece, got)
                new, old = self.cache.new, self.cache.old
            known[piece] = got
        for piece, got in zip(missing, self.aligned(missing), strict=True):
            known[piece] = got
            if got and len(piece) <= CACHED_LETTERS:
                self.cache.put(piece, got)
        index = dict(zip(known, range(len(known)), strict=True))
        found = [f or (b"", -1, 0, b"") for f in known.values()]
        frags = [f[0] for f in found]
        n_a, n_b = np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64)
        codes, each = np.frombuffer(b"".join([f[3] for f in found]), np.int64), np.array([len(f[3]) // 8 for f in found], np.int64)
        first = np.cumsum(each) - each
        rows, at, doc = [], [], []
        for k, pieces in enumerate(cut):
            listed = list(map(index.__getitem__, pieces))
            places = np.array(listed, np.int64)
            if not listed or (n_a[places] < 0).any():
                rows.append((0, 0, 0, ""))
                continue
            n = each[places]
            total = int(n.sum())
            groups = b"".join(map(frags.__getitem__, listed))[:-1]
            rows.append((int(n_a[places].sum()), int(n_b[places].sum()), total, hashlib.sha256(groups).hexdigest()))
            at.append(np.repeat(first[places] - (np.cumsum(n) - n), n) + np.arange(total))
            doc.append(np.full(total, k, np.int64))
        if not at:
            return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
        return rows, np.concatenate(doc), codes[np.concatenate(at)]


@functools.cache
def aligner(first: str, second: str) -> Aligner:
    """One per worker process and pair of files."""
    return Aligner(first, second)


def split_runs(keys: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(part, records, sums, records) of a run's (pair code, document) keys, a part at a time.

    ``sums`` holds pairs, their links and how many documents have them; the records hold these
    documents in the same order, and the links of each.
    """
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    part = keys >> (DOC_BITS + 2 * ID_BITS - RADIX_BITS)
    for p in np.unique(part):
        lo, hi = np.searchsorted(part, p, side="left"), np.searchsorted(part, p, side="right")
        pair, doc, n = keys[lo:hi] >> DOC_BITS, keys[lo:hi] & DOC_MASK, times[lo:hi]
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        sizes = np.diff(starts, append=len(pair))
        yield int(p), int(hi - lo), packed(pair[starts], np.add.reduceat(n, starts), sizes), packed(doc, n)


def coded(docs: DataFrame, first: str | None, second: str | None, records: int) -> DataFrame:
    """Rows of documents and rows of runs, out of one pass over the texts."""

    def run(batches):
        coder = aligner(first or vocabulary("byte_bpe_50k.json"), second or vocabulary("piece_bpe_32k.model"))
        base = number = TaskContext.get().partitionId() << 40
        held: list[np.ndarray] = []
        times: list[np.ndarray] = []
        size = 0

        def rows_of(some, doc_ids=None):
            n = len(some)
            blank = lambda kind: pa.nulls(n, kind)
            if doc_ids is not None:
                a, b, links, sha = zip(*some, strict=True) if some else ((), (), (), ())
                ids = pa.array(range(number, number + n), pa.int64())
                about = [ids, doc_ids, *[pa.array(x, pa.int64()) for x in (a, b, links)], pa.array(sha, pa.string())]
                rest = [blank(pa.int32()), blank(pa.int64()), blank(pa.int64()), blank(pa.binary()), blank(pa.binary())]
            else:
                p, count, sums, recs = zip(*some, strict=True)
                about = [blank(pa.int64()), pa.nulls(n, key_type), *[blank(pa.int64())] * 3, blank(pa.string())]
                rest = [
                    pa.array(p, pa.int32()), pa.array([base] * n, pa.int64()), pa.array(count, pa.int64()),
                    pa.array(sums, pa.binary()), pa.array(recs, pa.binary()),
                ]
            return pa.RecordBatch.from_arrays([*about, *rest], names)

        names = ["row_no", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "part", "run", "n_records", "sums", "records"]
        for batch in batches:
            key_type = batch.schema.field(0).type
            rows, doc, code = coder.texts(batch.column(1).to_pylist())
            if len(doc):
                keys, n = np.unique(code << DOC_BITS | doc + (number - base), return_counts=True)
                held.append(keys)
                times.append(n)
                size += len(keys)
            yield rows_of(rows, batch.column(0))
            number += batch.num_rows
            if size >= records or number - base > DOC_MASK - 1024:
                if size:
                    yield rows_of(list(split_runs(np.concatenate(held), np.concatenate(times))))
                held, times, size, base = [], [], 0, number
        if size:
            yield rows_of(list(split_runs(np.concatenate(held), np.concatenate(times))))

    schema = (
        f"row_no long, doc_id {id_type(docs)}, n_a long, n_b long, n_links long, groups_sha256 string, "
        "part int, run long, n_records long, sums binary, records binary"
    )
    return in_batches(key_and_text(docs), run, schema)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (pair, links) runs as one, by a heap over the side that each run is at.

    All runs at the least side give up their pairs of that side together.
    """
    ends, heap = [], []
    for k, (pairs, _) in enumerate(runs):
        side = pairs >> ID_BITS
        starts = np.flatnonzero(np.diff(side, prepend=-1))
        ends.append((side[starts].tolist(), [*starts.tolist(), len(pairs)]))
        if len(starts):
            heap.append((ends[k][0][0], k, 0))
    heapq.heapify(heap)
    pairs, links = [], []
    while heap:
        side, got = heap[0][0], []
        while heap and heap[0][0] == side:
            _, k, at = heap[0]
            sides, starts = ends[k]
            got.append((runs[k][0][starts[at] : starts[at + 1]], runs[k][1][starts[at] : starts[at + 1]]))
            if at + 1 < len(sides):
                heapq.heapreplace(heap, (sides[at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        if len(got) == 1:
            pairs.append(got[0][0])
            links.append(got[0][1])
            continue
        both, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, inverse, np.concatenate([g[1] for g in got]))
        pairs.append(both)
        links.append(total)
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(pairs), np.concatenate(links)


def merge_level(runs: DataFrame, groups: int) -> DataFrame:
    """(part, run, sums) with at most ``groups`` runs in each part."""
    dealt = runs.select("part", F.pmod(F.xxhash64("run"), F.lit(groups)).alias("run"), "sums", "arrays")

    def run(batches):
        at, held = None, []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([packed(*merged(held))], pa.binary()), pa.array([2], pa.int32())],
                ["part", "run", "sums", "arrays"],
            )

        for batch in batches:
            for part, group, sums, arrays in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (part, group):
                    if held:
                        yield out()
                    at, held = (part, group), []
                held.append(tuple(unpacked(sums, arrays)[:2]))
        if held:
            yield out()

    sorted_ = dealt.repartition("part", "run").sortWithinPartitions("part", "run")
    return in_batches(sorted_, run, "part int, run long, sums binary, arrays int")


def earned(runs: DataFrame, totals: DataFrame, shares: dict[int, int]) -> DataFrame:
    """(run, docs): what each run's records of one part add to its documents.

    The merged counts of a part come first to each of the tasks that share its runs.
    """
    named = F.create_map(*[F.lit(x) for item in shares.items() for x in item])
    salt = F.pmod(F.xxhash64("run"), named[F.col("part")]).cast("int")
    spread = totals.select(
        "part", F.explode(F.sequence(F.lit(0), named[F.col("part")] - 1)).alias("salt"), F.lit(0).alias("step"),
        F.lit(None).cast("long").alias("run"), "sums", F.lit(None).cast("binary").alias("records"),
    )
    streamed = runs.select("part", salt.alias("salt"), F.lit(1).alias("step"), "run", "sums", "records")
    sorted_ = spread.unionByName(streamed).repartition("part", "salt").sortWithinPartitions("part", "salt", "step")

    def run(batches):
        pairs = counts = best = np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for step, name, sums, records in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                if not step:
                    pairs, counts = unpacked(sums, 2)
                    starts = np.flatnonzero(np.diff(pairs >> ID_BITS, prepend=-1))
                    best = counts == np.repeat(np.maximum.reduceat(counts, starts), np.diff(starts, append=len(pairs)))
                    continue
                own, _, sizes = unpacked(sums, 3)
                doc, times = unpacked(records, 2)
                at = np.repeat(np.searchsorted(pairs, own), sizes)
                order = np.argsort(doc, kind="stable")
                doc, times, at = doc[order], times[order], at[order]
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                rows.append((name, packed(doc[starts], np.add.reduceat(times * counts[at], starts), np.add.reduceat(times * best[at], starts))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["run", "docs"]
            )

    return in_batches(sorted_, run, "run long, docs binary")


def per_document(parts: DataFrame) -> DataFrame:
    """(row_no, n_best, count_sum): the parts of each run summed."""

    def run(batches):
        at, held = None, []

        def out():
            docs, sums, best = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(docs, kind="stable")
            docs, sums, best = docs[order], sums[order], best[order]
            starts = np.flatnonzero(np.diff(docs, prepend=-1))
            return pa.RecordBatch.from_arrays(
                [pa.array(at + docs[starts]), pa.array(np.add.reduceat(best, starts)), pa.array(np.add.reduceat(sums, starts))],
                ["row_no", "n_best", "count_sum"],
            )

        for batch in batches:
            for name, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != name:
                    if held:
                        yield out()
                    at, held = name, []
                held.append(unpacked(docs, 3))
        if held:
            yield out()

    sorted_ = parts.repartition("run").sortWithinPartitions("run")
    return in_batches(sorted_, run, "row_no long, n_best long, count_sum long")


def alignment(
    docs: DataFrame, first: str | None = None, second: str | None = None, records: int = RECORDS, fan: int = FAN, share: int = SHARE
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    A blank and the text are encoded by a byte-level vocabulary (A) and by a SentencePiece
    model (B); special tokens in a text are plain text. Offsets at which tokens of both end cut
    them into groups, and link the two that end there. ``count_sum`` adds up how many links of
    the corpus hold the same two ids, ``n_best`` counts the links whose two ids are the most
    frequent with that B id, ties included. A null or empty text, or one whose bytes an encoder
    does not keep, has zeros and an empty ``groups_sha256``. Repeated rows are counted and answered
    one by one; other columns are not looked at; an empty table gives no rows.
    """
    rows = written(coded(docs, first, second, records), "coded")
    texts = rows.where("part IS NULL").select("row_no", "doc_id", "n_a", "n_b", "n_links", "groups_sha256")
    runs = rows.where("part IS NOT NULL").select("part", "run", "sums", "records")
    about = rows.where("part IS NOT NULL").groupBy("part").agg(F.count("*").alias("runs"), F.sum(F.length("records")).alias("size"))
    shares, most = {}, 0
    for r in about.collect():  # PARTS rows
        shares[r["part"]] = -(-r["size"] // share)
        most = max(most, r["runs"])
    result, scratch = texts.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}), [rows]
    if shares:
        totals, level = runs.select("part", "run", "sums", F.lit(3).alias("arrays")), []
        while most != 1 or not level:
            most = -(-most // fan)
            totals = written(merge_level(totals, most), "totals")
            drop_written(level)
            level = [totals]
        back = written(per_document(earned(runs, totals.select("part", "sums"), shares)), "earned")
        result = texts.join(back, "row_no", "left")
        scratch += [totals, back]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    result = result.select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
    result = written(result, "aligned")
    drop_written(scratch)
    return result
