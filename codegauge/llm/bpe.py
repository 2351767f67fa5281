"""Byte-level BPE encoding and decoding with a contiguous rank array per short word.

A word is held as its parts between boundaries and, beside them, the ranks of the pairs
of adjacent parts. The lowest rank is searched, its inner boundary is deleted and the two
neighbouring ranks are looked up anew, until no pair has a rank. The new words of a batch
are rows of one array, so each step is taken for all of them at once. Words longer than
``SHORT`` bytes, for which scanning would be quadratic, keep the same ranks in a heap over
a linked list. Both give the ids of the public vocabulary's own encoder.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codegauge.llm.tables import in_batches, key_and_text, once_in_worker

SHORT = 128
CACHED_WORDS = 500_000
# Fixed values of the vocabulary file's kind: pattern that splits text before the merges,
# and white space as that pattern means it.
SPACE = "\t-\r \x85\xa0  -     　"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
_INNER_SPACE = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files.

    Bytes that print as one visible Latin-1 letter stand for themselves; the others follow
    from code point 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Cache:
    """Keeps recently used words: two generations of at most ``size`` words and one batch's."""

    def __init__(self, size: int = CACHED_WORDS) -> None:
        self.size, self.new, self.old = size, {}, {}

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def put_all(self, items: dict) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new.update(items)

    def get(self, key):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got


class ByteBpe:
    """Encoder and decoder of one vocabulary file, with a bounded cache of words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        vocab = {spell(k): v for k, v in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self._bytes = np.array([vocab[bytes([b])] for b in range(256)], dtype=np.int32)
        # rank of a pair of ids, and the id that replaces it
        self._ranks: dict[int, int] = {}
        made: list[int] = []
        for m in data["model"]["merges"]:
            x, y = map(spell, m if isinstance(m, list) else m.split(" "))
            self._ranks.setdefault(vocab[x] << 20 | vocab[y], len(made))
            made.append(vocab[x + y])
        self._made = np.array(made, dtype=np.int32)
        self._table()
        left, right = np.divmod(np.arange(1 << 16), 256)
        self._byte_ranks = self.rank(self._bytes[left], self._bytes[right])
        names = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self._pattern = regex.compile(PATTERN)
        self._cache, self._after, self._spaced = Cache(), Cache(), Cache()

    def _table(self) -> None:
        """The ranks as an open hash table that a whole array of pairs is looked up in."""
        self._shift = 64 - 19
        keys, ranks = np.array([*self._ranks.keys()], np.uint64), np.array([*self._ranks.values()], np.int32)
        self._keys = np.full(1 << 19, np.iinfo(np.uint64).max, np.uint64)
        self._vals = np.full(1 << 19, len(self._made), np.int32)
        at = self._slot(keys)
        while len(keys):
            _, first = np.unique(at, return_index=True)
            free = first[self._vals[at[first]] == len(self._made)]
            self._keys[at[free]], self._vals[at[free]] = keys[free], ranks[free]
            keys, ranks, at = (np.delete(x, free) for x in (keys, ranks, at))
            at = (at + 1) & (len(self._keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self._shift)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the number of merges where a pair has none."""
        keys = (left.astype(np.int64) << 20 | right).astype(np.uint64)
        at = self._slot(keys)
        found = self._keys[at]
        ranks = np.where(found == keys, self._vals[at], len(self._made)).astype(np.int32)
        open_ = np.flatnonzero((found != keys) & (found != np.iinfo(np.uint64).max))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self._keys) - 1)
            found = self._keys[at[open_]]
            hit = found == keys[open_]
            ranks[open_[hit]] = self._vals[at[open_[hit]]]
            open_ = open_[~hit & (found != np.iinfo(np.uint64).max)]
        return ranks

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word; words of like length are merged side by side."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (4, 8, 12, 16, 24, 32, 64, SHORT):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for k in range(0, len(rows), 8192):
                self._merge_rows(words, rows[k : k + 8192], sizes, width, out)
        for k in np.flatnonzero(sizes > SHORT):
            out[k] = np.array(self._merge_long(words[k]), dtype="<u4").tobytes()
        return out

    def _merge_rows(self, words, rows, sizes, width, out) -> None:
        """Parts and ranks of adjacent parts, a row per word; one boundary goes at each step."""
        if not len(rows):
            return
        none = len(self._made)
        text = b"".join([words[k].ljust(width, b"\0") for k in rows])
        letters = np.frombuffer(text, np.uint8).reshape(-1, width)
        parts = self._bytes[letters]
        size = sizes[rows]
        ranks = np.full(parts.shape, none, np.int32)
        ranks[:, :-1] = self._byte_ranks[letters[:, :-1].astype(np.int32) << 8 | letters[:, 1:]]
        cols = np.arange(width)
        ranks[cols[None, :] >= size[:, None] - 1] = none
        while True:
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            going = best < none
            if not going.all():
                done = np.flatnonzero(~going)
                ids = parts[done].astype("<u4").tobytes()
                for k, (row, n) in enumerate(zip(rows[done].tolist(), size[done].tolist(), strict=True)):
                    out[row] = ids[4 * k * width : 4 * (k * width + n)]
                if not going.any():
                    return
                parts, ranks, size, rows, at, best = (x[going] for x in (parts, ranks, size, rows, at, best))
                line = line[: len(rows)]
            parts[line, at] = self._made[best]
            np.copyto(parts[:, :-1], parts[:, 1:].copy(), where=cols[:-1] > at[:, None])
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=cols[:-1] >= at[:, None])
            size = size - 1
            right = np.flatnonzero(at < size - 1)
            ranks[right, at[right]] = self.rank(parts[right, at[right]], parts[right, at[right] + 1])
            end = np.flatnonzero(at >= size - 1)
            ranks[end, at[end]] = none
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank(parts[left, at[left] - 1], parts[left, at[left]])

    def _merge_long(self, word: bytes) -> list[int]:
        rank, made = self._ranks.get, self._made.tolist()
        part = [int(self._bytes[b]) for b in word]
        after = [*range(1, len(word)), -1]
        before = [-1, *range(len(word) - 1)]
        heap = [(r, i) for i in range(len(word) - 1) if (r := rank(part[i] << 20 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j < 0 or rank(part[i] << 20 | part[j]) != r:
                continue
            part[i], part[j] = made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := rank(part[x] << 20 | part[y])) is not None:
                    heapq.heappush(heap, (s, x))
        return [p for p in part if p >= 0]

    def words(self, piece: str) -> list[str]:
        """Words of the pattern; a blank and letters, or that and a mark, need no pattern."""
        if piece[:1] == " " and len(piece) > 1:
            if piece[1:].isalpha():
                return [piece]
            if piece[-1] in ".,;:!?" and piece[1:-1].isalpha():
                return [piece[:-1], piece[-1]]
        return self._pattern.findall(piece)

    def _pieces(self, text: str) -> tuple[list[str], list[str]]:
        """The text cut where a word of the pattern begins, finely or not.

        A blank with no white space on one of its sides always begins a word, so most
        texts are cut at blanks; the pieces after a blank come second and without it.
        """
        if _INNER_SPACE.search(text):
            return self._pattern.findall(text), []
        head, *rest = text.split(" ")
        return [head] if head else [], rest

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids; special tokens in a text become their ids."""
        cut = []
        for text in texts:
            if self._special and any(s in text for s in self.special):
                pieces: list[str] = []
                for k, part in enumerate(self._special.split(text)):
                    pieces += [part] if k % 2 else self._pattern.findall(part)
                cut.append((pieces, []))
            else:
                cut.append(self._pieces(text))
        known = {s: i.to_bytes(4, "little") for s, i in self.special.items()}
        known |= self._known(set().union(*(x for x, _ in cut)).difference(known), "")
        spaced = self._known(set().union(*(y for _, y in cut)), " ")
        return [b"".join([*map(known.__getitem__, x), *map(spaced.__getitem__, y)]) for x, y in cut]

    def _known(self, pieces: set[str], lead: str) -> dict[str, bytes]:
        """Ids of each piece with ``lead`` before it; whole pieces and their words are remembered."""
        cache = self._after if lead else self._cache
        known = dict(zip(pieces, map(cache.new.get, pieces), strict=True))
        rest = [p for p, ids in known.items() if ids is None]
        again = {p: ids for p, ids in zip(rest, map(cache.old.get, rest), strict=True) if ids is not None}
        known |= again
        cut = {p: self.words(lead + p) for p in rest if p not in again}
        # a piece that is one word was just looked for; words of other pieces may be known
        coded = {own[0]: None for p, own in cut.items() if len(own) == 1 and (lead or p[0] != " ")}
        for own in cut.values():
            for w in own:
                if w not in coded:
                    coded[w] = self._after.get(w[1:]) if w[:1] == " " else self._cache.get(w)
        missing = [w for w, ids in coded.items() if ids is None]
        merged = dict(zip(missing, self.merge([w.encode() for w in missing]), strict=True))
        coded |= merged
        cache.put_all(again)
        self._after.put_all({w[1:]: ids for w, ids in merged.items() if w[:1] == " " and len(w) <= SHORT})
        self._cache.put_all({w: ids for w, ids in merged.items() if w[:1] != " " and len(w) <= SHORT})
        joined = {p: b"".join([coded[w] for w in own]) if len(own) > 1 else coded[own[0]] for p, own in cut.items()}
        cache.put_all({p: ids for p, ids in joined.items() if len(cut[p]) > 1 and len(p) <= SHORT})
        return known | joined

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word with a blank before it; words are UTF-8 without white space."""
        new, old, put = self._spaced.new, self._spaced.old, self._spaced.put
        out = [new.get(w) or old.get(w) for w in words]
        missing = [k for k, ids in enumerate(out) if ids is None]
        if not missing:
            return out
        cut: dict[int, list[str]] = {}
        for k in missing:
            piece = " " + words[k].decode()
            if "<" in piece and any(s in piece for s in self.special):
                out[k] = self.encode(piece)
            else:
                cut[k] = self.words(piece)
        order = list({w for parts in cut.values() for w in parts})
        known = dict(zip(order, self.merge([w.encode() for w in order]), strict=True))
        for k, parts in cut.items():
            out[k] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
            if len(words[k]) <= SHORT:
                put(words[k], out[k])
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become the replacement character."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@once_in_worker
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    return ByteBpe(path)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, name: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip): sha256 in lower-case
    hex of the ids as little-endian unsigned 32-bit integers and of the decoded text. A null
    text is an empty one; an empty table gives no rows; repeated rows are answered one by
    one; other columns are not looked at. ``path`` names a vocabulary file that every
    executor can open; left out, each executor finds the installed file ``name``.
    """

    def run(batches):
        coder = byte_bpe(path or vocabulary(name))
        for batch in batches:
            n, a, b, same = [], [], [], []
            texts = batch.column(1).to_pylist()
            for text, ids in zip(texts, coder.encode_batch(texts), strict=True):
                back = coder.decode(ids)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    return in_batches(
        key_and_text(docs),
        run,
        f"doc_id {id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean",
    )


def id_type(docs: DataFrame, key: str = "doc_id") -> str:
    """The DDL type of the id column, which results keep."""
    return docs.schema[key].dataType.simpleString()
