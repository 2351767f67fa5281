"""Decontamination, tokenizer alignment and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codegauge.llm import alignment as L
from codegauge.llm import spelling as S
from codegauge.llm import winnow as W
from codegauge.llm.bpe import vocabulary
from codegauge.llm.wordbytes import ByteWords, runs

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def slow_contamination(docs, items):
    windows = []
    for key, text in items:
        words = item_words(text)
        n = min(10, len(words))
        windows += [(key, words[k : k + n]) for k in range(len(words) - n + 1) if n]
    out = []
    for key, text in docs:
        words, hit, found = item_words(text), set(), set()
        for item, window in windows:
            for k in range(len(words) - len(window) + 1):
                if words[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    found.add(item)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        named = {i for i in found if i is not None}
        out.append((key, len(words), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_contamination(spark, seed):
    rng = random.Random(seed)
    names = ["alpha", "Beta", "ä", "日本", "x9", "e"]
    some = lambda n: " ".join(rng.choices(names, k=n))
    long = [rng.choice(names) + str(rng.randrange(50)) for _ in range(40)]
    items = [(1, " ".join(long)), (2, " ".join(long[5:20])), (10, some(12)), (3, "Beta, x9!"), (4, ""), (5, None), (6, some(10)), (6, some(4)), (None, "ä-e-ä")]
    docs = [(k, some(rng.randrange(40))) for k in range(25)]
    docs += [(30, "z! " * 9 + ",".join(long[3:16]).upper() + " q"), (30, " ".join(long[:9])), (31, None), (32, ""), (33, "日本" * 5000), (None, " ".join(long))]
    docs += [docs[0], (34, " ".join(long[8:18] + ["q"] + long[8:19]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "n_words": F.lit(2)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    got = sorted((tuple(r) for r in W.contamination(d, i).collect()), key=repr)
    assert got == slow_contamination(docs, items)


def test_contamination_of_empty_tables(spark):
    empty_docs = spark.createDataFrame([], "doc_id long, text string")
    empty_items = spark.createDataFrame([], "item_id string, text string")
    one = spark.createDataFrame([("a", "b c")], "item_id string, text string")
    assert W.contamination(empty_docs, one).collect() == []
    docs = spark.createDataFrame([(1, "b c d")], "doc_id long, text string")
    assert W.contamination(docs, empty_items).first()["contaminated"] is False
    assert W.contamination(docs, one).first()["n_hit"] == 2


def test_every_shared_span_has_a_common_fingerprint():
    rng = np.random.default_rng(5)
    for _ in range(200):
        span = int(rng.integers(1, 11))
        shared = rng.integers(0, 5, span).astype(np.uint64)
        one, two = (np.concatenate([rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64), shared, rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(2))
        a, b = (W.fingerprints(x, np.array([len(x)]), span)[1] for x in (one, two))
        assert set(a.tolist()) & set(b.tolist())


def test_words_across_chunks(monkeypatch):
    monkeypatch.setattr("codegauge.llm.wordbytes.CHUNK", 7)
    texts = ["Aa bb", None, "", "cccccccccccccccccccccc dd", "ä" * 20, "aa", "eeeeeee", "fffffff gggggg h"] * 3
    hashes, ends = ByteWords(W.letters()).of(pa.array(texts).slice(1))
    monkeypatch.undo()
    whole, same = ByteWords(W.letters()).of(pa.array(texts).slice(1))
    assert hashes.tolist() == whole.tolist() and ends.tolist() == same.tolist()
    assert np.diff(ends, prepend=0).tolist() == [len(item_words(t)) for t in texts[1:]]
    words = [w for t in texts[1:] for w in item_words(t)]
    assert len(set(hashes.tolist())) == len(set(words)) == len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)})
    assert len(runs(hashes, 3)) == len(hashes) - 2


class SlowAlignment:
    """Whole texts through the two libraries, and all counts in dictionaries."""

    def __init__(self):
        self.a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))

    def bytes_a(self, i):
        from codegauge.llm.bpe import byte_letters

        return bytes(byte_letters()[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        for joined in (b"".join(map(self.bytes_a, a)), b"".join(map(self.bytes_b, b))):
            if joined != (" " + text).encode():
                return [], []
        return a, b

    def rows(self, docs):
        found, counts = [], Counter()
        for key, text in docs:
            a, b = self.tokens(text)
            ends_a = np.cumsum([len(self.bytes_a(i)) for i in a]).tolist()
            ends_b = np.cumsum([len(self.bytes_b(i)) for i in b]).tolist()
            shared = sorted(set(ends_a) & set(ends_b))
            links = [(i, j) for i, e in zip(a, ends_a, strict=True) for j, f in zip(b, ends_b, strict=True) if e == f] if len(a) < 3000 else [
                (a[ends_a.index(e)], b[ends_b.index(e)]) for e in shared
            ]
            groups, before = [], 0
            for e in shared:
                part = [",".join(str(i) for i, x in zip(ids, ends, strict=True) if before < x <= e) for ids, ends in ((a, ends_a), (b, ends_b))]
                groups.append("|".join(part))
                before = e
            counts.update(links)
            found.append((key, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        best = defaultdict(int)
        for (_, j), n in counts.items():
            best[j] = max(best[j], n)
        return sorted(
            (key, na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha) for key, na, nb, ng, links, sha in found
        )


@pytest.fixture(scope="module")
def slow_alignment():
    return SlowAlignment()


def alignment_texts(rng):
    words = ["Haus", "house", "über", "naïve", "日本語", "don't", "x=1;", "\n", "\t", "  ", "", "<|endoftext|>", "<s>", "<0x41>", "🙂", "a.b,c", "\x00", "\u00a0", "e\u0301", "１"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(60)]
    texts += ["".join(rng.choices([*words, " "], k=rng.randrange(1, 40))) for _ in range(60)]
    return texts + ["", None, " ", "  ", "a ", " a", "\n \n", "▁", "a▁b", "if x:\n    y = 1\n\treturn  ", "the " * 400]


@pytest.mark.parametrize("records, fan, share", [(L.RECORDS, L.FAN, L.SHARE), (50, 2, 200)])
def test_alignment(spark, slow_alignment, records, fan, share):
    docs = [(k, t) for k, t in enumerate(alignment_texts(random.Random(3)))]
    docs += docs[:5] + [(900, "the cat sat " * 30)] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_a", F.lit("x")).repartition(6)
    got = sorted(tuple(r) for r in L.alignment(frame, records=records, fan=fan, share=share).collect())
    want = slow_alignment.rows(docs)
    assert [r for r in got if r not in want] == [] and got == want


def test_alignment_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert L.alignment(empty).collect() == []
    blank = spark.createDataFrame([("a", None), (None, "")], "doc_id string, text string")
    assert {tuple(r)[1:] for r in L.alignment(blank).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_runs_and_merge():
    rng = np.random.default_rng(1)
    total, some = Counter(), []
    for _ in range(7):
        code = L.pair_code(rng.integers(0, 40, 500), rng.integers(0, 300, 500))
        pairs, n = np.unique(code, return_counts=True)
        total.update(code.tolist())
        some.append((pairs, n))
    pairs, links = L.merged(some)
    assert dict(zip(pairs.tolist(), links.tolist(), strict=True)) == total and (np.diff(pairs) > 0).all()
    first, second = L.unpacked(L.packed(pairs, links), 2)
    assert first.tolist() == pairs.tolist() and second.tolist() == links.tolist()


def slow_spelling(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by_word = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in by_word.items() if vs}
    form = {w: v for w, v in form.items() if words[v] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, c, len(by_word[w]), form.get(w), words.get(form.get(w)), root(w)) for w, c in words.items())


@pytest.mark.parametrize("seed", range(3))
def test_spelling(spark, seed):
    rng = random.Random(seed)
    letters = "aabcÄäö" if seed else "ab"
    words = ["".join(rng.choices(letters, k=rng.randrange(4, 8))) for _ in range(90 if seed else 60)]
    words += ["spelling", "speling", "spellings", "spelled", "Spelling", "aaaaa", "aaaaaa", "aaaaaaa", "aaaab"]
    docs = [(k, " ".join(rng.choices(words, k=30)) + "\u00d7x_yz9") for k in range(120)]
    docs += [(None, "wordone " * 99 + "wordon " * 40 + "wordo " * 12 + "spelling " * 40), (5, None), (6, ""), (7, "ÀÀÀÀÀ ààààà " * 9), (8, "x" * 100_000), *docs[:3]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2)})
    rows = S.spelling_variants(frame).select("word", "n", "n_near", "form", "form_n", "root")
    got, want = sorted(tuple(r) for r in rows.collect()), slow_spelling(docs)
    assert got == want and any(r[3] for r in got) and any(r[3] and r[3] != r[5] for r in got)


def test_spelling_of_an_empty_table(spark):
    assert S.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choices("abcd", k=rng.randrange(5, 12)))
        ranks = {g: k for k, g in enumerate(sorted({word[k : k + 2] for k in range(len(word) - 1)}, key=lambda g: rng.random()))}
        places, _ = S.prefix_of(word, ranks)
        counts = np.array([rng.randrange(1, 50) for _ in range(S.COUNTERS)])
        cost = lambda p, counts=counts, word=word: counts[S.slot("l", word[: p[0] + 2])] + counts[S.slot("r", word[p[1] :])]
        pair = S.pivots_of(word, places, counts)
        every = [(x, y) for x in places for y in places if x + 2 <= y]
        assert pair in every and cost(pair) == min(map(cost, every))
