"""Encoding, lengths, packing and quality rules against libraries and plain recounts."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codegauge.llm.bpe import SHORT, ByteBpe, Cache, byte_bpe, encoded, vocabulary
from codegauge.llm.lengths import encoded_lengths, length_quantiles, length_table
from codegauge.llm.packing import SEQUENCE, best_fit, column_generation, cut, pack, plan
from codegauge.llm.quality import measured, rate_quality, good_documents, repeated_words, script_of
from codegauge.llm.tables import slices

ODD = [
    "", " ", "  a", "a  b   c ", " \n a\n\n  b", "\n", "a \n  b", "<|endoftext|>x<|endoftext|>", " <|endoftext|> <|endoftext|",
    "I'll don't 'sx", "x" * 1000, "ab" * 300, "日本語テスト éèê  　 foo\x1c bar\x85q", "123 45abc!!! ...", "é" * 200,
    "the " * 50 + "  ", "\r\n\r\n x", "don’t", "a\x00b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def odd_texts(n=3000):
    rng = random.Random(1)
    letters = list(" \n\t'ab1é! 　\x1c\x85sdt日") + ["<|endoftext|>", "  "]
    return ODD + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(n)]


def test_encoder_equals_the_library(library):
    coder, texts = byte_bpe(vocabulary("byte_bpe_50k.json")), odd_texts()
    ids = coder.encode_batch(texts)
    for text, got in zip(texts, ids, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert coder.decode(got) == library.decode(want, skip_special_tokens=False)


def test_long_words_take_the_other_way(library):
    coder = byte_bpe(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(2)
    for _ in range(30):
        word = "".join(rng.choices("abcdeth", k=rng.randint(SHORT - 3, 4 * SHORT)))
        assert np.frombuffer(coder.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_encoded_rows(spark, library):
    rows = [(1, "the cat", "x"), (1, "the cat", "y"), (None, None, None), (4, "", "z"), (5, "long " * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, encoded(docs).collect()), key=str)
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        want.append((key, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=str)
    assert encoded(docs.limit(0)).collect() == []


def test_length_table_answers_every_limit(spark):
    rng = random.Random(3)
    lengths = [rng.randint(0, 9000) for _ in range(300)] + [7] * 200
    frame = spark.createDataFrame([(n,) for n in lengths] + [(None,)], "n_tokens long")
    table = length_table(frame)
    rows = table.collect()
    assert {r["context_limit"] for r in rows} == set(lengths)
    for r in rows:
        limit = r["context_limit"]
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_longer"] == sum(n > limit for n in lengths)
        assert r["truncated_total"] == sum(min(n, limit) for n in lengths)
        assert r["tokens_lost"] == sum(lengths) - r["truncated_total"]
        assert math.isclose(r["quantile"], sum(n <= limit for n in lengths) / len(lengths))
    got = {r["share"]: r["n_tokens"] for r in length_quantiles(table).collect()}
    assert got[0.5] == sorted(lengths)[math.ceil(0.5 * len(lengths)) - 1]
    assert length_table(frame.limit(0)).collect() == []


def test_token_count_query(spark, sf_dir, library):
    import duckdb

    from codegauge.llm.queries import QUERIES

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()]
    lengths = Counter(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
    got = {r["context_limit"]: r["n_docs"] for r in QUERIES["op3_token_counts"](spark, sf_dir).collect()}
    assert got == dict(lengths)


def test_column_generation_reaches_full_patterns():
    sizes, demand = np.array([3, 5, 7]), np.array([60.0, 40.0, 20.0])
    patterns, used = column_generation(sizes, demand, 10)
    assert ((patterns * sizes).sum(1) <= 10).all()
    assert (patterns.T @ used >= demand - 1e-6).all()
    # 3+7, 5+5 and 3+3+3: no fewer sequences can hold them
    assert used.sum() <= 20 + 20 + 40 / 3 + 1e-6


def test_the_program_beats_best_fit():
    histogram = {922: 240, 317: 300, 886: 180, 825: 300}
    rounds = []
    planned, fitted = plan(histogram, rounds=rounds), best_fit(Counter(histogram), SEQUENCE)
    assert sum(n for n, _ in planned) == 370 < sum(n for n, _ in fitted) == 410
    assert len(rounds) > 1 and rounds[-1] < rounds[0]


def test_the_program_prices_columns_of_the_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    histogram = {r["length"]: r["count"] for r in cut(docs).groupBy("length").count().collect()}
    rounds = []
    planned = sum(n for n, _ in plan(histogram, rounds=rounds))
    full = histogram.pop(SEQUENCE, 0)
    assert len(rounds) > 0 and planned <= full + sum(n for n, _ in best_fit(Counter(histogram), SEQUENCE))


@pytest.mark.parametrize("n", [0, 1, 40, 2000])
def test_plan_covers_the_histogram(n):
    rng = random.Random(n)
    lengths = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(n)] + [900] * n
    histogram = Counter(lengths)
    placed = Counter()
    for times, pieces in plan(histogram):
        assert sum(c * a for c, a in pieces.items()) <= SEQUENCE
        for c, a in pieces.items():
            placed[c] += times * a
    assert placed == histogram


def check_packing(rows, texts, library):
    """Every id once, sequences gapless and within their size."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for key, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= SEQUENCE and {r["sequence_tokens"] for r in pieces} == {at}
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing(spark, sf_dir, library):
    import duckdb

    from codegauge.llm.queries import QUERIES

    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    rows = QUERIES["op7_packing"](spark, sf_dir).collect()
    check_packing(rows, texts, library)
    used = len({r["sequence_id"] for r in rows})
    assert sum(r["length"] for r in rows) / (used * SEQUENCE) > 0.95


def test_packing_odd_documents(spark, library):
    texts = {k: "word " * 40 for k in range(300)} | {1000: None, 1001: "", 1002: "a b c " * 20000}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, offset int")
    check_packing(pack(docs).collect(), texts, library)
    assert pack(docs.limit(0)).collect() == []
    twice = docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3"))
    assert cut(twice).count() == 6 and pack(twice).count() == 6


def test_short_texts_leave_no_padding(spark, library):
    texts = {k: None if k % 3 else "" for k in range(9000)} | {k: "word" for k in range(9000, 12000)} | {k: "a b c d e f g h" for k in range(12000, 13000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pack(docs).collect()
    check_packing(rows, texts, library)
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // SEQUENCE)


def test_wide_histograms_are_packed_by_exact_lengths():
    rng = np.random.default_rng(2)
    wide = Counter(min(SEQUENCE, int(x) + 1) for x in rng.lognormal(5.5, 1, 4000))
    whole = -(-sum(c * n for c, n in wide.items()) // SEQUENCE)
    assert sum(times for times, _ in plan(wide)) <= 1.001 * whole + 1
    few = Counter(int(x) for x in rng.integers(300, 900, 300))  # best fit alone does not do
    rows, placed = plan(few), Counter()
    for times, pieces in rows:
        assert sum(c * a for c, a in pieces.items()) <= SEQUENCE
        placed.update({c: times * a for c, a in pieces.items()})
    assert placed == few


def slow_counts(text):
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            marked |= {k, k + 1, k + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            again += line in seen
            seen.add(line)
    return (
        len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), again, len(marked),
        len(words) < 50 or 100 * len(marked) > 50 * len(words),
    )


def test_quality_counts(spark, sf_dir):
    import duckdb

    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    texts |= {-1: None, -2: "", -3: "a b c a b c a b c\n\n \na b c\na b c", -4: "\x85é \u3000x\x0by\x1cz", -5: "same word " * 40000, -6: "a | b | c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'x' AS kept", "1 AS row")
    for r in rate_quality(docs).collect():
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == slow_counts(texts[r["doc_id"]] or ""), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])
    assert rate_quality(docs.limit(0)).collect() == []


def test_repeated_words_with_many_distinct():
    ids = np.array([1, 2, 3, 9, 1, 2, 3, 8])
    assert repeated_words(ids, 10) == repeated_words(ids, 1 << 21) == 6


def test_scripts():
    assert script_of("Привет, мир abc") == "cyrillic"
    assert script_of("123 ... --") == "other" and script_of("") == "other"
    assert script_of("日本語") == "han" and script_of("été") == "latin"


def test_noise_goes_and_clean_text_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    rng = random.Random(5)
    noise = [(10**6 + k, "".join(rng.choices("kqxzwv7#", k=9)) + " ", "en", "s", 1) for k in range(5)]
    noise = [(k, "".join(t + "".join(rng.choices("kqxzwv789#~^", k=9)) + " " for _ in range(90)), lang, s, n) for k, t, lang, s, n in noise]
    table = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    kept = {r["doc_id"] for r in good_documents(table).select("doc_id").collect()}
    assert not kept & {k for k, *_ in noise}
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet").where("quality = 1")
    rated = {r["doc_id"]: r["base_failed"] for r in rate_quality(table).select("doc_id", "base_failed").collect()}
    clean = [r["doc_id"] for r in labels.collect() if not rated[r["doc_id"]]]
    assert np.mean([k in kept for k in clean]) > 0.97


def test_all_columns_travel(spark):
    text = "The words of this text differ from one another in many small ways so that it passes every rule here " * 1
    text = " ".join(f"{w}{k}" if k % 3 else w for k, w in enumerate((text * 4).split()))
    docs = spark.createDataFrame([(1, text, None, "a", 2.5)], "doc_id long, text string, lang string, band string, n_words double")
    assert good_documents(docs).columns == docs.columns
    assert measured(docs).count() == 1


def test_quality_measures_and_verdict_equal_a_recount(spark, sf_dir):
    """Fertility, byte share, entropy, quartiles and the verdict, step by step."""
    import sentencepiece

    from codegauge.llm import quality

    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rows = {r["doc_id"]: r for r in rate_quality(docs).collect()}
    for r in docs.where("doc_id % 10 = 3").collect():
        ids = [i for w in (r["text"] or "").encode().split() for i in model.encode(w.decode())]
        share = [n / len(ids) for n in Counter(ids).values()]
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids) and math.isclose(got["chars_per_token"], got["word_chars"] / len(ids))
        assert math.isclose(got["byte_share"], sum(model.is_byte(i) for i in ids) / len(ids), abs_tol=1e-12)
        assert math.isclose(got["token_entropy"], -sum(p * math.log2(p) for p in share), rel_tol=1e-9)
    limits = {}
    for band in {r["band"] for r in rows.values()}:
        held = {(r["chars_per_token"], r["token_entropy"]) for r in rows.values() if r["band"] == band and not r["base_failed"]}
        if held:
            quart = lambda v: [sorted(v)[max(0, math.ceil(q * len(v)) - 1)] for q in (0.25, 0.5, 0.75)]
            c, e = quart([h[0] for h in held]), quart([h[1] for h in held])
            reach = lambda q, a, b: quality.WIDTH * max((q[b] - q[a]) / 0.6745, quality.LEAST * q[1])
            limits[band] = len(held), c[1] - reach(c, 0, 1), c[1] + reach(c, 1, 2), e[1] - reach(e, 0, 1)
    for r in rows.values():
        fixed = quality.BANDS[r["script"]]
        n, low, high, least = limits.get(r["band"], (0, 0, 0, 0))
        mixed = lambda own, given: (n * own + quality.PRIOR * given) / (n + quality.PRIOR)
        c, e = r["chars_per_token"], r["token_entropy"]
        want = not r["base_failed"] and r["byte_share"] <= fixed.max_byte_share and e >= fixed.min_entropy and e >= mixed(least, fixed.min_entropy)
        want = want and max(fixed.min_chars_per_token, mixed(low, fixed.min_chars_per_token)) <= c <= min(fixed.max_chars_per_token, mixed(high, fixed.max_chars_per_token))
        assert r["kept"] == want
    assert sum(r["kept"] for r in rows.values()) >= 0.99 * sum(not r["base_failed"] for r in rows.values())


@pytest.mark.parametrize("n", [3, 199, 200])
def test_noise_fails_in_languages_of_any_size(spark, sf_dir, n):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").where("lang = 'en' AND length(text) > 600").orderBy("doc_id").limit(n)
    docs = docs.select("doc_id", "text", "lang")
    rng = random.Random(n)
    noise = [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(90)) for letters in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz") * 4]
    odd = spark.createDataFrame([(-1 - k, t, "en") for k, t in enumerate(noise)], docs.schema)
    kept = {r["doc_id"] for r in rate_quality(docs.unionByName(odd)).where("kept").collect()}
    clean = {r["doc_id"] for r in rate_quality(docs).where("NOT base_failed").collect()}
    assert not any(k < 0 for k in kept) and kept >= clean and len(clean) > 0.9 * docs.count()


def test_lengths_of_odd_rows(spark):
    coder = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = [None, "", "Hello there", "Hello there", "né à 日本 " * 40000]
    docs = spark.createDataFrame([(None, t, 7) for t in texts], "doc_id long, text string, n_tokens int")
    got = sorted(r["n_tokens"] for r in encoded_lengths(docs).collect())
    assert got == sorted(len(coder.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert encoded_lengths(docs.limit(0)).collect() == []


def test_texts_in_rows_are_sent_once_and_counted():
    """A batch is cut by the texts inside its rows too, also where the batch is itself a cut."""
    rows = pa.array([{"k": k, "text": f"{k}" * 100} for k in range(10)])
    batch = pa.RecordBatch.from_arrays([rows], ["row"])
    assert [len(b) for b in slices(batch, size=250)] == [2] * 5
    cut = batch.slice(4, 3)
    assert cut.column(0).field(1).to_pylist() == [f"{k}" * 100 for k in (4, 5, 6)]
    assert [len(b) for b in slices(cut, size=250)] == [2, 1]


def test_a_text_of_the_row_is_measured(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    frame = measured(docs)
    sent = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(text" not in sent and {(r["row"]["doc_id"], r["n_words"]) for r in frame.collect()} == {(1, 2), (2, 0)}
    assert {(r["row"]["doc_id"], r["n_words"]) for r in measured(docs, ["doc_id"]).collect()} == {(1, 2), (2, 0)}


def test_a_piece_of_several_words_is_cut_and_merged_once(monkeypatch):
    coder = ByteBpe(vocabulary("byte_bpe_50k.json"))
    texts = [f"one, two{k}. don't (three)" for k in range(50)]
    first = coder.encode_batch(texts)
    cut, merged = [], []
    plain, merge = coder.words, coder.merge
    monkeypatch.setattr(coder, "words", lambda piece: cut.append(piece) or plain(piece))
    monkeypatch.setattr(coder, "merge", lambda words: merged.extend(words) or merge(words))
    assert coder.encode_batch(texts) == first
    assert cut == [] and merged == []
    assert [coder.decode(x) for x in first] == texts


def test_a_worker_keeps_nothing_of_earlier_steps():
    from codegauge.llm.quality import pieces
    from codegauge.llm.tables import forget

    place = vocabulary("byte_bpe_50k.json")
    coder, model = byte_bpe(place), pieces(vocabulary("piece_bpe_32k.model"))
    forget(byte_bpe)
    assert byte_bpe(place) is coder and pieces(vocabulary("piece_bpe_32k.model")) is not model
    forget()
    assert byte_bpe(place) is not coder


def test_a_new_piece_of_one_word_is_looked_for_once(monkeypatch):
    coder = ByteBpe(vocabulary("byte_bpe_50k.json"))
    texts = ["first " + " ".join(f"word{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(20))]
    asked, get = [], Cache.get
    monkeypatch.setattr(Cache, "get", lambda self, key: asked.append(key) or get(self, key))
    once = coder.encode_batch(texts)
    assert asked == [] and coder.encode_batch(texts) == once and coder.decode(once[0]) == texts[0]
    # two generations and a batch: what is left out is coded anew
    coder._after.size = 7
    assert coder.encode_batch(texts * 2) == once * 2 and [coder.encode_batch([t])[0] for t in texts] == once
