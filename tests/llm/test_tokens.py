"""BPE round trip and packing against the tokenizers library."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import bpe, packing
from graphloom.llm.queries import TOKENIZERS

WORD, BYTE = f"{TOKENIZERS}/word_bpe_49k.json", f"{TOKENIZERS}/byte_bpe_50k.json"
if not os.path.exists(WORD):
    pytest.skip("no tokenizer files", allow_module_level=True)

TEXTS = [
    None, "", " ", "\n\t", "a\x1cb c", "İstanbul ΣΑΣ ς ß ẞ", "x<|endoftext|>Y <|startoftext|>", "don't it's 'LL 12 ²½Ⅷ <| |>", "é ́x", "日本語テキスト 😀👍🏽", "a b c​d", "the the the", "the the the",
    "a\n b", "a\n  b", "\n \nX", "a \n", "a  ", "   b", "a\t b \n\n  c",
]


@pytest.fixture(scope="module")
def word():
    return bpe.WordCodec(open(WORD).read()), Tokenizer.from_file(WORD)


def test_streams_long_words_like_the_library(word):
    codec, library = word
    random.seed(3)
    for w in ("ab" * 3000, "the" * 2000, "antidisestablishmentarianism" * 100, "".join(random.choice("abcdeghinorst") for _ in range(9000))):
        assert list(codec.stream(w.encode())) == library.encode(w, add_special_tokens=False).ids


def test_transducer_state_is_bounded(word):
    table = word[0].table
    t, most = bpe.WordTransducer(table), 0
    for _ in range(400):
        list(t.feed(b"inthean" * 9))
        most = max(most, len(t.held))
    assert most <= table.lookahead + table.longest + 63
    assert 0 < table.lookahead < 1000


def test_decoder_emits_only_whole_characters(word):
    table = word[0].table
    d = bpe.Decoder(table, {}, joined=False)
    parts = [d.feed([table.first[b]]) for b in "é日😀".encode()]
    assert "".join(parts) + d.finish() == "é日😀" and parts[0] == "" and parts[1] == "é"


def test_round_trip_rows(spark, word):
    codec, library = word
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "null id", 7)], "doc_id long, text string, n_tokens int")
    out = bpe.bpe_roundtrip(df, WORD, texts=True).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        ids = library.encode((TEXTS[r.doc_id] if r.doc_id is not None else "null id") or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe_roundtrip(df.limit(0), WORD).count() == 0


def test_texts_of_megabytes_in_blocks(spark, word, monkeypatch):
    monkeypatch.setattr(bpe, "_SLICE", 5000)
    codec, library = word
    for text in ["some words, and MORE of them\n" * 3000, "x" * 20_000 + " y " + "don't,stop" * 2000, " " * 12_000 + "end", "<|endoftext|>" * 40 + "a" * 5001, "\x1c" * 6000 + "b"]:
        ids = library.encode(text, add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert codec.round_trip(text) == want
    monkeypatch.undo()
    text = "the quick brown fox, 12 jumps\n" * 120_000
    r = bpe.bpe_roundtrip(spark.createDataFrame([("big", text)], "doc_id string, text string"), WORD).collect()[0]
    assert r.n_tokens == 120_000 * len(library.encode("the quick brown fox, 12 jumps\n", add_special_tokens=False).ids)


def test_lookahead_counts_every_rule_of_a_token():
    chars = bpe.byte_chars()
    vocab = {c: i for i, c in enumerate(chars)}
    for t in ("bc", "cd", "ab", "abc", "bcd"):
        vocab[t] = len(vocab)
    few = bpe.MergeTable(vocab | {c + "_": 900 + i for i, c in enumerate(chars)}, [("c", "d"), ("a", "b"), ("ab", "c")], "_")
    more = bpe.MergeTable(vocab | {c + "_": 900 + i for i, c in enumerate(chars)}, [("c", "d"), ("a", "b"), ("ab", "c"), ("a", "bc")], "_")
    assert more.lookahead >= few.lookahead


def test_query_matches_library_on_whole_documents(spark, data, word):
    from graphloom.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"](spark, data).collect():
        ids = word[1].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(word[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(rows, texts, capacity=1024):
    library = Tokenizer.from_file(BYTE)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == capacity for p in pieces[1:]) and (len(pieces) == 1) == (len(ids) <= capacity)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), sum(r.length for r in rows)


def test_packing_rows_and_bounds(spark):
    texts = {i: t for i, t in enumerate([*TEXTS, "word " * 3000, "a b" * 341, "x"])}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, length int")
    check_packing(packing.pack(df, BYTE).collect(), texts)
    assert packing.pack(df.limit(0), BYTE).count() == 0


def test_packing_repeated_rows_keep_all_pieces(spark):
    df = spark.createDataFrame([(1, "same text")] * 50, "doc_id long, text string")
    out = packing.pack(df, BYTE).collect()
    assert len(out) == 50 and len({(r.sequence_id, r.offset) for r in out}) == 50


def test_packing_query(spark, data):
    from graphloom.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    used, tokens = check_packing(QUERIES["op6_packing"](spark, data).collect(), texts)
    assert used <= 1.1 * -(-tokens // 1024) + 1


def test_plan_uses_exact_complements_up():
    def total(histogram):
        planned = packing.plan(histogram, 100)
        left = dict(histogram)
        for parts, times in planned:
            assert sum(parts) <= 100 and times > 0
            for p in parts:
                left[p] -= times
        assert not any(left.values())
        return sum(t for _, t in planned)

    assert total({60: 5, 40: 5}) == 5
    assert total({50: 4}) == 2
    assert total({70: 3, 20: 3, 10: 3}) == 3
    assert total({55: 2, 25: 2, 15: 2, 5: 2}) == 2
    assert total({100: 7, 99: 1, 1: 1}) == 8
    assert total({}) == 0
    random.seed(1)
    for _ in range(20):
        h = {random.randint(1, 100): random.randint(1, 50) for _ in range(30)}
        assert total(h) >= -(-sum(k * v for k, v in h.items()) // 100)


def test_sums_are_indexed_under_their_counts():
    sums = packing.Sums(np.bincount([10, 20, 20, 30, 45], minlength=101))
    assert sums.exact(45, ()) == (45,) and sums.exact(75, ()) == (45, 30) and sums.exact(95, ()) == (45, 30, 20)
    assert sums.exact(40, ()) == (30, 10) and sums.exact(40, (10,)) == (20, 20) and sums.exact(40, (10, 20)) is None
    assert sums.use((20, 20)) == 1 and sums.exact(20, ()) is None and sums.exact(50, ()) is None and sums.fitting(44, (30,)) == 10
    for s in range(1, 101):  # against a search of all combinations
        random.seed(s)
        lengths = [random.randint(1, 60) for _ in range(6)]
        sums = packing.Sums(np.bincount(lengths, minlength=101))
        some = any(sum(c) == s for k in (1, 2, 3) for c in itertools.combinations(lengths, k))
        assert (sums.exact(s, ()) is not None) == some


def test_plan_is_close_to_the_bound():
    random.seed(3)
    h = {k: random.randint(1, 400) for k in range(1, 1024)}
    used = sum(t for _, t in packing.plan(h))
    # no two pieces over half a sequence go together
    assert used <= 1.002 * max(sum(k * v for k, v in h.items()) / 1024, sum(v for k, v in h.items() if k > 512)) + 1


def test_ids_of_long_mixed_and_special_texts_match_the_library():
    library = Tokenizer.from_file(BYTE)
    ids = packing.Ids(open(BYTE).read(), 2)
    long = "word, don't  stop\n\n at 12 gaps " * 70_000
    for text in ["", " ", "  a  b ", "a\x1cb \x1c c", "漢字 and words — “quoted” 🎉 x", "<|endoftext|> a<|endoftext|>", "a" * 300_000, " " * 200_001 + "x", long, "é漢 " * 2000]:
        assert list(ids.of(text)) == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_packing_splits_a_length_held_by_most_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    df = spark.createDataFrame([(None if i % 3 else i, "same text") for i in range(90)] + [(500, "word " * 5000)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = packing.pack(df, BYTE, tokens=True, keep=["lang"]).collect()
    assert len(out) == 95 and len({(r.sequence_id, r.offset) for r in out}) == 95 and {r.lang for r in out} == {"en"}
    by_seq = {}
    for r in out:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(places[-1]) <= 1024
