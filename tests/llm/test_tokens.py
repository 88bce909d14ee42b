"""Encoding, decoding, counting and packing against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from heddle.llm import bpe_codec, packing, token_count

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktoken_encode():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return lambda name: Tokenizer.from_file(P.path(name))


def noise(n, seed):
    rnd = random.Random(seed)
    letters = list("ab stremvld'' \n\t　\x1c\x85é1²!%.ßß漢🙂́")
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(50))) for _ in range(n)] + ["a" * 900, "'s" * 90, " " * 99 + "x", "<|endoftext|>a<|endoftext|>", "x" * 49]


def test_codec_equals_library(tiktoken_encode):
    codec, texts = bpe_codec.Codec.of(RANKS, P.PATTERN), noise(800, 1)
    coded = codec.encode(texts)
    assert [" ".join(c) for c in coded] == [" ".join(map(str, tiktoken_encode(t))) for t in texts]
    assert codec.decode(coded) == [t.encode() for t in texts]


def test_long_words_equal_library(tiktoken_encode, monkeypatch):
    """Words above LONG_WORD, in runs, periods and at random; also with few rounds a query."""
    rnd = random.Random(7)
    texts = ["x" * 5000, "ab" * 900, "abc" * 333, "-" * 777, "é" * 300, " " * 1000 + "x", "the" * 500]
    texts += ["".join(rnd.choice(letters) for _ in range(n)) for letters, n in (("ab", 500), ("etaoin", 900), ("漢字東京日本語の", 200), ("=-_", 400))]
    texts += ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(47, 60))) for _ in range(60)]
    want = [" ".join(map(str, tiktoken_encode(t))) for t in texts]
    assert [" ".join(c) for c in bpe_codec.Codec(RANKS, P.PATTERN).encode(texts)] == want
    monkeypatch.setattr(bpe_codec, "KEPT_ROWS", 20_000)
    monkeypatch.setattr(bpe_codec, "LONG_ROWS", 1000)
    assert [" ".join(c) for c in bpe_codec.Codec(RANKS, P.PATTERN).encode(texts)] == want


def test_op1_edge_rows(edge, empty, tiktoken_encode):
    got = sorted(map(tuple, bpe_codec.round_trip(edge, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for r in edge.collect():
        ids = tiktoken_encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_codec.round_trip(empty, RANKS, P.PATTERN).count() == 0
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(edge, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in edge.collect())


def test_counter_equals_library(library):
    counter, texts = token_count.TokenCounter.of(P.path("byte_bpe_50k.json")), noise(800, 2)
    assert counter.counts(texts) == [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]


def test_chunk_maps_of_long_words(library):
    """Words of many chunks, also where the guessed start state of a chunk is wrong."""
    counter, rnd = token_count.TokenCounter.of(P.path("byte_bpe_50k.json")), random.Random(11)
    words = ["a" * n for n in (63, 64, 65, 128, 129, 1000)] + ["ab" * 400, "the" * 300, "é" * 200]
    words += ["".join(rnd.choice("etaoinshr") for _ in range(n)) for n in (64, 65, 127, 500, 2000)]
    t = library("byte_bpe_50k.json")
    assert [counter.counter.count(w.encode()) for w in words] == [len(t.encode(w, add_special_tokens=False).ids) for w in words]
    one = counter.counter
    for w in words:
        assert one.run(0, w.encode())[1] == one.count(w.encode())


def test_op6_edge_rows(edge, empty, library):
    t = library("byte_bpe_50k.json")
    got = sorted(map(tuple, token_count.count_tokens(edge, P.path("byte_bpe_50k.json")).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in edge.collect()]
    assert got == sorted(want, key=str)
    assert token_count.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_splitter_chunks_do_not_matter():
    s = token_count.Splitter()
    rnd = random.Random(4)
    classes = np.array([rnd.randrange(12) for _ in range(1000)], np.uint8)
    state, want = token_count.START, set()
    nxt, marks = token_count.split_table()
    for i, c in enumerate(classes):
        if marks[state, c] & token_count.HERE:
            want.add(i)
        if marks[state, c] & token_count.BACK1:
            want.add(i - 1)
        state = nxt[state, c]
    assert set(s.starts(classes).tolist()) == want


def check_packing(rows, docs, encode):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    got = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for d in docs:
        ids = np.array(encode(d.text or "").ids + [0], "<u4")
        want += [(str(d.doc_id), p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    assert got == sorted(want)
    return len(by)


def test_op10_edge_rows(edge, empty, library):
    t = library("word_bpe_49k.json")
    path = P.path("word_bpe_49k.json")
    rows = packing.pack(packing.pieces(edge, path)).collect()
    n = check_packing(rows, edge.collect(), lambda x: t.encode(x, add_special_tokens=False))
    assert n == -(-sum(r["length"] for r in rows) // 2048)
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_packing_of_many_blocks(spark, monkeypatch):
    """Several blocks, with elites that migrate: every piece once, and in each block about as few sequences as its sizes need."""
    monkeypatch.setattr(packing, "BLOCK", 60)
    rnd = random.Random(3)
    rows = [(i, 0, 0, rnd.choice([rnd.randrange(1, 400), rnd.randrange(500, 1100), 2048]), i) for i in range(500)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    seen = []
    epoch = packing._epoch

    def watched(frame, *rest):
        seen.append(frame.selectExpr("size(seeds) AS n", "block", "island").collect())
        return epoch(frame, *rest)

    monkeypatch.setattr(packing, "_epoch", watched)
    out = packing.pack(cut).collect()
    assert sorted((r.doc_id, r.length) for r in out) == sorted((r[0], r[3]) for r in rows)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    blocks = {x.block for x in seen[0]}
    least = -(-sum(r[3] for r in rows) // 2048)
    assert len(blocks) > 4 and least <= len(bins) <= least + 2 * len(blocks)
    assert len(seen) == packing.EPOCHS and {x.island for x in seen[0]} == set(range(packing.ISLANDS))
    assert all(x.n == 2 for x in seen[1])  # its own best and the one that came


def test_word_table_equals_library(library):
    texts = noise(500, 3) + ["İstanbul ΣΑΣ it's 'LL 12٣ \x85a\x1cb x"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library("word_bpe_49k.json").encode_batch(texts, add_special_tokens=False)]
    assert packing.WordTokenizer.of(P.path("word_bpe_49k.json")).encode(texts) == want


def test_evolution_is_no_worse_than_best_fit():
    rnd = random.Random(5)
    for _ in range(5):
        sizes = [rnd.randrange(200, 1400) for _ in range(300)]
        plain = packing.Packing([], []).add(sorted(range(300), key=sizes.__getitem__, reverse=True), sizes, 2048)
        best = packing.evolve(sizes, [], 2048, random.Random(1), 12)
        bins = np.bincount(best, weights=sizes)
        assert bins.max() <= 2048 and len(bins) <= len(plain.bins)
        child = packing.crossover(plain, packing.Packing.of(best, sizes, 2048), sizes, 2048, rnd)
        assert sorted(i for b in child.bins for i in b) == list(range(300))
