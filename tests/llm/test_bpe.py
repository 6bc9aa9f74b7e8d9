import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lithic.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.coder(open(PATH, "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(ours, theirs):
    rng = random.Random(6)
    bits = [*"abcdefghijklmnopqrstuvwxyz", *" \n\t.,'éñß中文字😀👩‍👩", "the", "ing", "'s", "  ", "123", "<|endoftext|>", " ", "и", "्"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        ids = ours.encode(text)
        assert ids == theirs.encode_ordinary(text), text
        assert ours.decode(ids).decode() == text


def test_every_token_and_pairs_of_tokens(ours, theirs):
    rng = random.Random(7)
    tokens = [b for b in ours.fst.ranks]
    for _ in range(20000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 3)))
        assert ours.fst.encode(piece) == theirs._encode_single_piece(piece)


def test_corpus_and_long_runs(ours, theirs, spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect():
        assert ours.encode(r.text) == theirs.encode_ordinary(r.text)
    for text in ("a" * 30_000, "ab" * 10_000, " " * 5_000 + "x", "中" * 3_000):
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_states_can_be_forgotten(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    text = " the quick brown foxes jumped over lazy dogs, whatever happens next"
    assert ours.encode(text) == theirs.encode_ordinary(text)
    assert len(ours.fst.states) < 400


def test_decoder_holds_unfinished_sequences(ours):
    text = "aé中😀z" * 3
    for size in (1, 2, 3):
        decoder, out = bpe.Decoder(ours.fst.bytes_of), []
        ids = [ours.fst.ranks[bytes([b])] for b in text.encode()]
        for at in range(0, len(ids), size):
            out.append(decoder.feed(ids[at : at + size]).decode())
        assert "".join(out) + decoder.end().decode() == text
    assert bpe.Decoder(ours.fst.bytes_of).unfinished(b"\x80\x80\x80") == 0


def test_query_rows(spark, theirs):
    texts = [None, "", "Hello wörld", "x " * 50_000, "Hello wörld"]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in queries.bpe_rows(docs).collect():
        ids = theirs.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert queries.bpe_rows(docs.limit(0)).count() == 0


def test_a_share_of_the_memory_gives_the_same_ids(monkeypatch):
    for name, most in (("STATES", 60), ("PIECES", 60), ("PAIRS", 60)):
        monkeypatch.setattr(bpe, name, most)
    raw, text = open(PATH, "rb").read(), " ".join(f"w{i}x{i * 7919} unlikelyword{i}" for i in range(300))
    whole, small = (bpe.Coder(bpe.read_ranks(raw), public_tokenizers.PATTERN, share) for share in (1.0, 0.1))
    assert small.encode(text) == whole.encode(text) and small.decode(small.encode(text)) == text.encode()
    for held, most in ((small.known, 6), (small.older, 6), (small.fst.newer, 6), (small.fst.older, 6)):
        assert len(held) <= most
    # states are dropped between pieces, so one piece may go beyond
    assert len(small.fst.states) < len(whole.fst.states)


def test_many_pieces_side_by_side(ours, theirs, monkeypatch):
    rng = random.Random(8)
    tokens = list(ours.fst.ranks)
    pieces = [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4))) for _ in range(5000)] + [bytes([b]) * n for b in (0, 97, 255) for n in (1, 2, 63)]
    assert ours.fst.encode_many(pieces) == [tuple(theirs._encode_single_piece(p)) for p in pieces]
    assert ours.fst.encode_many([]) == [] and ours.fst.encode_many([b"", b"ab"])[0] == ()
    bits = [*"abcdefghijklmnopqrstuvwxyz", *" \n\t.,'éñß中文字😀👩‍👩", "the", "ing", "'s", "  ", "123", " ", "и", "्", "x" * 70]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for together, pieces in ((1 << 15, 10**6), (7, 20)):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        monkeypatch.setattr(ours, "pieces", pieces)
        assert ours.encode_many(texts) == [theirs.encode_ordinary(t) for t in texts]


def test_new_pieces_make_no_states():
    rng = random.Random(9)
    fresh = bpe.Coder(bpe.read_ranks(open(PATH, "rb").read()), public_tokenizers.PATTERN)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(3000))
    ids = fresh.encode_many([text])[0]
    assert len(fresh.fst.states) < 100  # one by one they make more than 10,000
    assert ids == fresh.encode(text) and fresh.decode(ids).decode() == text
    assert bpe.Coder(bpe.read_ranks(open(PATH, "rb").read()), public_tokenizers.PATTERN).encode(text) == ids
