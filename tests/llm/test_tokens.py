import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparkloom.llm import bpe, token_files
from tests.llm.fixtures import none, odd, odd_rows

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec(open(MULTI, "rb").read(), P.PATTERN)


def test_random_texts_equal_the_library(codec, reference):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab  \n\t eéß日本🙂'sre12_-  .aeinrst") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_long_pieces_are_linear_and_exact(codec, reference):
    for text in ("ab" * 20000, "thequick" * 3000, " " * 9999, "é" * 5000):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_memo_that_overflows_changes_nothing(reference):
    codec = bpe.BpeCodec(open(MULTI, "rb").read(), P.PATTERN)
    codec.memo.entries = 3
    for text in ("one two three four five", "five four one. two, x"):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_over_a_table(spark, reference):
    rows = {(r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_encode(odd(spark), MULTI, P.PATTERN).collect()}
    want = set()
    for r in odd_rows():
        ids = reference.encode_ordinary(r[1] or "")
        want.add((r[0] or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert rows == want
    assert bpe.encode_documents(none(spark)).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1001):
        x = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(x), n) == x).all()


def test_token_files_round_trip(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    files = token_files.write_token_files(odd(spark), P.path("byte_bpe_50k.json"), P.PATTERN, end_id=2)
    got = sorted(token_files.read_token_files(*files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] or -1 for r in got] == sorted(r[0] or -1 for r in odd_rows())
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    want = sorted((r[0] or -1, zlib.crc32(np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in odd_rows())
    assert sorted((r["doc_id"] or -1, zlib.crc32(bytes(r["ids"]))) for r in got) == want
    empty = token_files.write_token_files(none(spark), P.path("byte_bpe_50k.json"), P.PATTERN, end_id=2)
    assert token_files.read_token_files(*empty).count() == 0


def test_special_token_strings_go_to_the_library_whole():
    content = open(P.path("byte_bpe_50k.json")).read()
    library = Tokenizer.from_str(content)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain text here"]
    for text, ids in zip(texts, token_files.LibraryEncoder(content, P.PATTERN).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_the_codec_keeps_a_smaller_memo_of_its_own(monkeypatch):
    """Before, the codec's memo had the room of the shared default. One that is emptied again and again gives the same ids."""
    import public_tokenizers

    from sparkloom.llm import bpe, pieces

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        content = f.read()
    texts = [" ".join(f"w{i}x{j} Word{j}." for j in range(40)) for i in range(60)]
    large = bpe.BpeCodec(content, public_tokenizers.PATTERN)
    assert large.memo.entries == bpe.MEMO_ENTRIES < pieces.MEMO_ENTRIES
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 100)
    small = bpe.BpeCodec(content, public_tokenizers.PATTERN)
    assert [small.encode([t])[0] for t in texts] == large.encode(texts)
    assert len(small.memo.cuts) <= 100 + 82
