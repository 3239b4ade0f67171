import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkloom.llm import cross_tokens
from tests.llm.fixtures import none, odd, odd_rows, prose

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(libraries, rows):
    """Both libraries on whole texts, and all links counted."""
    a, b = libraries
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in letters]
    back = {chr(x): x for x in letters} | {chr(256 + i): x for i, x in enumerate(rest)}
    aligned = []
    for _, text in rows:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        want = (" " + (text or "")).encode()
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            aligned.append(None)
            continue
        ends = []
        for ids, raws in ((ids_a, raw_a), (ids_b, raw_b)):
            n, own = 0, {}
            for i, r in zip(ids, raws, strict=True):
                n += len(r)
                own[n] = i
            ends.append(own)
        groups, last = [], 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            groups.append([[i for e, i in own.items() if last < e <= end] for own in ends])
            last = end
        aligned.append((len(ids_a), len(ids_b), groups, [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]))
    counts = Counter(link for x in aligned if x for link in x[3])
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for (doc, _), x in zip(rows, aligned, strict=True):
        if x is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in x[2])
        out.append((doc, x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str), {(*p, n, n == best[p[1]]) for p, n in counts.items()}


def test_random_texts_equal_the_libraries(spark, libraries, monkeypatch):
    """White space of all kinds in runs, bytes, the meta character, strings of special tokens, scripts without spaces; several blocks."""
    monkeypatch.setattr(cross_tokens, "BLOCK_BYTES", 4000)
    rnd = random.Random(5)
    bits = ["the ", "Word", " \n", "\n\n", "\t", "\r\n", "  ", "    ", " ", "　", "\x1c", "\x85", "\x01", "\x00", "!\x1f ", "é", "日本語", "🙂", "<|endoftext|>", "<s>", "</s> ", "<0x0A>", "'s ", "12", ");\r\n", ". ", "ſ", "ﬁ", "é"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))) for i in range(400)]
    rows += [(1000, "a ▁b"), (1001, "▁"), (1002, " "), (1003, "   "), (1004, "\n"), (1005, " lead"), (1006, "x" * 3000), (1007, "ab " * 2000), (1008, prose(5, 400)), (1009, prose(5, 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out, pairs = cross_tokens.align_tokens(docs, A, B)
    want, want_pairs = brute(libraries, rows)
    got = out.collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == want
    assert {tuple(r) for r in pairs.collect()} == want_pairs
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["n_a"])


def test_odd_rows_and_none(spark, libraries):
    out, _ = cross_tokens.align_tokens(odd(spark), A, B, with_groups=False)
    assert sorted((tuple(r)[:8] for r in out.collect()), key=str) == brute(libraries, [(r[0], r[1]) for r in odd_rows()])[0]
    out, pairs = cross_tokens.align_tokens(none(spark), A, B)
    assert out.count() == 0 and pairs.count() == 0


def test_what_is_cut_is_verified():
    """Pieces that run over a carriage return forbid a cut before it; spaces, tabs and line ends are free."""
    aligner = cross_tokens.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    assert aligner.cuts == " \n\t"
    pieces, starts, sizes = aligner.segments(["one two\nthree\r\nfour  five", "a b"])
    got = [pieces.to_pylist()[s : s + n] for s, n in zip(starts, sizes, strict=True)]
    assert got == [[" one", " two", "\nthree\r\nfour", "  five"], [" a", " b"]]
