import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import suffix_array
from tests.llm.fixtures import none, odd, odd_rows, prose


def brute(texts, least):
    """For each text: bytes, removed bytes, spans, digest of what is kept; all strings are counted."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                gone[i : i + least] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, least):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [tuple(r)[1:5] for r in suffix_array.drop_repeats(docs, least).orderBy("doc_id").collect()]


@pytest.mark.parametrize("least", [32, 47, 200])
def test_passages_and_edges_equal_brute_force(spark, least):
    """Shared passages cut at any place, near copies, chains of partners, strings of exactly the least length and one less."""
    rnd = random.Random(least)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passage, texts = fresh(200), []
    for _ in range(25):
        a = rnd.randint(0, 400)
        texts.append(fresh(rnd.randint(0, 40)) + passage[a : a + rnd.randint(10, 3 * least)] + fresh(rnd.randint(0, 40)))
    base = fresh(150)
    for _ in range(12):
        at = rnd.randint(0, len(base) - 1)
        texts.append(base[:at] + rnd.choice("XYZ") + base[at + 1 :])
    exact = "".join(rnd.choice("0123456789") for _ in range(least))
    texts += [f"p{exact}q", f"r{exact}s", f"t{exact[1:]}u", f"v{exact[:-1]}w", "a" * (least + 40), "ab" * least, "ab" * (least - 3) + "b", "", None, "x"]
    assert run(spark, texts, least) == brute(texts, least)


def test_odd_rows(spark):
    out = suffix_array.drop_repeats(odd(spark), 60)
    texts = [r[1] for r in odd_rows()]
    want = sorted((r[0] is not None, r[0] or 0, *b) for r, b in zip(odd_rows(), brute(texts, 60), strict=True))
    got = out.collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *tuple(r)[1:5]) for r in got) == want
    for r in got:  # the spans and the kept bytes are those of the digest
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
    assert suffix_array.drop_repeats(none(spark)).count() == 0


def test_parts_of_long_texts(spark, monkeypatch):
    """A text of many parts gives what it gives in one."""
    a, b = prose(50, 1500), prose(51, 300)
    texts = [a[:3000] + b + a[3000:], b[100:900] + prose(52, 100), a[4000:4700]]
    monkeypatch.setattr(suffix_array, "PART_BYTES", 500)
    rows = [(i, 0, t.encode()) for i, t in enumerate(texts)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows])], ["row", "text"])
    for held in suffix_array._parts(iter([batch]), 200):
        assert sum(len(h[2]) for h in held) < 1500
    starts = Counter((h[0], h[1] + i) for held in suffix_array._parts(iter([batch]), 200) for h in held for i in range(len(h[2]) - 199))
    assert starts == Counter((i, k) for i, t in enumerate(texts) for k in range(len(t.encode()) - 199))
    assert run(spark, texts, 200) == brute(texts, 200)


def test_strings_below_the_least_length_are_refused(spark):
    with pytest.raises(ValueError):
        suffix_array.drop_repeats(none(spark), 20)
