import random
import zlib

import corpus_pipeline
import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import sharding, simhash
from sparkloom.llm.components import components
from tests.llm.fixtures import none, odd, odd_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text, k):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(fps, bits):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= bits and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    return label


def test_fingerprints_and_components_match_brute_force(spark):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(odd(spark), words=3, bits=2).collect())
    rows = odd_rows()
    fps = [brute_fingerprint(r[1], 3) for r in rows]
    label = brute_components(fps, 2)
    least = {}
    for r, g in zip(rows, label):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    assert got == sorted((r[0] is not None, r[0] or 0, f, least.get(g)) for r, f, g in zip(rows, fps, label))


def test_links_lose_no_pair(spark):
    rnd = random.Random(5)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(8):
            y = x
            for _ in range(rnd.randint(1, 4)):
                y ^= 1 << rnd.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for bits in (1, 2, 3):
        got = {frozenset((r["a"], r["b"])) for r in simhash.pivot_links(df, bits).collect()}
        want = {frozenset((simhash._signed(a), simhash._signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= bits}
        assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 500 + i) for i in range(40)] + [(7, 7), (9, 8), (8, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, **{500 + i: 5 for i in range(40)}, 8: 8, 9: 8}


def test_keep_one_keeps_columns_and_one_row_of_each_component(spark):
    docs = odd(spark)
    kept = simhash.keep_one(docs, words=5, bits=3)
    assert kept.columns == docs.columns
    rows = kept.collect()
    want = len(set(brute_components([brute_fingerprint(r[1], 5) for r in odd_rows()], 3)))
    assert len(rows) == want
    assert sum(r["doc_id"] == 1 for r in rows) == 1 and not any(r["doc_id"] == 2 for r in rows)


def test_empty_tables(spark):
    assert simhash.near_duplicates(none(spark)).count() == 0
    assert simhash.keep_one(none(spark)).count() == 0
    assert sharding.lpt_shards(none(spark)).count() == 0


def test_shards_follow_the_greedy_rule(spark):
    rows = odd_rows()
    got = sharding.lpt_shards(odd(spark), shards=4).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((r[0] or -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    of_text = {}
    for r in got:
        assert of_text.setdefault(bytes(r["digest"]), r["shard"]) == r["shard"]
    for shard in range(4):
        slots = [r["slot"] for r in sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])]
        assert slots == list(range(len(slots)))
    groups = {}
    for r in rows:
        groups[r[1] or ""] = groups.get(r[1] or "", 0) + len((r[1] or "").encode()) + 1
    loads = [0] * 4
    for g in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += g
    assert sorted(r["b"] for r in spark.createDataFrame(got).groupBy("shard").agg(F.sum("size").alias("b")).collect()) == sorted(loads)


def test_deal_equals_one_by_one():
    rnd = random.Random(2)
    for _ in range(500):
        loads = [rnd.randint(0, 60) for _ in range(rnd.randint(1, 6))]
        want, size, count = list(loads), rnd.randint(1, 12), rnd.randint(0, 70)
        for _ in range(count):
            want[want.index(min(want))] += size
        got = list(loads)
        dealt = sharding._deal(got, size, count)
        assert sorted(got) == sorted(want) and sum(dealt) == count


def test_near_copies_of_similarity_four_fifths_are_found(spark):
    rnd = random.Random(12)
    texts = [prose(3000 + i, 60 + 20 * (i % 5)) for i in range(25)]
    for i in range(25):
        for edits in (1, 2, 3, 4):
            words = texts[i].split()
            for at in rnd.sample(range(len(words)), edits):
                words[at] = f"new{rnd.randint(0, 99)}"
            texts.append(" ".join(words))
    texts += [None, "", "one two", "One  two", "one two three"]
    sets = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    root, missed = list(range(len(texts))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            similar, close = 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]), (fps[a] ^ fps[b]).bit_count() <= 3
            missed += similar and not close
            if similar or close:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert missed > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == [i for i in range(len(texts)) if find(i) == i]


def test_bitmaps_never_say_less_than_what_is_shared():
    rnd = np.random.default_rng(5)
    for size in (1, 5, 31, 32, 33, 64, 500, 3000):
        for share in (0.0, 0.5, 0.8, 1.0):
            a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * share)], rnd.integers(0, 1 << 63, size - int(size * share) + 3).astype(np.uint64)]))
            most = simhash.most_shared(len(a), simhash.bitmap(a), len(b), simhash.bitmap(b))
            assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
            assert share > 0.5 or size < 31 or most * 9 < (len(a) + len(b)) * 4


def test_pairs_that_are_not_similar_do_not_carry_their_shingles(spark, monkeypatch):
    """Before, every pair that met over a shingle had both sets in its row, and each pair of a group of copies."""
    written, stash = {}, simhash.stash

    def seen(df, name):
        out = stash(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "stash", seen)
    shared = prose(1, 20)
    texts = [" ".join([shared, prose(100 + i, 30)]) for i in range(30)]
    long = prose(7, 200).split()
    texts += [" ".join([*long[:i], "other", *long[i + 1 :]]) for i in range(0, 120, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    links = simhash.shingle_links(stash(docs, "texts"), 5).collect()
    assert written["shingle-pairs"][0] >= 60 and written["shingle-sets"] == [12] and len(links) == 11
    assert {r["b"] for r in links} == set(range(31, 42)) and all(r["a"] >= 30 for r in links)
