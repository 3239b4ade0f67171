import math
import random
import re
from collections import Counter

import pytest

from sparkloom.operators import relational as R


@pytest.mark.parametrize("sure", [0, 3, 10_000])
def test_pruned_search_equals_scoring_all(spark, sure):
    """Rare and frequent words, repeated documents (ties), empty and null texts, words that no document holds; however much is pruned."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(0, 40)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "W0 w0, w1"), (1003, "W0 w0, w1")]
    queries = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 6)))) for i in range(12)] + [(50, "w0 w1"), (51, "nothing"), (52, "w0 w0 w55"), (53, "")]
    tokens = {d: [w for w in re.split(r"\W+", (t or "").lower()) if w] for d, t in docs}
    tokens = {d: x for d, x in tokens.items() if x}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(w for x in tokens.values() for w in set(x))
    want = set()
    for q, text in queries:
        scores = {}
        for d, x in tokens.items():
            tf = Counter(x)
            hits = [w for w in set(text.lower().split()) if tf[w]]
            if hits:
                scores[d] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 1.9 / (tf[w] + 0.9 * (0.6 + 0.4 * len(x) / mean)) for w in hits), 9)
        best = sorted(scores, key=lambda d: (-scores[d], d))[:5]
        want |= {(q, d, rank) for rank, d in enumerate(best, 1)}
    out = R.bm25(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(queries, "q long, text string"), 5, "doc", "q", "text", sure=sure)
    assert out.columns == ["q", "doc", "score", "rank"]
    assert {(r["q"], r["doc"], r["rank"]) for r in out.collect()} == want
