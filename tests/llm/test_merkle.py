import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import merkle
from sparkloom.llm.queries import ORACLE_SQL
from tests.llm.fixtures import none, odd, odd_rows


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(hashes, fanout):
    """The root, and for each leaf (hashes on its left, on its right) level by level."""
    ways, own, now = [[] for _ in hashes], [[i] for i in range(len(hashes))], list(hashes)
    while len(now) > 1:
        above, under = [], []
        for a in range(0, len(now), fanout):
            run = now[a : a + fanout]
            for j in range(len(run)):
                for leaf in own[a + j]:
                    ways[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(h("".join(run)))
            under.append(sum(own[a : a + fanout], []))
        now, own = above, under
    return now[0], ways


def brute(rows, fanout=2):
    """rows: doc_id, source, lang, n_chars, text."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = {}
    for d, source, lang, n, text in rows:
        leaf = h("".join(map(field, (d, source, lang, n, text))))
        tampered = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        changed = h("".join(map(field, (d, source, lang, None if n is None else n + 1, text)))) if tampered else leaf
        groups.setdefault(lang, []).append((d is not None, d or 0, leaf, changed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g])], fanout) for g in order]
    if not trees:
        return []
    root, upper = tree([t[0] for t in trees], fanout)
    out = []
    for g, (sub, ways), over in zip(order, trees, upper, strict=True):
        for (there, d, leaf, changed), way in zip(sorted(groups[g]), ways, strict=True):
            folded = changed
            for a, b in way + over:
                folded = h(a + folded + b)
            out.append((d if there else None, leaf, sub, root, h("".join(a + b for a, b in way + over)), folded, folded == root))
    return sorted(out, key=str)


def pick(rows):
    return [(r[0], r[3], r[2], r[4], r[1]) for r in rows]


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_odd_rows_equal_brute_force(spark, fanout):
    out = merkle.merkle_manifest(odd(spark), fanout)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(pick(odd_rows()), fanout)


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1], [2, 1], [9, 4, 1, 1, 7], [33]])
def test_all_shapes_of_trees(spark, sizes):
    rows = [(10 * k + 1000 * g, "s", None if g == 0 else f"l{g}", k, f"text {k}") for g, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert sorted(map(tuple, merkle.merkle_manifest(docs).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert merkle.merkle_manifest(none(spark)).count() == 0
    assert merkle.build(merkle.document_leaves(none(spark)), [F.col("doc_id")]).root is None


def test_every_change_is_found(spark):
    """Any altered leaf leads to another root; the leaf as it is leads to the root."""
    leaves = merkle.document_leaves(odd(spark))
    manifest = merkle.build(leaves, [F.col("doc_id").asc_nulls_first(), F.col("h")])
    ways = merkle.proofs(manifest)
    good, bad = merkle.fold(F.col("h"), F.col("proof")), merkle.fold(F.sha2(F.col("h"), 256), F.col("proof"))
    assert {tuple(r) for r in ways.select(good == manifest.root, bad == manifest.root).collect()} == {(True, False)}


def test_sql_on_odd_rows(spark, tmp_path):
    """Nulls, repeated ids, a row twice: the SQL gives the rows of the operator."""
    odd(spark).select("doc_id", "source", "lang", "n_chars", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = con.execute(ORACLE_SQL["op13_merkle"])
    assert sorted(result.fetchall(), key=str) == brute(pick(odd_rows()))
