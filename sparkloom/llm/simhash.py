"""SimHash near-duplicates, found with pivot distance tables.

A fingerprint's row in a pivot table holds its Hamming distances to reference
fingerprints ("pivots"). Two fingerprints within r bits differ by r at most in every
such coordinate. Tables over parts of the fingerprint make this a join: of
``r + s`` blocks of bits, r differing bits leave at least s blocks untouched, so over
the bits of some s blocks all pivot distances are equal. Each table joins on its
whole row of coordinates, the pairs met there are discarded if a coordinate over all
64 bits differs by more than r, and what survives is verified bit by bit. No link is
lost, and nothing is compared that does not share a row.

keep_one() also links texts by the Jaccard similarity of their shingles, with an exact
set-similarity join.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import cleaned, settle, small_batches, stash, table, trim, unstash
from sparkloom.llm.components import components

SEED = 42
#: Pivots of each table that is joined on, and of the table over all bits that discards.
TABLE_PIVOTS = 16
FILTER_PIVOTS = 12
#: Least Jaccard similarity of shingle sets: NUMERATOR / DENOMINATOR. Rarity of shingles is counted in so many hash buckets.
NUMERATOR, DENOMINATOR = 4, 5
BUCKETS = 1 << 18


def shingles(text: str | None, words: int) -> np.ndarray:
    """The XXH64 hashes of the word shingles of a text (A-Z lower-cased), in order. A shorter text is one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of the word shingles of a text, repeats counted."""
    return simhash(shingles(text, words))


def simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096].astype("<u8")
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows: the id and fp (long, the 64 bits of the fingerprint), in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], ["_id", "fp"])

    return rows.mapInArrow(run, f"_id {kind}, fp long").withColumnRenamed("_id", id_col)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_links(fps: DataFrame, bits: int = 2, agreeing: int = 3) -> DataFrame:
    """fps: fp long, distinct. Rows: a, b long, a < b, for every pair that differs in 1 to ``bits`` bits.

    bits + agreeing blocks make comb(bits + agreeing, agreeing) tables. A row of a table
    is met by few other fingerprints; where many share one (a large group of near copies)
    the sort-merge join splits it, and only verified links leave the join.
    """
    rng = random.Random(SEED)
    blocks = bits + agreeing
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block_masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(m) for m in combinations(block_masks, agreeing)]
    fp = F.col("fp")

    def distance(pivot: int, mask: int):
        return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot & mask))).bitwiseAND(F.lit(_signed(mask)))).cast("long")

    def packed(pivots: list[int], mask: int):
        """Coordinates (0 to 64, seven bits each), eight to a long."""
        out = []
        for at in range(0, len(pivots), 8):
            word = F.lit(0).cast("long")
            for k, p in enumerate(pivots[at : at + 8]):
                word = word + F.shiftleft(distance(p, mask), 7 * k)
            out.append(word)
        return out

    # The row of coordinates is joined on by a hash of it and of the table's number; equal rows always meet.
    rows = F.array(*[F.xxhash64(F.lit(t), *packed([rng.getrandbits(64) for _ in range(TABLE_PIVOTS)], m)) for t, m in enumerate(masks)])
    whole = packed([rng.getrandbits(64) for _ in range(FILTER_PIVOTS)], (1 << 64) - 1)
    table_rows = fps.select("fp", *[w.alias(f"w{i}") for i, w in enumerate(whole)], F.explode(rows).alias("row"))
    a, b = table_rows.alias("a"), table_rows.alias("b")
    near = None
    for k in range(FILTER_PIVOTS):
        side = [F.shiftright(F.col(f"{s}.w{k // 8}"), 7 * (k % 8)).bitwiseAND(F.lit(127)) for s in "ab"]
        one = F.abs(side[0] - side[1]) <= bits
        near = one if near is None else near & one
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits
    joined = a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.fp") < F.col("b.fp")) & near & exact)
    return joined.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _classes(rows: DataFrame, bits: int) -> DataFrame:
    """rows: fp and id. Per distinct fp: least (id), component_id, links."""
    classes = stash(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    links = stash(pivot_links(classes.select("fp"), bits).distinct(), "fingerprint-links")
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnsRenamed({"node": "fp", "component": "root"})
    members = classes.join(found, "fp").select("fp", "least", "root")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(least, "root").select("fp", "component_id").join(degree, "fp")
    return classes.join(linked, "fp", "left").select("fp", "least", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id (cast to long), fp long, component_id long, links long.

    Two rows are linked if their fingerprints differ in ``bits`` bits at most; the
    component_id is the smallest id reachable over links. links counts the other
    distinct fingerprints that a row's own one is linked to. Exact copies, and all rows
    without a word (fingerprint 0), share a fingerprint and are linked by it. Null
    and empty texts count as having no word. Rows with a null id take part; a component
    of such rows only has a null component_id. Repeated rows each give a row. Other
    columns are not read. An empty table gives no rows.

    Only fingerprints and ids are shuffled. Equal fingerprints are merged before
    the join, so groups of copies of any size count as one.
    """
    rows = stash(fingerprints(docs, words, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), "fp"), "fingerprints")
    # Written, so that the join can split a fingerprint that very many rows share.
    placed = stash(_classes(rows, bits).select("fp", "component_id", "links"), "fingerprint-components")
    return rows.join(placed, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "links")


def _rarity(texts: DataFrame, words: int) -> np.ndarray:
    """For each bucket of shingles a class from its count, two classes to each doubling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held += np.bincount((shingles(text, words) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS) if text else 0
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["bucket", "n"])

    with cleaned(texts.sparkSession):
        found = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return (2 * np.log2(counts + 1)).astype(np.uint8)


def bitmap(own: np.ndarray) -> bytes:
    """One bit for each of the shingles, among two to four times as many (64 at least)."""
    bits = 1 << max(6, (2 * len(own) - 1).bit_length())
    held = np.zeros(bits, np.uint8)
    held[(own & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(held, bitorder="little").tobytes()


def most_shared(an: int, amap: bytes, bn: int, bmap: bytes) -> int:
    """At most so many shingles are in both sets, by their sizes and bitmaps. A longer bitmap is folded to the length of the other."""
    x, y = (np.frombuffer(m, np.uint8) for m in (amap, bmap))
    least = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(m.reshape(-1, least), axis=0) for m in (x, y))
    return min(an - int(np.bitwise_count(x & ~y).sum()), bn - int(np.bitwise_count(y & ~x).sum()))


def _asked(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    return texts.select("row", "text").join(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "row", "left_semi")


def shingle_links(texts: DataFrame, words: int) -> DataFrame:
    """texts: row long, text. Rows: a, b long, a < b: pairs whose sets of shingles have the least similarity or more.

    Every such pair is in one component of what is returned; pairs within a component that other links already make are not all listed.

    Shingles are ordered by rarity, so such sets share one among their first ones
    (prefix filter). Pairs met there are dropped by their sizes and by the places of the
    shared shingle and by bitmaps, and verified on all shingles. Sets should be distinct. A written table of texts is removed as soon as nothing reads it any more.
    """
    spark = texts.sparkSession
    classes = spark.sparkContext.broadcast(_rarity(texts.select("text"), words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = classes.value
        for batch in batches:
            parts = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.unique(shingles(text, words))
                n = len(own)
                if n:
                    first = own[np.argsort(rarity[(own & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")][: n + (-n * NUMERATOR) // DENOMINATOR + 1]
                    parts.append((first.view(np.int64), np.full(len(first), row), np.arange(len(first)) | n << 32))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], ["token", "row", "place"])

    tokens = stash(texts.select("row", "text").mapInArrow(prefixes, "token long, row long, place long"), "shingle-prefixes")
    a, b = tokens.alias("a"), tokens.alias("b")
    an, bn = (F.shiftright(F.col(f"{s}.place"), 32) for s in "ab")
    ap, bp = (F.col(f"{s}.place").bitwiseAND(F.lit((1 << 32) - 1)) for s in "ab")
    sizes = (an * DENOMINATOR >= bn * NUMERATOR) & (bn * DENOMINATOR >= an * NUMERATOR)
    # overlap / (an + bn - overlap) >= NUMERATOR / DENOMINATOR; the place counts from the least shared shingle on, which is met as well.
    enough = F.least(an - ap, bn - bp) * (NUMERATOR + DENOMINATOR) >= (an + bn) * NUMERATOR
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.row") < F.col("b.row")) & sizes & enough)
    pairs = stash(met.select(F.col("a.row").alias("a"), F.col("b.row").alias("b")).distinct(), "shingle-pairs")
    unstash(tokens)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingles(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([bitmap(x) for x in own], pa.binary())], ["row", "n", "map"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            an, am, bn, bm = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [most_shared(*row) * (NUMERATOR + DENOMINATOR) >= (row[0] + row[2]) * NUMERATOR for row in zip(an, am, bn, bm, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingles(t, words)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["row", "own"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared * (NUMERATOR + DENOMINATOR) >= (len(x) + len(y)) * NUMERATOR)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Pairs meet by bitmaps first, of a thirtieth of the size: few of those that are not similar carry their shingles through a shuffle.
    told = stash(_asked(texts, pairs).mapInArrow(maps, "row long, n long, map binary"), "shingle-maps")
    side = lambda t, s: t.withColumnsRenamed({c: s if c == "row" else f"{s}_{c}" for c in t.columns})
    near = pairs.join(side(told, "a"), "a").join(side(told, "b"), "b").select("a", "b", "a_n", "a_map", "b_n", "b_map")
    near = stash(near.mapInArrow(close, "a long, b long"), "shingle-close")
    unstash(pairs)
    unstash(told)
    known = stash(_asked(texts, near).mapInArrow(sets, "row long, own binary"), "shingle-sets")
    unstash(texts)
    # Rows that links have brought together need no further one: a row's first pair goes ahead, and of the others those between components follow.
    verify = lambda t: t.join(side(known, "a"), "a").join(side(known, "b"), "b").select("a", "b", "a_own", "b_own").mapInArrow(similar, "a long, b long")
    first = stash(verify(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), "shingle-links")
    held = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))
    root = lambda s: held.withColumnsRenamed({"node": s, "component": f"{s}_root"})
    apart = near.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    rest = stash(verify(apart), "shingle-links")
    unstash(near)
    unstash(known)
    return first.unionByName(rest)


def keep_one(docs: DataFrame, words: int = 5, bits: int = 3, id_col: str = "doc_id", text_col: str = "text", similar: bool = False) -> DataFrame:
    """docs, all columns, with one row of each component: the one with the least id (null last), of repeated ids one row.

    Two rows are linked if their fingerprints differ in ``bits`` bits at most; with ``similar`` also if their sets of shingles have a Jaccard similarity of NUMERATOR /
    DENOMINATOR or more.
    The rows are written once with their fingerprints; what is joined afterwards is
    numbers of rows, and the shingles that may link them.
    """
    settle(docs.sparkSession)
    small_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.monotonically_increasing_id().alias("row"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            hashes = [shingles(t, words) for t in batch.column(0).field(at).to_pylist()]
            fps = np.array([simhash(h) for h in hashes], np.uint64)
            keys = [xxhash.xxh128_digest(np.unique(h).tobytes()) for h in hashes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64), pa.int64()), pa.array(keys, pa.binary())], ["whole", "row", "fp", "key"])

    fields = [*packed.schema.fields, T.StructField("fp", T.LongType()), T.StructField("key", T.BinaryType())]
    rows = stash(packed.mapInArrow(run, T.StructType(fields)), "fingerprinted")
    order = F.struct(F.col("whole")[id_col].isNull().alias("none"), F.col("whole")[id_col].cast("long").alias("id"), F.col("row").alias("row"))
    # Rows with the same shingles are one node, which the least of them stands for.
    nodes = stash(rows.select("fp", "key", order.alias("id")).groupBy("fp", "key").agg(F.min("id").alias("id")), "shingle-classes")
    by_print = stash(_classes(nodes, bits).select("fp", F.col("component_id").alias("least")), "fingerprint-nodes")
    to_least = lambda t, k: nodes.join(t, k).select(F.col("id.row").alias("u"), F.col("least.row").alias("v")).where("u <> v")
    links = to_least(by_print, "fp")
    if similar:
        by_set = stash(nodes.groupBy("key").agg(F.min("id").alias("least")), "shingle-nodes")
        asked = rows.select("row", F.col("whole")[text_col].cast("string").alias("text")).join(by_set.select("least.row"), "row", "left_semi")
        # Written once: the texts would else be shuffled again for each pass over them.
        asked = stash(asked, "shingle-texts")
        by_shingles = shingle_links(asked, words)
        links = links.unionByName(to_least(by_set, "key")).unionByName(by_shingles.withColumnsRenamed({"a": "u", "b": "v"}))
    links = stash(links, "near-links")
    found = components(links)
    members = stash(nodes.select("id").join(found, F.col("id.row") == F.col("node")), "near-members")
    unstash(links)
    unstash(by_print)
    least = members.groupBy("component").agg(F.min("id").alias("least")).select("least.row")
    kept = nodes.select("id.row").join(members.select("id.row"), "row", "left_anti").unionByName(least)
    return rows.join(kept, "row", "left_semi").select("whole.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links")
