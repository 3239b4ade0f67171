"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Documents and benchmark items meet over seeds, runs of MIN_MATCH words that both
hold. For each such pair the longest common runs of words are marked first, none
twice, down to MIN_MATCH words, whatever their order. The share of an item's words
that are marked (its coverage) decides, so passages with their sentences in another
order count like passages copied straight.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import small_batches, stash, table, unstash

MIN_MATCH = 5
COVERAGE = 0.6
#: Bytes of benchmark text that are broadcast at most.
BLOCK_BYTES = 4 << 20
#: Places of the filter of seeds in a larger benchmark's join.
FILTER_PLACES = 1 << 23

_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_BASE, _MODULUS = 1_000_003, (1 << 61) - 1


def words_of(text: str | None) -> list[bytes]:
    """Words, lower-cased, without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _MARKS).split()


def tile(pattern: list[int], text: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiles (start in pattern, start in text, length), longest first; numbers below 0 match nothing."""
    free_p, free_t = [x >= 0 for x in pattern], [x >= 0 for x in text]
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(len(pattern), len(text)))
    while True:
        found, longest = _scan(pattern, text, free_p, free_t, length)
        if longest > 2 * length:
            length = longest
            continue
        for size, p, t in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_p[p : p + size]) and all(free_t[t : t + size]):
                free_p[p : p + size] = [False] * size
                free_t[t : t + size] = [False] * size
                tiles.append((p, t, size))
        # A match that a longer one has cut short may still be long enough: look again at this length.
        if any(all(free_p[p + k : p + k + length]) and all(free_t[t + k : t + k + length]) for size, p, t in found for k in range(size - length + 1)):
            continue
        if length == least:
            return tiles
        length = max(least, length // 2 if length > 2 * least else length - 1)


def _windows(row: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Start and rolling hash of each run of free places."""
    top = pow(_BASE, length - 1, _MODULUS)
    value = run = 0
    for i, x in enumerate(row):
        if not free[i]:
            value = run = 0
            continue
        if run == length:
            value = (value - (row[i - length] + 1) * top) % _MODULUS
            run -= 1
        value = (value * _BASE + x + 1) % _MODULUS
        run += 1
        if run == length:
            yield i - length + 1, value


def _scan(pattern, text, free_p, free_t, length) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal matches of at least this length (length, pattern start, text start), and the longest length."""
    at = defaultdict(list)
    for t, value in _windows(text, free_t, length):
        at[value].append(t)
    found, longest = [], 0
    for p, value in _windows(pattern, free_p, length):
        for t in at.get(value, ()):
            if p and t and free_p[p - 1] and free_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # not maximal to the left: part of a match that starts before
            size = 0
            while p + size < len(pattern) and t + size < len(text) and free_p[p + size] and free_t[t + size] and pattern[p + size] == text[t + size]:
                size += 1
            if size >= length:
                found.append((size, p, t))
                longest = max(longest, size)
    return found, longest


class SeedIndex:
    """The items of one block: their words by number, and where each seed stands."""

    def __init__(self, items: list[tuple[object, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[object, list[int]]] = []
        postings = defaultdict(set)
        for item_id, text in items:
            row = [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
            if len(row) < MIN_MATCH:
                continue
            for value in self.hashes(np.array(row, np.int64)).tolist():
                postings[value].add(len(self.items))
            self.items.append((item_id, row))
        self.seeds = np.array(sorted(postings), np.uint64)
        self.by_seed = [sorted(postings[x]) for x in self.seeds.tolist()]

    @staticmethod
    def hashes(row: np.ndarray) -> np.ndarray:
        """A number for each run of MIN_MATCH words."""
        n = len(row) - MIN_MATCH + 1
        value = np.zeros(max(n, 0), np.uint64)
        for k in range(MIN_MATCH):
            value = (value * np.uint64(0x9E3779B97F4A7C15)) ^ (row[k : k + n].astype(np.uint64) + np.uint64(k + 1))
            value ^= value >> np.uint64(29)
        return value

    def coverages(self, words: list[bytes]) -> list[tuple[object, float]]:
        """Items that share a seed with a document, with the share of their words that is tiled."""
        n = len(words)
        if n < MIN_MATCH or not len(self.seeds):
            return []
        get = self.numbers.get
        row = np.fromiter((get(w, -1) for w in words), np.int64, n)
        known = np.concatenate([[0], np.cumsum(row >= 0)])
        starts = np.flatnonzero(known[MIN_MATCH:] - known[:-MIN_MATCH] == MIN_MATCH)
        if not len(starts):
            return []
        values = self.hashes(row)[starts]
        at = np.minimum(np.searchsorted(self.seeds, values), len(self.seeds) - 1)
        hit = self.seeds[at] == values
        by_item = defaultdict(list)
        for start, seed in zip(starts[hit].tolist(), at[hit].tolist(), strict=True):
            for item in self.by_seed[seed]:
                by_item[item].append(start)
        out = []
        for item, places in sorted(by_item.items()):
            item_id, pattern = self.items[item]
            # Only words inside a seed of this item can be in a match; runs of them are kept apart by -1.
            text, last = [], -1
            for start in places:
                if start > last:
                    text.append(-1)
                    text += row[start : start + MIN_MATCH].tolist()
                else:
                    text += row[last : start + MIN_MATCH].tolist()
                last = start + MIN_MATCH
            out.append((item_id, sum(size for _, _, size in tile(pattern, text)) / len(pattern)))
        return out


def _leak_type(item_kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", item_kind), T.StructField("coverage", T.DoubleType())]))


def _order(leak: dict) -> tuple:
    return (-leak["coverage"], leak["item_id"] is not None, leak["item_id"])


_INDEXES: dict[str, SeedIndex] = {}


def _index(key: str, items: list[tuple[object, str]]) -> SeedIndex:
    """One index in each Python worker, kept between tasks."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = SeedIndex(items)
    return _INDEXES[key]


def _from_broadcast(docs: DataFrame, items: list[tuple[object, str]], text_col: str, threshold: float, name: str, kind: T.ArrayType) -> DataFrame:
    """A benchmark of BLOCK_BYTES at most goes to every worker; there is no shuffle."""
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            leaks = [sorted(({"item_id": i, "coverage": c} for i, c in index.coverages(words_of(t)) if c >= threshold), key=_order) for t in texts]
            last = batch.column(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(leaks, last.type)], schema=batch.schema)

    empty = docs.withColumn(name, F.array().cast(kind))
    return empty.mapInArrow(run, empty.schema)


def _seeds(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of all runs of MIN_MATCH words."""
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + MIN_MATCH])) for i in range(len(words) - MIN_MATCH + 1)], np.uint64))


def _from_join(docs: DataFrame, benchmark: DataFrame, text_col: str, threshold: float, name: str, kind: T.ArrayType) -> DataFrame:
    """A larger benchmark meets the documents in a join over seeds; only pairs that share one are tiled. benchmark: item, text.

    A filter of fixed size keeps out most seeds that no item has.
    """
    spark = docs.sparkSession
    rows = stash(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.monotonically_increasing_id().alias("row")), "tiling-rows")
    texts = rows.select("row", F.col("whole")[text_col].cast("string").alias("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value if shared is not None else None
        for batch in batches:
            parts = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _seeds(words_of(text))
                found = found if marked is None else found[marked[(found & np.uint64(FILTER_PLACES - 1)).astype(np.int64)]]
                parts.append((np.full(len(found), row), found.view(np.int64)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], ["row", "seed"])

    shared = None
    items = stash(benchmark.select(F.monotonically_increasing_id().alias("row"), "item", "text"), "tiling-items")
    item_seeds = stash(items.select("row", "text").mapInArrow(seeds, "row long, seed long").select(F.col("row").alias("at"), "seed"), "tiling-item-seeds")
    marks = np.zeros(FILTER_PLACES, bool)
    for r in item_seeds.select(F.col("seed").bitwiseAND(F.lit(FILTER_PLACES - 1)).alias("p")).distinct().toArrow().to_batches():  # FILTER_PLACES rows at most
        marks[r.column(0).to_numpy()] = True
    shared = spark.sparkContext.broadcast(marks)
    met = stash(texts.mapInArrow(seeds, "row long, seed long").join(item_seeds, "seed").select("row", "at").distinct(), "tiling-met")
    pairs = met.join(items.select(F.col("row").alias("at"), "item", F.col("text").alias("pattern")), "at").join(texts, "row").select("row", "item", "pattern", "text")
    item_type = kind.elementType["item_id"].dataType

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for pattern, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                shares.append(max((c for _, c in SeedIndex([(0, pattern)]).coverages(words_of(text))), default=0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.float64())], ["row", "item_id", "coverage"])

    covered = pairs.mapInArrow(tiles, T.StructType([T.StructField("row", T.LongType()), T.StructField("item_id", item_type), T.StructField("coverage", T.DoubleType())])).where(F.col("coverage") >= threshold)
    lists = covered.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("coverage")).alias("less"), "item_id", "coverage"))).alias("all"))
    lists = stash(lists.select("row", F.transform("all", lambda x: F.struct(x["item_id"].alias("item_id"), x["coverage"].alias("coverage"))).alias("leaks")), "tiling-leaks")
    for t in (item_seeds, met):
        unstash(t)
    return rows.join(lists, "row", "left").select("whole.*", F.coalesce("leaks", F.array()).cast(kind).alias(name))


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = COVERAGE, name: str = "_leaks") -> DataFrame:
    """docs with one more column: the items that a row's text covers up to the threshold or more.

    The column is an array of (item_id, coverage), in descending coverage, then
    ascending item id (null first); empty if there are none. Items of fewer than MIN_MATCH words, or
    without a text, never match; a null or empty document has no match; very long texts are searched
    whole. All columns, whatever their names (but ``name``), and repeated rows, are passed on as they are.
    A benchmark of BLOCK_BYTES at most, which is measured, is broadcast and nothing is shuffled. A larger
    one meets the documents in a join over seeds. Both give the same.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_id_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    kind = _leak_type(items.schema["item"].dataType)
    if (items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0) <= BLOCK_BYTES:
        few = [(r["item"], r["text"] or "") for r in items.where("text is not null").collect()]  # BLOCK_BYTES at most
        return _from_broadcast(docs, few, text_col, threshold, name, kind)
    return _from_join(docs, items, text_col, threshold, name, kind)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = COVERAGE) -> DataFrame:
    """One row per row of docs: the id, contaminated boolean, best_item (null if none), coverage double (0 if none), n_items long.

    An empty benchmark contaminates nothing; an empty table of documents gives no
    rows. Other columns are not read. See annotate() for nulls and short items.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    best = F.try_element_at("_leaks", F.lit(1))
    return annotate(rows, benchmark, threshold=threshold).select(
        F.col("id").alias(id_col), (F.size("_leaks") > 0).alias("contaminated"), best["item_id"].alias("best_item"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), F.size("_leaks").cast("long").alias("n_items")
    )


def op7_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
