"""Repeated byte strings across all texts, by prefix doubling over written tables.

Every string of ``least`` bytes that starts in more than one place is found, whatever its
place, and the bytes that such strings cover are the repeated spans.

Ranks of plain prefix doubling need 16 bytes for each byte of text in each round. Here
a position is ranked only while it can still be repeated, and positions that stand in equal
surroundings are ranked together:

1. Each string's anchor is the least of its substrings of SEED bytes, by a hash (the first one
   of equal ones). Equal strings have equal anchors in the same place, so the anchor's
   content is the first rank. Neighbouring strings share an anchor occurrence; such
   a run of strings is one record.
2. Runs with a seed of their own end here. Runs whose whole content occurs twice are
   repeated. What is left are runs with a common seed and different contents.
3. Rounds: a record stands for the strings that start in some range before its anchor,
   and its rank for the bytes that they all share. The range is cut, each part shares more
   bytes, and a part's rank is the name of the pair (rank so far, bytes at the offsets that
   come to it). Spark sorts the records by these pairs; records with a rank of their own
   end. The missing length is quartered in each round, until a record is one string and
   its rank its whole content: strings of one rank are equal.

Names of pairs are 128-bit hashes: equal pairs have equal names in every task, so a pair that
very many records share is counted in parts and needs no single sorter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches, stash, table, unstash

#: Bytes of an anchor.
SEED = 24
#: Bytes that are looked at in one go; a longer text is cut into parts that overlap by least - 1 bytes.
PART_BYTES = 1 << 20
_PLACE_BITS = np.uint64(24)
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _words(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    out = np.zeros(len(raw) - 7, np.uint64)
    for shift in range(8):
        one = np.frombuffer(raw, "<u8", (len(raw) - shift) // 8, shift)
        out[shift::8] = one[: len(out[shift::8])]
    return out


def _seeds(raw: bytes) -> np.ndarray:
    """A hash of the SEED bytes from each place on."""
    words, n = _words(raw), len(raw) - SEED + 1
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(_MULTIPLIERS):
        out = (out ^ words[8 * k : 8 * k + n]) * m
        out ^= out >> np.uint64(29 + k)
    return out * _MULTIPLIERS[0]


def _least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys: the lesser of a block's tail and the next one's head."""
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    heads = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(keys) - width + 1
    return np.minimum(tails[:n], heads[width - 1 : width - 1 + n])


def runs(raw: bytes, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor, in parts that stand one after the other in raw.

    Gives for each run its part, its anchor's place, its first string's place (both in raw), how many strings it holds and its seed.
    """
    if len(raw) < least:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    seeds = _seeds(raw)
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    anchors = (_least_of((seeds & ~mask) | np.arange(len(seeds), dtype=np.uint64), least - SEED + 1) & mask).astype(np.int64)
    part = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(anchors)]
    at = np.flatnonzero(np.arange(len(anchors)) + least <= ends[part])
    anchors, part = anchors[at], part[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    return part[first], anchors[first], at[first], np.diff(first, append=len(at)), seeds[anchors[first]]


def _parts(batches: Iterator[pa.RecordBatch], least: int):
    """Lists of (row, offset, bytes) of PART_BYTES or so."""
    held, size = [], 0
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for at in range(0, max(0, len(text or b"") - least + 1), PART_BYTES):
                held.append((row, at, text[at : at + PART_BYTES + least - 1]))
                size += len(held[-1][2])
                if size >= PART_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _records(rows: DataFrame, least: int) -> DataFrame:
    """rows: row long, text binary. A record for each run: row, seed, c1 and c2 (name of its content), anchor and start (places in the text), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _parts(batches, least):
            raw = b"".join([h[2] for h in held])
            ends = np.cumsum([len(h[2]) for h in held])
            part, anchor, start, n, seed = runs(raw, ends, least)
            view, digest = memoryview(raw), xxhash.xxh3_128_digest
            names = b"".join([digest(view[a:b], back) for a, b, back in zip(start.tolist(), (start + n + (least - 1)).tolist(), (anchor - start).tolist(), strict=True)])
            names = np.frombuffer(names, np.int64).reshape(-1, 2)
            shift = np.array([h[1] for h in held])[part] - (ends - np.diff(ends, prepend=0))[part]
            columns = (np.array([h[0] for h in held])[part], seed.view(np.int64), names[:, 0], names[:, 1], anchor + shift, start + shift, n)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "seed", "c1", "c2", "anchor", "start", "n"])

    return rows.select("row", "text").mapInArrow(run, "row long, seed long, c1 long, c2 long, anchor long, start long, n long")


def _common(records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The records whose keys occur more than once, and the written table of these keys: a join with counts of the same stage could not split a hot key."""
    shared = stash(records.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys), "common")
    return records.join(shared, keys, "left_semi"), shared


def _cut(records: DataFrame, least: int, before: int, size: int) -> DataFrame:
    """Records of ranges of ``before`` strings cut into ranges of ``size``, with the ranks of the longer bytes that each part shares.

    A range [a, b] counts distances of starts from the anchor; its strings share the bytes
    from a before the anchor to least - b behind it. low and high are the distances that
    the record really has; left and right are the bytes on both sides that its strings have besides.
    """
    widest = least - SEED
    col = F.col
    parts = records.select("*", F.explode(F.sequence(F.floor(col("low") / size), F.floor(col("high") / size))).alias("_part"))
    # The range before and the part's, both cut at the widest distance.
    a0, a1 = F.floor(col("low") / before) * before, col("_part") * size
    b0, b1 = F.least(a0 + before - 1, F.lit(widest)), F.least(a1 + size - 1, F.lit(widest))
    low, high = F.greatest("low", a1), F.least("high", b1)
    took_left, took_right = (a1 - a0).cast("int"), (b0 - b1).cast("int")
    skip = (col("high") - high).cast("int")
    own_left, own_right = (high - a1).cast("int"), (b1 - low).cast("int")

    def piece(side: str, at: Column, n: Column) -> Column:
        return F.substring(col(side), at + 1, n)

    new = (piece("left", skip + own_left, took_left), piece("right", F.lit(0), took_right))
    return parts.select(
        "row", "anchor", "alone", low.cast("long").alias("low"), high.cast("long").alias("high"),
        F.xxhash64(F.lit(1), "r1", "r2", "_part", *new).alias("r1"), F.xxhash64(F.lit(2), "r2", "r1", "_part", *new).alias("r2"),
        piece("left", skip, own_left).alias("left"), piece("right", took_right, own_right).alias("right"),
    )


def repeated_starts(rows: DataFrame, least: int = 200) -> DataFrame:
    """rows: row long (unique), text binary; a written table. Rows: row, start, n, for n neighbouring strings of ``least`` bytes that all occur elsewhere too."""
    if least < SEED + 8:
        raise ValueError(f"strings of less than {SEED + 8} bytes have no anchor")
    records = stash(_records(rows, least).withColumn("id", F.monotonically_increasing_id()), "runs")
    # Both sides of each join are written tables, so that it can split a hot key.
    seeds = records.groupBy("seed").agg(F.count("*").alias("_n"), (F.min("c1") != F.max("c1")).alias("open")).where("_n > 1").drop("_n")
    seeds = stash(seeds, "seeds")
    met = stash(records.join(seeds, "seed"), "runs-met")
    unstash(records)
    unstash(seeds)
    classes = stash(met.groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.min("id").alias("first")).where("copies > 1"), "run-classes")
    joined = met.join(classes, ["c1", "c2"], "left")
    judged = joined.select("row", "seed", "anchor", "start", "n", "open", F.col("copies").isNull().alias("alone"), F.coalesce(F.col("first") == F.col("id"), F.lit(True)).alias("told"))
    judged = stash(judged.where("not alone or open"), "runs-judged")
    unstash(met)
    unstash(classes)
    found = judged.where("not alone").select("row", "start", "n")

    # One record of each content with a seed in common, and its bytes but for the seed.
    asked = judged.where("open and told").select("row", "seed", "anchor", "start", "n", "alone")
    size = lambda a, b: (F.col(a) - F.col(b)).cast("int")
    first = rows.join(asked, "row").select(
        "row", "anchor", "alone", (F.col("anchor") - F.col("start") - F.col("n") + 1).alias("low"), (F.col("anchor") - F.col("start")).alias("high"),
        F.col("seed").alias("r1"), F.lit(0).cast("long").alias("r2"),
        F.substring("text", (F.col("start") + 1).cast("int"), size("anchor", "start")).alias("left"),
        F.substring("text", (F.col("anchor") + SEED + 1).cast("int"), (F.col("start") + F.col("n") + least - 1 - F.col("anchor") - SEED).cast("int")).alias("right"),
    )
    strides = [1]
    while strides[-1] * 4 < least - SEED + 1:
        strides.append(strides[-1] * 4)
    now, before = stash(first, "blocks"), least - SEED + 1
    for stride in reversed(strides):
        kept, shared = (now, None) if before > strides[-1] else _common(now, ["r1", "r2"])
        cut = stash(_cut(kept, least, before, stride), "blocks")
        for t in (now, *([shared] if shared else [])):
            unstash(t)
        now, before = cut, stride
    kept, shared = _common(now, ["r1", "r2"])
    last = stash(kept.where("alone").select("row", (F.col("anchor") - F.col("low")).alias("start"), F.lit(1).cast("long").alias("n")), "strings")
    unstash(now)
    unstash(shared)
    return found.unionByName(last)


def spans(packed: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered spans (starts, ends) of runs, each packed as start times 2^32 plus n."""
    start, n = packed >> 32, packed & 0xFFFFFFFF
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + n + (least - 1))[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1] if len(start) else end


def drop_repeats(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """One row per row of docs: the id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept.

    A byte of a text's UTF-8 form goes if a string of ``least`` bytes covers it that also
    starts anywhere else, in the same text or another one; overlaps count, and all strings are
    judged on the input. spans (start and end) and kept (the other bytes) are null unless with_spans.

    Null texts count as empty: no bytes, no spans and the digest of nothing. Texts shorter than
    ``least`` stay whole; rows with equal longer texts, repeated rows among them, go whole.
    Null ids are kept. Other columns are not read. An empty table gives no rows. Very long
    texts are looked at in overlapping parts, so no string is missed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    starts = repeated_starts(rows.select("row", "text"), least)
    # A text's list is as long as the text at most.
    packed = starts.groupBy("row").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("n"))).alias("runs"))
    kind = dict(rows.dtypes)["id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer()
                if not found.is_valid:
                    out.append((raw.size, 0, 0, hashlib.sha256(raw).hexdigest(), [] if with_spans else None, text.as_py() if with_spans else None))
                    continue
                begins, ends = spans(found.values.to_numpy(), least)
                view = memoryview(raw)
                kept = b"".join([view[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), raw.size], strict=True)])
                pairs = [{"start": a, "end": b} for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                out.append((raw.size, raw.size - len(kept), len(begins), hashlib.sha256(kept).hexdigest(), pairs if with_spans else None, kept if with_spans else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    out = rows.join(packed, "row", "left").select("id", "text", "runs")
    out = out.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def op12_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"), least=200, with_spans=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
