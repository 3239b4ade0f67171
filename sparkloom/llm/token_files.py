"""Token ids in files: frequency-ranked ids, byte-aligned variable-length coding, control bytes kept apart.

The file format is a Parquet table of blocks, so that any store that Spark writes
will do. A block holds consecutive documents of one part in ascending order of id:

  part, block          place of the block (parts ascend with doc_id, blocks inside a part too)
  doc_ids              the documents' ids (array of long, null kept)
  lengths              ids of each document, its end id included (array of int)
  before               ids of the part before this block
  control              two bits an id, four ids a byte, lowest bits first: bytes of the id's rank less 1
  data                 the ranks, little-endian, in 1 to 4 bytes each

A rank is the place of an id among all ids by descending frequency (ties: smaller
id first), so frequent ids take one byte. The ranks are a second small table,
written beside the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import merged, parallelism, running_offsets, small_batches, stash, table, unstash
from sparkloom.llm.pieces import PieceMemo

#: Ids after which a block is closed (a document is never cut).
BLOCK_IDS = 1 << 18

#: For each control byte the number of data bytes of its four ids, and where each begins.
_CONTROL = np.arange(256)
_LENGTHS = np.stack([(_CONTROL >> (2 * k) & 3) + 1 for k in range(4)], axis=1)
_STARTS = np.concatenate([np.zeros((256, 1), np.int64), np.cumsum(_LENGTHS, axis=1)[:, :3]], axis=1)
_TOTAL = _LENGTHS.sum(axis=1)
#: Mask of the bytes that count, by length.
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    wide = ranks.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), wide[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers, by table lookup of every control byte."""
    codes = np.frombuffer(control, np.uint8)
    totals = _TOTAL[codes]
    if n % 4 and len(codes):  # the last control byte covers fewer ids
        totals[-1] = _LENGTHS[codes[-1], : n % 4].sum()
    group = np.concatenate([[0], np.cumsum(totals)])[:-1]
    start = (group[:, None] + _STARTS[codes]).reshape(-1)[:n]
    length = _LENGTHS[codes].reshape(-1)[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    return (raw[start] | raw[start + 1] << 8 | raw[start + 2] << 16 | raw[start + 3] << 24) & _MASK[length]


def unpack_lengths(codes: np.ndarray, data: bytes, real: np.ndarray) -> np.ndarray:
    """The numbers of several packed runs: their control bytes and data bytes joined, and which of the four slots of each control byte are used."""
    length = _LENGTHS[codes].reshape(-1)[real].astype(np.int64)
    start = np.cumsum(length) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    return (raw[start] | raw[start + 1] << 8 | raw[start + 2] << 16 | raw[start + 3] << 24) & _MASK[length]


def byte_letters() -> dict[int, str]:
    """The letters by which a byte-level vocabulary names bytes, by Latin-1 character: printable bytes by themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class LibraryEncoder:
    """Whole texts to ids by the tokenizers library, without special tokens being added.

    Texts that hold the string of an added token go to the library whole. For the
    others the library's model gets each distinct piece: its byte-level
    pre-tokenizer cuts a text by the same pattern, and no piece's ids depend on its neighbours.
    """

    def __init__(self, content: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cut, letters = self.tokenizer.model.tokenize, byte_letters()

        def ids(piece: str) -> list[int]:
            if piece[0] == " " and piece.isascii() and piece[1:].isalpha():
                return [t.id for t in cut(letters[32] + piece[1:])]
            return [t.id for t in cut(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))]

        self.memo = PieceMemo(pattern, ids)

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each begins, and the end."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        special = np.zeros(len(column), bool)
        for text in self.added:
            special |= pc.match_substring(column, text).to_numpy(zero_copy_only=False)
        if not special.any():
            return self.memo.flat(column)
        ids, bounds = self.memo.flat(pc.if_else(pa.array(special), "", column))
        whole = {i: np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(special).tolist()}
        parts = [whole[i] if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(len(column))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.flat(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of an array of numbers as a binary column, without an object for each."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    """All bytes of a binary column without nulls, as numbers."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(memoryview(column.buffers()[2])[offsets[0] : offsets[-1]] if column.buffers()[2] else b"", kind)


_ENCODERS: dict[tuple[str, str], LibraryEncoder] = {}


def _encoder(content: str, pattern: str) -> LibraryEncoder:
    key = (hashlib.sha256(content.encode()).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(content, pattern)
    return _ENCODERS[key]


def write_token_files(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Encode whole texts, append end_id to each, and write the blocks and the ranks.

    Gives three frames that read what was written: blocks, ranks (id, count, rank)
    and parts (part, first: ids of all parts before). A null text counts as empty
    and holds the end id alone; null ids come first; rows with equal ids all stay,
    in the order of their ids' values. Other columns are not read. An empty table
    gives empty files. The ranks have one row for each id of the vocabulary that
    occurs, and parts one row for each shuffle partition, so both stay small.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        raw_content = f.read()
    content = spark.sparkContext.broadcast(raw_content)
    width = "<u2" if max(end_id, *LibraryEncoder(raw_content, pattern).tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value, pattern)
        for batch in merged(batches, 1):
            ids, bounds = encoder.flat(batch.column(1))
            ended = np.insert(ids.astype(width), bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int32()), _binary(ended, bounds)], ["doc_id", "n", "ids"])

    # The texts are encoded once; ordering and counting read these ids.
    encoded = stash(rows.mapInArrow(encode, "doc_id long, n int, ids binary"), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            one = np.bincount(_numbers(batch.column(0), width), minlength=len(total))
            one[: len(total)] += total
            total = one
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("count"))
    # One row for each id of the vocabulary.
    found = sorted(((r["id"], r["count"]) for r in counts.collect()), key=lambda x: (-x[1], x[0]))
    by_id = {i: rank for rank, (i, _) in enumerate(found)}
    ranks = stash(spark.createDataFrame([(i, n, by_id[i]) for i, n in found], "id long, count long, rank long"), "token-ranks")
    to_rank = np.zeros(max(by_id, default=0) + 1, np.uint32)
    for i, r in by_id.items():
        to_rank[i] = r
    shared = spark.sparkContext.broadcast(to_rank)

    ordered = encoded.repartitionByRange(parallelism(spark), "doc_id", F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "n", "ids")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, block, before, held, size = shared.value, 0, 0, [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join([raw for _, _, _, raw in held]), width)
            control, data = pack(lookup[ids])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([held[0][0]], pa.int32()), pa.array([block], pa.int32()), pa.array([[h[1] for h in held]], pa.list_(pa.int64())), pa.array([[h[2] for h in held]], pa.list_(pa.int32())),
                    pa.array([before], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary()),
                ],
                ["part", "block", "doc_ids", "lengths", "before", "control", "data"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += row[2]
                if size >= BLOCK_IDS:
                    yield close()
                    block, before, held, size = block + 1, before + size, [], 0
        if held:
            yield close()

    written = stash(ordered.mapInArrow(blocks, "part int, block int, doc_ids array<long>, lengths array<int>, before long, control binary, data binary"), "token-blocks")
    unstash(encoded)
    totals = written.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    return written, ranks, running_offsets(spark, totals, ["part"], "n", "part int, first long")


def read_token_files(blocks: DataFrame, ranks: DataFrame, parts: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids (binary, unsigned 32-bit little-endian)."""
    spark = blocks.sparkSession
    by_rank = np.array([r["id"] for r in ranks.orderBy("rank").collect()], "<u4")  # a row for each id of the vocabulary
    shared = spark.sparkContext.broadcast(by_rank)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        for batch in batches:
            for ids, lengths, start, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = np.cumsum(lengths)
                all_ids = lookup[unpack(control, data, int(ends[-1]))]
                bounds = np.concatenate([[0], ends])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + bounds[:-1], pa.int64()), pa.array(lengths, pa.int64()), _binary(all_ids, bounds)], ["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(F.broadcast(parts), "part").select("doc_ids", "lengths", (F.col("first") + F.col("before")).alias("start"), "control", "data")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)

    return read_token_files(*files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


