"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that a pyahocorasick automaton over the
vocabulary finds the longest token at every position. Encoding starts with the
longest match and steps back to a shorter one where two adjacent tokens could not
stand side by side after the merges; that test is memoised per pair of tokens. Each
position is given up at most once, so a piece takes time linear in its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import merged, small_batches, table, trim
from sparkloom.llm.pieces import PieceMemo

#: Entries of the memo of token pairs after which it is emptied.
PAIR_ENTRIES = 250_000
#: Entries of the memo of cuts after which the older half goes: each takes some 300 bytes, and an executor has a worker for each core beside its own heap.
MEMO_ENTRIES = 400_000
#: Bytes of text that are encoded at once: the arrays over their cuts take some thirty times as much.
CALL_BYTES = 1 << 20


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """The tokens and ranks of a vocabulary file with a base64 token and a rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


def merge_parts(token: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The parts of token after all merges, lowest rank first; below: only merges of a lower rank."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BacktrackEncoder:
    """Encodes single pieces exactly as the merges by rank would."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.split(rank) is not None:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one (itself twice for a byte); None if no merge leads to it."""
        if token not in self.halves:
            raw = self.tokens[token]
            if len(raw) == 1:
                self.halves[token] = (token, token)
            else:
                parts = merge_parts(raw, self.ranks, below=token)
                self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def prefix(self, token: int) -> int | None:
        """The longest reachable token that is a proper prefix."""
        if token not in self.shorter:
            raw, found = self.tokens[token], None
            for end in range(len(raw) - 1, 0, -1):
                rank = self.ranks.get(raw[:end])
                if rank is not None and self.split(rank) is not None:
                    found = rank
                    break
            self.shorter[token] = found
        return self.shorter[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave these two side by side. Memoised."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIR_ENTRIES:
                self.pairs.clear()
            found = self.pairs[key] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the merges on both sides of the seam, latest first; a merge over the seam before the last undone one is a conflict."""
        single = lambda t: len(self.tokens[t]) == 1
        limit = None
        while True:
            over = self.ranks.get(self.tokens[left] + self.tokens[right])
            # A merge of the same rank happens leftmost first: what made the left token precedes the seam, what made the right one follows it.
            if over is not None and (limit is None or over < limit):
                return False
            undo_left = not single(left) and (single(right) or left > right)
            if not undo_left and single(right):
                return True
            if undo_left:
                limit, left = left, self.split(left)[1]
            else:
                limit, right = right + 1, self.split(right)[0]

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        size = len(raw)
        if not size:
            return []
        longest = [0] * size
        for end, (length, rank) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - length + 1] = rank  # ends ascend, so the last one kept is the longest
        sizes, pairs, prefix, out = self.sizes, self.pairs, self.prefix, []
        open_at = bytearray(b"\x01") * (size + 1)
        at, token = 0, longest[0]
        while at < size:
            last = out[-1] if out else None
            while token is not None:
                end = at + sizes[token]
                if open_at[end]:
                    if last is None:
                        break
                    fits = pairs.get((last, token))
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = prefix(token)
            if token is None:
                if last is None:
                    raise ValueError("no sequence of tokens fits the merges")
                open_at[at] = 0
                token = out.pop()
                at -= sizes[token]
            else:
                out.append(token)
                at = end
                token = longest[at] if at < size else None
        return out


class BpeCodec:
    """Whole texts to ids and back."""

    def __init__(self, ranks_content: bytes, pattern: str):
        ranks = parse_ranks(ranks_content)
        self.encoder = BacktrackEncoder(ranks)
        self.memo = PieceMemo(pattern, lambda piece: self.encoder.piece(piece.encode("utf-8", "surrogatepass")), MEMO_ENTRIES)
        self.vocabulary = [self.encoder.tokens.get(i, b"") for i in range(max(ranks.values()) + 1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.memo.texts(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], BpeCodec] = {}


def _codec(content: bytes, pattern: str) -> BpeCodec:
    """One codec in each Python worker, kept between tasks."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = BpeCodec(content, pattern)
    return _CODECS[key]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text; rows: id, n_tokens, ids (binary, unsigned 32-bit little-endian), digests.

    Columns: the id column, n_tokens long, ids binary (null unless with_ids),
    ids_sha256 and decoded_sha256 (lower-case hexadecimal).
    A null or empty text gives no token and the digests of no bytes. A null id is
    kept. Repeated rows are encoded each. Further columns, whatever their names, are
    not read. An empty table gives an empty result. There is no shuffle: each row
    depends on its text alone, so a lost task is simply run again.
    The vocabulary (a file of bounded size, read on the driver) is broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        codec = _codec(content.value, pattern)
        for batch in merged(batches, 1, CALL_BYTES):
            flat, bounds = codec.memo.flat(batch.column(1))
            at = bounds.tolist()
            ids = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(ids if with_ids else [None] * len(ids), pa.binary()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )
            pa.default_memory_pool().release_unused()

    out = rows.mapInArrow(run, f"_id {kind}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)


def encode_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns for a table of documents."""
    import public_tokenizers

    out = bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
