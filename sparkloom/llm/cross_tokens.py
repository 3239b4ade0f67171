"""Alignment of the tokens of two vocabularies, by distinct segments.

A text is cut before runs of white space where neither vocabulary can merge across,
which is verified on the vocabularies themselves. Tokens of a segment do not depend on
its neighbours then, so each distinct segment of the whole corpus is tokenised and aligned
once, its alignment is joined back, and documents are composed of their segments'.

Three written tables carry this:

  blocks     some BLOCK_BYTES of text: its distinct segments by bucket of their hash, and the
             documents as numbers of segments
  segments   a task has whole buckets of all blocks: it tokenises and aligns what is distinct,
             counts the linked id pairs by the segments' occurrences, and keeps which segment
             each block asked for
  payloads   for each block and bucket the alignments in the block's order, with the corpus-wide
             counts of their pairs

Pairs are summed and their highest count for each id found in DataFrame functions. A frequent
segment is one entry of each block, whatever its number of occurrences, so no task gets more than
its buckets' distinct segments times the blocks that hold them.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import merged, parallelism, shared_dir, small_batches, stash, table, trim, unstash
from sparkloom.llm.token_files import byte_letters

#: Text of a block (a document is never cut), and buckets of segments for each shuffle partition.
BLOCK_BYTES = 6 << 20
BUCKETS = 4
#: Segments that the libraries get at once: their own results take far more memory than the ids.
CALL_SEGMENTS = 8192

#: All characters that one of the libraries takes for white space.
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: What a text may be cut before, and what may stand before a segment without merging.
_CUTS, _GUARDS = " \n\t", "\n\t\x00"
_MARK = "\x01"
_META = "▁"


class Aligner:
    """Both tokenizers, and what is verified about them.

    a: a byte-level tokenizer of the tokenizers library, without normalizer; b: a sentencepiece model with byte fallback.
    """

    def __init__(self, a_content: str, b_content: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_content)
        self.a.encode_special_tokens = True
        before = self.a.pre_tokenizer
        if self.a.normalizer is not None or type(before).__name__ != "ByteLevel" or before.add_prefix_space or not getattr(before, "use_regex", True):
            raise ValueError("the first tokenizer does not cut texts by the byte-level pattern")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_content)
        ids = range(self.b.get_piece_size())
        pieces = ["" if self.b.is_byte(i) or self.b.is_unknown(i) or self.b.is_control(i) else self.b.id_to_piece(i).replace(_META, " ") for i in ids]
        if sum(map(self.b.is_byte, ids)) != 256:
            raise ValueError("the second vocabulary lacks bytes")
        #: Bytes of each token; of what no text gives, none.
        self.b_sizes = np.array([1 if self.b.is_byte(i) else len(p.encode()) for i, p in zip(ids, pieces, strict=True)], np.int64)
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_sizes = np.zeros(max(self.a.get_vocab().values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.a_sizes[i] = len(token)  # one letter for each byte
        # Nothing in either vocabulary goes from another character over to the cut.
        letters = {letter: byte for byte, letter in byte_letters().items()}
        tokens = [bytes(letters[c] for c in t).decode("utf-8", "replace") for t in vocabulary]
        crosses = lambda c: any(re.search(f"[^{re.escape(_SPACE)}]{re.escape(c)}", t) for t in [*pieces, *tokens])
        self.cuts = "".join(c for c in _CUTS if not crosses(c))
        guards = [g for g in _GUARDS if not any(g in p for p in pieces) and len(self.b.encode(g)) == 2]
        if not guards:
            raise ValueError("nothing can stand before a segment without merging with it")
        self.guard = guards[0]
        self.cut = re.compile(f"(?<![{re.escape(_SPACE)}])(?=[{re.escape(self.cuts)}])") if self.cuts else None
        #: Texts that Arrow may cut: their white space is what may be cut before, and the mark is not in them.
        self.odd = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _SPACE if c not in self.cuts) + "\\x{1}]"
        self.runs = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in self.cuts) + "]+"
        self.a_names = [np.array([f"{i}{c}" for i in range(len(self.a_sizes))], object) for c in ",|"]
        self.b_names = [np.array([f"{i}{c}" for i in ids], object) for c in ",;"]

    def whole(self, text: str) -> bool:
        """Whether the second tokenizer's tokens give a space and the text."""
        return bool(text) and self.b.normalize(text).replace(_META, " ") == " " + text

    def segments(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The segments of a space and each text one after the other; where each text's begin, and how many it has."""
        column = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pa.array(texts, pa.large_string()), pa.scalar("", pa.large_string()))
        odd = pc.match_substring_regex(column, self.odd) if self.cuts else pa.array(np.ones(len(texts), bool))
        marked = pc.replace_substring_regex(pc.if_else(odd, "", column), self.runs, _MARK + "\\0") if self.cuts else pc.if_else(odd, "", column)
        lists = pc.split_pattern(marked, _MARK)
        offsets, pieces = lists.offsets.to_numpy(), lists.flatten()
        starts, sizes = offsets[:-1] + 1, np.diff(offsets) - 1  # nothing stands before the first mark
        more, n = [], len(pieces)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            own = [x for x in self.cut.split(" " + texts[i]) if x] if self.cut else [" " + texts[i]]
            starts[i], sizes[i] = n + len(more), len(own)
            more += own
        return pa.chunked_array([pieces, pa.array(more, pa.large_string())]).combine_chunks(), starts, sizes

    def align(self, segments: list[str]):
        """For all segments: tokens of both kinds, groups, ids linked (first id times 2^32 plus second), groups as text, and its bounds."""
        found: tuple[list, ...] = ([], [], [], [])
        for at in range(0, len(segments), CALL_SEGMENTS):
            some = segments[at : at + CALL_SEGMENTS]
            ids = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)], [x[2:] for x in self.b.encode([self.guard + s for s in some], num_threads=1)]
            for k, lists in enumerate(ids):
                found[k].append(np.fromiter(map(len, lists), np.int64, len(lists)))
                found[2 + k].append(np.fromiter((i for x in lists for i in x), np.int32, int(found[k][-1].sum())))
        n_a, n_b, a, b = (np.concatenate(x).astype(np.int64) for x in found)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        over = np.cumsum(np.fromiter((len(s.encode()) for s in segments), np.int64, len(segments)))
        if (self.a_sizes[a] == 0).any() or (self.b_sizes[b] == 0).any() or (a_ends[np.cumsum(n_a) - 1] != over).any() or (b_ends[np.cumsum(n_b) - 1] != over).any():
            raise ValueError("tokens do not give the bytes of their segment")
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_last, b_last = np.searchsorted(a_ends, common), np.searchsorted(b_ends, common)
        n_groups = np.diff(np.searchsorted(common, over, "right"), prepend=0)
        # Tokens of both kinds in the order of the text: a group's first kind, then its second.
        group_a, group_b = np.searchsorted(a_last, np.arange(len(a))), np.searchsorted(b_last, np.arange(len(b)))
        at_a = np.arange(len(a)) + np.concatenate([[0], b_last + 1])[group_a]
        at_b = np.arange(len(b)) + (a_last + 1)[group_b]
        parts = np.empty(len(a) + len(b), object)
        parts[at_a], parts[at_b] = self.a_names[0][a], self.b_names[0][b]
        parts[at_a[a_last]], parts[at_b[b_last]] = self.a_names[1][a[a_last]], self.b_names[1][b[b_last]]
        parts = parts.tolist()
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[np.cumsum(n_a + n_b) - 1]
        return n_a, n_b, n_groups, a[a_last] << 32 | b[b_last], "".join(parts).encode(), ends


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_content: str, b_content: bytes) -> Aligner:
    """One in each Python worker, kept between tasks."""
    key = (hashlib.sha256(a_content.encode()).hexdigest(), hashlib.sha256(b_content).hexdigest())
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_content, b_content)
    return _ALIGNERS[key]


def _strings(sizes: np.ndarray, data: bytes) -> pa.Array:
    """Texts that stand one after the other."""
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def _rows(batches: Iterator[pa.RecordBatch]):
    """The rows of all batches, bytes without a copy."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield [c[i] for c in columns]


def _packed(values: np.ndarray | bytes) -> bytes:
    """Compressed bytes; of numbers the first bytes of all, then the second ones, and so on."""
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _raw(value) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_buffer())


def _ints(value, kind) -> np.ndarray:
    raw = np.frombuffer(_raw(value), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _out(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], [n for n, _ in types])


_BLOCK = [("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("nums", pa.binary()), ("sums", pa.binary()), ("data", pa.binary())]
_BLOCK_SQL = "block long, bucket int, ids array<long>, nums binary, sums binary, data binary"
_PART = [("q", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("nums", pa.binary()), ("links", pa.binary()), ("data", pa.binary())]
_PART_SQL = "q int, kind int, block long, bucket int, keys array<long>, counts array<long>, nums binary, links binary, data binary"


def _blocks(docs: DataFrame, shared, buckets: int) -> DataFrame:
    """docs: id, text. For each block a row of its documents (bucket -1: ids, sizes and numbers of segments) and one for each bucket (sizes, occurrences and segments)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        aligner = _aligner(*shared.value)
        for k, batch in enumerate(merged(batches, 1, BLOCK_BYTES)):
            block = TaskContext.get().partitionId() << 32 | k
            texts = [t if t and aligner.whole(t) else "" for t in batch.column(1).to_pylist()]
            pieces, starts, sizes = aligner.segments(texts)
            sizes = np.where([t != "" for t in texts], sizes, 0)
            ends = np.cumsum(sizes)
            coded = pieces.dictionary_encode()
            codes = coded.indices.to_numpy()[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
            times = np.bincount(codes, minlength=len(coded.dictionary))
            used = np.flatnonzero(times)
            names = coded.dictionary.take(pa.array(used))
            hashed = np.fromiter((xxhash.xxh64_intdigest(x) % buckets for x in names.to_pylist()), np.int32, len(used))
            order = np.argsort(hashed, kind="stable")
            names, times, hashed = names.take(pa.array(order)), times[used][order].astype(np.int64), hashed[order]
            place = np.zeros(len(coded.dictionary), np.int32)
            place[used[order]] = np.arange(len(used))
            rows = [(block, -1, batch.column(0).to_pylist(), _packed(sizes.astype(np.int32)), None, _packed(place[codes]))]
            lengths = pc.binary_length(names).to_numpy().astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            raw = b"".join(x.encode() for x in names.to_pylist())
            bounds = np.searchsorted(hashed, np.arange(buckets + 1))
            for bucket in np.unique(hashed).tolist():
                a, b = bounds[bucket], bounds[bucket + 1]
                rows.append((block, bucket, None, _packed(lengths[a:b]), _packed(times[a:b]), _packed(raw[offsets[a] : offsets[b]])))
            yield _out(rows, _BLOCK)

    return docs.select("id", "text").mapInArrow(run, _BLOCK_SQL)


def _segments(blocks: DataFrame, shared) -> DataFrame:
    """For each task q: its linked pairs with their counts (kind 0), its aligned segments (kind 1), and for each block and bucket the numbers of its segments (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        asked, sizes, times, data = [], [], [], []
        for block, bucket, nums, sums, raw in _rows(batches):
            sizes.append(_ints(nums, np.int32))
            times.append(_ints(sums, np.int64))
            data.append(_raw(raw))
            asked.append((block.as_py(), bucket.as_py()))
        if not asked:
            return
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
        coded = _strings(np.concatenate(sizes), b"".join(data)).dictionary_encode()
        codes = coded.indices.to_numpy()
        n_a, n_b, n_groups, links, text, ends = _aligner(*shared.value).align(coded.dictionary.to_pylist())
        weight = np.bincount(codes, np.concatenate(times).astype(float)).astype(np.int64)  # exact below 2^53
        pairs, which = np.unique(links, return_inverse=True)
        counts = np.bincount(which, np.repeat(weight, n_groups).astype(float), len(pairs)).astype(np.int64)
        q = TaskContext.get().partitionId()
        yield _out([(q, 0, None, None, pairs.tolist(), counts.tolist(), None, None, None)], _PART)
        nums = np.stack([n_a, n_b, n_groups, np.diff(ends, prepend=0)]).astype(np.int32)
        yield _out([(q, 1, None, None, None, None, _packed(nums), _packed(which.astype(np.int32)), _packed(text))], _PART)
        for k, (block, bucket) in enumerate(asked):
            yield _out([(q, 2, block, bucket, None, None, _packed(codes[bounds[k] : bounds[k + 1]].astype(np.int32)), None, None)], _PART)

    parts = blocks.repartition(parallelism(blocks.sparkSession), "bucket")
    return parts.select("block", "bucket", "nums", "sums", "data").mapInArrow(run, _PART_SQL)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task by kind: the counts of its pairs (twice, plus one for a highest one), its segments, then what each block asked for."""
    for _, kind, block, bucket, keys, nums, links, data in _rows(batches):
        kind = kind.as_py()
        if kind == 0:
            counts = keys.values.to_numpy()
        elif kind == 1:
            n_a, n_b, n_groups, size = _ints(nums, np.int32).reshape(4, -1)
            text, ends = _raw(data), np.cumsum(size, dtype=np.int64)
            which, last = _ints(links, np.int32), np.cumsum(n_groups, dtype=np.int64)
            total, best = (np.concatenate([[0], np.cumsum(x)]) for x in (counts[which] >> 1, counts[which] & 1))
            total, best = (x[last] - x[last - n_groups] for x in (total, best))
        else:
            own = _ints(nums, np.int32)
            mine = np.stack([n_a[own], n_b[own], n_groups[own], best[own], size[own]]).astype(np.int32)
            raw = b"".join([text[a:b] for a, b in zip((ends - size)[own].tolist(), ends[own].tolist(), strict=True)])
            yield _out([(block.as_py(), bucket.as_py(), None, _packed(mine), _packed(total[own].astype(np.int64)), _packed(raw))], _BLOCK)


def _compose(with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string()), ("groups", pa.string())]

        def documents(ids, sizes, codes, nums, sums, texts):
            n = np.concatenate(nums, axis=1) if nums else np.zeros((5, 0), np.int32)
            per = [*n[[0, 1, 2, 2, 3]].astype(np.int64), np.concatenate(sums) if sums else np.zeros(0, np.int64)]
            raw, ends = b"".join(texts), np.cumsum(n[4], dtype=np.int64)
            names = [raw[a:b] for a, b in zip((ends - n[4]).tolist(), ends.tolist(), strict=True)]
            del raw, ends, texts
            bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            added = []
            for values in per:
                run_sum = np.concatenate([[0], np.cumsum(values[codes])])
                added.append(run_sum[bounds[1:]] - run_sum[bounds[:-1]])
            out = []
            for i, doc in enumerate(ids):
                mine = codes[bounds[i] : bounds[i + 1]].tolist()
                text = b"".join([names[c] for c in mine])[:-1]
                out.append((doc, *(int(x[i]) for x in added), hashlib.sha256(text).hexdigest() if mine else "", text.decode() if with_groups else None))
            return _out(out, kinds)

        held = None
        for _, bucket, ids, nums, sums, data in _rows(batches):
            if bucket.as_py() < 0:
                if held:
                    yield documents(*held)
                held = (ids.as_py(), _ints(nums, np.int32), _ints(data, np.int32), [], [], [])
            else:
                held[3].append(_ints(nums, np.int32).reshape(5, -1))
                held[4].append(_ints(sums, np.int64))
                held[5].append(_raw(data))
        if held:
            yield documents(*held)

    return run


def _apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' rows and the buckets' rows, written in one go to two folders, as the latter are needed for the next step only."""
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/token-segments-{uuid.uuid4().hex}"
    rows.withColumn("kind", (F.col("bucket") >= 0).cast("int")).write.partitionBy("kind").parquet(path)
    out = []
    for kind in (0, 1):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        out.append(spark.read.schema(_BLOCK_SQL).parquet(f"{path}/kind={kind}") if there else spark.createDataFrame([], _BLOCK_SQL))
        if there:
            out[-1]._stash_path = f"{path}/kind={kind}"
    return out[0], out[1]


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two frames: one row per document, and one per linked pair of ids.

    Documents: doc_id (long), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups. Pairs: a, b, count, best.

    Both tokenizers see a space and the text. Offsets where tokens of both end cut them into
    groups; the tokens that end there are linked. Null and empty texts, and texts whose tokens
    do not give the space and the text, have no tokens: zeros, and an empty string for the
    digest. groups is null unless with_groups. Null ids are kept and repeated rows each give
    a row and count. Other columns are not read. An empty table gives two empty frames. A text
    without a place to cut is one segment, whatever its length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        content = (f.read(), g.read())
    Aligner(*content)  # what cannot be verified is refused here
    shared = spark.sparkContext.broadcast(content)
    few = parallelism(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks, segments = _apart(_blocks(rows, shared, BUCKETS * few))
    parts = stash(_segments(segments, shared), "token-alignments")
    unstash(segments)

    found = parts.where("kind = 0").select("q", F.posexplode(F.arrays_zip("keys", "counts")).alias("pos", "p")).select("q", "pos", F.col("p.keys").alias("key"), F.col("p.counts").alias("n"))
    # A pair's row knows the tasks that wait for its counts: a list of one place in each task at most.
    totals = found.groupBy("key").agg(F.sum("n").alias("count"), F.collect_list(F.struct("q", "pos")).alias("places")).withColumn("b", F.col("key").bitwiseAND(F.lit((1 << 32) - 1)))
    totals = stash(totals, "token-pair-counts")
    highest = stash(totals.groupBy("b").agg(F.max("count").alias("most")), "token-pair-highest")
    pairs = stash(totals.join(highest, "b").select(F.shiftright("key", 32).alias("a"), "b", "count", (F.col("count") == F.col("most")).alias("best"), "places"), "token-pairs")
    unstash(totals)
    unstash(highest)
    value = (F.col("count") * 2 + F.col("best").cast("long")).alias("v")
    told = pairs.select(F.explode("places").alias("p"), value).groupBy("p.q").agg(F.array_sort(F.collect_list(F.struct("p.pos", "v"))).alias("all"))
    none = F.lit(None)
    told = told.select("q", F.lit(0).alias("kind"), none.cast("long").alias("block"), none.cast("int").alias("bucket"), F.col("all.v").alias("keys"), *[none.cast("binary").alias(c) for c in ("nums", "links", "data")])
    by_task = parts.where("kind > 0").select(*told.columns).unionByName(told).repartition(few, "q").sortWithinPartitions("q", "kind")
    payloads = stash(by_task.mapInArrow(_payloads, _BLOCK_SQL), "token-payloads")
    unstash(parts)
    by_block = blocks.unionByName(payloads).repartition(few, "block").sortWithinPartitions("block", "bucket")
    out = by_block.mapInArrow(_compose(with_groups), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")
    return out.withColumnRenamed("doc_id", id_col), pairs.select("a", "b", "count", "best")


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, _ = align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), with_groups=False)
    return docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
