"""Loss masks over the tokens of conversations, and the texts that a mask keeps.

A conversation is one text by the template; its messages are spans of it. The text is encoded
once, with offsets, and a token belongs to the span in which it begins: it is trained if
that is what a message of a trained role says behind its header.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.binding import let

#: Header and end of a message; {role} is the role.
HEADER, END = "<|im_start|>{role}\n", "<|im_end|>\n"

_TOKENIZERS: dict[str, object] = {}


def _tokenizer(content: str):
    """One in each Python worker, kept between tasks."""
    from tokenizers import Tokenizer

    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer.from_str(content)
    return _TOKENIZERS[key]


def conversations(messages: DataFrame, key: str, order: str, role: str, text: str, trained: tuple[str, ...] = ("assistant",), step_mask: str | None = None, header: str = HEADER, end: str = END) -> DataFrame:
    """key, text, and the trained spans (starts, ends in characters) of each conversation. step_mask: a column by which 0 leaves a message out; null counts as 1."""
    told = F.col(role).isin(*trained) & (F.coalesce(F.col(step_mask), F.lit(1)) == 1 if step_mask else F.lit(True))
    head = F.replace(F.lit(header), F.lit("{role}"), F.coalesce(F.col(role), F.lit("")))
    message = F.struct(F.col(order).alias("order"), head.alias("head"), F.coalesce(F.col(text), F.lit("")).alias("said"), F.coalesce(told, F.lit(False)).alias("told"))
    grouped = messages.groupBy(key).agg(F.array_sort(F.collect_list(message)).alias("m"))
    # Places add up from message to message.
    size = lambda x: F.length(x["head"]) + F.length(x["said"]) + len(end)
    places = F.aggregate("m", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + size(x))))
    spans = let(places, lambda p: F.filter(F.transform("m", lambda x, i: F.struct((F.get(p, i) + F.length(x["head"])).alias("a"), F.get(p, i + 1).alias("b"), x["told"].alias("told"))), lambda s: s["told"]))
    whole = F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["said"], F.lit(end))), "")
    return grouped.select(key, whole.alias("text"), spans.alias("s")).select(key, "text", F.col("s.a").alias("starts"), F.col("s.b").alias("ends"))


def token_mask(talks: DataFrame, key: str, tokenizer_path: str, with_texts: bool = False) -> DataFrame:
    """key, ids and mask (arrays of int) of what conversations() gives; texts: what each run of 1 decodes to (null unless with_texts).

    tokenizer_path: a file of the tokenizers library. Null texts count as empty. No shuffle: a conversation is one row.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = talks.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(talks.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(content.value)
        for batch in batches:
            ids, masks, texts = [], [], []
            for text, starts, ends in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                coded = tokenizer.encode(text or "", add_special_tokens=False)
                own = np.array(coded.ids, np.int32)
                begins = np.array([a for a, _ in coded.offsets], np.int64)
                # The span whose start is the last one at or before the token; it holds the token if its end lies behind.
                span = np.searchsorted(np.array(starts, np.int64), begins, "right") - 1
                inside = (span >= 0) & (begins < np.append(np.array(ends, np.int64), 0)[span])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
                ids.append(own)
                masks.append(inside.astype(np.int32))
                texts.append([tokenizer.decode(own[a:b].tolist()) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)] if with_texts else None)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, ints), pa.array(masks, ints), pa.array(texts, pa.list_(pa.string()))], [key, "ids", "mask", "texts"])

    return talks.select(key, "text", "starts", "ends").mapInArrow(run, f"{key} {kind}, ids array<int>, mask array<int>, texts array<string>")
