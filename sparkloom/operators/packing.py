"""Order-dependent packing inside groups: a step's rows as (id, length), packed by one task for each step.

Only ids and lengths travel; groups are the batches of a training step, whose size is
bounded by configuration.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame


def first_fit_bins(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each length, in input order: the first one with room."""
    room: list[int] = []
    out = []
    for n in lengths:
        for i, left in enumerate(room):
            if n <= left:
                break
        else:
            i = len(room)
            room.append(capacity)
        room[i] -= n
        out.append(i)
    return out


def largest_differencing(lengths: list[int], parts: int, equal: bool = False) -> list[int]:
    """Part of each length, by k-way largest differencing: the two states with the widest spread are joined, large against small.

    equal: all parts get the same number, which must divide the number of lengths; states then begin with one of each of ``parts`` neighbours by length.
    """
    if equal and len(lengths) % parts:
        raise ValueError(f"{len(lengths)} lengths do not make {parts} parts of equal number")
    if equal:
        ranked = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
        first = [sorted((lengths[i], [i]) for i in ranked[at : at + parts])[::-1] for at in range(0, len(ranked), parts)]
    else:
        first = [[(n, [i])] + [(0, []) for _ in range(parts - 1)] for i, n in enumerate(lengths)]
    # A state's sums descend; the widest spread is joined first, then the earliest.
    heap = [(s[-1][0] - s[0][0], k, s) for k, s in enumerate(first)]
    heapq.heapify(heap)
    tick = len(first)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda s: (-s[0], s[1]))
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], tick, joined))
        tick += 1
    out = [0] * len(lengths)
    if heap:
        for k, (_, members) in enumerate(sorted(heap[0][2], key=lambda s: min(s[1], default=len(lengths)))):
            for i in members:
                out[i] = k
    return out


def greedy(lengths: list[int], parts: int) -> list[int]:
    """Part of each length: the longest first, each to the part with the least sum (the first of equal ones)."""
    out, heap = [0] * len(lengths), [(0, k) for k in range(parts)]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        total, k = heapq.heappop(heap)
        out[i] = k
        heapq.heappush(heap, (total + lengths[i], k))
    return out


def _grouped(df: DataFrame, by: list[str], order: str, size: str, column: str, place) -> DataFrame:
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, order, size)) + f", {column} int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")[[*by, order, size]].copy()
        rows[column] = place(rows[size].fillna(0).astype("int64").tolist())
        return rows

    return df.select(*by, order, size).groupBy(*by).applyInPandas(run, schema)


def first_fit(df: DataFrame, by: list[str], order: str, size: str, capacity: int) -> DataFrame:
    return _grouped(df, by, order, size, "bin", lambda n: first_fit_bins(n, capacity))


def balanced(df: DataFrame, by: list[str], order: str, size: str, parts: int, equal: bool = False) -> DataFrame:
    return _grouped(df, by, order, size, "part", lambda n: largest_differencing(n, parts, equal))


def greedily(df: DataFrame, by: list[str], order: str, size: str, parts: int) -> DataFrame:
    return _grouped(df, by, order, size, "part", lambda n: greedy(n, parts))


def schedule(df: DataFrame, step: str, rank: str, order: str, size: str, capacity: int) -> DataFrame:
    """step, rank, order, size, micro_batches and micro_batch: every rank of a step has as many micro-batches as the one with the most first-fit bins, and its rows balanced over them.

    A step is one training batch, so its rows come to one task.
    """
    kinds = dict(df.dtypes)
    keys = [step, rank, order, size]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([rank, order], kind="stable").reset_index(drop=True)
        lengths = rows[size].fillna(0).astype("int64")
        held = [(lengths[own].tolist(), own) for own in rows.groupby(rank, dropna=False, sort=True).groups.values()]
        most = max(max(first_fit_bins(n, capacity), default=-1) + 1 for n, _ in held)
        rows["micro_batches"] = most
        rows["micro_batch"] = 0
        for n, own in held:
            rows.loc[own, "micro_batch"] = largest_differencing(n, most)
        return rows[[*keys, "micro_batches", "micro_batch"]]

    return df.select(*keys).groupBy(step).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", micro_batches int, micro_batch int")
