"""Joins, ranking, limits, de-duplication and filters."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import written


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key. An aggregate with partial sums, so one hot key is no one task's work."""
    packed = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*key).agg(F.min_by(packed, F.struct(*order)).alias("_row")).select("_row.*")


def lookup(left: DataFrame, right: DataFrame, key: Column, right_key: Column, order: list) -> DataFrame:
    """Left join to the first right row of each key."""
    first = right.withColumn("_key", right_key).groupBy("_key").agg(F.min_by(F.struct(*[F.col(c) for c in right.columns]), F.struct(*order)).alias("_hit"))
    return left.withColumn("_key", key).join(first, "_key", "left").drop("_key")


def longest_shared_prefix(df: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """key and the longest string that its row's name and another row's begin with (of the rows with one key the longest); null if there is none.

    A prefix that one row alone has tells which row that is, so the longest shared one is a character shorter than a row's
    shortest own one, or the whole name if it has none. Only own prefixes come back to their rows: one that very many
    names share is a count, and meets nobody.
    """
    rows = written(df.select(F.col(key).alias("_key"), F.col(name).alias("_name")).withColumn("_row", F.monotonically_increasing_id()), "names")
    lengths = F.when(F.length("_name") > 0, F.sequence(F.lit(1), F.length("_name")))
    cut = rows.select("_row", "_name", F.explode(lengths).alias("_i")).select("_row", "_i", F.expr("left(_name, _i)").alias("_prefix"))
    own = cut.groupBy("_prefix").agg(F.count("*").alias("_n"), F.min("_row").alias("_row"), F.min("_i").alias("_i")).where("_n = 1")
    shortest = own.groupBy("_row").agg(F.min("_i").alias("_i"))
    shared = F.nullif(F.when(F.col("_i").isNull(), F.col("_name")).otherwise(F.expr("left(_name, _i - 1)")), F.lit(""))
    found = rows.join(shortest, "_row", "left").select(F.col("_key").alias(key), shared.alias(out))
    return found.groupBy(key).agg(F.max_by(out, F.length(out)).alias(out))


def normalised_key(column: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?U)\s+", " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: Rows of a query set that are broadcast at once; queries and rows of one product of matrices.
MOST_QUERIES = 20_000
QUERY_BLOCK, ROW_BLOCK = 512, 2048


def top_k(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, vector: str, descending: bool = True) -> DataFrame:
    """Exact nearest rows of each query by cosine: query_id, row_id, score, rank. Ties: the smaller row id. A null vector, or one with a null inside, has no score and comes last; vectors of different lengths do not meet.

    The rows are cut into partitions and every query meets every partition; each
    partition keeps its k best, which are ranked again. The stated query set is
    counted and broadcast in blocks of MOST_QUERIES rows at most.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    r = rows.select(F.col(row_id).alias("row_id"), F.col(vector).cast("array<double>").alias("v"))
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    spark = rows.sparkSession
    dealt = r.where(whole).repartition(spark.sparkContext.defaultParallelism, "row_id")
    kinds = {c: d.schema[c].dataType.simpleString() for c, d in (("query_id", q), ("row_id", r))}
    found = []
    for part in blocks(q.where(whole), "query_id", MOST_QUERIES):
        asked = part.toArrow()  # MOST_QUERIES rows at most
        shared = spark.sparkContext.broadcast((asked.column("query_id").combine_chunks(), asked.column("v").combine_chunks()))
        found.append(dealt.mapInArrow(_best(shared, k, descending), f"query_id {kinds['query_id']}, row_id {kinds['row_id']}, score double"))
    scored = reduce(DataFrame.unionByName, found)
    # Without a score the smallest ids are enough.
    none = F.lit(None).cast("double").alias("score")
    least = lambda df: F.broadcast(df.select("row_id").orderBy("row_id").limit(k))
    scored = scored.unionByName(q.where(whole).select("query_id").join(least(r.where(~whole)), how="cross").select("query_id", "row_id", none))
    scored = scored.unionByName(q.where(~whole).select("query_id").join(least(r), how="cross").select("query_id", "row_id", none))
    order = [F.desc_nulls_last("score") if descending else F.asc_nulls_last("score"), F.asc("row_id")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def _best(shared, k: int, descending: bool):
    """For mapInArrow over (row_id, v): query_id, row_id, score of the k best rows of each query in a partition.

    Products of matrices only say which rows may be among the best; these are scored value after value, so that equal vectors
    have equal scores wherever they stand.
    """
    def lengths(m: np.ndarray) -> np.ndarray:
        return np.maximum(np.sqrt(summed(m, m)), 1e-12)

    def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(max(len(a), len(b)))
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
        return out

    def matrices(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By number of dimensions: places, and the vectors there."""
        if not len(vectors):
            return {}
        sizes, values, starts = np.diff(vectors.offsets.to_numpy()), vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
        out = {}
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            out[int(d)] = at, values[starts[at][:, None] + np.arange(d)]
        return out

    def distinct(m: np.ndarray) -> np.ndarray:
        """Places of rows (in order of their ids) that fewer than k equal ones stand before."""
        seen: Counter = Counter()
        keep = np.zeros(len(m), bool)
        for i in range(len(m)):
            key = m[i].tobytes()
            keep[i] = seen[key] < k
            seen[key] += 1
        return np.flatnonzero(keep)

    def run(batches):
        ids, vectors = shared.value
        known = {d: (at, m, m / lengths(m)[:, None], lengths(m)) for d, (at, m) in matrices(vectors).items()}
        # Per query what is best so far: keys to be sorted up (the score or its negative), ids, scores.
        key, score = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.nan)
        rank = np.full((len(ids), k), -1, np.int64)  # places in held
        held: list = []

        def meet(row_ids: pa.Array, rows: pa.ListArray) -> None:
            nonlocal held
            order = pc.sort_indices(row_ids)
            row_ids, rows = row_ids.take(order), rows.take(order)
            for d, (at, m) in matrices(rows).items():
                if d not in known:
                    continue
                few = distinct(m)
                at, m = at[few], m[few]
                size = lengths(m)
                scaled = (m / size[:, None]).T
                q_at, q, q_scaled, q_size = known[d]
                new = []
                for start in range(0, len(q_at), QUERY_BLOCK):
                    own = slice(start, start + QUERY_BLOCK)
                    near = q_scaled[own] @ scaled
                    # The k-th best so far, and a little more than products and rounding may be off.
                    bound = key[q_at[own], k - 1][:, None] + 1e-8
                    if not np.isfinite(bound).all() and near.shape[1] > k:
                        own_keys = np.nan_to_num(-near if descending else near, nan=-np.inf if descending else np.inf)
                        bound = np.minimum(bound, np.partition(own_keys, k - 1, axis=1)[:, k - 1 : k] + 1e-8)
                    a, b = np.nonzero(~((-near if descending else near) > bound))
                    for part in range(0, len(a), 1 << 18):
                        own_a, own_b = a[part : part + (1 << 18)] + start, b[part : part + (1 << 18)]
                        exact = summed(q[own_a], m[own_b]) / (q_size[own_a] * size[own_b])
                        exact = np.sign(exact) * np.floor(np.abs(exact) * 1e9 + 0.5) / 1e9
                        new.append((q_at[own_a], at[own_b], exact))
                if new:
                    keep_best(*(np.concatenate(x) for x in zip(*new, strict=True)), row_ids)

        def keep_best(q_new, row_new, exact, row_ids) -> None:
            """Of the rows so far and the new ones the best of each query that has new ones."""
            nonlocal held
            touched = np.unique(q_new)
            old_q = np.repeat(touched, k)
            old_rank, old_score = rank[touched].ravel(), score[touched].ravel()
            real = old_rank >= 0
            base = len(held)
            rows_used, back = np.unique(row_new, return_inverse=True)
            held.extend(row_ids.take(pa.array(rows_used)).to_pylist())
            q_all = np.concatenate([old_q[real], q_new])
            r_all = np.concatenate([old_rank[real], back + base])
            s_all = np.concatenate([old_score[real], exact])
            # Ids in order, as they may be of any kind.
            used, where = np.unique(r_all, return_inverse=True)
            names = pa.array([held[i] for i in used], row_ids.type)
            places = np.empty(len(used), np.int64)
            places[pc.sort_indices(names).to_numpy()] = np.arange(len(used))
            # A score that is no number counts as the greatest.
            sort_key = np.where(np.isnan(s_all), np.inf, s_all)
            sort_key = -sort_key if descending else sort_key
            order = np.lexsort((places[where], sort_key, q_all))
            q_all, r_all, s_all, sort_key = q_all[order], r_all[order], s_all[order], sort_key[order]
            first = np.flatnonzero(np.concatenate([[True], q_all[1:] != q_all[:-1]]))
            nth = np.arange(len(q_all)) - np.repeat(first, np.diff(np.append(first, len(q_all))))
            best = nth < k
            q_all, r_all, s_all, sort_key, nth = q_all[best], r_all[best], s_all[best], sort_key[best], nth[best]
            key[touched], score[touched], rank[touched] = np.inf, np.nan, -1
            key[q_all, nth], score[q_all, nth], rank[q_all, nth] = sort_key, s_all, r_all
            if len(held) > 4 * rank.size + ROW_BLOCK:
                left, new_place = np.unique(rank[rank >= 0], return_inverse=True)
                rank[rank >= 0] = new_place
                held = [held[i] for i in left]

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for start in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(start, ROW_BLOCK)
                meet(part.column(0), part.column(1).take(pa.array(range(part.num_rows))))
        if kind is None:
            return
        q_at, nth = np.nonzero(rank >= 0)
        for start in range(0, len(q_at), 50_000):
            a, b = q_at[start : start + 50_000], nth[start : start + 50_000]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), pa.array([held[i] for i in rank[a, b]], kind), pa.array(score[a, b])], ["query_id", "row_id", "score"])

    return run


def blocks(queries: DataFrame, key: str, rows_per_block: int) -> list[DataFrame]:
    """The queries in parts of a bounded number of rows, by hash of the key."""
    n = max(1, -(-queries.count() // rows_per_block))
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def fan_out(*tables: DataFrame) -> DataFrame:
    """All combinations of a few small tables."""
    return reduce(lambda a, b: a.crossJoin(b), tables)


def margin_filter(df: DataFrame, group: list[str], candidate: str, p: str, n: str, least: float = 1.0) -> DataFrame:
    """Best against second candidate of each group: z of the margin and whether it is enough; fewer than two pass."""
    w = Window.partitionBy(*group).orderBy(F.desc(p), F.asc(candidate))
    ranked = df.withColumn("_rank", F.row_number().over(w)).where("_rank <= 2")
    of = lambda c, k: F.max(F.when(F.col("_rank") == k, F.col(c)))
    top = ranked.groupBy(*group).agg(of(p, 1).alias("p1"), of(n, 1).alias("n1"), of(p, 2).alias("p2"), of(n, 2).alias("n2"))
    var = lambda k: F.col(f"p{k}") * (1 - F.col(f"p{k}")) / F.col(f"n{k}")
    z = F.when(F.col("p2").isNotNull(), (F.col("p1") - F.col("p2")) / (F.sqrt(var(1) + var(2)) + 1e-8))
    return top.withColumn("z", z).withColumn("keep", F.coalesce(F.col("z") >= least, F.lit(True)))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets: both sorted together, and the lesser count of each value added up in one fold."""
    sided = lambda x, side: F.transform(F.filter(x, lambda v: v.isNotNull()), lambda v: F.struct(v.alias("v"), F.lit(side).alias("side")))
    both = F.sort_array(F.concat(sided(a, 0), sided(b, 1)))
    state = lambda last, n, m, total: F.struct(last.alias("last"), n.alias("n"), m.alias("m"), total.alias("total"))

    def step(s: Column, x: Column) -> Column:
        same = s["last"].eqNullSafe(x["v"])
        left, right = (F.when(x["side"] == k, 1).otherwise(0) for k in (0, 1))
        return state(x["v"], F.when(same, s["n"] + left).otherwise(left), F.when(same, s["m"] + right).otherwise(right), s["total"] + F.when(same, 0).otherwise(F.least(s["n"], s["m"])))

    # A value of the arrays' own kind, null to begin with.
    start = state(F.get(F.slice(F.concat(a, b), 1, 0), F.lit(0)), F.lit(0), F.lit(0), F.lit(0))
    return F.aggregate(both, start, step, lambda s: s["total"] + F.least(s["n"], s["m"]))


def newest_groups(df: DataFrame, group: str, timestamp: str, n: int) -> DataFrame:
    """Rows of the n groups with the latest time (null: 0); ties: the smaller group."""
    latest = df.groupBy(group).agg(F.max(F.coalesce(timestamp, F.lit(0))).alias("_latest")).orderBy(F.desc("_latest"), group).limit(n)
    return df.join(latest.select(group), group, "left_semi")


#: Words of a query set that are broadcast at once.
MOST_WORDS = 200_000


def bm25(docs: DataFrame, queries: DataFrame, k: int, doc_id: str, query_id: str, text: str, k1: float = 0.9, b: float = 0.4, sure: int = 10_000) -> DataFrame:
    """Best documents of each query by BM25: query_id, doc_id, score, rank. Ties: the smaller document id.

    Only words that are asked for leave a document's row, with their counts, and no document is scored that cannot be among
    the best. The k-th best score by a query's rarer words alone (those in ``sure`` documents or fewer) is a bound that the
    final scores do not fall below. Frequent words whose highest scores add up to less than it cannot lift a document to
    it by themselves, so their postings only meet documents that one of the query's other words has found.
    """
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    asked = queries.select(F.col(query_id).alias("_q"), F.explode(F.array_distinct(words)).alias("w"))
    own = docs.select(F.col(doc_id).alias("_d"), words.alias("words")).withColumn("len", F.size("words"))
    total = own.where("len > 0").agg(F.count("*").alias("N"), F.avg("len").alias("avglen"))
    wanted = asked.select("w").distinct()
    wanted = F.broadcast(wanted) if wanted.limit(MOST_WORDS + 1).count() <= MOST_WORDS else wanted
    tf = own.select("_d", "len", F.explode("words").alias("w")).join(wanted, "w", "left_semi").groupBy("_d", "len", "w").agg(F.count("*").alias("tf"))
    tf = written(tf, "postings")
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avglen")))
    postings = written(tf.join(df, "w").join(F.broadcast(total), how="cross").select("_d", "w", "df", part.alias("part")), "scored-postings")
    # A word's bound: its highest score in any document.
    bounds = asked.join(postings.groupBy("w").agg(F.max("part").alias("most"), F.max("df").alias("df")), "w")
    bounds = written(bounds, "word-bounds")
    best = Window.partitionBy("_q").orderBy(F.desc("score"), "_d")
    some = bounds.where(F.col("df") <= sure).select("_q", "w").join(postings, "w").groupBy("_q", "_d").agg(F.sum("part").alias("score"))
    least = some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("_q", F.col("score").alias("least"))
    # From the most frequent word on, as long as all of them together stay below.
    by_count = Window.partitionBy("_q").orderBy(F.desc("df"), "w").rowsBetween(Window.unboundedPreceding, 0)
    split = bounds.join(least, "_q", "left").withColumn("sum", F.sum("most").over(by_count))
    split = written(split.select("_q", "w", F.coalesce(F.col("sum") < F.col("least") - 1e-9, F.lit(False)).alias("weak")), "query-words")
    strong = split.where("not weak").select("_q", "w").join(postings.select("w", "_d", "part"), "w").select("_q", "_d", "w", "part")
    strong = written(strong, "strong-hits")
    found = strong.select("_q", "_d").distinct()
    # Each document that is found looks up the query's frequent words among its own.
    weak = found.join(split.where("weak").select("_q", "w"), "_q").join(postings.select("_d", "w", "part"), ["_d", "w"]).select("_q", "_d", "w", "part")
    scored = strong.unionByName(weak).groupBy("_q", "_d").agg(F.round(F.sum("part"), 9).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("_q").alias(query_id), F.col("_d").alias(doc_id), "score", "rank")
