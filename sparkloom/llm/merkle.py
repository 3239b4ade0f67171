"""Merkle manifest of a table: a hash tree over its rows, built bottom-up, with proofs pushed top-down.

Every row is a leaf: the SHA-256 of its fields. The leaves of a group stand in the order
of their ids; every ``fanout`` consecutive nodes are the children of a parent, whose hash
is that of the children's hashes, until one node is left, the group's subroot. The
subroots, ordered by group, are the leaves of one more such tree with the root.

Each level is a written table with a row for each parent and its children in order, so a
lost executor costs one level at most. Proofs go the other way: the rows of a level get
the proof of their parent, the children are taken out of the row, and each child puts
its own siblings before the proof that it inherits. A level is joined once, on its
nodes' places, which no hot group can make uneven.

A proof is an array with one step a level, from the leaf up. A step holds the hashes of
the whole run, with ``*`` in the place of the node itself, so folding a proof is
replacing the star by the hash so far and hashing the step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import parallelism, stash, table, unstash

#: Nodes that one task of a small level handles at most; larger levels keep the session's shuffle partitions.
TASK_NODES = 20_000

_EMPTY = "array<string>"


def row_hash(*fields: Column) -> Column:
    """The hash of a row: each field as ``-`` if null, else the number of its UTF-8 bytes, a colon and the value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """leaves: g, idx, n, h and the payload's columns. levels: one table for each, lowest first: g, idx, n, h, kids. subroots: g, at (its level), h, idx, n."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    tops: list[DataFrame]
    root: str | None
    fanout: int


def _placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with idx (place in its group g, from 0) and n (rows of the group). Ranges of rows are sorted; only counts of ranges are added up."""
    first = stash(rows, f"{name}-rows")
    ranged = first.repartitionByRange(parallelism(rows.sparkSession), "g", *order).sortWithinPartitions("g", *order)
    ranged = stash(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), f"{name}-sorted")
    unstash(first)
    ends = ranged.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_own"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("_own").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = stash(ends.select("g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_own").over(group).alias("n")), f"{name}-ranges")
    out = ranged.join(ends, ["g", "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")
    out = stash(out, f"{name}-placed")
    unstash(ranged)
    unstash(ends)
    return out


def _few(df: DataFrame, nodes: int) -> DataFrame:
    """A level of few nodes in few tasks."""
    tasks = -(-nodes // TASK_NODES)
    return df.coalesce(max(1, tasks)) if tasks < parallelism(df.sparkSession) else df


def _levels(nodes: DataFrame, payload: list[str], fanout: int, name: str) -> list[DataFrame]:
    """All levels above nodes (g, idx, n, h, payload). Only the first one's children carry the payload."""
    sums = nodes.agg(F.max("n").alias("most"), F.count("*").alias("all"), F.count_if(F.col("idx") == 0).alias("groups")).first()
    most, total, out = sums["most"] or 0, sums["all"], []
    while most > 1:
        most, total = -(-most // fanout), total // fanout + sums["groups"]
        runs = nodes.where("n > 1").groupBy("g", F.floor(F.col("idx") / fanout).alias("up")).agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "h", *payload))).alias("kids")
        )
        parents = runs.select("g", F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.array_join("kids.h", ""), 256).alias("h"), "kids")
        nodes, payload = stash(_few(parents, total), f"{name}-level"), []
        out.append(nodes)
    return out


def build(leaves: DataFrame, order: list[Column], fanout: int = 2) -> Manifest:
    """The manifest of leaves: columns g (string, not null), h and any others, which stay with the leaf.

    order puts the leaves of a group in order; rows that it leaves equal should be equal.
    An empty table has no levels and the root None.
    """
    if fanout < 2:
        raise ValueError("a parent needs two children or more")
    payload = [c for c in leaves.columns if c not in ("g", "h")]
    placed = _placed(leaves, order, "merkle-leaf")
    levels = _levels(placed, payload, fanout, "merkle")
    tops = placed.where("n = 1").select("g", F.lit(0).alias("at"), "h")
    for at, level in enumerate(levels, 1):
        tops = tops.unionByName(level.where("n = 1").select("g", F.lit(at).alias("at"), "h"))
    subroots = _placed(tops.select(F.lit("").alias("g"), F.col("g").alias("group"), "at", "h"), [F.col("group")], "merkle-subroot")
    over = _levels(subroots, ["group", "at"], fanout, "merkle-top")
    last = (over[-1] if over else subroots).select("h").first()  # one row, or none
    return Manifest(placed, levels, subroots, over, last["h"] if last else None, fanout)


def _pushed(state: DataFrame, level: DataFrame, payload: list[str], name: str, nodes: int) -> DataFrame:
    """state: g, idx, subroot, proof of the level's nodes. The same for their children, with h and the payload."""
    kid = F.posexplode("kids").alias("pos", "kid")
    taken = state.join(level.select("g", "idx", "kids"), ["g", "idx"]).select("g", "subroot", "proof", F.col("kids.h").alias("run"), kid)
    step = F.concat(F.array_join(F.slice("run", F.lit(1), F.col("pos")), ""), F.lit("*"), F.array_join(F.slice("run", F.col("pos") + 2, F.size("run")), ""))
    out = taken.select("g", F.col("kid.idx").alias("idx"), "subroot", F.concat(F.array(step), "proof").alias("proof"), F.col("kid.h").alias("h"), *[F.col(f"kid.{c}").alias(c) for c in payload])
    return _few(out, nodes)


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with its payload: h, subroot and proof (steps up to the root)."""
    none = F.array().cast(_EMPTY)
    payload = [c for c in manifest.leaves.columns if c not in ("g", "idx", "n", "h")]
    if manifest.tops:
        state = manifest.tops[-1].select("g", "idx", F.lit("").alias("subroot"), none.alias("proof"))
        for depth, level in enumerate(reversed(manifest.tops)):
            own = ["group", "at"] if depth == len(manifest.tops) - 1 else []
            state = stash(_pushed(state, level, own, "merkle-top-proof", manifest.fanout ** (depth + 1)), "merkle-top-proof")
    else:
        state = manifest.subroots.select("group", "at", "h", none.alias("proof"))
    tops = state.select(F.col("group").alias("g"), "at", F.col("h").alias("subroot"), "proof")

    state, groups = None, manifest.subroots.count()
    for at in range(len(manifest.levels), 0, -1):
        own = tops.where(F.col("at") == at).select("g", F.lit(0).cast("long").alias("idx"), "subroot", "proof")
        here = own if state is None else state.select(*own.columns).unionByName(own)
        before, level = state, manifest.levels[at - 1]
        state = _pushed(here, level, payload if at == 1 else [], "merkle-proof", groups * manifest.fanout ** (len(manifest.levels) - at + 1))
        if at > 1:
            state = stash(state, "merkle-proof")
            if before is not None:
                unstash(before)
    lone = manifest.leaves.where("n = 1").join(tops.where("at = 0"), "g").select("g", "h", "subroot", "proof", *payload)
    return lone if state is None else state.select(*lone.columns).unionByName(lone)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.replace(step, F.lit("*"), h), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of a table of documents: g (the language, null first), doc_id, h, and changed, the leaf with 1 added to n_chars where 7 divides the checksum of doc_id."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("g"), "doc_id",
        row_hash(*fields).alias("h"), F.when(hit, row_hash(*fields[:3], more, fields[4])).alias("changed"),
    )


def merkle_manifest(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Nulls are hashed as ``-``; a null language is a group of its own, before the others. A null
    doc_id stands first in its group and is never tampered with. Rows with one doc_id all
    stay, in the order of their leaves. Other columns are not read. An empty table gives no rows.
    """
    manifest = build(document_leaves(docs), [F.col("doc_id").asc_nulls_first(), F.col("h")], fanout)
    folded = proofs(manifest).select(
        "doc_id", F.col("h").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"),
        F.sha2(F.replace(F.array_join("proof", ""), F.lit("*"), F.lit("")), 256).alias("proof_sha256"), fold(F.coalesce("changed", "h"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))
