"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Rows that pass the base rules get a vector of transformed statistics. Location and
scatter come from minimum-covariance-determinant estimates for each language and
source. Concentration steps start twice, from medians with quartile ranges and from
means with covariances; each step keeps the share CORE of rows with the least
Mahalanobis distance and takes their mean and covariance, until no determinant
changes any more or MOST_STEPS are done. The start that ends with the least
determinant counts. Rows whose distance is beyond CUTOFF are rejected.

A group of fewer than LEAST rows uses its language's estimates, and a language of
fewer the estimates of all rows: so few rows fix no scatter. Sums are aggregated
before they are shuffled, and quantiles come from counts of fixed bins. The estimates
are broadcast while there are MOST_BROADCAST of them at most, so that rows stay where
they are; beyond that they are joined, each of them being a small group then, and
adaptive execution splits what is still large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import SPACE, stash, table, unstash

CORE = 0.75
MOST_STEPS = 8
#: Change of the logarithm of a determinant below which a group's steps are done.
SETTLED = 1e-4
#: Estimates (one for each group and start) that are broadcast at most: 30 numbers each.
MOST_BROADCAST = 20_000
LEAST = 100
#: Squared distance beyond which a row is rejected: chi-square with 4 degrees of freedom at about 1 - 4e-9.
CUTOFF = 45.0
#: Standard deviations that are added to each coordinate's own, so that a statistic that is the same for most rows doesn't make the scatter singular.
FLOORS = (0.05, 0.25, 0.5, 0.2)
#: Bins: of a coordinate in parts of one, of a squared distance by doubling.
COORDINATE_BINS, DISTANCE_BINS = 200, 64

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_X = [f"x{i}" for i in range(len(FLOORS))]


def let(value: Column, body) -> Column:
    """body of a value that is computed once for a row."""
    return F.transform(F.array(value), body).getItem(0)


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more; windows are compared by their 64-bit hash."""

    def covered(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(rows: Column) -> Column:
            def again(x: Column, j: Column) -> Column:
                return (F.get(rows, j - 1)["h"] == x["h"]) | (F.get(rows, j + 1)["h"] == x["h"])

            return F.sort_array(F.transform(F.filter(rows, again), lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(let(by_hash, places), start, step, lambda a: a["n"])

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))


def statistics(text: Column) -> Column:
    """A struct of the base statistics and upper (upper-case letters) of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    not_space = SPACE.replace("[", "[^")
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(not_space))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("again")))
    return let(
        counted,
        lambda c: F.struct(
            c["n"].alias("n_words"),
            (F.length(text) - F.length(F.regexp_replace(text, f"{not_space}+", ""))).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            c["again"].alias("n_repeat_words"),
            F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("upper"),
        ),
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def vector(s: Column) -> list[Column]:
    """Mean word length, symbols a word, share of repeated words, share of upper case: logarithms, with offsets where most rows have zero."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(s["word_chars"], F.lit(1)).cast("double")
    return [F.log(chars / n), F.log(0.05 + s["n_symbols"] / n), F.log(0.05 + s["n_repeat_words"] / n), F.log(0.02 + s["upper"] / chars)]


def _keys(lang: Column, source: Column) -> list[Column]:
    """The groups of a row, narrowest first. Nulls are a language and a source of their own."""
    return [F.concat(F.lit("s"), F.to_json(F.struct(lang.alias("l"), source.alias("s")))), F.concat(F.lit("l"), F.to_json(F.struct(lang.alias("l")))), F.lit("a")]


def _quantiles(bins: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """bins: by..., bin, n. The first bin at which each share of the rows is reached. Bins are few, whatever the number of rows."""
    w = Window.partitionBy(*by)
    run = bins.withColumn("run", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("run") >= F.col("all") * q, F.col("bin"))).alias(name) for name, q in shares.items()], F.max("all").alias("n"))


def _factor(cov: dict[tuple[int, int], Column]) -> list[Column]:
    """Cholesky factor of a covariance with the floors added, as columns c{i}{j}."""
    d = len(FLOORS)
    out: dict[tuple[int, int], Column] = {}
    for i in range(d):
        for j in range(i + 1):
            rest = cov[i, j] + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - out[i, k] * out[j, k]
            out[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / out[j, j]
    return [c.alias(f"c{i}{j}") for (i, j), c in out.items()]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0... from m0... by the factor c00...; by forward substitution."""
    y: list[Column] = []
    for i, x in enumerate(_X):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"c{i}{j}") * y[j]
        y.append(rest / F.col(f"c{i}{i}"))
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


def _bin() -> Column:
    return F.floor(F.log2(1 + _distance()) * DISTANCE_BINS)


def _near(estimates: DataFrame) -> DataFrame:
    """estimates, to be broadcast if they are few: their number is checked each time."""
    return F.broadcast(estimates) if estimates.count() <= MOST_BROADCAST else estimates


def _determinant() -> Column:
    """The logarithm of the determinant of a scatter, from its factor."""
    return sum((2 * F.log(f"c{i}{i}") for i in range(len(FLOORS))), F.lit(0.0))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """rows: key (a group's name), x0 ... The estimates of each group: key, n, m0..., c00..., scale.

    Distances divided by scale have the median of a chi-square distribution if the
    scatter came out too small; scale is never below 1.
    """
    d = len(FLOORS)
    means, places = [f"m{i}" for i in range(d)], [(i, j) for i in range(d) for j in range(i + 1)]
    by = ["key", "start"]
    parts = rows.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(x) * COORDINATE_BINS).cast("long").alias("bin")) for i, x in enumerate(_X)])).alias("p"))
    bins = parts.groupBy("key", "p.i", "p.bin").agg(F.count("*").alias("n"))
    spread = _quantiles(bins, ["key", "i"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    first = spread.groupBy("key").agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("q2") / COORDINATE_BINS)).alias(f"m{i}") for i in range(d)], *[F.max(F.when(F.col("i") == i, (F.col("q3") - F.col("q1")) / COORDINATE_BINS / 1.349)).alias(f"s{i}") for i in range(d)]
    )
    diagonal = {(i, j): F.col(f"s{i}") ** 2 if i == j else F.lit(0.0) for i, j in places}
    covariances = [F.covar_pop(_X[i], _X[j]).alias(f"v{i}{j}") for i, j in places]
    factor = _factor({(i, j): F.col(f"v{i}{j}") for i, j in places})
    plain = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.avg(x).alias(m) for x, m in zip(_X, means, strict=True)], *covariances)
    now = stash(first.select("key", F.lit(0).alias("start"), "n", *means, *_factor(diagonal)).unionByName(plain.select("key", F.lit(1).alias("start"), "n", *means, *factor)), "mcd")
    for _ in range(MOST_STEPS):
        counts = rows.join(_near(now), "key").groupBy(*by, _bin().alias("bin")).agg(F.count("*").alias("n"))
        limits = stash(now.join(_quantiles(counts, by, {"limit": CORE}).select(*by, "limit"), by), "mcd-limits")
        core = rows.join(_near(limits), "key").where(_bin() <= F.col("limit"))
        sums = core.groupBy(*by).agg(F.max("n").alias("n"), *[F.avg(x).alias(m) for x, m in zip(_X, means, strict=True)], *covariances)
        nxt = stash(sums.select(*by, "n", *means, *factor), "mcd")
        both = now.select(*by, _determinant().alias("before")).join(nxt.select(*by, _determinant().alias("after")), by)
        change = both.agg(F.max(F.abs(F.col("before") - F.col("after"))).alias("change")).first()["change"]
        unstash(now)
        unstash(limits)
        now = nxt
        if change is None or change < SETTLED:
            break
    held = [c for c in now.columns if c not in by]
    best = stash(now.groupBy("key").agg(F.min_by(F.struct(*held), F.struct(_determinant(), "start")).alias("e")).select("key", "e.*"), "mcd-best")
    counts = rows.join(_near(best), "key").groupBy("key", _bin().alias("bin")).agg(F.count("*").alias("n"))
    middle = _quantiles(counts, ["key"], {"half": 0.5}).select("key", F.greatest(F.lit(1.0), (F.pow(F.lit(2.0), F.col("half") / DISTANCE_BINS) - 1) / 3.357).alias("scale"))
    out = stash(best.join(middle, "key"), "mcd-estimates")
    unstash(now)
    unstash(best)
    return out


def judge(rows: DataFrame, lang: str, source: str, stats: str, verdict: str) -> DataFrame:
    """rows with a boolean column ``verdict``: true unless the base rules or the distance reject a row.

    rows are read several times, so they should be a written table.
    """
    fit = rows.where(~base_failed(F.col(stats))).select(F.explode(F.array(*_keys(F.col(lang), F.col(source)))).alias("key"), *[c.alias(x) for c, x in zip(vector(F.col(stats)), _X, strict=True)])
    estimates = robust_estimates(fit)
    # The narrowest group with enough rows. One row for each language and source.
    groups = rows.select(F.col(lang).alias("_l"), F.col(source).alias("_s")).distinct().select("_l", "_s", F.posexplode(F.array(*_keys(F.col("_l"), F.col("_s")))).alias("_level", "key"))
    held = groups.join(estimates, "key").where((F.col("n") >= LEAST) | (F.col("_level") == 2))
    narrow = held.groupBy("_l", "_s").agg(F.min_by(F.struct(*[c for c in estimates.columns if c != "key"]), "_level").alias("_e"))
    narrow = stash(narrow, "mcd-groups")
    unstash(estimates)
    joined = rows.join(_near(narrow), F.col(lang).eqNullSafe(F.col("_l")) & F.col(source).eqNullSafe(F.col("_s")), "left")
    s, e = F.col(stats), F.col("_e")
    y: list[Column] = []
    for i, x in enumerate(vector(s)):
        rest = x - e[f"m{i}"]
        for j in range(i):
            rest = rest - e[f"c{i}{j}"] * y[j]
        y.append(rest / e[f"c{i}{i}"])
    distance = sum((v * v for v in y[1:]), y[0] * y[0]) / e["scale"]
    kept = ~base_failed(s) & F.coalesce(distance <= CUTOFF, F.lit(True))
    return joined.withColumn(verdict, kept).drop("_l", "_s", "_e")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean).

    A null or empty text has no word and fails the base rules. A null language or
    source is a group of its own. Repeated rows are judged each, and alike, and so are ties of
    the distance. Very long texts are judged whole. Other columns are not read, whatever their
    names. An empty table gives no rows. The text is read once; only its statistics are
    written and read again.
    """
    rows = stash(docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source"), statistics(F.col(text_col)).alias("_stats")), "quality-rows")
    out = judge(rows, "_lang", "_source", "_stats", "kept")
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_stats.{c}").alias(c) for c in _BASE], base_failed(F.col("_stats")).alias("base_failed"), "kept")


def keep_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, whatever these are called. Nulls, long texts, ties, repeated rows and empty tables as there."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rows = stash(packed.select("_row", F.col("_row")[lang_col].cast("string").alias("_lang"), F.col("_row")[source_col].cast("string").alias("_source"), statistics(F.col("_row")[text_col]).alias("_stats")), "quality-docs")
    return judge(rows, "_lang", "_source", "_stats", "_kept").where("_kept").select("_row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
