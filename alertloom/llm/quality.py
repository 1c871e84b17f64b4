"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import small, stash, unstash, words

WINDOW = 8
#: Names of the transformed statistics, in the order of the covariance matrix. Each varies among good documents of any language with
#: letters in two cases and marks; one that is constant in a language takes its variance from the others (PRIOR_ROWS).
FEATURES = ("word_length", "capitals", "marks", "vocabulary", "line_words")
P = len(FEATURES)
#: Words of plain text added to every document before its rates are taken: 5 letters a word, a capital and a mark in 33, a line in 30
#: words, 7 of 10 words new. Rates of short documents, which vary most, are drawn in by it.
PRIOR_WORDS = 100
PRIOR = {"chars": 5.0, "capitals": 0.15, "marks": 0.15, "lines": 1 / 30, "distinct": 0.7}
#: Rows of the wider estimate (language for a source, all for a language) that every estimate is joined with: small cells go by the
#: wider one, large ones by themselves, with no step in between.
PRIOR_ROWS = 64
#: Statistics are rounded to this grid and summed as integers: sums don't depend on the order of rows, so reruns agree, and
#: products of values below 8 fit a long for 10**11 rows. The rounding's variance keeps every covariance regular.
GRID = 1 << 10
#: Grid steps of a bin of the medians that the first estimate starts from.
COARSE = 8
#: Share of a cell's rows in the covering half-sample; 0.75 is the usual compromise between breakdown and efficiency.
SUPPORT = 0.75
#: Bins of a distance: equal steps of its logarithm.
BINS_PER_E = 24
#: chi-square quantiles at 5 degrees of freedom: 0.5, 0.975 and 1 - 1e-5.
CHI2_5 = {"median": 4.35146, "reweight": 12.83250, "cutoff": 30.85619}
#: What the covariance of the rows within the 0.975 quantile is too small by: 0.975 / P(chi-square of 7 < 12.8325).
CONSISTENCY = 1.05553
STEPS = 6
STARTS = 2
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def base_statistics(docs: DataFrame) -> DataFrame:
    """One row per document row: counts over its whole text. Null text counts as empty, and every count of it is 0."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("text"), F.xxhash64("text").alias("text_hash")).withColumn("w", words(F.col("text"))).withColumn("n_words", F.size("w"))
    # what is neither letter, digit nor space: all symbols are among it
    d = d.withColumn("marks", F.regexp_replace("text", r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", ""))
    d = d.withColumn("win", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("n_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "lang", "source", "text_hash", "n_words", F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("marks", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.length("marks").cast("long").alias("n_marks"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        lines.alias("lines"),
        # positions matter only where some window comes twice; sorting by hash puts equal windows side by side
        F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"),
    )
    twice = F.filter("sorted", lambda x, k: (x.h == F.get("sorted", k + 1).h) | (x.h == F.get("sorted", k - 1).h))
    d = d.withColumn("starts", F.when(F.col("sorted").isNotNull(), F.sort_array(F.transform(twice, lambda x: x.i))))
    covered = F.aggregate(F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return d.select(
        "doc_id", "lang", "source", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_marks", "n_capitals", "n_distinct", "text_hash",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """Transformed statistics on an integer grid, with PRIOR_WORDS words of plain text added: logarithms of the mean word length, of
    the shares of capitals and marks and of the words in a line; ten times what Herdan's vocabulary richness lacks of 1."""
    plus = lambda c, k: F.col(c) + PRIOR_WORDS * PRIOR[k]
    long = F.col("n_words") + PRIOR_WORDS
    x = [
        F.log(plus("word_chars", "chars") / long), F.log(plus("n_capitals", "capitals") / plus("word_chars", "chars")), F.log(plus("n_marks", "marks") / plus("word_chars", "chars")),
        10 * (1 - F.log(plus("n_distinct", "distinct")) / F.log(long)), F.log(long / plus("n_lines", "lines")),
    ]
    return stats.select("*", *[F.round(e * GRID).cast("long").alias(f"q{i}") for i, e in enumerate(x)])


def _moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"q{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"s{i}_{j}") for i, j in PAIRS]]


SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}_{j}" for i, j in PAIRS]]


def _estimate(sums: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """Mean and Cholesky factor of the covariance (times ``factor``), from summed moments."""
    mean = [F.col(f"s{i}") / F.col("n") / GRID for i in range(P)]
    d = sums.select(*keys, "n", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[f"s{i}_{j}" for i, j in PAIRS])
    c = lambda i, j: F.col(f"s{i}_{j}") / F.col("n") / (GRID * GRID) - F.col(f"m{i}") * F.col(f"m{j}")
    d = d.select(*keys, "n", *[f"m{i}" for i in range(P)], *[(factor * (F.greatest(c(i, i), F.lit(0.0)) if i == j else c(i, j)) + (GRID**-2.0 if i == j else 0.0)).alias(f"c{i}_{j}") for i, j in PAIRS])
    return _cholesky(d, keys)


def _cholesky(d: DataFrame, keys: list[str]) -> DataFrame:
    """Lower factor l of the covariances c, a column at a time, and the log determinant."""
    for j in range(P):
        less = lambda i, j=j: reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}"), range(j), F.col(f"c{i}_{j}"))
        d = d.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(less(j), F.lit(1e-12))))
        d = d.withColumns({f"l{i}_{j}": less(i) / F.col(f"l{j}_{j}") for i in range(j + 1, P)})
    logdet = reduce(lambda a, j: a + 2 * F.log(f"l{j}_{j}"), range(P), F.lit(0.0))
    return d.select(*keys, *[f"m{i}" for i in range(P)], *[f"l{i}_{j}" for i, j in PAIRS], logdet.alias("logdet"))


def _distance(d: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution in the Cholesky factor."""
    for i in range(P):
        d = d.withColumn(f"z{i}", reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"z{k}"), range(i), F.col(f"q{i}") / GRID - F.col(f"m{i}")) / F.col(f"l{i}_{i}"))
    return d.withColumn("d2", reduce(lambda a, i: a + F.col(f"z{i}") * F.col(f"z{i}"), range(P), F.lit(0.0)))


def _bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-6) * BINS_PER_E).cast("int")


def _middle(v: DataFrame, keys: list[str], value: Column, share: float) -> DataFrame:
    """Per key the ``share`` quantile of an integer value, from counts per distinct grid value: exact, and combined before the shuffle."""
    counts = v.groupBy(*keys, value.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    counts = counts.select(*keys, "x", F.sum("n").over(w.orderBy("x")).alias("upto"), F.sum("n").over(w).alias("all"))
    return counts.filter(F.col("upto") >= share * F.col("all")).groupBy(*keys).agg(F.min("x").alias("mid"))


def _first(v: DataFrame) -> DataFrame:
    """Two starts for every cell: coordinatewise medians with median absolute deviations, and the classical estimate."""
    classical = _estimate(v.groupBy("cell").agg(*_moments()), ["cell"]).withColumn("start", F.lit(1))
    long = v.select("cell", F.posexplode(F.array(*[F.floor(F.col(f"q{i}") / COARSE).cast("long") for i in range(P)])).alias("k", "g"))
    mid = stash(_middle(long, ["cell", "k"], F.col("g"), 0.5))
    mad = _middle(long.join(small(mid), ["cell", "k"]), ["cell", "k"], F.abs(F.col("g") - F.col("mid")), 0.5).withColumnRenamed("mid", "mad")
    both = mid.join(mad, ["cell", "k"]).groupBy("cell").agg(*[F.max(F.when(F.col("k") == i, F.col("mid") * COARSE / GRID)).alias(f"m{i}") for i in range(P)], *[F.max(F.when(F.col("k") == i, F.pow((F.col("mad") + 1) * COARSE / GRID * 1.4826, 2))).alias(f"c{i}_{i}") for i in range(P)])
    robust = _cholesky(both.withColumns({f"c{i}_{j}": F.lit(0.0) for i, j in PAIRS if i != j}), ["cell"]).withColumn("start", F.lit(0))
    return robust.unionByName(classical)


def _concentrate(v: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """One C-step: moments per bin of distance in one pass, then those of the nearest bins that hold the support share of a cell."""
    d = _distance(v.join(small(params), "cell"))
    sums = d.groupBy(*keys, _bin(F.col("d2")).alias("bin")).agg(*_moments())
    w = Window.partitionBy(*keys)
    sums = sums.select("*", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    return sums.filter(F.col("upto") - F.col("n") < F.ceil(SUPPORT * F.col("all"))).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def fit(v: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate of every cell of ``v`` (cell, q0...), as the moments SUMS of the rows it rests on.

    From two starts, STEPS concentration steps; of the two results the smaller determinant stays. It is scaled so that the median
    distance is that of the chi-square distribution, and the rows within the 0.975 quantile give the moments: at least half of a cell.
    """
    params = stash(_first(v))
    old = [params]
    for _ in range(STEPS):
        params = stash(_estimate(_concentrate(v, params, ["cell", "start"]), ["cell", "start"]))
        old.append(params)
    best = params.groupBy("cell").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    raw = stash(params.join(best, ["cell", "start"]).drop("start"))
    d = _distance(v.join(small(raw), "cell"))
    half = stash(_middle(d, ["cell"], _bin(F.col("d2")), 0.5).select("cell", F.greatest(F.exp((F.col("mid") + 1) / F.lit(float(BINS_PER_E))) / CHI2_5["median"], F.lit(1.0)).alias("scale")))
    near = d.join(small(half), "cell").filter(F.col("d2") <= F.col("scale") * CHI2_5["reweight"])
    final = stash(near.groupBy("cell").agg(*_moments()))
    for t in [*old, raw, half]:
        unstash(t)
    return final


def shrunk(cells: DataFrame, sums: DataFrame) -> DataFrame:
    """(l, s, m0..., l0_0...): of every language and source in ``cells`` (l, s, c2, c1, c0: its cells from the narrowest on), the estimate
    from its own rows and PRIOR_ROWS rows' worth of its language's, that one in turn with as many of all rows."""
    at = lambda k: sums.select(F.col("cell").alias(f"c{k}"), *[F.col(c).cast("double").alias(f"{c}_{k}") for c in SUMS])
    d = cells
    for k in (0, 1, 2):
        d = d.join(small(stash(at(k))), f"c{k}")
        if k:
            share = PRIOR_ROWS / F.col(f"n_{k - 1}")
            d = d.withColumns({f"{c}_{k}": F.col(f"{c}_{k}") + share * F.col(f"{c}_{k - 1}") for c in SUMS})
    return _estimate(d.select("l", "s", *[F.col(f"{c}_2").alias(c) for c in SUMS]), ["l", "s"], CONSISTENCY)


def judge(docs: DataFrame, cutoff: float = CHI2_5["cutoff"]) -> DataFrame:
    """Quality verdict of every document row.

    Rows that fail the base rules (fewer than 20 words, or over 30 % of words in repeated windows of eight) are rejected and take
    no part in the estimates. The rest are rejected where the squared Mahalanobis distance of their statistics from the robust
    estimate of their language and source exceeds ``cutoff``, a chi-square quantile. Estimates of few rows are drawn towards their
    language's, and those of languages towards that of all rows (PRIOR_ROWS). Null language or source is a value of its own. Null
    or empty text fails the base rules. Repeated rows are judged one by one, alike; an empty table gives an empty result; other
    columns are ignored. Returns doc_id, lang, source, text_hash (xxhash64 of the text; with the others it tells rows apart as far
    as their verdicts can differ), the statistics, base_failed, distance (squared; null if base_failed) and kept.
    """
    stats = stash(vectors(base_statistics(docs)).withColumn("base_failed", base_failed()))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    names = [F.concat_ws("\x1f", F.lit("2"), part("lang"), part("source")), F.concat_ws("\x1f", F.lit("1"), part("lang")), F.lit("0")]
    good = stats.filter(~F.col("base_failed"))
    cells = stash(good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("l"), F.col("source").alias("s"), *[x.alias(c) for x, c in zip(names, ("c2", "c1", "c0"), strict=True)]))
    # every row enters the estimates of its three cells
    v = stash(good.select(F.explode(F.array(*names)).alias("cell"), *[f"q{i}" for i in range(P)]))
    model = stash(shrunk(cells, fit(v)))
    unstash(v)
    d = _distance(good.join(small(model), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))))
    cols = ["doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = d.select(*cols, F.col("d2").alias("distance"), (F.col("d2") <= cutoff).alias("kept"))
    return judged.unionByName(stats.filter("base_failed").select(*cols, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))
