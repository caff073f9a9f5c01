"""Quality rules: robust multivariate outliers within each language and source.

Five counts are taken from every whole text with array functions inside its row (no words are
shuffled). Four transformed statistics follow from them. For each (lang, source) a minimum
covariance determinant estimate gives centre and scatter, and a document whose squared
Mahalanobis distance passes the cutoff is rejected, as are those that fail the base rules.

The estimate is deterministic. It has three starts: medians with quartile ranges, lower quartiles
with quartile ranges, and the mean and covariance of all rows. Each takes concentration steps (mean
and covariance of the three quarters of rows that lie nearest) until centre and scatter stay, STEPS
at most; the start with the least determinant counts, is corrected for consistency, and reweighted
once. A step sums rows by group, start and bin of the distance, and takes the bins up to the one that
completes three quarters, so its state is bounded by the number of bins and one pass is enough. To every scatter a fixed tolerance is added, because
most clean documents have no symbols or repeats at all and their plain scatter is singular. It is
set so that in a clean group one repeated line in ten, with its words, stays and anything that
reaches four tolerances and a third does not.

Defined cases: null and empty texts have no words and fail; groups of fewer than SMALL rows use
their medians and the tolerance alone; null lang or source is a group of its own; repeated rows
are judged one by one; extra columns stay, whatever
their names, and one named `quality_` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import neutral, stage, text_of, words_of

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The transformed statistics, each with its tolerance.
TOLERANCE = {"x_length": 0.06, "x_symbols": 0.20, "x_lines": 0.15, "x_repeats": 0.15}
X = tuple(TOLERANCE)
SMALL = 20
#: Concentration steps at most; fewer where nothing moves any more.
STEPS, MOVED = 10, 1e-6
#: Consistency factors of the covariance of the nearest 75 % and 97.5 % in four dimensions,
#: and the chi-square quantiles (4 degrees) at 0.975 and 0.999.
NEAREST, FACTOR_NEAREST, FACTOR_REWEIGHTED, REWEIGHT_AT, REJECT_AT = 0.75, 1.485, 1.065, 11.143, 18.467


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column `counts_` of BASE and n_lines, for whole texts.

    A window of three words is known by its 64-bit hash within its own text. The hashes of a text
    are compared first as plain longs; only texts with a repeat sort (hash, place) pairs.
    """
    inner, names = neutral(docs)
    df = inner.withColumn("t_", text_of(names[text])).withColumn("w_", words_of(F.col("t_")))
    df = df.withColumn("lines_", F.filter(F.split("t_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("w_")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.col("w_")[i], F.col("w_")[i + 1], F.col("w_")[i + 2]))
    df = df.withColumn("h_", F.when(n >= 3, window))
    repeats = F.size("h_") > F.size(F.array_distinct("h_"))
    df = df.withColumn("s_", F.when((n >= 3) & repeats, F.sort_array(F.transform("h_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.filter("s_", lambda x, k: ((k > 0) & (x["h"] == F.get("s_", k - 1)["h"])) | ((k < F.size("s_") - 1) & (x["h"] == F.get("s_", k + 1)["h"])))
    df = df.withColumn("p_", F.sort_array(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate(
        "p_",
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w_", "")).cast("long").alias("word_chars"),
        (F.length("t_") - F.length(F.regexp_replace("t_", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines_").cast("long").alias("n_lines"),
    )
    # a filter on the counts must not be pushed below this: it would take them apart and evaluate arrays within lambdas
    own = [F.col(n).alias(c) for c, n in names.items() if c not in ("counts_", "barrier_")]
    return df.select(*own, counts.alias("counts_"), F.monotonically_increasing_id().alias("barrier_"))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def statistics(c: Column) -> dict[str, Column]:
    """The transformed statistics; zero where a text has no words."""
    n, lines = c["n_words"], c["n_lines"]
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), a / F.greatest(b, F.lit(1)))))
    return {
        "x_length": F.log(F.greatest(c["word_chars"], F.lit(1)) / F.greatest(n, F.lit(1))),
        "x_symbols": F.log1p(10.0 * c["n_symbols"] / F.greatest(n, F.lit(1))),
        "x_lines": share(c["n_dup_lines"], lines),
        "x_repeats": share(c["n_repeat_words"], n),
    }


_PAIRS = [(i, j) for i in range(len(X)) for j in range(i + 1)]
_CENTRE = [f"m_{x}" for x in X]
_SCATTER = [f"c_{i}{j}" for i, j in _PAIRS]
#: The inverse of the scatter's Cholesky factor, and the logarithm of the determinant's root.
_FACTOR = [f"w_{i}{j}" for i, j in _PAIRS]


def _factored(moments: DataFrame) -> DataFrame:
    """moments (a small table of centres and scatters) with _FACTOR and logdet_."""
    out = []
    for i, j in _PAIRS:
        rest = " - ".join([f"c_{i}{j}", *(f"l_{i}{k} * l_{j}{k}" for k in range(j))])
        out.append(f"sqrt(greatest({rest}, 1e-9D)) as l_{i}{j}" if i == j else f"({rest}) / l_{j}{j} as l_{i}{j}")
    for j in range(len(X)):
        for i in range(j, len(X)):
            before = " + ".join(f"l_{i}{k} * w_{k}{j}" for k in range(j, i))
            out.append(f"{f'-({before})' if before else '1.0D'} / l_{i}{i} as w_{i}{j}")
    logdet = " + ".join(f"ln(l_{i}{i})" for i in range(len(X)))
    return moments.selectExpr("*", *out, f"{logdet} as logdet_").select(*moments.columns, *_FACTOR, "logdet_")


def _distance() -> Column:
    """Squared Mahalanobis distance of X from a joined row of _factored."""
    z = [" + ".join(f"w_{i}{j} * ({X[j]} - {_CENTRE[j]})" for j in range(i + 1)) for i in range(len(X))]
    return F.expr(" + ".join(f"pow({v}, 2D)" for v in z))


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Number, sums and sums of products of X."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_"), *(F.expr(f"sum({x}) as s_{x}") for x in X), *(F.expr(f"sum({X[i]} * {X[j]}) as p_{i}{j}") for i, j in _PAIRS))


def _moments(sums: DataFrame, factor: float, *keys: str) -> DataFrame:
    """Centre and corrected scatter, with tolerance, from _sums."""
    mean = [f"s_{x} / n_ as m_{x}" for x in X]
    plain = lambda i, j: f"{factor}D * (p_{i}{j} / n_ - s_{X[i]} / n_ * s_{X[j]} / n_)"
    scatter = [f"if(n_ < {SMALL}, 0D, {plain(i, j)}) + {TOLERANCE[X[i]] ** 2 if i == j else 0.0}D as c_{i}{j}" for i, j in _PAIRS]
    return sums.selectExpr(*keys, *mean, *scatter)


def _bin(d2: Column) -> Column:
    """The logarithm of a distance to one decimal: at most 271 values."""
    return F.round(F.greatest(F.lit(-7.0), F.least(F.lit(20.0), F.log(d2 + 1e-3))), 1)


def _step(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """A concentration step: moments, by group and start, of the nearest rows, and whether they moved."""
    keys = ["g_", "start_"]
    # a row for each group and start on the right: a small table is broadcast, so that a hot group stays spread
    binned = _sums(rows.join(moments, keys).select(*keys, *X, _bin(_distance()).alias("bin_")), *keys, "bin_")
    all_bins = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n_").over(all_bins.orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = binned.withColumn("before_", before).withColumn("all_", F.sum("n_").over(all_bins)).where(F.col("before_") < NEAREST * F.col("all_"))
    added = [c for c in binned.columns if c not in (*keys, "bin_")]
    new = _moments(near.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in added)), FACTOR_NEAREST, *keys)
    both = new.alias("a").join(moments.alias("b"), keys)
    moved = F.expr(" or ".join(f"abs(a.{c} - b.{c}) > {MOVED}D" for c in (*_CENTRE, *_SCATTER)))
    return both.select(*keys, *(f"a.{c}" for c in (*_CENTRE, *_SCATTER)), moved.alias("moved_"))


def estimate(slim: DataFrame) -> DataFrame:
    """Centre, scatter and factor of each group g_ of rows with X (reads its input several times)."""
    quartiles = slim.groupBy("g_").agg(*(F.percentile(F.round(x, 2), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(x) for x in X))
    ranges = [F.pow((F.col(X[i])[2] - F.col(X[i])[0]) / 1.349, F.lit(2.0)) + TOLERANCE[X[i]] ** 2 if i == j else F.lit(0.0) for i, j in _PAIRS]
    spread = stage(quartiles, "mcd")
    starts = [spread.select("g_", F.lit(k).alias("start_"), *(F.col(x)[at].alias(m) for x, m in zip(X, _CENTRE, strict=True)), *(c.alias(n) for c, n in zip(ranges, _SCATTER, strict=True))) for k, at in ((0, 1), (1, 0))]
    whole = _moments(_sums(slim, "g_"), 1.0, "g_")
    moments = stage(_factored(starts[0].union(starts[1]).union(whole.select("g_", F.lit(2).alias("start_"), *_CENTRE, *_SCATTER))), "mcd")
    many = slim.withColumn("start_", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    for _ in range(STEPS):
        moments = stage(_factored(_step(many, moments)), "mcd")
        if moments.where("moved_").isEmpty():
            break
    rank = F.struct(F.round("logdet_", 6), F.col("start_"))
    best = moments.groupBy("g_").agg(F.min_by(F.struct(*_CENTRE, *_FACTOR), rank).alias("m"))
    near = slim.join(stage(best.select("g_", "m.*"), "mcd"), "g_").where(_distance() <= REWEIGHT_AT)
    return stage(_factored(_moments(_sums(near, "g_"), FACTOR_REWEIGHTED, "g_")), "mcd")


def judge(docs: DataFrame, text: str = "text", keep_text: bool = False, reject_at: float = REJECT_AT) -> DataFrame:
    """docs, with the struct `quality_`: BASE, base_failed, distance2 and kept.

    The estimates read statistics that are held, without texts, in the shared folder. Without
    keep_text the text is left out of the result, and counts are taken once; with it they are
    taken again on the way out, so that texts are neither written nor shuffled.
    Centre and scatter come from rows that pass the base rules. Where a group has none of them
    its documents have all failed.
    """
    inner, names = neutral(docs)
    text_ = names[text]
    keys = F.concat_ws("/", *(F.when(F.col(names[c]).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(names[c]).cast("string"))) if c in names else F.lit("-") for c in ("lang", "source")))
    rows = with_counts(inner, text_).withColumn("g_", keys).withColumns(statistics(F.col("counts_"))).withColumn("f_", base_failed(F.col("counts_")))
    if keep_text:
        held = stage(rows.select("g_", "f_", *X), "quality")
    else:
        held = rows = stage(rows.drop(text_), "quality")
    measured = rows.join(estimate(held.where(~F.col("f_")).select("g_", *X)), "g_", "left").withColumn("d2_", _distance())
    verdict = F.struct(
        *(F.col("counts_")[c].alias(c) for c in BASE),
        F.col("f_").alias("base_failed"),
        F.when(~F.col("f_"), F.col("d2_")).alias("distance2"),
        (~F.col("f_") & (F.coalesce(F.col("d2_"), F.lit(0.0)) <= reject_at) & (F.col("barrier_") >= 0)).alias("kept"),
    )
    return measured.select(*(F.col(n).alias(c) for c, n in names.items() if c != "quality_" and (keep_text or c != text)), verdict.alias("quality_"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "quality_.n_words", *(f"quality_.{c}" for c in BASE[1:]), "quality_.base_failed", "quality_.kept", F.col("quality_.distance2").alias("distance2"))
