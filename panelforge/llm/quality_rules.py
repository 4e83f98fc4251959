"""Quality rules: word statistics, two fixed rules, and robust multivariate outliers per language and source.

All of it is DataFrame expressions. The statistics of a document come from array functions on its own row, so no text
is shuffled. The minimum-covariance-determinant (MCD) estimate of each (lang, source) group starts from two
deterministic estimates and takes concentration steps; a step is one partial aggregation over (group, distance bin), so
a group that holds a third of the rows is summed map-side like any other.

Defined results: a null text counts as empty (no words, base_failed). Null lang or source form groups of their own.
A group's centre and scatter are drawn towards those of its language, and these towards those of all passing rows, with
weight n / (n + prior) for its own, where n are its passing rows: one rule for groups of every size, none included.
Repeated rows are judged one by one.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACES, materialize, texts, words

DIMS = 4
#: Quantiles of the chi-square distribution with four degrees of freedom.
CHI2_75, CHI2_9999 = 5.385, 23.513
#: Smallest standard deviation of each transformed statistic: most clean texts have no symbols or repeats at all, which would make the covariance singular.
LEAST_SD = (0.05, 0.06, 0.12, 0.12)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def document_statistics(docs: DataFrame, *keep: str, window: int = 8) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of each whole text."""
    w = F.lit(window)
    a = texts(docs, *keep).withColumn("words", words(F.col("text")))
    a = a.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - window + 1), lambda i: F.xxhash64(F.slice("words", i, w)))
    a = a.withColumn("n_words", F.size("words").cast("long")).withColumn("grams", F.when(F.size("words") >= window, grams))
    chars = lambda gone: F.length(F.translate("text", gone, "")).cast("long")
    a = a.select(
        "doc_id", *keep, "n_words", "grams", chars(SPACES).alias("word_chars"), (F.length("text").cast("long") - chars("#*$%&|<>")).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # Only texts in which a window recurs sort their windows: neighbours with equal hashes give the places of repeats.
    recurs = F.size("grams") > F.size(F.array_distinct("grams"))
    a = a.withColumn("order", F.when(recurs, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twins = F.zip_with("order", F.slice("order", F.lit(2), F.size("order")), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    a = a.withColumn("at", F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))))
    steps = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda x, y: F.coalesce(F.least(w, y - x), w))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return a.withColumn("n_repeat_words", F.when(F.size("at") > 0, covered).otherwise(0).cast("long")).drop("grams", "order", "at")


def fixed_rules() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """x0 to x3: log mean word length, and square roots of the shares of symbols, repeated lines and repeated words."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return stats.withColumns({
        "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "x1": share("n_symbols", "word_chars"), "x2": share("n_dup_lines", "n_lines"), "x3": share("n_repeat_words", "n_words"),
    })


def _few(groups: DataFrame) -> DataFrame:
    """Parameters of groups, written in few files: by their size Spark then broadcasts them, rather than deal the rows by group."""
    return materialize(groups.coalesce(8), "mcd")


def _factor(params: DataFrame, least: float = 1.0) -> DataFrame:
    """Adds the Cholesky factor l_ij of the covariance c_ij, whose diagonal gets ``least`` times the least variances."""
    params = params.withColumns({f"c{i}{i}": F.col(f"c{i}{i}") + least * LEAST_SD[i] ** 2 for i in range(DIMS)})
    for j in range(DIMS):
        square = reduce(lambda s, k: s - F.col(f"l{j}{k}") ** 2, range(j), F.col(f"c{j}{j}"))
        params = params.withColumn(f"l{j}{j}", F.sqrt(F.greatest(square, F.lit(1e-9))))
        params = params.withColumns({f"l{i}{j}": reduce(lambda s, k: s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{j}{i}")) / F.col(f"l{j}{j}") for i in range(j + 1, DIMS)})
    logdet = 2 * reduce(lambda s, k: s + F.log(f"l{k}{k}"), range(1, DIMS), F.log("l00"))
    return params.withColumn("logdet", logdet).drop(*(f"c{i}{j}" for i, j in PAIRS))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(DIMS):
        rows = rows.withColumn(f"z{i}", reduce(lambda s, k: s - F.col(f"l{i}{k}") * F.col(f"z{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", reduce(lambda s, k: s + F.col(f"z{k}") ** 2, range(1, DIMS), F.col("z0") ** 2))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(DIMS)), *(F.sum(f"p{i}{j}").alias(f"p{i}{j}") for i, j in PAIRS)]
    a = rows.groupBy(*keys).agg(*sums)
    a = a.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(DIMS)})
    return a.withColumns({f"c{i}{j}": F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in PAIRS})


def _terms() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS)]


def minimum_covariance_determinant(rows: DataFrame, share: float = 0.75, steps: int = 3) -> DataFrame:
    """Centre m_i and Cholesky factor l_ij of each group (g_lang, g_source) of rows with x0 to x3.

    Two starts, all rows' moments and medians with quartile spreads, each take ``steps`` concentration steps towards the
    ``share`` of rows that lie nearest; the smaller determinant wins. The nearest rows are counted by bins of the
    logarithm of the distance (1/32 wide), the last bin whole. The covariance is scaled so that the distance of the last
    bin meets the chi-square quantile."""
    keys = ["g_lang", "g_source"]
    starts = rows.groupBy(*keys).agg(*_terms(), *(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIMS)))
    plain = starts.select(*keys, F.lit(0).alias("start"), *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIMS)), *((F.col(f"p{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") ** 2).alias(f"c{i}{j}") for i, j in PAIRS))
    middle = starts.select(*keys, F.lit(1).alias("start"), *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(DIMS)), *((((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS))
    params = _few(_factor(plain.unionByName(middle)))
    for _ in range(steps):
        bins = _distance(rows.join(params, keys)).withColumn("bin", F.floor(32 * F.log(F.col("d2") + 1e-6))).groupBy(*keys, "start", "bin").agg(*_terms())
        bins = materialize(bins, "bins")  # else the windows' keys would deal the partial sums, and a hot group's would meet in one task
        nearer = W.partitionBy(*keys, "start").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        everyone = W.partitionBy(*keys, "start")
        near = bins.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).withColumn("all", F.sum("n").over(everyone)).filter(F.col("before") < F.ceil(share * F.col("all")))
        edge = near.groupBy(*keys, "start").agg(F.exp((F.max("bin") + 1) / 32).alias("edge"))
        params = _factor(_moments(near, [*keys, "start"]).drop("n", *(f"s{i}" for i in range(DIMS)), *(f"p{i}{j}" for i, j in PAIRS)))
        params = _few(params.join(edge, [*keys, "start"]))
    best = params.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in params.columns if c not in keys)), F.struct("logdet", "start")).alias("best")).select(*keys, "best.*")
    best = _few(best)
    # The h-subset's covariance is too small for its distances: scale it up (never down) to meet the chi-square quantile.
    own = _distance(rows.join(best, keys)).withColumn("bin", F.floor(32 * F.log(F.col("d2") + 1e-6))).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    own = materialize(own, "bins")
    nearer = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    edge = own.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).withColumn("all", F.sum("n").over(W.partitionBy(*keys))).filter(F.col("before") < F.ceil(share * F.col("all"))).groupBy(*keys).agg(F.exp((F.max("bin") + 1) / 32).alias("reach"))
    return best.join(edge, keys).withColumn("scale", F.greatest(F.lit(1.0), F.col("reach") / CHI2_75)).select(*keys, *(f"m{i}" for i in range(DIMS)), *(f"l{i}{j}" for j, i in PAIRS), "scale")


def group_parameters(stats: DataFrame, prior: float) -> DataFrame:
    """Centre m_i and Cholesky factor l_ij by which each (g_lang, g_source) is judged: its own estimate drawn towards its
    language's, and that towards the one of all passing rows."""
    keys = ["g_lang", "g_source"]
    rows = materialize(stats.filter(~F.col("base_failed")).select(*keys, *(f"x{i}" for i in range(DIMS))), "vectors")
    level = lambda a, b: F.struct(a.alias("g_lang"), b.alias("g_source"))
    own, of_lang, of_all = level(F.col("g_lang"), F.col("g_source")), level(F.col("g_lang"), F.lit("\1")), level(F.lit("\1"), F.lit("\1"))
    # A row counts in its group's estimate, in its language's and in that of all.
    params = minimum_covariance_determinant(rows.select(F.explode(F.array(own, of_lang, of_all)).alias("by"), *(f"x{i}" for i in range(DIMS))).select("by.*", *(f"x{i}" for i in range(DIMS))))
    spread = {f"c{i}{j}": F.col("scale") * reduce(lambda s, k: s + F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(1, i + 1), F.col(f"l{i}0") * F.col(f"l{j}0")) for i, j in PAIRS}
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = _few(sizes.unionByName(sizes.groupBy("g_lang").agg(F.sum("n").alias("n")).withColumn("g_source", F.lit("\1"))))
    values = [f"m{i}" for i in range(DIMS)] + list(spread)
    params = _few(params.withColumns(spread).join(sizes, keys, "left").select(*keys, F.struct((F.col("n") / (F.col("n") + prior)).alias("w"), *values).alias("p")))
    groups = stats.select(*keys).distinct()
    groups = groups.join(params.withColumnRenamed("p", "own"), keys, "left")
    groups = groups.join(params.filter(F.col("g_source") == "\1").select("g_lang", F.col("p").alias("lang")), "g_lang", "left")
    everyone = params.filter((F.col("g_lang") == "\1") & (F.col("g_source") == "\1")).select(F.col("p").alias("all"))  # one row, or none
    groups = groups.withColumn("_one", F.lit(1)).join(everyone.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")

    def drawn(name: str, towards: Column) -> dict[str, Column]:
        return {v: F.when(F.col(name).isNull(), towards[v]).otherwise(F.col(name)["w"] * F.col(name)[v] + (1 - F.col(name)["w"]) * towards[v]) for v in values}

    of_language = F.struct(*(c.alias(v) for v, c in drawn("lang", F.col("all")).items()))
    groups = groups.select(*keys, "own", of_language.alias("lang"))
    return _factor(groups.select(*keys, *(c.alias(v) for v, c in drawn("own", F.col("lang")).items())), 0.0)


def quality_rules(docs: DataFrame, cutoff: float = CHI2_9999, prior: float = 50.0) -> DataFrame:
    """Statistics, base_failed and kept of each document, with the squared robust distance d2 (null: no document passed the fixed rules)."""
    named = docs.withColumns({"g_lang": F.coalesce("lang", F.lit("\0")), "g_source": F.coalesce("source", F.lit("\0"))})
    stats = materialize(vectors(document_statistics(named, "g_lang", "g_source")).withColumn("base_failed", fixed_rules()), "statistics")
    params = _few(group_parameters(stats, prior))
    judged = _distance(stats.join(params, ["g_lang", "g_source"], "left"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"), "d2",
    )
