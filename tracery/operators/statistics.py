"""Statistics of scored runs: intervals from resampled clusters, paired tests, agreement of raters, graded ranking, variance over passes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered
from .runs import apart, plain_path

#: Draws that one digest gives: each takes six of its hexadecimal digits.
DRAWS = 5
#: Chance of at most k of a Poisson variable of mean 1, for the k whose chance of more is above 2**-24.
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(11)]


def poisson_weights(cluster: Column, replicates: int) -> Column:
    """An array of as many numbers as replicates: how often each takes the cluster, from md5 of the cluster and the replicate's fifth part."""
    digests = F.array(*(F.md5(F.concat_ws("|", cluster.cast("string"), F.lit(str(b))).cast("binary")) for b in range(-(-replicates // DRAWS))))
    u = F.flatten(F.transform(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda k: F.conv(F.substring(d, k * 6 + 1, F.lit(6)), 16, 10).cast("double") / 16777216)))
    bounds = F.array(*(F.lit(x) for x in POISSON))
    return F.slice(F.transform(u, lambda x: F.size(F.filter(bounds, lambda b: b <= x))), 1, replicates)


def bootstrap(rows: DataFrame, by: list[str], cluster: str, value: str, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """(by.., n, clusters, mean, low, high): means and their intervals, where the rows of a cluster come and go together.

    Values are summed by cluster first, and the replicates are as many columns of sums, so that
    no row is repeated and a group of any size leaves each task as one row. A replicate that takes
    no cluster has no mean; the bounds are nearest ranks of the others. Null values don't count;
    the rows of a null cluster are one cluster.
    """
    known = rows.where(F.col(value).isNotNull()).groupBy(*by, F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("_cluster")).agg(F.sum(F.col(value).cast("double")).alias("_sum"), F.count("*").alias("_n"))
    w = known.withColumn("_w", poisson_weights(F.col("_cluster"), replicates))
    sums = [x for r in range(replicates) for x in (F.sum(F.col("_w")[r] * F.col("_sum")).alias(f"_s{r}"), F.sum(F.col("_w")[r] * F.col("_n")).alias(f"_k{r}"))]
    got = w.groupBy(*by).agg(F.sum("_n").alias("n"), F.count("*").alias("clusters"), (F.sum("_sum") / F.sum("_n")).alias("mean"), *sums)
    means = F.array_sort(F.filter(F.array(*(F.try_divide(F.col(f"_s{r}"), F.col(f"_k{r}")) for r in range(replicates))), lambda x: x.isNotNull()))
    at = lambda q: F.try_element_at(F.col("_means"), F.greatest(F.lit(1), F.ceil(F.round(q * F.size("_means"), 9)).cast("int")))
    tail = (1 - level) / 2
    return got.withColumn("_means", means).select(*by, "n", "clusters", "mean", at(tail).alias("low"), at(1 - tail).alias("high"))


def ln_factorial(n: Column) -> Column:
    """Natural logarithm of a whole number's factorial: exact below 20, else by its series, whose next term is below 1e-15."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return F.when(n < 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided chance of so uneven a split of b + c discordant pairs, 1 where there is none.

    The largest term of the tail is taken in logarithms; the others follow from it by their
    ratios, as many as can change a double.
    """
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    top = F.exp(ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) - n * math.log(2))
    steps = F.least(k, F.ceil(7 * F.sqrt(n.cast("double"))).cast("long") + 40)
    # of 1 + k/(n-k+1) + k(k-1)/((n-k+1)(n-k+2)) + ..
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(a, j):
        term = a.term * (k - j) / (n - k + j + 1)
        return F.struct(term.alias("term"), (a.total + term).alias("total"))

    total = F.when(steps > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(steps - 1, F.lit(0))), zero, add, lambda a: a.total)).otherwise(1.0)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * top * total))


def mcnemar(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by.., n, both, only_a, only_b, neither, difference, p): two ways of answering the same queries; a pair with a null on either side doesn't count.

    difference is the share of a less that of b.
    """
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    known = pairs.where(x.isNotNull() & y.isNotNull())
    got = known.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    return got.withColumns({"difference": (F.col("only_a") - F.col("only_b")) / F.col("n"), "p": mcnemar_p(F.col("only_a"), F.col("only_b"))})


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys.., a, b) of the keys that both have: the value of each, or its mean where a key repeats, as over passes."""
    one = lambda df, name: df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(name))
    return one(a, "a").join(one(b, "b"), keys)


RATED = ["rubric", "row_id", "finding_idx"]


def _rated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both raters' grades of each rubric and finding; finding_idx is null for a grade of the whole row. Of repeated grades the smallest counts."""
    one = lambda df, name: df.groupBy(*RATED).agg(F.min("grade").alias(name))
    a, b = one(a, "grade_a"), one(b, "grade_b").withColumnsRenamed({k: f"_{k}" for k in RATED})
    same = a.rubric.eqNullSafe(b._rubric) & a.row_id.eqNullSafe(b._row_id) & a.finding_idx.eqNullSafe(b._finding_idx)
    return a.join(b, same, "full").select(*(F.coalesce(k, f"_{k}").alias(k) for k in RATED), "grade_a", "grade_b")


def kappa(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rubric, n, unpaired, agreement, chance, kappa) of two raters' grades (rubric, row_id, finding_idx, grade): unweighted, from the table of grades and its margins; null where chance agreement is whole, as with a single grade."""
    rows = _rated(a, b)
    ok = F.col("grade_a").isNotNull() & F.col("grade_b").isNotNull()
    cells = rows.where(ok).groupBy("rubric", "grade_a", "grade_b").agg(F.count("*").alias("n"))
    margin = lambda c: cells.groupBy("rubric", F.col(c).alias("grade")).agg(F.sum("n").alias(c))
    chance = margin("grade_a").join(margin("grade_b"), ["rubric", "grade"]).groupBy("rubric").agg(F.sum(F.col("grade_a").cast("double") * F.col("grade_b")).alias("product"))
    own = rows.groupBy("rubric").agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("unpaired"), F.count_if(ok & (F.col("grade_a") == F.col("grade_b"))).alias("same"))
    got = own.join(chance, "rubric", "left")
    got = got.withColumns({"agreement": F.try_divide(F.col("same").cast("double"), F.col("n").cast("double")), "chance": F.try_divide(F.coalesce("product", F.lit(0.0)), F.col("n").cast("double") * F.col("n"))})
    return got.select("rubric", "n", "unpaired", "agreement", "chance", F.try_divide(F.col("agreement") - F.col("chance"), 1 - F.col("chance")).alias("kappa"))


def adjudication(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rubric, row_id, finding_idx, grade_a, grade_b) that two raters disagree on; what only one has rated is no disagreement."""
    return _rated(a, b).where("grade_a <> grade_b")


def adjudicated(a: DataFrame, b: DataFrame, decisions: DataFrame) -> DataFrame:
    """(rubric, row_id, finding_idx, grade): what both agree on or one alone has rated, and what was decided (grade) where they don't; undecided ones are null."""
    d = decisions.groupBy(*RATED).agg(F.min("grade").alias("decided")).withColumnsRenamed({k: f"_{k}" for k in RATED})
    rows = _rated(a, b)
    same = rows.rubric.eqNullSafe(d._rubric) & rows.row_id.eqNullSafe(d._row_id) & rows.finding_idx.eqNullSafe(d._finding_idx)
    split = F.coalesce(F.col("grade_a") != F.col("grade_b"), F.lit(False))
    return rows.join(d, same, "left").select(*RATED, F.when(split, F.col("decided")).otherwise(F.coalesce("grade_a", "grade_b")).alias("grade"))


#: Relevance of a target by its role.
RELEVANCE = {"primary": 2, "equivalent": 1}


def graded(runs: DataFrame, findings: DataFrame, targets: DataFrame) -> DataFrame:
    """(run_id, query_id, pos, relevance) of findings (run_id, pos, path, line_start, line_end): 2 for a primary target, 1 for an equivalent one, else 0.

    A finding meets a target on its path whose span it overlaps; without lines on either side the
    path is enough. A target counts once, for the first finding that meets it; a finding that
    meets several takes the best of those that are its own.
    """
    relevance = F.coalesce(*(F.when(F.col("role") == k, v) for k, v in RELEVANCE.items()))
    t = targets.select("query_id", plain_path(F.col("path")).alias("path"), F.col("span_start").alias("t_start"), F.coalesce("span_end", "span_start").alias("t_end"), relevance.alias("relevance")).where("relevance > 0").distinct()
    f = findings.withColumn("path", plain_path(F.col("path"))).join(apart(runs.select("run_id", "query_id")), "run_id")
    whole = F.col("line_start").isNull() | F.col("t_start").isNull()
    met = f.join(apart(t), ["query_id", "path"]).where(whole | (F.col("line_start") <= F.col("t_end")) & (F.col("t_start") <= F.coalesce("line_end", "line_start")))
    own = met.groupBy("run_id", "query_id", "path", "t_start", "t_end", "relevance").agg(F.min("pos").alias("pos"))
    best = own.groupBy("run_id", "path", "pos").agg(F.max("relevance").alias("relevance"))
    return f.select("run_id", "query_id", "path", "pos").join(apart(best), ["run_id", "path", "pos"], "left").fillna(0, ["relevance"]).drop("path")


def ranking_quality(runs: DataFrame, findings: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """(run_id, query_id, n_targets, precision, ndcg) of every run: the share of its first k findings that are relevant, out of k, and the discounted gain 2**relevance - 1 over that of all targets in their best order.

    Findings are ranked by pos; ties among these share no rank, the order of their relevance
    decides. A query without targets has no ndcg (null); a run without findings has 0 where its
    query has any.
    """
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("pos", F.desc("relevance")))
    first = graded(runs, findings, targets).withColumn("place", place).where(F.col("place") <= k)
    gain = lambda c, at: (F.pow(F.lit(2.0), F.col(c)) - 1) / F.log2(F.col(at) + 1)
    got = first.groupBy("run_id").agg(F.count_if(F.col("relevance") > 0).alias("relevant"), F.sum(gain("relevance", "place")).alias("dcg"))
    n = lambda role: F.count_if(F.col("role") == role)
    counts = targets.select("query_id", plain_path(F.col("path")).alias("path"), "span_start", F.coalesce("span_end", "span_start").alias("span_end"), "role").distinct().groupBy("query_id").agg(n("primary").alias("two"), n("equivalent").alias("one"))
    # the best order has the primary ones first
    slots = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + F.when((i > a) & (i <= b), 1 / F.log2(i + 1)).otherwise(0.0))
    ideal = 3 * slots(F.lit(0), F.col("two")) + slots(F.col("two"), F.col("two") + F.col("one"))
    counts = counts.select("query_id", (F.col("two") + F.col("one")).alias("n_targets"), ideal.alias("ideal"))
    rows = runs.select("run_id", "query_id").join(apart(counts), "query_id", "left").join(apart(got), "run_id", "left")
    dcg = F.coalesce("dcg", F.lit(0.0))
    return rows.select("run_id", "query_id", F.coalesce("n_targets", F.lit(0)).alias("n_targets"), (F.coalesce("relevant", F.lit(0)) / k).alias("precision"), F.when(F.col("ideal") > 0, dcg / F.col("ideal")).alias("ndcg"))


def pass_variance(runs: DataFrame, findings: DataFrame, passes: list[int]) -> DataFrame:
    """(query_id, n_passes, distinct_top, jaccard, stage_agreement) of queries over the passes named.

    runs: (run_id, query_id, pass, stage), findings as above. jaccard is the mean over pairs of
    passes of the overlap of their findings (path and lines), 1 for two empty ones; stage_agreement
    the share of pairs of one stage; both null with fewer than two passes. distinct_top counts the
    files of first findings, none for a run without. Each query's passes lie side by side in one
    row, so that pairs are bounded by the passes named; of a pass that repeats, findings count
    together and the first stage by name.
    """
    f = findings.select("run_id", "pos", F.struct(plain_path(F.col("path")).alias("path"), "line_start", "line_end").alias("place"))
    rows = runs.where(F.col("pass").isin(list(passes))).join(apart(f), "run_id", "left")
    by = []
    for i, p in enumerate(passes):
        own = F.col("pass") == p
        by += [F.count_if(own).alias(f"n{i}"), F.collect_set(F.when(own, F.col("place"))).alias(f"set{i}"), F.min(F.when(own, F.col("stage"))).alias(f"stage{i}"), F.min_by(F.when(own & F.col("place").isNotNull(), F.col("place.path")), F.when(own & F.col("place").isNotNull(), F.struct("pos", "place.path"))).alias(f"top{i}")]
    got = rows.groupBy("query_id").agg(*by)
    pairs = []
    for i in range(len(passes)):
        for j in range(i + 1, len(passes)):
            a, b = F.col(f"set{i}"), F.col(f"set{j}")
            union = F.size(F.array_union(a, b))
            near = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
            pairs.append(F.when((F.col(f"n{i}") > 0) & (F.col(f"n{j}") > 0), F.struct(near.alias("near"), F.col(f"stage{i}").eqNullSafe(F.col(f"stage{j}")).cast("double").alias("same"))))
    known = F.filter(F.array(*pairs), lambda x: x.isNotNull()) if pairs else F.array().cast("array<struct<near:double,same:double>>")
    mean = lambda c: F.try_divide(F.aggregate("pairs", F.lit(0.0), lambda s, x: s + x[c]), F.size("pairs").cast("double"))
    n_passes = sum((F.col(f"n{i}") > 0).cast("int") for i in range(len(passes)))
    tops = F.size(F.array_distinct(F.filter(F.array(*(F.col(f"top{i}") for i in range(len(passes)))), lambda x: x.isNotNull())))
    return got.withColumn("pairs", known).select("query_id", n_passes.alias("n_passes"), tops.alias("distinct_top"), mean("near").alias("jaccard"), mean("same").alias("stage_agreement"))


def blind_export(rows: DataFrame, shown: list[str], hidden: list[str], seed: str) -> tuple[DataFrame, DataFrame]:
    """(blind, key): rows in an order drawn from a seed and their content, with row_id as their place; blind has what is shown to raters, key what is hidden.

    Both come from one numbered table, so that they stay together. Equal rows are drawn together.
    """
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.to_json(F.struct(*shown, *hidden))).cast("binary"))
    placed = numbered(rows.select(*shown, *hidden).withColumn("_draw", draw), [F.col("_draw")], "row_id").drop("_draw")
    return placed.select("row_id", *shown), placed.select("row_id", *hidden)
