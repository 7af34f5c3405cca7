"""Measures of scored candidates (query_id, rank, positive 0/1, p): all aggregate before they order anything."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import dealt, with_offsets

# What a model has to reach.
GATES = {"query_top1": (">=", 0.90), "auroc": (">=", 0.90), "ece": ("<=", 0.10), "precision": (">=", 0.85)}


def auroc(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Pairs won over pairs, ties half; null with one class only; one row, or one for each value of by.

    Scores are counted first, then distinct ones are dealt out by range: a task sums its own, and
    the sums below come from one row a key and range, so that no task orders all, of no key either.
    """
    key = [by] if by else []
    counts = scored.groupBy(*key, "p").agg(F.sum("positive").alias("pos"), F.sum(1 - F.col("positive")).alias("neg"))
    rows, sizes = dealt(counts, key, ["p"], F.col("neg"))
    own = F.sum("neg").over(Window.partitionBy(*key, "_range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    counts = with_offsets(rows, sizes, key, "_before")
    below = F.col("_before") + F.coalesce(own, F.lit(0))
    won = counts.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return won.groupBy(*key).agg(F.try_divide(F.sum("won"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"))


def ece(scored: DataFrame, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins (lo, hi], the first with 0."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col("p") * bins) - 1))
    by = scored.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg(F.col("positive").cast("double")).alias("acc"))
    return by.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def at_thresholds(scored: DataFrame, taus: list[int]) -> DataFrame:
    """(tau, selected, precision, recall) for thresholds in percent: rows are counted by the highest that they reach, then summed."""
    reached = scored.select("positive", F.try_element_at(F.filter(F.array(*map(F.lit, sorted(taus))), lambda t: t / 100 <= F.col("p")), F.lit(-1)).alias("top"))
    by = reached.groupBy("top").agg(F.count("*").alias("n"), F.sum("positive").alias("pos"))
    grid = scored.sparkSession.createDataFrame([(t,) for t in taus], "tau int")
    total = by.agg(F.sum("pos").alias("all_pos"))
    joined = grid.join(F.broadcast(by), F.col("top") >= F.col("tau"), "left").groupBy("tau").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("selected"), F.coalesce(F.sum("pos"), F.lit(0)).alias("hits"))
    return joined.crossJoin(F.broadcast(total)).select("tau", "selected", F.try_divide(F.col("hits"), F.col("selected").cast("double")).alias("precision"), F.try_divide(F.col("hits"), F.col("all_pos").cast("double")).alias("recall"))


def pick_threshold(scored: DataFrame, least_precision: float = 0.9) -> DataFrame:
    """The smallest of 30, 35 .. 90 percent with the precision, else 90."""
    good = at_thresholds(scored, list(range(30, 95, 5))).where(F.col("precision") >= least_precision)
    return good.agg(F.coalesce(F.min("tau"), F.lit(90)).alias("tau"))


def fit_temperature(logits: DataFrame) -> DataFrame:
    """(temperature, nll): of 0.50, 0.51 .. 5.00 that of least mean loss of sigmoid(z / t), the smaller of equals. Equal rows are counted first; the grid has 451 rows."""
    by = logits.groupBy("z", "positive").agg(F.count("*").alias("n"))
    grid = F.explode(F.sequence(F.lit(50), F.lit(500))).alias("t100")
    x = F.col("z") / (F.col("t100") / 100)
    signed = F.when(F.col("positive") == 1, x).otherwise(-x)
    loss = F.log1p(F.exp(-F.abs(signed))) + F.greatest(-signed, F.lit(0.0))
    by_t = by.select("z", "positive", "n", grid).groupBy("t100").agg(F.round(F.sum(loss * F.col("n")) / F.sum("n"), 9).alias("nll"))
    return by_t.agg(F.min_by("t100", F.struct("nll", "t100")).alias("t100"), F.min("nll").alias("nll")).select((F.col("t100") / 100).alias("temperature"), "nll")


def query_top1(scored: DataFrame) -> DataFrame:
    """Share of the queries with a positive whose best row, by p and then rank, is one."""
    by = scored.groupBy("query_id").agg(F.max("positive").alias("any"), F.min_by("positive", F.struct(-F.col("p"), "rank")).alias("top"))
    return by.where(F.col("any") == 1).agg(F.count("*").alias("n_queries"), F.avg(F.col("top").cast("double")).alias("top1"))


def none_rate(scored: DataFrame, tau: float) -> DataFrame:
    """Share of the queries without a positive of which no row reaches tau."""
    by = scored.groupBy("query_id").agg(F.max("positive").alias("any"), F.max("p").alias("best"))
    return by.where(F.col("any") == 0).agg(F.count("*").alias("n_queries"), F.avg((F.col("best") < tau).cast("double")).alias("none_rate"))


def score_states(states: DataFrame, scorer, column: str = "state") -> DataFrame:
    """With p: scorer, made once a worker, maps a list of states to a list of probabilities; a wrong number of answers is an error."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer()
        for batch in batches:
            out = list(score(batch.tolist()))
            if len(out) != len(batch):
                raise ValueError("one judgement a state is needed")
            yield pd.Series(out, dtype="float64")

    return states.withColumn("p", run(column))


def metric_breakdown(scored: DataFrame, tau: float, keys: list[str], bins: int = 15) -> DataFrame:
    """(key, value, n_rows, n_queries, auroc, ece, query_top1, none_rate, precision, recall, selected) over all rows (key overall) and for each value of each key.

    Every row is stacked once a key, then all measures are aggregates by (key, value).
    """
    stack = F.array(F.struct(F.lit("overall").alias("key"), F.lit("all").alias("value")), *(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))
    rows = scored.select("query_id", "rank", "positive", "p", F.explode(stack).alias("g")).withColumn("g", F.to_json("g"))
    chosen = F.col("p") >= tau
    base = rows.groupBy("g").agg(F.count("*").alias("n_rows"), F.countDistinct("query_id").alias("n_queries"), F.count_if(chosen).alias("selected"), F.sum(F.when(chosen, F.col("positive"))).alias("hits"), F.sum("positive").alias("all_pos"))
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col("p") * bins) - 1))
    by_bin = rows.groupBy("g", bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg(F.col("positive").cast("double")).alias("acc"))
    errors = by_bin.groupBy("g").agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))
    by_query = rows.groupBy("g", "query_id").agg(F.max("positive").alias("any"), F.min_by("positive", F.struct(-F.col("p"), "rank")).alias("top"), F.max("p").alias("best"))
    queries = by_query.groupBy("g").agg(F.avg(F.when(F.col("any") == 1, F.col("top").cast("double"))).alias("query_top1"), F.avg(F.when(F.col("any") == 0, (F.col("best") < tau).cast("double"))).alias("none_rate"))
    out = base.join(errors, "g").join(queries, "g").join(auroc(rows, "g"), "g")
    g = F.from_json("g", "key string, value string")
    return out.select(g.key.alias("key"), g.value.alias("value"), "n_rows", "n_queries", "auroc", "ece", "query_top1", "none_rate", F.try_divide(F.col("hits"), F.col("selected").cast("double")).alias("precision"), F.try_divide(F.col("hits"), F.col("all_pos").cast("double")).alias("recall"), "selected")


def acceptance_gate(metrics: DataFrame) -> DataFrame:
    """(metric, value, threshold, passed) of one row of metrics; missing values and NaN fail."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(f"{op} {t:.2f}").alias("threshold"), (F.coalesce(F.col(m) >= t if op == ">=" else F.col(m) <= t, F.lit(False)) & ~F.isnan(F.coalesce(F.col(m).cast("double"), F.lit(0.0)))).alias("passed")) for m, (op, t) in GATES.items()]
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def bake_off(scored: DataFrame, least_precision: float = 0.9) -> DataFrame:
    """(model, tau, ..): measures of each model (column model) at the threshold that suits it best."""
    taus = list(range(30, 95, 5))
    reached = scored.select("model", "positive", F.explode(F.filter(F.array(*map(F.lit, taus)), lambda t: t / 100 <= F.col("p"))).alias("tau"))
    good = reached.groupBy("model", "tau").agg(F.avg(F.col("positive").cast("double")).alias("precision")).where(F.col("precision") >= least_precision).groupBy("model").agg(F.min("tau").alias("tau"))
    picked = scored.join(scored.select("model").distinct().join(good, "model", "left").select("model", F.coalesce("tau", F.lit(90)).alias("tau")), "model")
    chosen = F.col("p") >= F.col("tau") / 100
    base = picked.groupBy("model").agg(F.first("tau").alias("tau"), F.count("*").alias("n_rows"), F.countDistinct("query_id").alias("n_queries"), F.count_if(chosen).alias("selected"), F.try_divide(F.sum(F.when(chosen, F.col("positive"))), F.count_if(chosen).cast("double")).alias("precision"), F.try_divide(F.sum(F.when(chosen, F.col("positive"))), F.sum("positive").cast("double")).alias("recall"))
    return base.join(auroc(scored, "model"), "model")


def calibrated_gate(val: DataFrame, test: DataFrame) -> DataFrame:
    """Temperature from the logits z of val, its threshold, and with both the gate on test: (metric, value, threshold, passed)."""
    t = fit_temperature(val.select("z", "positive")).head().temperature
    p = 1 / (1 + F.exp(-F.col("z") / F.lit(t)))
    tau = pick_threshold(val.withColumn("p", p)).head().tau / 100
    return acceptance_gate(metric_breakdown(test.withColumn("p", p), tau, []))


def permille(p):
    """A probability in thousandths, rounded and kept within 0..1000."""
    return F.least(F.lit(1000), F.greatest(F.lit(0), F.round(p * 1000))).cast("int")


def clamped_temperature(t):
    return F.least(F.lit(5.0), F.greatest(F.lit(0.5), t))
