"""Model evaluation: ranks, curves, calibration and gates. Cases are (*by, predicted, label) or (*by, predicted, measured)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.core.session import bounded, checkpoint


def _zero(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def running(values: DataFrame, by: list[str], key: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``values`` with running sums of columns within each group, in the order of ``key``; a key occurs once in its group.

    Rows are range-partitioned and each slice summed on its own; the sums of
    the slices before it, of which there are as many as shuffle partitions,
    are added. So a group of any size spreads over tasks.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(key).desc() if descending else F.col(key).asc()
    cut = checkpoint(values.repartitionByRange(parts, *by, order).withColumn("__slice", F.spark_partition_id()))
    slices = cut.groupBy(*by, "__slice").agg(*[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(*by).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(*[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)], F.col("__slice").alias("__at_slice"), *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__sum_{n}") for n in sums])
    on = [F.col("__slice") == F.col("__at_slice"), *[F.col(c).eqNullSafe(F.col(f"__by_{i}")) for i, c in enumerate(by)]]
    here = W.partitionBy(*by, "__slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = cut.select("*", *[F.sum(c).over(here).alias(f"__own_{n}") for n, c in sums.items()])
    for i, condition in enumerate(on[1:], 1):
        on[0] = on[0] & condition
    return rows.join(bounded(checkpoint(slices), 100_000), on[0]).select(*values.columns, *[(F.col(f"__own_{n}") + F.col(f"__sum_{n}")).alias(n) for n in sums])


def with_rank(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Ranks from 1, ties averaged, from counts of distinct values: only those are sorted."""
    values = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running(values, by, column, {"__upto": "__n"}).select(*by, column, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*by, column])


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """0 where either side does not vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (spread > 0), F.covar_pop(x, y) / F.when(spread > 0, spread))
    return df.groupBy(*by).agg(_zero(r).alias("pearson"), F.count(F.lit(1)).alias("n"))


def _slope(x: str, y: str) -> Column:
    return F.when(F.min(x) < F.max(x), F.covar_pop(x, y) / F.when(F.var_pop(x) > 0, F.var_pop(x))).otherwise(0.0)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    ranked = with_rank(with_rank(df.select(*by, x, y), by, x, "__x"), by, y, "__y")
    return pearson(ranked, by, "__x", "__y").withColumnRenamed("pearson", "spearman")


def regression(df: DataFrame, by: list[str], x: str = "predicted", y: str = "measured") -> DataFrame:
    """(slope, intercept, r2 of the prediction as it is); slope 0 and the mean where x does not vary, r2 0 where y does not."""
    total = F.sum(F.pow(F.col(y) - F.col("__m"), F.lit(2)))
    rows = df.join(df.groupBy(*by).agg(F.avg(y).alias("__m")), by) if by else df.crossJoin(F.broadcast(df.agg(F.avg(y).alias("__m"))))
    return rows.groupBy(*by).agg(
        _slope(x, y).alias("slope"), (F.avg(y) - _slope(x, y) * F.avg(x)).alias("intercept"),
        F.when(total > 0, 1 - F.sum(F.pow(F.col(y) - F.col(x), F.lit(2))) / F.when(total > 0, total)).otherwise(0.0).alias("r2"),
    )


def curve(cases: DataFrame, by: list[str]) -> DataFrame:
    """One row for each distinct score from the highest: cases and positives of that score, and up to it."""
    g = cases.groupBy(*by, "predicted").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    return running(g, by, "predicted", {"n_to": "n", "pos_to": "pos"}, descending=True)


def ranking_metrics(cases: DataFrame, by: list[str]) -> DataFrame:
    """(n, positives, pr_auc, pr_auc_skill, roc_auc, top_k_accuracy) for each group; 0 where a class is missing.

    Everything comes from the counts of distinct scores, so ties are handled
    in bulk: average precision by score, pair counts for the ROC area, and
    expected credit where the k-th place falls into a tie.
    """
    c = curve(cases, by)
    total = c.groupBy(*by).agg(F.sum("n").alias("n_all"), F.sum("pos").alias("pos_all"))
    rows = c.join(total, by) if by else c.crossJoin(F.broadcast(total))
    ap = F.sum(F.when(F.col("pos_all") > 0, F.col("pos") / F.col("pos_all") * F.col("pos_to") / F.col("n_to")).otherwise(0.0))
    neg = F.col("n") - F.col("pos")
    below = F.col("n_all") - F.col("pos_all") - (F.col("n_to") - F.col("pos_to"))
    wins = F.sum((F.col("pos") * below + F.col("pos") * neg * 0.5).cast("double"))
    before = F.col("n_to") - F.col("n")
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("pos_all") - before))
    credit = F.sum(F.col("pos") * taken / F.col("n"))
    out = rows.groupBy(*by, "n_all", "pos_all").agg(ap.alias("pr_auc"), wins.alias("w"), credit.alias("c"))
    share = F.col("pos_all") / F.col("n_all")
    both = (F.col("pos_all") > 0) & (F.col("pos_all") < F.col("n_all"))
    return out.select(
        *by, F.col("n_all").alias("n"), F.col("pos_all").alias("positives"), "pr_auc", F.when(both, (F.col("pr_auc") - share) / (1 - F.when(both, share).otherwise(0.0))).otherwise(0.0).alias("pr_auc_skill"),
        F.when(both, F.col("w") / F.when(both, F.col("pos_all") * (F.col("n_all") - F.col("pos_all"))).otherwise(1)).otherwise(0.0).alias("roc_auc"),
        F.when(F.col("pos_all") > 0, F.col("c") / F.when(F.col("pos_all") > 0, F.col("pos_all")).otherwise(1)).otherwise(0.0).alias("top_k_accuracy"),
    )


def threshold_metrics(cases: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(mcc, brier, brier_skill) for each group; 0 where undefined."""
    hit, pos = F.col("predicted") >= threshold, F.col("label") == 1
    rows = cases.groupBy(*by).agg(
        F.count_if(hit & pos).cast("double").alias("tp"), F.count_if(hit & ~pos).cast("double").alias("fp"), F.count_if(~hit & pos).cast("double").alias("fn"), F.count_if(~hit & ~pos).cast("double").alias("tn"),
        F.avg(F.pow(F.col("predicted") - F.col("label"), F.lit(2))).alias("brier"), F.avg("label").alias("share"),
    )
    under = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    base = F.col("share") * (1 - F.col("share"))
    return rows.select(
        *by, F.when(under > 0, (F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / F.when(under > 0, under).otherwise(1.0)).otherwise(0.0).alias("mcc"), "brier",
        F.when(base > 0, 1 - F.col("brier") / F.when(base > 0, base).otherwise(1.0)).otherwise(0.0).alias("brier_skill"),
    )


def reliability(cases: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of equal-width bins, the last one closed; empty bins have no row."""
    b = F.greatest(F.lit(0), F.least(F.floor(F.col("predicted") * bins), F.lit(bins - 1))).cast("int")
    return cases.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("confidence"), F.avg("label").alias("accuracy"))


def calibration_error(cases: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    r = reliability(cases, by, bins)
    return r.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def quartile_range(df: DataFrame, by: list[str], column: str) -> DataFrame:
    return df.groupBy(*by).agg((F.percentile(column, F.lit(0.75)) - F.percentile(column, F.lit(0.25))).alias("iqr"))


def conformal(df: DataFrame, by: list[str], residual: str, coverage: float = 0.9) -> DataFrame:
    """(n, q, covered): the k-th smallest residual, k = ceil((n + 1) * coverage), infinite if there are fewer; and the share within q."""
    values = df.groupBy(*by, residual).agg(F.count(F.lit(1)).alias("c"))
    values = running(values, by, residual, {"upto": "c"})
    total = values.groupBy(*by).agg(F.sum("c").alias("n"))
    rows = values.join(total, by) if by else values.crossJoin(F.broadcast(total))
    rows = rows.withColumn("k", F.ceil((F.col("n") + 1) * F.lit(coverage) - 1e-9))
    q = F.min(F.when(F.col("upto") >= F.col("k"), F.col(residual)))
    out = rows.groupBy(*by, "n").agg(F.coalesce(q, F.lit(math.inf)).alias("q"), F.min(F.when(F.col("upto") >= F.col("k"), F.col("upto"))).alias("within"))
    return out.select(*by, "n", "q", (F.coalesce("within", "n") / F.col("n")).alias("covered"))


def site_gate(cases: DataFrame, stratum: str, minimum: float = 0.5, fewest_groups: int = 2) -> DataFrame:
    """Overall and per stratum: metrics, the reasons against passing, and passed; cases have (group, stratum, predicted, label)."""
    every = cases.withColumn("stratum", F.lit("overall")).unionByName(cases.withColumn("stratum", F.col(stratum).cast("string")))
    m = ranking_metrics(every, ["stratum"]).join(threshold_metrics(every, ["stratum"]), "stratum").join(calibration_error(every, ["stratum"]), "stratum")
    m = m.join(every.groupBy("stratum").agg(F.count_distinct("group").alias("groups")), "stratum")
    reasons = F.array_compact(F.array(
        F.when((F.col("positives") == 0) | (F.col("positives") == F.col("n")), F.lit("one class")), F.when(F.col("groups") < fewest_groups, F.lit("too few groups")),
        F.when(F.col("pr_auc_skill") < minimum, F.lit("low skill")),
    ))
    return m.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("passed", F.size(reasons) == 0)


def numbered_groups(cases: DataFrame, group: str = "group") -> DataFrame:
    """(group, number): the distinct groups from 1, in their order."""
    return running(cases.select(group).distinct().withColumn("__one", F.lit(1)), [], group, {"number": "__one"}).select(group, "number")


def expression_gate(cases: DataFrame, share: float = 0.5, coverage: float = 0.9, least_rho: float = 0.3, tolerance: float = 0.1) -> DataFrame:
    """Grouped split, within-group centring, a link fitted on the calibration fold, and coverage of its conformal band on the rest.

    The first groups by name, ``share`` of them and at least one, are the
    calibration fold. One row; the link, the band and the rank correlation are
    aggregates of one row each.
    """
    groups = checkpoint(numbered_groups(cases))
    most = math.ceil(share * groups.count() - 1e-9)
    means = cases.groupBy("group").agg(F.avg("predicted").alias("__p"), F.avg("measured").alias("__m"))
    rows = cases.join(means, "group").join(groups.select("group", (F.col("number") <= most).alias("calibration")), "group")
    rows = checkpoint(rows.select("group", "calibration", (F.col("predicted") - F.col("__p")).alias("x"), (F.col("measured") - F.col("__m")).alias("y")))
    link = rows.where("calibration").agg(F.coalesce(_slope("x", "y"), F.lit(0.0)).alias("slope"), F.coalesce(F.avg("y") - _slope("x", "y") * F.avg("x"), F.lit(0.0)).alias("intercept")).first()
    rows = rows.withColumn("residual", F.abs(F.col("y") - (F.lit(link["slope"]) * F.col("x") + F.lit(link["intercept"]))))
    band = conformal(rows.where("calibration"), [], "residual", coverage).first()
    q = math.inf if band is None else band["q"]
    rest = rows.where("not calibration")
    out = rest.agg(F.avg(F.when(F.col("residual") <= q, 1.0).otherwise(0.0)).alias("covered"), F.lit(q).alias("q"), F.count(F.lit(1)).alias("n_test"))
    rho = spearman(rest.withColumn("__all", F.lit(1)), ["__all"], "x", "y").agg(F.coalesce(F.max("spearman"), F.lit(0.0)).alias("spearman"))
    out = out.crossJoin(F.broadcast(rho))
    return out.withColumn("passed", F.coalesce((F.col("spearman") >= least_rho) & (F.abs(F.col("covered") - coverage) <= tolerance), F.lit(False)))


def resampled(cases: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """The cases with columns draw and copies: in each draw as many groups as there are, with replacement, chosen by a seeded hash.

    Draws are counted by group before they meet the cases; nothing is drawn
    on the driver.
    """
    groups = checkpoint(numbered_groups(cases))
    n = groups.count()
    pick = F.pmod(F.xxhash64(F.lit(seed), "draw", "slot"), F.lit(max(n, 1))) + 1
    slots = cases.sparkSession.range(draws * n).select((F.col("id") / max(n, 1)).cast("long").alias("draw"), (F.col("id") % max(n, 1)).alias("slot"))
    plan = slots.select("draw", pick.alias("number")).groupBy("draw", "number").agg(F.count(F.lit(1)).alias("copies"))
    return cases.join(groups, "group").join(plan, "number").drop("number")


def cluster_bootstrap(cases: DataFrame, statistic, draws: int = 200, level: float = 0.95, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of ``statistic(cases, by)`` over resampled groups; NaN under 20 valid draws.

    Replicates are one grouped query; one number a draw comes to the driver.
    """
    drawn = resampled(cases, draws, seed).withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    values = sorted(r[0] for r in statistic(drawn, ["draw"]).collect() if r[0] is not None and not math.isnan(r[0]))
    if len(values) < 20:
        return math.nan, math.nan
    at = lambda p: values[min(len(values) - 1, max(0, round(p * (len(values) - 1))))]
    return at((1 - level) / 2), at((1 + level) / 2)


def median_interval(values: DataFrame, group: str, value: str, draws: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row (median, low, high): the median over groups(group, value), and a percentile interval from resampled groups."""
    rows = values.select(F.col(group).alias("group"), F.col(value).alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    each = resampled(rows, draws, seed).groupBy("draw").agg(F.percentile("__v", F.lit(0.5), F.col("copies")).alias("m"))
    ends = each.agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"))
    return rows.agg(F.percentile("__v", F.lit(0.5)).alias("median")).crossJoin(F.broadcast(ends))


def promotion(passed: bool, low: float, baselines: dict[str, float], width_over_iqr: float) -> dict[str, object]:
    """Whether a model is promoted: it passes its gate, the interval's lower end beats every baseline, and the interval is narrower than the spread."""
    best = max(baselines.items(), key=lambda b: (b[1], b[0])) if baselines else ("none", -math.inf)
    beats, informative = low > best[1], width_over_iqr < 1.0
    return {"best_baseline": best[0], "best_baseline_score": best[1], "beats_every_baseline": beats, "interval_is_informative": informative, "promotable": bool(passed and beats and informative)}


def sign_test(wins: int, losses: int) -> float:
    """Exact two-sided binomial p-value; 1 without trials."""
    n = wins + losses
    if not n:
        return 1.0
    tail = sum(math.comb(n, k) for k in range(min(wins, losses) + 1))
    return min(1.0, 2 * tail / 2**n)


def call_agreement(scores: DataFrame, top_k: int = 3) -> DataFrame:
    """(backend_a, backend_b, both, only_a, only_b, jaccard) of each backend's top calls by window; scores(backend, window, pos, score)."""
    best = W.partitionBy("backend", "window").orderBy(F.col("score").desc(), "pos")
    calls = scores.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top_k).select("backend", "window", "pos")
    names = calls.select("backend").distinct()
    pairs = names.select(F.col("backend").alias("backend_a")).join(names.select(F.col("backend").alias("backend_b")), F.col("backend_a") < F.col("backend_b"))
    a = calls.join(F.broadcast(pairs), calls["backend"] == pairs["backend_a"]).select("backend_a", "backend_b", "window", "pos", F.lit(1).alias("a"))
    b = calls.join(F.broadcast(pairs), calls["backend"] == pairs["backend_b"]).select("backend_a", "backend_b", "window", "pos", F.lit(1).alias("b"))
    both = a.join(b, ["backend_a", "backend_b", "window", "pos"], "full_outer")
    n = both.groupBy("backend_a", "backend_b").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    return n.withColumn("jaccard", F.col("both") / (F.col("both") + F.col("only_a") + F.col("only_b")))


def call_correlation(scores: DataFrame, top_k: int = 3) -> DataFrame:
    """(backend_a, backend_b, n, spearman) of both backends' scores at the positions that either calls; a position without a score has 0."""
    best = W.partitionBy("backend", "window").orderBy(F.col("score").desc(), "pos")
    calls = scores.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top_k).select("backend", "window", "pos")
    names = calls.select("backend").distinct()
    pairs = F.broadcast(names.select(F.col("backend").alias("backend_a")).join(names.select(F.col("backend").alias("backend_b")), F.col("backend_a") < F.col("backend_b")))
    either = calls.join(pairs, (F.col("backend") == F.col("backend_a")) | (F.col("backend") == F.col("backend_b"))).select("backend_a", "backend_b", "window", "pos").distinct()
    side = lambda n, v: scores.select(F.col("backend").alias(n), "window", "pos", F.col("score").alias(v))
    both = either.join(side("backend_a", "x"), ["backend_a", "window", "pos"], "left").join(side("backend_b", "y"), ["backend_b", "window", "pos"], "left").na.fill(0.0, ["x", "y"])
    return spearman(both, ["backend_a", "backend_b"], "x", "y")
