"""Statistics of labels, rankings, shares and trials as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PSI_FLOOR = 1e-4


def confusion(rows: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1, 0 where undefined, and whether there was nothing to find or to say."""
    t, p = F.col(truth), F.col(predicted)
    counts = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count("*").alias("n"))
    both = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.withColumns({
        "precision": F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0),
        "recall": F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0),
        "f1": F.when(both > 0, 2 * F.col("tp") / both).otherwise(0.0),
        "empty": both == 0,
    })


def f1_summary(confusions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro F1, macro F1 of classes with positives in truth (null without any), and micro F1."""
    some = F.col("tp") + F.col("fn") > 0
    whole = 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")
    return confusions.groupBy(*(by or [])).agg(
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(some, F.col("f1"))).alias("assessable_f1"),
        F.when(whole > 0, 2 * F.sum("tp") / whole).otherwise(0.0).alias("micro_f1"),
    )


def kappa(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa of two yes/no annotators; null when chance agreement is 1."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = rows.groupBy(*by).agg(F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)).alias("agreed"), F.avg(x).alias("pa"), F.avg(y).alias("pb"), F.count("*").alias("n"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select(*by, "n", "agreed", F.when(chance < 1, (F.col("agreed") - chance) / (1 - chance)).alias("kappa"))


def weighted_kappa(rows: DataFrame, a: str, b: str, categories: int) -> DataFrame:
    """Quadratic weights over grades 0..categories-1, others raise; null when no disagreement is expected."""
    wrong = ~F.col(a).between(0, categories - 1) | ~F.col(b).between(0, categories - 1)
    rows = rows.withColumn(a, F.when(wrong, F.raise_error(F.lit("a grade is out of range")).cast("int")).otherwise(F.col(a)))
    n = rows.agg(F.count("*").alias("n"))
    joint = rows.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("c"))
    left, right = joint.groupBy("i").agg(F.sum("c").alias("r")), joint.groupBy("j").agg(F.sum("c").alias("s"))
    weight = ((F.col("i") - F.col("j")) / (categories - 1)) ** 2
    seen = joint.agg(F.sum(weight * F.col("c")).alias("seen"))
    # categories x categories rows
    chance = left.crossJoin(right).agg(F.sum(weight * F.col("r") * F.col("s")).alias("chance"))
    return seen.crossJoin(chance).crossJoin(n).select("n", F.when(F.col("chance") > 0, 1 - F.col("seen") * F.col("n") / F.col("chance")).alias("kappa"))


def calibration(rows: DataFrame, by: list[str], truth: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins (1 belongs to the last), and Brier score."""
    t = F.col(truth).cast("double")
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    cells = rows.withColumn("_bin", place).groupBy(*by, "_bin").agg(F.count("*").alias("n"), F.avg(t).alias("rate"), F.avg(p).alias("mean"), F.sum((F.col(p) - t) ** 2).alias("sq"))
    return cells.groupBy(*by).agg(
        (F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean"))) / F.sum("n")).alias("ece"),
        (F.sum("sq") / F.sum("n")).alias("brier"),
    )


def best_cut(rows: DataFrame, by: list[str], truth: str, p: str, default: float = 0.5) -> DataFrame:
    """The cut with the highest F1, halfway to the next lower score; of equal ones the highest; default without positives.

    Equal scores are counted first, so a group is at most as long as it has distinct scores.
    """
    each = rows.groupBy(*by, p).agg(F.count_if(F.col(truth)).alias("_hit"), F.count("*").alias("_n"))
    down, whole = Window.partitionBy(*by).orderBy(F.col(p).desc()), Window.partitionBy(*by)
    tp, said = F.sum("_hit").over(down), F.sum("_n").over(down)
    scored = each.withColumns({"_f1": 2 * tp / (said + F.sum("_hit").over(whole)), "_below": F.coalesce(F.lead(p).over(down), F.lit(0.0)), "_positives": F.sum("_hit").over(whole)})
    top = scored.groupBy(*by).agg(F.max_by(F.struct(p, "_below"), F.struct("_f1", p)).alias("_top"), F.max("_positives").alias("_positives"))
    middle = (F.col(f"_top.{p}") + F.col("_top._below")) / 2
    cut = F.when(middle > F.col("_top._below"), middle).otherwise(F.col(f"_top.{p}"))
    return top.select(*by, F.when(F.col("_positives") > 0, cut).otherwise(default).alias("cut"))


def labels_at(probabilities: Column, cuts: Column) -> Column:
    return F.zip_with(probabilities, cuts, lambda p, c: p >= c)


def shares(rows: DataFrame, by: list[str], category: Column, name: str = "category") -> DataFrame:
    counts = rows.groupBy(*by, category.alias(name)).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def top_or_other(value: str, top: list[str], other: str = "other") -> Column:
    return F.when(F.col(value).isin(*top), F.col(value)).otherwise(other)


def length_bin(length: Column, edges: list[float]) -> Column:
    """Number of edges at or below log10 of the length."""
    log = F.log10(F.greatest(length, F.lit(1)).cast("double"))
    return F.concat(F.lit("bin"), sum((F.when(log >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("string"))


def psi(reference: DataFrame, current: DataFrame, by: list[str], category: str = "category", share: str = "share") -> DataFrame:
    """Population stability index; shares have a floor, over the union of categories."""
    r = reference.select(*by, category, F.col(share).alias("_r"))
    c = current.select(*by, category, F.col(share).alias("_c"))
    both = r.join(c, [*by, category], "full_outer").na.fill(0.0, ["_r", "_c"])
    a, b = F.greatest("_r", F.lit(PSI_FLOOR)), F.greatest("_c", F.lit(PSI_FLOOR))
    return both.groupBy(*by).agg(F.sum((b - a) * F.ln(b / a)).alias("psi"))


def uncertain_share(rows: DataFrame, p: str, cut: str, band: float = 0.1) -> DataFrame:
    return rows.agg(F.avg(F.when(F.abs(F.col(p) - F.col(cut)) <= band, 1.0).otherwise(0.0)).alias("uncertain"))


def ranking_metrics(run: DataFrame, grades: DataFrame, k: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """ndcg, mrr and recall at k for each query with a relevant item; others have nulls and are left out of means."""
    joined = run.where(F.col("rank") <= k).join(grades, [query, item], "left").na.fill(0, ["grade"])
    got = joined.groupBy(query).agg(
        F.sum(F.col("grade") / F.log2(F.col("rank") + 1.0)).alias("_dcg"),
        F.count_if(F.col("grade") > 0).alias("_hits"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("_first"),
    )
    order = F.row_number().over(Window.partitionBy(query).orderBy(F.col("grade").desc(), item))
    ideal = grades.where("grade > 0").withColumn("_i", order)
    ideal = ideal.groupBy(query).agg(F.sum(F.when(F.col("_i") <= k, F.col("grade") / F.log2(F.col("_i") + 1.0))).alias("_ideal"), F.count("*").alias("_relevant"))
    queries = grades.select(query).distinct()
    out = queries.join(ideal, query, "left").join(got, query, "left").na.fill(0, ["_hits"]).na.fill(0.0, ["_dcg"])
    some = F.col("_relevant") > 0
    return out.select(
        query,
        F.when(some, F.col("_dcg") / F.col("_ideal")).alias("ndcg"),
        F.when(some, F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        F.when(some, F.col("_hits") / F.col("_relevant")).alias("recall"),
    )


def mean_of_known(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("counted"), F.count_if(F.col(value).isNull()).alias("left_out"))


def trial_metrics(trials: DataFrame, by: list[str]) -> DataFrame:
    """Bias, error, coverage (a missing bound is infinite), false alarms at no effect, and power, of estimated trials."""
    low, high = F.coalesce("lo", F.lit(float("-inf"))), F.coalesce("hi", F.lit(float("inf")))
    gap = F.col("estimate") - F.col("truth")
    off = F.when((low > 0) | (high < 0), 1.0).otherwise(0.0)
    return trials.where("estimate is not null").groupBy(*by).agg(
        F.count("*").alias("trials"),
        F.avg(gap).alias("bias"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.when((low <= F.col("truth")) & (F.col("truth") <= high), 1.0).otherwise(0.0)).alias("coverage"),
        F.avg(F.when(F.col("truth") == 0, off)).alias("false_alarms"),
        F.avg(F.when(F.col("truth") != 0, off)).alias("power"),
    )


def decomposition(buckets: DataFrame, by: list[str]) -> DataFrame:
    """Shift-share parts in points of rows (bucket, p0, n0, p1, n1): a bucket empty on one side takes the other's share."""
    whole = Window.partitionBy(*by)
    w0, w1 = F.col("n0") / F.sum("n0").over(whole), F.col("n1") / F.sum("n1").over(whole)
    r0, r1 = F.when(F.col("n0") > 0, F.col("p0") / F.col("n0")), F.when(F.col("n1") > 0, F.col("p1") / F.col("n1"))
    s0 = F.coalesce(r0, r1, F.lit(0.0))
    cells = buckets.withColumns({"_w0": w0, "_w1": w1, "_s0": s0, "_s1": F.coalesce(r1, s0)})
    dw, ds = F.col("_w1") - F.col("_w0"), F.col("_s1") - F.col("_s0")
    parts = cells.groupBy(*by).agg(
        (100 * F.sum(dw * F.col("_s0"))).alias("composition"),
        (100 * F.sum(F.col("_w0") * ds)).alias("within"),
        (100 * F.sum(dw * ds)).alias("interaction"),
    )
    return parts.withColumn("total", F.col("composition") + F.col("within") + F.col("interaction"))


def prevalence(rows: DataFrame, code: str, category: str, values: list[str]) -> DataFrame:
    """Counts of each code over the given categories side by side, 0 where absent."""
    return rows.groupBy(code).pivot(category, values).count().na.fill(0)


def class_weights(rows: DataFrame, by: list[str], truth: str) -> DataFrame:
    """Negatives over positives; null without positives, which callers treat as an error."""
    counts = rows.groupBy(*by).agg(F.count_if(F.col(truth)).alias("positives"), F.count_if(~F.col(truth)).alias("negatives"))
    return counts.withColumn("weight", F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")))


def percentile_thresholds(rows: DataFrame, by: list[str], value: str, percentile: float = 0.99) -> DataFrame:
    return rows.groupBy(*by).agg(F.percentile(value, percentile).alias("threshold"))


def latencies(rows: DataFrame, by: list[str], query: str, ms: str) -> DataFrame:
    """Median and 95th percentile over tries, and that percentile of each query's fastest try."""
    fastest = rows.groupBy(*by, query).agg(F.min(ms).alias("_best")).groupBy(*by).agg(F.percentile("_best", 0.95).alias("p95_fastest"))
    return rows.groupBy(*by).agg(F.percentile(ms, 0.5).alias("p50"), F.percentile(ms, 0.95).alias("p95")).join(fastest, by)


def pooled_rate(runs: DataFrame, order: str, rate: str, n: str, last: int = 10) -> DataFrame:
    """Weighted mean of the last rows; null if there are fewer."""
    top = runs.orderBy(F.col(order).desc()).limit(last)
    return top.agg(F.when(F.count("*") == last, F.sum(F.col(rate) * F.col(n)) / F.sum(n)).alias("rate"))


def repeated_calls(calls: DataFrame, by: list[str], tool: str, arguments: str, order: str) -> DataFrame:
    """Calls, and those whose tool and arguments were seen before in the same run."""
    seen = F.row_number().over(Window.partitionBy(*by, tool, arguments).orderBy(order))
    return calls.withColumn("_again", seen > 1).groupBy(*by).agg(F.count("*").alias("calls"), F.count_if("_again").alias("repeats"))


def top_code(rows: DataFrame, by: list[str], code: str, mentions: str, position: str) -> DataFrame:
    """The code with most mentions, of equal ones the first in order."""
    return rows.groupBy(*by).agg(F.max_by(code, F.struct(F.col(mentions), -F.col(position))).alias(code))


def weekly_agreement(rows: DataFrame, week: str, code: str, truth: str, predicted: str) -> DataFrame:
    """Per week and code F1 and support, and the week's assessable macro F1."""
    each = confusion(rows, [week, code], truth, predicted).withColumn("support", F.col("tp") + F.col("fn"))
    some = F.when(F.col("support") > 0, F.col("f1"))
    return each.select(week, code, "f1", "support", F.avg(some).over(Window.partitionBy(week)).alias("macro_f1"))


def model_differences(rows: DataFrame, case: str, model: str, value: str) -> DataFrame:
    """Mean paired difference of every two models over the cases that both have a value for."""
    each = rows.where(F.col(value).isNotNull())
    a = each.select(case, F.col(model).alias("model_a"), F.col(value).alias("_a"))
    b = each.select(case, F.col(model).alias("model_b"), F.col(value).alias("_b"))
    both = a.join(b, case).where("model_a < model_b")
    return both.groupBy("model_a", "model_b").agg(F.avg(F.col("_a") - F.col("_b")).alias("difference"), F.count("*").alias("cases"))


def chosen(candidates: DataFrame, mean: str, floor: float, margin: float, cost: str) -> DataFrame:
    """The best candidate at or over the floor; of those within the margin of the best, the cheapest."""
    fit = candidates.where(F.col(mean) >= floor)
    best = fit.agg(F.max(mean).alias("_best"))  # one row
    tied = fit.crossJoin(F.broadcast(best)).where(F.col(mean) >= F.col("_best") - margin).drop("_best")
    return tied.orderBy(cost, F.col(mean).desc()).limit(1)


def cross_validated_f1(rows: DataFrame, fold: str, folds: int, code: str, truth: str, p: str) -> DataFrame:
    """F1 of each code at cuts chosen on the other folds, pooled over all folds."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col(fold))
    cuts = best_cut(rows.withColumn("_k", F.explode(others)), ["_k", code], truth, p).withColumnRenamed("_k", fold)
    judged = rows.join(cuts, [fold, code]).withColumn("_said", F.col(p) >= F.col("cut"))
    return confusion(judged, [code], truth, "_said").select(code, "f1")
