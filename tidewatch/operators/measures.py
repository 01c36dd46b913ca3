"""How well scores find labelled anomalies.  Tables: scored points (series_id, idx, score, label), one row per series out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import sums
from tidewatch.operators.ranks import from_the_top
from tidewatch.operators.segments import BUCKET, bucket, in_runs, merged, overlapping, runs, runs_over
from tidewatch.sources.lineage import materialise

STEPS = 100


def by_threshold(scored: DataFrame) -> DataFrame:
    """For each distinct score: points and positives at or above it (n_at, p_at), its own, and the totals n and p."""
    steps = scored.groupBy("series_id", "score").agg(F.count("*").alias("n_own"), F.sum("label").alias("p_own"))
    return from_the_top(steps, ["series_id"], "score", {"n_own": ("n_at", "n"), "p_own": ("p_at", "p")})


def roc_auc(scored: DataFrame) -> DataFrame:
    """Null where a series has labels of one kind only."""
    t = by_threshold(scored)
    area = (F.col("n_own") - F.col("p_own")) * (F.col("p_at") - F.col("p_own") / 2)
    return t.groupBy("series_id").agg(F.expr("CASE WHEN max(p) > 0 AND max(p) < max(n) THEN 1D END").alias("_ok"), F.sum(area).alias("_area"), F.max(F.col("p") * (F.col("n") - F.col("p"))).alias("_all")).select("series_id", F.when(F.col("_ok").isNotNull(), F.col("_area") / F.when(F.col("_all") > 0, F.col("_all"))).alias("auc_roc"))


def average_precision(scored: DataFrame) -> DataFrame:
    t = by_threshold(scored).filter("p > 0")
    return t.groupBy("series_id").agg(F.sum(F.col("p_own") / F.col("p") * (F.col("p_at") / F.col("n_at"))).alias("auc_pr"))


def best_f1(scored: DataFrame) -> DataFrame:
    """The best point-wise F1 over all thresholds."""
    t = by_threshold(scored).filter("p > 0").withColumn("_pr", F.col("p_at") / F.col("n_at")).withColumn("_re", F.col("p_at") / F.col("p"))
    return t.groupBy("series_id").agg(F.max(2 * F.col("_pr") * F.col("_re") / (F.col("_pr") + F.col("_re") + 1e-5)).alias("f1"))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def f1_of_predictions(predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 of pred; 0 where one is undefined."""
    counts = predicted.groupBy("series_id").agg(F.sum(F.col("label") * F.col("pred")).alias("tp"), F.sum("pred").alias("pp"), F.sum("label").alias("p"))
    return counts.select("series_id", _safe(F.col("tp"), F.col("pp")).alias("precision"), _safe(F.col("tp"), F.col("p")).alias("recall"), _safe(2 * F.col("tp"), F.col("pp") + F.col("p")).alias("f1"))


def three_sigma(scored: DataFrame) -> DataFrame:
    """Add pred: scores over the mean plus three deviations."""
    limit = scored.groupBy("series_id").agg((sums.mean("score") + 3 * sums.deviation("score")).alias("_limit"))
    return scored.join(limit, "series_id").withColumn("pred", (F.col("score") > F.col("_limit")).cast("int")).drop("_limit")


def over_percentile(scored: DataFrame, contamination: float) -> DataFrame:
    """Add pred: scores over the percentile that leaves the contamination."""
    limit = scored.groupBy("series_id").agg(F.percentile("score", 1 - contamination).alias("_limit"))
    return scored.join(limit, "series_id").withColumn("pred", (F.col("score") > F.col("_limit")).cast("int")).drop("_limit")


def precision_at_n(scored: DataFrame) -> DataFrame:
    """Precision among scores over the percentile that leaves as many points as there are positives."""
    steps = by_threshold(scored).filter("p > 0")
    # The percentile between two neighbours in ascending order, linear as numpy's default, from counts of distinct scores.
    at = (F.col("n") - 1) * (1 - F.col("p") / F.col("n"))
    low, first, last = F.floor(at), F.col("n") - F.col("n_at"), F.col("n") - F.col("n_at") + F.col("n_own") - 1
    value = lambda place: F.max(F.when((first <= place) & (place <= last), F.col("score")))
    ends = steps.groupBy("series_id").agg(value(low).alias("_a"), value(F.least(low + 1, F.col("n") - 1)).alias("_b"), F.first(at - low).alias("_part"))
    limits = ends.select("series_id", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("_limit"))
    hits = steps.join(limits, "series_id").filter("score > _limit").groupBy("series_id").agg((F.sum("p_own") / F.sum("n_own")).alias("precision"))
    return limits.select("series_id").join(hits, "series_id", "left").select("series_id", F.coalesce("precision", F.lit(0.0)).alias("precision_at_n"))


def grid(scored: DataFrame, steps: int = STEPS) -> DataFrame:
    """series_id, k and theta: thresholds in equal steps from the least to the greatest score."""
    ends = scored.groupBy("series_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (steps - 1)
    rows = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return rows.select("series_id", "k", F.when(F.col("k") == steps - 1, F.col("hi")).otherwise(F.col("lo") + F.col("k") * step).alias("theta"))


def passed(scored: DataFrame, steps: int = STEPS) -> DataFrame:
    """Add passed: how many thresholds of the grid a score is over.  It is over threshold k if k < passed."""
    ends = scored.groupBy("series_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / (steps - 1)
    theta = lambda k: F.when(k == steps - 1, F.col("_hi")).otherwise(F.col("_lo") + k * step)
    # About how many, put right by the thresholds on both sides of it.
    about = F.least(F.greatest(F.coalesce(F.ceil((F.col("score") - F.col("_lo")) / F.nullif(step, F.lit(0.0))), F.lit(0)), F.lit(0)), F.lit(steps)).cast("int")
    rows = scored.join(ends, "series_id").withColumn("_k", about)
    k = F.col("_k")
    more = ((k < steps) & (theta(k) < F.col("score"))).cast("int")
    less = ((k > 0) & (theta(k - 1) >= F.col("score"))).cast("int")
    return rows.withColumn("passed", k + more - less).drop("_lo", "_hi", "_k")


def _counts(with_passed: DataFrame, what: Column, name: str) -> DataFrame:
    """series_id, k and how much of ``what`` lies in points over threshold k, for each k with any."""
    steps = with_passed.groupBy("series_id", "passed").agg(F.sum(what).alias("_n"))
    return steps.filter("passed > 0").select("series_id", F.explode(F.sequence(F.lit(0), F.col("passed") - 1)).alias("k"), "_n").groupBy("series_id", "k").agg(F.sum("_n").alias(name))


def adjusted_f1(scored: DataFrame) -> DataFrame:
    """F1 after point adjustment, the best over the grid: a run with one point found counts as found whole.

    The first point of a series is never adjusted, only found by itself.
    """
    p = passed(scored)
    own = in_runs(p).groupBy("series_id", "seg_id", "s", "e").agg(F.max("passed").alias("passed"), F.max(F.when(F.col("idx") == 0, F.col("passed"))).alias("_first"))
    whole = own.withColumn("_size", F.col("e") - F.greatest("s", F.lit(1)) + 1)
    tp = _counts(whole, F.col("_size"), "tp")
    at_zero = _counts(own.filter("_first IS NOT NULL").select("series_id", F.col("_first").alias("passed")), F.lit(1), "tp0")
    fp = _counts(p, 1 - F.col("label"), "fp")
    positives = scored.groupBy("series_id").agg(F.sum("label").alias("p")).filter("p > 0")
    rows = grid(scored).select("series_id", "k").join(positives, "series_id")
    for c in (tp, at_zero, fp):
        rows = rows.join(c, ["series_id", "k"], "left")
    hit = F.coalesce("tp", F.lit(0)) + F.coalesce("tp0", F.lit(0))
    rows = rows.withColumn("f1", _safe(2 * hit, hit + F.coalesce("fp", F.lit(0)) + F.col("p")))
    return rows.groupBy("series_id").agg(F.max("f1").alias("pa_f1"))


def adjustment_latency(predicted: DataFrame) -> DataFrame:
    """How long until a run is found: the sum of the offsets of first hits over the number of runs found."""
    hits = in_runs(predicted).filter("pred = 1")
    firsts = hits.groupBy("series_id", "seg_id", "s").agg(F.min("idx").alias("_hit"))
    found = firsts.groupBy("series_id").agg(F.sum(F.col("_hit") - F.col("s")).alias("_late"), F.count("*").alias("_n"))
    return predicted.select("series_id").distinct().join(found, "series_id", "left").select("series_id", (F.coalesce("_late", F.lit(0)) / (F.coalesce("_n", F.lit(0)) + 1e-4)).alias("latency"))


def event_f1(scored: DataFrame) -> DataFrame:
    """The best F of the share of runs found and the point-wise precision; a run that reaches the end counts without its last point."""
    p = passed(scored)
    last = scored.groupBy("series_id").agg(F.max("idx").alias("_last"))
    best = in_runs(p).join(last, "series_id").filter("idx < _last").groupBy("series_id", "seg_id").agg(F.max("passed").alias("passed"))
    hits = _counts(best, F.lit(1), "hits")
    tp, pp = _counts(p, F.col("label"), "tp"), _counts(p, F.lit(1), "pp")
    total = runs(scored).groupBy("series_id").agg(F.count("*").alias("events"))
    rows = grid(scored).select("series_id", "k").join(total, "series_id")
    for c in (hits, tp, pp):
        rows = rows.join(c, ["series_id", "k"], "left")
    recall = F.coalesce("hits", F.lit(0)) / F.col("events")
    precision = _safe(F.coalesce("tp", F.lit(0)), F.coalesce("pp", F.lit(0)))
    rows = rows.withColumn("_r", recall).withColumn("_p", precision)
    return rows.groupBy("series_id").agg(F.max(2 * F.col("_r") * F.col("_p") / (F.col("_r") + F.col("_p") + 1e-15)).alias("event_f1"))


def _weight(lo: Column, hi: Column, s: Column, e: Column, bias: str) -> Column:
    """Sum of the weights of the indices lo to hi of a run from s to e: 1 each, or falling, rising or highest in the middle of a run of its length.

    As is usual the weight is that of the index in the series, not in the run.
    """
    length, total = e - s + 1, lambda a, b: F.when(a <= b, (b - a + 1) * (a + b) / 2).otherwise(F.lit(0.0))
    if bias == "flat":
        return (hi - lo + 1).cast("double")
    if bias == "back":
        return total(lo, hi)
    falling = lambda a, b: F.when(a <= b, (b - a + 1) * (length + 1)).otherwise(F.lit(0)) - total(a, b)
    if bias == "front":
        return falling(lo, hi)
    if bias != "middle":
        raise ValueError(f"no bias {bias!r}")
    half = F.floor(length / 2)
    return total(lo, F.least(hi, half)) + falling(F.greatest(lo, half + 1), hi)


def _range_scores(found: DataFrame, truth: DataFrame, keys: list[str], alpha: float, bias: str) -> DataFrame:
    """keys, _r (the sum over true runs of existence, and of overlap times cardinality) and _p (the sum over found runs of overlap times cardinality).

    found: keys, q, qs and qe; truth: series_id, seg_id, s and e.
    """
    pairs = overlapping(found, truth, ("qs", "qe"), ("s", "e"))
    lo, hi = F.greatest("s", "qs"), F.least("e", "qe")

    # A run's share that the other side covers, over the number of runs that cover it.
    def side(key: str, begin: str, end: str) -> DataFrame:
        s, e = F.col(begin), F.col(end)
        part = F.sum(_weight(lo, hi, s, e, bias)) / F.first(_weight(s, e, s, e, bias)) / F.count("*")
        return pairs.groupBy(*keys, key).agg(part.alias("_part"))

    recall = side("seg_id", "s", "e").groupBy(*keys).agg(F.sum(alpha + (1 - alpha) * F.col("_part")).alias("_r"), F.count("*").alias("_met"), F.sum("_part").alias("_overlap"))
    precision = side("q", "qs", "qe").groupBy(*keys).agg(F.sum("_part").alias("_p"))
    return recall.join(precision, keys, "full")


def range_f1(scored: DataFrame, alpha: float = 0.2, bias: str = "flat") -> DataFrame:
    """The best F of range recall (existence, and overlap times cardinality) and range precision over the grid; bias: flat, front, back or middle."""
    found = runs_over(passed(scored)).withColumnsRenamed({"s": "qs", "e": "qe"})
    truth = runs(scored)
    sums = _range_scores(found, truth, ["series_id", "k"], alpha, bias)
    n_found = found.groupBy("series_id", "k").agg(F.count("*").alias("_nf"))
    n_truth = truth.groupBy("series_id").agg(F.count("*").alias("_nt"))
    rows = grid(scored).select("series_id", "k").join(n_truth, "series_id").join(n_found, ["series_id", "k"], "left").join(sums, ["series_id", "k"], "left")
    r, p = F.coalesce("_r", F.lit(0.0)) / F.col("_nt"), F.coalesce(F.col("_p") / F.col("_nf"), F.lit(0.0))
    rows = rows.withColumn("_re", r).withColumn("_pr", p)
    return rows.groupBy("series_id").agg(F.max(_safe(2 * F.col("_re") * F.col("_pr"), F.col("_re") + F.col("_pr"))).alias("r_f1"))


def range_of_predictions(predicted: DataFrame, alpha: float = 0.2, bias: str = "flat") -> DataFrame:
    """range_recall, existence, overlap, range_precision and r_f1 of pred; existence and overlap are the two parts of the recall."""
    found = runs(predicted, "pred").select("series_id", F.col("seg_id").alias("q"), F.col("s").alias("qs"), F.col("e").alias("qe"))
    truth = runs(predicted)
    sums = _range_scores(found, truth, ["series_id"], alpha, bias)
    n_found, n_truth = (x.groupBy("series_id").agg(F.count("*").alias(n)) for x, n in ((found, "_nf"), (truth, "_nt")))
    rows = n_truth.join(n_found, "series_id", "left").join(sums, "series_id", "left")
    zero = lambda a, b: F.coalesce(F.col(a) / F.col(b), F.lit(0.0))
    rows = rows.select("series_id", zero("_r", "_nt").alias("range_recall"), zero("_met", "_nt").alias("existence"), zero("_overlap", "_nt").alias("overlap"), zero("_p", "_nf").alias("range_precision"))
    r, p = F.col("range_recall"), F.col("range_precision")
    return rows.withColumn("r_f1", _safe(2 * r * p, r + p))


def _areas(cells: DataFrame, keys: list[str]) -> DataFrame:
    """auc_roc and auc_pr of cells with k, tpr, fpr and precision, in the order of k."""
    order = Window.partitionBy(*keys).orderBy("k")
    steps = cells.withColumn("_t", F.lag("tpr", 1, 0.0).over(order)).withColumn("_f", F.lag("fpr", 1, 0.0).over(order)).withColumn("_last", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("k"))))
    end = F.when(F.col("_last") == 1, (1 - F.col("fpr")) * (1 + F.col("tpr")) / 2).otherwise(F.lit(0.0))
    return steps.groupBy(*keys).agg(F.sum((F.col("fpr") - F.col("_f")) * (F.col("tpr") + F.col("_t")) / 2 + end).alias("auc_roc"), F.sum((F.col("tpr") - F.col("_t")) * F.col("precision")).alias("auc_pr"))


def rank_grid(scored: DataFrame, steps: int = 250) -> DataFrame:
    """series_id, k, theta, n_at, n: the scores at ``steps`` places of the descending order, and how many points are at or above each.

    A distinct score knows the places that it takes, from n_at less its own points on, and so which of the k (whose
    places are floor(k * (n - 1) / (steps - 1))) are its own.
    """
    t = by_threshold(scored.select("series_id", "score", F.lit(0).alias("label")))
    first = lambda place: F.expr(f"CASE WHEN n = 1 THEN {steps} * ({place}) ELSE (({place}) * {steps - 1}L + n - 2) DIV (n - 1) END")
    ends = t.withColumn("_lo", first("n_at - n_own")).withColumn("_hi", F.least(first("n_at"), F.lit(steps)) - 1).filter("_lo <= _hi")
    return ends.select("series_id", F.explode(F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int"))).alias("k"), F.col("score").alias("theta"), "n", "n_at")


def volume_under_surface(scored: DataFrame, width: int, steps: int = 250, first_width: int = 0) -> DataFrame:
    """vus_roc and vus_pr: the mean, over buffers of 0 to ``width`` points, of the areas under the range-aware curves.

    Every cell (buffer, threshold) is a prefix sum: only points within half a buffer of a run have a soft label
    beside their own, so what is added for a buffer is a row for each such point, summed up by the first threshold
    that takes it in; nothing is computed point by point for each cell.
    """
    truth = runs(scored).withColumn("w", F.explode(F.sequence(F.lit(first_width), F.lit(width)))).withColumn("_left", F.floor(F.col("w") / 2)).withColumn("_right", F.col("_left"))
    return _volume(scored, truth, F.greatest("w", F.lit(1)), steps)


def range_auc_share(scored: DataFrame, share: float = 0.2, steps: int = 250) -> DataFrame:
    """The areas where the buffer of a run is a share of its own length: as many points before it, one less behind it."""
    buffer = F.floor((F.col("e") - F.col("s") + 1) * share)
    truth = runs(scored).withColumn("w", F.lit(0)).withColumn("_left", buffer).withColumn("_right", F.greatest(buffer - 1, F.lit(0)))
    return _volume(scored, truth, F.greatest(2 * F.col("_left"), F.lit(1)), steps).withColumnsRenamed({"vus_roc": "range_auc_roc", "vus_pr": "range_auc_pr"})


def _volume(scored: DataFrame, truth: DataFrame, reach: Column, steps: int) -> DataFrame:
    """The mean areas over w of runs (series_id, w, s, e) with buffers of _left and _right points, whose soft labels are sqrt(1 - d / reach) at the distance d."""
    sizes = scored.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("label").alias("p")).filter("p > 0")
    thresholds = rank_grid(scored, steps)
    # The first threshold k that takes in a score: the number of thresholds above it.
    marks = thresholds.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("k", "theta"))).alias("_t"))
    entered = lambda df, score="score": df.join(marks, "series_id").withColumn("k", F.size(F.filter("_t", lambda t: t["theta"] > F.col(score)))).drop("_t").filter(F.col("k") < steps)
    own = entered(scored.filter("label = 1")).groupBy("series_id", "k").agg(F.count("*").alias("_own"))
    buffers = truth.select("series_id", "w").distinct()
    # Soft labels beside runs.
    near = lambda side: F.when(F.col(side) > 0, F.sequence(F.lit(1), F.col(side).cast("int"))).otherwise(F.array().cast("array<int>"))
    soft_at = lambda d, idx: F.struct(idx.alias("idx"), F.sqrt(1 - d / reach).alias("_soft"))
    around = F.concat(F.transform(near("_left"), lambda d: soft_at(d, F.col("s") - d)), F.transform(near("_right"), lambda d: soft_at(d, F.col("e") + d)))
    beside = truth.select("series_id", "w", F.explode(around).alias("_p")).select("series_id", "w", "_p.idx", "_p._soft")
    soft = beside.groupBy("series_id", "w", "idx").agg(F.sum("_soft").alias("_soft")).join(scored.filter("label = 0").select("series_id", "idx", "score"), ["series_id", "idx"])
    more = entered(soft).groupBy("series_id", "w", "k").agg(F.sum(F.least("_soft", F.lit(1.0))).alias("_more"))
    # Merged runs and the first threshold that finds each.
    order = Window.partitionBy("series_id", "w").orderBy("s")
    new = F.coalesce((F.lag(F.col("e") + F.col("_right")).over(order) < F.col("s") - F.col("_left")).cast("int"), F.lit(1))
    joined = truth.withColumn("_new", new).withColumn("seg", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    wide = joined.groupBy("series_id", "w", "seg").agg(F.min(F.col("s") - F.col("_left")).alias("s"), F.max(F.col("e") + F.col("_right")).alias("e"))
    # The greatest score of a run: of the buckets that it covers whole, and of the points in those that it covers in part.
    parts = wide.withColumn("bucket", F.explode(F.sequence(bucket(F.greatest("s", F.lit(0))), bucket("e")))).withColumn("_whole", (F.col("s") <= F.col("bucket") * BUCKET) & (F.col("e") >= (F.col("bucket") + 1) * BUCKET - 1))
    points = scored.select("series_id", bucket().alias("bucket"), "idx", "score")
    tops = points.groupBy("series_id", "bucket").agg(F.max("score").alias("score"))
    best = parts.filter("_whole").join(tops, ["series_id", "bucket"]).select("series_id", "w", "seg", "score")
    best = best.unionByName(parts.filter("NOT _whole").join(points, ["series_id", "bucket"]).filter("idx BETWEEN s AND e").select("series_id", "w", "seg", "score"))
    best = best.groupBy("series_id", "w", "seg").agg(F.max("score").alias("score"))
    hits = entered(best).groupBy("series_id", "w", "k").agg(F.count("*").alias("_hits"))
    total = wide.groupBy("series_id", "w").agg(F.count("*").alias("_runs"))
    cells = thresholds.select("series_id", "k", "n_at").join(buffers, "series_id").join(sizes, "series_id").join(total, ["series_id", "w"])
    cells = cells.join(own, ["series_id", "k"], "left").join(more, ["series_id", "w", "k"], "left").join(hits, ["series_id", "w", "k"], "left")
    upto = Window.partitionBy("series_id", "w").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("series_id", "w", "k", "n_at", "n", "p", "_runs", F.sum(F.coalesce("_own", F.lit(0))).over(upto).alias("_own"), F.sum(F.coalesce("_more", F.lit(0.0))).over(upto).alias("_more"), F.sum(F.coalesce("_hits", F.lit(0))).over(upto).alias("_hits"))
    tp, positives = F.col("_own") + F.col("_more"), F.col("p") + F.col("_more") / 2
    cells = cells.select("series_id", "w", "k", (F.least(tp / positives, F.lit(1.0)) * F.col("_hits") / F.col("_runs")).alias("tpr"), ((F.col("n_at") - tp) / (F.col("n") - positives)).alias("fpr"), (tp / F.col("n_at")).alias("precision"))
    per_width = _areas(cells, ["series_id", "w"])
    return per_width.groupBy("series_id").agg(F.avg("auc_roc").alias("vus_roc"), F.avg("auc_pr").alias("vus_pr"))


def range_auc(scored: DataFrame, width: int, steps: int = 250) -> DataFrame:
    """The areas for one buffer."""
    return volume_under_surface(scored, width, steps, first_width=width).withColumnsRenamed({"vus_roc": "range_auc_roc", "vus_pr": "range_auc_pr"})


def affiliation_zones(truth: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each run [s, e + 1) with the zone nearer to it than to any other: z0 and z1 are midpoints, or 0 and n."""
    order = Window.partitionBy("series_id").orderBy("s")
    ends = truth.join(sizes, "series_id").withColumn("e1", F.col("e") + 1)
    return ends.select("series_id", "seg_id", F.col("s").cast("double").alias("j0"), F.col("e1").cast("double").alias("j1"), F.coalesce((F.lag("e1").over(order) + F.col("s")) / 2, F.lit(0.0)).alias("z0"), F.coalesce((F.col("e1") + F.lead("s").over(order)) / 2, F.col("n").cast("double")).alias("z1"))


def _piece(a: Column, b: Column, at: Column, sign: int) -> Column:
    """Integral of sign * (t - at) over [a, b]."""
    return sign * (b * b - a * a) / 2 - sign * at * (b - a)


def affiliation(scored: DataFrame, steps: int = STEPS) -> DataFrame:
    """affiliation_f: the best F of affiliation precision and recall over the grid."""
    sizes = scored.groupBy("series_id").agg(F.count("*").alias("n"))
    zones = affiliation_zones(runs(scored), sizes)
    found = runs_over(passed(scored, steps)).select("series_id", "k", F.col("s").cast("double").alias("q0"), (F.col("e") + 1).cast("double").alias("q1"))
    return _affiliation_f(found, zones, ["series_id", "k"]).groupBy("series_id").agg(F.max("f").alias("affiliation_f"))


def affiliation_of_predictions(predicted: DataFrame) -> DataFrame:
    """affiliation_precision, affiliation_recall and their f for pred."""
    sizes = predicted.groupBy("series_id").agg(F.count("*").alias("n"))
    found = runs(predicted, "pred").select("series_id", F.col("s").cast("double").alias("q0"), (F.col("e") + 1).cast("double").alias("q1"))
    return _affiliation_f(found, affiliation_zones(runs(predicted), sizes), ["series_id"])


def _affiliation_f(found: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: precision (mean over zones with predictions), recall (mean over all zones) and f."""
    cut = overlapping(found, zones, ("q0", "q1"), ("z0", "z1")).filter("q0 < z1 AND z0 < q1").withColumn("q0", F.greatest("q0", "z0")).withColumn("q1", F.least("q1", "z1"))
    j0, j1, z0, z1, q0, q1 = map(F.col, ("j0", "j1", "z0", "z1", "q0", "q1"))
    m, size = F.least(j0 - z0, z1 - j1), z1 - z0

    def outside(d0: Column, d1: Column) -> Column:
        """Of a part at distances d0 to d1 from the run: the integral of the chance that a random point is further away."""
        lost = (F.least(d1, m) ** 2 - F.least(d0, m) ** 2) / 2 + m * (F.greatest(d1, m) - F.greatest(d0, m)) + (d1 * d1 - d0 * d0) / 2 + (j1 - j0) * (d1 - d0)
        return (d1 - d0) - lost / size

    left_end, right_start = F.least(q1, j0), F.greatest(q0, j1)
    inside = F.greatest(F.least(q1, j1) - F.greatest(q0, j0), F.lit(0.0))
    left = F.when(q0 < left_end, outside(j0 - left_end, j0 - q0)).otherwise(F.lit(0.0))
    right = F.when(right_start < q1, outside(right_start - j1, q1 - j1)).otherwise(F.lit(0.0))
    precision = cut.groupBy(*keys, "seg_id").agg((F.sum(inside + left + right) / F.sum(q1 - q0)).alias("_p"))

    # Recall: the run is cut where its nearest prediction in the zone changes.
    order = Window.partitionBy(*keys, "seg_id").orderBy("q0")
    cells = cut.withColumn("c0", F.coalesce((F.lag("q1").over(order) + q0) / 2, z0)).withColumn("c1", F.coalesce((q1 + F.lead("q0").over(order)) / 2, z1))
    a, b = F.greatest("c0", "j0"), F.least("c1", "j1")
    cells = cells.filter(a < b).withColumn("_a", a).withColumn("_b", b)
    a, b = F.col("_a"), F.col("_b")

    def reach(lo: Column, hi: Column, c: Column, sign: int) -> Column:
        """Of a part [lo, hi] of the run whose nearest prediction ends at c: the part less the mean, over the zone, of
        |c - t| and what of |c - t| fits between t and the zone's far end; sign 1 where t is over c."""
        away = _piece(lo, hi, c, sign)
        x = F.least(F.greatest((c + (z1 if sign > 0 else z0)) / 2, lo), hi)
        fits = _piece(lo, x, c, 1) + _piece(x, hi, z1, -1) if sign > 0 else _piece(lo, x, z0, 1) + _piece(x, hi, c, -1)
        return F.when((c > z0) & (c < z1), (hi - lo) - (fits + away) / size).otherwise(F.lit(0.0))

    covered = F.greatest(F.least(b, q1) - F.greatest(a, q0), F.lit(0.0))
    before_end, after_start = F.least(b, q0), F.greatest(a, q1)
    before = F.when(a < before_end, reach(a, before_end, q0, -1)).otherwise(F.lit(0.0))
    after = F.when(after_start < b, reach(after_start, b, q1, 1)).otherwise(F.lit(0.0))
    recall = cells.groupBy(*keys, "seg_id").agg((F.sum(covered + before + after) / F.first(j1 - j0)).alias("_r"))
    total = zones.groupBy("series_id").agg(F.count("*").alias("_zones"))
    both = precision.join(recall, [*keys, "seg_id"], "left").groupBy(*keys).agg(F.avg("_p").alias("affiliation_precision"), F.sum(F.coalesce("_r", F.lit(0.0))).alias("_r"))
    out = both.join(total, "series_id").withColumn("affiliation_recall", F.col("_r") / F.col("_zones"))
    p, r = F.col("affiliation_precision"), F.col("affiliation_recall")
    return out.select(*keys, "affiliation_precision", "affiliation_recall", (2 * p * r / (p + r + 1e-15)).alias("f"))


def adjusted_of_predictions(predicted: DataFrame) -> DataFrame:
    """pa_f1 of pred: a run with one predicted point counts as found whole (but for the first point of a series)."""
    own = in_runs(predicted).groupBy("series_id", "seg_id", "s", "e").agg(F.max("pred").alias("_hit"), F.max(F.when(F.col("idx") == 0, F.col("pred"))).alias("_first"))
    hit = F.sum(F.when(F.col("_hit") == 1, F.col("e") - F.greatest("s", F.lit(1)) + 1).otherwise(0) + F.coalesce("_first", F.lit(0)))
    counts = own.groupBy("series_id").agg(hit.alias("tp"))
    others = predicted.groupBy("series_id").agg(F.sum(F.col("pred") * (1 - F.col("label"))).alias("fp"), F.sum("label").alias("p")).filter("p > 0")
    rows = others.join(counts, "series_id", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return rows.select("series_id", _safe(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")).alias("pa_f1"))


def event_of_predictions(predicted: DataFrame) -> DataFrame:
    """event_f1 of pred: the share of runs found and the point-wise precision; a run that reaches the end counts without its last point."""
    last = predicted.groupBy("series_id").agg(F.max("idx").alias("_last"), F.sum(F.col("label") * F.col("pred")).alias("tp"), F.sum("pred").alias("pp"))
    hits = in_runs(predicted).join(last, "series_id").filter("idx < _last AND pred = 1").groupBy("series_id").agg(F.countDistinct("seg_id").alias("hits"))
    rows = runs(predicted).groupBy("series_id").agg(F.count("*").alias("events")).join(last, "series_id").join(hits, "series_id", "left")
    r, p = F.coalesce("hits", F.lit(0)) / F.col("events"), _safe(F.col("tp"), F.col("pp"))
    return rows.select("series_id", (2 * r * p / (r + p + 1e-15)).alias("event_f1"))


def volume_of_predictions(predicted: DataFrame, width: int) -> DataFrame:
    """vus_recall, vus_precision and vus_f of pred: means over buffers of 0 to ``width`` points; each buffer is taken by itself."""
    totals = predicted.groupBy("series_id").agg(F.sum("label").alias("p"), F.sum("pred").alias("pp"), F.sum(F.col("label") * F.col("pred")).alias("own")).filter("p > 0")
    sides = runs(predicted).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(width)))).filter("w >= 2").withColumn("d", F.explode(F.sequence(F.lit(1), F.floor(F.col("w") / 2).cast("int"))))
    beside_runs = sides.select("series_id", "w", F.explode(F.array(F.col("s") - F.col("d"), F.col("e") + F.col("d"))).alias("idx"), F.sqrt(1 - F.col("d") / F.col("w")).alias("_soft"))
    hit = predicted.filter("label = 0 AND pred = 1").select("series_id", "idx")
    more = beside_runs.groupBy("series_id", "w", "idx").agg(F.sum("_soft").alias("_soft")).join(hit, ["series_id", "idx"]).groupBy("series_id", "w").agg(F.sum(F.least("_soft", F.lit(1.0))).alias("_more"))
    cells = totals.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(width)))).join(more, ["series_id", "w"], "left")
    soft = F.coalesce("_more", F.lit(0.0))
    tp = F.col("own") + soft
    cells = cells.select("series_id", F.least(tp / (F.col("p") + soft / 2), F.lit(1.0)).alias("_r"), _safe(tp, F.col("pp")).alias("_p"))
    r, p = F.col("_r"), F.col("_p")
    return cells.groupBy("series_id").agg(F.avg("_r").alias("vus_recall"), F.avg("_p").alias("vus_precision"), F.avg(_safe(2 * r * p, r + p)).alias("vus_f"))


def evaluate_predictions(predicted: DataFrame, width: int) -> DataFrame:
    """All measures of pred, one row for each series with labelled points."""
    predicted = materialise(predicted.select("series_id", "idx", "label", "pred"))
    out = predicted.groupBy("series_id").agg(F.sum("label").alias("_p")).filter("_p > 0").select("series_id")
    parts = (f1_of_predictions(predicted).select("series_id", "f1"), adjusted_of_predictions(predicted), event_of_predictions(predicted), range_of_predictions(predicted).select("series_id", "r_f1"), affiliation_of_predictions(predicted).select("series_id", F.col("f").alias("affiliation_f")), volume_of_predictions(predicted, width))
    for part in parts:
        out = out.join(part, "series_id", "left")
    return out


def evaluate_one_threshold(scored: DataFrame) -> DataFrame:
    """auc_roc, and of scores over the mean plus three deviations: precision, recall, f1, pa_f1, the range figures and precision among the top n."""
    predicted = materialise(three_sigma(scored))
    out = roc_auc(scored)
    for part in (f1_of_predictions(predicted), adjusted_of_predictions(predicted), range_of_predictions(predicted), precision_at_n(scored)):
        out = out.join(part, "series_id", "left")
    return out


def evaluate(scored: DataFrame, width: int) -> DataFrame:
    """All nine measures, one row for each series; null where one is undefined.  The scores are written once and read by each measure."""
    scored = materialise(scored.select("series_id", "idx", "score", "label"))
    out = scored.select("series_id").distinct()
    for part in (average_precision(scored), roc_auc(scored), volume_under_surface(scored, width), best_f1(scored), adjusted_f1(scored), event_f1(scored), range_f1(scored), affiliation(scored)):
        out = out.join(materialise(part), "series_id", "left")
    return out


def merged_runs(scored: DataFrame, width: int) -> DataFrame:
    return merged(runs(scored), scored.groupBy("series_id").agg(F.count("*").alias("n")), width)
