"""Quality of retrieval and of term extraction."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import top_k

KS = (1, 3, 5, 10)


def relevance(matrix: DataFrame, threshold: float) -> DataFrame:
    """query_id, rank, score (the best over the expected sources) and relevant, from query_id, rank, source, score."""
    return matrix.groupBy("query_id", "rank").agg(F.max("score").alias("score")).withColumn("relevant", F.col("score") >= threshold)


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, ks: tuple[int, ...] = KS, graded: bool = True, digits: int = 6) -> DataFrame:
    """query_id, k, recall, precision, hit_rate, ndcg, mrr. ranked: query_id, rank (from 1), score, relevant;
    expected: query_id, n_sources. Recall is of the sources, at most 1. Graded gain is the score of relevant ranks and its
    ideal their best order; binary gain is 1 and its ideal min(k, relevant, sources) hits in front."""
    gain = F.when(F.col("relevant"), F.col("score") if graded else F.lit(1.0)).otherwise(0.0)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "rank"))
    r = ranked.withColumn("gain", gain).withColumn("ideal_rank", best)
    firsts = r.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.count_if("relevant").alias("n_relevant"))
    discounted = lambda at: F.col("gain") / F.log2(F.col(at) + 1.0)
    aggs = []
    for k in ks:
        inside, ideal = F.col("rank") <= k, F.col("ideal_rank") <= k
        aggs += [F.count_if(inside & F.col("relevant")).alias(f"h{k}"), F.sum(F.when(inside, discounted("rank")).otherwise(0.0)).alias(f"d{k}"), F.sum(F.when(ideal, discounted("ideal_rank")).otherwise(0.0)).alias(f"i{k}")]
    wide = expected.join(r.groupBy("query_id").agg(*aggs), "query_id", "left").join(firsts, "query_id", "left")
    ideal_hits = lambda k: F.aggregate(F.sequence(F.lit(0), F.least(F.lit(k), "n_relevant", "n_sources") - 1), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 2.0))
    rows = []
    for k in ks:
        hits = F.coalesce(f"h{k}", F.lit(0))
        ideal = F.col(f"i{k}") if graded else F.when(F.least("n_relevant", "n_sources") > 0, ideal_hits(k))
        rows.append(F.struct(F.lit(k).alias("k"), F.least(F.coalesce(F.try_divide(hits, "n_sources"), F.lit(0.0)), F.lit(1.0)).alias("recall"), (hits / k).alias("precision"), F.when(hits > 0, 1.0).otherwise(0.0).alias("hit_rate"), F.least(F.coalesce(F.try_divide(F.col(f"d{k}"), ideal), F.lit(0.0)), F.lit(1.0)).alias("ndcg")))
    out = wide.select("query_id", F.explode(F.array(*rows)).alias("m"), F.coalesce(F.try_divide(F.lit(1.0), "first"), F.lit(0.0)).alias("mrr"))
    rounded = lambda c: F.round(c, digits).alias(c)
    return out.select("query_id", F.col("m.k").alias("k"), *(F.round(f"m.{c}", digits).alias(c) for c in ("recall", "precision", "hit_rate", "ndcg")), rounded("mrr"))


def long_form(metrics: DataFrame) -> DataFrame:
    """query_id, metric, value: one row for each metric and k, and one for mrr."""
    parts = metrics.unpivot(["query_id", "k"], ["recall", "precision", "hit_rate", "ndcg"], "name", "value").select("query_id", F.concat_ws("@", "name", "k").alias("metric"), "value")
    return parts.unionByName(metrics.groupBy("query_id").agg(F.first("mrr").alias("value")).select("query_id", F.lit("mrr").alias("metric"), "value"))


def averages(long: DataFrame, digits: int = 6) -> DataFrame:
    """Metric and mean over the questions that have it."""
    return long.groupBy("metric").agg(F.round(F.avg("value"), digits).alias("mean"))


def improvement(base: DataFrame, target: DataFrame, digits: int = 6) -> DataFrame:
    """Per cent by which the mean of each metric changed; none where the base is 0."""
    a, b = averages(base, digits).withColumnRenamed("mean", "base"), averages(target, digits).withColumnRenamed("mean", "target")
    return a.join(b, "metric").filter("base <> 0").withColumn("percent", F.round((F.col("target") - F.col("base")) / F.col("base") * 100, 4))


def expanding_mean(long: DataFrame, order: str = "query_id") -> DataFrame:
    """The mean of each metric over the questions so far; nulls are passed over. Sums are exact to six places."""
    so_far = Window.partitionBy("metric").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("mean", F.sum(F.col("value").cast("decimal(18,6)")).over(so_far).cast("double") / F.count("value").over(so_far))


def by_k(long: DataFrame, digits: int = 6) -> DataFrame:
    """Mean of each metric at each k, k as a number."""
    at = F.split("metric", "@")
    return long.filter("metric like '%@%'").groupBy(F.get(at, F.lit(0)).alias("metric"), F.get(at, F.lit(1)).cast("int").alias("k")).agg(F.round(F.avg("value"), digits).alias("mean"))


def rating(mean):
    """A21."""
    return F.when(mean >= 0.9, "excellent").when(mean >= 0.8, "good").when(mean >= 0.7, "fair").when(mean >= 0.6, "weak").otherwise("poor")


def histogram(long: DataFrame, buckets: int = 10) -> DataFrame:
    """Metric, bucket (from 1, equal widths over 0..1, 1 in the last), n."""
    return long.groupBy("metric", F.least(F.floor(F.col("value") * buckets) + 1, F.lit(buckets)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def heatmap(long: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each question, a column for each metric, 0 where it is missing."""
    return long.groupBy("query_id").pivot("metric", metrics).agg(F.first("value")).na.fill(0.0)


def flags(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Term, in_truth, in_found over both sets."""
    t, f = truth.select("term").distinct().withColumn("in_truth", F.lit(True)), found.select("term").distinct().withColumn("in_found", F.lit(True))
    return t.join(f, "term", "full").select("term", F.coalesce("in_truth", F.lit(False)).alias("in_truth"), F.coalesce("in_found", F.lit(False)).alias("in_found"))


def term_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Counts, precision, recall and f1; 0 where there is nothing to divide by."""
    n = flags(truth, found).agg(F.count_if(F.col("in_truth") & F.col("in_found")).alias("hits"), F.count_if("in_truth").alias("n_truth"), F.count_if("in_found").alias("n_found"))
    p, r = (F.coalesce(F.try_divide("hits", c), F.lit(0.0)) for c in ("n_found", "n_truth"))
    return n.select("hits", "n_truth", "n_found", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def recall_by(flagged: DataFrame, by: str, sample: int = 10) -> DataFrame:
    """N, hits, recall and the first terms of each class of the true terms."""
    true = flagged.filter("in_truth")
    g = true.groupBy(by).agg(F.count("*").alias("n"), F.count_if("in_found").alias("hits"))
    firsts = top_k(true.select(by, "term").distinct(), sample, [by], "term").groupBy(by).agg(F.array_sort(F.collect_list("term")).alias("sample"))
    both = g.join(firsts.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left")
    return both.select(by, "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("recall"), "sample")


def ordered_misses(flagged: DataFrame, counts: DataFrame) -> DataFrame:
    """Term and frequency of the true terms that were not found, most frequent first."""
    missed = flagged.filter("in_truth and not in_found").join(counts.select("term", "frequency"), "term", "left")
    return missed.select("term", F.coalesce("frequency", F.lit(0)).alias("frequency")).orderBy(F.desc("frequency"), "term")


def ordered_false_positives(flagged: DataFrame, scores: DataFrame) -> DataFrame:
    """Term and score of the found terms that are not true, best first; 0 where there is no score."""
    wrong = flagged.filter("in_found and not in_truth").join(scores.select("term", "score"), "term", "left")
    return wrong.select("term", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "term")


def frequency_bin(frequency):
    """Null for 0."""
    return F.when(frequency == 1, "1").when(frequency == 2, "2").when(frequency.between(3, 5), "3-5").when(frequency.between(6, 10), "6-10").when(frequency >= 11, "11+")


def score_statistics(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Mean, median, population deviation and bounds; missing scores are 0."""
    c = F.coalesce(column, F.lit(0.0))
    return df.groupBy(*(by or [])).agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.median(c), 6).alias("median"), F.round(F.stddev_pop(c), 6).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))


def upper_median(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean and the upper one of the middle values."""
    order = Window.partitionBy(*by).orderBy(column)
    whole = Window.partitionBy(*by)
    r = df.filter(F.col(column).isNotNull()).withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(whole))
    return r.groupBy(*by).agg(F.round(F.avg(column), 6).alias("mean"), F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col(column))).alias("median"))


def term_details(truth: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """Each true term, whether it was found, and its frequency, 0 where it has none."""
    return flags(truth, found).filter("in_truth").join(counts.select("term", "frequency"), "term", "left").select("term", "in_found", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def dropout_report(stages: DataFrame) -> DataFrame:
    """R2: each term's state after its last stage: the stage's name and whether the term is there; null counts as absent."""
    last = F.max_by(F.struct("stage", F.coalesce("present", F.lit(False)).alias("extracted")), "stage_index")
    return stages.groupBy("term").agg(last.alias("r")).select("term", F.col("r.stage").alias("last_stage"), "r.extracted")


def rerank_impact(scores: DataFrame) -> DataFrame:
    """Per frequency bin (all five, 1.0 where empty) how re-ranking changed scores: frequency, base, revised."""
    bins = scores.sparkSession.createDataFrame([(b,) for b in ("1", "2", "3-5", "6-10", "11+")], "bin string")
    r = scores.filter("base > 0").select(frequency_bin(F.col("frequency")).alias("bin"), (F.col("revised") / F.col("base")).alias("ratio"))
    return bins.join(r.groupBy("bin").agg(F.avg("ratio").alias("mean"), F.median("ratio").alias("median"), F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", F.lit(1.0)), 6).alias("mean_ratio"), F.round(F.coalesce("median", F.lit(1.0)), 6).alias("median_ratio"))


def truth_frequencies(truth: DataFrame, counts: DataFrame) -> DataFrame:
    """Bin and n of the true terms by their frequency; null for those that have none."""
    of = truth.select("term").distinct().join(counts.select("term", "frequency"), "term", "left")
    return of.groupBy(frequency_bin(F.col("frequency")).alias("bin")).agg(F.count("*").alias("n"))


def centres(long: DataFrame, digits: int = 6) -> DataFrame:
    """Mean and median of each metric."""
    return long.groupBy("metric").agg(F.round(F.avg("value"), digits).alias("mean"), F.round(F.median("value"), digits).alias("median"))


def compared(runs: DataFrame, digits: int = 6) -> DataFrame:
    """File, metric, mean of each metric that any file (run) has, 0 where a file lacks it. runs: file, metric, value."""
    means = runs.groupBy("file", "metric").agg(F.round(F.avg("value"), digits).alias("mean"))
    every = runs.select("file").distinct().crossJoin(F.broadcast(runs.select("metric").distinct()))  # files by metrics: a few names each
    return every.join(means, ["file", "metric"], "left").select("file", "metric", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def short_label(text, most: int = 30):
    """The first characters of a long question, with dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def track(truth: DataFrame, stages: DataFrame, terms: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Term, stage_index, stage, status (present, absent), what else terms has of it at that stage, and reason, for each true
    term and stage. stages: stage_index, stage (a few rows); terms: stage_index, term and more; removed: stage_index, term, reason,
    looked at where the term is absent."""
    every = truth.select("term").distinct().crossJoin(F.broadcast(stages.select("stage_index", "stage")))
    more = [c for c in terms.columns if c not in ("stage_index", "term")]
    there = terms.dropDuplicates(["stage_index", "term"]).withColumn("_there", F.lit(True))
    out = every.join(there, ["stage_index", "term"], "left").withColumn("status", F.when(F.col("_there"), "present").otherwise("absent"))
    if removed is None:
        out = out.withColumn("reason", F.lit(None).cast("string"))
    else:
        out = out.join(removed.groupBy("stage_index", "term").agg(F.min("reason").alias("_why")), ["stage_index", "term"], "left").withColumn("reason", F.when(F.col("status") == "absent", F.col("_why")))
    return out.select("term", "stage_index", "stage", "status", *more, "reason")


def stage_log(terms: DataFrame) -> DataFrame:
    """For each stage, how many terms were there before and after, were removed and added. terms: stage_index, stage, side
    (before, after), term."""
    each = terms.groupBy("stage_index", "stage", "term").agg(F.bool_or(F.col("side") == "before").alias("b"), F.bool_or(F.col("side") == "after").alias("a"))
    return each.groupBy("stage_index", "stage").agg(F.count_if("b").alias("terms_before"), F.count_if("a").alias("terms_after"), F.count_if(F.col("b") & ~F.col("a")).alias("removed"), F.count_if(F.col("a") & ~F.col("b")).alias("added"))


def stage_summary(terms: DataFrame) -> DataFrame:
    """One row: terms before the first stage and after the last, those of the first that the last lacks, and the number of stages."""
    ends = terms.agg(F.min("stage_index").alias("low"), F.max("stage_index").alias("high"), F.countDistinct("stage_index").alias("stages"))
    first = (F.col("stage_index") == F.col("low")) & (F.col("side") == "before")
    last = (F.col("stage_index") == F.col("high")) & (F.col("side") == "after")
    each = terms.crossJoin(F.broadcast(ends)).groupBy("term").agg(F.bool_or(first).alias("f"), F.bool_or(last).alias("l"))
    counts = each.agg(F.count_if("f").alias("initial"), F.count_if("l").alias("final"), F.count_if(F.col("f") & ~F.col("l")).alias("removed"))
    return counts.crossJoin(ends.select("stages"))  # one row each


def removals(removed: DataFrame, reasons: DataFrame, most: int = 20) -> DataFrame:
    """stage_index, reason, n and the first terms of those that a stage removed, by reason; a fixed word where there is none."""
    why = removed.select("stage_index", "term").distinct().join(reasons.groupBy("stage_index", "term").agg(F.min("reason").alias("reason")), ["stage_index", "term"], "left").withColumn("reason", F.coalesce("reason", F.lit("理由不明")))
    firsts = top_k(why, most, ["stage_index", "reason"], "term").groupBy("stage_index", "reason").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return why.groupBy("stage_index", "reason").agg(F.count("*").alias("n")).join(firsts, ["stage_index", "reason"])


def profile(phases: DataFrame, most: int = 3) -> DataFrame:
    """Phase, duration, percent of all durations, and rank, null but for the `most` longest. phases: phase, duration, a row
    for each time that a phase ran."""
    each = phases.groupBy("phase").agg(F.sum("duration").alias("duration"))
    total = each.agg(F.sum("duration").alias("total"))
    # A pipeline has a few phases, so one window over all of them is small.
    rank = F.row_number().over(Window.orderBy(F.desc("duration"), "phase"))
    out = each.crossJoin(F.broadcast(total)).withColumn("rank", rank)
    return out.select("phase", "duration", F.round(F.coalesce(F.try_divide(F.col("duration") * 100, "total"), F.lit(0.0)), 4).alias("percent"), F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))


def stage_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Term and whether a stage removed or added it."""
    return before.select("term").distinct().join(after.select("term"), "term", "left_anti").withColumn("change", F.lit("removed")).unionByName(after.select("term").distinct().join(before.select("term"), "term", "left_anti").withColumn("change", F.lit("added")))
