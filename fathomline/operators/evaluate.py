"""Measures of retrieval, classification and query generation, as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def ranks_of_gold(scored: DataFrame) -> DataFrame:
    """query_id, rank and similarity of each query's gold item in ``scored`` (query_id, item_id, gold_id, similarity);
    ties go to the smaller item."""
    gold = scored.filter("item_id = gold_id").select("query_id", F.col("item_id").alias("g"), F.col("similarity").alias("s"))
    better = (F.col("similarity") > F.col("s")) | ((F.col("similarity") == F.col("s")) & (F.col("item_id") < F.col("g")))
    return scored.join(gold, "query_id").groupBy("query_id").agg((F.count_if(better) + 1).alias("rank"), F.first("s").alias("similarity"))


def hits(ranks: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """hit@k and the mean reciprocal rank, which counts ranks beyond the largest k as 0."""
    most = max(ks)
    mrr = F.avg(F.when(F.col("rank") <= most, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr")
    return ranks.agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"hit_{k}") for k in ks], mrr)


def chunk_measures(rows: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank, precision@k and discounted gain of each query's returned ids against the expected ones.

    ``rows``: query_id, expected and returned (arrays). Precision divides by the smaller of k and what is expected; the
    gain discounts by rank, not by its logarithm.
    """
    top = F.slice("returned", 1, k)
    place = F.filter(F.transform("returned", lambda x, i: F.when(F.array_contains("expected", x), i + 1)), lambda x: x.isNotNull())
    near = F.filter(F.transform(top, lambda x, i: F.when(F.array_contains("expected", x), i + 1)), lambda x: x.isNotNull())
    least = F.least(F.lit(k), F.size("expected"))
    add = lambda items: F.aggregate(items, F.lit(0.0), lambda a, i: a + 1.0 / i)
    ideal = F.when(least > 0, add(F.sequence(F.lit(1), least)))
    return rows.select(
        "query_id",
        F.coalesce(1.0 / F.get(place, F.lit(0)), F.lit(0.0)).alias("mrr"),
        F.when(least > 0, F.size(F.array_intersect(top, F.col("expected"))) / least).otherwise(0.0).alias("precision"),
        F.coalesce(add(near) / ideal, F.lit(0.0)).alias("ndcg"),
    )


def jaccard(a: str, b: str):
    """Of two arrays: 1 if both are empty, 0 if one is."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def label_report(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """precision, recall, f1 and support of each label over rows with arrays of labels."""
    t = rows.select(F.explode(F.array_distinct(truth)).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("both"))
    p = rows.select(F.explode(F.array_distinct(guess)).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("both"))
    b = rows.select(F.explode(F.array_intersect(truth, guess)).alias("label"), F.lit(0).alias("t"), F.lit(0).alias("p"), F.lit(1).alias("both"))
    n = t.unionByName(p).unionByName(b).groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("guessed"), F.sum("both").alias("hit"))
    share = lambda a, c: F.coalesce(F.col(a) / F.nullif(F.col(c), F.lit(0)), F.lit(0.0))
    n = n.withColumn("precision", share("hit", "guessed")).withColumn("recall", share("hit", "support"))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return n.select("label", "precision", "recall", f1.alias("f1"), "support")


def label_summary(rows: DataFrame, labels: int, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Exact matches, rows whose labels are all found, and the Hamming loss over ``labels`` labels."""
    wrong = F.size(F.array_except(truth, guess)) + F.size(F.array_except(guess, truth))
    return rows.agg(
        F.avg((wrong == 0).cast("double")).alias("exact_match"),
        F.avg((F.size(F.array_except(truth, guess)) == 0).cast("double")).alias("superset"),
        (F.sum(wrong) / (F.count("*") * labels)).alias("hamming"),
    )


def overlap_matrix(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """How often each true label meets each guessed one."""
    return rows.select(F.explode(truth).alias("truth_label"), guess).select("truth_label", F.explode(guess).alias("guess_label")).groupBy("truth_label", "guess_label").agg(F.count("*").alias("n"))


def binary_report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts of right and wrong, precision, recall, F1 and the rate of false alarms."""
    c = lambda a, b: F.count_if((F.col(truth) == a) & (F.col(guess) == b))
    n = rows.agg(c(True, True).alias("tp"), c(False, False).alias("tn"), c(False, True).alias("fp"), c(True, False).alias("fn"))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return n.select("tp", "tn", "fp", "fn", over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), over(fp, fp + tn).alias("fp_rate"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Accuracy, first-attempt accuracy, retry rate, mean count ratio and share of schema-true queries of benchmark runs."""
    ok = F.col("success")
    return runs.agg(
        F.count("*").alias("n"),
        F.avg(ok.cast("double")).alias("accuracy"),
        F.avg((ok & (F.col("retry_attempts") == 0)).cast("double")).alias("first_attempt"),
        F.avg((F.col("retry_attempts") > 0).cast("double")).alias("retry_rate"),
        F.avg("count_ratio").alias("count_ratio"),
        F.avg(F.col("schema_adherent").cast("double")).alias("schema_rate"),
        F.percentile("execution_time_ms", 0.5).alias("p50_ms"),
        F.percentile("execution_time_ms", 0.95).alias("p95_ms"),
    )


def same_values(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows, whatever the order of rows and the names of columns."""
    row = lambda df: df.select(F.array_sort(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])).alias("r"))
    x, y = row(a).groupBy("r").count(), row(b).groupBy("r").count()
    return len(a.columns) == len(b.columns) and x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def contained(small: DataFrame, large: DataFrame) -> bool:
    """Whether each value of the small result, nulls aside, occurs in the large one."""
    def values(df):
        return reduce(lambda p, q: p.union(q), [df.select(F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns]).filter("v IS NOT NULL").distinct()

    return values(small).join(values(large), "v", "left_anti").isEmpty()


# Texts that stand for no value, and how much of an expected row's values must be there.
NULL_LIKE = ("N/A", "None", "null", "n/a", "")
FEW_ROWS, OVERLAP = 10, 0.6


def within(small, large):
    """Whether each element of an array column is in another."""
    return F.size(F.array_except(small, large)) == 0


def comparison(generated: str, expected: str):
    """``exact``, ``partial`` or ``mismatch`` of two results, each an array of rows, a row an array of its values as text.

    Only values count. Equal sets of values are exact; one within the other is partial, and so it is if that holds for
    the values that are no numbers, those that stand for no value left aside on the generated side.
    """
    g, e = (F.array_distinct(F.flatten(c)) for c in (generated, expected))
    words = lambda c: F.filter(c, lambda v: ~v.rlike(r"^[0-9]*\.?[0-9]*$") | (v == ""))
    gw, ew = words(g), words(e)
    real = F.filter(gw, lambda v: ~v.isin(*NULL_LIKE))
    some = (F.size(gw) > 0) & (F.size(ew) > 0)
    part = within(e, g) | within(g, e) | (some & (within(gw, ew) | within(ew, gw) | ((F.size(real) > 0) & within(real, ew))))
    empty = (F.size(generated) == 0) & (F.size(expected) > 0)
    return F.when(empty, "mismatch").when(within(g, e) & within(e, g), "exact").when(part, "partial").otherwise("mismatch")


def few_contained(generated: str, expected: str, most: int = FEW_ROWS, overlap: float = OVERLAP):
    """Whether a result of few rows has only rows that an expected row holds, or is held by, or shares most values with."""
    values = lambda row: F.array_distinct(F.filter(F.transform(row, lambda v: F.trim(v)), lambda v: v != ""))

    def fits(row):
        r = values(row)
        like = lambda e: within(r, values(e)) | within(values(e), r) | ((F.size(values(e)) > 0) & (F.size(F.array_intersect(r, values(e))) >= overlap * F.size(values(e))))
        return F.exists(expected, like)

    return (F.size(generated) > 0) & (F.size(generated) <= most) & F.forall(generated, fits)


def verdict(generated: str, expected: str):
    """YES for results of equal rows whatever their order, NO for an empty one where rows are expected, else null: these
    a judge must see. Results with nothing expected are null too."""
    rows = lambda c: F.array_sort(F.transform(c, lambda r: F.array_sort(r)))
    some = (F.size(generated) > 0) & (F.size(expected) > 0)
    return F.when(some & (rows(generated) == rows(expected)), "YES").when((F.size(generated) == 0) & (F.size(expected) > 0), "NO")


def rate_by(rows: DataFrame, category: str, flag: str, where: str = "true") -> DataFrame:
    """The share of rows with ``flag`` in each category, among those that fit ``where``."""
    return rows.filter(where).groupBy(category).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"))
