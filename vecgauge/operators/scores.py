"""Scores and roll-ups: coverage, truncation, confound and probe statistics, verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def code_coverage(events: DataFrame, known: DataFrame) -> DataFrame:
    """Per vocabulary and for ALL: events and distinct codes, and how many of each are known.

    ``events`` has ``code``; ``known`` has ``code``, each once. Counts are formed
    per code before the join, so a frequent code is one row in it.
    """
    codes = events.groupBy("code").agg(F.count("*").alias("n")).join(known.withColumn("covered", F.lit(1)), "code", "left")
    codes = codes.withColumn("vocabulary", F.split_part("code", F.lit("/"), F.lit(1)))
    out = codes.where("vocabulary is not null").groupingSets([["vocabulary"], []], "vocabulary").agg(
        F.grouping("vocabulary").alias("g"), F.sum("n").alias("n_events"), F.coalesce(F.sum(F.when(F.col("covered") == 1, F.col("n"))), F.lit(0)).alias("n_events_covered"),
        F.count("*").alias("n_codes"), F.count("covered").alias("n_codes_covered"),
    )
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("vocabulary")).alias("vocabulary"), "n_events", "n_events_covered", "n_codes", "n_codes_covered")


def known_base_codes(tokens: DataFrame) -> DataFrame:
    """``code``: the codes that a vocabulary of ``token`` knows, whatever their value buckets; special tokens, which open with a bracket, are none."""
    return tokens.where("token is not null and not startswith(token, '[')").select(F.split("token", r" \|\| ", 2)[0].alias("code")).distinct()


def truncation_report(lengths: DataFrame) -> DataFrame:
    """Per row: tokens seen, whether cut, and the share covered (1 for an empty history)."""
    n, limit = F.col("n_tokens"), F.col("context_length")
    return lengths.where("n_tokens >= 0").select(
        "person_id", "cutoff", "model_name", "context_length", "run_day", n.alias("n_untruncated"), F.least(n, limit).alias("n_seen"), (n > limit).alias("was_cut"),
        F.when(n == 0, 1.0).otherwise(F.least(n, limit) / n).alias("covered"),
    )


def truncation_stats(lengths: DataFrame) -> DataFrame:
    """Per model and context length: cap-hit rate, median, 95th percentile, maximum."""
    good = lengths.where("n_tokens >= 0")
    return good.groupBy("model_name", "context_length").agg(
        F.avg((F.col("n_tokens") >= F.col("context_length")).cast("double")).alias("cap_hit_rate"), F.percentile("n_tokens", F.lit(0.5)).alias("median_tokens"),
        F.percentile("n_tokens", F.lit(0.95)).alias("p95_tokens"), F.max("n_tokens").alias("max_tokens"),
    )


def context_table(summary: DataFrame, contexts: list[int]) -> DataFrame:
    """Per context length: share of persons whose record fits, and how much of the median record it holds."""
    median = summary.agg(F.percentile("n_events", F.lit(0.5)).alias("m"))
    rows = summary.select("n_events", F.explode(F.array(*[F.lit(c).cast("long") for c in contexts])).alias("context_length")).groupBy("context_length").agg(F.avg((F.col("n_events") <= F.col("context_length")).cast("double")).alias("fits"))
    return rows.join(F.broadcast(median)).select("context_length", "fits", F.try_divide(F.least(F.col("context_length").cast("double"), F.col("m")), F.col("m")).alias("median_share"))


def unanimous(column: str):
    """The one value of a group, ``mixed`` if there are several, ``-`` if none."""
    seen = F.collect_set(column)
    return F.when(F.size(seen) == 0, "-").when(F.size(seen) == 1, F.element_at(seen, 1)).otherwise("mixed")


def spread(column: str):
    """The group's numbers in order, joined by commas, ``-`` if none."""
    values = F.sort_array(F.collect_list(column))
    return F.when(F.size(values) == 0, "-").otherwise(F.array_join(F.transform(values, lambda x: x.cast("string")), ", "))


def choose_k(curve: DataFrame, keys: list[str], threshold: float = 0.8) -> DataFrame:
    """The largest k whose strength reaches the threshold, else the smallest k of the greatest strength."""
    best = F.max(F.when(F.col("strength").isNotNull(), F.struct("strength", (-F.col("k")).alias("k"))))
    return curve.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("strength") >= threshold, F.col("k"))), -best["k"]).alias("chosen_k"))


def group_shares(rows: DataFrame, group: str, member: str) -> DataFrame:
    """``group, member, n, share`` within each group; rows of a null group are left out."""
    counts = rows.where(F.col(group).isNotNull()).groupBy(group, member).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def numeric_r2(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Squared correlation over complete pairs; null below two pairs, 0 where either is constant."""
    good = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    out = good.groupBy(*keys).agg(F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.count("*").alias("n"))
    return out.select(*keys, F.when(F.col("n") < 2, None).otherwise(F.coalesce(F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vy")), F.lit(0.0))).alias("r2"))


def eta_squared(rows: DataFrame, keys: list[str], level: str, y: str) -> DataFrame:
    """Share of the variance of ``y`` between the levels; null below two rows, 0 where ``y`` is constant."""
    good = rows.where(F.col(level).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    per = good.groupBy(*keys, level).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
    out = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    middle = F.col("s") * F.col("s") / F.col("n")
    return out.select(*keys, F.when(F.col("n") < 2, None).otherwise(F.coalesce(F.try_divide(F.col("b") - middle, F.col("q") - middle), F.lit(0.0))).alias("eta2"))


RANGES = 256


def ranges_of(rows: DataFrame, column: str, n: int = RANGES) -> Column:
    """Number of the range of ``column`` that a row lies in, of about ``n`` equally filled ones."""
    bounds = rows.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    bounds = sorted({b for b in bounds if b is not None})
    edges = F.lit([float(b) for b in bounds]).cast("array<double>")
    # the value is bound once, however dear the expression behind the column is
    return F.transform(F.array(column), lambda x: F.size(F.filter(edges, lambda b: b < x)))[0]


def counts_below(rows: DataFrame, order: str, n: str) -> DataFrame:
    """Adds ``below``, the sum of ``n`` over the rows of smaller ``order``; ``order`` has no ties.

    The rows are cut into ranges that are summed by themselves, and the sums of
    earlier ranges are carried forward, so no task orders all rows.
    """
    cut_up = rows.withColumn("range_no", ranges_of(rows, order))
    carried = cut_up.groupBy("range_no").agg(F.sum(n).alias("in_range"))
    carried = carried.select("range_no", F.coalesce(F.sum("in_range").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("carried"))
    inside = Window.partitionBy("range_no").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut_up.withColumn("below", F.coalesce(F.sum(n).over(inside), F.lit(0.0))).join(F.broadcast(carried), "range_no")
    return out.withColumn("below", F.col("below") + F.col("carried")).drop("range_no", "carried")


def exact_quantile(rows: DataFrame, column: str, q: float) -> float | None:
    """The ``q`` quantile, linear between neighbours, as one number; null without values.

    Counts by range tell where it lies, and only that range is ordered.
    """
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    ranged = values.withColumn("range_no", ranges_of(values, "x"))
    counts = {r.range_no: (r.n, r.top) for r in ranged.groupBy("range_no").agg(F.count("*").alias("n"), F.max("x").alias("top")).collect()}
    total = sum(n for n, _ in counts.values())
    if not total:
        return None
    place, before = q * (total - 1), 0
    for i in sorted(counts):
        n, _ = counts[i]
        if place < before + n:
            break
        before += n
    own = ranged.where(F.col("range_no") == i)
    low, step = int(place) - before, place - int(place)
    at = own.agg(F.percentile("x", F.lit(low / max(1, n - 1))).alias("a"), F.percentile("x", F.lit(min(1.0, (low + 1) / max(1, n - 1)))).alias("b")).first()
    above = at.b
    if low + 1 >= n and step:  # the upper neighbour lies in the next range
        above = ranged.where(F.col("range_no") == min(j for j in counts if j > i)).agg(F.min("x")).first()[0]
    return at.a + step * (above - at.a)


def auroc(rows: DataFrame, keys: list[str], score: str, y: str, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve by midranks, of rows that count ``weight`` times; null where a class is missing.

    Equal scores are counted first, so the ordered pass runs over distinct
    scores only.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    per = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, score).agg(F.sum(times).cast("double").alias("n_tied"), F.sum(F.col(y).cast("double") * times).alias("n_tied_pos"))
    if keys:
        below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        ranked = per.withColumn("below", F.coalesce(F.sum("n_tied").over(below), F.lit(0.0)))
    else:
        ranked = counts_below(per, score, "n_tied")
    ranked = ranked.withColumn("midrank", F.col("below") + (F.col("n_tied") + 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum(F.col("midrank") * F.col("n_tied_pos")).alias("rank_sum"), F.sum("n_tied_pos").alias("n_pos"), F.sum(F.col("n_tied") - F.col("n_tied_pos")).alias("n_neg"))
    return out.select(*keys, F.try_divide(F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def monotone_trend(rows: DataFrame, keys: list[str], along: str, value: str) -> DataFrame:
    """Whether ``value`` never rises along the order within each group."""
    w = Window.partitionBy(*keys).orderBy(along)
    steps = rows.withColumn("before", F.lag(value).over(w))
    return steps.groupBy(*keys).agg(F.coalesce(F.bool_and(F.col("before").isNull() | (F.col(value) <= F.col("before") + 1e-12)), F.lit(True)).alias("never_rises"))
