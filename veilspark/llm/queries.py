"""The registered queries: thin, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm._spark import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.url_filter import Model, corpus_words, judge_urls

    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, model=Model(corpus=corpus_words(pages, "html", markup=True))).select("page_id", "host", "path", "rule", "verdict")


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.hilbert import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), count_links=True)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.lz_fingerprint import fingerprint_edits

    out = fingerprint_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.substring_dedup import dedup_windows

    out = dedup_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.decontaminate import find_leaks

    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(toxicity.fold_of(F.col("doc_id"), 4) != 2))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(toxicity.fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm import quality
    from veilspark.llm._spark import written
    from veilspark.llm.toxicity import fold_of

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = written(quality.features(docs), "features")
    model = quality.fit(found, labels.filter(fold_of(F.col("doc_id"), 5) != 0))
    out = quality.score(found, model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold_of(F.col("id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.mixing import mix_documents

    out = mix_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return out.select("doc_id", F.col("_tokens").alias("tokens"), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_hilbert_shards, op3_ngram_jaccard_join, op4_html_extraction, op5_lz_fingerprint, op6_substring_dedup, op7_benchmark_decontamination,
        op8_toxicity, op9_quality_classifier, op10_mixing,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op6_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        win as (select doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') as k from (select doc_id, ws, unnest(range(greatest(len(ws) - 19, 0))) as s from w)),
        later as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as rn from win) where rn > 1),
        gone as (select distinct doc_id, unnest(range(s, s + 20)) as i from later),
        word as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from w),
        kept as (select word.doc_id, count(*) as n, string_agg(word, ' ' order by word.i) as t from word anti join gone on word.doc_id = gone.doc_id and word.i = gone.i group by word.doc_id)
        select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
    """,
    "op7_benchmark_decontamination": rf"""
        with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from (select doc_id, coalesce(text, '') as text from documents)),
        b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from (select item_id, coalesce(text, '') as text from benchmark)),
        bw as (select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[s + 1 : s + 10], ' ') as k from (select item_id, ws, unnest(range(greatest(len(ws) - 9, 1))) as s from b where len(ws) > 0)),
        lens as (select distinct n from bw),
        dw as (select doc_id, s, n, array_to_string(ws[s + 1 : s + n], ' ') as k from (select doc_id, ws, n, unnest(range(greatest(len(ws) - n + 1, 0))) as s from d, lens)),
        hit as (select distinct dw.doc_id, dw.s, dw.n, item_id from dw join bw using (n, k)),
        words as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(s, s + n)) as i from hit) group by doc_id),
        items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, item_id::varchar as i from hit) group by doc_id)
        select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join words using (doc_id) left join items using (doc_id)
    """,
}
