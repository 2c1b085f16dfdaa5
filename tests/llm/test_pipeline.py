"""The pipeline over a small table, and the registration of the queries."""

import random

from tests.llm import brute


def test_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    bench = [(1, " ".join(brute.words(rng, 30, 9000)))]
    rows = [(i, " ".join(brute.words(rng, 60, 9000)), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, "you idiot moron " * 20, "en", "s0", 0), (101, rows[0][1], "en", "s1", 0), (102, rows[1][1] + " " + bench[0][1], "en", "s1", 0), (103, None, None, None, None), (104, "", "en", "s0", 0), (103, None, None, None, None)]
    documents = brute.table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    brute.table(spark, bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    brute.table(spark, [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, ids = documents, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        ids.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str))
    clean = set(range(60))
    assert 100 not in ids[0] and clean | {101, 102, 103, 104} == set(ids[0])
    assert 101 not in ids[1] and clean | {102, 103, 104} == set(ids[1]) and len(ids[1]) == len(set(ids[1]))
    assert 102 not in ids[2] and clean | {103, 104} == set(ids[2])
    assert len(ids[3]) > 0.6 * len(ids[2]) and ids[4] == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stages_take_awkward_tables(spark, tmp_path):
    """Clashing columns, null and repeated ids, null sources, and no rows at all."""
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, t, None if i and i % 3 == 0 else "s", None if i and i % 5 == 0 else "en", 1) for i, t in brute.awkward(rng) if len(t or "") < 5000] + [(None, None, None, None, None), (None, "no id but words " * 9, "s", "en", 1), (4, "one", "s", "en", 1)]
    documents = brute.table(spark, rows, "doc_id long, text string, source string, lang string, n_chars long")
    for name in ("_tokens", "_kept", "_m0", "_id", "_key_0", "row_hash", "first_id", "_dim0", "_group0", "curve", "rank", "shard", "k", "h", "_y", "_text"):
        documents = documents.withColumn(name, documents.doc_id)
    brute.table(spark, [(1, " ".join(brute.words(rng, 30, 9000))), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    brute.table(spark, [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (documents, documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_every_operator_has_one_query():
    from veilspark.llm.queries import ORACLE_SQL, QUERIES

    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(ORACLE_SQL) <= set(QUERIES)
