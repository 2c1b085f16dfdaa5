"""Fitted topics, and mixing by them."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veilspark.llm import mixing, topics

SUBJECTS = {"sea": "ship wave harbour sailor anchor tide deck mast storm crew", "sky": "cloud wing pilot rudder runway tower engine flight gate crew", "law": "court judge appeal clause statute jury plea bail oath verdict"}
FILLER = {"en": "the and of to in it is was for on".split(), "xx": "lo ka mi ti ra so pe du vo ne".split()}


def collection(rng, n=600):
    rows = []
    for i in range(n):
        subject, lang = rng.choice(list(SUBJECTS)), rng.choice(["en", "en", "en", "xx"])
        words = [rng.choice(SUBJECTS[subject].split()) for _ in range(40)] + [rng.choice(FILLER[lang]) for _ in range(60)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), lang, f"s{i % 3}", subject))
    return rows


def frame(spark, rows):
    return brute.table(spark, rows, "doc_id long, text string, lang string, source string, subject string")


def test_topics_find_subjects_across_languages(spark):
    rows = collection(random.Random(1))
    docs = frame(spark, rows)
    model = topics.fit(docs, topics=3)
    got = docs.select("subject", "lang", topics.topic_column(model, F.col("text"), F.col("lang")).alias("topic")).collect()
    by = Counter((r.subject, r.topic) for r in got)
    best = {s: max((n, t) for (x, t), n in by.items() if x == s) for s in SUBJECTS}
    assert len({t for _, t in best.values()}) == 3 and sum(n for n, _ in best.values()) > 0.95 * len(rows)
    assert {r.lang for r in got if r.topic == best["sea"][1]} == {"en", "xx"}
    again = topics.fit(docs.repartition(7), topics=3)
    assert np.allclose(model.centres, again.centres, atol=1e-3)


def test_rows_without_words_and_odd_tables(spark):
    rows = [(1, None, "en", "s", "x"), (2, "", None, None, "x"), (3, "!? ...", "en", "s", "x"), (4, "word " * 20_000, None, "s", "x"), (4, "word " * 20_000, None, "s", "x"), (5, "word", "en", "s", "x")]
    docs = frame(spark, rows)
    got = Counter((r.doc_id, r._topic) for r in mixing.mix_documents(docs).collect())
    assert got == {(1, "empty"): 1, (2, "empty"): 1, (3, "empty"): 1, (4, "topic0"): 2, (5, "topic0"): 1}
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    nothing = docs.filter("doc_id < 4")
    assert {r._topic for r in mixing.mix_documents(nothing).collect()} == {"empty"}


def test_kept_tokens_meet_the_margins_of_fitted_topics(spark):
    docs = frame(spark, collection(random.Random(2), 900))
    out = mixing.mix_documents(docs).collect()
    kept, whole = sum(r._tokens * r._probability for r in out), sum(r._tokens for r in out)
    for m in ("_lang", "_topic", "_source"):
        own, stay = Counter(), Counter()
        for r in out:
            own[r[m]] += r._tokens / whole
            stay[r[m]] += r._tokens * r._probability / kept
        assert len(own) > 1 and all(abs(stay[k] - v) < 1e-4 for k, v in mixing.tempered(own).items()), m


@pytest.mark.parametrize("most", [1000, 0])
def test_columns_of_the_same_names(spark, monkeypatch, most):
    if not most:  # every wide path, of few sweeps
        for name, value in (("BROADCAST_ROWS", 0), ("SWEEPS", 1), ("CAPPED_SWEEPS", 1), ("HALVINGS", 0)):
            monkeypatch.setattr(mixing, name, value)
    docs = frame(spark, collection(random.Random(3), 200))
    plain = docs.select("doc_id", "text", "lang", "source")
    for name in ("_tokens", "_m0", "_kept", "_draw", "_weight", "_probability", "_count", "_topic", "tokens", "factor"):
        docs = docs.withColumn(name, F.lit("mine"))
    model = topics.fit(plain)
    kept = mixing.sample_documents(docs, most_cells=most, model=model)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r._kept for r in rows} == {"mine"} and len({r.doc_id for r in rows}) == len(rows)
    if most:
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in mixing.sample_documents(plain, model=model).collect())
