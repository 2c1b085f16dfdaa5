"""Every registered query: its columns, its digests, and the classifiers' accuracy on held-out labels."""

import hashlib
import zlib

import pytest

from tests.llm import brute
from veilspark.llm import quality, toxicity
from veilspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "page_id host path rule verdict", "op2": "doc_id size text_crc32 law shard slot grown_shard", "op3": "doc_id n_shingles component_id n_links", "op4": "page_id url text n_chars",
    "op5": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op6": "doc_id n_words n_removed kept_sha256", "op7": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8": "doc_id held_out score predicted", "op9": "doc_id held_out score predicted", "op10": "doc_id tokens source lang topic weight probability kept",
}


@pytest.fixture(scope="module")
def results(spark):
    return {name.split("_")[0]: (df.dtypes, [r.asDict() for r in df.collect()]) for name, df in ((n, q(spark, FOLDER)) for n, q in QUERIES.items())}


def read(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()]


def test_columns_and_rows(spark, results):
    docs, pages = sorted(r["doc_id"] for r in read(spark, "documents")), sorted(r["page_id"] for r in read(spark, "pages"))
    for op, (types, rows) in results.items():
        assert [c for c, _ in types] == COLUMNS[op].split(), op
        key = types[0][0]
        assert sorted(r[key] for r in rows) == (docs if key == "doc_id" else pages), op
    kinds = dict(results["op2"][0]) | dict(results["op8"][0]) | dict(results["op7"][0])
    assert (kinds["size"], kinds["text_crc32"], kinds["law"], kinds["shard"], kinds["slot"], kinds["grown_shard"]) == ("bigint", "bigint", "string", "int", "bigint", "int")
    assert (kinds["held_out"], kinds["score"], kinds["predicted"], kinds["contaminated"]) == ("boolean", "double", "int", "boolean")


def test_digests_and_flags(spark, results):
    docs, items = read(spark, "documents"), [(r["item_id"], r["text"]) for r in read(spark, "benchmark")]
    by = {op: {r["doc_id"]: r for r in results[op][1]} for op in ("op2", "op3", "op5", "op6", "op7", "op8", "op9")}
    dedup = brute.deduped([(r["doc_id"], r["text"]) for r in docs])
    joined = {i: (n, c) for i, n, c in brute.joined([(r["doc_id"], r["text"]) for r in docs])}
    ordered = sorted(docs, key=lambda r: -r["doc_id"])
    for k, r in enumerate(ordered):
        i, text, after = r["doc_id"], r["text"] or "", ordered[(k + 1) % len(ordered)]["text"] or ""
        n_words, hits, found = brute.leaks(text, items)
        seven, six, five, two = by["op7"][i], by["op6"][i], by["op5"][i], by["op2"][i]
        assert (seven["n_words"], seven["n_hit"], seven["n_items"], seven["contaminated"]) == (n_words, len(hits), len(found), bool(hits))
        assert seven["items_sha256"] == brute.sha(",".join(found))
        assert (six["n_words"], six["n_removed"], six["kept_sha256"]) == (*dedup[i][:2], brute.sha(dedup[i][2]))
        half = len(text) // 2
        assert (five["n_chars"], five["edited_sha256"]) == (len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
        assert (two["size"], two["text_crc32"], two["law"], two["grown_shard"]) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "rows", None)
        assert (by["op3"][i]["n_shingles"], by["op3"][i]["component_id"]) == joined[i]
        for op, folds, held in (("op8", 4, 2), ("op9", 5, 0)):
            row = by[op][i]
            assert row["held_out"] == (zlib.crc32(str(i).encode()) % folds == held) and row["predicted"] == int(row["score"] >= 0.3) and 0 <= row["score"] <= 1


def held_out(spark, name, label, folder="/root/testdata/sf0.1"):
    """AUC, recall and precision on the labels that were not learned."""
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in QUERIES[name](spark, folder).filter("held_out").collect() if r.doc_id in labels]
    good, bad = ([s for s, _, y in rows if y == v] for v in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    hits = sum(p and y for _, p, y in rows)
    return auc, hits / len(good), hits / sum(p for _, p, _ in rows)


def test_toxicity_on_held_out_labels(spark):
    auc, recall, precision = held_out(spark, "op8_toxicity", "toxic")
    assert auc > 0.96 and recall >= 0.93 and precision >= 0.96


def test_quality_on_held_out_labels(spark):
    auc, recall, precision = held_out(spark, "op9_quality_classifier", "quality")
    assert auc > 0.99 and recall >= 0.98 and precision >= 0.98


def test_paired_stems_need_two_words():
    matcher = toxicity.Matcher(toxicity.Model(weights={"\tqux": 2.0, "quxer\n": 5.0}))
    assert matcher.total("a quxen and another quxen") == 0 and matcher.total("quxen quxa") == 4 and matcher.total("quxer") == 5 and matcher.total("quxen aquxa") == 0
    model = toxicity.Model(weights={"\tqux": 2.0}, exceptions=("quxa shop",))
    assert toxicity.Matcher(model).total("quxen in a quxa shop") == 0
    assert "\tabc" in toxicity.patterns("abcd abce") and "\tabc" not in toxicity.patterns("abcd abcd")


def test_patterns_that_chance_explains_are_not_learned():
    many = {f"p{i:05d}": 4 for i in range(20_000)}
    assert toxicity.choose(many | {"insult": 40}, {}, 300, 2500) == {"insult": pytest.approx(6.51, abs=0.01)}
    assert toxicity.evidence(5, 0, 100, 900) == pytest.approx(11.5, abs=0.1) and toxicity.evidence(1, 9, 100, 900) == 0


def test_labels_that_disagree_are_learned_the_same_way(spark):
    rows = [(i, "plain words here " * (1 + i % 3) if i % 2 else "!! SHOUTED " * (2 + i % 3)) for i in range(40)]
    docs = brute.docs(spark, rows)
    labels = [(i, i % 2) for i in range(40)] + [(i, 1 - i % 2) for i in range(0, 40, 4)]
    frame = lambda x: brute.table(spark, x, "doc_id long, quality int")
    found = quality.features(docs)
    once = quality.fit(found, frame([(i, 1 if i % 4 == 0 else y) for i, y in labels[:40]]))
    twice = quality.fit(found, frame(labels[::-1]))
    assert (once.steps == twice.steps).all()
    empty = brute.docs(spark, [])
    assert quality.score(quality.features(empty), once).count() == 0 and toxicity.score(empty, toxicity.Model()).count() == 0
    assert toxicity.fit(empty, frame(labels).withColumnRenamed("quality", "toxic")).weights == toxicity.Model().weights
