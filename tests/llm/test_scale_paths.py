"""The paths that large inputs take, forced on small ones, against brute force row for row."""

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.llm import brute
from veilspark.llm import decontaminate, hilbert, ngram_join, substring_dedup
from veilspark.llm._spark import mid_ranks, spread_join


def leak_rows(rng):
    """Repeated rows, null ids, texts that share an id, and words and windows that repeat on both sides."""
    items = [(i, " ".join(brute.words(rng, n, 3000))) for i, n in enumerate([40, 25, 10, 11, 9, 5, 1, 120])]
    items += [(50, " ".join(["same"] * 300)), (51, " ".join(["same"] * 40)), (52, items[1][1]), (53, "a b " * 60), (None, items[0][1]), (60, None), (61, "")]
    rows = brute.awkward(rng)
    for k, (_, t) in enumerate(items):
        part = (t or "").split()
        rows.append((300 + k, " ".join(brute.words(rng, 20, 3000) + part[: max(10, len(part) // 2)] + brute.words(rng, 20, 3000))))
    leaked = rows[-15][1]
    rows += [(900, " ".join(["same"] * 500)), (901, "a b " * 200), (300, leaked), (300, leaked), (300, "another text of that id"), (None, leaked), (None, leaked), (None, None), (None, None), (7, "")]
    return items, rows


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300}, {"block_bytes": 0, "most_log_bits": 16}])
def test_every_row_is_judged_whatever_the_size_of_the_benchmark(spark, options):
    items, rows = leak_rows(random.Random(61))
    bench = brute.table(spark, [(i, t, "x", 1) for i, t in items], "item_id long, text string, k string, hash int")
    want = sorted(((i, *brute.leaks(t, items)) for i, t in rows), key=str)
    got = [(r.doc_id, r.n_words, r.hit_words, r["items"]) for r in decontaminate.find_leaks(brute.docs(spark, rows), bench, **options).collect()]
    assert sorted(got, key=str) == want
    kept = decontaminate.drop_leaked(brute.docs(spark, rows), bench, **options)
    assert kept.columns == brute.docs(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in rows if not brute.leaks(t, items)[1])


def test_windows_that_agree_in_one_hash_are_told_apart():
    items = decontaminate.Items(["a", "b", "c"], [" ".join(f"w{i}" for i in range(12)), "one two three", "one two three"])
    other = items.check ^ np.uint64(1)
    assert (items.find(items.hash, other) == -1).all() and (items.find(items.hash, items.check) == np.arange(len(items.hash))).all()
    items.hash[:] = items.hash[0]  # all collide in the first hash
    assert (items.find(items.hash, items.check) == np.arange(len(items.hash))).all() and (items.find(items.hash, other) == -1).all()


def test_a_window_in_many_items_is_looked_up_once():
    same = " ".join(f"w{i}" for i in range(10))
    items = decontaminate.Items([str(i) for i in range(5000)], [same] * 5000)
    assert len(items.hash) == 1 and len(items.rows) == 5000
    of, item = items.names(np.zeros(3000, np.int64), np.zeros(3000, np.int64), 2)
    assert of.tolist() == [0, 5000, 5000] and item.tolist() == list(range(5000))


def test_mid_ranks_spread_few_values(spark):
    edges = [1.0] * 100 + [2.0] * 50 + [7.0] * 105
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 5.0, 7.0, 9.0)], "v double")
    assert [r[0] for r in df.select(mid_ranks(F.col("v"), edges)).collect()] == [0, 50, 100, 125, 150, 202, 255]
    assert [r[0] for r in df.select(mid_ranks(F.col("v"), [])).collect()] == [0] * 7


def test_spread_join_is_a_left_join(spark, monkeypatch):
    rng = random.Random(71)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None, "none"])) for i in range(4000)]
    counts = Counter(k for _, k in rows if k != "none")
    table = spark.createDataFrame([(k, n, n * 2) for k, n in counts.items()], "k string, n long, x long")
    got = spread_join(spark.createDataFrame(rows, "i long, k string"), table, ["k"], "n", len(rows)).collect()
    assert counts["hot"] > 1000 and Counter((r.i, r.k, r.x) for r in got) == Counter((i, k, counts[k] * 2 if k != "none" else None) for i, k in rows)


def layout(rows, shards, key):
    """Mean number of distinct values a shard where rows are cut in the order given."""
    return np.mean([len({key(r) for r in rows[s * len(rows) // shards : (s + 1) * len(rows) // shards]}) for s in range(shards)])


def test_shards_prune_every_dimension(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r.asDict() for r in docs.select("doc_id", "lang", "source", F.octet_length("text").alias("bytes")).collect()]
    place = {r.doc_id: (r.shard, r.slot) for r in hilbert.shard_documents(docs, range_rows=300).collect()}
    assert len(place) == len(rows)
    along = sorted(rows, key=lambda r: place[r["doc_id"]])
    shuffled = random.Random(3).sample(rows, len(rows))
    by_size = sorted(rows, key=lambda r: r["bytes"])
    for dim, share in (("lang", 0.75), ("source", 0.75)):
        at = lambda order: layout(order, 40, lambda r: r[dim])  # noqa: B023, E731
        assert at(along) < share * min(at(shuffled), at(by_size)), (dim, at(along), at(shuffled), at(by_size))
    spans = lambda order: np.mean([np.ptp([r["bytes"] for r in order[s * len(order) // 40 : (s + 1) * len(order) // 40]]) for s in range(40)])
    assert spans(along) < spans(shuffled)


def test_equal_texts_stay_in_one_shard(spark):
    rng = random.Random(72)
    rows = [(i, " ".join(brute.words(rng, rng.randrange(5, 50)))) for i in range(700)]
    for k in range(60):
        copy = " ".join(brute.words(rng, rng.randrange(5, 50)))
        rows += [(1000 + 40 * k + j, copy) for j in range(rng.randrange(2, 12))]
    rows += [(9000 + j, "a group larger than a shard") for j in range(90)] + [(None, rows[700][1]), (None, None), (9500, "")]
    rng.shuffle(rows)
    got = hilbert.shard_documents(brute.docs(spark, rows), range_rows=200).collect()
    shards, sizes = {}, Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    for r in got:
        shards.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    cut = [k for k, s in shards.items() if len(s) > 1]
    assert len(cut) == 1 and cut[0][1] == len("a group larger than a shard") + 16


def linked(rows):
    """Sorted rows of the join's contract with the number of links, by brute force."""
    sets = [brute.shingles(t) for _, t in rows]
    links = [sum(1 for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b)) for i, a in enumerate(sets)]
    return sorted(((*r, n) for r, n in zip(brute.joined(rows), links)), key=str)


def test_sets_held_together_by_a_chain_are_verified_entry_by_entry(spark, monkeypatch):
    """Neighbours share three of four parts, so chance entries join them all, but only true near copies link."""
    rng = random.Random(81)
    parts = [brute.words(rng, 15, 90_000) for _ in range(164)]
    rows = [(i, " ".join(w for p in parts[i : i + 4] for w in p)) for i in range(160)]
    for k in range(12):
        copy = rows[10 * k][1].split()
        copy[rng.randrange(60)] = f"z{k}"
        rows += [(500 + k, " ".join(copy)), (600 + k, " ".join(copy))]
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    seen, candidates = [], ngram_join._candidates

    def kept(*a):
        out = candidates(*a)
        seen.append(out.groupBy("by_entry").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("set_id").alias("sets"), F.sum("blocks").alias("moved")).collect())
        return out

    monkeypatch.setattr(ngram_join, "_candidates", kept)
    got = ngram_join.ngram_jaccard_join(brute.docs(spark, rows), frequent=4, count_links=True).collect()
    assert sorted(map(tuple, got), key=str) == linked(rows)
    (found,) = seen
    assert [r.by_entry for r in found] == [True] and found[0].sets > 100 and found[0].moved < found[0].sets * -(-found[0].sets // 16)


def test_dealing_in_two_levels_keeps_every_link(spark, monkeypatch):
    rng = random.Random(82)
    rows = [r for r in brute.awkward(rng) if len(r[1] or "") < 10_000]
    monkeypatch.setattr(ngram_join, "COUNT_ENTRIES", 150)
    got = ngram_join.ngram_jaccard_join(brute.docs(spark, rows), wide=4, count_links=True).collect()
    assert sorted(map(tuple, got), key=str) == linked(rows)
    texts = brute.docs(spark, rows).select("text")
    one, two = ({r.set_id: r.alone for r in ngram_join.alone_counts(texts, 5, 30, wide).collect()} for wide in (100, 4))
    assert one == two and len(one) > 10


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rng = random.Random(83)
    base = brute.words(rng, 60, 9000)
    near = [*base[:-1], "other"]
    a, b, c = " ".join(base), " ".join(near), " ".join(brute.words(rng, 60, 9000))
    rows = [(1, a), (5, b), (5, c), (5, c), (None, a), (None, c), (None, "alone and without an id at all"), (7, None), (7, None), (7, "")]
    docs = brute.docs(spark, rows).withColumn("_kept", F.lit(1)).withColumn("row_id", F.lit(2)).withColumn("first_hash", F.lit("x"))
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(1, a): 1, (5, c): 1, (None, "alone and without an id at all"): 1, (7, None): 1, (7, ""): 1})


@pytest.mark.parametrize("options", [{"max_cells": 0}, {"max_cells": 0, "bucket_bytes": 4000, "wide": 8}, {"bucket_bytes": 4000, "wide": 8}])
def test_windows_dedup_is_exact_on_every_path(spark, options):
    rows = brute.awkward(random.Random(91)) + [(None, "null id " * 30)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_windows(brute.docs(spark, rows), **options).collect()}
    assert got == brute.deduped(rows)


def test_sketches_add_up_the_same_in_any_number_of_levels(spark, monkeypatch):
    rng = random.Random(92)
    texts = [" ".join(brute.words(rng, 300, 40)) for _ in range(60)]
    docs = brute.docs(spark, list(enumerate(texts + texts[:20]))).select("text").repartition(40)
    one, many = (substring_dedup.sketch_bits(docs, 20, 16, 20_000, flush=flush, fan=2) for flush in (10**6, 500))
    assert one == many and 100 < sum(b.bit_count() for b in one)
