"""Operators on words: n-gram join, window dedup, decontamination, against brute force."""

import random

import pytest

from tests.llm import brute
from veilspark.llm import decontaminate, ngram_join, substring_dedup
from veilspark.llm._spark import components


def test_components_agree_on_both_paths(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 30)]
    df = spark.createDataFrame(edges, "u long, v long")
    small = sorted(map(tuple, components(df).collect()))
    assert small == sorted(map(tuple, components(df, small=0).collect()))
    label = dict(small)
    assert all(label[a] == label[b] for a, b in edges if a != b) and all(k >= v for k, v in small)
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_exact(spark, seed):
    rng = random.Random(seed)
    rows = brute.awkward(rng)
    small = [f"s{i}" for i in range(12)]
    rows += [(200 + i, " ".join(rng.choice(small) for _ in range(rng.randrange(3, 30)))) for i in range(60)]
    rows += [(rows[12][0], rows[12][1]), (None, rows[13][1]), (None, "nothing like it at all here")]  # a repeated row and null ids
    got = ngram_join.ngram_jaccard_join(brute.docs(spark, rows), frequent=3 if seed == 1 else 32, broadcast_rows=0 if seed == 1 else 10**6)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute.joined(rows), key=str)


def test_join_of_one_large_group_meets_block_by_block(spark, monkeypatch):
    rng = random.Random(3)
    base, rows = brute.words(rng, 80, 9000), []
    for k in range(40):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    got = ngram_join.ngram_jaccard_join(brute.docs(spark, rows), frequent=4)
    assert sorted(map(tuple, got.collect())) == sorted(brute.joined(rows))
    kept = {r.doc_id for r in ngram_join.keep_first(brute.docs(spark, rows)).collect()}
    assert kept == {c for _, _, c in brute.joined(rows)}


def test_join_counts_every_link(spark, monkeypatch):
    rng = random.Random(14)
    base, rows = brute.words(rng, 60, 9000), []
    for k in range(30):  # a dense group, a chain and copies
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    chain = brute.words(rng, 120, 9000)
    rows += [(100 + k, " ".join(chain[2 * k : 2 * k + 60])) for k in range(12)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "alone"), (203, "Alone"), (204, None), (None, rows[3][1])]
    sets = [brute.shingles(t) for _, t in rows]
    links = [sum(1 for j, b in enumerate(sets) if i != j and a & b and 100 * len(a & b) >= 80 * len(a | b)) for i, a in enumerate(sets)]
    want = sorted([(*r, n) for r, n in zip(brute.joined(rows), links)], key=str)
    for block in (1024, 7):
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
        got = ngram_join.ngram_jaccard_join(brute.docs(spark, rows), frequent=4, count_links=True)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_join_of_empty_tables(spark):
    assert ngram_join.ngram_jaccard_join(brute.docs(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_jaccard_join(brute.docs(spark, [(4, None)])).collect()] == [(4, 0, 4)]


def test_signatures_keep_every_link():
    import numpy as np

    rng = random.Random(8)
    for _ in range(300):
        n = rng.randrange(2, 60)
        a = set(rng.sample(range(1, 400), n))
        b = set(a)
        for x in rng.sample(sorted(a), rng.randrange(0, max(1, n // 8) + 1)):
            b.discard(x)
            if rng.random() < 0.5:
                b.add(rng.randrange(1, 400))
        if 100 * len(a & b) < 80 * len(a | b) or a == b:
            continue
        df = {x: 2 + x % 50 for x in range(400)}
        sig = [set(ngram_join.signatures(np.array(sorted(s), np.uint64), np.array([df[x] for x in sorted(s)]), len(s), 80, frequent=20).tolist()) for s in (a, b)]
        assert sig[0] & sig[1], (a, b)


def test_windows_dedup_is_exact(spark):
    rows = brute.awkward(random.Random(4)) + [(None, "null id " * 30)]
    for options in ({}, {"max_cells": 1 << 16}):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_windows(brute.docs(spark, rows), **options).collect()}
        assert got == brute.deduped(rows)


def test_windows_dedup_of_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"u{i}" for i in range(50))
    got = substring_dedup.dedup_windows(brute.docs(spark, [(5, text), (5, text), (6, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(5, 0), (5, 0), (6, 50)]
    assert substring_dedup.dedup_windows(brute.docs(spark, [])).count() == 0


def test_decontamination_is_exact(spark):
    rng = random.Random(6)
    items = [(i, " ".join(brute.words(rng, n, 3000))) for i, n in enumerate([40, 25, 10, 11, 9, 5, 4, 1, 200, 10])] + [(100, None), (101, ""), (102, "?!"), (103, "solo"), (104, "solo")]
    rows = brute.awkward(rng)
    for k, (_, t) in enumerate(items):
        part = (t or "").split()
        rows.append((300 + k, " ".join(brute.words(rng, 30, 3000) + part[: max(10, len(part) // 2)] + brute.words(rng, 30, 3000)).upper().replace(" ", ", ")))
        rows.append((400 + k, " ".join(part[1:10])))
    bench = brute.table(spark, [(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    want = {i: brute.leaks(t, items) for i, t in rows}
    for options in ({}, {"block_bytes": 300}):
        got = {r.doc_id: (r.n_words, r.hit_words, r["items"]) for r in decontaminate.find_leaks(brute.docs(spark, rows), bench, **options).collect()}
        assert got == want
    kept = {r.doc_id for r in decontaminate.drop_leaked(brute.docs(spark, rows), bench).collect()}
    assert kept == {i for i, w in want.items() if not w[1]}


def test_decontamination_with_empty_sides(spark):
    bench = brute.table(spark, [], "item_id long, text string")
    assert [r.hit_words for r in decontaminate.find_leaks(brute.docs(spark, [(1, "a b c")]), bench).collect()] == [[]]
    assert decontaminate.find_leaks(brute.docs(spark, []), bench).count() == 0
