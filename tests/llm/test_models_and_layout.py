"""URL filter, HTML extraction, fingerprints, classifiers, mixing and shards."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from veilspark.llm import hilbert, html_extract, lz_fingerprint, mixing, quality, toxicity, url_filter


def test_url_verdicts(spark):
    urls = [
        "http://a.net/x", "http://a.net", "https://WWW.Example.NET/en/1?q=/fr/", "http://example.net/de/", "http://x.example.com/de/3", "http://x.example.com/dex", "http://m.casino-win.example.com/en/1", "http://cheappills.example.com/",
        "http://citylibrary.example.com/", "http://casino.org/fr/1", "http://badexample.net/en/1", "no scheme", None, "", "://", "a://b://c/d", "http://h?x/y", "http://h#x", "http://\u00c4B.com/P#q", "http://" + "a" * 5000 + ".com/" + "b" * 5000, "http://x.y/p\nq",
    ]
    pages = brute.table(spark, [(i, u, "<p>", "mine", "other") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    rules = {"net/": ("net", "/", "block"), "example.net/en/": ("example.net", "/en/", "allow"), "example.com/de/": ("example.com", "/de/", "block"), "org/fr/": ("org", "/fr/", "allow")}
    model = url_filter.Model()
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = rest[:n].translate(brute.LOWER), rest[n:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [k for k, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        verdict = rules[rule][2] if rule else "block" if model.score(host, path) > 0 else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert got[6].verdict == got[7].verdict == "block" and got[8].verdict == got[12].verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_segmentation_finds_the_cheapest_cut():
    model = url_filter.Model()
    assert model.segment("cheappills") == ["cheap", "pills"] and model.segment("freecasinobonus") == ["free", "casino", "bonus"]
    rng = random.Random(1)
    cost = lambda w: model.cost.get(w, url_filter.UNKNOWN_START + url_filter.UNKNOWN_LETTER * len(w))
    for _ in range(20):
        name = "".join(rng.choice(["win", "bet", "ca", "sino", "x", "town"]) for _ in range(3))
        cuts = []
        for mask in range(1 << (len(name) - 1)):
            parts, last = [], 0
            for i in range(len(name)):
                if i == len(name) - 1 or mask >> i & 1:
                    parts.append(name[last : i + 1])
                    last = i + 1
            cuts.append(sum(map(cost, parts)))
        assert abs(sum(map(cost, model.segment(name))) - min(cuts)) < 1e-9


def test_html_extraction(spark):
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now.</div><article><h1>Head&amp;line</h1><p>First  <b>bold</b>\ntext, with a good many words in it so that it reads as prose.<br>Next line.</p><script>x()</script><p>Second &lt;p&gt; paragraph of the story, again of some length.</p></article><footer>&copy; me</footer></body></html>'
    rows = [(1, "u1", page), (2, None, None), (3, "u3", ""), (4, "u4", "<"), (5, "u5", "<p" + " x" * 20_000), (6, "u6", "<div>" * 3000 + "deep words here" + "</div>" * 3000), (1, "u1", page)]
    pages = brute.table(spark, [(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract_main_text(pages).collect()
    want = "Head&line First bold text, with a good many words in it so that it reads as prose. Next line. Second <p> paragraph of the story, again of some length."
    assert len(got) == len(rows) and [r.text for r in got if r.page_id == 1] == [want] * 2
    assert all(r.n_chars == len(r.text) for r in got) and {r.page_id: r.text for r in got if r.page_id in (2, 3)} == {2: "", 3: ""}
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_html_trees_on_pages_held_out():
    trees = html_extract.trained()
    right = total = 0
    for page in html_extract.training_pages(60, 77):
        nodes = html_extract.nodes_of(html_extract.parse(page))
        keep = html_extract.decode(nodes, trees.log_odds(html_extract.features(nodes)))
        assert all(n.parent is None or not k or keep[nodes.index(n.parent)] for n, k in zip(nodes, keep))
        right += sum(k == bool(n.main) for n, k in zip(nodes, keep) if n.parent is not None)
        total += len(nodes) - 1
    assert right / total > 0.97


def test_lz_parse_and_likeness():
    def plain(data):
        known, out, node = {b""}, [], b""
        for c in data:
            node += bytes([c])
            if node not in known:
                known.add(node)
                out.append(node)
                node = b""
        return out

    rng = random.Random(2)
    for _ in range(20):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 300)))
        ends = lz_fingerprint.phrase_ends(data)
        assert [data[a + 1 : b + 1] for a, b in zip([-1, *ends], ends)] == plain(data)
        text, cut = data.decode(), rng.randrange(0, len(data) + 1)
        other = text[:cut] + "cab" * rng.randrange(9)
        assert lz_fingerprint.fingerprint_pair(text, other, cut) == (lz_fingerprint.fingerprint(text), lz_fingerprint.fingerprint(other))
    text = " ".join(brute.words(rng, 400))
    assert lz_fingerprint.likeness(lz_fingerprint.fingerprint(text), lz_fingerprint.fingerprint(text)) == 1
    near = lz_fingerprint.likeness(lz_fingerprint.fingerprint(text), lz_fingerprint.fingerprint(text[:-40] + "other"))
    assert near > lz_fingerprint.likeness(lz_fingerprint.fingerprint(text), lz_fingerprint.fingerprint("completely different " * 90))


def test_lz_edits_follow_the_order_of_ids(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(brute.words(rng, rng.randrange(1, 60)))) for i in rng.sample(range(1000), 60)] + [(2000, None), (-5, ""), (-7, "é" * 7), (3000, "w" * 50_000)]
    for options in ({"range_bytes": 700}, {}):
        got = {r.doc_id: r for r in lz_fingerprint.fingerprint_edits(brute.docs(spark, rows), **options).collect()}
        ordered = sorted(rows, reverse=True)
        assert len(got) == len(rows)
        for k, (i, text) in enumerate(ordered):
            text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
            half = len(text) // 2
            new = text[: len(text) - half] + after[:half]
            r = got[i]
            mark, new_mark, next_mark = map(lz_fingerprint.fingerprint, (text, new, after))
            assert (r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest(), r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(new.encode()).hexdigest(), mark, new_mark)
            assert (r.near_edited, r.near_next) == (lz_fingerprint.likeness(mark, new_mark), lz_fingerprint.likeness(mark, next_mark))
    one = lz_fingerprint.fingerprint_edits(brute.docs(spark, [(1, "abcd")])).collect()
    assert one[0].edited_text == "abab" and lz_fingerprint.fingerprint_edits(brute.docs(spark, [])).count() == 0
    again = lz_fingerprint.fingerprint_edits(brute.docs(spark, [(1, "ab"), (1, "ab"), (None, "cd")])).collect()
    assert [r.edited_text for r in sorted(again, key=lambda r: (r.doc_id is None, r.edited_text))] == ["aa", "ac", "ca"]


def test_toxicity_folds_and_excepts(spark):
    m = toxicity.Matcher(toxicity.Model())
    total = lambda t: m.total(toxicity.fold(t))
    assert total("You IDIOT!!") == total("you 1d10t") == total("yоu іdiоt") == toxicity.DEFAULT_WEIGHT
    assert total("a$$hole") > 0 and total("the trash can stood there") == 0 < total("you are trash") and total("unscum") == 0
    rows = [(1, None), (2, ""), (3, "idiot"), (4, "fine words " * 3000), (5, "idiot moron " * 5)]
    got = {r.doc_id: r.score for r in toxicity.score(brute.docs(spark, rows + [(5, "idiot moron " * 5)]), toxicity.Model()).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[1] == got[2] < 0.3 < got[5] and got[4] < 0.3
    kept = toxicity.reject_toxic(brute.docs(spark, rows), toxicity.Model())
    assert kept.columns == brute.docs(spark, rows).columns and {r.doc_id for r in kept.collect()} == {1, 2, 4}


def test_toxicity_learns_stems(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(brute.words(rng, 60) + ([f"qux{rng.choice('abc')}el"] * 3 if i % 5 == 0 else []))) for i in range(200)]
    labels = brute.table(spark, [(i, int(i % 5 == 0)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = brute.docs(spark, rows)
    model = toxicity.fit(docs, labels)
    assert "qux" in model.weights and not any(w.startswith("quxa") for w in model.weights)
    assert {r.doc_id for r in toxicity.score(docs, model).filter("score >= 0.3").collect()} == {i for i, _ in rows if i % 5 == 0}
    assert toxicity.fit(docs, labels.limit(0)).weights == toxicity.Model().weights
    assert docs.select(toxicity.fold_of(F.col("doc_id"), 4).alias("m")).first().m == zlib.crc32(b"0") % 4


def test_quality_learns_statistics(spark):
    rng = random.Random(11)
    rows = [(i, (" ".join(brute.words(rng, 80)) if i % 3 else "!! ".join(w.upper() for w in brute.words(rng, 80, 9)))) for i in range(300)] + [(900, None), (901, ""), (902, "x" * 100_000), (5, "twice")]
    docs = brute.docs(spark, rows)
    found = quality.features(docs)
    labels = brute.table(spark, [(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = quality.score(found, quality.fit(found, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.3) == (r.id % 3 > 0) for r in got if 200 <= r.id < 300]
    assert sum(held) / len(held) > 0.95
    assert {r.score for r in quality.score(found, quality.fit(found, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.score(found, quality.fit(found, labels.filter("quality = 1"))).collect()} == {1.0}
    assert 0 < min(r.score for r in got) and max(r.score for r in got) < 1 and len({r.score for r in got}) > 3


def test_statistics_match_a_plain_count():
    from veilspark.llm import _text as T

    texts = ["Aa b!b 12\nAa b!b 12", "", "ééé x"]
    x = quality.statistics(next(T.chunks(brute.batch(texts))))
    assert np.allclose(x[1], 0)
    n = len(texts[0])
    assert np.isclose(x[0, 1], np.log1p(6)) and np.isclose(x[0, 3], 0.5) and np.isclose(x[0, 6], 0.5) and np.isclose(x[0, 9], 2 / n) and np.isclose(x[0, 10], 4 / n)


def test_isotonic_is_the_nearest_monotone_curve():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 20, 30).astype(float)
    good = np.floor(n * rng.random(30))
    got = quality.isotonic(good, n)
    assert (np.diff(got) >= -1e-12).all() and len(got) == 30
    # pooled means over all runs: max over starts of min over ends
    for k in np.flatnonzero(n):
        mean = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()
        want = max(min(mean(a, b) for b in range(k, 30)) for a in range(k + 1) if n[a : k + 1].sum())
        assert np.isclose(got[k], want)


def test_raking_meets_margins(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(brute.words(rng, rng.randrange(1, 90))), rng.choice(["a", "b", None]), rng.choice(["s", "t", "u"])) for i in range(800)] + [(None, None, None, "s"), (5, "", "a", "s")]
    df = brute.table(spark, rows, "doc_id long, text string, lang string, source string")
    targets = {"lang": {"a": 0.5, "b": 0.3, None: 0.2}, "source": {"s": 0.2, "t": 0.3, "u": 0.5}}
    margins = {"lang": F.col("lang"), "source": F.col("source")}
    both = []
    for most in (1000, 0):
        out = mixing.mix(df, margins, mixing.tokens_of(F.col("text")), targets, keep=0.5, most_cells=most).collect()
        assert len(out) == len(rows)
        mass, per = Counter(), Counter()
        for r in out:
            mass[r._lang] += r._tokens * r._weight
            per[r._source] += r._tokens * r._weight
        total = sum(mass.values())
        assert all(abs(mass[k] / total - v) < 1e-6 for k, v in targets["lang"].items()) and all(abs(per[k] / total - v) < 1e-6 for k, v in targets["source"].items())
        assert abs(sum(r._tokens * r._probability for r in out) / sum(r._tokens for r in out) - 0.5) < 1e-6
        both.append({(r.doc_id, r._tokens): round(r._probability, 6) for r in out})
        assert abs(sum(r._kept for r in out) / len(out) - 0.5) < 0.15
    assert both[0] == both[1]
    assert mixing.mix(df.limit(0), margins, F.lit(1)).count() == 0
    assert {r._tokens for r in mixing.mix_documents(brute.docs(spark, [(1, None), (2, ""), (3, " a b ")])).collect()} == {0, 2}


def test_curve_is_a_hilbert_curve(spark):
    bits, dims = 3, 3
    cells = spark.range(1 << bits * dims).select(*[F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).alias(f"q{i}") for i in range(dims)])
    got = cells.withColumn("h", hilbert.curve_index([F.col(f"q{i}") for i in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(1 << bits * dims))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(got, got[1:]))


def test_shards_differ_by_one_row(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(brute.words(rng, rng.randrange(0, 50)))) for i in range(430)] + [(i, "the same text") for i in range(1000, 1200)] + [(None, None), (7, None)]
    for some in (rows, rows[:7], rows[:1]):
        got = hilbert.shard_documents(brute.docs(spark, some), range_rows=50).collect()
        assert len(got) == len(some)
        count = Counter(r.shard for r in got)
        sizes = [count.get(s, 0) for s in range(40)]
        assert max(sizes) - min(sizes) <= 1 and set(count) <= set(range(40))
        for s in count:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
        want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in some)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
        order = [(r.curve) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert len(some) == len(rows) or order == sorted(order)  # where no group has to move
    assert hilbert.shard_documents(brute.docs(spark, [])).count() == 0


def test_kept_tokens_meet_the_margins_of_skewed_groups(spark):
    text = " ".join(["w"] * 60)
    rows = [(i, text, ["a", "b"][i % 3 == 0], "big" if i < 500 else f"s{i % 20}") for i in range(1500)] + [(2000 + i, text, "c", "big") for i in range(12)]
    df = brute.table(spark, rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df, {"lang": F.col("lang"), "source": F.col("source")}, mixing.tokens_of(F.col("text"))).collect()
    whole = sum(r._tokens for r in out)
    kept = sum(r._tokens * r._probability for r in out)
    assert len(out) == len(rows) and all(0 < r._probability <= 1 for r in out) and kept <= 0.9 * whole + 1e-6
    reach = []
    for m in ("_lang", "_source"):
        own, stay = Counter(), Counter()
        for r in out:
            own[r[m]] += r._tokens / whole
            stay[r[m]] += r._tokens * r._probability / kept
        want = mixing.tempered(own)
        assert all(abs(stay[k] - v) < 1e-5 for k, v in want.items())
        reach += [own[k] / v for k, v in want.items()]
    assert abs(kept / whole - min(reach)) < 1e-5  # the group that gains most is kept whole


def test_toxicity_learns_insults_rarer_than_a_hundredth(spark):
    rng = random.Random(15)
    rare = [f"{a}zq{b}" for a in "bdfgk" for b in ("orp", "ilm", "ent", "ask")]  # each in 25 of 4000 toxic texts
    rows = [(i, " ".join(brute.words(rng, 12) + (["glarp"] if i >= 500 else [rare[i % 20]]))) for i in range(4000)]
    rows += [(10_000 + i, " ".join(brute.words(rng, 12))) for i in range(4000)]
    labels = brute.table(spark, [(i, int(i < 10_000)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(brute.docs(spark, rows), labels)
    matcher = toxicity.Matcher(model)
    assert all(matcher.total(toxicity.fold(w)) > 0 for w in [*rare, "glarp"])
    assert not any(matcher.total(f"w{i}") for i in range(400))
