"""Plain versions of the operators' contracts, and small tables with awkward rows."""

import hashlib
import re

import pyarrow as pa

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, size=5):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def joined(rows, percent=80):
    """[(id, size, component)] in the order of rows of (id, text)."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    low = {x: min((r[0] for r, y in zip(rows, label) if y == x and r[0] is not None), default=None) for x in label}
    return [(r[0], len(s), low[x] if s else r[0]) for r, s, x in zip(rows, sets, label)]


def deduped(rows, window=20):
    """{id: (words, removed, kept text)} for distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = SPACED.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out[i] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)
    return out


def leaks(text, items, window=10):
    wins = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - window + 1)):
            if k := tuple(w[s : s + window]):
                wins.setdefault(k, set()).add(i)
    w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
    for n in {len(k) for k in wins}:
        for s in range(len(w) - n + 1):
            if (k := tuple(w[s : s + n])) in wins:
                hit |= set(range(s, s + n))
                found |= wins[k]
    return len(w), sorted(hit), sorted(str(i) for i in found if i is not None)


def table(spark, rows, schema):
    names = [c.strip().split()[0] for c in schema.split(",")]
    return spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema).select(*names)


def docs(spark, rows):
    """Documents of (id, text) with the other columns, two of them clashing with the operators' own names."""
    full = [(i, t, "en" if k % 3 else None, f"src{k % 4}", len(t or ""), "x", k) for k, (i, t) in enumerate(rows)]
    return table(spark, full, "doc_id long, text string, lang string, source string, n_chars long, bucket string, place int")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward(rng):
    """Nulls, empties, blanks, short and very long texts, copies, near copies, shared passages."""
    base, passage = words(rng, 120, 5000), words(rng, 60, 5000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "A B C D"), (8, "é É e"), (9, " ".join(words(rng, 40_000, 90_000)))]
    for k in range(12):
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
        rows.append((20 + k, " ".join(copy)))
    for k in range(6):
        rows.append((50 + k, " ".join(words(rng, 200, 5000) + passage + words(rng, 10 * k, 5000))))
    rows += [(70, " ".join(["again"] * 90)), (71, " ".join(["again"] * 30)), (72, "x y z " * 30), (80, " ".join(base)), (81, " ".join(base).upper())]
    return rows


def batch(texts):
    return pa.array(texts, pa.string())
