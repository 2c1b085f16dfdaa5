"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters to Latin ones and digits to the letters they stand for; the symbols
@ $ ! | count as letters between two letters. A pattern matches at the start of a word: whole words end in a mark and must end
there, others are stems. A paired stem counts only in a text that holds two different words of it: an inflected insult
comes in several forms, while a chance word shares its stem with no other. A match inside an exception phrase does not
count. A place in the text counts once, with the greatest weight that matches it. The sum of weights S gives two measures, log(1 + S) and its density log(1 + 1000 S / length);
a logistic curve over them gives the score, so a long text needs more matches than a short one.

Weights come from labelled rows, copies and most near copies counted once: stems of 3 to 12 letters, paired or not, and whole words, by how
many toxic and clean texts hold them. A pattern needs LEAST toxic texts, log odds well above their error, and to be so
one-sided that by chance not one of all patterns looked at would be (CHANCE, by Chernoff's bound): among millions of
stems some few fall into toxic texts alone, and learning those would only repeat the labels' noise. Of stems that the same
texts hold the longest stays; longer ones go where a stem of theirs weighs as much, paired stems first.
The fixed words below are matched as well, with a default weight where the labels say nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import _text as T
from veilspark.llm._spark import ship, written

#: The built-in lexicon.
WORDS = ("asshole", "bastard", "bitch", "clown", "cunt", "disgusting", "dumbass", "fucker", "idiot", "imbecile", "loser", "moron", "pathetic", "retard", "scum", "shithead", "stupid", "trash", "worthless", "wanker")
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("clown fish", "clownfish", "pathetic fallacy", "pond scum", "recycle trash", "scum line", "stupid simple", "take out the trash", "trash bag", "trash bin", "trash can", "trash collection")
#: Look-alike letters, and the digits and symbols that stand for letters.
LOOKALIKES = {
    "а": "a", "α": "a", "ɑ": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ҽ": "e", "ɡ": "g", "һ": "h", "і": "i", "ι": "i", "ı": "i", "ј": "j", "κ": "k", "к": "k", "ӏ": "l",
    "м": "m", "п": "n", "η": "n", "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ѵ": "v", "ν": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "l"}

_TABLE = str.maketrans(LOOKALIKES | DIGITS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_SYMBOL = re.compile(r"(?<=[^\W\d_])[@$!|]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
DEFAULT_WEIGHT = 6.0
#: Ends the pattern of a whole word.
END = "\n"
#: Begins the pattern of a paired stem.
PAIR = "\t"
#: Labelled rows of each class that the lexicon is fitted on: those of least hash.
MOST_TOXIC, MOST_CLEAN = 8_000, 16_000
SHORTEST, LONGEST = 3, 12
#: Toxic texts that must hold a pattern, and log odds, less their error, that it must reach.
LEAST, LEAST_WEIGHT = 4, 3.0
#: Patterns expected by chance among all that are looked at.
CHANCE = 0.05


def fold(text: str) -> str:
    text = text.lower().translate(_TABLE)
    return _SYMBOL.sub(lambda m: "".join(SYMBOLS[s] for s in m[0]), text) if any(s in text for s in SYMBOLS) else text


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=lambda: {w: DEFAULT_WEIGHT for w in WORDS})
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Intercept and the weights of log(1 + S) and of the density.
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)


class Matcher:
    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        none = (None, None, None, False)  # weights of the whole word, the stem and the paired stem; is it an exception
        for pattern, weight in model.weights.items():
            key = pattern.removesuffix(END).removeprefix(PAIR)
            _, whole, stem, pair, exception = self.machine.get(key, (0, *none))
            if pattern.endswith(END):
                whole = weight
            elif pattern.startswith(PAIR):
                pair = weight
            else:
                stem = weight
            self.machine.add_word(key, (len(key), whole, stem, pair, exception))
        for phrase in model.exceptions:
            key = fold(phrase)
            self.machine.add_word(key, (len(key), *self.machine.get(key, (0, *none))[1:4], True))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def total(self, text: str) -> float:
        """Sum of the weights of the matched places of a folded text, and of the words of paired stems that have two."""
        if self.empty:
            return 0.0
        found: dict[int, tuple[int, float]] = {}
        paired: dict[str, list[tuple[int, int, float]]] = {}
        harmless: list[tuple[int, int]] = []
        for last, (length, whole, stem, pair, exception) in self.machine.iter(text):
            first = last - length + 1
            if first and text[first - 1].isalpha():
                continue
            ends = last + 1 == len(text) or not text[last + 1].isalpha()
            if exception and ends:
                harmless.append((first, last))
            if pair is not None:
                paired.setdefault(text[first : last + 1], []).append((first, last, pair))
            weight = max((w for w in (stem, whole if ends else None) if w is not None), default=None)
            if weight is not None and (first not in found or found[first][1] < weight):
                found[first] = (last, weight)
        safe = lambda a, b: any(x <= a and b <= y for x, y in harmless)
        out = sum(w for a, (b, w) in found.items() if not safe(a, b))
        for places in paired.values():
            words = {_WORD.match(text, a)[0] for a, b, _ in places if not safe(a, b)} if len(places) > 1 else ()
            if len(words) > 1:
                out += places[0][2] * len(words)
        return out


def measures(total: float, length: int) -> tuple[float, float]:
    return float(np.log1p(total)), float(np.log1p(1000 * total / max(length, 1)))


def patterns(text: str) -> set[str]:
    out, stems = set(), Counter()
    for word in set(_WORD.findall(fold(text))):
        if len(word) <= 40:
            out.add(word + END)
            stems.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
    out.update(stems)
    out.update(PAIR + s for s, n in stems.items() if n > 1)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(patterns(text or ""))
        if len(seen) > 2_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])
            seen.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's five-word runs: near copies mostly agree in it. Texts of fewer words stand for themselves."""
    for batch in batches:
        for chunk in T.chunks(batch.column(0)):
            w = T.words(chunk, T.SPACE, lower=True)
            runs, whole = T.windows(w, 5)
            least = np.full(len(chunk.offsets) - 1, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, w.doc[: len(runs)][whole], runs[whole])
            for i in np.flatnonzero(np.diff(w.per_doc) < 5):
                least[i] = T.span_hash(w, w.per_doc[i], w.per_doc[i + 1])
            part = batch.slice(chunk.first, chunk.last - chunk.first)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least.view(np.int64))], names=["text", "_y", "_g"])


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least_weight: float = LEAST_WEIGHT, tests: int | None = None) -> dict[str, float]:
    """Weights (log odds of holding the pattern) of the patterns worth matching; tests is how many were looked at in all."""
    weight = {p: float(np.log((t + 0.5) / (n_toxic + 1)) - np.log((clean.get(p, 0) + 0.5) / (n_clean + 1))) for p, t in toxic.items()}
    error = {p: float(np.sqrt(1 / (t + 0.5) + 1 / (clean.get(p, 0) + 0.5))) for p, t in toxic.items()}
    proof = np.log((tests or len(toxic)) / CHANCE) if toxic else 0.0
    longer = Counter()
    for p, t in toxic.items():
        shorter = p[:-1]
        longer[shorter] = max(longer[shorter], t)
    kept: dict[str, float] = {}
    for p in sorted(toxic, key=lambda p: (not p.startswith(PAIR), len(p), p)):
        if weight[p] - error[p] < least_weight or longer[p] >= 0.9 * toxic[p] or evidence(toxic[p], clean.get(p, 0), n_toxic, n_clean) < proof:
            continue
        if any(max(kept.get(p[:k], -1.0), kept.get(PAIR + p[:k], -1.0)) >= weight[p] - 0.7 for k in range(SHORTEST, len(p))):
            continue
        kept[p] = weight[p]
    return kept


def evidence(t: int, c: int, n_toxic: int, n_clean: int) -> float:
    """Minus the logarithm of a bound on the chance that t or more of t + c texts are toxic if the pattern says nothing."""
    n, share = t + c, n_toxic / (n_toxic + n_clean)
    return 0.0 if t <= n * share else float(t * np.log(t / (n * share)) + (c * np.log(c / (n * (1 - share))) if c else 0.0))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (y - p) - 1e-2 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1]), float(b[2])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """Fit weights and curve on the given labelled rows; the bounds name how many of each class are used.

    Rows with a null id, a null label or no document teach nothing; where labels of one id disagree, toxic counts.
    Rows that share an id all teach. Without a toxic and a clean row the built-in lexicon and curve are returned.
    """
    ship(docs.sparkSession)
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = None
    for y, most in ((1, most_toxic), (0, most_clean)):
        part = labels.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        sample = part if sample is None else sample.union(part)
    # the sample has at most the two bounds' rows of 16 bytes; their texts are written, so docs are read once
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_id").select("text", "_y")
    rows = written(rows.mapInArrow(_groups, "text string, _y int, _g long").groupBy("_g", "_y").agg(F.min("text").alias("text")).select("text", "_y"), "labelled")
    n = dict(rows.groupBy("_y").count().collect())
    model = Model()
    if not n.get(0) or not n.get(1):
        return model
    # a pattern's counts in both classes, those cut that choose() would refuse for their weight: what is collected grows with the evidence, not the texts
    counts = written(rows.filter("_y = 1").select("text").mapInArrow(_count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("t")).filter(F.col("t") >= LEAST), "toxic")
    clean = rows.filter("_y = 0").select("text").mapInArrow(_count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("c"))
    both = counts.join(clean, "pattern", "left").select("pattern", "t", F.coalesce("c", F.lit(0)).alias("c"))
    weight = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    tests, share, held = counts.count(), n[1] / (n[0] + n[1]), F.col("t") + F.col("c")
    proof = F.col("t") * F.log(F.col("t") / (held * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (held * (1 - share)))).otherwise(0.0)
    both = written(both.withColumn("fits", (weight - error >= LEAST_WEIGHT - 1e-9) & (proof >= float(np.log(max(tests, 1) / CHANCE)) - 1e-9)), "counted")
    # choose() also asks how many texts hold a pattern's longest extension; only one that fits itself needs it
    longest = both.groupBy(F.expr("left(pattern, length(pattern) - 1)").alias("of")).agg(F.max("t").alias("longer"))
    found = both.filter("fits").join(longest, F.col("pattern") == F.col("of"), "left").filter("longer is null or longer < 0.9D * t").select("pattern", "t", "c").collect()
    toxic, clean = {r.pattern: r.t for r in found}, {r.pattern: r.c for r in found}
    model.weights |= choose(toxic, clean, n[1], n[0], tests=tests)
    points = rows.select("text", "_y").mapInArrow(_measure(model), "y int, a double, b double").collect()  # three numbers a sampled row
    model.curve = _logistic(np.array([(p.a, p.b) for p in points]), np.array([p.y for p in points], float))
    return model


def _measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            found = [measures(matcher.total(fold(t or "")), len(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64())], names=["y", "a", "b"])

    return run


def _score(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, (c, wa, wb) = Matcher(model), model.curve
        for batch in batches:
            totals = [(matcher.total(fold(t)), len(t)) if t else (0.0, 0) for t in batch.column(1).to_pylist()]
            x = np.array([measures(*t) for t in totals], float).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(c + x @ np.array([wa, wb]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in totals], pa.float64()), pa.array(score)], names=names)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, weight (sum of matched weights) and score (0 to 1). Null texts count as empty; other
    columns are ignored."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return docs.mapInArrow(_score(model, [id_col, "weight", "score"]), f"`{id_col}` {docs.schema[0].dataType.simpleString()}, weight double, score double")


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text modulo folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def reject_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores below the threshold; columns as given, whatever their names. Each row is judged
    by its text alone, so repeated rows and null ids stay or go with it; null and empty texts stay."""
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, (c, wa, wb) = Matcher(model), model.curve
        at = names.index(text_col)
        for batch in batches:
            keep = []
            for t in batch.column(at).to_pylist():
                a, b = measures(matcher.total(fold(str(t))), len(t)) if t else (0.0, 0.0)
                keep.append(1 / (1 + np.exp(-min(max(c + wa * a + wb * b, -30), 30))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
