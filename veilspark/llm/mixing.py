"""Mixing to target weights by iterative proportional fitting.

Tokens are added up by cell (source, language, topic). Raking multiplies cell weights until every margin meets its
target share; from there they are raked under the bound that no probability exceeds 1, to the largest budget of
tokens, at most the one asked for, at which the kept tokens meet the margins too. The margins come before the budget:
a group that should gain can't keep more than all it has, so the others are thinned until the shares are right. A
document stays if a hash of its id falls below its cell's probability.

The cell table is what the raking works on, not the documents. Up to MOST_CELLS cells and KEY_BYTES of keys, as counted,
it is raked in one place; above, targets and shares stay distributed too, each step is a grouped sum joined back, and
the driver gets a few totals a step. The cells' probabilities are broadcast under the same kind of bound, or meet the documents by
a join in which no task gets all rows of a large cell.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import topics
from veilspark.llm._spark import BROADCAST_ROWS, ship, spread_join, unused, written

#: Cells that may be raked in the driver: text keys and a number each.
MOST_CELLS = 100_000
#: Bytes of cells' keys that may be collected or broadcast.
KEY_BYTES = 32 << 20
SWEEPS, CLOSE = 50, 1e-9
#: Raking under the bound: sweeps, the error of a share that counts as met, and how often a budget out of reach is halved towards one within.
CAPPED_SWEEPS, NEAR, HALVINGS = 100, 1e-6, 6


def tokens_of(text: Column) -> Column:
    """White-space words; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0b\\f\\r]+")), F.lit(0)).cast("long")


def tempered(shares: dict, power: float = 0.7) -> dict:
    """Target shares that give small groups more than their own share."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def coded(cells: list[tuple], tokens: np.ndarray, targets: list[dict]) -> list[tuple]:
    """For each margin, the number of each cell's key (-1 for one without tokens) and the wanted share of each key."""
    codes = []
    for i, target in enumerate(targets):
        keys = sorted({c[i] for c, t in zip(cells, tokens, strict=True) if t > 0}, key=str)
        at = {k: j for j, k in enumerate(keys)}
        want = np.array([target.get(k, 0.0) for k in keys])
        codes.append((np.array([at.get(c[i], -1) for c in cells], int), want / want.sum() if want.sum() else np.full(len(keys), 1 / max(len(keys), 1))))
    return codes


def rake(tokens: np.ndarray, codes: list[tuple], sweeps: int = SWEEPS, close: float = CLOSE) -> np.ndarray:
    """A factor for each cell, so that the shares of tokens * factor meet the targets.

    Keys without a target keep no tokens; targets of absent keys are spread over the others in proportion.
    """
    factor = np.ones(len(tokens))
    for _ in range(sweeps):
        off = 0.0
        for code, want in codes:
            use = code >= 0
            mass = np.bincount(code[use], weights=(tokens * factor)[use], minlength=len(want))
            total = mass.sum()
            if total <= 0:
                return factor
            ratio = np.where(mass > 0, want * total / np.where(mass > 0, mass, 1), 1.0)
            off = max(off, float(np.abs(np.where(mass > 0, ratio - 1, 0)).max(initial=0)))
            factor[use] *= ratio[code[use]]
        if off < close:
            break
    return factor


def most_kept(tokens: np.ndarray, codes: list[tuple]) -> float:
    """The largest budget at which no key must keep more tokens than its own."""
    most = np.inf
    for code, want in codes:
        own = np.bincount(code[code >= 0], weights=tokens[code >= 0], minlength=len(want))
        some = (own > 0) & (want > 0)
        most = min(most, float((own[some] / want[some]).min(initial=np.inf)))
    return most


def capped(tokens: np.ndarray, chance: np.ndarray, codes: list[tuple], budget: float, sweeps: int = CAPPED_SWEEPS) -> tuple[np.ndarray, float]:
    """Probabilities of 1 at most whose expected tokens meet every margin of the budget, and the largest error of a share.

    Raking under the bound: a key that keeps too much is scaled down whole; in one that keeps too little, what is
    below 1 is scaled up and cut at 1.
    """
    chance, off = np.minimum(1.0, chance), 0.0
    for _ in range(sweeps):
        off = 0.0
        for code, want in codes:
            use, goal = code >= 0, want * budget
            add = lambda w: np.bincount(code[use], weights=w[use], minlength=len(want))  # noqa: E731, B023
            whole, rest = add(tokens * (chance >= 1)), add(tokens * chance * (chance < 1))
            off = max(off, float(np.abs(whole + rest - goal).max(initial=0)) / budget)
            less = whole + rest >= goal
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(less, goal / (whole + rest), np.where(rest > 0, (goal - whole) / rest, 1.0))
            ratio = np.where(whole + rest > 0, ratio, 1.0)
            scaled = use & (less[code] | (chance < 1))
            chance[scaled] = np.minimum(1.0, chance[scaled] * ratio[code[scaled]])
        if off < CLOSE:
            break
    return chance, off


def within(start: float, most: float, safe: float, attempt: Callable[[float], tuple[Any, float]], fallback: Callable[[], Any]) -> Any:
    """The attempt of the largest budget found whose margins come out within NEAR; safe is one that is known to."""
    best, low, high = None, safe, min(start, most)
    for i in range(HALVINGS + 1):
        budget = high if i == 0 else (low + high) / 2
        if budget <= safe:
            break
        found, off = attempt(budget)
        if off <= NEAR:
            best, low = found, budget
            if i == 0:
                break
        else:
            high = budget
    return fallback() if best is None else best


def _wanted(cells: DataFrame, margin: str, target: dict | None, power: float) -> DataFrame:
    """For each key with tokens: _m, own (its tokens) and want (its share of the target, which add up to 1)."""
    own = cells.filter("tokens > 0").groupBy(F.col(margin).alias("_m")).agg(F.sum("tokens").alias("own"))
    if target is None:
        raw = own.withColumn("raw", F.pow(F.col("own").cast("double"), power))
    else:
        given = cells.sparkSession.createDataFrame([(None if k is None else str(k), float(v)) for k, v in target.items()], "_k string, raw double")
        raw = own.join(given, F.col("_m").eqNullSafe(F.col("_k")), "left").select("_m", "own", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    raw = written(raw, "raw")
    total, keys = raw.agg(F.sum("raw"), F.count(F.lit(1))).first()
    return written(raw.select("_m", "own", (F.col("raw") / total if total else F.lit(1.0) / max(keys, 1)).alias("want")), "wants")


def _rake_wide(cells: DataFrame, margins: list[str], wants: list[DataFrame], sweeps: int) -> DataFrame:
    """rake() by grouped sums, for cell tables of any size; wants have key and want."""
    cells = cells.withColumn("factor", F.lit(1.0))
    for _ in range(sweeps):
        off = []
        for m, want in zip(margins, wants, strict=True):
            mass = cells.groupBy(F.col(m).alias("_k")).agg(F.sum(F.col("tokens") * F.col("factor")).alias("mass")).filter("mass > 0")
            known = written(mass.join(want, F.col("_k").eqNullSafe(F.col("_m"))).select("_m", "mass", "want"), "mass")
            total = known.agg(F.sum("mass")).first()[0]
            if not total:
                return cells
            ratio = known.select("_m", (F.col("want") * total / F.col("mass")).alias("ratio"))
            off.append(ratio.agg(F.max(F.abs(F.col("ratio") - 1))).first()[0])
            cells = cells.join(ratio, F.col(m).eqNullSafe(F.col("_m")), "left").withColumn("factor", F.col("factor") * F.coalesce("ratio", F.lit(1.0))).drop("_m", "ratio")
        cells = written(cells, "cells")
        if max(off) < CLOSE:
            break
    return cells


def _capped_wide(cells: DataFrame, margins: list[str], wants: list[DataFrame], budget: float, sweeps: int = CAPPED_SWEEPS) -> tuple[DataFrame, float]:
    """capped() by grouped sums, on cells with a column chance; wants have key, want and own."""
    cells, off = cells.withColumn("chance", F.least(F.lit(1.0), "chance")), 0.0
    for _ in range(sweeps):
        off = 0.0
        for m, want in zip(margins, wants, strict=True):
            mass = F.col("tokens") * F.col("chance")
            sums = cells.groupBy(F.col(m).alias("_k")).agg(F.sum(F.when(F.col("chance") >= 1, mass).otherwise(0.0)).alias("whole"), F.sum(F.when(F.col("chance") < 1, mass).otherwise(0.0)).alias("rest"))
            found = sums.join(want, F.col("_k").eqNullSafe(F.col("_m"))).select("_m", "whole", "rest", (F.col("want") * budget).alias("goal"))
            less = F.expr("whole + rest >= goal")
            ratio = written(found.select("_m", (F.abs(F.expr("whole + rest - goal")) / budget).alias("off"), less.alias("less"), F.expr("case when whole + rest <= 0 then 1.0D when whole + rest >= goal then goal / (whole + rest) when rest > 0 then (goal - whole) / rest else 1.0D end").alias("ratio")), "ratio")
            off = max(off, ratio.agg(F.max("off")).first()[0] or 0.0)
            scaled = F.when(F.col("less") | (F.col("chance") < 1), F.least(F.lit(1.0), F.col("chance") * F.col("ratio"))).otherwise(F.col("chance"))
            cells = cells.join(ratio, F.col(m).eqNullSafe(F.col("_m")), "left").withColumn("chance", F.coalesce(scaled, "chance")).drop("_m", "off", "less", "ratio")
        cells = written(cells, "chances")
        if off < CLOSE:
            break
    return cells, off


def mix(docs: DataFrame, margins: dict[str, Column], tokens: Column, targets: dict[str, dict] | None = None, *, keep: float = 0.9, power: float = 0.7, id_col: str = "doc_id", seed: int = 10, most_cells: int = MOST_CELLS) -> DataFrame:
    """docs with _tokens, the margins' keys (_ and their name), _weight (the cell's raked factor), _probability and _kept.

    margins name expressions over docs; a null key is a group of its own. targets give shares by margin and key; a
    margin without is tempered (shares to the power, scaled). keep is the most that is expected to stay of all tokens;
    less does where the margins can't be met otherwise. Rows of a cell without tokens weigh 1 and stay with probability
    keep. The draw hashes the id (a null id like any value), so repeated rows share their fate. An empty table gives an
    empty table. Where docs has a column of such a name already, the added one has another underscore before it (added()).
    """
    ship(docs.sparkSession)
    names = [unused(docs.columns, f"_m{i}") for i in range(len(margins))]
    out = added(docs.columns, list(margins))
    count = unused(docs.columns, "_count")
    marked = docs.select("*", F.coalesce(tokens, F.lit(0)).cast("long").alias(out["tokens"]), *[m.cast("string").alias(n) for m, n in zip(margins.values(), names, strict=True)])
    cells = written(marked.groupBy(*names).agg(F.sum(out["tokens"]).alias("tokens"), F.count(F.lit(1)).alias(count)), "cells")
    goals = [(targets or {}).get(m) for m in margins]
    number, size, rows_in_all = cells.agg(F.count(F.lit(1)), F.sum(sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in names), F.lit(24))), F.sum(count)).first()
    spark, small = cells.sparkSession, (size or 0) <= KEY_BYTES
    if number <= most_cells and small:
        rows = cells.collect()  # most_cells rows and KEY_BYTES at the most, as just counted
        keys, mass = [tuple(r[n] for n in names) for r in rows], np.array([r.tokens for r in rows], float)
        goals = [g if g is not None else tempered({k: mass[[c[i] == k for c in keys]].sum() / max(mass.sum(), 1) for k in {c[i] for c in keys}}, power) for i, g in enumerate(goals)]
        codes = coded(keys, mass, goals)
        factor = rake(mass, codes)
        weighed, largest = float((mass * factor).sum()), float(factor[mass > 0].max(initial=0))
        even = lambda budget: factor * budget / weighed if weighed else factor * 0.0
        start, safe = keep * mass.sum(), weighed / largest if largest else 0.0
        chance = within(start, most_kept(mass * (factor > 0), codes), safe, lambda budget: capped(mass, even(budget), codes, budget), lambda: even(min(start, safe)))
        chance = np.where(mass > 0, chance, keep)
        schema = ", ".join(f"`{n}` string" for n in names) + f", `{count}` long, _weight double, _probability double"
        table = spark.createDataFrame([(*k, r[count], float(f), float(p)) for k, r, f, p in zip(keys, rows, factor, chance, strict=True)], schema)
    else:
        total = cells.agg(F.sum("tokens")).first()[0]
        wants = [_wanted(cells, n, goal, power) for n, goal in zip(names, goals, strict=True)]
        raked = _rake_wide(cells, names, wants, SWEEPS)
        alive = raked.filter("tokens > 0 and factor > 0")
        weighed, largest = alive.agg(F.sum(F.col("tokens") * F.col("factor")), F.max("factor")).first()
        even = lambda budget: raked.withColumn("chance", F.col("factor") * (budget / weighed if weighed else 0.0))
        start, safe, most, reach = keep * (total or 0), weighed / largest if largest else 0.0, float("inf"), []
        for n, want in zip(names, wants, strict=True):
            own = raked.filter("tokens > 0").groupBy(F.col(n).alias("_k")).agg(F.sum(F.when(F.col("factor") > 0, F.col("tokens")).otherwise(0)).alias("own"))
            reach.append(written(own.join(want.select("_m", "want"), F.col("_k").eqNullSafe(F.col("_m"))).select("_m", "own", "want"), "reach"))
            most = min(most, reach[-1].filter("own > 0 and want > 0").agg(F.min(F.col("own") / F.col("want"))).first()[0] or most)
        chances = within(start, most, safe, lambda budget: _capped_wide(even(budget), names, reach, budget), lambda: even(min(start, safe)))
        table = chances.select(*names, count, F.col("factor").alias("_weight"), F.when(F.col("tokens") > 0, F.col("chance")).otherwise(keep).alias("_probability"))
        table = written(table, "probabilities")
    table = table.withColumnsRenamed({"_weight": out["weight"], "_probability": out["probability"]})
    if number <= BROADCAST_ROWS and small:
        same = reduce(lambda a, b: a & b, [marked[n].eqNullSafe(table[n]) for n in names])
        joined = marked.join(F.broadcast(table), same).select(*[marked[c] for c in marked.columns], out["weight"], out["probability"])
    else:
        joined = spread_join(marked, table, names, count, rows_in_all)
    draw = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    keys = [F.col(n).alias(out[m]) for m, n in zip(margins, names, strict=True)]
    return joined.select(*[f"`{c}`" for c in docs.columns], out["tokens"], *keys, out["weight"], out["probability"], (draw < F.col(out["probability"])).alias(out["kept"]))


def added(columns: list[str], margins: list[str]) -> dict[str, str]:
    """The names of the columns that mix() adds to these."""
    return {n: unused(columns, f"_{n}") for n in ("tokens", *margins, "weight", "probability", "kept")}


def mix_documents(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", model: topics.Topics | None = None, **options) -> DataFrame:
    """mix() over the source, lang and fitted topic (see topics) of documents, by tokens of text. A text without words has the topic empty."""
    model = model or topics.fit(docs, text_col, "lang", id_col)
    text = F.col(text_col).cast("string")
    return mix(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": topics.topic_column(model, text, F.col("lang"))}, tokens_of(text), id_col=id_col, **options)


def sample_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that mix_documents() keeps; columns as given, whatever their names."""
    kept = added(docs.columns, ["source", "lang", "topic"])["kept"]
    return mix_documents(docs, **options).filter(F.col(kept)).select(*[f"`{c}`" for c in docs.columns])
