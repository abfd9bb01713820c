"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted in cells of source, language and topic. A category without a target falls into OTHER,
so the number of cells is bounded by the targets and not by the data. Raking scales the cells, none beyond
probability 1, until their marginals meet the targets; a document's probability is its cell's. Topics are told
by plain rules on the text (see ``topic``), not learnt.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"
AXES = ("source", "lang", "topic")
NEW = ("mix_tokens", "mix_cell", "mix_probability", "mix_sampled")
#: Topics by the first rule that holds; fixed values.
TOPICS = ("licence", "numbers", "list", "note", "essay", "prose")


@dataclass(frozen=True)
class Targets:
    """Shares of tokens by category; they are scaled to 1 over the categories that occur. keep: share of tokens to sample."""

    source: dict[str, float] = field(default_factory=lambda: {f"src{i}": 2.0 if i == 0 else 1.0 for i in range(20)} | {OTHER: 1.0})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.12, OTHER: 0.02})
    topic: dict[str, float] = field(default_factory=lambda: {"licence": 0.05, "numbers": 0.1, "list": 0.15, "note": 0.1, "essay": 0.3, "prose": 0.3})
    keep: float = 0.5
    seed: int = 17

    def axis(self, name: str) -> dict[str, float]:
        return getattr(self, name)


def count(text: Column, character: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(character), F.lit("")))


def words(text: Column) -> Column:
    """Weight of a text: pieces between blanks and line feeds, 1 at least."""
    text = F.coalesce(text, F.lit(""))
    return (count(text, " ") + count(text, "\n") + 1).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """One of TOPICS, from what the whole text shows."""
    text = F.coalesce(text, F.lit(""))
    lines = count(text, "\n") + 1
    digits = F.regexp_count(text, F.lit("[0-9]"))
    return (
        F.when(F.contains(text, F.lit("icense")) & (tokens < 400), "licence")
        .when(digits * 25 > F.octet_length(text), "numbers")
        .when(lines * 12 > tokens, "list")
        .when(tokens < 150, "note")
        .when(tokens > 800, "essay")
        .otherwise("prose")
    )


def reachable(goal: np.ndarray, available: np.ndarray, total: float) -> np.ndarray:
    """Tokens of each category: total in the goal's proportions, no more than there are; what one lacks the others share."""
    out, fixed = np.zeros(len(goal)), available <= 0
    for _ in range(len(goal)):
        free = goal * ~fixed
        if not free.sum():
            break
        out = np.where(fixed, np.minimum(available, out), free / free.sum() * max(0.0, total - out[fixed].sum()))
        over = ~fixed & (out >= available)
        if not over.any():
            break
        out, fixed = np.where(over, available, out), fixed | over
    return np.minimum(out, available)


def factor(tokens: np.ndarray, chance: np.ndarray, goal: float) -> float:
    """The number by which chances rise or fall so that the expected tokens are goal, where no chance goes beyond 1."""
    own = (tokens > 0) & (chance > 0)
    if not own.any():
        return 1.0
    tokens, chance = tokens[own], chance[own]
    order = np.argsort(-chance)
    tokens, chance = tokens[order], chance[order]
    # with the first k at 1, the others make up the rest
    held = np.concatenate([[0.0], np.cumsum(tokens)])[:-1]
    free = np.cumsum((tokens * chance)[::-1])[::-1]
    for k in range(len(tokens)):
        scale = (goal - held[k]) / free[k]
        if scale * chance[k] <= 1:
            return max(scale, 0.0)
    return 1 / chance[-1]


@dataclass(frozen=True)
class Calibration:
    """chance: probability of each cell; goals and achieved: expected tokens by axis; targets: those asked for, before what there is bounds them."""

    chance: np.ndarray
    targets: list[np.ndarray]
    goals: list[np.ndarray]
    achieved: list[np.ndarray]


def rake(tokens: np.ndarray, targets: list[np.ndarray], keep: float, tolerance: float = 1e-9, most: int = 500) -> Calibration:
    """Bounded raking: probabilities of the cells whose expected tokens meet the targets along each axis and keep in all.

    A cell's chance is the product of one multiplier for each of its categories, 1 at most. Each step sets a category's
    multiplier so that its expected tokens are its goal, with cells that reach 1 held there and the others scaled. A category
    without tokens has no goal; one with too few gets all of them, and the others of its axis share the rest in their proportions.
    """
    axes = range(tokens.ndim)
    others = [tuple(i for i in axes if i != axis) for axis in axes]
    total = keep * tokens.sum()
    wanted = [g / max(g[tokens.sum(o) > 0].sum(), 1e-300) * total for g, o in zip(targets, others, strict=True)]
    goals = [reachable(g, tokens.sum(o), total) for g, o in zip(targets, others, strict=True)]
    multiplier = [np.ones(n) for n in tokens.shape]

    def chances() -> np.ndarray:
        out = np.full(tokens.shape, float(keep))
        for axis in axes:
            out = out * multiplier[axis].reshape([-1 if i == axis else 1 for i in axes])
        return out

    best, worst, since = chances(), np.inf, 0
    for _ in range(most if total else 0):
        for axis in axes:
            now = np.moveaxis(chances(), axis, 0)
            own = np.moveaxis(tokens, axis, 0)
            multiplier[axis] = np.clip(multiplier[axis] * [factor(t.ravel(), c.ravel(), g) for t, c, g in zip(own, now, goals[axis], strict=True)], 1e-12, 1e12)
        sums = np.minimum(1, chances()) * tokens
        off = max(float(np.abs(sums.sum(o) - g).max()) for o, g in zip(others, goals, strict=True)) / total
        since = 0 if off < 0.999 * worst else since + 1
        if off < worst:
            best, worst = chances(), off
        if worst < tolerance or since > 30:  # goals that exclude one another are met as far as they go, and in sum
            break
    chance = np.minimum(1, best * factor(tokens.ravel(), best.ravel(), total))
    return Calibration(chance, wanted, goals, [(chance * tokens).sum(o) for o in others])


def category(targets: Targets, axis: str) -> Column:
    value = topic(F.col("text"), F.col("mix_tokens")) if axis == "topic" else F.col(axis).cast("string")
    return F.when(value.isin(list(targets.axis(axis))), value).otherwise(OTHER)


def counted(rows: DataFrame, targets: Targets) -> tuple[list[list[str]], np.ndarray]:
    """Labels of each axis, and the tokens of every cell. rows: mix_cell, mix_tokens."""
    labels = [list(dict.fromkeys([*targets.axis(a), OTHER])) for a in AXES]
    counts = np.zeros([len(x) for x in labels])
    # no more rows than cells: the product of the targets' lengths
    for name, n in rows.groupBy("mix_cell").agg(F.sum("mix_tokens")).collect():
        counts[tuple(x.index(part) for x, part in zip(labels, name.split("/"), strict=True))] = n
    return labels, counts


def calibrate(rows: DataFrame, targets: Targets) -> tuple[list[list[str]], np.ndarray, Calibration]:
    labels, counts = counted(rows, targets)
    goals = [np.array([targets.axis(a).get(x, 0.0) for x in own]) for a, own in zip(AXES, labels, strict=True)]
    return labels, counts, rake(counts, goals, targets.keep)


def celled(docs: DataFrame, targets: Targets) -> DataFrame:
    names = [c for c in docs.columns if c not in NEW]
    rows = docs.select(*names, words(F.col("text")).alias("mix_tokens"))
    return rows.withColumn("mix_cell", F.concat_ws("/", *[category(targets, a) for a in AXES]))


def marginals(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """axis, category, target, reachable, expected and available: shares of the sampled tokens that were asked for, that there
    are tokens for, and that ``mixed`` gives in expectation; and the share of all tokens. One row for each category."""
    labels, counts, found = calibrate(celled(docs, targets), targets)
    total, kept = max(counts.sum(), 1.0), max(targets.keep * counts.sum(), 1e-300)
    rows = []
    for i, (axis, names) in enumerate(zip(AXES, labels, strict=True)):
        own = counts.sum(tuple(j for j in range(counts.ndim) if j != i))
        got = max(found.achieved[i].sum(), 1e-300)
        rows += [(axis, n, float(found.targets[i][j] / kept), float(found.goals[i][j] / kept), float(found.achieved[i][j] / got), float(own[j] / total)) for j, n in enumerate(names)]
    return docs.sparkSession.createDataFrame(rows, "axis string, category string, target double, reachable double, expected double, available double")


def mixed(docs: DataFrame, targets: Targets = Targets(), strict: bool = False) -> DataFrame:
    """docs with mix_tokens, mix_cell, mix_probability and mix_sampled behind their columns.

    mix_cell is 'source/lang/topic' after OTHER; a document is sampled if a uniform number made of its doc_id, the
    text's hash and the seed is below its probability, so any run gives the same sample and copies of a row
    share their fate. A null source or lang counts as OTHER, a null text as empty with weight 1. An empty table gives no rows.
    Columns with the names of the four new ones are replaced; others stay. Targets that the rows have too few tokens for are
    met as far as they go; ``marginals`` reports them, and with strict=True a miss of over a hundredth raises ValueError.
    """
    rows = celled(docs, targets)
    labels, counts, found = calibrate(rows, targets)
    if strict and (off := max(float(np.abs(a - t).max()) for a, t in zip(found.achieved, found.targets, strict=True))) > 0.01 * targets.keep * counts.sum():
        raise ValueError(f"targets are missed by up to {off:.0f} tokens")
    table = [("/".join(own[i] for own, i in zip(labels, at, strict=True)), float(found.chance[tuple(at)])) for at in np.argwhere(counts > 0).tolist()]
    look_up = F.create_map(*[F.lit(x) for pair in table for x in pair]) if table else F.create_map(F.lit(""), F.lit(0.0))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(targets.seed), F.col("doc_id").cast("long"), F.xxhash64("text")), 11) / F.lit(float(2**53))
    out = rows.withColumn("mix_probability", F.coalesce(F.get(F.map_values(look_up), F.array_position(F.map_keys(look_up), F.col("mix_cell")).cast("int") - 1), F.lit(0.0)))
    return out.withColumn("mix_sampled", uniform < F.col("mix_probability"))
