"""Mixing sources to target weights by iterative proportional fitting.

Token weights are raked to marginals of source, language and topic: one pass of the corpus adds up tokens per cell
(source, language, topic), then the cells' weights are scaled to one marginal after the other until all hold. Documents
are sampled by their cell's calibrated probability, decided by a hash of the document's id, so the choice is the same in
every run and in every task.

A target is a share, or bounds (low, high) of one: bounds are raked to the share in them that is nearest in proportion to
the corpus's own. How far the weighted shares are from their targets in the end is the residual, which every result
carries; targets that the cells cannot meet leave one, and a warning.

Values without a target share one target "other" in their dimension, so there are at most the product of the targets'
numbers of cells, whatever the corpus: that bound is checked, and is what makes the cells small enough for the driver and
for a broadcast.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.llm.shared import documents, free, quoted, stored

OTHER = "other"
MAX_CELLS, SWEEPS, TOLERANCE, SEED = 100_000, 1_000, 1e-9, 7
DIMENSIONS = ["source", "lang", "topic"]

Targets = dict[str, dict[str, float | tuple[float, float]]]

#: The target shares of tokens. What is not named falls under ``other``.
TARGETS: Targets = {
    "source": {"src0": 0.25, OTHER: 0.75},
    "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.12, OTHER: 0.02},
    "topic": {"prose": 0.87, "table": 0.06, "legal": 0.04, "contact": 0.03},
}
#: What marks a topic, and how often in a thousand characters at least.
TOPICS = {"table": ([" | "], 5.0), "legal": (["icensed under", "opyright", "ublic License"], 0.2), "contact": (["@"], 0.5)}
PLAIN_TOPIC = "prose"


def topic_of(text: Column) -> Column:
    """The topic whose marks the whole text has most often for what that topic needs (ties: the first); prose where it has
    none often enough."""
    count = lambda mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / F.lit(len(mark))
    dense = lambda t: sum((count(m) for m in TOPICS[t][0]), F.lit(0.0)) * F.lit(1000.0) / F.greatest(F.length(text), F.lit(1)) / F.lit(TOPICS[t][1])
    most = F.array_max(F.array(*[F.struct(dense(t).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("topic")) for i, t in enumerate(TOPICS)]))
    return F.when(most["n"] >= 1, most["topic"]).otherwise(PLAIN_TOPIC)


def tokens_of(text: Column) -> Column:
    """What weights are in: words as parted by single blanks, counted as blanks plus one."""
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def cell_of(targets: Targets) -> dict[str, Column]:
    """The cell's value in each dimension (``other`` for null and what has no target)."""
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.coalesce(F.col("text"), F.lit("")))}
    return {d: F.when(values[d].isin([v for v in targets[d] if v != OTHER]), values[d]).otherwise(OTHER) for d in DIMENSIONS}


def with_cells(docs: DataFrame, targets: Targets = TARGETS) -> DataFrame:
    """doc_id, tokens and the cell of each row."""
    return docs.select("doc_id", tokens_of(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"), *[c.alias(d) for d, c in cell_of(targets).items()])


def goal_shares(shares: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The shares to rake to: between low and high, in proportion to ``shares`` where the bounds let them, adding up to 1.
    Values that do not occur have none; what they were to have is dealt to the others in proportion."""
    there = shares > 0
    low, high = np.where(there, low, 0), np.where(there, high, 0)
    if not high.sum():
        return np.where(there, shares, 0)
    if not (low.sum() < 1 < high.sum()):
        bound = low if low.sum() >= 1 else high
        return bound / bound.sum()
    least, most = 0.0, 1.0
    while np.clip(most * shares, low, high).sum() < 1:
        most *= 2
    for _ in range(200):
        middle = (least + most) / 2
        least, most = (middle, most) if np.clip(middle * shares, low, high).sum() < 1 else (least, middle)
    return np.clip(most * shares, low, high)


def rake(cells: np.ndarray, totals: np.ndarray, goals: list[np.ndarray], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights of cells, so that weighted totals have the goal shares in each dimension, and the largest difference of a
    share from its goal that is left. cells: each cell's value number per dimension. Sweeps until ``tolerance`` is met."""
    whole, weights, residual = totals.sum(), np.ones(len(totals)), np.inf
    share_of = lambda d, w: np.bincount(cells[:, d], weights=totals * w, minlength=len(goals[d])) / whole
    for _ in range(sweeps):
        for d, goal in enumerate(goals):
            now = share_of(d, weights)
            weights = weights * np.divide(goal, now, out=np.ones(len(goal)), where=now > 0)[cells[:, d]]
        residual = max(float(np.abs(share_of(d, weights) - goal).max()) for d, goal in enumerate(goals))
        if residual <= tolerance:
            break
    return weights, residual


CELLS = "source string, lang string, topic string, cell_tokens long, weight double, probability double, residual double"


def calibrated(rows: DataFrame, targets: Targets = TARGETS, keep: float | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """One row per cell of ``rows`` (of ``with_cells``): its dimensions, tokens, weight, the probability of its documents,
    and the residual that all cells share.

    Probabilities are in proportion to the weights. keep: the share of tokens to keep; None: as many as the targets
    allow, so that the highest probability is 1. A larger ``keep`` caps probabilities at 1 and deals the rest to the
    other cells, as far as they go, so targets are neared and not met.
    """
    if math.prod(len(set(t) | {OTHER}) for t in targets.values()) > MAX_CELLS:
        raise ValueError(f"the targets make more than {MAX_CELLS} cells")
    spark = rows.sparkSession
    found = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).orderBy(*DIMENSIONS).collect()
    if not found:
        return spark.createDataFrame([], CELLS)
    values = [sorted(set(targets[d]) | {OTHER}) for d in DIMENSIONS]
    cells = np.array([[v.index(r[d]) for v, d in zip(values, DIMENSIONS, strict=True)] for r in found])
    totals = np.array([r.tokens for r in found], dtype=float)
    goals = []
    for i, (vs, d) in enumerate(zip(values, DIMENSIONS, strict=True)):
        bounds = np.array([t if isinstance(t := targets[d].get(v, 0.0), tuple) else (t, t) for v in vs], dtype=float)
        goals.append(goal_shares(np.bincount(cells[:, i], weights=totals, minlength=len(vs)) / totals.sum(), *bounds.T))
    weights, residual = rake(cells, totals, goals, sweeps)
    if residual > 1e-6:
        warnings.warn(f"the targets are missed by up to {residual:.2g}: these cells cannot meet them", stacklevel=2)
    scale = 1 / weights.max()
    chance = weights * scale
    if keep is not None:
        want = min(1.0, keep) * totals.sum()
        for _ in range(100):
            chance = np.minimum(1.0, weights * scale)
            if (chance * totals).sum() >= want * (1 - 1e-9) or chance.min() >= 1:
                break
            open_cells = chance < 1
            scale *= (want - totals[~open_cells].sum()) / max((chance * totals)[open_cells].sum(), 1e-300)
        chance = np.minimum(chance, chance * want / (chance * totals).sum()) if (chance * totals).sum() > want else chance
    return spark.createDataFrame([(*(r[d] for d in DIMENSIONS), int(r.tokens), float(w), float(p), residual) for r, w, p in zip(found, weights, chance, strict=True)], CELLS)


def reached(docs: DataFrame, targets: Targets = TARGETS, keep: float | None = None) -> list[tuple[str, str, float | tuple[float, float], float, float]]:
    """(dimension, value, target, share of tokens in ``docs``, expected share in the sample) of each value with a target."""
    cells = calibrated(with_cells(docs, targets), targets, keep).collect()
    out = []
    for d in DIMENSIONS:
        for value, target in targets[d].items():
            parts = [[c.cell_tokens * p for c, p in zip(cells, chance, strict=True) if c[d] == value] for chance in ([1] * len(cells), [c.probability for c in cells])]
            wholes = [sum(c.cell_tokens for c in cells), sum(c.cell_tokens * c.probability for c in cells)]
            out.append((d, value, target, *(sum(x) / max(w, 1) for x, w in zip(parts, wholes, strict=True))))
    return out


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 (less than 1), evenly spread over ids; the same for the same id and seed."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def mix(docs: DataFrame, targets: Targets = TARGETS, keep: float | None = None, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic (cells: ``other`` for what has no target), tokens,
    weight, probability, sampled, residual. Texts are read once.

    Null values fall under ``other``, null texts have one token; null ids are one id. Repeated rows are drawn together.
    A cell that no target wants (share 0) has weight 0. An empty table gives no rows. Long texts are taken whole. Extra
    columns are left out.
    """
    rows = stored(with_cells(docs, targets), "cells")
    cells = calibrated(rows, targets, keep)
    out = rows.join(F.broadcast(cells), DIMENSIONS)  # at most MAX_CELLS rows
    return out.select("doc_id", *DIMENSIONS, "tokens", "weight", "probability", (draw(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"), "residual")


def sampled_rows(docs: DataFrame, targets: Targets = TARGETS, keep: float | None = None, seed: int = SEED) -> DataFrame:
    """The sampled rows of ``docs``, with the columns they have, whatever those are called; narrow but for the pass that
    adds up cells."""
    names = free(docs.columns, *DIMENSIONS)
    chance, = free([*docs.columns, *names], "probability")
    cells = calibrated(with_cells(docs, targets), targets, keep)
    cells = F.broadcast(cells.select(*(F.col(d).alias(n) for d, n in zip(DIMENSIONS, names, strict=True)), F.col("probability").alias(chance)))
    out = docs.withColumns(dict(zip(names, cell_of(targets).values(), strict=True))).join(cells, names)
    return out.where(draw(F.col("doc_id"), seed) < F.col(chance)).select(*quoted(docs.columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).drop("residual")
    return out.withColumns({"weight": F.round("weight", 6), "probability": F.round("probability", 6)})


SQL_SWEEPS = 30


def _sql() -> str:
    """The same in SQL: cells, sweeps one after the other (as many as converge), and the draw."""
    def case(d: str, value: str) -> str:
        return f"CASE WHEN {value} IN ({', '.join(repr(v) for v in targets[d] if v != OTHER)}) THEN {value} ELSE '{OTHER}' END AS {d}"

    targets = TARGETS
    counts = {t: " + ".join(f"(length(t) - length(replace(t, '{m}', ''))) / {len(m)}.0::DOUBLE" for m in marks) for t, (marks, _) in TOPICS.items()}
    dense = ", ".join(f"(0.0::DOUBLE + {counts[t]}) * 1000.0::DOUBLE / greatest(length(t), 1) / {n}::DOUBLE" for t, (_, n) in TOPICS.items())
    topic = f"CASE WHEN list_max(m) >= 1 THEN ['{"', '".join(TOPICS)}'][list_position(m, list_max(m))] ELSE '{PLAIN_TOPIC}' END"
    parts = [
        "told AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)",
        f"marks AS (SELECT *, [{dense}] AS m FROM told)",
        f"topics AS (SELECT *, {topic} AS form FROM marks)",
        f"docs AS (SELECT doc_id, length(t) - length(replace(t, ' ', '')) + 1 AS tokens, {case('source', 'source')}, {case('lang', 'lang')}, {case('topic', 'form')} FROM topics)",
        "c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, 1.0::DOUBLE AS w FROM docs GROUP BY ALL)",
        *(f"goal_{d}({d}, share) AS (VALUES {', '.join(f'({v!r}, {s}::DOUBLE)' for v, s in targets[d].items())})" for d in DIMENSIONS),
        *(f"there_{d} AS (SELECT {d}, share / sum(share) OVER () AS share FROM goal_{d} WHERE {d} IN (SELECT {d} FROM c0))" for d in DIMENSIONS),
    ]
    n = 0
    for _ in range(SQL_SWEEPS):
        for d in DIMENSIONS:
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.w * coalesce(g.share, 0) * (SELECT sum(tokens) FROM c0) / sum(c.tokens * c.w) OVER (PARTITION BY c.{d}) AS w FROM c{n} c LEFT JOIN there_{d} g USING ({d}))"
            )
            n += 1
    draw_sql = f"('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT / {float(16**13)}"
    return f"""WITH {", ".join(parts)}
SELECT doc_id, source, lang, topic, docs.tokens, round(w, 6) AS weight, round(w / m, 6) AS probability, {draw_sql} < w / m AS sampled
FROM docs JOIN (SELECT source, lang, topic, w, max(w) OVER () AS m FROM c{n}) USING (source, lang, topic)"""


SQL = _sql()
