"""p1: samples that match target category shares, by calibration and pivotal sampling.

Units are distinct ids. Cell moments (how many ids a cell holds) are aggregated distributedly. Per plan,
Newton iterations on the dual of exponential tilting give the cells' tilts: the dual holds the moments of
all cells, of both labels' margins and of the whole sample, and is solved with its full Hessian. Cells
that the tilt drives to probability one while they still lack rows are fixed there; what they lack is
their gap, and the rest is solved again. The ids are drawn with the resulting probabilities by the
pivotal method: block by block in parallel, each block leaving at most one undecided id a cell, and the
undecided ones of all blocks are settled in a second round. So every cell gets its whole number of ids
exactly. Plans are solved in tasks of their own and neither plans nor units come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import codepoints as C
from triagelake.store import stage

BLOCK_UNITS = 50_000


def calibrate(held: np.ndarray, wanted: np.ndarray, margins: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(inclusion probability, gap) of the cells of one plan.

    The probability of cell c is start * exp(x_c . lambda), at most one, where x_c has an entry for the
    cell itself, its margins (one row a cell) and the whole sample. Newton steps on the dual
    sum(held * start * exp(x . lambda)) - lambda . moments, with its full Hessian; steps are limited, as
    the quadratic model is poor far from the solution. Nothing is drawn from cells that want nothing.
    """
    n = len(held)
    x = np.hstack([np.eye(n), margins.reshape(n, -1), np.ones((n, 1))])
    goal = wanted.astype(float).copy()
    gap = np.zeros(n)
    start = min(1.0, max(goal.sum(), 1e-9) / max(1.0, held.sum()))
    lam = np.zeros(x.shape[1])
    used = goal > 0
    for _ in range(rounds):
        tilted = np.where(used, start * np.exp(np.minimum(x @ lam, 50)), 0.0)
        pinned = tilted >= 1 - 1e-12
        mass = held * np.minimum(1.0, tilted)
        lack = used & pinned & (goal > held + 1e-9)
        if lack.any():  # fixed at probability one: the rest is solved for what can be met
            gap[lack] = goal[lack] - held[lack]
            goal[lack] = held[lack]
        left = np.where(used, goal - mass, 0.0)
        if np.abs(left).max(initial=0) < 1e-10 * max(1.0, goal.max(initial=0)) and not lack.any():
            break
        # a cell without mass has no curvature: it moves by the step limit until it is pinned
        curve = np.where(used & (~pinned | (left < 0)), np.maximum(mass, 1e-6), 0.0)
        step = np.linalg.lstsq(x.T @ (curve[:, None] * x), x.T @ left, rcond=1e-13)[0]
        far = np.abs(x @ step).max(initial=0)
        lam += step * min(1.0, 2.0 / far) if far > 0 else 0.0
    prob = np.where(used & (held > 0), np.minimum(1.0, np.where(used, start * np.exp(np.minimum(x @ lam, 50)), 0.0)), 0.0)
    return prob, gap


def pivotal(prob: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Settled probabilities (0 or 1, at most one in between) by the pivotal method, as a tournament.

    In every round the undecided units meet in pairs, and each meeting decides one of the two or both,
    so the rounds are logarithmic in the units and each is a vector operation. The chances are mixed
    from the units' keys.
    """
    p = prob.astype(float).copy()
    p[p >= 1 - 1e-9], p[p <= 1e-9] = 1.0, 0.0
    live = np.flatnonzero((p > 0) & (p < 1))
    turn = 0
    while len(live) > 1:
        turn += 1
        m = len(live) // 2
        a, b = live[: 2 * m : 2], live[1 : 2 * m : 2]
        u = (C.mix(key[a] + C.mix(key[b] + np.uint64(turn))) >> np.uint64(11)).astype(np.float64) / 2**53
        x, y = p[a], p[b]
        s = x + y
        low = s <= 1
        first = np.where(low, u * s < x, u * (2 - s) < 1 - y)
        won, lost = np.where(low, s, 1.0), np.where(low, 0.0, s - 1)
        p[a], p[b] = np.where(first, won, lost), np.where(first, lost, won)
        p[p >= 1 - 1e-9], p[p <= 1e-9] = 1.0, 0.0
        live = live[(p[live] > 0) & (p[live] < 1)]
    return p


def _keys(ids: pa.Array, salt: int) -> np.ndarray:
    """Random keys from the ids: the draw is the same on every run and survives lost executors."""
    cp, offs = C.decode(ids)
    place = np.arange(len(cp)) - np.repeat(offs[:-1], np.diff(offs))
    part = C.mix((cp.astype(np.uint64) << np.uint64(20)) + place.astype(np.uint64))
    h = np.zeros(len(ids), np.uint64)
    full = np.diff(offs) > 0
    if full.any():
        h[full] = np.add.reduceat(part, offs[:-1][full])
    return C.mix(h + np.uint64(salt))


def plan_report(rows: DataFrame, id_: str, split: str, labels: list[str], targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, report). units: (id, scope, *labels), one row per id of a scope and cell; scope is a split, or
    null for all. report: one row per plan and cell with available, needed, drawn, gap and probability, and
    the share wanted against the share of the whole drawn sample.

    Rows whose labels are null or not 0/1 belong to no cell, rows without an id are no unit. needed is the
    larger of min_rows and target_share * sample_size; where a cell holds less, all it holds is drawn and
    gap says how many are missing, as the calibration of the plan finds it. Plans without a matching split
    have nothing available. Plans may be of any number; the cells of one plan are solved in one task.
    """
    a, b = labels
    base = rows.filter(F.col(id_).isNotNull() & F.col(a).isin(0, 1) & F.col(b).isin(0, 1))
    scopes = F.explode(F.array(F.col(split), F.lit(None).cast("string")))
    units = base.select(F.col(id_).cast("string").alias("id"), F.col(a).cast("int").alias(a), F.col(b).cast("int").alias(b), F.col(split)).withColumn("scope", scopes).drop(split)
    units = units.distinct()
    moments = units.groupBy("scope", a, b).agg(F.count("*").alias("available"))
    plans = targets.groupBy("plan_id", "split_name", "sample_size", a, b).agg(F.sum("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"))
    same = plans["split_name"].eqNullSafe(moments["scope"]) & (plans[a] == moments[a]) & (plans[b] == moments[b])
    joined = plans.join(moments, same, "left").select(
        F.col("plan_id").cast("bigint"), plans["split_name"], plans[a].cast("int").alias(a), plans[b].cast("int").alias(b), F.coalesce("available", F.lit(0)).cast("bigint").alias("available"),
        F.coalesce("target_share", F.lit(0.0)).cast("double").alias("target_share"), F.coalesce("sample_size", F.lit(0)).cast("bigint").alias("sample_size"), F.coalesce("min_rows", F.lit(0)).cast("bigint").alias("min_rows"),
    )

    def solve(plan: pa.Table) -> pa.Table:
        plan = plan.sort_by([(a, "ascending"), (b, "ascending")])
        col = lambda c: plan.column(c).to_numpy().astype(float)
        needed = np.maximum(col("min_rows"), np.round(col("target_share") * col("sample_size"), 6))
        held = col("available")
        prob, gap = calibrate(held, np.ceil(needed - 1e-9), np.stack([col(a), col(b)], axis=1))
        drawn = np.round(held * prob)
        more = {
            "needed": needed, "drawn": drawn.astype(np.int64), "gap": np.round(gap).astype(np.int64), "probability": np.where(held > 0, drawn / np.maximum(held, 1), 0.0),
            "drawn_share": drawn / max(1.0, drawn.sum()),
        }
        kept = plan.select(["plan_id", "split_name", a, b, "available", "target_share"])
        for k, v in more.items():
            kept = kept.append_column(k, pa.array(v))
        return kept

    kinds = f"plan_id bigint, split_name string, {a} int, {b} int, available bigint, target_share double, needed double, drawn bigint, gap bigint, probability double, drawn_share double"
    return units, joined.groupBy("plan_id").applyInArrow(solve, kinds)


def target_sample(rows: DataFrame, id_: str, split: str, labels: list[str], targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sample, report): sample has (plan_id, id, *labels, probability), report is plan_report's."""
    units, report = plan_report(rows, id_, split, labels, targets)
    units, report = stage(units, "units"), stage(report, "report")
    a, b = labels
    blocks = max(1, -(-units.count() // BLOCK_UNITS))
    cells = report.filter("probability > 0").select("plan_id", "split_name", F.col(a).alias("_a"), F.col(b).alias("_b"), "probability")
    same = units["scope"].eqNullSafe(cells["split_name"]) & (units[a] == cells["_a"]) & (units[b] == cells["_b"])
    drawn = units.join(cells, same).select("plan_id", "id", a, b, "probability", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    out = f"plan_id bigint, id string, {a} int, {b} int, probability double, settled double"

    def settle(tab: pa.Table, probability: str, salt: int) -> pa.Table:
        tab = tab.combine_chunks().sort_by("id")
        key = _keys(tab.column("id").combine_chunks(), seed + salt + 1000 * tab.column("plan_id")[0].as_py())
        by = np.argsort(key, kind="stable")
        tab, key = tab.take(pa.array(by)), key[by]
        done = pivotal(tab.column(probability).to_numpy(), key)
        tab = tab.select(["plan_id", "id", a, b, "probability"]).append_column("settled", pa.array(done))
        return tab.filter(pa.array(done > 0))

    first = stage(drawn.groupBy("plan_id", a, b, "block").applyInArrow(lambda tab: settle(tab, "probability", 1), out), "pivotal")
    sure = first.filter("settled >= 1")

    def last(tab: pa.Table) -> pa.Table:
        got = settle(tab, "settled", 99)
        keep = got.column("settled").to_numpy() > 0.5
        return got.filter(pa.array(keep))

    rest = first.filter("settled < 1").groupBy("plan_id", a, b).applyInArrow(last, out)  # one id a block
    return sure.unionByName(rest).drop("settled"), report
