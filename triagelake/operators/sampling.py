"""Seeded sampling, quotas, splits. The order of rows is that of md5(seed|id): the same everywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triagelake.operators.joins import small
from triagelake.operators.order import place_in_group, running_sum
from triagelake.store import stage

MAX_GROUPS = 100_000  # group sizes are allocated on the driver up to this number of groups, in Spark beyond


def seeded(seed: int, id_: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_).cast("string")))


def uniform(df: DataFrame, n: int, seed: int, id_: str) -> DataFrame:
    """n rows in seeded order: a top-n, so every task sends n rows at most."""
    return df.orderBy(seeded(seed, id_), id_).limit(n)


def per_stratum(df: DataFrame, strata: list[str], quota: Column | int, seed: int, id_: str) -> DataFrame:
    """The first `quota` rows of each stratum in seeded order. A fixed quota limits each task's rows
    before the shuffle; a quota of the row needs every row's place."""
    if not isinstance(quota, int):
        return place_in_group(df, strata, [seeded(seed, id_), F.col(id_)], "_rn").filter(F.col("_rn") <= quota).drop("_rn")
    w = W.partitionBy(*strata).orderBy(seeded(seed, id_), F.col(id_))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= quota).drop("_rn")


def proportional_allocation(sizes: list[int], n: int, least: int = 0) -> list[int]:
    """Whole quotas that sum to min(n, total): proportional, largest remainders first, at least `least`
    per group where n allows it, never more than a group holds."""
    total = sum(sizes)
    n = min(n, total)
    if not n:
        return [0] * len(sizes)
    s = np.array(sizes, float)
    exact = s * n / total
    got = np.minimum(np.floor(exact + 1e-9), s)
    if least and least * len(sizes) <= n:
        got = np.maximum(got, np.minimum(least, s))
    order = sorted(range(len(sizes)), key=lambda i: (-(exact[i] - np.floor(exact[i] + 1e-9)), i))
    while got.sum() < n:
        for i in order:
            if got.sum() >= n:
                break
            if got[i] < s[i]:
                got[i] += 1
    for i in sorted(range(len(sizes)), key=lambda i: (-got[i], i)):
        while got.sum() > n and got[i] > least:
            got[i] -= 1
    return [int(x) for x in got]


def allocated(df: DataFrame, group: str, n: int, least: int = 1) -> DataFrame:
    """(group, size, quota) of every group (nulls are one, the first in order): whole quotas by largest
    remainder, at least `least` a group where n allows it.

    Up to MAX_GROUPS sizes are allocated on the driver; more are where they are, by the same rule, with
    places and running sums over ranges.
    """
    spark = df.sparkSession
    kind = df.schema[group].dataType.simpleString()
    sizes = stage(df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("size")), "sizes")
    groups = sizes.count()
    least = least if groups <= n else 0
    if groups <= MAX_GROUPS:
        got = sizes.orderBy(F.asc_nulls_first("_g")).collect()
        quota = proportional_allocation([r["size"] for r in got], n, least)
        return spark.createDataFrame([(r["_g"], r["size"], q) for r, q in zip(got, quota)], f"{group} {kind}, size bigint, quota int")
    total = sizes.agg(F.sum("size")).first()[0]
    n = min(n, total)
    exact = F.col("size") * F.lit(float(n)) / F.lit(float(total))
    floor = F.floor(exact + 1e-9)
    first = F.least(floor, F.col("size"))
    if least and least * groups <= n:
        first = F.greatest(first, F.least(F.lit(least), F.col("size")))
    given = sizes.withColumns({"quota": first.cast("bigint"), "rest": exact - floor})
    missing = n - given.agg(F.sum("quota")).first()[0]
    name = F.asc_nulls_first("_g")
    if missing > 0:  # one more, largest remainders first, where a group holds more
        open_ = place_in_group(given.withColumn("full", F.col("quota") >= F.col("size")), ["full"], [F.desc("rest"), name], "_place")
        given = open_.withColumn("quota", F.col("quota") + F.when(~F.col("full") & (F.col("_place") <= missing), 1).otherwise(0))
    elif missing < 0:  # too many by the least: the largest groups give back
        spare = F.greatest(F.col("quota") - least, F.lit(0))
        before = running_sum(given.withColumn("spare", spare), "spare", [F.desc("quota"), name], "_before")
        given = before.withColumn("quota", F.col("quota") - F.greatest(F.lit(0), F.least(F.col("spare"), F.lit(-missing) - F.col("_before"))))
    return given.select(F.col("_g").alias(group), "size", F.col("quota").cast("int").alias("quota"))


def proportional_sample(df: DataFrame, group: str, n: int, seed: int, id_: str, least: int = 1) -> DataFrame:
    """A sample of n whose groups (nulls are one) have their share, at least one row each if n allows."""
    plan = allocated(df, group, n, least).select(F.col(group).alias("_g"), F.col("quota").alias("_quota"))
    joined = df.join(small(plan), df[group].eqNullSafe(plan["_g"]))
    return per_stratum(joined, [group], F.col("_quota"), seed, id_).drop("_g", "_quota")


def split_three(df: DataFrame, strata: list[str], seed: int, id_: str, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Rows with split train/val/test by their place in the stratum's seeded order; a stratum of one row trains."""
    placed = place_in_group(df, strata, [seeded(seed, id_), F.col(id_)], "_place", "_size")
    place, size = F.col("_place"), F.col("_size")
    a, b = F.floor(size * shares[0] + 0.5), F.floor(size * (shares[0] + shares[1]) + 0.5)
    return placed.withColumn("split", F.when((size < 2) | (place <= a), "train").when(place <= b, "val").otherwise("test")).drop("_place", "_size")


def repair_coverage(df: DataFrame, labels: list[str], seed: int, id_: str, least: int = 1) -> DataFrame:
    """Test rows of every label that some training row has: rows of short labels move from train to test.

    All deficits come from one aggregation. A row that moves for one label counts for its others, too, so
    the moves are chosen label by label, but only for labels that lack rows, and joined once.
    """
    have = df.filter("split = 'test'").agg(*(F.coalesce(F.sum((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in labels)).first().asDict()
    moved: dict = {}
    for c in labels:
        short = least - have[c]
        if short <= 0:
            continue
        pool = df.filter((F.col("split") == "train") & (F.col(c) == 1) & ~F.col(id_).isin(list(moved)))
        for r in uniform(pool, short, seed, id_).select(id_, *labels).collect():  # at most `least` rows a label
            moved[r[id_]] = "test"
            for k in labels:
                have[k] += int(r[k] == 1)
    return _moved(df, moved, id_)


def _moved(df: DataFrame, moved: dict, id_: str) -> DataFrame:
    if not moved:
        return df
    plan = df.sparkSession.createDataFrame(list(moved.items()), f"{id_} {df.schema[id_].dataType.simpleString()}, _split string")
    return df.join(F.broadcast(plan), id_, "left").withColumn("split", F.coalesce("_split", "split")).drop("_split").select(*df.columns)


def swap_coverage(df: DataFrame, labels: list[str], stratum: str, seed: int, id_: str) -> DataFrame:
    """A test row of every label that at least two rows have: rows are swapped, so split sizes stay.

    Only labels without a test row are repaired, in order. The donor is a row of train if train keeps another
    of the label, else of val; it goes to test for a row of the same stratum without the label. Counts come
    from one aggregation and follow the swaps; each swap is found by one aggregation of firsts in seeded
    order, and all moves, two a label at most, are joined once. A label with no safe donor or no partner
    stays as it is. Ids are unique; nulls are no label.
    """
    sums = [F.coalesce(F.sum((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in labels]
    have = {r["split"]: r.asDict() for r in df.groupBy("split").agg(*sums).collect()}
    count = lambda s, c: have.get(s, {}).get(c, 0)
    moved: dict = {}
    for c in labels:
        if sum(count(s, c) for s in ("train", "val", "test")) < 2 or count("test", c):
            continue
        for donor in [s for s, keep in (("train", 1), ("val", 0)) if count(s, c) > keep]:
            free = df.filter(~F.col(id_).isin(list(moved))) if moved else df
            row = F.min(F.struct(seeded(seed, id_).alias("_o"), F.col(id_).alias("_id"), *(F.coalesce((F.col(k) == 1).cast("int"), F.lit(0)).alias(k) for k in labels)))
            gives = free.filter((F.col("split") == donor) & (F.col(c) == 1)).groupBy(F.col(stratum).alias("_s")).agg(row.alias("a"))
            takes = free.filter((F.col("split") == "test") & ~F.coalesce(F.col(c) == 1, F.lit(False))).groupBy(F.col(stratum).alias("_t")).agg(row.alias("b"))
            best = gives.join(takes, F.col("_s").eqNullSafe(F.col("_t"))).orderBy("a._o", "a._id").select("a", "b").first()
            if best is None:
                continue
            moved[best["a"]["_id"]], moved[best["b"]["_id"]] = "test", donor
            for k in labels:
                have["test"][k] += best["a"][k] - best["b"][k]
                have[donor][k] += best["b"][k] - best["a"][k]
            break
    return _moved(df, moved, id_)


def multilabel_folds(df: DataFrame, labels: list[str], k: int, seed: int, id_: str) -> DataFrame:
    """Rows with a fold: rows of each label set are dealt round-robin in seeded order, and sets start at
    different folds, so every label's rows spread evenly; no row is gathered."""
    key = F.concat_ws("", *(F.when(F.col(c) == 1, "1").otherwise("0") for c in labels))
    placed = place_in_group(df.withColumn("_set", key), ["_set"], [seeded(seed, id_), F.col(id_)], "_place")
    return placed.withColumn("fold", F.pmod(F.col("_place") + F.crc32("_set"), F.lit(k)).cast("int")).drop("_set", "_place")


def level_fill(need: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows go to each fold if every row goes to the fold of the largest need left, the one with
    the most slots left among equals, then the first; folds without slots get none."""
    got = np.zeros(len(need), np.int64)
    n = min(n, int(slots.sum()))
    low, high = need.min() - n - 1, need.max()
    for _ in range(60):  # the level to which the rows fill the needs
        mid = (low + high) / 2
        if np.minimum(slots, np.maximum(0, np.ceil(need - mid))).sum() > n:
            low = mid
        else:
            high = mid
    got = np.minimum(slots, np.maximum(0, np.ceil(need - high))).astype(np.int64)
    while got.sum() < n:
        free = np.flatnonzero(got < slots)
        at = free[np.lexsort((free, -(slots - got)[free], -np.round(need - got, 9)[free]))[0]]
        got[at] += 1
    return got


def set_quotas(sets: list[tuple[str, int]], k: int) -> dict[str, list[int]]:
    """How many rows of each label set (a string of 0 and 1) go to each of k folds: labels in the order of
    their rarity, each set with its rarest label, always to the folds that need the label most."""
    total = sum(n for _, n in sets)
    size = np.full(k, total // k)
    size[: total % k] += 1
    slots = size.copy()
    labels = len(sets[0][0]) if sets else 0
    has = {s: np.array([x == "1" for x in s]) for s, _ in sets}
    positives = np.zeros(labels) if not sets else sum(has[s] * n for s, n in sets)
    need = np.tile(np.asarray(positives, float) / k, (k, 1))
    out: dict[str, list[int]] = {}
    for lab in [*np.argsort(positives, kind="stable").tolist(), None]:
        for s, n in sorted(sets):
            if s in out or (lab is not None and not has[s][lab]):
                continue
            got = level_fill(need[:, lab] if lab is not None else slots.astype(float), slots, n)
            slots = slots - got
            need -= got[:, None] * has[s][None, :]
            out[s] = got.tolist()
    return out


MAX_SETS = 1 << 16  # label sets whose quotas are decided on the driver


def rarest_first_folds(df: DataFrame, labels: list[str], k: int, seed: int, id_: str) -> DataFrame:
    """Rows with a fold such that every label's rows are spread as evenly as can be: iterative stratification.

    Only the numbers of rows of each label set come to the driver, at most 2^labels; the rows of a set take
    the folds by their place in seeded order. Labels are those with value 1; nulls are none.
    """
    if 1 << len(labels) > MAX_SETS:
        raise ValueError(f"{len(labels)} labels have more sets than {MAX_SETS}")
    key = F.concat_ws("", *(F.when(F.col(c) == 1, "1").otherwise("0") for c in labels))
    keyed = df.withColumn("_set", key)
    quotas = set_quotas([(r["_set"], r["n"]) for r in keyed.groupBy("_set").agg(F.count("*").alias("n")).collect()], k)
    plan = df.sparkSession.createDataFrame([(s, np.cumsum(q).tolist()) for s, q in quotas.items()], "_set string, _ends array<bigint>")
    placed = place_in_group(keyed, ["_set"], [seeded(seed, id_), F.col(id_)], "_place").join(F.broadcast(plan), "_set")
    fold = F.size(F.filter("_ends", lambda e: e < F.col("_place")))
    return placed.withColumn("fold", fold).drop("_set", "_place", "_ends")
