"""p5: groups of near-duplicate texts by signature trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm import wordsets as W
from triagelake.store import stage


def near_duplicate_groups(rows: DataFrame, ord_: str, text: str, t: float = 0.7) -> DataFrame:
    """(ord, group_ord, copies): each row of a group of texts linked by a similarity of at least t.

    Similarity is the share of distinct words two texts have in common. Texts with equal word sets
    are one node; links between different sets are found without loss and joined to components.
    group_ord is the least ord of the group. Rows that are alone, and rows without words, are left
    out. Nulls in other columns, extra columns and repeated rows make no difference; an empty table
    gives no rows.
    """
    sets = stage(W.word_sets(rows, ord_, text), "sets")
    classes, total = W.set_classes(sets)
    reps = classes.filter("ord = rep")
    sketch = W.frequency_sketch(reps)
    pairs = W.candidates(W.word_postings(reps, sketch, t), t, W.task_count(reps, t))
    links = W.verified(pairs, reps, t)
    roots = W.components(links)
    keyed = reps.select("rep", "copies").join(roots.withColumnRenamed("v", "rep"), "rep", "left")
    keyed = keyed.filter("copies > 1 OR root IS NOT NULL").select("rep", "copies", F.coalesce("root", "rep").alias("group_ord"))
    return W.attach(classes.select("ord", "rep"), keyed, ["rep"], "copies", total).select("ord", "group_ord", "copies")
