"""One-to-one matching by preference, for all groups at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.stage import stage


def greedy_pairs(pairs: DataFrame, by: Sequence[str], left: str, right: str, order: Sequence[str]) -> DataFrame:
    """The pairs (by, left, right) that a pass in ``order`` takes, each member once.

    Work goes in rounds: a pair that comes first among all that share one of its
    members cannot be blocked, so all such pairs are taken together, and pairs
    with a taken member drop out. The result is that of the pass. Rounds are as
    many as the longest run of pairs that wait for each other, not as members.
    """
    by = list(by)
    rank = F.struct(*dict.fromkeys([*order, left, right]))
    open_ = stage(pairs.select(*by, left, right, rank.alias("__o")), "pairs")
    taken = []
    while True:
        first_left = open_.groupBy(*by, left).agg(F.min("__o").alias("__a"))
        first_right = open_.groupBy(*by, right).agg(F.min("__o").alias("__b"))
        marked = open_.join(first_left, [*by, left]).join(first_right, [*by, right])
        now = stage(marked.where((F.col("__o") == F.col("__a")) & (F.col("__o") == F.col("__b"))).select(*by, left, right), "taken")
        taken.append(now)
        open_ = stage(open_.join(now.select(*by, left), [*by, left], "left_anti").join(now.select(*by, right), [*by, right], "left_anti"), "pairs")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, taken)
