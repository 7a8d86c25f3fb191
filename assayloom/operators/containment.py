"""Pairs of degenerate patterns of which one allows all that the other does, by an index of short windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import base_masks
from ..sinks.scratch import materialize

#: Places of an index window: a pattern spells out 4 ** WINDOW strings of one at most.
WINDOW = 6


def _spelled(masks: Column) -> Column:
    """All strings that the places of a window allow, the bases as digits 0 to 3."""
    table = F.array(*[F.array(*[F.lit(str(i)) for i in range(4) if m >> i & 1]).cast("array<string>") for m in range(16)])
    start = F.array(F.lit("")).cast("array<string>")
    return F.aggregate(masks, start, lambda got, m: F.flatten(F.transform(got, lambda p: F.transform(F.get(table, m), lambda b: F.concat(p, b)))))


def _least_base(m: Column) -> Column:
    return F.when(m.bitwiseAND(1) != 0, "0").when(m.bitwiseAND(2) != 0, "1").when(m.bitwiseAND(4) != 0, "2").otherwise("3")


def containment_pairs(patterns: DataFrame, window: int = WINDOW) -> DataFrame:
    """(grp, a, b, n): patterns a and b of a group, not the same id, where each of the first n places of a allows all that b allows.

    patterns: (pid, grp, pattern) in IUPAC letters; n is the length of the shorter. What b allows,
    a allows, so the least base of b at each place of a window is among the strings that a spells
    there: b offers that string for every window of its group, a asks with all strings of the window
    where it meets fewest offers, and whoever meets is verified over all n places. The windows lie side
    by side within the group's shortest pattern; every such pair meets exactly once.

    A window spells at most 4 ** window strings, so no pattern grows without bound; a start that a
    whole group shares costs nothing, as another window has fewer offers. Patterns whose group, id or
    letters are null, that are empty or hold a letter that stands for no base are in no pair; of equal
    patterns both contain each other. Equal rows count once; patterns of one id never meet each other.
    """
    p = patterns.where("pid is not null and grp is not null and pattern != ''").select("pid", "grp", base_masks(F.upper("pattern")).alias("masks")).distinct()
    p = p.where(~F.exists("masks", lambda m: m == 0))
    p = materialize(p.join(p.groupBy("grp").agg(F.min(F.size("masks")).alias("reach")), "grp"))
    places = F.sequence(F.lit(0), F.floor((F.col("reach") - 1) / window).cast("int"))
    part = lambda i: F.slice("masks", i * window + 1, F.least(F.lit(window), F.col("reach") - i * window))
    each = p.select("grp", "pid", "masks", "reach", F.explode(places).alias("place"))
    offers = each.select("grp", "place", F.array_join(F.transform(part(F.col("place")), _least_base), "").alias("key"), F.col("pid").alias("b"), F.col("masks").alias("masks_b"))
    asks = each.select("grp", "place", F.explode(_spelled(part(F.col("place")))).alias("key"), F.col("pid").alias("a"), F.col("masks").alias("masks_a"))
    crowd = asks.join(offers.groupBy("grp", "place", "key").agg(F.count("*").alias("n")), ["grp", "place", "key"])
    crowd = crowd.groupBy("grp", "a", "masks_a", "place").agg(F.sum("n").alias("n")).groupBy("grp", "a", "masks_a").agg(F.min(F.struct("n", "place"))["place"].alias("place"))
    met = asks.join(crowd, ["grp", "a", "masks_a", "place"]).join(offers, ["grp", "place", "key"]).where("a != b")
    n = F.least(F.size("masks_a"), F.size("masks_b"))
    holds = F.zip_with(F.slice("masks_a", F.lit(1), n), F.slice("masks_b", F.lit(1), n), lambda u, v: u.bitwiseAND(v) == v)
    return met.where(F.forall(holds, lambda x: x)).select("grp", "a", "b", n.alias("n"))
