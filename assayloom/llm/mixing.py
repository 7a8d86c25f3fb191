"""Mixing sources to target weights: budgets down a tree, token prefixes of seeded epochs at its leaves.

DataFrame functions only; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Stands for a null on the tree's paths.
NONE = "(none)"
#: A tree of at most so many leaves is broadcast (under 100 bytes each); a larger one is joined by shuffle.
MOST_LEAVES = 50_000


def token_count(text: Column) -> Column:
    """Words parted by white space; 0 for null and empty texts."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, SPACE))).otherwise(0).cast("long")


def token_prefix(text: Column, tokens: Column) -> Column:
    """The text up to its tokens-th word, white space between words kept."""
    pieces = F.split(F.ltrim(text, F.lit(BLANKS)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    return F.rtrim(F.array_join(F.slice(pieces, F.lit(1), tokens.cast("int")), ""), F.lit(BLANKS))


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent..., name, weight, cap, budget of the parent) -> the same with `given`, each child's share.

    Shares follow the weights; a child that can't take its share takes its cap and leaves the rest
    to its siblings by their weights. Children that fill up come first by cap / weight, so the
    level of the others follows from running sums, without a loop.
    """
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = by.orderBy((F.col("cap") / F.col("weight")).asc(), F.col(name).asc())
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    x = children.where("weight > 0 and cap > 0")
    x = x.withColumns({"caps": F.sum("cap").over(so_far) - F.col("cap"), "weights": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))})
    x = x.withColumn("level", (F.col("budget") - F.col("caps")) / F.col("weights"))
    x = x.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    x = x.withColumn("line", F.min(F.when(~F.col("full"), F.struct("caps", "level"))).over(by)["level"])
    return x.withColumn("given", F.when(F.col("full") | F.col("line").isNull(), F.col("cap")).otherwise(F.col("line") * F.col("weight"))).drop("caps", "weights", "level", "full", "line")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple[str, ...], float], budget: float | None, share: float, max_epochs: int) -> DataFrame:
    """leaves (levels..., tokens) -> (levels..., tokens, target): whole tokens that each leaf gives.

    weights: by path from the top; a path that it lacks weighs 1. A node's cap is what its leaves
    hold in max_epochs epochs, without branches of weight 0, so a shortage goes to siblings first
    and to other branches only where a whole branch is short. Without a budget it is `share` of
    all tokens.
    """
    spark = leaves.sparkSession
    known = spark.createDataFrame([("/".join(map(_escape, p)), float(w)) for p, w in weights.items()] or [("", 1.0)], "path string, weight double")
    node = leaves.select(*levels, "tokens", (F.col("tokens") * F.lit(float(max_epochs))).alias("cap"))
    up = {}
    for depth in range(len(levels), 0, -1):
        path = F.concat_ws("/", *[F.replace(F.col(c), F.lit("/"), F.lit("//")) for c in levels[:depth]])
        node = node.withColumn("path", path).join(F.broadcast(known), "path", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop("path")
        up[depth] = node
        node = node.groupBy(*levels[: depth - 1]).agg(F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)).alias("cap"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    want = F.lit(float(budget)) if budget is not None else F.floor(F.col("all") * F.lit(share)).cast("double")
    top = [total.select(want.alias("w")).first().w]  # one number
    x = up[1].withColumn("budget", F.lit(float(top[0])))
    x = fill(x, [], levels[0])
    for depth in range(2, len(levels) + 1):
        above = x.select(*levels[: depth - 1], F.col("given").alias("budget"))
        x = fill(up[depth].join(above, levels[: depth - 1]), levels[: depth - 1], levels[depth - 1])
    return x.select(*levels, "tokens", F.floor(F.col("given") + F.lit(1e-6)).cast("long").alias("target"))


def _escape(x: str) -> str:
    return x.replace("/", "//")


def mix_sources(
    documents: DataFrame,
    levels: dict[str, Column],
    weights: dict[tuple[str, ...], float],
    budget: float | None = None,
    share: float = 1.0,
    max_epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """documents' columns and (mix_<level>..., mix_epoch, mix_tokens, mix_take): the rows that the mixture takes.

    levels: name and value of each level of the tree, from the top; null values are a branch of
    their own. A leaf's stream is all its documents in seeded order (md5 of seed, epoch and id,
    then id and text), epoch after epoch; it gives the first `target` tokens: whole epochs, then
    the documents before the cut, the last of them only for its first mix_take tokens, to which its
    text is shortened. Texts without tokens come with those around them.

    The cut is found from token sums by the first four digits of the order key, two at a time, so
    no leaf is ever sorted as a whole, however large: only documents that share all four digits
    with the cut are. Repeated rows count each time, null ids are ids like others and are told
    apart by their texts. Columns of documents may have any name but mix_<level>, mix_epoch,
    mix_tokens and mix_take, which are replaced.
    """
    names = [f"mix_{x}" for x in levels]
    base = documents.drop(*names, "mix_epoch", "mix_tokens", "mix_take")
    own = {f"mix_{x}": F.coalesce(c.cast("string"), F.lit(NONE)) for x, c in levels.items()}
    mark = {"mix_id": F.col(id_col), "mix_text": F.md5(F.coalesce(F.col(text_col), F.lit("")))}
    slim = base.select(*[c.alias(n) for n, c in mark.items()], *[c.alias(n) for n, c in own.items()], token_count(F.col(text_col)).alias("n"))
    slim = materialize(slim)
    leaves = slim.groupBy(*names).agg(F.sum("n").alias("tokens")).where("tokens > 0")
    plan = leaf_budgets(leaves, names, {k: v for k, v in weights.items()}, budget, share, max_epochs)
    plan = plan.withColumns({"whole": F.expr("least(target div tokens, 2147483647)").cast("int"), "rest": F.col("target") % F.col("tokens")})
    plan = materialize(plan.where("target > 0").select(*names, "whole", "rest"))
    few = plan.count() <= MOST_LEAVES
    join = lambda rows, leaf, keys=names: rows.join(F.broadcast(leaf) if few else leaf, keys)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.coalesce(F.col("mix_id").cast("string"), F.lit("")), F.col("mix_text"))).alias("key")
    keyed = join(slim, plan.where("rest > 0")).select(*names, "rest", key, "n")
    one, two = F.substring("key", 1, 2), F.substring("key", 3, 2)
    fine = materialize(keyed.groupBy(*names, "rest", one.alias("d1"), two.alias("d2")).agg(F.sum("n").alias("n")))
    coarse = fine.groupBy(*names, "rest", "d1").agg(F.sum("n").alias("n"))
    run = lambda t, part, by: t.withColumn("upto", F.sum("n").over(W.partitionBy(*part).orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)))
    # 256 rows a leaf, then 256 rows below the digit pair in which the cut falls
    first = run(coarse, names, "d1").where("upto >= rest and upto - n < rest").select(*names, "d1", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
    second = run(fine.join(first, [*names, "d1"]), names, "d2").where("upto >= left and upto - n < left")
    cut = materialize(second.select(*names, F.concat("d1", "d2").alias("cut"), (F.col("left") - F.col("upto") + F.col("n")).alias("inside")))
    leaf = materialize(plan.join(cut, names, "left"))
    kept = F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row")  # so that no column of documents meets one of these
    rows = base.select(kept, *[c.alias(n) for n, c in (own | mark).items()], token_count(F.col(text_col)).alias("mix_tokens"))
    rows = join(rows, leaf).withColumn("key", key)
    digits = F.substring("key", 1, 4)
    epochs = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>"))
    partial = F.when(digits < F.col("cut"), F.array(F.col("whole"))).otherwise(F.array().cast("array<int>"))
    made = [*names, "mix_epoch", "mix_tokens", "mix_take"]
    full = rows.withColumn("mix_epoch", F.explode(F.concat(epochs, partial))).withColumn("mix_take", F.col("mix_tokens")).select("row.*", *made)
    order = W.partitionBy(*names).orderBy("key", "mix_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = rows.where(digits == F.col("cut")).withColumn("upto", F.sum("mix_tokens").over(order))
    edge = edge.withColumn("mix_take", F.least("mix_tokens", F.col("inside") - F.col("upto") + F.col("mix_tokens"))).where("mix_take > 0")
    text = F.col("row")[text_col]
    shorter = F.when(F.col("mix_take") < F.col("mix_tokens"), token_prefix(text, F.col("mix_take"))).otherwise(text)
    edge = edge.withColumn("mix_epoch", F.col("whole")).select(*[(shorter if c == text_col else F.col("row")[c]).alias(c) for c in base.columns], *made)
    return full.unionByName(edge)
