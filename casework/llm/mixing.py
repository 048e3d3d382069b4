"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: shares of the whole by weight, at most ``most`` times what it has, the excess
shared anew by weight. Inside a source a document's expected copies rise with the bit length of its size and are at most
``most``; whole copies are certain, and for the rest documents are ranked by random odds divided by inclusion odds and taken
in that order until the remaining words of the target are filled. Ranks are cut by counting words per slice of the rank scale
first, so that only the one slice of each source that holds the cut is ordered. The random number of a document comes from its
id, so reruns and repeated rows agree.

Defined cases: null text has size 0 and takes nothing; the null source is a source of its own and comes last; rows with the
same id have the same random number; sources without words have target 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import stored
from .text import words

SLICES = 4096


def uniform(key: Column, seed: str) -> Column:
    """In (0, 1), from the key's text."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)


def source_targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Adds ``target`` to (source, source_size): one row per source, a list that a person writes weights for."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    df = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), k).cast("double")).withColumn("full", F.col("source_size").cast("double") * most)
    # the sources that reach their limit first come first; the level is the first one at which none is above it
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", level).withColumn("at", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct("at", "level"))
    chosen = F.min(fits).over(everything)["level"]
    return df.withColumn("target", F.least(F.col("full"), F.coalesce(F.col("weight") * chosen, F.col("full")))).select("source", "source_size", "target")


def class_copies(classes: DataFrame, most: int) -> DataFrame:
    """Expected copies of a document of each size class: ``most`` or a multiple of 1 + class, adding up to the target."""
    per_source = Window.partitionBy("source").orderBy(F.col("class").desc())
    before = per_source.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    mass = (F.col("class") + 1).cast("double") * F.col("class_size")
    df = classes.withColumn("mass", mass)
    full = F.coalesce(F.sum("class_size").over(before), F.lit(0)).cast("double") * most
    rest = F.sum("mass").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("mass").over(before), F.lit(0.0))
    df = df.withColumn("factor", F.when(rest > 0, (F.col("target") - full) / rest))
    fits = F.when(F.col("factor") * (F.col("class") + 1) <= most, F.struct((-F.col("class")).alias("c"), "factor"))
    chosen = F.min(fits).over(whole)["factor"]
    copies = F.least(F.lit(float(most)), F.coalesce(chosen * (F.col("class") + 1), F.lit(float(most))))
    return df.withColumn("copies", F.when(F.col("class_size") > 0, F.greatest(copies, F.lit(0.0))).otherwise(0.0))


def _named(df: DataFrame) -> DataFrame:
    """The source as two columns that can be joined on: null is a source, and not the empty one."""
    return df.withColumn("__name", F.coalesce(F.col("source"), F.lit(""))).withColumn("__none", F.col("source").isNull())


def _classed(df: DataFrame) -> DataFrame:
    return df.withColumn("__class", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))


def _ranked(df: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Adds the plan of a row's source and class, __rank (odds of its random number by odds of its chance, put on the
    scale from 0 to 1 by x / (1 + x)) and __slice of that scale; both null where nothing is left to chance."""
    df = _named(_classed(df)).join(plan, ["__name", "__none", "__class"]).withColumn("__u", uniform(F.col("doc_id"), seed))
    u, p = F.col("__u"), F.col("__chance")
    df = df.withColumn("__rank", F.when(p > 0, u * (1 - p) / (u * (1 - p) + p * (1 - u))))
    return df.withColumn("__slice", F.least(F.floor(F.col("__rank") * SLICES), F.lit(SLICES - 1)).cast("int"))


ORDER = ("__rank", "doc_id", "size")


def plan_mix(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """What the mix takes: a row per source and size class, with the certain copies, the chance of one more, and the source's cut.

    ``rows`` (doc_id, source, size) is read several times and should be a stored table.
    """
    classes = _classed(rows).groupBy("source", F.col("__class").alias("class")).agg(F.sum("size").alias("class_size"))
    sources = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, most)
    classes = _named(classes).join(_named(sources).drop("source"), ["__name", "__none"])
    classes = class_copies(classes, most)
    classes = classes.withColumn("certain", F.floor("copies")).withColumn("chance", F.col("copies") - F.col("certain"))
    rest = F.col("target") - F.sum(F.col("certain") * F.col("class_size")).over(Window.partitionBy("source"))
    plan = classes.withColumn("rest", rest).select(
        "__name", "__none", F.col("class").alias("__class"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.col("certain").alias("__certain"), F.col("chance").alias("__chance"), F.col("rest").alias("__rest"),
    )
    plan = stored(plan, "mix-classes")

    df = _ranked(rows, plan, seed).where("__chance > 0")
    slices = df.groupBy("__name", "__none", "__slice").agg(F.sum("size").alias("words"), F.max("__rest").alias("rest"))
    so_far = F.sum("words").over(Window.partitionBy("__name", "__none").orderBy("__slice"))
    slices = slices.withColumn("begin", so_far - F.col("words"))
    cut = slices.where((F.col("begin") < F.col("rest")) & (F.col("begin") + F.col("words") >= F.col("rest")))
    cut = stored(cut.select("__name", "__none", F.col("__slice").alias("__cut"), F.col("begin").alias("__begin")), "mix-cuts")
    # of the slice with the cut, documents whose middle lies before it are taken
    inside = df.join(cut, ["__name", "__none"]).where("__slice = __cut")
    order = Window.partitionBy("__name", "__none").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("end", F.col("__begin") + F.sum("size").over(order))
    inside = inside.withColumn("far", F.max(F.col("end") - F.col("size") / 2).over(order)).where("far <= __rest")
    last = inside.groupBy("__name", "__none").agg(F.max(F.struct(*ORDER)).alias("__last"))
    cuts = cut.drop("__begin").join(last, ["__name", "__none"], "left")
    return stored(plan.join(cuts, ["__name", "__none"], "left"), "mix-plan")


def apply_mix(df: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds source_size, target and repeats to rows with doc_id, source and size. Joins with the plan only, never with documents."""
    df = _ranked(df, plan, seed)
    # without a cut the slices end before the target does: all are taken
    more = F.when(F.col("__cut").isNull(), F.col("__rest") > 0).otherwise(
        (F.col("__slice") < F.col("__cut")) | ((F.col("__slice") == F.col("__cut")) & F.coalesce(F.struct(*ORDER) <= F.col("__last"), F.lit(False)))
    )
    extra = F.when((F.col("__chance") > 0) & more, 1).otherwise(0)
    return df.withColumns({
        "source_size": F.col("__source_size"), "target": F.col("__target"), "repeats": (F.col("__certain") + extra).cast("long"),
    }).drop(*plan.columns, "__u", "__rank", "__slice")


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")
    )


def mix_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, size, source, source_size, target, repeats and taken (words, repeats counted) of every row."""
    rows = stored(sized(docs), "mix-sizes")
    out = apply_mix(rows, plan_mix(rows, weights, most, seed), seed)
    return out.select("doc_id", "size", "source", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))
