"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A tree has the levels domain, language and source. A node can give at most ``epochs`` times the
tokens below it. From the root down, a node's budget is shared among its children by weight; what a
child cannot give goes to its siblings, by weight again, and only what all siblings together cannot
give is missing at their parent, whose budget was bounded by that in the same way one level up. All
amounts are integers, so the parts add up exactly. A leaf repeats its documents in whole epochs and
takes a prefix of tokens of one more epoch, in an order seeded by the epoch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftengine.llm.common import SPACE, stored

#: Leading hexadecimal digits of a document's order that form a slice of its leaf: with a leaf of a
#: third of all documents, a task sorts a 65,536th of it.
DIGITS = 4


def word_count(text: Column) -> Column:
    """Words of a text (runs without ASCII white space); null has none."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(plain == "", F.lit(0)).otherwise(
        F.length(plain) - F.length(F.translate(plain, " ", "")) + 1).cast("long")


def share(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Budgets of siblings. ``children``: parent columns, ``name``, ``weight`` (long, above 0), ``cap``
    (long) and the parent's ``budget`` (at most the sum of caps). Returns them with ``given``.

    Siblings are ordered by cap / weight. The first ones, whose cap is below their share of what the
    earlier ones left, give all they have; the others divide the rest by weight, rounded so that the
    parts add up.
    """
    by = Window.partitionBy(*parent)
    scarce = by.orderBy((F.col("cap") / F.col("weight")), name)
    done = scarce.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("budget") - F.coalesce(F.sum("cap").over(done), F.lit(0))
    weight_left = F.sum("weight").over(scarce.rowsBetween(0, Window.unboundedFollowing))
    d = children.withColumn("__rest", rest).withColumn("__w", weight_left)
    # In this order, saturated siblings are a leading run.
    full = F.col("cap").cast("decimal(38,0)") * F.col("__w") <= F.col("__rest").cast("decimal(38,0)") * F.col("weight")
    d = d.withColumn("__full", full)
    left = F.col("budget") - F.sum(F.when(F.col("__full"), F.col("cap")).otherwise(0)).over(by)
    open_weight = F.sum(F.when(F.col("__full"), 0).otherwise(F.col("weight"))).over(by)
    upto = F.sum(F.when(F.col("__full"), 0).otherwise(F.col("weight"))).over(
        scarce.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__left", left).withColumn("__all", open_weight).withColumn("__upto", upto)

    def part(upto: str) -> Column:
        return F.expr(f"cast(__left as decimal(20,0)) * cast({upto} as decimal(18,0)) "
                      "div nullif(cast(__all as decimal(18,0)), 0)")

    given = F.when(F.col("__full"), F.col("cap")).otherwise(part("__upto") - part("(__upto - weight)"))
    return d.withColumn("given", given).drop("__rest", "__w", "__full", "__left", "__all", "__upto")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: dict[str, str],
                 budget: str, epochs: int) -> DataFrame:
    """``leaves``: one row per leaf with its ``tokens``. Adds ``given``, the leaf's token budget.

    ``weights`` has for each level an SQL expression over the level's columns; null or less than 1 is
    1. ``budget`` is an SQL expression over ``total`` (all tokens); more than ``epochs`` times the tokens
    is cut to that.
    """
    tree = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = tree.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    root = total.select(F.least(F.expr(budget), F.col("total") * epochs).cast("long").alias("given"))
    parents, path = root.withColumn("__root", F.lit(0)), ["__root"]
    tree = tree.withColumn("__root", F.lit(0))
    for level in levels:
        here = tree.groupBy(*path, level).agg(F.sum("cap").alias("cap"))
        w = F.greatest(F.coalesce(F.expr(weights[level]), F.lit(1)), F.lit(1)).cast("long")
        up = parents.withColumnRenamed("given", "budget")
        joined = here.join(up, path).withColumn("weight", w)
        parents = share(joined, path, level).select(*path, level, "given")
        path = [*path, level]
    return tree.join(parents, path).drop("__root", "cap")


def mix_sources(docs: DataFrame, levels: dict[str, str], weights: dict[str, str], budget: str,
                epochs: int = 4, seed: int = 7, whole_rows: bool = False) -> DataFrame:
    """Tokens to take of every document: doc_id, the levels, n_tokens, full_epochs, prefix_tokens,
    taken_tokens (= full_epochs * n_tokens + prefix_tokens); with ``whole_rows`` also ``row``, all
    columns of ``docs``.

    Tokens are words; ``levels`` are SQL expressions over the columns of ``docs``. Null levels are one
    node named ''; null text has no tokens. Null ids order as the empty text. Repeated rows are
    documents of their own. An empty table gives no rows. A document in which the prefix ends is taken
    in part.
    """
    names = list(levels)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    base = docs.select(
        "doc_id", *row, *[F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
        word_count(F.col("text")).alias("n_tokens"))
    if not whole_rows:
        base = stored(base, "leaf-tokens")
    leaves = base.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    given = leaf_budgets(stored(leaves, "leaves"), names, weights, budget, epochs)
    whole = F.coalesce(F.floor(F.col("given") / F.nullif(F.col("tokens"), F.lit(0))), F.lit(0)).cast("long")
    given = stored(given.select(*names, whole.alias("full_epochs"),
                                (F.col("given") - whole * F.col("tokens")).alias("__part")), "budgets")

    # One row per leaf: Spark broadcasts it if small and splits a hot leaf otherwise.
    def keyed(rows: DataFrame) -> DataFrame:
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"),
                                  F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        return rows.join(given, names).withColumn("__o", order).withColumn("__slice", F.substring("__o", 1, DIGITS))

    sums = keyed(base.drop("row")).groupBy(*names, "__slice").agg(F.sum("n_tokens").alias("__n"))
    earlier = Window.partitionBy(*names).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, "__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*names, "__slice").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__off") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    prefix = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("__part") - before)).cast("long")
    return keyed(base).join(sums, [*names, "__slice"]).withColumn("prefix_tokens", prefix).select(
        "doc_id", *names, "n_tokens", "full_epochs", "prefix_tokens",
        (F.col("full_epochs") * F.col("n_tokens") + F.col("prefix_tokens")).alias("taken_tokens"),
        *(["row"] if whole_rows else []))


def mixed_documents(docs: DataFrame, levels: dict[str, str], weights: dict[str, str], budget: str,
                    epochs: int = 4, seed: int = 7) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row for every whole epoch of a document and
    one for its part of the last epoch. A text that is cut has its first words joined by one space,
    and its length in ``n_chars`` if there is such a column."""
    taken = mix_sources(docs, levels, weights, budget, epochs, seed, whole_rows=True)
    copies = F.col("full_epochs") + F.when(F.col("prefix_tokens") > 0, 1).otherwise(0)
    rows = taken.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut = (F.col("epoch") > F.col("full_epochs")) & (F.col("prefix_tokens") < F.col("n_tokens"))
    rows = rows.withColumn("__text", F.when(cut, first_words(F.col("row.text"), F.col("prefix_tokens").cast("int")))
                           .otherwise(F.col("row.text"))).withColumn("__cut", cut)
    new = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("__cut"), F.length("__text").cast(kind)).otherwise(F.col("row.n_chars"))
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words, joined by one space."""
    return F.array_join(F.slice(F.filter(F.split(text, SPACE), lambda w: w != ""), F.lit(1), n), " ")
