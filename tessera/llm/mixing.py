"""Mixing sources to target weights: hierarchical token budgets over a tree of levels.

The tree has one level per column (domain, language, source).  A node's supply is the number
of tokens below it, its capacity ``max_epochs`` times that (0 where its weight is 0).  The
budget goes down the tree: siblings share their parent's budget by weight, a sibling never
gets more than its capacity, and what it can't use goes to its siblings by weight.  Only when
all siblings are full does the parent run short, and then its own siblings take the rest: as a
node asks for no more than its capacity, shortages are met among siblings before ancestors.
All shares are whole tokens, computed in integers; the parts of a budget add up to it exactly.

A leaf with budget ``b`` and supply ``t`` takes ``b div t`` whole epochs and a token prefix of
the next: its documents in the order of ``md5(seed:epoch:id)``, up to ``b mod t`` tokens, the
last one in part.  The cut is found by token sums over hash prefixes, narrowed twice, so no
task orders a leaf.  Everything is DataFrame code.

Defined cases: a null or empty level value is the node ``(none)``; rows that share an id within
a leaf (null ids too) are one unit, taken together, or with ``by_row`` rows that are equal in
every column, so that a prefix of documents passes its budget by no more than one document and
its exact copies; of ties, equal units are one; very long texts count like others; units without tokens go with any epoch or
prefix that has begun before them; leaves without tokens get nothing; an empty table gives an
empty mix; a budget beyond the whole capacity is met as far as the capacity goes.  Weights are
whole numbers, 1 where none is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordinals import row_hash
from .common import materialise, n_words, small

NONE = "(none)"


def node_name(c: Column) -> Column:
    c = c.cast("string")
    return F.when(c.isNull() | (c == ""), F.lit(NONE)).otherwise(c)


def weight_table(spark: SparkSession, levels: list[str], weights: dict[tuple[str, ...], int]) -> DataFrame:
    """Rows (depth, levels..., weight); the path ends where the levels are null."""
    rows = [(len(path), *path, *[None] * (len(levels) - len(path)), int(w)) for path, w in weights.items()]
    return spark.createDataFrame(rows, "depth int, " + ", ".join(f"{c} string" for c in levels) + ", weight bigint")


def _sum(c: str, w=None) -> Column:
    s = F.sum(F.col(c).cast("decimal(38,0)"))
    return s.over(w) if w is not None else s


def leaf_budgets(supply: DataFrame, levels: list[str], weights: DataFrame, budget: int, max_epochs: int) -> DataFrame:
    """(levels..., supply, weight, budget) per leaf of the materialised table ``supply``
    (levels..., supply)."""
    nodes = []  # from the leaves up: (levels[:d], cap, weight)
    for d in range(len(levels), 0, -1):
        path = levels[:d]
        own = weights.where(F.col("depth") == d).select(*path, F.col("weight").alias("w"))
        below = (supply.select(*path, (F.col("supply") * max_epochs).alias("cap"), "supply") if not nodes else
                 nodes[-1].groupBy(*path).agg(_sum("cap").cast("bigint").alias("cap")))
        weighed = below.join(own, path, "left").withColumn("w", F.coalesce("w", F.lit(1).cast("bigint")))
        nodes.append(weighed.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0).cast("bigint"))))
    given = None
    for d, level in enumerate(reversed(nodes), start=1):
        parent, path = levels[: d - 1], levels[:d]
        level = level.withColumn("b", F.lit(budget).cast("decimal(38,0)")) if given is None else level.join(
            given.select(*parent, F.col("g").cast("decimal(38,0)").alias("b")), parent)
        all_ = Window.partitionBy(*(parent or [F.lit(0)]))
        by_ratio = all_.orderBy(F.col("cap") / F.greatest(F.col("w"), F.lit(1)), *path)
        up_to = by_ratio.rowsBetween(Window.unboundedPreceding, 0)
        live = (level.where("cap > 0").withColumn("before", _sum("cap", up_to) - F.col("cap"))
                .withColumn("rest", _sum("w", all_) - _sum("w", up_to) + F.col("w"))
                .withColumn("full", F.col("cap") * F.col("rest") <= F.col("w") * (F.col("b") - F.col("before")))
                .withColumn("taken", F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0)))
                .withColumn("open", F.when(F.col("full"), F.lit(0)).otherwise(F.col("w")))
                .withColumn("left", F.col("b") - _sum("taken", all_)).withColumn("opens", _sum("open", all_))
                .withColumn("upto", _sum("open", up_to)))
        share = "(({} * left) div opens)"
        given = live.withColumn("g", F.expr(f"case when full then cap else {share.format('upto')} - "
                                            f"{share.format('(upto - open)')} end").cast("bigint"))
    return (supply.join(given.select(*levels, F.col("g"), F.col("w")), levels, "left")
            .select(*levels, "supply", F.coalesce("w", F.lit(0)).alias("weight"),
                    F.coalesce("g", F.lit(0).cast("bigint")).alias("budget")))


def _unit(docs: DataFrame, id_col: str, by_row: bool) -> Column:
    unit = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null"))
    return F.concat_ws("#", unit, row_hash(docs).cast("string")) if by_row else unit


def _key(seed: int, epoch: str, unit: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.col(unit)))


def _crossing(sums: DataFrame, levels: list[str], order: list[str]) -> DataFrame:
    """Per leaf the one row in whose tokens ``t`` the count passes ``part``."""
    up_to = Window.partitionBy(*levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (sums.withColumn("upto", F.sum("t").over(up_to) + F.col("start"))
            .where("upto - t < part and upto >= part").withColumn("start", F.col("upto") - F.col("t")))


def mix_plan(docs: DataFrame, levels: dict[str, str], weights: dict[tuple[str, ...], int], budget: tuple[int, int],
             max_epochs: int, seed: int, id_col: str = "doc_id", tokens: Column | None = None,
             by_row: bool = False) -> tuple[DataFrame, DataFrame]:
    """The materialised units (levels..., id, unit, rows, tokens) and leaf plans (levels...,
    supply, weight, budget, epochs, cut, cut_take).  ``levels`` gives each level's SQL expression,
    the top one first; ``budget`` is the fraction (numerator,
    denominator) of the table's tokens that the mix shall have.  ``epochs`` epochs are taken
    whole; of the next, the units whose key is before ``cut`` and ``cut_take`` tokens of the
    unit at it."""
    names, spark = list(levels), docs.sparkSession
    unit = _unit(docs, id_col, by_row)
    units = materialise(docs.select(*[node_name(F.expr(c)).alias(n) for n, c in levels.items()], F.col(id_col).alias("id"),
                                    unit.alias("unit"), (n_words(F.col("text")) if tokens is None else tokens).alias("tokens"))
                        .groupBy(*names, "id", "unit").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")), "mix-units")
    supply = materialise(units.groupBy(*names).agg(F.sum("tokens").alias("supply")), "mix-supply")
    total = int(supply.agg(F.sum("supply")).first()[0] or 0) * budget[0] // budget[1]
    leaves = materialise(leaf_budgets(supply, names, weight_table(spark, names, weights), total, max_epochs)
                         .withColumn("epochs", F.expr("case when supply > 0 then int(budget div supply) else 0 end"))
                         .withColumn("part", F.expr("case when supply > 0 then budget % supply else 0 end")), "mix-leaves")
    keyed = units.join(small(leaves.where("part > 0").select(*names, "epochs", "part")), names).select(
        *names, "part", F.col("tokens").alias("t"), _key(seed, "epochs", "unit").alias("key"))
    at = None
    for digits in (3, 6):
        slot = keyed.withColumn("slot", F.substring("key", 1, digits))
        if at is not None:
            slot = slot.join(small(at), names).where(F.substring("key", 1, digits - 3) == F.col("above"))
        else:
            slot = slot.withColumn("start", F.lit(0).cast("bigint"))
        sums = slot.groupBy(*names, "part", "start", "slot").agg(F.sum("t").alias("t"))
        at = materialise(_crossing(sums, names, ["slot"]).select(*names, "start", F.col("slot").alias("above")), "mix-slot")
    last = keyed.join(small(at), names).where(F.substring("key", 1, 6) == F.col("above"))
    cut = _crossing(last, names, ["key"]).select(*names, F.col("key").alias("cut"), (F.col("part") - F.col("start")).alias("cut_take"))
    return units, materialise(leaves.drop("part").join(cut, names, "left"), "mix-plan")


def _taken(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with columns epochs, cut, unit, once for every epoch that takes them (``epoch``);
    ``key`` is the unit's key in the partial epoch."""
    copies = F.col("epochs") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    return (rows.withColumn("key", _key(seed, "epochs", "unit")).withColumn("copies", copies).where("copies > 0")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))))


def mixed_units(units: DataFrame, plan: DataFrame, levels: list[str], seed: int) -> DataFrame:
    """(levels..., id, epoch, rows, tokens, take): one row per unit and epoch that takes it."""
    return (_taken(units.join(small(plan.where("budget > 0")), levels), seed)
            .withColumn("take", F.when((F.col("epoch") == F.col("epochs")) & (F.col("key") == F.col("cut")), F.col("cut_take"))
                        .otherwise(F.col("tokens")))
            .select(*levels, "id", "epoch", "rows", "tokens", "take"))


def mix_documents(docs: DataFrame, plan: DataFrame, levels: dict[str, str], seed: int, id_col: str = "doc_id",
                  by_row: bool = False) -> DataFrame:
    """The documents of the mix, whole and with their columns unchanged, once per epoch that
    takes them; the unit at the cut is taken whole.  ``by_row`` as in the plan."""
    own = {n: f"__mix_{n}" for n in levels}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__mix_row"), *[node_name(F.expr(c)).alias(own[n]) for n, c in levels.items()],
                       _unit(docs, id_col, by_row).alias("unit"))
    plan = small(plan.where("budget > 0").select(*[F.col(n).alias(own[n]) for n in levels], "epochs", "cut"))
    return _taken(rows.join(plan, list(own.values())), seed).select("__mix_row.*")
