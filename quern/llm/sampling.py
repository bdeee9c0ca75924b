"""A sample whose shares over a category tree follow given targets.

Allocation goes top-down over form, kind and scoped. The root's quota is what all targets come to; each node divides
its quota among its children by their weight, and the leaves get what reaches them. What a leaf cannot fill goes to
its siblings (same form and kind), then to its cousins (same form), then to all other leaves, in proportion to what
they have to spare; the allocation that is left names what each leaf lacks of its own quota. Rows are
drawn at the leaves by their dense rank in a seeded permutation. The rank of a row is the number of rows in lower
blocks of the permutation plus its rank inside its block, so a leaf with any share of the rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = ["form", "kind", "scoped"]
#: Blocks of a leaf's permutation; one task ranks one block.
BLOCKS = 4096
SPACES = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def stripped(c: str) -> Column:
    """The string without white space at its ends, any Unicode white space included."""
    return F.trim(F.col(c), F.lit(SPACES))


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, form, kind, scoped): usable rows, of equal (session_id, entry_id, memory_id) the one of least pair_id.

    Usable rows have non-null entry_id, form and kind. Two nulls in session_id or memory_id are equal. form and kind
    are stripped and in lower case; scoped is 1 if scope_key is neither null nor blank. Copies of one pair collapse in
    the map-side aggregation.
    """
    good = pairs.where("entry_id is not null and form is not null and kind is not null")
    row = F.struct("pair_id", F.lower(stripped("form")).alias("form"), F.lower(stripped("kind")).alias("kind"), F.coalesce(stripped("scope_key") != "", F.lit(False)).cast("int").alias("scoped"))
    return good.groupBy("session_id", "entry_id", "memory_id").agg(F.min(row).alias("row")).select("row.*")


def strata(pairs: DataFrame) -> DataFrame:
    """(form, kind, scoped, available): the number of usable pairs of each leaf."""
    return strata_of(usable_pairs(pairs))


def strata_of(usable: DataFrame) -> DataFrame:
    """strata() of what usable_pairs() gave."""
    return usable.groupBy(*LEAF).agg(F.count("*").alias("available"))


def _handed_down(leaves: DataFrame) -> DataFrame:
    """leaves with quota: the root's, divided level by level by the weight of each child in its parent."""
    quota = F.sum("weight").over(Window.partitionBy(F.lit(0)))
    for depth in range(len(LEAF)):
        parent, child = (Window.partitionBy(*LEAF[:d]) if d else Window.partitionBy(F.lit(0)) for d in (depth, depth + 1))
        leaves = leaves.withColumn("__quota", quota).withColumn("__all", F.sum("weight").over(parent)).withColumn("__mine", F.sum("weight").over(child))
        quota = F.when(F.col("__all") > 0, F.expr("cast(__quota as decimal(19, 0)) * cast(__mine as decimal(19, 0)) div __all")).otherwise(F.lit(0)).cast("long")
    return leaves.withColumn("quota", quota).drop("__quota", "__all", "__mine")


def _pass_on(leaves: DataFrame, within: list[str], name: str) -> DataFrame:
    """Gives the unmet quota of a group to its leaves with pairs to spare, in proportion, the rest by leaf order."""
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    inside = group.orderBy(*LEAF).rowsBetween(Window.unboundedPreceding, 0)
    leaves = leaves.withColumn("room", F.col("available") - F.col("taken"))
    leaves = leaves.withColumn("lack", F.sum("unmet").over(group)).withColumn("space", F.sum("room").over(group))
    leaves = leaves.withColumn("moved", F.least("lack", "space"))
    share = F.when(F.col("space") > 0, F.expr("cast(moved as decimal(19, 0)) * cast(room as decimal(19, 0)) div space")).otherwise(F.lit(0)).cast("long")
    leaves = leaves.withColumn("share", share)
    leaves = leaves.withColumn("rest", F.col("moved") - F.sum("share").over(group)).withColumn("left", F.col("room") - F.col("share"))
    before = F.sum("left").over(inside) - F.col("left")
    more = F.greatest(F.least(F.col("rest") - before, F.col("left")), F.lit(0))
    leaves = leaves.withColumn(name, F.col("share") + more)
    # the group's lack shrinks by what moved, first for its first leaves
    owed = F.sum("unmet").over(inside) - F.col("unmet")
    settled = F.greatest(F.least(F.col("moved") - owed, F.col("unmet")), F.lit(0))
    return leaves.withColumn("unmet", F.col("unmet") - settled).withColumn("taken", F.col("taken") + F.col(name)).drop("room", "lack", "space", "moved", "share", "rest", "left")


def allocation(found: DataFrame, targets: DataFrame, *, one_in: int = 5) -> DataFrame:
    """(form, kind, scoped, quota, available, own, from_siblings, from_cousins, from_others, take, short): one row per target.

    With N usable pairs the sample has N div one_in; the weight of a leaf is the larger of minimum and share_permille *
    sample div 1000, and the quota that comes down to it is just that. take counts the drawn rows, and short what of them
    that others handed over doesn't cover of the quota: 0 if the target is met. Rows of a leaf listed again in targets
    are one leaf with the larger weight. Nulls in share or minimum count as 0; a null in the leaf matches no pair.
    The work is on one row per leaf.
    """
    leaf = [F.lower(stripped("form")).alias("form"), F.lower(stripped("kind")).alias("kind"), F.col("scoped").cast("int").alias("scoped")]
    size = (found.agg(F.sum("available")).first()[0] or 0) // one_in  # one number
    quota = F.greatest(F.coalesce("minimum", F.lit(0)).cast("long"), F.expr(f"coalesce(share_permille, 0) * {size}L div 1000").cast("long"))
    goals = targets.select(*leaf, "share_permille", "minimum").withColumn("weight", quota).groupBy(*LEAF).agg(F.max("weight").alias("weight"))
    # one row a target, so one task: no step of the allocation shuffles
    leaves = _handed_down(goals.coalesce(1)).join(found, LEAF, "left").coalesce(1).withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    leaves = leaves.withColumn("own", F.least("quota", "available")).withColumn("taken", F.col("own")).withColumn("unmet", F.col("quota") - F.col("own"))
    leaves = _pass_on(leaves, ["form", "kind"], "from_siblings")
    leaves = _pass_on(leaves, ["form"], "from_cousins")
    leaves = _pass_on(leaves, [], "from_others")
    short = F.col("quota") - (F.col("taken") - F.col("from_siblings") - F.col("from_cousins") - F.col("from_others"))
    return leaves.select(*LEAF, "quota", "available", "own", "from_siblings", "from_cousins", "from_others", F.col("taken").alias("take"), short.alias("short"))


def draw(pairs: DataFrame, plan: DataFrame, *, seed: int = 1, blocks: int = BLOCKS) -> DataFrame:
    """(pair_id, form, kind, scoped): the rows of each leaf whose permuted dense rank is at most its take."""
    return drawn_of(usable_pairs(pairs), plan, seed=seed, blocks=blocks)


def drawn_of(usable: DataFrame, plan: DataFrame, *, seed: int = 1, blocks: int = BLOCKS) -> DataFrame:
    """draw() of what usable_pairs() gave."""
    order = F.xxhash64(F.lit(seed), "pair_id")
    rows = usable.withColumn("order", order).withColumn("block", F.expr(f"pmod(shiftright(`order`, 16), {blocks})"))
    counts = rows.groupBy(*LEAF, "block").agg(F.count("*").alias("here"))
    before = Window.partitionBy(*LEAF).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).join(plan.select(*LEAF, "take"), LEAF).where("before < take")
    inside = Window.partitionBy(*LEAF, "block").orderBy("order", "pair_id")
    ranked = rows.join(starts, [*LEAF, "block"]).withColumn("rank", F.col("before") + F.row_number().over(inside))
    return ranked.where("rank <= take").select("pair_id", *LEAF)
