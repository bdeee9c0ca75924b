"""A score cutoff per source so that a target fraction of its records is kept, and the sizes that result.

A mergeable KLL sketch per source gives a bracket of scores around the wanted rank. Another pass counts the rows above
the bracket and the rows of each score inside it, from which the exact cutoff, the kept rows and the ties follow. Where
a sketch missed its error bound, or the bracket still holds more rows than one task should sort, the source is
bracketed again. Between heavily tied scores that ends when a bracket no longer narrows: all but about a sixty-fourth
of its rows are then ties with its ends. The result is exact either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.tables import cut

#: Size of a sketch; its rank error is under 0.15 % at 99 % confidence. GRID ranks are read from it, and a bracket
#: reaches MARGIN of them to each side. A bracket of more rows than BRACKET_ROWS is sketched again as long as that narrows it.
SKETCH_K = 2048
GRID = 256
MARGIN = 1
BRACKET_ROWS = 2_000_000


def usable(rows: DataFrame, source: str, score: str) -> DataFrame:
    """(source, score) of rows whose source is not null and whose score is a number from 0 to 1."""
    value = F.col(score).cast("double")
    return rows.select(F.col(source).alias("source"), value.alias("value")).where(F.col("source").isNotNull() & ~F.isnan("value") & F.col("value").between(0, 1))


def cutoffs(rows: DataFrame, targets: DataFrame, *, source: str = "kind", score: str = "score", keep: str = "keep_permille", bracket_rows: int = BRACKET_ROWS, sketch_k: int = SKETCH_K) -> DataFrame:
    """(source, keep_permille, n, cutoff, kept, ties): one row per source with a target.

    cutoff is the largest score present such that 1000 * (rows with that score or more) >= keep * n; kept counts those
    rows and ties the rows with exactly that score. Null, NaN and out-of-range scores are not usable and not counted.
    A source without usable rows, or a target over 1000, has a null cutoff and keeps nothing. A null source or target
    is no target; of a source listed again the largest target holds.
    """
    goals = targets.where(F.col(source).isNotNull() & F.col(keep).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.max(keep).cast("long").alias("keep"))
    scored = usable(rows, source, score).join(goals.select("source"), "source", "left_semi")
    ranks = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    sketch = F.kll_sketch_agg_double("value", F.lit(sketch_k)).alias("sketch")
    need = F.greatest(F.ceil(F.col("keep") * F.col("n") / 1000), F.lit(1))
    whole = scored.groupBy("source").agg(F.count("*").alias("n"), sketch)
    first = whole.join(goals, "source").withColumn("need", need.cast("long"))
    # rank of the wanted row from below, among the rows of the bracket
    bounds = _bracket(first, ranks, F.lit(0), F.col("n"), F.lit(0.0), F.lit(1.0))
    # still: its own sketch didn't narrow it, so its levels are counted as it is
    bounds = cut(bounds.where("need <= n").withColumn("still", F.lit(False)), "bounds")
    while True:
        seen = scored.join(bounds, "source")
        inside = F.col("value").between(F.col("low"), F.col("high"))
        counted = seen.groupBy("source").agg(F.count_if(F.col("value") > F.col("high")).alias("over"), F.count_if(inside).alias("within"), F.kll_sketch_agg_double(F.when(inside, F.col("value")), F.lit(sketch_k)).alias("sketch"))
        state = counted.join(bounds, "source").withColumn("hit", (F.col("over") < F.col("need")) & (F.col("over") + F.col("within") >= F.col("need")))
        state = cut(state, "bracket")
        wide = state.where(~F.col("hit") | ((F.col("within") > bracket_rows) & (F.col("low") < F.col("high")) & ~F.col("still")))
        if wide.isEmpty():
            break
        again = _bracket(state, ranks, F.col("over"), F.col("within"), F.col("low"), F.col("high"))
        missed = state.select("source", "n", "keep", "need", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(False).alias("still"), "hit").where("not hit").drop("hit")
        before = state.select("source", "hit", F.col("low").alias("was_low"), F.col("high").alias("was_high"))
        same = (F.col("low") == F.col("was_low")) & (F.col("high") == F.col("was_high"))
        shrunk = again.join(before, "source").where("hit").withColumn("still", same).drop("hit", "was_low", "was_high")
        bounds = cut(shrunk.unionByName(missed), "bounds")
    inside = F.col("value").between(F.col("low"), F.col("high"))
    levels = scored.join(state.select("source", "low", "high", "over", "need"), "source").where(inside).groupBy("source", "value", "over", "need").agg(F.count("*").alias("ties"))
    down = Window.partitionBy("source").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    reached = levels.withColumn("kept", F.col("over") + F.sum("ties").over(down)).where("kept >= need")
    best = reached.groupBy("source").agg(F.max_by(F.struct("value", "kept", "ties"), "value").alias("best")).select("source", "best.*")
    sizes = whole.select("source", "n").join(goals, "source", "right").join(best, "source", "left")
    zero = F.lit(0).cast("long")
    return sizes.select(F.col("source").alias(source), F.col("keep").alias(keep), F.coalesce("n", zero).alias("n"), F.col("value").alias("cutoff"), F.coalesce("kept", zero).alias("kept"), F.coalesce("ties", zero).alias("ties"))


def _bracket(of: DataFrame, ranks, over, within, low, high) -> DataFrame:
    values = F.kll_sketch_get_quantile_double("sketch", ranks)
    place = F.lit(1.0) - (F.col("need") - over) / within
    below, above = F.floor(place * GRID) - MARGIN, F.ceil(place * GRID) + MARGIN
    pick = lambda i, edge, out: F.when(out, edge).otherwise(F.element_at("grid", F.greatest(F.least(i, F.lit(GRID)), F.lit(0)).cast("int") + 1))
    return of.withColumn("grid", values).select("source", "n", "keep", "need", F.greatest(pick(below, low, below < 0), low).alias("low"), F.least(pick(above, high, above > GRID), high).alias("high"))


def kept(rows: DataFrame, found: DataFrame, *, source: str = "kind", score: str = "score") -> DataFrame:
    """The rows whose source has a cutoff and whose score is usable and at or above it, with their own columns."""
    limits = found.where("cutoff is not null").select(F.col(source).alias("__source"), F.col("cutoff").alias("__cutoff"))
    value = F.col(score).cast("double")
    good = (F.col(source) == F.col("__source")) & ~F.isnan(value) & (value >= F.col("__cutoff")) & (value <= 1)
    return rows.join(limits, good).drop("__source", "__cutoff")
