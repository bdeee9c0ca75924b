"""Joins on keys of which some hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key beyond which it is spread, and the most keys that are: a key is spread beyond total / MOST_HOT rows in
#: any case, so there are never more of them, and what is broadcast is bounded whatever the input.
HOT_ROWS, MOST_HOT = 200_000, 100_000


def hot_keys(counts: DataFrame, keys: list[str], *, n: str = "n", hot_rows: int = HOT_ROWS, most: int = MOST_HOT) -> DataFrame:
    """(keys, salts): the keys of so many rows that they are spread, and over how many salts; at most `most` of them.

    counts has one row per key with its exact number of rows. Null keys are never spread: they join nothing.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0  # one number
    limit = max(hot_rows, -(-total // most))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return counts.where((F.col(n) > limit) & known).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("salts"))


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """big joined with small on keys, where big's hot keys are spread by a hash of its columns `by`.

    small has few rows per key; those of a hot key are repeated for each salt. hot comes from hot_keys(), so its
    broadcast has a proven bound. how is inner, left or left_semi, seen from big.
    """
    salted = lambda rows, value: rows.join(F.broadcast(hot), keys, "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("__salt", value).drop("salts")
    left = salted(big, F.pmod(F.xxhash64(*by), F.col("salts")).cast("int"))
    right = salted(small, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
