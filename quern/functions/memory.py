"""Column builders over statements: liveness in two times, worth by age, similarity, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values by kind: weight, half-life in days, floor; threshold of a reading; lasting tier; whether it is a stated rule.
KINDS = {
    "preference": (1.0, 90.0, 0.6, 0.85, 2, True),
    "correction": (1.0, 90.0, 0.6, 0.70, 2, True),
    "semantic": (0.9, 90.0, 0.6, 0.80, 2, False),
    "procedural": (0.9, 90.0, 0.6, 0.80, 2, False),
    "praise": (0.5, 30.0, 0.0, 0.80, 0, False),
    "prospective": (0.4, 14.0, 0.0, 0.85, 1, False),
}
OTHER = (0.1, 90.0, 0.0)


def by_kind(kind: Column, at: int, otherwise: Column | None = None) -> Column:
    """The fixed value of a kind; a literal map, so that no join is needed."""
    values = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[at])])
    found = F.try_element_at(values, kind)
    return found if otherwise is None else F.coalesce(found, otherwise)


def worth(kind: Column, said_at: Column, created_at: Column, now: Column) -> Column:
    """weight * (floor + (1 - floor) * 0.5 ^ (age / half-life)); age from said_at else created_at, not below 0."""
    days = F.greatest((F.unix_micros(now) - F.unix_micros(F.coalesce(said_at, created_at))) / F.lit(86_400e6), F.lit(0.0))
    weight, half, floor = (by_kind(kind, i, F.lit(OTHER[i])) for i in range(3))
    return weight * (floor + (1 - floor) * F.pow(F.lit(0.5), days / half))


def live() -> Column:
    return F.col("superseded_by").isNull() & F.col("ended_at").isNull()


def live_at(moment: Column, now: Column, by_said_at: bool = False) -> Column:
    """Whether a statement stood at the moment, with SQL's three values.

    As stored: retired and ended not before or at it, created by it; a null moment means as of now. By what was said:
    live today and said before the moment, which a null moment never is. Either way its own term has not run out.
    """
    term = F.col("until_moment").isNull() | (F.col("until_moment") > F.coalesce(moment, now))
    if by_said_at:
        return live() & (F.col("said_at") < moment) & term
    stood = F.col("superseded_by").isNull() | (F.col("superseded_at") > moment)
    ended = F.col("ended_at").isNull() | (F.col("ended_at") > moment)
    return stood & ended & (moment.isNull() | (F.col("created_at") <= moment)) & term


def actionable(threshold: float = 0.6) -> Column:
    """A null passes."""
    return F.col("actionable").isNull() | (F.col("actionable").cast("double") >= threshold)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double; null if either is null or all zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def firing(scores: dict[str, Column]) -> Column:
    """The kinds whose score reaches their own threshold, in fixed order."""
    return F.array_compact(F.array(*[F.when(scores[k].cast("double") >= KINDS[k][3], F.lit(k)) for k in KINDS if k in scores]))


def best_kind(scores: dict[str, Column]) -> Column:
    """The kind of highest score, the first of equals in fixed order."""
    ranked = F.array(*[F.struct(c.cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, (k, c) in enumerate(scores.items())])
    return F.array_max(ranked)["kind"]
