"""Hierarchical scopes: paths whose segments are separated by slashes.

There are three ways to ask what is reachable from a scope, and they differ for a null. A statement in a scope is
reachable from it and from every scope below it; the test is on whole segments, so _ and % mean themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(ask: Column, scope: Column) -> Column:
    """Whether ask is the scope or lies below it; null if either is."""
    return (ask == scope) | ask.startswith(F.concat(scope, F.lit("/")))


def reach_read(ask: Column, scope: Column) -> Column:
    """Reading: no ask sees everything; an ask sees what holds everywhere and what it lies within."""
    return ask.isNull() | scope.isNull() | within(ask, scope)


def reach_match(ask: Column, scope: Column) -> Column:
    """Matching: what holds everywhere, and what the ask lies within; no ask sees only what holds everywhere."""
    return scope.isNull() | F.coalesce(within(ask, scope), F.lit(False))


def reach_opening(ask: Column, scope: Column) -> Column:
    """Opening: only scoped rows the ask lies within; no ask sees nothing."""
    return F.coalesce(within(ask, scope), F.lit(False))


def ancestors(scope: Column) -> Column:
    """The scope and all scopes above it, longest last; an empty array for null. Turns a prefix join into an equi-join."""
    parts = F.split(scope, "/")
    return F.coalesce(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.array().cast("array<string>"))


def reachable_join(asks: DataFrame, rows: DataFrame, ask: str, scope: str) -> DataFrame:
    """asks joined with the rows reachable for matching, by ancestor equality instead of a prefix condition.

    Two equi-joins: one on the exploded ancestors of the ask, one with the rows that hold everywhere.
    """
    exploded = asks.withColumn("__at", F.explode(F.concat(ancestors(F.col(ask)), F.array(F.lit("\x00")))))
    placed = rows.withColumn("__at", F.coalesce(F.col(scope), F.lit("\x00")))
    return exploded.join(placed, "__at").drop("__at")


def without_excluded(rows: DataFrame, excluded: DataFrame, scope: str) -> DataFrame:
    """Rows whose scope is no excluded scope and not below one; rows without scope stay. excluded has a column scope."""
    exploded = rows.select(scope).where(F.col(scope).isNotNull()).distinct().withColumn("__at", F.explode(ancestors(F.col(scope))))
    hidden = exploded.join(excluded.select(F.col("scope").alias("__at")), "__at", "left_semi").select(F.col(scope).alias("__hidden")).distinct()
    return rows.join(hidden, F.col(scope) == F.col("__hidden"), "left_anti")


def scope_of(places: DataFrame, directories: DataFrame, *, home: str = "home") -> DataFrame:
    """(path, scope_key, scope_kind) of each working directory.

    places has path and home; directories has path and is_repository. From the repository that holds the path (else
    the path itself) up to home, a level is named if it is a repository, an organisation (its parent's name looks like
    a domain and it holds a repository directly) or a forge (its own name looks like a domain). Names are joined from
    the top; the kind is that of the deepest. With none, the scope is the first directory below home, or the last name
    outside of it, of kind directory.
    """
    from quern.functions.text import looks_like_domain

    known = directories.select(F.col("path").alias("level"), "is_repository").groupBy("level").agg(F.max("is_repository").alias("is_repository"))
    held = directories.where("is_repository").select(F.regexp_replace("path", r"/[^/]+\z", "").alias("level"), F.element_at(F.split("path", "/"), -1).alias("child")).where("child not like '.%'").select("level").distinct().withColumn("holds", F.lit(True))
    below = places.select("path", F.col(home).alias("home")).distinct()
    levels = below.withColumn("level", F.explode(ancestors(F.col("path")))).where(F.length("level") > 0)
    inside = (F.length("level") > F.length("home")) & F.col("level").startswith(F.concat(F.col("home"), F.lit("/")))
    levels = levels.join(known, "level", "left").join(held, "level", "left").withColumn("depth", F.length("level"))
    top = levels.where(F.col("is_repository")).groupBy("path", "home").agg(F.max("depth").alias("root"))
    levels = levels.join(top, ["path", "home"], "left").where(inside & (F.col("root").isNull() | (F.col("depth") <= F.col("root"))))
    name = F.element_at(F.split("level", "/"), -1)
    parent = F.element_at(F.split(F.regexp_replace("level", r"/[^/]+\z", ""), "/"), -1)
    kind = F.when(F.col("is_repository"), "repository").when(looks_like_domain(parent) & F.col("holds"), "organisation").when(looks_like_domain(name), "forge")
    named = levels.withColumn("kind", kind).where("kind is not null").withColumn("name", name)
    keyed = named.groupBy("path", "home").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "name"))), lambda x: x["name"]), "/").alias("key"), F.max_by("kind", "depth").alias("kind"))
    rest = F.when(F.col("path") == F.col("home"), F.element_at(F.split("path", "/"), -1)).when(F.col("path").startswith(F.concat(F.col("home"), F.lit("/"))), F.split(F.substring(F.col("path"), F.length("home") + 2, F.length("path")), "/")[0]).otherwise(F.element_at(F.split("path", "/"), -1))
    return below.join(keyed, ["path", "home"], "left").select("path", F.coalesce("key", rest).alias("scope_key"), F.coalesce("kind", F.lit("directory")).alias("scope_kind"))
