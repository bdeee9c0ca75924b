"""Parent-child links to whole hierarchies: root, depth, path, descendants and circles.

The links are cut into fragments of neighbouring ids. Inside a fragment every node is contracted, by pointer
doubling, to the first ancestor outside it. The distinct exits form a much smaller quotient forest, solved the same
way; a quotient small enough for one task is solved in one. Nodes then take root and depth from their exit.

Past the first level a node goes to its parent's fragment when a coin of its id says so and the parent's says
otherwise, which contracts a quarter of the links in expectation whatever the ids look like; children of a parent
with more than a fragment of them stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.tables import cut

#: Nodes of one fragment, and the quotient size that one task solves (48 bytes a node without paths).
FRAGMENT_ROWS = 250_000
QUOTIENT_ROWS = 1_000_000
FRAGMENT = "id long, link long, leads_to long, steps long, last long, low long, circle boolean"


def _contract(pdf: pd.DataFrame, with_paths: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "rootless", "parent"], ascending=[True, False, True]).drop_duplicates("id", ignore_index=True)
    ids, n = pdf["id"].to_numpy(np.int64), len(pdf)
    has, parent = pdf["rootless"].to_numpy(bool), pdf["parent"].to_numpy(np.int64)
    steps, last, low = (pdf[c].to_numpy(np.int64) for c in ("steps", "last", "low"))
    at = np.searchsorted(ids, parent)
    inside = has & (at < n) & (ids[np.minimum(at, n - 1)] == parent) if n else has
    jump = np.where(inside, at, np.arange(n))
    far, least = np.where(inside, steps, 0), np.where(inside, low, np.iinfo(np.int64).max)
    for _ in range(max(1, n).bit_length() + 1):
        least = np.minimum(least, least[jump])
        far = far + far[jump]
        if np.array_equal(jump, jump[jump]):
            break
        jump = jump[jump]
    turning = inside[jump]
    stop = jump
    known = pdf["circle"].to_numpy(bool)[stop]
    circle = turning | known
    out = pd.DataFrame(
        {
            "id": ids,
            "link": pd.Series(parent, dtype="Int64").mask(~has),
            "leads_to": pd.Series(np.where(has[stop] & ~circle, parent[stop], 0), dtype="Int64").mask(~has[stop] | circle),
            "steps": far + steps[stop],
            "last": last[stop],
            "low": np.where(turning, least[stop], np.where(known, low[stop], np.minimum(least, low[stop]))),
            "circle": circle,
        }
    )
    if with_paths:
        own: list = list(pdf["path"])
        whole: list = [None] * n
        for i in range(n):
            if circle[i]:
                whole[i] = []
                continue
            way, j = [], i
            while whole[j] is None:
                way.append(j)
                if not inside[j]:
                    break
                j = at[j]
            if whole[j] is None:
                whole[j] = list(own[j])
                way.pop()
            for k in reversed(way):
                whole[k] = [*own[k], *whole[at[k]]]
        out["path"] = whole
    return out


def _fragments(nodes: DataFrame, with_paths: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            yield _contract(pd.concat(held, ignore_index=True), with_paths)

    # a nullable long would reach pandas as a float
    whole = nodes.select("*", F.col("parent").isNotNull().alias("rootless")).withColumn("parent", F.coalesce("parent", F.lit(0)))
    return whole.mapInPandas(run, FRAGMENT + (", path array<long>" if with_paths else ""))


def _mated(nodes: DataFrame, parts: int, fragment_rows: int, level: int) -> DataFrame:
    coin = lambda c: F.pmod(F.xxhash64(F.lit(level), c), F.lit(2))
    crowded = nodes.groupBy("parent").count().where((F.col("count") > fragment_rows) & F.col("parent").isNotNull()).select("parent", F.lit(True).alias("crowded"))
    mate = F.col("parent").isNotNull() & F.col("crowded").isNull() & (coin(F.col("id")) == 0) & (coin(F.col("parent")) == 1)
    return (
        nodes.join(crowded, "parent", "left")
        .withColumn("fragment_key", F.when(mate, F.col("parent")).otherwise(F.col("id")))
        .repartition(parts, F.xxhash64(F.lit(level), "fragment_key"))
        .select(nodes.columns)
    )


def _solve(nodes: DataFrame, with_paths: bool, fragment_rows: int, quotient_rows: int, level: int) -> DataFrame:
    """(id, link, root, depth, path?) of every id in nodes; a parent that is not among nodes is not there at all."""
    n = nodes.count()
    more = ["path"] if with_paths else []
    if level and n <= quotient_rows:
        parted = nodes.repartition(1)
    elif level:
        parted = _mated(nodes, max(2, -(-n // fragment_rows)), fragment_rows, level)
    else:
        parted = nodes.repartitionByRange(max(1, -(-n // fragment_rows)), "id")
    done = _fragments(parted, with_paths)
    ended = F.when(F.col("circle"), F.col("low")).otherwise(F.col("last"))
    if level and n <= quotient_rows:
        missing = F.col("leads_to").isNotNull().cast("long")
        return done.select("id", "link", ended.alias("root"), F.when(F.col("circle"), F.lit(-1)).otherwise(F.col("steps") - missing).cast("long").alias("depth"), *more)
    done = cut(done, "fragments")
    exits = done.where("leads_to is not null").select(F.col("leads_to").alias("exit")).distinct()
    quotient = done.join(exits, done["id"] == exits["exit"], "left_semi").drop("link").withColumnRenamed("leads_to", "parent")
    above = _solve(cut(quotient, "quotient"), with_paths, fragment_rows, quotient_rows, level + 1)
    above = above.select(F.col("id").alias("leads_to"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), *([F.col("path").alias("up_path")] if with_paths else []))
    local, gone, turns = F.col("leads_to").isNull(), F.col("up_root").isNull(), F.col("up_depth") == -1
    depth = F.when(local, F.when(F.col("circle"), F.lit(-1)).otherwise(F.col("steps"))).when(gone, F.col("steps") - 1).when(turns, F.lit(-1)).otherwise(F.col("steps") + F.col("up_depth"))
    root = F.when(local, ended).when(gone, F.col("last")).otherwise(F.col("up_root"))
    path = [F.when(local | gone, F.col("path")).when(turns, F.array().cast("array<long>")).otherwise(F.concat("path", "up_path")).alias("path")] if with_paths else []
    return done.join(above, "leads_to", "left").select("id", "link", root.alias("root"), depth.cast("long").alias("depth"), *path)


def hierarchy(links: DataFrame, node: str = "id", parent: str = "superseded_by", *, with_paths: bool = False, fragment_rows: int = FRAGMENT_ROWS, quotient_rows: int = QUOTIENT_ROWS) -> DataFrame:
    """(id, parent, root, depth[, path]) of every node.

    root is the last node reached by following parents and depth the number of links to it; a parent that is no node
    is no link. If the way runs into a circle, or the node is on one, root is the least id on the circle, depth is -1
    and path is empty. path lists the node first and its root last. Rows without a node id are left out; of rows
    repeating an id the least non-null parent counts. Other columns are ignored; no rows give no rows.
    """
    of = links.select(F.col(node).cast("long").alias("id"), F.col(parent).cast("long").alias("parent")).where("id is not null")
    nodes = of.select("id", "parent", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("id").alias("last"), F.col("id").alias("low"), F.lit(False).alias("circle"), *([F.array("id").alias("path")] if with_paths else []))
    found = _solve(nodes, with_paths, fragment_rows, quotient_rows, 0)
    return found.withColumnRenamed("link", "parent")


def open_hierarchy(links: DataFrame, node: str = "id", parent: str = "superseded_by", **how: int) -> DataFrame:
    """(id, parent, root, depth, path, beyond): as hierarchy() with paths, following the ways into circles too.

    depth stays -1 there, but path goes on to the root, the least id on the circle, and beyond lists the members of
    the circle that come after the root before the way meets itself; it is empty for all other nodes. path and beyond
    together are all that a node is below, nearest first.
    """
    found = cut(hierarchy(links, node, parent, with_paths=True, **how), "found")
    ways = cut(_opened(found.where("depth = -1"), **how), "ways")
    rings = _members(found, ways).select("root", "members")
    left = F.col("length") - F.size(F.array_intersect("path", "members"))
    turning = ways.select("id", "path", "root").join(rings, "root").withColumn("length", F.size("members"))
    turning = turning.select("id", F.col("path").alias("open"), F.slice("members", F.lit(2), left).alias("rest"))
    nothing = F.array().cast("array<long>")
    return found.join(turning, "id", "left").select("id", "parent", "root", "depth", F.coalesce("open", "path").alias("path"), F.coalesce("rest", nothing).alias("beyond"))


def descendants(found: DataFrame) -> DataFrame:
    """(ancestor, descendant, steps): every pair of a node and one below it, from open_hierarchy().

    On a circle each member is below each other one. From hierarchy(with_paths=True) the pairs of nodes whose way runs
    into a circle are missing, as it gives them no path.
    """
    above = F.concat("path", "beyond") if "beyond" in found.columns else F.col("path")
    return found.select(F.col("id").alias("descendant"), F.posexplode(above).alias("steps", "ancestor")).where("steps > 0").select("ancestor", "descendant", F.col("steps").cast("long").alias("steps"))


def _opened(turning: DataFrame, **how: int) -> DataFrame:
    """hierarchy() with paths of the rows whose way turns, each circle cut open at its least id."""
    opened = turning.select("id", F.when(F.col("id") != F.col("root"), F.col("parent")).alias("parent"))
    return hierarchy(opened, "id", "parent", with_paths=True, **how)


def _members(found: DataFrame, ways: DataFrame) -> DataFrame:
    """(root, length, members) of each circle: the way of the node that the least id links to."""
    start = found.where("depth = -1 and id = root").select(F.col("parent").alias("id"), F.col("root").alias("start"))
    members = F.concat(F.array("start"), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))))
    return ways.join(start, "id").select(F.col("start").alias("root"), F.size(members).cast("long").alias("length"), members.alias("members"))


def circles(links: DataFrame, node: str = "id", parent: str = "superseded_by", **how: int) -> DataFrame:
    """(root, length, members): each circle once, by its least id, its members in link order from the least.

    The rows whose way turns are solved again with each circle cut open at its least id.
    """
    found = cut(hierarchy(links, node, parent, **how).where("depth = -1"), "turning")
    return _members(found, _opened(found, **how))
