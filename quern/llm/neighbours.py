"""The most similar vectors of every vector, by cross-polytope hashing.

Unit vectors go through pseudo-rotations (rounds of random signs and a fast Hadamard transform). Each run of AXES
rotated coordinates is a table: a vector stands in the buckets of the PROBES signed axes nearest to it, so two vectors
are candidates if they share any. Within a bucket, BITS sign bits sort out far pairs, and the distinct pairs that are
left are ranked by the exact cosine of the stored vectors. How many tables there are, and how many bits may differ,
follows from the least cosine that is asked for: a pair of just that cosine is missed with a chance of about MISSED.

It is one method at any size. A bucket of more than BUCKET_ROWS rows is compared by pairs of slices, a group each.
With AXES = 128 a bucket holds about a 85th of a block in each table; depth takes so many runs of coordinates together,
which makes buckets a power smaller for more tables, and changes no result but for the pairs that chance misses.

Exact copies (same block, scope and vector) are one class: only the least id of it is hashed, and a class offers its
least K + 1 ids, which are all that can be among the K most similar of any vector when ties go to the smaller id.

Below a cosine of LEAST the chance of a shared bucket is too small, and similar() asks for exact=True: nearest(), by
matrix products over tiles of a block, quadratic in the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import skew
from quern.tables import cut

K = 10
AXES = 128
PROBES = 3
SEED = 20
#: Chance that a pair of the least cosine shares no bucket; the least cosine of the hashed search; pairs it is simulated with.
MISSED, LEAST, SIMULATED = 1e-4, 0.5, 20_000
#: Sign bits, and how many standard deviations more than expected may differ.
BITS, DEVIATIONS = 192, 4.6
#: Pairs compared in memory at once.
CHUNK = 2_000_000
#: Rows of a bucket beyond which it is cut into slices.
BUCKET_ROWS = 50_000
#: Pairs whose vectors one task holds.
GROUP_PAIRS = 20_000
#: Vectors of one tile of the exact search, and cosines it holds at once.
TILE, CELLS = 8_192, 2_000_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, width, h = *x.shape, 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width) / np.float32(np.sqrt(width))


def rotations(unit: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """Pseudo-rotations of the rows without end, the same ones for the same seed: three rounds, then one more for each."""
    width = max(AXES, 1 << max(0, unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), width), np.float32)
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng(seed)
    turn = lambda: hadamard(x * rng.choice(np.array([-1, 1], np.float32), width))
    x = turn()
    x = turn()
    while True:
        x = turn()
        yield x


def signs(turns: Iterator[np.ndarray]) -> np.ndarray:
    """BITS sign bits of each row as words, from as many rotations as they take."""
    parts = [next(turns) > 0]
    while sum(p.shape[1] for p in parts) < BITS:
        parts.append(next(turns) > 0)
    return np.packbits(np.concatenate(parts, axis=1)[:, :BITS], axis=1).view(np.uint64).view(np.int64)


def nearest_axes(x: np.ndarray, probes: int) -> np.ndarray:
    """The signed axes nearest to each row, nearest first; 2 * axis + 1 for the positive one."""
    size = np.abs(x)
    top = np.argpartition(size, -probes, axis=1)[:, -probes:]
    order = np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable")
    top = np.take_along_axis(top, order, 1)
    return 2 * top + (np.take_along_axis(x, top, 1) > 0)


@lru_cache
def tables_for(least: float, probes: int, depth: int) -> int:
    """Tables after which a pair of that cosine has met with a chance of 1 - MISSED, by simulated rotated coordinates."""
    rng = np.random.default_rng(SEED)
    a, b = rng.normal(size=(2, SIMULATED, AXES))
    b = least * a + np.sqrt(1 - least * least) * b
    a, b = nearest_axes(a, probes), nearest_axes(b, probes)
    meet = float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean()) ** depth
    return 1 if meet >= 1 else int(np.ceil(np.log(MISSED) / np.log(1 - meet)))


def bits_apart(least: float) -> int:
    """Sign bits in which a pair of that cosine may differ."""
    share = np.arccos(min(least, 1.0)) / np.pi
    return int(BITS * share + DEVIATIONS * np.sqrt(BITS * share * (1 - share)))


def vectors(rows: DataFrame, *, id_col: str, vector: str, blocks: list[str], scope: str) -> DataFrame:
    """(id, block, scope, vec): usable rows. Null, empty, all-zero and non-finite vectors, null ids and null blocks take no part.

    block is a hash of the block columns and the length of the vector; vec its floats as bytes.
    """

    def pack(batches):
        for pdf in batches:
            yield pdf.assign(vec=[np.asarray(v, np.float32).tobytes() for v in pdf["vec"]])

    good = F.lit(True)
    for c in [id_col, vector, *blocks]:
        good = good & F.col(c).isNotNull()
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    named = rows.where(good & sound).select(*[F.col(c) for c in dict.fromkeys([id_col, vector, scope, *blocks])])
    named = named.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(*blocks, F.size(vector)).alias("block"), F.col(scope).cast("string").alias("scope"), F.col(vector).cast("array<float>").alias("vec"))
    return named.mapInPandas(pack, "id long, block long, scope string, vec binary")


def _hashed(reps: DataFrame, tables: int, probes: int, depth: int, seed: int) -> DataFrame:
    """(key, place, id, a, b, c): one row for each bucket a vector stands in, with its scope (0 for none) and sign bits."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            lengths = pdf["vec"].str.len().to_numpy()
            for length in np.unique(lengths):
                part = pdf[lengths == length]
                unit = np.frombuffer(b"".join(part["vec"]), np.float32).reshape(len(part), -1).astype(np.float64)
                unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
                ids, block = part["id"].to_numpy(), part["block"].to_numpy().view(np.uint64)
                place = pd.util.hash_array(part["scope"].fillna("").to_numpy(object), categorize=True) >> np.uint64(33) | np.uint64(1)
                place = np.where(part["scope"].isna(), 0, place).astype(np.int32)
                turns = rotations(unit, seed)
                a, b, c = signs(turns).T
                x, at = next(turns), 0
                for table in range(tables):
                    axes = []
                    for _ in range(depth):
                        if at + AXES > x.shape[1]:
                            x, at = next(turns), 0
                        axes.append(nearest_axes(x[:, at : at + AXES], probes).astype(np.uint64))
                        at += AXES
                    for chosen in product(range(probes), repeat=depth):
                        key = block + np.uint64(table + 1) * np.uint64(0x9E3779B97F4A7C15)
                        for own, p in zip(axes, chosen):
                            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + own[:, p]
                        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                        # keys that are equal by chance only add candidates
                        yield pd.DataFrame({"key": (key >> np.uint64(32)).astype(np.uint32).view(np.int32), "place": place, "id": ids, "a": a, "b": b, "c": c})

    return reps.mapInPandas(run, "key int, place int, id long, a long, b long, c long")


def _near(rows: pd.DataFrame, apart: int) -> Iterator[pd.DataFrame]:
    """Pairs of comparable rows of a bucket that differ in few bits; rows are sorted by bucket, then scope, none first."""
    key, salt, place, ids = (rows[c].to_numpy() for c in ("key", "salt", "place", "id"))
    words = [rows[c].to_numpy().copy().view(np.uint64) for c in "abc"]  # bits of a negative number would be counted of its absolute value
    fresh = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
    edge, group = np.flatnonzero(fresh), np.flatnonzero(fresh | np.r_[True, place[1:] != place[:-1]])
    at = np.arange(len(key))
    # a row without a scope meets all after it in the bucket, one with a scope those of its own
    end = np.where(place == 0, np.r_[edge[1:], len(key)][np.searchsorted(edge, at, "right") - 1], np.r_[group[1:], len(key)][np.searchsorted(group, at, "right") - 1])
    count = end - at - 1
    start = 0
    while start < len(at):
        total = np.cumsum(count[start:])
        stop = start + max(1, int(np.searchsorted(total, CHUNK, "right")))
        n = count[start:stop]
        left = np.repeat(at[start:stop], n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + left + 1
        differ = np.zeros(len(left), np.int16)
        for w in words:
            differ += np.bitwise_count(w[left] ^ w[right])
        close = differ <= apart
        x, y = ids[left[close]], ids[right[close]]
        pair = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})
        yield pair[pair["a"] < pair["b"]].drop_duplicates()
        start = stop


def _sliced(hashed: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows with a salt: a bucket of more than bucket_rows rows is cut into slices, and each two of them are one salt's rows.

    Which buckets are, is counted exactly. As hot keys they are at most skew.MOST_HOT, each of over so large a share
    of the rows; a slice of those holds that share.
    """
    hot = cut(skew.hot_keys(hashed.groupBy("key").agg(F.count("*").alias("n")), ["key"], hot_rows=bucket_rows), "crowded")
    spread = hashed.join(F.broadcast(hot), "key", "left").withColumn("slices", F.coalesce("salts", F.lit(1)))  # at most skew.MOST_HOT rows
    mine = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
    with_ = F.explode(F.when(F.col("slices") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda i: i != F.col("slice"))))
    spread = spread.withColumn("slice", mine).withColumn("with", with_)
    return spread.withColumn("salt", F.least("slice", "with") * F.col("slices") + F.greatest("slice", "with")).select(*hashed.columns, "salt")


def candidates(reps: DataFrame, *, least: float = 0.8, tables: int | None = None, probes: int = PROBES, depth: int = 1, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b), a < b: distinct pairs of ids that share a bucket and differ in few sign bits."""
    apart = bits_apart(least)

    def run(batches):
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf["key"].to_numpy() == pdf["key"].iloc[-1]) & (pdf["salt"].to_numpy() == pdf["salt"].iloc[-1])
            held, whole = pdf[last], pdf[~last]  # a bucket may go on in the next batch
            if len(whole):
                yield from _near(whole, apart)
        if held is not None and len(held):
            yield from _near(held, apart)

    hashed = _sliced(cut(_hashed(reps, tables or tables_for(least, probes, depth), probes, depth, seed), "hashed"), bucket_rows)
    return hashed.repartition("key", "salt").sortWithinPartitions("key", "salt", "place").mapInPandas(run, "a long, b long").distinct()


def _cosines(pairs: DataFrame, named: DataFrame, group_pairs: int) -> DataFrame:
    """(a, b, cosine): the exact cosines of pairs that are comparable.

    A pair goes to the group of the least id that its a is paired with, so that the vectors of a cluster meet there once
    each rather than once a pair. A group of more than group_pairs pairs is cut into tiles by both ends of its pairs.
    """
    both = pairs.union(pairs.select("b", "a"))
    heads = both.groupBy("a").agg(F.least("a", F.min("b")).alias("head"))
    grouped = cut(pairs.join(heads, "a"), "grouped")
    hot = cut(skew.hot_keys(grouped.groupBy("head").agg(F.count("*").alias("n")), ["head"], hot_rows=group_pairs), "hot")
    tiles = grouped.join(F.broadcast(hot), "head", "left").withColumn("side", F.ceil(F.sqrt(F.coalesce("salts", F.lit(1)))).cast("int"))  # at most skew.MOST_HOT rows
    place = lambda c: F.pmod(F.xxhash64(c), F.col("side"))
    tiles = cut(tiles.select("a", "b", "head", (place("a") * F.col("side") + place("b")).alias("tile")), "tiles")
    needed = tiles.select("head", "tile", F.col("a").alias("id")).union(tiles.select("head", "tile", "b")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    sent = named.join(needed, "id").select("head", "tile", F.lit(False).alias("pair"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "block", "scope", "vec")
    wanted = tiles.select("head", "tile", F.lit(True).alias("pair"), "a", "b", F.lit(0).cast("long").alias("block"), none("string").alias("scope"), none("binary").alias("vec"))
    along = ["head", "tile", "pair", "a"]

    def run(batches):
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = ((pdf["head"] == pdf["head"].iloc[-1]) & (pdf["tile"] == pdf["tile"].iloc[-1])).to_numpy()
            held, whole = pdf[last], pdf[~last]  # a group may go on in the next batch
            if len(whole):
                yield _measured(whole)
        if held is not None:
            yield _measured(held)

    met = sent.unionByName(wanted).repartition("head", "tile").sortWithinPartitions(*along)
    return met.mapInPandas(run, "a long, b long, cosine double")


def _measured(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b, cosine) of the comparable pairs of whole groups, whose vectors come before their pairs, by id."""
    group = np.cumsum(np.r_[0, (rows["head"].to_numpy()[1:] != rows["head"].to_numpy()[:-1]) | (rows["tile"].to_numpy()[1:] != rows["tile"].to_numpy()[:-1])])
    pair = rows["pair"].to_numpy(bool)
    y, x = rows[~pair], rows[pair]
    at = pd.MultiIndex.from_arrays([group[~pair], y["a"]])
    first = ~at.duplicated()
    y, at = y[first], at[first]
    i, j = (at.get_indexer(pd.MultiIndex.from_arrays([group[pair], x[c]])) for c in "ab")
    block, scope = y["block"].to_numpy(), pd.factorize(y["scope"])[0]  # -1 for none
    good = (block[i] == block[j]) & ((scope[i] == scope[j]) | (scope[i] < 0) | (scope[j] < 0))
    i, j = i[good], j[good]
    value = np.empty(len(i))
    lengths = y["vec"].str.len().to_numpy()
    for length in np.unique(lengths):
        of = np.flatnonzero(lengths == length)
        v = np.frombuffer(b"".join(y["vec"].iloc[of]), np.float32).reshape(len(of), -1).astype(np.float64)
        mine = lengths[i] == length  # a block has one length
        p, q = v[np.searchsorted(of, i[mine])], v[np.searchsorted(of, j[mine])]
        value[mine] = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
    return pd.DataFrame({"a": x["a"].to_numpy()[good], "b": x["b"].to_numpy()[good], "cosine": value})


def similar(rows: DataFrame, *, id_col: str = "id", vector: str = "embedding", blocks: tuple[str, ...] = ("embedding_model", "kind"), scope: str = "scope_key", k: int = K, least: float = 0.8, exact: bool = False, group_pairs: int = GROUP_PAIRS, **how: int) -> DataFrame:
    """(id, other, cosine, place): for every usable row its most similar comparable rows, at most k, of cosine >= least.

    Rows are comparable if all block columns are equal and not null and the scopes are equal or one or both are null.
    place counts from 1, by falling cosine, ties to the smaller id. Ids are unique; of rows repeating an id any one
    counts. Pairs of the least cosine are found with a chance over 1 - MISSED each, closer ones more surely. exact=True
    compares all vectors of a block instead, and is the only way below a cosine of LEAST.
    """
    if exact:
        return nearest(rows, id_col=id_col, vector=vector, blocks=blocks, scope=scope, k=k).where(F.col("cosine") >= least)
    if least < LEAST:
        raise ValueError(f"hashing finds cosines of {LEAST} and over; exact=True finds any")
    named = cut(vectors(rows, id_col=id_col, vector=vector, blocks=list(blocks), scope=scope), "vectors")
    same = [F.col("block"), F.col("scope"), F.xxhash64("vec").alias("h1"), F.expr("md5(vec)").alias("h2")]
    copies = named.select("id", *same)
    classes = copies.groupBy("block", "scope", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    # classes of one row need no list of copies
    many = cut(classes.where("n > 1"), "classes")
    same_class = F.concat_ws("|", F.col("block").cast("string"), F.coalesce(F.concat(F.lit("="), "scope"), F.lit("none")), F.col("h1").cast("string"), "h2").alias("same")
    large = many.select(same_class, "rep", "n")
    in_class = skew.spread_join(copies.select("id", same_class), large.select("same", "rep"), ["same"], skew.hot_keys(large.select("same", "n"), ["same"]), ["id"])
    in_class = cut(in_class.select("id", "rep"), "copies")
    reps = named.join(in_class.where("id <> rep").select("id"), "id", "left_anti")
    pairs = cut(candidates(reps, least=least, **how), "pairs")
    near = _cosines(pairs, named, group_pairs).where(F.col("cosine") >= least)
    near = cut(near, "cosines")
    links = near.select(F.col("a").alias("from"), F.col("b").alias("to"), "cosine").union(near.select("b", "a", "cosine"))
    if not many.isEmpty():
        own = many.select(F.col("rep").alias("from"), F.col("rep").alias("to"), F.lit(1.0).alias("cosine"))
        # the least k + 1 ids of each class stand for it
        least_ids = Window.partitionBy("rep").orderBy("id")
        offered = in_class.withColumn("nth", F.row_number().over(least_ids)).where(F.col("nth") <= k + 1).select(F.col("rep").alias("to"), F.col("id").alias("member"))
        links = links.union(own).join(offered, "to", "left").select("from", F.coalesce("member", "to").alias("to"), "cosine")
        by_class = Window.partitionBy("from").orderBy(F.desc("cosine"), "to")
        links = links.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1).drop("nth")
        # every copy takes over the links of its class, one row of at most k + 1 of them
        listed = links.groupBy("from").agg(F.collect_list(F.struct("to", "cosine")).alias("links"))
        shared = listed.join(many.select(F.col("rep").alias("from")), "from", "left_semi").withColumnRenamed("from", "rep")
        taken = skew.spread_join(in_class, shared, ["rep"], skew.hot_keys(many.select("rep", "n"), ["rep"]), ["id"])
        own_links = links.join(many.select(F.col("rep").alias("from")), "from", "left_anti")
        links = taken.select(F.col("id").alias("from"), F.inline("links")).unionByName(own_links).where(F.col("from") != F.col("to"))
    best = Window.partitionBy("from").orderBy(F.desc("cosine"), "to")
    ranked = links.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= k)
    return ranked.select(F.col("from").alias("id"), F.col("to").alias("other"), "cosine", "place")


def _best(x: pd.DataFrame, y: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """(id, other, cosine): of each row of x its k most similar comparable rows of y, ties to the smaller id."""
    y = y.sort_values("id")
    ids, others = x["id"].to_numpy(), y["id"].to_numpy()
    p, q = (np.frombuffer(b"".join(z["vec"]), np.float32).reshape(len(z), -1).astype(np.float64) for z in (x, y))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    codes = pd.factorize(pd.concat([x["scope"], y["scope"]]))[0]  # -1 for null
    a, b = codes[: len(x)], codes[len(x) :]
    step = max(1, CELLS // len(y))
    for s in range(0, len(x), step):
        # copies of a vector may differ in the last bit of a product
        cosine = np.round(p[s : s + step] @ q.T, 12)
        mine = a[s : s + step, None]
        cosine[((mine != b) & (mine >= 0) & (b >= 0)) | (ids[s : s + step, None] == others)] = -np.inf
        keep = np.isfinite(cosine)
        if len(y) > k:
            edge = np.partition(cosine, -k, axis=1)[:, -k, None]
            over, tied = cosine > edge, cosine == edge
            keep &= over | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - over.sum(axis=1, keepdims=True)))
        at, to = np.nonzero(keep)
        yield pd.DataFrame({"id": ids[s + at], "other": others[to], "cosine": cosine[at, to]})


def nearest(rows: DataFrame, *, id_col: str = "id", vector: str = "embedding", blocks: tuple[str, ...] = ("embedding_model", "kind"), scope: str = "scope_key", k: int = K, tile: int = TILE) -> DataFrame:
    """(id, other, cosine, place): for every usable row its k most similar comparable rows, whatever their cosine.

    Rows are comparable as in similar(), place counts as there; a row with fewer than k comparable ones has all of
    them. Exact. Ids are unique. A block is cut into tiles of about tile rows, every pair of tiles is one group's work.
    """
    named = cut(vectors(rows, id_col=id_col, vector=vector, blocks=list(blocks), scope=scope), "vectors")
    sizes = named.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = named.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("id", "block", "scope", "vec", "tile", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["tile"] == pdf[c].iloc[0]] for c in ("i", "j"))
        parts = [pd.DataFrame({"id": np.empty(0, np.int64), "other": np.empty(0, np.int64), "cosine": np.empty(0)})]
        if len(x) and len(y):
            parts += _best(x, y, k)
            parts += _best(y, x, k) if pdf["i"].iloc[0] != pdf["j"].iloc[0] else []
        return pd.concat(parts, ignore_index=True)

    found = met.groupBy("block", "i", "j").applyInPandas(run, "id long, other long, cosine double")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return found.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= k)


def close_pairs(found: DataFrame) -> DataFrame:
    """(memory_id_a, memory_id_b), a < b: each pair of similar() once, whichever of the two found the other."""
    return found.select(F.least("id", "other").alias("memory_id_a"), F.greatest("id", "other").alias("memory_id_b")).distinct()
