"""The newest rows before a moment, over several groups each, for many moments at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a slice of time, the most slices, and candidates that are sorted at once.
ROWS, MOST, AT_ONCE = 10_000, 2_000, 2_000_000


def newest_before(asked: DataFrame, held: DataFrame, limit: int) -> DataFrame:
    """(prompt_id, memory_id, at, number): the newest rows of held in any of keys, strictly before each row of asked.

    asked has prompt_id, keys (different strings) and at (long); held has key, memory_id (long) and at; no key or at is
    null. Newest first, of equal ones the greater memory_id, null last; numbered from 1, at most limit for each row.

    Time is cut into slices of equal numbers of rows, and a slice is one task's work: what was held in it, and of each
    key asked for in it the last `limit` rows held before, which are carried forward slice by slice. An instant that
    fills several slices is one, and what is asked in it is spread over as many tasks.
    """
    n, cuts = asked.select("at").union(held.select("at")).agg(F.count("*"), F.percentile_approx("at", [i / MOST for i in range(1, MOST)], 10_000)).first()  # one row
    slices = max(1, min(MOST, -(-n // ROWS)))
    starts = [cuts[i * MOST // slices - 1] for i in range(1, slices)]
    lows = sorted(set(starts))
    crowded = [(i + 1, c) for i, (_, c) in enumerate(sorted(Counter(starts).items())) if c > 1]

    @F.pandas_udf("int")
    def slice_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(lows, np.int64), at.to_numpy(), side="right").astype(np.int32))

    tasks = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in crowded for x in pair]), F.col("slice")), F.lit(1)) if crowded else F.lit(1)
    asked = asked.select("prompt_id", "keys", "at", slice_of("at").alias("slice"))
    # all of an instant is before a moment, or nothing
    instant = Window.partitionBy("key", "at").orderBy(F.desc("memory_id"))
    held = held.withColumn("nth", F.row_number().over(instant)).where(F.col("nth") <= limit).withColumn("slice", slice_of("at"))
    held = held.groupBy("key", "slice").agg(F.sort_array(F.collect_list(F.struct("at", "memory_id"))).alias("held")).select("key", "slice", F.col("held.at").alias("ats"), F.col("held.memory_id").alias("ids"))

    last = lambda c: F.when(F.size(c) > limit, F.slice(c, -limit, limit)).otherwise(F.col(c)).alias(c)
    none = F.array().cast("array<long>")
    wanted = asked.select(F.explode("keys").alias("key"), "slice").distinct().select("key", "slice", none.alias("ats"), none.alias("ids"), F.lit(True).alias("wanted"))
    both = held.select("key", "slice", last("ats"), last("ids"), F.lit(False).alias("wanted")).union(wanted)
    both = both.groupBy("key", "slice").agg(F.max("wanted").alias("wanted"), F.flatten(F.collect_list("ats")).alias("ats"), F.flatten(F.collect_list("ids")).alias("ids"))
    ordered = both.repartition("key").sortWithinPartitions("key", "slice")
    carried = ordered.mapInArrow(_carry(limit), held.schema)

    parts = 3 * slices
    spread = held.union(carried).withColumn("part", F.explode(F.sequence(F.lit(0), tasks - 1))) if crowded else held.union(carried).withColumn("part", F.lit(0))
    left = asked.withColumn("part", F.pmod(F.xxhash64("prompt_id"), tasks).cast("int")).repartition(parts, "slice", "part")
    right = spread.repartition(parts, "slice", "part")
    schema = T.StructType([asked.schema["prompt_id"], *[T.StructField(c, T.LongType()) for c in ("memory_id", "at", "number")]])
    return left.groupBy("slice", "part").cogroup(right.groupBy("slice", "part")).applyInArrow(_pick(limit), schema)


def _carry(limit: int):
    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of key and slice: what each wanted slice finds held before it."""
        schema = pa.schema([("key", pa.string()), ("slice", pa.int32()), ("ats", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])
        of, ats, ids = None, [], []
        for batch in batches:
            out = []
            for key, piece, wanted, more, others in zip(*[batch.column(c).to_pylist() for c in ("key", "slice", "wanted", "ats", "ids")]):
                if key != of:
                    of, ats, ids = key, [], []
                if wanted and ats:
                    out.append((key, piece, ats, ids))
                ats, ids = (ats + more)[-limit:], (ids + others)[-limit:]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return carry


def _pick(limit: int):
    def pick(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The newest `limit` before each row of asked, of what is held in its keys."""
        one = lambda table, c: table.column(c).combine_chunks()
        prompts, lists = one(asked, "prompt_id"), one(held, "ats")
        at, ids = lists.flatten().to_numpy(), one(held, "ids").flatten()
        given = lambda owner, row, number: pa.table({"prompt_id": prompts.take(pa.array(owner)), "memory_id": ids.take(pa.array(row)), "at": pa.array(at[row]), "number": pa.array(number)})
        nothing = np.empty(0, np.int64)
        if not len(at):
            return given(nothing, nothing, nothing)
        named = one(held, "key").dictionary_encode()
        code = np.repeat(named.indices.to_numpy().astype(np.int64), lists.value_lengths().to_numpy())
        # oldest first, over all keys and within each
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), at))
        age = np.empty(len(at), np.int64)
        age[order] = np.arange(len(at))
        by_key = np.lexsort((age, code))
        first = np.searchsorted(code[by_key], np.arange(len(named.dictionary)))
        instants = np.unique(at)
        spot = code[by_key] * (len(instants) + 1) + np.searchsorted(instants, at[by_key])

        keys = one(asked, "keys")
        key = pc.index_in(keys.flatten(), value_set=named.dictionary).fill_null(-1).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(prompts)), keys.value_lengths().to_numpy())
        owner, key = owner[key >= 0], key[key >= 0]
        before = np.searchsorted(instants, one(asked, "at").to_numpy())[owner]
        end = np.searchsorted(spot, key * (len(instants) + 1) + before)
        begin = np.maximum(first[key], end - limit)
        many = end - begin

        out, total, i = [], np.cumsum(many), 0
        while i < len(owner):
            j = int(np.searchsorted(total, (total[i - 1] if i else 0) + AT_ONCE, side="right"))
            if j < len(owner):  # a prompt's candidates stay together
                j = int(np.searchsorted(owner, owner[j]) if owner[j] > owner[i] else np.searchsorted(owner, owner[i], side="right"))
            n = many[i:j]
            at_key = np.repeat(begin[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())
            best = np.sort(np.repeat(owner[i:j], n) * len(at) + (len(at) - 1 - age[by_key[at_key]]))
            whose, row = best // len(at), order[len(at) - 1 - best % len(at)]
            number = np.arange(1, len(best) + 1) - np.searchsorted(whose, whose)
            kept = number <= limit
            out.append(given(whose[kept], row[kept], number[kept]))
            i = j
        return pa.concat_tables(out) if out else given(nothing, nothing, nothing)

    return pick
