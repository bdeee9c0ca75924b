"""Long exact spans that texts share with other texts.

A text is covered by what it shares if some window of LENGTH characters around each place stands in another text too.
Equal windows contain the same anchor at the same place: the GRAM-gram of least hash in them. So:

1. A text is cut into runs, the stretches of windows that have one anchor: a row for about (LENGTH - GRAM) / 2
   characters, with the hashes of its anchor and of all its characters.
2. Count-min sketches tell which anchors may be repeated. The space of hashes is cut into slices that grow in number
   with the input, each with a sketch of its own; partitions send each slice their anchors, a repeated one twice at
   most, and an anchor whose cells are all taken when it comes is estimated repeated. None of two texts is ever missed.
3. Only runs of such anchors are grouped exactly, each first within its partition: the least and the greatest doc_id
   of equal runs tell whether all their windows stand in two texts.
4. Where an anchor has different runs (the ends of what is shared), one text of each different run is cut out, and the
   windows at the same distance from the anchor are compared as text.

No group of equal runs or windows is ever one task's rows: they are combined by least and greatest, and hot runs are
spread where their result is joined back. Nothing is sampled, and no window is lost, since a sketch only overestimates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import skew
from quern.tables import cut

LENGTH = 200
#: Characters of an anchor.
GRAM = 80
#: Anchors of one slice of the hash space, and cells of a row of its sketch for each; rows of a sketch.
SLICE_ANCHORS, CELLS_PER_ANCHOR, ROWS = 1_000_000, 8, 2
#: Most bits of a bitmap that goes to every worker (8 MB), bits for each value, and those that are merged at once. A bitmap
#: that the input has outgrown lets more rows go on to the exact join behind it, and loses none.
MOST_BITS, BITS_PER_VALUE, BLOCK = 1 << 26, 16, 1 << 19
#: Different runs of one anchor beyond which its windows are grouped by Spark rather than within one task.
GROUP_ROWS = 20_000
LOW = np.uint64(0xFFFFFFFF)
BASE, MIX = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
RUN = ["anchor", "h", "n", "lead"]


class Roller:
    """Rolling hashes of windows of texts, by powers that are computed once per worker."""

    def __init__(self, base: int = BASE):
        self.base, self.size = base, 0
        self.up = self.down = np.ones(0, np.uint64)

    def powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(self.size, self.base, np.uint64))
                self.down = np.cumprod(np.full(self.size, pow(self.base, -1, 1 << 64), np.uint64))

    def sums(self, codes: np.ndarray) -> np.ndarray:
        self.powers(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        """A mixed hash of each run of k characters; empty if there is none."""
        n = len(sums) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        h = (sums[k:] - sums[:-k]) * self.down[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


FIRST = Roller()


def codes(text: str, twist: int = MIX) -> np.ndarray:
    """A scrambled 64-bit number for each character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c += np.uint64(1)
    c *= np.uint64(twist)
    c ^= c >> np.uint64(32)
    c *= np.uint64(twist)
    return c


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values, the place of its least one, the first of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # the place rides in the low 32 bits, so that one minimum gives both; ties go to the first in any text alike
    packed = (values & ~LOW) | np.arange(len(values), dtype=np.uint64)
    pad = -len(packed) % width
    blocks = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (least & LOW).astype(np.int64)


def anchored(text: str, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the text the place of its anchor, and the hash of every gram."""
    grams = FIRST.windows(FIRST.sums(codes(text)), gram)
    return least_places(grams, length - gram + 1), grams


def anchors(text: str, length: int, gram: int) -> np.ndarray:
    """The distinct hashes of the anchors of a text."""
    where, grams = anchored(text, length, gram)
    if not len(where):
        return np.empty(0, np.uint64)
    return np.unique(grams[where[np.r_[True, where[1:] != where[:-1]]]])


def runs(text: str, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(at, n, lead, anchor, h) of each run: its first window, its windows, the place of the anchor in it, two hashes."""
    sums = FIRST.sums(codes(text))
    grams = FIRST.windows(sums, gram)
    where = least_places(grams, length - gram + 1)
    at = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])[: len(where)]
    n = np.diff(np.r_[at, len(where)])
    h = (sums[at + n + length - 1] - sums[at]) * FIRST.down[at]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return at, n, where[at] - at, grams[where[at]], h


def cells(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch; width is a power of two."""
    mask = np.uint64(width - 1)
    return [((hashes * np.uint64(m)) >> np.uint64(20) & mask).astype(np.int64) for m in (0x9FB21C651E98DF25, 0xA24BAED4963EE407)][:ROWS]


class Sketch:
    """The cells taken so far, in each row."""

    def __init__(self, width: int):
        self.width = width
        self.taken = np.zeros((ROWS, width), bool)

    def again(self, hashes: np.ndarray) -> np.ndarray:
        """Adds the hashes and gives those estimated to have been there before, here or in an earlier call."""
        distinct, count = np.unique(hashes, return_counts=True)
        there = np.ones(len(distinct), bool)
        for row, at in enumerate(cells(distinct, self.width)):
            there &= self.taken[row, at]
            self.taken[row, at] = True
        return distinct[there | (count > 1)]


def likely_repeated(listed: DataFrame, slices: int, width: int) -> DataFrame:
    """(anchor): those of listed that may stand there more than once, by a sketch of that width for each slice of the hashes."""

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, count = np.unique(pdf["anchor"].to_numpy().view(np.uint64), return_counts=True)
            values = np.concatenate([values, values[count > 1]])
            part = ((values * np.uint64(0xD1342543DE82EF95)) >> np.uint64(33)).astype(np.int64) % slices
            order = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])[: len(order)]
            parts = np.split(values[order], edge[1:])
            if len(order):
                yield pd.DataFrame({"slice": part[order][edge], "anchors": [p.tobytes() for p in parts]})

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, sketch = None, None
        for pdf in batches:
            for number, anchors_ in zip(pdf["slice"], pdf["anchors"]):
                if number != of:
                    of, sketch = number, Sketch(width)  # rows come by slice
                found = sketch.again(np.frombuffer(anchors_, np.uint64))
                if len(found):
                    yield pd.DataFrame({"anchor": found.view(np.int64)})

    parted = listed.select("anchor").mapInPandas(sent, "slice long, anchors binary")
    return parted.repartition("slice").sortWithinPartitions("slice").mapInPandas(told, "anchor long").distinct()


def places(values: np.ndarray, width: int) -> np.ndarray:
    """The bit of each value in a bitmap of that many bits, a power of two."""
    return ((values.view(np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(24) & np.uint64(width - 1)).astype(np.int64)


def bitmap(values: DataFrame, most_bits: int) -> np.ndarray:
    """Packed bits of the values (a column v): merged by tasks in blocks, and at most most_bits / 8 bytes here."""
    width = min(most_bits, max(1 << 12, 1 << (BITS_PER_VALUE * values.count()).bit_length()))
    block = min(BLOCK, width)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(width, bool)
        for pdf in batches:
            bits[places(pdf["v"].to_numpy(), width)] = True
        parts = bits.reshape(-1, block)
        there = np.flatnonzero(parts.any(axis=1))
        if len(there):
            yield pd.DataFrame({"block": there, "bits": [np.packbits(parts[i]).tobytes() for i in there]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at, bits in zip(pdf["block"], pdf["bits"]):
                new = np.frombuffer(bits, np.uint8)
                held[at] = held[at] | new if at in held else new
        if held:
            yield pd.DataFrame({"block": list(held), "bits": [b.tobytes() for b in held.values()]})

    kind = "block long, bits binary"
    out = np.zeros(width // 8, np.uint8)
    for r in values.mapInPandas(local, kind).repartition("block").mapInPandas(merged, kind).toLocalIterator():
        out[r["block"] * (block // 8) :][: block // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def maybe(rows: DataFrame, column: str, values: DataFrame, most_bits: int) -> DataFrame:
    """rows less those whose column (a long) is surely not among values (a column v)."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap(values, most_bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = places(pdf[column].to_numpy(), len(held.value) * 8)
            keep = (held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            if keep.any():
                yield pdf[keep]

    return rows.mapInPandas(run, rows.schema)


def shared_windows(texts: list[str], leads: list[int], least: list[int], greatest: list[int], length: int) -> list[list[int]]:
    """Of each run of one anchor the windows, counted from its first one, that stand in two documents, by their text.

    least and greatest are of the doc_ids that have the run.
    """
    out: list[list[int]] = [[] for _ in texts]
    for back in range(max(leads) + 1):  # characters of the window before the anchor
        seen: dict[str, list] = {}
        for i, text in enumerate(texts):
            at = leads[i] - back
            if at >= 0 and at + length <= len(text):
                known = seen.setdefault(text[at : at + length], [least[i], greatest[i], []])
                known[0], known[1] = min(known[0], least[i]), max(known[1], greatest[i])
                known[2].append((i, at))
        for a, b, places in seen.values():
            if a != b:
                for i, at in places:
                    out[i].append(at)
    return out


def _partly(contexts: DataFrame, length: int, group_rows: int) -> DataFrame:
    """(RUN, windows): of each run in contexts (RUN, a, b, m, context) its windows that stand in two documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf["anchor"] == pdf["anchor"].iloc[-1]
            held = pdf[last]
            yield from told(pdf[~last])
        if held is not None:
            yield from told(held)

    def told(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found = []
        for _, group in pdf.groupby("anchor", sort=False):
            found += shared_windows(group["context"].tolist(), group["lead"].tolist(), group["a"].tolist(), group["b"].tolist(), length)
        if found:
            out = pdf.iloc[np.concatenate([np.asarray(i) for i in pdf.groupby("anchor", sort=False).indices.values()])][RUN].assign(windows=found)
            yield out[out["windows"].str.len() > 0]

    kind = "anchor long, h long, n int, lead int, windows array<int>"
    few = contexts.where(F.col("m") <= group_rows).select(*RUN, "a", "b", "context")
    inside = few.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(run, kind)
    many = contexts.where(F.col("m") > group_rows).withColumn("window", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    text = F.expr(f"substring(context, window + 1, {length})")
    many = many.select(*RUN, "a", "b", "window", (F.col("lead") - F.col("window")).alias("back"), F.md5(text).alias("w1"), F.xxhash64(text).alias("w2"))
    key = ["anchor", "back", "w1", "w2"]
    twice = many.groupBy(*key).agg(F.min("a").alias("least"), F.max("b").alias("greatest")).where("least < greatest").select(*key)
    return inside.unionByName(many.join(twice, key, "left_semi").groupBy(*RUN).agg(F.collect_list("window").alias("windows")))


def shared(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, gram: int = GRAM, slice_anchors: int = SLICE_ANCHORS, cells_per_anchor: int = CELLS_PER_ANCHOR, group_rows: int = GROUP_ROWS, most_bits: int = MOST_BITS, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(doc_id, shared_chars, runs): of each text that shares a span of length characters or more with another doc_id.

    shared_chars counts the characters that lie in some such span, runs their connected stretches. Nothing is
    normalised; characters are code points. Repetition within one text does not count. Rows without id, null texts and
    texts shorter than length share nothing. Of an id with several texts the one that shares most counts. Whole runs are
    compared by two 64-bit hashes, the windows at their ends as text.
    """
    rows = documents.where(F.col(id_col).isNotNull() & (F.length(text_col) >= length)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def find_runs(batches):
        for pdf in batches:
            found = [runs(t, length, gram) for t in pdf["text"]]
            size = [len(f[0]) for f in found]
            if sum(size):
                at, n, lead, anchor, h = (np.concatenate(c) for c in zip(*found))
                yield pd.DataFrame({"doc_id": np.repeat(pdf["doc_id"].to_numpy(), size), "of": np.repeat(pdf["of"].to_numpy(), size), "at": at.astype(np.int32), "n": n.astype(np.int32), "lead": lead.astype(np.int32), "anchor": anchor.view(np.int64), "h": h.view(np.int64)})

    named = rows.withColumn("of", F.xxhash64("text"))
    every = cut(named.mapInPandas(find_runs, "doc_id long, of long, at int, n int, lead int, anchor long, h long"), "runs")
    total = every.count()
    slices = max(1, -(-total // slice_anchors))
    width = 1 << max(6, int(cells_per_anchor * total / slices).bit_length())
    likely = cut(likely_repeated(every, slices, width), "likely")
    # each anchor meets one row; where an anchor has a large share of the runs Spark's skew join splits its side
    some = maybe(every, "anchor", likely.select(F.col("anchor").alias("v")), most_bits)
    repeated = cut(some.join(likely, "anchor", "left_semi"), "repeated")
    different = repeated.groupBy(*RUN).agg(F.min(F.struct("doc_id", "of", "at")).alias("rep"), F.max("doc_id").alias("b"), F.count("*").alias("rows"))
    different = cut(different.select(*RUN, "rep.*", F.col("rep.doc_id").alias("a"), "b", "rows"), "different")
    # runs that stand in one text only, of anchors that others have too, and those others
    mixed = different.groupBy("anchor").agg(F.count("*").alias("m"), F.max(F.col("a") == F.col("b")).alias("alone")).where("m > 1 and alone").select("anchor", "m")
    ends = different.join(mixed, "anchor")
    asked = ends.groupBy("doc_id", "of").agg(F.collect_list(F.struct(*RUN, "at", "a", "b", "m")).alias("asked"))
    asked = cut(asked, "asked")
    some_texts = maybe(named.select("doc_id", "of", "text"), "of", asked.select(F.col("of").alias("v")), most_bits)
    cut_out = some_texts.join(asked, ["doc_id", "of"]).select("text", F.explode("asked").alias("run")).select("run.*", F.expr(f"substring(text, run.at + 1, run.n + {length - 1})").alias("context"))
    partly = _partly(cut_out.dropDuplicates(RUN), length, group_rows)
    whole = different.where("a < b").select(*RUN, F.lit(None).cast("array<int>").alias("windows"))
    partly = partly.join(different.where("a = b").select(*RUN), RUN, "left_semi")
    covers = cut(whole.unionByName(partly), "covers")
    hot_runs = cut(skew.hot_keys(different, RUN, n="rows", hot_rows=hot_rows), "hot")
    hits = skew.spread_join(repeated, covers, RUN, hot_runs, ["doc_id", "at"])

    def cover(batches):
        for pdf in batches:
            chars, stretches = [], []
            for found in pdf["found"]:
                start, end = [], []
                for f in found:
                    if f["windows"] is None:
                        start.append(np.array([f["at"]]))
                        end.append(np.array([f["at"] + f["n"] + length - 1]))
                    else:
                        place = f["at"] + np.asarray(f["windows"], np.int64)
                        start.append(place)
                        end.append(place + length)
                start, end = np.concatenate(start).astype(np.int64), np.concatenate(end).astype(np.int64)
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                fresh = np.maximum(start, np.r_[-1, end[:-1]])
                chars.append(int((end - np.minimum(fresh, end)).sum()))
                stretches.append(int(1 + (start[1:] > end[:-1]).sum()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "shared_chars": chars, "runs": stretches})

    of_text = hits.groupBy("doc_id", "of").agg(F.collect_list(F.struct("at", "n", "windows")).alias("found"))
    covered = of_text.mapInPandas(cover, "doc_id long, shared_chars long, runs long")
    return covered.groupBy("doc_id").agg(F.max(F.struct("shared_chars", "runs")).alias("most")).select("doc_id", "most.*")
