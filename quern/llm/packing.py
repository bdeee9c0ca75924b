"""Texts packed into containers of a fixed number of tokens, along a space-filling curve.

Every text is encoded, and its tokens, hashed to random directions, give it a vector of a few dimensions. The texts are
range-sorted by the Hilbert key of that vector, so that neighbours along the curve use similar words, and each range is
packed in curve order: an item goes to the fullest open container that still holds it. A text larger than a container
is cut into whole containers and a rest, and only such a text is.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import Encoder, default_vocabulary
from quern.tables import cut

CAPACITY = 3072
DIMENSIONS, BITS = 3, 16
#: Containers open at once along the curve; of more, the fullest is closed. Texts in one range of the curve.
OPEN = 512
RANGE_ROWS = 50_000


def directions(count: int, seed: int = 9) -> np.ndarray:
    """A random direction for each hashed token id."""
    return np.random.default_rng(seed).normal(size=(count, DIMENSIONS)).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place along the Hilbert curve of each row of cell numbers below 2 ** bits."""
    x = [c.astype(np.int64).copy() for c in cells.T]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(set_, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def measured(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, tokens, curve): the size of each text and its place along the curve; an empty text has 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(vocabulary or default_vocabulary())
        table = directions(65_536)
        for pdf in batches:
            ids, ends = encoder.flat(list(pdf["text"]))
            sizes = np.diff(ends, prepend=0)
            flat = np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32)
            vectors = np.zeros((len(pdf), DIMENSIONS))
            full = np.flatnonzero(sizes)
            if len(full):
                starts = (ends - sizes)[full]
                for c in range(DIMENSIONS):
                    vectors[full, c] = np.add.reduceat(table[flat % len(table), c].astype(np.float64), starts)
            vectors /= np.sqrt(np.maximum(sizes, 1))[:, None]
            # the sums are near normal; their distribution function spreads them over the cells
            spread = 1 / (1 + np.exp(-1.702 * np.clip(vectors / 2, -20, 20)))
            cells = np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": sizes, "curve": hilbert(cells)})

    rows = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, tokens long, curve long")


def pack(sizes: list[int], capacity: int, most_open: int = OPEN) -> list[list[tuple[int, int]]]:
    """For each item its pieces as (container, tokens), items in order; containers are numbered from 0."""
    out, open_, n = [], [], 0  # open_: (room left, container), sorted
    for size in sizes:
        pieces = []
        while size >= capacity:
            pieces.append((n, capacity))
            n, size = n + 1, size - capacity
        if size:
            at = bisect_left(open_, (size, -1))
            if at < len(open_):
                room, where = open_.pop(at)
            else:
                room, where, n = capacity, n, n + 1
                if len(open_) >= most_open:
                    open_.pop(0)
            pieces.append((where, size))
            if room > size:
                insort(open_, (room - size, where))
        out.append(pieces)
    return out


def packed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, container, at, tokens): every piece of every text and where it lies.

    container is unique over all ranges and at is the place of the piece's first token in it. piece counts from 0; a
    text of at most capacity tokens is one piece, an empty or null one a piece of 0 tokens in no container. Repeated
    rows are packed each. Rows without id are left out.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = cut(measured(documents, id_col, text_col, vocabulary=vocabulary), "sizes")
    ranges = max(1, -(-sized.count() // range_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held = [b for b in batches if len(b)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True).sort_values(["curve", "doc_id", "tokens"], ignore_index=True)
        offset = TaskContext.get().partitionId() << 40
        filled: dict[int, int] = {}
        rows = []
        for doc, pieces in zip(pdf["doc_id"].tolist(), pack(pdf["tokens"].tolist(), capacity)):
            for piece, (where, tokens) in enumerate(pieces):
                rows.append((doc, piece, offset + where, filled.get(where, 0), tokens))
                filled[where] = filled.get(where, 0) + tokens
            if not pieces:
                rows.append((doc, 0, None, None, 0))
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "container", "at", "tokens"])
        yield out.astype({"container": "Int64", "at": "Int64"})

    parted = sized.repartitionByRange(ranges, "curve", "doc_id")
    return parted.mapInPandas(run, "doc_id long, piece long, container long, at long, tokens long")


def containers(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, pieces, tokens, unused): one row per container."""
    return pieces.where("container is not null").groupBy("container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), (F.lit(capacity) - F.sum("tokens")).alias("unused"))
