"""Token ids of whole texts by a public byte-level tokenizer, by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged, so a text may be cut there and its fragments
encoded alone. The pairs are read from the vocabulary. Texts are cut in two steps: first before runs of ASCII white
space, where the vocabulary proves every pair of another byte and that white space to be forced and the word pattern
ends a word too; then, inside such a piece, at the ends of the pattern's words and between the bytes of every forced
pair. The fragments are encoded by merging the pair of least rank until none is left. Pieces and fragments repeat
heavily, so a worker keeps their ids; the stores are emptied when they are full, which changes no result.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kept pieces and fragments of a worker, and the longest that is kept.
KEPT_FRAGMENTS = 400_000
KEPT_LENGTH = 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def forced_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256 booleans: the pair (left, right) occurs inside no token."""
    forced = np.ones((256, 256), bool)
    for token in ranks:
        b = np.frombuffer(token, np.uint8)
        forced[b[:-1], b[1:]] = False
    return forced


SPACE = b" \t\n\r\f\x0b"


def fragment_pattern(ranks: dict[bytes, int]) -> re.Pattern:
    """Splits a text into pieces: white space, then everything up to the next white space that a cut is made before.

    A byte of several-byte characters may still be unforced before it, which Encoder.pieces sees to.
    """
    forced = forced_pairs(ranks)
    others = [b for b in range(128) if b not in SPACE]
    sure = "".join(re.escape(chr(w)) for w in SPACE if forced[others, w].all())
    return re.compile(f"[{sure}]*[^{sure}]+|[{sure}]+" if sure else r"(?s:.+)")


def merged(fragment: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a fragment: of all neighbouring parts the pair of least rank, the first of equals, is merged first.

    Parts are linked by their places and pairs wait in a heap, so a long fragment costs no more than n log n steps.
    """
    whole = ranks.get(fragment)
    if whole is not None:
        return [whole]
    n = len(fragment)
    end = list(range(1, n + 1))  # of the part that starts at a place; 0 where none starts any more
    before = list(range(-1, n - 1))
    waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(fragment[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, to = heapq.heappop(waiting)
        j = end[i]
        if not j or j >= n or end[j] != to:
            continue  # one of the two parts has been merged otherwise
        end[i], end[j] = to, 0
        if to < n:
            before[to] = i
            r = ranks.get(fragment[i : end[to]])
            if r is not None:
                heapq.heappush(waiting, (r, i, end[to]))
        if i:
            r = ranks.get(fragment[before[i] : to])
            if r is not None:
                heapq.heappush(waiting, (r, before[i], to))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[fragment[i : end[i]]])
        i = end[i]
    return ids


def cut_between(forced: np.ndarray, left: str, right: str) -> bool:
    """Whether the last byte of one character and the first of the next are forced apart."""
    a, b = left.encode("utf-8", "replace"), right.encode("utf-8", "replace")
    return bool(forced[a[-1], b[0]])


class Encoder:
    """Encodes texts; one per worker process and vocabulary file."""

    _own: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.ranks = read_vocabulary(path)
        self.split = fragment_pattern(self.ranks).findall
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.forced = forced_pairs(self.ranks)
        self.cut = [bytes(row) for row in self.forced.astype(np.uint8)]
        self.kept: dict[str, array] = {}
        self.known: dict[bytes, list[int]] = {}

    def pieces(self, text: str) -> list[str]:
        """The text cut before runs of ASCII white space, wherever the pair of bytes there is forced."""
        parts = self.split(text)
        if text.isascii() or len(parts) < 2:
            return parts
        out = parts[:1]
        for part in parts[1:]:
            if out[-1][-1] >= "\x80" and not cut_between(self.forced, out[-1][-1], part[0]):
                out[-1] += part
            else:
                out.append(part)
        return out

    def fragments(self, piece: str) -> Iterator[bytes]:
        """The fragments of a piece: its words, cut between the bytes of every forced pair. Lone surrogates count as U+FFFD."""
        cut = self.cut
        for word in self.words(piece):
            b = word.encode("utf-8") if word.isascii() else word.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode("utf-8")
            if b in self.ranks:
                yield b
                continue
            if len(b) > 64:
                codes = np.frombuffer(b, np.uint8)
                at = (np.flatnonzero(self.forced[codes[:-1], codes[1:]]) + 1).tolist()
            else:
                at = [i for i in range(1, len(b)) if cut[b[i - 1]][b[i]]]
            start = 0
            for i in at:
                yield b[start:i]
                start = i
            yield b[start:]

    def encode(self, piece: str) -> array:
        ids, known = array("i"), self.known
        for fragment in self.fragments(piece):
            found = known.get(fragment)
            if found is None:
                found = merged(fragment, self.ranks)
                if len(fragment) <= KEPT_LENGTH:
                    if len(known) >= KEPT_FRAGMENTS:
                        known.clear()
                    known[fragment] = found
            ids.extend(found)
        return ids

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def flat(self, texts: list[str | None]) -> tuple[array, np.ndarray]:
        """The ids of all texts in a row, and the end of each text among them."""
        ids, ends, kept, encode, split = array("i"), np.empty(len(texts), np.int64), self.kept, self.encode, self.pieces
        for i, text in enumerate(texts):
            if text:
                for piece in split(text):
                    known = kept.get(piece)
                    if known is None:
                        known = encode(piece)
                        if len(piece) <= KEPT_LENGTH:
                            if len(kept) >= KEPT_FRAGMENTS:
                                kept.clear()
                            kept[piece] = known
                    ids.extend(known)
            ends[i] = len(ids)
        return ids, ends


def encoded(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>): the token ids of every text, without special tokens.

    Strings that look like special tokens are ordinary text. A null or empty text gives an empty list. Every row gives
    one row, repeated ids included. vocabulary is a path that every executor can read; None is the public 50k one.
    """

    def run(batches):
        import pyarrow as pa

        encoder = Encoder.of(vocabulary or default_vocabulary())
        for batch in batches:
            ids, ends = encoder.flat(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(ids: list[int], path: str | None = None) -> str:
    """The text of token ids; the inverse of encoding."""
    words = {i: b for b, i in read_vocabulary(path or default_vocabulary()).items()}
    return b"".join(words[i] for i in ids).decode("utf-8", "replace")


def sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None) -> DataFrame:
    """(id, tokens): the number of tokens of every text; 0 for a null or empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(vocabulary or default_vocabulary())
        for pdf in batches:
            _, ends = encoder.flat(list(pdf[text_col]))
            yield pd.DataFrame({id_col: pdf[id_col], "tokens": np.diff(ends, prepend=0)})

    return documents.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInPandas(run, f"`{id_col}` long, tokens long")
