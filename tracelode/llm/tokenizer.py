"""Byte-level BPE encoding of a whole corpus from a public vocabulary file."""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.arrow_groups import widened

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode lists it (no other control characters).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = regex.compile(PATTERN.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]").replace(f"[^[{_SPACE}]", f"[^{_SPACE}"))
_ASCII_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_NONE = 1 << 60
SHORT_BYTES = 256
CACHE_PIECES = 200_000


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word by a contiguous rank array.

    ``cut`` holds the part boundaries and ``rank[i]`` the rank of joining the parts at ``i`` and
    ``i + 1``. The least rank is found by scanning, its boundary deleted and the two
    neighbouring ranks refreshed, until no join is listed.
    """
    cut = list(range(len(word) + 1))
    rank = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while rank and (least := min(rank)) != _NONE:
        i = rank.index(least)
        del cut[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get(word[cut[i] : cut[i + 2]], _NONE)
        if i:
            rank[i - 1] = ranks.get(word[cut[i - 1] : cut[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for words of any length: linked parts and a heap of joins."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            end = after[after[i]]
            if (r := ranks.get(word[i:end])) is not None:
                heapq.heappush(heap, (r, i, end))

    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        gone = after[i]
        alive[gone] = False
        after[i] = end
        if end < n:
            before[end] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts; ids of short pieces are remembered, a bounded number of them."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.known: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        word = piece.encode("utf-8", "replace")
        if (whole := self.ranks.get(word)) is not None:
            ids = [whole]
        elif len(word) <= SHORT_BYTES:
            ids = merge_short(word, self.ranks)
        else:
            return merge_long(word, self.ranks)
        if len(self.known) >= CACHE_PIECES:
            self.known.clear()
        self.known[piece] = ids
        return ids

    def extend(self, text: str, out: array) -> None:
        get, piece = self.known.get, self.piece
        for p in (_ASCII_PIECES if text.isascii() else _PIECES).findall(text):
            out.extend(get(p) or piece(p))

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.extend(text, out)
        return out.tolist()


_ENCODERS: dict[str, Encoder] = {}


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            offsets, ids = array("i", [0]), array("i")
            for text in batch.column(1):
                value = text.as_py()
                if value:
                    encoder.extend(value, ids)
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[batch.schema.names[0], "ids"])

    return run


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, least_tasks: int | None = None) -> DataFrame:
    """``doc_id, ids``: token ids of every row's text, without special tokens.

    Null and empty texts give an empty list; their strings of special tokens are ordinary text;
    texts and words of any length are encoded whole; repeated rows and null ids are kept; an
    empty table gives an empty result; other columns are ignored. One scan, without a shuffle
    unless its files give fewer splits than ``least_tasks``.
    ``vocabulary`` must be readable on every worker.
    """
    kind = dict(documents.dtypes)[doc_id]
    return widened(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), least_tasks).mapInArrow(_encode(vocabulary), f"doc_id {kind}, ids array<int>")
