"""Evaluation passages in training text: SimHash windows, Hamming blocks, exact verification.

Two sizes of windows. Of ``WINDOW_WORDS`` words, for passages held in part: what counts is that
all words of a window are equal. Of the size of each item, for passages held whole but edited:
fingerprints within ``NEAR_RADIUS`` bits are found through blocks, and what counts is the
weighted similarity of the five-word shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.arrow_groups import widened

WORDS = re.compile(r"[^\W_]+")
WINDOW_WORDS = 12
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of short windows within this distance are candidates; one block more than that must agree.
RADIUS = 2
#: Bit ranges of the blocks of a short window's 64-bit fingerprint.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: The same for item-sized windows: of 4 blocks of 16 bits one differs in a bit at most if no more than 7 bits differ.
NEAR_RADIUS = 7
NEAR_BLOCKS, NEAR_BITS = 4, 16
#: Characters of passages that tasks hold at once (some 10 times as many bytes are broadcast); more are searched in further passes.
CHARS_PER_PASS = 8 << 20
CHUNK_WORDS = 60_000
CACHE_WORDS = 300_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    return WORDS.findall((text or "").lower())


def _bits(word_hashes: np.ndarray) -> np.ndarray:
    """One row of 64 votes (+1 or -1) for each hash."""
    return (np.unpackbits(word_hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) << 1) - 1


def fingerprints(votes: np.ndarray) -> np.ndarray:
    """SimHash of each window of ``WINDOW_WORDS`` rows, from sums over doubled spans."""
    two = votes[:-1] + votes[1:]
    four = two[:-2] + two[2:]
    eight = four[:-4] + four[4:]
    twelve = eight[:-4] + four[8:]
    return np.packbits(twelve > 0, axis=1).view(np.uint64).ravel()


def fingerprints_at(totals: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words that begin at ``at``, from running totals of votes."""
    return np.packbits(totals[at + size] > totals[at], axis=1).view(np.uint64).ravel()


def running_totals(votes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(votes, axis=0, dtype=np.int32)])


def shingles_of(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, letters) of the shingle that begins at each word."""
    n = max(0, len(hashes) - SHINGLE_WORDS + 1)
    key, weight = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for k in range(SHINGLE_WORDS):
        key += hashes[k : k + n] * _MIX[k]
        weight += lengths[k : k + n]
    return key, weight


def shingle_similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags of shingles (hash, letters); a shingle weighs its letters."""
    (a, at, n), (b, _, m) = np.unique(one[0], return_index=True, return_counts=True), np.unique(two[0], return_index=True, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int((np.minimum(n[i], m[j]) * one[1][at[i]]).sum())
    either = int(one[1].sum() + two[1].sum()) - both
    return both / either if either else 0.0


def hashed(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and letters of each word."""
    return np.array([xxhash.xxh64_intdigest(x) for x in ws], np.uint64), np.array([len(x) for x in ws], np.int64)


class PassageIndex:
    """A bounded number of items: word hashes end to end, and fingerprints with their blocks."""

    def __init__(self, items: list[tuple[int, str]], near: bool):
        held = [(item, w) for item, w in ((item, words(passage)) for item, passage in items) if len(w) >= WINDOW_WORDS]
        parts = [hashed(w) for _, w in held]
        self.near = near
        self.item = np.array([item for item, _ in held], np.int64)
        self.size = np.array([len(w) for _, w in held], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.hash = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.letters = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
        if near:
            self.fp = np.array([np.packbits(_bits(h).sum(axis=0, dtype=np.int32) > 0).view(np.uint64)[0] for h, _ in parts], np.uint64)
            self.sizes = {int(s): np.flatnonzero(self.size == s) for s in np.unique(self.size)}
        else:
            at = [s + np.arange(n - WINDOW_WORDS + 1) for s, n in zip(self.start, self.size, strict=True)]
            self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
            self.owner = np.repeat(np.arange(len(held)), self.size - WINDOW_WORDS + 1)
            self.fp = np.concatenate([fingerprints(_bits(h)) for h, _ in parts]) if parts else np.zeros(0, np.uint64)
            self.blocks = [self._block(low, high) for low, high in BLOCKS]

    def _block(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        value = (self.fp >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(value, kind="stable")
        return value[order], order

    def equal_fingerprint_windows(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) pairs at most RADIUS bits apart, each once."""
        left, right = [], []
        for (low, high), (values, order) in zip(BLOCKS, self.blocks, strict=True):
            block = (fps >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
            present = np.zeros(1 << (high - low), bool)
            present[values] = True
            hit = np.flatnonzero(present[block])
            if not len(hit):
                continue
            a, b = np.searchsorted(values, block[hit], "left"), np.searchsorted(values, block[hit], "right")
            count = b - a
            left.append(np.repeat(hit, count))
            right.append(order[np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        l, r = np.concatenate(left), np.concatenate(right)
        close = np.bitwise_count(fps[l] ^ self.fp[r]) <= RADIUS
        pairs = np.unique(np.stack([l[close], r[close]], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def near_windows(self, fps: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs at most NEAR_RADIUS bits apart, each once; ``of`` names the items of the windows' size."""
        flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(NEAR_BITS, dtype=np.uint64)])
        mask = np.uint64((1 << NEAR_BITS) - 1)
        left, right = [], []
        for b in range(NEAR_BLOCKS):
            shift = np.uint64(b * NEAR_BITS)
            values = (((self.fp[of] >> shift) & mask)[:, None] ^ flips).ravel()
            who = np.repeat(of, len(flips))
            order = np.argsort(values, kind="stable")
            values, who = values[order], who[order]
            present = np.zeros(1 << NEAR_BITS, bool)
            present[values] = True
            block = (fps >> shift) & mask
            hit = np.flatnonzero(present[block])
            a, z = np.searchsorted(values, block[hit], "left"), np.searchsorted(values, block[hit], "right")
            count = z - a
            left.append(np.repeat(hit, count))
            right.append(who[np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
        l, r = np.concatenate(left), np.concatenate(right)
        close = np.bitwise_count(fps[l] ^ self.fp[r]) <= NEAR_RADIUS
        pairs = np.unique(np.stack([l[close], r[close]], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def held_whole_words(self, hashes: np.ndarray, w: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Whether all words of the windows (w, o) are equal."""
        same = np.ones(len(w), bool)
        for k in range(WINDOW_WORDS):
            same &= hashes[w + k] == self.hash[self.at[o] + k]
        return same

    def shingles(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(int(self.start[i]), int(self.start[i] + self.size[i]))
        return shingles_of(self.hash[span], self.letters[span])


def _in_part(index: PassageIndex, votes: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> dict[tuple[int, int], float]:
    """(document, item) -> windows whose words are equal."""
    fps = fingerprints(votes)
    w, o = index.equal_fingerprint_windows(fps)
    inside = owner[w] == owner[w + WINDOW_WORDS - 1]
    w, o = w[inside], o[inside]
    same = index.held_whole_words(hashes, w, o)
    found: dict[tuple[int, int], float] = {}
    for pair in zip(owner[w[same]].tolist(), index.item[index.owner[o[same]]].tolist(), strict=True):
        found[pair] = found.get(pair, 0) + 1
    return found


def _whole(index: PassageIndex, votes: np.ndarray, hashes: np.ndarray, letters: np.ndarray, owner: np.ndarray) -> dict[tuple[int, int], float]:
    """(document, item) -> greatest similarity of an item-sized window."""
    totals = running_totals(votes)
    found: dict[tuple[int, int], float] = {}
    for size, of in index.sizes.items():
        if size > len(owner):
            continue
        at = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
        if not len(at):
            continue
        w, items = index.near_windows(fingerprints_at(totals, at, size), of)
        for a, i in zip(at[w].tolist(), items.tolist(), strict=True):
            similar = shingle_similarity(shingles_of(hashes[a : a + size], letters[a : a + size]), index.shingles(i))
            if similar >= SIMILARITY:
                key = (int(owner[a]), int(index.item[i]))
                found[key] = max(found.get(key, 0.0), similar)
    return found


def _search(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: PassageIndex = shared.value
        places: dict[str, int] = {}
        votes, hashes, letters = np.zeros((1024, 64), np.int8), np.zeros(1024, np.uint64), np.zeros(1024, np.int64)

        def scan(docs: list[tuple[int, list[str]]]) -> list[tuple]:
            nonlocal votes, hashes, letters
            flat = [w for _, ws in docs for w in ws]
            if len(flat) < WINDOW_WORDS:
                return []
            if len(places) > CACHE_WORDS:
                places.clear()
            new = [w for w in dict.fromkeys(flat) if w not in places]
            if new:
                base = len(places)
                while base + len(new) > len(votes):
                    votes, hashes, letters = (np.concatenate([x, np.zeros_like(x)]) for x in (votes, hashes, letters))
                span = slice(base, base + len(new))
                hashes[span], letters[span] = hashed(new)
                votes[span] = _bits(hashes[span])
                places.update(zip(new, range(base, base + len(new))))
            place = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
            owner = np.repeat(np.arange(len(docs)), [len(ws) for _, ws in docs])
            found = _whole(index, votes[place], hashes[place], letters[place], owner) if index.near else _in_part(index, votes[place], hashes[place], owner)
            return [(docs[d][0], item, float(value)) for (d, item), value in found.items()]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.float64()]
            columns = zip(*rows) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "value"])

        for batch in batches:
            rows, docs, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words(text.as_py())
                if len(w) < WINDOW_WORDS:
                    continue
                docs.append((doc_id, w))
                size += len(w)
                if size > CHUNK_WORDS:
                    rows += scan(docs)
                    docs, size = [], 0
            rows += scan(docs)
            yield pack(rows)

    return run


def _matches(documents: DataFrame, items: DataFrame, near: bool, least_tasks: int | None) -> DataFrame:
    docs = widened(documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), least_tasks)
    held = items.select("item_id", "passage").where(F.col("item_id").isNotNull() & F.col("passage").isNotNull())
    passes = max(1, -(-(held.agg(F.sum(F.char_length("passage"))).first()[0] or 0) // CHARS_PER_PASS))
    found = None
    for k in range(passes):
        block = held.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()  # CHARS_PER_PASS bounds it
        shared = documents.sparkSession.sparkContext.broadcast(PassageIndex([tuple(r) for r in block], near))
        part = docs.mapInArrow(_search(shared), "doc_id long, item_id long, value double")
        found = part if found is None else found.unionByName(part)
    return found


def leaked_items(documents: DataFrame, items: DataFrame, least_tasks: int | None = None) -> DataFrame:
    """``doc_id, item_id, n_windows`` of documents that hold ``WINDOW_WORDS`` consecutive words of an item's passage.

    Every window of every document is looked up by its SimHash: windows of items within
    ``RADIUS`` bits share a block, so equal ones are always found; the words decide.
    ``n_windows`` counts the pairs of equal windows. Null, empty and short texts and passages
    match nothing; repeated documents with one id count together; empty tables give an empty
    result; other columns are ignored. One scan without a shuffle of texts; items are broadcast
    in blocks of about ``CHARS_PER_PASS``, each searched in a pass of its own.
    """
    found = _matches(documents, items, False, least_tasks)
    return found.groupBy("doc_id", "item_id").agg(F.sum("value").cast("long").alias("n_windows"))


def near_copies(documents: DataFrame, items: DataFrame, least_tasks: int | None = None) -> DataFrame:
    """``doc_id, item_id, similarity`` of documents that hold an item's whole passage, edited or not.

    Every window of as many words as the item has is a candidate if its SimHash lies within
    ``NEAR_RADIUS`` bits of the item's, all of which the blocks find; it counts if the weighted
    similarity of the five-word shingles is ``SIMILARITY`` or more. The greatest similarity of a
    document is given. Nulls, repeats, empty tables and blocks of items as in ``leaked_items``.
    """
    found = _matches(documents, items, True, least_tasks)
    return found.groupBy("doc_id", "item_id").agg(F.max("value").alias("similarity"))
