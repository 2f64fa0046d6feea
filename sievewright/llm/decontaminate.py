"""Benchmark decontamination by SimHash over item-sized windows.

Every window of a document that is as long as a benchmark item, and holds
shingles of the item of at least ``MIN_SIMILARITY`` of the item's weight, is a
candidate.  Candidates are taken by the Hamming distance of their 64-bit SimHash
from the item's, and verified by the exact weighted Jaccard similarity of their
shingles, at least ``MIN_SIMILARITY``.

The shared weight is at most the weight of the window's shingles that the item
has, and the united weight at least the item's; so a window that is no candidate
has a lower similarity, and the choice of candidates loses nothing.  The
distance decides the order alone.

The benchmark is a stated query set: it goes to the executors in blocks of at
most ``BLOCK_BYTES`` of text, one pass over the documents for each.

Defined results: null texts count as empty; items without a word match nothing;
items of fewer than five words are one shingle of all their words; repeated
documents are reported each (equal rows alike); empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._words import Words, mix, shingles, slices, words_of

K = 5
MIN_SIMILARITY = 0.8
BLOCK_BYTES = 8 << 20
#: Windows that are fingerprinted together.
CHUNK = 4096
_BITS = np.arange(64, dtype=np.uint64)


class Postings:
    """What each of many shingles leads to; as large as the number of its entries."""

    def __init__(self, grams: np.ndarray, targets: np.ndarray):
        order = np.lexsort((targets, grams))
        grams, targets = grams[order], targets[order]
        new = np.concatenate((np.ones(min(1, len(grams)), bool), (grams[1:] != grams[:-1]) | (targets[1:] != targets[:-1])))
        self.grams, self.targets = grams[new], targets[new]

    def of(self, grams: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Targets in order, each with the places among ``grams`` that lead to it."""
        first, last = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        n = last - first
        target = self.targets[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]
        order = np.argsort(target, kind="stable")
        place, target = np.repeat(np.arange(len(grams)), n)[order], target[order]
        cuts = np.flatnonzero(np.diff(target)) + 1
        return [(int(target[c]), p) for c, p in zip((0, *cuts.tolist()), np.split(place, cuts), strict=True)] if len(target) else []


class Items:
    """Benchmark items of one length, with their fingerprints and the items of every shingle.

    ``weights`` tells the weight of every shingle of the benchmark; whole numbers,
    so that sums are exact in any order.
    """

    def __init__(self, k: int, size: int, items: list[tuple[int, np.ndarray]], weights: Weights):
        self.k, self.size, self.weights = k, size, weights
        self.ids = [i for i, _ in items]
        self.bags = [bag(s, weights.of(s)) for _, s in items]
        self.prints = np.array([simhash(s, weights.of(s)) for _, s in items], np.uint64)
        self.least = np.array([MIN_SIMILARITY * weights.of(s).sum() for _, s in items])
        self.postings = Postings(np.concatenate([s for _, s in items]), np.repeat(np.arange(len(items)), [len(s) for _, s in items]))


class Weights:
    """Rare shingles of the benchmark weigh more; those it lacks weigh as the rarest."""

    def __init__(self, shingles_of_items: list[np.ndarray]):
        total = len(shingles_of_items)
        self.known, df = np.unique(np.concatenate([np.unique(s) for s in shingles_of_items]), return_counts=True)
        self.weight = np.round(8 * np.log1p(total / df)).astype(np.int64)
        self.unseen = round(8 * np.log1p(total))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Places among the known shingles, -1 for others."""
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.where(self.known[at] == grams, at, -1)

    def of(self, grams: np.ndarray) -> np.ndarray:
        at = self.find(grams)
        return np.where(at >= 0, self.weight[at], self.unseen)


class Block:
    """Items of a bounded amount of text with as many words to a shingle: ``groups`` by length, and which groups a shingle leads to.

    ``weights`` are those of the whole benchmark.
    """

    def __init__(self, k: int, items: list[tuple[int, np.ndarray, int]], weights: Weights):
        self.k, self.weights = k, weights
        self.groups = [Items(k, n, [(i, s) for i, s, m in items if m == n], self.weights) for n in sorted({n for *_, n in items})]
        number = {g.size: j for j, g in enumerate(self.groups)}
        self.leads = Postings(np.concatenate([s for _, s, _ in items]), np.repeat([number[n] for *_, n in items], [len(s) for _, s, _ in items]))


def bag(grams: np.ndarray, weights: np.ndarray) -> dict[int, tuple[int, int]]:
    """Shingles with their number and weight."""
    out: dict[int, tuple[int, int]] = {}
    for g, w in zip(grams.tolist(), weights.tolist(), strict=True):
        out[g] = (out[g][0] + 1 if g in out else 1, w)
    return out


def similarity(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]]) -> float:
    """Weighted Jaccard similarity of two bags."""
    low = sum(min(n, b[g][0]) * w for g, (n, w) in a.items() if g in b)
    total = sum(n * w for n, w in a.values()) + sum(n * w for n, w in b.values()) - low
    return low / total if total else 0.0


def _signs(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.where((mix(grams)[:, None] >> _BITS) & np.uint64(1), weights[:, None], -weights[:, None])


def simhash(grams: np.ndarray, weights: np.ndarray) -> int:
    return int(((_signs(grams, weights).sum(0) > 0).astype(np.uint64) << _BITS).sum(dtype=np.uint64)) if len(grams) else 0


def item_blocks(benchmark: list[tuple[int, str]]) -> list[list[Block]]:
    """The benchmark in blocks of bounded text, each parted by words to a shingle."""
    parts, size = [[]], 0
    for item_id, text in benchmark:
        size += len(text or "")
        if size > BLOCK_BYTES and parts[-1]:
            parts.append([])
            size = len(text or "")
        parts[-1].append((item_id, text))
    split: list[dict[int, list[tuple[int, np.ndarray, int]]]] = []
    for part in parts:
        split.append(by_k := {})
        for item_id, text in part:
            w = words_of(text)
            if n := len(w.hash):
                by_k.setdefault(min(K, n), []).append((item_id, shingles(w, min(K, n))[1], n))
    weights = {k: Weights([s for by_k in split for _, s, _ in by_k.get(k, [])]) for k in sorted({k for by_k in split for k in by_k})}
    return [[Block(k, items, weights[k]) for k, items in sorted(by_k.items())] for by_k in split]


def windows_near(items: Items, grams: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int, float, int]]:
    """Verified ``(item, start, shingles, similarity, distance)`` in one document, the best for each item and run of hits.

    ``grams`` are the document's shingles in order, ``hits`` the places of those
    that the items have.  A document shorter than the items is one window.
    """
    found: list[tuple[int, int, int, float, int]] = []
    size, n = items.size - items.k + 1, len(grams)
    for run in np.split(hits, np.flatnonzero(np.diff(hits) > size) + 1):
        lo, hi = max(0, int(run[0]) - size + 1), min(n, int(run[-1]) + size)
        own = grams[lo:hi]
        weights = items.weights.of(own)
        sums = np.zeros((len(own) + 1, 64), np.int64)
        np.cumsum(_signs(own, weights), axis=0, out=sums[1:])
        start = np.arange(max(1, len(own) - size + 1))
        end = np.minimum(start + size, len(own))
        best: dict[int, tuple[float, int, int, int]] = {}
        for i, place in items.postings.of(own[run - lo]):
            at = run[place] - lo
            if weights[at].sum() < items.least[i]:
                continue
            held = np.zeros(len(own) + 1, np.int64)
            held[at + 1] = weights[at]
            held = np.cumsum(held)
            some = np.flatnonzero(held[end] - held[start] >= items.least[i])
            prints = np.concatenate([(((sums[end[c]] - sums[start[c]]) > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64) for c in np.split(some, range(CHUNK, len(some), CHUNK))])
            distance = np.bitwise_count(prints ^ items.prints[i])
            for j in np.argsort(distance, kind="stable").tolist():
                a, b = int(start[some[j]]), int(end[some[j]])
                sim = similarity(bag(own[a:b], weights[a:b]), items.bags[i])
                if sim >= MIN_SIMILARITY and (i not in best or sim > best[i][0]):
                    best[i] = (sim, lo + a, b - a, int(distance[j]))
                if i in best and best[i][0] >= 1.0:
                    break
        found += [(items.ids[i], s, m, sim, distance) for i, (sim, s, m, distance) in best.items()]
    return found


def _finder(blocks: list[Block], names: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = []
        for block in blocks:
            known = block.weights.known
            bits = max(16, min(27, int(np.log2(len(known) + 1)) + 6))
            bitmap = np.zeros(1 << bits, bool)
            bitmap[(known & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            bitmaps.append((np.uint64((1 << bits) - 1), bitmap))
        for batch in batches:
            rows: list[int] = []
            out: list[tuple[int, int, int, float, int]] = []
            for lo, _, data, offsets in slices(batch.column(1)):
                w = Words(data, offsets)
                for block, (mask, bitmap) in zip(blocks, bitmaps, strict=True):
                    at, grams = shingles(w, block.k)
                    maybe = np.flatnonzero(bitmap[(grams & mask).astype(np.int64)])
                    maybe = maybe[block.weights.find(grams[maybe]) >= 0]
                    doc = w.doc[at[maybe]]
                    for d in np.unique(doc).tolist():
                        first, last = (int(np.searchsorted(at, w.first[x])) for x in (d, d + 1))
                        mine = slice(int(np.searchsorted(doc, d)), int(np.searchsorted(doc, d, "right")))
                        for g, place in block.leads.of(grams[maybe[mine]]):
                            for item, start, size, sim, distance in windows_near(block.groups[g], grams[first:last], maybe[mine][place] - first):
                                rows.append(lo + d)
                                out.append((item, start, size + block.k - 1, sim, distance))
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds))], names)

    return find


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item that it holds.

    ``doc_id, item_id, start_word, n_words, similarity, distance``: the best
    window of each item in each run of shared shingles.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = [(r[0], r[1]) for r in benchmark.select(F.col(f"`{item_col}`").cast("long"), F.col(f"`{item_text_col}`").cast("string")).toLocalIterator()]
    names = ["doc_id", "item_id", "start_word", "n_words", "similarity", "distance"]
    schema = f"doc_id {kind}, item_id long, start_word long, n_words long, similarity double, distance int"
    return reduce(DataFrame.unionByName, [rows.mapInArrow(_finder(blocks, names), schema) for blocks in item_blocks(items)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, with all their columns.

    The rows pass through the finder itself, so that no join by id is needed.
    """
    items = [(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()]
    for blocks in item_blocks(items):
        find = _finder(blocks, ["row", "item_id", "start_word", "n_words", "similarity", "distance"])
        at = docs.columns.index(text_col)

        def clean(batches: Iterator[pa.RecordBatch], find=find, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], ["row", "text"])
                bad = {r for hit in find(iter([numbered])) for r in hit.column(0).to_pylist()}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64())) if bad else batch

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
