"""Cross-entropy difference of matched n-gram models.

Two interpolated bigram models, one of target text and one of the background
(all documents), share one vocabulary.  They have the same order and smoothing,
so that their losses differ by the text they saw alone.  A document's score is
the mean over its words of target loss less background loss; the lower, the
more like the target.  Every document is held out: its own words are taken from
the counts of both models before they judge it, so that none is scored by a
model that has learnt it.

Words and pairs of words are told apart by keys of 64 bits.  Their counts are a
distributed table that grows with the corpus, cut into buckets by ranges of the
key: documents are bound into groups of about ``GROUP`` words, each group sends
each of its distinct keys once to the key's bucket, with its counts, and gets
the corpus counts back.  A frequent pair thus is one record a group.  How often
a word is a context follows from its count less that of texts that end with it.

Defined results: a null text counts as empty; a document without words has null
losses and score; with an empty target the target model is the uniform one, and
so it is for the only target document itself; repeated rows are scored alike,
each with its repeats in the models; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._common import release, stored
from sievewright.llm._words import SLICE, Words, mix, packed, slices, unpacked

#: The uniform estimate is over so many words, or as many as the documents have if these are more.
VOCAB = 1 << 16
#: Weights of the bigram and the unigram estimate; the rest is uniform.
BIGRAM, UNIGRAM = 0.6, 0.35
#: Words (or rows) of a group of documents, and documents' words whose losses are taken at once; words of the corpus to a bucket of keys, and least number of buckets.
GROUP, PIECE = 3 << 19, 1 << 19
BUCKET, BUCKETS = 1 << 20, 64
#: Target ids of so many rows at most are broadcast.
MAX_BROADCAST_TARGETS = 1 << 19
#: The last bit of a key tells words and pairs apart.
_PAIR = np.uint64(1)
_START = np.uint64(0x9E3779B97F4A7C14)
_P = np.uint64(0xD6E8FEB86659FD93)


def keys_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words, and of the pairs that they make with the word before them (or the start of the text)."""
    own = mix(w.hash) & ~_PAIR
    before = np.concatenate((np.full(1, _START), own[:-1])) if len(own) else own.copy()
    before[w.first[:-1][w.first[:-1] < len(own)]] = _START
    return own, mix(before * _P + mix(own)) | _PAIR


def coded(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, byte by byte, compressed."""
    steps = np.diff(keys, prepend=np.zeros(1, np.uint64))
    return packed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).reshape(-1))


def decoded(blob: bytes | pa.Buffer) -> np.ndarray:
    steps = np.ascontiguousarray(unpacked(blob).reshape(8, -1).T).reshape(-1).view(np.uint64)
    return np.cumsum(steps, dtype=np.uint64)


def _bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of documents with their texts, compressed."""
    task, n = TaskContext.get().partitionId() << 32, 0
    ids: list[pa.Array] = []
    texts: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    targets: list[np.ndarray] = []
    held = words = in_target = some = some_target = 0

    def bound() -> pa.RecordBatch:
        rows = pa.concat_arrays(ids)
        blobs = (packed(np.concatenate(x)) for x in (lengths, targets, texts))
        return pa.RecordBatch.from_arrays(
            [pa.array([x], pa.int64()) for x in (task + n, words, in_target, some, some_target)] + [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), *(pa.array([x], pa.binary()) for x in blobs)],
            ["group", "n", "n_target", "texts_all", "texts_target", "ids", "lengths", "targets", "texts"],
        )

    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            size = np.diff(Words(data, offsets).first)
            target = np.array(batch.column(2).slice(lo, hi - lo).to_pylist(), bool)
            ids.append(batch.column(0).slice(lo, hi - lo))
            texts.append(data)
            lengths.append(np.diff(offsets))
            targets.append(target.astype(np.uint8))
            words, in_target, held = words + int(size.sum()), in_target + int(size[target].sum()), held + max(int(size.sum()), hi - lo)
            some, some_target = some + int((size > 0).sum()), some_target + int((size[target] > 0).sum())
            if held >= GROUP:
                yield bound()
                n, held, words, in_target, some, some_target = n + 1, 0, 0, 0, 0, 0
                for x in (ids, texts, lengths, targets):
                    x.clear()
    if ids:
        yield bound()


class Group:
    """A group's documents: the distinct keys in order, where each bucket's begin (``bounds``), and each word's and pair's place among them."""

    def __init__(self, lengths: pa.Buffer, targets: pa.Buffer, texts: pa.Buffer, buckets: int):
        data, offsets = unpacked(texts), np.concatenate((np.zeros(1, np.int64), np.cumsum(unpacked(lengths), dtype=np.int64)))
        lo, n, keys, sizes = 0, len(offsets) - 1, ([], []), [np.zeros(0, np.int64)]
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1))
            w = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for held, found in zip(keys, keys_of(w), strict=True):
                held.append(found)
            sizes.append(np.diff(w.first))
            lo = hi
        self.targets, self.sizes = unpacked(targets).astype(bool), np.concatenate(sizes)
        self.keys, place = np.unique(np.concatenate([*keys[0], *keys[1], np.zeros(0, np.uint64)]), return_inverse=True)
        self.own, self.pair = np.split(place, 2)
        self.doc = np.repeat(np.arange(n), self.sizes)
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        width = np.uint64((1 << 64) // buckets)
        self.bounds = np.append(np.searchsorted(self.keys, np.arange(buckets, dtype=np.uint64) * width), len(self.keys))

    def counts(self) -> list[np.ndarray]:
        """How often each key is in the target documents and in all, and how many of these end with it."""
        of, last = self.targets[self.doc], np.append(self.starts[1:], len(self.own))[: len(self.starts)] - 1
        chosen = ((self.own[of], self.pair[of]), (self.own, self.pair), (self.own[last[of[last]]],), (self.own[last],))
        return [sum(np.bincount(p, minlength=len(self.keys)) for p in places) for places in chosen]

    def held_out(self, place: np.ndarray) -> np.ndarray:
        """For each word (or pair), how often its own document has it."""
        _, of, count = np.unique(self.doc * max(1, len(self.keys)) + place, return_inverse=True, return_counts=True)
        return count[of]


_COUNTS = ("target", "every", "target_ends", "every_ends")


def _sender(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *blobs in zip(*batch.columns, strict=True):
                g = Group(*(x.as_buffer() for x in blobs), buckets)
                at = [b for b in range(buckets) if g.bounds[b] < g.bounds[b + 1]]
                cut = [pa.array([f(x[g.bounds[b] : g.bounds[b + 1]]) for b in at], pa.binary()) for f, x in zip((coded, *[packed] * 4), (g.keys, *g.counts()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([name.as_py()] * len(at), pa.int64()), *cut], ["bucket", "group", "keys", *_COUNTS])

    return send


def _sum(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corpus counts of a bucket's keys, for each group in the order of its keys; ``n_words`` of the first row has the bucket's distinct words."""
    names, blobs = [], [[] for _ in range(5)]
    for batch in batches:
        names += batch.column(1).to_pylist()
        for i, column in enumerate(batch.columns[2:]):
            blobs[i] += [unpacked(x.as_buffer()) if i else decoded(x.as_buffer()) for x in column]
    ends = np.cumsum([len(x) for x in blobs[0]])[:-1]
    keys, place = np.unique(np.concatenate(blobs[0]), return_inverse=True)
    n_words = [int((keys & _PAIR == 0).sum())] + [0] * (len(names) - 1)
    back = []
    for x in blobs[1:]:
        sums = np.bincount(place, np.concatenate(x), len(keys)).astype(np.int64)[place]
        back.append(pa.array([packed(s) for s in np.split(sums, ends)], pa.binary()))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(n_words, pa.int64()), *back], ["bucket", "group", "n_words", *_COUNTS])


def losses(own: np.ndarray, context: np.ndarray, pair: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """Loss in nats of every word from the counts of it, its context and their pair; after a context never seen the bigram's weight goes to the others."""
    low = UNIGRAM * np.where(total > 0, own / np.maximum(total, 1), 1 / vocabulary) + (1 - BIGRAM - UNIGRAM) / vocabulary
    return -np.log(np.where(context == 0, low / (1 - BIGRAM), low + BIGRAM * pair / np.maximum(context, 1)))


def _scorer(buckets: int, totals: tuple[tuple[int, int], tuple[int, int]], vocabulary: int):
    """``totals``: words and texts with words, of the target documents and of all."""

    def score(bound: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group(*(bound.column(c)[0].as_buffer() for c in ("lengths", "targets", "texts")), buckets)
        counts = {name: np.zeros(len(g.keys), np.int64) for name in _COUNTS}
        for name in _COUNTS:
            for b, x in zip(answers.column("bucket").to_pylist(), answers.column(name), strict=True):
                counts[name][g.bounds[b] : g.bounds[b + 1]] = unpacked(x.as_buffer())
        n, size = len(g.sizes), g.sizes
        mine = g.held_out(g.own), g.held_out(g.pair)
        first = np.zeros(len(g.own), bool)
        first[g.starts] = True
        last = np.zeros(n, np.int64)
        last[size > 0] = g.own[np.append(g.starts[1:], len(g.own))[: len(g.starts)] - 1]
        means = []
        for name, (words, texts), among in zip(("target", "every"), totals, (g.targets, np.ones(n, bool)), strict=True):
            total = np.zeros(n)
            for lo in range(0, len(g.own), PIECE):
                at = slice(lo, lo + PIECE)
                doc, own, before = g.doc[at], g.own[at], g.own[np.maximum(np.arange(lo, min(lo + PIECE, len(g.own))) - 1, 0)]
                held, prior = among[doc], mine[0][np.maximum(np.arange(lo, lo + len(own)) - 1, 0)]
                uni, bi = counts[name][own] - mine[0][at] * held, counts[name][g.pair[at]] - mine[1][at] * held
                context = counts[name][before] - prior * held - counts[f"{name}_ends"][before] + held * (before == last[doc])
                loss = losses(uni, np.where(first[at], texts - held, context), bi, (words - size * among)[doc], vocabulary)
                total += np.bincount(doc, loss, n)
            means.append(total / np.maximum(size, 1))
        columns = [bound.column("ids")[0].values, pa.array(size), *(pa.array(x, mask=size == 0) for x in (*means, means[0] - means[1]))]
        return pa.Table.from_arrays(columns, ["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return score


def score_documents(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, target_loss, background_loss, score``.

    ``targets`` has the ids (column ``doc_id``) of the target documents; the
    background is all of ``docs``.  Targets beyond ``MAX_BROADCAST_TARGETS`` are
    joined by sorting, as they may be a large part of the documents.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chosen = stored(targets.select(F.col("doc_id").alias("_sw_id")).where("_sw_id is not null").distinct(), "lm-targets")
    chosen = F.broadcast(chosen) if chosen.count() <= MAX_BROADCAST_TARGETS else chosen.hint("merge")
    marked = rows.join(chosen, F.col("doc_id") == F.col("_sw_id"), "left").select("doc_id", "text", F.col("_sw_id").isNotNull().alias("target"))
    schema = f"group long, n long, n_target long, texts_all long, texts_target long, ids array<{kind}>, lengths binary, targets binary, texts binary"
    bound = stored(marked.mapInArrow(_bind, schema), "lm-groups")
    release(spark)
    n, n_target, texts, texts_target = (x or 0 for x in bound.agg(*(F.sum(c) for c in ("n", "n_target", "texts_all", "texts_target"))).first())
    buckets = max(BUCKETS, n // BUCKET)
    counts = ", ".join(f"{c} binary" for c in _COUNTS)
    sent = bound.select("group", "lengths", "targets", "texts").mapInArrow(_sender(buckets), f"bucket int, group long, keys binary, {counts}")
    counted = stored(sent.groupBy("bucket").applyInArrow(_sum, f"bucket int, group long, n_words long, {counts}"), "lm-counts")
    release(spark)
    vocabulary = max(VOCAB, counted.agg(F.sum("n_words")).first()[0] or 0)
    both = bound.select("group", "ids", "lengths", "targets", "texts").groupBy("group").cogroup(counted.select("bucket", "group", *_COUNTS).groupBy("group"))
    return both.applyInArrow(_scorer(buckets, ((n_target, texts_target), (n, texts)), vocabulary), f"doc_id {kind}, n_words long, target_loss double, background_loss double, score double")
