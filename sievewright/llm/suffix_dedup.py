"""Removal of byte strings that repeat across documents, by sparse suffix sorting.

A byte is removed if a 50-byte string covers it that also starts in a document
with a smaller id.  The difference-cover algorithm would sort two thirds of all
suffixes of the corpus as triples, at some 16 bytes each; the README tells why
that is out of reach here.  What is kept of it: a sample of positions that meets
every 50-byte string, names for the sampled positions, the remaining positions
placed by the sample that they contain, and the comparison of neighbours in the
sorted order.

* Sample: in each 50-byte string, the 18-byte gram with the least hash (its
  anchor; equal strings have it at the same place).  About one position in 17.
* Names: anchors' hashes are dealt out by value; an anchor that no other
  document has is answered with a zero bit, and its strings are done.
* Remaining positions: each string belongs to one anchor.  The bytes around
  repeated anchors are dealt out by the anchor's hash, so that equal strings
  meet.  Strings that repeat within a slice are answered there, and only those
  of the smallest id are sent: a string that a third of all documents share
  costs a row a slice.
* Comparison: strings are sorted by hash, neighbours compared byte by byte, and
  each group's smallest id decides.

Defined results: a null text counts as empty; ids are integers, and a null id is
larger than all others; documents with equal ids do not remove each other's
bytes; texts under 50 bytes stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._common import release, stored
from sievewright.llm._words import packed, powers, slices, unpacked

LENGTH = 50
GRAM = 18
#: Bytes of text in a slice (one document at least), and to each bucket.
SLICE_BYTES, BUCKET_BYTES, MIN_BUCKETS = 1 << 20, 1 << 22, 256
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW32 = np.uint64(0xFFFFFFFF)
_LAST = np.iinfo(np.int64).max


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data.astype(np.uint64) + np.uint64(1), powers(_P, len(data)), out=sums[1:])
    np.cumsum(sums, out=sums)
    out = sums[size:] - sums[:n]
    out *= powers(_P_INV, n)
    out ^= out >> np.uint64(29)
    out *= _C
    out ^= out >> np.uint64(32)
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: first start, end (exclusive), the anchor's hash, the document's number."""
    grams = gram_hashes(data, GRAM)
    width = LENGTH - GRAM + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = (grams & ~_LOW32) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    least &= _LOW32
    # Starts whose string ends within the document, and the first start of each document.
    edges = np.zeros(len(least) + LENGTH + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    np.add.at(edges, offsets[long], 1)
    np.add.at(edges, offsets[long + 1] - LENGTH + 1, -1)
    valid = np.cumsum(edges[: len(least)], dtype=np.int8) > 0
    fresh = np.zeros(len(least) + 1, bool)
    fresh[offsets[long]] = True
    new = np.ones(len(least) + 1, bool)
    new[1:-1] = least[1:] != least[:-1]
    new |= fresh
    new[1:-1] |= valid[1:] != valid[:-1]
    begins = np.flatnonzero(new)
    lo, hi = begins[:-1], begins[1:]
    keep = valid[lo]
    lo, hi = lo[keep], hi[keep]
    return lo, hi, grams[least[lo].astype(np.int64)], np.searchsorted(offsets, lo, "right") - 1


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``starts[i]`` to ``starts[i] + sizes[i]``, one range after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)[:-1])), sizes)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1), SLICE_BYTES):
            ids = batch.column(0).slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([offsets.tobytes()], pa.binary()), pa.array([packed(data)], pa.binary())], ["ids", "offsets", "data"]
            )


def _arrays(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column("ids")[row].as_py()
    data = unpacked(batch.column("data")[row].as_buffer())
    offsets = np.frombuffer(batch.column("offsets")[row].as_buffer(), np.int64)
    return np.array([_LAST if i is None else i for i in ids], np.int64), data, offsets


class _Names:
    """Distinct keys of a slice, dealt to buckets: ``keys`` in the order of ``used`` buckets, which begin at ``first``.

    ``of`` tells the place of each anchor's key, ``local`` which keys several documents have.
    """

    def __init__(self, key: np.ndarray, doc: np.ndarray, buckets: int):
        order = np.argsort(key, kind="stable")  # documents ascend within a key
        ordered = key[order]
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), ordered[1:] != ordered[:-1])))
        last = np.append(head[1:], len(key))[: len(head)] - 1
        distinct, local = ordered[head], doc[order][head] != doc[order][last]
        bucket = ((distinct >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        deal = np.argsort(bucket, kind="stable")
        self.keys, self.local = distinct[deal], local[deal]
        self.used, self.first = np.unique(bucket[deal], return_index=True)
        self.first = np.append(self.first, len(deal))
        place = np.empty(len(deal), np.int64)
        place[deal] = np.arange(len(deal))
        self.of = np.empty(len(key), np.int64)
        self.of[order] = np.repeat(place, last - head + 1)


def _name(buckets: int):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, data, offsets = _arrays(batch, row)
                _, _, key, doc = anchors(data, offsets)
                names = _Names(key, doc, buckets)
                keys, used, first = names.keys, names.used, names.first
                low, high = (keys & _LOW32).astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16)
                cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int64()),
                        pa.array(np.full(len(used), batch.column("slice")[row].as_py()), pa.int64()),
                        pa.array([low[a:b].tobytes() for a, b in cut], pa.binary()),
                        pa.array([high[a:b].tobytes() for a, b in cut], pa.binary()),
                    ],
                    ["bucket", "slice", "low", "high"],
                )

    return name


def _shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each slice's names in a bucket, the bits of those that another slice has too."""
    table = table.combine_chunks()
    low = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("low")]
    high = [np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("high")]
    names = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    twin = np.zeros(len(names), bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    bits = [np.packbits(x).tobytes() for x in np.split(twin, np.cumsum([len(x) for x in low])[:-1])]
    return pa.table({"slice": table.column("slice"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _context(buckets: int):
    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "slice", "starts", "counts", "ids", "bytes"]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, data, offsets = _arrays(batch, row)
                number = batch.column("slice")[row].as_py()
                lo, hi, key, doc = anchors(data, offsets)
                known = _Names(key, doc, buckets)
                twin = known.local.copy()
                answers = {a["bucket"]: a["bits"] for a in batch.column("answers")[row].as_py() or []}
                for b, x, y in zip(known.used.tolist(), known.first[:-1].tolist(), known.first[1:].tolist(), strict=True):
                    if b in answers:
                        twin[x:y] |= np.unpackbits(np.frombuffer(answers[b], np.uint8), count=y - x).astype(bool)
                repeated = twin[known.of]
                lo, hi, key, own = lo[repeated], hi[repeated], key[repeated], ids[doc[repeated]]
                # Equal contexts within the slice: only those of the smallest id are sent, the others are answered.
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(data)), out=sums[1:])
                whole = (sums[hi - 1 + LENGTH] - sums[lo]) * powers(_P_INV, len(data) + 1)[lo] * _C + (hi - lo).astype(np.uint64)
                order = np.lexsort((own, whole))
                head = np.concatenate((np.ones(min(1, len(order)), bool), whole[order][1:] != whole[order][:-1]))
                smallest = own[order][head][np.cumsum(head) - 1] if len(order) else own
                sent = np.zeros(len(order), bool)
                sent[order] = own[order] == smallest
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1 - number], pa.int64()), pa.array([number], pa.int64()), pa.array([lo[~sent].astype(np.int64).tobytes()], pa.binary()), pa.array([(hi - lo)[~sent].astype(np.uint8).tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())],
                    names,
                )
                lo, hi, key, own = lo[sent], hi[sent], key[sent], own[sent]
                bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                lo, hi, own, bucket = lo[order], hi[order], own[order], bucket[order]
                used, first = np.unique(bucket, return_index=True)
                rows: list[list] = [[], [], [], []]
                for x, y in zip(first.tolist(), [*first[1:].tolist(), len(bucket)][: len(first)], strict=True):
                    rows[0].append(lo[x:y].astype(np.uint32).tobytes())
                    rows[1].append((hi - lo)[x:y].astype(np.uint8).tobytes())
                    rows[2].append(own[x:y].tobytes())
                    rows[3].append(packed(data[_ranges(lo[x:y], (hi - lo)[x:y] + LENGTH - 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(np.full(len(used), number), pa.int64()), *(pa.array(r, pa.binary()) for r in rows)], names)

    return context


def repeats(data: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of the strings ``data[s : s + LENGTH]`` equal one of a smaller owner."""
    hashes = gram_hashes(data, LENGTH)[starts]
    order = np.argsort(hashes)
    at, ordered = starts[order], hashes[order]
    same = ordered[1:] == ordered[:-1]
    # Neighbours with one hash are compared in words of eight bytes; the last overlaps the one before.
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    pairs = np.flatnonzero(same)
    wrong: list[int] = []
    for part in range(0, len(pairs), 1 << 18):
        p = pairs[part : part + (1 << 18)]
        a, b = at[p], at[p + 1]
        unequal = np.zeros(len(p), np.uint64)
        for shift in (*range(0, LENGTH - 7, 8), LENGTH - 8):
            unequal |= words[a + shift] ^ words[b + shift]
        wrong += p[unequal != 0].tolist()
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), ~same)))
    sizes = np.diff(np.append(head, len(order)))
    least = np.repeat(np.minimum.reduceat(owner[order], head), sizes) if len(head) else np.zeros(0, np.int64)
    group = np.searchsorted(head, wrong, "right") - 1
    for g in np.unique(group).tolist():  # one hash for different strings: they are told apart by their bytes
        members = np.arange(head[g], head[g] + sizes[g])
        named: dict[bytes, int] = {}
        for i in members.tolist():
            text = data[at[i] : at[i] + LENGTH].tobytes()
            named[text] = min(named.get(text, _LAST), int(owner[order[i]]))
        least[members] = [named[data[at[i] : at[i] + LENGTH].tobytes()] for i in members.tolist()]
    out = np.zeros(len(starts), bool)
    out[order] = owner[order] > least
    return out


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Runs of starts of removed strings for each slice."""
    table = table.combine_chunks()
    if key[0].as_py() < 0:  # answered within the slice
        return table.select(["slice", "starts", "counts"])
    rows = [[np.frombuffer(x.as_buffer(), kind) for x in table.column(c)] for c, kind in (("starts", np.uint32), ("counts", np.uint8), ("ids", np.int64))]
    rows.append([unpacked(x.as_buffer()) for x in table.column("bytes")])
    data = np.concatenate(rows[3])
    counts = np.concatenate(rows[1]).astype(np.int64)
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts + LENGTH - 1)[:-1]))
    removed = repeats(data, _ranges(begin, counts), np.repeat(np.concatenate(rows[2]), counts))
    place = _ranges(np.concatenate(rows[0]).astype(np.int64), counts)
    per_row = np.array([int(x.sum(dtype=np.int64)) for x in rows[1]])
    first_of_context = np.zeros(len(removed), bool)
    first_of_context[(np.cumsum(counts) - counts)[counts > 0]] = True
    starts, sizes = [], []
    ends = np.cumsum(per_row)
    for lo, hi in zip((ends - per_row).tolist(), ends.tolist(), strict=True):
        gone, head = removed[lo:hi], first_of_context[lo:hi]
        begins = np.flatnonzero(gone & (head | ~np.concatenate((np.zeros(1, bool), gone[:-1]))))
        follows = np.flatnonzero(gone & (np.concatenate((head[1:], np.ones(1, bool))) | ~np.concatenate((gone[1:], np.zeros(1, bool)))))
        starts.append(place[lo:hi][begins].tobytes())
        sizes.append((follows - begins + 1).astype(np.uint8).tobytes())
    return pa.table({"slice": table.column("slice"), "starts": pa.array(starts, pa.binary()), "counts": pa.array(sizes, pa.binary())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for row in range(batch.num_rows):
            _, data, offsets = _arrays(batch, row)
            n = len(offsets) - 1
            change = np.zeros(len(data) + 1, np.int32)
            for a in batch.column("answers")[row].as_py() or []:
                starts, sizes = np.frombuffer(a["starts"], np.int64), np.frombuffer(a["counts"], np.uint8).astype(np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + sizes - 1 + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            head = np.zeros(len(data) + 1, bool)
            head[offsets] = True
            before = np.concatenate((np.zeros(min(1, len(data)), bool), gone[:-1]))
            after = np.concatenate((gone[1:], np.zeros(min(1, len(data)), bool)))
            lo = np.flatnonzero(gone & (head[:-1] | ~before))
            hi = np.flatnonzero(gone & (head[1:] | ~after)) + 1
            begins = np.searchsorted(lo, offsets)
            base = np.repeat(offsets[:-1], np.diff(begins))
            spans = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.StructArray.from_arrays([pa.array(lo - base), pa.array(hi - base)], ["start", "end"])).cast(spans_type)
            left = np.concatenate((np.zeros(1, np.int64), np.cumsum(~gone)))[offsets]
            kept = data[~gone].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("ids")[row].as_py(), pa.int64()),
                    pa.array(np.diff(offsets)),
                    spans,
                    pa.array([kept[left[i] : left[i + 1]] for i in range(n)], pa.binary()),
                ],
                ["doc_id", "n_bytes", "spans", "kept"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans`` (removed bytes, ``start`` to ``end``), ``kept`` (the remaining bytes)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bound = rows.mapInArrow(_pack, "ids array<long>, offsets binary, data binary")
    parts = stored(bound.withColumn("slice", F.monotonically_increasing_id()), "suffix-slices")
    buckets = max(MIN_BUCKETS, parts.count() * SLICE_BYTES // BUCKET_BYTES)

    named = parts.select("slice", "ids", "offsets", "data").mapInArrow(_name(buckets), "bucket long, slice long, low binary, high binary")
    shared = named.groupBy("bucket").applyInArrow(_shared, "slice long, bucket long, bits binary")
    answers = stored(shared, "suffix-names").groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))  # as many as there are buckets

    del named, shared
    release(spark)
    joined = parts.join(answers.hint("shuffle_hash"), "slice", "left")
    contexts = joined.mapInArrow(_context(buckets), "bucket long, slice long, starts binary, counts binary, ids binary, bytes binary")
    removed = stored(contexts.groupBy("bucket").applyInArrow(_answer, "slice long, starts binary, counts binary"), "suffix-answers")
    del joined, contexts
    release(spark)
    final = removed.where("octet_length(starts) > 0").groupBy("slice").agg(F.collect_list(F.struct("starts", "counts")).alias("answers"))
    return parts.join(final.hint("shuffle_hash"), "slice", "left").mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    rows = remove_repeats(docs, id_col, text_col)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
