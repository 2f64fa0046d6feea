"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Shingles of five words are labelled with their occurrence in the text, so that
all of a text's shingles differ.  Each of ``BANDS * ROWS`` sketches takes the
``ELL`` smallest of them under a hash of its own and retains them in the order
of the text; ``ROWS`` sketches make a band, and texts with an equal band are
candidates.  A pair is verified by aligning the two sequences of shingles:

    similarity = matched / (n_a + n_b - matched)

with the longest common subsequence of shingles as ``matched``.  A similarity
of ``MIN_SIMILARITY`` leaves at most (n_a + n_b)(1 - s) / (1 + s) shingles
unmatched, so an alignment that reaches it stays within that many diagonals of
the main one: the band cuts nothing that counts.

Classes are the connected components of verified links between different texts
(equal texts are one node from the start).  Pairs are not expanded within a
bucket.  First every member is tested against the bucket's leader, the member
with the least number; numbers are the same in all bands, so that a group of
copies has few leaders.  Then buckets whose other members still lie in several
classes are worked off without a cap, in blocks of at most about ``MAX_BLOCK``
texts and ``MAX_BLOCK_WORDS`` shingles that meet in pairs.  A block first looks
at counts of shingles by cells of their hash, which bound the matches from
above; only texts that may have a partner there are fetched.  A pair belongs to
the first band that both texts share, and is looked at there alone.

Texts move twice, to the leaders and to the blocks, and only those of pairs
whose cells allow the similarity; all else is numbers.

Defined results: a null text counts as empty; texts of fewer than five words
have one shingle of all their words; texts without words are in a class with
equal texts only; a class is named by its smallest id (null if no member has
one); repeated rows are in one class, and exactly one row of a class is kept;
an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm._common import release, stored, unused
from sievewright.llm._words import Words, mix, shingles, slices
from sievewright.operators.graph import connected_components

K = 5
MIN_SIMILARITY = 0.8
ELL, ROWS, BANDS = 2, 2, 20
#: Texts of a bucket that are compared all at once; larger buckets are dealt into blocks that meet in pairs.
MAX_BLOCK, MAX_BLOCK_WORDS = 400, 1 << 22
#: Members that meet one copy of their leader's text.
STAR = 256
#: Shingles whose occurrences are multiplied at once.
COLUMNS = 4096
#: The least number of cells, as a power of two; a text has a quarter to half as many cells as shingles.
LEAST_LEVEL = 4
#: A count that stands for itself and all above.
FULL = 255
_PLACE = np.uint64((1 << 28) - 1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_Q = np.uint64(0xD6E8FEB86659FD93)


def labelled_shingles(w: Words, n_docs: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of all rows in a slice, and the n + 1 places where rows begin.

    Rows of fewer than ``k`` words (but one) have a single shingle of them all.
    """
    at, grams = shingles(w, k)
    doc = w.doc[at]
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = np.array([mix(np.bitwise_xor.reduce(mix(w.hash[w.first[d] : w.first[d + 1]] + np.arange(size[d], dtype=np.uint64)), keepdims=True))[0] for d in short], np.uint64)
        order = np.argsort(np.concatenate((doc, short)), kind="stable")
        doc, grams = np.concatenate((doc, short))[order], np.concatenate((grams, whole))[order]
    keyed = mix(grams + doc.astype(np.uint64) * _Q)
    once = np.sort(keyed)
    twice = np.unique(once[1:][once[1:] == once[:-1]])
    if len(twice):
        some = np.flatnonzero(np.isin(keyed, twice))
        order = some[np.argsort(keyed[some], kind="stable")]
        starts = np.flatnonzero(np.concatenate((np.ones(1, bool), keyed[order][1:] != keyed[order][:-1])))
        number = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        grams = grams.copy()
        grams[order] = np.where(number > 0, mix(grams[order] + number.astype(np.uint64) * _Q), grams[order])
    return grams, np.searchsorted(doc, np.arange(n_docs + 1))


def order_minhash(grams: np.ndarray, begins: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes, one row for each text; texts without shingles get zeros."""
    n = len(begins) - 1
    out = np.zeros((n, bands), np.uint64)
    full = np.flatnonzero(np.diff(begins) > 0)
    if not len(full):
        return out
    starts = begins[full]
    place = np.arange(len(grams)) - np.repeat(starts, np.diff(np.append(starts, len(grams))))
    place = np.minimum(place, int(_PLACE)).astype(np.uint64)
    for band in range(bands):
        total = np.full(len(full), band + 1, np.uint64)
        for row in range(rows):
            seed = mix(np.array([band * rows + row + 1], np.uint64))[0]
            values = (((grams ^ seed) * (seed | np.uint64(1))) & ~_PLACE) | place
            picks = []
            for nth in range(ELL):
                least = np.minimum.reduceat(values, starts)
                picks.append(np.where(least == _TOP, _PLACE, least & _PLACE))
                if nth + 1 < ELL:
                    values[starts + (least & _PLACE).astype(np.int64)] = _TOP
            for pick in np.sort(np.array(picks), axis=0):  # in the order of the text
                there = pick < _PLACE
                total = mix(total * _Q + np.where(there, grams[np.where(there, starts + pick.astype(np.int64), 0)], np.uint64(1)))
        out[full, band] = total
    return out


def cell_counts(grams: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles of each text lie in each cell of the hash, up to ``FULL``, one text after the other; and where texts begin.

    A text has two to the power of its level cells, the same for all texts of about its size.
    """
    n = np.diff(begins)
    level = np.maximum(LEAST_LEVEL, np.log2(np.maximum(n, 1)).astype(np.int64) - 1)
    places = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.where(n > 0, 1 << level, 0))))
    doc = np.repeat(np.arange(len(n)), n)
    cell = (mix(grams) >> (64 - level[doc]).astype(np.uint64)).astype(np.int64)
    return np.minimum(np.bincount(places[doc] + cell, minlength=int(places[-1])), FULL).astype(np.uint8), places


def folded(cells: np.ndarray) -> np.ndarray:
    """The same counts in half as many cells."""
    return np.minimum(cells.reshape(-1, 2).sum(1, dtype=np.int64), FULL).astype(np.uint8)


def most_matches(a: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Upper bounds of the matches of a text with others, from their counts by the same cells."""
    low = np.minimum(a, many)
    return low.sum(1, dtype=np.int64) + (low == FULL).sum(1) * (1 << 40)


def least_matches(n: np.ndarray, m: int) -> np.ndarray:
    """Matches below which two texts of so many shingles cannot reach the similarity."""
    return MIN_SIMILARITY / (1 + MIN_SIMILARITY) * (n + m) - 1e-6


def _binaries(flat: np.ndarray, places: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            grams, begins = labelled_shingles(Words(data, offsets), hi - lo)
            bands = order_minhash(grams, begins)
            n = np.diff(begins)
            flat = pa.array(bands[n > 0].reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1, np.int64), np.cumsum(np.where(n > 0, BANDS, 0)))), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n), lists, _binaries(*cell_counts(grams, begins))], ["id", "key", "n", "bands", "cells"])


def aligned(a: np.ndarray, b: np.ndarray, least: float = MIN_SIMILARITY) -> float:
    """Similarity of two sequences of distinct shingles by their banded alignment; 0 if it is below ``least``."""
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < least * (na + nb - len(i)):
        return 0.0
    j = j[np.argsort(i)]
    i = np.sort(i)
    near = np.abs(i - j) <= (na + nb) * (1 - least) / (1 + least) + 1
    j = j[near]
    if np.all(j[1:] > j[:-1]):
        matched = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        matched = len(tails)
    found = matched / (na + nb - matched)
    return found if found >= least else 0.0


def _sequences(column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for lo, hi, data, offsets in slices(column):
        grams, begins = labelled_shingles(Words(data, offsets), hi - lo)
        out += [grams[begins[d] : begins[d + 1]] for d in range(hi - lo)]
    return out


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in column]


def _have_room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose lengths and cells allow the similarity; the last four columns are the counts of both sides."""
    for batch in batches:
        keep = []
        sides = zip(*(batch.column(c).to_pylist() for c in ("n", "ln")), *(_bytes(batch.column(c)) for c in ("cells", "lcells")), strict=True)
        for i, (n, m, a, b) in enumerate(sides):
            if min(n, m) >= MIN_SIMILARITY * max(n, m):
                while len(a) > len(b):
                    a = folded(a)
                while len(b) > len(a):
                    b = folded(b)
                if most_matches(a, b[None, :])[0] >= least_matches(n, m):
                    keep.append(i)
        yield batch.select(batch.schema.names[:-4]).take(pa.array(keep, pa.int64()))


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of members with their leader, whose text comes before theirs: ``leader, salt, node, text``."""
    held, lead = None, np.zeros(0, np.uint64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            found = []
            for leader, node, grams in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), _sequences(part.column(3)), strict=True):
                if leader == node:
                    held, lead = leader, grams
                elif leader == held and (similarity := aligned(lead, grams)) >= MIN_SIMILARITY:
                    found.append((min(leader, node), max(leader, node), similarity))
            yield _link_batch(found)


def _link_batch(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])


def with_partners(h: int, n: np.ndarray, comps: np.ndarray, bands: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
    """Which texts of a block have a possible partner in another class, in a pair that belongs to this bucket."""
    out = np.zeros(len(n), bool)
    size = np.array([len(c) for c in cells])
    for width in np.unique(size).tolist():
        own, wider = np.flatnonzero(size == width), np.flatnonzero(size == 2 * width)
        rows = np.concatenate((own, wider))
        table = np.array([cells[i] if size[i] == width else folded(cells[i]) for i in rows.tolist()])
        for at, i in enumerate(own.tolist()):
            later = np.arange(len(rows)) > at
            ok = later & (comps[rows] != comps[i]) & (np.minimum(n[rows], n[i]) >= MIN_SIMILARITY * np.maximum(n[rows], n[i]))
            some = np.flatnonzero(ok)
            some = some[most_matches(table[at], table[some]) >= least_matches(n[rows[some]], n[i])]
            if len(some):
                equal = bands[rows[some]] == bands[i]
                some = some[bands[i][np.argmax(equal, axis=1)] == h]  # the first band that both share
                out[rows[some]] = True
                out[i] |= len(some) > 0
    return out


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
        lo = 0
        for hi in range(1, len(keys) + 1):
            if hi == len(keys) or keys[hi] != keys[lo]:
                if held and keys[lo] != key:
                    yield pa.Table.from_batches(held)
                    held = []
                key = keys[lo]
                held.append(batch.slice(lo, hi - lo))
                lo = hi
    if held:
        yield pa.Table.from_batches(held)


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, without those that have no possible partner; the last three columns are left out."""
    for block in _runs(batches, 2):
        block = block.combine_chunks()
        if block.num_rows > 1:
            bands = block.column("bands").combine_chunks()
            found = with_partners(
                block.column("h")[0].as_py(), block.column("n").to_numpy(), block.column("comp").to_numpy(), np.asarray(bands.values if bands.offset == 0 else bands.flatten()).reshape(-1, BANDS), _bytes(block.column("cells").combine_chunks())
            )
            if found.any():
                yield from block.select(block.column_names[:-3]).filter(pa.array(found)).to_batches()


def possible_pairs(grams: list[np.ndarray]) -> np.ndarray:
    """Pairs of texts whose common shingles allow the similarity, from the product of the occurrence matrix with itself."""
    m, sizes = len(grams), np.array([len(g) for g in grams])
    _, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    text, shared = np.repeat(np.arange(m), sizes), count[column] > 1
    column, text = (np.cumsum(count > 1) - 1)[column[shared]], text[shared]
    order = np.argsort(column)
    column, text = column[order], text[order]
    common = np.zeros((m, m), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
        occurs = np.zeros((m, COLUMNS), np.float32)
        occurs[text[part], column[part] - lo] = 1
        common += occurs @ occurs.T
    return np.argwhere(np.triu(common >= MIN_SIMILARITY * (sizes[:, None] + sizes[None, :] - common) - 1e-3, 1))


def links_within(nodes: list[int], comps: list[int], grams: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """Verified pairs that join the classes ``comps`` of one block; pairs whose texts are in one class by then are not needed."""
    root: dict[int, int] = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    found = []
    for i, j in possible_pairs(grams).tolist():
        a, b = find(comps[i]), find(comps[j])
        if a != b and (similarity := aligned(grams[i], grams[j])) >= MIN_SIMILARITY:
            root[a] = b
            found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), similarity))
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of blocks: ``h, block, node, comp, text``."""
    for block in _runs(batches, 2):
        nodes, comps, grams = [], [], []
        for part in block.select(["node", "comp", "text"]).to_batches():
            nodes += part.column(0).to_pylist()
            comps += part.column(1).to_pylist()
            grams += _sequences(part.column(2))
        first = list({n: i for i, n in reversed(list(enumerate(nodes)))}.values())  # repeated rows of a text
        if len(first) > 1:
            yield _link_batch(links_within([nodes[i] for i in first], [comps[i] for i in first], [grams[i] for i in first]))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (node, comp)`` with the components that ``links (a, b)`` join made one; nodes that had no label get one."""
    of_a, of_b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    joined = links.join(of_a.hint("merge"), "a", "left").join(of_b.hint("merge"), "b", "left")
    moved = stored(connected_components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "moved").toDF("comp", "_to")
    old = labels.join(moved.hint("merge"), "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))
    fresh = moved.join(labels.select(F.col("node").alias("comp")).hint("merge"), "comp", "left_anti")
    return old.unionAll(fresh.select(F.col("comp").alias("node"), F.col("_to").alias("comp")))


def _with_text(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """``wanted (key, rep, ...)`` with the text of the row that has this key and id.

    Copies of a text have different ids, so they do not meet in one task; the
    texts are dealt out once and not sorted.
    """
    return rows.join(wanted.hint("shuffle_hash"), (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("rep")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members ``id, key, class_id, kept_text, rep`` (one row per document), and the links ``a, b, similarity`` that make the classes."""
    spark = docs.sparkSession
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(own.alias("id"), F.coalesce(text, F.lit("")).alias("text"), text_key(text).alias("key"))
    signed = stored(rows.mapInArrow(_sign, f"id {kind}, key binary, n long, bands array<long>, cells binary"), "signed")
    nodes = signed.groupBy("key").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "bands", "cells")))
    nodes = stored(nodes.withColumn("i", F.monotonically_increasing_id()), "nodes").withColumn("node", F.xxhash64("i")).drop("i")

    # Band hashes have the band in them, and so tell buckets apart alone.
    banded = nodes.select("node", "n", F.explode("bands").alias("h"))
    buckets = stored(banded.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("leader")).where("m > 1").select("h", "leader"), "buckets")
    members = stored(banded.join(buckets.hint("merge"), "h").where("node <> leader"), "members")

    # Stars: every member with its leader, unless lengths or cells rule the pair out.
    side = lambda prefix: nodes.select(F.col("node").alias("leader" if prefix else "node"), *(F.col(c).alias(prefix + c) for c in ("key", "rep", "n", "cells"))).hint("merge")
    pairs = members.select("node", "leader").distinct().join(side(""), "node").join(side("l"), "leader").select("node", "leader", "key", "rep", "lkey", "lrep", "n", "ln", "cells", "lcells")
    tested = stored(pairs.mapInArrow(_have_room, f"node long, leader long, key binary, rep {kind}, lkey binary, lrep {kind}"), "pairs")
    stars = stored(tested.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"), F.first("lkey").alias("lkey"), F.first("lrep").alias("lrep")), "stars")
    rays = tested.join(stars.select("leader", "salts").hint("merge"), "leader").select("leader", F.pmod("node", F.col("salts")).cast("int").alias("salt"), "node", "key", "rep")
    leads = stars.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("node"), "lkey", "lrep").toDF("leader", "salt", "node", "key", "rep")
    dealt = _with_text(rays.unionAll(leads).withColumnRenamed("key", "_key"), rows).select("leader", "salt", "node", "text")
    dealt = dealt.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("node") != F.col("leader"))
    links = stored(dealt.mapInArrow(_star, "a long, b long, similarity double"), "links")
    release(spark)
    labels = stored(connected_components(links), "labels")

    # Buckets whose other members still lie in several classes: all their pairs, in blocks.
    with_comp = members.select("h", "node", "n").join(labels.hint("merge"), "node", "left").select("h", "node", "n", F.coalesce("comp", "node").alias("comp"))
    mixed = with_comp.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("words")).where("lo <> hi")
    share = F.greatest(F.col("m") / MAX_BLOCK, F.col("words") / MAX_BLOCK_WORDS)
    mixed = stored(mixed.select("h", F.when(share <= 1, 1).otherwise(F.ceil(share * 2)).cast("int").alias("halves")), "mixed")
    if not mixed.isEmpty():
        halved = with_comp.drop("n").join(mixed.hint("merge"), "h").withColumn("half", F.pmod(F.xxhash64("node"), F.col("halves")).cast("long"))
        paired = halved.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("halves") - 1))).where("halves = 1 or half <> other")
        block = F.when(F.col("halves") == 1, 0).otherwise(F.least("half", "other") * F.col("halves") + F.greatest("half", "other"))
        paired = paired.select("h", block.alias("block"), "node", "comp").join(nodes.select("node", "key", "rep", "n", "bands", "cells").hint("merge"), "node")
        paired = paired.select("h", "block", "node", "comp", "key", "rep", "n", "bands", "cells").repartition("h", "block").sortWithinPartitions("h", "block")
        wanted = stored(paired.mapInArrow(_partners, f"h long, block long, node long, comp long, key binary, rep {kind}"), "partners")
        if not wanted.isEmpty():
            texts = _with_text(wanted.withColumnRenamed("key", "_key"), rows).select("h", "block", "node", "comp", "text")
            more = texts.repartition("h", "block").sortWithinPartitions("h", "block").mapInArrow(_blocks, "a long, b long, similarity double")
            more = stored(more, "links")
            links = links.unionAll(more)
            labels = stored(_merged(labels, more), "labels")
            release(spark)

    named = labels.join(nodes.select("node", "key", "rep").hint("merge"), "node")
    named = stored(named.select("comp", "key", "rep"), "named")
    names = named.groupBy("comp").agg(F.min("rep").alias("class_id"), F.min(F.struct(F.col("rep").isNull(), F.col("rep"), F.col("key")))["key"].alias("kept_key"))
    names = stored(names, "names")  # a join of two tables can be split at a hot key
    found = named.join(names.hint("merge"), "comp").select("key", "class_id", (F.col("key") == F.col("kept_key")).alias("kept_text"))
    classes = nodes.select("key", "rep").join(found.hint("merge"), "key", "left")
    classes = stored(classes.select("key", F.when(F.col("kept_text").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("kept_text", F.lit(True)).alias("kept_text"), "rep"), "classes")
    return signed.select("id", "key").join(classes.hint("merge"), "key"), links


def near_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id`` and ``kept`` (one text of each class; repeated rows of it alike)."""
    members, _ = near_classes(docs, id_col, text_col)
    kept = F.col("kept_text") & F.col("id").eqNullSafe(F.col("rep"))
    return members.select(F.col("id").alias("doc_id"), "class_id", kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, with all their columns."""
    members, _ = near_classes(docs, id_col, text_col)
    row_key = lambda i, k: F.concat_ws(":", i.cast("string"), F.hex(k))
    stay = members.where(F.col("kept_text") & F.col("id").eqNullSafe(F.col("rep"))).groupBy(row_key(F.col("id"), F.col("key")).alias("_stays")).agg(F.count(F.lit(1)).alias("_rows"))
    key, stays, count = unused(docs, "_sw_key", "_sw_stays", "_sw_rows")
    stay = stored(stay, "stay").toDF(stays, count)
    own = docs.withColumn(key, row_key(F.col(f"`{id_col}`"), text_key(F.col(f"`{text_col}`").cast("string"))))
    joined = own.join(stay.hint("merge"), F.col(key) == F.col(stays))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if stay.where(F.col(count) > 1).isEmpty():
        return joined.select(columns)
    return joined.where(F.col(count) == 1).select(columns).unionAll(joined.where(F.col(count) > 1).dropDuplicates([key]).select(columns))
