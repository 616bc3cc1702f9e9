"""N-gram Jaccard join: universe-partition pigeonhole with exact verification.

A document's set has the hashes of its distinct 5-word shingles. Sets are put into bands by
size, each 4/3 of the one before, so that two sets of Jaccard similarity 3/4 or more lie in
one band or in neighbouring ones. In the context of a band with largest size U the universe
of shingles is dealt by hash into M segments; r and s (no larger than r, in the band) differ
in at most H = floor((|r| + min(|r|, U)) / 7) elements if they are that similar.

* Pigeonhole. Give segment i of r a threshold v_i of -1, 0 or 1. If the v_i + 1 sum up to
  H + 1 or more, then some segment has r_i and s_i differing in at most v_i elements. Each set
  indexes its non-empty segment subsets in its own context and in the one below. Threshold 0
  is met by equal subsets, threshold 1 also by one-deletion neighbours, which sets index in the
  contexts of small bands. In those of larger bands a set has so many segments that -1 and 0
  are enough.
* Cost-based allocation, set by set. The first unit of a segment costs the other sets with the
  same subset, the second one those that are one deletion away. Units that no other set meets
  cost nothing, need no probe and already count; of the others r takes the cheapest until they
  are H + 1. A set with H + 1 units of no cost has no similar partner at all. In larger bands all
  sets order subsets alike, so only the first ones of the smaller set need be met either.
* A set whose units don't reach H + 1 (all its shingles in one or two segments: of seven
  shingles once in 16 million) is paired with all sets that share a shingle with it.
* Candidates. In each probed segment, all sets are first paired with one of them. Links
  found give components; then, where a segment has sets of several components, those of a
  segment of up to ``LIGHT`` sets are paired, and those of more are compared in blocks
  (``links_between``), so no link between components is missed and pairs within a group of
  copies are not listed.
* Verification counts the shingles that both sets have, by their names of 128 bits.

Documents with equal sets are one class from the start and share its component. Component
ids are the smallest document id in the component.

Defined cases: a text of one to four words has its whole sequence as its one shingle; null
and wordless texts have the empty set, which is linked with nothing; ids that are no integers
are compared as texts; a null id is never the smallest unless all are null; repeated rows are
one class; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.components import components
from shapeloom.llm.ids import LAST, last_id, ordered_id
from shapeloom.llm.lean import lean
from shapeloom.llm.words import Words, chunked, mix, owner, windows
from shapeloom.shared import stored, tidy

WORDS = 5
#: Similarity of 3/4: 100 times the intersection against 75 times the union.
SHARE, WHOLE = 75, 100
#: Segments of the smallest bands; larger ones have 9/20 of their largest size.
LEAST_SEGMENTS = 16
#: Bands with a largest size up to this index one-deletion neighbours.
SMALL = 128
#: Index entries a packed row may hold, and entries a bucket shall have.
PACK = 1 << 20
BUCKET = 500_000
#: Shingles of a block of a family.
BLOCK_SHINGLES = 1_000_000
#: Parts of the universe in which shingles are counted before pairs are compared.
PARTS = 64
#: Sets of a segment that are paired one by one.
LIGHT = 16

#: The least sizes of the bands.
FLOORS = [1]
while FLOORS[-1] < 1 << 40:
    FLOORS.append(-(-FLOORS[-1] * 4 // 3))
FLOORS = np.array(FLOORS, np.int64)


def shingles(column: pa.Array, check: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(document, hash, second hash if ``check``) of all distinct shingles, ordered by document
    and hash. Both hashes together are a shingle's name."""
    words = Words(column, lower=True)
    n = np.diff(words.first)
    few = [np.flatnonzero(n == k) for k in range(1, WORDS)]

    def hashed(salt: int) -> tuple[np.ndarray, np.ndarray]:
        h = words.hashes(salt)
        w, at = windows(h, words.first, WORDS, salt + 1)
        out = [w]
        for k, own in enumerate(few, 1):
            x = np.full(len(own), k, np.uint64)
            for j in range(k):
                x = mix(x ^ mix(h[words.first[own] + j] + np.uint64(salt)))
            out.append(x)
        return np.concatenate(out), at

    w, at = hashed(0)
    doc = np.concatenate([owner(at, words.first), *few])
    order = np.lexsort((w, doc))
    second = hashed(2)[0] if check else None
    new = np.ones(len(w), bool)

    def marked() -> np.ndarray:
        new[1:] = (w[order][1:] != w[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        return new

    if not check:
        marked()
        return doc[order][new], w[order][new], None
    x = second[order]
    if ((x[1:] != x[:-1]) & ~marked()[1:]).any():  # equal hashes of different shingles
        order = np.lexsort((second, w, doc))
        x = second[order]
    new[1:] = marked()[1:] | (x[1:] != x[:-1])
    return doc[order][new], w[order][new], x[new]


def class_ids(doc: np.ndarray, w: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each set: equal sets have equal ones."""
    total = np.zeros(n, np.uint64)
    np.add.at(total, doc, mix(w ^ np.uint64((0x7F4A7C159E3779B9 * (2 * seed + 1)) & (2**64 - 1))))
    return mix(total + np.bincount(doc, minlength=n).astype(np.uint64)).view(np.int64)


class Partition:
    """How sets of given sizes are dealt into segments in one of their two contexts."""

    def __init__(self, sizes: np.ndarray, below: bool, least: int):
        band = np.searchsorted(FLOORS, sizes, side="right") - 1 - int(below)
        self.ok = (band >= 0) & (sizes > 0)
        self.band = np.maximum(band, 0)
        top = FLOORS[self.band + 1] - 1
        self.segments = np.maximum(least, (top * 9 + 19) // 20)
        self.need = (sizes + np.minimum(sizes, top)) // 7 + 1
        self.deletions = top <= SMALL
        #: The most elements in which a set differs from a larger partner.
        self.most = (sizes + sizes * 4 // 3) // 7

    def subsets(self, doc: np.ndarray, w: np.ndarray, seed: int):
        """(key, document, segment, size) of the non-empty subsets, and (key, document, segment) of
        their one-deletion neighbours."""
        use = self.ok[doc]
        doc, w = doc[use], w[use]
        place = mix(w + np.uint64(0x632BE59BD9B4E019 * (seed + 1) & (2**64 - 1)))
        seg = ((place >> np.uint64(32)) * self.segments[doc].astype(np.uint64)) >> np.uint64(32)
        order = np.lexsort((seg, doc))
        doc, seg, x = doc[order], seg[order], mix(w[order] + np.uint64(0x1234567))
        if not len(doc):
            return (np.empty(0, np.uint64), doc, doc, doc), (np.empty(0, np.uint64), doc, doc)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(doc)))
        total = np.add.reduceat(x, start)
        salt = mix((self.band[doc[start]].astype(np.uint64) << np.uint64(40)) + seg[start])
        of = np.cumsum(new) - 1
        drop = self.deletions[doc] & (size[of] >= 2)
        seg = seg.astype(np.int64)
        return (mix(total + salt), doc[start], seg[start], size), (mix((total[of] - x + salt[of])[drop]), doc[drop], seg[drop])


def profile(docs: DataFrame, seed: int, least: int, keep: list[str]) -> DataFrame:
    """(d, id, text) and ``keep`` -> (d, id, n, c: its class, c2: another hash of it, of both
    contexts: held (segments that aren't empty), able (units), need (H + 1), small (one-deletion
    neighbours are indexed); band; most: one more than it and a larger partner may differ in;
    short: its units don't suffice) and ``keep``."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("d", "id", *keep)}
    names = ["d", "id", "n", "c", "c2", "band", "most", *(f"{x}{k}" for k in (0, 1) for x in ("held", "able", "need", "small")), "short", *keep]

    def run(batches):
        for batch in chunked(batches):
            doc, w, x = shingles(batch.column(2), check=True)
            n = np.bincount(doc, minlength=batch.num_rows)
            short, out = np.zeros(len(n), bool), []
            for below in (False, True):
                p = Partition(n, below, least)
                (_, of, _, size), _ = p.subsets(doc, w, seed)
                held = np.bincount(of, minlength=len(n))
                able = np.where(p.deletions, np.bincount(of, weights=np.minimum(size, 2), minlength=len(n)).astype(np.int64), held)
                short |= p.ok & (able < p.need)
                out += [pa.array(np.where(p.ok, v, 0), pa.int64()) for v in (held, able, p.need)] + [pa.array(p.deletions & p.ok)]
                if not below:
                    own = [pa.array(p.band, pa.int32()), pa.array(p.most + 1, pa.int64())]
            head = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(class_ids(doc, w, len(n), seed)), pa.array(class_ids(doc, x, len(n), seed + 1))]
            yield pa.RecordBatch.from_arrays([*head, *own, *out, pa.array(short), *batch.columns[3:]], names)

    shape = ", ".join(f"{x}{k} {'boolean' if x == 'small' else 'long'}" for k in (0, 1) for x in ("held", "able", "need", "small"))
    more = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return docs.select("d", "id", "text", *keep).mapInArrow(lean(run), f"d {kinds['d']}, id {kinds['id']}, n long, c long, c2 long, band int, most long, {shape}, short boolean{more}")


def index_rows(docs: DataFrame, buckets: int, seed: int, least: int) -> DataFrame:
    """Packed index entries: (bucket, sets, keys, at, segs). An entry is the 40 key bits below
    those that name the bucket, the place of its set in ``sets`` with flags for its kind (a
    deletion neighbour, the context below), and of small contexts the segment, with a flag for
    subsets of two or more."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        sets: list[np.ndarray] = []
        n_sets = n = 0

        def flush():
            key, at, seg = (np.concatenate(x) for x in zip(*held, strict=True))
            names = np.concatenate(sets)
            held.clear()
            sets.clear()
            bucket = bucket_of(key, buckets)
            order = np.argsort(bucket, kind="stable")
            key, at, seg, bucket = key[order], at[order], seg[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own, place = np.unique(at[a:b] >> 2, return_inverse=True)
                packed = (place.astype(np.uint32) << np.uint32(2)) | (at[a:b] & 3).astype(np.uint32)
                packed = packed.astype(np.uint16) if len(own) < 1 << 14 else packed
                low = np.ascontiguousarray(key[a:b, None].view(np.uint8)[:, :5])
                yield int(bucket[a]), names[own].tobytes(), low.tobytes(), packed.tobytes(), seg[a:b].tobytes()

        def batch_of(rows):
            kinds = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "sets", "keys", "at", "segs"])

        for batch in chunked(batches):
            doc, w, _ = shingles(batch.column(0))
            sizes = np.bincount(doc, minlength=batch.num_rows)
            names = class_ids(doc, w, len(sizes), seed)
            keep = np.zeros(len(sizes), bool)  # one of the equal sets of a chunk
            keep[np.unique(names, return_index=True)[1]] = True
            doc, w = doc[keep[doc]], w[keep[doc]]
            for below in (0, 1):
                p = Partition(sizes, bool(below), least)
                (key, of, seg, size), (dkey, dof, dseg) = p.subsets(doc, w, seed)
                seg = np.where(p.deletions[of], seg << 1 | (size >= 2), 0)
                for k, o, g, kind in ((key, of, seg, 0), (dkey, dof, dseg << 1 | 1, 1)):
                    held.append((k, ((o + n_sets) << 2) | (2 * below + kind), g.astype(np.uint8)))
                    n += len(k)
            sets.append(names)
            n_sets += len(names)
            if n >= PACK:
                yield batch_of(list(flush()))
                held, sets, n_sets, n = [], [], 0, 0
        if n:
            yield batch_of(list(flush()))

    return docs.select("text").mapInArrow(lean(run), "bucket int, sets binary, keys binary, at binary, segs binary")


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def repeated(rows: DataFrame) -> DataFrame:
    """(c, below, kind, key, seg, full, near): the entries whose key another set has too, and how
    many sets have it as their subset and as a neighbour of it."""

    def solve(bucket: int, packs: list[tuple[pa.Buffer, ...]]) -> tuple[np.ndarray, ...]:
        keys, sets, flags, segs = [], [], [], []
        for names, low, at, seg in packs:
            key = np.zeros((len(low) // 5, 8), np.uint8)
            key[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
            place = np.frombuffer(at, np.uint16 if len(at) * 5 == len(low) * 2 else np.uint32).astype(np.int64)
            keys.append(key.view(np.uint64)[:, 0] | np.uint64(bucket << 40))
            sets.append(np.frombuffer(names, np.int64)[place >> 2])
            flags.append(place & 3)
            segs.append(np.frombuffer(seg, np.uint8))
        key, c, flag, seg = (np.concatenate(x) for x in (keys, sets, flags, segs))
        # Most keys have one entry: they go before the costly sort by set.
        order = np.argsort(key, kind="stable")
        sk = key[order]
        alone = np.ones(len(sk), bool)
        same = sk[1:] == sk[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        order = order[~alone]
        key, c, flag, seg = key[order], c[order], flag[order], seg[order]
        order = np.lexsort((flag, c, key))
        key, c, flag, seg = key[order], c[order], flag[order], seg[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1]) | (flag[1:] != flag[:-1])
        key, c, flag, seg = key[new], c[new], flag[new], seg[new]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        group = np.cumsum(first) - 1
        distinct = np.ones(len(key), bool)
        distinct[1:] = first[1:] | (c[1:] != c[:-1])
        whole = (flag & 1) == 0
        count = lambda x: np.bincount(group, weights=x)[group].astype(np.int64) if len(key) else np.empty(0, np.int64)
        full, near, several = count(whole), count(~whole), count(distinct) > 1
        # Neighbours alone meet nothing.
        use = several & (full > 0)
        return tuple(x[use] for x in (key, c, flag, seg, full, near))

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        now, packs, n = None, [], 0

        def out():
            key, c, flag, seg, full, near = (np.concatenate(x) for x in zip(*held, strict=True))
            columns = [(c, pa.int64()), (flag >> 1, pa.int32()), (flag & 1, pa.int32()), (key.view(np.int64), pa.int64()), (seg, pa.int32()), (full, pa.int64()), (near, pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in columns], ["c", "below", "kind", "key", "seg", "full", "near"])

        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now and packs:
                    held.append(solve(now, packs))
                    n += len(held[-1][0])
                    packs = []
                    if n >= PACK:
                        yield out()
                        held, n = [], 0
                now = bucket
                packs.append(tuple(x[i].as_buffer() for x in batch.columns[1:]))  # no copies
        if packs:
            held.append(solve(now, packs))
            n += len(held[-1][0])
        if n:
            yield out()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "c long, below int, kind int, key long, seg int, full long, near long")


def rank_in(group: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """The place of each row in its group, ordered by ``by``."""
    order = np.lexsort((*reversed(by), group))
    first = np.ones(len(order), bool)
    first[1:] = group[order][1:] != group[order][:-1]
    start = np.flatnonzero(first)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return out


def chosen(group: np.ndarray, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of sets' contexts (``group``, from 0 on) are kept and which are probed.

    Large contexts: a set's subsets in the order of the number of sets and the key, which is
    the same for all sets. The first H + 1 of r and the first of s, as many as s and a partner of
    it may differ in and one more, share a subset if the two are similar. Small contexts: the
    cheapest units; r probes a subset for a segment's first unit, its neighbours too for the
    second, and s is met in all its entries.
    """
    n = int(group[-1]) + 1 if len(group) else 0
    whole, small, own = x["kind"] == 0, x["small"], x["below"] == 0
    per = lambda weights: np.bincount(group, weights=weights, minlength=n).astype(np.int64)[group]
    # Large contexts.
    free = x["held"] - per(whole)
    missing = x["need"] - free
    rank = rank_in(group, ~whole, x["full"], x["key"])
    probe = ~small & (rank < missing)
    keep = ~small & (rank < np.where(own, np.maximum(missing, x["most"] - free), missing))
    if not small.any():
        return keep, probe
    # Small contexts: a row for each segment of a set, its two units, and their costs.
    at = np.flatnonzero(small)
    place = group[at] * 256 + x["seg"][at]
    segment, of = np.unique(place, return_inverse=True)
    sums = lambda weights: np.bincount(of, weights=weights, minlength=len(segment)).astype(np.int64)
    is_whole = whole[at]
    first = np.maximum(sums(np.where(is_whole, x["full"][at] - 1, 0)), 0)
    second = np.maximum(first, sums(np.where(is_whole, x["near"][at], x["full"][at])))
    two = (segment & 1) == 1
    unit_segment = np.concatenate([np.arange(len(segment)), np.flatnonzero(two)])
    cost = np.concatenate([first, second[two]])
    number = np.concatenate([np.zeros(len(segment), np.int64), np.ones(int(two.sum()), np.int64)])
    unit_group = segment[unit_segment] // 256
    some = np.zeros(n, np.int64)
    some[group[at]] = x["need"][at] - x["able"][at]
    left = some + np.bincount(unit_group, minlength=n)  # units to be taken from those that others meet
    taken = rank_in(unit_group, cost, number, unit_segment) < left[unit_group]
    threshold = np.bincount(unit_segment[taken], minlength=len(segment)) - 1
    v = threshold[of]
    probe[at] = v >= np.where(is_whole, 0, 1)
    keep[at] = own[at] | probe[at]
    return keep, probe


def allocate(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, c, n, context, rank, below, probe, kind): the entries that can still lead to a pair,
    and whether their set probes them; rank: how much of the set other sets have too."""
    below = F.col("below") == 1
    named = lambda x: F.when(below, F.col(f"{x}1")).otherwise(F.col(f"{x}0")).alias(x)
    # One row a set and context before the join, so that a set's entries stay together.
    lists = found.groupBy("c", "below").agg(F.collect_list(F.struct("kind", "key", "seg", "full", "near")).alias("es"))
    rows = lists.join(classes.hint("merge"), "c").select("c", "n", (F.col("band") - F.col("below")).alias("context"), "below", "most", *(named(x) for x in ("held", "able", "need", "small")), "es")

    def run(batches):
        for batch in batches:
            size = np.asarray(pa.compute.list_value_length(batch.column(9)))
            group = np.repeat(np.arange(len(size)), size)
            es = batch.column(9).flatten()
            x = {k: es.field(k).to_numpy(zero_copy_only=False) for k in ("kind", "key", "seg", "full", "near")}
            head = {k: np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i, k in enumerate(("c", "n", "context", "below", "most", "held", "able", "need", "small"))}
            x |= {k: v[group] for k, v in head.items()}
            keep, probe = chosen(group, x)
            shared = np.bincount(group, weights=x["kind"] == 0, minlength=len(size)) * 1000 // np.maximum(head["held"], 1)
            out = [(x["key"], pa.int64()), (x["c"], pa.int64()), (x["n"], pa.int64()), (x["context"], pa.int32()), (shared[group].astype(np.int32), pa.int32()), (x["below"], pa.int32()), (probe, pa.bool_()), (x["kind"], pa.int32())]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[keep], t) for v, t in out], ["key", "c", "n", "context", "rank", "below", "probe", "kind"])

    return rows.mapInArrow(lean(run), "key long, c long, n long, context int, rank int, below int, probe boolean, kind int")


def sets_of(docs: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """(c, n, w, x, counts): the shingles of the classes (c, d), from the text of document d, their
    second hashes, and how many of them fall in each of ``PARTS`` parts of the universe."""

    def run(batches):
        for batch in chunked(batches):
            doc, w, x = shingles(batch.column(0), check=True)
            sizes = np.bincount(doc, minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            same = class_ids(doc, w, len(sizes), seed) == np.asarray(batch.column(1))  # of documents with one id, the right one
            counts = np.bincount(doc * PARTS + (w >> np.uint64(32)).astype(np.int64) % PARTS, minlength=len(sizes) * PARTS).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array((np.arange(len(sizes) + 1) * PARTS).astype(np.int32)), pa.array(counts))
            out = pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(v.view(np.int64))) for v in (w, x)), parts], ["c", "n", "w", "x", "counts"])
            yield out.filter(pa.array(same))

    texts = docs.select("d", "text").join(classes.select("d", "c").hint("merge"), "d").select("text", "c")
    return texts.mapInArrow(lean(run), "c long, n long, w array<long>, x array<long>, counts array<int>").dropDuplicates(["c"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes that are similar enough. Shingles are equal if both of
    their hashes are, so the fewer common ones count.

    Sets are sent only for pairs that may be: two sets have no more shingles in common than the
    smaller of their numbers in each part of the universe."""
    a = sets.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("w").alias("wa"), F.col("x").alias("xa"), F.col("counts").alias("pa"))
    b = sets.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("w").alias("wb"), F.col("x").alias("xb"), F.col("counts").alias("pb"))
    enough = lambda common: common * WHOLE >= (F.col("na") + F.col("nb") - common) * SHARE
    most = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    able = pairs.join(b.select("b", "nb", "pb").hint("merge"), "b").join(a.select("a", "na", "pa").hint("merge"), "a").where(enough(most)).select("a", "b", "na", "nb")
    both = stored(able, "jaccard-able").join(a.select("a", "wa", "xa").hint("merge"), "a").join(b.select("b", "wb", "xb").hint("merge"), "b")
    return both.where(enough(F.size(F.array_intersect("wa", "wb")))).where(enough(F.size(F.array_intersect("xa", "xb")))).select("a", "b")


def cross_links(names: np.ndarray, sets: list[np.ndarray], second: list[np.ndarray], root: np.ndarray, probe: np.ndarray, own: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Similar pairs of sets in different components, one of which probes and the other of
    which is in its own context: for each probing set one of each component that it has a
    link to. ``side``: only pairs of both sides, if given. Each probing set counts its
    shingles' other holders."""
    size = np.array([len(x) for x in sets])
    holder = np.repeat(np.arange(len(sets)), size)
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    holders, start = holder[order], np.searchsorted(at[order], np.arange(len(words) + 1))
    cut = np.concatenate([[0], np.cumsum(size)])
    del words, order, holder
    out = []
    for a in np.flatnonzero(probe).tolist():
        mine = at[cut[a] : cut[a + 1]]
        n = start[mine + 1] - start[mine]
        found = holders[np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        common = np.bincount(found, minlength=len(sets))
        ok = own & (root != root[a]) & (common * WHOLE >= (size + size[a] - common) * SHARE)
        if side is not None:
            ok &= side != side[a]
        hits = np.flatnonzero(ok)
        if len(hits):  # by the second hashes as well
            both = np.array([len(np.intersect1d(second[a], second[b])) for b in hits.tolist()])
            hits = hits[both * WHOLE >= (size[hits] + size[a] - both) * SHARE]
        for b in hits[np.unique(root[hits], return_index=True)[1]].tolist():  # one link to a component is enough
            out.append((int(max(names[a], names[b])), int(min(names[a], names[b]))))
    return out


def links_between(live: DataFrame, roots: DataFrame, sets: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) of classes in different components, those that join any two of them.

    A key of up to ``LIGHT`` entries lists its pairs of a probe and another component's set of
    like size. Sets of a context that share keys of more entries, directly or over others, are
    a family. Its probes are compared with all its sets, in blocks of bounded size, and only
    links leave the task: each set is sent once a pair of blocks it's in, however many keys it
    shares.
    """
    labelled = live.join(roots.select(F.col("v").alias("c"), "root").hint("merge"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    several = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("probe").alias("probed"), F.count(F.lit(1)).alias("entries")).where("r0 < r1 AND probed").select("key", "entries")
    rest = labelled.join(several.hint("merge"), "key").select("key", "entries", "c", "n", "below", "probe", "kind", "root", F.xxhash64("c", "context").alias("v"))
    rest = stored(rest, "jaccard-rest", small=True)
    few = rest.where(F.col("entries") <= LIGHT)
    r = few.where("probe").select("key", F.col("c").alias("r"), F.col("n").alias("nr"), F.col("kind").alias("kr"), F.col("root").alias("rr"))
    s = few.where("below = 0").select("key", F.col("c").alias("s"), F.col("n").alias("ns"), F.col("kind").alias("ks"), F.col("root").alias("rs"))
    listed = r.join(s.hint("merge"), "key").where("rr <> rs AND kr + ks < 2 AND 4 * ns >= 3 * nr AND 4 * nr >= 3 * ns")
    listed = verify(listed.select(F.greatest("r", "s").alias("a"), F.least("r", "s").alias("b")).distinct(), sets)
    rest = rest.where(F.col("entries") > LIGHT)
    stars = rest.join(rest.groupBy("key").agg(F.min("v").alias("m")).hint("merge"), "key").select(F.col("v").alias("a"), F.col("m").alias("b"))
    family = components(stars).withColumnRenamed("root", "family")
    nodes = rest.groupBy("v").agg(F.max("probe").alias("probe"), F.min("below").alias("below"), *(F.first(x).alias(x) for x in ("c", "n", "root")))
    nodes = stored(nodes.join(family.hint("merge"), "v"), "jaccard-nodes", small=True)
    blocks = stored(nodes.groupBy("family").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks")), "jaccard-blocks", small=True)
    block, other = F.pmod(F.xxhash64("c"), "blocks").cast("int"), F.col("other")
    dealt = nodes.join(blocks.hint("merge"), "family").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", other).alias("i"), F.greatest("block", other).alias("j"), "block", "c", "root", "probe", "below")
    rows = dealt.join(sets.select("c", "w", "x").hint("merge"), "c").select("family", "i", "j", "block", "c", "root", "probe", "below", "w", "x")

    def solve(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(group)
        block, names, root, probe, below = (t[x].to_numpy() for x in ("block", "c", "root", "probe", "below"))
        w, second = ([x.values.to_numpy() for x in t[k]] for k in ("w", "x"))
        side = None if t["i"][0].as_py() == t["j"][0].as_py() else block
        found = cross_links(names, w, second, root, probe, below == 0, side)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cut, cut[1:], strict=False):
                mine = tuple(key[:, s].tolist())
                if mine != now and held:
                    yield solve(held)
                    held = []
                now = mine
                held.append(batch.slice(s, e - s))
        if held:
            yield solve(held)

    found = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(lean(run), "a long, b long")
    return found.unionByName(listed).distinct()


def pairs_of_short(docs: DataFrame, short: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """(a, b): the classes ``short`` (c, d, n) with all classes of like size that share a shingle
    with them."""
    low, high = short.agg(F.min("n"), F.max("n")).first()
    near = classes.where((F.col("n") * 4 >= low * 3) & (F.col("n") * 3 <= high * 4))
    own = sets_of(docs, short, seed).select(F.col("c").alias("s"), F.explode("w").alias("e"))
    others = sets_of(docs, near, seed).select("c", F.explode("w").alias("e"))
    return others.join(own.hint("merge"), "e").where("c <> s").select(F.greatest("c", "s").alias("a"), F.least("c", "s").alias("b")).distinct()


@tidy
def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, least_segments: int = LEAST_SEGMENTS, block_shingles: int = BLOCK_SHINGLES, keep: list[str] | None = None) -> DataFrame:
    """One row for each document: id, n_shingles, component_id, class_id (a number of its
    component, also where ids are null or repeated), and the columns ``keep``."""
    spark, keep = docs.sparkSession, keep or []
    rows = docs.select(ordered_id(docs, id_col).alias("d"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    facts = ("n", "c2", "band", "most", "short", *(f"{x}{k}" for k in (0, 1) for x in ("held", "able", "need", "small")))
    while True:
        known = stored(profile(rows, seed, least_segments, keep), "jaccard-profiles")
        classes = known.where("n > 0").groupBy("c").agg(F.min("d").alias("d"), F.max("c2").alias("other"), F.min("c2").alias("c2"), *(F.first(x).alias(x) for x in facts if x != "c2"))
        classes = stored(classes, "jaccard-classes", small=True)
        total, short, clash = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("short"), F.lit(False)), F.coalesce(F.max(F.col("c2") != F.col("other")), F.lit(False))).first()
        if not clash:
            break
        seed += 2  # two sets of one name: all get others
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // BUCKET)
    entries = stored(allocate(repeated(index_rows(rows, min(buckets, 1 << 23), seed, least_segments)), classes), "jaccard-entries", small=True)
    keys = entries.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("probe").alias("probed")).where("probed AND c0 < c1").select("key")
    live = stored(entries.join(keys.hint("merge"), "key"), "jaccard-live", small=True)
    # Each key names a hub, the set that others have most of; its other sets are paired with it.
    hubs = live.groupBy("key").agg(F.max(F.struct("rank", "c")).alias("h")).select("key", F.col("h.c").alias("hub"))
    first = live.join(hubs.hint("merge"), "key").where("c <> hub").select(F.greatest("c", "hub").alias("a"), F.least("c", "hub").alias("b")).distinct()
    wanted = live.select("c").distinct()
    if short:
        more = stored(pairs_of_short(rows, classes.where("short"), classes, seed), "jaccard-short", small=True)
        first = first.unionByName(more).distinct()
        wanted = wanted.unionByName(more.select(F.col("a").alias("c"))).unionByName(more.select(F.col("b").alias("c"))).distinct()
    sets = stored(sets_of(rows, classes.select("c", "d").join(wanted.hint("merge"), "c"), seed), "jaccard-sets")
    links = stored(verify(first, sets), "jaccard-links")
    roots = components(links)
    more = stored(links_between(live, roots, sets, block_shingles), "jaccard-more")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = known.select("id", "n", "c", "d", *keep).join(roots.select(F.col("v").alias("c"), "root").hint("merge"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = classes.select("c", "d").join(roots.select(F.col("v").alias("c"), "root").hint("merge"), "c", "left").groupBy(F.coalesce("root", "c").alias("root")).agg(F.min("d").alias("least"))
    out = named.join(least.hint("merge"), "root", "left")
    found = F.when(F.col("n") == 0, F.col("d")).otherwise(F.col("least"))
    component = F.when(found < last_id(docs, id_col), found).cast(docs.schema[id_col].dataType)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("root").alias("class_id"), *keep)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


_T = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_T}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + 4], ' ') AS k
       FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM sh GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS x FROM sh a JOIN sh b ON a.k = b.k AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * x >= 75 * (na.n + nb.n - x)),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON n.rid = d.rid JOIN reach ON reach.a = d.rid JOIN d o ON o.rid = reach.b
GROUP BY d.rid, d.doc_id
"""
