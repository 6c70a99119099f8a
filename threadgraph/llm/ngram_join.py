"""N-gram Jaccard join: sets of word shingles, a global order by rarity, and prefix trees.

A document's set has its distinct shingles of ``WORDS`` words, lower-cased in A-Z. Two documents link when 100 times their
intersection is at least ``PERCENT`` times their union. Links, not pairs, are what is found: every pair of different sets that
links ends up in one component.

1. Each slice of documents hashes its shingles and deals them out by hash, sorted and packed. Where they meet, the number of
   documents of each shingle is counted, over all documents; those in two or more go back to their slice. Of a shingle that
   ``HOT`` documents of a slice share, only their number is dealt out and only the total comes back, so what a shingle puts into
   its bucket grows with the slices that have it, by some 100 bytes each at most, and not with the documents.
2. A document of which fewer than PERCENT of 100 shingles occur elsewhere can't link, and is done. The others keep their
   repeated shingles in the global order: rarest first, then by hash. Shingles of one document alone come before all others.
   Documents with equal sets become one.
3. Of two sets that link, the first few elements in that order, ``n - ceil(PERCENT / 100 * n) + 1`` of them, share one. Stars
   around the least document of each shared element, of which each task keeps a forest, and their connected components, give the
   groups that may link.
4. Within a group, the sets are stored in one prefix tree, whose nodes hold up to ``SEGMENT`` elements, and each set is looked
   up in it, a level at a time: the overlap counted along a path is shared by all sets below, and a subtree is left when the
   sizes, or the elements that remain on both sides, can't reach the overlap that is needed, when its sets were looked up
   themselves, or when all of them are in the component already. Groups of more than ``BLOCK`` sets or ``BLOCK_ITEMS`` elements
   are worked off by pairs of blocks. Their links give the components.

Shingles are counted by 64 bits of hash, and told apart by 48 of them or more (256 buckets at least, and 40 bits within). Buckets are as many as the bytes
of all texts ask for, and what a bucket holds is counted in ranges of bounded size. Every step that others build on is written to
the shared folder. Rows are numbered by partition and place, so any number of them may share a doc_id.

Defined results: null and empty texts, and texts of white space, have empty sets and link with nothing; with fewer than WORDS
words the whole sequence is the only shingle; repeated rows and equal sets share a component; a component's id is the least
doc_id of its rows that have one, and null if none has; rows that share a doc_id, or have none, are told apart; ``one_of_each``
takes rows of equal doc_id and text (by 64 bits of hash) for one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import gc

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, forest
from .common import fresh_names, join_hot, materialise, table, text_or_empty
from .hashing import give_back, mixed, powers, span_hashes
from .suffix_dedup import release

WORDS, PERCENT = 5, 75
PART_BYTES = 1_000_000  # bytes that are hashed at once
SLICE_BYTES = 4_000_000  # bytes of the documents whose shingles are sorted and packed together
LOW_BITS = 40  # of a hash within its bucket
LEAST_BUCKETS, BUCKET_BYTES = 256, 256_000_000  # a bucket for so many bytes of text
HOT = 16  # documents of a slice that share a shingle, from which on the slice keeps their places and deals out their number only
RANGE_ITEMS = 4_000_000  # shingles of a bucket that are counted together
BLOCK, BLOCK_ITEMS = 500, 250_000  # sets, and elements of sets, that one task holds in a tree
SEGMENT = 32  # elements of a node of the tree
ROW = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("named", "?")])  # what is known of a document but its text


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return lower, space


_LOWER, _SPACE = _byte_classes()


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the text) of every shingle of every text, repeats included."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    first, ends = edge[::2], edge[1::2]  # a text ends with white space, so words do end
    owner = np.searchsorted(np.cumsum(sizes), first, side="right")
    words = span_hashes(data, first, ends)
    count = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(count) - count
    rank = np.arange(len(words)) - begin[owner]
    keys = powers(0xD6E8FEB86659FD93, WORDS + 1)[1:]
    # A shingle starts at each word that has WORDS - 1 after it; a short text has one, of all its words.
    starts = np.flatnonzero(rank <= np.maximum(count[owner] - WORDS, 0))
    total = np.zeros(len(starts), np.uint64)
    length = np.minimum(count[owner[starts]], WORDS)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        total += np.where(k < length, padded[starts + k] * keys[k], np.uint64(0))
    return mixed(total + length.astype(np.uint64)), owner[starts]


def needed(a, b):
    """Least intersection with which sets of sizes a and b link: 100 i >= PERCENT (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_size(n):
    """How many first elements of a set of n share one with any set that it links with."""
    return n + (-PERCENT * n) // 100 + 1


def _rows(batch):
    """Rows of a batch, one at a time: their binaries needn't all be there as Python objects at once."""
    for k in range(batch.num_rows):
        yield tuple(column[k].as_py() for column in batch.columns)


# --- 1: shingles by bucket, and back ------------------------------------------------------------------------------------

PACKED = "bucket int, slice long, docs binary, sizes binary, owner binary, low binary, high binary"


def _pack(slice_id: int, docs: np.ndarray, hashes: np.ndarray, owner: np.ndarray, buckets: int):
    """A row of the documents and their set sizes, with the shingles that many of them share and whose these are; for each bucket
    a row of sorted hashes with the documents they are of, and one of the shared shingles with the number of their documents."""
    # By bucket, and by the bits that tell shingles apart within it: high bytes are then in order, and it is enough to count them.
    bits = np.uint64((1 << LOW_BITS) - 1)
    whole = hashes
    bucket = ((hashes >> np.uint64(LOW_BITS)) % np.uint64(buckets)).astype(np.uint64)
    hashes = bucket << np.uint64(LOW_BITS) | hashes & bits
    order = np.argsort(hashes, kind="stable")
    hashes, owner, whole = hashes[order], owner[order], whole[order]
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    sizes = np.bincount(owner[~again], minlength=len(docs))
    # Sizes count all 64 bits: a document's shingles that only the bits left out tell apart are counted one by one.
    mixed_up = again.copy()
    mixed_up[1:] &= whole[1:] != whole[:-1]
    if mixed_up.any():
        clashing = np.isin(hashes, hashes[mixed_up])
        pairs = np.unique(np.stack((owner[clashing].astype(np.uint64), whole[clashing])), axis=1)
        sizes += np.bincount(pairs[0].astype(np.int64), minlength=len(docs)) - np.bincount(owner[clashing & ~again], minlength=len(docs))
    hashes, owner = hashes[~again], owner[~again]
    head = {"bucket": slice_id % buckets, "slice": slice_id, "docs": docs.tobytes(), "sizes": sizes.astype("<i4").tobytes()}
    starts = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + np.uint64(1)))
    times = np.diff(starts, append=len(hashes))
    shared = times >= HOT
    hot, hot_times = hashes[starts[shared]], times[shared].astype("<u4")
    own = ~np.repeat(shared, times)
    if len(hot):
        head |= {"owner": owner[~own].astype("<u4").tobytes(), "low": hot.astype("<u8").tobytes(), "high": hot_times.tobytes()}
    hashes, owner = hashes[own], owner[own]
    yield head
    for k, a, b in _by_bucket(hot):
        yield {"bucket": k, "slice": slice_id, "low": (hot[a:b] & bits).astype("<u8").tobytes(), "sizes": hot_times[a:b].tobytes()}
    low = (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
    high = (hashes >> np.uint64(32) & np.uint64(0xFF)).astype(np.int64)
    kind = "<u2" if len(docs) <= 1 << 16 else "<u4"
    for k, a, b in _by_bucket(hashes):
        yield {"bucket": k, "slice": slice_id, "owner": owner[a:b].astype(kind).tobytes(), "low": low[a:b].tobytes(), "high": np.bincount(high[a:b], minlength=256).astype("<u4").tobytes()}


def _by_bucket(hashes: np.ndarray):
    """(bucket, first, last) of sorted hashes."""
    bucket = (hashes >> np.uint64(LOW_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False):
        yield int(bucket[a]), a, b


def _scanner(buckets: int):
    def scan(batches):
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        names = [f.split()[0] for f in PACKED.split(", ")]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        ordinal = 0

        def packed(docs, texts):
            nonlocal ordinal
            hashes, owners, start, held = [], [], 0, 0
            for k, text in enumerate(texts):
                held += len(text)
                if held >= PART_BYTES or k == len(texts) - 1:
                    h, o = shingles(texts[start : k + 1])
                    hashes.append(h)
                    owners.append((o + start).astype(np.int32))
                    start, held = k + 1, 0
            # A slice goes by the number of its first row.
            rows = list(_pack(part << 32 | ordinal, np.array(docs, ROW), np.concatenate(hashes), np.concatenate(owners), buckets))
            ordinal += len(docs)
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            docs, texts, held = [], [], 0
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs.append((doc or 0, mark, doc is not None))
                texts.append(text.as_buffer().to_pybytes())
                held += len(texts[-1])
                if held >= SLICE_BYTES:
                    yield packed(docs, texts)
                    docs, texts, held = [], [], 0
            if docs:
                yield packed(docs, texts)
        give_back()

    return scan


BACK = "slice long, bucket int, docs binary, sizes binary, owner binary, item binary, spread binary"


def _width(owner: bytes, low: bytes):
    return np.frombuffer(owner, "<u2" if 2 * len(owner) == len(low) else "<u4")


def _count(batches):
    """Rows of a bucket, together: what occurs in two documents or more goes back to its slice."""
    import pyarrow as pa

    names = [f.split()[0] for f in BACK.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def work(bucket, rows):
        if not rows:
            return
        # Hashes of a row are in order, so ranges of them by their high byte are slices; a range is at least one high byte's.
        hot = [r for r in rows if r[4] is None]
        rows = [r for r in rows if r[4] is not None]
        highs = np.array([np.frombuffer(r[6], "<u4") for r in rows], np.int64).reshape(-1, 256)
        hot_highs = np.array([np.bincount((np.frombuffer(r[5], "<u8") >> np.uint64(32)).astype(np.int64), minlength=256) for r in hot], np.int64).reshape(-1, 256)
        ends, hot_ends = np.cumsum(highs, axis=1), np.cumsum(hot_highs, axis=1)
        total = np.cumsum(highs.sum(axis=0) + hot_highs.sum(axis=0))
        low = 0
        while low < 256:
            before = int(total[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(total, before + RANGE_ITEMS, side="right")))
            if total[high - 1] > before:
                cuts, hot_cuts = ([slice(int(e[low - 1]) if low else 0, int(e[high - 1])) for e in of] for of in (ends, hot_ends))
                yield from count(bucket, rows, highs[:, low:high], low, cuts, hot, hot_cuts)
            low = high

    def count(bucket, rows, highs, low, cuts, hot, hot_cuts):
        owners = [_width(r[4], r[5])[own] for r, own in zip(rows, cuts, strict=True)]
        bytes_ = np.arange(low, low + highs.shape[1], dtype=np.uint64) << np.uint64(32)
        parts = [np.frombuffer(r[5], "<u4")[own].astype(np.uint64) | np.repeat(bytes_, n) for r, n, own in zip(rows, highs, cuts, strict=True)]
        which = np.repeat(np.arange(len(rows)), [len(o) for o in owners])
        items = np.concatenate([*parts, *[np.frombuffer(r[5], "<u8")[own] for r, own in zip(hot, hot_cuts, strict=True)]])
        times = np.concatenate([np.ones(len(which)), *[np.frombuffer(r[3], "<u4")[own] for r, own in zip(hot, hot_cuts, strict=True)]])
        order = np.argsort(items, kind="stable")
        head = np.ones(len(items), bool)
        head[1:] = items[order[1:]] != items[order[:-1]]
        group = np.cumsum(head) - 1
        spread = np.empty(len(items), np.int64)
        spread[order] = np.bincount(group, weights=times[order])[group]
        # Counts only serve the order of elements, in which beyond 16 bits all are equally common.
        capped = np.minimum(spread, 0xFFFF)
        found, at = [], len(which)
        for r, own in zip(hot, hot_cuts, strict=True):
            n = own.stop - own.start
            if n:
                found.append({"slice": r[1], "bucket": bucket, "item": items[at : at + n].astype("<u8").tobytes(), "spread": capped[at : at + n].astype("<u2").tobytes()})
            at += n
        again = np.flatnonzero(spread[: len(which)] > 1)
        if len(again):
            owner, which, items, spread = np.concatenate(owners)[again], which[again], items[again], capped[again]
            bounds = np.searchsorted(which, np.arange(len(rows) + 1))
            for k, r in enumerate(rows):
                own = slice(bounds[k], bounds[k + 1])
                if bounds[k] < bounds[k + 1]:
                    packed = items[own]
                    found.append({"slice": r[1], "bucket": bucket, "owner": owner[own].astype("<u4").tobytes(), "item": packed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), "spread": spread[own].astype("<u2").tobytes()})
        if found:
            yield out(found)

    key, rows = None, []
    for batch in batches:
        for r in _rows(batch):
            if r[2] is not None:
                yield out([{"slice": r[1], "docs": r[2], "sizes": r[3], "owner": r[4], "item": r[5], "spread": r[6]}])
                continue
            if r[0] != key:
                yield from work(key, rows)
                key, rows = r[0], []
            rows.append(r)
    yield from work(key, rows)
    give_back()


SETS = "id long, doc_id long, mark long, n int, items binary, spread binary, same string"


def _assemble(batches):
    """Rows of a slice, together: every document with its set size; those that may link with their repeated shingles in order."""
    import hashlib

    import pyarrow as pa

    def work(rows):
        if not rows:
            return
        head = next(r for r in rows if r[2] is not None)
        docs, sizes = np.frombuffer(head[2], ROW), np.frombuffer(head[3], "<i4")
        parts = [r for r in rows if r[2] is None]
        items_of, spread_of, same = [None] * len(docs), [None] * len(docs), [None] * len(docs)
        if parts:
            hot = [r for r in parts if r[4] is None]
            parts = [r for r in parts if r[4] is not None]
            owners, items, spread = [], [], []
            if hot:  # the totals of shared shingles are looked up for those of the slice
                keys = np.concatenate([np.frombuffer(r[5], "<u8") | np.uint64(r[1]) << np.uint64(LOW_BITS) for r in hot])
                totals, order = np.concatenate([np.frombuffer(r[6], "<u2") for r in hot]), np.argsort(keys)
                own, times = np.frombuffer(head[5], "<u8"), np.frombuffer(head[6], "<u4")
                owners.append(np.frombuffer(head[4], "<u4"))
                items.append(np.repeat(own, times))
                spread.append(np.repeat(totals[order[np.searchsorted(keys, own, sorter=order)]], times))
            owner = np.concatenate(owners + [np.frombuffer(r[4], "<u4") for r in parts])
            held = np.bincount(owner, minlength=len(docs))
            stays = (100 * held >= PERCENT * sizes.astype(np.int64)) & (sizes > 0)
            for r in parts:
                raw = np.frombuffer(r[5], np.uint8).reshape(-1, 5)
                wide = np.zeros((len(raw), 8), np.uint8)
                wide[:, :5] = raw
                items.append(wide.view("<u8")[:, 0] | np.uint64(r[1]) << np.uint64(LOW_BITS))
                spread.append(np.frombuffer(r[6], "<u2"))
            items, spread = np.concatenate(items), np.concatenate(spread)
            use = stays[owner]
            owner, items, spread = owner[use], items[use], spread[use]
            order = np.lexsort((items, spread, owner))
            owner, items, spread = owner[order], items[order], spread[order]
            cuts = np.searchsorted(owner, np.arange(len(docs) + 1))
            for k in np.flatnonzero(stays):
                own = slice(cuts[k], cuts[k + 1])
                items_of[k], spread_of[k] = items[own].tobytes(), spread[own].tobytes()
                if held[k] == sizes[k]:
                    same[k] = hashlib.md5(items_of[k]).hexdigest()
        columns = {"id": head[0] + np.arange(len(docs)), "doc_id": pa.array(docs["doc"], mask=~docs["named"]), "mark": docs["mark"].copy()}
        columns |= {"n": sizes, "items": pa.array(items_of, pa.binary()), "spread": pa.array(spread_of, pa.binary()), "same": pa.array(same, pa.string())}
        yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    key, rows = None, []
    for batch in batches:
        for r in _rows(batch):
            if r[0] != key:
                yield from work(rows)
                key, rows = r[0], []
            rows.append(r)
    yield from work(rows)
    give_back()


# --- 4: the prefix tree -------------------------------------------------------------------------------------------------


class Tree:
    """Prefix tree of sets (ordered elements below ``universe``), as arrays of nodes, level by level; a node's children adjoin.

    A node stands for the sets ``first`` to ``last`` (in the tree's order) and for up to SEGMENT elements that they share.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, universe: int):
        own = np.array(sorted(range(len(sets)), key=lambda k: sets[k].astype(">i4").tobytes()), np.int64)
        items = [sets[k] for k in own]
        held = np.array([len(i) for i in items])
        shared = [0, *(_common(a, b) for a, b in zip(items, items[1:], strict=False))]  # with the set before
        nodes, path = [], []  # (first, last, depth of start, of end); elements
        children = [(0, 0)]
        cells = [(0, len(items), 0)]
        at = 0
        while at < len(cells):
            first, last, depth = cells[at]
            at += 1
            begin = len(nodes)
            while first < last and held[first] == depth:  # sets that end here
                first += 1
            while first < last:
                to = first + 1
                while to < last and shared[to] > depth:
                    to += 1
                end = min([depth + SEGMENT, int(held[first]), *shared[first + 1 : to]])
                nodes.append((first, to, depth, end))
                path.append(items[first][depth:end])
                cells.append((first, to, end))
                first = to
            children.append((begin, len(nodes)))
        self.sizes, self.universe = sizes[own], universe
        self.own, self.place = own, np.argsort(own)
        self.top = children[1]
        self.child = np.array(children[2:], np.int64).reshape(-1, 2)
        self.first, self.last, start, self.end = np.array(nodes, np.int64).reshape(-1, 4).T
        self.path = np.full((len(nodes), SEGMENT), universe, np.int32)
        for k, part in enumerate(path):
            self.path[k, : len(part)] = part
        self.final = self.path[np.arange(len(nodes)), self.end - start - 1] if nodes else np.zeros(0, np.int32)
        self.rest = np.array([max(held[a:b]) for a, b in zip(self.first, self.last, strict=True)], np.int64) - start  # elements from the node on, at most
        self.least = np.array([self.sizes[a:b].min() for a, b in zip(self.first, self.last, strict=True)], np.int64)
        self.most = np.array([self.sizes[a:b].max() for a, b in zip(self.first, self.last, strict=True)], np.int64)
        self.ends = np.array([np.searchsorted(held[a:b] > d, True) for a, b, d in zip(self.first, self.last, self.end, strict=True)], np.int64)
        self.member = np.zeros(universe + 1, bool)

    def linked(self, items: np.ndarray, n: int, labels: np.ndarray, label: int, done: int) -> np.ndarray:
        """Places (in the tree's order, from ``done`` on) of the sets that a set links with; not all of those with its label."""
        self.member[items] = True
        change = np.cumsum(np.append(False, labels[1:] != labels[:-1]))  # equal at both ends of a stretch of one label
        least_size = -(-PERCENT * n // 100)
        nodes = np.arange(*self.top)
        overlap = np.zeros(len(nodes), np.int64)
        passed = np.zeros(len(nodes), np.int64)
        found = []
        while len(nodes):
            first, last, least = self.first[nodes], self.last[nodes], self.least[nodes]
            use = (last > done) & (100 * self.most[nodes] >= PERCENT * n) & (100 * n >= PERCENT * least)
            use &= overlap + np.minimum(self.rest[nodes], len(items) - passed) >= needed(np.maximum(least, least_size), n)
            use &= (labels[first] != label) | (change[first] != change[last - 1])
            nodes, overlap = nodes[use], overlap[use]
            if not len(nodes):
                break
            overlap = overlap + np.count_nonzero(self.member[self.path[nodes]], axis=1)
            passed = np.searchsorted(items, self.final[nodes], side="right")
            ending = np.flatnonzero(self.ends[nodes])
            if len(ending):
                count = self.ends[nodes[ending]]
                sets = np.repeat(self.first[nodes[ending]], count) + _steps(count)
                links = np.repeat(overlap[ending], count) >= needed(self.sizes[sets], n)
                found.append(sets[links])
            begin, count = self.child[nodes, 0], self.child[nodes, 1] - self.child[nodes, 0]
            nodes, overlap, passed = np.repeat(begin, count) + _steps(count), np.repeat(overlap, count), np.repeat(passed, count)
        self.member[items] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of leading elements that are equal."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _steps(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def link_group(sets: list[np.ndarray], sizes: list[int], split: int | None = None) -> np.ndarray:
    """Components of sets (ordered elements that other sets have too; sizes count the others as well), by their least place.

    With ``split``, only links between the first ``split`` sets and the rest are asked for.
    """
    sizes = np.array(sizes, np.int64)
    stored = len(sets) if split is None else split
    tree = Tree(sets[:stored], sizes[:stored], 1 + max((int(s[-1]) for s in sets if len(s)), default=0))
    # Labels of the stored sets, in the tree's order, and of the others.
    labels = np.arange(len(sets))
    for k in tree.own if split is None else range(split, len(sets)):
        place = int(tree.place[k]) if split is None else k
        found = tree.linked(sets[k], int(sizes[k]), labels[:stored], labels[place], place + 1 if split is None else 0)
        if len(found):
            labels[np.isin(labels, labels[found])] = labels[place]
    own = np.concatenate([tree.own, np.arange(stored, len(sets))])
    least = np.full(len(sets), len(sets))
    np.minimum.at(least, labels, own)
    out = np.empty(len(sets), np.int64)
    out[own] = least[labels]
    return out


def _link(batches):
    """Rows of a task (group and pair of blocks), together: a star of links for each component found."""
    import pyarrow as pa

    def work(rows):
        if len(rows) < 2:
            return
        rows.sort(key=lambda r: (r[1], r[2]))
        items = [np.frombuffer(r[4], "<u8") for r in rows]
        spread = np.concatenate([np.frombuffer(r[5], "<u2") for r in rows])
        whole = np.concatenate(items)
        order = np.lexsort((whole, spread))
        head = np.ones(len(whole), bool)
        head[1:] = whole[order[1:]] != whole[order[:-1]]
        rank = np.empty(len(whole), np.int32)
        rank[order] = np.cumsum(head) - 1
        cuts = np.cumsum([0, *map(len, items)])
        sets = [rank[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        sides = [r[1] for r in rows]
        links = link_group(sets, [r[3] for r in rows], sides.index(1) if 1 in sides else None)
        pairs = [(rows[k][2], rows[least][2]) for k, least in enumerate(links.tolist()) if least != k]
        if pairs:
            yield pa.RecordBatch.from_pydict({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    key, rows = None, []
    for batch in batches:
        for r in _rows(batch):
            if r[0] != key:
                yield from work(rows)
                key, rows = r[0], []
            rows.append(r)
    yield from work(rows)
    give_back()


def _prefixes(batches):
    """(item, doc, hub): of the documents of a batch that share an item, the least goes on as that item's; the others get it as
    their hub, and go along with their hub's place."""
    for batch in batches:
        docs, found = [], []
        for doc, n, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = np.frombuffer(items.as_buffer(), "<u8")
            own = own[: max(0, prefix_size(n) - (n - len(own)))]
            docs.append(np.full(len(own), doc, np.int64))
            found.append(own.view("<i8"))
        if docs:
            yield _stars(np.concatenate(found), np.concatenate(docs), None)[0]


def _stars(item, doc, hub):
    """The batch to emit of rows by item and document, and the last item with its hub; ``hub``: those of the rows before."""
    import pyarrow as pa

    order = np.lexsort((doc, item))
    item, doc = item[order], doc[order]
    head = np.ones(len(item), bool)
    head[1:] = item[1:] != item[:-1]
    least = doc[np.maximum.accumulate(np.where(head, np.arange(len(item)), 0))]
    if hub is not None and len(item) and item[0] == hub[0]:
        first = item == hub[0]
        least[first], head[0] = hub[1], doc[0] == hub[1]
    pairs = np.unique(np.column_stack([doc, least])[~head & (doc != least)], axis=0)
    items = np.concatenate([item[head], mixed(pairs[:, 0].astype(np.uint64)).view(np.int64)])  # pairs are dealt out by their document
    hubs = pa.array(np.concatenate([np.zeros(int(head.sum()), np.int64), pairs[:, 1]]), pa.int64(), mask=np.arange(len(items)) < int(head.sum()))
    out = pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(np.concatenate([doc[head], pairs[:, 0]]), pa.int64()), hubs], names=["item", "doc", "hub"])
    return out, (int(item[-1]), int(least[-1])) if len(item) else hub


def _meet(batches):
    """Rows by item, then document: (u, v) of each document and the least of all that share an item with it, less those that earlier
    ones of the task have tied together. So a task gives fewer rows than it has documents, however many items they share."""

    def stars():
        hub = None
        for batch in batches:
            done = np.asarray(batch.column(2).is_valid())
            item, doc = (batch.column(k).to_numpy()[~done] for k in range(2))
            out, hub = _stars(item, doc, hub)
            for part in (out.filter(out.column(2).is_valid()), batch.filter(batch.column(2).is_valid())):
                yield part.select(["doc", "hub"]).rename_columns(["a", "b"])

    for kept in forest(stars()):
        yield kept.rename_columns(["u", "v"])


# --- the join -----------------------------------------------------------------------------------------------------------


def sets_of(docs: DataFrame) -> DataFrame:
    """id, doc_id, mark (hash of the text), n, items, spread, same: a row per row, numbered."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("mark"), text_or_empty().alias("text"))
    held = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))
    packed = plain.mapInArrow(_scanner(buckets), PACKED)
    counted = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, BACK)
    return counted.repartition("slice").sortWithinPartitions("slice").mapInArrow(_assemble, SETS)


def components_of(sets: DataFrame) -> DataFrame:
    """id, rep, component of the rows that may link with others: ids of the least row of equal sets and of a linked one."""
    live = sets.where("items is not null")
    rows = live.count()
    least = live.where("same is not null").groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k"))
    alone = live.where("same is null").select("id", F.col("id").alias("rep"))
    member = join_hot(live.where("same is not null").select("id", "same"), least, "same", "k", rows).select("id", "rep").union(alone)
    member = materialise(member, "ngram-members")
    copies = member.where("id <> rep")

    posted = live.select("id", "n", "items").mapInArrow(_prefixes, "item long, doc long, hub long")
    stars = posted.repartition("item").sortWithinPartitions("item", "doc").mapInArrow(_meet, "u long, v long").distinct()
    # A copy shares its items with its representative, which stands for it at both ends: what ties others together may be a copy's.
    for end in "uv":
        stars = stars.join(copies.select(F.col("id").alias(end), F.col("rep").alias(f"rep_{end}")), end, "left")
    stars = stars.select(F.coalesce("rep_u", "u").alias("u"), F.coalesce("rep_v", "v").alias("v"))
    groups = materialise(connected_components(stars), "ngram-groups")

    weighed = groups.join(live.select(F.col("id").alias("node"), (F.octet_length("items") / 8).alias("w")), "node")
    sizes = groups_of(weighed)
    sized = join_hot(groups, sizes, "component", "k", rows).select(F.col("node").alias("id"), "component", "blocks")
    # Block i meets itself, the later blocks (side 0) and the earlier ones (side 1).
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j"), (j < F.col("block")).cast("int").alias("side")))
    dealt = sized.withColumn("block", block).select("id", "component", F.explode(tasks).alias("t"))
    dealt = dealt.select("id", F.concat_ws("/", "component", "t.i", "t.j").alias("task"), F.col("t.side").alias("side"))
    shipped = dealt.hint("merge").join(live.select("id", "n", "items", "spread"), "id").select("task", "side", "id", "n", "items", "spread")
    links = materialise(shipped.repartition("task").sortWithinPartitions("task").mapInArrow(_link, "u long, v long"), "ngram-links")

    joined = connected_components(links)
    copied = member.groupBy("rep").agg(F.count(F.lit(1)).alias("k"))
    labels = copied.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "k", F.coalesce("component", "rep").alias("component"))
    return join_hot(member, labels, "rep", "k", rows).select("id", "rep", "component")


def groups_of(weighed: DataFrame) -> DataFrame:
    """component, k (sets), blocks that it is dealt into."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("w") / BLOCK_ITEMS)).cast("int")
    return weighed.groupBy("component").agg(F.count(F.lit(1)).alias("k"), blocks.alias("blocks"))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n, best (unnamed, doc_id, mark: the least row of the component): a row per row of the input."""
    sets = materialise(sets_of(docs), "ngram-documents")
    gc.collect()
    release(docs.sparkSession)
    found = materialise(components_of(sets), "ngram-components").select("id", "component")
    own = sets.select("id", "doc_id", "mark", "n", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark").alias("own"))
    linked = own.join(found, "id")
    least = linked.groupBy("component").agg(F.min("own").alias("best"), F.count(F.lit(1)).alias("k"))
    linked = join_hot(linked, least, "component", "k", found.count()).select("doc_id", "mark", "n", "best")
    alone = own.join(found, "id", "left_anti").select("doc_id", "mark", "n", F.col("own").alias("best"))
    return linked.union(alone)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of the input."""
    return labelled(docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("best.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the row of least doc_id (and, among such or without one, of least text hash), with all its columns, once."""
    names = fresh_names(docs.columns, "doc", "mark", "kept_doc", "kept_mark")
    doc, mark, kept_doc, kept_mark = (names[n] for n in ("doc", "mark", "kept_doc", "kept_mark"))
    of = lambda column: F.struct(column.isNull().alias("none"), F.coalesce(column, F.lit(0)).alias("id"))
    found = labelled(docs).where("doc_id <=> best.doc_id and mark = best.mark").select(of(F.col("doc_id")).alias(kept_doc), F.col("mark").alias(kept_mark))
    found = materialise(found, "ngram-kept")
    release(docs.sparkSession)  # what led to the ids isn't needed beside the shuffle of the texts
    keyed = docs.withColumns({doc: of(F.col("doc_id").cast("long")), mark: F.xxhash64(text_or_empty())})
    kept = keyed.join(found, (F.col(doc) == F.col(kept_doc)) & (F.col(mark) == F.col(kept_mark)), "left_semi")
    return kept.dropDuplicates([doc, mark]).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE [array_to_string(l[i : i + 4], ' ') FOR i IN range(1, len(l) - 3)] END)) AS g
  FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, t.b FROM reach r JOIN both_ t ON t.a = r.b)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
