"""Removal of repeated byte strings with suffix arrays built by induced sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (smaller doc_id, or the same document at an earlier
place) goes. Matches never cross documents and are judged on the input.

1. Winnowing: a window of LENGTH bytes is assigned to its anchor, the first k-gram of least hash in it. Equal windows have
   equal anchors at equal offsets, so a window whose anchor is unique in the corpus repeats nothing. A run of windows with the
   same anchor is one row: anchor hash, hash of the run's bytes, document, place. Of equal runs within a task's slice only the
   earliest goes on; the others are repeats already. A hot passage thus sends a row for each slice, not for each document.
2. Rows meet by anchor, sorted. Runs equal to an earlier one are repeats. Where an anchor has runs of different bytes (the
   borders of a shared passage), the earliest of each is sent for.
3. The bytes of those runs are gathered into shards by anchor. Each shard's suffix array is built by induced sorting and the
   permuted common prefixes of its windows tell which are equal; all but the earliest are repeats. A group of runs that is too
   large for a shard is written out window by window instead and settled by a window function, which spills.
4. The repeats of a document, merged, are cut out of its bytes.

Runs are compared by a 64-bit hash of their bytes in addition to the anchor's 64 bits and both offsets. Steps are written to
the shared folder, so lost executors only cost the tasks at hand.

Defined results: null and empty texts have no bytes; documents are told apart by doc_id and a 64-bit hash of their text, in whose
order they go, null doc_ids first; so rows that share a doc_id, or have none, are documents of their own if their texts differ,
while wholly equal rows are one document (they repeat nothing by that, and get equal results); documents of any length are worked
off in overlapping stretches; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty
from .hashing import BASE, BYTES, give_back, mixed, span_hashes

LENGTH = 100
GRAM = 37  # so that a window has 64 k-grams
SPAN = LENGTH - GRAM + 1
SLICE_BYTES = 1_000_000
SHARD_BYTES = 2_000_000  # bytes of runs that one suffix array covers
GROUP_BYTES = 6_000_000  # bytes of one anchor's runs beyond which its windows are settled one by one
FIRST_DOC = -(1 << 63)  # stands for a null doc_id
SALTS = 64  # parts that equal windows are dealt into


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling: 1, 2, 4, ... bytes."""
    values = BYTES[data]
    levels = {1: values}
    size = 1
    while 2 * size <= GRAM:
        one = levels[size]
        levels[2 * size] = one[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + one[size:]
        size *= 2
    total, done = levels[size], size
    while done < GRAM:
        size = max(s for s in levels if s <= GRAM - done)
        n = len(data) - done - size + 1
        total = total[:n] * np.uint64(pow(BASE, size, 1 << 64)) + levels[size][done : done + n]
        done += size
    return mixed(total)


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """Place of the least hash among the SPAN from each place on; the first of equal ones."""
    place = np.arange(len(hashes), dtype=np.int32)
    size = 1
    while 2 * size <= SPAN:
        later = hashes[size:] < hashes[:-size]
        hashes = np.where(later, hashes[size:], hashes[:-size])
        place = np.where(later, place[size:], place[:-size])
        size *= 2
    rest = SPAN - size
    if rest:
        later = hashes[rest:] < hashes[:-rest]
        place = np.where(later, place[rest:], place[:-rest])
    return place


def runs(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor, in stretches of the given sizes that ``data`` consists of.

    Returns stretch, first window (within the stretch), number of windows, offset of the anchor, hash of the anchor, hash of
    the run's bytes.
    """
    starts = np.cumsum(sizes) - sizes
    fits = np.maximum(sizes - LENGTH + 1, 0)
    total = int(fits.sum())
    if not total:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    stretch = np.repeat(np.arange(len(sizes)), fits)
    window = np.arange(total) - np.repeat(np.cumsum(fits) - fits, fits) + starts[stretch]
    hashes = _gram_hashes(data)
    anchor = _anchors(hashes)[window]
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, total))
    first, owner = window[head], stretch[head]
    content = span_hashes(data, first, first + count - 1 + LENGTH)
    return owner, first - starts[owner], count, anchor[head] - first, hashes[anchor[head]].view(np.int64), content.view(np.int64)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of each document; touching ones become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    change = np.ones(len(doc), bool)
    change[1:] = doc[1:] != doc[:-1]
    # The largest end so far within the document: shift documents apart, so that one running maximum does.
    group = np.cumsum(change) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    new = change.copy()
    new[1:] |= start[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return doc[head], start[head], reach[np.append(head[1:], len(doc)) - 1]


# hi: end of an interval that is a repeat; null for a run, of which ``form`` has the anchor's offset and the number of windows
ROWS = "h long, c long, form int, doc long, tag long, lo int, hi int"
KEYS = ["h", "c", "form", "doc", "tag", "lo"]
KINDS = {"long": "int64", "int": "int32", "binary": "binary", "string": "string"}


def _batch(schema: str, *columns):
    """A batch by a schema in SQL; a column that is None is null."""
    import pyarrow as pa

    fields = [f.split() for f in schema.split(", ")]
    kinds = [getattr(pa, KINDS[k])() for _, k in fields]
    size = len(columns[0])
    arrays = [pa.nulls(size, k) if c is None else c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _again(kind: list[np.ndarray], own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order: which are the first of their kind, and which differ from that first one in the ``own`` columns."""
    n = len(kind[0])
    head = np.ones(n, bool)
    head[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in kind])
    lead = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    return head, np.logical_or.reduce([x != x[lead] for x in own])


def _scan(batches):
    """Runs of a slice's documents (the earliest of equal ones), and the intervals of the others."""

    def work(parts):
        docs, tags, offsets = (np.array([p[k] for p in parts], np.int64) for k in range(3))
        owner, lo, n, at, h, c = runs(np.frombuffer(b"".join(p[3] for p in parts), np.uint8), np.array([len(p[3]) for p in parts], np.int64))
        lo, doc, tag = lo + offsets[owner], docs[owner], tags[owner]
        form = at * (SPAN + 1) + n
        order = np.lexsort((lo, tag, doc, form, c, h))
        h, c, form, doc, tag, lo, n, owner = (x[order] for x in (h, c, form, doc, tag, lo, n, owner))
        if not len(h):
            return
        head, again = _again([h, c, form], [doc, tag, lo])
        yield _batch(ROWS, *(x[head] for x in (h, c, form, doc, tag, lo)), None)
        who, s, e = merged(owner[again], lo[again], lo[again] + n[again] - 1 + LENGTH)
        if len(who):
            d, t = docs[who], tags[who]
            spread = mixed(t.view(np.uint64) * np.uint64(BASE) + s.view(np.uint64)).view(np.int64)  # deals intervals out evenly
            zero = np.zeros(len(d), np.int64)
            yield _batch(ROWS, spread, zero, zero, d, t, s, e)

    for batch in batches:
        parts, held = [], 0
        for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = text.as_buffer().to_pybytes()
            for at in range(0, max(len(raw) - LENGTH + 1, 0), SLICE_BYTES):
                part = raw[at : at + SLICE_BYTES + LENGTH - 1]
                if held + len(part) > SLICE_BYTES and parts:
                    yield from work(parts)
                    parts, held = [], 0
                parts.append((doc, tag, at, part))
                held += len(part)
        if parts:
            yield from work(parts)
    give_back()


FOUND = "kind int, h long, doc long, tag long, lo int, hi int"  # kind 0: bytes lo to hi are repeats; 1: bytes to send for


def _meet(batches):
    """Rows by anchor, sorted: repeats of earlier runs, and the runs to send for where an anchor has different ones."""
    before = None  # the last first-of-its-kind row: h, c, form, doc, tag, lo, and whether it is sent for

    def out(kind, *columns):
        return _batch(FOUND, np.full(len(columns[0]), kind), *columns)

    for batch in batches:
        end = batch.column(6)
        ready = np.asarray(end.is_valid())
        columns = [batch.column(k).to_numpy().astype(np.int64) for k in range(6)]
        if ready.any():
            yield out(0, *(columns[k][ready] for k in (0, 3, 4, 5)), end.drop_null().to_numpy())
        h, c, form, doc, tag, lo = (x[~ready] for x in columns)
        if before is not None:
            h, c, form, doc, tag, lo = (np.concatenate([[v], x]) for v, x in zip(before[:6], (h, c, form, doc, tag, lo), strict=True))
        if not len(h):
            continue
        hi = lo + form % (SPAN + 1) - 1 + LENGTH
        head, again = _again([h, c, form], [doc, tag, lo])
        if again.any():
            yield out(0, *(x[again] for x in (h, doc, tag, lo, hi)))
        first = np.flatnonzero(head)
        wanted = np.zeros(len(first), bool)
        shared = h[first[1:]] == h[first[:-1]]
        wanted[1:] |= shared
        wanted[:-1] |= shared
        done = wanted.copy()
        if before is not None and before[6]:
            done[0] = False
        pick = first[done]
        if len(pick):
            yield out(1, *(x[pick] for x in (h, doc, tag, lo, hi)))
        last = first[-1]
        sent = bool(wanted[-1]) or (len(first) == 1 and before is not None and before[6])
        before = (*(int(x[last]) for x in (h, c, form, doc, tag, lo)), sent)


SETTLED = "doc long, tag long, lo int, hi int, piece binary"  # piece: a window that is still to be settled


def equal_windows(pieces: list[bytes], docs: np.ndarray, tags: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals (doc, tag, lo, hi) of the windows that also start earlier in one of the pieces."""
    from .induced_sort import permuted_common_prefixes, suffix_array

    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8).astype(np.int16) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    text[starts + sizes] = 0  # between pieces; no byte is 0
    counts = sizes - LENGTH + 1
    piece_at = np.full(len(text), -1, np.int64)
    windows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    piece_at[windows] = np.repeat(np.arange(len(pieces)), counts)
    order = suffix_array(text)
    common = permuted_common_prefixes(text, order, barrier=0)
    # Suffixes that start no window have less than LENGTH bytes before the next barrier, so groups of equal windows are whole.
    group = np.cumsum(common[order] < LENGTH)
    window = piece_at[order] >= 0
    order, group = order[window], group[window]
    piece = piece_at[order]
    # Pieces of a document share a number, and numbers go in the order of documents.
    by = np.lexsort((tags, docs))
    new = np.ones(len(by), bool)
    new[1:] = (docs[by[1:]] != docs[by[:-1]]) | (tags[by[1:]] != tags[by[:-1]])
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(new) - 1
    named = by[new]
    doc, place = number[piece], places[piece] + order - starts[piece]
    by = np.lexsort((place, doc, group))
    group, doc, place = group[by], doc[by], place[by]
    again = _again([group], [doc, place])[1]
    who, lo, hi = merged(doc[again], place[again], place[again] + LENGTH)
    return docs[named[who]], tags[named[who]], lo, hi


def _settle(batches):
    """Pieces by anchor: repeats among their windows, through suffix arrays."""

    def work(rows):
        if len(rows) > 1:
            found = equal_windows([r[3] for r in rows], *(np.array([r[k] for r in rows], np.int64) for k in range(3)))
            if len(found[0]):
                yield _batch(SETTLED, *found, None)

    def defer(rows):
        for doc, tag, lo, piece in rows:
            n = len(piece) - LENGTH + 1
            yield _batch(SETTLED, [doc] * n, [tag] * n, range(lo, lo + n), range(lo + LENGTH, lo + LENGTH + n), [piece[k : k + LENGTH] for k in range(n)])

    shard, group, key, held, own = [], [], None, 0, 0
    deferring = False
    for batch in batches:
        for h, *row, piece in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if h != key:
                shard += group
                held += own
                group, own, key, deferring = [], 0, h, False
                if held >= SHARD_BYTES:
                    yield from work(shard)
                    shard, held = [], 0
            group.append((*row, piece))
            own += len(piece)
            if deferring or own > GROUP_BYTES:
                deferring = True
                yield from defer(group)
                group, own = [], 0
    yield from work(shard + group)
    give_back()


def release(spark: SparkSession) -> None:
    """Let the driver notice that finished steps' shuffle files are no longer referenced, so that executors delete them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, doc and tag (which name a document and order it), text."""
    text = text_or_empty()
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_DOC))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("doc"), F.xxhash64(F.lit(1), text).alias("tag"), text.alias("text"))


def _later_windows(windows: DataFrame) -> DataFrame:
    """Those that an equal one goes before. A window that very many rows have is dealt out by document first, so that only the
    earliest of each of the ``SALTS`` parts meet in one task."""
    order = ["doc", "tag", "lo"]
    one = windows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    one = one.withColumn("_nth", F.dense_rank().over(Window.partitionBy("piece", "_salt").orderBy(*order)))
    one = materialise(one, "suffix-windows")
    two = one.where("_nth = 1").withColumn("_nth", F.dense_rank().over(Window.partitionBy("piece").orderBy(*order)))
    return one.where("_nth > 1").union(two.where("_nth > 1"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc, tag, lo, hi: intervals of repeated bytes, which may overlap."""
    spark = docs.sparkSession
    plain = _documents(docs).select("doc", "tag", "text")
    found = materialise(plain.mapInArrow(_scan, ROWS).repartition("h").sortWithinPartitions(*KEYS).mapInArrow(_meet, FOUND), "suffix-found")
    release(spark)
    # A document's runs are fewer than its bytes, which a row holds anyway.
    wanted = found.where("kind = 1").distinct().groupBy("doc", "tag").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("runs"))
    raw = F.col("text").cast("binary")
    cut = F.transform("runs", lambda r: F.struct(r["h"].alias("h"), F.col("doc").alias("doc"), F.col("tag").alias("tag"), r["lo"].alias("lo"), F.substring(raw, r["lo"] + 1, r["hi"] - r["lo"]).alias("piece")))
    pieces = plain.join(wanted, ["doc", "tag"]).select(F.inline(cut))
    settled = materialise(pieces.repartition("h").sortWithinPartitions("h", "doc", "tag", "lo").mapInArrow(_settle, SETTLED), "suffix-settled")
    release(spark)
    rest = _later_windows(settled.where("piece is not null"))
    names = ["doc", "tag", "lo", "hi"]
    return found.where("kind = 0").select(*names).union(settled.where("piece is null").select(*names)).union(rest.select(*names))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, data (the bytes that stay), n_bytes, n_removed, n_spans."""
    return _cut(docs, "doc_id long, data binary, n_bytes long, n_removed long, n_spans long", lambda kept: {"data": kept})


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _cut(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda kept: {"kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})


def _cut(docs: DataFrame, schema: str, made) -> DataFrame:
    of = repeats(docs).groupBy("doc", "tag").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
    joined = _documents(docs).join(of, ["doc", "tag"], "left").select("doc_id", "text", "los", "his")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for text, los, his in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw = text.as_buffer().to_pybytes()
                n_bytes.append(len(raw))
                if not los.is_valid:
                    kept.append(raw)
                    n_removed.append(0)
                    n_spans.append(0)
                    continue
                lo, hi = los.values.to_numpy().astype(np.int64), his.values.to_numpy().astype(np.int64)
                _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, hi)
                edges = [0, *np.column_stack([lo, hi]).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
                n_removed.append(int((hi - lo).sum()))
                n_spans.append(len(lo))
            columns = {"doc_id": batch.column(0), "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans} | made(kept)
            kinds = {"data": pa.binary(), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.int64())) if n != "doc_id" else columns[n] for n in names], names=names)

    return joined.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = """
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM t)),
d AS MATERIALIZED (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
runs AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM d),
spans AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM runs) GROUP BY doc_id, k),
gaps AS (SELECT s.doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY s.doc_id ORDER BY lo), 0) AS before FROM spans s),
cut AS (
  SELECT t.doc_id, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed,
    string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (lo - before))::BIGINT), '' ORDER BY lo) || substr(max(h), (2 * max(hi) + 1)::BIGINT) AS kept
  FROM gaps JOIN t USING (doc_id) GROUP BY t.doc_id
)
SELECT t.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
"""
