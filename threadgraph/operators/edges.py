"""Edge generators, one join each, and their assembly.

Pairs are of two nodes, the first before the second by (c_idx, s_idx). Generators that look at comments only join comments
first and spread to sentences afterwards. No generator builds the product of all nodes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import spans
from ..functions.vectors import cosine_blocks, cosines_of, packed, units
from ..schema import EDGE_WEIGHTS, ENDS, NODE_WEIGHTS, Graph
from ..storage import materialise
from .bundles import ALL, FIRST, NEXT, Pairs, bundle, sentences_of, spread
from .components import forest

MAX_TIME = 1000  # seconds; the configured value isn't consulted
BUCKET_ROWS = 4096  # comments of a bucket that are one key


def nodes_of(comments: DataFrame, fix_offsets: bool = False, text: str = "text") -> DataFrame:
    """A row for each sentence that is long enough."""
    rows = comments.select("c_idx", "id", "article_id", F.posexplode(spans(F.col(text), fix_offsets)).alias("s_idx", "span"))
    empty = [F.lit(None).cast("double").alias(w) for w in NODE_WEIGHTS]
    return rows.select("c_idx", F.col("s_idx").cast("long").alias("s_idx"), "id", "article_id", F.col("span.s").alias("s"), F.col("span.e").alias("e"), *empty)


def graph_of(comments: DataFrame, edges: DataFrame | None = None) -> Graph:
    nodes = nodes_of(comments)
    return Graph(comments, nodes, edges if edges is not None else assemble([edges_same_comment(nodes)]))


def _pairs(left: DataFrame, right: DataFrame, condition, weight, kind: str) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, condition)
    picked = joined.select(F.col("a.c_idx").alias("src_c"), F.col("a.s_idx").alias("src_s"), F.col("b.c_idx").alias("tgt_c"), F.col("b.s_idx").alias("tgt_s"), weight.cast("double").alias(kind))
    return picked.where(F.col(kind) != 0)


def _before():
    return (F.col("a.c_idx") < F.col("b.c_idx")) | ((F.col("a.c_idx") == F.col("b.c_idx")) & (F.col("a.s_idx") < F.col("b.s_idx")))


def edges_same_article(nodes: DataFrame, base: float = 1.0, only_root: bool = True) -> DataFrame:
    own = nodes.where("s_idx = 0") if only_root else nodes
    return _pairs(own, own, (F.col("a.article_id") == F.col("b.article_id")) & _before(), F.lit(base), "SAME_ARTICLE")


def edges_same_comment(nodes: DataFrame, base: float = 1.0, only_consecutive: bool = True) -> DataFrame:
    if only_consecutive:  # every sentence index up to the last is there, so this needs no join
        more = nodes.where("s_idx > 0").select(F.col("c_idx").alias("src_c"), (F.col("s_idx") - 1).alias("src_s"), F.col("c_idx").alias("tgt_c"), F.col("s_idx").alias("tgt_s"))
        return more.withColumn("SAME_COMMENT", F.lit(float(base))).where(F.col("SAME_COMMENT") != 0)
    return _pairs(nodes, nodes, (F.col("a.c_idx") == F.col("b.c_idx")) & (F.col("a.s_idx") < F.col("b.s_idx")), F.lit(base), "SAME_COMMENT")


def _spread(pairs: DataFrame, nodes: DataFrame, weight: str) -> DataFrame:
    """Edges of all sentences of the paired comments: pairs has c_a < c_b."""
    a = nodes.select(F.col("c_idx").alias("c_a"), F.col("s_idx").alias("src_s"))
    b = nodes.select(F.col("c_idx").alias("c_b"), F.col("s_idx").alias("tgt_s"))
    return pairs.join(a, "c_a").join(b, "c_b").select(F.col("c_a").alias("src_c"), "src_s", F.col("c_b").alias("tgt_c"), "tgt_s", weight).where(F.col(weight) != 0)


def replies(comments: DataFrame, base: float = 1.0) -> DataFrame:
    """c_a, c_b, REPLY_TO: the earlier of the two comments is the source, whichever answers the other."""
    answers = comments.where("reply_to_id is not null").select("c_idx", "reply_to_id")
    answered = comments.select(F.col("c_idx").alias("_other"), F.col("id").alias("reply_to_id"))
    pairs = answers.join(answered, "reply_to_id").where("c_idx <> _other")
    return pairs.select(F.least("c_idx", "_other").alias("c_a"), F.greatest("c_idx", "_other").alias("c_b")).distinct().withColumn("REPLY_TO", F.lit(float(base)))


def edges_reply_to(comments: DataFrame, nodes: DataFrame, base: float = 1.0, only_root: bool = True) -> DataFrame:
    return _spread(replies(comments, base), nodes.where("s_idx = 0") if only_root else nodes, "REPLY_TO")


BLOCK_ROWS = 16_384  # a block's vectors are 8 MB as doubles of 64 dimensions
LEAST_ROWS = 1024
ROWS_OUT = 1_000_000


def _known(comments: DataFrame, vectors: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """c_idx, embedding (null: none), and ``n`` if ``sizes`` (c_idx, n) is given, of the comments that it has."""
    own = comments.select("c_idx")
    own = own if sizes is None else own.join(sizes.select("c_idx", "n"), "c_idx")
    return own.join(vectors.select(F.col("vec_id").alias("c_idx"), "embedding"), "c_idx", "left")


def reach_of(known: DataFrame) -> tuple:
    """How many rows, the least and the largest c_idx."""
    return tuple(known.agg(F.count(F.lit(1)), F.min("c_idx"), F.max("c_idx")).first())


def _tiles(known: DataFrame, block_rows: int | None, work, schema: str, reach: tuple | None = None) -> DataFrame:
    """``work`` (low vectors, high vectors, same block) on every pair of blocks of vectors; each is (c_idx, packed embeddings, the rows).

    Blocks are ranges of c_idx, so that all ids of a low one come first; where numbers have wide gaps, vectors are dealt by hash. Each
    pair of blocks is a group. Blocks are as large as leaves a few groups for each core, as a vector is sent once for each block; what a
    group finds goes out in batches, so it holds two blocks and one batch at most.
    """
    (count, least, last), cores = reach or reach_of(known), known.sparkSession.sparkContext.defaultParallelism
    if block_rows is None:
        block_rows = min(BLOCK_ROWS, max(LEAST_ROWS, int(count / (8 * cores) ** 0.5)))
    span = last - least + 1 if count else 0
    if span <= 2 * count:
        blocks = max(1, -(-span // block_rows))
        block = F.floor((F.col("c_idx") - (least or 0)) / block_rows).cast("long")
    else:
        blocks = max(1, -(-count // block_rows))
        block = F.pmod(F.xxhash64("c_idx"), F.lit(blocks))
    own = known.withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other")
    dealt = own.select(*own.columns, other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")

    def group(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).sort_by("c_idx")
        low, high = table["i"][0], table["j"][0]
        sides = [table.filter(pc.equal(table["block"], x)) for x in (low, high)]
        if sides[0].num_rows and sides[1].num_rows:
            yield from work(*[(side["c_idx"].to_numpy(), packed(side["embedding"]), side) for side in sides], low == high)

    def stream(batches):
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = pc.add(pc.multiply(batch.column("i"), blocks), batch.column("j"))
            ends = (pc.indices_nonzero(pc.not_equal(key[1:], key[:-1])).to_numpy() + 1).tolist()
            for start, end in zip([0, *ends], [*ends, len(key)], strict=True):
                piece = batch.slice(start, end - start)
                if open_ and (open_[0]["i"][0], open_[0]["j"][0]) != (piece["i"][0], piece["j"][0]):
                    yield from group(open_)
                    open_ = []
                open_.append(piece)
        if open_:
            yield from group(open_)

    # Tasks are numbered here, as the work of a group grows with its square and a size in bytes tells nothing of it.
    groups = blocks * (blocks + 1) // 2
    return dealt.repartition(min(groups, max(4 * cores, groups // 4)), "i", "j").sortWithinPartitions("i", "j").mapInArrow(stream, schema)


def _cosines(left: tuple, right: tuple, same: bool, max_similarity: float, base: float):
    """Ids of some rows, ids of all columns, which pairs of them qualify (each pair once), and their weights."""
    (ids_a, own, _), (ids_b, others, _) = left, right
    for start, cos in cosine_blocks(own, others):
        rows = ids_a[start : start + len(cos)]
        with np.errstate(invalid="ignore"):
            weight = (1 - cos) / (1 - max_similarity) * base
            wanted = (cos < max_similarity) & (weight != 0)
        if same:
            wanted &= rows[:, None] < ids_b[None, :]
        yield rows, ids_b, wanted, weight


def _pair_batches(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(np.concatenate(x)) for n, x in zip(("c_a", "c_b", "SIMILARITY"), zip(*found, strict=True), strict=True)})


PAIRS = "c_a long, c_b long, SIMILARITY double"


def similar_comments(comments: DataFrame, vectors: DataFrame, max_similarity: float = 0.75, base: float = 0.1, block_rows: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """c_a, c_b, SIMILARITY of comments whose cosine is below ``max_similarity``; the weight grows with the distance.

    What is asked for is most of all pairs, so they are never shuffled: with ``sizes`` (c_idx, n) a pair brings n_a and n_b along, and
    comments that it lacks are left out.
    """
    if max_similarity == 1:
        raise ZeroDivisionError("a similarity of 1 leaves no room for a weight")
    sized = sizes is not None
    names = ["c_a", "c_b", *(["n_a", "n_b"] if sized else []), "SIMILARITY"]

    def work(left, right, same):
        n_left, n_right = [side[2]["n"].to_numpy() for side in (left, right)] if sized else (None, None)
        found, n, at = [], 0, 0

        def batch():
            return pa.RecordBatch.from_pydict({name: pa.array(np.concatenate(x)) for name, x in zip(names, zip(*found, strict=True), strict=True)})

        for rows, columns, wanted, weight in _cosines(left, right, same, max_similarity, base):
            r, c = np.nonzero(wanted)
            a, b = rows[r], columns[c]
            ends = [a, b, n_left[at + r], n_right[c]] if sized else [a, b]
            if len(a) and not same and rows[-1] > columns[0]:
                turned = a > b
                for k in range(0, len(ends), 2):
                    ends[k : k + 2] = np.where(turned, ends[k + 1], ends[k]), np.where(turned, ends[k], ends[k + 1])
            found.append((*ends, weight[r, c]))
            at += len(rows)
            n += len(a)
            if n > ROWS_OUT:
                yield batch()
                found, n = [], 0
        if n:
            yield batch()

    return _tiles(_known(comments, vectors, sizes), block_rows, work, ", ".join(f"{name} {'double' if name == 'SIMILARITY' else 'long'}" for name in names))


def _first(key: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least, the first of equal ones."""
    if len(key) <= k:
        return np.arange(len(key))
    bound = np.partition(key, k - 1)[k - 1]
    less = np.flatnonzero(key < bound)
    return np.concatenate((less, np.flatnonzero(key == bound)[: k - len(less)]))


BOUND_ROWS = 2048
CELLS_MULTIPLIED = 4_194_304
NEAR = 1e-9  # products of matrices differ from the expression's cosines by far less
BOUNDED = "c_idx long, embedding array<double>, bound double, others array<long>, weights array<double>"


def _bounds(first: tuple, k: int, sign: int, max_similarity: float, base: float):
    """For batches of vectors: the ``k`` first neighbours of each among ``first``, and the last one's weight (its sign turned if
    ``sign`` is -1; infinite if there are fewer)."""

    def told(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            side = (rows["c_idx"].to_numpy(), packed(rows["embedding"]), rows)
            bound, others, weights = [], [], []
            for own, ids, wanted, weight in _cosines(side, first, False, max_similarity, base):
                key = np.where(wanted & (own[:, None] != ids[None, :]), sign * weight, np.inf)
                for r in range(len(own)):
                    at = _first(key[r], k)
                    at = at[np.isfinite(key[r, at])]
                    bound.append(key[r, at].max() if len(at) == k else np.inf)
                    others.append(ids[at])
                    weights.append(weight[r, at])
            yield pa.RecordBatch.from_pydict({"c_idx": rows["c_idx"].combine_chunks(), "embedding": rows["embedding"].combine_chunks().cast(pa.list_(pa.float64())), "bound": pa.array(bound, pa.float64()), "others": pa.array(others, pa.list_(pa.int64())), "weights": pa.array(weights, pa.list_(pa.float64()))})

    return told


def _first_of(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of rows (own, other, key) the ``k`` first by key and other, of each own."""
    own, other, key = found
    order = np.lexsort((other, key, own))
    own = own[order]
    start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    kept = order[rank < k]
    return [found[0][kept], other[kept], key[kept]]


def first_similar(comments: DataFrame, vectors: DataFrame, k: int, descending: bool = True, max_similarity: float = 0.75, base: float = 0.1, block_rows: int | None = None) -> DataFrame:
    """Of ``similar_comments`` those that are among the ``k`` first of either comment by weight, and then by the other comment, and
    some more. ``k`` counts from 1.

    Every comment meets the first ones, and the first ones without a vector, which bounds the weight of its ``k`` first. One without
    a vector is equally far from all, so this is all of it. Pairs of blocks of the others are multiplied as matrices, and only
    pairs that may be within a bound, by a margin over the rounding of such products, get the expression's value. Each pair of blocks
    gives the ``k`` first of each of its comments, so rows grow with comments times blocks, not with pairs.
    """
    if max_similarity == 1:
        raise ZeroDivisionError("a similarity of 1 leaves no room for a weight")

    sign, slope = -1 if descending else 1, base / (1 - max_similarity)

    def each(left, right, same):
        columns = right[0]
        best_ids, best = np.zeros((len(columns), k), np.int64), np.full((len(columns), k), np.inf)
        found = []

        def kept(own, others, weights):
            found.append((np.minimum(own, others), np.maximum(own, others), weights))

        for rows, ids, wanted, weight in _cosines(left, right, same, max_similarity, base):
            key = np.where(wanted, sign * weight, np.inf)
            for r, own in enumerate(rows):
                at = _first(key[r], k)
                at = at[wanted[r, at]]
                kept(np.full(len(at), own), ids[at], weight[r, at])
            # Ids ascend, so of equal weights the earlier rows' stay.
            new = np.flatnonzero((key < best[:, -1]).any(axis=0))
            both = np.hstack((best[new], key[:, new].T))
            both_ids = np.hstack((best_ids[new], np.broadcast_to(rows, (len(new), len(rows)))))
            order = np.argsort(both, axis=1, kind="stable")[:, :k]
            best[new], best_ids[new] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
        r, c = np.nonzero(np.isfinite(best))
        kept(columns[r], best_ids[r, c], sign * best[r, c])
        yield _pair_batches(found)

    def work(left, right, same):
        unit = [units(side[1]) for side in (left, right)]
        if not slope or any(u is None for u in unit) or unit[0].shape[1] != unit[1].shape[1]:
            yield from each(left, right, same)
            return
        low = sign * slope < 0  # the least cosines come first
        turn = 1.0 if low else -1.0
        bounds = [side[2]["bound"].to_numpy() for side in (left, right)]
        with np.errstate(invalid="ignore"):
            most = [np.minimum(turn * (1 - sign * b / slope), max_similarity if low else np.inf) + NEAR for b in bounds]
        ids_a, ids_b = left[0], right[0]
        sides: list[list] = [[], []]

        def settle():
            for x, side in enumerate(sides):
                if side:
                    sides[x] = [tuple(_first_of([np.concatenate(y) for y in zip(*side, strict=True)], k))]

        at_once, n = max(1, CELLS_MULTIPLIED // len(ids_b)), 0
        for start in range(0, len(ids_a), at_once):
            rows = slice(start, start + at_once)
            near = (turn * unit[0][rows]) @ unit[1].T
            maybe = near <= most[0][rows, None]
            if not same:
                maybe |= near <= most[1][None, :]
            if not low:
                maybe &= near >= -max_similarity - NEAR
            cells = np.flatnonzero(maybe)
            for cut in range(0, len(cells), ROWS_OUT):
                r, c = np.divmod(cells[cut : cut + ROWS_OUT], len(ids_b))
                cos = cosines_of(left[1], right[1], r + start, c)
                a, b, weight = ids_a[r + start], ids_b[c], (1 - cos) / (1 - max_similarity) * base
                key = sign * weight
                wanted = (cos < max_similarity) & (weight != 0) & (a != b)
                for side, own, other, bound in ((0, a, b, bounds[0][r + start]), (1, b, a, bounds[1][c])):
                    if side and same:  # rows meet all columns
                        continue
                    kept = wanted & (key <= bound)
                    sides[side].append((own[kept], other[kept], key[kept]))
                    n += len(kept)
                if n > ROWS_OUT:
                    settle()
                    n = 0
        settle()
        found = [(np.minimum(own, other), np.maximum(own, other), sign * key) for side in sides for own, other, key in side]
        if found:
            yield _pair_batches(found)

    known = _known(comments, vectors)
    if k > BOUND_ROWS // 2:
        return _tiles(known, block_rows, each, PAIRS).distinct()
    rows = known.orderBy("c_idx").limit(BOUND_ROWS).union(known.where("embedding is null").orderBy("c_idx").limit(k)).toArrow()  # a bounded number of vectors
    _, once = np.unique(rows["c_idx"].to_numpy(), return_index=True)
    rows = rows.take(once)
    first = (rows["c_idx"].to_numpy(), packed(rows["embedding"]), rows)
    cores = known.sparkSession.sparkContext.defaultParallelism
    bounded = materialise(known.repartition(4 * cores, "c_idx").mapInArrow(_bounds(first, k, sign, max_similarity, base), BOUNDED), "similar-bounds")
    pair = F.explode(F.arrays_zip(F.col("others").alias("other"), F.col("weights").alias("weight"))).alias("p")
    pairs = bounded.select("c_idx", pair).select(F.least("c_idx", "p.other").alias("c_a"), F.greatest("c_idx", "p.other").alias("c_b"), F.col("p.weight").alias("SIMILARITY"))
    return pairs.union(_tiles(bounded.where("embedding is not null").select("c_idx", "embedding", "bound"), block_rows, work, PAIRS)).distinct()


FIRST_ROWS = 1024


def _first_ties(first: tuple, passes, max_similarity: float, base: float):
    """For batches of vectors: pairs of one of the ``first`` comments that tie parts together, in order, and, with c_b null, the comments
    that these leave apart from the first one."""

    def told(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).sort_by("c_idx")
            rows = rows.filter(pc.greater(rows["c_idx"], int(first[0][-1])))
            ids, of = np.concatenate((first[0], rows["c_idx"].to_numpy())), first[2]["embedding"].combine_chunks()
            both = packed(pa.chunked_array([of, *rows["embedding"].cast(of.type).chunks]))
            label, found = np.arange(len(ids)), []
            at = 0
            for own, columns, wanted, weight in _cosines(first, (ids, both, None), True, max_similarity, base):
                if (label == label[0]).all():
                    break
                wanted &= passes(weight)
                for r in range(len(own)):
                    new = np.flatnonzero(wanted[r] & (label != label[at + r]))
                    if len(new):  # of the columns of a part only the first one ties it
                        parts, k = np.unique(label[new], return_index=True)
                        new = np.sort(new[k])
                        found.append((np.full(len(new), own[r]), columns[new], weight[r, new]))
                        label[np.isin(label, parts)] = label[at + r]
                at += len(own)
            apart = ids[label != label[0]]
            a, b, w = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_pydict({
                "c_a": pa.array(np.concatenate((a, apart))),
                "c_b": pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(apart), pa.int64())]),
                "SIMILARITY": pa.concat_arrays([pa.array(w, pa.float64()), pa.nulls(len(apart), pa.float64())]),
            })

    return told


def _tied(cosines, passes):
    """Pairs that pass, less those that earlier ones have tied together."""
    found = []
    for rows, columns, wanted, weight in cosines:
        r, c = np.nonzero(wanted & passes(weight))
        a, b, w = np.minimum(rows[r], columns[c]), np.maximum(rows[r], columns[c]), weight[r, c]
        order = np.lexsort((b, a))
        batch = pa.RecordBatch.from_pydict({"a": pa.array(a[order]), "b": pa.array(b[order]), "w": pa.array(w[order])})
        found += list(forest([batch]))
    table = pa.Table.from_batches(found).sort_by([("a", "ascending"), ("b", "ascending")]) if found else None
    for batch in forest(table.combine_chunks().to_batches()) if table else []:
        yield pa.RecordBatch.from_arrays(batch.columns, ["c_a", "c_b", "SIMILARITY"])


def tied_similar(comments: DataFrame, vectors: DataFrame, passes, max_similarity: float = 0.75, base: float = 0.1, block_rows: int | None = None) -> DataFrame:
    """Of ``similar_comments`` those that ``passes`` (an array of weights to one of booleans) takes, less those that earlier ones, by
    (c_a, c_b), have tied together, and some more.

    Pairs of the first comments come first, and where most pairs pass they tie nearly all. A pair of two comments that they have tied to
    the first one is later than all of them, so it ties nothing. So only comments that they leave apart are then met with all others. If
    those are more than a block, all pairs of blocks are looked at, and each gives a forest: fewer pairs than comments.
    """
    if max_similarity == 1:
        raise ZeroDivisionError("a similarity of 1 leaves no room for a weight")

    def work(left, right, same):
        yield from _tied(_cosines(left, right, same, max_similarity, base), passes)

    known = materialise(_known(comments, vectors), "similar-vectors")
    most = block_rows or LEAST_ROWS
    if known.limit(2 * most + 1).count() <= 2 * most:
        return _tiles(known, block_rows, work, PAIRS)
    side = lambda df: (lambda rows: (rows["c_idx"].to_numpy(), packed(rows["embedding"]), rows))(df.toArrow().sort_by("c_idx"))
    first = side(known.orderBy("c_idx").limit(min(most, FIRST_ROWS)))  # a bounded number of vectors
    cores = known.sparkSession.sparkContext.defaultParallelism
    found = materialise(known.repartition(4 * cores, "c_idx").mapInArrow(_first_ties(first, passes, max_similarity, base), PAIRS), "similar-first")
    apart = materialise(found.where("c_b is null").select(F.col("c_a").alias("c_idx")).where(F.col("c_idx") > int(first[0][-1])).distinct(), "similar-apart")
    tied = found.where("c_b is not null").distinct()  # pairs of two first comments are found by several tasks
    most = block_rows or BLOCK_ROWS
    n = apart.limit(most + 1).count()
    if n > most:
        return _tiles(known, block_rows, work, PAIRS)
    if not n:
        return tied
    lone, last = side(known.join(apart, "c_idx", "left_semi")), int(first[0][-1])

    def rest(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch]).sort_by("c_idx")
            rows = rows.filter(pc.greater(rows["c_idx"], last))
            if rows.num_rows:
                yield from _tied(_lone(_cosines(lone, (rows["c_idx"].to_numpy(), packed(rows["embedding"]), rows), False, max_similarity, base), lone[0]), passes)

    return tied.unionByName(known.repartition(4 * cores, "c_idx").mapInArrow(rest, PAIRS))


def _lone(cosines, ids: np.ndarray):
    """Each pair once, and none of a comment with itself, where the rows are all of ``ids`` and some of the columns are among them."""
    for rows, columns, wanted, weight in cosines:
        yield rows, columns, wanted & ((rows[:, None] < columns[None, :]) | ~np.isin(columns, ids)[None, :]), weight


def edges_similarity(comments: DataFrame, nodes: DataFrame, vectors: DataFrame, max_similarity: float = 0.75, base: float = 0.1) -> DataFrame:
    return _spread(similar_comments(comments, vectors, max_similarity, base), nodes, "SIMILARITY")


def _busy_keys(own: DataFrame, name: str, other: str, busy: DataFrame) -> DataFrame:
    """Rows of ``own`` for one side of the join, once for each part of each bucket that they meet."""
    n_own = busy.select("bucket", F.col("parts").alias("_own"))
    n_other = busy.select(F.col("bucket").alias(f"bucket_{other}"), F.col("parts").alias("_other"))
    rows = own.join(n_own, "bucket", "left").withColumn(f"part_{name}", F.pmod(F.xxhash64("c_idx"), F.coalesce("_own", F.lit(1))))
    rows = rows.withColumn(f"bucket_{other}", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1))).join(n_other, f"bucket_{other}", "left")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_other", F.lit(1)) - 1)).alias(f"part_{other}")
    return rows.select(F.col("c_idx").alias(f"c_{name}"), F.col("at").alias(f"at_{name}"), F.col("bucket").alias(f"bucket_{name}"), f"part_{name}", f"bucket_{other}", part)


PAIR_KEY = ["bucket_a", "part_a", "bucket_b", "part_b"]


def candidates_in_time(own: DataFrame, bucket_rows: int) -> DataFrame:
    """c_a, at_a, c_b, at_b of rows (c_idx, at, bucket) whose buckets are the same or side by side.

    Buckets of over ``bucket_rows`` are dealt into parts by count, and pairs of parts are the keys, so that a second in which
    very many comments were written is no hot key. What is repeated for it is part of the pairs that it asks for.
    """
    counts = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    busy = materialise(counts.select("bucket", F.ceil(F.col("n") / bucket_rows).cast("long").alias("parts")), "busy-buckets")
    if busy.isEmpty():
        a = own.select(F.col("c_idx").alias("c_a"), F.col("at").alias("at_a"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
        return a.join(own.select(F.col("c_idx").alias("c_b"), F.col("at").alias("at_b"), "bucket"), "bucket").where("c_a < c_b")
    return _busy_keys(own, "a", "b", busy).join(_busy_keys(own, "b", "a", busy), PAIR_KEY).where("c_a < c_b")


def close_comments(comments: DataFrame, max_time: int = MAX_TIME, base: float = 1.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """c_a, c_b, TEMPORAL of comments less than ``max_time`` seconds apart.

    A range join by equal keys: buckets of max_time seconds, each comment looked up in its own and the two beside it.
    """
    at = F.unix_micros("ts")
    own = comments.select("c_idx", at.alias("at"), F.floor(at / (max_time * 1_000_000)).alias("bucket")).where("at is not null")
    micros = F.col("at_a") - F.col("at_b")
    # Later by position but earlier in time: exact seconds; otherwise whole ones.
    gap = F.when(micros > 0, micros / 1_000_000).otherwise(F.floor(-micros / 1_000_000).cast("double"))
    pairs = candidates_in_time(own, bucket_rows).withColumn("gap", gap).where(F.col("gap") < max_time)
    return pairs.select("c_a", "c_b", ((1 - F.col("gap") / max_time) * base).alias("TEMPORAL"))


def edges_temporal(comments: DataFrame, nodes: DataFrame, max_time: int = MAX_TIME, base: float = 1.0) -> DataFrame:
    across = _spread(close_comments(comments, max_time, base), nodes, "TEMPORAL")
    timed = nodes.join(comments.where("ts is not null").select("c_idx"), "c_idx", "left_semi")
    within = edges_same_comment(timed, base, only_consecutive=False).withColumnRenamed("SAME_COMMENT", "TEMPORAL")
    return across.union(within)


def assemble(parts: list[DataFrame]) -> DataFrame:
    """One row for each pair of nodes with all its weights, and ``ord``, the order in which nested loops would meet it."""
    wide = [p.select(*ENDS, *[(F.col(w) if w in p.columns else F.lit(None).cast("double")).alias(w) for w in EDGE_WEIGHTS]) for p in parts]
    one = reduce(DataFrame.unionByName, wide)
    if len(parts) > 1:
        one = one.groupBy(*ENDS).agg(*[F.max(w).alias(w) for w in EDGE_WEIGHTS])
    return one.withColumn("ord", F.array(*ENDS))


def pairs_same_article(nodes: DataFrame, base: float = 1.0, only_root: bool = True) -> Pairs:
    a, b = (nodes.where("s_idx = 0").select(F.col("c_idx").alias(c), "article_id") for c in ("c_a", "c_b"))
    rows = a.join(b, "article_id").where("c_a < c_b" if only_root else "c_a <= c_b")
    return Pairs(rows.select("c_a", "c_b", F.lit(float(base)).alias("SAME_ARTICLE")), "SAME_ARTICLE", FIRST if only_root else ALL)


def _own(comments: DataFrame, kind: str, base: float) -> DataFrame:
    return comments.select(F.col("c_idx").alias("c_a"), F.col("c_idx").alias("c_b"), F.lit(float(base)).alias(kind))


def pairs_same_comment(nodes: DataFrame, base: float = 1.0, only_consecutive: bool = True) -> Pairs:
    return Pairs(_own(nodes.where("s_idx = 0"), "SAME_COMMENT", base), "SAME_COMMENT", NEXT if only_consecutive else ALL)


def pairs_reply_to(comments: DataFrame, base: float = 1.0, only_root: bool = True) -> Pairs:
    return Pairs(replies(comments, base), "REPLY_TO", FIRST if only_root else ALL)


def pairs_similarity(comments: DataFrame, nodes: DataFrame, vectors: DataFrame, max_similarity: float = 0.75, base: float = 0.1) -> Pairs:
    return Pairs(similar_comments(comments, vectors, max_similarity, base, sizes=sentences_of(nodes)), "SIMILARITY", ALL)


def pairs_temporal(comments: DataFrame, max_time: int = MAX_TIME, base: float = 1.0) -> Pairs:
    return Pairs(close_comments(comments, max_time, base).union(_own(comments.where("ts is not null"), "TEMPORAL", base)), "TEMPORAL", ALL)


def bundled(comments: DataFrame, nodes: DataFrame, parts: list[Pairs]) -> Graph:
    """The graph that ``assemble`` gives for the same generators. Sentences of a comment are numbered from 0 without gaps."""
    found = bundle(nodes, parts)
    return Graph(comments, nodes, spread(found), found)
