"""Merkle manifest of a dataset: built bottom-up over persisted levels, proofs pushed top-down (DataFrame functions only).

1. Every row becomes a leaf. Leaves are numbered within their language: range-partitioned by language, doc_id and digest, numbered
   in their range, and only the counts of ranges are summed up.
2. Bottom-up: ``fanout ** LEVELS`` consecutive nodes are a page. A page works out the levels above its nodes; its top is a node of
   the next persisted level, whose children are found again by language and number, until each language has one page. Nodes at the
   end of a level that are fewer than the fan-out, even one alone, are hashed like a full run. Subroots, in order of languages, are
   the leaves of one more tree, whose top is the root.
3. Top-down: a page is joined by its number with the proof that its parent inherited, and each of its nodes prepends its siblings
   (the digests beside it, left and right, level by level) to that suffix. A page holds a bounded number of nodes, so no join has
   a hot key, and suffixes travel once for each page instead of once for each row.

A digest is lowercase hexadecimal SHA-256 of the concatenated inputs, digests as hexadecimal text. A field is ``-`` if null,
otherwise its UTF-8 byte count, ``:`` and its value.

Defined results: a null lang is a language of its own, before all others; an empty text is ``0:``, unlike a null one; a null
doc_id is ``-``, comes first in its language, and is never tampered with; rows that share a doc_id are ordered by their leaf, and
equal rows have equal leaves but a place and a proof each; a lone leaf is its own subroot, and a lone subroot the root, with an empty
proof (the digest of nothing); texts of any length are hashed whole; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .crc_sql import CRC_TABLE, crc32

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 6  # levels of a page: 64 nodes at a fan-out of 2
TAMPER = 7


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    return digest(*[field(changed.get(name, F.col(name))) for name in FIELDS])


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with pos, their place in their group from 0, and n, the group's size; ``rows`` are written down already."""
    keys = [*group, *order]
    placed = rows.withColumn("_place", F.monotonically_increasing_id())  # tells equal rows apart, so that they needn't share a range
    placed = placed.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], "_place").withColumn("_part", F.spark_partition_id())
    placed = materialise(placed, "merkle-ranges")
    counts = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", *[F.col(g).alias(f"_{g}") for g in group], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    inside = Window.partitionBy("_part", *group).orderBy(*[F.col(k).asc_nulls_first() for k in order], "_place")
    same = [F.col("a._part") == F.col("b._part"), *[F.col(f"a.{g}").eqNullSafe(F.col(f"b._{g}")) for g in group]]
    own = placed.withColumn("_in", F.row_number().over(inside) - 1).alias("a").join(counts.alias("b"), same)
    return own.select(*[F.col(f"a.{c}").alias(c) for c in rows.columns], (F.col("a._in") + F.col("b._before")).alias("pos"), F.col("b.n").alias("n"))


def _height(n: Column, fanout: int) -> Column:
    """Levels above n leaves."""
    powers = F.array(*[F.lit(fanout**k).cast("long") for k in range(63) if fanout**k < 1 << 62])
    return F.size(F.filter(powers, lambda p: p < n))


def _run_digest(nodes: Column, fanout: int):
    return lambda run: digest(F.array_join(F.slice(nodes, run * fanout + 1, fanout), ""))


def _paged(nodes: DataFrame, fanout: int, step: int) -> DataFrame:
    """Pages of nodes (g, pos, height, digest, own): g, page, height, nodes, levels (the page's digests, level by level), top."""
    size = fanout**LEVELS
    page = nodes.groupBy("g", F.floor(F.col("pos") / size).alias("page"), "height").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "own"))).alias("nodes"))
    page = page.withColumn("steps", F.least(F.lit(LEVELS), F.col("height") - step * LEVELS)).withColumn("l0", F.col("nodes.digest"))
    for k in range(1, LEVELS + 1):
        runs = F.sequence(F.lit(0), F.ceil(F.size(f"l{k - 1}") / fanout).cast("int") - 1)
        below = F.col(f"l{k - 1}")
        page = page.withColumn(f"l{k}", F.transform(runs, _run_digest(below, fanout)))
    levels = F.array(*[F.col(f"l{k}") for k in range(LEVELS + 1)])
    return page.select("g", "page", "height", "steps", "nodes", levels.alias("levels")).withColumn("top", F.element_at(F.element_at("levels", F.col("steps") + 1), 1))


def _siblings(fanout: int) -> Column:
    """Of a page's node ``k``: (left, right) of each of its levels, the digests beside it in its run, joined."""
    entries = []
    for level in range(LEVELS):
        at = F.floor(F.col("k") / fanout**level).cast("int")
        first = at - at % fanout
        row = F.element_at("levels", level + 1)
        left = F.array_join(F.slice(row, first + 1, at - first), "")
        right = F.array_join(F.slice(row, at + 2, first + fanout - 1 - at), "")
        entries.append(F.when(F.col("steps") > level, F.struct(left.alias("left"), right.alias("right"))))
    return F.slice(F.array(*entries), 1, F.col("steps"))


def tree(leaves: DataFrame, fanout: int):
    """Tree over each group of leaves (g, pos, height, digest, own): its tops (g, digest), and a function that pushes proofs down.

    The function takes g, proof (the entries that follow), root, and gives g, pos, own, digest, proof, root, subroot of all leaves.
    """
    pages, tops, nodes, step = [], None, leaves, 0
    while True:
        level = materialise(_paged(nodes, fanout, step), "merkle-pages")
        pages.append(level)
        done = level.where(F.col("height") <= (step + 1) * LEVELS).select("g", F.col("top").alias("digest"))
        tops = done if tops is None else tops.union(done)
        more = level.where(F.col("height") > (step + 1) * LEVELS)
        if more.isEmpty():
            break
        nodes = more.select("g", F.col("page").alias("pos"), "height", F.col("top").alias("digest"), F.lit(None).cast(dict(leaves.dtypes)["own"]).alias("own"))
        step += 1

    def push(inherited: DataFrame) -> DataFrame:
        """``inherited``: g, proof, root."""
        above = None
        for k in range(len(pages) - 1, -1, -1):
            known = pages[k].join(inherited, "g").where(F.col("height") <= (k + 1) * LEVELS).withColumn("subroot", F.col("top"))
            if above is not None:
                below = pages[k].where(F.col("height") > (k + 1) * LEVELS).join(above, ["g", "page"])
                known = known.select(*pages[k].columns, "proof", "root", "subroot").union(below.select(*pages[k].columns, "proof", "root", "subroot"))
            each = known.select("g", "steps", "levels", "proof", "root", "subroot", F.posexplode("nodes").alias("k", "node"))
            each = each.select("g", "node.*", F.concat(_siblings(fanout), "proof").alias("proof"), "root", "subroot")
            above = each.select("g", F.col("pos").alias("page"), "proof", "root", "subroot")
        return each

    return tops, push


def manifest(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row; also n_proof, how many levels the proof has."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tampered = F.when((crc % TAMPER == 0) & F.col("n_chars").isNotNull(), leaf(n_chars=F.col("n_chars") + 1))
    rows = materialise(docs.select("doc_id", "lang", leaf().alias("leaf"), tampered.alias("tampered")), "merkle-leaves")
    placed = numbered(rows, ["lang"], ["doc_id", "leaf"])
    placed = placed.select(F.struct("lang").alias("g"), "pos", _height(F.col("n"), fanout).alias("height"), F.col("leaf").alias("digest"), F.struct("doc_id", "tampered").alias("own"))
    tops, push = tree(placed, fanout)
    tops = materialise(tops.select("g.lang", "digest"), "merkle-subroots")
    langs = numbered(tops, [], ["lang"])
    langs = langs.select(F.lit(0).alias("g"), "pos", _height(F.col("n"), fanout).alias("height"), "digest", F.struct("lang").alias("own"))
    roots, push_langs = tree(langs, fanout)
    start = roots.select("g", F.array().cast("array<struct<left:string,right:string>>").alias("proof"), F.col("digest").alias("root"))
    inherited = push_langs(start).select(F.col("own").alias("g"), "proof", "root")
    proofs = push(materialise(inherited, "merkle-proofs"))
    beside = F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), "")
    folded = F.aggregate("proof", F.coalesce("own.tampered", "digest"), lambda acc, x: digest(x["left"], acc, x["right"]))
    out = proofs.select(
        F.col("own.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        digest(beside).alias("proof_sha256"), folded.alias("folded_root"), F.size("proof").cast("long").alias("n_proof"),
    )
    return out.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_FIELDS = " || ".join(f"CASE WHEN {{t}}{c} IS NULL THEN '-' ELSE octet_length(encode(CAST({{t}}{c}{{{c}}} AS VARCHAR))) || ':' || CAST({{t}}{c}{{{c}}} AS VARCHAR) END" for c in FIELDS)


def _leaf_sql(more: str = "") -> str:
    return f"sha256({_FIELDS.format(t='', **{c: more if c == 'n_chars' else '' for c in FIELDS})})"


#: Levels by recursion, then each leaf's walk up its language's levels and the subroots'.
SQL = f"""
WITH RECURSIVE c AS ({CRC_TABLE}), leaves AS (
  SELECT doc_id, coalesce(lang, '') AS l, lang IS NOT NULL AS given, {_leaf_sql()} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND {crc32("CAST(doc_id AS VARCHAR)")} % {TAMPER} = 0 THEN {_leaf_sql(" + 1")} END AS tampered
  FROM documents, c
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY given, l ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY given, l) AS n FROM leaves
), levels AS (
  SELECT given, l, 0 AS level, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT given, l, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM levels WHERE n > 1 GROUP BY given, l, level, pos // 2
), subroots AS (
  SELECT given, l, h, row_number() OVER (ORDER BY given, encode(l)) - 1 AS pos, count(*) OVER () AS n FROM levels WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2
), walk AS (
  SELECT given, l, doc_id, leaf, pos AS own, 0 AS level, pos, n, coalesce(tampered, leaf) AS acc, '' AS proof FROM placed
  UNION ALL
  SELECT w.given, w.l, w.doc_id, w.leaf, w.own, w.level + 1, w.pos // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.acc ELSE w.acc || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
  FROM walk w LEFT JOIN levels s ON s.given = w.given AND s.l = w.l AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1
), further AS (
  SELECT w.given, w.l, w.doc_id, w.leaf, w.own, s.h AS subroot, 0 AS level, s.pos, s.n, w.acc, w.proof FROM walk w JOIN subroots s ON s.given = w.given AND s.l = w.l WHERE w.n = 1
  UNION ALL
  SELECT w.given, w.l, w.doc_id, w.leaf, w.own, w.subroot, w.level + 1, w.pos // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.acc ELSE w.acc || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
  FROM further w LEFT JOIN tops s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1
), heights AS (
  SELECT given, l, max(level) AS height FROM levels GROUP BY given, l
), top AS (
  SELECT h AS root, level AS height FROM tops WHERE n = 1
)
SELECT f.doc_id, f.leaf, f.subroot, t.root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = t.root AS verified, CAST(g.height + t.height AS BIGINT) AS n_proof
FROM further f JOIN heights g ON g.given = f.given AND g.l = f.l, top t WHERE f.n = 1
"""
