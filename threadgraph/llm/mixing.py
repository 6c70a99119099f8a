"""Mixing of sources to target weights by iterative proportional fitting (DataFrame functions only).

Token counts are summed by source, language and topic. The sums are raked: in turn, the cells of each category are scaled to
the category's target share, until all three marginals hold. A cell's share divided by its tokens is its weight; weights are
scaled to inclusion probabilities of at most 1 so that the expected number of sampled tokens is ``budget`` of all tokens. Each
document is then kept or not by a hash of its doc_id against the probability of its cell.

Targets are shares by name. An axis without given targets aims at the observed shares raised to ``temperature`` (below 1: small
categories gain). Every category of an axis is raked by its own target, however many there are. Up to ``MAX_NAMES`` of them the
driver rakes the cells, which are then few enough to be broadcast; with more on any axis, cells and factors are tables that are
joined by axis in each round, and only totals come to the driver.

A corpus may have no way to meet all targets (a category that occurs only together with another one, say). Raking then goes on
for ``ROUNDS`` rounds, takes the shares of the last one, in which the topics' targets hold, and warns.

Defined results: null source, language or text count as categories named ``(null)`` and as empty; a document without tokens has
the probability of its cell, and a cell without tokens has probability 1; targets of categories that no document has are spread
over the others in proportion; repeated rows of a doc_id share their fate; a null doc_id is hashed like any value; an empty
table gives an empty result; further columns are ignored by ``mix``, and kept by ``sampled``, whatever their names.
"""

from __future__ import annotations

import json
import warnings
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fresh_names, materialise, table, text_or_empty

MAX_NAMES = {"source": 200, "lang": 50, "topic": 8}  # that the driver rakes: 80 k cells at most
ROUNDS, TOLERANCE = 200, 1e-9
LANG_TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
AXES = ("source", "lang", "topic")


def topic(text: Column) -> Column:
    """What kind of page a text looks like: contact data, licence, table, shouting, prose; eight names at most."""
    return (
        F.when(F.contains(text, F.lit("@")), "contact")
        .when(text.rlike("(?i)licen[sc]e|copyright"), "licence")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("!!")), "shouting")
        .when(F.length(text) < 600, "note")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, source, lang, topic."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").alias("doc_id"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("n_tokens"),
        F.coalesce(F.col("source").cast("string"), F.lit("(null)")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("(null)")).alias("lang"),
        topic(text).alias("topic"),
    )


def rake(cells: dict[tuple, float], targets: list[dict]) -> dict[tuple, float]:
    """Shares of the cells whose marginals are the targets, as near to the cells' own proportions as can be."""
    total = sum(cells.values())
    share = {c: n / total for c, n in cells.items() if n > 0} if total else {}
    wanted = []
    for axis, target in enumerate(targets):
        there = {c[axis] for c in share}
        held = {k: v for k, v in target.items() if k in there and v > 0}
        whole = sum(held.values())
        wanted.append({k: v / whole for k, v in held.items()})
    for _ in range(ROUNDS):
        worst = 0.0
        for axis, target in enumerate(wanted):
            sums: dict = defaultdict(float)
            for c, v in share.items():
                sums[c[axis]] += v
            for c in share:
                now = sums[c[axis]]
                if not now:  # a target of 0 was met
                    continue
                factor = target.get(c[axis], 0.0) / now
                worst = max(worst, abs(factor - 1))
                share[c] *= factor
        if worst < TOLERANCE:
            break
    else:
        _warn(worst)
    return share


def _warn(worst: float) -> None:
    warnings.warn(f"raking did not settle in {ROUNDS} rounds: a factor is still off by {worst:.2g}", stacklevel=2)


def probabilities(cells: dict[tuple, float], share: dict[tuple, float], budget: float) -> dict[tuple, float]:
    """Inclusion probability of each cell: in proportion to share / tokens, at most 1, and ``budget`` of the tokens expected."""
    total = sum(cells.values())
    want = budget * total
    free, taken = {c for c in share if share[c] > 0}, 0.0
    out = {c: 0.0 for c in cells} | {c: 1.0 for c, n in cells.items() if n <= 0}
    while free:
        scale = max(0.0, want - taken) / sum(share[c] for c in free)
        full = {c for c in free if scale * share[c] >= cells[c]}
        if not full:
            return out | {c: scale * share[c] / cells[c] for c in free}
        out |= dict.fromkeys(full, 1.0)
        taken += sum(cells[c] for c in full)
        free -= full
    return out


def _few(sums: DataFrame) -> bool:
    """Whether every axis has few enough names for the driver."""
    row = sums.agg(*[F.countDistinct(a).alias(a) for a in AXES]).first()
    return all(row[a] <= MAX_NAMES[a] for a in AXES)


def _raked_here(sums: DataFrame, targets: dict[str, dict], temperature: float, budget: float) -> DataFrame:
    """The lookup of ``calibrated``, worked out by the driver."""
    cells = {tuple(r[a] for a in AXES): float(r["n_tokens"]) for r in sums.collect()}  # bounded by MAX_NAMES
    wanted = []
    for k, axis in enumerate(AXES):
        seen: dict = defaultdict(float)
        for c, n in cells.items():
            seen[c[k]] += n
        given = targets.get(axis)
        tempered = {name: n**temperature for name, n in seen.items() if n > 0}
        if given is None:
            wanted.append(tempered)
        else:  # what has no target of its own keeps the share that the given ones leave, if any
            rest = max(0.0, 1 - sum(given.values()))
            others = {name: n for name, n in tempered.items() if name not in given}
            whole = sum(others.values())
            wanted.append(dict(given) | ({name: rest * n / whole for name, n in others.items()} if whole else {}))
    share = rake(cells, wanted)
    chance = probabilities(cells, share, budget)
    total = sum(cells.values())
    known = [[*c, share.get(c, 0.0) * total / cells[c] if cells[c] else 1.0, chance[c]] for c in sorted(cells)]
    schema = "array<struct<_source:string,_lang:string,_topic:string,weight:double,probability:double>>"
    literal = json.dumps([dict(zip(("_source", "_lang", "_topic", "weight", "probability"), c, strict=True)) for c in known])
    return F.broadcast(sums.sparkSession.range(1).select(F.inline(F.from_json(F.lit(literal), schema))))


def _target_table(full: DataFrame, axis: str, given: dict | None, temperature: float) -> DataFrame:
    """axis, target: the target share of each category that has tokens, if it is over 0."""
    seen = full.groupBy(axis).agg(F.pow(F.sum("n"), F.lit(float(temperature))).alias("tempered"))
    if given is None:
        valued = seen.withColumn("v", F.col("tempered"))
    else:
        known = json.dumps([{axis: k, "given": float(v)} for k, v in given.items()])
        rows = full.sparkSession.range(1).select(F.inline(F.from_json(F.lit(known), f"array<struct<{axis}:string,given:double>>")))
        seen = seen.join(rows, axis, "left")
        whole = seen.where("given is null").agg(F.sum("tempered")).first()[0]
        rest = max(0.0, 1 - sum(given.values()))
        valued = seen.withColumn("v", F.coalesce("given", rest * F.col("tempered") / F.lit(whole)))
    valued = materialise(valued.where("v > 0").select(axis, "v"), "mixing-targets")
    whole = valued.agg(F.sum("v")).first()[0]
    return valued.select(axis, (F.col("v") / F.lit(whole)).alias("target"))


def _raked_apart(sums: DataFrame, targets: dict[str, dict], temperature: float, budget: float) -> DataFrame:
    """The lookup of ``calibrated`` by the same steps as ``rake`` and ``probabilities``, on tables."""
    cells = sums.select(*AXES, F.col("n_tokens").cast("double").alias("n"))
    full = cells.where("n > 0")
    total = full.agg(F.sum("n")).first()[0] or 0.0
    wanted = [_target_table(full, axis, targets.get(axis), temperature) for axis in AXES]
    now = full.withColumn("share", F.col("n") / F.lit(total))
    for _ in range(ROUNDS):
        now = now.withColumn("worst", F.lit(0.0))
        for axis, target in zip(AXES, wanted, strict=True):
            held = now.groupBy(axis).agg(F.sum("share").alias("held"))
            factor = held.join(target, axis, "left").select(axis, F.coalesce(F.col("target") / F.col("held"), F.lit(0.0)).alias("factor"))
            now = now.join(factor, axis).withColumn("worst", F.greatest("worst", F.abs(F.col("factor") - 1)))
            # A share of 0 stays 0: its cell has no part in the rounds that follow.
            now = now.withColumn("share", F.col("share") * F.col("factor")).drop("factor").where("share > 0")
        now = materialise(now, "mixing-shares")
        worst = now.agg(F.max("worst")).first()[0]
        now = now.drop("worst")
        if worst is None or worst < TOLERANCE:
            break
    else:
        _warn(worst)
    # Cells are full in the order of share / n, so the scale tells which ones are; it grows until no further one is full.
    scale, left = 0.0, None
    while True:
        free = F.lit(scale) * F.col("share") < F.col("n")
        row = now.agg(F.count(F.when(free, 1)).alias("k"), F.sum(F.when(free, F.col("share"))).alias("share"), F.sum(F.when(~free, F.col("n"))).alias("taken")).first()
        if not row["k"] or (left is not None and row["k"] >= left):
            break
        scale, left = max(0.0, budget * total - (row["taken"] or 0.0)) / row["share"], row["k"]
    share = F.coalesce("share", F.lit(0.0))
    found = cells.join(now.drop("n"), list(AXES), "left").select(
        *[F.col(a).alias(f"_{a}") for a in AXES],
        F.when(F.col("n") > 0, share * F.lit(total) / F.col("n")).otherwise(1.0).alias("weight"),
        F.when(F.col("n") > 0, F.least(F.lit(1.0), F.lit(scale) * share / F.col("n"))).otherwise(1.0).alias("probability"),
    )
    return materialise(found, "mixing-lookup")


def calibrated(docs: DataFrame, targets: dict[str, dict] | None = None, temperature: float = 0.5, budget: float = 0.6) -> DataFrame:
    """_source, _lang, _topic, weight, probability of each cell."""
    targets = {"lang": LANG_TARGETS} if targets is None else targets
    sums = materialise(described(docs).groupBy(*AXES).agg(F.sum("n_tokens").alias("n_tokens")), "mixing-cells")
    return (_raked_here if _few(sums) else _raked_apart)(sums, targets, temperature, budget)


def _looked_up(rows: DataFrame, lookup: DataFrame, columns: dict[str, str]) -> DataFrame:
    keys = [F.col(columns[a]) == F.col(f"_{a}") for a in AXES]
    return rows.join(lookup, keys[0] & keys[1] & keys[2], "left")


def _drawn(seed: int, probability: str = "probability") -> Column:
    """Whether a row is in the sample: 53 bits of a hash, as a number from 0 to 1, against its probability."""
    uniform = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11).cast("double") / float(1 << 53)
    return uniform < F.col(probability)


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, seed: int = 17, **options) -> DataFrame:
    """doc_id, n_tokens, source, lang, topic, weight, probability, sampled: one row per document."""
    lookup = calibrated(docs, targets, **options)
    joined = _looked_up(described(docs), lookup, {a: a for a in AXES})
    return joined.select("doc_id", "n_tokens", "source", "lang", "topic", "weight", "probability", _drawn(seed).alias("sampled"))


def sampled(docs: DataFrame, targets: dict[str, dict] | None = None, seed: int = 17, **options) -> DataFrame:
    """The documents that were sampled, with all their columns; with few categories nothing is shuffled for it but the sums by cell."""
    lookup = calibrated(docs, targets, **options)
    names = fresh_names(docs.columns, *AXES, *[f"of_{n}" for n in lookup.columns])
    own = {a: F.coalesce(F.col(a).cast("string"), F.lit("(null)")) for a in ("source", "lang")} | {"topic": topic(text_or_empty())}
    rows = docs.withColumns({names[a]: c for a, c in own.items()})
    known = lookup.toDF(*[names[f"of_{n}"] for n in lookup.columns])
    keys = [F.col(names[a]) == F.col(names[f"of__{a}"]) for a in AXES]
    joined = rows.join(known, keys[0] & keys[1] & keys[2], "left")
    return joined.where(_drawn(seed, names["of_probability"])).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
