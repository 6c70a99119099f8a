"""Personal data: span candidates, boosted trees over format and context, calibrated thresholds (DataFrame functions only).

For each kind a base pattern and a high-recall generator propose spans, which may overlap. Spans of the base rules (a base match
that passes its kind's check) always stay. All other proposals, base matches that fail their check among them, are scored by
boosted trees over format (digits, groups, length, marks, check) and context (neighbouring characters, cue words before), and
added if the score reaches their kind's threshold and they overlap no base span.

What is learned is whether a span is personal data, not whether it passes a check. There are no such labels in the tables, so the
classifier is fit on ``PLANTS`` examples that are made here by rule: each is a line of text with a personal item in a plain or
disguised form, or with a lookalike (order and part numbers, versions, dates, settings, mistyped numbers), after a cue word, a
misleading one or none. A candidate is positive if it has more than half of a personal item and is of its kind. There are several makers
of examples, with names, prose, cue words and forms of their own. Trees learn from two of them; on a third one's examples, thresholds
are set so that ``PRECISION`` of what is accepted is positive; a fourth one's measure recall in the tests. Only counts by feature
values come to the driver.

The texts themselves are read once, without a shuffle. Positions are code points, ends exclusive. Defined results: a null text
counts as empty and has no spans; texts of any length are searched whole; repeated rows give repeated results; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "secret")  # the last has no base rule
#: The base patterns, written so that a search is linear: repeats that can't give back are possessive, and a match may begin
#: only where its first run of characters does, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GATE = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: High-recall generators of forms that the base patterns don't read.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}|(?<= )(?:at|AT)(?= )) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}|(?<= )(?:dot|DOT)(?= )) ?[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]| \. )[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:[a-z0-9]{1,16}[_-])?(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)[\"']? {0,2}[:=] {0,2}[\"']?[a-z0-9+/_.=-]{6,256}[\"']?",
}
MORE_GATE = {
    "email": r"[\[({]at[\])}]| (?:at|AT) [A-Za-z0-9-]{1,63} (?:dot|DOT) ",
    "ip": r"[0-9](?:[\[(](?:\.|dot)[\])]| \. [0-9])",
    "card": r"[0-9]{4}[._/][0-9]{4}",
    "phone": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|key)[\"']? {0,2}[:=]",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|courriel|correo)\W{0,3}\w{0,4}\W{0,3}$",
    "ip": r"(?i)(?:\bip|host|server|addr\w*)\W{0,3}\w{0,4}\W{0,3}$",
    "card": r"(?i)(?:card|visa|karte|carte|tarjeta|pay\w*)\W{0,3}\w{0,4}\W{0,3}$",
    "phone": r"(?i)(?:tel\w*|phone|call|fax|mobil\w*|fon)\W{0,3}\w{0,4}\W{0,3}$",
    "secret": r"(?i)(?:export|set|env|auth\w*|login|config)\W{0,3}\w{0,4}\W{0,3}$",
}
LOOKALIKE_CUE = r"(?i)(?:order|part|item|isbn|ref\w*|invoice|version|section|serial|tracking|sku|figure|width|example|\bno|\bnr)\W{0,3}\w{0,3}\W{0,3}$"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Values of each feature.
FEATURES = {"kind": 5, "digits": 6, "groups": 4, "valid": 2, "before": 4, "after": 4, "cue": 3, "marks": 6, "length": 4}
PLANTS = 9_000  # examples to learn from
PRECISION = 0.9
ROUNDS, RATE, LEAST_HESSIAN, DEPTH = 20, 0.4, 1.0, 3


def valid(kind: str, found: Column) -> Column:
    """Whether a span passes its kind's check, its digits taken without the marks between them."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "email":  # an address as such always passes; a disguised one has to end like a domain
        return F.contains(found, F.lit("@")) | found.rlike("(?:^|[^A-Za-z])[A-Za-z]{2,4}$")
    if kind == "ip":
        plain = F.regexp_replace(F.regexp_replace(found, r"[^0-9]+", "."), r"^\.|\.$", "")
        return plain.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "secret":
        value = F.regexp_extract(found, r"[:=] *[\"']?([^\"']*)", 1)
        return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("(?i)[a-z]")
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", digits)
    return n.between(9, 15)


def _class(char: Column) -> Column:
    """0 nothing or white space, 1 letter, 2 digit, 3 mark."""
    return F.when(char.rlike(r"^\s*$"), 0).when(char.rlike(r"^\p{L}"), 1).when(char.rlike("^[0-9]"), 2).otherwise(3)


def _marks(found: Column) -> Column:
    """0 none, 1 white space, 2 dots, 3 dashes and the like, 4 words in place of marks, 5 brackets."""
    return (
        F.when(found.rlike(r"[\[({](?:\.|at|dot)[\])}]"), 5)
        .when(found.rlike(r"(?i) (?:at|dot) "), 4)
        .when(found.rlike(r"[-/_()=:]"), 3)
        .when(found.rlike(r"\s"), 1)
        .when(found.rlike(r"\."), 2)
        .otherwise(0)
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def candidates(text: Column, kind: str, pattern: str, gate: str, base: bool) -> Column:
    """Array of candidate structs, by their start.

    The k-th match starts after the first k gaps and k - 1 matches. These sums are taken from the start of the match's block,
    with blocks of the square root of all matches.
    """

    def describe(r, start):
        digits = F.length(F.regexp_replace(r["m"], "[^0-9]", ""))
        groups = F.least(F.size(F.regexp_extract_all(r["m"], F.lit("[0-9]+"), F.lit(0))), F.lit(3))
        size = F.when(digits == 0, 0).when(digits < 9, 1).when(digits < 13, 2).when(digits < 16, 3).when(digits < 20, 4).otherwise(5)
        length = F.length(r["m"])
        said = F.right(r["g"], F.lit(24))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            start.alias("s"),
            (start + length).alias("e"),
            F.lit(base).alias("base"),
            size.alias("digits"),
            groups.cast("int").alias("groups"),
            valid(kind, r["m"]).cast("int").alias("valid"),
            _class(F.right(r["g"], F.lit(1))).alias("before"),
            _class(r["a"]).alias("after"),
            F.when(said.rlike(CUES[kind]), 2).when(said.rlike(LOOKALIKE_CUE), 0).otherwise(1).alias("cue"),
            _marks(r["m"]).alias("marks"),
            F.when(length < 16, 0).when(length < 32, 1).when(length < 64, 2).otherwise(3).alias("length"),
        )

    def rows(x):
        before = F.zip_with(x["found"], F.slice(x["gaps"], F.lit(1), F.size(x["found"])), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        after = F.slice(x["gaps"], F.lit(2), F.size(x["found"]))
        return F.zip_with(before, after, lambda r, a: F.struct(r["m"].alias("m"), r["g"].alias("g"), F.substring(a, 1, 1).alias("a")))

    def sized(r):
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(r))).cast("int"))
        return F.struct(r.alias("rows"), F.transform(r, lambda x: F.length(x["g"]) + F.length(x["m"])).alias("sizes"), block.alias("block"))

    def summed(x):
        blocks = F.sequence(F.lit(0), (F.size(x["rows"]) / x["block"]).cast("int"))
        sums = F.transform(blocks, lambda j: _sum(F.slice(x["sizes"], j * x["block"] + 1, x["block"])))
        return F.struct(x["rows"].alias("rows"), x["sizes"].alias("sizes"), x["block"].alias("block"), sums.alias("sums"))

    def offset(x):
        offsets = F.transform(x["sums"], lambda _, j: _sum(F.slice(x["sums"], F.lit(1), j)))
        return F.struct(x["rows"].alias("rows"), x["sizes"].alias("sizes"), x["block"].alias("block"), offsets.alias("offsets"))

    def placed(x):
        def one(r, k):
            own = (k / x["block"]).cast("int")
            start = F.get(x["offsets"], own) + _sum(F.slice(x["sizes"], own * x["block"] + 1, k % x["block"])) + F.length(r["g"])
            return describe(r, start)

        return F.transform(x["rows"], one)

    raw = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    all_ = _let(raw, lambda a: _let(rows(a), lambda b: _let(sized(b), lambda c: _let(summed(c), lambda d: _let(offset(d), placed)))))
    fields = ",".join(f"{n}:int" if n != "base" else "base:boolean" for n in ("kind", "s", "e", "base", *[f for f in FEATURES if f != "kind"]))
    return F.when(text.rlike(gate), all_).otherwise(F.array().cast(f"array<struct<{fields}>>"))


def proposed(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, ``others`` and ``found``, the candidates of all kinds: by kind, base before generated, then by start."""
    text = F.col("_text")
    lists = []
    for kind in KINDS:
        if kind in BASE:
            lists.append(candidates(text, kind, BASE[kind], GATE[kind], True))
        lists.append(candidates(text, kind, MORE[kind], MORE_GATE[kind], False))
    return docs.select("doc_id", *others, text_or_empty().alias("_text")).select("doc_id", *others, F.concat(*lists).alias("found"))


# --- examples to learn from --------------------------------------------------------------------------------------------

#: Makers of examples: each has words, cues and forms of its own. Trees learn from the first two, thresholds from the third, and the
#: last is for measuring alone.
MAKERS = 4
LEARN, CALIBRATE, MEASURE = (0, 1), (2,), (3,)
NAMES = (("anna", "j.doe", "info", "maria_k"), ("b.smith77", "sales", "pierre", "lopez"), ("k-huber", "office", "tom.w", "rita99"), ("zoe.m", "support", "hans_p", "c.ito"))
HOSTS = (("example", "mail7"), ("uni-west", "acme", "posteo9"), ("webhost", "kontor"), ("blue-sky", "inbox3", "stadt"))
ENDS = (("com", "org"), ("net", "de"), ("co", "fr", "info"), ("es", "io", "eu"))
WORDS = (("the", "river", "and", "stone", "green", "over"), ("la", "und", "window", "que", "again", "small"), ("el", "haus", "paper", "with", "les", "late"), ("into", "der", "noche", "we", "table", "sous"))
CUE_WORDS = (
    {"email": ("mail", "contact"), "ip": ("host", "ip"), "card": ("card", "visa"), "phone": ("tel.", "call"), "secret": ("export", "config")},
    {"email": ("write to", "e-mail:"), "ip": ("server", "address"), "card": ("pay by", "card no"), "phone": ("phone", "fax"), "secret": ("login", "set")},
    {"email": ("courriel", "contact:"), "ip": ("addr", "host is"), "card": ("karte", "payment"), "phone": ("mobile", "telephone"), "secret": ("env", "auth")},
    {"email": ("correo", "mailto"), "ip": ("servers", "ip:"), "card": ("tarjeta", "paying"), "phone": ("telefon", "fon"), "secret": ("config:", "authorize")},
)
LOOKALIKE_WORDS = (("order", "part", "item"), ("ref.", "invoice no.", "section"), ("serial", "version", "isbn"), ("tracking", "figure", "sku"))


def plants(spark: SparkSession, n: int, seed: int = 1, makers: tuple = LEARN) -> DataFrame:
    """doc_id, text, kind (place in KINDS), personal (0, 1), s, e, maker: lines with an item at s to e that is personal data, or looks
    like it; made by the given makers in turn."""

    def draw(k, size):
        return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(size)).cast("int")

    def pick(k, *values):
        return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), draw(k, len(values)) + 1)

    def digits(k, size):  # the first one isn't 0
        more = F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k + 1000)), F.lit(10 ** (size - 1))).cast("string")
        return F.concat((draw(k, 9) + 1).cast("string"), F.lpad(more, size - 1, "0")) if size > 1 else (draw(k, 9) + 1).cast("string")

    def grouped(number, by):
        return F.concat(F.substring(number, 1, 4), F.lit(by), F.substring(number, 5, 4), F.lit(by), F.substring(number, 9, 4), F.lit(by), F.substring(number, 13, 4))

    def put(template, *values):
        """The template, with a value at each %."""
        parts = template.split("%")
        return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))])

    octets = [draw(20 + k, 254).cast("string") for k in range(4)]
    over = [octets[0], (draw(24, 600) + 260).cast("string"), *octets[2:]]
    stem = digits(30, 15)
    card = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(stem, d.cast("string"))), lambda x: F.call_function("luhn_check", x)), 1)
    other = digits(31, 16)
    tel = [digits(50, 3), digits(51, 3), digits(52, 4)]
    hexes = F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{seed}")), 256)
    long_ = F.substring(F.base64(hexes), 1, 32)
    key = pick(60, "token", "secret", "password", "api_key", "access-key", "db_pwd")
    word = pick(61, "required", "yes-please", "see_below", "optional", "configuration", "version-2", "none-given")
    kind, is_personal, cue = draw(2, len(KINDS)), draw(1, 2) == 1, draw(3, 3)

    def lines(maker):
        """item, head and tail of a maker's lines."""
        name, host, end = pick(40, *NAMES[maker]), pick(41, *HOSTS[maker]), pick(42, *ENDS[maker])
        at = (("%@%.%", "% [at] % [dot] %"), ("%(at)%.%", "% at % dot %"), ("% {at} % {dot} %", "%[at]%.%", "%@%.%"), ("% AT % DOT %", "% (at) %.%", "%@%.%"))[maker]
        dotted = (("%.%.%.%", "%[.]%[.]%[.]%"), ("%[dot]%[dot]%[dot]%", "% . % . % . %"), ("%(.)%(.)%(.)%", "%.%.%.%", "% . % . % . %"), ("%[.]%[.]%[.]%", "%(.)%(.)%(.)%"))[maker]
        by = (" .", "/.", "_ .", "_/")[maker]
        call = (("+1 (%) %-%", "(%) %-%"), ("%.%.%", "001-%-%-%"), ("0049 % % %", "% % %", "+44 % % %"), ("0033.%.%.%", "%-%-%"))[maker]
        assigned = (('% = "%"', F.substring(hexes, 1, 40)), ("%: %", long_), ("%=%", F.substring(hexes, 1, 24)), ("%='%'", F.concat(F.substring(hexes, 3, 9), F.lit("-"), F.substring(long_, 5, 12))))[maker]
        personal = {
            "email": [put(x, name, host, end) for x in at],
            "ip": [put(x, *octets) for x in dotted],
            "card": [card, *[grouped(card, x) for x in by]],
            "phone": [put(x, *tel) for x in call],
            "secret": [put(assigned[0], key, assigned[1])],
        }
        near = (("% at % dot matrix", "look at % dot number"), ("% at % dot paper", "%@home"), ("% at % dot printing", "point at % dot by dot"), ("% AT % DOT MATRIX", "smile at % dot chart"))[maker]
        lookalike = {
            "email": [put(x, *[name, host][2 - x.count("%") :]) for x in near],
            "ip": [put(x, *over) for x in dotted],
            "card": [other, *[grouped(other, x) for x in by], digits(32, 12)],
            "phone": [*[put(x, *tel) for x in call if not x.startswith(("+", "00"))], F.concat_ws("- ."[maker % 3], *tel), F.concat(F.lit("+"), digits(53, 5))],
            "secret": [put(x, key, word) for x in (("%: %", '% = "%"'), ("%=%", "%: %"), ('%="%"', "%: %"), ("%='%'", "% = %"))[maker]],
        }
        forms = [F.when(is_personal, pick(100 + k, *personal[x])).otherwise(pick(200 + k, *lookalike[x])) for k, x in enumerate(KINDS)]
        cues = [pick(300 + k, *CUE_WORDS[maker][x]) for k, x in enumerate(KINDS)]
        prose = [F.concat_ws(" ", *[pick(400 + 20 * side + k, *WORDS[maker]) for k in range(6)]) for side in range(2)]
        # A third to a half of the lines have no cue. Lookalikes have a misleading one more often than a true one, personal data never.
        right = F.concat(F.element_at(F.array(*cues), kind + 1), F.lit(" "))
        wrong = F.concat(pick(500, *LOOKALIKE_WORDS[maker]), F.lit(" "))
        # Numbers in groups like a telephone's are told from one by such a word alone.
        alike = ~is_personal & (kind == KINDS.index("phone"))
        said = F.when(alike, wrong).when(cue == 0, "").when(is_personal | ((cue == 1) & (draw(4, 3) == 0)), right).when(cue == 1, wrong).otherwise("")
        return F.struct(F.element_at(F.array(*forms), kind + 1).alias("item"), F.concat(prose[0], F.lit(" "), said).alias("head"), prose[1].alias("tail"))

    maker = F.element_at(F.array(*[F.lit(m) for m in makers]), draw(5, len(makers)) + 1)
    one = reduce(lambda rest, m: F.when(maker == m, lines(m)).otherwise(rest), makers[1:], lines(makers[0]))
    made = spark.range(n).select(F.col("id").alias("doc_id"), kind.alias("kind"), is_personal.cast("int").alias("personal"), maker.alias("maker"), one.alias("x"), pick(600, " ", ", ", ". ", "\n").alias("gap"))
    start = F.length("x.head")
    return made.select("doc_id", F.concat("x.head", "x.item", "gap", "x.tail").alias("text"), "kind", "personal", start.alias("s"), (start + F.length("x.item")).alias("e"), "maker")


def labelled_candidates(examples: DataFrame, *others: str) -> DataFrame:
    """doc_id, the candidate's features, s, e, base, and whether it is of the kind of a personal item of which it has more than half."""
    item = examples.select("doc_id", "text", *others, *[F.col(n).alias(f"_{n}") for n in ("kind", "personal", "s", "e")])
    one = proposed(item, *others, "_kind", "_personal", "_s", "_e").withColumn("c", F.explode("found")).select("doc_id", *others, "_kind", "_personal", "_s", "_e", "c.*")
    common = F.least("e", "_e") - F.greatest("s", "_s")
    same = (F.col("kind") == F.col("_kind")) & (2 * common > F.col("_e") - F.col("_s"))
    return one.withColumn("positive", F.when(same, F.col("_personal")).otherwise(0))


# --- boosted trees -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """A split, and under each side another one or a value: (feature, threshold, low, high), where low takes values <= threshold."""

    feature: str
    threshold: int
    low: Tree | float
    high: Tree | float

    def value(self, row: dict) -> float:
        side = self.low if row[self.feature] <= self.threshold else self.high
        return side.value(row) if isinstance(side, Tree) else side

    def column(self, row: Column) -> Column:
        low, high = (s.column(row) if isinstance(s, Tree) else F.lit(s) for s in (self.low, self.high))
        return F.when(row[self.feature] <= self.threshold, low).otherwise(high)


def _grow(rows: list[dict], depth: int) -> Tree | float:
    """The tree of largest gain in the second-order loss; rows carry their summed gradient ``g`` and hessian ``h``."""
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    best = (1e-6, None)
    for name, size in FEATURES.items() if depth else ():
        by = [[0.0, 0.0] for _ in range(size)]
        for r in rows:
            own = by[r[name]]
            own[0] += r["g"]
            own[1] += r["h"]
        gl = hl = 0.0
        for cut in range(size - 1):
            gl, hl = gl + by[cut][0], hl + by[cut][1]
            gain = gl * gl / (hl + LEAST_HESSIAN) + (g - gl) ** 2 / (h - hl + LEAST_HESSIAN) - g * g / (h + LEAST_HESSIAN)
            if gain > best[0] and hl > 0 and h - hl > 1e-12:
                best = (gain, (name, cut))
    if best[1] is None:
        return -RATE * g / (h + LEAST_HESSIAN)
    name, cut = best[1]
    return Tree(name, cut, _grow([r for r in rows if r[name] <= cut], depth - 1), _grow([r for r in rows if r[name] > cut], depth - 1))


def boost(counts: list[dict]) -> tuple[float, list[Tree | float]]:
    """Log-odds to start from, and trees; ``counts`` has n and positives of each combination of features."""
    total, positive = sum(r["n"] for r in counts), sum(r["positive"] for r in counts)
    start = math.log((positive + 0.5) / (total - positive + 0.5))
    rows = [dict(r, f=start) for r in counts]
    trees: list[Tree | float] = []
    for _ in range(ROUNDS):
        for r in rows:
            p = 1 / (1 + math.exp(-r["f"]))
            r["g"], r["h"] = r["n"] * p - r["positive"], r["n"] * p * (1 - p)
        tree = _grow(rows, DEPTH)
        if not isinstance(tree, Tree):
            break
        trees.append(tree)
        for r in rows:
            r["f"] += tree.value(r)
    return start, trees


def calibrate(counts: list[dict], start: float, trees: list) -> list[float]:
    """For each kind, the log-odds from which on ``PRECISION`` of the counted candidates are positive: the least at which that holds, and
    at which the candidates just there are more often right than not. Without any such, nothing is accepted."""
    out = []
    for kind in range(len(KINDS)):
        by_score: dict[float, list[int]] = {}
        for r in (r for r in counts if r["kind"] == kind):
            own = by_score.setdefault(round(start + sum(t.value(r) for t in trees), 9), [0, 0])
            own[0], own[1] = own[0] + r["n"], own[1] + r["positive"]
        scored = sorted(((score, *own) for score, own in by_score.items()), reverse=True)
        n = positive = accepted = 0
        for k, (_, more, yes) in enumerate(scored):
            n, positive = n + more, positive + yes
            if positive >= PRECISION * n and 2 * yes > more:
                accepted = k + 1
        if not accepted:
            out.append(math.inf)
        elif accepted == len(scored):
            out.append(scored[-1][0])
        else:  # halfway to the best score that isn't accepted
            out.append((scored[accepted - 1][0] + scored[accepted][0]) / 2)
    return out


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple
    thresholds: tuple

    def accepts(self, row: Column) -> Column:
        score = reduce(lambda a, t: a + t.column(row), self.trees, F.lit(self.start))
        at = F.element_at(F.array(*[F.lit(t) for t in self.thresholds]), row["kind"] + 1)
        return score >= at


_models: dict[tuple[int, int], Model] = {}


def fit(spark: SparkSession, n: int = PLANTS, seed: int = 1) -> Model:
    """Trees from two thirds of ``n`` examples, thresholds from the others, which are by another maker. No table is read for it, so a model is
    fit once for each ``n`` and ``seed`` of an application."""
    if (n, seed) not in _models:
        own = plants(spark, n - n // 3, seed, LEARN).unionByName(plants(spark, n // 3, seed + 1, CALIBRATE))
        one = labelled_candidates(materialise(own.withColumn("held", F.col("maker").isin(*CALIBRATE)), "pii-plants"), "held")
        counted = one.groupBy("held", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("positive").alias("positive"))
        counts = sorted((r.asDict() for r in counted.collect()), key=lambda r: [r[f] for f in FEATURES])  # a few for each example at most
        start, trees = boost([r for r in counts if not r["held"]])
        _models[n, seed] = Model(start, tuple(trees), tuple(calibrate([r for r in counts if r["held"]], start, trees)))
    return _models[n, seed]


# --- spans -------------------------------------------------------------------------------------------------------------


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])

    def one(c):
        return F.concat(F.element_at(names, c["kind"] + 1), F.lit(":"), c["s"].cast("string"), F.lit(":"), c["e"].cast("string"))

    return F.array_join(F.transform(spans, one), ",")


def find(docs: DataFrame, model: Model | None = None, *others: str) -> DataFrame:
    """doc_id, ``others``, base (spans of the base rules), spans (with those the model adds); arrays of kind, s, e in order."""
    model = model or fit(docs.sparkSession)
    split = proposed(docs, *others).select(
        "doc_id",
        *others,
        F.filter("found", lambda c: c["base"] & (c["valid"] == 1)).alias("base"),
        F.filter("found", lambda c: ~(c["base"] & (c["valid"] == 1)) & model.accepts(c)).alias("more"),
    )
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))
    free = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("base", plain), F.transform(free, plain))))
    return split.select("doc_id", *others, F.transform("base", plain).alias("base"), F.when(F.size("more") == 0, F.transform("base", plain)).otherwise(every).alias("spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets; overlapping spans become one."""
    found = find(docs.select("doc_id", text_or_empty().alias("text")), model, "text")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))

    def step(acc, c):
        gap = F.when(c["s"] >= acc["at"], F.concat(acc["out"], F.substr("text", acc["at"] + 1, c["s"] - acc["at"]), F.element_at(names, c["kind"] + 1))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], c["e"]).alias("at"), gap.alias("out"))

    state = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    done = found.select("doc_id", "text", state.alias("r"))
    return done.select("doc_id", F.concat(F.col("r")["out"], F.substr("text", F.col("r")["at"] + 1, F.length("text"))).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda c: c["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS) if name in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
