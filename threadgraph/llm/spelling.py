"""Spelling variants: words within one edit of one another, by forward and reversed sorted dictionaries.

1. Runs of letters are counted (DataFrame functions, combined before the shuffle); words that are long and frequent enough are the
   dictionary.
2. One edit between a word of ``m`` letters and one of ``m`` or ``m + 1`` lies behind the first ``m // 2`` letters, which are then
   shared as a prefix, or among them, and then the letters after them are shared as a suffix. So each word stands twice (as the
   shorter and as the longer one) in a dictionary sorted by prefixes and in one sorted by reversed suffixes; words that share the
   key are a block.
3. Blocks are counted. One with more than ``BLOCK`` words is subdivided in the same way: of the letters between the shared prefix
   and suffix either the first half is shared as well, or the second; and so on until one letter is left between them, where
   distinct words are few by themselves. A word is in 2 blocks for each of its letters at most.
4. Dictionaries are range-partitioned and sorted, and a scan compares the words of each block. A pair belongs to the block whose
   gap holds the place where the two words part, so it is found once. Nothing but pairs that are near is emitted.
5. The most frequent near word becomes a word's form if it is frequent enough; roots come by pointer jumping over forms.

Defined results: null and empty texts have no words; a null doc_id stands as an empty string before the colon, so rows without one
lose the same letters; rows that repeat a doc_id or a text count each; texts and runs of any length are read whole; ties between
near words go to the one first in code-point order; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, lower_ascii, materialise, table, text_or_empty
from .crc_sql import CRC_TABLE, crc32

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
DROP_EVERY = 199
BLOCK = 64
BLOCK_SCHEMA = "block string, word string, n long, m int, p int, q int"
MAX_ROUNDS = 64


def counted_words(docs: DataFrame, drop_every: int = DROP_EVERY, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the dictionary. Runs with fewer letters can't become words, as letters are only taken away."""
    found = F.regexp_extract_all(text_or_empty(), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(found).alias("run"))
    runs = runs.select(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":")).alias("head"), lower_ascii(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("head", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Blocks of words with m letters (or m + 1) that share their first p and last q letters."""
    reverse = F.reverse("word")
    key = F.concat_ws(":", "m", "p", "q", F.substring("word", F.lit(1), F.col("p")), F.substring(reverse, F.lit(1), F.col("q")))
    return rows.select(key.alias("block"), "word", "n", "m", "p", "q")


def _halves(p: Column, q: Column) -> Column:
    """The two ways in which a block is subdivided: (p, q) of each."""
    gap = F.col("m") - p - q
    half = F.floor(gap / 2).cast("int")
    return F.array(F.struct((p + half).alias("p"), q.alias("q")), F.struct(p.alias("p"), (q + gap - half).alias("q")))


def dictionaries(words: DataFrame, least_letters: int = LEAST_LETTERS, block: int = BLOCK) -> DataFrame:
    """Rows of all blocks, none of which is larger than ``block`` unless just one letter is between its prefix and suffix."""
    length = F.length("word")
    none = F.lit(0)
    roles = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(F.col("m") >= least_letters)
    rows = _keyed(roles.select("word", "n", "m", F.explode(_halves(none, none)).alias("x")).select("word", "n", "m", "x.p", "x.q"))
    settled = None
    for _ in range(MAX_ROUNDS):
        rows = materialise(rows, "spelling-blocks")
        sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
        crowded = sizes.where(F.col("size") > block).withColumn("crowded", F.lit(True))
        marked = materialise(join_hot(rows, crowded, "block", "size", rows.count()), "spelling-marked")
        divide = F.col("crowded").isNotNull() & (F.col("m") - F.col("p") - F.col("q") > 1)
        done = marked.where(~divide).drop("crowded")
        settled = done if settled is None else settled.unionByName(done)
        more = marked.where(divide)
        if more.isEmpty():
            return settled
        more = more.select("word", "n", "m", F.explode(_halves(F.col("p"), F.col("q"))).alias("x")).select("word", "n", "m", "x.p", "x.q")
        rows = _keyed(more)
    raise RuntimeError(f"blocks did not settle in {MAX_ROUNDS} rounds")


def parting(short: str, long: str, at: int) -> int:
    """Where two words that agree up to ``at`` part, if they are one edit apart, else -1. ``long`` has as many letters, or one more."""
    m = len(short)
    while at < m and short[at] == long[at]:
        at += 1
    same = short[at + 1 :] == long[at + 1 :] if len(long) == m else short[at:] == long[at + 1 :]
    return at if same else -1


def _pairs_of(words: list[str], counts: list[int], m: int, p: int, q: int):
    shorter = [(w, n) for w, n in zip(words, counts, strict=True) if len(w) == m]
    longer = [(w, n) for w, n in zip(words, counts, strict=True) if len(w) > m]
    end = m - q if q else m + 1
    for k, (w, n) in enumerate(shorter):
        for other, other_n in shorter[k + 1 :] + longer:
            if p <= parting(w, other, p) < end:
                yield w, other, other_n
                yield other, w, n


def _scan(batches):
    """Near pairs of each block of rows that come sorted by block; a block is a bounded number of rows."""
    import pyarrow as pa

    now, words, counts, shape, out = None, [], [], (0, 0, 0), []

    def batch():
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "other", "other_n"])

    for rows in batches:
        for block, word, n, m, p, q in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            if block != now:
                if len(words) > 1:
                    out.extend(_pairs_of(words, counts, *shape))
                now, words, counts, shape = block, [], [], (m, p, q)
            words.append(word)
            counts.append(n)
        yield batch()
        out = []
    if len(words) > 1:
        out.extend(_pairs_of(words, counts, *shape))
    yield batch()


def near_pairs(words: DataFrame, least_letters: int = LEAST_LETTERS, block: int = BLOCK) -> DataFrame:
    """word, other, other_n: both orders of each pair of words one edit apart."""
    rows = dictionaries(words, least_letters, block)
    return rows.repartitionByRange("block").sortWithinPartitions("block", "word").mapInArrow(_scan, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of each row of forms (word, form): where its chain of forms ends. Chains have no cycles, as counts grow along them."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(MAX_ROUNDS):
        up = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialise(now.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if moved.where("moved").isEmpty():
            return now
        now = moved.drop("moved")
    raise RuntimeError(f"roots did not settle in {MAX_ROUNDS} rounds")


def variants(docs: DataFrame, ratio: int = RATIO, block: int = BLOCK, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the dictionary."""
    words = materialise(counted_words(docs, **counting), "spelling-words")
    pairs = near_pairs(words, counting.get("least_letters", LEAST_LETTERS), block)
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    found = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(found, "word", "left")
    takes = -F.col("best.n") >= ratio * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.n")).alias("form_n"))
    joined = materialise(joined, "spelling-forms")
    ends = roots(joined.where("form is not null").select("word", "form"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: Words that lose the same letter of the same place, or one of which is the other less a letter.
SQL = f"""
WITH RECURSIVE c AS ({CRC_TABLE}), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{{{LEAST_LETTERS},}}}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT d, run, count(*) AS n FROM runs GROUP BY d, run
), hashed AS (
  SELECT run, n, {crc32("(d || ':' || run)")} AS h FROM counted, c
), cut AS (
  SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), less AS (
  SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON b.rest = a.word
  UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON b.rest = a.word
), best AS (
  SELECT word, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= {RATIO} * w.n THEN b.other END AS form, CASE WHEN b.other_n >= {RATIO} * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.k = 1
), walk AS (
  SELECT word, word AS at, form AS further FROM forms
  UNION ALL
  SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON f.word = w.further
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.further IS NULL
""".replace("{{", "{").replace("}}", "}")
