r"""Line dedup: a suffix array over line sequences by distributed prefix doubling.

Lines are the parts of a text between line feeds that hold a word; their id is the rank of their
content. The suffixes that start at each line are ranked by their first 1, 2, 4, ... lines: the pair
(rank of the first half, rank of the second half) is sorted and numbered anew. Suffixes of one rank
form an interval of the suffix array with that common prefix; a rank that only one suffix has cannot
be part of a repeated run, so it is dropped and later rounds handle repeated lines only.

Runs that two places share are intervals of equal ranks: n lines are known by the ranks of their first and
their last 2^k lines, 2^k <= n < 2^(k+1), so that an interval's common prefix is at least n lines long. A run counts
when it has at least `min_words` words. Any maximal repeated run is the union of the shortest counting runs that start,
and those that end, at its lines; so ranks of up to `min_words` lines tell all of them, and longer ones would
add none. Running sums of words give each line's two shortest runs. The earliest place of an interval (by
doc_id, then line) stays; those of all other places are merged into maximal runs, document by document, and these
are deleted. Where a later copy overlaps the first one in the same text, only the lines behind the first go.

All of it is DataFrame operations. Counts are aggregated before a shuffle and names come back by joins: see
`tables.named`; no group of equal lines is gathered. Each round is written to the shared folder, since ranks must not
change on recomputation. Only texts that change are shuffled: a bitmap of their keys (16 bits a document, 32 MB
at most; full ones let more texts through to the shuffle, no more) tells which.

Defined cases: lines compare without white space (space, 0x09-0x0D) at their ends; null and empty
texts have no lines and stay as they are; lines without a word are kept and don't part a run; rows
with equal doc_id and equal text are one document, treated alike; equal ids with different texts are
ordered by a hash of the text; a null id comes first; an empty table gives an empty one; columns of
other names are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstream.llm.tables import forget, kept, marked, named, table

MIN_WORDS = 20
_KEY = ["d", "k"]
_SPACE = r"[\x20\x09-\x0D]"


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("k", F.xxhash64("text"))


def lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: d, k (the document), p (its number among them), i (among all lines), two hashes, words."""
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, rf"\A{_SPACE}+|{_SPACE}+\z", "").alias("line")))
    rows = _key(docs.where(F.col("text").isNotNull()).select("doc_id", "text")).select(*_KEY, F.posexplode(F.filter(parts, lambda x: x["line"] != "")).alias("p", "x"))
    return rows.select(*_KEY, "p", "x.i", F.xxhash64("x.line").alias("h"), F.xxhash64(F.lit(1), "x.line").alias("g"), (F.regexp_count("x.line", F.lit(f"{_SPACE}+")) + 1).alias("w"))


def _ranks(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """The pairs that occur twice or more, with ascending numbers in the order of (a, b), and how often they do."""
    again = pairs.groupBy(a, b).agg(F.count("*").alias("times")).where("times > 1")
    # ids of a range-sorted table ascend with it; written at once, so that they are decided once
    return kept(again.repartitionByRange(a, b).sortWithinPartitions(a, b).withColumn(name, F.monotonically_increasing_id()), "line-ranks")


def doubled(docs: DataFrame, min_words: int) -> DataFrame:
    """The repeated lines with `r`: the ranks of their suffixes by the first 1, 2, 4, ... lines (null: not repeated)."""
    all_lines = lines(docs)
    again = kept(all_lines.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "line-counts")
    own = kept(named(all_lines, again, ["h"]).dropDuplicates([*_KEY, "p"]), "repeated-lines")
    first = _ranks(own, "h", "g", "rank")
    old, own = own, kept(named(own, first, ["h", "g"]).select(*_KEY, "p", "i", "w", F.array("rank").alias("r")), "line-suffixes")
    forget(old, first, again)
    size, at = 1, Window.partitionBy(*_KEY).orderBy("p")
    while 2 * size <= min_words:
        level = size.bit_length() - 1
        half = own.select("*", F.col("r")[level].alias("a"), F.first(F.col("r")[level]).over(at.rangeBetween(size, size)).alias("b"))
        ranks = _ranks(half.where("a is not null and b is not null"), "a", "b", "rank")
        if ranks.isEmpty():
            break
        old, own = own, kept(named(half, ranks, ["a", "b"], "left").select(*_KEY, "p", "i", "w", F.concat("r", F.array("rank")).alias("r")), "line-suffixes")
        forget(old, ranks)
        size *= 2
    return own


def runs(own: DataFrame, min_words: int) -> DataFrame:
    """The shortest counting runs that start or end at each repeated line: d, k, s and e (numbers of the first and
    last line among all lines of the text), n (lines with words), a and b (their names)."""
    doc = Window.partitionBy(*_KEY).orderBy("p")
    levels = min_words.bit_length()
    # lines that follow on one another have one `piece`; q: ranks of the 1, 2, 4, ... lines that end at a line
    q = [F.first(F.get("r", F.lit(k))).over(doc.rangeBetween(1 - (1 << k), 1 - (1 << k))) for k in range(levels)]
    rows = own.withColumns({"piece": F.col("p") - F.row_number().over(doc), "q": F.array(*q)})
    piece = Window.partitionBy(*_KEY, "piece")
    rows = rows.withColumn("upto", F.sum("w").over(piece.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("w"))
    # the last line before which fewer words lie than are asked for ends the shortest run, and likewise backwards
    ahead = F.last(F.struct("p", "i", "upto", "q")).over(piece.orderBy("before").rangeBetween(0, min_words - 1))
    behind = F.first(F.struct("p", "i", "before", "r")).over(piece.orderBy("upto").rangeBetween(1 - min_words, 0))
    rows = rows.withColumns({"ahead": ahead, "behind": behind})

    def run(first: Column, last: Column, words: Column, r: Column, q: Column, s: Column, e: Column) -> Column:
        n = last - first + 1
        level = F.floor(F.log2(n)).cast("int")
        return F.when(words >= min_words, F.struct(n.alias("n"), F.get(r, level).alias("a"), F.get(q, level).alias("b"), s.alias("s"), e.alias("e")))

    c = F.col
    starts = run(c("p"), c("ahead.p"), c("ahead.upto") - c("before"), c("r"), c("ahead.q"), c("i"), c("ahead.i"))
    ends = run(c("behind.p"), c("p"), c("upto") - c("behind.before"), c("behind.r"), c("q"), c("behind.i"), c("i"))
    both = rows.select(*_KEY, F.explode(F.array_distinct(F.array(starts, ends))).alias("x")).select(*_KEY, "x.*")
    return both.where("a is not null and b is not null")


def deleted(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, k and `gone`: the maximal later copies in each document that has some, as ascending (s, e): all lines with words from s to e go."""
    suffixes = doubled(docs, min_words)
    all_runs = kept(runs(suffixes, min_words), "line-runs")
    forget(suffixes)
    place, key = F.struct("d", "k", "s", "e"), ["n", "a", "b"]
    first = all_runs.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("times")).where("first != last").drop("last")
    first = kept(first, "first-runs")
    later = named(all_runs, first, key).where(place != F.col("first"))
    # lines of the first copy itself stay
    same = (F.col("d") == F.col("first.d")) & (F.col("k") == F.col("first.k"))
    later = later.withColumn("s", F.when(same, F.greatest("s", F.col("first.e") + 1)).otherwise(F.col("s"))).where("s <= e")
    order = Window.partitionBy(*_KEY).orderBy("s", "e")
    reached = later.select(*_KEY, "s", "e", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"))
    new = reached.withColumn("run", F.sum(F.when(F.col("s") <= F.col("reach") + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = new.groupBy(*_KEY, "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    out = kept(whole.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("gone")), "deleted-lines")
    forget(all_runs, first)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the later copies of repeated runs; n_lines, n_removed as last columns."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = _key(docs.select(*(F.col(c).alias(f"own_{c}") for c in keep), "doc_id", "text")).drop("doc_id", "text")
    gone = deleted(docs, min_words)
    told = marked(own, gone, *_KEY)
    joined = told.where("hit").join(gone, _KEY, "left")
    # a string of 0 (keep) and 1 (delete) up to the last deleted line, as an array: linear in the lines
    last = lambda j: F.coalesce(F.get(F.col("gone"), j - 1)["e"], F.lit(-1))
    flags = F.split(F.array_join(F.transform("gone", lambda x, j: F.concat(F.repeat(F.lit("0"), x["s"] - last(j) - 1), F.repeat(F.lit("1"), x["e"] - x["s"] + 1))), ""), "")
    parts = F.split("own_text", "\n", -1)
    stays = lambda v: (v["f"] == "0") | ~v["x"].rlike(r"[^\x20\x09-\x0D]")
    left = F.filter(F.transform(parts, lambda x, j: F.struct(x.alias("x"), F.coalesce(F.get(F.col("flags"), j), F.lit("0")).alias("f"))), stays)["x"]
    joined = joined.withColumn("flags", flags).withColumn("left", F.when(F.col("gone").isNotNull(), left))
    n = F.when(F.col("own_text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    names = lambda text: [text.alias("text") if c == "text" else F.col(f"own_{c}").alias(c) for c in keep]
    changed = joined.select(*names(F.coalesce(F.array_join("left", "\n"), F.col("own_text"))), n.alias("n_lines"), F.coalesce(n - F.size("left"), F.lit(0)).cast("long").alias("n_removed"))
    same = told.where("not hit").select(*names(F.col("own_text")), n.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return changed.unionByName(same)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same rule in plain SQL, by another way: all maximal runs that two places share, from equal lines on one diagonal. A
#: line goes if the words from the run's start on, up to the last line whose copy still lies before it, suffice.
ORACLE_SQL = r"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT doc_id, i, line, length(regexp_split_to_array(line, '[\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, i, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM parts) WHERE line <> ''
), l AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM worded
), diagonal AS (
  SELECT a.doc_id, b.doc_id AS other, a.p, a.p - b.p AS shift, a.p - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, a.p - b.p ORDER BY a.p) AS piece
  FROM l a JOIN l b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.p < a.p))
), maximal AS (
  SELECT doc_id, other, shift, min(p) AS s, max(p) AS e FROM diagonal GROUP BY doc_id, other, shift, piece
), gone AS (
  SELECT DISTINCT x.doc_id, x.i FROM maximal m JOIN l f ON f.doc_id = m.doc_id AND f.p = m.s JOIN l t ON t.doc_id = m.doc_id AND t.p = m.e AND t.c - f.c + f.w >= 20
    JOIN l x ON x.doc_id = m.doc_id AND x.p BETWEEN m.s AND m.e
    JOIN l y ON y.doc_id = m.doc_id AND y.p = CASE WHEN m.doc_id = m.other THEN least(m.e, x.p + m.shift - 1) ELSE m.e END
  WHERE y.c - f.c + f.w >= 20
), left_over AS (
  SELECT p.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(p.raw, chr(10) ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS text
  FROM parts p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN left_over x ON x.doc_id = d.doc_id
"""
