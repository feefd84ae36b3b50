"""Importance resampling towards a target distribution.

A text's features are its runs of one to three words, hashed to buckets. A bucket's gain is the logarithm of its
smoothed share in the target over that in the corpus, in thousandths; a text's weight is the sum over its features.
With Gumbel noise from a hash of the id, the largest scores are a sample without replacement in proportion to exp(weight).

Two passes of array work read the texts: the first counts buckets in tasks, the second sums gains. The scores are
then put in order by a distributed radix sort, least significant digit first. The composite key is
(largest score first, smallest id first), and its digits are DIGIT bits each:

1. rows have a place; BLOCK places in a row are a block;
2. the rows of each block and digit are counted, and prefix sums over (digit, block) give where each such run begins;
3. a row's next place is that plus its rank by place within its run. Equal digits keep their order.

After the last digit a row's place is its rank. No task holds more than the rows of one digit in one block, and all
that the driver sees are the counts of 2**DIGIT digits. Each pass is a written table.

Defined cases: null and empty texts and texts without words have no features and weight 0; a row with a null id counts
in the corpus, has no score and is not drawn; repeated rows and equal ids are rows of their own, in any order among
themselves if score and id are equal; an empty table, or an empty target, gives no error (all shares are smoothed); other
columns are ignored. A long text is worked on in spans, whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstream.llm import crc
from tillstream.llm.spans import joined, spans, words
from tillstream.llm.tables import forget, kept, table

BUCKETS = 10_000
#: Bits of a digit; bits of a place within a block.
DIGIT, BLOCK = 12, 17
#: Digits, lower-cased letters and all that is no ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_RAW = WORD | np.isin(np.arange(256), np.arange(65, 91))  # before lower-casing


def features(batch: pa.RecordBatch, longest: int = 3) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts [first, first + n): the text and the bucket of each feature, and the text of each word."""
    for s in spans(batch, _RAW, longest - 1):
        t = s.lower()
        start, end, row = words(t, WORD)
        if not len(start):
            yield s.first, s.n, row, row, row
            continue
        data, at = joined(t, start, end)
        size = (end - start).astype(np.int64)
        known, which = crc.distinct(data, at, size)
        spaced = known.to_pylist()  # each with its space behind
        own = np.fromiter((zlib.crc32(w[:-1]) for w in spaced), np.uint32, len(spaced))[which]
        behind = np.fromiter((zlib.crc32(b" " + w[:-1]) for w in spaced), np.uint32, len(spaced))[which]
        new = start >= s.lead
        rows, sums, run = [row[new]], [own[new]], own
        for k in range(1, longest):
            run = crc.carried(run[:-1], size[k:] + 1) ^ behind[k:]  # of the k + 1 words that begin here
            ok = (row[: len(run)] == row[k:]) & new[k:]
            rows.append(row[k:][ok])
            sums.append(run[ok])
        yield s.first, s.n, np.concatenate(rows), np.concatenate(sums) % BUCKETS, row[new]


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, _, bucket, _ in features(b):
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in rows.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, in thousandths of a natural logarithm, rounded down."""
    all_s, all_t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_s / ((float(s) + 1) * all_t))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(doc_id: int, seed: int = 42) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    names = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for first, n, row, bucket, own in features(b):
                at = slice(first, first + n)
                n_words[at] += np.bincount(own, minlength=n)
                n_features[at] += np.bincount(row, minlength=n)
                order = np.argsort(row, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
                weight[at] += sums[cut[1:]] - sums[cut[:-1]]
            ids = b.column(0).to_pylist()
            score = [None if i is None else w + noise(i) for i, w in zip(ids, weight.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n_words, n_features, weight)), pa.array(score, pa.int64())], names=[x.split()[0] for x in names.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, names)


def radix_sorted(rows: DataFrame, digits: list, digit_bits: int = DIGIT, block_bits: int = BLOCK) -> DataFrame:
    """rows with `place`: 0, 1, 2, ... in the order of a key whose digits are given, the least significant first, as Columns of
    0 to 2**digit_bits - 1. Stable. Files of the last pass stay."""
    spark = rows.sparkSession
    now = kept(rows.withColumn("place", F.monotonically_increasing_id()), "digits")  # ascending within a task: blocks are small
    for digit in digits:
        placed = now.withColumn("digit", digit).withColumn("block", F.shiftright("place", block_bits))
        counts = placed.groupBy("digit", "block").agg(F.count("*").alias("c"))
        counts = kept(counts, "digit-counts")
        begin, bases = 0, []
        for d, c in sorted((r[0], r[1]) for r in counts.groupBy("digit").agg(F.sum("c")).collect()):  # 2**digit_bits rows at most
            bases.append((d, begin))
            begin += c
        base = F.broadcast(spark.createDataFrame(bases, "digit long, base long"))
        before = F.sum("c").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        begins = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(base, "digit").select("digit", "block", (F.col("base") + F.col("before")).alias("begin"))
        rank = F.row_number().over(Window.partitionBy("digit", "block").orderBy("place"))
        moved = placed.withColumn("rank", rank).join(begins, ["digit", "block"]).withColumn("place", F.col("begin") + F.col("rank") - 1)
        old, now = now, kept(moved.select(*rows.columns, "place"), "digits")
        forget(old, counts)
    return now


def digits_of(value, low: int, high: int, digit_bits: int = DIGIT) -> list:
    """The digits of a long column that lies in [low, high], least significant first."""
    width = (high - low).bit_length()
    v = value - F.lit(low) if width < 64 else value.bitwiseXOR(F.lit(-(1 << 63)))  # ordered as unsigned
    return [F.shiftrightunsigned(v, k).bitwiseAND((1 << digit_bits) - 1) for k in range(0, width, digit_bits)]


def drawn(rows: DataFrame, percent: int = 5, least_words: int = 20, digit_bits: int = DIGIT, block_bits: int = BLOCK) -> DataFrame:
    """rows of `scored` with `rank`: of those with enough words the largest scores, that many in a hundred, ties to the smaller id."""
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    able = F.coalesce(able, F.lit(False))
    n, s0, s1, d0, d1 = rows.where(able).agg(F.count("*"), F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id")).first()
    none = F.lit(None).cast("long").alias("rank")
    if not n:
        return rows.select("*", none)
    digits = digits_of(F.col("doc_id"), d0, d1, digit_bits) + digits_of(F.lit(s1) - F.col("score"), 0, s1 - s0, digit_bits)
    ordered = radix_sorted(rows.where(able), digits or [F.lit(0).cast("long")], digit_bits, block_bits)
    rank = F.when(F.col("place") < percent * n // 100, F.col("place") + 1).alias("rank")
    return ordered.select(*rows.columns, rank).unionByName(rows.where(~able).select("*", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of each row. docs and target have a text."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return drawn(kept(scored(docs, gain), "scored"), percent, least_words)


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
