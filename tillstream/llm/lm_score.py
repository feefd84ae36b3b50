"""LM scoring: byte contexts of up to six bytes counted over the corpus, next to a smoothed word unigram.

Training counts come from all texts whose crc32(doc_id) modulo `hold_out` is not 0: tasks count
their texts' context-symbol pairs and words, Spark adds them up. Every observed context stays in the
tables of `predictions`, one of each length, that grow with the corpus. An escape goes to the context
without its first byte, and excludes what was seen: resolved by joining each length with the next
shorter one, in which a row meets at most 256 longer ones.
Scoring reads each text once. The most frequent pairs (at most GRAMS of them) and the words that make
up a fixed share of all tokens (at most HEAVY) are sent along; a document's rarer ones, counted, are
joined with the tables, so that no common one gathers in one task. Pairs that were never
observed (held-out documents have some) are first resolved to the shorter contexts, each once.

Defined cases: a null or empty text is the end mark alone; repeated rows and ids are scored row by
row; a null id is not held out; if nothing is left to train on, all predictions are uniform and the
unigram gives probability 1 to everything; an empty table gives no rows; other columns are ignored.
A NUL byte in a context counts as a place before the text's start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm import ppm
from tillstream.llm.tables import forget, held_out, kept, table
from tillstream.llm.textbytes import Texts, chunks

HEAVY = 1 << 19
GRAMS = 1 << 20
SPAN = 4 << 20


def words_of(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of normalised texts: row of each token but the end marks, the distinct words (each with a space behind), and each token's number among them."""
    ends = np.flatnonzero((b == 32) | (b == ppm.END)) + 1
    begin = np.concatenate([[0], ends[:-1]])
    rows = np.searchsorted(offsets, begin, "right") - 1
    a = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(begin, len(b))), pa.py_buffer(np.where(b == ppm.END, 32, b).astype(np.uint8))])
    d = pc.dictionary_encode(a)
    which = d.indices.to_numpy()
    real = ends - begin > 1  # a text without words has the end mark only
    return rows[real], d.dictionary.cast(pa.binary()).cast(pa.string()), which[real]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in chunks(b, size=SPAN):
            _, words, which = words_of(*ppm.normalised(t))
            n = np.bincount(which, minlength=len(words))
            used = n > 0
            yield pa.RecordBatch.from_arrays([words.filter(pa.array(used)), pa.array(n[used])], names=["word", "n"])


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the task's byte keys, merged now and then so that few rows are shuffled."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["key", "n"])

    for batch in batches:
        for t in chunks(batch):
            held.append(np.unique(ppm.byte_keys(t)[0], return_counts=True))
            if len(held) >= 5:
                held = [_merged(held)]
            if len(held[0][0]) > 2_000_000:
                held = [_merged(held)]
                yield rows()
                held = []
    if held:
        held = [_merged(held)]
        yield rows()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _shorter(k: int) -> Column:
    """The key of a pair with the last k bytes of its context only."""
    return F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1).cast("long"))


def predictions(texts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each length of contexts: all observed pairs (key, n, p), and all observed contexts (ctx, all, escape, fall), where a
    pair that its context has not seen gets `fall` times what the next shorter context gives it."""
    counts = [kept(texts.select("text").mapInArrow(_key_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "grams")]
    for k in range(ppm.ORDER - 1, -1, -1):  # what a shorter context saw is what the longer ones did
        counts.insert(0, kept(counts[0].groupBy(_shorter(k).alias("key")).agg(F.sum("n").alias("n")), "grams"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, at in enumerate(counts):
        own = at.withColumn("ctx", F.shiftright("key", 8))
        low = own.withColumn("low", F.lit(1 / 256))
        if k:
            low = own.withColumn("tail", _shorter(k - 1)).join(out[-1][0].select(F.col("key").alias("tail"), F.col("p").alias("low")), "tail")
        each = low.groupBy("ctx").agg(F.sum("n").alias("all"), (F.count_if(F.col("n") == 1) + 0.5).alias("once"), F.count("*").alias("seen"), F.sum("low").alias("low"))
        each = each.withColumn("escape", F.when(F.col("seen") == 256, 0.0).otherwise(F.col("once") / (F.col("all") + F.col("once"))))
        nodes = kept(each.select("ctx", "all", "escape", (F.col("escape") / F.greatest(1 - F.col("low"), F.lit(1e-12))).alias("fall")), "contexts")
        pairs = kept(own.join(nodes, "ctx").select("key", "n", (F.col("n") / F.col("all") * (1 - F.col("escape"))).alias("p")), "pairs")
        out.append((pairs, nodes))
    forget(*counts)
    return out


def resolved(needed: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(key, p) of distinct keys, observed or not."""
    out = None
    for k, (pairs, nodes) in enumerate(levels):
        at = needed.select(_shorter(k).alias("key")).distinct().withColumn("ctx", F.shiftright("key", 8))
        at = at.join(pairs.select("key", "p"), "key", "left").join(nodes.select("ctx", "fall"), "ctx", "left")
        low = F.lit(1 / 256)
        if out is not None:
            at, low = at.withColumn("tail", _shorter(k - 1)).join(out.select(F.col("key").alias("tail"), F.col("p").alias("low")), "tail"), F.col("low")
        old, out = out, kept(at.select("key", F.coalesce("p", F.coalesce("fall", F.lit(1.0)) * low).alias("p")), "resolved")
        if old is not None:
            forget(old)
    return out


def _grams(b: np.ndarray, offsets: np.ndarray, common: ppm.Level, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each normalised text's log10 probability of its common pairs; the others as n + 1 offsets, keys and how often each."""
    z, rows, own, times = [], [], [], []
    for first, part, within in _parts(b, offsets):
        keys = ppm.keys(part, within)
        at = common.find(keys)
        total = np.concatenate([[0.0], np.cumsum(logs[at])])  # the last of logs is 0, for those not found
        z.append(total[within[1:]] - total[within[:-1]])
        lost = np.flatnonzero(at < 0)
        distinct, which = np.unique(keys[lost], return_inverse=True)
        pair, n = np.unique((np.searchsorted(within, lost, "right") - 1) << 32 | which, return_counts=True)
        rows.append((pair >> 32) + first)
        own.append(distinct[pair & (1 << 32) - 1])
        times.append(n)
    return np.concatenate(z), np.searchsorted(np.concatenate(rows), np.arange(len(offsets))).astype(np.int32), np.concatenate(own), np.concatenate(times)


def score(docs: DataFrame, hold_out: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = docs.where(~held_out(F.col("doc_id"), hold_out))
    levels = predictions(training)
    top = levels[-1][0]
    size = F.floor(F.log2("n") * 8).cast("int")
    many, least = 0, 1 << 10
    for r in top.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # at most 512 rows
        many += r["count"]
        if many > GRAMS:
            break
        least = r["size"]
    often = top.where(size >= least).select("key", "p").toArrow()  # at most GRAMS rows
    counts = kept(training.select("text").mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c")), "words")
    distinct, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = training.count()
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    norm = float(np.log10(tokens + 0.1 * (distinct + 1)))
    heavy = counts.where(F.col("c") * HEAVY >= tokens).toArrow()  # at most HEAVY rows
    given = spark.sparkContext.broadcast((often.column("key").to_numpy(), often.column("p").to_numpy(), heavy.column("word").combine_chunks().cast(pa.string()), heavy.column("c").to_numpy(), ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, p, common, c, ends = given.value
        grams, logs = ppm.Level(keys), np.append(np.log10(p), 0.0)
        weight, row_id = np.log10(c + 0.1), TaskContext.get().partitionId() << 40
        for b in batches:
            for t in chunks(b):
                text, offsets = ppm.normalised(t)
                rows, words, which = words_of(text, offsets)
                place = pc.fill_null(pc.index_in(words, value_set=common), -1).to_numpy()[which] if len(which) else which
                known = place >= 0
                n = np.bincount(rows, minlength=t.n) + 1
                base = np.bincount(rows[known], weights=weight[place[known]], minlength=t.n) + np.log10(ends + 0.1)
                n_known = np.bincount(rows[known], minlength=t.n) + (ends > 0)
                tail, times = np.unique(rows[~known] << 32 | which[~known], return_counts=True)
                cut = np.searchsorted(tail >> 32, np.arange(t.n + 1)).astype(np.int32)
                z, cut2, rest, seen = _grams(text, offsets, grams, logs)
                cols = [b.column(0).slice(t.first, t.n), pa.array(row_id + np.arange(t.n)), pa.array(n), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(z)]
                cols += [pa.ListArray.from_arrays(cut, words.take(pa.array(tail & (1 << 32) - 1))), pa.ListArray.from_arrays(cut, pa.array(times))]
                cols += [pa.ListArray.from_arrays(cut2, pa.array(rest)), pa.ListArray.from_arrays(cut2, pa.array(seen))]
                row_id += t.n
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_tokens", "n_known", "base", "score", "rare", "times", "keys", "seen"])

    fields = "doc_id bigint, row bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<string>, times array<bigint>, keys array<bigint>, seen array<bigint>"
    own = kept(docs.mapInArrow(run, fields), "scored")
    rare = own.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    found = rare.join(counts.where(F.col("c") * HEAVY < tokens), "word", "left")
    sums = found.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"))
    sums = kept(sums, "word-sums")
    forget(counts)
    pairs = own.select("row", "doc_id", F.explode(F.arrays_zip("keys", "seen")).alias("x")).select("row", "doc_id", F.col("x.keys").alias("key"), F.col("x.seen").alias("n"))
    # only held-out documents have pairs that were not observed
    needed = kept(pairs.where(held_out(F.col("doc_id"), hold_out)).select("key").distinct().join(top, "key", "left_anti"), "needed")
    last = resolved(needed, levels)
    forget(needed, *(t for level in levels for t in level if t is not top))
    all_pairs = top.where(size < least).select("key", "p").unionByName(last)
    rest = pairs.join(all_pairs, "key").groupBy("row").agg(F.sum(F.col("n") * F.log10("p")).alias("rest"))
    out = own.drop("rare", "times", "keys", "seen").join(sums, "row", "left").join(rest, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm
    return out.select("doc_id", held_out(F.col("doc_id"), hold_out).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))


def _parts(b: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Normalised texts in smaller runs: the number of the first, bytes and offsets."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 19), "right")) - 1)
        yield i, b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def op6_lm_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
