"""Spelling variant grouping with a dictionary of trie-node pairs.

Words are counted over all texts. Each word is a path in a trie of the vocabulary and, read backwards, in a second one.
Two words that differ in one code point share a node of the first (what stands before it) and a node of the second (what
stands behind it). So each word enters, for each position i,

- the pair (prefix node i, suffix node i + 1), which skips its code point i, and
- the pair (prefix node i, suffix node i), into which another word may have a code point inserted.

Words with one skipping pair in common differ by a replacement there; a skipping pair of one that is an inserting pair of
another tells an insertion. Of the places where a repeated letter may be left out only the first counts, so that each
near pair is met once, and a pair's words differ in one letter: a group is no larger than the alphabet and one.
Groups are turned into counts and best forms at once; near pairs are never listed.

A node's number is 64 bits, from its parent's number and its letter. `numbered` writes the nodes as a table and makes
sure that each number has one parent and one letter only (else it starts anew with another seed); then, from the root on,
equal numbers are equal nodes, and the joins on integers are exact.

Defined cases: a null or empty text has no words; a null id is an empty text before the colon; repeated rows count each
time; an empty table gives no rows; other columns are ignored. A long text is worked on in spans, whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm import crc
from tillstream.llm.spans import joined, spans, words
from tillstream.llm.tables import Scratch, forget, kept, table
from tillstream.llm.textbytes import mix

#: Words of which a task counts occurrences before it hands them on.
HELD = 200_000
#: Letters of vocabulary words that are worked on at once.
LETTERS = 1 << 18
U64 = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # 0xC3 begins each of U+00C0 to U+00FF
_PART = np.zeros(256, bool)
_PART[0x80:0xC0] = True


def letter_runs(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the maximal runs of letters."""
    return words(t, _LETTER) if not (t.data == 0xC3).any() else _wide_runs(t)


def _wide_runs(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = _LETTER[t.data]
    inside[1:] |= (t.data[:-1] == 0xC3) & _PART[t.data[1:]]
    cut = np.zeros(len(inside) + 1, bool)
    cut[t.offsets] = True
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1] & ~cut[1:-1], inside[1:] & ~cut[1:-1]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, t.rows(starts)


def occurrences(docs: DataFrame, every: int = 199) -> DataFrame:
    """word, n: how often each word is found, one row for each task and more; of a run whose hash is a multiple of `every` a
    letter is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for b in batches:
            ids = [f"{'' if i is None else i}:".encode() for i in b.column(0).to_pylist()]
            head = np.fromiter((zlib.crc32(i) for i in ids), np.uint32, len(ids))
            for s in spans(b, _NOT_SPLIT):
                t = s.lower()
                start, end, row = letter_runs(t)
                if not len(start):
                    continue
                data, at = joined(t, start, end)
                size = (end - start).astype(np.int64)
                known, which = crc.distinct(data, at, size)
                known = [w[:-1] for w in known.to_pylist()]
                own = np.fromiter((zlib.crc32(w) for w in known), np.uint32, len(known))[which]
                h = crc.carried(head[s.first + row], size) ^ own
                odd = np.flatnonzero(h % every == 0)
                n = np.bincount(which, minlength=len(known)) - np.bincount(which[odd], minlength=len(known))
                for w, k in zip(known, n.tolist(), strict=True):
                    if k:
                        w = w.decode()
                        found[w] = found.get(w, 0) + k
                for k, w in zip(h[odd].tolist(), which[odd].tolist(), strict=True):
                    w = known[w].decode()
                    w = w[: k % len(w)] + w[k % len(w) + 1 :]
                    found[w] = found.get(w, 0) + 1
                if len(found) > HELD:
                    yield handed()
        yield handed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n bigint")


#: Long texts are cut at ASCII bytes that are no letters.
_NOT_SPLIT = np.ones(256, bool)
_NOT_SPLIT[[i for i in range(128) if not (65 <= i <= 90 or 97 <= i <= 122)]] = False


def vocabulary(docs: DataFrame, least: int = 6, often: int = 5) -> DataFrame:
    """word and n of the words with so many letters and occurrences at least."""
    n = occurrences(docs).where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))
    return n.where(F.col("n") >= often)


def _root(seed: int) -> np.uint64:
    return mix(np.array([seed], np.uint64))[0]


def _paths(code: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """The number of each letter's node: of the letters (of many words, one after another, `place` from 0 in each) from its
    word's first up to it. Step by step for short words; equal paths have equal numbers in every batch."""
    out = np.empty(len(code), np.uint64)
    order = np.argsort(place, kind="stable")
    cut = np.searchsorted(place[order], np.arange(int(place.max(initial=-1)) + 2))
    root = _root(seed)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        at = order[a:b]
        parent = out[at - 1] if a else root
        out[at] = mix(parent * U64(0x9FB21C651E98DF25) + code[at].astype(np.uint64) + U64(1))
    return out


def paths(vocab: DataFrame, seed: int) -> DataFrame:
    """n, ord, letters (code points), down and up: the numbers of its prefix and suffix nodes, from the empty one to the word."""
    names = ["n", "ord", "letters", "down", "up"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(w) for w in b.column(2).to_pylist()], np.int64)
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(np.cumsum(size[i:]), LETTERS, "right")) + i)
                part, n = b.slice(i, j - i), size[i:j]
                code = np.frombuffer("".join(part.column(2).to_pylist()).encode("utf-32-le"), np.uint32)
                first = np.cumsum(n) - n
                place = np.arange(len(code)) - np.repeat(first, n)
                turned = np.repeat(first + n - 1, n) - place  # where the letter stands in the word read backwards
                each = [np.insert(_paths(c, place, s), first, _root(s)) for c, s in ((code, seed), (code[turned], seed + 1))]
                cut, letters = (pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32)) for x in (n + 1, n))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.view(np.int64))) for x in each]
                codes = pa.ListArray.from_arrays(letters, pa.array(code.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), codes, *lists], names=names)
                i = j

    return vocab.select("n", "ord", "word").mapInArrow(run, "n bigint, ord bigint, letters array<int>, down array<bigint>, up array<bigint>")


def nodes(rows: DataFrame) -> DataFrame:
    """The two tries of `paths`: trie, node, its parent and letter (the least and the largest that a word gives it), how many words pass it."""
    out = None
    for name, letters in (("down", "letters"), ("up", "reverse(letters)")):
        step = F.expr(f"transform({letters}, (x, i) -> struct('{name}' as trie, {name}[i + 1] as node, {name}[i] as parent, x as letter))")
        part = rows.select(F.explode(step).alias("s")).select("s.*")
        out = part if out is None else out.unionByName(part)
    ends = [f(c).alias(f"{c}{k}") for c in ("parent", "letter") for k, f in ((0, F.min), (1, F.max))]
    return out.groupBy("trie", "node").agg(*ends, F.count("*").alias("words"))


def numbered(vocab: DataFrame, scratch: Scratch) -> DataFrame:
    """`paths` with a seed under which no two nodes have one number."""
    for seed in range(0, 20, 2):
        rows = scratch.kept(paths(vocab, seed), "paths")
        root = [int(_root(s).view(np.int64)) for s in (seed, seed + 1)]
        bad = nodes(rows).where((F.col("parent0") != F.col("parent1")) | (F.col("letter0") != F.col("letter1")) | F.col("node").isin(*root))
        if bad.isEmpty():
            return rows
        scratch.forget(rows)
    raise RuntimeError("no seed numbers the nodes apart")


def near(rows: DataFrame) -> DataFrame:
    """ord, n_near, and best: the near word of largest n, of these the smallest, as struct<m (its n, negative), ord>, for words that have some."""
    size = F.size("letters")
    skipped = F.expr("transform(letters, (x, i) -> struct(down[i] as p, up[size(letters) - i - 1] as s, x as letter, coalesce(get(letters, i - 1) != x, true) as first))")
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.get("down", i).alias("p"), F.get("up", size - i).alias("s"), F.lit(None).cast("int").alias("letter"), F.lit(True).alias("first")))
    keys = rows.select("ord", "n", F.explode(F.concat(skipped, whole)).alias("k")).select("k.p", "k.s", F.struct("k.letter", "k.first", (-F.col("n")).alias("m"), "ord").alias("w"))
    groups = keys.groupBy("p", "s").agg(F.collect_list("w").alias("ws")).where(F.size("ws") > 1)  # as many as letters, and one
    # an inserting pair meets the skipping ones of a repeated letter's first place; skipping pairs meet each other
    meets = F.expr("transform(ws, x -> struct(x.ord as ord, filter(ws, y -> y.ord != x.ord and (x.letter is not null or y.first) and (y.letter is not null or x.first)) as others))")
    each = groups.select(F.explode(meets).alias("g")).select("g.ord", "g.others").where(F.size("others") > 0)
    best = F.array_min(F.transform("others", lambda y: F.struct(y["m"].alias("m"), y["ord"].alias("ord"))))
    return each.select("ord", F.size("others").cast("long").alias("c"), best.alias("b")).groupBy("ord").agg(F.sum("c").alias("n_near"), F.min("b").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms ends; forms: word, form. Chains are halved in each round, and each step's n is
    a multiple of the one before, so rounds are few."""
    now = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.alias("a").join(now.select(F.col("word").alias("w"), F.col("root").alias("r")).alias("b"), F.col("a.root") == F.col("b.w"), "left")
        new = kept(on.select("a.word", F.coalesce("b.r", "a.root").alias("root"), F.col("b.r").isNotNull().alias("moved")), "roots")
        forget(now)
        done, now = new.where("moved").isEmpty(), new
        if done:
            return now.drop("moved")


def variants(docs: DataFrame, least: int = 6, often: int = 5, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words."""
    scratch = Scratch()
    # numbered in the order of code points: later steps move numbers only
    vocab = kept(vocabulary(docs, least, often).orderBy("word").withColumn("ord", F.monotonically_increasing_id()), "vocabulary")
    found = near(numbered(vocab, scratch)).join(vocab.select("ord", "n"), "ord")
    far = -F.col("best.m") >= times * F.col("n")
    found = kept(found.select("ord", "n_near", F.when(far, F.col("best.ord")).alias("form_ord"), F.when(far, -F.col("best.m")).alias("form_n")), "near")
    scratch.clear()
    names = vocab.select(F.col("ord").alias("form_ord"), F.col("word").alias("form"))
    rows = vocab.join(found, "ord", "left").join(names, "form_ord", "left")
    rows = kept(rows.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "forms")
    forget(vocab, found)
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
