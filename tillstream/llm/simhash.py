"""SimHash near-dedup with bit-sliced comparison.

A text's fingerprint has a bit set if more than half of the 64-bit hashes of its shingles have it set. Fingerprints
that differ in at most `radius` bits link. Distinct fingerprints are the nodes:

1. The 64 bits are split into m blocks. Fingerprints within the radius agree in m - radius of them at least, so each
   one enters a bucket for each choice of m - radius blocks, by their bits. m grows with the number of fingerprints,
   and bits are folded while buckets would be smaller than MEMBERS; both change the work, never the result.
2. A bucket of more than TILE members is cut into chunks by hash, and each two chunks are a tile: a group of close
   copies, however large, is compared in blocks by many tasks.
3. A tile's fingerprints lie as 64 vertical bit planes, 64 members in a machine word. All its members are compared with
   all others at once: planes are xored with each query's bits and added into carry-save counters, four planes at a time;
   words whose members are all beyond the radius are abandoned.
4. A tile gives the stars of its components, never its pairs; these links make the components of all fingerprints.

Defined cases: null and empty texts and texts without words have fingerprint zero and link like any other; a text with
fewer words than a shingle has its whole sequence as one; repeated rows and ids are rows of their own; a row with a null
id has a fingerprint, links nothing and has a null component; an empty table gives no rows; other columns are ignored.
A long text is worked on in spans, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm.components import components
from tillstream.llm.spans import SPACED, joined, spans, words
from tillstream.llm.tables import Scratch, kept, named, table

#: Members of a bucket that are aimed at, and members of a tile at most (those of two chunks).
MEMBERS, TILE = 2048, 4096
#: Rows that are sent to all tasks at most.
BROADCAST_ROWS = 500_000
U64, ALL = np.uint64, np.uint64(0xFFFFFFFFFFFFFFFF)
LANES = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, 64): how many hashes of each row have each bit; rows ascend. Eight bits at a time lie in the bytes of a word,
    which hold the sums of up to 255 hashes."""
    out = np.zeros((n, 64), np.int64)
    if not len(h):
        return out
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    start = np.flatnonzero(place % 255 == 0)
    owner = rows[start]
    for k in range(8):
        sums = np.add.reduceat((h >> U64(k)) & LANES, start).view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            out[:, 8 * lane + k] = np.bincount(owner, weights=sums[:, lane], minlength=n)
    return out


def _hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(data[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def bits_of(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint and the number of shingles of each text of a batch."""
    counts, total = np.zeros((batch.num_rows, 64), np.int64), np.zeros(batch.num_rows, np.int64)
    seen = 0  # words of the text that goes on
    for s in spans(batch, SPACED, size - 1):
        t = s.lower()
        start, end, row = words(t, SPACED)
        data, at = joined(t, start, end)
        stop, text = at + (end - start), data.tobytes()
        has = np.bincount(row, minlength=t.n)
        new = int((start >= s.lead).sum())
        in_all = np.array([seen + new]) if s.n == 1 else has  # if few, the lead has all words of the spans before
        few = np.flatnonzero((in_all < size) & (in_all > 0) & (not s.more))
        begin = np.cumsum(has) - has
        m = max(0, len(row) - size + 1)
        ok = np.flatnonzero(row[:m] == row[len(row) - m :])
        h = np.concatenate([_hashes(text, at[ok], stop[ok + size - 1]), _hashes(text, at[begin[few]], stop[begin[few] + has[few] - 1])])
        of = np.concatenate([row[ok], few])
        order = np.argsort(of, kind="stable")
        own = slice(s.first, s.first + s.n)
        counts[own] += _bit_counts(h[order], of[order], s.n)
        total[own] += np.bincount(of, minlength=s.n)
        seen = seen + new if s.more else 0
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view(np.int64).reshape(-1), total


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and n_shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, bits_of(b, size))], names=["doc_id", "fp", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint, n_shingles bigint")


def _add(c: list[np.ndarray], x: list[np.ndarray]) -> None:
    """Adds four planes to the counters of ones, twos and fours and to the mark of eight and more."""

    def full(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = a ^ b
        return u ^ d, (a & b) | (u & d)

    c[0], p = full(c[0], x[0], x[1])
    c[0], q = full(c[0], x[2], x[3])
    c[1], r = full(c[1], p, q)
    c[3] |= c[2] & r
    c[2] ^= r


def _beyond(c: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over the radius (0 to 7)."""
    over, same = c[3].copy(), np.full_like(c[0], ALL)
    for k in (2, 1, 0):
        if radius >> k & 1:
            same &= c[k]
        else:
            over |= same & c[k]
            same &= ~c[k]
    return over


def near(fps: np.ndarray, radius: int, block: int = 256) -> np.ndarray:
    """(n, words) of bits: which fingerprints lie within the radius of each one, itself left out."""
    n = len(fps)
    width = (n + 63) // 64
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.zeros((64, width * 64), np.uint8)
    planes[:, :n] = bits.T
    planes = np.packbits(planes, axis=1, bitorder="little").view("<u8")
    query = (U64(0) - bits.T.astype(np.uint64))  # all ones where the bit is set
    none = np.zeros(width, np.uint64)  # lanes behind the last member
    if n % 64:
        none[-1] = ALL << U64(n % 64)
    out = np.zeros((n, width), np.uint64)
    for low in range(0, n, block):
        high = min(n, low + block)
        c = [np.zeros((high - low, width), np.uint64) for _ in range(3)] + [np.repeat(none[None], high - low, 0)]
        q, w = None, None
        for g in range(0, 64, 4):
            if q is None:
                x = [planes[k][None] ^ query[k, low:high, None] for k in range(g, g + 4)]
            else:
                x = [planes[k][w] ^ query[k][q] for k in range(g, g + 4)]
            _add(c, x)
            if g >= 12 and g % 8 == 4:
                live = _beyond(c, radius) != ALL
                if 2 * np.count_nonzero(live) < live.size:
                    at = np.nonzero(live)
                    q, w = (at[0] + low, at[1]) if q is None else (q[at[0]], w[at[0]])
                    c = [y[live] for y in c]
        hits = ~_beyond(c, radius)
        if q is None:
            out[low:high] = hits
        else:
            out[q, w] = hits
    me = np.arange(n)
    out[me, me >> 6] &= ~(U64(1) << (me & 63).astype(np.uint64))
    return out


def stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each component of the fingerprints within the radius: (member, its component's first)."""
    to = near(fps, radius)
    some = np.flatnonzero(to.any(axis=1))
    left = np.zeros(to.shape[1] * 64, np.uint8)
    left[some] = 1
    left = np.packbits(left, bitorder="little").view("<u8")
    members, heads = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in some.tolist():
        if not int(left[r >> 6]) >> (r & 63) & 1:
            continue
        left[r >> 6] &= ~(U64(1) << U64(r & 63))
        edge = np.array([r])
        while len(edge):
            reached = np.bitwise_or.reduce(to[edge], axis=0) & left
            left &= ~reached
            edge = np.flatnonzero(np.unpackbits(reached.view(np.uint8), bitorder="little"))
            members.append(edge)
            heads.append(np.full(len(edge), r))
    return fps[np.concatenate(members)], fps[np.concatenate(heads)]


def layout(n: int, radius: int) -> tuple[list[list[int]], int]:
    """For n fingerprints: for each choice of blocks the positions of their bits, and how many bits a bucket's number keeps."""
    for m in range(radius + 1, 9):
        edges = [64 * k // m for k in range(m + 1)]
        chosen = [[p for k in c for p in range(edges[k], edges[k + 1])] for c in combinations(range(m), m - radius)]
        if n >> min(map(len, chosen)) <= MEMBERS or m == 8:
            break
    assert len(chosen) == comb(m, radius)
    return chosen, min(min(map(len, chosen)), max(0, (n // MEMBERS).bit_length()))


def _runs(positions: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in positions:
        if out and out[-1][0] + out[-1][1] == p:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((p, 1))
    return out


def buckets(nodes: DataFrame, n: int, radius: int) -> DataFrame:
    """fp and the numbers of the buckets that it enters, one row each."""
    chosen, bits = layout(n, radius)

    def number(k: int, positions: list[int]) -> Column:
        value, width = F.lit(0).cast("long"), 0
        for start, size in _runs(positions):
            part = F.shiftrightunsigned(F.col("fp"), start).bitwiseAND((1 << size) - 1) if size < 64 else F.col("fp")
            value, width = value.bitwiseOR(F.shiftleft(part, width)), width + size
        folded = value if bits == width else F.pmod(F.xxhash64(value), F.lit(1 << bits).cast("long"))
        return F.struct(F.lit(k).alias("choice"), folded.alias("part"))

    return nodes.select("fp", F.explode(F.array(*(number(k, p) for k, p in enumerate(chosen)))).alias("b")).select("fp", "b.*")


def links(nodes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join each component within the radius; nodes has the column fp."""
    n = nodes.count()
    rows, key = buckets(nodes, n, radius), ["choice", "part"]
    sizes = scratch.kept(rows.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    large = sizes.where(F.col("c") > TILE).select(*key, F.ceil(F.col("c") * 2 / TILE).alias("g"))
    few = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    rows = rows.join(few, key, "left")
    chunk = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("g"))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda j: j != chunk)
    tile = F.when(F.col("g").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(other, lambda j: F.least(j, chunk) * F.col("g") + F.greatest(j, chunk)))
    rows = rows.select(*key, "fp", F.explode(tile).alias("tile"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(layout(n, radius)[0]) // 200_000)
    dealt = rows.repartition(tasks, *key, "tile").sortWithinPartitions(*key, "tile", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(rest: list[np.ndarray], cut: np.ndarray) -> pa.RecordBatch:
            found = [stars(rest[3][i:j], radius) for i, j in zip(cut[:-1], cut[1:], strict=True) if j - i > 1]
            a, b = (np.concatenate([np.zeros(0, np.uint64), *(f[k] for f in found)]).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        rest = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        for b in batches:
            now = [b.column(k).to_numpy() for k in range(4)]
            now[3] = now[3].view(np.uint64)
            rest = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
            cut = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([np.diff(x) != 0 for x in rest[:3]])]))
            yield compared(rest, cut)
            rest = [x[cut[-1] :] for x in rest]  # the last group may go on
        yield compared(rest, np.array([0, len(rest[3])]))

    out = dealt.select("choice", "part", "tile", "fp").mapInArrow(run, "a bigint, b bigint")
    return scratch.kept(out, "links")


def groups(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the least id reachable by links) of each row. radius: at most 7."""
    if not 0 <= radius < 8:
        raise ValueError("the counters hold a radius of 7 at most")
    scratch = Scratch()
    own = kept(fingerprints(docs, size), "fingerprints")
    nodes = scratch.kept(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")), "nodes")
    comp = components(links(nodes, radius, scratch))
    scratch.tables.append(comp)
    nodes = nodes.join(comp.select(F.col("node").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named_nodes = kept(nodes.join(least, "comp").select("fp", "times", "component_id"), "nodes")
    scratch.clear()
    out = named(own.where("doc_id is not null").select("doc_id", "fp"), named_nodes, ["fp"])
    alone = own.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return out.select("doc_id", "fp", "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """docs, all columns, without the members of groups but the one of least id (of rows with that id, all)."""
    gone = groups(docs, size, radius).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
