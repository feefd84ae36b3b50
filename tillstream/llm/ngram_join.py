"""N-gram Jaccard join with PartEnum signatures.

A text's set holds its distinct word shingles; two texts link when their sets' Jaccard similarity
is at least num/den. Equal sets are one node. Each set gives PartEnum signatures (see `shingles`)
for its size band and the next; similar sets share one. A signature that one document has is
dropped, by way of sorted differences of the signatures' first bits (see `shared_beginnings`); what is left is checked without emitting all pairs of a group:

1. Each signature's members are compared with one pivot, the member with the most company over all
   its signatures. Links found this way make components.
2. Only pairs of different components are open then. In groups of at most SMALL members they are
   compared directly, at most SMALL for each member.
3. In larger groups each member x is described by what it adds to the pivot's set (A) and lacks of
   it (B). Similar sets of different components share an element of A - found by a join on those of A's
   elements that members of other components add too, rarer first, as many as the needed overlap allows - or lack a common element of the pivot
   while their sizes alone allow a link; then what both lack makes up most of what either lacks, so only the
   first of these elements are joined (see `first_lacking`). Both joins lose no link and emit near none of the pairs of a
   group of loosely edited copies.

Before sets are fetched, a pair must pass three bounds: sizes within the ratio, and the L1 distance of
the sets' counts in 64 hash cells, then the number of hash cells, PARITIES or more for each element, in which only one of them has
an odd number of elements, at most the difference that similar sets can have. Verification
intersects the whole sets. Documents are read once per step instead of keeping their sets: sets of
all texts would be several times the input.

Defined cases: null and empty texts and texts without words have no shingles and link with nothing;
a text with fewer words than a shingle has its whole sequence as one; repeated rows and equal ids
are members of their own, equal sets link; rows with a null id link with nothing and have a null
component; an empty table gives no rows; columns of other names are ignored by `groups` and kept by
`one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm import shingles
from tillstream.llm.components import components
from tillstream.llm.tables import Scratch, forget, kept, marked, named, table
from tillstream.llm.textbytes import Texts, chunks

SMALL = 16
CELLS = 64
PARITIES = 8
#: Ids that are sent to all tasks as a filter at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Added elements are told apart by how many rows have them: as many as each of these.
FREQUENT = (2, 4, 16, 128)
MOST_LEVEL_BITS = 1 << 26
U64 = np.uint64


def _node(rows: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array]:
    """Size and identity of each set: two independent 64-bit sums over its elements, both kept."""
    both = np.stack(shingles.fingerprints(rows, g, n), axis=1).astype(">u8")
    at = np.arange(n + 1, dtype=np.int32) * 16
    return np.bincount(rows, minlength=n), pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(both.tobytes())])


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    cut = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(cut, pa.array(values.view(np.int64)))


def _mapped(docs: DataFrame, size: int, make, fields: str) -> DataFrame:
    """doc_id and what `make` gives for the sets of each run of texts."""
    names = ["doc_id", *(x.split()[0] for x in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(b):
                rows, g = shingles.sets(t, size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, t.n), *make(t, rows, g)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id bigint, {fields}")


def _parities(rows: np.ndarray, g: np.ndarray, n: int) -> pa.Array:
    """Of each set a bit for each of so many hash cells, a power of two and PARITIES or more for each element: whether it has an odd number of elements there.
    An element that only one of two sets has changes one bit; of twice the cells, the halves xored are what half as many cells give."""
    size = np.bincount(rows, minlength=n)
    width = 8 << np.ceil(np.log2(np.maximum(1, size * PARITIES / 64))).astype(np.int64)  # bytes, of whole words of 64 bits
    cut = np.concatenate([[0], np.cumsum(width)])
    at = (shingles.mix(g + U64(78)) & (width * 8 - 1).astype(U64)[rows]).astype(np.int64)
    bits = np.zeros(cut[-1], np.uint8)
    np.bitwise_xor.at(bits, cut[rows] + (at >> 3), np.uint8(1) << (at & 7).astype(np.uint8))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(bits.tobytes())]).cast(pa.binary())


def sized(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (shingles), key (the set's identity), cells (counts in 64 hash cells, at most 255 each)."""

    def make(t: Texts, rows: np.ndarray, g: np.ndarray) -> list:
        n, node = _node(rows, g, t.n)
        cell = (shingles.mix(g + U64(77)) >> U64(58)).astype(np.int64)
        counts = np.minimum(np.bincount(rows * CELLS + cell, minlength=t.n * CELLS), 255).astype(np.uint8)
        return [pa.array(n.astype(np.int64)), node, pa.array([x.tobytes() for x in counts.reshape(t.n, CELLS)], pa.binary())]

    return _mapped(docs, size, make, "n bigint, key binary, cells binary")


def signed(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id and signature, one row each."""
    rows = _mapped(docs, size, lambda t, rows, g: [_lists(*shingles.signatures(rows, g, t.n, num, den), t.n)], "sigs array<bigint>")
    return rows.where("doc_id is not null").select("doc_id", F.explode("sigs").alias("sig"))


def _deltas(h: np.ndarray) -> bytes:
    """Ascending numbers below 2**32 as differences, byte plane by byte plane: what the shuffle compresses well."""
    return np.diff(h, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1), dtype=np.int64)


def shared_beginnings(docs: DataFrame, size: int, num: int, den: int, total: int) -> tuple[DataFrame, int]:
    """(h, bits): the first `bits` bits of signatures, of those that two documents or more have in common. A few more are told, whose
    beginnings agree only. total: about how many signatures there are.

    Nearly all signatures are of one document. They are not shuffled as rows: each task sorts its own, and sends, for each
    range of values, the differences of their beginnings, about two bytes a signature."""
    bits = max(24, total.bit_length() + 6)
    wide = max(4, (total >> 22).bit_length())  # ranges, as a power of two; what is left of a beginning is below 2**32

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            h = np.sort(np.concatenate([np.zeros(0, np.uint64), *held])) >> U64(64 - bits)
            h = h[np.concatenate([np.ones(min(2, len(h)), bool), h[2:] != h[:-2]])].astype(np.int64)  # two are enough to tell
            cut = np.searchsorted(h, np.arange((1 << wide) + 1) << (bits - wide))
            some = np.flatnonzero(np.diff(cut))
            rest = h & ((1 << (bits - wide)) - 1)
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array([_deltas(rest[cut[k] : cut[k + 1]]) for k in some.tolist()], pa.binary())], names=["part", "packed"])

        held: list[np.ndarray] = []
        for b in batches:
            for t in chunks(b):
                held.append(shingles.signatures(*shingles.sets(t, size), t.n, num, den)[1])
                if sum(map(len, held)) > 1 << 22:
                    yield packed(held)
                    held = []
        yield packed(held)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(part: int, held: list[bytes]) -> pa.RecordBatch:
            h = np.sort(np.concatenate([_numbers(x) for x in held]))
            h = np.unique(h[1:][h[1:] == h[:-1]]) + (part << (bits - wide))
            return pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])

        last, held = -1, []
        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part != last and held:
                    yield told(last, held)
                    held = []
                last = part
                held.append(x)
        if held:
            yield told(last, held)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(sent, "part bigint, packed binary")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << max(0, wide - 2))
    return rows.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(common, "h bigint"), bits


def _place_keys(a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One number for each (pivot, element); where two agree by chance, a pair more is compared."""
    return shingles.mix(e.view(U64) ^ shingles.mix(a.view(U64) + U64(91))).view(np.int64)


def _flat(b: pa.RecordBatch, name: str, *names: str) -> tuple[np.ndarray, ...]:
    """Row numbers and elements of a column of arrays, and other columns of the batch as numbers."""
    lists = b.column(b.schema.get_field_index(name))
    row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
    cols = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names)
    return row, lists.flatten().to_numpy().astype(np.int64), *cols


def _in(bitmap: np.ndarray, k: np.ndarray) -> np.ndarray:
    at = k & (len(bitmap) * 8 - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def levels(rows: DataFrame, name: str, frequent: tuple[int, ...]) -> list[np.ndarray]:
    """A bitmap for each of `frequent`: whether members of two components or more, and so many rows, have an element of the arrays
    `name`, or add it to one pivot where rows have one (a); by the low bits of its key, so that it may be taken for a more frequent
    one. The bitmaps are all that leaves the tasks: MOST_LEVEL_BITS each, whatever the input."""
    pivot = ["a"] if "a" in rows.columns else []

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, k, comp, *of = _flat(b, name, "comp", *pivot)
            k, comp = _place_keys(of[0][row], k) if of else k, comp[row]
            order = np.lexsort((comp, k))
            k, comp = k[order], comp[order]
            new = np.ones(len(k), bool)  # a component's elements count once a batch
            new[1:] = (k[1:] != k[:-1]) | (comp[1:] != comp[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array(comp[new])], names=["k", "comp"])

    total = rows.agg(F.coalesce(F.sum(F.size(name)), F.lit(0))).first()[0]
    size = min(MOST_LEVEL_BITS, max(1 << 15, 1 << (4 * total).bit_length()))
    at = F.col("k").bitwiseAND(size - 1) + 1
    elements = rows.select("comp", *pivot, name).mapInArrow(once, "k bigint, comp bigint").repartition("k")
    counted = elements.groupBy("k").agg(F.count("*").alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    level = F.filter(F.array(*(F.when(F.col("f") >= f, k) for k, f in enumerate(frequent))), lambda x: x.isNotNull())
    found = counted.select(at.alias("at"), F.explode(level).alias("level")).groupBy("level", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = [np.zeros(size // 8, np.uint8) for _ in frequent]
    for r in found.toLocalIterator():
        out[r.level][(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _typed(rows: DataFrame, *without: str) -> list[str]:
    return [f"{f.name} {f.dataType.simpleString()}" for f in rows.drop(*without).schema.fields]


def _with_list(b: pa.RecordBatch, name: str, row: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A batch with other arrays in place of, or behind, its own."""
    cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32)
    names = [c for c in b.schema.names if c != name]
    cols = [b.column(b.schema.get_field_index(c)) for c in names]
    return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(cut), pa.array(values))], names=[*names, name])


def only_shared(rows: DataFrame, given: Broadcast) -> DataFrame:
    """rows with those elements of `more` only that members of two components or more have, by a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, e = _flat(b, "more")
            keep = _in(given.value[0], e)
            yield _with_list(b, "more", row[keep], e[keep])

    return rows.mapInArrow(run, ", ".join([*_typed(rows, "more"), "more array<bigint>"]))


def first_elements(rows: DataFrame, given: Broadcast, num: int, den: int) -> DataFrame:
    """rows with `both`, how many of the elements that they add to their pivot (`more`) members of other components add too, and `first`, in
    place of `more`: keys of the first of these that a similar row must share one of, in an order that all rows of a pivot
    have: by frequency level (given: its bitmaps), then key. Nothing is shuffled by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, e, a, n, np_, nb = _flat(b, "more", "a", "n", "np", "nb")
            k = _place_keys(a[row], e)
            has = [_in(m, k) for m in given.value]
            k, row, level = k[has[0]], row[has[0]], np.sum(has, axis=0)[has[0]]
            order = np.lexsort((k, level, row))
            k, row = k[order], row[order]
            both = np.bincount(row, minlength=b.num_rows)
            place = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
            needed = np.maximum(1, -(-n * num // den) - (np_ - nb))
            keep = place < (both - needed + 1)[row]
            b = b.drop_columns(["more"]).append_column("both", pa.array(both))
            yield _with_list(b, "first", row[keep], k[keep])

    return rows.mapInArrow(run, ", ".join([*_typed(rows, "more"), "both bigint", "first array<bigint>"]))


def first_lacking(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows with `first`, in place of `less`: those elements of what they lack of their pivot, in an order that all rows of a pivot have,
    one of which is in common with any similar row of another component that adds nothing in common; and how many of them count
    where the row is the one outside the pivot's component (`outer`), and where it is the other one (`inner`).

    Let x and y add na and na' elements and lack nb and nb' of a pivot of np, with b of these in common. They are similar if
    (num + den) * (na + nb + na' + nb' - 2 * b) <= (den - num) * (n + n'), where n' = np + na' - nb' and nb' >= b. So, for either of them,
    2 * num * b >= (num + den) * (na + nb) - (den - num) * (n + np). As x is outside the pivot's component, it is not similar
    to the pivot, which makes (num + den) * b > num * na' + den * nb' for the other one. Of two sets with b elements in common, the first
    |set| - b + 1 of each have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, e, n, np_, na, nb, out = _flat(b, "less", "n", "np", "na", "nb", "out")
            order = np.lexsort((shingles.mix(e.view(U64)), row))
            row, e = row[order], e[order]
            either = np.maximum(1, -(-((num + den) * (na + nb) - (den - num) * (n + np_)) // (2 * num)))
            outer = np.where(out == 1, np.maximum(0, nb - either + 1), 0)
            inner = np.maximum(0, nb - np.maximum(either, (num * na + den * nb) // (num + den) + 1) + 1)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = place < np.maximum(outer, inner)[row]
            b = b.drop_columns(["less"]).append_column("outer", pa.array(outer)).append_column("inner", pa.array(inner))
            yield _with_list(b, "first", row[keep], e[keep])

    return rows.mapInArrow(run, ", ".join([*_typed(rows, "less"), "outer bigint", "inner bigint", "first array<bigint>"]))


def _near(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with cells of both that pass the L1 bound; vectorised, as there may be many false ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for i in (4, 5))
            apart = np.abs(x - y).sum(1)
            ok = (num + den) * apart <= (den - num) * (b.column(2).to_numpy() + b.column(3).to_numpy())
            yield b.filter(pa.array(ok)).select([0, 1, 2, 3])

    return pairs.mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint")


def _few_odd(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b, na, nb, p, q) those whose parities p and q differ in no more cells than similar sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded(bits: pa.Array, width: int, to: int) -> np.ndarray:
            words = np.frombuffer(b"".join(bits.to_pylist()), U64).reshape(len(bits), width // to, to // 8)
            return np.bitwise_xor.reduce(words, axis=1)

        for b in batches:
            p, q = b.column(4), b.column(5)
            width = np.stack([pc.binary_length(c).to_numpy() for c in (p, q)], axis=1)
            apart = np.zeros(b.num_rows, np.int64)
            for w in np.unique(width, axis=0):
                at = np.flatnonzero((width == w).all(1))
                x, y = (folded(c.take(pa.array(at)), int(k), int(w.min())) for c, k in zip((p, q), w, strict=True))
                apart[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            ok = (num + den) * apart <= (den - num) * (b.column(2).to_numpy() + b.column(3).to_numpy())
            yield b.filter(pa.array(ok)).select([0, 1, 2, 3])

    return pairs.select("a", "b", "na", "nb", "p", "q").mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint")


class Join:
    """The steps of one join; each keeps the tables that later ones read."""

    def __init__(self, docs: DataFrame, size: int, num: int, den: int, scratch: Scratch):
        kept, self.scratch = scratch.kept, scratch
        self.kept = kept
        self.docs, self.size, self.num, self.den = docs.select("doc_id", "text"), size, num, den
        self.own = kept(sized(self.docs, size), "sets")
        found = self.own.where("n > 0 and doc_id is not null")
        nodes = found.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.count("*").alias("times"))
        self.nodes = kept(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # a number for each distinct set
        # equal sets are known already: of each, one document gives signatures
        copies = named(found.select("key", "doc_id"), self.nodes.select("key", "times", F.col("doc_id").alias("own")), ["key"]).where("doc_id != own").select("doc_id").distinct()
        copies = copies.join(self.nodes.select("doc_id"), "doc_id", "left_anti")  # an id may have several texts
        copies = kept(copies, "copies")
        once = self.docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti")
        total = self.nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        shared, bits = shared_beginnings(once, size, num, den, 2 * total)
        shared = kept(shared, "shared")
        begun = signed(once, size, num, den).withColumn("h", F.shiftrightunsigned("sig", 64 - bits))
        likely = marked(begun, shared, "h").where("hit").drop("hit")
        members = likely.join(shared, "h").join(self.nodes.select("doc_id", "node"), "doc_id").select("sig", "node").distinct()
        members = kept(members, "members")
        many = members.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
        self.members = kept(members.join(many, "sig"), "members")
        scratch.forget(shared, copies, members)

    def pivots(self) -> DataFrame:
        """sig, pivot: the member with the largest groups over all its signatures."""
        company = self.members.groupBy("node").agg(F.sum("c").alias("s"))
        return self.members.join(company, "node").groupBy("sig").agg(F.max(F.struct("s", "node"))["node"].alias("pivot"))

    def made_of(self, nodes: DataFrame, make, field: str) -> DataFrame:
        """nodes (node, other columns) with what `make` gives for the set of each, from one text."""
        wanted = self.kept(nodes.join(self.nodes.select("node", "key", "doc_id"), "node"), "wanted")
        ids = wanted.select("doc_id").distinct()
        texts = self.docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

        def run(t: Texts, rows: np.ndarray, g: np.ndarray) -> list:
            return [_node(rows, g, t.n)[1], make(rows, g, t.n)]

        name = field.split()[0]
        one = _mapped(texts, self.size, run, f"key binary, {field}").groupBy("key", "doc_id").agg(F.first(name).alias(name))  # dealt as the join asks
        return self.kept(one.join(wanted, ["key", "doc_id"]).drop("key", "doc_id"), name)

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """nodes with `set`, their shingles."""
        return self.made_of(nodes, _lists, "set array<bigint>")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) with their sizes that may be similar by size and cells."""
        x = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
        y = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
        both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(x, "a").join(y, "b")
        fits = (self.den * F.least("na", "nb") >= self.num * F.greatest("na", "nb"))
        return self.kept(_near(both.where(fits).select("a", "b", "na", "nb", "ca", "cb"), self.num, self.den), "pairs")

    @staticmethod
    def both(pairs: DataFrame) -> DataFrame:
        """The nodes of pairs."""
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    @staticmethod
    def beside(pairs: DataFrame, of: DataFrame, name: str, x: str, y: str) -> DataFrame:
        """pairs with x and y, what a and b have as `name`."""
        return pairs.join(of.select(F.col("node").alias("a"), F.col(name).alias(x)), "a").join(of.select(F.col("node").alias("b"), F.col(name).alias(y)), "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose whole sets are similar."""
        same, before = F.size(F.array_intersect("x", "y")), list(self.scratch.tables)
        pairs = self.bounded(pairs)
        odd = self.made_of(self.both(pairs), _parities, "odd binary")
        pairs = self.kept(_few_odd(self.beside(pairs, odd, "odd", "p", "q"), self.num, self.den), "pairs")
        with_sets = self.beside(pairs, self.sets_of(self.both(pairs)), "set", "x", "y")
        out = self.kept(with_sets.where((self.num + self.den) * same >= self.num * (F.col("na") + F.col("nb"))).select("a", "b"), "links")
        self.only(before, out)
        return out

    def only(self, before: list[DataFrame], *more: DataFrame) -> None:
        """Of the tables kept since then only these stay."""
        stay = [*before, *more]
        self.scratch.forget(*(t for t in self.scratch.tables if all(t is not x for x in stay)))

    def open_groups(self, comp: DataFrame, pivots: DataFrame) -> DataFrame:
        """Members, with component and pivot, of the signatures that more than one component has."""
        m = self.members.where("c > 2").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        rest = m.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("sig")
        return self.kept(m.join(rest, "sig").join(pivots, "sig"), "open")

    def small_pairs(self, rows: DataFrame) -> DataFrame:
        x = rows.where((F.col("c") <= SMALL) & (F.col("node") != F.col("pivot"))).select("sig", F.col("node").alias("a"), F.col("comp").alias("p"))
        y = x.select("sig", F.col("a").alias("b"), F.col("p").alias("q"))
        return x.join(y, (x.sig == y.sig) & (x.a < y.b) & (x.p != y.q)).select("a", "b")

    def large_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of different components that may be similar, by what they add to and lack of their pivot."""
        num, den = self.num, self.den
        star = self.kept(rows.where((F.col("c") > SMALL) & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b"), "comp").distinct(), "stars")
        pivot_comp = rows.where("node = pivot").select(F.col("node").alias("a"), F.col("comp").alias("pc")).distinct()
        before = list(self.scratch.tables)
        either = star.select(F.col("a").alias("node"), F.lit(True).alias("pivot")).unionByName(star.select(F.col("b").alias("node"), F.lit(False).alias("pivot")))
        sets, members = self.sets_of(either.groupBy("node").agg(F.bool_or("pivot").alias("pivot"))), star.select(F.col("b").alias("node"), "comp").distinct()
        members = sets.join(F.broadcast(members) if members.count() <= BROADCAST_IDS else members, "node")
        send = self.docs.sparkSession.sparkContext.broadcast
        shared = send(levels(members, "set", FREQUENT[:1]))
        d = star.join(pivot_comp, "a").join(sets.where("pivot").select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
        d = d.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        d = d.select("a", "b", "comp", (F.col("comp") != F.col("pc")).alias("out"), F.size("x").alias("np"), F.size("y").alias("n"), F.array_except("y", "x").alias("more"), "x", "y")
        d = d.withColumn("na", F.size("more")).withColumn("nb", F.col("np") - F.col("n") + F.col("na"))
        # what a member lacks is asked for where that alone can make up for what it adds
        spare = F.col("na") * (num + den) <= (den - num) * (F.col("n") + F.ceil(F.col("n") * den / num))
        d = d.withColumn("less", F.when(spare & ((F.col("nb") > F.col("na")) | F.col("out")), F.array_except("x", "y"))).drop("x", "y")
        d = self.kept(only_shared(d, shared), "deltas")
        shared.destroy()
        self.only(before, d)
        side = ["a", "b", "comp", "out", "n", "na", "nb"]

        def joined(keys: DataFrame, on: list[str], condition) -> DataFrame:
            x, y = keys.where("out").alias("x"), keys.alias("y")
            same = reduce(Column.__and__, (F.col(f"x.{c}") == F.col(f"y.{c}") for c in on)) & (F.col("x.comp") != F.col("y.comp"))
            fits = (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n"))
            return x.join(y, same & fits & condition).select(F.col("x.b").alias("a"), F.col("y.b").alias("b"))

        # added elements, rarer ones first: the first common one is among the first |A| - t + 1, where t
        # of the needed overlap must lie in A; from its place on, both must have enough of them left
        order = send(levels(d, "more", FREQUENT))
        keys = first_elements(d.select(*side, "np", "more"), order, num, den).drop("a", "na")
        keys = self.kept(keys.select("*", F.posexplode("first").alias("i", "k")).drop("first"), "rare")
        order.destroy()
        left = F.least(F.col("x.both") - F.col("x.i"), F.col("y.both") - F.col("y.i"))
        most = left + F.least(F.col("x.np") - F.col("x.nb"), F.col("y.np") - F.col("y.nb"))
        by_added = joined(keys, ["k"], (num + den) * most >= num * (F.col("x.n") + F.col("y.n")))
        # nothing added in common: lacking elements must make up for it, which takes a smaller set
        lacking = first_lacking(d.where("less is not null").select(*side, "np", "less"), num, den).drop("np")
        lacking = self.kept(lacking.select("*", F.posexplode("first").alias("i", "e")).drop("first"), "lacking")
        left = F.least(F.col("x.nb") - F.col("x.i"), F.col("y.nb") - F.col("y.i"))  # if this is the first common one
        kept_all = F.col("x.na") + F.col("x.nb") + F.col("y.na") + F.col("y.nb") - 2 * left
        roles = (F.col("x.i") < F.col("x.outer")) & (F.col("y.i") < F.col("y.inner"))
        by_lacking = joined(lacking, ["a", "e"], roles & ((num + den) * kept_all <= (den - num) * (F.col("x.n") + F.col("y.n"))))
        return by_added.unionByName(by_lacking)

    def components(self) -> DataFrame:
        """node, comp for nodes with links."""
        pivots = self.kept(self.pivots(), "pivots")
        star = self.members.join(pivots, "sig").where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        first = self.links(star)
        comp = components(first)
        rows = self.open_groups(comp, pivots)
        forget(comp)
        before = list(self.scratch.tables)
        rest = self.links(self.small_pairs(rows).unionByName(self.large_pairs(rows)))
        self.only(before, rest)
        out = components(first.unionByName(rest))
        self.scratch.tables.append(out)
        return out


def groups(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of each row."""
    scratch = Scratch()
    j = Join(docs, size, num, den, scratch)
    of_sets = j.nodes.select("key", "times", "node").join(j.components(), "node", "left").select("key", "times", F.coalesce("comp", "node").alias("comp"))
    own = named(j.own.select("doc_id", "n", "key"), of_sets, ["key"], "left").select("doc_id", "n", "comp")
    own = kept(own, "components")
    scratch.clear()
    least = own.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("times"))
    linked = named(own.where("n > 0 and doc_id is not null"), least, ["comp"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = own.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs, all columns, without the members of groups but the one of least id (of rows with that id, all)."""
    gone = kept(groups(docs, size, num, den).where("doc_id != component_id").select("doc_id").distinct(), "copies")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), 3, 9, 10)
