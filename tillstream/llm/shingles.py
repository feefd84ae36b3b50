"""Word shingle sets of whole texts and their PartEnum signatures, a batch at a time."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np

from tillstream.llm.textbytes import Texts, mix

U64 = np.uint64


def bands(num: int, den: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Size bands for a similarity of num/den: first size of each band, and the most elements in
    which two sets of a band and the one below may differ. Similar sets lie in one band or in neighbours."""
    first, differ, low = [], [], 1
    while low <= most:
        high = low * den // num
        first.append(low)
        differ.append(2 * high * (den - num) // (den + num))
        low = high + 1
    return np.array(first), np.array(differ)


def sets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct `size`-word shingles of each lower-cased text, ascending; a text with
    fewer words has its whole sequence as the only one, one without words none."""
    w = t.lower().words()
    h, n = w.hashes(), w.counts()
    parts = [w.grams(h, size)]
    for k in range(1, size):
        rows, g = w.grams(h, k)
        few = n[rows] == k
        parts.append((rows[few], g[few]))
    rows, g = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((g, rows))
    rows, g = rows[order], g[order]
    if len(g):
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])])
        rows, g = rows[new], g[new]
    return rows, g


def fingerprints(rows: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal for equal sets."""
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(a, rows, g)
    np.add.at(b, rows, mix(g + U64(0x51ED270B)))
    return a, b


#: What a false meeting of two texts costs against a signature, and the share of their elements that unrelated texts may well
#: have in common (quoted passages); both only weigh layouts against each other.
MEETING, SHARED = 64.0, 0.5


@lru_cache(maxsize=1 << 16)
def layout(size: int, k: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for sets of a size, of which similar ones differ in k elements at most.

    The domain is split into n1 parts, each of these into n2 cells. n1 is so large that, however k differences fall, more
    than `spare` parts have k2 of them at most; in such a part some n2 - k2 cells have none. All subsets of n2 - k2 cells of
    each part are signatures. Fewer, larger cells make fewer false meetings, more subsets make more signatures: the layout
    is the one of least expected cost, n1 * C(n2, k2) signatures, each with a chance of SHARED**elements to meet in vain."""
    if k == 0:
        return 1, 1, 0, 0
    found = []
    for k2 in range(min(k, 3) + 1):
        least = k // (k2 + 1) + 1
        spare = 1 + least // 12
        for n2 in range(k2 + 1, k2 + 4):
            n1 = least + spare
            elements = size * (n2 - k2) / (n1 * n2)
            found.append((n1 * comb(n2, k2) * (1 + MEETING * SHARED**elements), n1, n2, k2, spare))
    return min(found)[1:]


def signatures(rows: np.ndarray, g: np.ndarray, n: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of each set: (row, signature), for each of the two size bands that a set is compared in (see `layout`).

    Subsets of cells without elements would be signatures of many unrelated sets. A part with such a subset is hollow; a
    set with at most `spare` hollow parts gives no empty signatures: of the parts in which a similar set agrees with it, one
    is not hollow, so they still share a signature with elements. The few sets with more hollow parts give all."""
    size = np.bincount(rows, minlength=n)
    first, differ = bands(num, den, int(size.max(initial=1)) * den // num + 1)
    plan = np.array([layout(int(a), int(k)) for a, k in zip(first, differ, strict=True)], np.int64)
    band = np.searchsorted(first, size, "right") - 1
    spread = mix(g ^ U64(0xA5A5A5A5DEADBEEF))
    high, low, element = spread >> U64(32), spread & U64(0xFFFFFFFF), mix(g)
    out_rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for up in (0, 1):
        own = np.minimum(band + up, len(first) - 1)
        n1, n2, k2, spare = plan[own].T
        for m, k in sorted(set(zip(n2[size > 0].tolist(), k2[size > 0].tolist(), strict=True))):
            mine = (size > 0) & (n2 == m) & (k2 == k)
            parts = np.where(mine, n1, 0)
            start = np.concatenate([[0], np.cumsum(parts)])
            here = mine[rows]
            r = rows[here]
            part = start[r] + (high[here] * parts[r].astype(np.uint64) >> U64(32)).astype(np.int64)
            cell = part * m + (low[here] * U64(m) >> U64(32)).astype(np.int64)
            sums = np.zeros(start[-1] * m, np.uint64)
            np.add.at(sums, cell, element[here])
            sums, count = sums.reshape(-1, m), np.bincount(cell, minlength=start[-1] * m).reshape(-1, m)
            row = np.repeat(np.arange(n), parts)
            place = np.arange(start[-1]) - start[row]
            name = mix((own[row].astype(np.uint64) << U64(32)) + (place.astype(np.uint64) << U64(8)))
            chosen = list(combinations(range(m), m - k))
            empty = [count[:, c].sum(1) == 0 for c in chosen]
            hollow = np.logical_or.reduce(empty)
            all_ = (np.bincount(row[hollow], minlength=n) > spare)[row]
            for i, (c, e) in enumerate(zip(chosen, empty, strict=True)):
                keep = ~e | all_
                out_rows.append(row[keep])
                out.append(mix(sums[keep][:, c].sum(1, dtype=np.uint64) ^ (name[keep] + U64(i))))
    row, sig = np.concatenate(out_rows), np.concatenate(out)
    order = np.argsort(row, kind="stable")
    return row[order], sig[order]
