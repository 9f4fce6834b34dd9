"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Round j inserts the suffix of length j of every string that is so long: its symbol goes
into the transform at the row of the string's last suffix; that row's rank among the rows with the
same symbol is the place of the new suffix. The common prefix with the row above is one more
than the smallest common prefix between the two rows that precede them, so it comes
from the values of the round before. Both sequences are kept in files that a round reads
once from front to back and writes anew; strings are short blocks of bounded number, so
the rounds and the files are bounded too.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np


class Columns:
    """The two sequences on disk: one file each for the last round and for the next, written over in place."""

    def __init__(self, folder: str):
        self.files = [{k: open(Path(folder, f"{k}{i}"), "w+b", buffering=0) for k in ("bwt", "lcp")} for i in (0, 1)]
        self.turn = self.size = 0

    def read(self, kind: str) -> np.ndarray:
        f = self.files[self.turn][kind]
        f.seek(0)
        return np.fromfile(f, np.uint8, self.size)

    def write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        self.turn, self.size = self.turn ^ 1, len(bwt)
        for kind, values in (("bwt", bwt), ("lcp", lcp)):
            f = self.files[self.turn][kind]
            f.seek(0)
            values.tofile(f)

    def close(self) -> None:
        for pair in self.files:
            for f in pair.values():
                f.close()


def _merged(old: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``old`` with ``new`` inserted so that new[i] stands at at[i] (ascending)."""
    out = np.empty(len(old) + len(new), np.uint8)
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[keep] = old
    out[at] = new
    return out


def collection_bwt(data: np.ndarray, first: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefixes up to ``cap``, row of each whole string) of the strings data[first[i]:first[i + 1]].

    Symbols are bytes + 1 in the transform (uint8: the byte 255 does not occur in UTF-8); 0 ends a string.
    """
    m = len(first) - 1
    size = np.diff(first)
    row = np.arange(m)
    with tempfile.TemporaryDirectory(prefix="bwt-") as folder:
        files = Columns(folder)
        files.write(np.zeros(m, np.uint8), np.zeros(m, np.uint8))
        starts = np.zeros(257, np.int64)  # suffixes by first symbol so far
        starts[0] = m
        for j in range(1, int(size.max(initial=0)) + 1):
            bwt, lcp = files.read("bwt"), files.read("lcp")
            active = np.flatnonzero(size >= j)
            symbol = data[first[1:][active] - j].astype(np.int64) + 1
            order = np.lexsort((row[active], symbol))
            active, symbol = active[order], symbol[order]
            p = row[active]
            n = len(bwt)
            by_symbol = np.argsort(bwt, kind="stable")  # pending rows hold 0 and sort in front
            counts = np.bincount(bwt, minlength=257)
            end = np.cumsum(counts)
            begin = end - counts
            at = np.empty(len(active), np.int64)
            cut = np.searchsorted(symbol, np.arange(258))
            for c in np.flatnonzero(np.diff(cut)):
                own = slice(cut[c], cut[c + 1])
                at[own] = np.searchsorted(by_symbol[begin[c] : end[c]], p[own]) + begin[c]
            rank = at - begin[symbol]
            base = np.cumsum(starts) - starts
            place = base[symbol] + rank + np.arange(len(active))
            ahead = np.where(rank > 0, by_symbol[np.maximum(at - 1, 0)], -1)  # last row before p with the symbol
            after = np.where(at < end[symbol], by_symbol[np.minimum(at, n - 1)], -1)
            same = np.zeros(len(active), bool)
            same[1:] = symbol[1:] == symbol[:-1]
            ahead[1:] = np.where(same[1:], np.maximum(ahead[1:], p[:-1]), ahead[1:])
            last = np.ones(len(active), bool)  # of the new suffixes before the same old one
            last[:-1] = ~(same[1:] & (at[1:] == at[:-1]))
            value = np.zeros(len(active), np.uint8)
            has = np.flatnonzero(ahead >= 0)
            value[has] = np.minimum(_least(lcp, ahead[has] + 1, p[has] + 1).astype(np.int64) + 1, cap)
            fix = np.flatnonzero((after >= 0) & last)
            lcp_next = np.minimum(_least(lcp, p[fix] + 1, after[fix] + 1).astype(np.int64) + 1, cap)
            bwt[p] = symbol
            lcp[base[symbol[fix]] + rank[fix]] = lcp_next
            inserted = np.sort(place)
            files.write(_merged(bwt, place, np.zeros(len(active), np.uint8)), _merged(lcp, place, value))
            shift = np.searchsorted(inserted - np.arange(len(inserted)), row, "right")
            row = row + shift
            row[active] = place
            starts += np.bincount(symbol, minlength=257)
        out = files.read("bwt"), files.read("lcp"), row
        files.close()
        return out


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of values[a:b] for each pair, a < b."""
    if not len(a):
        return np.empty(0, np.uint8)
    ends = np.column_stack([a, b]).reshape(-1)
    return np.minimum.reduceat(np.append(values, np.uint8(255)), ends)[::2]


def suffix_rows(bwt: np.ndarray, row: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """The rows of the suffixes that start at 0, 1, ..., most - 1 of each string (columns); -1 beyond its end."""
    follow = np.argsort(bwt, kind="stable")
    out = np.full((most, len(row)), -1, np.int64)
    for j in range(most):
        inside = size > j
        out[j, inside] = row[inside]
        row = np.where(inside, follow[row], row)
    return out
