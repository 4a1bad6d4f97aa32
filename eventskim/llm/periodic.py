"""Runs of repeating words: found by a suffix automaton under link-cut access.

The words of a text are appended to a suffix automaton whose suffix links are kept as a
link-cut tree. A preferred path holds the substrings that were last seen to end at one
word, so appending word i recolours the path from the root to the state of the whole
prefix: each path segment met on the way says that the suffixes with lengths in (low,
high] ended last at word e. If d = i - e lies in that range, the last 2d words are a
square of a primitive word; it is extended to the run, the longest stretch of that period.

Every run holds six consecutive words that recur within it at a distance of its period,
so only stretches of words that six-word hashes cover are appended. That leaves out
nothing: a hash that is equal by accident only makes a stretch longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, let, mapped, mixed, word_hashes

#: Shortest run, in words. A shorter one than twice its period is none.
LEAST_WORDS = 12
_STRETCH = np.uint64(0x9E3779B97F4A7C15)


class _Automaton:
    """Suffix automaton of appended symbols; states are numbers, 0 the empty word."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.last = [-1], [0], 0
        # Link-cut tree over the suffix links: splay children, and parent or path parent.
        # The root of a splay tree holds the colour of its path.
        self.left, self.right, self.up, self.colour = [-1], [-1], [-1], [-1]

    def _state(self, size: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.left.append(-1)
        self.right.append(-1)
        self.up.append(link)
        self.colour.append(-1)
        return len(self.size) - 1

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner >= 0:
            up[inner] = y
        up[y], up[x] = x, z
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def _splay(self, x: int) -> int:
        """Make ``x`` the root of its splay tree; the colour of its path."""
        left, right, up, rotate = self.left, self.right, self.up, self._rotate
        root = x
        while (y := up[root]) >= 0 and (left[y] == root or right[y] == root):
            root = y
        self.colour[x] = colour = self.colour[root]
        while x != root:
            y = up[x]
            if y == root:
                rotate(x)
                break
            z = up[y]
            rotate(y if (left[z] == y) == (left[y] == x) else x)
            rotate(x)
            if z == root:
                break
        return colour

    def append(self, symbol, i: int) -> list[int]:
        """Append symbol number ``i``; periods of the primitive squares that end with it."""
        following, link, size = self.next, self.link, self.size
        left, right, up, colour = self.left, self.right, self.up, self.colour
        p = self.last
        new = self._state(size[p] + 1, 0, {})
        while p >= 0 and symbol not in following[p]:
            following[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = following[p][symbol]
            if size[q] != size[p] + 1:
                copy = self._state(size[p] + 1, link[q], following[q].copy())
                # The copy's words were last seen where q's were: it goes above q in q's path.
                self._splay(q)
                if (above := left[q]) >= 0:
                    up[above] = copy
                left[copy], left[q], up[copy] = above, copy, q
                while p >= 0 and following[p].get(symbol) == q:
                    following[p][symbol] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = up[new] = q
        self.last = new
        periods = []
        below, x = new, link[new]
        while x >= 0:
            end = self._splay(x)
            higher = up[x]
            if end >= 0 and (size[higher] if higher >= 0 else 0) < i - end <= size[x]:
                periods.append(i - end)
            if (cut := right[x]) >= 0:
                colour[cut] = end
            right[x] = below
            below, x = x, higher
        colour[below] = i
        self._splay(new)
        return periods


def runs(words: list, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and two periods, in order.

    ``words`` may be any hashable values; equal values are equal words.
    """
    automaton, n = _Automaton(), len(words)
    found, last_end = [], {}
    for i, word in enumerate(words):
        for d in automaton.append(word, i):
            if i <= last_end.get(d, -1):
                continue  # inside a run that is known
            start, stop = i - 2 * d + 1, i + 1
            while start > 0 and words[start - 1] == words[start - 1 + d]:
                start -= 1
            while stop < n and words[stop] == words[stop - d]:
                stop += 1
            last_end[d] = stop - 1
            if stop - start >= least:
                found.append((start, stop - start, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(hashes: np.ndarray, docs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges of words, none across documents, outside of which no run has a word.

    A run of period q has ``least`` words or more and 2q, so ``least // 2`` consecutive
    words of it recur q further, and q is at most half of the range it lies in.
    """
    gram = least // 2
    where, part = np.arange(len(hashes)), docs
    while len(where) >= gram:
        n = len(where) - gram + 1
        sums = np.zeros(n, np.uint64)
        for j in range(gram):
            sums = sums * _STRETCH + hashes[where[j : j + n]]
        # Only grams of adjacent words of one part count.
        whole = np.flatnonzero((part[:n] == part[gram - 1 :]) & (where[gram - 1 :] - where[:n] == gram - 1))
        keys = mixed(sums[whole] ^ mixed(part[whole].astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        at = where[whole[order]]
        most = np.bincount(part)[part[whole[order]]] // 2
        again = keys[order[1:]] == keys[order[:-1]]
        near = again & (at[1:] - at[:-1] <= most[1:])
        hit = np.zeros(len(order), bool)
        hit[1:] |= near
        hit[:-1] |= near
        edge = np.zeros(len(where) + 1, np.int64)
        np.add.at(edge, whole[order[hit]], 1)
        np.add.at(edge, whole[order[hit]] + gram, -1)
        covered = np.cumsum(edge[:-1]) > 0
        kept, of = where[covered], part[covered]
        if not len(kept):
            return []
        new = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(of) != 0)])
        if len(kept) > 0.9 * len(where):
            first = np.flatnonzero(new)
            lengths = np.diff(np.append(first, len(kept)))
            return [(int(kept[f]), int(kept[f]) + int(k)) for f, k in zip(first, lengths, strict=True) if k >= least]
        where, part = kept, np.cumsum(new) - 1
    return []


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run only the first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)])


def _of_texts(texts: list[str | None], least: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes, docs = word_hashes(data, np.cumsum([0, *map(len, raw)]))
    first = np.searchsorted(docs, np.arange(len(raw)))
    found: list[list] = [[] for _ in raw]
    words: dict[int, list[bytes]] = {}
    for start, stop in _stretches(hashes, docs, least):
        doc = int(docs[start])
        if doc not in words:
            words = {doc: raw[doc].split()}
        at = start - int(first[doc])
        found[doc] += [(at + s, n, q) for s, n, q in runs(words[doc][at : at + stop - start], least)]
    for f in found:
        f.sort(key=lambda r: (r[0], r[2]))
    return found, [_collapsed(t.split(), f) if f else b" ".join(t.split()) for t, f in zip(raw, found, strict=True)]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the runs of its column ``text`` and the text without their repeats.

    ``runs`` lists the word number, length and smallest period of each run of at least
    ``least`` words and two periods, by start and period. ``collapsed`` joins by one
    space the words that no run holds after its first period. Columns of these names are
    replaced. NULL and empty texts have no run and collapse to ''. Every row stands for
    itself: repeated rows, NULL ids and empty tables need nothing special. A text is held
    by one task; an automaton takes about 1 kB a word of the stretches that repeat.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    def start():
        def of(texts: list) -> list[pa.Array]:
            found, left = _of_texts(texts, least)
            as_rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found]
            return [pa.array(as_rows, _RUNS), pa.array(left, pa.binary()).cast(pa.string())]

        return of

    return mapped(docs, text, {"runs": RUNS, "collapsed": "string"}, start)


def repeat_tails(doc_id: Column, text: Column) -> Column:
    """The words of ``text``, joined by a space; of a tenth of all ids the end is made to repeat.

    With h the CRC-32 of the id's digits and g = h // 10, ids with h % 10 = 0 have word i
    from a = g % n on replaced by word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    The text of other ids, and of a NULL id, is left as it is; NULL is ''.
    """
    text = F.coalesce(text, F.lit(""))
    code = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(code / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        number = F.sequence(F.lit(0), n - 1)
        return let(
            F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p")),
            lambda c: F.transform(
                number, lambda i: F.get(c["w"], F.when(i < c["a"], i).otherwise(c["a"] + (i - c["a"]) % c["p"]))
            ),
        )

    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0)
    long = F.array_join(let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(w)), " ")
    return F.when(code % 10 == 0, long).otherwise(text)


def op11_runs(docs: DataFrame) -> DataFrame:
    """Runs of each whole text of ``documents``, after :func:`repeat_tails`, as digests.

    One row for each row of ``docs``. A text without a run has NULL for the longest run's
    start, length, period and exponent; ties go to the smaller start, then period.
    """
    found = periodic_runs(docs.select("doc_id", repeat_tails(F.col("doc_id"), F.col("text")).alias("text")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    order = lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
    found = found.select(
        "doc_id", "runs", "collapsed", F.array_join(F.transform("runs", line), "").alias("lines"),
        F.array_max(F.transform("runs", order)).alias("longest"),
    )
    length, period = F.col("longest.n"), -F.col("longest.p")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
