"""Periodic runs of words by online dyadic square catching (operator 13).

A square is a stretch of words followed at once by the same words again. ``SquareCatcher`` takes the words of a text as
they are appended, one by one or many at a time. On level k every completed block of m = 2**k words that starts at
a multiple of m is a catcher: it watches the words appended behind it for its own words at a distance q from 2m - 1
to 4m - 2. The first half of any square of such a half-length holds a whole block, so no square escapes. Blocks are
compared by names that are doubled from level to level, all appended places of a level at once; what
a catcher reports is compared word by word towards both ends. A square whose equal stretch touches the end of the text so
far stays open, and each appended word advances its comparison; squares of one period that touch are one run.

Only runs of ``exponent`` periods or more are wanted, which hold so many blocks in a row that each of them must report
the same distance (``chain``); a distance that is a multiple of the period of a run around it is no new square.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlab.llm.common import prepare

#: A run has at least this many periods and words.
EXPONENT = 4
LENGTH = 6
#: Words appended at a time, so that the names of a long text are built up in steps.
APPENDED = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _reach(x: np.ndarray, p: int, q: int) -> int:
    """Number of places from p on at which the words q apart are equal."""
    last, width, start = len(x) - q, 64, p
    while p < last:
        end = min(last, p + width)
        differ = x[p:end] != x[p + q : end + q]
        if differ.any():
            return p + int(differ.argmax()) - start
        p, width = end, 2 * width
    return last - start


def _reach_back(x: np.ndarray, p: int, q: int) -> int:
    """Number of places before p at which the words q apart are equal."""
    width, start = 64, p
    while p > 0:
        begin = max(0, p - width)
        differ = (x[begin:p] != x[begin + q : p + q])[::-1]
        if differ.any():
            return start - p + int(differ.argmax())
        p, width = begin, 2 * width
    return start


class SquareCatcher:
    """Runs of a growing sequence of word numbers."""

    def __init__(self, exponent: int = EXPONENT, length: int = LENGTH):
        if exponent < 2:
            raise ValueError("a run has two periods at least")
        self.exponent, self.length = exponent, length
        self.words = np.zeros(0, dtype=np.int64)
        self.names: list[np.ndarray] = []  # of the blocks of each level, from every place on
        self.stretches: dict[int, dict[int, int]] = {}  # by distance q: start -> end of places equal to those q on
        self.open: dict[int, int] = {}  # by distance: the start of the stretch that touches the end so far

    def append(self, new: np.ndarray) -> None:
        """Append words; all catchers advance by them."""
        self.words = x = np.concatenate([self.words, new]) if len(self.words) else np.asarray(new, dtype=np.int64)
        n = len(x)
        for q, start in list(self.open.items()):  # the comparisons that are still open
            own = self.stretches[q]
            own[start] += _reach(x, own[start], q)
            if own[start] + q < n:
                del self.open[q]
        m, level = 1, 0
        while (2 * m - 1) * self.exponent <= n:
            if level == len(self.names):
                self.names.append(np.zeros(0, dtype=np.uint64))
            done, names = len(self.names[level]), n - m + 1
            if level == 0:
                added = x[done:].astype(np.uint64)
            else:
                below = self.names[level - 1]
                added = (below[done:names] * _MIX) ^ (below[done + m // 2 : names + m // 2] + (below[done:names] >> np.uint64(29)))
                added *= _MIX
            self.names[level] = np.concatenate([self.names[level], added]) if done else added
            self._catch(level, m, done)
            m, level = 2 * m, level + 1

    def _catch(self, level: int, m: int, done: int) -> None:
        """What the catchers of a level report of the places from ``done`` on."""
        names = self.names[level]
        chain = ((self.exponent - 1) * (2 * m - 1) - (m - 1)) // m
        first = max(done, (2 * m - 1) + (chain - 1) * m)
        if first >= len(names):
            return
        last = names[first:]
        block = (np.arange(first - (2 * m - 1), len(names) - (2 * m - 1))) & -m
        starts, distances = [], []
        for behind in (0, m):  # two blocks stand at the watched distances from each place
            hit = np.flatnonzero(last == names[block - behind])  # an index before the text is sorted out below
            if not len(hit):
                continue
            at, catcher = hit + first, block[hit] - behind
            good = (catcher >= (chain - 1) * m) & (at - catcher <= 4 * m - 2)
            for link in range(1, chain):
                at, catcher = at[good], catcher[good]
                if not len(at):
                    break
                good = names[at - link * m] == names[catcher - link * m]
            starts.append(catcher[good] if len(at) else catcher)
            distances.append((at - catcher)[good] if len(at) else at)
        if not starts or not len(start := np.concatenate(starts)):
            return
        distance = np.concatenate(distances)
        for p in list(self.stretches):
            new = self._new(p, start, m, distance)
            start, distance = start[new], distance[new]
        for q in np.unique(distance).tolist():
            self._report(q, np.sort(start[distance == q]), m)

    def _new(self, p: int, start: np.ndarray, m: int, distance: np.ndarray | int) -> np.ndarray:
        """Which blocks are not, with their like, inside a run whose period p divides the distance."""
        strong = [(s, e) for s, e in self.stretches[p].items() if e - s >= (self.exponent - 1) * p]
        if not strong or not len(start):
            return np.ones(len(start), dtype=bool)
        ends = np.array(sorted(strong))  # stretches of one distance do not overlap
        k = np.searchsorted(ends[:, 0], start, side="right") - 1
        return (k < 0) | (start + m + distance > ends[k, 1] + p) | (distance % p != 0)

    def _report(self, q: int, start: np.ndarray, m: int) -> None:
        """Stretches of equal words q apart around the blocks at ``start``."""
        for p in self.stretches:
            if q % p == 0:
                start = start[self._new(p, start, m, q)]
        own = self.stretches.setdefault(q, {})
        x, at = self.words, 0
        while at < len(start):
            p = int(start[at])
            s, e = p - _reach_back(x, p, q), p + _reach(x, p, q)
            if e > p:  # else the names agree by chance
                own[s] = e
                if e + q == len(x):
                    self.open[q] = s
            at = max(at + 1, int(np.searchsorted(start, e)))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) of all runs, by start and period."""
        ends: dict[tuple[int, int], int] = {}
        for q in sorted(self.stretches):
            for s, e in self.stretches[q].items():
                if e + q - s >= max(self.length, self.exponent * q):
                    ends.setdefault((s, e + q), q)
        return sorted((s, e - s, q) for (s, e), q in ends.items())


def find_runs(words: list, exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the runs of a list of words."""
    if len(words) < max(length, exponent):
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return []
    catcher = SquareCatcher(exponent, length)
    for at in range(0, len(ids), APPENDED):
        catcher.append(ids[at : at + APPENDED])
    return catcher.runs()


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
DIGESTS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()  # bytes: only ASCII white space splits


def mark_runs(docs: DataFrame, exponent: int = EXPONENT, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, its runs by start and period, the text without the repetitions.

    Words are split at ASCII white space and told apart by their bytes. Null and blank texts have no words and no
    runs. Repeated rows and rows without an id each give a row; other columns are not read, so their names do
    not matter. An empty table gives no rows. A text is handled whole by the task that reads it; nothing is shuffled.
    """
    prepare(docs.sparkSession)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(text)
                runs = find_runs(words, exponent, length)
                out.append((doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapsed(words, runs)).decode("utf-8")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(marked, RUNS)


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with words rewritten to a period from a place on, for ids whose crc32 is a multiple of ten.

    Of a rewritten text the words are joined by one space; all others, and rows without an id, stay as they are. Gives (doc_id, text).
    """
    prepare(docs.sparkSession)

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
                if h % 10 == 0 and (words := _words(texts[k])):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode("utf-8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(planted, "doc_id long, text string")


def digests(marked: DataFrame) -> DataFrame:
    """Of the rows of ``mark_runs``: number of runs, the longest (ties: smallest start, then period), digests of the runs and the collapsed text."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                runs = [(r["start"], r["length"], r["period"]) for r in row["runs"]]
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                milli = 1000 * best[1] // best[2] if runs else None
                out.append((row["doc_id"], row["n_words"], len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(row["collapsed"].encode("utf-8")).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return marked.mapInArrow(digested, DIGESTS)
