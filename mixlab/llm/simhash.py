"""SimHash near-duplicates by a byte-position inverted index (operator 4).

Two 64-bit fingerprints that differ in at most d bits share at least 8 - d of their eight positional
bytes, the guaranteed minimum of matches. A list per single (position, byte) holds 1/256 of all
fingerprints, so tallying those lists would emit a share of all pairs. The index therefore
lists fingerprints under each combination of 8 - d positional bytes: a pair stands together in a list exactly if
its tally of shared bytes reaches the minimum. A list holds at most 2 ** (8 d) fingerprints (65,536 for
d = 2) whatever the input is. Within a list, a bit mask over the remaining bytes names the partners;
their tally is taken again over all eight bytes and the bits are verified. A list passes on one link per
fingerprint to its local group, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlab.llm.common import prepare, row_key, saved
from mixlab.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if set in over half of the shingles' XXH64 (seed 42).

    A-Z is lower-cased, ASCII white space splits words; fewer words than a shingle: the whole sequence; none: 0.
    """
    found = (text or "").encode("utf-8").lower().split()  # bytes: only ASCII changes case or splits
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed=42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    h = np.array([digest(joined[s:e], 42) for s, e in spans], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(doc_id, fp), and the binary column ``key_col`` if given: fp is the fingerprint's bits as a signed long."""
    prepare(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            kept = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *kept], names=["doc_id", "fp", *keys])

    keys = [key_col] if key_col else []
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keys)
    return texts.mapInArrow(prints, ", ".join(["doc_id long, fp long", *[f"{k} binary" for k in keys]]))


def _masks(kept: tuple[int, ...], bits: int) -> np.ndarray:
    """Differences of at most ``bits`` bits within the bytes that are not in ``kept``."""
    free = [8 * p + b for p in range(8) if p not in kept for b in range(8)]
    return np.array([sum(1 << x for x in c) for n in range(1, bits + 1) for c in combinations(free, n)], dtype=np.uint64)


def _tally(x: np.ndarray) -> np.ndarray:
    """Number of equal positional bytes, given the xor of fingerprints."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)


def list_links(fps: np.ndarray, masks: np.ndarray, bits: int) -> np.ndarray:
    """Links within one list of distinct fingerprints, sorted: (fingerprint, root of its local group)."""
    n = len(fps)
    root = np.arange(n)
    if n <= 64:
        i, j = np.triu_indices(n, 1)
        pairs = [(i, j)]
    else:  # look every possible partner up
        pairs = []
        for mask in masks:
            other = fps ^ mask
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            hit = np.flatnonzero((fps[at] == other) & (other > fps))
            pairs.append((hit, at[hit]))
    for i, j in pairs:
        x = fps[i] ^ fps[j]
        good = (_tally(x) >= 8 - bits) & (_bits(x) <= bits)
        for a, b in zip(i[good].tolist(), j[good].tolist()):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            root[max(a, b)] = min(a, b)
    for a in range(n):
        root[a] = root[root[a]]
    linked = np.flatnonzero(root != np.arange(n))
    return np.stack([fps[linked], fps[root[linked]]], axis=1)


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): enough to connect all that differ in at most ``bits`` bits."""
    if not 1 <= bits <= 3:
        raise ValueError("the index holds for 1 to 3 differing bits")
    prepare(distinct.sparkSession)
    kept = list(combinations(range(8), 8 - bits))
    keys = [sum(0xFF << 8 * p for p in c) for c in kept]
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    entries = F.array(*[F.struct(F.lit(i).cast("byte").alias("c"), F.col("fp").bitwiseAND(F.lit(k)).alias("key")) for i, k in enumerate(signed)])
    lists = distinct.select("fp", F.explode(entries).alias("e")).select("e.c", "e.key", "fp")
    lists = lists.repartition("c", "key").sortWithinPartitions("c", "key")
    masks = [_masks(c, bits) for c in kept]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None

        def close(c: np.ndarray, key: np.ndarray, fp: np.ndarray, last: bool):
            """Links of the lists that have ended, and the rows of the one that may go on."""
            new = np.flatnonzero((c[1:] != c[:-1]) | (key[1:] != key[:-1])) + 1
            edges = [0, *new.tolist(), *([len(c)] if last else [])]
            starts, ends = np.array(edges[:-1], dtype=int), np.array(edges[1:], dtype=int)
            out = [list_links(np.sort(fp[s:e]), masks[c[s]], bits) for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1])]
            return out, None if last else (c[edges[-1] :], key[edges[-1] :], fp[edges[-1] :])

        def emit(out: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            out = [x for x in out if len(x)]
            if out:
                both = np.concatenate(out).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            own = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
            rows = own if rest is None else tuple(np.concatenate(x) for x in zip(rest, own))
            out, rest = close(*rows, last=False)
            yield from emit(out)
        if rest is not None:
            yield from emit(close(*rest, last=True)[0])

    return lists.mapInArrow(found, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero, linked like any other. Rows without an id take
    part but never name a component, unless no member has an id (component_id is null then). Repeated
    rows stay. An empty table gives no rows.
    """
    rows = saved(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = saved(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    out = rows.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: that of the smallest id, one without an id only if no member has one.

    Rows are told apart by id and text, so rows without an id or of one id go only if they are near-duplicates
    of a row that stays. Of rows equal in both one stays.
    """
    keyed = docs.withColumn("_row", row_key(id_col, text_col))
    rows = saved(fingerprints(keyed, words, id_col, text_col, "_row"), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    distinct = saved(rows.groupBy("fp").agg(F.min(place).alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    return keyed.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
