"""Vector best-fit packing of documents into token sequences (operator 9).

Each sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are taken longest first; among the open sequences in which all three residuals
suffice, the one of the largest weighted dot product of residual and need, or of the smallest
norm of what would remain, receives the piece. Pieces are dealt by hash into groups of a bounded size that
are packed independently, so no task sees the whole table; a group leaves about one sequence unfilled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlab.llm.common import prepare, saved
from mixlab.llm.encoding import default_tokenizer, encoder

#: Pieces in a group, on average.
GROUP_PIECES = 32_768


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. The defaults leave only the tokens to bind."""

    tokens: int = 4096
    docs: int = 4096
    attention: int = 4096 * 4096


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", group int, bin long, offset long"


def cut(docs: DataFrame, length: int = 4096, tokenizer: str | None = None, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text: only a document above ``length`` ids is cut.

    A null text is an empty document and has the end id alone; without an end id an empty
    document has one piece of length 0.
    """
    prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                ids += tail
                for k, at in enumerate(range(0, max(len(ids), 1), 4 * length)):
                    part = ids[at : at + 4 * length]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def best_fit(lengths: np.ndarray, limits: Limits = Limits(), rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. ``rule``: "norm" (residual norm) or "dot" (weighted dot product).

    Ties go to the bin opened first. Raises if a piece alone exceeds a capacity.
    """
    full = np.array([limits.tokens, limits.docs, limits.attention], dtype=float)
    w = np.array(weights)
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    left = np.zeros((3, 1024))  # residuals of the open bins
    name = np.zeros(1024, dtype=np.int64)
    n = made = 0
    order = np.argsort(-lengths, kind="stable")
    smallest = int(lengths.min()) if len(lengths) else 0
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if (need > full).any():
            raise ValueError(f"a piece of {lengths[i]} tokens exceeds the limits {limits}")
        r = left[:, :n]
        fits = np.flatnonzero((r[0] >= need[0]) & (r[1] >= 1) & (r[2] >= need[2]))
        if len(fits):
            after = (r[:, fits] - need[:, None]) / full[:, None]
            score = w @ after**2 if rule == "norm" else -(w @ (r[:, fits] / full[:, None] * (need / full)[:, None]))
            b = int(fits[np.argmin(score)])
        else:
            if n == left.shape[1]:
                left, name = np.hstack([left, np.zeros_like(left)]), np.concatenate([name, np.zeros_like(name)])
            b, n = n, n + 1
            left[:, b], name[b] = full, made
            made += 1
        bins[i], offsets[i] = name[b], limits.tokens - int(left[0, b])
        left[:, b] -= need
        if left[0, b] < max(smallest, 1) or left[1, b] < 1:  # closed: its place goes to the last open bin
            n -= 1
            left[:, b], name[b] = left[:, n], name[n]
    return bins, offsets


def pack(pieces: DataFrame, limits: Limits = Limits(), rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset. Pieces of full length need no packing and fill a sequence each.

    Repeated rows are pieces of their own; an empty table gives no rows.
    """
    rows = saved(pieces.withColumn("tag", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_pieces))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("tag"), F.lit(groups)).cast("int")).drop("tag")
    dealt = dealt.repartition(groups, "group")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None:
            return
        group = table.column("group").to_numpy()
        for g in np.unique(group):
            own = table.filter(pa.array(group == g)).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            bins, offsets = best_fit(own.column("length").to_numpy(), limits, rule)
            out = own.append_column("bin", pa.array(bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
            yield from out.to_batches()

    placed = dealt.mapInArrow(packed, PLACED)
    sequence = F.col("bin") * F.lit(groups) + F.col("group")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, limits: Limits = Limits(), rule: str = "norm", **options) -> DataFrame:
    return pack(cut(docs, limits.tokens, **options), limits, rule)
