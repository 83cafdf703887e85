"""Near-duplicate lines by an exact set-similarity join (operator 3).

A line is the set of its lower-cased blank-separated words. Equal sets collapse first. The words of a set
are ordered by rarity; two sets of Jaccard similarity ``THRESHOLD`` or more share a word among their first few
(prefix filter), lie in a narrow range of sizes (length filter) and share it at places that still leave
enough words behind it (positional filter). What passes is verified on the whole sets. Every line that has a
similar line before it, in order of (doc_id, line number), is removed. Rows that share an id or have none are told
apart by a 64-bit hash of their texts, which stands between the two in that order.

Rarity is the number of occurrences of the words of a hash bucket, counted over all documents; the
table of ``BUCKETS`` bytes is all that is broadcast, and any fixed order keeps the join exact. A word that occurs
once has no partner and is not listed. A 64-bit map holds the parity of each set's words per hash bucket: two
maps differ in no more bits than the sets differ in words, which bounds the overlap of a pair before it leaves
the join.

For the verification a pair is dealt to the cell of one word that both prefixes share. The words of a set are sent
once to each cell in which it has pairs, not along with every pair; a cell with many pairs is cut into a grid by its sets.
The cells are dealt into rounds, each of which sends about as many bytes as the sets have. Links are not written: a cell
passes on the number of links of each of its sets, and whether one leads to an earlier set.

The removal of lines needs no numbers. There each set is verified with the likeliest of its earlier candidates first,
and only the sets that this leaves are verified with the others.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.llm.common import BATCH_ROWS, prepare, saved

THRESHOLD = 0.8
#: Entries of the rarity table, a byte each.
BUCKETS = 1 << 23
#: Pairs of a cell from which it is cut into a grid.
CELL_PAIRS = 1 << 16
#: Most rows and columns of a grid.
GRID = 1 << 15
#: Bytes of words that a round of the verification may send in any case, and the most rounds.
ROUND_BYTES = 64 << 20
ROUNDS = 32
#: 64-bit words of a wide map.
MAP_LONGS = 4
#: Words that a worker counts or remembers at a time.
CACHED_WORDS = 400_000


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8"))


class _Remembered(dict):
    """word -> value, computed once while there is room."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str):
        value = self.compute(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def _lines(text: str | None) -> Iterator[tuple[int, set[str]]]:
    """(line number, set of words) of lines that are not blank."""
    for k, line in enumerate((text or "").lower().split("\n")):
        if words := set(line.split()):
            yield k, words


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Occurrences per hash bucket of words over all documents, as a class of one byte: exact up to 64, then by a
    sixteenth of a power of two. A table of fixed size."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            bucket = np.array([_hash(w) % BUCKETS for w in found], dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(list(found.values()), pa.int64())], names=["bucket", "n"])

        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update((text or "").lower().split())
            if len(found) > CACHED_WORDS:
                yield emit()
                found.clear()
        if found:
            yield emit()

    counted = docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    log = F.least(F.lit(255), F.lit(64) + F.floor(16 * (F.log2("n") - 6)))
    classes = counted.where("n > 1").select("bucket", F.when(F.col("n") <= 64, F.col("n")).otherwise(log).cast("short").alias("n"))
    table = np.ones(BUCKETS, dtype=np.uint8)
    rows = classes.toArrow()  # at most BUCKETS rows
    table[rows.column(0).to_numpy()] = rows.column(1).to_numpy().astype(np.uint8)
    return table


LINES = "doc_id long, version long, line_no int, set_id binary, size int, at int, prefix array<int>, parity long"
#: A word of a sorted set: class of rarity, then hash.
KEY = np.dtype([("rare", "u1"), ("hash", "<i8")])
#: Bits of the filter that names the lines to verify, 1 MB.
WANTED_BITS = 1 << 23


def _version(text_col: str) -> Column:
    """Hash of a row's text; rows of the same id and text count as repeated."""
    return F.xxhash64(F.col(text_col))


def line_sets(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per line that is not blank: doc_id, version, line_no, set_id, size, the keys of its prefix from place ``at`` on
    (rarest first, without those that occur once, as 32 bits of their hashes) and the parity map."""
    table = docs.sparkSession.sparkContext.broadcast(rarity(docs, text_col))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value

        def ordered(word: str) -> bytes:
            h = _hash(word)
            return int(counts[h % BUCKETS]).to_bytes(1, "big") + h.to_bytes(8, "little")

        key = _Remembered(ordered)
        get = key.__getitem__
        for batch in batches:
            ids, versions, places, digests, joined = [], [], [], [], []
            for doc_id, text, version in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for k, words in _lines(text):
                    keys = b"".join(sorted(map(get, words)))
                    ids.append(doc_id)
                    versions.append(version)
                    places.append(k)
                    digests.append(xxhash.xxh3_128_digest(keys))
                    joined.append(keys)
            if not ids:
                continue
            n = np.fromiter(map(len, joined), np.int64, len(joined)) // KEY.itemsize
            flat = np.frombuffer(b"".join(joined), KEY)
            start = np.cumsum(n) - n
            at = np.add.reduceat((flat["rare"] <= 1).astype(np.int64), start)
            last = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            at = np.minimum(at, last)
            place = np.arange(len(flat)) - np.repeat(start, n)
            listed = (place >= np.repeat(at, n)) & (place < np.repeat(last, n))
            offsets = np.concatenate([[0], np.cumsum(last - at)]).astype(np.int32)
            h = np.ascontiguousarray(flat["hash"])
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array((h[listed] >> 32).astype(np.int32)))
            parity = np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), (h & 63).astype(np.uint64)), start).view(np.int64)
            columns = [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(places, pa.int32()), pa.array(digests, pa.binary()), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)), prefix, pa.array(parity)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "line_no", "set_id", "size", "at", "prefix", "parity"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _version(text_col).alias("version"))
    return texts.mapInArrow(sets, LINES)


def candidates(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of class ids that pass the prefix, length, positional and parity filters, with the least key that
    both list and the number of bits in which their maps differ; b has the smaller set or id and is listed under its shorter
    index prefix. Keys are part of a hash: a collision only adds a candidate."""
    t = threshold
    posted = classes.select("id", "size", "parity", F.col("at").alias("skip"), F.posexplode("prefix").alias("at", "key"))
    posted = posted.withColumn("at", F.col("at") + F.col("skip")).drop("skip")
    short = F.col("size") - F.ceil(F.lit(2 * t / (1 + t)) * F.col("size") - 1e-9) + 1
    index = posted.where(F.col("at") < short)
    index = index.select(F.col("id").alias("b"), F.col("size").alias("bs"), F.col("at").alias("bi"), F.col("parity").alias("other"), "key")
    probe = posted.select(F.col("id").alias("a"), F.col("size").alias("as_"), F.col("at").alias("ai"), "parity", "key")
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("as_") + F.col("bs")) - 1e-9)
    most = F.least("ai", "bi") + F.least(F.col("as_") - F.col("ai"), F.col("bs") - F.col("bi"))
    differ = F.bit_count(F.col("parity").bitwiseXOR(F.col("other")))
    bound = (F.col("as_") + F.col("bs") - differ) / 2
    smaller = (F.col("bs") < F.col("as_")) | ((F.col("bs") == F.col("as_")) & (F.col("b") < F.col("a")))
    pairs = probe.join(index, "key").withColumn("differ", differ.cast("byte")).where(smaller & (F.col("bs") >= F.lit(t) * F.col("as_") - 1e-9) & (most >= need) & (bound >= need))
    return pairs.groupBy("a", "b", "as_", "bs").agg(F.min("key").alias("key"), F.min("differ").alias("differ"))


def _in_cells(pairs: DataFrame) -> DataFrame:
    """The candidates with the cell each is verified in: that of its key, or one of a grid of a key with many."""
    many = pairs.groupBy("key").count().where(F.col("count") > CELL_PAIRS)
    grids = many.select("key", F.least(F.lit(GRID), F.ceil(F.sqrt(F.col("count") / CELL_PAIRS))).cast("int").alias("grid"))
    side = F.coalesce("grid", F.lit(1))
    at = [F.pmod(F.xxhash64(c), side).cast("int") for c in ("a", "b")]
    cell = F.shiftleft(F.col("key").cast("long"), 32) + F.shiftleft(at[0], 16) + at[1]
    return pairs.join(F.broadcast(grids), "key", "left").select("a", "b", "as_", "bs", cell.alias("cell"))  # a grid per CELL_PAIRS pairs at most


def _cells_of(pairs: DataFrame) -> DataFrame:
    """(id, cells) of the sets of pairs in cells: a key of its prefix each, or parts of one."""
    ends = pairs.select(F.col("a").alias("id"), "cell").unionAll(pairs.select(F.col("b").alias("id"), "cell"))
    return ends.groupBy("id").agg(F.collect_set("cell").alias("cells"))


def _place_bit(doc_id: int | None, version: int, line_no: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{doc_id},{version},{line_no}") % WANTED_BITS


def _maps(sets: list[bytes]) -> pa.ListArray:
    """Parity of the words per bucket of their hashes, for sets of one word or more."""
    n = np.fromiter(map(len, sets), np.int64, len(sets)) // 8
    h = np.frombuffer(b"".join(sets), np.uint64)
    bit = np.left_shift(np.uint64(1), h & np.uint64(63))
    long = (h >> np.uint64(6)) % np.uint64(MAP_LONGS)
    maps = [np.bitwise_xor.reduceat(np.where(long == k, bit, np.uint64(0)), np.cumsum(n) - n) for k in range(MAP_LONGS)]
    offsets = np.arange(0, MAP_LONGS * len(sets) + 1, MAP_LONGS, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.stack(maps, axis=1).reshape(-1).view(np.int64)))


def _words_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, cells, words, map) of the wanted lines (id, cells, no_id, doc_id, version, line_no): words as 64-bit hashes, and their
    parity per hash bucket in ``MAP_LONGS`` longs.

    A broadcast filter of a fixed size names the lines, so that texts stay where they are read; what
    passes it is joined with the wanted lines exactly.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {_place_bit(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(3)))}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32())], names=["bit"])

    named = wanted.select("doc_id", "version", "line_no").mapInArrow(bits, "bit int").distinct().toArrow()  # at most WANTED_BITS rows
    table = np.zeros(WANTED_BITS, dtype=bool)
    table[named.column(0).to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value)
        key = _Remembered(lambda w: _hash(w) - (1 << 63))
        for batch in batches:
            ids, versions, places, sets = [], [], [], []
            for doc_id, text, version in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for k, line in enumerate((text or "").lower().split("\n")):
                    if table[_place_bit(doc_id, version, k)] and (found := line.split()):
                        ids.append(doc_id)
                        versions.append(version)
                        places.append(k)
                        sets.append(array("q", {key[w] for w in found}).tobytes())
            if ids:
                columns = [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(places, pa.int32()), pa.array(sets, pa.binary()), _maps(sets)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "line_no", "words", "map"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _version(text_col).alias("version"))
    found = texts.mapInArrow(words, "doc_id long, version long, line_no int, words binary, map array<long>")
    return _known(found).dropDuplicates(PLACE).join(wanted, PLACE).select("id", "cells", "words", "map")


#: Columns that name a line, none of them null.
PLACE = ["no_id", "doc_id", "version", "line_no"]


def _known(lines: DataFrame) -> DataFrame:
    return lines.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))


def _verifier(any_earlier: bool):
    """Tallies (id, n_links, late) of the sets of a cell from rows (cell, a, b, need, words) by cell: first its sets (a, words),
    then its pairs by b. Under ``any_earlier`` a set that has an earlier link is compared with no other earlier set."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        sets: dict[int, bytes] = {}
        own: frozenset = frozenset()
        n_links: Counter[int] = Counter()
        late: set[int] = set()
        out: list[tuple[int, int, bool]] = []

        def close() -> None:
            out.extend((x, n, x in late) for x, n in n_links.items())
            n_links.clear()
            late.clear()
            sets.clear()

        def emit() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["id", "n_links", "late"])

        for batch in batches:
            for cell, a, b, need, words in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != now:
                    close()
                    now, last = cell, None
                if b is None:
                    sets[a] = words
                    continue
                later = max(a, b)
                if any_earlier and later in late:
                    continue
                if b != last:
                    last, own = b, frozenset(memoryview(sets[b]).cast("q"))
                if len(own.intersection(memoryview(sets[a]).cast("q"))) >= need:
                    n_links[a] += 1
                    n_links[b] += 1
                    late.add(later)
            if len(out) >= BATCH_ROWS:
                yield emit()
        close()
        if out:
            yield emit()

    return verify


def _tallies(sets: DataFrame, pairs: DataFrame, threshold: float, any_earlier: bool = False) -> DataFrame:
    """(id, n_links, late) of the sets (id, cells, words) that are similar to another one by the pairs (cell, a, b, as_, bs):
    the number of links, and whether one leads to a smaller id."""
    size = F.octet_length("words")
    held, sent = sets.agg(F.sum(size), F.sum(size * F.size("cells"))).first()
    rounds = max(1, min(ROUNDS, -(-(sent or 0) // max(held or 0, ROUND_BYTES))))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("as_") + F.col("bs")) - 1e-9)
    tallies = None
    for k in range(rounds):
        here = F.pmod(F.xxhash64("cell"), F.lit(rounds)) == k
        own = sets.select(F.explode("cells").alias("cell"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("need"), "words")
        both = own.where(here).unionByName(pairs.where(here).select("cell", "a", "b", need.alias("need"), F.lit(None).cast("binary").alias("words")))
        part = both.repartition("cell").sortWithinPartitions("cell", "b").mapInArrow(_verifier(any_earlier), "id long, n_links long, late boolean")
        part = saved(part, "tallies")
        tallies = part if tallies is None else tallies.unionAll(part)
    return tallies.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.max("late").alias("late"))


def _narrowed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose wide maps differ in no more bits than similar sets of their sizes differ in words."""
    own, other = (sets.select(F.col("id").alias(c), F.col("map").alias(f"map_{c}")) for c in ("a", "b"))
    differ = sum((F.bit_count(F.get("map_a", F.lit(k)).bitwiseXOR(F.get("map_b", F.lit(k)))) for k in range(MAP_LONGS)), F.lit(0))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("as_") + F.col("bs")) - 1e-9)
    return pairs.join(own, "a").join(other, "b").where((F.col("as_") + F.col("bs") - differ) / 2 >= need).drop("map_a", "map_b")


def _wanted(classes: DataFrame, cells: DataFrame) -> DataFrame:
    """The first lines of the sets (id, cells), with set_id."""
    return saved(_known(classes.select("id", "set_id", "first.doc_id", "first.version", "first.line_no").join(cells, "id")), "wanted")


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(set_id, n_links, late) of the sets that are similar to others: all candidates are verified on the words of their sets."""
    pairs = saved(_in_cells(pairs), "pairs")
    wanted = _wanted(classes, _cells_of(pairs))
    sets = saved(_words_of(docs, wanted, id_col, text_col), "words")
    return wanted.select("id", "set_id").join(_tallies(sets, pairs, threshold), "id").drop("id")


def _late(docs: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(set_id, n_links, late) of the sets that are similar to an earlier one; n_links is not the whole number.

    The candidate whose map differs least comes first, in the cell of the earlier set. The sets that are not
    similar to it are verified with all others, of which wide maps of the words leave those that may be similar.
    """
    later, earlier = F.greatest("a", "b"), F.least("a", "b")
    columns = ["a", "b", "as_", "bs"]
    best = pairs.groupBy(later.alias("later")).agg(F.min_by(F.struct(*columns), F.struct("differ", earlier)).alias("p")).select("p.*")
    best = saved(_in_cells(best.withColumn("key", F.hash(earlier))), "pairs")
    all_ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = _wanted(classes, all_ids.join(_cells_of(best), "id", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<bigint>"))))
    sets = saved(_words_of(docs, wanted, id_col, text_col), "words")
    found = saved(_tallies(sets, best, threshold, True).where("late"), "late")

    rest = pairs.withColumn("later", later).join(found.select(F.col("id").alias("later")), "later", "left_anti").drop("later")
    rest = _narrowed(rest.join(best.select("a", "b"), ["a", "b"], "left_anti"), sets, threshold)
    rest = saved(_in_cells(rest), "pairs")
    sets = saved(sets.drop("cells").join(_cells_of(rest), "id").select("id", "cells", "words"), "words")
    found = found.unionAll(_tallies(sets, rest, threshold, True).where("late"))
    return wanted.select("id", "set_id").join(found, "id").drop("id")


def _marks(docs: DataFrame, threshold: float, id_col: str, text_col: str, count: bool) -> DataFrame:
    """The rows of ``mark_lines`` with the hash of the row's text (version); n_links is whole only under ``count``."""
    lines = saved(line_sets(docs, threshold, id_col, text_col), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version", "line_no")
    classes = lines.groupBy("set_id").agg(F.min(place).alias("first"), *[F.first(c).alias(c) for c in ("size", "at", "prefix", "parity")])
    classes = saved(classes.orderBy("first").withColumn("id", F.monotonically_increasing_id()), "classes")  # ids in the order of first lines
    pairs = saved(candidates(classes, threshold), "candidates")

    linked = (_linked if count else _late)(docs, classes, pairs, threshold, id_col, text_col)
    named = classes.select("set_id", "first").join(linked, "set_id", "left")
    out = lines.select("doc_id", "version", "line_no", "set_id", "size").join(named, "set_id")
    late = F.coalesce("late", F.lit(False))
    return out.select("doc_id", "version", "line_no", "size", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (late | (place != F.col("first"))).alias("removed"))


def mark_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that is not blank: doc_id, line_no, size, class_doc_id, class_line_no, n_links, removed.

    The class of a line is named by its first line of the same words; n_links counts the other classes that are
    similar. Blank lines take no part and stay. Rows without an id come last; of repeated rows the
    lines count once, and the lines of a repeated row are not removed for being equal to themselves. Null and
    empty texts and empty tables give no rows.
    """
    return _marks(docs, threshold, id_col, text_col, count=True).drop("version")


def remove_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, the text without its removed lines. A document of which no word is left goes; one that had none stays."""
    marks = _marks(docs, threshold, id_col, text_col, count=False).where("removed")
    gone = marks.groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).agg(F.collect_set("line_no").alias("_gone"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (_version(text_col) == F.col("_version"))
    joined = docs.join(gone, same, "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, k: ~F.array_contains("_gone", k)), "\n")
    cleaned = joined.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(left))
    return cleaned.where(F.col("_gone").isNull() | F.col(text_col).rlike("\\S")).select(*docs.columns)
