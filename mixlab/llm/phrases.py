"""Phrase collocations counted by double-array tries (operator 12).

A pass over the texts counts all words per language and writes the texts as sequences of 64-bit word hashes (XXH64; a
collision between any two words of the corpus is looked for, and the pass repeated under another seed if there is
one). Then there is one more pass for each length from two words up:

1. Phrases whose parts are all frequent (Apriori) are added up in the task that reads them and dealt out by a 64-bit hash
   into parts; the number of parts follows the number of words. The filter of frequent phrases is a bit table, so it may
   let more through, never less.
2. In a part, the occurrences are counted into buckets of the whole hash. A phrase in a bucket below the minimum cannot be
   frequent; the different phrases of the others are the candidates.
3. Candidates are put in double-array tries of a bounded size (``TRIE_PHRASES``). numpy moves the states of all phrases of
   the part on together, word by word, and adds their occurrences up by accepting state. That count is exact and decides.

No phrase passes the driver, and the number of passes does not depend on the number of candidates.
Per language and phrase, the scores are exact in decimals.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlab.llm.common import BATCH_BYTES, prepare, saved

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
#: A phrase goes if a longer candidate around it has this percentage of its occurrences.
COVERED_PERCENT = 50
#: Languages of texts without one.
NO_LANG = "und"
#: Phrases of two words in a trie, a third of that for three; the candidates of a part take as many tries as they need.
TRIE_PHRASES = 500_000
#: Words of the texts to a part of the phrases; more than ``MANY_PARTS`` parts only if each of them has ``MOST_WORDS``.
PART_WORDS = 1 << 19
MANY_PARTS = 1 << 12
MOST_WORDS = 1 << 21
#: Places that a worker adds up before it deals them out.
HELD_PLACES = 1 << 21
#: Bits of the filter of frequent phrases, at least and at most: 16 or more to a phrase in between.
FILTER_BITS = 1 << 25
MOST_BITS = 1 << 28
BLOCK = 1 << 16
#: Characters read together by a worker: more texts repeat more words.
READ_CHARS = 1 << 20
#: Different words that a worker counts before it passes the counts on; they are Python objects.
HELD_WORDS = 100_000
#: Phrases that a worker holds in arrays before it passes them on.
CACHED_WORDS = 200_000
#: Piece ends and blanks, A-Z in lower case.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _tokens(texts: list[str]) -> Iterator[pa.DictionaryArray]:
    """Words of texts as dictionary arrays; "." stands for every end of a piece or text, and "" may stand beside it."""
    joined = " . ".join(texts).encode("utf-8").translate(_FOLD).replace(b".", b" . ")
    for a, b in _cuts(joined):
        words = pc.ascii_split_whitespace(pa.array([joined[a:b]], pa.binary()).cast(pa.string())).flatten()
        yield words.cast(pa.binary()).dictionary_encode()


def _cuts(text: bytes, size: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end at a blank."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield at, end
        at = end


SEQUENCES = "lang string, codes binary, word string, n long"


def _read_texts(docs: DataFrame, seed: int, lang_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: sequences (lang, codes: 64-bit hashes of the words in order, 0 between pieces) and counts of a task (lang, word, n)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(langs, codes, words, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(codes, pa.binary()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "codes", "word", "n"])

        def read_held() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                place, codes, counts = found.setdefault(lang, ({}, array("Q"), array("q")))
                for chunk in _tokens(texts):
                    words = chunk.dictionary.to_pylist()
                    at = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
                    for w in (words[k] for k in np.flatnonzero(at >= len(codes)).tolist()):  # new words, in the order of their places
                        codes.append(xxhash.xxh64_intdigest(w, seed) if w.strip(b".") else 0)
                        counts.append(0)
                    places = chunk.indices.to_numpy()
                    np.frombuffer(counts, np.int64)[at] += np.bincount(places, minlength=len(words))
                    yield row([lang], [np.frombuffer(codes, np.uint64)[at][places].tobytes()], [None], [None])

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, (place, _, counts) in found.items():
                words = [w for w in place if w.strip(b".")]
                if words:
                    yield row([lang] * len(words), [None] * len(words), words, [counts[place[w]] for w in words])

        held: dict[str, list] = {}
        found: dict[str, tuple[dict, array, array]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size > READ_CHARS:
                    yield from read_held()
                    held.clear()
                    size = 0
                    pa.default_memory_pool().release_unused()
            if sum(len(x[0]) for x in found.values()) > HELD_WORDS:
                yield from emit()
                found.clear()
        yield from read_held()
        yield from emit()

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(read, SEQUENCES)


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, word, code, n) of all words and the written (lang, codes) of all texts; no two words share a code and none has code 0."""
    prepare(docs.sparkSession)
    for seed in (42, 43, 44, 45):
        rows = saved(_read_texts(docs, seed, lang_col, text_col), "sequences")
        counted = rows.where("codes IS NULL").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        words = saved(counted.mapInArrow(_coded(seed), "lang string, word string, n long, code long"), "words")
        first = words.groupBy("code").agg(F.min("word").alias("least"), F.max("word").alias("most"))
        if first.where("code = 0 OR least <> most").isEmpty():
            return words, rows.where("codes IS NOT NULL").select("lang", "codes")
    raise RuntimeError("words collide under four seeds")


def _coded(seed: int):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8"), seed) for w in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64))], names=["lang", "word", "n", "code"])

    return coded


def _key_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8"), 1))


def _keys(lang: str, codes: np.ndarray, words: int) -> np.ndarray:
    """Hash of the phrase of ``words`` words that starts at each place."""
    n = max(0, len(codes) - words + 1)
    key = np.full(n, _key_of(lang))
    for k in range(words):
        key = (key ^ codes[k : k + n]) * _GOLD
        key ^= key >> np.uint64(31)
    return key


def _phrase_keys(lang: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The same hash of given phrases (a language and a row of codes each)."""
    named, inverse = np.unique(lang, return_inverse=True)
    return _hashed(np.array([_key_of(x) for x in named], dtype=np.uint64)[inverse], codes)


def _hashed(key: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The same hash of rows of codes, from the keys of their languages."""
    for k in range(codes.shape[1]):
        key = (key ^ codes[:, k]) * _GOLD
        key ^= key >> np.uint64(31)
    return key


def _place(key: np.ndarray, size: int) -> np.ndarray:
    return (key >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of codes from a binary column of equal lengths."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64).reshape(len(column), -1)


def _runs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows of numbers as a binary column: a row from each place of ``first`` to the next one."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    ends = (np.append(first, len(values)) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _starts(values: np.ndarray) -> np.ndarray:
    """Places at which a run of equal values begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)


def _filter(frequent: DataFrame) -> np.ndarray:
    """Bit table of frequent phrases (lang, codes binary): ``FILTER_BITS`` to ``MOST_BITS`` bits."""
    size = min(MOST_BITS, max(FILTER_BITS, 1 << (16 * frequent.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            at = np.unique(np.concatenate(held))
            first = _starts(at // BLOCK)
            return pa.RecordBatch.from_arrays([pa.array((at[first] // BLOCK).astype(np.int32)), _runs((at % BLOCK).astype(np.uint16), first)], names=["block", "at"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_place(_phrase_keys(batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))), size))
                n += batch.num_rows
            if n > CACHED_WORDS:
                yield emit()
                held, n = [], 0
        if held:
            yield emit()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0)

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total, bitorder="little").tobytes()])], names=["block", "bits"])

        for batch in batches:
            for block, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != now:
                    if now is not None:
                        yield emit()
                    now, total = block, np.zeros(BLOCK, dtype=bool)
                total[np.frombuffer(at, np.uint16)] = True
        if now is not None:
            yield emit()

    blocks = frequent.select("lang", "codes").mapInArrow(places, "block int, at binary").repartition("block").sortWithinPartitions("block")
    table = np.zeros(size >> 3, dtype=np.uint8)
    for row in blocks.mapInArrow(add, "block int, bits binary").collect():  # MOST_BITS / 8 bytes in all
        table[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return table


def _safe(lang: str, codes: np.ndarray, words: int, parts: np.ndarray) -> np.ndarray:
    """Places where a phrase of ``words`` words within a piece starts both of whose parts of one word less pass the filter."""
    n = len(codes) - words + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    part = _bit(parts, _place(_keys(lang, codes, words - 1), 8 * len(parts)))
    good = part[:-1] & part[1:]
    for k in range(words):
        good &= codes[k : k + n] != 0
    return np.flatnonzero(good)


def _summed(key: np.ndarray, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases (hash, row of codes, occurrences) in the order of their hashes, equal neighbours added up; phrases of one hash stay apart."""
    order = np.argsort(key)
    key, rows, n = key[order], rows[order], n[order]
    other = key[1:] != key[:-1]
    for k in range(rows.shape[1]):
        other |= rows[1:, k] != rows[:-1, k]
    first = np.flatnonzero(np.append(True, other))
    return key[first], rows[first], np.add.reduceat(n, first)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """Part of a phrase's hash, not falling as the hash grows."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _dealt(sequences: DataFrame, words: int, frequent, parts: int) -> DataFrame:
    """(part, lang, codes, counts): the Apriori-safe phrases of ``words`` words, a row of codes each, with their occurrences in what a task held."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def add_up() -> int:
            for lang, some in held.items():
                held[lang] = [_summed(*map(np.concatenate, zip(*some)))]
            return sum(len(x[0][0]) for x in held.values())

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, ((key, rows, n),) in held.items():
                part = _part(key, parts)
                first = _starts(part)
                step = max(1, len(first) * BATCH_BYTES // (rows.nbytes + n.nbytes))
                for a in range(0, len(first), step):
                    own = first[a : a + step]
                    end = first[a + step] if a + step < len(first) else len(part)
                    at = own - own[0]
                    yield pa.RecordBatch.from_arrays([pa.array(part[own]), pa.array([lang] * len(own), pa.string()), _runs(rows[own[0] : end], at), _runs(n[own[0] : end], at)], names=["part", "lang", "codes", "counts"])

        for batch in batches:
            for lang, codes in zip(batch.column(0), batch.column(1)):
                lang, x = lang.as_py(), np.frombuffer(codes.as_buffer(), np.uint64)
                at = _safe(lang, x, words, frequent.value)
                if len(at):
                    own = _summed(_keys(lang, x, words)[at], np.stack([x[at + k] for k in range(words)], axis=1), np.ones(len(at), dtype=np.int64))
                    held.setdefault(lang, []).append(own)
                    size += len(own[0])
                if size > HELD_PLACES:
                    size = add_up()
                    if 2 * size > HELD_PLACES:
                        yield from emit()
                        held.clear()
                        size = 0
        add_up()
        yield from emit()

    return sequences.mapInArrow(deal, "part int, lang string, codes binary, counts binary")


@dataclass
class Trie:
    """A double array over word numbers: the child of a state s by word w is t = base[s] + w if check[t] = s."""

    words: np.ndarray  # sorted word codes
    number: np.ndarray  # of each word: frequent last words have small ones, so that families of children lie close
    roots: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    accepting: np.ndarray  # state of each phrase

    def states(self, lang: str, codes: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
        """States reached by the ``length`` words from the places ``at`` on, where there is such a path."""
        return self.walk(lang, codes, length, at)[1]

    def walk(self, lang: str, codes: np.ndarray, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``at`` from which there is such a path, and the states reached."""
        if lang not in self.roots or not len(self.words):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        state = np.full(len(at), self.roots[lang], dtype=np.int64)
        for k in range(length):
            word = codes[at + k]
            found = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            to = self.base[state] + self.number[found]
            good = (self.words[found] == word) & (self.check[to] == state)
            at, state = at[good], to[good]
        return at, state


def build_trie(lang: np.ndarray, codes: np.ndarray) -> Trie:
    """The trie of given phrases: a language and a row of word codes each."""
    words, inverse = np.unique(codes, return_inverse=True)
    inverse = inverse.reshape(codes.shape)
    times = np.bincount(inverse[:, -1], minlength=len(words))  # last words first: theirs are the most families
    ranks = np.empty(len(words), dtype=np.int32)
    ranks[np.argsort(-times, kind="stable")] = np.arange(len(words))
    number = ranks[inverse]
    langs, at = np.unique(lang, return_inverse=True)
    width = len(words)
    size = 2 * width + len(langs) + 2 * codes.size + 64
    base, check, used = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool)

    def grow(least: int) -> None:
        nonlocal base, check, used
        if least > len(base):
            more = max(least, len(base) * 3 // 2) - len(base)
            base, check, used = np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32)), np.append(used, np.zeros(more, bool))

    def place(own: np.ndarray) -> int:
        """A base at which the places of all children are free: in one of some windows, else behind all that is used."""
        low = len(langs)
        for window in (*[1 << 10] * 8, *[1 << 13] * 4, 1 << 16):
            at = low + int(pick.integers(max(1, top - low - window)))
            grow(at + window + int(own[-1]) + 1)
            taken = np.zeros(window, dtype=bool)
            for k, c in enumerate(own.tolist()):
                taken |= used[at + c : at + c + window]
                if k & 31 == 31 and taken.all():
                    break
            if not taken.all():
                return at + int(taken.argmin())
        grow(top + int(own[-1]) + 1)
        return top

    pick = np.random.default_rng(len(words))
    used[: len(langs)] = True
    state, free, top = at.astype(np.int64), len(langs), len(langs)  # roots are the first states
    for level in range(codes.shape[1]):
        edge, inverse = np.unique(state * width + number[:, level], return_inverse=True)
        parent, child = edge // width, edge % width
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        degree = np.diff(np.append(first, len(parent)))
        for k in np.argsort(-degree, kind="stable"):  # large families first
            if degree[k] == 1:
                break
            own = child[first[k] : first[k] + degree[k]]
            b = place(own)
            base[parent[first[k]]] = b
            used[b + own], check[b + own] = True, parent[first[k]]
            top = max(top, b + int(own[-1]) + 1)
        while used[free]:
            free += 1
        alone = first[degree == 1]  # an only child takes any free place from its number on
        if len(alone):
            alone = alone[np.argsort(child[alone], kind="stable")]
            places = np.flatnonzero(~used[free:])[: len(alone) + width] + free
            if len(places) < len(alone) + width:
                grow(len(base) + len(alone) + width)
                places = np.flatnonzero(~used[free:])[: len(alone) + width] + free
            take = places[len(places) - len(alone) :] if places[0] < child[alone[-1]] else places[: len(alone)]
            base[parent[alone]] = take - child[alone]
            used[take], check[take] = True, parent[alone]
            top = max(top, int(take[-1]) + 1)
        state = (base[parent].astype(np.int64) + child)[inverse]
    end = top + width + 1
    grow(end)
    return Trie(words, ranks, {x: k for k, x in enumerate(langs.tolist())}, base[:end], check[:end], state.astype(np.int32))


def _by_trie(names: list[str], lang: np.ndarray, rows: np.ndarray, n: np.ndarray, min_count: int) -> pa.RecordBatch:
    """(lang, codes, n) of the phrases that occur ``min_count`` times among dealt ones: numbers of languages, rows of codes, occurrences, in the order of their hashes."""
    words = rows.shape[1]
    other = lang[1:] != lang[:-1]
    for k in range(words):
        other |= rows[1:, k] != rows[:-1, k]
    first = np.flatnonzero(np.append(True, other))
    trie = build_trie(lang[first], rows[first])
    order = np.argsort(trie.accepting)
    accepting = trie.accepting[order]
    total = np.zeros(len(order), dtype=np.int64)  # a count a phrase: the states of a trie are many more
    for x in trie.roots:
        own = np.flatnonzero(lang == x)
        at, state = trie.walk(x, rows[own].ravel(), words, words * np.arange(len(own)))
        np.add.at(total, np.searchsorted(accepting, state), n[own[at // words]])
    seen = np.flatnonzero(total >= min_count)
    found = first[order[seen]]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang[found])), _runs(rows[found], np.arange(len(found))), pa.array(total[seen])], names=["lang", "codes", "n"])


def _counted(sequences: DataFrame, words: int, min_count: int, frequent, parts: int) -> DataFrame:
    """(lang, codes, n) of the phrases of ``words`` words that occur ``min_count`` times: their exact number, by tries."""
    if min_count < 1:
        raise ValueError("a minimum count is 1 at least")
    most = max(1, 2 * TRIE_PHRASES // words // (words - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        now = None

        def of_part() -> Iterator[pa.RecordBatch]:
            names = list(held)
            own = [np.frombuffer(b"".join(held[x][0]), np.uint64).reshape(-1, words) for x in names]
            key = np.concatenate([_hashed(np.full(len(x), _key_of(name)), x) for name, x in zip(names, own)])
            lang = np.repeat(np.arange(len(names)), [len(x) for x in own])
            rows = np.concatenate(own)
            n = np.frombuffer(b"".join(b for x in names for b in held[x][1]), np.int64)
            order = np.argsort(key)
            first = _starts(key[order])
            sizes = np.diff(np.append(first, len(key)))
            hot = np.add.reduceat(n[order], first) >= min_count  # a bucket has one phrase, or a few of one hash
            order = order[np.repeat(hot, sizes)]
            trie = np.repeat(np.arange(hot.sum()) // most, sizes[hot])
            for some in np.split(order, _starts(trie)[1:]):
                if len(some):
                    yield _by_trie(names, lang[some], rows[some], n[some], min_count)

        for batch in batches:
            for part, lang, codes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if held:
                        yield from of_part()
                        held.clear()
                    now = part
                own = held.setdefault(lang, ([], []))
                own[0].append(codes)
                own[1].append(counts)
        if held:
            yield from of_part()

    dealt = _dealt(sequences, words, frequent, parts).repartition("part").sortWithinPartitions("part")
    return saved(dealt.mapInArrow(count, "lang string, codes binary, n long"), "phrases")


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, codes, n) of all phrases of up to ``max_words`` words that occur ``min_count`` times, (lang, word, code, n) of the frequent words, and (lang, total)."""
    words, sequences = word_counts(docs, lang_col, text_col)
    sc = docs.sparkSession.sparkContext
    frequent = words.where(F.col("n") >= min_count)
    binary = F.col("code").cast("long")
    level = saved(frequent.mapInArrow(_as_codes, "lang string, codes binary, n long"), "phrases")
    found = level
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = max(1, min(MANY_PARTS, -(-total // PART_WORDS)), total // MOST_WORDS)
    for length in range(2, max_words + 1):
        bits = sc.broadcast(_filter(level))
        level = _counted(sequences, length, min_count, bits, parts)
        found = found.unionByName(level)
        bits.destroy()
    return found, frequent.select("lang", "word", binary.alias("code"), "n"), words.groupBy("lang").agg(F.sum("n").alias("total"))


def _as_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column(3).to_numpy().astype("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(2)], names=["lang", "codes", "n"])


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The candidates that no longer candidate covers: lang, phrase, words, a, l, r, n (all words of the language), score.

    ``score`` is floor(1000000 a a / (l r)) of the cut that scores lowest, the earliest of several. A-Z is lower-cased; pieces
    end at ``[.,;:!?]`` and line ends, words at spaces and tabs. Null texts are empty, null languages are ``und``.
    Repeated rows count each time; other columns are not read. Empty tables give no rows.
    """
    found, words, totals = frequent_phrases(docs, max_words, min_count, lang_col, text_col)
    length = (F.octet_length("codes") / 8).cast("int")
    counts = found.select("lang", F.col("codes").alias("part"), F.col("n").alias("f"))
    phrases = found.select("lang", "codes", length.alias("words"), F.col("n").alias("a")).where("words > 1")

    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = phrases.select("*", cut.alias("k")).select("*", F.substring("codes", F.lit(1), 8 * F.col("k")).alias("first"), F.substring("codes", 8 * F.col("k") + 1, 8 * (F.col("words") - F.col("k"))).alias("rest"))
    both = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = both.join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = [F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")]
    score = F.expr("CAST(1000000 AS DECIMAL(7,0)) * big * big div (le * ri)")
    scored = both.select("lang", "codes", "words", "a", "l", "r", "k", exact[0].alias("big"), exact[1].alias("le"), exact[2].alias("ri")).withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "codes").agg(F.min(F.struct("score", "k", "words", "a", "l", "r")).alias("s")).select("lang", "codes", "s.*")

    inner = F.explode(F.expr("flatten(transform(sequence(2, words - 1), s -> transform(sequence(0, words - s), i -> substring(codes, 8 * i + 1, 8 * s))))"))
    around = phrases.where("words > 2").select("lang", inner.alias("codes"), F.col("a").alias("longer")).groupBy("lang", "codes").agg(F.max("longer").alias("longer"))
    kept = best.join(around, ["lang", "codes"], "left").where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * covered_percent)

    spelled = kept.withColumn("code", F.expr("transform(sequence(0, words - 1), i -> substring(codes, 8 * i + 1, 8))"))
    names = words.mapInArrow(_names, "lang string, code binary, word string")
    for k in range(max_words):
        names_k = names.select("lang", F.col("code").alias(f"c{k}"), F.col("word").alias(f"w{k}"))
        spelled = spelled.withColumn(f"c{k}", F.get("code", F.lit(k))).join(names_k, ["lang", f"c{k}"], "left")
    phrase = F.concat_ws(" ", *[F.col(f"w{k}") for k in range(max_words)])
    return spelled.join(totals, "lang").select("lang", phrase.alias("phrase"), "words", "a", "l", "r", F.col("total").alias("n"), "score")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column(2).to_numpy().astype("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["lang", "code", "word"])


def top(scored: DataFrame, n: int = TOP, salts: int = 64) -> DataFrame:
    """The first ``n`` of each language by score and a (descending) and phrase, with their rank from 1; a language is ranked in ``salts`` parts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    few = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= n)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= n)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
