"""Document fingerprints by SimHash and a search of all fingerprints within a Hamming radius (operator 11, DataFrame functions only).

A term is a pair of adjacent words (a text of one word: that word). Each occurrence votes on every one of the 128 bits of the
term's two hashes, for or against, with the term's weight: its length in characters, at most 15, as long terms are
rarer. The sign of a bit's votes is the fingerprint's bit. Votes against need no counting: they are the total weight
less the votes for it. Votes for are summed four bits to a long, 16 bits a lane, over blocks of at most ``BLOCK_TERMS``
terms, so that no lane overflows; the blocks of a text are added up in lanes of 32 bits. No text is gathered for that:
its terms stay in the task that reads it.

The search splits the bits into eight blocks. Fingerprints within ``RADIUS`` bits agree in at least two of them, so for every pair of
blocks a table is dealt out by the two blocks (the permutation that puts them first) and joined on them; a pair is verified
and reported in its first common table only. Only different fingerprints are joined, with the number of rows of each.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlab.llm.common import prepare, saved

#: Terms of a text whose votes are summed in 16 bits: BLOCK_TERMS * MAX_WEIGHT < 2 ** 15, as a long has a sign.
BLOCK_TERMS = 2048
MAX_WEIGHT = 15
WORDS = 2  # 64-bit words of a fingerprint
BITS = 64 * WORDS
RADIUS = 6
#: Documents with an id divisible by this are the queries of the search.
QUERY_STEP = 50
#: Characters of the texts that stand together in a bucket of the order by id, on average, and buckets at most.
BUCKET_CHARS = 8 << 20
MAX_BUCKETS = 1 << 14
_SPREAD, _LANES, _HALVES = 0x0000200040008001, 0x0001000100010001, 0x0000FFFF0000FFFF


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _hash(term: list[Column], k: int) -> Column:
    """The k-th 64-bit hash of a term."""
    return F.xxhash64(*term) if k == 0 else F.xxhash64(F.lit(k), *term)


def _votes(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Per text and block of terms: the total weight and the votes for each bit, 16 bits each, in ``16 * WORDS`` longs."""
    words = _words(F.col(text_col))
    split = texts.select(*keys, words.alias("_x")).withColumn("_y", F.slice("_x", 2, F.greatest(F.lit(1), F.size("_x"))))
    terms = split.select(*keys, F.posexplode_outer(F.arrays_zip("_x", "_y")).alias("_at", "_t"), F.size("_x").alias("_n"))
    term = [F.col("_t._x"), F.col("_t._y")]
    weight = F.least(F.lit(MAX_WEIGHT), F.length(term[0]) + F.coalesce(F.length(term[1]), F.lit(0))).cast("long")
    # the last word of several begins no pair
    counts = term[0].isNotNull() & (term[1].isNotNull() | (F.col("_n") == 1))
    hashed = terms.select(*keys, F.coalesce(F.floor(F.col("_at") / BLOCK_TERMS), F.lit(0)).alias("_block"), F.when(counts, weight).otherwise(0).alias("_weight"), *[_hash(term, k).alias(f"_h{k}") for k in range(WORDS)])
    sums = [F.sum("_weight").alias("_total")]
    for k in range(WORDS):
        for nibble in range(16):
            four = F.shiftrightunsigned(f"_h{k}", 4 * nibble).bitwiseAND(F.lit(15))
            lanes = (four * F.lit(_SPREAD)).bitwiseAND(F.lit(_LANES)) * F.col("_weight")
            sums.append(F.sum(lanes).alias(f"_v{16 * k + nibble}"))
    return hashed.groupBy(*keys, "_block").agg(*sums)


def _from_votes(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the fingerprint's words ``_f0``, ``_f1``: a bit is 1 if more than half of the weight voted for it."""
    sums = [F.sum("_total").alias("_total")]
    for v in range(16 * WORDS):  # lanes 0 and 2 stay, lanes 1 and 3 move down
        sums += [F.sum(F.col(f"_v{v}").bitwiseAND(F.lit(_HALVES))).alias(f"_a{v}"), F.sum(F.shiftrightunsigned(f"_v{v}", 16).bitwiseAND(F.lit(_HALVES))).alias(f"_b{v}")]
    added = votes.groupBy(*keys).agg(*sums)
    prints = []
    for k in range(WORDS):
        word = F.lit(0).cast("long")
        for nibble in range(16):
            v = 16 * k + nibble
            for lane, (side, shift) in enumerate((("_a", 0), ("_b", 0), ("_a", 32), ("_b", 32))):
                n = F.shiftrightunsigned(f"{side}{v}", shift).bitwiseAND(F.lit(0xFFFFFFFF))
                word = word.bitwiseOR(F.when(2 * n > F.col("_total"), F.shiftleft(F.lit(1).cast("long"), 4 * nibble + lane)).otherwise(F.lit(0).cast("long")))
        prints.append(word.alias(f"_f{k}"))
    return added.select(*keys, *prints)


def _hex(prefix: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f"{prefix}{k}"), 16, "0") for k in reversed(range(WORDS))]))


def _likeness(a: str, b: str) -> Column:
    differ = sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(WORDS)), F.lit(0))
    return F.lit(1.0) - differ.cast("double") / BITS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, f0, f1) per different (id, text): the fingerprint's 128 bits as two longs.

    Null and empty texts have fingerprint zero. Equal texts have equal fingerprints. Rows without an id take part.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), text.alias("_text")).dropDuplicates(["doc_id", "text_sha256"])
    keys = ["doc_id", "text_sha256"]
    return _from_votes(saved(_votes(rows, keys, "_text"), "votes"), keys).select(*keys, *[F.col(f"_f{k}").alias(f"f{k}") for k in range(WORDS)])


def _block(k: int) -> Column:
    """The k-th of eight blocks of 16 bits."""
    return F.shiftrightunsigned(f"f{k // 4}", 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))


def near(queries: DataFrame, table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of different fingerprints (columns f0, f1 of ``queries``, g0, g1 of ``table``) that differ in at most ``radius`` bits.

    Both tables hold different fingerprints in f0 and f1; a fingerprint is not paired with itself. ``radius`` may be up to 6.
    """
    if not 0 <= radius <= 6:
        raise ValueError("two of eight blocks agree up to a radius of 6")
    tables = list(combinations(range(8), 2))
    entries = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.shiftleft(_block(i), 16).bitwiseOR(_block(j)).alias("key")) for t, (i, j) in enumerate(tables)]))
    asked = queries.select("f0", "f1", entries.alias("e")).select("f0", "f1", "e.t", "e.key")
    held = table.select("f0", "f1", entries.alias("e")).select(F.col("f0").alias("g0"), F.col("f1").alias("g1"), "e.t", "e.key")
    x = [F.col(f"f{k}").bitwiseXOR(F.col(f"g{k}")) for k in range(2)]
    bits = F.bit_count(x[0]) + F.bit_count(x[1])
    equal = [F.shiftrightunsigned(x[k // 4], 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF)) == 0 for k in range(8)]
    first = F.coalesce(*[F.when(equal[i] & equal[j], F.lit(t)) for t, (i, j) in enumerate(tables)])
    # merged: Spark sizes entries like the fingerprints before the explode, 28 times too low, and would broadcast them
    return asked.hint("merge").join(held, ["t", "key"]).where((bits > 0) & (bits <= radius) & (first == F.col("t"))).select("f0", "f1", "g0", "g1", bits.alias("bits"))


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a bucket: the buckets follow descending id (rows without one last), and each also holds a copy of the
    first row of the bucket behind it (``_copy``), the last one that of the first.

    Edges are quantiles of the id; an id that fills a bucket, and rows without an id, are spread by the hash of their texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), F.sha2(text, 256).alias("_sha"))
    size = base.agg(F.sum(F.length("_text").cast("long"))).first()[0] or 0
    n = int(min(MAX_BUCKETS, max(1, -(-size // BUCKET_CHARS))))
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    probs = [k / n for k in range(1, n)] or [0.5]
    found = base.agg(F.percentile_approx("doc_id", probs, 100 * n)).first()[0] or []  # MAX_BUCKETS numbers at most
    edges = F.lit(found) if found else F.array().cast("array<bigint>")
    low = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda acc, s: F.when((acc + s <= F.size(edges)) & (F.get(edges, acc + s - 1) < F.col("doc_id")), acc + s).otherwise(acc))
    hot = F.col("doc_id").isNull() | (F.get(edges, F.col("_e")) == F.col("doc_id")) & (F.get(edges, F.col("_e") + 1) == F.col("doc_id"))
    part = F.when(F.coalesce(hot, F.lit(False)), F.conv(F.substring("_sha", 1, 2), 16, 10).cast("int") + 1).otherwise(0)
    placed = base.withColumn("_e", F.when(F.col("doc_id").isNull(), -1).otherwise(low)).withColumn("_part", part)
    # the id of an edge is the largest of its bucket
    keyed = placed.withColumn("_bucket", F.struct((-F.col("_e")).alias("e"), (F.col("_part") == 0).alias("s"), F.col("_part").alias("p")))
    order = F.struct(F.col("doc_id").isNull().alias("x"), (-F.col("doc_id")).alias("y"), F.col("_sha").alias("z"))
    firsts = keyed.groupBy("_bucket").agg(F.min(order).alias("_first"))
    line = Window.orderBy("_bucket")  # a row a bucket
    to = F.coalesce(F.lag("_bucket").over(line), F.max("_bucket").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    before = firsts.select("_first", F.col("_bucket").alias("_own"), to.alias("_to"))
    found = keyed.withColumn("_order", order).join(F.broadcast(before), F.col("_bucket") == F.col("_own"))
    copies = F.when(F.col("_order") == F.col("_first"), F.array(F.struct(F.lit(0).alias("copy"), F.col("_bucket").alias("b")), F.struct(F.lit(1).alias("copy"), F.col("_to").alias("b")))).otherwise(F.array(F.struct(F.lit(0).alias("copy"), F.col("_bucket").alias("b"))))
    return found.select("doc_id", "_text", "_sha", F.explode(copies).alias("_c")).select("doc_id", "_text", "_sha", F.col("_c.b").alias("_bucket"), F.col("_c.copy").alias("_copy"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its text, the edited text (its last half replaced by the beginning of the next row's text) and its place in the order.

    The order is by descending id, then by the SHA-256 of the text; rows without an id come last; behind the last row
    comes the first. Repeated rows follow each other.
    """
    rows = _ordered(docs, id_col, text_col)
    order = Window.partitionBy("_bucket").orderBy("_copy", F.col("doc_id").desc_nulls_last(), "_sha")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    new = F.concat(F.substring("_text", F.lit(1), n - half), F.substring(F.coalesce(F.lead("_text").over(order), F.lit("")), F.lit(1), half))
    return rows.select("doc_id", "_text", "_sha", "_bucket", "_copy", F.row_number().over(order).alias("_row"), new.alias("_edited"), n.cast("long").alias("n_chars"))


def compare(docs: DataFrame, radius: int = RADIUS, query_step: int = QUERY_STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (32 hex digits), near_edited, near_next
    (share of equal bits with the edited text's fingerprint and the next row's), class_id (smallest id of the same
    fingerprint) and, for ids divisible by ``query_step``, n_near: the other rows within ``radius`` bits, equal fingerprints included.

    Null texts are empty; empty texts have fingerprint zero. Rows without an id come last in the order and never name a class
    unless no member has an id. Repeated rows each give a row. Other columns are not read. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    keys = ["_bucket", "_copy", "_row", "_kind", "doc_id", "n_chars", "_esha"]
    rows = edited(docs, id_col, text_col)
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("_text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("_edited").alias("text")))
    texts = rows.withColumn("_esha", F.unhex(F.sha2("_edited", 256))).select("_bucket", "_copy", "_row", "doc_id", "n_chars", "_esha", F.explode(both).alias("_b"))
    texts = texts.where((F.col("_copy") == 0) | (F.col("_b.kind") == 0))
    votes = saved(_votes(texts.select(*[c for c in keys if c != "_kind"], F.col("_b.kind").alias("_kind"), F.col("_b.text").alias("_t")), keys, "_t"), "votes")
    prints = _from_votes(votes.repartition("_bucket"), keys)  # all that follows stays with its bucket
    per = prints.groupBy("_bucket", "_copy", "_row", "doc_id", "n_chars", "_esha").agg(*[F.max(F.when(F.col("_kind") == 0, F.col(f"_f{k}"))).alias(f"f{k}") for k in range(WORDS)], *[F.max(F.when(F.col("_kind") == 1, F.col(f"_f{k}"))).alias(f"e{k}") for k in range(WORDS)])
    order = Window.partitionBy("_bucket").orderBy("_copy", "_row")
    per = per.select("*", *[F.lead(f"f{k}").over(order).alias(f"n{k}") for k in range(WORDS)]).where(F.col("_copy") == 0)
    out = saved(per.select("doc_id", "n_chars", F.lower(F.hex("_esha")).alias("edited_sha256"), "f0", "f1", "e0", "e1", "n0", "n1"), "prints")

    asked = F.coalesce(F.col("doc_id") % query_step == 0, F.lit(False))
    distinct = saved(out.groupBy("f0", "f1").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_equal"), F.max(asked).alias("asked")), "distinct")
    found = near(distinct.where("asked").select("f0", "f1"), distinct.select("f0", "f1"), radius)
    sizes = distinct.select(F.col("f0").alias("g0"), F.col("f1").alias("g1"), "n_equal")
    # merged too: the written tables are smaller in their files than as rows in memory
    others = found.hint("merge").join(sizes, ["g0", "g1"]).groupBy("f0", "f1").agg(F.sum("n_equal").alias("others"))
    classes = distinct.join(others, ["f0", "f1"], "left").select("f0", "f1", "class_id", (F.col("n_equal") - 1 + F.coalesce("others", F.lit(0))).alias("within"))
    named = out.hint("merge").join(classes, ["f0", "f1"])
    return named.select("doc_id", "n_chars", "edited_sha256", _hex("f").alias("fingerprint"), _hex("e").alias("edited_fingerprint"), _likeness("f", "e").alias("near_edited"), _likeness("f", "n").alias("near_next"), "class_id", F.when(asked, F.col("within")).alias("n_near"))
