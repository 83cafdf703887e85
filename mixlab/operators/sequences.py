"""Sequence preparation (L1-L5) and dialogue rollups.

Token ids come from a vocabulary table (whitespace words ranked by
frequency) instead of a model tokenizer. Packing never explodes tokens:
each row emits one slice per block it touches, so packing costs
O(rows + blocks) rows, and a block holds at most ``block_size`` ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlab.functions.keys import numeric_rank
from mixlab.functions.text import strip_ws, words
from mixlab.session import cut_lineage

# Reserved ids and the reference's batch of rows per packing group.
PAD_ID = 0
IGNORE = -100
PACK_GROUP_ROWS = 1000
# Fixed value: the system turn the chat corpus job prepends.
CHAT_SYSTEM = ("You are Llama, an AI assistant created by Philipp to be helpful and honest. Your knowledge spans a "
               "wide range of topics, allowing you to engage in substantive conversations and provide analysis on "
               "complex subjects.")


def bucketed_rank(df: DataFrame, buckets: Sequence[tuple[Column, bool]], order: Sequence[Column],
                  name: str = "rank") -> DataFrame:
    """Exact global rank when the (ascending/descending) bucket expressions
    order rows consistently with ``order``: count rows per bucket, offsets by
    a window over that histogram, row_number within each bucket."""
    bcols = {f"_b{i}": e for i, (e, _) in enumerate(buckets)}
    keyed = df.withColumns(bcols)
    names = list(bcols)
    counts = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    ordering = [F.col(n).desc() if desc else F.col(n).asc() for n, (_, desc) in zip(names, buckets)]
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    j = keyed.join(offsets, names)
    w = Window.partitionBy(*names).orderBy(*order)
    return j.withColumn(name, (F.col("_off") + F.row_number().over(w)).cast("long")).drop(*names, "_off")


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """(word, id, n) with ids 1.. by frequency (desc) then word; 0 is padding.
    Buckets (count, first character) split a long tail of rare words."""
    counts = texts.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)  # ranks and every use of the ids read it again, words are counted once
    r = bucketed_rank(counts, [(F.col("n"), True), (F.substring("word", 1, 1), False)],
                      [F.col("n").desc(), F.col("word").asc()], "id")
    return r.select("word", "id", "n")


#: Frequent words that ``token_ids`` resolves without a shuffle: rows and letters of the broadcast table.
HEAD_WORDS = 4096
HEAD_LETTERS = 64


def token_ids(df: DataFrame, text: str, vocab: DataFrame, id_col: str = "id") -> DataFrame:
    """Per row the ordered array of vocabulary ids of its words. The vocabulary is ordered by frequency: its
    first ``HEAD_WORDS`` words of at most ``HEAD_LETTERS`` letters, which fill most places, are broadcast; only the places of
    the others are dealt out by word, so that no task gets all places of a hot word. A hot word that is
    longer or stands late in a foreign vocabulary is left to the engine's skew split."""
    ids = vocab.select("word", F.col("id").alias("_tid"))
    in_head = (F.col("_tid") <= HEAD_WORDS) & (F.length("word") <= HEAD_LETTERS)
    ex = df.select(id_col, F.posexplode(words(text)).alias("pos", "word"))
    known = ex.join(F.broadcast(ids.where(in_head)), "word", "left")
    rest = known.where("_tid IS NULL").drop("_tid").join(ids.where(~in_head), "word")
    j = known.where("_tid IS NOT NULL").unionByName(rest)
    return j.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "_tid"))).alias("_t")).select(
        id_col, F.transform("_t", lambda x: x["_tid"]).alias("ids"))


def pack_blocks(df: DataFrame, ids: str, order_col: str, block_size: int,
                group_rows: int = PACK_GROUP_ROWS) -> DataFrame:
    """L1: rows in ``order_col`` order form groups of ``group_rows``; each
    group's ids are concatenated and cut into blocks of ``block_size``; the
    tail of every group is dropped; labels = input ids."""
    df = cut_lineage(df)  # bounds, counts and ranks read the order again: the ids are made once
    r = numeric_rank(df, order_col, descending=False, tiebreak=[order_col], name="_r")
    r = r.withColumn("_g", F.floor((F.col("_r") - 1) / group_rows)).withColumn("_len", F.size(ids))
    w = Window.partitionBy("_g").orderBy("_r")  # at most group_rows rows per window partition
    r = r.withColumn("_off", F.coalesce(F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = r.withColumn("_total", F.sum("_len").over(Window.partitionBy("_g")))
    r = r.withColumn("_nblk", F.floor(F.col("_total") / block_size))
    first = F.floor(F.col("_off") / block_size)
    last = F.least(F.floor((F.col("_off") + F.col("_len") - 1) / block_size), F.col("_nblk") - 1)
    r = r.filter((F.col("_len") > 0) & (last >= first))
    r = r.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("block") * block_size, F.col("_off"))
    hi = F.least((F.col("block") + 1) * block_size, F.col("_off") + F.col("_len"))
    piece = F.slice(F.col(ids), (lo - F.col("_off") + 1).cast("int"), (hi - lo).cast("int"))
    parts = r.select(F.col("_g").alias("group"), "block", lo.alias("_start"), piece.alias("_piece"))
    out = parts.groupBy("group", "block").agg(F.array_sort(F.collect_list(F.struct("_start", "_piece"))).alias("_p"))
    packed = out.select("group", "block", F.flatten(F.transform("_p", lambda x: x["_piece"])).alias("input_ids"))
    return packed.withColumn("labels", F.col("input_ids"))


def prompt_mask(inp: Column, tgt: Column, max_len: int, pad: int = PAD_ID) -> tuple[Column, Column]:
    """L2: ids of input+target truncated / padded to max_len; labels = ids
    with padding and the (truncated) input prefix set to -100."""
    joined = F.slice(F.concat(inp, tgt), 1, max_len)
    padded = F.concat(joined, F.array_repeat(F.lit(pad), F.greatest(F.lit(max_len) - F.size(joined), F.lit(0))))
    n_in = F.least(F.size(inp), F.lit(max_len))
    labels = F.transform(padded, lambda x, i: F.when((x == pad) | (i < n_in), F.lit(IGNORE)).otherwise(x))
    return padded, labels


def pad_to(ids: Column, max_len: int, pad: int = PAD_ID) -> Column:
    t = F.slice(ids, 1, max_len)
    return F.concat(t, F.array_repeat(F.lit(pad), F.greatest(F.lit(max_len) - F.size(t), F.lit(0))))


def pair_encode(src: Column, tgt: Column, max_in: int, max_out: int, pad: int = PAD_ID) -> tuple[Column, Column]:
    """L3: source and target padded to their own lengths; -100 on target padding."""
    labels = F.transform(pad_to(tgt, max_out, pad), lambda x: F.when(x == pad, F.lit(IGNORE)).otherwise(x))
    return pad_to(src, max_in, pad), labels


def dialogue_rollup(turns: DataFrame, key: str, order: str, speaker: str, text: str, name: str = "context") -> DataFrame:
    """Per dialogue ``speaker: text|`` for every turn in order (a bounded
    collect: one dialogue's turns)."""
    g = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, speaker, text))).alias("_t"))
    return g.select(key, F.array_join(F.transform("_t", lambda x: F.concat(
        strip_ws(x[speaker]), F.lit(": "), strip_ws(x[text]), F.lit("|"))), "").alias(name))


def chat_corpus(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                text: str = "text", system: str = CHAT_SYSTEM) -> DataFrame:
    """L4: conversations as ordered (role, content) lists; a ``system`` turn is
    prepended when the first is not one; conversations whose later turns are
    odd in number are dropped. Output exploded: (key, pos, role, content)."""
    g = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, role, text))).alias("_t"))
    msgs = F.transform("_t", lambda x: F.struct(x[role].alias("role"), x[text].alias("content")))
    sysm = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    g = g.withColumn("_m", F.when(F.get(F.col("_t"), 0)[role] == "system", msgs).otherwise(F.concat(sysm, msgs)))
    g = g.filter((F.size("_m") - 1) % 2 == 0)
    return g.select(key, F.posexplode("_m").alias("pos", "m")).select(key, "pos", "m.role", "m.content")
