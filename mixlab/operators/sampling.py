"""Sampling, splitting and ranked slicing.

Every operator orders rows by the seeded md5 key (then id) and keeps a rank
predicate; nothing depends on row position or a driver-side RNG, and no
operator pulls rows through one task: small top-k uses TakeOrderedAndProject
(bounded heap per task), large ranks use the bucketed exact rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlab.functions.keys import DEFAULT_SEED, exact_rank, frac_count, numeric_rank, order_key
from mixlab.functions.selection import drawn

# The reference sends generation requests in five slices.
N_SLICES = 5
SLICE_SHARE = 0.20


def sample_n(df: DataFrame, n: int, seed: int = DEFAULT_SEED, id_col: str = "id") -> DataFrame:
    """Exactly n rows without replacement (all rows when fewer exist).
    Top-n by key: a bounded heap per task, no full sort, no single partition."""
    return df.withColumn("_k", order_key(id_col, seed)).orderBy("_k", id_col).limit(n).drop("_k")


def sample_frac(df: DataFrame, frac: float, seed: int = DEFAULT_SEED, by: Sequence[str] = (),
                id_col: str = "id") -> DataFrame:
    """Round-half-even(n * frac) rows per group (pandas ``sample(frac)``)."""
    r = exact_rank(df, order_key(id_col, seed), tiebreak=[id_col], partition_by=by, name="_r", size_name="_n")
    return r.filter(F.col("_r") <= frac_count(F.col("_n"), frac, "half_even")).drop("_r", "_n")


def shuffle_split(df: DataFrame, valid_frac: float = 0.2, seed: int = DEFAULT_SEED, by: Sequence[str] = (),
                  id_col: str = "id", names: tuple[str, str] = ("train", "valid")) -> DataFrame:
    """Shuffled two-way split at int(n * (1 - f)); adds ``split``."""
    r = exact_rank(df, order_key(id_col, seed), tiebreak=[id_col], partition_by=by, name="_r", size_name="_n")
    cut = F.floor(F.col("_n").cast("double") * F.lit(1.0 - valid_frac))
    return r.withColumn("split", F.when(F.col("_r") <= cut, F.lit(names[0])).otherwise(F.lit(names[1]))).drop(
        "_r", "_n")


def sample_per_group(df: DataFrame, group: str, n: int = 5, seed: int = DEFAULT_SEED, id_col: str = "id",
                     salt_buckets: int = 64) -> DataFrame:
    """N random rows per group. Two phases so a hot group (a third of all
    rows) is split: top-n within (group, salt bucket) first, then top-n of
    those few candidates per group. Exact: the global top-n of a group is
    within the union of its buckets' top-n."""
    k = order_key(id_col, seed)
    d = df.withColumn("_k", k).withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salt_buckets)))
    w1 = Window.partitionBy(group, "_salt").orderBy("_k", id_col)
    cand = d.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n)
    w2 = Window.partitionBy(group).orderBy("_k", id_col)
    return cand.withColumn("sample_rank", F.row_number().over(w2).cast("long")).filter(F.col("sample_rank") <= n).drop(
        "_k", "_salt", "_r1")


def nested_samples(df: DataFrame, sizes: Sequence[int], seed: int = DEFAULT_SEED, by: Sequence[str] = (),
                   id_col: str = "id") -> DataFrame:
    """Samples of decreasing size, each inside the previous: one rank,
    size s = rank <= s. Output adds ``size`` (one row per (size, member))."""
    r = exact_rank(df, order_key(id_col, seed), tiebreak=[id_col], partition_by=by, name="_r")
    return r.withColumn("size", F.explode(F.array(*[F.lit(int(s)) for s in sizes]))).filter(
        F.col("_r") <= F.col("size")).drop("_r")


def complement_head(df: DataFrame, base: int, n: int, seed: int = DEFAULT_SEED, by: Sequence[str] = (),
                    id_col: str = "id") -> DataFrame:
    """The first n rows *not* in a sample of ``base`` rows."""
    r = exact_rank(df, order_key(id_col, seed), tiebreak=[id_col], partition_by=by, name="_r")
    return r.filter((F.col("_r") > base) & (F.col("_r") <= base + n)).drop("_r")


def complement(df: DataFrame, sample: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``df`` whose id is not in ``sample`` (left anti join)."""
    return df.join(sample.select(id_col), id_col, "left_anti")


def repeat_draws(df: DataFrame, sizes: Sequence[int], runs: int, seed: int = DEFAULT_SEED,
                 by: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """``runs`` independent draws of each size: the key is salted with
    the run (and size), so draws differ; output adds (run, size). The last key of each draw is
    found on the ids alone; then one scan of the rows names the draws of each row."""
    draws = {f"{r}/{int(s)}": (int(s), (r, int(s))) for r in range(runs) for s in sizes}
    d = drawn(df, draws, seed, by, id_col).withColumn("_in", F.explode("_in"))
    part = F.split("_in", "/")
    return d.withColumn("run", part[0].cast("int")).withColumn("size", part[1].cast("int")).drop("_in")


def shuffled(df: DataFrame, seed: int = DEFAULT_SEED, id_col: str = "id") -> DataFrame:
    """Rows in shuffled order for a sink (a range-partitioned sort by the seeded key)."""
    return df.orderBy(order_key(id_col, seed), id_col)


def cap_per_split(df: DataFrame, caps: dict[str, int], split_col: str = "split", seed: int = DEFAULT_SEED,
                  id_col: str = "id", input_col: str | None = None) -> DataFrame:
    """Rows whose ``input_col`` is NULL, empty or of spaces only are skipped; after a shuffle keep at most caps[split] rows of each split
    (exactly n, not n-1); splits without a cap are kept whole."""
    if input_col:
        df = df.filter(F.col(input_col).isNotNull() & (F.trim(input_col) != ""))
    r = exact_rank(df, order_key(id_col, seed), tiebreak=[id_col], partition_by=[split_col], name="_r")
    cap = F.element_at(F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(int(v)))]),
                       F.col(split_col))
    return r.filter(cap.isNull() | (F.col("_r") <= cap)).drop("_r")


def slices(df: DataFrame, seed: int = DEFAULT_SEED, by: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """Five equal slices of floor(n * 0.2) rows; the last slice also takes
    the remainder (the reference drops it). Adds ``batch`` and ``custom_id``
    (0-based position inside the batch, as text)."""
    r = exact_rank(df, order_key(id_col, seed), tiebreak=[id_col], partition_by=by, name="_r", size_name="_n")
    per = F.floor(F.col("_n").cast("double") * F.lit(SLICE_SHARE))
    batch = F.when(per == 0, F.lit(N_SLICES - 1)).otherwise(
        F.least(F.floor((F.col("_r") - 1) / per), F.lit(N_SLICES - 1)))
    return r.withColumn("batch", batch.cast("int")).withColumn(
        "custom_id", (F.col("_r") - 1 - F.col("batch") * per).cast("long").cast("string")).drop("_r", "_n")


def first_seen_id(df: DataFrame, content: str, src_key: str, name: str = "context_id") -> DataFrame:
    """id = order of first appearance of the content (0-based), linear:
    first key per distinct content, exact rank of those keys, join back."""
    firsts = df.groupBy(content).agg(F.min(src_key).alias("_first"))
    ranked = numeric_rank(firsts, "_first", descending=False, tiebreak=[content], name="_r")
    ids = ranked.select(content, (F.col("_r") - 1).alias(name))
    return df.join(ids, content)


def top_fraction(df: DataFrame, score: str, frac: float, top: bool = True, id_col: str = "id") -> DataFrame:
    """Leading int(n*frac) rows by score (desc, NULL last) or the trailing
    rows from position int(n*(1-frac)) on."""
    n = df.select(F.count(F.lit(1))).scalar()
    r = numeric_rank(df, score, descending=True, tiebreak=[id_col], name="_r")
    if top:
        return r.filter(F.col("_r") <= F.floor(n.cast("double") * F.lit(frac))).drop("_r")
    return r.filter(F.col("_r") > F.floor(n.cast("double") * F.lit(1.0 - frac))).drop("_r")


def sort_by_score(df: DataFrame, score: str = "score", id_col: str = "id") -> DataFrame:
    """Descending score, NULLs last, ties by id (a range-partitioned
    global sort: no single partition)."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(id_col))
