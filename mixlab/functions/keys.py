"""Deterministic keys, exact ranks and sampling primitives.

Sampling never depends on row position or on a driver RNG: rows are ordered
by ``md5(id || '-' || seed [|| '-' || salt])`` then ``id``. The same order is
expressible in plain SQL, so every sampling operator has an exact oracle.

Exact global ranks avoid ``Window.orderBy`` without partition keys (which
moves every row into one task). Instead the key space is cut into ordered
buckets (the leading hex digits of the md5 key, uniform by construction),
rows are counted per bucket, cumulative offsets are computed on that small
table and each bucket is ranked independently: one shuffle, bounded tasks,
and no hot bucket even if a third of the rows share one group value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

DEFAULT_SEED = 42
# 16**3 = 4096 ordered buckets; the offsets table is bounded by this many rows
# per group, which is what makes its broadcast safe when there is no group.
DEFAULT_HEX_DIGITS = 3


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_key(id_col: str | Column, seed: int = DEFAULT_SEED, *salt: str | Column) -> Column:
    """md5 hex of ``id-seed[-salt...]`` (SQL: ``md5(concat(CAST(id AS VARCHAR),'-','42'))``)."""
    parts: list[Column] = [_col(id_col).cast("string"), F.lit("-"), F.lit(str(seed))]
    for s in salt:
        parts += [F.lit("-"), _col(s).cast("string")]
    return F.md5(F.concat(*parts))


def exact_rank(
    df: DataFrame,
    key: str | Column,
    tiebreak: Sequence[str] = ("id",),
    partition_by: Sequence[str] = (),
    name: str = "rank",
    size_name: str | None = None,
    hex_digits: int = DEFAULT_HEX_DIGITS,
    ahead: tuple[Sequence[str], int] | None = None,
) -> DataFrame:
    """Add a dense 1-based ``name`` column ordered by (key, *tiebreak) within
    ``partition_by``; optionally ``size_name`` = rows in the group.

    NULL groups are groups of their own; rows with a NULL key rank last.
    ``ahead`` = (columns, k) adds, without another shuffle, ``_ahead``: these columns of each of the next k
    rows of the bucket (structs, NULL behind its end), and ``_at`` and ``_in``: the row's place in its bucket and the bucket's rows.

    ``key`` must be a lowercase hex string (md5) so that its prefix is an
    order-preserving, uniformly filled bucket.
    """
    pb = ["_g"] if partition_by else []  # a struct: a NULL group is a group, and the join and the window share one shuffle
    keyed = df.withColumn("_k", _col(key)).withColumn(
        "_b", F.coalesce(F.conv(F.substring("_k", 1, hex_digits), 16, 10).cast("int"), F.lit(16**hex_digits))
    )  # rows without a key (NULL id) come last, in a bucket of their own
    if pb:
        keyed = keyed.withColumn("_g", F.struct(*partition_by))
    counts = keyed.groupBy(*pb, "_b").agg(F.count(F.lit(1)).alias("_in"))
    wcum = Window.partitionBy(*pb).orderBy("_b")
    offsets = counts.withColumn(
        "_off",
        F.coalesce(F.sum("_in").over(wcum.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    if size_name:
        offsets = offsets.withColumn(size_name, F.sum("_in").over(Window.partitionBy(*pb)))
    if not ahead:
        offsets = offsets.drop("_in")
    if not pb:
        # at most 16**hex_digits rows: a proven bound, safe to broadcast
        offsets = F.broadcast(offsets)
    # with group keys the offsets table grows with the number of groups; leave
    # the strategy to AQE, which broadcasts it at runtime only if it is small.
    joined = keyed.join(offsets, [*pb, "_b"])
    w = Window.partitionBy(*pb, "_b").orderBy(F.col("_k").asc_nulls_last(), *tiebreak)
    ranked = joined.withColumn(name, (F.col("_off") + F.row_number().over(w)).cast("long"))
    if ahead:
        nexts = [F.lead(F.struct(*ahead[0]), j).over(w) for j in range(1, ahead[1] + 1)]
        ranked = ranked.withColumns({"_ahead": F.array(*nexts), "_at": F.col(name) - F.col("_off")})
    columns = [*df.columns, *([size_name] if size_name else []), name]
    return ranked.select(*columns, *(["_in", "_ahead", "_at"] if ahead else []))


def numeric_rank(
    df: DataFrame,
    value: str,
    descending: bool = True,
    tiebreak: Sequence[str] = ("id",),
    name: str = "rank",
    buckets: int = 64,
) -> DataFrame:
    """Exact 1-based rank by a numeric column (NULLs last), then ``tiebreak``.

    Buckets are cut at quantiles of the value (one aggregate, ``buckets`` numbers), so outliers
    do not fill one of them. A value that stands at two quantiles or more is hot: it has a bucket of
    its own, cut again at quantiles of the first tie-break column if that is a number. Each
    bucket is ranked on its own and shifted by the count of the buckets before it.
    """
    v = F.col(value).cast("double")
    probs = [k / buckets for k in range(1, buckets)]
    cuts = [F.percentile_approx(v, probs).alias("v")]
    split_ties = bool(tiebreak) and isinstance(df.schema[tiebreak[0]].dataType, NumericType)
    if split_ties:
        tie = F.col(tiebreak[0]).cast("double")
        cuts.append(F.percentile_approx(tie, probs).alias("t"))
    found = df.agg(*cuts).first()
    at = found["v"] or []

    def below(c: Column, edges: list[float]) -> Column:
        if not edges:
            return F.lit(0)
        return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < c))

    hot = sorted({x for x in at if at.count(x) > 1})
    edges = sorted(set(at))
    place = 2 * below(v, edges) + F.when(v.isin(hot), 1).otherwise(0) if hot else 2 * below(v, edges)
    if descending:
        place = F.lit(2 * len(edges) + 1) - place
    if split_ties and hot:
        ties = F.when(v.isin(hot), below(tie, sorted(set(found["t"] or [])))).otherwise(0)
    else:
        ties = F.lit(0)
    b = F.when(v.isNull(), F.lit((2 * buckets + 2) * buckets)).otherwise(place * buckets + ties)
    keyed = df.withColumn("_b", b)
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).select("_b", "_off")
    joined = keyed.join(F.broadcast(offsets), on="_b")  # a row for each bucket that has any
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    w = Window.partitionBy("_b").orderBy(order, *tiebreak)
    return joined.withColumn(name, (F.col("_off") + F.row_number().over(w)).cast("long")).drop(
        "_b", "_off"
    )


def dense_id(df: DataFrame, key_cols: Sequence[str], name: str = "dense_id") -> DataFrame:
    """Dense 0-based surrogate id from a source key, never from row position.

    Ids follow ``md5(key)`` order (ties by the key itself), so the buckets of
    the exact rank are uniform whatever the key distribution.
    SQL: ``row_number() OVER (ORDER BY md5(key), key) - 1``.
    """
    key = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in key_cols]))
    return exact_rank(df, key, tiebreak=list(key_cols), name=name).withColumn(
        name, F.col(name) - 1
    )


def frac_count(n: Column, frac: float, rounding: str = "floor") -> Column:
    """Row count of a fraction: ``floor`` = int(n*f) (split points, mixtures);
    ``half_even`` = round(n*f) as pandas ``sample(frac)`` does."""
    prod = n.cast("double") * F.lit(float(frac))
    if rounding == "floor":
        return F.floor(prod).cast("long")
    return F.bround(prod, 0).cast("long")
