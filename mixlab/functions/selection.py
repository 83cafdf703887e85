"""Distributed selection: exact quantiles without a buffer of values, draws without ranking rows.

``quantiles`` finds order statistics in three passes over one column: a sketch of bounded size per group cuts the
values into ``BINS`` ranges, the rows of each range are counted exactly, and only the ranges that hold a wanted rank
are looked into, value by value. The sketch decides how even the ranges are, never the result. No task holds
more than the distinct values of one range, and those in a sort that spills.

``draw_keys`` finds, for any number of seeded draws, the key of the last row that is drawn: keys are md5 values, so
their leading digits are even ranges; these are counted, and the rank is found within one range. A row then
compares its own keys with those few and knows its draws: rows and texts are neither shuffled nor multiplied.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlab.functions.keys import DEFAULT_SEED, order_key

BINS = 256
#: Leading hex digits of a key that make a range: 65,536 ranges.
DIGITS = 4
_MISSING = 16**DIGITS


def same_group(a: DataFrame, b: DataFrame, by: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in by:  # a NULL group is a group
        cond = cond & a[c].eqNullSafe(b[f"_g_{c}"])
    return cond


def attach(df: DataFrame, per_group: DataFrame, by: Sequence[str], cols: Sequence[str], how: str = "inner") -> DataFrame:
    """``cols`` of the row of each group; a scalar without groups."""
    if not by:
        return df.withColumns({c: per_group.select(c).scalar() for c in cols})
    named = per_group.select(*[F.col(c).alias(f"_g_{c}") for c in by], *cols)
    return df.join(named, same_group(df, named, by), how).drop(*[f"_g_{c}" for c in by])


def _count_below(edges: str, v: str, size: int) -> Column:
    """Number of edges (sorted) below v, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(size.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s <= F.size(edges)) & (F.get(F.col(edges), at + s - 1) < F.col(v)), at + s).otherwise(at))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """``by``, ``q`` (array of double: the exact quantiles with linear interpolation, NULL without values) and the
    aggregates ``extra`` (over the column ``v`` of values as doubles), one row per group."""
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("v"))
    cuts = [k / BINS for k in range(1, BINS)]
    groups = rows.groupBy(*by).agg(F.count("v").alias("_n"), F.percentile_approx("v", cuts, 10 * BINS).alias("_e"), *extra)
    cut = attach(rows.where("v IS NOT NULL"), groups, by, ["_e"]).withColumn("_bin", _count_below("_e", "v", BINS - 1)).drop("_e")

    hist = cut.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    hist = attach(hist.withColumn("_before", before), groups, by, ["_n"])
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    ranks = [r for a in at for r in (F.floor(a), F.ceil(a))]
    holds = F.lit(False)
    for r in ranks:
        holds = holds | ((F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")))
    wanted = hist.where(holds).select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_bin").alias("_b"), "_before", "_n")

    inside = cut.join(F.broadcast(wanted) if not by else wanted, same_group(cut, wanted, by) & (cut["_bin"] == wanted["_b"]))
    values = inside.groupBy(*by, "_bin", "_before", "_n", "v").agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*by, "_bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("_end", F.col("_before") + upto)
    start = F.col("_end") - F.col("_m")
    found = placed.groupBy(*by).agg(*[F.max(F.when((start <= r) & (r < F.col("_end")), F.col("v"))).alias(f"_r{i}") for i, r in enumerate(ranks)], F.first("_n").alias("_m"))
    picked = []
    for i, p in enumerate(probs):
        a = F.lit(float(p)) * (F.col("_m") - 1)
        low, high = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        picked.append(low + (high - low) * (a - F.floor(a)))
    q = found.select(*by, F.array(*picked).alias("q"))
    return attach(groups.drop("_e", "_n"), q, by, ["q"], "left")


Draws = Mapping[str, tuple[int, tuple]]


def _key(id_col: str, seed: int, salt: tuple) -> Column:
    return F.coalesce(order_key(id_col, seed, *[F.lit(str(s)) for s in salt]), F.lit("~"))


def draw_keys(df: DataFrame, draws: Draws, seed: int = DEFAULT_SEED, by: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """``by`` and ``last``: per draw the (key, id) of its last row, as a map; draws that take all rows of the group are absent.

    A draw is name -> (number of rows, salts): the first rows by md5(id-seed[-salt...]), then id. Rows without an id
    come last. Reads ids and groups only.
    """
    by = list(by)
    each = F.array(*[F.struct(F.lit(name).alias("draw"), F.lit(int(n)).cast("long").alias("want"), _key(id_col, seed, salt).alias("k")) for name, (n, salt) in draws.items()])
    keys = df.select(*by, F.col(id_col).alias("_id"), F.explode(each).alias("d")).select(*by, "_id", "d.*")
    keys = keys.withColumn("_bin", F.when(F.col("k") == "~", F.lit(_MISSING)).otherwise(F.conv(F.substring("k", 1, DIGITS), 16, 10).cast("int")))
    hist = keys.groupBy(*by, "draw", "want", "_bin").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*by, "draw").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    cut = hist.withColumn("_before", before).where("_before < want AND want <= _before + _c")
    cut = cut.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("draw").alias("_draw"), F.col("_bin").alias("_b"), (F.col("want") - F.col("_before")).alias("_need"))
    edge = keys.join(cut, same_group(keys, cut, by) & (keys["draw"] == cut["_draw"]) & (keys["_bin"] == cut["_b"]))
    ranked = edge.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "draw").orderBy("k", "_id"))).where("_r = _need")
    entry = F.struct("draw", F.struct("k", F.col("_id").alias("id")).alias("at"))
    return ranked.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("last"))  # an entry a draw


def drawn(df: DataFrame, draws: Draws, seed: int = DEFAULT_SEED, by: Sequence[str] = (), id_col: str = "id", name: str = "_in") -> DataFrame:
    """Adds ``name``: the names of the draws (array of strings) that take the row. Rows of one id are drawn together."""
    out = attach(df, draw_keys(df, draws, seed, by, id_col), list(by), ["last"], "left")
    own = []
    for draw, (n, salt) in draws.items():
        at = F.try_element_at("last", F.lit(draw))
        inside = F.struct(_key(id_col, seed, salt).alias("k"), F.col(id_col).alias("id")) <= at
        own.append(F.when(F.lit(n > 0) & (F.col("last").isNull() | at.isNull() | inside), F.lit(draw)))
    return out.withColumn(name, F.filter(F.array(*own), lambda x: x.isNotNull())).drop("last")
