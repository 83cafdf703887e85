"""Mixtures of human and generated rows (M1-M5).

A mixture replaces exactly ``int(n * frac)`` rows of each dataset with their
generated twin. Which rows is decided by one exact rank over the md5 key,
so every fraction, size and run is a predicate on a rank column: fractions
of the same seed are nested, and the whole sweep is a single plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.functions.keys import DEFAULT_SEED, exact_rank, frac_count, order_key
from mixlab.functions.selection import attach, drawn

# The reference's mixture fractions, sweep sizes and runs.
MIX_FRACS = [0.0, 0.5, 0.95, 0.975, 1.0]
SWEEP_SIZES = [1000, 3000, 5000]
SWEEP_RUNS = 3

TASK_COLUMNS = {
    # task: (text, second, syn_text, syn_second)
    "qa": ("question", "answer", "syn_question", "syn_answer"),
    "fv": ("claim", "label", "syn_claim", "syn_label"),
}


def assemble(df: DataFrame, task: str, synthetic, keep: Sequence[str] = ()) -> DataFrame:
    """Training rows from a boolean ``synthetic`` column/expression.

    text = context || ' | ' || (generated or human text); label likewise
    (always the human label for human rows). qa adds ``input`` and the
    `` ANSWER: `` suffix.
    """
    text_col, second, syn_text, syn_second = TASK_COLUMNS[task]
    syn = F.col("synthetic") if isinstance(synthetic, str) else synthetic
    d = df.withColumn("synthetic", syn)
    body = F.concat(
        F.col("context"), F.lit(" | "),
        F.when(F.col("synthetic"), F.col(syn_text)).otherwise(F.col(text_col)),
    )
    label = F.when(F.col("synthetic"), F.col(syn_second)).otherwise(F.col(second))
    d = d.select(*keep, "id", body.alias("text"), label.alias("label"), "synthetic", "meta")
    if task == "qa":
        d = d.withColumn("input", F.concat(F.col("text"), F.lit(" ANSWER: "))).withColumn(
            "text", F.concat(F.col("text"), F.lit(" ANSWER: "), F.col("label"), F.lit(" |"))
        )
    return d


def mixture(
    df: DataFrame,
    task: str,
    frac: float,
    seed: int = DEFAULT_SEED,
    by: Sequence[str] = ("dataset_name",),
    keep: Sequence[str] = ("dataset_name",),
) -> DataFrame:
    """M1: exactly floor(n*frac) generated rows per dataset."""
    if frac <= 0.0:
        return assemble(df, task, F.lit(False), keep)
    if frac >= 1.0:
        return assemble(df, task, F.lit(True), keep)
    ranked = exact_rank(df, order_key("id", seed), partition_by=list(by), name="_r", size_name="_n")
    return assemble(ranked, task, F.col("_r") <= frac_count(F.col("_n"), frac), keep)


# Holdout splits of these corpora are sampled before mixing.
HOLDOUT_FRAC = {"fever": 0.25}


def mixture_sweep(
    df: DataFrame, task: str, fracs: Sequence[float] = tuple(MIX_FRACS), seed: int = DEFAULT_SEED,
    by: Sequence[str] = ("dataset_name",), split_col: str | None = None,
    holdout_frac: dict[str, float] | None = None,
) -> DataFrame:
    """M2: every fraction in one plan. One rank per row serves all fractions
    (nested by construction); the fraction list is a literal array exploded
    per row, not joined.

    With ``split_col``: mixing happens per split, the test split is never
    mixed (it appears at fraction 0 only), and non-train splits of the
    datasets in ``holdout_frac`` are first sampled (fever at 25 %).
    """
    part = [*by] + ([split_col] if split_col else [])
    d = df
    if split_col and holdout_frac is not False:
        hf = HOLDOUT_FRAC if holdout_frac is None else holdout_frac
        if hf and "dataset_name" in df.columns:
            from mixlab.operators.cleaning import literal_map

            f = F.try_element_at(literal_map({k: float(v) for k, v in hf.items()}), F.col("dataset_name"))
            r = exact_rank(d, order_key("id", seed, F.lit("holdout")), partition_by=part, name="_h", size_name="_hn")
            keep = (F.col(split_col) == "train") | f.isNull() | (F.col("_h") <= F.bround(F.col("_hn") * f, 0))
            d = r.filter(keep).drop("_h", "_hn")
    ranked = exact_rank(d, order_key("id", seed), partition_by=part, name="_r", size_name="_n")
    fr = ranked.withColumn("frac", F.explode(F.array(*[F.lit(float(f)) for f in fracs])))
    if split_col:
        fr = fr.filter((F.col(split_col) != "test") | (F.col("frac") == 0.0))
    syn = F.col("_r") <= F.floor(F.col("_n").cast("double") * F.col("frac"))
    return assemble(fr, task, syn, keep=[*part, "frac"])


# The small corpus has its own sizes and additions.
CORPUS_SIZES = {"scifact": [100, 300, 500]}
CORPUS_BASES = {"scifact": ([100, 200, 300], 20)}


def size_sweep(
    df: DataFrame, task: str, sizes: Sequence[int] = tuple(SWEEP_SIZES), runs: int = SWEEP_RUNS,
    fracs: Sequence[float] = tuple(MIX_FRACS), seed: int = DEFAULT_SEED,
    by: Sequence[str] = ("dataset_name",), corpus_sizes: Mapping[str, Sequence[int]] = CORPUS_SIZES,
) -> DataFrame:
    """For each (size, run) draw ``size`` rows (by a key salted
    with the run, so that sizes are nested), then mix each draw at every fraction. Below fraction 1 the human rows
    of a file stand a second time with ``small`` = true, as a file of their own. Corpora in ``corpus_sizes``
    have their own sizes (where ``dataset_name`` is in ``by``).

    Draws and mixtures are found on the ids alone (``functions/selection.py``); one scan of the
    texts then compares each row's keys with the last keys of each. Rows of one id go together.
    """
    by = list(by)
    every = sorted({int(s) for own in (sizes, *corpus_sizes.values()) for s in own}) if "dataset_name" in by else [int(s) for s in sizes]
    taken = drawn(df, {f"{r}/{s}": (s, (r,)) for r in range(runs) for s in every}, seed, by)
    if "dataset_name" in by:
        own = F.array(*[F.lit(int(s)) for s in sizes])
        for name, special in corpus_sizes.items():
            own = F.when(F.col("dataset_name") == name, F.array(*[F.lit(int(s)) for s in special])).otherwise(own)
        taken = taken.withColumn("_in", F.filter("_in", lambda x: F.array_contains(own, F.split(x, "/")[1].cast("int"))))

    def parts(d: DataFrame) -> DataFrame:
        at = F.split("_draw", "/")
        return d.withColumn("run", at[0].cast("int")).withColumn("size", at[1].cast("int"))

    # the last generated row of each mixture, found among the drawn ids
    ids = parts(taken.select(*by, "id", F.explode("_in").alias("_draw")))
    key = F.coalesce(order_key("id", seed, "run", "size"), F.lit("~"))
    ranked = exact_rank(ids, order_key("id", seed, "run", "size"), partition_by=[*by, "run", "size"], name="_r", size_name="_n")
    last = F.filter(F.array(*[F.when(F.col("_r") == F.floor(F.col("_n").cast("double") * f), F.struct(
        F.concat("_draw", F.lit(f"/{i}")).alias("file"), F.struct(key.alias("k"), F.col("id").alias("id")).alias("at"))) for i, f in enumerate(fracs)]), lambda x: x.isNotNull())
    lasts = ranked.select(*by, F.explode(last).alias("e")).groupBy(*by).agg(F.map_from_entries(F.collect_list("e")).alias("_last"))

    rows = parts(attach(taken, lasts, by, ["_last"], "left").withColumn("_draw", F.explode("_in")))
    files = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("frac")) for i, f in enumerate(fracs)])
    rows = rows.withColumn("_f", F.explode(files)).withColumn("frac", F.col("_f.frac"))
    bound = F.try_element_at("_last", F.concat("_draw", F.lit("/"), F.col("_f.i").cast("string")))
    syn = F.coalesce(F.struct(key.alias("k"), F.col("id").alias("id")) <= bound, F.lit(False))
    out = assemble(rows, task, syn, keep=[*by, "size", "run", "frac"])
    again = F.when((F.col("frac") < 1) & ~F.col("synthetic"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return out.withColumn("small", F.explode(again))


def replacement_value(df: DataFrame, task: str, base_sizes: Sequence[int] = (3000, 2000, 1000), real_add: int = 200,
                      seed: int = DEFAULT_SEED, by: Sequence[str] = ("dataset_name",),
                      corpus_bases: Mapping[str, tuple[Sequence[int], int]] = CORPUS_BASES) -> DataFrame:
    """M4: nested all-generated bases (descending sizes, each inside the
    previous), each written as 'train', 'real_train' (+ real_add
    human rows drawn from all rows) and 'synth_i_train' (+ real_add*(i+1)
    generated rows that follow the base in key order), i < gap//add - 1. Corpora in ``corpus_bases`` have their
    own sizes and addition (where ``dataset_name`` is in ``by``).

    All draws are found on the ids alone, and one scan of the texts names the files of each row."""
    by = list(by)
    plain = (tuple(base_sizes), real_add)
    special = dict(corpus_bases) if "dataset_name" in by else {}

    def steps(plan) -> list[tuple[int, int, int]]:
        sizes, add = sorted(plan[0], reverse=True), plan[1]
        n_adds = (sizes[0] - sizes[1]) // add - 1 if len(sizes) > 1 else 0
        return [(int(s), int(add), n_adds) for s in sizes]

    draws: dict[str, tuple[int, tuple]] = {}
    for s, add, n_adds in (x for plan in (plain, *special.values()) for x in steps(plan)):
        draws |= {f"b/{n}": (n, ()) for n in (s, *(s + add * (i + 1) for i in range(n_adds)))}
        draws[f"r/{s}/{add}"] = (add, ("real", s))
    taken = drawn(df, draws, seed, by)

    def files(plan) -> Column:
        out = []
        for s, add, n_adds in steps(plan):
            def file(variant: str, synthetic: bool, holds: Column, s=s) -> Column:
                return F.when(holds, F.struct(F.lit(s).alias("base_size"), F.lit(variant).alias("variant"), F.lit(synthetic).alias("synthetic")))

            base = F.array_contains("_in", f"b/{s}")
            out += [file("train", True, base), file("real_train", True, base), file("real_train", False, F.array_contains("_in", f"r/{s}/{add}"))]
            out += [file(f"synth_{i}_train", True, F.array_contains("_in", f"b/{s + add * (i + 1)}")) for i in range(n_adds)]
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    own = files(plain)
    for name, plan in special.items():
        own = F.when(F.col("dataset_name") == name, files(plan)).otherwise(own)
    rows = taken.withColumn("_f", F.explode(own)).select("*", "_f.base_size", "_f.variant", F.col("_f.synthetic").alias("synthetic"))
    return assemble(rows, task, "synthetic", keep=[*by, "base_size", "variant"])


# Per-corpus sequence limits from the reference's run scripts.
MAX_SEQ_LEN = {"factify": 800, "wanli": 150, "scifact": 512, "fever": 100, "ropes": 400, "qaconv": 512,
               "narrativeqa": 800, "coqa": 512, "fairytaleqa": 400}
DEFAULT_MAX_SEQ_LEN = 512
GEN_MODEL = "gpt-3.5-turbo"


def manifest(datasets: DataFrame, sizes: Sequence[int] = tuple(SWEEP_SIZES), fracs: Sequence[float] = tuple(MIX_FRACS),
             runs: int = SWEEP_RUNS, model: str = GEN_MODEL, cot: bool = False) -> DataFrame:
    """M5: one row per training run (dataset x size x frac x run) with its
    length limit and the partitioned path of its training file. The grid is
    generated per dataset row from literal arrays (no join)."""
    from mixlab.operators.cleaning import literal_map

    own = F.array(*[F.lit(int(s)) for s in sizes])
    for name, special in CORPUS_SIZES.items():
        own = F.when(F.col("dataset_name") == name, F.array(*[F.lit(int(s)) for s in special])).otherwise(own)
    g = datasets.select("dataset_name", F.explode(own).alias("size"))
    g = g.withColumn("frac", F.explode(F.array(*[F.lit(float(f)) for f in fracs])))
    g = g.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    msl = F.coalesce(F.try_element_at(literal_map(MAX_SEQ_LEN), F.col("dataset_name")), F.lit(DEFAULT_MAX_SEQ_LEN))
    path = F.concat(F.lit(f"exp2/{model}/cot_{cot}/"), F.col("dataset_name"), F.lit("/size_"), F.col("size").cast("string"),
                    F.lit("/frac_"), F.col("frac").cast("string"), F.lit("/run_"), F.col("run").cast("string"))
    return g.select(F.lit(model).alias("model"), "dataset_name", "size", "frac", "run", msl.alias("max_seq_len"),
                    path.alias("path"))
