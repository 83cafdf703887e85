"""Views that stand in for the reference's inputs, derived from the driver
tables (FIXTURES.md §3). Each has a SQL twin in ``mixlab.plans.oracle_fixtures``.

They are plain DataFrame plans over the whole tables: their size grows with
the scale factor and Catalyst prunes columns down to what each query reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixlab.functions.text import words
from mixlab.sources.tables import Tables

# Price table models (per 1M tokens) used by the usage view.
MODEL_EVEN = "gpt-3.5-turbo-0125"
MODEL_ODD = "gpt-4-turbo"
FRACS = [0.0, 0.5, 0.95, 0.975, 1.0]


def fx_fv(t: Tables) -> DataFrame:
    """Fact-verification records with a human and a generated claim/label."""
    bench = t.benchmark
    n_items = bench.select(F.count(F.lit(1))).scalar()
    claims = bench.select(F.col("item_id").alias("_i1"), F.col("text").alias("claim"))
    syn = bench.select(F.col("item_id").alias("_i2"), F.col("text").alias("syn_claim"))
    base = (
        t.documents.join(t.labels, "doc_id", "left")  # a document without a label gets one by its id
        .withColumn("_i1", F.col("doc_id") % n_items)
        .withColumn("_i2", (F.col("doc_id") + 1) % n_items)
        .join(claims, "_i1")
        .join(syn, "_i2")
    )
    return base.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("context_id"),
        F.col("source").alias("dataset_name"),
        F.lit("fv").alias("task"),
        F.col("text").alias("context"),
        F.col("claim"),
        F.coalesce("quality", F.col("doc_id") % 2).alias("label"),
        F.col("syn_claim"),
        F.coalesce("toxic", F.lit(0)).alias("syn_label"),
        F.col("lang").alias("meta"),
    )


def fx_qa(t: Tables) -> DataFrame:
    """Question-answering records: a user turn and the assistant turn after it."""
    c = t.conversations
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context")
    )
    nxt = c.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("syn_question")
    )
    j = u.join(a, ["conv_id", "turn"]).join(nxt, ["conv_id", "turn"], "left")
    rid = F.col("conv_id") * 1_000_000 + F.col("turn")
    pieces = F.split("context", r"[.]")
    pred = F.concat(F.col("context"), F.lit(" | tail"))
    return j.select(
        rid.alias("id"),
        F.col("conv_id").alias("context_id"),
        F.concat(F.lit("conv"), (F.col("conv_id") % 3).cast("string")).alias("dataset_name"),
        F.lit("qa").alias("task"),
        F.col("question"),
        F.col("context"),
        F.get(pieces, 0).alias("answer"),
        F.col("syn_question"),
        F.get(pieces, 1).alias("syn_answer"),
        F.when(rid % 17 == 0, F.lit(None).cast("string")).otherwise(pred).alias("prediction"),
        F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("meta"),
    )


def fx_scores(t: Tables) -> DataFrame:
    """Binary labels with a score in [0, 1)."""
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.coalesce("quality", F.col("doc_id") % 2).alias("label"),
        ((F.col("n_chars") % 1000).cast("double") / 1000.0).alias("output"),
    )


def fx_runs(t: Tables) -> DataFrame:
    """Run results: one metric per (dataset, task, frac, run)."""
    frac = F.element_at(F.array(*[F.lit(f) for f in FRACS]), (F.col("o_custkey") % 5 + 1).cast("int"))
    task = F.when(F.col("o_orderstatus") == "F", F.lit("Fact Verification")).otherwise(
        F.lit("Question Answering")
    )
    o = t.orders.select(
        F.col("o_orderpriority").alias("dataset_name"),
        task.alias("task"),
        frac.alias("frac"),
        (F.col("o_orderkey") % 3).alias("run"),
        (F.col("o_totalprice") / 1e5).alias("metric"),
    ).filter(~((F.col("dataset_name") == "5-LOW") & (F.col("frac") == 0.0)))
    return o.groupBy("dataset_name", "task", "frac", "run").agg(F.avg("metric").alias("metric"))


def fx_equiv(t: Tables) -> DataFrame:
    """Replacement-value results: metric per (dataset, synthetic n, real n)."""
    p = t.part.select(
        F.col("p_brand").alias("dataset_name"),
        (F.lit(1000) * (F.lit(1) + F.col("p_size") % 10)).cast("long").alias("synthetic"),
        F.when(F.col("p_partkey") % 2 == 1, F.lit(200)).otherwise(F.lit(0)).cast("long").alias("real"),
        (F.col("p_retailprice") / 1000.0).alias("acc"),
    )
    return p.groupBy("dataset_name", "synthetic", "real").agg(F.avg("acc").alias("acc"))


def fx_usage(t: Tables) -> DataFrame:
    """Token usage per request."""
    e = t.events
    return e.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("user_id") % 2 == 0, F.lit(MODEL_EVEN)).otherwise(F.lit(MODEL_ODD)).alias("model"),
        (F.floor("value") * 10).cast("long").alias("prompt_tokens"),
        F.floor("value").cast("long").alias("completion_tokens"),
        F.col("ts"),
    )


def fx_logits(t: Tables, k: int = 2) -> DataFrame:
    e = t.embeddings
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("label"),
        F.slice(F.col("embedding"), 1, k).cast("array<double>").alias("logits"),
    )


def fx_token_vecs(t: Tables) -> DataFrame:
    e = t.embeddings
    return e.select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("pair_id"),
        (F.col("vec_id") % 2).alias("side"),
        (F.floor(F.col("vec_id") / 2) % 5).cast("long").alias("pos"),
        F.col("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def fx_urls(t: Tables) -> DataFrame:
    p = t.pages
    return p.select(
        F.col("page_id").alias("id"),
        F.concat(F.lit("see "), F.col("url"), F.lit(" and "), F.col("html")).alias("text"),
    )


def fx_completion_layouts(claim, context) -> list:
    """Completion texts shaped like §4.1 of FIXTURES.md, from a claim ``c``
    and an answer ``a`` (the context), each on one line."""
    c = F.array_join(words(claim), " ")
    a = F.array_join(words(context), " ")
    nl = F.lit("\n")
    return [
        F.concat(F.lit("Claim: "), c, F.lit("||"), nl, F.lit("Label: True")),
        F.concat(F.lit("Claim: "), c, F.lit("||"), nl, F.lit("Label: Untrue")),
        F.concat(F.lit("Claim: "), c, nl, F.lit("Verdict: not supported")),
        F.concat(F.lit("Question: "), c, F.lit("?||"), nl, F.lit("Answer: "), a),
        F.concat(F.lit("Question: "), c, F.lit("?|"), a, F.lit("|x")),
        F.concat(F.lit("|True Claim: "), c, F.lit("|")),
        F.concat(F.lit("|Untrue Claim: "), c, F.lit("|")),
        F.concat(c, F.lit("?"), nl, a),
        F.concat(F.lit("Claim: "), c, F.lit("||"), nl, F.lit("Label: incorrect")),
        F.lit("nothing useful"),
    ]


def fx_completions(t: Tables, explained: bool = False) -> DataFrame:
    """Completions, one per fx_fv row, layout chosen by ``id mod 10``."""
    fv = fx_fv(t)
    if explained:
        c = F.array_join(words("claim"), " ")
        a = F.array_join(words("context"), " ")
        e = F.array_join(words("syn_claim"), " ")
        text = F.when(
            F.col("id") % 10 < 5,
            F.concat(F.lit("Explanation: "), e, F.lit("||\nQuestion: "), c, F.lit("?||\nAnswer: "), a),
        ).otherwise(
            F.concat(F.lit("Explanation: "), e, F.lit("||\nClaim: "), c, F.lit("||\nLabel: "),
                     F.when(F.col("label") == 1, F.lit("True")).otherwise(F.lit("Untrue")))
        )
    else:
        layouts = fx_completion_layouts("claim", "context")
        text = F.element_at(F.array(*layouts), (F.col("id") % 10 + 1).cast("int"))
    return fv.select("id", "dataset_name", text.alias("completion"))
