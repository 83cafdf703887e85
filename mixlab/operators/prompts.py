"""Generation inputs and result ingestion.

Few-shot assembly never resamples the table per row (quadratic in the
reference). Rows are ranked once within their (dataset, label) group by the
seeded md5 key; the row of rank r takes as examples the rows of rank
r+1..r+k (cyclically) -- distinct, never itself, deterministic. They are the
next rows in the order of the ranks, so they are read beside the row where it is ranked; only those
behind the end of a bucket of the ranks are found by an equi join on (group, rank), whose keys are unique so no key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlab.functions.keys import DEFAULT_SEED, exact_rank, order_key
from mixlab.functions.text import strip_urls, truncate_words
from mixlab.operators.parse import parse_cot_fv, parse_cot_qa, parse_fv, parse_qa
from mixlab.operators.sampling import sample_per_group, slices

# Prompt texts and templates of the reference.
PROMPT_TEMPLATE = "Context: [CONTEXT]"
SYSTEM = {
    ("qa", False): "Given the context, come up with a question and answer pair. Answer in the format below:",
    ("qa", True): "Given the context, come up with a question and answer pair. Explain why it is a good example "
                  "before providing it in the format below:",
    ("fv", False): "Given the context, come up with a [LABEL] claim. Answer in the format below:",
    ("fv", True): "Given the context, come up with a [LABEL] claim. Explain why it is a good example before "
                  "providing it in the format below:",
}
ANSWER_TEMPLATE = {
    ("qa", False): "Question: [QUESTION]||\nAnswer: [ANSWER]",
    ("qa", True): "Explanation: [EXPLANATION]||\nQuestion: [QUESTION]||\nAnswer: [ANSWER]",
    ("fv", False): "Claim: [CLAIM]||\nLabel: [LABEL]",
    ("fv", True): "Explanation: [EXPLANATION]||\nClaim: [CLAIM]||\nLabel: [LABEL]",
}
LABEL_TRUE_SYSTEM = "True"
LABEL_FALSE_SYSTEM = "Untrue (either False or just not supported)"
LABEL_TRUE_ANSWER = "True"
LABEL_FALSE_ANSWER = "Untrue"
MAX_CONTEXT_WORDS = 3000
MODEL = "gpt-3.5-turbo"
MAX_TOKENS = 120
METHOD = "POST"
ENDPOINT = "/v1/chat/completions"
K_EXAMPLES = 3
#: Leading digits of the key that make a bucket of the ranks: fewer, larger buckets have fewer rows near their ends.
SHOT_HEX_DIGITS = 2


def _rep(template: Column, slot: str, value: Column) -> Column:
    return F.replace(template, F.lit(f"[{slot}]"), value)


def context_message(context: str | Column) -> Column:
    """User turn: template filled, truncated to 3000 words, URLs removed."""
    ctx = F.col(context) if isinstance(context, str) else context
    return strip_urls(truncate_words(_rep(F.lit(PROMPT_TEMPLATE), "CONTEXT", ctx), MAX_CONTEXT_WORDS))


def system_message(task: str, explained: bool, label: Column | None) -> Column:
    s = F.lit(SYSTEM[(task, explained)])
    if task == "fv" and label is not None:
        s = _rep(s, "LABEL", F.when(label == 1, F.lit(LABEL_TRUE_SYSTEM)).otherwise(F.lit(LABEL_FALSE_SYSTEM)))
    return s


def answer_message(task: str, explained: bool, prefix: str = "") -> Column:
    """Assistant turn from the example's columns (``prefix`` + name)."""
    t = F.lit(ANSWER_TEMPLATE[(task, explained)])
    c = lambda n: F.col(prefix + n)
    if task == "qa":
        t = _rep(_rep(t, "QUESTION", c("question")), "ANSWER", c("answer"))
    else:
        lab = F.when(c("label") == 1, F.lit(LABEL_TRUE_ANSWER)).otherwise(F.lit(LABEL_FALSE_ANSWER))
        t = _rep(_rep(t, "CLAIM", c("claim")), "LABEL", lab)
    if explained:
        t = _rep(t, "EXPLANATION", c("explanation"))
    return strip_urls(t)


def _messages_long(rows: DataFrame, ex: DataFrame, task: str, explained: bool, k: int, id_col: str) -> DataFrame:
    """rows(id, context, label?) + ex(id, j, ex_*) -> (id, pos, role, content)."""
    label = F.col("label") if task == "fv" else None
    head = rows.select(id_col, F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("system").alias("role"),
                 system_message(task, explained, label).alias("content")),
        F.struct(F.lit(2 * k + 1).alias("pos"), F.lit("user").alias("role"),
                 context_message("context").alias("content")))).alias("m")).select(id_col, "m.*")
    shots = ex.select(id_col, F.explode(F.array(
        F.struct((2 * F.col("j") - 1).alias("pos"), F.lit("user").alias("role"),
                 context_message("ex_context").alias("content")),
        F.struct((2 * F.col("j")).alias("pos"), F.lit("assistant").alias("role"),
                 answer_message(task, explained, "ex_").alias("content")))).alias("m")).select(id_col, "m.*")
    return head.unionByName(shots)


def few_shot(df: DataFrame, task: str, k: int = K_EXAMPLES, seed: int = DEFAULT_SEED,
             by: Sequence[str] = ("dataset_name",), id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(messages (id, pos, role, content), rejects (id)).

    fv rows draw examples of their own label; qa rows from their dataset.
    Groups with k rows or fewer cannot supply k distinct other rows: rejects.
    """
    group = [*by, "label"] if task == "fv" else list(by)
    cols = ["context", "question", "answer"] if task == "qa" else ["context", "claim", "label"]
    ranked = exact_rank(df, order_key(id_col, seed), tiebreak=[id_col], partition_by=group, name="_r", size_name="_n",
                        hex_digits=SHOT_HEX_DIGITS, ahead=(cols, k))
    rejects = ranked.filter(F.col("_n") <= k).select(id_col)
    ok = ranked.filter((F.col("_n") > k) & (F.col("_at") >= 1))  # always true: rows and heads read the same columns, so one shuffle
    grouped = reduce(and_, [F.col(g).isNotNull() for g in group])  # a NULL group has no examples
    near = ok.select(id_col, grouped.alias("_g"), F.posexplode(F.concat(F.array(F.struct(*cols)), "_ahead")).alias("j", "_e"))
    near = near.where((F.col("j") == 0) | (F.col("_g") & F.col("_e").isNotNull()))  # 0: the row itself
    near = near.select(id_col, "j", *[F.col(f"_e.{c}").alias(f"ex_{c}") for c in cols])
    far = ok.select(id_col, *group, "_r", "_n", "_at", "_in", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j")).where(
        F.col("_at") + F.col("j") > F.col("_in")).withColumn("_pr", F.pmod(F.col("_r") - 1 + F.col("j"), F.col("_n")) + 1)
    heads = ok.where(F.col("_at") <= k).select(*group, F.col("_r").alias("_pr"), *[F.col(c).alias(f"ex_{c}") for c in cols])
    far = far.join(heads, [*group, "_pr"]).select(id_col, "j", *[f"ex_{c}" for c in cols])
    own = F.col("j") == 0
    label = F.col("ex_label") if task == "fv" else None
    turn = lambda pos, role, content: F.struct(pos.alias("pos"), F.lit(role).alias("role"), content.alias("content"))
    two = F.array(F.when(own, turn(F.lit(0), "system", system_message(task, False, label))).otherwise(
                      turn(2 * F.col("j"), "assistant", answer_message(task, False, "ex_"))),
                  turn(F.when(own, 2 * k + 1).otherwise(2 * F.col("j") - 1), "user", context_message("ex_context")))
    return near.unionByName(far).select(id_col, F.inline(two)), rejects


def curated_examples(df: DataFrame, task: str, per_group: int = 10, seed: int = DEFAULT_SEED,
                     by: Sequence[str] = ("dataset_name",), id_col: str = "id") -> DataFrame:
    """The curated explanation table (the reference ships none): at most
    ``per_group`` rows per (dataset, label) -- a proven size bound."""
    group = [*by, "label"] if task == "fv" else list(by)
    keyed = df.withColumn("_g", F.concat_ws("\u0001", *[F.col(g).cast("string") for g in group]))
    return sample_per_group(keyed, "_g", per_group, seed, id_col).drop("_g", "sample_rank")


# Primes whose product is beyond any row count, so that one of them divides no given count.
STRIDES = [101, 103, 107, 109, 113, 127, 131, 137, 139, 149]


def few_shot_explained(df: DataFrame, curated: DataFrame, task: str, k: int = K_EXAMPLES, seed: int = DEFAULT_SEED,
                       by: Sequence[str] = ("dataset_name",), id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(messages (id, pos, role, content), rejects (id)): k examples per row from the table of explained rows of
    the same dataset (and label for fv), of any size.

    The pool is ranked once within its groups by the seeded key. A row starts at a hashed rank and steps on by a
    hashed stride, a prime that does not divide the group's size m: so its k examples are distinct, and no candidate beside them
    is looked at. A row that stands in the pool itself steps over its own rank. Rows of groups without
    k (other) examples, and rows without a group, are rejects. Ids are unique.
    """
    group = [*by, "label"] if task == "fv" else list(by)
    cols = ["context", "explanation", "question", "answer"] if task == "qa" else ["context", "explanation", "claim", "label"]
    pool = exact_rank(curated, order_key(id_col, seed), tiebreak=[id_col], partition_by=group, name="_pr", size_name="_m")
    sizes = curated.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"))
    own = pool.select(id_col, (F.col("_pr") - 1).alias("_own"), *[F.col(g).alias(f"_o_{g}") for g in group])
    rows = df.select(id_col, *group).join(sizes, group, "left").join(own, id_col, "left")
    for g in group:  # a row's own rank counts in its own group only
        rows = rows.withColumn("_own", F.when(F.col(g) == F.col(f"_o_{g}"), F.col("_own"))).drop(f"_o_{g}")
    enough = F.coalesce(F.col("_m") - F.col("_own").isNotNull().cast("int") >= k, F.lit(False))

    h = order_key(id_col, seed, F.lit("examples"))
    number = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    strides = F.filter(F.array(*[F.lit(p).cast("long") for p in STRIDES]), lambda p: F.col("_m") % p != 0)
    stepped = rows.where(enough).withColumn("_s", strides).withColumn("_step", F.get("_s", (number(9) % F.size("_s")).cast("int")))
    ranks = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: (number(1) + j * F.col("_step")) % F.col("_m"))
    others = F.slice(F.filter(ranks, lambda r: F.col("_own").isNull() | (r != F.col("_own"))), 1, k)
    want = stepped.select(id_col, *group, F.posexplode(others).alias("_j", "_at")).select(
        id_col, *group, (F.col("_j") + 1).alias("j"), (F.col("_at") + 1).alias("_pr"))
    texts = pool.select(*group, "_pr", *[F.col(c).alias(f"ex_{c}") for c in cols])
    ex = want.join(texts, [*group, "_pr"]).select(id_col, "j", *[f"ex_{c}" for c in cols])
    full = df.join(rows.where(enough).select(id_col), id_col, "left_semi").select(id_col, "context", *(["label"] if task == "fv" else []))
    return _messages_long(full, ex, task, True, k, id_col), rows.where(~enough).select(id_col)


def requests(messages: DataFrame, df: DataFrame, by: Sequence[str] = ("dataset_name",), id_col: str = "id",
             model: str = MODEL, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One request per row: batch (five slices, W14), custom_id inside the
    batch, and the JSON body {model, messages[], max_tokens}. Messages are
    re-nested per row with a bounded collect (2k+2 turns)."""
    nested = messages.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("_m"))
    sl = slices(df.select(id_col, *by), by=by, id_col=id_col)
    j = sl.join(nested, id_col)
    body = F.to_json(F.struct(F.lit(model).alias("model"),
                              F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                                   m["content"].alias("content"))).alias("messages"),
                              F.lit(max_tokens).alias("max_tokens")))
    return j.select(id_col, *by, "batch", "custom_id", F.lit(METHOD).alias("method"), F.lit(ENDPOINT).alias("url"),
                    body.alias("body"))


RESULT_SCHEMA = "struct<custom_id:string,response:struct<body:struct<choices:array<struct<message:struct<content:string>>>>>>"


def result_line(custom_id: Column, content: Column) -> Column:
    """A batch-result JSON line as the service returns it."""
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.struct(
        content.alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))


def read_results(lines: DataFrame, line: str = "value") -> DataFrame:
    """S3: typed parse of result lines -> (custom_id, text)."""
    r = lines.select("*", F.from_json(F.col(line), RESULT_SCHEMA).alias("_r"))
    return r.withColumn("custom_id", F.col("_r.custom_id")).withColumn(
        "text", F.get(F.col("_r.response.body.choices"), 0)["message"]["content"]).drop("_r")


def realign(results: DataFrame, reqs: DataFrame, keys: Sequence[str] = ("dataset_name", "batch", "custom_id"),
            id_col: str = "id") -> DataFrame:
    """Results back to their source rows by (batch, custom_id) -- ids, not
    offsets, so a short batch shifts nothing (quirk Q4)."""
    return reqs.select(id_col, *keys).join(results, list(keys))


def ingest(results: DataFrame, task: str, explained: bool = False, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Parse completions into synthetic columns; (kept, rejects)."""
    if task == "qa":
        p = (parse_cot_qa if explained else parse_qa)(results, text, "_p")
        d = p.withColumn("syn_question", F.col("_p.question")).withColumn("syn_answer", F.col("_p.answer"))
    else:
        p = (parse_cot_fv if explained else parse_fv)(results, text, "_p")
        d = p.withColumn("syn_claim", F.col("_p.claim")).withColumn("syn_label", F.col("_p.label").cast("int"))
    return d.filter(~F.col("_p.rejected")).drop("_p"), d.filter(F.col("_p.rejected")).drop("_p")


def resume(todo: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Work still to do = todo minus finished ids (left anti join)."""
    return todo.join(done.select(id_col), id_col, "left_anti")
