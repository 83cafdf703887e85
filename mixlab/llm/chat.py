"""Chat formatting from event logs (operator 6, DataFrame functions only).

A log holds events (conv_id, seq, turn, kind, role, text). Events are dealt by conversation and block of
``BLOCK_TURNS`` turns, sorted by sequence and folded into final messages:

* ``message`` puts a message of its own at its turn,
* ``delta`` appends its text to the turn's last message (or starts one),
* ``edit`` replaces the text of the turn's last message (or starts one),
* ``regenerate`` discards the turn's messages and every later turn written so far, and starts anew with its text.

The final messages of a block are rendered as one piece of the conversation; pieces in order of ``block``
joined without a separator are the whole. A turn is written as::

    ### role:
    text
    </turn>

with control strings of the text escaped reversibly: ``\\`` as ``\\b``, ``###`` as ``\\h``, ``</turn>`` as ``\\t``
(and a line end within a role as ``\\n``). ``loss`` lists the spans (start, length in code points) of
assistant texts within the piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 64
END = "\n</turn>\n"
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
MESSAGE = "struct<turn:bigint,role:string,text:string>"


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in (*ESCAPES, *((("\n", "\\n"), (":", "\\c")) if role else ())):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    """The backslash is last: until then every backslash starts a code, and no code's letter is one."""
    for plain, code in reversed((*ESCAPES, *((("\n", "\\n"), (":", "\\c")) if role else ()))):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: Column) -> Column:
    """Final messages of sorted events (seq, kind, turn, role, text, tie). Deltas are joined at the end."""
    empty = F.expr(f"cast(array() as array<{MESSAGE}>)")

    def step(done: Column, e: Column) -> Column:
        # place of the last message of the event's turn, from 1; 0: none
        at = F.coalesce(F.array_max(F.filter(F.transform(done, lambda m, k: F.when(m.turn == e.turn, k + 1)), lambda k: k.isNotNull())), F.lit(0))
        fresh = F.struct(e.turn.alias("turn"), e.role.alias("role"), e.text.alias("text"))
        one = F.array(fresh)
        put = lambda text: F.transform(done, lambda m, k: F.when(k + 1 == at, F.struct(m.turn.alias("turn"), m.role.alias("role"), text(m).alias("text"))).otherwise(m))
        before = F.filter(done, lambda m: m.turn < e.turn)
        return (
            F.when(e.kind == "regenerate", F.concat(before, one))
            .when((e.kind == "delta") & (at > 0), put(lambda m: F.concat(m.text, e.text)))
            .when((e.kind == "edit") & (at > 0), put(lambda m: e.text))
            .otherwise(F.concat(done, one))
        )

    return F.aggregate(events, empty, step)


def render(events: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, block, piece, loss, n_turns) of an event log.

    Null texts and roles count as empty, an unknown kind as ``message``; events of a null turn or seq come first.
    Equal events that were logged twice are messages twice. Extra columns are ignored; an empty log gives no rows.
    """
    log = events.select(
        "conv_id", F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))).alias("seq"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # a regeneration voids what was written before it at later turns, in whatever block: its last seq per turn is enough
    redone = log.where("kind = 'regenerate'").groupBy("conv_id", "turn").agg(F.max("seq").alias("seq"))
    redone = redone.groupBy(F.col("conv_id").alias("_conv")).agg(F.collect_list(F.struct("turn", "seq")).alias("_redone"))
    log = log.join(redone, log.conv_id.eqNullSafe(F.col("_conv")), "left")
    void = F.exists("_redone", lambda r: (r.turn < F.col("turn")) & (r.seq > F.col("seq")))
    log = log.where(F.col("_redone").isNull() | ~void)
    block = F.floor(F.col("turn") / F.lit(block_turns)).cast("long")
    blocks = log.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("seq", "turn", "kind", "role", "text"))).alias("events"))
    folded = blocks.select("conv_id", "block", F.explode(F.array(fold(F.col("events")))).alias("messages"))
    folded = folded.select("conv_id", "block", F.explode(F.array(F.array_sort("messages", _by_turn))).alias("messages"))
    parts = F.transform("messages", lambda m: F.struct(F.concat(F.lit("### "), escape(m.role, role=True), F.lit(":\n")).alias("head"), escape(m.text).alias("body"), (m.role == "assistant").alias("learn")))
    parted = folded.select("conv_id", "block", F.explode(F.array(parts)).alias("parts"))
    piece = F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(END))), "")
    begin = F.expr("cast(struct(0 as at, array() as spans) as struct<at:int,spans:array<struct<start:int,length:int>>>)")

    def span(acc: Column, p: Column) -> Column:
        start, length = acc["at"] + F.length(p.head), F.length(p.body)
        own = F.when(p.learn, F.array(F.struct(start.alias("start"), length.alias("length")))).otherwise(F.expr("cast(array() as array<struct<start:int,length:int>>)"))
        return F.struct((start + length + len(END)).alias("at"), F.concat(acc.spans, own).alias("spans"))

    loss = F.aggregate("parts", begin, span, lambda acc: acc.spans)
    return parted.select("conv_id", "block", piece.alias("piece"), loss.alias("loss"), F.size("parts").cast("long").alias("n_turns"))


def _by_turn(a: Column, b: Column) -> Column:
    """Stable: messages of one turn keep the order of the fold."""
    return F.when(a.turn < b.turn, -1).when(a.turn > b.turn, 1).otherwise(0)


def parse(piece: Column) -> Column:
    """Turns (role, text) read back from a piece."""
    rows = F.filter(F.split(piece, "\n</turn>\n"), lambda s: s != "")

    def turn(s: Column) -> Column:
        cut = F.instr(s, ":\n") if isinstance(s, str) else F.locate(":\n", s)
        return F.struct(unescape(F.substring(s, F.lit(5), cut - 5), role=True).alias("role"), unescape(F.substring(s, cut + 2, F.length(s))).alias("text"))

    return F.transform(rows, turn)


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from its pieces: turns and loss text, hashed.

    A digest needs the conversation's texts together; what is gathered is a row per block.
    """
    read = pieces.select("conv_id", "block", "n_turns", F.length("piece").cast("long").alias("chars"), F.explode(F.array(parse(F.col("piece")))).alias("turns"), "piece", "loss")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("piece"), s.start + 1, s.length))), "")
    read = read.select("conv_id", "chars", F.size("turns").cast("long").alias("n"), F.struct("block", turns.alias("turns"), learned.alias("learned")).alias("part"))
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    texts = F.array_join(F.col("parts.turns"), "")
    loss = F.array_join(F.col("parts.learned"), "")
    return whole.select("conv_id", "n_turns", F.sha2(texts, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def from_turns(conversations: DataFrame) -> DataFrame:
    """The event log of a table of finished turns (conv_id, turn, role, text)."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")
