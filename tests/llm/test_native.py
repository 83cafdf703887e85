"""Exact dedup, decontamination, chat, sharding: oracle SQL and planted cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import mixlab.plans.check as check
from mixlab.llm import chat, decontaminate, exact_dedup, queries, sharding

from ..conftest import SF01

DOC = "doc_id long, text string, lang string, kept string, slot int"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], DOC)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = check.duck_con(SF01)
    cols, rows = check.rows_of_spark(queries.QUERIES[name](spark, SF01))
    names, expected = check.rows_of_duck(con, queries.ORACLE[name])
    assert cols == names and sorted(map(repr, rows)) == sorted(map(repr, expected)) and rows


def test_exact_dedup_edge_cases(spark):
    same = [(k, "a  b\n") for k in range(40, 60)]
    rows = docs(spark, *same, (3, "a b "), (1, None), (2, ""), (5, "x"), (5, "x"), (None, "x"), (7, " "))
    got = {(r.doc_id, r.text_sha256, r.kept): r for r in exact_dedup.mark_duplicates(rows, support=0.1).collect()}
    assert sum(r.kept for r in got.values()) == 4
    heavy = [r for r in got.values() if r.doc_id in range(40, 60)]
    assert len(heavy) == 20 and all(r.keep_id == 3 and r.group_size == 21 and not r.kept for r in heavy)
    assert {r.keep_id for r in got.values() if r.doc_id in (1, 2)} == {1}
    kept = exact_dedup.exact_dedup(rows, support=0.1)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7]
    assert exact_dedup.mark_duplicates(rows.limit(0)).count() == 0


def test_native_plans_have_no_python(spark):
    for name in ("op2_exact_dedup", "op6_chat", "op8_decontaminate"):
        plan = queries.QUERIES[name](spark, SF01)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def overlaps(doc, item):
    """Brute force: (matches, doc_pos, item_pos) of all windows with few substitutions."""
    W, least = decontaminate.WINDOW, decontaminate.WINDOW - decontaminate.MAX_SUBSTITUTIONS
    found = []
    for i in range(len(doc) - W + 1):
        for j in range(len(item) - W + 1):
            m = sum(x == y for x, y in zip(doc[i : i + W], item[j : j + W]))
            if m >= least:
                found.append((m, i, j))
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(12)] + [f"rare{k}" for k in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (30, 20, 13, 12, 5)]
    texts = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if k % 2:
            part = list(rng.choice(items))
            for at in rng.sample(range(len(part)), min(len(part), k % 7)):
                part[at] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        texts.append(words)
    bench = spark.createDataFrame([(k, " ".join(w).upper()) for k, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    rows = docs(spark, *[(k, ", ".join(w)) for k, w in enumerate(texts)], (100, None), (None, " ".join(items[0])), (101, ""), (1, ", ".join(texts[1])))
    got = {(r.doc_id, r.item_id): (r.window_matches, r.doc_pos, r.item_pos) for r in decontaminate.contaminated(rows, bench).collect()}
    expected = {}
    for d, words in enumerate(texts):
        for i, item in enumerate(items):
            if found := overlaps(words, item):
                expected[d, i] = min((-m, a, b) for m, a, b in found)
    assert got == {k: (-m, a, b) for k, (m, a, b) in expected.items()} and got
    clean = decontaminate.drop_contaminated(rows, bench)
    assert clean.columns == rows.columns and {r.doc_id for r in clean.collect()} == ({*range(60), 100, 101, None} - {d for d, _ in expected})
    assert decontaminate.contaminated(rows.limit(0), bench).count() == 0 == decontaminate.contaminated(rows, bench.limit(0)).count()


def test_decontamination_decides_each_row_by_its_own_text(spark):
    item = " ".join(f"bench{k}" for k in range(20))
    bench = spark.createDataFrame([(3, item)], "item_id long, text string")
    rows = docs(spark, (1, f"see {item}"), (1, "clean text"), (None, f"{item} end"), (None, "also clean"), (2, item), (2, item), (None, None))
    left = lambda **o: sorted(((r.doc_id, r.text) for r in decontaminate.drop_contaminated(rows, bench, **o).collect()), key=repr)
    clean = [(1, "clean text"), (None, "also clean"), (None, None)]
    assert left(null_ids=True) == sorted(clean, key=repr)
    assert left() == sorted([*clean, (None, f"{item} end")], key=repr)
    found = {(r.doc_id, r.item_id, r.doc_pos, r.window_matches, r.n_windows) for r in decontaminate.contaminated(rows, bench, null_ids=True).collect()}
    assert found == {(1, 3, 1, 13, 8), (None, 3, 0, 13, 8), (2, 3, 0, 13, 8)}


def test_every_pattern_of_substitutions_is_hit():
    from itertools import combinations

    for bad in combinations(range(decontaminate.WINDOW), decontaminate.MAX_SUBSTITUTIONS):
        assert any(all(at + o not in bad for o in m) for m in decontaminate.MASKS for at in range(decontaminate.WINDOW - m[-1]))


EVENT = "conv_id long, seq long, turn long, kind string, role string, text string, extra int"


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "message", "user", "hi", 0),
        (1, 1, 1, "delta", "assistant", "he", 0),
        (1, 2, 1, "delta", "assistant", "llo", 0),
        (1, 3, 2, "message", "user", "more", 0),
        (1, 4, 200, "delta", "assistant", "lost", 0),
        (1, 5, 1, "regenerate", "assistant", "good", 0),
        (1, 6, 1, "delta", "assistant", "bye", 0),
        (1, 7, 2, "message", "user", None, 0),
        (1, 8, 0, "edit", "user", "hi \\t ### </turn>\n</turn>\n", 0),
        (2, 0, 0, None, None, "x", 0),
        (2, 0, 0, None, None, "x", 0),
        (None, 0, 0, "message", "assistant", "a\\", 0),
    ]
    rng = random.Random(1)
    rng.shuffle(log)
    pieces = chat.render(spark.createDataFrame(log, EVENT))
    turns = {}
    for r in pieces.select("conv_id", "piece", "loss", chat.parse(F.col("piece")).alias("t")).orderBy("block").collect():
        turns.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.t)
        for s in r.loss:
            assert r.piece[s.start : s.start + s.length] in ("goodbye", "a\\b")
    assert turns == {1: [("user", "hi \\t ### </turn>\n</turn>\n"), ("assistant", "goodbye"), ("user", "")], 2: [("", "x"), ("", "x")], None: [("assistant", "a\\")]}
    assert chat.render(spark.createDataFrame([], EVENT)).count() == 0


def test_chat_blocks_and_odd_texts(spark):
    odd = ["\\", "\\\\", "###", "####", "</turn>", "\n</turn>\n", "\\h", "\\b\\t", "", None, "é\U0001f600", "### assistant:\n", ":\n", "\\n\\c"]
    rows = [(9, t, odd[t % len(odd)] if t % 3 == 0 else ("assistant" if t % 3 == 1 else "user"), odd[t % len(odd)]) for t in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    pieces = chat.render(chat.from_turns(table))
    assert pieces.count() == 5
    got = chat.digests(pieces).first()
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)
    loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert got.n_turns == 300 and got.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_lookup_table_is_even_and_stable():
    names = [f"s{k}" for k in range(20)]
    full = sharding.lookup_table(names, 4099)
    counts = [full.count(k) for k in range(20)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(full, fewer) if a != 19)
    assert moved < 0.1 * 4099
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 4100)


def test_placement(spark, tmp_path):
    rows = docs(spark, *[(k, str(k)) for k in range(50)], (None, "n"), (3, "again"))
    placed = sharding.place(rows, shards=["a", "b", "c"], size=101)
    got = [(r.doc_id, r.shard, r.slot) for r in placed.collect()]
    table = sharding.lookup_table(["a", "b", "c"], 101)
    for i, shard, slot in got:
        assert slot == int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16) % 101 and shard == "abc"[table[slot]]
    assert len(got) == 52 and sharding.place(rows.limit(0)).count() == 0
    sharding.write_shards(rows, f"{tmp_path}/out", shards=["a", "b"], size=101)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 52
