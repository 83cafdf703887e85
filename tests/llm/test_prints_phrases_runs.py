"""Operators 11 to 13 against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlab.llm import periodic_runs, phrases, queries, weighted_prints
from mixlab.llm.common import read

SF = "/root/testdata/sf0.001"
BLANKS = "[\x20\x09-\x0d]+"


# --- operator 13 ---------------------------------------------------------------------------------


def brute_runs(x, exponent=4, length=6):
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        p = 0
        while p < n - q:
            if x[p] != x[p + q]:
                p += 1
                continue
            s = p
            while p < n - q and x[p] == x[p + q]:
                p += 1
            if p - s + q >= max(length, exponent * q):
                out.setdefault((s, p + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


@pytest.mark.parametrize("step", [1, 7, 1000])
@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_runs_match_brute_force_however_words_are_appended(step, exponent):
    rnd = random.Random(step * 10 + exponent)
    for _ in range(60):
        n, letters = rnd.randint(0, 90), rnd.choice([1, 2, 3, 6])
        x = [rnd.randrange(letters) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):
            if n > 4:
                a, p, m = rnd.randrange(n), rnd.randint(1, n // 4), rnd.randint(0, n)
                for i in range(a + p, min(n, a + m)):
                    x[i] = x[i - p]
        catcher = periodic_runs.SquareCatcher(exponent, 2)
        for at in range(0, n, step):
            catcher.append(np.array(x[at : at + step], dtype=np.int64))
        assert catcher.runs() == brute_runs(x, exponent, 2)


def test_runs_of_long_periodic_texts():
    assert periodic_runs.find_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    passage = [f"w{k}" for k in range(5_000)]
    assert periodic_runs.find_runs(["x", *passage * 5]) == [(1, 25_000, 5_000)]
    assert periodic_runs.find_runs(["a"] * 5) == [] and periodic_runs.find_runs([]) == []


def test_op13_rows(spark):
    rows = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    planted = {r.doc_id: r.text for r in periodic_runs.plant(read(spark, SF, "documents")).collect()}
    assert rows.keys() == planted.keys() and any(r.n_runs for r in rows.values())
    for k, r in rows.items():
        words = [w for w in re.split(BLANKS, planted[k] or "") if w]
        runs = brute_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def test_runs_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "a b " * 5, 0), (2, "x y", 0), (2, "x y", 0)], "doc_id long, text string, runs int")
    rows = [(r.doc_id, r.n_words, len(r.runs), r.collapsed) for r in periodic_runs.mark_runs(docs).collect()]
    assert sorted(rows, key=str) == sorted([(1, 0, 0, ""), (1, 0, 0, ""), (None, 10, 1, "a b"), (2, 1, 0, "x y"), (2, 1, 0, "x y")], key=str)
    assert periodic_runs.digests(periodic_runs.mark_runs(docs.limit(0))).count() == 0


# --- operator 12 ---------------------------------------------------------------------------------


def brute_phrases(docs, min_count=10, top=2000):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = [x for x in re.split("[\x20\x09]", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        covered = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * count[q]}
        rows = []
        for p, a in found.items():
            if p not in covered:
                score, k = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_phrases_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TRIE_PHRASES", 40)  # many tries, split by phrase as well
    monkeypatch.setattr(phrases, "CACHED_WORDS", 300)
    docs = read(spark, SF, "documents").select("lang", "text")
    got = phrases.top(phrases.collocations(docs, min_count=10))
    assert sorted(map(tuple, got.collect())) == brute_phrases([tuple(r) for r in docs.collect()])


def test_phrases_of_odd_rows(spark):
    rows = [(None, "New\tYork. new york, NEW  YORK" * 5, 1), ("und", "new york\x0bcity", 1), ("fr", None, 1), ("fr", "", 1), ("de", "é. É é", 1)] * 3
    docs = spark.createDataFrame(rows, "lang string, text string, score int")
    got = phrases.top(phrases.collocations(docs))
    assert sorted(map(tuple, got.collect())) == brute_phrases([r[:2] for r in rows]) != []
    assert phrases.top(phrases.collocations(docs.limit(0))).count() == 0


@pytest.mark.parametrize("many", [7, 500_000])
def test_passes_do_not_grow_with_the_candidates(spark, monkeypatch, many):
    written, save = [], phrases.saved
    monkeypatch.setattr(phrases, "saved", lambda df, name: written.append(name) or save(df, name))
    monkeypatch.setattr(phrases, "build_trie", None)  # here only: the driver holds no trie
    monkeypatch.setattr(phrases, "TRIE_PHRASES", many)
    monkeypatch.setattr(phrases, "PART_WORDS", 500, raising=False)
    monkeypatch.setattr(phrases, "HELD_PLACES", 100, raising=False)
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), " ".join(rnd.choice("uvwxyz") for _ in range(60))) for _ in range(200)]
    got = phrases.top(phrases.collocations(spark.createDataFrame(rows, "lang string, text string")))
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows) != []
    assert sorted(written) == ["phrases"] * 3 + ["sequences", "words"]


def test_phrases_of_one_hash_are_counted_apart():
    x, y = [5, 6], [7, 8]  # as if both had one hash: their rows stand in any order
    rows = np.array([x, y, x, y, x], dtype=np.uint64)
    got = phrases._by_trie(["de"], np.zeros(5, dtype=np.int64), rows, np.array([4, 3, 2, 3, 4]), 7)
    assert [(r["lang"], np.frombuffer(r["codes"], np.uint64).tolist(), r["n"]) for r in got.to_pylist()] == [("de", x, 10)]


def test_trie_accepts_its_phrases_only():
    rng = np.random.default_rng(0)
    codes = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    held = codes[np.unique(rng.integers(0, 300, (4000, 3)) ** 2 // 300, axis=0)]
    lang = np.array(["a" if k % 3 else "b" for k in range(len(held))], dtype=object)
    trie = phrases.build_trie(lang, held)
    assert len(set(trie.accepting.tolist())) == len(held)
    text = np.append(held.ravel(), codes[rng.integers(0, 300, 5000)])
    known = {("a" if k % 3 else "b", *p): s for k, (p, s) in enumerate(zip(held.tolist(), trie.accepting.tolist()))}
    for x in "ab":
        want = Counter(known[x, *t] for t in zip(*(text[k : len(text) - 2 + k].tolist() for k in range(3))) if (x, *t) in known)
        assert Counter(trie.states(x, text, 3, np.arange(len(text) - 2)).tolist()) == want


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**13 + 7
    row = spark.sql(f"SELECT CAST(1000000 AS DECIMAL(7,0)) * CAST({big} AS DECIMAL(15,0)) * CAST({big} AS DECIMAL(15,0)) div (CAST({big + 1} AS DECIMAL(15,0)) * CAST({big + 2} AS DECIMAL(15,0))) AS s").first()
    assert row.s == 1000000 * big * big // ((big + 1) * (big + 2))


# --- operator 11 ---------------------------------------------------------------------------------


def terms(text):
    w = [x for x in re.split(BLANKS, text) if x]
    return [(w[0], None)] if len(w) == 1 else list(zip(w, w[1:]))


def brute_prints(spark, texts):
    """128 bits of each text, with the hashes of its terms taken one by one."""
    every = sorted({t for x in texts for t in terms(x)}, key=str)
    rows = spark.createDataFrame(every, "x string, y string").select("x", "y", F.xxhash64("x", "y").alias("a"), F.xxhash64(F.lit(1), "x", "y").alias("b")).collect()
    code = {(r.x, r.y): (r.a % (1 << 64)) | (r.b % (1 << 64)) << 64 for r in rows}
    out = []
    for text in texts:
        own = [(code[t], min(15, len(t[0]) + len(t[1] or ""))) for t in terms(text)]
        total = sum(w for _, w in own)
        out.append(sum(1 << k for k in range(128) if 2 * sum(w for h, w in own if h >> k & 1) > total))
    return out


def edit(texts):
    """Edited texts of texts in their order."""
    return [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]


@pytest.mark.parametrize("chars", [5_000, 1 << 30])
def test_fingerprints_match_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(weighted_prints, "BUCKET_CHARS", chars)
    docs = read(spark, SF, "documents").where("length(text) < 3000")
    rows = {r.doc_id: r for r in weighted_prints.compare(docs).collect()}
    held = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    texts = [t for _, t in held]
    own, new = brute_prints(spark, texts), brute_prints(spark, edit(texts))
    assert len(rows) == len(held)
    for k, (doc_id, text) in enumerate(held):
        r, following = rows[doc_id], own[(k + 1) % len(own)]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit(texts)[k].encode()).hexdigest()
        assert (int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (own[k], new[k])
        assert r.near_edited == pytest.approx(1 - (own[k] ^ new[k]).bit_count() / 128)
        assert r.near_next == pytest.approx(1 - (own[k] ^ following).bit_count() / 128)
        assert r.n_near == (sum((own[k] ^ x).bit_count() <= 6 for x in own) - 1 if doc_id % 50 == 0 else None)


def test_fingerprints_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(weighted_prints, "BUCKET_CHARS", 40)
    monkeypatch.setattr(weighted_prints, "BLOCK_TERMS", 3)  # many blocks of one text
    texts = [(7, "one two three four five six seven"), (7, "one two three four five six seven"), (7, "z"), (3, None), (3, ""), (0, "é" * 9), *[(None, f"no id {k}") for k in range(6)], *[(5, f"hot {k}") for k in range(9)]]
    docs = spark.createDataFrame([(*x, 1) for x in texts], "doc_id long, text string, _bucket int")
    rows = weighted_prints.compare(docs).collect()
    order = sorted(((i, t or "") for i, t in texts), key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.sha256(x[1].encode()).hexdigest()))
    held = [t for _, t in order]
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, t), e in zip(order, edit(held)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == want
    assert {int(r.fingerprint, 16) for r in rows} == set(brute_prints(spark, held))
    assert weighted_prints.compare(docs.limit(0)).count() == 0


def test_search_finds_every_pair_within_the_radius(spark):
    rnd = random.Random(3)
    centres = [rnd.getrandbits(128) for _ in range(20)]
    points = {c ^ sum(1 << b for b in rnd.sample(range(128), rnd.randint(0, 8))) for c in centres for _ in range(15)}

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    table = spark.createDataFrame([(signed(p % (1 << 64)), signed(p >> 64)) for p in points], "f0 long, f1 long")
    got = [((r.f1 % (1 << 64)) << 64 | r.f0 % (1 << 64), (r.g1 % (1 << 64)) << 64 | r.g0 % (1 << 64), r.bits) for r in weighted_prints.near(table, table).collect()]
    assert sorted(got) == sorted((a, b, (a ^ b).bit_count()) for a in points for b in points if 0 < (a ^ b).bit_count() <= 6)


def test_operator_11_has_no_python_in_its_plan(spark):
    plan = weighted_prints.compare(read(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert not re.search("MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroups", plan)


def test_search_broadcasts_no_table_that_grows(spark, tmp_path):
    spark.range(3000).select(F.xxhash64("id").alias("f0"), F.xxhash64(F.lit(7), "id").alias("f1")).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    for found in (weighted_prints.near(table, table), weighted_prints.compare(read(spark, SF, "documents"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
