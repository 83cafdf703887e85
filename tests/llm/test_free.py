"""Token files, SimHash, line dedup, toxicity, URLs, packing: brute force, round trips, held-out accuracy."""

import io
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from mixlab.llm import components, line_dedup, packing, queries, simhash, token_store, toxicity, url_templates
from mixlab.llm.common import saved, work_dir
from mixlab.llm.encoding import CACHED_WORD_BYTES, WordEncoder, default_tokenizer

from ..conftest import SF01, SF001

DOC = "doc_id long, text string, lang string, start int, fp string"
ODD = ["", None, " \t\n", "a\u00a0b \u2003c", "don't STOP 12345", "<|endoftext|> x<|startoftext|>", "e\u0301 \u00c9 \x1c \x85", "\u03a3\u0391\u03a3 OK", "<|ENDOFTEXT|> A<B", "E\u0301 \u0130I \u212a", "x" * 500, "\U0001f600 ### </turn>", "one\x0btwo\x0cthree\rfour"]


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], DOC)


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_word_encoder_equals_whole_texts(spark):
    texts = ODD + [r.text for r in table(spark, SF001, "documents").collect()]
    enc = WordEncoder(default_tokenizer())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [x[:-1] for x in whole_ids(texts)]
    assert max(map(len, enc.known)) <= CACHED_WORD_BYTES


def test_token_file_round_trip_and_corruption():
    docs = [(3, b""), (None, np.arange(5, dtype="<u4").tobytes()), (4, np.arange(1000, dtype="<u4").tobytes()), (4, b"\x01\0\0\0")]
    out = io.BytesIO()
    assert token_store.write_file(out, docs, frame_ids=300) == (4, 1006)
    f = token_store.TokenFile.open(out)
    assert [(f.doc_id(k), f.ids(k)) for k in (2, 0, 3, 1)] == [docs[k] for k in (2, 0, 3, 1)]
    assert len(f.frames) == 7
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(x for _, x in docs)
    bad = bytearray(out.getvalue())
    bad[int(f.at[3]) + 12] ^= 1
    f = token_store.TokenFile.open(io.BytesIO(bytes(bad)))
    assert f.ids(3) == docs[3][1]
    with pytest.raises(token_store.CorruptFrame):
        f.ids(2)


def test_token_store_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF01, "documents").collect()}
    ids = dict(zip(sorted(texts), whole_ids([texts[k] for k in sorted(texts)])))
    at, expected = 0, {}
    for k in sorted(ids):
        expected[k] = (at, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes()))
        at += len(ids[k])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_store(spark, SF01).collect()}
    assert got == expected


def test_token_store_edge_cases(spark):
    rows = docs(spark, *enumerate(ODD), (3, "again"), (None, "no id"))
    folder = work_dir(spark, "store")
    manifest = token_store.write_tokens(rows, folder, shards=3)
    got = token_store.read_tokens(manifest).collect()
    assert len(got) == len(ODD) + 2 and sorted(r.start for r in got)[0] == 0
    one = token_store.fetch(f"{folder}/manifest", spark, [4]).collect()
    assert [r.ids for r in one] == whole_ids([ODD[4]])
    assert token_store.token_files(rows.limit(0)).count() == 0


def slow_fingerprint(text, n):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(nodes, linked):
    """node -> smallest node reachable."""
    nodes, root = sorted(nodes), {}
    for n in nodes:
        if n in root:
            continue
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = n
                stack += [y for y in nodes if y not in root and linked(x, y)]
    return root


def test_simhash_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF01, "documents").collect()}
    fps = {k: simhash.fingerprint(t) for k, t in texts.items()}
    for k in list(texts)[:60]:
        assert fps[k] == slow_fingerprint(texts[k], 3)
    root = closure(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, SF01).collect()}
    assert got == {k: (f"{fps[k]:016x}", root[k]) for k in texts}


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_index_finds_every_link(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    fps = set(base)
    for x in base:
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            fps.add(y)
    fps |= {(base[0] & ~0xFFFF) | v for v in range(0, 400, 3)}  # a long list
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits)
    got = {r.node: r.root for r in components.components(links).collect()}
    expected = closure(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= bits)
    assert {k: got.get(k, k) for k in signed} == expected


def test_simhash_edge_cases(spark):
    rows = docs(spark, (5, None), (2, ""), (7, "A b"), (8, "a  B"), (9, "x " * 30000), (9, "x " * 30000), (None, "a b"), (11, " "))
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == 8
    zero = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
    assert zero[5] == zero[2] == zero[11] == ("0" * 16, 2) and zero[8][1] == 7 == zero[None][1]
    kept = simhash.keep_representatives(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [2, 7, 9]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_simhash_keeps_rows_that_only_share_an_id(spark):
    texts = ["one two three four five", "six seven eight nine ten", "red green blue black white"]
    assert all((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 2 for a in texts for b in texts if a != b)
    rows = docs(spark, *[(None, t) for t in texts], (None, texts[0]), (4, texts[1]), (6, "to be or not"), (6, "that is the question"), (6, "to be or not"))
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_representatives(rows).collect()), key=repr)
    assert kept == sorted([(None, texts[0]), (None, texts[2]), (4, texts[1]), (6, "to be or not"), (6, "that is the question")], key=repr)


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (500, 501), (501, 501)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(200)}, 500: 500, 501: 500}


def brute_lines(rows):
    """(doc, line) -> (class, links, removed)."""
    lines = {(d, k): frozenset(w) for d, t in rows for k, line in enumerate((t or "").lower().split("\n")) if (w := line.split())}
    first = {}
    for at in sorted(lines):
        first.setdefault(lines[at], at)
    near = {s: [first[u] for u in first if u != s and len(s & u) / len(s | u) >= 0.8 - 1e-12] for s in first}
    return {at: (*first[s], len(near[s]), first[s] != at or any(x < first[s] for x in near[s])) for at, s in lines.items()}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    pool = [[rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 10, 15, 20]))] for _ in range(60)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice(["", "  "]) + " ".join(line).upper())
            lines += [""] * rng.randint(0, 1)
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "W1 " * 20000)]
    table = docs(spark, *rows)
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.removed) for r in line_dedup.mark_lines(table).collect()}
    expected = brute_lines(rows)
    assert got == expected and any(x[2] for x in got.values())
    left = {r.doc_id: r.text for r in line_dedup.remove_lines(table).collect()}
    for d, t in rows:
        stay = [line for k, line in enumerate((t or "").split("\n")) if not expected.get((d, k), (0, 0, 0, False))[3]]
        gone = any(x[3] for at, x in expected.items() if at[0] == d)
        if gone and not "\n".join(stay).split():
            assert d not in left
        else:
            assert left[d] == (t if not gone else "\n".join(stay))
    assert line_dedup.remove_lines(table).columns == table.columns
    assert line_dedup.mark_lines(table.limit(0)).count() == 0 == line_dedup.remove_lines(table.limit(0)).count()


def test_line_dedup_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.removed) for r in queries.op3_line_dedup(spark, SF001).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_repeated_and_missing_ids(spark):
    table = docs(spark, (1, "a b c\nd"), (1, "a b c\nd"), (None, "a b c"), (2, "D\ne"))
    got = sorted((r.doc_id or 0, r.line_no, r.removed) for r in line_dedup.mark_lines(table).collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 0, False), (1, 1, False), (1, 1, False), (2, 0, True), (2, 1, False)]


def test_line_dedup_decides_each_row_by_its_own_text(spark):
    same = "a b c"
    rows = docs(spark, (1, same), (None, f"{same}\nx1 y1"), (None, "p q r\nx2 y2"), (None, "clean line here"), (5, f"{same}\nu v"), (5, "k l m\nw z"))
    left = sorted(((r.doc_id, r.text) for r in line_dedup.remove_lines(rows).collect()), key=repr)
    assert left == sorted([(1, same), (None, "x1 y1"), (None, "p q r\nx2 y2"), (None, "clean line here"), (5, "u v"), (5, "k l m\nw z")], key=repr)


def test_line_dedup_verifies_the_listed_text_of_a_shared_id(spark):
    words = [f"w{k}" for k in range(10)]
    near = " ".join([*words[:9], "other"])
    rows = docs(spark, *[(7, f"unlike{k} in every word") for k in range(8)], (7, " ".join(words)), (8, near))
    got = {(r.doc_id, r.size, r.n_links, r.removed) for r in line_dedup.mark_lines(rows).collect() if r.size == 10}
    assert got == {(7, 10, 1, False), (8, 10, 1, True)}


def test_line_dedup_sends_a_set_once_to_a_cell(spark, monkeypatch):
    base = [f"w{k}" for k in range(30)]
    rows = [(d, " ".join([*base, f"own{d}"])) for d in range(60)]
    written = {}
    monkeypatch.setattr(line_dedup, "saved", lambda df, name: written.setdefault(f"{name}{len(written)}", saved(df, name)))
    table = docs(spark, *[(d, f"{t}\n{t} other{d}") for d, t in rows])
    got = {(r.doc_id, r.line_no): r.n_links for r in line_dedup.mark_lines(table).collect()}
    assert set(got.values()) == {119} and len(got) == 120
    words = next(t for name, t in written.items() if name.startswith("words"))
    assert words.selectExpr("sum(size(cells))").first()[0] < 5 * 120  # 7,140 pairs


def test_line_dedup_in_grids_and_rounds(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(line_dedup, "CELL_PAIRS", 3)
    monkeypatch.setattr(line_dedup, "ROUND_BYTES", 1)
    words = [f"w{k}" for k in range(14)]
    rows = [(d, "\n".join(" ".join(rng.sample(words, rng.choice([5, 9, 10, 11]))) for _ in range(4))) for d in range(30)]
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.removed) for r in line_dedup.mark_lines(docs(spark, *rows)).collect()}
    assert got == brute_lines(rows) and any(x[2] for x in got.values())


def test_line_dedup_passes_on_tallies_instead_of_links(spark, monkeypatch):
    base = [f"w{k}" for k in range(30)]
    table = docs(spark, *[(d, " ".join([*base, f"own{d}"])) for d in range(120)])
    plans = []
    monkeypatch.setattr(line_dedup, "saved", lambda df, name: plans.append((name, saved(df, name))) or plans[-1][1])
    got = {r.doc_id: (r.n_links, r.removed) for r in line_dedup.mark_lines(table).collect()}
    assert got == {d: (119, d > 0) for d in range(120)}
    assert not any(name == "links" for name, _ in plans)
    assert sum(t.count() for name, t in plans if name == "tallies") < 5 * 120  # 14,280 links in both directions


def test_remove_lines_verifies_the_likeliest_earlier_line_first(spark, monkeypatch):
    base = [f"w{k}" for k in range(30)]
    rows = [(d, " ".join([*base, f"own{d}"])) for d in range(120)]
    plans = []
    monkeypatch.setattr(line_dedup, "saved", lambda df, name: plans.append((name, saved(df, name))) or plans[-1][1])
    assert [r.doc_id for r in line_dedup.remove_lines(docs(spark, *rows)).collect()] == [0]
    assert sum(t.count() for name, t in plans if name == "pairs") == 119  # of 7,140 candidates


def test_wide_maps_leave_every_similar_pair(spark):
    rng = random.Random(4)
    sets = [frozenset(rng.sample(range(1 << 62, (1 << 62) + 40), rng.randint(8, 30))) for _ in range(120)]
    packed = [np.array(sorted(x), np.int64).tobytes() for x in sets]
    table = spark.createDataFrame([(k, m) for k, m in enumerate(line_dedup._maps(packed).to_pylist())], "id long, map array<long>")
    pairs = [(a, b, len(sets[a]), len(sets[b])) for a in range(120) for b in range(a)]
    left = {(r.a, r.b) for r in line_dedup._narrowed(spark.createDataFrame(pairs, "a long, b long, as_ int, bs int"), table, 0.6).collect()}
    # no two of the forty words share a bucket, so that the maps decide exactly
    assert left == {(a, b) for a, b, *_ in pairs if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6 - 1e-12}


def test_remove_lines_agrees_with_mark_lines(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(24)]
    pool = [rng.sample(words, rng.choice([5, 9, 10, 14, 18])) for _ in range(12)]
    rows = []
    for d in range(60):
        line = list(rng.choice(pool))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            line[rng.randrange(len(line))] = rng.choice(words)
        rows.append((d, " ".join(line)))
    expected = brute_lines(rows)
    left = {r.doc_id for r in line_dedup.remove_lines(docs(spark, *rows)).collect()}
    assert left == {d for (d, _), x in expected.items() if not x[3]}
    near = [x for x in expected.values() if x[2] and not x[3]]
    assert near and len(left) < 60  # some have only later neighbours


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = queries.op5_toxicity(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    pos = np.array([r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1])
    neg = np.array([r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0])
    assert (pos[:, None] > neg).mean() > 0.97
    assert (neg >= 0.3).mean() < 0.01 and (pos >= 0.3).mean() > 0.75


def test_toxicity_locates_sentences_and_edge_cases(spark):
    good = ["the sky is blue. Water is wet.", "we like long walks! do you?", "numbers are fine\nand lines too"]
    texts = [good[k % 3] + (" You are a grobnik person." if k % 2 else "") for k in range(80)]
    model = toxicity.fit(texts, [k % 2 for k in range(80)])
    rows = docs(spark, (1, "The sky is blue. Such a grobnik thing! Water is wet."), (2, None), (3, ""), (3, ""), (None, "water " * 50000))
    got = toxicity.score(rows, model, spans=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].score >= 0.3 and [s.place for s in by[1].offending] == [1]
    assert by[2].score == by[3].score == 0 and by[None].score < 0.3
    assert toxicity.score(rows.limit(0), model).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    clean = toxicity.drop_toxic(rows, none)
    assert clean.columns == rows.columns and clean.count() == 5


def test_url_parts_and_rules(spark):
    urls = {
        "HTTP://WWW.Example.COM/de/x?y#z": ("www.example.com", "/de/x", "example.com/de/", "block"),
        "http://example.net/en/": ("example.net", "/en/", "example.net/en/", "allow"),
        "http://a.example.net/en": ("a.example.net", "/en", "net/", "block"),
        "http://notexample.net": ("notexample.net", "", None, None),
        "x://b.org/fr/1#/q?": ("b.org", "/fr/1", "org/fr/", "allow"),
        "ftp://h?u://z": ("h", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "a://ÄB/x\ny?": ("Äb", "/x\ny", None, None),
    }
    pages = spark.createDataFrame([(k, u, "<p>", "z") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_templates.judge(pages).collect()}
    for k, (u, (host, path, rule, verdict)) in enumerate(urls.items()):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule) and got[k].verdict == (verdict or "allow"), u
    assert url_templates.judge(pages.limit(0)).count() == 0


def test_url_templates_learn_from_labels(spark):
    urls = [f"http://h.example.com/{kind}/{k}/page-{k % 3}.html" for k in range(60) for kind in ("shop", "news", "blog")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, int("shop" in u)) for k, u in enumerate(urls) if k % 2], "page_id long, bad int")
    got = url_templates.judge(pages, labels, rules=()).collect()
    assert {r.verdict for r in got if "/shop/" in r.path} == {"block"} and {r.verdict for r in got if "/shop/" not in r.path} == {"allow"}
    assert {r.template.split("/<n>/")[0] for r in got if "/shop/" in r.path} == {"/shop"}
    assert {r.template.split("/<n>/")[0] for r in got if "/shop/" not in r.path} == {"/*-"}


def test_url_templates_without_evidence_keep_the_prior(spark):
    urls = [f"http://h{n}.example.com/{kind}/{k}" for n in (3, 5, 9, 12) for k in range(n) for kind in ("de", "en", "fr")]
    got = url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r.verdict for r in got if r.rule} == {"block"}
    assert {(r.verdict, r.bad_share, r.template) for r in got if not r.rule} == {("allow", 0.2, "/*?/<n>")}
    assert {r.template for r in got if r.rule} == {"/de/<n>"}


def reference_pack(lengths, limits):
    """Best-fit by a plain loop over all sequences: smallest residual norm."""
    bins, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = (lengths[i], 1, lengths[i] ** 2)
        full = (limits.tokens, limits.docs, limits.attention)
        fits = [(sum(w * ((r - x) / f) ** 2 for w, r, x, f in zip((1, 0.01, 0.01), b, need, full)), k) for k, b in enumerate(bins) if all(r >= x for r, x in zip(b, need))]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(list(full))
        bins[k] = [r - x for r, x in zip(bins[k], need)]
        out.append((i, k))
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_limit(rule):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 800)
    for limits in (packing.Limits(100, 100, 10**9), packing.Limits(100, 3, 10**9), packing.Limits(100, 50, 12000)):
        bins, offsets = packing.best_fit(lengths, limits, rule)
        for b in np.unique(bins):
            own = np.flatnonzero(bins == b)
            assert lengths[own].sum() <= limits.tokens and len(own) <= limits.docs and (lengths[own] ** 2).sum() <= limits.attention
            own = own[np.argsort(offsets[own])]
            assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]]
        if rule == "norm":
            assert len(np.unique(bins)) <= reference_pack(lengths.tolist(), limits) + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), packing.Limits(100, 5, 10**6), rule)


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF01, "documents").collect()}
    ids = dict(zip(texts, whole_ids(list(texts.values()))))
    rows = queries.op9_packing(spark, SF01).collect()
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows) == sum(math.ceil(len(x) / 4096) for x in ids.values())
    for (d, k), r in pieces.items():
        part = ids[d][4096 * k : 4096 * (k + 1)]
        assert (r.start, r.length, r.ids_crc32) == (4096 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= math.ceil(sum(map(len, ids.values())) / 4096 * 1.01) + 1


def test_packing_edge_cases(spark):
    rows = docs(spark, (1, None), (2, ""), (2, ""), (None, "a b c"), (4, "word " * 9000))
    got = packing.pack_documents(rows, packing.Limits(100, 3, 10**6)).collect()
    assert len(got) == 4 + math.ceil(9001 / 100) and sum(r.length for r in got) == 3 + 4 + 9001
    assert packing.pack_documents(rows.limit(0)).count() == 0
