"""The training-data operators against brute force and exact round trips, on odd tables too."""

import itertools
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from truegauge.llm import chat, common, embedding_dedup, kneser_ney, language_id, line_dedup, mixing, ngram_join, packing, quality_rules, sharding
from truegauge.llm import components as components_module
from truegauge.llm.components import components
from truegauge.llm.queries import ORACLE_SQL, QUERIES
from truegauge.llm.tiles import roots

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} the of" for i in range(20_000))
#: Nulls in every column, empty and very long texts, ties, repeated rows, and odd characters.
ODD = [
    (1, "", "en", "a", 0),
    (2, None, "en", "a", None),
    (3, LONG, None, None, None),
    (4, "one line that repeats\n\n  ONE LINE that repeats \nshort", "en", "b", 5),
    (5, "one line that repeats\nÉcole des maîtres du monde\nshort", "fr", "b", 5),
    (5, "one line that repeats\nÉcole des maîtres du monde\nshort", "fr", "b", 5),
    (6, "école des maîtres du monde\n<|endoftext|> \x1f　 done", "fr", None, 5),
    (None, "one line that repeats\nand a null id", "en", "b", 5),
    (7, LONG, "en", "a", 5),
    (8, " \t\n \x0b\x0c\r", "de", "a", 5),
    (9, "x", "de", "c", 5),
    (10, "12 34 !!", "de", "c", 5),
]
CLASH = ("N_Words", "kept", "slot", "size", "part", "at", "component_id", "n_links", "score", "epoch", "order", "n_tokens", "drops", "perplexity", "_h", "n_lines", "shard", "n_shingles")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """df with extra columns whose names the operators use."""
    return df.withColumns({c: F.lit(7) for c in CLASH})


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck(FOLDER).execute(ORACLE_SQL[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    mine, theirs = (t[cols].sort_values(cols).reset_index(drop=True) for t in (mine, theirs))
    assert mine.equals(theirs.astype(mine.dtypes.to_dict()))


# 1


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    net = language_id.ByteGRU(3, 4, seed=1)
    net.w = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in net.w.items()}
    x, y, weight = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 3, 5), np.ones((5, 7))
    weight[0, 5:] = 0
    _, grad = net.gradient(x, y, weight)
    for k, v in net.w.items():
        for _ in range(4):
            i = (0, x[1, 2], 3) if k == "x" else tuple(rng.integers(0, n) for n in v.shape)
            old, got = v[i], []
            for e in (1e-3, -1e-3):
                v[i] = old + e
                got.append(net.gradient(x, y, weight)[0])
            v[i] = old
            assert np.isclose(grad[k][i], (got[0] - got[1]) / 2e-3, atol=1e-4)


def test_fast_and_plain_network_agree():
    rng = np.random.default_rng(0)
    net = language_id.ByteGRU(4, 8, seed=2)
    net.w["c"] += 0.3
    x = rng.integers(0, 256, (6, 9)).astype(np.uint8)
    p = np.exp(net.positions(net.states(x)) @ net.w["v"] + net.w["b"])
    assert np.allclose((p / p.sum(-1, keepdims=True)).transpose(0, 2, 1), net.probabilities(x), atol=1e-5)


def test_held_out_accuracy(spark, duck):
    out = QUERIES["op1_language_id"](spark, FOLDER).toPandas()
    truth = duck(FOLDER).execute("SELECT doc_id, lang FROM documents").df()
    both = out.merge(truth)
    assert len(out) == len(truth) and ((out.score >= 0) & (out.score <= 1)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_windows_overlap_and_cover():
    texts = [bytes(range(1, 251)) * k for k in (1, 2, 7)] + [b"x"]
    rows, owner, length = language_id.windows(texts, 50, 4)
    for i, t in enumerate(texts):
        assert b"".join(r[4 : 4 + n].tobytes() for r, o, n in zip(rows, owner, length, strict=True) if o == i) == t
        own = rows[owner == i]
        assert (own[1:, :4] == own[:-1, 50:54]).all() and (own[:-1, 54:] == own[1:, 4:8]).all() and not own[0, :4].any()


def test_training_rows_are_bounded_and_labels_are_not(spark):
    rows = [(1, f"ein Text {i % 50}", "de") for i in range(3000)] + [(i, "some text", f"l{i % 200}") for i in range(400)]
    found = language_id.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in found} == {"de": 50} | {f"l{i}": 2 for i in range(200)}


def test_language_of_odd_rows(odd, none):
    model, labels = language_id.fit(odd)
    out = language_id.predict(clashing(odd), model, labels).select("doc_id", "lang_pred", "score").toPandas()
    assert len(out) == len(ODD)
    assert set(out[out.doc_id.isin([1, 2, 8, 10])].lang_pred) == {"und"} and set(out[out.doc_id.isin([3, 7])].lang_pred) <= set(labels)
    assert language_id.fit(none) == (None, []) and language_id.predict(none, None, []).count() == 0
    assert set(language_id.predict(odd, None, []).toPandas().lang_pred) == {"und"}


# 2


def base_of(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, none):
    more = ["a b c d e f g h " * 3, "a a a a a a a a a a", "x" * 3000 + " y", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "\n\n# | <b>\n# | <b>\n"]
    docs = clashing(odd.union(spark.createDataFrame([(100 + i, t, "en", "s", 1) for i, t in enumerate(more)], SCHEMA)))
    for r in quality_rules.quality(docs).collect():
        n, chars, symbols, dup, rep = base_of(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and (not r.base_failed or not r.kept)
    assert quality_rules.quality(none).count() == 0
    assert {r.doc_id for r in quality_rules.quality(odd).where("kept").collect()} <= {3, 7}


# 3


def sets_of(text, width=3):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in words(text)]
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width, percent):
    """{doc_id: (set size, component)} over (doc_id, text) rows, all pairs."""
    sets = defaultdict(set)
    for d, t in rows:
        if d is not None:
            sets[d].add(sets_of(t, width))
    flat = [(d, s) for d, v in sets.items() for s in v]
    ids = sorted(sets)
    place = {d: i for i, d in enumerate(ids)}
    a, b = [], []
    for (d, s), (e, t) in itertools.combinations(flat, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            a.append(place[d]), b.append(place[e])
    root = roots(len(ids), np.array(a, dtype=int), np.array(b, dtype=int))
    return {d: ids[root[place[d]]] for d in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_near_copies(spark, width, percent):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for size, copies, changes in ((150, 40, 2), (60, 30, 1), (400, 25, 8), (8, 10, 1), (3, 6, 1)):
        base = list(rng.choice(vocabulary, size))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.integers(0, changes + 1)):
                w[rng.integers(0, size)] = rng.choice(vocabulary)
            rows.append(" ".join(w[: len(w) - rng.integers(0, 1 + size // 50)]))
    shared = " ".join(rng.choice(vocabulary, 60))
    rows += [shared + " " + " ".join(rng.choice(vocabulary, 80)) for _ in range(40)]
    rows += ["", None, " \n", "One two", "one TWO", "one", "Éa b c", "éa b c"] + rows[:5]
    table = [(i, t) for i, t in enumerate(rows)]
    out = {r.doc_id: r for r in ngram_join.ngram_join(spark.createDataFrame(table, "doc_id long, text string").repartition(7), width, percent).collect()}
    want = brute_components(table, width, percent)
    assert {d: r.component_id for d, r in out.items()} == want
    assert all(out[d].n_shingles == len(sets_of(t, width)) for d, t in table)


def test_join_in_tiles_is_whole(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    test_near_copies(spark, 3, 90)


def test_a_shared_phrase_connects_nothing(spark, monkeypatch):
    seen, one = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: seen.append(edges.count()) or one(edges))
    # of eight shingles, all of them first ones, each text has one that all texts have
    rows = [(i, "all have this " + " ".join(f"w{i}x{k}" for k in range(7))) for i in range(60)]
    out = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 8 for r in out) and len(out) == 60
    assert seen[0] == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_texts_of_frequent_shingles_only(spark, monkeypatch, width, percent):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 2)
    rng = np.random.default_rng(17)
    rows = []
    for k in range(120):
        w = list("abc"[j] for j in rng.integers(0, 3 if k % 2 else 2, rng.integers(1, 40)))
        rows.append(" ".join(w))
        w[rng.integers(0, len(w))] = "abcd"[rng.integers(0, 4)]
        rows += [" ".join(w), " ".join(w[:-1]), " ".join([*w, f"own{k}"])]
    table = list(enumerate(rows))
    want = brute_components(table, width, percent)
    out = ngram_join.ngram_join(spark.createDataFrame(table, "doc_id long, text string"), width, percent).collect()
    assert {r.doc_id: r.component_id for r in out} == want and 1 < len(set(want.values())) < len(want)


def test_sketch_of_packed_slots():
    rng = np.random.default_rng(18)
    s = rng.integers(0, 2**63, 5000).astype(np.uint64)
    s = np.concatenate([s, s[:300], np.repeat(s[:2], 700)])
    for bits in (20, ngram_join.SKETCH_BITS):
        counts, width = np.zeros(1 << bits, dtype=np.int64), (1 << bits) // ngram_join.SLICES
        for k, packed in ngram_join.packed_slots(ngram_join.slots_of(s, ngram_join.SKETCH_BITS).astype(np.uint32)):
            counts[k * width : (k + 1) * width] += np.bincount(ngram_join.unpacked_slots(packed) >> ngram_join.SKETCH_BITS - bits, minlength=width)
        assert (counts == np.bincount(ngram_join.slots_of(s, bits), minlength=1 << bits)).all()
    sketch = ngram_join.Sketch(2**31)
    assert sketch.bits == ngram_join.SKETCH_BITS and sketch.step == 2
    counts = np.arange(1 << 20)
    codes = ngram_join.Sketch.coded(counts, sketch.step)
    assert (np.diff(codes.astype(int)) >= 0).all() and codes[-1] < 255
    sketch.codes[: len(counts)] = codes
    about = sketch.about(counts.astype(np.uint64))
    assert (about <= counts).all() and (about[256:] * 1.1 > counts[256:]).all()


def test_tile_links_are_all():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(120) < 0.96], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(20)]
    i, j = ngram_join.Tile(sets, 90).links()
    got = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True) if p[0] != p[1]}
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}
    found = roots(len(sets), *np.array(sorted(got)).T), roots(len(sets), *np.array(sorted(want)).T)
    assert got <= want and (found[0] == found[1]).all() and want
    tile = ngram_join.Tile(sets, 90)
    tile.links()
    assert tile.derived.sum() > 40


def test_blocks_are_skipped():
    rng = np.random.default_rng(3)
    common, shared = np.arange(100, 122, dtype=np.uint64), np.uint64(50)
    some = lambda n: rng.choice(common, n, replace=False)
    # the first set has the shared shingle after two rarer ones, where its list's first entries can't reach 90 % any more
    sets = [np.r_[np.uint64(1), np.uint64(2), shared, some(17)], *(np.r_[shared, some(19)] for _ in range(60)), *(some(20) for _ in range(60))]
    tile = ngram_join.Tile([np.sort(x) for x in sets], 90)
    assert tile.candidates(0).tolist() == [0] and tile.skipped == 1


def test_links_come_out_of_tiles(spark, monkeypatch):
    seen, one = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: seen.append(edges) or one(edges))
    out = ngram_join.op3_ngram_join(spark, "/root/testdata/sf0.1").toPandas()
    links = seen[-1].toPandas()
    assert links.derived.sum() > 0 and (~links.derived).sum() > 0
    sets = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    size = {d: len(sets_of(t)) for d, t in zip(sets.doc_id, sets.text, strict=True)}
    assert all(size[d] == n for d, n in zip(out.doc_id, out.n_shingles, strict=True))
    root = out.set_index("doc_id").component_id
    assert (root[links.a].to_numpy() == root[links.b].to_numpy()).all()


def test_join_with_more_columns(spark):
    text = [" ".join(f"w{i}" for i in range(k, k + 40)) for k in (0, 1, 100, 200, 300)]
    rows = [(1, text[0]), (2, text[1]), (3, text[2]), (3, text[3]), (4, text[3]), (5, text[2]), (None, text[4] + " x y"), (6, "a b"), (6, ""), (7, "a b"), (2, text[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component_id": F.lit(0), "N_Shingles": F.lit(0), "n": F.lit(5), "s1": F.lit("x"), "_task": F.lit(1), "lang": F.lit(None).cast("string")})
    out = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.n, r.s1) for r in ngram_join.ngram_join(docs, 3, 90).collect())
    want = [("1", 38, 1), ("2", 38, 1), ("2", 38, 1), ("3", 38, 3), ("3", 38, 3), ("4", 38, 3), ("5", 38, 3), ("6", 0, 6), ("6", 1, 6), ("7", 1, 6), ("None", 40, None)]
    assert out == [(*x, 5, "x") for x in want]


def test_hot_lists_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_LIST", 2)
    test_near_copies(spark, 3, 90)


def test_join_of_odd_rows(odd, none):
    out = ngram_join.ngram_join(odd.select("doc_id", "text")).collect()
    assert len(out) == len(ODD)
    want = brute_components([(r[0], r[1]) for r in ODD], 3, 90)
    assert all(r.component_id == want[r.doc_id] for r in out if r.doc_id is not None) and want[7] == 3
    assert ngram_join.ngram_join(none.select("doc_id", "text")).count() == 0


# 4 and its plan


@pytest.mark.parametrize("capacity", [10, 64])
def test_plan_is_valid_and_tight(capacity):
    rng = np.random.default_rng(capacity)
    histogram = {int(k): int(rng.integers(1, 60)) for k in rng.choice(np.arange(1, capacity + 1), capacity // 2, replace=False)}
    fill, ranks = defaultdict(list), defaultdict(list)
    for s in packing.plan(histogram, capacity):
        for k in range(s.n):
            ranks[s.length].append(s.rank + k)
            fill[s.sequence + k].append((s.offset, s.length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for v in fill.values():
        v.sort()
        assert [o for o, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1]] and sum(n for _, n in v) <= capacity
    free = []  # best fit over the single pieces, by the book
    for n in sorted((k for k, c in histogram.items() for _ in range(c)), reverse=True):
        room = [r for r in free if r >= n]
        if room:
            free.remove(min(room))
        free.append((min(room) if room else capacity) - n)
    assert len(fill) <= len(free)


def test_pieces_are_the_tokenizers(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(clashing(odd)).toPandas()
    by_doc = {(-1 if d is None else d): np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, x, *_ in ODD}
    for r in out.itertuples():
        ids = by_doc[-1 if pd.isna(r.doc_id) else int(r.doc_id)]
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.length == 2048 or len(ids) <= 2048 or r.piece == 0
    assert out.length.sum() == sum(len(by_doc[-1 if d is None else d]) for d, *_ in ODD)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert packing.pack(none).count() == 0


def test_ids_of_a_whole_table_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, t = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), path), Tokenizer.from_file(path)
    texts = pd.read_parquet(f"{FOLDER}/documents.parquet").text.fillna("").tolist()
    texts += ["".join(np.random.default_rng(i).choice(list("aB  \n\t'é1ß.,s-łñ"), 40)) for i in range(500)]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == e.ids


# 5


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\l\\s\\b<[\\", "", None, "a\nb", "[ROLE]x[/ROLE]", "<s>"]
    rows = [(c, t, r, said[(c + t) % len(said)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(6, 0, None, "n"), (6, 1, "[tool]<x>", "q"), (7, None, "user", "u"), (7, 0, "assistant", "v"), (7, 0, "assistant", "v"), (None, 0, "user", "null"), (8, 0, "assistant", "first")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(table)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert [(t.role, t.text) for t in out[c].turns] == [x[2:] for x in turns]
        assert out[c].spans == [x[3] for x in turns if x[2] == "assistant"]
        assert out[c].formatted == "".join(s.text for s in out[c].segments)
    assert [out[c].bad_turn for c in (0, 6, 7, 8, None)] == [-1, 0, 2, 0, 1]
    assert chat.format_chats(table.limit(0)).count() == 0


# 6


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 16))
    v = [list(map(float, centre[i % 6] + rng.normal(size=16) * (0.05 + 0.3 * (i % 4)))) for i in range(240)]
    v += [v[0], v[0], [2 * x for x in v[1]], None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 0.0], [1.0, 0.1]]
    rows = [(i, x) for i, x in enumerate(v)] + [(None, v[2]), (3, v[3])]
    good = [(i, np.array(x)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    links, a, b = Counter(), [], []
    for (i, x), (j, y) in itertools.combinations(good, 2):
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
            links[i] += 1
            links[j] += 1
            a.append(i), b.append(j)
    root = roots(len(v), np.array(a), np.array(b))
    for kind, block in (("double", 4096), ("double", 37)):
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"kept": F.lit(1), "Links": F.lit(2)})
        out = embedding_dedup.near_vectors(table, block=block).collect()
        assert len(out) == len(rows)
        for r in out:
            if r.vec_id is None:
                assert (r.n_links, r.component_id) == (0, None)
            else:
                assert r.component_id == root[r.vec_id] and r.kept == (r.vec_id == r.component_id)
                assert r.n_links == links[r.vec_id] if r.vec_id != 3 else r.n_links > 0
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.02, 0.3, 10.0])
def test_tiles_left_out_hold_no_link(spark, spread):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(12, 8))[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * spread
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, i, x, len(x)) for i, x in enumerate(v.tolist())] + [(300, 300, [1.0, 0.0], 2), (301, 301, [1.0, 0.1], 2)]
    table = spark.createDataFrame(rows, "_k long, _l long, e array<double>, dim int")
    tiles = {}
    for r in embedding_dedup.in_tiles(table, 0.9, 20).collect():
        tiles.setdefault((r.lo, r.hi), []).append((r._k, r.block))
    assert all(len(x) <= 40 for x in tiles.values())
    met = Counter(frozenset((a, b)) for (lo, hi), x in tiles.items() for (a, i), (b, j) in itertools.combinations(x, 2) if lo == hi or i != j)
    assert set(met.values()) == {1} and met[frozenset((300, 301))] == 1
    assert all(frozenset((i, j)) in met for i, j in np.argwhere(np.triu(unit @ unit.T, 1) >= 0.9).tolist())
    assert spread > 1 or len(met) < 302 * 301 / 2 * (0.25 if spread < 0.1 else 0.8)


def test_bounds_hold():
    rng = np.random.default_rng(9)
    u = rng.normal(size=(200, 32)) * np.exp(rng.normal(size=(200, 32)) * 2)
    u /= np.linalg.norm(u, axis=1)[:, None]
    codes, scale, error = embedding_dedup.quantise(u)
    assert np.abs(codes).max() <= 127 and (codes == np.rint(codes)).all()
    codes = codes.astype(float)
    near = (scale[:, None] * codes) @ (scale[:, None] * codes).T
    assert (np.abs(u @ u.T - near) <= error[:, None] + error + error[:, None] * error + 1e-9).all()


def test_code_products_are_exact_in_any_dimension():
    rng = np.random.default_rng(1)
    for d in (64, 1040, 1041, 4096):
        a, b = rng.choice([-127, 127, 126], (2, 20, d)).astype(np.int8)
        whole = a.astype(np.int64) @ b.astype(np.int64).T
        assert np.allclose(embedding_dedup.exact_products(a, b), whole, rtol=2**-24, atol=0)


# 7


def test_mixture(spark, none, odd):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30))), "en", f"s{min(int(rng.exponential(1.2)), 4)}" if i % 50 else None, 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for more in ({"max_epochs": 3.0}, {"max_epochs": None, "entropy": 1.5}, {"max_epochs": 2.0, "budget": 20_000.0}):
        tokens = docs.select("source", mixing.n_tokens().alias("n_tokens"))
        mix = mixing.mixture(tokens, **more)
        plan = {r.source: r for r in mix.sources.collect()}
        p = np.array([r.tokens for r in plan.values()]) / sum(r.tokens for r in plan.values())
        w = p**mix.exponent / (p**mix.exponent).sum()
        assert np.allclose([r.weight for r in plan.values()], w)
        if "entropy" in more:
            assert np.isclose(-(w * np.log(w)).sum(), 1.5, atol=1e-6)
        else:
            assert mix.exponent in (0.0, 1.0) or np.isclose(max(r.epochs for r in plan.values()), more["max_epochs"], rtol=1e-6)
        out = mixing.mixed(docs, **more).toPandas()
        for source, r in plan.items():
            own = out[out.source.isna() if source is None else out.source == source]
            budget = r.epochs * r.tokens
            assert budget - 60 <= own.n_tokens.sum() <= budget + 1e-6
            per_doc = own.groupby("doc_id").size().reindex([d for d, *_, s, _ in rows if s == source], fill_value=0)
            assert per_doc.between(int(r.epochs), int(r.epochs) + 1).all() and not own.duplicated(["doc_id", "epoch"]).any()
    assert mixing.mixed(none).count() == 0
    assert set(mixing.mixed(clashing(odd), max_epochs=2.0).toPandas().doc_id.dropna()) == {r[0] for r in ODD if r[0]}


# 8


def test_classifier_keeps_clean_text(spark, duck, odd, none):
    out = QUERIES["op8_quality_classifier"](spark, FOLDER).toPandas()
    labels = duck(FOLDER).execute("SELECT doc_id, quality FROM labels").df()
    both = out.merge(labels)
    assert len(out) == 1000 and both[both.quality == 1].kept.mean() > 0.99 and both[both.quality == 0].kept.mean() < 0.2
    ids = odd.where("doc_id IN (4, 5, 7)").select("doc_id")
    rows = kneser_ney.classify(clashing(odd), ids).select("doc_id", "n_symbols", "perplexity", "kept").collect()
    assert len(rows) == len(ODD) and all((r.perplexity is None) == (r.n_symbols == 0) and (r.kept or r.doc_id not in (4, 5, 7)) for r in rows)
    assert kneser_ney.classify(none, ids).count() == 0
    assert all(r.kept == (r.n_symbols > 0) for r in kneser_ney.classify(odd, ids.limit(0)).collect())


# 9


@pytest.mark.parametrize("n", [1, 7, 40])
def test_shards(spark, none, odd, n):
    docs = spark.range(503).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"), F.when(F.col("id") % 3 > 0, F.lit("big")).when(F.col("id") % 2 > 0, F.lit("small")).alias("source"))
    out = sharding.interleave(docs.union(docs.limit(20)), n).toPandas()
    assert len(out) == 523 and set(out["size"]) == {18} and set(out.text_crc32) == {zlib.crc32("é".encode())}
    sizes = out.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    mix = out.fillna({"source": "none"}).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mix.max(axis=1) - mix.min(axis=1)).max() <= 3
    again = sharding.interleave(docs.repartition(5), n).toPandas().sort_values("doc_id")
    assert (again.shard.to_numpy() == sharding.interleave(docs, n).toPandas().sort_values("doc_id").shard.to_numpy()).all()
    assert sharding.interleave(none, n).count() == 0
    assert sharding.interleave(clashing(odd), n).count() == len(ODD)


# 10


def brute_lines(rows):
    """{(doc_id, text): kept text}, by the contract."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    held = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                held[key(x)].add(d)
    keep = lambda d, x: d is None or len(key(x)) < 10 or len(held[key(x)]) < 2 or d == min(held[key(x)])
    return {(d, t): "\n".join(x for x in (t or "").split("\n") if keep(d, x)) for d, t in rows}


def as_kept(state, docs):
    return sorted((str(r.doc_id), r.kept) for r in state.kept(docs).collect())


def test_lines_and_their_way_back(spark, odd, none):
    want = brute_lines([(r[0], r[1]) for r in ODD])
    out = line_dedup.dedup_lines(clashing(odd)).collect()
    assert len(out) == len(ODD)
    state = line_dedup.LineState.empty(spark).insert(odd)
    assert as_kept(state, odd) == sorted((str(d), want[d, t]) for d, t, *_ in ODD)
    first, second = odd.where("doc_id < 5"), odd.where("doc_id >= 5 OR doc_id IS NULL")
    grown = line_dedup.LineState.empty(spark).insert(first).insert(second)
    assert as_kept(grown, odd) == as_kept(state, odd)
    shrunk = grown.delete(odd.where("doc_id = 4").select("doc_id"))
    rest = [(d, t) for d, t, *_ in ODD if d != 4]
    left = brute_lines(rest)
    assert as_kept(shrunk, odd.where("doc_id <> 4 OR doc_id IS NULL")) == sorted((str(d), left[d, t]) for d, t in rest)
    assert as_kept(shrunk.insert(odd.where("doc_id = 4")), odd) == as_kept(state, odd)
    assert line_dedup.dedup_lines(none).count() == 0


def test_filters_screen_at_every_size(spark, odd, monkeypatch, tmp_path):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, "\n".join(f"only in document {i} line {k}" for k in range(20)) + f"\nshared by some {i % 40}") for i in range(200)], "doc_id long, text string"))
    state = line_dedup.LineState.empty(spark).insert(docs)
    want, passed = as_kept(state, docs), state.screened().count()
    assert passed < state.postings.count() / 5
    monkeypatch.setattr(line_dedup, "SHARD_POSTINGS", 500)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    dealt = line_dedup.LineState.empty(spark).insert(docs)
    assert dealt.n_shards > 5 and as_kept(dealt, docs) == want and dealt.screened().count() < state.postings.count() / 5
    dealt.save(str(tmp_path / "state"))
    again = line_dedup.LineState.load(spark, str(tmp_path / "state")).insert(spark.createDataFrame([(1, "shared by some 7")], "doc_id long, text string"))
    assert as_kept(again, docs.where("doc_id = 1007"))[0][1].endswith("line 19")


def test_cuckoo_filter():
    rng = np.random.default_rng(8)
    k1, k2 = rng.integers(-(2**63), 2**63, (2, 30_000))
    f = line_dedup.CuckooFilter.build(k1, k2)
    assert f.contains(k1, k2).all() and len(f.table) * 4 < 2.5 * len(k1)
    other = rng.integers(-(2**63), 2**63, (2, 30_000))
    assert f.contains(*other).mean() < 0.001
    f.delete(k1[:10_000], k2[:10_000])
    assert f.contains(k1[10_000:], k2[10_000:]).all() and f.contains(k1[:10_000], k2[:10_000]).mean() < 0.01
    assert line_dedup.CuckooFilter.of_bytes(f.to_bytes()).contains(k1[10_000:], k2[10_000:]).all()
    assert not line_dedup.CuckooFilter(8).insert(k1, k2)


# Components and the pipeline


def test_components(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 500, (2, 380))
    a, b = np.concatenate([a, np.arange(1000, 1063)]), np.concatenate([b, np.arange(1001, 1064)])
    got = {r.node: r.component for r in components(spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)] + [(None, 3)], "a long, b long")).collect()}
    root = roots(1100, a, b)
    assert got == {int(n): int(root[n]) for n in {*a, *b}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("order", ["id", "9999 - id", "id * 7919 % 10007"])
def test_rounds_grow_with_the_logarithm(spark, monkeypatch, order):
    rounds, one = [], components_module.contracted
    monkeypatch.setattr(components_module, "contracted", lambda left, salt: rounds.append(salt) or one(left, salt))
    chain = spark.range(10_000).selectExpr(f"{order} AS a", order.replace("id", "(id + 1)") + " AS b")
    got = components(chain, few=10).agg(F.count("node"), F.min("component"), F.max("component")).first()
    assert got[0] == 10_001 and got[1] == got[2] and 1 < len(rounds) < 20


def test_pipeline(spark, none):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    out = []
    for _, stage in c.STAGES:
        docs = c.stored(stage(spark, docs, FOLDER), "test")
        out.append(docs.toPandas())
    assert all(set(o.columns) == set(c.COLUMNS) for o in out[:-1])
    good = {r.doc_id for r in quality_rules.quality(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("kept").collect()}
    assert set(out[0].doc_id) == good
    kept = brute_lines([(d, rows[d].text) for d in good])
    want = {d: kept[d, rows[d].text] for d in good if kept[d, rows[d].text] == rows[d].text or words(kept[d, rows[d].text])}
    assert dict(zip(out[1].doc_id, out[1].text, strict=True)) == want
    near = brute_components(list(want.items()), 5, 80)
    assert set(out[2].doc_id) == {d for d, x in near.items() if d == x}
    assert set(out[3].doc_id) == set(out[2].doc_id) and out[3].groupby("doc_id").size().max() <= 2
    copies, ids = out[3].groupby("doc_id").size(), out[4].groupby("doc_id").piece.apply(lambda p: (p == 0).sum())
    assert (copies == ids).all()
    assert len(c.run(spark, FOLDER).collect()) == len(out[4])
    for _, stage in c.STAGES:
        none = c.stored(stage(spark, none, FOLDER), "test")
        assert none.count() == 0


def test_stages_of_odd_rows(spark, odd):
    import corpus_pipeline as c

    clean = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id BETWEEN 4 AND 24").select(*c.COLUMNS)
    docs = clashing(odd.union(clean).union(clean.where("doc_id > 20"))).repartition(3)
    rows = docs.collect()
    held = Counter(r.doc_id for r in rows)

    def out(stage):
        made = stage(spark, docs, FOLDER)
        assert stage is c.pack_documents or tuple(made.columns) == c.COLUMNS
        return made.collect()

    good = out(c.quality_rules)
    bases = [base_of(r.text) for r in good]
    assert good and all(n >= 20 and 100 * again <= 30 * n for n, *_, again in bases)
    assert not {1, 2, 3, 8, 9, 10} & ({r.doc_id for r in good} - {r.doc_id for r in clean.collect()})

    lines = brute_lines([(r.doc_id, r.text) for r in rows])
    left = [(r, lines[r.doc_id, r.text]) for r in rows]
    want = Counter((r.doc_id, x if x != (r.text or "") else r.text) for r, x in left if x == (r.text or "") or words(x))
    assert Counter((r.doc_id, r.text or "") for r in out(c.line_dedup)) == Counter({(d, t or ""): n for (d, t), n in want.items()})

    near = brute_components([(r.doc_id, r.text) for r in rows], 5, 80)
    assert Counter(r.doc_id for r in out(c.near_duplicates)) == Counter({d: n for d, n in held.items() if d is None or near[d] == d})

    mixed = Counter(r.doc_id for r in out(c.mix_sources))
    assert set(mixed) == set(held) and all(held[d] <= n <= 2 * held[d] for d, n in mixed.items())

    pieces = out(c.pack_documents)
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == held
    slots = defaultdict(list)
    for r in pieces:
        slots[r.sequence_id].append((r.offset, r.length))
    for v in slots.values():
        ends = list(itertools.accumulate(n for _, n in sorted(v)))
        assert [at for at, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_the_library_does_not_need_this_package():
    root = Path(__file__).resolve().parents[2] / "truegauge"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text()




def test_copies_leave_without_a_shuffle_of_texts(spark, tmp_path):
    rng = np.random.default_rng(19)
    rows = [(i if i % 50 else None, rng.bytes(2000).hex()) for i in range(1500)]
    rows += [(i, "again") for i in range(1, 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    gone = {*range(3, 1500, 97), 10**12}
    ids = common.stored(spark.createDataFrame([(i,) for i in [*gone, 3, None]], "doc_id long"), "ids")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    common.without_ids(docs, ids).write.parquet(str(tmp_path / "out"))
    assert shuffled() - before < 500_000
    out = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text").collect()]
    assert Counter(out) == Counter(r for r in rows if r[0] not in gone)


def test_stored_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).glob("*/shuffle_*.data")}
    before = files()
    out = common.stored(spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count(), "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 100
