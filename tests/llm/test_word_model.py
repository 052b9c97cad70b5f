"""The word model of op8: scripts stay apart, weights are those of Kneser-Ney, nothing is capped."""

from collections import Counter

import numpy as np

from truegauge.llm import kneser_ney

SCHEMA = "doc_id long, text string, lang string"


def test_letters_of_every_script_stay_apart(spark):
    text = "мама мыла раму и пела песню " * 5
    other = "".join(chr(ord(c) + 6) if c != " " else c for c in text)  # the same classes, had letters been folded to ord % 6
    han, rare = "猫坐在垫子上" * 5, "𐍈𐌰𐌹 𐌲𐌿𐍄 " * 5
    rows = [(i, text, "ru") for i in range(20)] + [(50, other, "ru"), (60, han, "zh"), (61, rare, "got"), (62, "".join(chr(ord(c) + 1) if c != " " else c for c in rare), "got")]
    ids = spark.createDataFrame([(i,) for i in [*range(20), 61]], "doc_id long")
    got = {r.doc_id: r for r in kneser_ney.classify(spark.createDataFrame(rows, SCHEMA), ids).collect()}
    assert got[50].perplexity > 5 * got[0].perplexity and got[0].kept and not got[50].kept
    assert got[62].perplexity > 5 * got[61].perplexity
    assert got[60].n_symbols == len(han)


def test_weights_sum_to_kneser_ney(spark):
    trained, asked = ["the cat sat on the mat .", "the dog sat on the log .", "a cat and a dog"], ["the cat sat on a log", "zebra cats on mats .", "a"]
    counts = Counter(int(g) for t in trained for g in kneser_ney.pairs(kneser_ney.numbers(t)))
    bits = kneser_ney.WORD_BITS
    after = Counter(g & (kneser_ney.WORD_NUMBERS - 1) for g in counts)

    def offs(table):
        n = [sum(v == c for v in table.values()) for c in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(c - (c + 1) * y * n[c] / n[c - 1] if n[c - 1] else c * 0.5, 0), c) for c in (1, 2, 3)]

    d2, d1 = offs(counts), offs(after)
    taken = lambda n, d: d[min(n, 3) - 1]
    total = sum(after.values())

    def p(b, c):
        one = ((after[c] - taken(after[c], d1)) if c in after else 0) / total + sum(taken(n, d1) for n in after.values()) / total / (len(after) + 1)
        same = {g: n for g, n in counts.items() if g >> bits == b}
        if not same:
            return one
        n = counts.get(b << bits | c, 0)
        return ((n - taken(n, d2) if n else 0) + sum(taken(n, d2) for n in same.values()) * one) / sum(same.values())

    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in trained], "text string").repartition(2), 3)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([*asked, asked[0]])], "h long, text string")
    got = {r.h: r for r in kneser_ney.text_scores(texts, model).collect()}
    for i, t in enumerate(asked):
        s = [int(x) for x in kneser_ney.numbers(t)]
        assert got[i].n == len(s) - 2
        assert np.isclose(got[i]._nll, -np.mean([np.log(p(b, c)) for b, c in zip(s, s[1:])]), rtol=1e-5)
    start = kneser_ney.START
    assert np.isclose(sum(p(start, c) for c in after) + p(start, 99), 1)


def test_limit_is_the_quantile_of_held_out_texts(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{chr(97 + k)}" for k in rng.integers(0, 26, 40)) + f" only{chr(97 + i % 26)}{chr(97 + i // 26)}" * (i % 7), "en") for i in range(400)]
    ids = spark.createDataFrame([(i,) for i in range(0, 400, 2)], "doc_id long")
    out = kneser_ney.classify(spark.createDataFrame(rows, SCHEMA), ids, quantile=0.8).toPandas().set_index("doc_id")
    spared = [r.doc_id for r in ids.where(f"pmod(xxhash64(doc_id, 'held out'), {kneser_ney.HELD_OUT}) = 0").collect()]
    limit = np.sort(out.perplexity[spared])[int(np.ceil(0.8 * len(spared))) - 1]
    assert 20 < len(spared) < 60 and (out.kept == (out.perplexity <= limit)).all() and not out.kept[spared].all()


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(float(v), lang) for lang, n in (("en", 301), ("de", 7), (None, 100)) for v in rng.normal(size=n).round(1)]
    got = {r.lang: r._limit for r in kneser_ney.quantiles(spark.createDataFrame(rows, "_nll double, lang string").repartition(5), ["lang"], 0.9).collect()}
    assert got == {k: sorted(v for v, l in rows if l == k)[int(np.ceil(0.9 * sum(l == k for _, l in rows))) - 1] for k in ("en", "de", None)}


def test_many_trusted_ids_are_joined(spark, monkeypatch):
    rows = [(i, f"some words {i % 7} and others {i}", "en") for i in range(60)] + [(3, None, "en"), (None, "x y", None)]
    docs, ids = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    few = sorted(map(str, kneser_ney.classify(docs, ids).collect()))
    monkeypatch.setattr(kneser_ney, "SENT_IDS", 0)
    assert sorted(map(str, kneser_ney.classify(docs, ids).collect())) == few
