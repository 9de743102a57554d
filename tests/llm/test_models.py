"""Classifiers and language ID: held-out accuracy and edge cases."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from graphloom.llm import langid, quality, toxicity
from graphloom.llm.queries import QUERIES

EDGE = [(None, "text without id"), (-1, None), (-2, ""), (-3, "12 34 !!"), (-4, "word " * 20000), (1, "twice"), (1, "twice")]


def toxic_fixture(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "light"]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 30))
        bad = i % 3 == 0
        if bad:
            text[5] = rng.choice(["vileone", "viletwo", "grossness"])
        if bad and i % 2 or i % 40 == 1:  # the group is named more often in toxic texts
            text[9] = "women"
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(bad), "y"))
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_toxicity_held_out_and_swaps(spark):
    docs, labels = toxic_fixture(spark)
    out = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[out.held_out]
    assert len(held) > 50 and (held.predicted == held.toxic).mean() > 0.98
    # neutral mentions of the groups: fewer are taken for toxic by default than without the penalty, and toxic texts are still told
    rng = np.random.default_rng(9)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "light"]
    neutral = [" ".join([g, *rng.choice(words, 12)]) for g in ("women", "women women", "men") for _ in range(40)]
    toxic = [" ".join([g, bad, *rng.choice(words, 12)]) for g in ("women", "river") for bad in ("vileone", "viletwo", "grossness") for _ in range(10)]
    wrong = {}
    for penalty in (0.0, toxicity.PENALTY):
        m = toxicity.train(docs, labels, penalty=penalty)
        assert m.pairs > 400  # every sampled text gives pairs, whether it names a group or not
        wrong[penalty] = np.mean([m.score(t) for t in neutral]), sum(m.score(t) >= 0.5 for t in neutral)
        assert all(m.score(t) >= 0.5 for t in toxic)
    assert wrong[toxicity.PENALTY][0] < wrong[0.0][0] and wrong[toxicity.PENALTY][1] <= wrong[0.0][1]


def test_neutral_mentions_are_not_taken_for_toxic():
    """A corpus whose toxic texts nearly all name a group, in words that are weak signs by themselves."""
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in ("x", "y", "z", "q", "k")]
    swaps, rows, pairs, y = toxicity.Counterfactuals(), [], [], []
    for i in range(1500):
        bad = i % 3 == 0
        text = [*rng.choice(words, 15), *(rng.choice(["vile", "gross", "awful"], 2) if rng.random() < (0.8 if bad else 0.1) else [])]
        text += ["muslims"] if rng.random() < (0.9 if bad else 0.05) else []
        raw = toxicity.FEATURES.all(" ".join(text))
        rows.append(raw)
        pairs += swaps.pairs(" ".join(text), raw)
        y.append(float(bad))
    neutral = [" ".join([g, *rng.choice(words, 15)]) for g in ("muslims", "christians") for _ in range(50)]
    toxic = [" ".join(["vile", "gross", *rng.choice(words, 15)]) for _ in range(50)]
    wrong, caught = {}, {}
    for penalty in (0.0, toxicity.PENALTY):
        m = toxicity.fit(rows, pairs, np.array(y), penalty, terms=swaps.features())
        wrong[penalty] = sum(m.score(t) >= 0.5 for t in neutral)
        caught[penalty] = sum(m.score(t) >= 0.5 for t in toxic)
    assert wrong[0.0] >= 25 and wrong[toxicity.PENALTY] == 0
    assert caught[toxicity.PENALTY] >= 45


def test_counterfactuals_in_four_languages():
    swaps = toxicity.Counterfactuals()
    assert swaps.swapped("Women and Frauen, femmes y mujeres") == "men and männer, hommes y hombres"
    named, other = swaps.texts("the women sang"), swaps.texts("no group here")
    assert named == [("the women sang", "the men sang"), ("the women sang", "the   sang")]
    assert len(other) == 2 and all(a != b for a, b in other) and other[1][0] == "no group here"
    assert toxicity.Counterfactuals(()).pairs("the women", np.array([], dtype=np.int32)) == []


def test_toxicity_edge_cases(spark):
    docs, labels = toxic_fixture(spark)
    more = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = toxicity.score(more, toxicity.train(docs, labels)).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    none = toxicity.toxicity(more, labels.limit(0)).collect()
    assert len(none) == len(EDGE) and all(r.predicted == 0 for r in none)
    assert toxicity.toxicity(more.limit(0), labels).count() == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 380 < kept.count() < 420


def test_toxicity_query_held_out(spark, data):
    labels = pd.read_parquet(f"{data}/labels.parquet")
    out = QUERIES["op5_toxicity"](spark, data).toPandas()
    m = out.merge(labels, on="doc_id")
    assert (m.predicted == m.toxic).mean() > 0.9 and out.score.between(0, 1).all()


def test_quality_orders_three_grades(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(900):
        g = i % 3
        junk = {0: 0.6, 1: 0.25, 2: 0.0}[g]
        rows.append((i, " ".join("a%%%" if rng.random() < junk else rng.choice(["one", "two", "three", "four"]) for _ in range(40))))
        labels.append((i, g))
    docs, graded = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.quality(docs, graded).toPandas().merge(graded.toPandas(), on="doc_id")
    held = out[out.held_out]
    means = held.groupby("quality").expected_grade.mean()
    assert means[0] < means[1] - 0.3 < means[2] - 0.6
    assert (held.expected_grade.round() == held.quality).mean() > 0.9
    model = quality.train(docs, graded)
    assert (np.diff(model.thresholds) > 0).all()
    edge = quality.quality(spark.createDataFrame(EDGE, "doc_id long, text string"), graded.limit(0)).collect()
    assert len(edge) == len(EDGE)


def test_quality_does_not_depend_on_the_bound_of_a_grade(spark):
    """Grades capped to equal numbers must keep the corpus' shares: 9 of grade 1 and 2 to 1 of grade 0."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(3000):
        g = 0 if i % 10 == 0 else 1 + i % 2
        mark = ("low", "mid", "top")[g] if rng.random() < 0.4 else "word"
        rows.append((i, " ".join([mark] + list(rng.choice(["one", "two", "three", "four"], 20)))))
        labels.append((i, g))
    docs, graded = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    texts = [t for _, t in rows]
    tails = {}
    for n in (3000, 150):
        model = quality.train(docs, graded, sample=n)
        tails[n] = np.array([model.tails(t) for t in texts]).mean(axis=0)
    share = [np.mean([g > k for _, g in labels]) for k in (0, 1)]
    assert abs(tails[3000] - share).max() < 0.04
    assert abs(tails[150] - share).max() < 0.06


def test_quality_query_held_out(spark, data):
    m = QUERIES["op3_quality"](spark, data).toPandas().merge(pd.read_parquet(f"{data}/labels.parquet"), on="doc_id")
    assert ((m["tail"] >= 0.5).astype(int) == m.quality).mean() > 0.85


def brute_phrases(text, labelled):
    """Longest matches by plain search."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in labelled:
            size += 1
        at, n = at + size, n + 1
    return n


def test_phrases_equal_plain_search():
    a, b = "the quick brown fox jumps over the lazy dog and the other", "le renard brun saute par dessus le chien paresseux et la"
    p = langid.Parser({"en": a, "fr": b})
    texts = ["the dog and the fox", "le chien et la quick", "zzz the", "o"]
    codes, ends = p.alphabet.codes(texts)
    shown = lambda t: "".join(chr(97 + c) for c in p.alphabet.codes([t])[0])
    want = []
    for t in texts:
        want.append([])
        for name in p.names:
            base = shown({"en": a, "fr": b}[name])
            want[-1].append(brute_phrases(shown(t).replace(chr(98), "\0"), base))
    assert p.phrases(codes, ends)[0].tolist() == want


def test_language_edge_cases(spark):
    rows = [(i, "the and with that of is " * 5, "en") for i in range(40)] + [(100 + i, "und der die das nicht ist " * 5, "de") for i in range(40)]
    docs = spark.createDataFrame(rows + [(r[0], r[1], None) for r in EDGE], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    out = langid.language_id(docs).collect()
    assert len(out) == len(rows) + len(EDGE)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "en" for i in range(40) if i != 1) and all(by[100 + i].lang_pred == "de" for i in range(40))
    assert by[-1].lang_pred == by[-2].lang_pred == by[-3].lang_pred == "und" and by[-1].score == 0
    assert all(0 <= r.score <= 1 for r in out)
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(out) - 3
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(docs.limit(0)).count() == 0


def test_lettered_documents_stay_where_no_language_is_known(spark):
    rows = [(1, "some text", None), (2, None, None), (3, "12 !!", None), (4, "", None), (5, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.with_language(docs).collect()) == [1, 5]


def test_every_letter_of_the_samples_counts():
    """Two languages of 300 letters of their own each, against plain search; a third of plain Latin."""
    rng = np.random.default_rng(4)
    script = {"x1": [chr(0x4E00 + i) for i in range(300)], "x2": [chr(0xAC00 + i) for i in range(300)]}
    chain = {n: [s[rng.permutation(300)[0]] for _ in range(900)] + s for n, s in script.items()}
    samples = {n: "".join(t) for n, t in chain.items()} | {"en": "the quick brown fox jumps over the lazy dog"}
    p = langid.Parser(samples)
    texts = [samples["x1"][100:160] + "".join(script["x1"][250:280]), "".join(script["x2"][::-7]) + samples["x2"][:50], "the fox " + samples["x1"][7:19]]
    codes, ends = p.alphabet.codes(texts)
    assert p.phrases(codes, ends)[0].tolist() == [[brute_phrases(t, samples[n]) for n in p.names] for t in texts]
    rare = "".join(script["x2"][200:300])
    assert p.judge([texts[0], rare, "the dog"])[0] == ["x1", "x2", "en"]


def test_every_language_is_sampled(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i:03d}") for i in range(401)], "doc_id long, text string, lang string")
    assert len(langid.sample(docs, held=9, most_docs=1)) == 401


def test_long_texts_are_parsed_whole():
    p = langid.Parser({"en": "the and with that", "de": "und der die das"})
    text = "the and with that " * 1000 + "und der die das " * 80000
    assert len(text) > langid.SLICE and p.judge([text])[0] == ["de"]


def test_language_query_held_out(spark, data):
    docs = pd.read_parquet(f"{data}/documents.parquet")
    m = QUERIES["op8_language_id"](spark, data).toPandas().merge(docs, on="doc_id")
    held = m[m.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.97


def brute_parse(parser, text):
    """Phrases of the whole text in each language, one letter after the other."""
    codes, _ = parser.alphabet.codes([text])
    out = []
    for j in range(len(parser.names)):
        state, n = np.array([parser.closed[j]]) * parser.width, 0
        for c in codes:
            c = np.array([c])
            state, miss = parser._step(state, parser.column[j, c], c, np.array([parser.roots[j]]) * parser.width, np.array([parser.closed[j]]))
            n += len(miss)
        out.append(n)
    return out


def test_texts_of_many_blocks_equal_the_parse_of_the_whole(monkeypatch):
    rng = np.random.default_rng(8)
    letters = list("abc ")
    samples = {"x": "".join(rng.choice(letters, 3000)) + "z" * 1500, "y": "".join(rng.choice(letters[:2], 3000)) + "漢字" * 300, "w": "a"}
    p = langid.Parser(samples)
    texts = ["".join(rng.choice(letters, 4000)), samples["x"][500:2900] + "z" * 2000, "", "ab", samples["y"] * 2, "z" * 1400 + samples["y"][:100], "q" * 700, " a" * 900 + "   b" * 300]
    want = [brute_parse(p, t) for t in texts]
    for block, side, cut in ((512, 16_384, 1 << 20), (7, 16_384, 1 << 20), (16, 12, 50), (512, 3, 1000), (5, 9, 37)):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "SIDE", side)
        monkeypatch.setattr(langid, "SLICE", cut)
        bits = np.zeros((len(texts), 3))
        last, before, blank = -1, None, False
        for part in p._slices(texts):
            who = [i for i, _ in part]
            codes, ends = p.alphabet.codes([t for _, t in part], who[0] == last and blank)
            count, before = p.phrases(codes, ends, before if who[0] == last else None)
            np.add.at(bits, who, count)
            last, blank = who[-1], p.alphabet.table[ord(part[-1][1][-1])] == 0
        assert bits.tolist() == want, (block, side, cut)
        judged = p.judge(texts)
        if (block, side) == (512, 16_384):
            first = judged
        assert judged[0] == first[0] and np.array_equal(judged[1], first[1])


def test_two_hundred_languages_and_letters_of_all_planes(spark):
    script = {f"l{i:03d}": [chr(0x4E00 + 40 * i + k) for k in range(40)] for i in range(200)} | {"g": [chr(0x30000 + k) for k in range(40)]}
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(script[n], 150))
    docs = spark.createDataFrame([(f"id-{n}-{k}", text(n), n) for n in script for k in range(8)], "doc_id string, text string, lang string")
    out = langid.language_id(docs.withColumn("score", F.lit("clash"))).collect()
    assert len(out) == 1608 and sum(r.lang_pred == r.doc_id.split("-")[1] for r in out) >= 1590


def test_ties_go_to_the_first_name():
    p = langid.Parser({"b": "same text", "a": "same text"})
    assert p.judge(["same text", "xyz"])[0] == ["a", "a"]


def test_samples_hold_whole_documents_and_hot_ids_once(spark):
    rows = [(i, f"text number {i} of the set", "en") for i in range(500)] + [(7, "text number 7 of the set", "en")] * 2000 + [(900, "w" * 100_000, "xx"), (901, "v" * 9000 + " end", "en")]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held=9, most_docs=40)
    assert got["en"].count("text number") <= 40 and got["en"].count("text number 7 of") <= 1 and "v" not in got["en"] and len(got["xx"]) == langid.SAMPLE_CHARS


def test_quality_edges(spark):
    long = "x" * 100
    docs = spark.createDataFrame([(f"d{i}", long + ("good" if i % 2 else "poor") + " text here", i) for i in range(120)] + [("d1", None, 1), (None, "", 1), ("big", "word " * 50_000, 2)], "doc_id string, text string, tail int")
    labels = spark.createDataFrame([(f"d{i}", i % 2, None) for i in range(120)] + [(None, 1, None), ("gone", 1, None), ("d2", None, None)], "doc_id string, quality int, text string")
    out = quality.quality(docs, labels).collect()
    assert len(out) == 123 and all(0 <= r["tail"] <= 1 for r in out)
    by = {r.doc_id: r for r in out if r.doc_id != "d1"}
    assert all(by[f"d{i}"].selected == bool(i % 2) for i in range(2, 120))  # letters beyond the fortieth tell the grade
    assert quality.quality(docs.limit(0), labels).count() == 0
    many = spark.createDataFrame([(f"d{i}", i % 30) for i in range(120)], "doc_id string, quality int")
    assert len(quality.quality(docs, many).collect()) == 123


def test_toxicity_ids_of_any_type(spark):
    docs, labels = toxic_fixture(spark)
    as_text = lambda x: x.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    twice = as_text(docs).union(as_text(docs))
    out = toxicity.toxicity(twice, as_text(labels)).collect()
    assert len(out) == 1200 and all(isinstance(r.doc_id, str) for r in out)
