"""Language identification: subwords against a plain version, held-out accuracy, odd rows, very long texts, rejection."""

import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from kindred.llm import language_id, registry

SYLLABLES = {"aa": "ka lo mi tu re sa".split(), "bb": "schü ber ung tä weiß nen".split(), "cc": "ção não que são lhe".split()}
ODD = [None, "", " \t\n", "12 34!", "\U0001f600 ...", "a", "Ж", "ÀÉ ß 中文", "\x00\x1c z", "é" * 3, "d͜z"]
SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double"  # clashing extra columns


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "no", 7.0) for i, (t, lang) in enumerate(rows)], SCHEMA)


def plain_subwords(t):
    """Runs of one to four characters: in the middle letters and marks alone, at the ends one sign at most."""
    word = lambda c: unicodedata.category(c)[0] in "LM"
    low, out = f" {t.lower()} ", []
    for i in range(len(low)):
        for k in range(1, 5):
            s = low[i : i + k]
            if len(s) == k and (word(s) if k == 1 else word(s[0]) or word(s[1]) if k == 2 else all(map(word, s[1:-1]))):
                out.append("".join(c if word(c) else " " for c in s))
    return out


def test_subwords_of_plain_version(monkeypatch):
    r = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(r.choice("abc dé.1 ") for _ in range(r.randrange(90))) for _ in range(60)]
    for t in texts:
        for segment in (1 << 17, 5, 7):
            monkeypatch.setattr(language_id, "SEGMENT", segment)
            at, shares = language_id.subwords(t)
            want = plain_subwords(t)
            assert (not want and not len(at)) or abs(float(shares.sum()) - 1) < 1e-5
            counts = np.rint(shares * len(want)).astype(int)
            assert counts.sum() == len(want)
    # one table row for one subword, wherever it stands
    (a,) = {x for x in language_id.buckets(np.array([0, 97, 0], np.uint32))[0].tolist() if x < language_id.BUCKETS}
    assert a in language_id.subwords("xyz a")[0] and a in language_id.subwords("bab")[0]


def test_pieces_and_batches_change_nothing(monkeypatch):
    r = random.Random(5)
    model = language_id.LanguageModel(["x", "y"], np.random.RandomState(1).normal(0, 1, (language_id.BUCKETS, language_id.WIDTH)), np.random.RandomState(2).normal(0, 1, (language_id.WIDTH, 2)), np.zeros(2))
    texts = [t or "" for t in ODD] + [text(r, lang, 200) for lang in SYLLABLES] + ["a" * 500]
    langs, scores = language_id.Reader(model).predict(texts)
    for i, t in enumerate(texts):  # means of embeddings first, or logits of rows first
        at, shares = language_id.subwords(t)
        p = model.probabilities(model.logits((shares @ model.embeddings[at])[None]))[0]
        if langs[i] != "und":
            assert langs[i] == model.languages[p.argmax()] and abs(p.max() - scores[i]) < 1e-5
    monkeypatch.setattr(language_id, "SEGMENT", 11)
    again = language_id.Reader(model).predict(texts)
    assert again[0] == langs and np.allclose(again[1], scores)


def test_held_out_accuracy_odd_rows_and_rejection(spark):
    r = random.Random(7)
    rows = [(text(r, lang, r.randrange(1, 30)), lang) for _ in range(150) for lang in SYLLABLES]
    odd = [(t, "aa") for t in ODD] + [("неизвестный алфавит здесь", None), (text(r, "bb", 120_000), None), (rows[0][0], "aa"), (rows[0][0], None)]
    docs = table(spark, rows + odd)
    model = language_id.fit_languages(docs, F.col("doc_id") % 3 != 0)
    found = {x.doc_id: x for x in language_id.identify_languages(docs, model).collect()}
    assert len(found) == len(rows) + len(odd)
    left_out = [i for i in range(len(rows)) if i % 3 == 0]
    assert sum(found[i].lang_pred == rows[i][1] for i in left_out) >= 0.97 * len(left_out)
    for i, (t, _) in enumerate(odd, len(rows)):
        letters = any(c.isalpha() for c in t or "")
        assert (found[i].lang_pred == "und") == (not letters) and (letters or found[i].score == 0)
        assert 0 <= found[i].score <= 1
    n = len(rows) + len(ODD)
    assert not found[n].accepted and found[n + 1].lang_pred == "bb" and found[n + 1].accepted
    assert found[0].asDict() | {"doc_id": 0} == found[n + 2].asDict() | {"doc_id": 0} == found[n + 3].asDict() | {"doc_id": 0}


def test_without_rows_or_labels(spark):
    empty = table(spark, [("a b", None)]).where("false")
    for docs in (empty, table(spark, [("a b", None), (None, "x")])):
        model = language_id.fit_languages(docs, F.lit(True))
        assert model.languages == [] and {x.lang_pred for x in language_id.identify_languages(docs, model).collect()} <= {"und"}
    one = table(spark, [("a b", "x"), ("c", "x")])
    assert {x.lang_pred for x in language_id.identify_languages(one, language_id.fit_languages(one, F.lit(True))).collect()} == {"x"}


def test_sample_is_bounded_and_repeated_rows_count_once(spark):
    r = random.Random(9)
    rows = [(text(r, "aa", 5), "aa") for _ in range(400)] + [("same text", "bb")] * 2000 + [(text(r, "bb", 5), "bb") for _ in range(50)]
    docs = table(spark, rows)
    model = language_id.fit_languages(docs, F.lit(True), sample_rows=100)
    found = language_id.identify_languages(docs, model).groupBy("lang_pred").count().collect()
    assert {x.lang_pred: x["count"] > 0 for x in found} == {"aa": True, "bb": True}


def test_calibration():
    model = language_id.LanguageModel(["x", "y"], np.zeros((2, 1)), np.zeros((1, 2)), np.zeros(2))
    r = np.random.RandomState(4)
    z = r.normal(0, 2, 4000)
    labels = (r.rand(4000) < 1 / (1 + np.exp(-z))).astype(int)  # logits three times too large
    language_id.calibrate(model, np.stack([np.zeros(4000), 3 * z], 1), labels, 0.9)
    assert 2.4 < model.temperature < 3.7
    p = model.probabilities(np.stack([np.zeros(4000), 3 * z], 1))
    sure = p.max(1) >= model.bound
    assert 0.3 < sure.mean() < 0.95 and (p.argmax(1) == labels)[sure].mean() >= 0.89


def test_query(spark):
    found = registry.op11_language(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(docs, on="doc_id")
    assert len(both) == len(docs) and (both.lang == both.lang_pred)[both.held_out].mean() > 0.9
