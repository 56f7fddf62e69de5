import random
import tracemalloc
import zlib

import numpy as np
import pytest

from arcframe.llm import langid

from .data import ODD_TEXTS, documents

SYLLABLES = {"aa": "ka lo mi pu ne ta", "bb": "sch ung ver lich zu ein", "cc": "eau oux que ais ment", "dd": "ción llo ñas que dor", "ee": "th ing wh ough the", "ff": "жи ло ква за не", "gg": "日 本 語 の は", "hh": "ij oo een aan ge", "ii": "ssä yö kka min ta", "jj": "cz rz szy ow nie"}


def labelled(spark, languages, n=60):
    rng = random.Random(1)
    rows = []
    for k in range(n * len(languages)):
        lang = languages[k % len(languages)]
        parts = SYLLABLES[lang].split()
        rows.append((k, " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("n", [1, 2, 4, 8, 10])
def test_held_out_accuracy(spark, n):
    docs = labelled(spark, sorted(SYLLABLES)[:n])
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97 and held


def test_the_fit_is_ridge_regression_in_little_memory():
    rng = np.random.default_rng(2)
    labels = [["aa", "bb", "cc"][k] for k in rng.choice(3, 800, p=[0.6, 0.3, 0.1])]
    x = rng.random((800, langid.FEATURES)) + 0.1 * np.array([ord(v[0]) - 97 for v in labels])[:, None] * (np.arange(langid.FEATURES) % 7 == 0)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)
    tracemalloc.start()
    model = langid.fit(x, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    # rows weighted so that languages count alike, centred; a point where the gradient is zero
    weight = np.array([800 / 3 / labels.count(v) for v in labels])
    y = model.code[[model.languages.index(v) for v in labels]]
    wide = x.astype(float)
    error = weight[:, None] * (y - wide @ model.weights - model.bias)
    assert np.abs(error.sum(0)).max() < 1e-2 and np.abs((wide - np.average(wide, 0, weight)).T @ error - langid.DECAY * model.weights).max() < 1e-3
    right = (wide @ model.weights + model.bias) * y > 0
    share = np.stack([right[[v == k for v in labels]].mean(0) for k in model.languages]) + 1e-6
    assert np.allclose(model.trust, share / share.sum(1, keepdims=True))


def test_predictions_depend_on_text_alone(spark):
    docs = labelled(spark, ["aa", "bb", "ee"])
    first = {r.doc_id: r.lang_pred for r in langid.identify_languages(docs).collect()}
    from pyspark.sql import functions as F

    # held-out labels are never learned from: garbling them changes nothing
    garbled = docs.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in langid.identify_languages(garbled.repartition(3)).collect()} == first


def test_odd_rows(spark):
    texts = [*ODD_TEXTS, "123 456", "ß"]
    rows = langid.identify_languages(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        has_letter = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred in ("en", "de")) == has_letter and (r.lang_pred == "und") == (not has_letter)
        assert r.score == 0 or has_letter
    same = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert same[8] == same[9]


def test_tables_without_labels(spark):
    assert langid.identify_languages(documents(spark, [])).count() == 0
    unlabelled = documents(spark, ["some text", None], [None, None]).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {(r.lang_pred, r.score, r.held_out) for r in langid.identify_languages(unlabelled).collect()} == {("und", 0.0, True)}


@pytest.mark.parametrize("n", range(2, 20))
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= max(1, code.shape[1] // 4) and (abs(code.sum(0)) < n).all()


def test_wrong_bits_are_corrected():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, np.eye(code.shape[1], dtype=np.float32), np.zeros(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    for k in range(5):
        for wrong in range(code.shape[1]):
            x = code[k].copy()
            x[wrong] *= -1
            assert model.predict(x[None])[0] == ["abcde"[k]]


def test_pieces_count_as_the_whole(monkeypatch):
    text = " ".join("wort" + str(i) + "ä" * (i % 5) for i in range(400))
    whole = langid.features(text)
    monkeypatch.setattr(langid, "PIECE", 97)
    assert np.allclose(langid.features(text), whole)


def test_the_sample_is_bounded_where_one_id_has_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "SPARE", 3)
    sizes = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, labels: sizes.append(len(labels)) or fit(x, labels))
    # an id that the seed draws
    hot = spark.range(5000).where("pmod(xxhash64(3, id), 1048576) < 1048576 * 10 / 1500").first().id
    rows = [(hot if i % 3 else 10_000 + i, f"word{i} and text number {i}", "en" if i % 2 else "de") for i in range(3000)]
    langid.train(spark.createDataFrame(rows, "id long, text string, lang string"), 3, total=20, each=10)
    assert sizes == [2 * (2 * 10 + 3)]
