import math
import zlib

import numpy as np
import pytest
import zstandard

from labelloom.llm import language, quality
from labelloom.llm.common import held_out, table
from labelloom.llm.queries import QUERIES


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.01"


def test_quality_of_held_out_documents(spark, folder):
    scored = QUERIES["op2_quality"](spark, folder).toPandas()
    labels = table(spark, folder, "labels").toPandas()
    assert len(scored) == table(spark, folder, "documents").count()
    assert scored["score"].between(0, 1).all()
    assert (scored["predicted"] == (scored["score"] >= 0.3)).all()
    assert (scored["held_out"] == scored["doc_id"].map(is_held_out)).all()
    assert quality.accuracy(scored, labels) > 0.9


def test_quality_learns_nothing_from_held_out_rows(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    one, other = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert one.dictionaries == other.dictionaries and np.allclose(one.weights, other.weights)


def test_quality_of_odd_documents(spark, folder, odd_documents, no_documents):
    model = quality.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    found = quality.score(odd_documents, model).toPandas()
    assert len(found) == odd_documents.count()
    assert found["score"].between(0, 1).all()
    empty = found[found["doc_id"].isin([103, 104])]["score"]
    assert empty.nunique() == 1
    assert quality.score(no_documents, model).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(odd_documents, nothing) is None
    assert set(quality.score(odd_documents, None).toPandas()["score"]) == {0.5}


def test_features_count_every_block():
    bad, good = quality.compressors([b"x" * 64, b"abc " * 16])
    short = quality.features(b"abc " * 100, bad, good)
    long = quality.features(b"abc " * 100_000, bad, good)
    assert short[0] > 0 and long[0] > 0 and long[2] > short[2]
    assert quality.features(b"", bad, good) == (0.0, 1.0, 0.0)


def test_language_of_held_out_documents(spark, folder):
    found = QUERIES["op6_language"](spark, folder).toPandas()
    truth = table(spark, folder, "documents").select("doc_id", "lang").toPandas()
    both = found.merge(truth, on="doc_id")
    assert len(found) == len(truth)
    held = both[both["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert set(found["lang_pred"]) <= set(truth["lang"]) | {"und"}


def brute_slots(text, bits=16):
    """The n-grams' slots one by one, by the same hash."""
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    letters = " " + letters + " "
    while "  " in letters:
        letters = letters.replace("  ", " ")
    found = []
    for n in language.ORDERS:
        for i in range(len(letters) - n + 1):
            h = n
            for c in letters[i : i + n]:
                h = (h * 0x01000193 + ord(c)) % 2**32
            h = h * 0x9E3779B1 % 2**32
            h = (h ^ h >> 15) * 0x85EBCA77 % 2**32
            found.append(h >> 32 - bits)
    return found


def test_scores_equal_those_of_one_text_at_a_time():
    draw = np.random.default_rng(2)
    model = language.LanguageModel(["a", "b", "c"], np.log(draw.random((3, (1 << 16) + 1))))
    model.logs[:, -1] = 0
    texts = ["Hello wörld", "", "123 --", "  \u4e2d\u6587 x\U0001f600", "a", "ÀÉ " * 400]
    names, scores = model.predict([t.encode() for t in texts])
    for text, name, score in zip(texts, names, scores):
        if not any(map(str.isalpha, text)):
            assert (name, score) == ("und", 0.0)
            continue
        slots = brute_slots(text)
        sums = model.logs[:, slots].sum(axis=1) * min(1.0, language.EVIDENCE / len(slots))
        shares = np.exp(sums - sums.max())
        assert name == model.languages[int(np.argmax(sums))]
        assert score == pytest.approx(shares.max() / shares.sum())


def brute_bayes(rows, bits):
    """lang -> log probabilities, counted n-gram by n-gram."""
    held = {}
    for doc_id, text, lang in rows:
        if lang is not None and text is not None and not is_held_out(doc_id):
            counts = held.setdefault(lang, np.zeros(1 << bits))
            if any(map(str.isalpha, text)):
                np.add.at(counts, brute_slots(text, bits), 1)
    return {lang: np.log((c + language.SMOOTHING) / (c + language.SMOOTHING).sum()) for lang, c in held.items() if c.any()}


@pytest.mark.parametrize("languages, most", [(3, 1 << 24), (40, 1 << 16)])
def test_fit_and_predictions_equal_plain_naive_bayes(spark, monkeypatch, languages, most):
    """More languages get fewer slots; none is left out, whatever its frequency."""
    monkeypatch.setattr(language, "MOST_NUMBERS", most)
    draw = np.random.default_rng(5)
    rows = []
    for i in range(600):
        k = int(min(draw.integers(0, languages), draw.integers(0, languages)))
        letters = np.array(list("abcdefghijklmnopqrstuvwxyzéßñ"))[(np.arange(6) * 5 + k) % 29]
        text = " ".join("".join(draw.choice(letters, 4)) for _ in range(draw.integers(1, 12)))
        rows.append((i, text, f"l{k:02d}"))
    rows += [(700, None, "l00"), (701, "no language", None), (702, "123 --", "l00"), (None, "abc", "l00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(docs)
    bits = language.slot_bits(len({r[2] for r in rows if r[2] and r[1] and not is_held_out(r[0])}))
    expected = brute_bayes(rows, bits)
    assert model.bits == bits == (16 if languages == 3 else 10) and model.languages == sorted(expected)
    for lang, logs in zip(model.languages, model.logs):
        assert np.allclose(logs[:-1], expected[lang])
    found = {r.doc_id: r for r in language.predictions(docs, model).collect()}
    for doc_id, text, _ in rows[:200]:
        slots = brute_slots(text, bits)
        sums = np.array([expected[lang][slots].sum() for lang in model.languages]) * min(1.0, language.EVIDENCE / len(slots))
        shares = np.exp(sums - sums.max())
        assert found[doc_id].lang_pred == model.languages[int(sums.argmax())]
        assert found[doc_id].score == pytest.approx(shares.max() / shares.sum())


def test_too_many_languages_fail(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_NUMBERS", 1 << 13)
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="too many"):
        language.fit(docs)


def test_blocks_for_dictionaries_come_from_the_whole_text():
    for n in range(1, 40):
        text = b"".join(bytes([65 + i]) * quality.BLOCK for i in range(n))
        taken = [piece[0] - 65 for piece in quality.spread_blocks(text, 4)]
        assert taken == sorted(set(taken)) and len(taken) == min(4, n)
        if n > 4:
            assert all(abs(t - (i + 0.5) * n / 4) <= 1 for i, t in enumerate(taken))


def test_scores_equal_sizes_compressed_one_by_one(spark, folder):
    """Sizes of single blocks with a compressor made anew, and the logistic function written out."""
    docs = table(spark, folder, "documents").limit(60)
    model = quality.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    found = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for row in docs.collect():
        raw, sizes = row.text.encode(), []
        for content in model.dictionaries:
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=quality.LEVEL)
            one = zstandard.ZstdCompressor(dict_data=held, level=quality.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(one.compress(raw[at : at + 2048])) for at in range(0, len(raw), 2048)))
        bad, good = sizes
        difference, left, size = (bad - good) / (bad + good), math.log(min(max((bad + good) / 2 / len(raw), 1e-4), 4.0)), math.log1p(len(raw))
        inputs = [1.0, difference, left, left**2, size, difference * size]
        total = sum(w * (x - m) / s for w, x, m, s in zip(model.weights, inputs, model.mean, model.spread))
        assert found[row.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_many_rows_with_one_labelled_id_count_once(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    first = labels.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0").first().doc_id
    one = quality.fit(docs, labels)
    copies = docs.where(docs.doc_id == first)
    many = quality.fit(docs.unionByName(copies).unionByName(copies).unionByName(copies), labels)
    assert one.dictionaries == many.dictionaries and np.allclose(one.weights, many.weights)


def test_language_of_odd_documents(spark, odd_documents, no_documents):
    model = language.fit(odd_documents)
    found = language.predictions(odd_documents, model).toPandas()
    assert len(found) == odd_documents.count()
    unknown = found[found["lang_pred"] == "und"]
    assert set(unknown["doc_id"].dropna()) == {103, 104, 105, 108}
    kept = language.in_known_language(odd_documents, model, least=0.0)
    assert kept.columns == odd_documents.columns
    assert kept.count() == len(found) - len(unknown)
    assert language.predictions(no_documents, model).count() == 0
    assert set(language.predictions(odd_documents, language.fit(no_documents)).toPandas()["lang_pred"]) == {"und"}


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(language, "STRETCH", 7)
    grams = language.Grams([b"abcdefghijklmnopqrstuvwxyz", b"", b"zz"])
    assert (grams.by_text((grams.codes > 32).astype(float)) == [26, 0, 2]).all()


def test_held_out_matches_the_contract(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", held_out().alias("h"))
    assert all(r.h == is_held_out(r.doc_id) for r in rows.collect())
