from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import features, scoring
from labelloom.plans import inputs as given
from labelloom.session import new_path, stored
from labelloom.sources.runs import discover_runs
from labelloom.streaming.incremental import file_stream, score_stream

CLASSES = [("B", "blue sky"), ("A", "red apple")]


def answers(rows):
    return scoring.answers_of(rows, lambda: lambda texts: [t.upper() for t in texts]).select("id", F.col("raw_output").alias("prediction"))


def texts(spark, rows):
    return spark.createDataFrame(rows, "id int, text string")


def test_scores_of_texts_without_known_terms(spark):
    corpus = texts(spark, [(1, "red apple pie"), (2, "blue sky red"), (3, ""), (4, "zzz"), (5, "red apple blue sky")])
    vocab = stored(features.vocabulary(features.document_terms(corpus)), "vocabulary")
    found = {r.id: r for r in scoring.lexical_scores(corpus, CLASSES, vocab).collect()}
    assert len(found) == 5
    assert found[1].prediction == "A" and found[2].prediction == "B"
    for key in (3, 4):
        assert found[key].prediction == "A" and found[key].confidence == 0.0
        assert found[key].probabilities == {"A": 0.5, "B": 0.5}


def test_five_thousand_classes_equal_plain_cosines(spark, monkeypatch):
    """The plan is that of two classes; small batches and spans; a word that all classes share."""
    draw = np.random.default_rng(3)
    words = [f"word{i}" for i in range(900)]
    classes = [(f"c{k:04d}", "common " + " ".join(draw.choice(words, 4))) for k in range(5000)]
    rows = [(i, " ".join([*draw.choice(words, draw.integers(0, 9)), *(["common"] if i % 3 == 0 else [])])) for i in range(60)]
    corpus = texts(spark, [*rows, (100, ""), (101, "zzz yyy")])
    described = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(classes)], "id int, text string")
    vocab = stored(features.vocabulary(features.document_terms(corpus.unionByName(described), bigrams=False)), "vocabulary")
    plan = lambda some: scoring.lexical_scores(corpus, some, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan(classes).split("\n")) == len(plan(classes[:2]).split("\n"))
    monkeypatch.setattr(scoring, "HELD", 20_000)
    found = {r.id: r for r in scoring.lexical_scores(corpus, classes, vocab).collect()}
    idf = {r.term: r.idf for r in vocab.collect()}

    def vector(text):
        counts = Counter(t for t in text.split() if t in idf)
        raw = {t: (1 + np.log(n)) * idf[t] for t, n in counts.items()}
        length = np.sqrt(sum(w * w for w in raw.values()))
        return {t: w / length for t, w in raw.items()}

    centres = [vector(text) for _, text in classes]
    for i, text in [*rows, (100, ""), (101, "zzz yyy")]:
        own = vector(text)
        cosines = np.array([sum(w * c.get(t, 0.0) for t, w in own.items()) for c in centres])
        p = np.exp(cosines / 0.1) / np.exp(cosines / 0.1).sum()
        ranked = sorted(range(5000), key=lambda k: (-round(p[k], 12), k))
        assert found[i].prediction == classes[ranked[0]][0]
        assert found[i].confidence == pytest.approx(p[ranked[0]] - p[ranked[1]], abs=1e-9)
        for label, value in found[i].probabilities.items():
            assert value == pytest.approx(p[int(label[1:])])
        assert len(found[i].probabilities) == min(10, int((cosines > 0).sum()))


def test_scores_with_a_large_vocabulary_are_the_same(spark, monkeypatch):
    corpus = texts(spark, [(i, f"red apple {'blue' if i % 3 else 'pie'} sky w{i % 7}") for i in range(40)] + [(40, ""), (1, "blue sky")])
    vocab = stored(features.vocabulary(features.document_terms(corpus)), "vocabulary")
    columns = ["id", "prediction", F.round("confidence", 9).alias("c"), F.round(F.col("probabilities")["B"], 9).alias("b")]
    direct = stored(scoring.lexical_scores(corpus, CLASSES, vocab).select(*columns), "direct")
    monkeypatch.setattr(features, "ROWS_PER_TASK", 5)
    for most, words in ((3, 1000), (0, 1), (9, 2)):
        monkeypatch.setattr(features, "MAX_BROADCAST_TERMS", most)
        monkeypatch.setattr(features, "MAX_BROADCAST_ROWS", words)
        large = scoring.lexical_scores(corpus, CLASSES, vocab).select(*columns)
        assert large.count() == 42 and large.exceptAll(direct).isEmpty() and direct.exceptAll(large).isEmpty()


def test_vocabulary_of_texts_is_that_of_counted_terms(spark, monkeypatch):
    """Pieces of a few bytes; null and empty texts count as documents; no term is made to count documents."""
    rows = [(i, f"Red apple w{i % 5} red apple pie{'!' * i} x") for i in range(30)] + [(30, ""), (31, None), (31, "red sky"), (None, "red sky")]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(2)
    terms = features.document_terms(docs)
    columns = ["term", "df", F.round("idf", 12).alias("idf")]
    expected = stored(features.vocabulary(terms).select(*columns), "expected")
    for most in (1, 100, 1 << 22):
        monkeypatch.setattr(features, "VOCABULARY_BYTES", most)
        found = stored(features.vocabulary(docs).select(*columns), "found")
        assert found.schema == expected.schema and found.count() == expected.count() > 5
        assert found.exceptAll(expected).isEmpty()
    plan = features.vocabulary(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_texts_are_marked_like_their_counted_terms(spark, monkeypatch):
    """Words in other pairs, words outside the vocabulary, null and empty texts; small and large vocabularies; pieces of a few bytes."""
    rows = [(i, f"red apple w{i % 9} pie red apple{' sky' * (i % 3)} once{i}") for i in range(60)] + [(60, ""), (61, None), (62, "apple red"), (None, "zz yy")]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(2)
    vocab = stored(features.vocabulary(docs), "vocabulary")
    marks = spark.createDataFrame([("red apple", 0), ("w3", 1), ("sky", 2), ("unseen", 3)], "term string, number int")

    def shown(df):
        return {r["id"]: (round(r["squares"], 9), sorted((n, round(x, 9)) for n, x in zip(r["numbers"], r["raws"]))) for r in df.collect()}

    expected = shown(features.marked_terms(features.document_terms(docs), vocab, marks))
    assert len(expected) == 64 and expected[5][0] > 0
    for most, size in ((1_000_000, 1 << 22), (1_000_000, 1), (4, 100), (0, 1)):
        monkeypatch.setattr(features, "MAX_BROADCAST_TERMS", most)
        monkeypatch.setattr(features, "VOCABULARY_BYTES", size)
        assert shown(features.marked_terms(docs, vocab, marks)) == expected


def test_only_rare_terms_of_the_vocabulary_move(spark, monkeypatch):
    corpus = texts(spark, [(i, f"common words r{i // 2} once{i}") for i in range(400)])
    terms = features.document_terms(corpus, bigrams=False)
    vocab = stored(features.vocabulary(terms), "vocabulary")
    marks = spark.createDataFrame([("r7", 0), ("common", 1)], "term string, number int")
    whole = {r["id"]: r for r in features.marked_terms(terms, vocab, marks).collect()}
    kept = []
    monkeypatch.setattr(features, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    monkeypatch.setattr(features, "MAX_BROADCAST_TERMS", 50)
    found = {r["id"]: r for r in features.marked_terms(terms, vocab, marks).collect()}
    assert found.keys() == whole.keys()
    for i, row in found.items():
        assert row["squares"] == pytest.approx(whole[i]["squares"])
        assert sorted(zip(row["numbers"], row["raws"])) == sorted(zip(whole[i]["numbers"], whole[i]["raws"]))
    moved = kept[0].select(F.inline("rare")).toPandas()["term"]
    assert {f"r{i}" for i in range(200) if i != 7} <= set(moved)
    # Frequent and marked terms stay, and few of the 400 terms outside the vocabulary pass the filter.
    assert not {"common", "words", "r7"} & set(moved) and moved.str.startswith("once").sum() < 100


def test_salted_join_equals_broadcast(spark, folder, monkeypatch):
    terms = stored(features.document_terms(given.documents(spark, folder).select("id", "text")), "terms")
    vocab = stored(features.vocabulary(terms), "vocabulary")
    columns = ["id", "term", "tf", "df", "raw"]
    direct = features.raw_weights(terms, vocab).select(columns)
    monkeypatch.setattr(features, "MAX_BROADCAST_TERMS", 10)
    salted = features.raw_weights(terms, vocab).select(columns)
    assert direct.count() == salted.count()
    assert direct.exceptAll(salted).isEmpty()
    whole = features.raw_weights(terms, vocab, every=True)
    assert whole.where("raw IS NOT NULL").count() == direct.count()
    assert whole.select("id").distinct().count() == terms.count()


def test_resume_skips_done_ids_and_restart_rescores(spark):
    path = new_path(spark, "results")
    first = scoring.score_pending(texts(spark, [(1, "a"), (2, "b")]), answers, path, "s", "1", run=1)
    assert {(r.id, r.prediction, r.run) for r in first.collect()} == {(1, "A", 1), (2, "B", 1)}
    more = texts(spark, [(1, "changed"), (2, "b"), (3, "c")])
    second = scoring.score_pending(more, answers, path, "s", "1", run=2)
    assert {(r.id, r.prediction, r.run) for r in second.collect()} == {(1, "A", 1), (2, "B", 1), (3, "C", 2)}
    again = scoring.score_pending(more, answers, path, "s", "1", run=2)
    assert again.count() == 3
    other = scoring.score_pending(more, answers, path, "t", "1", run=3)
    assert {(r.scorer, r.run) for r in other.collect()} == {("t", 3)}
    restarted = scoring.score_pending(more, answers, path, "s", "1", run=4, restart=True)
    assert {(r.id, r.prediction, r.run) for r in restarted.collect()} == {
        (1, "CHANGED", 4), (2, "B", 4), (3, "C", 4),
    }


def test_stream_stopped_and_resumed_equals_batch(spark, folder):
    documents = given.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    vocab = stored(features.vocabulary(features.document_terms(documents)), "vocabulary")

    def score(rows):
        return scoring.lexical_scores(rows, given.DOCUMENT_CLASSES, vocab)

    arriving, results, checkpoint = (new_path(spark, n) for n in ("arriving", "results", "checkpoint"))
    for part in range(4):
        documents.where(F.col("id") % 4 == part).coalesce(1).write.mode("append").parquet(arriving)
        if part % 2:
            stream = file_stream(spark, arriving, documents.schema, files_per_batch=1)
            score_stream(stream, score, results, checkpoint, "lexical", "1").awaitTermination()
    schema = scoring.result_schema(score(documents).schema)
    found = scoring.read_results(spark, results, schema)
    assert found.count() == documents.count()
    assert found.select("run").distinct().count() == 4
    rounded = [F.round("confidence", 9).alias("confidence"), "id", "prediction"]
    assert found.select(rounded).exceptAll(score(documents).select(rounded)).isEmpty()


def test_typed_response_must_be_a_choice(spark):
    body = '{"model": "m", "answers": {"q": {"type": "text", "choice": "A"}}, "usage": {"input_tokens": 1}}'
    responses = spark.createDataFrame([(7, body)], "id int, raw_response string")
    with pytest.raises(Exception, match="expected a choice answer for id 7"):
        scoring.typed_responses(responses, "q").collect()


def test_argmax_ties_go_to_the_smallest_label(spark):
    rows = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "a", 0.1), (2, "c", 0.9)], "id int, label string, p double")
    assert {(r.id, r.prediction) for r in scoring.argmax_class(rows).collect()} == {(1, "a"), (2, "c")}


def test_metric_files_are_found_by_name(spark, tmp_path):
    for name in ("tfidf_lr_v2_b20_d01.json", "embedding_lr_v2_b100_d05.json", "other_v2_bx_dy.json"):
        (tmp_path / name).write_text('{\n  "model": "x",\n  "macro_f1": 0.5,\n  "accuracy": 0.25\n}')
    found = discover_runs(spark, f"{tmp_path}/*_v2_b*_d*.json").collect()
    assert {(r.model, r.budget, r.draw, r.macro_f1) for r in found} == {
        ("tfidf_lr_v2", 20, 1, 0.5), ("embedding_lr_v2", 100, 5, 0.5),
    }


def test_every_record_of_a_file_is_a_run(spark, tmp_path):
    one = '{"macro_f1": 0.5, "accuracy": 0.25, "note": "a } { b"}'
    (tmp_path / "m_b20_d01.json").write_text(f"{one}\n{one.replace('0.5', '0.75')}\n")
    (tmp_path / "m_b20_d02.json").write_text('{\n "macro_f1": 1,\n "accuracy": 1\n}\n{\n "macro_f1": 0\n}')
    (tmp_path / "m_b20_d03.json").write_text('[{"macro_f1": 0.1}, {"macro_f1": 0.2}]')
    found = discover_runs(spark, f"{tmp_path}/*.json").collect()
    assert sorted((r.draw, r.macro_f1) for r in found) == [(1, 0.5), (1, 0.75), (2, 0.0), (2, 1.0), (3, 0.1), (3, 0.2)]
    (tmp_path / "m_b20_d04.json").write_text('{"macro_f1": 0.1')
    with pytest.raises(Exception):
        discover_runs(spark, f"{tmp_path}/m_b20_d04.json").collect()


def test_scorers_and_class_versions_share_run_numbers(spark):
    path = new_path(spark, "results")
    rows = texts(spark, [(1, "a"), (2, "b")])
    for scorer, version in (("s", "1"), ("t/u=v", "1"), ("s", "2"), ("s", "1")):
        assert scoring.score_pending(rows, answers, path, scorer, version, run=1).count() == 2
    schema = scoring.result_schema(answers(rows).schema)
    found = scoring.read_results(spark, path, schema).groupBy("scorer", "class_version").count().collect()
    assert {(r.scorer, r.class_version): r["count"] for r in found} == {("s", "1"): 2, ("t/u=v", "1"): 2, ("s", "2"): 2}
    with pytest.raises(ValueError, match="need a name"):
        scoring.score_pending(rows, answers, path, "", "1", run=1)


def test_a_second_stream_keeps_the_first_ones_results(spark):
    results, arriving = new_path(spark, "results"), new_path(spark, "arriving")
    for turn, rows in enumerate(([(1, "a"), (2, "b")], [(3, "c")])):
        texts(spark, rows).write.mode("append").parquet(arriving)
        stream = file_stream(spark, arriving, "id int, text string")
        score_stream(stream, answers, results, new_path(spark, f"checkpoint-{turn}"), "s", "1").awaitTermination()
    schema = scoring.result_schema(answers(texts(spark, [])).schema)
    assert {r.id for r in scoring.read_results(spark, results, schema).collect()} == {1, 2, 3}


def test_large_class_lists_are_refused():
    with pytest.raises(ValueError, match="too large"):
        scoring.checked_classes([("A", "x" * 20_000_000)])


def test_class_version_follows_the_definitions():
    assert scoring.version_of(CLASSES) == scoring.version_of(CLASSES[::-1])
    assert scoring.version_of(CLASSES) != scoring.version_of([("A", "red apple"), ("B", "blue sea")])
