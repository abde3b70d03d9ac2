import csv
import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import joins, scoring, taxonomy
from labelloom.sources.tables import CSV_OPTIONS, keyed, read_csv


def test_keyed_tables_meet_without_a_shuffle(spark):
    truth = spark.range(3000).select("id", F.concat(F.lit("c"), F.col("id") % 3).alias("v2_label"))
    predictions = spark.range(3000).repartition(5).select("id", F.concat(F.lit("c"), F.col("id") % 4).alias("prediction"))
    left, right = keyed(truth, "id", 6, "truth"), keyed(predictions, "id", 6, "predictions")
    # Small tables would be broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (joins.aligned(left, right), joins.left_aligned(left, right), joins.matched(right, left)):
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
            assert joined.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = joins.aligned(truth, predictions)
    assert joins.aligned(left, right).exceptAll(again).isEmpty()
    twice = keyed(predictions.unionByName(predictions.where("id = 7")), "id", 6, "predictions")
    with pytest.raises(Exception, match="duplicate key"):
        joins.aligned(left, twice).collect()


def test_sketches_of_loads_count_distinct_values(spark):
    loads = [spark.range(n, n + 60_000).select("id", (F.col("id") % 700).alias("few"), F.lit(None).cast("int").alias("none")) for n in (0, 30_000, 120_000)]
    kept = loads[0].limit(0).select(F.lit("").alias("column"), F.lit(0).cast("long").alias("rows"), F.lit(b"").alias("sketch"))
    for load in loads:
        kept = kept.unionByName(taxonomy.distinct_sketches(load, "id", "few", "none"))
    found = {r["column"]: r for r in taxonomy.merged_distinct_counts(kept).collect()}
    assert {(r.loads, r.rows) for r in found.values()} == {(3, 180_000)}
    assert found["few"]["values"] == 700 and found["none"]["values"] == 0
    assert abs(found["id"]["values"] - 150_000) < 4 * 1.04 / 2**8 * 150_000


GOOD = '{"model": "m", "answers": {"q": {"type": "choice", "choice": "A", "confidence": 0.5, "probabilities": {"A": 0.75, "B": 0.25}}}, "usage": {"input_tokens": 3}}'
PROBLEMS = {
    "no JSON": [None, "", "{", GOOD[:-2], "plain words"],
    "no answer to the question": ["{}", "[]", "3", '{"answers": {}}', '{"answers": {"other": {"type": "choice"}}}'],
    "expected a choice answer": ['{"answers": {"q": {"type": "text", "choice": "A"}}}', '{"answers": {"q": {"choice": "A"}}}', '{"answers": {"q": 3}}'],
    "no choice is named": ['{"answers": {"q": {"type": "choice"}}}', '{"answers": {"q": {"type": "choice", "choice": null}}}'],
    "confidence of another type": [GOOD.replace("0.5", '"high"')],
    "probabilities of another type": [GOOD.replace('{"A": 0.75, "B": 0.25}', "[0.75, 0.25]"), GOOD.replace("0.75", '"most"')],
    "input_tokens of another type": [GOOD.replace("3}", '"many"}')],
}


def test_bad_responses_are_listed_with_a_reason(spark):
    cases = [(None, GOOD), (None, GOOD.replace("0.5", "null")), (None, GOOD.replace('"model": "m", ', ""))]
    cases += [(problem, text) for problem, texts in PROBLEMS.items() for text in texts]
    responses = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "id int, raw_response string")
    sound, bad = scoring.split_responses(responses, "q")
    assert {r.id: (r.problem, r.raw_response) for r in bad.collect()} == {i: c for i, c in enumerate(cases) if c[0]}
    typed = {r.id: r for r in sound.collect()}
    assert set(typed) == {0, 1, 2}
    assert tuple(typed[0])[1:] == ("A", 0.5, {"A": 0.75, "B": 0.25}, "m", 3, None)
    assert typed[1].confidence is None and typed[2].response_model is None
    with pytest.raises(Exception, match="no JSON for id 1"):
        scoring.typed_responses(spark.createDataFrame([(1, "{")], "id int, raw_response string"), "q").collect()


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def csv_rows(n):
    """Rows short and long; some longer than several splits, with quotes, line breaks and separators."""
    draw = random.Random(n)
    rows = []
    for i in range(n):
        kind = draw.randrange(8)
        text = [None, "", "plain", 'a "quoted", word', "two\nlines", "\n\n", 'x"\n"y', "long line,\n" * draw.choice([3, 40, 900])][kind]
        rows.append((i, text, draw.choice(["en", None, 'd"e', "f\nr"]), i / 4))
    return rows


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_a_large_csv_file_is_read_by_many_tasks(spark, tmp_path, small_splits, ends):
    schema, rows = "id bigint, text string, lang string, x double", csv_rows(400)
    for name, part in (("a.csv", rows[:300]), ("b.csv", rows[300:]), ("empty.csv", [])):
        with open(tmp_path / name, "w", newline="") as out:
            write = csv.writer(out, lineterminator=ends)
            write.writerow(["id", "text", "lang", "x"])
            for i, text, lang, x in part:
                out.write(",".join([str(i), *["\x1a" if v is None else '"' + v.replace('"', '""') + '"' for v in (text, lang)], str(x)]) + ends)
    found = read_csv(spark, str(tmp_path), schema)
    assert sorted(tuple(r) for r in found.collect()) == rows
    # The same with one task per file.
    whole = spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=True).csv(str(tmp_path))
    assert found.exceptAll(whole).isEmpty() and whole.count() == 400
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 30


def test_a_csv_file_whose_last_record_stays_open(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text("id,text\n1,a\n\n2,\"open\n" + "more\n" * 900)
    found = {r.id: r.text for r in read_csv(spark, str(tmp_path), "id int, text string").collect()}
    assert found[1] == "a" and found[2].startswith("open\nmore\n") and len(found) == 2


def test_no_csv_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,text\n")
    (tmp_path / "nothing.csv").write_text("")
    assert read_csv(spark, str(tmp_path), "id int, text string").collect() == []
