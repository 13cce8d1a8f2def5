import zlib

from kvartal.llm import toxicity


def test_features_are_words_pairs_and_skips():
    f = toxicity.features("You are, bad!")
    assert len(f) == 1 + 3 + 2 + 1 and set(f) == set(toxicity.features("YOU are%%% BAD"))
    assert list(toxicity.features(None)) == [0] == list(toxicity.features(" \n"))


def test_rows(spark):
    text = lambda i: f"word{i % 7} calm thing{i % 5}" + (" vileword" if i % 3 == 0 else "")
    rows = [(i, text(i), 9) for i in range(600)] + [(9000, None, 9), (9001, "", 9), (9002, "vileword " * 20000, 9), (None, "vileword", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(600)] + [(None, 1), (5, None), (7, 0), (7, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == (i % 3 == 0) for i in range(600)) and by[9002].predicted == 1 == by[None].predicted
    assert by[9000].score == by[9001].score and 0 <= by[9000].score < 0.3
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in got.collect() if r.held_out and r.doc_id in y]
    hit = sum(r.predicted and y[r.doc_id] for r in got)
    assert hit >= 0.75 * sum(y[r.doc_id] for r in got) and hit >= 0.9 * sum(r.predicted for r in got)
