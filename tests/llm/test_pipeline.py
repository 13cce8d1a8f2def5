"""Every stage against brute force on its own input."""

import test_decontaminate
import test_mixing
import test_simhash

import corpus_pipeline
from kvartal.llm import mixing


def test_stages(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = raw.columns
    junk = spark.createDataFrame([(10**6, "123 456 !!", "en", "src0", 10), (10**6 + 1, None, "en", "src0", None)], raw.schema)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    dirty = spark.createDataFrame([(10**6 + 2, "Unheard words come before it here. " + item.text.replace("\n", " "), "en", "src1", 1)], raw.schema)
    docs, ins, outs = raw.unionByName(junk).unionByName(dirty), {}, {}
    for name, stage in corpus_pipeline.STAGES:
        ins[name] = docs.collect()
        docs = stage(spark, docs, sf_dir)
        if name != "mix":
            assert docs.columns == cols
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        outs[name] = docs.collect()

    gone = {r.doc_id for r in ins["language_id"]} - {r.doc_id for r in outs["language_id"]}
    assert {10**6, 10**6 + 1} <= gone and all(not any(c.isalpha() for c in r.text or "") for r in ins["language_id"] if r.doc_id in gone)

    before = {r.doc_id: r for r in ins["line_dedup"]}
    for r in outs["line_dedup"]:
        it = iter(before[r.doc_id].text.split("\n"))
        assert all(x in it for x in r.text.split("\n")) and r.n_chars == len(r.text)
    assert sum(len(r.text) for r in outs["line_dedup"]) < sum(len(r.text) for r in ins["line_dedup"])

    fps = [test_simhash.brute_fingerprint(r.text) for r in ins["simhash_dedup"]]
    comp = test_simhash.brute_components([r.doc_id for r in ins["simhash_dedup"]], fps)
    assert {r.doc_id for r in outs["simhash_dedup"]} == {i for i, c in comp.items() if i == c}

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in test_decontaminate.brute([(r.doc_id, r.text) for r in ins["decontamination"]], items) if r[-1]}
    assert 10**6 + 2 in bad
    assert {r.doc_id for r in outs["decontamination"]} == {r.doc_id for r in ins["decontamination"]} - bad

    test_mixing.check([(r.doc_id, r.text, r.source) for r in ins["mix"]], outs["mix"])


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "taken", "shards"} <= set(out.columns) and out.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "some words of a text here", "en", "s", 25), (2, "some words of a text here", "en", "s", 25), (None, "other letters altogether, not near", "en", None, 1)]


def test_odd_rows(spark, sf_dir):
    """Each stage on nulls, repeats and no rows."""
    docs, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    kept = {name: sorted((r.doc_id or -1, r.text) for r in stage(spark, docs, sf_dir).collect() if r.text) for name, stage in corpus_pipeline.STAGES}
    words = [(-1, ODD[4][1]), (2, ODD[2][1]), (2, ODD[2][1])]
    assert all(k == words for k in kept.values()), kept
    blank = {name: sum(not r.text for r in stage(spark, docs, sf_dir).collect()) for name, stage in corpus_pipeline.STAGES}
    assert blank == {"language_id": 0, "line_dedup": 2, "simhash_dedup": 1, "decontamination": 2, "mix": 2}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).collect() == [], name
    taken = {(r.doc_id, r.text, len(r.shards)) for r in corpus_pipeline.mix(spark, docs, sf_dir).collect()}
    assert (None, None, 0) in taken and (1, "", 0) in taken


INNER = (
    "score fit lang_pred n_lines n_dropped n_words n_hit n_items items_sha256 contaminated size source_size target taken shards copy shard "
    "h d g hit ids own drop u s by pick rid rank k n t o times cut bounds fp line leaf no template row _h _d _g _drop _hit _ids _f p b bu bn before"
).split()


def test_columns_of_any_name_come_through(spark, sf_dir):
    """No stage overwrites, loses or trips over a column of the user's."""
    rows = [(1, "some words of a text here", "en", "s", 25), (2, "quite another text with more words in it", "en", "s", 40), (3, "and a third one that says nothing else at all", "en", "t", 45)]
    mine = {c: -5 - k for k, c in enumerate(INNER)}
    docs = spark.createDataFrame([(*r, *mine.values()) for r in rows], SCHEMA + "".join(f", `{c}` int" for c in INNER))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = [r.asDict() for r in out.collect()]
        assert len(got) == 3 and out.columns[: len(docs.columns)] == docs.columns, name
        assert all(r[c] == v for r in got for c, v in mine.items()), name
    drawn = [r.asDict() for r in mixing.draw(out, shards="shards_").collect()]
    assert drawn and all(r[c] == v for r in drawn for c, v in mine.items() if c not in ("copy", "shard"))


def test_run_takes_what_the_mix_decides(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-1:])
    mixed = corpus_pipeline.mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert any(not r.shards for r in mixed) and any(len(r.shards) > 1 for r in mixed)
    assert sorted((r.doc_id, s) for r in mixed for s in r.shards) == sorted((r.doc_id, r.shard) for r in got)
    assert sum(r.taken for r in mixed) == sum(r["size"] for r in got) and [r.shard for r in got] == sorted(r.shard for r in got)
