"""The pipeline against a plain version of its stages."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_python import brute_components, check_packed

from loomgraph.llm import mixing, packing, quality_crf


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    results, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name.replace(' ', '-')}"
        out.write.mode("overwrite").parquet(path)
        at = spark.read.parquet(path)
        results[name] = at
        if name != "pack":
            assert at.columns == docs.columns

    kept = {r.doc_id for r in results["quality"].collect()}
    assert kept == {r.doc_id for r in quality_crf.classify_documents(docs, labels).collect() if r.predicted}

    last = defaultdict(int)
    for i in kept:
        last[text[i]] = max(last[text[i]], i)
    distinct = {r.doc_id for r in results["exact copies"].collect()}
    assert distinct == set(last.values())

    rows = sorted((i, text[i]) for i in distinct)
    single = {c for _, _, c in brute_components(rows, 5, 80)}
    assert {r.doc_id for r in results["near copies"].collect()} == single

    copies = defaultdict(int)
    for r in results["mix"].collect():
        copies[r.doc_id] += 1
    want = {r.doc_id: r.copies for r in mixing.mix_documents(results["near copies"], corpus_pipeline.SEED).collect() if r.copies}
    assert dict(copies) == want

    encoder = packing.WordEncoder(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    total = sum(n * (len(encoder.encode([text[i]])[0]) // 4 + 1) for i, n in copies.items())
    packed = results["pack"].collect()
    assert sum(r.length for r in packed) == total
    assert check_packed(packed) <= -(-total // 2048) + 2


ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n", None, "a", 2), (None, "one two", "en", "b", 7), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7), (5, "A plain line of words. " * 4000, "en", "a", None)]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_names(spark, sf, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit("clash") for c in ("row", "size", "h", "__row", "__key", "__skey", "digest", "at", "n", "score", "length", "a`b")}
    df = spark.createDataFrame(ODD, schema).withColumns(clash)
    out = stage(spark, df, sf)
    if stage is corpus_pipeline.pack:
        rows = out.collect()
        assert sorted((r.doc_id or 0) for r in rows if not r.piece) == [0, 1, 2, 3, 4, 4, 5]
        check_packed(rows)
    else:
        assert out.columns == df.columns
        rows = out.collect()
        assert {tuple(r)[:5] for r in rows} <= set(ODD) and all(tuple(r)[5:] == ("clash",) * len(clash) for r in rows)
    if stage is corpus_pipeline.exact_copies:
        assert sorted((r.doc_id, r.text or "") for r in rows) == [(2, ""), (3, " \n"), (4, "one two"), (5, ODD[-1][1])]
    if stage is corpus_pipeline.near_copies:
        assert Counter(r.text for r in rows)["one two"] == 1 and {r.doc_id for r in rows} == {1, 2, 3, 4, 5}
    assert stage(spark, df.limit(0), sf).count() == 0


def test_run_gives_the_last_stages_columns(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
