"""The pipeline's stages on small tables, each against what its operator says."""

import random

import corpus_pipeline
import pyarrow as pa
import pytest
import xxhash

from sievework.llm import langid, near_dedup

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "123 !", "en", "s", 5), (900_003, docs.first().text, "en", "s", 0)], docs.schema)
    docs = docs.union(extra)
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
        docs = out
        counts.append(docs.count())
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not ids & {900_001, 900_002}
    assert docs.select("text").distinct().count() == docs.count() and counts[-1] < counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == ids


@pytest.mark.parametrize("sent", [corpus_pipeline.MOST_SENT, 0])
def test_null_and_repeated_doc_ids(spark, monkeypatch, sent):
    monkeypatch.setattr(corpus_pipeline, "MOST_SENT", sent)
    rnd = random.Random(22)
    a, b, c, d = (" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(4))
    near = a.rsplit(" ", 1)[0] + " end"
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(k, t, "x") for k, t in [(None, b), (None, b), (1, a), (1, a), (3, a), (3, c), (2, c), (4, c), (None, c), (None, d)]], schema)
    exact = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()), key=str)
    assert exact == sorted([(None, b), (3, a), (4, c), (None, d)], key=str)
    docs = spark.createDataFrame([(k, t, "x") for k, t in [(None, b), (None, b), (5, a), (5, near), (None, near), (5, d), (6, c), (6, None)]], schema)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=str)
    assert len(got) == 5 and got[-1] == (None, b) and {(5, d), (6, c), (6, None)} < set(got) and sum(t in (a, near) for _, t in got) == 1


def test_run_is_registered(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert "pipeline" in queries and all(any(n.startswith(f"op{i}_") for n in queries) for i in range(1, 11))
    assert queries["pipeline"](spark, SF).count() > 0


def test_kept_text_goes_to_the_workers_once(spark):
    """Twice filled an executor beyond its memory."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = langid.train(docs)
    by_key = langid.predict(docs, model)
    kept = langid.predict(docs, model, keep=("lang", "text"))
    joined = sorted((r.doc_id, r.lang, r.text, p.lang_pred, p.score) for r in docs.collect() for p in by_key.collect() if p.doc_id == r.doc_id)
    assert sorted(map(tuple, kept.collect())) == joined
    sent = kept._jdf.queryExecution().optimizedPlan().children().head().output()
    assert sent.size() == 3
    odd = spark.createDataFrame([(1, None), (2, ""), (3, docs.first().text)], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(odd, model, keep=("text",)).orderBy("doc_id").collect()] == [True, True, False]


def test_text_goes_to_the_workers_in_small_batches(spark):
    """A whole partition's text at once, beside the executor's heap, went beyond its memory in near_dedup."""
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 400), i -> hash(i, id))) AS text", "'x' AS lang").cache()
    longest = docs.selectExpr("max(octet_length(text))").first()[0]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_copies, corpus_pipeline.pack_sequences):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(50), SF)
        most = docs.select("doc_id", "text").mapInArrow(sizes, "bytes long").selectExpr("max(bytes)").first()[0]
        assert longest < most < (2 << 20) + 2 * longest


def test_few_word_hashes_are_kept():
    memo = near_dedup.WordHashes()
    words = [b"%d" % i for i in range(120_000)]
    assert [memo[w] for w in words] == [xxhash.xxh3_64_intdigest(w) for w in words] and len(memo) <= 50_000
