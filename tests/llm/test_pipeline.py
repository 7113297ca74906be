"""The pipeline's stages against plain Python on the smallest data."""

import corpus_pipeline
import pyarrow as pa
from ringtrace.llm import mixing, secretscan
from ringtrace.llm.shared import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, SF), "test-stage")
        made[name.split()[0]] = (before.collect(), docs.collect(), docs.columns)
    names = made["quality"][0][0].__fields__
    assert all(list(made[k][2]) == list(names) for k in ("quality", "SimHash", "secret", "mixing"))
    before, after, _ = made["quality"]
    kept = {r.doc_id for r in after}
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) / len(labels) > 0.9
    before, after, _ = made["SimHash"]
    assert {r.text for r in before} == {r.text for r in after} or len(after) < len(before)
    assert len({r.text for r in after}) == len(after)
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert {r.doc_id for r in after} <= set(first.values())
    before, after, _ = made["secret"]
    old = {r.doc_id: r.text for r in before}
    assert len(after) == len(before) and all(r.text == secretscan.redact_text(old[r.doc_id], 10.0, "[SECRET]") and not secretscan.base_spans(r.text) for r in after)
    before, after, _ = made["mixing"]
    want = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(before), whole_docs=True).collect() if r.size}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    before, after, columns = made["BPE"]
    assert len(after) == len(before) and {"doc_id", "n_tokens", "ids"} <= set(columns)
    assert sorted(corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()) == sorted((r.doc_id, r.ids_sha256) for r in after)


def test_stages_pass_small_batches(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'a b' AS text").coalesce(1)
    corpus_pipeline.bpe_encoding(spark, docs, SF)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 1000


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long, key string, bar string", "doc_id long, quality int, toxic int"


def run_on(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_empty_tables(spark, tmp_path):
    assert run_on(spark, tmp_path, [], []) == []


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "a", 0, "x", "y"), (2, None, "en", None, None, "x", "y"), (3, "same text of several words in a row here", "en", "b", 41, "x", "y")]
    rows += rows * 2 + [(None, "same text of several words in a row here", None, "b", None, None, None), (4, "q " * 200_000, "en", "c", 400_000, "x", "y")]
    got = run_on(spark, tmp_path, rows, [(None, None, None), (1, 1, 0), (3, 1, None)])
    assert {r.doc_id for r in got} <= {None, 1, 2, 3, 4} and all(r.n_tokens == len(r.ids) for r in got)
