"""The pipeline's stages against brute force on their own inputs, and the registered queries."""

import random

import brute
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from wayloom.llm import lines, pieces, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.cache())]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stage(spark, out[-1][1], SF).cache()))
    return dict(out)


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_queries_are_registered():
    names = set(entry_module.queries())
    assert set(queries.queries()) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))


def test_stages_return_the_columns_of_documents(stages):
    columns = stages["documents"].columns
    assert all(df.columns == columns for df in list(stages.values())[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {d for d, _ in rows(stages["toxicity"])}
    right = [(d in kept) == (not y) for d, y in labels.items() if d in {d for d, _ in rows(stages["documents"])}]
    assert sum(right) >= 0.95 * len(right)


def test_lines(stages):
    source = {r.doc_id: (r.source, r.text) for r in stages["toxicity"].collect()}
    order = list(source)
    want = dict(zip(order, brute.boilerplate([source[d] for d in order], lines.RATIO, lines.MIN_PAGES)))
    got = {r.doc_id: (r.text, r.n_chars) for r in stages["line_dedup"].collect()}
    assert got == {d: (w[2], len(w[2])) for d, w in want.items()}


def test_copies_of_a_third_of_a_source_leave_one_text(spark):
    body = "\n".join(f"line {k} of the text that was copied" for k in range(8))
    table = [(i, body if i % 3 == 0 else f"menu\nnothing but number {i} is told here", "s" if i < 60 else None) for i in range(120)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang", "0L AS n_chars")
    cleaned = corpus_pipeline.without_boilerplate(spark, docs, SF)
    assert {t for d, t in rows(cleaned) if d % 3 == 0} == {body}
    assert {t for d, t in rows(cleaned) if d % 3} == {f"nothing but number {i} is told here" for i in range(120) if i % 3}
    kept = rows(corpus_pipeline.without_near_duplicates(spark, cleaned, SF))
    assert [t for d, t in kept if d % 3 == 0] == [body] and all(t for _, t in kept)


def test_one_of_each_group_stays(stages):
    of = brute.jaccard(rows(stages["line_dedup"]))
    assert {d for d, _ in rows(stages["jaccard_join"])} == {d for d, (_, c) in of.items() if d == c}


def test_leaks_go(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {d for d, _ in rows(stages["decontamination"])}
    leaked = {d for d, t in rows(stages["jaccard_join"]) if any(i in t for i in items)}
    before = {d for d, _ in rows(stages["jaccard_join"])}
    assert leaked and not leaked & kept and len(before - kept - leaked) <= 0.01 * len(before)


def test_tokens(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = {}
    for r in stages["sentencepiece"].orderBy("doc_id", "chunk").collect():
        ids.setdefault(r.doc_id, []).extend(r.ids)
        assert r.round_trip
    assert ids == {d: library.encode(t) for d, t in rows(stages["decontamination"])}


def test_run_equals_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "chunk", F.xxhash64("ids")).collect()
    assert sorted(got) == sorted(stages["sentencepiece"].select("doc_id", "chunk", F.xxhash64("ids")).collect())


def test_odd_tables_pass_through(spark, tmp_path):
    rng = random.Random(2)
    table = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (1, "", "en", "s", 0, 2), (2, None, None, "s", None, 3)]
    table += [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(400)), "en", "s", 5, i) for i in range(3, 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
    for name, df in {
        "labels": spark.createDataFrame([(3, 1, None), (None, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(None, "x y"), (1, None)], "item_id long, text string"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    for some in (table, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "sentencepiece":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
                assert {r.score for r in docs.collect()} <= {t[5] for t in some}
        # The two rows with id 1 are one document.
        assert docs.count() == len(some)


def test_stages_send_batches_of_bounded_bytes(spark):
    # With Spark's count of rows alone a batch held all of these 12 MB.
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    def stage(_, docs, __):
        return docs.mapInArrow(sizes, "n long")

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    assert all(hasattr(s, "__wrapped__") for _, s in corpus_pipeline.STAGES)
    try:
        docs = spark.range(120, numPartitions=1).selectExpr("repeat('abcdefghij', 10000 + CAST(id AS INT)) AS text")
        got = [r.n for r in corpus_pipeline._small_batches(stage)(spark, docs, "").collect()]
        assert len(got) > 1 and max(got) < 9 << 20 and sum(got) >= 12_000_000
    finally:
        spark.conf.set(name, before)
