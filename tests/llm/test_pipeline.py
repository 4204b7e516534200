"""The pipeline's stages take effect, keep clean documents and return the columns of documents."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, SF).cache()
        assert left.columns == docs.columns and left.count() <= before.count(), name
        assert left.join(docs, ["doc_id", "text"], "left_semi").count() == left.count(), name
        if name == "toxicity":
            assert docs.count() - left.count() <= 2 * len(toxic) + 10
    texts = [r.text for r in left.collect()]
    assert len(texts) == len(set(texts)) > docs.count() // 2
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert packed["doc_id"].nunique() == len(texts) and packed.groupby("sequence_id")["length"].sum().max() <= 4096


def test_entry_registers_all():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 14)) and "pipeline" in names
    assert None not in entry.oracle_sql().values()


def test_toxicity_training_holds_nothing_of_earlier_stages():
    """The token coder of a stage before goes first, and texts are taken in small parts that change no features."""
    import numpy as np
    import pyarrow as pa

    from placegrid.llm import common, toxicity

    common.held(("an earlier operator",), lambda: [0])
    texts = [f"w{k} " * 40_000 for k in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20, dtype=np.int32)), pa.array(texts)], names=["label", "text"])
    parts = list(toxicity._example_rows([batch]))
    assert not common._held and len(parts) > 2
    assert [r for p in parts for r in p.column(1).to_pylist()] == [np.unique(toxicity.features(pa.array([t]))[0]).tolist() for t in texts]
