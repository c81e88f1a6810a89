from collections import Counter

import corpus_pipeline
import public_tokenizers

import __spark_entry__
from folioforge.llm import segment

from .test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_last_one_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.stage_table(stage(spark, seen[-1], SF), "test"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[-1].columns == columns, name
    kept = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(kept, kept[1:])) and 0 < len(kept[-1])
    before = [(r.doc_id, r.text) for r in seen[2].select("doc_id", "text").collect()]
    assert kept[3] == {i for i, (_, _, own) in brute(before).items() if own}
    assert Counter(Counter(r.doc_id for r in seen[4].collect()).values()).keys() <= {1, 2}
    own = segment.segmenter(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in seen[4].collect()}
    for r in seen[5].collect():
        assert "".join(own.raw[i].decode("utf-8", "surrogateescape") for i in r.ids)[1:] == texts[r.doc_id] or any(i in own.bytes.values() for i in r.ids)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.score) for r in whole.collect()) == sorted((r.doc_id, r.score) for r in seen[5].collect())


def test_awkward_documents_pass_through_every_stage(spark, docs, empty):
    for df in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.stage_table(stage(spark, df, SF), "test")
        assert df.count() >= 0


def test_entry_registers_all():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
