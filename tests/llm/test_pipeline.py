import os

import public_tokenizers
from test_retrieval_packing import sound
from test_shingle_join import brute_kept
from test_suffix_dedup import brute
from tokenizers import Tokenizer

import corpus_pipeline
from unionlog.llm import decontamination, quality_rules
from unionlog.llm.common import cut


def test_stages_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], sf)))
        if name != "retrieval_packing":
            assert kept[-1].columns == columns and kept[-1].dtypes == docs.dtypes
    text = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]
    verdict = {r.doc_id: r.kept for r in quality_rules.op7_quality_rules(spark, sf).collect()}
    assert set(text[1]) == {d for d, k in verdict.items() if k}
    assert set(text[2]) == brute_kept(text[1])
    lost = brute(sorted((d, t.encode()) for d, t in text[2].items()))
    assert {d for d in text[2] if lost[d][1] == 0 or lost[d][1] < lost[d][0] - 20} <= set(text[3])
    for d, t in text[3].items():
        if lost[d][1] == 0:
            assert t == text[2][d]
        else:  # whole characters may stay at the ends of a span
            assert lost[d][0] - lost[d][1] <= len(t.encode()) <= lost[d][0] - lost[d][1] + 6 * lost[d][2]
    items = [decontamination.normalised(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {d for d, t in text[3].items() if any(i in decontamination.normalised(t) for i in items)}
    assert set(text[4]).isdisjoint(found) and len(set(text[3]) - set(text[4]) - found) <= 3
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 2] for d, t in text[4].items()}
    assert sound([tuple(r) for r in kept[-1].collect()], ids) == 0


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    """The whole pipeline on a null text and id, an empty text, rows that repeat, and on no rows at all."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "A few words of no document id. " * 3, "en", "s", 90)]
    docs = docs.limit(60).unionByName(docs.limit(60)).unionByName(spark.createDataFrame(odd, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    assert rows and not ids & {9001, 9002, None} and len({(r.doc_id, r.start) for r in rows}) == len(rows)
    empty = tmp_path / "none"
    empty.mkdir()
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        os.symlink(f"{sf}/{name}.parquet", empty / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
