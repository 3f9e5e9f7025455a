"""The pipeline: columns, order, effect of each stage, and a plain version of what it decides."""

from __future__ import annotations

import corpus_pipeline
from helpers import SF
from tessella.llm import language, near_copies, packing, suffix_dedup, toxicity


def test_stages_work_on_what_was_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "repeats", "packing"]
    now, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns
        rows = {r.doc_id: r for r in after.collect()}
        kept.append((now, rows))
        now = spark.createDataFrame(list(rows.values()), docs.schema)
    before, rows = kept[0]
    assert set(rows) == {r.doc_id for r in toxicity.toxicity(before, labels).filter("predicted = 0").collect()}
    before, rows = kept[1]
    assert set(rows) == {r.doc_id for r in language.identify_language(before).filter("lang_pred != 'und' and score >= 0.5").collect()}
    before, rows = kept[2]
    assert set(rows) == {r.doc_id for r in near_copies.near_copies(before).filter("doc_id = component_id").collect()}
    before, rows = kept[3]
    cut = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(before).filter("n_bytes = 0 or n_removed < n_bytes").collect()}
    assert {i: r.text for i, r in rows.items()} == {i: b.decode(errors="ignore") for i, b in cut.items()}
    assert all(r.n_chars == len(r.text) for r in rows.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in packed.collect()} == set(rows)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_odd_rows_pass_every_stage(spark, odd, none):
    for df in (odd.select("doc_id", "text", "lang", "source", "n_chars"), none.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            if stage is corpus_pipeline.packing:  # every row is packed once
                assert sorted(str(r.doc_id) for r in out.collect() if r.piece == 0) == sorted(str(r.doc_id) for r in df.collect())
            else:  # filters: rows come out as they went in, but for what was cut out of a text
                assert out.columns == df.columns
                left = [(str(r.doc_id), r.lang, r.source) for r in out.collect()]
                whole = [(str(r.doc_id), r.lang, r.source) for r in df.collect()]
                assert all(left.count(x) <= whole.count(x) for x in left)
                assert stage is not corpus_pipeline.near_duplicates or ("None", "en", "s") in left or not whole


def test_packing_stage_uses_the_operator(spark, odd):
    packed = corpus_pipeline.packing(spark, odd, SF)
    assert packed.columns == packing.pack_documents(odd, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).columns
