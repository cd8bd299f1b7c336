from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from sonalyt.llm import lines, mixing, packing, quality, simhash
from sonalyt.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    labels = table(spark, SF, "labels")
    good = {r.doc_id for r in quality.quality(docs, labels).where("predicted = 1").collect()}
    docs = stored(corpus_pipeline.STAGES[0][1](spark, docs, SF))
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == good and len(good) < len(before)
    gone = {r.doc_id: set(r.gone) for r in lines.aligned_lines(docs).collect()}
    after = stored(corpus_pipeline.STAGES[1][1](spark, docs, SF))
    for r in after.collect():
        assert r.text == "\n".join(x for i, x in enumerate(before[r.doc_id].text.split("\n")) if i not in gone.get(r.doc_id, ())) and r.n_chars == len(r.text)
    comps = {r.doc_id: r.component_id for r in simhash.near_copies(after).collect()}
    one = stored(corpus_pipeline.STAGES[2][1](spark, after, SF))
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(comps.values()))
    often = {r.doc_id: r.copies for r in mixing.mix(one, mixing.languages(one, labels), keep_all=True).collect()}
    mixed = stored(corpus_pipeline.STAGES[3][1](spark, one, SF))
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == often and min(often.values()) >= 1
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    assert packed.count() == packing.cut_up(mixed).count()


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "mixing", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_any_table(spark, docs, nothing, rows):
    for x in ("good_doc", "aligned_doc", "aligned_gone", "aligned_left", "mixed_doc", "mixed_times", "mixed_copy", "GOOD_DOC_"):
        docs = docs.withColumn(x, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, nothing):
            got = stored(stage(spark, df, SF))
            assert got.columns == df.columns and got.count() >= 0
        some = stage(spark, docs, SF).collect()
        assert {r.doc_id for r in some} <= {r[0] for r in rows} and all(r.good_doc == r.mixed_copy == r.aligned_gone == "clash" for r in some)
        assert some or name == "quality"  # labels of other texts say nothing of these
    assert corpus_pipeline.STAGES[4][1](spark, nothing, SF).count() == 0 and corpus_pipeline.STAGES[4][1](spark, docs, SF).count() >= len(rows)
