"""The pipeline on the given documents and on planted rows, each stage by its own effect."""

import corpus_pipeline as p
from conftest import SF001, SF01
from llm.frames import DOCS, docs, prose

from cordon.llm import jaccard_join, mixing, pii
from cordon.llm.tables import read, written


def test_stages_and_columns(spark):
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_copies", "decontamination", "personal_data", "mixing"]
    d = read(spark, SF01, "documents")
    for name, stage in p.STAGES:
        out = written(stage(spark, d, SF01), name)
        assert out.columns == (d.columns if name != "mixing" else [*d.columns, "copy"])
        before = {r.doc_id for r in d.select("doc_id").collect()}
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before
        if name == "near_copies":
            found = jaccard_join.jaccard_components(d, size=5, percent=80).collect()
            assert after == {r.component_id for r in found}
        if name == "decontamination":
            bench = [r.text.lower() for r in read(spark, SF01, "benchmark").collect()]
            texts = {r.doc_id: r.text.lower() for r in d.collect()}
            assert before - after == {i for i, t in texts.items() if any(b in t for b in bench)}
        if name == "personal_data":
            assert after == before
            assert all(not pii.base_spans(r.text) for r in out.collect())
        if name == "mixing":
            want = {r.doc_id: r._copies for r in mixing.copies(d).collect() if r._copies}
            got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
            assert got == want
        d = out


def test_planted_rows(spark, tmp_path):
    bench = prose(1, 40)
    rows = [(k, prose(100 + k, 80)) for k in range(30)]
    rows += [(40, rows[0][1] + " tail"), (41, rows[1][1]), (42, prose(7, 50) + " " + bench), (43, prose(8, 50) + " mail me at a@b.cc now"), (44, None), (44, None), (None, "lone"), (45, "")]
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    d = docs(spark, rows)
    for _, stage in p.STAGES[:4]:
        d = written(stage(spark, d, str(tmp_path)), "step")
    got = sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    kept = [r for r in rows if r[0] not in (40, 41, 42, 43)] + [(43, prose(8, 50) + " mail me at [EMAIL] now")]
    assert got == sorted(kept, key=str)


def test_run_and_empty_documents(spark, tmp_path):
    out = p.run(spark, SF001)
    assert out.count() > 0 and out.columns[-1] == "copy"
    for name in ("benchmark", "labels"):
        read(spark, SF001, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
