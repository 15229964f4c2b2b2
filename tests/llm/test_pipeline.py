"""The stages in turn on the small tables."""

from __future__ import annotations

import corpus_pipeline
from freightlens.llm import decontaminate, minhash_dedup


def test_stages_filter_and_keep_columns(spark, root, tmp_path):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names, counts = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, root).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == names
    assert counts[0] < 200 + 1 and counts[1] <= counts[0] and counts[2] <= counts[1] and counts[3] >= counts[2] and counts[4] == counts[3]
    clean = spark.read.parquet(str(tmp_path / "decontamination"))
    assert minhash_dedup.groups(clean).where("NOT kept").count() == 0
    assert decontaminate.contaminated(clean, spark.read.parquet(f"{root}/benchmark.parquet")).count() == 0


def test_run_gives_the_last_stage(spark, root):
    assert corpus_pipeline.run(spark, root).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
