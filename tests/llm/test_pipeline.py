"""The corpus pipeline over the smallest tables, stage by stage."""

import re

import corpus_pipeline
from tracklake.llm.queries import word_bpe_path


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for nr, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / f"{nr}"))
        docs = spark.read.parquet(str(tmp_path / f"{nr}"))
        if nr < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            counts.append(docs.count())
    assert before >= counts[0] >= counts[1] >= counts[2] == counts[3] > 0.5 * before
    masked = spark.read.parquet(str(tmp_path / "3")).collect()
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|@mail[0-9]", r["text"] or "") for r in masked)
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
    assert word_bpe_path().endswith(".json")


def test_stages_of_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_stages_on_hard_rows(spark, docs, small, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns: every stage against a plain version."""
    from tracklake.llm import decontaminate, pii
    from tracklake.llm.common import table
    from tracklake.llm.queries import toxicity_model

    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "")
    state = docs
    for nr, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(state.select("doc_id", "text").collect(), key=key)
        stage(spark, state, small).write.parquet(str(tmp_path / f"{nr}"))
        out = spark.read.parquet(str(tmp_path / f"{nr}"))
        if name != "packing":
            assert out.columns == docs.columns
            after = sorted((tuple(r) for r in out.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
        if name == "toxicity":
            scorer = toxicity_model(spark, small).scorer()
            assert after == [tuple(r) for r in before if scorer.score(r["text"]) < 0.3]
        elif name == "near_duplicates":
            sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in ((r["text"] or "").lower().split() for r in before)]
            root = list(range(len(sets)))
            for i, a in enumerate(sets):
                for j in range(i):
                    if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                        root = [root[j] if x == root[i] else x for x in root]
            assert len(after) == len(set(root))
        elif name == "decontamination":
            hits = decontaminate.find_hits(state, table(spark, small, "benchmark")).where("n_hit > 0").count()
            assert len(after) == len(before) - hits
        elif name == "personal_data":
            crf = pii.train()
            found = pii.all_spans([r["text"] for r in before], crf)
            plain = [(r["doc_id"], r["text"] if r["text"] is None else pii.mask(r["text"], spans)) for r, (_, spans) in zip(before, found)]
            assert after == sorted(plain, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
        else:
            pieces = out.toPandas()
            assert set(pieces["doc_id"].dropna()) == {r["doc_id"] for r in before if r["doc_id"] is not None}
            assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048
        state = out
