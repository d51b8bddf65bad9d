"""The pipeline's stages on a small corpus, and all registered queries on the smallest tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_return_documents_columns(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    packed = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.where("n > 4096").count() == 0 and docs.select("doc_id").distinct().count() == before.count()


def test_ten_operators_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op1_warc", "op4_exact_top_k"])
def test_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    mine = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert mine == sorted(map(tuple, cursor.fetchall()), key=repr)


def odd_corpus(spark):
    """Null ids and texts, an empty and a very long text, repeated rows, unlike texts of one id, and clashing names."""
    draw = np.random.default_rng(12)

    def text(n):
        return " ".join(f"plain{i}" for i in draw.integers(0, 4000, n))

    long, passage = text(30_000), text(60)
    texts = {1: text(80), 3: None, 4: "", 5: long, 6: long + " end", 7: text(70) + " " + passage, 8: text(70) + " " + passage + " " + text(30), 9: "日" * 5000}
    rows = [(i, t) for i, t in texts.items()]
    rows += [(1, texts[1]), (1, text(90)), (None, texts[1]), (None, None), (2, texts[1])]
    names = ["row", "kept", "runs", "score", "expected_grade", "tail_probability", "n_bytes", "n_removed", "digest", "text_key", "component_id", "own", "at", "_row_file", "file"]
    made = [(i, t, "en", "s", len(t or ""), *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(rows)]
    columns = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame(made, columns).repartition(3), names


def test_stages_on_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, names = odd_corpus(spark)
    spark.createDataFrame([(1, 1, 0), (7, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r["row"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0, name
        got = stage(spark, docs, str(tmp_path))
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in before.values()}
            continue
        assert got.dtypes == docs.dtypes
        rows = got.collect()
        for r in rows:
            own = before[r["row"]]
            assert all(r[c] == own[c] for c in ["doc_id", "lang", "source", *names])
            assert name == "substring_dedup" or r["text"] == own["text"]
        if name in ("quality_classifier", "toxicity", "substring_dedup"):
            assert len(rows) == len(before)
        if name == "substring_dedup":
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
            at = {r["row"]: r["text"] for r in rows}
            gone = [k for k, r in before.items() if r["text"] is not None and at[k] != r["text"]]
            assert {before[k]["doc_id"] for k in gone} >= {6, 8, 2, None} and 7 not in {before[k]["doc_id"] for k in gone}
        if name == "minhash_near_dedup":
            # 1 and its copy of id 2 are one, 1's other text and rows without an id stay
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, i) for i in (1, 1, 3, 4, 5, 7, 8, 9)] + [(True, 0)] * 2
