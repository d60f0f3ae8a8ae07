"""Every stage of the pipeline against a plainer version on its own input, and all stages on edge tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
import public_tokenizers
from retailforge.llm.queries import ORACLE
from retailforge.session import stage
from tests.conftest import SF, spark  # noqa: F401


def oracle(df, name):
    """The SQL of a query over the rows that a stage gets."""
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    return con.execute(ORACLE[name]).fetchdf()


def test_stages_against_sql(spark):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(P.STAGES)
    got = stage(steps["language_id"](spark, docs, SF), "t1")
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}
    assert got.columns == columns and {r.doc_id for r in got.collect()} == lettered  # four well separated languages
    docs, got = got, stage(steps["line_dedup"](spark, got, SF), "t2")
    want = oracle(docs, "op7_line_dedup").set_index("doc_id")
    rows = got.withColumn("sha", F.sha2("text", 256)).collect()
    assert got.columns == columns and len(rows) == docs.count() and all(r.sha == want.kept_sha256[r.doc_id] for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows)
    docs, got = got, stage(steps["jaccard_join"](spark, got, SF), "t3")
    want = oracle(docs, "op4_jaccard_join")
    assert got.columns == columns and sorted(r.doc_id for r in got.collect()) == sorted(want.groupby("group_id").doc_id.min())
    docs, got = got, stage(steps["decontamination"](spark, got, SF), "t4")
    want = oracle(docs, "op2_decontamination")
    assert got.columns == columns and sorted(r.doc_id for r in got.collect()) == sorted(want[~want.contaminated].doc_id)
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = steps["best_fit_packing"](spark, got, SF).collect()
    sizes = {r.doc_id: len(tk.encode(r.text, add_special_tokens=False).ids) + 1 for r in got.collect()}
    by_doc, by_seq = {}, {}
    for r in packed:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc == sizes
    for pieces in by_seq.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 1024


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "some words of a text", "en", None, 1), (2, "", "en", "a", 0),
                                       (2, "", "en", "a", 0), (3, "some words of a text", "en", "a", None)]])
def test_stages_on_edge_tables(spark, rows):  # noqa: F811
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("own"))
    for name, step in P.STAGES:
        got = stage(step(spark, docs, SF), "t")
        assert name == "best_fit_packing" or got.columns == docs.columns
        if name != "best_fit_packing":
            got.count()
            docs = got
