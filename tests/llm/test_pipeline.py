"""The pipeline's stages, each against plain Python on its own input."""

import os
import random

import pytest
from docloom.llm.queries import ORACLES, QUERIES

from tests.llm.test_exact_and_mixing import WORD, low
from tests.llm.test_near_dedup import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def corpus():
    draw = random.Random(11)
    words = {"en": "the and house with water that tree over stone river hill".split(), "fr": "les dans maison avec été eau arbre où pierre colline".split()}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join(draw.choice(words[lang]) + str(draw.randrange(9)) for _ in range(draw.randrange(20, 90))), lang, f"s{i % 4}", i))
    rows += [(200, rows[0][1].upper(), "fr", "s1", 0), (201, rows[1][1] + " more", "en", None, 0), (202, None, "en", "s0", None), (203, "12 34", None, "s0", 5), (204, "", "en", "s0", 0)]
    return rows


def test_stages(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(corpus(), columns)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.columns == docs.columns
        rows = after.collect()
        if name == "language":
            assert {r.doc_id for r in rows} == {i for i, r in before.items() if r.text and any(c.isalpha() for c in r.text)}
        elif name == "exact_copies":
            best = {}
            for i, r in before.items():
                best[low(r.text)] = max(i, best.get(low(r.text), i))
            assert sorted(r.doc_id for r in rows) == sorted(best.values())
        elif name == "near_copies":
            expected = brute([(i, r.text) for i, r in before.items()], 0.8)
            assert {r.doc_id for r in rows} == {i for i, (_, c) in expected.items() if i == c}
        elif name == "source_mix":
            total, taken = sum(len(WORD.findall(r.text)) for r in before.values()), sum(len(WORD.findall(r.text)) for r in rows)
            assert abs(taken - 1.5 * total) <= 64 * 5
        else:
            assert sum(1 for r in rows if r.start == 0) == len(before)
        docs = after


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_run(spark):
    import duckdb

    sql = duckdb.connect()
    sql.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_quality_rules", "op2_quality", "op5_exact_dedup", "op6_toxicity", "op7_minhash", "op8_mixing", "op9_token_files", "op10_language"):
        df = QUERIES[name](spark, SF)
        rows = df.collect()
        assert len(rows) == n and len({r.doc_id for r in rows}) == n, name
        if name in ORACLES:
            expected = sql.sql(ORACLES[name])
            at = [expected.columns.index(c) for c in df.columns]
            assert sorted(map(tuple, rows)) == sorted(tuple(r[i] for i in at) for r in expected.fetchall())
