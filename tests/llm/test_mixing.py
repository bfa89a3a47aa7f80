from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from harness.check import canon
from postmill.llm.mixing import MIXING_SQL, mix_documents, op3_mixing, probabilities, rake

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(MIXING_SQL).df()
    got = op3_mixing(spark, SF).toPandas()
    assert len(got) > 20 and canon(got) == canon(want)


def test_margins_meet_their_targets_and_tokens_their_share(spark):
    cells = spark.createDataFrame([(s, lang, t, 10 + 97 * i * (s == "a") + 7 * j + 3 * k) for i, s in enumerate("abc") for j, lang in enumerate(["x", "y"]) for k, t in enumerate("pq")], "source string, lang string, topic string, tokens long")
    raked = rake(cells, {"source": 0.5, "lang": 0.0, "topic": 0.5}, 50)
    total = cells.agg(F.sum("tokens")).first()[0]
    assert {round(r[1] / total, 6) for r in raked.groupBy("lang").agg(F.sum("weight")).collect()} == {0.5}
    masses = {r[0]: r[1] ** 0.5 for r in cells.groupBy("source").agg(F.sum("tokens")).collect()}
    for r in raked.groupBy("source").agg(F.sum("weight").alias("w")).collect():
        assert r.w / total == pytest.approx(masses[r.source] / sum(masses.values()), abs=1e-6)
    for share in (0.3, 0.9):
        p = probabilities(raked, share).selectExpr("sum(tokens * probability)", "max(probability)").first()
        assert p[0] == pytest.approx(share * total) and p[1] <= 1


def test_odd_rows(spark):
    rows = [(i, f"word {i % 7} " * (i % 5), "s" if i % 3 else None, "en" if i % 2 else None, i) for i in range(300)]
    rows += [(None, "no id", "s", "en", 1), (7, None, "s", None, 2), (1, rows[1][1], "s", "en", 3), (8, "", None, "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight int")
    got = mix_documents(docs, share=0.6)
    assert 0 < got.count() < docs.count() and got.select("doc.weight", "weight").columns == ["weight", "weight"]
    assert mix_documents(docs.limit(0)).count() == 0
    all_taken = mix_documents(docs, {"source": 1.0, "lang": 1.0, "topic": 1.0}, share=1.0)
    assert all_taken.filter("n_tokens > 0").count() == docs.filter("length(trim(text)) > 0").count()
