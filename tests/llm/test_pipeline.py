from __future__ import annotations

import re

import __spark_entry__ as entry
import corpus_pipeline
from postmill.llm import mixing, toxicity
from postmill.llm.secrets import secret_spans
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.01"


def test_stages_hold_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
        assert name == "packing" or docs.columns == columns
    assert list(seen) == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]

    before, after = seen["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(before, model).filter("predicted = 1").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert toxic and ids(after) == ids(before) - toxic

    before, after = seen["near_duplicates"]
    groups = brute([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == {d for d, (_, c) in groups.items() if c == d} != ids(before)

    before, after = seen["secrets"]
    old, new = ({r.doc_id: r for r in df.collect()} for df in (before, after))
    assert set(old) == set(new) and all(len(r.text) == r.n_chars for r in new.values())
    changed = {d for d in old if old[d].text != new[d].text}
    assert changed == {d for d, r in old.items() if secret_spans(r.text)} != set()
    assert not any(re.search("AKIA[A-Z0-9]{12}", r.text) for r in new.values())

    before, after = seen["mixing"]
    assert ids(after) == {r[0] for r in mixing.mix_documents(before).select("doc.doc_id").collect()} < ids(before)

    before, after = seen["packing"]
    assert ids(after) == ids(before) and after.agg({"length": "max"}).first()[0] == 1024


def test_it_is_registered_and_runs(spark):
    assert entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0


def test_odd_tables_pass(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long"
    rows = [(1, None, "en", "s", None, 1), (2, "", None, None, 0, 2), (3, "one two three four five six", "en", "s", 27, 3), (3, "one two three four five six", "en", "s", 27, 3), (None, "token=abcdefgh1", "en", "s", 15, 4)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert name == "packing" or docs.columns == table.columns
        docs.count()
