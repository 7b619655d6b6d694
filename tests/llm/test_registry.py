"""Queries with SQL against DuckDB, the pipeline against its operators, and what the contracts fix."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import duck, rows_of
from finescale.llm import decontaminate, language, neardup, quality
from tests.llm.common import HAVE, SF

pytestmark = pytest.mark.skipif(not HAVE, reason="driver tables absent")


def test_one_query_per_operator():
    names = list(entry.LLM_QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]
    assert set(entry.LLM_SQL) <= set(names)


@pytest.mark.parametrize("name", sorted(entry.LLM_SQL))
def test_equals_sql(spark, name):
    sf = SF.replace("sf0.001", "sf0.01")
    df = entry.LLM_QUERIES[name](spark, sf)
    cur = duck(sf).execute(entry.LLM_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_columns(spark):
    want = {"op3": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
            "op5": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
            "op6": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
            "op7": {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")},
            "op8": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
            "op10": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
            "op11": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
            "op12": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
            "op13": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
                     "base_failed": "boolean", "kept": "boolean"}}
    for name, query in entry.LLM_QUERIES.items():
        if (short := name.split("_")[0]) in want:
            assert want[short].items() <= dict(query(spark, SF).dtypes).items(), name


def test_pipeline_keeps_what_its_operators_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = docs.join(quality.score(docs.select("doc_id", "text"), model).filter("score >= 0.7").select("doc_id"), "doc_id").select(docs.columns)
    found = language.predict(good.select("doc_id", "text"), language.fit(good)).filter("lang_pred <> 'und' AND score >= 0.5 * array_max(proportions)")
    known = good.join(found.select("doc_id"), "doc_id").select(docs.columns).cache()
    first = known.join(neardup.groups(known).filter("is_first").select("doc_id"), "doc_id").select(docs.columns).cache()
    bad = {r.doc_id for r in decontaminate.contaminated(first, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in rows} == {r.doc_id for r in first.select("doc_id").collect()} - bad
    assert 0 < len({r.doc_id for r in rows}) < docs.count()


def test_documents_in_several_languages_stay(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    some = {x: docs.filter((F.col("lang") == x) & F.col("text").rlike("^[^#*$%&|<>!]{1200}")).orderBy("doc_id").limit(3).collect() for x in ("de", "en", "es", "fr")}
    mixed = spark.createDataFrame([(10_000_000 + 10 * n + k, " ".join(some[x][k].text[:1200] for x in ("de", "en", "es", "fr")[:n]), None, "s", 1) for n in (3, 4) for k in range(3)],
                                  docs.schema)
    kept = corpus_pipeline.known_language(spark, docs.unionByName(mixed), "").filter("doc_id >= 10000000")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in mixed.collect())


def test_stages_take_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, doc bigint, digest string"
    body = "The river of the old town runs quietly by the mill and the people like it there. "
    rows = [(i, f"{body * (i % 5 + 1)} {i} {i * 7} {i * 11} end of {i}.", "en", "s", 1, 0.1, 2, "d") for i in range(40)]
    rows += [(None, body, None, None, None, None, None, None), (3, rows[3][1], "en", "s", 1, 0.1, 2, "d"), (90, None, None, None, None, None, None, None),
             (91, "", "en", "s", 0, 0.1, 2, "d"), (92, body * 5000, "en", "s", 0, 0.1, 2, "d")]
    for name, kind, more in (("labels", "doc_id bigint, quality int, toxic int", [(i, 1, 0) for i in range(40)]),
                             ("benchmark", "item_id bigint, text string", [(1, None), (2, "none of the words of this item stand anywhere else at all")])):
        spark.createDataFrame(more, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, str(tmp_path))
            assert kept.columns == docs.columns, name
            kept = kept.collect()
            if given:
                assert {92, 7} <= {r.doc_id for r in kept} and sum(r.doc_id == 3 for r in kept) == (1 if "dedup" in name else 2), name
                assert (90 in {r.doc_id for r in kept}) == (name != "language ID"), name
            else:
                assert kept == []
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0) == bool(given)
