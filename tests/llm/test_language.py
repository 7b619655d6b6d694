import numpy as np
import pytest

from finescale.llm import language
from tests.llm.common import HAVE, SF

EN, FR, DE = "the quick brown fox jumps over the lazy dog and ", "le renard brun saute par dessus le chien qui ", "der schnelle braune fuchs springt ueber den hund "
SCHEMA = "doc_id bigint, text string, lang string, score double, letter boolean"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0.1, True) for r in rows], SCHEMA)


def trained(spark):
    rows = [(i, t * 5, lang) for i in range(40) for t, lang in ((EN, "en"), (FR, "fr"), (DE, "de"))]
    return language.fit(docs(spark, [*rows, (1, None, "en"), (3, "zzz", None), (None, "qqq", "xx")]))


def test_predicts_mixtures(spark):
    model = trained(spark)
    assert model.languages == ("de", "en", "fr")
    rows = [(1, EN, None), (1, EN, None), (2, FR * 3 + EN, "de"), (3, EN * 2 + DE * 2, None), (4, None, "en"), (5, "", "en"), (6, "12 %% 7", "en"),
            (None, DE, None), (7, DE * 20_000, None), (8, "x", None)]
    got = language.predict(docs(spark, rows), model, "_").collect()
    assert len(got) == len(rows) and list(got[0].__fields__) == [*SCHEMA.replace(",", "").split()[::2], "_lang_pred", "_score", "_languages", "_proportions"]
    by = {r.doc_id: r for r in got}
    assert by[1]._lang_pred == "en" and by[1]._score > 0.9 and by[None]._lang_pred == by[7]._lang_pred == "de"
    assert by[2]._lang_pred == "fr" and set(by[2]._languages) == {"en", "fr"} and abs(dict(zip(by[2]._languages, by[2]._proportions))["fr"] - 0.75) < 0.1
    assert set(by[3]._languages) == {"en", "de"} and abs(by[3]._score - 0.5) < 0.1
    for k in (4, 5, 6):
        assert (by[k]._lang_pred, by[k]._score) == ("und", 0.0)
    assert by[8]._lang_pred in model.languages


def test_mixture_against_grid(spark):
    model = trained(spark)
    at, n = next(language.trigrams(language.plain(__import__("pyarrow").array([FR + EN])), 16))
    part, like = model.mixture(model.shares[at][:, 1:], n, 500)
    grid = max(float(n @ np.log(model.shares[at][:, 1:] @ [p, 1 - p])) for p in np.linspace(0.001, 0.999, 999))
    assert abs(part.sum() - 1) < 1e-9 and like >= grid - 0.5


def test_nothing_learned_and_empty(spark):
    model = language.fit(docs(spark, []))
    assert language.predict(docs(spark, [(1, EN, "en")]), model, "_").first()._lang_pred == "und"
    assert language.predict(docs(spark, []), trained(spark), "_").collect() == []


@pytest.mark.skipif(not HAVE, reason="driver tables absent")
def test_held_out_accuracy(spark):
    from finescale.llm.queries import op5_language_id
    sf = SF.replace("sf0.001", "sf0.1")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op5_language_id(spark, sf).filter("held_out").join(truth, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
