import pytest

from palimpsest.functions import checksums
from palimpsest.operators.resolve import sanitize
from palimpsest.plans import config
from palimpsest.sources import fixtures, jsonleaves
from pyspark.sql import functions as F


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("PALIMPSEST_TEST", "7")
    assert config.load(tmp_path / "none.yaml") == config.DEFAULTS
    path = tmp_path / "a.yaml"
    path.write_text("text:\n  chunk_size: ${PALIMPSEST_TEST}\nimage:\n  classes: [face]\nextra: {a: ['${NO_SUCH_NAME}']}\n")
    told = config.load(path)
    assert told["text"]["chunk_size"] == "7" and told["text"]["detector"] == "rules" and told["image"]["classes"] == ["face"] and told["extra"] == {"a": [""]}
    assert config.load(path, "output") == config.DEFAULTS["output"] and config.DEFAULTS["image"]["classes"] == []
    path.write_text("")
    assert config.load(path) == config.DEFAULTS
    with pytest.raises(FileNotFoundError):
        config.models(tmp_path / "none.yaml")
    path.write_text("default: m\nmodels:\n  m: {key: '${PALIMPSEST_TEST}'}\n")
    assert config.models(path) == {"key": "7"}
    with pytest.raises(ValueError):
        config.models(path, "n")


def test_made_up_people_are_valid_and_the_same_each_time(spark):
    p = fixtures.people(spark, 50)
    good = checksums.id_valid(F.col("id_number")) & checksums.credit_valid(F.col("credit_code"))
    assert p.filter(good).count() == 50 and p.collect() == fixtures.people(spark, 50).collect()
    docs = fixtures.people_json(spark, 5)
    edits = sanitize(jsonleaves.leaves(docs)).filter(F.size("spans") > 0)
    found = edits.select(F.explode("spans.field_type").alias("f")).groupBy("f").count().collect()
    assert {r.f: r["count"] for r in found}["phone"] == 15 and {r.f: r["count"] for r in found}["id_card"] == 5


def test_units_have_keys_too(spark):
    df = spark.createDataFrame([(1, '{"13812345678": {"a": "x"}, "b": [{"a": 1}]}')], "doc_id int, json string")
    got = sorted((r.place, r.text) for r in jsonleaves.units(df).collect())
    assert got == [("$.13812345678.a", "13812345678"), ("$.13812345678.a", "a"), ("$.13812345678.a", "x"), ("$.b[0].a", "1"), ("$.b[0].a", "b")]
