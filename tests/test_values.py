import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomrow.config import Config, Service
from loomrow.functions import keys as K
from loomrow.functions.keys import Key, KeyBuilder


@given(st.dictionaries(st.text(min_size=1), st.one_of(st.integers(), st.text(), st.none(), st.booleans()), min_size=1))
def test_keys_survive_a_round_trip(values):
    key = Key("t", tuple(values), tuple(values.values()))
    assert Key.from_json(key.to_json()) == key and hash(Key.from_json(key.to_json())) == hash(key)


def test_keys():
    key = KeyBuilder("t").add("a", 1).add("b", "x").set("a", 2).build()
    assert str(key) == "{t: a -> 2, b -> x}" and key.get("a") == 2 and key.get("c") is None and "b" in key and len(key) == 2
    assert key.search_values(["b", "a"]) == ("x", 2) and key.partitioning("a") == Key.of("t", a=2) and key.partitioning() is key
    with pytest.raises(K.FieldNotFoundError):
        key.search_values(["c"])
    with pytest.raises(K.FieldNotFoundError):
        KeyBuilder("t").set("a", 1)
    with pytest.raises(ValueError):
        Key("t", ("a",), ())


def test_records_survive_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "test", 2, "two")], "i int, s string, f int, g string")
    df.write.parquet(f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").collect() == df.collect()


@pytest.mark.parametrize("x", [0.0, 1.23456, -1.23456, 12345.99999, 2.7, -0.00009])
def test_truncation_is_the_same_in_both_forms(spark, x):
    assert spark.range(1).select(K.truncate(F.lit(x))).first()[0] == K.truncated(x)


def test_printed_forms(spark):
    row = spark.createDataFrame([(1, "x", None)], "a int, b string, c string").select(K.key_text("t", {"a": "a", "b": "b"}), K.record_text("t", ["a"], ["b", "c"])).first()
    assert tuple(row) == ("{t: a -> 1, b -> x}", "t: {*a: 1, b: x, c: null}")


def test_config():
    c = Config.from_properties({"service": "3", "batch_size": "20", "imbalance_tolerance": "0.5", "caught_up": "false"})
    assert c.service is Service.FUSED_REBALANCED and c.batched and c.fused and c.imbalance_tolerance == 0.5 and not c.caught_up
    for bad in ({"service": "9"}, {"nothing": "1"}, {"caught_up": "maybe"}, {"chunk_by_bytes": "true"}, {"batch_size": "0"}):
        with pytest.raises(ValueError):
            Config.from_properties(bad)


def test_core_queries_stay_when_the_corpora_cannot_be_imported():
    import subprocess
    import sys

    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; n = e.queries(); print(len(n), 'plan_moves' in n, 'pipeline' in n)"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(said[0]) >= 70 and said[1:] == ["True", "False"], said
