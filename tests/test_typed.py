import pytest
from pyspark.sql import functions as F

from palimpsest.functions.typed import KINDS, openapi_schema, typed

over5 = typed("Over5", "int", lambda v: v > 5)
long_text = typed("LongText", "string", lambda v: F.length(v) > 5)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize("text,ok,value", [("6", True, 6), ("5", False, 0), ("x", False, 0), ("6.5", False, 0), (" 7 ", True, 7), (None, False, 0), ("99999999999", False, 0)])
def test_try_parse_int(spark, text, ok, value):
    r = one(spark, over5.try_parse(F.col("a")), a=text)
    assert (r.ok, r.value) == (ok, value)


def test_parse_and_construct_raise(spark):
    assert one(spark, over5.parse(F.col("a")), a="6") == 6
    for bad in (over5.parse(F.lit("5")), over5.construct(F.lit(5)), over5.parse(F.lit("x"))):
        with pytest.raises(Exception, match="not valid for Over5"):
            spark.range(1).select(bad).collect()


def test_strings(spark):
    assert one(spark, long_text.try_parse(F.col("a")), a="123456").value == "123456" and not one(spark, long_text.try_parse(F.col("a")), a="12345").ok
    assert one(spark, long_text.read_json(F.col("a")), a=None) == "" and one(spark, long_text.value(F.col("a")), a=None) == "" and one(spark, long_text.to_string(F.col("a")), a=None) == ""
    assert one(spark, long_text.compare(F.col("a"), F.col("b")), a="a", b="B") == -1
    assert one(spark, long_text.compare(F.col("a"), F.col("b")), a="a", b=None) == 1


def test_json_codec(spark):
    assert one(spark, over5.read_json(F.col("a")), a=5) == 0 and one(spark, over5.read_json(F.col("a")), a=6) == 6
    guid = typed("Id", "guid")
    with pytest.raises(Exception, match="null is no value of Id"):
        spark.range(1).select(guid.read_json(F.lit(None))).collect()
    m = spark.range(1).select(F.create_map(F.lit("6"), F.lit(1)).alias("m"))
    back = m.select(over5.read_keys(F.col("m")).alias("m")).select("m", over5.write_keys(F.col("m")).alias("t")).first()
    assert back.m == {6: 1} and back.t == {"6": 1}
    with pytest.raises(Exception, match="not valid"):
        spark.range(1).select(over5.read_keys(F.create_map(F.lit("5"), F.lit(1)))).collect()


SAMPLES = {"string": "x", "bool": "true", "byte": "255", "sbyte": "-1", "bytes": "eA==", "short": "-3", "ushort": "65535", "int": "1", "uint": "4294967295", "long": "9", "ulong": "18446744073709551615", "float": "1.5", "double": "1e3", "decimal": "1.25", "datetime": "2026-01-02T03:04:05", "datetimeoffset": "2026-01-02T03:04:05+01:00", "date": "2026-01-02", "time": "03:04:05", "timespan": "1.02:03:04", "guid": "0f8fad5b-d9cb-469f-a165-70867728950e", "char": "c", "uri": "https://a.example/b"}
BAD = {"bool": "yes", "byte": "256", "sbyte": "128", "bytes": "*", "short": "40000", "ushort": "-1", "int": "1.0", "uint": "-1", "long": "x", "ulong": "-1", "float": "x", "double": "1,5", "decimal": "x", "datetime": "soon", "datetimeoffset": "2026", "date": "2026-13-01", "time": "3", "timespan": "x", "guid": "123", "char": "ab", "uri": "a b"}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_every_kind_parses_and_has_an_empty_value(spark, kind):
    t = typed("T", kind)
    r = spark.range(1).select(t.try_parse(F.lit(SAMPLES[kind])).alias("r"), t.empty().isNotNull().alias("e")).select("r.ok", "e").first()
    assert r.ok and r.e
    if kind in BAD:
        assert not spark.range(1).select(t.try_parse(F.lit(BAD[kind])).alias("r")).select("r.ok").first().ok
    schema = openapi_schema(kind)
    assert openapi_schema(kind, array=True) == (None if schema is None else {"type": "array", "items": schema})


def test_formats_overrides_and_capabilities(spark):
    assert one(spark, typed("N", "int").to_string(F.col("a"), "%05d"), a=42) == "00042"
    assert spark.range(1).select(typed("D", "date").to_string(F.lit("2026-01-02").cast("date"), "yyyy")).first()[0] == "2026"
    own = typed("Own", "int", is_valid=lambda v: v == 1)
    assert one(spark, own.is_valid(F.col("a")), a=1) and not one(spark, own.is_valid(F.col("a")), a=2)
    assert "compare" not in typed("B", "bytes").operations and "format" not in typed("S", "string").operations
    with pytest.raises(TypeError):
        typed("U", "uri").compare(F.lit("a"), F.lit("b"))
    with pytest.raises(ValueError):
        typed("X", "complex")
    with pytest.raises(ValueError):
        typed("X", "int", hash=lambda v: v)
