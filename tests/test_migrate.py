import itertools
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.migrate import MigrationEngine, Options, migration_counts, observed
from palimpsest.plans.registry import Listed, Mapped, Policy, Registry, Versioned

S, I = T.StringType(), T.IntegerType()


def words(c):
    parts = F.filter(F.split(c, " "), lambda x: x != "")
    return F.coalesce(F.get(parts, 0), F.lit("")), F.coalesce(F.get(parts, 1), F.lit(""))


def person(s):
    first, last = words(s["name"])
    return F.struct(first.alias("firstName"), last.alias("lastName"), s["age"].alias("age"))


def tracking(**more):
    v1 = Versioned("TrackingV1", {"name": S, "age": I})
    v3 = Versioned("TrackingV3", {"firstName": S, "lastName": S, "age": I}, annotated=True, tracked=True, **more)
    return v1, v3


def run(spark, engine, target, payloads, on_error="column"):
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, j string")
    return [r.asDict(recursive=True) for r in engine.migrate(df, "j", target, on_error=on_error).orderBy("id").collect()]


def test_classification_cases(spark):
    v1, v3 = tracking()
    out = run(spark, MigrationEngine(Registry().register(v1, v3, person)), v3, [
        '{"$type":"TrackingV1","name":"Jane  Doe","age":3}', '{"$type":"TrackingV3","firstName":"A","lastName":"B","age":1}',
        '{"firstName":"A","lastName":"B","$type":"not-first"}', "{}", "[]", " null ", '{"$type":42}', '{"$type":"   "}', '{"$type":"zz"}', "", "{", '{/*c*/"a":1}',
        '{"$type":"TrackingV1","age":"x"}', '{"$type":"TrackingV1"} trailing', '{"\\u0024type":"TrackingV1","name":"a b"}', '{"$type":"trackingv1"}', None,
    ])
    assert [r["_path"] for r in out] == ["migrate", "target", "legacy", "legacy", "legacy", "null", "error", "error", "error", "error", "error", "error", "migrate", "error", "migrate", "error", "null"]
    assert out[0]["value"] == {"firstName": "Jane", "lastName": "Doe", "age": 3} and out[0]["_migrated"] and out[0]["_status"] == "success"
    assert out[1]["_migrated"] is False and out[2]["_migrated"] is True and out[3]["value"] == {"firstName": None, "lastName": None, "age": None}
    assert "could not be converted" in out[4]["_error"] and out[5]["value"] is None and out[5]["_error"] is None
    for k, text in {6: "Expected discriminator string", 7: "cannot be null or empty", 8: "No migrator was found for discriminator", 9: "Unexpected end of JSON payload.", 10: "Unexpected end of JSON payload."}.items():
        assert text in out[k]["_error"]
    assert "could not be converted" in out[12]["_error"] and out[14]["value"]["firstName"] == "a"


def test_errors_raise_once_the_value_is_read(spark):
    v1, v3 = tracking()
    engine = MigrationEngine(Registry().register(v1, v3, person))
    with pytest.raises(Exception, match="Expected discriminator string"):
        run(spark, engine, v3, ['{"$type":42}'], on_error="raise")


@pytest.mark.parametrize("policy,value,migrated,error", [(Policy.THROW, None, None, "Migration failed for"), (Policy.FALL_BACK, {"firstName": None, "lastName": None, "age": 7}, False, None), (Policy.NULL, None, None, None)])
def test_failure_policies(spark, policy, value, migrated, error):
    v1, v3 = tracking(policy=policy)
    engine = MigrationEngine(Registry().register(v1, v3, lambda s: (F.lit(False), person(s))))
    (row,) = run(spark, engine, v3, ['{"$type":"TrackingV1","name":"x","age":7}'])
    assert row["value"] == value and row["_migrated"] is migrated and row["_status"] == "failure"
    assert (row["_error"] is None) if error is None else (error in row["_error"])


def test_target_owned_edge_wins_and_source_property_names(spark):
    v1, v3 = tracking()
    other = Versioned("Other", {"name": S, "age": I}, discriminator="o", property_name="kind")
    v3.migrates_from(v1)(lambda s: F.struct(F.lit("own").alias("firstName"), F.lit("").alias("lastName"), s["age"].alias("age")))
    engine = MigrationEngine(Registry().register(v1, v3, person).register(other, v3, person))
    out = run(spark, engine, v3, ['{"$type":"TrackingV1","name":"x"}', '{"kind":"o","name":"a b","age":1}', '{"kind":"TrackingV3"}', '{"kind":5}', '{"Kind":"o"}'])
    assert out[0]["value"]["firstName"] == "own" and out[1]["value"]["lastName"] == "b" and out[1]["_source"] == "Other"
    assert "No migrator was found" in out[2]["_error"] and "Expected discriminator string" in out[3]["_error"] and out[4]["_path"] == "legacy"


def label(*parts):
    return F.struct(F.concat(*parts).alias("label"))


def shapes(*sources):
    target = Versioned("Shape", {"label": S}, discriminator="shape")
    registry = Registry()
    for s in sources:
        registry.register(s, target, lambda v, n=s.name: label(F.lit(n)))
    return MigrationEngine(registry), target


def test_scalars(spark):
    engine, target = shapes(Versioned("text", S), Versioned("number", I), Versioned("bool", T.BooleanType()), Versioned("day", T.DateType()))
    out = run(spark, engine, target, ['"hello"', "42", "true", '{"label":"x"}'])
    assert [r["value"]["label"] for r in out] == ["text", "number", "bool", "x"]
    engine, target = shapes(Versioned("int", I), Versioned("double", T.DoubleType()))
    assert "ambiguous" in run(spark, engine, target, ["1"])[0]["_error"]


def test_arrays_by_first_element(spark):
    e1, e2 = Versioned("E1", {"data": S}, discriminator="e1"), Versioned("E2", {"data": S}, discriminator="e2")
    engine, target = shapes(Versioned("texts", T.ArrayType(S)), Versioned("ints", T.ArrayType(I)), Versioned("e1s", Listed(e1)), Versioned("e2s", Listed(e2)), Versioned("grid", T.ArrayType(T.ArrayType(I))))
    out = run(spark, engine, target, ['["a"]', "[1,2]", '[{"$type":"e2","data":"x"}]', '[{"$type":"e1","data":"x"}]', "[[1],[2]]", "[]", '[{"data":"x"}]', "[true]"])
    assert [r["value"] and r["value"]["label"] for r in out[:5]] == ["texts", "ints", "e2s", "e1s", "grid"]
    assert "ambiguous" in out[5]["_error"] and "ambiguous" in out[6]["_error"] and out[7]["_source"] == "texts"
    one, target = shapes(Versioned("texts", T.ArrayType(S)))
    assert run(spark, one, target, ["[]", '["a"]'])[0]["value"]["label"] == "texts"


def test_maps_and_undiscriminated(spark):
    texts, ints = Versioned("texts", T.MapType(S, S)), Versioned("ints", T.MapType(S, I))
    engine, target = shapes(texts, ints)
    out = run(spark, engine, target, ['{"a":"x"}', '{"a":4}', "{}", '{"$type":"shape","label":"q"}'])
    assert [r["value"]["label"] for r in out] == ["texts", "ints", None, "q"] and out[2]["_path"] == "legacy"
    free = Versioned("Free", {"a": S})
    target = Versioned("Shape", {"label": S}, discriminator="shape", undiscriminated_source=free)
    registry = Registry().register(free, target, lambda v: label(F.coalesce(v["a"], F.lit("none")))).register(texts, target, lambda v: label(F.lit("map")))
    out = run(spark, MigrationEngine(registry), target, ['{"a":"x"}', "{}", '{"$type":"shape","label":"q"}'])
    assert [r["value"]["label"] for r in out] == ["x", "none", "q"] and [r["_source"] for r in out] == ["Free", "Free", None]


def test_nested_in_every_place_and_self_nesting(spark):
    c1, c2 = Versioned("C1", {"name": S}, discriminator="c1"), Versioned("C2", {"first": S, "last": S}, discriminator="c2", tracked=True)
    c2.migrates_from(c1)(lambda s: F.struct(words(s["name"])[0].alias("first"), words(s["name"])[1].alias("last")))
    parent = Versioned("P", {"one": c2, "many": Listed(c2), "by": Mapped(c2), "n": I}, discriminator="p")
    old = Versioned("P1", {"child": c2}, discriminator="p1")
    engine = MigrationEngine(Registry().register(old, parent, lambda s: F.struct(s["child"].alias("one"), F.array(s["child"]).alias("many"), F.create_map(F.lit("k"), s["child"]).alias("by"), F.lit(1).alias("n"))))
    child = '{"$type":"c1","name":"a b"}'
    out = run(spark, engine, parent, [f'{{"$type":"p","one":{child},"many":[{child},{{"$type":"c2","first":"x"}},null],"by":{{"k":{child}}},"n":1}}', f'{{"$type":"p1","child":{child}}}', '{"$type":"p","one":{"$type":"bad"}}'])
    done = {"first": "a", "last": "b", "_migrated": True}
    assert out[0]["value"] == {"one": done, "many": [done, {"first": "x", "last": None, "_migrated": False}, None], "by": {"k": done}, "n": 1}
    assert out[1]["value"]["one"] == done and out[1]["_status"] == "success"
    assert "No migrator was found" in out[2]["_error"]


def test_cycles_chains_and_round_trip(spark):
    a, b, c = (Versioned(n, {f: S, g: I}, discriminator=n) for n, f, g in (("cycle-a", "name", "age"), ("cycle-b", "label", "value"), ("cycle-c", "tag", "count")))
    move = lambda x, y: lambda s: F.struct(*[s[m].alias(n) for m, n in zip(x.members(), y.members())])
    for x, y in ((a, b), (b, c), (c, a)):
        y.migrates_from(x)(move(x, y))
    registry = Registry().register(a, c, lambda s: move(b, c)(move(a, b)(s)))  # a composed edge
    engine = MigrationEngine(registry)
    (row,) = run(spark, engine, b, ['{"$type":"cycle-a","name":"n","age":2}'])
    assert row["value"] == {"label": "n", "value": 2}
    (row,) = run(spark, engine, c, ['{"$type":"cycle-a","name":"n","age":2}'])
    assert row["value"] == {"tag": "n", "count": 2}
    df = spark.createDataFrame([('{"$type":"cycle-a","name":"n","age":2}',)], "j string")
    text = engine.migrate(df, "j", b).select(engine.encode(F.col("value"), b)).first()[0]
    assert text == '{"$type":"cycle-b","label":"n","value":2}'
    assert engine.rewritten(df, "j", b).collect()[0][0] == text
    assert engine.rewritten(spark.createDataFrame([(text,)], "j string"), "j", b).count() == 0


def test_encode_keeps_a_member_of_the_discriminators_name(spark):
    t = Versioned("T", {"$type": S, "x": I}, discriminator="t")
    text = spark.range(1).select(MigrationEngine(Registry()).encode(F.struct(F.lit("own").alias("$type"), F.lit(1).alias("x")), t)).first()[0]
    assert json.loads(text) == {"$type": "own", "x": 1} and text.count("$type") == 1


@pytest.mark.parametrize("naming,insensitive,lenient,omit", itertools.product(("exact", "camel"), (False, True), (False, True), (False, True)))
def test_option_matrix(spark, naming, insensitive, lenient, omit):
    options = Options(naming=naming, case_insensitive=insensitive, numbers_from_strings=lenient, omit_nulls=omit)
    v1, v2 = Versioned("V1", {"name": S, "age": I, "nick_name": S}), Versioned("V2", {"first_name": S, "age": I, "nick_name": S})
    engine = MigrationEngine(Registry().register(v1, v2, lambda s: F.struct(words(s["name"])[0].alias("first_name"), s["age"].alias("age"), s["nick_name"].alias("nick_name"))), options)
    key = options.json_name("nick_name")
    rows = [f'{{"$type":"V1","name":"a b","age":3,"{key}":null}}', f'{{"$type":"V1","name":"a b","age":3,"{key.upper()}":"n"}}', '{"$type":"V1","name":"a","age":"3"}']
    out = run(spark, engine, v2, rows)
    assert out[0]["value"] == {"first_name": "a", "age": 3, "nick_name": None}
    assert out[1]["value"]["nick_name"] == ("n" if insensitive else None)
    assert (out[2]["value"] is not None and out[2]["value"]["age"] == 3) if lenient or insensitive else "could not be converted" in out[2]["_error"]
    text = spark.range(1).select(engine.encode(F.struct(F.lit("a").alias("first_name"), F.lit(1).alias("age"), F.lit(None).cast("string").alias("nick_name")), v2)).first()[0]
    assert (key in json.loads(text)) is not omit and next(iter(json.loads(text))) == "$type"


def test_unknown_members(spark):
    t = Versioned("T", {"x": I}, discriminator="t")
    out = run(spark, MigrationEngine(Registry(), Options(unknown_members="error")), t, ['{"$type":"t","x":1}', '{"$type":"t","x":1,"y":2}'])
    assert out[0]["value"] == {"x": 1} and "could not be converted" in out[1]["_error"]


def test_counters_and_observation(spark):
    v1, v3 = tracking(policy=Policy.NULL)
    engine = MigrationEngine(Registry().register(v1, v3, lambda s: (s["age"] > 1, person(s))))
    rows = ['{"$type":"TrackingV1","name":"x","age":7}', '{"$type":"TrackingV1","name":"x","age":0}', '{"$type":"TrackingV3"}', "{}"]
    df = engine.migrate(spark.createDataFrame([(r,) for r in rows], "j string"), "j", v3)
    assert {(r.source_type, r.target_type, r.status, r.migrations) for r in migration_counts(df, v3).collect()} == {("TrackingV1", "TrackingV3", "success", 1), ("TrackingV1", "TrackingV3", "failure", 1)}
    observed(df, "seen").select("_status").collect()


def test_plan_is_a_map(spark):
    v1, v3 = tracking()
    df = MigrationEngine(Registry().register(v1, v3, person)).migrate(spark.createDataFrame([("{}",)], "j string"), "j", v3).where(F.col("_path") == "legacy")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
