"""Queries over the driver's tables, each with the SQL that gives the same rows.

The tables hold no versioned payloads, so the queries build payloads from columns, the same text in both engines, and then
classify, decode and migrate that text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.typed import KINDS, openapi_schema, typed
from palimpsest.operators import feed, reports
from palimpsest.operators.migrate import MigrationEngine, Options, migration_counts
from palimpsest.plans.registry import Listed, Policy, Registry, Versioned
from palimpsest.sources.files import dealt

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Customer payloads: one of 15 forms by key.

FORMS_SQL = """SELECT c_custkey, c_custkey % 15 AS form, split_part(c_name, '#', 1) AS f, split_part(c_name, '#', 2) AS l, c_mktsegment AS s,
  CASE c_custkey % 15
    WHEN 0 THEN concat('{"$type":"cust-v3","firstName":"', split_part(c_name, '#', 1), '","lastName":"', split_part(c_name, '#', 2), '","segment":"', c_mktsegment, '"}')
    WHEN 1 THEN concat('{"$type":"cust-v2","name":"', replace(c_name, '#', ' '), '","segment":"', c_mktsegment, '"}')
    WHEN 2 THEN concat('{"$type":"cust-v1","fullName":"', replace(c_name, '#', ' '), '"}')
    WHEN 3 THEN concat('{"firstName":"', split_part(c_name, '#', 1), '","lastName":"', split_part(c_name, '#', 2), '","segment":"', c_mktsegment, '"}')
    WHEN 4 THEN concat('{"lastName":"', split_part(c_name, '#', 2), '","$type":"cust-v2"}')
    WHEN 5 THEN '{}'
    WHEN 6 THEN concat('["', split_part(c_name, '#', 1), '","', split_part(c_name, '#', 2), '"]')
    WHEN 7 THEN concat('"', replace(c_name, '#', ' '), '"')
    WHEN 8 THEN '{"$type":"cust-v9"}'
    WHEN 9 THEN '{"$type":5}'
    WHEN 10 THEN '{"$type":"  "}'
    WHEN 11 THEN 'null'
    WHEN 12 THEN CAST(c_custkey AS VARCHAR)
    WHEN 13 THEN '{"$type":"cust-v3"'
    ELSE concat('{"kind":"cust-v0","n":"', replace(c_name, '#', ' '), '"}') END AS payload
FROM customer"""


def customer_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    first, last, seg = F.split_part("c_name", F.lit("#"), F.lit(1)), F.split_part("c_name", F.lit("#"), F.lit(2)), F.col("c_mktsegment")
    both = F.replace("c_name", F.lit("#"), F.lit(" "))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [
        text('{"$type":"cust-v3","firstName":"', first, '","lastName":"', last, '","segment":"', seg, '"}'),
        text('{"$type":"cust-v2","name":"', both, '","segment":"', seg, '"}'),
        text('{"$type":"cust-v1","fullName":"', both, '"}'),
        text('{"firstName":"', first, '","lastName":"', last, '","segment":"', seg, '"}'),
        text('{"lastName":"', last, '","$type":"cust-v2"}'),
        F.lit("{}"),
        text('["', first, '","', last, '"]'),
        text('"', both, '"'),
        F.lit('{"$type":"cust-v9"}'),
        F.lit('{"$type":5}'),
        F.lit('{"$type":"  "}'),
        F.lit("null"),
        F.col("c_custkey").cast("string"),
        F.lit('{"$type":"cust-v3"'),
        text('{"kind":"cust-v0","n":"', both, '"}'),
    ]
    form = F.col("c_custkey") % 15
    payload = F.when(form == 0, forms[0])
    for k, f in enumerate(forms[1:], 1):
        payload = payload.when(form == k, f)
    return c.select("c_custkey", payload.alias("payload"))


def words(text) -> tuple:
    parts = F.filter(F.split(text, " "), lambda x: x != "")
    return F.coalesce(F.get(parts, 0), F.lit("")), F.coalesce(F.get(parts, 1), F.lit(""))


def person(first, last, segment):
    return F.struct(first.alias("firstName"), last.alias("lastName"), segment.alias("segment"))


def customer_types(policy: Policy | None = None, fails=None, free: bool = False):
    v0 = Versioned("CustV0", {"n": S}, discriminator="cust-v0", property_name="kind")
    v1 = Versioned("CustV1", {"fullName": S}, discriminator="cust-v1")
    v2 = Versioned("CustV2", {"name": S, "segment": S}, discriminator="cust-v2")
    pair = Versioned("Pair", T.ArrayType(S))
    plain = Versioned("Plain", S)
    legacy = Versioned("Free", {"firstName": S, "lastName": S})
    v3 = Versioned("CustV3", {"firstName": S, "lastName": S, "segment": S}, discriminator="cust-v3", policy=policy, tracked=True, undiscriminated_source=legacy if free else None)
    none = F.lit(None).cast("string")
    r = Registry()
    r.register(v0, v3, lambda s: person(*words(s["n"]), none))
    r.register(v1, v3, lambda s: person(*words(s["fullName"]), none))
    r.register(v2, v3, lambda s: ((~fails(s)) if fails else F.lit(True), person(*words(s["name"]), s["segment"])))
    r.register(pair, v3, lambda s: person(F.get(s, 0), F.get(s, 1), none))
    r.register(plain, v3, lambda s: person(*words(s), none))
    if free:
        r.register(legacy, v3, lambda s: person(s["firstName"], s["lastName"], F.lit("free")))
    return r, v3


def report(out: DataFrame, *keys: str) -> DataFrame:
    return out.select(*keys, F.col("_path").alias("path"), F.col("_source").alias("source"), F.col("_status").alias("status"), F.col("_migrated").alias("migrated"), F.col("value.firstName").alias("first_name"), F.col("value.lastName").alias("last_name"), F.col("value.segment").alias("segment"))


# The same classification in SQL, from the payload's text.
OUTCOME_SQL = f"""SELECT p.*, k0, CASE
    WHEN NOT valid THEN 'error' WHEN kind = 'NULL' THEN 'null'
    WHEN kind = 'VARCHAR' THEN 'migrate' WHEN kind = 'ARRAY' THEN 'migrate' WHEN kind <> 'OBJECT' THEN 'legacy'
    WHEN k0 = '$type' THEN CASE WHEN dkind <> 'VARCHAR' THEN 'error' WHEN disc = 'cust-v3' THEN 'target' WHEN disc IN ('cust-v0', 'cust-v1', 'cust-v2') THEN 'migrate' ELSE 'error' END
    WHEN k0 = 'kind' THEN CASE WHEN disc0 IN ('cust-v0', 'cust-v1', 'cust-v2') THEN 'migrate' ELSE 'error' END
    ELSE 'legacy' END AS path,
  CASE WHEN kind = 'VARCHAR' THEN 'Plain' WHEN kind = 'ARRAY' THEN 'Pair' WHEN k0 = '$type' AND disc = 'cust-v1' THEN 'CustV1' WHEN k0 = '$type' AND disc = 'cust-v2' THEN 'CustV2' WHEN k0 = 'kind' AND disc0 = 'cust-v0' THEN 'CustV0' END AS source
FROM (SELECT q.*, CASE WHEN valid AND kind = 'OBJECT' THEN json_keys(payload)[1] END AS k0,
    CASE WHEN valid THEN json_extract_string(payload, '$."$type"') END AS disc, CASE WHEN valid THEN json_type(payload, '$."$type"') END AS dkind,
    CASE WHEN valid THEN json_extract_string(payload, '$.kind') END AS disc0
  FROM (SELECT b.*, json_valid(payload) AS valid, CASE WHEN json_valid(payload) THEN json_type(payload) END AS kind FROM ({FORMS_SQL}) b) q) p"""

NAMES_SQL = """CASE WHEN path IN ('target', 'migrate') AND form <> 8 THEN f WHEN form = 3 THEN f END AS first_name,
  CASE WHEN path IN ('target', 'migrate') OR form IN (3, 4) THEN l END AS last_name, CASE WHEN form IN (0, 1, 3) THEN s END AS segment"""


@query(f"""SELECT c_custkey, path, source, CASE WHEN path = 'migrate' THEN 'success' END AS status,
  CASE path WHEN 'target' THEN false WHEN 'legacy' THEN true WHEN 'migrate' THEN true END AS migrated, {NAMES_SQL}, CASE
    WHEN NOT valid THEN 'Unexpected end of JSON payload.' WHEN form = 9 THEN 'Expected discriminator string.' WHEN form = 10 THEN 'Type discriminator cannot be null or empty.'
    WHEN form = 8 THEN 'No migrator was found for discriminator ''cust-v9'' to ''CustV3''.' WHEN form = 12 THEN 'The JSON value could not be converted to ''CustV3''.' END AS error
  FROM ({OUTCOME_SQL}) o""")
def m_migrate(spark, sf_dir):
    registry, target = customer_types()
    out = MigrationEngine(registry).migrate(customer_payloads(spark, sf_dir), "payload", target, on_error="column")
    return report(out.withColumn("error", F.col("_error")), "c_custkey", "error")


@query(f"SELECT source AS source_type, 'CustV3' AS target_type, 'success' AS status, count(*) AS migrations FROM ({OUTCOME_SQL}) o WHERE path = 'migrate' GROUP BY source")
def m_counters(spark, sf_dir):
    registry, target = customer_types()
    out = MigrationEngine(registry).migrate(customer_payloads(spark, sf_dir), "payload", target, on_error="column")
    return migration_counts(out, target)


@query(f"""SELECT c_custkey, path, source, CASE WHEN path = 'migrate' THEN CASE WHEN form = 1 AND s = 'BUILDING' THEN 'failure' ELSE 'success' END END AS status,
  CASE WHEN path = 'legacy' THEN true WHEN path = 'target' THEN false WHEN form = 1 AND s = 'BUILDING' THEN false WHEN path = 'migrate' THEN true END AS migrated,
  CASE WHEN form = 1 AND s = 'BUILDING' THEN NULL WHEN path IN ('target', 'migrate') OR form = 3 THEN f END AS first_name,
  CASE WHEN form = 1 AND s = 'BUILDING' THEN NULL WHEN path IN ('target', 'migrate') OR form IN (3, 4) THEN l END AS last_name,
  CASE WHEN form IN (0, 1, 3) THEN s END AS segment FROM ({OUTCOME_SQL}) o""")
def m_policy_fall_back(spark, sf_dir):
    registry, target = customer_types(Policy.FALL_BACK, lambda s: s["segment"] == "BUILDING")
    rows = customer_payloads(spark, sf_dir)
    return report(MigrationEngine(registry).migrate(rows, "payload", target, on_error="column"), "c_custkey")


@query(f"""SELECT c_custkey, path, source, CASE WHEN path = 'migrate' THEN CASE WHEN form = 1 AND s = 'BUILDING' THEN 'failure' ELSE 'success' END END AS status,
  CASE WHEN path = 'legacy' THEN true WHEN path = 'target' THEN false WHEN path = 'migrate' AND NOT (form = 1 AND s = 'BUILDING') THEN true END AS migrated,
  CASE WHEN form = 1 AND s = 'BUILDING' THEN NULL WHEN path IN ('target', 'migrate') OR form = 3 THEN f END AS first_name,
  CASE WHEN form = 1 AND s = 'BUILDING' THEN NULL WHEN path IN ('target', 'migrate') OR form IN (3, 4) THEN l END AS last_name,
  CASE WHEN form IN (0, 3) OR form = 1 AND s <> 'BUILDING' THEN s END AS segment FROM ({OUTCOME_SQL}) o""")
def m_policy_null(spark, sf_dir):
    registry, target = customer_types(Policy.NULL, lambda s: s["segment"] == "BUILDING")
    rows = customer_payloads(spark, sf_dir)
    return report(MigrationEngine(registry).migrate(rows, "payload", target, on_error="column"), "c_custkey")


@query(f"""SELECT c_custkey, CASE WHEN form IN (3, 4, 5) THEN 'migrate' ELSE path END AS path, CASE WHEN form IN (3, 4, 5) THEN 'Free' ELSE source END AS source,
  CASE WHEN path = 'migrate' OR form IN (3, 4, 5) THEN 'success' END AS status, CASE WHEN path = 'target' THEN false WHEN path NOT IN ('null', 'error') THEN true END AS migrated,
  CASE WHEN path IN ('target', 'migrate') OR form = 3 THEN f END AS first_name, CASE WHEN path IN ('target', 'migrate') OR form IN (3, 4) THEN l END AS last_name,
  CASE WHEN form IN (0, 1) THEN s WHEN form IN (3, 4, 5) THEN 'free' END AS segment FROM ({OUTCOME_SQL}) o""")
def m_undiscriminated(spark, sf_dir):
    registry, target = customer_types(free=True)
    rows = customer_payloads(spark, sf_dir)
    return report(MigrationEngine(registry).migrate(rows, "payload", target, on_error="column"), "c_custkey")


@query(f"""SELECT c_custkey, concat('{{"$type":"cust-v3","firstName":', CASE WHEN path = 'migrate' OR form = 3 THEN concat('"', f, '"') ELSE 'null' END,
  ',"lastName":', CASE WHEN path = 'migrate' OR form IN (3, 4) THEN concat('"', l, '"') ELSE 'null' END, ',"segment":', CASE WHEN form IN (1, 3) THEN concat('"', s, '"') ELSE 'null' END, '}}') AS payload
  FROM ({OUTCOME_SQL}) o WHERE path IN ('migrate', 'legacy') AND form <> 12""")
def m_write_back(spark, sf_dir):
    registry, target = customer_types()
    rows = customer_payloads(spark, sf_dir)
    return MigrationEngine(registry).rewritten(rows, "payload", target, on_error="column")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'legacy' ELSE 'migrate' END AS path, CASE p_partkey % 4 WHEN 0 THEN 'Texts' WHEN 1 THEN 'Numbers' WHEN 2 THEN 'Texts' END AS source,
  CASE p_partkey % 4 WHEN 0 THEN concat('brand=', p_brand, ';type=', p_type) WHEN 1 THEN concat('size=', p_size) WHEN 2 THEN concat('brand=', p_brand) END AS label FROM part""")
def m_maps(spark, sf_dir):
    """Objects without a discriminator as maps: the first value decides between maps of texts and of numbers; {} is legacy."""
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"))
    form = F.col("p_partkey") % 4
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    payload = (
        F.when(form == 0, F.concat(F.lit('{"brand":'), text(F.col("p_brand")), F.lit(',"type":'), text(F.col("p_type")), F.lit("}")))
        .when(form == 1, F.concat(F.lit('{ "size" : '), F.col("p_size").cast("string"), F.lit("}"))).when(form == 2, F.concat(F.lit('{"brand":'), text(F.col("p_brand")), F.lit("}"))).otherwise("{}")
    )
    texts, numbers = Versioned("Texts", T.MapType(S, S)), Versioned("Numbers", T.MapType(S, I))
    target = Versioned("Label", {"label": S}, discriminator="label")
    show = lambda m: F.struct(F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("label"))
    registry = Registry().register(texts, target, show).register(numbers, target, show)
    out = MigrationEngine(registry).migrate(p.select("p_partkey", payload.alias("payload")), "payload", target)
    return out.select("p_partkey", F.col("_path").alias("path"), F.col("_source").alias("source"), "value.label")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN 'error' ELSE 'migrate' END AS path, CASE o_orderkey % 6 WHEN 0 THEN 'Ints' WHEN 1 THEN 'Strings' WHEN 2 THEN 'ItemsV1' WHEN 3 THEN 'ItemsV2' WHEN 4 THEN 'Grid' END AS source,
  CASE o_orderkey % 6 WHEN 0 THEN concat('ints:', o_orderkey, ',', o_custkey) WHEN 1 THEN concat('strings:', o_orderstatus, ',', o_orderpriority) WHEN 2 THEN concat('v1:', o_orderpriority) WHEN 3 THEN concat('v2:', o_orderpriority) WHEN 4 THEN concat('grid:', o_custkey) END AS label FROM orders""")
def m_arrays(spark, sf_dir):
    """Lists told apart by their first element: its token, its discriminator, its shape. An empty list is ambiguous."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    key, cust, form = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderkey") % 6
    item = lambda v: F.concat(F.lit(f'[{{"$type":"elem-v{v}","data":"'), F.col("o_orderpriority"), F.lit('"}]'))
    payload = (
        F.when(form == 0, F.concat(F.lit("["), key, F.lit(","), cust, F.lit("]"))).when(form == 1, F.concat(F.lit('["'), F.col("o_orderstatus"), F.lit('","'), F.col("o_orderpriority"), F.lit('"]')))
        .when(form == 2, item(1)).when(form == 3, item(2)).when(form == 4, F.concat(F.lit("[["), cust, F.lit("],[]]"))).otherwise("[ ]")
    )
    e1, e2 = Versioned("ElemV1", {"data": S}, discriminator="elem-v1"), Versioned("ElemV2", {"data": S}, discriminator="elem-v2")
    target = Versioned("Label", {"label": S}, discriminator="label")
    label = lambda *parts: F.struct(F.concat(*parts).alias("label"))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")
    r = Registry()
    r.register(Versioned("Ints", T.ArrayType(T.LongType())), target, lambda s: label(F.lit("ints:"), text(s)))
    r.register(Versioned("Strings", T.ArrayType(S)), target, lambda s: label(F.lit("strings:"), text(s)))
    r.register(Versioned("ItemsV1", Listed(e1)), target, lambda s: label(F.lit("v1:"), F.get(s, 0)["data"]))
    r.register(Versioned("ItemsV2", Listed(e2)), target, lambda s: label(F.lit("v2:"), F.get(s, 0)["data"]))
    r.register(Versioned("Grid", T.ArrayType(T.ArrayType(T.LongType()))), target, lambda s: label(F.lit("grid:"), text(F.flatten(s))))
    out = MigrationEngine(r).migrate(o.select("o_orderkey", payload.alias("payload")), "payload", target, on_error="column")
    return out.select("o_orderkey", F.col("_path").alias("path"), F.col("_source").alias("source"), "value.label")


@query("""SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 2 = 0 THEN 'migrate' ELSE 'target' END AS path, o.o_orderstatus AS state, count(*) AS n_lines,
  count(*) FILTER (WHERE l_linenumber % 2 = 1) AS n_migrated, string_agg(concat(l_linenumber, ':', l_returnflag, l_linestatus), ',' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS lines
  FROM orders o JOIN lineitem l ON l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderstatus""")
def m_nested(spark, sf_dir):
    """Orders of two versions with a list of lines of two versions: parent and children migrate on their own."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")  # noqa: E741
    n = F.col("l_linenumber").cast("string")
    old = F.concat(F.lit('{"$type":"line-v1","n":'), n, F.lit(',"flags":"'), F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus"), F.lit('"}'))
    new = F.concat(F.lit('{"$type":"line-v2","n":'), n, F.lit(',"flag":"'), F.col("l_returnflag"), F.lit('","status":"'), F.col("l_linestatus"), F.lit('"}'))
    lines = l.select("l_orderkey", F.struct("l_linenumber", F.when(F.col("l_linenumber") % 2 == 1, old).otherwise(new).alias("j")).alias("x"))
    lines = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]), ",").alias("lines"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    head = F.when(F.col("o_orderkey") % 2 == 0, F.lit('{"$type":"order-v1","s":"')).otherwise(F.lit('{"$type":"order-v2","state":"'))
    payload = F.concat(head, F.col("o_orderstatus"), F.lit('","lines":['), F.col("lines"), F.lit("]}"))
    l1, l2 = Versioned("LineV1", {"n": I, "flags": S}, discriminator="line-v1"), Versioned("LineV2", {"n": I, "flag": S, "status": S}, discriminator="line-v2", tracked=True)
    o1, o2 = Versioned("OrderV1", {"s": S, "lines": Listed(l2)}, discriminator="order-v1"), Versioned("OrderV2", {"state": S, "lines": Listed(l2)}, discriminator="order-v2")
    r = Registry()
    r.register(l1, l2, lambda s: F.struct(s["n"].alias("n"), words(s["flags"])[0].alias("flag"), words(s["flags"])[1].alias("status")))
    r.register(o1, o2, lambda s: F.struct(s["s"].alias("state"), s["lines"].alias("lines")))
    out = MigrationEngine(r).migrate(o.select("o_orderkey", payload.alias("payload")), "payload", o2)
    shown = F.array_join(F.transform("value.lines", lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["flag"], x["status"])), ",")
    return out.select("o_orderkey", F.col("_path").alias("path"), "value.state", F.size("value.lines").cast("long").alias("n_lines"), F.size(F.filter("value.lines", lambda x: x["_migrated"])).cast("long").alias("n_migrated"), shown.alias("lines"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'migrate' ELSE 'target' END AS path, s_name AS label, CAST(s_nationkey AS INTEGER) AS value,
  concat('{"$type":"side-y","label":"', s_name, '","value":', s_nationkey, '}') AS encoded, concat('{"$type":"side-x","name":"', s_name, '","age":', s_nationkey, '}') AS back FROM supplier""")
def m_cycle(spark, sf_dir):
    """Two types that migrate into each other: read as y, written, read again as x."""
    x, y = Versioned("SideX", {"name": S, "age": I}, discriminator="side-x"), Versioned("SideY", {"label": S, "value": I}, discriminator="side-y")
    x.migrates_from(y)(lambda s: F.struct(s["label"].alias("name"), s["value"].alias("age")))
    y.migrates_from(x)(lambda s: F.struct(s["name"].alias("label"), s["age"].alias("value")))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    body = F.concat(F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, '","age":').otherwise('","value":'), F.col("s_nationkey").cast("string"), F.lit("}"))
    payload = F.concat(F.when(F.col("s_suppkey") % 2 == 0, '{"$type":"side-x","name":"').otherwise('{"$type":"side-y","label":"'), body)
    engine = MigrationEngine(Registry())
    there = engine.migrate(s.select("s_suppkey", payload.alias("payload")), "payload", y)
    there = there.select("s_suppkey", F.col("_path").alias("path"), F.col("value.label").alias("label"), F.col("value.value").alias("value"), engine.encode(F.col("value"), y).alias("encoded"))
    again = engine.migrate(there, "encoded", x, value="x")
    return again.select("s_suppkey", "path", "label", "value", "encoded", engine.encode(F.col("x"), x).alias("back"))


@query("""SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 3 = 2 THEN -1 ELSE s_nationkey END AS INTEGER) AS age, s_suppkey % 3 <> 2 AS good, s_suppkey % 5 <> 0 OR s_suppkey % 3 = 2 AS strict_ok FROM supplier""")
def m_options(spark, sf_dir):
    """Numbers written as strings are read when asked for; members that the type lacks are an error when asked for."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    form, n = F.col("s_suppkey") % 3, F.col("s_nationkey").cast("string")
    number = F.when(form == 0, n).when(form == 1, F.concat(F.lit('"'), n, F.lit('"'))).otherwise('"x"')
    extra = F.when(F.col("s_suppkey") % 5 == 0, ',"more":1').otherwise("")
    rows = s.select("s_suppkey", F.concat(F.lit('{"$type":"t","theAge":'), number, extra, F.lit("}")).alias("payload"))
    t = Versioned("T", {"the_age": I}, discriminator="t")
    lenient = MigrationEngine(Registry(), Options(naming="camel", numbers_from_strings=True)).migrate(rows, "payload", t, on_error="column")
    out = lenient.select("s_suppkey", "payload", F.col("value.the_age").alias("age"), F.col("_error").isNull().alias("good"))
    loose = MigrationEngine(Registry(), Options(naming="camel", unknown_members="error", case_insensitive=False, numbers_from_strings=True)).migrate(out, "payload", t, on_error="column")
    return loose.select("s_suppkey", F.coalesce("age", F.lit(-1)).alias("age"), "good", (F.col("_error").isNull() | ~F.col("good")).alias("strict_ok"))


# Typed scalars.

@query("""SELECT event_id, n IS NOT NULL AND n > 5 AS ok, CASE WHEN n > 5 THEN n ELSE 0 END AS parsed, CASE WHEN n > 5 THEN CAST(n AS VARCHAR) ELSE '0' END AS shown,
  CASE WHEN n > 5 THEN CASE WHEN n > 50 THEN 1 WHEN n < 50 THEN -1 ELSE 0 END ELSE -1 END AS against
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events) e""")
def p_try_parse(spark, sf_dir):
    level = typed("Level", "int", lambda v: v > 5)
    e = table(spark, sf_dir, "events").select("event_id", level.try_parse(F.get_json_object("props", "$.k")).alias("r"))
    value = F.col("r.value")
    return e.select("event_id", F.col("r.ok").alias("ok"), value.alias("parsed"), level.to_string(value).alias("shown"), level.compare(value, F.lit(50)).alias("against"))


@query("""SELECT p_partkey, CASE WHEN length(p_brand) > 8 THEN p_brand ELSE '' END AS brand, CASE WHEN p_size BETWEEN 10 AND 255 THEN CAST(p_size AS SMALLINT) ELSE CAST(0 AS SMALLINT) END AS size,
  concat('{"brand":"', CASE WHEN length(p_brand) > 8 THEN p_brand ELSE '' END, '","size":', CASE WHEN p_size BETWEEN 10 AND 255 THEN p_size ELSE 0 END, '}') AS encoded FROM part""")
def p_json_codec(spark, sf_dir):
    """Invalid members read as Empty, without an error; writing gives the plain value."""
    brand, size = typed("Brand", "string", lambda v: F.length(v) > 8), typed("Size", "byte", lambda v: v >= 10)
    p = table(spark, sf_dir, "part").select("p_partkey", brand.read_json(F.col("p_brand")).alias("brand"), size.read_json(F.col("p_size")).alias("size"))
    return p.withColumn("encoded", F.to_json(F.struct(brand.write_json(F.col("brand")).alias("brand"), size.write_json(F.col("size")).alias("size"))))


@query("""SELECT o_orderpriority, count(*) AS n, CAST(count(*) FILTER (WHERE substr(o_orderpriority, 1, 1) IN ('1', '2')) AS BIGINT) AS urgent FROM orders GROUP BY o_orderpriority""")
def p_group_by_typed(spark, sf_dir):
    priority = typed("Priority", "string", lambda v: v.rlike("^[1-5]-"))
    urgent = typed("Urgent", "string", lambda v: v.rlike("^[12]-"))
    o = table(spark, sf_dir, "orders").select(priority.parse(F.col("o_orderpriority")).alias("o_orderpriority"))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(urgent.is_valid(F.col("o_orderpriority"))).alias("urgent"))


@query("""SELECT n_nationkey, concat('{"', upper(n_name), '":', n_regionkey, '}') AS encoded, upper(n_name) AS key_back FROM nation""")
def p_map_keys(spark, sf_dir):
    """Typed values as property names: written as text, read strictly."""
    name = typed("Name", "string", lambda v: v == F.upper(v))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.create_map(F.upper("n_name"), F.col("n_regionkey")).alias("m"))
    n = n.withColumn("encoded", F.to_json(name.write_keys(F.col("m"))))
    back = name.read_keys(F.from_json("encoded", "map<string,int>"))
    return n.select("n_nationkey", "encoded", F.element_at(F.map_keys(back), 1).alias("key_back"))


@query("""SELECT * FROM (VALUES ('bool','boolean',NULL),('byte','integer','uint8'),('bytes','string','byte'),('char','string','char'),('date','string','date'),('datetime','string','date-time'),
  ('datetimeoffset','string','date-time'),('decimal','number','double'),('double','number','double'),('float','number','float'),('guid','string','uuid'),('int','integer','int32'),('long','integer','int64'),
  ('sbyte',NULL,NULL),('short','integer','int16'),('string','string',NULL),('time','string','time'),('timespan',NULL,NULL),('uint','integer','uint32'),('ulong','integer','uint64'),('uri','string','uri'),('ushort','integer','uint16')) t(kind, type, format)""")
def p_openapi(spark, sf_dir):
    rows = [(k, (s := openapi_schema(k) or {}).get("type"), s.get("format")) for k in sorted(KINDS)]
    return spark.createDataFrame(rows, "kind string, type string, format string")


# Activity feeds over events: user = entity, view = read, purchase = write, error = clear, the rest are calls.

ACTIVITY_SQL = """SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS entity_id, CASE event_type WHEN 'view' THEN 'StorageRead' WHEN 'purchase' THEN 'StorageWrite' WHEN 'error' THEN 'StorageClear' ELSE 'GrainCall' END AS kind, value, event_type FROM events"""


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("entity_id"), "event_type", "value", "props")
    operation = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "error", "clear")
    events = feed.ingest(e.withColumn("operation", operation))
    storage = F.struct(F.col("kind"), F.col("entity_id"), F.lit("Default").alias("store"), F.lit("state").alias("state_name"), F.concat(F.lit("etag-"), F.col("seq").cast("string")).alias("etag"), F.col("props").alias("state"))
    call = F.struct(F.col("entity_id").alias("target_id"), F.col("event_type").alias("method"), F.lit("IUser").alias("interface"))
    is_call = F.col("kind") == feed.CALL
    return events.select("seq", "entity_id", "kind", "value", F.when(~is_call, storage).alias("storage"), F.when(is_call, call).alias("call"))


@query(f"SELECT seq, entity_id, kind FROM ({ACTIVITY_SQL}) a ORDER BY seq DESC LIMIT 256")
def a_history(spark, sf_dir):
    return feed.history(activities(spark, sf_dir)).select("seq", "entity_id", "kind")


@query(f"SELECT seq, entity_id, kind FROM ({ACTIVITY_SQL}) a WHERE seq > (SELECT max(event_id) // 2 FROM events) - 256")
def a_replay_then_live(spark, sf_dir):
    events = activities(spark, sf_dir)
    half = events.agg(F.max("seq")).first()[0] // 2
    return feed.feed(events, half, replay=True).select("seq", "entity_id", "kind")


@query(f"SELECT seq, entity_id, kind FROM ({ACTIVITY_SQL}) a WHERE seq > (SELECT max(event_id) // 2 FROM events)")
def a_live_only(spark, sf_dir):
    events = activities(spark, sf_dir)
    half = events.agg(F.max("seq")).first()[0] // 2
    return feed.feed(events, half).select("seq", "entity_id", "kind")


@query(f"SELECT h.seq, h.kind, h.entity_id, 'Default' AS store, concat('etag-', h.seq) AS etag FROM (SELECT * FROM ({ACTIVITY_SQL}) a ORDER BY seq DESC LIMIT 256) h WHERE h.kind <> 'GrainCall' AND h.entity_id = '7'")
def a_storage_of_entity(spark, sf_dir):
    """History is cut first: an entity sees only its part of the newest 256 events."""
    rows = feed.storage_operations(feed.history(activities(spark, sf_dir)), "7")
    return rows.select("seq", "kind", "entity_id", "store", "etag")


@query(f"SELECT seq, entity_id AS target_id, event_type AS method FROM (SELECT * FROM ({ACTIVITY_SQL}) a ORDER BY seq DESC LIMIT 256) h WHERE kind = 'GrainCall'")
def a_calls(spark, sf_dir):
    return feed.calls(feed.history(activities(spark, sf_dir))).select("seq", "target_id", "method")


@query(f"SELECT seq, entity_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq) AS n FROM ({ACTIVITY_SQL}) a) b WHERE n <= 3")
def a_take_per_entity(spark, sf_dir):
    return feed.take_per_entity(activities(spark, sf_dir), 3).select("seq", "entity_id", "kind")


@query(f"SELECT seq, entity_id, kind FROM ({ACTIVITY_SQL}) a ORDER BY seq LIMIT 10")
def a_take(spark, sf_dir):
    return feed.take(activities(spark, sf_dir), 10).select("seq", "entity_id", "kind")


@query(f"""SELECT entity_id, min(seq) AS seq, min(attempts) AS attempts FROM (SELECT entity_id, seq, sum(CASE WHEN kind = 'StorageWrite' THEN 1 ELSE 0 END) OVER w AS state, count(*) OVER w + 1 AS attempts
  FROM ({ACTIVITY_SQL}) a WINDOW w AS (PARTITION BY entity_id ORDER BY seq)) b WHERE state >= 3 GROUP BY entity_id""")
def a_wait_until(spark, sf_dir):
    """The event at which each entity has been written three times, and how often a waiter would have tried."""
    return feed.first_when(activities(spark, sf_dir), F.when(F.col("kind") == feed.WRITE, 1).otherwise(0), lambda s: s >= 3)


@query(f"SELECT kind, count(*) AS n FROM ({ACTIVITY_SQL}) a WHERE (kind = 'GrainCall' OR seq % 4 <> 0) AND seq % 10 <> 0 AND NOT (kind = 'GrainCall' AND seq % 3 = 0) GROUP BY kind")
def a_ingest(spark, sf_dir):
    """Failed storage operations, suppressed scopes and calls of the runtime give no event; failed calls do."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity_id"), "event_type")
    operation = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "error", "clear")
    raw = e.withColumns({"operation": operation, "ok": F.col("event_id") % 4 != 0, "hidden": F.col("event_id") % 10 == 0, "iface": F.when(F.col("event_id") % 3 == 0, "host.IX").otherwise("IUser")})
    return feed.ingest(raw, interface="iface", system_prefix="host.", succeeded="ok", suppressed="hidden").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT store, count(*) AS n FROM (SELECT 'hot' AS store FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'cold' FROM events WHERE event_id % 2 = 1) s GROUP BY store")
def a_stores(spark, sf_dir):
    """Feeds of several stores; a store that is named twice counts once."""
    e = table(spark, sf_dir, "events").select("event_id")
    hot, cold = e.where(F.col("event_id") % 2 == 0), e.where(F.col("event_id") % 2 == 1)
    return feed.stores(("hot", hot), ("cold", cold), ("hot", hot), known={"hot", "cold"}).groupBy("store").agg(F.count("*").alias("n"))


# Inventory reports: parts as packages, their types as versions, sizes as files.

@query("""SELECT p_brand AS package, len(list_distinct(list(p_type))) AS n_versions, list_sort(list_distinct(list(p_type)))[1] AS first_version FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1""")
def t_version_conflicts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_type").alias("version"), F.col("p_size").cast("string").alias("file"))
    return reports.version_conflicts(p).select("package", F.size("versions").cast("long").alias("n_versions"), F.get("versions", 0).alias("first_version"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O' AND l_discount > 0.05) AS open_discount FROM lineitem GROUP BY l_orderkey")
def t_any_by(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return reports.any_by(l, "l_orderkey", returned=F.col("l_returnflag") == "R", open_discount=(F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.05))


@query("""SELECT p_brand, p_size, string_agg(concat('- ', p_name, ' ', p_partkey), chr(10) ORDER BY p_name, p_partkey) AS details FROM
  (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_name, p_partkey) AS n FROM part) p WHERE n <= 30 GROUP BY p_brand, p_size""")
def t_top_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return reports.top_lines(p, ["p_brand", "p_size"], ["p_name", "p_partkey"], F.concat(F.lit("- "), F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS key, arg_min(o_orderpriority, o_orderkey) AS title, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_details, count(DISTINCT o_orderstatus) AS n_acceptance FROM orders GROUP BY o_custkey""")
def t_merge_findings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("title"), F.lit("s").alias("scope"), F.lit("c").alias("category"), F.lit("x").alias("summary"), F.when(F.col("o_orderstatus") == "F", "  ").otherwise(F.col("o_orderstatus")).alias("detail"), F.array("o_orderstatus").alias("acceptance"))
    return reports.merge_findings(o).select("key", "title", F.size("details").cast("long").alias("n_details"), F.size("acceptance").cast("long").alias("n_acceptance"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def t_members(spark, sf_dir):
    names = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return reports.members(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey").select("o_orderkey")


@query("""SELECT concat('K', k) AS key, coalesce(i, 0) AS number, CASE WHEN i IS NULL THEN 'create' WHEN p IS NOT NULL AND i % 3 = 0 THEN 'reopen' WHEN p IS NOT NULL THEN 'update' ELSE 'close' END AS action FROM
  (SELECT coalesce(c.c_custkey, s.s_suppkey) AS k, c.c_custkey AS p, s.s_suppkey AS i FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey) x WHERE p IS NOT NULL OR i % 3 <> 0""")
def t_upserts(spark, sf_dir):
    """Create, update, reopen, and close what a complete inventory no longer names."""
    payloads = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == 0).select(F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("key"))
    issues = table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_suppkey").alias("number"), F.when(F.col("s_suppkey") % 3 == 0, "closed").otherwise("open").alias("state"))
    return reports.upserts(payloads, issues, complete=True).withColumns({"key": F.upper("key"), "number": F.coalesce("number", F.lit(0))})


@query("""SELECT c_mktsegment, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS INTEGER) AS place, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY place""")
def t_custom_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return c.select("c_mktsegment", reports.rank_of(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"]).cast("int").alias("place"), "n").orderBy("place")


@query("""SELECT event_id AS seq, CAST(CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 2 END AS INTEGER) AS section,
  concat('change ', event_id) AS description FROM events WHERE (event_type IN ('click', 'view') OR event_id % 5 = 0) AND event_id % 7 <> 0""")
def t_commits(spark, sf_dir):
    """Conventional commits made from events: click = feat, view = fix, others are types that notes skip."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type")
    kind = F.when(F.col("event_type") == "click", "feat").when(F.col("event_type") == "view", "Fix").otherwise("chore")
    message = F.concat(kind, F.when(F.col("seq") % 2 == 0, "(core)").otherwise(""), F.when((F.col("seq") % 5 == 0) & (F.col("seq") % 2 == 0), "!").otherwise(""), F.lit(": change "), F.col("seq").cast("string"),
                       F.when(F.col("seq") % 7 == 0, "\n\n[skip notes]").when(F.col("seq") % 5 == 0, "\n\nBREAKING CHANGE: it breaks\nSigned-off-by: me").otherwise(""))
    return reports.classify_commits(e.withColumn("message", message)).select("seq", F.col("section").cast("int").alias("section"), "description")


@query("SELECT s_name AS scope, 'v9' AS target, c AS collection, concat('p', n) AS package FROM supplier, (VALUES ('topLevelPackages', 1), ('topLevelPackages', 2), ('transitivePackages', 3)) v(c, n)")
def t_unroll(spark, sf_dir):
    package = lambda n: F.struct(F.lit(f"p{n}").alias("id"), F.lit("1").alias("requestedVersion"), F.lit("1").alias("resolvedVersion"))
    targets = F.array(F.struct(F.lit("v9").alias("target"), F.array(package(1), package(2)).alias("topLevelPackages"), F.array(package(3)).alias("transitivePackages")))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("scope"), F.lit("x").alias("project"), targets.alias("targets"))
    return reports.unrolled(s).select("scope", "target", "collection", "package")
