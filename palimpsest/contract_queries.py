"""More queries over the driver's tables: configuration, composition, codecs, file scans and sinks.

Files that a query scans are written by it to the shared folder first.
"""

from __future__ import annotations

import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.typed import openapi_schema, typed
from palimpsest.operators import reports
from palimpsest.operators.migrate import MigrationEngine, migration_counts
from palimpsest.plans.registry import Policy, Registry, RegistryError, Versioned, migration
from palimpsest.queries import I, OUTCOME_SQL, S, customer_payloads, customer_types, person, query, table, words
from palimpsest.sources import files


def parts(spark: SparkSession, sf_dir: str, *payload_parts) -> DataFrame:
    """(p_partkey, payload): one object a part, made of the given pieces of text and columns."""
    pieces = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in payload_parts]
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(*pieces).alias("payload"))


def labelled(*pieces):
    return F.struct(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces]).alias("label"))


LABEL = Versioned("Label", {"label": S}, discriminator="label")
BRAND = Versioned("BrandV1", {"brand": S}, discriminator="brand-v1")
SIZE = Versioned("SizeV1", {"size": I}, discriminator="size-v1")


def brand_or_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    brand = F.concat(F.lit('{"$type":"brand-v1","brand":"'), "p_brand", F.lit('"}'))
    size = F.concat(F.lit('{"$type":"size-v1","size":'), F.col("p_size").cast("string"), F.lit("}"))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, brand).otherwise(size).alias("payload"))


def labels(out: DataFrame) -> DataFrame:
    return out.select("p_partkey", F.col("_path").alias("path"), F.col("_source").alias("source"), F.col("value.label").alias("label"), F.col("_error").alias("error"))


class Labels:
    """A provider of two edges with state of its own."""

    def __init__(self, mark: str = "new"):
        self.mark = mark

    @migration(BRAND, LABEL)
    def brand(self, s):
        return labelled(self.mark, ":brand:", s["brand"])

    @migration(SIZE, LABEL)
    def size(self, s):
        return labelled(self.mark, ":size:", s["size"].cast("string"))


def _label_sql(mark: str) -> str:
    return f"""SELECT p_partkey, 'migrate' AS path, CASE WHEN p_partkey % 2 = 0 THEN 'BrandV1' ELSE 'SizeV1' END AS source,
  CASE WHEN p_partkey % 2 = 0 THEN concat('{mark}:brand:', p_brand) ELSE concat('{mark}:size:', p_size) END AS label, CAST(NULL AS VARCHAR) AS error FROM part"""


@query(_label_sql("new"))
def m_register_all(spark, sf_dir):
    """Every edge of a provider class."""
    return labels(MigrationEngine(Registry().register_all(Labels)).migrate(brand_or_size(spark, sf_dir), "payload", LABEL, on_error="column"))


@query(_label_sql("resolved"))
def m_resolver(spark, sf_dir):
    """The provider's instance comes from a resolver."""
    registry = Registry(resolver=lambda cls: cls("resolved")).register_all(Labels)
    return labels(MigrationEngine(registry).migrate(brand_or_size(spark, sf_dir), "payload", LABEL, on_error="column"))


@query(_label_sql("new"))
def m_scan(spark, sf_dir):
    """Edges found in a module; a class that can't be made is passed over."""

    class Unmade(Labels):
        def __init__(self, needed):
            super().__init__(needed)

    class Found(Labels):
        pass

    module = types.ModuleType("found")
    Unmade.__module__ = Found.__module__ = "found"
    module.Unmade, module.Found = Unmade, Found
    return labels(MigrationEngine(Registry().scan(module)).migrate(brand_or_size(spark, sf_dir), "payload", LABEL, on_error="column"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'migrate' WHEN 1 THEN 'target' ELSE 'error' END AS path, CASE WHEN p_partkey % 3 = 0 THEN 'Marked' END AS source,
  CASE p_partkey % 3 WHEN 0 THEN concat('m:', p_brand) WHEN 1 THEN p_brand END AS label,
  CASE WHEN p_partkey % 3 = 2 THEN 'No migrator was found for discriminator ''marked'' to ''Label''.' END AS error FROM part""")
def m_discriminator_source(spark, sf_dir):
    """Discriminators from a mark of the type, which hide its own, and a default property name; a type without a mark falls through."""
    marked = Versioned("Marked", {"brand": S}, discriminator="marked", marks={"alias": "by-mark"})
    registry = Registry().set_property_name("kind").discriminator_from(lambda v: v.marks.get("alias")).register(marked, LABEL, lambda s: labelled("m:", s["brand"]))
    p = table(spark, sf_dir, "part")
    body = F.concat(F.lit('"brand":"'), "p_brand", F.lit('"}'))
    form = F.col("p_partkey") % 3
    payload = F.when(form == 0, F.concat(F.lit('{"kind":"by-mark",'), body)).when(form == 1, F.concat(F.lit('{"kind":"label","label":"'), "p_brand", F.lit('"}'))).otherwise(F.concat(F.lit('{"kind":"marked",'), body))
    return labels(MigrationEngine(registry).migrate(p.select("p_partkey", payload.alias("payload")), "payload", LABEL, on_error="column"))


@query("""SELECT p_partkey, 'migrate' AS path, 'BrandV1' AS source, concat('own:', p_brand) AS label, CAST(NULL AS VARCHAR) AS error FROM part""")
def m_precedence(spark, sf_dir):
    """The target's own edge goes before a registered one of the same source."""
    target = Versioned("Label", {"label": S}, discriminator="label")
    target.migrates_from(BRAND)(lambda s: labelled("own:", s["brand"]))
    registry = Registry().register(BRAND, target, lambda s: labelled("registered:", s["brand"]))
    rows = parts(spark, sf_dir, '{"$type":"brand-v1","brand":"', F.col("p_brand"), '"}')
    return labels(MigrationEngine(registry).migrate(rows, "payload", target, on_error="column"))


@query(f"""SELECT c_custkey, path, source, CASE WHEN path = 'migrate' THEN CASE WHEN form = 1 AND s = 'BUILDING' THEN 'failure' ELSE 'success' END END AS status,
  CASE WHEN form = 1 AND s = 'BUILDING' THEN 'Migration failed for ''CustV2'' to ''CustV3''.' END AS error FROM ({OUTCOME_SQL}) o WHERE form = 1""")
def m_policy_throw(spark, sf_dir):
    """The default policy: the error names source and target."""
    registry, target = customer_types(fails=lambda s: s["segment"] == "BUILDING")
    out = MigrationEngine(registry).migrate(customer_payloads(spark, sf_dir), "payload", target, on_error="column")
    return out.where(F.col("_source") == "CustV2").select("c_custkey", F.col("_path").alias("path"), F.col("_source").alias("source"), F.col("_status").alias("status"), F.col("_error").alias("error"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS good, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS from_base, CASE WHEN p_partkey % 2 <> 0 THEN 'Migration failed for ''BrandV1'' to ''Silent''.' END AS error_of_silent FROM part""")
def m_policy_scopes(spark, sf_dir):
    """NULL from the base's annotation; a type that is annotated without a policy takes the registry's, not its base's."""
    base = Versioned("Base", {"label": S}, policy=Policy.NULL)
    plain, silent = Versioned("Plain", {"label": S}, base=base), Versioned("Silent", {"label": S}, discriminator="silent", base=base)
    edge = lambda s: (s["brand"] != "-", labelled(s["brand"]))
    registry = Registry(policy=Policy.THROW).register(BRAND, plain, edge).register(BRAND, silent, edge)
    brand = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("-")
    engine, rows = MigrationEngine(registry), parts(spark, sf_dir, '{"$type":"brand-v1","brand":"', brand, '"}')
    out = engine.migrate(rows, "payload", plain, on_error="column").select("p_partkey", "payload", F.col("value.label").alias("from_base"))
    out = engine.migrate(out, "payload", silent, on_error="column")
    return out.select("p_partkey", F.col("_error").isNull().alias("good"), "from_base", F.col("_error").alias("error_of_silent"))


def config_errors() -> list[tuple[str, str, str]]:
    """(case, type of error, text) of each configuration that is refused."""
    one, two = Versioned("One", {"a": S}, discriminator="x"), Versioned("Two", {"a": S}, discriminator="x")
    target, edge = Versioned("Target", {"a": S}), lambda s: s
    plan = lambda r, t: MigrationEngine(r).plan(t)
    cases = {
        "duplicate edge": lambda: Registry().register(one, target, edge).register(one, target, edge),
        "duplicate discriminator": lambda: plan(Registry().register(one, target, edge).register(two, target, edge), target),
        "external contract": lambda: plan(Registry(), Versioned("V", {"a": S}, external=object())),
        "no edge of the source": lambda: plan(Registry(), Versioned("V", {"a": S}, undiscriminated_source=one)),
        "polymorphic": lambda: plan(Registry(), Versioned("V", {"a": S}, polymorphic=True)),
        "no contract": lambda: Registry().register_all(object()),
        "blank name": lambda: Registry().set_property_name(" "),
        "unknown policy": lambda: Registry().set_policy("throw"),
    }
    out = []
    for name, run in cases.items():
        try:
            run()
            out.append((name, "none", ""))
        except RegistryError as e:
            out.append((name, type(e).__name__, str(e)))
    return out


@query("""SELECT n_nationkey, c AS case_name, k AS kind FROM nation, (VALUES ('duplicate edge', 'RegistryError'), ('duplicate discriminator', 'DuplicateDiscriminatorError'), ('external contract', 'InvalidTargetMigratorError'),
  ('no edge of the source', 'RegistryError'), ('polymorphic', 'RegistryError'), ('no contract', 'RegistryError'), ('blank name', 'RegistryError'), ('unknown policy', 'RegistryError')) v(c, k)""")
def m_config_errors(spark, sf_dir):
    """Refused configurations, the same for each nation's registry."""
    cases = F.array(*[F.struct(F.lit(c).alias("case_name"), F.lit(k).alias("kind")) for c, k, _ in config_errors()])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.inline(cases))


@query("""SELECT p_partkey, 'legacy' AS path, p_brand AS label, p_type AS inner_label, CAST(NULL AS VARCHAR) AS error FROM part""")
def m_recursion(spark, sf_dir):
    """A type inside itself is decoded there as it is, without migration."""
    node = Versioned("Node", {"label": S}, discriminator="node")
    node.shape["inner"] = node
    rows = parts(spark, sf_dir, '{"label":"', F.col("p_brand"), '","inner":{"$type":"node-v1","label":"', F.col("p_type"), '"}}')
    out = MigrationEngine(Registry()).migrate(rows, "payload", node, on_error="column")
    return out.select("p_partkey", F.col("_path").alias("path"), "value.label", F.col("value.inner.label").alias("inner_label"), F.col("_error").alias("error"))


@query("""SELECT p_partkey, 'migrate' AS path, CASE WHEN p_partkey % 2 = 0 THEN 'Ints' ELSE 'Strings' END AS source, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS label FROM part""")
def m_first_candidate(spark, sf_dir):
    """Lists whose first element fits no candidate, such as null, go to the first one."""
    text = lambda s: labelled(F.array_join(F.transform(s, lambda x: x.cast("string")), ","))
    registry = Registry().register(Versioned("Ints", T.ArrayType(I)), LABEL, text).register(Versioned("Strings", T.ArrayType(S)), LABEL, text)
    even = F.col("p_partkey") % 2 == 0
    p = table(spark, sf_dir, "part")
    payload = F.when(even, F.concat(F.lit("[null,"), F.col("p_size").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit('["'), "p_brand", F.lit('"]')))
    out = MigrationEngine(registry).migrate(p.select("p_partkey", payload.alias("payload")), "payload", LABEL, on_error="column")
    return out.select("p_partkey", F.col("_path").alias("path"), F.col("_source").alias("source"), "value.label")


@query("""SELECT c_custkey, 'CustV1' AS source, CASE WHEN c_custkey % 3 = 0 THEN 'failure' ELSE 'success' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN split_part(c_name, '#', 2) END AS last_name FROM customer""")
def m_composed(spark, sf_dir):
    """An edge made of two earlier ones; either step's failure fails the whole."""
    v1 = Versioned("CustV1", {"fullName": S}, discriminator="cust-v1")
    v3 = Versioned("CustV3", {"firstName": S, "lastName": S, "segment": S}, discriminator="cust-v3", policy=Policy.NULL)
    first = lambda s: (s["fullName"] != "?", F.struct(s["fullName"].alias("name")))
    second = lambda s: (F.lit(True), person(*words(s["name"]), F.lit(None).cast("string")))

    def both(s):
        ok, middle = first(s)
        good, made = second(middle)
        return ok & good, made

    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, "?").otherwise(F.replace("c_name", F.lit("#"), F.lit(" ")))
    rows = c.select("c_custkey", F.concat(F.lit('{"$type":"cust-v1","fullName":"'), name, F.lit('"}')).alias("payload"))
    out = MigrationEngine(Registry().register(v1, v3, both)).migrate(rows, "payload", v3, on_error="column")
    return out.select("c_custkey", F.col("_source").alias("source"), F.col("_status").alias("status"), F.col("value.lastName").alias("last_name"))


@query(f"SELECT path, source, count(*) AS n, count(*) FILTER (WHERE form IN (8, 9, 10, 12, 13)) AS n_errors FROM ({OUTCOME_SQL}) o GROUP BY path, source")
def m_event_store(spark, sf_dir):
    """Payloads in files, read as a stream and migrated on reading; the files stay as they are."""
    store, made = files.shared_folder(spark, "events"), files.shared_folder(spark, "migrated")
    customer_payloads(spark, sf_dir).select("payload").write.text(store)
    registry, target = customer_types()
    out = MigrationEngine(registry).migrate(files.payload_stream(spark, store), "payload", target, on_error="column")
    stream = out.select(F.col("_path").alias("path"), F.col("_source").alias("source"), F.col("_error").isNotNull().alias("bad"), F.col("value.lastName").alias("last_name"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{made}/_state").trigger(availableNow=True).start(f"{made}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{made}/rows").groupBy("path", "source").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_errors"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'migrate' ELSE 'target' END AS path, CASE WHEN p_partkey % 2 = 0 THEN concat('b:', p_brand) ELSE concat('read ', p_brand) END AS label FROM part""")
def m_lifecycle(spark, sf_dir):
    """A hook that runs when the target itself is read; migrated values don't pass it."""
    target = Versioned("Label", {"label": S}, discriminator="label", after_decode=lambda v: F.when(v["label"].startswith("b:"), v).otherwise(labelled("read ", v["label"])))
    registry = Registry().register(BRAND, target, lambda s: labelled("b:", s["brand"]))
    even = F.col("p_partkey") % 2 == 0
    rows = parts(spark, sf_dir, F.when(even, F.lit('{"$type":"brand-v1","brand":"')).otherwise('{"$type":"label","label":"'), F.col("p_brand"), '"}')
    out = MigrationEngine(registry).migrate(rows, "payload", target, on_error="column")
    return out.select("p_partkey", F.col("_path").alias("path"), "value.label")


MALFORMED = ("{'$type':'cust-v3','firstName':'a'}", "{/*c*/\"$type\":\"cust-v3\"}", '{"$type":"cust-v3"} x', '{"$type":"cust-v3"}],[2', '{"$type":"cust-v3"},{"v":1', '{"$type":"cust-v3"}', '{"$type":"cust-v3","firstName":"it\'s //fine"}', "[[1],[2]]", "01")
_quoted = ", ".join("'" + m.replace("'", "''") + "'" for m in MALFORMED)


@query(f"""SELECT c_custkey, CASE WHEN NOT json_valid(t) THEN 'error' WHEN json_type(t) = 'ARRAY' THEN 'migrate' ELSE 'target' END AS path, NOT json_valid(t) AS malformed FROM
  (SELECT c_custkey, list_extract([{_quoted}], CAST(c_custkey % {len(MALFORMED)} + 1 AS BIGINT)) AS t FROM customer) c""")
def m_malformed(spark, sf_dir):
    """Texts that lenient readers take for JSON: other quotes, comments, trailing text, numbers with a leading zero."""
    registry, target = customer_types()
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*[F.lit(m) for m in MALFORMED]), (F.col("c_custkey") % len(MALFORMED)).cast("int")).alias("payload"))
    out = MigrationEngine(registry).migrate(rows, "payload", target, on_error="column")
    return out.select("c_custkey", F.col("_path").alias("path"), (F.col("_path") == "error").alias("malformed"))


@query(f"""SELECT date_trunc('month', o_orderdate) AS month, source AS source_type, 'CustV3' AS target_type, 'success' AS status, count(*) AS migrations
  FROM ({OUTCOME_SQL}) p JOIN orders ON o_custkey = c_custkey WHERE path = 'migrate' GROUP BY 1, 2""")
def m_counters_by_month(spark, sf_dir):
    """Migrations in each month of orders."""
    registry, target = customer_types()
    rows = customer_payloads(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").alias("month")), F.col("c_custkey") == F.col("o_custkey"))
    return migration_counts(MigrationEngine(registry).migrate(rows, "payload", target, on_error="column"), target, "month")


# Typed scalars.

@query("SELECT p_partkey, p_size AS parsed, CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS from_json, p_brand AS name, coalesce(CASE WHEN p_size > 25 THEN p_brand END, '') AS name_or_empty FROM part")
def p_parse(spark, sf_dir):
    """Strict parsing of texts, and JSON members whose null is Empty for strings."""
    size, big, name = typed("Size", "int"), typed("Big", "int", lambda v: v > 25), typed("Name", "string")
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", size.parse(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("parsed"), big.read_json(F.col("p_size")).alias("from_json"),
                    name.parse(F.col("p_brand")).alias("name"), name.read_json(F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("name_or_empty"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 = 0 THEN -1 WHEN o_custkey < o_orderkey THEN -1 WHEN o_custkey > o_orderkey THEN 1 ELSE 0 END AS INTEGER) AS place,
  o_orderkey % 7 <> 0 AND o_custkey = o_orderkey AS same, o_orderkey % 7 = 0 OR o_custkey < o_orderkey AS less, o_orderkey % 7 = 0 OR o_custkey <= o_orderkey AS less_or_same FROM orders""")
def p_compare(spark, sf_dir):
    """Order and equality of typed values; NULL is less than any value."""
    key = typed("Key", "long")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey").cast("long")).alias("a"), F.col("o_orderkey").cast("long").alias("b"))
    a, b = F.col("a"), F.col("b")
    return o.select("o_orderkey", key.compare(a, b).cast("int").alias("place"), key.equals(a, b).alias("same"), key.less(a, b).alias("less"), key.less_or_equal(a, b).alias("less_or_same"))


@query("SELECT p_partkey, concat('#', p_brand) AS text, p_size * 2 AS doubled, p_size = 7 AS seven FROM part")
def p_overrides(spark, sf_dir):
    """Operations that a type replaces by its own."""
    mine = typed("Mine", "int", to_string=lambda c: F.concat(F.lit("#"), c), write_json=lambda c: c * 2, equals=lambda a, b: a == 7)
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", mine.to_string(F.col("p_brand")).alias("text"), mine.write_json(F.col("p_size")).alias("doubled"), mine.equals(F.col("p_size"), F.lit(0)).alias("seven"))


@query("""SELECT r_regionkey, k AS kind, o AS ordered, f AS formatted FROM region, (VALUES ('string', true, false), ('int', true, true), ('bytes', false, false), ('guid', true, true), ('uri', false, true), ('bool', true, false)) v(k, o, f)""")
def p_operations(spark, sf_dir):
    """Which operations an underlying type can back."""
    kinds = [(k, typed("X", k).operations) for k in ("string", "int", "bytes", "guid", "uri", "bool")]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit("compare" in o).alias("ordered"), F.lit("format" in o).alias("formatted")) for k, o in kinds])
    return table(spark, sf_dir, "region").select("r_regionkey", F.inline(rows))


@query("SELECT n_nationkey, 'array' AS outer_type, 'integer' AS inner_type, 'int32' AS inner_format FROM nation")
def p_openapi_arrays(spark, sf_dir):
    """The schema of a list of a typed value."""
    schema = openapi_schema(typed("Size", "int"), array=True)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lit(schema["type"]).alias("outer_type"), F.lit(schema["items"]["type"]).alias("inner_type"), F.lit(schema["items"]["format"]).alias("inner_format"))


# File scans and sinks.

def _written(spark: SparkSession, rows: DataFrame, label: str) -> str:
    """A folder with one file of text a task, a row of ``rows`` (text) each line."""
    path = files.shared_folder(spark, label)
    rows.write.text(path)
    return path


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS version, concat('r', n_regionkey) AS target FROM nation")
def s_xml(spark, sf_dir):
    """Attributes of elements, and the text of others, in XML files."""
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit('<project><Package Include="'), "n_name", F.lit('" Version="'), F.col("n_nationkey").cast("string"), F.lit('" /><Target>r'), F.col("n_regionkey").cast("string"), F.lit("</Target></project>"))
    found = files.whole_files(spark, _written(spark, n.repartition(25, "n_nationkey").select(F.concat(F.lit("<all>"), text, F.lit("</all>")).alias("text")), "xml"), "*.txt")
    one = found.select("file", F.posexplode(F.split(F.trim("text"), "\n")).alias("k", "text")).select(F.concat("file", F.lit("#"), F.col("k").cast("string")).alias("file"), "text")
    packages, targets = files.xml_attributes(one, "Package", ["Include", "Version"]), files.xml_values(one, "Target")
    return packages.join(targets, "file").select(F.col("Include").alias("name"), F.col("Version").alias("version"), F.col("value").alias("target"))


@query("SELECT p_partkey, p_brand, p_size FROM part")
def s_json(spark, sf_dir):
    """A JSON sink, and whole JSON files under a declared schema."""
    path = files.shared_folder(spark, "json")
    files.write_json(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), path)
    back = spark.read.text(path).select(F.from_json("value", "p_partkey long, p_brand string, p_size int").alias("r")).select("r.*")
    whole = files.shared_folder(spark, "json-whole")
    back.agg(F.to_json(F.array_sort(F.collect_list(F.struct("p_partkey", "p_brand", "p_size")))).alias("t")).write.text(whole)
    return files.json_files(spark, whole, "p_partkey long, p_brand string, p_size int")


@query("SELECT p_brand AS match, count(*) AS n FROM part GROUP BY p_brand")
def s_text(spark, sf_dir):
    """Matches of a pattern in whole text files."""
    p = table(spark, sf_dir, "part")
    path = _written(spark, p.select(F.concat(F.lit("uses: "), "p_brand", F.lit(" @ "), F.col("p_partkey").cast("string")).alias("text")), "text")
    return files.matches(files.whole_files(spark, path, "*.txt"), r"uses: (\S+) @").groupBy("match").agg(F.count("*").alias("n"))


@query("SELECT n_name AS method, CAST(n_nationkey AS VARCHAR) AS mean, CAST(NULL AS VARCHAR) AS missing FROM nation")
def s_markdown(spark, sf_dir):
    """Rows of a pipe table by the names of its columns."""
    n = table(spark, sf_dir, "nation")
    lines = n.select(F.struct("n_nationkey", F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |")).alias("line")).alias("x"))
    text = lines.agg(F.concat(F.lit("# Report\n\n| Mean | Method |\n|---:|---|\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")).alias("text"))
    return files.markdown_tables(files.whole_files(spark, _written(spark, text, "markdown"), "*.txt"), ["Method", "Mean", "Missing"]).select(F.col("Method").alias("method"), F.col("Mean").alias("mean"), F.col("Missing").alias("missing"))


@query("SELECT concat('feat: order ', o_orderkey) AS message FROM orders")
def s_log(spark, sf_dir):
    """A commit log whose messages end in a zero character."""
    o = table(spark, sf_dir, "orders")
    path = files.shared_folder(spark, "log")
    o.select(F.concat(F.lit("feat: order "), F.col("o_orderkey").cast("string")).alias("m")).write.option("lineSep", "\0").text(path)
    return files.commit_log(spark, path).select("message")


@query("SELECT concat('- ', n_name) AS line FROM nation")
def s_report(spark, sf_dir):
    """A text report in order, read back."""
    path = files.shared_folder(spark, "report")
    files.write_lines(table(spark, sf_dir, "nation").orderBy("n_name").select(F.concat(F.lit("- "), "n_name").alias("line")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey DESC, s_acctbal, s_suppkey) AS place FROM supplier ORDER BY place LIMIT 50")
def t_sorted(spark, sf_dir):
    """The head of a report by several keys, falling and rising."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    head = reports.sorted_by(s, (F.col("s_nationkey"), True), (F.col("s_acctbal"), False), (F.col("s_suppkey"), False)).limit(50)
    rows = head.agg(F.array_sort(F.collect_list(F.struct((-F.col("s_nationkey")).alias("a"), "s_acctbal", "s_suppkey"))).alias("r"))
    return rows.select(F.posexplode("r").alias("place", "x")).select("x.s_suppkey", (F.col("place") + 1).alias("place"))

