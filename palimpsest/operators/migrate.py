"""Migration of versioned JSON payloads as column expressions: classify, decode by the source's schema, apply the edge, report.

A payload takes one of these ways. ``target``: it is current. ``migrate``: an edge converts it. ``legacy``: it has no
discriminator and no edge claims its shape, so it is read as the target. ``null``: it is JSON null. ``error``: it can't be
read. Classification looks at the first property or the first element only; nothing is shuffled.

The way is found in this order: other shapes than objects by shape; ``{}`` by the undiscriminated edge; an object whose first
property has the target's discriminator name, or else a source's, by its value, which must be known; the undiscriminated
edge; a map edge; legacy.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import jsontext as J
from palimpsest.functions.jsontext import let
from palimpsest.plans.registry import Edge, Listed, Mapped, Metadata, Policy, Registry, RegistryError, Versioned

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Options:
    """How members are read and written."""

    naming: str = "exact"  # or camel
    case_insensitive: bool = False
    numbers_from_strings: bool = False
    unknown_members: str = "ignore"  # or error
    omit_nulls: bool = False
    pretty: bool = False
    validate: bool = True

    def json_name(self, member: str) -> str:
        if self.naming != "camel":
            return member
        head, *rest = re.split(r"_+", member)
        return head[:1].lower() + head[1:] + "".join(p[:1].upper() + p[1:] for p in rest)


def first_true(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return otherwise if out is None else out.otherwise(otherwise)


def same_name(name: str) -> Callable[[Column], Column]:
    return lambda entry: F.lower(entry["key"]) == name.lower()


def scalar_kind(kind) -> str | None:
    """The JSON token that a Spark type or member takes by itself: only strings, booleans and numbers have one."""
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return "number" if isinstance(kind, NUMBERS) else None


def element_of(source: Versioned):
    """What a list holds, or what a map's values are."""
    shape = source.shape
    return shape.item if isinstance(shape, Listed | Mapped) else shape.elementType if isinstance(shape, T.ArrayType) else shape.valueType


def element_shape(element) -> str:
    """object or array, for elements that are no scalars."""
    kind = element.kind if isinstance(element, Versioned) else "array" if isinstance(element, T.ArrayType | T.MapType) else "object"
    return "array" if kind in ("array", "map") else "object"


class Plan:
    """The compiled migration to one target. ``excluded`` are the types it is nested in, which are not migrated again."""

    def __init__(self, registry: Registry, target: Versioned, options: Options, excluded: frozenset = frozenset()):
        self.registry, self.target, self.options = registry, target, options
        self.inside = excluded | {target}
        self.metadata: Metadata = registry.metadata(target)
        self.edges: list[Edge] = registry.edges_to(target)
        self.policy = registry.policy_of(target)
        if self.policy is Policy.NULL and target.value_type:
            raise RegistryError(f"Migration failed for '{target.name}' can't give null: it is a value type.")

    # Facts: what classification needs of the text.

    @staticmethod
    def head(raw: Column) -> dict[str, Column]:
        """Parts of the prefix, as written; '' where there is none."""
        return {"r": F.regexp_extract(raw, J.ROOT_TOKEN, 1), "n": F.regexp_extract(raw, J.FIRST_TOKEN, 1), "t": F.regexp_extract(raw, J.FIRST_TOKEN, 2), "s": F.regexp_extract(raw, J.FIRST + J.STRING, 2)}

    def facts(self, raw: Column, head) -> list[Column]:
        root = J.token_kind(head["r"])
        fields = [
            root.alias("root"),
            (J.is_one_value(raw) if self.options.validate else root.isNotNull()).alias("valid"),
            F.when(head["t"] != "", J.unescaped(head["n"])).alias("name"),
            J.token_kind(head["t"]).alias("token"),
            F.when(head["t"] == '"', J.unescaped(head["s"])).alias("text"),
        ]
        for kind in ("array", "map"):
            if len(self.by_kind(kind)) > 1:
                fields += self.element_facts(raw, kind)
        return fields

    def fact_names(self) -> list[str]:
        more = [f"{kind}_{x}" for kind in ("array", "map") if len(self.by_kind(kind)) > 1 for x in ("token", "name", "text")]
        return ["root", "valid", "name", "token", "text", *more]

    def element_facts(self, raw: Column, kind: str) -> list[Column]:
        first = F.get_json_object(raw, "$[0]") if kind == "array" else J.extract(raw, J.FIRST + r"([\s\S]*)", 2)
        token = J.extract(raw, J.ELEMENT_TOKEN) if kind == "array" else J.extract(raw, J.FIRST_TOKEN, 2)
        return [J.token_kind(token).alias(f"{kind}_token"), J.unescaped(J.extract(first, J.FIRST_NAME)).alias(f"{kind}_name"), J.unescaped(J.extract(first, J.FIRST + J.STRING, 2)).alias(f"{kind}_text")]

    # Route: the way, the number of the edge, and the error.

    def by_kind(self, kind: str) -> list[int]:
        return [k for k, e in enumerate(self.edges) if e.source.kind == kind]

    def route(self, facts) -> Column:
        to = lambda way, edge=None, error=None: F.struct(F.lit(way).alias("way"), F.lit(edge).cast("int").alias("edge"), (error if isinstance(error, Column) else F.lit(error).cast("string")).alias("error"))
        legacy, target = to("legacy"), to("target")
        migrate = lambda k: to("migrate", k)
        ambiguous = to("error", None, f"Several edges to '{self.target.name}' take payloads of this shape: their source types are ambiguous.")
        unknown = F.when(F.trim(facts["text"]) == "", F.lit("Type discriminator cannot be null or empty.")).otherwise(F.concat(F.lit("No migrator was found for discriminator '"), facts["text"], F.lit(f"' to '{self.target.name}'.")))
        free = next((k for k, e in enumerate(self.edges) if e.source is self.target.undiscriminated_source), None)
        by_name = [(facts["text"] == e.metadata.discriminator, migrate(k)) for k, e in enumerate(self.edges)]
        not_text = (facts["token"] != "string", to("error", None, "Expected discriminator string."))
        known = first_true([not_text, (facts["text"] == self.metadata.discriminator, target), *by_name], to("error", None, unknown))
        known_to_source = first_true([not_text, *by_name], to("error", None, unknown))
        names: list[str] = []
        for e in self.edges:  # names that differ in case only count once: the first stays
            if e.metadata.property_name.lower() not in [n.lower() for n in names]:
                names.append(e.metadata.property_name)
        others = [n for n in names if n != self.metadata.property_name]
        rest = migrate(free) if free is not None else self.by_element(facts, "map", ambiguous, migrate, legacy)
        objects = [(facts["name"].isNull(), migrate(free) if free is not None else legacy), (facts["name"] == self.metadata.property_name, known)]
        if others:
            objects.append((facts["name"].isin(*others), known_to_source))
        scalars = []
        for token in ("string", "number", "bool"):
            fits = [k for k in self.by_kind("scalar") if scalar_kind(self.edges[k].source.shape) == token]
            if fits:
                scalars.append((facts["root"] == token, migrate(fits[0]) if len(fits) == 1 else ambiguous))
        return first_true(
            [
                (~facts["valid"] | facts["root"].isNull(), to("error", None, "Unexpected end of JSON payload.")),
                (facts["root"] == "null", to("null")),
                (facts["root"] == "object", first_true(objects, rest)),
                (facts["root"] == "array", self.by_element(facts, "array", ambiguous, migrate, legacy)),
                *scalars,
            ],
            legacy,
        )

    def by_element(self, facts, kind: str, ambiguous: Column, migrate: Callable, legacy: Column) -> Column:
        """One edge of a kind takes every payload of it. Of several, the first element decides: its token, its discriminator, its
        shape; if nothing does, the first edge."""
        among = self.by_kind(kind)
        if len(among) < 2:
            return migrate(among[0]) if among else legacy
        token = facts[f"{kind}_token"]
        elements = {k: element_of(self.edges[k].source) for k in among}
        pick = lambda fits: migrate(fits[0]) if len(fits) == 1 else ambiguous
        branches = [(token.isNull(), ambiguous)]
        for t in ("string", "number", "bool"):
            fits = [k for k in among if scalar_kind(elements[k]) == t]
            if fits:
                branches.append((token == t, pick(fits)))
        named: dict[tuple[str, str], list[int]] = {}
        for k in among:
            data = self.registry.element_metadata(elements[k]) if isinstance(elements[k], Versioned) else None
            if data is not None:
                named.setdefault((data.property_name, data.discriminator), []).append(k)
        for (name, discriminator), fits in named.items():
            branches.append(((token == "object") & (facts[f"{kind}_name"] == name) & (facts[f"{kind}_text"] == discriminator), pick(fits)))
        for t in ("object", "array"):
            fits = [k for k in among if scalar_kind(elements[k]) is None and element_shape(elements[k]) == t]
            if fits:
                branches.append((token == t, pick(fits)))
        return first_true(branches, migrate(among[0]))

    # Decoding: struct<value, error>.

    def decode(self, raw: Column, kind: Versioned, root: Column | None = None) -> Column:
        wrong = F.lit(f"The JSON value could not be converted to '{kind.name}'.")
        nested = {m: s for m, s in kind.members().items() if isinstance(s, Versioned | Listed | Mapped)} if kind.kind == "object" else {}
        error = wrong
        if kind.kind == "object" and self.options.unknown_members == "error":
            allowed = [self.options.json_name(m) for m in kind.members()] + [self.registry.metadata(kind).property_name]
            extra = F.size(F.array_except(F.json_object_keys(raw), F.array(*[F.lit(a) for a in allowed]))) > 0
        else:
            extra = None
        flat = self.flat_value(raw, kind)

        def build(value: Column) -> Column:
            fits = value.isNotNull() if root is None or kind.kind == "scalar" else value.isNotNull() & (root == ("object" if kind.kind in ("object", "map") else "array"))
            made, problems = self.with_nested(value, kind, nested)
            first = F.coalesce(*problems) if problems else F.lit(None).cast("string")
            out = F.struct(made.alias("value"), first.alias("error"))
            bad = F.struct(F.lit(None).cast(self.schema(kind)).alias("value"), error.alias("error"))
            fits = fits if extra is None else fits & ~F.coalesce(extra, F.lit(False))
            return F.when(fits, out).otherwise(bad)

        return let(flat, build)

    def flat_value(self, raw: Column, kind: Versioned) -> Column:
        """The value with nested versioned members still as JSON text."""
        if kind.kind != "object":
            return J.decoded(raw, self.flat_type(kind.shape))
        names = {m: self.options.json_name(m) for m in kind.members()}
        types = {m: self.flat_type(s) for m, s in kind.members().items()}
        if self.options.case_insensitive:
            entries = F.map_entries(J.decoded(raw, T.MapType(T.StringType(), T.StringType())))

            def build(all_entries: Column) -> Column:
                found = {m: F.try_element_at(F.filter(all_entries, same_name(names[m])), F.lit(-1))["value"] for m in names}
                return F.when(all_entries.isNotNull(), F.struct(*[(found[m] if isinstance(types[m], T.StringType) else J.decoded(found[m], types[m])).alias(m) for m in names]))

            return let(entries, build)
        lenient = {m for m in names if self.options.numbers_from_strings and isinstance(types[m], NUMBERS)}
        row = J.decoded(raw, T.StructType([T.StructField(names[m], T.StringType() if m in lenient else types[m]) for m in names]))
        if not lenient and all(m == n for m, n in names.items()):
            return row

        def rename(r: Column) -> Column:
            bad = [r[names[m]].isNotNull() & r[names[m]].try_cast(types[m]).isNull() for m in lenient]
            value = F.struct(*[(r[names[m]].try_cast(types[m]) if m in lenient else r[names[m]]).alias(m) for m in names])
            fits = r.isNotNull()
            for b in bad:
                fits = fits & ~b
            return F.when(fits, value)

        return let(row, rename)

    def flat_type(self, shape) -> T.DataType:
        if isinstance(shape, Versioned):
            return T.StringType()
        if isinstance(shape, Listed):
            return T.ArrayType(T.StringType())
        if isinstance(shape, Mapped):
            return T.MapType(T.StringType(), T.StringType())
        return shape

    def with_nested(self, value: Column, kind: Versioned, nested: dict) -> tuple[Column, list[Column]]:
        if kind.kind != "object":
            if isinstance(kind.shape, Listed | Mapped):
                return self.nested_value(value, kind.shape)
            return value, []
        if not nested:
            return value, []
        fields, problems = [], []
        for m in kind.members():
            if m in nested:
                made, errors = self.nested_value(value[m], nested[m])
                fields.append(made.alias(m))
                problems += errors
            else:
                fields.append(value[m].alias(m))
        return F.struct(*fields), problems

    def nested_value(self, raw: Column, shape) -> tuple[Column, list[Column]]:
        item = shape.item if isinstance(shape, Listed | Mapped) else shape
        if item in self.inside:
            full = T.StructType([T.StructField(m, self.flat_type(s)) for m, s in item.members().items()]) if item.kind == "object" else self.schema(item)
            plain = lambda r: J.decoded(r, full)
            value = F.transform(raw, plain) if isinstance(shape, Listed) else F.transform_values(raw, lambda _, r: plain(r)) if isinstance(shape, Mapped) else plain(raw)
            return value, []
        plan = Plan(self.registry, item, self.options, self.inside)
        one = lambda r: plan.expression(r)
        shown = (lambda o: F.when(o["value"].isNotNull(), F.struct(*[o["value"][m].alias(m) for m in item.members()], F.coalesce(o["migrated"], F.lit(False)).alias("_migrated")))) if item.tracked and item.kind == "object" else (lambda o: o["value"])
        if isinstance(shape, Listed):
            all_of = F.transform(raw, one)
            return F.transform(all_of, shown), [F.array_min(F.filter(F.transform(all_of, lambda o: o["error"]), lambda e: e.isNotNull()))]
        if isinstance(shape, Mapped):
            all_of = F.transform_values(raw, lambda _, r: one(r))
            return F.transform_values(all_of, lambda _, o: shown(o)), [F.array_min(F.filter(F.transform(F.map_values(all_of), lambda o: o["error"]), lambda e: e.isNotNull()))]
        out = one(raw)
        return shown(out), [out["error"]]

    def schema(self, kind: Versioned) -> T.DataType:
        """The Spark type of a decoded value."""

        def of(shape, inside):
            if isinstance(shape, Listed):
                return T.ArrayType(of(shape.item, inside))
            if isinstance(shape, Mapped):
                return T.MapType(T.StringType(), of(shape.item, inside))
            if isinstance(shape, Versioned):
                if shape.kind != "object":
                    return of(shape.shape, inside | {shape})
                if shape in inside:
                    return T.StructType([T.StructField(m, self.flat_type(s)) for m, s in shape.members().items()])
                fields = [T.StructField(m, of(s, inside | {shape})) for m, s in shape.members().items()]
                return T.StructType(fields + ([T.StructField("_migrated", T.BooleanType())] if shape.tracked and shape is not kind else []))
            return shape

        return of(kind, self.inside - {kind}) if kind.kind == "object" else of(kind.shape, self.inside)

    # Edges.

    def applied(self, raw: Column, route) -> Column:
        """struct<ok, value, error> of the routed edge."""
        kind = self.schema(self.target)
        none = F.struct(F.lit(False).alias("ok"), F.lit(None).cast(kind).alias("value"), F.lit(None).cast("string").alias("error"))

        def run(edge: Edge) -> Callable[[Column], Column]:
            def body(source: Column) -> Column:
                made = edge.apply(source["value"])
                ok, value = made if isinstance(made, tuple) else (F.lit(True), made)
                ok = F.coalesce(ok, F.lit(False))
                good = source["error"].isNull() & ok
                return F.struct(good.alias("ok"), F.when(good, value.cast(kind)).alias("value"), source["error"].alias("error"))

            return body

        branches = [(route["edge"] == k, let(self.decode(raw, e.source), run(e))) for k, e in enumerate(self.edges)]
        return first_true(branches, none)

    def verdict(self, route, applied: Column) -> dict[str, Column]:
        """Path, source, status and tracking flag."""
        migrated = route["way"] == "migrate"
        names = first_true([(route["edge"] == k, F.lit(e.source.name)) for k, e in enumerate(self.edges)], F.lit(None).cast("string"))
        fell_back = self.policy is Policy.FALL_BACK
        tracked = F.when(route["way"] == "legacy", True).when(route["way"] == "target", False).when(migrated & applied["ok"], True)
        if fell_back:
            tracked = tracked.when(migrated & applied["error"].isNull(), False)
        return {"path": route["way"], "source": names, "status": F.when(migrated, F.when(applied["ok"], "success").otherwise("failure")), "migrated": tracked}

    def outcome(self, raw: Column, facts, route, applied: Column) -> Column:
        """struct<value, error>."""
        failed = (route["way"] == "migrate") & ~applied["ok"] & applied["error"].isNull()
        read = route["way"].isin("target", "legacy")
        if self.policy is Policy.FALL_BACK:
            read = read | failed
        failure = F.concat(F.lit("Migration failed for '"), self.verdict(route, applied)["source"], F.lit(f"' to '{self.target.name}'."))

        def build(own: Column) -> Column:
            error = F.coalesce(route["error"], applied["error"], own["error"])
            if self.policy is Policy.THROW:
                error = F.coalesce(error, F.when(failed, failure))
            value = F.when(applied["ok"], applied["value"]).otherwise(own["value"])
            if self.target.after_decode is not None:
                value = F.when(value.isNotNull(), self.target.after_decode(value))
            return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))

        empty = F.struct(F.lit(None).cast(self.schema(self.target)).alias("value"), F.lit(None).cast("string").alias("error"))
        return let(F.when(read, self.decode(raw, self.target, facts["root"])).otherwise(empty), build)

    def expression(self, raw: Column) -> Column:
        """struct<value, error, migrated> of a payload, as one expression; NULL text is SQL NULL."""

        def whole(facts: Column) -> Column:
            return let(self.route(facts), lambda r: let(self.applied(raw, r), lambda a: finish(facts, r, a)))

        def finish(facts: Column, route: Column, applied: Column) -> Column:
            flag = self.verdict(route, applied)["migrated"]
            return let(self.outcome(raw, facts, route, applied), lambda o: F.struct(o["value"].alias("value"), o["error"].alias("error"), flag.alias("migrated")))

        empty = F.struct(F.lit(None).cast(self.schema(self.target)).alias("value"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("boolean").alias("migrated"))
        return F.when(raw.isNull(), empty).otherwise(let(F.struct(*[c.alias(n) for n, c in self.head(raw).items()]), lambda h: let(F.struct(*self.facts(raw, h)), whole)))


class MigrationEngine:
    """Compiles targets once and applies them to DataFrames."""

    def __init__(self, registry: Registry, options: Options | None = None):
        self.registry, self.options = registry, options or Options()
        self._plans: dict[Versioned, Plan] = {}

    def plan(self, target: Versioned) -> Plan:
        if target not in self._plans:
            self._plans[target] = Plan(self.registry, target, self.options)
        return self._plans[target]

    def migrate(self, df: DataFrame, payload: str, target: Versioned, on_error: str = "raise", value: str = "value") -> DataFrame:
        """``df`` with the decoded value and _path, _source, _status, _migrated, _error.

        ``on_error='raise'`` fails the query once the value of a bad row is read (a plan that prunes the value, as a bare count
        does, raises nothing); ``'column'`` leaves the value NULL and the reason in ``_error``.
        """
        if on_error not in ("raise", "column"):
            raise ValueError("on_error is 'raise' or 'column'")
        plan = self.plan(target)
        raw = F.col(payload)
        # Facts and route are rows made by a generator: a filter on the result can't be pushed through one, so their expressions
        # are neither inlined into the predicate nor computed twice. Decoding stays a projection, pruned where nothing reads it.
        names = plan.fact_names()
        parts = plan.head(raw)
        steps = df.select("*", *[c.alias(f"__h{n}") for n, c in parts.items()])
        head = {n: F.col(f"__h{n}") for n in parts}
        steps = steps.select("*", F.inline(F.array(F.struct(*plan.facts(raw, head)))).alias(*[f"__{n}" for n in names]))
        facts = {n: F.col(f"__{n}") for n in names}
        steps = steps.select("*", F.inline(F.array(plan.route(facts))).alias("__way", "__edge", "__problem"))
        route = {"way": F.col("__way"), "edge": F.col("__edge"), "error": F.col("__problem")}
        steps = steps.withColumn("__applied", plan.applied(raw, route))
        steps = steps.withColumn("__out", plan.outcome(raw, facts, route, F.col("__applied")))
        null, error, shown = raw.isNull(), F.col("__out.error"), F.col("__out.value")
        error = F.when(~null, error)
        shown = F.when(~null, shown)
        if on_error == "raise":
            shown = F.when(error.isNotNull(), F.raise_error(error).cast(plan.schema(target))).otherwise(shown)
        verdict = plan.verdict(route, F.col("__applied"))
        said = [(F.when(null, "null").otherwise(c) if n == "path" else F.when(~null, c)).alias(f"_{n}") for n, c in verdict.items()]
        return steps.select(*df.columns, shown.alias(value), *said, error.alias("_error"))

    def encode(self, value: Column, target: Versioned) -> Column:
        """JSON text with the discriminator as first property, unless the type has a member of that name."""
        options = {"ignoreNullFields": str(self.options.omit_nulls).lower(), "pretty": str(self.options.pretty).lower()}
        shaped = self._tagged(value, target)
        return F.to_json(shaped, options) if target.kind != "scalar" else F.get_json_object(F.to_json(F.struct(value.alias("v"))), "$.v")

    def _tagged(self, value: Column, shape) -> Column:
        if isinstance(shape, Listed):
            return F.transform(value, lambda v: self._tagged(v, shape.item))
        if isinstance(shape, Mapped):
            return F.transform_values(value, lambda _, v: self._tagged(v, shape.item))
        if not isinstance(shape, Versioned):
            return value
        if shape.kind != "object":
            return self._tagged(value, shape.shape)
        data = self.registry.metadata(shape)
        names = {m: self.options.json_name(m) for m in shape.members()}
        lead = [] if data.property_name in names.values() else [F.lit(data.discriminator).alias(data.property_name)]
        return F.when(value.isNotNull(), F.struct(*lead, *[self._tagged(value[m], s).alias(names[m]) for m, s in shape.members().items()]))

    def rewritten(self, df: DataFrame, payload: str, target: Versioned, on_error: str = "raise") -> DataFrame:
        """The rows whose payload isn't current, with the payload in its current form: what a store writes back. Rows with an
        error are no such rows where ``on_error`` is 'column'."""
        done = self.migrate(df, payload, target, value="__value", on_error=on_error)
        return done.where(F.col("_migrated") & F.col("_error").isNull()).withColumn(payload, self.encode(F.col("__value"), target)).select(*df.columns)


def migration_counts(migrated: DataFrame, target: Versioned, *by: str) -> DataFrame:
    """Migrations by source, target and status, and by further columns. Current and legacy payloads aren't migrations."""
    rows = migrated.where(F.col("_path") == "migrate")
    return rows.groupBy(F.col("_source").alias("source_type"), F.lit(target.name).alias("target_type"), F.col("_status").alias("status"), *by).agg(F.count("*").alias("migrations"))


def observed(migrated: DataFrame, name: str) -> DataFrame:
    """``migrated`` with a running count of successes and failures, for batch observations and streaming progress."""
    return migrated.observe(name, F.count_if(F.col("_status") == "success").alias("success"), F.count_if(F.col("_status") == "failure").alias("failure"))
