"""Validated typed scalars: parse, try-parse, validate, compare, format and JSON codecs for one-field value types.

A type is an entry on the driver: a Spark type, a rule and an Empty value. Its operations are column expressions; a column
holds the plain value. Empty is the type's default and bypasses the rule; an Empty string is '' from outside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ZERO_GUID = "00000000-0000-0000-0000-000000000000"


@dataclass(frozen=True)
class Kind:
    """An underlying type: its Spark type, its default, the text it parses, and its OpenAPI type and format."""

    spark: T.DataType
    empty: Any
    pattern: str | None
    openapi: tuple[str, str | None] | None
    low: int | None = None
    high: int | None = None
    null_is_empty: bool = False
    comparable: bool = True
    formattable: bool = True


DIGITS = r"^\s*[+-]?[0-9]+\s*$"
REAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE, TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
KINDS: dict[str, Kind] = {
    "string": Kind(T.StringType(), "", None, ("string", None), null_is_empty=True, formattable=False),
    "bool": Kind(T.BooleanType(), False, r"^\s*(?i:true|false)\s*$", ("boolean", None), formattable=False),
    "byte": Kind(T.ShortType(), 0, DIGITS, ("integer", "uint8"), 0, 255),
    "sbyte": Kind(T.ByteType(), 0, DIGITS, None),
    "bytes": Kind(T.BinaryType(), b"", None, ("string", "byte"), comparable=False, formattable=False),
    "short": Kind(T.ShortType(), 0, DIGITS, ("integer", "int16")),
    "ushort": Kind(T.IntegerType(), 0, DIGITS, ("integer", "uint16"), 0, (1 << 16) - 1),
    "int": Kind(T.IntegerType(), 0, DIGITS, ("integer", "int32")),
    "uint": Kind(T.LongType(), 0, DIGITS, ("integer", "uint32"), 0, (1 << 32) - 1),
    "long": Kind(T.LongType(), 0, DIGITS, ("integer", "int64")),
    "ulong": Kind(T.DecimalType(20, 0), 0, DIGITS, ("integer", "uint64"), 0, (1 << 64) - 1),
    "float": Kind(T.FloatType(), 0.0, REAL, ("number", "float")),
    "double": Kind(T.DoubleType(), 0.0, REAL, ("number", "double")),
    "decimal": Kind(T.DecimalType(38, 10), 0, REAL, ("number", "double")),
    "datetime": Kind(T.TimestampNTZType(), "0001-01-01 00:00:00", rf"^{DATE}([T ]{TIME})?$", ("string", "date-time")),
    "datetimeoffset": Kind(T.TimestampType(), "0001-01-01 00:00:00+00:00", rf"^{DATE}([T ]{TIME}(Z|[+-]\d{{2}}:\d{{2}})?)?$", ("string", "date-time")),
    "date": Kind(T.DateType(), "0001-01-01", rf"^{DATE}$", ("string", "date")),
    "time": Kind(T.StringType(), "00:00:00", rf"^{TIME}$", ("string", "time")),
    "timespan": Kind(T.DayTimeIntervalType(), "INTERVAL '0' SECOND", None, None),
    "guid": Kind(T.StringType(), ZERO_GUID, GUID, ("string", "uuid")),
    "char": Kind(T.StringType(), "\0", r"^[\s\S]$", ("string", "char"), formattable=False),
    "uri": Kind(T.StringType(), "", r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$|^[^\s:]+$", ("string", "uri"), comparable=False),
}


@dataclass(frozen=True)
class Typed:
    """A named value type. ``rule`` is a boolean expression over the value; ``overrides`` replaces operations by name."""

    name: str
    kind: str
    rule: Callable[[Column], Column] | None = None
    overrides: dict[str, Callable] = field(default_factory=dict)

    @property
    def base(self) -> Kind:
        return KINDS[self.kind]

    @property
    def operations(self) -> frozenset[str]:
        """Which operations the underlying type can back."""
        extra = (["compare"] if self.base.comparable else []) + (["format"] if self.base.formattable else [])
        return frozenset(["construct", "parse", "try_parse", "equals", "to_string", "read_json", "write_json", *extra])

    def _call(self, name: str, default: Callable, *args):
        return self.overrides.get(name, default)(*args)

    def empty(self) -> Column:
        if self.kind == "timespan":
            return F.expr(self.base.empty)
        return F.lit(self.base.empty).cast(self.base.spark)

    def is_valid(self, value: Column) -> Column:
        """The rule, and the range of unsigned types. NULL is not valid."""
        good = value.isNotNull()
        if self.base.low is not None:
            good = good & value.between(F.lit(str(self.base.low)).cast("decimal(20,0)"), F.lit(str(self.base.high)).cast("decimal(20,0)"))
        if self.base.pattern and isinstance(self.base.spark, T.StringType):
            good = good & value.rlike(self.base.pattern)
        return self._call("is_valid", lambda v: F.coalesce(good & (self.rule(v) if self.rule else F.lit(True)), F.lit(False)), value)

    def construct(self, value: Column) -> Column:
        """The value; an error where the rule is broken."""
        return self._call("construct", self._construct, value)

    def _construct(self, value: Column) -> Column:
        shown = F.coalesce(value.cast("string"), F.lit("null"))
        bad = F.raise_error(F.concat(F.lit(f"The value is not valid for {self.name}: "), shown)).cast(self.base.spark)
        return F.when(self.is_valid(value), value.cast(self.base.spark)).otherwise(bad)

    def raw(self, text: Column) -> Column:
        """The underlying parse: NULL where the text has not the type's form. Strings are taken as they are."""
        kind = self.base.spark
        if self.kind == "string":
            return text
        if self.kind == "bytes":
            return F.try_to_binary(text, F.lit("base64"))
        if self.kind == "timespan":
            return F.when(text.rlike(r"^-?(\d+\.)?\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"), self._interval(text))
        return F.when(text.rlike(self.base.pattern), text if isinstance(kind, T.StringType) else F.trim(text).try_cast(kind))

    @staticmethod
    def _interval(text: Column) -> Column:
        part = lambda n: F.coalesce(F.nullif(F.regexp_extract(text, r"^-?(?:(\d+)\.)?(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?$", n), F.lit("")), F.lit("0"))
        size = F.make_dt_interval(part(1).cast("int"), part(2).cast("int"), part(3).cast("int"), part(4).cast("decimal(18,6)"))
        return F.when(text.startswith("-"), -size).otherwise(size)

    def parse(self, text: Column) -> Column:
        return self._call("parse", lambda t: self.construct(self.raw(t)), text)

    def try_parse(self, text: Column) -> Column:
        """struct<ok, value>; Empty where it fails."""

        def default(t: Column) -> Column:
            value = self.raw(t)
            good = t.isNotNull() & self.is_valid(value)
            return F.struct(good.alias("ok"), F.when(good, value).otherwise(self.empty()).alias("value"))

        return self._call("try_parse", default, text)

    def value(self, column: Column) -> Column:
        """What a reader sees: a string that is NULL inside reads as ''."""
        return F.coalesce(column, F.lit("")) if self.base.null_is_empty else column

    def compare(self, left: Column, right: Column) -> Column:
        """-1, 0 or 1; a value is greater than NULL. Strings compare in the Unicode collation."""
        if "compare" in self.overrides:
            return self.overrides["compare"](left, right)
        if not self.base.comparable:
            raise TypeError(f"{self.name} has no order")
        a, b = (F.collate(left, "UNICODE"), F.collate(right, "UNICODE")) if self.kind == "string" else (left, right)
        return F.when(left.isNull() & right.isNull(), 0).when(right.isNull(), 1).when(left.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0)

    def equals(self, left: Column, right: Column) -> Column:
        return self._call("equals", lambda a, b: a.eqNullSafe(b), left, right)

    def less(self, left: Column, right: Column) -> Column:
        return self.compare(left, right) < 0

    def less_or_equal(self, left: Column, right: Column) -> Column:
        return self.compare(left, right) <= 0

    def greater(self, left: Column, right: Column) -> Column:
        return self.compare(left, right) > 0

    def greater_or_equal(self, left: Column, right: Column) -> Column:
        return self.compare(left, right) >= 0

    def to_string(self, column: Column, pattern: str | None = None) -> Column:
        """The text; with a pattern, printf's for numbers and date_format's for dates."""
        if "to_string" in self.overrides:
            return self.overrides["to_string"](column)
        if pattern is None:
            return F.coalesce(column.cast("string"), F.lit("")) if self.base.null_is_empty else column.cast("string")
        if not self.base.formattable:
            raise TypeError(f"{self.name} takes no format")
        return F.date_format(column, pattern) if isinstance(self.base.spark, T.DateType | T.TimestampType | T.TimestampNTZType) else F.format_string(pattern, column)

    def read_json(self, value: Column) -> Column:
        """A JSON member as the value: an invalid one is Empty, without an error. JSON null is Empty for strings, an error else."""

        def default(v: Column) -> Column:
            typed = v if not isinstance(self.base.spark, T.StringType) else v.cast("string")
            out = F.when(self.is_valid(typed), typed.cast(self.base.spark)).otherwise(self.empty())
            if self.base.null_is_empty:
                return out
            return F.when(v.isNull(), F.raise_error(F.lit(f"null is no value of {self.name}")).cast(self.base.spark)).otherwise(out)

        return self._call("read_json", default, value)

    def write_json(self, column: Column) -> Column:
        return self._call("write_json", lambda c: self.value(c), column)

    def read_keys(self, entries: Column) -> Column:
        """A map whose keys are parsed strictly, as property names are."""
        return F.transform_keys(entries, lambda k, _: self.parse(k))

    def write_keys(self, entries: Column) -> Column:
        return F.transform_keys(entries, lambda k, _: self.to_string(k))


def typed(name: str, kind: str, rule: Callable[[Column], Column] | None = None, **overrides: Callable) -> Typed:
    if kind not in KINDS:
        raise ValueError(f"'{name}' has the unsupported underlying type '{kind}'")
    unknown = set(overrides) - {"is_valid", "construct", "parse", "try_parse", "equals", "compare", "to_string", "read_json", "write_json"}
    if unknown:
        raise ValueError(f"'{name}' overrides unknown operations: {', '.join(sorted(unknown))}")
    return Typed(name, kind, rule, overrides)


def openapi_schema(kind: str | Typed, array: bool = False) -> dict | None:
    """OpenAPI schema of a type, or of a list of it; None where the type has none."""
    entry = kind.base if isinstance(kind, Typed) else KINDS.get(kind)
    if entry is None or entry.openapi is None:
        return None
    schema = {"type": entry.openapi[0]} | ({"format": entry.openapi[1]} if entry.openapi[1] else {})
    return {"type": "array", "items": schema} if array else schema
