"""Column functions over raw JSON text that look no further than they must."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING = r'"((?:[^"\\]|\\.)*)"'
FIRST = rf"^\s*\{{\s*{STRING}\s*:\s*"
FIRST_NAME = FIRST + "."
FIRST_STRING = FIRST + STRING
FIRST_TOKEN = FIRST + r"(.)"
ROOT_TOKEN = r"^\s*(.)"
ELEMENT_TOKEN = r"^\s*\[\s*(.)"
EMPTY_OBJECT = r"^\s*\{\s*\}\s*$"
EMPTY_ARRAY = r"^\s*\[\s*\]\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unescaped(raw: Column) -> Column:
    """The text of a JSON string's inside. Only strings with a backslash are parsed."""
    return F.when(raw.contains("\\"), F.get_json_object(F.concat(F.lit('{"a":"'), raw, F.lit('"}')), "$.a")).otherwise(raw)


def extract(json: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern, NULL where it doesn't match."""
    return F.when(json.rlike(pattern), F.regexp_extract(json, pattern, group))


def token_kind(first_character: Column) -> Column:
    """object, array, string, number, bool or null, from the first character of a JSON value."""
    return (
        F.when(first_character == "{", "object").when(first_character == "[", "array").when(first_character == '"', "string")
        .when(first_character.isin("t", "f"), "bool").when(first_character == "n", "null").when(first_character.rlike("[-0-9]"), "number")
    )


LENIENT = r"'|/[/*]|\]\s*,\s*\["  # what the quick count may take though it is no JSON: other quotes, comments, text beyond the value


def is_one_value(json: Column) -> Column:
    """Whether the text is exactly one well-formed JSON value. Texts that the quick count might wrongly take are parsed strictly,
    as a list's element and as a member, so that text that closes one of the two is found out by the other."""
    quick = F.coalesce(F.json_array_length(F.concat(F.lit("["), json, F.lit("]"))) == 1, F.lit(False))
    strict = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), json, F.lit("}"))).isNotNull()
    return quick & (~json.rlike(LENIENT) | strict)


def path_of(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def decoded(json: Column, kind: T.DataType, options: dict | None = None) -> Column:
    """The value as a Spark type, scalars included; NULL where it doesn't fit as a whole."""
    wrapped = F.concat(F.lit('{"v":'), json, F.lit("}"))
    schema = T.StructType([T.StructField("v", kind), T.StructField("_bad", T.StringType())])
    row = F.from_json(wrapped, schema, {"columnNameOfCorruptRecord": "_bad", **(options or {})})
    return let(row, lambda r: F.when(r["_bad"].isNull(), r["v"]))
