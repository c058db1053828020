"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its bytes. A ledger holds which (blob, rule version) pairs have been
scanned and what was found; a scan takes only pairs the ledger lacks, and findings are joined back to every path whose
content is that blob.

Defined cases: a null text is the empty text; repeated rows each get a result; a null id stays null; an empty table gives
no row; other columns are ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import scratch, table

SPANS = "array<struct<start:int,end:int,kind:string,rule:string>>"
FOUND = "array<struct<start:int,kind_no:int,kind:string,end:int,rule:string>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; one whose ``group`` is under ``least`` characters is dropped."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed patterns of the contract, in its order. A run of under 32 or 16 characters can't hold a longer one, so those two
# carry their least length in the pattern; the assignment can't, since a short value still uses up its text.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 16, 0, True),
    Rule("hex", 1, r"[0-9a-f]{32,}", 32, 0, True),
)
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule. The pieces between matches and the matches themselves, measured in turn, give the positions."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    rows = F.arrays_zip(pieces.alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("size"), F.transform(value, lambda x: F.length(x)).alias("value"))
    empty = F.array().cast(SPANS)
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, x):
        at = acc["at"] + x["gap"]
        end = at + F.coalesce(x["size"], F.lit(0))
        span = F.struct(at.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"))
        good = x["size"].isNotNull() & (x["value"] >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(empty)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of blobs (blob, text, todo), where ``todo`` lists the rules that the ledger lacks."""
    empty = F.array().cast(SPANS)
    found = [F.when(F.array_contains("todo", r.key), rule_spans(F.col("text"), r)).otherwise(empty) for r in rules]
    return blobs.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("spans"))


def update_ledger(docs: DataFrame, ledger: DataFrame | None, folder: str, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the (blob, rule version) pairs of ``docs`` that ``ledger`` lacks, store them under ``folder``, return the whole ledger: the given rows and the new ones.

    Which row of each unseen blob is read is settled from (digest, row key) alone; the texts then pass one exchange in
    which every row has its own key, so thousands of copies of one blob don't meet.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("blob", F.sha2("text", 256))
    unseen = rows.groupBy("blob").agg(F.min("id").alias("id"))
    if ledger is None:
        unseen = unseen.withColumn("todo", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        unseen = unseen.join(seen, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").where(F.size("todo") > 0)
    match = unseen.withColumnsRenamed({"blob": "b", "id": "i"}).hint("shuffle_hash")
    texts = rows.join(match, (F.col("blob") == F.col("b")) & F.col("id").eqNullSafe(F.col("i"))).select("blob", "text", "todo")
    spark, path = docs.sparkSession, f"{folder}/scan-{uuid.uuid4().hex}"
    scan(texts, rules).write.parquet(path)
    new = spark.read.schema(LEDGER).parquet(path)
    return new if ledger is None else ledger.select("blob", "rules", "spans").unionByName(new)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of all scans stored under ``folder``."""
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(folder)


def findings(docs: DataFrame, ledger: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: its blob and the array of spans of the given rule versions, whose kinds are numbered as given."""
    number = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
    numbered = lambda s: F.struct(s["start"].alias("start"), F.element_at(number, s["rule"]).alias("kind_no"), s["kind"].alias("kind"), s["end"].alias("end"), s["rule"].alias("rule"))
    hits = ledger.select("blob", F.transform(F.filter("spans", lambda s: s["rule"].isin([r.key for r in rules])), numbered).alias("spans")).where(F.size("spans") > 0)
    hits = hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    rows = docs.select(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    return rows.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(FOUND)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``docs`` and return the findings of every row."""
    folder = folder or scratch(docs.sparkSession, "secret-ledger")
    return findings(docs, update_ledger(docs, ledger, folder, id_col, text_col, rules), id_col, text_col, rules)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_RULES))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _rule_sql(number: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    size = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {number} AS kind_no, '{rule.kind}' AS kind, {size("gap[1:i]")} + {size("hit[1:i - 1]")} AS s, {size("gap[1:i]")} + {size("hit[1:i]")} AS e
  FROM (SELECT doc_id, gap, hit, val, unnest(range(1, len(hit) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gap, regexp_extract_all(t, '{pattern}', 0) AS hit, regexp_extract_all(t, '{pattern}', {rule.group}) AS val
    FROM docs WHERE regexp_matches(t, '{pattern}')) a) b WHERE length(val[i]) >= {rule.least}"""


OP4_SQL = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(_rule_sql(k, r) for k, r in enumerate(RULES))}),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS c,
  string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, kind_no) FILTER (WHERE kind_no < {len(BASE_RULES)}) AS base, string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, kind_no) AS every FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs d LEFT JOIN by_doc f ON f.doc_id = d.doc_id"""
