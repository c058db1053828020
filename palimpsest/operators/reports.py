"""Inventory reports: conflicts, any-aggregates, top rows a group, keyed merges, upserts and release notes, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTE_SECTIONS = ("BREAKING CHANGES:", "New Features:", "Bug Fixes:", "Performance:")  # fixed headings, in order
NOTE_TYPES = {"feat": 1, "fix": 2, "perf": 3}
BREAKS = ("BREAKING CHANGE", "BREAKING-CHANGE")  # fixed footer names of the commit convention
FOOTER_NAME = r"^[A-Za-z][A-Za-z-]*$"


def version_conflicts(rows: DataFrame, name: str = "package", version: str = "version", where: str = "file") -> DataFrame:
    """Names in use with more than one version, with the sorted list of versions and of places."""
    out = rows.groupBy(name).agg(F.array_sort(F.collect_set(version)).alias("versions"), F.array_sort(F.collect_set(where)).alias("places"))
    return out.where(F.size("versions") > 1).orderBy(name)


def any_by(rows: DataFrame, key: str, **tests: Column) -> DataFrame:
    """For each key, whether any row passes each test."""
    return rows.groupBy(key).agg(*[F.coalesce(F.bool_or(t), F.lit(False)).alias(n) for n, t in tests.items()])


def top_lines(rows: DataFrame, keys: list[str], order: list[str], line: Column, count: int = 30, separator: str = "\n") -> DataFrame:
    """For each key the first ``count`` rows in order, joined to one text. Ranks are cut before the lists are gathered."""
    window = Window.partitionBy(*keys).orderBy(*order)
    cut = rows.withColumn("_line", line).withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= count)
    gathered = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_all"))
    return gathered.select(*keys, F.array_join(F.col("_all._line"), separator).alias("details"))


def merge_findings(rows: DataFrame, key: str = "key", order: str = "seq", first: tuple[str, ...] = ("title", "scope", "category", "summary"), append: str = "detail", distinct: str = "acceptance") -> DataFrame:
    """One finding a key: the first row's fields, all non-blank details in order, and the distinct acceptance items by first use."""
    details = F.array_sort(F.collect_list(F.when(F.trim(F.coalesce(F.col(append), F.lit(""))) != "", F.struct(F.col(order), F.col(append)))))
    accepted = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(distinct))))
    out = rows.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in first], details.alias("_d"), accepted.alias("_a"))
    return out.select(key, *first, F.col(f"_d.{append}").alias("details"), F.array_distinct(F.flatten(F.filter(F.col(f"_a.{distinct}"), lambda x: x.isNotNull()))).alias("acceptance"))


def labels(category: Column, *more: Column) -> Column:
    """The labels of a finding: without blanks, each once, by first use."""
    every = F.array(F.lit("maintenance"), F.concat(F.lit("maintenance:"), category), *more)
    return F.array_distinct(F.filter(every, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))


def members(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the names."""
    return rows.join(names.select(key).distinct(), key, "left_semi")


def upserts(payloads: DataFrame, issues: DataFrame, complete: bool = False, key: str = "key") -> DataFrame:
    """The action for each key: create, update, reopen, or, if the inventory is complete, close. Keys compare without case.

    Nothing is carried out; the open issues that no payload names any more are kept unless ``complete``.
    """
    a = payloads.select(F.lower(key).alias("k"), F.col(key).alias("pk"))
    b = issues.select(F.lower(key).alias("k2"), F.col(key).alias("ik"), "number", "state")
    both = a.join(b, F.col("k") == F.col("k2"), "full_outer")
    action = (
        F.when(F.col("k2").isNull(), "create").when(F.col("k").isNotNull() & (F.col("state") == "closed"), "reopen").when(F.col("k").isNotNull(), "update")
        .when(F.lit(complete) & (F.col("state") == "open"), "close")
    )
    return both.select(F.coalesce("pk", "ik").alias(key), "number", action.alias("action")).where(F.col("action").isNotNull())


def rank_of(value: Column, order: list[str], prefix: bool = False) -> Column:
    """Place of a value in a custom order; what it lacks comes last."""
    out = None
    for n, text in enumerate(order):
        hit = value.startswith(text) if prefix else value == text
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.otherwise(len(order)) if out is not None else F.lit(0)


def _footer(line: Column) -> Column:
    """The name in front of a line's first colon, if a value follows it."""
    at = F.instr(line, ": ")
    return F.when(at > 0, F.substring(line, F.lit(1), at - 1))


def _breaks(line: Column) -> Column:
    return F.coalesce(_footer(line).isin(*BREAKS), F.lit(False))


def classify_commits(commits: DataFrame, message: str = "message") -> DataFrame:
    """Commits that release notes list: section, description and cleaned body. A breaking change wins over its type; other types,
    other forms of subject, and messages with ``[skip notes]`` are left out."""
    whole = F.trim(F.col(message))
    subject = F.trim(F.substring_index(whole, "\n", 1))
    body = F.when(whole.contains("\n"), F.trim(F.expr(f"substring(trim({message}), locate('\\n', trim({message})) + 1)"))).otherwise("")
    colon = F.instr(subject, ":")
    lead = F.substring(subject, F.lit(1), F.greatest(colon - 1, F.lit(0)))
    mark = lead.endswith("!")
    lead = F.when(mark, F.substring(lead, F.lit(1), F.char_length(lead) - 1)).otherwise(lead)
    scope = F.instr(lead, "(")
    kind = F.lower(F.when(scope > 0, F.substring(lead, F.lit(1), scope - 1)).otherwise(lead))
    description = F.trim(F.substring(subject, colon + 1, F.char_length(subject)))
    formed = (colon > 0) & kind.rlike("^[a-z0-9_]+$") & ((scope == 0) | lead.endswith(")")) & (description != "")
    breaking = mark | F.exists(F.split(body, "\r?\n"), _breaks)
    section = F.when(breaking, 0)
    for name, place in NOTE_TYPES.items():
        section = section.when(kind == name, place)
    paragraphs = F.split(F.regexp_replace(body, "\r\n", "\n"), r"\n\s*\n")
    keep = lambda last: lambda line: ~_breaks(line) & ~(last & F.coalesce(_footer(line).rlike(FOOTER_NAME), F.lit(False)))
    cleaned = F.transform(paragraphs, lambda p, i: F.btrim(F.array_join(F.filter(F.split(p, "\n"), keep(i == F.size(paragraphs) - 1)), "\n"), F.lit(" \t\n")))  # footers stand in the last paragraph
    clean = F.array_join(F.filter(cleaned, lambda p: p != ""), "\n\n")
    kept = commits.where(~F.lower(whole).contains("[skip notes]") & formed)
    return kept.withColumns({"section": section, "description": description, "body": clean}).where(F.col("section").isNotNull())


def release_notes(classified: DataFrame, order: str = "seq") -> DataFrame:
    """The notes as lines in order: headings, items, and their indented bodies."""
    item = F.concat(F.array(F.concat(F.lit("- "), "description")), F.when(F.col("body") != "", F.transform(F.split("body", "\n"), lambda x: F.concat(F.lit("  "), x))).otherwise(F.array().cast("array<string>")))
    lines = classified.select("section", F.col(order).alias("item"), F.posexplode(item).alias("n", "line"))
    heads = classified.select("section").distinct().select("section", F.lit(None).cast(classified.schema[order].dataType).alias("item"), F.lit(0).alias("n"), F.element_at(F.array(*[F.lit(h) for h in NOTE_SECTIONS]), F.col("section") + 1).alias("line"))
    return heads.unionByName(lines).orderBy("section", F.col("item").asc_nulls_first(), "n").select("line")


def sorted_by(rows: DataFrame, *keys: tuple[Column, bool]) -> DataFrame:
    """Rows by several keys, each with whether it falls; nulls come last."""
    return rows.orderBy(*[c.desc_nulls_last() if falls else c.asc_nulls_last() for c, falls in keys])


def unrolled(projects: DataFrame, targets: str = "targets", name: str = "target", collections: tuple[str, ...] = ("topLevelPackages", "transitivePackages")) -> DataFrame:
    """One row for each package of each project's targets, direct and transitive ones alike."""
    each = projects.select("scope", "project", F.explode(targets).alias("f"))
    parts = [each.select("scope", "project", F.col(f"f.{name}").alias("target"), F.lit(c).alias("collection"), F.explode(F.col(f"f.{c}")).alias("p")) for c in collections]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("scope", "project", "target", "collection", F.col("p.id").alias("package"), F.col("p.requestedVersion").alias("requested"), F.col("p.resolvedVersion").alias("resolved"))
