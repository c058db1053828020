import hashlib
import re

from pyspark.sql import functions as F

from palimpsest.llm import secrets as X

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
TEXTS = [
    "x password = 'abcdefgh1' and secret: token: abcdefghij", "é🙂 Token=\"12345678\" tail " + "0123456789abcdef" * 2, "AKIA" + "A" * 12 + " AKIAshort AKIA" + "B" * 11, "deadbeef" * 3,
    "password=short\napi_key:abcdefgh.ijk apikey=zzzzzzzz", "", None, "password=token=abcdefgh", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36, "a" * 31 + " " + "a" * 32,
]


def base(text):
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_base_spans_against_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[0]), (None, TEXTS[1])], "doc_id long, text string")
    for r in X.scan_documents(df).withColumn("base", X.joined(F.filter("spans", lambda s: s["kind_no"] < 3))).join(df.withColumnRenamed("doc_id", "d"), F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("blob")).collect():
        assert r.base == ",".join(base(r.text)), r.text
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
    assert X.scan_documents(df.limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    old = spark.createDataFrame([(1, "password=abcdefgh1"), (2, "clean")], "doc_id long, text string")
    ledger = X.update_ledger(old, None, folder, "doc_id", "text")
    assert ledger.count() == 2
    new = spark.createDataFrame([(1, "password=abcdefgh1"), (9, "password=abcdefgh1"), (3, "secret=zzzzzzzz9")], "doc_id long, text string")
    ledger = X.update_ledger(new, ledger, folder, "doc_id", "text")
    assert ledger.count() == 3  # one more blob
    newer = tuple(X.Rule(r.kind, 2, r.pattern, r.least, r.group, r.base) if r.kind == "hex" else r for r in X.RULES)
    ledger = X.update_ledger(new, ledger, folder, "doc_id", "text", newer)
    assert sorted(len(r.rules) for r in ledger.collect()) == [1, 1, 7, 7, 7]  # the changed rule alone is run again
    got = {r.doc_id: [s.kind for s in r.spans] for r in X.findings(new, ledger, "doc_id", "text", newer).collect()}
    assert got == {1: ["assign"], 9: ["assign"], 3: ["assign"]}


def test_rules_in_another_order_and_a_ledger_without_its_folder(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXTS[1]), (2, TEXTS[2])], "doc_id long, text string")
    ledger = X.update_ledger(docs, None, f"file://{tmp_path}/a", "doc_id", "text", X.RULES[::-1])
    both = X.scan_documents(docs, ledger)  # scans nothing; numbers follow the order asked for
    assert X.read_ledger(spark, f"file://{tmp_path}/a").count() == 2
    plain = X.scan_documents(docs)
    assert sorted(map(str, both.collect())) == sorted(map(str, plain.collect()))
    assert [s.kind_no for r in plain.collect() for s in r.spans if s.kind == "access"] == [1] * 1
