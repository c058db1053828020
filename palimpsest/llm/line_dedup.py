"""Fuzzy line dedup by MinHash, in DataFrame operations only.

1. Equal lines (trimmed) become one entry, addressed by a 64-bit hash and held by their first place, (doc_id, line number).
2. An entry's signature comes from its distinct character shingles by one-permutation hashing: one 64-bit hash a shingle,
   whose leading bits choose a bin and whose rest competes for the bin's minimum. Only shingles among the few smallest
   expected in a bin are kept before aggregation. Empty bins borrow from the next.
3. Rows of the signature form bands; their height follows from the threshold (``rows_for``). Entries of a bucket that share too few
   bins (``least_equal``) are no pair; entries without a partner go. The rest get a parity sketch of their shingle sets, which
   bounds the similarity of a pair from above, without error. Pairs within the bound are verified by exact Jaccard similarity of the
   shingle sets: first those with a bucket's least entry; then, between entries that are still in different components, those with
   about ``FEW`` of the bucket, with ``FEW`` times as many, and so on up to all of it. No partner is left out, at any size.
4. Union-find (large-star, small-star) gives components.
5. The first place of each component keeps its line.

Shingles are slices of the line's UTF-32 form, exploded and hashed inside generated code; their minima are aggregated before
anything is shuffled. Texts are shuffled once, and only lines with a partner. An entry that is like many others is tied to some before
it meets all, so few ties leave a join for each entry. What grows with the square of a bucket are comparisons of sketches inside
the join, between entries of different components.

Defined cases: null texts stay null and empty texts empty; blank lines are kept; a line shorter than a shingle only equals
itself; rows without a doc_id, and documents that repeat a doc_id, are told apart by their content; an empty table gives no row;
columns whose names clash with those made here give way only inside, ``dedup_lines`` returns all of them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import persist, table
from palimpsest.llm.components import connected_components

SHINGLE, THRESHOLD, BINS = 6, 0.8, 21
DENSITY = 2  # smallest shingles expected to stay in a bin
FEW, BLOCK, WORDS = 16, 4096, 8
LANES, LOW, HIGH = 7, 0x7F7F7F7F7F7F7F, 0x80808080808080  # bins a number holds, eight bits each


def at_least(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= k)."""
    return 1 - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))


def rows_for(threshold: float, bins: int = BINS, recall: float = 0.99) -> int:
    """The tallest bands of which a pair at the threshold still shares one."""
    return max((r for r in range(1, bins) if bins % r == 0 and at_least(1, bins // r, threshold**r) >= recall), default=1)


def least_equal(threshold: float, bins: int = BINS, loss: float = 0.002) -> int:
    """Bins that a pair must share: at the threshold, fewer are equal with a probability of ``loss`` at most."""
    return max(m for m in range(bins + 1) if m == 0 or 1 - at_least(m, bins, threshold) <= loss)


def wide(line: Column) -> Column:
    return F.encode(line, "UTF-32")


def shingle_hash(wide_line: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.substring(wide_line, at * 4 + 1, F.lit(size * 4)))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, copy, n, line, entry) for every non-blank line. ``copy`` tells documents with one id apart."""
    text = F.col(text_col)
    # The outer form has no filter on its array inferred, which would split each text again; a null text gives a null line.
    whole = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("copy"), F.posexplode_outer(F.split(text, "\n", -1)).alias("n", "raw"))
    rows = whole.select("doc", "copy", "n", F.trim("raw").alias("line"))
    return rows.where(F.col("line") != "").withColumn("entry", F.xxhash64("line"))


def signatures(lines: DataFrame, shingle: int = SHINGLE, bins: int = BINS, density: int = DENSITY) -> DataFrame:
    """(entry, b0 ... b{bins-1}): the least hash of each bin, null where it is empty."""
    count = F.char_length("line") - shingle + 1
    level = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.round(F.log2(count / (density * bins))))).cast("long")  # by powers of two, so that similar lines have one limit
    whole = lines.where(count >= 1).select("entry", wide(F.col("line")).alias("w"), level.alias("level"), count.alias("count"))  # once a line, below the explode
    rows = whole.select("entry", "w", "level", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("at"))
    hashed = rows.select("entry", "level", shingle_hash(F.col("w"), F.col("at"), shingle).alias("h"))
    # The low 32 bits compete, the high 31 choose the bin; of n shingles about density x bins pass.
    near = hashed.select("entry", F.col("h").bitwiseAND(0xFFFFFFFF).alias("value"), (F.shiftrightunsigned("h", 33) % bins).cast("int").alias("place"), "level")
    near = near.where(F.col("value") * F.col("level") < (1 << 32))
    none = F.lit(1 << 32)  # over any value; minima of values that are never null take half the time
    return near.groupBy("entry").agg(*[F.nullif(F.min(F.when(F.col("place") == b, F.col("value")).otherwise(none)), none).alias(f"b{b}") for b in range(bins)])


def band_keys(signature: DataFrame, rows: int, bins: int = BINS) -> DataFrame:
    """(entry, keys, s0, s1 ...): one key for each band, and the low 8 bits of every bin, seven to a number. An empty bin takes the value of the next full one, marked with the distance."""
    full = [F.coalesce(F.col(f"b{b}"), *[F.col(f"b{(b + d) % bins}") + (d << 33) for d in range(1, bins)]) for b in range(bins)]
    keys = [F.xxhash64(F.lit(k), *full[k * rows : (k + 1) * rows]) for k in range(bins // rows)]
    lanes = [F.shiftleft(f.bitwiseAND(0xFF), 8 * (b % LANES)) for b, f in enumerate(full)]
    sigs = [reduce(lambda x, y: x.bitwiseOR(y), lanes[b : b + LANES]).alias(f"s{b // LANES}") for b in range(0, bins, LANES)]
    return signature.select("entry", F.array(*keys).alias("keys"), *sigs)


def equal_bins(x: str, y: str, bins: int = BINS) -> Column:
    """How many bins two signatures (columns x0, x1 ... and y0, y1 ...) share: lanes whose difference is zero."""
    out = F.lit(0)
    for k in range(-(-bins // LANES)):
        apart = F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))
        marks = F.bitwise_not((apart.bitwiseAND(F.lit(LOW)) + F.lit(LOW)).bitwiseOR(apart)).bitwiseAND(F.lit(HIGH))
        out = out + F.bit_count(marks)
    return out - (-bins % LANES)  # lanes without a bin are always equal


def shingles_of(line: Column, shingle: int) -> Column:
    """A row with the hashes of the line's shingles, in place order. The wide form is bound by the outer lambda, so it is made once a line.

    It is a generator's row, so no filter is pushed below it and makes the hashes again, and distinct ones are told in generated code.
    """
    last = (F.char_length(line) - shingle) * 4 + 1
    return F.explode_outer(F.transform(F.array(wide(line)), lambda w: F.transform(F.sequence(F.lit(1), last, F.lit(4)), lambda at: F.xxhash64(F.substring(w, at, F.lit(shingle * 4))))))


def bucket_rows(keyed: DataFrame) -> DataFrame:
    """(entry, key, c, s0, s1 ...) of entries that share a bucket of ``c`` entries."""
    keys = keyed.select("entry", F.explode("keys").alias("key")).repartition("key")  # dealt out once, for the count and the join
    bucket = keys.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > 1)
    rows = keys.join(bucket.hint("shuffle_hash"), "key")
    return persist(rows.join(keyed.drop("keys").hint("shuffle_hash"), "entry"), "line-buckets")


def facing(one: DataFrame, two: DataFrame, how: str, test: Column, block: int) -> DataFrame:
    """Rows ``one`` (a_key, a_c, a_entry ...) joined with ``two`` (b_key, b_c, b_entry ...) of their bucket where ``test`` holds. Pairs are
    compared inside the join, which gives out only those that pass. The first side of a large bucket is dealt out in blocks."""
    n = lambda c: F.ceil(F.col(c) / block).cast("int")
    one = one.withColumn("at", F.pmod(F.xxhash64("a_entry"), n("a_c")).cast("int"))
    two = two.withColumn("bt", F.explode(F.sequence(F.lit(0), n("b_c") - 1)))
    return one.join(two.hint("shuffle_hash"), (F.col("a_key") == F.col("b_key")) & (F.col("at") == F.col("bt")) & test, how)


def named(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])


def counted(rows: DataFrame) -> DataFrame:
    """``rows`` with the count ``c`` of their bucket's rows and its least entry."""
    bucket = rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c"), F.min("entry").alias("least"))
    return rows.drop("c").join(bucket.hint("shuffle_hash"), F.col("key") == F.col("k")).drop("k")


def with_partners(rows: DataFrame, least: int, block: int) -> DataFrame:
    """``rows`` that share at least so many bins with another of their bucket: each once, however many they are like."""
    return facing(named(rows, "a_"), named(rows, "b_"), "left_semi", (F.col("a_entry") != F.col("b_entry")) & (equal_bins("a_s", "b_s") >= least), block).select(*[F.col(f"a_{c}").alias(c) for c in rows.columns])


def marks(texts: DataFrame, shingle: int, words: int = WORDS) -> DataFrame:
    """(entry, size, m0, m1 ...): the number of distinct shingles, and the parity of those that hash to each of 64 x ``words`` bits."""
    rows = texts.select("entry", shingles_of(F.col("line"), shingle).alias("all")).select("entry", F.explode_outer(F.array_distinct("all")).alias("h"))
    rows = rows.select("entry", F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 8) & 63 as int))").alias("bit"), F.pmod("h", F.lit(words)).alias("word"))
    return rows.groupBy("entry").agg(F.count("*").alias("size"), *[F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in range(words)])


def may_be_near(threshold: float, words: int = WORDS) -> Column:
    """False only for pairs under the threshold: every odd bit of the difference stands for a shingle that one of the lines lacks."""
    odd = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_m{k}").bitwiseXOR(F.col(f"b_m{k}"))) for k in range(words)])
    return odd <= (F.col("a_size") + F.col("b_size")) * ((1 - threshold) / (1 + threshold)) + 1e-6


def hub_ties(rows: DataFrame, test: Column) -> DataFrame:
    """Ties (a, b) of entries with the least of their bucket."""
    hubs = rows.where(F.col("entry") == F.col("least"))
    ties = named(rows, "a_").join(named(hubs, "b_").hint("shuffle_hash"), (F.col("a_key") == F.col("b_key")) & (F.col("a_entry") != F.col("b_entry")) & test)
    return ties.select(F.col("a_entry").alias("a"), F.col("b_entry").alias("b")).distinct()


def open_rows(rows: DataFrame, classes: DataFrame, over: int) -> DataFrame:
    """``rows`` with their component o and the ``keys`` of all their rows here, in buckets of over ``over`` entries that are not all in one component."""
    known = classes.select(F.col("node").alias("entry"), "component")
    rows = rows.where(F.col("c") > over).drop("o", "keys").join(known, "entry", "left").withColumn("o", F.coalesce("component", "entry")).drop("component")
    split = rows.groupBy(F.col("key").alias("k")).agg(F.min("o").alias("lo"), F.max("o").alias("hi")).where(F.col("lo") != F.col("hi")).select("k")
    rows = persist(rows.join(split.hint("shuffle_hash"), F.col("key") == F.col("k"), "left_semi"), "line-open")
    keys = rows.groupBy(F.col("entry").alias("e")).agg(F.collect_set("key").alias("keys"))
    return rows.join(keys, F.col("entry") == F.col("e")).drop("e")


def open_ties(rows: DataFrame, share: int, test: Column, block: int) -> DataFrame:
    """Ties (a, b) between different components: of all entries with about ``share`` of their bucket, with all in buckets up to ``share``.

    A pair leaves the join in the least of the buckets that it shares here; where that has not drawn it, the bucket stays open for later shares."""
    once = F.col("a_key") == F.array_min(F.array_intersect("a_keys", "b_keys"))
    rows = rows.withColumn("drawn", F.pmod(F.xxhash64("entry", F.lit(share)), F.ceil(F.col("c") / share)) == 0)
    one, two = named(rows, "a_"), named(rows.where("drawn").drop("drawn"), "b_")
    met = facing(one, two, "inner", (F.col("a_o") != F.col("b_o")) & (~F.col("a_drawn") | (F.col("a_entry") > F.col("b_entry"))) & test & once, block)
    return met.select(F.col("a_entry").alias("a"), F.col("b_entry").alias("b"), F.col("a_o").alias("oa"), F.col("b_o").alias("ob")).dropDuplicates(["a", "b"])


def texts_of(ends: DataFrame, docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(entry, line) of the entries ``ends`` (e). A line's text is fetched from its first place; only documents that hold one are split."""
    wanted = places.join(ends, F.col("entry") == F.col("e")).groupBy("doc", "copy").agg(F.collect_list(F.struct("n", "entry")).alias("ws"))
    whole = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("c"), F.col(text_col).alias("t"))
    rows = whole.join(wanted.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")))
    lines = F.element_at(F.transform(F.array(F.split("t", "\n", -1)), lambda p: F.transform("ws", lambda x: F.struct(x["entry"].alias("entry"), F.trim(F.element_at(p, x["n"] + 1)).alias("line")))), 1)
    return persist(rows.select(F.explode_outer(lines).alias("x")).select("x.entry", "x.line").dropDuplicates(["entry"]), "line-texts")


def verified(ties: DataFrame, texts: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The ties (a, b) whose lines have at least the similarity ``threshold``.

    Ties carry a's line to where b's shingles, made once a hub, are hashed; a hub of very many ties is split by the adaptive join.
    The intersection passes through a generator, so the filter is not pushed below it and makes it once.
    """
    hubs = texts.select(F.col("entry").alias("b"), F.col("line").alias("lb")).join(ties.select("b").distinct(), "b").repartition("b").select("b", shingles_of(F.col("lb"), shingle).alias("sb")).select("b", F.array_distinct("sb").alias("sb"))
    both = ties.join(texts.select(F.col("entry").alias("a"), F.col("line").alias("la")), "a").join(hubs.hint("shuffle_hash"), "b")
    both = both.select(*ties.columns, shingles_of(F.col("la"), shingle).alias("sa"), "sb")
    both = both.select(*ties.columns, F.size(F.array_distinct("sa")).alias("na"), F.size("sb").alias("nb"), F.explode_outer(F.array(F.size(F.array_intersect("sa", "sb")))).alias("common"))
    return both.where(F.col("common") >= threshold * (F.col("na") + F.col("nb") - F.col("common")) - 1e-9).select(*ties.columns)


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (node, component) once ``links`` (oa, ob) join components; an entry in no class is its own component."""
    joined = connected_components(links.select(F.col("oa").alias("a"), F.col("ob").alias("b"))).select(F.col("node").alias("was"), F.col("component").alias("now"))
    moved = classes.join(joined, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    alone = joined.join(classes.select("component").distinct(), F.col("was") == F.col("component"), "left_anti")
    return persist(moved.unionAll(alone.select("was", "now")), "line-classes")


def line_classes(lines: DataFrame, places: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of the entries that are like another."""
    keyed = persist(band_keys(signatures(lines, shingle), rows_for(threshold)), "line-keys")
    least = least_equal(threshold)
    rows = persist(with_partners(bucket_rows(keyed), least, BLOCK), "line-partners")
    texts = texts_of(rows.select(F.col("entry").alias("e")).distinct(), docs, places, id_col, text_col)
    rows = persist(counted(rows).join(marks(texts, shingle), "entry"), "line-marked")
    test = (equal_bins("a_s", "b_s") >= least) & may_be_near(threshold)
    classes = persist(connected_components(verified(hub_ties(rows, test), texts, shingle, threshold)), "line-classes")
    largest = rows.agg(F.max("c")).first()[0] or 0
    rows = rows.where(F.col("entry") != F.col("least"))
    done, share = 2, FEW
    while done < largest:
        rows = open_rows(rows, classes, done)
        ties = persist(open_ties(rows, share, test, BLOCK), "line-ties")
        if not ties.isEmpty():
            classes = merged(classes, verified(ties, texts, shingle, threshold))
        done, share = share, share * FEW
    return classes


def keepers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All non-blank lines (doc, copy, n, entry, size), and, for each entry with more than one line in its class, the place (kd, kc, kn) that keeps its line.

    Places are compared as (doc, n, copy), nulls first.
    """
    lines = lines_of(docs, id_col, text_col)
    light = persist(lines.select("doc", "copy", "n", "entry", F.char_length("line").alias("size")), "line-light")
    place = F.struct("doc", "n", "copy")
    places = persist(light.groupBy("entry").agg(F.min(place).alias("p"), F.count("*").alias("times")).select("entry", "p.doc", "p.n", "p.copy", "times"), "line-places")
    classes = line_classes(lines, places, docs, id_col, text_col, shingle, threshold)
    member = classes.select(F.col("node").alias("entry"), "component").join(places, "entry")
    first = member.groupBy("component").agg(F.min(place).alias("p"))
    near = member.join(first, "component").select("entry", F.col("p.doc").alias("kd"), F.col("p.copy").alias("kc"), F.col("p.n").alias("kn"))
    alone = places.where(F.col("times") > 1).join(classes.select(F.col("node").alias("entry")), "entry", "left_anti")
    return light, near.unionAll(alone.select("entry", F.col("doc").alias("kd"), F.col("copy").alias("kc"), F.col("n").alias("kn")))


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, copy, n, entry, size, kept) for every non-blank line."""
    light, keep = keepers(docs, id_col, text_col, shingle, threshold)
    kept = F.col("kn").isNull() | (F.col("doc").eqNullSafe(F.col("kd")) & (F.col("copy") == F.col("kc")) & (F.col("n") == F.col("kn")))
    return light.join(keep, "entry", "left").select("doc", "copy", "n", "entry", "size", kept.alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the lines that another place keeps, with column ``n_removed``. All other columns stay."""
    gone = line_verdicts(docs, id_col, text_col, shingle, threshold).where(~F.col("kept"))
    gone = gone.groupBy("doc", "copy").agg(F.collect_set("n").alias("_gone"))
    rows = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("doc")) & (F.xxhash64(text_col) == F.col("copy")), "left").drop("doc", "copy")
    parts = F.split(F.col(text_col), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    text = F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.transform(left, lambda i: F.element_at(p, i + 1)), "\n")), 1)
    return rows.withColumns({text_col: F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(text), "n_removed": F.coalesce(F.size("_gone"), F.lit(0))}).drop("_gone")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its non-blank lines, those removed, the characters kept, and a digest over the kept lines and their places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    verdicts = line_verdicts(docs)
    mark = F.xxhash64("entry", "n")
    by_doc = verdicts.groupBy("doc", "copy").agg(
        F.count("*").alias("n_lines"), F.count_if(~F.col("kept")).alias("n_removed"),
        F.sum(F.when(F.col("kept"), F.col("size")).otherwise(0)).alias("kept_chars"), F.bit_xor(F.when(F.col("kept"), mark)).alias("kept_digest"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("_copy"))
    rows = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("_copy") == F.col("copy")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", zero("n_lines"), zero("n_removed"), zero("kept_chars"), zero("kept_digest"))
