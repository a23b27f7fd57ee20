"""Secret scans (10): credentials in texts, and weak candidates that complementary parts confirm.

Three kinds are reported wherever they stand: assignments to a password-like name, access identifiers and
long hexadecimal runs.  Two kinds are weak alone: bare 40-character keys and service endpoints.  They are
linked as parts of one credential by an interval join: parts lie in one scope if they start within SCOPE
code points of each other.  A bare key is reported if an access identifier lies in its scope, an endpoint
if both an identifier or user name and a secret (bare key, assignment) do.  DataFrame functions only; joins
are semi joins on scope buckets, so no row is multiplied by its partners.

Offsets are code points, ends exclusive.  redact() replaces what scan() reports, span by span: values of
assignments, identifiers, hexadecimal runs and linked keys.  Linked endpoints stay, as they open nothing alone.

Cases: null and empty texts hold nothing, and redact() leaves them as they are; rows that share a doc_id are
scanned each for itself; a null doc_id stays; further columns are not read by scan() and kept by redact(), also
those with names of results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uploadwatch.llm.common import row_key
from uploadwatch.scratch import materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # what AKIA[A-Z0-9]+ matches with 16 characters or more
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
BARE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"(?i)\b(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9.-]+(?::[0-9]+)?"
USER = r"""(?i)(?<![A-Za-z0-9])(?:user|username|login|access_key_id|client_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+"""
KINDS = ("assign", "access", "hex", "secret", "endpoint")
SCOPE = 400
BLOCK = 512  # matches of one text whose places are summed at a time
_SPANS = "array<struct<start:int,past:int,value:int>>"


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or the like, of an array of integers: within blocks, then over blocks, as appending to one array copies it each time."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    more = lambda acc, x: F.array_append(acc, F.coalesce(combine(F.try_element_at(acc, F.lit(-1)), x), x))
    inner = F.transform(blocks, lambda block: F.aggregate(block, F.array().cast("array<int>"), more))
    last = F.aggregate(F.transform(inner, lambda x: F.element_at(x, -1)), F.array().cast("array<int>"), more)
    return F.flatten(F.transform(F.arrays_zip(inner.alias("own"), F.concat(F.array(F.lit(None).cast("int")), F.slice(last, 1, F.size(last) - 1)).alias("before")), lambda x: F.transform(x["own"], lambda y: F.coalesce(combine(x["before"], y), y))))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """start, past, value (length of the group) of all matches, left to right.

    What splitting leaves between the matches gives their places.
    """
    lengths = lambda c: F.transform(c, lambda s: F.length(s))
    whole, inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.arrays_zip(lengths(F.split(text, pattern, -1)).alias("gap"), lengths(whole).alias("size"), lengths(inner).alias("value"))
    known = F.filter(sizes, lambda x: x["size"].isNotNull())
    settled = F.get(F.transform(F.array(known), lambda found: F.transform(F.arrays_zip(_running(F.transform(found, lambda x: x["gap"] + x["size"]), lambda a, b: a + b).alias("past"), found.alias("x")), lambda y: F.struct((y["past"] - y["x"]["size"]).alias("start"), y["past"].alias("past"), y["x"]["value"].alias("value")))), F.lit(0))
    return F.when(text.rlike(pattern), settled).otherwise(F.array().cast(_SPANS))


def base_spans(texts: DataFrame) -> DataFrame:
    """The kinds that stand alone, as columns assign, access and hex."""
    assign = F.filter(matches(F.col("text"), ASSIGN, 2), lambda s: s["value"] >= LEAST_VALUE)
    return texts.withColumns({"assign": assign, "access": matches(F.col("text"), ACCESS), "hex": matches(F.col("text"), HEX)})


def _tagged(tag: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(tag, s["start"].alias("start"), s["past"].alias("past")))


def linked_spans(texts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, _key, kind, start, past of bare keys and endpoints that complementary parts in scope confirm."""
    held = texts.filter(F.col("text").rlike(ENDPOINT) | (F.col("text").rlike(ACCESS) & F.col("text").rlike(BARE)))
    kinds = {"assign": F.filter(matches(F.col("text"), ASSIGN, 2), lambda s: s["value"] >= LEAST_VALUE), "access": matches(F.col("text"), ACCESS), "secret": matches(F.col("text"), BARE), "endpoint": matches(F.col("text"), ENDPOINT), "user": matches(F.col("text"), USER)}
    tagged = F.flatten(F.array(*(_tagged(F.lit(kind).alias("kind"), spans) for kind, spans in kinds.items())))
    parts = materialize(held.select("doc_id", "_key", F.inline(tagged)).withColumn("_cell", F.floor(F.col("start") / scope)).distinct(), "parts")

    def near(wanted: DataFrame, *partners: str) -> DataFrame:
        other = parts.filter(F.col("kind").isin(*partners)).select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), F.col("start").alias("_s"), F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)).alias("_c"))
        on = wanted["doc_id"].eqNullSafe(other["_d"]) & (wanted["_key"] == other["_k"]) & (wanted["_cell"] == other["_c"]) & (F.abs(wanted["start"] - other["_s"]) <= scope)
        return wanted.join(other, on, "left_semi")

    keys = near(parts.filter("kind = 'secret'"), "access")
    ends = near(near(parts.filter("kind = 'endpoint'"), "access", "user"), "secret", "assign")
    return keys.unionByName(ends).select("doc_id", "_key", "kind", "start", "past")


def _listed(spans: Column) -> Column:
    """kind:start:past, comma-joined, by start, then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"]), s["start"], s["past"])), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every row."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_key", row_key())
    ranked = lambda column, rank: F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["past"].alias("past")))
    found = base_spans(texts).select("doc_id", "_key", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]), F.flatten(F.array(*(ranked(k, i + 1) for i, k in enumerate(KINDS[:3])))).alias("_base"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    linked = linked_spans(texts, scope).groupBy("doc_id", "_key").agg(F.collect_set(F.struct("start", rank.alias("rank"), "past")).alias("_more"))
    linked = linked.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_more")
    joined = found.join(linked, found["doc_id"].eqNullSafe(linked["_d"]) & (found["_key"] == linked["_k"]), "left")
    every = F.when(F.col("_more").isNull(), F.col("_base")).otherwise(F.concat("_base", "_more"))
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(every).alias("spans"), F.coalesce(F.size("_more"), F.lit(0)).cast("bigint").alias("n_linked"))


def redact(docs: DataFrame, mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """docs with the reported secrets replaced in text, each span by the mark; spans that overlap are one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [f"_{c}_part" for c in ("doc", "text", "keys")]
    keys = linked_spans(docs.select("doc_id", text.alias("text")).withColumn("_key", row_key()), scope).filter("kind = 'secret'")
    more = keys.groupBy(F.col("doc_id").alias(names[0]), F.col("_key").alias(names[1])).agg(F.collect_set(F.struct("start", "past")).alias(names[2]))
    joined = docs.join(more, docs["doc_id"].eqNullSafe(more[names[0]]) & (F.xxhash64(text, F.length(text)) == more[names[1]]), "left")
    own = docs["text"].cast("string")
    span = lambda first, past: F.struct(first.alias("start"), past.alias("past"))
    values = F.transform(F.filter(matches(own, ASSIGN, 2), lambda s: s["value"] >= LEAST_VALUE), lambda s: span(s["past"] - s["value"], s["past"]))
    others = [F.transform(matches(own, p), lambda s: span(s["start"], s["past"])) for p in (ACCESS, HEX)]
    spans = F.array_sort(F.concat(values, *others, F.coalesce(F.col(names[2]), F.array().cast("array<struct<start:int,past:int>>"))))

    def replaced(chars: Column, found: Column, reach: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1))
        kept = F.transform(F.arrays_zip(found.alias("s"), before.alias("at")), lambda x: F.when(x["s"]["start"] >= x["at"], F.concat(F.array_join(F.slice(chars, x["at"] + 1, x["s"]["start"] - x["at"]), ""), F.lit(mark))).otherwise(""))
        rest = F.slice(chars, F.element_at(reach, -1) + 1, F.size(chars))
        return F.concat(F.array_join(kept, ""), F.array_join(rest, ""))

    one = lambda c, then: F.get(F.transform(F.array(c), then), F.lit(0))  # noqa: E731  what is used more than once is worked out once
    clean = one(spans, lambda found: F.when(F.size(found) > 0, one(F.split(own, ""), lambda chars: one(_running(F.transform(found, lambda s: s["past"]), lambda a, b: F.greatest(a, b)), lambda reach: replaced(chars, found, reach)))).otherwise(own))
    return joined.select(*(F.when(own.isNotNull(), clean).alias(c) if c == "text" else docs[c] for c in docs.columns))
