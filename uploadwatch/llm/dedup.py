"""MinHash near-dedup (1): documents whose shingle sets are alike, and their connected components.

One-permutation hashing puts each shingle of a document into one of 150 bins and keeps each bin's least
hash; an empty bin takes the value of the first filled bin in a random order of its own (optimal
densification).  Bins form 30 bands of 5, so a pair at similarity 0.85 shares no band with a probability
of 2e-8.  Documents with equal sets are one node.  Within a bucket of equal bands candidates form a star
around one member, so their number is linear in the bucket; every candidate is confirmed on the full sets.

Stars alone could lose a link between two members of which the centre is linked with one at most.  So a
star keeps how its members differ from the centre, and links between members of different components are
found from those differences alone, exactly and without pairing all members (see crossing_components).

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; rows that
share an id are one document, linked if any of their texts is; a row with a null id takes no part and is
kept; equal texts are linked; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uploadwatch.llm.common import map_batches, row_key, text_bytes
from uploadwatch.operators.components import components
from uploadwatch.scratch import materialize

BANDS, ROWS = 30, 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles of ``width`` words.

    Words are separated by white space of ASCII, in lower case for A-Z; that is what bytes methods do.
    """
    import xxhash

    words = np.array(list(map(xxhash.xxh64_intdigest, text.lower().split())), np.uint64)
    if not len(words):
        return words
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        total = total * _FACTOR + words[k : k + len(total)]
    return np.unique(_mix(total))


def _orders(bins: int) -> np.ndarray:
    """For each attempt and bin, the bin to borrow from."""
    return np.random.default_rng(20240229).integers(0, bins, (512, bins)).astype(np.int16)


def signature(shingles: np.ndarray, bands: int, rows: int, orders: np.ndarray) -> list[int]:
    """One signed 64-bit number per band, different in different bands."""
    bins = bands * rows
    again = _mix(shingles + _FACTOR)
    where = ((again >> _BITS) * np.uint64(bins)) >> _BITS
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    ranked = np.sort((where << np.uint64(48)) | (again * _FACTOR >> np.uint64(16)))
    found = ranked >> np.uint64(48)
    first = np.r_[True, found[1:] != found[:-1]]
    filled = np.zeros(bins, bool)
    filled[found[first]] = True
    least[found[first]] = ranked[first] & np.uint64((1 << 48) - 1)
    empty = np.flatnonzero(~filled)
    if len(empty) == bins - 1:
        least[:] = least[found[0]]
    else:
        for order in orders:
            if not len(empty):
                break
            source = order[empty]
            good = filled[source]
            least[empty[good]] = least[source[good]]
            empty = empty[~good]
        if len(empty):
            full = np.flatnonzero(filled)
            least[empty] = least[full[np.searchsorted(full, empty) % len(full)]]
    total = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        total = _mix(total * _FACTOR + column)
    return total.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (null for the empty set), bands."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        orders = _orders(bands * rows)
        sizes, keys, marks = [], [], []
        for text in batch.column(1).to_pylist():
            shingles = shingle_set(text, width)
            sizes.append(len(shingles))
            keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            marks.append(signature(shingles, bands, rows, orders) if len(shingles) else np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"]
        )

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), text_bytes()), run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


STARS = "a bigint, mark bigint, b bigint, n bigint, n_a bigint, linked boolean, novel array<bigint>, missing array<bigint>"


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """For candidates (a, b), a the centre of a star: whether they are linked, and how b's set differs from a's.

    mark tells texts of one centre apart; n and n_a are the sizes of the sets of b and a.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(8)]
        last, left, mark = None, None, 0
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
            if (a, x) != last:
                last, left = (a, x), shingle_set(x, width)
                mark = int.from_bytes(hashlib.blake2b(left.tobytes(), digest_size=8).digest(), "little", signed=True)
            right = shingle_set(y, width)
            novel, missing = np.setdiff1d(right, left, assume_unique=True), np.setdiff1d(left, right, assume_unique=True)
            common = len(right) - len(novel)
            linked = 100 * common >= percent * (len(left) + len(novel))
            for c, v in zip(columns, (a, mark, b, len(right), len(left), linked, novel.view(np.int64), missing.view(np.int64))):
                c.append(v)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in STARS.split(", ")])

    second = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    first = second.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return materialize(map_batches(first.select("a", "b", "text_a", "text_b"), run, STARS), "stars")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept, for every row."""
    marked = materialize(signatures(docs, width, bands, rows), "signatures")
    named = marked.filter("doc_id is not null and set_key is not null")
    sets = materialize(named.groupBy("set_key").agg(F.min("doc_id").alias("u"), F.min_by("bands", "doc_id").alias("bands")), "sets")
    buckets = sets.select("u", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("u").alias("a"), F.count("*").alias("members")).filter("members > 1")
    pairs = materialize(buckets.join(heads, "bucket").filter("u <> a").select("a", F.col("u").alias("b")).distinct(), "pairs")

    repeats = named.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").limit(1).count() > 0
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).filter("doc_id is not null and text is not null")
    if repeats:
        texts = texts.withColumn("_key", row_key()).dropDuplicates(["doc_id", "_key"]).drop("_key")
    stars = confirm(pairs, texts.select("doc_id", text_bytes().alias("text")), width, percent)

    links = stars.filter("linked").select("a", "b")
    if repeats:
        own = named.join(sets.select("set_key", "u"), "set_key").select("doc_id", "u").distinct()
        least = own.groupBy("doc_id").agg(F.min("u").alias("low"), F.max("u").alias("high")).filter("low < high")
        links = links.unionByName(own.join(least, "doc_id").filter("u > low").select(F.col("low").alias("a"), F.col("u").alias("b")))
    known = crossing_components(stars, components(links), percent)

    of_set = sets.select("set_key", "u").join(known.withColumnRenamed("node", "u"), "u", "left").select("set_key", F.coalesce("component", "u").alias("component"))
    whole = marked.join(of_set, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


FEW = 512  # members of one star that share a leading difference: so many are paired, more become a star of their own


def crossing_components(stars: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """node, component as in known, with the links between members of one star that were in different components.

    Members that share a bucket share its centre r, and their sets follow from their differences D from r.
    Members m and x are linked if |Dm| + |Dx| - 2 |Dm & Dx| <= T = (100 - p) / (100 + p) * (nm + nx), so they
    share at least (|Dm| + |Dx| - T) / 2 differences.  As | |Dm| - |Dx| | <= T, that is |D| - T or more for
    either; and as m is not linked with r, it is more than (1 - t) / 2 * |Dx| for x.  With the differences in
    one order, rarest first, both leading parts must meet, and early enough for the rest to suffice (prefix
    and positional filter).  Replaced words make differences that no other copy has, and these come first,
    so copies of one text that are too far apart hardly ever meet.

    Where a few members meet in a difference they are paired.  Where many do, one of them becomes the centre of
    a star of the others: each is compared with it, components grow by what is found, and the rest is settled
    in the new star by the same rules, where the differences that all of them shared are gone.  So rows stay in
    proportion to members, and no link is lost.
    """
    members = stars.select("a", "mark", "b", "n", F.concat("novel", "missing").alias("differences")).withColumn("h", F.xxhash64("differences"))  # h tells several texts of one document apart
    while True:
        ordered = open_members(members, known, percent)
        leading = ordered.select("a", "mark", "b", "h", "n", "c", "c_a", "k", "own", F.posexplode(F.slice("order", 1, F.col("reach"))).alias("pos", "x")).filter("x.f > 1").withColumn("e", F.col("x.e"))
        met = leading.groupBy("a", "mark", "e").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high"), F.min_by("b", F.xxhash64("b", "h")).alias("head"), F.min_by("h", F.xxhash64("b", "h")).alias("head_h"))
        met = materialize(met.filter("low < high").select("a", "mark", "e", "size", "head", "head_h"), "met")
        links = paired(leading, met.filter(F.col("size") <= FEW), ordered, percent)
        many = met.filter(F.col("size") > FEW)
        grown = not many.isEmpty()
        if grown:
            members = materialize(new_stars(leading.join(many, ["a", "mark", "e"]), ordered), "members")
            links = links.unionByName(members.filter(_linked(F.col("n"), F.col("n_a"), F.size("differences"), percent)).select("a", "b").distinct())
        links = materialize(links, "links")
        if not links.isEmpty():
            known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        if not grown:
            return known


def _linked(n: Column, m: Column, differ: Column, percent: int) -> Column:
    """Twice the intersection and twice the union, of sets of n and m elements that differ in so many."""
    return 100 * (n + m - differ) >= percent * (n + m + differ)


def open_members(members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Members of stars in which not all are of the centre's component, with their differences in order (rarest first) and how many of them lead: reach, and own for those not linked with the centre."""
    t = (100 - percent) / (100 + percent)
    label = known.select(F.col("node").alias("b"), F.col("component").alias("c"))
    centre = known.select(F.col("node").alias("a"), F.col("component").alias("c_a"))
    joined = members.join(label, "b", "left").join(centre, "a", "left").withColumns({"c": F.coalesce("c", "b"), "c_a": F.coalesce("c_a", "a")})
    open_ = joined.filter("c <> c_a").select("a", "mark").distinct()
    left = materialize(joined.join(open_, ["a", "mark"], "left_semi").select("a", "mark", "b", "h", "n", "c", "c_a", "differences", F.size("differences").alias("k")), "open")
    elements = left.select("a", "mark", "b", "h", F.explode("differences").alias("e"))
    counts = elements.groupBy("a", "mark", "e").agg(F.count("*").alias("f"))
    orders = elements.join(counts, ["a", "mark", "e"]).groupBy("a", "mark", "b", "h").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("order"))
    apart = F.ceil(F.col("k") - t * (1 + 100 / percent) * F.col("n") - 1e-6)
    own = F.greatest(F.lit(1), apart)
    as_partner = F.greatest(F.lit(1), apart, F.floor((1 - t) / 2 * F.col("k")) + 1)
    to = lambda least: (F.col("k") - least + 1).cast("int")
    found = left.join(orders, ["a", "mark", "b", "h"]).select("a", "mark", "b", "h", "n", "c", "c_a", "k", "differences", "order", F.when(F.col("c") != F.col("c_a"), to(own)).otherwise(0).alias("own"), F.greatest(to(as_partner), F.when(F.col("c") != F.col("c_a"), to(own)).otherwise(0), F.lit(0)).alias("reach"))
    return materialize(found, "ordered")


def paired(leading: DataFrame, few: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of different components that share one of few, leading differences."""
    t = (100 - percent) / (100 + percent)
    probes = leading.filter(F.col("pos") < F.col("own")).join(few, ["a", "mark", "e"], "left_semi").select("a", "mark", "e", "b", "h", "n", "c", "k", "pos")
    partners = leading.select("a", "mark", "e", *(F.col(c).alias(f"{c}_2") for c in ("b", "h", "n", "c", "k", "pos")))
    needed = (F.col("k") + F.col("k_2") - t * (F.col("n") + F.col("n_2"))) / 2 - 1e-6
    reachable = F.least(F.col("k") - F.col("pos"), F.col("k_2") - F.col("pos_2"))
    fits = (F.col("c") != F.col("c_2")) & (100 * F.least("n", "n_2") >= percent * F.greatest("n", "n_2")) & (reachable >= needed)
    pairs = probes.join(partners, ["a", "mark", "e"]).filter(fits).select("a", "mark", "b", "h", "b_2", "h_2").distinct()
    one = ordered.select("a", "mark", "b", "h", "n", "differences")
    other = one.select("a", "mark", *(F.col(c).alias(f"{c}_2") for c in ("b", "h", "n", "differences")))
    both = pairs.join(one, ["a", "mark", "b", "h"]).join(other, ["a", "mark", "b_2", "h_2"])
    differ = F.size("differences") + F.size("differences_2") - 2 * F.size(F.array_intersect("differences", "differences_2"))
    return both.filter(_linked(F.col("n"), F.col("n_2"), differ, percent)).select(F.least("b", "b_2").alias("a"), F.greatest("b", "b_2").alias("b")).distinct()


def new_stars(leading: DataFrame, ordered: DataFrame) -> DataFrame:
    """Stars whose centres are the heads of differences in which many members meet; a head of several differences has one star."""
    rows = leading.filter((F.col("b") != F.col("head")) | (F.col("h") != F.col("head_h"))).select("a", "mark", "b", "h", "head", "head_h").distinct()
    one = ordered.select("a", "mark", "b", "h", "n", "differences")
    heads = ordered.select("a", "mark", F.col("b").alias("head"), F.col("h").alias("head_h"), F.col("n").alias("n_a"), F.col("differences").alias("from"))
    both = rows.join(one, ["a", "mark", "b", "h"]).join(heads, ["a", "mark", "head", "head_h"])
    differ = F.concat(F.array_except("differences", "from"), F.array_except("from", "differences"))
    found = both.select(F.col("head").alias("a"), F.xxhash64("a", "mark", "head", "head_h").alias("mark"), "b", "n", "n_a", differ.alias("differences"))
    return found.withColumn("h", F.xxhash64("differences"))


def without_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, all its columns, for each group of near duplicates: that of the least doc_id, and of its rows the one whose text hashes lowest."""
    found = materialize(near_duplicates(docs, width, percent), "judged")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
    again = found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_rows")).filter("_rows > 1").select("_again")
    if again.isEmpty():
        return left
    repeated = left["doc_id"].cast("bigint") == again["_again"]
    rows = left.join(again, repeated, "left_semi")
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*rows.columns), row_key()).alias("_row")).select("_row.*")
    return left.join(again, repeated, "left_anti").unionByName(one)
