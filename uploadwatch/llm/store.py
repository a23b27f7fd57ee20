"""Token-ID / binary output (8): a content-addressed store of token id streams.

A rolling hash over the ids cuts each stream where its value meets a mask, so equal passages give equal
chunks wherever they stand.  A chunk's address is the SHA-256 of its ids; the store holds each chunk once
and a recipe (list of addresses) per document.  A document's root is the SHA-256 of its addresses.  The manifest
is a Merkle tree: its leaves are the documents that start within PART ids of the stream, its nodes join FAN
nodes each, up to one root, so nodes do not depend on how files are split.  Reading works the tree out again
from the recipes and checks each chunk against its address, so a lost or changed recipe, chunk or manifest row
is an error.

Layout of a store folder, all Parquet:
  pool/kind=0   address, ids (little-endian; 16 bits where the vocabulary allows it), in order of addresses
  recipes       doc_id, start, n_tokens, addresses (32 bytes each), sizes, ends, root; ascending by doc_id
  manifest      level, part, documents, root

One shuffle writes it: chunk rows go to the partition of their address, where one of them stays;
a map task sends an address once, so a passage that stands in a third of all documents stays small.

Cases: null and empty texts hold only the end id; a null doc_id sorts first; rows with one doc_id are kept
all, ordered by root; further columns are not read; an empty table gives an empty store.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uploadwatch.llm.codec import codec, decode_texts, tokenizer_path
from uploadwatch.llm.common import bounded_batches, in_order, map_batches, text_bytes
from uploadwatch.llm.tokens import TOKENIZER
from uploadwatch.scratch import drop_path, scratch_path

END_ID = 0
WINDOW, LEAST, MASK, MOST = 16, 64, 0xFF, 4096  # ids: hash window, least chunk, one cut in 256, longest chunk
ROWS = 256
PART, FAN = 1 << 20, 1024  # ids of a leaf (each document has one at least), nodes below a node
WORDS = 1_500_000  # words whose ids a worker remembers; encoding takes most of the time
SEEN_LIMIT = 200_000  # addresses that a map task remembers as sent


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the WINDOW ids before a position meets the mask."""
    if len(ids) <= WINDOW:
        return np.empty(0, np.int64)
    total, span = _mixed(ids), 1
    while span < WINDOW:  # hashes of twice as many ids, from two of the last length
        power = np.uint64(pow(0x5851F42D4C957F2D, span, 1 << 64))
        total = total[:-span] * power + total[span:]
        span *= 2
    return np.flatnonzero(((total >> np.uint64(40)) & np.uint64(MASK)) == 0) + WINDOW


def chunk_ends(size: int, points: np.ndarray) -> list[int]:
    """Ends of a document's chunks: the first cut point at least LEAST ids on, MOST at most."""
    ends, at = [], 0
    for p in points.tolist():
        while p - at > MOST:
            at += MOST
            ends.append(at)
        if p - at >= LEAST and p < size:
            at = p
            ends.append(at)
    while size - at > MOST:
        at += MOST
        ends.append(at)
    return [*ends, size] if size > at else ends


def _rows(path: str):
    """Recipe rows (kind 1), numbered, and, once per task and address, chunk rows (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        source, number = codec(path), TaskContext.get().partitionId() << 40 if TaskContext.get() else 0
        width, end = source.dtype.itemsize, source.pack([END_ID])
        if source.map is not None:
            source.map.words.limit = WORDS
        seen: set[bytes] = set()
        # A few hundred documents at a time: the hashes of a whole batch would take 30 bytes for each of its ids.
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            if len(seen) > SEEN_LIMIT:
                seen.clear()
            streams = [x + end for x in source.encode(decode_texts(batch.column(1)))]
            sizes = np.array([len(x) // width for x in streams])
            starts = np.cumsum(sizes) - sizes
            points = cut_points(np.frombuffer(b"".join(streams), source.dtype))
            first, past = np.searchsorted(points, starts + WINDOW), np.searchsorted(points, starts + sizes)
            recipes, lengths, ends, roots, addresses, chunks = [], [], [], [], [], []
            for k, stream in enumerate(streams):
                at, own, spans = 0, [], []
                ends.append(chunk_ends(int(sizes[k]), points[first[k] : past[k]] - starts[k]))
                for to in ends[-1]:
                    chunk = stream[at * width : to * width]
                    address = hashlib.sha256(chunk).digest()
                    own.append(address)
                    spans.append(to - at)
                    at = to
                    if address not in seen:
                        seen.add(address)
                        addresses.append(address)
                        chunks.append(chunk)
                recipes.append(b"".join(own))
                lengths.append(spans)
                roots.append(hashlib.sha256(recipes[-1]).digest())
            n, m = len(streams), len(chunks)
            number += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([1] * n + [0] * m, pa.int32()), pa.array(roots + addresses, pa.binary()), pa.array([*range(number - n, number), *[0] * m], pa.int64()),
                    pa.array(batch.column(0).to_pylist() + [None] * m, pa.int64()), pa.array(sizes.tolist() + [None] * m, pa.int64()),
                    pa.array(recipes + [None] * m, pa.binary()), pa.array(lengths + [None] * m, pa.list_(pa.int32())), pa.array(ends + [None] * m, pa.list_(pa.int64())), pa.array([None] * n + chunks, pa.binary()),
                ],
                names=["kind", "address", "number", "doc_id", "n_tokens", "addresses", "sizes", "ends", "ids"],
            )

    return run


def merkle(recipes: DataFrame) -> DataFrame:
    """level, part, documents, root of the tree over recipes (doc_id, start, n_tokens, root); the single node of the highest level is the store's root."""
    hashed = lambda marks: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(marks)), lambda x: x["root"]), ","), 256)
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens", F.hex("root")), 256)
    nodes = recipes.select((F.col("start") / PART).cast("bigint").alias("part"), "start", leaf.alias("root"))
    nodes = nodes.groupBy("part").agg(F.count("*").alias("documents"), hashed(F.struct("start", "root")).alias("root"))
    ids = recipes.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] or 0
    levels = [nodes.select(F.lit(0).alias("level"), "part", "documents", "root")]
    parts = -(-ids // PART)
    while parts > 1:
        below = levels[-1].select((F.col("part") / FAN).cast("bigint").alias("up"), "part", "documents", "root")
        nodes = below.groupBy(F.col("up").alias("part")).agg(F.sum("documents").alias("documents"), hashed(F.struct("part", "root")).alias("root"))
        levels.append(nodes.select(F.lit(len(levels)).alias("level"), "part", "documents", "root"))
        parts = -(-parts // FAN)
    return functools.reduce(DataFrame.unionByName, levels)


def verify(spark: SparkSession, path: str) -> None:
    """Fails unless the manifest is what its recipes give."""
    held = spark.read.schema("level int, part bigint, documents bigint, root string").parquet(f"{path}/manifest")
    found = merkle(read_recipes(spark, path))
    same = held.join(found.select("level", "part", F.col("documents").alias("n"), F.col("root").alias("own")), ["level", "part"], "full_outer")
    if not same.filter(~(F.col("root").eqNullSafe(F.col("own")) & F.col("documents").eqNullSafe(F.col("n")))).isEmpty():
        raise ValueError("the recipes do not match the manifest")


def write_store(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Encode whole texts, append END_ID to each and write the store to a folder that all executors share."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("bigint"), text_bytes()).mapInArrow(
        _rows(tokenizer_path(tokenizer)), "kind int, address binary, number bigint, doc_id bigint, n_tokens bigint, addresses binary, sizes array<int>, ends array<bigint>, ids binary"
    )
    # Dealt out before they are grouped, so nothing is sorted or merged on the way there; a root can repeat (copies), its number cannot.
    keys = ["kind", "address", "number"]
    dealt = rows.repartition(*keys).groupBy(*keys).agg(*(F.first(c).alias(c) for c in rows.columns if c not in keys)).drop("number")
    # Chunks hardly ever repeat by then, so a dictionary of them only costs time.
    dealt.write.partitionBy("kind").option("compression", "snappy").option("parquet.enable.dictionary", "false").parquet(f"{path}/pool")
    spark = docs.sparkSession
    recipes = spark.read.schema(dealt.schema).parquet(f"{path}/pool").filter("kind = 1").select("doc_id", "n_tokens", "addresses", "sizes", "ends", F.col("address").alias("root"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("root")]
    numbered = in_order(recipes, order, None, "n_tokens", "recipes").withColumnRenamed("before", "start")
    # Ranges of the offset follow the order of ids.
    numbered.repartitionByRange("start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_path(spark, f"{path}/pool/kind=1")
    merkle(read_recipes(spark, path)).write.parquet(f"{path}/manifest")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in GF(2)[x] modulo the CRC's polynomial, bit-reflected; a broadcasts against b."""
    out, a, b = np.zeros(np.broadcast(a, b).shape, np.uint32), a.copy(), b.copy()
    for _ in range(32):
        out ^= np.where(a >> np.uint32(31), b, np.uint32(0))
        a = a << np.uint32(1)
        b = (b >> np.uint32(1)) ^ (b & np.uint32(1)) * np.uint32(0xEDB88320)
    return out


@functools.cache
def _powers() -> np.ndarray:
    """x to the 32 d 256^k for digits d and k = 0..4: what moves a checksum past d 256^k ids of 4 bytes."""
    rows, step = [], np.full(1, 1 << 23, np.uint32)  # x to the 8
    for _ in range(2):
        step = _times(step, step)
    for _ in range(5):
        row = [np.full(1, 1 << 31, np.uint32)]
        for _ in range(256):
            row.append(_times(row[-1], step))
        step = row.pop()
        rows.append(np.concatenate(row))
    return np.array(rows)


def _shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRC-32 values moved past ``after`` ids of 4 bytes each."""
    out, left = crc.astype(np.uint32), after.astype(np.int64)
    for row in _powers():
        if not left.any():
            return out
        out = _times(row[left & 255], out)
        left = left >> 8
    if left.any():
        raise ValueError("a document of more than 2^40 ids")
    return out


def read_chunks(spark: SparkSession, path: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """address, n, crc (of the ids as unsigned 32-bit integers), as the pool's files have them; fails if ids do not give their address."""
    name = tokenizer_path(tokenizer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = codec(name).dtype
        crcs, sizes = [], []
        for address, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if hashlib.sha256(ids).digest() != address:
                raise ValueError(f"chunk {address.hex()} does not match its address")
            found = np.frombuffer(ids, kind)
            crcs.append(zlib.crc32(found.astype("<u4")))
            sizes.append(len(found))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["address", "n", "crc"])

    pool = spark.read.schema("address binary, ids binary, kind int").parquet(f"{path}/pool").filter("kind = 0").select("address", "ids")
    return map_batches(pool, run, "address binary, n bigint, crc bigint")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, n_tokens bigint, addresses binary, sizes array<int>, ends array<bigint>, root binary, start bigint").parquet(f"{path}/recipes")


def read_documents(spark: SparkSession, path: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, put together from its chunks' checksums.

    The checksum of a stream is the exclusive or of its chunks' checksums, each moved past the bytes after
    it, so chunks join by address as small rows and sum without an order; the ids of a document need not come
    together (read_ids does that).  Recipes are checked against the manifest first; a chunk that is missing,
    has another length or does not match its address fails the query.
    """
    verify(spark, path)

    def move(batch: pa.RecordBatch) -> pa.RecordBatch:
        moved = _shifted(batch.column("crc").to_numpy(), batch.column("after").to_numpy()).astype(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(moved)], names=["doc_id", "start", "n_tokens", "moved"])

    recipes = read_recipes(spark, path)
    whole = (F.unhex(F.sha2("addresses", 256)) == F.col("root")) & (F.element_at("ends", -1) == F.col("n_tokens")) & (F.length("addresses") == 32 * F.size("ends"))
    checked = recipes.withColumn("ends", F.when(whole, F.col("ends")).otherwise(F.raise_error(F.lit("a recipe does not match its root")).cast("array<bigint>")))
    pieces = checked.select("doc_id", "start", "n_tokens", "addresses", "ends", F.posexplode("ends").alias("k", "end"))
    size = F.col("end") - F.when(F.col("k") > 0, F.get("ends", F.col("k") - 1)).otherwise(0)
    pieces = pieces.select("doc_id", "start", "n_tokens", F.substring("addresses", F.col("k") * 32 + 1, F.lit(32)).alias("address"), (F.col("n_tokens") - F.col("end")).alias("after"), size.alias("size"))
    joined = pieces.join(read_chunks(spark, path, tokenizer), "address", "left")
    crc = F.when(F.col("n").eqNullSafe(F.col("size")), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing")).cast("bigint"))
    moved = map_batches(joined.select("doc_id", "start", "n_tokens", "after", crc.alias("crc")), move, "doc_id bigint, start bigint, n_tokens bigint, moved bigint")
    # start tells documents apart: each holds its end id at least.
    return moved.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("moved").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str, doc_ids: list[int], tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, start, ids array<bigint> of some documents, put together from the pool."""
    dtype = codec(tokenizer_path(tokenizer)).dtype.str
    wanted = read_recipes(spark, path).filter(F.col("doc_id").isin(doc_ids)).select(
        "doc_id", "start", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("sizes") - 1), lambda i: F.substring("addresses", i * 32 + 1, F.lit(32)))).alias("seq", "address")
    )
    pool = spark.read.schema("address binary, ids binary, kind int").parquet(f"{path}/pool").filter("kind = 0").select("address", "ids")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.concatenate([np.frombuffer(c["ids"], dtype) for c in chunks]).astype(np.int64) for chunks in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    gathered = wanted.join(pool, "address").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("seq", "ids"))).alias("chunks"))
    return map_batches(gathered, run, "doc_id bigint, start bigint, ids array<bigint>")


def store_and_read(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    spark = docs.sparkSession
    path = scratch_path(spark, "store")
    write_store(docs, path, tokenizer)
    return read_documents(spark, path, tokenizer)
