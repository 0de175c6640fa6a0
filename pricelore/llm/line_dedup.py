r"""Operator 12: lines that many documents share, by sharded minimal perfect hashes.

A line's key is the line without white space (``[\x20\x09-\x0D]``) at both ends and with A-Z lower-cased. The distinct hashes (128 bits) of the keys of at least ``MIN_CHARS`` code points are counted over documents, and those found in at least ``MIN_DOCS`` are indexed: they are dealt to shards of about
``SHARD_KEYS`` by their upper bits, and each shard is a minimal perfect hash (levels of bit arrays: what stands alone in a level is placed there, the rest goes on) with arrays of fingerprints, counts and last documents in its order. Documents then probe the arrays:

* while the index is at most ``BROADCAST_BYTES`` (checked), each task holds all shards and reads texts once, without a shuffle;
* beyond it, each document's distinct line hashes are dealt to the shards (those of a shard that is asked for more than ``PIECE`` times in pieces, so that a line of a third of all documents is many tasks' work), each piece meets its shard once, and what is found goes back to the documents.

Both ways give the same rows. All lines of such a key are dropped, but for those of the document with the largest id that holds it; other lines stay, joined by ``\n``.

Edge cases: a null or empty text is one empty line; a row is a document, so rows with the same id count each, and as the largest id they all keep their lines; a null id is less than all others; of equal keys within a document all are dropped or none; very long lines and texts are whole keys
and whole texts; an empty table gives no rows; columns other than doc_id and text are passed on by ``without_shared_lines``, whatever their names, and ignored by ``report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm._common import cut, table, utf8_slices

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS, PIECE = 1 << 18, 1 << 20
BROADCAST_BYTES = 48 << 20
SLICE_BYTES = 8_000_000
#: Slots for each key of a level.
ROOM = 1.5
NO_ID = -(2**63)
SPACE = b" \t\n\x0b\x0c\r"
INDEX = "shard int, keys long, levels array<binary>, sizes array<long>, prints array<long>, counts array<long>, lasts array<long>"
_KEYS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("last", pa.int64())])


def line_key(line: bytes) -> bytes | None:
    """The key of a line in UTF-8; none if it is too short to count."""
    key = line.strip(SPACE).lower()  # bytes: A-Z alone
    return key if len(key) >= 4 * MIN_CHARS or len(key) >= MIN_CHARS and len(key.decode()) >= MIN_CHARS else None


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hi, lo) of the key of each line that has one, in order of the lines."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    of, raw = [], []
    for k, text in enumerate(texts):
        found = [digest(key) for line in text.split(b"\n") if len(line) >= MIN_CHARS and (key := line_key(line)) is not None]
        raw += found
        of.append(len(found))
    both = np.frombuffer(b"".join(raw), ">i8").astype(np.int64).reshape(-1, 2)
    return np.repeat(np.arange(len(texts)), of), both[:, 0], both[:, 1]


def line_counts(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """(hi, lo, n, last): hashes of the keys in at least ``least`` documents, with the largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for a, b, texts in utf8_slices(batch.column(1), SLICE_BYTES):
                of, hi, lo = hashes(texts)
                rows = np.unique(np.stack([hi, lo, of], axis=1), axis=0) if len(of) else np.zeros((0, 3), np.int64)
                first = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))) if len(rows) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(rows)))
                last = np.maximum.reduceat(ids[a:b][rows[:, 2]], first) if len(first) else first
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[first, 0], rows[first, 1], n, last)], schema=_KEYS)

    each = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "hi long, lo long, n long, last long")
    return each.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= least)


def _slot(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of hashes among ``size`` slots, another one at each level."""
    x = hi.view(np.uint64) ^ (lo.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(level * 0xD1B54A32D192ED03 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build(hi: np.ndarray, lo: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """The levels (bits) of a minimal perfect hash of distinct hashes, and their sizes."""
    levels, sizes, level = [], [], 0
    while len(hi):
        size = -(-max(64, int(len(hi) * ROOM)) // 64) * 64
        at = _slot(hi, lo, level, size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        sizes.append(size)
        left = ~alone[at]
        hi, lo, level = hi[left], lo[left], level + 1
    return levels, sizes


class Shard:
    """A minimal perfect hash with its arrays."""

    def __init__(self, levels: list[bytes], sizes: list[int], prints: np.ndarray, counts: np.ndarray, lasts: np.ndarray):
        self.words = [np.frombuffer(x, "<u8") for x in levels]
        self.sizes, self.prints, self.counts, self.lasts = list(sizes), prints, counts, lasts
        self.before, total = [], 0
        for w in self.words:
            ones = np.bitwise_count(w).astype(np.int64)
            self.before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The number of each hash; of one that isn't a key, any number or -1."""
        out, todo = np.full(len(hi), -1), np.arange(len(hi))
        for level, (words, size) in enumerate(zip(self.words, self.sizes, strict=True)):
            at = _slot(hi[todo], lo[todo], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[there]] = self.before[level][at[there] >> 6] + below[there]
            todo = todo[~there]
        return out

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, last document) of each hash; 0 for those that aren't keys. The fingerprint is the lower half of the hash; slots are chosen by both."""
        at = self.find(hi, lo)
        key = at >= 0
        key[key] = self.prints[at[key]] == lo[key]
        counts, lasts = np.zeros(len(hi), np.int64), np.full(len(hi), NO_ID)
        counts[key], lasts[key] = self.counts[at[key]], self.lasts[at[key]]
        return counts, lasts


def _shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return ((hi.view(np.uint64) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def index(counted: DataFrame) -> DataFrame:
    """One row a shard, built by a task each, of (hi, lo, n, last)."""
    keys = counted.count()
    shards = max(1, -(-keys // SHARD_KEYS))

    def run(t: pa.Table) -> pa.Table:
        hi, lo, n, last = (t.column(c).to_numpy() for c in ("hi", "lo", "n", "last"))
        levels, sizes = build(hi, lo)
        order = np.argsort(Shard([x.tobytes() for x in levels], sizes, lo, n, last).find(hi, lo))
        row = {"shard": int(_shard_of(hi[:1], shards)[0]), "keys": len(hi), "levels": [x.tobytes() for x in levels], "sizes": sizes, "prints": lo[order], "counts": n[order], "lasts": last[order]}
        return pa.table({"shard": pa.array([row["shard"]], pa.int32()), "keys": pa.array([row["keys"]], pa.int64()), "levels": pa.array([row["levels"]], pa.list_(pa.binary())), **{c: pa.array([row[c]], pa.list_(pa.int64())) for c in ("sizes", "prints", "counts", "lasts")}})

    shard = F.pmod(F.shiftrightunsigned("hi", 32), F.lit(shards))
    return cut(counted.groupBy(shard.alias("shard_")).applyInArrow(run, INDEX))


def _shards(rows: list[tuple]) -> dict[int, Shard]:
    return {s: Shard(levels, sizes, *(np.asarray(x, np.int64) for x in arrays)) for s, levels, sizes, *arrays in rows}


def _dropped(shards: dict[int, Shard], n_shards: int, hi: np.ndarray, lo: np.ndarray, ids: np.ndarray, least: int) -> np.ndarray:
    """Which hashes' lines go from documents of these ids."""
    out, of = np.zeros(len(hi), bool), _shard_of(hi, n_shards)
    for s in np.unique(of):
        if s in shards:
            here = of == s
            counts, lasts = shards[s].probe(hi[here], lo[here])
            out[here] = (counts >= least) & (lasts != ids[here])
    return out


def _kept(text: bytes, dropped) -> tuple[int, list[bytes]]:
    """How many lines a text has and those that stay; ``dropped`` yields what goes for each line with a key."""
    lines = text.split(b"\n")
    return len(lines), [x for x in lines if len(x) < MIN_CHARS or line_key(x) is None or not next(dropped)]


def _cleaned(docs: DataFrame, schema: str, emit, least: int, broadcast_bytes: int) -> DataFrame:
    """``emit`` (batch, from, to, [(lines, kept lines)]) of the rows of ``docs``, whose lines are dropped by the index."""
    spark = docs.sparkSession
    counted = cut(line_counts(docs, least))
    known = index(counted)
    sizes = {r["shard"]: (r["keys"], r["asked"]) for r in known.select("shard", "keys", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("asked")).collect()}  # a row for each shard
    n_shards = max(1, -(-sum(k for k, _ in sizes.values()) // SHARD_KEYS))

    def ids_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)

    if sum(k for k, _ in sizes.values()) * 32 <= broadcast_bytes:
        rows = [tuple(r) for r in known.drop("keys").collect()]  # at most broadcast_bytes
        packed = spark.sparkContext.broadcast([(s, [bytes(x) for x in levels], sizes_, *(np.array(x, np.int64) for x in arrays)) for s, levels, sizes_, *arrays in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = _shards(packed.value)
            for batch in batches:
                ids = ids_of(batch)
                for a, b, texts in utf8_slices(batch.column(batch.schema.get_field_index("text")), SLICE_BYTES):
                    of, hi, lo = hashes(texts)
                    gone = iter(_dropped(shards, n_shards, hi, lo, ids[a:b][of], least).tolist())
                    yield emit(batch, a, b, [_kept(t, gone) for t in texts])

        return docs.mapInArrow(run, schema)

    # beyond the bound: hashes go to the shards, results come back by a key of id and text, which equal rows share
    pieces = spark.createDataFrame([(s, max(1, -(-asked // PIECE))) for s, (_, asked) in sizes.items()], "shard int, pieces int")
    key = F.struct(F.xxhash64(F.lit(1), "doc_id", "text").alias("a"), F.xxhash64(F.lit(2), "text", "doc_id").alias("b"))
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", "text", key.alias("key"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ids_of(batch)
            for a, b, texts in utf8_slices(batch.column(1), SLICE_BYTES):
                of, hi, lo = hashes(texts)
                yield pa.RecordBatch.from_arrays([pa.array(_shard_of(hi, n_shards), pa.int32()), batch.column(2).slice(a, b - a).take(pa.array(of)), pa.array(ids[a:b][of]), pa.array(hi), pa.array(lo)], names=["shard", "key", "doc_id", "hi", "lo"])

    asked = plain.mapInArrow(ask, "shard int, key struct<a: long, b: long>, doc_id long, hi long, lo long").distinct().join(F.broadcast(pieces), "shard")
    asked = asked.withColumn("piece", F.pmod("key.a", "pieces").cast("int"))
    held = known.join(F.broadcast(pieces), "shard").select(*known.columns, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))

    def answer(probes: pa.Table, arrays: pa.Table) -> pa.Table:
        if not arrays.num_rows or not probes.num_rows:
            return probes.slice(0, 0).select(["key", "hi", "lo"])
        row = arrays.slice(0, 1)
        shard = Shard(row["levels"][0].as_py(), row["sizes"][0].as_py(), *(row[c].combine_chunks().values.to_numpy() for c in ("prints", "counts", "lasts")))
        counts, lasts = shard.probe(probes["hi"].to_numpy(), probes["lo"].to_numpy())
        return probes.filter(pa.array((counts >= least) & (lasts != probes["doc_id"].to_numpy()))).select(["key", "hi", "lo"])

    found = asked.select("shard", "piece", "key", "doc_id", "hi", "lo").groupBy("shard", "piece").cogroup(held.groupBy("shard", "piece")).applyInArrow(answer, "key struct<a: long, b: long>, hi long, lo long")
    gone = found.groupBy("key").agg(F.collect_list(F.struct("hi", "lo")).alias("gone"))  # of one document's lines
    own = F.struct(F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("a"), F.xxhash64(F.lit(2), F.col("text").cast("string"), F.col("doc_id").cast("long")).alias("b"))
    joined = docs.select(F.struct("*").alias("row"), own.alias("key")).join(gone, "key", "left").select("row", "gone")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column(0))
            for a, b, texts in utf8_slices(rows.column(rows.schema.get_field_index("text")), SLICE_BYTES):
                of, hi, lo = hashes(texts)
                lost = [{(x["hi"], x["lo"]) for x in own_ or ()} for own_ in batch.column(1).slice(a, b - a).to_pylist()]
                drop = iter([(h, low) in lost[d] for d, h, low in zip(of.tolist(), hi.tolist(), lo.tolist(), strict=True)])
                yield emit(rows, a, b, [_kept(t, drop) for t in texts])

    return joined.mapInArrow(finish, schema)


def report(docs: DataFrame, least: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row."""
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]

    def emit(batch: pa.RecordBatch, a: int, b: int, kept: list) -> pa.RecordBatch:
        ids = batch.column(batch.schema.get_field_index("doc_id")).slice(a, b - a)
        return pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in kept], pa.int64()), pa.array([n - len(x) for n, x in kept], pa.int64()), pa.array([hashlib.sha256(b"\n".join(x)).hexdigest() for _, x in kept], pa.string())], names=names)

    return _cleaned(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_lines long, n_dropped long, kept_sha256 string", emit, least, broadcast_bytes)


def without_shared_lines(docs: DataFrame, least: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` with the text that is left; ``n_chars`` follows it where there is one. Null texts stay null."""
    fields = docs.schema

    def emit(batch: pa.RecordBatch, a: int, b: int, kept: list) -> pa.RecordBatch:
        k, part = batch.schema.get_field_index("text"), batch.slice(a, b - a)
        null = part.column(k).is_null().to_pylist()
        texts = [None if no else b"\n".join(x).decode() for no, (_, x) in zip(null, kept, strict=True)]
        return part.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    out = _cleaned(docs, fields, emit, least, broadcast_bytes)
    return out.withColumn("n_chars", F.length("text").cast(fields["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op12_hashed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH l AS (SELECT doc_id, r, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, r, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT r) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key),
j AS (SELECT k.doc_id, k.r, k.pos, k.line, coalesce(c.n >= 3 AND k.doc_id IS DISTINCT FROM c.last, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::bigint AS n_lines, count(*) FILTER (gone)::bigint AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id, r"""
