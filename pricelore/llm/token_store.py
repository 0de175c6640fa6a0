"""Operator 8: token ids in Simple-8b blocks.

``write_tokens`` encodes texts, appends the end id and writes blocks of 64-bit words in ascending id order; ``read_tokens`` decodes
them. A word holds a selector in its top 4 bits and 60 // width ids of ``width`` bits below. Values of over 60 bits are escapes: the word has selector
15 and the value stands in the block's escape list. A block starts at a word boundary every ``BLOCK`` ids, and ``word_offsets`` has its first word,
so that any block is decoded alone and all blocks of a row at once.

Edge cases: a null text counts as empty and gives only the end id; rows with equal or null ``doc_id`` keep a place each (null first, then by text);
an empty table gives an empty store; other columns are ignored. A very long text is a slice of its own; a worker then holds that text's words and ids. Repeated rows are repeated in the store.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelore.llm._common import partitions, shared_dir, table

END_ID = 2
BLOCK = 16384
#: Bits of an id by selector; 15 is the escape.
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
COUNTS = 60 // WIDTHS
ESCAPE = 15
#: Characters that are encoded at once, and words that the cache of a Python worker holds; it lives as long as the worker, over its tasks.
SLICE_CHARS = 2_000_000
CACHE_WORDS = 1_200_000
#: Words that go through the tokenizer as one text.
RUN = 300
WHITE = frozenset(c for c in map(chr, range(0x110000)) if c.isspace())

SCHEMA = "part int, row int, first_id long, doc_ids array<long>, lengths array<int>, starts array<long>, n_ids long, word_offsets array<int>, words binary, escapes binary"


#: The narrowest selector for ids below 2 ** 16.
NARROWEST = np.searchsorted(WIDTHS, np.frexp(np.maximum(np.arange(1 << 16), 1))[1]).astype(np.int8)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all blocks, the escapes, and where each block's words begin. Each word takes as many ids as fit; the last of a block is filled up with zeros.

    All blocks are walked side by side: a row for each, with the place of the word that each begins at present.
    """
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks, size = -(-n // block), min(block, n)
    width = size + int(COUNTS[0])  # zeros behind each block
    values = np.zeros((blocks, width), np.uint64)
    full = n // size
    values[:full, :size] = ids[: full * size].reshape(full, size)
    values[full:, : n - full * size] = ids[full * size :]
    values = values.ravel()
    ends = np.full(blocks, size)
    ends[-1] = n - (blocks - 1) * size
    ends += np.arange(blocks) * width
    need = NARROWEST[values] if ids.max() < 1 << 16 else np.searchsorted(np.uint64(1) << WIDTHS.astype(np.uint64), values, side="right").astype(np.int8)
    choice = np.full(len(values), ESCAPE, dtype=np.int8)
    top, reach = need, 1
    for s in range(len(WIDTHS) - 1, -1, -1):  # what fits with one count fits with each smaller one, so the last that fits stands
        while reach < COUNTS[s]:
            step = min(reach, int(COUNTS[s]) - reach)
            wider = top.copy()
            np.maximum(top[:-step], top[step:], out=wider[:-step])
            top, reach = wider, reach + step
        np.copyto(choice, np.int8(s), where=top <= s)
    hop = np.arange(len(values)) + np.concatenate([COUNTS, [1, 1]])[choice]
    for row in range(blocks):
        stop = ends[row]
        hop[stop : (row + 1) * width] = stop
        np.minimum(hop[max(stop - int(COUNTS[0]), 0) : stop], stop, out=hop[max(stop - int(COUNTS[0]), 0) : stop])
    places = [np.arange(blocks) * width]
    while (places[-1] < ends).any():
        run = np.empty((256, blocks), np.int64)
        np.take(hop, places[-1], out=run[0])
        for k in range(1, 256):
            np.take(hop, run[k - 1], out=run[k])
        places += list(run)
    starts = np.array(places).T
    begun = starts < ends[:, None]
    offsets = np.concatenate([[0], np.cumsum(begun.sum(axis=1))])[:-1]
    starts = starts[begun]
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.flatnonzero(np.bincount(chosen)):
        if s != ESCAPE:
            rows, w = np.flatnonzero(chosen == s), np.uint64(WIDTHS[s])
            own, at = words[rows], starts[rows]
            for k in range(int(COUNTS[s])):
                own |= values[at + k] << (np.uint64(k) * w)
            words[rows] = own
    return words, values[starts[chosen == ESCAPE]], offsets


def pack_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words and the escapes of one block."""
    return pack(ids, max(len(ids), 1))[:2]


def unpack(words: np.ndarray, escapes: np.ndarray, offsets: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """All ids of a row, in one pass over the words of all its blocks."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.where(selectors == ESCAPE, 1, COUNTS[np.minimum(selectors, len(COUNTS) - 1)])
    before = np.concatenate([[0], np.cumsum(counts)])
    of_block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    at = before[:-1] - before[offsets][of_block] + of_block * block  # where the word's first id goes
    out = np.zeros(n_ids + int(COUNTS[0]), dtype=np.uint64)
    for s in np.unique(selectors)[::-1]:
        rows = np.flatnonzero(selectors == s)
        if s == ESCAPE:
            out[at[rows]] = escapes
            continue
        c, w = int(COUNTS[s]), np.uint64(WIDTHS[s])
        mask = np.uint64((1 << int(w)) - 1)
        got = (words[rows][:, None] >> (np.arange(c, dtype=np.uint64) * w)) & mask
        to = at[rows][:, None] + np.arange(c)
        keep = to < np.minimum((of_block[rows] + 1) * block, n_ids)[:, None]  # the padding of a block's last word
        out[to[keep]] = got[keep]
    return out[:n_ids]


class WordEncoder:
    """Encodes texts piece by piece with a cache.

    A single space between two other characters always begins a new piece of the byte-level pattern, so what stands between such spaces is encoded on
    its own, once for each distinct string, and the ids are joined.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(self.tokenizer.get_vocab_size())])
        self.single = re.compile(r"(?<=\S) (?=\S)")
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.starts = np.zeros(1024, dtype=np.int64)
        self.lengths = np.zeros(1024, dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def learn(self, keys: list[str]) -> None:
        """Keys without spaces, and without white space at their ends, go through the tokenizer many at once: there, a word begins at each id whose string begins with a space. The others, and words of a run where that count differs, go alone."""
        outer = WHITE
        alone = [not k or k[0] in outer or k[-1] in outer or " " in k or "<" in k for k in keys]  # "<" may begin a special token
        plain, rest = [k for k, x in zip(keys, alone, strict=True) if not x], [k for k, x in zip(keys, alone, strict=True) if x]
        known, lengths, ids = [], [], []
        runs = [plain[k : k + RUN] for k in range(0, len(plain), RUN)]
        for run, got in zip(runs, self.tokenizer.encode_batch_fast([" " + " ".join(run) for run in runs], add_special_tokens=False), strict=True):
            joined = np.array(got.ids, dtype=np.uint32)
            first = np.flatnonzero(self.spaced[joined])
            if len(first) == len(run):
                known += run
                lengths.append(np.diff(first, append=len(joined)))
                ids.append(joined)
            else:
                rest += run
        got = [x.ids for x in self.tokenizer.encode_batch_fast([k[1:] if k[:1] == "\n" else " " + k for k in rest], add_special_tokens=False)]
        keys = known + rest
        lengths = np.concatenate([*lengths, np.fromiter(map(len, got), dtype=np.int64, count=len(got))])
        ids = np.concatenate([*ids, np.array([i for x in got for i in x], dtype=np.uint32)])
        base, total = len(self.cache), len(ids)
        while base + len(keys) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = ids
        self.starts[base : base + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[base : base + len(keys)] = lengths
        self.used += total
        self.cache.update(zip(keys, range(base, base + len(keys)), strict=True))

    def split(self, texts: list[str]) -> tuple[np.ndarray, pa.DictionaryArray]:
        """How many pieces each text has, and all pieces. The first of a text gets a line break in front: no other piece begins with white space."""
        whole = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(whole, r"[\s\pZ\x{85}\x{1c}-\x{1f}\v]{2}").to_numpy(zero_copy_only=False).nonzero()[0].tolist()
        pieces = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), whole, pa.scalar("\n", pa.large_string())), " ")
        sizes, flat = np.diff(pieces.offsets.to_numpy()), pieces.values
        if odd:  # runs of white space
            own = [self.single.split(texts[k]) for k in odd]
            for x in own:
                x[0] = "\n" + x[0]
            at = np.concatenate([[0], np.cumsum(sizes)])
            cuts, chunks = 0, []
            for k, x in zip(odd, own, strict=True):
                chunks += [flat[cuts : at[k]], pa.array(x, pa.large_string())]
                cuts, sizes[k] = at[k + 1], len(x)
            flat = pa.concat_arrays([*chunks, flat[cuts:]])
        return sizes, flat.dictionary_encode()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self.cache) > CACHE_WORDS:
            self.clear()
        sizes, pieces = self.split(texts)
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.cache.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(known < 0)
        if len(new):
            own = [words[k] for k in new.tolist()]
            self.learn(own)
            known[new] = [self.cache[w] for w in own]
        lengths_of, starts_of = self.lengths[known].astype(np.int32), self.starts[known].astype(np.int32)
        index = pieces.indices.to_numpy()
        lengths = lengths_of[index]
        ends = np.cumsum(lengths, dtype=np.int32)
        ids = self.pool[np.repeat(starts_of[index] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(tokenizer_path: str) -> WordEncoder:
    """The worker's encoder."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield start, k + 1
            start, chars = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Writes the store of ``docs`` (doc_id, text) to ``path``: Parquet rows of some hundred documents with their blocks."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, row, before = encoder_of(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(all_texts):
                ids, lengths = encoder.encode(all_texts[a:b])
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, end_id)
                lengths = lengths + 1
                starts = before + np.cumsum(lengths) - lengths
                words, escapes, offsets = pack(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()), pa.array([row], pa.int32()), pa.array([min((x for x in all_ids[a:b] if x is not None), default=None)], pa.int64()),
                        pa.array([all_ids[a:b]], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([starts], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()),
                        pa.array([offsets], pa.list_(pa.int32())), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([escapes.astype("<u8").tobytes()], pa.binary()),
                    ],
                    names=["part", "row", "first_id", "doc_ids", "lengths", "starts", "n_ids", "word_offsets", "words", "escapes"],
                )
                row, before = row + 1, before + len(ids)

    spark = docs.sparkSession
    dealt = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(encode, SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files at ``path``."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each partition that wrote
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = unpack(np.frombuffer(x["words"], "<u8"), np.frombuffer(x["escapes"], "<u8"), np.array(x["word_offsets"], dtype=np.int64), x["n_ids"]).astype("<u4")
                lengths = np.array(x["lengths"], dtype=np.int64)
                at = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["doc_ids"], pa.int64()), pa.array(np.array(x["starts"], dtype=np.int64) + x["before"]), pa.array(lengths), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return rows.join(F.broadcast(before), "part").select("doc_ids", "lengths", "starts", "n_ids", "word_offsets", "words", "escapes", "before").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
