r"""Operator 13: phrases of two to five words that belong together, for each language.

Texts are lower-cased (A-Z), split at ``[.,;:!?\x0A-\x0D]`` into pieces and those at spaces and tabs into words. All text is read once and stored as blocks of word numbers; the rest works on numbers:

1. Words are counted from the blocks' own counts. Those of at least ``LEAST`` get numbers (of one language each, so a phrase of numbers has a language); all others and the ends of pieces are 0.
2. For two and three words in turn, each task sorts the hashes of the positions whose shorter phrases may all be frequent and gives the buckets that it met with their counts; the sum over tasks is one bit a bucket. No task holds the table. Only phrases in full buckets, of which all shorter phrases
   are in full buckets too, can be frequent (Apriori). Four and five words need no table. Such phrases of the text are told with their counts by each part that holds their share; those whose told counts, with the most that the other parts may hold untold, are ``LEAST`` are the candidates, so none that is
   frequent is missed.
3. Candidates are put together by their first two words in shards, and a task makes each shard's double-array trie: ``base[state] + word`` is the next state if ``check`` there is the state. Tries are broadcast, as many at once as ``BROADCAST_BYTES`` allow. A task advances all positions' states at the same time, level
   by level, and adds up the states reached by ``bincount``; the sums over tasks are exact counts.
4. Scores, cuts and containment are joins of the frequent phrases, in decimals.

The size of what is broadcast: one bit for each bucket, compressed (``MAX_BUCKETS`` at most; a fuller table means more candidates, not other results), tries of ``BROADCAST_BYTES`` at most, in as many passes over the numbers as that takes, and the frequent words if they are no more than that (else they are joined).

Edge cases: null texts count as empty, a null language is ``und``; words of other white space or control characters are words; repeated rows count each; null doc_ids count like others; ties of score and count go by the phrase's bytes; a very long text is cut at its pieces' ends, a piece is never cut; an empty
table gives no rows; columns other than text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelore.llm._common import cut, numbered, shared_dir, table, utf8_slices

LEAST, LONGEST, TOP = 100, 5, 2000
#: In percent: a phrase goes if a longer one that contains it is found that often.
SHARE = 100
#: Lengths whose candidates a table of hashed counts thins out, and its bytes: a power of two for this many words of the corpus each.
HASHED, WORDS_A_BUCKET, MIN_BUCKETS, MAX_BUCKETS = (2, 3), 8, 1 << 16, 1 << 28
#: Words of a block and bytes of text read at once; positions worked on at once.
BLOCK_WORDS, SLICE_BYTES, POSITIONS = 1 << 20, 4_000_000, 1 << 22
#: Distinct words that a task keeps numbers of before it begins anew.
TASK_WORDS = 1_000_000
#: Pieces of candidates by their first two words: so many, or one for so many words of the corpus; and candidates of a shard.
PIECES, WORDS_A_PIECE, SHARD_PHRASES = 128, 1 << 21, 1 << 18
#: Buckets are added up in this many parts at most, so that a place within one fits in two bytes.
BUCKET_PARTS = 1 << 12
BROADCAST_BYTES, CHUNK = 64 << 20, 1 << 14
_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: One byte for each: A-Z in lower case, ends of pieces as a line feed, tabs as a space.
_FOLD = bytes(10 if c in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCKS = "block string, lang string, words array<string>, counts array<long>, codes binary"
TRIES = "shard int, base binary, check binary, states array<int>, phrases array<array<int>>"


class _Numbers(dict):
    """Words to numbers from 2 on, in order of appearance; 0 ends a piece and 1 is the nothing between two spaces."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of ``BLOCKS``: the distinct words of a block with their counts, and its words as places in that list, from 1; 0 ends a piece."""

    def block(numbers: _Numbers, lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.concatenate(parts)
        codes = codes[codes != 1]
        n = np.bincount(codes, minlength=len(numbers))
        own = np.flatnonzero(n[2:]) + 2
        place = np.zeros(len(numbers), np.int32)
        place[own] = np.arange(1, len(own) + 1)
        spelled = pa.array(list(numbers), pa.binary()).take(pa.array(own)).cast(pa.string())
        one = lambda values, kind: pa.array([values], kind)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), x) for x in (spelled, pa.array(n[own], pa.int64()))]
        return pa.RecordBatch.from_arrays([one(uuid.uuid4().hex, pa.string()), one(lang, pa.string()), *lists, one(place[codes].astype("<i4").tobytes(), pa.binary())], names=["block", "lang", "words", "counts", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, sizes = _Numbers(), {}, {}

        def flush(langs: list[str]) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                yield block(numbers, lang, held.pop(lang))
                del sizes[lang]

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, _, texts in utf8_slices(batch.column(1), SLICE_BYTES):
                for k, raw in enumerate(texts):
                    lang = langs[a + k]
                    raw, at = raw.translate(_FOLD), 0
                    while at < len(raw):
                        end = len(raw) if len(raw) - at <= SLICE_BYTES else raw.find(b"\n", at + SLICE_BYTES)
                        piece, at = (raw[at:end], end) if end >= 0 else (raw[at:], len(raw))
                        words = piece.replace(b"\n", b" \n ").split(b" ")
                        words.append(b"\n")
                        held.setdefault(lang, []).append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                        sizes[lang] = sizes.get(lang, 0) + len(words)
                        if sizes[lang] >= BLOCK_WORDS:
                            yield from flush([lang])
                        if len(numbers) > TASK_WORDS or sum(sizes.values()) > 8 * BLOCK_WORDS:
                            yield from flush(list(held))
                            numbers = _Numbers() if len(numbers) > TASK_WORDS else numbers
        yield from flush(list(held))

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string")).where("text is not null").mapInArrow(run, BLOCKS)


def encoded(store: DataFrame, words: DataFrame) -> DataFrame:
    """(ids): the blocks with the corpus' word numbers (words: lang, word, id). Up to ``BROADCAST_BYTES`` of words (summed first) go to the tasks as they are; more of them are joined to the blocks' words."""
    if (words.agg(F.sum(F.octet_length("word") + F.octet_length("lang") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        known: dict[str, dict[str, int]] = {}
        for lang, word, n in words.select("lang", "word", "id").collect():
            known.setdefault(lang, {})[word] = n
        sent = store.sparkSession.sparkContext.broadcast(known)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    own = sent.value.get(batch.column(0)[k].as_py(), {}).get
                    number = np.array([0, *(own(w, 0) for w in batch.column(1)[k].as_py())], "<i4")
                    yield pa.RecordBatch.from_arrays([pa.array([number[np.frombuffer(batch.column(2)[k].as_buffer(), "<i4")].tobytes()], pa.binary())], names=["ids"])

        return store.select("lang", "words", "codes").mapInArrow(look_up, "ids binary")
    each = store.select("block", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    own = each.groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                at, ids = (np.asarray(batch.column(c)[k].values, np.int64) for c in (0, 1))
                number = np.zeros(batch.column(2)[k].as_py() + 1, "<i4")
                number[at + 1] = ids
                out.append(number[np.frombuffer(batch.column(3)[k].as_buffer(), "<i4")].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return store.select("block", F.size("words").alias("n"), "codes").join(own, "block").select("at", "id", "n", "codes").mapInArrow(run, "ids binary")


def _positions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """Word numbers of some blocks side by side, ``size`` or somewhat more, with ``LONGEST`` ends of pieces after each."""
    held, n = [], 0
    for raw in chain.from_iterable(b.column(0) for b in batches):
        held += [np.frombuffer(raw.as_buffer(), "<i4"), np.zeros(LONGEST, "<i4")]
        n += len(held[-2])
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _hash(ids: np.ndarray, at: np.ndarray, k: int, buckets: int) -> np.ndarray:
    """The bucket of the k words from each place on."""
    h = np.full(len(at), k, np.uint64)
    for j in range(k):
        h = (h ^ ids[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h & np.uint64(buckets - 1)).astype(np.int64)


def _packed(full: dict[int, np.ndarray]) -> dict[int, bytes]:
    """Few buckets are full, so what is broadcast is much less than a bit for each."""
    import zstandard

    return {k: zstandard.ZstdCompressor(level=1).compress(bits.tobytes()) for k, bits in full.items()}


def _unpacked(sent: dict[int, bytes]) -> dict[int, np.ndarray]:
    import zstandard

    return {k: np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8) for k, bits in sent.items()}


def _levels(ids: np.ndarray, full: dict[int, np.ndarray], buckets: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, places) from which k words on may be a frequent phrase, by the full buckets that are known (``full``: bits by length)."""
    known = ids > 0
    for k in range(2, longest + 1):
        at = np.flatnonzero(known[:-1] & known[1:])
        at = at[at + k <= len(ids)]
        if k in full and len(at):
            b = _hash(ids, at, k, buckets)
            at = at[(full[k][b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1]
        yield k, at
        known = np.zeros(len(ids), bool)
        known[at] = True


def _chunks(counts: np.ndarray, shard: int = 0) -> Iterator[pa.RecordBatch]:
    """The parts of an array that hold something, compressed."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    rows = [(shard, k, pack(x.tobytes())) for k in range(-(-len(counts) // CHUNK)) if (x := counts[k * CHUNK : (k + 1) * CHUNK]).any()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary())], names=["shard", "chunk", "counts"])


def _added(chunks: DataFrame, finish, schema: str) -> DataFrame:
    """Sums of the chunks of all tasks; ``finish`` makes the rows of (shard, chunk, sums)."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, total = zstandard.ZstdDecompressor().decompress, np.zeros(CHUNK, np.int64)
        for batch in batches:
            for raw in batch.column(2):
                part = np.frombuffer(unpack(raw.as_py()), "<i8")
                total[: len(part)] += part
        yield finish(key[0].as_py(), key[1].as_py(), total)

    return chunks.groupBy("shard", "chunk").applyInArrow(run, schema)


def full_buckets(ids: DataFrame, k: int, full: dict[int, np.ndarray], buckets: int, least: int) -> np.ndarray:
    """One bit for each bucket: whether phrases of ``k`` words that fall in it are ``least`` together. Tasks hold the buckets of the positions that they work on, and in the sum one part of the table."""
    sent = ids.sparkSession.sparkContext.broadcast(_packed(full))
    size = max(CHUNK, buckets // BUCKET_PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        known = _unpacked(sent.value)
        for x in _positions(batches, POSITIONS):
            *_, (_, at) = _levels(x, known, buckets, k)
            met = np.sort(_hash(x, at, k, buckets).astype(np.uint32))
            first = np.flatnonzero(np.append(True, met[1:] != met[:-1])) if len(met) else np.zeros(0, np.int64)
            n = np.minimum(np.diff(np.append(first, len(met))), least).astype("<u2")
            met = met[first]
            step = np.diff(met, prepend=np.uint32(0)).astype("<u2")  # only the first of a part steps from elsewhere
            cuts = np.searchsorted(met, np.arange(0, buckets + 1, size).astype(np.uint32))
            own = np.flatnonzero(np.diff(cuts))
            step[cuts[own]] = met[cuts[own]] % np.uint32(size)
            packed = [pack(np.concatenate([y[cuts[j] : cuts[j + 1]].view(np.uint8)[b::2] for y in (step, n) for b in (0, 1)]).tobytes()) for j in own.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, total = zstandard.ZstdDecompressor().decompress, np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(1):
                low, high, n, more = np.frombuffer(unpack(raw.as_py()), np.uint8).reshape(4, -1).astype(np.int64)
                total[np.cumsum(low + (high << 8))] += n + (more << 8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    bits = np.zeros(buckets // 8, np.uint8)
    for r in ids.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, bits binary").collect():  # buckets / 8 bytes
        bits[r["part"] * size // 8 : (r["part"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    sent.destroy()
    return bits


def told(ids: DataFrame, full: dict[int, np.ndarray], buckets: int, least: int, words: int) -> DataFrame:
    """(piece, k, phrases, more, untold): the phrases of two to five numbers that may be frequent, side by side, by pieces of their first two words. A phrase that is ``least`` in a corpus of ``words`` is its share of that, or more, in one of the parts that tasks work on: others need not be told there. ``untold``
    is the most that a phrase may be in a part that doesn't tell it, and ``more`` by how much each phrase exceeds that. Every beginning of a phrase is told where the phrase is, and a part has a row for each piece and length."""
    sent = ids.sparkSession.sparkContext.broadcast(_packed(full))
    pieces = max(PIECES, words // WORDS_A_PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _unpacked(sent.value)
        for x in _positions(batches, POSITIONS):
            untold = max(-(-least * np.count_nonzero(x) // max(words, 1)) - 1, 0)
            state = x.copy()  # of the words before the last one: equal for equal words
            for k, at in _levels(x, known, buckets, LONGEST):
                _, first, of, n = np.unique((state[at].astype(np.int64) << 32) | x[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
                state[:] = 0
                state[at] = of + 1
                del of
                own, n = x[at[first[n > untold]][:, None] + np.arange(k)], n[n > untold]
                piece = _piece(own, pieces)
                order = np.argsort(piece, kind="stable")
                cuts = np.searchsorted(piece[order], np.arange(pieces + 1))
                lists = [pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(v, pa.int32())) for c, v in ((cuts * k, own[order].ravel()), (cuts, n[order] - untold))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces), pa.int32()), pa.array(np.full(pieces, k), pa.int32()), *lists, pa.array(np.full(pieces, untold), pa.int64())], names=["piece", "k", "phrases", "more", "untold"])

    return ids.mapInArrow(run, "piece int, k int, phrases array<int>, more array<int>, untold long")


def candidates(found: DataFrame, least: int) -> DataFrame:
    """(piece, k, phrases): those that are told and may be ``least`` in all parts together, each once. A beginning of one is one too."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = []
        for k in range(2, LONGEST + 1):
            own = t.filter(pc.equal(t["k"], k))
            untold = pc.sum(own["untold"]).as_py()
            phrases, more = own["phrases"].combine_chunks().flatten().to_numpy().reshape(-1, k), own["more"].combine_chunks().flatten().to_numpy()
            if len(phrases):
                order = np.lexsort(phrases.T[::-1])
                phrases = phrases[order]
                first = np.flatnonzero(np.append(True, (phrases[1:] != phrases[:-1]).any(axis=1)))
                phrases = phrases[first][np.add.reduceat(more[order].astype(np.int64), first) + untold >= least]
            if len(phrases):
                rows.append((key[0].as_py(), k, phrases.ravel()))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["piece", "k", "phrases"])

    return found.groupBy("piece").applyInArrow(run, "piece int, k int, phrases array<int>")


def _piece(phrases: np.ndarray, pieces: int) -> np.ndarray:
    h = phrases[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29)) ^ phrases[:, 1].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(pieces)).astype(np.int64)


def trie(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and the state of each phrase. phrases: rows of ``LONGEST`` numbers, padded by zeros, sorted, distinct, with every beginning of two or more words among them."""
    words = int(phrases.max(initial=0))
    size = words + 2 + 2 * len(phrases) + words  # more than enough: nodes that can't share slots find free ones at the end
    base, check, taken = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool)
    first = np.unique(phrases[:, 0])
    taken[: words + 1] = True  # a first word's state is its number
    check[first] = 0
    state = np.zeros(len(phrases), np.int32)
    length = (phrases > 0).sum(axis=1)
    low = words + 1
    for k in range(2, phrases.shape[1] + 1):
        own = np.flatnonzero(length == k)
        if not len(own):
            break
        if k > 2:  # the phrase without its last word stands somewhere before it
            shorter = np.flatnonzero(length == k - 1)
            parent = state[shorter[np.searchsorted(shorter, own) - 1]].astype(np.int64)
        else:
            parent = phrases[own, 0].astype(np.int64)
        symbol = phrases[own, k - 1].astype(np.int64)
        begin = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        n = np.diff(np.append(begin, len(own)))
        for g in np.flatnonzero(n > 1)[np.argsort(-n[n > 1], kind="stable")].tolist():
            s = symbol[begin[g] : begin[g] + n[g]]
            while taken[low]:
                low += 1
            at = low
            while True:  # the first place where all children fit, some free slots at a time
                free = at + np.flatnonzero(~taken[at : at + 4096])
                fits = np.ones(len(free), bool)
                offsets = s - s[0]
                if len(free) and free[-1] + offsets[-1] >= size:
                    more = int(free[-1] + offsets[-1]) + size
                    base, check, taken = (np.concatenate([x, np.full(more - size, v, x.dtype)]) for x, v in ((base, 0), (check, -1), (taken, False)))
                    size = more
                for o in offsets[1:].tolist():
                    free = free[~taken[free + o]]
                    if not len(free):
                        break
                if len(free):
                    slots = free[0] + offsets
                    break
                at += 4096
            p = int(parent[begin[g]])
            base[p] = free[0] - s[0]
            taken[slots], check[slots], state[own[begin[g] : begin[g] + n[g]]] = True, p, slots
        single = begin[n == 1]
        while taken[low]:
            low += 1
        free = low + np.flatnonzero(~taken[low:])[: len(single)]
        if len(free) < len(single):
            more = size + len(single)
            free = np.concatenate([free, np.arange(size, size + len(single) - len(free))])
            base, check, taken = (np.concatenate([x, np.full(more - size, v, x.dtype)]) for x, v in ((base, 0), (check, -1), (taken, False)))
            size = more
        base[parent[single]] = free - symbol[single]
        taken[free], check[free], state[own[single]] = True, parent[single], free
    end = int(np.flatnonzero(check >= 0).max(initial=0)) + 1
    return base[:end], check[:end], state


def tries(found: DataFrame) -> DataFrame:
    """One row a shard, made by a task each, of the candidates of its pieces."""
    sizes = found.groupBy("piece").agg(F.sum(F.size("phrases") / F.col("k")).cast("long").alias("n")).orderBy("piece").collect()  # a row for each piece
    shards, room = {}, 0
    for r in sizes:
        room += r["n"]
        shards[r["piece"]] = (shards[max(shards)] if shards else 0) + (room > SHARD_PHRASES and bool(shards))
        room = r["n"] if room > SHARD_PHRASES else room
    dealt = found.join(F.broadcast(found.sparkSession.createDataFrame(list(shards.items()), "piece int, shard int")), "piece")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        parts = []
        for k in range(2, LONGEST + 1):
            own = t.filter(pc.equal(t["k"], k))["phrases"].combine_chunks().flatten().to_numpy().reshape(-1, k)
            parts.append(np.concatenate([own, np.zeros((len(own), LONGEST - k), own.dtype)], axis=1))
        rows = np.concatenate(parts).astype(np.int32)
        rows = rows[np.lexsort(rows.T[::-1])]
        base, check, state = trie(rows)
        n = (rows > 0).sum(axis=1)
        phrases = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(rows[rows > 0], pa.int32()))
        one = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), phrases)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "base": pa.array([base.astype("<i4").tobytes()], pa.binary()), "check": pa.array([check.astype("<i4").tobytes()], pa.binary()), "states": pa.array([state], pa.list_(pa.int32())), "phrases": one})

    return dealt.select("shard", "k", "phrases").groupBy("shard").applyInArrow(run, TRIES)


def advance(ids: np.ndarray, base: np.ndarray, check: np.ndarray) -> np.ndarray:
    """How often each state is reached after two or more words: all places walk on together, a word at a time."""
    at = np.flatnonzero((ids > 0) & (ids < len(check)))
    at = at[check[ids[at]] == 0]
    state, counts = ids[at].astype(np.int64), np.zeros(len(check), np.int64)
    for k in range(1, LONGEST):
        go = at + k < len(ids)
        at, state = at[go], state[go]
        word = ids[at + k]
        to = base[state] + word.astype(np.int64)
        go = (word > 0) & (to >= 0) & (to < len(check))
        at, state, to = at[go], state[go], to[go]
        go = check[to] == state
        at, state = at[go], to[go]
        if not len(at):
            break
        counts += np.bincount(state, minlength=len(check))
    return counts


def phrase_counts(ids: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """(phrase, a): exact counts of the candidates that are ``least`` or more."""
    spark = ids.sparkSession
    known = cut(tries(found))
    sizes = known.select("shard", (F.length("base") + F.length("check")).alias("bytes")).orderBy("shard").collect()  # a row for each shard
    rounds: list[list[int]] = []
    room = 0
    for r in sizes:
        if not rounds or room + r["bytes"] > BROADCAST_BYTES:
            rounds.append([])
            room = 0
        rounds[-1].append(r["shard"])
        room += r["bytes"]

    def finish(shard: int, chunk: int, total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total >= least)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array((at + chunk * CHUNK).astype(np.int32)), pa.array(total[at])], names=["shard", "state", "a"])

    counts = spark.createDataFrame([], "shard int, state int, a long")
    for own in rounds:
        arrays = {r["shard"]: (bytes(r["base"]), bytes(r["check"])) for r in known.where(F.col("shard").isin(own)).select("shard", "base", "check").collect()}  # at most BROADCAST_BYTES
        sent = spark.sparkContext.broadcast(arrays)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = {s: [np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4"), None] for s, (b, c) in sent.value.items()}
            for x in _positions(batches, BLOCK_WORDS):
                for t in held.values():
                    n = advance(x, t[0], t[1])
                    t[2] = n if t[2] is None else t[2] + n
            for s, t in held.items():
                if t[2] is not None:
                    yield from _chunks(t[2].astype("<i8"), s)

        counts = counts.unionByName(cut(_added(ids.mapInArrow(count, "shard int, chunk int, counts binary"), finish, "shard int, state int, a long")))
        sent.destroy()
    named = known.select("shard", F.explode(F.arrays_zip("states", "phrases")).alias("x")).select("shard", F.col("x.states").alias("state"), F.col("x.phrases").alias("phrase"))
    return counts.join(named, ["shard", "state"]).select("phrase", "a")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates (lang, words, a) that no longer one of equal count contains."""
    part = lambda begin, n: F.array_join(F.slice("words", begin, n), " ")
    counts = cut(phrases.select("lang", F.array_join("words", " ").alias("phrase"), "a").unionByName(words.select("lang", F.col("word").alias("phrase"), F.col("f").alias("a"))))
    cuts = phrases.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select("lang", part(F.lit(1), F.size("words")).alias("phrase"), "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    both = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]).join(F.broadcast(totals), "lang")
    exact = both.withColumn("score", F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0)) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))").cast("long"))
    least_cut = exact.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda b: F.array_join(F.slice("words", b, n), " "))))
    contained = phrases.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = least_cut.join(contained, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * SHARE))
    return left.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` of each language."""
    spark = docs.sparkSession
    where = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}"
    blocks(docs).write.option("compression", "zstd").parquet(f"{where}/blocks")
    store = spark.read.schema(BLOCKS).parquet(f"{where}/blocks")
    counted = store.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    totals = cut(store.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    words = cut(numbered(counted.where(F.col("f") >= least), [F.desc("f"), F.asc("word"), F.asc("lang")], "id").withColumn("id", F.col("id").cast("int")))
    encoded(store, words).write.option("compression", "zstd").parquet(f"{where}/ids")
    ids = spark.read.schema("ids binary").parquet(f"{where}/ids")
    n = totals.agg(F.sum("n")).first()[0] or 0
    buckets = min(max(1 << (n // WORDS_A_BUCKET).bit_length(), MIN_BUCKETS), MAX_BUCKETS)
    full: dict[int, np.ndarray] = {}
    for k in HASHED:
        full[k] = full_buckets(ids, k, full, buckets, least)
    counts = phrase_counts(ids, cut(candidates(told(ids, full, buckets, least, n), least)), least)
    each = counts.select("phrase", "a", F.posexplode("phrase").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = each.groupBy("phrase").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))
    rows = scored(cut(spelled.select("lang", "words", "a")), words, totals)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS r(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::bigint AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS j FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.a, c.k, c.j, x.a AS l, y.a AS r, n.n, ((1000::hugeint * c.a * n.n) // (x.a::hugeint * y.a))::bigint AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[:c.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.j + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT DISTINCT lang, a, array_to_string(ws[st:st + m - 1], ' ') AS inner_phrase FROM (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS st FROM (SELECT lang, a, ws, k, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
d AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.inner_phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d) WHERE rank <= 2000"""
