"""Operator 11: fill-in-the-middle transformation over seekable compressed frames.

``write_frames`` stores each whole text as independent zstandard frames of about ``FRAME`` bytes of UTF-8, with the units and code points up to the end of each. A unit is a run of ASCII letters or any other single code point; a frame that goes on with the last one's run of letters
says so. ``units`` of any place are then found by a search in the cumulative counts: only the two frames that hold the cuts are decompressed to select, and the output is a stream of frames in the order of its form, from which digests are taken without the text ever being whole.
``outputs`` gives the transformed texts, ``digests`` their digests, and ``restored`` puts a text together again from an output stream alone: what has to wait (the suffix) is kept as compressed frames.

Edge cases: null texts count as empty, and empty texts stay as they are (plain); a null doc_id hashes as an empty number; repeated rows give equal results; a text that holds a mark is plain; a letter run or a text of any length is cut into frames like any other (a frame may begin inside a
run or a line, never inside a code point); an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm._common import shared_dir, table

FRAME, SLICE = 1 << 16, 1 << 23
LEVEL = 3
#: Shares in percent of texts that are transformed, and of those whose form is suffix-prefix-middle.
FIM_RATE, SPM_RATE = 90, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
STORE = "doc_id long, marked boolean, frames array<binary>, joined array<boolean>, units array<long>, chars array<long>"
_STORE = pa.schema([("doc_id", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(pa.binary())), ("joined", pa.list_(pa.bool_())), ("units", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64()))])


def _kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 are ASCII letters, and which begin a code point."""
    return ((raw | 32) - np.uint8(97)) < 26, (raw & 0xC0) != 0x80


def _framed(raw: np.ndarray, ends: np.ndarray, marked: list[bool], ids: pa.Array, compress, frame: int) -> pa.RecordBatch:
    """The store's rows of texts that lie side by side in ``raw``."""
    begins = np.concatenate([[0], ends[:-1]])
    letter, head = _kinds(raw)
    goes_on = np.zeros(len(raw), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[begins[begins < ends]] = False
    pieces = -(-(ends - begins) // frame)
    of = np.repeat(np.arange(len(ends)), pieces)
    cuts = begins[of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * frame
    for _ in range(3):  # a code point has three further bytes at most
        cuts += ~head[cuts]
    to = np.append(cuts[1:], len(raw)) if len(cuts) else cuts
    starts = head & ~goes_on
    sums = [np.add.reduceat(x, cuts, dtype=np.int64) if len(cuts) else np.zeros(0, np.int64) for x in (starts, head)]
    first = np.cumsum(pieces) - pieces
    totals = [np.cumsum(x) for x in sums]
    totals = [t - np.concatenate([[0], t])[first][of] for t in totals]
    view = memoryview(raw)
    frames = [compress(view[a:b]) for a, b in zip(cuts.tolist(), to.tolist(), strict=True)]
    offsets = pa.array(np.concatenate([[0], np.cumsum(pieces)]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(frames, pa.binary()), pa.array(goes_on[cuts]), *(pa.array(t, pa.int64()) for t in totals))]
    return pa.RecordBatch.from_arrays([ids, pa.array(marked, pa.bool_()), *lists], schema=_STORE)


def write_frames(docs: DataFrame, path: str, frame: int = FRAME) -> None:
    """Stores (doc_id, text) at ``path`` in frames of ``frame`` bytes, four or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            a = 0
            while a < len(sizes):
                before = int(sizes[a - 1]) if a else 0
                b = max(int(np.searchsorted(sizes, before + SLICE, side="right")), a + 1)
                texts = pa.concat_arrays([pc.fill_null(batch.column(1).slice(a, b - a), "")])
                marked = [bool(x) for x in pc.match_substring_regex(texts, "<[PSM]>").to_pylist()]
                offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + b - a + 1].astype(np.int64)
                raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                yield _framed(raw, offsets[1:] - offsets[0], marked, batch.column(0).slice(a, b - a), compress, frame)
                a = b

    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STORE).write.option("compression", "none").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path)


class Framed:
    """A stored text. Its frames are decompressed one at a time; the last one is kept."""

    def __init__(self, frames: list, joined: list[bool], units: list[int], chars: list[int], decompress):
        self.frames, self.joined, self.units, self.chars, self.decompress = frames, joined, units, chars, decompress
        self.n = units[-1] if units else 0
        self._last: tuple[int, bytes] = -1, b""

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self._last = k, self.decompress(self.frames[k])
        return self._last[1]

    def place(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before) of the place where unit number ``unit`` begins; of the end for the count of units."""
        if unit == self.n:
            return len(self.frames), 0, self.chars[-1] if self.chars else 0
        k = int(np.searchsorted(self.units, unit, side="right"))
        raw = np.frombuffer(self.frame(k), np.uint8)
        letter, head = _kinds(raw)
        start = head.copy()
        start[1:] &= ~(letter[1:] & letter[:-1])
        start[0] &= not self.joined[k]
        at = int(np.flatnonzero(start)[unit - (self.units[k - 1] if k else 0)])
        return k, at, (self.chars[k - 1] if k else 0) + int(np.count_nonzero(head[:at]))

    def stream(self, begin: tuple[int, int, int], end: tuple[int, int, int]) -> Iterator[bytes]:
        """The bytes from one place to another, a frame at a time."""
        for k in range(begin[0], min(end[0] + 1, len(self.frames))):
            low, high = begin[1] if k == begin[0] else 0, end[1] if k == end[0] else None
            if high is None or high > low:
                yield self.frame(k)[low:high]


def plan(text: Framed, marked: bool, doc_id: int | None) -> tuple[str, tuple, tuple]:
    """The form and the two places of the cuts, from the hash of the id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))
    if not text.n or marked or h3 % 100 >= FIM_RATE:
        return "plain", (0, 0, 0), (0, 0, 0)
    low, high = sorted((h1 % (text.n + 1), h2 % (text.n + 1)))
    return "spm" if h4 % 100 < SPM_RATE else "psm", text.place(low), text.place(high)


def output(text: Framed, form: str, low: tuple, high: tuple) -> Iterator[bytes]:
    """The transformed text as a stream."""
    start, end = (0, 0, 0), (len(text.frames), 0, 0)
    parts = {PREFIX: (start, low), MIDDLE: (low, high), SUFFIX: (high, end)}
    if form == "plain":
        yield from text.stream(start, end)
    for mark in {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}[form]:
        yield mark
        yield from text.stream(*parts[mark])


def restored(stream: Iterable[bytes], form: str) -> Iterator[bytes]:
    """The original text from an output stream and its form. Only the suffix, which comes before the middle, is kept, as compressed frames."""
    import zstandard

    if form == "plain":
        yield from stream
        return
    marks = iter((PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE))
    held, rest, part, mark = [], b"", None, next(marks)
    pack = zstandard.ZstdCompressor(level=1).compress

    def put(piece: bytes) -> Iterator[bytes]:
        if part == SUFFIX:
            held.append(pack(piece))
        elif piece:
            yield piece

    for piece in stream:
        rest += piece
        while mark and (at := rest.find(mark)) >= 0:
            yield from put(rest[:at])
            rest, part, mark = rest[at + len(mark) :], mark, next(marks, None)
        keep = 2 if mark else 0  # a mark may be cut by the pieces' edge
        if len(rest) > keep:
            yield from put(rest[: len(rest) - keep])
            rest = rest[len(rest) - keep :]
    yield from put(rest)
    unpack = zstandard.ZstdDecompressor().decompress
    for piece in held:
        yield unpack(piece)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bool, Framed]]:
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    for k in range(batch.num_rows):  # one row at a time: others stay in Arrow's memory
        doc_id, marked, *lists = (batch.column(c)[k].as_py() for c in range(6))
        yield doc_id, marked, Framed(*lists, decompress)


def outputs(frames: DataFrame) -> DataFrame:
    """(doc_id, form, output): the transformed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, marked, text in _texts(batch):
                form, low, high = plan(text, marked, doc_id)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([form]), pa.array([b"".join(output(text, form, low, high)).decode()])], names=["doc_id", "form", "output"])

    return frames.mapInArrow(run, "doc_id long, form string, output string")


def digests(frames: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), from streams of frames."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, marked, text in _texts(batch):
                form, low, high = plan(text, marked, doc_id)
                out, back = hashlib.sha256(), hashlib.sha256()

                def seen(stream: Iterator[bytes], out=out) -> Iterator[bytes]:
                    for piece in stream:
                        out.update(piece)
                        yield piece

                for piece in restored(seen(output(text, form, low, high)), form):
                    back.update(piece)
                cuts = (None, None) if form == "plain" else (low[2], high[2] - low[2])
                rows.append((doc_id, text.n, form, *cuts, out.hexdigest(), back.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)

    return frames.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op11_framed_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    write_frames(table(spark, sf_dir, "documents"), path)
    return digests(read_frames(spark, path))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
e AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::ubigint AS h1, ('0x' || h[9:16])::ubigint AS h2, ('0x' || h[17:24])::ubigint AS h3, ('0x' || h[25:32])::ubigint AS h4 FROM d),
f AS (SELECT doc_id, text, u, n, least(h1 % (n + 1)::ubigint, h2 % (n + 1)::ubigint)::bigint AS c1, greatest(h1 % (n + 1)::ubigint, h2 % (n + 1)::ubigint)::bigint AS c2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[:c1], ''), '') AS p, coalesce(array_to_string(u[c1 + 1:c2], ''), '') AS m, coalesce(array_to_string(u[c2 + 1:], ''), '') AS s FROM f)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::bigint AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::bigint AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM g"""
