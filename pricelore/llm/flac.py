"""Operator 9: media columns in FLAC.

``encode`` stores bytes as 8-bit mono samples (byte - 128) in FLAC streams with frames of 192 samples: constant, verbatim or fixed linear predictors of order 0 to 2 with Rice-coded residuals,
CRC-8 on each header, CRC-16 on each frame, the MD5 of the samples and a seek table. ``decode`` verifies all of that and writes back the PCM bytes with the sample and byte
offsets of every ``SEEK``-th frame. Streams of other encoders (quantised linear predictors, Rice partitions, escapes, wasted bits, stereo, up to 24 bits) go through a frame-by-frame decoder.

The work of a batch is vectorised over all its frames. Edge cases: a null text counts as empty, and an empty one gives a payload of 192 spaces; equal texts give equal streams; a stream that fails
a checksum raises ``ValueError`` (``decode_stream``), or gives null PCM and the reason (``decode`` with ``strict=False``); a null medium gives null PCM; null and repeated doc_ids are rows
like any other; a very long text is a slice of its own; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm._common import table

N = 192
SEEK = 64
SLICE_BYTES = 1_000_000
RATE = 8000


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(rows: np.ndarray, wide: bool) -> np.ndarray:
    """The CRC of each row; zeros in front don't change it."""
    out = np.zeros(len(rows), dtype=np.int64)
    for column in np.ascontiguousarray(rows.T):
        out = CRC16[out >> 8 ^ column] ^ (out << 8 & 0xFFFF) if wide else CRC8[out ^ column]
    return out


def _gather(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rows data[end - size : end], aligned to the right, with zeros in front."""
    width = int(sizes.max())
    back = np.arange(width, 0, -1)
    at = ends[:, None] - back
    return np.where(back <= sizes[:, None], data[np.maximum(at, 0)], 0)


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the variable-length code of the header: bytes (padded to 7), sizes."""
    size = 1 + sum((n >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000, 0x200000, 0x4000000, 0x80000000))
    out = np.zeros((len(n), 7), dtype=np.uint8)
    for k in range(1, 8):
        rows = size == k
        if not rows.any():
            continue
        lead = 0xFF << 8 - k & 0xFF
        for j in range(k):
            part = n[rows] >> 6 * (k - 1 - j)
            out[rows, j] = (n[rows] if k == 1 else lead | part) if j == 0 else 0x80 | part & 0x3F
    return out, size


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose sizes are positive multiples of 192."""
    raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    x = (raw.astype(np.int16) - 128).reshape(-1, N)
    frames = np.array([len(p) // N for p in payloads])
    first = np.cumsum(frames) - frames
    number = np.arange(len(x)) - np.repeat(first, frames)

    residuals = [x, np.diff(x), np.diff(x, n=2)]
    order = np.argmin([np.abs(r[:, 2 - k :], dtype=np.int32).sum(axis=1) for k, r in enumerate(residuals)], axis=0)
    codes = np.zeros((len(x), N), dtype=np.int32)  # zigzag, on the right; the warm-up samples' places are not coded
    for k, r in enumerate(residuals):
        rows = order == k
        codes[rows, k:] = np.where(r[rows] < 0, -2 * r[rows].astype(np.int32) - 1, 2 * r[rows].astype(np.int32))
    coded = N - order
    k0 = np.maximum(np.frexp(codes.sum(axis=1) * 0.69 / coded)[1] - 1, 0)
    size_at = lambda k: (codes >> k[:, None]).sum(axis=1) + coded * (k + 1)
    s0, s1 = size_at(k0), size_at(k0 + 1)
    rice, bits = np.where(s1 < s0, k0 + 1, k0), np.minimum(s0, s1)
    flat = (x == x[:, :1]).all(axis=1)
    body = order + (10 + bits + 7) // 8
    plain = ~flat & ((body >= N) | (rice > 14))
    fixed = ~flat & ~plain
    body = np.where(flat, 1, np.where(plain, N, body))

    number_bytes, number_size = _number(number)
    head = 4 + number_size + 1
    size = head + 1 + body + 2
    end = np.cumsum(size)
    start = end - size
    out = np.zeros(int(end[-1]), dtype=np.uint8)
    sub = start + head  # the subframe's header
    rows = np.flatnonzero(fixed)
    if len(rows):
        bit = np.zeros(len(out) * 8, dtype=np.uint8)
        at = (sub[rows] + 1 + order[rows]) * 8
        for j in range(4):
            bit[at + 6 + j] = rice[rows] >> (3 - j) & 1
        k, skip = rice[rows][:, None], np.arange(N) < order[rows][:, None]
        q = codes[rows] >> k
        length = np.where(skip, 0, q + 1 + k)
        one = (np.cumsum(length, axis=1) - length + q + (at + 10)[:, None]).astype(np.int64)  # where the code's 1 goes
        bit[one[~skip]] = 1
        for j in range(int(k.max())):
            take = ~skip & (j < k)
            bit[one[take] + 1 + j] = (codes[rows] >> np.maximum(k - 1 - j, 0) & 1)[take]
        out = np.packbits(bit)
    out[start], out[start + 1], out[start + 2], out[start + 3] = 0xFF, 0xF8, 0x14, 0x02
    for j in range(7):
        rows = number_size > j
        out[start[rows] + 4 + j] = number_bytes[rows, j]
    out[sub - 1] = crc(_gather(out, sub - 1, head - 1), False)
    out[sub] = np.where(flat, 0, np.where(plain, 2, (8 | order) << 1))
    out[sub[flat] + 1] = x[flat, 0]
    out[(sub[plain] + 1)[:, None] + np.arange(N)] = x[plain]
    for j in range(2):
        rows = fixed & (order > j)
        out[sub[rows] + 1 + j] = x[rows, j]
    check = crc(_gather(out, end - 2, size - 2), True)
    out[end - 2], out[end - 1] = check >> 8, check & 0xFF

    streams, blob = [], out.tobytes()
    for p, f, n in zip(payloads, first, frames, strict=True):
        own = slice(f, f + n)
        points = b"".join(struct.pack(">QQH", k * N, start[f + k] - start[f], N) for k in range(0, n, SEEK))
        info = struct.pack(">HH", N, N) + int(size[own].min()).to_bytes(3, "big") + int(size[own].max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big")
        digest = hashlib.md5(x[own].astype(np.int8).tobytes(), usedforsecurity=False).digest()
        streams.append(b"fLaC\x00\x00\x00\x22" + info + digest + b"\x83" + len(points).to_bytes(3, "big") + points + blob[start[f] : end[f + n - 1]])
    return streams


def stream_info(data: bytes) -> dict:
    """What the metadata blocks say; ``body`` is where the frames begin."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info = 4, {"seek": []}
    while True:
        if at + 4 > len(data):
            raise ValueError("the metadata is cut off")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            low, high = struct.unpack(">HH", block[:4])
            rest = int.from_bytes(block[10:18], "big")
            info |= {"least": low, "most": high, "rate": rest >> 44, "channels": (rest >> 41 & 7) + 1, "bits": (rest >> 36 & 31) + 1, "samples": rest & (1 << 36) - 1, "md5": block[18:34]}
        elif kind & 127 == 3:
            info["seek"] = [struct.unpack(">QQH", block[k : k + 18]) for k in range(0, size, 18)]
        at += 4 + size
        if kind & 128:
            return info | {"body": at}


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        end = self.at + n
        if end > len(self.data) * 8:
            raise ValueError("the stream is cut off")
        value = int.from_bytes(self.data[self.at // 8 : (end + 7) // 8], "big") >> -end % 8 & (1 << n) - 1
        self.at = end
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> n - 1 else value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


def _subframe(b: _Bits, n: int, bits: int) -> list[int]:
    kind = b.take(8) >> 1
    wasted = 0
    if b.data[b.at // 8 - 1] & 1:
        wasted = b.unary() + 1
    bits -= wasted
    if kind == 0:
        out = [b.signed(bits)] * n
    elif kind == 1:
        out = [b.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [b.signed(bits) for _ in range(order)]
        shift, weights = 0, FIXED[order] if kind < 32 else []
        if kind >= 32:
            precision, shift = b.take(4) + 1, b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        wide, parts = b.take(2), b.take(4)
        for p in range(1 << parts):
            k = b.take(4 + wide)
            escape = b.take(5) if k == (1 << 4 + wide) - 1 else None
            for _ in range((n >> parts) - order * (p == 0)):
                if escape is None:
                    u = b.unary() << k
                    u |= b.take(k)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = b.signed(escape)
                out.append(r + (sum(w * s for w, s in zip(weights, reversed(out[-order:] if order else []), strict=False)) >> shift))
    else:
        raise ValueError("a reserved kind of subframe")
    return [s << wasted for s in out]


def decode_stream(data: bytes) -> tuple[list[list[int]], dict, list[int]]:
    """Samples by channel, the stream's information and the byte offset of each frame, for any stream; checks every checksum."""
    info = stream_info(data)
    samples: list[list[int]] = [[] for _ in range(info["channels"])]
    offsets, at = [], info["body"]
    while at < len(data):
        offsets.append(at - info["body"])
        b = _Bits(data, at)
        if b.take(15) != 0x7FFC:
            raise ValueError("no frame where one is due")
        b.take(1)
        n, rate, how, depth = b.take(4), b.take(4), b.take(4), b.take(4) >> 1
        lead = b.take(8)
        for _ in range(max(0, 8 - (lead ^ 0xFF).bit_length() - 1)):
            b.take(8)
        n = 192 if n == 1 else 576 << n - 2 if 2 <= n <= 5 else b.take(8) + 1 if n == 6 else b.take(16) + 1 if n == 7 else 256 << n - 8
        b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        head = b.at // 8
        if crc(np.frombuffer(data[at:head], np.uint8)[None], False)[0] != b.take(8):
            raise ValueError("a frame's header fails its CRC-8")
        bits = info["bits"] if depth == 0 else (0, 8, 12, 0, 16, 20, 24, 32)[depth]
        got = [_subframe(b, n, bits + (how == 8 and c == 1 or how == 9 and c == 0 or how == 10 and c == 1)) for c in range(how + 1 if how < 8 else 2)]
        if how == 8:
            got[1] = [x - y for x, y in zip(*got, strict=True)]
        elif how == 9:
            got[0] = [x + y for x, y in zip(*got, strict=True)]
        elif how == 10:
            mid = [(m << 1) | (s & 1) for m, s in zip(*got, strict=True)]
            got = [[m + s >> 1 for m, s in zip(mid, got[1], strict=True)], [m - s >> 1 for m, s in zip(mid, got[1], strict=True)]]
        end = (b.at + 7) // 8
        if crc(np.frombuffer(data[at:end], np.uint8)[None], True)[0] != int.from_bytes(data[end : end + 2], "big"):
            raise ValueError("a frame fails its CRC-16")
        at = end + 2
        for own, new in zip(samples, got, strict=True):
            own += new
    if info["samples"] and info["samples"] != len(samples[0]):
        raise ValueError("the count of samples is wrong")
    if any(info["md5"]):
        width = (info["bits"] + 7) // 8
        whole = b"".join(s.to_bytes(width, "little", signed=True) for frame in zip(*samples, strict=True) for s in frame)
        if hashlib.md5(whole, usedforsecurity=False).digest() != info["md5"]:
            raise ValueError("the samples fail their MD5")
    return samples, info, offsets


def _starts(data: np.ndarray, n: int) -> np.ndarray | None:
    """Where the frames of an own stream's body begin, by their headers; None if these aren't all there in order."""
    at = np.flatnonzero((data[:-6] == 0xFF) & (data[1:-5] == 0xF8) & (data[2:-4] == 0x14) & (data[3:-3] == 0x02)) if len(data) > 6 else np.zeros(0, np.int64)
    bytes_, size = _number(np.arange(n))
    if len(at) != n:
        return None
    for j in range(4):
        rows = size > j
        if (data[at[rows] + 4 + j] != bytes_[rows, j]).any():
            return None
    return at if n and at[0] == 0 else None


def decode_batch(streams: list[bytes]) -> list[tuple[bytes, list[int], dict] | None]:
    """For each stream of 8-bit mono: the PCM bytes, the byte offset of each frame, and how many frames have which kind. None where the frame-by-frame decoder must look."""
    found, at = [], 0
    for data in streams:
        info = stream_info(data)
        n = -(-info["samples"] // N)
        own = np.frombuffer(data, np.uint8)[info["body"] :]
        starts = _starts(own, n) if info["channels"] == 1 and info["bits"] == 8 and info["least"] == info["most"] == N and info["samples"] % N == 0 else None
        found.append((info, own, starts, at))
        at += len(own) if starts is not None else 0
    good = [x for x in found if x[2] is not None]
    if not good:
        return [None] * len(streams)
    data = np.concatenate([x[1] for x in good] + [np.zeros(8, np.uint8)])
    start = np.concatenate([x[2] + x[3] for x in good])
    end = np.concatenate([np.append(x[2][1:], len(x[1])) + x[3] for x in good])
    counts = np.array([len(x[2]) for x in good])
    first = np.cumsum(counts) - counts
    _, number_size = _number(np.arange(len(start)) - np.repeat(first, counts))
    sub = start + 5 + number_size
    whole = (crc(_gather(data, sub - 1, sub - 1 - start), False) == data[sub - 1]) & (crc(_gather(data, end - 2, end - 2 - start), True) == data[end - 2].astype(np.int64) << 8 | data[end - 1])
    kind = data[sub] >> 1
    whole &= (data[sub] & 1 == 0) & np.isin(kind, (0, 1, 8, 9, 10))
    x = np.zeros((len(start), N), dtype=np.int64)
    signed = data.view(np.int8)
    rows = np.flatnonzero(whole & (kind == 0))
    x[rows] = signed[sub[rows] + 1][:, None]
    rows = np.flatnonzero(whole & (kind == 1))
    x[rows] = signed[(sub[rows] + 1)[:, None] + np.arange(N)]
    bits = np.unpackbits(data)
    ahead = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(2**31 - 1))
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]  # the next 1 from each bit on
    wide = data.astype(np.int32)
    wide[:-2] = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    for order in (0, 1, 2):
        rows = np.flatnonzero(whole & (kind == 8 + order))
        if not len(rows):
            continue
        at = (sub[rows] + 1 + order) * 8
        window = lambda p, k: wide[p >> 3] >> (24 - (p & 7) - k) & ((1 << k) - 1)
        whole[rows] &= window(at, 6) == 0  # one partition with 4-bit parameters
        k = window(at + 6, 4)
        p, limit = at + 10, end[rows] * 8 - 16
        r = np.zeros((N - order, len(rows)), dtype=np.int64)
        for j in range(N - order):
            one = ahead[np.minimum(p, len(ahead) - 1)]
            u = (one - p) << k | window(np.minimum(one + 1, limit), k)
            r[j] = u >> 1 ^ -(u & 1)
            p = np.minimum(one + 1 + k, limit)
        whole[rows] &= (p + 7) // 8 * 8 == limit
        r = r.T
        warm = signed[(sub[rows] + 1)[:, None] + np.arange(order)].astype(np.int64)
        if order == 0:
            x[rows] = r
        elif order == 1:
            x[rows] = np.cumsum(np.concatenate([warm, r], axis=1), axis=1)
        else:
            slope = np.cumsum(np.concatenate([warm[:, 1:] - warm[:, :1], r], axis=1), axis=1)
            x[rows] = np.cumsum(np.concatenate([warm[:, :1], slope], axis=1), axis=1)
    pcm = x.astype(np.int8)
    out, k = [], 0
    for info, _, starts, _ in found:
        if starts is None:
            out.append(None)
            continue
        own = slice(first[k], first[k] + counts[k])
        samples = pcm[own].tobytes()
        if whole[own].all() and hashlib.md5(samples, usedforsecurity=False).digest() == info["md5"]:
            kinds = np.bincount(kind[own], minlength=11)
            out.append(((pcm[own].view(np.uint8) + np.uint8(128)).tobytes(), starts.tolist(), {"constant": int(kinds[0]), "verbatim": int(kinds[1]), "fixed0": int(kinds[8]), "fixed1": int(kinds[9]), "fixed2": int(kinds[10])}))
        else:
            out.append(None)
        k += 1
    return out


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= SLICE_BYTES:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def encode(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in _runs([len(r) for r in raw]):
                media = encode_batch([r + b" " * ((-len(r)) % N if r else N) for r in raw[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(r) for r in raw[a:b]], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame, strict: bool = True) -> DataFrame:
    """Adds to (doc_id, n_bytes, media): pcm, blocks (sample_offset and byte_offset of every SEEK-th frame), feature, fault."""

    def one(data: bytes) -> tuple[bytes, list[int], dict]:
        samples, info, offsets = decode_stream(data)
        if info["bits"] == 8 and info["channels"] == 1:
            return bytes(s + 128 for s in samples[0]), offsets, {"frames": len(offsets)}
        width = (info["bits"] + 7) // 8
        return b"".join(s.to_bytes(width, "little", signed=True) for f in zip(*samples, strict=True) for s in f), offsets, {"frames": len(offsets)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64())]))
        for batch in batches:
            data = batch.column(2).to_pylist()
            for a, b in _runs([len(x or b"") for x in data]):
                there = [k for k in range(a, b) if data[k] is not None]
                try:
                    fast = dict(zip(there, decode_batch([data[k] for k in there]), strict=True)) if there else {}
                except (ValueError, KeyError, struct.error):
                    fast = {}
                pcm, blocks, feature, fault = [], [], [], []
                for k in range(a, b):
                    got, wrong = fast.get(k), None
                    if got is None and data[k] is not None:
                        try:
                            got = one(data[k])
                        except (ValueError, KeyError, struct.error, IndexError) as e:
                            if strict:
                                raise
                            wrong = str(e)
                    pcm.append(got and got[0])
                    blocks.append(got and [{"sample_offset": j * N, "byte_offset": got[1][j]} for j in range(0, len(got[1]), SEEK)])
                    feature.append(got and ";".join(f"{n}={v}" for n, v in got[2].items()))
                    fault.append(wrong)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in range(3)), pa.array(pcm, pa.binary()), pa.array(blocks, kind), pa.array(feature, pa.string()), pa.array(fault, pa.string())], names=["doc_id", "n_bytes", "media", "pcm", "blocks", "feature", "fault"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, pcm binary, blocks array<struct<sample_offset: bigint, byte_offset: bigint>>, feature string, fault string")


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, byte_offset, pcm): a row for each ``SEEK`` frames of what ``decode`` gives, so that a place is read without the rest."""
    each = decoded.where("pcm IS NOT NULL").select("doc_id", "pcm", F.posexplode("blocks").alias("block", "b"))
    return each.select("doc_id", "block", "b.sample_offset", "b.byte_offset", F.substring("pcm", F.col("b.sample_offset").cast("int") + 1, F.lit(SEEK * N)).alias("pcm"))


def write_blocks(decoded: DataFrame, path: str) -> None:
    """The blocks as Parquet in ranges of doc_id and offset."""
    pcm_blocks(decoded).repartitionByRange("doc_id", "sample_offset").sortWithinPartitions("doc_id", "sample_offset").write.parquet(path)


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = decode(encode(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pcm, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat("feature", F.lit(";blocks="), F.size("blocks")).alias("feature"),
    )
