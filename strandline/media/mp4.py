"""MP4 sample tables: probe, packet digests, concatenation, splitting and JPEG muxing.

Only packets move; nothing is decoded.  Files with one video track are read by
their sample tables (stts, ctts, stss, stsc, stsz, stco or co64).
"""

from __future__ import annotations

import hashlib
import io
import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain
from typing import BinaryIO

EPSILON = 1e-7
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


@dataclass(slots=True)
class Sample:
    offset: int
    size: int
    dts: int
    cts: int  # presentation offset
    duration: int
    key: bool


@dataclass
class Track:
    timescale: int
    codec: str
    width: int
    height: int
    description: bytes  # the stsd box
    samples: list[Sample] = field(default_factory=list)
    audio: bool = False

    @cached_property
    def shown(self) -> tuple[list[float], list[int] | None]:
        """Seconds from the first picture at which samples are shown, in that order, and the samples' numbers where that is not their own order."""
        times = [s.dts + s.cts for s in self.samples]
        order = None
        if any(a > b for a, b in zip(times, times[1:], strict=False)):
            order = sorted(range(len(times)), key=times.__getitem__)
            times = [times[i] for i in order]
        return [(t - times[0]) / self.timescale for t in times], order

    @property
    def duration(self) -> float:
        return sum(s.duration for s in self.samples) / self.timescale if self.samples else 0.0

    @property
    def fps(self) -> float:
        return len(self.samples) / self.duration if self.samples and self.duration else 0.0


def boxes(file: BinaryIO, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin, end) of the payload of each box."""
    at = start
    while at + 8 <= end:
        file.seek(at)
        size, kind = struct.unpack(">I4s", file.read(8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", file.read(8))[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError("a damaged box")
        yield kind, at + head, at + size
        at += size


def _tree(file: BinaryIO, start: int, end: int) -> dict[bytes, list]:
    out: dict[bytes, list] = {}
    for kind, a, b in boxes(file, start, end):
        if kind in _PARENTS:
            out.setdefault(kind, []).append(_tree(file, a, b))
        elif kind != b"mdat":
            file.seek(a)
            out.setdefault(kind, []).append(file.read(b - a))
    return out


def _numbers(raw: bytes, fmt: str) -> list[tuple[int, ...]]:
    (n,) = struct.unpack_from(">I", raw, 4)
    return list(struct.iter_unpack(">" + fmt, raw[8 : 8 + n * struct.calcsize(">" + fmt)]))


def read_track(file: BinaryIO) -> Track:
    """The video track of a file."""
    file.seek(0, io.SEEK_END)
    top = _tree(file, 0, file.tell())
    if b"moov" not in top:
        raise ValueError("no movie box")
    tracks = top[b"moov"][0].get(b"trak", [])
    kinds = [t[b"mdia"][0][b"hdlr"][0][8:12] for t in tracks]
    if b"vide" not in kinds:
        raise ValueError("no video track")
    media = tracks[kinds.index(b"vide")][b"mdia"][0]
    header = media[b"mdhd"][0]
    timescale = struct.unpack_from(">I", header, 20 if header[0] == 1 else 12)[0]
    table = media[b"minf"][0][b"stbl"][0]
    stsd = table[b"stsd"][0]
    codec = stsd[12:16].decode("latin1")
    width, height = struct.unpack_from(">HH", stsd, 8 + 8 + 24)
    (fixed, n) = struct.unpack_from(">II", table[b"stsz"][0], 4)
    sizes = [fixed] * n if fixed else [x for (x,) in struct.iter_unpack(">I", table[b"stsz"][0][12 : 12 + 4 * n])]
    chunks = [x for (x,) in (_numbers(table[b"co64"][0], "Q") if b"co64" in table else _numbers(table[b"stco"][0], "I"))]
    runs = _numbers(table[b"stsc"][0], "III")
    durations = [d for count, d in _numbers(table[b"stts"][0], "II") for _ in range(count)]
    shifts = [s for count, s in _numbers(table[b"ctts"][0], "Ii") for _ in range(count)] if b"ctts" in table else [0] * n
    keys = {k - 1 for (k,) in _numbers(table[b"stss"][0], "I")} if b"stss" in table else None
    samples, i, dts = [], 0, 0
    for r, (first, per_chunk, _) in enumerate(runs):
        last = runs[r + 1][0] - 1 if r + 1 < len(runs) else len(chunks)
        for chunk in range(first - 1, last):
            at = chunks[chunk]
            for _ in range(per_chunk):
                if i == n:
                    break
                samples.append(Sample(at, sizes[i], dts, shifts[i], durations[i], keys is None or i in keys))
                at += sizes[i]
                dts += durations[i]
                i += 1
    return Track(timescale, codec, width, height, stsd, samples, b"soun" in kinds)


def _box(kind: bytes, *payload: bytes) -> bytes:
    body = b"".join(payload)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *payload: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *payload)


def _runs(values: Iterable[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [(a, b) for a, b in out]


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_mp4(out: BinaryIO, like: Track, samples: list[Sample], payload: Iterable[bytes]) -> Track:
    """A file with one video track of the samples, in decode order; times start at 0.

    The samples' sizes are known, so the file is written from its begin to its
    end and ``out`` need not seek; their offsets are ignored.
    """
    return _stream(out, like, zip(payload, samples, strict=True), sum(s.size for s in samples))


def _stream(out: BinaryIO, like: Track, pairs: Iterable[tuple[bytes, Sample]], size: int) -> Track:
    """``write_mp4`` from packets with their samples as they come; only ``size``, the bytes of all of them, is known before."""
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    out.write(head)
    out.write(struct.pack(">I4sQ", 1, b"mdat", 16 + size))
    begin = at = len(head) + 16
    dts, samples = 0, []
    for data, s in pairs:
        if len(data) != s.size:
            raise ValueError(f"a packet has {len(data)} bytes, its table says {s.size}")
        samples.append(Sample(at, s.size, dts, s.cts, s.duration, s.key))
        out.write(data)
        at += s.size
        dts += s.duration
    if at - begin != size:
        raise ValueError(f"the packets have {at - begin} bytes, {size} are expected")
    n = len(samples)
    pack = lambda fmt, rows: struct.pack(">I", len(rows)) + b"".join(struct.pack(">" + fmt, *r) for r in rows)
    parts = [_box(b"stsd", like.description), _full(b"stts", pack("II", _runs(s.duration for s in samples)))]
    if any(s.cts for s in samples):
        parts.append(_full(b"ctts", pack("Ii", _runs(s.cts for s in samples))))
    if not all(s.key for s in samples):
        parts.append(_full(b"stss", pack("I", [(i + 1,) for i, s in enumerate(samples) if s.key])))
    parts.append(_full(b"stsc", pack("III", [(1, 1, 1)] if n else [])))
    parts.append(_full(b"stsz", struct.pack(">II", 0, n), b"".join(struct.pack(">I", s.size) for s in samples)))
    parts.append(_full(b"co64", pack("Q", [(s.offset,) for s in samples])))
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1")))
    minf = _box(b"minf", _box(b"vmhd", b"\0\0\0\1" + b"\0" * 8), dinf, _box(b"stbl", *parts))
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, like.timescale, dts, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12s", 0, b"vide", b""), b"video\0"), minf)
    tkhd = _box(b"tkhd", b"\0\0\0\3", struct.pack(">IIIII", 0, 0, 1, 0, dts * 1000 // max(1, like.timescale)), b"\0" * 16, _MATRIX, struct.pack(">II", like.width << 16, like.height << 16))
    mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, 1000, dts * 1000 // max(1, like.timescale)), struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2))
    out.write(_box(b"moov", mvhd, _box(b"trak", tkhd, mdia)))
    return Track(like.timescale, like.codec, like.width, like.height, like.description, samples)


def packets(file: BinaryIO, track: Track, samples: Iterable[Sample] | None = None) -> Iterator[tuple[bytes, Sample]]:
    for s in track.samples if samples is None else samples:
        file.seek(s.offset)
        yield file.read(s.size), s


def within(track: Track, start: float, stop: float) -> list[Sample]:
    """Samples shown from ``start`` up to ``stop`` seconds, in decode order; found by bisection, as a file may hold very many slices."""
    times, order = track.shown
    a, b = bisect_left(times, start - EPSILON), bisect_left(times, stop - EPSILON)
    return track.samples[a:b] if order is None else [track.samples[i] for i in sorted(order[a:b])]


def same_stream(a: Track, b: Track) -> bool:
    """Whether packets of both may stand in one track."""
    return (a.description, a.timescale) == (b.description, b.timescale)


def join_slices(slices: Iterable[tuple[BinaryIO, Track, float, float]], out: BinaryIO, size: int | None = None) -> Track:
    """One file with the packets of slices (file, track, start, stop) in order.

    Codec parameters and time scales must agree, and a slice must begin with a
    key frame: a cut elsewhere needs a codec.  With ``size``, the bytes of all
    packets, a slice is asked for when the one before is written, so its file
    need not be open until then; else all are checked before any is written.
    """
    rest = iter(slices)
    if (first := next(rest, None)) is None:
        raise ValueError("no slices")
    like = first[1]

    def chosen(track: Track, start: float, stop: float) -> list[Sample]:
        if not same_stream(track, like):
            raise ValueError("the inputs' codec parameters or time scales differ")
        found = within(track, start, stop)
        if found and not found[0].key:
            raise ValueError(f"the slice at {start} does not begin with a key frame")
        return found

    every: Iterable[tuple[BinaryIO, Track, float, float]] = chain([first], rest)
    if size is None:
        every = list(every)
        size = sum(s.size for _, track, start, stop in every for s in chosen(track, start, stop))
    return _stream(out, like, (pair for file, track, start, stop in every for pair in packets(file, track, chosen(track, start, stop))), size)


def concatenate(inputs: list[BinaryIO], out: BinaryIO) -> Track:
    """One file with the packets of all inputs in order; codec parameters and time scales must agree."""
    return join_slices([(f, read_track(f), 0.0, float("inf")) for f in inputs], out)


def split(source: BinaryIO, ranges: list[tuple[float, float, BinaryIO]]) -> None:
    """Cuts a file into slices that start at 0; a slice must begin with a key frame."""
    track = read_track(source)
    for start, stop, out in ranges:
        join_slices([(source, track, start, stop)], out)


def _nal_types(data: bytes, length_bytes: int) -> set[int]:
    """Types of the H.264 units of a packet."""
    at, found = 0, set()
    while at + length_bytes < len(data):
        size = int.from_bytes(data[at : at + length_bytes], "big")
        at += length_bytes
        if not size or at + size > len(data):
            return set()
        found.add(data[at] & 31)
        at += size
    return found


def remux_safe(file: BinaryIO, ranges: list[tuple[float, float]]) -> bool:
    """Whether every range can be cut out by moving packets: proven, or False.

    Packets of motion JPEG stand alone.  A range of H.264 must begin with an
    instantaneous refresh, and no packet from outside may be shown within it.
    """
    track = read_track(file)
    if track.codec in ("jpeg", "mjpa"):
        return all(within(track, a, b) for a, b in ranges)
    at = track.description.find(b"avcC")
    if track.codec not in ("avc1", "avc3") or at < 0:
        return False
    length_bytes = (track.description[at + 8] & 3) + 1
    order = {s.offset: i for i, s in enumerate(track.samples)}
    for a, b in ranges:
        chosen = within(track, a, b)
        if not chosen or not chosen[0].key or [order[s.offset] for s in chosen] != list(range(order[chosen[0].offset], order[chosen[0].offset] + len(chosen))):
            return False
        data, _ = next(packets(file, track, chosen[:1]))
        if 5 not in _nal_types(data, length_bytes):
            return False
    return True


def packet_digest(file: BinaryIO, start: float = 0.0, stop: float = float("inf"), track: Track | None = None) -> str:
    """SHA-256 over the encoded packets shown in a slice, in decode order."""
    track = track or read_track(file)
    digest = hashlib.sha256()
    for data, _ in packets(file, track, within(track, start, stop)):
        digest.update(data)
    return digest.hexdigest()


def probe(file: BinaryIO) -> dict[str, object]:
    """Codec, size, frames, rate, duration and whether there is audio."""
    t = read_track(file)
    return {"codec": t.codec, "width": t.width, "height": t.height, "frames": len(t.samples), "fps": t.fps, "duration": t.duration, "audio": t.audio}


def jpeg_size(data: bytes) -> tuple[int, int]:
    """Width and height from the frame header of a JPEG."""
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    raise ValueError("not a JPEG with a frame header")


def jpeg_passthrough(frames: Iterable[bytes]) -> bool:
    """Whether frames may become a motion-JPEG file as they are: all of them JPEG, and of one size."""
    sizes = set()
    for f in frames:
        try:
            sizes.add(jpeg_size(f) if f[:2] == b"\xff\xd8" else None)
        except (ValueError, struct.error):
            return False
        if None in sizes or len(sizes) > 1:
            return False
    return len(sizes) == 1


def mux_jpegs(frames: Iterable[bytes], fps: int, out: BinaryIO, sizes: list[int] | None = None) -> Track:
    """A motion-JPEG file with the frames as they are; with their ``sizes`` no more than one is held."""
    if sizes is None:
        frames = list(frames)
        sizes = [len(f) for f in frames]
    frames = iter(frames)
    try:
        first = next(frames)
    except StopIteration:
        raise ValueError("no frames") from None
    width, height = jpeg_size(first)
    entry = b"\0" * 6 + struct.pack(">H", 1) + b"\0" * 16 + struct.pack(">HHIIIH", width, height, 0x480000, 0x480000, 0, 1) + b"\0" * 32 + struct.pack(">Hh", 24, -1)
    track = Track(fps, "jpeg", width, height, b"\0\0\0\0" + struct.pack(">I", 1) + _box(b"jpeg", entry))

    def payload() -> Iterator[bytes]:
        yield first
        for f in frames:
            if jpeg_size(f) != (width, height):
                raise ValueError("the frames' sizes differ")
            yield f

    return write_mp4(out, track, [Sample(0, n, 0, 0, 1, True) for n in sizes], payload())
