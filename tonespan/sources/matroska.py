"""Named audio tracks of plain PCM in Matroska, and the headers of audio containers."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

# Element numbers of the container format.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE, TRACKS, TRACK, NUMBER, UID, KIND, CODEC, NAME, AUDIO, HERTZ, CHANNELS, DEPTH, CLUSTER, TIME, BLOCK = (
    0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x536E, 0xE1, 0xB5, 0x9F, 0x6264, 0x1F43B675, 0xE7, 0xA3,
)
_PARENTS = {SEGMENT, TRACKS, TRACK, AUDIO, CLUSTER}
_UNKNOWN = (1 << 56) - 1
#: Names that programs give streams without a title.
DEFAULT_TITLES = ("SoundHandler", "Core Media Audio")


def _element(number: int, payload: bytes | int | float | str) -> bytes:
    if isinstance(payload, int):
        payload = payload.to_bytes(max(1, (payload.bit_length() + 7) // 8), "big")
    elif isinstance(payload, float):
        payload = struct.pack(">d", payload)
    elif isinstance(payload, str):
        payload = payload.encode()
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + (len(payload) | 1 << 56).to_bytes(8, "big") + payload


def header(names: list[str], rate: int) -> bytes:
    """What stands before the sound: one mono 16-bit track for each name. Times count
    samples as nearly as whole nanoseconds allow."""
    tracks = b"".join(
        _element(TRACK, _element(NUMBER, k) + _element(UID, k) + _element(KIND, 2) + _element(CODEC, "A_PCM/INT/LIT") + _element(NAME, name) + _element(AUDIO, _element(HERTZ, float(rate)) + _element(CHANNELS, 1) + _element(DEPTH, 16)))
        for k, name in enumerate(names, 1)
    )
    segment = SEGMENT.to_bytes(4, "big") + (_UNKNOWN | 1 << 56).to_bytes(8, "big")
    return _element(EBML, _element(DOC_TYPE, "matroska")) + segment + _element(INFO, _element(SCALE, 1_000_000)) + _element(TRACKS, tracks)


def cluster(at_ms: int, tracks: list[np.ndarray]) -> bytes:
    """Sound of every track (samples in [-1, 1]) from one moment on."""
    blocks = b"".join(_element(BLOCK, bytes([0x80 | k]) + struct.pack(">hB", 0, 0x80) + to_16bit(x)) for k, x in enumerate(tracks, 1))
    return _element(CLUSTER, _element(TIME, at_ms) + blocks)


def to_16bit(x: np.ndarray) -> bytes:
    return np.clip(np.rint(np.asarray(x, np.float64) * 32768), -32768, 32767).astype("<i2").tobytes()


def _number(data: memoryview, at: int, keep: bool) -> tuple[int, int]:
    """A number of variable length and the place behind it."""
    size = 9 - data[at].bit_length()
    raw = int.from_bytes(data[at : at + size], "big")
    return raw if keep else raw & ~(1 << (7 * size)), at + size


def elements(data: memoryview, at: int = 0, end: int | None = None) -> Iterator[tuple[int, memoryview]]:
    """Elements in order; those that hold others are followed by what they hold."""
    end = len(data) if end is None else end
    while at < end:
        number, at = _number(data, at, keep=True)
        size, begin = _number(data, at, keep=False)
        stop = end if size in (_UNKNOWN, 0x7F) else begin + size
        yield number, data[begin : min(stop, end)]
        at = begin if number in _PARENTS else stop


class Track(NamedTuple):
    number: int
    kind: int
    name: str
    rate: float


def tracks_of(content: bytes) -> list[Track]:
    """The tracks that the header lists."""
    found: list[dict] = []
    for number, data in elements(memoryview(content)):
        if number == CLUSTER:
            break
        if number == TRACK:
            found.append({"number": 0, "kind": 0, "name": "", "rate": 0.0})
        elif number in (NUMBER, KIND) and found:
            found[-1]["number" if number == NUMBER else "kind"] = int.from_bytes(data, "big")
        elif number == NAME and found:
            found[-1]["name"] = bytes(data).decode(errors="replace")
        elif number == HERTZ and found:
            found[-1]["rate"] = struct.unpack(">d" if len(data) == 8 else ">f", data)[0]
    return [Track(**t) for t in found]


def decode(content: bytes, stream: int = 0) -> tuple[np.ndarray, int]:
    """(samples x 1, rate) of one audio track of 16-bit PCM."""
    track = [t for t in tracks_of(content) if t.kind == 2][stream]
    parts = [np.frombuffer(data[4:], "<i2") for number, data in elements(memoryview(content)) if number == BLOCK and data[0] & 0x7F == track.number]
    x = np.concatenate(parts) if parts else np.zeros(0, "<i2")
    return (x / 32768.0).reshape(-1, 1), int(track.rate)


def _boxes(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    at = 0
    while at + 8 <= len(data):
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8]), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or len(data) - at
        if size < head:
            return
        yield kind, data[at + head : at + size]
        at += size


def _inside(data: memoryview, *path: bytes) -> Iterator[memoryview]:
    for kind, inner in _boxes(data):
        if kind == path[0]:
            if len(path) == 1:
                yield inner
            else:
                yield from _inside(inner, *path[1:])


def titles(content: bytes) -> list[str]:
    """The title of each audio stream, "" where it has none; raises where the container is
    not known."""
    head = content[:12]
    if head[:4] == EBML.to_bytes(4, "big"):
        found = [t.name for t in tracks_of(content) if t.kind == 2]
    elif head[4:8] in (b"ftyp", b"moov", b"free", b"mdat", b"wide"):
        found = []
        for trak in _inside(memoryview(content), b"moov", b"trak"):
            handler = next(_inside(trak, b"mdia", b"hdlr"), None)
            if handler is None or bytes(handler[8:12]) != b"soun":
                continue
            named = next(_inside(trak, b"udta", b"name"), None)
            name = bytes(named if named is not None else handler[24:])
            found.append(name.strip(b"\0").decode(errors="replace").strip())
    elif head[:4] in (b"RIFF", b"fLaC", b"OggS") or head[:3] == b"ID3" or head[:1] == b"\xff":
        found = [""]
    else:
        raise ValueError("not a known audio container")
    return ["" if name in DEFAULT_TITLES else name for name in found]


def wave_header(rate: int, channels: int, size: int) -> bytes:
    """Of 16-bit PCM."""
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data" + struct.pack("<I", size)


class MatroskaFile:
    """Writes tracks block by block."""

    suffix = "mka"

    def __init__(self, out: io.RawIOBase, names: list[str], rate: int):
        self.out, self.rate, self.frames = out, rate, 0
        out.write(header(names, rate))

    def write(self, tracks: list[np.ndarray]) -> None:
        step = 30_000 * self.rate // 1000  # times within a cluster are 16 bits of milliseconds
        for a in range(0, len(tracks[0]), step):
            self.out.write(cluster(self.frames * 1000 // self.rate, [x[a : a + step] for x in tracks]))
            self.frames += len(tracks[0][a : a + step])

    def close(self) -> None:
        self.out.close()


class WaveFile:
    """Writes tracks as channels; the sizes in the header are those of a stream, as readers
    take up to the file's end."""

    suffix = "wav"

    def __init__(self, out: io.RawIOBase, names: list[str], rate: int):
        self.out, self.frames = out, 0
        out.write(wave_header(rate, len(names), 0xFFFFFFFF - 36))

    def write(self, tracks: list[np.ndarray]) -> None:
        self.out.write(to_16bit(np.stack(tracks, axis=1)))
        self.frames += len(tracks[0])

    def close(self) -> None:
        self.out.close()
