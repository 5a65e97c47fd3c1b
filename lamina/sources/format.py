"""The container's bytes: header, directory, chunk payloads, trailer.  Pure functions over bytes, for Arrow functions."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .codec import Fault

# Fixed values of the format.
MAGIC, TRAILER = b"LUMN", b"LEND"
VERSION = 1
MULTI_SECTOR, ENCRYPTED = 1 << 1, 1 << 3
RETIRED_FLAGS = 1 << 0 | 1 << 2 | 1 << 4
SEALED = 1 << 4
HEADER, DESCRIPTOR, ENTRY = struct.Struct("<4sIQIIQ"), struct.Struct("<4sQQQI"), struct.Struct("<IIIIQI")
DICT_MOST = 112640
CLEAR = ("HEAD", "AUTH", "LTBL", "LHAS")
CONTENT = ("LAYR", "META", "PROF", "LROV", "VOXL", "ZDIC")
COMPRESSED = ("META", "PROF", "LROV", "VOXL")
PASSWORD_BYTES, RECIPIENT_BYTES = 65, 104


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


_TABLE = _crc_table()
_LIST = [int(x) for x in _TABLE]


def _crc_plain(data: bytes, crc: int = 0xFFFFFFFF) -> int:
    for b in data:
        crc = _LIST[(crc ^ b) & 255] ^ (crc >> 8)
    return crc


def _advance(crc: int, zeros: np.ndarray) -> int:
    """Applies a 32 by 32 bit matrix (a column for each bit) to a state."""
    out, i = 0, 0
    while crc:
        if crc & 1:
            out ^= int(zeros[i])
        crc >>= 1
        i += 1
    return out


def crc32c(data: bytes, lanes: int = 256) -> int:
    """CRC-32C.  Long data are cut in equal lanes that advance together, and are then combined."""
    if len(data) < 64 * lanes:
        return _crc_plain(data) ^ 0xFFFFFFFF
    size = len(data) // lanes
    rows = np.frombuffer(data[: size * lanes], np.uint8).reshape(lanes, size)
    state = np.zeros(lanes, np.uint32)
    state[0] = 0xFFFFFFFF
    for b in np.ascontiguousarray(rows.T):
        state = _TABLE[(state ^ b) & 255] ^ (state >> 8)
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(size):
        basis = _TABLE[basis & 255] ^ (basis >> 8)
    crc = 0
    for s in state:
        crc = _advance(crc, basis) ^ int(s)
    return _crc_plain(data[size * lanes :], crc) ^ 0xFFFFFFFF


@dataclass
class Chunk:
    kind: str
    payload: bytes  # as stored
    size: int  # size_uncompressed
    compressed: int = 0
    flags: int = 0
    offset: int = 0
    index: int = 0

    @property
    def stored(self) -> int:
        return self.compressed or self.size


@dataclass
class Header:
    magic: bytes
    version: int
    dir_offset: int
    chunk_count: int
    flags: int
    total: int


def parse_header(data: bytes) -> Header:
    if len(data) < 32:
        raise Fault("header.magic", "shorter than a header")
    return Header(*HEADER.unpack_from(data))


def parse_descriptor(data: bytes, index: int) -> Chunk:
    if len(data) < DESCRIPTOR.size:
        raise Fault("dir.descriptor", f"{len(data)} bytes of descriptor {index}")
    kind, offset, size, compressed, flags = DESCRIPTOR.unpack_from(data)
    return Chunk(kind.decode("latin-1"), b"", size, compressed, flags, offset, index)


def parse_directory(data: bytes, h: Header) -> list[Chunk]:
    """All descriptors, null ones too (offset 0); payloads only where they lie in the file."""
    end = h.dir_offset + 32 * h.chunk_count
    if h.dir_offset < 32 or end > len(data) - 8:
        raise Fault("header.dir_offset", f"{h.chunk_count} descriptors at {h.dir_offset} in {len(data)} bytes")
    out = []
    for i in range(h.chunk_count):
        c = parse_descriptor(data[h.dir_offset + 32 * i : h.dir_offset + 32 * (i + 1)], i)
        if c.offset:
            c.payload = data[c.offset : c.offset + c.stored]
        out.append(c)
    return out


def unzstd(frame: bytes, most: int, dictionary: bytes | None = None, check: str = "layr.frame_decompressed_size") -> bytes:
    """The content of one frame, if it declares its size, that size is at most `most`, and it holds exactly that."""
    import zstandard

    size = content_size(frame)
    if size > most:
        raise Fault("frame.allocation_bound", f"{size} bytes declared, {most} justified")
    try:
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out = d.decompress(frame, max_output_size=max(size, 1))
    except zstandard.ZstdError as e:
        raise Fault(check, str(e)) from None
    if len(out) != size:
        raise Fault(check, f"{len(out)} bytes, {size} declared")
    return out


def content_size(frame: bytes) -> int:
    import zstandard

    try:
        p = zstandard.get_frame_parameters(frame)
    except zstandard.ZstdError as e:
        raise Fault("layr.content_size_present", str(e)) from None
    if p.content_size == zstandard.CONTENTSIZE_UNKNOWN:
        raise Fault("layr.content_size_present", "the frame doesn't declare its size")
    return p.content_size


def dict_id(frame: bytes) -> int:
    import zstandard

    return zstandard.get_frame_parameters(frame).dict_id


def zstd(data: bytes, level: int, dictionary: bytes | None = None) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True).compress(data)


# --- payloads ---------------------------------------------------------------------------------------------------


@dataclass
class Head:
    name: str = ""
    created: int = 0
    width: int = 0
    height: int = 0
    build_w: int = 0
    build_d: int = 0
    build_h: int = 0
    layer_height: int = 0
    total_layers: int = 0
    version: int = 1

    def to_bytes(self) -> bytes:
        name = self.name.encode()
        return struct.pack("<II", self.version, len(name)) + name + struct.pack("<QIIIIIII", self.created, self.width, self.height, self.build_w, self.build_d, self.build_h, self.layer_height, self.total_layers)

    @classmethod
    def parse(cls, data: bytes) -> Head:
        if len(data) < 8:
            raise Fault("head.frame", "shorter than its name's length")
        version, n = struct.unpack_from("<II", data)
        if version != 1:
            raise Fault("head.version", str(version))
        if n > 256 or len(data) != 44 + n:
            raise Fault("head.frame", f"a name of {n} bytes in {len(data)}")
        try:
            name = data[8 : 8 + n].decode()
        except UnicodeDecodeError:
            raise Fault("head.frame", "the name is not UTF-8") from None
        return cls(name, *struct.unpack_from("<QIIIIIII", data, 8 + n), version)


@dataclass
class Entry:
    data_size: int
    first_lrov: int
    first_layr: int
    additional: int
    data_offset: int
    sector: int
    layer: int = -1


def table_bytes(entries: list[Entry], layers: int) -> bytes:
    return struct.pack("<IIII", 1, layers, ENTRY.size, len(entries)) + b"".join(ENTRY.pack(e.data_size, e.first_lrov, e.first_layr, e.additional, e.data_offset, e.sector) for e in entries)


def parse_table(data: bytes) -> tuple[int, list[Entry]]:
    """The layer count and the entries, with their layers where the walk along the table reaches them."""
    if len(data) < 16:
        raise Fault("ltbl.entry_size", "shorter than its header")
    version, layers, stride, count = struct.unpack_from("<IIII", data)
    if version != 1:
        raise Fault("ltbl.version", str(version))
    if stride < ENTRY.size:
        raise Fault("ltbl.entry_size", str(stride))
    if len(data) != 16 + count * stride:
        raise Fault("ltbl.entry_count", f"{count} entries of {stride} bytes in {len(data)}")
    entries = [Entry(*ENTRY.unpack_from(data, 16 + i * stride)) for i in range(count)]
    at = layer = 0
    while at < count:
        group = entries[at : at + 1 + entries[at].additional]
        if len(group) != 1 + entries[at].additional or any(e.additional for e in group[1:]):
            raise Fault("ltbl.entry_count", f"layer {layer}")
        for e in group:
            e.layer = layer
        at += len(group)
        layer += 1
    return layers, entries


def leaf(data: bytes) -> bytes:
    return hashlib.sha256(b"\0" + data).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    if not leaves:
        return hashlib.sha256(b"\1").digest()
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + leaves[i] + leaves[i + 1]).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def hashes_bytes(leaves: list[bytes]) -> bytes:
    return struct.pack("<BBI", 1, 32, len(leaves)) + merkle_root(leaves) + b"".join(leaves)


def parse_hashes(data: bytes) -> tuple[int, bytes, list[bytes]]:
    if len(data) < 38:
        raise Fault("lhas.frame", "shorter than its header")
    algorithm, size, count = struct.unpack_from("<BBI", data)
    if algorithm != 1 or size != 32:
        raise Fault("lhas.hash_algorithm", f"{algorithm}, {size} bytes")
    if len(data) < 38 + 32 * count:
        raise Fault("lhas.frame", f"{count} hashes in {len(data)} bytes")
    return count, data[6:38], [data[38 + 32 * i : 70 + 32 * i] for i in range(count)]


def dictionary_bytes(dictionary: bytes, number: int) -> bytes:
    return struct.pack("<III", 1, number, len(dictionary)) + dictionary


def parse_dictionary(data: bytes) -> tuple[int, bytes]:
    if len(data) < 12:
        raise Fault("zdic.dict_size", "shorter than its header")
    version, number, size = struct.unpack_from("<III", data)
    if version != 1:
        raise Fault("zdic.version", str(version))
    if size > DICT_MOST or len(data) < 12 + size:
        raise Fault("zdic.dict_size", str(size))
    return number, data[12 : 12 + size]


@dataclass
class Auth:
    cipher: str
    mode: int
    password: bytes = b""
    machine: bytes = b""
    version: int = 1

    def to_bytes(self) -> bytes:
        return self.cipher.encode() + struct.pack("<IIII", self.version, self.mode, len(self.password), len(self.machine)) + self.password + self.machine

    @classmethod
    def parse(cls, data: bytes) -> Auth:
        if len(data) < 20:
            raise Fault("auth.frame", "shorter than its header")
        version, mode, p, m = struct.unpack_from("<IIII", data, 4)
        if version != 1:
            raise Fault("auth.version", str(version))
        if data[:4] not in (b"A256", b"C20P"):
            raise Fault("auth.cipher_known", repr(data[:4]))
        if len(data) < 20 + p + m:
            raise Fault("auth.frame", f"sections of {p} and {m} bytes in {len(data)}")
        out = cls(data[:4].decode(), mode, data[20 : 20 + p], data[20 + p : 20 + p + m], version)
        if not mode & 3:
            raise Fault("crypt.mode_empty")
        if mode & 1:
            if p < PASSWORD_BYTES:
                raise Fault("crypt.password_section_len", str(p))
            t, memory, lanes = struct.unpack_from("<IIB", out.password, 16)
            if t > 10 or memory > 4194304 or lanes > 16:
                raise Fault("crypt.argon2_budget", f"{t}, {memory} KiB, {lanes}")
        if mode & 2 and (m < RECIPIENT_BYTES or m % RECIPIENT_BYTES):
            raise Fault("crypt.machine_section_len", str(m))
        return out

    def recipients(self) -> list[tuple[bytes, bytes, bytes]]:
        """(fingerprint, ephemeral key, wrapped key) of each machine."""
        return [(self.machine[i : i + 32], self.machine[i + 32 : i + 64], self.machine[i + 64 : i + 104]) for i in range(0, len(self.machine), RECIPIENT_BYTES)]


def json_object(data: bytes, check: str) -> dict:
    """A JSON object; numbers with a fraction or an exponent stay floats."""

    def refuse(x: str):
        raise ValueError(x)

    try:
        found = json.loads(data.decode(), parse_constant=refuse)
    except (ValueError, RecursionError) as e:
        raise Fault(check, str(e)[:80]) from None
    if not isinstance(found, dict):
        raise Fault(check, "no object")
    return found


# --- whole files ------------------------------------------------------------------------------------------------


def assemble(chunks: list[Chunk], flags: int) -> bytes:
    """A file of the chunks in order: payloads at multiples of eight, the directory, the trailer."""
    body, at, rows = bytearray(), 32, []
    for c in chunks:
        pad = -at % 8
        body += b"\0" * pad + c.payload
        at += pad
        rows.append(DESCRIPTOR.pack(c.kind.encode("latin-1"), at, c.size, c.compressed, c.flags))
        at += len(c.payload)
    body += b"\0" * (-at % 8)
    at += -at % 8
    data = HEADER.pack(MAGIC, VERSION, at, len(chunks), flags, sum(c.size for c in chunks)) + bytes(body) + b"".join(rows)
    return data + TRAILER + struct.pack("<I", crc32c(data))


def plain_chunk(kind: str, payload: bytes, flags: int = 0) -> Chunk:
    return Chunk(kind, payload, len(payload), 0, flags)


def json_chunk(kind: str, value: dict, level: int = 3) -> Chunk:
    raw = json.dumps(value, separators=(",", ":"), sort_keys=True).encode()
    frame = zstd(raw, level)
    return Chunk(kind, frame, len(raw), len(frame))


def layer_chunk(frame: bytes) -> Chunk:
    payload = struct.pack("<I", 1) + frame
    return Chunk("LAYR", payload, len(payload), len(payload))


#: Decompressed layer chunks held at most for one file.
KEPT = 16


@dataclass
class Parsed:
    """What can be read of a file without a key; chunks that are sealed are left alone."""

    header: Header
    chunks: list[Chunk]
    head: Head | None = None
    meta: dict = field(default_factory=dict)
    layers: int = 0
    entries: list[Entry] = field(default_factory=list)
    dictionary: bytes | None = None
    frames: dict[int, tuple[bytes | None, int]] = field(default_factory=dict)  # compressed, and the most that they may hold
    overrides: dict[int, dict] = field(default_factory=dict)
    fetch: Callable[[Chunk], bytes] | None = None  # reads a layer chunk that isn't at hand
    kept: dict[int, bytes] = field(default_factory=dict)  # outputs last asked for, the oldest first
    of_layer: dict[int, list[Entry]] | None = None

    def of(self, kind: str) -> list[Chunk]:
        return [c for c in self.chunks if c.offset and c.kind == kind]

    def frame(self, index: int) -> bytes:
        """A layer chunk's output; as many are kept as a layer has sectors, up to KEPT, so a walk by layers opens each once."""
        out = self.kept.pop(index, None)
        if out is None:
            if index not in self.frames:
                raise Fault("ltbl.first_layr_in_range", str(index))
            raw, most = self.frames[index]
            if raw is None:
                raw = self.fetch(self.chunks[index])[4:]
            out = unzstd(raw, most, self.dictionary if dict_id(raw) else None)
            room = min(KEPT, 1 + max((e.additional for e in self.entries), default=0))
            while len(self.kept) >= room:
                del self.kept[next(iter(self.kept))]
        self.kept[index] = out
        return out

    def slice(self, e: Entry) -> bytes:
        if not e.data_size:
            return b""
        frame = self.frame(e.first_layr)
        if e.data_offset + e.data_size > len(frame):
            raise Fault("ltbl.offset_within_chunk", f"{e.data_offset} + {e.data_size} of {len(frame)}")
        return frame[e.data_offset : e.data_offset + e.data_size]

    def layer_data(self, layer: int) -> bytes:
        if self.of_layer is None:
            self.of_layer = {}
            for e in self.entries:
                self.of_layer.setdefault(e.layer, []).append(e)
        return b"".join(self.slice(e) for e in sorted(self.of_layer.get(layer, []), key=lambda e: e.sector))


def payload_of(c: Chunk) -> bytes:
    """Decompressed by the chunk's type; an extension is compressed where its descriptor says so."""
    if c.kind in COMPRESSED or c.kind == "EXTD" and c.compressed:
        return unzstd(c.payload, 4096 * max(len(c.payload), 1))
    return c.payload


def read(data: bytes) -> Parsed:
    """Opens a file without validating it; what is malformed raises Fault.  Frames are decompressed when first asked for."""
    h = parse_header(data)
    if h.magic != MAGIC:
        raise Fault("header.magic", repr(h.magic))
    return _filled(Parsed(h, parse_directory(data, h)))


def read_ranges(at: Callable[[int, int], bytes], size: int) -> Parsed:
    """Opens a file of `size` bytes by at(offset, length): header, directory, and the small chunks; layer chunks when asked for.

    Scenes, previews and extensions are not read.
    """
    h = parse_header(at(0, min(size, HEADER.size)))
    if h.magic != MAGIC:
        raise Fault("header.magic", repr(h.magic))
    if h.dir_offset < 32 or h.dir_offset + 32 * h.chunk_count > size - 8:
        raise Fault("header.dir_offset", f"{h.chunk_count} descriptors at {h.dir_offset} in {size} bytes")
    raw = at(h.dir_offset, 32 * h.chunk_count)
    chunks = [parse_descriptor(raw[32 * i : 32 * (i + 1)], i) for i in range(h.chunk_count)]

    def fetch(c: Chunk) -> bytes:
        return at(c.offset, max(0, min(c.stored, size - c.offset)))

    for c in chunks:
        if c.offset and c.kind in ("HEAD", "META", "LTBL", "ZDIC", "LROV", "LHAS", "AUTH"):
            c.payload = fetch(c)
    return _filled(Parsed(h, chunks, fetch=fetch))


def _filled(p: Parsed) -> Parsed:
    clear = lambda kind: [c for c in p.of(kind) if not c.flags & SEALED]
    p.head = Head.parse(next(iter(clear("HEAD"))).payload) if clear("HEAD") else None
    if clear("META"):
        p.meta = json_object(payload_of(clear("META")[0]), "meta.json")
    if clear("LTBL"):
        p.layers, p.entries = parse_table(clear("LTBL")[0].payload)
    if clear("ZDIC"):
        p.dictionary = parse_dictionary(clear("ZDIC")[0].payload)[1]
    pixels = p.head.width * p.head.height if p.head else 0
    slices: dict[int, int] = {}
    for e in p.entries:
        slices[e.first_layr] = slices.get(e.first_layr, 0) + (e.data_size > 0)
    for c in clear("LAYR"):
        p.frames[c.index] = (c.payload[4:] if p.fetch is None else None, max(slices.get(c.index, 0), 1) * (5 * pixels + 64))
    for c in clear("LROV"):
        p.overrides[c.index] = json_object(payload_of(c), "lrov.json")
    return p
