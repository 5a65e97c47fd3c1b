"""Byte codecs of run-end streams, on NumPy arrays; called from Arrow functions, one call for each slice.

A run list is (starts, values): ascending starts, from 0, and the value of each run; neighbours differ.  Reading
raises Fault with the name of the check that fails.  strict also checks the canonical form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINARY, GRAY, SPLIT, ATTACHED = 0, 1, 2, 3
MOST = (1 << 28) - 1


@dataclass
class Fault(Exception):
    check: str
    detail: str = ""

    def __str__(self) -> str:
        return f"{self.check}: {self.detail}"


# --- integers ---------------------------------------------------------------------------------------------------


def varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def zigzag(d: np.ndarray) -> np.ndarray:
    return np.where(d >= 0, 2 * d, -2 * d - 1)


def unzigzag(u: np.ndarray) -> np.ndarray:
    return np.where(u & 1, -((u + 1) >> 1), u >> 1)


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int, check: str) -> bytes:
        if n > len(self.data) - self.at:
            raise Fault(check, f"{n} bytes wanted, {len(self.data) - self.at} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        out = 0
        for i in range(10):
            b = self.take(1, "ree.varint")[0]
            out |= (b & 127) << (7 * i)
            if b < 128:
                if i and not b:
                    raise Fault("ree.varint", "not the shortest form")
                if out >> 64:
                    raise Fault("ree.varint", "more than 64 bits")
                return out
        raise Fault("ree.varint", "more than ten bytes")


# --- significance planes ----------------------------------------------------------------------------------------


def write_planes(values: np.ndarray) -> bytes:
    """Four plane lengths, then byte j of every varint in plane j."""
    v = np.asarray(values, np.int64)
    if len(v) and (v.max() > MOST or v.min() < 0):
        raise Fault("ree.varint", "a stored value needs a fifth byte")
    planes = []
    for j in range(4):
        reach = v >= (1 << (7 * j)) if j else np.ones(len(v), bool)
        part = v[reach]
        planes.append((((part >> (7 * j)) & 127) | np.where(part >= (1 << (7 * (j + 1))), 128, 0)).astype(np.uint8).tobytes())
    return b"".join(varint(len(p)) for p in planes) + b"".join(planes)


def read_planes(c: Cursor, count: int, strict: bool) -> np.ndarray:
    sizes = [c.varint() for _ in range(4)]
    if strict and any(a == 0 < b for a, b in zip(sizes, sizes[1:])):
        raise Fault("ree.planes", "a plane follows an empty one")
    planes = [np.frombuffer(c.take(n, "ree.varint"), np.uint8) for n in sizes]
    out, live = np.zeros(count, np.int64), np.arange(count)
    for j, plane in enumerate(planes):
        if len(plane) < len(live):
            raise Fault("ree.varint", f"plane {j} ends early")
        if strict and len(plane) > len(live):
            raise Fault("ree.planes", f"plane {j} holds more than its array")
        now = plane[: len(live)].astype(np.int64)
        if j and ((now == 0)).any():
            raise Fault("ree.varint", "not the shortest form")
        out[live] |= (now & 127) << (7 * j)
        live = live[now > 127]
    if len(live):
        raise Fault("ree.varint", "a fifth byte")
    return out


# --- runs -------------------------------------------------------------------------------------------------------


def merge(starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins equal neighbours."""
    if not len(starts):
        return starts, values
    new = np.ones(len(starts), bool)
    new[1:] = values[1:] != values[:-1]
    return starts[new], values[new]


def runs_of_mask(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.asarray(mask, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(mask[1:] != mask[:-1]) + 1]) if len(mask) else np.zeros(0, np.int64)
    return starts.astype(np.int64), mask[starts]


def runs_of_spans(spans: list[tuple[int, int, int]], pixels: int) -> tuple[np.ndarray, np.ndarray]:
    """From disjoint (start, end, value) spans over black."""
    starts, values, at = [], [], 0
    for s, e, v in sorted(spans):
        if s > at:
            starts.append(at)
            values.append(0)
        if s < at or e > pixels or s >= e:
            raise Fault("ree.data_size", "spans must be disjoint and inside the layer")
        starts.append(s)
        values.append(v)
        at = e
    if at < pixels:
        starts.append(at)
        values.append(0)
    return merge(np.array(starts, np.int64), np.array(values, np.uint8))


def mask_of_runs(runs: tuple[np.ndarray, np.ndarray], pixels: int) -> np.ndarray:
    starts, values = runs
    return np.repeat(values, np.diff(np.append(starts, pixels)))


def core_of(runs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    starts, values = runs
    return merge(starts, np.where(values >= 128, 255, 0).astype(np.uint8))


def edges_of(runs: tuple[np.ndarray, np.ndarray], pixels: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the anti-aliased pixels."""
    starts, values = runs
    sizes = np.diff(np.append(starts, pixels))
    some = (values != 0) & (values != 255)
    n = sizes[some]
    where = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(starts[some], n) + where, np.repeat(values[some], n)


def with_edges(core: tuple[np.ndarray, np.ndarray], at: np.ndarray, values: np.ndarray, pixels: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a core with single pixels written over it; no mask is built."""
    cuts = np.unique(np.concatenate([core[0], at, at + 1]))
    cuts = cuts[cuts < pixels]
    out = core[1][np.searchsorted(core[0], cuts, "right") - 1].copy()
    place = np.searchsorted(at, cuts)
    hit = (place < len(at)) & (at[np.minimum(place, max(len(at) - 1, 0))] == cuts) if len(at) else np.zeros(len(cuts), bool)
    out[hit] = values[place[hit]]
    return merge(cuts, out)


# --- writing ----------------------------------------------------------------------------------------------------


def _binary_body(core: tuple[np.ndarray, np.ndarray]) -> bytes:
    starts, values = core
    return bytes([int(values[0])]) + varint(len(starts)) + write_planes(np.diff(starts))


def encode(runs: tuple[np.ndarray, np.ndarray], pixels: int, tag: int | None = None) -> bytes:
    """A slice: the tag and its stream; no bytes where all is black.  tag None: binary if there is no anti-aliased
    pixel, else split where it is strictly shorter than grayscale."""
    starts, values = runs
    if not len(starts) or (len(starts) == 1 and values[0] == 0):
        return b""
    if tag is None:
        if not len(edges_of(runs, pixels)[0]):
            return encode(runs, pixels, BINARY)
        gray, split = encode(runs, pixels, GRAY), encode(runs, pixels, SPLIT)
        return split if len(split) < len(gray) else gray
    if tag == BINARY:
        if ((values != 0) & (values != 255)).any():
            raise Fault("ree.first_value", "binary form of an anti-aliased layer")
        return b"\0" + _binary_body(runs)
    if tag == GRAY:
        return b"\1" + varint(len(starts)) + values.astype(np.uint8).tobytes() + write_planes(np.diff(starts))
    core, (at, edge) = core_of(runs), edges_of(runs, pixels)
    if tag == SPLIT:
        return b"\2" + _binary_body(core) + varint(len(at)) + write_planes(np.diff(at, prepend=0)) + edge.astype(np.uint8).tobytes()
    if tag == ATTACHED:
        lengths = np.diff(core[0])
        stored = lengths.copy()
        stored[2:] = zigzag(lengths[2:] - lengths[:-2])
        ends = np.append(core[0][1:], pixels)
        run = np.searchsorted(core[0], at, "right") - 1
        first, last = at == core[0][run], (at == ends[run] - 1) & (ends[run] - core[0][run] > 1)
        flags = np.zeros(8 * -(-len(core[0]) // 4), np.uint8)
        flags[2 * run[first]] = 1
        flags[2 * run[last] + 1] = 1
        inside = at[~first & ~last]
        steps = edge.astype(np.int64)
        steps[1:] = zigzag(np.diff(edge.astype(np.int64)))
        return b"".join([b"\3", bytes([int(core[1][0])]), varint(len(core[0])), write_planes(stored[0::2]), write_planes(stored[1::2]), varint(len(at)), np.packbits(flags, bitorder="little").tobytes(), varint(len(inside)), write_planes(np.diff(inside, prepend=0)), write_planes(steps)])
    raise Fault("ree.tag", str(tag))


# --- reading ----------------------------------------------------------------------------------------------------


def _bounded(n: int, pixels: int, check: str) -> int:
    if n > pixels + 1:
        raise Fault(check, f"{n} for {pixels} pixels")
    return n


def _ends(lengths: np.ndarray, pixels: int, strict: bool) -> np.ndarray:
    """Starts of the runs from all lengths but the last."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    if strict and (len(lengths) and lengths.min() < 1 or starts[-1] >= pixels):
        raise Fault("ree.run_lengths", "a run is empty, or the last is")
    if starts[-1] > pixels or (len(lengths) and lengths.min() < 0):
        raise Fault("ree.end_positions", "runs leave the layer")
    if len(lengths) and lengths.min() < 1 or starts[-1] == pixels and pixels:
        raise Fault("ree.end_positions", "ends must increase")
    return starts


def _read_core(c: Cursor, pixels: int, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    value = c.take(1, "ree.varint")[0]
    if value not in (0, 255):
        raise Fault("ree.first_value", str(value))
    k = _bounded(c.varint(), pixels, "ree.run_lengths")
    if k == 0:
        if strict:
            raise Fault("ree.no_run_count_zero")
        if c.at < len(c.data):
            read_planes(c, 0, strict)
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    starts = _ends(read_planes(c, k - 1, strict), pixels, strict)
    return starts, np.where(np.arange(k) % 2, 255 - value, value).astype(np.uint8)


def decode(data: bytes, pixels: int, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a slice, which must end where the data end."""
    if not data:
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    c = Cursor(data, 1)
    if data[0] == BINARY:
        runs = _read_core(c, pixels, strict)
    elif data[0] == GRAY:
        runs = _read_gray(c, pixels, strict)
    elif data[0] == SPLIT:
        runs = _read_split(c, pixels, strict)
    elif data[0] == ATTACHED:
        runs = _read_attached(c, pixels, strict)
    else:
        raise Fault("ree.tag", str(data[0]))
    if c.at != len(data):
        raise Fault("ree.no_trailing_bytes", f"{len(data) - c.at} bytes follow the stream")
    return merge(*runs)


def _read_gray(c: Cursor, pixels: int, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    k = _bounded(c.varint(), pixels, "ree.run_lengths")
    if k == 0:
        if strict:
            raise Fault("ree.no_run_count_zero")
        if c.at < len(c.data):
            read_planes(c, 0, strict)
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    values = np.frombuffer(c.take(k, "ree.varint"), np.uint8)
    lengths = read_planes(c, k - 1, strict)
    if strict:
        if (lengths < 1).any() or (values[1:] == values[:-1]).any():
            raise Fault("ree.grayscale_runs", "an empty run, or equal neighbours")
        if np.isin(values, (0, 255)).all():
            raise Fault("ree.grayscale_all_binary")
    return _ends(lengths, pixels, strict), values


def _positions(deltas: np.ndarray, pixels: int, check: str) -> np.ndarray:
    at = np.cumsum(deltas)
    if len(at) and ((deltas[1:] < 1).any() or at[-1] >= pixels):
        raise Fault(check, "positions must increase and stay in the layer")
    return at


def _right_side(core: tuple[np.ndarray, np.ndarray], at: np.ndarray, values: np.ndarray, check: str) -> None:
    side = core[1][np.searchsorted(core[0], at, "right") - 1]
    if np.isin(values, (0, 255)).any() or (np.where(values >= 128, 255, 0) != side).any():
        raise Fault(check, "an overlay value is not anti-aliased, or on the wrong side of its core")


def _read_split(c: Cursor, pixels: int, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    core = _read_core(c, pixels, strict)
    n = _bounded(c.varint(), pixels, "ree.split_positions")
    at = _positions(read_planes(c, n, strict), pixels, "ree.split_positions")
    values = np.frombuffer(c.take(n, "ree.varint"), np.uint8)
    if strict:
        if not n:
            raise Fault("ree.split_all_binary")
        _right_side(core, at, values, "ree.split_threshold")
    return with_edges(core, at, values, pixels)


def _read_attached(c: Cursor, pixels: int, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    value = c.take(1, "ree.varint")[0]
    if value not in (0, 255):
        raise Fault("ree.first_value", str(value))
    k = _bounded(c.varint(), pixels, "ree.run_lengths")
    if k == 0 and strict:
        raise Fault("ree.no_run_count_zero")
    n = max(k - 1, 0)
    lengths = np.zeros(n, np.int64)
    for parity, size in ((0, (n + 1) // 2), (1, n // 2)):
        stored = read_planes(c, size, strict)
        stored[1:] = unzigzag(stored[1:])
        lengths[parity::2] = np.cumsum(stored)
    starts = _ends(lengths, pixels, strict)
    core = (starts, np.where(np.arange(k) % 2, 255 - value, value).astype(np.uint8) if k else np.zeros(1, np.uint8))
    count = _bounded(c.varint(), pixels, "ree.attach_count")
    flags = np.unpackbits(np.frombuffer(c.take(-(-k // 4), "ree.attach_count"), np.uint8), bitorder="little")
    n_escape = c.varint()
    if n_escape > count:
        raise Fault("ree.attach_count", "more escapes than overlay pixels")
    inside = _positions(read_planes(c, n_escape, strict), pixels, "ree.attach_positions")
    ends = np.append(starts[1:], pixels)
    sizes = ends - starts
    first, last = flags[0 : 2 * k : 2] > 0, flags[1 : 2 * k : 2] > 0
    if strict and (flags[2 * k :].any() or (last & (sizes[:k] == 1)).any()):
        raise Fault("ree.attach_bits", "a bit of no run, or a second one of a single pixel")
    run = np.searchsorted(starts, inside, "right") - 1
    if len(inside) and ((inside == starts[run]) | (inside == ends[run] - 1)).any():
        raise Fault("ree.attach_positions", "an escape is not strictly inside its run")
    at = np.concatenate([starts[:k][first], inside, ends[:k][last] - 1])
    rank = np.concatenate([np.zeros(first.sum()), np.ones(len(inside)), np.full(last.sum(), 2)])
    at = at[np.lexsort((rank, at))]
    if len(at) != count:
        raise Fault("ree.attach_count", f"{count} declared, {len(at)} named")
    steps = read_planes(c, count, strict)
    steps[1:] = unzigzag(steps[1:])
    values = np.cumsum(steps)
    if len(values) and (values.min() < 0 or values.max() > 255):
        raise Fault("ree.attach_count", "an overlay value is no byte")
    if strict:
        _right_side(core, at, values, "ree.attach_threshold")
    if len(at) > 1 and (np.diff(at) == 0).any():  # a single pixel named twice: the later value stands
        keep = np.append(np.diff(at) > 0, True)
        at, values = at[keep], values[keep]
    return with_edges(core, at, values.astype(np.uint8), pixels)
