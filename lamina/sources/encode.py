"""Files from layers: tag choice, layer groups, dictionary, frames, shared overrides, layout."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np

from . import format as X
from .codec import ATTACHED, Fault, encode


@dataclass
class Print:
    """layers: for each layer, sector -> runs.  tags: forced tags by (layer, sector).

    overrides: by (layer, sector), or a list of (layer, sector, settings), in which a pair may come only once.
    """

    head: X.Head
    meta: dict
    layers: list[dict[int, tuple[np.ndarray, np.ndarray]]]
    tags: dict[tuple[int, int], int] = field(default_factory=dict)
    overrides: dict[tuple[int, int], dict] | list[tuple[int, int, dict]] = field(default_factory=dict)
    profile: dict | None = None
    previews: list[tuple[int, bytes]] = field(default_factory=list)
    extensions: list[tuple[int, bool, bytes, bytes]] = field(default_factory=list)  # vendor, critical, type, data
    scene: bytes | None = None
    per_chunk: int = 64
    level: int = 6
    probe: bool = True
    dictionary: bool = True
    hashes: bool = True
    share_overrides: bool = True

    def __post_init__(self):
        if not isinstance(self.overrides, dict):
            pairs = [(layer, sector) for layer, sector, _ in self.overrides]
            twice = sorted({at for at in pairs if pairs.count(at) > 1}) if len(set(pairs)) < len(pairs) else []
            if twice:
                raise Fault("lrov.orphan", f"two sets of overrides for layer and sector {twice[0]}")
            self.overrides = {(layer, sector): settings for layer, sector, settings in self.overrides}


#: Windows that a dictionary is trained on. Fixed value.
WINDOWS = 256


def windows_of(part: bytes, size: int = 1024) -> list[bytes]:
    return [part[i : i + size] for i in range(0, len(part), size) if len(part) - i >= 8]


def sample_windows(parts: list[bytes], size: int = 1024, most: int = WINDOWS) -> list[bytes]:
    """At most `most` windows at equal steps over all plaintext."""
    windows = [w for p in parts for w in windows_of(p, size)]
    return windows[:: max(1, -(-len(windows) // most))]


#: Plaintext below which a trained dictionary always stands, bytes of the probe, and the gain it must show. Fixed values.
SMALL_PRINT, PROBE_BYTES, PROBE_GAIN = 8 << 20, 4 << 20, 0.002


def probe_of(parts: list[bytes]) -> bytes:
    """Starts of the first, middle and last chunk."""
    return b"".join(parts[i][: PROBE_BYTES // 3] for i in (0, (len(parts) - 1) // 2, len(parts) - 1)) if parts else b""


def pays(parts: list[bytes], dictionary: bytes, level: int) -> bool:
    return saves(probe_of(parts), sum(map(len, parts)), dictionary, level)


def saves(probe: bytes, total: int, dictionary: bytes, level: int) -> bool:
    """Whether a probe of a print of `total` bytes shrinks by more than the dictionary's share of it."""
    if total < SMALL_PRINT or not probe:
        return True
    share = len(dictionary) * len(probe) / total
    return len(X.zstd(probe, level, dictionary)) + share < len(X.zstd(probe, level)) * (1 - PROBE_GAIN)


def train(parts: list[bytes], level: int = 6) -> bytes | None:
    return train_on(sample_windows(parts), probe_of(parts), sum(map(len, parts)), level)


def train_on(samples: list[bytes], probe: bytes, total: int, level: int = 6) -> bytes | None:
    """A dictionary from windows over the whole print, where training succeeds and it pays."""
    import zstandard

    if len(samples) < 8:
        return None
    try:
        trained = zstandard.train_dictionary(min(X.DICT_MOST, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return None
    return trained if saves(probe, total, trained, level) else None


def encode_layers(layers: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]], sectors: dict[int, list[int]], pixels: int, probe: bool = True, tags: dict[tuple[int, int], int] | None = None) -> tuple[dict, dict]:
    """By (layer, sector) the stream of the primary form, and that of the attached form where the probe asks for it."""
    first: dict[tuple[int, int], bytes] = {}
    second: dict[tuple[int, int], bytes] = {}
    for k, layer in layers.items():
        for s in sectors[k]:
            runs, tag = layer.get(s), (tags or {}).get((k, s))
            first[k, s] = encode(runs, pixels, tag) if runs is not None else b""
            second[k, s] = encode(runs, pixels, ATTACHED) if probe and tag is None and first[k, s] else first[k, s]
    return first, second


def choose_frame(first: list[bytes], second: list[bytes], level: int, dictionary: bytes | None) -> tuple[bytes, list[bytes]]:
    """The smaller frame of a chunk's two forms, and its streams; a tie keeps the primary one."""
    frame = X.zstd(b"".join(first), level, dictionary)
    if first != second:
        other = X.zstd(b"".join(second), level, dictionary)
        if len(other) < len(frame):
            return other, second
    return frame, first


def build(job: Print) -> bytes:
    """The file's bytes: a pure function of the job."""
    pixels = job.head.width * job.head.height
    if job.head.total_layers != len(job.layers):
        raise Fault("head.total_layers", f"{len(job.layers)} layers pushed")
    for at in job.overrides:
        if not 0 <= at[0] < len(job.layers):
            raise Fault("lrov.orphan", str(at))
    sectors = {k: sorted({0, *layer, *(s for i, s in job.overrides if i == k)}) for k, layer in enumerate(job.layers)}
    first, second = encode_layers(dict(enumerate(job.layers)), sectors, pixels, job.probe, job.tags)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, s in sorted(first):
        groups.setdefault((k // job.per_chunk, s), []).append(k)
    groups = {g: ks for g, ks in sorted(groups.items()) if any(first[k, g[1]] for k in ks)}
    dictionary = train([b"".join(first[k, g[1]] for k in ks) for g, ks in groups.items()], job.level) if job.dictionary else None
    frames, chosen = {}, dict(first)
    for g, ks in groups.items():
        frames[g], streams = choose_frame([first[k, g[1]] for k in ks], [second[k, g[1]] for k in ks], job.level, dictionary)
        chosen |= {(k, g[1]): x for k, x in zip(ks, streams)}
    leaves = [X.leaf(b"".join(chosen[k, s] for s in sectors[k])) for k in range(len(job.layers))]
    return lay_out(job, sectors, frames, {at: len(x) for at, x in chosen.items()}, leaves, dictionary)


def lay_out(job: Print, sectors: dict[int, list[int]], frames: dict[tuple[int, int], bytes], sizes: dict[tuple[int, int], int], leaves: list[bytes], dictionary: bytes | None = None) -> bytes:
    """The file from its frames by (layer group, sector) and the bytes of each (layer, sector); job.layers aren't read."""
    frames = frames or {(0, 0): X.zstd(b"", job.level, dictionary)}
    chunks = [X.plain_chunk("HEAD", job.head.to_bytes()), X.json_chunk("META", job.meta)]
    if job.profile is not None:
        chunks.append(X.json_chunk("PROF", job.profile))
    placed: dict[tuple[int, int], int] = {}
    shared: dict[str, int] = {}
    for at in sorted(job.overrides):
        text = json.dumps(job.overrides[at], sort_keys=True)
        if text not in shared or not job.share_overrides:
            shared[text] = len(chunks)
            chunks.append(X.json_chunk("LROV", job.overrides[at]))
        placed[at] = shared[text]
    if dictionary is not None:
        import zstandard

        chunks.append(X.plain_chunk("ZDIC", X.dictionary_bytes(dictionary, zstandard.ZstdCompressionDict(dictionary).dict_id())))
    chunks += [X.plain_chunk("PREV", image, role) for role, image in job.previews]
    if job.scene is not None:
        frame = X.zstd(job.scene, 3)
        chunks.append(X.Chunk("VOXL", frame, len(job.scene), len(frame)))
    at_table = len(chunks)
    home = {g: at_table + 1 + job.hashes + i for i, g in enumerate(frames)}
    entries, offsets = [], dict.fromkeys(frames, 0)
    for k in range(job.head.total_layers):
        own = [home[k // job.per_chunk, s] for s in sectors[k] if (k // job.per_chunk, s) in home]
        for j, s in enumerate(sectors[k]):
            g = (k // job.per_chunk, s)
            size = sizes.get((k, s), 0)
            entries.append(X.Entry(size, placed.get((k, s), 0), home.get(g, (own or [next(iter(home.values()))])[0]), len(sectors[k]) - 1 if j == 0 else 0, offsets.get(g, 0), s, k))
            if g in offsets:
                offsets[g] += size
    chunks.append(X.plain_chunk("LTBL", X.table_bytes(entries, job.head.total_layers)))
    if job.hashes:
        chunks.append(X.plain_chunk("LHAS", X.hashes_bytes(leaves)))
    chunks += [X.layer_chunk(f) for f in frames.values()]
    chunks += [X.plain_chunk("EXTD", (1).to_bytes(4, "little") + kind + data, vendor << 8 | critical << 24) for vendor, critical, kind, data in job.extensions]
    return X.assemble(chunks, X.MULTI_SECTOR if any(len(s) > 1 for s in sectors.values()) else 0)
