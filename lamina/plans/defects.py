"""Container files with one planted defect each, and the rule that must name it first."""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np

from ..functions import keys as K
from ..operators import rules as RU
from ..operators.previews import png
from ..operators.validate import failures
from ..sources import format as X
from ..sources.codec import ATTACHED, GRAY, SPLIT, runs_of_spans, varint, write_planes
from ..sources.encode import Print, build
from ..sources.sealing import seal_file

META = {"meta_version": 1, "normal_exposure_ms": 2500, "bottom_exposure_ms": 30000, "bottom_layer_count": 2, "transition_layer_count": 1, "layer_height_um": 50, "lift_slow_distance_um": 5000, "lift_slow_speed_um_min": 65000, "retract_fast_distance_um": 5000, "retract_fast_speed_um_min": 150000}

PX = 64 * 48


def job(spans=None, **more):
    """spans: for each layer, sector -> spans."""
    spans = spans if spans is not None else [{0: [(0, 100, 255), (200, 300, 255)], 1: [(100, 200, 255)]}, {0: [(0, 64, 255)]}, {}, {0: [(500, 600, 255)], 1: [(600, 660, 128)]}]
    layers = [{s: runs_of_spans(x, PX) for s, x in layer.items()} for layer in spans]
    head = X.Head("test", 1, 64, 48, 100, 100, 100, 50, len(layers))
    meta = {**META, "materials": [{"name": "m"}], "sectors": [{"sector_id": 1, "material_index": 0, "normal_exposure_ms": 2800}]}
    return Print(head, more.pop("meta", meta), layers, per_chunk=more.pop("per_chunk", 2), **more)


def first(data, strict=True):
    found = [f for f in failures(data) if strict or f[0] not in RU.STRICT]
    return found[0][0] if found else None


VALID = {
    "sectors": {},
    "overrides": {"overrides": {(0, 1): {"normal_exposure_ms": 2800}, (1, 0): {"lift_slow_distance_um": 6000}, (3, 0): {"lift_slow_distance_um": 6000}}},
    "profile": {"profile": {"profile_type": "material", "profile_name": "n", "profile_version": "1", "profile_uuid": "12345678-1234-1234-1234-1234567890ab", "settings": META}},
    "extras": {"previews": [(1, png(np.zeros((4, 5), np.uint8)))], "extensions": [(0x1234, False, b"DRNF", b"x")], "scene": b"VOXL..."},
    "bare": {"hashes": False, "dictionary": False, "probe": False},
    "tags": {"tags": {(0, 0): ATTACHED, (3, 1): SPLIT}},
    "three": {"spans": [{0: [(0, 9, 255)], 3: [(9, 20, 255)], 5: [(20, 30, 255)]}, {}, {}, {}], "hashes": False, "dictionary": False},
}


def rebuilt(data, change):
    """The file again after a change to its chunks (a list), with a right directory and checksum."""
    p = X.parse_directory(data, X.parse_header(data))
    flags = change(p)
    return X.assemble(p, X.parse_header(data).flags if flags is None else flags)


def payload(kind, edit, at=0):
    def change(chunks):
        c = [x for x in chunks if x.kind == kind][at]
        raw = X.payload_of(c)
        new = edit(raw)
        if kind in X.COMPRESSED:
            frame = X.zstd(new, 3)
            c.payload, c.size, c.compressed = frame, len(new), len(frame)
        else:
            c.payload, c.size = new, len(new)
            c.compressed = c.compressed and len(new)

    return change


def meta(**change):
    def edit(raw):
        found = json.loads(raw)
        found.update(change)
        return json.dumps({k: v for k, v in found.items() if v != "gone"}).encode()

    return payload("META", edit)


def profile(settings=None, **change):
    def edit(raw):
        found = {**json.loads(raw), **change}
        found["settings"] = {**found["settings"], **(settings or {})}
        return json.dumps(found).encode()

    return payload("PROF", edit)


def put(at, value, form="<I"):
    return lambda raw: raw[:at] + struct.pack(form, value) + raw[at + struct.calcsize(form) :]


def entry(i, field, value):
    return payload("LTBL", put(16 + 28 * i + {"size": 0, "lrov": 4, "layr": 8, "more": 12, "offset": 16, "sector": 24}[field], value, "<Q" if field == "offset" else "<I"))


def flags(kind, value, at=0):
    def change(chunks):
        [x for x in chunks if x.kind == kind][at].flags = value

    return change


def drop(kind):
    def change(chunks):
        chunks[:] = [c for c in chunks if c.kind != kind]

    return change


def twice(kind):
    def change(chunks):
        chunks.append(next(c for c in chunks if c.kind == kind))

    return change


def auth(**change):
    def edit(chunks):
        a = X.Auth("A256", 1, b"s" * 16 + struct.pack("<IIB", 3, 65536, 1) + b"k" * 40)
        for k, v in change.items():
            setattr(a, k, v)
        for c in chunks:
            if c.kind in X.CONTENT:
                c.flags |= X.SEALED
        raw = a.to_bytes()
        chunks.append(X.plain_chunk("AUTH", raw[: change.get("cut", len(raw))]))
        return X.ENCRYPTED | X.MULTI_SECTOR

    return edit


DEFECTS = [
    ("presence.head", drop("HEAD"), "sectors"),
    ("dir.head_first", lambda c: c.insert(0, c.pop()), "sectors"),
    ("presence.meta", drop("META"), "sectors"),
    ("presence.ltbl", drop("LTBL"), "sectors"),
    ("presence.ltbl", twice("LTBL"), "sectors"),
    ("presence.layr", drop("LAYR"), "sectors"),
    ("presence.auth", lambda c: X.ENCRYPTED, "bare"),
    ("header.flags_reserved", lambda c: X.MULTI_SECTOR | 1, "sectors"),
    ("head.multi_sector_flag", lambda c: 0, "sectors"),
    ("crypt.chunk_flags", flags("META", X.SEALED), "sectors"),
    ("head.version", payload("HEAD", put(0, 2)), "sectors"),
    ("head.frame", payload("HEAD", lambda r: r + b"x"), "sectors"),
    ("head.total_layers", payload("HEAD", put(44, 0)), "sectors"),
    ("head.layer_height", payload("HEAD", put(40, 0)), "sectors"),
    ("head.build_dims", payload("HEAD", put(32, 0)), "sectors"),
    ("head.display_pixels", payload("HEAD", put(20, 0)), "bare"),
    ("ltbl.layer_count", payload("HEAD", put(44, 9)), "bare"),
    ("meta.json", payload("META", lambda r: b"[1]"), "sectors"),
    ("meta.json", payload("META", lambda r: b"{"), "sectors"),
    ("meta.required_fields", meta(lift_slow_distance_um="gone"), "sectors"),
    ("meta.version", meta(meta_version=2), "sectors"),
    ("meta.time_integer", meta(normal_exposure_ms=2500.5), "sectors"),
    ("meta.time_integer", meta(sectors=[{"sector_id": 1, "bottom_exposure_ms": 1.5}]), "sectors"),
    ("meta.exposure", meta(normal_exposure_ms=0), "sectors"),
    ("meta.layer_height", meta(layer_height_um=0), "sectors"),
    ("meta.materials_shape", meta(materials=[], sectors=[]), "sectors"),
    ("meta.sectors_shape", meta(sectors=[{"sector_id": 1}, {"sector_id": 1}]), "sectors"),
    ("meta.sectors_shape", meta(sectors=[{"sector_id": 0}]), "sectors"),
    ("meta.sector_material_index", meta(sectors=[{"sector_id": 1, "material_index": 7}]), "sectors"),
    ("meta.sector_material_index", meta(materials="gone"), "sectors"),
    ("meta.cure_curve", meta(cure_curve={"dp_um": 0, "ec_mj_cm2": 1, "e0_mj_cm2": 0}), "sectors"),
    ("meta.temperature_range", meta(vat_temperature_c=121), "sectors"),
    ("pwm.range", meta(light_pwm=256), "sectors"),
    ("prof.profile_type", profile(profile_type="x"), "profile"),
    ("prof.profile_identity", profile(profile_name=""), "profile"),
    ("prof.settings_time_integer", profile({"normal_exposure_ms": 1.5}), "profile"),
    ("prof.settings_exposure", profile({"normal_exposure_ms": 0}), "profile"),
    ("prof.settings_layer_height", profile({"layer_height_um": 0}), "profile"),
    ("prof.cure_curve", profile({"cure_curve": {"dp_um": 1, "ec_mj_cm2": 0, "e0_mj_cm2": 0}}), "profile"),
    ("prof.profile_uuid", profile(profile_uuid="12345678-1234-1234-1234-1234567890aG"), "profile"),
    ("prof.materials_shape", profile(materials=[{"name": ""}]), "profile"),
    ("lrov.json", payload("LROV", lambda r: b"3"), "overrides"),
    ("lrov.time_integer", payload("LROV", lambda r: b'{"normal_exposure_ms":2.5}'), "overrides"),
    ("ltbl.first_lrov_null", entry(1, "lrov", 0), "overrides"),
    ("prev.flags", flags("PREV", 4), "extras"),
    ("prev.flags", flags("PREV", 1 << 9), "extras"),
    ("prev.png_signature", payload("PREV", lambda r: b"GIF89a" + r[6:]), "extras"),
    ("voxl.signature", payload("VOXL", lambda r: b"nope"), "extras"),
    ("extd.frame", payload("EXTD", lambda r: r[:7]), "extras"),
    ("extd.ext_type", payload("EXTD", lambda r: r[:4] + b"\xff" + r[5:]), "extras"),
    ("extd.flags", flags("EXTD", 1 << 26), "extras"),
    ("extd.critical", flags("EXTD", 1 << 24), "extras"),
    ("ltbl.version", payload("LTBL", put(0, 2)), "sectors"),
    ("ltbl.entry_size", payload("LTBL", put(8, 24)), "sectors"),
    ("ltbl.entry_count", payload("LTBL", lambda r: r + b"\0" * 28), "sectors"),
    ("ltbl.entry_count", entry(1, "more", 1), "sectors"),
    ("ltbl.layer_index_range", payload("LTBL", put(4, 5)), "sectors"),
    ("ltbl.first_entry_is_sector_zero", entry(2, "sector", 3), "bare"),
    ("ltbl.sector_id_unique", entry(1, "sector", 0), "bare"),
    ("ltbl.first_layr_in_range", entry(0, "layr", 0), "bare"),
    ("ltbl.first_lrov_in_range", entry(0, "lrov", 1), "bare"),
    ("ltbl.offset_within_chunk", entry(0, "offset", 1 << 20), "bare"),
    ("ltbl.slices_disjoint", entry(2, "offset", 0), "bare"),
    ("layr.version", payload("LAYR", put(0, 2)), "bare"),
    ("layr.content_size_present", payload("LAYR", lambda r: r[:4] + b"junk"), "bare"),
    ("layr.frame_decompressed_size", payload("LAYR", lambda r: r[:-3]), "bare"),
    ("frame.allocation_bound", payload("LAYR", lambda r: r[:4] + X.zstd(bytes(200000), 3)), "bare"),
    ("presence.zdic", lambda c: c.append(X.plain_chunk("ZDIC", X.dictionary_bytes(b"d" * 64, 9))), "bare"),
    ("zdic.version", lambda c: c.append(X.plain_chunk("ZDIC", b"\2" + b"\0" * 11)), "bare"),
    ("zdic.dict_size", lambda c: c.append(X.plain_chunk("ZDIC", struct.pack("<III", 1, 1, 200000))), "bare"),
    ("lhas.frame", payload("LHAS", lambda r: r[:-1]), "sectors"),
    ("lhas.hash_algorithm", payload("LHAS", lambda r: b"\2" + r[1:]), "sectors"),
    ("lhas.layer_count", payload("LHAS", put(2, 3)), "sectors"),
    ("lhas.root_recompute", payload("LHAS", lambda r: r[:6] + bytes([r[6] ^ 1]) + r[7:]), "sectors"),
    ("auth.version", auth(version=2), "bare"),
    ("auth.cipher_known", auth(cipher="NONE"), "bare"),
    ("auth.frame", auth(cut=19), "bare"),
    ("crypt.mode_empty", auth(mode=0), "bare"),
    ("crypt.password_section_len", auth(password=b"x" * 64), "bare"),
    ("crypt.machine_section_len", auth(mode=2, machine=b"x" * 105), "bare"),
    ("crypt.argon2_budget", auth(password=b"s" * 16 + struct.pack("<IIB", 11, 65536, 1) + b"k" * 40), "bare"),
    ("crypt.recipient_entry", auth(mode=2, machine=bytes(104)), "bare"),
]


def raw_edit(at, value):
    return lambda d: d[:at] + value + d[at + len(value) :]


def seal(body):
    return body + X.TRAILER + struct.pack("<I", X.crc32c(body))


def descriptor(d, field, value):
    return raw_edit(X.parse_header(d).dir_offset + 32 + field, value)(d)


FRAMING = [
    ("trailer.magic", lambda d: d[:-8] + b"X" + d[-7:]),
    ("trailer.magic", lambda d: d[:5]),
    ("trailer.crc32c", raw_edit(50, b"\xee")),
    ("header.magic", lambda d: seal(b"X" + d[1:-8])),
    ("header.version", lambda d: seal(raw_edit(4, b"\2")(d)[:-8])),
    ("header.dir_offset", lambda d: seal(raw_edit(8, struct.pack("<Q", 5))(d)[:-8])),
    ("header.total_uncompressed_size", lambda d: seal(raw_edit(24, struct.pack("<Q", 5))(d)[:-8])),
    ("dir.chunk_extent", lambda d: seal(descriptor(d, 4, struct.pack("<Q", 8))[:-8])),
    ("dir.overlap", lambda d: seal(descriptor(d, 4, struct.pack("<Q", 40))[:-8])),
]


def unnamed_override(chunks):
    """An override that no entry names, equal to one that is named."""
    chunks.append(next(c for c in chunks if c.kind == "LROV"))


def dictionary(number, frame_number=None):
    """The first frame compressed with one dictionary, and a ZDIC chunk with that number, or none."""
    import zstandard

    def change(chunks):
        words = [bytes([i, i + 1, i + 2]) * 20 for i in range(200)]
        trained = zstandard.train_dictionary(512, words, dict_id=frame_number or 9).as_bytes()
        chunk = next(c for c in chunks if c.kind == "LAYR")
        new = X.layer_chunk(X.zstd(X.unzstd(chunk.payload[4:], 10**6), 3, trained))
        chunk.payload, chunk.size, chunk.compressed = new.payload, new.size, new.compressed
        if number:
            chunks.append(X.plain_chunk("ZDIC", X.dictionary_bytes(trained, number)))

    return change


DEFECTS += [
    ("lrov.orphan", unnamed_override, "overrides"),
    ("ltbl.sector_ids_ascending", entry(0, "sector", 9), "three"),
    ("layr.dict_id_absent", dictionary(0), "bare"),
    ("layr.dict_id_match", dictionary(8, 9), "bare"),
    ("zdic.single", lambda c: [c.append(X.plain_chunk("ZDIC", X.dictionary_bytes(b"d" * 64, 9))) for _ in range(2)] and None, "bare"),
]


def stream_file(stream):
    """A file of one layer whose only slice has these bytes."""

    def change(chunks):
        chunk = next(c for c in chunks if c.kind == "LAYR")
        new = X.layer_chunk(X.zstd(stream, 3))
        chunk.payload, chunk.size, chunk.compressed = new.payload, new.size, new.compressed
        entry(0, "size", len(stream))(chunks)

    return rebuilt(build(job([{0: [(0, 9, 255)]}], hashes=False, dictionary=False)), change)


def _planes(*values):
    return write_planes(np.array(values, np.int64))


def _attached(count, flags, inside=(), values=()):
    """An attached stream over one black run."""
    return b"\3\0" + varint(1) + _planes() + _planes() + varint(count) + bytes([flags]) + varint(len(inside)) + _planes(*inside) + _planes(*values)


#: Streams of a layer of PX pixels.
STREAMS = [
    ("ree.tag", b"\7\0"),
    ("ree.varint", b"\0\0\x80"),
    ("ree.varint", b"\0\0\x80\0"),
    ("ree.planes", b"\0\xff" + varint(2) + bytes([2, 0, 0, 0, 5, 5])),
    ("ree.first_value", b"\0\7" + varint(1) + _planes()),
    ("ree.no_run_count_zero", b"\0\0\0"),
    ("ree.run_lengths", b"\0\xff" + varint(4000)),
    ("ree.grayscale_runs", b"\1" + varint(2) + b"\7\7" + _planes(5)),
    ("ree.grayscale_all_binary", b"\1" + varint(2) + b"\xff\0" + _planes(5)),
    ("ree.split_all_binary", b"\2\xff" + varint(2) + _planes(5) + varint(0) + _planes()),
    ("ree.split_threshold", b"\2\0" + varint(1) + _planes() + varint(1) + _planes(5) + b"\xc8"),
    ("ree.split_positions", b"\2\0" + varint(1) + _planes() + varint(1) + _planes(4000) + b"\5"),
    ("ree.attach_positions", _attached(1, 0, (0,), (5,))),
    ("ree.attach_count", _attached(1, 0, (), (5,))),
    ("ree.attach_bits", _attached(0, 4)),
    ("ree.attach_threshold", _attached(1, 1, (), (200,))),
    ("ree.end_positions", b"\0\xff" + varint(2) + _planes(4000)),
    ("ree.no_trailing_bytes", b"\0\xff" + varint(2) + _planes(5) + b"\0"),
]

LABEL = b"test binding\0"
SESSION, SECRET = hashlib.sha256(b"s").digest(), hashlib.sha256(b"m").digest()


def sealed_file():
    """Encrypted for the password "geheim" and for the machine with SECRET."""
    password = K.password_section("geheim", SESSION, b"s" * 16, 1, 32, 1)
    recipients = K.machine_entry(K.x25519(SECRET), SESSION, b"f" * 32, LABEL)
    return seal_file(build(job(**VALID["overrides"])), X.Auth("A256", 3, password, recipients), SESSION, lambda i: struct.pack("<QI", 99, i))


def _moved(chunks):
    """A layer's unit sealed for the first place."""
    one = next(c for c in chunks if c.kind == "LAYR")
    one.payload = one.payload[:4] + K.seal("A256", SESSION, b"n" * 12, b"x" * 40, "LAYR", 0)
    one.compressed = len(one.payload)


def _low_order(chunks):
    """The machine's entry with a sender's key that gives no shared secret."""
    a = next(c for c in chunks if c.kind == "AUTH")
    at = a.payload.index(hashlib.sha256(K.x25519(SECRET)).digest()) + 32
    a.payload = a.payload[:at] + b"\1" + bytes(31) + a.payload[at + 32 :]


def key_cases():
    """(check, bytes, password, secret): what a report says where keys are given."""
    f = sealed_file()
    return [
        (None, f, "geheim", None),
        (None, f, None, SECRET),
        ("crypt.key_unwrap", f, "falsch", None),
        ("crypt.no_key", f, None, b"x" * 32),
        ("crypt.no_key", f, None, None),
        ("crypt.low_order_point", rebuilt(f, _low_order), None, SECRET),
        ("crypt.unit_index_binding", rebuilt(f, _moved), "geheim", None),
        ("crypt.tag_verify", rebuilt(f, flip_last("META")), "geheim", None),
    ]


def flip_last(kind):
    def change(chunks):
        c = next(x for x in chunks if x.kind == kind)
        c.payload = c.payload[:-1] + bytes([c.payload[-1] ^ 1])

    return change


def planted(group: str) -> list[tuple[str, str, bytes]]:
    """(case, the rule that it breaks first, the file) of a group of rules: framing, chunks or streams."""
    if group == "framing":
        found = [(c, edit(build(job()))) for c, edit in FRAMING] + [(c, rebuilt(build(job(**VALID[base])), change)) for c, change, base in DEFECTS if c.startswith(FRAMED)]
    elif group == "streams":
        found = [(c, stream_file(s)) for c, s in STREAMS]
        found += [("sector.partition", build(job([{0: [(0, 100, 255)], 1: [(99, 120, 255)]}], hashes=False)))]
        found += [("lhas.leaf_match", rebuilt(build(job()), payload("LHAS", lambda r: X.hashes_bytes([b"\1" * 32, *X.parse_hashes(r)[2][1:]]))))]
    else:
        found = [(c, rebuilt(build(job(**VALID[base])), change)) for c, change, base in DEFECTS if not c.startswith(FRAMED)]
    return [(f"{group} {i}", c, data) for i, (c, data) in enumerate(found)]


FRAMED = ("presence", "dir.", "header.", "crypt.chunk")
