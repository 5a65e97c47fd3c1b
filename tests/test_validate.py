"""One defect at a time, and the rule that must name it first."""

import json
import struct

import numpy as np
import pytest

from lamina.operators import rules as RU
from lamina.operators.previews import fit, pgm, png, resample
from lamina.operators.validate import failures, validate
from lamina.plans.defects import DEFECTS, FRAMING, LABEL, META, PX, STREAMS, VALID, descriptor, drop, first, job, key_cases, payload, raw_edit, rebuilt, seal, stream_file, twice  # noqa: F401
from lamina.sources import format as X
from lamina.sources.codec import BINARY, GRAY, SPLIT, Fault
from lamina.sources.encode import build, sample_windows
from lamina.sources.prints import PrintFiles, write_prints

@pytest.mark.parametrize("name", sorted(VALID))
def test_valid_files(name):
    data = build(job(**VALID[name]))
    assert failures(data) == []
    assert build(job(**VALID[name])) == data
    p = X.read(data)
    assert p.layers == 4 and p.head.width == 64


def test_shared_overrides_take_one_chunk():
    shared = X.read(build(job(**VALID["overrides"])))
    apart = X.read(build(job(**VALID["overrides"], share_overrides=False)))
    assert (len(shared.of("LROV")), len(apart.of("LROV"))) == (2, 3)


@pytest.mark.parametrize("check,change,base", DEFECTS, ids=[f"{d[0]}-{i}" for i, d in enumerate(DEFECTS)])
def test_defects(check, change, base):
    assert first(rebuilt(build(job(**VALID[base])), change)) == check


@pytest.mark.parametrize("check,edit", FRAMING, ids=[f"{d[0]}-{i}" for i, d in enumerate(FRAMING)])
def test_framing(check, edit):
    assert first(edit(build(job()))) == check


def test_leaf_match_and_partition_are_strict():
    wrong = rebuilt(build(job()), lambda c: payload("LHAS", lambda r: X.hashes_bytes([b"\1" * 32, *X.parse_hashes(r)[2][1:]]))(c))
    assert first(wrong) == "lhas.leaf_match" and first(wrong, strict=False) is None
    met = build(job([{0: [(0, 100, 255)], 1: [(99, 120, 255)]}], hashes=False))
    assert first(met) == "sector.partition" and first(met, strict=False) is None


def test_wrong_tag_is_strict():
    data = build(job([{0: [(0, 9, 255)]}], tags={(0, 0): GRAY}, hashes=False))
    assert first(data) == "ree.grayscale_all_binary" and first(data, strict=False) is None
    assert first(build(job([{0: [(0, 9, 255)]}], tags={(0, 0): SPLIT}, hashes=False))) == "ree.split_all_binary"


def test_stream_faults_are_named():
    def change(c):
        chunk = next(x for x in c if x.kind == "LAYR")
        frame = X.unzstd(chunk.payload[4:], 10**6)
        new = X.layer_chunk(X.zstd(b"\x07" + frame[1:], 3))
        chunk.payload, chunk.size, chunk.compressed = new.payload, new.size, new.compressed

    assert first(rebuilt(build(job(hashes=False, dictionary=False)), change)) == "ree.tag"


@pytest.mark.parametrize("check,stream", STREAMS, ids=[f"{d[0]}-{i}" for i, d in enumerate(STREAMS)])
def test_streams(check, stream):
    assert first(stream_file(stream)) == check


def test_keys_in_the_report():
    for check, data, password, secret in key_cases():
        found = failures(data, label=LABEL, password=password, secret=secret)
        assert (found[0][0] if found else None) == check


def test_an_override_comes_once():
    pairs = [(0, 1, {"normal_exposure_ms": 2800}), (1, 0, {"lift_slow_distance_um": 6000})]
    assert build(job(overrides=pairs)) == build(job(overrides={(a, b): c for a, b, c in pairs}))
    with pytest.raises(Fault) as e:
        job(overrides=[*pairs, (0, 1, {"normal_exposure_ms": 1})])
    assert e.value.check == "lrov.orphan"


def test_short_descriptors_are_named():
    with pytest.raises(Fault) as e:
        X.parse_descriptor(b"x" * 31, 0)
    assert e.value.check == "dir.descriptor"


def test_every_rule_of_reading_is_planted():
    named = {d[0] for d in (*DEFECTS, *FRAMING, *STREAMS)} | {c[0] for c in key_cases()} | {"sector.partition", "lhas.leaf_match", "dir.descriptor"}
    assert set(RU.RANK) - named == {"zdic.dict_id_match", "ree.data_size"}  # one is reported as layr.dict_id_match, one is of writing


def test_truncations_and_flips_never_crash():
    data = build(job(**VALID["extras"]))
    rng = np.random.default_rng(4)
    for i in range(0, len(data), 7):
        assert failures(data[:i])
        flipped = data[:i] + bytes([data[i] ^ int(rng.integers(1, 256))]) + data[i + 1 :]
        assert failures(flipped)
        assert isinstance(failures(seal(flipped[:-8])), list)


def test_crc32c():
    assert X.crc32c(b"123456789") == 0xE3069283
    data = np.random.default_rng(0).integers(0, 256, 50001).astype(np.uint8).tobytes()
    assert X.crc32c(data) == X._crc_plain(data) ^ 0xFFFFFFFF


def test_merkle_shapes():
    import hashlib

    h = lambda *p: hashlib.sha256(b"".join(p)).digest()
    a, b, c, d, e = (X.leaf(bytes([i])) for i in range(5))
    n = lambda x, y: h(b"\1", x, y)
    assert X.merkle_root([]) == h(b"\1") and X.merkle_root([a]) == a
    assert X.merkle_root([a, b, c]) == n(n(a, b), c) and X.merkle_root([a, b, c, d, e]) == n(n(n(a, b), n(c, d)), e)


def test_views_and_sink(spark, tmp_path):
    files = spark.createDataFrame([("good", build(job())), ("bad", build(job())[:-1]), ("sectors", build(job(**VALID["overrides"])))], "path string, content binary")
    found = validate(files).collect()
    assert {r["file_id"] for r in found} == {"bad"}
    (tmp_path / "one.bin").write_bytes(build(job(**VALID["extras"])))
    p = PrintFiles.load(spark, str(tmp_path / "*.bin"))
    assert [r["chunk_type"] for r in p.chunks().orderBy("dir_index").collect()][:2] == ["HEAD", "META"]
    assert p.heads().first()["total_layers"] == 4 and p.entries().count() == 6
    assert json.loads(p.objects().first()["json"])["meta_version"] == 1
    spans = p.runs(exposed=True)
    assert spans.filter("layer = 3 and sector_id = 1").first()["value"] == 128
    leaves = p.leaves().orderBy("layer").collect()
    assert X.merkle_root([bytes(r["leaf"]) for r in leaves]) == bytes(leaves[0]["root"])
    assert p.frames().count() == sum(c.kind == "LAYR" for c in X.parse_directory(build(job(**VALID["extras"])), X.parse_header(build(job(**VALID["extras"])))))
    heads = spark.createDataFrame([(r["file_id"], 64, 48, 4, json.dumps(META)) for r in p.heads().collect()], "file_id string, width int, height int, total_layers int, meta string")
    made = write_prints(spans.select("file_id", "layer", "sector_id", "start", "end", "value"), heads, per_chunk=2)
    assert validate(made).count() == 0
    again = PrintFiles(made).runs(exposed=True)
    assert sorted(map(str, again.drop("file_id").collect())) == sorted(map(str, spans.drop("file_id").collect()))


def test_previews(spark):
    from pyspark.sql import functions as F

    w, h = fit(F.lit(1600), F.lit(300))
    assert tuple(spark.range(1).select(w, h).first()) == (400, 75)
    small = resample(np.arange(12, dtype=np.uint8).reshape(3, 4), 2, 2)
    assert small.tolist() == [[1, 3], [9, 11]]
    import zlib

    assert pgm(np.array([[1, 2]], np.uint8)) == b"P5\n2 1\n255\n\x01\x02"
    raw = png(np.array([[1, 2], [3, 4]], np.uint8))
    at = raw.index(b"IDAT")
    assert zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]]) == b"\0\1\2\0\3\4"


def test_sampling_and_forms():
    assert len(sample_windows([b"x" * 1024 * 1000])) <= 256
    assert X.read(build(job([{0: [(0, 9, 255)]}], tags={(0, 0): BINARY}))).slice(X.read(build(job([{0: [(0, 9, 255)]}]))).entries[0])[0] == BINARY


def test_all_rules_are_ranked():
    assert len(RU.RANK) == len(RU.CHECKS) == 115
