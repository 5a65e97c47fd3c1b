import hashlib

from pyspark.sql import functions as F

from lamina.functions.binary import u32, u64
from lamina.functions.register import register
from lamina.operators.compare import differences
from lamina.operators.validate import validate
from lamina.sources import datasource
from lamina.sources import format as X
from lamina.sources.directory import descriptors, framing_report, headers
from lamina.sources.encode import pays
from lamina.sources.prints import PrintFiles

from .test_validate import VALID, build, descriptor, drop, job, raw_edit, rebuilt, seal, twice


def test_native_framing_is_the_validator_s(spark):
    good = build(job(**VALID["extras"]))
    cases = {
        "good": good,
        "version": seal(raw_edit(4, b"\2")(good)[:-8]),
        "dir": seal(raw_edit(8, (5).to_bytes(8, "little"))(good)[:-8]),
        "total": seal(raw_edit(24, b"\5")(good)[:-8]),
        "extent": seal(descriptor(good, 4, (8).to_bytes(8, "little"))[:-8]),
        "overlap": seal(descriptor(good, 4, (40).to_bytes(8, "little"))[:-8]),
        "huge": seal(descriptor(good, 4, b"\xff" * 8)[:-8]),
        "flags": rebuilt(good, lambda c: 1 << 4),
        "no head": rebuilt(good, drop("HEAD")),
        "two tables": rebuilt(good, twice("LTBL")),
        "sealed": rebuilt(good, lambda c: setattr(c[1], "flags", 16)),
    }
    files = spark.createDataFrame(list(cases.items()), "path string, content binary")
    names = {"header.version", "header.dir_offset", "header.total_uncompressed_size", "dir.chunk_extent", "dir.overlap", "header.flags_reserved", "presence.head", "dir.head_first", "presence.ltbl", "crypt.chunk_flags"}
    mine = {(r["file_id"], r["check"]) for r in framing_report(files).collect()}
    other = {(r["file_id"], r["check"]) for r in validate(files).collect() if r["check"] in names}
    assert other - mine == set() and {f for f, _ in mine - other} <= {"version", "extent", "huge"}  # the validator stops there
    assert headers(files).filter("file_id = 'good'").first()["magic"] == "LUMN"
    a = [(r["dir_index"], r["chunk_type"], int(r["offset"])) for r in descriptors(files).filter("file_id = 'good'").orderBy("dir_index").collect()]
    assert a == [(c.index, c.kind, c.offset) for c in X.parse_directory(good, X.parse_header(good))]


def test_unsigned_numbers(spark):
    d = spark.createDataFrame([(b"\xff" * 12,), (b"\1\0\0\0\2" + b"\0" * 7,)], "b binary").select(u32(F.col("b"), 0).alias("a"), u64(F.col("b"), 4).alias("c"))
    assert [(r["a"], int(r["c"])) for r in d.collect()] == [(4294967295, 2**64 - 1), (1, 2)]


def test_registered_functions(spark):
    register(spark)
    row = spark.sql("SELECT crc32c(encode('123456789', 'UTF-8')) AS c, varint_decode(varint_encode(2073600L)) AS v, octet_length(varint_encode(128L)) AS n, varint_decode(X'8000') AS bad, decode(zstd_decompress(zstd_compress(encode('hello', 'UTF-8'), 3), 100), 'UTF-8') AS z, zstd_decompress(X'00', 10) AS damaged").first()
    assert (row["c"], row["v"], row["n"], row["bad"], row["z"], row["damaged"]) == (0xE3069283, 2073600, 2, None, "hello", None)
    assert spark.sql("SELECT hex(shake256(X'', 16)) AS h, shake256(X'00', -1) AS none").first()[:] == ("46B9DD2B0BA88D13233B3FEB743EEB24", None)  # the standard's empty message
    runs = spark.sql("SELECT * FROM ree_decode(X'01020007' || X'0100000003', 12)").collect()
    assert [(r["start"], r["end"], r["value"]) for r in runs] == [(0, 3, 0), (3, 12, 7)]
    leaves = [X.leaf(bytes([i])) for i in range(5)]
    d = spark.createDataFrame([(i, h) for i, h in enumerate(leaves)], "i int, h binary").repartition(3)
    d.createOrReplaceTempView("leaves")
    root = spark.sql("SELECT merkle_root(concat(unhex(lpad(hex(i), 8, '0')), h)) AS r FROM leaves").first()["r"]
    assert bytes(root) == X.merkle_root(leaves)


def test_data_source(spark, tmp_path):
    for name in ("overrides", "extras"):
        (tmp_path / f"{name}.bin").write_bytes(build(job(**VALID[name])))
    datasource.register(spark)
    read = lambda view, path=tmp_path: spark.read.format("prints").option("view", view).load(str(path))
    assert read("heads").count() == 2 and read("chunks", tmp_path / "extras.bin").filter("chunk_type = 'EXTD'").count() == 1
    want = PrintFiles.load(spark, str(tmp_path / "*.bin")).runs()
    key = lambda r: (r["file_id"].rpartition("/")[2], *r[1:])
    assert sorted(map(key, read("runs", tmp_path / "*.bin").collect())) == sorted(map(key, want.collect()))
    one = read("runs").filter("layer = 3")
    assert sorted(map(key, one.collect())) == sorted(map(key, want.filter("layer = 3").collect()))


def test_ranges_read_only_what_a_view_needs():
    spans = [{0: [(k, k + 40, 255)], 1: [(500 + k, 900, 90)]} for k in range(12)]
    data = build(job(spans, per_chunk=3, scene=b"scene" * 1000))
    asked = []

    def at(offset, length):
        asked.append((offset, length))
        return data[offset : offset + length]

    p = X.read_ranges(at, len(data))
    before = len(asked)
    whole = X.read(data)
    assert [p.layer_data(k) for k in range(12)] == [whole.layer_data(k) for k in range(12)]
    layers = [c for c in whole.chunks if c.kind == "LAYR"]
    assert len(asked) - before == len(layers) == 8  # each once, though layers take turns between two sectors' chunks
    assert not any(o == c.offset for c in whole.chunks if c.kind == "VOXL" for o, _ in asked)
    assert len(p.kept) == 2


def test_verified_layer_by_layer(spark, tmp_path):
    good = build(job())
    (tmp_path / "good.bin").write_bytes(good)
    c = next(c for c in X.parse_directory(good, X.parse_header(good)) if c.kind == "LAYR")
    at = c.offset + c.stored - 2
    (tmp_path / "hurt.bin").write_bytes(good[:at] + bytes([good[at] ^ 255]) + good[at + 1 :])
    datasource.register(spark)
    found = {(r["file_id"].rpartition("/")[2], r["layer"]): r["matches"] for r in spark.read.format("prints").option("view", "verified").load(str(tmp_path / "*.bin")).collect()}
    assert all(found["good.bin", k] for k in range(4))
    assert not (found["hurt.bin", 0] and found["hurt.bin", 1]) and found["hurt.bin", 2] and found["hurt.bin", 3]  # the first chunk holds two layers
    (tmp_path / "good.bin").write_bytes(build(job(hashes=False)))
    assert spark.read.format("prints").option("view", "verified").load(str(tmp_path / "good.bin")).filter("matches is null").count() == 4


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5), (3, "z", 6)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 7), (4, "z", 6)], "k int, s string, n int")
    assert sorted((r["k"], r["field"], r["expected"], r["found"]) for r in differences(a, b, ["k"]).collect()) == [(2, "n", "5", "7"), (3, "missing", None, None), (4, "extra", None, None)]


def test_dictionary_pays_on_small_prints_and_by_the_probe():
    assert pays([b"x" * 1000], b"d" * 100, 6)
    noise = [hashlib.shake_256(bytes([i])).digest(3 << 20) for i in range(3)]
    assert not pays(noise, b"d" * 100000, 1)
