import time

from lamina.operators.validate import failures
from lamina.plans.files import META
from lamina.sources.codec import encode, runs_of_spans
from lamina.sources.prints import PrintFiles
from lamina.streaming.layers import IN, assemble

from .test_validate import PX, VALID, build, job


def rows(name, layers, total):
    out = []
    for k in layers:
        out.append((name, k, 0, total, 64, 48, encode(runs_of_spans([(10 * k, 10 * k + 50, 255)], PX), PX) if k else b""))
    return out


def test_layers_in_any_order_and_gaps(spark, tmp_path):
    source = tmp_path / "in"
    batches = [rows("a", [3, 0], 4) + rows("b", [1], 3), rows("a", [2, 1, 3], 4) + rows("b", [0], 3)]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, IN).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(1.1 if i == 0 else 0)
    stream = spark.readStream.schema(IN).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = assemble(stream, META, wait_ms=3000).writeStream.format("memory").queryName("prints").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("prints").count() < 2:
            time.sleep(0.5)
        got = {r["file_id"]: r for r in spark.table("prints").collect()}
    finally:
        query.stop()
    assert got["a"]["complete"] and failures(bytes(got["a"]["content"])) == []
    assert not got["b"]["complete"] and got["b"]["missing"] == [2] and got["b"]["content"] is None


def test_print_views(spark):
    files = spark.createDataFrame([("o", build(job(**VALID["overrides"]))), ("x", build(job(**VALID["extras"]))), ("bad", b"short")], "path string, content binary")
    p = PrintFiles(files).validated(strict=True)
    assert sorted(r["path"] for r in p.files.collect()) == ["o", "x"]
    assert p.thumbnails().first()["role"] == 1 and p.extensions().first()["vendor"] == 0x1234
    mask = {r["file_id"]: bytes(r["mask"]) for r in p.layer(0).collect()}["x"]
    assert mask[:100] == b"\xff" * 100 and mask[100:200] == bytes(100) and len(mask) == PX
    assert [r["sector_id"] for r in p.layer(3, primary=False).filter("file_id = 'x'").collect()] == [0, 1]
    assert bytes(p.layer(2).first()["mask"]) == bytes(PX) and bytes(p.layer_images(0).first()["image"])[:4] == b"\x89PNG"
    got = {(r["layer"], r["sector_id"]): r for r in p.resolved().filter("file_id = 'o'").collect()}
    assert got[0, 1]["exposure_ms"] == 2800 and got[1, 0]["lift_slow_distance_um"] == 6000 and got[3, 0]["exposure_ms"] == 2500 and got[0, 0]["is_bottom"]
