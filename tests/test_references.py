"""Rules between a print's parts: the joins must find what the validator of single files finds."""

from lamina.operators.references import REFERENCES, reference_report, unknown_keys
from lamina.operators.validate import validate
from lamina.plans.defects import VALID, build, job, planted
from lamina.sources import format as X
from lamina.sources.prints import PrintFiles


def readable(data):
    try:
        return X.read(data).head is not None and all(c.payload is not None for c in X.read(data).chunks)
    except Exception:
        return False


def test_as_the_validator(spark):
    cases = [(case, data) for group in ("framing", "chunks") for case, check, data in planted(group) if check in REFERENCES and readable(data)]
    cases += [(name, build(job(**VALID[name]))) for name in VALID]
    assert len(cases) > 20
    files = spark.createDataFrame(cases, "path string, content binary")
    mine = {(r["file_id"], r["check"]) for r in reference_report(PrintFiles(files)).collect()}
    other = {(r["file_id"], r["check"]) for r in validate(files).collect() if r["check"] in REFERENCES}
    assert mine == other
    assert not any(f in VALID for f, _ in mine)


def test_unknown_keys(spark):
    o = spark.createDataFrame([("a", 1, "META", '{"x": {"y": [1, 2]}, "known": 1}'), ("b", 1, "META", '{"known": 2}'), ("c", 1, "META", "{}")], "file_id string, dir_index int, chunk_type string, json string")
    assert [(r["file_id"], r["unknown"]) for r in unknown_keys(o, ("known",)).collect()] == [("a", {"x": '{"y":[1,2]}'})]
