"""The sink of prints: its files against those that the encoder builds of one print, and its views."""

import json

import numpy as np
import pytest

from lamina.functions import keys as K
from lamina.operators.validate import validate
from lamina.plans.defects import LABEL, META, SECRET, VALID
from lamina.sources import format as X
from lamina.sources.codec import runs_of_spans
from lamina.sources.encode import Print, build, train_on, windows_of
from lamina.sources.prints import PrintFiles, seal_prints, write_prints

W, H, N = 64, 48, 30
SPANS = "file_id string, layer int, sector_id long, start long, end long, value int"
HEADS = """file_id string, width int, height int, total_layers int, meta string, encoder string, created long, build_w long, layer_height_um long, profile string,
    previews array<struct<role: int, image: binary>>, extensions array<struct<vendor: int, critical: boolean, ext_type: string, data: binary>>, scene binary"""
EXTRAS = {**VALID["extras"], **VALID["profile"]}


def lit(seed, n=N):
    """Rows (layer, sector, start, end, value); some layers have none."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        cuts = np.sort(rng.choice(W * H, 400 * (k % 5 > 0), replace=False)).tolist()
        out += [(k, i % 3 // 2, a, b, int(rng.choice([255, 255, 90]))) for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
    return out


def print_of(rows, **more):
    layers = [{} for _ in range(N)]
    for k, s, *span in rows:
        layers[k].setdefault(s, []).append(tuple(span))
    head = X.Head("own", 77, W, H, 120, 1000, 1000, 40, N)
    return Print(head, META, [{s: runs_of_spans(x, W * H) for s, x in layer.items()} for layer in layers], per_chunk=8, **more)


def tables(spark, named):
    spans = spark.createDataFrame([(name, *r) for name, rows in named.items() for r in rows], SPANS)
    extensions = [(v, c, t.decode(), d) for v, c, t, d in EXTRAS["extensions"]]
    heads = [(name, W, H, N, json.dumps(META), "own", 77, 120, 40, json.dumps(EXTRAS["profile"]), EXTRAS["previews"], extensions, EXTRAS["scene"]) for name in named]
    return spans, spark.createDataFrame(heads, HEADS)


OVERRIDES = [(0, 0, {"normal_exposure_ms": 2600}), (5, 1, {"normal_exposure_ms": 2600}), (7, 4, {"lift_slow_distance_um": 6000})]


@pytest.mark.parametrize("dictionary,hashes,level", [(True, True, 6), (False, False, 3)])
def test_the_sink_writes_what_the_encoder_builds(spark, dictionary, hashes, level):
    named = {"a": lit(1), "b": lit(2), "empty": []}
    spans, heads = tables(spark, named)
    over = spark.createDataFrame([("b", k, s, json.dumps(x)) for k, s, x in OVERRIDES], "file_id string, layer int, sector_id long, settings string")
    made = write_prints(spans, heads, per_chunk=8, overrides=over, level=level, dictionary=dictionary, hashes=hashes)
    found = {r["path"]: bytes(r["content"]) for r in made.collect()}
    for name, rows in named.items():
        want = build(print_of(rows, overrides=OVERRIDES if name == "b" else {}, dictionary=dictionary, hashes=hashes, level=level, **EXTRAS))
        assert found[name] == want
    assert dictionary == (X.read(found["a"]).dictionary is not None)


def test_a_pair_is_overridden_once(spark):
    spans, heads = tables(spark, {"a": lit(1, 3)})
    twice = spark.createDataFrame([("a", 1, 0, "{}")] * 2, "file_id string, layer int, sector_id long, settings string")
    with pytest.raises(Exception, match="lrov.orphan"):
        write_prints(spans, heads, overrides=twice).collect()
    far = spark.createDataFrame([("a", N, 0, "{}")], "file_id string, layer int, sector_id long, settings string")
    with pytest.raises(Exception, match="lrov.orphan"):
        write_prints(spans, heads, overrides=far).collect()


def test_many_windows_are_sampled_over_the_whole_print(spark):
    from lamina.sources import prints

    spans, heads = tables(spark, {"a": lit(3)})
    before, prints.WINDOWS = prints.WINDOWS, 20
    try:
        made = prints.train_dictionaries(prints._sized(spans, heads, 8)).collect()
    finally:
        prints.WINDOWS = before
    assert len(made) <= 1 and all(0 < len(r["dictionary"]) <= X.DICT_MOST for r in made)
    assert train_on([w for w in windows_of(b"x" * 7)], b"", 7) is None


def test_sealed_prints_open_again(spark):
    spans, heads = tables(spark, {"a": lit(1, 9), "b": lit(2, 9)})
    plain = write_prints(spans, heads, per_chunk=4)
    want = sorted(map(str, PrintFiles(plain).runs().collect()))
    public = K.x25519(SECRET)
    for given, opened, machines in (({"password": "geheim", "costs": (1, 32, 1)}, {"password": "geheim"}, 0), ({"machines": (public, K.x25519(b"2" * 32)), "cipher": "C20P"}, {"secret": SECRET}, 2)):
        rows = [(r["path"], bytes(r["content"])) for r in seal_prints(plain, LABEL, **given).collect()]
        p = PrintFiles(spark.createDataFrame(rows, "path string, content binary"))
        assert validate(p.files, label=LABEL, **opened).count() == 0
        assert all(r["encrypted"] for r in p.flags().collect())
        a = p.auth().filter("file_id = 'a'").first()
        assert a["by_password"] == ("password" in given) and len(a["fingerprints"]) == machines
        assert p.scenes().count() == 0 and p.previews().count() == 2
        assert sorted(map(str, p.opened(LABEL, **opened).runs().collect())) == want
    with pytest.raises(Exception, match="crypt.mode_empty"):
        seal_prints(plain, LABEL)


def test_views(spark):
    data = {"full": build(print_of(lit(1), **EXTRAS)), "bare": build(print_of(lit(2), hashes=False, dictionary=False))}
    p = PrintFiles(spark.createDataFrame(list(data.items()), "path string, content binary"))
    assert [bytes(r["scene"]) for r in p.scenes().collect()] == [EXTRAS["scene"]]
    assert [(r["file_id"], bytes(r["dictionary"])) for r in p.dictionaries().collect()] == [("full", X.read(data["full"]).dictionary)]
    stored = {r["layer"]: bytes(r["leaf"]) for r in p.hashes().collect()}
    assert stored == {r["layer"]: bytes(r["leaf"]) for r in p.leaves().filter("file_id = 'full'").collect()}
    assert {(r["file_id"], r["encrypted"], r["size"]) for r in p.flags().collect()} == {(k, False, len(v)) for k, v in data.items()}
    assert p.auth().count() == 0
    s = p.inspect().filter("file_id = 'bare'").first()
    assert (s["layers"], s["sectors"], s["overridden"]) == (N, 2, 0)
    assert s["data_bytes"] == p.inspect_layers().filter("file_id = 'bare'").agg({"data_size": "sum"}).first()[0]
