"""Container files as DataFrames, and DataFrames as container files."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ints import bits
from ..functions.keys import machine_entry, password_section
from ..operators import settings as S
from ..operators.previews import png, role_rank
from ..session import materialise
from . import format as X
from .codec import Fault, decode, mask_of_runs, runs_of_spans
from .encode import PROBE_BYTES, WINDOWS, Print, choose_frame, encode_layers, lay_out, train_on, windows_of
from .sealing import open_file, seal_file, session_key

FILES = "path string, content binary"
HEADS = "file_id string, encoder string, created long, width long, height long, build_w long, build_d long, build_h long, layer_height_um long, total_layers long"
CHUNKS = "file_id string, dir_index int, chunk_type string, offset long, size_uncompressed long, size_compressed long, flags long, payload binary"
ENTRIES = "file_id string, entry_idx int, layer int, sector_id long, data_size long, data_offset long, first_layr long, first_lrov long, additional_sector_count long"
SLICES = "file_id string, layer int, sector_id long, tag int, data binary"
RUNS = "file_id string, layer int, sector_id long, run_idx int, start long, end long, value int"
LEAVES = "file_id string, layer int, leaf binary, root binary"
JSON = "file_id string, dir_index int, chunk_type string, json string"


def _each(files: DataFrame, schema: str, rows: Callable[[str, bytes], Iterator[tuple]], most: int = 4096) -> DataFrame:
    """Runs a function over each file; rows go on in batches of at most `most`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = _parse_datatype_string(schema)

    def run(stream):
        arrow = to_arrow_schema(target)
        for batch in stream:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = []
                for row in rows(name, data):
                    held.append(row)
                    if len(held) == most:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, target)


def run_batches(name: str, p: X.Parsed, strict: bool = False, exposed: bool = False, layer: int | None = None, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The runs of a file (RUNS) as Arrow batches of some `most` rows, made of arrays; of one layer, if it is given."""
    pixels = p.head.width * p.head.height if p.head else 0
    held: list[tuple] = []
    n = 0
    for e in p.entries:
        if e.data_size and layer in (None, e.layer):
            starts, values = decode(p.slice(e), pixels, strict)
            ends, at = np.append(starts[1:], pixels), np.arange(len(starts))
            if exposed:
                lit = values > 0
                starts, ends, values, at = starts[lit], ends[lit], values[lit], at[lit]
            held.append((e.layer, e.sector, at, starts, ends, values))
            n += len(at)
        if n >= most:
            yield _run_batch(name, held)
            held, n = [], 0
    if n:
        yield _run_batch(name, held)


def _run_batch(name: str, held: list[tuple]) -> pa.RecordBatch:
    counts = [len(h[2]) for h in held]
    each = [np.repeat([h[i] for h in held], counts) for i in (0, 1)] + [np.concatenate([h[i] for h in held]) for i in range(2, 6)]
    kinds = (np.int32, np.int64, np.int32, np.int64, np.int64, np.int32)
    columns = [pa.array(c.astype(k)) for c, k in zip(each, kinds)]
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.string()), sum(counts)), *columns], names=["file_id", "layer", "sector_id", "run_idx", "start", "end", "value"])


class PrintFiles:
    """Views of container files (path, content), opened without validation.  Sealed chunks show no content."""

    def __init__(self, files: DataFrame):
        self.files = files

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PrintFiles:
        return cls(spark.read.format("binaryFile").load(path).select("path", "content"))

    def validated(self, strict: bool = False, key: bytes | None = None) -> PrintFiles:
        """Only the files that break no rule of the level."""
        from ..operators.rules import at_level
        from ..operators.validate import validate

        bad = at_level(validate(self.files, key=key), strict).select(F.col("file_id").alias("path")).distinct()
        return PrintFiles(self.files.join(bad, "path", "left_anti"))

    def opened(self, label: bytes, password: str | None = None, secret: bytes | None = None) -> PrintFiles:
        """Encrypted files as plain ones, by password or by a machine's secret key; raises where no key is found."""

        def rows(name, data):
            yield (name, open_file(data, *session_key(data, label, password, secret)) if X.parse_header(data).flags & X.ENCRYPTED else data)

        return PrintFiles(_each(self.files, FILES, rows, 1))

    def heads(self) -> DataFrame:
        def rows(name, data):
            h = X.read(data).head
            if h:
                yield (name, h.name, h.created, h.width, h.height, h.build_w, h.build_d, h.build_h, h.layer_height, h.total_layers)

        return _each(self.files, HEADS, rows)

    def chunks(self) -> DataFrame:
        """Non-null descriptors with their stored bytes."""

        def rows(name, data):
            for c in X.parse_directory(data, X.parse_header(data)):
                if c.offset:
                    yield (name, c.index, c.kind, c.offset, c.size, c.compressed, c.flags, c.payload)

        return _each(self.files, CHUNKS, rows, 16)

    def objects(self) -> DataFrame:
        """JSON chunks as text."""

        def rows(name, data):
            for c in X.parse_directory(data, X.parse_header(data)):
                if c.offset and c.kind in ("META", "PROF", "LROV") and not c.flags & X.SEALED:
                    yield (name, c.index, c.kind, X.payload_of(c).decode())

        return _each(self.files, JSON, rows)

    def entries(self) -> DataFrame:
        def rows(name, data):
            for i, e in enumerate(X.read(data).entries):
                yield (name, i, e.layer, e.sector, e.data_size, e.data_offset, e.first_layr, e.first_lrov, e.additional)

        return _each(self.files, ENTRIES, rows)

    def slices(self) -> DataFrame:
        """Streams of entries with bytes, by layer and sector."""

        def rows(name, data):
            p = X.read(data)
            for e in p.entries:
                if e.data_size:
                    s = p.slice(e)
                    yield (name, e.layer, e.sector, s[0], s)

        return _each(self.files, SLICES, rows, 256)

    def runs(self, strict: bool = False, exposed: bool = False) -> DataFrame:
        """Decoded runs, or only those that are not black; an entry without bytes has no row."""

        def run(stream):
            for batch in stream:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from run_batches(name, X.read(data.as_py()), strict, exposed)

        return self.files.select("path", "content").mapInArrow(run, RUNS)

    def layer(self, index: int, primary: bool = True) -> DataFrame:
        """(file_id, sector_id, mask) of one layer: the primary sector's (black if it has no bytes), or of all sectors with bytes.

        Only the frames that the layer's entries name are decompressed.
        """

        def rows(name, data):
            p = X.read(data)
            pixels = p.head.width * p.head.height
            for e in p.entries:
                if e.layer == index and (e.sector == 0 if primary else e.data_size):
                    yield (name, e.sector, mask_of_runs(decode(p.slice(e), pixels), pixels).tobytes())

        return _each(self.files, "file_id string, sector_id long, mask binary", rows, 4)

    def layer_images(self, index: int) -> DataFrame:
        """(file_id, image): one layer's primary mask as PNG."""

        def rows(name, data):
            p = X.read(data)
            h = p.head
            for e in p.entries:
                if e.layer == index and e.sector == 0:
                    mask = mask_of_runs(decode(p.slice(e), h.width * h.height), h.width * h.height)
                    yield (name, png(mask.reshape(h.height, h.width)))

        return _each(self.files, "file_id string, image binary", rows, 4)

    def frames(self) -> DataFrame:
        """(file_id, dir_index, output) of each layer chunk: its decompressed bytes."""

        def rows(name, data):
            p = X.read(data)
            for i in sorted(p.frames):
                yield (name, i, p.frame(i))

        return _each(self.files, "file_id string, dir_index int, output binary", rows, 4)

    def previews(self) -> DataFrame:
        return self.chunks().filter("chunk_type = 'PREV'").select("file_id", "dir_index", F.col("flags").bitwiseAND(15).cast("int").alias("role"), (F.col("flags").bitwiseAND(X.SEALED) != 0).alias("sealed"), F.col("payload").alias("image"))

    def thumbnails(self) -> DataFrame:
        """The clear preview of the most wanted role of each file."""
        best = F.min_by(F.struct("dir_index", "role", "image"), F.struct(role_rank(F.col("role")), "dir_index"))
        return self.previews().filter("not sealed").groupBy("file_id").agg(best.alias("b")).select("file_id", "b.dir_index", "b.role", "b.image")

    def extensions(self) -> DataFrame:
        c = self.chunks().filter("chunk_type = 'EXTD'")
        return c.select("file_id", "dir_index", bits(F.col("flags"), 8, 16).alias("vendor"), (bits(F.col("flags"), 24, 1) == 1).alias("critical"), F.decode(F.substring("payload", 5, 4), "US-ASCII").alias("ext_type"), F.expr("substring(payload, 9)").alias("data"))

    def resolved(self) -> DataFrame:
        """Settings of every entry: base, sector and override from the file's own JSON."""
        keys = (*S.KEYS, *S.COUNTS)
        schema = "struct<" + ", ".join([f"{k}: bigint" for k in keys] + [f"{k}: double" for k in S.PASSED]) + ">"
        objects = self.objects()
        base = objects.filter("chunk_type = 'META'").groupBy("file_id").agg(F.min_by("json", "dir_index").alias("json")).select("file_id", F.from_json("json", schema).alias("base"), F.from_json(F.get_json_object("json", "$.sectors"), f"array<struct<sector_id: bigint, {schema[7:]}>").alias("sectors"))
        own = base.select("file_id", F.explode("sectors").alias("s")).select("file_id", F.col("s.sector_id").alias("sector_id"), F.struct(*[F.col(f"s.{k}").alias(k) for k in (*keys, *S.PASSED)]).alias("sector"))
        over = objects.filter("chunk_type = 'LROV'").select("file_id", F.col("dir_index").cast("long").alias("first_lrov"), F.from_json("json", schema).alias("override"))
        points = self.entries().select("file_id", "layer", "sector_id", "first_lrov").join(base.select("file_id", "base"), "file_id").join(own, ["file_id", "sector_id"], "left").join(over, ["file_id", "first_lrov"], "left")
        return S.resolve(points).drop("base", "sector", "override", "first_lrov")

    def flags(self) -> DataFrame:
        """(file_id, version, chunk_count, encrypted, multi_sector, total, size), by expressions alone."""
        from .directory import headers

        set_ = lambda mask: F.col("flags").bitwiseAND(mask) != 0
        return headers(self.files).select("file_id", "version", "chunk_count", set_(X.ENCRYPTED).alias("encrypted"), set_(X.MULTI_SECTOR).alias("multi_sector"), F.col("total").cast("long").alias("total"), "size")

    def scenes(self) -> DataFrame:
        """(file_id, scene) of files with a clear scene."""

        def rows(name, data):
            for c in X.parse_directory(data, X.parse_header(data)):
                if c.offset and c.kind == "VOXL" and not c.flags & X.SEALED:
                    yield (name, X.payload_of(c))

        return _each(self.files, "file_id string, scene binary", rows, 1)

    def dictionaries(self) -> DataFrame:
        """(file_id, dict_id, dictionary) of files with a clear dictionary."""

        def rows(name, data):
            for c in X.parse_directory(data, X.parse_header(data)):
                if c.offset and c.kind == "ZDIC" and not c.flags & X.SEALED:
                    yield (name, *X.parse_dictionary(c.payload))

        return _each(self.files, "file_id string, dict_id long, dictionary binary", rows, 16)

    def hashes(self) -> DataFrame:
        """(file_id, layer, leaf, root) as the files store them, not recomputed."""

        def rows(name, data):
            for c in X.parse_directory(data, X.parse_header(data)):
                if c.offset and c.kind == "LHAS":
                    _, root, leaves = X.parse_hashes(c.payload)
                    for k, x in enumerate(leaves):
                        yield (name, k, x, root)

        return _each(self.files, LEAVES, rows)

    def chunk_kinds(self) -> DataFrame:
        """(file_id, dir_index, chunk_type, sealed) without any payload."""

        def rows(name, data):
            for c in X.parse_directory(data, X.parse_header(data)):
                if c.offset:
                    yield (name, c.index, c.kind, bool(c.flags & X.SEALED))

        return _each(self.files, "file_id string, dir_index int, chunk_type string, sealed boolean", rows)

    def tables(self) -> DataFrame:
        """(file_id, declared, total_layers, pixels, multi_sector): what table, head and header say of the layers."""

        def rows(name, data):
            p = X.read(data)
            if p.head:
                yield (name, p.layers, p.head.total_layers, p.head.width * p.head.height, bool(p.header.flags & X.MULTI_SECTOR))

        return _each(self.files, "file_id string, declared long, total_layers long, pixels long, multi_sector boolean", rows)

    def frame_headers(self) -> DataFrame:
        """(file_id, dir_index, content_size, dict_id) of each layer chunk, from its frame's header alone; no size, or no frame: null."""

        def rows(name, data):
            p = X.read(data)
            for i, (raw, _) in sorted(p.frames.items()):
                try:
                    yield (name, i, X.content_size(raw), X.dict_id(raw))
                except Fault:
                    yield (name, i, None, None)

        return _each(self.files, "file_id string, dir_index int, content_size long, dict_id long", rows)

    def auth(self) -> DataFrame:
        """(file_id, cipher, by_password, fingerprints): how a file opens; no secret is needed to read it."""

        def rows(name, data):
            for c in X.parse_directory(data, X.parse_header(data)):
                if c.offset and c.kind == "AUTH":
                    a = X.Auth.parse(c.payload)
                    yield (name, a.cipher, bool(a.mode & 1), [f for f, _, _ in a.recipients()] if a.mode & 2 else [])

        return _each(self.files, "file_id string, cipher string, by_password boolean, fingerprints array<binary>", rows)

    def inspect(self) -> DataFrame:
        """An inspector's summary: (file_id, layers, entries, sectors, frames, data_bytes, frame_bytes, overridden)."""

        def rows(name, data):
            p = X.read(data)
            yield (name, p.layers, len(p.entries), len({e.sector for e in p.entries}), len(p.frames), sum(e.data_size for e in p.entries), sum(len(f) for f, _ in p.frames.values()), sum(e.first_lrov > 0 for e in p.entries))

        return _each(self.files, "file_id string, layers long, entries long, sectors long, frames long, data_bytes long, frame_bytes long, overridden long", rows)

    def inspect_layers(self) -> DataFrame:
        """A row for each entry with bytes: (file_id, layer, sector_id, tag, data_size, n_runs, exposed, first, last), pixels counted and the first and last exposed."""

        def rows(name, data):
            p = X.read(data)
            pixels = p.head.width * p.head.height
            for e in p.entries:
                if e.data_size:
                    stream = p.slice(e)
                    starts, values = decode(stream, pixels)
                    ends, lit = np.append(starts[1:], pixels), values > 0
                    some = bool(lit.any())
                    yield (name, e.layer, e.sector, stream[0], e.data_size, len(starts), int((ends - starts)[lit].sum()), int(starts[lit][0]) if some else None, int(ends[lit][-1]) - 1 if some else None)

        return _each(self.files, "file_id string, layer int, sector_id long, tag int, data_size long, n_runs long, exposed long, first long, last long", rows)

    def leaves(self) -> DataFrame:
        """Leaf hashes of the data, with the stored root (null without one)."""

        def rows(name, data):
            p = X.read(data)
            stored = p.of("LHAS")
            root = X.parse_hashes(stored[0].payload)[1] if stored else None
            for k in range(p.layers):
                yield (name, k, X.leaf(p.layer_data(k)), root)

        return _each(self.files, LEAVES, rows)


GROUPS = "file_id string, layer_group int, sector_id long, frame binary, layers array<int>, sizes array<long>, leaf_layers array<int>, leaves array<binary>"
SAMPLES = "file_id string, layer_group int, sector_id long, place int, rank long, bytes long, window binary, probe binary"
_GROUPS = pa.schema([("file_id", pa.string()), ("layer_group", pa.int32()), ("sector_id", pa.int64()), ("frame", pa.binary()), ("layers", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("leaf_layers", pa.list_(pa.int32())), ("leaves", pa.list_(pa.binary()))])
_SAMPLES = pa.schema([("file_id", pa.string()), ("layer_group", pa.int32()), ("sector_id", pa.int64()), ("place", pa.int32()), ("rank", pa.int64()), ("bytes", pa.int64()), ("window", pa.binary()), ("probe", pa.binary())])


def _plain(x):
    return x.as_py() if hasattr(x, "as_py") else x


def _sized(spans: DataFrame, heads: DataFrame, per_chunk: int) -> DataFrame:
    sizes = heads.select("file_id", (F.col("width") * F.col("height")).cast("long").alias("pixels"), F.ceil(F.col("total_layers") / per_chunk).cast("int").alias("groups"))
    return spans.join(sizes, "file_id").withColumn("layer_group", F.floor(F.col("layer") / per_chunk).cast("int"))


def _streams(table: pa.Table, probe: bool) -> tuple[dict[int, list[int]], dict, dict, list[tuple[int, list[int]]]]:
    """Of a group's spans: sectors by layer, both forms of the streams, and (sector, its layers with bytes)."""
    pixels = table.column("pixels")[0].as_py()
    spans_of: dict[int, dict[int, list]] = {}
    for layer, sector, a, b, v in zip(*(table.column(c).to_pylist() for c in ("layer", "sector_id", "start", "end", "value"))):
        spans_of.setdefault(layer, {}).setdefault(sector, []).append((a, b, v))
    layers = {k: {s: runs_of_spans(x, pixels) for s, x in v.items()} for k, v in sorted(spans_of.items())}
    sectors = {k: sorted({0, *v}) for k, v in layers.items()}
    first, second = encode_layers(layers, sectors, pixels, probe)
    held = [(s, [k for k in layers if first.get((k, s))]) for s in sorted({s for _, s in first})]
    return sectors, first, second, [(s, ks) for s, ks in held if ks]


def train_dictionaries(sized: DataFrame, level: int = 6) -> DataFrame:
    """(file_id, dictionary) of the prints that a dictionary pays for, without any print meeting in one task.

    Each layer group offers its windows of least hash, of which the least of the whole print are trained on: all windows of a
    small print, in their order.  The probe is the start of the print's first, middle and last group.
    """

    def sample(key: tuple, table: pa.Table) -> pa.Table:
        name, group = map(_plain, key)
        number = table.column("groups")[0].as_py()
        _, first, _, held = _streams(table, False)
        windows, totals = [], []
        for s, ks in held:
            part = b"".join(first[k, s] for k in ks)
            probe = part[: PROBE_BYTES // 3] if not totals and group in (0, (number - 1) // 2, number - 1) else None
            totals.append((name, group, s, -1, 0, len(part), None, probe))
            windows += [(name, group, s, i, zlib.crc32(struct.pack("<iqi", group, s, i)), 0, w, None) for i, w in enumerate(windows_of(part))]
        rows = totals + sorted(windows, key=lambda r: (r[4], r[2], r[3]))[:WINDOWS]
        return pa.Table.from_pylist([dict(zip(_SAMPLES.names, r)) for r in rows], _SAMPLES)

    def learn(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        windows = [r["window"] for r in sorted(left.to_pylist(), key=lambda r: (r["layer_group"], r["sector_id"], r["place"]))]
        total = right.to_pylist()[0]
        found = train_on(windows, b"".join(p["probe"] for p in total["probes"]), total["bytes"], level)
        out = [(_plain(key[0]), found)] if found is not None else []
        return pa.table({"file_id": pa.array([x for x, _ in out], pa.string()), "dictionary": pa.array([x for _, x in out], pa.binary())})

    samples = materialise(sized.groupBy("file_id", "layer_group").applyInArrow(sample, SAMPLES), "samples")
    order = Window.partitionBy("file_id").orderBy("rank", "layer_group", "sector_id", "place")
    few = samples.filter("window is not null").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= WINDOWS).select("file_id", "layer_group", "sector_id", "place", "window")
    probes = F.sort_array(F.collect_list(F.when(F.col("probe").isNotNull(), F.struct("layer_group", "probe"))))  # three at most
    totals = samples.filter("window is null").groupBy("file_id").agg(F.sum("bytes").alias("bytes"), probes.alias("probes"))
    return few.groupBy("file_id").cogroup(totals.groupBy("file_id")).applyInArrow(learn, "file_id string, dictionary binary")


def encode_groups(spans: DataFrame, heads: DataFrame, per_chunk: int = 64, level: int = 6, probe: bool = True, dictionaries: DataFrame | None = None) -> DataFrame:
    """A row for each chunk (GROUPS) from exposed spans (file_id, layer, sector_id, start, end, value).

    The layers of one group meet in a task, with all their sectors; so a file is encoded by as many tasks as it has
    groups.  The first chunk of a group also holds the leaf hashes of the group's layers that have spans.
    dictionaries (file_id, dictionary) go to every group of their file, by the groups' key.
    """

    def encode_group(key: tuple, table: pa.Table, learned: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return _GROUPS.empty_table()
        name, group = map(_plain, key)
        dictionary = learned.column("dictionary")[0].as_py() if learned is not None and learned.num_rows else None
        sectors, first, second, held = _streams(table, probe)
        rows, chosen = [], dict(first)
        for s, ks in held:
            frame, streams = choose_frame([first[k, s] for k in ks], [second[k, s] for k in ks], level, dictionary)
            chosen |= {(k, s): x for k, x in zip(ks, streams)}
            rows.append({"file_id": name, "layer_group": group, "sector_id": s, "frame": frame, "layers": ks, "sizes": [len(x) for x in streams], "leaf_layers": [], "leaves": []})
        if rows:
            rows[0]["leaf_layers"] = list(sectors)
            rows[0]["leaves"] = [X.leaf(b"".join(chosen[k, s] for s in sectors[k])) for k in sectors]
        return pa.Table.from_pylist(rows, _GROUPS)

    groups = _sized(spans, heads, per_chunk).groupBy("file_id", "layer_group")
    if dictionaries is None:
        return groups.applyInArrow(lambda key, table: encode_group(key, table), GROUPS)
    number = F.greatest(F.ceil(F.col("total_layers") / per_chunk).cast("int"), F.lit(1))
    each = heads.select("file_id", F.explode(F.sequence(F.lit(0), number - 1)).alias("layer_group")).join(dictionaries, "file_id").select(F.col("file_id").alias("print"), "layer_group", "dictionary")  # a name of its own, as heads may come from the spans
    return groups.cogroup(each.groupBy("print", "layer_group")).applyInArrow(encode_group, GROUPS)


def write_prints(spans: DataFrame, heads: DataFrame, per_chunk: int = 64, overrides: DataFrame | None = None, level: int = 6, probe: bool = True, dictionary: bool = False, hashes: bool = True, share_overrides: bool = True) -> DataFrame:
    """(path, content) from exposed spans and heads (file_id, width, height, total_layers, meta).

    heads may also have encoder, created, build_w, build_d, build_h, layer_height_um, profile (JSON), previews (structs of
    role and image), extensions (structs of vendor, critical, ext_type and data) and scene; a null one is left out, or
    keeps its default.  overrides: (file_id, layer, sector_id, settings as JSON), a pair only once in a file, or the file
    is refused.  Layer groups are encoded in parallel; only their frames meet in one task, as a file is one value of bytes.
    With `dictionary` the spans are read once before, for a sample of the whole print.
    """
    learned = train_dictionaries(_sized(spans, heads, per_chunk), level) if dictionary else None
    if learned is not None:
        learned = materialise(learned, "dictionaries")
        heads = heads.join(learned, "file_id", "left")
    if overrides is not None:
        listed = overrides.groupBy("file_id").agg(F.collect_list(F.struct("layer", "sector_id", "settings")).alias("overrides"))
        heads = heads.join(listed, "file_id", "left")
    groups = encode_groups(spans, heads, per_chunk, level, probe, learned)

    def pack(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        name = _plain(key[0])
        if not right.num_rows:
            raise ValueError(f"no head for {name}")
        h = right.to_pylist()[0]
        n = h["total_layers"]
        value = lambda column, default: default if h.get(column) is None else h[column]
        head = X.Head(value("encoder", "lamina"), value("created", 0), h["width"], h["height"], value("build_w", 1000), value("build_d", 1000), value("build_h", 1000), value("layer_height_um", 50), n)
        job = Print(
            head,
            json.loads(h["meta"]),
            [],
            overrides=[(o["layer"], o["sector_id"], json.loads(o["settings"])) for o in value("overrides", [])],
            profile=json.loads(h["profile"]) if h.get("profile") is not None else None,
            previews=[(p["role"], p["image"]) for p in value("previews", [])],
            extensions=[(e["vendor"], e["critical"], e["ext_type"].encode("ascii"), e["data"]) for e in value("extensions", [])],
            scene=h.get("scene"),
            per_chunk=per_chunk,
            level=level,
            hashes=hashes,
            share_overrides=share_overrides,
        )
        frames, sizes, leaves = {}, {}, [X.leaf(b"")] * n
        sectors: dict[int, set[int]] = {k: {0} for k in range(n)}
        for k, s in job.overrides:
            if k not in sectors:
                raise Fault("lrov.orphan", f"{name}: layer {k} of {n}")
            sectors[k].add(s)
        for r in left.to_pylist():
            frames[r["layer_group"], r["sector_id"]] = r["frame"]
            for k, size in zip(r["layers"], r["sizes"]):
                sizes[k, r["sector_id"]] = size
                sectors[k].add(r["sector_id"])
            for k, x in zip(r["leaf_layers"], r["leaves"]):
                leaves[k] = x
        data = lay_out(job, {k: sorted(s) for k, s in sectors.items()}, dict(sorted(frames.items())), sizes, leaves, h.get("dictionary"))
        return pa.table({"path": pa.array([name], pa.string()), "content": pa.array([data], pa.binary())})

    return groups.groupBy("file_id").cogroup(heads.groupBy("file_id")).applyInArrow(pack, FILES)


def seal_prints(files: DataFrame, label: bytes, password: str | None = None, machines: tuple[bytes, ...] = (), cipher: str = "A256", costs: tuple[int, int, int] = (3, 65536, 1)) -> DataFrame:
    """Plain files (path, content) as encrypted ones, for a password, for machines' public keys, or for both.

    costs: Argon2id's rounds, KiB and lanes for the password.

    Each file gets a session key of its own, and all its nonces are fresh; so files differ from run to run, and a task that
    runs again gives other bytes of the same content.
    """
    if password is None and not machines:
        raise Fault("crypt.mode_empty", "neither a password nor a machine")

    def rows(name, data):
        key = os.urandom(32)
        opened_by = password_section(password, key, os.urandom(16), *costs) if password is not None else b""
        entries = b"".join(machine_entry(public, key, os.urandom(32), label) for public in machines)
        yield (name, seal_file(data, X.Auth(cipher, (password is not None) + 2 * bool(machines), opened_by, entries), key, lambda _: os.urandom(12)))

    return _each(files, FILES, rows, 1)
