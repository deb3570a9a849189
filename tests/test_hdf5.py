"""h5ad files: slices of datasets, both layouts, several files, normalised values; files of other forms are refused."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.sources import formats, hdf5


@pytest.mark.parametrize("chunk", [None, 7, 100_000])
def test_datasets_and_slices(tmp_path, chunk):
    rng = np.random.default_rng(0)
    tree = {"X": {"data": rng.normal(size=3000).astype("f4"), "indices": rng.integers(0, 99, 3000).astype("i4"), "indptr": np.arange(601, dtype="i8") * 5}, "obs": {"total": rng.random(50)}, "none": np.zeros(0, "i8"), "short": np.arange(10, dtype="u2")}
    path = tmp_path / "a.h5ad"
    path.write_bytes(hdf5.encode(tree, chunk))
    with hdf5.File(str(path)) as f:
        for name, want in (("X/data", tree["X"]["data"]), ("X/indices", tree["X"]["indices"]), ("X/indptr", tree["X"]["indptr"]), ("obs/total", tree["obs"]["total"]), ("none", tree["none"]), ("short", tree["short"])):
            got = f[name]
            assert len(got) == len(want) and got.dtype == want.dtype
            assert (got[:] == want).all() and (got[3:40] == want[3:40]).all() and len(got[5:5]) == 0
        with pytest.raises(KeyError):
            f["X/absent"]


def test_superblock_by_the_format(tmp_path):
    """Fixed values of the format: places of the sizes, the end of the file and the root's entry."""
    raw = hdf5.encode({"a": np.arange(3.0)})
    assert raw[:8] == b"\x89HDF\r\n\x1a\n" and raw[13] == raw[14] == 8
    assert struct.unpack("<HH", raw[16:20]) == (4, 16) and struct.unpack("<Q", raw[40:48])[0] == len(raw)
    tree, heap = struct.unpack("<QQ", raw[80:96])
    assert raw[tree : tree + 4] == b"TREE" and raw[heap : heap + 4] == b"HEAP"


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"no such file" * 20)
    (tmp_path / "y").write_bytes(hdf5.SIGNATURE + b"\x02" + b"\0" * 100)
    with pytest.raises(ValueError):
        hdf5.File(str(tmp_path / "x"))
    with pytest.raises(NotImplementedError):
        hdf5.File(str(tmp_path / "y"))


@pytest.mark.parametrize("normalised", [False, True])
def test_round_trip_of_several_files(spark, tmp_path, normalised):
    rng = np.random.default_rng(3)
    rows = [(c * 10, g * 3, int(rng.integers(1, 70))) for c in range(60) for g in range(20) if rng.random() < 0.4]
    counts = spark.createDataFrame(rows, "cell long, gene long, raw int")
    known = formats.write_h5ad(counts, f"file:{tmp_path}/h", 200, normalised=normalised).collect()
    files = sorted({(r.file, r.path, r.layout) for r in known})
    assert [f[2] for f in files] == ["csr", "csc", "csr"]
    read = formats.h5ad(spark, [f[1] for f in files], [f[2] for f in files], 7, "total" if normalised else None)
    name = {(r.file, r.kind, r.new): r.old for r in known}
    assert sorted((name[r.file, "cell", r.cell], name[r.file, "gene", r.gene], r.raw) for r in read.collect()) == sorted(rows)
    genes = spark.createDataFrame([(r.file, r.new, r.old) for r in known if r.kind == "gene"], "file int, gene long, universe long")
    kept = formats.h5ad_union([read], genes, 22, 5, 200).collect()
    often = {g for g in {g for _, g, _ in rows} if sum(x[1] == g for x in rows) >= 22}
    own = [x for x in rows if x[1] in often]
    good = {c for c in {x[0] for x in own} if sum(x[0] == c for x in own) >= 5 and sum(x[2] for x in own if x[0] == c) >= 200}
    assert sorted((name[r.file, "cell", r.cell], r.gene, r.raw) for r in kept) == sorted(x for x in own if x[0] in good)
    assert read.select(F.col("file")).distinct().count() == 3


def test_small_slabs_are_read_together(tmp_path):
    """Forty slabs of two files are one task's; a slab beyond the bound stays alone."""
    paths = []
    for i in range(2):
        ptr = np.arange(41) * 3
        x = {"data": np.arange(120.0), "indices": np.arange(120, dtype=np.int32) % 7, "indptr": ptr}
        (tmp_path / f"{i}").write_bytes(hdf5.encode({"X": x, "obs": {"total": np.ones(7)}}, 16))
        paths.append(str(tmp_path / f"{i}"))
    reader = formats._SlabReader(paths, ["csr", "csc"], 2, None)
    parts = reader.partitions()
    assert [p.value for p in parts] == [[(0, 0, 40), (1, 0, 40)]]
    got = [r for batch in reader.read(parts[0]) for r in batch.to_pylist()]
    assert sorted((r["file"], r["value"]) for r in got) == [(i, float(v)) for i in range(2) for v in range(120)]
    assert all((r["cell"] if r["file"] == 0 else r["gene"]) == r["value"] // 3 for r in got)
    before, formats.AT_ONCE = formats.AT_ONCE, 10
    try:
        assert [p.value for p in reader.partitions()][:2] == [[(0, 0, 2)], [(0, 2, 4)]]
    finally:
        formats.AT_ONCE = before
