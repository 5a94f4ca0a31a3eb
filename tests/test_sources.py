import json

import numpy as np
import pytest

from stemline.config import Settings
from stemline.sources.geff import find_key, read_geff
from stemline.sources.submission import graphs, read_submission, uncovered, write_submission
from stemline.operators.lineage import submission


def put(folder, name, values, chunk):
    values = np.asarray(values)
    d = folder / name
    d.mkdir(parents=True)
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(values.shape), "data_type": values.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}]}
    (d / "zarr.json").write_text(json.dumps(meta))
    padded = np.zeros([-(-s // c) * c for s, c in zip(values.shape, chunk)], values.dtype)
    padded[tuple(slice(0, s) for s in values.shape)] = values
    for i in range(padded.shape[0] // chunk[0]):
        at = d / "c" / "/".join([str(i)] + ["0"] * (values.ndim - 1))
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(padded[i * chunk[0] : (i + 1) * chunk[0]].tobytes())


def store(folder, t=(0, 1, 1), edges=True):
    put(folder, "nodes/ids", np.array([103, 240, 377], np.int64), [2])
    for c, v in (("t", t), ("z", (0.0, 2.0, 2.5) if any(t) else (0.0, 0.0, 0.0)), ("y", (1.0, 2.0, 3.0)), ("x", (4.0, 5.0, 6.0))):
        put(folder, f"nodes/props/{c}/values", np.array(v, np.int64 if c == "t" else np.float64), [2])
    if edges:
        put(folder, "edges/ids", np.array([[103, 240], [103, 377]], np.int64), [2, 2])
    (folder / "zarr.json").write_text(json.dumps({"attributes": {"geff": {"extra": {"estimated_number_of_nodes": 4.0}}}}))


def test_geff(spark, tmp_path):
    store(tmp_path / "a_1.geff")
    store(tmp_path / "b_2.geff", edges=False)
    nodes, edges, meta = read_geff(spark, str(tmp_path))
    assert {tuple(r) for r in nodes.where("dataset = 'a_1'").collect()} == {("a_1", 103, 0, 0.0, 1.0, 4.0), ("a_1", 240, 1, 2.0, 2.0, 5.0), ("a_1", 377, 1, 2.5, 3.0, 6.0)}
    assert {tuple(r) for r in edges.collect()} == {("a_1", 103, 240), ("a_1", 103, 377)}
    assert {tuple(r) for r in meta.collect()} == {("a_1", 4.0), ("b_2", 4.0)}
    store(tmp_path / "more" / "c_3.geff", t=(0, 0, 0))
    with pytest.raises(Exception, match="broken download"):
        read_geff(spark, str(tmp_path / "more"))[0].collect()
    assert find_key({"a": [{"b": 1}, {"c": {"d": 2}}]}, "d") == 2 and find_key([], "d") is None


def test_submission(spark, tmp_path):
    det = spark.createDataFrame([("m_1", 1, 0, 3.4, 10.6, 20.0), ("m_1", 2, 1, 3.6, 11.0, 21.2), ("m_2", 3, 0, 1.5, 2.5, -0.7)], "dataset string, node_id long, t int, z double, y double, x double")
    links = spark.createDataFrame([("m_1", 1, 2)], "dataset string, source_id long, target_id long")
    path = str(tmp_path / "out")
    write_submission(submission(det, links), path)
    rows = read_submission(spark, path)
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2, 3]
    nodes, edges = graphs(rows)
    assert {(r.node_id, r.z, r.y, r.x) for r in nodes.collect()} == {(1, 3, 11, 20), (2, 4, 11, 21), (3, 2, 2, 0)}
    assert [tuple(r) for r in edges.collect()] == [("m_1", 1, 2)]
    assert [r.dataset for r in uncovered(rows, spark.createDataFrame([("m_1",), ("m_9",)], "dataset string")).collect()] == ["m_9"]
    rows.drop("x").write.csv(str(tmp_path / "bad"), header=True)
    with pytest.raises(ValueError, match="missing columns: x"):
        read_submission(spark, str(tmp_path / "bad"))


def test_settings():
    s = Settings.of({"fill_longest": "2", "readmit_um": "3.5"})
    off = Settings.of({"add_threshold": "none", "cap_scale": "Exempt", "delete_threshold": "0.05"})
    assert off.add_threshold is None and off.cap_scale is None and off.differs(Settings()) == {"add_threshold": (None, 0.3), "delete_threshold": (0.05, 0.01)}
    assert s.fill_longest == 2 and s.differs(Settings()) == {"fill_longest": (2, 3), "readmit_um": (3.5, 4.0)}
    assert json.loads(s.manifest(run="a"))["run"] == "a"
    for bad in ({"nothing": "1"}, {"readmit_um": "nan"}, {"smoothing_weight": "2"}):
        with pytest.raises(ValueError):
            Settings.of(bad)
