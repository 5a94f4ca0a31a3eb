"""Annotated graphs stored as Zarr version 3 arrays, one folder `{dataset}.geff` each.

Spark lists and reads the files of all stores (``binaryFile``); the files of one store come to one task, which decodes its
arrays. A store is one movie, its annotation is sparse. Codecs: bytes (little endian), gzip, zstd if zstandard is there.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.store import Scratch

ARRAYS = {"nodes/ids": "node_id", "nodes/props/t/values": "t", "nodes/props/z/values": "z", "nodes/props/y/values": "y", "nodes/props/x/values": "x"}
SCHEMA = "dataset string, kind string, node_id long, t int, z double, y double, x double, source_id long, target_id long, estimate double"


class GeffError(ValueError):
    """A store that cannot be read whole."""


def decode(files: dict[str, bytes], name: str) -> np.ndarray:
    """One array from the files of its store."""
    if f"{name}/zarr.json" not in files:
        raise GeffError(f"no array {name}")
    meta = json.loads(files[f"{name}/zarr.json"])
    shape, chunk = meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"]
    out = np.full(shape, meta.get("fill_value") or 0, np.dtype(meta["data_type"]).newbyteorder("<"))
    sep = meta.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
    for at in itertools.product(*[range(math.ceil(s / c)) for s, c in zip(shape, chunk)]):
        raw = files.get(f"{name}/c{sep}{sep.join(map(str, at))}")
        if raw is None:
            continue  # an absent chunk holds the fill value
        for codec in reversed(meta["codecs"]):
            if codec["name"] == "gzip":
                raw = gzip.decompress(raw)
            elif codec["name"] == "zstd":
                import zstandard

                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            elif codec["name"] != "bytes" or codec.get("configuration", {}).get("endian", "little") != "little":
                raise GeffError(f"codec {codec['name']} of {name} is not supported")
        part = np.frombuffer(raw, out.dtype).reshape(chunk)
        where = tuple(slice(i * c, min((i + 1) * c, s)) for i, c, s in zip(at, chunk, shape))
        out[where] = part[tuple(slice(0, w.stop - w.start) for w in where)]
    return out


def find_key(value, key: str):
    """The first value of a key anywhere in nested metadata, or None."""
    if isinstance(value, dict):
        if key in value:
            return value[key]
        value = list(value.values())
    if isinstance(value, list):
        return next((x for v in value if (x := find_key(v, key)) is not None), None)
    return None


def _rows(key: tuple, files: pd.DataFrame) -> pd.DataFrame:
    held = dict(zip(files["name"], files["content"]))
    if "zarr.json" not in held:
        raise GeffError(f"{key[0]}: no zarr.json")
    nodes = pd.DataFrame({column: decode(held, name) for name, column in ARRAYS.items()})
    if len(nodes) and not nodes.t.any() and not nodes.z.any():
        raise GeffError(f"{key[0]}: all times and depths are 0, as in a broken download")
    links = decode(held, "edges/ids").reshape(-1, 2) if "edges/ids/zarr.json" in held else np.zeros((0, 2), np.int64)
    edges = pd.DataFrame(links, columns=["source_id", "target_id"])
    estimate = find_key(json.loads(held["zarr.json"]), "estimated_number_of_nodes")
    out = pd.concat([nodes.assign(kind="node"), edges.assign(kind="edge"), pd.DataFrame([{"kind": "meta", "estimate": None if estimate is None else float(estimate)}])])
    out["dataset"] = key[0]
    for c in ("node_id", "t", "source_id", "target_id"):
        out[c] = out[c].astype("Int64") if c in out else pd.array([None] * len(out), "Int64")
    return out.reindex(columns=[c.split()[0] for c in SCHEMA.split(", ")])


def read_geff(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, meta) of all stores in a folder: (dataset, node_id, t, z, y, x), (dataset, source_id, target_id), (dataset, estimate)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.regexp_extract("path", r"/([^/]+)\.geff/", 1).alias("dataset"), F.regexp_extract("path", r"\.geff/(.*)$", 1).alias("name"), "content").where("dataset <> ''")
    rows = Scratch(spark, "geff").keep(named.groupBy("dataset").applyInPandas(_rows, SCHEMA), "decoded")  # once for all three
    return (
        rows.where("kind = 'node'").select("dataset", "node_id", "t", "z", "y", "x"),
        rows.where("kind = 'edge'").select("dataset", "source_id", "target_id"),
        rows.where("kind = 'meta'").select("dataset", "estimate"),
    )
