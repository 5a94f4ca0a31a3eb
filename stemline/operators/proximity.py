"""Points near other points or regions, within frames.

The plane of a frame is cut into strips along y (and, across them, into long blocks along x, so that a crowded strip is
not one task). Strips overlap: a point is also copied to the next strip or block if it lies within the distance of it.
Spark range-partitions the cells by frame, strip and block, and sorts each partition by cell and x. A task then sweeps its
rows once with a window of the rows within reach along x, so that it never holds a whole cell. Each candidate pair is verified by its distance,
and belongs to one cell only: the one that holds the larger y and the larger x of the two.

Regions are boxes, half open. A box is copied to each cell that it touches, a point is only tested in its own cell, so
each pair comes out once. Boxes that span more than WIDE cells are copied only to those of them that hold points: these
are looked up by frame and band of strips, and all boxes go through the same sweep.

Defined cases: points without frame keys or coordinates (null or NaN) take no part; repeated rows of one point count
once; points at the same place are a pair; empty tables give an empty result; a box with a null or NaN border, or with
lo >= hi, holds nothing. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemline.functions.sweep import expand, forward_pairs

#: Micrometres of a voxel along z, y, x.
SCALE = (1.625, 0.40625, 0.40625)
#: Strip height and block length in units of the distance.
STRIP, BLOCK_LENGTH = 8.0, 32.0
#: Boxes that span more cells than this look up the ones that hold points; strips of a band in that lookup.
WIDE, BAND = 256, 64
SIDES = tuple(f"{c}_{s}" for c in "zyx" for s in ("lo", "hi"))


def clean_points(points: DataFrame, frame: list[str], key: str = "node_id") -> DataFrame:
    """(frame..., key, z, y, x) of rows with all of them."""
    rows = points.select(*frame, F.col(key).alias("id"), *[F.col(c).cast("double").alias(c) for c in "zyx"])
    for c in [*frame, "id", *"zyx"]:
        rows = rows.where(F.col(c).isNotNull())
    return rows.where(~(F.isnan("z") | F.isnan("y") | F.isnan("x")))


def _cell(um, width):
    return F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), um)) / width).cast("long")


def near_points(points: DataFrame, distance_um: float, frame: list[str], key: str = "node_id") -> DataFrame:
    """(left_id, right_id): each two different points of one frame at most distance_um apart, the smaller id left."""
    return neighbourhoods(points, None, distance_um, frame, key).select("left_id", "right_id")


def points_in_boxes(points: DataFrame, boxes: DataFrame, frame: list[str], key: str = "node_id", box_key: str = "crop_id", cell_um: float = 26.0) -> DataFrame:
    """(left_id, right_id): a point and a box of its frame that holds it (lo <= c < hi on each axis)."""
    return neighbourhoods(points, boxes, cell_um / STRIP, frame, key, box_key, pairs=False).select("left_id", "right_id")


def clean_boxes(boxes: DataFrame, frame: list[str], box_key: str = "crop_id") -> DataFrame:
    """(frame..., id, z_lo, ..., x_hi) of boxes that can hold something, repeated rows once."""
    crops = boxes.select(*frame, F.col(box_key).alias("id"), *[F.col(c).cast("double").alias(c) for c in SIDES])
    for c in [*frame, "id", *SIDES]:
        crops = crops.where(F.col(c).isNotNull())
    for c in "zyx":
        crops = crops.where(~F.isnan(f"{c}_hi") & (F.col(f"{c}_lo") < F.col(f"{c}_hi")))
    return crops.distinct()


def neighbourhoods(
    points: DataFrame, boxes: DataFrame | None, distance_um: float, frame: list[str], key: str = "node_id", box_key: str = "crop_id", pairs: bool = True
) -> DataFrame:
    """(is_pair, left_id, right_id): near points as near_points gives them, and points in boxes, in one sweep."""
    height, length = STRIP * distance_um, BLOCK_LENGTH * distance_um
    um = {c: F.col(c) * s for c, s in zip("zyx", SCALE)}
    rows = clean_points(points, frame, key)

    def cells(c, width):  # a point's own cell, and the next one if it is within reach of it
        own, next_ = _cell(um[c], width), _cell(um[c] + distance_um, width)
        return F.explode(F.when((own == next_) | F.lit(not pairs), F.array(own)).otherwise(F.array(own, next_)))

    no_sides = F.lit(None).cast("struct<" + ",".join(f"{c}:double" for c in SIDES) + ">")
    keys = [*frame, "strip", "block"]
    stream = rows.withColumn("strip", cells("y", height)).withColumn("block", cells("x", length)).select(*keys, F.col("x").alias("at"), no_sides.alias("sides"), "id", "z", "y")
    if boxes is not None:
        crops = clean_boxes(boxes, frame, box_key)
        lo_s, hi_s = (_cell(F.col(f"y_{s}") * SCALE[1], height) for s in ("lo", "hi"))
        lo_b, hi_b = (_cell(F.col(f"x_{s}") * SCALE[2], length) for s in ("lo", "hi"))
        crops = crops.withColumns({"s0": lo_s, "s1": hi_s, "b0": lo_b, "b1": hi_b})
        # as doubles, so that the product of two spans cannot overflow
        wide = (F.col("s1") - F.col("s0") + 1).cast("double") * (F.col("b1") - F.col("b0") + 1) > WIDE
        placed = crops.where(~wide).withColumn("strip", F.explode(F.sequence("s0", "s1"))).withColumn("block", F.explode(F.sequence("b0", "b1")))
        if crops.where(wide).limit(1).count():
            placed = placed.unionByName(_occupied(crops.where(wide), stream, frame))
        none = F.lit(None).cast("double")
        stream = stream.unionByName(placed.select(*keys, F.col("x_lo").alias("at"), F.struct(*SIDES).alias("sides"), "id", none.alias("z"), none.alias("y")))
    # at one place, boxes come before points
    sorted_ = stream.repartitionByRange(*keys).sortWithinPartitions(*keys, "at", F.col("sides").isNull(), "id")
    return sorted_.mapInArrow(_sweep(keys, distance_um, height, length, pairs), "is_pair boolean, left_id long, right_id long")


def _occupied(wide: DataFrame, stream: DataFrame, frame: list[str]) -> DataFrame:
    """Wide boxes with each strip and block that they span and that holds a point."""
    cells = stream.select(*frame, F.floor(F.col("strip") / BAND).alias("band"), "strip", "block").distinct()
    bands = cells.select(*frame, "band").distinct()
    spans = wide.join(bands, frame).where((F.col("band") >= F.floor(F.col("s0") / BAND)) & (F.col("band") <= F.floor(F.col("s1") / BAND)))
    return spans.join(cells, [*frame, "band"]).where(F.col("strip").between(F.col("s0"), F.col("s1")) & F.col("block").between(F.col("b0"), F.col("b1"))).drop("band")


def _runs(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each row that changes where any of the keys does; rows come sorted by keys."""
    change = np.zeros(batch.num_rows, bool)
    for k in keys:
        col = batch.column(k)
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            col = col.dictionary_encode()
            col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).indices
        values = col.to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def _found(is_pair: bool, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(left), is_pair)), pa.array(left), pa.array(right)], ["is_pair", "left_id", "right_id"])


def _sweep(keys: list[str], distance: float, height: float, length: float, pairs: bool):
    sz, sy, sx = SCALE

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None  # the points behind that are still within reach, and the boxes that are still open
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            old = 0 if carried is None else carried.num_rows
            if old:
                table = pa.concat_tables([carried, table]).combine_chunks()
            group = _runs(table, keys)
            at, ids = table.column("at").to_numpy(), table.column("id").to_numpy()
            sides = table.column("sides").combine_chunks()
            is_box = sides.is_valid().to_numpy(zero_copy_only=False)
            box, point = np.flatnonzero(is_box), np.flatnonzero(~is_box)
            if len(point):  # repeated deliveries stand side by side
                point = point[np.r_[True, (group[point][1:] != group[point][:-1]) | (ids[point][1:] != ids[point][:-1])]]
            seen = int(np.searchsorted(point, old))  # carried points have been tested among themselves and in carried boxes
            g, i_, x = group[point], ids[point], at[point]
            z, y = (table.column(c).to_numpy()[point] for c in "zy")
            strip, block = (table.column(c).to_numpy()[point] for c in ("strip", "block"))
            if pairs:
                zu, yu, xu = z * sz, y * sy, x * sx
                for i, j in forward_pairs(g, xu, distance):
                    new = j >= seen
                    i, j = i[new], j[new]
                    with np.errstate(invalid="ignore"):
                        d = (zu[i] - zu[j]) ** 2 + (yu[i] - yu[j]) ** 2 + (xu[i] - xu[j]) ** 2
                        own = (np.floor(np.maximum(yu[i], yu[j]) / height) == strip[i]) & (np.floor(np.maximum(xu[i], xu[j]) / length) == block[i])
                    hit = (d <= distance * distance) & own & (i_[i] != i_[j])
                    i, j = i[hit], j[hit]
                    if len(i):
                        yield _found(True, np.minimum(i_[i], i_[j]), np.maximum(i_[i], i_[j]))
            side = {c: pc.struct_field(sides, c).to_numpy(zero_copy_only=False) for c in SIDES} if len(box) else {}
            if len(box) and len(point):
                # a point is tested in its own cell only
                home = (np.floor(np.clip(y * sy, -1e15, 1e15) / height) == strip) & (np.floor(np.clip(x * sx, -1e15, 1e15) / length) == block)
                first = np.maximum(np.searchsorted(point, box), seen)
                ends = np.searchsorted(g, group[box], side="right")
                stop = np.array([a + np.searchsorted(x[a:b], h, side="left") for a, b, h in zip(first, ends, side["x_hi"][box])], np.int64)
                for b, k in expand(box, first, np.maximum(stop, first)):
                    hit = home[k] & (z[k] >= side["z_lo"][b]) & (z[k] < side["z_hi"][b]) & (y[k] >= side["y_lo"][b]) & (y[k] < side["y_hi"][b])
                    b, k = b[hit], k[hit]
                    if len(b):
                        yield _found(False, i_[k], ids[b])
            keep = np.zeros(len(at), bool)
            here = group == group[-1]
            keep[point] = here[point] & ((at[point] >= at[-1]) | (at[point] * sx >= at[-1] * sx - distance)) if pairs else here[point] & (at[point] >= at[-1])
            if len(box):
                keep[box] = here[box] & (side["x_hi"][box] > at[-1])
            carried = table.filter(pa.array(keep))

    return sweep
