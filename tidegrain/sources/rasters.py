"""Raster files as long tables of cells.  A file is one row of `binaryFile` and is decoded by the task that reads it, so rasters
spread over tasks by file; files must be smaller than 2 GB.

GeoTIFF: strips or tiles, uncompressed, deflated or LZW, with or without a predictor.  grid_blocks.py reads single blocks of larger files,
and classic NetCDF; cells of HDF files are expected as Parquet (grid_id, date or start_date and end_date, value)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.recode import no_data
from .grid_blocks import SAMPLES, tiff_fields, unpacked
from .grid_blocks import samples as samples_of
from .periods import files, met_by

#: Box in which a registered grid must lie in part.  Fixed values.
REGISTERED_BOX = (-125.5, 24.0, -66.5, 49.8)


@dataclass(frozen=True)
class Grid:
    """Top left corner, cell size, columns, rows, bands, and the mark of missing cells."""

    x0: float
    y0: float
    cell: float
    width: int
    height: int
    bands: int
    nodata: float | None


def _fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    return tiff_fields(lambda at, n: data[at : at + n])


def grid_of(data: bytes) -> Grid:
    """The grid of a north-up GeoTIFF."""
    _, f = _fields(data)
    scale, tie = f.get(33550), f.get(33922)
    if scale is None or tie is None or 34264 in f or abs(scale[0] - scale[1]) > 1e-12:
        raise ValueError("the raster must be north-up with square cells")
    mark = f[42113][0].split(b"\0")[0].strip() if 42113 in f else b""
    return Grid(tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], f[256][0], f[257][0], f.get(277, (1,))[0], float(mark) if mark else None)


def band_of(data: bytes, band: int = 1) -> np.ndarray:
    """One band as rows of numbers, band 1 first."""
    order, f = _fields(data)
    width, height, samples = f[256][0], f[257][0], f.get(277, (1,))[0]
    kind = np.dtype(f"{order}{SAMPLES[f.get(339, (1,))[0]]}{f[258][0] // 8}")
    planar, packing, predictor = f.get(284, (1,))[0], f.get(259, (1,))[0], f.get(317, (1,))[0]
    tiles = 322 in f
    w, h = (f[322][0], f[323][0]) if tiles else (width, f.get(278, (height,))[0])
    starts, sizes = (f[324], f[325]) if tiles else (f[273], f[279])
    across, down = -(-width // w), -(-height // h)
    inner = samples if planar == 1 else 1
    out = np.zeros((down * h, across * w), kind.newbyteorder("="))
    for k in range(across * down):
        at = k + (across * down * (band - 1) if planar == 2 else 0)
        raw = data[starts[at] : starts[at] + sizes[at]]
        block = samples_of(unpacked(raw, packing), kind, w, inner, predictor)
        y, x = k // across * h, k % across * w
        out[y : y + len(block), x : x + w] = block[..., band - 1 if planar == 1 else 0]
    return out[:height, :width]


def cells(spark: SparkSession, found: DataFrame, bands: dict[str, int] | None = None, wanted: DataFrame | None = None, offset: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """found(path, *keep) -> (*keep, grid_id, one column for each band): cells row-major from the top left corner, from `offset`;
    cells without data in every band go.  wanted(grid_id): only these, by a join beside the decoding.  A zip is read as its one raster."""
    bands = bands or {"value": 1}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                data = row.content
                if data[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        data = z.read(next(n for n in z.namelist() if n.lower().endswith((".tif", ".tiff"))))
                mark = grid_of(data).nodata
                made = {c: band_of(data, b).astype(np.float64).ravel() for c, b in bands.items()}
                for c, v in made.items():
                    if mark is not None:
                        v[np.isclose(v, mark)] = np.nan
                held = np.flatnonzero(~np.all([np.isnan(v) for v in made.values()], axis=0))
                for k in range(0, len(held), 200_000):
                    at = held[k : k + 200_000]
                    part = {"path": row.path, "grid_id": at + offset} | {c: v[at] for c, v in made.items()}
                    yield pd.DataFrame(part)

    content = spark.read.format("binaryFile").load([r.path for r in found.select("path").collect()]).select("path", "content")  # a list of files
    out = content.mapInPandas(decode, ", ".join(["path string", "grid_id long", *[f"`{c}` double" for c in bands]]))
    out = out.select("path", "grid_id", *[no_data(F.col(c)).alias(c) for c in bands])
    if keep:
        out = out.join(F.broadcast(found.select("path", *keep)), "path")  # one row for each file
    if wanted is not None:
        out = out.join(wanted.select("grid_id").distinct(), "grid_id", "left_semi")
    return out.select(*keep, "grid_id", *bands)


def grids(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, x0, y0, cell, width, height, bands, nodata) of GeoTIFF files."""

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"path": p} | vars(grid_of(c)) for p, c in zip(batch.path, batch.content, strict=True)], columns=["path", *Grid.__dataclass_fields__])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(head, "path string, x0 double, y0 double, cell double, width int, height int, bands int, nodata double")


def checked_grid(spark: SparkSession, paths: list[str] | str) -> dict[str, float]:
    """The one grid of all files, in degrees; fails if they differ or lie outside the contiguous states."""
    rows = grids(spark, paths).select("x0", "y0", "cell", "width", "height").distinct().limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the rasters do not share one grid")
    g, (west, south, east, north) = rows[0].asDict(), REGISTERED_BOX
    if g["x0"] > east or g["x0"] + g["width"] * g["cell"] < west or g["y0"] < south or g["y0"] - g["height"] * g["cell"] > north:
        raise ValueError("the raster lies outside the contiguous states")
    return g


def dated_cells(spark: SparkSession, folder: str, pattern: str, first: Column, last: Column, bands: dict[str, int] | None = None, wanted: DataFrame | None = None, offset: int = 0) -> DataFrame:
    """(start_date, end_date, grid_id, bands) of the files whose period meets first .. last; others are not opened."""
    return cells(spark, met_by(files(spark, folder, pattern), first, last), bands, wanted, offset, ("start_date", "end_date"))


def box_cells(west: float, south: float, east: float, north: float, x0: float = -180.0, y0: float = 90.0, cell: float = 0.25, width: int = 1440) -> Column:
    """Array of the ids of the cells of a grid in degrees that a box meets."""
    columns = F.sequence(F.lit(int((west - x0) // cell)), F.lit(int((east - x0) // cell)))
    rows = F.sequence(F.lit(int((y0 - north) // cell)), F.lit(int((y0 - south) // cell)))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: r * width + c)))


def preconverted(long_cells: DataFrame, path: str, feature: str, ids: Column) -> None:
    """Writes the cells (grid_id, date, value) of a box by feature and year, for readers to prune.  A feature's years that are written again
    replace what was there; others stay."""
    kept = long_cells.withColumn("__ids", ids).filter(F.array_contains("__ids", F.col("grid_id"))).drop("__ids")
    kept.withColumns({"feature": F.lit(feature), "year": F.year("date")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature", "year").parquet(path)
