"""Sensor products behind GDAL or h5py, for installations that have them; neither is needed otherwise.

They are opened on the driver and cut into row bands that executors read themselves, from shared paths.
Without the library a call raises ImportError. The libraries are absent where this is tested, so only the
parts that don't need them are.
"""

from __future__ import annotations

import glob
import os

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from ..raster import Raster, from_numpy


def bands(spark: SparkSession, name: str, rows: int = 256) -> Raster:
    """All bands of a GDAL dataset, read in row bands by the executors."""
    from osgeo import gdal

    ds = gdal.Open(name)
    n, ny, nx = ds.RasterCount, ds.RasterYSize, ds.RasterXSize
    is_complex = "C" in gdal.GetDataTypeName(ds.GetRasterBand(1).DataType)[:1]
    meta = dict(ds.GetMetadata()) | {f"CH_{k}": [ds.GetRasterBand(b + 1).GetMetadata().get(k) for b in range(n)] for k in ds.GetRasterBand(1).GetMetadata()}

    def read(batches):
        from osgeo import gdal as g

        for p in batches:
            for y0 in p["id"] * rows:
                h = min(rows, ny - int(y0))
                a = g.Open(name).ReadAsArray(0, int(y0), nx, h).reshape(n, h, nx)
                c, i, j = (k.ravel() for k in np.indices(a.shape))
                a = np.where(np.isfinite(a), a, 0).ravel()
                yield pd.DataFrame({"ch": c.astype("int32"), "y": i + int(y0), "x": j, "re": a.real.astype(float), "im": a.imag.astype(float)})

    df = spark.range(-(-ny // rows)).mapInPandas(read, "ch int, y long, x long, re double, im double")
    df = df if n > 1 else df.drop("ch")
    return Raster(df if is_complex else df.drop("im"), ny, nx, (n,) if n > 1 else (), "long", is_complex, meta)


def _one(pattern: str) -> str:
    found = sorted(glob.glob(pattern))
    if not found:
        raise FileNotFoundError(pattern)
    return found[0]


def envisat(spark: SparkSession, path: str) -> Raster:
    return bands(spark, path)


def palsar(spark: SparkSession, directory: str) -> Raster:
    return bands(spark, _one(os.path.join(directory, "VOL*")))


def radarsat2(spark: SparkSession, directory: str) -> Raster:
    return bands(spark, _one(os.path.join(directory, "product.xml")))


def terrasarx(spark: SparkSession, directory: str) -> Raster:
    return bands(spark, _one(os.path.join(directory, "T*X*.xml")))


def sentinel1(spark: SparkSession, directory: str, swath: int = 1) -> Raster:
    """The manifest's bands; of an SLC product the third sub-dataset of a swath."""
    from osgeo import gdal

    ds = gdal.Open(_one(os.path.join(directory, "manifest.safe")))
    if ds.GetMetadata().get("PRODUCT_TYPE") == "SLC":
        return bands(spark, ds.GetSubDatasets()[(swath - 1) * 3 + 2][0])
    return bands(spark, _one(os.path.join(directory, "manifest.safe")))


def airsar_matrix(r: Raster) -> Raster:
    """Six bands (HH, HX, HV*, XX, XV, VV products) to a Hermitian 3 x 3 matrix in the order HH, VV, XX."""
    from ..functions.cplx import at
    from ..operators.polar import _pix

    r = r.pix()
    b = [at(k) for k in range(6)]
    conj = lambda z: (z[0], -z[1])
    return _pix(r, [b[0], b[2], b[1], conj(b[2]), b[5], conj(b[4]), conj(b[1]), b[4], b[3]], (3, 3), CH_pol=[f"{p}{q}*" for p in ("HH", "VV", "XX") for q in ("HH", "VV", "XX")])


def airsar(spark: SparkSession, path: str) -> Raster:
    return airsar_matrix(bands(spark, path))


def convair(spark: SparkSession, path: str) -> Raster:
    from ..operators.geometry import rotateleft

    return rotateleft(bands(spark, path))


def kompsat5(spark: SparkSession, path: str, crop: tuple[int, int, int, int] = (0, 0, 0, 0)) -> Raster:
    """The image of an HDF5 product, two planes being real and imaginary parts."""
    import h5py

    with h5py.File(path, "r") as f:
        d = f["S01"]["SBI"]
        y1, x1 = crop[1] or d.shape[0], crop[3] or d.shape[1]
        a = d[crop[0] : y1, crop[2] : x1]
    return from_numpy(spark, a[..., 0] + 1j * a[..., 1] if a.ndim == 3 else a)


def save_hdf5(r: Raster, path: str) -> None:
    """Datasets D1..Dn and the metadata as attributes; for results that fit the driver."""
    import h5py

    a = r.to_numpy().reshape(-1, r.ny, r.nx)
    with h5py.File(path, "w") as f:
        for k, plane in enumerate(a, 1):
            f.create_dataset(f"D{k}", data=plane)
        for k, v in r.meta.items():
            f.attrs[k] = str(v)


def save_gdal(r: Raster, path: str, driver: str = "GTiff") -> None:
    from osgeo import gdal, gdal_array

    a = r.to_numpy().reshape(-1, r.ny, r.nx)
    ds = gdal.GetDriverByName(driver).Create(path, r.nx, r.ny, len(a), gdal_array.NumericTypeCodeToGDALTypeCode(a.dtype))
    for k, plane in enumerate(a, 1):
        ds.GetRasterBand(k).WriteArray(plane)
    ds.FlushCache()
