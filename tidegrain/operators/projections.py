"""Map projections of the ellipsoid, forward as columns and in numpy, back in numpy; told from WKT, from the keys of a GeoTIFF, or by EPSG code.

Formulas: Snyder 1987 (equal-area and conformal cones, sinusoidal); Krueger's series in n to the fourth order for transverse Mercator, which
is good to well under a millimetre within some thousand kilometres of the central meridian.  WGS84 and NAD83 places are taken as equal; other
datums are not shifted."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.grid_blocks import Read, tiff_fields
from .spatial import GRS80, WGS84, albers, albers_inverse  # noqa: F401


class _Columns:
    """numpy's names for the functions of columns."""

    sin, cos, tan, sqrt, log, exp, arctan2, arcsinh, arctanh, sinh, cosh, radians = F.sin, F.cos, F.tan, F.sqrt, F.log, F.exp, F.atan2, F.asinh, F.atanh, F.sinh, F.cosh, F.radians


@dataclass(frozen=True)
class Projection:
    """kind: degrees, albers, lambert, mercator (transverse), sinusoidal or web.  Parallels, origin and meridian in degrees; the rest in metres,
    but `unit`, metres of one unit of x and y."""

    kind: str
    lat_1: float = 0.0
    lat_2: float = 0.0
    lat_0: float = 0.0
    lon_0: float = 0.0
    scale: float = 1.0
    false_x: float = 0.0
    false_y: float = 0.0
    unit: float = 1.0
    ellipsoid: tuple[float, float] = WGS84

    def columns(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return self._forward(lon, lat, _Columns)

    def forward(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._forward(np.asarray(lon, float), np.asarray(lat, float), np)

    def inverse(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By Newton steps on the forward formulas."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        if self.kind == "degrees":
            return x, y
        lon, lat = np.full(x.shape, self.lon_0), np.full(x.shape, (self.lat_1 + self.lat_2) / 2 if self.kind in ("albers", "lambert") else self.lat_0)
        for _ in range(30):
            fx, fy = self.forward(lon, lat)
            d = 1e-5
            (ax, ay), (bx, by) = self.forward(lon + d, lat), self.forward(lon, lat + d)
            ax, ay, bx, by = (ax - fx) / d, (ay - fy) / d, (bx - fx) / d, (by - fy) / d
            det, dx, dy = ax * by - bx * ay, x - fx, y - fy
            step_lon, step_lat = (dx * by - dy * bx) / det, (dy * ax - dx * ay) / det
            lon, lat = lon + np.clip(step_lon, -30, 30), np.clip(lat + np.clip(step_lat, -20, 20), -89.9, 89.9)
            if not x.size or max(np.abs(step_lon).max(), np.abs(step_lat).max()) < 1e-12:
                break
        return lon, lat

    def _forward(self, lon, lat, m):
        if self.kind == "degrees":
            return lon, lat
        x, y = getattr(self, f"_{self.kind}")(m.radians(lon - self.lon_0), m.radians(lat), m)
        return (x + self.false_x) / self.unit, (y + self.false_y) / self.unit

    def _eccentricity(self) -> float:
        f = self.ellipsoid[1]
        return math.sqrt(f * (2 - f))

    def _albers(self, dlon, lat, m):
        e = self._eccentricity()
        q = lambda s, log: (1 - e * e) * (s / (1 - e * e * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))
        s1, s2, s0 = (math.sin(math.radians(p)) for p in (self.lat_1, self.lat_2, self.lat_0))
        m1, m2 = (math.cos(math.radians(p)) / math.sqrt(1 - (e * s) ** 2) for p, s in ((self.lat_1, s1), (self.lat_2, s2)))
        n = (m1**2 - m2**2) / (q(s2, math.log) - q(s1, math.log)) if self.lat_1 != self.lat_2 else s1
        c, a = m1**2 + n * q(s1, math.log), self.ellipsoid[0]
        rho = a / n * m.sqrt(c - n * q(m.sin(lat), m.log))
        return rho * m.sin(n * dlon), a / n * math.sqrt(c - n * q(s0, math.log)) - rho * m.cos(n * dlon)

    def _lambert(self, dlon, lat, m):
        e, a = self._eccentricity(), self.ellipsoid[0]
        # log t of Snyder's t(lat)
        log_t = lambda s, lib: (lib.log((1 - s) / (1 + s)) - e * lib.log((1 - e * s) / (1 + e * s))) / 2
        s1, s2, s0 = (math.sin(math.radians(p)) for p in (self.lat_1, self.lat_2, self.lat_0))
        m1, m2 = (math.cos(math.radians(p)) / math.sqrt(1 - (e * s) ** 2) for p, s in ((self.lat_1, s1), (self.lat_2, s2)))
        n = (math.log(m1) - math.log(m2)) / (log_t(s1, math) - log_t(s2, math)) if self.lat_1 != self.lat_2 else s1
        f = a * self.scale * m1 / n * math.exp(-n * log_t(s1, math))
        rho = f * m.exp(n * log_t(m.sin(lat), m))
        return rho * m.sin(n * dlon), f * math.exp(n * log_t(s0, math)) - rho * m.cos(n * dlon)

    def _mercator(self, dlon, lat, m):
        a, f = self.ellipsoid
        n = f / (2 - f)
        radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        k = 2 * math.sqrt(n) / (1 + n)
        t = lambda s, lib: lib.sinh(lib.atanh(s) - k * lib.atanh(k * s)) if lib is math else lib.sinh(lib.arctanh(s) - k * lib.arctanh(k * s))
        tau = t(m.sin(lat), m)
        xi, eta = m.arctan2(tau, m.cos(dlon)), m.arcsinh(m.sin(dlon) / m.sqrt(tau * tau + m.cos(dlon) * m.cos(dlon)))
        x, y = eta, xi
        for j, c in enumerate(alpha, 1):
            x, y = x + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta), y + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        xi_0 = math.atan(t(math.sin(math.radians(self.lat_0)), math))
        start = xi_0 + sum(c * math.sin(2 * j * xi_0) for j, c in enumerate(alpha, 1))
        return self.scale * radius * x, self.scale * radius * (y - start)

    def _sinusoidal(self, dlon, lat, m):
        a, f = self.ellipsoid
        e2 = f * (2 - f)
        arc = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * m.sin(2 * lat)
        arc = arc + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * m.sin(4 * lat) - 35 * e2**3 / 3072 * m.sin(6 * lat)
        s = m.sin(lat)
        return a * dlon * m.cos(lat) / m.sqrt(1 - e2 * s * s), a * arc

    def _web(self, dlon, lat, m):
        s = m.sin(lat)
        return self.ellipsoid[0] * dlon, self.ellipsoid[0] / 2 * m.log((1 + s) / (1 - s))


#: Radius of the sphere of the sinusoidal tiles of satellite products.
SPHERE = (6371007.181, 0.0)


def of_epsg(code: int) -> Projection:
    if code in (4326, 4269):
        return Projection("degrees")
    if code == 3857:
        return Projection("web")
    if code in (5070, 5069):
        return Projection("albers", 29.5, 45.5, 23.0, -96.0, ellipsoid=GRS80)
    for first, south, ellipsoid in ((32600, False, WGS84), (32700, True, WGS84), (26900, False, GRS80)):
        if first < code <= first + 60:
            return Projection("mercator", lon_0=(code - first) * 6.0 - 183, scale=0.9996, false_x=500_000.0, false_y=10_000_000.0 if south else 0.0, ellipsoid=ellipsoid)
    raise ValueError(f"no projection for EPSG {code}")


#: Names of projections in WKT, and kinds by the codes of GeoTIFF keys.  Fixed values.
WKT_KINDS = {"albers": "albers", "lambert_conformal_conic": "lambert", "transverse_mercator": "mercator", "sinusoidal": "sinusoidal"}
KEY_KINDS = {1: "mercator", 8: "lambert", 9: "lambert", 11: "albers", 24: "sinusoidal"}


def of_wkt(text: str) -> Projection:
    """From the WKT (version 1) of a .prj file."""
    number = r"\s*,\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    spheroid = re.search(r'(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"' + number + number, text)
    a, inverse = (float(v) for v in spheroid.groups()) if spheroid else (WGS84[0], 1 / WGS84[1])
    ellipsoid = (a, 1 / inverse if inverse else 0.0)
    named = re.search(r'PROJECTION\s*\[\s*"([^"]*)"', text)
    if named is None:
        return Projection("degrees", ellipsoid=ellipsoid)
    p = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\s*\[\s*"([^"]*)"' + number, text)}
    name = named[1].lower()
    if "auxiliary_sphere" in name:
        return Projection("web", ellipsoid=ellipsoid)
    kind = next((v for k, v in WKT_KINDS.items() if name.startswith(k)), None)
    if kind is None:
        raise ValueError(f"no projection {named[1]}")
    unit = float(re.findall(r'UNIT\s*\[\s*"[^"]*"' + number, text)[-1])
    get = lambda *names: next((p[n] for n in names if n in p), 0.0)
    lat_0 = get("latitude_of_origin", "latitude_of_center")
    lat_1 = get("standard_parallel_1") if "standard_parallel_1" in p else lat_0
    return Projection(kind, lat_1, p.get("standard_parallel_2", lat_1), lat_0, get("central_meridian", "longitude_of_center"), p.get("scale_factor", 1.0), get("false_easting") * unit, get("false_northing") * unit, unit, ellipsoid)


def of_tiff(read: Read) -> Projection:
    """From the keys of a GeoTIFF; without any, degrees."""
    _, f = tiff_fields(read)
    directory, doubles = f.get(34735, (1, 1, 0, 0)), f.get(34736, ())
    keys = {}
    for k in range(4, len(directory) - 3, 4):
        key, where, n, value = directory[k : k + 4]
        keys[key] = value if where == 0 else doubles[value] if where == 34736 and n == 1 else None
    code = keys.get(3072, 32767 if 3075 in keys else 0)
    if keys.get(1024) != 1 and 3075 not in keys:
        return Projection("degrees")
    if code not in (0, 32767):
        return of_epsg(code)
    kind = KEY_KINDS.get(keys.get(3075))
    if kind is None:
        raise ValueError(f"no projection of kind {keys.get(3075)}")
    get = lambda *names: next((float(keys[n]) for n in names if keys.get(n) is not None), 0.0)
    inverse = get(2059)
    ellipsoid = (get(2057), 1 / inverse if inverse else 0.0) if keys.get(2057) else GRS80 if keys.get(2048) == 4269 else WGS84
    lat_0 = get(3085, 3081)
    lat_1 = get(3078) if keys.get(3078) is not None else lat_0
    return Projection(kind, lat_1, get(3079) or lat_1, lat_0, get(3084, 3080, 3088), get(3092) or 1.0, get(3082, 3086), get(3083, 3087), 1.0, ellipsoid)
