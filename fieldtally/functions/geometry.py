"""Geometry and camera mathematics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 without overlap or area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when((w * h > 0) & (total > 0), w * h / F.when(total > 0, total)).otherwise(F.lit(0.0))


def affine(x: Column, y: Column, m: tuple) -> Column:
    """Struct (x, y) of a point under a, b, c, d, tx, ty."""
    a, b, c, d, tx, ty = m
    return F.struct((a * x + b * y + tx).alias("x"), (c * x + d * y + ty).alias("y"))


def affine_fit(px: str, py: str, qx: str, qy: str) -> list[Column]:
    """Aggregates a, b, tx, c, d, ty, rmse of the least-squares affine p -> q; null for fewer than 3 points or collinear ones.

    Nine moments of centred sums give the solution, so partial sums are all that crosses the network.
    """
    cov = lambda u, v: F.covar_pop(u, v)
    xx, yy, xy = cov(px, px), cov(py, py), cov(px, py)
    det = xx * yy - xy * xy
    ok = F.when((F.count(F.lit(1)) >= 3) & (det > 1e-9), det)
    a, b = (cov(px, qx) * yy - cov(py, qx) * xy) / ok, (cov(py, qx) * xx - cov(px, qx) * xy) / ok
    c, d = (cov(px, qy) * yy - cov(py, qy) * xy) / ok, (cov(py, qy) * xx - cov(px, qy) * xy) / ok
    tx = F.avg(qx) - a * F.avg(px) - b * F.avg(py)
    ty = F.avg(qy) - c * F.avg(px) - d * F.avg(py)
    rest = cov(qx, qx) - a * cov(px, qx) - b * cov(py, qx) + cov(qy, qy) - c * cov(px, qy) - d * cov(py, qy)
    names = ("a", "b", "tx", "c", "d", "ty", "rmse")
    return [v.alias(n) for v, n in zip((a, b, tx, c, d, ty, F.sqrt(F.greatest(rest, F.lit(0.0)))), names)]


def size_scale(tw: Column, th: Column, ww: Column, wh: Column) -> Column:
    """Scale from one frame size to another; 1 where a size is missing or 0."""
    ok = (ww > 0) & (wh > 0) & (tw > 0) & (th > 0)
    return F.struct(F.when(ok, tw / ww).otherwise(1.0).alias("sx"), F.when(ok, th / wh).otherwise(1.0).alias("sy"))


def rotated(ring: Column) -> Column:
    return F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Half-open ray casting over a ring of structs (x, y), closed or not."""

    def crosses(a: Column, b: Column) -> Column:
        rise = F.when(b["y"] != a["y"], b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < (b["x"] - a["x"]) * (y - a["y"]) / rise + a["x"], F.lit(False))

    return F.aggregate(F.zip_with(ring, rotated(ring), crosses), F.lit(False), lambda s, c: s != c)


def on_edge(x: Column, y: Column, ring: Column, tolerance: float = 1e-9) -> Column:
    """Whether a point lies on an edge of a ring."""

    def touches(a: Column, b: Column) -> Column:
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        inside = x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return (F.abs(cross) <= tolerance) & inside

    return F.exists(F.zip_with(ring, rotated(ring), touches), lambda t: t)


def covers(x: Column, y: Column, ring: Column) -> Column:
    """Containment with the boundary counted as inside."""
    return in_polygon(x, y, ring) | on_edge(x, y, ring)


def side(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(p1: Column, p2: Column, q1: Column, q2: Column) -> Column:
    """Proper crossing: an end on the other segment doesn't count."""
    d = lambda a, b, c: side(a["x"], a["y"], b["x"], b["y"], c["x"], c["y"])
    return (d(p1, p2, q1) * d(p1, p2, q2) < 0) & (d(q1, q2, p1) * d(q1, q2, p2) < 0)


def segment_touches(a: Column, b: Column, ring: Column) -> Column:
    """Whether a segment has an end in a polygon or crosses an edge of it."""
    edges = F.exists(F.zip_with(ring, rotated(ring), lambda p, q: segments_cross(a, b, p, q)), lambda c: c)
    return in_polygon(a["x"], a["y"], ring) | in_polygon(b["x"], b["y"], ring) | edges


def flat_footprint(x: Column, y: Column, z: Column, fovy: Column, yaw: Column, aspect: float = 4 / 3) -> Column:
    """Ring of the ground a camera sees over flat earth, turned by its yaw; altitudes below 1 count as 1."""
    h = F.greatest(z, F.lit(1.0)) * F.tan(F.radians(fovy / 2))
    w = h * aspect
    c, s = F.cos(F.radians(F.pmod(yaw, F.lit(360.0)))), F.sin(F.radians(F.pmod(yaw, F.lit(360.0))))
    corner = lambda i, j: F.struct((x + c * w * i - s * h * j).alias("x"), (y + s * w * i + c * h * j).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def pixel_ray(px: Column, py: Column, width: float, height: float, fovy: Column, yaw: Column, pitch: Column, aspect: float = 1.0) -> Column:
    """Struct (dx, dy, dz): direction of a pixel's ray; it goes down by 1 in the middle of a level camera's picture.

    The camera looks straight down at pitch 0; a pitch tips it about its own x axis, then the yaw turns it.
    """
    t = F.tan(F.radians(fovy) / 2)
    u, v = (2 * px / width - 1) * aspect * t, (1 - 2 * py / height) * t
    cp, sp, cy, sy = F.cos(F.radians(pitch)), F.sin(F.radians(pitch)), F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    dy = cp * v + sp
    return F.struct((cy * u - sy * dy).alias("dx"), (sy * u + cy * dy).alias("dy"), (sp * v - cp).alias("dz"))


def on_plane(d: Column, x: Column, y: Column, z: Column, ground: Column) -> Column:
    """Struct (x, y, range) where a ray (``pixel_ray``) from a place meets the plane z = ground, null for a level or rising ray."""
    k = (ground - z) / F.when(d["dz"] < -1e-9, d["dz"])
    return F.when(k.isNotNull(), F.struct((x + k * d["dx"]).alias("x"), (y + k * d["dy"]).alias("y"), F.sqrt((k * d["dx"]) ** 2 + (k * d["dy"]) ** 2).alias("range")))


def ground_ray(px: Column, py: Column, width: float, height: float, x: Column, y: Column, z: Column, fovy: Column, yaw: Column, pitch: Column, ground: Column, aspect: float = 1.0) -> Column:
    """Struct (x, y, range) where a pixel's ray (``pixel_ray``) meets the plane z = ground, null for a level or rising ray."""
    return on_plane(pixel_ray(px, py, width, height, fovy, yaw, pitch, aspect), x, y, z, ground)


def miss_reason(rays: Column, lx: float, hx: float, ly: float, hy: float) -> Column:
    """Why a box's corner rays (array of ``ground_ray``) missed a mesh: other, beyond_mesh or above_horizon."""
    down = F.filter(rays, lambda r: r.isNotNull())
    inside = F.exists(down, lambda r: r["x"].between(lx, hx) & r["y"].between(ly, hy))
    return F.when(inside, "other").when(F.size(down) > 0, "beyond_mesh").when(F.size(rays) > 0, "above_horizon").otherwise("other")


def project(x: Column, y: Column, z: Column, cx: Column, cy: Column, cz: Column, fovy: Column, yaw: Column, pitch: Column, width: float, height: float, aspect: float = 1.0) -> Column:
    """Struct (px, py): pixel of a world point, by perspective divide without a cull; the inverse of ``ground_ray``."""
    dx, dy, dz = x - cx, y - cy, z - cz
    c, s = F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    ux, uy = c * dx + s * dy, -s * dx + c * dy
    cp, sp = F.cos(F.radians(pitch)), F.sin(F.radians(pitch))
    vy, depth = cp * uy + sp * dz, cp * dz * -1 + sp * uy
    t = F.tan(F.radians(fovy) / 2)
    w = F.when(depth != 0, depth)
    return F.struct(((ux / w / (aspect * t) + 1) * width / 2).alias("px"), ((1 - vy / w / t) * height / 2).alias("py"))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone: 326xx north, 327xx south, zones 1 to 60."""
    zone = F.greatest(F.lit(1), F.least(F.lit(60), ((lon + 180) / 6).cast("int") + 1))
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def is_utm(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


# WGS 84 ellipsoid and the transverse Mercator projection of UTM.
_A, _FLAT, _K0, _EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def to_utm(lon: Column, lat: Column) -> Column:
    """Struct (easting, northing) by Krueger's series to third order; northing with 10,000 km added in the south."""
    n = _FLAT / (2 - _FLAT)
    big_a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    zone = F.greatest(F.lit(1), F.least(F.lit(60), ((lon + 180) / 6).cast("int") + 1))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((_EAST + _K0 * big_a * east).alias("easting"), (_K0 * big_a * north + F.when(lat < 0, 10_000_000.0).otherwise(0.0)).alias("northing"))


def from_utm(easting: Column, northing: Column, epsg: Column) -> Column:
    """Struct (lon, lat) of a UTM position, the inverse of ``to_utm``; null where the code names no UTM zone.

    Krueger's inverse series to third order, whose rest is below a tenth of a millimetre within a zone.
    """
    n = _FLAT / (2 - _FLAT)
    big_a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (northing - F.when(epsg >= 32700, 10_000_000.0).otherwise(0.0)) / (_K0 * big_a)
    eta = (easting - _EAST) / (_K0 * big_a)
    up, out = xi, eta
    for j, b in enumerate(beta, 1):
        up = up - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        out = out - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(up) / F.cosh(out))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    lon = epsg % 100 * 6 - 183 + F.degrees(F.atan2(F.sinh(out), F.cos(up)))
    return F.when(is_utm(epsg), F.struct(lon.alias("lon"), F.degrees(phi).alias("lat")))


def tile(lon: Column, lat: Column, zoom: int) -> Column:
    """Slippy-map tile (x, y) of a position."""
    n = float(1 << zoom)
    y = (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n
    return F.struct(((lon + 180) / 360 * n).cast("int").alias("x"), y.cast("int").alias("y"))


def tile_corner(x: Column, y: Column, zoom: int) -> Column:
    """North-west corner (lon, lat) of a tile."""
    n = float(1 << zoom)
    return F.struct((x / n * 360 - 180).alias("lon"), F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n)))).alias("lat"))


def wrap_degrees(v: Column) -> Column:
    return F.pmod(v + 180, F.lit(360.0)) - 180


def wrap_radians(v: Column) -> Column:
    return F.pmod(v + math.pi, F.lit(2 * math.pi)) - math.pi


def circles_meet(d: Column, r1: Column, r2: Column) -> Column:
    return d.between(F.abs(r1 - r2), r1 + r2)


def lognormal_interval(estimate: Column, cv: Column, z: float = 1.96) -> Column:
    spread = F.exp(z * F.sqrt(F.log(1 + cv * cv)))
    return F.struct((estimate / spread).alias("low"), (estimate * spread).alias("high"))


def crop_window(box: list[Column], padding: float, square: bool, size: tuple[Column, Column] | None = None) -> Column:
    """Window around a box's centre, grown by ``padding`` on each side, squared to the longer side; may leave the image."""
    w = size[0] if size else F.abs(box[2] - box[0])
    h = size[1] if size else F.abs(box[3] - box[1])
    w, h = w * (1 + 2 * padding), h * (1 + 2 * padding)
    if square:
        w = h = F.greatest(w, h)
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    return F.struct((cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def unit_box(box: list[Column], width: float, height: float) -> Column:
    """Centre and size in parts of the image."""
    return F.struct(((box[0] + box[2]) / 2 / width).alias("cx"), ((box[1] + box[3]) / 2 / height).alias("cy"), ((box[2] - box[0]) / width).alias("w"), ((box[3] - box[1]) / height).alias("h"))


def world_to_raster(x: Column, y: Column, left: float, top: float, pixel: float) -> Column:
    """Raster position (col, row) of a north-up grid."""
    return F.struct(((x - left) / pixel).alias("col"), ((top - y) / pixel).alias("row"))


def diagonal_focal(fov_diagonal: Column, width: float, height: float) -> Column:
    """Focal length in pixels of a diagonal field of view in degrees."""
    return math.hypot(width, height) / 2 / F.tan(F.radians(fov_diagonal) / 2)


def area_text(m2: Column) -> Column:
    """Area with a unit: square kilometres, hectares or square metres. Ties go to the even digit."""
    return F.when(m2 >= 1e6, F.format_string("%.2f km2", F.bround(m2 / 1e6, 2))).when(m2 >= 1e4, F.format_string("%.2f ha", F.bround(m2 / 1e4, 2))).otherwise(F.format_string("%.0f m2", F.bround(m2, 0)))


def usable_origin(x: Column, y: Column) -> Column:
    """A terrain origin, or 0, 0 where it looks like degrees."""
    degrees = (F.abs(x) <= 180) & (F.abs(y) <= 90)
    return F.struct(F.when(degrees, 0.0).otherwise(x).alias("x"), F.when(degrees, 0.0).otherwise(y).alias("y"))


def padded_bounds(ax: Column, ay: Column, bx: Column, by: Column, pad: float) -> Column:
    return F.struct((F.least(ax, bx) - pad).alias("lx"), (F.least(ay, by) - pad).alias("ly"), (F.greatest(ax, bx) + pad).alias("hx"), (F.greatest(ay, by) + pad).alias("hy"))


def range_gap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Frames between two ranges; 0 where they overlap."""
    return F.greatest(F.lit(0), b1 - a2, a1 - b2)


def sees_tile(x: Column, y: Column, alt: Column, fovy: Column, box: tuple, factor: float = 2.5) -> Column:
    """Whether a shot's circle of view touches a tile (lx, ly, hx, hy); shots below 1 m always count."""
    r = factor * alt * F.tan(F.radians(fovy) / 2)
    dx = x - F.greatest(F.lit(box[0]), F.least(F.lit(box[2]), x))
    dy = y - F.greatest(F.lit(box[1]), F.least(F.lit(box[3]), y))
    return (alt < 1) | (dx * dx + dy * dy <= r * r)
