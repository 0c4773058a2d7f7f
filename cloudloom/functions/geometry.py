"""Rotations, covariances, cameras and spaces as column expressions. Vectors are tuples of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

Vec = Sequence[Column]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        out = out + p * q
    return out


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, eps: float = 0.0) -> tuple[Column, ...]:
    n = length(a) + eps
    return tuple(c / n for c in a)


def cross(a: Vec, b: Vec) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def rotation(q: Vec) -> list[list[Column]]:
    """3x3 matrix of a quaternion (w, x, y, z), normalised first."""
    n = F.sqrt(dot(q, q))
    w, x, y, z = (c / n for c in q)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def quaternion(r: Sequence[Sequence[Column]]) -> list[Column]:
    """Quaternion of a rotation matrix; the branch with the largest component is used."""
    trace = r[0][0] + r[1][1] + r[2][2]

    def root(c: Column) -> Column:
        return F.sqrt(F.greatest(c, F.lit(1e-24)))

    def branch(s: Column, at: int) -> list[Column]:
        a, b, c = r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]
        d, e, f = r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1]
        rows = ([None, a, b, c], [a, None, d, e], [b, d, None, f], [c, e, f, None])[at]
        return [s / 2 if v is None else v / (2 * s) for v in rows]

    options = [
        branch(root(1 + trace), 0),
        branch(root(1 + r[0][0] - r[1][1] - r[2][2]), 1),
        branch(root(1 - r[0][0] + r[1][1] - r[2][2]), 2),
        branch(root(1 - r[0][0] - r[1][1] + r[2][2]), 3),
    ]
    x_first = (r[0][0] > r[1][1]) & (r[0][0] > r[2][2])
    return [F.when(trace > 0, options[0][i]).when(x_first, options[1][i]).when(r[1][1] > r[2][2], options[2][i]).otherwise(options[3][i]) for i in range(4)]


def covariance(log_scales: Vec, q: Vec) -> dict[str, Column]:
    """R diag(exp(2 s)) R^T as its six distinct entries xx, xy, xz, yy, yz, zz."""
    r, v = rotation(q), [F.exp(2 * s) for s in log_scales]
    name = "xyz"
    return {name[i] + name[j]: r[i][0] * v[0] * r[j][0] + r[i][1] * v[1] * r[j][1] + r[i][2] * v[2] * r[j][2] for i in range(3) for j in range(i, 3)}


@dataclass(frozen=True)
class Camera:
    """A pinhole camera as plain numbers: rows of ``axes`` are right, up and back."""

    eye: tuple[float, float, float]
    axes: tuple[tuple[float, float, float], ...]
    focal: float
    size: int

    @classmethod
    def orbit(cls, centre: Sequence[float], radius: float, yaw: float = 30.0, pitch: float = 20.0, distance: float = 2.5, fov: float = 45.0, size: int = 64) -> Camera:
        """Looks at ``centre`` from ``distance`` radii away; angles in degrees, y is up."""
        a, b = math.radians(yaw), math.radians(pitch)
        back = (math.cos(b) * math.sin(a), math.sin(b), math.cos(b) * math.cos(a))
        right = (math.cos(a), 0.0, -math.sin(a))
        up = (back[1] * right[2] - back[2] * right[1], back[2] * right[0] - back[0] * right[2], back[0] * right[1] - back[1] * right[0])
        eye = tuple(c + radius * distance * v for c, v in zip(centre, back))
        return cls(eye, (right, up, back), 0.5 * size / math.tan(math.radians(fov) / 2), size)

    def to_camera(self, p: Vec) -> tuple[Column, ...]:
        """Coordinates along right, up and back; depth is minus the last."""
        d = [c - e for c, e in zip(p, self.eye)]
        return tuple(d[0] * a[0] + d[1] * a[1] + d[2] * a[2] for a in self.axes)

    def pixel(self, c: Vec) -> tuple[Column, Column, Column]:
        """(px, py, depth) of camera coordinates."""
        depth = -c[2]
        return self.focal * c[0] / depth + self.size / 2, -self.focal * c[1] / depth + self.size / 2, depth

    def view_covariance(self, cov: dict[str, Column]) -> dict[str, Column]:
        """W S W^T of a world covariance, by its six entries 00, 01, 02, 11, 12, 22."""
        s = [[cov["xx"], cov["xy"], cov["xz"]], [cov["xy"], cov["yy"], cov["yz"]], [cov["xz"], cov["yz"], cov["zz"]]]
        w, out = self.axes, {}
        for a in range(3):
            for b in range(a, 3):
                terms = [w[a][i] * w[b][j] * s[i][j] for i in range(3) for j in range(3)]
                out[f"{a}{b}"] = sum(terms[1:], terms[0])
        return out

    def screen_covariance(self, c: Vec, m: dict[str, Column], dilate: float = 0.1) -> tuple[Column, Column, Column]:
        """(a, b, c) of J M J^T + dilate I for camera coordinates and a view covariance.

        Give named columns, not expressions: each is used several times.
        """
        x, y, z = c
        f = self.focal
        j0, j1, j2, j3 = -f / z, f * x / (z * z), f / z, -f * y / (z * z)
        a = j0 * j0 * m["00"] + 2 * j0 * j1 * m["02"] + j1 * j1 * m["22"] + dilate
        b = j0 * j2 * m["01"] + j0 * j3 * m["02"] + j1 * j2 * m["12"] + j1 * j3 * m["22"]
        return a, b, j2 * j2 * m["11"] + 2 * j2 * j3 * m["12"] + j3 * j3 * m["22"] + dilate


def inverse_2x2(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Inverse of [[a, b], [b, c]]; a determinant within 1e-10 of zero counts as 1e-10."""
    det = a * c - b * b
    det = F.when(F.abs(det) < 1e-10, 1e-10).otherwise(det)
    return c / det, -b / det, a / det


def radius_3sigma(a: Column, b: Column, c: Column) -> Column:
    t, det = a + c, a * c - b * b
    return 3.0 * F.sqrt(0.5 * (t + F.sqrt(F.greatest(t * t - 4 * det, F.lit(0.0)))))


def contract(p: Vec) -> tuple[Column, ...]:
    """Unit ball unchanged, the rest drawn into radius 2."""
    r = length(p)
    k = F.when(r > 1, (2 - 1 / r) / r).otherwise(1.0)
    return tuple(c * k for c in p)


def uncontract(p: Vec) -> tuple[Column, ...]:
    r = length(p)
    k = F.when(r > 1, 1 / ((2 - r) * r)).otherwise(1.0)
    return tuple(c * k for c in p)


def ray_box(o: Vec, d: Vec, low: Sequence[float], high: Sequence[float]) -> tuple[Column, Column]:
    """(near, far) of a ray through a box; a miss has near > far."""
    t = []
    for i in range(3):
        inv = 1.0 / F.when(F.abs(d[i]) < 1e-12, 1e-12).otherwise(d[i])
        t.append(((low[i] - o[i]) * inv, (high[i] - o[i]) * inv))
    return F.greatest(F.lit(0.0), *[F.least(a, b) for a, b in t]), F.least(*[F.greatest(a, b) for a, b in t])


def disparity_t(i: Column, n: int, near: float, far: float) -> Column:
    """The i-th of n sample distances, even in 1/t."""
    s = (i + 0.5) / n
    return 1.0 / ((1 - s) / near + s / far)


def disparity_schedule(i: Column, n: int, near: float, far: float, inner: float = 2.5, share: float = 0.6) -> Column:
    """The i-th of n distances: a ``share`` of them even from near to ``inner``, the others even in 1/t from there to far."""
    k = max(2, min(n - 2, round(n * share)))
    first = near + (inner - near) * ((i + 0.5) / k)
    beyond = 1.0 / F.greatest(1 / inner + (1 / far - 1 / inner) * ((i - k + 0.5) / (n - k)), F.lit(1e-6))
    return F.when(i < k, first).otherwise(beyond)


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return 0.5 * length(cross([q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]))


def triangle_normal(a: Vec, b: Vec, c: Vec) -> tuple[Column, ...]:
    """Unit normal; (0, 1, 0) for a degenerate triangle."""
    n = cross([q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)])
    m = length(n)
    return tuple(F.when(m < 1e-12, F.lit(e)).otherwise(v / m) for v, e in zip(n, (0.0, 1.0, 0.0)))


def rotvec_matrix(v: Vec) -> list[list[Column]]:
    """Rodrigues' formula; the identity for tiny vectors."""
    t = length(v)
    k = [F.when(t < 1e-12, 0.0).otherwise(c / t) for c in v]
    s, c = F.sin(t), 1 - F.cos(t)
    return [
        [1 - c * (k[1] * k[1] + k[2] * k[2]), c * k[0] * k[1] - s * k[2], c * k[0] * k[2] + s * k[1]],
        [c * k[0] * k[1] + s * k[2], 1 - c * (k[0] * k[0] + k[2] * k[2]), c * k[1] * k[2] - s * k[0]],
        [c * k[0] * k[2] - s * k[1], c * k[1] * k[2] + s * k[0], 1 - c * (k[0] * k[0] + k[1] * k[1])],
    ]


def matrix_angle(r: Sequence[Sequence[Column]]) -> Column:
    """Rotation angle of a matrix in radians."""
    t = (r[0][0] + r[1][1] + r[2][2] - 1) / 2
    return F.acos(F.greatest(F.lit(-1.0), F.least(t, F.lit(1.0))))


def normal_quaternion(n: Vec) -> list[Column]:
    """Quaternion (w, x, y, z) that turns the z axis to a unit normal; half a turn about x for the opposite one."""
    half = F.acos(F.greatest(F.lit(-1.0), F.least(n[2], F.lit(1.0)))) / 2
    side = F.greatest(F.sqrt(n[0] * n[0] + n[1] * n[1]), F.lit(1e-9))
    same, back = F.abs(n[2] - 1) < 1e-6, F.abs(n[2] + 1) < 1e-6
    q = [F.cos(half), -n[1] / side * F.sin(half), n[0] / side * F.sin(half), F.lit(0.0)]
    return [F.when(same, a).when(back, b).otherwise(c) for a, b, c in zip((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), q)]


def orthographic(p: Vec, view: str) -> tuple[Column, Column]:
    """Plane coordinates of a view: 'top', 'front', 'side' or 'iso'."""
    x, y, z = p
    return {"top": (x, -y), "front": (x, -z), "side": (y, -z), "iso": (x - 0.5 * y, -0.5 * x - 0.5 * y - z)}[view]


def focal_pixels(equivalent_mm: Column, width: int, fov: float) -> Column:
    """Focal length in pixels of a 35 mm equivalent; where there is none, of a field of view in degrees."""
    return F.coalesce(F.when(equivalent_mm > 0, equivalent_mm * width / 36.0), F.lit(0.5 * width / math.tan(math.radians(fov) / 2)))
