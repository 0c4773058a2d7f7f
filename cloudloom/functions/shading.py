"""Colour, local surface and light as column expressions. Vectors are tuples of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from cloudloom.functions.geometry import Vec, dot, unit
from cloudloom.functions.quant import clip, norm


def sh_basis(d: Vec) -> list[Column]:
    """The 16 real spherical harmonics of degree 0 to 3 (fixed values) at a unit direction."""
    x, y, z = d
    return [
        F.lit(0.28209479177387814),
        -0.4886025119029199 * y,
        0.4886025119029199 * z,
        -0.4886025119029199 * x,
        1.0925484305920792 * x * y,
        -1.0925484305920792 * y * z,
        0.31539156525252 * (3 * z * z - 1),
        -1.0925484305920792 * x * z,
        0.5462742152960395 * (x * x - y * y),
        -0.5900435899266435 * y * (3 * x * x - y * y),
        2.890611442640554 * x * y * z,
        -0.4570457994644658 * y * (5 * z * z - 1),
        0.3731763325901154 * z * (5 * z * z - 3),
        -0.4570457994644658 * x * (5 * z * z - 1),
        1.445305721320277 * z * (x * x - y * y),
        -0.5900435899266435 * x * (x * x - 3 * y * y),
    ]


def sh_colour(dc: Vec, rest: Column, d: Vec, bounded: bool = True) -> list[Column]:
    """Base colour plus 15 view-dependent terms a channel (channel-major)."""
    b = sh_basis(d)[1:]
    out = []
    for c in range(3):
        v = dc[c]
        for k in range(15):
            v = v + rest[15 * c + k].cast("double") * b[k]
        out.append(clip(v, 0.0, 1.0) if bounded else v)
    return out


def fibonacci_direction(i: Column, n: int) -> tuple[Column, Column, Column]:
    """The i-th of n directions of a golden-angle spiral."""
    y = 1 - 2 * (i + 0.5) / n
    r = F.sqrt(1 - y * y)
    a = i * (math.pi * (3 - math.sqrt(5)))
    return r * F.cos(a), y, r * F.sin(a)


# --- local surface: H(s, t) = k1 s^2 + k2 t^2 + chi (s^3 - 3 s t^2) + omega (3 s^2 t - t^3) + zeta (s^4 + t^4)


def germ_basis(s: Column, t: Column) -> list[Column]:
    return [s * s, t * t, s * s * s - 3 * s * t * t, 3 * s * s * t - t * t * t, s * s * s * s + t * t * t * t]


def germ_value(theta: Sequence[Column], s: Column, t: Column) -> Column:
    return dot(theta, germ_basis(s, t))


def germ_gradient(theta: Sequence[Column], s: Column, t: Column) -> tuple[Column, Column]:
    k1, k2, chi, om, ze = theta
    return 2 * k1 * s + chi * (3 * s * s - 3 * t * t) + om * 6 * s * t + 4 * ze * s * s * s, 2 * k2 * t - 6 * chi * s * t + om * (3 * s * s - 3 * t * t) + 4 * ze * t * t * t


def germ_hessian(theta: Sequence[Column], s: Column, t: Column) -> tuple[Column, Column, Column]:
    k1, k2, chi, om, ze = theta
    return 2 * k1 + 6 * chi * s + 6 * om * t + 12 * ze * s * s, -6 * chi * t + 6 * om * s, 2 * k2 - 6 * chi * s - 6 * om * t + 12 * ze * t * t


def wide_basis(s: Column, t: Column) -> list[Column]:
    """Nine terms: bias, two tilts, three quadratics, two cubics, one quartic."""
    return [F.lit(1.0), s, t, s * s, s * t, t * t, s * s * s - 3 * s * t * t, 3 * s * s * t - t * t * t, s * s * s * s + t * t * t * t]


def closest_on_germ(theta: Sequence[Column], sigma: Vec, u: Vec, rounds: int = 3, damping: float = 0.85, lam: float = 100.0) -> tuple[Column, Column]:
    """(s, t) after a fixed number of damped Newton steps on the squared distance to the germ, starting at (u0, u1).

    The minimised sum is (u0-s)^2/s0^2 + (u1-t)^2/s1^2 + (u2-H)^2/s2^2 + lam (s^2+t^2)^2;
    a determinant within 1e-12 of zero counts as 1e-12.
    """
    wa, wb, wn = (1 / (c * c) for c in sigma)

    def newton(at: Column, _: Column) -> Column:
        s, t = at["s"], at["t"]
        h, (hs, ht) = germ_value(theta, s, t), germ_gradient(theta, s, t)
        hss, hst, htt = germ_hessian(theta, s, t)
        r, q = u[2] - h, s * s + t * t
        gs = -2 * (u[0] - s) * wa - 2 * r * hs * wn + 4 * lam * q * s
        gt = -2 * (u[1] - t) * wb - 2 * r * ht * wn + 4 * lam * q * t
        a = 2 * wa + 2 * wn * (hs * hs - r * hss) + lam * (4 * q + 8 * s * s)
        b = 2 * wn * (hs * ht - r * hst) + 8 * lam * s * t
        c = 2 * wb + 2 * wn * (ht * ht - r * htt) + lam * (4 * q + 8 * t * t)
        det = a * c - b * b
        det = F.when(F.abs(det) < 1e-12, 1e-12).otherwise(det)
        return F.struct((s - damping * (c * gs - b * gt) / det).alias("s"), (t - damping * (a * gt - b * gs) / det).alias("t"))

    start = F.struct(u[0].cast("double").alias("s"), u[1].cast("double").alias("t"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, newton)
    return end["s"], end["t"]


def gaussian_density(m: Column) -> Column:
    """exp(-m / 2) of a squared Mahalanobis distance, its exponent floored at -20."""
    return F.exp(F.greatest(-0.5 * m, F.lit(-20.0)))


def curved_density(m: Column, k1: Column, k2: Column) -> Column:
    """Gaussian that falls faster where the surface is curved."""
    return F.exp(-F.least(0.5 * m * (1 + 0.5 * (F.abs(k1) + F.abs(k2)) * m), F.lit(20.0)))


def germ_density(m: Column, h: Column) -> Column:
    """Gaussian of the distance and the height of the germ."""
    return F.exp(-0.5 * F.least(m + h * h, F.lit(40.0)))


def mip_filter(a: Column, b: Column, c: Column, alpha: Column, r: Column | float) -> tuple[Column, Column, Column, Column]:
    """Screen covariance widened by r^2 I, and the opacity that keeps its integral."""
    r2 = (F.lit(r) if not isinstance(r, Column) else r) * r
    a2, c2 = a + r2, c + r2
    before, after = F.greatest(a * c - b * b, F.lit(1e-12)), F.greatest(a2 * c2 - b * b, F.lit(1e-12))
    return a2, b, c2, alpha * F.sqrt(before / after)


def band_norms(rest: Column, strided: bool = True) -> tuple[Column, Column, Column]:
    """Norms of the coefficients of degree 1, 2 and 3 of a channel-major array of 3 x 15.

    ``strided=False`` takes the slices 0:9, 9:24 and 24:45 as if the array were
    band-major; some writers' scores were made that way.
    """
    if not strided:
        return norm(F.slice(rest, 1, 9)), norm(F.slice(rest, 10, 15)), norm(F.slice(rest, 25, 21))

    def part(at: int, n: int) -> Column:
        return norm(F.concat(*[F.slice(rest, 15 * c + at + 1, n) for c in range(3)]))

    return part(0, 3), part(3, 5), part(8, 7)


def pbr_split(albedo: Vec, b1: Column, b2: Column, b3: Column) -> dict[str, Column]:
    """metallic, roughness and f0_{r,g,b} from base colour and band norms."""
    bands, bright = b1 + b2 + b3, F.sqrt(dot(albedo, albedo))
    m = bands / (bright + 1e-3) * (0.4 + 1.6 * b3 / F.greatest(bands, F.lit(1e-6)))
    metallic = F.least(1 / (1 + F.exp(-(m - 0.6) / 0.25)), F.lit(0.95))
    ratio = clip(b1 / F.greatest(b3, F.lit(1e-6)), 0.05, 20.0)
    rough = clip(0.5 + 0.2 * F.log(ratio), 0.05, 0.95)
    flat = bands < 0.02 * bright
    metallic, rough = F.when(flat, 0.05).otherwise(metallic), F.when(flat, 0.9).otherwise(rough)
    f0 = {f"f0_{n}": F.greatest(0.04 + metallic * (c - 0.04), F.lit(0.02)) for n, c in zip("rgb", albedo)}
    return {"metallic": metallic, "roughness": rough, **f0}


#: Material classes (fixed values of the format).
UNKNOWN, DIFFUSE, GLOSSY, MIRROR, EMISSIVE, FLOATER = 0, 1, 2, 3, 5, 6


def class_roughness(hint: Column, view_dep: Column) -> Column:
    """Width of the specular lobe by class; of unknown ones by view dependence."""
    return F.when(hint == DIFFUSE, 0.95).when(hint == GLOSSY, 0.4).when(hint == MIRROR, 0.05).when(hint == FLOATER, 1.0).when(hint == UNKNOWN, 0.9 - 0.7 * view_dep / 255.0).otherwise(0.6)


def class_f0(hint: Column, albedo: Column) -> Column:
    return F.when(hint == GLOSSY, 0.04 + 0.3 * (albedo - 0.04)).when(hint == MIRROR, clip(albedo, 0.0, 1.0)).when(hint == FLOATER, 0.0).otherwise(0.04)


def schlick(f0: Column, cosine: Column) -> Column:
    return f0 + (1 - f0) * F.pow(1 - cosine, F.lit(5.0))


def reflect(v: Vec, n: Vec) -> list[Column]:
    k = 2 * dot(v, n)
    return [k * b - a for a, b in zip(v, n)]


def ggx(n: Vec, v: Vec, l: Vec, rough: Column, f0: Column, cusp: Column | None = None) -> Column:
    """Cook-Torrance specular term of one channel; 0 with light or view below the horizon."""
    eps = 1e-6
    h = unit([a + b for a, b in zip(v, l)], eps)
    nl, nv, nh, vh = (F.greatest(dot(a, b), F.lit(0.0)) for a, b in ((n, l), (n, v), (n, h), (v, h)))
    a = rough if cusp is None else clip(rough + 0.2 * cusp, 0.02, 1.0)
    d = nh * nh * (a * a - 1) + 1
    k = (a + 1) * (a + 1) / 8
    spec = a * a / (math.pi * d * d + eps) * schlick(f0, vh) * (nv / (nv * (1 - k) + k + eps)) * (nl / (nl * (1 - k) + k + eps)) / (4 * nl * nv + eps)
    return F.when((nl > 0) & (nv > 0), spec).otherwise(0.0)


def aces(c: Column) -> Column:
    """Filmic tone curve (fixed values)."""
    return clip(c * (2.51 * c + 0.03) / (c * (2.43 * c + 0.59) + 0.14), 0.0, 1.0)


def to_srgb(c: Column) -> Column:
    v = clip(c, 0.0, 1.0)
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def luma(rgb: Vec) -> Column:
    return 0.2126 * rgb[0] + 0.7152 * rgb[1] + 0.0722 * rgb[2]


# --- light


def reflected(n: Vec, v: Vec) -> tuple[Column, ...]:
    """Unit reflection of -v about n."""
    return unit(reflect(v, n), 1e-9)


def sky_ambient(n: Vec, sun: Sequence[float], intensity: float = 0.65) -> list[Column]:
    """Ambient of a normal from zenith, horizon and ground, with a glow towards the sun (fixed colours). ``sun`` points away from it."""
    up = clip(n[1], -1.0, 1.0)
    top, flat, low = clip(up, 0.0, 1.0), clip(1 - F.abs(up), 0.0, 1.0), clip(-up, 0.0, 1.0)
    k = math.sqrt(sum(c * c for c in sun)) + 1e-9
    toward = clip(-(n[0] * (sun[0] / k) + n[1] * (sun[1] / k) + n[2] * (sun[2] / k)), 0.0, 1.0)
    glow = F.pow(toward, F.lit(8.0)) * 0.35
    colours = zip((0.55, 0.70, 0.95), (0.85, 0.88, 0.95), (0.35, 0.30, 0.25), (1.20, 1.05, 0.85))
    return [intensity * ((top * z + flat * h + low * g) / (top + flat + low + 1e-6) + glow * s) for z, h, g, s in colours]


def cusp_glint(nl: Column, cusp: Column, pixels: Column) -> Column:
    """Glint of a cusp over a footprint of so many pixels, before the light's colour."""
    away = 1 - clip(nl, 0.0, 1.0)
    return F.pow(clip(cusp, 0.0, 1.0), F.lit(1.5)) * F.exp(-(4.0 / (pixels + 1.0)) * away * away)


class Environment:
    """A procedural sky, sun and chequered ground, as linear RGB of directions (see ``operators.light``).

    ``sun`` points away from the sun. The colours are fixed values of the format; ``studio`` is its other preset.
    """

    def __init__(self, sun: Sequence[float], sun_rgb=(1.4, 1.30, 1.10), zenith=(0.45, 0.62, 0.92), horizon=(0.78, 0.85, 0.95), dark=(0.18, 0.16, 0.14), light=(0.45, 0.42, 0.38), disc=0.985, sharp=16.0, haze=0.08):
        k = math.sqrt(sum(c * c for c in sun)) + 1e-9
        self.sun = [c / k for c in sun]
        self.sun_rgb, self.zenith, self.horizon, self.dark, self.light, self.disc, self.sharp, self.haze = sun_rgb, zenith, horizon, dark, light, disc, sharp, haze

    @classmethod
    def studio(cls, sun: Sequence[float]) -> Environment:
        return cls(sun, (2.20, 2.05, 1.85), (0.78, 0.80, 0.85), (0.92, 0.92, 0.92), (0.30, 0.30, 0.30), (0.55, 0.55, 0.55), 0.992, 10.0, 0.04)

    def terms(self, d: Vec) -> dict[str, Column]:
        """What the colours of a unit direction depend on. Each is used several times: make columns of them."""
        x, y, z = d
        toward = clip(-(x * self.sun[0] + y * self.sun[1] + z * self.sun[2]), -1.0, 1.0)
        up = clip(y, -1.0, 1.0)
        down = F.when(y < 0, -1.0 / y)  # the way to a floor one below
        return {
            "up": up,
            "glow": F.pow(F.greatest(toward, F.lit(0.0)), F.lit(self.sharp)) * 0.45 + F.when(toward > self.disc, 4.0).otherwise(0.0),
            "band": 0.5 * (1 - F.abs(up) / self.haze),
            "chequer": F.pmod(F.floor(x * down * 1.7) + F.floor(z * down * 1.7), F.lit(2)).cast("double"),
            "near": F.exp(-0.08 * down * F.sqrt(x * x + y * y + z * z)),
        }

    def colours(self, t: dict[str, Column]) -> list[Column]:
        up, band, chequer, near, out = t["up"], t["band"], t["chequer"], t["near"], []
        for s, top, h, a, b in zip(self.sun_rgb, self.zenith, self.horizon, self.dark, self.light):
            sky = F.when(up > 0, F.sqrt(F.greatest(up, F.lit(0.0))) * top + F.greatest(F.lit(0.0), 1 - up) * h + t["glow"] * s).otherwise(0.0)
            sky = F.when(F.abs(up) < self.haze, sky * (1 - band) + h * 1.15 * band).otherwise(sky)
            out.append(F.when(up < -1e-3, (a * (1 - chequer) + b * chequer) * near + h * (1 - near)).otherwise(sky))
        return out


def lambert_light(albedo: Vec, n: Vec, light: Sequence[float], shadow: Column, ao: Column, ambient: Sequence[float], sun_rgb: Sequence[float]) -> list[Column]:
    """Sun with shadow, and ambient with occlusion. ``light`` points away from the sun and is a unit vector."""
    nl = F.greatest(F.lit(0.0), -(n[0] * light[0] + n[1] * light[1] + n[2] * light[2]))
    return [clip(s * a * nl * shadow + m * a * ao, 0.0, 1.0) for a, m, s in zip(albedo, ambient, sun_rgb)]


def bar1_light(albedo: Vec, n: Vec, v: Vec, light: Sequence[float], sun_rgb: Sequence[float], shadow: Column, ao: Column, hint: Column, view_dep: Column, cusp: Column, pixels: Column) -> list[Column]:
    """Lambert, sky ambient, specular lobe by material class, and cusp glint (strengths are fixed values)."""
    to = [F.lit(-c) for c in light]
    nl = F.greatest(F.lit(0.0), dot(n, to))
    rough, sky, glint = class_roughness(hint, view_dep), sky_ambient(n, light), cusp_glint(nl, cusp, pixels)
    out = []
    for a, m, s in zip(albedo, sky, sun_rgb):
        spec = 1.2 * ggx(n, v, to, rough, class_f0(hint, a), cusp) * s * nl * shadow + 0.6 * glint * s * shadow
        out.append(clip(s * a * nl * shadow + m * a * ao + spec, 0.0, 1.0))
    return out


def three_directions(eye: Sequence[float], centre: Sequence[float]) -> dict[str, tuple[float, float, float]]:
    """Key, fill and rim light, each pointing from its source to the scene (azimuth and elevation are fixed values)."""

    def norm(a):
        k = math.sqrt(sum(c * c for c in a)) + 1e-9
        return [c / k for c in a]

    def across(a, b):
        return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    ahead = norm([c - e for c, e in zip(centre, eye)])
    right = norm(across(ahead, (0.0, 1.0, 0.0)))
    up = norm(across(right, ahead))
    out = {}
    for name, az, el in (("key", 35.0, 25.0), ("fill", -50.0, 10.0), ("rim", 170.0, 35.0)):
        a, e = math.radians(az), math.radians(el)
        out[name] = tuple(-c for c in norm([math.cos(e) * math.sin(a) * r + math.sin(e) * u + math.cos(e) * math.cos(a) * f for r, u, f in zip(right, up, ahead)]))
    return out


def colour_grade(rgb: Vec, stops: float = 0.0, contrast: float = 1.05, saturation: float = 1.10) -> list[Column]:
    """Lift, gamma, gain (fixed values), contrast about a half, and saturation."""
    out = []
    for c, lift, gamma, gain in zip(rgb, (0.005, 0.005, 0.012), (1.00, 1.00, 0.98), (1.02, 1.00, 0.97)):
        out.append((F.pow(F.greatest(c * 2.0**stops + lift, F.lit(1e-9)), F.lit(1 / gamma)) * gain - 0.5) * contrast + 0.5)
    grey = luma(out)
    return [grey + (c - grey) * saturation for c in out]


def vignette(y: Column, x: Column, height: int, width: int, strength: float = 0.20, falloff: float = 1.6) -> Column:
    """The factor that darkens a pixel towards the corners."""
    cy, cx = (height - 1) / 2, (width - 1) / 2
    r2 = ((x - cx) / cx) * ((x - cx) / cx) + ((y - cy) / cy) * ((y - cy) / cy)
    return 1 - strength * F.pow(clip(r2, 0.0, 1.0), F.lit(falloff))


def equirect_pixel(d: Vec, height: int, width: int) -> tuple[Column, Column]:
    """(v, u): row and column of a direction in an equirectangular panorama."""
    x, y, z = unit(d, 1e-9)
    u = F.atan2(x, -z) / (2 * math.pi) + 0.5
    v = F.asin(clip(y, -1.0, 1.0)) / math.pi + 0.5
    hold = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(c), F.lit(n - 1))).cast("int")
    return hold((1 - v) * height, height), hold(u * width, width)


def eigenframe_density(a: Column, b: Column, c: Column, dx: Column, dy: Column, theta: Sequence[Column]) -> Column:
    """Germ density of a screen offset in the eigenframe of [[a, b], [b, c]]; without germ the Gaussian."""
    det = a * c - b * b
    det = F.when(F.abs(det) < 1e-10, 1e-10).otherwise(det)
    m = F.greatest((c * dx * dx - 2 * b * dx * dy + a * dy * dy) / det, F.lit(0.0))
    root = F.sqrt(F.greatest((a + c) * (a + c) - 4 * (a * c - b * b), F.lit(0.0)))
    one, two = 0.5 * (a + c + root), 0.5 * (a + c - root)
    turned = F.abs(b) > 1e-9
    vx = F.when(turned, one - c).when(a >= c, 1.0).otherwise(0.0)
    vy = F.when(turned, b).when(a >= c, 0.0).otherwise(1.0)
    k = F.sqrt(vx * vx + vy * vy) + 1e-12
    s = (dx * vx + dy * vy) / k / (F.sqrt(F.greatest(one, F.lit(1e-12))) + 1e-12)
    t = (dy * vx - dx * vy) / k / (F.sqrt(F.greatest(two, F.lit(1e-12))) + 1e-12)
    return germ_density(m, germ_value(theta, s, t))


def height_colour(z: Column, low: Column, high: Column) -> list[Column]:
    h = (z - low) / (high - low + 1e-9)
    return [clip(c, 0.0, 1.0) for c in (0.3 + 0.6 * h, 0.5 + 0.3 * (1 - h), 0.6 + 0.4 * h)]


def sh_sequence(dc: Vec, rest: Column, count: int = 12) -> Column:
    """3 * count colours of a splat: RGB at each of ``count`` spread directions, in [0, 1]."""
    basis = []
    for i in range(count):
        y = 1 - 2 * (i + 0.5) / count
        r, a = math.sqrt(1 - y * y), math.pi * (1 + math.sqrt(5)) * (i + 0.5)
        d = (math.cos(a) * r, math.sin(a) * r, y)
        basis.append(F.array(*[F.lit(float(v)) for v in _basis_at(d)]))

    def at(b: Column) -> Column:
        each = [F.aggregate(F.zip_with(F.slice(rest, 15 * c + 1, 15), b, lambda p, q: p.cast("double") * q), dc[c] * 0.28209479177387814 + 0.5, lambda s, v: s + v) for c in range(3)]
        return F.array(*[clip(e, 0.0, 1.0) for e in each])

    return F.flatten(F.transform(F.array(*basis), at))


def _basis_at(d: Sequence[float]) -> list[float]:
    """The 15 view-dependent basis values (fixed constants of ``sh_basis``) at a direction of plain numbers."""
    x, y, z = d
    return [
        -0.4886025119029199 * y, 0.4886025119029199 * z, -0.4886025119029199 * x,
        1.0925484305920792 * x * y, -1.0925484305920792 * y * z, 0.31539156525252 * (3 * z * z - 1), -1.0925484305920792 * x * z, 0.5462742152960395 * (x * x - y * y),
        -0.5900435899266435 * y * (3 * x * x - y * y), 2.890611442640554 * x * y * z, -0.4570457994644658 * y * (5 * z * z - 1), 0.3731763325901154 * z * (5 * z * z - 3), -0.4570457994644658 * x * (5 * z * z - 1), 1.445305721320277 * z * (x * x - y * y), -0.5900435899266435 * x * (x * x - 3 * y * y),
    ]


def material_class(dc: Vec, rest: Column, alpha: Column, kappa: Column, distance: Column, far: Column, flat: Column, strided: bool = False) -> tuple[Column, Column]:
    """(class, confidence): floater, emissive, mirror, glossy, diffuse or unknown, in that order (thresholds are fixed values).

    ``far`` and ``flat`` are the 90th percentile of ``distance`` and the 25th of ``kappa``.
    """
    base = (dc[0] + dc[1] + dc[2]) / 3 * 0.28209479177387814 + 0.5
    b1, _, b3 = band_norms(rest, strided)
    size = F.sqrt(dot(dc, dc)) + 1e-3
    ratio = norm(rest) / size
    votes = (distance > far).cast("int") + (kappa < flat).cast("int") + (alpha < 0.3).cast("int")
    rules = [
        (votes >= 2, FLOATER, F.least(votes * 80, F.lit(255))),
        ((F.least(base, F.lit(2.0)) > 1.0) & (b3 > 0.3), EMISSIVE, F.lit(200)),
        ((b3 / size > 1.5) & (alpha > 0.7), MIRROR, F.floor(clip(b3 * 50, 0, 255))),
        ((ratio > 0.5) & (b1 > b3 * 1.5), GLOSSY, F.floor(clip(ratio * 80, 0, 255))),
        ((ratio < 0.2) & (alpha > 0.5), DIFFUSE, F.greatest(255 - F.floor(ratio * 1000), F.lit(0))),
    ]
    hint, sure = F.lit(None).cast("int"), F.lit(None).cast("int")
    for rule, name, confidence in rules:
        hint = F.coalesce(hint, F.when(rule, F.lit(name)))
        sure = F.coalesce(sure, F.when(rule, confidence.cast("int")))
    return F.coalesce(hint, F.lit(UNKNOWN)), F.coalesce(sure, F.lit(0))
