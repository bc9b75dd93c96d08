"""Scalar kernels as column expressions: depth errors, boxes, poses, text, timing. Only the Unicode compatibility form of labels leaves the JVM."""

from __future__ import annotations

import math
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# -- depth: pixel rows are aggregated ------------------------------------------------------------------------------------


def valid_depth(pred: Column, truth: Column, low: float, high: float) -> Column:
    """Pixels that count: a finite truth strictly inside the range, a finite positive prediction."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce(fine(truth) & (truth > low) & (truth < high) & fine(pred) & (pred > 0), F.lit(False))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def depth_aggregates(pred: Column, truth: Column) -> dict[str, Column]:
    """Errors and accuracies over the rows of a group; an empty group has error 0 and accuracy 1."""
    p = F.greatest(pred, F.lit(1e-6))
    worst = F.greatest(p / truth, truth / p)
    log = F.ln(p) - F.ln(truth)
    zero, one = (lambda c: F.coalesce(c, F.lit(0.0))), (lambda c: F.coalesce(c, F.lit(1.0)))
    share = lambda power: one(F.avg((worst < 1.25**power).cast("double")))
    return {
        "absrel": zero(F.avg(F.abs(p - truth) / truth)), "sqrel": zero(F.avg((p - truth) * (p - truth) / truth)), "rmse": zero(F.sqrt(F.avg((p - truth) * (p - truth)))),
        "mae": zero(F.avg(F.abs(p - truth))), "log_rmse": zero(F.sqrt(F.avg(log * log))), "silog": zero(F.stddev_pop(log)),
        "irmse": zero(F.sqrt(F.avg((1 / p - 1 / truth) * (1 / p - 1 / truth)))), "delta1": share(1), "delta2": share(2), "delta3": share(3),
    }


def band(value: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the half-open band [edges[i], edges[i + 1]) that a value is in; null outside."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges, edges[1:], names))):
        out = F.when((value >= low) & (value < high), F.lit(name)).otherwise(out)
    return out


ROTATION_EDGES = [0.0, 15.0, 45.0, 90.0, math.inf]
ROTATION_BINS = ["0-15", "15-45", "45-90", "90-180"]

# -- boxes: (x1, y1, x2, y2) -----------------------------------------------------------------------------------------------

Box = tuple[Column, Column, Column, Column]


def box_valid(b: Box, width: Column, height: Column) -> Column:
    x1, y1, x2, y2 = b
    fine = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.coalesce(fine & (x1 >= 0) & (y1 >= 0) & (x2 >= x1) & (y2 >= y1) & (x2 < width) & (y2 < height), F.lit(False))


def _overlap(a: Box, b: Box, plus: int) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + plus
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + plus
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def _area(b: Box, plus: int) -> Column:
    return F.greatest(b[2] - b[0] + plus, F.lit(0)) * F.greatest(b[3] - b[1] + plus, F.lit(0))


def box_iou(a: Box, b: Box, inclusive: bool = False) -> Column:
    """Intersection over union; inclusive boxes hold their last pixel too."""
    plus = int(inclusive)
    union = _area(a, plus) + _area(b, plus) - _overlap(a, b, plus)
    return F.when(union > 0, _overlap(a, b, plus) / F.nullif(union, F.lit(0))).otherwise(0.0)


def box_giou(a: Box, b: Box, inclusive: bool = True) -> Column:
    """Intersection over union less the share of the hull that neither box covers."""
    plus = int(inclusive)
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0]) + plus) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]) + plus)
    union = _area(a, plus) + _area(b, plus) - _overlap(a, b, plus)
    return box_iou(a, b, inclusive) - F.when(hull > 0, (hull - union) / F.nullif(hull, F.lit(0))).otherwise(0.0)


def center_inside(a: Box, b: Box) -> Column:
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return (x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3])


def scaled_box(b: Box, width: Column, height: Column) -> Box:
    """Pixel box of a box in [0, 1] (if all four numbers are) or on a grid of [0, 1000], neither rounded nor clamped; nulls for numbers
    off the grid or corners out of order."""
    unit = F.greatest(*b) <= 1
    scale = F.when(unit, 1.0).otherwise(1000.0)
    fine = (F.least(*b) >= 0) & (F.greatest(*b) <= 1000) & (b[0] <= b[2]) & (b[1] <= b[3])
    at = lambda c, size: F.when(fine, c * (size - 1) / scale)
    return at(b[0], width), at(b[1], height), at(b[2], width), at(b[3], height)


# -- poses -----------------------------------------------------------------------------------------------------------------

Vec = list[Column]


def dot(a: Vec, b: Vec) -> Column:
    return sum((x * y for x, y in zip(a, b)), F.lit(0.0))


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def quaternion_angle(a: Vec, b: Vec) -> Column:
    """Degrees between two unit quaternions; a quaternion and its negative are the same rotation."""
    return F.degrees(2 * F.acos(F.least(F.abs(dot(a, b)), F.lit(1.0))))


def quaternion_matrix(q: Vec) -> list[Vec]:
    """Rotation matrix of a unit quaternion (x, y, z, w)."""
    x, y, z, w = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def rotation_error(a: list[Vec], b: list[Vec]) -> Column:
    """Degrees between two rotation matrices."""
    trace = sum((a[i][j] * b[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.least((trace - 1) / 2, F.lit(1.0)), F.lit(-1.0))))


def translation_error(a: Vec, b: Vec) -> Column:
    return norm([x - y for x, y in zip(a, b)])


def direction_error(a: Vec, b: Vec, tiny: float = 1e-9) -> Column:
    """Degrees between two translations; 180 where one is shorter than tiny."""
    size = norm(a) * norm(b)
    angle = F.degrees(F.acos(F.greatest(F.least(dot(a, b) / F.nullif(size, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))))
    return F.when((norm(a) < tiny) | (norm(b) < tiny), F.lit(180.0)).otherwise(angle)


def compose(acc: Column, step: Column) -> Column:
    """Product of two rigid motions, each an array of 12 numbers (rows of the rotation, then the translation)."""
    r = lambda m, i, j: m[3 * i + j]
    rotation = [sum((r(acc, i, k) * r(step, k, j) for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)]
    move = [sum((r(acc, i, k) * step[9 + k] for k in range(3)), F.lit(0.0)) + acc[9 + i] for i in range(3)]
    return F.array(*rotation, *move)


IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]


def chain(steps: Column) -> Column:
    """Product of an array of motions in order."""
    return F.aggregate(steps, F.array(*[F.lit(x) for x in IDENTITY]), compose)


def inverse(m: Column) -> Column:
    """Inverse of a rigid motion (12 numbers)."""
    r = lambda i, j: m[3 * j + i]  # noqa: E731  transposed
    move = [-sum((r(i, k) * m[9 + k] for k in range(3)), F.lit(0.0)) for i in range(3)]
    return F.array(*[r(i, j) for i in range(3) for j in range(3)], *move)


def relative(a: Column, b: Column) -> Column:
    """Motion from pose a to pose b, in a's axes."""
    return compose(inverse(a), b)


#: Signs of the axes between the two camera conventions (y and z point the other way).
AXIS_SIGNS = (1.0, -1.0, -1.0)


def flip_axes(m: Column) -> Column:
    """A motion in the other camera convention: axes flipped on both sides."""
    s = AXIS_SIGNS
    return F.array(*[m[3 * i + j] * (s[i] * s[j]) for i in range(3) for j in range(3)], *[m[9 + i] * s[i] for i in range(3)])


def motion(q: Vec, t: Vec) -> Column:
    """A motion from a unit quaternion and a translation."""
    return F.array(*[x for row in quaternion_matrix(q) for x in row], *t)


def motion_angle(m: Column) -> Column:
    """Degrees that a motion turns by."""
    return F.degrees(F.acos(F.greatest(F.least((m[0] + m[4] + m[8] - 1) / 2, F.lit(1.0)), F.lit(-1.0))))


# -- text ------------------------------------------------------------------------------------------------------------------

#: Spellings that mean the same, by kind of attribute.
COLOUR_ALIASES = {"gray": "grey"}
FUNCTION_ALIASES = {"to drink": "drink", "to eat": "eat", "to snack": "snack"}


@F.arrow_udf(StringType())
def compatible(texts: pa.Array) -> pa.Array:
    """Unicode compatibility form (NFKC); the JVM's functions have none."""
    plain = (t.as_py() for t in texts)
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in plain], pa.string())


def normal_label(text: Column) -> Column:
    """Compatibility form, lower case, underscores as spaces, letters, digits and hyphens of any script kept, single spaces."""
    plain = F.regexp_replace(F.lower(compatible(text)), "_", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\p{L}\p{N}\s-]", ""), r"(?U)\s+", " "))


def canonical(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case and single spaces, then the aliases of the value's kind."""
    label = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    out = label
    for a, b in (aliases or {}).items():
        out = F.when(label == a, F.lit(b)).otherwise(out)
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(normal_label(text), " "), lambda w: w != "")


def token_f1(pred: Column, truth: Column) -> Column:
    """F1 of two arrays of words (see words) as multisets; 0 where either is empty or null."""
    nothing = F.array().cast("array<string>")
    p, t = F.coalesce(pred, nothing), F.coalesce(truth, nothing)
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(F.array_intersect(p, t), F.lit(0), lambda acc, w: acc + F.least(count(p, w), count(t, w)))
    return F.when(common == 0, 0.0).otherwise(2.0 * common / (F.size(p) + F.size(t)))


def only_box(text: Column) -> Column:
    """The four numbers of the one box in a text, as an array; null if there is none or more than one."""
    number = r"\s*(-?\d+(?:\.\d+)?)\s*"
    found = F.regexp_extract_all(text, F.lit(r"\[" + ",".join([number] * 4) + r"\]"), F.lit(0))
    parts = F.transform(F.split(F.regexp_replace(found[0], r"[\[\]\s]", ""), ","), lambda x: x.cast("double"))
    return F.when(F.size(found) == 1, parts)


def metadata_field(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


# -- timing ----------------------------------------------------------------------------------------------------------------


def roofline(flops: Column, traffic: Column, peak_tflops: float, peak_gbs: float) -> tuple[Column, Column, Column, Column]:
    """Milliseconds that the arithmetic and the traffic take at least, the larger of them, and what bounds the kernel."""
    compute, memory = flops / (peak_tflops * 1e12) * 1e3, traffic / (peak_gbs * 1e9) * 1e3
    return compute, memory, F.greatest(compute, memory), F.when(compute >= memory, "compute").otherwise("memory")


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0))
        .when(n < 1024**3, F.format_string("%.1f MB", n / float(1024**2))).otherwise(F.format_string("%.1f GB", n / float(1024**3)))
    )
