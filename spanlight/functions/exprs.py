"""Column expressions: intervals, geometry, labels, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps_closed(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a1 >= b0) & (a0 <= b1)


def precedes(left_t1: Column, right_t0: Column, max_gap) -> Column:
    gap = right_t0 - left_t1
    return (gap >= 0) & (gap <= max_gap)


def t_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Temporal intersection over union; 0 where the union is empty."""
    inter = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0)).cast("double")
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def bbox_iou(a: Column, b: Column) -> Column:
    """Boxes as structs x0, y0, x1, y1."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def valid_box(b: Column) -> Column:
    inside = F.greatest(b["x0"], b["y0"], b["x1"], b["y1"]) <= 1
    return inside & (F.least(b["x0"], b["y0"]) >= 0) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])


def label_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(text)), "[^a-z0-9]+"), lambda t: t != "")


def label_match(haystack: Column, needle: str) -> Column:
    """Every whole token of the needle is among the haystack's; substrings don't count."""
    want = [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in needle.lower()).split()]
    return F.size(F.array_except(F.array(*[F.lit(t) for t in want]), label_tokens(haystack))) == 0


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The unit vector; a zero vector is an error."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.raise_error(F.lit("a zero vector has no direction")))


def finite(x: Column) -> Column:
    """x; NaN and infinities are an error (null stays null)."""
    odd = F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(F.coalesce(odd, F.lit(False)), F.raise_error(F.lit("scores are finite"))).otherwise(x)


def payload(text: Column) -> Column:
    """A JSON payload as a variant; what is no object becomes {"value": it}, and what is no JSON the text itself so."""
    said = F.try_parse_json(text)
    own = F.schema_of_variant(said).startswith("OBJECT")
    wrapped = F.to_variant_object(F.named_struct(F.lit("value"), said))
    return F.when(said.isNull(), F.to_variant_object(F.named_struct(F.lit("value"), text))).when(own, said).otherwise(wrapped)


def in_group_scope(payload: Column, group: str) -> Column:
    """Whether a predicate_scope (JSON: a string, a list, or an object with group_id) names the group."""
    said = F.try_parse_json(payload)
    kind = F.schema_of_variant(said)
    text = F.try_variant_get(said, "$", "string")
    by_list = F.array_contains(F.try_variant_get(said, "$", "array<string>"), group)
    hit = F.when(kind.startswith("ARRAY"), by_list).when(kind.startswith("OBJECT"), F.try_variant_get(said, "$.group_id", "string") == group).otherwise(text == group)
    return F.coalesce(hit, F.lit(False))


def luminance(pixels: Column) -> Column:
    """Mean of a grey image's pixels, 0 to 1."""
    return F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x.cast("double")) / (F.size(pixels) * 255.0)


def sharpness(pixels: Column, wide: int) -> Column:
    """Variance of the Laplacian over the inner pixels of a row-major grey image; 0 for images without any."""
    high = F.floor(F.size(pixels) / wide).cast("int")
    at = lambda i: F.element_at(pixels, (i + 1).cast("int")).cast("double")
    inner = F.filter(F.sequence(F.lit(0), F.size(pixels) - 1), lambda i: (i % wide > 0) & (i % wide < wide - 1) & (i >= wide) & (i < (high - 1) * wide))
    lap = F.transform(inner, lambda i: at(i - 1) + at(i + 1) + at(i - wide) + at(i + wide) - 4 * at(i))
    mean = F.aggregate(lap, F.lit(0.0), lambda s, x: s + x) / F.size(lap)
    return F.when(F.size(lap) == 0, F.lit(0.0)).otherwise(F.aggregate(lap, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(lap))


def frame_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two grey images, 0 to 1; images of different sizes are an error, empty ones don't differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("frames have equal dimensions"))).when(F.size(a) == 0, F.lit(0.0)).otherwise(total / (F.size(a) * 255.0))


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def stable_id(*columns: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def artefact_path(kind: str, *inputs: Column) -> Column:
    """kind and the first 32 hex digits of the key over an artefact's declared inputs."""
    return F.concat(F.lit(f"{kind}/"), F.substring(F.sha2(F.to_json(F.struct(*inputs)), 256), 1, 32))
