"""Scalar functions on columns: cleaning of catalogue texts, numbers, binning, divergence, interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the correlation scores at four selectivities.
TAU_SELECTIVITIES = (0.001, 0.01, 0.1, 0.5)
TAU_POINTS = {
    "true": (0.085904, 0.038007, 0.045303, 0.019288),
    "heuristic": (0.104385, 0.104385, 0.104385, 0.104385),
    "tanh": (0.007354, 0.028364, 0.026088, 0.006374),
    "pgap": (0.0, 0.001352, 0.004521, 0.003754),
}


def price(c: Column) -> Column:
    """Number in a price: all but digits, points and minus signs dropped; null where that is no number."""
    return _try_double(F.nullif(F.regexp_replace(c, r"[^0-9.\-]", ""), F.lit("")))


def rating(c: Column) -> Column:
    """First number in a text; null without one."""
    return _try_double(F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")))


def _try_double(c: Column) -> Column:
    return c.try_cast("double")


def top_category(c: Column) -> Column:
    """First non-empty part of a category path; the whole trimmed text where there is none; null of a blank."""
    text = F.trim(c)
    parts = F.filter(F.transform(F.split(text, r"[>/\\|,:]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(text != "", F.coalesce(F.try_element_at(parts, F.lit(1)), text))


def missing_to_null(c: Column) -> Column:
    """Null for empty, 'nan' and 'None' texts."""
    t = F.trim(c)
    return F.when(~t.isin("", "nan", "None"), t)


def embedding_text(title: Column, description: Column) -> Column:
    """'title. description', or the title alone."""
    return F.when(missing_to_null(description).isNotNull(), F.concat_ws(". ", title, description)).otherwise(title)


def selectivity_token(c: Column) -> Column:
    """A selectivity as a part of a file name: 0.01 is 0p01."""
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", c), "0+$", ""), r"\.$", "")
    return F.replace(fixed, F.lit("."), F.lit("p"))


def selectivity_of_name(c: Column) -> Column:
    """The selectivity in a file name's token; null without one."""
    return _try_double(F.replace(F.nullif(F.regexp_extract(c, r"(\d+p\d+)", 1), F.lit("")), F.lit("p"), F.lit(".")))


def finite(c: Column) -> Column:
    """True of numbers that are neither null, NaN nor infinite."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def bin_index(v: Column, low: Column, high: Column, bins: Column) -> Column:
    """Index of v's bin of equal width, from 0, held inside the outer bins."""
    i = F.floor((v - low) / ((high - low) / bins))
    return F.greatest(F.lit(0), F.least(i, bins - 1)).cast("int")


def freedman_diaconis(n: Column, low: Column, high: Column, iqr: Column, least: int = 20, most: int = 200) -> Column:
    """Number of bins: the span over twice the interquartile range by the cube root of n; n / 50 where the range is 0; 1 where all is one value."""
    span = high - low
    width = 2 * iqr / F.cbrt(n.cast("double"))
    wanted = F.when(iqr > 0, F.ceil(span / width)).otherwise(F.ceil(n / 50))
    return F.when(span == 0, F.lit(1)).otherwise(F.least(F.greatest(wanted, F.lit(least)), F.lit(most))).cast("int")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""
    mid = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    part = lambda x: F.aggregate(F.zip_with(x, mid, lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, y: s + y)
    return F.sqrt(F.greatest(0.5 * part(p) + 0.5 * part(q), F.lit(0.0)))


def tau(selectivity: Column, metric: str) -> Column:
    """Threshold of a score at a selectivity: linear between points in log10 of the selectivity, held at the ends; null outside (0, 1]."""
    s, t = TAU_SELECTIVITIES, TAU_POINTS[metric]
    out = F.lit(t[-1])
    for k in range(len(s) - 1, 0, -1):
        a, b = F.log10(F.lit(s[k - 1])), F.log10(F.lit(s[k]))
        out = F.when(selectivity <= s[k], t[k - 1] + (F.log10(selectivity) - a) / (b - a) * (t[k] - t[k - 1])).otherwise(out)
    out = F.when(selectivity <= s[0], F.lit(t[0])).otherwise(out)
    return F.when((selectivity > 0) & (selectivity <= 1), out)


def class_of(score: Column, threshold: Column) -> Column:
    """positive above the threshold, negative below its negative, else random."""
    return F.when(score > threshold, F.lit("positive")).when(score < -threshold, F.lit("negative")).otherwise(F.lit("random"))


def json_of(**columns: Column) -> Column:
    """A JSON object of the columns, keys in order."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))


def parsed_json(c: Column, fields: str) -> Column:
    """A JSON object's fields, by a schema such as "a long, s string"; what is no JSON object has null fields, and so has a missing one."""
    return F.from_json(c, fields)


def spaced(kind: str, start: float, stop: float, n: int) -> Column:
    """An array of n numbers: linspace from start to stop; logspace, powers of ten between these exponents; geomspace, a constant ratio from start to stop, both above 0; one number is start."""
    if n < 1 or kind not in ("linspace", "logspace", "geomspace") or kind == "geomspace" and not (start > 0 and stop > 0):
        raise ValueError(f"no {kind} of {n} numbers from {start} to {stop}")
    a, b = (math.log10(start), math.log10(stop)) if kind == "geomspace" else (start, stop)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(a)) + i * ((b - a) / max(n - 1, 1)))
    return at if kind == "linspace" else F.transform(at, lambda x: F.pow(F.lit(10.0), x))


def stepped(start: float, stop: float, step: float) -> Column:
    """An array from start to before stop by a step above 0; empty if stop is not beyond start."""
    n = max(0, math.ceil((stop - start) / step))
    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), 1, n), lambda i: F.lit(float(start)) + i * float(step))


def numbers_of(c: Column) -> Column:
    """The numbers of a list with commas; blanks are passed over, and what is no number is null."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, _try_double)


def content_key(*c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by '|'."""
    return F.substring(F.sha2(F.concat_ws("|", *c), 256), 1, 16)
