"""Scalar expressions: all built from Spark functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of value, with value evaluated once: inside a lambda an expression is otherwise evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_spans(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, end, text): code points, half-open. For patterns without empty matches."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def total(parts: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(parts, first + 1, n), F.lit(0).cast("long"), lambda a, x: a + x)

    def spans(s: Column) -> Column:
        steps = F.zip_with(s["found"], s["between"], lambda m, b: (F.length(b) + F.length(m)).cast("long"))

        def by_block(step: Column, size: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor(F.size(s["found"]) / size).cast("int"))
            sums = F.transform(blocks, lambda j: total(step, j * size, size))
            return let(sums, lambda t: let(F.transform(blocks, lambda j: total(t, F.lit(0), j)), lambda before: F.transform(s["found"], lambda m, i: span(m, i, step, size, before))))

        # offsets are summed within blocks of about (2 n)^(1/3) matches, and over blocks
        return let(steps, lambda step: let(F.ceil(F.cbrt(2 * F.size(s["found"]) + 1)).cast("int"), lambda size: by_block(step, size)))

    def span(m: Column, i: Column, step: Column, size: Column, before: Column) -> Column:
        block = F.floor(i / size).cast("int")
        end = F.get(before, block) + total(step, block * size, i % size + 1)
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text"))

    return let(both, spans)


def luhn(number: Column) -> Column:
    """13 to 19 digits with a right check digit; only spaces and hyphens may stand between."""
    bare = F.regexp_replace(number, "[ -]", "")
    return F.coalesce(bare.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", bare), F.lit(False))


def truthy(value: Column) -> Column:
    """true, yes, 1 and on in any case; everything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "yes", "1", "on"), F.lit(False))


def human_size(n: Column) -> Column:
    one = lambda unit, name: F.format_string("%.1f " + name, n / F.lit(float(unit)))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, one(1024, "KB")).when(n < 1024**3, one(1024**2, "MB")).otherwise(one(1024**3, "GB"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 luminance."""
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def points(value: Column, unit: str) -> Column:
    return value * {"pt": 1.0, "inch": 72.0, "cm": 72.0 / 2.54, "mm": 72.0 / 25.4}[unit]


def padded_number(n: Column, digits: int) -> Column:
    """Zero-padded like printf: never cut."""
    return F.when(F.length(n.cast("string")) >= digits, n.cast("string")).otherwise(F.lpad(n.cast("string"), digits, "0"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def intersects(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Rectangles of x, y, w, h: touching edges do not intersect."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def decompose_ligatures(text: Column) -> Column:
    for code, plain in zip(range(0xFB00, 0xFB07), ("ff", "fi", "fl", "ffi", "ffl", "st", "st"), strict=True):
        text = F.replace(text, F.lit(chr(code)), F.lit(plain))
    return text


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
