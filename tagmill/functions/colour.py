"""Colour expressions: contrast, conversions, parsing and suggestions, all on r, g, b columns of 0..255."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named colours.
NAMED = {"black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "cyan": "00ffff", "magenta": "ff00ff", "gray": "808080", "grey": "808080", "silver": "c0c0c0", "maroon": "800000", "olive": "808000", "purple": "800080", "teal": "008080", "navy": "000080"}


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance as accessibility guidelines define it."""

    def linear(c: Column) -> Column:
        x = c.cast("double") / 255
        return F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast_ratio(first: tuple[Column, Column, Column], second: tuple[Column, Column, Column]) -> Column:
    """Each luminance is worked out once; a filter that holds both sides of it twice is too long for the JVM to compile."""
    return let(F.array(luminance(*first), luminance(*second)), lambda two: (F.array_max(two) + 0.05) / (F.array_min(two) + 0.05))


def is_large(size: Column, bold: Column) -> Column:
    return (size >= 18) | (bold & (size >= 14))


def required_ratio(size: Column, bold: Column, level: str = "AA") -> Column:
    large, normal = (3.0, 4.5) if level == "AA" else (4.5, 7.0)
    return F.when(is_large(size, bold), large).otherwise(normal)


def level_description(ratio: Column) -> Column:
    return F.when(ratio >= 7, "AAA").when(ratio >= 4.5, "AA").when(ratio >= 3, "AA large").otherwise("insufficient")


def visibility(r: Column, g: Column, b: Column) -> Column:
    return F.when((0.299 * r + 0.587 * g + 0.114 * b) / 255 > 0.5, "light").otherwise("dark")


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c), 2, "0")) for c in (r, g, b)])


def parsed(text: Column) -> Column:
    """struct(r, g, b) of a name, #rgb, #rrggbb, rgb() or rgba(); null if it is none of them."""
    t = F.lower(F.trim(text))
    name = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])[t]
    short = F.regexp_extract(t, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", 0)
    digits = F.when(name.isNotNull(), name).when(t.rlike("^#[0-9a-f]{6}$"), F.substring(t, 2, 6)).when(short != "", F.regexp_replace(F.substring(t, 2, 3), "(.)", "$1$1"))
    from_hex = F.struct(*[F.conv(F.substring(digits, i, 2), 16, 10).cast("int").alias(c) for c, i in zip("rgb", (1, 3, 5), strict=True)])
    call = r"^rgba?\(\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*,\s*([0-9]{1,3})\s*(?:,[^)]*)?\)$"
    from_call = F.struct(*[F.regexp_extract(t, call, i).cast("int").alias(c) for c, i in zip("rgb", (1, 2, 3), strict=True)])
    return F.when(digits.isNotNull(), from_hex).when(t.rlike(call), from_call)


def to_hsl(r: Column, g: Column, b: Column) -> Column:
    """struct(h, s, l), whole degrees and percents, halves to even."""
    x, y, z = (c.cast("double") / 255 for c in (r, g, b))
    top, low = F.greatest(x, y, z), F.least(x, y, z)
    span, light = top - low, (top + low) / 2
    s = F.when(span == 0, 0.0).when(light > 0.5, span / (2 - top - low)).otherwise(span / (top + low))
    h = F.when(span == 0, 0.0).when(top == x, (y - z) / span + F.when(y < z, 6.0).otherwise(0.0)).when(top == y, (z - x) / span + 2).otherwise((x - y) / span + 4)
    whole = lambda c: F.bround(c).cast("int")
    return F.struct(whole(h * 60).alias("h"), whole(s * 100).alias("s"), whole(light * 100).alias("l"))


def darkened(c: Column) -> Column:
    return F.floor(c * 0.7).cast("int")


def lightened(c: Column) -> Column:
    return F.floor(c + (255 - c) * 0.7).cast("int")


def suggestion(text: tuple[Column, Column, Column], ground: tuple[Column, Column, Column], target: Column) -> Column:
    """The first change that reaches target: darker text, lighter ground, both, else the plain pair of more contrast."""
    dark, light = tuple(darkened(c) for c in text), tuple(lightened(c) for c in ground)
    plain = F.when(contrast_ratio((F.lit(0),) * 3, ground) >= contrast_ratio((F.lit(255),) * 3, ground), "black text").otherwise("white text")
    return F.when(contrast_ratio(dark, ground) >= target, "darken text").when(contrast_ratio(text, light) >= target, "lighten background").when(contrast_ratio(dark, light) >= target, "both").otherwise(plain)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def from_hsl(h: Column, s: Column, light: Column) -> Column:
    """Array of red, green and blue of whole degrees and percents, halves to even."""

    def one(c: Column, shift: float) -> Column:
        def bent(at: Column) -> Column:
            up = c["p"] + (c["q"] - c["p"]) * 6 * at
            down = c["p"] + (c["q"] - c["p"]) * (2 / 3 - at) * 6
            return F.when(at < 1 / 6, up).when(at < 0.5, c["q"]).when(at < 2 / 3, down).otherwise(c["p"])

        turned = let(c["x"] + shift, lambda at: F.when(at < 0, at + 1).when(at > 1, at - 1).otherwise(at))
        return F.bround(F.when(c["y"] == 0, c["z"]).otherwise(let(turned, bent)) * 255).cast("int")

    base = F.struct((h / 360.0).alias("x"), (s / 100.0).alias("y"), (light / 100.0).alias("z"))
    with_q = let(base, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"), F.when(c["z"] < 0.5, c["z"] * (1 + c["y"])).otherwise(c["z"] + c["y"] - c["z"] * c["y"]).alias("q")))
    with_p = let(with_q, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"), c["q"].alias("q"), (2 * c["z"] - c["q"]).alias("p")))
    return let(with_p, lambda c: F.array(one(c, 1 / 3), one(c, 0.0), one(c, -1 / 3)))


def accessible_pairs(text: tuple[Column, Column, Column], ground: tuple[Column, Column, Column], target: Column) -> Column:
    """Array of (text, ground, ratio) that reach target by 30 points of lightness, the most contrast first; plain black and white if none does."""
    sides = lambda c: tuple(c[k] for k in range(3))

    def pair(moved: Column, other: tuple[Column, Column, Column], is_text: bool, may: Column) -> Column:
        def told(c: Column) -> Column:
            a, b = (sides(c), other) if is_text else (other, sides(c))
            return F.struct(contrast_ratio(a, b).alias("ratio"), hex_of(*a).alias("text"), hex_of(*b).alias("ground"), may.alias("may"))

        return let(moved, told)

    def moves(v: Column) -> Column:
        out = []
        for name, other in (("t", ground), ("g", text)):
            x = v[name]
            out.append(pair(from_hsl(x["h"], x["s"], F.greatest(F.lit(0), x["l"] - 30)), other, name == "t", x["l"] > 50))
            out.append(pair(from_hsl(x["h"], x["s"], F.least(F.lit(100), x["l"] + 30)), other, name == "t", x["l"] < 50))
        return F.array(*out)

    good = F.filter(let(F.struct(to_hsl(*text).alias("t"), to_hsl(*ground).alias("g")), moves), lambda x: x["may"] & (x["ratio"] >= target))
    ranked = F.array_sort(F.transform(good, lambda x, i: F.struct((-x["ratio"]).alias("down"), i.alias("i"), x["text"].alias("text"), x["ground"].alias("ground"))))
    best = F.transform(ranked, lambda x: F.struct(x["text"].alias("text"), x["ground"].alias("ground"), (-x["down"]).alias("ratio")))
    plain = F.array(*[F.struct(F.lit(a).alias("text"), F.lit(b).alias("ground"), F.lit(21.0).alias("ratio")) for a, b in (("#000000", "#ffffff"), ("#ffffff", "#000000"))])
    return let(best, lambda x: F.when(F.size(x) > 0, x).otherwise(plain))
