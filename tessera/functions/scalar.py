"""Scalar functions on columns: all are built-in expressions, so they stay in generated code and can be pushed down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values


def enum_name(code: Column, table: dict[int, str]) -> Column:
    """Name of a code; null if unknown."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, name in table.items():
        out = out.when(code == k, name)
    return out


def enum_error(code: Column, table: dict[int, str]) -> Column:
    return F.when(code.isNull() | ~code.isin(*table), F.concat(F.lit("unknown code "), code.cast("string")))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def rect(x, y, width, height) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), width.cast("long").alias("width"), height.cast("long").alias("height"))


def area(r: Column) -> Column:
    return r["width"] * r["height"]


def contains(r: Column, x: Column, y: Column) -> Column:
    """Half-open at the right and the bottom."""
    return (x >= r["x"]) & (x < r["x"] + r["width"]) & (y >= r["y"]) & (y < r["y"] + r["height"])


def intersects(a: Column, b: Column) -> Column:
    """Touching edges don't intersect."""
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def wrap16(c: Column) -> Column:
    return c.cast("long").bitwiseAND(F.lit(65535))


def is_zero(dx: Column, dy: Column) -> Column:
    return (dx == 0) & (dy == 0)


def magnitude(dx: Column, dy: Column) -> Column:
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def to_compact(dx: Column, dy: Column) -> Column:
    """Struct of bytes, or null if either is outside [-128, 127]."""
    fits = dx.between(-128, 127) & dy.between(-128, 127)
    return F.when(fits, F.struct(dx.cast("byte").alias("dx"), dy.cast("byte").alias("dy")))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def dominant(colors: Column) -> Column:
    return F.try_element_at(colors, F.lit(1))


def coverage(foreground: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(foreground / total)


def bandwidth_ratio(bbox_w: Column, bbox_h: Column, frame_w: Column, frame_h: Column) -> Column:
    frame = frame_w * frame_h
    return F.when(frame == 0, 1.0).otherwise(bbox_w * bbox_h / frame)


def savings_percent(hybrid: Column, traditional: Column) -> Column:
    return F.when(traditional == 0, 0.0).otherwise((1 - hybrid / traditional) * 100)


def savings_ratio(hybrid: Column, traditional: Column) -> Column:
    return F.when(traditional == 0, 1.0).otherwise(traditional / F.greatest(hybrid, F.lit(1)))


def hundredths(x: Column) -> Column:
    """``x`` with two digits, as C's %.2f writes it: the double's exact value is rounded, ties to even (format_string rounds its shortest decimal form, ties up)."""
    size, low = F.abs(x), F.lit((1 << 30) - 1)
    whole = F.floor(size)
    part = ((size - whole) * float(1 << 60)).cast("long")  # all bits of the fraction; what is below 2 ** -60 decides nothing
    under = part.bitwiseAND(low) * 100
    over = F.shiftright(part, 30) * 100 + F.shiftright(under, 30)
    n, rest = F.shiftright(over, 30), F.shiftleft(over.bitwiseAND(low), 30) + under.bitwiseAND(low)
    cents = n + F.when((rest > 1 << 59) | ((rest == 1 << 59) & (n % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), (whole + F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def estimate_bytes(width: Column, height: Column, cover: Column, scene: Column, bpp: Column) -> Column:
    """Struct traditional, hybrid: bytes of a plain frame and of scene + person + mask."""
    pixels = width * height
    person = pixels * cover
    hybrid = F.floor(person * bpp / 8) + F.floor(person / 50) + scene
    return F.struct(F.floor(pixels / 8).alias("traditional"), hybrid.alias("hybrid"))


def grid_cell(entity: Column, width: int) -> Column:
    return F.struct((entity % width).alias("block_x"), wrap16(F.floor(entity / width)).alias("block_y"))


def from_grid(block_x: Column, block_y: Column, width: int) -> Column:
    return block_y * width + block_x


def has_scene_magic(data: Column) -> Column:
    return (F.length(data) >= 16) & (F.hex(F.substring(data, 1, 4)) == values.SCENE_MAGIC_HEX)


def flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(values.FLAGS[name])) != 0


def set_flag(flags: Column, name: str, on: Column) -> Column:
    bit = values.FLAGS[name]
    return F.when(on, flags.bitwiseOR(F.lit(bit))).otherwise(flags.bitwiseAND(F.lit(65535 - bit)))


def hex_be(c: Column, size: int) -> Column:
    """Unsigned big-endian hex of ``size`` bytes."""
    return F.lpad(F.hex(c.cast("long")), 2 * size, "0")


def hex_le(c: Column, size: int) -> Column:
    be = hex_be(c, size)
    return F.concat(*[F.substring(be, 2 * (size - k) - 1, 2) for k in range(size)])


def uint_be(data: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def uint_le(data: Column, at: int, size: int) -> Column:
    text = F.hex(F.substring(data, at + 1, size))
    return F.conv(F.concat(*[F.substring(text, 2 * (size - k) - 1, 2) for k in range(size)]), 16, 10).cast("long")


def color_bytes(c: Column) -> Column:
    """A colour's struct on the wire: three bytes."""
    return F.unhex(F.concat(*[hex_be(c[n], 1) for n in "rgb"]))


def bytes_color(raw: Column) -> Column:
    """The inverse; null unless three bytes."""
    return F.when(F.length(raw) == 3, F.struct(*[uint_be(raw, k, 1).alias(n) for k, n in enumerate("rgb")]))


def rect_bytes(r: Column) -> Column:
    """A rectangle's struct on the wire: four unsigned 32-bit integers, little-endian; wider values wrap."""
    return F.unhex(F.concat(*[hex_le(r[n].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 4) for n in ("x", "y", "width", "height")]))


def bytes_rect(raw: Column) -> Column:
    """The inverse; null unless sixteen bytes."""
    return F.when(F.length(raw) == 16, F.struct(*[uint_le(raw, 4 * k, 4).alias(n) for k, n in enumerate(("x", "y", "width", "height"))]))
