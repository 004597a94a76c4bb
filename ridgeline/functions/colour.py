"""Colours: packing, fixed ramps, and classification by break table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgba(red: int, green: int, blue: int, alpha: int = 255) -> int:
    return red << 24 | green << 16 | blue << 8 | alpha


def pack(red: Column, green: Column, blue: Column, alpha: Column) -> Column:
    """Four byte columns as one 0xRRGGBBAA number."""
    wide = lambda c, bits: F.shiftleft(c.cast("long"), bits)
    return wide(red, 24).bitwiseOR(wide(green, 16)).bitwiseOR(wide(blue, 8)).bitwiseOR(alpha.cast("long"))


def channels(packed: Column) -> Column:
    part = lambda bits: F.shiftright(packed, bits).bitwiseAND(F.lit(255)).cast("int")
    return F.struct(part(24).alias("red"), part(16).alias("green"), part(8).alias("blue"), part(0).alias("alpha"))


# Break -> colour tables of the products.
RAMPS = {
    "int": [(0.0, rgba(0, 0, 0)), (1.0, rgba(0, 255, 0))],
    "default": [
        (0.0, 0xFFFFE5FF),
        (0.00001, 0xF7FCB9FF),
        (0.00002, 0xD9F0A3FF),
        (0.00003, 0xADDD8EFF),
        (0.00004, 0x78C679FF),
        (0.00005, 0x41AB5DFF),
        (0.00006, 0x238443FF),
        (0.00007, 0x006837FF),
        (1.0, 0x004529FF),
    ],
    "artslope": [
        (3.5, rgba(0, 255, 0)),
        (7.5, rgba(63, 255, 51)),
        (11.5, rgba(102, 255, 102)),
        (15.5, rgba(178, 255, 102)),
        (19.5, rgba(255, 255, 0)),
        (23.5, rgba(255, 255, 51)),
        (26.5, rgba(255, 153, 51)),
        (31.5, rgba(255, 128, 0)),
        (35.0, rgba(255, 51, 51)),
        (40.0, rgba(255, 0, 0)),
    ],
    "hlz": [
        (0.0, rgba(255, 255, 255, 0)),
        (1.0, 0xFFFF6600),
        (2.0, 0xFFCC6600),
        (3.0, 0x00FF0000),
        (100.0, 0xFFFF667F),
        (110.0, 0xFFCC667F),
        (120.0, 0x00FF007F),
    ],
    "tpi": [
        (-1.0, 0xF7DA22FF),
        (0.45, 0xECBE1DFF),
        (0.55, 0xE77124FF),
        (0.75, 0xD54927FF),
        (0.85, 0xCF3A27FF),
    ],
    "aspect": [
        (22.5, rgba(255, 0, 0)),
        (67.5, rgba(231, 113, 36)),
        (112.5, rgba(246, 235, 20)),
        (157.5, rgba(171, 208, 80)),
        (202.5, rgba(57, 198, 240)),
        (247.5, rgba(70, 152, 211)),
        (292.5, rgba(42, 46, 127)),
        (337.5, rgba(165, 34, 120)),
        (360.0, rgba(255, 0, 0)),
    ],
    "hover": [(float(red), rgba(red, 0, 0)) for red in range(256)],
}

# Colour runs stretched over a layer's own quantile breaks.
RUNS = {
    "green-red-orange": [
        0x569543FF,
        0x9EBD4DFF,
        0xBBCA7AFF,
        0xD9E2B2FF,
        0xE4E7C4FF,
        0xE6D6BEFF,
        0xE3C193FF,
        0xDFAC6CFF,
        0xDB9842FF,
        0xB96230FF,
    ],
    "muted-terrain": [0xCEE1E8FF, 0x7CBCB5FF, 0x82B36DFF, 0x94C279FF, 0xD1DE8DFF, 0xEDECC3FF, 0xCCAFB4FF, 0xC99884FF],
}

# Which table a job's picture uses; the others stretch a run over quantiles.
RAMP_BY_OP = {"artslope": "artslope", "tpi": "tpi", "aspect": "aspect", "hlz": "hlz", "hover": "hover"}
RUN_BY_OP = {"hillshade": "muted-terrain", "draw": "muted-terrain", "slope": "green-red-orange", "viewshed": "green-red-orange"}


def classify(value: Column, stops: Sequence[tuple[float, int]]) -> Column:
    """Colour of the least break that is not below the value; NULL above the last. A search tree of comparisons."""
    ordered = sorted(stops)

    def among(first: int, last: int) -> Column:
        if first == last:
            return F.lit(ordered[first][1]).cast("long")
        middle = (first + last) // 2
        return F.when(value <= F.lit(ordered[middle][0]), among(first, middle)).otherwise(among(middle + 1, last))

    return F.when(value <= F.lit(ordered[-1][0]), among(0, len(ordered) - 1))
