"""Group style, palette, markers, display settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour-blind-safe palette, in display order.
GROUP_PALETTE = [
    ("Vermilion", "#d55e00"), ("Sky blue", "#56b4e9"), ("Bluish green", "#009e73"), ("Yellow", "#f0e442"),
    ("Blue", "#0072b2"), ("Orange", "#e69f00"), ("Reddish purple", "#cc79a7"), ("Black", "#000000"),
]

# Display defaults and limits.
DISPLAY_DEFAULTS = {"brightness": 0.0, "contrast": 0.0, "gamma": 1.0, "saturation": 1.0, "separation": 6.0}
DISPLAY_LIMITS = {"brightness": (-1.0, 1.0), "contrast": (-1.0, 1.0), "gamma": (0.2, 5.0), "saturation": (0.0, 3.0), "separation": (2.0, 16.0)}
DISPLAY_CHANNELS = ["rgb", "red", "green", "blue", "luma", "centre"]

# Presets that differ from the defaults in the listed fields.
PRESETS = {
    "default": {},
    "high-contrast": {"auto_contrast": True, "contrast": 0.35, "saturation": 1.3},
    "green": {"channel": "green", "auto_contrast": True},
    "inverted-grey": {"channel": "luma", "invert": True, "auto_contrast": True},
    "centres": {"channel": "centre"},
}


def round_half_up(c: Column) -> Column:
    """floor(x + 1/2), the rounding of the plate documents (also for negatives)."""
    return F.floor(c + F.lit(0.5))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def clamp_opacity(c: Column) -> Column:
    return clamp(c, 0.1, 1.0)


def clamp_size(c: Column) -> Column:
    return clamp(round_half_up(c).cast("double"), 2.0, 24.0)


def clamp_label_size(c: Column) -> Column:
    return clamp(round_half_up(c).cast("double"), 8.0, 32.0)


def colour_name(hex_: Column) -> Column:
    names = F.create_map(*[F.lit(x) for n, v in GROUP_PALETTE for x in (v, n)])
    return F.coalesce(F.element_at(names, F.lower(hex_)), F.concat(F.lit("Custom "), F.lower(hex_)))


def luminance(hex_: Column) -> Column:
    """Relative luminance of #rgb / #rrggbb; one half when it does not parse."""
    h = F.regexp_extract(F.trim(hex_), "^#?([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$", 1)
    six = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)

    def part(i: int) -> Column:
        v = F.conv(F.substring(six, i, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return F.when(h == "", F.lit(0.5)).otherwise(part(1) * 0.2126 + part(3) * 0.7152 + part(5) * 0.0722)


def contrast_outline(hex_: Column) -> Column:
    return F.when(luminance(hex_) > 0.4, "rgba(0,0,0,0.8)").otherwise("rgba(255,255,255,0.92)")


def display_radius(size: Column, scale: Column) -> Column:
    """Marker radius on screen: shrinks with the square root of the scale below one half."""
    small = size * F.sqrt(F.greatest(F.lit(0.0), scale) / 0.5)
    shrunk = F.greatest(F.lit(3.5), round_half_up(small * 2) / 2)
    return F.when((scale >= 0.5) | (size <= 3.5), size).otherwise(shrunk)


def erase_radius(marker: Column, pointer: Column) -> Column:
    return F.greatest(marker, F.when(pointer == "mouse", 12.0).otherwise(22.0))


def display_field(name: str, raw: Column) -> Column:
    lo, hi = DISPLAY_LIMITS[name]
    ok = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) < float("inf"))
    return F.when(ok, round_half_up(clamp(raw, lo, hi) * 1000) / 1000).otherwise(F.lit(DISPLAY_DEFAULTS[name]))


def display_channel(raw: Column) -> Column:
    return F.when(raw.isin(*DISPLAY_CHANNELS), raw).otherwise("rgb")


def normalise_display(prefix: str = "") -> dict[str, Column]:
    """Lenient repair of raw display columns (VAL9)."""
    out = {n: display_field(n, F.col(prefix + n)) for n in DISPLAY_LIMITS}
    out["channel"] = display_channel(F.col(prefix + "channel"))
    for b in ("invert", "auto_contrast"):
        out[b] = F.coalesce(F.col(prefix + b), F.lit(False))
    return out


def is_default_display(d: dict[str, Column]) -> Column:
    return (
        (d["brightness"] == 0) & (d["contrast"] == 0) & (d["gamma"] == 1) & (d["saturation"] == 1)
        & ~d["invert"] & (d["channel"] == "rgb") & ~d["auto_contrast"]
    )


def number_text(c: Column) -> Column:
    """Shortest text of a number, without a trailing .0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def display_key(d: dict[str, Column], centre_key: Column | None = None) -> Column:
    """Equal keys render equally (FIL13)."""
    sat = F.when(d["channel"] == "rgb", d["saturation"]).otherwise(1.0)
    key = F.concat_ws(
        "|", d["channel"], number_text(d["brightness"]), number_text(d["contrast"]), number_text(d["gamma"]), number_text(sat),
        F.when(d["invert"], "1").otherwise("0"), F.when(d["auto_contrast"], "1").otherwise("0"),
    )
    tail = centre_key if centre_key is not None else F.lit("none")
    return F.when(is_default_display(d), "default").when(d["channel"] == "centre", F.concat_ws("|", key, tail)).otherwise(key)


def preset_values(name: str) -> dict[str, Column]:
    base: dict[str, object] = {**DISPLAY_DEFAULTS, "channel": "rgb", "invert": False, "auto_contrast": False}
    return {k: F.lit(v) for k, v in {**base, **PRESETS[name]}.items()}


def preset_key(d: dict[str, Column]) -> Column:
    return F.concat(display_key(d), F.when(d["channel"] == "centre", F.concat(F.lit("|"), number_text(d["separation"]))).otherwise(""))


def matching_preset(d: dict[str, Column]) -> Column:
    k = preset_key(d)
    out = None
    for name in PRESETS:
        hit = k == preset_key(preset_values(name))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
