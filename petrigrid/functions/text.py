"""Text and byte functions: CSV cells, formats, names, status texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image formats by mime type and the extension used for stored bytes.
EXTENSIONS = {
    "image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/gif": "gif", "image/bmp": "bmp",
    "image/avif": "avif", "image/heic": "heic", "image/tiff": "tif", "image/heif": "heif",
}
# ISO base-media brands.
AVIF_BRANDS = ["avif", "avis"]
HEIC_BRANDS = ["heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1"]


def sniff_mime(content: Column) -> Column:
    """Image type from magic bytes, null when unknown (SCA1)."""
    head = F.substring(content, 1, 64)
    h = F.hex(head)
    ascii_ = lambda at, n: F.substring(h, 2 * at + 1, 2 * n)
    hexed = lambda s: s.encode().hex().upper()
    n = F.length(content)
    # the major brand, then the compatible brands from byte 16 in steps of four
    brands = F.concat(
        F.array(ascii_(8, 4)),
        F.transform(F.when(n >= 20, F.sequence(F.lit(16), F.least(n, F.lit(64)) - 4, F.lit(4))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(h, 2 * i + 1, F.lit(8))),
    )
    has = lambda names: F.exists(brands, lambda b: b.isin(*[hexed(x) for x in names]))
    iso = (n >= 12) & (ascii_(4, 4) == hexed("ftyp"))
    return (
        F.when((n >= 3) & h.startswith("FFD8FF"), "image/jpeg")
        .when((n >= 8) & h.startswith("89" + hexed("PNG")), "image/png")
        .when((n >= 6) & h.startswith(hexed("GIF8")), "image/gif")
        .when((n >= 12) & h.startswith(hexed("RIFF")) & (ascii_(8, 4) == hexed("WEBP")), "image/webp")
        .when((n >= 2) & h.startswith(hexed("BM")), "image/bmp")
        .when((n >= 4) & (h.startswith("49492A00") | h.startswith("4D4D002A")), "image/tiff")
        .when(iso & has(AVIF_BRANDS), "image/avif")
        .when(iso & has(HEIC_BRANDS), "image/heic")
    )


def extension_for(mime: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.element_at(m, mime), F.lit("bin"))


def neutralise_formula(c: Column) -> Column:
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_text(c: Column) -> Column:
    s = neutralise_formula(c)
    untrimmed = s.rlike(r"^[\s\x{FEFF}\x{00A0}]") | s.rlike(r"[\s\x{FEFF}\x{00A0}]$")
    quote = s.rlike("[\",\r\n]") | untrimmed
    return F.when(quote, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_number(c: Column) -> Column:
    """Numbers verbatim, non-finite ones empty."""
    d = c.cast("double")
    bad = c.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(bad, "").otherwise(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def csv_boolean(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def csv_row(cells: list[Column]) -> Column:
    return F.concat_ws(",", *cells)


def content_key(*cols: Column) -> Column:
    """Equal exactly when the canonical columns are equal."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]), 256)


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(F.format_number(n, 0), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def delta_text(version: Column, now: Column) -> Column:
    d = version - now
    return F.when(d == 0, "same as now").otherwise(F.concat(F.format_number(F.abs(d), 0), F.when(d > 0, " more").otherwise(" fewer"), F.lit(" than now")))


def reason_tag(reason: Column) -> Column:
    return (
        F.when(reason == "before-destructive", "Before a change")
        .when(reason == "before-restore", "Before restoring")
        .when(reason == "manual", "Saved by you")
        .when(reason == "session-start", "Opened")
        .when(reason == "periodic", "Automatic")
    )


def review_question(chosen: Column, alternative: Column) -> Column:
    """Short question of a review region; ``alternative`` null when there is none."""
    s = lambda c: c.cast("string")
    more = F.when(alternative == 1, "One more?").otherwise(F.concat(s(alternative), F.lit(" more?")))
    single = F.when(chosen == 1, "Colony?").otherwise(F.concat(s(chosen), F.lit(" colonies?")))
    both = F.concat(s(F.least(chosen, alternative)), F.lit(" or "), s(F.greatest(chosen, alternative)), F.lit("?"))
    return (
        F.when((chosen == 0) & alternative.isNotNull() & (alternative > 0), more)
        .when(alternative.isNull() | (alternative == chosen), single)
        .otherwise(both)
    )


def save_status(local_error: Column, opened: Column, linked: Column, pushing: Column, conflicts: Column, dirty: Column, connected: Column, remote_error: Column) -> Column:
    return (
        F.when(local_error.isNotNull(), "local-error")
        .when(~opened, "idle")
        .when(~linked, "saved-local")
        .when(pushing, "saving-drive")
        .when(conflicts > 0, "conflict")
        .when(dirty & ~connected, "reconnect-required")
        .when(dirty & remote_error.isNotNull(), "failed")
        .when(dirty, "pending")
        .otherwise("saved-drive")
    )


def retry_delay_ms(failures: Column) -> Column:
    """15 s doubling per failure, at most five minutes."""
    return F.least(F.lit(300_000.0), F.lit(15_000.0) * F.pow(F.lit(2.0), failures - 1)).cast("bigint")
