"""File names, limits and content sniffing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Size limits in bytes.
LIMIT_ACQUIRE = 64 * 1024 * 1024
LIMIT_PAGE = 50 * 1024 * 1024
LIMIT_IMAGE = 100 * 1024 * 1024
LIMIT_VIDEO = 250 * 1024 * 1024
MAX_PIXELS = 100_000_000
MIN_SIDE = 8

# Signatures.
PNG = b"\x89PNG\r\n\x1a\n"
JPEG2 = b"\xff\xd8"
JPEG3 = b"\xff\xd8\xff"
TIFF_LE = b"II*\x00"
TIFF_BE = b"MM\x00*"
BMP = b"BM"
ZIP = b"PK\x03\x04"
PDF = b"%PDF-"
ELF = b"\x7fELF"
SCRIPT = b"#!"
MATROSKA = b"\x1a\x45\xdf\xa3"
HEIF_BRANDS = ("heic", "heix", "heim", "heis", "hevc", "hevx", "mif1", "msf1", "avif", "avis")

# Reasons written to ledgers.
NOT_PAGE_IMAGE = "not a PNG, JPEG, TIFF, BMP or WebP file (magic bytes do not match)"
NO_IHDR = "PNG header is missing its IHDR chunk"
PAGE_PIXELS = "decoded image exceeds the pixel limit"
HEIF_REASON = ("HEIC/AVIF photos are not supported yet. In your photo app, export or share the photo as JPEG"
               " and add that.")
UNSUPPORTED = ("Unsupported file type. Use a photo or screenshot (PNG, JPEG, TIFF, BMP) or a short video"
               " (MP4, MOV, AVI, WebM, MKV).")
IMAGE_TOO_BIG = "input exceeds the 100 MiB limit"
VIDEO_TOO_BIG = "video exceeds the 250 MiB limit"
IMAGE_CORRUPT = "image could not be decoded (corrupt or truncated)"
IMAGE_SMALL = "image too small"
IMAGE_PIXELS = "image exceeds the 100 megapixel limit"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _UPPER.lower())


# ---- names and paths --------------------------------------------------------------------

def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def claimed_extension(name: Column) -> Column:
    """Text after the last dot of the base name, lower case; a leading dot alone names no extension."""
    return ascii_lower(F.regexp_extract(base_name(name), r"(?s)^.+\.([^.]*)$", 1))


def relative_path(path: Column, root: Column) -> Column:
    """Path below ``root`` with forward slashes."""
    below = F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)
    return F.replace(below, F.lit("\\"), F.lit("/"))


def escapes_root(path: Column, root: Column) -> Column:
    """True when the path, taken lexically, does not stay below ``root``."""
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    parts = F.split(F.substr(path, F.length(root) + 2), "/")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out"))

    def step(acc, part):
        depth = acc["depth"] + F.when(part == "..", -1).when((part == "") | (part == "."), 0).otherwise(1)
        return F.struct(depth.alias("depth"), (acc["out"] | (depth < 0)).alias("out"))
    return ~inside | F.aggregate(parts, zero, step)["out"]


def safe_name(name: Column) -> Column:
    """Base name with unsafe runs replaced, outer dots and underscores removed, 80 characters at most."""
    cleaned = F.btrim(F.regexp_replace(base_name(name), "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.substring(F.when(cleaned == "", "evidence").otherwise(cleaned), 1, 80)


def blob_name(sha256: Column) -> Column:
    return F.concat(F.lit("vault/"), sha256, F.lit(".arcv"))


def exhibit_name(sha256: Column, suffix: Column | None = None) -> Column:
    """``suffix`` defaults to six random hex digits, so equal files stay separate exhibits."""
    if suffix is None:
        suffix = F.substring(F.sha2(F.expr("uuid()"), 256), 1, 6)
    return F.concat(F.lit("evidence-"), F.substring(sha256, 1, 16), F.lit("-"), suffix, F.lit(".arcr"))


# ---- limits and content -----------------------------------------------------------------

def size_verdict(length: Column, limit: int) -> Column:
    """``oversized`` when strictly above the limit."""
    return F.when(length > limit, "oversized").otherwise("ok")


def _starts(content: Column, magic: bytes) -> Column:
    return F.startswith(content, F.lit(magic))


def _ascii(content: Column, start: int, size: int) -> Column:
    return F.decode(F.substring(content, start, size), "ISO-8859-1")


def looks_like_text(content: Column, sample_bytes: int = 512) -> Column:
    """At least 85 % printable ASCII or whitespace (integer division); empty counts as text."""
    sample = F.decode(F.substring(content, 1, sample_bytes), "ISO-8859-1")
    printable = F.length(F.regexp_replace(sample, r"[^\x21-\x7e \t\n\f\r]", ""))
    share = F.floor(printable * 100 / F.length(sample))
    return F.when(F.length(sample) == 0, True).otherwise(share >= 85)


def magic_hint(content: Column, sniff_bytes: int = 16) -> Column:
    """First matching rule on the sniffed head of a file."""
    head = F.substring(content, 1, sniff_bytes)
    return (F.when(_starts(head, ZIP), "zip-family").when(_starts(head, PDF), "pdf")
            .when(_starts(head, ELF), "elf").when(_starts(head, JPEG2), "jpeg")
            .when(_starts(head, PNG), "png").when(_starts(head, SCRIPT), "script")
            .when(looks_like_text(head), "text").otherwise("unknown"))


def image_format(content: Column, rules: str = "page") -> Column:
    """Raster format. ``page`` knows WebP and wants 26 bytes of BMP, ``photo`` neither,
    ``intake`` takes two bytes as JPEG."""
    png = F.when(_starts(content, PNG), "png")
    if rules == "intake":
        return png.when(_starts(content, JPEG2), "jpeg")
    fmt = (png.when(_starts(content, JPEG3), "jpeg")
           .when(_starts(content, TIFF_LE) | _starts(content, TIFF_BE), "tiff"))
    if rules == "photo":
        return fmt.when(_starts(content, BMP), "bmp")
    if rules != "page":
        raise ValueError(f"unknown rules: {rules}")
    return (fmt.when(_starts(content, BMP) & (F.length(content) >= 26), "bmp")
            .when((_ascii(content, 1, 4) == "RIFF") & (_ascii(content, 9, 4) == "WEBP"), "webp"))


def is_heif(content: Column) -> Column:
    return (_ascii(content, 5, 4) == "ftyp") & _ascii(content, 9, 4).isin(*HEIF_BRANDS)


def video_kind(content: Column) -> Column:
    """Container suffix, or null. HEIF brands share the box type but are images."""
    return (F.when(_starts(content, MATROSKA), ".webm")
            .when((_ascii(content, 5, 4) == "ftyp") & ~_ascii(content, 9, 4).isin(*HEIF_BRANDS), ".mp4")
            .when((_ascii(content, 1, 4) == "RIFF") & (_ascii(content, 9, 4) == "AVI "), ".avi"))


def uint_be(content: Column, start: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, size)), 16, 10).cast("bigint")


def png_dimensions(content: Column) -> Column:
    """struct(width, height) declared by a PNG, null without an IHDR chunk."""
    has = (F.length(content) >= 24) & (_ascii(content, 13, 4) == "IHDR")
    return F.when(has, F.struct(uint_be(content, 17, 4).alias("width"), uint_be(content, 21, 4).alias("height")))


def intake_reason(content: Column, length: Column, rules: str = "page", width: Column | None = None,
                  height: Column | None = None, limit: int | None = None,
                  max_pixels: int = MAX_PIXELS) -> Column:
    """First failing rule as text, null when accepted.

    ``width``/``height`` come from the raster reader (-1 where it could not decode).
    """
    nothing = F.lit(None).cast("string")
    width = F.lit(None).cast("int") if width is None else width
    height = F.lit(None).cast("int") if height is None else height
    pixels = width.cast("bigint") * height.cast("bigint")
    fmt = image_format(content, rules)
    if rules == "page":
        limit = LIMIT_PAGE if limit is None else limit
        dims = png_dimensions(content)
        return (F.when(length > limit, F.concat(length.cast("string"), F.lit(f" bytes exceeds the {limit}-byte limit")))
                .when(fmt.isNull(), NOT_PAGE_IMAGE)
                .when((fmt == "png") & dims.isNull(), NO_IHDR)
                .when((fmt == "png") & (dims["width"] * dims["height"] > max_pixels),
                      F.concat(dims["width"].cast("string"), F.lit("x"), dims["height"].cast("string"),
                               F.lit(f" exceeds the {max_pixels}-pixel limit")))
                .when(width < 0, F.concat(fmt, F.lit(" data could not be decoded (truncated or corrupt)")))
                .when(pixels > max_pixels, PAGE_PIXELS).otherwise(nothing))
    limit = LIMIT_IMAGE if limit is None else limit
    video = video_kind(content)
    return (F.when(video.isNotNull() & (length > LIMIT_VIDEO), VIDEO_TOO_BIG)
            .when(video.isNotNull(), nothing)
            .when(length > limit, IMAGE_TOO_BIG)
            .when(is_heif(content), HEIF_REASON)
            .when(fmt.isNull(), UNSUPPORTED)
            .when(width < 0, IMAGE_CORRUPT)
            .when((width < MIN_SIDE) | (height < MIN_SIDE), IMAGE_SMALL)
            .when(pixels > max_pixels, IMAGE_PIXELS).otherwise(nothing))


def skip_reason(file_kind: Column, outside: Column, length: Column, limit: int = LIMIT_ACQUIRE) -> Column:
    """Why acquisition passes a walked entry by; null for accepted files and for folders."""
    return (F.when(file_kind == "error", "walk_error").when(file_kind == "symlink", "symlink")
            .when(file_kind == "special", "special").when(file_kind == "dir", F.lit(None).cast("string"))
            .when(outside, "outside_root").when(length > limit, "oversized"))
