"""Image references, their names, kinds, ids and embedding routes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"!\[([^\]]*)\]\(\s*<?([^\s>)]+)>?(?:\s+[\"'][^)]*)?\s*\)"
#: First bytes and kinds.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"BM", "image/bmp"),
    (b"II*\x00", "image/tiff"),
    (b"MM\x00*", "image/tiff"),
)
#: Brands of containers, which stand after ``ftyp``.
BRANDS = (
    (b"avif", "image/avif"),
    (b"avis", "image/avif"),
    (b"heic", "image/heic"),
    (b"heix", "image/heic"),
    (b"heim", "image/heic"),
    (b"heis", "image/heic"),
    (b"mif1", "image/heic"),
)
#: Kinds by suffix.
SUFFIXES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff",
            "webp": "image/webp", "svg": "image/svg+xml", "avif": "image/avif", "heic": "image/heic", "heif": "image/heif", "ico": "image/vnd.microsoft.icon"}
UNKNOWN = "application/octet-stream"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "strataframe/image-assets")
#: Names of the modes.
ALIASES = {
    "text": "text",
    "text_only": "text",
    "alt": "text",
    "optional": "optional",
    "hybrid": "optional",
    "auto": "optional",
    "omni": "omni",
    "full": "omni",
    "multimodal": "omni",
}


def mode(name: str) -> str:
    """The image mode of a name or alias."""
    try:
        return ALIASES[name.strip().lower().replace("-", "_")]
    except KeyError:
        raise ValueError(f"no image mode {name!r}; there are {sorted(set(ALIASES.values()))}") from None


def references(body: Column) -> Column:
    """(alt, src) of each image in a body, in order."""
    found = F.regexp_extract_all(body, F.lit(REFERENCE), 0)
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, REFERENCE, 1).alias("alt"), F.regexp_extract(m, REFERENCE, 2).alias("src")))


def file_name(src: Column) -> Column:
    """Name for a source: an asset's id, ``image.<kind>`` for data, else the path's last part, decoded."""
    path = F.regexp_replace(src, r"[?#].*$", "")
    last = F.try_url_decode(F.element_at(F.split(path, "/"), -1))
    data = F.concat(F.lit("image."), F.regexp_extract(src, r"^data:image/([a-z0-9]+)", 1))
    name = F.when(src.startswith("asset://"), F.substr(src, F.lit(9))).when(src.startswith("data:"), data).otherwise(last)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("image")).otherwise(name)


def mime(data: Column, name: Column) -> Column:
    """Kind by first bytes, else by the name's suffix."""
    def at(start: int, wanted: bytes) -> Column:
        return F.substring(data, start + 1, len(wanted)) == F.lit(wanted)

    out = F.when(F.lit(False), "")
    for magic, kind in MAGIC:
        out = out.when(at(0, magic), kind)
    out = out.when(at(0, b"RIFF") & at(8, b"WEBP"), "image/webp")
    for brand, kind in BRANDS:
        out = out.when(at(4, b"ftyp") & at(8, brand), kind)
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    for end, kind in SUFFIXES.items():
        out = out.when(suffix == end, kind)
    return out.otherwise(UNKNOWN)


def fallback_caption(name: Column, number: Column, concept: Column) -> Column:
    return F.format_string("%s (image %d in %s)", name, number, F.element_at(F.split(concept, "/"), -1))


def asset_id(concept: Column, number: Column, src: Column) -> Column:
    """An asset's own id, else ``img_`` and the name-based UUID of where it stands."""
    name = F.concat_ws(":", concept, number.cast("string"), src)
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), name.cast("binary")))
    third = F.concat(F.lit("5"), F.substring(digest, 14, 3))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    fourth = F.concat(variant, F.substring(digest, 19, 2))
    made = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), third, fourth, F.substring(digest, 21, 12))
    return F.when(src.startswith("asset://"), F.substr(src, F.lit(9))).otherwise(F.concat(F.lit("img_"), made))


def staged_id(stem: Column, number: Column, data: Column) -> Column:
    head = F.concat_ws("|", stem, number.cast("string"), F.lit(""))
    return F.concat(F.lit("img_"), F.substring(F.sha2(F.concat(head.cast("binary"), data), 256), 1, 16))


def route(how: str, alt: Column, has_data: Column) -> Column:
    """``text`` or ``omni``: how an image of this mode is embedded."""
    described = F.coalesce(alt, F.lit("")) != ""
    omni = {"text": F.lit(False), "optional": ~described & has_data, "omni": has_data}[mode(how)]
    return F.when(omni, "omni").otherwise("text")


def caption(how: str, alt: Column, has_data: Column, fallback: Column) -> Column:
    """The text an image is known by: its alt, else the fallback; null where it is embedded itself."""
    text = F.when(F.coalesce(alt, F.lit("")) != "", alt).otherwise(fallback)
    return F.when(route(how, alt, has_data) == "text", text)


def content_hash(how: Column, payload: Column) -> Column:
    return F.sha2(F.concat(how.cast("binary"), F.lit("|").cast("binary"), payload.cast("binary")), 256)


def data_bytes(src: Column) -> Column:
    """Bytes of a data: source, plain or base64; null for others."""
    body = F.regexp_extract(src, r"^data:[^,]*,(.*)$", 1)
    return F.when(src.rlike(r"^data:[^,]*;base64,"), F.unbase64(body)).when(src.startswith("data:"), F.try_url_decode(body).cast("binary"))
