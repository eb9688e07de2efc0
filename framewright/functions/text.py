"""Names, paths and stamps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.constants import IMAGE_EXTENSIONS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """Null for null, empty or white-space text; other text unchanged."""
    c = _c(c)
    return F.when(F.trim(c) != "", c)


def file_name(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def parent_of(path) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def has_extension(path, extensions=IMAGE_EXTENSIONS) -> Column:
    """Case-insensitive suffix test; a filter because listing globs mind the case."""
    return F.lower(_c(path)).rlike(r"\.(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")


def ignoring_case(c) -> list[Column]:
    """Sort keys: text ignoring case, exact text as the tie-break."""
    c = _c(c)
    return [F.lower(c), c]


def sanitized(c, default: str = "Crop") -> Column:
    """Keep letters, digits, dot, underscore and dash; blank becomes the default."""
    return F.coalesce(F.regexp_replace(blank_to_null(c), "[^A-Za-z0-9._-]", "_"), F.lit(default))


def segment_folder(prefix, start, end) -> Column:
    """Folder of one video segment; a blank prefix is named after its range."""
    whole = (_c(start) < 0) | (_c(end) < 0)
    fallback = F.when(whole, F.lit("seg_full_full")).otherwise(
        F.concat(F.lit("seg_"), _c(start).cast("string"), F.lit("_"), _c(end).cast("string")))
    clean = F.regexp_replace(F.trim(F.coalesce(_c(prefix), F.lit(""))), "[^A-Za-z0-9._-]", "_")
    return F.when(F.length(clean) == 0, fallback).otherwise(clean)


def size_label(w, h) -> Column:
    return F.concat(_c(w).cast("string"), F.lit("x"), _c(h).cast("string"))


def crop_file_name(prefix, w, h, number) -> Column:
    return F.format_string("%s_%dx%d_%05d.png", _c(prefix), _c(w), _c(h), _c(number))


def sequence_in_name(name) -> Column:
    """Digits between the last underscore and the last dot of a PNG name."""
    tail = F.regexp_extract(_c(name), r"_([^_]*)\.[^._]*$", 1)
    return F.regexp_replace(tail, r"\D", "").try_cast("int")


def utc_stamp(ts) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd'T'HHmmss'Z'")


def stamp_to_iso(stamp) -> Column:
    """``yyyyMMddTHHmmssZ`` to ISO text; text of another length is kept."""
    s = _c(stamp)

    def cut(at, n):
        return F.substring(s, at, n)

    iso = F.concat(cut(1, 4), F.lit("-"), cut(5, 2), F.lit("-"), cut(7, 2), F.lit("T"),
                   cut(10, 2), F.lit(":"), cut(12, 2), F.lit(":"), cut(14, 2), F.lit("Z"))
    return F.when(F.length(s) == 16, iso).otherwise(s)


def volume_base_name(name) -> Column:
    return F.regexp_replace(_c(name), r"(?i)\.nii(\.gz)?$", "")


def export_name(prefix, name, fmt: str) -> Column:
    """Prefix + name without its last suffix + new suffix."""
    base = F.regexp_replace(_c(name), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.trim(F.coalesce(_c(prefix), F.lit(""))), base, F.lit("." + fmt))


def storage_key(prefix, w, h, name) -> Column:
    return F.concat_ws("/", _c(prefix), size_label(w, h), _c(name))


def saved_as(connection: str, bucket: str, key) -> Column:
    return F.concat(F.lit(f"{connection}://{bucket}/"), _c(key))


def local_key(annotation, w, h, name) -> Column:
    return F.concat_ws("/", F.coalesce(blank_to_null(annotation), F.lit("image")), size_label(w, h), _c(name))


def image_location(path, source_root) -> Column:
    """An absolute path wins; a relative one is placed under the source root."""
    p = _c(path)
    rooted = F.concat_ws("/", F.regexp_replace(_c(source_root), "/+$", ""), p)
    return F.when(p.startswith("/") | blank_to_null(source_root).isNull(), p).otherwise(rooted)


def sink_location(override, manifest_sink, fallback) -> Column:
    return F.coalesce(blank_to_null(override), blank_to_null(manifest_sink), blank_to_null(fallback))


def scope_prefix(scope: str, bucket: str) -> str:
    """Key prefix of a scope text such as ``/bucket/a/b``; always ends in a slash."""
    text = (scope or "").strip().lstrip("/").removeprefix(bucket + "/").lstrip("/")
    return text if not text or text.endswith("/") else text + "/"
