"""Checks of what is uploaded or fetched: size, type, address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1024 * 1024
#: What each kind of upload may be: largest size, media types, suffixes.
KINDS = {
    "image": (10 * MIB, ("image/jpeg", "image/png", "image/webp", "image/gif"), (".jpg", ".jpeg", ".png", ".webp", ".gif")),
    "video": (250 * MIB, ("video/mp4", "video/quicktime", "video/x-matroska", "video/webm"), (".mp4", ".mov", ".mkv", ".webm")),
    "pdf": (25 * MIB, ("application/pdf",), (".pdf",)),
    "docx": (25 * MIB, ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), (".docx",)),
}
MAX_PIXELS = 40_000_000
MAX_FRAMES = 120

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
_AUTHORITY = r"^[^:]+://([^/?#]*)"


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(url, _AUTHORITY, 1), r"([^@:]*)(:[0-9]+)?$", 1)


def url_status(url: Column, secure_only: bool = False) -> Column:
    """ok, or why an address is refused: bad_scheme, no_host, has_user."""
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    return (
        F.when(~scheme.isin(*(("https",) if secure_only else ("http", "https"))), "bad_scheme")
        .when(authority == "", "no_host")
        .when(F.contains(authority, F.lit("@")), "has_user")
        .otherwise("ok")
    )


def is_private_address(host: Column) -> Column:
    """True for a literal IPv4 address that is not public."""
    part = lambda i: F.try_to_number(F.split_part(host, F.lit("."), F.lit(i)), F.lit("999")).cast("int")
    a, b = part(1), part(2)
    inside = (
        a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127)) | (a >= 224)
    )
    return host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.coalesce(inside, F.lit(False))


def upload_status(kind: str, name: Column, media: Column, size: Column) -> Column:
    """ok, or why an upload is refused: empty, too_large, bad_type, bad_suffix."""
    most, types, suffixes = KINDS[kind]
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(size > most, "too_large")
        .when(~F.coalesce(media, F.lit("")).isin(*types), "bad_type")
        .when(~suffix.isin(*suffixes), "bad_suffix")
        .otherwise("ok")
    )


def frame_rate(seconds: Column) -> Column:
    """Frames a second so that a video gives ``MAX_FRAMES`` at most, between 0.1 and 1."""
    usable = seconds.isNotNull() & (seconds > 0)
    return F.when(usable, F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.lit(float(MAX_FRAMES)) / seconds))).otherwise(1.0)


def batch_size(depth: Column) -> Column:
    return F.when(depth <= 5, 4).when(depth <= 20, 8).when(depth <= 50, 16).otherwise(32)


def read_files(spark, path: str, pattern: str = "*") -> DataFrame:
    """Files with their path, length and content, where the pattern matches."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
