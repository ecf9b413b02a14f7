"""Images that Markdown refers to: finding them, telling data from files from remote ones, and their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an image link; group 1 is what it refers to.
IMAGE_LINK = r"!\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)"


def image_links(text: Column) -> Column:
    """What the image links of a text refer to, in order; of null none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(IMAGE_LINK), F.lit(1)), F.array().cast("array<string>"))


def kind(link: Column) -> Column:
    """data, remote or file. A scheme is a letter, then letters, digits, +, - or dots, up to a colon."""
    return F.when(link.startswith("data:"), "data").when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | link.startswith("//"), "remote").otherwise("file")


def unquoted(text: Column) -> Column:
    """Percent escapes decoded; a plus stays a plus, and what isn't an escape stays as it is."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(safe)


def data_bytes(link: Column) -> Column:
    """The bytes of a data: link, or null if they can't be decoded."""
    header, payload = F.substring_index(link, ",", 1), F.when(link.contains(","), F.regexp_replace(link, "(?s)^[^,]*,", "")).otherwise(F.lit(""))
    plain = unquoted(payload)
    return F.when(header.contains(";base64"), F.try_to_binary(F.regexp_replace(payload, "[^A-Za-z0-9+/=]", ""), F.lit("base64"))).when(~plain.rlike(r"[^\x{00}-\x{FF}]"), F.encode(plain, "ISO-8859-1"))


def local_path(link: Column) -> Column:
    """The path of a file link, without query and fragment, its dots resolved; null if it leads out of its folder."""
    path = unquoted(F.regexp_replace(link, "[?#].*$", ""))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # Each ".." takes a name away; below the folder there is none to take.
    step = lambda done, p: F.when(done.isNull(), done).when(p != "..", F.concat(done, F.array(p))).when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.lit(None).cast("array<string>"))
    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~path.startswith("/") & (F.size(walked) > 0), F.array_join(walked, "/"))


def warning(link: Column, read: Column) -> Column:
    """Why a link's image was not read: null if it was. read: whether its bytes are there."""
    short, k = F.left(link, F.lit(80)), kind(link)
    return (
        F.when(read, F.lit(None).cast("string"))
        .when(k == "data", F.lit("an inline data: image could not be decoded"))
        .when(k == "remote", F.concat(F.lit("remote image not fetched (no network calls are made): "), short))
        .when(local_path(link).isNull(), F.concat(F.lit("image outside the document's folder was not read: "), short))
        .otherwise(F.concat(F.lit("image file not found: "), short))
    )
