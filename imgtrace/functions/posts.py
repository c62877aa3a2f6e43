"""Rules over post metadata: tags, URLs, labels, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")

RATING_ALIASES = {
    "g": "g", "general": "g",
    "s": "s", "sensitive": "s",
    "q": "q", "questionable": "q",
    "e": "e", "explicit": "e",
}
RATING_LABELS = {
    "ko": {"g": "전체 이용가", "s": "다소 민감", "q": "선정적", "e": "노골적", "": "등급 없음"},
    "en": {"g": "General", "s": "Sensitive", "q": "Questionable", "e": "Explicit", "": "Unrated"},
}

SKIP_DELETED = "삭제된 게시물"
SKIP_BANNED = "차단된 게시물"
SKIP_NO_URL = "지원하는 이미지 URL 없음"

TAG_CATEGORIES = ("artist", "character", "copyright", "general", "meta")
VISIBLE_TAGS = 12
# --------------------------------------------------------------------------

_USABLE_URL = r"(?is)^[^?#]*\.(" + "|".join(IMAGE_EXTENSIONS) + r")([?#].*)?\z"


def split_tags(c: Column) -> Column:
    """Whitespace-separated words, no empties; NULL gives an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def merged_tags(tag_string: Column, *categories: Column) -> Column:
    """The full tag string, or the category strings joined, first occurrence kept."""
    whole = split_tags(tag_string)
    parts = F.array_distinct(F.concat(*[split_tags(c) for c in categories]))
    return F.when(F.size(whole) > 0, whole).otherwise(parts)


def usable_url(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(_USABLE_URL)


def download_url(large: Column, file: Column, preview: Column) -> Column:
    """First URL in order large, file, preview that points at a still picture."""
    return F.coalesce(*[F.when(usable_url(c), c) for c in (large, file, preview)], F.lit(""))


def skip_reason(deleted: Column, banned: Column, url: Column) -> Column:
    """'' means the post is to be processed."""
    return (
        F.when(F.coalesce(deleted, F.lit(False)), SKIP_DELETED)
        .when(F.coalesce(banned, F.lit(False)), SKIP_BANNED)
        .when(url == "", SKIP_NO_URL)
        .otherwise("")
    )


def rating_label(c: Column, lang: str = "en") -> Column:
    """Readable rating; unknown words pass through untouched, blank is unrated."""
    labels = RATING_LABELS[lang]
    key = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    out = F.when(key == "", labels[""])
    for word, short in RATING_ALIASES.items():
        out = out.when(key == word, labels[short])
    return out.otherwise(c)


def post_label(site: Column, post_id: Column, artists: Column) -> Column:
    head = F.concat(site, F.lit(" #"), post_id.cast("string"))
    names = F.array_join(artists, ", ")
    return F.when(F.size(artists) > 0, F.concat(head, F.lit(" · "), names)).otherwise(head)


def visible_tags(tags: Column, limit: int = VISIBLE_TAGS) -> Column:
    shown = F.array_join(F.slice(tags, 1, limit), ", ")
    more = F.concat(F.lit(" and "), (F.size(tags) - limit).cast("string"), F.lit(" more"))
    return F.when(F.size(tags) > limit, F.concat(shown, more)).otherwise(shown)


def http_links(*urls: Column) -> Column:
    """Only http/https links, in the given order."""
    return F.filter(
        F.array(*[F.coalesce(u, F.lit("")) for u in urls]),
        lambda u: u.startswith("http://") | u.startswith("https://"),
    )


def safe_segment(site: Column) -> Column:
    """One folder name: ASCII lower case, other characters become '-'."""
    ascii_lower = F.translate(site, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    dashed = F.regexp_replace(ascii_lower, r"[^a-z0-9_-]", "-")
    trimmed = F.regexp_replace(dashed, r"^-+|-+$", "")
    return F.when(trimmed == "", "unknown").otherwise(trimmed)


def thumb_path(site: Column, post_id: Column) -> Column:
    """site/ll/hh/<id>.jpg with the two low bytes as fan-out folders."""
    low = post_id.bitwiseAND(F.lit(0xFF))
    high = F.shiftright(post_id, 8).bitwiseAND(F.lit(0xFF))
    return F.format_string("%s/%02x/%02x/%d.jpg", safe_segment(site), low, high, post_id)


def canonical_url(base: str, post_id: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/posts/"), post_id.cast("string"))


def query_key(picture_bytes: Column) -> Column:
    return F.sha2(picture_bytes, 256)


def payload(df) -> Column:
    """Seven-field struct stored next to an index point."""
    return F.struct(
        F.coalesce(df["image_id"], F.lit(0)).alias("image_id"),
        *[F.coalesce(df[c], F.lit("")).alias(c) if c != "source_post_id"
          else F.coalesce(df[c], F.lit(0)).alias(c)
          for c in ("source_site", "source_post_id", "canonical_url", "rating", "phash", "dhash")],
    )
