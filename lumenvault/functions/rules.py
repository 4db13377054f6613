"""Column rules: names, keys, records, sources, media classes, mail. Every rule is a pure column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the domain.
STILL, CLIP = ("jpg", "jpeg", "png", "webp"), ("gif", "mp4", "m4v", "webm")
MEDIA = STILL + CLIP
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "mp4": "video/mp4", "m4v": "video/x-m4v", "webm": "video/webm"}
SOURCE_HOSTS = ("reddit.com", "www.reddit.com", "old.reddit.com", "new.reddit.com")
#: Weights of the copy to keep: pixels, duration of moving media, lossless formats, bytes.
RESOLUTION, DURATION, LOSSLESS, SIZE = 1.0, 0.9, 0.12, 0.08
FIXED_LOCALS = ("abuse", "dmca", "postmaster", "security")
MAX_MESSAGE = 25 * 1024 * 1024


def extension_of(key: Column) -> Column:
    """What follows the last dot of the last path segment, lower case; '' without one."""
    return F.lower(F.regexp_extract(key, r"\.([^./]*)$", 1))


def safe_key(key: Column) -> Column:
    """Whether a key can be used as a path; a null key cannot."""
    parts = F.split(key, "/")
    return F.coalesce((key != "") & ~key.startswith("/") & ~key.contains("\\") & ~F.array_contains(parts, ".."), F.lit(False))


def valid_record(size: Column, sha1: Column) -> Column:
    """Whether a record has content and a digest of the right form or none; without a size or digest field it is invalid."""
    return F.coalesce((size > 0) & (sha1.isin("", "none") | sha1.rlike("^[0-9a-fA-F]{40}$")), F.lit(False))


def reject_reason(extension: Column, size: Column, most: int) -> Column:
    return F.when(~extension.isin(*MEDIA), "type").when(size <= 0, "empty").when(size > most, "large").otherwise("ok")


def safe_name(name: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen stay; the last 160 characters; `media.bin` if nothing is left."""
    clean = F.right(F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_"), F.lit(160))
    return F.when(F.length(clean) == 0, "media.bin").otherwise(clean)


def canonical_key(prefix: str, relative: Column, content: Column) -> Column:
    digest = F.sha1(F.concat(F.encode(relative, "UTF-8"), F.lit(b"\0"), F.encode(content, "UTF-8")))
    return F.concat(F.lit(prefix), F.substring(digest, 1, 20), F.lit("_"), safe_name(F.substring_index(relative, "/", -1)))


def source_identity(value: Column) -> Column:
    return F.substring(F.sha2(F.lower(value), 256), 1, 16)


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _bare(value: Column) -> Column:
    """A name without outer slashes and what comes before and after `r/name`."""
    v = F.regexp_replace(value, "^/+|/+$", "")
    return F.when(F.lower(v).startswith("r/"), F.split_part(F.substring(v, 3, 1 << 30), F.lit("/"), F.lit(1))).otherwise(v)


def _named(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9_]{3,21}$")


def normalised_source(value: Column) -> Column:
    """The listing url of a bare name, an r/ path or a url as a whole (optional www, old or new host); '' if it is none."""
    v = _stripped(value)
    in_url = F.regexp_extract(v, r"(?i)^https?://(?:www\.|old\.|new\.)?reddit\.com/r/([A-Za-z0-9_]{3,21})(?:/.*)?$", 1)
    name = F.when(v.startswith("https://") | v.startswith("http://"), in_url).otherwise(_bare(v))
    return F.coalesce(F.when(_named(name), F.concat(F.lit("https://www.reddit.com/r/"), name, F.lit("/new/"))), F.lit(""))


def normalised_source_api(value: Column) -> Column:
    """The bare name by the rule of the request interface, '' if there is none.

    A url needs a known host (sign-in and port aside) and a path whose first parts, empty ones aside, are r and the name.
    """
    v = _stripped(value)
    host = F.lower(F.regexp_extract(v, r"(?i)^https?:/+(?:[^/?#]*@)?([^/?#:@]*)(?::[0-9]*)?(?:[/?#]|$)", 1))
    in_url = F.regexp_extract(v, r"(?i)^https?:/+[^/?#]*/+r/+([^/?#]+)", 1)
    name = F.when(v.rlike("(?i)^https?://"), F.when(host.isin(*SOURCE_HOSTS), in_url)).otherwise(F.split_part(_bare(v), F.lit("/"), F.lit(1)))
    return F.coalesce(F.when(_named(name), name), F.lit(""))


def media_class(extension: Column) -> Column:
    return F.when(extension.isin(*STILL), "stills").when(extension.isin(*CLIP), "clips")


def buckets_of(extension: Column) -> Column:
    """The buckets an item is in: `all`, and by a known extension its class and itself."""
    e = F.lower(extension)
    return F.array_compact(F.array(F.lit("all"), media_class(e), F.when(e.isin(*MEDIA), e)))


def requested_bucket(name: Column) -> Column:
    """The bucket that a request means; an unknown name means all."""
    n = F.lower(name)
    return F.when(n.isin("stills", "clips", *MEDIA), n).otherwise("all")


def recipient_verdict(recipient: Column, size: Column, domain: str, suffix: str) -> Column:
    """What becomes of a message: size first, then the address's form and domain, then its local part.

    Fixed names match in any case; the suffix and the alias before it are taken as written.
    """
    host = F.substring_index(recipient, "@", -1)
    at = F.length(recipient) - F.length(host)
    local = F.substring(recipient, F.lit(1), at - 1)
    alias = F.substring(local, F.lit(1), F.length(local) - len(suffix))
    return (
        F.when(size > MAX_MESSAGE, "too large").when((at <= 1) | (host == ""), "malformed").when(F.lower(host) != domain, "foreign").when(F.lower(local).isin(*FIXED_LOCALS), "fixed")
        .when(~local.endswith(suffix), "no suffix").when((alias == "") | alias.startswith(".") | alias.endswith(".") | ~alias.rlike(r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+$"), "bad alias").otherwise("alias")
    )


def scrubbed(text: Column, private: Column, public: Column) -> Column:
    """`private` replaced in any case, literally."""
    literal = F.regexp_replace(private, r"([^A-Za-z0-9])", r"\\$1")
    return F.regexp_replace(text, F.concat(F.lit("(?i)"), literal), public)


def html_text(html: Column) -> Column:
    """The text of a page: no style or script (each up to its own closing tag), line ends for breaks, no tags, four entities."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<style.*?</style>", ""), r"(?is)<script.*?</script>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>", "\n"), r"(?i)</p>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.regexp_replace(out, f"(?i){entity}", plain)
    return out


def survivor_quality(width: Column, height: Column, duration: Column, kind: Column, extension: Column, size: Column, resolution: float = RESOLUTION, lasting: float = DURATION, lossless: float = LOSSLESS, bytes_: float = SIZE) -> Column:
    """Score of the copy to keep by the weights given; -infinity without a media kind (no fingerprint)."""
    logged = lambda x: F.log2(F.greatest(F.lit(1.0), x.cast("double")))
    pixels = resolution * logged(width.cast("bigint") * height)
    moving = F.when(kind != 1, lasting * logged(F.coalesce(duration, F.lit(0)))).otherwise(0.0)
    bonus = F.when(extension.isin("png", "webp", "gif"), lossless).otherwise(0.0)
    return F.when(kind.isNull(), F.lit(float("-inf"))).otherwise(pixels + moving + bonus + bytes_ * logged(size))


def _day(seconds: Column, pattern: str) -> Column:
    """The UTC day of a time in seconds, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")), pattern)


def _clock(seconds: Column, between: str) -> Column:
    of_day = F.pmod(seconds, F.lit(86_400))
    part = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat_ws(between, part(F.floor(of_day / 3600)), part(F.floor(of_day / 60) % 60), part(of_day % 60))


def iso_time(seconds: Column) -> Column:
    """Epoch seconds as 2024-01-31T05:06:07Z."""
    return F.concat(_day(seconds, "yyyy-MM-dd"), F.lit("T"), _clock(seconds, ":"), F.lit("Z"))


def generation_id(seconds: Column, token: Column) -> Column:
    """The name of a generation begun then: 20240131T050607Z and ten digits of a digest of `token`."""
    return F.concat(_day(seconds, "yyyyMMdd"), F.lit("T"), _clock(seconds, ""), F.lit("Z-"), F.substring(F.sha2(token, 256), 1, 10))


def mail_date(seconds: Column, now: int) -> Column:
    """The date line of a message: Wed, 31 Jan 2024 05:06:07 GMT; of `now` where it has no readable date."""
    at = F.coalesce(seconds, F.lit(now).cast("long"))
    return F.concat(_day(at, "EEE, dd MMM yyyy"), F.lit(" "), _clock(at, ":"), F.lit(" GMT"))
