"""Text expressions: trimming, hashed names, picture links, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes, in code-point order.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The picture service address and its options.
PICTURE_URL = "https://ui-avatars.com/api/?name="
UNKNOWN_COVER = PICTURE_URL + "Unknown&background=random"
COVER_OPTIONS = "&color=fff&size=512&length=1&bold=true"
AVATAR_OPTIONS = COVER_OPTIONS + "&font-size=0.7"


def strip_ws(text: Column) -> Column:
    """Remove leading and trailing white space of every kind, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def nonempty(value: Column) -> Column:
    """The value as text, or null when it is missing or empty."""
    text = value.cast("string")
    return F.when(text != "", text)


def percent_encode(text: Column) -> Column:
    """Percent-encode for a link, keeping ``/`` and ``~`` and encoding blanks as %20."""
    form = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        form = F.replace(form, F.lit(found), F.lit(wanted))
    return form


def avatar_url(name: Column, kind: str = "avatar") -> Column:
    """A picture link whose colour is fixed by the name; ``kind`` is avatar or cover."""
    options, empty = {
        "avatar": (AVATAR_OPTIONS, ""),
        "cover": (COVER_OPTIONS, UNKNOWN_COVER),
    }[kind]
    colour = F.substring(F.md5(name), 1, 6)
    link = F.concat(
        F.lit(PICTURE_URL),
        percent_encode(name),
        F.lit("&background="),
        colour,
        F.lit(options),
    )
    return F.when(F.coalesce(name, F.lit("")) == "", empty).otherwise(link)


def short_username(user_id: Column) -> Column:
    return F.substring(F.sha1(user_id.cast("string")), 1, 8)


def fmt_duration(seconds: Column) -> Column:
    """Seconds as ``m:ss``; a missing or not-a-number length shows as 0:00."""
    known = F.coalesce(F.nanvl(seconds.cast("double"), F.lit(0.0)), F.lit(0.0))
    minutes = F.floor(known / 60).cast("string")
    rest = F.lpad(F.floor(known % 60).cast("string"), 2, "0")
    return F.concat(minutes, F.lit(":"), rest)


def words(text: Column) -> Column:
    """Lower-case words of a name: maximal runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda word: word != "")


def new_id() -> Column:
    """A fresh random id; write the result before anything reads it twice."""
    return F.uuid()
