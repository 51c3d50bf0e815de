"""Formats of texts as Column arithmetic: splitting, counting and casting, without one large pattern a format.

``asserted`` holds a text against the rules of a format (RFC 3339 dates with a real calendar day, RFC 5321 addresses, RFC 4122, RFC 3986, RFC 4291).
``detected`` names the first format that a text looks like, by shape: a space may stand for the T of a date-time, and
months and days are only bounded. So a detected format need not be a valid one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789"
HEX = DIGITS + "abcdefABCDEF"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed sets of characters: of an atom in an address, of URIs, and of the local part that a detected address has.
ATOM = LETTERS + DIGITS + "!#$%&'*+/=?^_`{|}~-"
URI = LETTERS + DIGITS + "-._~:/?#[]@!$&'()*+,;=%"
LOCAL = LETTERS + DIGITS + "._%+-"
#: Fixed schemes that are detected without slashes.
OPAQUE = ("mailto", "urn", "tel", "data", "news")


def only(text: Column, chars: str) -> Column:
    """Whether a text has no other characters than these."""
    return F.translate(text, chars, "") == ""


def shape(text: Column) -> Column:
    """A text with every digit as 9."""
    return F.translate(text, DIGITS, "9" * 10)


def _from(text: Column, at: int, n: int = 2**31 - 1) -> Column:
    return F.substring(text, at, n)


def _number(text: Column, at: int, n: int = 2) -> Column:
    return _from(text, at, n).try_cast("int")


def is_date(t: Column) -> Column:
    year, month, day = _number(t, 1, 4), _number(t, 6), _number(t, 9)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return (shape(t) == "9999-99-99") & month.between(1, 12) & day.between(1, last)


def _clock(t: Column, strict: bool) -> Column:
    """hh:mm:ss, digits after a point or none, and Z or an offset."""
    rest = _from(t, 9)
    zulu = F.upper(F.right(rest, F.lit(1))) == "Z"
    zone = F.when(zulu, "Z").otherwise(F.right(rest, F.lit(6)))
    fraction = F.left(rest, F.char_length(rest) - F.when(zulu, 1).otherwise(6))
    plain = (fraction == "") | (fraction.startswith(".") & (F.char_length(fraction) > 1) & only(_from(fraction, 2), DIGITS))
    offset = shape(zone).isin("+99:99", "-99:99")
    good = (shape(F.left(t, F.lit(8))) == "99:99:99") & plain & (zulu | offset)
    if not strict:
        return good
    return good & (_number(t, 1) <= 23) & (_number(t, 4) <= 59) & (_number(t, 7) <= 60) & (zulu | ((_number(zone, 2) <= 23) & (_number(zone, 5) <= 59)))


def is_time(t: Column) -> Column:
    return _clock(t, True)


def is_date_time(t: Column) -> Column:
    return is_date(F.left(t, F.lit(10))) & _from(t, 11, 1).isin("T", "t") & is_time(_from(t, 12))


def _is_label(t: Column) -> Column:
    return F.char_length(t).between(1, 63) & only(t, LETTERS + DIGITS + "-") & ~t.startswith("-") & ~t.endswith("-")


def is_hostname(t: Column) -> Column:
    host = F.when(t.endswith("."), F.left(t, F.char_length(t) - 1)).otherwise(t)
    return F.char_length(host).between(1, 253) & F.forall(F.split(host, r"\."), _is_label)


def is_email(t: Column) -> Column:
    parts = F.split(t, "@")
    local, domain = F.get(parts, 0), F.get(parts, 1)
    dotted = F.forall(F.split(local, r"\."), lambda x: (x != "") & only(x, ATOM))
    return (F.size(parts) == 2) & (F.char_length(t) <= 254) & dotted & F.forall(F.split(domain, r"\."), _is_label)


def is_uuid(t: Column) -> Column:
    return F.translate(t, HEX, "x" * len(HEX)) == "-".join("x" * n for n in (8, 4, 4, 4, 12))


def is_ipv4(t: Column) -> Column:
    octet = lambda x: F.char_length(x).between(1, 3) & only(x, DIGITS) & ((F.char_length(x) == 1) | ~x.startswith("0")) & (x.try_cast("int") <= 255)
    parts = F.split(t, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, octet)


def is_ipv6(t: Column) -> Column:
    """Eight groups of hex digits, or at most seven and one gap; the last two may be an IPv4 address."""
    halves = F.split(t, "::")
    groups = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))
    every = F.concat(groups(F.get(halves, 0)), F.when(F.size(halves) > 1, groups(F.get(halves, 1))).otherwise(F.array().cast("array<string>")))
    last = F.try_element_at(every, F.lit(-1))
    tail = F.coalesce(last.contains("."), F.lit(False))
    hexes = F.when(tail, F.slice(every, F.lit(1), F.size(every) - 1)).otherwise(every)
    count = F.size(every) + tail.cast("int")
    sized = ((F.size(halves) == 1) & (count == 8)) | ((F.size(halves) == 2) & (count <= 7))
    return (t != "") & sized & (~tail | F.coalesce(is_ipv4(last), F.lit(False))) & F.forall(hexes, lambda x: F.char_length(x).between(1, 4) & only(x, HEX))


def is_uri_reference(t: Column) -> Column:
    escapes = F.slice(F.split(t, "%"), F.lit(2), F.size(F.split(t, "%")))
    return only(t, URI) & (F.size(F.split(t, "#")) <= 2) & F.forall(escapes, lambda x: (F.char_length(x) >= 2) & only(F.left(x, F.lit(2)), HEX))


def is_uri(t: Column) -> Column:
    scheme = F.substring_index(t, ":", 1)
    return is_uri_reference(t) & t.contains(":") & (scheme != "") & only(F.left(scheme, F.lit(1)), LETTERS) & only(scheme, LETTERS + DIGITS + "+.-")


def is_regex(t: Column) -> Column:
    """Whether Spark could search by the pattern; asked of the JVM, where a pattern that can't be compiled gives null."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), t).isNotNull()


#: The asserted formats by name, with what a message calls a valid text.
ASSERTED = {
    "date-time": (is_date_time, "date-time"),
    "date": (is_date, "date"),
    "time": (is_time, "time"),
    "email": (is_email, "email address"),
    "uuid": (is_uuid, "UUID"),
    "uri": (is_uri, "URI"),
    "uri-reference": (is_uri_reference, "URI reference"),
    "ipv4": (is_ipv4, "IPv4 address"),
    "ipv6": (is_ipv6, "IPv6 address"),
    "hostname": (is_hostname, "hostname"),
    "regex": (is_regex, "regular expression"),
}


def asserted(name: str, text: Column) -> Column:
    """Whether a text is valid by the format; null for null."""
    return F.when(text.isNotNull(), F.coalesce(ASSERTED[name][0](text), F.lit(False)))


def _looks_like_email(t: Column) -> Column:
    parts = F.split(t, "@")
    labels = F.split(F.get(parts, 1), r"\.")
    return (F.size(parts) == 2) & (F.get(parts, 0) != "") & only(F.get(parts, 0), LOCAL) & (F.size(labels) > 1) & F.forall(labels, lambda x: (x != "") & only(x, LETTERS + DIGITS + "-"))


def _looks_like_uri(t: Column) -> Column:
    scheme = F.substring_index(t, ":", 1)
    rest = t.substr(F.char_length(scheme) + 2, F.char_length(t))
    spaced = t.rlike(r"(?U)\s")
    named = (scheme != "") & only(F.left(scheme, F.lit(1)), LETTERS) & only(scheme, LETTERS + DIGITS + "+.-") & rest.startswith("//") & (F.char_length(rest) > 2)
    return t.contains(":") & ~spaced & (named | (scheme.isin(*OPAQUE) & (rest != "")))


def detected(t: Column) -> Column:
    """The first format that a text looks like, else null; a text without any of ``-:@.`` has none."""
    day = shape(F.left(t, F.lit(10))) == "9999-99-99"
    return (
        F.when(F.translate(t, "-:@.", "") == t, F.lit(None).cast("string"))
        .when(day & _from(t, 11, 1).isin("T", "t", " ") & _clock(_from(t, 12), False), "date-time")
        .when(day & (F.char_length(t) == 10) & _number(t, 6).between(1, 12) & _number(t, 9).between(1, 31), "date")
        .when(_clock(t, False), "time")
        .when(_looks_like_email(t), "email")
        .when(is_uuid(t), "uuid")
        .when(is_ipv4(t), "ipv4")
        .when(_looks_like_uri(t), "uri")
    )
