"""Text columns: keys, HTML cleaning, labels, export escapes. Built-in expressions but for entity unescaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as surrounding whitespace: all of Unicode's, not spaces alone.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def strip(c: Column | str) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def blank_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def key_text(c: Column) -> Column:
    """Lower-cased and stripped; null stays null."""
    return strip(F.lower(c))


def canonical_hash(title: Column, local_date: Column, venue: Column) -> Column:
    """SHA-256 of title|date|venue, normalised: equal for one event whoever lists it."""
    return F.sha2(F.concat_ws("|", key_text(title), local_date.cast("string"), key_text(F.coalesce(venue, F.lit("")))), 256)


@F.pandas_udf(T.StringType())
def _unescape(text):
    import html

    return text.map(html.unescape, na_action="ignore")


def ended_only():
    """Two functions around any reading of markup, after which it has decoded only references that end in a semicolon.

    The first writes other ampersands as something that isn't a reference, the
    second writes them back. Without them ``&amp`` is read as ``&amp;``, as
    browsers do, so a text that was cut inside of a reference may change.
    """
    import re
    from html.entities import html5

    mark, kept, loose = "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2"  # not characters, so no reference gives them
    names = frozenset(n for n in html5 if n.endswith(";"))
    found = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")

    def one(m):
        return m[0] if m[1] and (m[1][0] == "#" or m[1] in names) else loose + (m[1] or "")

    def guard(markup):
        return found.sub(one, markup.replace(mark, kept))

    def restore(text):
        return text.replace(loose, "&").replace(kept, mark)

    return guard, restore


def unescape_ended(c: Column) -> Column:
    """Decodes references that end in a semicolon, leaves all others as they are written."""
    guard, restore = ended_only()

    @F.pandas_udf(T.StringType())
    def unescape(text):
        import html

        return text.map(lambda x: restore(html.unescape(guard(x))), na_action="ignore")

    return unescape(c)


def clean_html(c: Column, unescape=None) -> Column:
    """Markup to text: entities first, line breaks and closing blocks to newlines, tags away, whitespace collapsed.

    Only texts with an ampersand leave the JVM. ``unescape`` may name another
    expression, e.g. unescape_ended or a chain of replace() for a known set of
    entities.
    """
    text = F.when(F.contains(c, F.lit("&")), (unescape or _unescape)(c)).otherwise(c)
    for pattern, to in (
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(?:p|div|h[1-6]|li|section|article)>", "\n\n"),
        (r"<[^>]+>", ""),
        (r"(?U)[^\S\n]+", " "),
        (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def cost_indicator(description: Column) -> Column:
    """free, if the word is there; else paid, if a dollar sign is; else null. Word ends are ASCII."""
    free = description.rlike(r"(?i)(?<![A-Za-z0-9_])free(?![A-Za-z0-9_])")
    return F.when(free, "free").when(F.contains(description, F.lit("$")), "paid")


def location_label(name: Column, address: Column) -> Column:
    return F.concat_ws(", ", blank_as_null(name), blank_as_null(address))


def address_line(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """street, city, "state zip" without the empty parts; null if all are."""
    tail = F.concat_ws(" ", blank_as_null(state), blank_as_null(zip_code))
    return blank_as_null(F.concat_ws(", ", blank_as_null(street), blank_as_null(city), blank_as_null(tail)))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[blank_as_null(c) for c in columns])


def all_day_description(times: Column, description: Column) -> Column:
    """Free-form times before the description, unless they only point to it."""
    useful = (times != "") & ~F.contains(F.lower(times), F.lit("see event description"))
    return F.when(useful, F.concat_ws(" — ", times, blank_as_null(description))).otherwise(description)


def escape_ical(c: Column) -> Column:
    for raw, to in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n"), ("\r", "\\n")):
        c = F.replace(c, F.lit(raw), F.lit(to))
    return c


def ical_filename(title: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.substring(slug, 1, 50), F.lit(".ics"))


def is_http_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def venue_matches(venue: Column, term: str) -> Column:
    """Case-insensitive substring search over venue names."""
    return F.contains(F.lower(venue), F.lit(term.lower()))
