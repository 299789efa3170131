"""Identifiers and instants as their senders spell them, brought to one form on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANKS = r"\p{IsWhite_Space}*"
#: Notations of a UUID after a mark: plain, 32 digits, braces or parentheses, urn:uuid: and uuid: prefixes, any case, outer blanks; not all zero.
UUID_PATTERN = (
    rf"^#{_BLANKS}(?i:urn:)?(?i:uuid:)?[{{(]?(?!0{{8}}-?0{{4}}-?0{{4}}-?0{{4}}-?0{{12}}[^0-9a-fA-F]*$)"
    rf"([0-9a-fA-F]{{8}})-?([0-9a-fA-F]{{4}})-?([0-9a-fA-F]{{4}})-?([0-9a-fA-F]{{4}})-?([0-9a-fA-F]{{12}})[)}}]?{_BLANKS}$"
)
#: ISO-8601 date and time after a mark: date, time of day, offset.
ISO_PATTERN = rf"^#{_BLANKS}(\d{{4}}-\d{{2}}-\d{{2}})[T ](\d{{2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d{{1,9}})?)?) ?(Z|z|[+-]\d{{2}}(?::?\d{{2}})?)?{_BLANKS}$"


def _marked(c: Column | str) -> Column:
    """The text after a mark; what a pattern doesn't meet keeps the mark, and so can't be read as a number or time."""
    return F.concat(F.lit("#"), F.col(c) if isinstance(c, str) else c)


def uuid_key(c: Column | str) -> Column:
    """The 16 bytes of a UUID in any usual notation, outer blanks aside.

    Null for null, for text that is no UUID and for the all-zero UUID.
    """
    return F.unhex(F.regexp_replace(_marked(c), UUID_PATTERN, "$1$2$3$4$5"))


def iso_micros(c: Column | str) -> Column:
    """Microseconds since 1970 UTC of an ISO-8601 text; without an offset it is UTC.

    Null for null and for text that can't be read as a date with a time of day. The text is looked at once.
    """
    parts = F.regexp_replace(_marked(c), ISO_PATTERN, "$1T$2|$3")
    hours = F.regexp_replace(parts, r"\|([+-]\d{2})$", "|$1:00")
    return F.unix_micros(F.try_to_timestamp(F.translate(F.regexp_replace(hours, r"\|$", "Z"), ",z|", ".Z")))


def micros_of(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC of a timestamp column; one without a zone is taken as UTC."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name))
        return F.unix_micros(local.cast("timestamp"))
    return F.unix_micros(F.col(name))


def joined_words(c: Column | str) -> Column:
    """Spelling of a tag or task id without letter case, outer blanks and the choice of ``_``, ``-`` or blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.lower(F.trim(F.translate(c, "\t\n\r ", "    "))), "- ", "__")
