"""String functions shared by the jobs. Every function maps Columns to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a field is trimmed.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# One field of a comma line: plain runs and quoted runs. A quote that is never
# closed runs to the end of the line.
QUOTED_FIELD = r',((?:[^",]++|"[^"]*+(?:"|\z))*+)'


def known(c: Column) -> Column:
    """Missing text is the empty string everywhere in this package."""
    return F.coalesce(c, F.lit(""))


def full_trim(c: Column) -> Column:
    """Trim Unicode white space and BOM; Spark's own ``trim`` only drops spaces."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return full_trim(known(c)) == ""


def identity_key(dni: Column) -> Column:
    """Leading zeros go first, white space second, so ``" 012"`` keeps its zero."""
    return full_trim(F.ltrim(known(dni), F.lit("0")))


def field(parts: Column, position: int) -> Column:
    """Element of a split line, empty when the line is too short."""
    return known(F.get(parts, F.lit(position)))


def split_quoted(line: Column) -> Column:
    """Raw comma fields where each quote toggles whether commas separate."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(QUOTED_FIELD), F.lit(1))


def quoted_field(parts: Column, position: int) -> Column:
    """One field of :func:`split_quoted`, without its quotes and trimmed."""
    return full_trim(F.translate(field(parts, position), '"', ""))


def file_stem(name: Column) -> Column:
    """Lower-case file name up to its first dot."""
    return F.substring_index(F.lower(name), ".", 1)


def contains_text(c: Column, text: str) -> Column:
    """Literal, case-insensitive substring test."""
    return F.lower(c).contains(F.lower(F.lit(text)))


def highlight(c: Column, text: str) -> Column:
    """Mark every literal, case-insensitive occurrence of ``text``."""
    if not text:
        return c
    quoted = text.replace("\\E", "\\E\\\\E\\Q")
    return F.regexp_replace(c, f"(?iu)(\\Q{quoted}\\E)", "<mark>$1</mark>")


def search_name(name: Column) -> Column:
    """The form of an extracted name that is compared with the roster."""
    return full_trim(F.lower(known(name)))


# Fixed values of the name link: shortest name tried, least number of edits
# always accepted, share of the name's length accepted above that.
SHORTEST_NAME = 4
LEAST_EDITS = 3
LENGTH_PER_EDIT = 4


def accepted_edits(length: Column) -> Column:
    """Largest edit distance at which a name of this length is linked."""
    return F.greatest(F.lit(LEAST_EDITS), (length / LENGTH_PER_EDIT).cast("int"))


def single_line_base64(content: Column) -> Column:
    """Base64 without the line breaks that Spark inserts."""
    return F.regexp_replace(F.base64(content), "\r\n", "")


# Identity numbers of participants: up to six base-36 characters, in two halves of three.
ID_HALF = 36**3
ID_ROUNDS = 4


def participant_id(id_ref: Column, position: Column) -> Column:
    """``x`` and up to six base-36 characters from the place (from 1) in a reference.

    A Feistel permutation of the numbers below 36^6, keyed by the reference: places of one
    reference never share an id (up to 36^6 of them), and a repeated run gives the same ids.
    """
    place = F.pmod(position.cast("long") - 1, F.lit(ID_HALF**2))
    low = F.pmod(place, F.lit(ID_HALF))
    halves = F.struct(((place - low) / ID_HALF).cast("long").alias("left"), low.alias("right"))
    digest = F.md5(id_ref.cast("binary"))
    keys = F.array(
        *(F.conv(F.substring(digest, 1 + 5 * r, 5), 16, 10).cast("long") for r in range(ID_ROUNDS))
    )

    def turned(now: Column, key: Column) -> Column:
        x = now["right"] + key
        mixed = F.pmod(x * x * 48271 + x * 69621, F.lit(2**31 - 1))
        right = F.pmod(now["left"] + mixed, F.lit(ID_HALF))
        return F.struct(now["right"].alias("left"), right.alias("right"))

    number = F.aggregate(keys, halves, turned, lambda now: now["left"] * ID_HALF + now["right"])
    return F.concat(F.lit("x"), F.conv(number.cast("string"), 10, 36))
