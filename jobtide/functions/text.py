"""Text repair and normalisation as column expressions.

All of it stays in the JVM.  Input columns may hold bytes that are not valid
UTF-8 (read them with ``sources.files.read_raw_lines``); Spark keeps such
bytes in a string column until something decodes them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The Windows-1252 code page differs from ISO-8859-1 only in 0x80..0x9F.
_HIGH = range(0x80, 0xA0)
_DEFINED = [b for b in _HIGH if bytes([b]).decode("cp1252", "ignore")]
_UNDEFINED = [b for b in _HIGH if b not in _DEFINED]
C1_CONTROLS = "".join(map(chr, _DEFINED))
CP1252_CHARS = bytes(_DEFINED).decode("cp1252")

R_BLANKS = " \t\r\n"
REPLACEMENT_CHAR = "�"


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def computed_once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` where ``x`` is evaluated once, however often ``use`` mentions it.

    Spark repeats a column expression in every place it is mentioned; as the
    only element of an array it is a value by the time ``use`` sees it.
    """
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _decode_cp1252(x: Column) -> Column:
    """Bytes of ``x`` read as Windows-1252; undefined bytes become ``<81>`` etc."""
    latin = F.decode(x.cast("binary"), "iso-8859-1")
    spelled = reduce(
        lambda c, b: F.replace(c, F.lit(chr(b)), F.lit(f"<{b:02x}>")), _UNDEFINED, latin
    )
    return F.translate(spelled, C1_CONTROLS, CP1252_CHARS)


def repair_invalid_bytes(x: Column | str) -> Column:
    """Valid UTF-8 is kept; anything else is taken to be Windows-1252."""
    x = as_column(x)
    text = x.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(_decode_cp1252(text))


def trim_blanks(x: Column | str) -> Column:
    return F.btrim(as_column(x), F.lit(R_BLANKS))


def normalize_posting_text(x: Column | str) -> Column:
    """Repair bytes, fold line breaks into one space, trim.  Idempotent; null stays null.

    The pattern is applied only where a line break is, as looking for one costs far less.  The bytes that need
    repair are few, and repaired apart: written out for each of several columns, the repair makes a method that HotSpot would not compile.
    """
    text = as_column(x).cast("string")
    fold = lambda c: F.regexp_replace(c, "[\r\n]+", " ")
    broken = text.contains("\n") | text.contains("\r")
    valid = F.when(broken, fold(text)).otherwise(text)
    return trim_blanks(F.when(F.is_valid_utf8(text), valid).otherwise(computed_once(text, lambda raw: fold(_decode_cp1252(raw)))))


#: One of these is in every text in which white space is more than single spaces (what ``\s`` stands for).
_UNEVEN = ("  ", "\t", "\n", "\x0b", "\f", "\r")


def identity_component(x: Column | str, normalised: bool = False) -> Column:
    """The form in which a field takes part in a posting identity: normalised,
    lower case, every run of white space one space.

    Line breaks are white space like any other here, and the pattern is applied only to
    text with more than single spaces, of which there is little.  ``normalised`` says that the text
    went through ``normalize_posting_text`` already.
    """
    text = as_column(x)
    lower = F.lower(text if normalised else trim_blanks(repair_invalid_bytes(text)))
    uneven = reduce(lambda a, b: a | b, [text.cast("string").contains(blank) for blank in _UNEVEN])
    return F.when(uneven, F.regexp_replace(lower, r"\s{2,}|[^\S ]", " ")).otherwise(lower)


def squish(x: Column | str) -> Column:
    """Trim and reduce every run of white space (any Unicode separator) to one space."""
    return F.trim(F.regexp_replace(as_column(x), r"[\t\n\x0B\f\r\p{Z}]+", " "))


def repair_mojibake(x: Column | str) -> Column:
    """Undo UTF-8-read-as-Windows-1252, but only with proof.

    The candidate is accepted when corrupting it again gives exactly the input;
    properly accented or CJK text fails that test and is left alone.
    """
    x = as_column(x)
    suspicious = x.rlike("[^\\x01-\\x7f]") & ~x.rlike("[\\x{80}-\\x{9f}]")

    def to_bytes(narrowed: Column) -> Column:
        # encode() raises on characters outside the code page: give it only safe text.
        return F.encode(F.when(narrowed.rlike("^[\\x{00}-\\x{ff}]*$"), narrowed), "iso-8859-1")

    def proven(raw: Column) -> Column:
        candidate = raw.cast("string")
        corrupted_again = F.translate(F.decode(raw, "iso-8859-1"), C1_CONTROLS, CP1252_CHARS)
        return F.when(F.is_valid_utf8(candidate) & (corrupted_again == x), candidate)

    narrowed = F.translate(x, CP1252_CHARS, C1_CONTROLS)
    repaired = computed_once(computed_once(narrowed, to_bytes), proven)
    return F.coalesce(F.when(suspicious, repaired), x)


def repair_title(x: Column | str) -> Column:
    """Byte repair without trimming, then the mojibake reversal."""
    return repair_mojibake(repair_invalid_bytes(x))


def repair_column(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(repaired frame, report of the rows that changed)."""
    if column not in df.columns:
        raise ValueError(f"repair_column: no column {column!r}")
    both = df.withColumn("_repaired", repair_title(column))
    report = both.filter(F.col(column) != F.col("_repaired")).select(
        *[c for c in df.columns if c != column],
        F.col(column).alias("original"),
        F.col("_repaired").alias("repaired"),
    )
    return both.withColumn(column, F.col("_repaired")).drop("_repaired"), report


def has_encoding_fault(x: Column | str) -> Column:
    """Invalid UTF-8, or a replacement character left by an earlier lossy read."""
    text = as_column(x)
    return ~F.is_valid_utf8(text) | text.contains(REPLACEMENT_CHAR)


def match_key(x: Column | str) -> Column:
    """Lower case, trimmed, every non-alphanumeric run as one space.

    Trimming comes first, so "Math T." keeps a final space and is not "Math T".
    """
    return F.regexp_replace(F.lower(trim_blanks(as_column(x).cast("string"))), r"(?U)[^\p{Alnum}]+", " ")


def strip_suffix(x: Column | str, suffix: str) -> Column:
    """Drop one literal suffix such as a state name after the comma."""
    return F.regexp_replace(as_column(x), "\\Q" + suffix + "\\E$", "")


def or_text_na(x: Column) -> Column:
    """A missing part of a pasted key is written out as NA, never skipped."""
    return F.coalesce(x, F.lit("NA"))
