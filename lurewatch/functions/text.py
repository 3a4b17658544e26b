"""Text normalisation, redaction and untrusted-text handling as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lurewatch import lexicon as L
from lurewatch.functions.bind import let

_SP = L.SPACE



def _nfkc_udf():
    """Built per call so that it ships by value: workers need no copy of this package."""

    @F.arrow_udf(StringType())
    def compose(text: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        return pc.utf8_normalize(text, form="NFKC")

    return compose


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition.

    Spark has no built-in for it.  Only rows holding a non-ASCII character are
    handed to the Arrow function; the rest cross the boundary as nulls.
    """
    needs = text.rlike(r"[^\x00-\x7f]")
    return F.coalesce(_nfkc_udf()(F.when(needs, text)), text)


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, f"[{L.INVISIBLE}]", "")


def fold_lookalikes(text: Column) -> Column:
    """``translate`` looks up every letter, so it only sees texts that hold a look-alike, none of which is ASCII."""
    return let(text, lambda t: F.when(t.rlike(f"[{L.HOMOGLYPHS_FROM}]"), F.translate(t, L.HOMOGLYPHS_FROM, L.HOMOGLYPHS_TO)).otherwise(t))


def collapse_space(text: Column) -> Column:
    """Blank runs to one space, three or more line feeds to two, every line trimmed."""
    out = F.regexp_replace(text, f"[{L.BLANK_RUN}]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, f"[{_SP}&&[^\\n]]*+\\n[{_SP}&&[^\\n]]*+", "\n")
    return strip_space(out)


def strip_space(text: Column) -> Column:
    """Python-style ``strip``: Unicode white space off both ends."""
    return F.btrim(text, F.lit(L.SPACE_CHARS))


def normalize(text: Column, max_chars: int | None = L.LIMITS["text_chars"], fold_unicode: bool = True) -> Column:
    """The full clean-up; ``max_chars`` is the intake limit, None lifts it."""
    out = F.coalesce(text, F.lit(""))
    if fold_unicode:
        out = nfkc(out)
    out = collapse_space(fold_lookalikes(strip_invisible(out)))
    return out if max_chars is None else F.left(out, F.lit(max_chars))


def language_or_default(lang: Column, text: Column) -> Column:
    blank = strip_space(F.coalesce(text, F.lit(""))) == ""
    return F.when(blank, F.lit("en")).otherwise(F.coalesce(F.nullif(F.trim(lang), F.lit("")), F.lit("en")))


def repair_transcribed_urls(text: Column) -> Column:
    """Line by line: ``httpsIl`` becomes ``https://`` and blanks after it become dots."""
    edge = f"(?<![{L.WORD}])"
    gap = f"[{_SP}&&[^\\n]]*"

    def fix(line: Column) -> Column:
        line = F.regexp_replace(line, f"(?iu){edge}https{gap}[Il|]{{1,2}}{gap}", "https://")
        line = F.regexp_replace(line, f"(?iu){edge}http{gap}[Il|]{{1,2}}{gap}", "http://")
        cut = F.locate("://", line)
        return F.when(
            cut > 0,
            F.concat(line.substr(F.lit(1), cut + 2), F.replace(line.substr(cut + 3, F.length(line)), F.lit(" "), F.lit("."))),
        ).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n"), fix), "\n")


def pieces_of(text: Column) -> Column:
    """Pieces ending in ``.?!`` or a line break, as they are."""
    return F.split(text, rf"(?<=[.?!])[{_SP}]+|\n+")


def sentences(text: Column) -> Column:
    """Pieces ending in ``.?!`` or a line break, trimmed, blanks dropped."""
    return F.filter(F.transform(pieces_of(text), strip_space), lambda s: s != "")


def redact(text: Column) -> Column:
    """Mask e-mail addresses, then payment handles, then phone-length digit runs."""
    w = L.WORD
    start, end = f"(?<![{w}])", f"(?![{w}])"
    # A mask starts at a word boundary; the run before "@" cannot hold "@", so
    # it is matched possessively (linear on long runs).
    head = rf"(?:(?<![{w}])(?=[{w}])|(?<=[{w}])(?![{w}]))[{w}.+-]++"
    out = F.regexp_replace(text, rf"{head}@[{w}-]+\.[a-zA-Z]{{2,}}{end}", "[redacted-email]")
    out = F.regexp_replace(out, rf"{head}@[a-zA-Z]{{2,}}{end}", "[redacted-upi]")
    return F.regexp_replace(out, rf"{start}\p{{Nd}}{{10,13}}{end}", "[redacted-phone]")


def _override(pattern: str) -> str:
    pattern = pattern.replace("{b}DAN{b}", f"(?<![{L.WORD}])DAN(?![{L.WORD}])")
    return "(?iu)" + L.rx(pattern)


def neutralize(text: Column) -> Column:
    """Replace instruction-override phrases by a marker."""
    for pattern in L.OVERRIDE_PHRASES:
        text = F.regexp_replace(text, _override(pattern), L.OVERRIDE_MARK)
    return text


def has_override(text: Column) -> Column:
    joined = "|".join(L.rx(p.replace("{b}DAN{b}", L.whole("DAN"))) for p in L.OVERRIDE_PHRASES)
    return text.rlike("(?iu)" + joined)


def wrap_untrusted(text: Column) -> Column:
    return F.concat(F.lit(L.UNTRUSTED_BEGIN + "\n"), neutralize(text), F.lit("\n" + L.UNTRUSTED_END))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([_*\[\]()~`>#+\-=|{}.!])", r"\\$1")


def word_count(text: Column) -> Column:
    return let(strip_space(text), lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"[{_SP}]+"))))
