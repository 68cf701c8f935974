"""Text functions as column expressions: tokens, cleaning, windows, preservation keys.

All of them stay inside the JVM. A null text gives null, an empty one an empty result, unless said
otherwise. `x` lambdas are named so that they can't clash with columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Python's str.split sees it: Unicode spaces and the four separators.
WHITE = r"(?U)[\s\x{1c}-\x{1f}]+"
# Bullets of private use and kin, and characters that count as a space.
BULLETS = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}\x{AD}\x{FFFD}"
SPACES = r"\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{200B}\x{FEFF}"
REMOVED = rf"[\p{{C}}&&[^\n\t{BULLETS}{SPACES}]]"
REQUIREMENT_ID = "[A-Z]{2,4}-[0-9]{3,4}"
TOKEN = "[0-9A-Za-z가-힣]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Lower-case runs of ASCII letters, digits and Hangul, in order."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(TOKEN), F.lit(0)), lambda x: F.lower(x))


def squeeze(text) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), WHITE, " "))


def windows(text, size: int = 800, overlap: int = 120, squeezed: bool = False) -> Column:
    """array<struct<part,start,text>>: windows of `size` characters of the squeezed text; each begins
    `overlap` before the end of the last one. An empty text has none. Squeezing is repeated per window
    unless the text is a column that is `squeezed` already."""
    step = max(size - overlap, 1)
    s = _col(text) if squeezed else squeeze(text)
    n = F.length(s)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    many = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(many, lambda i: F.struct(i.alias("part"), ((i - 1) * step).alias("start"), F.substring(s, (i - 1) * step + 1, F.lit(size)).alias("text")))


def normalize_characters(text) -> Column:
    """struct<text,n_bullets,n_removed,n_spaces>: bullets of private use become "- " at a line's start
    and a space elsewhere, space-like characters a space; other control and format characters go."""
    t = _col(text)
    blank = rf"(?:[{SPACES}\x{{20}}\x{{1680}}\x{{2028}}\x{{2029}}]|{REMOVED})*"
    out = F.regexp_replace(t, rf"(?md)^({blank})[{BULLETS}]", "$1- ")
    out = F.regexp_replace(F.regexp_replace(out, f"[{BULLETS}]", " "), f"[{SPACES}]", " ")
    out = F.regexp_replace(out, REMOVED, "")
    n = lambda p: F.regexp_count(t, F.lit(p))
    return F.when(t.isNotNull(), F.struct(out.alias("text"), n(f"[{BULLETS}]").alias("n_bullets"), n(REMOVED).alias("n_removed"), n(f"[{SPACES}]").alias("n_spaces")))


def drop_repeated_lines(text, min_length: int = 8) -> Column:
    """struct<text,n_lines,n_digits>: without lines that equal the line before them, if their squeezed
    length is at least min_length; and the lines and ASCII digits dropped."""
    t = _col(text)
    lines = F.split(t, "\n", -1)
    again = lambda x, i: (i > 0) & (x == F.get(lines, i - 1)) & (F.length(squeeze(x)) >= min_length)
    kept = F.filter(lines, lambda x, i: ~F.coalesce(again(x, i), F.lit(False)))
    gone = F.filter(lines, lambda x, i: F.coalesce(again(x, i), F.lit(False)))
    digits = F.length(F.regexp_replace(F.array_join(gone, ""), "[^0-9]", ""))
    return F.when(t.isNotNull(), F.struct(F.array_join(kept, "\n").alias("text"), F.size(gone).alias("n_lines"), digits.alias("n_digits")))


def collapse_blank(text, max_blank_lines: int = 1) -> Column:
    """struct<text,n_blank>: runs of spaces and tabs as one space, stripped lines, at most so many blank
    lines in a row, and the number of blank lines dropped."""
    t = _col(text)
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]{2,}", " "), r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", ""))
    # a blank line goes if the max_blank_lines before it are blank too
    excess = lambda x, i: (x == "") & (i >= max_blank_lines) & (F.array_join(F.slice(lines, i - max_blank_lines + 1, max_blank_lines), "") == "")
    if max_blank_lines == 0:
        excess = lambda x, i: x == ""
    kept = F.filter(lines, lambda x, i: ~excess(x, i))
    out = F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")
    return F.when(t.isNotNull(), F.struct(out.alias("text"), (F.size(lines) - F.size(kept)).alias("n_blank")))


def clean(df, text_col: str = "text", out: str = "clean", min_length: int = 8, max_blank_lines: int = 1):
    """df with the struct column `out`: characters, then repeated lines, then white space, and all counters.

    The steps are columns of their own, so that none is evaluated twice.
    """
    a = df.withColumn("__a", normalize_characters(text_col))
    b = a.withColumn("__b", drop_repeated_lines(F.col("__a.text"), min_length))
    c = b.withColumn("__c", collapse_blank(F.col("__b.text"), max_blank_lines))
    all_of = F.struct(F.col("__c.text").alias("text"), "__a.n_bullets", "__a.n_removed", "__a.n_spaces", "__b.n_lines", "__b.n_digits", "__c.n_blank")
    return c.withColumn(out, F.when(F.col(text_col).isNotNull(), all_of)).drop("__a", "__b", "__c")


def requirement_ids(text, pattern: str = REQUIREMENT_ID) -> Column:
    """The distinct requirement numbers, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))))


def digit_count(text) -> Column:
    """ASCII digits in a text."""
    return F.length(F.regexp_replace(_col(text), "[^0-9]", ""))


def preservation(original, cleaned, values, duplicate_digits) -> Column:
    """What cleaning lost: struct<lost_ids,lost_values,checked_values,digit_loss,preserved>. Values that
    the original doesn't hold are not checked; digits in dropped duplicates are no loss."""
    o, c, v = _col(original), _col(cleaned), _col(values)
    so, sc = squeeze(o), squeeze(c)
    checked = F.filter(F.coalesce(v, F.array().cast("array<string>")), lambda x: F.contains(so, squeeze(x)))
    lost = F.filter(checked, lambda x: ~F.contains(sc, squeeze(x)))
    ids = F.array_except(requirement_ids(o), requirement_ids(c))
    loss = digit_count(o) - digit_count(c) - _col(duplicate_digits)
    return F.struct(ids.alias("lost_ids"), lost.alias("lost_values"), F.size(checked).alias("checked_values"), loss.alias("digit_loss"), ((F.size(ids) == 0) & (F.size(lost) == 0) & (loss == 0)).alias("preserved"))


def amount_forms(value) -> Column:
    """A sum of money as it may stand in a text: as stored, its digits, and with thousands separators."""
    digits = F.regexp_replace(_col(value), "[^0-9]", "")
    forms = F.array(_col(value), digits, F.format_number(digits.try_cast("double"), 0))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def split_lines(text) -> Column:
    """Lines without their ends: \\n, \\r\\n or \\r; a closing line end opens no further line."""
    return F.split(F.regexp_replace(_col(text), r"(?:\r\n|\n|\r)\z", ""), r"\r\n|\n|\r", -1)
