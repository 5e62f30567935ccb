"""Text expressions. Lengths are code points; whitespace is the full Unicode set."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chunkloom.constants import CHUNK_OVERLAP, CHUNK_SIZE, SNIPPET_CHARS

# All 29 Unicode blanks. The first class lets printable ASCII fail at once; (?U) widens \s.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WS = r"(?U)[[^!-~]&&[\s\x1c-\x1f]]"
LINE_WS = r"(?U)[[^!-~\n]&&[\s\x1c-\x1f]]"
THINK = r"(?is)<think\b[^>]*>.*?(?:</think>|\z)"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where it is used in several branches."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def left(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def normalize_document_text(text: Column) -> Column:
    """Unix newlines, no trailing blanks on lines, one blank line at most, stripped."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    t = F.replace(t, F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, rf"{LINE_WS}++(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def check_chunking(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")


def window_count(length: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Number of character windows over a text of ``length`` characters."""
    check_chunking(size, overlap)
    step = size - overlap
    extra = F.ceil((length - F.lit(size)) / F.lit(float(step))).cast("long")
    return F.when(length <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), extra) + 1).cast("long")


def fixed_pieces(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters, found in one pass over the text."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % (size if size > 0 else 20)), F.lit(0))


def chunk_array(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows of an already normalised text, stripped, blanks dropped, in order.

    The text is cut once into steps; a window is its step plus the beginning of the next
    one. Only an overlap longer than the step has to seek in the text.
    """
    check_chunking(size, overlap)
    step = size - overlap
    count = window_count(F.char_length(text), size, overlap).cast("int")
    if overlap <= step:
        steps = fixed_pieces(text, step)
        ahead = F.transform(F.slice(F.concat(steps, F.array(F.lit(""))), 2, 1 << 30), lambda s: left(s, overlap))
        windows = F.zip_with(steps, ahead, lambda s, a: strip(F.concat(s, a)))
        windows = F.slice(windows, F.lit(1), count)
    else:
        starts = F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)
        windows = F.transform(starts, lambda i: strip(F.substring(text, i * step + 1, F.lit(size))))
    return F.filter(windows, lambda piece: piece != "")


def estimate_tokens(text: Column) -> Column:
    """Word count when there are several words, otherwise character count."""
    body = strip(F.coalesce(text, F.lit("")))
    words = F.size(F.split(body, rf"{WS}+"))
    count = let(words, lambda n: F.when(n > 1, n).otherwise(F.char_length(body)))
    return F.when(body == "", F.lit(0)).otherwise(count)


def collapse_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{WS}+", " "))


def prefixed(prefix: str, text: Column) -> Column:
    """One-line text behind a model prefix whose backslash escapes are expanded."""
    real = prefix.replace("\\n", "\n").replace("\\r", "\r").replace("\\t", "\t")
    body = collapse_whitespace(text)
    return F.concat(F.lit(real), body) if real else body


def build_snippet(text: Column, limit: int = SNIPPET_CHARS) -> Column:
    flat = F.translate(strip(F.coalesce(text, F.lit(""))), "\n", " ")
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(left(flat, limit), F.lit("...")))


def truncate_hit(text: Column, limit: int) -> Column:
    """Cut of the context assembly."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(left(text, limit), F.lit(" ...")))


def truncate_prompt(text: Column, limit: int) -> Column:
    """Second cut, only in the single-turn prompt."""
    body = F.coalesce(text, F.lit(""))
    cut = F.concat(rstrip(left(body, limit)), F.lit("\n...[truncated]"))
    return F.when(F.char_length(body) <= limit, body).otherwise(cut)


def strip_think_tags(text: Column) -> Column:
    return strip(F.regexp_replace(text, THINK, ""))
