"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of these characters; everything else separates.
WORD_PATTERN = "[a-z0-9']+"

# Bytes that are in no word read as blanks; those of characters beyond ASCII are among them.
_WORD_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789'" else 0x20 for b in range(256))

# The white-space characters of Python's str.strip().
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set for use inside a Java regular expression.
WHITESPACE_CLASS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def strip(text: Column) -> Column:
    """Cut white space, Unicode included, from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def unify_newlines(text: Column) -> Column:
    """Turn ``\\r\\n`` and lone ``\\r`` into ``\\n``."""
    return F.regexp_replace(text, "\\r\\n?", "\n")


def drop_invalid_utf8(text: Column) -> Column:
    """Drop bytes that are not UTF-8; valid text, the normal case, is not rewritten."""
    repaired = F.regexp_replace(F.make_valid_utf8(text), "\ufffd", "")
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def tokenize(text: Column, lowercase: bool = True) -> Column:
    """Words of ``text`` as ``array<string>``.

    Without ``lowercase`` capitals separate words, because they are not in the
    word pattern.
    """
    source = F.lower(text) if lowercase else text
    return F.regexp_extract_all(source, F.lit(WORD_PATTERN), F.lit(0))


def split_words(text: bytes) -> list[bytes]:
    """The words of ``tokenize`` in a text that is in lower case already, for use inside tasks."""
    return text.translate(_WORD_BYTES).split()


def chunk_starts(n_chars: Column, chunk_size: int = 1000, overlap: int = 100) -> Column:
    """0-based start offsets of the overlapping chunks of a text of ``n_chars``.

    A short text has the one start 0. Otherwise starts go on in steps of
    ``chunk_size - overlap`` as long as the rest is not shorter than the overlap.
    """
    if not 0 <= overlap < chunk_size:
        raise ValueError("overlap must be at least 0 and smaller than chunk_size")
    step = chunk_size - overlap
    # Last start s = k*step with s <= n - overlap and s < n.
    last = F.greatest(F.lit(0), F.least(n_chars - overlap, n_chars - 1))
    return F.when(n_chars <= chunk_size, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), last.cast("int"), F.lit(step))
    )
