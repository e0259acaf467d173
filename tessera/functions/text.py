"""Column -> Column text functions.

All of them are built-in Spark SQL expressions, so they stay inside whole-stage codegen
(except the higher-order ``transform``/``filter`` used for the paragraph and sentence
lists, which are still JVM-side).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace removed by Python's str.strip(), derived by rule: every code point for which
# str.isspace() holds (29 of them: TAB..CR, U+001C-U+001F, SPACE, NEL, NBSP and the other
# Unicode space separators; not U+200B or U+FEFF).
STRIP_CHARS = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())
STRIP_CLASS = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in STRIP_CHARS) + "]"
# The same as ranges, which Java's regex engine tests faster, without the ASCII space; and a run that
# isn't a single ASCII space already (between words most are: nothing to match or copy there).
_OTHER_SPACES = r"\t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RUN = f"[{_OTHER_SPACES}][ {_OTHER_SPACES}]*+| [ {_OTHER_SPACES}]++"
# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Characters kept by the cleaning step: CJK U+4E00-U+9FA5, ASCII letters and
# digits, the space, and the punctuation ，。！？；：、"（）【】《》 (ASCII double
# quote kept, apostrophe removed).
CLEAN_KEEP = "一-龥a-zA-Z0-9 ，。！？；：、\"（）【】《》"
# Sentence delimiters of the chunker: 。！？ and the line feed.
SENTENCE_SPLIT = "[。！？\n]"
# Paragraph delimiter of the chunker: a blank line.
PARAGRAPH_SPLIT = "\n\n"
# Prefix of the fuzzy copy: "[副本{i+1}] ".
FUZZY_OPEN, FUZZY_CLOSE = "[副本", "] "
# Token pattern of the search analyzer and the hash embedder (anything that is
# not a letter or digit separates tokens).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# ---------------------------------------------------------------------------

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` on a string column (``btrim`` with the whitespace set:
    no regex)."""
    return F.btrim(_c(c), F.lit(STRIP_CHARS))


def flatten_text(c, replace_cr: bool = False) -> Column:
    """Newline and tab become a space, then strip.  ``replace_cr`` also maps CR
    (used when writing a line-oriented collection, see K1)."""
    src, dst = ("\n\t\r", "   ") if replace_cr else ("\n\t", "  ")
    return py_strip(F.translate(_c(c), src, dst))


def char_length(c) -> Column:
    """Length in code points, as BIGINT."""
    return F.length(_c(c)).cast("bigint")


def length_between(c, min_length: int, max_length: int) -> Column:
    """inclusive on both ends."""
    return F.length(_c(c)).between(min_length, max_length)



def sentence_marks_to_cjk(c) -> Column:
    """Option for Latin corpora: map . ! ? to 。！？ so the chunker sees sentence ends
    (the cleaning step would otherwise delete them)."""
    return F.translate(_c(c), ".!?", "。！？")


def _dropped(keep: str) -> str:
    """``[^keep]+`` with the ASCII part as a class of its own: Java tests a class of many ranges range by
    range for every character, one of ASCII alone by a table."""
    try:
        ascii_part = "".join(f"\\x{{{i:x}}}" for i in range(128) if re.match(f"[^{keep}]", chr(i)))
    except re.error:  # a class in Java's own syntax
        return f"[^{keep}]+"
    rest = f"(?=[^\\x00-\\x7f])[^{keep}]+"
    return f"[{ascii_part}]+|{rest}" if ascii_part else rest


def clean_text(c, keep: str = CLEAN_KEEP) -> Column:
    """Collapse whitespace runs to one space, delete every character outside the
    allow-list, strip."""
    collapsed = F.regexp_replace(_c(c), _RUN, " ")
    kept = F.regexp_replace(collapsed, _dropped(keep), "")
    # after the collapse the only whitespace left is the ASCII space (when the allow-list
    # keeps no other), so Python's strip() is a plain trim here
    return F.trim(kept) if " " in keep and not any(ch.isspace() and ch != " " for ch in keep) else py_strip(kept)


def _nonblank_pieces(arr: Column, spaces_only: bool = False) -> Column:
    strip = F.trim if spaces_only else py_strip
    return F.filter(F.transform(arr, lambda x: strip(x)), lambda x: x != F.lit(""))


def split_paragraphs(c, spaces_only: bool = False) -> Column:
    """P5: split on a blank line, strip, drop empty pieces -> array<string>.
    ``spaces_only``: the text holds no whitespace but ASCII spaces (cleaned), so strip = trim."""
    return _nonblank_pieces(F.split(_c(c), PARAGRAPH_SPLIT), spaces_only)


def split_sentences(c, spaces_only: bool = False) -> Column:
    """Split on 。！？ or a newline (delimiter dropped), strip, drop empty."""
    return _nonblank_pieces(F.split(_c(c), SENTENCE_SPLIT), spaces_only)


def preview(c, n: int = 80) -> Column:
    """First ``n`` characters plus "..." when longer."""
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def wrap_instruction(c, template: str | None) -> Column:
    """Put the text into ``{text}`` of the template; empty template = unchanged.
    The template is split once on the driver, so ``$`` or ``\\`` in a text is never
    interpreted."""
    if not template:
        return _c(c)
    if "{text}" not in template:
        return F.concat(F.lit(template), _c(c))
    head, tail = template.split("{text}", 1)
    return F.concat(F.lit(head), _c(c), F.lit(tail.replace("{text}", "")))


def fuzzy_prefix(c, repeat_id) -> Column:
    """P10: ``[副本{repeat_id+1}] `` in front of the text."""
    return F.concat(F.lit(FUZZY_OPEN), (_c(repeat_id) + 1).cast("string"), F.lit(FUZZY_CLOSE), _c(c))


def tokens(c) -> Column:
    """Lower-cased letter/digit runs, empty pieces removed -> array<string>."""
    return F.filter(F.split(F.lower(_c(c)), TOKEN_SPLIT), lambda x: x != F.lit(""))


def token_count(c, mode: str = "chars") -> Column:
    """The reference's last fallback counts characters; ``words`` counts letter/digit
    runs.  A caller tokenizer goes through :func:`tessera.operators.tokens.count_tokens_with`."""
    if mode == "chars":
        return F.length(_c(c)).cast("bigint")
    if mode == "words":
        return F.size(tokens(c)).cast("bigint")
    raise ValueError(f"unknown token mode {mode!r}")


def id_too_long(c, max_bytes: int = 64) -> Column:
    """Ids are stored in at most 64 UTF-8 bytes; flag (never truncate) longer ones."""
    return F.octet_length(_c(c)) > max_bytes
