"""Column functions over texts: bytes, positions, words, spans, hashes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of words: ASCII letters, digits and underscore, and all bytes of other characters.
WORD_CLASS = r"[A-Za-z0-9_]|[^\x00-\x7F]"


def byte_slice(text: Column, start: Column, length: Column) -> Column:
    """Text of a byte range that begins and ends between characters."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, length), "UTF-8")


def inside_character(text: Column, at: Column) -> Column:
    """Whether a byte offset lies inside a character: the byte there goes on with one. False at and beyond the ends."""
    byte = F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), at + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce((at >= 0) & byte.between(128, 191), F.lit(False))


def checked_slice(text: Column, start: Column, length: Column) -> Column:
    """byte_slice that is an error if the range lies outside the text or begins or ends inside a character."""
    bad = (start < 0) | (length < 0) | (start + length > F.octet_length(text))
    split = inside_character(text, start) | inside_character(text, start + length)
    return F.when(bad, F.raise_error(F.lit("the range is outside the text")).cast("string")).when(split, F.raise_error(F.lit("the range splits a character")).cast("string")).otherwise(byte_slice(text, start, length))


def chunks(text: Column, size: int) -> Column:
    """The text in parts of `size` characters; the empty text is one empty part."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / size).cast("int")), lambda k: F.substring(text, k * size + 1, F.lit(size)))


def whole_word(text: Column, word: str) -> Column:
    """Whether the word stands in the text with no word byte on either side."""
    return text.rlike(f"(?<!{WORD_CLASS}){re.escape(word)}(?!{WORD_CLASS})")


#: Bytes of text whose line breaks are sought at once, so that what that takes does not grow with a batch.
SLICE_BYTES = 1 << 20


def line_starts(text: Column) -> Column:
    """Byte offsets at which lines begin, in one pass over the bytes of a batch; no text becomes an object of Python."""
    def some(texts: pa.Array, offsets: np.ndarray) -> pa.Array:
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        breaks = np.flatnonzero(data == 10) + offsets[0]
        row = np.searchsorted(offsets, breaks, side="right") - 1
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)) + 1)))
        out = np.zeros(ends[-1], np.int32)
        later = np.ones(ends[-1], bool)
        later[ends[:-1]] = False
        out[later] = breaks + 1 - offsets[row]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=texts.is_null() if texts.null_count else None)

    def run(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        cuts = np.searchsorted(offsets, np.arange(offsets[0] + SLICE_BYTES, offsets[-1], SLICE_BYTES))
        cuts = np.unique(np.concatenate(([0], cuts, [len(texts)])))
        return pa.concat_arrays([some(texts.slice(a, b - a), offsets[a : b + 1]) for a, b in zip(cuts[:-1], cuts[1:])])

    return F.arrow_udf(run, "array<int>")(text)


def line_of(text: Column, offset: Column) -> Column:
    """0-based line of a byte offset."""
    head = byte_slice(text, F.lit(0), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n")))


def column_of(text: Column, offset: Column) -> Column:
    """0-based column of a byte offset, in characters."""
    head = byte_slice(text, F.lit(0), offset)
    return F.length(F.substring_index(head, "\n", -1))


def content_id(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def match_id(path: Column, start: Column, end: Column, text: Column) -> Column:
    """12 hex digits that name a located match."""
    return F.substring(F.sha2(F.concat_ws("|", path, start.cast("string"), end.cast("string"), text), 256), 1, 12)


def line_count(text: Column) -> Column:
    """Lines that a match spans."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1


def is_metavariable(word: Column) -> Column:
    return word.rlike(r"^[$]{1,3}[A-Z_][A-Z0-9_]*$")


def pattern_words(pattern: str) -> list[str]:
    """Literal words of a pattern that every match must contain: maximal runs of letters, digits and _, not after $."""
    found = re.finditer(r"\w+", pattern)
    return sorted({m[0] for m in found if pattern[m.start() - 1 : m.start()] != "$"})


def cursor(nonce: Column, query: Column, kind: Column, digest: Column) -> Column:
    return F.concat_ws(".", F.lit("v1"), nonce, query, kind, digest)


def relative_time(seconds: Column) -> Column:
    """Age in words, from seconds."""
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" d ago")))
    )


# Spans are half-open byte ranges; overlap excludes touching, containing includes equality.


def span_length(start: Column, end: Column) -> Column:
    return end - start


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a < d) & (c < b)


def contains(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a <= c) & (d <= b)


def span_union(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    return F.least(a, c), F.greatest(b, d)


def span_violation(start: Column, end: Column, n_bytes: Column) -> Column:
    """Why a span is not one of a text of n_bytes; null if it is."""
    return F.when(start > end, "unordered").when(start < 0, "negative").when(end > n_bytes, "out of bounds")
