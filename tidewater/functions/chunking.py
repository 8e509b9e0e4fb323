"""Overlapping chunks of a text that end at paragraphs, lines, sentences or words."""

from __future__ import annotations

from pyspark.sql import Column

from tidewater.functions.models import text_model

# fixed values: where a chunk may end, best first
BREAKS = ("\n\n", "\n", ". ", " ")
_BLANKS = " \t\n\v\f\r"


def _end(text: str, start: int, size: int) -> int:
    """The end of the chunk that begins at start: after the last of the best breaks within size characters, else after size."""
    if start + size >= len(text):
        return len(text)
    for mark in BREAKS:
        # a break may stand behind the window by one character, but not at its start
        at = text.rfind(mark, start + 1, start + size + 1)
        if at > 0:
            return at + len(mark)
    return start + size


def _chunks(text: str | None, size: int, overlap: int) -> list[str]:
    text = (text or "").strip(_BLANKS)
    found, start, end = [], 0, 0
    while end < len(text):
        end = _end(text, start, size)
        piece = text[start:end].strip(_BLANKS)
        if piece:
            found.append(piece)
        start = end - overlap if end - overlap > start else end
    return found


def chunks_at_breaks(text: Column, size: int = 2048, overlap: int = 200) -> Column:
    """Chunks of a text's characters, each beginning overlap characters before the end of the last one.

    Where that would not get on, the next chunk begins at the end. The last chunk ends with the text. Chunks are trimmed,
    and blank ones left out; a null or blank text has none. Cut in Arrow batches, as built-in substrings of a long text are
    counted from its start for each chunk.
    """
    return text_model(lambda batch: batch.map(lambda t: _chunks(t, size, overlap)), "array<string>")(text)
