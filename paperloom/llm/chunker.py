"""Splitting oversized items at natural boundaries, content-defined.

Words are longest runs of letters, digits and underscores of any script. A rolling hash over
the words (polynomial, over a window of ``WINDOW`` words) marks landmarks wherever its low bits
vanish; each landmark inside the permitted span snaps to the nearest natural boundary, a
paragraph end before a sentence end before a plain word. So whether a place is cut depends on
the words around it, and an edit alters only the neighbouring pieces. A piece has at most
``size`` words, of which the first ``overlap`` repeat the last ones of the piece before.

A text of at most ``size`` words is one piece (the text as it is). Null, empty and blank texts
have no piece. ``size`` below 1 is an error; an overlap that would leave no room for new words
is reduced to ``size - 1``. Cuts inside a text without any boundary fall between words; a
single word is never split. Pieces are substrings of the text: [start, end) in code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import shuffle_width

WINDOW = 8
_BASE, _MASK = 1_000_003, (1 << 64) - 1
_WORD = re.compile(r"\w+")
_PARAGRAPH = re.compile(r"\n\s*\n|\n")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?=\s)|[。！？]")


@lru_cache(1 << 16)
def _word_value(word: str) -> int:
    h = 1469598103934665603
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 1099511628211) & _MASK
    return h


def boundaries(text: str, starts: list[int], ends: list[int]) -> list[int]:
    """For each gap after word i: 2 a paragraph end, 1 a sentence end, else 0."""
    grades = [0] * len(ends)
    for i in range(len(ends) - 1):
        gap = text[ends[i] : starts[i + 1]]
        if "\n" in gap:
            grades[i] = 2
        elif _SENTENCE.search(gap):
            grades[i] = 1
    return grades


def cut_words(values: list[int], grades: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """[first word, last word + 1) of each piece."""
    n = len(values)
    overlap = max(0, min(overlap, size - 1))
    # The mask makes landmarks about as far apart as half of the new words of a piece.
    fresh = size - overlap
    bits = max(1, (max(2, fresh) // 4).bit_length())
    mask = (1 << bits) - 1
    top = pow(_BASE, WINDOW, 1 << 64)
    marks, h = [], 0
    for i, v in enumerate(values):
        h = (h * _BASE + v) & _MASK
        if i >= WINDOW:
            h = (h - values[i - WINDOW] * top) & _MASK
        # the high half is mixed down, as low bits of a polynomial see only low bits
        marks.append(((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 & _MASK) >> 40 & mask == 0)
    pieces, first, new = [], 0, 0
    while True:
        if n - first <= size:
            pieces.append((first, n))
            return pieces
        most = first + size
        # Long enough for the next piece to repeat the whole overlap and still go on.
        least = max(new + max(1, (most - new) // 2), first + overlap + 1)
        best = None
        for wanted in (2, 1, 0):
            at = [e for e in range(least, most + 1) if grades[e - 1] == wanted]
            if not at:
                continue
            landmarks = [e for e in range(least, most + 1) if marks[e - 1]]
            if landmarks:
                target = landmarks[-1]
                best = min(at, key=lambda e: (abs(e - target), -e))
            else:
                best = at[-1]
            break
        end = best if best is not None else most
        pieces.append((first, end))
        new = end
        first = end - overlap


def split_text(text: str | None, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, words) of each piece of ``text``, in code points."""
    if size < 1:
        raise ValueError("a size of at least one word is needed")
    if text is None or not text.strip():
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) <= size:
        return [(0, len(text), len(spans))]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    grades = boundaries(text, starts, ends)
    values = [_word_value(text[a:b]) for a, b in spans]
    out = []
    for k, (a, b) in enumerate(cut_words(values, grades, size, overlap)):
        start = 0 if a == 0 else starts[a]
        end = len(text) if b == len(spans) else starts[b]
        out.append((start, end, b - a))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"piece": [], "start_pos": [], "end_pos": [], "piece_words": [], "piece_text": []}
        take = []
        for i, (text, size, overlap) in enumerate(zip(batch["text"].to_pylist(), batch["size"].to_pylist(), batch["overlap"].to_pylist())):
            for k, (a, b, w) in enumerate(split_text(text, size, overlap)):
                take.append(i)
                for name, v in (("piece", k), ("start_pos", a), ("end_pos", b), ("piece_words", w), ("piece_text", text[a:b])):
                    rows[name].append(v)
        at = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["item_id"].take(at), pa.array(rows["piece"], pa.int32()), pa.array(rows["start_pos"], pa.int32()), pa.array(rows["end_pos"], pa.int32()), pa.array(rows["piece_words"], pa.int32()), pa.array(rows["piece_text"], pa.string())],
            ["item_id", "piece", "start_pos", "end_pos", "piece_words", "piece_text"],
        )


def split_items(items: DataFrame, item_id: str, text: str, profile: str, settings: DataFrame) -> DataFrame:
    """(item_id, piece, start_pos, end_pos, piece_words, piece_text) of each distinct item.

    ``settings(profile, chunk_size_words, chunk_overlap_words)``: profiles are compared without
    case and surrounding space; a null or blank profile is ``default``; an item whose profile
    has no setting is cut by ``default`` (left out where the settings name no default). Exact duplicates of (id, profile, text) count once."""
    clean = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("default"))
    rules = settings.select(clean(settings["profile"]).alias("rule"), settings["chunk_size_words"].alias("size"), settings["chunk_overlap_words"].alias("overlap")).groupBy("rule").agg(F.max("size").alias("size"), F.max_by("overlap", "size").alias("overlap"))
    default = rules.where("rule = 'default'").first()
    own = items.select(items[item_id].alias("item_id"), items[text].alias("text"), clean(items[profile]).alias("rule")).where("text is not null").repartition(shuffle_width(items.sparkSession), "item_id").distinct()
    ruled = own.join(rules, "rule", "left").select(
        "item_id", "text",
        F.coalesce("size", F.lit(default["size"] if default else None)).alias("size"),
        F.coalesce("overlap", F.lit(default["overlap"] if default else None)).alias("overlap"),
    ).where("size is not null")
    return ruled.mapInArrow(_pieces, f"item_id {items.schema[item_id].dataType.simpleString()}, piece int, start_pos int, end_pos int, piece_words int, piece_text string")
