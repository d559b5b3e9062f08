"""Problem 2: splitting oversized texts at natural boundaries, with overlap.

Method: lexical-cohesion segmentation. The similarity of the blocks of text on both sides of every possible cut is
taken while a window slides over the text; valleys mark topic boundaries. Within each size window (from a third of the
room to all of it) the end of a paragraph, line or sentence with the deepest valley is the cut; where there is none, the last
end of a word. Each further piece then begins with the
last ``overlap`` characters of the body before it, and pieces with their overlap stay within the limit.

Defined results: texts within the limit, null and empty texts give no pieces. A null or non-positive limit switches
the kind off; an overlap that leaves less than half of the limit for new text is reduced to half. Where there is no
natural boundary the cut falls at the limit. Of equal valleys the end of a paragraph goes first, then the later cut. Repeated rows give repeated pieces. Columns
other than the id and the text are ignored. Lengths are Unicode characters.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import map_rows
from corvane.session import spread

LEVELS = ("paragraph", "sentence", "word", "none")
_BLANK = re.compile(r"(?:\r\n|\n|\r)[ \t]*(?=(?:\r\n|\n|\r))")
_SENTENCE = re.compile(r"\r\n|[\n\r]|(?<=[。！？])|(?<=[.!?])(?=\s)")
_WORD = re.compile(r"\s")
_UNIT = re.compile(r"\w+")
_CJK = re.compile(r"[぀-ヿ一-鿿]")


def cut_points(text: str) -> tuple[list[int], list[int], list[int]]:
    """Places where paragraphs, sentences (or lines) and words end, each list without those of the coarser ones."""
    para = [m.end() for m in _BLANK.finditer(text)]
    sent = [m.end() for m in _SENTENCE.finditer(text)]
    word = [m.end() for m in _WORD.finditer(text)]
    return para, sorted(set(sent) - set(para)), sorted(set(word) - set(sent) - set(para))


def longest(text: str, cuts: list[int]) -> int:
    """Length of the longest stretch between cuts, without white space at its ends."""
    most, begin = 0, 0
    for end in [*cuts, len(text)]:
        if end - begin > most:
            most = max(most, len(text[begin:end].strip()))
        begin = end
    return most


def boundary(text: str, limit: int) -> str:
    """The coarsest sort of boundary that suffices to keep every stretch within the limit."""
    para, sent, word = cut_points(text)
    if longest(text, para) <= limit:
        return "paragraph"
    cuts = sorted({*para, *sent})
    if longest(text, cuts) <= limit:
        return "sentence"
    return "word" if longest(text, sorted({*cuts, *word})) <= limit else "none"


def bags(text: str, cuts: list[int]) -> list[Counter]:
    """The words of each stretch; runs of characters without blanks count by pairs."""
    out = []
    for lo, hi in zip([0, *cuts], [*cuts, len(text)], strict=True):
        bag: Counter = Counter()
        for unit in _UNIT.findall(text[lo:hi].lower()):
            if _CJK.search(unit):
                bag.update(map("".join, zip(unit, unit[1:], strict=False)))
            elif len(unit) > 3:
                bag[unit] += 1
        out.append(bag)
    return out


def valleys(stretches: list[Counter], width: int = 4) -> list[float]:
    """Depth of the cohesion valley at each cut between neighbouring stretches.

    Running sums keep it linear in the text: every stretch enters and leaves each block once.
    """
    n = len(stretches)
    if n < 2:
        return []
    left: Counter = Counter()
    right: Counter = Counter()
    for b in stretches[1 : 1 + width]:
        right.update(b)
    left.update(stretches[0])
    sims = []
    for i in range(1, n):
        small, big = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(v * big[k] for k, v in small.items() if k in big)
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        sims.append(dot / norm if norm else 0.0)
        if i == n - 1:
            break
        left.update(stretches[i])
        if i - width >= 0:
            _take(left, stretches[i - width])
        _take(right, stretches[i])
        if i + width < n:
            right.update(stretches[i + width])
    depth = []
    for i, s in enumerate(sims):
        before, after = max(sims[max(0, i - width) : i + 1]), max(sims[i : i + width + 1])
        depth.append(before + after - 2 * s)
    return depth


def _take(bag: Counter, other: Counter) -> None:
    for k, v in other.items():
        if bag[k] > v:
            bag[k] -= v
        else:
            del bag[k]


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces ``(start, body_start, end, boundary)``: the piece is text[start:end], its new part begins at body_start."""
    overlap = max(0, min(overlap, limit // 2))
    para, sent, word = cut_points(text)
    natural = sorted({*para, *sent})
    depth = dict(zip(natural, valleys(bags(text, natural)), strict=True))
    sort = dict.fromkeys(sent, "sentence") | dict.fromkeys(para, "paragraph")
    pieces: list[tuple[int, int, int, str]] = []
    begin, n = 0, len(text)
    at = [0, 0]
    while begin < n:
        start = max(0, begin - overlap) if pieces else begin
        most = start + limit
        if most >= n:
            pieces.append((start, begin, n, "end"))
            break
        least = begin + max(1, (most - begin) // 3)
        end, how = most, "none"
        for level, cuts in enumerate((natural, word)):
            k = at[level] = bisect_left(cuts, least, at[level])
            stop = bisect_right(cuts, most, k)
            if stop > k:
                # The deepest valley; of equal ones the coarser boundary, then the later cut. Words have no valleys.
                end = max(cuts[k:stop], key=lambda c: (depth[c], sort[c] == "paragraph", c)) if level == 0 else cuts[stop - 1]
                how = sort.get(end, "word")
                break
        pieces.append((start, begin, end, how))
        begin = end
    return pieces


def oversized(df: DataFrame, id_col: str, kind: str, limits: DataFrame, text_col: Column | str = "text") -> DataFrame:
    """(kind, rec_id, body, max_chars, overlap_chars) of the texts above the limit of their kind.

    ``limits`` is a fixed table with one row for each kind; its row becomes constants of the plan.
    """
    rows = limits.where(F.col("kind") == kind).select("max_chars", "overlap_chars").head(1)
    most, overlap = rows[0] if rows and (rows[0][0] or 0) > 0 else (2**31 - 1, 0)
    out = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).alias("body")).where(F.length("body") > most)
    return out.select(F.lit(kind).alias("kind"), "rec_id", "body", F.lit(most).alias("max_chars"), F.lit(overlap or 0).alias("overlap_chars"))


def pieces(texts: DataFrame) -> DataFrame:
    """The operator: ``(kind, rec_id, boundary, piece_ix, body_start, cut, piece)`` for the rows of :func:`oversized`.

    ``boundary`` describes the text, ``cut`` the end of the piece. A huge text is worked on in one pass of linear cost.
    """

    def run(rows: Iterable[dict]) -> Iterator[tuple]:
        for r in rows:
            text, limit = r["body"], r["max_chars"]
            sort = boundary(text, limit)
            for k, (lo, body, hi, how) in enumerate(split(text, limit, r["overlap_chars"])):
                yield r["kind"], r["rec_id"], sort, k, body, how, text[lo:hi]

    return map_rows(spread(texts), run, "kind string, rec_id long, boundary string, piece_ix int, body_start int, cut string, piece string")


def all_pieces(chunks: DataFrame, blocks: DataFrame, limits: DataFrame) -> DataFrame:
    return pieces(oversized(chunks, "chunk_id", "chunk", limits).unionByName(oversized(blocks, "block_id", "block", limits)))


def found(chunks: DataFrame, blocks: DataFrame, limits: DataFrame) -> DataFrame:
    """p2_found: the boundary of every oversized text, from the first of its pieces."""
    return all_pieces(chunks, blocks, limits).where("piece_ix = 0").select("kind", "rec_id", "boundary").distinct()
