"""Problem 3: repair of text from scanned pages.

Method: the lines of a text, freed of running headers and page numbers, become one character stream with soft line ends,
which is decoded into words: known words are kept, words broken over line ends are merged (with or without a mark, also
over lines that were taken out), run-together words are split, and misread characters are undone where that gives a known
word; the cheapest reading wins, by the frequency of its words. Words that no line end touches are decoded alone, since
blanks are kept. Look-alike characters of scripts without blanks are decided by their neighbours. Paragraph boundaries
are chosen by dynamic programming over the line ends.

The lexicon holds every word and look-alike pair of the whole corpus that is counted ``LEAST_COUNT`` times or more. Only its
most frequent terms, at most ``COMMON``, go to every worker; the others stay a table, of which workers have a filter of fixed
size over the skeletons. A text that the filter lets none of them matter to is read at once. For the few others what they
need (the terms that their uncommon words, the parts these can be made of and their words over line ends can be) is joined to
them, so no term is cut and nothing grows with the vocabulary. A form that is far rarer than the word it turns into is taken as a misreading and not as a
word.

Headers are lines that repeat on pages of the asset, on a twentieth of the pages between the first and the last of them, or
that equal, whole or cut, one of its titles. They are joined to the texts by asset and stretch of pages, so an asset of any size
is spread. A page number counts if it agrees with the page, or if the page is unknown.

Defined results: null and blank texts are left out. Texts without noise give no row in :func:`repair`; its sorts of noise
are hyphen, char, header, pageno, break (a word broken without a mark) and joined (run-together words); the last two are
no rows of :func:`found`. Repeated rows give
repeated rows. A null asset has no titles; a null page accepts any page number. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.arrow import map_rows
from corvane.session import materialize, spread

LEAST_COUNT = 3
#: How much more frequent the right form has to be.
RATIO = 8
#: Terms of the lexicon that every worker holds, at most.
COMMON = 200_000
#: Bits of the filter over the skeletons of the other terms; it may let too much through, never too little.
FILTER_BITS = 1 << 23
#: Pages of an asset that share their header keys, and texts of one such stretch that stay together.
STRETCH, TOGETHER = 64, 4096

#: What Latin letters are misread as (misread, right).
CONFUSIONS = (("rn", "m"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("vv", "w"), ("0", "o"), ("1", "l"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("!", "i"), ("†", "t"), ("c", "e"), ("€", "e"), ("|", "l"), ("$", "s"), ("@", "a"))
#: Characters that look alike (misread, right).
LOOKALIKE = (
    "囹图 裘表 入人 彔录 汜记 旱早 曰日 捡检 问间 杳查 囚因 归旧 囗口 士土 贞页 日目 目日 末未 未末 己已 已己 大太 太大 千干 干千 夭天 天夫 囯国 困因 呆果 甴由 由田 田由 甲申 申甲 牛午 午牛 刀力 力刀 几儿 儿几 乌鸟 鸟乌 候侯 侯候 析折 折析 拆析 徽微 微徽 辨辩 辩辨 代伐 伐代 往住 住往 兔免 免兔 贷货 货贷 土士 人入 末木 木本 本木 白自 自白 间问 旦旧 记汜 早旱 己巳 于干 平乎 乎平 令今 今令 毎每"
    " 氷水 水氷 占古 古占 占点 貝見 見貝 犬大 夕タ 卜ト 力カ 囗口 圖図 囲図 口ロ ロ口 二ニ ニ二 八ハ ハ八 工エ エ工 一ー ー一 ソン ンソ シツ ツシ 未末 呆保 牛年 写与 与写 孝考 者著 検険 険検 録緑 緑録 頁貞 貞頁 真直 直真 図囲 設説 説設 理埋 埋理 索素 素索 画面 弁并 侍待 待侍 棟楝 瀬頼 帳張 張帳 閒間 閲閱 巨臣 臣巨 予矛 矢失 失矢 使便 便使 治冶 冶治 准淮 淮准 圧庄 庄圧 比此 此比"
)
_PAIRS: dict[str, tuple[str, ...]] = {}
for _p in LOOKALIKE.split():
    _PAIRS[_p[0]] = tuple(dict.fromkeys((*_PAIRS.get(_p[0], ()), _p[1])))
_LOOKS = re.compile("[" + "".join(sorted({c for p in LOOKALIKE.split() for c in p})) + "]")
_WRONG = re.compile("[" + "".join(sorted(_PAIRS)) + "]")
_MARK = "-‐‑­¬=‒"
WORD = re.compile(r"[a-zß-öø-ÿœ0-9!†€|$@]*[a-zß-öø-ÿœ][a-zß-öø-ÿœ0-9!†€|$@]*")
#: Signs that are other letters where case is folded.
_FOLDED = re.compile("[ſİı]")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿœ0-9!†€|$@"
#: A line that was taken out of the stream; words may go on over it.
GONE = "\x0b"
_JOIN = rf"([{_MARK}]?)[ \t]*\r?\n((?:[ \t{GONE}]*\r?\n)*+)[ \t]*"
#: Words that meet at line ends: what joint decoding reads as one.
_CHAIN = re.compile(rf"(?<![{_LETTER}])[{_LETTER}]++(?:{_JOIN}[{_LETTER}]++)+")
_JOINS = re.compile(_JOIN)
#: Costs of a reading, in nats beside the rarity of its words: an unknown word and each of its characters, a merge
#: without a mark, a misreading, a split.
UNKNOWN, UNKNOWN_CHAR, MERGE, MISREAD, SPLIT = 8.0, 2.0, 8.0, 4.0, 3.0
#: Pieces that one word is broken into at most; parts a run-together word has at most.
MOST_PIECES, MOST_PARTS = 3, 4
#: A part of a run-together word is at least so frequent.
PART_COUNT = 20
#: Capitalised words are split only after one of the most frequent words: others can be compounds or names.
FREQUENT = 200
_HALVES = re.compile(rf"([{_LETTER}])[{_MARK}][ \t]*\r?\n[ \t]*(?=[a-zß-öø-ÿœ])")
_INNER = re.compile(r"(?<=[a-zß-öø-ÿœ])[0159!†€](?=[a-zß-öø-ÿœ])|^[a-zß-öø-ÿœ]{2,}[09†]$")
_CJK = r"぀-ヿ一-鿿"
_NUMBER = r"(?:\d{1,5}|(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
_PAGE = re.compile(rf"[\s\-–—\[(|·~]*(?:(?:page|seite|p[áa]g(?:ina|\.)?|p\.|s\.|folio|blatt|第)\s*)?({_NUMBER})\s*(?:页|頁|ページ)?(?:\s*(?:/|of|von|de|sur)\s*\d{{1,5}}\s*(?:页|頁|ページ)?)?[\s\-–—\])|·~]*", re.I)
_HEAD_NUMBER = re.compile(rf"^\s*({_NUMBER})\s{{2,}}(?=\S)|(?<=\S)\s{{2,}}({_NUMBER})\s*$", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def page_value(text: str) -> int | None:
    """The number that digits or Roman numerals write."""
    if text.isdigit():
        return int(text)
    total = 0
    digits = [_ROMAN[c] for c in text.lower()]
    for a, b in zip(digits, [*digits[1:], 0], strict=True):
        total += -a if a < b else a
    return total


def line_key(line: str) -> str:
    """A line in the form in which headers are compared."""
    return re.sub(r"[\s\-–—|·~]+", " ", line).strip().lower().replace("ß", "ss")


_SINGLES = str.maketrans({bad: good for bad, good in CONFUSIONS if len(bad) == 1})
_DOUBLES = tuple((bad.translate(_SINGLES), good) for bad, good in CONFUSIONS if len(bad) == 2)


def skeleton(word: str) -> str:
    """Equal for a word and its misreadings: everything that can be confused is made the same."""
    out = word.translate(_SINGLES)
    for bad, good in _DOUBLES:
        out = out.replace(bad, good)
    return out


def explains(bad: str, good: str, most: int = 4) -> bool:
    """Whether ``bad`` can be a misreading of ``good`` in at most ``most`` places."""
    if not bad or not good:
        return not bad and not good
    if bad[0] == good[0] and explains(bad[1:], good[1:], most):
        return True
    return most > 0 and any(bad.startswith(x) and good.startswith(y) and explains(bad[len(x) :], good[len(y) :], most - 1) for x, y in CONFUSIONS)


class Lexicon:
    """Counts of words and of pairs of characters, with cached decisions on unknown words."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        self.counts = counts
        self.decided: dict[str, str | None] = {}
        self.likely: dict[str, list[str]] = {}
        latin = [w for w in counts if w[0] < "぀"]
        for w in latin:
            if w.isalpha():
                self.likely.setdefault(skeleton(w), []).append(w)
        self.words = {w for w in latin if self.right(w) is None}
        self.total = math.log((sum(counts[w] for w in latin) if total is None else total) + 1)
        self.frequent = set(heapq.nlargest(FREQUENT, (w for w in self.words if len(w) > 1 and w.isalpha()), key=lambda w: (counts[w], w)))
        self.splits: dict[str, tuple[float, list[str]] | None] = {}
        self.longest = max(map(len, latin), default=0)
        self.added: list[str] = []

    def add(self, terms: list[tuple[str, int]]) -> None:
        """Take in the rarer terms that a text needs; the decisions on its words rest on all of them."""
        if len(self.added) > COMMON:
            for w in self.added:
                del self.counts[w]
                self.words.discard(w)
                if w.isalpha():
                    self.likely[skeleton(w)].remove(w)
            self.added.clear()
            self.decided.clear()
            self.splits.clear()
        fresh = sorted((w, n) for w, n in terms if w not in self.counts)
        if fresh:
            self.decided.clear()
            self.splits.clear()
        for w, n in fresh:
            self.counts[w] = n
            self.longest = max(self.longest, len(w))
            if w.isalpha():
                self.likely.setdefault(skeleton(w), []).append(w)
        self.added += [w for w, _ in fresh]
        self.words.update(w for w, _ in fresh if self.right(w) is None)

    def right(self, word: str) -> str | None:
        """What a misread word should be, or None if it is fine or unknown."""
        if word in self.decided:
            return self.decided[word]
        if len(self.decided) > 500_000:
            self.decided.clear()
        own = self.counts.get(word, 0)
        best, most = None, max(RATIO * own, LEAST_COUNT) - 1
        for w in self.likely.get(skeleton(word), ()):
            n = self.counts[w]
            if n > most and w != word and explains(word, w):
                best, most = w, n
        if best is None and not own and len(word) >= 4 and sum(map(str.isdigit, word)) <= 2 and _INNER.search(word):
            best = plain(word)
        self.decided[word] = best
        return best

    def cost(self, word: str) -> float:
        """How rare a known word is, in nats."""
        return self.total - math.log(self.counts[word])

    def split(self, word: str) -> tuple[float, list[str]] | None:
        """(cost, parts) of the cheapest reading of an unknown word as run-together known words, misread or not.

        None where keeping the word as it is costs less.
        """
        if word in self.splits:
            return self.splits[word]
        if len(self.splits) > 500_000:
            self.splits.clear()
        best: list[tuple[float, list[str]] | None] = [(0.0, []), *[None] * len(word)]
        for i in range(len(word) - 1 if len(word) >= 5 else 0):
            if best[i] is None or len(best[i][1]) >= MOST_PARTS:
                continue
            # No part is longer than a term with two characters for each of its own.
            for j in range(i + 2, min(len(word), i + 2 * self.longest) + 1):
                part = word[i:j]
                known = part if part in self.words else self.right(part) if j - i >= 3 else None
                if known is None or j - i == len(word) or self.counts.get(known, 0) < PART_COUNT or not known.isalpha() or (j - i < 4 and known not in self.frequent):
                    continue
                cost = best[i][0] + self.cost(known) + (MISREAD if known != part else 0.0) + (SPLIT if i else 0.0)
                if best[j] is None or cost < best[j][0]:
                    best[j] = (cost, [*best[i][1], known])
        whole = best[-1] if best[-1] is not None and best[-1][0] < UNKNOWN + UNKNOWN_CHAR * len(word) else None
        self.splits[word] = whole
        return whole

    def reading(self, raw: str) -> tuple[float, str, set[str]]:
        """(cost, text, sorts of noise) of the cheapest reading of one word: kept, misread or run together."""
        low = raw.lower()
        if low in self.words:
            return self.cost(low), raw, set()
        right = self.right(low)
        if right is not None:
            cost = self.cost(right) if right in self.counts else UNKNOWN + UNKNOWN_CHAR * len(right)
            return cost + MISREAD, right.capitalize() if raw[0].isupper() else right, {"char"}
        split = self.split(low) if raw[1:].islower() or low == raw else None
        if split is not None and (raw[0].islower() or split[1][0] in self.frequent):
            text = " ".join(split[1])
            noise = {"joined"} if "".join(split[1]) == low else {"joined", "char"}
            return split[0], text[0].upper() + text[1:] if raw[0].isupper() else text, noise
        return UNKNOWN + UNKNOWN_CHAR * len(raw), raw, set()

    def pair(self, two: str) -> int:
        return self.counts.get(two, 0)

    def right_char(self, before: str, char: str, after: str) -> str | None:
        """The look-alike that fits between its neighbours far better, if there is one."""
        sides = [(before, "")] * (before > "~") + [("", after)] * (after > "~")
        if not sides:
            return None
        own = [self.pair(a + char + b) for a, b in sides]
        for other in _PAIRS.get(char, ()):
            new = [self.pair(a + other + b) for a, b in sides]
            if min(new) >= max(5, RATIO * min(own)) and sum(new) * 2 >= RATIO * sum(own):
                return other
        return None


def plain(word: str) -> str:
    """Digits and signs inside a word as the letters they stand for."""
    return word.translate(str.maketrans({"0": "o", "1": "l", "9": "g", "!": "i", "†": "t", "5": "s", "€": "e"}))


def find_headers(lines: list[str], keys: list[str], page: int | None) -> tuple[list[str | None], set[str]]:
    """The lines with headers and page numbers set to None, and the sorts of noise among them."""
    noise: set[str] = set()
    out: list[str | None] = []
    for line in lines:
        text = line.strip()
        if text and len(text) <= 40 and (m := _PAGE.fullmatch(text)) and (page is None or page_value(m[1]) == page + 1):
            noise.add("pageno")
            out.append(None)
            continue
        if text and keys:
            number = _HEAD_NUMBER.search(text)
            bare = _HEAD_NUMBER.sub("", text) if number else text
            if _is_header(line_key(bare), keys):
                noise.add("header")
                value = (number[1] or number[2]) if number else None
                if value and (page is None or page_value(value) == page + 1):
                    noise.add("pageno")
                out.append(None)
                continue
        out.append(line)
    return out, noise


def _is_header(key: str, keys: list[str]) -> bool:
    wide = len(re.findall(f"[{_CJK}]", key))
    if len(key) < (6 if wide * 2 > len(key) else 12):
        return False
    for k in keys:
        if k == key or (k.startswith(key) and len(key) * 3 >= len(k)) or (key.startswith(k) and len(key) - len(k) <= 3):
            return True
        if abs(len(k) - len(key)) <= 3 and len(key) > 12 and sum(a != b for a, b in zip(k, key, strict=False)) <= 2:
            return True
    return False


def decode(text: str, lexicon: Lexicon) -> tuple[str, set[str]]:
    """The text with broken words merged, run-together words split and misread characters undone.

    The sorts of noise are hyphen and char, with a word broken without a mark as break and run-together words as joined.
    """
    noise: set[str] = set()
    if "\n" in text:
        text = _CHAIN.sub(lambda m: _chain(m[0], lexicon, noise), text)

    def word(m: re.Match) -> str:
        _, reading, more = lexicon.reading(m[0])
        noise.update(more)
        return reading

    text = re.sub(WORD.pattern, word, text, flags=re.I) if _needs(text.lower(), lexicon) else text
    if _WRONG.search(text):
        chars = list(text)
        changed = False
        for m in _WRONG.finditer(text):
            i, j = m.start() - 1, m.end()
            while i >= 0 and chars[i].isspace():
                i -= 1
            while j < len(chars) and chars[j].isspace():
                j += 1
            other = lexicon.right_char(chars[i] if i >= 0 else "", m[0], chars[j] if j < len(chars) else "")
            if other:
                changed = True
                chars[m.start()] = other
        if changed:
            noise.add("char")
            text = "".join(chars)
    return text, noise


def _chain(text: str, lexicon: Lexicon, noise: set[str]) -> str:
    """The cheapest reading of words that meet at line ends: dynamic programming over the line ends.

    A span of pieces is read as one word (kept, misread or run together) or its pieces stay apart.
    """
    joins = list(_JOINS.finditer(text))
    edges = [0, *(x for m in joins for x in (m.start(), m.end())), len(text)]
    pieces = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    can = [_may_meet(a, m, b) for a, m, b in zip(pieces, joins, pieces[1:], strict=False)]
    # Cheap test first: without a mark only a known word, as it is or misread, can go over a line end.
    if not any(ok and (m[1] or _known(pieces[k] + pieces[k + 1], lexicon) or k + 2 < len(pieces)) for k, (ok, m) in enumerate(zip(can, joins, strict=True))):
        return text
    best: list[tuple[float, str, set[str]]] = [(0.0, "", set())]
    for j in range(1, len(pieces) + 1):
        found = []
        for i in range(j - 1, max(-1, j - 1 - MOST_PIECES), -1):
            if i < j - 1 and not can[i]:
                break
            before, out, sorts = best[i]
            raw = "".join(pieces[i:j])
            marks = [m[1] for m in joins[i : j - 1]]
            if "" in marks and not _known(raw, lexicon):
                continue
            cost, reading, more = lexicon.reading(raw)
            if i < j - 1:
                cost += MERGE * marks.count("")
                more = more | {"break" if x == "" else "hyphen" for x in marks}
            if i:
                m = joins[i - 1]
                if can[i - 1] and m[1]:
                    # A mark stays only in a compound that is counted as one.
                    left, right = pieces[i - 1], pieces[i]
                    if m[1] not in "-=" or f"{left}{right}".lower() in lexicon.words or left.lower() not in lexicon.words or right.lower() not in lexicon.words or lexicon.counts.get(f"{left}-{right}".lower(), 0) < LEAST_COUNT:
                        cost += 1e6
                    out += "-"
                else:
                    out += m[0]
            found.append((before + cost, out + reading, sorts | more))
        best.append(min(found, key=lambda x: x[0]))
    noise |= best[-1][2]
    return best[-1][1]


def meeting(text: str) -> Iterator[str]:
    """What words over line ends and their pieces can be, in lower case."""
    for chain in _CHAIN.finditer(text):
        pieces = [p.lower() for p in re.split(_JOIN, chain[0])[::3]]
        for i in range(len(pieces)):
            for j in range(i + 1, min(len(pieces), i + MOST_PIECES) + 1):
                yield "".join(pieces[i:j])


def _may_meet(left: str, join: re.Match, right: str) -> bool:
    """Whether a word can go over this line end; over blank lines only with a mark or where a line was taken out."""
    if join[2] and not join[1] and GONE not in join[2]:
        return False
    if not join[1]:
        return left[-1].isalpha() and right[0].islower()
    return (left[-1].isalpha() or left[-1] in "01!9†") and ((right[0].isalpha() and not "À" <= right[0] <= "Þ" and not right[0] in "Œ") or right[0] in "01!9†") and any(map(str.isalpha, right))


def _known(raw: str, lexicon: Lexicon) -> bool:
    low = raw.lower()
    return low in lexicon.words or lexicon.right(low) in lexicon.words


def _needs(low: str, lexicon: Lexicon) -> bool:
    return any(lexicon.right(w) is not None or lexicon.split(w) is not None for w in set(WORD.findall(low)) - lexicon.words)


def paragraphs(lines: list[str | None], lexicon: Lexicon) -> str:
    """Lines joined to paragraphs; dynamic programming decides at which line ends a paragraph ends.

    A line that was taken out (None) or blank favours a boundary only where the sentence is over.
    """
    kept: list[tuple[str, int]] = []
    gap = 0
    for line in lines:
        if line is None or not line.strip():
            gap += 1 if line is not None else 0
        else:
            kept.append((line.strip(), gap))
            gap = 0
    if not kept:
        return ""
    width = sorted(len(x) for x, _ in kept)[len(kept) // 2]
    ends = _boundaries([_line_costs(line, blank, width) for (line, _), (_, blank) in zip(kept, [*kept[1:], ("", 1)], strict=True)], [len(x) < 0.5 * width for x, _ in kept])
    out, run = [], kept[0][0]
    for i in range(1, len(kept)):
        line = kept[i][0]
        if ends[i - 1]:
            out.append(run)
            run = line
        else:
            solid = re.match(f"[{_CJK}。，、！？：；）」』]", run[-1]) and (re.match(f"[{_CJK}。，、！？：；（「『]", line[0]) or line[0].isalnum())
            run += line if solid or (re.match(f"[{_CJK}]", line[0]) and run[-1].isdigit()) else f" {line}"
    return "\n\n".join([*out, run])


def _line_costs(line: str, blank: int, width: int) -> tuple[float, float]:
    """(cost of going on after the line, cost of ending a paragraph there)."""
    over = line[-1] in ".!?。！？:：\"”»)"
    stop = (0.0 if over else 6.0) + 1.0 + (2.0 if len(line) > 0.85 * width else 0.0) - (3.0 if blank else 0.0)
    go = (2.5 if over and blank else 0.0) + (1.5 if over and len(line) < 0.6 * width else 0.0)
    return go, stop


def _boundaries(costs: list[tuple[float, float]], short: list[bool]) -> list[bool]:
    """Whether a paragraph ends after each line: the cheapest way, where a paragraph of one short line costs extra.

    State 0: the line begins a paragraph, state 1: it continues one.
    """
    best, back = [0.0, float("inf")], []
    for i, (go, stop) in enumerate(costs):
        if i == len(costs) - 1:
            break
        begin = [best[0] + stop + (1.0 if short[i] else 0.0), best[1] + stop]
        onward = [best[0] + go, best[1] + go]
        step = (0 if begin[0] <= begin[1] else 1, 0 if onward[0] <= onward[1] else 1)
        back.append(step)
        best = [begin[step[0]], onward[step[1]]]
    state = 0 if best[0] <= best[1] else 1
    ends = [False] * len(costs)
    for i in range(len(costs) - 2, -1, -1):
        ends[i] = state == 0
        state = back[i][state]
    return ends


def stream_of(text: str, keys: list[str], page: int | None) -> tuple[str, list[str | None], set[str]]:
    """The text freed of headers and page numbers, its lines, and the sorts of noise among those."""
    lines, noise = find_headers(text.split("\n"), keys, page) if "\n" in text else ([text], set())
    return "\n".join(GONE if x is None else x for x in lines) if None in lines else text, lines, noise


def repair_text(text: str, keys: list[str], page: int | None, lexicon: Lexicon) -> tuple[str, set[str]]:
    """(repaired text, sorts of noise) of one text."""
    stream, _, noise = stream_of(text, keys, page)
    return repair_stream(stream, noise, lexicon)


def repair_stream(stream: str, noise: set[str], lexicon: Lexicon) -> tuple[str, set[str]]:
    """(repaired text, sorts of noise) of a text whose headers and page numbers are out; the text itself where there is no noise."""
    decoded, more = decode(stream, lexicon)
    noise = noise | more
    if not noise:
        return stream, noise
    return paragraphs([None if x == GONE else x for x in decoded.split("\n")], lexicon), noise


def lexicon_terms(texts: DataFrame) -> DataFrame:
    """``(term, n)``: all words and look-alike pairs of all rows (body) that are frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for body in batch.column(0).to_pylist():
                low = body.lower()
                # The halves of a broken word are no words.
                counts.update(WORD.findall(_HALVES.sub(r"\1", low) if "\n" in low else low))
                if _LOOKS.search(low):
                    solid = re.sub(r"\s+", "", low)
                    for m in _LOOKS.finditer(solid):
                        i = m.start()
                        counts[solid[i : i + 2]] += 1
                        if i and not _LOOKS.match(solid[i - 1]):
                            counts[solid[i - 1 : i + 1]] += 1
            if len(counts) > 400_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    terms = texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}")
    return materialize(terms.where(F.col("term").rlike(f"[{_CJK}]") | (F.length("term") > 1)), "terms")


def common_terms(terms: DataFrame, most: int) -> tuple[dict[str, int], int, int]:
    """(the most frequent terms, the least count among them, the count of all words); the rest is ``n`` below that count.

    The cut falls between two counts, found from the number of terms of each count, so equal terms stay together.
    """
    latin = F.sum(F.when(F.col("term") < "぀", F.col("n"))).alias("words")
    levels = sorted(((r["n"], r["terms"], r["words"] or 0) for r in terms.groupBy("n").agg(F.count("*").alias("terms"), latin).collect()), reverse=True)
    cut, held = None, 0
    for n, count, _ in levels:
        if held + count > most:
            break
        cut, held = n, held + count
    cut = cut if cut is not None else (levels[0][0] + 1 if levels else LEAST_COUNT)
    table = terms.where(F.col("n") >= cut).toArrow()
    # In a fixed order, so that ties between candidates do not change from run to run.
    pairs = zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)
    return dict(sorted(pairs, key=lambda x: (-x[1], x[0]))), cut, sum(x for _, _, x in levels)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])


def records(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(kind, rec_id, asset_id, page, body) of both tables."""
    one = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").cast("long").alias("rec_id"), F.col("metadata.asset_id").alias("asset_id"), F.col("metadata.page").alias("page"), F.col("text").alias("body"))
    two = blocks.select(F.lit("block").alias("kind"), F.col("block_id").cast("long").alias("rec_id"), "asset_id", "page", F.col("text").alias("body"))
    return spread(one.where("body is not null and trim(body) <> ''")).unionByName(spread(two.where("body is not null and trim(body) <> ''")))


def header_keys(rows: DataFrame, titles: DataFrame, least_pages: int = 3, least_share: float = 0.05) -> DataFrame:
    """(asset_id, stretch, keys, parts) for stretches of ``STRETCH`` pages (-1: no page): titles of the asset, and lines that
    repeat on its pages; ``parts`` grows with the number of texts of the stretch.

    ``titles`` (asset_id, title). A repeated line has to stand on ``least_pages`` texts and on a twentieth of the texts of the
    asset between its first and last page: a chapter's header counts however large the asset is.
    """
    named = titles.where("asset_id is not null and title is not null")
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace("title", r"[\s\-–—|·~]+", " "))), "ß", "ss")
    named = named.select("asset_id", plain.alias("key")).where("key <> ''").distinct()
    wrapped = rows.where(r"asset_id is not null and body like '%\n%'").withColumn("stretch", _stretch())
    # Cheap tests first: only short lines that do not end like a sentence can be headers.
    lines = wrapped.select("asset_id", "kind", "rec_id", "page", F.explode(F.split("body", "\n")).alias("line")).where("length(line) between 8 and 160")
    lines = lines.where(~F.right(F.rtrim("line"), F.lit(1)).isin(*".!?。！？,，;；:、") & ~F.col("line").startswith("#") & ~F.col("line").startswith("- "))
    key = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), r"\s{2,}\d+\s*$|^\s*\d+\s{2,}", " "), r"[\s\-–—|·~]+", " ")), "ß", "ss")
    lines = lines.select("asset_id", "kind", "rec_id", "page", key.alias("key"))
    lines = lines.where(F.length("key") >= F.when(F.col("key").rlike(f"[{_CJK}]"), 8).otherwise(14))
    places = materialize(wrapped.groupBy("asset_id", "stretch").agg(F.count("*").alias("texts")), "header-stretches")
    seen = lines.groupBy("asset_id", "key").agg(F.count_distinct("kind", "rec_id").alias("n"), F.coalesce(F.floor(F.min("page") / STRETCH), F.lit(-1)).alias("first"), F.coalesce(F.floor(F.max("page") / STRETCH), F.lit(-1)).alias("last"), F.max(F.col("page").isNull()).alias("pageless"))
    seen = materialize(seen.where(F.col("n") >= least_pages), "header-lines")
    # The texts between the first and the last stretch of a line, from running sums over the stretches of its asset.
    upto = F.sum("texts").over(Window.partitionBy("asset_id").orderBy("stretch"))
    sums = places.withColumn("upto", upto)
    begins = sums.select("asset_id", F.col("stretch").alias("first"), (F.col("upto") - F.col("texts")).alias("below"))
    ends = sums.select("asset_id", F.col("stretch").alias("last"), "upto")
    loose = places.where("stretch = -1").select("asset_id", F.col("texts").alias("loose"))
    measured = seen.join(begins, ["asset_id", "first"]).join(ends, ["asset_id", "last"]).join(loose, "asset_id", "left")
    texts = F.col("upto") - F.col("below") + F.when(F.col("pageless") & (F.col("first") >= 0), F.coalesce("loose", F.lit(0))).otherwise(0)
    dense = measured.where(F.col("n") >= least_share * texts)
    runs = F.array_union(F.sequence("first", "last"), F.when(F.col("pageless"), F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    kept = dense.select("asset_id", F.explode_outer(runs).alias("stretch"), "key")
    every = named.join(places.select("asset_id", "stretch"), "asset_id").select("asset_id", "stretch", "key").union(kept)
    keys = every.groupBy("asset_id", "stretch").agg(F.collect_set("key").alias("keys"))
    return keys.join(places, ["asset_id", "stretch"]).select("asset_id", "stretch", "keys", F.ceil(F.col("texts") / TOGETHER).cast("int").alias("parts"))


def _stretch():
    return F.coalesce(F.floor(F.col("page") / STRETCH), F.lit(-1))


def with_keys(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """(kind, rec_id, page, body, keys): the rows with the headers of their asset and stretch of pages, null where there is none.

    A stretch with many texts has its keys once for each of its parts, so texts of one page or none are spread as well.
    """
    lined = F.col("body").contains("\n") & F.col("asset_id").isNotNull()
    keys = header_keys(rows, titles)
    keys = keys.withColumn("part", F.explode_outer(F.sequence(F.lit(0), F.col("parts") - 1)))
    # The number of parts is joined first where it is above one; most stretches have one part.
    many = keys.where("parts > 1 and part = 0").select("asset_id", "stretch", "parts")
    split = rows.where(lined).withColumn("stretch", _stretch()).join(many, ["asset_id", "stretch"], "left")
    split = split.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("kind", "rec_id"), F.col("parts"))).otherwise(0).cast("int"))
    joined = split.join(keys.drop("parts"), ["asset_id", "stretch", "part"], "left").select("kind", "rec_id", "page", "body", "keys")
    return joined.unionByName(rows.where(~lined).select("kind", "rec_id", "page", "body", F.lit(None).cast("array<string>").alias("keys")))


def _place(skel: str) -> int:
    return zlib.crc32(skel.encode()) & (FILTER_BITS - 1)


def _holds(bits: bytes, skel: str) -> bool:
    at = _place(skel)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def skeleton_filters(rare: DataFrame) -> tuple[bytes, bytes]:
    """Two filters: over the skeletons of all terms (term, n), and of those that can be parts of run-together words."""
    places = map_rows(rare, lambda items: ((_place(skeleton(r["term"])), r["n"] >= PART_COUNT and r["term"].isalpha()) for r in items), "place int, part boolean")
    table = places.groupBy("place").agg(F.max("part").alias("part")).toArrow()
    at, part = table.column(0).to_numpy(), table.column(1).to_numpy()

    def bits(places: np.ndarray) -> bytes:
        flags = np.zeros(FILTER_BITS, np.bool_)
        flags[places] = True
        return np.packbits(flags, bitorder="little").tobytes()

    return bits(at), bits(at[part.astype(bool)])


class Needs:
    """Which of the terms that a worker does not hold can matter to a text, as skeletons.

    ``every`` and ``parts`` are the filters over those terms, ``longest`` the length of the longest term of the corpus that can be a part.
    """

    def __init__(self, held: dict[str, int], lexicon: Lexicon, every: bytes, parts: bytes, longest: int) -> None:
        self.held, self.every, self.parts, self.longest = held, every, parts, longest
        self.able = {s for s, words in lexicon.likely.items() if any(lexicon.counts[w] >= PART_COUNT for w in words)}
        self.brief = {skeleton(w) for w in lexicon.frequent}
        self.any_part = any(parts)
        self.known: dict[str, frozenset[str]] = {}

    def of(self, stream: str) -> set[str]:
        words = {*WORD.findall(stream.lower()), *meeting(stream)}
        if _FOLDED.search(stream):
            words.update(x.lower() for x in re.findall(WORD.pattern, stream, flags=re.I))
        out: set[str] = set()
        # One by one: the difference to a view of a dict walks through all that is held.
        for w in words:
            if w not in self.held:
                out |= self.of_word(w)
        if _WRONG.search(stream):
            solid = re.sub(r"\s+", "", stream)
            for m in _WRONG.finditer(solid):
                out |= self.of_pairs(solid[m.start() - 1 : m.start()] if m.start() else "", m[0], solid[m.end() : m.end() + 1])
        return out

    def of_pairs(self, before: str, char: str, after: str) -> frozenset[str]:
        """Of the pairs that decide on a look-alike character; the one before it may be undone first."""
        key = f"{before}\n{char}{after}"
        if key not in self.known:
            if len(self.known) > COMMON:
                self.known.clear()
            either = (char, *_PAIRS[char])
            pairs = {a + c for a in (before, *_PAIRS.get(before, ())) for c in either if before > "~"} | {c + after for c in either if after > "~"}
            self.known[key] = frozenset(s for s in (skeleton(p) for p in pairs if p not in self.held) if _holds(self.every, s))
        return self.known[key]

    def of_word(self, word: str) -> frozenset[str]:
        if word not in self.known:
            if len(self.known) > COMMON:
                self.known.clear()
            self.known[word] = frozenset(s for s in {skeleton(word), *self.parts_of(word)} if _holds(self.every, s))
        return self.known[word]

    def parts_of(self, word: str) -> set[str]:
        """Skeletons of the parts of a word that can be read as run together; none where no parts that can be words fill it."""
        flat, n = word.translate(_SINGLES), len(word)
        reached, out = [True, *[False] * n], set()
        for i in range(n - 1 if n >= 5 else 0):
            if not reached[i]:
                continue
            for j in range(i + 2, min(n, i + 2 * self.longest) + 1):
                skel = flat[i:j]
                for bad, good in _DOUBLES:
                    if bad in skel:
                        skel = skel.replace(bad, good)
                if j - i < n and (skel in self.brief if j - i < 4 else skel in self.able or (self.any_part and _holds(self.parts, skel))):
                    reached[j] = True
                    out.add(skel)
        return out if reached[n] else set()


def with_rare_terms(waiting: DataFrame, rare: DataFrame) -> DataFrame:
    """Adds ``rare``: the terms (term, n) of the table ``rare`` whose skeletons are ``asked`` for by a row (uid)."""
    skeletons = map_rows(rare, lambda items: ((r["term"], r["n"], skeleton(r["term"])) for r in items), "term string, n long, skel string")
    met = waiting.select("uid", F.explode("asked").alias("skel")).join(skeletons, "skel")
    return waiting.join(met.groupBy("uid").agg(F.collect_list(F.struct("term", "n")).alias("rare")), "uid", "left")


def repair(rows: DataFrame, titles: DataFrame, common: int = COMMON) -> DataFrame:
    """The operator: ``(kind, rec_id, noises, repaired)`` of the rows of :func:`records` that hold noise."""
    name = uuid.uuid4().hex
    terms = lexicon_terms(rows.select("body"))
    held, least, total = common_terms(terms, common)
    keyed, rare = with_keys(rows, titles), terms.where(F.col("n") < least)
    out = "kind string, rec_id long, noises array<string>, repaired string"
    if least <= LEAST_COUNT or rare.isEmpty():
        shared = rows.sparkSession.sparkContext.broadcast((held, total))

        def whole(items: Iterable[dict]) -> Iterator[tuple]:
            lex = _lexicon(name, shared)
            for r in items:
                text, noise = repair_text(r["body"], r["keys"] or [], r["page"], lex)
                if noise:
                    yield r["kind"], r["rec_id"], sorted(noise), text

        return map_rows(keyed, whole, out)
    longest = terms.where(F.col("n") >= PART_COUNT).agg(F.coalesce(F.max(F.length("term")), F.lit(0))).first()[0]
    shared = rows.sparkSession.sparkContext.broadcast((held, total, (*skeleton_filters(rare), longest)))

    def first(items: Iterable[dict]) -> Iterator[tuple]:
        lex, needs = _lexicon(name, shared), _needs_of(name, shared)
        for i, r in enumerate(items):
            stream, _, noise = stream_of(r["body"], r["keys"] or [], r["page"])
            asked = needs.of(stream)
            if asked:
                yield (TaskContext.get().partitionId() << 40) + i, r["kind"], r["rec_id"], sorted(noise), stream, sorted(asked)
                continue
            text, noise = repair_stream(stream, noise, lex)
            if noise:
                yield None, r["kind"], r["rec_id"], sorted(noise), text, None

    def second(items: Iterable[dict]) -> Iterator[tuple]:
        lex = _lexicon(name, shared)
        for r in items:
            if r["rare"]:
                lex.add([(x["term"], x["n"]) for x in r["rare"]])
            text, noise = repair_stream(r["repaired"], set(r["noises"]), lex)
            if noise:
                yield r["kind"], r["rec_id"], sorted(noise), text

    read = materialize(map_rows(keyed, first, f"uid long, {out}, asked array<string>"), "scan-first")
    done = read.where("uid is null").select("kind", "rec_id", "noises", "repaired")
    return done.unionByName(map_rows(with_rare_terms(read.where("uid is not null"), rare), second, out))


_LEXICONS: dict[str, Lexicon] = {}


def _lexicon(name: str, shared) -> Lexicon:
    """The lexicon of one run, built once in each worker."""
    if name not in _LEXICONS:
        _LEXICONS.clear()
        held, total = shared.value[:2]
        _LEXICONS[name] = Lexicon(dict(held), total)
    return _LEXICONS[name]


_NEEDS: dict[str, Needs] = {}


def _needs_of(name: str, shared) -> Needs:
    if name not in _NEEDS:
        _NEEDS.clear()
        held, _, filters = shared.value
        _NEEDS[name] = Needs(held, _lexicon(name, shared), *filters)
    return _NEEDS[name]


def all_titles(chunks: DataFrame, log: DataFrame) -> DataFrame:
    return chunks.select(F.col("metadata.asset_id").alias("asset_id"), F.col("metadata.asset_title").alias("title")).union(log.select("asset_id", "asset_title"))


def found(chunks: DataFrame, blocks: DataFrame, log: DataFrame) -> DataFrame:
    """p3_found: one row for each sort of noise in each text, of the four sorts that the query defines."""
    noises = repair(records(chunks, blocks), all_titles(chunks, log)).select("kind", "rec_id", F.explode("noises").alias("noise"))
    return noises.where(F.col("noise").isin("hyphen", "char", "header", "pageno")).distinct()
