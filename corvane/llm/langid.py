"""Problem 5: the language of documents, and of the segments of mixed ones, with a confidence.

Method: word-first backoff. A known word scores with its log frequency in each language; an unseen word falls back to
character n-grams that get shorter until some are known. Scripts without blanks have pieces of two Han or three kana
characters for words. The model is fitted on the fixed table of clean samples (bounded by ``max_samples`` rows).

A text is cut into sentences; a sentence counts for its language if it is whole: it ends like one and has at least four
words (or eight characters of a script without blanks); queries need no mark at the end. A text with whole
sentences in several languages is mixed and has one row for each.

Defined results: null and blank texts and texts of under eight letters have no language. Ties take the language that
comes first in ``LANGS``. Repeated rows give repeated rows. A label counts as right if it is a usual code or name of the
language. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import spread

LANGS = ("en", "zh", "de", "fr", "es", "ja")
LEAST_LETTERS = 8
#: Usual codes and names of the languages, in lower case, without region or script.
NAMES = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "ingles", "英语", "英文", "英語"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "chinesisch", "chinois", "chino", "中文", "汉语", "漢語", "简体中文", "繁體中文", "中国語"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "德语", "德文", "ドイツ語"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "法语", "法文", "フランス語"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "西班牙语", "スペイン語"),
    "ja": ("ja", "jpn", "jp", "japanese", "日本語", "japanisch", "japonais", "japonés", "日语", "日文"),
}
_TOKEN = re.compile(r"[a-zß-öø-ÿœ]+|[぀-ゟ]{1,3}|[゠-ヿ]{1,3}|[一-鿿]{1,2}|[。！？!?]|\.(?=\s|$|[぀-鿿])|\n\s*\n|\n|(?<=\s)[/—–|](?=\s)")
_END, _LINE, _PARA, _BAR, _TEXT = 0, 1, 2, 3, 4
_MARKS = {"\n": _LINE, "/": _BAR, "—": _BAR, "–": _BAR, "|": _BAR, **dict.fromkeys(".。！？!?", _END)}
_CACHE = 400_000


class Model:
    """Scores of words for each language; fitted on ``(lang, text)`` samples."""

    def __init__(self, samples: list[tuple[str, str]], smooth: float = 0.1, orders: tuple[int, ...] = (4, 3, 2, 1)) -> None:
        words = {lang: Counter() for lang in LANGS}
        for lang, text in samples:
            if lang in words:
                words[lang].update(t for t in _TOKEN.findall(text.lower()) if t not in _MARKS and not t.isspace())
        self.words = self._table(words, smooth)
        self.orders = orders
        self.grams = []
        for n in orders:
            grams = {lang: Counter() for lang in LANGS}
            for lang, counts in words.items():
                for w, c in counts.items():
                    for g in _grams(w, n):
                        grams[lang][g] += c
            self.grams.append(self._table(grams, smooth))

    @staticmethod
    def _table(counts: dict[str, Counter], smooth: float) -> dict[str, np.ndarray]:
        every = set().union(*counts.values())
        total = np.array([sum(counts[x].values()) for x in LANGS], float) + smooth * (len(every) + 1)
        out = {}
        for key in every:
            logs = np.log((np.array([counts[x][key] for x in LANGS]) + smooth) / total)
            out[key] = (logs - logs.max()).astype(np.float32)
        return out

    def score(self, word: str) -> np.ndarray:
        """Log scores of a word, the best language at 0; a word without any known part says nothing but its script."""
        if word[0] < "぀":
            return self._backoff(word)
        scores = self._backoff(word)
        foreign = np.array([0.0 if lang in ("zh", "ja") else -3.0 for lang in LANGS], np.float32)
        if word[0] < "㐀":
            foreign[LANGS.index("zh")] = -4.0
        return np.minimum(scores, scores.max() + foreign)

    def _backoff(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        for table, n in zip(self.grams, self.orders, strict=True):
            hits = [table[g] for g in _grams(word, n) if g in table]
            if hits:
                # Unseen words are often names: shorter n-grams say less, and long words no more than short ones.
                sums = np.sum(hits, axis=0) * (0.12 * n / max(3, len(hits)) if word[0] < "぀" else 0.3)
                return (sums - sums.max()).astype(np.float32)
        return np.zeros(len(LANGS), np.float32)


def _grams(word: str, n: int) -> list[str]:
    if word[0] >= "぀":
        return [word[i : i + n] for i in range(len(word) - n + 1)] if n < 3 else []
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Scorer:
    """Tokens as numbers of a table of scores that fills up as words come; emptied before it grows too large."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {k: v for k, v in _MARKS.items()}
        self.scores = np.zeros((_CACHE + 50_000, len(LANGS)), np.float32)
        self.sizes = np.zeros((_CACHE + 50_000, 3), np.int16)
        self.next = _TEXT + 1

    def number(self, token: str) -> int:
        if token.isspace():
            return _PARA
        at = self.next
        if at >= len(self.scores):
            grown = len(self.scores) * 2
            self.scores = np.resize(self.scores, (grown, len(LANGS)))
            self.sizes = np.resize(self.sizes, (grown, 3))
        self.next += 1
        self.ids[token] = at
        self.scores[at] = self.model.score(token)
        self.sizes[at] = (0, len(token), len(token) * (token[0] < "㐀")) if token[0] >= "぀" else (1, 0, 0)
        return at

    def tokens(self, text: str) -> list[int]:
        get, number = self.ids.get, self.number
        return [n if (n := get(t)) is not None else number(t) for t in _TOKEN.findall(text)]


def verdicts(texts: list[str], queries: list[bool], scorer: Scorer) -> list[list[tuple[str, float]]]:
    """The languages of each text with their confidence: one for plain texts, several for mixed ones."""
    if not texts:
        return []
    if scorer.next > _CACHE:
        scorer.clear()
    flat: list[int] = []
    owner: list[int] = []
    for k, t in enumerate(texts):
        own = scorer.tokens(t.lower())
        own.append(_TEXT)
        flat += own
        owner.append(len(flat))
    ids = np.array(flat, np.int64)
    ends_of = np.array(owner)
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends_of, prepend=0))
    is_query = np.array(queries, bool)[text_of]
    cut = (ids == _END) | (ids == _PARA) | (ids == _TEXT) | (is_query & ((ids == _LINE) | (ids == _BAR)))
    ends = np.flatnonzero(cut)
    begins = np.concatenate(([0], ends[:-1] + 1))
    sums = _between(scorer.scores[ids], begins, ends)
    sizes = _between(scorer.sizes[ids].astype(np.int64), begins, ends)
    latin, cjk, kana = sizes.T
    # No Japanese sentence goes without kana.
    sums[:, LANGS.index("ja")] -= np.where((cjk >= 4) & (kana == 0), 8.0, 0.0)
    first = np.concatenate(([0], np.searchsorted(ends, ends_of - 1)[:-1] + 1))
    last = np.searchsorted(ends, ends_of - 1) + 1
    out: list[list[tuple[str, float]]] = []
    top = np.partition(sums, -2, axis=1) if len(sums) else sums
    margin = top[:, -1] - top[:, -2] if len(sums) else np.zeros(0)
    best = sums.argmax(axis=1) if len(sums) else np.zeros(0, int)
    ended = (ids[ends] == _END) | is_query[ends]
    whole = ended & ((latin >= 4) | (cjk >= np.where(is_query[ends], 6, 8))) & (margin >= 4.0)
    for k, text in enumerate(texts):
        lo, hi = first[k], last[k]
        if sum(map(str.isalpha, text)) < LEAST_LETTERS:
            out.append([])
            continue
        votes = Counter()
        for s in range(lo, hi):
            if queries[k] and (latin[s] >= 4 and cjk[s] >= 6 or latin[s] >= 8):
                votes.update(_parts(ids[begins[s] : ends[s]], scorer))
            elif whole[s]:
                votes[int(best[s])] += int(latin[s] * 5 + cjk[s])
        total = sums[lo:hi].sum(axis=0)
        weight = max(1.0, math.sqrt(float(latin[lo:hi].sum() + cjk[lo:hi].sum() / 2)))
        if len(votes) == 1:
            lang = next(iter(votes))
            p = np.exp((total - max(total.max(), total[lang])) / weight)
            out.append([(LANGS[lang], round(float(max(p[lang], 0.5 * p.max()) / p.sum()), 4))])
        elif votes:
            out.append([(LANGS[i], round(n / sum(votes.values()), 4)) for i, n in sorted(votes.items())])
        else:
            p = np.exp((total - total.max()) / weight)
            out.append([(LANGS[int(total.argmax())], round(float(p.max() / p.sum()), 4))])
    return out


def _between(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of rows begins..ends-1; empty stretches are zero."""
    run = np.add.reduceat(np.vstack((values, values[:1] * 0)), np.stack((begins, ends), 1).ravel(), axis=0)[::2]
    run[begins == ends] = 0
    return run


def _parts(ids: np.ndarray, scorer: Scorer) -> Counter:
    """Whole questions within one stretch of a query that has no mark between them."""
    sizes, scores = scorer.sizes[ids], scorer.scores[ids].astype(float)
    votes: Counter = Counter()
    cjk = sizes[:, 1] > 0
    if sizes[~cjk, 0].sum() >= 4 and sizes[:, 1].sum() >= 6:
        top = np.sort(scores[~cjk].sum(axis=0))
        if top[-1] - top[-2] >= 4.0:
            votes[int(scores[~cjk].sum(axis=0).argmax())] += int(sizes[~cjk, 0].sum() * 5)
        votes[int(scores[cjk].sum(axis=0).argmax())] += int(sizes[:, 1].sum())
        return votes
    run = np.vstack((np.zeros(len(LANGS)), scores.cumsum(axis=0)))
    whole = run[-1].max()
    split = run.max(axis=1) + (run[-1] - run).max(axis=1)
    inner = split[4:-4]
    if len(inner) and inner.max() - whole >= 12.0:
        at = 4 + int(inner.argmax())
        votes[int(run[at].argmax())] += at * 5
        votes[int((run[-1] - run[at]).argmax())] += (len(ids) - at) * 5
    else:
        votes[int(run[-1].argmax())] += len(ids) * 5
    return votes


def fit(samples: DataFrame, max_samples: int = 20_000) -> Model:
    """A model of the samples (lang, text); at most ``max_samples`` rows, by their text."""
    rows = samples.where("text is not null and lang is not null").select("lang", "text").orderBy("text", "lang").limit(max_samples).collect()
    return Model([(r[0], r[1]) for r in rows])


def label_lang(label: Column) -> Column:
    """The language that a label names, or null."""
    plain = F.lower(F.trim(label))
    base = F.regexp_replace(plain, r"[-_](?:[a-z]{2}|[a-z]{4}|\d{3})(?:[-_][a-z]{2})?$", "")
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(base.isin(*names) | plain.isin(*names), lang).otherwise(out)
    return out


def detect(rows: DataFrame, model: Model, every: bool = False) -> DataFrame:
    """``(kind, rec_id, named, lang, confidence, mixed)`` of the rows (kind, rec_id, body, named).

    ``named`` is passed through: the language that the declared label names. With ``every``, a row without a verdict
    has a null language with confidence 0.
    """
    none = [(None, 0.0)] if every else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                kinds, ids, bodies, named = (c.to_pylist() for c in batch.slice(at, 400).columns)
                found = verdicts([b or "" for b in bodies], [k == "query" for k in kinds], scorer)
                out = [(k, i, n, lang, conf, len(f) > 1) for k, i, n, f in zip(kinds, ids, named, found, strict=True) for lang, conf in f or none]
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds_of = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_of, strict=True)], names=["kind", "rec_id", "named", "lang", "confidence", "mixed"])

    return rows.mapInArrow(run, "kind string, rec_id long, named string, lang string, confidence double, mixed boolean")


def records(chunks: DataFrame, queries: DataFrame, documents: DataFrame, every: bool = False) -> DataFrame:
    """(kind, rec_id, body, named) of the three tables; null texts only with ``every``."""
    parts = []
    for kind, df, key, text in (("chunk", chunks, "chunk_id", "text"), ("query", queries, "query_id", "raw"), ("document", documents, "doc_id", "text")):
        parts.append(spread(df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("rec_id"), F.col(text).alias("body"), label_lang(F.col("lang")).alias("named")).where(F.lit(every) | F.col("body").isNotNull())))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def labels(chunks: DataFrame, queries: DataFrame, documents: DataFrame, samples: DataFrame) -> DataFrame:
    """p5_labels: every record; null texts and those without a verdict have a null language with confidence 0."""
    return detect(records(chunks, queries, documents, every=True), fit(samples), every=True)


def found(chunks: DataFrame, queries: DataFrame, documents: DataFrame, samples: DataFrame, residue: DataFrame) -> DataFrame:
    """p5_found: records whose label is missing or wrong, and every language of mixed ones. ``residue`` (id) is left out."""
    rows = detect(records(chunks, queries, documents), fit(samples)).where("mixed or named is null or named <> lang")
    bad = residue.select(F.lit("document").alias("kind"), F.col("id").alias("rec_id"))
    return rows.join(bad, ["kind", "rec_id"], "left_anti").select("kind", "rec_id", "lang").distinct()


def segments(rows: DataFrame, model: Model) -> DataFrame:
    """``(kind, rec_id, seg, start, lang, confidence, piece)``: the sentences of texts, neighbours of one language joined.

    ``rows`` as for :func:`detect`; meant for the mixed ones.
    """
    from corvane.llm.arrow import map_rows

    def run(items) -> Iterator[tuple]:
        scorer = Scorer(model)
        for r in items:
            spans: list[list] = []
            text = r["body"]
            for lo, hi in _sentences(text, r["kind"] == "query"):
                total = scorer.scores[scorer.tokens(text[lo:hi].lower())].sum(axis=0)
                p = np.exp((total - total.max()) / 2)
                lang, conf = LANGS[int(total.argmax())], float(p.max() / p.sum())
                if spans and (spans[-1][2] == lang or conf < 0.5):
                    spans[-1][1], spans[-1][3] = hi, max(spans[-1][3], conf)
                else:
                    spans.append([lo, hi, lang, conf])
            for k, (lo, hi, lang, conf) in enumerate(spans):
                yield r["kind"], r["rec_id"], k, lo, lang, round(conf, 4), text[lo:hi]
            if scorer.next > _CACHE:
                scorer.clear()

    return map_rows(rows, run, "kind string, rec_id long, seg int, start int, lang string, confidence double, piece string")


_CUT = re.compile(r"(?<=[。！？])|(?<=[.!?])(?=\s|[぀-鿿])|\n\s*\n")
_CUT_QUERY = re.compile(r"(?<=[。！？])|(?<=[.!?])(?=\s|[぀-鿿])|\n|(?<=\s)[/—–|](?=\s)")


def _sentences(text: str, query: bool) -> Iterator[tuple[int, int]]:
    begin = 0
    for m in (_CUT_QUERY if query else _CUT).finditer(text):
        if m.end() > begin:
            yield begin, m.end()
            begin = m.end()
    if begin < len(text):
        yield begin, len(text)
