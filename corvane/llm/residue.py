"""Problem 8: template residue, filler and error pages in place of content.

Method: trusted labels spread through the connected components of a graph of documents and their units (lines and
sentences, with placeholders and numbers made equal). Trusted are units of a few general forms: placeholder syntax, the
classic filler passage, a word or unit said over and over, status lines and dumps of programs, demands for scripts,
apologies. Links are

* units that stand in two or more different documents: such a unit takes the label if most of the documents that can tell
  show residue beside it (labelled units that outweigh what is the document's own);
* near-duplicate documents: candidates share a band of minima of their shingles (at the threshold 0.9998 of the pairs do)
  and are verified by the similarity of their shingles.

Labels spread until nothing changes. A document is residue if its labelled units outweigh all others, or if a verified link
ties it to residue. Shingles are of five words at a similarity of 0.8 or more; texts of under five words use all their words.

Defined results: null, empty and blank texts are no residue and stay in the clean corpus. Ties (as much residue as
content) are no residue unless a link reaches them. Repeated rows share one verdict. Empty tables give no rows. Other
columns are passed on as they are by :func:`clean`; the verdict itself uses the id and the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import map_rows
from corvane.llm.shingles import band_keys, codes, sequence_hashes, set_signature, token_hashes, windows
from corvane.session import materialize, spread

SIMILARITY = 0.8
#: A pair is a candidate if it shares one of so many keys, each of so many minima: 0.9998 of the pairs at the threshold do.
BANDS, ROWS = 16, 4
#: A unit said so often in one document, and making up most of it, is filler.
REPEATS = 3
#: Labelled units of a document make up one part in so many before its other units can take the label from them.
LEAST_SHARE = 5

#: The syntax of placeholders, and in brackets what asks for a text.
_ASKS = r"insert|your|insérer|poner|inserir|ihre?n?|hier|enter|add|fill in|votre|su"
_LATER = r"goes (?:here|in)|to be added|to be filled|to come|à compléter|à remplir|por definir|por completar|einfügen|ergänzen|folgt|待补充|待补|此处填写|请输入|请填写|ここに記入|未定|を入力|未記入"
PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[A-Za-z0-9_.]+\s*\}\}\}?|\$\{[A-Za-z0-9_.]+\}|(?<![A-Za-z0-9_\\}])\{[A-Za-z][A-Za-z0-9_.]+\}|<%.{0,60}?%>|\{%.{0,60}?%\}|&lt;[A-Za-z0-9_.]+&gt;|(?<![A-Za-z0-9])__[A-Za-z][A-Za-z0-9_.]*?__(?![A-Za-z0-9])|@@[A-Za-z0-9_.]+@@|(?<![A-Za-z0-9_#])#[A-Za-z][A-Za-z0-9_.]+#"
    r"|(?<![A-Za-z0-9_$])\$[A-Za-z][A-Za-z0-9_.]{2,}\$|(?<![A-Za-z0-9])%[A-Za-z][A-Za-z0-9_.]{2,}%|«\s?[A-Za-z0-9_.]+\s?»|<(?!/?(?:h\d|noscript|br|p|div|span|s|b|i|a|u|ul|li|table|tr|td)\b)(?:(?:" + _ASKS + r") )?[A-Za-z][A-Za-z0-9_.]{2,}>"
    r"|\[(?:" + _ASKS + r")\b[^\]\n]{0,60}\]|\[(?!mask\b|sep\b|cls\b|unk\b|pad\b)[A-Za-z_.]{4,}\d?[A-Za-z0-9_]*\]|[【〔（(\[<][^】〕）)\]>\n]{0,40}(?:" + _LATER + r")[^】〕）)\]>\n]{0,40}[】〕）)\]>]|(?<![A-Za-z])TODO:? ?[A-Za-z0-9_]+|(?<![A-Za-z])FIXME:? ?[A-Za-z0-9_]+|\bT\.?B\.?D\.?\b",
    re.I,
)
#: Words of the classic filler passage.
_LOREM = frozenset(
    "lorem orem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "ac ante arcu augue bibendum blandit condimentum cras curabitur cursus dapibus diam dictum egestas eget eleifend elementum erat eros facilisi facilisis fames faucibus felis fermentum feugiat fringilla fusce gravida habitant hendrerit iaculis imperdiet integer interdum justo lacinia lacus laoreet lectus leo libero ligula lobortis luctus maecenas malesuada massa mattis mauris metus mi molestie morbi nam nec neque netus nibh nisl nullam nunc odio orci ornare pellentesque pharetra phasellus placerat porta porttitor posuere praesent pretium proin pulvinar purus quam quisque rhoncus risus rutrum sagittis sapien scelerisque sem semper senectus sodales sollicitudin suscipit suspendisse tellus tempus tincidunt tortor tristique turpis ultrices ultricies urna varius vehicula vel vestibulum vitae vivamus viverra volutpat vulputate".split()
)
#: Words of the passage that are words of living languages too; they count only beside others.
_COMMON = frozenset("do et ut ad ex in non id est qui sit sed ac sem mi leo nec nam vel ea eu sunt esse porta massa nulla integer cursus libero nunc".split())
FILLER = re.compile(r"placeholder|dummy|lorem ipsum|factice|relleno|platzhalter|blindtext|ダミー|占位", re.I)
#: A word said again at once, two or more times in a row.
AGAIN = re.compile(r"(\w{2,12}?)(?:[ .,、。]*\1)+(?!\w*[a-z])", re.I)
#: Reason phrases of status codes.
_REASONS = r"bad request|unauthorized|forbidden|not found|method not allowed|request timeout|conflict|gone|too many requests|internal server error|bad gateway|service unavailable|gateway timeout"
STATUS = re.compile(
    rf"^\W*(?:(?:http|error|status|code|erreur|fehler)[ :=/]*){{1,3}}[45]\d\d\b|^\W*[45]\d\d(?:\W+(?:{_REASONS}))?\W*$|^\W*(?:{_REASONS})\W*$|^\{{?\"?(?:ok|code|error|status)\"?: ?[\d\"{{fn]|^traceback \(most recent call last\)|^file \"[^\"\n]+\", line \d+|^\w+(?:error|exception): ",
    re.I,
)
_DEMAND = r"(?:enabl|activ|aktivier|turn(?:ed)? o|allow|disabl|désactiv|desactiv|deaktivier|block|bloqu|requir|need|启用|开启|允许|禁用|有効|無効)"
_SCRIPT = r"(?:javascript|\bjs\b|\bscripts?\b|脚本|スクリプト)"
SCRIPTS = re.compile(rf"{_DEMAND}.{{0,30}}{_SCRIPT}|{_SCRIPT}.{{0,30}}{_DEMAND}", re.I)
SORRY = re.compile(r"^\W*(?:sorry|oops|we (?:could not|couldn['’]t|cannot|are unable to)|unable to|failed to|could not|cannot)\b", re.I)
#: Some part of each trusted form, in lower case; units without any are not looked at.
HINTS = ("{", "[", "<", "«", "__", "@@", "#", "%", "$", "&lt;", "todo", "fixme", "tbd", "t.b.d", *re.sub(r"\(\?:here\|in\)", "", _LATER).split("|"), "placeholder", "dummy", "factice", "relleno", "platzhalter", "blindtext", "ダミー", "占位", "javascript", "script", " js", "js ", "脚本", "スクリプト", "http", "error", "exception: ", "status", "code=", "code:", 'code"', "code 4", "code 5", "erreur", "fehler", "traceback", 'file "', '"ok', "sorry", "oops", "we could", "we cannot", "we are", "unable to", "failed to", "could not", "cannot", *_REASONS.split("|"), *sorted(w for w in _LOREM if len(w) > 4 and w not in _COMMON))
_CODE_LINE = re.compile(r"^\W*[45]\d\d\W*$")
_TAGS = re.compile(r"</?(?:noscript|h\d|p|div|br|span|b|i|html|body)\b[^<>]*>", re.I)
_UNITS = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。！？])")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def _hinted():
    try:
        import ahocorasick
    except ImportError:
        return lambda low: any(h in low for h in HINTS)
    machine = ahocorasick.Automaton()
    for h in HINTS:
        machine.add_word(h, 1)
    machine.make_automaton()
    return lambda low: next(machine.iter(low), None) is not None


def _size(text: str) -> int:
    return len(text) - text.count(" ")


def _words(text: str) -> float:
    """Words, where two characters of a script without blanks are one."""
    cjk = len(_CJK.findall(text))
    return len(_WORD.findall(_CJK.sub(" ", text) if cjk else text)) + cjk / 2


def trusted(unit: str) -> bool:
    """Whether a unit is residue by its form alone."""
    size = _size(unit)
    spots = PLACEHOLDER.findall(unit)
    if spots:
        rest = PLACEHOLDER.sub(" ", unit)
        left = _size(rest)
        if len(spots) >= 2 or left <= 6 or _words(rest) <= 3 or size - left >= left:
            return True
    words = [w.lower() for w in _WORD.findall(unit)]
    filler = [w for w in words if w in _LOREM]
    if len(filler) * 2 >= len(words) > 1 and not _COMMON.issuperset(filler):
        return True
    if STATUS.search(unit) or SORRY.search(unit):
        return True
    few = _words(unit)
    return few <= 14 and bool(SCRIPTS.search(unit)) or few <= 8 and bool(FILLER.search(unit))


def stutters(unit: str) -> bool:
    """Whether a unit says a word three times in a row, or is for the greater part words said again at once."""
    return _THRICE.search(unit) is not None or sum(_size(m[0]) for m in AGAIN.finditer(unit)) * 2 > _size(unit)


_THRICE = re.compile(r"(?<!\w)([a-zß-öø-ÿ]{3,12})(?:[ .,]+\1){2}(?!\w)|([぀-ヿ一-鿿]{2,4})\2\2", re.I)

def units(low: str) -> list[str]:
    """The lines and sentences of a text."""
    return [u for x in _UNITS.split(_TAGS.sub(" ", low) if "<" in low else low) if (u := x.strip())]


def masked(text: str) -> str:
    """The text in lower case with placeholders and numbers made equal."""
    return _DIGITS.sub("0", PLACEHOLDER.sub(" xplace ", text.lower()))


def _repeating(tokens: np.ndarray, begins: np.ndarray) -> list[int]:
    """The stretches in which a token, or a pair or more of them, comes again at once; masked numbers do not count."""
    out = [np.zeros(0, np.int64)]
    number = token_hashes(["0"])[0]
    for width in (1, 2, 3, 4):
        if len(tokens) >= 2 * width:
            same = (tokens[:-width] == tokens[width:]) & (tokens[:-width] != number)
            run = np.flatnonzero(np.logical_and.reduce([same[k : len(same) - width + 1 + k] for k in range(width)]))
            at = np.searchsorted(begins, run, "right") - 1
            out.append(at[run + 2 * width <= begins[at + 1]])
    return np.unique(np.concatenate(out)).tolist()


@dataclass
class Read:
    """What a batch of texts holds: for each text its shingles, its size and where its units begin (with the end as the
    last); for each unit, once in a text, its hash, its size and whether it is trusted."""

    sets: list[np.ndarray]
    totals: np.ndarray
    begins: np.ndarray
    units: np.ndarray
    sizes: np.ndarray
    trusted: np.ndarray


def read(texts: list[str], hinted) -> Read:
    flat: list[str] = []
    marks: list[bool] = []
    ends = [0]
    for text in texts:
        low = text.lower()
        own = units(_DIGITS.sub("0", low))
        if hinted(low) or "0" in own:
            # Masked numbers change no end of a unit, so both lists run side by side.
            for k, u in enumerate(units(low)):
                mark = False
                if hinted(u):
                    mark, own[k] = trusted(u), masked(u)
                marks.append(mark or (own[k] == "0" and _CODE_LINE.match(u) is not None))
        else:
            marks += [False] * len(own)
        flat += own
        ends.append(len(flat))
    tokens, begins = token_hashes(flat)
    for u in _repeating(tokens, begins):
        marks[u] = marks[u] or stutters(flat[u])
    edges = begins[ends]
    sets = windows(tokens, edges, 5)
    for k in range(len(texts)):
        if not len(sets[k]):
            sets[k] = np.unique(tokens[edges[k] : edges[k + 1]])
    data, at = codes(flat)
    sizes = np.diff(at) - np.diff(np.concatenate(([0], np.cumsum(data == 32)))[at])
    counts = np.diff(begins)
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends))
    # Units without a token (of other scripts) are content of their text, rules and bullets are nothing.
    weighty = counts > 0
    for u in np.flatnonzero(~weighty):
        weighty[u] = any(map(str.isalpha, flat[u]))
    totals = np.bincount(text_of[weighty], sizes[weighty], len(texts)).astype(np.int64)
    kept = np.flatnonzero(counts)
    sigs = sequence_hashes(tokens, begins)[kept]
    order = np.lexsort((sigs, text_of[kept]))
    sigs, owner, size, mark = sigs[order], text_of[kept][order], sizes[kept][order], np.array(marks, bool)[kept][order]
    if len(sigs):
        first = np.flatnonzero(np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (owner[1:] != owner[:-1]))))
        times = np.diff(np.concatenate((first, [len(sigs)])))
        size, mark = np.add.reduceat(size, first), np.logical_or.reduceat(mark, first)
        sigs, owner = sigs[first], owner[first]
        again = times >= REPEATS
        mark |= again & (np.bincount(owner[again], size[again], len(texts)) * 2 > totals)[owner]
    return Read(sets, totals, np.searchsorted(owner, np.arange(len(texts) + 1)), sigs, size, mark)


def _raw(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(id, sig, raw, total, units, keys)`` of the rows (id, body) with words; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hinted = _hinted()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 500).columns)
                r = read(texts, hinted)
                rows = [k for k, s in enumerate(r.sets) if len(s)]
                keys = np.concatenate([band_keys(r.sets[k], BANDS, ROWS) for k in rows]).view(np.int64) if rows else np.zeros(0, np.int64)
                # Texts without shingles have no units, so the units of the others stand in a row.
                parts = pa.StructArray.from_arrays([pa.array(r.units), pa.array(r.sizes.astype(np.int32)), pa.array(r.trusted)], ["unit", "size", "trusted"])
                ends = r.begins[[*rows, len(texts)]].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in rows], pa.int64()), pa.array([set_signature(r.sets[k]) for k in rows], pa.int64()), pa.array([_raw(texts[k]) for k in rows], pa.int64()), pa.array(r.totals[rows].astype(np.int32) if rows else [], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), parts), pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * BANDS, pa.array(keys))],
                    names=["id", "sig", "raw", "total", "units", "keys"],
                )

    return docs.mapInArrow(run, "id long, sig long, raw long, total int, units array<struct<unit:long,size:int,trusted:boolean>>, keys array<long>")


def found(docs: DataFrame) -> DataFrame:
    """``(id)`` of the rows (id, body) that are residue."""
    return verdicts(docs).select("id")


def verdicts(docs: DataFrame) -> DataFrame:
    """``(id, how)`` of the residue among the rows (id, body).

    ``how`` is 'form' where units trusted by their form outweigh the rest, 'units' where units that took the label from
    others do, and 'copy' where a verified near-duplicate carries it.
    """
    texts = docs.where("body is not null and trim(body) <> ''")
    prints = materialize(fingerprints(spread(texts)), "residue-prints")
    # Texts with the same set share a verdict: one of them stands for all, so a hot text counts once, or as two where
    # texts that differ (in numbers or placeholders) have the same set.
    again = prints.groupBy("sig").agg(F.count("*").alias("n"), F.when(F.min("raw") < F.max("raw"), 2).otherwise(1).alias("texts"))
    again = materialize(again.where("n > 1").select("sig", "texts"), "residue-copies")
    single = prints.join(again, "sig", "left_anti").withColumn("texts", F.lit(1)).unionByName(prints.join(again, "sig").dropDuplicates(["sig"]))
    flat = single.select("sig", "texts", "total", F.explode_outer("units").alias("u")).select("sig", "texts", "total", "u.*")
    shared = flat.groupBy("unit").agg(F.sum("texts").alias("n"), F.max("trusted").alias("trusted")).where("n > 1 or trusted")
    shared = materialize(shared.select("unit", "trusted"), "residue-units")
    # What is left has only units that stand in several documents or are trusted.
    graph = materialize(flat.drop("trusted", "texts").join(shared, "unit"), "residue-graph")
    formal = outweighed(graph.withColumn("labelled", F.col("trusted")))
    labelled, reached, probed = shared.where("trusted").select("unit"), None, None
    while True:
        labelled = spread_labels(graph, labelled, reached)
        bad = outweighed(_marked(graph, labelled))
        known = materialize(bad if reached is None else bad.union(reached).distinct(), "residue-known")
        fresh = known if probed is None else known.join(probed, "sig", "left_anti")
        near = materialize(near_copies(single, texts, known, fresh), "residue-near")
        if near.isEmpty():
            break
        reached, probed = near if reached is None else near.union(reached), known
    how = F.when(F.col("form"), "form").when(F.col("unit"), "units").otherwise("copy")
    out = known.join(formal.withColumn("form", F.lit(True)), "sig", "left").join(bad.withColumn("unit", F.lit(True)), "sig", "left").select("sig", how.alias("how"))
    # Back from the text that stands for all to every row with the same set.
    return prints.select("id", "sig").join(out, "sig").select("id", "how").distinct()


def _marked(graph: DataFrame, labelled: DataFrame) -> DataFrame:
    return graph.join(labelled.withColumn("labelled", F.lit(True)), "unit", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


def outweighed(marked: DataFrame) -> DataFrame:
    """``(sig)`` of the documents whose labelled units outweigh all others."""
    sums = marked.groupBy("sig").agg(F.first("total").alias("total"), F.sum(F.when(F.col("labelled"), F.col("size")).otherwise(0)).alias("bad"))
    return sums.where("bad * 2 > total").select("sig")


def spread_labels(graph: DataFrame, labelled: DataFrame, reached: DataFrame | None) -> DataFrame:
    """The labelled units with all that take the label from the documents they stand in.

    A document shows residue if its labelled units outweigh what is its own (units of no other document) and make up a
    fifth of it, or if it was reached by a link; it shows content if something is its own; else it tells nothing. A unit takes the label if more of
    its documents show residue than content. Each round is one sum by document and one by unit, both with partial sums.
    """
    while True:
        marked = _marked(graph, labelled)
        docs = marked.groupBy("sig").agg(F.sum(F.when(F.col("labelled"), F.col("size")).otherwise(0)).alias("bad"), F.first("total").alias("total"), (F.first("total") - F.sum("size")).alias("own"), F.max(~F.col("labelled")).alias("open")).where("open")
        if reached is not None:
            docs = docs.join(reached.withColumn("linked", F.lit(True)), "sig", "left")
        else:
            docs = docs.withColumn("linked", F.lit(None).cast("boolean"))
        tells = docs.select("sig", F.when(F.col("linked") | ((F.col("bad") > F.col("own")) & (F.col("bad") * LEAST_SHARE >= F.col("total"))), 1).when(F.col("own") > 0, -1).otherwise(0).alias("tells")).where("tells <> 0")
        votes = marked.where("not labelled").select("unit", "sig").join(tells, "sig").groupBy("unit").agg(F.sum("tells").alias("votes"))
        fresh = materialize(votes.where("votes > 0").select("unit"), "residue-fresh")
        if fresh.isEmpty():
            return labelled
        labelled = labelled.union(fresh)


def near_copies(single: DataFrame, texts: DataFrame, known: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(sig)`` of the texts outside ``known`` that are near-duplicates of a text of ``fresh``."""
    from_ = single.join(fresh, "sig", "left_semi").select(F.col("id").alias("a"), F.explode_outer("keys").alias("key"))
    to = single.join(known, "sig", "left_anti").select(F.col("id").alias("b"), "sig", F.explode_outer("keys").alias("key"))
    pairs = materialize(from_.join(to, "key").select("a", "b", "sig").distinct(), "residue-links")
    return verify(pairs, texts).distinct()


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(sig)`` of the pairs (a, b, sig) whose shingles are similar enough."""
    need = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    body = materialize(texts.join(need, "id", "left_semi").dropDuplicates(["id"]), "residue-texts")
    both = pairs.join(body.toDF("a", "body_a"), "a").join(body.toDF("b", "body_b"), "b")

    def run(rows: Iterable[dict]) -> Iterator[tuple]:
        hinted = _hinted()
        for r in rows:
            x, y = (frozenset(s.tolist()) for s in read([r["body_a"], r["body_b"]], hinted).sets)
            if x and len(x & y) >= SIMILARITY * len(x | y):
                yield (r["sig"],)

    return map_rows(both, run, "sig long")


def records(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body"))


def clean(documents: DataFrame) -> DataFrame:
    """The corpus without its residue, with all columns."""
    bad = found(records(documents)).withColumnRenamed("id", "__residue")
    return documents.join(bad, documents["doc_id"] == bad["__residue"], "left_anti")
