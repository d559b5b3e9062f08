"""Column functions on text: tokens, slugs, tags, cleaning. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that are no keywords.
EN_STOPWORDS = ("the", "and", "for", "with", "from", "this", "that", "are", "was", "were", "but", "not", "you", "your", "our", "all", "any", "can", "has", "have", "had", "one", "two", "may", "use", "used", "via", "of", "in", "on", "at", "to", "is", "it", "by", "as", "or", "an", "be", "if", "we", "do")
#: Chinese words that are no keywords.
ZH_STOPWORDS = ("的", "了", "和", "是", "在", "我", "有", "与", "也", "就", "都", "而", "及", "等", "着", "或", "一个", "没有", "我们", "你们", "他们", "这", "那", "为", "以", "从", "到", "把", "被", "对", "于", "上", "下", "中")
#: A token is a Latin run or a run of Han characters; a word of the Chinese channel keeps its joints.
WORD = "[A-Za-z0-9]+|[一-鿿]+"
LATIN = "[A-Za-z0-9]+"
ZH_REST = "[A-Za-z][A-Za-z0-9]++(?:[-_.][A-Za-z0-9]++)*+|[0-9]++|(?<![一-鿿])[一-鿿](?![一-鿿])|[^ \t\r\n\f\v一-鿿]"
MD_IMAGE = r"!\[[^\]]*\]\([^)]+\)"


def _all(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def tokens(col: Column) -> Column:
    """Latin and Han runs, case kept; an empty array for null."""
    return _all(col, WORD)


def bm25_tokens(col: Column) -> Column:
    """Lower-cased Latin runs."""
    return F.transform(_all(col, LATIN), F.lower)


def zh_tokens(col: Column) -> Column:
    """Tokens of the Chinese channel: Latin words in lower case, numbers, Han runs as character pairs, other signs alone.

    A bag of tokens: the pairs come first, then the rest in order. A look-ahead gives overlapping pairs in one pass. What is
    longer than one sign is a word or a number, so its case goes without another match.
    """
    rest = F.transform(_all(col, ZH_REST), lambda t: F.when(F.length(t) > 1, F.lower(t)).otherwise(t))
    return F.concat(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit("(?=([一-鿿]{2}))"), F.lit(1)), rest)


def term_index(col: Column) -> Column:
    """The first eight bytes of the SHA-1 of a term as an unsigned number."""
    return F.conv(F.substring(F.sha1(col), 1, 16), 16, 10).cast("decimal(20,0)")


def approx_tokens(col: Column) -> Column:
    """Characters by 3.5, at least 1."""
    return F.greatest(F.lit(1), F.round(F.length(col) / F.lit(3.5)).cast("int"))


def strip_images(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), MD_IMAGE, " ")


def keyword_footer(text: Column, keywords: Column) -> Column:
    return F.when(F.size(keywords) > 0, F.concat(text, F.lit("\n\n关键词: "), F.array_join(keywords, " "))).otherwise(text)


def split_tags(col: Column) -> Column:
    """Tags of a delimited string: trimmed, without blanks, the first of equal ones."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), "[,，;；\n]+"), lambda x: F.trim(x)), lambda x: x != ""))


def clean_list(col: Column, most: int = 12) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))), 1, most)


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def slugify(col: Column, most: int = 80) -> Column:
    """A stem for file names: control signs and what paths cannot hold become one underscore each run."""
    plain = F.regexp_replace(F.trim(col), r"[\x00-\x1f\x7f]", "")
    return F.substring(F.trim(F.regexp_replace(plain, r"[\s/\\:*?\"<>|]+", "_")), 1, most)


def fold(col: Column) -> Column:
    """Lower case with the sharp s written out."""
    return F.regexp_replace(F.lower(col), "ß", "ss")


def strip_hash(col: Column) -> Column:
    """Without one trailing hash of eight digits."""
    return F.regexp_replace(col, "_[0-9a-f]{8}$", "")


def strip_hashes(col: Column) -> Column:
    """Without all trailing hashes."""
    return F.regexp_replace(col, "(_[0-9a-f]{8})+$", "")


def slug(col: Column) -> Column:
    """The form in which ids are compared by the metrics."""
    return F.regexp_replace(F.regexp_replace(fold(strip_hashes(F.coalesce(col, F.lit("")))), r"[\s\-_]+", "-"), "^-+|-+$", "")


def strip_think(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, "(?s)<think>.*?</think>", ""))


def scrub_error(col: Column, most: int = 240) -> Column:
    """The first line of a message without URLs, hosts and ports; a longer one ends in an ellipsis, an empty one says so."""
    line = F.regexp_replace(F.coalesce(col, F.lit("")), r"https?://[^ \t\"')]+", "<url>")
    line = F.regexp_replace(line, r"host=['\"]?[A-Za-z0-9_.-]+['\"]?", "host=<host>")
    line = F.regexp_replace(line, r"\b[A-Za-z0-9.-]+:[0-9]{2,5}\b", "<host>:<port>")
    line = F.regexp_replace(F.regexp_extract(line, r"^[^\n\r]*", 0), r"[\x00-\x08\x0a-\x1f]", "")
    line = F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)
    return F.when(line == "", "Error: <no message>").otherwise(line)


def as_bool(col: Column, default: bool = False) -> Column:
    return F.when(col.isNull(), F.lit(default)).otherwise(F.lower(F.trim(col)).isin("1", "true", "yes", "y", "on"))


def default_title(stem: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(stem, "[_-]+", " ")))


def last_sentences(col: Column, n: int = 2, most: int = 200) -> Column:
    """The last ``n`` sentences, at most ``most`` characters from the end."""
    parts = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), "[。！？.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    text = F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), F.lit(n)), ". ")
    return F.right(text, F.lit(most))


def insecure_url(col: Column) -> Column:
    """Plain http to a host that is not this machine."""
    return (F.lower(F.regexp_extract(col, "^([A-Za-z]+)://", 1)) == "http") & ~F.regexp_extract(col, "^[A-Za-z]+://([^/:?#]+)", 1).isin("localhost", "127.0.0.1", "::1", "")


def safe_path(col: Column) -> Column:
    """Whether a path stays below its folder: relative, without drive, back slash, NUL, blank name or a step upwards."""
    path = F.coalesce(col, F.lit(""))
    return (F.trim(path) != "") & ~path.rlike(r"^/|\\|\x00|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)")


def clean_options(col: Column, allowed: dict[str, tuple[str, ...]]) -> Column:
    """The entries of a map of options whose key is known and whose value, trimmed and in lower case, is allowed."""
    plain = F.transform_values(F.coalesce(col, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(F.trim(v)))
    test = lambda k, v: F.lit(False)
    for name, values in allowed.items():
        test = lambda k, v, before=test, name=name, values=values: before(k, v) | ((k == name) & v.isin(*values))
    return F.map_filter(plain, lambda k, v: F.coalesce(test(k, v), F.lit(False)))
