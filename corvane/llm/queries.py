"""The queries of this package, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import history, langid, neardup, packing, residue, scanrepair, splitting, tokenize
from corvane.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "parsed_chunks"), table(spark, d, "asset_index_log"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each chunk with its class and number of links, at the usual 0.8 on five words.

    A null, empty or short chunk is a class of its own without links.
    """
    chunks = table(spark, d, "parsed_chunks")
    pairs, members = neardup.verified_pairs(neardup.chunk_records(chunks), neardup.Likeness(least_tokens=5), "p1-groups")
    return neardup.every_class(chunks.select(F.col("chunk_id").alias("id")), neardup.classes(pairs, members))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(table(spark, d, "parsed_chunks"), table(spark, d, "ir_blocks"), table(spark, d, "split_limits"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.all_pieces(table(spark, d, "parsed_chunks"), table(spark, d, "ir_blocks"), table(spark, d, "split_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scanrepair.found(table(spark, d, "parsed_chunks"), table(spark, d, "ir_blocks"), table(spark, d, "asset_index_log"))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The texts with scan noise, repaired."""
    chunks = table(spark, d, "parsed_chunks")
    return scanrepair.repair(scanrepair.records(chunks, table(spark, d, "ir_blocks")), scanrepair.all_titles(chunks, table(spark, d, "asset_index_log")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.found(table(spark, d, "asset_index_log"), table(spark, d, "task_records"))


def p4_typing(spark: SparkSession, d: str) -> DataFrame:
    """Titles of assets (lower case, single blanks) that differ by one or two edits, from the segment index."""
    plain = F.trim(F.regexp_replace(F.lower("asset_title"), r"\s+", " "))
    titles = table(spark, d, "asset_index_log").select(plain.alias("name")).distinct()
    return history.lookup(titles, titles, tau=2).where("probe < name").select("probe", "name", "distance")


def _p5_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, d, n) for n in ("parsed_chunks", "preprocessed_queries", "documents", "lang_samples"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.found(*_p5_tables(spark, d), residue.found(residue.records(table(spark, d, "documents"))))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    """The language of every record with its confidence, and what its label named."""
    return langid.labels(*_p5_tables(spark, d))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments of mixed records, each with its language and confidence."""
    chunks, queries_, documents, samples = _p5_tables(spark, d)
    model, rows = langid.fit(samples), langid.records(chunks, queries_, documents)
    mixed = langid.detect(rows, model).where("mixed").select("kind", "rec_id").distinct()
    return langid.segments(rows.join(mixed, ["kind", "rec_id"], "left_semi"), model)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids differ from their text: there are none."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    back = tokenize.decode(tokenize.token_ids(docs, text_col="body"))
    return back.join(docs, "doc_id").where("text <> body").select("doc_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokenize.token_counts(table(spark, d, "documents")), table(spark, d, "pack_capacities"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(residue.records(table(spark, d, "documents"))).select(F.col("id").alias("doc_id"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without its residue."""
    return residue.clean(table(spark, d, "documents")).select("doc_id", "text", "lang", "source", "n_chars")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_pieces, p3_found, p3_repaired, p4_found, p4_typing, p5_found, p5_labels, p5_segments, p6_ids, p6_roundtrip, p7_containers, p8_found, p8_clean)}


def oracle_sql() -> dict[str, str]:
    from corvane.llm.sql import SQL

    return dict(SQL)
