"""Registered queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillhouse.llm import encoding_repair, near_duplicates, packing, pair_defects, scan_repair, split_overlap, leak_search, vector_neighbours
from stillhouse.llm.sql import SQL  # noqa: F401  (the driver's equivalents)
from stillhouse.sources.tables import table

_NEAR = near_duplicates.NearParams(width=3, similarity=0.45)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and questions in one table, their kind in front of the id."""
    chunks = table(spark, d, "document_chunks").select(F.concat(F.lit("chunk:"), "chunk_id").alias("id"), "text", F.lit("chunk").alias("part"))
    return chunks.unionByName(table(spark, d, "qa_benchmark").select(F.concat(F.lit("question:"), "id").alias("id"), F.col("question").alias("text"), F.lit("question").alias("part")))


def _kind_and_id(c: str) -> list:
    return [F.substring_index(c, ":", 1), F.expr(f"substring({c}, instr({c}, ':') + 1)")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.near_pairs(_records(spark, d), _NEAR)
    (ka, a), (_, b) = _kind_and_id("id_a"), _kind_and_id("id_b")
    return pairs.select(ka.alias("record_kind"), a.alias("id_a"), b.alias("id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_groups(_records(spark, d), _NEAR)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return vector_neighbours.dense_vectors(table(spark, d, "sample_profiles"), "profile_id", "features")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = vector_neighbours.all_neighbours(_vectors(spark, d), k=5, radius=2.0)
    return near.select(F.least("id", "neighbour").alias("profile_id_a"), F.greatest("id", "neighbour").alias("profile_id_b")).distinct()


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest without a radius, for the stated query set: ids divisible by 50, against all rows."""
    v = _vectors(spark, d)
    return vector_neighbours.neighbours_of(v.filter("id % 50 = 0"), v, k=5).withColumn("distance", F.round("distance", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.split_pairs(split_overlap.split_groups(table(spark, d, "manifest"))[0])


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.split_report(split_overlap.split_groups(table(spark, d, "manifest"))[0])


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.group_rows(split_overlap.split_groups(table(spark, d, "manifest"))[0])


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Every verified pair of folded ids within one edit, and whether both name the same sample or only look alike."""
    return split_overlap.split_groups(table(spark, d, "manifest"))[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.defects(table(spark, d, "qa_benchmark")).select("id", "defect")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Defects by source of the pair."""
    qa = table(spark, d, "qa_benchmark")
    found = pair_defects.defects(qa)
    return qa.select("id", "source").distinct().join(found, "id").groupBy("source", "defect").agg(F.count("*").alias("pairs"))


def _pages_and_chunks(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.records_of(table(spark, d, "loaded_documents"), table(spark, d, "document_chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.noise_of(_pages_and_chunks(spark, d))[0]


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.clean_paragraphs(_pages_and_chunks(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak_search.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_matches(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p9_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the documents that stay when those with a leaked passage are removed."""
    return table(spark, d, "documents").select("doc_id").join(_leaks(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents that it leaked into."""
    hits = _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))
    items = table(spark, d, "eval_items").select("item_id", "suite").distinct()
    return items.join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"), F.coalesce("longest", F.lit(0)).cast("int").alias("longest"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.repaired(table(spark, d, "documents"), changed_only=True).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.repaired(table(spark, d, "documents"), changed_only=True)


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_groups, p4_found, p4_nearest, p5_found, p5_report, p5_groups, p5_links, p6_found, p6_report, p7_found, p7_clean, p8_containers,
        p9_found, p9_matches, p9_clean_documents, p9_items, p10_found, p10_restored,
    )
}