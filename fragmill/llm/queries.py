"""Named queries over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.llm import birch, clusters, duplicates, encoding, leakage, mixing, overlap, splits
from fragmill.llm.oracles import ORACLES  # noqa: F401
from fragmill.sources.tables import table

RECORD = ["protac_smiles", "e3_binder_smiles", "poi_ligand_smiles"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = duplicates.copies(table(spark, folder, "curated", ["row_id", *RECORD]), "row_id", RECORD)
    return rows.filter("row <> representative").select(F.col("representative").alias("row_a"), F.col("row").alias("row_b"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.collapse(table(spark, folder, "curated", ["row_id", *RECORD]), "row_id", RECORD)


def _molecules(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "curated", ["row_id", "protac_smiles"]).select(F.col("row_id").alias("rec_id"), F.lit(0).alias("space"), F.col("protac_smiles").alias("value"))
    b = table(spark, folder, "finetuning", ["sample_id", "poi_ligand_smiles_with_direction"]).select(F.col("sample_id").alias("rec_id"), F.lit(1).alias("space"), F.col("poi_ligand_smiles_with_direction").alias("value"))
    return a.union(b)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = clusters.linked(_molecules(spark, folder), "rec_id", "value", "space")
    return rows.select(F.col("id").alias("rec_id"), F.col("cluster").alias("cluster_id"))


def _clusterings(spark: SparkSession, folder: str) -> dict[str, birch.Clustering]:
    return {
        "protac_smiles": birch.Clustering(table(spark, folder, "curated", ["row_id", "protac_smiles"]), "row_id", "protac_smiles"),
        "poi_ligand_smiles_with_direction": birch.Clustering(table(spark, folder, "finetuning", ["sample_id", "poi_ligand_smiles_with_direction"]), "sample_id", "poi_ligand_smiles_with_direction"),
    }


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (c.described().withColumn("field", F.lit(n)) for n, c in _clusterings(spark, folder).items())
    return a.union(b)


def p3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How far the clusters keep together what p3_found groups."""
    groups = p3_found(spark, folder).select(F.col("rec_id").alias("id"), F.col("cluster_id").alias("grp"))
    a, b = (birch.kept_together(groups, c.assigned()).withColumn("field", F.lit(n)) for n, c in _clusterings(spark, folder).items())
    return a.union(b)


def _tuning(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "finetuning", ["sample_id", "text", "labels", "split_name", "source"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.pairs(_tuning(spark, folder), "sample_id", ["text", "labels"], "split_name")


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, field, class_id, links): the class of copies of each row by each field, and how many classes of the
    other side it is linked with."""
    return overlap.classes(_tuning(spark, folder), "sample_id", ["text", "labels"], "split_name")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.report(_tuning(spark, folder), "sample_id", ["text", "labels"], "split_name", "source")


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    curated = table(spark, folder, "curated", ["row_id", "e3_binder_smiles_with_direction", "poi_ligand_smiles_with_direction"])
    tuning = table(spark, folder, "finetuning", ["sample_id", "labels"])
    a = curated.select(F.col("row_id").alias("rec_id"), splits.column_entities({"e3_binder_smiles_with_direction": "e3", "poi_ligand_smiles_with_direction": "poi"}).alias("entities"))
    b = tuning.select(F.col("sample_id").alias("rec_id"), splits.part_entities("labels").alias("entities"))
    return a.union(b)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.groups(_entities(spark, folder)).filter("group_rows > 1").select("rec_id", "group_id")


def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign(_entities(spark, folder), {"train": 0.8, "validation": 0.1, "test": 0.1})


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    return splits.shares(p5_splits(spark, folder))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents", ["doc_id", "text"]), table(spark, folder, "heldout_items", ["item_id", "item_text"]))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).filter("exact_run >= 12").select("doc_id", "item_id")


def p6_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).filter("matched_words >= 12")


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, folder, "documents", ["doc_id", "text", "source"]), table(spark, folder, "mix_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).reached().filter("short").select("source")


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).documents()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).shares()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.repair(table(spark, folder, "documents", ["doc_id", "text", "lang"])).select("doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.repair(table(spark, folder, "documents", ["doc_id", "text", "lang"]))


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p3_found, p3_clusters, p3_quality, p4_found, p4_classes, p4_report, p5_found, p5_splits, p5_shares, p6_found, p6_overlaps, p7_found, p7_mixture, p7_shares, p8_found, p8_restored)}
