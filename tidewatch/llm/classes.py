"""Classes of equal texts, and components of documents that links between classes make.

Classes are told apart by 64 bits of the texts' SHA-256.  Rows with the same doc_id are one document, whatever their
texts: what one of them links, all are linked with.  A blank row is a class of its document alone.  A row without
doc_id links others as any row does, but gives no name to their component; where nobody has an id, it is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut
from tidewatch.llm.components import components


def text_class(text: Column) -> Column:
    """An even number that equal texts share; a null text is empty."""
    return F.xxhash64(F.sha2(F.coalesce(text, F.lit("")), 256)).bitwiseAND(F.lit(-2).cast("long"))


def with_class(docs: DataFrame) -> DataFrame:
    """doc_id, class and text (not null) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_class(F.col("text")).alias("class"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def class_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text of each class that is wanted (doc_id: the class), with the columns of ``wanted``.

    Copies are put together before they are shuffled, and the join needs no other shuffle.
    """
    return texts.groupBy(F.col("class").alias("doc_id")).agg(F.min("text").alias("text")).join(wanted, "doc_id")


def class_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, class, n, component_id and first (the least class of the component) of rows (doc_id, class, n): joined by links of classes (a, b) and by common ids."""
    own = F.when(F.col("n") > 0, F.col("class")).otherwise(F.xxhash64(F.lit("blank"), "doc_id"))
    rows = rows.select("doc_id", "n", "class", own.alias("node"))
    several = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b <> most").select("doc_id", "b")
    same = rows.join(several, "doc_id").select(F.col("node").alias("a"), "b").distinct()
    found = components(links.select("a", "b").unionByName(same))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = cut(nodes.join(found, nodes["node"] == found["id"], "left").select("node", "least", F.coalesce("component", "node").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("node").alias("first"))
    return rows.join(rooted.join(names, "root").select("node", "component_id", "first"), "node").select("doc_id", "class", "n", "component_id", "first")
