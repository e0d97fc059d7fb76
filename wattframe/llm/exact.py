"""Exact de-duplication by salted groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import stored
from .common import texts_of


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Column | None = None
) -> DataFrame:
    """For every row: ``id``, ``text_sha256``, the ``keep_id`` of its class of equal texts, ``group_size``, ``kept``.

    Equal texts are combined in each task first, then in groups of (digest, salt), where the salt
    comes from the row, and the winners of the salts are combined at last.  The text itself is part
    of the key at every stage, so no two texts meet by their digest alone.  Rows find their class by
    digest, where the digest has one class; only if there are digests with several classes do their
    rows find it by digest and text.

    The row with the largest id stays; a null id loses to any other.  Rows equal in id and text count
    each, and all of them carry ``kept`` if their id does.  A null text counts as empty.  ``digest``
    replaces the SHA-256 that groups texts (a test makes it collide); ``text_sha256`` remains.
    """
    rows = texts_of(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("text"), 256)))
    rows = rows.withColumn("digest", F.col("sha") if digest is None else digest.cast("binary"))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        .groupBy("digest", "salt", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    )
    classes = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    digests = stored(classes.groupBy("digest").agg(
        F.count("*").alias("classes"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")
    ), "exact-digests")
    columns = ["id", "sha", "keep_id", "group_size"]
    found = rows.select("id", "sha", "digest").join(digests.where("classes = 1"), "digest").select(columns)
    collided = digests.where("classes > 1").select("digest")
    if not collided.isEmpty():
        texts = classes.join(collided, "digest", "left_semi").withColumnRenamed("n", "group_size")
        found = found.union(rows.join(collided, "digest", "left_semi").join(texts, ["digest", "text"]).select(columns))
    return found.select(
        "id", F.lower(F.hex("sha")).alias("text_sha256"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` (any columns that can be ordered) that stay: of each class of equal texts the one with the largest id.

    The same salted combining as above, with the winner's other columns carried along, so texts are
    shuffled for the two stages and no more.  Of rows equal in id and text the greatest in the other columns
    stays.  Null and empty texts are one class; the row that stays keeps its own.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    fields = [F.col(id_col).alias("id"), F.col(text_col).isNotNull().alias("given")]
    row = F.struct(*fields, *(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), row.alias("row"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("row.id"), F.lit(salts)).alias("salt"), "text").agg(F.max("row").alias("row"))
    classes = salted.groupBy("digest", "text").agg(F.max("row").alias("row"))
    back = {
        id_col: F.col("row.id"), text_col: F.when(F.col("row.given"), F.col("text")),
        **{c: F.col(f"row.c{i}") for i, c in enumerate(others)},
    }
    return classes.select(*(back[c].alias(c) for c in docs.columns))
