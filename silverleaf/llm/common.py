"""What the text operators share: reading tables, folds by id, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpoint

#: The ASCII white space that separates words in every contract here.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold that a row belongs to (null id: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def fold_is(column: str, modulus: int, remainder: int) -> Column:
    """Whether a row is in the fold; false for a null id."""
    return F.coalesce(id_bucket(column, modulus) == remainder, F.lit(False))


def bounded_sample(rows: DataFrame, per_group: int, group: str, key: list[str], seed: int) -> DataFrame:
    """At most about per_group rows of each group, chosen by a hash of the key.

    The share that a group keeps is set from its row count, so what is kept has a
    bounded expectation at every size of the input (and all of it when it is small).
    The choice depends on key and seed alone, never on the partitioning; with a key that
    tells all distinct rows apart no single id can bring in many. Groups are the values
    of a label, whose counts come to the driver; a null group is left out.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    unit = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, n in counts.items():
        if value is not None:
            keep = keep | ((F.col(group) == F.lit(value)) & (unit < min(1.0, per_group / max(1, n))))
    return rows.filter(keep)


def labelled_rows(docs: DataFrame, known: DataFrame, label: str, per_label: int, seed: int) -> DataFrame:
    """(doc_id, text, label): at most about per_label rows of each label, whole texts.

    known has distinct (doc_id, label). Ids are drawn first, as they are small, and then
    the distinct rows of docs with these ids, so an id that is repeated with many texts
    counts with each of them. Null texts and ids are left out; an empty table gives none.
    """
    chosen = bounded_sample(known, per_label, label, ["doc_id"], seed)
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", label).distinct()
    return bounded_sample(checkpoint(rows), per_label, label, ["doc_id", "text"], seed + 1)
