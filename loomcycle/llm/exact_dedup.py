"""Exact deduplication by content-defined chunk recipes, in built-in functions only.

1. Each normalised text is cut at content-defined places (a sentence end after at least `MIN_CHUNK` code
   points, at most `MAX_CHUNK`), and each chunk gets 64 bits of its hash and a SHA-256 mark.
2. All chunks are deduplicated to a table of hashes. A hash whose chunks all have one mark is verified and is
   the identifier of its chunk; of the others, the distinct chunks are numbered by their marks, and hash and
   number together are the identifier.
3. Documents are equal when their ordered identifier lists are equal: the lists are the group key. Texts are
   read once and never shuffled; the digest of the whole text is only carried into the result.

Defined cases: a null text is empty, and all empty texts are equal. A very long text is a longer list. A null
doc_id sorts after all others. Rows that share doc_id and text count as one group; the row read first stays.
An empty table gives an empty result. Further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomcycle.session import cut_lineage

MIN_CHUNK, MAX_CHUNK = 256, 2048
#: A run of white space that isn't already one space.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def chunks(text: Column) -> Column:
    """Content-defined chunks; joined again they are the text."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 2}}}?[.!?] |.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """row_no, doc_id, text_sha256, recipe (identifiers in order) and marks (a digest for each), materialised."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    cut = text.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("parts"))
    short = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - id_bits) if id_bits < 64 else F.xxhash64(c)
    return cut_lineage(
        cut.select(
            F.monotonically_increasing_id().alias("row_no"),
            "doc_id",
            "text_sha256",
            F.transform("parts", short).alias("recipe"),
            F.transform("parts", lambda c: F.unhex(F.sha2(c, 256))).alias("marks"),
        )
    )


def chunk_identifiers(recipe_rows: DataFrame) -> DataFrame:
    """ident, mark, variant: the distinct chunks of those hashes that stand for several, numbered within each."""
    pairs = recipe_rows.select(F.explode(F.arrays_zip("recipe", "marks")).alias("x")).select(F.col("x.recipe").alias("ident"), F.col("x.marks").alias("mark"))
    table = pairs.groupBy("ident").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    doubtful = cut_lineage(table.where("low <> high").select("ident"))
    several = pairs.join(doubtful, "ident", "left_semi").distinct()
    return cut_lineage(several.withColumn("variant", F.row_number().over(W.partitionBy("ident").orderBy("mark"))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = recipes(docs, id_col, text_col, id_bits)
    variants = chunk_identifiers(rows)
    if variants.isEmpty():
        keyed = rows.withColumn("variants", F.lit(None).cast("array<struct<place:int,variant:int>>"))
    else:
        places = rows.select("row_no", F.posexplode(F.arrays_zip("recipe", "marks")).alias("place", "x"))
        met = places.join(variants, (F.col("x.recipe") == F.col("ident")) & (F.col("x.marks") == F.col("mark")))
        numbered = met.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("place", "variant"))).alias("variants"))  # one document's chunks
        keyed = rows.join(numbered, "row_no", "left")
    key = ["recipe", "variants"]
    keyed = keyed.select("row_no", "doc_id", "text_sha256", "recipe", F.coalesce("variants", F.array().cast("array<struct<place:int,variant:int>>")).alias("variants"))
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "row_no"))
    groups = keyed.groupBy(*key).agg(first.alias("first"), F.count("*").alias("group_size"))
    return keyed.join(groups, key).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("first.row_no")).alias("kept"),
        "text_sha256",
    )
