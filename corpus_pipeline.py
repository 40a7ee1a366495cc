"""Documents to token ids: language ID, near-duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns documents that are left, with the columns of documents; the last
returns their token ids. Between stages documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import langid, mixing, nearcopies, pieces, suffixes
from siftlake.llm.common import stage as written


def _packed(docs: DataFrame, *plain: str) -> tuple[DataFrame, str]:
    """docs as the named columns and one struct of all columns but text, so that no name clashes with an operator's own."""
    name = "row_of_docs"
    return docs.select(*plain, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias(name)), name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter (null and empty texts too) go. Learns from the labels of docs itself.

    Equal texts have equal fates, rows that repeat stay as often as they are, texts of any length are read whole, an
    empty table stays empty, and columns of any name pass through.
    """
    packed, row = _packed(docs, "doc_id", "text", "lang")
    kept = langid.identify(packed, ("text", row)).where("lang_pred <> 'und'")
    return kept.select(*(F.col("text") if c == "text" else F.col(f"{row}.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a 5-word similarity of 0.8 or more, that of the smallest doc_id.

    Null and empty texts are one group. Ids that tie are told apart by the text's hash, rows alike in both are one; null
    ids come last. Texts are compared whole. Columns of any name pass through; an empty table stays empty.
    """
    return nearcopies.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur again; documents of which no word is left go. n_chars follows.

    Null and empty texts stay and are empty. Rows that repeat are copies of each other and lose all. Columns of any name
    pass through; an empty table stays empty.
    """
    packed, row = _packed(docs, "doc_id", "text")
    found = suffixes.remove_repeats(packed, (row,), as_text=True)
    left = found.where(F.col("kept").rlike("[^\\x20\\x09-\\x0D]") | (F.col("n_removed") == 0))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[new.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document occurs as often as the sample takes it.

    Documents without words (null and empty texts) go. Rows that repeat id, source and text are drawn alike. Columns of
    any name pass through; an empty table stays empty.
    """
    packed, row = _packed(docs, "doc_id", "source", "text")
    taken = mixing.mix(packed.drop(row)).where("copies > 0").select("doc_id", "source", "text_key", "copies").distinct()
    on = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.md5(F.coalesce("d.text", F.lit(""))) == F.col("t.text_key"))
    copies = packed.alias("d").join(taken.alias("t"), on).select("d.text", f"d.{row}", F.explode(F.array_repeat(F.lit(0), F.col("t.copies").cast("int"))).alias("copy"))
    return copies.select(*(F.col("text") if c == "text" else F.col(f"{row}.`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces and ids of every document; whole: the ids decode to the text. A row per row.

    Null and empty texts have no ids and are whole. Other columns are not read; an empty table gives no rows.
    """
    path = pieces.model_path()
    rows = docs.select("doc_id", "source", "text", F.sha2(F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" ")), 256).alias("sha"))
    back = pieces.decode(pieces.encode(rows, path, ("doc_id", "source", "sha")), path, ("doc_id", "source", "sha", "ids"))
    return back.select("doc_id", "source", F.size("ids").alias("n_pieces"), "ids", (F.sha2("text", 256) == F.col("sha")).alias("whole"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = written(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
