"""Sections to overlapping chunks: the greedy fold, as a higher-order aggregate per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T


def _pack(parts: Column, size: int) -> Column:
    """Join parts with spaces into groups of at most ``size`` words, one too long stays whole."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, part: Column) -> Column:
        words = T.word_count(part)
        full = (acc["n"] > 0) & (acc["n"] + words > size)
        return F.when(full, F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), part.alias("now"), words.alias("n"))).otherwise(
            F.struct(acc["done"].alias("done"), F.when(acc["now"] == "", part).otherwise(F.concat_ws(" ", acc["now"], part)).alias("now"), (acc["n"] + words).alias("n"))
        )

    return F.aggregate(parts, empty, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def segments(paragraphs: Column, size: int) -> Column:
    """Paragraphs of more than ``size`` words are packed from their sentences."""
    return F.flatten(F.transform(paragraphs, lambda p: F.when(T.word_count(p) <= size, F.array(p)).otherwise(_pack(T.sentences(p), size))))


def chunk_texts(paragraphs: Column, size: int, overlap: int) -> Column:
    """The chunks of a section; each next one begins with the last ``overlap`` words of the one
    before (which may carry it beyond ``size``)."""
    overlap = max(0, min(overlap, max(size - 1, 0)))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"), F.lit(False).alias("any"))

    def step(acc: Column, part: Column) -> Column:
        words = T.word_count(part)
        carry = T.tail_words(acc["now"], overlap)
        next_ = F.concat_ws(" ", F.nullif(carry, F.lit("")), part)
        full = acc["any"] & (acc["n"] + words > size)
        return F.when(
            full, F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), next_.alias("now"), (T.word_count(carry) + words).alias("n"), F.lit(True).alias("any"))
        ).otherwise(F.struct(acc["done"].alias("done"), F.when(acc["any"], F.concat_ws(" ", acc["now"], part)).otherwise(part).alias("now"), (acc["n"] + words).alias("n"), F.lit(True).alias("any")))

    all_ = F.aggregate(segments(paragraphs, size), empty, step, lambda acc: F.when(acc["any"], F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
    return F.filter(F.transform(all_, lambda x: F.trim(x)), lambda c: c != "")


def chunk_sections(sections: DataFrame, size: int = 180, overlap: int = 30) -> DataFrame:
    """``sections(section_id, paper_id, text)`` to linked chunks; paragraphs end at line breaks."""
    paragraphs = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda p: p != "")
    rows = sections.where(F.coalesce(F.trim("text"), F.lit("")) != "").select("section_id", "paper_id", F.posexplode(chunk_texts(paragraphs, size, overlap)).alias("ordinal", "text"))
    made = rows.withColumn("chunk_id", F.concat(F.col("section_id"), F.lit("-chunk-"), F.col("ordinal").cast("string")))
    return with_links(made.withColumn("word_count", T.word_count(F.col("text"))).withColumn("salience_score", T.base_salience(F.col("text"))))


def with_links(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("section_id").orderBy("ordinal")
    return chunks.withColumn("prev_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))


def latest(rows: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The last load of each key, of equally late ones the greatest by those of ``ties`` it has (WindowGroupLimit
    keeps one row a key map-side)."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), *[F.desc_nulls_last(t) for t in ties if t in rows.columns])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def chunk_context(chunks: DataFrame) -> DataFrame:
    """Text of the chunk before and after in the whole paper."""
    w = Window.partitionBy("paper_id").orderBy("section_id", "ordinal")
    return chunks.withColumn("previous_text", F.lag("text").over(w)).withColumn("next_text", F.lead("text").over(w))
