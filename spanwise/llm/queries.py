"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm import bpe, glyphs, langid, packing, readability
from spanwise.session import materialize, table

VOCABULARY = "byte_bpe_50k"


# 1. languages


def _caption_labels(spark: SparkSession, d: str, names: dict[str, str]) -> DataFrame:
    return table(spark, d, "caption_docs").filter("caption_id IS NOT NULL").groupBy("caption_id", "video_id", "track").agg(F.min(langid.label_code(F.col("lang"), names)).alias("label"))


def _document_languages(spark: SparkSession, d: str, languages: langid.LanguageFilter, names: dict[str, str]) -> DataFrame:
    docs = table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", langid.label_code(F.col("lang"), names).alias("label"), "text")
    return langid.judged(docs, ["doc_id", "label"], "text", languages, markup=True).filter("lang IS NOT NULL")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    languages = langid.fit(table(spark, d, "lang_samples"))
    names = langid.spellings(spark, languages.langs)
    cues, captions = langid.cue_languages(table(spark, d, "caption_cues"), languages)
    wrong = "NOT (label <=> lang)"
    case = lambda df, kind, item: df.select(F.lit(kind).alias("kind"), item.cast("string").alias("item_id"), "lang").distinct()
    labelled = _caption_labels(spark, d, names).join(captions.drop("confidence"), "caption_id")
    videos = table(spark, d, "videos").filter("video_id IS NOT NULL").groupBy("video_id").agg(F.min(langid.label_code(F.col("language"), names)).alias("label"))
    of_video = videos.join(labelled.filter("track = 'original'").select("video_id", "lang"), "video_id").filter(wrong)
    out = case(labelled.filter(wrong), "caption", F.col("caption_id"))
    out = out.unionByName(case(of_video, "video", F.col("video_id")))
    out = out.unionByName(case(_document_languages(spark, d, languages, names).filter(wrong), "document", F.col("doc_id")))
    return out.unionByName(case(langid.foreign_cues(cues, captions, languages), "segment", F.concat_ws(":", "caption_id", "cue_idx")))


def _video_languages(videos: DataFrame, labels: DataFrame, captions: DataFrame) -> DataFrame:
    """(video_id, lang, confidence) of each video with an original caption document: that of the surest one."""
    spoken = labels.filter("track = 'original'").join(captions, "caption_id").groupBy("video_id")
    best = spoken.agg(F.min(F.struct(F.negative("confidence").alias("order"), "lang", "confidence")).alias("best"))
    return videos.filter("video_id IS NOT NULL").select("video_id").distinct().join(best, "video_id").select("video_id", "best.lang", "best.confidence")


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    languages = langid.fit(table(spark, d, "lang_samples"))
    cues, captions = langid.cue_languages(table(spark, d, "caption_cues"), languages)
    row = lambda df, kind, item: df.select(F.lit(kind).alias("kind"), item.cast("string").alias("item_id"), "lang", F.round("confidence", 4).alias("confidence"))
    out = row(captions, "caption", F.col("caption_id"))
    names = langid.spellings(spark, languages.langs)
    out = out.unionByName(row(_video_languages(table(spark, d, "videos"), _caption_labels(spark, d, names), captions), "video", F.col("video_id")))
    out = out.unionByName(row(_document_languages(spark, d, languages, names), "document", F.col("doc_id")))
    return out.unionByName(row(langid.foreign_cues(cues, captions, languages), "segment", F.concat_ws(":", "caption_id", "cue_idx")))


# 2. look-alike text


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.look_alikes(table(spark, d, "caption_cues"), "caption_id", "cue_idx", "text")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.look_classes(table(spark, d, "caption_cues"), "caption_id", "cue_idx", "text")


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    cues = table(spark, d, "caption_cues").select("caption_id", "cue_idx", "text").distinct()
    return glyphs.with_form(cues, "text", "form").select("caption_id", "cue_idx", "form")


# 6. token ids


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text", bpe.vocabulary(spark, VOCABULARY))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.count_tokens(table(spark, d, "documents"), "doc_id", "text", bpe.vocabulary(spark, VOCABULARY))


# 7. packing


def _packed(spark: SparkSession, d: str, targets: DataFrame) -> DataFrame:
    """The packing of all articles; their sizes, a few bytes each, are worked out once and kept."""
    docs = table(spark, d, "documents").filter("doc_id IS NOT NULL")
    sizes = materialize(bpe.count_tokens(docs, "doc_id", "text", bpe.vocabulary(spark, VOCABULARY)))
    blocks = max(1, math.ceil(sizes.count() / packing.BLOCK_ITEMS))
    items = sizes.select("doc_id", F.col("n_tokens").alias("size"), F.lit(VOCABULARY).alias("tokenizer"))
    return packing.pack(items, targets, "doc_id", blocks)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles that lie in more than one container of 8,192 tokens of the packing."""
    placed = _packed(spark, d, table(spark, d, "pack_targets")).filter("capacity = 8192").select("doc_id", "container").distinct()
    return placed.groupBy("doc_id").agg(F.count("*").alias("containers")).filter("containers > 1").select("doc_id")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, table(spark, d, "pack_targets")).select("target_id", "container", "doc_id", "piece", "size")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    per = _packed(spark, d, table(spark, d, "pack_targets")).groupBy("target_id", "capacity", "container").agg(F.sum("size").alias("filled"))
    return per.groupBy("target_id", "capacity").agg(F.count("*").alias("containers"), F.sum("filled").alias("tokens"), F.max("filled").alias("fullest"), F.sum(F.when(F.col("filled") == F.col("capacity"), 1).otherwise(0)).alias("full"))


# 8. reading level


def _graded(spark: SparkSession, d: str) -> DataFrame:
    graded = langid.bounded(table(spark, d, "graded_samples"), ["lang", "band"], readability.MAX_SAMPLES)
    samples = [(r["lang"], r["band"], t) for r in graded for t in r["texts"]]
    grader = spark.sparkContext.broadcast(readability.Grader(langid.fit(table(spark, d, "lang_samples")), samples))
    docs = table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("band", T.StringType()), T.StructField("lang", T.StringType()), *(T.StructField(f"n_{b}", T.LongType()) for b in readability.BANDS), T.StructField("grade", T.DoubleType())])

    def run(batches):  # noqa: ANN001, ANN202
        own = grader.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = own.judge(part.column(1).to_pylist())
                counts = [pa.array([r[2][k] for r in rows], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), *counts, pa.array([r[3] for r in rows], pa.float64())], names=schema.fieldNames())

    return docs.mapInArrow(run, schema).filter("band IS NOT NULL")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).select("doc_id", "band")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).withColumn("grade", F.round("grade", 3))


QUERIES = {f.__name__: f for f in (p1_found, p1_languages, p2_found, p2_classes, p2_forms, p6_ids, p6_counts, p7_found, p7_packing, p7_fill, p8_found, p8_levels)}
ORACLES: dict[str, str] = {}
