"""Metadata and result documents as JSON: schemas, scans, sinks, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import fraction

#: Fields of the documents, in the order of their files.
VIDEO = """video_id string, protocol_version string, files struct<raw: string, processed: string>,
runner struct<id: string, height_cm: double>, footwear struct<category: string, model: string>,
capture struct<fps: double, width: int, height: int, date: string>, quality struct<usable: boolean, notes: string>"""
RUNNERS = """runners array<struct<id: string, name: string, height_cm: double, stratum: string, sex: string, age: int, specialist_event: string,
personal_bests: map<string, string>, consent_signed: boolean>>"""
PROBE = "format struct<tags: struct<creation_time: string>>, streams array<struct<tags: struct<creation_time: string>, width: int, height: int, avg_frame_rate: string>>"


def load_documents(spark: SparkSession, path: str, schema: str = VIDEO) -> DataFrame:
    """A folder of JSON documents; what does not fit the schema is kept beside."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True).withColumn("_file", F.input_file_name())


def save_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def store(docs: DataFrame, key: str = "video_id") -> DataFrame:
    """One document for each id: of duplicates, that of the last file by name."""
    fields = F.struct(*(c for c in docs.columns if c != "_file"))
    return docs.groupBy(key).agg(F.max_by(fields, "_file").alias("d")).select("d.*")


def lookup(wanted: DataFrame, docs: DataFrame, key: str = "video_id") -> DataFrame:
    """A wanted id without a document is an error."""
    found = wanted.join(docs.withColumn("found_", F.lit(True)), key, "left")
    return found.where(F.coalesce("found_", F.raise_error(F.concat(F.lit("no document: "), F.col(key).cast("string"))).cast("boolean"))).drop("found_")


def runners(text: Column) -> Column:
    """Array of runners of a runner document."""
    return F.from_json(text, RUNNERS)["runners"]


def valid_runner(r: Column) -> Column:
    return r["stratum"].rlike("^[ABC]$") & r["sex"].rlike("^[MF]$")


def runner_info(r: Column) -> Column:
    """What a video's document keeps of a runner."""
    return F.struct(r["id"].alias("id"), r["height_cm"].alias("height_cm"), r["stratum"].alias("stratum"), r["specialist_event"].alias("specialist_event"))


def sorted_ids(docs: DataFrame, key: str = "video_id") -> DataFrame:
    """Every id once, in order."""
    return docs.select(key).distinct().orderBy(key)


def probed(text: Column) -> Column:
    """Struct of creation_time, width, height, fps of a probe document; NULL for what is missing, empty, zero or no document."""
    p = F.from_json(text, PROBE)
    stream = F.get(p["streams"], 0)
    fps = fraction(stream["avg_frame_rate"])
    fields = {"creation_time": creation_time(text), "width": stream["width"], "height": stream["height"], "fps": F.when(fps != 0, fps)}
    return F.named_struct(*(x for k, v in fields.items() for x in (F.lit(k), v)))


def creation_time(text: Column) -> Column:
    """The container's tag first, then the first stream's."""
    p = F.from_json(text, PROBE)
    return F.coalesce(F.nullif(p["format"]["tags"]["creation_time"], F.lit("")), F.nullif(F.get(p["streams"], 0)["tags"]["creation_time"], F.lit("")))


def stem(path: Column) -> Column:
    """File name without folder, extension, and the mark of a converted file."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", ""), "_cfr$", "")


def resolve(clips: DataFrame, docs: DataFrame, strict: bool = False) -> DataFrame:
    """clips: clip, explicit_height, path, given_height. Height of an explicit document, else of the store's, else as given; source says which.

    A clip without any is marked error; with strict it is an error."""
    d = docs.select(F.col("video_id").alias("stem_"), F.col("runner.height_cm").alias("stored"))
    out = clips.withColumn("stem_", stem(F.col("path"))).join(d, "stem_", "left")
    source = F.when(F.col("explicit_height").isNotNull(), "explicit").when(F.col("stored").isNotNull(), "store").when(F.col("given_height").isNotNull(), "stub").otherwise("error")
    if strict:
        source = F.when(source == "error", F.raise_error(F.concat(F.lit("no metadata for clip "), F.col("clip").cast("string"))).cast("string")).otherwise(source)
    return out.select("clip", F.coalesce("explicit_height", "stored", "given_height").alias("height_cm"), source.alias("source"))


#: Fields of a result document, in the order of its file.
RESULT = """version string, timestamp string,
input struct<video_path: string, video_id: string, runner_height_cm: double, shoe_sole_cm: double, fps: double, duration_seconds: double>,
calibration struct<method: string, confidence: double, pixels_per_cm: double, segments_px: map<string, double>, segments_proportions: map<string, double>, proportion_warnings: array<string>, leg_length_cm: double>,
metrics struct<temporal: struct<cadence_spm: double, cadence_std: double, gct_ms: double, gct_std: double, flight_time_ms: double, duty_factor: double>,
  spatial_absolute: struct<stride_length_m: double, stride_length_std: double, step_length_m: double, oscillation_cm: double, leg_length_cm: double>,
  spatial_normalised: struct<stride_leg_ratio: double, oscillation_leg_ratio: double>, efficiency: struct<running_economy_index: double, flight_ratio: double>,
  derived: struct<velocity_ms: double, velocity_kmh: double, pace_per_km: string>>,
quality struct<detection_rate: double, mean_hip_visibility: double, n_contacts: int, n_refined_contacts: int, metric_warnings: array<string>, overall_score: double>"""


def result_documents(results: DataFrame) -> DataFrame:
    """clip_id, doc: the whole result of each clip as a JSON document of RESULT.

    results: the fields of RESULT by their own names as columns (stride_sd, cadence_sd and gct_sd for the
    deviations; hip_vis, warnings and score for the quality); what is missing is left out of the document."""
    named = {"cadence_std": "cadence_sd", "gct_std": "gct_sd", "stride_length_std": "stride_sd", "mean_hip_visibility": "hip_vis", "metric_warnings": "warnings", "overall_score": "score", "confidence": "calibration_confidence"}
    fixed = {"version": F.lit("1.0"), "method": F.lit("direct")}

    def build(kind, name: str) -> Column:
        if isinstance(kind, StructType):
            return F.struct(*(build(f.dataType, f.name).alias(f.name) for f in kind))
        column = named.get(name, name)
        return fixed.get(name, F.col(column).cast(kind) if column in results.columns else F.lit(None).cast(kind))

    return results.select("clip_id", F.to_json(build(_parse(RESULT), "")).alias("doc"))


def _parse(fields: str) -> StructType:
    return StructType.fromDDL(fields)


def read_results(docs: DataFrame, col: str = "doc") -> DataFrame:
    """The fields of result documents as columns of RESULT; other columns stay. A text that is no document gives NULLs."""
    return docs.withColumn("r_", F.from_json(col, RESULT)).select(*(c for c in docs.columns if c != col), "r_.*")


def save_results(results: DataFrame, path: str) -> None:
    """One JSON line a clip."""
    result_documents(results).select(F.col("doc").alias("value")).write.mode("overwrite").text(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path)
