"""Videos from their frames: maxima, unsafe share, longest unsafe run, merge with the transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.operators.decision import CASCADE_KEYS

RISKS = ("adult_score", "violence_self_harm_score", "weapon_score", "blood_score", "child_safety_score")
UNSAFE = 0.55


def frame_risk() -> Column:
    return F.greatest(*[F.col(k) for k in RISKS])


def longest_run(frames: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """(key, longest_run): most frames in a row for which the flag holds, 0 if none."""
    flagged = frames.select(key, order, flag.alias("__on"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    among = F.row_number().over(Window.partitionBy(key, "__on").orderBy(order))
    runs = flagged.withColumn("__island", place - among).groupBy(key, "__island", "__on").agg(F.count("*").alias("__n"))
    return runs.groupBy(key).agg(F.max(F.when(F.col("__on"), F.col("__n")).otherwise(0)).alias("longest_run"))


def score_columns(frames: DataFrame, key: str, order: str) -> list[str]:
    """The columns of numbers beside the key and the order: whatever a frame was scored for."""
    return [f.name for f in frames.schema if f.name not in (key, order) and isinstance(f.dataType, T.NumericType)]


def summarise(frames: DataFrame, key: str = "video", order: str = "frame") -> DataFrame:
    """One row a video: the maximum of every score of its frames (0 at least; null and what is no number count as 0), frames,
    unsafe frames and share, longest unsafe run."""
    scores = score_columns(frames, key, order)
    frames = frames.withColumns({k: F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col(k).cast("double"), F.lit(0.0)), F.lit(0.0))) for k in scores})
    unsafe = frame_risk() >= UNSAFE
    totals = frames.groupBy(key).agg(
        *[F.max(k).alias(k) for k in scores],
        F.count("*").alias("n_frames"),
        F.sum(unsafe.cast("long")).alias("n_unsafe"),
    )
    runs = longest_run(frames, key, order, unsafe).withColumnRenamed(key, "__key")
    return (
        totals.join(runs, F.col(key) == F.col("__key"))
        .drop("__key")
        .withColumn("unsafe_ratio", F.col("n_unsafe") / F.col("n_frames"))
    )


def merge_transcript(videos: DataFrame, transcripts: DataFrame, key: str = "video") -> DataFrame:
    """The larger of frame and transcript score for every score that the cascade reads or either side has, 0 where neither has it.

    The explicit score is the adult one, the unsafe share and run are those of the frames, and the ensemble is
    1.5 times the unsafe share at least.
    """
    spoken = transcripts.select(F.col(key).alias("__key"), *[F.col(c).alias(f"t_{c}") for c in transcripts.columns if c != key])
    joined = videos.join(spoken, F.col(key) == F.col("__key"), "left")
    there = set(joined.columns)

    def larger(k: str) -> Column:
        parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (k, f"t_{k}") if c in there]
        return F.greatest(F.lit(0.0), F.lit(0.0), *parts)

    merged = {k: larger(k) for k in CASCADE_KEYS}
    merged["nsfw_score"] = merged["adult_score"]
    merged["ensemble_risk_score"] = F.greatest(merged["ensemble_risk_score"], F.least(F.lit(1.0), F.col("unsafe_ratio") * 1.5))
    merged["video_unsafe_frame_ratio"] = F.col("unsafe_ratio")
    merged["video_consecutive_unsafe_frames"] = F.col("longest_run").cast("double")
    return joined.select(key, *[v.alias(k) for k, v in merged.items()])


def snapshots(frames: DataFrame, key: str = "video", order: str = "frame") -> DataFrame:
    """Rounded scores of every frame, one row a frame, so no list of a video's frames is gathered."""
    return frames.select(
        key, order, *[F.round(k, 4).alias(k) for k in RISKS], F.round(frame_risk(), 4).alias("risk"),
        (frame_risk() >= UNSAFE).alias("unsafe"),
    )
