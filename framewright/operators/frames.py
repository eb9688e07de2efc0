"""Video frames: segments, selection rules, duplicate drop and rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.constants import DECIMATE_FRAC, DECIMATE_HI, DECIMATE_LO, MIN_FRAME_LUMA, SCENE_THRESHOLD
from framewright.functions.pixels import near_identical
from framewright.plans.ordered import MAX_GROUP_ROWS, group_sizes, number_rows
from framewright.plans.ranges import interval_join
from framewright.session import cut_lineage

# Frames of one video that are walked in one go.
FRAMES_PER_BLOCK = 1024
# Rounds of block repair before a video whose chains do not meet is walked on in pieces.
MAX_ROUNDS = 12
# Blocks that one task walks after that, one after another.
PIECE_BLOCKS = 8

_FLAGS = (T.StructField("block", T.LongType()), T.StructField("rn", T.LongType()), T.StructField("kept", T.BooleanType()))


def whole_video(start="start_s", end="end_s") -> Column:
    return (F.col(start) < 0) | (F.col(end) < 0)


def valid_segments(segments: DataFrame) -> DataFrame:
    return segments.where((F.col("end_s") >= F.col("start_s")) | whole_video())


def frames_in_segments(frames: DataFrame, segments: DataFrame, bucket_s: float = 3600.0) -> DataFrame:
    """Frames matched to the segments whose time range holds them.

    A whole-video segment is given its video's own time range, so one bucketed
    equi-join serves both kinds and a long video spreads over its buckets.
    """
    extent = frames.groupBy("video_id").agg(F.min("pts_s").alias("_lo"), F.max("pts_s").alias("_hi"))
    spans = valid_segments(segments).join(extent, "video_id").withColumns({
        "_from": F.when(whole_video(), F.col("_lo")).otherwise(F.greatest(F.col("start_s").cast("double"), "_lo")),
        "_to": F.when(whole_video(), F.col("_hi")).otherwise(F.least(F.col("end_s").cast("double"), "_hi")),
    }).drop("_lo", "_hi")
    return interval_join(frames, spans, ["video_id"], "pts_s", "_from", "_to", bucket_s).drop("_from", "_to")


def scene_change(threshold: float = SCENE_THRESHOLD) -> Column:
    return F.col("scene") > F.lit(float(threshold))


def bright(threshold: float = MIN_FRAME_LUMA) -> Column:
    return F.col("y_avg") > F.lit(float(threshold))


def sample_uniform(frames: DataFrame, fps: float | Column) -> DataFrame:
    """First frame of every 1/fps interval of a video; pre-aggregates map-side."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    slot = F.floor(F.col("pts_s") * rate).cast("long")
    rest = [c for c in frames.columns if c not in ("video_id", "pts_s", "frame_id")]
    packed = frames.groupBy("video_id", slot.alias("slot")).agg(
        F.min_by(F.struct("pts_s", "frame_id", *rest), F.struct("pts_s", "frame_id")).alias("_f"))
    return packed.select("video_id", "slot", "_f.*")


def walk_kept(images: np.ndarray, last: np.ndarray | None, hi: int, lo: int, frac: float) -> np.ndarray:
    """Flags of the frames that differ from the last kept one, walking in order.

    Frames ahead are compared with the last kept one a stretch at a time; the
    stretch doubles while nothing is kept and starts small again after a keep.
    """
    kept = np.zeros(len(images), bool)
    at, stretch = 0, 2
    if last is None:
        kept[0], last, at = True, images[0], 1
    while at < len(images):
        ahead = images[at:at + stretch]
        differs = ~near_identical(ahead, last, hi, lo, frac)
        first = int(differs.argmax())
        if differs[first]:
            at += first
            kept[at], last, stretch = True, images[at], 2
            at += 1
        else:
            at, stretch = at + len(ahead), stretch * 2
    return kept


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the blocks of a sorted partition batch by batch.

    Only the last kept frame outlives a batch, so memory does not grow with a block.
    """
    key, last = None, None
    for batch in batches:
        video, block, height, width, hi, lo, frac = (
            batch.column(c).to_numpy(zero_copy_only=False)
            for c in ("video_id", "block", "height", "width", "_hi", "_lo", "_frac"))
        carried = batch.column("carried").to_numpy(zero_copy_only=False)
        px = batch.column("px").to_pylist()
        kept = np.zeros(len(px), bool)
        cuts = np.flatnonzero((video[1:] != video[:-1]) | (block[1:] != block[:-1]) | carried[:-1]) + 1
        for start, end in zip([0, *cuts], [*cuts, len(px)]):
            if (video[start], block[start]) != key:
                key, last = (video[start], block[start]), None
            images = np.frombuffer(b"".join(px[start:end]), np.uint8).reshape(end - start, height[start], width[start])
            if carried[start]:
                last = images[0]
                continue
            kept[start:end] = flags = walk_kept(images, last, hi[start], lo[start], frac[start])
            if flags.any():
                last = images[np.flatnonzero(flags)[-1]]
        own = pa.array(~carried)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).filter(own) for c in ("video_id", "block", "rn")), pa.array(kept).filter(own)],
            ["video_id", "block", "rn", "kept"])


def drop_near_duplicates(
    frames: DataFrame, hi: int | Column = DECIMATE_HI, lo: int | Column = DECIMATE_LO,
    frac: float | Column = DECIMATE_FRAC,
    carried: DataFrame | None = None, frames_per_block: int = FRAMES_PER_BLOCK,
    max_group_rows: int = MAX_GROUP_ROWS, at_most: int | None = None,
) -> DataFrame:
    """Drop gray frames near-identical to the **last kept** frame of their video.

    The rule is sequential, yet a video is not walked by one task.  It is cut into
    blocks of bounded size that are walked side by side, each first as if nothing
    was kept before it.  A block whose predecessor ends on another kept frame than
    assumed is walked again from that frame, until no block changes.  Chains that
    meet stay together, so few rounds are needed.  A video whose chains do not meet in
    ``MAX_ROUNDS`` goes on from its first open block in pieces of ``PIECE_BLOCKS`` blocks,
    each handing its last kept frame to the next.  The result is exact either way.

    The limits are numbers, or columns that are the same for all frames of a video.
    ``carried`` may give the last kept frame per video of earlier input.
    """
    limits = {"_hi": (hi, "int"), "_lo": (lo, "int"), "_frac": (frac, "double")}
    limits = {n: (v if isinstance(v, Column) else F.lit(v)).cast(t) for n, (v, t) in limits.items()}
    numbered = number_rows(
        frames, ["video_id"], ["pts_s", "frame_id"], "rn", max_group_rows, at_most,
    ).withColumns({"block": F.floor((F.col("rn") - 1) / F.lit(frames_per_block)), **limits})
    cells = ["video_id", "block", "rn", "height", "width", "px", *limits]
    extra = ["rn", "block", *limits]
    result = T.StructType([frames.schema["video_id"], *_FLAGS])
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def walked(rows: DataFrame) -> DataFrame:
        placed = rows.repartition(n, "video_id", "block").sortWithinPartitions("video_id", "block", "rn")
        return placed.mapInArrow(_walk, result)

    # Row number 0 stands for the frame carried in from earlier input.
    seed = None if carried is None else carried.select(
        "video_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("rn"), "height", "width", "px",
        *[F.lit(0).cast(numbered.schema[c].dataType).alias(c) for c in limits])
    small = at_most is not None and at_most <= frames_per_block
    if small or group_sizes(frames, ["video_id"])[0] <= frames_per_block:
        rows = numbered.select(*cells, F.lit(False).alias("carried"))
        if seed is not None:
            present = frames.select("video_id").distinct()
            rows = rows.unionByName(seed.join(present, "video_id", "left_semi").withColumn("carried", F.lit(True)))
        kept = walked(rows).where("kept")
        return numbered.join(kept.select("video_id", "rn"), ["video_id", "rn"], "left_semi").drop(*extra)

    numbered = cut_lineage(numbered)
    pool = numbered.select(*cells)
    if seed is not None:
        pool = pool.unionByName(seed)
    plain = numbered.select(*cells, F.lit(False).alias("carried"))

    def with_entry(entry: DataFrame) -> DataFrame:
        """Rows of the named blocks, each led by the frame it is entered with."""
        lead = entry.join(pool.drop("block"), ["video_id", "rn"]).select(*cells, F.lit(True).alias("carried"))
        return plain.join(entry.select("video_id", "block"), ["video_id", "block"], "left_semi").unionByName(lead)

    start = F.lit(0).cast("long")
    first = plain if seed is None else plain.unionByName(
        seed.join(numbered.select("video_id").distinct(), "video_id", "left_semi").withColumn("carried", F.lit(True)))
    flags = cut_lineage(walked(first))
    entered = flags.select("video_id", "block").distinct().withColumn("entered", F.lit(None).cast("long"))
    if seed is not None:
        entered = entered.withColumn("entered", F.when(F.col("block") == 0, start))
    entered = cut_lineage(entered)
    rounds = 0
    while True:
        # A block that keeps nothing passes on the frame it was entered with.
        own = flags.where("kept").groupBy("video_id", "block").agg(F.max("rn").alias("exit"))
        exits = entered.join(own, ["video_id", "block"], "left").select(
            "video_id", (F.col("block") + 1).alias("block"), F.coalesce("exit", "entered").alias("rn"))
        entry = entered.join(exits, ["video_id", "block"]).where(
            F.col("rn").isNotNull() & ~F.col("rn").eqNullSafe(F.col("entered"))).select("video_id", "block", "rn")
        entry = cut_lineage(entry)
        if entry.isEmpty():
            break
        if rounds < MAX_ROUNDS:
            redone = walked(with_entry(entry))
        else:
            # Chains that do not meet: what lies before a video's first open block is settled,
            # so the video goes on from there, a piece of bounded size at a time.
            first_open = cut_lineage(entry.groupBy("video_id").agg(F.min_by(F.struct("block", "rn"), "block").alias("_f")).select(
                "video_id", F.col("_f.block").alias("_at"), F.col("_f.rn").alias("rn")))
            piece = plain.join(first_open.select("video_id", "_at"), "video_id").where(
                (F.col("block") >= F.col("_at")) & (F.col("block") < F.col("_at") + PIECE_BLOCKS))
            lead = first_open.join(pool.drop("block"), ["video_id", "rn"]).withColumn("block", F.col("_at"))
            redone = walked(piece.withColumn("block", F.col("_at")).select(*plain.columns).unionByName(
                lead.select(*cells, F.lit(True).alias("carried"))))
            redone = cut_lineage(redone.withColumn("block", F.floor((F.col("rn") - 1) / F.lit(frames_per_block))))
            before = Window.partitionBy("video_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            last = redone.groupBy("video_id", "block").agg(F.max(F.when(F.col("kept"), F.col("rn"))).alias("_exit"))
            entry = cut_lineage(last.join(first_open.drop("_at"), "video_id").select(
                "video_id", "block", F.coalesce(F.max("_exit").over(before), "rn").alias("rn")))
        flags = cut_lineage(flags.join(entry, ["video_id", "block"], "left_anti").unionByName(redone))
        entered = cut_lineage(entered.join(
            entry.withColumnRenamed("rn", "_new"), ["video_id", "block"], "left").select(
            "video_id", "block", F.coalesce("_new", "entered").alias("entered")))
        rounds += 1
    kept = flags.where("kept").select("video_id", "rn")
    return numbered.join(kept, ["video_id", "rn"], "left_semi").drop(*extra)


def select_frames(
    frames: DataFrame, scene: float | None = SCENE_THRESHOLD, luma: float | None = MIN_FRAME_LUMA,
    drop_duplicates: bool = True, fps: float | None = None, **decimate,
) -> DataFrame:
    """Selection rules in their fixed order: scene, luma, duplicate drop, fps."""
    out = frames
    if scene and scene > 0:
        out = out.where(scene_change(scene))
    if luma and luma > 0:
        out = out.where(bright(luma))
    if drop_duplicates:
        out = drop_near_duplicates(out, **decimate)
    if fps:
        out = sample_uniform(out, fps)
    return out


def select_by_options(frames: DataFrame, **decimate) -> DataFrame:
    """The same rules with each video's own options as columns.

    ``scene_threshold``, ``min_luma`` and ``fps`` switch their rule off where they are
    null, zero or below;
    ``drop_duplicates`` is a flag, with ``hi``, ``lo`` and ``frac`` null for defaults.
    """
    lit = frames.where(
        (F.coalesce(F.col("scene_threshold") <= 0, F.lit(True)) | (F.col("scene") > F.col("scene_threshold")))
        & (F.coalesce(F.col("min_luma") <= 0, F.lit(True)) | (F.col("y_avg") > F.col("min_luma"))))
    limits = {n: F.coalesce(F.col(n), F.lit(d)) for n, d in (("hi", DECIMATE_HI), ("lo", DECIMATE_LO), ("frac", DECIMATE_FRAC))}
    thinned = drop_near_duplicates(lit.where("drop_duplicates"), **limits, **decimate).unionByName(
        lit.where(~F.col("drop_duplicates")))
    sampled = sample_uniform(thinned.where(F.col("fps") > 0), F.col("fps")).drop("slot")
    return sampled.unionByName(thinned.where(F.coalesce(F.col("fps") <= 0, F.lit(True))))


def drop_increment(line="line") -> Column:
    """Number after ``drop_count:`` in a decoder log line, 0 where there is none."""
    return F.coalesce(F.regexp_extract(line, r"drop_count[^:]*:\s*(\d+)", 1).try_cast("int"), F.lit(0))


def dropped_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("video_id").agg(F.sum(drop_increment()).cast("long").alias("dropped"))


def frames_per_segment(matched: DataFrame) -> DataFrame:
    """Frames per segment, and per video where ``seg`` is null."""
    return matched.rollup("video_id", "seg").agg(F.count(F.lit(1)).alias("frames")).where(F.col("video_id").isNotNull())


def extraction_rates(runs: DataFrame) -> DataFrame:
    """Rates of runs ``(frames, dropped, duration_s, elapsed_s, source_bytes, frame_bytes)``; 0 for a zero base."""
    def ratio(a, b):
        return F.coalesce(F.try_divide(a, F.when(b > 0, b)), F.lit(0.0))

    n, d = F.col("frames").cast("double"), F.col("dropped").cast("double")
    fps = ratio(n, F.col("duration_s"))
    return runs.withColumns({
        "frames_per_second": fps, "frames_per_minute": fps * 60,
        "processing_rate": ratio(n, F.col("elapsed_s")),
        "duplicate_rate": ratio(d * 100, n + d),
        "real_time_factor": ratio(F.col("elapsed_s").cast("double"), F.col("duration_s")),
        "compression_ratio": F.try_divide(F.col("frame_bytes").cast("double"),
                                          F.when(F.col("source_bytes") > 0, F.col("source_bytes"))),
    })
