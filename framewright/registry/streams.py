"""Stateful operators (STR-*): batch twins over whole tables, and streams worked off to their end."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.constants import IMAGE_SIGNATURES
from framewright.fixtures import views as V
from framewright.fixtures.sql import with_views
from framewright.functions import text as X
from framewright.functions.pixels import custom_measure
from framewright.operators import catalog as K
from framewright.operators import curation as U
from framewright.operators import frames as R
from framewright.operators import similarity as S
from framewright.registry import query
from framewright.registry.filters import walk_sql
from framewright.schemas import FRAMES
from framewright.sinks.png import write_files
from framewright.session import cut_lineage, work_folder
from framewright.streaming import ingest
from framewright.streaming.autoexport import auto_export, export_sequences
from framewright.streaming.frames import drop_near_duplicates_stream
from framewright.streaming.mirror import mirror_stream
from framewright.streaming.sessions import frames_in_segments_stream, session_rates_stream
from framewright.streaming.state import AVAILABLE_NOW


@query("str1_drop_near_duplicates", walk_sql("frames", "\nSELECT video_id, frame_id FROM walk WHERE kept"))
def str1(spark, sf):
    return R.drop_near_duplicates(V.pixel_frames(spark, sf), at_most=V.rows(spark, sf, "events")).select("video_id", "frame_id")


@query("str2_uniform_sampling", with_views("frames", """
SELECT video_id, slot, frame_id, pts_s FROM (SELECT *, CAST(floor(pts_s * 0.0002) AS BIGINT) AS slot,
  row_number() OVER (PARTITION BY video_id, floor(pts_s * 0.0002) ORDER BY pts_s, frame_id) AS k FROM frames) WHERE k = 1"""))
def str2(spark, sf):
    return R.sample_uniform(V.frames(spark, sf), 0.0002).select("video_id", "slot", "frame_id", "pts_s")


@query("str3_head_then_tail", with_views("objects", """
SELECT key, CASE WHEN rn <= 20 THEN 'head' ELSE 'tail' END AS phase FROM (
  SELECT key, row_number() OVER (ORDER BY lower(key), key) AS rn FROM objects WHERE regexp_matches(lower(key), '\\.(png|jpe?g|bmp|gif)$'))"""))
def str3(spark, sf):
    from framewright.plans.ordered import number_rows
    index = number_rows(V.objects(spark, sf).where(X.has_extension("key")), [], X.ignoring_case("key"), "rn",
                        at_most=V.rows(spark, sf, "pages"))
    return index.select("key", F.when(F.col("rn") <= 20, "head").otherwise("tail").alias("phase"))


@query("str4_auto_export", """
WITH c AS (SELECT l_suppkey AS session_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_linenumber % 3 = 1 AS is_primary FROM lineitem),
s AS (SELECT *, CAST(sum(CAST(is_primary AS INT)) OVER (PARTITION BY session_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seen,
  CAST(sum(CAST(is_primary AS INT)) OVER (PARTITION BY session_id) AS BIGINT) AS total FROM c)
SELECT session_id, CASE WHEN e <= total // 50 THEN e END AS export_sequence, count(*) AS crops, count_if(is_primary) AS primary_crops
FROM (SELECT *, (seen - CAST(is_primary AS INT)) // 50 + 1 AS e FROM s) GROUP BY 1, 2""")
def str4(spark, sf):
    crops = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("session_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        (F.col("l_linenumber") % 3 == 1).alias("is_primary"))
    numbered = export_sequences(crops, 50, order=("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"),
                                at_most=V.rows(spark, sf, "lineitem"))
    return numbered.groupBy("session_id", "export_sequence").agg(
        F.count(F.lit(1)).alias("crops"), F.count_if("is_primary").alias("primary_crops"))


@query("str5_restart_ledger", with_views("manifests", """
SELECT path, CASE WHEN done THEN 'finished before' ELSE 'to do' END AS state FROM manifests"""))
def str5(spark, sf):
    m = V.manifests(spark, sf).select("path", "done")
    todo = K.pending(m, m.where("done"))
    return todo.select("path", F.lit("to do").alias("state")).unionByName(
        m.where("done").select("path", F.lit("finished before").alias("state")))


@query("str6_quality_counters", with_views("measures", """
SELECT count(*) AS seen, count_if(var_laplacian >= 120 AND mean_luma >= 20) AS kept, count_if(var_laplacian < 120 OR mean_luma < 20) AS dropped FROM measures"""))
def str6(spark, sf):
    return U.decide(U.measure(V.thumbs(spark, sf))).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("decision") == "keep").alias("kept"), F.count_if(F.col("decision") == "drop").alias("dropped"))


@query("str7_exact_copies", """
SELECT sha256, CAST(n AS BIGINT) AS copies, first_id FROM (SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1)""")
def str7(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


def _streamed(spark, rows, root, batches=4, at_most=0, file_rows=1_000_000):
    """``rows`` written to ``root`` and read as a stream of ``batches``; with ``at_most`` rows, a
    batch has as many files as keep each to about ``file_rows``."""
    files = max(1, -(-at_most // (batches * file_rows)))
    rows.repartition(batches * files).write.mode("overwrite").parquet(root)
    return spark.readStream.schema(spark.read.parquet(root).schema).option("maxFilesPerTrigger", files).parquet(root)


@query("str3_stream_mirror", with_views("objects", """
SELECT key, CASE WHEN rn <= 20 THEN 0 ELSE 1 + (rn - 21) // greatest(1, (n - 19) // 2) END AS admission, CASE WHEN rn <= 20 THEN 'head' ELSE 'tail' END AS phase,
  CASE WHEN local_size = 0 THEN 'failed' WHEN mirrored THEN 'skipped' ELSE 'downloaded' END AS outcome
FROM (SELECT *, row_number() OVER (ORDER BY lower(key), key) AS rn, count(*) OVER () AS n FROM objects WHERE regexp_matches(lower(key), '\\.(png|jpe?g|bmp|gif)$'))"""))
def str3_stream(spark, sf):
    """Objects written to a store and mirrored by three runs of one stream, each going on where the last one stopped.
    Empty objects fail; what the mirror holds is skipped."""
    objects = V.objects(spark, sf).withColumn("data", F.when(F.col("local_size") == 0, F.lit(b"")).otherwise(
        F.concat(F.lit(IMAGE_SIGNATURES[0]), F.col("key").cast("binary"))))
    n = objects.where(X.has_extension("key")).count()
    with work_folder(spark, "mirror") as root:
        def put(rows, folder):
            write_files(rows.select(F.concat(F.lit(f"{root}/{folder}/"), "key").alias("target"), "data")).write.format("noop").mode("overwrite").save()
        put(objects, "store")
        put(objects.where("mirrored and local_size > 0"), "mirror")
        for _ in range(3):
            mirror_stream(spark, f"{root}/store", f"{root}/mirror", f"{root}/out", f"{root}/checkpoint", 20, max(1, (n - 19) // 2),
                          settle_ms=0).awaitTermination()
        return cut_lineage(spark.read.parquet(f"{root}/out").select("key", "admission", "phase", "outcome"))


@query("str1_stream_drop", walk_sql("frames", "\nSELECT video_id, frame_id FROM walk WHERE kept"))
def str1_stream(spark, sf):
    """The earlier half of each video by the batch operator, the later half by a stream that starts from its last kept frames."""
    with work_folder(spark, "frames") as root:
        frames = V.frames(spark, sf)
        middle = frames.groupBy("video_id").agg(((F.min("pts_s") + F.max("pts_s")) / 2).alias("_m"))
        late = frames.join(middle, "video_id").withColumn("_late", F.col("pts_s") > F.col("_m"))
        # Frames get their pixels after the shuffle and are written once, by half.
        V.with_pixels(late).select(*FRAMES.names, "_late").write.partitionBy("_late").parquet(f"{root}/in")
        halves = T.StructType([*FRAMES.fields, T.StructField("_late", T.BooleanType())])
        early = spark.read.schema(halves).parquet(f"{root}/in").where("not _late").drop("_late")
        kept = cut_lineage(R.drop_near_duplicates(early, at_most=V.rows(spark, sf, "events")))
        last = kept.groupBy("video_id").agg(F.max_by(F.struct(*FRAMES.names[1:]), F.struct("pts_s", "frame_id")).alias("_f")).select("video_id", "_f.*")
        stream = spark.readStream.schema(halves).parquet(f"{root}/in").where("_late").drop("_late")
        drop_near_duplicates_stream(stream, f"{root}/out", f"{root}/checkpoint", initial=last).awaitTermination()
        later = spark.read.schema(FRAMES).parquet(f"{root}/out")
        return cut_lineage(kept.select("video_id", "frame_id").unionByName(later.select("video_id", "frame_id")))


@query("str4_stream_exports", """
WITH c AS (SELECT l_suppkey AS session_id, count_if(l_linenumber % 3 = 1) AS n FROM lineitem GROUP BY 1)
SELECT session_id, CAST(n // 50 AS BIGINT) AS exports, CAST(n // 50 * 50 AS BIGINT) AS primary_crops FROM c WHERE n >= 50""")
def str4_stream(spark, sf):
    """Exports of a crop stream: as many as the queued primary crops fill, however it is cut in batches."""
    with work_folder(spark, "exports") as root:
        crops = V.table(spark, sf, "lineitem").select(
            F.col("l_suppkey").alias("session_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
            (F.col("l_linenumber") % 3 == 1).alias("is_primary"))
        auto_export(_streamed(spark, crops, f"{root}/in", 2, V.rows(spark, sf, "lineitem")), 50, f"{root}/out", f"{root}/checkpoint",
                    order=("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).awaitTermination()
        out = spark.read.parquet(f"{root}/out").groupBy("session_id").agg(
            F.max("export_sequence").alias("exports"), F.count_if("is_primary").alias("primary_crops"))
        return cut_lineage(out)


@query("str7_stream_hash_distances", with_views("distances", """
SELECT CAST(folder AS VARCHAR) AS folder, a_image_id, a_name, b_image_id, b_name, distance FROM distances"""))
def str7_distances(spark, sf):
    """Distances of the first half of all names by the batch operator, of the rest by a stream that starts from each folder's last image."""
    with work_folder(spark, "distances") as root:
        measured = cut_lineage(U.measure(V.thumbs(spark, sf)).select(F.col("folder").cast("string").alias("folder"), "name", "image_id", "dhash"))
        early = F.col("image_id") < 2 * V.rows(spark, sf, "embeddings")  # names follow the ids
        last = measured.where(early).groupBy("folder").agg(F.max_by(F.struct("name", "image_id", "dhash"), "name").alias("_l")).select("folder", "_l.*")
        measured.where(~early).write.parquet(f"{root}/in")
        stream = spark.readStream.schema(measured.schema).parquet(f"{root}/in")
        ingest.consecutive_distances_stream(stream, f"{root}/out", f"{root}/checkpoint", initial=last).awaitTermination()
        first = S.hash_distances(measured.where(early), at_most=V.rows(spark, sf, "embeddings", times=4))
        return cut_lineage(first.unionByName(spark.read.schema(ingest.HASH_PAIR).parquet(f"{root}/out")))


@query("str7_stream_exact_copies", "SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def str7_stream(spark, sf):
    """One file per content goes through the stream, whatever batch its copies arrive in."""
    with work_folder(spark, "copies") as root:
        files = V.table(spark, sf, "documents").select(
            F.col("doc_id").cast("string").alias("path"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("modificationTime"),
            F.col("text").cast("binary").alias("content"))
        kept = ingest.drop_exact_copies(_streamed(spark, files, f"{root}/in", at_most=V.rows(spark, sf, "documents"), file_rows=20_000))
        kept.select("sha256").writeStream.format("parquet").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/checkpoint").trigger(**AVAILABLE_NOW).start().awaitTermination()
        return cut_lineage(spark.read.parquet(f"{root}/out"))


@query("agg4_stream_sessions", with_views("frames", """
, t AS (SELECT video_id, make_timestamp(CAST(round(pts_s * 1000000) AS BIGINT)) AS ts FROM frames),
marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY video_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS begins FROM t),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY video_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked),
sessions AS (SELECT video_id, min(ts) AS started, max(ts) AS ended, count(*) AS total FROM numbered GROUP BY video_id, k)
SELECT video_id, epoch_us(started) AS started_us, epoch_us(ended) AS ended_us, total,
  round(total / greatest(1, (epoch_us(ended) - epoch_us(started)) / 1000000.0), 6) AS per_second FROM sessions
WHERE ended + INTERVAL 6 HOURS <= (SELECT max(ts) FROM t) - INTERVAL 1 DAY"""))
def agg4_stream(spark, sf):
    """Stretches of work of a stream, each given once the watermark has passed its end; the last day's are still open."""
    with work_folder(spark, "sessions") as root:
        rows = V.frames(spark, sf).select("video_id", F.timestamp_micros(F.round(F.col("pts_s") * 1_000_000).cast("long")).alias("ts"))
        rows.write.parquet(f"{root}/in")
        stream = spark.readStream.schema("video_id long, ts timestamp").parquet(f"{root}/in")
        session_rates_stream(stream, "6 hours", "1 day", ("video_id",)).writeStream.format("parquet").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/checkpoint").trigger(**AVAILABLE_NOW).start().awaitTermination()
        return cut_lineage(spark.read.parquet(f"{root}/out").select(
            "video_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "total",
            F.round("per_second", 6).alias("per_second")))


@query("jon3_stream_segments", with_views("matched", "SELECT video_id, seg, frame_id, pts_s FROM matched WHERE start_s >= 0"))
def jon3_stream(spark, sf):
    """Frames and bounded segments as two streams; whatever meets comes out."""
    with work_folder(spark, "met") as root:
        def at(c):
            return F.timestamp_micros(F.round(F.col(c).cast("double") * 1_000_000).cast("long"))

        V.frames(spark, sf).select("video_id", "frame_id", "pts_s", at("pts_s").alias("ts")).write.parquet(f"{root}/frames")
        V.segments(spark, sf).where("start_s >= 0").select("video_id", "seg", at("start_s").alias("start_ts"), at("end_s").alias("end_ts")).write.parquet(f"{root}/segments")

        def stream(name):
            return spark.readStream.schema(spark.read.parquet(f"{root}/{name}").schema).parquet(f"{root}/{name}")
        frames_in_segments_stream(stream("frames"), stream("segments"), "11 days").writeStream.format("parquet").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/checkpoint").trigger(**AVAILABLE_NOW).start().awaitTermination()
        return cut_lineage(spark.read.parquet(f"{root}/out").select("video_id", "seg", "frame_id", "pts_s"))


@query("udf1_progress_counters", with_views("measures", """
SELECT count(*) AS seen, count_if(var_laplacian >= 120 AND mean_luma >= 20) AS kept, count_if(var_laplacian < 120 OR mean_luma < 20) AS dropped FROM measures"""))
def udf1(spark, sf):
    """Live counters of a curation stream, summed over its batches by the listener."""
    counters = ingest.ProgressListener("udf1_curation")
    spark.streams.addListener(counters)
    try:
        with work_folder(spark, "curation") as root:
            decided = U.decide(_streamed(spark, U.measure(V.thumbs(spark, sf)), f"{root}/in"))
            run = ingest.observed_decisions(decided, "udf1_curation").writeStream.format("noop").option(
                "checkpointLocation", f"{root}/checkpoint").trigger(**AVAILABLE_NOW).start()
            run.awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(counters)
    names = ("seen", "kept", "dropped")
    return spark.createDataFrame([tuple(counters.totals.get(n, 0) for n in names)], ", ".join(f"{n} long" for n in names))


@query("udf2_custom_measure", with_views("thumbs", """
SELECT image_id, CAST(max(v) AS DOUBLE) AS brightest FROM thumbs GROUP BY image_id"""))
def udf2(spark, sf):
    """A measure that a user brings: the brightest sample of each image."""
    brightest = custom_measure(lambda block: block.reshape(len(block), -1).max(axis=1).astype(float))
    return V.thumbs(spark, sf).select("image_id", brightest("px", "height", "width", "n_channels").alias("brightest"))
