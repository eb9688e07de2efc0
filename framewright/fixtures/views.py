"""Collections derived by Spark from the given tables.

The tables hold no pixels, so each view maps their rows to the shape of an image,
volume, frame or crop collection.  Every view scans its table once, shuffles
nothing unless said, and grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.pixels import bytes_from_ints
from framewright.plans.spread import spread

THUMB_W, THUMB_H = 9, 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def rows(spark: SparkSession, sf: str, *names: str, times: int = 1) -> int:
    """Rows of tables, from their file footers, as a bound for what is derived from them."""
    return times * sum(table(spark, sf, n).count() for n in names)


def wide_table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """A few columns of a table whose rows expand a lot downstream."""
    return spread(table(spark, sf, name).select(*columns))


def _thumb_values() -> Column:
    """72 gray values of variant ``k`` of a vector: plain, jittered, brighter (or dark), flat."""
    def value(i: Column) -> Column:
        e = F.element_at("embedding", (i % 64 + 1).cast("int")).cast("double")
        b = F.floor((e + F.lit(0.6)) * 210)
        v = (
            F.when(F.col("k") == 0, b)
            .when(F.col("k") == 1, b + (i * 7 + F.col("vec_id")) % 3 - 1)
            .when(F.col("k") == 2, b + F.when(F.col("vec_id") % 9 == 0, -140).otherwise(40))
            .otherwise(F.floor(b / 16) + 8 + F.col("vec_id") % 12)
        )
        return F.least(F.lit(255), F.greatest(F.lit(0), v)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(THUMB_W * THUMB_H - 1)), value)


def _thumb_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = wide_table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", "embedding", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    image_id = F.col("vec_id") * 4 + F.col("k")
    return rows.select(
        image_id.alias("image_id"), (F.col("vec_id") % 5).alias("folder"),
        F.concat(F.lit("img_"), F.lpad(image_id.cast("string"), 7, "0"), F.lit(".png")).alias("name"),
        _thumb_values().alias("v"))


def _as_image(rows: DataFrame, channels: int, values: Column) -> DataFrame:
    return rows.select(
        "image_id", "folder", "name", F.lit(THUMB_W).alias("width"), F.lit(THUMB_H).alias("height"),
        F.lit(channels).alias("n_channels"), bytes_from_ints(values).alias("px"))


def thumbs(spark: SparkSession, sf: str) -> DataFrame:
    """Gray 9x8 images, four per vector."""
    return _as_image(_thumb_rows(spark, sf), 1, F.col("v"))


def colour_thumbs(spark: SparkSession, sf: str) -> DataFrame:
    """Colour 9x8 images: blue 255 - v, green 2 v mod 256, red v; v = 0 is black."""
    def sample(v: Column) -> Column:
        return F.when(v == 0, F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(F.array(255 - v, v * 2 % 256, v))
    return _as_image(_thumb_rows(spark, sf), 3, F.flatten(F.transform("v", sample)))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Video frames with time, mean luma and scene score."""
    seconds = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")).cast("double") / 1000000
    return wide_table(spark, sf, "events", "user_id", "event_id", "ts", "value").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_id"), seconds.alias("pts_s"),
        (F.col("value") / 2).alias("y_avg"), ((F.col("event_id") * 37 % 100).cast("double") / 1000).alias("scene"))


def block_level(k: int) -> Column:
    """Gray level of 8x8 block k of a frame: slow steps, and a jump on bright frames."""
    step = F.floor(F.col("frame_id") / 400) * (k + 1) % 5
    return (F.lit(100) + step * 2 + F.when(F.col("y_avg") > 60, 20).otherwise(0)).cast("int")


def pixel_frames(spark: SparkSession, sf: str) -> DataFrame:
    return with_pixels(frames(spark, sf))


def with_pixels(frames: DataFrame) -> DataFrame:
    """Frames with 16x16 gray pixels made of four even 8x8 blocks."""
    leveled = frames.withColumn("_l", F.array(*[block_level(k) for k in range(4)]))
    cell = [F.repeat(F.lpad(F.hex(F.col("_l")[k]), 2, "0"), 8) for k in range(4)]
    halves = [F.repeat(F.concat(cell[k], cell[k + 1]), 8) for k in (0, 2)]
    return leveled.withColumns(
        {"height": F.lit(16), "width": F.lit(16), "px": F.unhex(F.concat(*halves))}).drop("_l")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Two segments per video, or one whole-video segment."""
    user = F.col("user_id")

    def seg(n, start, end):
        return F.struct(F.lit(n).alias("seg"), start.cast("int").alias("start_s"), end.cast("int").alias("end_s"))

    whole = F.array(seg(1, F.lit(-1), F.lit(-1)))
    two = F.array(seg(1, user % 10 * 86400, (user % 10 + 5) * 86400), seg(2, F.lit(20 * 86400), F.lit(30 * 86400)))
    videos = table(spark, sf, "events").select("user_id").distinct()
    return videos.select(
        user.alias("video_id"), F.inline(F.when(user % 10 == 0, whole).otherwise(two))).withColumn("prefix", F.lit("Frame_"))


def decoder_log(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("event_type") == "error", F.concat(
        F.lit("[mpdecimate] drop pts:"), F.col("event_id").cast("string"), F.lit(" drop_count: "),
        (F.col("event_id") % 4).cast("string"))).otherwise(F.concat(F.lit("frame="), F.col("event_id").cast("string")))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("line_no"), line.alias("line"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Image catalogue; suffixes include other files and upper case."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".png", ".jpg", ".JPEG", ".bmp", ".gif", ".txt", ".dcm")]),
                          (F.col("doc_id") % 7 + 1).cast("int"))
    n = F.col("n_chars")
    return wide_table(spark, sf, "documents", "doc_id", "source", "n_chars", "lang").select(
        F.col("doc_id").alias("image_id"),
        F.concat(F.lit("/ds/"), "source", F.lit("/img_"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.col("source").alias("folder"), (64 + n % 960).cast("int").alias("width"),
        (64 + n * 7 % 720).cast("int").alias("height"), n.alias("bytes"),
        F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.col("lang")).alias("annotation"))


def crop_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Crop requests in both spellings, with bad bounds and missing images."""
    o = F.col("l_orderkey")
    corner, sized = o % 4 == 0, o % 4 == 1
    i = "int"
    return wide_table(
        spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
        "l_returnflag", "l_linestatus",
    ).select(
        F.col("l_suppkey").alias("manifest_id"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("image_id"),
        F.col("l_extendedprice").alias("tiebreak"),
        F.when(~corner, (o % 900 - 20).cast(i)).alias("x1"), F.when(~corner, (o * 3 % 700).cast(i)).alias("y1"),
        F.when(sized, (F.col("l_quantity") * 5).cast(i)).alias("w"),
        F.when(sized, (F.col("l_quantity") * 4).cast(i)).alias("h"),
        F.when(corner, (o % 300).cast(i)).alias("tl_x"), F.when(corner, (o % 200).cast(i)).alias("tl_y"),
        F.when(corner, (o % 300 + 127).cast(i)).alias("br_x"), F.when(corner, (o % 200 + 63).cast(i)).alias("br_y"),
        F.when(F.col("l_linenumber") == 3, " ").otherwise(F.concat_ws(" ", "l_returnflag", "l_linestatus")).alias("annotation"))


CROP_KEY = ("manifest_id", "l_orderkey", "l_linenumber", "image_id", "tiebreak")
DEFAULT_W, DEFAULT_H = 256, 128


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.alias("manifest_id"),
        F.concat(F.lit("/meta/"), F.col("s_nationkey").cast("string"), F.lit("/crop_metadata_"), s.cast("string"),
                 F.lit(".json")).alias("path"),
        (s % 5 == 0).alias("done"), (s % 13 != 0).alias("has_crops"))


def existing_files(spark: SparkSession, sf: str) -> DataFrame:
    """Names in crop sinks: numbered PNGs of several prefixes and sizes, other files among them."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    size = F.element_at(F.array(F.lit("64x64"), F.lit("128x64"), F.lit("200x160")), (c % 3 + 1).cast("int"))
    prefix = F.substring("o_orderpriority", 3, 4)
    suffix = F.when(o % 17 == 0, ".txt").when(o % 5 == 0, ".PNG").otherwise(".png")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("/sink/"), "o_orderstatus").alias("sink"),
        F.concat(F.when(o % 4 == 0, F.lower(prefix)).otherwise(prefix), F.lit("_"), size, F.lit("_"),
                 F.lpad((o % 9000 * 3).cast("string"), 5, "0"), suffix).alias("name"))


def voxel_slices(spark: SparkSession, sf: str) -> DataFrame:
    """8x8 axial slices, 64 to a volume; some constant, near-empty or with NaN voxels."""
    vec = F.col("vec_id")
    z = vec % 64

    def value(i: Column) -> Column:
        return (
            F.when(z % 10 == 9, F.lit(7.0))
            .when(z % 10 == 8, F.when(i == 5, F.lit(100.0)).otherwise(F.lit(0.0)))
            .when((vec * 64 + i) % 97 == 0, F.lit(float("nan")))
            .otherwise(F.element_at("embedding", (i + 1).cast("int")).cast("double") * 1000))

    return wide_table(spark, sf, "embeddings", "vec_id", "embedding").select(
        F.floor(vec / 64).alias("volume_id"), z.cast("int").alias("z"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.transform(F.sequence(F.lit(0), F.lit(63)), value).alias("vox"))


def volume_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of one to four dimensions with various types; a third carries affine rows."""
    d, n = F.col("doc_id"), F.col("n_chars")
    ndim = F.element_at(F.array(*map(F.lit, (2, 3, 3, 4, 1))), (d % 5 + 1).cast("int"))
    w, h, depth = 16 + n % 500, 16 + n * 3 % 400, 1 + n % 90
    dims = [ndim, w, F.when(ndim >= 2, h).otherwise(1), F.when(ndim >= 3, depth).otherwise(1),
            F.when(ndim >= 4, 2).otherwise(1), F.lit(1), F.lit(1), F.lit(1)]
    kind = F.element_at(F.array(*map(F.lit, (2, 4, 8, 16, 64, 512))), (d % 6 + 1).cast("int"))
    bits = F.element_at(F.array(*map(F.lit, (8, 16, 32, 32, 64, 16))), (d % 6 + 1).cast("int"))
    gz = F.when(d % 4 == 0, ".nii.gz").when(d % 4 == 1, ".NII").otherwise(".nii")

    def row(a, b, c, t):
        return F.when(d % 3 == 0, F.array(*[F.lit(float(v)) for v in (a, b, c)], (t - n % 7).cast("double")))

    return table(spark, sf, "documents").select(
        F.concat(F.lit("/vol/"), "source", F.lit("/scan_"), d.cast("string"), gz).alias("path"),
        F.array(*[v.cast("smallint") for v in dims]).alias("dim"), kind.alias("datatype"), bits.alias("bitpix"),
        row(1.5, 0, 0, -10).alias("srow_x"), row(0, 2, 0.25, -20).alias("srow_y"), row(0, 0.5, 3, 5).alias("srow_z"))


def header_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """348-byte volume headers of both byte orders, with values that need repair."""
    d, n = F.col("doc_id"), F.col("n_chars")
    big = d % 2 == 1

    def int16(v):
        text = F.lpad(F.right(F.hex(v.cast("long")), F.lit(4)), 4, "0")
        return F.when(big, text).otherwise(F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2)))

    def word(text):
        pairs = [F.substring(text, at, 2) for at in (7, 5, 3, 1)]
        return F.when(big, text).otherwise(F.concat(*pairs))

    dims = [F.element_at(F.array(*map(F.lit, (2, 3, 3, 4, 9))), (d % 5 + 1).cast("int")), 16 + n % 500, n * 3 % 400, n % 90 - 20]
    size = F.when(d % 13 == 12, "00000000").otherwise("0000015C")
    code = F.element_at(F.array(*map(F.lit, (2, 4, 8, 16, 64, 512, 1024))), (d % 7 + 1).cast("int"))
    # IEEE bits: 1.0, 1.5, 2000.0, -1.0 and NaN
    spacing = F.element_at(F.array(*map(F.lit, ("3F800000", "3FC00000", "44FA0000", "BF800000", "7FC00000"))), (n % 5 + 1).cast("int"))
    offset = F.when(d % 3 == 0, "43B00000").when(d % 3 == 1, "44000000").otherwise("BF800000")
    text = F.concat(
        word(size), F.repeat(F.lit("00"), 36), *[int16(v) for v in dims], F.repeat(F.lit("00"), 8 + 14), int16(code), F.repeat(F.lit("00"), 4),
        word(F.lit("3F800000")), *[word(spacing)] * 3, F.repeat(F.lit("00"), 16), word(offset), F.repeat(F.lit("00"), 236))
    return wide_table(spark, sf, "documents", "doc_id", "n_chars").select(d.alias("volume_id"), F.unhex(text).alias("head"))


def dicom_tags(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    parent = F.concat(F.lit("/dcm/d"), (v % 7).cast("string"))
    second = F.element_at("embedding", 2).cast("double")
    return table(spark, sf, "embeddings").select(
        v.alias("file_id"), F.concat(parent, F.lit("/"), v.cast("string"), F.lit(".dcm")).alias("path"), parent.alias("parent"),
        F.when(v % 17 == 0, "").otherwise(F.concat(F.lit("1.2.3."), F.col("label").cast("string"))).alias("series_uid"),
        F.when(v % 5 != 0, F.element_at("embedding", 1).cast("double")).alias("slice_location"),
        F.when(v % 10 != 0, F.array(F.lit(0.0), F.lit(0.0), second)).alias("image_position"))


def file_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate DICOM files with their first 132 bytes; some short, some without the magic."""
    d = F.col("doc_id")
    magic = F.when(d % 3 == 0, "DICM").otherwise(F.lpad(F.substring("lang", 1, 4), 4, "-"))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("/in/"), "source", F.lit("/"), d.cast("string"), F.when(d % 4 == 0, ".DCM").when(d % 4 == 3, ".bin").otherwise(".dcm")).alias("path"),
        F.col("source").alias("folder"), F.col("n_chars").alias("length"),
        F.concat(F.repeat(F.lit("\x01"), 128), magic).cast("binary").alias("head"))


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """Remote objects with what a local mirror holds of them."""
    p = F.col("page_id")
    suffix = F.when(p % 3 == 0, ".PNG").when(p % 3 == 1, ".jpg").otherwise(".html")
    size = F.length("html").cast("long")
    return table(spark, sf, "pages").select(
        F.concat(F.when(p % 4 == 0, "raw/").otherwise("Images/"), (p % 9).cast("string"), F.lit("/p"),
                 p.cast("string"), suffix).alias("key"),
        size.alias("size"), (p % 2 == 0).alias("mirrored"), F.when(p % 6 == 0, 0).otherwise(size).cast("long").alias("local_size"))


def segment_json(spark: SparkSession, sf: str) -> DataFrame:
    """Segment manifests as JSON text, one per conversation turn; options vary and may be missing."""
    c, t = F.col("conv_id"), F.col("turn")
    n = F.length("text")
    options = F.struct(
        F.when(c % 2 == 0, True).alias("dropDuplicates"), (t % 2 == 0).alias("useCustomMpdecimateParams"),
        F.when(c % 3 == 0, 600).alias("mpdecimateHi"), (c % 5 == 0).alias("useUniformSampling"),
        F.when(c % 10 == 0, F.lit(2.5)).alias("uniformSamplingFps"), (t % 3 == 0).alias("skipDarkFrames"))
    seg = F.struct(
        F.when(t % 4 != 3, n % 100).alias("start"), F.when(t % 4 != 3, n % 100 + 10).alias("end"),
        F.when(t % 2 == 0, F.col("role")).alias("prefix"))
    doc = F.struct(
        F.concat(F.lit("/v/"), c.cast("string"), F.lit("_"), t.cast("string"), F.lit(".mp4")).alias("videoPath"),
        options.alias("extractionOptions"), F.create_map(F.lit("segment_1"), seg, F.lit("segment_2"), seg).alias("segments"))
    return table(spark, sf, "conversations").select(F.to_json(doc).alias("document"))
