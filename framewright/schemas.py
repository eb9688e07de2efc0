"""Schemas of the tables and documents the engine reads and writes."""

from pyspark.sql import types as T

BOOL, BYTES, DOUBLE, FLOAT = T.BooleanType(), T.BinaryType(), T.DoubleType(), T.FloatType()
INT, LONG, SHORT, TEXT, TIME = T.IntegerType(), T.LongType(), T.ShortType(), T.StringType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


POINT = struct(x=INT, y=INT)
SIZE = struct(w=INT, h=INT)
RECT = struct(x=INT, y=INT, width=INT, height=INT)

IMAGES = struct(image_id=LONG, path=TEXT, width=INT, height=INT, n_channels=INT, px=BYTES)

CROP_OPERATION = struct(level=INT, dimensions=TEXT, crop_area=RECT, crop_areas=T.ArrayType(RECT))

CROP_RECORD = struct(
    project=TEXT, user=TEXT, sourceDir=TEXT, sinkDir=TEXT, imageName=TEXT, imagePath=TEXT, imageWidth=INT,
    imageHeight=INT, cropX1=INT, cropY1=INT, cropX2=INT, cropY2=INT, cropWidth=INT, cropHeight=INT, x1=INT, y1=INT,
    w=INT, h=INT, cropTopLeft=POINT, cropBottomRight=POINT, annotation=TEXT, savedAs=TEXT, nx1=DOUBLE, ny1=DOUBLE,
    nx2=DOUBLE, ny2=DOUBLE, designated=BOOL, crop_operations=T.ArrayType(CROP_OPERATION))

CROP_MANIFEST = struct(
    project=TEXT, user=TEXT, sourceDir=TEXT, sinkDir=TEXT, sessionId=TEXT, exportSequence=INT, defaultCropSize=SIZE,
    sessionFolderUtc=TEXT, exportedAtUtc=TEXT, count=INT, crops=T.ArrayType(CROP_RECORD), _corrupt_record=TEXT)

CURATION_ROW = struct(
    filename=TEXT, width=INT, height=INT, bytes=LONG, sha256=TEXT, dhash=LONG, var_laplacian=DOUBLE, mean_luma=DOUBLE,
    metric=TEXT, metric_value=TEXT, near_duplicate=BOOL, source_video=TEXT, timecode_sec=DOUBLE, decision=TEXT, reason=TEXT)

COCO_IMAGE = struct(id=LONG, file_name=TEXT, width=INT, height=INT)
COCO_CATEGORY = struct(id=LONG, name=TEXT, supercategory=TEXT)
COCO_ANNOTATION = struct(
    id=LONG, image_id=LONG, category_id=LONG, bbox=T.ArrayType(INT), area=DOUBLE, iscrowd=INT,
    segmentation=T.ArrayType(DOUBLE))

REGION = struct(x=DOUBLE, y=DOUBLE, width=INT, height=INT)
ROTATION_PLAN = struct(
    image_id=LONG, angle=INT, geometricParameters=T.MapType(TEXT, DOUBLE), cropRegions=T.ArrayType(REGION))

EXTRACTION_OPTIONS = struct(
    dropDuplicates=BOOL, advancedDropDuplicates=BOOL, useCustomMpdecimateParams=BOOL, mpdecimateHi=INT, mpdecimateLo=INT,
    mpdecimateFrac=DOUBLE, useUniformSampling=BOOL, uniformSamplingFps=DOUBLE, useSceneChanges=BOOL,
    sceneThreshold=DOUBLE, skipDarkFrames=BOOL, minLumaYavg=DOUBLE)
SEGMENT_MANIFEST = struct(
    videoPath=TEXT, sinkDirectory=TEXT, project=TEXT, user=TEXT, extractionOptions=EXTRACTION_OPTIONS, filterString=TEXT,
    segments=T.MapType(TEXT, struct(start=INT, end=INT, prefix=TEXT, isFull=BOOL)), _corrupt_record=TEXT)
SEGMENTS = struct(video_id=LONG, seg=INT, start_s=INT, end_s=INT, prefix=TEXT)
FRAMES = struct(video_id=LONG, frame_id=LONG, pts_s=DOUBLE, height=INT, width=INT, px=BYTES)

VOLUME_HEADER = struct(
    big_endian=BOOL, dim=T.ArrayType(SHORT), datatype=SHORT, bitpix=SHORT, vox_offset=LONG, pixdim=T.ArrayType(FLOAT),
    reject=TEXT)
VOLUME_SLICE = struct(volume_id=TEXT, z=INT, width=INT, height=INT, vox=T.ArrayType(DOUBLE))

DICOM_TAGS = struct(
    path=TEXT, parent=TEXT, patient_id=TEXT, study_date=TEXT, modality=TEXT, series_uid=TEXT, slice_location=DOUBLE,
    image_position=T.ArrayType(DOUBLE))

OBJECT_SUMMARY = struct(key=TEXT, size=LONG, last_modified=TIME)
