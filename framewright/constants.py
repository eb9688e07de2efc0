"""Fixed values that results depend on (thresholds, codes, default texts)."""

# Image file suffixes and first bytes, volume suffixes, DICOM magic.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "gif")
IMAGE_SIGNATURES = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"BM")
VOLUME_EXTENSIONS = ("nii", "nii.gz")
DICOM_MAGIC = "DICM"
DICOM_MAGIC_OFFSET = 128
DICOM_MIN_BYTES = 132

# Curation defaults.
BLUR_THRESHOLD = 120.0
MIN_LUMA = 20.0
FOCUS_PRESETS = (("loose", 80.0), ("medium", 120.0), ("strict", 180.0))

# Near-duplicate presets (name, dHash at most, PSNR at least, SSIM at least).
SIMILARITY_PRESETS = (
    ("Loose", 8, 35.0, 0.95),
    ("Medium", 5, 40.0, 0.98),
    ("Strict", 3, 45.0, 0.99),
)

# Crop levels (level, tiles per side).
CROP_LEVELS = ((0, 1), (1, 2), (2, 4))

# Volume view and slice content limits.
MIN_VIEW_SIDE = 64
MAX_VIEW_ASPECT = 4.0
MIN_SLICE_STDDEV = 5.0
DARK_LEVEL = 10
MAX_DARK_SHARE = 0.95

# Voxel type codes (code, name, numpy type or None where values are not decoded).
VOXEL_TYPES = (
    (0, "none", None),
    (1, "binary", None),
    (2, "uint8", "u1"),
    (4, "int16", "i2"),
    (8, "int32", "i4"),
    (16, "float32", "f4"),
    (32, "complex64", None),
    (64, "float64", "f8"),
    (128, "rgb", None),
    (255, "all", None),
    (512, "uint16", "u2"),
    (768, "uint32", None),
    (1024, "int64", None),
    (1280, "uint64", None),
    (1536, "float128", None),
    (1792, "complex128", None),
    (2048, "complex256", None),
)

# Video extraction defaults.
DECIMATE_HI = 512
DECIMATE_LO = 192
DECIMATE_FRAC = 0.30
SCENE_THRESHOLD = 0.02
MIN_FRAME_LUMA = 20.0
UNIFORM_FPS = 1.0
SEGMENT_PREFIX = "Frame_"

# Rotation angles in degrees.
ROTATION_ANGLES = tuple(range(0, 91, 10))

# Curation CSV header.
CURATION_HEADER = (
    "filename", "width", "height", "bytes", "sha256", "dhash", "var_laplacian", "mean_luma",
    "metric", "metric_value", "near_duplicate", "source_video", "timecode_sec", "decision", "reason",
)
