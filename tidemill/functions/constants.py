"""Fixed values of the media domain: extensions, names, screen sizes and thresholds."""

# File name extensions by kind.
PHOTO_EXTENSIONS = ("jpg", "jpeg", "jpe", "heic", "heif", "hif", "png", "gif", "webp", "tif", "tiff")
RAW_EXTENSIONS = ("dng", "cr2", "cr3", "nef", "arw", "orf", "rw2", "raf", "pef", "srw")
VIDEO_EXTENSIONS = ("mov", "mp4", "m4v", "3gp", "3g2")
SIDECAR_EXTENSIONS = ("aae", "xmp")
KINDS = {"photo": PHOTO_EXTENSIONS, "raw": RAW_EXTENSIONS, "video": VIDEO_EXTENSIONS, "sidecar": SIDECAR_EXTENSIONS}
MEDIA_KINDS = ("photo", "raw", "video")

# Names of system files, and folders that a walk leaves out.
JUNK_NAMES = (".ds_store", "thumbs.db", "desktop.ini")
JUNK_PREFIX = "._"
EXCLUDED_DIRS = ("@eaDir", "#recycle", "#snapshot", ".Trashes", ".Spotlight-V100", ".fseventsd", "$RECYCLE.BIN", "System Volume Information", "_tidemill_catalog", ".thumbnails", "@Recycle", "@Recently-Snapshot", ".TemporaryItems")
EXCLUDED_SUFFIXES = (".photoslibrary", ".lrdata")
TEMP_SUFFIX = ".tidemill-part"

# Categories in order of priority, with their confidence.
CATEGORIES = {"duplicates": "high", "screenshots": "high", "screen_recordings": "high", "short_videos": "medium", "no_camera_media": "low", "junk": "high", "blurry_dark": "low", "similar": "medium"}

# Patterns of names, and weights of what makes a name look like a copy's.
SCREEN_RECORDING = r"(?i)^RPReplay_Final\d+$"
EDITED_STEM = r"(?i)^(.*)_E(\d+)$"
NAME_PENALTIES = ((r"~\d+$", 4), (r"\s\(\d+\)$", 3), (r"\(\d+\)", 2), (r"(?i)(^|[\s_-])copy([\s_-]?\d+)?$", 3), (r"(?i)^copy of ", 3), (r"\d[-_ ]\d{1,2}$", 2), (r"(?i)[\s_-](dup|duplicate)$", 3))

# Portrait screen sizes of phones and tablets, in pixels.
SCREENS = (
    (640, 960), (640, 1136), (750, 1334), (1080, 1920), (1242, 2208), (1125, 2436), (1242, 2688), (828, 1792), (1170, 2532), (1080, 2340),
    (1284, 2778), (1179, 2556), (1290, 2796), (1206, 2622), (1320, 2868), (1260, 2736), (768, 1024), (1536, 2048), (1620, 2160), (1640, 2360),
    (1668, 2224), (1668, 2388), (1668, 2420), (2048, 2732), (2064, 2752), (720, 1280), (720, 1520), (720, 1600), (1080, 2160), (1080, 2220),
    (1080, 2280), (1080, 2400), (1440, 2560), (1440, 2960), (1440, 3040), (1440, 3120), (1440, 3200),
)

# Limits.
PARTIAL_BYTES = 65_536
LIVE_VIDEO_MS = 5_000
HEVC_SAVING = 0.45
NO_TIME = 1 << 62
