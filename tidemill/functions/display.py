"""Texts for people: reasons, sizes and savings."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.constants import HEVC_SAVING

# Reason templates; a number's format stands in the placeholder as printf has it.
REASONS = {
    "duplicate_of": ("Exact copy of %s", ["keeper"]),
    "screenshot_comment": ('EXIF UserComment says "Screenshot"', []),
    "screenshot_resolution": ("PNG without camera data at a phone screen size (%s×%s)", ["width", "height"]),
    "screen_recording_name": ("File name looks like an iOS screen recording", []),
    "screen_recording_resolution": ("Video without camera data at a phone screen size (%s×%s)", ["width", "height"]),
    "short_video": ("Video is %.1f s long (threshold %.0f s)", ["seconds", "threshold"]),
    "no_camera": ("No camera make or model in metadata", []),
    "junk_name": ("System or metadata file", []),
    "junk_empty": ("File is empty (0 bytes)", []),
    "junk_broken": ("File cannot be decoded (%s)", ["detail"]),
    "junk_orphan_aae": (".AAE edit sidecar without its photo", []),
    "junk_aae": (".AAE edit sidecar (option: move all)", []),
    "blurry": ("Very low sharpness (%.1f < %.1f)", ["sharpness", "threshold"]),
    "dark": ("Almost black frame (mean brightness %.0f%%)", ["percent"]),
    "similar_member": ("Looks like %s taken %.0f s apart", ["keeper", "delta"]),
    "similar_keeper": ("Best shot of group %s", ["group"]),
}


# The same templates in Russian, with the same places in the same order.
REASONS_RU = {
    "duplicate_of": "Точная копия %s",
    "screenshot_comment": "В EXIF UserComment записано «Screenshot»",
    "screenshot_resolution": "PNG без данных камеры с разрешением экрана телефона (%s×%s)",
    "screen_recording_name": "Имя файла как у записи экрана iOS",
    "screen_recording_resolution": "Видео без данных камеры с разрешением экрана телефона (%s×%s)",
    "short_video": "Длительность %.1f с (порог %.0f с)",
    "no_camera": "В метаданных нет производителя и модели камеры",
    "junk_name": "Системный или служебный файл",
    "junk_empty": "Пустой файл (0 байт)",
    "junk_broken": "Файл не декодируется (%s)",
    "junk_orphan_aae": "Файл правок .AAE без фотографии",
    "junk_aae": "Файл правок .AAE (опция «все .AAE»)",
    "blurry": "Очень низкая резкость (%.1f < %.1f)",
    "dark": "Почти чёрный кадр (средняя яркость %.0f%%)",
    "similar_member": "Похож на %s, снят с разницей %.0f с",
    "similar_keeper": "Лучший кадр группы %s",
}
LANGUAGES = ("en", "ru")


def template_of(name: str, lang: str = "en") -> str:
    """A reason's template; English where a language has none."""
    return REASONS_RU.get(name, REASONS[name][0]) if lang == "ru" else REASONS[name][0]


def places(template: str, k: int) -> int:
    """Decimals that the placeholder number `k` of a template shows."""
    return 1 if re.findall(r"%(?:\.\d)?[sf]", template)[k] == "%.1f" else 0


def reason_text(key: Column, params: Column, lang: str = "en") -> Column:
    """The text of a reason in a language; `params` maps names to strings. An unknown key is shown itself. Ties round to even, as in printf."""
    out = key
    for name, (_, wanted) in REASONS.items():
        template = template_of(name, lang)
        if wanted:
            numeric = [w in ("seconds", "threshold", "sharpness", "percent", "delta") for w in wanted]
            values = [F.bround(params[w].try_cast("double"), places(template, wanted.index(w))) if n else params[w] for w, n in zip(wanted, numeric, strict=True)]
            text = F.format_string(template, *values)
        else:
            text = F.lit(template)
        out = F.when(key == name, text).otherwise(out)
    return out


UNITS = ("KB", "MB", "GB", "TB")


def human_bytes(size: Column, largest: str = "TB") -> Column:
    """Steps of 1024 up to the unit `largest`; bytes without decimals, others with one. Null stays null."""
    powers = range(1, UNITS.index(largest) + 2)
    *steps, out = [F.format_string(f"%.1f {unit}", F.bround(size / float(1 << 10 * power), 1)) for power, unit in zip(powers, UNITS, strict=False)]
    for power, text in reversed(list(zip(powers, steps, strict=False))):
        out = F.when(size < (1 << 10 * (power + 1)), text).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).when(size.isNotNull(), out)


def hevc_saving(size: Column, codec: Column) -> Column:
    """What H.264 video would save in HEVC, in whole bytes; other codecs nothing."""
    return F.when(codec == "h264", F.floor(size * HEVC_SAVING)).otherwise(0).cast("long")


def format_eta(seconds: float | None) -> str:
    if seconds is None or seconds < 0:
        return "?"
    whole = int(seconds)
    if whole < 60:
        return f"{whole}s"
    if whole < 3600:
        return f"{whole // 60}m {whole % 60:02d}s"
    return f"{whole // 3600}h {whole % 3600 // 60:02d}m"


def bytes_text(size: float) -> str:
    """`human_bytes` of one number."""
    if size < 1024:
        return f"{int(size)} B"
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        if size < 1 << 10 * (power + 1):
            return f"{size / (1 << 10 * power):.1f} {unit}"
    return f"{size / (1 << 40):.1f} TB"
