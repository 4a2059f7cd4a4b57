"""Names and paths as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemill.functions import constants as C


@F.pandas_udf(StringType())
def nfc(names: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfd(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """All before the last slash, '' without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def top_folder(path: Column) -> Column:
    """The first component of a path, '' for a file that stands in no folder."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("")


def has_ext(name: Column) -> Column:
    return name.rlike(r"^.+\.[^.]*$")


def stem(name: Column) -> Column:
    """The name up to its last dot; a dotfile with one dot is all stem."""
    return F.when(has_ext(name), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def ext(name: Column) -> Column:
    return F.when(has_ext(name), F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))).otherwise("")


def kind(extension: Column) -> Column:
    """photo, raw, video, sidecar or other."""
    out = F.lit("other")
    for name, extensions in C.KINDS.items():
        out = F.when(extension.isin(*extensions), name).otherwise(out)
    return out


def is_excluded_dir(name: Column) -> Column:
    out = name.isin(*C.EXCLUDED_DIRS)
    for suffix in C.EXCLUDED_SUFFIXES:
        out = out | F.lower(name).endswith(suffix)
    return out


def is_temp_file(name: Column) -> Column:
    return name.endswith(C.TEMP_SUFFIX)


def name_penalty(stem: Column) -> Column:
    """How much a name looks like a copy's: the sum of the weights of the patterns found in it."""
    out = F.lit(0)
    for pattern, weight in C.NAME_PENALTIES:
        out = out + F.when(stem.rlike(pattern), weight).otherwise(0)
    return out


def suffixed(name: Column, n: Column) -> Column:
    """stem~n.ext, or name~n where there is no extension; n under 2 leaves the name."""
    plain = ext(name) == ""
    dotted = F.concat(stem(name), F.lit("~"), n.cast("string"), F.lit("."), F.substring_index(name, ".", -1))
    return F.when(n < 2, name).when(plain, F.concat(name, F.lit("~"), n.cast("string"))).otherwise(dotted)


def suffixed_name(name: str, n: int) -> str:
    """`suffixed` for one name."""
    head, dot, tail = name.rpartition(".")
    if n < 2:
        return name
    return f"{head}~{n}.{tail}" if dot and head and tail else f"{name}~{n}"


def ancestors(folder: Column) -> Column:
    """All folders from the top down to `folder` itself; none for ''."""
    parts = F.split(folder, "/")
    return F.when(folder != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def in_folder(folder: Column, within: str, recursive: bool = True) -> Column:
    """Whether `folder` is `within` or, recursively, under it; '' is everything. Compared literally and with case."""
    if not within:
        return F.lit(True) if recursive else folder == ""
    return (folder == within) | folder.startswith(within + "/") if recursive else folder == within


def nocase(name: Column) -> Column:
    """ASCII letters in lower case, others as they are: the key of a case-blind order."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_phone_screen(width: Column, height: Column) -> Column:
    """Whether width and height, either way round, are a phone's or tablet's. Null and 0 are not."""
    pair = F.concat_ws("x", F.least(width, height).cast("long"), F.greatest(width, height).cast("long"))
    return F.coalesce((width > 0) & (height > 0) & pair.isin(*[f"{w}x{h}" for w, h in C.SCREENS]), F.lit(False))
