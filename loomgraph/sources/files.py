"""Source snapshots and artifacts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import BUILD_DIRECTORIES, IGNORED_DIRECTORIES, language_of


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """files(path, file_ord, lang, content, mtime) below a folder that Spark reads; undecodable bytes are dropped, unreadable files left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").load(root)
    top = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), f"^{_quoted(top)}/*", "")
    text = F.regexp_replace(F.decode("content", F.lit("UTF-8")), "�", "")
    return with_order(raw.select(path.alias("path"), text.alias("content"), F.col("modificationTime").alias("mtime")))


def with_order(files: DataFrame) -> DataFrame:
    """files with lang and, where it is missing, file_ord from the path's order: an order that needs no global sort."""
    if "file_ord" not in files.columns:
        files = files.withColumn("file_ord", F.lit(0))
    return files.withColumn("lang", language_of(F.col("path")))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def in_repository(path: Column, ignored: tuple[str, ...] = IGNORED_DIRECTORIES) -> Column:
    """Whether no directory of the path (its last part aside) is an ignored one."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in ignored]))


def within_root(path: Column, root: str, case_sensitive: bool = True) -> Column:
    """Whether a path is the root or below it; Windows roots are given with case_sensitive=False."""
    a, b = normal_path(path), root.replace("\\", "/").rstrip("/")
    a, b = (a, b) if case_sensitive else (F.lower(a), b.lower())
    return (a == b) | a.startswith(b + "/")


def normal_path(path: Column) -> Column:
    """Forward slashes, no trailing one."""
    return F.regexp_replace(F.regexp_replace(path, r"\\+", "/"), r"(?<=.)/+$", "")


def case_sensitive(root: str, rules: list[dict] | None = None, git_ignorecase: bool | None = None) -> bool:
    """A rule for the root decides, then the syntax of a Windows path, then git's own setting; else paths are case-sensitive."""
    for rule in rules or []:
        if root.replace("\\", "/").lower().startswith(str(rule.get("root", "")).replace("\\", "/").lower()):
            return bool(rule.get("case_sensitive", True))
    if root[1:2] == ":" or root.startswith("\\\\"):
        return False
    return not git_ignorecase if git_ignorecase is not None else True


def newest_artifact(listing: DataFrame, name: str, folders: tuple[str, ...] = ("", *BUILD_DIRECTORIES)) -> DataFrame:
    """path of the newest file `name` in the base folder or a build folder, from listing(path, mtime)."""
    places = [f"{f}/{name}".lstrip("/") for f in folders]
    return listing.where(F.col("path").isin(*places)).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"), F.max("mtime").alias("mtime")).where("path is not null")


def rewrite_root(text: Column, old: str, new: str, ignore_case: bool = False) -> Column:
    """A string with the root `old` replaced by `new` in either slash style, at path boundaries only."""
    old = old.replace("\\", "/").rstrip("/")
    out = text
    for style in ("/", "\\"):
        find = _quoted(old.replace("/", style))
        put = new.replace("\\", "/").rstrip("/").replace("/", style).replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, f"{'(?i)' if ignore_case else ''}(?:(?<![A-Za-z0-9_.-])|(?<=\\s-[A-Za-z]|^-[A-Za-z]|-isystem|-iquote|-include)){find}(?![A-Za-z0-9_.-])", put)
    return out
