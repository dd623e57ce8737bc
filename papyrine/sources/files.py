"""Documents as rows: files, directories and bytes, with checks; sinks for results."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import error

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, modificationTime, length, content of each file named."""
    return spark.read.format("binaryFile").load(path)


def ignore_pattern(lines: list[str], base: str = "") -> list[tuple[bool, str, bool]]:
    """(ignored, regular expression on the relative path, directories only) of each ignore rule, in order.

    The usual rules of ignore files: ``#`` comments, ``!`` takes back, a leading or inner ``/`` anchors, a trailing
    ``/`` means directories, ``**`` crosses them. base: the directory of the file, relative to the root.
    """
    out = []
    for line in lines:
        rule = line.rstrip("\n").rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule.removeprefix("!").removeprefix("\\")
        folder = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        parts = [re.sub(r"\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(p)).replace(".*", "[^/]*").replace("(?>", "(?:") if p != "**" else "**" for p in rule.lstrip("/").split("/")]
        body = "/".join(parts).replace("/**/", "/(?:.*/)?")
        body = re.sub(r"^\*\*/", "(?:.*/)?", body)
        body = re.sub(r"/\*\*$", "/.*", body)
        prefix = re.escape(base.strip("/")) + "/" if base.strip("/") else ""
        out.append((not keep, rf"^{prefix}{'' if anchored else '(?:.*/)?'}{body}$", folder))
    return out


def not_ignored(relative: Column, rules: list[str] | list[tuple[bool, str, bool]] | None = None, hidden: bool = False) -> Column:
    """Whether a relative path is walked: no part is hidden (a leading dot), neither it nor a directory above is ignored.

    rules: lines of an ignore file at the root, or what ignore_pattern makes of several; the last that matches decides.
    What lies in an ignored directory can't be taken back.
    """
    rules = rules or []
    found = ignore_pattern(rules) if rules and isinstance(rules[0], str) else rules
    out = F.lit(True) if hidden else ~relative.rlike(r"(^|/)\.[^/]")
    if not found:
        return out
    parts = F.split(relative, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))

    def ignored(path: Column) -> Column:
        chain = F
        for ignore, pattern, folder in reversed(found):
            chain = chain.when(path.rlike(pattern) & (path != relative) if folder else path.rlike(pattern), F.lit(ignore))
        return chain.otherwise(F.lit(False))

    return out & ~F.exists(above, ignored)


def ignore_files(spark: SparkSession, root: str) -> list[tuple[bool, str, bool]]:
    """The rules of all ``.gitignore`` files from root on, where it lies in a git repository, then of all ``.ignore`` files.

    Deeper files come later and so decide before those above. One glob for each depth finds them, without a listing
    of the files to the driver. Ignore files above root aren't read.
    """
    jvm, root = spark.sparkContext._jvm, root.rstrip("/")
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at, git = path(root), False
    while at is not None and not git:
        git, at = fs.exists(path(at, ".git")), at.getParent()
    by_name: dict[str, list] = {".gitignore": [], ".ignore": []}
    base = len(fs.makeQualified(path(root)).toUri().getPath().rstrip("/"))
    stars = ""
    while found := fs.globStatus(path(f"{root}{stars}/*")):
        for name in by_name if git else [".ignore"]:
            for x in fs.globStatus(path(f"{root}{stars}/{name}")) or []:
                where = x.getPath().getParent().toUri().getPath()[base:]
                by_name[name] += ignore_pattern(_lines(spark, x.getPath().toString()), where)
        stars += "/*"
        if not len(found):
            break
    return by_name[".gitignore"] + by_name[".ignore"]


def read_directory(spark: SparkSession, root: str, rules: list[str] | None = None, hidden: bool = False) -> DataFrame:
    """path, relative, modificationTime, length, content of the files under root that no rule ignores.

    rules are the lines of an ignore file at the root; where none are given those of ``ignore_files`` hold. Rows
    aren't sorted: sort a result by path where its order shows. Spark's readers also skip names with a leading
    underscore.
    """
    found = ignore_files(spark, root) if rules is None else ignore_pattern(rules)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z]+:(//[^/]*)?", ""), f"^/*{re.escape(base.lstrip('/'))}/", "")
    return files.withColumn("relative", relative).filter(not_ignored(F.col("relative"), found, hidden))


def _lines(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    stream = fs.open(p)  # Spark's readers skip names with a leading dot
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()


def checked(files: DataFrame) -> DataFrame:
    """files with an error column: NoContents where there are no bytes, Io where they are missing."""
    problem = F.when(F.col("content").isNull(), error("Io", None, "content can't be read")).when(F.length("content") == 0, error("NoContents", None, "document has no contents"))
    return files.withColumn("error", problem)


def write_json(results: DataFrame, path: str) -> None:
    """One JSON object a line, without null fields."""
    results.write.json(path)


def write_text(results: DataFrame, path: str, text: str = "text") -> None:
    """The texts alone, with no break after them; a row without a text fails, as there is nothing to write."""
    checked_text = F.coalesce(F.col(text), F.raise_error(F.lit("no text to write")).cast("string"))
    results.select(checked_text.alias("value")).write.option("lineSep", "\u0000").text(path)
