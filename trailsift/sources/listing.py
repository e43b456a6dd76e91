"""SRC-1 / SRC-3: which files the arguments name.

Spark's file index lists all arguments in one read (in tasks of its own from 32 folders on); names and
their arguments stay in DataFrames. The driver asks the file system once or twice per argument, never per file:
whether an argument matches anything, and which of its matches have names that Spark never lists
(leading ``_`` or ``.``), which come back as one text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_glob(path: str) -> bool:
    return "*" in path or "?" in path


def literal_glob(path: str) -> str:
    """The path as a glob that matches itself only."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def glob_regex(glob: str) -> str:
    """A regular expression for whole paths from a file-system glob (no part of it crosses a ``/``)."""
    out, braces, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c in "*?":
            out.append("[^/]*" if c == "*" else "[^/]")
        elif end > 0:
            body = glob[i + 1:end].replace("\\", "\\\\")
            out.append("[^" + body[1:] + "]" if body[0] in "!^" else "[" + body + "]")
            i = end
        elif c == "{" and "}" in glob[i:]:
            out.append("(?:")
            braces += 1
        elif c == "}" and braces:
            out.append(")")
            braces -= 1
        elif c == "," and braces:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def _hidden_globs(glob: str, whole: bool) -> list[str]:
    """Globs of the names with a leading ``_`` or ``.`` among what ``glob`` matches, and inside its folders."""
    folder, _, last = glob.rpartition("/")
    found = [f"{glob}/[_.]*"]
    if not whole and last.startswith(("_", ".")):
        found.append(glob)
    elif not whole and last.startswith("*"):
        found.append(f"{folder}/[_.]{last}")
    elif not whole and last.startswith("?"):
        found.append(f"{folder}/[_.]{last[1:]}")
    return found


class Listing:
    """What the arguments of an ingest name: globs to read, and hidden names that are not read."""

    def __init__(self, spark: SparkSession, patterns: list[str]):
        self.spark = spark
        #: (argument number, qualified path or glob, as a glob, is a glob) of each argument that matches something
        self.arguments: list[tuple[int, str, str, bool]] = []
        self.hidden: set[str] = set()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        util = jvm.org.apache.spark.deploy.SparkHadoopUtil.get()
        for number, pattern in enumerate(patterns):
            if not pattern:
                continue
            path = jvm.org.apache.hadoop.fs.Path(pattern)
            fs = path.getFileSystem(conf)
            name = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
            glob = name if is_glob(pattern) else literal_glob(name)
            if util.globPath(fs, jvm.org.apache.hadoop.fs.Path(glob)).isEmpty():
                continue
            own = not is_glob(pattern) and name.rpartition("/")[2].startswith(("_", "."))
            own = own and not fs.getFileStatus(path).isDirectory()  # a file that Spark doesn't read
            for hidden in [glob] if own else _hidden_globs(glob, not is_glob(pattern)):
                names = util.globPath(fs, jvm.org.apache.hadoop.fs.Path(hidden)).mkString("\n").split("\n")
                self.hidden.update(n for n in names if n and (
                    not hidden.endswith("/[_.]*") or n.lower().endswith(".json")))
            if not own:
                self.arguments.append((number, name, glob, is_glob(pattern)))

    def files(self) -> DataFrame:
        """(file, length, arg, matched, from_dir): a row for each argument that names the file, or its folder."""
        read = self.read("binaryFile").select(F.col("path").alias("file"), "length").distinct()
        parent = F.regexp_replace("file", "/[^/]*$", "")
        in_dir = F.lower("file").endswith(".json")
        globs = [(number, glob) for number, _, glob, many in self.arguments if many]
        plain = [(number, name) for number, name, _, many in self.arguments if not many]
        parts = []
        if globs:
            hits: list[Column] = []
            for number, glob in globs:
                regex = F.lit(glob_regex(glob))
                hits.append(F.when(F.regexp_like("file", regex), F.struct(
                    F.lit(number).alias("arg"), F.col("file").alias("matched"), F.lit(False).alias("from_dir"))))
                hits.append(F.when(in_dir & F.regexp_like(parent, regex), F.struct(
                    F.lit(number).alias("arg"), parent.alias("matched"), F.lit(True).alias("from_dir"))))
            parts.append(read.select("file", "length", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
                         .select("file", "length", "hit.*"))
        if plain:
            named = self.spark.createDataFrame(pa.table({"arg": pa.array([n for n, _ in plain], pa.int32()),
                                                         "matched": [p for _, p in plain]}))
            parts.append(read.withColumn("matched", F.col("file")).join(named, "matched")
                         .select("file", "length", "arg", "matched", F.lit(False).alias("from_dir")))
            parts.append(read.filter(in_dir).withColumn("matched", parent).join(named, "matched")
                         .select("file", "length", "arg", "matched", F.lit(True).alias("from_dir")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def read(self, kind: str, **options: str) -> DataFrame:
        """One read of all arguments; files in folders below theirs are pruned before they are opened."""
        found = self.spark.read.format(kind).options(recursiveFileLookup="true", **options).load(
            sorted({glob for _, _, glob, _ in self.arguments}))
        # Globs don't cross "/": a file's depth tells whether it can be a match or lie in a matching folder.
        depths = sorted({name.count("/") + more for _, name, _, _ in self.arguments for more in (0, 1)})
        depth = F.length("_metadata.file_path") - F.length(F.regexp_replace("_metadata.file_path", "/", ""))
        return found.filter(depth.isin(depths))
