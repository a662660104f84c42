"""Java sources, git, configuration and specifications as tables."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exclude_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + ("[^/]*" if glob[i] == "*" else re.escape(glob[i])), i + 1
    return out


def java_files(spark: SparkSession, roots: list[str], excludes: tuple[str, ...] = ()) -> DataFrame:
    """(path, content, modified) of every .java file below the roots; a root that does not exist has none."""
    have = [r for r in roots if Path(r).exists() or "://" in r]
    if not have:
        return spark.createDataFrame([], "path string, content string, modified timestamp")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(have)
    for g in excludes:
        df = df.where(~F.col("path").rlike(exclude_regex(g)))
    return df.select(F.regexp_replace("path", "^file:", "").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def stream_java(spark: SparkSession, root: str) -> DataFrame:
    """The same as a stream; every new or rewritten file comes once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(root)
    return df.select(F.regexp_replace("path", "^file:", "").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def _git(repo: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
    return done.stdout.splitlines() if done.returncode == 0 else []


def git_changed(spark: SparkSession, repo: str, ref: str = "HEAD") -> DataFrame:
    rows = [(p,) for p in _git(repo, "diff", "--name-only", ref) if p.endswith(".java")]
    return spark.createDataFrame(rows, "path string")


def git_log(spark: SparkSession, repo: str, path: str) -> DataFrame:
    rows = [(path, *x.split("|", 3)) for x in _git(repo, "log", "--format=%H|%ae|%aI|%s", "--follow", "--", path)]
    return spark.createDataFrame(rows, "path string, sha string, author string, at string, subject string")


def config(path: str) -> dict:
    """The YAML configuration with its defaults; {} defaults only where the file is missing."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) if Path(path).exists() else {}
    arch = (raw or {}).get("architecture") or {}
    return {
        "source_roots": (raw or {}).get("sourceRoots") or ["."], "excludes": (raw or {}).get("excludes") or [], "layers": arch.get("layers") or [], "rules": arch.get("rules") or [],
        "endpoints": arch.get("endpointAnnotations") or [], "invokers": arch.get("invokers") or [], "chain_stop_methods": arch.get("chainStopMethods") or [],
    }


def spec(spark: SparkSession, path: str) -> DataFrame:
    """(class, name, signature, throws, annotations) of a Markdown specification."""
    cls, rows = "", []
    for line in Path(path).read_text().splitlines():
        if m := re.match(r"#\s+(\S+)", line):
            cls = m[1]
        elif m := re.match(r"(?:###\s+|-\s+)`?([^`*]+\))`?", line):
            name = re.search(r"([\w$]+)\s*\(", m[1])
            if name:
                rows.append((cls, name[1], m[1].strip(), [], []))
        elif rows and (m := re.match(r"(?i)\s*-\s+\*\*(throws|annotation)s?(?::\*\*|\*\*:?)\s*(.*)", line)):
            throws = m[1].lower() == "throws"
            for x in (m[2] if throws else re.sub(r"\([^)]*\)", "", m[2])).split(","):
                if x := x.strip(" `@"):
                    rows[-1][3 if throws else 4].append(x if throws else x.rsplit(".", 1)[-1])
    return spark.createDataFrame(rows, "class string, name string, signature string, throws array<string>, annotations array<string>")
