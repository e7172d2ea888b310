"""Sources and sinks: note trees, JSON-line ledgers, transcripts, source trees, audit exports, and a pluggable document source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from inkgrove.functions.scalars import glob_regex

MAX_FILE_BYTES = 1 << 20
#: Keys a note's head may have.
HEAD_KEYS = ("id", "name", "ring", "kind", "created", "updated", "tags", "links", "bereich", "retention", "supersedes", "superseded_by", "valid_from", "invalid_at", "pii", "anchors")
_LISTS = ("tags", "links", "supersedes", "anchors")
_LOCKFILES = r"(?:^|/)(?:package-lock\.json|yarn\.lock|Cargo\.lock|poetry\.lock|go\.sum|uv\.lock)$"


def parse_note(text: str | None) -> dict:
    """Head and body of a note, or the reason why it is none under "error". The body keeps every byte."""
    t = (text or "").removeprefix("﻿").replace("\r\n", "\n") if text and "\r\n" in text.split("\n---", 1)[0] else (text or "").removeprefix("﻿")
    m = re.match(r"---\n(.*?)(?:^|\n)---(?:\n|\Z)", t, re.S)
    if not m:
        return {"error": "no head"}
    head: dict = {}
    key = None
    for line in m[1].splitlines():
        if not line.strip():
            continue
        if (item := re.match(r"\s+- (.*)$|- (.*)$", line)) and key in _LISTS:
            head.setdefault(key, []).append((item[1] or item[2]).strip().strip("\"'"))
            continue
        field = re.match(r"([a-z_]+):\s*(.*)$", line)
        if not field:
            return {"error": f"unreadable line: {line.strip()[:40]}"}
        key, value = field[1], field[2].strip()
        if key not in HEAD_KEYS:
            return {"error": f"unknown key: {key}"}
        if key in head:
            return {"error": f"key twice: {key}"}
        if key in _LISTS:
            head[key] = [x.strip().strip("\"'") for x in value.strip("[]").split(",") if x.strip()] if value else []
        elif value:
            head[key] = value.strip("\"'")
    for need in ("id", "name", "ring"):
        if need not in head:
            return {"error": f"missing key: {need}"}
    if head["ring"] not in ("0", "1", "2", "3", "4"):
        return {"error": "ring is not 0 to 4"}
    return {**head, "ring": int(head["ring"]), "body": t[m.end() :]}


def render_note(head: dict, body: str) -> str:
    """The inverse of parse_note()."""
    lines = []
    for key in HEAD_KEYS:
        value = head.get(key)
        if value is None or value == []:
            continue
        lines += [f"{key}:", *(f"  - {x}" for x in value)] if isinstance(value, list) else [f"{key}: {value}"]
    return "---\n" + "\n".join(lines) + "\n---\n" + body


NOTE_SCHEMA = "path string, id string, name string, ring int, kind string, created string, updated string, tags array<string>, links array<string>, bereich string, retention string, supersedes array<string>, superseded_by string, valid_from string, invalid_at string, pii string, anchors array<string>, body string, error string"


def parse_notes(files: DataFrame) -> DataFrame:
    """Notes of files (path, content); a file that is none has its reason in error and nothing else."""
    columns = [c.split()[0] for c in NOTE_SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"path": p} | parse_note(t) for p, t in zip(frame["path"], frame["content"])]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="Int32" if c == "ring" else object) for c in columns})

    return files.select("path", "content").mapInPandas(run, NOTE_SCHEMA)


def note_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, skipped): Markdown files under r0 to r4; others with the reason they are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.try_element_at(F.split("path", "/"), F.lit(-2))
    reason = F.when(name.startswith("."), "hidden").when(~name.endswith(".md"), "not markdown").when(~folder.rlike("^r[0-4]$"), "not in a ring folder").when(~name.rlike(r"^[a-z0-9ß-ɏ]+(?:-[a-z0-9ß-ɏ]+)*\.md$"), "bad name")
    return files.select("path", F.decode("content", "UTF-8").alias("content"), reason.alias("skipped"))


def _ignore_pattern(rule: str) -> str:
    folder = rule.rstrip("/")
    folder = "/" + folder.lstrip("/") if "/" in folder else folder  # a rule with a / inside starts at the root
    inside = f"(?:{glob_regex(folder + '/**')})"
    return inside if rule.endswith("/") else f"(?:{glob_regex(folder)})|{inside}"


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules leave a path out: the last rule that matches decides, one with ! takes back; a rule that ends in / is of a folder and all in it."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            out = F.when(path.rlike(_ignore_pattern(rule.removeprefix("!"))), F.lit(not rule.startswith("!"))).otherwise(out)
    return out


def source_files(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """(path, content, skipped): files of a source tree; ignored, too large, lock and binary files with the reason. Contents of files
    that are too large are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").removeprefix("file:")) + "/", "")
    left_out = F.when(ignored(inside, rules or []), "ignored")
    large = files.where(F.col("length") > MAX_FILE_BYTES).select("path", F.lit(None).cast("string").alias("content"), F.coalesce(left_out, F.lit("too large")).alias("skipped"))
    reason = left_out.when(F.col("path").rlike(_LOCKFILES), "lock file").when(F.instr(F.decode(F.substring("content", 1, 8000), "ISO-8859-1"), "\x00") > 0, "binary")
    small = files.where(F.col("length") <= MAX_FILE_BYTES).select("path", F.when(reason.isNull(), F.decode("content", "UTF-8")).alias("content"), reason.alias("skipped"))
    return small.unionByName(large)


def counted_apart(spark: SparkSession, root: str) -> int:
    """How many files a tree has by the file system's own listing, to hold an import's ledger against."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing, n = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), 0
    while listing.hasNext():
        n += not listing.next().getPath().getName().startswith(("_", "."))
    return n


def skip_counts(files: DataFrame) -> DataFrame:
    """(skipped, extension, n) of the files left out."""
    return files.where("skipped is not null").groupBy("skipped", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("extension")).agg(F.count("*").alias("n"))


LEDGER_SCHEMA = "at string, op string, unit string, returned bigint, full bigint, hits bigint, sources array<string>"


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER_SCHEMA) -> DataFrame:
    """A JSON-lines ledger with its unreadable lines in _corrupt; they are to be counted, not lost."""
    return spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, role, text) of session lines: text parts joined, tool calls as [used name], tool results and meta lines left out."""
    part = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("type", "text", "name")]))
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("isMeta", T.BooleanType()), T.StructField("message", T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))])
    rows = spark.read.schema(schema).json(path).withColumn("file", F.col("_metadata.file_path")).where("not coalesce(isMeta, false) and message is not null")
    parts = F.from_json("message.content", part)
    shown = F.transform(parts, lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"] == "tool_use", F.concat(F.lit("[used "), p["name"], F.lit("]"))))
    text = F.when(F.col("message.content").startswith("["), F.array_join(F.array_compact(shown), "\n")).otherwise(F.col("message.content"))
    return rows.select("file", F.col("message.role").alias("role"), F.trim(F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", "")).alias("text")).where("text <> ''")


def write_log(log: DataFrame, path: str, kind: str = "json") -> None:
    """An audit log as JSON lines or tab-separated text; nested fields as JSON text in the latter."""
    if kind == "json":
        log.write.json(path)
    else:
        nested = [f.name for f in log.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        log.withColumns({c: F.to_json(c) for c in nested}).write.csv(path, sep="\t", header=True)


class MarkdownSource(DataSource):
    """spark.read.format("inkgrove_documents").load(folder): (path, locator, text) of each part of Markdown files.

    A pluggable source: override parts() for other formats. Files are read on the executors."""

    @classmethod
    def name(cls) -> str:
        return "inkgrove_documents"

    def schema(self) -> str:
        return "path string, locator string, text string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _MarkdownReader(self.options["path"], type(self))

    @staticmethod
    def accepts(path: str) -> bool:
        return path.lower().endswith((".md", ".markdown"))

    @staticmethod
    def parts(text: str) -> Iterator[tuple[str | None, str]]:
        for section in re.split(r"(?m)(?=^#{1,6}[ \t])", text):
            if section.strip():
                heading = re.match(r"#{1,6}[ \t]+(.*)", section)
                yield (heading[1].strip() if heading else None), section


class _MarkdownReader(DataSourceReader):
    def __init__(self, root: str, source: type[MarkdownSource]):
        self.root, self.source = root, source

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(self.root) if "://" in self.root else (pafs.LocalFileSystem(), self.root)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return [InputPartition(i.path) for i in sorted(found, key=lambda i: i.path) if i.is_file and self.source.accepts(i.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs = pafs.FileSystem.from_uri(self.root)[0] if "://" in self.root else pafs.LocalFileSystem()
        with fs.open_input_stream(partition.value) as f:
            text = f.read().decode("utf-8", "replace")
        for locator, part in self.source.parts(text):
            yield partition.value, locator, part
