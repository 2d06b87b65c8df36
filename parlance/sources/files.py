"""Sources and sinks: CSV, JSON, audio folders, manifests and reports."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import lexicon
from parlance.operators.batches import batched
from parlance.operators.naming import col
from parlance.operators.position import in_files
from parlance.session import bounded, folder, remove
from parlance.sources import wav

PAIRS = "hypothesis string, reference string"
MANIFEST = "audio string, reference string"
AUDIO = "{*.wav,*.mp3,*.flac}"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: A null in a file whose rows are lines; texts have two backslashes there.
NULL = "\\N"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, required: tuple[str, ...] = (), one_line: bool = False) -> DataFrame:
    """CSV with a header; quotes are doubled inside quoted cells, which may span lines. With `schema`, nothing is inferred.

    A cell that spans lines keeps a file in one task. `one_line` says that no cell does, as `write_csv` has it with the
    same parameter: then a file of any size is read in splits.

    An empty cell is null, and a quoted empty one the empty text.
    """
    # a null mark that no text has: the default one would also take quoted empty cells
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": not one_line, "enforceSchema": False, "nullValue": NULL if one_line else "\0"}
    reader = spark.read.options(**options)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if one_line:
        # select keeps `_metadata` of the scan within reach
        df = df.select(*(_unescaped(col(c)).alias(c) if t == "string" else col(c) for c, t in df.dtypes))
    return require_columns(df, *required)


def _escaped(c: Column) -> Column:
    """Line ends, and the backslashes that mark them, as two letters; a mark before a blank cell, as a blank line counts as none."""
    c = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(c.rlike(r"^[\x00-\x20]+$"), F.concat(F.lit("\\e"), c)).otherwise(c)


def _unescaped(c: Column) -> Column:
    # two backslashes are put aside as a letter that no text has, or that stays as it is behind a mark of its own
    aside = F.replace(F.replace(c, F.lit("\0"), F.lit("\0" + "0")), F.lit("\\\\"), F.lit("\0" + "1"))
    lines = F.replace(F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\\e"), F.lit(""))
    return F.replace(F.replace(lines, F.lit("\0" + "1"), F.lit("\\")), F.lit("\0" + "0"), F.lit("\0"))


def read_json(spark: SparkSession, path: str, schema: str = PAIRS) -> DataFrame:
    """A JSON array of objects, or an object a line, as `write_json` has them; a missing reference is the empty text.

    The first line with text decides: a whole object means that each line is one, and large files can be split;
    so can the parts of an array that `write_array` wrote.
    """
    if (first := _first_part(spark, path)) and [r.value for r in spark.read.text(first).limit(2).collect()] == ["["]:
        lines = spark.read.text(path).where(~F.col("value").isin("[", "]"))
        df = lines.select(F.from_json(F.regexp_replace("value", "^,", ""), schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")
        return df.fillna("", ["reference"]) if "reference" in df.columns else df
    line = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").rlike(r"(?s)^\{.*\}$").alias("whole")).first()
    df = spark.read.schema(schema).option("multiLine", not (line and line.whole)).json(path)
    return df.fillna("", ["reference"]) if "reference" in df.columns else df


def _first_part(spark: SparkSession, path: str) -> str | None:
    """The first file of a folder that Spark wrote in parts."""
    parts = [p for p in spark.read.text(path).inputFiles() if p.rpartition("/")[2].startswith("part-")]
    return min(parts, default=None)


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["hypothesis"], r.get("reference", "")) for r in rows], PAIRS)


def from_columns(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))


def list_audio(spark: SparkSession, folder: str, pattern: str = AUDIO) -> DataFrame:
    """`file, path` of the matching files by name; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "path").orderBy("file")


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    """Samples between -1 and 1 (of one channel, or samples by channels) as a 16-bit PCM WAV file."""
    x = np.asarray(x, float)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(x.shape[1] if x.ndim > 1 else 1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.rint(x * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """(samples by channels, rate) of a PCM WAV file."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        data = f.readframes(f.getnframes())
    return wav.samples(data, width, channels), rate


def read_wav(spark: SparkSession, folder: str) -> DataFrame:
    return read_audio(spark, folder, pattern="*.wav")


def read_audio(spark: SparkSession, folder: str, decoders: dict[str, Callable[[bytes], tuple[np.ndarray, int]]] | None = None, pattern: str = AUDIO) -> DataFrame:
    """`file, waveform, sample_rate, error`: audio files decoded to mono; what can't be decoded has an error and no samples.

    `decoders` gives, by lower-case suffix without the dot, functions of a file's bytes to (samples by channels,
    rate), for the formats that the caller has a library for; PCM WAV is built in.
    """
    return decoded(audio_contents(spark, folder, pattern), decoders)


def audio_contents(spark: SparkSession, folder: str, pattern: str = AUDIO) -> DataFrame:
    """`file, content` of the matching files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "content")


SOUND = "file string, waveform array<float>, sample_rate int, error string"
Frames = Iterator[pd.DataFrame]


def decoded(contents: DataFrame, decoders: dict[str, Callable[[bytes], tuple[np.ndarray, int]]] | None = None, then: Callable[[Frames], Frames] | None = None, schema: str = SOUND) -> DataFrame:
    """As `read_audio`, of a table `file, content`. `then` goes on with the decoded rows in the same worker; it yields rows of `schema`."""
    known = {"wav": decode_wav} | (decoders or {})

    def run(batches: Frames) -> Frames:
        rows = _decode(batches, known)
        return then(rows) if then else rows

    bounded(contents.sparkSession)
    return contents.select("file", "content").mapInPandas(run, schema)


def decoding_errors(contents: DataFrame, decoders: dict[str, Callable[[bytes], tuple[np.ndarray, int]]] | None = None) -> DataFrame:
    """`file, error` of each file: why it can't be decoded, or null. Samples stay in the worker."""
    return decoded(contents, decoders, lambda rows: (b[["file", "error"]] for b in rows), "file string, error string")


def _decode(batches: Iterator[pd.DataFrame], known: dict) -> Iterator[pd.DataFrame]:
    def row(name: str, content: bytes) -> tuple:
        suffix = name.rpartition(".")[2].lower()
        try:
            if suffix not in known:
                raise ValueError(f"no decoder for .{suffix}")
            x, rate = known[suffix](content)
            x = np.asarray(x, np.float32)
            return name, x if x.ndim == 1 else x.mean(1).astype(np.float32), rate, None
        except Exception as e:  # noqa: BLE001  one file's failure is its own
            return name, np.zeros(0, np.float32), None, str(e) or type(e).__name__

    for b in batches:
        for out in batched(map(row, b["file"], b["content"]), "file, waveform, sample_rate, error"):
            yield out.astype({"sample_rate": "Int32"})


def manifest(files: DataFrame) -> DataFrame:
    return files.select(F.col("file").alias("audio"), F.lit(lexicon.MANIFEST_TEXT).alias("reference"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", one_line: bool = False) -> None:
    """CSV that `read_csv` reads back as it was: spaces at the ends of a text stay, and null isn't the empty text.

    With `one_line`, a row is a line: line ends within cells are written as \\n and \\r, a backslash as two, and null as \\N.
    """
    df = df.select(*(_escaped(col(c)).alias(c) if t == "string" else col(c) for c, t in df.dtypes)) if one_line else df
    options = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**options, **({"nullValue": NULL} if one_line else {})).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def _in_parts(df: DataFrame, path: str, head: Column, tail: str, mode: str) -> None:
    """Text files that, one after the other by name, are one JSON document: `head`, the rows of `df` as objects in their order, `tail`.

    The rows are written once as JSON lines, whose first one is known by its place, so that nothing gathers them.
    """
    spark, lines = df.sparkSession, folder(df.sparkSession)
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(lines)
    placed, _ = in_files(spark.read.text(lines))
    one = lambda c: spark.range(1, numPartitions=1).select(c.alias("value"))
    # the first row gets no comma, where it stands: a scan of its own for it would be one task that reads all lines
    body = placed.orderBy("position").select(F.when(F.col("position") == 0, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    # the partitions of a union follow each other
    one(head).union(body).union(one(F.lit(tail))).write.mode(mode).text(path)
    remove(spark, lines)


def write_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The rows as one JSON array of any size, in parts that follow each other by name; `read_json` reads them in many tasks."""
    _in_parts(df, path, F.lit("["), "]", mode)


def write_nested(summary: DataFrame, samples: DataFrame, name: str, path: str, mode: str = "errorifexists") -> None:
    """The one row of `summary` as a JSON document whose last field `name` is the array of all `samples`, in parts that follow each other by name."""
    [row] = summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).collect()
    head = row.value[:-1] + ("," if len(row.value) > 2 else "") + json.dumps(name) + ":["
    _in_parts(samples, path, F.lit(head), "]}", mode)


def join_parts(spark: SparkSession, path: str, to: str) -> None:
    """Copy the parts of a document into one file, a buffer at a time."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source = hadoop.fs.Path(path)
    fs, target = source.getFileSystem(conf), hadoop.fs.Path(to)
    out = target.getFileSystem(conf).create(target)
    try:
        for part in sorted(f.getPath().toString() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-")):
            into = fs.open(hadoop.fs.Path(part))
            try:
                hadoop.io.IOUtils.copyBytes(into, out, 1 << 20, False)
            finally:
                into.close()
    finally:
        out.close()


def write_document(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One row as one nested JSON document."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode(mode).text(path)


def write_evaluation(summary: DataFrame, samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The summary as one document, and beside it a JSON line for each sample: for evaluations whose samples no single document can hold."""
    write_document(summary, f"{path}/summary", mode)
    write_json(samples, f"{path}/samples", mode)
