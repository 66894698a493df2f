"""Reading and writing: JSON lines, zstd lines, single entities, TOML, and the text forms of results."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CLUSTER_INPUT_DDL, RELEASE_INPUT_DDL, RELEASE_STRUCT

_YEAR = "release_year"


def _typed(releases: DataFrame) -> DataFrame:
    """Years as integers; one that is no number is null."""
    return releases.withColumn(_YEAR, F.col(_YEAR).try_cast("int"))


def read_releases(spark: SparkSession, path: str, multi_line: bool = False, strict: bool = True) -> DataFrame:
    """Records from JSON lines, or from files of one record each. Blank lines are skipped; a bad line fails the read if ``strict``."""
    return _typed(spark.read.schema(RELEASE_INPUT_DDL).json(path, multiLine=multi_line, mode="FAILFAST" if strict else "DROPMALFORMED"))


def typed_clusters(clusters: DataFrame) -> DataFrame:
    """(k, v) documents with years as integers."""
    return clusters.select("k", F.transform("v", lambda r: r.withField(_YEAR, r[_YEAR].try_cast("int"))).cast(f"array<{RELEASE_STRUCT}>").alias("v"))


def read_clusters(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(k, v) documents from JSON lines; one without k or v is an error if ``strict`` and left out otherwise."""
    raw = typed_clusters(spark.read.schema(CLUSTER_INPUT_DDL).json(path, mode="FAILFAST" if strict else "DROPMALFORMED"))
    if strict:
        for c in ("k", "v"):
            raw = raw.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"cluster document without {c}"))))
        return raw
    return raw.where("k is not null and v is not null")


def read_zstd_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Lines of zstd files as (path, line_no, line), blank ones too, each file streamed in one task; the last line needs no newline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import zstandard

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content.as_buffer()), read_across_frames=True)
                lines, at = [], 0
                for line in io.TextIOWrapper(source, encoding=encoding, newline="\n"):
                    lines.append(line.removesuffix("\n"))
                    if len(lines) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines)], ["path", "line_no", "line"])
                        at, lines = at + len(lines), []
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines)], ["path", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, line_no long, line string")


def from_json_column(x: Column | str) -> Column:
    return F.from_json(x, f"{RELEASE_STRUCT}")


def to_json_column(*columns: str) -> Column:
    return F.to_json(F.struct(*columns) if columns else F.struct("*"))


def toml_to_json(x: Column | str) -> Column:
    """A TOML text as JSON; null if it doesn't parse. Dates become strings."""
    import json

    @F.arrow_udf("string")
    def converted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(v: str | None) -> str | None:
            try:
                return None if v is None else json.dumps(tomllib.loads(v), default=str)
            except tomllib.TOMLDecodeError:
                return None

        for a in batches:
            yield pa.array([one(v) for v in a.to_pylist()], pa.string())

    return converted(F.col(x) if isinstance(x, str) else x)


def json_to_toml(x: Column | str, drop: tuple[str, ...] = ()) -> Column:
    """A JSON object as TOML: nulls and the fields of ``drop`` are left out."""
    import json

    def value(v) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(value(i) for i in v if i is not None) + "]"
        if isinstance(v, dict):
            return "{" + ", ".join(f"{json.dumps(k)} = {value(i)}" for k, i in v.items() if i is not None) + "}"
        return json.dumps(v, ensure_ascii=False).replace("\x7f", "\\u007F")

    @F.arrow_udf("string")
    def converted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([None if v is None else "".join(f"{json.dumps(k)} = {value(i)}\n" for k, i in json.loads(v).items() if i is not None and k not in drop) for v in a.to_pylist()], pa.string())

    return converted(F.col(x) if isinstance(x, str) else x)


# ---- Results as text


def pair_lines(verified: DataFrame, base: str = "") -> DataFrame:
    """``<base>a <base>b Status.X Reason.Y``: one line per pair."""
    return verified.select(F.concat_ws(" ", F.concat(F.lit(base), "ident_a"), F.concat(F.lit(base), "ident_b"), F.concat(F.lit("Status."), F.upper("status")), F.concat(F.lit("Reason."), F.upper("reason"))).alias("value"))


def match_tsv(matches: DataFrame) -> DataFrame:
    """ident, work_id, container_id and title, tab-separated."""
    return matches.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("ident", "work_id", "container_id", "title")]).alias("value"))


def match_json(queries: DataFrame, matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """One JSON object per query: entity, matches in order of rank and match_count. Queries without a match have an empty list."""
    entity = queries.select(F.col("ident").alias("query"), F.struct(*queries.columns).alias("entity"))
    found = matches.join(catalog.select("ident", F.struct(*catalog.columns).alias("r")), "ident").groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.to_json("r").alias("j")))), lambda x: x["j"]).alias("m"))
    joined = entity.join(found, "query", "left")
    listed = F.array_join(F.coalesce("m", F.array().cast("array<string>")), ",")
    return joined.select("query", F.concat(F.lit('{"entity":'), F.to_json("entity"), F.lit(',"matches":['), listed, F.lit('],"match_count":'), F.coalesce(F.size("m"), F.lit(0)).cast("string"), F.lit("}")).alias("value"))


def verdict_json(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, status, reason) as JSON objects {extra, a, b, r}."""
    return pairs.select(F.to_json(F.struct(F.struct(F.lit("verify").alias("q")).alias("extra"), "a", "b", F.array("status", "reason").alias("r"))).alias("value"))


def citation_tsv(closest: DataFrame) -> DataFrame:
    """STATUS, REASON and ident of each citation's closest match."""
    return closest.select(F.concat_ws("\t", F.upper("status"), F.upper("reason"), "ident").alias("value"))


def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> None:
    (lines.write.option("compression", compression) if compression else lines.write).text(path)
