"""CSV sources, zipped ones too, and the sinks of a run."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.columns import col
from tallyweave.session import scratch

Schema = T.StructType | str


def read_csv(
    spark: SparkSession, path: str, schema: Schema | None = None, sep: str = ","
) -> DataFrame:
    """A CSV file with a header, UTF-8 with or without a byte order mark.

    Without a schema the types are inferred, which reads the file once more.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


#: Name of the column that a line which does not fit its schema is kept in.
LINE = "__line"


def read_csv_checked(
    spark: SparkSession,
    path: str,
    schema: Schema,
    sep: str = ",",
    required: Sequence[str] = (),
    header: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV file that fit its schema, and ``file, line`` of all the others.

    A line does not fit if it has too few or too many fields, if a field is not of its type, or if one of the ``required``
    columns is empty. Rejects of that last kind are written out as a line again. No line gets lost, and none is read half.
    The file is parsed once, and what it holds is landed in the shared folder, where both are read from.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = schema.names
    kept = T.StructType([*schema.fields, T.StructField(LINE, T.StringType())])
    reader = spark.read.schema(kept).option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", LINE).option("columnPruning", False)
    landed = scratch(spark, "lines")
    reader.csv(path).select("*", F.col("_metadata.file_name").alias("__file")).write.parquet(landed)
    rows = spark.read.parquet(landed)
    empty = F.lit(False)
    for name in required:
        empty = empty | col(name).isNull()
    broken = F.col(LINE).isNotNull()
    good = rows.where(~broken & ~empty).select(*map(col, names))
    line = F.coalesce(F.col(LINE), F.to_csv(F.struct(*map(col, names)), {"sep": sep}))
    return good, rows.where(broken | empty).select(F.col("__file").alias("file"), line.alias("line"))


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to bigint or double where every value allows it, in one pass."""

    def fits(name, kind):
        cast = col(name).try_cast(kind)
        return F.coalesce(F.bool_and(col(name).isNull() | cast.isNotNull()), F.lit(True))

    checks = []
    for i, name in enumerate(df.columns):
        checks += [fits(name, "bigint").alias(f"w{i}"), fits(name, "double").alias(f"r{i}")]
    got = df.agg(*checks).first()

    def cast(i, name):
        kind = "bigint" if got[f"w{i}"] else "double" if got[f"r{i}"] else "string"
        return col(name).cast(kind).alias(name)

    return df.select([cast(i, name) for i, name in enumerate(df.columns)])


def read_zipped_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: Schema | None = None,
    sep: str = ",",
    chunk_rows: int = 50_000,
) -> DataFrame:
    """CSV members of zip archives (``path`` may be a pattern), each with a header.

    An archive cannot be split, so one task unpacks each, in chunks; its rows are
    dealt out right after. Many archives are read side by side. Land a single
    very large one as plain CSV instead. Types come from ``schema`` or are inferred.
    """
    archives = spark.read.format("binaryFile").load(path).select("content")

    def chunks(content, **options):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for member in archive.namelist():
                if member.endswith("/"):
                    continue
                with archive.open(member) as handle:
                    yield from pd.read_csv(
                        handle,
                        sep=sep,
                        dtype=str,
                        keep_default_na=False,
                        na_values=[""],
                        encoding="utf-8-sig",
                        chunksize=chunk_rows,
                        **options,
                    )

    def header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                first = next(chunks(content, nrows=1), pd.DataFrame())
                yield pd.DataFrame({"names": [list(first.columns)]})

    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if columns is None:
        columns = (
            schema.names
            if schema is not None
            else archives.limit(1).mapInPandas(header, "names array<string>").first()["names"]
        )
    names = list(columns)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                # A column that a member does not have is null in its rows.
                for frame in chunks(content, usecols=lambda name: name in names):
                    frame = frame.reindex(columns=names)
                    yield frame.astype(object).where(frame[names].notna(), None)

    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    unpacked = archives.mapInPandas(rows, text)
    dealt = unpacked.repartition(spark.sparkContext.defaultParallelism)
    if schema is None:
        return infer_types(dealt)
    return dealt.select([col(n).cast(schema[n].dataType).alias(n) for n in names])


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def write_latents(df: DataFrame, path: str, size: int, z: str = "z") -> None:
    """One headerless CSV column per latent dimension."""
    write_csv(df.select([F.get(col(z), F.lit(i)).alias(f"z{i}") for i in range(size)]), path, False)


def write_losses(losses: DataFrame, path: str) -> None:
    """A few rows of metrics as JSON lines."""
    losses.coalesce(1).write.mode("overwrite").json(path)
