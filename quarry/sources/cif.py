"""Tables of CIF files, and assemblies.

Spark splits files at their data blocks; a block, which is one structure, is read as a stream of tokens, so values may be
wrapped over lines, quoted, or text fields. Only the category asked for is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a batch that a task hands on.
ROWS = 10_000
_TOKEN = re.compile(r"^;(.*?)(?:\r?\n;|\Z)|'((?:[^'\n]|'(?=\S))*)'(?=\s|\Z)|\"((?:[^\"\n]|\"(?=\S))*)\"(?=\s|\Z)|#[^\n]*|(\S+)", re.S | re.M)


def tokens(text: str) -> Iterator[tuple[bool, str]]:
    """(is a value for sure, token) of a CIF text; quoted values and text fields are such."""
    for m in _TOKEN.finditer(text):
        k = m.lastindex
        if k:
            yield k < 4, m.group(k)


def rows_of(text: str, category: str, columns: list[str]) -> Iterator[list[str | None]]:
    """The values of a category's columns, row by row, from a loop or from single items; ``?`` and ``.`` without quotes are
    null, as is a column that isn't there. A row that ends too early raises."""
    names: list[str] = []
    values: list[str | None] = []
    header = pending = False
    prefix = f"_{category}.".lower()
    single: dict[str, str | None] = {}
    item = ""

    def picked(row: list[str | None]) -> list[str | None]:
        have = dict(zip(names, row, strict=True))
        return [have.get(c.lower()) for c in columns]

    for sure, token in tokens(text):
        lower = token.lower()
        if not sure and (lower == "loop_" or lower[:1] == "_" or lower.startswith(("data_", "save_"))):
            if values:
                raise ValueError(f"a row of {category} has {len(values)} of {len(names)} values")
            if lower == "loop_":
                names, header, pending = [], True, False
            elif lower[:1] == "_":
                if header:
                    names.append(lower.removeprefix(prefix) if lower.startswith(prefix) else "")
                else:
                    names, item, pending = [], lower, True
            else:
                names, header, pending = [], False, False
            continue
        value = None if not sure and token in ("?", ".") else token
        if pending:
            if item.startswith(prefix):
                single[item.removeprefix(prefix)] = value
            pending = False
        elif names:
            header = False
            if not any(names):
                continue
            values.append(value)
            if len(values) == len(names):
                yield picked(values)
                values = []
    if values:
        raise ValueError(f"a row of {category} has {len(values)} of {len(names)} values")
    if single:
        yield [single.get(c.lower()) for c in columns]


def read_category(spark: SparkSession, path: str | list[str], category: str, columns: list[str]) -> DataFrame:
    """(file, data_block, row, one string a column) of a category; files may have any number of data blocks."""
    read = spark.read.option("lineSep", "\ndata_").text(path)
    blocks = read.select(F.col("_metadata.file_name").alias("file"), "value").where(F.col("value").contains(f"_{category}."))
    schema = pa.schema([("file", pa.string()), ("data_block", pa.string()), ("row", pa.int64()), *((c, pa.string()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                named = re.match(r"(?:(?:\s*#[^\n]*\n|\s+)*data_)?(\S*)", text).group(1)
                body, held, n = f"data_{text}" if not re.match(r"(?:\s*#[^\n]*\n|\s+)*data_", text) else text, [], 0
                for row in rows_of(body, category, columns):
                    held.append((file, named, n, *row))
                    n += 1
                    if len(held) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return blocks.mapInArrow(run, ", ".join(["file string", "data_block string", "row long", *(f"`{c}` string" for c in columns)]))


def operations(expression: str) -> list[list[str]]:
    """The sequences of operations, each in order of application, that an expression such as ``1,2``, ``(1-3)`` or
    ``(X0)(1-60)`` stands for. Groups are combined, and the rightmost is applied first; a range runs over whole numbers."""
    groups = re.findall(r"\(([^()]*)\)|([^()]+)", expression.replace(" ", ""))
    steps = []
    for text in (a or b for a, b in groups):
        ids: list[str] = []
        for part in text.split(","):
            span = re.fullmatch(r"(\d+)-(\d+)", part)
            ids += [str(i) for i in range(int(span[1]), int(span[2]) + 1)] if span else [part] if part else []
        steps.append(ids)
    return [list(s[::-1]) for s in product(*steps)] if steps else []


_MATRIX = [f"matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)] + [f"vector[{i}]" for i in (1, 2, 3)]


def read_assemblies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, data_block, assembly_id, sym_id, chain_id, transforms) of all assemblies: each chain once for each sequence of
    operations; ``sym_id`` numbers these from 0 in an assembly, and ``transforms`` are arrays of 12 numbers (three rows of a
    matrix, then the shift) in order of application. An operation that isn't listed raises."""
    gen = read_category(spark, path, "pdbx_struct_assembly_gen", ["assembly_id", "oper_expression", "asym_id_list"])
    listed = read_category(spark, path, "pdbx_struct_oper_list", ["id", *_MATRIX])
    key = ["file", "data_block"]
    matrix = F.array(*(F.col(f"`{c}`").cast("double") for c in _MATRIX)).alias("m")
    by_id = listed.select(*key, F.col("id"), matrix).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("id", "m"))).alias("ops"))  # of one structure

    @F.udf("array<array<string>>")
    def sequences(expression: str) -> list[list[str]]:
        return operations(expression or "")

    rows = gen.select(*key, "assembly_id", "row", F.split("asym_id_list", r"\s*,\s*").alias("chains"), F.posexplode(sequences("oper_expression")).alias("k", "ids")).join(by_id, key)
    missing = F.raise_error(F.concat(F.lit("an operation that is not listed: "), F.array_join("ids", ",")))
    found = F.transform("ids", lambda i: F.try_element_at("ops", i))
    rows = rows.withColumn("transforms", F.when(F.exists(found, lambda m: m.isNull()), missing).otherwise(found))
    number = F.row_number().over(W.partitionBy(*key, "assembly_id").orderBy("row", "k")) - 1
    return rows.withColumn("sym_id", number).select(*key, "assembly_id", "sym_id", F.explode("chains").alias("chain_id"), "transforms")


def expanded(atoms: DataFrame, assemblies: DataFrame, assembly_id: str = "1") -> DataFrame:
    """Atoms (file, chain_id, x, y, z, ...) of an assembly: each chain's once for each of its operations, moved, with
    ``sym_id``. Files without such an assembly keep their atoms as they are, with a ``sym_id`` of 0."""
    chosen = assemblies.where(F.col("assembly_id") == assembly_id).select("file", "chain_id", "sym_id", "transforms")
    start = F.struct(*(F.col(c).cast("double").alias(c) for c in "xyz"))

    def step(at: Column, m: Column) -> Column:
        return F.struct(*((m[3 * i] * at["x"] + m[3 * i + 1] * at["y"] + m[3 * i + 2] * at["z"] + m[9 + i]).alias(c) for i, c in enumerate("xyz")))

    moved = atoms.join(chosen, ["file", "chain_id"]).withColumn("__at", F.aggregate("transforms", start, step))
    moved = moved.withColumns({c: F.col(f"__at.{c}") for c in "xyz"}).select(*atoms.columns, "sym_id")
    alone = atoms.join(chosen.select("file").distinct(), "file", "left_anti").withColumn("sym_id", F.lit(0))
    return moved.unionByName(alone)


def polymer_counts(assemblies: DataFrame, polymers: DataFrame) -> DataFrame:
    """(file, assembly_id, n): the polymer chains of each assembly, copies counted; ``polymers`` are (file, chain_id)."""
    return assemblies.join(polymers.select("file", "chain_id").distinct(), ["file", "chain_id"]).groupBy("file", "assembly_id").agg(F.count("*").alias("n"))
