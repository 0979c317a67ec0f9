"""Writers of results: structures as CIF, a file for each sample, and a summary that counts failures.

Spark's own commit makes files appear only when a write has ended; what a failed task has written is thrown away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an atom table and their CIF names, in the order written.
ATOM_SITE = (
    ("hetero", "group_PDB"), ("id", "id"), ("element", "type_symbol"), ("atom_name", "label_atom_id"), ("alt_id", "label_alt_id"), ("res_name", "label_comp_id"), ("chain_id", "label_asym_id"), ("entity_id", "label_entity_id"), ("res_id", "label_seq_id"),
    ("x", "Cartn_x"), ("y", "Cartn_y"), ("z", "Cartn_z"), ("occupancy", "occupancy"), ("b_factor", "B_iso_or_equiv"), ("auth_chain_id", "auth_asym_id"), ("model", "pdbx_PDB_model_num"),
)


def cif_value(value: Column) -> Column:
    """A value as one CIF token: null as ``?``; quoted where it is empty, has blanks or quotes, or could be taken for something
    else. A value with a line break, or with both quotes before blanks, raises."""
    text = value.cast("string")
    odd = (text == "") | text.rlike(r"[\s'\"#]|^[_;$\[\]]|^[?.]$|(?i)^(data_|loop_|save_|stop_|global_)")
    single, double = ~text.rlike(r"'(\s|$)"), ~text.rlike(r"\"(\s|$)")
    broken = F.raise_error(F.concat(F.lit("a value that a line can't hold: "), text))
    quoted = F.when(text.rlike(r"[\r\n]"), broken).when(single, F.concat(F.lit("'"), text, F.lit("'"))).when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(broken)
    return F.when(text.isNull(), "?").when(odd, quoted).otherwise(text)


def cif_text(atoms: DataFrame, structure: str = "file", order: str = "atom_idx") -> DataFrame:
    """(structure, value): the CIF text of each structure, its atoms in order. Columns of ``ATOM_SITE`` that the table doesn't
    have are left out; numbers are written as Spark writes them."""
    have = [(c, name) for c, name in ATOM_SITE if c in (*atoms.columns, "id")]

    def field(column: str) -> Column:
        if column == "id":
            return (F.col(order) + 1).cast("string")
        return F.when(F.col(column), "HETATM").otherwise("ATOM") if column == "hetero" else cif_value(F.col(column))

    line = F.concat_ws(" ", *(field(c) for c, _ in have))
    rows = atoms.groupBy(structure).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("v")))), lambda r: r["v"]), "\n").alias("lines"))  # one structure
    head = "#\nloop_\n" + "\n".join(f"_atom_site.{name}" for _, name in have) + "\n"
    name = F.regexp_replace(F.col(structure).cast("string"), r"\s", "_")
    return rows.select(structure, F.concat(F.lit("data_"), name, F.lit("\n"), F.lit(head), "lines", F.lit("\n#")).alias("value"))


def write_samples(texts: DataFrame, path: str, keys: list[str], value: str = "value") -> None:
    """One file for each row, in folders named by its keys (``query=a/seed=1/...``); rows with equal keys would share a
    folder, so they raise. Samples are dealt by their keys, and no task holds more than one open file."""
    twice = texts.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one text for {twice[0].asDict()}")
    texts.select(*keys, value).repartition(*keys).sortWithinPartitions(*keys).write.partitionBy(*keys).text(path)


def summary(results: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """(keys, samples, failures, reasons) of each group of results, and what went wrong, each reason once with its number;
    results whose failure is unknown count as failures."""
    bad = F.coalesce(failed, F.lit(True))
    rows = results.withColumn("__bad", bad)
    reason = F.coalesce(F.col("reason"), F.lit("unknown")) if "reason" in results.columns else F.lit("unknown")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if("__bad").alias("failures"))
    told = rows.where("__bad").groupBy(*keys, reason.alias("__why")).agg(F.count("*").alias("__n"))
    told = told.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__why", "__n")))).alias("reasons"))
    return counts.join(told, keys, "left")
