"""Writing results: one folder of part files, or a single file where a reader needs one."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None, kind: str = "parquet") -> None:
    """Parquet, ORC, JSON or CSV (with header, quotes doubled)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if kind == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(kind).save(path)


def result_lines(df: DataFrame, smiles: str = "smiles", prediction: str = "default_pred_n0") -> DataFrame:
    """One CSV line a row: smiles, e3, linker, poi, model_name; nulls as empty fields."""
    from pyspark.sql import functions as F

    from fragmill.functions.fragments import split_roles

    r = split_roles(F.col(prediction))
    quoted = lambda c: F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cells = [F.col(smiles), r["e3"], r["linker"], r["poi"], F.col("model_name")]
    return df.select(F.array_join(F.array(*[F.coalesce(quoted(c), F.lit("")) for c in cells]), ",").alias("value"))


def npy_files(df: DataFrame, column: str, rows: int = 10_000) -> DataFrame:
    """(part, rows, content): an array column as NumPy files of up to ``rows`` rows, in the order of its partitions; every
    content is what ``numpy.load`` reads. Arrays of one file have one length; null arrays are left out."""
    from pyspark.sql import functions as F

    def pack(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                out = io.BytesIO()
                some = batch.slice(k, rows)
                np.save(out, np.array(some.column(1).to_pylist(), float))
                yield pa.RecordBatch.from_arrays([pa.array([some.column(0)[0].as_py()], pa.int64()), pa.array([some.num_rows], pa.int64()), pa.array([out.getvalue()], pa.binary())], names=["part", "rows", "content"])

    return df.select(F.monotonically_increasing_id().alias("part"), column).dropna().mapInArrow(pack, "part long, rows long, content binary")
