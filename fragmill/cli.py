"""Command line: split one molecule or a table, score predictions, curate a table with a dictionary, fit a classifier."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.operators import curation, learning, scoring, splitting
from fragmill.sources.sinks import result_lines, write_table
from fragmill.sources.tables import load, require


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fragmill", description=__doc__)
    sub = p.add_subparsers(dest="job", required=True)
    split = sub.add_parser("split", help="split a molecule, or all of a CSV file")
    split.add_argument("--smiles")
    split.add_argument("--strategy", default="grid")
    split.add_argument("--model", help="folder of a fitted classifier")
    split.add_argument("--references", help="CSV file with smiles and is_warhead")
    score = sub.add_parser("score", help="score predictions of a CSV file against its labels")
    score.add_argument("--label", default="labels")
    score.add_argument("--prediction", default="default_pred_n0")
    curate = sub.add_parser("curate", help="split a CSV file by a dictionary of known parts, and grow it")
    curate.add_argument("--dictionary", required=True, help="CSV file with role and ligand")
    curate.add_argument("--grown", help="where to write the grown dictionary")
    fit = sub.add_parser("fit", help="fit a classifier of bonds to cut on labelled molecules of a CSV file")
    fit.add_argument("--label", default="labels")
    fit.add_argument("--model", required=True)
    for x in (split, score, curate, fit):
        x.add_argument("--input", help="CSV file with a header")
        x.add_argument("--column", default="smiles", help="column of whole molecules")
        x.add_argument("--output", help="folder for the result as CSV; without it lines are printed")
    return p


def _references(spark: SparkSession, path: str | None) -> splitting.References | None:
    if not path:
        return None
    rows = load(spark, path).withColumn("is_warhead", F.lower("is_warhead") == "true")
    return splitting.References.of_table(rows)


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("_row", F.monotonically_increasing_id())


def _emit(df: DataFrame, output: str | None) -> None:
    if output:
        write_table(df, output, kind="csv")
    else:
        for row in df.toLocalIterator():
            print(row[0] if len(row) == 1 else ",".join("" if v is None else str(v) for v in row))


def run(spark: SparkSession, argv: list[str] | None = None) -> int:
    """Runs one job in a session; 0 if it went well, 2 for input that is missing."""
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    smiles = getattr(a, "smiles", None)
    if not a.input and not smiles:
        print("give --input" + (" or --smiles" if a.job == "split" else ""), file=sys.stderr)
        return 2
    df = load(spark, a.input) if a.input else spark.createDataFrame([(smiles,)], f"`{a.column}` string")
    require(df, [a.column], "input")
    if a.job == "split":
        model = learning.load_model(a.model) if a.model else None
        out = splitting.split(df, a.column, a.strategy, _references(spark, a.references), model)
        _emit(out if a.output else result_lines(out, a.column), a.output)
    elif a.job == "score":
        rows = _numbered(require(df, [a.label, a.prediction], "input"))
        _emit(rows.join(scoring.score_predictions(rows, "_row", a.column, a.label, a.prediction), "_row").drop("_row"), a.output)
    elif a.job == "curate":
        done, known = curation.curate(df.select(a.column).dropna().distinct().withColumn("_key", F.col(a.column)), "_key", a.column, load(spark, a.dictionary))
        _emit(done.withColumnRenamed("_key", a.column), a.output)
        if a.grown:
            write_table(known, a.grown, kind="csv")
    else:
        rows = learning.sample_molecules(_numbered(require(df, [a.label], "input").dropna(subset=[a.column, a.label])), "_row")
        learning.save_model(learning.fit_edges(learning.labelled_edges(rows, "_row", a.column, a.label)), a.model)
    return 0


def main(argv: list[str] | None = None) -> int:
    from fragmill.session import local_session

    return run(SparkSession.getActiveSession() or local_session(), argv)
