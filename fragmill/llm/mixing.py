"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, gone through up to ``max_repeats`` times. A document's
virtual finish time is the source's cumulative size up to and with it, divided by the source's weight. Taking
documents in the order of their finish times keeps the sources' sizes in the ratio of their weights until a queue runs
dry; the order is a global range sort, cut where the budget is reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.plans.lineage import Scratch
from fragmill.sources.tables import require

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str, sent: bool = False):
    """The tokenizer of a rank file, one a process; with ``sent``, of the copy that the session sent to its executors."""
    if vocabulary not in _ENCODERS:
        import base64
        import os

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(os.path.basename(vocabulary)) if sent else vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def _count(batches: Iterator[pa.RecordBatch], vocabulary: str, at: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary, True).encode_ordinary
    for batch in batches:
        n = np.fromiter((len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()), np.int64, batch.num_rows)
        columns = [batch.column(i) for i in range(batch.num_columns) if i != at] + [pa.array(n)]
        names = [x for i, x in enumerate(batch.schema.names) if i != at] + ["n_tokens"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def token_counts(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with ``n_tokens`` in place of its text; null has none. The rank file is sent to the executors."""
    require(df, [text])
    df.sparkSession.sparkContext.addFile(vocabulary)
    from pyspark.sql import types as T

    at = df.columns.index(text)
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField("n_tokens", T.LongType())])
    return df.mapInArrow(lambda it: _count(it, vocabulary, at), schema)


class Mixture:
    """A mixture of ``docs`` (doc_id, text, source) by ``targets`` (source, target_share, max_repeats).

    Shares are taken relative to their sum. Sources that are null, not listed, or listed with no positive share give
    nothing; a source listed twice is refused. ``budget`` is the mixture's size in tokens, by default that of all
    documents of listed sources, each counted once. Null and empty texts have size 0 and cost nothing. Rows are
    documents even if their ids repeat. The target table may have at most ``most_sources`` rows; it is sent to all tasks.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None, seed: int = 42, vocabulary: str = VOCABULARY, most_sources: int = 10_000, bucket_rows: int = 50_000):
        require(docs, [doc_id, text, source], "documents")
        require(targets, ["source", "target_share", "max_repeats"], "targets")
        listed = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).filter("source is not null")
        rows = listed.limit(most_sources + 1).collect()
        if len(rows) > most_sources:
            raise ValueError(f"more than {most_sources} target sources")
        if len({r.source for r in rows}) < len(rows):
            raise ValueError("a source is listed twice")
        self.spark, self.scratch = docs.sparkSession, Scratch(docs.sparkSession)
        wanted = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"))
        wanted = wanted.join(F.broadcast(listed.select("source")), "source").select("doc_id", "source", "text")
        # The tokens are counted once; all else works on three numbers a document.
        sized = token_counts(wanted, "text", vocabulary).withColumn("at", F.xxhash64(F.lit(seed), "source", "doc_id"))
        self.sized = self.scratch.keep(sized)
        held = {r.source: (r.size, r.n) for r in self.sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
        total_share = sum(max(r.target_share, 0.0) for r in rows) or 1.0
        self.total = sum(size for size, _ in held.values())
        self.budget = self.total if budget is None else budget
        self.plan = {r.source: {"weight": max(r.target_share, 0.0) / total_share, "target_share": r.target_share, "max_repeats": max(r.max_repeats, 0), "size": held.get(r.source, (0, 0))[0], "n": held.get(r.source, (0, 0))[1]} for r in rows}
        self.finish = self._cut()
        # Buckets of the shuffled order bound what one window partition holds; a source has as many as its rows need.
        most = max([n for _, n in held.values()] or [1])
        self.bits = max(0, int(np.ceil(np.log2(max(1, most / bucket_rows)))))

    def _cut(self) -> float:
        """The virtual time at which the queues have given the whole budget, or all they have."""
        live = sorted((p["size"] * p["max_repeats"] / p["weight"], p["weight"]) for p in self.plan.values() if p["weight"] > 0)
        given, time, flow = 0.0, 0.0, sum(w for _, w in live)
        for dry, w in live:
            if given + (dry - time) * flow >= self.budget:
                break
            given, time, flow = given + (dry - time) * flow, dry, flow - w
        return time + (self.budget - given) / flow if flow > 1e-12 else time

    def queue(self) -> DataFrame:
        """(doc_id, source, n_tokens, cumulative): each document with its source's size up to and with it."""
        from pyspark.sql import Window as W

        bucket = F.shiftrightunsigned("at", 64 - self.bits) if self.bits else F.lit(0).cast("long")
        rows = self.sized.withColumn("bucket", bucket)
        sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
        before = sums.select("source", "bucket", (F.sum("s").over(W.partitionBy("source").orderBy("bucket")) - F.col("s")).alias("before"))
        inner = F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("at", "doc_id").rowsBetween(W.unboundedPreceding, 0))
        return rows.withColumn("c", inner).join(before, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("before") + F.col("c")).alias("cumulative"))

    def _targets(self) -> DataFrame:
        rows = [(s, float(p["target_share"]), float(p["weight"]), int(p["max_repeats"]), int(p["size"])) for s, p in self.plan.items()]
        return self.spark.createDataFrame(rows, "source string, target_share double, weight double, max_repeats int, size long")

    def documents(self) -> DataFrame:
        """(doc_id, source, copy, n_tokens, finish) of the mixture, in the order in which the queue gives them."""
        t = self._targets().filter("weight > 0 and max_repeats > 0")
        rows = self.queue().join(F.broadcast(t), "source")
        quota = F.col("weight") * F.lit(float(self.finish)) * (1 + 1e-12)
        rounds = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor((quota - F.col("cumulative")) / F.greatest("size", F.lit(1))) + 1)
        n = F.least(rounds.cast("long"), F.col("max_repeats").cast("long"))
        taken = rows.withColumn("n", n).filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        finish = ((F.col("copy") - 1) * F.col("size") + F.col("cumulative")) / F.col("weight")
        return taken.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "n_tokens", finish.alias("finish")).orderBy("finish", "source", "doc_id", "copy")

    def reached(self) -> DataFrame:
        """(source, target_share, max_repeats, tokens, documents, copies, short) for each listed source, by its rows of the mixture.

        A source is short where the mixture holds all its copies and they are less than what is due to it: its last
        finish time comes before the budget, and the cut never does.
        """
        got = self.documents().groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum((F.col("copy") == 1).cast("long")).alias("documents"), F.count(F.lit(1)).alias("copies"))
        held = [(s, float(p["weight"] * self.budget), int(p["n"] * p["max_repeats"]), int(p["size"])) for s, p in self.plan.items()]
        due = self.spark.createDataFrame(held, "source string, due double, most_copies long, size long")
        n = lambda c: F.coalesce(c, F.lit(0))
        t = self._targets().drop("size").join(F.broadcast(due), "source").join(got, "source", "left")
        all_given = (n("copies") == F.col("most_copies")) | (F.col("size") == 0)
        return t.select("source", "target_share", "max_repeats", n("tokens").alias("tokens"), n("documents").alias("documents"), n("copies").alias("copies"), (all_given & (n("tokens") < F.col("due"))).alias("short"))

    def shares(self) -> DataFrame:
        """(source, target_share, reached_share, tokens, documents, copies, short) for each listed source."""
        from pyspark.sql import Window as W

        total = F.sum("tokens").over(W.partitionBy(F.lit(0)))  # at most ``most_sources`` rows
        return self.reached().select("source", "target_share", F.coalesce(F.try_divide("tokens", total), F.lit(0.0)).alias("reached_share"), "tokens", "documents", "copies", "short")
