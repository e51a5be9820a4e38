"""Learning: a classifier of bonds to cut, and a sweep over numbers of clusters."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragmill.chem import molecule as m
from fragmill.chem import quick, splitting
from fragmill.operators.molecules import _map, edge_features, map_many, slices, spread

NUMBERS = ["order", "degree_u", "degree_v", "degree2_u", "degree2_v", "degree3_u", "degree3_v", "betweenness_u", "betweenness_v", "smaller_side", "num_nodes", "num_edges", "ring_bonds"]


def _true_cuts(whole: str | None, label: str | None) -> dict:
    from fragmill.chem.repair import _cuts

    roles = m.roles(label)
    texts = {role: roles.get(role) for role in ("e3", "poi")}
    parts = {role: m.parse(t) for role, t in texts.items()}
    if not (parts["e3"] and parts["poi"]):
        return {"cuts": []}
    w = quick.read(whole)
    target = None if w else m.parse(whole)
    found = []
    for role, s in (("e3", 2), ("poi", 1)):
        b = quick.cut_off(w, texts[role], parts[role], s) if w else next((b for b, _ in _cuts(target, parts[role], s)), None) if target else None
        if b is not None:
            found.append({"bond": b, "side": s})
    return {"cuts": found}


def labelled_edges(df: DataFrame, key: str, whole: str, label: str) -> DataFrame:
    """The bridges of each molecule with their features and ``side``: 2 where the E3 ligand was cut off, 1 for the
    target ligand, 0 for all others."""
    return edge_features(df, key, whole).join(cuts(df, key, whole, label), [key, "bond"], "left").withColumn("side", F.coalesce("side", F.lit(0)))


def with_cuts(df: DataFrame, key: str, whole: str, label: str) -> DataFrame:
    """(key, whole, cuts array<struct<bond, side>>): each molecule with the bonds at which the labelled parts were cut off."""

    def begin():
        return lambda rows: [{whole: w, **_true_cuts(w, t)} for w, t in rows]

    return map_many(df, key, [whole, label], f"{whole} string, cuts array<struct<bond:int,side:int>>", begin)


def _bonds(text: str | None) -> tuple[list[int], list[tuple], list[int]]:
    """The bridges of a molecule, their NUMBERS with both elements, and their fingerprints as bits."""
    w = quick.read(text)
    if w:
        return [w.up[v] for v in w.low], *quick.features(w, quick.betweenness(w))
    edges = splitting.edge_features(text)
    prints = [sum(1 << i for i, x in enumerate(e["fp"]) if x) for e in edges]
    return [e["bond"] for e in edges], [tuple(e[c] for c in (*NUMBERS, "atom_u", "atom_v")) for e in edges], prints


def labelled_bonds(df: DataFrame, whole: str) -> DataFrame:
    """The same bonds as ``labelled_edges``, of molecules ``with_cuts``, in few bytes each: NUMBERS, atom_u, atom_v, the
    fingerprint as ``bits``, and ``side``."""
    import pyarrow as pa

    schema = pa.schema([*((c, pa.float64()) for c in NUMBERS), ("atom_u", pa.string()), ("atom_v", pa.string()), ("bits", pa.int64()), ("side", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 256)):
            rows, bits, sides = [], [], []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, r, p = _bonds(text)
                side = {c["bond"]: c["side"] for c in cuts}
                rows += r
                bits += p
                sides += [side.get(b, 0) for b in at]
            if rows:
                columns = [*zip(*rows, strict=True), np.array(bits, np.uint64).view(np.int64), sides]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    fields = ", ".join([*(f"{c} double" for c in NUMBERS), "atom_u string, atom_v string, bits long, side int"])
    return spread(df.select(F.lit(0).alias("_"), whole, "cuts")).mapInArrow(run, fields)


def _borders(counts: list[tuple[float, float]], bins: int) -> list[float]:
    """Where values that weigh so much are parted into at most so many ranges of about the same weight, or one a value."""
    values = sorted(counts)
    x = np.array([v for v, _ in values])
    upto = np.cumsum([w for _, w in values])
    ends = np.arange(len(x) - 1) if len(x) <= bins else np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins))
    ends = ends[ends < len(x) - 1]
    inner = ((x[ends] + x[ends + 1]) / 2).tolist() or x[:1].tolist()
    return [float("-inf"), *inner, float("inf")]


def fit_edges(edges: DataFrame, trees: int = 30, depth: int = 6, seed: int = 42, bins: int = 32):
    """A random forest that tells bonds to cut from all others, of ``labelled_edges`` or ``labelled_bonds``. The few bonds to
    cut weigh as much as the rest.

    All bonds count, however many: numbers fall into ranges whose borders follow from the counts of all values (of
    centralities to four places), and bonds that are alike in all ranges become one row that weighs as many, so what the
    forest holds follows the number of kinds of bonds."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler

    from fragmill.plans.lineage import Scratch

    scratch, binned = Scratch(edges.sparkSession), [f"{c}_bin" for c in NUMBERS]
    if "bits" not in edges.columns:
        edges = edges.withColumn("bits", F.aggregate(F.reverse("fp"), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long"))))
    rows = edges.select(*[F.col(c).cast("double").alias(c) for c in NUMBERS], "atom_u", "atom_v", "bits", (F.col("side") > 0).cast("double").alias("cut"))
    values = F.array(*[F.struct(F.lit(i).alias("i"), (F.round(c, 4) if c.startswith("betweenness") else F.col(c)).alias("value")) for i, c in enumerate(NUMBERS)])
    counts = rows.select("cut", F.explode(values).alias("x")).groupBy("x.i", "x.value", "cut").count().collect()
    if not counts:
        raise ValueError("no bonds to fit on")
    share = {k: sum(r["count"] for r in counts if r.i == 0 and r.cut == k) for k in (0.0, 1.0)}
    total = sum(share.values())
    weight = {k: total / (2 * (n or 1)) for k, n in share.items()}
    heavy: list[Counter] = [Counter() for _ in NUMBERS]
    for r in counts:
        heavy[r.i][r.value] += r["count"] * weight[r.cut]
    bucket = Bucketizer(splitsArray=[_borders(list(h.items()), bins) for h in heavy], inputCols=NUMBERS, outputCols=binned)
    alike = [*binned, "atom_u", "atom_v", "bits", "cut"]
    plain = [F.col(c).alias(c, metadata={}) for c in alike]  # ranges have an order, which the metadata would deny
    kinds = bucket.transform(rows).select(*plain).groupBy(*alike).agg((F.count("*") * F.when(F.col("cut") == 1, weight[1.0]).otherwise(weight[0.0])).alias("w"))
    kinds = scratch.keep(kinds.sortWithinPartitions(*alike))
    index = StringIndexer(inputCols=["atom_u", "atom_v"], outputCols=["iu", "iv"], handleInvalid="keep").fit(kinds)
    assemble = VectorAssembler(inputCols=[*binned, "iu", "iv", "fpv"], outputCol="features")
    # values of every row are asked for splits where maxBins squared reaches the number of rows; ranges stay as they are
    most = max(bins, math.isqrt(kinds.count()) + 1)
    forest = RandomForestClassifier(labelCol="cut", weightCol="w", numTrees=trees, maxDepth=depth, seed=seed, maxBins=most)
    prints = F.transform(F.sequence(F.lit(0), F.lit(splitting.PLACES - 1)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1).cast("long")).cast("double"))
    fitted = forest.fit(assemble.transform(index.transform(_vectors(kinds.withColumn("fp", prints)))))
    scratch.drop(kinds)
    return PipelineModel(stages=[bucket, index, assemble, fitted])


def _vectors(edges: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return edges.withColumn("fpv", array_to_vector("fp"))


def save_model(model, path: str) -> None:
    """Writes a fitted model to a folder all executors share."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """A model written by ``save_model``; one object a session and path."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def sample_molecules(df: DataFrame, key: str, most: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``most`` rows, the first in the order of a hash of their key: what a model is fitted on."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most)


def top_bonds(model, edges: DataFrame, key: str, n: int = 2) -> DataFrame:
    """(key, bond, proba, rank): the n bonds of each molecule that are most likely to be cut."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_vectors(edges)).withColumn("proba", F.get(vector_to_array("probability"), F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("proba"), "bond")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(key, "bond", "proba", "rank")


class Forest:
    """A fitted forest in numbers, by which bonds are judged where their molecule is read: votes are summed tree by tree as
    the fitted model does, so its probabilities are the same."""

    def __init__(self, model):
        bucket, index, _, forest = model.stages
        borders = bucket.getSplitsArray()
        self.labels = [{x: float(i) for i, x in enumerate(labels)} for labels in index.labelsArray]
        nodes: list[tuple] = []  # (feature, threshold, categories that go left, left, right, votes)

        def add(node) -> int:
            at = len(nodes)
            nodes.append(())
            if node.subtreeDepth() == 0:
                stats = list(node.impurityStats().stats())
                total = sum(stats)
                nodes[at] = (0, 0.0, None, at, at, [x / total if total else 0.0 for x in stats])
                return at
            split = node.split()
            categories = set(split.leftCategories()) if split.getClass().getSimpleName() == "CategoricalSplit" else None
            threshold, at_feature = split.threshold() if categories is None else 0.0, split.featureIndex()
            if categories is None and at_feature < len(borders):  # ranges up to this one: numbers below its upper border
                threshold = float(np.nextafter(borders[at_feature][int(threshold) + 1], -np.inf))
            left, right = add(node.leftChild()), add(node.rightChild())
            nodes[at] = (at_feature, threshold, categories, left, right, [0.0, 0.0])
            return at

        self.roots = np.array([add(t.rootNode()) for t in forest._java_obj.trees()])
        self.feature, self.left, self.right = (np.array([n[i] for n in nodes]) for i in (0, 3, 4))
        self.threshold, self.votes = np.array([n[1] for n in nodes]), np.array([n[5] for n in nodes])
        most = 1 + max(map(len, self.labels))
        self.categorical = np.array([n[2] is not None for n in nodes])
        self.goes_left = np.array([[c in (n[2] or ()) for c in range(most)] for n in nodes])

    def __call__(self, edges: list[dict]):
        """The probability of each bond to be cut."""
        x = np.array([[*(e[c] for c in NUMBERS), *(held.get(e[c], float(len(held))) for c, held in zip(("atom_u", "atom_v"), self.labels, strict=True)), *e["fp"]] for e in edges], float)
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while True:
            value = x[rows, self.feature[at]]
            by_kind = self.goes_left[at, np.clip(value, 0, self.goes_left.shape[1] - 1).astype(int)]
            new = np.where(np.where(self.categorical[at], by_kind, value <= self.threshold[at]), self.left[at], self.right[at])
            if (new == at).all():
                break
            at = new
        votes = np.zeros((len(x), 2))
        for t in range(at.shape[1]):
            votes += self.votes[at[:, t]]
        return votes[:, 1] / (votes[:, 0] + votes[:, 1])


def judged(model, df: DataFrame, key: str, text: str, n: int = 2) -> DataFrame:
    """(key, top array<struct<bond, proba>>): the n bonds of each molecule most likely to be cut, the likeliest first, the
    smaller bond on ties. Features of bonds never leave the task that reads the molecule."""
    held = df.sparkSession.sparkContext.broadcast(Forest(model))

    def begin():
        trees = quick.Trees(held.value)

        def make(rows: list[tuple]) -> list[dict]:
            read = [_bonds(text) for (text,) in rows]
            if not any(at for at, _, _ in read):
                return [{"top": []} for _ in read]
            proba, done, out = trees([x for _, r, _ in read for x in r], [x for _, _, p in read for x in p]), 0, []
            for at, _, _ in read:
                p, done = proba[done : done + len(at)], done + len(at)
                out.append({"top": [{"bond": at[i], "proba": float(p[i])} for i in np.argsort(-p, kind="stable")[:n].tolist()]})
            return out

        return make

    return map_many(df, key, [text], "top array<struct<bond:int,proba:double>>", begin)


def cuts(df: DataFrame, key: str, whole: str, label: str) -> DataFrame:
    """(key, bond, side): the bonds at which the labelled parts were cut off."""
    return _map(df, key, [whole, label], "cuts array<struct<bond:int,side:int>>", _true_cuts).select(key, F.inline("cuts"))


def cluster_sweep(df: DataFrame, vector: str, ks: list[int], seed: int = 42) -> DataFrame:
    """(k, silhouette, cost, least, most): k-means for each number of clusters that is smaller than the number of rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    n, out = rows.count(), []
    for k in ks:
        if not 1 < k < n:
            continue
        model = KMeans(k=k, seed=seed, maxIter=50).fit(rows)
        sizes = model.summary.clusterSizes
        out.append((k, float(ClusteringEvaluator().evaluate(model.transform(rows))), float(model.summary.trainingCost), int(min(sizes)), int(max(sizes))))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "k int, silhouette double, cost double, least long, most long")


def pick_clusters(sweep: DataFrame) -> int:
    """The number of clusters at which silhouette, cost and balance, each from 0 to 1 over the sweep, agree most (least
    sample deviation); the smallest on ties."""
    from fragmill.operators.summaries import min_max, row_std

    rows = sweep.withColumns({"balance": F.col("most") / F.greatest("least", F.lit(1)), "all": F.lit(0)})
    norm = min_max(rows, "all", ["silhouette", "cost", "balance"])
    spread = F.round(row_std([F.coalesce(f"norm_{c}", F.lit(0.0)) for c in ("silhouette", "cost", "balance")]), 9)
    first = norm.select("k", spread.alias("s")).orderBy("s", "k").first()  # one row a number tried
    if first is None:
        raise ValueError("no number of clusters is smaller than the number of rows")
    return first.k


def representatives(df: DataFrame, key: str, text: str, ks: list[int], size: int = 256, seed: int = 42) -> DataFrame:
    """(cluster, representative, size): molecules clustered by fingerprints into the best number of the given ones, each
    cluster with the member nearest to its centre. Each distinct molecule counts once; what cannot be read is left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from fragmill.operators.summaries import medoids
    from fragmill.plans.lineage import Scratch

    def make(t: str | None) -> dict:
        g = m.parse(t)
        places = m.bits(g, size=size) if g else set()
        return {"fp": [float(i in places) for i in range(size)] if g else None}

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna().groupBy("text").agg(F.min("key").alias("key"))
    prints = Scratch(df.sparkSession).keep(_map(rows, "key", ["text"], "fp array<double>", make).filter("fp is not null"))
    k = pick_clusters(cluster_sweep(prints, "fp", ks, seed))
    vectors = prints.withColumn("features", array_to_vector("fp"))
    out = KMeans(k=k, seed=seed, maxIter=50).fit(vectors).transform(vectors).select("key", "fp", F.col("prediction").alias("cluster"))
    return medoids(out, "key", "fp", "cluster").select("cluster", F.col("medoid").alias("representative"), "size")


def even_odds(df: DataFrame, score: str, label: str) -> float:
    """The score at which a fitted logistic curve gives both labels (0, 1) even odds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("features"), F.col(label).cast("double").alias("label")).dropna()
    fitted = LogisticRegression(regParam=0.0, maxIter=100).fit(rows)
    return -fitted.intercept / fitted.coefficients[0]


def plane(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x, y): the first two principal components of centred vectors; their signs are arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(rows).transform(rows)
    out = PCA(k=2, inputCol="centred", outputCol="p").fit(centred).transform(centred).withColumn("p", vector_to_array("p"))
    return out.select(key, F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def search(edges: DataFrame, trees: list[int], depths: list[int], folds: int = 2, seed: int = 42):
    """The best of several forests by cross-validated area under the precision curve, fitted on all edges, and its score."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    judge = BinaryClassificationEvaluator(labelCol="cut", metricName="areaUnderPR")
    rows = edges.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *edges.columns[:1]), F.lit(folds)))
    best = (-1.0, 0, 0)
    for t in trees:
        for d in depths:
            scores = []
            for f in range(folds):
                fitted = fit_edges(rows.filter(F.col("_fold") != f).drop("_fold"), t, d, seed)
                held_out = fitted.transform(_vectors(rows.filter(F.col("_fold") == f).drop("_fold")).withColumn("cut", (F.col("side") > 0).cast("double")))
                scores.append(judge.evaluate(held_out))
            best = max(best, (sum(scores) / folds, -t, -d))
    return fit_edges(edges, -best[1], -best[2], seed), best[0]
