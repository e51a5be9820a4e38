"""Splitting whole molecules: one entry for a string, a list or a table, with a choice of strategies.

Every strategy computes each distinct molecule once and joins the result back, so repeated rows cost one join. Stages
that run on what an earlier one left open filter first and join after, as a condition would not keep Python from running.

* ``heuristic`` cuts by betweenness; ``grid`` tries several settings and keeps the best by its quality flags.
* ``classifier`` cuts the two bonds a fitted model finds most likely.
* ``transformer`` takes the first readable one of given predictions (``beams``); the model behind them is not part of this.
* ``a->b`` is a, and b where a gives nothing; ``classifier+heuristic`` keeps the longer linker.
* ``adaptive`` is grid, then classifier and beams for molecules that still have flags, each only if strictly better.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.chem import molecule as m
from fragmill.chem import quick
from fragmill.chem import splitting as cut
from fragmill.functions import fragments as fr
from fragmill.operators import learning, scoring
from fragmill.operators.molecules import _map, map_many
from fragmill.plans.lineage import Scratch
from fragmill.sources.tables import require

#: The settings tried (threshold, bonds weighted), in their order, and the rank of the methods on ties.
GRID = ((0.4, False), (0.3, False), (0.5, False), (0.4, True), (0.3, True), (0.5, True))
PRIORITY = {"Heuristic": 0, "Classifier": 0, "Transformer": 1}
STRATEGIES = ("transformer", "classifier", "heuristic", "grid", "transformer->classifier", "classifier->heuristic", "classifier+heuristic", "heuristic->classifier", "heuristic+classifier", "adaptive")


def strategy_of(name: str | None = None, use_transformer: bool | None = None, use_classifier: bool | None = None) -> str:
    """The strategy's name; ``xgboost`` may stand for ``classifier``. Without a name two switches choose, adaptive if none is given."""
    if name is None:
        if use_transformer is None and use_classifier is None:
            return "adaptive"
        return {(True, True): "transformer->classifier", (True, False): "transformer", (False, True): "classifier"}.get((bool(use_transformer), bool(use_classifier)), "heuristic")
    name = name.replace("xgboost", "classifier")
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name}; there are {', '.join(STRATEGIES)}")
    return name


@dataclass
class References:
    """Fingerprints of known E3 ligands and warheads: fixed lists, at most ``most`` of each."""

    e3s: list[set[int]]
    warheads: list[set[int]]

    @classmethod
    def of(cls, e3s: Sequence[str] = (), warheads: Sequence[str] = (), most: int = 10_000) -> References:
        if max(len(e3s), len(warheads)) > most:
            raise ValueError(f"more than {most} references")
        return cls(*([m.bits(g) for g in map(m.parse, x) if g] for x in (e3s, warheads)))

    @classmethod
    def of_table(cls, df: DataFrame, text: str = "smiles", is_warhead: str = "is_warhead", most: int = 10_000) -> References:
        rows = df.select(text, is_warhead).limit(2 * most + 1).collect()
        if len(rows) > 2 * most:
            raise ValueError(f"more than {most} references")
        return cls.of(*(sorted(r[0] for r in rows if r[0] and bool(r[1]) == w) for w in (False, True)), most=most)


def joined(parts: dict | None) -> str | None:
    """``e3.linker.poi``, None if a part is missing."""
    return ".".join(parts[r] for r in ("e3", "linker", "poi")) if parts and all(parts.get(r) for r in ("e3", "linker", "poi")) else None


def _score(prediction: str | None, whole: str | None, refs: References, method: str) -> dict:
    return _rated(prediction, scoring.facts(prediction, whole, refs.e3s, refs.warheads), method)


def _rated(prediction: str | None, facts: dict, method: str) -> dict:
    flags = scoring.flags_of(facts)
    known = (facts.get("e3_sim_to_known_e3") or 0.0) + (facts.get("poi_sim_to_known_wh") or 0.0)
    return {"prediction": prediction, "n_flags": len(flags), "reasons": ";".join(flags) or None, "structural": "structural" in flags, "known": known, "key": ("structural" in flags, len(flags), PRIORITY[method], -known), "swap": "role_swap_suspected" in flags}


def best_orientation(prediction: str | None, whole: str | None, refs: References, method: str) -> dict:
    """The prediction scored; where its roles look exchanged, also with labels exchanged, and the strictly better of both."""
    one = _score(prediction, whole, refs, method)
    if prediction is None or not one["swap"]:
        return one
    two = _score(prediction.replace("[*:1]", "\0").replace("[*:2]", "[*:1]").replace("\0", "[*:2]"), whole, refs, method)
    return two if two["key"] < one["key"] else one


def grid_search(text: str | None, refs: References, grid: Sequence[tuple[float, bool]] = GRID) -> dict:
    """The best candidate of all settings; ends at the first without flags. Settings that cut alike are scored once."""
    mol = m.parse(text)
    best, scores, seen = None, {}, {}
    for threshold, weighted in grid:
        if mol is not None and weighted not in scores:
            scores[weighted] = m.betweenness(mol, m.capacities(mol) if weighted else None)
        bonds = cut.best_cut(mol, cut.candidate_bonds(mol, threshold, scores[weighted])) if mol is not None else None
        if bonds not in seen:
            seen[bonds] = best_orientation(joined(cut.split_at(mol, bonds, refs.e3s)) if bonds else None, text, refs, "Heuristic")
        got = seen[bonds] | {"params": f"betweenness_threshold={threshold},use_capacity_weight={weighted}"}
        if best is None or got["key"] < best["key"]:
            best = got
        if not best["structural"] and best["n_flags"] == 0:
            break
    return best or _score(None, text, refs, "Heuristic")


def spelled_out(roles: dict[str, str], whole: str) -> bool:
    """Whether parts that can be read, written one after the other without their attachment points, are a readable whole."""
    a, b, c = roles["e3"].removesuffix("[*:2]"), roles["linker"].removeprefix("[*:2]").removesuffix("[*:1]"), roles["poi"].removeprefix("[*:1]")
    plain = not any("*" in x for x in (a, b, c)) and all(x[:1].isalpha() or x[:1] == "[" for x in (a, b, c)) and all(x[-1] not in "-=#:/\\" for x in (a, b))
    return plain and a + b + c == whole and quick.read(whole) is not None


class Methods:
    """The heuristic and the classifier for many molecules at once: each is read once, whatever is asked of it."""

    def __init__(self, refs: References, forest=None, threshold: float = 0.4, use_capacity: bool = False):
        self.refs, self.forest, self.threshold, self.use_capacity = refs, forest, threshold, use_capacity
        self.cutter, self.trees = quick.Cutter(refs.e3s), quick.Trees(forest) if forest else None
        self.known = {k: [(quick.places(x), len(x)) for x in held] for k, held in (("e3", refs.e3s), ("wh", refs.warheads))}
        self.parts: dict[tuple[str, str], dict | None] = {}

    def read(self, texts: Sequence[str | None]) -> list[tuple[str | None, quick.Whole | None, list[float] | None]]:
        """(text, molecule, betweenness) of each; molecules that ``quick`` does not read are left to ``splitting``."""
        wholes = [(t, quick.read(t)) for t in texts]
        return [(t, w, quick.betweenness(w) if w else None) for t, w in wholes]

    def heuristic(self, text: str | None, w: quick.Whole | None, score: list[float] | None) -> str | None:
        if w is None:
            return joined(cut.split(text, self.refs.e3s, self.threshold, self.use_capacity))
        got = self.cutter(w, quick.best_cut(w, quick.candidates(w, self.threshold, score)))
        return joined(got[0]) if got else None

    def classifier(self, rows: Sequence[tuple[str | None, quick.Whole | None, list[float] | None]]) -> list[str | None]:
        read = [(w, score) for _, w, score in rows if w]
        likely = iter(quick.likeliest([w for w, _ in read], [s for _, s in read], self.trees))
        out = []
        for text, w, _ in rows:
            got = self.cutter(w, next(likely)) if w else None
            out.append(joined(got[0]) if got else None if w else self._slow(text))
        return out

    def _part(self, role: str, text: str) -> dict | None:
        """What ``scoring.facts`` says of one part; None for what cannot be read. Ligands repeat, linkers seldom do."""
        got = self.parts.get((role, text))
        if got is not None:
            return got
        g = m.parse(text)
        if g is None:
            return None
        if role == "linker":
            return dict(zip(("linker_heavy_atoms_between", "linker_branch_points", "linker_ring_count"), m.linker_shape(g), strict=True))
        if len(self.parts) > quick.KEPT:
            self.parts.clear()
        own = quick.places(m.bits(g))
        got = {f"{role}_mw": round(m.weight(g), 3), f"{role}_heavy_atoms": m.real_atoms(g), f"{role}_disconnected": len(m.pieces(g, set())) > 1, f"{role}_attachment_chain_length": m.chain_length(g)}
        got |= {f"{role}_sim_to_known_{k}": round(quick.nearest(own, held), 9) for k, held in self.known.items()}
        self.parts[role, text] = got
        return got

    def scored(self, w: quick.Whole, low: tuple[int, int] | None, method: str) -> dict:
        """As ``best_orientation`` of a cut: parts written from a molecule join to it again if both bonds were single."""
        if low is None:
            return _score(None, None, self.refs, method)
        parts, cuts = self.cutter(w, low)
        facts = dict.fromkeys(("pred_valid", "has_three_substructures", "has_all_attachment_points"), True) | {"reassembly_ok": all(w.bonds[w.up[x]][2] == 1.0 for x in cuts)}
        for role, part in parts.items():
            facts |= self._part(role, part)
        got = _rated(joined(parts), facts, method)
        return best_orientation(got["prediction"], w.text, self.refs, method) if got["swap"] else got

    def grid(self, text: str | None, w: quick.Whole | None, score: list[float] | None, grid: Sequence[tuple[float, bool]]) -> dict:
        """As ``grid_search``; weights change no betweenness."""
        if w is None:
            return grid_search(text, self.refs, grid)
        best, cuts, seen = None, {}, {}
        for threshold, weighted in grid:
            if threshold not in cuts:
                cuts[threshold] = quick.best_cut(w, quick.candidates(w, threshold, score))
            low = cuts[threshold]
            if low not in seen:
                seen[low] = self.scored(w, low, "Heuristic")
            got = seen[low] | {"params": f"betweenness_threshold={threshold},use_capacity_weight={weighted}"}
            if best is None or got["key"] < best["key"]:
                best = got
            if not best["structural"] and best["n_flags"] == 0:
                break
        return best or _score(None, text, self.refs, "Heuristic")

    def classifier_scored(self, rows: Sequence[tuple[str | None, quick.Whole | None, list[float] | None]]) -> list[dict]:
        read = [(w, score) for _, w, score in rows if w]
        likely = iter(quick.likeliest([w for w, _ in read], [s for _, s in read], self.trees))
        return [self.scored(w, next(likely), "Classifier") if w else best_orientation(self._slow(text), text, self.refs, "Classifier") for text, w, _ in rows]

    def beam(self, prediction: str | None, whole: str | None) -> dict:
        """As ``_score`` of a given prediction."""
        roles = m.roles(prediction)
        parts = {r: self._part(r, t) if t else None for r, t in roles.items()}
        if not whole or not all(parts.values()):
            return _score(prediction, whole, self.refs, "Transformer")
        facts = {"pred_valid": True, "has_three_substructures": True, "has_all_attachment_points": prediction.count("[*:1]") == 2 and prediction.count("[*:2]") == 2}
        facts["reassembly_ok"] = spelled_out(roles, whole) or m.reassembles(prediction, whole)
        return _rated(prediction, facts | parts["e3"] | parts["linker"] | parts["poi"], "Transformer")

    def _slow(self, text: str | None) -> str | None:
        mol, edges = m.parse(text), cut.edge_features(text)
        if len(edges) < 2:
            return None
        likely = sorted((-p, e["bond"]) for e, p in zip(edges, self.forest(edges).tolist(), strict=True))
        return joined(cut.split_at(mol, (likely[0][1], likely[1][1]), self.refs.e3s))


_SCORED = "prediction string, n_flags int, reasons string, structural boolean, known double"


def _key(method: str, prefix: str = "") -> Column:
    c = lambda x: F.col(prefix + x)
    return F.struct(c("structural").cast("int").alias("structural"), c("n_flags"), F.lit(PRIORITY[method]).alias("priority"), (-c("known")).alias("known"))


class Splitter:
    """Strategies over a table of distinct molecules (id, text)."""

    def __init__(self, base: DataFrame, refs: References, model=None, beams: DataFrame | None = None, grid: Sequence[tuple[float, bool]] = GRID, threshold: float = 0.4, use_capacity: bool = False):
        self.base, self.model, self.beams, self.grid = base, model, beams, tuple(grid)
        self.threshold, self.use_capacity = threshold, use_capacity
        self.held = base.sparkSession.sparkContext.broadcast(refs)
        self.scratch, self.forest = Scratch(base.sparkSession), None

    def _methods(self, rows: DataFrame, fields: str, make, model: bool) -> DataFrame:
        """(id, fields): make(methods, molecules as read) gives a dict for each."""
        if model and self.model is None:
            raise ValueError("this strategy needs a fitted model")
        if model and self.forest is None:
            self.forest = rows.sparkSession.sparkContext.broadcast(learning.Forest(self.model))
        held, forest, t, c = self.held, self.forest if model else None, self.threshold, self.use_capacity

        def begin():
            methods = Methods(held.value, forest.value if forest else None, t, c)
            return lambda many: make(methods, methods.read([text for (text,) in many]))

        return map_many(rows, "id", ["text"], fields, begin)

    def heuristic(self, rows: DataFrame) -> DataFrame:
        """(id, prediction) by betweenness."""
        return self._methods(rows, "prediction string", lambda by, read: [{"prediction": by.heuristic(*x)} for x in read], False)

    def classifier(self, rows: DataFrame) -> DataFrame:
        """(id, prediction) by the model's two most likely bonds; null where a molecule has fewer or they leave no three parts."""
        return self._methods(rows, "prediction string", lambda by, read: [{"prediction": p} for p in by.classifier(read)], True)

    def given(self, rows: DataFrame, repaired: bool = False) -> DataFrame:
        """(id, prediction): the first of the beams (id, beams) that is well labelled and readable, or becomes so by repair."""
        if self.beams is None:
            raise ValueError("this strategy needs beams")
        from fragmill.chem.repair import repair

        def make(text: str | None, beams: list[str | None] | None) -> dict:
            for b in beams or []:
                got = repair(b, text)[0] if repaired else b
                if got and all(m.roles(got).values()) and all(m.parse(p) for p in got.split(".")):
                    return {"prediction": got}
            return {"prediction": None}

        return _map(rows.join(self.beams, "id", "left"), "id", ["text", "beams"], "prediction string", make)

    def fallback(self, first: DataFrame, name: str, second, other: str) -> DataFrame:
        """(id, prediction, model_name): the second method runs only on what the first left null, and its name stands even
        where it finds nothing."""
        one = self.scratch.keep(first)
        failed = self.base.join(one.filter("prediction is null").select("id"), "id", "left_semi")
        two = second(failed).select("id", F.col("prediction").alias("later"), F.lit(True).alias("tried"))
        out = one.join(two, "id", "left")
        return out.select("id", F.coalesce("prediction", "later").alias("prediction"), F.when(F.col("tried"), F.lit(other)).otherwise(F.lit(name)).alias("model_name"))

    def either(self, first: str, other: str) -> DataFrame:
        """(id, prediction, model_name): heuristic and classifier as in ``fallback``, in one pass."""

        def make(by: Methods, read: list) -> list[dict]:
            if first == "Classifier":
                one = by.classifier(read)
                two = [by.heuristic(*x) if p is None else None for x, p in zip(read, one, strict=True)]
            else:
                one = [by.heuristic(*x) for x in read]
                later = iter(by.classifier([x for x, p in zip(read, one, strict=True) if p is None]))
                two = [next(later) if p is None else None for p in one]
            return [{"prediction": q if p is None else p, "model_name": other if p is None else first} for p, q in zip(one, two, strict=True)]

        return self._methods(self.base, "prediction string, model_name string", make, True)

    def longest(self) -> DataFrame:
        """(id, prediction, model_name): the longer linker of both methods, the classifier's on ties."""
        atoms = lambda c: fr.heavy_atoms(fr.split_roles(F.col(c))["linker"])
        both = self._methods(self.base, "x string, h string", lambda by, read: [{"x": x, "h": by.heuristic(*r)} for x, r in zip(by.classifier(read), read, strict=True)], True)
        first = atoms("x") >= atoms("h")
        return both.select("id", F.when(first, F.col("x")).otherwise(F.col("h")).alias("prediction"), F.when(first, "Classifier").otherwise("Heuristic").alias("model_name"))

    def gridded(self, model: bool = False) -> DataFrame:
        """(id, scored fields, params, model_name, priority) of the best setting; with the model also the classifier's for
        molecules that still have flags, if strictly better."""
        grid = self.grid

        def make(by: Methods, read: list) -> list[dict]:
            out = [by.grid(*x, grid) | {"model_name": "Heuristic", "priority": PRIORITY["Heuristic"]} for x in read]
            flagged = [i for i, r in enumerate(out) if r["n_flags"] > 0] if model else []
            for i, new in zip(flagged, by.classifier_scored([read[i] for i in flagged]) if flagged else [], strict=True):
                if new["prediction"] is not None and new["key"] < out[i]["key"]:
                    out[i] = new | {"model_name": "Classifier", "priority": PRIORITY["Classifier"]}
            return out

        return self._methods(self.base, _SCORED + ", params string, model_name string, priority int", make, model)

    def _scored(self, rows: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
        """(key, scored fields) of given predictions."""
        held = self.held

        def begin():
            by = Methods(held.value)
            return lambda many: [by.beam(p, t) for t, p in many]

        return map_many(rows.join(candidates, "id"), key, ["text", "prediction"], _SCORED, begin)

    def _replaced(self, now: DataFrame, new: DataFrame, method: str) -> DataFrame:
        """now, with new's row where its key is strictly smaller; parameters belong to the heuristic only."""
        names = ["prediction", "n_flags", "reasons", "structural", "known"]
        later = new.select("id", *[F.col(c).alias(f"new_{c}") for c in names])
        both = now.join(later, "id", "left")
        held = F.struct(F.col("structural").cast("int").alias("structural"), F.col("n_flags"), F.col("priority"), (-F.col("known")).alias("known"))
        better = F.col("new_prediction").isNotNull() & (_key(method, "new_") < held)
        pick = lambda new, old: F.when(better, new).otherwise(old)
        return both.select("id", *[pick(F.col(f"new_{c}"), F.col(c)).alias(c) for c in names], pick(F.lit(None).cast("string"), F.col("params")).alias("params"), pick(F.lit(method), F.col("model_name")).alias("model_name"), pick(F.lit(PRIORITY[method]), F.col("priority")).alias("priority"))

    def adaptive(self) -> DataFrame:
        """(id, prediction, model_name, params, n_flags, reasons): later stages take only molecules that still have flags."""
        now = self.gridded(self.model is not None)
        if self.beams is not None:
            now = self.scratch.keep(now)
            rows = self.base.join(now.filter("n_flags > 0").select("id"), "id", "left_semi")
            each = self.beams.select("id", F.posexplode("beams").alias("at", "prediction")).filter("prediction is not null").select("id", "prediction", F.struct("id", "at").alias("beam"))
            scored = self._scored(rows, each, "beam").select("beam.id", "beam.at", "prediction", "n_flags", "reasons", "structural", "known")
            order = F.struct(_key("Transformer"), F.col("at"))
            best = scored.groupBy("id").agg(F.min_by(F.struct("prediction", "n_flags", "reasons", "structural", "known"), order).alias("b")).select("id", "b.*")
            now = self._replaced(now, best, "Transformer")
        return now.select("id", "prediction", "model_name", "params", "n_flags", "reasons")

    def run(self, strategy: str) -> DataFrame:
        named = lambda df, n: df.withColumn("model_name", F.lit(n))
        if strategy == "heuristic":
            return named(self.heuristic(self.base), "Heuristic")
        if strategy == "classifier":
            return named(self.classifier(self.base), "Classifier")
        if strategy == "transformer":
            return named(self.given(self.base), "Transformer")
        if strategy == "transformer->classifier":
            return self.fallback(self.given(self.base), "Transformer", self.classifier, "Classifier")
        if strategy == "classifier->heuristic":
            return self.either("Classifier", "Heuristic")
        if strategy == "heuristic->classifier":
            return self.either("Heuristic", "Classifier")
        if strategy == "grid":
            return self.gridded().select("id", "prediction", "model_name", "params", "n_flags", "reasons")
        return self.longest() if "+" in strategy else self.adaptive()


def split(df: DataFrame, text: str, strategy: str = "adaptive", refs: References | None = None, model=None, beams: DataFrame | None = None, grid: Sequence[tuple[float, bool]] = GRID, threshold: float = 0.4, use_capacity: bool = False) -> DataFrame:
    """df with ``default_pred_n0`` (null where nothing was found, the molecule is null or cannot be read) and ``model_name``;
    grid and adaptive add ``heuristic_params`` (of the heuristic only), ``n_flags`` and ``review_reasons``.

    As many rows come out as went in. ``beams`` has (the text column, beams array<string>). Columns of those names are replaced.
    """
    require(df, [text])
    strategy, made = strategy_of(strategy), ["default_pred_n0", "model_name", "heuristic_params", "n_flags", "review_reasons"]
    rows = df.drop(*[c for c in made if c in df.columns]).withColumn("_id", F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    scratch = Scratch(df.sparkSession)
    base = scratch.keep(rows.groupBy("_id").agg(F.first(f"`{text}`").alias("text")).select(F.col("_id").alias("id"), "text"))
    if beams is not None:
        beams = beams.filter(F.col(f"`{text}`").isNotNull()).groupBy(F.sha2(F.col(f"`{text}`"), 256).alias("id")).agg(F.flatten(F.collect_list("beams")).alias("beams"))
    out = Splitter(base, refs or References([], []), model, beams, grid, threshold, use_capacity).run(strategy)
    names = {"id": "_id", "prediction": "default_pred_n0", "params": "heuristic_params", "reasons": "review_reasons"}
    return rows.join(out.withColumnsRenamed({k: v for k, v in names.items() if k in out.columns}), "_id", "left").drop("_id")


def split_molecules(spark: SparkSession, x: str | Sequence[str | None] | DataFrame, column: str = "smiles", **kw):
    """What goes in comes out: a dict for a string, a list of dicts in order for a list, a DataFrame for one."""
    if isinstance(x, DataFrame):
        return split(x, column, **kw)
    texts = [x] if isinstance(x, str) else list(x)
    df = spark.createDataFrame(list(enumerate(texts)), f"_at long, `{column}` string")
    rows = [r.asDict() for r in split(df, column, **kw).orderBy("_at").collect()]  # as many rows as the caller gave
    for r in rows:
        r.pop("_at")
    return rows[0] if isinstance(x, str) else rows
