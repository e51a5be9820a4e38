"""Quality control of splits without a known answer: all checks of a row, its flags counted and named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.chem import molecule as m
from fragmill.chem import splitting as cut
from fragmill.operators import learning, molecules, scoring
from fragmill.operators.molecules import _map
from fragmill.operators.quality import count_flags
from fragmill.operators.splitting import References

#: The similarity of the least similar part below which two methods disagree, and the lead of the first
#: bond over the second below which a classifier is unsure.
DISAGREE, UNSURE = 0.6, 0.15


def agreement(df: DataFrame, key: str, whole: str, prediction: str, refs: References, threshold: float = 0.4) -> DataFrame:
    """(key, heuristic_e3, heuristic_linker, heuristic_poi, heuristic_min_similarity): the heuristic's own split, and how
    similar its least similar part is to the predicted one; null where either is missing."""
    held = df.sparkSession.sparkContext.broadcast(refs)

    def make(w: str | None, p: str | None) -> dict:
        own, given = cut.split(w, held.value.e3s, threshold), m.roles(p)
        out = {f"heuristic_{r}": t for r, t in own.items()}
        pairs = [(m.parse(own[r]), m.parse(given[r])) for r in own]
        known = [m.tanimoto(m.bits(a), m.bits(b)) for a, b in pairs if a is not None and b is not None]
        return out | ({"heuristic_min_similarity": round(min(known), 3)} if known else {})

    return _map(df, key, [whole, prediction], "heuristic_e3 string, heuristic_linker string, heuristic_poi string, heuristic_min_similarity double", make)


def confidence(model, df: DataFrame, key: str, whole: str) -> DataFrame:
    """(key, top_probability, margin): the classifier's likeliest bond, and its lead over the second; null for one bond."""
    at = lambda k: F.get("top", F.lit(k))["proba"]
    top = learning.judged(model, df, key, whole).filter(F.size("top") > 0)
    return top.select(key, F.bround(at(0), 3).alias("top_probability"), F.bround(at(0) - at(1), 3).alias("margin"))


def check(df: DataFrame, key: str, whole: str, prediction: str, e3_refs: list[str], warhead_refs: list[str], model=None) -> DataFrame:
    """One row a key (unique) with the facts of ``score_splits``, structure scans, agreement with the heuristic and, given a
    model, its confidence; ``flag_*``, ``n_flags`` and ``review_reasons`` count all of them. A molecule that cannot be read is
    structural; what is unknown raises no flag."""
    refs = References.of(e3_refs, warhead_refs)
    parts = [
        scoring.score_splits(df, key, prediction, whole, e3_refs, warhead_refs).drop("n_flags", "review_reasons"),
        molecules.scans(df, key, whole),
        agreement(df, key, whole, prediction, refs),
    ]
    if model is not None:
        parts.append(confidence(model, df, key, whole))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "left")
    flags = {c.removeprefix("flag_"): F.col(c) for c in out.columns if c.startswith("flag_")}
    flags |= {"unstable": F.col("unstable"), "leaving_group": F.col("leaving_group"), "method_disagreement": F.col("heuristic_min_similarity") < DISAGREE}
    if model is not None:
        flags["low_confidence"] = F.col("margin") < UNSURE
    return count_flags(out, flags)
