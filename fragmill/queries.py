"""Named queries over the tables of a folder, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.functions import fragments as fr
from fragmill.operators import choose, curation, dictionary, generate, graph, learning, malformed, molecules, qc, quality, sampling, scoring, splitting, summaries
from fragmill.plans.lineage import Scratch
from fragmill.sources.tables import table
from fragmill.streaming import metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Records that cannot be loaded


_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_BRACKETED = rf"\[[0-9]*(?:{malformed._SYMBOL}|\*)@{{0,2}}(?:H[0-9]*)?(?:[+-][0-9]+|\++|-+)?(?::[0-9]+)?\]"
_ATOM = rf"(?:{_BRACKETED}|Cl|Br|[BCNOPSFIbcnops*])"
_BLANK = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
_WELL_FORMED = rf"""(regexp_full_match(p, '[/\\]*{_ATOM}(?:{_ATOM}|[-=#:/\\.()]|[0-9]|%[0-9][0-9])*') and not regexp_matches(p, '[-=#:/\\.]$|\(\)')
and len(replace(p, '(', '')) = len(replace(p, ')', '')) and list_bool_and(list_transform(range(1, len(p) + 1), lambda i: len(replace(p[:i], '(', '')) <= len(replace(p[:i], ')', ''))))
and list_bool_and(list_transform(regexp_extract_all(regexp_replace(p, '{_BRACKETED}', 'C', 'g'), '%[0-9][0-9]|[0-9]'), lambda d: len(list_filter(regexp_extract_all(regexp_replace(p, '{_BRACKETED}', 'C', 'g'), '%[0-9][0-9]|[0-9]'), lambda x: ltrim(x, '%0') = ltrim(d, '%0'))) % 2 = 0)) is not false)"""


@query(
    f"""with f as (select line_id, feed, raw_line as s, regexp_full_match(raw_line, '(?s){_FIELD}(?:,{_FIELD})*') as quoted, case feed when 'curated' then regexp_full_match(raw_line, '(?s){_FIELD}(?:,{_FIELD}){{5}}') else regexp_full_match(raw_line, '(?s){_FIELD}(?:,{_FIELD}){{4}}') end as wide,
regexp_extract(raw_line, '(?s)^{_FIELD},{_FIELD}', 2) as c from raw_lines),
v as (select *, regexp_replace(case when c[1] = '"' then replace(c[2:-2], '""', '"') else c end, '^{_BLANK}|{_BLANK}$', '', 'g') as v from f),
w as (select line_id, quoted, wide, case when feed = 'curated' then [v] when v = '' then [] when len(v) - len(replace(v, '.', '')) = 2 and len(v) - len(replace(v, '[*:1]', '')) = 10 and len(v) - len(replace(v, '[*:2]', '')) = 10 then string_split(v, '.') else [''] end as parts from v),
r as (select line_id, case when not quoted then 'quoting' when not wide then 'column_count' when list_bool_and(list_transform(parts, lambda p: {_WELL_FORMED})) is false then 'invalid_value' end as reason from w)
select line_id, reason from r where reason is not null"""
)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "raw_lines", ["line_id", "feed", "raw_line"])
    return malformed.rejected(lines).select("line_id", "reason")


@query()
def p1_broken_fields(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "raw_lines", ["line_id", "feed", "raw_line"])
    return malformed.judge(lines).filter("reason is not null").groupBy("feed", "reason", "broken_field").agg(F.count(F.lit(1)).alias("n"))


@query()
def p1_loaded_curated(spark: SparkSession, folder: str) -> DataFrame:
    return malformed.loaded(table(spark, folder, "raw_lines", ["line_id", "feed", "raw_line"]), malformed.CURATED)


@query()
def p1_loaded_prediction(spark: SparkSession, folder: str) -> DataFrame:
    return malformed.loaded(table(spark, folder, "raw_lines", ["line_id", "feed", "raw_line"]), malformed.PREDICTION)


# Fragment strings

_PARTS = "string_split(default_pred_n0, '.')"
_ROLE = "case when len({p}) = 3 then list_filter({p}, lambda p: {cond})[-1] end"


def _role_sql(parts: str, role: str) -> str:
    one, two = "contains(p, '[*:1]')", "contains(p, '[*:2]')"
    cond = {"e3": f"{two} and not {one}", "linker": f"{one} and {two}", "poi": f"{one} and not {two}"}[role]
    return _ROLE.format(p=parts, cond=cond)


@query(f"select pred_id, {', '.join(f'{_role_sql(_PARTS, r)} as {r}' for r in ('e3', 'linker', 'poi'))} from predictions")
def split_prediction(spark, folder):
    rows = table(spark, folder, "predictions", ["pred_id", "default_pred_n0"])
    return rows.select("pred_id", fr.split_roles(F.col("default_pred_n0")).alias("r")).select("pred_id", "r.e3", "r.linker", "r.poi")


@query(f"select pred_id, {_PARTS}[1] as e3, {_PARTS}[2] as linker, {_PARTS}[3] as poi from predictions")
def positional_split(spark, folder):
    rows = table(spark, folder, "predictions", ["pred_id", "default_pred_n0"])
    return rows.select("pred_id", fr.split_positions(F.col("default_pred_n0")).alias("r")).select("pred_id", "r.e3", "r.linker", "r.poi")


_N = "(len({c}) - len(replace({c}, '{s}', ''))) // {n}"
_THREE = "coalesce({} = 2, false)".format(_N.format(c="default_pred_n0", s=".", n=1))
_POINTS = "coalesce({} = 2 and {} = 2, false)".format(_N.format(c="default_pred_n0", s="[*:1]", n=5), _N.format(c="default_pred_n0", s="[*:2]", n=5))


@query(f"select pred_id, {_THREE} as three_parts, {_POINTS} as all_points from predictions")
def structural_predicates(spark, folder):
    p = F.col("default_pred_n0")
    return table(spark, folder, "predictions", ["pred_id", "default_pred_n0"]).select("pred_id", fr.three_parts(p).alias("three_parts"), fr.all_attachment_points(p).alias("all_points"))


@query("select pred_id, replace(replace(replace(default_pred_n0, '[*:1]', '[*:x]'), '[*:2]', '[*:1]'), '[*:x]', '[*:2]') as swapped from predictions")
def swap_labels(spark, folder):
    return table(spark, folder, "predictions", ["pred_id", "default_pred_n0"]).select("pred_id", fr.swap_labels(F.col("default_pred_n0")).alias("swapped"))


@query("select row_id, try_cast(nullif(regexp_extract(e3_binder_smiles_with_direction, '\\[\\*:(\\d+)\\]', 1), '') as integer) as e3_label, regexp_replace(poi_ligand_smiles_with_direction, '\\[\\*:1\\]|\\[1\\*\\]', '[*:3]', 'g') as relabelled from curated")
def attachment_labels(spark, folder):
    rows = table(spark, folder, "curated", ["row_id", "e3_binder_smiles_with_direction", "poi_ligand_smiles_with_direction"])
    return rows.select("row_id", fr.first_label(F.col("e3_binder_smiles_with_direction")).alias("e3_label"), fr.rename_label(F.col("poi_ligand_smiles_with_direction"), 1, 3).alias("relabelled"))


@query(
    """select row_id, key, value, case when regexp_matches(value, '^\\d+$') then 'int' when lower(value) in ('true', 'false') then 'bool' when lower(value) = 'none' then 'none' else 'string' end as kind
from (select row_id, unnest(regexp_extract_all(notes, '\\(([A-Za-z_]+)=([^)]*)\\)', 1)) as key, unnest(regexp_extract_all(notes, '\\(([A-Za-z_]+)=([^)]*)\\)', 2)) as value from curated)"""
)
def parse_notes(spark, folder):
    return table(spark, folder, "curated", ["row_id", "notes"]).select("row_id", F.inline(fr.notes_entries(F.col("notes"))))


@query("select row_id, sha256(protac_smiles || '|' || linker_smiles || '|') as mol_id from curated")
def mol_id_hash(spark, folder):
    return table(spark, folder, "curated", ["row_id", "protac_smiles", "linker_smiles"]).select("row_id", fr.mol_id(F.col("protac_smiles"), F.col("linker_smiles")).alias("mol_id"))


@query("select sample_id, labels from finetuning where labels is not null and not regexp_matches(labels, '\\.\\[Cl-\\]\\.|\\.\\[Na\\+\\]')")
def regex_anti_filter(spark, folder):
    rows = table(spark, folder, "finetuning", ["sample_id", "labels"])
    return rows.filter(F.col("labels").isNotNull() & ~F.col("labels").rlike(r"\.\[Cl-\]\.|\.\[Na\+\]"))


_LABELS = "string_split(labels, '.')"


@query(f"select sample_id, {_role_sql(_LABELS, 'linker')} as linker, {_role_sql(_LABELS, 'e3')} || '.' || {_role_sql(_LABELS, 'poi')} as ligands from finetuning")
def label_projection(spark, folder):
    rows = table(spark, folder, "finetuning", ["sample_id", "labels"])
    return rows.select("sample_id", fr.label_projection(F.col("labels"), "linker").alias("linker"), fr.label_projection(F.col("labels"), "ligands").alias("ligands"))


@query(f"select pred_id, case when {_THREE} and {_POINTS} then default_pred_n0 end as prediction from predictions")
def invalid_to_null(spark, folder):
    p = F.col("default_pred_n0")
    rows = table(spark, folder, "predictions", ["pred_id", "default_pred_n0"])
    return rows.select("pred_id", F.when(fr.three_parts(p) & fr.all_attachment_points(p), p).alias("prediction"))


@query("select row_id, e3_binder_smiles_with_direction || '.' || linker_smiles_with_direction || '.' || poi_ligand_smiles_with_direction as labels, protac_smiles as text from curated where protac_smiles is not null")
def training_pairs(spark, folder):
    cols = ["e3_binder_smiles_with_direction", "linker_smiles_with_direction", "poi_ligand_smiles_with_direction"]
    rows = table(spark, folder, "curated", ["row_id", "protac_smiles", *cols]).filter("protac_smiles is not null")
    return rows.select("row_id", fr.join_roles(*[F.col(c) for c in cols]).alias("labels"), F.col("protac_smiles").alias("text"))


# Quality flags

_FLAGS = {
    "missing": "default_pred_n0 is null",
    "parts": f"default_pred_n0 is not null and not {_THREE}",
    "points": f"default_pred_n0 is not null and not {_POINTS}",
    "reported": "n_flags > 0",
    "unscored": "n_flags is null",
}


def _flagged(spark, folder):
    p = F.col("default_pred_n0")
    rows = table(spark, folder, "predictions", ["pred_id", "protac_id", "default_pred_n0", "n_flags"]).withColumnRenamed("n_flags", "given_flags")
    return quality.count_flags(rows, {"missing": p.isNull(), "parts": p.isNotNull() & ~fr.three_parts(p), "points": p.isNotNull() & ~fr.all_attachment_points(p), "reported": F.col("given_flags") > 0, "unscored": F.col("given_flags").isNull()})


@query(
    f"""select pred_id, n_flags, nullif(reasons, '') as review_reasons from (select pred_id, {' + '.join(f'coalesce({s}, false)::int' for s in _FLAGS.values())} as n_flags,
concat_ws(';', {', '.join(f"case when {s} then '{n}' end" for n, s in _FLAGS.items())}) as reasons from predictions) where n_flags > 0"""
)
def qc_triage(spark, folder):
    return _flagged(spark, folder).filter("n_flags > 0").select("pred_id", "n_flags", "review_reasons").orderBy(F.desc("n_flags"), "pred_id")


@query(" union all ".join(f"select '{n}' as flag, count(*) filter ({s}) as n, count(*) filter ({s}) / count(*) as share from predictions" for n, s in _FLAGS.items()))
def flag_frequency(spark, folder):
    return quality.flag_frequency(_flagged(spark, folder), list(_FLAGS))


# Choosing among methods

_METHODS = ("Heuristic", "XGBoost", "Transformer")
_FIRST = "(select protac_id, {cols} from predictions group by protac_id)".format(
    cols=", ".join(f"arg_min(struct_pack(p := default_pred_n0, f := n_flags), pred_id) filter (model_name = '{m}') as c_{m}" for m in _METHODS)
)


def _candidates(spark, folder):
    """One row a molecule: of each method the first prediction and its flags."""
    rows = table(spark, folder, "predictions", ["pred_id", "protac_id", "default_pred_n0", "model_name", "n_flags"])
    held = lambda m: F.min_by(F.when(F.col("model_name") == m, F.struct(F.col("default_pred_n0").alias("p"), F.col("n_flags").alias("f"))), F.when(F.col("model_name") == m, F.col("pred_id"))).alias(f"c_{m}")
    return rows.groupBy("protac_id").agg(*[held(m) for m in _METHODS])


@query(f"select protac_id, coalesce(c_XGBoost.p, c_Heuristic.p, c_Transformer.p) as chosen, case when c_XGBoost.p is not null then 'XGBoost' when c_Heuristic.p is not null then 'Heuristic' else 'Transformer' end as method from {_FIRST}")
def fallback_coalesce(spark, folder):
    rows = _candidates(spark, folder)
    return choose.fallback(rows, [(m, F.col(f"c_{m}.p")) for m in ("XGBoost", "Heuristic", "Transformer")]).select("protac_id", "chosen", "method")


@query(f"select protac_id, case when c_Heuristic.p is null then c_XGBoost.p else c_Heuristic.p end as value, case when c_Heuristic.p is null then 'XGBoost' else 'Heuristic' end as method from {_FIRST}")
def fallback_two_phase(spark, folder):
    rows = _candidates(spark, folder)
    first = rows.select("protac_id", F.col("c_Heuristic.p").alias("value"), F.lit("Heuristic").alias("method"))
    second = rows.filter("c_Heuristic.p is null").select("protac_id", F.col("c_XGBoost.p").alias("value"), F.lit("XGBoost").alias("method"))
    return choose.patch(first, second, "protac_id", "value")


def _atoms_sql(x: str) -> str:
    return f"coalesce(len(regexp_extract_all(regexp_replace({x}, '\\[\\*:\\d+\\]|\\[H\\]|\\*', '', 'g'), '\\[[^\\]]*\\]|Cl|Br|[BCNOPSFIbcnops]')), -1)"


_LX, _LH = (_atoms_sql(_role_sql(f"string_split(c_{m}.p, '.')", "linker")) for m in ("XGBoost", "Heuristic"))


@query(f"select protac_id, case when x >= h then 'XGBoost' else 'Heuristic' end as method, greatest(x, h)::int as linker_atoms from (select protac_id, {_LX} as x, {_LH} as h from {_FIRST})")
def select_longest(spark, folder):
    atoms = lambda m: fr.heavy_atoms(fr.split_roles(F.col(f"c_{m}.p"))["linker"])
    rows = _candidates(spark, folder).select("protac_id", atoms("XGBoost").alias("x"), atoms("Heuristic").alias("h"))
    return rows.select("protac_id", F.when(F.col("x") >= F.col("h"), "XGBoost").otherwise("Heuristic").alias("method"), F.greatest("x", "h").alias("linker_atoms"))


def _key_sql(m: str, priority: int) -> str:
    bad = _THREE.replace("default_pred_n0", f"c_{m}.p"), _POINTS.replace("default_pred_n0", f"c_{m}.p")
    return f"struct_pack(structural := (not ({bad[0]} and {bad[1]}))::int, n_flags := coalesce(c_{m}.f, 9), priority := {priority})"


@query(
    f"""with c as (select protac_id, c_Heuristic.p as p0, c_XGBoost.p as p1, c_Transformer.p as p2, {_key_sql('Heuristic', 0)} as k0, {_key_sql('XGBoost', 0)} as k1, {_key_sql('Transformer', 1)} as k2 from {_FIRST}),
s as (select *, k0.n_flags > 0 and p1 is not null and k1 < k0 as take1 from c),
t as (select protac_id, case when take1 then p1 else p0 end as p, case when take1 then k1 else k0 end as k, p2, k2 from s)
select protac_id, case when take2 then p2 else p end as prediction, case when take2 then k2.n_flags else k.n_flags end as n_flags from (select *, k.n_flags > 0 and p2 is not null and k2 < k as take2 from t)"""
)
def adaptive_escalation(spark, folder):
    def key(m, priority):
        p = F.col(f"c_{m}.p")
        return F.struct((~(fr.three_parts(p) & fr.all_attachment_points(p))).cast("int").alias("structural"), F.coalesce(F.col(f"c_{m}.f"), F.lit(9)).alias("n_flags"), F.lit(priority).alias("priority"))

    rows = _candidates(spark, folder).select("protac_id", *[F.col(f"c_{m}.p").alias(f"p{i}") for i, m in enumerate(_METHODS)], *[key(m, i // 2).alias(f"k{i}") for i, m in enumerate(_METHODS)])
    value, rank = choose.escalate([(F.col("p1"), F.col("k1")), (F.col("p2"), F.col("k2"))], F.col("p0"), F.col("k0"), F.col("k0.n_flags") > 0)
    return rows.select("protac_id", value.alias("prediction"), rank["n_flags"].alias("n_flags"))


#: The thresholds and weightings tried, in their order.
_GRID = [f"betweenness_threshold={t},use_capacity_weight={c}" for t, c in ((0.4, False), (0.3, False), (0.5, False), (0.4, True), (0.3, True), (0.5, True))]
_PLACE = "case heuristic_params " + " ".join(f"when '{g}' then {i}" for i, g in enumerate(_GRID)) + " else 99 end"


@query(f"select protac_id, arg_min(pred_id, row(n_flags > 0, case when n_flags > 0 then n_flags else 0 end, {_PLACE}, pred_id)) as pred_id, count(*) as tried from predictions where model_name = 'Heuristic' and n_flags is not null group by protac_id")
def grid_first_clean(spark, folder):
    rows = table(spark, folder, "predictions", ["pred_id", "protac_id", "model_name", "heuristic_params", "n_flags"]).filter("model_name = 'Heuristic' and n_flags is not null")
    place = F.lit(99)
    for i, g in enumerate(_GRID):
        place = F.when(F.col("heuristic_params") == g, F.lit(i)).otherwise(place)
    order = F.struct((F.col("n_flags") > 0).alias("dirty"), F.greatest("n_flags", F.lit(0)).alias("f"), place.alias("place"), F.col("pred_id").alias("id"))
    return rows.groupBy("protac_id").agg(F.min_by("pred_id", order).alias("pred_id"), F.count(F.lit(1)).alias("tried"))


@query("select protac_id, arg_min(pred_id, row(coalesce(n_flags, 9), case when model_name = 'Transformer' then 1 else 0 end, pred_id)) as pred_id from predictions where default_pred_n0 is not null group by protac_id")
def rank_key_best(spark, folder):
    rows = table(spark, folder, "predictions", ["pred_id", "protac_id", "default_pred_n0", "model_name", "n_flags"]).filter("default_pred_n0 is not null")
    order = [F.coalesce("n_flags", F.lit(9)).alias("f"), (F.col("model_name") == "Transformer").cast("int").alias("m"), F.col("pred_id").alias("i")]
    return choose.first_per_key(rows, ["protac_id"], order, ["pred_id"])


@query("select l_orderkey, list_resize(list(l_partkey order by l_extendedprice desc, l_linenumber)[:3], 3, -1) as top from lineitem group by l_orderkey")
def topn_padded(spark, folder):
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"])
    return choose.top_n_padded(rows, "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber")], "l_partkey", 3)


@query("select protac_id, run_id, pred_id, rank::int as rank from (select *, row_number() over (partition by protac_id, run_id order by predicted_at desc, pred_id desc) as rank from predictions) where rank <= 2")
def latest_predictions(spark, folder):
    rows = table(spark, folder, "predictions", ["protac_id", "run_id", "pred_id", "predicted_at"])
    return choose.top_n(rows, ["protac_id", "run_id"], [F.desc("predicted_at"), F.desc("pred_id")], 2).select("protac_id", "run_id", "pred_id", "rank")


@query("select l_orderkey, coalesce(arg_min(l_linenumber, row(-l_extendedprice, l_linenumber)) filter (l_returnflag = 'R'), -1)::bigint as returned, coalesce(arg_min(l_linenumber, row(-l_extendedprice, l_linenumber)) filter (l_returnflag = 'N'), -1)::bigint as kept from lineitem group by l_orderkey")
def argmax_per_class(spark, folder):
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"])
    return choose.argmax_per_class(rows, "l_orderkey", {"returned": F.col("l_returnflag") == "R", "kept": F.col("l_returnflag") == "N"}, "l_linenumber", "l_extendedprice")


@query("select l_orderkey, s[1] as best, round(s[1] - s[2], 6) as margin from (select l_orderkey, list_reverse_sort(list(l_extendedprice)) as s from lineitem where l_extendedprice is not null group by 1)")
def margin_top2(spark, folder):
    out = choose.margin(table(spark, folder, "lineitem", ["l_orderkey", "l_extendedprice"]), "l_orderkey", "l_extendedprice")
    return out.withColumn("margin", F.round("margin", 6))


@query("select l_orderkey, l_linenumber, case greatest(l_quantity, l_discount * 100, l_tax * 500) when l_quantity then 0 when l_discount * 100 then 1 else 2 end as best from lineitem")
def best_beam_idxmax(spark, folder):
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    return rows.select("l_orderkey", "l_linenumber", choose.best_index([F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 500]).alias("best"))


# Summaries


@query("select source, count(*) as n, count(*) / sum(count(*)) over () as share from curated where source is not null group by source")
def fg_distribution(spark, folder):
    return summaries.distribution(table(spark, folder, "curated", ["source"]), "source")


@query("select l_returnflag, l_linestatus, count(*) as n, count(*) / sum(count(*)) over (partition by l_returnflag) as share from lineitem group by 1, 2")
def fg_conditional(spark, folder):
    return summaries.conditional(table(spark, folder, "lineitem", ["l_returnflag", "l_linestatus"]), "l_returnflag", "l_linestatus")


@query("select e3_binder_id, list_sort(list(distinct linker_smiles_with_direction)) as members from curated where e3_binder_id is not null and linker_smiles_with_direction is not null group by 1")
def multimap(spark, folder):
    return summaries.multimap(table(spark, folder, "curated", ["e3_binder_id", "linker_smiles_with_direction"]), "e3_binder_id", "linker_smiles_with_direction")


@query(
    " union all ".join(
        f"select model_name, 'flags' as metric, '{n}' as reduce, round({s}, 9) as value from predictions group by 1 union all select model_name, 'length', '{n}', round({s.replace('n_flags', 'len(default_pred_n0)')}, 9) from predictions group by 1"
        for n, s in {"mean": "avg(n_flags)", "max": "max(n_flags)::double", "min": "min(n_flags)::double", "std": "stddev_samp(n_flags)"}.items()
    )
)
def report_long(spark, folder):
    rows = table(spark, folder, "predictions", ["model_name", "n_flags", "default_pred_n0"])
    return summaries.long_report(rows, ["model_name"], {"flags": F.col("n_flags"), "length": F.length("default_pred_n0")}).withColumn("value", F.round("value", 9))


@query("select event_type, round(avg(value) filter (not isnan(value)), 6) as mean, count(*) as n from events group by 1")
def nanmean_metrics(spark, folder):
    rows = table(spark, folder, "events", ["event_type", "value"])
    return rows.groupBy("event_type").agg(F.round(F.avg(F.nanvl("value", F.lit(None).cast("double"))), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("select notes, count(*) as n from curated where notes is not null group by 1")
def value_counts_notes(spark, folder):
    return table(spark, folder, "curated", ["notes"]).dropna().groupBy("notes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "notes")


@query("select p_partkey, round((p_retailprice - lo) / nullif(hi - lo, 0), 9) as norm from part join (select p_brand, min(p_retailprice) as lo, max(p_retailprice) as hi from part group by 1) using (p_brand)")
def minmax_per_group(spark, folder):
    rows = summaries.min_max(table(spark, folder, "part", ["p_partkey", "p_brand", "p_retailprice"]), "p_brand", ["p_retailprice"])
    return rows.select("p_partkey", F.round("norm_p_retailprice", 9).alias("norm"))


@query("select p_brand, p_partkey, rank::int as rank from (select p_brand, p_partkey, row_number() over (partition by p_brand order by abs(p_size - m), p_partkey) as rank from part join (select p_brand, median(p_size) as m from part group by 1) using (p_brand))")
def median_distance_order(spark, folder):
    from pyspark.sql import Window

    rows = table(spark, folder, "part", ["p_partkey", "p_brand", "p_size"])
    middle = rows.groupBy("p_brand").agg(F.median("p_size").alias("m"))
    w = Window.partitionBy("p_brand").orderBy(F.abs(F.col("p_size") - F.col("m")), "p_partkey")
    return rows.join(middle, "p_brand").select("p_brand", "p_partkey", F.row_number().over(w).alias("rank"))


_STD3 = "sqrt((pow(q - (q + d + t) / 3, 2) + pow(d - (q + d + t) / 3, 2) + pow(t - (q + d + t) / 3, 2)) / 2)"


@query(f"select l_orderkey, arg_min(l_linenumber, row(round({_STD3}, 9), l_linenumber)) as sweet_spot from (select *, l_quantity / 50 as q, l_discount * 10 as d, l_tax * 12 as t from lineitem) group by 1")
def sweet_spot(spark, folder):
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    spread = summaries.row_std([F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12])
    return rows.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(F.round(spread, 9).alias("s"), F.col("l_linenumber").alias("n"))).alias("sweet_spot"))


@query("select count(*) as n, round(avg(k), 9) as mean, round(stddev_pop(k), 9) as std, min(k) as least, median(k) as median, max(k) as most, round(avg(pow(k - m, 3)) / pow(stddev_pop(k), 3), 9) as skew from (select count(*) as k, avg(count(*)) over () as m from curated where source is not null group by source)")
def cluster_size_stats(spark, folder):
    out = summaries.group_sizes(table(spark, folder, "curated", ["source"]).dropna(), "source")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "std", "skew")})


@query("select label as truth, case when s < -0.5 then 0 when s < 0.5 then 1 else label end as predicted, count(*) as n from (select label, round(list_sum(embedding), 6) as s from embeddings) group by 1, 2")
def confusion(spark, folder):
    return summaries.confusion(_classified(spark, folder), "truth", "predicted")


def _classified(spark, folder):
    s = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6)
    return table(spark, folder, "embeddings", ["embedding", "label"]).select(F.col("label").alias("truth"), F.when(s < -0.5, 0).when(s < 0.5, 1).otherwise(F.col("label")).alias("predicted"))


@query(
    """with c as (select label as truth, case when s < -0.5 then 0 when s < 0.5 then 1 else label end as predicted, count(*) as n from (select label, round(list_sum(embedding), 6) as s from embeddings) group by 1, 2),
k as (select class, sum(support)::bigint as support, sum(given) as given, sum(hit) as hit from (select truth as class, n as support, 0 as given, case when truth = predicted then n else 0 end as hit from c union all select predicted, 0, n, 0 from c) group by 1)
select class, support, round(hit / nullif(given, 0), 9) as precision, round(hit / nullif(support, 0), 9) as recall, round(2 * hit / nullif(given + support, 0), 9) as f1 from k"""
)
def confusion_prf(spark, folder):
    out = summaries.precision_recall(_classified(spark, folder), "truth", "predicted")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    """with f as (select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings), c as (select label, i, avg(x::double) as m from f group by 1, 2),
d as (select vec_id, label, round(sum((x - m) * (x - m)), 9) as d from f join c using (label, i) group by 1, 2) select label, arg_min(vec_id, row(d, vec_id)) as medoid, count(*) as size from d group by 1"""
)
def centroid_medoid(spark, folder):
    return summaries.medoids(table(spark, folder, "embeddings", ["vec_id", "embedding", "label"]), "vec_id", "embedding", "label")


# Dictionaries


@query("select p.pred_id, c.source, c.row_id from predictions p left join (select protac_id, arg_min(source, row_id) as source, min(row_id) as row_id from curated where source is not null group by 1) c using (protac_id)")
def lookup_first_match(spark, folder):
    known = table(spark, folder, "curated", ["protac_id", "source", "row_id"]).filter("source is not null")
    return dictionary.lookup_first(table(spark, folder, "predictions", ["pred_id", "protac_id"]), known, "protac_id", "row_id").select("pred_id", "source", "row_id")


@query("select row_id, protac_id from curated where protac_id is not null and not exists (select 1 from predictions p where p.protac_id = curated.protac_id)")
def anti_join_remaining(spark, folder):
    rows = table(spark, folder, "curated", ["row_id", "protac_id"]).filter("protac_id is not null")
    return rows.join(table(spark, folder, "predictions", ["protac_id"]), "protac_id", "left_anti").select("row_id", "protac_id")


@query("select smiles, sha256(smiles) as id, 'new' as origin from (select distinct e3_binder_smiles_with_direction as smiles from curated where trim(e3_binder_smiles_with_direction) <> '') where smiles not in (select smiles from representatives) union all select smiles, rep_id, 'known' from representatives")
def dictionary_upsert(spark, folder):
    known = table(spark, folder, "representatives", ["smiles", "rep_id"]).select("smiles", F.col("rep_id").alias("id"), F.lit("known").alias("origin"))
    return dictionary.upsert(known, table(spark, folder, "curated", ["e3_binder_smiles_with_direction"]).toDF("smiles"))


@query("select protac_id, arg_min(protac_smiles, row(p, i)) as protac_smiles from (select protac_id, protac_smiles, 0 as p, protac_id as i from controls union all select protac_id, protac_smiles, 1, lpad(row_id::varchar, 12, '0') from curated) where protac_id is not null group by 1")
def union_distinct_keep_first(spark, folder):
    a = table(spark, folder, "controls", ["protac_id", "protac_smiles"]).withColumn("i", F.col("protac_id"))
    b = table(spark, folder, "curated", ["protac_id", "protac_smiles", "row_id"]).withColumn("i", F.lpad(F.col("row_id").cast("string"), 12, "0")).drop("row_id")
    return dictionary.keep_first([a.filter("protac_id is not null"), b.filter("protac_id is not null")], "protac_id", "i").select("protac_id", "protac_smiles")


@query("select doc_id, linker from documents, (select distinct linker_smiles as linker from curated where linker_smiles <> '') where contains(text, linker)")
def containment_join(spark, folder):
    linkers = table(spark, folder, "curated", ["linker_smiles"]).dropna().distinct().select(F.col("linker_smiles").alias("linker"), F.col("linker_smiles").alias("s"))
    return dictionary.contained(table(spark, folder, "documents", ["doc_id", "text"]), "doc_id", "text", linkers, "linker", "s")


_REF_GRAMS = "(select distinct rep_id, is_warhead, substr(smiles, i::int, 3) as g from representatives, range(1, len(smiles) - 1) t(i))"
_NEAREST = f"""(with q as (select row_id, poi_ligand_smiles as s from curated), u as (select distinct s from q where len(s) >= 3),
ug as (select distinct s, substr(s, i::int, 3) as g from u, range(1, len(s) - 1) t(i)), un as (select s, count(*) as n from ug group by 1), rg as {_REF_GRAMS}, rn as (select rep_id, is_warhead, count(*) as m from rg group by 1, 2),
b as (select s, rep_id, count(*) as k from ug join rg using (g) group by 1, 2),
f as (select u.s, rn.is_warhead, rn.rep_id, coalesce(k, 0) / (n + m - coalesce(k, 0)) as t from u join un using (s) cross join rn left join b on b.s = u.s and b.rep_id = rn.rep_id),
best as (select s, is_warhead, max(t) as similarity from f group by 1, 2)
select row_id, c.is_warhead, round(coalesce(similarity, 0), 6) as similarity from q cross join (select distinct is_warhead from representatives) c left join best on best.s = q.s and best.is_warhead = c.is_warhead)"""


@query(f"select row_id, is_warhead::varchar as cls, similarity from {_NEAREST}")
def tanimoto_max_ref(spark, folder):
    return _nearest(spark, folder).select("row_id", "cls", F.round("similarity", 6).alias("similarity"))


def _nearest(spark, folder):
    refs = table(spark, folder, "representatives", ["rep_id", "is_warhead", "smiles"])
    out = dictionary.nearest_reference(table(spark, folder, "curated", ["row_id", "poi_ligand_smiles"]), "row_id", "poi_ligand_smiles", refs, "rep_id", "is_warhead", "smiles")
    return out.withColumnRenamed("key", "row_id")


@query(f"select row_id, case when e >= w then 'e3' else 'poi' end as role, w > e and w >= 0.2 as swap_suspected from (select row_id, max(similarity) filter (not is_warhead) as e, max(similarity) filter (is_warhead) as w from {_NEAREST} group by 1)")
def assign_roles(spark, folder):
    s = lambda c: F.max(F.when(F.col("cls") == c, F.round("similarity", 6)))
    both = _nearest(spark, folder).groupBy("row_id").agg(s("false").alias("e"), s("true").alias("w"))
    return both.select("row_id", F.when(F.col("e") >= F.col("w"), "e3").otherwise("poi").alias("role"), ((F.col("w") > F.col("e")) & (F.col("w") >= 0.2)).alias("swap_suspected"))


@query(
    """with recursive p as (select distinct e3_binder_id as a, poi_ligand_id as b from curated where e3_binder_id is not null and poi_ligand_id is not null), e as (select a, b from p union select b, a from p),
seeds as (select distinct e3_binder_id as item from curated where notes like '(method=manual)%' and source = 'vendor_list' and e3_binder_id in (select a from e)),
r(item, step) using key (item) as (select item, 0 from seeds union select distinct e.b, step + 1 from r join e on e.a = r.item where e.b not in (select item from recurring.r))
select item, step from r"""
)
def iterative_fixpoint(spark, folder):
    rows = table(spark, folder, "curated", ["notes", "source", "e3_binder_id", "poi_ligand_id"])
    seeds = rows.filter(F.col("notes").startswith("(method=manual)") & (F.col("source") == "vendor_list")).select("e3_binder_id").dropna()
    return dictionary.grow(rows.select(F.col("e3_binder_id").alias("a"), F.col("poi_ligand_id").alias("b")), seeds)


@query("select protac_id from (select protac_id from curated where protac_id is not null intersect select protac_id from predictions) except select protac_id from controls")
def set_intersect_except(spark, folder):
    ids = lambda t: table(spark, folder, t, ["protac_id"])
    return ids("curated").dropna().intersect(ids("predictions")).exceptAll(ids("controls"))


@query("select count(*) as rows, count(distinct protac_id) filter (covered) as covered, count(distinct protac_id) filter (covered) / count(distinct protac_id) as share from (select protac_id, protac_id in (select protac_id from predictions where default_pred_n0 is not null) as covered from curated where protac_id is not null)")
def coverage(spark, folder):
    done = table(spark, folder, "predictions", ["protac_id", "default_pred_n0"]).dropna().select("protac_id").distinct().withColumn("yes", F.lit(True))
    rows = table(spark, folder, "curated", ["protac_id"]).dropna().groupBy("protac_id").agg(F.count(F.lit(1)).alias("k")).join(done, "protac_id", "left")
    n = F.count("yes")
    return rows.agg(F.sum("k").alias("rows"), n.alias("covered"), (n / F.count(F.lit(1))).alias("share"))


_BOTH = "select row_id, max(similarity) filter (not is_warhead) as e, max(similarity) filter (is_warhead) as w from {n} group by 1"


@query(f"select a.row_id, a.w > a.e and a.w >= 0.2 and b.e > b.w and b.e >= 0.2 as swapped from ({_BOTH.format(n=_NEAREST.replace('poi_ligand_smiles', 'e3_binder_smiles'))}) a join ({_BOTH.format(n=_NEAREST)}) b using (row_id)")
def role_swap_flag(spark, folder):
    refs = table(spark, folder, "representatives", ["rep_id", "is_warhead", "smiles"])
    rows = table(spark, folder, "curated", ["row_id", "e3_binder_smiles", "poi_ligand_smiles"])
    s = lambda c: F.max(F.when(F.col("cls") == c, F.round("similarity", 6)))
    near = lambda c, p: dictionary.nearest_reference(rows, "row_id", c, refs, "rep_id", "is_warhead", "smiles").groupBy(F.col("key").alias("row_id")).agg(s("false").alias(f"{p}e"), s("true").alias(f"{p}w"))
    both = near("e3_binder_smiles", "a").join(near("poi_ligand_smiles", "b"), "row_id")
    return both.select("row_id", ((F.col("aw") > F.col("ae")) & (F.col("aw") >= 0.2) & (F.col("be") > F.col("bw")) & (F.col("be") >= 0.2)).alias("swapped"))


@query(
    f"""with g as {_REF_GRAMS}, n as (select rep_id, is_warhead, count(*) as n from g group by 1, 2),
s as (select a.rep_id as e, b.rep_id as w, count(*) / (na.n + nb.n - count(*)) as t from g a join g b using (g) join n na on na.rep_id = a.rep_id join n nb on nb.rep_id = b.rep_id where not a.is_warhead and b.is_warhead group by 1, 2, na.n, nb.n),
one as (select rep_id from representatives where not is_warhead and rep_id not in (select e from s where t > 0.3)),
two as (select rep_id from representatives where is_warhead and rep_id not in (select w from s where t > 0.3 and e in (select rep_id from one)))
select rep_id, false as is_warhead from one union all select rep_id, true from two"""
)
def cross_dissimilarity(spark, folder):
    return dictionary.cross_dissimilar(table(spark, folder, "representatives", ["rep_id", "smiles", "is_warhead"]), "rep_id", "smiles", "is_warhead", 0.3)


@query("with c as (select doc_id, linker, len(linker) as n from documents, (select distinct linker_smiles as linker from curated where linker_smiles <> '') where contains(text, linker)), m as (select doc_id, median(n) as mid, count(*) as tried from c group by 1) select doc_id, arg_min(linker, row(abs(n - mid), n, linker)) as first, any_value(tried) as tried from c join m using (doc_id) group by 1")
def candidate_first_pass(spark, folder):
    return dictionary.first_passing(containment_join(spark, folder).withColumn("n", F.length("linker")), "doc_id", "n", "linker")


_LETTERS = "list_distinct(regexp_extract_all({}, '(?s).'))"


@query(f"select row_id, least(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), len(list_intersect(x, z)) / len(list_distinct(list_concat(x, z)))) as least from (select row_id, {', '.join(_LETTERS.format(c) + ' as ' + n for c, n in (('e3_binder_smiles', 'x'), ('poi_ligand_smiles', 'y'), ('linker_smiles', 'z')))} from curated where e3_binder_smiles <> '' and poi_ligand_smiles <> '' and linker_smiles <> '')")
def least_similarity(spark, folder):
    rows = table(spark, folder, "curated", ["row_id", "e3_binder_smiles", "poi_ligand_smiles", "linker_smiles"]).filter("e3_binder_smiles <> '' and poi_ligand_smiles <> '' and linker_smiles <> ''")
    letters = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(.)"), 1))
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    e, p, k = letters("e3_binder_smiles"), letters("poi_ligand_smiles"), letters("linker_smiles")
    return rows.select("row_id", F.least(share(e, p), share(e, k)).alias("least"))


# Reports and shapes


@query("select source, " + ", ".join(f"count(distinct labels) filter (split_name = '{x}') as {x}" for x in ("train", "validation", "test", "held_out")) + " from finetuning where split_name in ('train', 'validation', 'test', 'held_out') group by 1")
def pivot_splits(spark, folder):
    return summaries.pivot_counts(table(spark, folder, "finetuning", ["source", "split_name", "labels"]), "source", "split_name", ["train", "validation", "test", "held_out"], "labels")


@query("select user_id, count(value) filter (not isnan(value)) as tokens, round(exp(avg(value / 1000) filter (not isnan(value))), 6) as perplexity from events group by 1")
def perplexity(spark, folder):
    rows = table(spark, folder, "events", ["user_id", "value"])
    out = summaries.perplexity(rows, "user_id", F.nanvl("value", F.lit(None).cast("double")) / 1000)
    return out.withColumn("perplexity", F.round("perplexity", 6))


@query("select event_id, case when isfinite(1 / (event_id % 3)) then 1 / (event_id % 3) end as ratio from events where event_id % 3 > 0 union all select event_id, null from events where event_id % 3 = 0")
def json_safe(spark, folder):
    x = F.col("event_id") % 3
    ratio = F.when(x == 0, F.lit(float("inf"))).otherwise(1 / F.when(x == 0, F.lit(1)).otherwise(x))
    return table(spark, folder, "events", ["event_id"]).select("event_id", summaries.finite(ratio).alias("ratio"))


@query("select distinct event_type, array_to_string(list_transform(string_split(event_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') as shown from events")
def display_names(spark, folder):
    return table(spark, folder, "events", ["event_type"]).distinct().select("event_type", summaries.display_name(F.col("event_type")).alias("shown"))


@query("select row_id, '(source=' || coalesce(source, 'None') || ')(linker=' || coalesce(linker_smiles is not null, false) || ')' as note from curated")
def note_builder(spark, folder):
    return table(spark, folder, "curated", ["row_id", "source", "linker_smiles"]).select("row_id", summaries.note(source=F.col("source"), linker=F.col("linker_smiles").isNotNull()).alias("note"))


@query("select e3_binder_id, e3_binder_smiles, e3_binder_smiles_with_direction from curated")
def prefix_columns(spark, folder):
    return summaries.prefixed(table(spark, folder, "curated"), "e3_")


@query("select * from (" + " union all ".join(f"select model_name, 'flags' as metric, '{n}' as reduce, round({e}, 9) as value from predictions group by 1" for n, e in {"mean": "avg(n_flags)", "max": "max(n_flags)::double"}.items()) + ")")
def metric_filter(spark, folder):
    rows = report_long(spark, folder)
    return rows.filter(F.col("metric").rlike("^fl") & F.col("reduce").isin("mean", "max"))


@query("with m as (select e3_binder_id as k, list_sort(list(distinct linker_smiles)) as v from curated where e3_binder_id is not null and linker_smiles is not null group by 1) select distinct poi_ligand_id as k, coalesce(v, []) as linkers from curated left join m on m.k = poi_ligand_id where poi_ligand_id is not null")
def map_with_default(spark, folder):
    rows = table(spark, folder, "curated", ["e3_binder_id", "poi_ligand_id", "linker_smiles"])
    held = summaries.multimap(rows, "e3_binder_id", "linker_smiles").withColumnRenamed("e3_binder_id", "k")
    asked = rows.select(F.col("poi_ligand_id").alias("k")).dropna().distinct()
    return asked.join(held, "k", "left").select("k", F.coalesce("members", F.array().cast("array<string>")).alias("linkers"))


# Graphs, molecules, sampling, streams

_EDGES = "(select distinct 0 as g, least(e3_binder_id, poi_ligand_id) as u, greatest(e3_binder_id, poi_ligand_id) as v from curated where e3_binder_id <> poi_ligand_id)"


def _ligand_edges(spark, folder):
    rows = table(spark, folder, "curated", ["e3_binder_id", "poi_ligand_id"]).dropna()
    return rows.select(F.lit(0).alias("g"), F.col("e3_binder_id").alias("u"), F.col("poi_ligand_id").alias("v")).distinct()


@query(f"select u, count(*) as degree from (select u, v from {_EDGES} union select v, u from {_EDGES}) group by 1")
def edge_degree(spark, folder):
    return graph.degrees(_ligand_edges(spark, folder), "g").select("u", "degree")


@query(f"with e as (select u, v from {_EDGES} union select v, u from {_EDGES}) select u, count(*) as n2 from (select distinct a.u, b.v from e a join e b on a.v = b.u where a.u <> b.v and not exists (select 1 from e c where c.u = a.u and c.v = b.v)) group by 1")
def edge_two_hops(spark, folder):
    return graph.exactly_two_away(_ligand_edges(spark, folder), "g").select("u", "n2")


_ORDER_EDGES = "(select distinct l_orderkey as g, l_suppkey as u, l_partkey % 7 + 1000000 as v from lineitem)"
_WALK = f"e as (select g, u, v from {_ORDER_EDGES} union select g, v, u from {_ORDER_EDGES}), one as (select g, u, v from e), two as (select distinct a.g, a.u, b.v from one a join e b on a.g = b.g and a.v = b.u where a.u <> b.v and (a.g, a.u, b.v) not in (select g, u, v from one)), three as (select distinct a.g, a.u, b.v from two a join e b on a.g = b.g and a.v = b.u where a.u <> b.v and (a.g, a.u, b.v) not in (select g, u, v from one union all select g, u, v from two))"


@query(f"with {_WALK} " + " union all ".join(f"select g, u, {k} as hop, count(*) as n from {t} group by 1, 2" for k, t in ((1, "one"), (2, "two"), (3, "three"))))
def edge_degree_khop(spark, folder):
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_suppkey", "l_partkey"])
    return graph.khop(rows.select(F.col("l_orderkey").alias("g"), F.col("l_suppkey").alias("u"), (F.col("l_partkey") % 7 + 1000000).alias("v")), "g", 3)


@query("with t as (select l_orderkey, sum(l_quantity) as s from lineitem group by 1), p as (select l_orderkey, a.l_linenumber as a, b.l_linenumber as b, round(sqrt((pow(a.l_quantity - s / 3, 2) + pow(b.l_quantity - s / 3, 2) + pow(s - a.l_quantity - b.l_quantity - s / 3, 2)) / 3), 6) as spread from lineitem a join lineitem b using (l_orderkey) join t using (l_orderkey) where a.l_linenumber < b.l_linenumber) select l_orderkey, m.a, m.b, m.spread from (select l_orderkey, min(struct_pack(spread := spread, a := a, b := b)) as m from p group by 1)")
def pair_enumeration(spark, folder):
    return graph.pairs_by_balance(table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"]), "l_orderkey", "l_linenumber", "l_quantity")


@query("select distinct l_orderkey, a.l_linenumber as a, b.l_linenumber as b from lineitem a join lineitem b using (l_orderkey) where a.l_linenumber < b.l_linenumber and (a.l_suppkey in (b.l_suppkey, b.l_partkey + 1000000) or a.l_partkey + 1000000 in (b.l_partkey + 1000000, b.l_suppkey))")
def line_graph(spark, folder):
    rows = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])
    edges = rows.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1000000).alias("v"))
    return graph.line_graph(edges, "l_orderkey", "l_linenumber")


def _e3_refs(spark, folder):
    rows = table(spark, folder, "representatives", ["rep_id", "smiles", "is_warhead"]).filter("not is_warhead")
    return [r.smiles for r in _few(rows.orderBy("rep_id"))]


def _few(rows: DataFrame, most: int = 10_000) -> list:
    """All rows of a fixed small table; more are refused."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} references")
    return held


_LABELLED = ["e3_binder_smiles_with_direction", "linker_smiles_with_direction", "poi_ligand_smiles_with_direction"]


def _whole_molecules(spark, folder):
    """(protac_id, protac_smiles) of curated and controls, each protac_id once; it is a hash of the string."""
    both = table(spark, folder, "curated", ["protac_id", "protac_smiles"]).union(table(spark, folder, "controls", ["protac_id", "protac_smiles"]))
    return both.dropna().groupBy("protac_id").agg(F.min("protac_smiles").alias("protac_smiles"))


def _once(rows: DataFrame, keys: list[str], inputs: list[str], make) -> DataFrame:
    """make(rows, key), computed once for each distinct combination of the inputs and joined back to every key."""
    keyed = rows.select(*keys, *inputs, F.sha2(F.to_json(F.struct(*inputs)), 256).alias("_input"))
    done = make(keyed.groupBy("_input").agg(*[F.first(c).alias(c) for c in inputs]), "_input")
    return keyed.select(*keys, "_input").join(done, "_input").drop("_input")


@query()
def heuristic_split(spark, folder):
    return molecules.heuristic_split(_whole_molecules(spark, folder), "protac_id", "protac_smiles", _e3_refs(spark, folder))


@query()
def reassembly(spark, folder):
    return molecules.reassembly(table(spark, folder, "finetuning", ["sample_id", "labels", "text"]), "sample_id", "labels", "text")


@query()
def edge_features(spark, folder):
    return molecules.edge_features(_whole_molecules(spark, folder), "protac_id", "protac_smiles")


@query()
def approx_ged(spark, folder):
    return molecules.edit_distance(table(spark, folder, "curated", ["row_id", "e3_binder_smiles", "poi_ligand_smiles"]), "row_id", "e3_binder_smiles", "poi_ligand_smiles")


@query()
def molecule_descriptors(spark, folder):
    return molecules.descriptors(table(spark, folder, "curated", ["row_id", "linker_smiles_with_direction"]), "row_id", "linker_smiles_with_direction")


@query("with s as (select source as v, sum(count(*)) over (order by source) / sum(count(*)) over () as upto from curated where source is not null group by source) select sample_id, coalesce((select min(v) from s where upto = (select min(upto) from s where upto > ((sample_id % 2147483647 * 1327217885 + 42) % 2147483647) / 2147483647.0)), (select max(v) from s)) as source from finetuning")
def weighted_sample(spark, folder):
    shares = summaries.distribution(table(spark, folder, "curated", ["source"]), "source")
    return sampling.weighted(table(spark, folder, "finetuning", ["sample_id"]), "sample_id", shares, "source", "share")


@query("select e3, poi, len(list_intersect(a, b)) as n from (select e3_binder_id as e3, list(distinct linker_smiles) as a from curated where e3_binder_id is not null and linker_smiles is not null group by 1) join (select distinct e3_binder_id as e3, poi_ligand_id as poi from curated where poi_ligand_id is not null) using (e3) join (select poi_ligand_id as poi, list(distinct linker_smiles) as b from curated where poi_ligand_id is not null and linker_smiles is not null group by 1) using (poi)")
def compatible_pairs(spark, folder):
    rows = table(spark, folder, "curated", ["e3_binder_id", "poi_ligand_id", "linker_smiles"])
    known = rows.select(F.col("e3_binder_id").alias("e3"), F.col("poi_ligand_id").alias("poi")).dropna().distinct()
    e = rows.select(F.col("e3_binder_id").alias("e3"), "linker_smiles").dropna().distinct()
    p = rows.select(F.col("poi_ligand_id").alias("poi"), "linker_smiles").dropna().distinct()
    both = known.join(e, "e3").join(p, ["poi", "linker_smiles"]).groupBy("e3", "poi").agg(F.count(F.lit(1)).alias("n"))
    return known.join(e.select("e3").distinct(), "e3", "left_semi").join(p.select("poi").distinct(), "poi", "left_semi").join(both, ["e3", "poi"], "left").select("e3", "poi", F.coalesce("n", F.lit(0)).alias("n"))


@query("select sample_id, unnest(range(case when (sample_id % 2147483647 * 1327217885 + 7) % 2147483647 % 100 < 30 then 4 else 1 end))::int as copy from finetuning")
def augment_repeat(spark, folder):
    return sampling.repeat_some(table(spark, folder, "finetuning", ["sample_id"]), "sample_id", 4, 30)


@query("select o_orderkey from orders order by o_orderkey limit (select floor(0.3 * count(*))::int from orders)")
def ratio_limit(spark, folder):
    return sampling.first_share(table(spark, folder, "orders", ["o_orderkey"]), "o_orderkey", 0.3)


_TOK = r"\[[^\]]*\]|Cl|Br|%[0-9]{2}|[A-Za-z0-9*=#:/\\().+@-]"


@query(f"select sample_id, len(t)::int as n, list_resize(t, (select max(len(regexp_extract_all(text, '{_TOK}'))) from finetuning), '<pad>') as tokens from (select sample_id, regexp_extract_all(text, '{_TOK}') as t from finetuning where text is not null)")
def tokenise(spark, folder):
    """All tokens of each text, padded to the longest of the table."""
    rows = table(spark, folder, "finetuning", ["sample_id", "text"]).dropna()
    rows = rows.select("sample_id", F.regexp_extract_all("text", F.lit(f"({_TOK})"), 1).alias("t")).select("sample_id", "t", F.size("t").alias("n"))
    longest = rows.agg(F.max("n")).first()[0] or 0
    return rows.select("sample_id", "n", F.concat("t", F.array_repeat(F.lit("<pad>"), F.lit(longest) - F.col("n"))).alias("tokens"))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(avg(value) filter (not isnan(value)), 6) as mean from events group by 1, 2")
def windowed_metrics(spark, folder):
    out = metrics.windowed_metrics(table(spark, folder, "events", ["ts", "event_type", "value"]), "ts", ["event_type"], "value")
    return out.withColumns({"mean": F.round("mean", 6), "start": F.col("start").cast("timestamp_ntz")})


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k"""
)
def sessions(spark, folder):
    out = metrics.sessions(table(spark, folder, "events", ["ts", "user_id"]), "ts", "user_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query()
def score_splits(spark, folder):
    cols = ["protac_id", "protac_smiles", *_LABELLED]
    rows = table(spark, folder, "curated", ["row_id", *cols]).unionByName(table(spark, folder, "controls", cols), allowMissingColumns=True)
    rows = rows.withColumn("label", fr.join_roles(*[F.col(c) for c in _LABELLED]))
    refs = _few(table(spark, folder, "representatives", ["rep_id", "smiles", "is_warhead"]).orderBy("rep_id"))
    make = lambda rows, key: scoring.score_splits(rows, key, "label", "protac_smiles", [r.smiles for r in refs if not r.is_warhead], [r.smiles for r in refs if r.is_warhead])
    return _once(rows, ["protac_id", "row_id"], ["label", "protac_smiles"], make)


def _known_splits(spark, folder):
    """(protac_id, protac_smiles, label) of controls and curated. Of a protac_id with several records in curated the one
    with the smallest row_id counts, if possible of those with all three parts."""
    cols = ["protac_id", "protac_smiles", *_LABELLED]
    label = fr.join_roles(*[F.col(c) for c in _LABELLED]).alias("label")
    controls = table(spark, folder, "controls", cols).select("protac_id", "protac_smiles", label, F.lit(0).alias("place"), F.lit(0).cast("long").alias("row_id"))
    curated = table(spark, folder, "curated", ["row_id", *cols]).select("protac_id", "protac_smiles", label, F.lit(1).alias("place"), "row_id")
    known = controls.union(curated).dropna(subset=["protac_id"])
    return known.groupBy("protac_id").agg(F.min_by(F.struct("protac_smiles", "label"), F.struct("place", F.col("label").isNull(), "row_id")).alias("k")).select("protac_id", "k.*")


def _labelled_predictions(spark, folder):
    """Every prediction beside its molecule and the known split."""
    return table(spark, folder, "predictions", ["pred_id", "protac_id", "default_pred_n0"]).join(_known_splits(spark, folder), "protac_id", "left")


@query()
def score_predictions(spark, folder):
    make = lambda rows, key: scoring.score_predictions(rows, key, "protac_smiles", "label", "default_pred_n0")
    return _once(_labelled_predictions(spark, folder), ["pred_id"], ["protac_smiles", "label", "default_pred_n0"], make)


@query()
def fix_predictions(spark, folder):
    make = lambda rows, key: scoring.repair(rows, key, "default_pred_n0", "protac_smiles")
    return _once(_labelled_predictions(spark, folder), ["pred_id"], ["default_pred_n0", "protac_smiles"], make)


@query()
def attachment_group_distribution(spark, folder):
    rows = scoring.attachment_groups(table(spark, folder, "curated", ["row_id", "e3_binder_smiles_with_direction"]), "row_id", "e3_binder_smiles_with_direction", 2)
    return summaries.distribution(rows, "grp")


@query()
def generated_molecules(spark, folder):
    """As many draws as there are curated records."""
    rows = table(spark, folder, "curated", _LABELLED)
    return generate.generate(rows, *_LABELLED, rows.count())


@query()
def generated_by_groups(spark, folder):
    rows = table(spark, folder, "curated", _LABELLED)
    return generate.by_groups(rows, *_LABELLED, rows.count())


@query()
def covering_molecules(spark, folder):
    return generate.cover(table(spark, folder, "curated", _LABELLED), *_LABELLED)


@query()
def ligand_representatives(spark, folder):
    rows = table(spark, folder, "curated", ["row_id", "e3_binder_smiles_with_direction"])
    return learning.representatives(rows, "row_id", "e3_binder_smiles_with_direction", [10, 25, 50])


@query()
def chemical_plane(spark, folder):
    return learning.plane(table(spark, folder, "embeddings", ["vec_id", "embedding"]), "vec_id", "embedding")


def _half(rows, key, which):
    return rows.filter(F.pmod(F.xxhash64(F.lit(5), key), F.lit(2)) == which)


def _labelled(spark, folder):
    """(protac_id, protac_smiles, cuts) of the molecules with a known split."""
    return learning.with_cuts(_known_splits(spark, folder).dropna(), "protac_id", "protac_smiles", "label")


def _fit(spark, known):
    scratch = Scratch(spark)
    bonds = scratch.keep(learning.labelled_bonds(known, "protac_smiles"))
    model = learning.fit_edges(bonds)
    scratch.drop(bonds)
    return model


def _model(spark, folder):
    """A classifier fitted on all labelled molecules; where none are held out to judge it, a half would be a sample."""
    return _fit(spark, _labelled(spark, folder))


@query()
def edge_classifier(spark, folder):
    """The two likeliest bonds of every labelled molecule; ``held_out`` are those of the half it was not fitted on."""
    known = Scratch(spark).keep(_labelled(spark, folder))
    top = learning.judged(_fit(spark, _half(known, "protac_smiles", 0)), known, "protac_id", "protac_smiles")
    top = top.select("protac_id", F.posexplode("top").alias("at", "b")).select("protac_id", F.col("b.bond").alias("bond"), (F.col("at") + 1).alias("rank"))
    cuts = known.select("protac_id", F.inline("cuts"))
    held_out = _half(known, "protac_smiles", 1).select("protac_id", F.lit(True).alias("held_out"))
    out = top.join(cuts, ["protac_id", "bond"], "left").join(held_out, "protac_id", "left")
    return out.select("protac_id", "bond", "rank", F.coalesce("side", F.lit(0)).alias("side"), F.coalesce("held_out", F.lit(False)).alias("held_out"))


def _split(spark, folder, strategy, **kw):
    refs = splitting.References.of_table(table(spark, folder, "representatives", ["smiles", "is_warhead"]))
    return splitting.split(_whole_molecules(spark, folder), "protac_smiles", strategy, refs, **kw).drop("protac_smiles")


def _beams(spark, folder):
    """What a sequence model said about each molecule: its stored predictions, in the order of their ids."""
    rows = table(spark, folder, "predictions", ["pred_id", "smiles", "default_pred_n0", "model_name"]).filter("model_name = 'Transformer'").dropna()
    return rows.groupBy(F.col("smiles").alias("protac_smiles"), "default_pred_n0").agg(F.min("pred_id").alias("i")).groupBy("protac_smiles").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "default_pred_n0"))), lambda x: x["default_pred_n0"]).alias("beams"))


@query()
def split_grid(spark, folder):
    return _split(spark, folder, "grid")


@query()
def split_classifier(spark, folder):
    return _split(spark, folder, "classifier->heuristic", model=_model(spark, folder))


@query()
def split_longest(spark, folder):
    return _split(spark, folder, "classifier+heuristic", model=_model(spark, folder))


@query()
def split_transformer(spark, folder):
    return _split(spark, folder, "transformer->classifier", model=_model(spark, folder), beams=_beams(spark, folder))


@query()
def split_adaptive(spark, folder):
    return _split(spark, folder, "adaptive", model=_model(spark, folder), beams=_beams(spark, folder))


def _dictionary(spark, folder):
    """Known parts to begin with: those of the records curated by hand."""
    return _parts_of(table(spark, folder, "curated", ["notes", *_LABELLED]).filter(F.col("notes").startswith("(method=manual)")))


def _parts_of(rows):
    return rows.select(F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("ligand")) for r, c in zip(("e3", "linker", "poi"), _LABELLED, strict=True)])))


def _curated_parts(spark, folder):
    """The parts of every curated record, as a dictionary."""
    return _parts_of(table(spark, folder, "curated", _LABELLED))


@query()
def dictionary_split(spark, folder):
    """All molecules split by the parts of all curated records."""
    return curation.split_known(_whole_molecules(spark, folder), "protac_id", "protac_smiles", _curated_parts(spark, folder))


@query()
def dictionary_growth(spark, folder):
    """All molecules split from few known parts, growing the dictionary to its fixpoint."""
    return curation.curate(_whole_molecules(spark, folder), "protac_id", "protac_smiles", _dictionary(spark, folder))[0]


@query()
def substructure_join(spark, folder):
    """Which parts of the control molecules occur in each molecule, attachment points standing for any atom."""
    parts = table(spark, folder, "controls", ["protac_id", *_LABELLED])
    named = parts.select(F.inline(F.array(*[F.struct(F.concat_ws(":", F.lit(r), "protac_id").alias("part_id"), F.col(c).alias("part")) for r, c in zip(("e3", "linker", "poi"), _LABELLED, strict=True)])))
    return curation.containing(_whole_molecules(spark, folder), "protac_id", "protac_smiles", named, "part_id", "part")


@query()
def qc_rows(spark, folder):
    """All checks of the known split of every molecule."""
    refs = _few(table(spark, folder, "representatives", ["rep_id", "smiles", "is_warhead"]).orderBy("rep_id"))
    rows = Scratch(spark).keep(_known_splits(spark, folder))
    return qc.check(rows, "protac_id", "protac_smiles", "label", [r.smiles for r in refs if not r.is_warhead], [r.smiles for r in refs if r.is_warhead], _model(spark, folder))


@query()
def split_metrics(spark, folder):
    rows = _known_splits(spark, folder)
    return molecules.metrics(rows, "protac_id", "protac_smiles", "label")


@query()
def structure_scans(spark, folder):
    return molecules.scans(_whole_molecules(spark, folder), "protac_id", "protac_smiles")


@query()
def canonical_strings(spark, folder):
    return molecules.canonical(_whole_molecules(spark, folder), "protac_id", "protac_smiles")


@query()
def rewritten_pairs(spark, folder):
    return molecules.rewritten(table(spark, folder, "finetuning", ["sample_id", "text", "labels"]), "sample_id", ["text", "labels"], 4, 30)


@query()
def cluster_sweep(spark, folder):
    return learning.cluster_sweep(table(spark, folder, "embeddings", ["embedding"]), "embedding", [5, 10, 20])
