"""SQL that must give the same rows as the queries, where SQL can say it on whole tables."""

_FOLD = r"regexp_replace(lower(coalesce({}, '')), '[^a-z0-9()\[\]=#@+\-/\\%*:.]', '', 'g')"
_KEY = "list_sort([" + ", ".join(_FOLD.format(c) for c in ("protac_smiles", "e3_binder_smiles", "poi_ligand_smiles")) + "])"
_SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"


def _words(text: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(lower({text}), '{_SPACE}'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> '')"


def _runs(ident: str, text: str, table: str) -> str:
    return f"select distinct {ident}, array_to_string(w[i:i + 11], ' ') as run from (select {ident}, w, unnest(range(1, len(w) - 10)) as i from (select {ident}, {_words(text)} as w from {table} where {text} is not null) where len(w) >= 12)"


ORACLES = {
    "p2_found": f"with k as (select row_id, {_KEY} as k from curated), m as (select k, min(row_id) as row_a from k group by 1) select row_a, row_id as row_b from k join m using (k) where row_id <> row_a",
    "p2_records": f"select min(row_id) as representative, count(*) as n_copies from (select row_id, {_KEY} as k from curated) group by k",
    "p4_found": f"""with r as (select sample_id, split_name = 'train' as train, 0 as f, {_FOLD.format('text')} as v from finetuning union all select sample_id, split_name = 'train', 1, {_FOLD.format('labels')} from finetuning),
p as (select sample_id, train, f, unnest(string_split(v, '.')) as p from r),
g as (select distinct sample_id, train, f, substr(p, i::int, 4) as g from (select *, unnest(range(1, len(p) - 2)) as i from p where len(p) >= 4)),
n as (select sample_id, f, count(*) as n from g group by 1, 2),
b as (select x.sample_id as a, y.sample_id as b, x.f as f, count(*) as k from g x join g y on x.f = y.f and x.g = y.g where x.train and not coalesce(y.train, false) group by 1, 2, 3)
select distinct least(a, b) as sample_a, greatest(a, b) as sample_b from b join n na on na.sample_id = a and na.f = b.f join n nb on nb.sample_id = b and nb.f = b.f where k >= 0.9 * (na.n + nb.n - k)""",
    "p4_classes": f"""with r as (select sample_id, split_name = 'train' as train, 'text' as f, {_FOLD.format('text')} as v from finetuning union all select sample_id, split_name = 'train', 'labels', {_FOLD.format('labels')} from finetuning),
c as (select f, v, min(sample_id) as class_id, bool_or(train) as train, bool_or(not coalesce(train, false)) as other from r where len(v) >= 4 group by 1, 2), p as (select f, class_id, train, other, unnest(string_split(v, '.')) as p from c),
g as (select distinct f, class_id, train, other, substr(p, i::int, 4) as g from (select *, unnest(range(1, len(p) - 2)) as i from p where len(p) >= 4)), n as (select f, class_id, count(*) as n from g group by 1, 2),
b as (select x.f as f, x.class_id as a, y.class_id as b, count(*) as k from g x join g y on x.f = y.f and x.g = y.g where x.train and y.other and x.class_id <> y.class_id group by 1, 2, 3),
l as (select b.f as f, a, b from b join n na on na.f = b.f and na.class_id = a join n nb on nb.f = b.f and nb.class_id = b where k >= 0.9 * (na.n + nb.n - k)),
d as (select f, a, count(distinct b) as links from (select f, a, b from l union select f, b, a from l) group by 1, 2)
select sample_id, r.f as field, c.class_id, coalesce(links, 0) as links from r join c on c.f = r.f and c.v = r.v left join d on d.f = r.f and d.a = c.class_id""",
    "p5_found": f"""with recursive part as (select sample_id as rec, unnest(string_split({_FOLD.format('labels')}, '.')) as p from finetuning),
ent as (select row_id as rec, 'e' || {_FOLD.format('e3_binder_smiles_with_direction')} as k from curated union select row_id, 'p' || {_FOLD.format('poi_ligand_smiles_with_direction')} from curated
union select rec, case when contains(p, '[*:2]') then 'e' else 'p' end || p from part where contains(p, '[*:2]') <> contains(p, '[*:1]')),
known as (select rec, k from ent where len(k) > 1), least as (select k, min(rec) as m from known group by 1), adj as (select distinct a.k, b.k as other from known a join known b using (rec)),
reach(k, other) as (select k, k from least union select r.k, a.other from reach r join adj a on a.k = r.other),
label as (select reach.k, min(m) as group_id from reach join least l on l.k = reach.other group by 1), member as (select distinct rec, group_id from known join label using (k))
select rec as rec_id, group_id from member where group_id in (select group_id from member group by 1 having count(*) > 1)""",
    "p6_found": f"select distinct doc_id, item_id from ({_runs('doc_id', 'text', 'documents')}) join ({_runs('item_id', 'item_text', 'heldout_items')}) using (run)",
    "p7_found": "with s as (select t.source, t.target_share, t.max_repeats, coalesce(sum(length(text)), 0) as size from mix_targets t left join documents d using (source) group by all) select source from s where size * max_repeats < target_share * (select sum(size) from s)",
}
