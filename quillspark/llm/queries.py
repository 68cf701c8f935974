"""Queries of the problems pN_, and the SQL that some of them can be held against."""

from __future__ import annotations

from ..session import table
from . import leakage, lookalike, mixture, names, near_dup, qa_pairs, repetition, scans, split, toxicity


def queries():
    t = table
    return {
        "p1_found": lambda s, d: split.found(t(s, d, "sample_chunks"), t(s, d, "table_records")),
        "p1_pieces": lambda s, d: split.split_oversized(split.oversized(t(s, d, "sample_chunks"), t(s, d, "table_records"))),
        "p2_found": lambda s, d: near_dup.found(t(s, d, "sample_chunks")),
        "p2_groups": lambda s, d: near_dup.NearDuplicates(t(s, d, "sample_chunks")).groups(),
        "p3_found": lambda s, d: repetition.found(t(s, d, "sample_chunks")),
        "p3_ledger": lambda s, d: repetition.repetition_ledger(t(s, d, "sample_chunks")),
        "p3_ablations": lambda s, d: repetition.ablations(repetition.repetition_ledger(t(s, d, "sample_chunks"))),
        "p4_found": lambda s, d: scans.found(t(s, d, "image_records")),
        "p4_repaired": lambda s, d: scans.repaired(t(s, d, "image_records")),
        "p5_found": lambda s, d: lookalike.found(t(s, d, "sample_chunks")),
        "p5_unified": lambda s, d: lookalike.unified(lookalike.fields(t(s, d, "sample_chunks"))),
        "p6_found": lambda s, d: names.found(t(s, d, "sample_chunks"), t(s, d, "questions")),
        "p6_links": lambda s, d: names.link(names.observed_names(t(s, d, "sample_chunks"), t(s, d, "questions"))),
        "p7_found": lambda s, d: qa_pairs.found(t(s, d, "results_openai")),
        "p8_found": lambda s, d: leakage.found(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_leaks": lambda s, d: leakage.leaks(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_mix": lambda s, d: mixture.mix(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_report": lambda s, d: mixture.report(mixture.mix(t(s, d, "documents"), t(s, d, "mix_targets")), t(s, d, "mix_targets")),
        "p9_checks": lambda s, d: mixture.checks(mixture.mix(t(s, d, "documents"), t(s, d, "mix_targets")), t(s, d, "mix_targets"), t(s, d, "documents")),
        "p10_found": lambda s, d: toxicity.found(t(s, d, "documents"), t(s, d, "review_labels")),
        "p10_scores": lambda s, d: toxicity.scores(t(s, d, "documents"), t(s, d, "review_labels")),
        "p10_rates": lambda s, d: toxicity.rates(toxicity.scores(t(s, d, "documents"), t(s, d, "review_labels"))),
    }


_SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LETTERS = r"regexp_replace(lower(%s), '[^\p{L}\p{N}]', '', 'g')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Fixed values, apart from those of `fold` so that either can find an error in the other: characters that look like
# the one below them.
_SEEN = "АВЕЅІЈКМНОРСТУХҮԚԜаеорсухѕіјһԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ‐‑‒–−﹣－‧∙⋅・ㆍ･"
_READ = "ABESIJKMHOPCTYXYQWaeopcyxsijhdqwlABEZHIKMNOPTYXovcj-------······"
_SHOWS_NOTHING = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064"
    "\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0\ufff9\ufffa\ufffb" + "".join(map(chr, range(0xFE00, 0xFE10)))
)
_NUMERALS = "Ⅰ I Ⅱ II Ⅲ III Ⅳ IV Ⅴ V Ⅵ VI Ⅶ VII Ⅷ VIII Ⅸ IX Ⅹ X Ⅺ XI Ⅻ XII ⅰ i ⅱ ii ⅲ iii ⅳ iv ⅴ v ⅵ vi ⅶ vii ⅷ viii ⅸ ix ⅹ x".split()
_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _unified(value: str) -> str:
    """SQL for the one form of a text: full-width forms, blanks and look-alikes replaced, the rest composed."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in _SEEN)
    for a, b in zip(_NUMERALS[::2], _NUMERALS[1::2]):
        value = f"replace({value}, '{a}', '{b}')"
    seen, read = wide + _BLANKS + _SEEN, "".join(chr(ord(c) - 0xFEE0) for c in wide) + " " * len(_BLANKS) + _READ
    return f"nfc_normalize(translate({value}, {_quoted(seen + _SHOWS_NOTHING)}, {_quoted(read)}))"


def oracle_sql():
    """SQL for what SQL can say; the others are tested against brute force, round trips or held-out labels."""
    strip = lambda x: f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    return {
        "p1_found": rf"""
with t as (select distinct chunk_id, text from sample_chunks where length(text) > 800),
u as (select chunk_id, unnest(string_split_regex(regexp_replace(text, '([.!?]){_SPACE}+', '\1' || chr(10), 'g'), '\r?\n')) as u from t),
m as (select distinct record_id, table_markdown as s from table_records where length(table_markdown) > 800),
l as (select record_id, string_split_regex(s, '\r\n|\n|\r') as l, case when contains(s, chr(13) || chr(10)) then 2 else 1 end as e from m),
h as (select record_id, l, e, len(l) > 1 and regexp_matches(trim(l[2]), '^\|?\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)*\|?\s*$') as sep from l),
r as (select record_id, length(l[1]) + e + case when sep then length(l[2]) + e else 0 end as head, list_filter(l[case when sep then 3 else 2 end:], lambda x: trim(x) <> '') as rows, e from h)
select 'text' as item_kind, chunk_id as item_id, case when max(length({strip('u')})) > 800 then 'forced' else 'natural' end as cut_kind from u group by chunk_id
union all select 'table', record_id::varchar, case when coalesce(list_max(list_transform(rows, lambda x: head + length(x))), head - e) > 800 then 'forced' else 'natural' end from r""",
        "p2_found": rf"""
with v as (select distinct chunk_id, text from sample_chunks where chunk_id is not null and regexp_matches(text, '{_SPACE.replace("[", "[^", 1)}')),
f as (select chunk_id, regexp_replace(lower({_unified('text')}), '{_SPACE}+', ' ', 'g') as s from v),
t as (select s, row_number() over (order by s) as i from (select distinct s from f)),
o as (select distinct i, substring(s, k, 5) as gram from (select i, s, unnest(generate_series(1, length(s) - 4)) as k from t where length(s) >= 5)),
d as (select gram, row_number() over (order by count(*), gram) as g from o group by gram),
e as (select i, g from o join d using (gram)),
n as (select i, count(*) as n from e group by i),
r as (select i, g, n, row_number() over (partition by i order by g) as pos from e join n using (i)),
c as (select distinct a.i as i, b.i as j, a.n as x, b.n as y from r a join r b on a.g = b.g and a.i < b.i and a.n >= 0.6 * b.n and b.n >= 0.6 * a.n
  where a.pos <= a.n - ceil(0.6 * a.n - 1e-9) + 1 and b.pos <= b.n - ceil(0.6 * b.n - 1e-9) + 1 and 1 + least(a.n - a.pos, b.n - b.pos) + least(a.pos, b.pos) >= 0.375 * (a.n + b.n)),
l as (select c.i, c.j from c join e a on a.i = c.i join e b on b.i = c.j and b.g = a.g group by c.i, c.j, x, y having count(*) >= 0.6 * (x + y - count(*)) - 1e-9),
m as (select chunk_id, i from f join t using (s)),
k as (select i, j from l union all select j, i from l union all select i, i from t)
select distinct a.chunk_id as chunk_id_a, b.chunk_id as chunk_id_b from m a join k on k.i = a.i join m b on b.i = k.j where a.chunk_id < b.chunk_id""",
        "p3_found": rf"""
with s as (select chunk_id, {_LETTERS % _unified('text')} as s from (select distinct chunk_id, text from sample_chunks where text is not null)),
p as (select chunk_id, length(s) as n, s, unnest(generate_series(1, length(s) - 11)) as i from s where length(s) >= 12),
f as (select chunk_id, n, i, min(i) over (partition by chunk_id, substring(s, i, 12)) as first from p),
c as (select distinct chunk_id, n, unnest(generate_series(i, i + 11)) as at from f where first < i)
select chunk_id from c group by chunk_id, n having count(*) >= 0.3 * n""",
        "p5_found": f"""
with v as (select distinct 'text' as field_name, chunk_id as id, text as value from sample_chunks union select distinct 'project_name', doc_id, metadata['project_name'] from sample_chunks),
u as (select field_name, id, value, {_unified('value')} as form from v where value is not null and id is not null)
select distinct a.field_name, a.id as id_a, b.id as id_b from u a join u b on a.field_name = b.field_name and a.form = b.form and a.value <> b.value and a.id < b.id""",
        "p8_found": rf"""
with i as (select item_id, {_LETTERS % 'text'} as s from eval_items where text is not null), d as (select doc_id, {_LETTERS % 'text'} as s from documents where text is not null),
ig as (select distinct item_id, substring(s, k, 12) as g from (select item_id, s, unnest(generate_series(1, length(s) - 11)) as k from i where length(s) >= 12)),
dg as (select distinct doc_id, substring(s, k, 12) as g from (select doc_id, s, unnest(generate_series(1, length(s) - 11)) as k from d where length(s) >= 12)),
n as (select item_id, count(*) as n from ig group by item_id)
select doc_id, item_id from dg join ig using (g) join n using (item_id) group by doc_id, item_id, n having count(*) >= 0.5 * n""",
        "p9_checks": "select source, true as share_met, true as repeats_met from mix_targets",
    }
