"""Registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import (
    conversation_trie,
    filter_audit,
    hnsw,
    html_text,
    language,
    merkle,
    mixing,
    packing,
    quality,
    sentence_pieces,
    simhash,
    suffixes,
    toxicity,
)
from arborlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_ids(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_digests(table(spark, sf_dir, "documents"))


@query
def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(table(spark, sf_dir, "documents"))


def _leaves(text: str) -> str:
    return f"""list_sort(list_distinct(list_transform(regexp_extract_all({text}, '{merkle.PIECE}'), lambda p: substr(md5(p), 1, {merkle.DIGITS}))))[1:{merkle.SKETCH}]"""


def _branches(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: sha256(p)))"


def _near(a: str, b: str, root_a: str, root_b: str) -> str:
    least = f"list_sort(list_distinct(list_concat({a}, {b})))[1:{merkle.SKETCH}]"
    shared = f"len(list_intersect({least}, list_intersect({a}, {b})))"
    return f"case when {root_a} = {root_b} then 1.0::double when len({a}) + len({b}) = 0 then 0.0::double else {shared}::double / len({least}) end"


ORACLES["op8_merkle"] = f"""
with texts as (select doc_id, coalesce(text, '') as a from documents),
next as (
  select doc_id, a, coalesce(lead(a) over (order by doc_id), first_value(a) over (order by doc_id)) as c from texts
),
edited as (
  select doc_id, a, c, length(a) as n, substring(a, 1, length(a) - length(a) // 2) || substring(c, 1, length(a) // 2) as b from next
),
cut as (
  select *, {_leaves("a")} as la, {_leaves("b")} as lb, {_leaves("c")} as lc, {_branches("a")} as ta, {_branches("b")} as tb, {_branches("c")} as tc from edited
),
rooted as (
  select *, sha256(array_to_string(list_transform(ta, lambda s: sha256(array_to_string(s, ','))), ',')) as ra,
    sha256(array_to_string(list_transform(tb, lambda s: sha256(array_to_string(s, ','))), ',')) as rb,
    sha256(array_to_string(list_transform(tc, lambda s: sha256(array_to_string(s, ','))), ',')) as rc,
    flatten(list_transform(range(greatest(len(ta), len(tb))), lambda i: list_filter(list_transform(
      range(greatest(coalesce(len(ta[i + 1]), 0), coalesce(len(tb[i + 1]), 0))),
      lambda j: case when ta[i + 1][j + 1] is distinct from tb[i + 1][j + 1] then [i, j] end), lambda x: x is not null))) as edits
  from cut
)
select doc_id, n as n_chars, sha256(b) as edited_sha256, ra || ':' || array_to_string(la, '') as fingerprint, rb || ':' || array_to_string(lb, '') as edited_fingerprint,
  {_near("la", "lb", "ra", "rb")} as near_edited, {_near("la", "lc", "ra", "rc")} as near_next,
  cast(len(edits) as integer) as n_differing, cast(edits[1][1] as integer) as edit_section, cast(edits[1][2] as integer) as edit_paragraph
from rooted
"""


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"))


@query
def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.embedding_groups(table(spark, sf_dir, "embeddings"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
firsts as (select t, min(doc_id) as first from texts group by t),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from texts),
fails as (
  select x.doc_id, x.part, coalesce(m.good, 0) as good, coalesce(m.toxic, 0) as toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 2 * length(x.t),
     regexp_matches(x.t, '[#$%&*|]'), coalesce(x.doc_id > f.first, false)] as f
  from words x join firsts f on f.t = x.t left join marks m on m.doc_id = x.doc_id
),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 3, 4, 5]) as i),
orders as (
  select [a.i, b.i, c.i, d.i, e.i] as o, a.l || b.l || c.l || d.l || e.l as filter_order
  from letters a join letters b on b.i <> a.i join letters c on c.i not in (a.i, b.i)
  join letters d on d.i not in (a.i, b.i, c.i) join letters e on e.i not in (a.i, b.i, c.i, d.i)
),
steps as (select o, filter_order, unnest([1, 2, 3, 4, 5]) as step from orders),
cells as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by part, f),
seen as (
  select part, filter_order, step, o[step] as i, n, good, toxic, f[o[step]] as hit,
    list_bool_or(list_transform(o[1:step - 1], lambda j: f[j])) as earlier,
    len(list_filter(f, lambda b: b)) = 1 and f[o[step]] as alone
  from cells cross join steps
),
counted as (
  select part, filter_order, step, i,
    sum(case when not hit and not coalesce(earlier, false) then n else 0 end) as kept,
    sum(case when hit and not coalesce(earlier, false) then n else 0 end) as removed,
    sum(case when hit and coalesce(earlier, false) then n else 0 end) as redundant,
    sum(case when alone then n else 0 end) as unique_fails,
    sum(case when hit and not coalesce(earlier, false) then good else 0 end) as good_lost,
    sum(case when hit and not coalesce(earlier, false) then toxic else 0 end) as toxic_lost
  from seen group by part, filter_order, step, i
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, i) as bigint) as shapley
from counted
"""


@query
def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_digests(table(spark, sf_dir, "documents"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_conversation_trie"] = """
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null
),
ids as (select conv_id, cast(conv_id as varchar) as digits from turns group by conv_id),
crc as (
  select conv_id, conv_id - conv_id % 5 as base,
    xor(list_reduce(
      list_concat([cast(4294967295 as bigint)], flatten(list_transform(string_split(digits, ''), lambda c: list_concat([cast(ascii(c) as bigint)], list_transform(range(8), lambda i: cast(-1 as bigint)))))),
      lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a // 2, cast(3988292384 as bigint)) else a // 2 end
    ), cast(4294967295 as bigint)) % 9 as h
  from ids
),
joined as (
  select c.conv_id, 0 as own, t.pos, t.role, t.text from crc c join turns t on t.conv_id = c.base and t.pos <= c.h
  union all
  select c.conv_id, 1 as own, t.pos, t.role, t.text from crc c join turns t on t.conv_id = c.conv_id and t.pos > c.h
),
rebuilt as (
  select conv_id, row_number() over w as depth, strlen(text) as n_bytes,
    string_agg(length(role) || ':' || role || length(text) || ':' || text || ';', '') over (w rows between unbounded preceding and current row) as prefix
  from joined window w as (partition by conv_id order by own, pos)
),
paths as (
  select conv_id, depth, n_bytes, prefix from rebuilt
  union all select conv_id, 0, 0, '' from crc
),
lengths as (select conv_id, max(depth) as len from paths group by conv_id),
nodes as (
  select p.prefix, p.depth, min(p.conv_id) as conv_id, count(*) as n_convs, max(p.n_bytes) as n_bytes,
    sha256(coalesce(string_agg(cast(p.conv_id as varchar), ',' order by p.conv_id) filter (where l.len = p.depth), '')) as ends_sha256
  from paths p join lengths l on l.conv_id = p.conv_id group by p.prefix, p.depth
),
parents as (
  select n.prefix, n.depth, p.prefix as above, p.conv_id as parent_conv_id
  from nodes n left join nodes p on p.depth = n.depth - 1 and starts_with(n.prefix, p.prefix)
),
children as (select above, depth - 1 as depth, count(*) as n from parents where above is not null group by above, depth),
below as (
  select n.prefix, n.depth, sum((m.n_convs - 1) * m.n_bytes) as saved, sum(case when c.n is null then 1 else 0 end) as leaves
  from nodes n join nodes m on m.depth >= n.depth and starts_with(m.prefix, n.prefix)
  left join children c on c.above = m.prefix and c.depth = m.depth
  group by n.prefix, n.depth
)
select n.conv_id, cast(n.depth as bigint) as depth, p.parent_conv_id, cast(n.n_convs as bigint) as n_convs, cast(coalesce(c.n, 0) as bigint) as n_children,
  cast(b.leaves as bigint) as n_leaves, cast(b.saved as bigint) as saved_tokens, n.ends_sha256
from nodes n join parents p on p.prefix = n.prefix and p.depth = n.depth
left join children c on c.above = n.prefix and c.depth = n.depth join below b on b.prefix = n.prefix and b.depth = n.depth
"""
