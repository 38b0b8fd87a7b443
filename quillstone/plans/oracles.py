"""The queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

import re

_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_CORPORA = """
regs as (select cast(row_number() over (order by vec_id) - 1 as integer) as reg_idx, vec_id, 'DOC-' || label as stem, embedding::double[] as e from embeddings where vec_id % 4 = 0),
procs as (select cast(row_number() over (order by vec_id) - 1 as integer) as proc_idx, vec_id, 'DOC-' || label as stem, embedding::double[] as e from embeddings where vec_id % 4 <> 0),
sizes as (select (select count(*) from regs) as m, (select count(*) from procs) as n),
pairs as materialized (select reg_idx, proc_idx, list_dot_product(r.e, p.e) / (sqrt(list_dot_product(r.e, r.e)) * sqrt(list_dot_product(p.e, p.e)) + 1e-8) as sim from regs r cross join procs p),
edges as materialized (select reg_idx as src, cast(proc_idx + m as integer) as dst, sim, greatest(0, 1 - sim) as weight from pairs, sizes where sim >= 0.30),
nodes as (select cast(i as integer) as id, case when i < m then 'REG' else 'PROC' end as kind, cast(case when i < m then i else i - m end as integer) as local_idx from (select unnest(range((select m + n from sizes))) as i), sizes),
best as (select reg_idx, proc_idx, sim from (select *, row_number() over (partition by reg_idx order by sim desc, proc_idx) as k from pairs) where k = 1),
covered as (select *, case when sim >= 0.35 then 'COVERED' when sim >= 0.30 then 'PARTIAL' else 'GAP' end as status from best)
"""
_LABEL = "left({0}.stem, 18) || ' | SEC-' || {0}.vec_id"
_NAMED = f"(select b.*, {_LABEL.format('r')} as reg_label, {_LABEL.format('p')} as proc_label from covered b join regs r using (reg_idx) join procs p using (proc_idx))"
_SELF = """
v as (select cast(vec_id as integer) as id, embedding::double[] as e from embeddings),
g as materialized (select a.id as src, b.id as dst, greatest(0, 1 - sim) as weight from (select a.id, b.id as bid, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-8) as sim from v a join v b on a.id < b.id) x join v a on a.id = x.id join v b on b.id = x.bid where sim >= 0.30)
"""


def _c(sql: str) -> str:
    return f"with recursive {_CORPORA} {sql}"


def _s(sql: str) -> str:
    return f"with recursive {_SELF} {sql}"


ORACLES: dict[str, str] = {
    "pairwise_cosine": _c("select reg_idx, proc_idx, round(sim, 6) as sim from pairs"),
    "cosine_stats": _c("select round(min(sim), 6) as min_sim, round(max(sim), 6) as max_sim, count(*) as pairs from pairs"),
    "edges": _c("select src, dst, round(sim, 6) as sim, round(weight, 6) as weight from edges"),
    "edge_counts": _c("select id, count(src) as degree from nodes left join edges on src = id group by id"),
    "csr_row_ptr": _c("select cast(x.id as integer) as id, cast((select count(*) from edges where src < x.id) as integer) as row_ptr from (select id from nodes union all select m + n from sizes) x"),
    "csr_fill": _c("select cast(row_number() over (order by src, dst) - 1 as integer) as pos, src, dst, round(sim, 6) as sim from edges"),
    "edge_density": _c("select count(*) as num_edges, round(100.0 * count(*) / (select greatest(m * n, 1) from sizes), 6) as density_pct from edges"),
    "best_match": _c("select reg_idx, proc_idx, round(sim, 6) as sim from best"),
    "coverage_status": _c(f"select reg_idx, proc_idx, round(sim, 6) as sim, status, reg_label, proc_label from {_NAMED}"),
    "coverage_summary": _c("select count(*) filter (status = 'COVERED') as covered, count(*) filter (status = 'PARTIAL') as partial, count(*) filter (status = 'GAP') as gaps, count(*) as total, round(100.0 * count(*) filter (status = 'COVERED') / count(*), 6) as coverage_pct from covered"),
    "coverage_default_threshold": _c("select count(*) filter (sim >= 0.75) as covered, count(*) filter (sim < 0.75 and sim >= 0.5) as partial, count(*) filter (sim < 0.5) as gaps, count(*) as total, round(100.0 * count(*) filter (sim >= 0.75) / count(*), 6) as coverage_pct, (select count(*) from pairs where sim >= 0.75) as edges from best"),
    "gap_list": _c(f"select reg_idx, proc_idx as best_proc, round(sim, 6) as best_sim, reg_label, proc_label, case when sim < 0.30 then 'NO MATCH' else 'PARTIAL' end as severity from {_NAMED} where sim < 0.35"),
    "gap_totals": _c("select case when sim < 0.30 then 'NO MATCH' else 'PARTIAL' end as severity, count(*) as n from best where sim < 0.35 group by 1"),
    "labels": "select distinct global_idx, left(coalesce(nullif(doc_id, ''), stem), 18) || ' | ' || coalesce(nullif(left(heading, 25), ''), section_id) as label, left(coalesce(nullif(doc_id, ''), stem), 18) || ' | ' || coalesce(nullif(left(heading, 28), ''), section_id) as ranking_label from sections",
    "matrix_lines": _c(f"select reg_idx, rpad(left(reg_label, 38), 38, ' ') || '  ' || rpad(case when sim >= 0.01 then left(proc_label, 38) else '—' end, 38, ' ') || '  ' || case when sim >= 0.01 then printf('%7.4f', sim) else '   —   ' end || '  ' || status as line from {_NAMED}"),
    "dot_edges": _c("select reg_idx, cast(k as integer) as k, proc_idx, case when sim >= 0.9 then '#006400' when sim >= 0.8 then '#228B22' else '#FF8C00' end as colour, printf('%.1f', 1 + (sim - 0.30) * 4) as penwidth, printf('%.3f', sim) as label from (select *, row_number() over (partition by reg_idx order by sim desc, proc_idx desc) as k from pairs where sim >= 0.30) where k <= 3"),
    "dot_nodes": r"""select global_idx as idx, '    "SRC-' || global_idx || '" [label="' || regexp_replace(left(coalesce(nullif(doc_id, ''), stem), 20), '(["\\\n])', '\\\1', 'g') || '\n' || regexp_replace(coalesce(nullif(left(heading, 22), ''), section_id), '(["\\\n])', '\\\1', 'g') || '" shape=box style=filled fillcolor=lightblue];' as line from (select distinct global_idx, doc_id, stem, heading, section_id from sections)""",
    "l2_norm_stats": "select label, round(min(x), 6) as min_norm, round(max(x), 6) as max_norm, round(avg(x), 6) as mean_norm, count(*) as n from (select label, sqrt(list_dot_product(embedding::double[], embedding::double[])) as x from embeddings) group by label",
    "top_pair_per_doc": "with u as (select label, vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-9 as n from embeddings), p as (select a.label, a.vec_id as i, b.vec_id as j, list_dot_product(a.e, b.e) / (a.n * b.n) as sim from u a join u b on a.label = b.label and a.vec_id < b.vec_id) select label, i, j, round(sim, 6) as sim from (select *, row_number() over (partition by label order by sim desc, i, j) as k from p) where k = 1",
    "mean_pool": "with t as (select label, case when embedding[1] > 0 then 1.0 else 0.0 end as m, embedding::double[] as e from embeddings), x as (select label, m, unnest(e) as h, unnest(range(len(e))) as dim from t) select label, cast(dim as integer) as dim, round(sum(h * m) / greatest(sum(m), 1e-9), 6) as value from x group by label, dim",
    "embed_input_text": "select distinct global_idx, coalesce(subject, '') || ' | ' || coalesce(heading, '') || ' | ' || coalesce(text_preview, '') as input from sections",
    "load_union": "with x as (select stem, count(*) as n from sections group by stem), y as (select *, sum(n) over (order by stem nulls first) - n as before, sum(n) over () as total from x) select source, stem, cast(before + source * total as integer) as first, cast(before + n - 1 + source * total as integer) as last, n as rows, n as numbers from y, (select unnest([0, 1]) as source)",
    "load_rows": "select stem, coalesce(nullif(doc_id, ''), stem) as doc_id, coalesce(doc_type, 'Order') as doc_type, coalesce(subject, '') as subject, section_id, coalesce(heading, '') as heading, coalesce(text_preview, '') as text_preview, coalesce(obligations, 0) as obligations, coalesce(citations, 0) as citations, cast(coalesce(len(embedding), -1) as integer) as dims, count(*) as rows from sections group by all",
    "stored_sections": "select cast(1 as bigint) as files, count(*) as sections, true as has_bytes from sections",
    "vector_problems": "select case when embedding is null then 'null' when len(embedding) <> 64 then 'length' when len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 'element' else 'none' end as problem, count(*) as rows from sections group by 1",
    "dirty_best": "with g as (select distinct global_idx, embedding::double[] as e from sections where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0) select a.global_idx as reg_idx, round(max(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-8)), 6) as sim from g a join g b on a.global_idx % 4 = 0 and b.global_idx % 4 <> 0 group by 1",
    "relabelled": "select distinct stem, case when contains(lower(stem), '740') then 'First' when contains(lower(stem), 'o-') then 'Order' else 'Other' end as label, subject from parsed_documents",
    "stem_collisions": "with f as (select stem, source_file from parsed_documents union select stem, 'mirror/' || source_file from parsed_documents) select stem, count(*) as n, string_agg(source_file, '|' order by source_file) as paths from f group by stem having count(*) > 1",
    "skip_done": "select stem from (select stem from parsed_documents union select 'doc-' || doc_id from documents) d where stem is not null and not exists (select 1 from parsed_sections s where s.stem = d.stem)",
    "empty_documents": "select cast(doc_id as varchar) as stem from documents where text is null",
    "document_scan": "select cast(doc_id as varchar) as stem, case when text is not null then cast(length(text) - length(replace(text, chr(12), '')) + 1 as integer) end as page_count, cast(length(replace(text, chr(12), chr(10) || chr(10))) as integer) as n_chars, md5(replace(text, chr(12), chr(10) || chr(10))) as digest, text is null as failed from documents",
    "first_files": "select cast(doc_id as varchar) as stem, cast(octet_length(encode(coalesce(text, '%PDF-broken'))) as bigint) as length from documents order by doc_id || '.txt' limit 5",
    "ingest_state": "select count(*) as files, count(*) as done, count(*) filter (text is null) as failed, cast(0 as bigint) as backlog, 100.0::double as percent from documents",
    "gap_lines": _c(f"select reg_idx, '[' || rpad(case when sim < 0.30 then 'NO MATCH' else 'PARTIAL' end, 8, ' ') || ']  ' || reg_label || chr(10) || repeat(' ', 11) || case when sim >= 0.01 then printf('nearest: %s (%.4f)', proc_label, sim) else 'nothing like it' end || chr(10) || repeat(' ', 11) || 'text: ' || left('SEC-' || (select vec_id from regs where regs.reg_idx = z.reg_idx) || ' of ' || (select stem from regs where regs.reg_idx = z.reg_idx), 100) || '…' as line from {_NAMED} z where sim < 0.35"),
    "one_pass": _c("select (select round(min(sim), 6) from pairs) as min_sim, (select round(max(sim), 6) from pairs) as max_sim, (select count(*) from pairs) as pairs, (select count(*) from best) as sources, (select round(sum(sim), 6) from best) as best_sum, (select count(*) from edges) as edges, (select round(sum(sim), 6) from edges) as edge_sum"),
    "bfs_coverage": _c("select count(*) filter (hit) as covered, count(*) as targets, round(100.0 * count(*) filter (hit) / count(*), 6) as coverage_pct from (select exists (select 1 from edges where src = 0 and dst = id) as hit from nodes where kind = 'PROC')"),
    "bfs_from_many": _c("select cast(id as bigint) as source, cast(id as bigint) as id, 0 as dist from nodes where kind = 'REG' union all select src, dst, 1 from edges"),
    "undirected_edges": _c("select src, dst, round(weight, 6) as weight from edges union all select dst, src, round(weight, 6) from edges"),
    "bfs": _s(", b(id, dist) as (select 0, 0 union select g.dst, b.dist + 1 from b join g on g.src = b.id) select cast(id as bigint) as id, min(dist) as dist from b group by id"),
    "bfs_levels": _s(", b(id, dist) as (select 0, 0 union select g.dst, b.dist + 1 from b join g on g.src = b.id) select dist, count(*) as nodes from (select id, min(dist) as dist from b group by id) group by dist"),
    "bfs_gaps": _c("select id, local_idx, not exists (select 1 from edges where src = 0 and dst = id) as is_gap from nodes where kind = 'PROC'"),
    "topo_order": _s(", l(id, level) as (select id, 0 from v union select g.dst, l.level + 1 from l join g on g.src = l.id) select cast(id as bigint) as id, max(level) as level, cast(row_number() over (order by max(level), id) - 1 as integer) as pos from l group by id"),
    "topo_levels": _s(", l(id, level) as (select id, 0 from v union select g.dst, l.level + 1 from l join g on g.src = l.id) select level, count(*) as nodes from (select id, max(level) as level from l group by id) group by level"),
    "cycle_check": _s(""", e as (select src, dst from g union all select max(id), min(id) from v),
reach(a, b) as (select src, dst from e union select r.a, e.dst from reach r join e on e.src = r.b),
loops as (select distinct a from reach where a = b), bad as (select a as id from loops union select r.b from reach r join loops l on l.a = r.a),
good as (select id from v where id not in (select id from bad)),
l(id, level) as (select id, 0 from good union select e.dst, l.level + 1 from l join e on e.src = l.id join good on good.id = e.dst)
select (select count(*) from v) as nodes, (select count(*) from good) as sorted, coalesce((select max(level) + 1 from l), 0) as levels, (select count(*) from bad) > 0 as has_cycle"""),
    "rank_sources": _c(""", rk as (select id, round(0.15 / (m + n) + 1e-12, 9) as rank from nodes, sizes where kind = 'REG')
select cast(row_number() over (order by rank desc, id) as integer) as place, case row_number() over (order by rank desc, id) when 1 then '★' when 2 then '·' when 3 then '·' else '' end as medal, cast(id as bigint) as idx, rank, left(r.stem, 18) || ' | SEC-' || r.vec_id as label from rk join regs r on r.reg_idx = id order by rank desc, id limit 15"""),
    "rank_targets": _c(""", deg as (select src, count(*) as k from edges group by src),
rk as (select nd.local_idx as idx, round(0.15 / max(m + n) + 0.85 * coalesce(sum(0.15 / (m + n) / k), 0) + 1e-12, 9) as rank from nodes nd cross join sizes left join edges e on e.dst = nd.id left join deg on deg.src = e.src where kind = 'PROC' group by nd.local_idx)
select cast(row_number() over (order by rank desc, idx) as integer) as place, case row_number() over (order by rank desc, idx) when 1 then '★' when 2 then '·' when 3 then '·' else '' end as medal, cast(idx as bigint) as idx, rank, left(p.stem, 18) || ' | SEC-' || p.vec_id as label from rk join procs p on p.proc_idx = idx order by rank desc, idx limit 10"""),
    "rank_top": _c(""", deg as (select src, count(*) as k from edges group by src),
rk as (select nd.id, round(0.15 / max(m + n) + 0.85 * coalesce(sum(0.15 / (m + n) / k), 0) + 1e-12, 9) as rank from nodes nd cross join sizes left join edges e on e.dst = nd.id left join deg on deg.src = e.src group by nd.id)
select cast(row_number() over (order by rank desc, id) as integer) as place, cast(id as bigint) as id, rank from rk order by rank desc, id limit 10"""),
    "ranking_lines": _c(""", rk as (select id, round(0.15 / (m + n) + 1e-12, 9) as rank from nodes, sizes where kind = 'REG'),
p as (select row_number() over (order by rank desc, id) as place, id, rank from rk order by rank desc, id limit 15)
select cast(place as integer) as place, '  ' || case when place = 1 then '★' when place <= 3 then '·' else ' ' end || ' ' || printf('%3d  %8.5f', place, rank) || '  ' || rpad(left(stem, 18), 22, ' ') || '  SEC-' || vec_id as line from p join regs on reg_idx = id"""),
    "hierarchy": _c(""", lv as (select id, kind, local_idx, case when exists (select 1 from edges where dst = id) then 1 else 0 end as level from nodes)
select cast(row_number() over (order by level, id) - 1 as integer) as pos, kind, case kind when 'REG' then (select left(stem, 18) || ' | SEC-' || vec_id from regs where reg_idx = local_idx) else (select left(stem, 18) || ' | SEC-' || vec_id from procs where proc_idx = local_idx) end as label from lv"""),
    "sssp": _s(", d(it, id, dist) as (select 0, 0, 0.0::double union all select it + 1, id, min(dist) from (select d.it, g.dst as id, d.dist + g.weight as dist from d join g on g.src = d.id where d.it < 60) group by it, id), x as (select id, min(dist) as dist from d group by id) select cast(x.id as bigint) as id, round(x.dist, 6) as dist, (select cast(arg_min(g.src, y.dist + g.weight) as bigint) from g join x y on y.id = g.src where g.dst = x.id) as pred from x"),
    "sssp_path": _s(", d(it, id, dist, path) as (select 0, 0, 0.0::double, '0' union all select it + 1, id, min(dist), arg_min(path, dist) from (select d.it, g.dst as id, d.dist + g.weight as dist, d.path || '>' || g.dst as path from d join g on g.src = d.id where d.it < 60) group by it, id) select cast(id as bigint) as id, arg_min(path, dist) as path from d group by id"),
    "strongest_paths": _c("select cast(id as bigint) as id, local_idx, round(weight, 6) as dist, round(1 - weight, 6) as similarity from edges join nodes on id = dst where src = 0 order by weight, id limit 10"),
    "distance_summary": _s(", d(it, id, dist) as (select 0, 0, 0.0::double union all select it + 1, id, min(dist) from (select d.it, g.dst as id, d.dist + g.weight as dist from d join g on g.src = d.id where d.it < 60) group by it, id), x as (select id, min(dist) as dist from d group by id) select count(*) as reachable, round(100.0 * count(*) / (select count(*) from v), 6) as reachable_pct, round(min(dist), 6) as min_dist, round(max(dist), 6) as max_dist from x"),
    "apsp": _s(", d(it, src, dst, dist) as (select 0, id, id, 0.0::double from v union all select it + 1, src, dst, min(dist) from (select d.it, d.src, g.dst, d.dist + g.weight as dist from d join g on g.src = d.dst where d.it < 60) group by it, src, dst) select cast(src as bigint) as src, cast(dst as bigint) as dst, round(min(dist), 6) as dist from d group by src, dst"),
    "apsp_coverage": _c("select m * n as pairs, (select count(*) from edges) as reachable, m * n - (select count(*) from edges) as gaps, round(100.0 * (select count(*) from edges) / (m * n), 6) as reachable_pct from sizes"),
}

# the file's parts in order, each with the order of its lines
_NODE = """'    "{0}-' || {1} || '" [label="' || left(stem, 20) || '\\n' || left('SEC-' || vec_id, 22) || '" shape={2} style=filled fillcolor={3}];'"""


def _fixed(part: int, *lines: str) -> str:
    return " union all ".join(f"select {part} as part, {i} as a, 0 as b, {repr(x) if chr(39) not in x else x} as line" for i, x in enumerate(lines))


ORACLES["dot_file"] = _c(
    f""", lines as (
{_fixed(0, 'digraph coverage {', '  graph [rankdir=LR fontname="Helvetica" label="Similar sections" labelloc=t fontsize=14];', '  node [fontname="Helvetica" fontsize=10];', '  edge [fontname="Helvetica" fontsize=8];', '')}
union all {_fixed(1, '  subgraph cluster_source {', '    label="Source Corpus"; style=filled; color=lightblue;')}
union all select 2, reg_idx, 0, {_NODE.format('SRC', 'reg_idx', 'box', 'lightblue')} from regs
union all {_fixed(3, '  }', '', '  subgraph cluster_target {', '    label="Target Corpus"; style=filled; color=lightgreen;')}
union all select 4, proc_idx, 0, {_NODE.format('TGT', 'proc_idx', 'ellipse', 'lightgreen')} from procs
union all {_fixed(5, '  }', '')}
union all select 6, reg_idx, k, '  "SRC-' || reg_idx || '" -> "TGT-' || proc_idx || '" [label="' || printf('%.3f', sim) || '" color="' || case when sim >= 0.9 then '#006400' when sim >= 0.8 then '#228B22' else '#FF8C00' end || '" penwidth="' || printf('%.1f', 1 + (sim - 0.30) * 4) || '"];' from (select *, row_number() over (partition by reg_idx order by sim desc, proc_idx desc) as k from pairs where sim >= 0.30) where k <= 3
union all {_fixed(7, '}')})
select row_number() over (order by part, a, b) as n, line from lines"""
)
# stored under one stem each, so the order is that of the corpora; the document's id still is the stem it had
_GAPPED = "select reg_idx, '[NO MATCH]  ' || reg_label as l1, repeat(' ', 11) || case when sim >= 0.01 then printf('nearest: %s (%.4f)', proc_label, sim) else 'nothing like it' end as l2 from x where sim < 0.35"
ORACLES["report_file"] = _c(
    f""", x as {_NAMED},
cov as (select -2 as a, 0 as b, 'Best matches at threshold 0.35' as line union all select -1, 0, m || ' source sections, ' || n || ' target sections' from sizes
  union all select reg_idx, 0, rpad(left(reg_label, 38), 38, ' ') || '  ' || rpad(case when sim >= 0.01 then left(proc_label, 38) else '—' end, 38, ' ') || '  ' || case when sim >= 0.01 then printf('%7.4f', sim) else '   —   ' end || '  ' || case when sim >= 0.35 then 'COVERED' when sim >= 0.5 then 'PARTIAL' else 'GAP' end from x
  union all select 1000000000, 0, printf('Covered %d, partial 0, gap %d; coverage %.1f %%', count(*) filter (sim >= 0.35), count(*) filter (sim < 0.35), 100.0 * count(*) filter (sim >= 0.35) / count(*)) from x),
gap as (select -2 as a, 0 as b, 'Gaps at threshold 0.35' as line union all select -1, 0, count(*) filter (sim < 0.35) || ' of ' || count(*) || ' source sections lack a match' from x
  union all select reg_idx, 0, l1 from ({_GAPPED}) union all select reg_idx, 1, l2 from ({_GAPPED})
  union all select 1000000000, 0, count(*) filter (sim < 0.35) || ' below 0.5, 0 between' from x)
select 'coverage' as kind, row_number() over (order by a, b) as n, line from cov union all select 'gaps', row_number() over (order by a, b), line from gap"""
)

_PAGERANK = """, deg as (select src, count(*) as k from g group by src), c as (select count(*) as n from v),
w as materialized (select g.src, g.dst, 0.85 / k as f from g join deg using (src)),
r(it, id, rank) as (select 0, id, 0.15::double / n from v, c union all select it + 1, id, sum(x) from (select r.it, w.dst as id, r.rank * w.f as x from r join w on w.src = r.id where r.it < 60) group by it, id)
select cast(id as bigint) as id, round(sum(rank) + 1e-12, 8) as rank from r group by id"""
ORACLES["pagerank"] = _s(_PAGERANK)

# An edge is in the forest exactly if no way between its ends has only lighter edges.
_FOREST = (
    """, l as materialized (select src as a, dst as b, weight as w from edges),
u0 as materialized (select a, b, min(w) as w from (select a, b, w from l union all select b, a, w from l union all select id, id, 0 from nodes) group by a, b),
"""
    + ",\n".join(f"u{i + 1} as materialized (select x.a, y.b, min(greatest(x.w, y.w)) as w from u{i} x join u{i} y on x.b = y.a group by x.a, y.b)" for i in range(6))
    + ",\nforest as materialized (select l.a as src, l.b as dst, l.w as weight from l join u6 on u6.a = l.a and u6.b = l.b where u6.w >= l.w)\n"
)
ORACLES["mst_edges"] = _c(_FOREST + "select cast(src as bigint) as src, cast(dst as bigint) as dst, round(weight, 6) as weight from forest")
ORACLES["mst_stats"] = _c(_FOREST + "select count(*) as edges, round(sum(weight), 6) as total_weight, round(1 - avg(weight), 6) as mean_similarity, count(distinct dst) as targets, round(100.0 * count(distinct dst) / (select n from sizes), 6) as targets_pct from forest")
ORACLES["mst_top_links"] = _c(_FOREST + "select cast(src as bigint) as src, cast(dst as bigint) as dst, round(1 - weight, 6) as similarity from forest order by weight, src, dst limit 10")

_PARTS = "t as (select distinct section_key as k, coalesce(text, '') as text from parsed_sections)"
_DOCS = "t as (select doc_id as k, coalesce(text, '') as text from documents)"


def _p(pattern: str) -> str:
    """The pattern with Unicode white space, inside and outside of character classes."""
    inner = _WS[1:-1]
    for c in (r"[-\s]", r"[:\s]", r"[A-Z\s]", r"[A-Z\s,/()\-]"):
        pattern = pattern.replace(c, c.replace(r"\s", inner))
    return pattern.replace("'", "''").replace(r"\s", _WS) if inner not in pattern else inner.join(x.replace("'", "''").replace(r"\s", _WS) for x in pattern.split(inner))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


# The patterns of functions/text.py as DuckDB's engine reads them.
_CITES = (
    ("doe", r"(?i)\bDOE\s+[OPMGN]\s+[\d]+\.[\d]+[A-Za-z\d.\-]*(?:\s+Chg\s*\d+)?(?:\s+\([A-Za-z]+\))?", _strip("x")),
    ("cfr", r"\b(\d+)\s+C\.?F\.?R\.?\s+(?:[Pp]arts?\s+|§\s*)?(\d+[\d.\-]*)", "a || ' CFR ' || b"),
    ("usc", r"\b(\d+)\s+U\.?S\.?C\.?\s+(?:[Ss]ec(?:tions?|\.?)\s*|§\s*)?(\d+[\d.\-]*)", "a || ' USC ' || b"),
    ("eo", r"(?i)\bExecutive\s+Order\s+(\d+)", "'EO ' || a"),
    ("pl", r"(?i)\b(?:P\.?L\.?|Public\s+Law)\s+(\d+[-–]\d+)", "'PL ' || a"),
    ("hspd", r"(?i)\bHSPD[-\s](\d+)", "'HSPD ' || a"),
)
_DEFS = (r'(?i)"([^"]{2,80})"\s+means\s+([^.]{10,300}\.)', r"\b([A-Z][A-Z\s]{2,50})\s+means\s+([^.]{10,300}\.)", r'(?i)\bthe\s+term\s+"([^"]{2,80})"\s+(?:means|is\s+defined\s+as)\s+([^.]{10,300}\.)')
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_DATE = rf"(?i)\b(?:\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}})"
_AGENCIES = ("CIA", "DHS", "DOD", "DOE", "DOT", "EPA", "FBI", "FEMA", "GAO", "NASA", "NIST", "NNSA", "NRC", "NSA", "OMB", "OSHA")
_HEADS = "Administration|Agency|Authority|Board|Bureau|Center|Commission|Committee|Council|Department|Directorate|Institute|Laboratory|Ministry|Office|Service"
_B, _A, _H = r"^(\d{1,2})\.\s+([A-Z][A-Z ,/()\-]{2,80})\.\s*(.*)", r"^\s*(\d{1,2})\.\s*$", r"^([A-Z][A-Z\s,/()\-]{2,80})\.\s*(.*)"
_H1, _H2 = r"(?i)\n\s*\d*\s*\n?\s*DOE\s+[OPMGN]\s+[\d]+\.[\d]+[A-Za-z\d.\- ]*\n\s*[\d\-]+\s*\n", r"(?i)\n\s*DOE\s+[OPMGN]\s+[\d]+\.[\d]+[A-Za-z\d.\- ]*\s*\n\s*\d+\s*\n\s*[\d\-]+\s*\n"


def _cited(rel: str, out: str) -> str:
    """``out(k, ord, cit_type, reference, context)`` of ``rel(k, text)``: places of matches are the lengths of what
    lies between them and of themselves, summed up."""
    each = []
    for i, (kind, pattern, form) in enumerate(_CITES):
        p, groups = _p(pattern), len(re.findall(r"(?<!\\)\((?!\?)", pattern))
        a, b = (f"regexp_extract_all(text, '{p}', {g}) as {n}" if g <= groups else f"[]::varchar[] as {n}" for g, n in ((1, "aa"), (2, "bb")))
        each.append(f"""select k, text, '{kind}' as cit_type, {i} * 1000000 + i as ord, {form} as reference, x, s from (
  select k, text, i, xs[i] as x, aa[i] as a, bb[i] as b, cast(list_sum(list_transform(gaps[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(xs[1:i - 1], lambda y: length(y))), 0) as bigint) as s
  from (select *, unnest(range(1, len(xs) + 1)) as i from (select k, text, regexp_extract_all(text, '{p}') as xs, {a}, {b}, string_split_regex(text, '{p}') as gaps from {rel})))""")
    around = "replace(substring(text, greatest(s - 40, 0) + 1, s + length(x) + 40 - greatest(s - 40, 0)), chr(10), ' ')"
    return f"{out}_all as ({' union all '.join(each)}), {out} as (select k, ord, cit_type, reference, {_strip(around)} as context from (select *, row_number() over (partition by k, reference order by ord) as r from {out}_all) where r = 1)"


def _obliged(rel: str, out: str) -> str:
    s = f"select k, {_strip('x')} as s, i from (select k, unnest(xs) as x, unnest(range(len(xs))) as i from (select k, regexp_extract_all(text, '[^.!?]*\\b(?i:shall|must)\\b[^.!?]*[.!?]') as xs from {rel}))"
    return f"{out} as (select k, min(i) as ord, case when regexp_matches(any_value(s), '(?i)\\bshall\\b') then 'shall' else 'must' end as modal, replace(s, chr(10), ' ') as sentence from ({s}) where length(s) between 15 and 600 group by k, replace(s, chr(10), ' '))"


def _defined(rel: str, out: str) -> str:
    each = " union all ".join(f"select k, {i} * 1000000 + unnest(range(len(xs))) as ord, unnest(aa) as a, unnest(bb) as b from (select k, regexp_extract_all(text, '{_p(p)}') as xs, regexp_extract_all(text, '{_p(p)}', 1) as aa, regexp_extract_all(text, '{_p(p)}', 2) as bb from {rel})" for i, p in enumerate(_DEFS))
    return f"{out} as (select k, ord, term, definition from (select *, row_number() over (partition by k, term order by ord) as r from (select k, ord, {_strip('a')} as term, {_strip('b')} as definition from ({each}))) where r = 1)"


def _date(x: str, table: str, keys: str) -> str:
    months = ", ".join(f"'{m.lower()}'" for m in _MONTHS.split("|"))
    dig, nam = _p(r"^\s*(\d{1,2})[-/](\d{1,2})[-/](\d{4}|\d{2})\s*$"), _p(r"^\s*([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})\s*$")
    return f"""(select {keys}, {x} as raw, try_cast(regexp_extract({x}, '{dig}', 1) as int) as a, try_cast(regexp_extract({x}, '{dig}', 2) as int) as b, try_cast(regexp_extract({x}, '{dig}', 3) as int) as y, nullif(list_position([{months}], lower(regexp_extract({x}, '{nam}', 1))), 0) as nm, try_cast(regexp_extract({x}, '{nam}', 2) as int) as nd, try_cast(regexp_extract({x}, '{nam}', 3) as int) as ny from {table})"""


_DONE = "coalesce(strftime(try_cast(printf('%04d-%02d-%02d', coalesce(case when y < 69 then y + 2000 when y < 100 then y + 1900 else y end, ny), coalesce(case when a > 12 and b <= 12 then b else a end, nm), coalesce(case when a > 12 and b <= 12 then a else b end, nd)) as date), '%Y-%m-%d'), raw)"


def _dated(rel: str, out: str) -> str:
    each = f"select k, {_strip('x')} as x, i from (select k, unnest(xs) as x, unnest(range(len(xs))) as i from (select k, regexp_extract_all(text, '{_p(_DATE)}') as xs from {rel}))"
    return f"{out}_raw as (select k, x, min(i) as ord from ({each}) group by k, x), {out} as (select k, ord, {_DONE} as date from {_date('x', f'{out}_raw', 'k, ord')})"


def _named(rel: str, out: str) -> str:
    return f"{out} as (select k, agency from {rel}, (select unnest([{', '.join(repr(a) for a in _AGENCIES)}]) as agency) where regexp_matches(text, '\\b' || agency || '\\b'))"


def _cleaned(rel: str, out: str) -> str:
    return f"{out} as (select k, regexp_replace(regexp_replace(regexp_replace(text, '{_p(_H1)}', chr(10), 'g'), '{_p(_H2)}', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') as text from {rel})"


def _sectioned(rel: str, out: str) -> str:
    """``out(k, pos, section_id, heading, text)``: marks are headed lines, and numbers alone whose next line with
    anything on it is a heading; a section goes to the next mark."""
    b, a, h = _p(_B), _p(_A), _p(_H)
    return f"""{out}_ln as (select k, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from (select k, string_split(regexp_replace(text, '\\r\\n|[\\r\\v\\f\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)) as ls from {rel})),
{out}_nb as (select k, i, s, lead(i) over w as ni, lead(s) over w as ns from (select k, i, {_strip('line')} as s from {out}_ln) where s <> '' window w as (partition by k order by i)),
{out}_mk as (
  select k, i, regexp_extract(s, '{b}', 1) as number, {_strip(f"regexp_extract(s, '{b}', 2)")} as heading, regexp_extract(s, '{b}', 3) as fst, i + 1 as start from {out}_nb where regexp_matches(s, '{b}')
  union all select k, i, regexp_extract(s, '{a}', 1), case when regexp_matches(ns, '{h}') then {_strip(f"regexp_extract(ns, '{h}', 1)")} end, {_strip(f"regexp_extract(ns, '{h}', 2)")}, ni + 1 from {out}_nb where regexp_matches(s, '{a}') and not regexp_matches(s, '{b}')),
{out}_se as (select *, coalesce(lead(i) over (partition by k order by i), 1000000000) as fin from {out}_mk),
{out}_bd as (select se.k, se.i, number, heading, fst, string_agg(line, chr(10) order by ln.i) as rest from {out}_se se left join {out}_ln ln on ln.k = se.k and ln.i >= start and ln.i < fin where heading <> '' group by all),
{out} as (
  select k, cast(row_number() over (partition by k order by i) - 1 as integer) as pos, number as section_id, heading, {_strip(f"concat_ws(chr(10), case when {_strip('fst')} <> '' then fst end, rest)")} as text from {out}_bd
  union all select k, 0, '0', 'FULL_TEXT', {_strip('text')} from {rel} where k not in (select k from {out}_bd))"""


def _meta(rel: str, keys: str) -> str:
    """``(keys, found_id, doc_type, subject, approved_date, initiating_office)``."""
    ident = _p(r"\bDOE\s+([OPMGN])\s+([\d]+\.[\d]+[A-Za-z\d.\-]*(?:\s+Chg\s*\d+)?)")
    x = f"""(select {keys}, regexp_extract(left(text, 500), '{ident}', 1) as l, {_strip(f"regexp_extract(left(text, 500), '{ident}', 2)")} as nr, {_strip(f"regexp_extract(left(text, 1500), '{_p(r'(?i)SUBJECT[:\s]+([^\n]{5,200})')}', 1)")} as subject, {_strip(f"regexp_extract(left(text, 800), '{_p(r'(?i)Approved\s*[:\s]+([^\n]{5,30})')}', 1)")} as ap, {_strip(f"regexp_extract(left(text, 1000), '{_p(r'(?i)INITIATED\s+BY[:\s]+([^\n]{5,100})')}', 1)")} as initiating_office from {rel})"""
    return f"select {keys}, case when l = '' then '' else 'DOE ' || l || ' ' || nr end as found_id, case l when 'P' then 'Policy' when 'M' then 'Manual' when 'G' then 'Guide' when 'N' then 'Notice' else 'Order' end as doc_type, subject, {_DONE} as approved_date, initiating_office from {_date('ap', x, f'{keys}, l, nr, subject, initiating_office')}"


for _kind, _, _ in _CITES:
    ORACLES[f"cite_{_kind}"] = f"with {_PARTS}, {_cited('t', 'c')} select k as section_key, reference from c where cit_type = '{_kind}'"
ORACLES["citations"] = f"with {_PARTS}, {_cited('t', 'c')} select k as section_key, cit_type, reference, context from c"
ORACLES["obligations"] = f"with {_DOCS}, {_obliged('t', 'o')} select k as doc_id, modal, sentence from o"
ORACLES["definitions"] = f"with {_PARTS}, {_defined('t', 'f')} select k as section_key, term, definition from f"
ORACLES["dates"] = f"with {_PARTS}, {_dated('t', 'd')} select distinct k as section_key, date from d"
ORACLES["document_dates"] = f"with x as (select distinct approved_date as x from parsed_documents where approved_date is not null) select x as approved_date, {_DONE} as date from {_date('x', 'x', 'x')}"
ORACLES["agencies"] = f"with {_DOCS}, {_named('t', 'n')} select k as doc_id, agency from n"
ORACLES["organisations"] = f"""with {_PARTS}, x as (select distinct k, regexp_replace(unnest(regexp_extract_all(text, '\\b(?:[A-Z][A-Za-z&-]* )*(?:{_HEADS})\\b(?: (?:of|for|on)(?: the)? [A-Z][A-Za-z&-]*(?: [A-Z][A-Za-z&-]*)*(?: and [A-Z][A-Za-z&-]*(?: [A-Z][A-Za-z&-]*)*)?)*')), '^The ', '') as name from t)
select k as section_key, name from x where length(name) between 3 and 80 and not regexp_full_match(name, '{_HEADS}')"""
ORACLES["truncation"] = f"with {_PARTS} select k as section_key, cast(length(left(text, 2048)) as integer) as n_chars, md5(left(text, 2048)) as digest from t"
ORACLES["doc_metadata"] = f"with {_DOCS} select m.* exclude (k), k as doc_id from ({_meta('t', 'k')}) m"
ORACLES["header_strip"] = f"with {_DOCS}, {_cleaned('t', 'c')} select k as doc_id, cast(length(c.text) as integer) as n_chars, md5(c.text) as digest, length({_strip('t.text')}) < 100 as near_empty from c join t using (k)"
_SECTIONS = f"{_DOCS}, {_cleaned('t', 'c')}, {_sectioned('c', 's')}"
ORACLES["sections_split"] = f"with {_SECTIONS} select k as doc_id, pos, section_id, heading, cast(length(text) as integer) as n_chars, md5(text) as digest from s"
_FACTS = f"{_SECTIONS}, p as (select k || '/' || pos as k, k as doc, pos, section_id, heading, text from s), {_cited('p', 'pc')}, {_obliged('p', 'po')}, {_defined('p', 'pf')}, {_dated('p', 'pd')}, {_named('c', 'cn')}"


def _listed(table: str, value: str, order: str, key: str, most: int | None = None) -> str:
    rows = f"(select * from {table} where k = {key} order by {order}{f' limit {most}' if most else ''})"
    return f"coalesce((select string_agg({value}, '|' order by {order}) from {rows}), '')"


ORACLES["section_facts"] = f"with {_FACTS} select cast(doc as varchar) as stem, pos as section_pos, {_listed('pc', 'reference', 'ord', 'p.k')} as citations, {_listed('po', 'sentence', 'ord', 'p.k')} as obligations, {_listed('pf', 'term', 'ord', 'p.k')} as definitions, {_listed('pd', 'date', 'ord', 'p.k')} as dates, {_listed('cn', 'agency', 'agency', 'p.doc')} as agencies from p"
ORACLES["ingest"] = f"with {_FACTS} select cast(doc as varchar) as stem, pos as section_pos, section_id, heading, replace(left(text, 200), chr(10), ' ') as text_preview, cast((select count(*) from po where po.k = p.k) as integer) as obligations, cast((select count(*) from pc where pc.k = p.k) as integer) as citations, 64 as dims from p where doc in (select doc_id from documents where text is not null)"
ORACLES["document_summary"] = f"""with {_SECTIONS}, {_cited('c', 'dc')}, {_obliged('c', 'dob')}, {_defined('c', 'df')}, {_named('c', 'dn')}, m as ({_meta('c', 'k')})
select cast(k as varchar) as source_file, found_id, doc_type, subject, approved_date, initiating_office, {', '.join(f"cast({least}(select count(*) from {t} where {t}.k = m.k){end} as integer) as {n}" for t, n, least, end in (('s', 'sections', '', ''), ('dc', 'citations', '', ''), ('dob', 'obligations', 'least(', ', 50)'), ('df', 'definitions', '', ''), ('dn', 'agencies', '', '')))}, {_listed('dc', 'reference', 'ord', 'm.k', 5)} as first_citations, {_listed('dob', 'sentence', 'ord', 'm.k', 3)} as first_obligations, {_listed('df', 'term', 'ord', 'm.k', 3)} as first_definitions from m"""
ORACLES["parsed_json"] = ORACLES["document_summary"]
ORACLES["fact_counts"] = "select distinct section_key, cast(len(obligations) as integer) as obligations, cast(len(citations) as integer) as citations, replace(left(text, 200), chr(10), ' ') as text_preview from parsed_sections"
ORACLES["hash_embedding"] = r"""with t as (select section_key as k, regexp_extract_all(lower(coalesce(heading, '') || ' | ' || coalesce(text, '')), '[\pL\pN_]+') as w from (select distinct section_key, heading, text from parsed_sections)),
h as (select k, list_transform(w, lambda x: ('0x' || left(md5(x), 8))::bigint) as h from t),
e as (select k, unnest(h || list_transform(range(1, len(h)), lambda i: (31 * h[i] + h[i + 1]) % 4294967296)) as v from h),
s as (select k, v % 64 as dim, cast(sum(case when v >= 2147483648 then 1 else -1 end) as double) as x from e group by k, dim),
n as (select k, sqrt(sum(x * x)) as norm from s group by k)
select k as section_key, cast(dim as integer) as dim, round(x / norm, 4) as value from s join n using (k) where x <> 0"""
