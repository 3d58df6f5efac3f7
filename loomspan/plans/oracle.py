"""The queries of queries.py as plain DuckDB SQL, written without any of the joins' tricks."""

from __future__ import annotations

from .fixtures import NAMES
from .queries import POINTS

_BASE = {k: v.format(string="varchar") for k, v in NAMES.items()}


def _merge(name: str, source: str, keys: str, collect: bool) -> str:
    """CTEs that end in `name`: merged intervals of `source`."""
    tools = ", array_to_string(list_sort(list_distinct(flatten(list(src)))), '|') as sources" if collect else ""
    same = " and ".join(f"s.{k} = i.{k}" for k in (*keys.split(", "), "chrom"))
    own = ", ".join(f"i.{k}" for k in keys.split(", "))
    return f"""{name}_0 as (select distinct {keys}, chrom, cstart, cend from {source}),
{name}_1 as (select *, max(cend) over (partition by {keys}, chrom order by cstart, cend rows between unbounded preceding and 1 preceding) as reach from {name}_0),
{name}_2 as (select *, sum(case when cstart <= reach then 0 else 1 end) over (partition by {keys}, chrom order by cstart, cend rows unbounded preceding) as island from {name}_1),
{name}_3 as (select {keys}, chrom, min(cstart) as cstart, max(cend) as cend from {name}_2 group by {keys}, chrom, island),
{name} as (select {own}, i.chrom, i.cstart, i.cend{tools} from {name}_3 i join {source} s on {same} and s.cstart >= i.cstart and s.cend <= i.cend group by {own}, i.chrom, i.cstart, i.cend)"""


_OV = "least({a}.cend, {b}.cend) - greatest({a}.cstart, {b}.cstart)"
_AB = _OV.format(a="a", b="b")
_RECIPROCAL = f"2 * ({_AB}) >= a.cend - a.cstart and 2 * ({_AB}) >= b.cend - b.cstart"
_LOGS = f"(log10(1000000.0) - log10(500.0)) / {POINTS - 1}"
_BINS = f"select cast(i as int) as bin, pow(10.0, log10(500.0) + i * {_LOGS}) as lower, pow(10.0, log10(500.0) + (i + 1) * {_LOGS}) as upper from range({POINTS - 1}) r(i)"
_IDS = "case when classification = 'FP' then pred_chrom else truth_chrom end as c1, case when classification = 'FP' then pred_start else truth_start end as c2, case when classification = 'FP' then pred_end else truth_end end as c3, svtype as c4"

_CTES = [
    *(f"{k} as ({v})" for k, v in _BASE.items()),
    "untouched as (select * from calls where svtype <> 'NA')",
    "driven as (select * from untouched u where exists (select 1 from untouched d where d.tool = 'delly' and d.sample = u.sample and d.svtype = u.svtype))",
    "kept as (select * from driven c where chrom in (select chrom from genome) and not exists (select 1 from regions r where r.chrom = c.chrom and 2 * (least(c.cend, r.cend) - greatest(c.cstart, r.cstart)) >= c.cend - c.cstart))",
    f"pairs as (select a.sample, a.svtype, a.chrom, a.tool as a_tool, a.cstart as a_cstart, a.cend as a_cend, b.tool as b_tool, b.cstart as b_cstart, b.cend as b_cend from kept a join kept b on a.sample = b.sample and a.svtype = b.svtype and a.chrom = b.chrom and a.tool < b.tool and {_RECIPROCAL})",
    "clips as (select sample, svtype, chrom, greatest(a_cstart, b_cstart) as cstart, least(a_cend, b_cend) as cend, [a_tool, b_tool] as src from pairs)",
    "wholes as (select sample, svtype, chrom, a_cstart as cstart, a_cend as cend, [a_tool, b_tool] as src from pairs union all select sample, svtype, chrom, b_cstart, b_cend, [a_tool, b_tool] from pairs)",
    _merge("inter", "clips", "sample, svtype", True),
    _merge("unions", "wholes", "sample, svtype", True),
    "common as (select sample from headers group by sample having count(distinct bench) = (select count(distinct bench) from headers))",
    "truths as (select * from truth where sample in (select sample from common))",
    _merge("merged", "truths", "sample, svtype", False),
    """pred as (select 'intersections' as input_set, * from inter union all select 'unions', * from unions
  union all select 'gatk', sample, svtype, chrom, cstart, cend, tool from kept where tool = 'gatk')""",
    f"tps as (select a.input_set, a.sample, a.svtype, a.chrom, a.cstart, a.cend, a.sources, b.cstart as t1, b.cend as t2 from pred a join merged b on a.sample = b.sample and a.svtype = b.svtype and a.chrom = b.chrom and {_RECIPROCAL})",
    "held as (select distinct s.input_set, m.* from merged m join (select distinct input_set, sample from pred) s on s.sample = m.sample)",
    f"""cls as (select 'TP' as classification, input_set, sample, svtype, chrom as pred_chrom, cstart as pred_start, cend as pred_end, sources, chrom as truth_chrom, t1 as truth_start, t2 as truth_end, cend - cstart as pred_size, t2 - t1 as truth_size from tps
  union all select 'FP', input_set, sample, svtype, chrom, cstart, cend, sources, null, null, null, cend - cstart, null from pred a where not exists (select 1 from merged b where a.sample = b.sample and a.svtype = b.svtype and a.chrom = b.chrom and {_RECIPROCAL})
  union all select 'FN', input_set, sample, svtype, null, null, null, null, chrom, cstart, cend, null, cend - cstart from held a where not exists (select 1 from pred b where a.input_set = b.input_set and a.sample = b.sample and a.svtype = b.svtype and a.chrom = b.chrom and {_RECIPROCAL}))""",
    "bounded as (select * from cls where (pred_size is null or pred_size between 500 and 1000000) and (truth_size is null or truth_size between 500 and 1000000))",
    f"bins as ({_BINS})",
    f"binned as (select distinct input_set, k.kind, classification, {_IDS}, bin from bounded join bins on (pred_size is null or pred_size between floor(lower) and floor(upper)) and (truth_size is null or truth_size between floor(lower) * 0.5 and floor(upper) / 0.5) join (values ('ALL'), ('DEL'), ('DUP')) k(kind) on k.kind = 'ALL' or k.kind = svtype)",
    "grid as (select * from (select distinct input_set from bounded) s, (values ('ALL'), ('DEL'), ('DUP')) k(svtype), bins)",
    """hist as (select g.input_set, g.svtype, g.bin, sqrt(lower * upper) as x, count(*) filter (where classification = 'TP') as tp, count(*) filter (where classification = 'FP') as fp, count(*) filter (where classification = 'FN') as fn
  from grid g left join binned b on g.input_set = b.input_set and g.svtype = b.kind and g.bin = b.bin group by all)""",
    "ends as (select input_set, kind, classification, c1, c2, c3, c4, min(bin) as first, max(bin) as last from binned group by all)",
    """cum as (select g.input_set, g.svtype, g.bin, upper as x, count(*) filter (where classification = 'TP') as tp, count(*) filter (where classification = 'FP') as fp, count(*) filter (where classification = 'FN') as fn
  from grid g left join ends b on g.input_set = b.input_set and g.svtype = b.kind and b.first <= g.bin group by all)""",
    """ccum as (select g.input_set, g.svtype, g.bin, lower as x, count(*) filter (where classification = 'TP') as tp, count(*) filter (where classification = 'FP') as fp, count(*) filter (where classification = 'FN') as fn
  from grid g left join ends b on g.input_set = b.input_set and g.svtype = b.kind and b.last >= g.bin group by all)""",
    """venn as (select c1, c2, c3, c4, bit_or(mask) as mask from (
    select truth_chrom as c1, truth_start as c2, truth_end as c3, svtype as c4, case input_set when 'intersections' then 4 when 'unions' then 2 else 1 end as mask from bounded where classification = 'TP'
    union all select truth_chrom, truth_start, truth_end, svtype, 0 from bounded where classification = 'FN' and input_set = 'intersections') group by all)""",
    """sizes as (select input_set as source, pred_size as size from bounded where classification <> 'FN'
  union all select 'benchmark', truth_size from bounded where classification <> 'FP' and input_set = 'intersections')""",
    """lifts as (select p.chrom, p.pos, arg_max(case when new_strand = '-' then new_length - 1 - (new_start + pos - block_start) else new_start + pos - block_start end, score * 1000000000 - chain_id) as new_pos
  from (select chrom, cstart as pos from untouched union select chrom, cend from untouched) p join blocks b on b.chrom = p.chrom and pos >= block_start and pos < block_end group by p.chrom, p.pos)""",
    """lifted as (select u.*, s.new_pos as new_start, e.new_pos as new_end,
  case when s.new_pos is null or e.new_pos is null then 'unmapped' when u.cend > u.cstart and 10 * abs((e.new_pos - s.new_pos) - (u.cend - u.cstart)) <= u.cend - u.cstart then 'ok' else 'resized' end as status
  from untouched u left join lifts s on s.chrom = u.chrom and s.pos = u.cstart left join lifts e on e.chrom = u.chrom and e.pos = u.cend)""",
    """logs as (select k.sample, k.svtype, b_c as before_cnvpytor, b_d as before_delly, b_g as before_gatk, coalesce(a_c, 0) as after_cnvpytor, coalesce(a_d, 0) as after_delly, coalesce(a_g, 0) as after_gatk, coalesce(cd, 0) as cnvpytor_delly, coalesce(cg, 0) as cnvpytor_gatk, coalesce(dg, 0) as delly_gatk
  from (select sample, svtype, count(*) filter (where tool = 'cnvpytor') as b_c, count(*) filter (where tool = 'delly') as b_d, count(*) filter (where tool = 'gatk') as b_g from driven group by all) k
  left join (select sample, svtype, count(*) filter (where tool = 'cnvpytor') as a_c, count(*) filter (where tool = 'delly') as a_d, count(*) filter (where tool = 'gatk') as a_g from kept group by all) a on a.sample = k.sample and a.svtype = k.svtype
  left join (select sample, svtype, count(*) filter (where a_tool = 'cnvpytor' and b_tool = 'delly') as cd, count(*) filter (where a_tool = 'cnvpytor' and b_tool = 'gatk') as cg, count(*) filter (where a_tool = 'delly') as dg from pairs group by all) p on p.sample = k.sample and p.svtype = k.svtype)""",
    """changes as (select sample, svtype, caller, before, after, before - after as abs_change, case when before > 0 then (before - after) * 100.0 / before end as pct_change from (
  select sample, svtype, 'cnvpytor' as caller, before_cnvpytor as before, after_cnvpytor as after from logs union all select sample, svtype, 'delly', before_delly, after_delly from logs union all select sample, svtype, 'gatk', before_gatk, after_gatk from logs))""",
    """counts as (select input_set, sample, svtype, count(*) filter (where classification = 'TP') as tp, count(*) filter (where classification = 'FP') as fp, count(*) filter (where classification = 'FN') as fn from cls group by all)""",
]
_WITH = "with " + ",\n".join(_CTES) + "\n"

_CALL_TYPE = "case when upper({0}) in ('DEL', 'DELETION') then 'DEL' when upper({0}) in ('DUP', 'DUPLICATION', 'INS', 'INSERTION') then 'DUP' else 'NA' end"
_RDCN = "case when rdcn is null then 'NA' when rdcn > case when chrom in ('chrX', 'chrY', 'X', 'Y') then {0} else 2.0 end then 'DUP' else 'DEL' end"
_SCORES = "round(case when tp + fp > 0 then tp * 1.0 / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp * 1.0 / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1"


def _filtered(lo: int, hi: int, strict: bool) -> str:
    a, b = (lo, hi) if strict else (lo // 2, hi * 2)
    return f"(pred_size is null or pred_size between {lo} and {hi}) and (truth_size is null or truth_size between {a} and {b})"


def _tally(where: str, by: str) -> str:
    return f"select {by}, count(*) filter (where classification = 'TP') as tp, count(*) filter (where classification = 'FP') as fp, count(*) filter (where classification = 'FN') as fn from cls where {where} group by {by}"


def _summary(name: str, where: str) -> str:
    return f"""select '{name}' as size_class, s.input_set, s.sample, v.svtype, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn
 from (select distinct input_set, sample from cls where input_set <> 'gatk' and {where}) s join (select distinct input_set, svtype from cls where input_set <> 'gatk' and {where}) v on s.input_set = v.input_set
 left join ({_tally(where, "input_set, sample, svtype")}) c on c.input_set = s.input_set and c.sample = s.sample and c.svtype = v.svtype"""


_TRUTH_TYPE = """case when info_svtype is null then 'NA' when contains(upper(info_svtype), 'DEL') then 'DEL' when contains(upper(info_svtype), 'DUP') or contains(upper(info_svtype), 'INS') then 'DUP'
 when contains(upper(info_svtype), 'LINE1') or contains(upper(info_svtype), 'ALU') or contains(upper(info_svtype), 'SVA') then 'DUP'
 when contains(upper(info_svtype), 'CNV') and contains(upper(coalesce(record_id, '')), 'DEL') then 'DEL' when contains(upper(info_svtype), 'CNV') and contains(upper(coalesce(record_id, '')), 'DUP') then 'DUP' else 'NA' end"""

_LIMITS = "select file_id as f, case when list_sort(list(rdcn))[cast(floor(count(*) / 2) as int) + 1] < 1.5 then 1.0 else 2.0 end as top from records where chrom in ('chrX', 'chrY', 'X', 'Y') and rdcn is not null group by 1"
_WAYS = f"""select file_id as f, arg_min(way, (record_no, way)) as method from (select file_id, record_no, alt, i, case when i <> 'NA' then 'info' when a <> 'NA' then 'alt' when rdcn is not null then 'rdcn' else 'info' end as way
    from (select *, {_CALL_TYPE.format('info_svtype')} as i, {_CALL_TYPE.format("trim(alt, '<>')")} as a from records)) where i <> 'NA' or alt <> '.' group by 1"""
_SUMS = "count(*) as n, cast(sum(cstart) as bigint) as starts, cast(sum(cend) as bigint) as ends"
_FIVE = "count({0}) as n, round(quantile_cont({0}, 0.25), 6) as q1, round(quantile_cont({0}, 0.5), 6) as median, round(quantile_cont({0}, 0.75), 6) as q3, round(min({0}), 6) as lowest, round(max({0}), 6) as highest"

_TAIL = {
    "genome_whitelist": "select * from calls where chrom in (select chrom from genome)",
    "svtype_sanitize_calls": f"select distinct record_no, info_svtype, {_CALL_TYPE.format('info_svtype')} as svtype from records",
    "svtype_sanitize_truth": f"select distinct record_no, {_TRUTH_TYPE} as svtype from records",
    "sex_threshold": "select file_id, case when list_sort(list(rdcn))[cast(floor(count(*) / 2) as int) + 1] < 1.5 then 1.0 else 2.0 end as threshold from records where chrom in ('chrX', 'chrY', 'X', 'Y') and rdcn is not null group by file_id",
    "rdcn_svtype": f"select distinct record_no, {_RDCN.format('1.0')} as svtype from records",
    "svtype_method_dispatch": f"""select file_id, method, case method when 'alt' then a when 'rdcn' then {_RDCN.format('coalesce(top, 2.0)')} else i end as svtype, count(*) as n from (
  select *, {_CALL_TYPE.format('info_svtype')} as i, {_CALL_TYPE.format("trim(alt, '<>')")} as a from records) r
  join (select file_id as f, arg_min(way, (record_no, way)) as method from (select file_id, record_no, alt, i, case when i <> 'NA' then 'info' when a <> 'NA' then 'alt' when rdcn is not null then 'rdcn' else 'info' end as way
    from (select *, {_CALL_TYPE.format('info_svtype')} as i, {_CALL_TYPE.format("trim(alt, '<>')")} as a from records)) where i <> 'NA' or alt <> '.' group by 1) w on w.f = r.file_id left join ({_LIMITS}) l on l.f = r.file_id where alt <> '.' group by file_id, method, 3""",
    "vcf_calls_scan": f"""select cast(file_id as varchar) as sample, chrom, svtype, {_SUMS} from (select file_id, chrom, pos - 1 as cstart, coalesce(try_cast(info_end as bigint), pos) as cend,
  case method when 'alt' then a when 'rdcn' then {_RDCN.format('coalesce(top, 2.0)')} else i end as svtype
  from (select *, {_CALL_TYPE.format('info_svtype')} as i, {_CALL_TYPE.format("trim(alt, '<>')")} as a from records) r join ({_WAYS}) w on w.f = r.file_id left join ({_LIMITS}) l on l.f = r.file_id where alt <> '.') group by file_id, chrom, svtype""",
    "vcf_truth_scan": f"""select 'F' || file_id as sample, c as chrom, svtype, allele_a || '/' || allele_b as genotype, coalesce(record_id, '.') as id, {_SUMS} from (
  select *, case when starts_with(chrom, 'chr') then chrom else 'chr' || chrom end as c, pos - 1 as cstart, coalesce(try_cast(info_end as bigint), pos + abs(try_cast(info_svlen as bigint))) as cend, {_TRUTH_TYPE} as svtype from records where alt <> '.')
  where c in (select chrom from genome) and svtype <> 'NA' and cend is not null and (allele_a <> 0 or allele_b <> 0) group by file_id, c, svtype, allele_a, allele_b, record_id""",
    "vcf_header_samples": "select distinct 'F' || file_id as sample from records",
    "array_calls_scan": f"""select 'S' || file_id as sample, chrom, svtype, {_SUMS} from (select file_id, chrom, pos as cstart, pos + 70 as cend, case when floor(rdcn) <= 1 then 'DEL' when floor(rdcn) >= 3 then 'DUP' end as svtype from records where rdcn is not null and starts_with(chrom, 'chr'))
  where svtype is not null group by file_id, chrom, svtype""",
    "chain_scan": """select chain_id, score, chrom, block_start, block_start + 40000 as block_end, 'q' || chrom as new_chrom, new_start, new_strand, new_length from blocks
  union all select chain_id, score, chrom, block_start + 40010, block_end, 'q' || chrom, new_start + 40020, new_strand, new_length from blocks""",
    "bed_roundtrip": "select tool, sample, chrom, cstart, cend, svtype from driven",
    "classified_roundtrip": "select classification, input_set, sample, svtype, pred_chrom, pred_start, pred_end, sources, truth_chrom, truth_start, truth_end, pred_size, truth_size from cls",
    "log_roundtrip": "select * from logs",
    "genome_scan": "select chrom, length, cast(row_number() over (order by ord) as int) as place from genome",
    "venn3_shares": "select right('000' || bin(m), 3) as region, case when m & 4 > 0 then round(n * 100.0 / a, 6) end as pct_1, case when m & 2 > 0 then round(n * 100.0 / b, 6) end as pct_2, case when m & 1 > 0 then round(n * 100.0 / c, 6) end as pct_3 from (select m, (select count(*) from venn where mask = m) as n, (select count(*) from venn where mask & 4 > 0) as a, (select count(*) from venn where mask & 2 > 0) as b, (select count(*) from venn where mask & 1 > 0) as c from range(1, 8) r(m))",
    "benchmark_sizes": "select 'benchmark' as source, svtype, truth_size as size, count(*) as n from bounded where classification <> 'FP' and input_set = 'intersections' group by svtype, truth_size",
    "excluded_abs_change_box": f"select caller, {_FIVE.format('abs_change')} from changes group by caller",
    "liftover_box": f"select svtype, {_FIVE.format('pct')} from (select sample, svtype, count(*) filter (where status = 'ok') * 100.0 / count(*) as pct from lifted group by all) group by svtype",
    "penncnv_cn_svtype": "select cast(floor(rdcn) as int) as cn, case when floor(rdcn) <= 1 then 'DEL' else 'DUP' end as svtype, count(*) as n from records where rdcn is not null and floor(rdcn) <> 2 group by all",
    "genotype_carrier": "select allele_a || '/' || allele_b as genotype, allele_a <> 0 or allele_b <> 0 as carrier, allele_a > 0 or allele_b > 0 as carrier_strict, count(*) as n from records group by all",
    "end_fallback": "select distinct record_no, coalesce(try_cast(info_end as bigint), pos) as call_end, coalesce(try_cast(info_end as bigint), pos + abs(try_cast(info_svlen as bigint))) as truth_end from records",
    "chr_prefix": "select distinct chrom, case when starts_with(chrom, 'chr') then chrom else 'chr' || chrom end as prefixed from records",
    "display_names": "select distinct tool, case tool when 'delly' then 'Delly 2' when 'gatk' then 'GATK' else tool end as display, 'my_' || tool as source from calls",
    "consensus_sources": "select sample, svtype, array_to_string(list_sort(list_distinct(flatten(list([a_tool, b_tool])))), '|') as sources from pairs group by sample, svtype",
    "excluded_antijoin": "select * from untouched c where not exists (select 1 from regions r where r.chrom = c.chrom and 2 * (least(c.cend, r.cend) - greatest(c.cstart, r.cstart)) >= c.cend - c.cstart)",
    "reciprocal_pairs_clipped": "select sample, svtype, chrom, cstart, cend, array_to_string(src, ',') as sources from clips",
    "reciprocal_pairs_full": "select sample as a_sample, svtype as a_svtype, chrom as a_chrom, a_tool, a_cstart, a_cend, b_tool, b_cstart, b_cend from pairs",
    "consensus_intersection": "select * from inter",
    "consensus_union": "select * from unions",
    "consensus_combined_sorted": "select i.* from inter i left join genome g on g.chrom = i.chrom order by g.ord, i.chrom, cstart, cend",
    "consensus_log": "select * from logs",
    "excluded_change_rows": "select sample, svtype, caller, before, after, abs_change, round(pct_change, 6) as pct_change from changes",
    "excluded_change_means": "select caller, round(avg(abs_change), 6) as abs_change, round(avg(pct_change), 6) as pct_change from changes group by caller",
    "excluded_change_box": """select caller, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(min(pct_change), 6) as whisker_low, round(max(pct_change), 6) as whisker_high, round(lowest, 6) as lowest, round(highest, 6) as highest
  from changes join (select caller as c, count(pct_change) as n, quantile_cont(pct_change, 0.25) as q1, quantile_cont(pct_change, 0.5) as median, quantile_cont(pct_change, 0.75) as q3, min(pct_change) as lowest, max(pct_change) as highest from changes group by 1) q
  on q.c = caller and pct_change between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all""".replace("group by all", "group by caller, n, q1, median, q3, lowest, highest"),
    "interval_complement": """select chrom, cast(a as bigint) as cstart, cast(b as bigint) as cend from (
  select g.chrom, coalesce(max(cend) over (partition by g.chrom order by cstart rows between unbounded preceding and 1 preceding), 0) as a, cstart as b from genome g join regions r on r.chrom = g.chrom where cstart < length
  union all select g.chrom, coalesce(max(cend), 0), length from genome g left join regions r on r.chrom = g.chrom and r.cstart < length group by g.chrom, length) where a < b""",
    "bucketed_overlap_join": f"select a.sample as a_sample, a.svtype as a_svtype, a.chrom as a_chrom, a.cstart as a_cstart, a.cend as a_cend, b.cstart as b_cstart, b.cend as b_cend from kept a join kept b on a.sample = b.sample and a.svtype = b.svtype and a.chrom = b.chrom and a.tool = 'delly' and b.tool = 'gatk' and {_AB} > 0",
    "genome_sort": "select r.* from regions r left join genome g on g.chrom = r.chrom order by g.ord nulls last, r.chrom, cstart, cend",
    "common_samples": "select * from common",
    "control_samples_of_interest": "select sample, count(*) as n from calls where tool = 'gatk' and sample in (select sample from inter) group by sample",
    "truth_counts": "select bench, sample, count(*) as n_all, count(*) filter (where svtype = 'DEL') as n_del, count(*) filter (where svtype = 'DUP') as n_dup from truth group by bench, sample",
    "truth_merged": "select * from merged",
    "truth_merge_log": "select sample, svtype, bench as source, count(*) as n from truth group by all union all select sample, svtype, 'merged', count(*) from merged group by all",
    "liftover_points": "select * from lifts",
    "liftover_size_filter": "select sample, tool, svtype, chrom, cstart, cend, new_start, new_end from lifted where status = 'ok'",
    "liftover_log": """select sample, svtype, before, after, failed_liftover, failed_size_change, round(after * 100.0 / before, 6) as pct_succeeded, round(failed_liftover * 100.0 / before, 6) as pct_failed_liftover, round(failed_size_change * 100.0 / before, 6) as pct_failed_size_change
  from (select sample, svtype, count(*) as before, count(*) filter (where status = 'ok') as after, count(*) filter (where status = 'unmapped') as failed_liftover, count(*) filter (where status = 'resized') as failed_size_change from lifted group by all)""",
    "tp": "select * exclude (classification) from cls where classification = 'TP'",
    "fp": "select input_set, sample, svtype, pred_chrom, pred_start, pred_end, sources, pred_size from cls where classification = 'FP'",
    "fn": "select input_set, sample, svtype, truth_chrom, truth_start, truth_end, truth_size from cls where classification = 'FN'",
    "classification_counts": "select * from counts",
    "precision_recall_f1": f"select input_set, sample, svtype, tp, fp, fn, {_SCORES} from counts",
    "size_filter_strict": _tally(_filtered(10_000, 100_000, True), "input_set, svtype"),
    "size_filter_relaxed": _tally(_filtered(10_000, 100_000, False), "input_set, svtype"),
    "summary_by_size_class": f"select size_class, input_set, sample, svtype, tp, fp, fn, {_SCORES} from ({_summary('all', 'true')} union all {_summary('10k-100k', _filtered(10_000, 100_000, False))} union all {_summary('100k-1M', _filtered(100_000, 1_000_000, False))})",
    "size_bins": """select kind, cast(i as int) as bin, round(case kind when 'cumulative' then 500 else pow(10.0, log10(500.0) + i * w) end, 4) as lower, round(case kind when 'complementary_cumulative' then 1000000 else pow(10.0, log10(500.0) + (i + 1) * w) end, 4) as upper
  from range(99) r(i), (values ('histogram'), ('cumulative'), ('complementary_cumulative')) k(kind), (select (log10(1000000.0) - log10(500.0)) / 99 as w)""",
    "dist_histogram": "select input_set, svtype, bin, round(x, 4) as x, tp, fp, fn from hist",
    "dist_cumulative": "select input_set, svtype, bin, round(x, 4) as x, tp, fp, fn from cum",
    "dist_comp_cumulative": "select input_set, svtype, bin, round(x, 4) as x, tp, fp, fn from ccum",
    "dist_metrics": f"select input_set, svtype, dist_type, bin, {_SCORES} from (select 'histogram' as dist_type, * from hist union all select 'cumulative', * from cum union all select 'complementary_cumulative', * from ccum)",
    "gaussian_smooth": f"""select h.input_set, h.svtype, h.bin, round(sum(w * y.v), 6) as smooth_recall from hist h, (select k, exp(-0.5 * (k / 5.0) * (k / 5.0)) / sum(exp(-0.5 * (k / 5.0) * (k / 5.0))) over () as w from range(-20, 21) r(k)) g,
  (select input_set, svtype, bin, case when tp + fn > 0 then tp * 1.0 / (tp + fn) else 0 end as v from hist) y
  where y.input_set = h.input_set and y.svtype = h.svtype and y.bin = case when (h.bin + k + {4 * (POINTS - 1)}) % {2 * (POINTS - 1)} < {POINTS - 1} then (h.bin + k + {4 * (POINTS - 1)}) % {2 * (POINTS - 1)} else {2 * (POINTS - 1) - 1} - (h.bin + k + {4 * (POINTS - 1)}) % {2 * (POINTS - 1)} end group by all""".replace("group by all", "group by h.input_set, h.svtype, h.bin"),
    "venn3_regions": "select right('000' || bin(m), 3) as region, (select count(*) from venn where mask = m) as n, (select count(*) from venn where mask > 0) as detected, (select count(*) from venn) as truth from range(1, 8) r(m)",
    "venn3_percentages": "select right('000' || bin(m), 3) as region, round(n * 100.0 / d, 6) as pct_detected, round(n * 100.0 / t, 6) as pct_truth from (select m, (select count(*) from venn where mask = m) as n, (select count(*) from venn where mask > 0) as d, (select count(*) from venn) as t from range(1, 8) r(m))",
    "venn3_methods": "select s as input_set, n, round(n * 100.0 / d, 6) as pct_detected, round(n * 100.0 / t, 6) as pct_truth from (select s, (select count(*) from venn where c4 = 'DEL' and mask & b > 0) as n, (select count(*) from venn where c4 = 'DEL' and mask > 0) as d, (select count(*) from venn where c4 = 'DEL') as t from (values ('intersections', 4), ('unions', 2), ('gatk', 1)) v(s, b))",
    "size_histogram_log": """select source, bin, round(pow(10, a + bin * w), 3) as lower, round(pow(10, a + (bin + 1) * w), 3) as upper, n, round(n / (sum(n) over (partition by source) * w), 6) as density from (
  select source, cast(least(floor((log10(size) - a) / w), 39) as int) as bin, any_value(a) as a, any_value(w) as w, count(*) as n from sizes, (select min(log10(size)) as a, (max(log10(size)) - min(log10(size))) / 40 as w from sizes) group by 1, 2)""",
    "size_kde": """select source, point, round(pow(10, g), 3) as size, round(sum(c * exp(-0.5 * ((g - x) / h) * ((g - x) / h))) / (n * h * 2.5066282746310002), 6) as density from (
  select source, x, c, n, h, cast(i as int) as point, lo - 3 * h + i * (hi - lo + 6 * h) / 199 as g from (select source, log10(size) as x, count(*) as c from sizes group by 1, 2) d
  join (select source as s, count(*) as n, min(log10(size)) as lo, max(log10(size)) as hi, stddev_samp(log10(size)) * pow(count(*), -0.2) as h from sizes group by 1) q on q.s = d.source, range(200) r(i)) group by source, point, g, n, h""",
    "caller_raw_pct": """select input_set, sample, svtype, caller as caller_or_combination, round(count(*) * 100.0 / n, 6) as percentage from (
  select input_set, sample, svtype, unnest(string_split(sources, '|')) as caller, count(*) over (partition by input_set, sample, svtype) as n from bounded where classification = 'TP' and input_set <> 'gatk') group by input_set, sample, svtype, caller, n""",
    "caller_combo_pct": """select input_set, sample, svtype, sources as caller_or_combination, round(count(*) * 100.0 / n, 6) as percentage from (
  select *, count(*) over (partition by input_set, sample, svtype) as n from bounded where classification = 'TP' and input_set <> 'gatk') group by input_set, sample, svtype, sources, n""",
    "entity_sort": "select distinct sources as caller_or_combination from unions",
    "shared_samples": "select input_set, count(*) filter (where classification = 'TP') as tp, count(*) filter (where classification = 'FP') as fp, count(*) filter (where classification = 'FN') as fn from cls where sample in (select sample from cls group by sample having count(distinct input_set) = (select count(distinct input_set) from cls)) group by input_set",
}


def oracle_sql() -> dict[str, str]:
    return {k: _WITH + v for k, v in _TAIL.items()}
