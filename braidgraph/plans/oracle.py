"""The catalogue's queries as DuckDB SQL, written independently of the DataFrame code."""

from __future__ import annotations

# common tables, by the names that the queries use
CTE = {
    "seg": "select p_partkey + 1 as node_id, p_name as name, cast(p_size as bigint) as len from part",
    "pstep": """select l_orderkey as trav,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as pos,
        case when l_returnflag = 'R' then -(l_partkey + 1) else l_partkey + 1 end as snode from lineitem""",
    "pmeta": """select o_orderkey as trav, 'N' || c_nationkey as sample, 'N' || c_nationkey || '#' || (o_custkey % 2 + 1) as hap,
        'N' || c_nationkey || '#' || (o_custkey % 2 + 1) || '#ord' || o_orderkey as name from orders join customer on o_custkey = c_custkey""",
    "ev": "select user_id, event_type, event_id, cast(json_extract_string(props, '$.k') as bigint) + 1 as node_id from events",
    "wstep": "select user_id, event_type, row_number() over (partition by user_id, event_type order by event_id) - 1 as pos, node_id as snode from ev",
    "wmeta": """select user_id, event_type, 'U' || user_id as sample_id, cast(0 as bigint) as hap_index, event_type as seq_id,
        case when user_id % 5 <> 0 then cast(0 as bigint) end as seq_start, case when user_id % 5 <> 0 then cast(sum(len) as bigint) end as seq_end
        from ev join seg using (node_id) group by user_id, event_type""",
    "link": "select distinct a, b from (select snode as a, lead(snode) over (partition by trav order by pos) as b from pstep) where b is not null",
    "member": "select distinct sample as grp, abs(snode) as node_id from pstep join pmeta using (trav)",
    "memberh": "select distinct hap as grp, abs(snode) as node_id from pstep join pmeta using (trav)",
    "memberw": "select distinct user_id || '/' || event_type as grp, snode as node_id from wstep",
    "offs": """select trav, pos, node_id, cast(e - len as bigint) as node_start, cast(e as bigint) as node_end from
        (select trav, pos, node_id, len, sum(len) over (partition by trav order by pos) as e from (select trav, pos, abs(snode) as node_id from pstep) join seg using (node_id))""",
    "total": "select trav, max(node_end) as total from offs group by trav",
    "refs": "select trav, total from total",
    "bed": """select trav * 4294967296 + w as wid, trav, name as chrom, w * 25 as "start", w * 25 + 25 as "end", name || ':' || w as name from
        (select trav, unnest(range(0, cast((total - 1) // 25 as bigint) + 1)) as w from refs) join pmeta using (trav)""",
    "hit": """select distinct wid, node_id from bed join offs using (trav) where "end" > node_start and "start" < node_end""",
    "rawmer": "select user_id, event_type, pos, snode as a, lead(snode) over (partition by user_id, event_type order by pos) as b from wstep",
    "mer": """select user_id, event_type, pos, a, b, least(a * 4294967296 + (b & 4294967295), (-b) * 4294967296 + ((-a) & 4294967295)) as kmer from rawmer where b is not null""",
}


def needs(sql: str) -> list[str]:
    """The common tables that a statement uses, in order of definition."""
    import re

    names, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for n in CTE:
            if n not in names and re.search(rf"\b{n}\b", text):
                names.add(n)
                todo.append(CTE[n])
    return [n for n in CTE if n in names]


def full(sql: str) -> str:
    used = needs(sql)
    inner = sql.lstrip()
    head = ", ".join(f"{n} as ({CTE[n]})" for n in used)
    if not head:
        return sql
    return f"with {head}, {inner[5:]}" if inner.startswith("with ") else f"with {head} {inner}"


def curve(member: str, groups: str, digits: bool = True) -> str:
    """Expected growth from (grp, node_id) and the number of groups."""
    value = "round(g, 4) as growth" if digits else "g"
    return f"""with n as (select {groups} as n), cov as (select node_id, count(*) as c from {member} join seg using (node_id) group by node_id),
        hist as (select c, count(*) as h from cov group by c), ks as (select unnest(range(1, n + 1)) as k, n from n),
        cells as (select k, h * case when c >= n or n - c < k then 1.0 else 1.0 - exp(list_sum(list_transform(range(0, c), lambda i: ln(cast(n - k - i as double) / (n - i))))) end as x from ks, hist),
        sums as (select k, sum(x) as g from cells group by k)
        select k, {value} from (select ks.k, coalesce(sums.g, 0.0) as g from ks left join sums using (k))"""


def ratio(member: str, groups: str) -> str:
    return f"""select b.wid, g.grp, coalesce(num, 0) as num, coalesce(den, 0) as den, case when coalesce(den, 0) = 0 then 0.0 else coalesce(num, 0) / cast(den as double) end as pav
        from bed b cross join (select distinct {groups} as grp from pmeta) g
        left join (select wid, cast(sum(len) as bigint) as den from hit join seg using (node_id) group by wid) d on b.wid = d.wid
        left join (select wid, grp, cast(sum(len) as bigint) as num from hit join seg using (node_id) join {member} using (node_id) group by wid, grp) x on b.wid = x.wid and g.grp = x.grp"""


P_TOKENS = "string_agg(abs(snode) || case when snode < 0 then '-' else '+' end, ',' order by pos)"
W_TOKENS = "string_agg(case when snode < 0 then '<' else '>' end || abs(snode), '' order by pos)"
WALK_LINE = f"""select 'W' || chr(9) || sample_id || chr(9) || hap_index || chr(9) || seq_id || chr(9) || coalesce(cast(seq_start as varchar), '*') || chr(9) || coalesce(cast(seq_end as varchar), '*') || chr(9) || toks as line
    from wmeta join (select user_id, event_type, {W_TOKENS} as toks from wstep group by user_id, event_type) using (user_id, event_type)"""
ODD = """select o_orderkey as trav, case o_orderkey % 8 when 0 then n when 1 then n || '#1' when 2 then n || '#1#ord' || o_orderkey || ':0-100' when 3 then n || '#'
    when 4 then n || '##q' || o_orderkey when 5 then n || '#1#' when 6 then n || ':3-9' else n || '#2:4-8' end as name, n, o_orderkey % 8 as f from (select *, 'N' || (o_custkey % 25) as n from orders)"""
#: One round of rules over the walks: places where a repeated pair stands, islands of them, every second place taken.
ROUND = """rep as (select kmer from mer {where} group by kmer having count(*) >= 2),
    cand as (select m.*, row_number() over (partition by user_id, event_type order by pos) as rn from mer m join rep using (kmer) {which}),
    isl as (select *, row_number() over (partition by user_id, event_type, pos - rn order by pos) as k from cand),
    pick as (select * from isl where k % 2 = 1)"""
RULES = """base as (select max(node_id) as m from ev),
    rules as (select kmer, (select m from base) + row_number() over (order by kmer) as rule_id, kmer // 4294967296 - case when kmer < 0 and kmer % 4294967296 <> 0 then 1 else 0 end as first,
        case when (kmer & 4294967295) > 2147483647 then (kmer & 4294967295) - 4294967296 else kmer & 4294967295 end as second from (select distinct kmer from pick))"""
ROUND_ALL = ROUND.format(where="", which="") + ", " + RULES
CODED = """sym as (select w.user_id, w.event_type, w.pos, case when p.kmer is null then w.snode when p.a * 4294967296 + (p.b & 4294967295) = p.kmer then r.rule_id else -r.rule_id end as snode,
        p.kmer is not null as is_rule from wstep w left join pick p on w.user_id = p.user_id and w.event_type = p.event_type and w.pos = p.pos left join rules r on p.kmer = r.kmer {which}),
    kept as (select * from (select *, lag(is_rule, 1, false) over (partition by user_id, event_type order by pos) as gone from sym) where not gone),
    coded as (select user_id, event_type, row_number() over (partition by user_id, event_type order by pos) - 1 as pos, snode from kept)"""

PLAIN = {
    "node_coverage": "select s.node_id, count(m.grp) as coverage from seg s left join member m using (node_id) group by s.node_id",
    "coverage_hist": """with cov as (select s.node_id, count(m.grp) as c from seg s left join member m using (node_id) group by s.node_id), bins as (select unnest(range(0, (select count(distinct sample) from pmeta) + 1)) as c)
        select bins.c, count(cov.node_id) as n_nodes from bins left join cov using (c) group by bins.c""",
    "growth_sample": curve("member", "(select count(distinct sample) from pmeta)"),
    "growth_sample_hap": curve("memberh", "(select count(distinct hap) from pmeta)"),
    "growth_sample_hap_seq": curve("memberw", "(select count(*) from wmeta)"),
    "growth_path": curve("memberw", "(select count(*) from wmeta)"),
    "growth_lines": "with g as (" + curve("member", "(select count(distinct sample) from pmeta)", False) + ") select k, k || chr(9) || printf('%.4f', g) as line from g",
    "growth_summary": """select mode, n as num_haplotypes, (select count(*) from seg) as num_nodes from (select 'sample' as mode, count(distinct sample) as n from pmeta
        union all select 'sample-hap', count(distinct hap) from pmeta union all select 'sample-hap-seq', count(distinct name) from pmeta)""",
    "haplotype_groups": "select trav, sample, hap as sample_hap, name as sample_hap_seq from pmeta",
    "slice_nodes": "select distinct trav, abs(snode) as node_id from pstep",
    "group_nodes": "select grp, node_id from member",
    "node_groups": "select node_id, string_agg(grp, ',' order by grp) as grps from member group by node_id",
    "all_slices": """select 'P' as kind, name, count(*) as n_steps from pstep join pmeta using (trav) group by name
        union all select 'W', sample_id || '#0#' || seq_id, count(*) from wstep join wmeta using (user_id, event_type) group by sample_id, seq_id""",
    "pansn_parse": f"""select trav, name, n as sample, case when f in (1, 2, 5) then '1' when f = 7 then '2' end as hap, case when f = 2 then 'ord' || trav end as seq,
        n || '#' || case when f in (1, 2, 5) then '1' when f = 7 then '2' else '' end as sample_hap, case when f in (1, 5) then n || '#1' when f = 7 then n || '#2' when f = 2 then n || '#1#ord' || trav else n end as sample_hap_seq from ({ODD})""",
    "pansn_parse_pav": f"""select trav, name, n as sample, case when f in (1, 2, 5) then '1' when f = 7 then '2' end as hap, case when f = 2 then 'ord' || trav when f = 4 then 'q' || trav end as seq,
        case when f in (1, 2, 5) then n || '#1' when f = 7 then n || '#2' else n end as sample_hap, case when f in (1, 5) then n || '#1' when f = 7 then n || '#2' when f = 2 then n || '#1#ord' || trav else n end as sample_hap_seq from ({ODD})""",
    "node_offsets": "select trav, pos, node_id, node_start, node_end from offs",
    "bed_tiles": 'select wid, chrom, "start", "end", name from bed',
    "bed_resolve": "select wid, chrom, p.trav from bed join pmeta p on chrom = p.name",
    "interval_overlap": "select wid, node_id from hit",
    "pav_long": f"select wid, grp, num, den, round(pav, 6) as pav from ({ratio('member', 'sample')})",
    "pav_haplotype": f"select wid, grp, num, den, round(pav, 6) as pav from ({ratio('memberh', 'hap')})",
    "pav_binary": f"select wid, grp, cast(pav >= 0.5 as integer) as pav from ({ratio('member', 'sample')})",
    "pav_matrix": "select wid, " + ", ".join(f"max(case when grp = 'N{i}' then round(pav, 6) end) as N{i}" for i in range(25)) + f" from ({ratio('member', 'sample')}) group by wid",
    "pav_groups": "select trav, sample, hap as sample_hap, name as sample_hap_seq from pmeta",
    "walk_names": "select sample_id, seq_id, sample_id || '#0#' || seq_id || case when seq_end is null then '' else ':' || seq_start || '-' || seq_end end as name from wmeta",
    "extract_path": f"select cast(0 as bigint) as req_idx, 'P' || chr(9) || name || chr(9) || {P_TOKENS} || chr(9) || '*' as line from pstep join pmeta using (trav) where name = (select min(name) from pmeta) group by name",
    "extract_path_batch": f"select -trav as req_idx, 'P' || chr(9) || name || chr(9) || coalesce(toks, '') || chr(9) || '*' as line from pmeta left join (select trav, {P_TOKENS} as toks from pstep group by trav) using (trav)",
    "extract_walk": WALK_LINE,
    "extract_walk_by_name": f"{WALK_LINE} where seq_id = 'click'",
    "duplicate_names": "select name, count(*) as n from seg group by name having count(*) > 1",
    "sample_names": "select name, md5('7:' || name) as h from pmeta order by h limit 20",
    "delta_encode": "select trav, pos, snode - coalesce(lag(snode) over (partition by trav order by pos), 0) as snode from pstep",
    "delta_encode_2": """with d as (select trav, pos, snode - coalesce(lag(snode) over (partition by trav order by pos), 0) as s from pstep)
        select trav, pos, s - coalesce(lag(s) over (partition by trav order by pos), 0) as snode from d""",
    "delta_roundtrip": "select trav, pos, snode from pstep",
    "max_abs_symbol": "select max(abs(d)) as max_abs from (select snode - coalesce(lag(snode) over (partition by trav order by pos), 0) as d from pstep)",
    "two_mers": "select user_id, event_type, pos, a, b, kmer from mer",
    "repeated_2mers": "select kmer, count(*) as n from mer group by kmer having count(*) >= 2",
    "flatten_lengths": 'select trav, len, cast(coalesce(sum(len) over (order by trav rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from (select trav, count(*) as len from pstep group by trav)',
    "strings_reconstruct": "select p_brand, p_type, row_number() over (partition by p_brand, p_type order by p_partkey) - 1 as idx, p_name as part from part",
    "grammar_round": f"with {ROUND_ALL}, {CODED.format(which='')} select user_id, event_type, pos, snode from coded",
    "rule_column_delta": f"with {ROUND_ALL} select rule_id, first - coalesce(lag(first) over (order by rule_id), 0) as first, second - coalesce(lag(second) over (order by rule_id), 0) as second from rules",
    "grammar_expand": "select user_id, event_type, pos, snode from wstep",
    "grammar_multi_round": "select user_id, event_type, pos, snode from wstep",
    "grammar_reduction": f"""with {ROUND_ALL}, {CODED.format(which='')} select (select count(*) from wstep) as n_before, (select count(*) from coded) as n_after, (select count(*) from rules) as n_rules,
        round((select count(*) from coded) / cast((select count(*) from wstep) as double), 6) as share""",
    "append_encode": f"""with {ROUND.format(where="where event_type <> 'purchase'", which="where event_type <> 'purchase'").replace("rep as", "rep0 as").replace("join rep using", "join rep0 using").replace("cand", "cand0").replace("isl ", "isl0 ").replace("from isl", "from isl0").replace("pick as", "pick0 as").replace("isl00", "isl0")},
        {RULES.replace("from pick", "from pick0")},
        cand as (select m.*, row_number() over (partition by user_id, event_type order by pos) as rn from mer m join rules using (kmer) where event_type = 'purchase'),
        isl as (select *, row_number() over (partition by user_id, event_type, pos - rn order by pos) as k from cand), pick as (select * from isl where k % 2 = 1),
        {CODED.format(which="where w.event_type = 'purchase'")} select user_id, event_type, pos, snode from coded""",
    "append_paths": """select trav, name from pmeta where name like '%#1#%' union all
        select (select max(trav) + 1 from pmeta where name like '%#1#%') + row_number() over (order by name) - 1, name from pmeta where name like '%#2#%'""",
    "append_walks": """select user_id * 100 as trav, sample_id, hap_index, seq_id, coalesce(seq_start, -1) as seq_start, coalesce(seq_end, -1) as seq_end from wmeta where seq_id <> 'purchase' union all
        select (select max(user_id) * 100 + 1 from wmeta where seq_id <> 'purchase') + row_number() over (order by sample_id, seq_id) - 1, sample_id, hap_index, seq_id, coalesce(seq_start, -1), coalesce(seq_end, -1) from wmeta where seq_id = 'purchase'""",
    "append_conflicts": """select name, 'repeated' as reason from seg where len > 25 group by name having count(*) > 1 union all
        select distinct name, 'exists' from seg where len > 25 and name in (select name from seg where len <= 25)""",
    "tail_split": "select trav as line_no, name as line, case when row_number() over (order by trav desc) <= 10 then 'tail' else 'head' end as part from pmeta",
    "dangling_filter": "select a, b from link where abs(a) in (select node_id from seg where len <= 25) and abs(b) in (select node_id from seg where len <= 25)",
    "render_gfa_lines": f"""select 'S' || chr(9) || 'n' || (p_partkey + 1) || chr(9) || repeat('A', p_size) || chr(9) || 'BZ:Z:' || p_brand || chr(9) || 'PR:f:' || printf('%.6g', p_retailprice) || chr(9) || 'TY:Z:' || p_type as line from part
        union all select 'L' || chr(9) || 'n' || abs(a) || chr(9) || case when a < 0 then '-' else '+' end || chr(9) || 'n' || abs(b) || chr(9) || case when b < 0 then '-' else '+' end || chr(9) || '0M' from link
        union all select 'P' || chr(9) || name || chr(9) || coalesce(toks, '') || chr(9) || '*' from pmeta left join (select trav, {P_TOKENS.replace("abs(snode)", "'n' || abs(snode)")} as toks from pstep group by trav) using (trav)""",
    "scan_gfa_roundtrip": "select name, pos, snode from pstep join pmeta using (trav)",
    "path_parse_explode": "select name, pos, abs(snode) as node_id, snode < 0 as reverse from pstep join pmeta using (trav)",
    "walk_parse_explode": "select sample_id, seq_id, coalesce(seq_start, -1) as seq_start, coalesce(seq_end, -1) as seq_end, pos, snode as node_id, false as reverse from wstep join wmeta using (user_id, event_type)",
    "link_parse": """select o_orderkey, o as overlap, case when o in ('*', '') then 0 else coalesce(try_cast(regexp_extract(o, '^([0-9]*)', 1) as bigint), 0) end as overlap_num,
        case when o in ('*', '') then null else nullif(regexp_extract(o, '^[0-9]*(.?)', 1), '') end as overlap_op from (select o_orderkey, (['*', '', '5', '12M', '3M2I', 'M', '0M', '7='])[o_orderkey % 8 + 1] as o from orders)""",
    "seg_dictionary": """select row_number() over (order by k) as node_id, name, len as seq_len from (select replace(p_name, ' ', '_') as name, min(p_partkey) as k, cast(arg_min(p_size, p_partkey) as bigint) as len from part group by 1)""",
    "tag_pivot": "select p_partkey, p_brand as bz, cast(p_size as bigint) as sz, p_type as ty from part",
    "tag_render": "select p_partkey, 'BZ:Z:' || p_brand || chr(9) || 'PR:f:' || printf('%.6g', cast(round(p_retailprice * 100) as bigint) / 100.0) || chr(9) || 'SZ:i:' || p_size as tags from part",
    "graph_summary": """select 'segments' as record, count(*) as n from seg union all select 'steps', (select count(*) from pstep) + (select count(*) from wstep) union all
        select 'paths', count(*) from pmeta union all select 'walks', count(*) from wmeta union all select 'links', count(*) from link""",
    "dense_name_stats": """select count(*) as n_segments, count(*) filter (where n = cast(node_id as varchar)) as n_dense, round(count(*) filter (where n = cast(node_id as varchar)) / cast(count(*) as double), 6) as share
        from (select node_id, case when len > 25 then name else cast(node_id as varchar) end as n from seg)""",
    "column_size_stats": """select 'segments' as tbl, 'node_id' as col, count(*) * 8 as bytes from seg union all select 'segments', 'name', cast(sum(strlen(name)) as bigint) from seg union all select 'segments', 'seq_len', count(*) * 8 from seg
        union all select 'steps', 'trav', count(*) * 8 from pstep union all select 'steps', 'pos', count(*) * 8 from pstep union all select 'steps', 'snode', count(*) * 8 from pstep
        union all select 'paths', 'trav', count(*) * 8 from pmeta union all select 'paths', 'name', cast(sum(strlen(name)) as bigint) from pmeta union all select 'paths', 'overlaps', cast(0 as bigint)""",
    "orient_bitpack": "select trav, pos // 8 as byte_idx, cast(sum(case when snode < 0 then 1 << cast(pos % 8 as integer) else 0 end) as bigint) as byte from pstep group by trav, pos // 8",
    "varint_sizes": """with d as (select trav, snode - coalesce(lag(snode) over (partition by trav order by pos), 0) as d from pstep), z as (select trav, case when d < 0 then -2 * d - 1 else 2 * d end as z from d)
        select trav, count(*) as n, cast(sum(case when z < 128 then 1 when z < 16384 then 2 when z < 2097152 then 3 when z < 268435456 then 4 else 5 end) as bigint) as bytes from z group by trav""",
    "verify_equal": "select side, count(*) filter (where name like '%#2#%') as n from pmeta, (values ('left'), ('right')) v(side) group by side",
    "header_scan": "select 'H' || chr(9) || 'VN:Z:' || max(o_orderkey) as line from orders",
    "jump_parse": """select row_number() over (order by o_orderkey) - 1 as jump_idx, o_orderkey % 50 + 1 as from_id, '+' as from_orient, o_orderkey % 7 + 1 as to_id, '-' as to_orient,
        case when o_orderkey % 3 = 0 then '*' else cast(o_orderkey as varchar) end as distance, 'SC:i:1' || chr(9) || 'XX:Z:y' as rest from orders where o_orderkey % 50 + 1 in (select node_id from seg where len > 25) and o_orderkey % 7 + 1 in (select node_id from seg where len > 25)""",
    "containment_parse": """select row_number() over (order by o_orderkey) - 1 as containment_idx, o_orderkey % 50 + 1 as container_id, '+' as container_orient, o_orderkey % 7 + 1 as contained_id, '-' as contained_orient,
        o_orderkey as pos, '5M' as overlap, 'ID:Z:q' as rest from orders where o_orderkey % 50 + 1 in (select node_id from seg where len > 25) and o_orderkey % 7 + 1 in (select node_id from seg where len > 25)""",
    "bed_parse": """select o_orderkey as line_no, 'c' || o_orderkey as chrom, cast(case f when 0 then 5 when 1 then 7 when 4 then 9 else -1 end as bigint) as "start", cast(case f when 0 then 9 when 1 then 8 else 5 end as bigint) as "end",
        case f when 0 then 'n' || o_orderkey when 1 then 'c' || o_orderkey || ':7-8' when 4 then 'r' else '' end as name, f in (0, 1) as ok from (select o_orderkey, o_orderkey % 6 as f from orders) where f not in (2, 3)""",
    "appendix_check": "select o_orderkey, o_orderkey % 6 = 0 as is_path, o_orderkey % 6 = 3 as is_walk from orders",
    "number_prefix": "select o_orderkey, case o_orderkey % 4 when 2 then -o_orderkey when 3 then -999 else o_orderkey end as n from orders",
    "tag_conflicts": "select 'AA' as tag, 'Z,i' as types where (select count(distinct p_size > 10) from part) = 2 union all select 'CC', 'q' where exists (select 1 from part)",
    "render_streamed": f"""select 1 as section, 'S' || chr(9) || (p_partkey + 1) || chr(9) || repeat('A', p_size) || chr(9) || 'BZ:Z:' || p_brand || chr(9) || 'PR:f:' || printf('%.6g', p_retailprice) || chr(9) || 'TY:Z:' || p_type as line from part
        union all select 2, 'L' || chr(9) || abs(a) || chr(9) || case when a < 0 then '-' else '+' end || chr(9) || abs(b) || chr(9) || case when b < 0 then '-' else '+' end || chr(9) || '0M' from link
        union all select 5, 'P' || chr(9) || name || chr(9) || coalesce(toks, '') || chr(9) || '*' from pmeta left join (select trav, {P_TOKENS} as toks from pstep group by trav) using (trav)""",
    "pav_lines": f"""select b.chrom || chr(9) || b."start" || chr(9) || b."end" || chr(9) || b.name || chr(9) || r.grp || chr(9) || printf('%.5g', r.pav) as line from ({ratio('member', 'sample')}) r join bed b using (wid)""",
    "walk_groups": "select sample_id, seq_id, sample_id as sample, sample_id || '#0' as sample_hap, sample_id || '#0#' || seq_id as sample_hap_seq from wmeta",
    "flat_delta": "select node_id, len - coalesce(lag(len) over (order by node_id), 0) as seq_len from seg",
    "largest_symbols": """with d1 as (select trav, pos, snode - coalesce(lag(snode) over (partition by trav order by pos), 0) as d from pstep),
        d2 as (select trav, pos, d - coalesce(lag(d) over (partition by trav order by pos), 0) as d from d1), d3 as (select trav, pos, d - coalesce(lag(d) over (partition by trav order by pos), 0) as d from d2)
        select 1 as round, max(abs(d)) as max_abs from d1 union all select 2, max(abs(d)) from d2 union all select 3, max(abs(d)) from d3""",
    "zigzag_values": """with d as (select trav, pos, snode - coalesce(lag(snode) over (partition by trav order by pos), 0) as d from pstep), z as (select trav, pos, case when d < 0 then -2 * d - 1 else 2 * d end as z from d)
        select trav, pos, z, cast(case when z < 128 then 1 when z < 16384 then 2 when z < 2097152 then 3 when z < 268435456 then 4 else 5 end as bigint) as n from z""",
    "unpacked_2mers": "select user_id, event_type, pos, a as first, -b as second from mer",
    "used_rules": f"with {ROUND_ALL} select rule_id, kmer, first, second from rules",
    "rule_leaves": f"with {ROUND_ALL} select rule_id, cast(2 as bigint) as n, first || ',' || second as leaf from rules",
    "size_texts": """select o_orderkey, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.2f KB', n / 1024.0) when n < 1073741824 then printf('%.2f MB', n / 1048576.0) else printf('%.2f GB', n / 1073741824.0) end as size
        from (select o_orderkey, o_orderkey * o_orderkey * 977 as n from orders)""",
    "store_roundtrip": "select name, pos, snode from pstep join pmeta using (trav)",
}

SQL = {name: full(sql) for name, sql in PLAIN.items()}
