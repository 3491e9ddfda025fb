"""DuckDB SQL of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from .secrets import ANY, DIGITS, HEXES, LETTERS, ONE_CASE, SCALE, WINDOW, WORDS, largest_sum

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$"""


def _found(kind: int, pattern: str, where: str) -> str:
    """doc_id, k, s, e, m of the matches of a pattern: places follow from the lengths of gaps and matches."""
    return f"""select doc_id, {kind} as k, s, s + length(m) as e, m from (
        select doc_id, hits[i] as m, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as bigint) as s
        from (select doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) as i from
            (select doc_id, regexp_extract_all(t, '{pattern}') as hits, regexp_split_to_array(t, '{pattern}') as gaps from d where regexp_matches(t, '{pattern}')))) where {where}"""


_CASES = [("[0-9]+", DIGITS), ("(?:[0-9a-f]+|[0-9A-F]+)", HEXES), ("[A-Za-z]+", LETTERS), ("(?:[A-Z0-9]+|[a-z0-9]+)", ONE_CASE), ("[A-Za-z0-9]+", WORDS)]
_LIMIT = "case " + " ".join(f"when regexp_full_match(w, '{p}') then {largest_sum(b)}" for p, b in _CASES) + f" else {largest_sum(ANY)} end"
SECRETS = f"""with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rn from documents),
base as ({_found(0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN_VALUE}', 1)) >= 12")} union all {_found(1, "AKIA[A-Z0-9]+", "length(m) >= 18")} union all {_found(2, "[0-9a-f]+", "length(m) >= 16")}),
long_ as ({_found(3, f"[A-Za-z0-9+/_=-]{{{WINDOW},}}", "true")}),
kept as (select doc_id, s, regexp_replace(m, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}', repeat(' ', 36), 'g') as m from long_),
win as (select doc_id, s, i, substr(m, cast(i + 1 as integer), {WINDOW}) as w from (select *, unnest(range(0, length(m) - {WINDOW - 1})) as i from kept)),
fair as (select * from win where not contains(w, ' ') and not regexp_matches(w, '(?i)example|sample|placeholder|dummy|xxxx|your[_-]|changeme') and not regexp_matches(w, '(?i)abcdefghij|0123456789|qwertyuiop')
    and not regexp_full_match(w, '[-_/=+]*[A-Za-z]+(?:[-_/=+]+[A-Za-z]+)+[-_/=+]*') and len(list_filter(range(1, {WINDOW} - 6), lambda i: w[i:i + 7] = repeat(w[i:i], 8))) = 0),
chars as (select doc_id, s, i, w, unnest(string_split(w, '')) as c from fair),
counts as (select doc_id, s, i, w, c, count(*) as n from chars group by all),
bits as (select doc_id, s, i, w, sum(cast(round(n * log2(n) * {SCALE}) as bigint)) as h from counts group by doc_id, s, i, w),
hits as (select doc_id, s, i from bits where h <= {_LIMIT}),
runs as (select *, sum(case when i - before < {WINDOW} then 0 else 1 end) over (partition by doc_id, s order by i) as run from (select *, lag(i, 1, -1000000) over (partition by doc_id, s order by i) as before from hits)),
dense as (select doc_id, 3 as k, s + min(i) as s, s + max(i) + {WINDOW} as e from runs group by doc_id, runs.s, run),
more as (select * from dense where not exists (select 1 from base b where b.doc_id = dense.doc_id and b.s <= dense.s and dense.e <= b.e)),
spans as (select doc_id, k, s, e, (['assign', 'access', 'hex', 'entropy'])[k + 1] || ':' || s || ':' || e as x from (select doc_id, k, s, e from base union all select doc_id, k, s, e from more)),
agg as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex, count(*) filter (where k = 3) as n_entropy,
    string_agg(x, ',' order by s, k, e) filter (where k < 3) as base, string_agg(x, ',' order by s, k, e) as spans from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
    coalesce(n_entropy, 0) as n_entropy from d left join agg using (doc_id)"""

NEAR_DUPLICATES = r"""with recursive w as (select doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
sh as (select distinct doc_id, md5(x) as x from (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else [array_to_string(w, ' ')] end) as x from w where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.x = b.x and a.doc_id < b.doc_id group by all),
link as (select a, b from both_ join n na on a = na.doc_id join n nb on b = nb.doc_id where c >= 0.8 * (na.n + nb.n - c) - 1e-9
    union select min(doc_id) over (partition by text), doc_id from w),
ways as (select a, b from link union select b, a from link),
reach as (select doc_id as a, doc_id as b from w union select r.a, ways.b from reach r join ways on r.b = ways.a),
class as (select a as doc_id, min(b) as class_id from reach group by a),
size as (select class_id, count(*) as class_size from class group by class_id)
select doc_id, class_id, class_size from class join size using (class_id) union all select doc_id, doc_id, 1 from documents where text is null"""

NEIGHBOURS = """with v as (select vec_id, cast(embedding as double[]) as v, row_number() over () as r from embeddings),
ok as (select * from v where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
pairs as (select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) as score from ok q join ok c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 10"""

SQL = {"op5_secrets": SECRETS, "op6_near_duplicates": NEAR_DUPLICATES, "op10_neighbours": NEIGHBOURS}
