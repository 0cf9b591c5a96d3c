"""Common table expressions for the SQL twins of the queries."""

CC = "cc as (select * exclude (rn) from (select *, row_number() over (partition by chunk_id order by ingested_at desc) as rn from code_chunks where chunk_id is not null) where rn = 1)"
RC = "rc as (select * exclude (rn) from (select *, row_number() over (partition by chunk_id order by ingested_at desc) as rn from readme_chunks where chunk_id is not null) where rn = 1)"
EDGES = "edges as (select edge_id, min(caller_chunk_id) as caller, min(callee_chunk_id) as callee, min(caller_identifier) as caller_identifier, min(callee_identifier) as callee_identifier, min(caller_file) as caller_file, min(callee_file) as callee_file, min(project_name) as project_name, min(resolution_tier) as tier from call_edges group by edge_id)"


def vectors(field: str, name: str) -> str:
    return f"""{name} as (select chunk_id as id, {field}::double[] as vector from (select *, row_number() over (partition by chunk_id order by exported_at desc) as rn from code_embeddings)
        where rn = 1 and {field} is not null and len({field}) = 64 and len(list_filter({field}, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter({field}, lambda x: x <> 0)) > 0)"""


VEC, SIG = vectors("embedding", "vec"), vectors("signature_embedding", "sig")
BY_100 = "('0x' || right({0}, 12))::bigint % 100 = 0"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({expr}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def bm25(docs: str, queries: str) -> str:
    """CTEs tok, tot, post, dfs, scores over relations docs(id, text) and queries(query_id, query)."""
    return f"""tok as (select id, {tokens('text')} as ts from {docs}),
    tot as (select count(*) as n, avg(len(ts)) as a from tok),
    post as (select term, id, count(*) as tf, any_value(dl) as dl from (select id, len(ts) as dl, unnest(ts) as term from tok) group by term, id),
    dfs as (select term, count(*) as df from post group by term),
    wanted as (select query_id, term, count(*) as times from (select query_id, unnest({tokens('query')}) as term from {queries}) group by all),
    scores as (select query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) as score
        from wanted join post using (term) join dfs using (term), tot group by query_id, id),
    bm as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from scores where score > 0) where rank <= 10)"""


CAMEL = r"lower(regexp_replace(regexp_replace({0}, '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '([^\p{{Lu}}\s])(\p{{Lu}})', '\1 \2', 'g'))"


def searchable(i: str = "identifier", s: str = "signature", d: str = "docstring") -> str:
    camel = CAMEL.format(i)
    return f"concat_ws(chr(10), {i} || ' ' || {i} || case when {camel} <> lower({i}) then ' ' || {camel} else '' end, {s}, nullif({d}, ''))"


def cut(expr: str, limit: int, mark: str = "") -> str:
    low = limit // 4
    return f"case when strlen({expr}) <= {limit} then {expr} else left({expr}, list_max(list_filter(range({low}, {limit} + 1), lambda k: strlen(left({expr}, k)) <= {limit})))" + (f" || '{mark}'" if mark else "") + " end"
