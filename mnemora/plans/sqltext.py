"""Common table expressions for the plain-SQL twins; ``sql`` chains the ones a query needs."""

from __future__ import annotations

NOW = "2026-02-01 00:00:00"

CTES = {
    "n": """select * from nodes qualify row_number() over (partition by graph_id, key
        order by coalesce(try_cast(created_at as timestamptz), to_timestamp(0)), id) = 1""",
    "e": "select * from edges qualify row_number() over (partition by graph_id, id order by key) = 1",
    "bothways": """select graph_id, source_key as from_key, target_key as to_key, key as edge_key, id as edge_id, 'F' as direction, strength from e
        union all select graph_id, target_key, source_key, key, id, 'R', strength from e""",
    "adj": """select b.*, strength / (case when t.total = 0 then 1 else t.total end) as share from bothways b
        join (select graph_id, from_key, sum(strength) as total from bothways group by all) t using (graph_id, from_key)""",
    "ways": "select graph_id, from_key, to_key, direction, sum(share) as share from adj group by all",
    "seeds": """select distinct s.ask, s.graph_id, s.key from (select read_id as ask, graph_id, unnest(seeds) as key from read_trace) s
        join n on n.graph_id = s.graph_id and n.key = s.key""",
    "h0": "select ask, graph_id, key, 0 as hop, 1.0::double as arrived, 0.0::double as fwd, 0.0::double as rev from seeds",
    "h1": """select h.ask, h.graph_id, w.to_key as key, 1 as hop, sum(arrived * share * 0.6) as arrived,
        sum(case when direction = 'F' then arrived * share * 0.6 else 0 end) as fwd, sum(case when direction = 'R' then arrived * share * 0.6 else 0 end) as rev
        from h0 h join ways w on w.graph_id = h.graph_id and w.from_key = h.key group by all""",
    "h2": """select h.ask, h.graph_id, w.to_key as key, 2 as hop, sum(arrived * share * 0.6) as arrived,
        sum(case when direction = 'F' then arrived * share * 0.6 else 0 end) as fwd, sum(case when direction = 'R' then arrived * share * 0.6 else 0 end) as rev
        from h1 h join ways w on w.graph_id = h.graph_id and w.from_key = h.key group by all""",
    "act": """select ask, graph_id, key, round(sum(arrived), 9) as score, min(hop) as hop,
        case when min(hop) = 0 then 'SEED' when round(sum(fwd), 9) >= round(sum(rev), 9) then 'FORWARD' else 'REVERSE' end as direction
        from (select * from h0 union all select * from h1 union all select * from h2) group by ask, graph_id, key""",
    "ep": "select distinct graph_id, key, episode from (select graph_id, key, unnest(source_episode_ids) as episode from n) where episode is not null",
    "fired": "select ask, graph_id, key from act where score >= {primary}",
    "near": """select distinct l.ask, l.graph_id, ep.key from (select distinct f.ask, f.graph_id, ep.episode from fired f join ep using (graph_id, key)) l
        join ep using (graph_id, episode) anti join fired f on f.ask = l.ask and f.graph_id = l.graph_id and f.key = ep.key""",
    "boosted": """select coalesce(a.ask, x.ask) as ask, coalesce(a.graph_id, x.graph_id) as graph_id, coalesce(a.key, x.key) as key,
        round(coalesce(a.score, 0) + case when x.ask is not null then 0.15 else 0 end, 9) as score, a.hop, coalesce(a.direction, 'FORWARD') as direction, x.ask is not null as co_episode
        from act a full join near x on a.ask = x.ask and a.graph_id = x.graph_id and a.key = x.key""",
    "classed": """select *, row_number() over (partition by ask, graph_id, direction = 'REVERSE' order by score desc, key) as c from boosted where score >= {primary}""",
    "placed": """select *, row_number() over (partition by ask, graph_id order by (case when direction = 'REVERSE' then c <= 2 else c <= 6 end) desc, score desc, key) as p from classed""",
    "chosen": """select ask, graph_id, key, score, direction, hop, row_number() over (partition by ask, graph_id order by score desc, key) as rank from placed where p <= 8""",
    "pick": "select ask, graph_id, key from chosen",
    "live": "select *, coalesce(try_cast(created_at as timestamptz), to_timestamp(0)) as ts0 from e where coalesce(properties['superseded_by'], '') = ''",
    "linerows": """select c.ask, c.graph_id, c.rank, l.ts0, l.id, s.name || ' -[' || l.relation || ']-> ' || t.name as line
        from chosen c join live l on l.graph_id = c.graph_id and l.source_key = c.key
        join chosen d on d.ask = c.ask and d.graph_id = c.graph_id and d.key = l.target_key
        join n s on s.graph_id = l.graph_id and s.key = l.source_key join n t on t.graph_id = l.graph_id and t.key = l.target_key""",
    "lines": """select ask, graph_id, line, row_number() over (partition by ask, graph_id order by rank, ts0, id) as ord from
        (select * from linerows qualify row_number() over (partition by ask, graph_id, line order by rank, ts0, id) = 1)""",
    "snipends": """select graph_id, source_key as key, 0 as d, strength, ts0, id, snippet from live where coalesce(snippet, '') <> ''
        union all select graph_id, target_key, 1, strength, ts0, id, snippet from live where coalesce(snippet, '') <> ''""",
    "sniptop": """select c.ask, c.graph_id, c.rank, s.key, s.id, s.snippet, row_number() over (partition by c.ask, c.graph_id, c.key order by s.strength desc, s.d, s.ts0, s.id) as k
        from chosen c join snipends s using (graph_id, key) where c.score >= {secondary} qualify k <= 4""",
    "snips": """select ask, graph_id, key, id as edge_id, snippet, row_number() over (partition by ask, graph_id order by rank, k, key, id) as ord from
        (select * from sniptop qualify row_number() over (partition by ask, graph_id, snippet order by rank, k, key, id) = 1)""",
    "idx": """select graph_id, key, case when len(list_filter(coalesce(aliases, []), lambda x: x is not null)) > 0
          then coalesce(name || ' ', '') || array_to_string(list_filter(aliases, lambda x: x is not null), ' ') else coalesce(name, '') end as text from n
        union all select distinct graph_id, 'REL::' || relation, replace(lower(relation), '_', ' ') from e""",
}
ORDER = list(CTES)
RETRIEVAL = ("n", "e", "bothways", "adj", "ways", "seeds", "h0", "h1", "h2", "act", "ep", "fired", "near", "boosted", "classed", "placed", "chosen", "live", "linerows", "lines", "snipends", "sniptop", "snips")


def sql(select: str, *names: str, primary: float = 0.30, secondary: float = 0.60) -> str:
    """``select`` behind the named CTEs, in an order in which each stands after those it uses."""
    parts = [f"{k} as {'materialized ' if k in ('chosen', 'pick') else ''}({CTES[k].replace('{primary}', str(primary)).replace('{secondary}', str(secondary))})" for k in sorted(set(names), key=ORDER.index)]
    return (("with " + ",\n".join(parts) + "\n") if parts else "") + select


def canon(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '[^a-z0-9]+', '_', 'g'), '_')"


def tokens(expr: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({expr}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def inlist(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
