"""Queries of the general data-processing operators: snapshot changes (p4) and nested records (p5)."""

from __future__ import annotations

from mnemora.operators.nested import campaign_items, campaign_nodes, campaign_tables
from mnemora.operators.snapshots import snapshot_changes
from mnemora.runtime import table

QUERIES = {
    "p4_found": lambda spark, d: snapshot_changes(table(spark, d, "node_snapshots")),
    "p5_found": lambda spark, d: campaign_items(table(spark, d, "campaigns")),
    "p5_nodes": lambda spark, d: campaign_nodes(table(spark, d, "campaigns")),
    "p5_sessions": lambda spark, d: campaign_tables(table(spark, d, "campaigns"))["session"],
}

SQL = {
    "p4_found": """
        with r as (select distinct graph_id, key, snapshot_no, name, kind, confidence,
                          list_sort(list_distinct(list_filter(coalesce(aliases, []), lambda x: x is not null))) as al
                   from node_snapshots where graph_id is not null and snapshot_no is not null),
        d as (select graph_id, snapshot_no, lag(snapshot_no) over (partition by graph_id order by snapshot_no) as prev
              from (select distinct graph_id, snapshot_no from r)),
        a as (select r.*, d.prev from r join d using (graph_id, snapshot_no) where d.prev is not null),
        b as (select r.*, d.snapshot_no as at from r join d on r.graph_id = d.graph_id and r.snapshot_no = d.prev)
        select coalesce(a.graph_id, b.graph_id) as graph_id, coalesce(a.key, b.key) as key,
               coalesce(a.snapshot_no, b.at) as snapshot_no,
               case when b.graph_id is null then 'added' when a.graph_id is null then 'removed' else 'changed' end as change_kind
        from a full join b on a.graph_id = b.graph_id and a.snapshot_no = b.at and a.key is not distinct from b.key
        where a.graph_id is null or b.graph_id is null or a.name is distinct from b.name or a.kind is distinct from b.kind
              or a.confidence is distinct from b.confidence or a.al is distinct from b.al""",
}
