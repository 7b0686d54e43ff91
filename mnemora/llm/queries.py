"""Named queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from mnemora.llm import cooccur, encode, leak, names, quality, survivor
from mnemora.runtime import table

QUERIES = {
    "p1_found": lambda spark, d: names.same_entity_pairs(table(spark, d, "nodes")),
    "p1_entities": lambda spark, d: names.attributed(table(spark, d, "nodes")),
    "p2_found": lambda spark, d: cooccur.found_pairs(table(spark, d, "read_trace"), table(spark, d, "nodes")),
    "p2_surprise": lambda spark, d: cooccur.surprising_pairs(cooccur.read_baskets(table(spark, d, "read_trace")).unionByName(cooccur.episode_baskets(table(spark, d, "nodes"))), {"read": 1, "episode": 1}),
    "p3_found": lambda spark, d: survivor.survivors(table(spark, d, "node_records")),
    "p3_truth": lambda spark, d: survivor.true_values(table(spark, d, "node_records")),
    "p3_fused": lambda spark, d: survivor.fused(table(spark, d, "node_records")),
    "p6_ids": lambda spark, d: encode.corpus_ids(table(spark, d, "documents")),
    "p7_found": lambda spark, d: leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id"),
    "p7_passages": lambda spark, d: leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p7_clean": lambda spark, d: leak.clean_documents(table(spark, d, "documents").select("doc_id", "source", "n_chars", "text"), table(spark, d, "eval_items")).drop("text"),
    "p8_found": lambda spark, d: quality.not_prose(table(spark, d, "documents"), table(spark, d, "doc_labels")),
    "p8_statistics": lambda spark, d: quality.outlierness(table(spark, d, "documents")),
}

SQL = {
    "p2_found": """
        with sets as (
          select distinct 'read' as basket, graph_id, cast(read_id as varchar) as set_id, unnest(list_concat(coalesce(seeds, []), coalesce(selected, []))) as key
          from read_trace
          union
          select distinct 'episode', graph_id, unnest(source_episode_ids), key from nodes),
        s as (select * from sets where key is not null and set_id is not null),
        n as (select basket, graph_id, count(distinct set_id) as n from s group by all),
        f as (select basket, graph_id, key, count(*) as n from s group by all),
        c as (select a.basket, a.graph_id, a.key as key_a, b.key as key_b, count(*) as n_ab
              from s a join s b on a.basket = b.basket and a.graph_id = b.graph_id and a.set_id = b.set_id and a.key < b.key group by all)
        select c.basket, c.graph_id, c.key_a, c.key_b
        from c join n using (basket, graph_id)
        join f fa on fa.basket = c.basket and fa.graph_id = c.graph_id and fa.key = c.key_a
        join f fb on fb.basket = c.basket and fb.graph_id = c.graph_id and fb.key = c.key_b
        where c.n_ab * n.n >= 3 * fa.n * fb.n and c.n_ab >= case c.basket when 'read' then 6 else 4 end""",
    "p3_found": r"""
        with r as (
          select distinct rec_id, graph_id,
                 upper(trim(split_part(key, '::', 1))) || '::' || trim(regexp_replace(lower(substr(key, instr(key, '::') + 2)), '[^a-z0-9]+', '_', 'g'), '_') as node_key,
                 case when confidence between 0 and 1 then confidence end as conf,
                 len(list_distinct(list_filter(list_transform(coalesce(aliases, []), lambda x: lower(trim(x))), lambda x: x <> ''))) as na,
                 len(list_distinct(list_filter(coalesce(source_episode_ids, []), lambda x: x is not null))) as ne,
                 case when try_cast(updated_at as timestamptz) <= timezone('UTC', received_at) then try_cast(updated_at as timestamptz) end as upd
          from node_records where contains(key, '::'))
        select graph_id, node_key,
               first(rec_id order by conf desc, rec_id) filter (where conf is not null) as confidence_rec,
               first(rec_id order by na desc, rec_id) as aliases_rec,
               first(rec_id order by ne desc, rec_id) as episodes_rec,
               first(rec_id order by upd desc, rec_id) filter (where upd is not null) as updated_rec
        from r group by graph_id, node_key having count(distinct rec_id) >= 2""",
}
