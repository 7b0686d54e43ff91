"""Queries of the scalar functions over the memory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora import config
from mnemora.functions import decay as D
from mnemora.functions import text as T
from mnemora.functions import vectors as V
from mnemora.operators import graph as Gr
from mnemora.operators.resolve import ABBREVIATIONS, abbreviation_groups
from mnemora.plans.sqltext import NOW, canon, inlist, sql, tokens
from mnemora.runtime import canonical_name, instant, table


def _now():
    return F.to_timestamp(F.lit(NOW))


def _alias_pairs(spark, d):
    n = Gr.one_per_key(table(spark, d, "nodes"))
    return n.select("graph_id", "key", "name", F.explode(F.array_distinct(F.array_compact("aliases"))).alias("alias"))


def _edges(spark, d):
    return Gr.one_per_id(table(spark, d, "edges"))


def _reads(spark, d):
    return table(spark, d, "read_trace").groupBy("read_id").agg(F.min("message_preview").alias("m"))


QUERIES = {
    "f01_canonical_names": lambda s, d: table(s, d, "nodes").select("graph_id", "id", canonical_name("name").alias("canon"), T.node_key("kind", "name").alias("made_key")).distinct(),
    "f03_edge_keys": lambda s, d: _edges(s, d).select("graph_id", "id", T.edge_key("source_key", "relation", "target_key").alias("made_key")),
    "f04_relation_forms": lambda s, d: _edges(s, d).select("relation").distinct().withColumn("typed", F.concat(F.lit(" "), F.lower(F.replace("relation", F.lit("_"), F.lit("- "))), F.lit(" ."))).select("relation", T.normal_relation("typed").alias("normal"), T.strict_relation("typed").alias("strict"), T.is_relation(T.strict_relation("typed")).alias("strict_valid"), T.is_relation("relation").alias("valid"), T.relation_phrase("relation").alias("phrase"), T.relation_index_key("relation").alias("index_key"), T.relation_of_key(T.relation_index_key("relation")).alias("back"), T.is_relation_key(T.relation_index_key("relation")).alias("is_rel")),
    "f10_elapsed_days": lambda s, d: _edges(s, d).select("graph_id", "id", F.round(D.elapsed_days(instant("updated_at"), _now()), 6).alias("days")),
    "f12_clamped_confidence": lambda s, d: table(s, d, "node_records").select("rec_id", T.clamp01(F.col("confidence").cast("string"), config.DEFAULT_CONFIDENCE).alias("confidence"), F.coalesce(F.col("confidence").between(0, 1), F.lit(False)).alias("in_range")).distinct(),
    "f15_name_similarity": lambda s, d: _alias_pairs(s, d).select("graph_id", "key", "alias", F.round(T.name_similarity("name", "alias"), 6).alias("similarity")),
    "f17_token_overlap": lambda s, d: _alias_pairs(s, d).select("graph_id", "key", "alias", T.token_overlap(T.name_tokens("name"), T.name_tokens("alias")).alias("overlap"), F.size(T.name_tokens("name")).alias("n_tokens")),
    "f18_abbreviation_groups": lambda s, d: table(s, d, "nodes").where("kind = 'PERSON'").select(F.split(canonical_name("name"), "_")[0].alias("first")).distinct().select("first", F.explode(abbreviation_groups(F.col("first"))).alias("grp")),
    "f19_hash_buckets": lambda s, d: Gr.one_per_key(table(s, d, "nodes")).select(F.explode(T.tokens(T.node_text("name", "aliases"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).select("t", V.token_bucket(F.col("t")).alias("bucket"), V.token_sign(F.col("t")).alias("sign"), "n"),
    "f23_message_nouns": lambda s, d: _reads(s, d).select(F.explode(T.nouns("m")).alias("noun")).groupBy("noun").agg(F.count(F.lit(1)).alias("n")),
    "f24_decayed_strength": lambda s, d: _edges(s, d).select("graph_id", "id", F.round(D.decayed(F.col("strength"), F.col("stability"), D.elapsed_days(instant("updated_at"), _now())), 6).alias("strength")).withColumn("dormant", D.is_dormant(F.col("strength"))),
    "f29_payload_repair": lambda s, d: table(s, d, "campaigns").select("campaign_id", "payload").distinct().select("campaign_id", F.md5("payload").alias("digest"), T.repaired_json("payload").isNotNull().alias("usable"), F.length(T.without_fences("payload")).alias("inner_chars")),
    "f32_prompts": lambda s, d: table(s, d, "episodes").select("graph_id", "id", "summary", "source_prompt_text").distinct().select("graph_id", "id", T.filled_prompt("Known:\n{context}\n\nSaid:\n{conversation}", F.coalesce("summary", F.lit("")), F.coalesce("source_prompt_text", F.lit(""))).alias("prompt")),
    "f34_nullish_evidence": lambda s, d: _edges(s, d).select("graph_id", "id", T.nullish("evidence").alias("evidence"), F.coalesce(T.nullish(F.col("ttl_days").cast("string")), F.lit("none")).alias("ttl")),
    "f35_clean_tags": lambda s, d: table(s, d, "episodes").select("graph_id", "id", F.array_join(T.clean_list("tags", 5), "|").alias("tags")).distinct(),
    "f36_clean_aliases": lambda s, d: table(s, d, "nodes").select("graph_id", "id", F.array_join(T.clean_list("aliases"), "|").alias("aliases")).distinct(),
    "f38_token_estimates": lambda s, d: table(s, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("preview"), T.token_estimate("text").alias("tokens")),
    "f41_superseded": lambda s, d: _edges(s, d).select("graph_id", "id", Gr.superseded(F.col("properties")).alias("superseded")),
    "f42_key_pool": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(T.split_keys(F.concat_ws(",", "lang", "source", F.lit(" "), "lang", "party")), "|").alias("pool")),
    "f46_expectations": lambda s, d: table(s, d, "read_trace").select("read_id", "message_preview", F.transform(F.array_compact(F.coalesce("selected", F.array().cast("array<string>"))), lambda k: F.replace(F.substring_index(k, "::", -1), F.lit("_"), F.lit(" "))).alias("terms")).select("read_id", F.coalesce(T.holds_any(F.col("message_preview"), F.col("terms")), F.lit(False)).alias("any_found"), F.coalesce(T.holds_all(F.col("message_preview"), F.col("terms")), F.lit(False)).alias("all_found")).distinct(),
}

_DAYS = f"greatest(0.0::double, (epoch_us(timestamptz '{NOW}+00') - epoch_us(try_cast(updated_at as timestamptz))) / 86400e6)"
_RATE = "case stability " + " ".join(f"when '{k}' then {v}" for k, v in config.DECAY_PER_DAY.items()) + " end"
_PAIRS = "p as (select graph_id, key, name, alias from (select distinct graph_id, key, name, unnest(aliases) as alias from n) where alias is not null)"
_ALIASTOK = "list_distinct(list_filter(string_split({}, '_'), lambda t: t <> ''))"


def _pairs_sql(select: str) -> str:
    return sql("select 1", "n").rsplit("\n", 1)[0] + ",\n" + _PAIRS + "\n" + select


_CLEAN = "list_filter(list_transform(coalesce({}, []), lambda x: trim(x)), lambda x: x <> '')"
_TA, _TB = _ALIASTOK.format(canon("name")), _ALIASTOK.format(canon("alias"))
_TEXT = "trim(case when len(list_filter(coalesce(aliases, []), lambda x: x is not null)) > 0 then coalesce(name || ' ', '') || array_to_string(list_filter(aliases, lambda x: x is not null), ' ') else coalesce(name, '') end)"
_INNER = r"trim(regexp_replace(regexp_replace(trim(payload), '^```[A-Za-z]*\s*', ''), '\s*```$', ''))"

SQL = {
    "f01_canonical_names": f"select distinct graph_id, id, {canon('name')} as canon, kind || '::' || {canon('name')} as made_key from nodes",
    "f03_edge_keys": sql("select graph_id, id, source_key || '::' || relation || '::' || target_key as made_key from e", "e"),
    "f04_relation_forms": sql(
        r"""select relation, trim(regexp_replace(upper(trim(typed)), '[^A-Z0-9]+', '_', 'g'), '_') as normal, replace(upper(trim(typed)), ' ', '_') as strict,
            regexp_full_match(replace(upper(trim(typed)), ' ', '_'), '[A-Z]+(?:_[A-Z]+){0,3}') as strict_valid, regexp_full_match(relation, '[A-Z]+(?:_[A-Z]+){0,3}') as valid,
            replace(lower(relation), '_', ' ') as phrase, 'REL::' || relation as index_key, relation as back, true as is_rel
            from (select distinct relation, ' ' || lower(replace(relation, '_', '- ')) || ' .' as typed from e)""",
        "e",
    ),
    "f10_elapsed_days": sql(f"select graph_id, id, round({_DAYS}, 6) as days from e", "e"),
    "f12_clamped_confidence": "select distinct rec_id, least(1.0, greatest(0.0, coalesce(case when not isnan(confidence) then confidence end, 0.85))) as confidence, coalesce(confidence between 0 and 1, false) as in_range from node_records",
    "f15_name_similarity": _pairs_sql(f"select graph_id, key, alias, case when greatest(length({canon('name')}), length({canon('alias')})) = 0 then 1.0 else round(1 - levenshtein({canon('name')}, {canon('alias')}) / greatest(length({canon('name')}), length({canon('alias')})), 6) end as similarity from p"),
    "f17_token_overlap": _pairs_sql(f"select graph_id, key, alias, len(list_filter(list_intersect(ta, tb), lambda t: length(t) >= 2)) > 0 and (len(list_intersect(ta, tb)) = len(ta) or len(list_intersect(ta, tb)) = len(tb) or len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) >= 0.5) as overlap, len(ta) as n_tokens from (select *, {_TA} as ta, {_TB} as tb from p)"),
    "f18_abbreviation_groups": f"with g as (select unnest([{', '.join('[' + inlist(g) + ']' for g in ABBREVIATIONS)}]) as names, unnest(range({len(ABBREVIATIONS)})) as grp) select first, grp from (select distinct split_part({canon('name')}, '_', 1) as first from nodes where kind = 'PERSON') f join g on list_contains(g.names, f.first)",
    "f19_hash_buckets": sql(f"select t, ('0x' || substr(sha1(t), 1, 8))::bigint % 256 as bucket, case when ('0x' || substr(sha1(t), 9, 2))::int % 2 = 1 then 1.0 else -1.0 end as sign, count(*) as n from (select unnest({tokens(_TEXT)}) as t from n) group by t", "n"),
    "f23_message_nouns": f"select noun, count(*) as n from (select distinct read_id, noun from (select read_id, unnest({tokens('m')}) as noun from (select read_id, min(message_preview) as m from read_trace group by read_id)) where length(noun) > 1 and noun not in ({inlist(T.STOP_WORDS)})) group by noun",
    "f24_decayed_strength": sql(f"select graph_id, id, s as strength, s < 2 as dormant from (select graph_id, id, round(strength * exp(-({_RATE}) * {_DAYS}), 6) as s from e)", "e"),
    "f32_prompts": r"select distinct graph_id, id, 'Known:' || chr(10) || coalesce(nullif(summary, ''), '(empty - no existing graph)') || chr(10) || chr(10) || 'Said:' || chr(10) || coalesce(source_prompt_text, '') as prompt from episodes",
    "f34_nullish_evidence": sql("select graph_id, id, case when lower(trim(evidence)) not in ('null', 'none', '') then evidence end as evidence, coalesce(cast(ttl_days as varchar), 'none') as ttl from e", "e"),
    "f35_clean_tags": f"select distinct graph_id, id, array_to_string(({_CLEAN.format('tags')})[1:5], '|') as tags from episodes",
    "f36_clean_aliases": f"select distinct graph_id, id, array_to_string({_CLEAN.format('aliases')}, '|') as aliases from nodes",
    "f38_token_estimates": r"select doc_id, substr(text, 1, 200) as preview, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) as tokens from documents",
    "f41_superseded": sql("select graph_id, id, coalesce(properties['superseded_by'], '') <> '' as superseded from e", "e"),
    "f46_expectations": "select distinct read_id, coalesce(len(list_filter(terms, lambda w: contains(lower(m), lower(w)))) > 0, false) as any_found, len(terms) = 0 or coalesce(len(list_filter(terms, lambda w: contains(lower(m), lower(w)))) = len(terms), false) as all_found from (select read_id, message_preview as m, list_transform(list_filter(coalesce(selected, []), lambda k: k is not null), lambda k: replace(split_part(k, '::', 2), '_', ' ')) as terms from read_trace)",
}
