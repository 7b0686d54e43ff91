"""Scalar text functions as column expressions: canonical names, keys, tokens, similarity, payload repair, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora import config
from mnemora.runtime import canonical_name

#: Stop words, which must be these for the same seeds.
STOP_WORDS = tuple(
    dict.fromkeys(
        """
        a an the this that these those my your his her its our their me you he she it we they him them us
        i and or but nor so yet for of to in on at by with from into onto over under as is am are was were be
        been being do does did done have has had having will would shall should can could may might must
        not no yes if then else when where why how what which who whom whose all any some each few more most
        other such only own same than too very just about up out off down then once here there
        me about get got like really actually maybe think know want need help thanks please okay ok hey hi
        """.split()
    )
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def node_key(kind: Column | str, name: Column | str) -> Column:
    """``KIND::canonical_name``."""
    return F.concat(col(kind), F.lit("::"), canonical_name(name))


def edge_key(source: Column | str, relation: Column | str, target: Column | str) -> Column:
    return F.concat(col(source), F.lit("::"), col(relation), F.lit("::"), col(target))


def relation_index_key(relation: Column | str) -> Column:
    return F.concat(F.lit("REL::"), col(relation))


def is_relation_key(key: Column | str) -> Column:
    return F.startswith(col(key), F.lit("REL::"))


def relation_of_key(key: Column | str) -> Column:
    return F.substring(col(key), 6, 1 << 20)


def normal_relation(raw: Column | str) -> Column:
    """Upper case, other runs than ``[A-Z0-9]`` become one underscore, outer ones go."""
    return F.btrim(F.regexp_replace(F.upper(F.btrim(col(raw))), "[^A-Z0-9]+", "_"), F.lit("_"))


def strict_relation(raw: Column | str) -> Column:
    """The weaker form for tool calls: outer blanks off, upper case, blanks to underscores."""
    return F.replace(F.upper(F.btrim(col(raw))), F.lit(" "), F.lit("_"))


def is_relation(relation: Column | str) -> Column:
    return col(relation).rlike(config.RELATION_SHAPE)


def relation_phrase(relation: Column | str) -> Column:
    return F.replace(F.lower(col(relation)), F.lit("_"), F.lit(" "))


def node_text(name: Column | str, aliases: Column | str) -> Column:
    """Name and aliases as one text for embedding."""
    return F.concat_ws(" ", col(name), F.array_compact(F.coalesce(col(aliases), F.array().cast("array<string>"))))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def nouns(text: Column | str) -> Column:
    """Distinct tokens in order, without one-letter words and stop words."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def name_tokens(name: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(canonical_name(name), "_"), lambda t: t != ""))


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length, on canonical names; two empty ones are equal."""
    ca, cb = canonical_name(a), canonical_name(b)
    longest = F.greatest(F.length(ca), F.length(cb))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(ca, cb) / F.nullif(longest, F.lit(0)))


def token_overlap(a: Column, b: Column) -> Column:
    """Some shared token of two letters or more, and one set inside the other or Jaccard of at least a half."""
    shared = F.size(F.array_intersect(a, b))
    long_one = F.exists(F.array_intersect(a, b), lambda t: F.length(t) >= 2)
    inside = (shared == F.size(a)) | (shared == F.size(b))
    return long_one & (inside | (shared / F.nullif(F.size(F.array_union(a, b)), F.lit(0)) >= config.JACCARD_FROM))


def clamp01(value: Column | str, default: float) -> Column:
    """The number within 0 to 1; what isn't a number becomes ``default``."""
    number = col(value).try_cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.lit(default))))


def clean_list(values: Column | str, most: int | None = None) -> Column:
    """Trimmed, non-empty elements (the first ``most`` of them)."""
    cleaned = F.filter(F.transform(F.coalesce(col(values), F.array().cast("array<string>")), lambda x: F.btrim(x)), lambda x: x != "")
    return F.slice(cleaned, 1, most) if most else cleaned


def nullish(value: Column | str) -> Column:
    """Text with the words null, none and blanks as null."""
    c = col(value)
    return F.when(~F.lower(F.btrim(c)).isin("null", "none", ""), c)


def preview(text: Column | str, size: int = 200) -> Column:
    return F.substring(col(text), 1, size)


def token_estimate(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda x: x != ""))


def without_fences(text: Column | str) -> Column:
    """Text without an opening Markdown fence line and a closing fence."""
    inner = F.regexp_replace(F.btrim(col(text)), r"^```[A-Za-z]*\s*", "")
    return F.btrim(F.regexp_replace(inner, r"\s*```$", ""))


def repaired_json(text: Column | str) -> Column:
    """The first of these that parses: the text, its outermost braces, those without trailing commas; else null."""
    whole = without_fences(text)
    first, last = F.instr(whole, "{"), F.length(whole) - F.instr(F.reverse(whole), "}") + 1
    braces = F.when((first > 0) & (last >= first), F.substr(whole, first, last - first + 1))
    fixed = F.regexp_replace(braces, r",(\s*[}\]])", "$1")
    parses = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(parses(whole), parses(braces), parses(fixed))


def filled_prompt(template: str, context: Column, conversation: Column) -> Column:
    """A template's ``{context}`` and ``{conversation}`` places filled in; an empty context is spelled out."""
    shown = F.coalesce(F.nullif(context, F.lit("")), F.lit("(empty - no existing graph)"))
    return F.replace(F.replace(F.lit(template), F.lit("{context}"), shown), F.lit("{conversation}"), conversation)


def split_keys(pool: Column | str) -> Column:
    """A comma-separated pool: trimmed, blanks dropped, first occurrences kept."""
    return F.array_distinct(clean_list(F.split(col(pool), ",")))


def holds_all(text: Column, wanted: Column) -> Column:
    return F.forall(wanted, lambda w: F.contains(F.lower(text), F.lower(w)))


def holds_any(text: Column, wanted: Column) -> Column:
    return F.exists(wanted, lambda w: F.contains(F.lower(text), F.lower(w)))
