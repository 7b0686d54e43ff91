"""Variant spellings of names typed by people, attributed to the person or organisation they stand for.

A noisy channel: somebody means a canonical name and types it with slips, abbreviations, nicknames, in another order,
or with parts left out. Spellings of one graph that share a blocking key are scored in both directions; a spelling is
attached to the higher-ranked one of greatest posterior (rank: how often it occurs and how many spellings it
explains). Spellings with less information (initials, a bare surname, an acronym, a part of a body's name) are
attached to an entity only if the posterior, summed over the entity's spellings, leaves no other entity in play.

Graphs of any size stay many small rows: equal spellings count once, and blocks pair a slip-tolerant key of one word
with the initial of the other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.runtime import checkpointed

#: Common English short forms of given names (and some of other languages), by full name.
NICKNAMES = """
abigail abby gail; agnes aggie nessa; albert al bert bertie; alexander alex alec sandy xander sasha; alexandra alex sandra lexi sasha sandy;
alfred alf fred alfie; amanda mandy; andrew andy drew; anthony tony ant; antonio toni tonio nino; barbara barb babs; bartholomew bart barty tolly;
benjamin ben benny; catherine cathy cate kate katie kitty cat; charles charlie chuck chas; charlotte lottie charlie; christina chris tina chrissy;
christopher chris kit topher kris; cornelius neil corny; daniel dan danny; david dave davey; deborah deb debbie debs debby; dominic dom nic nick nico;
donald don donnie; dorothy dot dolly dottie; edmund ed eddie ned ted; edward ed eddie ned ted teddy; eleanor ellie nell nora; elizabeth liz beth lizzie eliza betty betsy libby lisa;
emmanuel manny; eugene gene; florence flo; frances fran frankie; francesca fran cesca frankie chess; francis frank frankie; francisco paco pancho; frederick fred freddie;
gabriella gabi gabby ella bella; geoffrey geoff jeff; george georgie; gerald gerry; gertrude trudy; giovanni gianni vanni; giuseppe beppe peppe pino; gregory greg; guillermo memo guille;
harold hal harry; heinrich heinz; helen nell lena; henry harry hank hal; ignacio nacho iggy; isabella bella izzy isa belle; jacqueline jackie jacqui; jakub kuba; james jim jimmy jamie;
jennifer jen jenny; jessica jess; johann hans; john jack johnny; jonathan jon jonny; jose pepe; joseph joe joey; josephine jo josie; joshua josh; katherine kate kathy katie kit kitty kat;
kenneth ken kenny; konstantin kostya kosta; kwame kwams; lawrence larry laurie; leonard len lenny leo; leilani lei lani; louis lou; lucille lucy; ludwig lutz; luis lucho; magdalena lena magda; margaret maggie meg peggy greta madge marge;
maria mia; martha patty; martin marty; mary molly polly; matthew matt; matthias matt matze hias; maximilian max; michael mike mick mickey; mohammed mo hamed; nathaniel nat nate nathan;
nicholas nick nicky; oluwaseun seun olu; pamela pam; patricia pat patty trish tricia; patrick pat paddy; paloma lola; peter pete; philip phil pip; philippa pippa pip; quentin quin;
ravindra ravi; raymond ray; rebecca becky becca bex; richard dick rick rich ricky; robert rob bob bobby bert robbie; ronald ron; rosemary rosie; samantha sam; samuel sam sammy; sarah sally;
solomon sol; soraya raya; stanislaw staszek stas stan; stephen steve; steven steve; susan sue susie; susannah sue zanna susie anna susan; theodore ted theo teddy; theresa tess terry tessa tracy;
thomas tom tommy; timothy tim; valentina tina; venkatesh venky venkat; victoria vicky tori vic; vincent vince vinny vin; virginia ginny; vladimir vova; wilhelm willi; wilhelmina mina;
william bill will liam billy; winifred winnie; yusuf yus joe; zachary zach zak zack; zoe zo
"""
#: Titles, generation suffixes, words for oneself, legal forms, and short forms of words in names of bodies.
TITLES = {"mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "rev", "sir", "dame", "lord", "lady", "hon", "herr", "frau", "mme", "mlle"}
GENERATIONS = {"jr", "sr", "ii", "iii", "iv", "junior", "senior"}
SELF = {"user", "the user", "me", "myself", "self", "i", "the_user"}
LEGAL = {"inc", "incorporated", "llc", "llp", "ltd", "limited", "plc", "gmbh", "ag", "sa", "corp", "corporation", "group", "grp", "hq", "headquarters", "holdings"}
SHORT_WORDS = {"assoc": "association", "assn": "association", "ctr": "centre", "center": "centre", "co": "company", "dept": "department", "inst": "institute", "intl": "international", "lib": "library", "med": "medical", "natl": "national", "sch": "school", "soc": "society", "uni": "university", "univ": "university"}
EMPTY_WORDS = {"and", "of", "the", "for", "de", "und", "et"}
AND_WORDS = {"and", "und", "et"}

#: Log likelihoods of the channel's slips, and of a spelling that stands for somebody not yet known.
SLIP, NICK, CUT, DROPPED, TURNED, UNKNOWN = -2.5, -1.0, -1.5, -0.7, -0.5, -7.0
#: Share of the posterior that one entity must hold for a spelling of less information.
SURE = 0.8

#: Short forms by full name, full names by short form.
_SHORT: dict[str, list[str]] = {e.split()[0]: e.split()[1:] for e in NICKNAMES.split(";")}
_FULL: dict[str, set[str]] = {s: {n for n, shorts in _SHORT.items() if s in shorts} for shorts in _SHORT.values() for s in shorts}
_DETERMINER = re.compile(r"^(the|my|our|a|an)\s+", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")
_KEPT_CAMEL = re.compile(r"\b(Mc|Mac|De|Di|La|Le|Van|O)(?=[A-Z])")


def plain(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("ł", "l").replace("Ł", "L").replace("ø", "o").replace("Ø", "O").replace("ß", "ss")) if not unicodedata.combining(c)).casefold()


def within_one(a: str, b: str) -> bool:
    """Whether one slip (a wrong, lost, added or two swapped letters) turns one word into the other."""
    la, lb = len(a), len(b)
    if a == b:
        return True
    if abs(la - lb) > 1:
        return False
    if la > lb:
        a, b, la, lb = b, a, lb, la
    i = 0
    while i < la and a[i] == b[i]:
        i += 1
    if la < lb:
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def parse(kind: str, form: str) -> tuple[str, int] | None:
    """Normal form of a typed name and how much it tells: 3 a full name, 2 initials, 1 a single word, 0 a role or oneself."""
    raw = re.sub(r"\s+", " ", form).strip()
    if not raw:
        return None
    if kind == "PERSON":
        low = plain(raw).strip(" .,")
        if low in SELF:
            return "self:", 0
        bare = _DETERMINER.sub("", raw)
        if bare != raw and bare == bare.lower() or bare == bare.lower() and not any(w in _FULL or w in _SHORT for w in low.split()):
            return "role:" + plain(bare), 0
        raw = _KEPT_CAMEL.sub(lambda m: m.group(1).lower(), raw)
        raw = _CAMEL.sub(" ", raw)
        raw = re.sub(r"(?<=\w)[-‐’'](?=\w)", "", raw)
        comma = None
        words = []
        generation = ""
        for part in re.split(r"(,)|[\s.]+", raw):
            if not part:
                continue
            if part == ",":
                comma = len(words) if comma is None else comma
                continue
            w = re.sub(r"[^\w]", "", plain(part))
            if w in GENERATIONS:
                generation = {"junior": "jr", "senior": "sr"}.get(w, w)
            elif w and (w not in TITLES or len(raw.split()) == 1):
                words.append(w)
        if comma is not None and 0 < comma < len(words):
            words = words[comma:] + words[:comma]
        if not words:
            return None
        if len(words) > 1 and len(words[-1]) <= 2 < len(words[0]):
            words = words[1:] + words[:1] if len(words) == 2 else words
        norm = " ".join(words) + "|" + generation
        return norm, level_of(kind, norm)
    raw = re.sub(r"\([^)]*\)", " ", raw)
    if re.fullmatch(r"[A-Z]{3,7}", raw.strip()):
        return "acr:" + raw.strip().lower(), 1
    raw = _CAMEL.sub(" ", re.sub(r"\bGmbH\b", "gmbh", raw)).replace("&", " and ")
    parts = [[w for w in re.split(r"[^\w]+", plain(p)) if w] for p in raw.split(",")]
    parts = [p for p in parts if p]
    while len(parts) > 1 and set(parts[-1]) <= LEGAL:
        parts.pop()
    words = [w for p in reversed(parts) for w in p] if len(parts) == 2 else [w for p in parts for w in p]
    while len(words) > 1 and words[-1] in LEGAL:
        words.pop()
    told = [w for w in words if w not in EMPTY_WORDS or w in AND_WORDS]
    if len(told) > 1 and told[0] == "university":
        told = told[1:] + told[:1]
    kept = [SHORT_WORDS.get(w, w) for w in told if w not in AND_WORDS]
    # Numbers of words before each "and" between two parts; the order of such parts is free.
    ands = {sum(w not in AND_WORDS for w in told[:i]) for i, w in enumerate(told) if w in AND_WORDS} if kept else set()
    words = kept or words
    tail = ",".join(str(k) for k in sorted(ands) if 0 < k < len(words))
    return (" ".join(words) + "|" + tail, 3 if len(words) > 1 else 1) if words else None


@lru_cache(100_000)
def pieces(word: str) -> frozenset[str]:
    """Beginnings and ends of a word, so long that one slip leaves one of them as it was.

    Their size follows the word's length; words at a change of size have pieces of both, since a slip may change the
    length by one. In four letters a swap in the middle changes both ends, and three have no such ends: these words
    also have keys with one letter out (three letters as they are, since only a fourth one may be lost or added).
    """
    n = len(word)
    if n < 4:
        return frozenset({"=" + word})
    sizes = {2 if m <= 5 else 3 if m <= 8 else 4 for m in (n - 1, n, n + 1)}
    out = {"=" + word[:i] + word[i + 1 :] for i in range(n)} if n == 4 else set()
    return frozenset({"<" + word[:k] for k in sizes} | {">" + word[-k:] for k in sizes} | out)


def initials(word: str) -> set[str]:
    """The initial of a word and of the names it may be short for."""
    return {word[0]} | {f[0] for f in _FULL.get(word, ())}


def blocking(kind: str, norm: str, roles: str) -> set[str]:
    """Keys of a spelling in the roles asked for: ``b`` to meet others of several words (a piece of one word with the
    initial of the other), ``s`` for single words and acronyms to seek, ``f`` to be found by those."""
    if norm.startswith("acr:"):
        return {norm} if "s" in roles else set()
    words = norm.partition("|")[0].split()
    if len(words) == 1:
        return set(pieces(words[0])) if "s" in roles else set()
    a, b = words[0], words[-1]
    keys: set[str] = set()
    if "b" in roles:
        # An organisation's words may stand in another order: every one with the initial of every other.
        ends = ((a, b), (b, a)) if kind == "PERSON" else ((words[i], words[j]) for i in range(len(words)) for j in range(len(words)) if i != j)
        keys |= {f"{p}{i}" for w, o in ends for p in pieces(w) for i in initials(o)}
    if "f" in roles:
        keys |= pieces(a) | (pieces(b) if kind == "PERSON" else {"acr:" + "".join(w[0] for w in words)})
        if kind == "PERSON":
            keys |= {p for w in _SHORT.get(a, ()) for p in pieces(w)}
    return keys


def word_slip(a: str, b: str) -> float | None:
    if a == b:
        return 0.0
    return SLIP if min(len(a), len(b)) >= 3 and max(len(a), len(b)) >= 4 and within_one(a, b) else None


def given_slip(a: str, b: str) -> float | None:
    """Log likelihood that one given name was typed for the other, in either direction."""
    same = word_slip(a, b)
    if same is not None:
        return same
    if len(a) > len(b):
        a, b = b, a
    if len(a) <= 3 and b.startswith(a):
        return CUT
    fa, fb = _FULL.get(a, set()), _FULL.get(b, set())
    if b in fa or a in fb or fa & fb:
        return NICK
    if any(within_one(f, b) for f in fa) or any(within_one(f, a) for f in fb):
        return NICK + SLIP
    return None


def person_likelihood(v: str, c: str) -> tuple[float, bool] | None:
    """Log likelihood that the two spellings stand for one person, and whether one of them tells too little to be sure."""
    (v, _, gv), (c, _, gc) = v.partition("|"), c.partition("|")
    if gv and gc and gv != gc:
        return None
    generation = 0.0 if gv == gc else -1.0
    x, y = v.split(), c.split()
    if len(x) == 1 or len(y) == 1:
        one, many = (x[0], y) if len(x) == 1 else (y[0], x)
        if len(many) == 1:
            s = word_slip(one, many[0])
            return None if s is None else (s + generation, gv != gc)
        options = [word_slip(one, many[-1]), given_slip(one, many[0]) if len(one) > 2 else None]
        options = [o for o in options if o is not None]
        return (max(options) - 1.0 + generation, True) if options else None
    best = None
    for words, turn in ((x, 0.0), (x[1:] + x[:1], TURNED)):
        family = word_slip(words[-1], y[-1])
        given = given_slip(words[0], y[0]) if family is not None else None
        if given is None:
            continue
        total = family + given + turn
        a, b = words[1:-1], y[1:-1]
        if a and b:
            middle = given_slip(a[0], b[0])
            if middle is None:
                continue
            total += middle
        total += DROPPED * abs(len(a) - len(b))
        best = total if best is None else max(best, total)
    if best is None:
        return None
    short = (min(len(x[0]), len(x[-1])) <= 2) != (min(len(y[0]), len(y[-1])) <= 2)
    return best + generation, short or gv != gc


def turned_bodies(norm: str) -> list[list[str]]:
    """The words of an organisation's spelling with the parts around one "and" in the other order, for every end of the second part."""
    name, _, ands = norm.partition("|")
    words = name.split()
    return [words[k:end] + words[:k] + words[end:] for k in map(int, filter(None, ands.split(","))) for end in range(k + 1, len(words) + 1)]


def body_likelihood(v: str, c: str) -> tuple[float, bool] | None:
    """The same for two spellings of organisations: a part of a name, a bare word or an acronym isn't sure by itself."""
    if v.startswith("acr:") or c.startswith("acr:"):
        short, other = (v[4:], c) if v.startswith("acr:") else (c[4:], v)
        if other.startswith("acr:"):
            return None
        return (CUT - 1.0, True) if short == "".join(w[0] for w in other.partition("|")[0].split()) else None
    x, y = v.partition("|")[0].split(), c.partition("|")[0].split()
    straight = _parts_likelihood(x, y)
    if straight is not None and straight[0] >= TURNED:
        return straight
    turned = [_parts_likelihood(t, y) for t in turned_bodies(v)] + [_parts_likelihood(x, t) for t in turned_bodies(c)]
    options = [(got[0] + TURNED, got[1]) for got in turned if got is not None] + ([straight] if straight is not None else [])
    return max(options, key=lambda got: got[0]) if options else None


def _parts_likelihood(x: list[str], y: list[str]) -> tuple[float, bool] | None:
    """Words of two organisations one by one, in the order given."""
    if len(x) > len(y):
        x, y = y, x
    total = 0.0
    for a, b in zip(x, y, strict=False):
        s = word_slip(a, b)
        if s is None and min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
            s = CUT
        if s is None:
            joined = word_slip("".join(x), "".join(y))
            return None if joined is None else (joined, False)
        total += s
    return total + 2 * DROPPED * (len(y) - len(x)), len(x) != len(y)


def likelihood(kind: str, v: str, c: str) -> tuple[float, bool] | None:
    got = person_likelihood(v, c) if kind == "PERSON" else body_likelihood(v, c)
    return got if got is not None and got[0] > UNKNOWN else None


def level_of(kind: str, norm: str) -> int:
    """How much a spelling tells: 3 a full name, 2 initials, 1 a single word or an acronym, 0 a role or oneself."""
    if norm.startswith(("self:", "role:")):
        return 0
    words = norm.partition("|")[0].split()
    return 1 if norm.startswith("acr:") or len(words) == 1 else 2 if kind == "PERSON" and len(words[0]) <= 2 else 3


def spelling_id(norm: str = "norm"):
    """Number of a spelling inside its graph (64 bits of its kind and normal form)."""
    return F.xxhash64("kind", norm)


def typed_forms(nodes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``graph_id, kind, id, norm, level, name_norm, name_level``: a node's forms (``norm``), the name's own among them."""
    graph, ident = dict(nodes.dtypes)["graph_id"], dict(nodes.dtypes)["id"]
    named = nodes.where(F.col("kind").isin(*kinds) & F.col("id").isNotNull() & F.col("graph_id").isNotNull())
    rows = named.select("graph_id", "kind", "id", "name", F.array_sort(F.array_distinct(F.array_compact(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("aliases")).distinct()
    columns = ["graph_id", "kind", "id", "norm", "level", "name_norm", "name_level"]

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, k, i, name, aliases in pdf.itertuples(index=False, name=None):
                own = parse(k, name or "") or ("", -1)
                forms = {own} | {f for a in aliases for f in [parse(k, a)] if f}
                out += [(g, k, i, n, level, *own) for n, level in sorted(forms) if n]
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(normal, f"graph_id {graph}, kind string, id {ident}, norm string, level int, name_norm string, name_level int")


def scored_pairs(spellings: DataFrame) -> DataFrame:
    """``graph_id, v, c, level, score, weak``: spellings that may stand for the same one, each pair once.

    ``v`` is the one that tells less, ``level`` how much.
    """
    graph = dict(spellings.dtypes)["graph_id"]

    def keys_of(roles: str) -> DataFrame:
        def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(g, k, n, key) for g, k, n in zip(pdf["graph_id"], pdf["kind"], pdf["norm"], strict=True) for key in blocking(k, n, roles)]
                yield pd.DataFrame(rows, columns=["graph_id", "kind", "norm", "key"])

        level = {"b": "level > 1", "s": "level = 1"}.get(roles, "true")
        made = spellings.where(level).select("graph_id", "kind", "norm").mapInPandas(keyed, f"graph_id {graph}, kind string, norm string, key string")
        # A 32-bit hash: what it mixes up inside a graph is told apart by the score.
        return made.select("graph_id", F.hash("kind", "key").alias("key"), F.col("kind") == "PERSON", F.col("norm")).toDF("graph_id", "key", "person", "norm")

    def meeting(left: DataFrame, right: DataFrame, condition: str) -> DataFrame:
        a, b = left.withColumnRenamed("norm", "a"), right.withColumnRenamed("norm", "b")
        met = a.join(b, ["graph_id", "key", "person"]).where(condition)
        return met.select("graph_id", F.when(F.col("person"), "PERSON").otherwise("ORG").alias("kind"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    several, single = keys_of("b"), keys_of("s")
    pairs = meeting(several, several, "a < b").unionByName(meeting(single, keys_of("sf"), "a <> b")).distinct()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, k, a, b in pdf[["graph_id", "kind", "a", "b"]].itertuples(index=False, name=None):
                if (got := likelihood(k, a, b)) is not None:
                    la, lb = level_of(k, a), level_of(k, b)
                    less, more = (a, b) if (la, len(a), a) <= (lb, len(b), b) else (b, a)
                    out.append((g, k, less, more, min(la, lb), got[0], got[1]))
            yield pd.DataFrame(out, columns=["graph_id", "kind", "v", "c", "level", "score", "weak"])

    found = pairs.mapInPandas(score, f"graph_id {graph}, kind string, v string, c string, level int, score double, weak boolean")
    return found.select("graph_id", spelling_id("v").alias("v"), spelling_id("c").alias("c"), "level", "score", "weak")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``graph_id, sid, entity`` of all ends of ``edges`` (``graph_id, a, b``): the least number of each connected component.

    Repeated minimum of neighbours; only linked spellings take part. Wide components don't take a round per link: from
    the third round on, a label hears what its bearers heard, and bearers jump to their label's label. Ends when nothing
    moves; labels not settled after ``rounds`` raise an error.
    """
    ways = checkpointed(edges.select("graph_id", "a", "b").unionByName(edges.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = ways.groupBy("graph_id", F.col("a").alias("sid")).agg(F.min("b").alias("m")).select("graph_id", "sid", F.least("sid", "m").alias("entity"))
    for turn in range(rounds):
        heard = ways.join(labels.withColumnRenamed("sid", "b"), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("sid")).agg(F.min("entity").alias("told"))
        if turn >= 2:
            heard = checkpointed(labels.join(heard, ["graph_id", "sid"]))
            hooked = heard.select("graph_id", "sid", "told").unionByName(heard.where("told < entity").select("graph_id", F.col("entity").alias("sid"), "told"))
            hooked = checkpointed(labels.join(hooked.groupBy("graph_id", "sid").agg(F.min("told").alias("told")), ["graph_id", "sid"]).select("graph_id", "sid", F.col("entity").alias("was"), F.least("entity", "told").alias("entity")))
            beyond = hooked.select("graph_id", F.col("sid").alias("entity"), F.col("entity").alias("beyond"))
            after = checkpointed(hooked.join(beyond, ["graph_id", "entity"]).select("graph_id", "sid", F.least("entity", "beyond").alias("entity"), (F.least("entity", "beyond") < F.col("was")).alias("moved")))
        else:
            after = checkpointed(labels.join(heard, ["graph_id", "sid"], "left").select("graph_id", "sid", F.least("entity", "told").alias("entity"), (F.col("told") < F.col("entity")).alias("moved")))
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components haven't settled after {rounds} rounds")


def _attach(links: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """``links`` (``graph_id, a, b``) with those entities added that the evidence (``v, c, score``) sends to one other entity alone."""

    def entity_of(df: DataFrame, spelling: str, entity: str) -> DataFrame:
        known = entities.select("graph_id", F.col("sid").alias(spelling), F.col("entity").alias("_e"))
        return df.join(known, ["graph_id", spelling], "left").withColumn(entity, F.coalesce("_e", spelling)).drop("_e")

    seen = entity_of(entity_of(evidence, "v", "ev"), "c", "ec").where("ev <> ec").groupBy("graph_id", "ev", "ec").agg(F.max("score").alias("score"))
    w = Window.partitionBy("graph_id", "ev")
    share = F.exp("score") / (F.sum(F.exp("score")).over(w) + F.exp(F.lit(UNKNOWN)))
    sure = seen.withColumn("share", share).where(F.col("share") >= SURE)
    return links.unionByName(sure.select("graph_id", F.col("ev").alias("a"), F.col("ec").alias("b")))


def attributed(nodes: DataFrame, kinds: tuple[str, ...] = ("PERSON", "ORG")) -> DataFrame:
    """The entity of each named node: distinct ``graph_id, kind, id, entity``.

    Defined cases: blank and null names or aliases aren't spellings (a node without a name gives no row); repeated
    rows count once; spellings without letters or digits are ignored; a role that several people of a graph carry, and
    a part of a name that fits several entities, is attached to none; an empty table gives no rows.
    """
    typed = typed_forms(nodes, kinds)
    # Kept small: the texts are parsed a second time for the spellings rather than stored.
    forms = checkpointed(typed.select("graph_id", "kind", "id", "level", "name_level", spelling_id().alias("sid"), spelling_id("name_norm").alias("name_sid")))
    uses = checkpointed(typed.where("level > 0").groupBy("graph_id", "kind", "norm", "level").agg(F.count(F.lit(1)).alias("uses")))
    pairs = checkpointed(scored_pairs(uses))
    # Prior of a spelling: its uses and the spellings that it explains without doubt. Only spellings in pairs need one.
    sure = pairs.where("not weak")
    ways = sure.select("graph_id", F.col("v").alias("sid"), F.col("c").alias("other"), "score").unionByName(sure.select("graph_id", F.col("c").alias("sid"), F.col("v").alias("other"), "score"))
    count = uses.select("graph_id", spelling_id().alias("sid"), "uses")
    prior = ways.groupBy("graph_id", "sid").agg(F.count(F.lit(1)).alias("explained")).join(count, ["graph_id", "sid"]).select("graph_id", "sid", (F.col("uses") + F.col("explained")).alias("p"))
    higher = ways.join(prior.withColumnRenamed("p", "p0"), ["graph_id", "sid"]).join(prior.select("graph_id", F.col("sid").alias("other"), F.col("p").alias("p1")), ["graph_id", "other"]).where("p1 > p0 or (p1 = p0 and other < sid)")
    best = higher.groupBy("graph_id", "sid").agg(F.max(F.struct((F.log("p1") + F.col("score")).alias("posterior"), "other")).alias("m"))
    links = best.select("graph_id", F.col("sid").alias("a"), F.col("m.other").alias("b"))
    # A full alias names the same one as the node's full name; a lesser alias is evidence.
    alias = forms.where("sid <> name_sid and level > 0 and name_level > 0")
    links = checkpointed(links.unionByName(alias.where("level = 3 and name_level = 3").select("graph_id", F.col("sid").alias("a"), F.col("name_sid").alias("b"))))
    weak = pairs.where("weak").select("graph_id", "v", "c", "level", "score").unionByName(alias.where("level < 3").select("graph_id", F.col("sid").alias("v"), F.col("name_sid").alias("c"), "level", F.lit(0.0).alias("score")))
    entities = components(links)
    for step in ("level >= 2", "level = 1"):
        links = checkpointed(_attach(links, entities, weak.where(step)))
        entities = components(links)
    known = forms.where("sid = name_sid and level > 0").select("graph_id", "kind", "id", "sid").join(entities, ["graph_id", "sid"], "left").select("graph_id", "kind", "id", F.coalesce("entity", "sid").alias("entity"))
    # Roles: the one person of the graph who carries the role as an alias; without any, nodes of one role are one.
    carried = forms.where("level = 0 and name_level > 0").select("graph_id", "kind", F.col("sid").alias("role"), F.col("name_sid").alias("sid")).join(entities, ["graph_id", "sid"], "left")
    holder = carried.groupBy("graph_id", "kind", "role").agg(F.min(F.coalesce("entity", "sid")).alias("holder"), F.countDistinct(F.coalesce("entity", "sid")).alias("holders"))
    placed = forms.where("level = 0 and sid = name_sid").select("graph_id", "kind", "id", F.col("sid").alias("role")).join(holder, ["graph_id", "kind", "role"], "left")
    alone = F.when(F.col("holders").isNull(), F.col("role")).when(F.col("holders") == 1, F.col("holder")).otherwise(F.xxhash64("role", "id"))
    return known.unionByName(placed.select("graph_id", "kind", "id", alone.alias("entity"))).distinct()


def same_entity_pairs(nodes: DataFrame) -> DataFrame:
    """All pairs ``id_a < id_b`` of nodes of one graph and kind, PERSON or ORG, that mean the same one."""
    found = attributed(nodes).select("graph_id", "kind", "entity", "id").distinct()
    # Only entities of several nodes take part in the pairing.
    several = checkpointed(found.join(found.groupBy("graph_id", "kind", "entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["graph_id", "kind", "entity"]).drop("n"))
    a, b = several.withColumnRenamed("id", "id_a"), several.withColumnRenamed("id", "id_b")
    return a.join(b, ["graph_id", "kind", "entity"]).where("id_a < id_b").select("id_a", "id_b").distinct()
