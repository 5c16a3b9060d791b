"""Linking the variant spellings of names typed by people, by suffix blocking.

1. Each distinct spelling is read into parts: what does not tell entities apart (legal form, department,
   title, dose, form, salt, remark) falls away; kind of institution, given name, surname or the components
   of a combination stay. What remains of each part is its *core*, without accents, blanks and case.
2. Cores of one class are compared where they share a suffix of half their length, read from either end:
   one slip of the pen leaves one half intact, and any longer suffix in common implies this one. A suffix
   held by more than ``common`` cores is refined with the rest of the core, once for each character left out
   of it: cores one slip apart share one of these, and so few strings can that no block is large.
   Nothing is discarded, so no pair one slip apart is missed.
3. Pairs are kept by the ratio of their longest common subsequence.
4. A core joins the best supported core it is linked to, unless it is an entity of its own: typed in several
   ways itself, and by share of spellings and of rows nearly as common as the other. Only shares count, so
   more of the same data links the same. Abbreviations and initials join the best supported core or given
   name that they begin.
5. Spellings with the same resolved parts are one class.

Defined cases: null and empty names have no class; names that leave no core stand for themselves as
typed, folded; repeated rows only add support.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.session import cut_lineage

#: Least share of the longest common subsequence in two cores: 2 * lcs / (sum of lengths).
MIN_RATIO = 0.87
#: Characters in which the longer of two linked cores may differ from what they share.
MAX_SLIPS = 1
#: Shorter cores are only equal or not.
MIN_CORE = 4
#: A suffix held by more cores than this is refined.
COMMON = 40
#: A core with more than this share of the other's spellings and of its rows is an entity of its own ...
OWN_SHARE = 0.9
#: ... if it is typed in this many ways at least: fewer say nothing about shares.
OWN_SPELLINGS = 4

# Legal forms of companies.
LEGAL = "ab ag as bv co company corp corporation gmbh inc incorporated kg kk limited llc llp lp ltd nv oy plc pty sa sarl se spa srl".split()
# Words for kinds of institutions, with abbreviations.
KINDS = {
    "university": "university univ u uni universitat universite universidad universita college".split(),
    "hospital": "hospital hosp hospitals clinic clinics infirmary".split(),
    "institute": "institute inst institut instituto center centre ctr".split(),
    "company": (
        "pharmaceuticals pharmaceutical pharma pharm pharmaceutica therapeutics therapeutic thera ther biosciences bioscience "
        "biosci sciences laboratories laboratory labs lab biotech biotechnology biologics biopharma devices device dev diagnostics"
    ).split(),
    "other": "consortium network foundation council ministry society association group agency department".split(),
}
# Words that qualify an institution without telling it from others.
QUALIFIERS = "general gen cancer ca medical med bio the of for and de der la school medicine faculty clinical operations europe usa international global trust division dept department research ci".split()
# Titles and degrees of persons.
TITLES = "dr prof professor md phd mr mrs ms miss sir dds do rn msc bsc mph".split()
# Short forms of given names.
NICKNAMES = {
    "al": "albert", "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "andy": "andrew", "drew": "andrew",
    "tony": "anthony", "ben": "benjamin", "kathy": "katherine", "kate": "katherine", "katie": "katherine", "kat": "katherine",
    "charlie": "charles", "chuck": "charles", "chris": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david",
    "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy", "ed": "edward", "eddie": "edward", "ted": "theodore",
    "teddy": "theodore", "theo": "theodore", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth",
    "lisa": "elizabeth", "fran": "francesca", "frannie": "francesca", "cesca": "francesca", "frank": "francis", "gabe": "gabriel",
    "gabi": "gabriel", "george": "georg", "greg": "gregory", "lupe": "guadalupe", "lupita": "guadalupe", "hans": "johannes",
    "johann": "johannes", "jannes": "johannes", "jack": "john", "jim": "james", "jimmy": "james", "joe": "joseph", "jon": "jonathan",
    "larry": "lawrence", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "matt": "matthew",
    "mike": "michael", "nick": "nikolaus", "klaus": "nikolaus", "niko": "nikolaus", "claus": "nikolaus", "pat": "patricia",
    "pete": "peter", "dick": "richard", "rick": "richard", "rich": "richard", "ricky": "richard", "bob": "robert", "bobby": "robert",
    "rob": "robert", "bert": "robert", "sam": "samuel", "steve": "stephen", "sue": "susan", "tom": "thomas", "vera": "veronica",
    "ronnie": "veronica", "vicky": "victoria", "bill": "william", "billy": "william", "will": "william", "willy": "william",
}
# Forms of drugs, salts and remarks that make no other drug.
DRUG_WORDS = """
tablet tablets tab tabs capsule capsules cap caps injection injections inj infusion infusions solution solutions sol oral
intravenous iv im sc po cream gel ointment patch spray syrup suspension drops powder vial pill pills film coated extended release
hydrochloride hcl acetate mesylate citrate sodium potassium phosphate sulfate sulphate tartrate maleate fumarate succinate
hydrobromide besylate tosylate chloride bromide nitrate calcium magnesium monohydrate dihydrate anhydrous
generic investigational arm drug study experimental treatment dose doses daily weekly once twice bid tid qd of the a
mg mcg ug g kg ml l iu units unit day
""".split()

_LEGAL, _QUAL, _TITLES, _DRUG = map(frozenset, (LEGAL, QUALIFIERS, TITLES, DRUG_WORDS))
_KIND_OF = {w: k for k, ws in KINDS.items() for w in ws}
_DOSE = re.compile(r"\d+(?:[.,]\d+)?\s*(?:mg|mcg|µg|ug|g|kg|ml|l|iu|units?|%)(?:\s*/\s*(?:\d+\s*)?(?:ml|l|day|d|kg|m2|h|hour|week|dose))?\b|\d+(?:[.,]\d+)?\s*%", re.I)
_PAREN = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_COMBINE = re.compile(r"\s*[+/&,;]\s*|\s+(?:and|plus|with)\s+")
_SA = re.compile(r"\bs\.\s?([apl])\.(?:\s?([aslr])\.)?|\bs\s+a\s*$")


def fold(text: str) -> str:
    """Lower case without accents; runs of blanks of any kind become one."""
    t = unicodedata.normalize("NFKD", text)
    t = "".join(ch for ch in t if not unicodedata.combining(ch) and unicodedata.category(ch) != "Cf")
    return " ".join(t.casefold().split())


def read_sponsor(name: str) -> list[tuple]:
    """[(class, core, given, is_prefix)] of an organisation or a person."""
    t = _PAREN.sub(" ", fold(name))
    t = re.sub(r"\bmed(?:ical|\.)? dev(?:ices?|\.)?(?=[\s,.]|$)", " devices ", t)
    t = re.sub(r"\bbio sciences?\b", " biosciences ", t)
    t = _SA.sub(" sa ", t)
    comma = "," in t
    words = re.findall(r"[a-z0-9]+", t)
    kinds = [_KIND_OF[w] for w in words if w in _KIND_OF]
    legal = any(w in _LEGAL for w in words[1:])
    if kinds or legal:
        order = ("university", "hospital", "institute", "company", "other")
        kind = next((k for k in order if k in kinds), "company")
        core = "".join(w for w in words if w not in _KIND_OF and w not in _LEGAL and w not in _QUAL)
        return [(kind, core or "".join(words), "", False)]
    if comma:  # "Given Surname, MD" is no inversion
        head, _, tail = t.partition(",")
        comma = any(w not in _TITLES for w in re.findall(r"[a-z0-9]+", tail)) and bool(head.strip())
    words = [w for w in words if w not in _TITLES]
    if len(words) < 2:
        return [("other", "".join(words) or fold(name), "", False)]
    if comma:
        surname, given = words[0], words[1]
    elif len(words[-1]) == 1:
        surname, given = words[0], words[-1]
    else:
        surname, given = words[-1], words[0]
    return [("person", surname, NICKNAMES.get(given, given), len(given) == 1)]


def read_drug(name: str) -> list[tuple]:
    """[(class, core, '', is_prefix)] of each component of a drug or intervention."""
    whole = fold(name)
    t = _DOSE.sub(" ", _PAREN.sub(" ", whole))
    out = []
    for part in _COMBINE.split(t):
        words = re.findall(r"[^\W_]+\.?", part)
        kept = [w for w in words if w.rstrip(".") not in _DRUG and not w[0].isdigit()]
        if not kept:
            continue
        core = "".join(w.rstrip(".") for w in kept)
        short = len(kept) == 1 and kept[0].endswith(".") and len(core) >= 4
        out.append(("drug", core, "", short))
    if not out:
        out = [("drug", "".join(re.findall(r"[^\W_]+", whole)) or whole, "", False)]
    return sorted(set(out))


_READERS = {"sponsor": read_sponsor, "drug": read_drug}
_PART = "array<struct<cls:string,core:string,given:string,is_prefix:boolean>>"


def read_names(names: DataFrame) -> DataFrame:
    """(kind, name, n) -> the same with the parts that each name was read into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ("cls", "core", "given", "is_prefix")
        for pdf in batches:
            pdf["parts"] = [
                [dict(zip(cols, p, strict=True)) for p in _READERS[k](x)]
                for k, x in zip(pdf["kind"], pdf["name"], strict=True)
            ]
            yield pdf

    return names.select("kind", "name", "n").mapInPandas(run, f"kind string, name string, n bigint, parts {_PART}")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine operation per character of b."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        m = row & where.get(ch, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def similar(pairs: DataFrame, min_ratio: float = MIN_RATIO, max_slips: int = MAX_SLIPS) -> DataFrame:
    """Keeps the pairs (a, b) whose longest common subsequence is long enough; adds the ratio."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lcs = [lcs_length(a, b) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            la, lb = pdf["a"].str.len(), pdf["b"].str.len()
            pdf["ratio"] = 2.0 * pd.Series(lcs, index=pdf.index) / (la + lb)
            long = pd.concat([la, lb], axis=1).max(axis=1)
            yield pdf[(pdf["ratio"] >= min_ratio) & (long - pd.Series(lcs, index=pdf.index) <= max_slips)]

    # a slip in the sense of the subsequence costs at most two edits: a cheap and lossless first test
    near = pairs.filter(F.levenshtein("a", "b", 2 * max_slips) >= 0)
    return near.mapInPandas(run, f"{schema}, ratio double")


def _suffix_keys(core: Column) -> Column:
    """array of struct(key, rest): the half-length suffixes of a core from both ends and what stands before them.

    A pair one slip apart shares one of the keys, and its rests are one slip apart. Lengths follow the
    shorter core, so each core emits those for its own length and for one less.
    """
    n = F.length(core)

    def keys(end: str, size: Column) -> Column:
        half = F.greatest(F.lit(0), F.floor((size - 2) / 2).cast("int"))  # a swap touches two places
        key = F.right(core, half) if end == "suffix" else F.left(core, half)
        rest = F.left(core, n - half) if end == "suffix" else F.right(core, n - half)
        return F.struct(F.concat(F.lit(f"{end}:"), key).alias("key"), rest.alias("rest"))

    every = F.array(*(F.when(n - d >= MIN_CORE, keys(e, n - d)) for e in ("suffix", "prefix") for d in (0, 1)))
    return F.array_distinct(F.array_compact(every))


def _with_one_left_out(rest: Column) -> Column:
    """A text, and the text without each of its characters."""
    at = F.sequence(F.lit(1), F.length(rest))
    less = F.transform(at, lambda i: F.concat(F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, F.length(rest))))
    return F.array_distinct(F.concat(F.array(rest), less))


def candidate_pairs(forms: DataFrame, common: int = COMMON) -> DataFrame:
    """forms (cls, core) -> distinct (cls, a, b), a before b, that share a block."""
    keyed = forms.filter(F.length("core") >= MIN_CORE).select("cls", "core", F.inline(_suffix_keys(F.col("core"))))
    size = keyed.groupBy("cls", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = keyed.join(size, ["cls", "key"])
    blocks = sized.select(
        "cls",
        "core",
        F.explode(
            F.when(F.col("size") <= common, F.array("key")).otherwise(
                F.transform(_with_one_left_out(F.col("rest")), lambda r: F.concat("key", F.lit("|"), r))
            )
        ).alias("key"),
    )
    a, b = blocks.select("cls", "key", F.col("core").alias("a")), blocks.select("cls", "key", F.col("core").alias("b"))
    return (
        a.join(b, ["cls", "key"])
        .filter((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= MAX_SLIPS))
        .select("cls", "a", "b")
        .distinct()
    )


def _order(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}") for c in ("spellings", "n", "core")))


def resolve_cores(forms: DataFrame) -> DataFrame:
    """forms (cls, core, spellings, n) -> (cls, core, root).

    Each core points at its best supported link that is better supported than itself; support rises
    along the pointers, which are followed until none leads further.
    """
    links = similar(candidate_pairs(forms))
    both = links.select("cls", F.col("a").alias("core"), F.col("b").alias("to")).unionByName(
        links.select("cls", F.col("b").alias("core"), F.col("a").alias("to"))
    )
    own = forms.select("cls", "core", _order().alias("mine"))
    target = forms.select("cls", F.col("core").alias("to"), _order().alias("theirs"))
    mine, theirs = F.col("mine"), F.col("theirs")
    apart = (
        (mine["spellings"] >= OWN_SPELLINGS)
        & (mine["spellings"] > theirs["spellings"] * OWN_SHARE)
        & (mine["n"] > theirs["n"] * OWN_SHARE)
    )
    parent = (
        both.join(own, ["cls", "core"])
        .join(target, ["cls", "to"])
        .filter((theirs > mine) & ~apart)
        .groupBy("cls", "core")
        .agg(F.max_by("to", "theirs").alias("root"))
    )
    return follow_roots(
        forms.select("cls", "core").join(parent, ["cls", "core"], "left").select(
            "cls", "core", F.coalesce("root", "core").alias("root")
        )
    )


def follow_roots(pointers: DataFrame) -> DataFrame:
    """(cls, core, root) with each root replaced by the end of its chain; the steps double each time."""
    out = cut_lineage(pointers)
    while True:
        nxt = out.filter("core <> root").select("cls", F.col("core").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(out.join(nxt, ["cls", "root"], "left"))
        out = step.select("cls", "core", F.coalesce("further", "root").alias("root"))
        if step.filter("further is not null").isEmpty():
            return out


def _resolve_prefixes(shorts: DataFrame, roots: DataFrame, support: DataFrame) -> DataFrame:
    """Abbreviations (cls, core) -> (cls, core, root) of the best supported full core that they begin."""
    lengths = shorts.select("cls", F.length("core").alias("size")).distinct()  # a few numbers
    full = roots.join(support, ["cls", "core"]).join(F.broadcast(lengths), "cls").filter(F.length("core") > F.col("size"))
    heads = (
        full.groupBy("cls", F.left("core", F.col("size")).alias("core"))
        .agg(F.max_by("root", F.struct("n", F.col("core"))).alias("root"))
    )
    return shorts.join(heads, ["cls", "core"])


def link_names(names: DataFrame) -> DataFrame:
    """names (kind, name), rows as they come -> (kind, name, entity): one row per distinct name.

    kind says how to read the names: 'sponsor' or 'drug'. Names of one kind with one entity belong
    together; entity is built from the best supported spellings of the parts.
    """
    counted = names.filter("name is not null and name <> ''").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
    read = cut_lineage(read_names(counted))
    parts = read.select("kind", "name", "n", F.posexplode("parts").alias("i", "p")).select(
        "kind", "name", "n", "i", "p.cls", "p.core", "p.given", "p.is_prefix"
    )
    is_short = (F.col("cls") == "drug") & F.col("is_prefix")
    support = (
        parts.filter(~is_short)
        .groupBy("cls", "core")
        .agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"))
    )
    support = cut_lineage(support)
    roots = resolve_cores(support)
    shorts = parts.filter(is_short).select("cls", "core").distinct()
    by_prefix = _resolve_prefixes(shorts, roots, support.select("cls", "core", "n"))
    resolved = (
        parts.join(roots.withColumnRenamed("root", "r1"), ["cls", "core"], "left")
        .join(by_prefix.withColumnRenamed("root", "r2"), ["cls", "core"], "left")
        .withColumn("root", F.when(is_short, F.coalesce("r2", "r1", "core")).otherwise(F.coalesce("r1", "core")))
    )
    resolved = cut_lineage(resolved)  # read twice below
    # initials: the best supported full given name of the same surname that they begin
    people = resolved.filter("cls = 'person'")
    givens = (
        people.filter(F.length("given") > 1)
        .groupBy("root", "given")
        .agg(F.sum("n").alias("m"))
        .groupBy("root", F.left("given", F.lit(1)).alias("initial"))
        .agg(F.max_by("given", F.struct("m", "given")).alias("full"))
    )
    resolved = resolved.withColumn("initial", F.when((F.col("cls") == "person") & (F.length("given") == 1), F.col("given")))
    named = resolved.join(givens, ["root", "initial"], "left")
    part_key = F.concat_ws("|", "cls", "root", F.coalesce(F.col("full"), F.col("given")))
    return (
        named.select("kind", "name", part_key.alias("part"))
        .groupBy("kind", "name")
        .agg(F.array_join(F.array_sort(F.collect_set("part")), " + ").alias("entity"))
    )


def name_pairs(linked: DataFrame) -> DataFrame:
    """(kind, name_a, name_b) of all different names of one entity, name_a first by code points."""
    linked = cut_lineage(linked)  # read twice below
    a = linked.select("kind", "entity", F.col("name").alias("name_a"))
    b = linked.select("kind", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["kind", "entity"]).filter("name_a < name_b").select("kind", "name_a", "name_b")
