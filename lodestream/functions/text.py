"""Scalar text functions of the evidence pipeline, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spellings of trial phases, upper case without blanks, hyphens and underscores, and the code of each.
PHASES = {
    "PHASE1": "PHASE1", "PHASEI": "PHASE1", "P1": "PHASE1", "1": "PHASE1",
    "PHASE2": "PHASE2", "PHASEII": "PHASE2", "P2": "PHASE2", "2": "PHASE2",
    "PHASE3": "PHASE3", "PHASEIII": "PHASE3", "P3": "PHASE3", "3": "PHASE3",
    "PHASE4": "PHASE4", "PHASEIV": "PHASE4", "P4": "PHASE4", "4": "PHASE4",
    "EARLYP1": "EARLY_PHASE1", "EARLYPHASE1": "EARLY_PHASE1",
}
#: Spellings of study types.
STUDY_TYPES = {
    "INTERVENTIONAL": "INTERVENTIONAL", "INT": "INTERVENTIONAL", "OBSERVATIONAL": "OBSERVATIONAL", "OBS": "OBSERVATIONAL",
    "EXPANDED_ACCESS": "EXPANDED_ACCESS",
}


def _lookup(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def phase_code(c: Column) -> Column:
    """A known spelling's code, read without case, blanks, hyphens and underscores; another spelling in upper case; null stays null."""
    return F.coalesce(_lookup(PHASES, F.translate(F.upper(c), " -_", "")), F.upper(c))


def study_type_code(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.coalesce(_lookup(STUDY_TYPES, t), t)


def sentences(c: Column, least: int = 10) -> Column:
    """Sentences of at least ``least`` characters; cut after . ! ? and blanks, and at line ends."""
    parts = F.split(F.trim(c), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda s: F.length(s) >= least)


def occurrences(text: Column, part: Column) -> Column:
    """Number of occurrences that do not overlap; 0 for an empty part."""
    n = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) > 0, n.cast("int")).otherwise(0)


def chunks_at_blanks(text: Column, size: int = 1500) -> Column:
    """Chunks of ``size`` characters, each extended to the next blank or line end."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{size}}}[^ \n]*|.+"), F.lit(0))


def chunk_spans(df: DataFrame, key: str, text: str, size: int = 1500) -> DataFrame:
    """(key, chunk, start, text): the chunks of each text with the place of their first character; null texts have none."""
    cut = df.select(key, F.posexplode(chunks_at_blanks(F.col(text), size)).alias("chunk", "text"))
    w = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select(key, "chunk", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("start"), "text")


def rebased(place: Column, start: Column) -> Column:
    """A place in a chunk as a place in the whole text."""
    return place + start


def content_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(c))


def canonical_hash(*pairs: tuple[str, Column]) -> Column:
    """First 16 hexadecimal digits of SHA-256 over sorted name=value pairs; lists sorted, texts trimmed."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.trim(v), F.lit(""))) for k, v in sorted(pairs, key=lambda p: p[0])]
    return F.substring(F.sha2(F.concat_ws(";", *parts), 256), 1, 16)


def title_case(c: Column) -> Column:
    """Capital after any character that is no letter (initcap only knows blanks)."""
    chars = F.split(F.lower(c), "")
    marked = F.transform(
        chars,
        lambda ch, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(ch)).otherwise(ch),
    )
    return F.array_join(marked, "")


def application_type(c: Column) -> Column:
    """NDA, ANDA or BLA from an application number's first letters, else null."""
    t = F.regexp_extract(F.upper(c), "^(NDA|ANDA|BLA)", 1)
    return F.when(t != "", t)


def unquoted(c: Column) -> Column:
    """Without one pair of double, then one pair of single quotes."""
    a = F.when((F.length(c) >= 2) & c.startswith('"') & c.endswith('"'), c.substr(F.lit(2), F.length(c) - 2)).otherwise(c)
    return F.when((F.length(a) >= 2) & a.startswith("'") & a.endswith("'"), a.substr(F.lit(2), F.length(a) - 2)).otherwise(a)


def truncated(c: Column, limit: int = 200) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)


def listed(c: Column, sep: str = "|") -> Column:
    """Parts of a joined text, trimmed, without blanks; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), F.lit(f"[{sep}]")), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def quoted(c: Column) -> Column:
    """A text as a double-quoted scalar of YAML and JSON."""
    out = c
    for ch, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(ch), F.lit(code))
    return F.concat(F.lit('"'), out, F.lit('"'))


def yaml_block(fields: dict[str, Column], texts: set[str]) -> Column:
    """One ``name: value`` per line in the given order, without the null ones; ``texts`` are quoted."""
    lines = [F.concat(F.lit(f"{k}: "), quoted(c) if k in texts else c.cast("string")) for k, c in fields.items()]
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n"))
