"""Text functions as column expressions: names, accessions, casts, term families and residue symbols."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accession grammar, empty-name tokens, domain synonyms, residue letters and groups, family terms
ACCESSION = r"(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|A0[A-Z0-9]{8}|[A-NR-Z][0-9][A-Z0-9]{3}[0-9])"
EMPTY_NAMES = ("", "na", "n/a", "none", ".", "null")
DOMAIN_SYNONYMS = {
    "archaea": ("archaea", "archaeal", "archaeota", "archaeon"),
    "bacteria": ("bacteria", "bacterial", "bacterium"),
    "eukaryota": ("eukaryota", "eukaryotic", "eukaryote", "eukarya"),
}
RESIDUE_LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
STRONG_GROUPS = ("STA", "NEQK", "NHQK", "NDEQ", "QHRK", "MILV", "MILF", "FYW")
WEAK_GROUPS = ("CSA", "ATV", "SAG", "STNK", "STPA", "SGND", "SNDEQK", "NDEQHK", "NEQHRK", "FVLIM", "HFY")
FAMILY_TERMS = (
    "gpcr", "g protein-coupled receptor", "g-protein coupled receptor", "g-protein-coupled receptor", "opsin", "rhodopsin", "olfactory", "vomeronasal", "taste",
    "pheromone", "frizzled", "purinoceptor", "odorant", "tastant", "7tm_gpcr_serpentine", "serpentine", "transmembrane 7 superfamily member", "G_PROTEIN_RECEP",
    "Gustatory", "OPSD", "CHEMOKINE RECEPTOR", "G PROTEIN-COUPLED", "FOLLICLE-STIMULATING HORMONE RECEPTOR", "CRE-SRX-10 PROTEIN", "-SRX", "GLUCOSE RECEPTOR", "GCR",
)
ANYWHERE = {"archaea": ("archaea", "archaeota"), "bacteria": ("bacteria",), "eukaryota": ("eukaryota", "eukaryote", "eukaryotic", "eukarya")}
SEVEN_TM_TERMS = ("7TM_GPCR", "7TM GPCR", "7TM-GPCR", "7TM_GPCR_SERPENTINE")
SEVEN_TM = r"\b7TM[_\-\s]?GPCR(?:\b|[_\-\s][A-Z0-9_]+)*"
IONIZABLE = ("ASP", "GLU", "HIS", "CYS", "LYS", "ARG", "MLY", "MLZ", "M3L")
POLAR = ("ASN", "GLN", "SER", "THR", "TYR", "TRP")
APOLAR = ("GLY", "ALA", "ILE", "LEU", "MET", "PHE", "PRO", "VAL")


def strip_all(c: Column) -> Column:
    """Without white space at the ends, of any Unicode kind."""
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


def clean_name(c: Column, empty: str | None = "UC") -> Column:
    """A name as one token: blanks of any kind and runs of _ become one _, outer _ go; tokens that mean nothing become `empty` (None keeps them)."""
    s = F.regexp_replace(F.regexp_replace(strip_all(F.coalesce(c, F.lit(""))), r"(?U)\s+", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return s if empty is None else F.when(F.lower(s).isin(*EMPTY_NAMES), F.lit(empty)).otherwise(s)


def first_token(c: Column, separators: Sequence[str]) -> Column:
    """The part before the first *listed* separator that occurs, stripped."""
    out = strip_all(c)
    chain = None
    for sep in separators:
        part = strip_all(F.split_part(c, F.lit(sep), F.lit(1)))
        chain = F.when(F.contains(c, F.lit(sep)), part) if chain is None else chain.when(F.contains(c, F.lit(sep)), part)
    return out if chain is None else chain.otherwise(out)


def accession(c: Column) -> Column:
    """The first accession in a text, null if there is none."""
    return F.nullif(F.regexp_extract(c, rf"\b({ACCESSION})\b", 1), F.lit(""))


def structure_accession(c: Column) -> Column:
    """Accession of a structure file or CSV field: after AF-, else ten characters, else six; an isoform's suffix goes."""
    tries = (rf"AF-({ACCESSION})", r"\b(A0[A-Z0-9]{8})\b", r"\b([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9][A-Z0-9]{3}[0-9])\b")
    return F.regexp_replace(F.coalesce(*[F.nullif(F.regexp_extract(c, t, 1), F.lit("")) for t in tries]), "-[0-9]+$", "")


def header_id(c: Column) -> Column:
    """Id of a sequence header: second | field of its first token, else the first accession anywhere."""
    token = F.split_part(c, F.lit(" "), F.lit(1))
    return F.coalesce(F.nullif(F.split_part(token, F.lit("|"), F.lit(2)), F.lit("")), accession(c))


def header_fields(c: Column) -> Column:
    """A five-field header (superkingdom|uid|gene|organism|rank) as a struct; null with fewer fields; an empty gene is UC."""
    parts = F.split(c, r"\|")
    at = lambda k: F.get(parts, F.lit(k))
    gene = F.when(at(2) == "", "UC").otherwise(at(2))
    return F.when(F.size(parts) >= 5, F.struct(at(0).alias("superkingdom"), at(1).alias("uid"), gene.alias("gene"), at(3).alias("organism"), at(4).alias("rank")))


def int_or(c: Column, default: int) -> Column:
    return F.coalesce(strip_all(c).try_cast("long"), F.lit(default))


def whole_of_float(c: Column, default: int) -> Column:
    """int(float(x)); what has no whole number (NaN, infinities, beyond 64 bits) is the default."""
    return F.coalesce(strip_all(c).try_cast("double").try_cast("long"), F.lit(default))


def float_or(c: Column, default: float | None) -> Column:
    return F.coalesce(strip_all(c).try_cast("double"), F.lit(default).cast("double"))


def evalue(c: Column) -> Column:
    """An evalue: empty and NA mean infinity, as does what can't be read."""
    return F.coalesce(F.when(~F.upper(strip_all(c)).isin("", "NA"), strip_all(c).try_cast("double")), F.lit(float("inf")))


def hex_int(c: Column) -> Column:
    """A fixed-width number: decimal, else hexadecimal."""
    s = strip_all(c)
    return F.coalesce(s.try_cast("int"), F.conv(s, 16, 10).try_cast("int"))


def term_pattern(term: str) -> str:
    """Java pattern of one family term on upper-cased text."""
    t = term.strip().upper()
    if t == "GCR":
        return r"\bGCR-?\d+\b"
    if t in SEVEN_TM_TERMS:
        return SEVEN_TM
    if re.fullmatch(r"[A-Z0-9_]{2,6}", t):
        return rf"\b{t}\b"
    return "".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in t)


def in_family(c: Column, terms: Sequence[str]) -> Column:
    """Whether the upper-cased text matches any term; no terms match nothing. Never null."""
    patterns = dict.fromkeys(term_pattern(t) for t in terms if t.strip())
    return F.coalesce(F.upper(c).rlike("|".join(patterns)), F.lit(False)) if patterns else F.lit(False)


def haystack(columns: Sequence[str]) -> Column:
    return F.upper(F.concat_ws(" ", *columns))


def domain_of(c: Column) -> Column:
    """archaea, bacteria, eukaryota or other: the first word of the first | field if it's a synonym, else the first of the three that is named anywhere."""
    low = F.lower(strip_all(F.regexp_replace(c, "^>+", "")))
    lead = F.regexp_extract(F.split_part(low, F.lit("|"), F.lit(1)), r"^(?U)\s*(\S+)", 1)
    chain = None
    for name, words in DOMAIN_SYNONYMS.items():
        chain = F.when(lead.isin(*words), name) if chain is None else chain.when(lead.isin(*words), name)
    for name, words in ANYWHERE.items():
        chain = chain.when(low.rlike("|".join(words)), name)
    return chain.otherwise("other")


def kingdom_prefix(c: Column) -> Column:
    s = F.lower(strip_all(c))
    return F.when(s.startswith("arch"), "archaea").when(s.startswith("bact"), "bacteria").when(s.startswith("euk"), "eukaryota").otherwise(s)


def one_letter(c: Column) -> Column:
    """Residue letter of a three-letter code; null if unknown."""
    return F.create_map(*[F.lit(x) for kv in RESIDUE_LETTERS.items() for x in kv])[F.upper(c)]


def side_chain_type(c: Column) -> Column:
    return F.when(c.isin(*IONIZABLE), "ionizable").when(c.isin(*POLAR), "polar").when(c.isin(*APOLAR), "apolar")


def pair_symbol(a: Column, b: Column) -> Column:
    """Symbol under two aligned residues: blank with a gap, * if equal (not X), : in a strong group, . in a weak one, else blank."""
    a, b = F.upper(a), F.upper(b)
    both = lambda groups: F.exists(F.array(*[F.lit(g) for g in groups]), lambda g: F.contains(g, a) & F.contains(g, b))
    return F.when((a == "-") | (b == "-"), " ").when((a == b) & (a != "X"), "*").when(both(STRONG_GROUPS), ":").when(both(WEAK_GROUPS), ".").otherwise(" ")


def letters_upper(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))


def clean_list(c: Column, separator: str = ";") -> Column:
    """Split, stripped, without empty parts, each part once and in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, separator), strip_all), lambda x: x != ""))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def half_up(c: Column, places: int = 2) -> Column:
    """Decimal rounding, halves away from zero."""
    return F.round(c.try_cast("decimal(38,18)"), places).cast(f"decimal(18,{places})")
