"""Text rules: station names, equipment words, equation ids, contract ids, token lists."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Generic words dropped from a station name before matching.
STATION_WORDS = ("substation sub terminal station switching switchyard zone bulk supply point ts zs ss s/s kv "
                 "power the transmission and").split()

# Words that name an equipment type in a description.
EQUIPMENT_WORDS = {
    "LINE": ["LINE", "FEEDER"],
    "CB": ["CB", "BREAKER"],
    "BUS": ["BUS", "BUSBAR"],
    "TRANS": ["TRANSFORMER", "TX", "TRANS", "XFMR", "TFMR"],
    "REAC": ["REACTOR", "REAC", "REACT", "CAPACITOR", "CAP", "SVC", "STATCOM"],
}

# Region names and short forms in price files.
REGION_NAMES = {"NEW SOUTH WALES": "NSW1", "NSW": "NSW1", "VICTORIA": "VIC1", "VIC": "VIC1",
                "QUEENSLAND": "QLD1", "QLD": "QLD1", "SOUTH AUSTRALIA": "SA1", "SA": "SA1"}


def station_name(name: Column) -> Column:
    """Lower-case letters only, without brackets, voltages and generic words."""
    plain = F.regexp_replace(F.lower(name), r"\([^)]*\)", " ")
    plain = F.regexp_replace(plain, r"[0-9]+(\.[0-9]+)?\s*kv", " ")
    plain = F.regexp_replace(plain, r"\b(" + "|".join(STATION_WORDS) + r")\b", " ")
    plain = F.regexp_replace(plain, "[^a-z ]", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def equipment_type(description: Column) -> Column:
    """Type named by the last recognised word; OTHER when none is."""
    lookup = F.create_map(*[F.lit(x) for kind, words in EQUIPMENT_WORDS.items() for w in words for x in (w, kind)])
    words = F.split(F.regexp_replace(F.upper(description), "-", " "), r"\s+")
    kinds = F.filter(F.transform(words, lambda w: F.try_element_at(lookup, w)), lambda k: k.isNotNull())
    return F.coalesce(F.try_element_at(kinds, F.lit(-1)), F.lit("OTHER"))


def leading_place(description: Column) -> Column:
    """Normalised leading words of a description, up to a digit or hyphen."""
    return station_name(F.regexp_extract(description, r"^\s*([A-Za-z][A-Za-z .']*)", 1))


def named_voltage(description: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(description), r"([0-9]+)\s*kv", 1), F.lit(""))


# What an equation id has to show (how, mark), in the order it is looked for, and the label it then has.
FAMILY_MARKS = [
    ("starts", "NRM", "negative residue management"),
    ("starts", "#", "manual/ramp"),
    ("has", ">>", "thermal"),
    ("early", ">", "thermal"),
    ("has", "^^", "voltage stability"),
    ("has", "::", "transient stability"),
    ("has", "<<", "oscillatory"),
    ("plain", "^([VNQSTI]-)?[A-Z0-9]+[-_]", "interconnector limit"),
]
STATE_MARKS = [
    ("starts", "NRM", "system normal"),
    ("starts", "#", "other"),
    ("holds", "NIL", "system normal"),
]
NO_FAMILY, NO_STATE, NO_ID = "other", "outage/other", "unreported"

_SHOWS = {
    "starts": lambda cid, mark: F.upper(cid).startswith(mark),
    "holds": lambda cid, mark: F.upper(cid).contains(mark),
    "has": lambda cid, mark: cid.contains(mark),
    "early": lambda cid, mark: F.left(cid, F.lit(3)).contains(mark),
    "plain": lambda cid, mark: cid.rlike(mark) & ~cid.rlike("[>^:<]"),
}


def _labelled(cid: Column, marks: list[tuple[str, str, str]], otherwise: str) -> Column:
    """The label of the first mark that an id shows."""
    found = F.array(*[F.when(_SHOWS[how](cid, mark), F.lit(label)) for how, mark, label in marks])
    return F.when(F.coalesce(cid, F.lit("")) == "", F.lit(NO_ID)).otherwise(F.coalesce(F.get(F.array_compact(found), F.lit(0)), F.lit(otherwise)))


def equation_family(cid: Column) -> Column:
    """Limit family from the marks inside an equation id."""
    return _labelled(cid, FAMILY_MARKS, NO_FAMILY)


def network_state(cid: Column) -> Column:
    """Whether an equation belongs to the system-normal set."""
    return _labelled(cid, STATE_MARKS, NO_STATE)


def contract_quarter(cid: Column) -> Column:
    return F.when(cid.rlike("C[0-9]{4}Q[0-9]T[0-9]{2}"), F.concat(
        F.regexp_extract(cid, "C([0-9]{4})Q([0-9])T([0-9]{2})", 1), F.lit("Q"),
        F.regexp_extract(cid, "C([0-9]{4})Q([0-9])T([0-9]{2})", 2)))


def contract_tranche(cid: Column) -> Column:
    return F.nullif(F.regexp_extract(cid, "C[0-9]{4}Q[0-9]T([0-9]{2})", 1), F.lit("")).cast("int")


def quarter_in_text(text: Column) -> Column:
    """Quarter written as Q3 2025, Q3-25 or 2025 Q3, as 2025Q3; the earliest mention wins."""
    found = F.regexp_extract(text, r"(?i)(Q[1-4][\s\-_']*(?:20)?[0-9]{2}|20[0-9]{2}[\s\-_]*Q[1-4])", 1)
    q = F.regexp_extract(found, "(?i)Q([1-4])", 1)
    year = F.when(F.upper(found).startswith("Q"), F.concat(F.lit("20"), F.right(found, F.lit(2)))).otherwise(
        F.left(found, F.lit(4)))
    return F.when(found != "", F.concat(year, F.lit("Q"), q))


def region_in_text(text: Column) -> Column:
    up = F.upper(text)
    names = sorted(REGION_NAMES, key=lambda k: -len(k))
    return reduce(lambda acc, k: acc.when(up.rlike(rf"\b{k}\b"), REGION_NAMES[k]), names[1:],
                  F.when(up.rlike(rf"\b{names[0]}\b"), REGION_NAMES[names[0]]))


def setter_class(code: Column, own: Column, outage_member: Column) -> Column:
    """Class of a limit-setting equation from its prefix and set membership flags."""
    return (F.when(own, "own_set").when(code.startswith("#"), "ramp_discretionary")
            .when(code.startswith("F_"), "fcas").when(outage_member, "other_outage_set")
            .otherwise("system_normal_other"))


def tokens(text: Column, mark: str = r"\|") -> Column:
    """Distinct, sorted, non-empty tokens of a delimited text."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), mark), F.trim)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def joined(token_array: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(token_array)), "|")
