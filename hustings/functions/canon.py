"""Row functions: names, numbers, labels, bands and rates. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States whose seats were renumbered, from which year, by how much; states with a boundary break, and its year.
RENUMBERED = {"NATION_3": (1998, 119), "NATION_7": (1998, 119)}
BREAKS = {"NATION_5": 1998, "NATION_9": 1998}
#: Alliance of each party.
ALLIANCES = {"STANDARD": "A Alliance (X)", "ECONOMY": "A Alliance (X)", "MEDIUM": "B Alliance (Y)", "PROMO": "B Alliance (Y)"}
#: Ends of the bands of margin and turnout.
MARGIN_BANDS = (2.0, 5.0, 10.0, 20.0)
TURNOUT_BANDS = (55.0, 62.0, 70.0, 78.0)


def lenient_number(x: Column, digits: int = 2) -> Column:
    """A number from text: empty or unreadable is null; no digits means truncated to an integer."""
    value = x.try_cast("double")
    return value.cast("long") if digits == 0 else F.round(value, digits)


def tolerant_number(x: Column) -> Column:
    """As lenient_number, with thousands commas, and with the usual words for nothing as null; rounded to an integer."""
    bare = F.trim(F.regexp_replace(x, ",", ""))
    return F.round(F.when(bare.isin("", "-", "NA", "N/A", "nan", "None"), None).otherwise(bare).try_cast("double")).cast("long")


def party_name(p: Column) -> Column:
    """Without a footnote in brackets at the end, smart punctuation and repeated spaces."""
    bare = F.regexp_replace(F.trim(p), r"\s*\[[^\]]*\]$", "")
    return F.trim(F.regexp_replace(F.translate(bare, "‘’“”–—", "''\"\"--"), r"\s+", " "))


def is_junk_party(p: Column) -> Column:
    """Rows that are no party: totals, electors, none of the above, nothing."""
    bare = F.upper(F.trim(F.coalesce(p, F.lit(""))))
    return bare.isin("", "OTH", "NOTA") | bare.rlike("VALID VOTES|TURNOUT|REGISTERED VOTERS|NONE OF THE ABOVE")


def seat_key(name: Column) -> Column:
    """Upper case, & for AND, no reservation in brackets at the end, letters and digits only."""
    upper = F.regexp_replace(F.upper(name), r"\s*\((SC|ST|GEN)\)\s*$", "")
    return F.regexp_replace(F.regexp_replace(upper, r"\bAND\b", "&"), "[^A-Z0-9]", "")


def padded_code(x: Column, width: int) -> Column:
    return F.lpad(F.substring_index(x.cast("string"), ".", 1), width, "0")


def alliance_of(p: Column) -> Column:
    found = F.lit("Unaligned")
    for party, alliance in ALLIANCES.items():
        found = F.when(p == party, alliance).otherwise(found)
    return found


def alliance_base(a: Column) -> Column:
    """An alliance without its state's suffix in brackets; null is Unaligned."""
    return F.coalesce(F.regexp_replace(a, r" \(.*\)$", ""), F.lit("Unaligned"))


def pooling_group(p: Column, a: Column) -> Column:
    """The alliance that a party's votes are pooled in, or the party itself."""
    base = alliance_base(a)
    return F.when(base == "Unaligned", p).otherwise(base)


def continuity(arena: Column, s: Column, y: Column, n: Column) -> Column:
    """The seat's number that is kept across years: n, shifted where a state's seats were renumbered."""
    found = n
    for state, (year, shift) in RENUMBERED.items():
        found = F.when((arena == "AE") & (s == state) & (y >= year), n + shift).otherwise(found)
    return found.cast("int")


def comparable(arena: Column, s: Column, y1: Column, y2: Column) -> Column:
    """Whether two years' seats can be compared: no boundary break of the state lies between them. National seats always can."""
    found = F.lit(True)
    for state, year in BREAKS.items():
        found = F.when((arena == "AE") & (s == state), (y1 < year) == (y2 < year)).otherwise(found)
    return found


def reservation_of(n: Column) -> Column:
    return F.when(n <= 2, "SC").when(n == 3, "ST").otherwise("GEN")


def reservation_category(r: Column) -> Column:
    """GEN, SC or ST of a label."""
    return F.when(r.rlike(r"\bST\b"), "ST").when(r.rlike(r"\bSC\b"), "SC").otherwise("GEN")


def band(x: Column, ends: tuple[float, ...]) -> Column:
    """Number of the half-open band of x; null stays null."""
    return F.when(x.isNotNull(), sum(((x >= e).cast("int") for e in ends), F.lit(0)))


def safety(m: Column) -> Column:
    return F.when(m.isNull(), "Unknown").when(m >= 15, "Safe").when(m >= 5, "Lean").otherwise("Marginal")


def lost_deposit(share: Column) -> Column:
    """Less than a sixth of the valid votes."""
    return share < F.lit(100.0) / 6


def percent(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") * 100 / b)


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


#: Words of a town's name that tell its kind of council only.
COUNCIL_WORDS = ("municipal", "corporation", "council", "committee", "nagar panchayat", "nagar palika", "parishad", "nagar nigam", "mahanagar", "palike", "palika", "town", "area", "notified", "cantonment", "board", "m corp", "cb", "nac", "np", "mc", "m cl")


def town_name(name: Column) -> Column:
    """Letters of a town's name in lower case, without brackets and the words for its council; null stays null."""
    bare = F.regexp_replace(F.lower(name), r"\(.*?\)", " ")
    return F.regexp_replace(F.regexp_replace(bare, rf"\b({'|'.join(COUNCIL_WORDS)})\b", " "), "[^a-z]", "")


def title_case(name: Column) -> Column:
    """Words begin with a capital, also after ( - . / and an apostrophe; null is empty."""
    marked = F.regexp_replace(F.coalesce(name, F.lit("")), r"([\s(\-./'])", "$1\u0001 ")
    return F.trim(F.regexp_replace(F.initcap(marked), "\u0001 ", ""))


def unit_level(district: Column, subdistrict: Column, town: Column) -> Column:
    """Level of a census row by which of its codes are all zeros; a town above sub-districts spans several."""
    d, s, t = (c.rlike("^0+$") for c in (district, subdistrict, town))
    return F.when(s & ~t, "TOWN_WHOLE").when(d & s, "STATE").when(s, "DISTRICT").when(~d & t, "SUBDISTRICT").when(~d, "TOWN")
