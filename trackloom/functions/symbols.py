"""Symbol codes in three standards and force codes, as columns.

A code is 20 digits (2525D), 10 to 15 letters, digits and dashes (2525C) or a CoT type.
Every function is an expression over the code, so that rows never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of affiliations and dimensions, digits of identities, symbol sets of domains, force codes.
LETTERS = {"pending": "p", "unknown": "u", "assumed_friend": "a", "friend": "f", "neutral": "n", "suspect": "s", "hostile": "h", "joker": "j", "faker": "k", "none": "o"}
DIMENSIONS = {"air": "A", "surface": "S", "subsurface": "U", "ground": "G", "space": "P"}
DIGITS = {"pending": "0", "unknown": "1", "none": "1", "assumed_friend": "2", "friend": "3", "neutral": "4", "suspect": "5", "hostile": "6", "joker": "5", "faker": "6"}
#: Letters of 2525C identities that are another one's in CoT (exercise identities are their real-world ones).
REAL = {"G": "p", "W": "u", "-": "u", "M": "a", "D": "f", "L": "n"}
SETS = {"air": ("01", "02", "51"), "space": ("05", "06", "50"), "ground": ("10", "11", "15", "20", "27", "52"), "surface": ("30", "53"), "subsurface": ("35", "36", "54")}
LAND = {"10": "G-U", "15": "G-E", "20": "G-I"}
#: By position, then threat: hostile, pending, friend, assumed friend, suspect, neutral, unknown.
THREATS = ("hostile", "pending", "friend", "assumed_friend", "suspect", "neutral", "unknown")
FORCE = {
    "air": (1, 2, 3, 10, 11, 12, 28),
    "subsurface": (4, 5, 6, 13, 14, 15, 29),
    "surface": (7, 8, 9, 16, 17, 18, 30),
    "ground": (24, 26, 22, 23, 25, 27, 31),
    "unknown": (38, 0, 39, 20, 19, 21, 32),
}


def lookup(table: dict[str, str], x: Column) -> Column:
    """``table`` of ``x``, null for what it lacks."""
    return F.element_at(F.create_map(*(F.lit(y) for kv in table.items() for y in kv)), F.coalesce(x, F.lit("\x00")))


def standard(raw: Column) -> Column:
    """2525C, 2525D or cot; null for what is none of them."""
    s = F.trim(raw)
    upper = F.replace(F.upper(s), F.lit("*"), F.lit("-"))
    return F.when(s.rlike(r"^[0-9]{20}\z"), "2525D").when(upper.rlike(r"^[SGWIOE][A-Z0-9-]{9,14}\z"), "2525C").when(s.rlike(r"^[a-z](-[A-Za-z0-9_.]+)*\z"), "cot")


def normalised(raw: Column) -> Column:
    """The code as it is kept: 2525C in capitals, filled with dashes to 15 characters."""
    s = F.trim(raw)
    return F.when(standard(raw) == "2525C", F.rpad(F.replace(F.upper(s), F.lit("*"), F.lit("-")), 15, "-")).when(standard(raw).isNotNull(), s)


def _at(code: Column, i: int, n: int = 1) -> Column:
    return F.substring(code, i + 1, n)


def affiliation(raw: Column) -> Column:
    """The standard identity that a code carries, null if none."""
    code, kind = normalised(raw), standard(raw)
    back = {v: k for k, v in LETTERS.items()}
    exercise = _at(code, 2) == "1"
    real = lookup({"0": "pending", "1": "unknown", "2": "assumed_friend", "3": "friend", "4": "neutral", "5": "suspect", "6": "hostile"}, _at(code, 3))
    d = F.when(exercise & (_at(code, 3) == "5"), "joker").when(exercise & (_at(code, 3) == "6"), "faker").otherwise(real)
    atoms = F.split(code, "-")
    return F.when(kind == "2525C", lookup(back, F.lower(_at(code, 1)))).when(kind == "2525D", d).when((kind == "cot") & (F.get(atoms, 0) == "a"), lookup(back, F.get(atoms, 1)))


def domain(raw: Column) -> Column:
    """The domain of a code's battle dimension or symbol set, null if it says none."""
    code, kind = normalised(raw), standard(raw)
    back = {v: k for k, v in DIMENSIONS.items()}
    atoms = F.split(code, "-")
    return (
        F.when(kind == "2525C", lookup(back | {"F": "ground"}, _at(code, 2)))
        .when(kind == "2525D", lookup({s: d for d, sets in SETS.items() for s in sets}, _at(code, 4, 2)))
        .when((kind == "cot") & (F.get(atoms, 0) == "a"), lookup(back, F.get(atoms, 2)))
    )


def cot_type(raw: Column) -> Column:
    """The CoT type that a code stands for; null for graphics, weather and what names no atom."""
    code, kind = normalised(raw), standard(raw)
    letter = F.coalesce(lookup(REAL, _at(code, 1)), lookup({v.upper(): v for v in LETTERS.values()}, _at(code, 1)))
    dim, scheme = _at(code, 2), _at(code, 0)
    function = F.split(F.regexp_extract(F.substring(code, 5, 6), "^[^-]*", 0), "")
    fighting = F.when(dim.isin(*"PAGSUFX"), F.concat_ws("-", F.lit("a"), letter, dim, F.array_join(F.filter(function, lambda c: c != ""), "-")))
    plain = F.when(dim.isin(*"PAGSU"), F.concat(F.lit("a-"), letter, F.lit("-"), dim))
    c = F.when(scheme == "S", F.regexp_replace(fighting, "-$", "")).when(scheme == "I", plain).when(scheme.isin("O", "E"), F.concat(F.lit("a-"), letter, F.lit("-G")))
    d = F.concat(F.lit("a-"), lookup(LETTERS, affiliation(raw)), F.lit("-"), F.coalesce(lookup(LAND, _at(code, 4, 2)), lookup(DIMENSIONS, domain(raw))))
    return F.when(kind == "cot", code).when((kind == "2525C") & letter.isNotNull(), c).when(kind == "2525D", d)


def with_affiliation(raw: Column, identity: Column) -> Column:
    """The same code with its standard identity replaced; joker and faker also mark an exercise."""
    code, kind = normalised(raw), standard(raw)
    letter, digit = lookup(LETTERS, identity), lookup(DIGITS, identity)
    c = F.concat(_at(code, 0), F.upper(letter), F.substring(code, 3, 13))
    context = F.when(identity.isin("joker", "faker"), "1").otherwise(_at(code, 2))
    d = F.concat(_at(code, 0, 2), context, digit, F.substring(code, 5, 16))
    atoms = F.split(code, "-")
    cot = F.when((F.get(atoms, 0) == "a") & (F.size(atoms) > 1), F.concat_ws("-", F.lit("a"), letter, F.array_join(F.slice(atoms, 3, 100), "-"))).otherwise(code)
    return F.when(kind == "2525C", c).when(kind == "2525D", d).when(kind == "cot", F.regexp_replace(cot, "-$", ""))


def force_code(domain: Column, identity: Column) -> Column:
    """The force code (0-39) of a domain and affiliation."""
    threat = F.coalesce(lookup({**{t: t for t in THREATS}, "joker": "suspect", "faker": "hostile"}, identity), F.lit("unknown"))
    place = F.coalesce(lookup({**{p: p for p in FORCE if p != "unknown"}, "space": "air"}, domain), F.lit("unknown"))
    codes = {f"{p}|{t}": str(n) for p, row in FORCE.items() for t, n in zip(THREATS, row, strict=True)}
    return lookup(codes, F.concat(place, F.lit("|"), threat)).cast("int")
