"""Named groups of countries, as labels use them."""

from __future__ import annotations

from collections.abc import Iterable

#: Countries of groups (fixed values).
MEMBERS = {
    "eu": "AT BE BG CY CZ DE DK EE ES FI FR GR HR HU IE IT LT LU LV MT NL PL PT RO SE SI SK",
    "middle east": "AE BH CY EG IL IQ IR JO KW LB OM PS QA SA SY TR YE",
    "north africa": "DZ EG LY MA SD TN",
    "central america": "BZ CR GT HN NI PA SV",
    "southeast asia": "BN ID KH LA MM MY PH SG TH TL VN",
    "gulf": "AE BH KW OM QA SA",
    "nordics": "DK FI IS NO SE",
    "dach": "AT CH DE",
    "benelux": "BE LU NL",
    "uki": "GB IE",
    "anz": "AU NZ",
    "north america": "US CA MX",
}

#: Names of a region, folded, and what it is made of: groups, continents (@) and countries; what follows "-" is left out (fixed values).
REGIONS = (
    ("europe", "@EU"),
    ("eu, european union", "eu"),
    ("eea, european economic area", "eu, IS, LI, NO"),
    ("emea", "@EU, @AF, middle east"),
    ("apac, asia pacific, apj, asia pacific and japan", "@AS, @OC, -middle east"),
    ("asia", "@AS"),
    ("africa", "@AF"),
    ("oceania", "@OC"),
    ("north america, namer, noram", "north america"),
    ("south america", "@SA"),
    ("latin america, latam", "@SA, MX, central america, CU, DO, PR"),
    ("americas, the americas, amer", "@NA, @SA"),
    ("nordics, nordic, nordic countries, scandinavia", "nordics"),
    ("dach", "dach"),
    ("benelux", "benelux"),
    ("uki, uk&i", "uki"),
    ("anz", "anz"),
    ("middle east", "middle east"),
    ("north africa", "north africa"),
    ("mena", "middle east, north africa"),
    ("gcc, gulf, gulf region", "gulf"),
    ("southeast asia, south east asia", "southeast asia"),
)


def regions(continents: dict[str, str]) -> dict[str, tuple[str, ...]]:
    """Countries by folded name of each region; ``continents`` has the continent of each country there is."""

    def members(term: str) -> Iterable[str]:
        if term.startswith("@"):
            return (c for c, continent in continents.items() if continent == term[1:])
        return MEMBERS[term].split() if term in MEMBERS else (term,)

    out = {}
    for names, formula in REGIONS:
        kept: dict[str, None] = {}
        for term in formula.split(", "):
            if term.startswith("-"):
                for c in members(term[1:]):
                    kept.pop(c, None)
            else:
                kept.update(dict.fromkeys(members(term)))
        for name in names.split(", "):
            out[name] = tuple(c for c in kept if c in continents)
    return out
