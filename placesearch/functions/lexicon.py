"""Place-name word lists.  All tables here are fixed values that results depend on."""

from __future__ import annotations

# State and territory codes with their full names.
STATE_NAMES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
    "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont",
    "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin",
    "WY": "Wyoming", "DC": "District of Columbia", "PR": "Puerto Rico",
    "VI": "Virgin Islands",
}

# Territories are not in the guidebook: neither as section lines nor in addresses.
TERRITORIES = ("PR", "VI")
BOOK_STATES = {code: name for code, name in STATE_NAMES.items() if code not in TERRITORIES}
STATE_LINES = sorted(set(BOOK_STATES.values()) | {n.upper() for n in BOOK_STATES.values()})

# Codes that are everyday words and so never count as a state in a query,
# and the district, which queries do not filter on.
WORDLIKE_CODES = ("HI", "IN", "ME", "OR")
UNLISTED_STATES = ("DC",)

# Extra names for states in queries.
STATE_NICKNAMES = {
    "bama": "AL", "arkie": "AR", "cali": "CA", "nutmeg state": "CT", "hoosier": "IN",
    "mass": "MA", "show me state": "MO", "jersey": "NJ", "ny state": "NY",
    "new york state": "NY", "okie": "OK", "lone star": "TX", "lone star state": "TX",
    "cheesehead": "WI",
}


def state_aliases() -> dict[str, str]:
    """Lowercase word or phrase -> state code, for query text."""
    listed = {c: n for c, n in BOOK_STATES.items() if c not in UNLISTED_STATES}
    aliases = {name.lower(): code for code, name in listed.items()}
    aliases.update({c.lower(): c for c in listed if c not in WORDLIKE_CODES})
    aliases.update(STATE_NICKNAMES)
    return aliases


# Region names in queries and the directory region each stands for.
REGION_ALIASES = {
    "deep south": "Deep South",
    "great plains": "Great Plains",
    "mid-atlantic": "Mid-Atlantic",
    "mid atlantic": "Mid-Atlantic",
    "mid-south": "Mid-South",
    "mid south": "Mid-South",
    "midwest": "Midwest",
    "mid-west": "Midwest",
    "new england": "New England",
    "northeast": "New England",
    "southwest": "Southwest",
    "west coast": "West Coast",
    "pacific coast": "West Coast",
}

# Wider areas as lists of states.
EAST_COAST = ("ME", "NH", "MA", "RI", "CT", "NY", "NJ", "PA", "DE", "MD", "VA", "NC", "SC",
              "GA", "FL")
THE_SOUTH = ("VA", "WV", "KY", "NC", "SC", "GA", "FL", "AL", "MS", "TN", "AR", "LA", "TX",
             "OK")
BROAD_REGIONS = {
    "east coast": EAST_COAST,
    "eastern seaboard": EAST_COAST,
    "the south": THE_SOUTH,
    "southern states": THE_SOUTH,
    "southeast": ("AL", "GA", "FL", "SC", "KY", "TN", "MS", "LA"),
    "northwest": ("WA", "OR", "ID"),
    "pacific northwest": ("WA", "OR"),
}
