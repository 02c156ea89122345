"""Vocabularies of the linkage domain.

Fixed values: the tables below define results. A table of pairs maps a token to
its normal form; a word that stands for itself is its own.
"""

# fmt: off

MISSING = (
    "null", "none", "nan", "n/a", "nil", "-", "--", "?",
)
LEGAL_INFIX = {
    "corp": "corp", "corporation": "corp", "inc": "inc", "incorporated": "inc", "ltd": "ltd", "limited": "ltd", "pvt": "pvt", "private": "pvt",
    "llc": "llc", "llp": "llp", "plc": "plc", "gmbh": "gmbh", "sarl": "sarl", "srl": "srl", "sas": "sas", "sasu": "sas", "bv": "bv", "nv": "nv",
    "spa": "spa", "kg": "kg", "kk": "kk", "pte": "pte", "pty": "pty",
}
LEGAL_SUFFIX_ONLY = {
    "co": "co", "company": "co", "ag": "ag", "sa": "sa", "as": "as", "ab": "ab", "lp": "lp", "sl": "sl",
}
LEGAL_FORMS = LEGAL_INFIX | LEGAL_SUFFIX_ONLY
LEGAL_PHRASES = (
    ("private limited", "pvt ltd"),
    ("pvt ltd", "pvt ltd"),
    ("p ltd", "pvt ltd"),
    ("private ltd", "pvt ltd"),
    ("co ltd", "co ltd"),
    ("and co", "co"),
    ("s a r l", "sarl"),
    ("s a", "sa"),
)
NAME_ABBREVIATIONS = {
    "intl": "international", "int": "international", "natl": "national", "assoc": "associates", "bros": "brothers", "mfg": "manufacturing",
    "mfr": "manufacturer", "ctr": "center", "svcs": "services", "svc": "service", "tech": "technology", "ind": "industries", "indl": "industrial",
    "mgmt": "management", "mktg": "marketing", "univ": "university", "inst": "institute", "hosp": "hospital", "dept": "department",
    "dist": "distribution", "whse": "warehouse", "bldg": "building", "apt": "apartment", "ste": "suite", "blvd": "boulevard", "rd": "road",
    "st": "street", "ave": "avenue", "hwy": "highway", "pkwy": "parkway", "cir": "circle", "ter": "terrace", "plz": "plaza", "sq": "square",
    "mt": "mount", "ft": "fort", "no": "number", "opp": "opposite", "nr": "near", "nrt": "near", "sec": "section", "grp": "group", "cos": "company",
    "pics": "pictures", "photo": "photography",
}
NAME_STOPWORDS = (
    "the", "of", "and", "a", "an", "in", "at", "for", "to", "on", "by", "with", "or", "de", "la", "le", "les", "el", "du", "des", "di", "da", "et",
    "this", "that", "our", "your", "my", "its",
)
STREET_TYPES = {
    "street": "street", "st": "street", "str": "street", "road": "road", "rd": "road", "avenue": "avenue", "ave": "avenue", "av": "avenue",
    "aven": "avenue", "boulevard": "boulevard", "blvd": "boulevard", "boul": "boulevard", "lane": "lane", "ln": "lane", "drive": "drive", "dr": "drive",
    "drv": "drive", "court": "court", "ct": "court", "crt": "court", "place": "place", "pl": "place", "square": "square", "sq": "square", "sqr": "square",
    "highway": "highway", "hwy": "highway", "highwy": "highway", "parkway": "parkway", "pkwy": "parkway", "pky": "parkway", "parkwy": "parkway",
    "terrace": "terrace", "ter": "terrace", "terr": "terrace", "circle": "circle", "cir": "circle", "circl": "circle", "way": "way", "wy": "way",
    "loop": "loop", "trail": "trail", "trl": "trail", "crescent": "crescent", "cres": "crescent", "gardens": "gardens", "gdns": "gardens",
    "garden": "gardens", "villa": "villa", "villas": "villa", "apartments": "apartments", "apartment": "apartments", "apts": "apartments",
    "nagar": "nagar", "colony": "colony", "society": "society", "plaza": "plaza", "plz": "plaza", "mall": "mall", "complex": "complex", "cx": "complex",
    "centre": "center", "center": "center", "building": "building", "bldg": "building", "bldgs": "building", "tower": "tower", "towers": "tower",
    "rua": "rua", "rue": "rue", "avenida": "avenida", "calle": "calle", "via": "via", "viale": "viale",
}
DIRECTIONS = {
    "north": "north", "n": "north", "south": "south", "s": "south", "east": "east", "e": "east", "west": "west", "w": "west", "northeast": "northeast",
    "ne": "northeast", "northwest": "northwest", "nw": "northwest", "southeast": "southeast", "se": "southeast", "southwest": "southwest",
    "sw": "southwest",
}
ADDRESS_SYNONYMS = {
    "apartment": "apartment", "apt": "apartment", "flat": "apartment", "suite": "suite", "ste": "suite", "unit": "unit", "floor": "floor", "fl": "floor",
    "ground": "floor", "first": "floor", "second": "floor", "third": "floor", "fourth": "floor", "fifth": "floor", "number": "number", "no": "number",
    "num": "number", "plot": "plot", "house": "plot", "shop": "plot", "block": "plot", "door": "plot", "premises": "plot", "property": "plot",
    "near": "near", "nr": "near", "nrt": "near", "opposite": "opposite", "opp": "opposite", "beside": "beside", "adjacent": "beside", "next": "beside",
    "behind": "behind", "across": "across", "sector": "sector", "sec": "sector", "phase": "phase", "layout": "layout", "district": "district",
    "dist": "district", "city": "city", "town": "town", "village": "town", "county": "county", "state": "state", "province": "province",
    "region": "region", "postal": "postal", "zip": "postal", "pin": "postal", "pincode": "postal", "zipcode": "postal", "post": "postal",
    "code": "postal",
}
SMALL_WORDS = (
    "the", "of", "and", "a", "an", "in", "at", "to", "for", "on", "by", "with", "or", "de", "la", "le", "les", "du", "des", "di", "da", "et", "von",
    "van", "del", "della", "dos", "das",
)
TITLES_AND_FORMS = (
    "inc", "corp", "corporation", "co", "company", "ltd", "limited", "pvt", "private", "llc", "llp", "lp", "plc", "gmbh", "ag", "sa", "sarl", "bv", "nv",
    "spa", "srl", "mr", "mrs", "ms", "dr", "shri", "smt",
)
ADDRESS_STOPWORDS = tuple(dict.fromkeys([*SMALL_WORDS, *STREET_TYPES, *ADDRESS_SYNONYMS, *TITLES_AND_FORMS]))
LANDMARK_MARKERS = (
    "near", "nearby", "opposite", "opp", "beside", "adjacent", "next", "behind", "across", "infront", "towards", "toward", "by",
)
LANDMARK_WORDS = (
    "atm", "bank", "banking", "hotel", "hospital", "clinic", "dispensary", "school", "college", "university", "institute", "temple", "mosque", "church",
    "gurudwara", "bus", "stop", "railway", "station", "metro", "market", "mandi", "bazaar", "post", "office", "circle", "junction", "crossing", "bypass",
    "flyover", "signal", "gate", "campus", "park", "zoo", "theatre", "theater", "cinema", "mall", "stadium", "port", "airport", "bridge", "residency",
    "apartments", "centre", "center", "chowk", "ganj", "busstop", "police", "court", "gas", "petrol",
)
TOP_LEVEL_DOMAINS = (
    "com", "net", "org", "co", "in", "us", "biz", "info", "io", "fr", "uk", "de", "shop", "store", "online", "site", "website", "co.in", "co.uk",
)
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}
REGIONS = {
    "us": tuple(US_STATES),
    "india": (
        "andhra pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala",
        "madhya pradesh", "maharashtra", "manipur", "meghalaya", "odisha", "punjab", "rajasthan", "tamil nadu", "telangana", "uttar pradesh", "uttarakhand",
        "west bengal", "delhi", "pondicherry", "chandigarh", "andaman nicobar", "dadra nagar", "daman diu", "lakshadweep", "sikkim", "arunachal", "nagaland",
        "tripura", "mizoram",
    ),
    "france": (
        "ile de france", "auvergne", "bretagne", "normandie", "pays de la loire", "grand est", "hauts de france", "occitanie", "provence alpes cote d azur",
        "corse", "normandy", "brittany",
    ),
}
STATE_CODES = {"us": tuple(US_STATES.values())}
POSTAL_LENGTHS = {"us": (5,), "india": (6,), "france": (5,)}
ANY_POSTAL_LENGTHS = (5, 6)
LATIN_FROM = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūýÿñçšžćčłøđÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝÑÇ"
LATIN_TO = "aaaaaaaeeeeeiiiiioooooouuuuuyyncszcclodAAAAAAEEEEIIIIOOOOOUUUUYNC"
