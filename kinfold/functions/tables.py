"""Word lists and lookup tables of the normalisation. All are fixed values that results depend on."""

# Words without meaning for the identity of a business, removed anywhere in a name.
LEGAL_WORDS = [
    "inc", "incorporated", "ltd", "limited", "llc", "corp", "corporation", "co", "company", "plc", "pvt", "private", "llp",
    "lp", "sarl", "sa", "sas", "eurl", "snc", "sc", "pllc", "pc", "ms", "the", "and",
]
DOMAIN_WORDS = ["www", "http", "https"]
TOP_LEVEL_DOMAINS = ["com", "in", "net", "org", "co", "biz", "info", "fr", "us", "io"]

# Digits and one letter that stand for letters in distorted names: from, to.
LEET = ("01l5347", "oiiseat")

# Words of an address that say nothing, tested before states and abbreviations.
ADDRESS_DROP = ["null", "none", "nan", "township", "city", "no", "nos", "hno", "h", "d", "dno", "ho", "po", "p", "o", "the", "of", "and"]

US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
    "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi",
    "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh",
    "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh",
    "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd",
    "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
    "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}
INDIA_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "chattisgarh": "cg",
    "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl",
    "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od",
    "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "tg", "ts": "tg",
    "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "delhi": "dl",
    "new delhi": "new dl", "jammu and kashmir": "jk", "jammu kashmir": "jk", "ladakh": "la", "puducherry": "py", "pondicherry": "py",
    "chandigarh": "ch", "dadra and nagar haveli": "dn", "daman and diu": "dd", "andaman and nicobar islands": "an", "lakshadweep": "ld",
}
ADDRESS_SHORT = {
    "street": "st", "str": "st", "road": "rd", "drive": "dr", "avenue": "ave", "av": "ave", "boulevard": "blvd", "bd": "blvd",
    "lane": "ln", "court": "ct", "place": "pl", "square": "sq", "terrace": "ter", "highway": "hwy", "parkway": "pkwy", "circle": "cir",
    "trail": "trl", "apartment": "apt", "apartments": "apt", "suite": "ste", "floor": "flr", "building": "bldg", "north": "n",
    "south": "s", "east": "e", "west": "w", "mount": "mt", "saint": "st", "fort": "ft", "first": "1st", "second": "2nd", "third": "3rd",
    "fourth": "4th", "fifth": "5th", "near": "nr", "opposite": "opp", "sector": "sec", "bengaluru": "bangalore", "gurugram": "gurgaon",
    "mumbai": "mumbai", "bombay": "mumbai", "calcutta": "kolkata", "madras": "chennai",
}

STATES = US_STATES | INDIA_STATES
STATE_WORDS = {k: v for k, v in STATES.items() if " " not in k}
#: Longest first, so that a phrase isn't cut by one that it contains.
STATE_PHRASES = dict(sorted(((k, v) for k, v in STATES.items() if " " in k), key=lambda x: (-len(x[0]), x[0])))

# Most matches of one reference record from each of the two noisy sources.
MOST_S2, MOST_S3 = 5, 6
# Pair features whose scale depends on how dense the reference index is.
DENSITY_FEATURES = ["gap_best", "margin_other", "sn_gap", "sa_gap", "q_comb1", "q_comb2", "n_q", "rank_s1", "n_s1", "s1_top_s2", "s1_top_s3"]
# Floors tried for the expected-F rule.
FLOORS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
