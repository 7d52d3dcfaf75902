"""The word lists, tables, patterns and default settings that decide results.

Everything here is data, kept together so that a reader can check it at a glance.
"""

# ---- fixed values: missing-value words -------------------------------------------------------

# Cells a delimited reader treats as absent (case-sensitive, whole cell).
READ_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Values a standardizer treats as absent (cleaned, lower case).
MISSING_WORDS = ["", "na", "n/a", "none", "null", "-", "--", "nan"]
NA_TEXT = "NA"

# ---- fixed values: home ownership ------------------------------------------------------------

OWNER_WORDS = ["owner", "own", "owns", "owned", "homeowner", "home owner", "yes", "y", "o"]
RENTED_WORDS = ["rented", "rent", "rents", "renter", "renting", "tenant", "lease", "no", "n", "r"]
EXPLICIT_HOME_WORDS = ["own", "owner", "owned", "owns", "homeowner", "rent", "rented", "renter", "rents"]

# ---- fixed values: insurance carriers --------------------------------------------------------

CARRIERS = [
    "State Farm", "GEICO", "Progressive", "Allstate", "USAA", "Liberty Mutual", "United", "Aetna",
    "Farm Bureau", "Auto-Owners", "Hartford", "National General", "Nationwide", "AAA", "Mercury",
    "Cincinnati", "Direct Auto", "Go Auto", "Bristol West", "Root Insurance", "Travelers", "Farmers",
]
CARRIER_SPELLINGS = {
    "gieco": "GEICO",
    "prograssive": "Progressive",
    "progresive": "Progressive",
    "liberty": "Liberty Mutual",
    "statefram": "State Farm",
    "root": "Root Insurance",
    "assurance": "Assurance",
    "alphainsurance": "Alpha Insurance",
    "atlinsurancegroup": "ATL Insurance Group",
}
# Carrier mentions inside free text, in order of precedence (case-insensitive).
CARRIER_MENTIONS = [
    (r"farm\s*bureau", "Farm Bureau"),
    (r"stat\s*e?\s*farm|sate\s*farm", "State Farm"),
    (r"progr[ae]?s{1,2}ive", "Progressive"),
    (r"g[ei]{1,2}co", "GEICO"),
    (r"\busaa\b", "USAA"),
    (r"allstate", "Allstate"),
    (r"liberty", "Liberty Mutual"),
    (r"hartford", "Hartford"),
    (r"auto\s*(owners?|onwers?)", "Auto-Owners"),
    (r"\baaa\b", "AAA"),
    (r"national\s*gen[ae]ral", "National General"),
    (r"nation\s*wide", "Nationwide"),
    (r"mercury", "Mercury"),
    (r"cincinnati", "Cincinnati"),
    (r"direct\s*auto", "Direct Auto"),
    (r"go\s*auto", "Go Auto"),
    (r"brist[ao]l\s*west", "Bristol West"),
    (r"\broot\b", "Root Insurance"),
    (r"travelers", "Travelers"),
    (r"\bfarmers\b", "Farmers"),
    (r"\bassurance\b", "Assurance"),
    (r"alpha\s*ins\w*", "Alpha Insurance"),
    (r"atl\s*insurance", "ATL Insurance Group"),
]

# ---- fixed values: dates ---------------------------------------------------------------------

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december"]

# ---- fixed values: change-log reasons --------------------------------------------------------

CHANGE_REASONS = {
    "name": "name recased/cleaned",
    "date": "date normalized to MM/DD/YYYY",
    "datetime": "timestamp normalized",
    "phone": "phone formatted",
    "zip": "ZIP normalized",
    "homeowner": "homeowner standardized",
    "int": "count normalized",
    "carrier": "carrier canonicalized",
    "email": "email normalized",
    "text": "whitespace cleaned",
}
CHANGE_REASON_OTHER = "normalized"
CHANGE_REASON_NA = "unparseable — set to NA"

# ---- fixed values: card sheets (patterns are case-insensitive) -------------------------------

CARD_BANNER = "live call transfer"
CARD_EMAIL = r"^\s*e-?mail\b\s*[:=]?\s*(.*)$"
CARD_SKIP = (
    r"live\s*call\s*transfer|lead\s*source|^\s*information|"
    r"^\s*\d+\s*(accidents?|tickets?|dui)\b|^\s*duration\b|only\s*home\s*insurance|"
    r"homeowners?\s*quote|^\s*(more\s*than|more\s*thena)|^\s*years?\s*[.:]|"
    r"^\s*\d+\s*(years?|yrs?|yr|yers)\.?\s*$|^\s*other\s*$|^\s*cars?\s*[:=]?\s*$"
)
CARD_NAME = r"^\s*name\b\s*[:=]?\s*[:=]?\s*(.*)$"
CARD_DOB = r"^\s*d\.?\s*o\.?\s*b\.?\b\s*[:=]?\s*(.*)$"
CARD_PHONE = r"^\s*(?:number|phone)\b\s*[:=]?\s*(.*)$"
CARD_ADDRESS = r"^\s*address\b\s*[:=]?\s*(.*)$"
CARD_CITY = r"^\s*city\s*[:=]\s*=?\s*(.*)$"
CARD_STATE = r"^\s*state\s*[:=]\s*=?\s*(.*)$"
CARD_ZIP = r"^\s*zip\s*_?\s*code?\s*[:=]\s*=?\s*(.*)$"
CARD_INSURANCE = r"^\s*(?:insurance|inc)\b\s*[:=/]?\s*(.*)$"
CARD_AUTOS = r"^\s*cars?\s*[:=]?\s*0?(\d)\s*$|^\s*0?(\d)\s*cars?\s*$"
CARD_VEHICLE_LABEL = r"^\s*cars?\b\s*[:=]?\s*"
CARD_RENT_PHRASE = r"^(renter|renting|rented|rent)\b"
CARD_OWN_PHRASE = r"^(home\s*own\w*|homeown\w*|homewoner|homeonwer|homeowner|owner)\b\s*:?\s*=?\s*(.*)$"
CARD_SINGLE_FAMILY = r"^single\s*family"
CARD_GEORGIA = r"^(ga|georgia)\.?$"
CARD_GEORGIA_ZIP = r"\b(3[01]\d{3})\b"
CARD_STREET = r"^\d+\s+\S+"
CARD_YEAR = r"(19|20)\d{2}"
VEHICLE_MAKES = (
    r"(?<![A-Za-z])(chevrolet|chevy|checy|ford|toyota|honda|hunda|nissan|dodge|dogde|doge|"
    r"ram|jeep|kia|hyundai|hundai|hundayi|lexus|bmw|mercedes|mercedies|benz|audi|gmc|"
    r"buick|buic|cadillac|lincoln|mazda|subaru|volkswagen|volkswagon|volks\s*wag[ao]n|"
    r"acura|infiniti|tesla|rivian|volvo|chrysler|mitsubishi|saab|mercury|pontiac|"
    r"land\s*rover|landrover|range\s*rover|avalon|sienna)"
)
LINE_NAME = r"^\s*name\b\s*[:=]"
LINE_DOB = r"^\s*d\.?\s*o\.?\s*b\.?\b\s*[:=]"
LINE_BANNER = r"^\s*live\s*call\s*transfer\s*:?\s*$"
LINE_RULE = r"^_{5,}$"
GRID_DOB = r"^\s*d\.?\s*o\.?\s*b\.?\b"

# ---- fixed values: labeled columns -----------------------------------------------------------

LABELED_BANNER = "contact details"
LABELED_BOUNDARY = "drivers"
LABELED_FIELDS = {
    "first name": "first", "last name": "last",
    "primary phone": "phone", "phone": "phone", "phone number": "phone",
    "email": "email", "address": "address", "city": "city", "state": "state",
    "zipcode": "zip", "zip code": "zip", "date of birth": "dob",
}

# ---- fixed values: default target profile ----------------------------------------------------

DEFAULT_PROFILE = {
    "name": "default",
    "columns": [
        {"name": "Timestamp", "type": "datetime",
         "aliases": ["timestamp", "time stamp", "time", "date added", "created", "created at",
                     "submission date"]},
        {"name": "Full Name", "type": "name",
         "aliases": ["full name", "name", "fullname", "lead name", "customer name", "client name"]},
        {"name": "Date of Birth", "type": "date",
         "aliases": ["date of birth", "dob", "d o b", "date of birt", "birth date", "birthdate", "born"]},
        {"name": "Address", "type": "text",
         "aliases": ["address", "street address", "addr", "home address", "full address"]},
        {"name": "Phone Number", "type": "phone",
         "aliases": ["phone number", "phone", "phone num", "phone no", "telephone", "contact",
                     "contact number", "mobile", "cell", "cell phone"]},
        {"name": "ZIP Code", "type": "zip",
         "aliases": ["zip code", "zip", "zipcode", "postal code", "postal", "postcode"]},
        {"name": "Homeowner", "type": "homeowner",
         "aliases": ["homeowner", "home owner", "owner status", "own rent", "own or rent", "housing",
                     "housing status", "residence status"]},
        {"name": "Autos", "type": "int",
         "aliases": ["autos", "auto", "vehicles", "num autos", "number of autos", "auto count",
                     "vehicle count", "no of cars"]},
        {"name": "Current Insurance", "type": "carrier",
         "aliases": ["current insurance", "current ins", "ins", "insurance", "carrier",
                     "current carrier", "insurance company", "provider"]},
        {"name": "Cars Make and Model", "type": "text",
         "aliases": ["cars make and model", "car make and model", "make and model", "cars make model",
                     "vehicle info", "car info", "vehicle details", "car details"]},
    ],
    "compose": {
        "Full Name": [
            ["first name", "first", "fname", "given name"],
            ["middle name", "middle"],
            ["last name", "last", "lname", "surname", "family name"],
        ],
        "Address": [
            ["street", "street address", "address 1", "address line 1", "addr"],
            ["city", "town"],
            ["state", "province"],
        ],
    },
    "aux_columns": [
        {"name": "Email", "type": "email", "aliases": ["email", "e-mail", "email address", "mail"]},
        {"name": "Age", "type": "int", "aliases": ["age", "current age"]},
        {"name": "Occupation", "type": "text", "aliases": ["occupation", "job", "job title", "profession"]},
        {"name": "Country", "type": "text", "aliases": ["country"]},
    ],
    "drop_columns": [
        "agent name", "agent", "agent nam", "assigned agent", "leads note", "lead notes", "leads notes",
        "lead note", "notes", "note", "comments", "remarks",
    ],
    "dedupe_on": ["Phone Number", "Full Name"],
    "sort_by": [],
}

# ---- fixed values: default quality settings --------------------------------------------------

DEFAULT_QUALITY = {
    "verticals": {
        "insurance": ["current insurance", "carrier", "premium", "policy type", "policy number", "autos",
                      "cars make and model", "homeowner"],
        "real_estate": ["listing", "property address", "mls", "list price", "square feet", "bedrooms",
                        "lot size"],
        "general_sales": ["company", "deal size", "product", "quote amount"],
    },
    "vertical_min_hits": 2,
    "nicknames": {
        "jon": "john", "jonny": "john", "johnny": "john",
        "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert",
        "bill": "william", "will": "william", "billy": "william", "willie": "william",
        "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth",
        "jim": "james", "jimmy": "james", "mike": "michael", "mick": "michael",
        "tom": "thomas", "tommy": "thomas", "tony": "anthony",
        "chris": "christopher", "dan": "daniel", "danny": "daniel",
        "dave": "david", "ed": "edward", "eddie": "edward", "ted": "theodore",
        "greg": "gregory", "jeff": "jeffrey", "joe": "joseph", "joey": "joseph",
        "kate": "katherine", "kathy": "katherine", "katie": "katherine",
        "larry": "lawrence", "matt": "matthew", "nick": "nicholas",
        "pat": "patricia", "patty": "patricia", "peggy": "margaret", "meg": "margaret",
        "rick": "richard", "dick": "richard", "richie": "richard",
        "ron": "ronald", "ronnie": "ronald", "sam": "samuel", "sammy": "samuel",
        "steve": "steven", "sue": "susan", "susie": "susan",
        "tim": "timothy", "timmy": "timothy", "andy": "andrew", "drew": "andrew",
        "tricia": "patricia", "trish": "patricia", "raymond": "ray", "ray": "raymond",
    },
    "name_fuzzy_threshold": 0.85,
    "email_domains": [
        "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "comcast.net",
        "att.net", "verizon.net", "msn.com", "live.com", "bellsouth.net", "sbcglobal.net", "charter.net",
        "cox.net",
    ],
    "email_autofix_ratio": 0.85,
    "email_suggest_ratio": 0.75,
    "rules": {
        "dob_implausible": {"enabled": True, "min_age": 16, "max_age": 105, "penalty": 10},
        "dob_vs_age": {"enabled": True, "tolerance_years": 2, "penalty": 10},
        "dob_vs_occupation": {"enabled": True, "student_max_age": 60, "retired_min_age": 40, "penalty": 10},
        "email_invalid": {"enabled": True, "penalty": 5},
        "email_domain_typo": {"enabled": True, "penalty": 5},
        "phone_invalid": {"enabled": True, "penalty": 15},
        "name_suspicious": {"enabled": True, "penalty": 5},
        "duplicate_group": {"enabled": True, "penalty": 10},
    },
    "scoring": {
        "weights": {
            "Full Name": 15, "Phone Number": 20, "Address": 10, "ZIP Code": 10, "Date of Birth": 10,
            "Homeowner": 5, "Autos": 5, "Current Insurance": 10, "Cars Make and Model": 5, "Timestamp": 10,
        },
        "review_threshold": 70,
    },
}

# ---- fixed values: cutoffs of the fuzzy lookups and layout tests ------------------------------

ALIAS_CUTOFF = 0.8
DROP_CUTOFF = 0.85
HOMEOWNER_CUTOFF = 0.8
CARRIER_CUTOFF = 0.75
CARRIER_COLUMN_CUTOFF = 0.8
HEADER_SEARCH_ROWS = 10
HEADER_MIN_HITS = 2
CARD_MIN_LABELS = 4
LEAD_MIN_CELLS = 3
PROFILE_SAMPLES = 200
YEAR_SAMPLES = 50
BIRTH_YEAR_BEFORE = 2015
NO_YEAR = 9999  # a date column without a year sorts last
MAX_VEHICLES = 4
MAX_ADDRESS_PARTS = 3
DELIMITERS = [",", ";", "\t", "|"]
XLSX_MAGIC = "504B0304"
XLS_MAGIC = "D0CF11E0A1B11AE1"
