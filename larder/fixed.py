"""Numbers, words and patterns that decide results, stated once and in plain form."""

from __future__ import annotations

# --- Fixed values: text -------------------------------------------------------------------
# White space as the sources mean it: Java's \s leaves out the no-break space and its relatives.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f"
    "\u205f\u3000\ufeff"
)
# Word edges over accent-free text; ASCII on purpose.
WORD_START = "(?<![A-Za-z0-9_])"
WORD_END = "(?![A-Za-z0-9_])"

# --- Fixed values: money and gates --------------------------------------------------------
MAX_PRICE_COP = 50_000_000
MAX_UNREADABLE_SHARE = 0.2
MIN_SAMPLE = 50
PRICE_JUMP = 10
STALE_AFTER_DAYS = 3
MAX_MISSING_SHARE = 0.25
PUBLISH_EVERY = 1000
NATIONAL = "NACIONAL"
KEEP_ALL_DAYS = 90

# --- Fixed values: catalogue pages --------------------------------------------------------
PAGE_SIZE = 50
PAGE_CEILING = 2500
EAN = r"^[0-9]{8,14}$"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$"

# --- Fixed values: units ------------------------------------------------------------------
# spelling -> measure
UNIT_SPELLINGS = {
    "g": "g", "gr": "g", "grs": "g", "gramo": "g", "gramos": "g",
    "kg": "kg", "kgs": "kg", "kilo": "kg", "kilos": "kg",
    "ml": "ml", "mls": "ml", "cc": "ml",
    "l": "l", "lt": "l", "lts": "l", "litro": "l", "litros": "l",
    "un": "un", "und": "un", "uds": "un", "unid": "un", "unidad": "un", "unidades": "un",
}
UNIT_KIND = {"g": "weight", "kg": "weight", "ml": "volume", "l": "volume", "un": "unit"}
UNIT_FACTOR = {"g": 1, "kg": 1000, "ml": 1, "l": 1000, "un": 1}
UNIT_BASE = {"g": "g", "kg": "g", "ml": "ml", "l": "ml", "un": "un"}
UNIT_REFERENCE = {"g": 100, "ml": 100, "un": 1}
SMALL_UNITS = ("g", "ml", "un")
# kind -> (least, most) in g, ml or units
PLAUSIBLE = {"weight": (3, 50_000), "volume": (3, 25_000), "unit": (1, 2_000)}

# --- Fixed values: what makes a size in a name untrustworthy ------------------------------
_ANY_UNIT = "|".join(UNIT_SPELLINGS)
PACK_COUNT_BEFORE = (
    rf"(?i)[0-9]{SPACE}*x{SPACE}*$"
    rf"|(?:^|[0-9]|{SPACE})x{SPACE}*[0-9]"
    rf"|(?:^|[^0-9])[0-9]+{SPACE}*(?:und|unds|uds|un|unid|unidad|unidades|latas?|packs?|pacas?"
    rf"|sobres?|bolsas?|botellas?){WORD_END}"
)
NOT_A_SIZE_BEFORE = (
    rf"(?iu)(?<![\p{{L}}0-9_.,/#°º-])(?<!#{SPACE})(?<![0-9]{SPACE}en{SPACE})[0-9]{{1,2}}{SPACE}+$"
    rf"|[0-9]{SPACE}*/{SPACE}*$"
    rf"|[0-9]{SPACE}*(?:(?:{_ANY_UNIT}){SPACE}*)?(?:-|–|{WORD_START}a){SPACE}*$"
    rf"|{WORD_START}(?:hasta|desde|m[aá]s{SPACE}+de|menos{SPACE}+de){SPACE}+$"
)
MEASURE_BEFORE = rf"(?i)[0-9]{SPACE}*({_ANY_UNIT}){SPACE}+$"
SPLIT_DECIMAL_BEFORE = rf"[0-9][.,]{SPACE}+$"
PLUS_COUNT_BEFORE = rf"\+{SPACE}*[0-9]"
COMBO = (
    rf"(?iu){WORD_START}(?:gratis|combo|pague|lleve){WORD_END}"
    rf"|{WORD_START}kit{WORD_END}(?!{SPACE}*-?{SPACE}*kat)"
    rf"|{WORD_START}(?:six|four|tri|bi|duo|dúo|twin|multi){SPACE}*-?{SPACE}*pack"
    rf"|[0-9]{SPACE}*(?:{_ANY_UNIT}){SPACE}*\+"
    r"|[0-9]\+(?=[^\s\u00a0])"
)
PET_DOSE = (
    rf"(?i){WORD_START}(?:antipulgas|antiparasitari[oa]s?|desparasitantes?|garrapatas|bravecto|simparica"
    rf"|credelio|nexgard|advocate|comprimidos?|masticables?|pipetas?){WORD_END}"
    rf"|[0-9]{SPACE}*tab(?:s|letas?)?{WORD_END}"
)

# --- Fixed values: shouted ERP titles -----------------------------------------------------
ERP_UNITS = {
    "G": "g", "GR": "g", "GRS": "g", "GRAMOS": "g", "KG": "kg", "KILO": "kg", "KILOS": "kg",
    "ML": "ml", "M": "ml", "C": "ml", "CC": "ml", "L": "l", "LT": "l", "LTS": "l",
    "U": "un", "UND": "un", "UNIDADES": "un",
}
ERP_BARE_UNITS = ("M", "C")
ERP_ROLL_GOODS = rf"(?i){WORD_START}(?:PAPEL|ALUMINIO|SEDA|VINIPEL|CINTA){WORD_END}"
ERP_LIQUID_AISLES = ("bebidas", "lacteos")
ERP_FOOD_AISLES = (
    "viveres", "lacteos", "carnes", "frutas-verduras", "panaderia", "bebidas", "congelados", "bebes", "otros",
)
ERP_MIN_BARE_VOLUME = 100
ERP_MAX = {"g": 50_000, "kg": 50, "ml": 25_000, "l": 25, "un": 500}
_ERP_ANY_UNIT = "|".join(sorted(ERP_UNITS, key=len, reverse=True))
ERP_MULTIPACK = (
    rf"(?i){WORD_START}(?:LLEVE?|LLVE|LLV|PAGUE|PAG|PG){WORD_END}"
    rf"|[0-9]{SPACE}*X{SPACE}*[0-9]"
    rf"|{WORD_START}X{SPACE}?[0-9]+(?:[.,][0-9]+)?(?![.,0-9]){WORD_END}(?!{SPACE}(?:{_ERP_ANY_UNIT}){WORD_END})"
)

# --- Fixed values: names and brands -------------------------------------------------------
FILLER_WORDS = (
    "x", "und", "unds", "un", "unidad", "unidades", "aprox", "pack", "paca", "tubo", "bolsa", "sobre", "caja",
    "frasco", "lata", "botella", "tarro", "display", "surtido", "surtida", "surtidos", "surtidas", "de", "del",
    "la", "el", "los", "las", "y", "con", "en", "por",
)
MEASURE_WORD = r"(?iu)^(?:x?[0-9]+(?:[.,][0-9]+)?[a-zñ]*|[a-z]{1,3}[0-9]+)$"
PLACEHOLDER_BRAND = (
    rf"(?iu)^(?:sin{SPACE}+marca(?:{SPACE}+[0-9]+)?\.?|gen[eé]ric[oa]s?\.?|no{SPACE}+aplica|n\.?/?a\.?|-+"
    r"|[0-9]+(?:[.,/-][0-9]+)+)$"
)
# container words by product keyword, singular and plural
CONTAINERS = (
    ("leche", "bolsa", "bolsas"),
    ("aceite", "botella", "botellas"),
    ("gaseosa", "botella", "botellas"),
    ("jugo", "botella", "botellas"),
    ("agua", "botella", "botellas"),
    ("vino", "botella", "botellas"),
    ("cerveza", "lata", "latas"),
    ("atun", "lata", "latas"),
    ("yogur*", "vaso", "vasos"),
)
MEASURE_LABELS = {"g": "g", "kg": "kg", "ml": "ml", "l": "L", "un": "un"}

# --- Fixed values: search -----------------------------------------------------------------
MAX_TERMS = 6
MAX_TERM_LENGTH = 30
SEARCH_PAGE = 20

# --- Fixed values: saved lists ------------------------------------------------------------
LIST_MAX_ITEMS = 500
LIST_MAX_NAME = 100
LIST_MIN_QUANTITY = "0.001"
LIST_MAX_QUANTITY = "999"

# --- Fixed values: reminders --------------------------------------------------------------
OCCURRENCES_PER_REMINDER = 8
NOTIFICATION_BUDGET = 56
NOTIFICATION_PREFIX = "reminder:"

# --- Fixed values: map --------------------------------------------------------------------
EARTH_RADIUS_M = 6_371_000.0
LAT_RANGE = (-4.3, 13.6)
LNG_RANGE = (-82.0, -66.8)
MAX_RADIUS_M = 50_000
MAX_NEAREST = 100
DEFAULT_RADIUS_M = 25_000
DEFAULT_NEAREST = 30
WALKING_LIMIT_M = 1500
SATURATED_AT = 300
KM_PER_DEGREE = 111.32
MAX_KM_FROM_TOWN = 30.0

# --- Fixed values: town centres (label, latitude, longitude) ------------------------------
TOWN_CENTRES = (
    ("Bogotá", 4.711, -74.072), ("Medellín", 6.244, -75.581), ("Cali", 3.452, -76.532),
    ("Barranquilla", 10.969, -74.781), ("Cartagena", 10.391, -75.479), ("Bucaramanga", 7.119, -73.123),
    ("Cúcuta", 7.894, -72.507), ("Pereira", 4.813, -75.696), ("Manizales", 5.07, -75.514),
    ("Armenia", 4.533, -75.681), ("Ibagué", 4.439, -75.232), ("Villavicencio", 4.142, -73.626),
    ("Santa Marta", 11.241, -74.199), ("Neiva", 2.927, -75.282), ("Pasto", 1.213, -77.281),
    ("Montería", 8.748, -75.881), ("Valledupar", 10.463, -73.253), ("Sincelejo", 9.304, -75.398),
    ("Popayán", 2.444, -76.614), ("Tunja", 5.535, -73.367), ("Riohacha", 11.544, -72.907),
    ("Florencia", 1.614, -75.606), ("Yopal", 5.337, -72.395), ("Quibdó", 5.692, -76.658),
    ("Girardot", 4.304, -74.804), ("Sogamoso", 5.715, -72.934), ("Duitama", 5.827, -73.033),
    ("Barrancabermeja", 7.065, -73.854), ("Tuluá", 4.084, -76.195), ("Buenaventura", 3.882, -77.031),
    ("Palmira", 3.539, -76.303), ("Cartago", 4.746, -75.912), ("Apartadó", 7.882, -76.625),
    ("Rionegro", 6.155, -75.374), ("Zipaquirá", 5.022, -74.004), ("Fusagasugá", 4.337, -74.364),
    ("Facatativá", 4.814, -74.354), ("Soacha", 4.579, -74.217), ("Ocaña", 8.237, -73.356),
    ("Magangué", 9.241, -74.754), ("Arauca", 7.084, -70.759), ("San Andrés", 12.584, -81.701),
    ("Leticia", -4.215, -69.94), ("Mocoa", 1.152, -76.647), ("Ipiales", 0.83, -77.644),
    ("Pitalito", 1.853, -76.051), ("Aguachica", 8.309, -73.616), ("Caucasia", 7.983, -75.198),
    ("Turbo", 8.093, -76.728), ("Lorica", 9.236, -75.814), ("Espinal", 4.149, -74.884),
    ("La Dorada", 5.451, -74.664), ("Puerto Boyacá", 5.976, -74.587), ("Chiquinquirá", 5.617, -73.818),
    ("Garzón", 2.196, -75.627), ("Tumaco", 1.807, -78.765), ("Maicao", 11.378, -72.24),
    ("Ciénaga", 11.007, -74.247), ("El Banco", 9.0, -73.975), ("Corozal", 9.318, -75.293),
    ("San José del Guaviare", 2.57, -72.641), ("Puerto Asís", 0.505, -76.495),
)
# towns only the copied-coordinate check needs
MORE_TOWNS = (
    ("Cajicá", 4.918, -74.028), ("Chía", 4.861, -74.058), ("Cota", 4.809, -74.098), ("Funza", 4.716, -74.211),
    ("Madrid", 4.733, -74.264), ("Buga", 3.901, -76.298), ("Santander de Quilichao", 3.009, -76.484),
    ("San Agustín", 1.881, -76.268), ("Puerto Colombia", 10.988, -74.955), ("Soledad", 10.917, -74.765),
    ("Itagüí", 6.172, -75.611),
)
# label, latitude, longitude, radius km, step km
METRO_AREAS = (
    ("Bogotá", 4.65, -74.1, 20.0, 6.0), ("Medellín", 6.25, -75.58, 16.0, 6.0),
    ("Cali", 3.43, -76.52, 12.0, 6.0), ("Barranquilla", 10.97, -74.8, 10.0, 6.0),
)

# --- Fixed values: addresses --------------------------------------------------------------
# street words in the order they are tried, and the street type they mean
STREET_WORDS = (
    (r"(?:avenida|avda|av)\s+(?:carrera|kra|cra|kr|cr)", "carrera"),
    (r"(?:avenida|avda|av)\s+(?:calle|cll|cl)", "calle"),
    (r"ak", "carrera"),
    (r"ac", "calle"),
    (r"(?:calle|clle|cll|cl|call|cale)", "calle"),
    (r"(?:carrera|carr|kra|cra|crr|kr|cr)", "carrera"),
    (r"(?:diagonal|diag|dg)", "diagonal"),
    (r"(?:transversal|transv|trans|trv|tv|tr)", "transversal"),
    (r"(?:avenida|avda|av)", "avenida"),
)
STREET_LETTER = r"((?!n\s*[0-9])[a-z](?![a-z]))"
STREET_NUMBER = rf"([0-9]+)(?:\s*{STREET_LETTER})?(?:\s*(bis))?(?:\s*{STREET_LETTER})?"
CROSS_STREET = (
    rf"^(?:#|numero|num|no|n)?\s*{STREET_NUMBER}(?:\s+(sur|este))?"
    rf"(?:(?:\s*-\s*|\s+)([0-9]+)(?:\s+(sur|este){WORD_END})?)?"
)
PLACE_NOISE = rf"{WORD_START}(?:perimetro urbano|ciudad|distrito capital|d c|dc|de indias|centro){WORD_END}"
DEPARTMENTS = (
    "amazonas", "antioquia", "arauca", "atlantico", "bolivar", "boyaca", "caldas", "caqueta", "casanare", "cauca",
    "cesar", "choco", "cordoba", "cundinamarca", "guainia", "guaviare", "huila", "la guajira", "magdalena", "meta",
    "narino", "norte de santander", "putumayo", "quindio", "risaralda", "san andres", "santander", "sucre",
    "tolima", "valle del cauca", "vaupes", "vichada",
)
PLACE_FIELDS = ("city", "town", "village", "municipality", "county")
SETTLEMENT_FIELDS = ("village", "hamlet")
HIT_LIMIT = 40
HIT_MAX_AGE_DAYS = 180
M_PER_DEGREE = 111_320.0
TOUCH_DEGREES = 0.00025
MAX_CORNER_M = 400.0
MAX_CORNER_SPREAD_M = 500.0
MAX_STREET_SPAN_M = 300.0
MAX_STREET_GAP_M = 1000.0
MAX_CROSS_AWAY_M = 150.0

# --- Fixed values: trips ------------------------------------------------------------------
ARRIVAL_M = 30.0
OFF_ROUTE_M = 50.0
OFF_ROUTE_FIXES = 3
REROUTE_PAUSE_MS = 30_000
SEGMENT_TIE_M = 10.0

# --- Fixed values: what a name tastes of or is filled with, and other phrases that mislead --
REPEATED_HEAD = rf"^(\s*)([a-z]{{3,}}?)(?:e?s)?\s+(?=\2(?:e?s)?{WORD_END})"
FLAVOUR_PHRASE = rf"{WORD_START}sabor(?:es)?\s+(?:a\s+|de\s+)?\S+(?:\s\S+)?"
FILLING_PHRASE = rf"{WORD_START}rellen[oa]s?\s+(?:de|con)\s+\S+(?:\s\S+)?"
HOT_DOG = rf"{WORD_START}perros?\s+calientes?{WORD_END}"
