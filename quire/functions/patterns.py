"""Fixed values that must be the same everywhere for equal results: patterns, word lists and constants.

``W`` is the Unicode word class; explicit look-arounds are used for word boundaries because ``\\b`` is ASCII in Java.
"""

WHITESPACE = " \t\n\r\x0b\x0c"
# What a browser trims beyond ASCII white space.
WIDE_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
W = r"\p{L}\p{N}_"
WB = rf"(?<![{W}])"
WE = rf"(?![{W}])"
LATIN = r"A-Za-zÀ-ÖØ-öø-ÿ"
LATIN_UPPER = r"A-ZÀ-ÖØ-Þ"

# --- continuation cues and page numbers (fixed values) ---
_CUE = r"(?i)(?:continued|cont(?:'?d|d)?\.?)\s+{word}\s+(?:(?:page|p\.?|pg\.?)\s*)?(\d{{1,4}})"
CONTINUED_ON = _CUE.format(word="on")
CONTINUED_FROM = _CUE.format(word="from")
PAGE_LABEL = r"(?i)^\s*page\s+(\d+)(?![\p{L}\p{N}_])"
FOLIO_LINE = r"^\s*(?:[—\-–~•·*]+\s*)?(\d{1,4})(?:\s*[—\-–~•·*]+)?\s*$"
CONT_NOISE = r"(?i)^\s*(?:continued\s+(?:on|from)|cont\.?\s+(?:on|from))"

# --- advertising (fixed values) ---
AD_WORDS = (
    r"advertisement|advertising|advertorial|sponsored|circle\s+(?:the\s+)?number|coupon|%\s*off|percent\s+off|"
    r"discount|call\s+(?:now|today)|order\s+now|buy\s+now|limited\s+time|special\s+offer|subscribe\s+now|"
    r"toll[\s-]*free|1[\s\-]*800|save\s+\$|free\s+shipping|while\s+supplies\s+last|act\s+now|"
    r"buy|order|offer|price|free|shipping|money\s+order|cashier'?s\s+check|enclosed\s+is\s+my|"
    r"ship\s+me\s+to|reader\s+service"
)
AD_WORDS_WEB = (
    r"advertisement|advertising|advertorial|sponsored|circle\s+(?:the\s+)?number|coupon|%\s*off|percent\s+off|"
    r"discount|call\s+(?:now|today)|order\s+now|buy\s+now|limited\s+time|special\s+offer|subscribe\s+now|"
    r"toll[\s-]*free|1[\s\-]*800|save\s+\$|free\s+shipping|while\s+supplies\s+last|act\s+now|buy|order|offer|"
    r"price|shipping|money\s+order|cashier'?s\s+check|enclosed\s+is\s+my|ship\s+me\s+to|reader\s+service"
)
SHOUT = r"(?i)(?:\bunbelievable\b|\bincredible\b|\bamazing\b|\bintroducing\b|new!|only\s*\$)"
# The web rule closes with a word boundary, so "new!" and "only $" need a word character right after them.
SHOUT_WEB = r"(?i)\b(?:unbelievable|incredible|amazing|introducing|new!|only\s*\$)\b"
FORM_AD = (
    r"(?i)(?:enclosed\s+is\s+my|cashier'?s\s+check|money\s+order|personal\s+check|ship\s+me\s+to|"
    r"circle\s+the\s+number|reader\s+service|bingo\s+card)"
)

# --- running heads, dates, page numbers in margins (fixed values) ---
FILE_OR_URL = (
    r"(?i)\b(?:file:///|https?://|www\.|about:blank|chrome-extension://|blob:|data:|[a-zA-Z]:\\[^\n\r]+|"
    r"/(?:Users|home|var|tmp|etc|usr|opt)/[^\n\r]+|\b[a-zA-Z0-9_\-]+\.(?:pdf|html|htm|doc|docx|txt|epub)\b)"
)
BROWSER_ARTIFACT = r"(?i)\b(?:text\s+canvas|page\s+\d+\s+of\s+\d+|\d+\s+of\s+\d+|\b\d+\s*/\s*\d{1,4}\b)\b"
_MONTH = (
    r"(?:january|february|march|april|may|june|july|august|september|october|november|december|"
    r"jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
)
DATE_OR_TIME = (
    r"(?i)\b(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}(?:,?\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?)?|"
    r"\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}|\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)|"
    rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{2,4}}|\b{_MONTH}\s+\d{{2,4}}|\b\d{{1,2}}\s+{_MONTH}\s+\d{{2,4}})\b"
)
ISSUE_VOL = (
    r"(?i)\b(issue\s+(?:number\s+)?\d+|vol(?:ume)?\.?\s*\d+|no\.?\s*\d+|"
    r"spring\s+\d{4}|summer\s+\d{4}|fall\s+\d{4}|autumn\s+\d{4}|winter\s+\d{4})\b"
)
YEAR = r"\b(?:19\d\d|20\d\d)\b"
PAGE_NUMBER = (
    r"(?i)^\s*(?:page|pg\.?|p\.?|folio|seite|pág\.?)?\s*[-–—#\[(]?\s*(\d{1,4})\s*[-–—\])]?"
    r"(?:\s*(?:of|/|-)\s*\d{1,4})?\.?\s*$"
)
ROMAN_NUMBER = r"^\s*(?:page|pg\.?|p\.?)?\s*[-–—#\[(]?\s*([ivxlcdmIVXLCDM]{1,8})\s*[-–—\])]?\.?\s*$"
PAGE_OF = r"(?i)^\s*(?:page|pg\.?|p\.?)\s*\d+\s*(?:of|/)\s*\d+\s*$"
PUBLISHER = (
    r"(?i)\b(published\s+monthly\s+by|all\s+rights\s+reserved|printed\s+in\s+usa|issn\s+[\d\-x]+|"
    r"isbn\s+[\d\-x]+|publications?,\s+inc\.?)\b"
)
METADATA_LINE = r"(?i)^\s*(?:printed\s+in\s+usa|all\s+rights\s+reserved|\$[\d.]+\s+in\s+[a-z\s]+)\s*$"
HEADER_PUNCT = r"[\s\-_.,;:'\"()\[\]/\\|#]+"
TOP_ZONE, BOTTOM_ZONE, MAX_HEADER_CHARS = 0.18, 0.82, 140

# --- months and issue dates (fixed values) ---
MONTHS = (
    "January February March April May June July August September October November December"
).split()
ISSUE_DATE = r"(?i)(?:^|[_\-\s])((?:19|20)\d{2})[_\-](0?[1-9]|1[0-2])(?:$|[_\-\s])"

# --- speech garbage (fixed values) ---
LONG_DASHES = r"[-–—]{4,}"
COMMON_SHORT = (
    "a i an am pm no in on at to of or is it as by up so ok us we ea ft lb oz pt sq vs dc ac hz"
).split()

# --- tables and rules (fixed values) ---
RULE_CHARS = r"\-_─━—–═−~"
BOX = r"─-╿▀-▟"
TABLE_LINES = [
    rf"^[\s{BOX}|+\-=_~#*•·—–:;.,\\/]{{3,}}$",
    r"^[\s|:+*\-=_~#•]{3,}$",
    r"^[\s\-_=.·•*~^#/\\|]{3,}$",
    r"^[.\s·•…_\-]{4,}$",
    r"^[\s|:+*\-=_~#•\\]*$",
]
TABLE_SYMBOLS = r"[─-╿|+\-=_~#*•·—–:;\\/]"

# --- gibberish tokens (fixed values) ---
TWO_LETTER_WORDS = (
    "am an as at be by do go he hi if in is it me my no of on or so to up us we re ex ox ok fi se id tv pc db io ai "
    "ui os ip vr ar st nd rd th"
).split()
SHORT_UNITS = (
    r"(?i)^(?:[aI]|a\.m\.|p\.m\.|e\.g\.|i\.e\.|vs|ft|in|cm|mm|kg|ms|ns|v|w|a|k|m|g|c|p|d|x|y|z)$"
)
TECH_CODES = (
    r"(?i)^(?:\d+[KkMbGg]|\d+th|\d+st|\d+nd|\d+rd|z80|8080|6800|6502|8086|8088|rs232|v\d+[.\d]*|\d+[ad]c|\d+hz|"
    r"\d+mhz|\d+kb|\d+mb|\d+bit|mpu\d*|\d+d)$"
)

# --- hyphenation and split words (fixed values) ---
CONNECTORS = "a an and as at based by for from in like of on or the to with".split()
PREFIXES = (
    "micro macro inter intra multi ultra super semi anti auto tele trans sub pseudo mono poly omni tieto ohjel puheen "
    "lait järjes kirjoi elektroniik"
).split()
SUFFIXES = (
    "ing tion tions ation ations ment ments able ible ness less ful fully sion sions ity ities ized izing ally"
).split()
SPLIT_WORDS = [
    ("cir", "cuits?"), ("syn", "thesi[sz]ers?|thetic|thesis"), ("soft|hard", "wares?"), ("key", "boards?"),
    ("data", "base[s]?"), ("byte", "savers?"), ("star", "ships?"), ("fre", "quenc(?:y|ies)"), ("sig", "nals?"),
    ("os", "cillat(?:or|ors|ion)"), ("re", "gist(?:er|ers|ered|ration)"), ("me", "mor(?:y|ies)"),
    ("ca", "paci(?:ty|tor|tors|tance)"), ("con", "troll?ers?|trols?|trolled|trolling"),
    ("trans", "fer|fers|ferred|ferring"), ("dia", "grams?"), ("wave", "forms?"), ("mag", "azines?"),
    ("pub", "licat(?:ion|ions)"), ("pro", "gramm?ers?|gramm?ing|grams?"), ("com", "puters?|puting"),
]
BROKEN_LETTERS = [
    ("t|w|a|h", "he|hat|his|hese|hose|ith|ere|hen|hich|nd|ave|ad|as"),
    ("speec|whic|wit|eac|muc|suc|researc|approac|pitc|catc|matc|switc", "h"),
    ("compute|printe|characte|generato|buffe|use|membe|autho|develope", "r"),
    ("circui|outpu|inpu|uni|digi|forma|curren", "t"),
]
FINAL_C = (
    "homc", "timc", "somc", "namc", "samc", "makc", "takc", "comc", "havc", "givc", "pagc", "linc", "widc", "lifc",
    "wifc", "drivc", "sidc",
)
# Syllable splits whose repair is the lower-case text without the blanks.
SYLLABLES = (
    "co m p ut er", "com put er", "co mpu ter", "c o m p u t e r", "com put ers", "ex per i ment", "th e", "wh o",
    "wh at", "wh ere", "wh ich", "wh en", "th at", "th is", "th ese", "th ose", "th eir", "th ere", "sh e", "des ign",
    "des igns", "des igned", "des igning", "per son", "per sons", "start ed", "writ es", "writ ing", "an d",
    "mi cro pro ces sor", "mi cro pro ces sors", "micro pro cessor", "micro pro cessors", "elec tron ic",
    "elec tron ics", "pro gram ming", "pro gram mer", "pro gram mers", "syn the si zer", "syn the si zers",
    "in ter fa ce", "in ter fa ces", "key board", "key boards", "dis play", "dis plays", "sys tem", "sys tems",
)
EXPERIMENTATION = [
    r"ex\s+pc?\s*rimc?\s*nt\s*a?\s*ti\s*on",
    r"ex\s+per\s+i\s+men\s+ta\s+tion",
    r"ex\s+peri\s+men\s+ta\s+tion",
    r"ex\s+per\s+i\s+ment\s+a\s+tion",
]
STANDALONE_SHORT = (
    "a i am an as at be by do go he if in is it me my no of on or so to up us we re hi ok ex ox "
    "all and any are bad bar bed big bit box boy bus but buy can car cat cut day did dog dry due ear eat end eye far "
    "few fit fly for get god got guy had has hat her him his hit how its job key kid law lay let lot low man may new "
    "not now off old one our out own pay per put red run saw say see set she sir sit six son sun ten the too top try "
    "two use war way who why win yes yet you"
).split()
FRAGMENT_COMMON = (
    "a an as at be by do go he if in is it me my no of on or so to up us we the and for are but not you all can had "
    "her was one our out has him his how its may new now old see two way who boy did yet she say get let put ask own "
    "too any"
).split()

# --- form blanks, contractions, abbreviations (fixed values) ---
FORM_BLANKS = [
    (r"\$\s*_{2,}", " dollar amount here "),
    (r"NAME\s*_{2,}", " your name here "),
    (r"ADDRESS\s*_{2,}", " your address here "),
    (r"(?:ZIP(?:\s*CODE)?|POSTAL\s*CODE)\s*_{2,}", " ZIP code here "),
    (r"CITY\s*_{2,}", " city here "),
    (r"(?:PHONE|TEL(?:EPHONE)?)\s*_{2,}", " phone number here "),
    (r"E-?MAIL\s*_{2,}", " email here "),
    (r"(?:COMPANY|ORG(?:ANIZATION)?)\s*_{2,}", " company name here "),
    (r"DATE\s*_{2,}", " date here "),
    (r"SIGNATURE\s*_{2,}", " signature here "),
]
CONTRACTIONS = {
    "you'll": "you will", "we'll": "we will", "they'll": "they will", "i'll": "I will", "he'll": "he will",
    "she'll": "she will", "it'll": "it will", "that'll": "that will", "there'll": "there will",
    "you're": "you are", "we're": "we are", "they're": "they are", "it's": "it is", "that's": "that is",
    "what's": "what is", "who's": "who is", "here's": "here is", "there's": "there is", "let's": "let us",
    "you've": "you have", "we've": "we have", "they've": "they have", "i've": "I have", "you'd": "you would",
    "we'd": "we would", "i'd": "I would", "don't": "do not", "doesn't": "does not", "didn't": "did not",
    "won't": "will not", "wouldn't": "would not", "can't": "cannot", "couldn't": "could not",
    "shouldn't": "should not", "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not",
    "haven't": "have not", "hasn't": "has not", "hadn't": "had not",
}
ABBREVIATIONS = {
    "ea": "each", "etc": "et cetera", "vs": "versus", "approx": "approximately", "dept": "department",
    "est": "established", "ft": "feet", "lb": "pounds", "oz": "ounces", "pt": "point", "sec": "second", "sq": "square",
    "jan": "January", "feb": "February", "mar": "March", "apr": "April", "jun": "June", "jul": "July", "aug": "August",
    "sep": "September", "sept": "September", "oct": "October", "nov": "November", "dec": "December",
}

# --- boilerplate (fixed values) ---
JUNK_PHRASES = [
    r"Circle\s+\d{1,4}\s+on\s+(?:inquiry|reader|service)\s+(?:card|coupon)\b",
    r"(?:send|mail)\s+(?:check|money\s+order|coupon|order)\s+to\b[^\n\r.]*",
    r"postage\s+paid\s+at\b[^\n\r.]*",
    r"(?:write|call)\s+for\s+(?:free|our)\s+(?:catalog|brochure|info|details)\b[^\n\r.]*",
    r"(?:order|get)\s+yours\s+(?:today|now)\b",
    r"(?:satisfaction\s+guaranteed|money[\s-]back\s+guarantee)\b",
    r"(?:dealer|distributor)\s+inquiries\s+invited\b",
    r"(?:california|new\s+york|massachusetts|illinois)\s+residents\s+add\s+\d+%\s+tax\b",
    r"allow\s+\d+\s+weeks\s+for\s+delivery\b",
    r"(?:dept\.?\s*\w+|p\.?o\.?\s*box\s*\d+)\b",
    r"(?:continued\s+on\s+page|continued\s+from\s+page|see\s+page)\s+\d{1,4}\b",
    r"(?:NAME|ADDRESS|CITY|STATE|ZIP|PHONE|EMAIL)\s*_{2,}",
]
#: first letters of all of them
JUNK_OPENING = "(?=[acdegimnopswz])"
JUNK_LINES = [
    r"(?i)\b(?:copyright|©|\(c\))\s+(?:\d{4}|19\d\d|20\d\d)",
    r"(?i)\ball\s+rights\s+reserved\b",
    r"(?i)\bprinted\s+in\s+u\.?s\.?a\.?\b",
    r"(?i)\bpublished\s+monthly\s+by\b",
    r"(?i)\b(?:second\s+class\s+postage\s+paid)\b",
    r"(?i)\b(?:subscription\s+rates?|single\s+copy\s+price)\b",
    r"(?i)\bCircle\s+\d{1,4}\s+on\s+(?:inquiry|reader)\s+card\b",
]

# --- word-level symbols (fixed values) ---
DINGBATS = r"[■-◿☀-⛿✀-➿]"
SYMBOL_RUN = r"^[|+\-=_~#*•·—–^\\/]{2,}$"
DOT_LEADERS = r"[.·•_]{3,}"
EMPTY_BRACKET = r"\s*[xX*•\-_\s]?\s*"
EDGE_NOISE = r"[|~#*•·^/\\=_+`§°©®™%\[\]{}<>]"

# --- containers and blocks of HTML (fixed values) ---
HTML_DROPPED = "script style noscript svg nav header footer iframe".split()
HTML_BLOCKS = "h1 h2 h3 h4 h5 h6 p blockquote pre li td".split()

IMAGE_EXTENSIONS = "jpg jpeg png tif tiff webp bmp".split()
SKIP_MARK = r"(?i)^\s*\[\[SKIP_AS_AD\]\]\s*"
