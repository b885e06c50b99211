"""Regular expressions, written for Java's engine (what Spark runs).

The redaction rules are defined with Unicode-aware classes (``\\w``, ``\\d``,
``\\s``, ``\\b`` of a Unicode string pattern). Java's own shorthand classes
are ASCII unless flagged, and its flagged forms are close but not equal, so
each class is spelled out below.
"""

# ---------------------------------------------------------------------------
# Character classes (Unicode semantics, spelled out for Java)
# ---------------------------------------------------------------------------
W = r"[\p{L}\p{N}_]"                       # word character
D = r"\p{Nd}"                               # decimal digit
S = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
     r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")   # whitespace
BL = r"(?<![\p{L}\p{N}_])"                  # word boundary before a word char
BR = r"(?![\p{L}\p{N}_])"                   # word boundary after a word char
# stands first in a rule and only repeats what the rest demands, as one cheap
# test where most positions fail (the classes above are slow to test)
NOT_PRINTED = r"(?![!-~])"                  # no whitespace is printable ASCII
# [A-Z] under case-insensitive matching also takes these four code points
LETTER_CI = r"[A-Za-z\x{130}\x{131}\x{17f}\x{212a}]"

# ---------------------------------------------------------------------------
# Repetitions that nothing else could share are possessive and an address can
# only start where a run starts or where the last match ended: same spans,
# linear time, no recursion in the matcher on texts of any length.
# ---------------------------------------------------------------------------
EMAIL_TOKEN = "[EMAIL_REDACTED]"
PHONE_TOKEN = "[PHONE_REDACTED]"
HEALTH_TOKEN = "[HEALTH_ID_REDACTED]"
REF_TOKEN = "[REF_NUM_REDACTED]"
NAME_TOKEN = "[NAME_REDACTED]"

_ADDRESS = r"[\p{L}\p{N}_.-]"
EMAIL = rf"(?:(?<!{_ADDRESS})|\G){_ADDRESS}++@{_ADDRESS}+\.{W}++"
PHONE = rf"(?:0|\+44){S}*{D}{{2,5}}{S}*{D}{{3,5}}{S}*{D}{{3,6}}"
HEALTH_ID = rf"(?={D}){BL}{D}{{3}}{S}*{D}{{3}}{S}*{D}{{4}}{BR}"
REF_NUM = (rf"{BL}{LETTER_CI}{{2}}{S}*{D}{{2}}{S}*{D}{{2}}{S}*{D}{{2}}"
           rf"{S}*{LETTER_CI}{BR}")

_NAME2 = rf"([A-Z][a-z]++(?:{S}++[A-Z][a-z]++)++)"
CONTEXT_NAME_RULES = [
    rf"(Subject:{S}*){_NAME2}",
    rf"(Coordinator:{S}*){_NAME2}",
    rf"(Kin Contact:{S}*){_NAME2}",
    rf"(Dr\.{S}*)([A-Z][a-z]+)",
]
CONTEXT_REPLACEMENT = "$1" + NAME_TOKEN
# literal each context rule needs (used to skip the regex when absent)
CONTEXT_KEYWORDS = ["Subject:", "Coordinator:", "Kin Contact:", "Dr."]
# the same, as found in raw text before whitespace normalisation
CONTEXT_RAW_KEYWORDS = ["Subject:", "Coordinator:", "Contact:", "Dr."]

# whitespace normalisation before redaction. The rule is "a whitespace run
# holding a newline becomes one space" (written S*\nS*); the possessive form
# below matches the same spans (non-newline whitespace, the first newline,
# then the rest of the run) without backtracking. Single spaces are left as
# they are, so only runs of two or more are rewritten.
S_NO_NL = S[:-1] + r"&&[^\n]]"
NEWLINE_RUN = rf"{NOT_PRINTED}{S_NO_NL}*+\n{S}*+"
SPACE_RUN = r" {2,}"

# generic helpers
WS_RUN = rf"{S}+"
EDGE_WS = rf"{NOT_PRINTED}(?:^{S}+|{S}+$)"

# ---------------------------------------------------------------------------
# HTML (main-content extraction and links)
# ---------------------------------------------------------------------------
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
HTML_STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
# containers in order of preference; blocks removed inside the chosen one;
# other elements whose end tag closes what was left open inside them
HTML_CONTAINERS = ["main", "article", "body"]
HTML_DROPPED_BLOCKS = ["nav", "footer", "header"]
HTML_ENCLOSING = ["html", "div", "section", "aside"]
# each element's one-letter code on the stack of open elements
HTML_CODES = {tag: chr(ord("a") + i) for i, tag in
              enumerate(HTML_CONTAINERS + HTML_DROPPED_BLOCKS + HTML_ENCLOSING)}
HTML_STRUCTURE = rf"(?i)</?(?:{'|'.join(HTML_CODES)})(?=[\s/>])[^>]*+>"
HTML_STRUCTURE_NAME = r"^</?([A-Za-z]+)"
HTML_TAG = r"<[A-Za-z/!?][^>]*>"     # "5 < 6" is text
# Entities decoded, in this order; &amp; must stay last
HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"),
    ("&middot;", "·"), ("&pound;", "£"), ("&euro;", "€"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&hellip;", "…"), ("&bull;", "•"), ("&deg;", "°"),
    ("&frac12;", "½"), ("&eacute;", "é"), ("&reg;", "®"), ("&trade;", "™"),
    ("&amp;", "&"),
]
NUMERIC_ENTITY = r"&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
ANCHOR_HREF = r"""(?is)<a\s(?:[^>]*?[\s"'])?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

URL_SCHEME_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
URL_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
URL_AFTER_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$"
