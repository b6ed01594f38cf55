"""Keyword lists, weights and patterns.

FIXED VALUES: every list, weight and pattern in this module must equal the
behaviour being reproduced for results to match; they are stated plainly, in
their natural order, and are not derived from anything.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (pipeline A, page scoring for candidate gating)
# ---------------------------------------------------------------------------
LEGAL_PATH_WORDS = [
    "mentionslegales", "mentions-legales", "mentions_legales", "mentions-légales",
    "mentions_légales", "mentionslégales", "legal-notice", "legal_notice",
    "legalnotice", "legal", "legales", "légales",
]
SECONDARY_PATH_WORDS = [
    "contact", "about", "a-propos", "apropos", "about-us", "aboutus",
    "infos", "informations", "cgu", "cgv", "privacy", "policy",
    "terms", "conditions", "impressum", "rgpd", "gdpr",
]
IRRELEVANT_PATH_WORDS = ["blog", "article", "news", "post"]
LOCALE_SEGMENTS = ["fr", "en"]
PAGE_SUFFIXES = [".html", ".php", ".htm"]
# rule points: localized legal segment, footer+legal, legal, secondary, suffix, irrelevant
SCORE_LOCALIZED = 15
SCORE_FOOTER_LEGAL = 12
SCORE_LEGAL = 10
SCORE_SECONDARY = 5
SCORE_SUFFIX = 2
SCORE_IRRELEVANT = -5
GATE_MIN_SCORE = 1.0
LEGAL_COUNT_WORDS = ["mentions", "legal"]

# ---------------------------------------------------------------------------
# FIXED VALUES (pipeline A, crawl link weights; max-of-weights score)
# ---------------------------------------------------------------------------
CRAWL_WEIGHTS = [
    ("mentions légales", 1.0),
    ("mentions-legales", 1.0),
    ("legal", 0.8),
    ("legal-notice", 0.8),
    ("cgv", 0.7),
    ("conditions générales", 0.7),
    ("conditions-generales", 0.7),
    ("politique de confidentialité", 0.6),
    ("confidentialite", 0.6),
    ("privacy", 0.6),
    ("terms", 0.5),
    ("about", 0.4),
    ("contact", 0.3),
]
CRAWL_TEXT_BONUS = 1.2
CRAWL_SHORT_PATH_BONUS = 1.2
CRAWL_SHORT_PATH_PARTS = 2
CRAWL_MAX_DEPTH = 2
CRAWL_MAX_VISITED = 100

# ---------------------------------------------------------------------------
# FIXED VALUES (pipeline B, candidate URL keywords)
# ---------------------------------------------------------------------------
CANDIDATE_KEYWORDS = [
    "mentions", "mentions-legales", "mentions-légales", "legal", "legales", "légales",
    "mentions_legales", "mentions_légales", "mentionslegales", "mentionslégales",
    "fr/terms", "fr/legal", "fr/mentions-legales", "fr/mentions", "fr/cgu",
    "en/terms", "en/legal", "en/legal-notice",
    "cgu", "cgv", "infos", "contact", "a-propos", "about", "about-us", "impressum",
    "privacy", "policy", "terms", "conditions", "terms-and-conditions",
    "informations-legales", "informations-légales", "legal-notice", "legalnotice",
    "terms-of-service", "terms-of-use", "conditions-generales-de-vente",
    "politique-de-confidentialite", "politique-confidentialite",
    "rgpd", "gdpr", "data-protection", "protection-des-donnees", "private-policy",
    "termes", "charte", "conditions-generales", "conditionsgenerales",
    "informations", "mentions-obligatoires", "mentionsobligatoires",
    "avis-juridiques", "disclaimer", "cookies", "cookie-policy",
    "avis-legaux", "legal-information", "legalinformation",
    "footer/legal", "footer/terms", "footer/mentions-legales",
    "legal.html", "legal.php", "mentions-legales.html", "mentions-legales.php",
    "terms.html", "terms.php",
]

# ---------------------------------------------------------------------------
# FIXED VALUES (pipeline B, additive page score)
# ---------------------------------------------------------------------------
URL_SUM_WEIGHTS = [
    ("mention", 2.0),
    ("legal", 2.0),
    ("contact", 1.5),
    ("about", 1.0),
    ("apropos", 1.0),
    ("entreprise", 1.0),
    ("societe", 1.0),
    ("cgv", 1.5),
    ("condition", 1.0),
    ("rcs", 2.0),
    ("siret", 2.0),
    ("siren", 2.0),
]
TEXT_SUM_WEIGHTS = [
    ("siren", 2.0),
    ("siret", 2.0),
    ("rcs", 1.5),
    ("société", 1.0),
    ("capital", 1.0),
    ("immatriculation", 1.5),
    ("registre", 1.0),
    ("commerce", 1.0),
]
TOP_URLS_PER_STAGE = 10
SITE_CRAWL_MAX_DEPTH = 2
SITE_CRAWL_MAX_PAGES = 20

# ---------------------------------------------------------------------------
# FIXED VALUES (pipeline B, identifier context gate)
# ---------------------------------------------------------------------------
CONTEXT_KEYWORDS = [
    "siret", "siren", "rcs", "numero", "numéro", "n°", "immatriculation",
    "registre", "commerce", "sociétés", "societes", "entreprise",
    "identification", "tva", "fiscal", "fiscale",
]
CONTEXT_WINDOW = 10

# ---------------------------------------------------------------------------
# FIXED VALUES (pipeline B, e-mail de-obfuscation, applied in this order)
# ---------------------------------------------------------------------------
OBFUSCATION_RULES = [
    (r"\[at\]", "@"),
    (r"\(at\)", "@"),
    (" at ", "@"),
    (r"\[dot\]", "."),
    (r"\(dot\)", "."),
    (" dot ", "."),
    (r"\[point\]", "."),
    (r"\(point\)", "."),
    (" point ", "."),
]

# ---------------------------------------------------------------------------
# FIXED VALUES (pipeline B, footer classes)
# ---------------------------------------------------------------------------
FOOTER_CLASS_WORDS_A = ["footer"]
FOOTER_CLASS_WORDS_B = ["footer", "bottom", "bas-page"]

# ---------------------------------------------------------------------------
# FIXED VALUES (pipeline B, zones of the cleaned page text)
# ---------------------------------------------------------------------------
ZONE_METAS = [("name", "description"), ("property", "og:description"), ("name", "keywords")]
ZONE_FOOTER = "footer"
ZONE_WORDS = ["legal", "mention", "contact", "about", "apropos", "societe", "entreprise", "cgv", "condition"]

# ---------------------------------------------------------------------------
# FIXED VALUES (pipeline B, scored page crawl)
# ---------------------------------------------------------------------------
PAGE_CRAWL_MIN_SCORE = 1.0
PAGE_CRAWL_MAX_FOUND = 10

# ---------------------------------------------------------------------------
# FIXED VALUES (patterns)
# ---------------------------------------------------------------------------
SIREN_PLAIN = r"\b(\d{3}\s?\d{3}\s?\d{3})\b"
SIRET_PLAIN = r"\b(\d{3}\s?\d{3}\s?\d{3}\s?\d{5})\b"
EMAIL_PLAIN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_SIMPLE = r"[\w\.-]+@[\w\.-]+\.\w+"
SIREN_CONTEXT = r"(?:^|[^\d])(\d{3}[ .-]?\d{3}[ .-]?\d{3})(?:[^\d]|$)"
SIRET_CONTEXT = r"(?:^|[^\d])(\d{3}[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{5})(?:[^\d]|$)"
EMAIL_RFC = (
    r"""(?:[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*|"(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])*")@(?:(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?|\[(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?|[a-z0-9-]*[a-z0-9]:(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x5a\x53-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])+)\])"""
)
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
SITEMAP_LOC_LENIENT = r"<loc>(.*?)</loc>"
SITEMAP_BARE_URL_COMPAT = r"""https?://[^\s<>"]+?(?<![\.,])"""
URL_VARIANT_TEMPLATES = ["https://www.{}", "https://{}", "http://www.{}", "http://{}"]
SKIP_HREF_PREFIXES_L2 = ["#", "javascript:", "tel:", "mailto:"]
SKIP_HREF_PREFIXES_C1 = ["#", "mailto:", "tel:"]
KEEP_AS_IS_PREFIXES_L1 = ["http", "https", "mailto", "tel", "#"]
STATUS_OK = "success"
STATUS_ERROR = "error"
ERROR_NO_BASE_URL = "Could not determine base URL"
