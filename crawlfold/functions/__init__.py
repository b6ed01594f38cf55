"""Column -> Column functions (text, URLs, scores, extraction)."""

from crawlfold.functions.extract import (  # noqa: F401
    context_numbers, context_ok, email_plain, email_rfc, email_simple, extract_context,
    joined, luhn_valid, number_hits, parse_ignore_list, siren_plain, siret_plain, sorted_set,
)
from crawlfold.functions.scoring import score_max, score_rules, score_sum  # noqa: F401
from crawlfold.functions.text import (  # noqa: F401
    clean_ws, collapse_ws, decode_entities, deobfuscate_email, digits_only, page_text, unaccent,
)
from crawlfold.functions.urls import (  # noqa: F401
    candidate_keyword, domain_key, http_only, internal_link, netloc, normalize_url, origin,
    same_host, scheme, skip_scheme, url_join, url_path, url_variants,
)
