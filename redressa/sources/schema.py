"""The canonical raw columns, the headers accepted for them, and their notes."""

from __future__ import annotations

# Canonical column -> accepted headers, first non-null wins.
ALIASES = {
    "date_received": ("date_received",),
    "product": ("product",),
    "sub_product": ("sub_product",),
    "issue": ("issue",),
    "sub_issue": ("sub_issue",),
    "consumer_narrative": (
        "consumer_complaint_narrative",
        "consumer_narrative",
        "complaint_what_happened",
    ),
    "company_public_response": ("company_public_response",),
    "company": ("company",),
    "state": ("state",),
    "zip_code": ("zip_code", "zip"),
    "tags": ("tags",),
    "consumer_consent": ("consumer_consent_provided", "consumer_consent"),
    "submitted_via": ("submitted_via",),
    "date_sent_to_company": ("date_sent_to_company",),
    "company_response": ("company_response_to_consumer", "company_response"),
    "timely_response": ("timely_response", "timely"),
    "consumer_disputed": ("consumer_disputed",),
    "complaint_id": ("complaint_id",),
    "raw_source": ("raw_source",),
}
CANONICAL_COLUMNS = tuple(ALIASES)

# What the main derived variables mean; kept as column comments.
DEFINITIONS = {
    "post_cutoff": "1 when received on the cutoff day or later.",
    "any_relief": "1 for a monetary or a non-monetary relief response.",
    "monetary_relief": "1 for a response closed with monetary relief.",
    "non_monetary_relief": "1 for a response closed with non-monetary relief.",
    "timely_binary": "1 when the company response is marked as timely.",
    "n_words": "Words and numbers in the narrative.",
    "avg_sentence_len": "Words per sentence.",
    "lexical_diversity": "Distinct words over all words.",
    "legal_term_count": "Hits of legal and regulatory terms.",
    "evidence_term_count": "Hits of evidence and document terms.",
    "urgency_term_count": "Hits of urgency terms.",
    "hardship_term_count": "Hits of hardship terms.",
    "template_phrase_count": "Hits of repeated legal phrases.",
    "product_group": "Coarse product class used by the models.",
}
