"""Rule pack for loan and property paperwork: plain tables that operators take as arguments."""

# Text cleaning.  Each rule is (pattern, replacement), applied in order.
NOISE_RULES = (
    (r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]", " "),
    (r"[▪◦□■●◆▶►→←↑↓©®™°•]", " "),
)
SPACE_RULE = (r"\s{3,}", "  ")
NUMBER_RULES = (
    (r"(?<=\d)O(?=\d)", "0"),
    (r"(?<=\d)O(?=\b)", "0"),
    (r"\bO(?=\d)", "0"),
    (r"(\$\s{0,2})O", "$10"),
    (r"(?<=\d)[Il|](?=\d)", "1"),
    (r"(?<=\d)[Il|](?=\b)", "1"),
    (r"\b[Il](?=\d)", "1"),
    (r"(?<=\d)S(?=\d)", "5"),
    (r"\bS(?=\d{2,})", "5"),
    (r"(?<=\d)Z(?=\d)", "2"),
    (r"\bZ(?=\d{3,})", "2"),
    (r"(?<=\d)B(?=\d)", "8"),
    (r"(?<=\d)G(?=\d)", "6"),
    (r"(?<=\$)\s+", ""),
)
WORD_RULES = (
    (r"(?<=[a-z])rn(?=[a-z])", "m"),
    (r"(?<=[a-z])cl(?=[a-z])", "d"),
    (r"(?<=[a-z])li(?=[a-z])", "h"),
    (r"(?<=[a-z])vv(?=[a-z])", "w"),
    (r"(?<=[a-z])ii(?=[a-z])", "u"),
)

# Words that mark a page of corrections, and the pattern of a corrected amount.
CORRECTION_KEYWORDS = (
    "addendum", "revised", "revision", "correction", "corrected", "amendment", "amended", "per county", "reinspection", "updated schedule", "erratum", "errata",
    "notice of change", "as-corrected", "as corrected", "schedule b", "supplement", "modification", "change order", "supersedes", "supercedes", "overrides", "replaces",
    "pursuant to notice", "post-cd", "post cd", "fee schedule update", "updated fee", "restated", "restatement", "updated disclosure", "updated appraisal",
    "stale appraisal", "new appraisal", "reconsidered value", "reconsideration of value", "adjusted value", "rov ", "change of circumstance", "changed circumstance",
    "notice of updated", "re-disclosure", "redisclosure", "tolerance cure", "cure payment", "value update", "field update", "data update", "replacement page",
)
CORRECTION_VALUE = r"(?:revised|corrected|updated|new|correct)\s+(?:value|amount|fee|total|cost|rate|ltv).*?\$[\d,]+(?:\.\d{2})?"
CORRECTION_TRIGGER = r"\b(ADDENDUM|ADDENDA|CORRECTION|REVISED|REVISION|REINSPECTION|ERRATA|AMENDMENT)\b"
# Field, pattern of its corrected value (dot spans lines where told), text before and after it.
REVISION_PATTERNS = (
    ("appraised_value", r"(?is)appraised\s+value\b.{0,120}?(?:revised|adjusted|corrected)\b.{0,50}?\$\s*([\d,]+(?:\.\d{2})?)", "$", ""),
    ("appraised_value", r"(?i)(?:revised|adjusted)\s+(?:downward|upward)\s+to\s+\$\s*([\d,]+(?:\.\d{2})?)", "$", ""),
    ("total_closing_costs", r"(?i)(?:revised|updated)\s+total\s+closing\s+costs\s*[:\-]?\s*\$\s*([\d,]+(?:\.\d{2})?)", "$", ""),
    ("taxes_and_govt_fees", r"(?is)(?:recording\s+fee|govt\s+fee|government\s+fee)\b.{0,80}?(?:revised|corrected)\s+to\s+\$\s*([\d,]+(?:\.\d{2})?)", "$", ""),
    ("ltv_revised", r"(?i)revised\s+ltv\s*[:\(]?\s*([\d.]+)\s*%", "", "%"),
)

# Phrases by which a described element is absent.
NEGATIONS = (
    "no visible", "not visible", "not present", "none visible", "no watermark", "no stamp", "no signature", "not found", "absent", "none detected", "not detected",
    "n/a", "does not appear", "cannot be seen", "could not be found", "is not present", "are not present",
)
TEXT_QUALITIES = ("clean", "noisy", "degraded", "unreadable")
ELEMENT_TYPES = ("signature", "stamp", "watermark", "logo", "image", "handwriting", "checkbox")
CONFIDENCES = ("high", "medium", "low")
NULL_LIKE = ("", "null", "none", "n/a", "not applicable")

# Kinds of fields.
MONEY_FIELDS = (
    "loan_amount", "origination_charges", "total_loan_costs", "total_closing_costs", "taxes_and_govt_fees", "prepaids", "total_other_costs", "appraised_value",
    "escrow_deposit", "monthly_escrow", "aggregate_adjustment", "insurance_annual", "property_tax_annual", "flood_zone_surcharge", "comparable_sale_1",
    "comparable_sale_2", "comparable_sale_3", "services_borrower_shopped", "services_borrower_did_not_shop", "adjustment_amount",
)
PERCENT_FIELDS = ("interest_rate", "ltv_ratio", "ltv_original", "ltv_revised")
DATE_FIELDS = ("date_issued", "inspection_date", "correction_date")
UNCORRECTED_FIELDS = ("ltv_original", "appraised_value_original")

# The canonical field names, in order.
SCHEMA_FIELDS = (
    "loan_number", "borrower_name", "co_borrower_name", "property_address", "loan_amount", "interest_rate", "loan_term", "loan_purpose", "loan_type",
    "origination_charges", "services_borrower_did_not_shop", "services_borrower_shopped", "total_loan_costs", "taxes_and_govt_fees", "prepaids",
    "total_other_costs", "total_closing_costs", "appraised_value", "property_type", "year_built", "gross_living_area", "appraiser_name", "appraiser_cert",
    "inspection_date", "file_ref", "associated_loan_number", "ltv_original", "ltv_revised", "adjustment_amount", "adjustment_basis", "escrow_deposit",
    "monthly_escrow", "aggregate_adjustment", "insurance_annual", "property_tax_annual", "flood_zone_surcharge", "comparable_sale_1", "comparable_sale_2",
    "comparable_sale_3", "lender_name", "nmls", "date_issued", "borrower_signature_present", "loan_number_on_signature_page", "correction_date",
)
# Other names of the canonical fields.
ALIASES = {
    "taxes_and_govt_fees": ("recording_fee", "recording_fees", "govt_recording_fee", "government_recording_fee", "county_tax", "county_taxes", "transfer_taxes", "transfer_tax", "state_tax", "state_taxes", "govt_fees", "government_fees"),
    "total_closing_costs": ("updated_closing_total", "revised_closing_total", "total_closing", "closing_costs_total"),
    "appraised_value": ("revised_value", "updated_value", "corrected_value", "market_value", "estimated_value", "opinion_of_value", "property_value"),
    "ltv_original": ("ltv", "loan_to_value", "loan_to_value_ratio", "ltv_ratio"),
    "ltv_revised": ("revised_ltv", "updated_ltv", "corrected_ltv"),
    "loan_number": ("loan_id", "loan_no"),
    "file_ref": ("file_number", "file_no"),
    "services_borrower_did_not_shop": ("services_not_shopped", "services_borrower_did_not_shop_for", "lender_required_services"),
    "services_borrower_shopped": ("services_shopped", "borrower_shopped_services"),
    "origination_charges": ("origination_fee", "origination_fees", "lender_fees"),
    "prepaids": ("prepaid_items", "prepaid_interest", "prepaid_insurance"),
    "property_tax_annual": ("property_taxes_annual", "annual_taxes", "annual_property_tax"),
    "insurance_annual": ("hazard_insurance", "homeowners_insurance", "annual_insurance"),
    "gross_living_area": ("gross_area", "gla", "living_area", "sq_ft", "square_footage"),
    "appraiser_name": ("appraiser",),
    "appraiser_cert": ("appraiser_license", "appraiser_certification"),
    "comparable_sale_1": ("sale_1", "comp_1", "comparable_1"),
    "comparable_sale_2": ("sale_2", "comp_2", "comparable_2"),
    "comparable_sale_3": ("sale_3", "comp_3", "comparable_3"),
    "escrow_deposit": ("escrow", "initial_escrow"),
    "monthly_escrow": ("monthly_payment_escrow",),
    "adjustment_amount": ("net_adjustment", "total_adjustment"),
    "lender_name": ("lender", "mortgage_lender"),
    "nmls": ("nmls_id", "nmls_number"),
    "date_issued": ("issue_date", "issuance_date", "document_date", "effective_date"),
    "borrower_signature_present": ("signed", "signature_present"),
    "borrower_name": ("borrower",),
    "co_borrower_name": ("co_borrower", "coborrower"),
    "property_address": ("address", "subject_property", "property"),
    "interest_rate": ("rate", "note_rate", "loan_rate"),
    "loan_term": ("term", "loan_term_months", "amortization_term"),
    "loan_purpose": ("purpose", "loan_purpose_type"),
    "loan_type": ("type", "loan_product"),
    "year_built": ("year", "year_construction"),
}

# Labels of table rows -> field.
TABLE_LABELS = {
    "origination_charges": ("origination charges", "origination charge", "origination fee", "lender fees", "lender origination fee"),
    "services_borrower_did_not_shop": ("services borrower did not shop for", "services you cannot shop for", "services you did not shop for", "required services (no shop)"),
    "services_borrower_shopped": ("services borrower did shop for", "services you can shop for", "services you did shop for", "optional services"),
    "total_loan_costs": ("total loan costs", "total loan costs (a+b+c)", "total loan costs (a + b + c)", "d. total loan costs"),
    "taxes_and_govt_fees": ("taxes and govt fees", "taxes and other govt fees", "taxes and government fees", "taxes, and other government fees", "e. taxes and other government fees"),
    "prepaids": ("prepaids", "prepaid items", "f. prepaids"),
    "escrow_deposit": ("initial escrow payment", "initial escrow payment at closing", "g. initial escrow payment at closing"),
    "total_other_costs": ("other", "other costs", "total other costs", "total other costs (e+f+g+h)", "total other costs (e + f + g + h)", "i. total other costs"),
    "total_closing_costs": ("total closing costs", "total closing costs (d+i)", "total closing costs (d + i)", "j. total closing costs (d + i)"),
    "monthly_escrow": ("monthly escrow payment", "monthly escrow"),
    "aggregate_adjustment": ("aggregate adjustment",),
}

# Sums that fields must satisfy: check, total, components, whether another check's flag makes it moot.
SUM_CHECKS = (
    ("loan_costs", "total_loan_costs", ("origination_charges", "services_borrower_did_not_shop", "services_borrower_shopped"), None),
    ("other_costs", "total_other_costs", ("taxes_and_govt_fees", "prepaids"), None),
    ("closing_costs", "total_closing_costs", ("total_loan_costs", "total_other_costs"), None),
    ("closing_components", "total_closing_costs", ("origination_charges", "services_borrower_did_not_shop", "services_borrower_shopped", "taxes_and_govt_fees", "prepaids"), "closing_costs"),
)
SUM_TOLERANCE, CELL_TOLERANCE, RATIO_TOLERANCE = 1.01, 1.00, 0.6
GENERIC_EXCLUDED = ("ltv_original", "ltv_revised", "interest_rate", "loan_term", "year_built")

# Signals of document types; those marked True belong to one type only and count three.
TYPE_SIGNALS = {
    "Loan Estimate": {
        "loan estimate": True, "this is not a commitment to make a loan": True, "before you close": True, "good faith estimate": False, "intent to proceed": False, "rate lock": False,
        "application received": False, "projected payments": True, "estimated total monthly payment": True, "costs at closing": False, "estimated closing costs": False,
        "estimated cash to close": False, "origination charges": False, "services you cannot shop for": False, "services you can shop for": False,
        "services borrower did not shop for": False, "services borrower did shop for": False, "loan costs": False, "other costs": False, "prepaids": False,
        "initial escrow payment": False, "loan terms": False, "nmls": False, "comparisons use this chart": False, "other considerations": False,
        "this form is a statement of final loan terms": False,
    },
    "Property Appraisal Summary": {
        "appraisal": False, "appraised value": False, "uniform residential appraisal": True, "urar": True, "comparable sale": False, "market conditions": False,
        "gross living area": False, "appraiser certification": True, "subject property": False, "neighborhood": False, "site area": False, "above grade": False,
        "below grade": False, "condition rating": False, "quality rating": False, "reconciliation": False, "opinion of value": True, "effective date of appraisal": False,
        "sales comparison approach": True, "cost approach": False, "income approach": False, "reinspection": False, "reconsideration of value": False, "adjusted value": False,
    },
    "Closing Disclosure": {
        "closing disclosure": True, "three business days before": True, "consummation date": True, "cash to close": False, "summaries of transactions": True,
        "due from borrower at closing": True, "adjustments for items paid by seller": False, "paid already by or on behalf of borrower": False, "due to seller at closing": False,
        "loan costs paid": False, "other costs paid": False, "total closing costs paid": False, "loan disclosures": False, "assumption": False, "demand feature": False,
        "late payment": False, "negative amortization": False, "partial payment": False, "security interest": False, "escrow account": False, "cd form": False,
    },
    "Promissory Note": {
        "promissory note": False, "note rate": False, "i promise to pay": True, "monthly payment": False, "maturity date": False, "prepayment": False,
        "borrower's right to prepay": True, "place of payment": False, "default": False, "notice of default": False, "note holder": True,
        "failure to pay as required": False, "giving of notices": False,
    },
    "Deed of Trust": {
        "deed of trust": False, "mortgage": False, "trustee": True, "grantor": False, "grantee": False, "security instrument": False, "covenants": False,
        "hazard insurance": False, "preservation and maintenance of property": False, "protection of lender's interest": False, "uniform covenants": False,
        "acceleration": False, "remedies": False, "foreclosure": True, "this security instrument": True, "lien": False,
    },
    "HUD-1 Settlement Statement": {
        "hud-1": True, "hud 1": True, "settlement statement": True, "settlement charges": False, "gross amount due from borrower": False, "gross amount due to seller": False,
        "total settlement charges": False, "poc": False, "paid outside closing": True, "settlement agent": False, "place of settlement": False,
    },
}
