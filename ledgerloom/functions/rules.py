"""Patterns, word lists and catalogs whose exact content decides results. Plain text, in natural order."""

from __future__ import annotations

# --- quality rules (fixed values) -----------------------------------------------------------------------------------
MIN_CHUNK_LENGTH = 50
MIN_LETTER_RATIO = 0.3
MAX_SYMBOL_RATIO = 0.35
MAX_HEADER_LABELS = 2
MAX_URLS = 3
LONG_XBRL_LINE = 200

#: Whitespace as Unicode has it, for engines whose \s is ASCII only.
SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

FINANCIAL = (
    r"\$[\p{Nd},]+",
    r"\p{Nd}+%",
    r"\p{Nd}{4}.*\p{Nd}{4}.*\p{Nd}{4}",
    r"(?i)(million|billion|thousand)",
    r"(?i)(revenue|sales|income|profit|loss|margin)",
)
GIBBERISH = (
    r'"?[A-Z0-9]{3,}@',
    r"\*{4,}",
    r"_{4,}",
    r"HHHH",
    r"ZZZZ",
    r"\b[A-Z]{3,}\b [A-Z]{3,}\b [A-Z]{3,}",
    r"X{3,}",
)
HEADER_LABELS = (
    r"ACCESSION NUMBER:\s*\d+",
    r"CONFORMED SUBMISSION TYPE:\s*[\w-]+",
    r"PUBLIC DOCUMENT COUNT:\s*\d+",
    r"CONFORMED PERIOD OF REPORT:\s*\d+",
    r"FILED AS OF DATE:\s*\d+",
    r"DATE AS OF CHANGE:\s*\d+",
    r"COMPANY CONFORMED NAME:.*",
    r"CENTRAL INDEX KEY:\s*\d+",
    r"STANDARD INDUSTRIAL CLASSIFICATION:.*",
    r"IRS NUMBER:\s*[\d-]+",
    r"STATE OF INCORPORATION:\s*[A-Z]{2}",
    r"FISCAL YEAR END:\s*\d{4}",
    r"FORM TYPE:\s*[\w-]+",
    r"SEC ACT:\s*[\d\w\s]+",
    r"SEC FILE NUMBER:\s*[\d-]+",
    r"FILM NUMBER:\s*\d+",
    r"BUSINESS ADDRESS:.*",
    r"MAIL ADDRESS:.*",
    r"FORMER COMPANY:.*",
    r"FORMER CONFORMED NAME:.*",
    r"DATE OF NAME CHANGE:\s*\d+",
)
XBRL_URL = r"(?i)us-gaap:|xbrl:|http://fasb\.org"
XBRL_SPANS = (
    r"<link:.*?>",
    r"<xbrl:.*?>",
    r"<xbrli:.*?>",
    r"<link:calculationLink.*?</link:calculationLink>",
    r"<link:presentationLink.*?</link:presentationLink>",
    r"<link:definitionLink.*?</link:definitionLink>",
    r"<link:labelLink.*?</link:labelLink>",
    r"<link:referenceLink.*?</link:referenceLink>",
    r"<link:roleRef.*?/>",
    r"<link:arcroleRef.*?/>",
    r"<link:loc.*?/>",
    r"<link:calculationArc.*?/>",
    r"<link:presentationArc.*?/>",
    r"<link:definitionArc.*?/>",
    r"<link:labelArc.*?/>",
    r"<link:referenceArc.*?/>",
)
BOILERPLATE = (
    r"\(Mark One\)",
    r"Indicate by check mark.*?\.",
    r"See the definitions of.*?in Rule.*?of the Exchange Act\.",
    r"Commission File Number:\s*[\d-]+",
    r"DOCUMENTS INCORPORATED BY REFERENCE",
    r"TABLE OF CONTENTS",
    r"Page\s+\d+",
    r"Part [IVX]+",
    r"Item \d+[A-Z]?\.",
    r"This Annual Report on Form.*?contains forward-looking statements",
    r"Forward-looking statements provide current expectations",
    r"Unless otherwise stated, all information presented herein",
    r"The information contained on the websites.*?is not incorporated by reference",
)
CONTENT_STARTS = ("PART I", "ITEM 1.", "BUSINESS", "COMPANY BACKGROUND", "THE COMPANY", "MANAGEMENT'S DISCUSSION")
CONTENT_ENDS = ("SIGNATURES", "EXHIBIT", "CERTIFICATION", "PART IV", "ITEM 15.")

# --- chunking and retrieval defaults (fixed values) -----------------------------------------------------------------
CHUNK_TOKENS, CHUNK_OVERLAP, MAX_CHUNK_BYTES = 400, 0.3, 16_384
SENTENCE_TOKEN_CAP = 1024
TOP_K, RERANK_CUT, CONTEXT_CHARS = 20, 18, 50_000
IVF_FROM, IVF_MAX_CELLS, IVF_PROBES = 10_000, 256, 10

# --- filing forms (fixed values) ------------------------------------------------------------------------------------
REPORT_FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A")
S1_FORMS = ("S-1", "S-1/A")
VALID_FORMS = ("10-K", "10-Q", "S-1", "10-K/A", "10-Q/A", "S-1/A")
ITEM_LABEL = r"(?i)item\s+(1a|1b|7a|7|8|9|15)"
ITEM_TITLE = r"(?i)item \d{1,3}(?:[a-z]|\([a-z]\))?\.?:?"

#: Section name, clean title, pattern searched in the cleaned lower-case title.
SECTIONS = (
    ("PROSPECTUS_SUMMARY", "Prospectus Summary", r"^(?:prospectus )?summary$"),
    ("ABOUT_PROSPECTUS", "About Prospectus", r"about this prospectus"),
    ("FORWARD_LOOKING_STATEMENTS", "Forward Looking Statements", r"forward[ -]looking statements"),
    ("RISK_FACTORS", "Risk Factors", r"risk factors"),
    ("USE_OF_PROCEEDS", "Use Of Proceeds", r"use of proceeds"),
    ("DIVIDEND_POLICY", "Dividend Policy", r"^dividend policy"),
    ("CAPITALIZATION", "Capitalization", r"^capitalization$"),
    ("DILUTION", "Dilution", r"^dilution$"),
    ("MANAGEMENT_DISCUSSION", "Management Discussion", r"^management(?:[’']s)? discussion"),
    ("BUSINESS", "Business", r"^business$"),
    ("MANAGEMENT", "Management", r"^(?:(?:our )?management)|(?:executive officers)$"),
    ("COMPENSATION", "Compensation", r"compensation"),
    ("RELATED_PARTY_TRANSACTIONS", "Related Party Transactions", r"(?:relationships|related).*transactions"),
    ("PRINCIPAL_STOCKHOLDERS", "Principal Stockholders", r"(?:principal.*(?:stockholder|shareholder)s?)|(?:(security|stock|share) ownership .*certain)"),
    ("DESCRIPTION_OF_STOCK", "Description Of Stock", r"^description of (?:capital stock|share capital|securities)"),
    ("DESCRIPTION_OF_DEBT", "Description Of Debt", r"^description of .*debt"),
    ("FUTURE_SALE", "Future Sale", r"(?:shares|stock) eligible for future sale"),
    ("US_TAX", "Us Tax", r"(?:us|u\.s\.|united states|material federal).* tax (?:consideration|consequence)"),
    ("UNDERWRITING", "Underwriting", r"underwrit"),
    ("LEGAL_MATTERS", "Legal Matters", r"legal matters"),
    ("EXPERTS", "Experts", r"^experts$"),
    ("MORE_INFORMATION", "More Information", r"(?:additional|more) information"),
    ("FINANCIAL_STATEMENTS", "Financial Statements", r"financial statements"),
    ("MARKET_RISK_DISCLOSURES", "Market Risk Disclosures", r"(?:quantitative|qualitative) disclosures? about market risk"),
    ("CONTROLS_AND_PROCEDURES", "Controls And Procedures", r"controls and procedures"),
    ("LEGAL_PROCEEDINGS", "Legal Proceedings", r"legal proceedings"),
    ("DEFAULTS", "Defaults", r"defaults (?:up)?on .*securities"),
    ("MINE_SAFETY", "Mine Safety", r"mine safety disclosures?"),
    ("OTHER_INFORMATION", "Other Information", r"other information"),
    ("UNRESOLVED_STAFF_COMMENTS", "Unresolved Staff Comments", r"unresolved staff comments"),
    ("PROPERTIES", "Properties", r"^properties$"),
    ("MARKET_FOR_REGISTRANT_COMMON_EQUITY", "Market For Registrant Common Equity", r"market for(?: the)? (?:registrant|company)(?:['’]s)? common equity"),
    ("ACCOUNTING_DISAGREEMENTS", "Accounting Disagreements", r"disagreements with accountants"),
    ("FOREIGN_JURISDICTIONS", "Foreign Jurisdictions", r"dis?closure .*foreign jurisdictions .*inspection"),
    ("EXECUTIVE_OFFICERS", "Executive Officers", r"executive officers"),
    ("ACCOUNTING_FEES", "Accounting Fees", r"accounting fees"),
    ("EXHIBITS", "Exhibits", r"^exhibits?(.*financial statement schedules)?$"),
    ("FORM_SUMMARY", "Form Summary", r"^form .*summary$"),
    ("CERTAIN_TRADEMARKS", "Certain Trademarks", r"certain trademarks"),
    ("OFFER_PRICE", "Offer Price", r"(?:determination of )offering price"),
)
SECTIONS_10K = (
    "BUSINESS", "RISK_FACTORS", "UNRESOLVED_STAFF_COMMENTS", "PROPERTIES", "LEGAL_PROCEEDINGS", "MINE_SAFETY",
    "MARKET_FOR_REGISTRANT_COMMON_EQUITY", "MANAGEMENT_DISCUSSION", "MARKET_RISK_DISCLOSURES", "FINANCIAL_STATEMENTS",
    "ACCOUNTING_DISAGREEMENTS", "CONTROLS_AND_PROCEDURES", "FOREIGN_JURISDICTIONS", "MANAGEMENT", "COMPENSATION",
    "PRINCIPAL_STOCKHOLDERS", "RELATED_PARTY_TRANSACTIONS", "ACCOUNTING_FEES", "EXHIBITS", "FORM_SUMMARY",
)
SECTIONS_10Q = (
    "FINANCIAL_STATEMENTS", "MANAGEMENT_DISCUSSION", "MARKET_RISK_DISCLOSURES", "CONTROLS_AND_PROCEDURES", "LEGAL_PROCEEDINGS",
    "RISK_FACTORS", "USE_OF_PROCEEDS", "DEFAULTS", "MINE_SAFETY", "OTHER_INFORMATION",
)
SECTIONS_S1 = (
    "PROSPECTUS_SUMMARY", "ABOUT_PROSPECTUS", "FORWARD_LOOKING_STATEMENTS", "RISK_FACTORS", "USE_OF_PROCEEDS", "DIVIDEND_POLICY",
    "CAPITALIZATION", "DILUTION", "MANAGEMENT_DISCUSSION", "BUSINESS", "MANAGEMENT", "COMPENSATION", "RELATED_PARTY_TRANSACTIONS",
    "PRINCIPAL_STOCKHOLDERS", "DESCRIPTION_OF_STOCK", "DESCRIPTION_OF_DEBT", "FUTURE_SALE", "US_TAX", "UNDERWRITING",
    "LEGAL_MATTERS", "EXPERTS", "MORE_INFORMATION",
)

# --- questions (fixed values) ---------------------------------------------------------------------------------------
COMPANIES = (
    ("apple", "AAPL"), ("microsoft", "MSFT"), ("google", "GOOGL"), ("alphabet", "GOOGL"), ("amazon", "AMZN"), ("meta", "META"),
    ("facebook", "META"), ("tesla", "TSLA"), ("nvidia", "NVDA"), ("netflix", "NFLX"), ("jpmorgan", "JPM"), ("jpm", "JPM"),
    ("bank of america", "BAC"), ("goldman sachs", "GS"), ("visa", "V"), ("mastercard", "MA"), ("coca cola", "KO"), ("pepsi", "PEP"),
    ("walmart", "WMT"), ("disney", "DIS"), ("intel", "INTC"), ("amd", "AMD"), ("ibm", "IBM"), ("oracle", "ORCL"),
    ("salesforce", "CRM"), ("adobe", "ADBE"), ("paypal", "PYPL"), ("uber", "UBER"), ("airbnb", "ABNB"),
)
YEAR_IN_QUESTION = r"\b(19\d{2}|20\d{2})\b"
FORM_IN_QUESTION = r"(?i)\b(10-K|10-Q|8-K|10-KT)\b"

# --- answers (fixed values) -----------------------------------------------------------------------------------------
CITATION_PHRASES = (
    r"(?i)\[Source[:\s]+\d+\]",
    r"(?i)\(Source[:\s]+\d+\)",
    r"(?i)according to",
    r"(?i)per the",
    r"(?i)in the.*filing",
    r"(?i)from.*filing",
)
ALIGNMENT_WEIGHT, CITATION_WEIGHT, FACT_WEIGHT = 0.4, 0.3, 0.3
NO_SOURCES = "No sources retrieved"
EMPTY_ANSWER = "I couldn't find any relevant information in the SEC filings to answer your question."
MIME_TYPES = ((".png", "image/png"), (".jpg", "image/jpeg"), (".jpeg", "image/jpeg"), (".gif", "image/gif"), (".webp", "image/webp"))
TEXT_TYPES = ("Text", "Section header", "Title", "List")
