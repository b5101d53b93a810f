"""Word lists, patterns, code lists and thresholds that decide the results."""

# --- money -------------------------------------------------------------------------------------------------------
CURRENCY_SYMBOLS = {
    "€": "EUR",
    "$": "USD",
    "£": "GBP",
    "¥": "JPY",
    "₹": "INR",
    "₽": "RUB",
    "₩": "KRW",
    "₴": "UAH",
}
AMOUNT_CODES = ["EUR", "USD", "GBP", "JPY", "PLN", "SEK", "DKK", "NOK"]

# --- identifiers -------------------------------------------------------------------------------------------------
VAT_ID_SHAPES = {
    "DE": "DE[0-9]{9}",
    "EE": "EE[0-9]{9}",
    "GB": "GB[0-9]{9}",
    "FR": "FR[0-9A-Z]{2}[0-9]{9}",
    "IT": "IT[0-9]{11}",
    "ES": "ES[0-9A-Z][0-9]{7}[0-9A-Z]",
    "NL": "NL[0-9]{9}B[0-9]{2}",
    "AT": "ATU[0-9]{8}",
    "BE": "BE[0-9]{10}",
    "PL": "PL[0-9]{10}",
    "FI": "FI[0-9]{8}",
    "SE": "SE[0-9]{12}",
    "DK": "DK[0-9]{8}",
}
COUNTRY_CURRENCY = {
    "DE": "EUR",
    "EE": "EUR",
    "FR": "EUR",
    "IT": "EUR",
    "ES": "EUR",
    "NL": "EUR",
    "AT": "EUR",
    "BE": "EUR",
    "FI": "EUR",
    "GB": "GBP",
    "PL": "PLN",
    "SE": "SEK",
    "DK": "DKK",
}

# --- invoice code lists and length limits ------------------------------------------------------------------------
INVOICE_CURRENCIES = ["EUR", "USD", "GBP", "PLN", "SEK", "DKK"]
INVOICE_TYPES = ["380", "381", "383", "384"]
VAT_CATEGORIES = ["S", "Z", "E", "AE", "O"]
MAX_LENGTHS = {
    "invoice_id": 50,
    "purchase_order_reference": 50,
    "contract_reference": 50,
    "party.name": 200,
    "party.address_line": 300,
    "party.city": 100,
    "party.postal_code": 20,
    "line.description": 500,
    "line.unit_code": 10,
    "payment_terms": 500,
}

# --- completeness weights ----------------------------------------------------------------------------------------
REQUIRED_FIELDS = [
    "invoice_id",
    "issue_date",
    "supplier.name",
    "customer.name",
    "total_incl_vat",
    "currency_code",
    "supplier.country_code",
    "customer.country_code",
]
IMPORTANT_FIELDS = [
    "supplier.vat_id",
    "customer.vat_id",
    "supplier.address_line",
    "customer.address_line",
    "invoice_lines",
    "total_excl_vat",
    "total_vat",
    "payable_amount",
]
OPTIONAL_FIELDS = [
    "supplier.city",
    "supplier.postal_code",
    "customer.city",
    "customer.postal_code",
    "purchase_order_reference",
    "contract_reference",
]

# --- text patterns, in trial order -------------------------------------------------------------------------------
INVOICE_NUMBER_PATTERNS = [
    r"(?:Invoice|Rechnung|Arve|Factura|Fattura)[\s#:]*([A-Z0-9\-/\.]+)",
    r"(?:No|Nr|Number|Numero)[\s.:]*([A-Z0-9\-/\.]+)",
    r"([A-Z]{1,4}\-\d{4,})",
    r"(\d{4,})",
    r"([A-Z]{1,4}\d{4,})",
    r"(\d{4}/\d{4})",
    r"([A-Z]{1,4}/\d{4,})",
]
LEGAL_FORMS = [
    "GmbH", "AG", "Ltd", "Limited", "Inc", "Corp", "Corporation", "OÜ", "AS", "OY", "AB", "ApS",
    "A/S", "SA", "SL", "SRL", "LLC", "LLP", "LP", "PLC", "BV", "NV",
]
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERNS = [
    r"\+\d{1,3}[-.\s]?\d{1,14}",
    r"\b\d{2,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b",
    r"\(\d{2,4}\)\s?\d{3,8}",
]
POSTAL_PATTERNS = [
    r"\b\d{5}\b",
    r"\b\d{5}\s+[A-Z]+\b",
    r"\b[A-Z]{1,2}\d{1,2}[A-Z]?\s+\d[A-Z]{2}\b",
    r"\b\d{2}-\d{3}\b",
    r"\b\d{3}\s?\d{2}\b",
]
TOKEN_AMOUNT_PATTERNS = [
    r"[€$£]\s*\d+[.,]\d{2}",
    r"\d+[.,]\d{2}\s*[€$£]",
    r"\d{1,3}(?:[.,]\d{3})*[.,]\d{2}",
]

# --- language vote: language -> keywords; earlier languages win ties ----------------------------------------------
DOCUMENT_LANGUAGE_WORDS = {
    "de": ["rechnung", "datum", "betrag", "mwst", "ust", "gesamt", "summe", "netto", "brutto", "lieferant", "kunde",
           "steuernummer", "ustidnr", "rechnungsnummer", "zahlbar", "fällig"],
    "et": ["arve", "kuupäev", "summa", "käibemaks", "kokku", "maksukohustuslane", "reg", "müüja", "ostja",
           "maksetähtaeg", "number"],
    "en": ["invoice", "date", "amount", "vat", "total", "subtotal", "tax", "supplier", "customer", "due", "payment",
           "number", "net", "gross"],
    "fr": ["facture", "date", "montant", "tva", "total", "fournisseur", "client", "échéance", "paiement", "numéro",
           "net", "brut"],
    "es": ["factura", "fecha", "importe", "iva", "total", "proveedor", "cliente", "vencimiento", "pago", "número",
           "neto", "bruto"],
    "it": ["fattura", "data", "importo", "iva", "totale", "fornitore", "cliente", "scadenza", "pagamento", "numero",
           "netto", "lordo"],
    "nl": ["factuur", "datum", "bedrag", "btw", "totaal", "leverancier", "klant", "vervaldatum", "betaling", "nummer",
           "netto", "bruto"],
}
PAGE_LANGUAGE_WORDS = {
    "de": ["rechnung", "datum", "betrag", "mwst", "ust", "gesamt", "summe", "netto", "brutto"],
    "et": ["arve", "kuupäev", "summa", "käibemaks", "kokku", "maksukohustuslane"],
    "en": ["invoice", "date", "amount", "vat", "total", "subtotal", "tax"],
}

# --- line-item tables --------------------------------------------------------------------------------------------
LINE_TABLE_WORDS = [
    "description", "quantity", "price", "amount", "total",
    "beschreibung", "menge", "preis", "betrag", "summe",
    "kirjeldus", "kogus", "hind", "summa",
]
COLUMN_ROLE_WORDS = {
    "description": ["description", "item", "product", "beschreibung", "artikel", "produkt", "kirjeldus", "toode"],
    "quantity": ["quantity", "qty", "menge", "anzahl", "kogus"],
    "unit_price": ["unit price", "price", "einzelpreis", "preis", "ühiku hind", "hind"],
    "line_total": ["total", "amount", "gesamt", "betrag", "summa", "kokku"],
    "vat_rate": ["vat", "tax", "mwst", "ust", "steuer", "käibemaks"],
}

# --- files and monitoring ----------------------------------------------------------------------------------------
UPLOAD_EXTENSIONS = [".pdf", ".jpg", ".jpeg", ".png", ".tiff", ".bmp"]
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
ALERT_THRESHOLDS = {
    "cpu_usage": 90.0,
    "memory_usage": 90.0,
    "disk_usage": 90.0,
    "gpu_memory_usage": 90.0,
    "error_rate": 0.1,
}
ALERT_COOLDOWN_SECONDS = 300
LOG_KEEP = 1000
SAMPLES_KEEP = 100
