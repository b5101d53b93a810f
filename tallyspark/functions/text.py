"""Column functions that pull fields out of document text. All run on whole texts inside the JVM; the one
vectorised UDF (Unicode NFKC) receives only rows that hold non-ASCII characters."""

from __future__ import annotations

import re
import string
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.values import number_characters, plain_number

def one_of(near: str, far: str = "") -> str:
    """A character class that Java tests fast. Latin-1 characters named one by one share a table of bits, where ranges and
    properties are tried in turn; what `far` lists above them is behind a single test of its range."""
    return f"[{''.join(f'{chr(92)}x{ord(c):02x}' for c in near)}{far}]"


def wider(near: str) -> str:
    """The Latin-1 characters of `near` and every character above Latin-1: one table of bits, for cutting out stretches of a
    text in which an exact pattern is then searched."""
    return f"[^{one_of(''.join(c for c in map(chr, range(0x100)) if c not in near))[1:]}"


# Unicode-aware white space and word characters, spelled out so that no regex flag is needed.
NEAR_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
FAR_SPACES = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = one_of(NEAR_SPACES, rf"[\x{{1680}}-\x{{3000}}&&[{FAR_SPACES}]]")
WORD = one_of(string.digits + string.ascii_letters + "_", r"[\x{80}-\x{10ffff}&&[\p{L}\p{N}]]")
NOT_IN_WORD_AFTER = f"(?!{WORD})"


# Executors receive the UDF body itself and need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Array functions with a lambda interpret the lambda and their arguments. There rlike decodes its pattern for every value, and
# concat works out its type again; so a pattern is searched by regexp_instr, and parts are put together outside.


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _holds(text: Column, pattern: str) -> Column:
    """rlike, for use inside of array functions."""
    return F.regexp_instr(text, F.lit(pattern)) > 0


# --- cleaning ------------------------------------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normal form."""
    return texts.str.normalize("NFKC")


def normalized(text: Column) -> Column:
    needs_it = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(nfkc(needs_it), text)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def clean_text(text: Column) -> Column:
    """NFKC, one space for each run of white space, trimmed; null becomes ''."""
    return F.coalesce(collapse_space(normalized(text)), F.lit(""))


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR become LF, three or more LF become two."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n{3,}", "\n\n")


def clean_ocr_text(text: Column) -> Column:
    return clean_text(normalize_newlines(text))


# --- single fields -------------------------------------------------------------------------------------------------
def _first_group(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?iu)" + p, 1), F.lit("")) for p in patterns])


def invoice_number(text: Column, strict: bool = False) -> Column:
    """First capture over the ordered number patterns; strict also asks for a digit in the capture."""
    patterns = fv.INVOICE_NUMBER_PATTERNS
    if not strict:
        return _first_group(text, patterns)
    tries = [F.filter(_all(text, "(?iu)" + p, 1), lambda hit: hit.rlike("[0-9]")) for p in patterns]
    return F.coalesce(*[F.get(t, F.lit(0)) for t in tries])


# Pattern, and where year, month and day stand.
NUMERIC_DATES = [
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", (1, 6, 9)),
    (r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", (7, 4, 1)),
    (r"[0-9]{2}/[0-9]{2}/[0-9]{4}", (7, 4, 1)),
    (r"[0-9]{2}-[0-9]{2}-[0-9]{4}", (7, 4, 1)),
]
DAY_MONTH_YEAR = rf"([0-9]{{1,2}}){SPACE}+({WORD}+){SPACE}+([0-9]{{4}})"
MONTH_DAY_YEAR = rf"({WORD}+){SPACE}+([0-9]{{1,2}}),?{SPACE}+([0-9]{{4}})"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december"]


def _numeric_dates(text: Column, pattern: str, places: tuple[int, int, int]) -> Column:
    def parsed(hit: Column) -> Column:
        year, month, day = (F.substring(hit, place, 4 if i == 0 else 2) for i, place in enumerate(places))
        return F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")

    return F.transform(_all(text, pattern), parsed)


def _when_possible(text: Column, necessary: str, found: Column, kind: str) -> Column:
    """Runs a costly pattern only on texts that pass a cheap test every match must pass."""
    return F.when(_holds(text, necessary), found).otherwise(F.array().cast(kind))


# The same as MONTHS joined by bars; most letters are turned away at the first character.
ANY_MONTH = "(?=[adfjmnos])(?:j(?:anuary|une|uly)|ma(?:rch|y)|a(?:pril|ugust)|february|september|october|november|december)"

# What follows a month in both named forms, after the last letter of one.
AFTER_MONTH = f"[ehlrtyEHLRTY]{wider(NEAR_SPACES)}++[0-9]"


def _named_dates(text: Column, pattern: str, day: int, month: int) -> Column:
    month_number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")])

    def parsed(hit: Column) -> Column:
        number = F.try_element_at(month_number, F.lower(F.regexp_extract(hit, pattern, month)))
        dash = F.lit("-")
        iso = F.concat(F.regexp_extract(hit, pattern, 3), dash, number, dash, F.regexp_extract(hit, pattern, day))
        return iso.try_cast("date")

    named = pattern.replace(f"({WORD}+)", ANY_MONTH)
    found = _when_possible(text, f"(?i){named}", _all(text, pattern), "array<string>")
    hits = _when_possible(text, AFTER_MONTH, found, "array<string>")
    return F.transform(F.filter(hits, lambda hit: _holds(F.lower(hit), ANY_MONTH)), parsed)


def digit_groups(text: Column) -> Column:
    """Runs of ten or more digits and date separators, joined by blanks; every numeric date lies inside one."""
    return F.array_join(_all(text, one_of(string.digits + "./-") + "{10,}+"), " ")


def dates(text: Column, groups: Column | None = None) -> Column:
    """All valid dates in the six printed forms, distinct and ascending, as 'yyyy-MM-dd' strings. `groups`, a column of the
    text's digit_groups, spares the numeric forms the whole text."""
    found = [_numeric_dates(text if groups is None else groups, pattern, places) for pattern, places in NUMERIC_DATES]
    found += [_named_dates(text, DAY_MONTH_YEAR, 1, 2), _named_dates(text, MONTH_DAY_YEAR, 2, 1)]
    valid = [F.filter(some, lambda d: d.isNotNull() & (d >= F.lit("0001-01-01").cast("date"))) for some in found]
    # Years have four digits, so the texts lie in the order of the dates.
    return F.sort_array(F.array_distinct(F.concat(*[F.transform(some, lambda d: d.cast("string")) for some in valid])))


# Runs of digits and separators are matched possessively and only from their start, so no run is scanned twice.
SYMBOLS = "[" + "".join(fv.CURRENCY_SYMBOLS) + "]"
RUN = one_of(string.digits + ".," + NEAR_SPACES, rf"[\x{{1680}}-\x{{3000}}&&[{FAR_SPACES}]]")
RUN_START = f"(?<!{RUN})"
SYMBOL_FIRST = f"{SYMBOLS}{RUN}+"
SYMBOL_LAST = f"{RUN_START}{RUN}++{SYMBOLS}"
CODE_LAST = f"{RUN_START}{RUN}++(?:{'|'.join(fv.AMOUNT_CODES)})"
BARE_AMOUNT = r"[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2}"


# The longest stretches of digits, separators and symbols (or any others above Latin-1) that hold a digit, with the code after.
NEAR_SYMBOLS = "".join(c for c in fv.CURRENCY_SYMBOLS if c <= "\xff")
NO_DIGIT = wider(".," + NEAR_SPACES + NEAR_SYMBOLS)
CHAIN = wider(string.digits + ".," + NEAR_SPACES + NEAR_SYMBOLS)
NUMBER_CHAIN = f"(?={CHAIN})(?<!{CHAIN}){NO_DIGIT}*+[0-9]{CHAIN}*+(?:{'|'.join(fv.AMOUNT_CODES)})?"


def number_chains(text: Column) -> Column:
    """Every stretch of a text in which an amount can stand, joined by bars. No amount reaches over the end of a stretch, so
    the four shapes need not scan the whole text."""
    return F.array_join(_all(text, NUMBER_CHAIN), "|")


def amount_candidates(text: Column) -> Column:
    """Every positive printed amount: symbol before, symbol after, code after, then bare numbers (EUR). Takes a text or,
    cheaper and with the same result, a column of its number_chains.

    Sorted array of struct<neg, currency, i, raw>: largest amount first, equal ones in the order they were found.
    """
    symbol_code = F.create_map(*[F.lit(x) for kv in fv.CURRENCY_SYMBOLS.items() for x in kv])

    def entry(raw: Column, currency: Column) -> Column:
        return F.struct(number_characters(raw).alias("kept"), currency.alias("currency"), raw.alias("raw"))

    symbol_last = _when_possible(text, SYMBOLS, _all(text, SYMBOL_LAST), "array<string>")
    code_last = _when_possible(text, "(?:" + "|".join(fv.AMOUNT_CODES) + ")", _all(text, CODE_LAST), "array<string>")
    found = F.concat(
        F.transform(_all(text, SYMBOL_FIRST), lambda r: entry(r, symbol_code[F.left(r, F.lit(1))])),
        F.transform(symbol_last, lambda r: entry(r, symbol_code[F.right(r, F.lit(1))])),
        F.transform(code_last, lambda r: entry(r, F.right(r, F.lit(3)))),
        F.transform(_all(text, BARE_AMOUNT), lambda r: entry(r, F.lit("EUR"))),
    )
    # Array functions are interpreted and share nothing: the characters are kept once per hit, then the number is read.
    valued = F.transform(
        found,
        lambda e: F.struct(plain_number(e["kept"]).try_cast("decimal(38,6)").alias("amount"), e["currency"], e["raw"]),
    )
    return F.sort_array(
        F.transform(
            F.filter(valued, lambda e: e["amount"] > 0),
            lambda e, i: F.struct(
                (-e["amount"]).alias("neg"), e["currency"].alias("currency"), i.alias("i"), e["raw"].alias("raw")
            ),
        )
    )


def distinct_amounts(candidates: Column) -> Column:
    """One entry per (amount, currency), the first found. Pass a plain column: the lambda looks back into it."""
    kept = F.filter(
        candidates,
        lambda e, i: (i == 0)
        | (F.get(candidates, i - 1)["neg"] != e["neg"])
        | (F.get(candidates, i - 1)["currency"] != e["currency"]),
    )
    return F.transform(
        F.array_sort(F.transform(kept, lambda e: F.struct(e["neg"], e["i"], e["currency"], e["raw"]))),
        lambda e: F.struct((-e["neg"]).alias("amount"), e["currency"].alias("currency"), e["raw"].alias("raw_text")),
    )


LONG_RUN = one_of(string.digits + string.ascii_letters) + "{10,}+"


def long_runs(text: Column) -> Column:
    """Runs of ten or more ASCII letters and digits that hold seven digits in a row, joined by blanks. Every VAT id
    lies inside one such run, so the thirteen shapes need not scan the whole text."""
    runs = F.filter(_all(text, LONG_RUN), lambda run: run.rlike("[0-9]{7}"))
    return F.when(text.rlike("[0-9]{7}"), F.array_join(runs, " ")).when(text.isNotNull(), "")


def vat_ids(runs: Column) -> Column:
    """VAT ids in country order, upper-cased, repeats kept: array of struct<vat_id, country>. Takes a text or, cheaper
    and with the same result, a column of its long_runs."""

    def of(country: str, shape: str) -> Column:
        hits = _all(runs, "(?i)" + shape)
        return F.transform(hits, lambda h: F.struct(F.upper(h).alias("vat_id"), F.lit(country).alias("country")))

    found = F.concat(*[of(country, shape) for country, shape in fv.VAT_ID_SHAPES.items()])
    return F.when(runs == "", F.array().cast("array<struct<vat_id:string,country:string>>")).otherwise(found)


ANY_FORM = f"(?=[{''.join(sorted({form[0] for form in fv.LEGAL_FORMS}))}])(?:{'|'.join(fv.LEGAL_FORMS)}){NOT_IN_WORD_AFTER}"
BEYOND_ASCII = "".join(map(chr, range(0xC0, 0x100)))  # À to ÿ
NAME_CHAR = one_of(string.ascii_letters + BEYOND_ASCII + "&-." + NEAR_SPACES, rf"[\x{{1680}}-\x{{3000}}&&[{FAR_SPACES}]]")
COMPANY = rf"[A-ZÀ-ÿ]{NAME_CHAR}+{SPACE}(?:{'|'.join(fv.LEGAL_FORMS)})\.?" + NOT_IN_WORD_AFTER
# A run of name characters (or any others above Latin-1), which may hold A/S, with the character after it; and its part up to the last legal form.
NAME_CHARS = wider(string.ascii_letters + BEYOND_ASCII + "&-." + NEAR_SPACES)
NAME_RUN = rf"{NAME_CHARS}++(?:(?<=A)/S{NAME_CHARS}*+)*+(?s:.)?"
NAMED_PART = rf"(?s)^.*{SPACE}(?:{'|'.join(fv.LEGAL_FORMS)})\.?" + NOT_IN_WORD_AFTER


def companies(text: Column) -> Column:
    """Names that end in a legal form, cleaned, longer than three characters, distinct, in text order. A name may be of any
    length: the text is cut into runs of name characters, and only runs with a legal form are searched, up to the last."""
    runs = F.filter(_all(text, NAME_RUN), lambda run: _holds(run, ANY_FORM))
    found = F.flatten(F.transform(runs, lambda run: _all(F.regexp_extract(run, NAMED_PART, 0), COMPANY)))
    hits = _when_possible(text, ANY_FORM, found, "array<string>")
    names = F.transform(hits, collapse_space)
    return F.array_distinct(F.filter(names, lambda n: F.length(n) > 3))


# Word boundary over Unicode letters and digits, the same on every Java version.
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def _in_words(pattern: str) -> str:
    """Replaces the word boundaries of a pattern. Where the first character is a digit or a capital, the boundary before it
    means that no word character precedes; the character is looked at first because that is the cheaper test. Where the last
    one is such, the boundary means that no word character follows."""
    for first in (r"\d", "[A-Z]"):
        if pattern.startswith(rf"\b{first}"):
            pattern = rf"(?={first})(?<!{WORD})" + pattern[2:]
    if re.search(r"(?:\\d|\[A-Z\])(?:\{[0-9,]+\}|\+)?\\b$", pattern):
        pattern = pattern[:-2] + NOT_IN_WORD_AFTER
    return pattern.replace(r"\b", BOUNDARY)


POSTAL = "|".join(f"(?:{_in_words(p)})" for p in fv.POSTAL_PATTERNS)


# A line that holds a digit, as every postal code does. It is looked for from the start of a line only.
DIGIT_LINE = f"(?md)^[^\\n{string.digits}]*+[0-9][^\\n]*+"


def address_lines(text: Column) -> Column:
    """Lines longer than ten characters that hold a postal code, cleaned, distinct and sorted."""
    lines = F.transform(_all(text, DIGIT_LINE), lambda line: F.trim(line))
    holding = F.filter(lines, lambda line: (F.length(line) > 10) & _holds(line, POSTAL))
    return F.array_sort(F.array_distinct(F.transform(holding, collapse_space)))


def emails(text: Column) -> Column:
    """Mail addresses, distinct and sorted. None reaches over white space, and white space is no word character, so they are
    searched in the blank-separated parts of the text that hold an @."""
    parts = F.array_join(_all(text, MAIL_PART), " ")
    found = F.when(text.contains("@"), _all(parts, EMAIL)).otherwise(F.array().cast("array<string>"))
    return F.sort_array(F.array_distinct(found))


EMAIL = _in_words(fv.EMAIL_PATTERN)
BLANKS = r"\t\n\x0b\f\r "
MAIL_PART = f"(?<![^{BLANKS}])[^{BLANKS}@]*+@[^{BLANKS}]*+"


def phones(text: Column) -> Column:
    """Printed phone numbers of at least seven characters out of [0-9+], distinct and sorted."""
    hits = [_all(text, _in_words(p)) for p in fv.PHONE_PATTERNS]
    long_enough = [F.filter(some, lambda h: F.length(F.regexp_replace(h, "[^0-9+]", "")) >= 7) for some in hits]
    return F.sort_array(F.array_distinct(F.concat(*[F.transform(some, lambda h: F.trim(h)) for some in long_enough])))


# --- language ------------------------------------------------------------------------------------------------------
def language_scores(lowered: Column, words: dict[str, list[str]]) -> list[tuple[str, Column]]:
    """Number of keywords of each language that occur anywhere in the lower-cased text."""
    return [(lang, sum((lowered.contains(w).cast("int") for w in ws), F.lit(0))) for lang, ws in words.items()]


def earliest_label(scores: list[tuple[str, Column]]) -> Column:
    """struct<score, rank, label> of the highest score; the earlier label wins a tie."""
    return F.greatest(
        *[
            F.struct(score.alias("score"), F.lit(-rank).alias("rank"), F.lit(label).alias("label"))
            for rank, (label, score) in enumerate(scores)
        ]
    )


def vote(scores: list[tuple[str, Column]], least: int) -> Column:
    """Winning label when it has at least `least` points, else 'en'."""
    floor = ("en", F.lit(least - 1))  # wins over every label with fewer points, and ties go to it
    return earliest_label([floor, *scores])["label"]


def document_language(lowered: Column) -> Column:
    """Language of a lower-cased text; null counts as an empty text."""
    return vote(language_scores(F.coalesce(lowered, F.lit("")), fv.DOCUMENT_LANGUAGE_WORDS), 2)


# --- whole-text comparison -----------------------------------------------------------------------------------------
def word_set(text: Column) -> Column:
    return F.array_distinct(_all(F.lower(text), WORD + "+"))


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all distinct words; 0 when a side is empty."""
    both = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - both
    return F.when((F.size(left) > 0) & (F.size(right) > 0), both / union).otherwise(F.lit(0.0))


# --- small header extraction ---------------------------------------------------------------------------------------
FALLBACK_NUMBER = [
    r"(?iu)invoice\s*(?:no\.?|number)?[\s#:]*([A-Z0-9-]+)",
    r"(?iu)rechnung\s*(?:nr\.?)?[\s#:]*([A-Z0-9-]+)",
    r"(?iu)arve\s*(?:nr\.?)?[\s#:]*([A-Z0-9-]+)",
]
FALLBACK_DATE = r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"
FALLBACK_TOTAL = [
    r"(?iu)\btotal\s*:?\s*[€$£]?\s*([0-9]+[.,][0-9]{2})",
    r"(?iu)\bgesamt\s*:?\s*[€$£]?\s*([0-9]+[.,][0-9]{2})",
    r"(?iu)\bkokku\s*:?\s*[€$£]?\s*([0-9]+[.,][0-9]{2})",
]


def fallback_number(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in FALLBACK_NUMBER])


def fallback_date(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, FALLBACK_DATE, 0), F.lit(""))


def fallback_total(text: Column) -> Column:
    hit = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in FALLBACK_TOTAL])
    return F.replace(hit, F.lit(","), F.lit(".")).try_cast("decimal(18,2)")


def document_currency(text: Column) -> Column:
    """Currency of the first listed symbol that the text holds; EUR when there is none."""
    choice = None
    for symbol, code in fv.CURRENCY_SYMBOLS.items():
        hit = text.contains(symbol)
        choice = F.when(hit, code) if choice is None else choice.when(hit, code)
    return choice.otherwise(F.lit("EUR"))
