"""Text functions as Column expressions: cleaning, extraction, formatting."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlake.functions import fixed_values as v
from spendlake.functions.rules import any_contains, behind_first_letters, case_of, first_group, first_regex

CONTROL = r"[\x00-\x1f\x7f-\x9f]"


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


# --- amounts, dates, descriptions -------------------------------------------------


def clean_amount(c: Column) -> Column:
    """Signed number in an amount text, null when there is none.

    Parentheses, a leading minus and DR or DEBIT mean negative. "Rs." is taken
    out whole so that its dot is not read as a decimal point; of several dots
    the first one counts. A text of digits, commas and one dot needs no cleaning.
    """
    plain = F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    negative = c.rlike(r"(?is)^\s*(?:-|\(.*\)\s*$)|dr|debit")
    digits = F.regexp_replace(c, r"(?i)\brs\.?\s*|[^0-9.\-]|^\s*-", "")
    number = F.regexp_replace(digits, r"(?<=\.[0-9\-]{0,60})\.", "").try_cast("double")
    return F.when(c.rlike(r"^[0-9,]+(?:\.[0-9]*)?$"), plain).when(negative, -F.abs(number)).otherwise(number)


def clean_date(c: Column, as_of: dt.date, preferred: str | None = None) -> Column:
    """First layout that gives a day from 1990 up to the day after ``as_of``."""
    s = F.trim(c)
    named = F.initcap(F.regexp_replace(s, r"[-\s]+", " "))
    tried = [F.when(s.rlike(g), F.try_to_date(named if "MMM" in f else s, f)) for g, f in v.DATE_LAYOUTS]
    if preferred:
        tried.insert(0, F.try_to_date(s, preferred))
    # Only d/M/yyyy has a second reading, used when the first is out of range.
    month_first = F.when(s.rlike(v.MONTH_FIRST[0]), F.try_to_date(s, v.MONTH_FIRST[1]))
    low, high = F.lit(dt.date(1990, 1, 1)), F.lit(as_of + dt.timedelta(days=1))

    def in_range(day: Column) -> Column:
        # Two-digit years above 68 belong to the last century. Each step names the day once.
        century = F.transform(F.array(day), lambda d: F.when((F.year(d) > 2068) & s.rlike(r"\D\d{2}$"), F.add_months(d, -1200)).otherwise(d))
        return F.try_element_at(F.filter(century, lambda d: (d >= low) & (d <= high)), F.lit(1))

    # A failed reading costs far more than a good one: the second is tried only when it is needed.
    return F.coalesce(in_range(F.coalesce(*tried)), in_range(month_first))


def parsed_date(c: Column) -> Column:
    """Date of a parsed row: ISO, or one of four other layouts."""
    return F.coalesce(*[F.try_to_date(c, layout) for layout in v.PARSED_DATE_LAYOUTS])


def clean_description(c: Column) -> Column:
    s = F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), CONTROL, "")
    s = F.translate(s, "–—‘’“” ", "--''\"\" ")
    upi = r"(?i)^UPI[-/](\d+)[-/]([^@/]+)[@/]?"
    merchant = F.trim(F.regexp_extract(s, upi, 2))
    return F.trim(F.when(s.rlike(upi), F.concat(F.lit("UPI - "), merchant, F.lit(" ("), s, F.lit(")"))).otherwise(s))


def extract_reference(c: Column) -> Column:
    return first_group(c, v.REFERENCE_PATTERNS)


def transaction_type(
    description: Column,
    amount: Column | None = None,
    withdrawal: Column | None = None,
    deposit: Column | None = None,
    indicator: Column | None = None,
) -> Column:
    """CREDIT, DEBIT or UNKNOWN: indicator, columns, sign, then keywords."""
    branches: list[tuple[Column, object]] = []
    if indicator is not None:
        flag = F.upper(strip(indicator))
        branches += [(flag.isin(v.CREDIT_INDICATORS), "CREDIT"), (flag.isin(v.DEBIT_INDICATORS), "DEBIT")]
    if withdrawal is not None and deposit is not None:
        both = withdrawal.isNotNull() & deposit.isNotNull()
        branches += [(both & (withdrawal > 0), "DEBIT"), (both & (deposit > 0), "CREDIT")]
    if amount is not None:
        branches += [(amount < 0, "DEBIT"), (amount > 0, "CREDIT")]
    up = F.upper(description)
    branches += [(any_contains(up, v.DEBIT_KEYWORDS), "DEBIT"), (any_contains(up, v.CREDIT_KEYWORDS), "CREDIT")]
    return case_of([(cond, F.lit(value)) for cond, value in branches], "UNKNOWN")


def normalize_bank_name(c: Column) -> Column:
    s = strip(F.upper(c))
    branches = [(any_contains(s, spellings), F.lit(name)) for name, spellings in v.BANK_NAMES]
    return F.when(c.isNull() | (c == ""), F.lit(None)).otherwise(case_of(branches, s))


def extract_account_number(c: Column) -> Column:
    return first_group(c, v.ACCOUNT_PATTERNS)


def mask_account_number(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return (
        F.when(c.isNull() | (c == ""), F.lit(""))
        .when(F.length(digits) < 4, F.lit("XXXX"))
        .otherwise(F.concat(F.lit("XXXX-XXXX-"), F.right(digits, F.lit(4))))
    )


def mask_all_but_last4(c: Column) -> Column:
    hidden = F.repeat(F.lit("*"), F.length(c) - 4)
    return F.when(F.length(c) <= 4, F.lit("****")).otherwise(F.concat(hidden, F.right(c, F.lit(4))))


def description_class(c: Column) -> Column:
    """Coarse category of a description; 'Other' when no class matches."""
    up = F.upper(c)
    rules = [(behind_first_letters(pattern), name) for name, pattern in v.DESCRIPTION_CLASSES]
    # The first condition always runs and names the upper-case text twice: Spark works it out once for all rules.
    return F.when(up.isNull() | (up == ""), F.lit(None)).otherwise(first_regex(up, rules, "Other"))


def canonical_merchant(c: Column) -> Column:
    return first_regex(F.upper(c), v.CANONICAL_MERCHANTS, None)


# --- matching text ----------------------------------------------------------------


def normalize_description(c: Column) -> Column:
    s = strip(F.lower(F.coalesce(c, F.lit(""))))
    for pattern in v.NORMALIZE_PATTERNS:
        s = F.regexp_replace(s, f"(?i){pattern}", "")
    return squeeze(s)


def keywords(normalized: Column) -> Column:
    """Words of a normalised description that can name a merchant."""
    noise = F.array(*[F.lit(w) for w in v.NOISE_WORDS])
    words = F.regexp_extract_all(normalized, F.lit("[a-z]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(noise, w))


def extract_upi_id(c: Column) -> Column:
    return first_group(F.lower(c), v.UPI_ID_PATTERNS)


def merchant_name_guess(normalized: Column) -> Column:
    """Merchant name by its place in the text, else the first keyword."""
    named = []
    for pattern in v.MERCHANT_NAME_PATTERNS:
        m = squeeze(F.regexp_extract(normalized, pattern, 1))
        named.append(F.when(F.length(m) >= 3, F.initcap(m)))
    return F.coalesce(*named, F.initcap(F.try_element_at(keywords(normalized), F.lit(1))))


def looks_like_subscription(description: Column, merchant: Column, amount: Column, is_recurring: Column) -> Column:
    words = "|".join(v.SUBSCRIPTION_WORDS)
    text = F.concat_ws("\n", F.lower(description), F.lower(F.coalesce(merchant, F.lit(""))))
    prices = [F.lit(p).cast("decimal(15,2)") for p in v.SUBSCRIPTION_PRICES]
    return text.rlike(words) | amount.isin(prices) | F.coalesce(is_recurring, F.lit(False))


# --- time -------------------------------------------------------------------------


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def time_of_day(ts: Column) -> Column:
    h = F.hour(ts.cast("timestamp"))
    return (
        F.when(h.between(6, 11), "morning").when(h.between(12, 16), "afternoon").when(h.between(17, 20), "evening").otherwise("night")
    )


def hint(category: str, subcategory: str, confidence: float) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"), F.lit(confidence).alias("confidence")
    )


def time_hints(ts: Column) -> Column:
    """Category hints from weekday, hour and day of month, in fixed order."""
    # Fixed values: (condition, category, subcategory, confidence).
    weekend, part, day = is_weekend(ts), time_of_day(ts), F.dayofmonth(ts)
    rows = [
        (weekend, "Food & Dining", "Restaurants", 0.1),
        (weekend, "Entertainment", "Movies/Cinema", 0.1),
        (weekend, "Shopping", "Clothes/Apparel", 0.05),
        (part == "morning", "Food & Dining", "Coffee/Tea", 0.1),
        (part == "morning", "Transport", "Cab/Auto", 0.1),
        (part == "evening", "Food & Dining", "Food Delivery", 0.1),
        (part == "evening", "Food & Dining", "Restaurants", 0.1),
        (day <= 5, "Housing", "Rent", 0.15),
        (day <= 5, "Income", "Salary", 0.15),
        (day >= 25, "Financial", "EMI Payment", 0.1),
        (day >= 25, "Financial", "Credit Card Bill", 0.1),
    ]
    return F.array_compact(F.array(*[F.when(cond, hint(c, s, p)) for cond, c, s, p in rows]))


def amount_hints(amount: Column, is_debit: Column) -> Column:
    """Up to 5 category hints whose usual amounts cover this one, best first."""
    # Ranges are laid out by confidence, so the array needs no sort.
    ordered = sorted(v.AMOUNT_RANGES, key=lambda r: -r[4])
    debit = F.array_compact(F.array(*[F.when(amount.between(lo, hi), hint(c, s, p)) for lo, hi, c, s, p in ordered]))
    income = [("Other Income", 0.30), ("Refund", 0.25), ("Cashback", 0.20)]
    credit = (
        F.when(amount >= 20000, F.array(hint("Income", "Salary", 0.50)))
        .when(amount >= 100, F.array(*[hint("Income", s, p) for s, p in income]))
        .otherwise(F.slice(F.array(hint("Income", "Salary", 0.0)), 1, 0))
    )
    return F.when(is_debit, F.slice(debit, 1, 5)).otherwise(credit)


# --- general ----------------------------------------------------------------------


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"(?U)[\s_]+", "-")
    s = F.regexp_replace(s, r"[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")


def slug_of(text: str) -> str:
    """Same as ``slug`` for a literal known on the driver."""
    s = re.sub(r"[^a-z0-9-]", "", re.sub(r"[\s_]+", "-", text.lower()))
    return re.sub("-+", "-", s).strip("-")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def transaction_key(date: Column, amount: Column, txn_type: Column, description: Column) -> Column:
    """md5 of day, amount with 2 decimals, direction and 50 characters of text."""
    money = amount.cast("decimal(20,2)").cast("string")
    return F.md5(F.concat_ws("|", date.cast("string"), money, txn_type, F.substring(F.coalesce(description, F.lit("")), 1, 50)))


def format_currency(amount: Column, currency: Column) -> Column:
    symbol = case_of([(currency == k, F.lit(s)) for k, s in v.CURRENCY_SYMBOLS.items()], currency)
    return F.concat(symbol, F.when(currency == "JPY", F.format_number(amount, 0)).otherwise(F.format_number(amount, 2)))


def format_indian(amount: Column, symbol: str = "₹") -> Column:
    """Crore and lakh units above 1e7 and 1e5."""
    a = amount.cast("double")
    text = (
        F.when(a >= 10000000, F.format_string("%.2f Cr", a / 10000000))
        .when(a >= 100000, F.format_string("%.2f L", a / 100000))
        .when(a >= 1000, F.format_number(a, 0))
        .otherwise(F.format_string("%.2f", a))
    )
    return F.concat(F.lit(symbol), text)


def mask_email(c: Column) -> Column:
    local = F.regexp_extract(c, r"(?s)^(.*)@([^@]*)$", 1)
    domain = F.regexp_extract(c, r"(?s)^(.*)@([^@]*)$", 2)
    last = F.when(F.length(local) <= 2, F.lit("")).otherwise(F.right(local, F.lit(1)))
    return F.when(~c.contains("@"), c).otherwise(F.concat(F.left(local, F.lit(1)), F.lit("***"), last, F.lit("@"), domain))


def truncate(c: Column, max_length: int = 100) -> Column:
    return F.when(F.length(c) <= max_length, c).otherwise(F.concat(F.left(c, F.lit(max_length - 3)), F.lit("...")))


def safe_uuid(c: Column) -> Column:
    """Canonical text of a UUID, null when it is none."""
    hexed = F.lower(F.regexp_replace(F.regexp_replace(c, "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", ""))
    parts = [F.substring(hexed, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(hexed.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def platform_family(c: Column) -> Column:
    p = F.lower(c)
    return (
        F.when(p.contains("windows"), "windows")
        .when(p.contains("mac") | p.contains("darwin"), "macos")
        .when(p.contains("linux"), "linux")
        .when(p.contains("android"), "android")
        .when(any_contains(p, ["ios", "iphone", "ipad"]), "ios")
        .otherwise(p)
    )


def browser_family(c: Column) -> Column:
    ua = F.lower(c)
    return (
        F.when(ua.contains("chrome") & ~ua.contains("edge"), "chrome")
        .when(ua.contains("firefox"), "firefox")
        .when(ua.contains("safari") & ~ua.contains("chrome"), "safari")
        .when(ua.contains("edge"), "edge")
        .otherwise("other")
    )
