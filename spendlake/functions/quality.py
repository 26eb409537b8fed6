"""Text hygiene and data-quality checks: every check adds to an ``errors`` array."""

from __future__ import annotations

import datetime as dt
import html
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.functions import fixed_values as v
from spendlake.functions.rules import any_contains, any_of, case_of
from spendlake.functions.text import squeeze

# Python's re stops '.' at a line feed only; (?d) gives Java the same rule.
FLAGS = "(?id)"


# Whole pages pass through these: rows go to Python by the hundred, not in Arrow batches of 10,000.
@F.udf(T.StringType(), useArrow=False)
def nfc(s: str | None) -> str | None:
    """Unicode NFC; Spark has no built-in for it."""
    return None if s is None else unicodedata.normalize("NFC", s)


@F.udf(T.StringType(), useArrow=False)
def unescape_html(s: str | None) -> str | None:
    """HTML entities to characters; Spark has no built-in for the entity table."""
    return None if s is None else html.unescape(s)


def normalize_nfc(c: Column) -> Column:
    """NFC, sending only text with non-ASCII characters to Python."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), nfc(F.when(c.rlike(r"[^\x00-\x7f]"), c))).otherwise(c)


def strip_html(c: Column) -> Column:
    bare = F.regexp_replace(c, r"<[^>]+>", "")
    has_entity = bare.contains("&")
    return F.when(has_entity, unescape_html(F.when(has_entity, bare))).otherwise(bare)


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def remove_control_characters(c: Column) -> Column:
    """Line feed, carriage return and tab stay."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def sanitize_filename(c: Column) -> Column:
    s = F.regexp_replace(c, r"[/\\\x00-\x1f\x7f-\x9f]", "")
    s = F.regexp_replace(F.regexp_replace(s, r'[<>:"|?*]', "_"), r"^\.+", "")
    dotted = s.contains(".")
    name = F.when(dotted, F.regexp_extract(s, r"(?s)^(.*)\.([^.]*)$", 1)).otherwise(s)
    ext = F.when(dotted, F.regexp_extract(s, r"(?s)^(.*)\.([^.]*)$", 2)).otherwise("")
    return F.concat(F.left(name, F.lit(200)), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))


def sanitize_email(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[<>\"']", "")


def sanitize_phone(c: Column) -> Column:
    return F.concat(F.when(c.startswith("+"), "+").otherwise(""), F.regexp_replace(c, r"\D", ""))


# --- suspicious text -----------------------------------------------------------------


def _needed(pattern: str) -> str:
    """A literal every match of the pattern contains ('' when there is none)."""
    if pattern.startswith("<"):
        return "<"
    if pattern.endswith(":"):
        return ":"
    if pattern.rstrip(")").endswith("\\("):
        return "("
    if "=" in pattern:
        return "="
    return "&{" if pattern == "&\\{" else ""


def _search(c: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found; patterns that need a literal wait for it.

    A literal test is far cheaper than a case-insensitive regex on a long text.
    """
    groups: dict[str, list[str]] = {}
    for p in patterns:
        groups.setdefault(_needed(p), []).append(p)
    tests = []
    for literal, ps in sorted(groups.items(), key=lambda g: g[0] == ""):
        hit = c.rlike(FLAGS + "|".join(f"(?:{p})" for p in ps))
        tests.append(c.contains(literal) & hit if literal else hit)
    return any_of(tests)


def has_sql_injection(c: Column) -> Column:
    marks = any_contains(c, ["--", ";", "/*", "*/", "@"])
    return marks | _search(c, [p for p in v.SQL_INJECTION_PATTERNS if p != v.SQL_INJECTION_PATTERNS[1]])


def has_markup(c: Column) -> Column:
    return _search(c, v.MARKUP_PATTERNS)


def _first_match(c: Column, patterns: list[str]) -> Column:
    return case_of([(c.rlike(FLAGS + p), F.regexp_extract(c, FLAGS + p, 0)) for p in patterns])


def sql_injection_match(c: Column) -> Column:
    """Text of the first pattern that matches, null when the text is safe."""
    return _first_match(c, v.SQL_INJECTION_PATTERNS)


def markup_match(c: Column) -> Column:
    return _first_match(c, v.MARKUP_PATTERNS)


# --- validators ----------------------------------------------------------------------


def _result(value: Column, checks: list[tuple[Column, Column | str]], missing: Column, required: bool, name: str) -> Column:
    """struct(value, errors, is_valid); a missing value only fails when required."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), message) for bad, message in checks]))
    absent = F.array(F.lit(f"{name} is required")) if required else F.array().cast("array<string>")
    errors = F.when(missing, absent).otherwise(broken)
    return F.struct(
        F.when(~missing, value).alias("value"), errors.alias("errors"), (F.size(errors) == 0).alias("is_valid")
    )


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def validate_string(
    c: Column,
    name: str = "field",
    min_length: int = 0,
    max_length: int = 10000,
    pattern: str | None = None,
    required: bool = True,
    allow_html: bool = False,
    check_injection: bool = True,
) -> Column:
    s = squeeze(remove_control_characters(normalize_nfc(c)))
    checks = [
        (F.length(s) < min_length, f"{name} must be at least {min_length} characters"),
        (F.length(s) > max_length, f"{name} must not exceed {max_length} characters"),
    ]
    if pattern:
        checks.append((~s.rlike(f"^(?:{pattern})"), f"{name} format is invalid"))
    if check_injection:
        checks += [
            (has_sql_injection(s), f"{name} contains invalid characters"),
            (has_markup(s), f"{name} contains invalid content"),
        ]
    checks = [(bad, F.lit(message)) for bad, message in checks]
    return _result(s if allow_html else escape_html(s), checks, blank(c), required, name)


def validate_email(c: Column, name: str = "email", required: bool = True) -> Column:
    s = sanitize_email(c)
    # Fixed value: accepted form of an address.
    form = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
    checks = [
        (~s.rlike(form), F.lit(f"{name} is not a valid email address")),
        (s.contains("..") | s.startswith(".") | s.endswith("."), F.lit(f"{name} has invalid format")),
        (F.length(s) > 254, F.lit(f"{name} is too long")),
    ]
    return _result(s, checks, c.isNull() | (c == ""), required, name)


def validate_phone(c: Column, name: str = "phone", required: bool = True, country_code: str | None = None) -> Column:
    s = sanitize_phone(c)
    checks = [(~s.rlike(r"^\+?[1-9]\d{1,14}$"), F.lit(f"{name} is not a valid phone number"))]
    if country_code:
        checks.append((~s.startswith(f"+{country_code}"), F.lit(f"{name} must start with +{country_code}")))
    return _result(s, checks, c.isNull() | (c == ""), required, name)


def validate_amount(
    c: Column,
    name: str = "amount",
    currency: str = "USD",
    allow_negative: bool = False,
    allow_zero: bool = True,
    min_amount: str | None = None,
    max_amount: str | None = None,
) -> Column:
    """Amount text to a decimal rounded half up to the currency's digits."""
    digits, largest = v.CURRENCY_LIMITS.get(currency, v.CURRENCY_LIMITS["USD"])
    low, high = min_amount or "0", max_amount or largest
    raw = F.regexp_replace(c, r"[^\d.-]", "").try_cast("decimal(38,10)")
    amount = F.round(raw, digits)

    def dec(x: str) -> Column:
        return F.lit(x).cast("decimal(38,10)")

    number = raw.isNotNull()
    checks = [
        (~number, F.lit(f"{name} must be a valid number")),
        (F.lit(not allow_negative) & (amount < 0), F.lit(f"{name} cannot be negative")),
        (F.lit(not allow_zero) & (amount == 0), F.lit(f"{name} cannot be zero")),
        (amount < dec(low), F.lit(f"{name} must be at least {low}")),
        (amount > dec(high), F.lit(f"{name} must not exceed {high}")),
        (F.abs(amount) > dec(v.AMOUNT_OVERFLOW), F.lit(f"{name} exceeds maximum allowed value")),
    ]
    return _result(amount, checks, c.isNull() | (c == ""), True, name)


def validate_date(
    c: Column,
    as_of: dt.date,
    name: str = "date",
    required: bool = True,
    min_date: dt.date | None = None,
    max_date: dt.date | None = None,
    allow_future: bool = True,
    allow_past: bool = True,
) -> Column:
    day = F.coalesce(*[F.try_to_date(c, f) for f in ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d")])
    checks = [(day.isNull(), F.lit(f"{name} has invalid date format"))]
    if not allow_future:
        checks.append((day > F.lit(as_of), F.lit(f"{name} cannot be in the future")))
    if not allow_past:
        checks.append((day < F.lit(as_of), F.lit(f"{name} cannot be in the past")))
    if min_date:
        checks.append((day < F.lit(min_date), F.lit(f"{name} cannot be before {min_date}")))
    if max_date:
        checks.append((day > F.lit(max_date), F.lit(f"{name} cannot be after {max_date}")))
    return _result(day, checks, c.isNull() | (c == ""), required, name)


def validate_uuid(c: Column, name: str = "id", required: bool = True) -> Column:
    # Fixed value: accepted form of a UUID.
    form = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    checks = [(~c.rlike(form), F.lit(f"{name} is not a valid UUID"))]
    return _result(F.lower(c), checks, c.isNull() | (c == ""), required, name)


def validate_account_number(c: Column, name: str = "account_number", required: bool = True) -> Column:
    s = F.regexp_replace(c, r"[\s-]", "")
    checks = [
        (~s.rlike(r"^[\p{L}\p{N}]+$"), F.lit(f"{name} contains invalid characters")),
        ((F.length(s) < 4) | (F.length(s) > 34), F.lit(f"{name} has invalid length")),
        (has_sql_injection(s), F.lit(f"{name} contains invalid characters")),
    ]
    return _result(F.upper(s), checks, c.isNull() | (c == ""), required, name)


def transaction_errors(df: DataFrame) -> DataFrame:
    """Rules of a new transaction row; ``errors`` lists the broken ones."""
    limits = {"merchant_name": 255, "merchant_category": 100, "description": 500, "bank_name": 100, "notes": 1000}
    amount = F.col("amount").cast("decimal(38,10)")
    checks = [
        (F.coalesce(~(amount > 0), F.lit(True)), "amount must be greater than 0"),
        (amount != F.round(amount, 2), "amount can have at most 2 decimal places"),
        (~F.coalesce(F.col("transaction_type").isin("CREDIT", "DEBIT"), F.lit(False)), "transaction_type must be CREDIT or DEBIT"),
        (F.col("transaction_date").isNull(), "transaction_date is required"),
    ]
    if "account_last_4" in df.columns:
        checks.append((~F.col("account_last_4").rlike("^[0-9]{4}$"), "account_last_4 must be exactly 4 digits"))
    checks += [(F.length(c) > n, f"{c} must not exceed {n} characters") for c, n in limits.items() if c in df.columns]
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(m)) for bad, m in checks])))


def error_summary(df: DataFrame, errors: str = "errors") -> DataFrame:
    """How often each rule is broken."""
    return df.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
