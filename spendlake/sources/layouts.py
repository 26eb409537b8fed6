"""Statement text lines to transactions, by bank layout.

A layout is an ordered list of line patterns. The first of them that gives a
complete row for a line is the one that counts.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions import text as x
from spendlake.functions.rules import any_contains, beginnings, case_of, first_group, found
from spendlake.operators.ranking import first_per_key
from spendlake.sources.delimited import computed_once

# Line patterns of each layout (matched from the start of the line).
HDFC = [
    r"^(\d{2}[/-]\d{2}[/-]\d{2,4})\s+(.+?)\s+(\d+)\s+\d{2}[/-]\d{2}[/-]\d{2,4}\s+([\d,]+\.?\d*)?\s*([\d,]+\.?\d*)?\s+([\d,]+\.?\d*)",
    r"^(\d{2}[/-]\d{2}[/-]\d{2,4})\s+(.+?)\s+([\d,]+\.?\d*)\s+(?:DR|CR)?\s*([\d,]+\.?\d*)?",
]
SBI = [
    r"(?i)^(\d{1,2}\s+\w{3}\s+\d{4})\s+\d{1,2}\s+\w{3}\s+\d{4}\s+(.+?)\s+(\d+)?\s+([\d,]+\.?\d*)?\s+([\d,]+\.?\d*)?\s+([\d,]+\.?\d*)",
    r"(?i)^(\d{2}[/-]\d{2}[/-]\d{4})\s+(.+?)\s+([\d,]+\.?\d*)\s+(DR|CR)\s+([\d,]+\.?\d*)",
]
ICICI = [
    r"^(\d+)\s+(\d{2}/\d{2}/\d{4})\s+\d{2}/\d{2}/\d{4}\s+[\w-]+\s+(.+?)\s+([\d,]+\.?\d*)?\s+([\d,]+\.?\d*)?\s+([\d,]+\.?\d*)",
]
AXIS = [r"^(\d{2}-\w{3}-\d{4})\s+(\d*)\s+(.+?)\s+([\d,]+\.?\d*)?\s+([\d,]+\.?\d*)?\s+([\d,]+\.?\d*)"]
KOTAK = [r"(?i)^(\d{2}[/-]\d{2}[/-]\d{4})\s+(.+?)\s+([\d,]+\.?\d*)\s+(DR|CR)\s+([\d,]+\.?\d*)"]
GENERIC = [
    r"(?i)^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s+(.+?)\s+([\d,]+\.?\d+)\s*(DR|CR|D|C)?\s*([\d,]+\.?\d+)?",
    r"(?i)^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s+(.+?)\s+([\d,]+\.?\d*)?\s+([\d,]+\.?\d*)?\s+([\d,]+\.?\d+)",
    r"(?i)^(\d{1,2}\s+\w{3}\s+\d{4})\s+(.+?)\s+([\d,]+\.?\d+)\s*(DR|CR)?\s*([\d,]+\.?\d+)?",
]
GENERIC_HEADER_WORDS = ["DATE", "DESCRIPTION", "BALANCE", "NARRATION", "PARTICULARS"]

# Bank patterns in order, and the layout of each bank.
BANKS = [
    ("hdfc", r"HDFC\s*BANK|HDFCBANK"),
    ("sbi", r"STATE\s*BANK\s*OF\s*INDIA|SBI|SBIN"),
    ("icici", r"ICICI\s*BANK|ICICIBANK"),
    ("axis", r"AXIS\s*BANK|AXISBANK"),
    ("kotak", r"KOTAK\s*MAHINDRA|KOTAK\s*BANK|KOTAKBANK"),
    ("idfc", r"IDFC\s*FIRST|IDFC\s*BANK|IDFCFIRST"),
    ("yes", r"YES\s*BANK|YESBANK"),
    ("scb", r"STANDARD\s*CHARTERED|SCB"),
    ("citi", r"CITIBANK|CITI\s*BANK"),
    ("pnb", r"PUNJAB\s*NATIONAL\s*BANK|PNB"),
    ("bob", r"BANK\s*OF\s*BARODA|BOB"),
    ("canara", r"CANARA\s*BANK|CANARABANK"),
    ("union", r"UNION\s*BANK|UNIONBANK"),
    ("indian", r"INDIAN\s*BANK|INDIANBANK"),
    ("indusind", r"INDUSIND\s*BANK|INDUSINDBANK"),
    ("federal", r"FEDERAL\s*BANK|FEDERALBANK"),
    ("rbl", r"RBL\s*BANK|RATNAKAR\s*BANK"),
    ("bandhan", r"BANDHAN\s*BANK|BANDHANBANK"),
]
UPI_APPS = [
    ("gpay", r"GOOGLE\s*PAY|GPAY"),
    ("phonepe", r"PHONEPE|PHONE\s*PE"),
    ("paytm", r"PAYTM|PAY\s*TM"),
    ("amazonpay", r"AMAZON\s*PAY|AMAZONPAY"),
    ("bhim", "BHIM"),
    ("mobikwik", "MOBIKWIK"),
]
LAYOUT_OF_BANK = {
    "hdfc": "hdfc", "sbi": "sbi", "pnb": "sbi", "bob": "sbi", "canara": "sbi", "icici": "icici", "axis": "axis",
    "indusind": "axis", "kotak": "kotak",
}

# Patterns of the facts in a statement's head.
ACCOUNT_PATTERNS = [
    r"(?i)A/C\s*(?:NO\.?)?\s*[:\s]*(\d{9,18})",
    r"(?i)ACCOUNT\s*(?:NO\.?|NUMBER)?\s*[:\s]*(\d{9,18})",
    r"(?i)ACCT\s*(?:NO\.?)?\s*[:\s]*(\d{9,18})",
]
PERIOD_PATTERNS = [
    r"(?i)STATEMENT\s*(?:FOR|OF)?\s*(?:THE)?\s*(?:PERIOD)?\s*[:\s]*(\d{1,2}[-/]\w{3}[-/]\d{2,4})\s*(?:TO|-)?\s*(\d{1,2}[-/]\w{3}[-/]\d{2,4})",
    r"(?i)FROM\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\s*TO\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
    r"(?i)PERIOD\s*[:\s]*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\s*[-–]\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
]
NAME_PATTERNS = [
    r"(?i)NAME\s*[:\s]*([A-Z][A-Z\s\.]+)",
    r"(?i)CUSTOMER\s*NAME\s*[:\s]*([A-Z][A-Z\s\.]+)",
    r"(?i)A/C\s*HOLDER\s*[:\s]*([A-Z][A-Z\s\.]+)",
]
OPENING_PATTERNS = [r"(?i)OPENING\s*BALANCE\s*[:\s]*([\d,]+\.?\d*)", r"(?i)BALANCE\s*B/F\s*[:\s]*([\d,]+\.?\d*)"]
CLOSING_PATTERNS = [r"(?i)CLOSING\s*BALANCE\s*[:\s]*([\d,]+\.?\d*)", r"(?i)BALANCE\s*C/F\s*[:\s]*([\d,]+\.?\d*)"]

SEP = "\u0001"
ROW = """struct<date:date,description:string,amount:double,transaction_type:string,balance:double,reference:string,raw_text:string,
 confidence:double>"""


@dataclass(frozen=True)
class LinePattern:
    """One line pattern and where its groups go.

    ``paid`` and ``got`` are the withdrawal and deposit groups. With ``mark``,
    ``paid`` is the amount and the mark group says which of the two it is.
    """

    layout: str
    regex: str
    groups: int
    day: int
    description: int
    paid: int
    balance: int
    got: int | None = None
    mark: int | None = None
    reference_in_description: bool = False
    confidence: float = 1.0


PATTERNS = [
    LinePattern("hdfc", HDFC[0], 6, 1, 2, 4, 6, got=5),
    LinePattern("hdfc", HDFC[1], 4, 1, 2, 3, 4),
    LinePattern("sbi", SBI[0], 6, 1, 2, 4, 6, got=5),
    LinePattern("sbi", SBI[1], 5, 1, 2, 3, 5, mark=4),
    LinePattern("icici", ICICI[0], 6, 2, 3, 4, 6, got=5, reference_in_description=True),
    LinePattern("axis", AXIS[0], 6, 1, 3, 4, 6, got=5),
    LinePattern("kotak", KOTAK[0], 5, 1, 2, 3, 5, mark=4, reference_in_description=True),
    *[LinePattern("generic", p, 5, 1, 2, 3, 5, got=4, mark=4, confidence=0.7) for p in GENERIC],
]
LAYOUTS = ["hdfc", "sbi", "icici", "axis", "kotak", "generic"]


def _usable(line: Column, upper: Column, layout: str) -> Column:
    if layout == "icici":
        return ~line.startswith("S No")
    if layout == "generic":
        return (F.length(line) >= 10) & ~any_contains(upper, GENERIC_HEADER_WORDS)
    return F.lit(True)


PARTS = ["day", "description", "paid", "got", "balance", "mark", "kind", "referred"]


def _parts(line: Column, p: LinePattern) -> Column:
    """The groups of a pattern, in the order of ``PARTS``; one regex pass, and a single part where the pattern does not match."""
    group = lambda k: f"${k}" if k else ""
    kind = "mark" if p.mark else "columns" if p.got else "word"
    referred = "description" if p.reference_in_description else "line"
    parts = [group(p.day), group(p.description), group(p.paid), group(p.got), group(p.balance), group(p.mark), kind, referred]
    return F.split(F.regexp_replace(line, p.regex + "(?s:.*)", SEP.join(parts)), SEP)


def _with_rows(lines: DataFrame, layout: Column | str, as_of: dt.date, only: Column | None = None) -> DataFrame:
    """Add ``t``: the first complete row among the patterns of the line's layout, or null.

    The patterns are tried in turn, and a line that has its row is left out of the next turn. The steps of a
    turn are columns, which Spark works out once for a line. Lines outside ``only`` have no row.
    """
    names = [layout] if isinstance(layout, str) else LAYOUTS
    patterns = {name: [p for p in PATTERNS if p.layout == name] for name in names}
    c = F.col
    s, up, kind, mark = c("_s"), c("_up"), c("_kind"), c("_mark")
    out = lines.withColumn("_s", x.strip(c("line") if only is None else F.when(only, c("line")))).withColumns({
        "_up": F.upper(s), "_plain": F.replace(s, F.lit(SEP), F.lit(" ")), "t": F.lit(None).cast(ROW)})
    for turn in range(max(map(len, patterns.values()))):
        tried = {name: some[turn] for name, some in patterns.items() if turn < len(some)}
        mine = {name: (F.lit(True) if isinstance(layout, str) else layout == name) & _usable(s, up, name) for name in tried}
        parts = case_of([(mine[name], _parts(c("_plain"), p)) for name, p in tried.items()])
        sure = case_of([(mine[name], F.lit(p.confidence)) for name, p in tried.items()])
        out = out.withColumn("_parts", F.when(c("t").isNull() & s.isNotNull(), parts))
        hit = F.size("_parts") == len(PARTS)
        out = out.withColumns({f"_{name}": F.when(hit, F.get("_parts", F.lit(k))) for k, name in enumerate(PARTS)})
        # Without a mark or a second column the line says DR somewhere, or is a deposit.
        into = F.when(kind == "word", ~up.contains("DR")).when(kind == "mark", F.upper(mark).isin("CR", "C"))
        out_of = F.when(kind == "word", up.contains("DR")).when(kind == "mark", F.upper(mark).isin("DR", "D"))
        out = out.withColumns({"_into": F.coalesce(into, F.lit(False)), "_out_of": F.coalesce(out_of, F.lit(False))})
        out = out.withColumns({"_paid": F.when(~c("_into"), c("_paid")), "_got": F.when(c("_into"), c("_paid")).when(~c("_out_of"), c("_got"))})
        out = out.withColumns({
            "_date": F.when(c("_day").isNotNull(), x.clean_date(c("_day"), as_of)), "_description": x.squeeze(c("_description")),
            "_paid": x.clean_amount(c("_paid")), "_got": x.clean_amount(c("_got")), "_balance": x.clean_amount(c("_balance")),
            "_reference": F.when(c("_referred") == "description", c("_description")).when(c("_referred") == "line", s), "_sure": sure,
        })
        # Only the generic layout asks for a minimum of text.
        complete = c("_date").isNotNull() & ((c("_paid") > 0) | (c("_got") > 0)) & ((c("_sure") == 1.0) | (F.length("_description") >= 3))
        row = F.struct(
            c("_date").alias("date"), c("_description").alias("description"), F.when(c("_paid") > 0, c("_paid")).otherwise(c("_got")).alias("amount"),
            F.when(c("_paid") > 0, "DEBIT").otherwise("CREDIT").alias("transaction_type"), c("_balance").alias("balance"),
            x.extract_reference(c("_reference")).alias("reference"), s.alias("raw_text"), c("_sure").alias("confidence"),
        )
        out = out.withColumn("t", F.coalesce("t", F.when(complete, row)))
    # A filter on the row stays above the steps that made it.
    return out.select(*lines.columns, computed_once(c("t")).alias("t"))


def parse_layout(lines: DataFrame, layout: str, as_of: dt.date) -> DataFrame:
    """Transactions of all lines, all read with one layout."""
    return _with_rows(lines, layout, as_of).filter("t IS NOT NULL").select("file", "line_no", "t.*")


def first_named(lines: DataFrame, names: list[tuple[str, str]], alias: str) -> DataFrame:
    """First name, in list order, whose pattern occurs on any line of the file.

    Most lines have no plain beginning of any pattern in them and are not searched with the patterns.
    """
    up = F.col("_up")
    near = any_contains(up, beginnings(p for _, p in names))
    k = F.when(near, case_of([(up.rlike(p), F.lit(n)) for n, (_, p) in enumerate(names)]))
    labels = F.array(*[F.lit(name) for name, _ in names])
    return lines.select("file", F.upper("line").alias("_up")).groupBy("file").agg(F.min(k).alias("k")).select("file", F.try_element_at(labels, F.col("k") + 1).alias(alias))


def detect_banks(lines: DataFrame) -> DataFrame:
    return first_named(lines, BANKS, "bank")


def detect_upi_apps(lines: DataFrame) -> DataFrame:
    return first_named(lines, UPI_APPS, "app")


def layout_of(bank: Column) -> Column:
    return case_of([(bank == b, F.lit(layout)) for b, layout in LAYOUT_OF_BANK.items()], "generic")


def parse_statements(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Route every file to its bank's layout; a file without rows is read as generic."""
    routed = lines.join(detect_banks(lines), "file").withColumn("layout", layout_of(F.col("bank")))
    own = _with_rows(routed, F.col("layout"), as_of).withColumnRenamed("t", "own")
    # A file is bounded by the size limit, so it may be looked at as one group.
    any_row = F.max(F.col("own").isNotNull()).over(Window.partitionBy("file"))
    retry = ~F.col("_any") & (F.col("layout") != "generic")
    second = _with_rows(own.withColumn("_any", any_row), "generic", as_of, retry)
    rows = second.withColumn("t", F.coalesce("own", "t")).filter("t IS NOT NULL").select("file", "line_no", "bank", "t.*")
    return rows.withColumn("category", x.description_class(F.col("description")))


def statement_facts(texts: DataFrame, as_of: dt.date) -> DataFrame:
    """Masked account, period, holder and balances from each file's text (file, text)."""
    t = F.col("text")
    account = first_group(t, ACCOUNT_PATTERNS)
    start, end = (x.clean_date(first_group(t, PERIOD_PATTERNS, g), as_of) for g in (1, 2))
    # The later of two balance patterns overrides the first.
    opening, closing = (
        F.coalesce(*[x.clean_amount(found(t, p)) for p in reversed(patterns)]) for patterns in (OPENING_PATTERNS, CLOSING_PATTERNS)
    )
    period = F.when(start.isNotNull() & end.isNotNull(), F.concat_ws(" to ", start.cast("string"), end.cast("string")))
    return texts.select(
        "file",
        F.when(account.isNotNull(), x.mask_account_number(account)).alias("account_number_masked"),
        period.alias("statement_period"),
        x.strip(first_group(t, NAME_PATTERNS)).alias("account_holder"),
        opening.alias("opening_balance"),
        closing.alias("closing_balance"),
    )


# --- spreadsheets: a table of cells (file, sheet, row, col, value) -----------------------

# Words of a sheet's header per field, in field order.
SHEET_WORDS = {
    "date": ["date", "dt", "txn date", "transaction date", "value date", "posting date"],
    "description": ["description", "narration", "particulars", "details", "remarks", "transaction description"],
    "withdrawal": ["withdrawal", "debit", "dr", "debit amount", "withdrawal amt", "dr amount"],
    "deposit": ["deposit", "credit", "cr", "credit amount", "deposit amt", "cr amount"],
    "amount": ["amount", "transaction amount", "txn amount", "value"],
    "balance": ["balance", "closing balance", "running balance", "available balance"],
    "reference": ["reference", "ref no", "cheque no", "chq no", "transaction id", "utr"],
    "type": ["type", "transaction type", "dr/cr", "cr/dr"],
}
SHEET_BANKS = [
    ("HDFC BANK", "HDFC"), ("STATE BANK OF INDIA", "SBI"), ("SBI", "SBI"), ("ICICI BANK", "ICICI"), ("AXIS BANK", "AXIS"),
    ("KOTAK MAHINDRA", "KOTAK"), ("IDFC FIRST", "IDFC FIRST"), ("YES BANK", "YES"),
]


def sheet_columns(cells: DataFrame) -> DataFrame:
    """Header row and column of each field per sheet: (file, sheet, header_row, field, col)."""
    top = cells.filter((F.col("row") < 30) & (F.col("value") != "") & F.col("file").isNotNull() & F.col("sheet").isNotNull())
    # What a cell's text names is worked out once; a row's facts come from one aggregate of fixed-width columns.
    low = F.col("_low")
    marks = F.struct(*[any_contains(low, words).alias(f) for f, words in SHEET_WORDS.items()])
    named = top.withColumn("_low", F.lower("value")).withColumn("_m", F.explode(F.array(marks)))
    field = case_of([(F.col(f"_m.{f}"), F.lit(f)) for f in SHEET_WORDS])
    near = F.col("col") < 20
    money = F.col("_m.description") | F.col("_m.amount") | F.col("_m.withdrawal") | F.col("_m.deposit")
    per_row = named.withColumn("field", field).groupBy("file", "sheet", "row").agg(
        F.max(near & F.col("_m.date")).alias("d"), F.max(near & money).alias("m"),
        *[F.max(F.col("field") == f).alias(f"_has_{f}") for f in SHEET_WORDS],
        *[F.min(F.when(F.col("field") == f, F.col("col"))).alias(f"_col_{f}") for f in SHEET_WORDS],
    )
    header = first_per_key(per_row.filter("d AND m"), ["file", "sheet"], [F.col("row")])
    # The first row with a date and another field is the header; the first word list that fits names a column.
    usable = header.filter(F.col("_has_date") & (F.col("_has_amount") | F.col("_has_withdrawal") | F.col("_has_deposit")))
    fields = F.array(*[
        F.when(F.col(f"_has_{f}"), F.struct(F.lit(f).alias("field"), F.col(f"_col_{f}").alias("col"))) for f in SHEET_WORDS
    ])
    return usable.select("file", "sheet", F.col("row").alias("header_row"), F.inline(F.array_compact(fields)))


def parse_sheets(cells: DataFrame, as_of: dt.date) -> DataFrame:
    from spendlake.sources.delimited import fields_to_transaction

    columns = sheet_columns(cells)
    body = cells.join(columns, ["file", "sheet", "col"]).filter(F.col("row") > F.col("header_row"))
    wide = body.groupBy("file", "sheet", "row").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in SHEET_WORDS]
    )
    return fields_to_transaction(wide.withColumn("type_indicator", F.lit(None).cast("string")), as_of, typed_words=False)


def sheet_banks(cells: DataFrame) -> DataFrame:
    """Bank named in the first cells of a sheet, in reading order."""
    bank = case_of([(F.upper("value").contains(p), F.lit(b)) for p, b in SHEET_BANKS])
    near = cells.filter((F.col("row") < 10) & (F.col("col") < 5)).withColumn("bank", bank).filter("bank IS NOT NULL")
    return first_per_key(near, ["file", "sheet"], [F.col("row"), F.col("col")]).select("file", "sheet", "bank")
