"""Delimited statement files (bank portals and payment apps) to transactions.

Everything about a file (delimiter, header row, format, column positions) is a
small aggregate over its first lines, joined back to the lines.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions import fixed_values as v
from spendlake.functions import text as x
from spendlake.functions.rules import any_contains, case_of
from spendlake.operators.ranking import first_per_key
from spendlake.session import checkpoint_dir
from spendlake.sources import store
from spendlake.sources.files import DELIMITERS

# Words that mark a header row.
HEADER_WORDS = [
    "date", "description", "amount", "balance", "narration", "particulars", "debit", "credit", "withdrawal", "deposit",
    "transaction", "reference", "type", "status",
]

# Header names of each field per source format, in order of preference.
ALIASES = {
    "gpay": {
        "date": ["Date", "Transaction Date"],
        "description": ["Description", "Merchant", "To/From"],
        "amount": ["Amount", "Transaction Amount"],
        "type": ["Transaction Type", "Type", "Status"],
        "reference": ["Transaction ID", "Reference", "UPI ID"],
    },
    "phonepe": {
        "date": ["Date", "Transaction Date"],
        "description": ["Payee Name", "Description", "Merchant"],
        "amount": ["Amount", "Transaction Amount"],
        "type": ["Transaction Type", "Type"],
        "reference": ["Transaction ID", "UTR", "Reference"],
    },
    "paytm": {
        "date": ["Date", "Transaction Date", "Order Date"],
        "description": ["Description", "Merchant Name", "Order Details"],
        "amount": ["Amount", "Transaction Amount", "Total Amount"],
        "type": ["Transaction Type", "Type", "Status"],
        "reference": ["Order ID", "Transaction ID", "Reference"],
    },
    "amazonpay": {
        "date": ["Date", "Transaction Date"],
        "description": ["Description", "Merchant", "Order Description"],
        "amount": ["Amount", "Transaction Amount"],
        "type": ["Transaction Type", "Type"],
        "reference": ["Order ID", "Transaction ID", "Reference"],
    },
    "hdfc": {
        "date": ["Date", "Txn Date", "Transaction Date", "Value Date"],
        "description": ["Narration", "Description", "Particulars", "Transaction Description"],
        "withdrawal": ["Withdrawal Amt.", "Withdrawal Amount", "Debit", "Debit Amount"],
        "deposit": ["Deposit Amt.", "Deposit Amount", "Credit", "Credit Amount"],
        "balance": ["Closing Balance", "Balance", "Running Balance"],
        "reference": ["Chq./Ref.No.", "Reference No.", "Cheque No"],
    },
    "sbi": {
        "date": ["Txn Date", "Transaction Date", "Value Date", "Date"],
        "description": ["Description", "Narration", "Particulars"],
        "withdrawal": ["Debit", "Withdrawal", "Debit Amount"],
        "deposit": ["Credit", "Deposit", "Credit Amount"],
        "balance": ["Balance", "Closing Balance"],
        "reference": ["Ref No./Cheque No.", "Reference", "Txn Reference"],
    },
    "icici": {
        "date": ["Value Date", "Transaction Date", "Date"],
        "description": ["Transaction Remarks", "Remarks", "Description"],
        "withdrawal": ["Withdrawal Amount (INR )", "Withdrawal", "Debit"],
        "deposit": ["Deposit Amount (INR )", "Deposit", "Credit"],
        "balance": ["Balance (INR )", "Balance"],
        "reference": ["Cheque Number", "Reference"],
    },
    "axis": {
        "date": ["Tran Date", "Transaction Date", "Date"],
        "description": ["Particulars", "Description", "Narration"],
        "withdrawal": ["Debit", "Withdrawal", "Dr Amount"],
        "deposit": ["Credit", "Deposit", "Cr Amount"],
        "balance": ["Balance", "Closing Balance"],
        "reference": ["Chq No", "Reference"],
    },
    "kotak": {
        "date": ["Date", "Transaction Date", "Value Date"],
        "description": ["Description", "Narration", "Particulars"],
        "amount": ["Amount", "Transaction Amount"],
        "type_indicator": ["Dr / Cr", "Type", "DR/CR"],
        "balance": ["Balance", "Closing Balance"],
    },
    "generic": {
        "date": ["Date", "Txn Date", "Transaction Date", "Value Date"],
        "description": ["Description", "Narration", "Particulars", "Details", "Remarks"],
        "amount": ["Amount", "Transaction Amount", "Txn Amount"],
        "withdrawal": ["Withdrawal", "Debit", "Dr", "Withdrawal Amount"],
        "deposit": ["Deposit", "Credit", "Cr", "Deposit Amount"],
        "balance": ["Balance", "Closing Balance", "Running Balance"],
        "type": ["Type", "Transaction Type", "Dr/Cr"],
        "reference": ["Reference", "Ref No", "Transaction ID", "Cheque No"],
    },
}
FIELDS = ["date", "description", "amount", "withdrawal", "deposit", "balance", "type", "type_indicator", "reference"]

# Cell texts that mean "no value".
EMPTY_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]

# Names in the file text and the bank or app they stand for, in order.
CONTENT_BANKS = [
    ("HDFC BANK", "HDFC"), ("HDFCBANK", "HDFC"), ("STATE BANK OF INDIA", "SBI"), ("SBI", "SBI"), ("ICICI BANK", "ICICI"),
    ("ICICIBANK", "ICICI"), ("AXIS BANK", "AXIS"), ("AXISBANK", "AXIS"), ("KOTAK MAHINDRA", "KOTAK"), ("KOTAK BANK", "KOTAK"),
    ("IDFC FIRST", "IDFC FIRST"), ("IDFC BANK", "IDFC FIRST"), ("YES BANK", "YES"), ("YESBANK", "YES"),
    ("GOOGLE PAY", "GOOGLE PAY"), ("GPAY", "GOOGLE PAY"), ("PHONEPE", "PHONEPE"), ("PAYTM", "PAYTM"), ("AMAZON PAY", "AMAZON PAY"),
]


def occurrences(text: Column, piece: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def detect_delimiters(lines: DataFrame) -> DataFrame:
    """Delimiter per file: steady count over the first 10 lines, highest mean wins.

    Mean > 0 and variance < 2 are tested on whole numbers: n*Σx² - (Σx)² < 2n².
    """
    # A file whose first lines are all blank stays, with the default delimiter.
    filled = (F.col("line_no") < 10) & (F.trim("line") != "")
    sums = []
    for k, d in enumerate(DELIMITERS):
        c = F.when(filled, occurrences(F.col("line"), d).cast("bigint")).otherwise(0)
        sums += [F.sum(c).alias(f"s{k}"), F.sum(c * c).alias(f"q{k}")]
    per_file = lines.groupBy("file").agg(F.count(F.when(filled, 1)).alias("n"), *sums)
    n = F.col("n")

    def usable(k: int) -> Column:
        s, q = F.col(f"s{k}"), F.col(f"q{k}")
        return (s > 0) & (n * q - s * s < 2 * n * n)

    best = F.array_max(F.array_compact(F.array(*[
        F.when(usable(k), F.struct(F.col(f"s{k}").alias("s"), F.lit(-k).alias("o"), F.lit(d).alias("d"))) for k, d in enumerate(DELIMITERS)
    ])))
    return per_file.select("file", F.coalesce(best["d"], F.lit(",")).alias("delimiter"))


def split_cells(line: Column, delimiter: Column) -> Column:
    """Cells of a line; a delimiter inside double quotes does not split."""

    def cut(d: str) -> Column:
        plain = F.split(line, "\\" + d if d != "\t" else "\t", -1)
        quoted = F.split(line, ("\\" + d if d != "\t" else "\t") + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
        bare = F.transform(quoted, lambda s: F.replace(F.regexp_replace(F.trim(s), '^"|"$', ""), F.lit('""'), F.lit('"')))
        return F.when(line.contains('"'), bare).otherwise(plain)

    return case_of([(delimiter == d, cut(d)) for d in DELIMITERS])


def computed_once(value: Column) -> Column:
    """The value as a generated column: a later filter on it is not pushed below and does not work it out again.

    Spark does not compile what it generates from where a lambda is inside: give it columns that are made already.
    """
    return F.explode(F.array(value))


def find_headers(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """First of 20 lines with two header words and three columns, else line 0."""
    low = F.lower("line")
    words = sum((low.contains(w).cast("int") for w in HEADER_WORDS[1:]), low.contains(HEADER_WORDS[0]).cast("int"))
    head = lines.filter(F.col("line_no") < 20).join(delimiters, "file")
    columns = case_of([(F.col("delimiter") == d, occurrences(F.col("line"), d) + 1) for d in DELIMITERS])
    hit = (words >= 2) & (columns >= 3)
    return head.groupBy("file", "delimiter").agg(F.coalesce(F.min(F.when(hit, F.col("line_no"))), F.lit(0)).alias("header_row"))


def detect_format(headers: Column) -> Column:
    """Source format from the lower-case header names joined by blanks."""
    h = headers
    return (
        F.when(h.contains("narration") & (h.contains("withdrawal") | h.contains("deposit")), "hdfc")
        .when(h.contains("transaction remarks"), "icici")
        .when(h.contains("particulars") & h.contains("tran date"), "axis")
        .when(h.contains("dr / cr") | h.contains("dr/cr"), "kotak")
        .when((h.contains("merchant") | h.contains("payee")) & h.contains("upi"), "gpay")
        .when(h.contains("merchant") | h.contains("payee"), "phonepe")
        .when(h.contains("order") & h.contains("amazon"), "amazonpay")
        .when(h.contains("order"), "paytm")
        .when(h.contains("txn date") & h.contains("ref no"), "sbi")
        .otherwise("generic")
    )


def header_cells(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Header line of every file: its row, format and (stripped) cells."""
    # A file without a header row uses its first non-blank line.
    candidates = (
        lines.join(headers, "file")
        .filter((F.col("line_no") >= F.col("header_row")) & (F.trim("line") != ""))
    )
    first = first_per_key(candidates, ["file"], [F.col("line_no")])
    cells = F.transform(split_cells(F.col("line"), F.col("delimiter")), lambda s: F.trim(s))
    return first.select("file", "delimiter", F.col("line_no").alias("header_row"), cells.alias("cells")).withColumn(
        "format", detect_format(F.lower(F.array_join("cells", " ")))
    )


def map_columns(headers: DataFrame) -> DataFrame:
    """Position of every field per file: aliases of the format, else by substring."""
    rows = [(f, field, n, a.lower()) for f, fields in ALIASES.items() for field, names in fields.items() for n, a in enumerate(names)]
    aliases = headers.sparkSession.createDataFrame(rows, "format string, field string, alias_ord int, name string")
    cells = headers.select("file", "format", F.posexplode("cells").alias("pos", "cell")).withColumn("name", F.lower("cell"))
    exact = cells.join(aliases, ["format", "name"]).groupBy("file", "field").agg(F.min(F.struct("alias_ord", "pos"))["pos"].alias("pos"))
    mapped = _pivot(exact)
    has = lambda f: F.col(f).isNotNull()
    complete = has("date") & has("description") & (has("amount") | has("withdrawal") | has("deposit"))
    fuzzy = fuzzy_map(cells)
    chosen = headers.select("file").join(mapped, "file", "left").withColumn("_ok", F.coalesce(complete, F.lit(False)))
    other = fuzzy.select("file", *[F.col(f).alias(f"_f_{f}") for f in FIELDS])
    return chosen.join(other, "file", "left").select(
        "file", *[F.when(F.col("_ok"), F.col(f)).otherwise(F.col(f"_f_{f}")).alias(f) for f in FIELDS]
    )


def _pivot(found: DataFrame) -> DataFrame:
    return found.groupBy("file").agg(*[F.max(F.when(F.col("field") == f, F.col("pos"))).alias(f) for f in FIELDS])


def fuzzy_map(cells: DataFrame) -> DataFrame:
    """Substring rules: the first column wins, but the last one for amounts."""
    n, pos = F.col("name"), F.col("pos")
    has = lambda words: any_contains(n, words)
    money = has(["amount", "amt"])
    out = money & has(["withdraw", "debit", "dr"])
    into = money & ~out & has(["deposit", "credit", "cr"])
    rules = {
        "date": F.min(F.when(has(["date", "dt", "time"]), pos)),
        "description": F.min(F.when(has(["desc", "narr", "particular", "detail", "remark"]), pos)),
        "withdrawal": F.max(F.when(out, pos)),
        "deposit": F.max(F.when(into, pos)),
        "amount": F.max(F.when(money & ~out & ~into, pos)),
        "balance": F.min(F.when(has(["balance", "bal"]), pos)),
    }
    none = F.max(F.lit(None).cast("int"))
    return cells.groupBy("file").agg(*[rules.get(f, none).alias(f) for f in FIELDS])


def data_rows(lines: DataFrame, headers: DataFrame, columns: DataFrame) -> DataFrame:
    """Lines below the header with their cells and one text column per field.

    Lines with more cells than the header are skipped.
    """
    facts = headers.select("file", "delimiter", "header_row", "format", F.size("cells").alias("width")).join(
        columns.select("file", *[F.col(f).alias(f"_p_{f}") for f in FIELDS]), "file"
    )
    rows = (
        lines.join(facts, "file")
        .filter((F.col("line_no") > F.col("header_row")) & (F.trim("line") != ""))
        .withColumn("cells", split_cells(F.col("line"), F.col("delimiter")))
        .withColumn("cells", computed_once(F.col("cells")))
        .filter(F.size("cells") <= F.col("width"))
    )

    def cell(f: str) -> Column:
        value = F.try_element_at("cells", F.col(f"_p_{f}") + 1)
        return F.when(~value.isin(EMPTY_CELLS), value)

    return rows.select("file", "line_no", "line", "cells", "format", *[cell(f).alias(f) for f in FIELDS])


def fields_to_transaction(rows: DataFrame, as_of: dt.date, typed_words: bool = True) -> DataFrame:
    """Field texts to a transaction: shared by delimited files and sheets.

    Withdrawal beats deposit beats the amount column; a row without a date or
    with amount 0 is dropped.
    """
    c = F.col
    debit_words = ["DR", "D", "DEBIT", "-"] + (["WITHDRAWAL"] if typed_words else [])
    credit_words = ["CR", "C", "CREDIT", "+"] + (["DEPOSIT"] if typed_words else [])
    keep = [k for k in ("file", "sheet", "line_no", "row") if k in rows.columns]
    raw = F.substring(F.array_join(F.filter("cells", lambda s: ~s.isin(EMPTY_CELLS)), " | "), 1, 500) if "cells" in rows.columns else F.lit(None)
    # Cleaned texts first, as columns, so that later steps refer to them by name.
    texts = [
        x.clean_date(c("date"), as_of).alias("date"),
        x.clean_description(c("description")).alias("description"),
        F.abs(x.clean_amount(c("withdrawal"))).alias("_paid"),
        F.abs(x.clean_amount(c("deposit"))).alias("_got"),
        x.clean_amount(c("amount")).alias("_single"),
        x.clean_amount(c("balance")).alias("balance"),
        F.upper(x.strip(F.coalesce("type", "type_indicator"))).alias("_flag"),
        F.nullif(x.strip(c("reference")), F.lit("")).alias("_ref"),
        raw.cast("string").alias("raw_text"),
    ]
    made = rows.select(*keep, *texts)
    cleaned = made.select(*keep, computed_once(F.struct(*made.columns[len(keep):])).alias("_t")).select(*keep, "_t.*")
    paid, got, single = c("_paid"), c("_got"), c("_single")
    amount = F.when(paid > 0, paid).when(got > 0, got).otherwise(F.abs(single))
    direction = (
        F.when(paid > 0, "DEBIT")
        .when(got > 0, "CREDIT")
        .when(c("_flag").isin(debit_words), "DEBIT")
        .when(c("_flag").isin(credit_words), "CREDIT")
        .otherwise(x.transaction_type(c("description"), single))
    )
    return (
        cleaned.withColumn("amount", amount)
        .filter(c("date").isNotNull() & (c("amount") != 0))
        .select(
            *keep, "date", "description", "amount", direction.alias("transaction_type"), "balance",
            F.coalesce("_ref", x.extract_reference(c("description"))).alias("reference"),
            "raw_text", F.lit(1.0).alias("confidence"), x.description_class(c("description")).alias("category"),
        )
    )


HEAD_LINES = 20


def head_of_files(lines: DataFrame) -> DataFrame:
    """The first lines of every file and its first line with text, gathered by one shuffle.

    All facts about a file are derived from this; Spark reuses the exchange, so
    the files are read once for their facts and once for their rows.
    """
    line = F.struct("line_no", "line")
    head = lines.groupBy("file").agg(
        F.collect_list(F.when(F.col("line_no") < HEAD_LINES, line)).alias("h"), F.min(F.when(F.trim("line") != "", line)).alias("first")
    )
    return head.select("file", F.inline(F.array_distinct(F.array_compact(F.array_append("h", F.col("first"))))))


def parse_lines(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """All transactions of all delimited files.

    The headers are stored: the column maps and the rows all read them.
    """
    head = head_of_files(lines)
    headers = header_cells(head, find_headers(head, detect_delimiters(head)))
    headers = store.stage(headers, f"{checkpoint_dir(lines.sparkSession)}/headers-{uuid.uuid4().hex}")
    return fields_to_transaction(data_rows(lines, headers, map_columns(headers)), as_of)


def parse_with_config(lines: DataFrame, config: dict[str, str], as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """Parse with the caller's column names: (transactions, messages per file).

    The first line is the header. An unknown column is a warning; a missing
    date column is an error and the file gives no rows.
    """
    head = head_of_files(lines)
    headers = header_cells(head, detect_delimiters(head).withColumn("header_row", F.lit(0)))
    wanted = {f: config.get(f) for f in FIELDS}
    columns = headers.select(
        "file",
        *[
            (F.nullif(F.array_position("cells", F.lit(name)), F.lit(0)) - 1 if name else F.lit(None)).cast("int").alias(f)
            for f, name in wanted.items()
        ],
    )
    warnings = [
        F.when(F.col(f).isNull(), F.lit(f"Column '{name}' not found for field '{f}'")) for f, name in config.items()
    ]
    messages = columns.select(
        "file",
        F.array_compact(F.array(*warnings)).alias("warnings"),
        F.array_compact(F.array(F.when(F.col("date").isNull(), F.lit("Date column mapping is required")))).alias("errors"),
    )
    usable = columns.filter(F.col("date").isNotNull())
    return fields_to_transaction(data_rows(lines, headers, usable), as_of), messages


def bank_of_files(lines: DataFrame) -> DataFrame:
    """Bank or app named anywhere in the file; the first of the ordered names wins."""
    up = F.upper("line")
    ranked = case_of([(up.contains(word), F.lit(n)) for n, (word, _) in enumerate(CONTENT_BANKS)])
    names = F.array(*[F.lit(bank) for _, bank in CONTENT_BANKS])
    return lines.groupBy("file").agg(F.min(ranked).alias("k")).select("file", F.try_element_at(names, F.col("k") + 1).alias("bank"))


def statement_totals(parsed: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Credits, debits and counts per file."""
    sums = parsed.groupBy("file").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum(F.when(F.col("transaction_type") == "CREDIT", F.col("amount").cast("decimal(18,2)")).otherwise(0)).alias("total_credits"),
        F.sum(F.when(F.col("transaction_type") == "DEBIT", F.col("amount").cast("decimal(18,2)")).otherwise(0)).alias("total_debits"),
    )
    if messages is None:
        return sums.withColumn("error_count", F.lit(0)).withColumn("warning_count", F.lit(0))
    counts = messages.select("file", F.size("errors").alias("error_count"), F.size("warnings").alias("warning_count"))
    return counts.join(sums, "file", "left")


def post_process(parsed: DataFrame) -> DataFrame:
    """Fill missing categories; rows sorted by date.

    A sort reads its input twice, once for the bounds of its parts: the rows are stored before it.
    """
    category = F.coalesce("category", x.description_class(F.col("description")))
    stored = store.stage(parsed.withColumn("category", category), f"{checkpoint_dir(parsed.sparkSession)}/parsed-{uuid.uuid4().hex}")
    return stored.orderBy("file", "date", "line_no")


def to_stored(parsed: DataFrame, user_id: Column, batch: Column, source: Column) -> DataFrame:
    """Parsed rows in the shape of the transactions table; unknown direction is a debit."""
    kind = F.when(F.col("transaction_type") == "CREDIT", "CREDIT").otherwise("DEBIT")
    raw = F.to_json(F.struct("date", "description", "amount", "transaction_type", "balance", "reference", "confidence", "category"))
    return parsed.select(
        F.xxhash64("file", "line_no").alias("txn_id"),
        user_id.alias("user_id"),
        F.col("amount").cast("decimal(15,2)").alias("amount"),
        kind.alias("transaction_type"),
        F.lit(None).cast("int").alias("category_id"),
        F.lit(None).cast("string").alias("merchant_name"),
        "description",
        F.col("date").cast("timestamp").alias("transaction_date"),
        source.alias("source"),
        batch.alias("upload_batch_id"),
        raw.alias("raw_data"),
        F.lit(False).alias("is_deleted"),
    )
