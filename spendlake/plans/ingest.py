"""Statement files, sheets, messages, duplicates, stored-table changes."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions import fixed_values as v
from spendlake.functions import quality as q
from spendlake.functions import text as x
from spendlake.operators import dedup
from spendlake.plans.categorize import AUTO_COLUMNS, auto_categorized, auto_sql
from spendlake.plans.registry import Inputs, query
from spendlake.plans.text import KEY_SQL, first_of, lit
from spendlake.session import checkpoint_dir
from spendlake.sources import delimited as dl
from spendlake.sources import files as fl
from spendlake.sources import layouts as ly
from spendlake.sources import messages as msg
from spendlake.sources import store

AS_OF = dt.date(2001, 12, 31)
NOW = dt.datetime(2002, 1, 1)


def scratch(i: Inputs, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(i.spark)}/{name}-{uuid.uuid4().hex}"


# --- delimited files -------------------------------------------------------------------------

COUNTS = "length(line) - length(replace(line, {d}, ''))"
DELIMS = [("','", 0), ("';'", 1), ("chr(9)", 2), ("'|'", 3)]
DELIMITER = f"""
SELECT f.file, coalesce(first(d ORDER BY av DESC, o) FILTER (WHERE av > 0 AND vr < 2), ',') AS delimiter FROM (SELECT DISTINCT file FROM csv_lines) f LEFT JOIN (
 SELECT file, d, o, avg(c) AS av, var_pop(c) AS vr FROM (
 {" UNION ALL ".join(f"SELECT file, {d} AS d, {o} AS o, {COUNTS.format(d=d)} AS c FROM csv_lines WHERE line_no < 10 AND trim(line) <> ''" for d, o in DELIMS)}) GROUP BY 1, 2, 3) s ON s.file = f.file GROUP BY f.file
"""


@query("S2_delimiter", "file string, delimiter string", DELIMITER)
def _(i: Inputs):
    return dl.detect_delimiters(i.csv_lines)


WORDS = " + ".join(f"CAST(contains(lower(line), '{w}') AS INT)" for w in dl.HEADER_WORDS)
HEADER = f"""
SELECT l.file, coalesce(min(line_no) FILTER (WHERE {WORDS} >= 2 AND length(line) - length(replace(line, delimiter, '')) + 1 >= 3), 0) AS header_row
FROM csv_lines l JOIN ({DELIMITER}) d ON d.file = l.file WHERE line_no < 20 GROUP BY l.file
"""


def _headers(i: Inputs):
    lines = i.csv_lines
    return dl.header_cells(lines, dl.find_headers(lines, dl.detect_delimiters(lines)))


@query("S3_header_row", "file string, header_row bigint", HEADER)
def _(i: Inputs):
    return dl.find_headers(i.csv_lines, dl.detect_delimiters(i.csv_lines))


FORMAT = f"""
SELECT l.file, CASE WHEN h LIKE '%narration%' AND (h LIKE '%withdrawal%' OR h LIKE '%deposit%') THEN 'hdfc' WHEN h LIKE '%transaction remarks%' THEN 'icici'
 WHEN h LIKE '%particulars%' AND h LIKE '%tran date%' THEN 'axis' WHEN h LIKE '%dr / cr%' OR h LIKE '%dr/cr%' THEN 'kotak'
 WHEN (h LIKE '%merchant%' OR h LIKE '%payee%') AND h LIKE '%upi%' THEN 'gpay' WHEN h LIKE '%merchant%' OR h LIKE '%payee%' THEN 'phonepe'
 WHEN h LIKE '%order%' AND h LIKE '%amazon%' THEN 'amazonpay' WHEN h LIKE '%order%' THEN 'paytm' WHEN h LIKE '%txn date%' AND h LIKE '%ref no%' THEN 'sbi' ELSE 'generic' END AS format,
 cells, delimiter
FROM (SELECT l.file, delimiter, string_split(line, delimiter) AS cells, lower(replace(line, delimiter, ' ')) AS h FROM csv_lines l JOIN ({HEADER}) k ON k.file = l.file AND k.header_row = l.line_no JOIN ({DELIMITER}) d ON d.file = l.file) l
"""


@query("S4_source_format", "file string, format string", f"SELECT file, format FROM ({FORMAT})")
def _(i: Inputs):
    return _headers(i)


ALIAS_ROWS = ", ".join(
    f"({lit(f)}, {lit(field)}, {n}, {lit(a.lower())})" for f, fields in dl.ALIASES.items() for field, names in fields.items() for n, a in enumerate(names))
CELLS = f"SELECT file, format, unnest(cells) AS cell, generate_subscripts(cells, 1) - 1 AS pos FROM ({FORMAT})"
EXACT = f"""
SELECT file, {", ".join(f"max(pos) FILTER (WHERE field = '{f}') AS {f}" for f in dl.FIELDS)} FROM (
 SELECT file, field, first(pos ORDER BY o) AS pos FROM ({CELLS}) c JOIN (VALUES {ALIAS_ROWS}) a(fmt, field, o, name) ON fmt = format AND name = lower(cell) GROUP BY 1, 2) GROUP BY 1
"""
MAPPED = f"""
SELECT f.file, {", ".join(f"CASE WHEN e.date IS NOT NULL AND e.description IS NOT NULL AND coalesce(e.amount, e.withdrawal, e.deposit) IS NOT NULL THEN e.{f} ELSE z.{f} END AS {f}" for f in dl.FIELDS)}
FROM (SELECT DISTINCT file FROM csv_lines) f LEFT JOIN ({EXACT}) e ON e.file = f.file LEFT JOIN (
 SELECT file, min(pos) FILTER (WHERE n LIKE '%date%' OR n LIKE '%dt%' OR n LIKE '%time%') AS date,
 min(pos) FILTER (WHERE regexp_matches(n, 'desc|narr|particular|detail|remark')) AS description,
 max(pos) FILTER (WHERE regexp_matches(n, 'amount|amt') AND NOT regexp_matches(n, 'withdraw|debit|dr|deposit|credit|cr')) AS amount,
 max(pos) FILTER (WHERE regexp_matches(n, 'amount|amt') AND regexp_matches(n, 'withdraw|debit|dr')) AS withdrawal,
 max(pos) FILTER (WHERE regexp_matches(n, 'amount|amt') AND NOT regexp_matches(n, 'withdraw|debit|dr') AND regexp_matches(n, 'deposit|credit|cr')) AS deposit,
 min(pos) FILTER (WHERE n LIKE '%bal%') AS balance, NULL AS type, NULL AS type_indicator, NULL AS reference
 FROM (SELECT file, lower(cell) AS n, pos FROM ({CELLS})) GROUP BY 1) z ON z.file = f.file
"""
MAP_COLUMNS = "file string, " + ", ".join(f"{f} bigint" for f in dl.FIELDS)


@query("S5_column_map", MAP_COLUMNS, MAPPED)
def _(i: Inputs):
    return dl.map_columns(_headers(i))


@query("S6_fuzzy_column_map", "file string, date bigint, description bigint, amount bigint, withdrawal bigint, deposit bigint, balance bigint",
       MAPPED.replace("e.date IS NOT NULL AND", "FALSE AND"))
def _(i: Inputs):
    cells = _headers(i).select("file", F.posexplode("cells").alias("pos", "cell")).withColumn("name", F.lower("cell"))
    return dl.fuzzy_map(cells)


# What the generated files hold, written out directly.
EXPECTED = """
SELECT concat('file', CAST(f AS VARCHAR)) AS file, 3 + k % 100 AS line_no, make_date(2000, CAST(1 + k % 6 AS INT), CAST(1 + k % 28 AS INT)) AS date,
 CASE k % 3 WHEN 0 THEN 'REFUND FROM AMAZON' WHEN 1 THEN 'NEFT-N' || CAST(k AS VARCHAR) || ' RENT' ELSE 'ATM WDL' END AS description,
 CAST(m AS DOUBLE) AS amount, CASE WHEN k % 3 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type, CASE WHEN f % 6 = 4 THEN NULL ELSE 5000 END AS balance,
 CASE WHEN f % 6 = 4 AND k % 5 <> 0 THEN 'UTR' || CAST(k AS VARCHAR) WHEN k % 3 = 1 THEN 'N' || CAST(k AS VARCHAR) WHEN k % 3 = 0 THEN 'UND' END AS reference,
 CASE k % 3 WHEN 0 THEN 'Shopping' WHEN 1 THEN 'Transfer' ELSE 'ATM' END AS category
FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f, CAST(o_totalprice AS DECIMAL(15,2)) AS m FROM orders) WHERE k % 50 <> 7
"""
PARSED_COLUMNS = """file string, line_no bigint, date string, description string, amount double, transaction_type string, balance double,
 reference string, category string"""


@query("S7_rows_to_transactions", PARSED_COLUMNS, EXPECTED)
def _(i: Inputs):
    return dl.parse_lines(i.csv_lines, AS_OF)


CONFIG = {"date": "Date", "description": "Details", "amount": "Value", "balance": "Left"}


# For each layout of the generated files: the names a caller gives its columns, and the fields they are.
LAYOUTS = [
    ("Date,Details,Value,Kind,Left", CONFIG | {"type": "Kind"}),
    ("Day;What;Out;In;Rest", {"date": "Day", "description": "What", "withdrawal": "Out", "deposit": "In", "balance": "Rest"}),
    ("Date\tDetails\tValue\tSign\tLeft", CONFIG | {"type_indicator": "Sign"}),
    ("On|Text|Minus|Plus|Rest", {"date": "On", "description": "Text", "withdrawal": "Minus", "deposit": "Plus", "balance": "Rest"}),
    ("Date,To,Value,Kind,Code", {"date": "Date", "description": "To", "amount": "Value", "type": "Kind", "reference": "Code"}),
    ("On,Text,Minus,Plus,Rest", {"date": "On", "description": "Text", "withdrawal": "Minus", "deposit": "Plus", "balance": "Rest"}),
]


def _by_caller(i: Inputs):
    """Every file of every layout, each layout under a mapping of its own."""
    lines = i.csv_lines.withColumn("f", F.substring("file", 5, 20).cast("long") % len(LAYOUTS)).filter("line_no >= 2")
    parts = []
    for n, (names, config) in enumerate(LAYOUTS):
        header = F.when(F.col("line_no") == 2, F.lit(names)).otherwise(F.col("line"))
        moved = lines.filter(F.col("f") == n).select("file", (F.col("line_no") - 2).alias("line_no"), header.alias("line"))
        parts.append(dl.parse_with_config(moved, config, AS_OF)[0])
    return reduce(DataFrame.unionByName, parts)


query("S8_caller_mapping", "file string, line_no bigint, date string, amount double, transaction_type string", f"SELECT * REPLACE (line_no - 2 AS line_no) FROM ({EXPECTED})")(_by_caller)
query("S8_caller_mapping_layouts", PARSED_COLUMNS, f"SELECT * REPLACE (line_no - 2 AS line_no) FROM ({EXPECTED})")(_by_caller)


@query("S8_mapping_messages", "file string, warnings string, errors string", """
SELECT DISTINCT file, 'Column ''When'' not found for field ''date''' AS warnings, 'Date column mapping is required' AS errors FROM csv_lines
""")
def _(i: Inputs):
    _rows, messages = dl.parse_with_config(i.csv_lines, {"date": "When"}, AS_OF)
    return messages.select("file", F.array_join("warnings", "; ").alias("warnings"), F.array_join("errors", "; ").alias("errors"))


@query("S9_content_bank", "file string, bank string", "SELECT f.file, first(bank ORDER BY o) AS bank FROM (SELECT DISTINCT file FROM csv_lines) f LEFT JOIN (SELECT file, bank, o FROM csv_lines JOIN (VALUES "
       + ", ".join(f"({n}, {lit(w)}, {lit(b)})" for n, (w, b) in enumerate(dl.CONTENT_BANKS)) + ") v(o, w, bank) ON contains(upper(line), w)) b ON b.file = f.file GROUP BY 1")
def _(i: Inputs):
    return dl.bank_of_files(i.csv_lines)


@query("S38_post_process", PARSED_COLUMNS, EXPECTED)
def _(i: Inputs):
    return dl.post_process(dl.parse_lines(i.csv_lines, AS_OF).withColumn("category", F.when(F.col("line_no") % 2 == 0, F.col("category"))))


@query("A27_statement_totals", "file string, transaction_count bigint, total_credits double, total_debits double", f"""
SELECT file, count(*) AS transaction_count, sum(CASE WHEN transaction_type = 'CREDIT' THEN CAST(amount AS DECIMAL(18,2)) ELSE 0 END) AS total_credits,
 sum(CASE WHEN transaction_type = 'DEBIT' THEN CAST(amount AS DECIMAL(18,2)) ELSE 0 END) AS total_debits FROM ({EXPECTED}) GROUP BY 1
""")
def _(i: Inputs):
    return dl.statement_totals(dl.parse_lines(i.csv_lines, AS_OF))


@query("U1_merged_results", "source string, n bigint, amount double", f"""
SELECT 'csv' AS source, count(*) AS n, sum(CAST(amount AS DECIMAL(18,2))) AS amount FROM ({EXPECTED})
UNION ALL SELECT 'sheet', count(*), sum(CAST(o_totalprice AS DECIMAL(15,2))) FROM orders
""")
def _(i: Inputs):
    both = dl.parse_lines(i.csv_lines, AS_OF).withColumn("source", F.lit("csv")).unionByName(
        ly.parse_sheets(i.sheet_cells, AS_OF).withColumn("source", F.lit("sheet")), allowMissingColumns=True
    )
    return both.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount"))


# --- whole files ---------------------------------------------------------------------------------


def _write_files(i: Inputs, lines, suffix: str = ".csv") -> str:
    """One folder per file name, so that Spark's own text sink writes the files.

    Tasks move their files themselves; by default the driver moves all of them, one by one.
    """
    path = scratch(i, "files")
    lines.withColumn("name", F.col("file")).repartition("name").sortWithinPartitions("name", "line_no").select("name", "line").write.option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("name").text(path)
    return path


@query("S1_bulk_file_load", "file string, n bigint, chars bigint", "SELECT file, count(*) AS n, sum(length(line)) AS chars FROM csv_lines GROUP BY 1")
def _(i: Inputs):
    path = _write_files(i, i.csv_lines)
    lines = fl.to_lines(fl.read_files(i.spark, path, "*.txt"))
    name = F.regexp_extract("file", "name=([^/]*)", 1)
    # The text sink ends every line with a line feed, which leaves one empty line.
    return lines.withColumn("name", name).groupBy("name").agg((F.count("*") - 1).alias("n"), F.sum(F.length("line")).alias("chars")).withColumnRenamed("name", "file")


@query("S26_directory_ingest", "file string, transaction_count bigint, total_debits double", f"""
SELECT file, count(*) AS transaction_count, sum(CASE WHEN transaction_type = 'DEBIT' THEN CAST(amount AS DECIMAL(18,2)) ELSE 0 END) AS total_debits FROM ({EXPECTED}) GROUP BY 1
""")
def _(i: Inputs):
    path = _write_files(i, i.csv_lines)
    lines = fl.to_lines(fl.read_files(i.spark, path, "*.txt")).withColumn("file", F.regexp_extract("file", "name=([^/]*)", 1))
    return dl.statement_totals(dl.parse_lines(lines, AS_OF))


def _page_files(i: Inputs):
    """Pages as raw files, with several encodings, first bytes and extensions."""
    body = F.expr("""CASE CAST(page_id % 6 AS INT) WHEN 0 THEN concat(X'EFBBBF', encode(html, 'UTF-8')) WHEN 1 THEN concat(X'FFFE', encode(html, 'UTF-16LE'))
      WHEN 2 THEN concat(X'255044462D', encode(html, 'UTF-8')) WHEN 3 THEN concat(X'504B0304', encode('xl/ data', 'UTF-8'))
      WHEN 4 THEN encode(concat('a,b,c', chr(10), '1,2,3', chr(10), '4,5,6'), 'UTF-8') ELSE CAST('' AS BINARY) END""")
    name = F.expr("""concat('/data/p', CAST(page_id AS STRING), CASE CAST(page_id % 7 AS INT) WHEN 0 THEN '.csv' WHEN 1 THEN '.pdf' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.exe' WHEN 4 THEN '.txt' ELSE '' END)""")
    return i.table("pages").select("page_id", name.alias("path"), body.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


ENC = "CASE page_id % 6 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-16LE' ELSE 'UTF-8' END"
# The first 2000 bytes of a marked page, as far as they are ASCII; UTF-16 holds half as many characters and no blank line.
HEAD = """CASE page_id % 6 WHEN 1 THEN left(html, 999) ELSE
 list_aggregate(list_transform(regexp_extract_all(left(hex(encode(html)), 3994), '..'), lambda h: CASE WHEN h < '80' THEN chr(CAST('0x' || h AS INT)) ELSE '' END), 'string_agg', '') END"""
DELIMITED = "(" + " OR ".join(
    f"(len(cut) > 0 AND list_min(list_transform(cut, lambda s: length(s) - length(replace(s, {d}, '')))) >= 2 AND "
    f"list_min(list_transform(cut, lambda s: length(s) - length(replace(s, {d}, '')))) = list_max(list_transform(cut, lambda s: length(s) - length(replace(s, {d}, '')))))"
    for d in ("','", "';'", "chr(9)", "'|'")) + ")"
CUT = f"SELECT *, list_filter(string_split({HEAD}, chr(10))[1:5], lambda s: page_id % 6 = 1 OR trim(s, ' ') <> '') AS cut FROM pages"
TYPE = f"""CASE WHEN page_id % 6 = 2 THEN 'pdf' WHEN page_id % 6 = 3 THEN 'excel' WHEN page_id % 7 IN (0, 4) THEN 'csv' WHEN page_id % 7 = 1 THEN 'pdf' WHEN page_id % 7 = 2 THEN 'excel'
 WHEN page_id % 6 = 4 OR page_id % 6 < 2 AND {DELIMITED} THEN 'csv' END"""


@query("S10_encoding", "page_id bigint, encoding string, text string", f"""
SELECT page_id, {ENC} AS encoding, CASE CAST(page_id % 6 AS INT) WHEN 0 THEN html WHEN 1 THEN html WHEN 2 THEN '%PDF-' || html WHEN 3 THEN 'PK' || chr(3) || chr(4) || 'xl/ data'
 WHEN 4 THEN 'a,b,c' || chr(10) || '1,2,3' || chr(10) || '4,5,6' ELSE '' END AS text FROM pages
""")
def _(i: Inputs):
    return _page_files(i).select("page_id", fl.encoding_of(F.col("content")).alias("encoding"), fl.decode_text(F.col("content")).alias("text"))


@query("S23_file_type", "page_id bigint, file_type string", f"SELECT page_id, {TYPE} AS file_type FROM ({CUT})")
def _(i: Inputs):
    return _page_files(i).withColumn("file_type", fl.file_type(F.col("path"), F.col("content")))


EXT = "CASE CAST(page_id % 7 AS INT) WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'exe' WHEN 4 THEN 'txt' ELSE '' END"
SIZE = "CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 3 + strlen(html) WHEN 1 THEN 2 + 2 * length(html) WHEN 2 THEN 5 + strlen(html) WHEN 3 THEN 12 WHEN 4 THEN 17 ELSE 0 END"
VALIDATION = f"""
SELECT path, size AS length, kind AS file_type, coalesce(issue, '') AS issues, issue IS NULL AS is_valid FROM (SELECT *,
 CASE WHEN size = 0 THEN 'File is empty' WHEN kind IS NULL THEN 'Unsupported file format'
  WHEN kind = 'pdf' AND NOT (page_id % 6 = 2 AND e = 'pdf') OR kind = 'excel' AND e <> 'xlsx' OR kind = 'csv' AND e NOT IN ('csv', 'txt') THEN 'File appears to be corrupted or malformed' END AS issue
 FROM (SELECT *, CASE WHEN size > 0 THEN {TYPE} END AS kind, '/data/p' || CAST(page_id AS VARCHAR) || CASE WHEN e = '' THEN '' ELSE '.' || e END AS path
  FROM (SELECT *, {EXT} AS e, {SIZE} AS size FROM ({CUT}))))
"""


@query("S24_file_validation", "path string, length bigint, file_type string, issues string, is_valid boolean", VALIDATION)
def _(i: Inputs):
    return fl.validate_files(_page_files(i)).withColumn("issues", F.array_join("issues", "; "))


@query("S25_upload_validation", "path string, content_type string, errors string, is_valid boolean")
def _(i: Inputs):
    return fl.validate_uploads(_page_files(i)).withColumn("errors", F.array_join("errors", "; "))


# --- statement text --------------------------------------------------------------------------------


def num(g: str) -> str:
    return f"TRY_CAST(replace(nullif({g}, ''), ',', '') AS DOUBLE)"


DAY = "CAST(coalesce(try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%d %b %Y'), try_strptime(day, '%d-%b-%Y')) AS DATE)"


def layout_sql(pattern: str, n: int, fields: str, extra: str = "TRUE", confidence: float = 1.0) -> str:
    """Rows one pattern gives: fields name day, description, debit, credit, balance from g1..gn."""
    groups = ", ".join(f"regexp_extract(s, {lit(pattern)}, {k}) AS g{k}" for k in range(1, n + 1))
    return f"""SELECT file, line_no, {DAY} AS date, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS description,
 CASE WHEN debit > 0 THEN debit WHEN credit > 0 THEN credit END AS amount, CASE WHEN debit > 0 THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type, balance,
 {first_of('rf', v.REFERENCE_PATTERNS)} AS reference, CAST({confidence} AS DOUBLE) AS confidence
FROM (SELECT file, line_no, {fields} FROM (SELECT file, line_no, s, {groups} FROM (SELECT file, line_no, trim(line) AS s FROM text_lines) WHERE regexp_matches(s, {lit(pattern)})) WHERE {extra})
WHERE (debit > 0 OR credit > 0) AND {DAY} IS NOT NULL"""


def first_pattern(*sqls: str) -> str:
    parts = "\nUNION ALL ".join(f"SELECT *, {k} AS o FROM ({s})" for k, s in enumerate(sqls))
    return f"SELECT * EXCLUDE (o, rn) FROM (SELECT *, row_number() OVER (PARTITION BY file, line_no ORDER BY o) AS rn FROM ({parts})) WHERE rn = 1"


def two_columns(day: int, desc: int, a: int, source: str = "s") -> str:
    return f"g{day} AS day, g{desc} AS description, {num(f'g{a}')} AS debit, {num(f'g{a + 1}')} AS credit, {num(f'g{a + 2}')} AS balance, {source} AS rf"


def marked(source: str) -> str:
    return f"g1 AS day, g2 AS description, CASE WHEN upper(g4) = 'DR' THEN {num('g3')} END AS debit, CASE WHEN upper(g4) <> 'DR' THEN {num('g3')} END AS credit, {num('g5')} AS balance, {source} AS rf"


GENERIC_FIELDS = f"""g1 AS day, g2 AS description, CASE WHEN upper(g4) IN ('CR', 'C') THEN NULL ELSE {num('g3')} END AS debit,
 CASE WHEN upper(g4) IN ('CR', 'C') THEN {num('g3')} WHEN upper(g4) IN ('DR', 'D') THEN NULL ELSE {num('g4')} END AS credit, {num('g5')} AS balance, s AS rf"""
GENERIC_OK = "length(s) >= 10 AND NOT regexp_matches(upper(s), 'DATE|DESCRIPTION|BALANCE|NARRATION|PARTICULARS') AND length(trim(g2)) >= 3"
LAYOUT_SQL = {
    "hdfc": first_pattern(
        layout_sql(ly.HDFC[0], 6, two_columns(1, 2, 4)),
        layout_sql(ly.HDFC[1], 4, f"g1 AS day, g2 AS description, CASE WHEN contains(upper(s), 'DR') THEN {num('g3')} END AS debit, CASE WHEN NOT contains(upper(s), 'DR') THEN {num('g3')} END AS credit, {num('g4')} AS balance, s AS rf")),
    "sbi": first_pattern(layout_sql(ly.SBI[0], 6, two_columns(1, 2, 4)), layout_sql(ly.SBI[1], 5, marked("s"))),
    "icici": layout_sql(ly.ICICI[0], 6, two_columns(2, 3, 4, "g3"), "NOT starts_with(s, 'S No')"),
    "axis": layout_sql(ly.AXIS[0], 6, two_columns(1, 3, 4)),
    "kotak": layout_sql(ly.KOTAK[0], 5, marked("g2")),
    "generic": first_pattern(*[layout_sql(p, 5, GENERIC_FIELDS, GENERIC_OK, 0.7) for p in ly.GENERIC]),
}
LAYOUT_COLUMNS = "file string, line_no bigint, date string, description string, amount double, transaction_type string, balance double, reference string, confidence double"


def _layout(name: str):
    def plan(i: Inputs):
        return ly.parse_layout(i.text_lines, name, AS_OF)

    return plan


for _id, _name in (("S14", "hdfc"), ("S15", "sbi"), ("S16", "icici"), ("S17", "axis"), ("S18", "kotak"), ("S19", "generic")):
    query(f"{_id}_{_name}_layout", LAYOUT_COLUMNS, LAYOUT_SQL[_name])(_layout(_name))


def named_sql(names: list[tuple[str, str]], alias: str) -> str:
    cases = "CASE " + " ".join(f"WHEN regexp_matches(upper(line), {lit('(?i)' + p)}) THEN {n}" for n, (_, p) in enumerate(names)) + " END"
    labels = "[" + ", ".join(lit(n) for n, _ in names) + "]"
    return f"SELECT file, ({labels})[min({cases}) + 1] AS {alias} FROM text_lines GROUP BY file"


BANK_SQL = named_sql(ly.BANKS, "bank")
ROUTED = f"""
WITH b AS ({BANK_SQL}), l AS (SELECT file, bank, CASE bank {" ".join(f"WHEN '{b}' THEN '{n}'" for b, n in ly.LAYOUT_OF_BANK.items())} ELSE 'generic' END AS layout FROM b),
 own AS ({" UNION ALL ".join(f"SELECT r.*, l.bank FROM ({s}) r JOIN l ON l.file = r.file AND l.layout = '{n}'" for n, s in LAYOUT_SQL.items() if n != "generic")}),
 other AS (SELECT r.*, l.bank FROM ({LAYOUT_SQL["generic"]}) r JOIN l ON l.file = r.file WHERE r.file NOT IN (SELECT file FROM own))
SELECT * FROM own UNION ALL SELECT * FROM other
"""


@query("S20_routed_statements", LAYOUT_COLUMNS + ", bank string", ROUTED)
def _(i: Inputs):
    return ly.parse_statements(i.text_lines, AS_OF)


@query("S21_banks_and_apps", "file string, bank string, app string",
       f"SELECT b.file, bank, app FROM ({BANK_SQL}) b JOIN ({named_sql(ly.UPI_APPS, 'app')}) a ON a.file = b.file")
def _(i: Inputs):
    return ly.detect_banks(i.text_lines).join(ly.detect_upi_apps(i.text_lines), "file")


@query("S22_statement_facts", "file string, account_number_masked string, statement_period string, account_holder string, opening_balance double, closing_balance double", """
SELECT CAST(o_orderkey AS VARCHAR) AS file, 'XXXX-XXXX-' || right(CAST(50100000000 + o_orderkey AS VARCHAR), 4) AS account_number_masked,
 CASE WHEN o_orderkey % 3 < 2 THEN '2000-01-' || lpad(CAST(1 + o_orderkey % 20 AS VARCHAR), 2, '0') || ' to 2000-02-25' END AS statement_period,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'A K RAO.' END AS account_holder, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS opening_balance,
 CASE WHEN o_orderkey % 5 = 0 THEN 12345.5 END AS closing_balance FROM orders
""")
def _(i: Inputs):
    text = F.expr("""concat_ws(chr(10), 'HDFC BANK', concat('A/C NO: ', CAST(50100000000 + o_orderkey AS STRING)),
      CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN concat('STATEMENT PERIOD: ', lpad(CAST(1 + o_orderkey % 20 AS STRING), 2, '0'), '-Jan-2000 TO 25-Feb-2000')
        WHEN 1 THEN concat('FROM ', lpad(CAST(1 + o_orderkey % 20 AS STRING), 2, '0'), '/01/2000 TO 25/02/2000') ELSE 'no dates' END,
      CASE WHEN o_orderkey % 4 <> 0 THEN 'NAME: A K RAO.' END, '1',
      concat('OPENING BALANCE: ', CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING)), CASE WHEN o_orderkey % 5 = 0 THEN 'BALANCE C/F 12,345.50' END)""")
    texts = i.table("orders").select(F.col("o_orderkey").cast("string").alias("file"), text.alias("text"))
    return ly.statement_facts(texts, AS_OF)


# --- sheets ------------------------------------------------------------------------------------------


@query("S11_sheet_columns", "file string, header_row bigint, field string, col bigint", """
SELECT DISTINCT file, 3 AS header_row, field, col FROM sheet_cells JOIN (VALUES ('Txn Date', 'date'), ('Narration', 'description'), ('Withdrawal Amt', 'withdrawal'), ('Deposit Amt', 'deposit'), ('Amount', 'amount'),
 ('Cr/Dr', 'withdrawal')) v(value_, field) ON value = value_ WHERE row = 3
""")
def _(i: Inputs):
    return ly.sheet_columns(i.sheet_cells)


@query("S12_sheet_rows", "file string, row bigint, date string, description string, amount double, transaction_type string", """
SELECT 'book' || CAST(f AS VARCHAR) AS file, 4 + k % 100 AS row, make_date(2000, CAST(1 + k % 12 AS INT), CAST(1 + k % 28 AS INT)) AS date, 'POS shop ' || CAST(k AS VARCHAR) AS description,
 CAST(m AS DOUBLE) AS amount, CASE WHEN f % 2 = 0 AND k % 3 <> 0 THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type
FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 100.0) AS BIGINT) AS f, CAST(o_totalprice AS DECIMAL(15,2)) AS m FROM orders)
""")
def _(i: Inputs):
    return ly.parse_sheets(i.sheet_cells, AS_OF)


@query("S13_sheet_bank", "file string, bank string", """
SELECT DISTINCT file, CASE WHEN contains(upper(value), 'HDFC BANK') THEN 'HDFC' ELSE 'SBI' END AS bank FROM sheet_cells WHERE row = 1 AND (contains(upper(value), 'HDFC BANK') OR contains(upper(value), 'SBI'))
""")
def _(i: Inputs):
    return ly.sheet_banks(i.sheet_cells)


# --- messages ------------------------------------------------------------------------------------------


@query("D10_messages", """message_id bigint, amount double, merchant string, bank string, app string, day string, transaction_type string, balance double, is_manual boolean""", """
SELECT k AS message_id, CASE WHEN k % 4 = 2 THEN 500 + k % 100 ELSE m END AS amount, CASE k % 4 WHEN 0 THEN 'SWIGGY' WHEN 1 THEN 'Amazon Pay' WHEN 2 THEN 'petrol' ELSE 'Blue Tokai' END AS merchant,
 CASE k % 4 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'SBI' END AS bank, CASE WHEN k % 4 = 3 THEN 'phonepe' END AS app, CASE WHEN k % 4 < 2 THEN make_date(2000, CAST(1 + k % 6 AS INT), CAST(1 + k % 28 AS INT)) END AS day,
 CASE k % 4 WHEN 1 THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type, CASE WHEN k % 4 = 0 THEN 5000.5 END AS balance, k % 4 = 2 AS is_manual
FROM (SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(15,2)) AS m FROM orders)
""")
def _(i: Inputs):
    body = F.expr("""CASE CAST(o_orderkey % 4 AS INT)
      WHEN 0 THEN concat('Rs.', m, ' debited from HDFC Bank A/c XX12 on ', d, ' to SWIGGY. Avl Bal Rs.5,000.50')
      WHEN 1 THEN concat('INR ', m, ' credited to your SBI A/c on ', d, ' from Amazon Pay via UPI')
      WHEN 2 THEN concat('₹', CAST(500 + o_orderkey % 100 AS STRING), ' petrol') ELSE concat('PhonePe: You paid ₹', m, ' at Blue Tokai') END""")
    rows = i.table("orders").select(
        "o_orderkey", F.expr("CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING)").alias("m"),
        F.expr("concat(lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0'), '-', lpad(CAST(1 + o_orderkey % 6 AS STRING), 2, '0'), '-00')").alias("d"),
    )
    return msg.parse_messages(rows.select(F.col("o_orderkey").alias("message_id"), body.alias("body")), AS_OF)


# --- duplicates ---------------------------------------------------------------------------------------


@query("W4_first_by_content_key", "txn_id bigint, key string",
       f"SELECT min(txn_id) AS txn_id, {KEY_SQL} AS key FROM exact_copies GROUP BY user_id, {KEY_SQL}")
def _(i: Inputs):
    return dedup.first_occurrences(i.exact_copies, [F.col("txn_id")], ["user_id"])


PAIRS = """
SELECT b.txn_id, min(a.txn_id) AS duplicate_of FROM near_copies a JOIN near_copies b ON a.user_id = b.user_id AND a.transaction_type = b.transaction_type
 AND CAST(a.transaction_date AS DATE) = CAST(b.transaction_date AS DATE) AND a.txn_id < b.txn_id AND abs(a.amount - b.amount) <= 0.01
WHERE 1 - CAST(levenshtein(lower(a.description), lower(b.description)) AS DOUBLE) / greatest(length(a.description), length(b.description)) > 0.8 GROUP BY b.txn_id
"""


@query("J15_near_duplicates", "txn_id bigint, duplicate_of bigint", PAIRS)
def _(i: Inputs):
    return dedup.near_duplicates(i.near_copies)


@query("J15_near_duplicates_ratio", "txn_id bigint, duplicate_of bigint")
def _(i: Inputs):
    return dedup.near_duplicates(i.near_copies, method="ratio")


@query("W5_greedy_removal", "txn_id bigint, is_kept boolean")
def _(i: Inputs):
    return dedup.remove_duplicates(i.near_copies)


# One row of each day after the other, with the list of the rows kept so far.
GREEDY = """
WITH RECURSIVE r AS (
 SELECT txn_id, user_id, transaction_type AS k, CAST(transaction_date AS DATE) AS d, amount AS a, lower(description) AS t,
  row_number() OVER (PARTITION BY user_id, transaction_type, CAST(transaction_date AS DATE) ORDER BY txn_id) AS n FROM near_copies
), g AS (
 SELECT user_id, k, d, n, txn_id, true AS is_kept, [{'a': a, 't': t}] AS kept FROM r WHERE n = 1
 UNION ALL
 SELECT user_id, k, d, n, txn_id, NOT dup, CASE WHEN dup THEN kept ELSE list_append(kept, {'a': a, 't': t}) END FROM (
  SELECT r.*, g.kept, len(list_filter(g.kept, lambda x: abs(x.a - r.a) <= 0.01
    AND 1 - CAST(levenshtein(x.t, r.t) AS DOUBLE) / greatest(length(x.t), length(r.t), 1) > 0.8)) > 0 AS dup
  FROM g JOIN r ON r.user_id = g.user_id AND r.k = g.k AND r.d = g.d AND r.n = g.n + 1) AS s
)
SELECT txn_id, is_kept FROM g
"""


@query("W5_greedy_removal_edit", "txn_id bigint, is_kept boolean", GREEDY)
def _(i: Inputs):
    return dedup.remove_duplicates(i.near_copies, method="edit")


@query("U5_removed_rows", "txn_id bigint", "SELECT txn_id FROM exact_copies WHERE txn_id >= 10000000")
def _(i: Inputs):
    return dedup.removed(dedup.remove_duplicates(i.exact_copies))


# --- stored tables --------------------------------------------------------------------------------------


def _stored(i: Inputs):
    t = i.transactions
    return (
        t.withColumn("is_auto_categorized", F.col("txn_id") % 2 == 0)
        .withColumn("confidence_score", F.when(F.col("txn_id") % 2 == 0, F.lit(0.8)))
        .withColumn("upload_batch_id", F.concat(F.lit("job"), (F.col("txn_id") % 30).cast("string")))
    )


@query("S27_read_tables", "txn_month string, n bigint, amount double", """
SELECT strftime(transaction_date, '%Y-%m') AS txn_month, count(*) AS n, sum(amount) AS amount FROM transactions WHERE CAST(transaction_date AS DATE) BETWEEN DATE '2000-02-01' AND DATE '2000-04-30' GROUP BY 1
""")
def _(i: Inputs):
    path = scratch(i, "transactions")
    store.append_transactions(i.transactions, path)
    rows = i.spark.read.parquet(path).filter("txn_month BETWEEN '2000-02' AND '2000-04'")
    return rows.groupBy("txn_month").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


BAD = "CASE WHEN txn_id % 13 = 0 THEN -amount WHEN txn_id % 17 = 0 THEN amount + 0.005 ELSE amount END"
KIND = "CASE WHEN txn_id % 19 = 0 THEN 'OTHER' ELSE transaction_type END"
LAST4 = "CASE CAST(txn_id % 4 AS INT) WHEN 0 THEN '1234' WHEN 1 THEN '12a4' WHEN 2 THEN NULL ELSE '99' END"
ERRORS = f"""SELECT txn_id, concat_ws('; ', CASE WHEN NOT ({BAD} > 0) THEN 'amount must be greater than 0' END, CASE WHEN {BAD} <> round({BAD}, 2) THEN 'amount can have at most 2 decimal places' END,
 CASE WHEN {KIND} NOT IN ('CREDIT', 'DEBIT') THEN 'transaction_type must be CREDIT or DEBIT' END, CASE WHEN NOT regexp_matches({LAST4}, '^[0-9]{{4}}$') THEN 'account_last_4 must be exactly 4 digits' END) AS errors
FROM (SELECT * REPLACE (CAST(amount AS DECIMAL(20,4)) AS amount) FROM transactions)"""


def _incoming(i: Inputs):
    rows = i.transactions.withColumn("amount", F.col("amount").cast("decimal(20,4)"))
    return rows.withColumn("amount", F.expr(BAD)).withColumn("transaction_type", F.expr(KIND)).withColumn("account_last_4", F.expr(LAST4))


@query("S28_insert_counts", "created_count bigint, failed_count bigint, duplicate_count bigint",
       f"SELECT count(*) FILTER (WHERE errors = '') AS created_count, count(*) FILTER (WHERE errors <> '') AS failed_count, 0 AS duplicate_count FROM ({ERRORS})")
def _(i: Inputs):
    return store.insert_counts(_incoming(i))


@query("S29_insert_rules", "txn_id bigint, errors string", ERRORS)
def _(i: Inputs):
    return q.transaction_errors(_incoming(i)).withColumn("errors", F.array_join("errors", "; "))


@query("S29_rule_counts", "error string, n bigint", f"SELECT e AS error, count(*) AS n FROM (SELECT unnest(string_split(errors, '; ')) AS e FROM ({ERRORS})) WHERE e <> '' GROUP BY 1")
def _(i: Inputs):
    return q.error_summary(q.transaction_errors(_incoming(i)))


@query("S30_insert_categorized", AUTO_COLUMNS, auto_sql("SELECT * REPLACE (CASE WHEN txn_id % 2 = 0 THEN category_id END AS category_id) FROM transactions"))
def _(i: Inputs):
    # Half of the rows come with a category and keep it.
    rows = i.transactions.withColumn("category_id", F.when(F.col("txn_id") % 2 == 0, F.col("category_id")))
    valid, _ = store.split_valid(rows)
    return auto_categorized(i, valid)


STORED = """SELECT *, txn_id % 2 = 0 AS is_auto_categorized, CASE WHEN txn_id % 2 = 0 THEN CAST(0.8 AS DOUBLE) END AS confidence_score, 'job' || CAST(txn_id % 30 AS VARCHAR) AS upload_batch_id FROM transactions"""


@query("S31_updates", "txn_id bigint, amount double, notes string, category_id bigint, is_auto_categorized boolean, confidence_score double", f"""
SELECT txn_id, CASE WHEN txn_id % 10 = 3 THEN 42 ELSE amount END AS amount, CASE WHEN txn_id % 20 = 3 THEN 'edited' ELSE notes END AS notes, CASE WHEN txn_id % 30 = 3 THEN 101 ELSE category_id END AS category_id,
 CASE WHEN txn_id % 30 = 3 THEN false ELSE is_auto_categorized END AS is_auto_categorized, CASE WHEN txn_id % 30 = 3 THEN NULL ELSE confidence_score END AS confidence_score FROM ({STORED})
""")
def _(i: Inputs):
    k = F.col("txn_id")
    changes = i.transactions.filter("txn_id % 10 = 3").select(
        "txn_id", F.lit(42).cast("decimal(15,2)").alias("amount"), F.when(k % 20 == 3, "edited").alias("notes"), F.when(k % 30 == 3, 101).alias("category_id")
    )
    return store.apply_updates(_stored(i), changes, NOW)


@query("S32_soft_delete", "txn_id bigint, is_deleted boolean, stamped boolean", """
SELECT txn_id, is_deleted OR txn_id % 12 = 5 AS is_deleted, txn_id % 12 = 5 AND NOT is_deleted AS stamped FROM transactions
""")
def _(i: Inputs):
    ids = i.transactions.filter("txn_id % 12 = 5").select("txn_id", "user_id")
    return store.soft_delete(i.transactions, ids, NOW).withColumn("stamped", F.col("deleted_at").isNotNull())


@query("S32_hard_delete", "txn_id bigint", "SELECT txn_id FROM transactions WHERE txn_id % 12 <> 5")
def _(i: Inputs):
    return store.hard_delete(i.transactions, i.transactions.filter("txn_id % 12 = 5").select("txn_id", "user_id"))


@query("S33_recategorize", "txn_id bigint, category_id bigint, is_auto_categorized boolean, confidence_score double", f"""
SELECT txn_id, CASE WHEN txn_id % 8 = 1 THEN 110 ELSE category_id END AS category_id, CASE WHEN txn_id % 8 = 1 THEN false ELSE is_auto_categorized END AS is_auto_categorized,
 CASE WHEN txn_id % 8 = 1 THEN NULL ELSE confidence_score END AS confidence_score FROM ({STORED})
""")
def _(i: Inputs):
    corrections = i.transactions.filter("txn_id % 8 = 1").select("txn_id", "user_id", F.lit(110).alias("category_id"))
    return store.recategorize(_stored(i), corrections, NOW)


def _jobs(i: Inputs):
    rows = i.transactions.select(F.concat(F.lit("job"), (F.col("txn_id") % 30).cast("string")).alias("job_id"), (F.col("txn_id") % 3).alias("user_id"))
    return rows.groupBy("job_id").agg(F.min("user_id").alias("user_id")).withColumn("status", F.lit("completed"))


@query("S34_delete_batch", "txn_id bigint", "SELECT txn_id FROM transactions WHERE txn_id % 30 NOT IN (4, 5)")
def _(i: Inputs):
    return store.delete_batch(_stored(i), _jobs(i).filter("job_id IN ('job4', 'job5')"))


@query("S37_upload_ledger", "job_id string, status string, transactions_count bigint", f"""
SELECT upload_batch_id AS job_id, 'completed' AS status, count(*) FILTER (WHERE NOT is_deleted) AS transactions_count FROM ({STORED}) GROUP BY 1
""")
def _(i: Inputs):
    return store.upload_ledger(_jobs(i), _stored(i)).orderBy("job_id")


@query("S37_job_rows", "txn_id bigint", f"SELECT txn_id FROM ({STORED}) WHERE upload_batch_id = 'job7' AND NOT is_deleted")
def _(i: Inputs):
    return store.job_transactions(_stored(i), "job7")


def uploaded(i: Inputs, lines):
    """(rows to store, messages per file) of uploaded statement lines; near duplicates in a file are removed."""
    parsed, messages = dedup.without_repeated_lines(store.stage(dl.parse_lines(lines, AS_OF), scratch(i, "parsed")))
    return dl.to_stored(parsed, F.lit(7).cast("bigint"), F.col("file"), store.source_of(F.lit(".csv"))), messages


@query("S36_process_upload", "txn_id bigint, user_id bigint, amount double, transaction_type string, category_id bigint, merchant_name string, raw_data string")
def _(i: Inputs):
    from spendlake.operators.categorize import extract_merchant

    rows, _messages = uploaded(i, i.csv_lines)
    # Parsing is done once; the categorisation stages read the staged rows.
    staged = store.stage(rows, scratch(i, "upload"))
    named = extract_merchant(staged, "txn_id", i.merchant_keywords).withColumn("merchant_name", F.coalesce("merchant", "description")).drop("merchant")
    named = store.stage(named, scratch(i, "named"))
    return auto_categorized(i, named)


@query("D9_preview_import", "txn_id bigint, is_duplicate boolean, category_id bigint", """
WITH k AS (SELECT *, CAST(transaction_date AS DATE) AS d, substring(description, 1, 50) AS s FROM transactions)
SELECT a.txn_id, EXISTS (SELECT 1 FROM k b WHERE b.txn_id % 3 > 0 AND b.user_id = a.user_id AND b.d = a.d AND b.amount = a.amount AND b.transaction_type = a.transaction_type AND b.s = a.s) AS is_duplicate,
 CASE WHEN a.txn_id % 20 = 0 THEN 102 ELSE a.category_id END AS category_id FROM k a
""")
def _(i: Inputs):
    # Every row is imported into a table that holds two rows of three, and every twentieth gets a chosen category.
    parsed = dedup.with_key(i.transactions).withColumn("temp_id", F.col("txn_id").cast("string"))
    preview = store.preview_import(parsed, parsed.filter("txn_id % 3 > 0"))
    selected = preview.select("temp_id")
    overrides = preview.filter("txn_id % 20 = 0").select("temp_id", F.lit(102).alias("category_id"))
    return store.confirm_import(preview, selected, overrides)
