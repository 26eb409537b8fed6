"""Plans and steps that must not grow faster than their input."""

import re

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from spendlake.functions import quality, rules, text
from spendlake.operators import categorize, classifier, matching
from spendlake.plans import ingest
from spendlake.plans.ingest import AS_OF
from spendlake.sources import delimited, layouts
from spendlake.plans.streams import _uploads
from spendlake.streaming import jobs
from tests.test_properties import plan_of


def nodes(df, name: str) -> int:
    """Operators of this kind in the plan's tree."""
    return len(re.findall(rf"{name} \(\d+\)$", plan_of(df).split("\n\n")[0], re.M))


def test_retrieval_joins_only_the_dictionary(spark, inputs):
    index = categorize.retrieval_index(inputs.merchant_keywords)
    rows = [(1, "swiggy order"), (1, "netflix"), (2, "nothing here"), (None, "swiggy"), (3, "Blue Tokai blue tokai")]
    queries = spark.createDataFrame(rows, "txn_id bigint, query string")
    got = matching.tfidf_retrieve(queries, "txn_id", "query", index, "merchant", 2)
    # Two joins with the stored dictionary; the queries are never broadcast or joined with each other.
    assert nodes(got, "BroadcastHashJoin Inner BuildRight") == 2 and nodes(got, "SortMergeJoin Inner") == 0
    assert plan_of(got).count("Arguments: hashpartitioning(txn_id") == 1
    found = {(r["txn_id"], r["merchant"]): (r["rank"], r["score"]) for r in got.collect()}
    assert {k: v[0] for k, v in found.items()}.keys() == {(1, "Swiggy"), (1, "Netflix"), (3, "Blue Tokai")}
    # The rows of a repeated key are one query: its norm has the terms of both.
    assert found[1, "Swiggy"][1] < 0.9 and found[1, "Netflix"][1] < 0.9


def test_texts_are_cleaned_once_for_all_ngrams(spark):
    rows = spark.createDataFrame([("UPI payment to swiggy food order",), ("a",), (None,)], "description string")
    terms = classifier.with_terms(rows)
    optimized = terms._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("regexp_extract_all") == 1 and terms.columns == ["description", "terms"]
    words = spark.createDataFrame([(["a1", "b2", "c3"],), (["a1"],), ([],)], "w array<string>")
    got = [r["t"] for r in words.select(classifier.ngrams(F.col("w")).alias("t")).collect()]
    assert got == [["a1", "b2", "c3", "a1 b2", "b2 c3", "a1 b2 c3"], ["a1"], []]


def test_texts_of_a_row_are_cleaned_once(inputs):
    plan = delimited.parse_lines(inputs.csv_lines, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    # The filters on the date and the number of cells stay above the columns they test.
    conditions = [line for line in plan.split("\n") if re.match(r"[\s:+-]*(Filter|Join) ", line)]
    assert any("_t#" in c for c in conditions) and any("size(cells#" in c for c in conditions)
    assert not any("gettimestamp" in c.lower() for c in conditions)


def test_sorted_rows_are_stored_before_the_sort(inputs):
    done = delimited.post_process(delimited.parse_lines(inputs.csv_lines, AS_OF))
    assert nodes(done, "Sort") == 1 and not re.search("Aggregate|Join", plan_of(done).split("\n\n")[0])


def test_columns_of_a_sheet_come_from_one_pass(spark):
    cells = [
        ("a", "s", 1, 1, "Bank"), ("a", "s", 3, 1, "Txn Date"), ("a", "s", 3, 2, "Narration"), ("a", "s", 3, 25, "Amount"), ("a", "s", 3, 4, "Amount"),
        ("a", "s", 4, 1, "2000-01-01 date"), ("a", "s", 4, 2, "amount"), ("b", "s", 2, 1, "Date"), ("b", "s", 2, 2, "Balance"),
        ("b", "s", 5, 1, "Date"), ("b", "s", 5, 2, "Details"), (None, "s", 1, 1, "Date"), (None, "s", 1, 2, "Amount"), ("a", "s", 40, 1, "x"), ("a", "s", 2, 1, None),
    ]
    found = layouts.sheet_columns(spark.createDataFrame(cells, "file string, sheet string, row int, col int, value string"))
    assert {tuple(r) for r in found.collect()} == {
        ("a", "s", 3, "date", 1), ("a", "s", 3, "description", 2), ("a", "s", 3, "amount", 4)}
    # The header row is taken by rank, so the cells are read once and joined with nothing.
    assert "Join" not in plan_of(found).split("\n\n")[0]


def test_whole_pages_do_not_pass_in_arrow_batches(spark):
    html = spark.createDataFrame([("<b>a &amp; é</b>",), (None,), ("plain",)], "html string")
    got = html.select(quality.strip_html(F.col("html")).alias("a"), quality.normalize_nfc(F.col("html")).alias("b"))
    assert nodes(got, "BatchEvalPython") >= 1 and nodes(got, "ArrowEvalPython") == 0
    assert [tuple(r) for r in got.collect()] == [("a & é", "<b>a &amp; é</b>"), (None, None), ("plain", "plain")]


def test_tasks_move_the_files_they_wrote(spark, inputs, monkeypatch):
    seen = {}
    real = DataFrameWriter.option
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, k, v: (seen.update({k: v}), real(self, k, v))[1])
    path = ingest._write_files(inputs, inputs.csv_lines.limit(300))
    assert seen.get("mapreduce.fileoutputcommitter.algorithm.version") == "2" and spark.read.text(path).count() == 300


def test_a_line_passes_every_layout_pattern_once(inputs):
    plan = layouts.parse_statements(inputs.text_lines, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    own = [p.regex for p in layouts.PATTERNS if p.layout != "generic"]  # two banks share one
    assert [plan.count(regex) for regex in own] == [own.count(regex) for regex in own]
    # The later reading of a file without rows is the only second use of the generic ones.
    assert [plan.count(regex) for regex in layouts.GENERIC] == [2] * len(layouts.GENERIC)


def test_statement_lines_of_odd_shape(spark):
    lines = [
        ("a", 0, "State  Bank of India"), ("a", 1, "05/01/2000  SHOP\x0112  30.00 CR 45000.00"), ("a", 2, None), ("a", 3, "05/01/2000 SHOP 30.00 CR 45.00\rPage 1"),
        ("a", 4, "x"), (None, 0, "05/01/2000 SHOP 30.00 CR 45.00"), ("b", 0, "HDFC BANK"), ("b", 1, "5/1/2000 SHOP 30.00CR"), ("b", 2, "5/1/2000 ab 30.00 DR"),
        ("c", 1, "5/1/2000 no amount here"), ("d", 0, "axis bank or sbi"), ("d", 1, "5 Jan 2000 6 Jan 2000 CASH  77  9.00    1.00"),
    ]
    got = layouts.parse_statements(spark.createDataFrame(lines, "file string, line_no long, line string"), AS_OF)
    rows = {(r["file"], r["line_no"]): (str(r["date"]), r["description"], r["amount"], r["transaction_type"], r["balance"], r["bank"], r["confidence"]) for r in got.collect()}
    assert rows == {
        ("a", 1): ("2000-01-05", "SHOP 12", 30.0, "CREDIT", 45000.0, "sbi", 1.0), ("a", 3): ("2000-01-05", "SHOP", 30.0, "CREDIT", 45.0, "sbi", 1.0),
        ("b", 1): ("2000-01-05", "SHOP", 30.0, "CREDIT", None, "hdfc", 0.7), ("d", 1): ("2000-01-05", "CASH", 9.0, "DEBIT", 1.0, "sbi", 1.0),
    }


def test_names_are_searched_only_near_their_beginnings(spark):
    assert rules.beginnings(["HDFC\\s*BANK|HDFCBANK", "PAYTM?|PAY\\s*TM", "BOB"]) == ["BOB", "HDFC", "PAY"]
    lines = [("a", "paid to Phone Pe"), ("a", "BHIM"), ("b", "nothing"), ("c", None), (None, "gpay")]
    got = layouts.detect_upi_apps(spark.createDataFrame(lines, "file string, line string"))
    assert {tuple(r) for r in got.collect()} == {("a", "phonepe"), ("b", None), ("c", None), (None, "gpay")}


def test_plain_amounts_and_second_readings_of_dates(spark):
    texts = ["1,23,456.78", "45000.00", "5.", ",", ".5", "1.2.3", "-7", "(8)", "Rs. 9", "9 DR", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.clean_amount(F.col("t"))).collect()
    assert [r[0] for r in got] == [123456.78, 45000.0, 5.0, None, 0.5, 1.23, -7.0, -8.0, 9.0, -9.0, None, None]
    days = ["03/02/2001", "03/02/2001 ", "12/25/2000", "25/12/2000", "01/01/1980", "5/6/75", "5/6/99", "2099-01-01", None, "x"]
    frame = spark.createDataFrame([(t,) for t in days], "t string").select(text.clean_date(F.col("t"), AS_OF).cast("string").alias("d"))
    assert [r[0] for r in frame.collect()] == ["2001-02-03", "2001-02-03", "2000-12-25", "2000-12-25", None, None, "1999-06-05", "1999-01-01", None, None]


def test_uploads_are_the_files_of_the_sink(spark, inputs):
    names = ["a", "b c", "x=1/2%3:*?#", "é[{^]\"'\\", "", None]
    rows = [(name, n, text) for name in names for n, text in ((2, "last é"), (0, "first"), (1, None), (1, ""))] + [(None, 3, "end")]
    lines = spark.createDataFrame(rows, "file string, line_no long, line string")

    def held(path):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").collect()
        return {re.search("name=([^/]*)", r["path"]).group(1): bytes(r["content"]) for r in files}

    got = held(_uploads(inputs, lines))
    assert got == held(ingest._write_files(inputs, lines)) and len(got) == 5
    assert got["a"] == "first\n\n\nlast é\n".encode()


def test_new_files_are_listed_and_read_by_few_tasks_and_opened_once(spark, tmp_path, monkeypatch):
    count = 2 * jobs.LISTED * spark.sparkContext.defaultParallelism
    for n in range(count):
        (tmp_path / "in" / f"d{n}").mkdir(parents=True)
        (tmp_path / "in" / f"d{n}" / "f.csv").write_text(f"Date,Description,Amount\n01/02/2000,SHOP {n},-{n + 1}.50\n")
    seen = []
    real = delimited.parse_lines
    monkeypatch.setattr(delimited, "parse_lines", lambda lines, as_of: (seen.append(lines.inputFiles()), real(lines, as_of))[1])
    before = spark.conf.get(jobs.LISTING)
    try:
        jobs.ingest_statements(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), AS_OF).awaitTermination()
        assert int(spark.conf.get(jobs.LISTING)) == jobs.LISTED * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(jobs.LISTING, before)
    rows = spark.read.parquet(str(tmp_path / "out")).select("description", "amount").collect()
    assert {tuple(r) for r in rows} == {(f"SHOP {n}", n + 1.5) for n in range(count)}
    # The batch is read once, into a table of a few files that both readings of its lines use.
    assert len(seen) == 1 and all("/lines-" in f for f in seen[0]) and len(seen[0]) <= count // 2


def test_headers_of_files_are_found_once(inputs):
    done = delimited.parse_lines(inputs.csv_lines, AS_OF)
    assert nodes(done, "Window") == 0 and plan_of(done).count("collect_list") == 0


def test_descriptions_are_normalised_once(spark, inputs):
    rows = inputs.transactions.limit(50)
    done = categorize.auto_categorize(rows, inputs.categories, inputs.merchant_keywords, inputs.merchant_keywords.select(
        "ord", "merchant", F.col("keyword").alias("pattern"), "category", "subcategory"))
    # The texts and the rows with their category are stored; what reads them does not work them out again.
    assert "VPA:" not in plan_of(done) and nodes(done, "SortMergeJoin LeftOuter") <= 1


def test_classes_behind_their_first_letters(spark):
    assert rules.behind_first_letters("SIP|MF\\s*X") == "(?=[MS])(?:SIP|MF\\s*X)"
    for pattern in ("A?B|C", "[ab]|C", "A(B|C)", ""):
        assert rules.behind_first_letters(pattern) == pattern
    texts = ["Swiggy order", "bill   pay", "neft x", "mutual fund", "straße 7", "", None, "ǆ vi"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.description_class(F.col("t"))).collect()
    assert [r[0] for r in got] == ["Food & Dining", "Utilities", "Transfer", "Investment", "Other", None, None, "Utilities"]
