"""Multi-stage categorisation of all transactions at once.

Stages that need only the row itself (bank narration, amount, time) are
expressions. Stages that need a dictionary give (txn_id, candidate) rows; they
meet the transactions in one join on txn_id, which has no hot keys. The best
candidate is picked inside the row by an array sort.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions import fixed_values as v
from spendlake.functions import text as x
from spendlake.functions.rules import case_of
from spendlake.operators import matching
from spendlake.operators.analytics import CATEGORY_ALIASES
from spendlake.operators.ranking import first_per_key, top_k
from spendlake.session import checkpoint_dir
from spendlake.sources import dimensions as dim
from spendlake.sources import store

# Weight and tie order of each stage.
STAGES = {
    "pattern_match": (0.95, 0),
    "user_correction": (1.0, 1),
    "upi_match": (0.98, 2),
    "exact_match": (1.0, 3),
    "fuzzy_match": (0.85, 4),
    "ml_classification": (0.88, 5),
    "rag_retrieval": (0.92, 6),
    "amount_heuristic": (0.6, 7),
    "time_pattern": (0.55, 8),
}
CANDIDATE = (
    "struct<neg_score:double,stage:int,pos:int,category:string,subcategory:string,confidence:double,method:string,merchant:string>"
)


def candidate(method: str, category: Column, subcategory: Column, confidence: Column, merchant: Column | None = None, pos: Column | int = 0) -> Column:
    """A candidate; structs sort by score (descending), then stage, then position."""
    weight, stage = STAGES[method]
    return F.struct(
        (-(confidence * F.lit(weight))).alias("neg_score"),
        F.lit(stage).alias("stage"),
        (pos if isinstance(pos, Column) else F.lit(pos)).cast("int").alias("pos"),
        category.alias("category"),
        subcategory.alias("subcategory"),
        confidence.cast("double").alias("confidence"),
        F.lit(method).alias("method"),
        (F.lit(None) if merchant is None else merchant).cast("string").alias("merchant"),
    ).cast(CANDIDATE)


def bank_narration(description: Column) -> Column:
    """struct(category, subcategory) of the first bank pattern found, else null."""
    branches = [
        (description.rlike(f"(?i){p}"), F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory")))
        for p, c, s in v.BANK_NARRATIONS
    ]
    return case_of(branches)


def hints_as_candidates(method: str, hints: Column) -> Column:
    return F.transform(
        hints, lambda h, i: candidate(method, h["category"], h["subcategory"], h["confidence"], None, i)
    )


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """Last correction per (normalised description, amount)."""
    return corrections.groupBy(x.normalize_description(F.col("description")).alias("normalized"), "amount").agg(
        F.max_by(F.struct("category", "subcategory"), "corrected_at").alias("c")
    )


def record_corrections(path: str, corrections: DataFrame) -> None:
    """Append to the corrections table that ``latest_corrections`` reads."""
    corrections.select("description", "amount", "category", "subcategory", "corrected_at").write.mode("append").parquet(path)


def extract_merchant(txns: DataFrame, key: str, keywords: DataFrame) -> DataFrame:
    """Dictionary merchant in the description, else a guess from its form."""
    best = matching.best_contained(txns, key, "description", keywords).select(key, F.col("merchant").alias("_m"))
    guess = x.merchant_name_guess(x.normalize_description(F.col("description")))
    return txns.withColumn("_guess", guess).join(best, key, "left").withColumn("merchant", F.coalesce("_m", "_guess")).drop("_m", "_guess")


def infer_from_text(text: Column) -> Column:
    """Category from taxonomy words: a sub-category name, else most keywords."""
    low = F.lower(text)
    subs = F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory")) for c, subs in dim.SUBCATEGORIES.items() for s in subs
    ])
    hit = F.try_element_at(F.filter(subs, lambda s: low.contains(F.lower(s["subcategory"]))), F.lit(1))
    scored = F.array(*[
        F.struct(
            F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))).alias("n"),
            F.lit(-k).alias("o"),
            F.lit(c).alias("category"),
            F.lit(dim.SUBCATEGORIES[c][0]).alias("subcategory"),
        )
        for k, (c, words) in enumerate(dim.CATEGORY_KEYWORDS.items())
    ])
    best = F.array_max(scored)
    by_words = F.when(
        best["n"] > 0,
        F.struct(
            best["category"].alias("category"),
            best["subcategory"].alias("subcategory"),
            F.least(F.lit(0.85), F.lit(0.6) + best["n"] * F.lit(0.05)).alias("confidence"),
        ),
    )
    by_name = F.when(
        hit.isNotNull(),
        F.struct(hit["category"].alias("category"), hit["subcategory"].alias("subcategory"), F.lit(0.8).alias("confidence")),
    )
    return F.coalesce(by_name, by_words)


def retrieval_index(keywords: DataFrame) -> DataFrame:
    """TF-IDF index of the dictionary: name, keywords, category and sub-category per merchant.

    It is stored, so that Spark plans its joins with its real size.
    """
    docs = keywords.groupBy("merchant", "category", "subcategory").agg(
        F.min("ord").alias("ord"), F.array_join(F.array_sort(F.collect_list(F.struct("ord", "keyword")))["keyword"], " ").alias("words")
    )
    text = F.concat_ws(" ", "merchant", "words", "category", "subcategory")
    index = matching.tfidf_index(docs.withColumn("text", text), "merchant", "text")
    return store.stage(index, f"{checkpoint_dir(keywords.sparkSession)}/retrieval-{uuid.uuid4().hex}")


def retrieval_candidates(queries: DataFrame, key: str, text: str, keywords: DataFrame, k: int = 5, min_score: float = 0.2) -> DataFrame:
    """Merchants that read like the text, with confidence 1.15 x cosine (at most 1)."""
    facts = keywords.groupBy("merchant").agg(F.first("category").alias("category"), F.first("subcategory").alias("subcategory"))
    hits = matching.tfidf_retrieve(queries, key, text, retrieval_index(keywords), "merchant", k, min_score)
    return hits.join(facts, "merchant").withColumn("confidence", F.least(F.lit(1.0), F.col("score") * 1.15))


def categorize(
    txns: DataFrame,
    keywords: DataFrame,
    upi_patterns: DataFrame,
    corrections: DataFrame | None = None,
    predictions: DataFrame | None = None,
    retrieval: bool = True,
) -> DataFrame:
    """Best category of every transaction, with alternatives.

    ``txns``: txn_id, description, amount, transaction_type, transaction_date.
    ``predictions``: optional classifier output (txn_id, category, subcategory, confidence).
    All stages that look at the text run once for each distinct description,
    and one join brings what they found to the transactions.
    """
    desc = F.col("description")
    base = (
        txns.select(desc.alias("_t")).distinct().withColumn("description", F.col("_t"))
        .withColumn("normalized", x.normalize_description(desc))
        .withColumn("guess", x.merchant_name_guess(F.col("normalized")))
        .withColumn("upi", x.extract_upi_id(desc))
        .withColumn("bank", bank_narration(desc))
    )
    # Every stage reads these texts: they are worked out once and stored.
    base = store.stage(base, f"{checkpoint_dir(txns.sparkSession)}/descriptions-{uuid.uuid4().hex}")
    key = "_t"

    def rows(df: DataFrame, method: str, confidence: Column, merchant: Column | None = None, pos: Column | int = 0) -> DataFrame:
        return df.select(key, candidate(method, F.col("category"), F.col("subcategory"), confidence, merchant, pos).alias("c"))

    conf, merchant = F.col("confidence"), F.col("merchant")
    exact = matching.best_contained(base, key, "normalized", keywords, 3)
    unmatched = base.select(key, "normalized").join(exact.filter("rank = 1").select(key), key, "left_anti")
    fuzzy = matching.fuzzy_matches(unmatched, key, "normalized", keywords, 0.65, 2)
    upi = matching.upi_matches(base, key, "upi", upi_patterns)
    named = matching.best_contained(base, key, "description", keywords).select(key, F.col("merchant").alias("named"))
    parts = [
        rows(exact, "exact_match", conf, merchant, F.col("rank")),
        rows(fuzzy, "fuzzy_match", F.col("score") * 0.8, merchant, F.col("rank")),
        rows(upi, "upi_match", F.lit(0.90), merchant),
    ]
    if retrieval:
        query = base.select(key, "description", "guess").join(named, key, "left").select(
            key, F.trim(F.concat_ws(" ", F.coalesce("named", "guess"), "description")).alias("query")
        )
        found = retrieval_candidates(query, key, "query", keywords).filter("rank <= 3")
        parts.append(rows(found, "rag_retrieval", conf, merchant, F.col("rank")))
    looked_up = parts[0]
    for part in parts[1:]:
        looked_up = looked_up.unionByName(part)
    found = looked_up.groupBy(key).agg(F.collect_list("c").alias("found"))
    guess_sub = matching.best_contained(base.filter("guess IS NOT NULL"), key, "guess", keywords).select(
        key, F.col("is_subscription").alias("guess_sub")
    )
    facts = base.select(key, "normalized", "guess", "bank").join(found, key, "left").join(named, key, "left").join(guess_sub, key, "left")
    out = txns.join(facts, desc.eqNullSafe(F.col(key)), "left")
    if predictions is not None:
        own = candidate("ml_classification", F.col("category"), F.col("subcategory"), conf * 0.85, None, 0)
        predicted = predictions.select("txn_id", own.alias("p")).groupBy("txn_id").agg(F.collect_list("p").alias("predicted"))
        out = out.join(predicted, "txn_id", "left")
    else:
        out = out.withColumn("predicted", F.lit(None).cast(f"array<{CANDIDATE}>"))
    if corrections is not None:
        out = out.join(latest_corrections(corrections), ["normalized", "amount"], "left")
    else:
        out = out.withColumn("c", F.lit(None).cast("struct<category:string,subcategory:string>"))

    is_debit = F.lower("transaction_type") == "debit"
    bank = F.col("bank")
    none = F.array().cast(f"array<{CANDIDATE}>")
    all_candidates = F.concat(
        F.array_compact(F.array(
            F.when(bank.isNotNull(), candidate("pattern_match", bank["category"], bank["subcategory"], F.lit(0.80))),
            F.when(F.col("c").isNotNull(), candidate("user_correction", F.col("c.category"), F.col("c.subcategory"), F.lit(0.99))),
        )),
        F.coalesce("found", none),
        F.coalesce("predicted", none),
        hints_as_candidates("amount_heuristic", F.slice(x.amount_hints(F.col("amount"), is_debit), 1, 2)),
        hints_as_candidates("time_pattern", x.time_hints(F.col("transaction_date"))),
    )
    out = out.withColumn("candidates", F.array_sort(all_candidates)).withColumn(
        "best", F.try_element_at("candidates", F.lit(1))
    )
    named_merchant = F.coalesce(F.col("best.merchant"), F.col("named"))
    out = out.withColumn("_dict_name", named_merchant).join(_subscription_names(keywords), "_dict_name", "left")
    return out.select(
        *txns.columns,
        "normalized",
        F.coalesce(F.col("best.category"), F.when(is_debit, "Personal").otherwise("Income")).alias("category"),
        F.coalesce(F.col("best.subcategory"), F.when(is_debit, "Miscellaneous").otherwise("Other Income")).alias("subcategory"),
        F.coalesce(F.col("best.confidence"), F.lit(0.1)).alias("confidence"),
        F.coalesce(F.col("best.method"), F.lit("default")).alias("method"),
        F.when(F.col("best").isNotNull(), F.coalesce("_dict_name", "guess")).alias("matched_merchant"),
        (
            F.col("best").isNotNull()
            & F.coalesce(F.when(F.col("_dict_name").isNotNull(), F.col("_sub")).otherwise(F.col("guess_sub")), F.lit(False))
        ).alias("is_subscription"),
        F.filter(F.slice("candidates", 2, 4), lambda c: c["confidence"] >= 0.1).alias("alternatives"),
    )


def _subscription_names(keywords: DataFrame) -> DataFrame:
    """Subscription flag of every dictionary name, looked up by the name itself."""
    names = keywords.select(F.col("merchant").alias("_dict_name")).distinct()
    best = matching.best_contained(names, "_dict_name", "_dict_name", keywords)
    return best.select("_dict_name", F.col("is_subscription").alias("_sub"))


def suggestions(categorized: DataFrame, top_n: int = 5) -> DataFrame:
    """Best category and alternatives, each (category, subcategory) once."""
    first = F.struct("category", "subcategory", "confidence")
    rest = F.transform(
        "alternatives",
        lambda c: F.struct(c["category"].alias("category"), c["subcategory"].alias("subcategory"), c["confidence"].alias("confidence")),
    )
    rows = categorized.select("txn_id", F.posexplode(F.concat(F.array(first), rest)).alias("pos", "s"))
    flat = rows.select("txn_id", "pos", "s.category", "s.subcategory", "s.confidence")
    unique = first_per_key(flat, ["txn_id", "category", "subcategory"], [F.col("pos")])
    return top_k(unique, ["txn_id"], [F.col("pos")], top_n)


# --- from names to stored category ids --------------------------------------------------


def category_keys(categories: DataFrame) -> DataFrame:
    """Every key (slug of the name, lower-case name) of a category; the last listed wins."""
    both = categories.select("category_id", F.explode(F.array(x.slug(F.col("name")), F.lower("name"))).alias("key"))
    return both.groupBy("key").agg(F.max("category_id").alias("category_id"))


def resolve_category(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Add ``resolved_id``: sub-category name first, then category name.

    Only the distinct name pairs are looked up.
    """
    alias = F.create_map(*[F.lit(s) for pair in CATEGORY_ALIASES.items() for s in pair])
    keys = category_keys(categories)
    pairs = df.select("category", "subcategory").distinct()
    out = pairs
    for n, name in enumerate(("subcategory", "category")):
        s = x.slug(F.col(name))
        for m, k in enumerate((F.coalesce(F.try_element_at(alias, s), s), F.lower(name))):
            found = keys.select(F.col("key").alias(f"k{n}{m}"), F.col("category_id").alias(f"id{n}{m}"))
            out = out.withColumn(f"k{n}{m}", k).join(found, f"k{n}{m}", "left")
    out = out.select("category", "subcategory", F.coalesce("id00", "id01", "id10", "id11").alias("resolved_id"))
    return df.join(out, ["category", "subcategory"], "left")


def keyword_fallback(df: DataFrame, key: str, category_words: DataFrame) -> DataFrame:
    """First category, in order, with a keyword in description and merchant.

    ``category_words``: ord, keyword, category_id.
    """
    texts = df.select(key, F.concat_ws(" ", "description", F.coalesce("merchant_name", F.lit(""))).alias("text"))
    distinct = texts.select("text", F.col("text").alias("_t")).distinct()
    hits = matching.contained(distinct, "_t", "text", category_words, "keyword")
    first = hits.groupBy("_t").agg(F.min_by("category_id", "ord").alias("fallback_id"))
    return texts.join(first, F.col("text") == F.col("_t")).select(key, "fallback_id")


def auto_categorize(
    txns: DataFrame,
    categories: DataFrame,
    keywords: DataFrame,
    upi_patterns: DataFrame,
    category_words: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Stored category id and confidence for rows that came without a category."""
    text = F.trim(F.concat_ws(" ", "description", F.coalesce("merchant_name", F.lit(""))))
    joined = txns.withColumn("_given", F.col("description")).withColumn("description", text)
    found = categorize(joined, keywords, upi_patterns, **options).select(*joined.columns, "category", "subcategory", "confidence")
    # Read twice: for the names that are looked up, and for the rows that get them.
    found = store.stage(found, f"{checkpoint_dir(txns.sparkSession)}/categorized-{uuid.uuid4().hex}")
    result = resolve_category(found, categories).withColumn("description", F.col("_given"))
    if category_words is not None:
        fallback = keyword_fallback(txns, "txn_id", category_words)
        result = result.join(fallback, "txn_id", "left")
    else:
        result = result.withColumn("fallback_id", F.lit(None).cast("int"))
    given = F.col("category_id").isNotNull()
    predicted = F.coalesce("resolved_id", "fallback_id")
    auto = ~given & predicted.isNotNull()
    score = F.when(F.col("resolved_id").isNotNull(), F.col("confidence")).otherwise(F.lit(0.9))
    return result.select(
        *[c for c in txns.columns if c not in ("category_id", "is_auto_categorized", "confidence_score")],
        F.coalesce("category_id", predicted).alias("category_id"),
        auto.alias("is_auto_categorized"),
        F.when(auto, score).alias("confidence_score"),
    )
