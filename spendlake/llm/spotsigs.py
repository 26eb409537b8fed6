"""SpotSigs: fingerprints of texts from the words that follow common words, in DataFrame functions only.

A common word (an anchor) and the CHAIN content words that come next form a signature; anchors among them are
skipped. A text's fingerprint is the set of its signatures' hashes: boilerplate of links and lists holds few anchors
and hardly counts. Sets are likened by Jaccard. To find all near ones, sets are put into partitions by their size, such
that a near pair lies in one partition or in two neighbours; within these, sets meet by a signature of their prefixes,
the sizes discard pairs, and only what is left is compared.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.shared import components, stored, text_key, without

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if",
    "in", "into", "is", "it", "its", "not", "of", "on", "or", "she", "that", "the", "their", "there", "they", "this", "to", "was", "we", "were",
    "which", "will", "with", "would", "you",
    "aber", "als", "am", "auch", "auf", "aus", "bei", "das", "dass", "dem", "den", "der", "des", "die", "ein", "eine", "einen", "einer", "er",
    "es", "hat", "ich", "im", "ist", "mit", "nach", "nicht", "noch", "oder", "sich", "sie", "sind", "um", "und", "von", "war", "wie", "zu", "zum", "zur",
    "au", "aux", "avec", "ce", "ces", "cette", "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "leur", "mais", "ne",
    "nous", "on", "ou", "par", "pas", "plus", "pour", "qu", "que", "qui", "sa", "se", "ses", "son", "sont", "sur", "un", "une", "vous",
    "al", "como", "con", "del", "el", "ella", "ha", "las", "lo", "los", "más", "muy", "no", "o", "para", "pero", "por", "su", "sus", "y", "ya",
)
#: Content words that follow an anchor in a signature.
CHAIN = 2
#: Likeness from which documents are near.
LEAST = 0.8
#: A signature in more sets than this comes last in the order that prefixes are taken from.
OFTEN = 64
#: Rows of a bucket of neighbouring documents, in expectation, and most buckets.
BUCKET, BUCKETS = 1 << 15, 100_000
#: Parts of equal counts in which ids are looked at; a part is cut evenly into buckets.
QUANTILES = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, whatever the optimiser makes of it."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct 64-bit hashes of a text's signatures.

    Words are runs of letters and digits in lower case. Where no anchor has a chain after it, every word is an anchor;
    of fewer words than a chain and its anchor, the sequence of them is the one signature. No word: an empty set; null: as empty.
    """
    common = [F.xxhash64(F.lit(w)) for w in dict.fromkeys(anchors)]
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    hashes = F.filter(F.transform(split, lambda w: F.xxhash64(w)), lambda h: h != F.xxhash64(F.lit("")))

    def of_words(words: Column) -> Column:
        content = F.array_compact(F.transform(words, lambda h, i: F.when(~h.isin(*common), i)))

        def chains(at: Column) -> Column:
            """at: the places of the content words. The anchors before one share the chain that begins with it."""

            def own(p: Column, j: Column) -> Column:
                before = F.when(j > 0, at[j - 1]).otherwise(F.lit(-1))
                gap = p - before - 1
                run = F.slice(words, before + 2, gap)
                return F.when((gap > 0) & (j + (chain - 1) < F.size(at)), F.transform(run, lambda a: F.xxhash64(a, *(words[at[j + k]] for k in range(chain)))))

            return F.flatten(F.array_compact(F.transform(at, own)))

        return let(content, chains)

    def all_words(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - chain, F.lit(1)))
        return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(chain + 1))))).otherwise(F.array().cast("array<bigint>"))

    def some(words: Column) -> Column:
        return let(of_words(words), lambda found: F.when(F.size(found) > 0, found).otherwise(all_words(words)))

    return F.sort_array(F.array_distinct(let(hashes, some)))


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard's likeness of two sets; two empty ones are equal. Pairs whose sizes alone keep them below ``least`` give 0 unlooked at."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)).cast("double")
    exact = let(both, lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(large == 0, F.lit(1.0)).when(small < F.lit(float(least)) * large - 1e-9, F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(exact)


def fingerprint_text(signed: Column) -> Column:
    """A set of signatures as text: 16 hex digits of each, in ascending order."""
    return F.lower(F.array_join(F.transform(signed, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _bounds(least: float) -> list[int]:
    """Where partitions of set sizes begin: of two near sets, the larger is in the smaller one's partition or the next."""
    out, share = [1], Fraction(str(least))
    while out[-1] < 1 << 31:
        out.append(int(out[-1] / share) + 1)
    return out


def length_partition(size: Column, least: float = LEAST) -> Column:
    """The partition of a set size: 0 for an empty set, then 1, 2, ..."""
    return F.size(F.filter(F.array(*map(F.lit, _bounds(least))), lambda b: b <= size))


def near_pairs(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, likeness) of the near pairs of ``sets`` (id, signed), each with another set; every pair once, a's set no larger than b's.

    Signatures of many sets come last in the order of prefixes, so pairs meet by rare ones. Empty sets are not paired.
    The work of one signature grows with the square of the different sets that hold it in their prefixes.
    """
    sets = stored(sets.where(F.size("signed") > 0).select("id", "signed"), "signed")
    often = sets.select(F.explode("signed").alias("sig")).groupBy("sig").count().where(F.col("count") > OFTEN).select(F.col("sig").alias("__often"))
    size = F.size("signed")
    share = Fraction(str(least))
    # |a & b| >= least * |b| for the larger one: of |s| signatures, all but ceil(least * |s|) - 1 are a prefix
    need = F.expr(f"int(({share.numerator}L * size(signed) + {share.denominator - 1}L) div {share.denominator}L)")
    rows = sets.select("id", size.alias("size"), (size - need + 1).alias("first"), F.explode("signed").alias("sig"))
    rows = rows.join(often, F.col("sig") == F.col("__often"), "left")
    order = Window.partitionBy("id").orderBy(F.col("__often").isNotNull(), "sig")
    rows = rows.withColumn("place", F.row_number().over(order)).where("place <= first").withColumn("part", length_partition(F.col("size"), least))
    large = rows.select(F.col("id").alias("b"), F.col("size").alias("size_b"), "sig", "part")
    small = rows.select(F.col("id").alias("a"), F.col("size").alias("size_a"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    fits = (F.col("size_a") < F.col("size_b")) | (F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b"))
    met = small.join(large, ["sig", "part"]).where(fits & (F.col("size_a") * share.denominator >= F.col("size_b") * share.numerator))
    met = met.select("a", "b").distinct()
    met = met.join(sets.toDF("a", "signed_a"), "a").join(sets.toDF("b", "signed_b"), "b")
    return met.select("a", "b", jaccard(F.col("signed_a"), F.col("signed_b"), least).alias("likeness")).where(F.col("likeness") >= least)


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, fingerprint (array), group_id and n_near of every row of ``docs`` (doc_id, text).

    ``group_id`` is the smallest doc_id that near pairs reach, null where none of those rows has a doc_id; ``n_near`` the
    number of different sets that are near the row's own. Rows of equal sets are one node (told by a 64-bit hash), so copies are never compared.
    Texts without words are equal to each other and near nothing else. An empty table gives an empty result; other columns are not read.
    """
    rows = stored(docs.select("doc_id", signatures(F.col("text")).alias("fingerprint")).withColumn("id", F.xxhash64("fingerprint")), "spots")
    sets = rows.groupBy("id").agg(F.first("fingerprint").alias("signed"), F.min("doc_id").alias("first"))
    pairs = stored(near_pairs(sets, least), "near")
    linked = components(pairs.select("a", "b"))
    near = pairs.select("a").unionAll(pairs.select("b")).groupBy(F.col("a").alias("of")).agg(F.count("*").alias("n"))
    nodes = sets.select("id", "first").join(linked, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("component", "id").alias("component"))
    nodes = stored(nodes.join(near, F.col("id") == F.col("of"), "left").drop("of"), "nodes")
    least_id = nodes.groupBy("component").agg(F.min("first").alias("group_id"))
    named = nodes.join(least_id, "component").select("id", "group_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_near"))
    return rows.join(named, "id").select("doc_id", "fingerprint", "group_id", "n_near")


def with_next(docs: DataFrame, carried: tuple[str, ...], add: Callable[[DataFrame], DataFrame] = lambda rows: rows, bucket: int = BUCKET) -> DataFrame:
    """``docs`` (doc_id, text, ...) after ``add`` and, as next_<name>, each column of ``carried`` of the next document in ascending order of doc_id.

    A null doc_id comes first, equal ones run in the order of a hash of their texts; the first document follows the last. Rows are
    shuffled once, by buckets of neighbouring ids, and what ``add`` adds is computed after that; the first row of each bucket goes to the
    bucket before it, too. An id that many rows repeat is cut into buckets by the hash.
    """
    docs = without(docs, *(f"next_{c}" for c in carried))
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    n, nulls = ids.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(max(-(-n // bucket), 2 * parts), BUCKETS)
    cuts = (ids.agg(F.percentile_approx("doc_id", [k / QUANTILES for k in range(QUANTILES + 1)], 10_000)).first()[0] or [0]) if n else [0]
    # ranges of ids [low, next low), as wide as their share; an id that fills quantiles is a range of its own
    lows: list[int] = []
    for a, b in zip(cuts, [*cuts[1:], None]):
        if not lows or a > lows[-1]:
            lows.append(a)
        if a == b and a + 1 not in lows:
            lows.append(a + 1)
    lows = sorted(set(lows))
    shares = [sum(1 for c in cuts[:-1] if low <= c and (k + 1 == len(lows) or c < lows[k + 1])) for k, low in enumerate(lows)]
    highs = [*(low - 1 for low in lows[1:]), max(cuts[-1], lows[-1])]
    pieces = [max(1, -(-wanted * max(s, 1) // QUANTILES)) for s in shares]
    first_bucket = [sum(pieces[:k]) for k in range(len(pieces))]
    null_pieces = max(1, -(-wanted * nulls // max(n, 1)))

    def literal(values: list[int]) -> Column:
        return F.lit(values).cast("array<bigint>")

    # the place of a hash, or of an id within its range, as a share in [0, 1)
    by_tie = F.shiftrightunsigned(F.col("__tie").bitwiseXOR(F.lit(-(1 << 63))), 11) / float(1 << 53)
    low, high = F.get(literal(lows), F.col("__range")), F.get(literal(highs), F.col("__range"))
    by_id = F.when(low == high, by_tie).otherwise((F.least("doc_id", high).cast("double") - low) / (high.cast("double") - low + 1))
    many = F.get(literal(pieces), F.col("__range"))
    inner = F.least(F.greatest(F.floor(by_id * many), F.lit(0).cast("bigint")), many - 1) + F.get(literal(first_bucket), F.col("__range")) + null_pieces
    place = F.when(F.col("doc_id").isNull(), F.floor(by_tie * null_pieces)).otherwise(inner)
    rows = docs.withColumn("__tie", F.xxhash64(text_key("text")))
    rows = rows.withColumn("__range", F.greatest(F.size(F.filter(literal(lows), lambda b: b <= F.col("doc_id"))) - 1, F.lit(0)))
    rows = rows.withColumn("__bucket", place).drop("__range")
    # heads: a row per bucket, at most BUCKETS and some; the one after the last bucket's is the first
    heads = rows.groupBy("__bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "__tie")).alias("head"))
    ring = Window.orderBy("__bucket")
    last = F.max("__bucket").over(Window.partitionBy())
    heads = stored(heads.select(F.coalesce(F.lag("__bucket").over(ring), last).alias("__to"), F.col("__bucket").alias("__of"), F.col("head.doc_id").alias("__id"), F.col("head.__tie").alias("__head")), "heads")
    same = (F.col("__bucket") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__head"))
    both = rows.join(F.broadcast(heads), same, "left")
    copies = F.when(F.col("__of").isNull(), F.array(F.struct("__bucket", F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct("__bucket", F.lit(False).alias("guest")), F.struct(F.col("__to").alias("__bucket"), F.lit(True).alias("guest")))
    )
    both = both.withColumn("__copy", F.explode(copies)).select(*docs.columns, "__tie", F.col("__copy.__bucket").alias("__bucket"), F.col("__copy.guest").alias("__guest"))
    order = Window.partitionBy("__bucket").orderBy("__guest", F.col("doc_id").asc_nulls_first(), "__tie")
    rows = add(both.repartition("__bucket")).withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return rows.where(~F.col("__guest")).drop("__guest", "__tie", "__bucket")


def edits(docs: DataFrame, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """How the fingerprint of each row of ``docs`` (doc_id, text) takes an edit: doc_id, n_chars, edited, signed, edited_signed, near_edited, near_next.

    ``edited`` is the text whose last quarter of code points (rounded down) gave way to as many of the next document's
    first (or all it has), in ascending order of doc_id; after the last comes the first. ``near_edited`` and ``near_next`` liken the text's signatures
    to those of ``edited`` and of the next document. A null text is empty; repeated rows are rows of their own; one row is its own next; an empty table gives no row.
    """

    def add(rows: DataFrame) -> DataFrame:
        return rows.withColumn("signed", signatures(F.col("text"), anchors, chain))

    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ("text", "signed"), add)
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("cut", F.expr("int(n_chars div 4)"))
    edited = F.concat(F.substring("text", F.lit(1), F.expr("int(n_chars) - cut")), F.substring("next_text", F.lit(1), F.col("cut")))
    rows = rows.withColumn("edited", edited).withColumn("edited_signed", signatures(F.col("edited"), anchors, chain))
    return rows.select(
        "doc_id", "n_chars", "edited", "signed", "edited_signed",
        jaccard(F.col("signed"), F.col("edited_signed")).alias("near_edited"), jaccard(F.col("signed"), F.col("next_signed")).alias("near_next"),
    )
