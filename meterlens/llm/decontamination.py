"""Benchmark passages in documents by a distributed positional inverted index.

Every window of an item (``window`` consecutive words; a shorter item is one window)
is known by its two rarest words, by their counts over the whole corpus. The index
stores the postings of these words: document, position, and the words around it. The
two posting lists of a window, each shifted by its word's offset, are intersected on
document and start, and what is left is compared word by word. Only DataFrame and SQL
functions are used. Postings stay with their document, so neither a frequent word nor
a passage that many documents share gathers anywhere.

The words to be indexed travel to the tasks as a set. A benchmark with more of them than
``TERMS_AT_ONCE`` is searched in blocks of windows, each with a pass over the corpus.

Defined cases: null and empty texts have no words and match nothing; repeated rows
(documents or items) count each for itself, equal item ids once; empty tables give no
hits; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import UPPER, let, small_side
from meterlens.session import settle

WINDOW = 10
TERMS_AT_ONCE = 20_000
# Fixed pattern of what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of ``text`` with A to Z in lower case; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    # ``lower`` is the faster where it does the same: on texts of ASCII characters.
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )
    return F.array_remove(F.split(plain, BETWEEN), "")


def item_windows(benchmark: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """Distinct windows of all items: (phrase, items), items as sorted strings."""
    cut = let(words(F.col(text_column)), lambda w: F.when(
        F.size(w) > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(1))),
            lambda at: F.slice(w, at, F.lit(window)),
        ),
    ))
    return (
        benchmark.select(F.col(id_column).cast("string").alias("item"), F.explode(cut).alias("phrase"))
        .groupBy("phrase").agg(F.collect_set("item").alias("items"))
    )


def term_counts(docs: DataFrame, text_column: str, vocabulary: DataFrame) -> DataFrame:
    """Occurrences over all documents of the words in ``vocabulary`` (term)."""
    found = docs.select(F.explode(words(F.col(text_column))).alias("term"))
    side = small_side(vocabulary)
    # A vocabulary too large to broadcast meets the counts, not the words.
    if side is not vocabulary:
        found = found.join(side, "term", "left_semi")
    counted = found.groupBy("term").agg(F.count("*").alias("n"))
    return vocabulary.join(counted, "term", "left").fillna(0, ["n"])


def with_rarest(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with their two rarest words and the words' offsets (the same for one word)."""
    ranked = (
        windows.select("phrase_id", F.posexplode("phrase").alias("offset", "term"))
        .join(small_side(counts), "term")
        .groupBy("phrase_id")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))), 1, 2).alias("two"))
    )
    return windows.join(ranked, "phrase_id").select(
        "phrase_id", "phrase", "items",
        F.col("two")[0]["term"].alias("rarest"), F.col("two")[0]["offset"].alias("rarest_at"),
        F.element_at("two", -1)["term"].alias("second"),
        F.element_at("two", -1)["offset"].alias("second_at"),
    )


def positional_index(
    keyed: DataFrame, terms: list[str], window: int = WINDOW
) -> DataFrame:
    """The stored index of documents (key, doc_id, text): (key, doc_id, n_words, postings).

    A posting has the term, its position, and up to ``window`` - 1 words on either side
    from position ``near_from``. These are one string, the words parted by spaces (no word
    holds one), so that a batch of documents is read back as one value for each posting.
    """
    def postings(w: Column) -> Column:
        at = F.filter(
            F.transform(w, lambda word, k: F.when(word.isin(terms), k)), lambda k: k.isNotNull()
        ) if terms else F.array().cast("array<int>")
        return F.struct(F.size(w).cast("long").alias("n_words"), F.transform(at, lambda k: F.struct(
            F.get(w, k).alias("term"),
            k.alias("position"),
            F.greatest(k - (window - 1), F.lit(0)).alias("near_from"),
            F.concat_ws(
                " ", F.slice(w, F.greatest(k - (window - 2), F.lit(1)), F.lit(2 * window - 1))
            ).alias("near"),
        )).alias("postings"))

    return settle(
        keyed.select("key", "doc_id", let(words(F.col("text")), postings).alias("found"))
        .select("key", "doc_id", "found.n_words", "found.postings")
    )


def posting_lists(index: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists of every window's rarest and second word, shifted to where the window starts."""
    rows = index.select("key", F.explode("postings").alias("p"))
    first = rows.join(windows, F.col("p.term") == F.col("rarest")).select(
        "key", "phrase_id", (F.col("p.position") - F.col("rarest_at")).alias("start"),
        F.col("p.near").alias("near"), F.col("p.near_from").alias("near_from"), "phrase",
    )
    second = rows.select("key", F.col("p.term").alias("term"), F.col("p.position").alias("position")) \
        .join(windows.select("phrase_id", "second", "second_at"), F.col("term") == F.col("second")) \
        .select("key", "phrase_id", (F.col("position") - F.col("second_at")).alias("start"))
    return first, second


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences of windows: (key, phrase_id, start, length)."""
    first, second = posting_lists(index, windows)
    within = F.col("start") - F.col("near_from")
    return (
        first.filter(within >= 0)
        .join(second, ["key", "phrase_id", "start"])
        .filter(F.slice(F.split("near", " "), within + 1, F.size("phrase")) == F.col("phrase"))
        .select("key", "phrase_id", "start", F.size("phrase").alias("length"))
    )


def proximity_matches(index: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """Places where a window's two rarest words stand at most ``slop`` words out of step.

    (key, phrase_id, start, shift). Lists meet in stretches of ``slop`` + 1 starts.
    """
    first, second = posting_lists(index, windows)
    stretch = F.floor(F.col("start") / (slop + 1))
    left = first.select("key", "phrase_id", "start", stretch.alias("at"))
    right = second.select(
        "key", "phrase_id", F.col("start").alias("other"),
        F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("at"),
    )
    shift = F.col("other") - F.col("start")
    return (
        left.join(right, ["key", "phrase_id", "at"])
        .filter(F.abs(shift) <= slop)
        .select("key", "phrase_id", "start", shift.alias("shift"))
    )


def _covered(spans: Column) -> Column:
    """Words inside sorted (start, length) spans, each counted once."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(so_far: Column, span: Column) -> Column:
        end = F.greatest(so_far["end"], span["start"] + span["length"])
        return F.struct(
            (so_far["n"] + end - F.greatest(so_far["end"], span["start"])).alias("n"),
            end.alias("end"),
        )

    return F.aggregate(spans, begin, add)["n"]


def prepared_windows(
    docs: DataFrame, benchmark: DataFrame, text_column: str, item_column: str,
    item_text_column: str, window: int,
) -> DataFrame:
    """All distinct windows with their rarest words, as a settled table."""
    windows = settle(
        item_windows(benchmark, item_column, item_text_column, window)
        .withColumn("phrase_id", F.monotonically_increasing_id())
    )
    vocabulary = settle(windows.select(F.explode("phrase").alias("term")).distinct())
    return settle(with_rarest(windows, settle(term_counts(docs, text_column, vocabulary))))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    terms_at_once: int = TERMS_AT_ONCE,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document row."""
    windows = prepared_windows(docs, benchmark, text_column, item_column, item_text_column, window)
    n_terms = windows.select(F.explode(F.array("rarest", "second")).alias("term")).distinct().count()
    blocks = max(1, -(-n_terms // terms_at_once))
    keyed = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_column).alias("doc_id"),
        F.col(text_column).alias("text"),
    )
    if blocks > 1:  # several passes must agree on the keys
        keyed = settle(keyed)
    index, matches = None, None
    for block in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("phrase_id"), F.lit(blocks)) == block)
        terms = [r[0] for r in own.select(F.explode(F.array("rarest", "second")).alias("term"))
                 .distinct().collect()]  # about terms_at_once
        index = positional_index(keyed, terms, window)
        side = small_side(own) if blocks == 1 else own
        found = phrase_matches(index, side).join(side.select("phrase_id", "items"), "phrase_id")
        matches = found if matches is None else matches.unionByName(found)
    per_document = matches.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).select("key", _covered(F.col("spans")).cast("long").alias("n_hit"), "items")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return index.select("key", "doc_id", "n_words").join(per_document, "key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
