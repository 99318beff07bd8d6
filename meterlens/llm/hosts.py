"""Quality rules judged by host: failure rates with an empirical beta prior.

1. One pass over the texts measures each document and applies the rules.
2. Failures are added up by host, per rule and for "any rule".
3. For each rule the rates of all hosts give a beta prior by Kleinman's moments: the spread
   of the rates beyond what chance makes gives the weight of the prior. A host's rate is the
   mean of its posterior, so a host of few documents stays near the rate of all.
4. A host whose rate on some rule exceeds ``HOST_LIMIT`` is rejected, and its verdict is
   joined back to its documents. A document stays if it breaks no rule and its host is not
   rejected.

Defined cases: a null or empty text has no words and breaks the first rule; a document
without host is judged by its own rules alone and counts for no host; if hosts do not differ
beyond chance, or there is one only, every host has the rate of all; repeated rows count
each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import lanes_for_join, small_side
from meterlens.session import settle

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
SYMBOL_PERCENT = 10  # of the words
LINE_PERCENT = 30
HOST_LIMIT = 0.5
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)

_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text.

    Equal windows have equal hashes; only windows whose hash occurs twice are compared.
    """
    many = len(words) - width + 1
    if many < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = sum(hashes[k:many + k] * _MULTIPLIERS[k] for k in range(width))
    _, kind, count = np.unique(mixed, return_inverse=True, return_counts=True)
    places = np.flatnonzero(count[kind] > 1)
    if not len(places):
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)[places]
    _, kind, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    places = places[count[kind.reshape(-1)] > 1]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + width, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measures(raw: bytes | None) -> tuple[int, ...]:
    """The measures of one text in UTF-8, in the order of ``MEASURES``; lines are those with a word."""
    if not raw:
        return (0,) * len(MEASURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = counts.sum() - counts[0x80:0xC0].sum()  # without continuation bytes
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), int(points - counts[SPACES].sum()), int(counts[SYMBOLS].sum()), len(lines),
            len(lines) - len(set(lines)), repeated_words(words))


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures(raw.as_py()) for raw in batch.column("raw")]
        columns = np.array(rows, np.int64).reshape(-1, len(MEASURES)).T
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), *map(pa.array, columns)],
            names=["doc_id", "host", *MEASURES],
        )


def rules() -> dict[str, Column]:
    """Name of each rule and the condition under which a document breaks it."""
    words = F.col("n_words")
    return {
        "short": words < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * words,
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * words,
        "lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
    }


RULES = ("short", "repeats", "symbols", "lines", "any")


def beta_prior(hosts: int, n: float, failed: float, squares: float, rates: float) -> tuple[float, float]:
    """(mean, weight) of the beta prior of a rule; an infinite weight holds all hosts at the mean.

    ``squares`` is the sum of n**2 of the hosts, ``rates`` that of failed**2 / n.
    """
    mean = failed / n
    free = n - squares / n - (hosts - 1)
    if not 0 < mean < 1 or free <= 1e-9 * n:
        return mean, np.inf
    within = (rates - mean * mean * n) / (mean * (1 - mean)) - (hosts - 1)
    share = min(within / free, 0.999)  # correlation of the documents of a host
    return (mean, 1 / share - 1) if share > 1e-12 else (mean, np.inf)


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n, one shrunk rate per rule, rejected) from documents with a flag per rule."""
    hosts = settle(judged.filter("host is not null").groupBy("host").agg(
        F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES)
    ))
    n = F.col("n").cast("double")
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("squares"),
        *(F.sum(F.col(r).cast("double")).alias(f"{r}_failed") for r in RULES),
        *(F.sum(F.col(r).cast("double") * F.col(r) / n).alias(f"{r}_rates") for r in RULES),
    ).first()
    rates = {}
    for r in RULES:
        if not sums["hosts"]:
            rates[r] = F.lit(0.0)
            continue
        mean, weight = beta_prior(
            sums["hosts"], sums["n"], sums[f"{r}_failed"], sums["squares"], sums[f"{r}_rates"])
        rates[r] = F.lit(mean) if np.isinf(weight) else (F.col(r) + weight * mean) / (n + weight)
    return hosts.select("host", "n", *(c.alias(r) for r, c in rates.items())).withColumn(
        "rejected", F.greatest(*RULES) > HOST_LIMIT
    )


def host_rules(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source"
) -> DataFrame:
    """(doc_id, host, measures, a flag per rule, rejected, kept) of every document row."""
    texts = docs.select(
        F.col(id_column).alias("doc_id"), F.col(host_column).alias("host"),
        F.col(text_column).cast("binary").alias("raw"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = f"doc_id {kinds['doc_id']}, host {kinds['host']}, " + ", ".join(f"{m} long" for m in MEASURES)
    broken = rules()
    judged = settle(
        texts.mapInArrow(_measure, schema)
        .select("*", *(condition.alias(r) for r, condition in broken.items()))
        .withColumn("any", F.greatest(*broken))
    )
    bad = settle(host_rates(judged).filter("rejected").select("host", "n", "rejected"))
    left, right = lanes_for_join(judged, bad, "host", F.col("doc_id"), judged.count())
    return (
        left.join(small_side(settle(right.drop("n"))), ["host", "lane"], "left")
        .withColumn("rejected", F.coalesce("rejected", F.lit(False)))
        .select("doc_id", "host", *MEASURES, *RULES, "rejected",
                (~F.col("any") & ~F.col("rejected")).alias("kept"))
    )
