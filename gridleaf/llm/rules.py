"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only read the bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_rows
from .words import repeated_words

WINDOW = 8

#: Measurements of one text, in ledger order.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bars", "n_bangs", "n_upper", "n_letters"]

#: Rule -> condition on the measurements under which a document fails. Bit i of the mask is rule i.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "bars_between_words": "n_words >= 20 AND 100 * n_bars > 20 * n_words",
    "shouting": "n_words >= 20 AND 100 * n_upper > 60 * n_letters AND 100 * n_bangs > 20 * n_words",
    "long_words": "word_chars > 40 * n_words",
}

#: Versioned policies: the rules whose failure removes a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": list(RULES),
}

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
SPACES = str.maketrans("", "", " \t\n\r\x0b\x0c")


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text. Null and empty texts measure zero everywhere."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[str] = set()
    lines = duplicates = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    upper, lower = len(data) - len(data.translate(None, UPPER)), len(data) - len(data.translate(None, LOWER))
    return (
        len(words), len(text.translate(SPACES)) if not text.isascii() else sum(map(len, words)),
        len(data) - len(data.translate(None, SYMBOLS)), duplicates, repeated_words(words, WINDOW),
        lines, data.count(b" |"), data.count(b"!!"), upper, upper + lower,
    )


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the measurements and ``failed``: one bit for each rule of ``RULES`` that the document fails.

    One row for each input row (repeated rows stay repeated, null keys stay null). A null text counts as empty: it has
    no words and fails ``few_words``. No shuffle; memory is bounded by one Arrow batch and one text.
    """

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for name, value in rows:
            yield (name, *measure(value))

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    measured = map_rows(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("bigint")).withColumnRenamed("key", key)


def policy_mask(policy: str) -> int:
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[policy])


def fails(policy: str, failed: str = "failed") -> Column:
    """True where the ledger's bits meet the policy's."""
    return F.col(failed).bitwiseAND(F.lit(policy_mask(policy))) != 0


def ablations(book: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """``policy, rule, removed, removed_only_by``: documents a rule removes, and those that no other rule of the policy does.

    The ledger is first reduced to one count for each mask (at most 2 ** rules rows, combined before the shuffle). A
    policy over an empty ledger has rows of zero.
    """
    masks = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    sums = []
    for policy in policies or list(POLICIES):
        whole = policy_mask(policy)
        for rule in POLICIES[policy]:
            bit = 1 << list(RULES).index(rule)
            hit = F.col("failed").bitwiseAND(F.lit(bit)) != 0
            alone = F.col("failed").bitwiseAND(F.lit(whole)) == bit
            sums.append(F.struct(
                F.lit(policy).alias("policy"), F.lit(rule).alias("rule"),
                F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("removed"),
                F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("removed_only_by"),
            ))
    return masks.agg(F.array(*sums).alias("all")).select(F.inline("all"))


def rule_ledger(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    book = ledger(docs)
    return book.withColumn("base_failed", fails("base")).withColumn("kept", ~fails("base") & ~fails(policy))
