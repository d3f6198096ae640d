"""Line-first quality rules (native).

Every line is judged by itself: it must end like a sentence and not be mostly punctuation marks, it must
not be a navigation list, and it must not be boilerplate. Failing lines are removed; a document that loses
more than ``max_loss`` of its characters is rejected.

Nulls, empties and ties: a null text has no words and no lines (all counts 0, base_failed true). A text
without any word fails the base rules. Blank lines neither pass nor fail and weigh nothing. Repeated rows are
judged row by row, an empty table gives no rows. A loss of exactly ``max_loss`` is no reason to reject. Texts of any
length are judged whole, in the memory that a few copies of one text take. Columns other than doc_id and text are
carried by ``clean`` and ignored by ``judge``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import SPACE, SPACE_CHARS, let, unused

#: Characters that may end a sentence, separators of navigation lists, and boilerplate phrases.
SENTENCE_END = ".!?…。！？:;\"'”’»)]"
NAVIGATION_MARKS = "|»›•→"
BOILERPLATE = (
    "(?i)lorem ipsum|\\bcookies?\\b|javascript|terms of (use|service)|privacy policy|all rights reserved"
    "|sign (in|up)|log ?in\\b|subscribe|newsletter|click here|read more|share this|skip to content"
)
#: Of which every match of BOILERPLATE has at least one, in lower case.
BOILERPLATE_PARTS = (
    "lorem ipsum", "cookie", "javascript", "terms of ", "privacy policy", "all rights reserved", "sign in", "sign up", "login",
    "log in", "subscribe", "newsletter", "click here", "read more", "share this", "skip to content",
)
SYMBOLS = "#*$%&|<>"

MAX_LOSS = 0.3


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    """text less some characters; a search for each is faster than translate()."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def line_fails(line: Column) -> Column:
    """True if a non-blank line breaks one of the rules."""
    last = F.substring(F.rtrim(line, F.lit(SPACE_CHARS)), -1, 1)
    marks = F.octet_length(line) - F.octet_length(without(line, SYMBOLS + "!"))
    punctuation = ~F.contains(F.lit(SENTENCE_END), last) | (marks * 10 > F.length(without(line, SPACE_CHARS)))
    navigation = F.length(line) - F.length(without(line, NAVIGATION_MARKS)) >= 2

    def may_be(low: Column) -> Column:
        return functools.reduce(lambda x, y: x | y, [F.contains(low, F.lit(part)) for part in BOILERPLATE_PARTS])

    return punctuation | navigation | (let(F.lower(line), may_be) & line.rlike(BOILERPLATE))


def is_blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACE_CHARS)) == ""


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice, the first place included.

    Windows are compared by hash after a sort inside the row, so no shuffle is needed. A window is one number, its
    hash above its place; a text of n words leaves 64 - log2(n) bits to the hash.
    """

    def covered(w: Column) -> Column:
        windows = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )
        all_differ = lambda h: F.size(F.array_distinct(h)) == F.size(h)
        return let(windows, lambda h: F.when(all_differ(h), 0).otherwise(let(F.length(F.bin(F.size(h).cast("long"))), lambda bits: twice(h, bits))))

    def twice(h: Column, bits: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))

        def alike(s: Column) -> Column:
            """A window is like the next one if the two differ in their places alone."""
            near = F.transform(s, lambda x, k: F.call_function("shiftrightunsigned", x.bitwiseXOR(F.get(s, k + 1)), bits) == 0)
            return let(near, lambda same: F.filter(s, lambda x, k: F.get(same, k) | F.get(same, k - 1)))

        at = F.transform(let(ordered, alike), lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1))
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(F.size(words) >= 4, covered(words)).otherwise(F.lit(0))


def judged_lines(text: Column) -> Column:
    """Every line of a text as (line, blank, fails); each is judged once."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda x: let(is_blank(x), lambda blank: F.struct(x.alias("line"), blank.alias("blank"), (~blank & line_fails(x)).alias("fails"))),
    )


def measures(text: Column, clean_text: bool = False) -> Column:
    """One struct per text: the counts and, with clean_text, the lines that pass as one text."""
    body = F.coalesce(text, F.lit(""))

    def weigh(judged: Column) -> Column:
        found = F.filter(judged, lambda x: ~x["blank"])
        total = F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x["line"]))
        lost = F.aggregate(found, F.lit(0), lambda a, x: a + F.when(x["fails"], F.length(x["line"])).otherwise(0))
        good = F.filter(judged, lambda x: ~x["fails"])
        return F.struct(
            (F.size(found) - F.size(F.array_distinct(F.transform(found, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
            total.cast("long").alias("n_line_chars"),
            lost.cast("long").alias("n_lost_chars"),
            *([F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("good")] if clean_text else []),
        )

    def count(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))

    return F.struct(
        let(words_of(text), count).alias("w"),
        let(judged_lines(text), weigh).alias("l"),
        F.length(without(body, SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.octet_length(body) - F.octet_length(without(body, SYMBOLS))).cast("long").alias("n_symbols"),
    )


def judge(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """doc_id, the counts, n_line_chars, n_lost_chars, base_failed and kept for every row of docs."""
    found = docs.select("doc_id", let(measures(F.col("text")), lambda m: m).alias("m"))
    flat = found.select(
        "doc_id",
        F.col("m.w.n_words").alias("n_words"),
        F.col("m.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.l.n_dup_lines").alias("n_dup_lines"),
        F.col("m.w.n_repeat_words").alias("n_repeat_words"),
        F.col("m.l.n_line_chars").alias("n_line_chars"),
        F.col("m.l.n_lost_chars").alias("n_lost_chars"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.col("n_lost_chars") > F.lit(float(max_loss)) * F.col("n_line_chars")
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~lost)


def clean(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The kept documents, all their columns, with failing lines taken out of text and n_chars recounted."""
    (m,) = unused(docs.columns, "measured")
    marked = docs.withColumn(m, let(measures(F.col("text"), clean_text=True), lambda x: x))
    n, r = F.col(f"{m}.w.n_words"), F.col(f"{m}.w.n_repeat_words")
    lost = F.col(f"{m}.l.n_lost_chars") > F.lit(float(max_loss)) * F.col(f"{m}.l.n_line_chars")
    kept = marked.where((n >= 50) & (100 * r <= 50 * n) & ~lost).withColumn("text", F.col(f"{m}.l.good")).drop(m)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept
