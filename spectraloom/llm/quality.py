"""Quality rules by distribution divergence, with DataFrame expressions only.

Every document gets two histograms: classes of its characters, and common words of several
languages.  Summed over the sound documents of a language they are that language's reference.
A document is rejected when its Jensen-Shannon distance (base 2, 0 to 1) to the reference is
above a limit; texts below a minimum length are not judged by a histogram they cannot fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import SPACE
from spectraloom.session import settle

# Common words, four languages.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "on",
    "der", "die", "und", "den", "von", "das", "ist", "nicht", "ein", "eine", "auf", "sich",
    "le", "la", "les", "des", "est", "et", "un", "une", "que", "pour", "dans", "pas",
    "el", "los", "las", "por", "con", "una", "para", "se", "y", "en", "de", "du",
)
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "other")
WINDOW = 8
LEAST_CHARS = 200
LEAST_WORDS = 50
#: Limit of a distance: a constant plus a share of 1 / sqrt(words), as short texts scatter more.
CHAR_LIMIT, CHAR_SCATTER = 0.25, 0.5
WORD_LIMIT, WORD_SCATTER = 0.24, 1.5


def _lines() -> str:
    return rf"filter(split(text, '\n', -1), l -> regexp_like(l, r'[^\x20\x09-\x0D]'))"


def features(docs: DataFrame) -> DataFrame:
    """Base counts and both histograms of every row (doc_id, lang kept).

    Null text counts as none.  ``n_repeat_words`` counts the words inside 8-word windows that
    occur twice or more in the text, the first occurrence included.
    """
    text = F.coalesce("text", F.lit(""))
    staged = (
        docs.select("doc_id", "lang", text.alias("text"))
        .withColumn("words", F.expr(f"filter(split(text, r'{SPACE}+', -1), w -> w <> '')"))
        .withColumn("rest", F.regexp_replace("text", "[a-z]+", ""))
        .withColumn("inked", F.regexp_replace("rest", SPACE + "+", ""))
        .withColumn("h", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn("lines", F.expr(_lines()))
    )
    for step in (1, 2, 4):  # hashes of 2, 4, then 8 words in a row
        short = f"greatest(0, size(h) - {step})"
        staged = staged.withColumn(
            "h", F.expr(f"zip_with(slice(h, 1, {short}), slice(h, {step + 1}, {short}), (a, b) -> xxhash64(a, b))")
        )
    staged = staged.withColumn("twice", F.expr("size(array_distinct(h)) < size(h)")).withColumn(
        "sorted",
        F.expr("IF(twice, sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i))), NULL)"),
    )
    staged = staged.withColumn(
        "starts",
        F.expr(
            """IF(sorted IS NULL, NULL, sort_array(transform(filter(
                transform(sorted, (s, j) -> named_struct('i', s.i, 'again',
                    s.x = get(sorted, j - 1).x OR s.x = get(sorted, j + 1).x)),
                s -> coalesce(s.again, false)), s -> s.i)))"""
        ),
    )
    repeated = F.expr(
        f"""coalesce(aggregate(zip_with(starts, slice(starts, 2, greatest(0, size(starts) - 1)),
                (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (s, x) -> s + x), 0L)"""
    )
    common = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    bare = r"lower(regexp_replace(w, r'[.,;:!?]+$', ''))"
    staged = staged.withColumn(
        "spoken", F.expr(f"filter(transform(words, w -> {bare}), w -> w IN ({common}))")
    ).withColumn("spoken_text", F.expr("concat(' ', array_join(spoken, '  '), ' ')"))

    def length(c: str) -> Column:
        return F.length(c).cast("bigint")

    upper, digit = F.regexp_count("inked", F.lit("[A-Z]")), F.regexp_count("inked", F.lit("[0-9]"))
    stop = F.regexp_count("inked", F.lit(r"[.,;:!?'\"()-]"))
    symbol = F.regexp_count("inked", F.lit(r"[#*$%&|<>]"))
    lower, blank = length("text") - length("rest"), length("rest") - length("inked")
    named = [upper, digit, stop, symbol]
    other = length("inked") - sum(named[1:], named[0])
    chars = [lower, upper, digit, blank, stop, symbol, other]
    spoken = [
        ((F.length("spoken_text") - F.length(F.replace("spoken_text", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2))
        for w in COMMON_WORDS
    ]
    return staged.select(
        "doc_id",
        "lang",
        F.size("words").cast("bigint").alias("n_words"),
        (lower + length("inked")).alias("word_chars"),
        symbol.cast("bigint").alias("n_symbols"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)").alias("n_dup_lines"),
        repeated.cast("bigint").alias("n_repeat_words"),
        F.array(*[c.cast("double") for c in chars]).alias("char_hist"),
        F.array(*[c.cast("double") for c in spoken], (F.size("words") - F.size("spoken")).cast("double")).alias(
            "word_hist"
        ),
    )


def _distance(hist: str, reference: str) -> Column:
    """Jensen-Shannon distance of two histograms, each divided by its sum."""

    def part(x: str, y: str) -> str:
        return f"IF({x} > 0, {x} * log2(2 * {x} / ({x} + {y})), 0D)"

    def share(h: str) -> str:
        return f"transform({h}, x -> x / aggregate({h}, 0D, (s, y) -> s + y))"

    return F.expr(
        f"""sqrt(greatest(0D, 0.5 * aggregate(zip_with({share(hist)}, {share(reference)},
            (p, q) -> {part('p', 'q')} + {part('q', 'p')}), 0D, (s, x) -> s + x)))"""
    )


def references(measured: DataFrame) -> DataFrame:
    """``(lang, char_ref, word_ref)``: summed histograms of the sound documents of a language."""
    sound = measured.where("NOT base_failed")
    n_chars, n_words = len(CLASSES), len(COMMON_WORDS) + 1
    return sound.groupBy(F.coalesce("lang", F.lit("")).alias("lang_key")).agg(
        F.array(*[F.sum(F.col("char_hist")[i]) for i in range(n_chars)]).alias("char_ref"),
        F.array(*[F.sum(F.col("word_hist")[i]) for i in range(n_words)]).alias("word_ref"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, distances and verdict of every row of ``docs`` (doc_id, lang, text, ...).

    ``base_failed``: fewer than 20 words, or over 30 % of them repeated.  ``kept`` is false
    for those, else true unless a distance exceeds its limit, which widens for short texts.  Null text has no words and
    fails; a null language is a language of its own; a language without sound documents has
    no failing rows to judge; short texts (under LEAST_CHARS, LEAST_WORDS) are not measured.
    Repeated rows stay; an empty table gives an empty table.
    """
    measured = features(docs).withColumn(
        "base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    )
    measured = settle(measured, "quality")  # counts only: small beside the texts
    judged = measured.withColumn("lang_key", F.coalesce("lang", F.lit(""))).join(
        settle(references(measured), "references"), "lang_key", "left"
    )
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    long = (F.col("n_words") >= LEAST_WORDS) & (F.col("word_chars") >= LEAST_CHARS)
    return judged.withColumns(
        {
            "char_distance": F.when(long, _distance("char_hist", "char_ref")),
            "word_distance": F.when(long, _distance("word_hist", "word_ref")),
        }
    ).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (
            ~F.col("base_failed")
            & (F.coalesce("char_distance", F.lit(0.0)) <= CHAR_LIMIT + CHAR_SCATTER / root)
            & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT + WORD_SCATTER / root)
        ).alias("kept"),
        "char_distance",
        "word_distance",
    )
