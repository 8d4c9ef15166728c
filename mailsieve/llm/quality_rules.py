r"""Operator 11, quality rules as weak supervision.

Every rule of ``RULES`` looks at one figure of a whole text and votes that the
document is good, that it is bad, or abstains. No rule decides alone: the rules
have unknown accuracies, which expectation-maximisation estimates from how they
agree over all documents, with a document's true quality as the hidden variable.
A document's posterior probability of being good, ``quality``, replaces the test
that all rules be passed; it is kept from ``MIN_QUALITY`` on.

Documents with the same votes are alike to the model, so the estimation reads one
row per pattern of votes: at most 3 to the number of rules, whatever the number
of documents. It is a fold over the rounds inside one row. The figures are
computed in the row of the document, without a shuffle, and written once, as both
the patterns and the verdicts need them.

Windows of eight words that occur twice are found by hash first; the positions
that share a hash, which are few, are then compared by their words.

Besides the votes the base rule holds: documents of fewer than ``MIN_WORDS``
words, or with over 30 % of words in repeated windows, are never kept.

Defined results: null counts as empty; a text without words has figures of 0, all
rules abstain, and it fails the base rule. Rows that repeat an id are judged one
by one. An empty table gives an empty result. Other columns are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.patterns import let
from mailsieve.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
#: A word without a letter or digit.
LOOSE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]++(?![^\x20\x09-\x0D])"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
MIN_QUALITY = 0.5
#: The bits of a position; no text has more words.
_PLACES = (1 << 30) - 1
#: Rounds of estimation.
ROUNDS = 25
#: How often a rule that votes is right, on good and on bad documents: where the estimation
#: starts, with the weight of ten documents, and the bounds it keeps. A rule calls few good
#: documents bad, else it would be no rule; most defects are seen by some rules only.
ON_GOOD, ON_BAD = (0.985, 0.98, 0.995), (0.5, 0.2, 0.9)
WEIGHT = 10.0

#: Rule: (figure, part of which figure, good at, bad at). The quotient votes good on the
#: side of the first bound and bad on the side of the second; between them it abstains.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.05, 0.15),
    "capitals": ("n_upper", "n_letters", 0.20, 0.50),
    "exclamations": ("n_exclaimed", "n_words", 0.10, 0.30),
    "letters": ("n_letters", "word_chars", 0.85, 0.70),
    "sentence_ends": ("n_ends", "n_words", 0.02, 0.005),
    "loose_marks": ("n_loose", "n_words", 0.05, 0.15),
    "line_copies": ("n_dup_lines", "n_lines", 0.10, 0.40),
    "repeats": ("n_repeat_words", "n_words", 0.15, 0.35),
    "stutter": ("n_stutter", "n_words", 0.05, 0.30),
}


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("bigint")


def _with_equal_neighbour(sorted_: Column, same) -> Column:
    """The rows of a sorted array that are the ``same`` as the one before or after them."""
    return let(
        sorted_,
        lambda rows: F.filter(
            rows,
            lambda x, i: F.coalesce(same(F.get(rows, i - 1), x), F.lit(False))
            | F.coalesce(same(F.get(rows, i + 1), x), F.lit(False)),
        ),
    )


def _window_hashes(words: Column, hash_of) -> Column:
    """A hash of every window: of pairs of words, then of pairs of pairs, then of two such fours."""

    def with_next(reach: int):
        return lambda h: F.zip_with(h, F.slice(h, reach + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    joined = F.transform(words, lambda w: hash_of(w))
    for reach in (1, 2, 4):
        joined = let(joined, with_next(reach))
    return F.slice(joined, 1, F.size(words) - WINDOW + 1)


def repeated_words(words: Column, hash_of=F.xxhash64) -> Column:
    """How many of the words lie in a window that the text holds twice or more."""
    none = F.lit(0).cast("bigint")

    def positions(hashes: Column) -> Column:
        """Where windows begin whose hash another has: its high bits and the position in one number, as that sorts fast."""
        packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(~_PLACES).bitwiseOR(i.cast("bigint"))))
        shared = _with_equal_neighbour(packed, lambda a, b: a.bitwiseXOR(b).between(0, _PLACES))
        return F.transform(shared, lambda x: x.bitwiseAND(_PLACES).cast("int"))

    def exact(hashes: Column, held: Column) -> Column:
        again = F.transform(
            positions(hashes),
            lambda i: F.struct(F.array_join(F.slice(held, i + 1, WINDOW), " ").alias("words"), i.alias("at")),
        )
        equal = _with_equal_neighbour(F.sort_array(again), lambda a, b: a["words"] == b["words"])
        return F.aggregate(
            F.sort_array(F.transform(equal, lambda x: x["at"])),
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total")),
            lambda a, i: F.struct(
                (i + WINDOW).alias("end"), (a["total"] + i + WINDOW - F.greatest(a["end"], i)).alias("total")
            ),
            lambda a: a["total"],
        )

    def counted(held: Column) -> Column:
        return let(
            _window_hashes(held, hash_of),
            lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), exact(hashes, held)).otherwise(none),
        )

    # The copy is an array of objects, of which a slice costs what it holds.
    return F.when(F.size(words) > WINDOW, let(F.transform(words, lambda w: w), counted)).otherwise(none)


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.xxhash64) -> DataFrame:
    """Per row: the id and the figures of its whole text."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda l: F.translate(l, BLANKS, "") != ""))
    return rows.select(
        id_col, F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        _without(text, f"[^{SYMBOLS}]++").alias("n_symbols"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words"), hash_of).alias("n_repeat_words"),
        _without(text, r"[^\p{L}]++").alias("n_letters"), _without(text, r"[^\p{Lu}]++").alias("n_upper"),
        _without(text, "[^!]++").alias("n_exclaimed"), _without(text, "[^.!?]++").alias("n_ends"),
        # Words that repeat the one before; words of marks alone.
        F.size(F.filter("words", lambda w, i: (i > 0) & (w == F.get("words", i - 1)))).cast("bigint").alias("n_stutter"),
        F.regexp_count("text", F.lit(LOOSE)).cast("bigint").alias("n_loose"),
    )


def vote(rule: str) -> Column:
    """1 for good, -1 for bad, 0 where the rule abstains."""
    part, whole, good, bad = RULES[rule]
    share = F.col(part) / F.nullif(F.col(whole), F.lit(0))
    is_good, is_bad = (share <= good, share >= bad) if good < bad else (share >= good, share <= bad)
    return F.when(is_good, 1).when(is_bad, -1).otherwise(0)


def with_votes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("votes", F.array(*(vote(rule) for rule in RULES)))


def _sum(rows: Column, value) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda total, row: total + value(row))


def _posterior(model: Column, votes: Column) -> Column:
    """The probability of good, given the votes: each weighs as its rule is right on good and on bad documents."""
    weights = F.zip_with(
        votes,
        F.arrays_zip(model["on_good"].alias("good"), model["on_bad"].alias("bad")),
        lambda v, a: F.when(v > 0, F.log(a["good"] / (1 - a["bad"])))
        .when(v < 0, F.log((1 - a["good"]) / a["bad"]))
        .otherwise(0.0),
    )
    odds = F.log(model["prior"] / (1 - model["prior"])) + F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.exp(-odds))


def _model(prior: Column, on_good: Column, on_bad: Column) -> Column:
    return F.struct(prior.alias("prior"), on_good.alias("on_good"), on_bad.alias("on_bad"))


def _improved(model: Column, patterns: Column, rules: int) -> Column:
    """One round: posteriors under the model, then the model that fits them best."""
    judged = F.transform(
        patterns,
        lambda p: F.struct(
            p["votes"].alias("votes"), (p["n"] * _posterior(model, p["votes"])).alias("good"), p["n"].alias("n")
        ),
    )

    def rates(rows: Column, sign: int, weight, bounds: tuple[float, float, float]) -> Column:
        """By rule, the share of ``sign`` among its votes, of documents that count by ``weight``."""
        start, least, most = bounds

        def rate(rule: Column) -> Column:
            right = _sum(rows, lambda p: F.when(p["votes"][rule] == sign, weight(p)).otherwise(0.0))
            cast = _sum(rows, lambda p: F.when(p["votes"][rule] != 0, weight(p)).otherwise(0.0))
            return F.greatest(F.lit(least), F.least(F.lit(most), (right + WEIGHT * start) / (cast + WEIGHT)))

        return F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), rate)

    return let(
        judged,
        lambda rows: _model(
            (_sum(rows, lambda p: p["good"]) + WEIGHT / 2) / (_sum(rows, lambda p: p["n"]) + WEIGHT),
            rates(rows, 1, lambda p: p["good"], ON_GOOD),
            rates(rows, -1, lambda p: p["n"] - p["good"], ON_BAD),
        ),
    )


def estimate(voted: DataFrame, rounds: int = ROUNDS, rules: int = len(RULES)) -> DataFrame:
    """One row: prior, the accuracies on good and on bad documents (by rule), and the patterns of votes they come from."""
    counted = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    # One row a pattern: at most 3 ** rules of them.
    patterns = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    start = _model(F.lit(0.5), F.array_repeat(F.lit(ON_GOOD[0]), rules), F.array_repeat(F.lit(ON_BAD[0]), rules))
    fitted = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), start, lambda model, _: _improved(model, F.col("patterns"), rules)
    )
    return patterns.withColumn("model", fitted).select("model", "patterns")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.xxhash64
) -> DataFrame:
    """Per row: id, n_words, the base figures, base_failed, votes, quality, kept."""
    rows = stage(with_votes(figures(docs, id_col, text_col, hash_of)), "figures")
    model = stage(estimate(rows), "accuracies")
    judged = model.select("model", F.explode("patterns").alias("p")).select(
        F.col("p.votes").alias("votes"), _posterior(F.col("model"), F.col("p.votes")).alias("quality")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    # The verdicts are one row a pattern, too.
    return rows.join(F.broadcast(judged), "votes").select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "votes",
        "quality", (~failed & (F.col("quality") >= MIN_QUALITY)).alias("kept"),
    )
