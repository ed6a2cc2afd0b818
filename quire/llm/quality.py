"""Quality rules: base limits, then divergence from what the document's language looks like.

A reference is made for each language from the whole corpus: how characters spread over a few
classes in its median document, and how often the language's most common short words occur. A
document is compared with its language's reference by the Jensen-Shannon distance (base 2, from
0 for equal to 1 for disjoint histograms), and fails when a distance is beyond its limit. Classes
are compared twice: with digits as a class of their own, which allows for a long number in a
short text, and with digits among the rest, which is strict about signs. Short documents have
noisy histograms, so each limit widens with 1 / sqrt(words) and every document that passes the
base rules is judged. Small languages have noisy references: their classes lean on those of all
languages together, and the limit for words allows for the reference's noise too.
DataFrame functions only; nothing is exploded for the documents themselves, so their judgement
moves no rows at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import bounded, stored

GAP = r"[\x20\x09-\x0D]+"

#: Last bits of a sorted number that hold a window's place in its text.
PLACE_BITS = 24


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules."""

    #: Base rules.
    least_words: int = 50
    most_repeated_percent: int = 50
    #: Common words of a language: so many, each of at most so many characters.
    common_words: int = 20
    common_letters: int = 4
    #: Distances beyond which a document fails. A histogram of n words strays from its source by
    #: about 1 / sqrt(n), so limits are base + noise / sqrt(n_words); a reference of words strays
    #: too, which makes it noise * sqrt(1 / n_words + 1 / total) there. Chosen on the labelled
    #: documents of sf0.1, see the README.
    most_word_distance: float = 0.18
    word_noise: float = 1.7
    most_class_distance: float = 0.12
    class_noise: float = 1.6
    #: The same for classes with digits among the rest.
    most_sign_distance: float = 0.08
    sign_noise: float = 0.4
    #: Words that a language must have for its own classes to weigh as much as those of all languages.
    least_reference_words: int = 20_000
    #: Languages up to which the references are broadcast.
    most_languages: int = 10_000


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, GAP), "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; the first occurrence counts too.

    Windows are compared by 64-bit hash. Repeated windows are found by sorting (hash, place);
    with their places in order, each adds the words up to the next one, 3 at most. Arrays are
    shifted and zipped whole, which costs less than a lambda that looks up neighbours. Hash and
    place are sorted as one number, whose last ``PLACE_BITS`` bits are the place; where cut
    hashes meet whose whole ones differ, or places need more bits, they are sorted as pairs.
    """
    mask = (1 << PLACE_BITS) - 1
    rest = lambda a, by: F.slice(a, F.lit(1 + by), F.size(a))  # noqa: E731  by 0: the array, without a name of its own

    def counted(zipped: Column) -> Column:
        # the last two windows reach beyond the text
        hashes = F.transform(F.slice(zipped, F.lit(1), F.size(zipped) - 2), lambda x: F.xxhash64(x))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).when(F.size(h) > mask, covered_by_pairs(h)).otherwise(covered(h)))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
        near = lambda a: F.filter(  # noqa: E731  no bit before the place differs
            F.arrays_zip(rest(a, 0), rest(a, 1), F.concat(F.slice(a, 1, 1), a)),
            lambda x, i: F.coalesce(x["0"].bitwiseXOR(x["1"]).between(0, mask), F.lit(False)) | ((i > 0) & F.coalesce(x["0"].bitwiseXOR(x["2"]).between(0, mask), F.lit(False))),
        )
        places = lambda found: F.transform(found, lambda x: x["0"].bitwiseAND(F.lit(mask)).cast("int"))
        whole = lambda p: F.transform(p, lambda i: F.get(hashes, i))
        # as many whole hashes as cut ones, or some cut ones met by chance
        sound = lambda found, p: F.size(F.array_distinct(F.transform(found, lambda x: x["0"].bitwiseAND(F.lit(~mask))))) == F.size(F.array_distinct(whole(p)))
        return let(let(ordered, near), lambda found: let(places(found), lambda p: F.when(sound(found, p), spread(p)).otherwise(covered_by_pairs(hashes))))

    def covered_by_pairs(hashes: Column) -> Column:
        ordered = F.sort_array(F.arrays_zip(rest(hashes, 0), F.sequence(F.lit(1), F.size(hashes))))
        same = lambda a: F.filter(
            F.arrays_zip(rest(a, 0), rest(a, 1), F.concat(F.slice(a, 1, 1), a)),
            lambda x, i: F.coalesce(x["0"]["0"] == x["1"]["0"], F.lit(False)) | ((i > 0) & F.coalesce(x["0"]["0"] == x["2"]["0"], F.lit(False))),
        )
        return spread(F.transform(let(ordered, same), lambda x: x["0"]["1"]))

    def spread(places: Column) -> Column:
        gaps = lambda p: F.transform(F.arrays_zip(rest(p, 0), rest(p, 1)), lambda x: F.least(F.lit(3), F.coalesce(x["1"] - x["0"], F.lit(3))))
        return F.aggregate(let(F.sort_array(places), gaps), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.arrays_zip(rest(words, 0), rest(words, 1), rest(words, 2)), counted))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda a: F.size(a) - F.size(F.array_distinct(a)))


def without(text: Column, pattern: str) -> Column:
    """Characters of a text that a pattern doesn't match."""
    return F.length(F.regexp_replace(text, pattern, ""))


#: Characters of no class that is named here, then the classes: digits, punctuation of prose, other ASCII signs.
MARKS = r"[^0-9.,;:!?'\"()#$%&*+/<=>@\\^_`{|}~\[\]-]+"
CLASSES = {"digits": "[0-9]+", "prose": r"[.,;:!?'\"()-]+", "signs": r"[#$%&*+/<=>@\\^_`{|}~\[\]]+"}


def class_counts() -> Column:
    """Characters by class: white space, digits, punctuation of prose, other signs, the rest."""
    gaps, known = F.col("n_chars") - F.col("word_chars"), [F.col(c) for c in CLASSES]
    left = F.col("word_chars")
    for c in known:
        left = left - c
    return F.array(*(x.cast("double") for x in (gaps, *known, left)))


def mixed_digits(classes: Column) -> Column:
    """The same with digits counted among the rest."""
    return F.array(classes[0], classes[2], classes[3], classes[1] + classes[4])


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as arrays of counts, null if either is empty or null."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))
    shares = lambda a: let(a, lambda own: let(total(own), lambda s: F.when(s > 0, F.transform(own, lambda x: x / s))))
    each = F.zip_with(shares(counts), shares(reference), lambda x, y: (part(x, y) + part(y, x)) / 2)
    return let(total(each), lambda d: F.sqrt(F.when(d < 0, F.lit(0.0)).otherwise(d)))


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, keep: list[str]) -> DataFrame:
    """Each document's text, language, words and counts of characters.

    What is neither a letter nor white space is cut out once and counted by class in what is cut out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")
    kept = [F.col(c).alias(f"kept {c}") for c in keep]
    base = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), text.alias("text"), *kept)
    base = base.withColumns({"words": words_of(F.col("text")), "marks": F.regexp_replace("text", MARKS, "")})
    among = lambda pattern: (F.length("marks") - without(F.col("marks"), pattern)).cast("long")
    counts = {"n_chars": F.length("text").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long")}
    counts |= {"n_words": F.size("words").cast("long"), "n_symbols": among(r"[#*$%&|<>]+")}
    return base.withColumns(counts | {k: among(p) for k, p in CLASSES.items()}).drop("marks")


def short_words(limits: Limits) -> Column:
    """The words of few letters, lower-cased; some that grow by that are among them."""
    return F.transform(F.filter("words", lambda w: F.length(w) <= limits.common_letters), F.lower)


def references(docs: DataFrame, limits: Limits, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """(lang, total, classes, common array<word>, times array): one row for each language, over all documents.

    ``classes`` are medians over documents of the shares, so neither junk nor one long text shapes
    them. Shares are rounded to thousandths, which makes medians exact with a bounded state.
    Words and characters are summed before they move, so a language or a word with a third of
    all occurrences moves as little as any other.
    """
    all_docs = measured(docs, id_col, text_col, lang_col, []).withColumn("classes", class_counts())
    shares = F.when(F.col("n_chars") > 0, F.array(*(F.concat(F.lit(f"{i} "), F.round(F.col("classes")[i] / F.col("n_chars"), 3).cast("string")) for i in range(5))))
    # one histogram of all: short words, "class share" of documents and "" for each document; no word has a blank
    entries = F.concat(short_words(limits), F.coalesce(shares, F.array().cast("array<string>")), F.array(F.lit("")))
    histogram = stored(all_docs.select("lang", "n_words", F.explode(entries).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"), F.sum("n_words").alias("total")), "histogram")
    number, share = F.split("word", " ")[0], F.split("word", " ")[1].cast("double")
    median = lambda i: F.coalesce(F.percentile(F.when(number == str(i), share), 0.5, F.when(number == str(i), F.col("n"))), F.lit(0.0))
    totals = histogram.where("word = '' OR contains(word, ' ')").groupBy("lang").agg(
        F.max(F.when(F.col("word") == "", F.col("total"))).alias("total"), F.array(*(median(i) for i in range(5))).alias("classes")
    )
    times = histogram.where(F.col("word").rlike(rf"^\p{{L}}{{1,{limits.common_letters}}}$")).select("lang", "word", "n")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common = times.withColumn("r", first).where(F.col("r") <= limits.common_words).groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("r", "word", F.col("n").cast("double").alias("n")))).alias("top")
    )
    joined = totals.join(common, "lang", "left")
    return joined.select("lang", "total", "classes", F.col("top.word").alias("common"), F.col("top.n").alias("times"))


def pooled(refs: DataFrame, limits: Limits) -> DataFrame:
    """``refs`` with classes mixed with those over all languages, each weighed by its words.

    The mixture is by words too, without a step: a language of few words is judged by what all
    languages look like, a large one by what it looks like itself.
    """
    every = refs.agg(*(F.sum(F.col("total") * F.col("classes")[i]) / F.greatest(F.sum("total"), F.lit(1)) for i in range(5))).first()
    all_classes = F.array(*(F.lit(x or 0.0) for x in every))
    mixed = F.zip_with("classes", all_classes, lambda x, y: F.col("total") * x + F.lit(limits.least_reference_words) * y)
    return refs.withColumn("classes", mixed)


def quality(
    docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", keep: tuple[str, ...] = ()
) -> DataFrame:
    """The counts and the verdict of every document, over its whole text.

    Row by row after one pass for the references: rows and ids may repeat, ids may be null. A
    null text counts as empty (no words, so it fails the base rules); a null language counts
    as a language of its own; an empty table gives an empty result. ``keep`` names columns to
    carry along, whatever they are called; other columns are not read.

    Returns (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, word_distance, class_distance) and ``keep``; distances are null below ``least_words``.
    """
    limits = limits or Limits()
    refs = pooled(stored(references(docs, limits, id_col, text_col, lang_col), "references"), limits)
    every = measured(docs, id_col, text_col, lang_col, list(keep)).join(bounded(refs, limits.most_languages), "lang", "left")
    # the common words of a text, each with a blank of its own on either side, so neighbours never share one
    spaced = F.concat(F.lit(" "), F.array_join(F.filter(short_words(limits), lambda w: F.array_contains("common", w)), "  "), F.lit(" "))
    rest = lambda counts, total: let(counts, lambda c: F.concat(c, F.array(total - F.aggregate(c, F.lit(0.0), lambda a, x: a + x))))

    def word_counts(padded: Column) -> Column:
        size = F.octet_length(padded)
        found = lambda w: (size - F.octet_length(F.replace(padded, F.concat(F.lit(" "), w, F.lit(" "))))) / (F.octet_length(w) + 2)
        return F.transform("common", lambda w: found(w).cast("double"))

    comparable = F.col("n_words") >= limits.least_words
    counted = every.withColumns(
        {
            "n_dup_lines": duplicate_lines(F.col("text")).cast("long"),
            "n_repeat_words": repeated_words(F.col("words")).cast("long"),
            "own_words": F.when(comparable, let(spaced, word_counts)),
            "own_classes": F.when(comparable, class_counts()),
        }
    ).withColumns(
        {
            "word_distance": distance(rest(F.col("own_words"), F.col("n_words").cast("double")), rest(F.col("times"), F.col("total").cast("double"))),
            "class_distance": distance(F.col("own_classes"), F.col("classes")),
            "sign_distance": distance(mixed_digits(F.col("own_classes")), mixed_digits(F.col("classes"))),
            "base_failed": (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.most_repeated_percent * F.col("n_words")),
        }
    )
    one_in = lambda n: 1 / F.greatest(n, F.lit(1))
    word_limit = limits.most_word_distance + limits.word_noise * F.sqrt(one_in(F.col("n_words")) + one_in(F.col("total")))
    noisy = lambda base, noise: base + noise * F.sqrt(one_in(F.col("n_words")))
    limit_of = {"word": word_limit, "class": noisy(limits.most_class_distance, limits.class_noise), "sign": noisy(limits.most_sign_distance, limits.sign_noise)}
    within = [F.coalesce(f"{k}_distance", F.lit(0.0)) <= limit for k, limit in limit_of.items()]
    near = within[0] & within[1] & within[2]
    return counted.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & near).alias("kept"),
        "word_distance",
        "class_distance",
        *(F.col(f"kept {c}").alias(c) for c in keep),
    )
