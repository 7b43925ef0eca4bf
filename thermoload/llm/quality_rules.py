"""Quality rules by distribution divergence, in built-in column functions only.

Two histograms of a document are compared to language references:

* character classes: a-z, A-Z, 0-9, white space, other ASCII, beyond ASCII;
* common words: one bin for each of the languages' most frequent words, as the corpus has them, and one for all others.

The languages are those that at least ``LANGUAGE_SHARE`` of the documents name in ``lang`` (50 at most, whatever the corpus),
their common words the ``WORDS`` most frequent ones of all their documents (a grouped count).
A language's reference is the sum of the histograms of all documents whose
``lang`` names it, so it covers the whole corpus; it follows from the same word counts. A text whose own language has no reference is not judged
by those of others: only the base rules hold for it. The divergence is the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) to the
nearest reference. Each comparison has a minimum-length guard: a text with
fewer than ``min_chars`` characters or ``min_words`` words is not judged by it.

The base rules need no reference: too few words, or too many words inside
repeated 5-word windows (windows are compared by a 64-bit hash within one text).

The whole measurement is one struct expression, so Spark evaluates it once per
row. Only the references and the common words reach the driver: at most one row for each language, and
``WORDS`` words. Nothing is shuffled but partial sums and word counts.

Edge cases: a null or blank text has 0 words and fails the base rule; a null or
rare ``lang`` adds to no reference and is judged by the base rules; without any reference (an empty table, or
no language) the divergence rules reject nothing; repeated rows are judged
one by one, and other columns pass through untouched.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, let, words, written

WORDS = 10                # common words of a language
LANGUAGE_SHARE = 0.02     # of the documents with a language
CLASSES, SPACES = 6, 3
MIN_WORDS = 10            # base rule
MAX_REPEAT_PERCENT = 20   # base rule
WINDOW = 5
# Measured (README): good texts reach 0.25 at most, but for a few short ones; symbols glued to words begin at 0.31.
CHAR_DISTANCE = 0.25
# Measured from 120 words on: good texts reach 0.23; a text without any common word is about 0.31 away.
WORD_DISTANCE = 0.25
GUARD_CHARS = 100
GUARD_WORDS = 120


def bins(common: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(w for ws in common.values() for w in ws))


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def class_counts(text: Column) -> Column:
    """Six counts of characters: each class is taken out of what the earlier ones left."""
    def spaces(rest: Column) -> Column:
        def upper(rest2: Column) -> Column:
            def digits(rest3: Column) -> Column:
                def beyond(rest4: Column) -> Column:
                    far = F.length(_without(rest4, r"[\x00-\x7F]+"))
                    return F.array(F.length(text) - F.length(rest), F.length(rest2) - F.length(rest3),
                                   F.length(rest3) - F.length(rest4), F.length(rest) - F.length(rest2),
                                   F.length(rest4) - far, far)
                return let(_without(rest3, "[0-9]+"), beyond)
            return let(_without(rest2, "[A-Z]+"), digits)
        return let(_without(rest, SPACE), upper)
    return let(_without(text, "[a-z]+"), spaces)


def common_counts(ws: Column, listed: list[str]) -> Column:
    """One count per listed word, then the count of all other words."""
    found = F.sort_array(F.filter(F.transform(ws, F.lower), lambda w: w.isin(listed)))

    def runs(hits: Column) -> Column:
        """Each word's count is the distance between the starts of runs of the sorted hits."""
        first = F.filter(F.transform(hits, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                         lambda x: (x["i"] == 0) | (x["w"] != F.get(hits, x["i"] - 1)))

        def dense(starts: Column) -> Column:
            counts = F.map_from_entries(F.transform(starts, lambda x, i: F.struct(
                x["w"], F.coalesce(F.get(starts, i + 1)["i"], F.size(hits)) - x["i"])))
            return let(counts, lambda c: F.concat(
                F.transform(F.array(*map(F.lit, listed)), lambda k: F.coalesce(F.try_element_at(c, k), F.lit(0))),
                F.array(F.size(ws) - F.size(hits))))
        return let(first, dense)
    return let(found, runs)


def repeat_words(ws: Column) -> Column:
    """Words inside 5-word windows that the text has twice or more."""
    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(order: Column) -> Column:
        twice = F.filter(order, lambda s, i: (s["k"] == F.get(order, i - 1)["k"])
                         | (s["k"] == F.get(order, i + 1)["k"]))
        return let(F.sort_array(F.transform(twice, lambda s: s["p"])), covered)

    def by_window(h: Column) -> Column:
        # the last four start no window; hashed over fewer words, they equal nothing
        keys = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, WINDOW)]))

        def if_any(k: Column) -> Column:
            order = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("p"))))
            return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(let(order, repeated))
        return let(keys, if_any)

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(let(hashed, by_window))


def nearest(counts: Column, references: list[list[float]]) -> Column:
    """Jensen-Shannon distance of a histogram to the nearest reference of probabilities.

    With s = p + q the divergence is (sum p log p + sum q log q - sum s log s) / 2 + 1 in
    bits, so only the last sum is made once per reference.
    """
    def xlogx(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + xlogx(x))

    def shares(n: Column) -> Column:
        return let(F.transform(counts, lambda x: x / n), lambda p: let(total(p), lambda own: F.least(*[
            (own + float(sum(q * math.log2(q) for q in ref if q > 0))
             - total(F.zip_with(p, F.array(*map(F.lit, ref)), lambda x, q: x + q))) / 2 + 1
            for ref in references + references[:1]])))
    n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), let(n, shares)))


def languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, int]:
    """The languages that enough documents name, and the characters of their texts."""
    named = docs.filter(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("__lang")).agg(F.count(F.lit(1)).alias("n"))
    total = named.agg(F.sum("n").alias("n")).first()["n"] or 0
    enough = [r["__lang"] for r in named.filter(F.col("n") >= LANGUAGE_SHARE * total).collect()]  # 1 / LANGUAGE_SHARE at most
    chars = docs.filter(F.col(lang).isin(enough)).groupBy(F.col(lang).alias("__lang")).agg(
        F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars"))
    return {r["__lang"]: r["chars"] for r in chars.sort("__lang").collect()}


def word_counts(docs: DataFrame, langs: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``__lang``, ``w``, ``n``: how often each word, as it is spelt, stands in the texts of a language."""
    rows = docs.filter(F.col(lang).isin(langs)).select(F.col(lang).alias("__lang"), F.explode(words(text)).alias("w"))
    return rows.groupBy("__lang", "w").agg(F.count(F.lit(1)).alias("n"))


def common_words(counts: DataFrame, langs: list[str]) -> dict[str, list[str]]:
    """The most frequent lower-cased words of each language; ties go to the smaller word."""
    lower = counts.groupBy("__lang", F.lower("w").alias("w")).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy(F.desc("n"), "w"))
    out = {x: [] for x in langs}
    for r in lower.withColumn("rank", rank).filter(F.col("rank") <= WORDS).sort("__lang", "rank").collect():
        out[r["__lang"]].append(r["w"])
    return out


def references(counts: DataFrame, chars: dict[str, int], common: dict[str, list[str]]) -> tuple[list[list[float]], list[list[float]]]:
    """Class and word references of the languages, from their word counts alone: a text's characters are those of
    its words and white space."""
    listed = bins(common)
    classes = counts.groupBy("__lang").agg(F.sum("n").alias("n"), F.array(*[
        F.sum(F.col("n") * class_counts(F.col("w"))[i]) for i in range(CLASSES)]).alias("c"))
    lower = F.lower("w")
    found = {(r["__lang"], r["w"]): r["n"] for r in counts.filter(lower.isin(listed)).groupBy("__lang", lower.alias("w"))
             .agg(F.sum("n").alias("n")).collect()}  # at most one row per language and listed word
    out = ([], [])
    for row in sorted(classes.collect(), key=lambda r: r["__lang"]):  # at most one row per language
        c = list(row["c"])
        c[SPACES] = chars[row["__lang"]] - sum(c)
        w = [found.get((row["__lang"], x), 0) for x in listed]
        for side, n in zip(out, (c, [*w, row["n"] - sum(w)])):
            side.append([x / sum(n) for x in n])
    return out


def verdict(text: str, refs: tuple[list[list[float]], list[list[float]]],
            common: dict[str, list[str]], lang: str = "lang", char_distance: float = CHAR_DISTANCE,
            word_distance: float = WORD_DISTANCE, min_chars: int = GUARD_CHARS,
            min_words: int = GUARD_WORDS) -> Column:
    """Struct of the measures and decisions for one text column and its language."""
    t = F.coalesce(F.col(text), F.lit(""))
    listed = bins(common)
    known = F.col(lang).isin(list(common))
    class_refs, word_refs = refs

    def measure(ws: Column) -> Column:
        def rest(classes: Column) -> Column:
            lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
            inked = F.length(t) - classes[SPACES]
            far_c = F.when(known & (F.length(t) >= min_chars) & (inked > 0),
                           nearest(classes, class_refs)) if class_refs else F.lit(None).cast("double")
            far_w = F.when(known & (F.size(ws) >= min_words),
                           nearest(common_counts(ws, listed), word_refs)) if word_refs else F.lit(None).cast("double")
            return F.struct(
                F.size(ws).cast("long").alias("n_words"),
                inked.cast("long").alias("word_chars"),
                F.length(_without(t, "[^#*$%&|<>]+")).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeat_words(ws).cast("long").alias("n_repeat_words"),
                far_c.alias("char_distance"), far_w.alias("word_distance"))
        return let(class_counts(t), rest)

    def decide(m: Column) -> Column:
        base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        odd_c = F.coalesce(m["char_distance"] > char_distance, F.lit(False))
        odd_w = F.coalesce(m["word_distance"] > word_distance, F.lit(False))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "char_distance", "word_distance"]
        return F.struct(*[m[n].alias(n) for n in names], base.alias("base_failed"),
                        odd_c.alias("odd_characters"), odd_w.alias("odd_words"),
                        (~reduce(Column.__or__, [base, odd_c, odd_w])).alias("kept"))
    return let(let(words(t), measure), decide)


def rules(docs: DataFrame, text: str = "text", lang: str = "lang", common: dict[str, list[str]] | None = None, **params) -> Column:
    """The ``verdict`` by the languages of ``docs``: their words are counted once and give both the common words (or
    those in ``common``) and the references."""
    chars = languages(docs, text, lang)
    counts = written(word_counts(docs, list(chars), text, lang), "words")
    common = common_words(counts, list(chars)) if common is None else common
    refs = references(counts, chars, common)
    discard(counts)
    return verdict(text, refs, common, lang, **params)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", **params) -> DataFrame:
    """``docs`` with one more column, the struct ``verdict`` (an input column of that
    name is replaced)."""
    return docs.withColumn("verdict", rules(docs, text, lang, **params))


def clean(docs: DataFrame, text: str = "text", lang: str = "lang", **params) -> DataFrame:
    """The documents that pass, with their columns."""
    return docs.filter(rules(docs, text, lang, **params)["kept"])
