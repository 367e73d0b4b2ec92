"""Quality rules: base counts, then distribution divergence from language references. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The most common function words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by are this at from or an not have which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
#: Character classes, in order; what none of them takes is the last class.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": r"\x20\x09-\x0D", "mark": r".,;:!?'\"()\-"}
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _windows(words: Column) -> Column:
    """Hashes of the 3-word windows; none in a text of fewer words."""
    keys = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(keys)


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two share arrays in bits; its square root is the distance."""
    side = lambda x, m: F.when(x > 0, x / 2 * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: side(x, (x + y) / 2) + side(y, (x + y) / 2))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def _shares(counts: Column, whole: Column) -> Column:
    """Shares of a whole, and last what is left of it."""
    parts = F.transform(counts, lambda x: x.cast("double") / F.greatest(whole, F.lit(1)))
    return F.concat(parts, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x))))


def document_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """df's columns with q_* counts of each whole text beside them; one scan, no shuffle."""
    lists = [F.when(F.col(lang) == k, F.array(*map(F.lit, v))) for k, v in COMMON_WORDS.items()]
    none = F.array().cast("array<string>")
    listed = sorted({w for v in COMMON_WORDS.values() for w in v})
    size = lambda c: F.size(c).cast("bigint")
    # each array stands in a column of its own, used twice at least, so that no lambda computes it again
    out = df.withColumn("q_text", F.coalesce(F.col(text), F.lit(""))).withColumn("q_common", F.coalesce(*lists, none))
    out = out.withColumn("q_words", F.array_remove(F.split("q_text", r"[\x20\x09-\x0D]+"), ""))
    out = out.withColumn("q_hits", F.transform(F.filter("q_words", lambda w: F.lower(w).isin(listed)), F.lower))
    out = out.withColumn("q_keys", _windows(F.col("q_words")))
    distinct = F.size(F.array_distinct("q_keys")) == F.size("q_keys")
    pairs = F.transform("q_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    out = out.withColumn("q_ordered", F.when(~distinct, F.sort_array(pairs)).otherwise(F.array().cast("array<struct<k:bigint,i:int>>")))
    same = lambda s, j: F.coalesce(F.get("q_ordered", j)["k"] == s["k"], F.lit(False))
    out = out.withColumn("q_again", F.filter("q_ordered", lambda s, j: same(s, j - 1) | same(s, j + 1)))
    places = F.array_distinct(F.flatten(F.transform("q_again", lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    out = out.withColumn("q_lines", F.filter(F.split("q_text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0))
    # lower-case letters and spaces are most of a text; the other classes are counted in what is left of it
    out = out.withColumn("q_rest", F.regexp_replace("q_text", rf"[{CLASSES['lower']}{CLASSES['space']}]+", ""))
    out = out.withColumn("q_chars", F.length("q_text").cast("bigint")).withColumn("q_word_chars", F.length(F.array_join("q_words", "")).cast("bigint"))
    left = F.length("q_rest")
    of = {c: left - F.length(F.regexp_replace("q_rest", f"[{CLASSES[c]}]+", "")) for c in ("upper", "digit", "mark")}
    of |= {"lower": F.col("q_word_chars") - left, "space": F.col("q_chars") - F.col("q_word_chars")}
    return out.withColumns(
        {
            "q_n_words": size("q_words"),
            "q_n_symbols": (left - F.length(F.translate("q_rest", SYMBOLS, ""))).cast("bigint"),
            "q_n_dup_lines": size("q_lines") - size(F.array_distinct("q_lines")),
            "q_n_repeat_words": size(places),
            "q_n_hits": size("q_hits"),
            "q_classes": F.array(*[of[c].cast("bigint") for c in CLASSES]),
            "q_hist": F.transform("q_common", lambda x: F.size("q_hits") - F.size(F.array_remove("q_hits", x))),
        }
    ).drop("q_text", "q_common", "q_words", "q_keys", "q_ordered", "q_again", "q_lines", "q_hits", "q_rest")


def language_references(counted: DataFrame) -> DataFrame:
    """Per language (q_lang), the class shares and common-word shares over the rows of counted."""
    k = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.get("q_classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get("q_hist", F.lit(i))).alias(f"w{i}") for i in range(k)]
    total = counted.groupBy(F.col("q_lang").alias("ref_lang")).agg(F.sum("q_chars").alias("ref_chars"), F.sum("q_n_words").alias("ref_words"), *sums)
    total = total.withColumn("c", F.array(*[f"c{i}" for i in range(len(CLASSES))])).withColumn("w", F.array(*[f"w{i}" for i in range(k)]))
    listed = F.array_compact("w")
    return total.select("ref_lang", "ref_words", _shares(F.col("c"), F.col("ref_chars")).alias("ref_classes"), _shares(listed, F.col("ref_words")).alias("ref_common"))


def diverge(counted: DataFrame, refs: DataFrame, min_chars: int, min_words: int, min_reference_words: int) -> DataFrame:
    """counted with char_js and word_js against refs; null where a guard holds."""
    out = counted.join(refs, F.col("q_lang").eqNullSafe(F.col("ref_lang")), "left")
    known = F.col("ref_words") >= min_reference_words
    char_js = _divergence(_shares(F.col("q_classes"), F.col("q_chars")), F.col("ref_classes"))
    word_js = _divergence(_shares(F.col("q_hist"), F.col("q_n_words")), F.col("ref_common"))
    out = out.withColumn("char_js", F.when(known & (F.col("q_chars") >= min_chars), F.round(char_js, 6)))
    out = out.withColumn("word_js", F.when(known & (F.col("q_n_words") >= min_words) & (F.size("q_hist") > 0), F.round(word_js, 6)))
    return out.drop("ref_lang", "ref_words", "ref_classes", "ref_common")


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", max_char_js: float = 0.025, max_word_js: float = 0.085, min_chars: int = 200, min_words: int = 100, min_reference_words: int = 1000, references: DataFrame | None = None) -> DataFrame:
    """Base counts and the verdict of distribution divergence, one row per input row.

    A document that fails no base rule is rejected if its character classes diverge from
    its language's by more than max_char_js * (1 + 600 / characters) bits, as short texts
    scatter more, or its common words by more than max_word_js. Minimum-length guards: the first test needs min_chars characters, the
    second min_words words and a language with a word list; both need a reference of
    min_reference_words words. references (from language_references) can come from
    another corpus. By default they come from df, twice: from all documents that pass
    the base rules, and again from those of them that also pass twice these limits
    against the first references, so that what is to be rejected does not shape them.

    Null and empty texts have no words and fail the base rules. Null or unlisted languages
    are languages of their own, without the word test. Very long texts are counted whole. Repeated rows and ids are rows of
    their own. Extra columns are ignored. Empty input gives an empty result.
    """
    picked = df.select(F.col(id).alias("q_id"), F.col(lang).alias("q_lang"), F.col(text).cast("string").alias("q_body"))
    counted = document_counts(picked, "q_body", "q_lang").drop("q_body")
    out = _judged(counted, max_char_js, max_word_js, (min_chars, min_words, min_reference_words), references)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(F.col("q_id").alias(id), *[F.col(f"q_{n}").alias(n) for n in names], "char_js", "word_js", "kept")


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", max_char_js: float = 0.025, max_word_js: float = 0.085, min_chars: int = 200, min_words: int = 100, min_reference_words: int = 1000, references: DataFrame | None = None) -> DataFrame:
    """df's rows that quality_rules keeps, in df's columns. The rows are written once with their counts, so no join and no shuffle moves a text."""
    names = [f"x_{i}" for i in range(len(df.columns))]
    wide = df.toDF(*names)
    wide = wide.select("*", F.col(names[df.columns.index(lang)]).alias("q_lang"), F.col(names[df.columns.index(text)]).cast("string").alias("q_body"))
    counted = document_counts(wide, "q_body", "q_lang").drop("q_body")
    out = _judged(counted, max_char_js, max_word_js, (min_chars, min_words, min_reference_words), references)
    return out.where("kept").select(*names).toDF(*df.columns)


def _judged(counted: DataFrame, max_char_js: float, max_word_js: float, guards: tuple[int, int, int], references: DataFrame | None) -> DataFrame:
    """counted, written, with q_base_failed, char_js, word_js and kept."""
    scratch = Scratch(counted.sparkSession, "quality")
    failed = (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))
    counted = scratch.table(counted.withColumn("q_base_failed", failed), "counts")
    fits = lambda x: (F.coalesce("char_js", F.lit(0.0)) <= x * max_char_js * (1 + 600 / F.greatest("q_chars", F.lit(1)))) & (F.coalesce("word_js", F.lit(0.0)) <= x * max_word_js)
    if references is None:
        sound = counted.where("not q_base_failed")
        first = scratch.table(language_references(sound), "references")
        references = scratch.table(language_references(diverge(sound, first, *guards).where(fits(2))), "references")
    out = diverge(counted, references, *guards)
    return out.withColumn("kept", ~F.col("q_base_failed") & fits(1))
