"""Code in free text: blocks, languages, comments, syntax."""

from __future__ import annotations

import ast
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clean_text, strip

#: Tags of fenced blocks that hold data and not code.
DATA_FORMATS = ["json", "yaml", "yml", "xml", "csv", "toml"]
#: What tells a language, in order of trial.
LANGUAGES = {
    "python": [r"(?m)^\s*(def|class|import|from)\s+", r"print\s*\(", r":\s*\n\s+(if|for|while|def|class)"],
    "javascript": [r"\b(const|let|var)\s+\w+\s*=", r"function\s*\w*\s*\(", r"=>\s*\{", r"console\.log\s*\("],
    "java": [r"\bpublic\s+(class|static|void)\s+", r"System\.(out|err)\.print", r"import\s+java\."],
    "c": [r"#include\s*<", r"int\s+main\s*\(", r"printf\s*\("],
    "cpp": [r"#include\s*<\w+>", r"std::", r"cout\s*<<"],
    "go": [r"(?m)^package\s+\w+", r"func\s+\w+\s*\(", r"fmt\.Print"],
    "rust": [r"(?m)^fn\s+\w+\s*\(", r"let\s+mut\s+", r"println!\s*\("],
}


def fenced(c: Column) -> Column:
    """array<struct(code, lang)> of fenced blocks; an unclosed fence still gives one."""
    odd = F.filter(F.split(F.coalesce(c, F.lit("")), "```"), lambda x, i: i % 2 == 1)

    def block(x: Column) -> Column:
        first = F.substring_index(x, "\n", 1)
        tagged = x.contains("\n") & (first != "") & ~first.contains(" ") & (F.length(first) < 20)
        body = F.when(tagged, F.substring(x, F.length(first) + 2, F.length(x))).otherwise(x)
        return F.struct(strip(body).alias("code"), F.when(tagged, F.lower(strip(first))).alias("lang"))

    return F.filter(F.transform(odd, block), lambda b: b["code"] != "")


def unfenced(c: Column) -> Column:
    """Python functions; without any, indented blocks and <code> spans."""
    text = F.coalesce(c, F.lit(""))
    found = lambda p, g=1: F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), strip), lambda x: x != "")
    functions = found(r"(def\s+\w+\s*\([^)]*\)\s*:(?:\n(?:    |\t).+)+)")
    rest = F.concat(found(r"(?s)(?:^|\n)(?:    |\t)(.+?)(?=\n[^\s]|\z)", 0), found(r"(?is)<code>(.*?)</code>"))
    return F.transform(F.when(F.size(functions) > 0, functions).otherwise(rest), lambda x: F.struct(x.alias("code"), detect_language(x).alias("lang")))


def blocks(c: Column) -> Column:
    inside = fenced(c)
    every = F.when(F.size(inside) > 0, inside).otherwise(unfenced(c))
    code = F.filter(every, lambda b: b["lang"].isNull() | ~b["lang"].isin(*DATA_FORMATS))
    return F.when(F.size(code) > 0, code).otherwise(every)


def with_blocks(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with blocks of a text column; the steps are columns of their own, and texts without a fence are searched only where they have one of the other forms."""
    c = F.col(text)
    out = df.withColumn("x_fenced", F.when(c.contains("```"), fenced(c)).otherwise(F.array().cast("array<struct<code:string,lang:string>>")))
    other = c.rlike(r"def\s+\w+\s*\(|(?:^|\n)(?:    |\t)|(?i)<code>")
    out = out.withColumn("x_every", F.when(F.size("x_fenced") > 0, F.col("x_fenced")).when(other, unfenced(c)).otherwise(F.array().cast("array<struct<code:string,lang:string>>")))
    out = out.withColumn("x_kept", F.filter("x_every", lambda b: b["lang"].isNull() | ~b["lang"].isin(*DATA_FORMATS)))
    out = out.withColumn(name, F.when(c.isNotNull(), F.when(F.size("x_kept") > 0, F.col("x_kept")).otherwise(F.col("x_every"))))
    return out.drop("x_fenced", "x_every", "x_kept")


def pick(c: Column, found: Column, mode: str = "last_block") -> Column:
    texts = F.transform(found, lambda b: b["code"])
    one = {"last_block": F.try_element_at(texts, F.lit(-1)), "first_block": F.try_element_at(texts, F.lit(1)), "all_blocks": F.when(F.size(texts) > 0, F.array_join(texts, "\n\n"))}[mode]
    return F.coalesce(one, clean_text(F.coalesce(c, F.lit(""))))


def confidence_of(c: Column, found: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(text == "", 0.0).when(F.size(found) > 0, F.when(text.contains("```"), 0.95).otherwise(0.8)).otherwise(0.3)


def extract(c: Column, mode: str = "last_block") -> Column:
    """The last, the first or all blocks of code; the cleaned text without any."""
    return pick(c, blocks(c), mode)


def confidence(c: Column) -> Column:
    return confidence_of(c, blocks(c))


def post_process(c: Column, without_comments: bool = False) -> Column:
    """Code as it is kept: stripped, on demand without comments; null is ''."""
    out = strip(F.coalesce(c, F.lit("")))
    return strip(strip_comments(out)) if without_comments else out


def detect_language(c: Column) -> Column:
    shebang = F.regexp_extract(c, r"^#!\s*/usr/bin/env\s+(\w+)", 1)
    rules = [(p, lang) for lang, ps in LANGUAGES.items() for p in ps]
    return reduce(lambda w, r: w.when(c.rlike(r[0]), F.lit(r[1])), rules, F.when(shebang != "", shebang))


def extract_function(c: Column, name: str) -> Column:
    pattern = rf"(?s)(def\s+\Q{name}\E\s*\([^)]*\).*?)(?:\n\n|\z)"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1)))


@F.pandas_udf(T.BooleanType())
def syntax_ok(s: pd.Series) -> pd.Series:
    """Whether a text is Python."""

    def ok(code: str | None) -> bool:
        try:
            ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return s.map(ok)


#: A line with a comment: before it, quotes are closed. What is matched is never tried anew, so a line of any length takes no stack.
_COMMENT = r"""(?s)^((?:[^"'#]++|"[^"]*+"|'[^']*+')*+)#.*\z"""


def strip_comments(c: Column) -> Column:
    """Without what follows a # outside quotes, and without lines that are then empty."""
    line = lambda x: F.when(x.rlike(_COMMENT), F.regexp_replace(F.regexp_replace(x, _COMMENT, "$1"), r"(?U)\s+\z", "")).otherwise(x)
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), line), lambda x: strip(x) != ""), "\n")
