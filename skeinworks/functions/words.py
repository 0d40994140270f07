"""Word tokens, and the canonical spelling of slices.

Fixed values: the word rule is lower case, then runs of letters, digits and
underscores, or one other character that is not white space. Spark's and
DuckDB's regular expressions need the Unicode white space spelt out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For Python.
WORD = re.compile(r"\w+|[^\w\s]")
#: The same rule for Spark and DuckDB.
WORD_SQL = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}]"
#: Splits as they are spelt, by canonical name (fixed values).
SPLIT_NAMES = {
    "train": ["train", "training"],
    "validation": ["validation", "val", "valid", "dev"],
    "test": ["test", "testing"],
}
#: Language codes of three letters (fixed values).
LANGUAGES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es"}


def word_tokens(text: Column) -> Column:
    """The word tokens of ``text``, in order; null stays null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_SQL), F.lit(0))


def slice_name(value: Column) -> Column:
    """One spelling: lower case letters and digits only; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", ""), F.lit(""))


def split_name(value: Column) -> Column:
    """train, validation or test; null where the split is not known."""
    bare = F.regexp_replace(F.lower(value), r"[^a-z]", "")
    name = F.lit(None).cast("string")
    for to, spelt in SPLIT_NAMES.items():
        name = F.when(bare.isin(spelt), F.lit(to)).otherwise(name)
    return name


def language(value: Column) -> Column:
    """A code of two letters where one is known; null where nothing is left."""
    code = F.nullif(F.regexp_extract(F.lower(F.trim(value)), r"^([a-z]+)", 1), F.lit(""))
    short = code
    for long, two in LANGUAGES.items():
        short = F.when(code == long, F.lit(two)).otherwise(short)
    return short
