"""Texts that were cut, by the trigrams they end in, in pure SQL.

All trigrams of words are counted over the whole collection, each with the
number of words that still follow it in its sentence. A text that ends without
the end of a sentence is looked up by its last trigrams: one that is frequent,
but after which sentences almost never end so soon, shows a cut in the middle
of a sentence; a last word that hardly ever follows the two before it, while
longer words that begin with it do, shows one in the middle of a word.

Words are lower case, numbers are one word ``#``, tags are none; a sentence ends at a full
stop, question or exclamation mark or line break. Marks of a cut behind the
text (dots, [truncated] and the like) are taken off first. A text's own ending
(and that of its copies) does not count as evidence for itself. Null, empty and
blank texts and texts without a word are no cases; a ``doc_id`` that repeats
keeps its rows. An empty table has no cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.draws import let
from skeinworks.session import stash

#: What may stand behind a cut (fixed values).
MARK = r"(?is)(?<![\s.…])(?:\s*+(?:\.{2,}+|…|[\[(<{]\s*+(?:\.{2,}+|…|truncated|cut(?: off)?|snip(?:ped)?|more|continued|text truncated|output truncated|rest missing)\W{0,3}[\])>}]|-{2,}+\s*+(?:truncated|cut|more)\s*+-{2,}+))++\s*+$"
#: White space, Unicode's too (fixed values).
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"</?[a-z]\w*+>|\d++(?:[.,:]\d++)*+|[\p{L}\p{M}_][\p{L}\p{M}\p{N}_]*+(?:['’][\p{L}\p{M}]++)*+|[.!?…。]++|[\n\r]"
#: How far before the end words are looked up, how often they must occur (with the two words before them, with one),
#: up to which share of endings they show a cut, and from which one a whole sentence.
REACH, SUPPORT, CUT, WHOLE = 3, {3: 10, 2: 30}, 0.02, 0.5
#: Further off than one word, where a sentence may go on in more ways, almost none may end there.
FAR = 0.004
PREFIX_SUPPORT = 3


def body(text: Column) -> Column:
    """``text`` without marks of a cut and blanks at its end; the pattern is tried only where the last signs can be a mark's."""
    trimmed = lambda t: F.rtrim(t, F.lit(BLANKS))
    marked = lambda t: F.right(t, F.lit(1)).isin("…", "]", ")", ">", "}") | F.right(t, F.lit(2)).isin("..", "--")
    return trimmed(let(trimmed(text), lambda t: F.when(marked(t), F.regexp_replace(t, MARK, "")).otherwise(t)))


def sentences(text: Column) -> Column:
    """The sentences of ``text`` as arrays of words; the last one is empty where the text ends with the end of a sentence."""

    def plain(token: Column) -> Column:
        first = F.substring(token, 1, 1)
        return F.when(first.between("0", "9"), "#").when(first.isin(".", "!", "?", "…", "。", "\n", "\r"), "\n").when(first == "<", "").otherwise(token)

    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.transform(F.split(F.array_join(F.transform(tokens, plain), " "), "\n", -1), lambda s: F.filter(F.split(s, " "), lambda w: w != ""))


def trigrams(words: Column) -> Column:
    """Of every word: the hashes of the two words before it (``two``) and of the one (``one``), the word, how many follow."""

    def all_of(before: Column) -> Column:
        at = lambda w, i: F.struct(F.xxhash64(F.get(before, i), F.get(before, i + 1)).alias("two"), F.xxhash64(F.get(before, i + 1)).alias("one"), w.alias("word"), (F.size(words) - 1 - i).alias("after"))
        return F.transform(words, at)

    return let(F.concat(F.array(F.lit("^"), F.lit("^")), words), all_of)


def truncated(documents: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """The ``doc_id`` (and columns ``kept``) of every cut document with ``kind``: mid-sentence or mid-word."""
    kept = kept or []
    # One pass over the texts.
    said = documents.filter("text IS NOT NULL").select("doc_id", *kept, F.xxhash64("text").alias("copy"), sentences(body(F.col("text"))).alias("said"))
    said = stash(said.withColumn("row", F.monotonically_increasing_id()), "sentences")
    each = said.select(F.explode("said").alias("s")).select(F.inline(trigrams(F.col("s"))))
    ends = [F.count(F.when(F.col("after") == k, 1)).alias(f"end{k}") for k in range(REACH + 1)]
    three = stash(each.groupBy("two", "one", "word").agg(F.count("*").alias("n"), *ends), "trigrams")
    totals = ["n", *[f"end{k}" for k in range(REACH + 1)]]
    two = stash(three.groupBy(F.col("one").alias("context"), "word").agg(*[F.sum(c).alias(c) for c in totals]), "bigrams")
    counts = three.select(F.lit(3).alias("grade"), F.col("two").alias("context"), "word", *totals).unionByName(two.select(F.lit(2).alias("grade"), "context", "word", *totals))

    # A line break ends a sentence: the last one is in the last line.
    last = said.withColumn("s", F.element_at("said", -1)).filter(F.size("s") > 0)
    last = stash(last.select("row", "doc_id", *kept, "copy", F.filter(trigrams(F.col("s")), lambda g: g["after"] <= REACH).alias("t")), "endings")
    copies = last.groupBy("copy").agg(F.count("*").alias("own"))
    asked = last.select("row", "copy", F.explode("t").alias("t"))
    of = lambda grade, context: asked.select("row", "copy", F.lit(grade).alias("grade"), F.col(context).alias("context"), "t.word", "t.after")
    asked = of(3, "t.two").unionByName(of(2, "t.one"))
    key = ["grade", "context"]

    # At every distance from the end: how often the words occur elsewhere, and how often sentences end as soon there.
    ended = F.coalesce(*[F.when(F.col("after") == k, F.col(f"end{k}")) for k in range(REACH + 1)])
    looked = asked.join(counts, [*key, "word"]).join(copies, "copy").select("row", "grade", "after", (F.col("n") - F.col("own")).alias("others"), (ended - F.col("own")).alias("same"))
    at = lambda grade, k, c: F.max(F.when((F.col("grade") == grade) & (F.col("after") == k), F.col(c)))
    by_row = looked.groupBy("row").agg(*[at(g, k, c).alias(f"{c}{g}{k}") for g in (3, 2) for k in range(REACH + 1) for c in ("others", "same")])

    def share(k: int) -> Column:
        """The share of endings with two words before; with one, where those two are rare."""
        of = lambda g: F.when(F.col(f"others{g}{k}") >= SUPPORT[g], F.col(f"same{g}{k}") / F.col(f"others{g}{k}"))
        return F.coalesce(of(3), of(2))

    shares = [share(k) for k in range(REACH + 1)]
    goes_on = F.coalesce(F.least(shares[0], shares[1]) <= CUT, F.lit(False)) | F.coalesce(F.least(*shares[2:]) <= FAR, F.lit(False))
    by_row = by_row.select("row", (goes_on & (F.greatest(*shares) < WHOLE)).alias("mid_sentence"), *[F.coalesce(f"others{g}0", F.lit(0)).alias(f"exact{g}") for g in (3, 2)])

    # The last word as the beginning of longer words after the same words, and anywhere.
    ending = asked.filter("after = 0 AND word <> '#'")
    wanted = ending.select(*key, F.col("word").alias("prefix")).distinct()
    there = counts.join(wanted.select(*key).distinct(), key, "left_semi")
    prefixes = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda k: F.substring(w, F.lit(1), k))
    longer = there.filter("length(word) > 1").select(*key, F.explode(prefixes(F.col("word"))).alias("prefix"), "n")
    longer = longer.join(wanted, [*key, "prefix"]).groupBy(*key, "prefix").agg(F.sum("n").alias("longer"))
    words = two.groupBy("word").agg(F.sum("n").alias("n"))
    starts = words.filter("length(word) > 1").select(F.explode(prefixes(F.col("word"))).alias("prefix"), "n")
    anywhere = ending.select(F.col("word").alias("prefix")).distinct().join(starts, "prefix").groupBy("prefix").agg(F.sum("n").alias("starts"))
    known = anywhere.join(words.withColumnRenamed("word", "prefix").withColumnRenamed("n", "known"), "prefix", "left")
    tail = ending.select("row", "copy", *key, F.col("word").alias("prefix")).join(longer, [*key, "prefix"], "left").join(known, "prefix", "left").join(copies, "copy")
    grade = lambda g: F.coalesce(F.max(F.when(F.col("grade") == g, F.col("longer"))), F.lit(0)).alias(f"longer{g}")
    tail = tail.groupBy("row").agg(grade(3), grade(2), F.coalesce(F.max("starts"), F.lit(0)).alias("starts"), (F.coalesce(F.max("known"), F.lit(0)) - F.max("own")).alias("known"))

    judged = last.select("row", "doc_id", *kept).join(by_row, "row", "left").join(tail, "row", "left").fillna(0, ["exact3", "exact2"])
    torn = lambda g: (F.col(f"longer{g}") >= PREFIX_SUPPORT) & (F.col(f"exact{g}") <= F.col(f"longer{g}") * CUT)
    rare = (F.col("longer3") < PREFIX_SUPPORT) & (F.col("exact3") <= 0)
    unknown = (F.col("exact2") <= 0) & (F.col("known") <= 0) & (F.col("starts") >= PREFIX_SUPPORT)
    kind = F.when(torn(3) | (rare & torn(2)) | unknown, "mid-word").when(F.col("mid_sentence"), "mid-sentence")
    return judged.withColumn("kind", kind).filter("kind IS NOT NULL").select("doc_id", *kept, "kind")


def truncation_by_source(documents: DataFrame) -> DataFrame:
    """Per source (null is ``unknown``): documents with text, cut ones, and their share."""
    source = F.coalesce(F.lower(F.trim("source")), F.lit("unknown"))
    cut = truncated(documents.withColumn("source", source), ["source"]).groupBy("source").agg(F.count("*").alias("cut"))
    every = documents.filter(F.col("text").rlike(r"[^\s\p{Z}]")).groupBy(source.alias("source")).agg(F.count("*").alias("documents"))
    return every.join(cut, "source", "left").select("source", "documents", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("documents")).alias("share"))
