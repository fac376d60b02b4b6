"""Texts cut off by field limits or in transfer (problem 10).

Per source, the lengths of texts in characters and in bytes form a histogram; the hazard of a length is
the share of the texts at least that long that have just that length. Each hazard is tested against its
neighbours with control of the false discovery rate, which gives the lengths that are limits.

What an incomplete ending looks like is learned from the same corpus. An ending is a *signature*: the
shape of the last symbols and of the line they stand in. Texts at ordinary lengths show how complete texts end; the
same texts broken off at a random place, and the signatures that are more common at limits than anywhere else, show
how cut ones end. A text is cut if its ending is likelier for a cut than for a complete text, given how likely a cut
is at its length: at a limit nearly every text is, elsewhere as few as the corpus lets us infer.
No list of words, marks or languages goes into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.util import cut

#: Blanks that may follow a text's end.
BLANKS = " \t\n\r\f\x0b\x85\xa0    ​   　﻿"
#: Lengths on either side of a length that make up its neighbourhood, and those next to it, which a limit stands out
#: from as well: a hump in the lengths is no limit.
REACH, NEXT = 25, 3
#: Expected share of false discoveries among the significant lengths of a source.
FDR = 0.001
#: Fewest texts of one length that can make it significant.
LEAST = 5
#: Places at which each text is broken off to learn what cut texts look like.
BREAKS = 2
#: Characters of a line or a text's end whose shape is looked at, and from which on a line is a long one.
SEEN, LONG = 24, 60
#: Least part of the endings of broken texts that no complete text has.
NEVER = 0.5
#: Largest share of cut texts at ordinary lengths that is believed, and texts by which a source's own share leans on it.
MOST_CUT, LEAN = 0.2, 20.0
#: Weight of the coarser signature in the estimate of a finer one, in texts.
BACKOFF = 5.0
#: Most that a length alone can say for a cut: a complete text may have just that length, too.
LIMIT_PRIOR = 0.9
#: Longest word before a full stop that is looked up as an abbreviation.
SHORT_WORD = 10


def significant_lengths(lengths: DataFrame, reach: int = REACH, fdr: float = FDR, least: int = LEAST) -> DataFrame:
    """(source, unit, n, texts, at_risk, expected): lengths that hold too many of a source's texts.

    ``lengths`` has source, unit and n, one row per text and unit. The texts are counted per length
    before any window, so a source with a third of all texts is as many rows as it has lengths.
    The p-value of a hazard is Chernoff's bound of the Poisson tail; Benjamini-Hochberg within
    each source and unit.
    """
    counts = lengths.where(F.col("n").isNotNull()).groupBy("source", "unit", "n").agg(F.count(F.lit(1)).alias("texts"))
    key = ["source", "unit"]
    longer = Window.partitionBy(*key).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    hazards = counts.withColumn("at_risk", F.sum("texts").over(longer))
    near = Window.partitionBy(*key).orderBy("n").rangeBetween(-reach, reach)
    beside = Window.partitionBy(*key).orderBy("n").rangeBetween(-NEXT, NEXT)
    per_length = F.greatest(
        (F.sum("texts").over(near) - F.col("texts") + 0.5) / (2 * reach), (F.sum("texts").over(beside) - F.col("texts")) / (2.0 * NEXT)
    )
    # by the neighbours' hazards, but never fewer than the neighbours have: where lengths run out, hazards rise anyway
    expected = per_length * F.greatest(F.col("at_risk") / (F.avg("at_risk").over(near) + 0.5), F.lit(1.0))
    k = F.col("texts").cast("double")
    p = F.when((k >= least) & (k > F.col("expected")), F.exp(k - F.col("expected") - k * F.log(k / F.col("expected"))))
    tested = hazards.withColumn("expected", expected).withColumn("p", F.coalesce(p, F.lit(1.0)))
    ranked = tested.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("p", "n"))).withColumn(
        "_tests", F.count(F.lit(1)).over(Window.partitionBy(*key))
    )
    passing = F.when(F.col("p") <= F.col("_rank") * fdr / F.col("_tests"), F.col("_rank"))
    last = F.max(passing).over(Window.partitionBy(*key))
    kept = ranked.withColumn("_last", F.coalesce(last, F.lit(0))).where(F.col("_rank") <= F.col("_last"))
    return kept.select(*key, "n", "texts", "at_risk", "expected")


# Endings


def shape(text: Column) -> Column:
    """A text with each run of letters, digits or blanks as one symbol; other signs stand for themselves, a run of one as two."""
    for pattern, symbol in (
        (r"\p{Lu}[\p{L}\p{M}]*", "A"), (r"\p{Ll}[\p{L}\p{M}&&[^\p{Lu}]]*", "a"), (r"[\p{L}\p{M}&&[^Aa]]+", "x"), (r"\p{N}+", "9"),
        (r"[\s\p{Z}]+", " "), (r"([^\p{L}\p{N} ])\1+", "$1$1"), (r"[Aax](?: [Aax])+(?= [Aax])", "a"),
    ):
        text = F.regexp_replace(text, pattern, symbol)
    return text


def _words(line: Column) -> Column:
    """A line without its numbers and what stands around its words."""
    return F.regexp_replace(line, r"^[^\p{L}]+(?:\p{Ll}(?=[\s\p{Z}]))?[^\p{L}]*|[\s\p{Z}]+$", "")


def endings(documents: DataFrame, breaks: int = BREAKS) -> DataFrame:
    """What is looked at of every text as it ends (``k`` = 0) and broken off at random places (``k`` = 1, 2, ...).

    (doc_id, source, chars, bytes, k, fine, middle, coarse, word, entry, running, entries): three signatures of an
    ending, each coarser than the one before; the short word before a last full stop, or the words of a short last line;
    and once per text the short words with a full stop after which a sentence goes on, and the words of short lines with
    a line after them. One pass over the texts. Blank texts have no signatures.
    """
    body = F.rtrim("text", F.lit(BLANKS))
    running = F.array_distinct(F.transform(F.regexp_extract_all(F.col("body"), F.lit(rf"(?<![^\s(\[])([^\s(\[]{{1,{SHORT_WORD}}}\.)(?= [\p{{Ll}}\p{{N}}])"), 1), F.lower))
    above = F.filter(F.slice(F.split("body", "\n"), F.lit(1), F.size(F.split("body", "\n")) - 1), lambda x: (F.length(x) <= LONG) & x.rlike(r"\p{L}\s*$"))
    entries = F.array_distinct(F.transform(above, _words))
    texts = documents.select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), body.alias("body"))
    rows = texts.select("*", F.explode(F.sequence(F.lit(0), F.lit(breaks))).alias("k"))
    place = F.pmod(F.xxhash64("doc_id", "chars", "k"), F.greatest(F.length("body") - 1, F.lit(1))) + 1
    end = F.when(F.col("k") == 0, F.col("body")).otherwise(F.rtrim(F.substr("body", F.lit(1), place.cast("int")), F.lit(BLANKS)))
    once = [F.when(F.col("k") == 0, x).alias(n) for x, n in ((running, "running"), (entries, "entries"))]
    ended = rows.select("doc_id", "source", "chars", "bytes", "k", end.alias("end"), *once)
    last = F.substring_index("end", "\n", -1)
    before = F.substring_index(F.substring_index("end", "\n", -2), "\n", 1)
    whole = F.length("end") == F.length(last)
    lined = ended.where("end <> ''").select(
        "doc_id", "source", "chars", "bytes", "k", "running", "entries", whole.alias("whole"), (F.length(F.trim(last)) > LONG).alias("long"),
        F.trim(last, F.lit(BLANKS)).alias("line"), F.trim(F.left(before, F.lit(SEEN)), F.lit(BLANKS)).alias("before"),
    )
    head = lambda c: F.left(shape(F.left(c, F.lit(SEEN))), F.lit(4))
    tail = F.right(shape(F.right("line", F.lit(SEEN))), F.lit(4))
    shaped = lined.select(
        "doc_id", "source", "chars", "bytes", "k", "running", "entries", "whole", "long", head(F.col("line")).alias("head"), head(F.col("before")).alias("above"),
        tail.alias("tail"), F.lower(F.nullif(F.regexp_extract("line", rf"(?<![^\s(\[])([^\s(\[]{{1,{SHORT_WORD}}}\.)$", 1), F.lit(""))).alias("word"),
        F.when(~F.col("long") & F.col("line").rlike(r"\p{L}$"), _words(F.col("line"))).alias("entry"),
    )
    kind = F.when(F.col("long"), "long").when(F.col("whole"), "only").when(F.col("head") == F.col("above"), "listed").otherwise("short")
    return shaped.select(
        "doc_id", "source", "chars", "bytes", "k", "running", "entries", "word", "entry",
        F.concat_ws("\x01", kind, F.when(F.col("long"), "").otherwise(F.col("head")), "tail").alias("fine"),
        F.concat_ws("\x01", kind, F.right("tail", F.lit(2))).alias("middle"),
        F.concat_ws("\x01", F.when(F.col("long"), "long").otherwise("short"), F.regexp_extract("tail", r"(?:\p{Ps}.{0,2}\p{Pe}|.[\p{Pe}\p{Pf}]|([^\p{L}\p{N}])\1|.)$", 0)).alias("coarse"),
    )


def abbreviations(ends: DataFrame) -> DataFrame:
    """(word): short words whose full stop is followed by the same sentence far more often than it ends a text."""
    goes_on = ends.where("k = 0").select(F.explode("running").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    stops = ends.where("k = 0 AND word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("m"))
    both = goes_on.where("n >= 3").join(stops, "word", "left")
    return both.where(F.col("n") > 3 * F.coalesce("m", F.lit(0))).select("word")


def marked(ends: DataFrame) -> DataFrame:
    """``ends`` with signatures that tell abbreviations from other stops, and whether a short last line stands elsewhere whole.

    Only rows with a word or a line to look up are joined, so that no null is a key.
    """
    words = abbreviations(ends).select("word", F.lit("\x02").alias("_mark"))
    lines = ends.where("k = 0").select(F.explode("entries").alias("entry")).distinct().select("entry", F.lit("\x03").alias("_mark"))
    parts = (
        ends.where("word IS NOT NULL").join(words, "word", "left"),
        ends.where("word IS NULL AND entry IS NOT NULL").join(lines, "entry", "left"),
        ends.where("word IS NULL AND entry IS NULL").withColumn("_mark", F.lit(None).cast("string")),
    )
    slim = [x.select("doc_id", "source", "chars", "bytes", "k", *[F.concat(c, F.coalesce("_mark", F.lit(""))).alias(c) for c in ("fine", "middle", "coarse")]) for x in parts]
    return slim[0].unionByName(slim[1]).unionByName(slim[2])


def with_limits(ends: DataFrame, reach: int = REACH, fdr: float = FDR) -> DataFrame:
    """``ends`` with ``excess``: the share of the texts of that length that are too many; null at ordinary lengths.

    A length in characters counts first, then that in bytes among the texts whose length in characters is ordinary.
    """
    sizes = ends.where("k = 0").select("source", "chars", "bytes")

    def limits(rows: DataFrame, unit: str) -> DataFrame:
        found = significant_lengths(rows.select("source", F.lit(unit).alias("unit"), F.col(unit).alias("n")), reach, fdr)
        share = 1 - F.col("expected") / F.col("texts")
        return cut(found.select(F.col("source").alias("_source"), F.col("n").alias("_n"), share.alias(f"_{unit}")))

    def marked(rows: DataFrame, found: DataFrame, unit: str) -> DataFrame:
        same = F.col("source").eqNullSafe(F.col("_source")) & (F.col(unit) == F.col("_n"))
        return rows.join(found, same, "left").drop("_source", "_n")

    # limits are at most a few lengths per source: cut off as a table, joined by Spark's own size check
    by_chars = limits(sizes, "chars")
    by_bytes = limits(marked(sizes, by_chars, "chars").where(F.col("_chars").isNull()), "bytes")
    return marked(marked(ends, by_chars, "chars"), by_bytes, "bytes").withColumn("excess", F.coalesce("_chars", "_bytes")).drop("_chars", "_bytes")


def signature_odds(ends: DataFrame, limits: bool = True) -> tuple[DataFrame, float]:
    """(fine, middle, coarse, ordinary, limited) of every signature, and the share of cut texts at ordinary lengths.

    The last two are the odds for texts at ordinary lengths and at limits, each without the text that is judged: a rare
    ending must not vouch for itself.

    Odds compare how often a signature ends a cut text with how often it ends a complete one. A signature seen in
    few texts leans on the coarser one, and the coarsest on even odds, so what was never seen says nothing. The share of cut
    texts follows from the signatures that complete texts never have: there, ordinary texts are as many as are cut.
    They are taken to be at least ``NEVER`` of the signatures of broken texts.
    """
    key = ["fine", "middle", "coarse"]
    here = F.col("excess").isNotNull() if limits else F.lit(False)
    counts = cut(ends.groupBy(*key).agg(
        F.count_if((F.col("k") == 0) & ~here).cast("double").alias("o"), F.count_if((F.col("k") == 0) & here).cast("double").alias("l"),
        F.count_if(F.col("k") > 0).cast("double").alias("s"),
    ))
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in "ols"]).collect()[0]
    n_o, n_l, n_s = max(total["o"], 1.0), max(total["l"], 1.0), max(total["s"], 1.0)
    common = counts.groupBy("coarse").agg(F.sum("o").alias("o"), F.sum("s").alias("s")).where(F.col("s") > 0)
    order = Window.orderBy(F.col("o") / F.col("s"), "coarse")  # a window over last symbols, which are few
    summed = common.select(*[F.sum(c).over(order).alias(c) for c in ("o", "s")]).where(F.col("s") >= NEVER * n_s)
    share = summed.agg(F.min((F.col("o") / n_o) / (F.col("s") / n_s))).collect()[0][0]
    share = min(MOST_CUT, share or 0.0)
    levels = counts
    for name, by in (("m", "middle"), ("c", "coarse")):
        over = Window.partitionBy(by)
        levels = levels.select("*", *[F.sum(x).over(over).alias(f"{x}_{name}") for x in "ols"])

    def odds(own_o: float, own_l: float) -> Column:
        odds = F.lit(1.0)
        for suffix in ("_c", "_m", ""):
            o, l, s = (F.greatest(F.col(f"{x}{suffix}") - own, F.lit(0.0)) for x, own in (("o", own_o), ("l", own_l), ("s", 0.0)))
            from_cuts = share * s * n_o / n_s  # of these texts, and twice what that may vary by
            complete = F.greatest(o - from_cuts - 2 * F.sqrt(from_cuts), F.lit(0.0)) / n_o / (1 - share)
            as_cut = s / n_s
            if suffix == "_c" and total["l"]:  # what is too common at limits to come from complete texts
                as_cut = (as_cut + F.greatest(l / n_l - complete, F.lit(0.0))) / 2
            weight = BACKOFF / n_o
            # the weight counts as texts that are cut and complete in the proportion of the coarser signature
            odds = (as_cut + weight * odds / (1 + odds)) / (complete + weight / (1 + odds))
        return odds

    return levels.select(*key, odds(1.0, 0.0).alias("ordinary"), odds(0.0, 1.0).alias("limited")), share


def judged(documents: DataFrame, reach: int = REACH, fdr: float = FDR, limits: bool = True) -> DataFrame:
    """(doc_id, source, truncated, at_limit, probability) for every document.

    ``at_limit``: the length in characters is significant for the source, or else that in bytes
    among the texts whose length in characters is not. ``truncated``: it is likelier than not that the text breaks off
    inside a word or sentence. ``limits`` = False leaves the lengths out, to see what they contribute.

    Defined results: null, empty and blank texts are not truncated; a null source is a source of
    its own; repeated rows are judged each; an empty table gives no rows; signatures never seen say nothing, so
    such a text is cut by the length alone; texts are judged whole, however long.
    """
    ends = cut(endings(documents))
    ends = cut(with_limits(marked(ends), reach, fdr))
    table, share = signature_odds(ends, limits)
    rows = ends.where("k = 0").join(table, ["fine", "middle", "coarse"])
    here = F.col("excess").isNotNull() & F.lit(limits)
    weighed = cut(rows.select("doc_id", "source", F.col("excess").isNotNull().alias("at_limit"), F.when(here, F.least("excess", F.lit(LIMIT_PRIOR))).alias("prior"),
                              F.when(here, F.col("limited")).otherwise(F.col("ordinary")).alias("odds")))
    likely = lambda prior: prior * F.col("odds") / (prior * F.col("odds") + 1 - prior)
    # a source cuts more or fewer of its texts than others: the same odds with its own share
    own = weighed.where("prior IS NULL").groupBy("source").agg(((F.sum(likely(F.lit(share))) + LEAN * share) / (F.count(F.lit(1)) + LEAN)).alias("_share"))
    own = own.select(F.col("source").alias("_source"), F.least("_share", F.lit(MOST_CUT)).alias("_share"))
    found = weighed.join(own, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "doc_id", "source", "at_limit", likely(F.coalesce("prior", "_share")).alias("probability")
    )
    blank = documents.where(F.coalesce(F.rtrim("text", F.lit(BLANKS)), F.lit("")) == "").select(
        "doc_id", "source", F.lit(False).alias("at_limit"), F.lit(0.0).alias("probability")
    )
    return found.unionByName(blank).select("doc_id", "source", (F.col("probability") > 0.5).alias("truncated"), "at_limit", "probability")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text breaks off."""
    return judged(documents).where("truncated").select("doc_id")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """Per source: documents, truncated ones, those among them at a significant length, the share, and the stated error.

    ``expected_wrong`` and ``expected_missed`` add up the probabilities of being wrong over the source's documents.
    """
    cut_off, p = F.col("truncated"), F.col("probability")
    rates = judged(documents).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(cut_off).alias("n_truncated"),
        F.count_if(cut_off & F.col("at_limit")).alias("n_at_limit"),
        F.sum(F.when(cut_off, 1 - p).otherwise(0.0)).alias("expected_wrong"), F.sum(F.when(cut_off, 0.0).otherwise(p)).alias("expected_missed"),
    )
    return rates.withColumn("share", F.col("n_truncated") / F.col("n_docs"))
