"""Text cut off by field limits or in transfer (problem 9).

Corpus statistics decide, all as group-bys over one tokenizing pass: a vocabulary trie, kept
as a table of its nodes, tells final tokens that are unknown proper prefixes of known words;
the lengths at which a source's texts pile up unfinished are its field limits; trigrams tell
endings that the corpus leaves without a full stop as a habit (procedural formulas) from
sentences broken in the middle.  One score weighs these together.  Copies of a text count
once in all of these.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.common import broadcast_if_small, cut, join_dictionary

#: A word is known from this many occurrences; a formula from this many breaks after it.
KNOWN, FORMULA = 3, 5
#: Share of a trigram's occurrences that must be followed by a break for a formula; longer words that begin with its last one are occurrences too, as a text may be cut within them.
FORMULA_SHARE = 0.3
#: A trigram this frequent that ends a sentence this rarely was cut at its point.
FREQUENT, RARELY = 20, 0.02
#: A limit: so many texts at one length, so many times the mean of the hundred lengths around.
PILE, PILE_RATIO = 8, 10.0
#: Weights of the evidence, in favour of a cut where positive; a text is cut if they sum to more than nothing.
WEIGHTS = {"mark": 7, "limit": 4, "prefix": 3, "open": 2}
#: What a text starts from, and what a closing bracket or a dash takes, with which speakers break off.
START, BROKEN_OFF = -1, -2
#: Distinct pairs of words before texts' last ones up to which they are broadcast, eight bytes each.
TWOS = 1_000_000
#: Signs that a system puts for the lost rest; ellipses may also be the speaker's.
LOST = r"\.\.\.|…|more|continued|cont\.|cont'd|truncated|cut|mehr|gekürzt|suite|más|sigue"
BRACKETED = rf"(?i)[\[(]\s?(?:{LOST})\s?[\])]$"
#: Titles that a name follows.
TITLES = r"(?i)(?:^|[^\p{L}])(?:mr|mrs|ms|dr|prof|hr|fr|herr|frau|mme|sr|sra|st|nr|no|art|bzw|z\.b)\.$"

_CLOSERS = "\"”“»’')]"
_STOP = rf"[.!?…][{re.escape(_CLOSERS)}]*(?=\s|$)"
#: Signs between words, by rule: what is no letter, mark, number or sign inside of words.
_BETWEEN = "".join(c for c in map(chr, range(0x3100)) if unicodedata.category(c)[0] not in "LMN" and c not in "'’-¶§#\ud800")
_DIGITS = "".join(c for c in map(chr, range(0x3100)) if unicodedata.category(c)[0] == "N")
#: Control characters and white space.
_BLANKS = "".join(map(chr, [*range(33), *range(0x7F, 0xA1), 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _end(c: Column) -> Column:
    return F.rtrim(c, F.lit(_BLANKS))


def _tokens(c: Column) -> Column:
    """Lower-case tokens with digits as #, "¶" where a sentence stops, "§" where a line or the text just ends."""
    s = F.lower(c)
    for own in "¶§#":
        s = F.replace(s, F.lit(own), F.lit(" "))
    s = F.regexp_replace(s, _STOP, " ¶ ")
    s = F.concat(F.replace(s, F.lit("\n"), F.lit(" § ")), F.lit(" § "))
    s = F.translate(s, _BETWEEN + _DIGITS, " " * len(_BETWEEN) + "#" * len(_DIGITS))
    for _ in range(5):  # a run of up to 32 digits is one sign
        s = F.replace(s, F.lit("##"), F.lit("#"))
    # apostrophes and hyphens count inside of words only
    for outer in ("--", " -", "- ", " '", "' ", " ’", "’ "):
        s = F.replace(s, F.lit(outer), F.lit(" "))
    return F.split(F.trim(F.regexp_replace(s, "([¶§])[¶§ ]+", "$1 ")), " +")


def _is_word(x: Column) -> Column:
    return ~x.isin("¶", "§", "")


def _words(tokens: Column) -> Column:
    """The words among tokens (a column of its own, as it is used twice), each with the token that follows it."""
    after = F.slice(F.concat(tokens, F.array(F.lit(""))), 2, 2**30)
    return F.filter(F.zip_with(tokens, after, lambda w, x: F.struct(w.alias("word"), x.alias("next"))), lambda s: _is_word(s["word"]))


def endings(docs: DataFrame) -> DataFrame:
    """Of each non-blank text: what its end looks like.  Expects id, source, text."""
    d = docs.where(F.col("text").isNotNull()).withColumn("end", _end(F.col("text"))).where("end <> ''")
    # a mark is far shorter than what it is looked for in
    mark = F.regexp_extract(F.expr("right(end, 80)"), rf"(?i)(\s?[\[(]\s?(?:{LOST})\s?[\])]|\s?(?:\.\.\.|…))$", 1)
    d = d.withColumn("mark", mark).withColumn("base", F.expr("left(end, length(end) - length(mark))")).withColumn("near", F.expr("right(base, 40)"))
    # the last words as a column of its own, so that they are made once
    d = d.withColumn("t", _tokens(F.expr("right(base, 120)"))).withColumn("short", _words(F.col("t")))
    # the tail's first word may be a part: with fewer than four words the last three come from the whole text
    d = d.withColumn("all", F.when((F.length("base") > 120) & (F.size("short") < 4), _tokens(F.col("base"))).otherwise(F.col("t"))).withColumn("words", _words(F.col("all")))
    d = d.withColumn("three", F.slice(F.concat(F.array(F.lit(""), F.lit(""), F.lit("")), F.col("words.word")), -3, 3))
    # a tail of nothing but closing signs tells nothing about what is before them
    tail = F.when((F.length("base") > 40) & (F.rtrim("near", F.lit(_CLOSERS + _BLANKS)) == ""), F.col("base")).otherwise(F.col("near"))
    # whole texts are counted below
    return d.select(
        "id", "source", "mark", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.length("base").alias("base_chars"), F.octet_length("base").alias("base_bytes"),
        tail.alias("tail"), F.get("three", 2).alias("last"), F.xxhash64(F.get("three", 0), F.get("three", 1), F.get("three", 2)).alias("gram"),
        F.xxhash64(F.get("three", 0), F.get("three", 1)).alias("two"), F.coalesce(F.get("words", F.size("words") - 1)["next"] == "§", F.lit(False)).cast("int").alias("own"), F.xxhash64("end").alias("body"),
    )


def _shape(d: DataFrame) -> DataFrame:
    tail, mark = F.col("tail"), F.col("mark")
    broken_off = (tail.rlike(r"\s?[—–]$") & (mark == "")) | ((mark != "") & ~mark.rlike(BRACKETED))
    stopped = tail.rlike(r"[.!?][\"”“»’')\]]*$") & ~tail.rlike(TITLES)
    closed = tail.rlike(r"[)\]]$")
    shape = F.when(mark.rlike(BRACKETED) | tail.rlike("�$"), "marked").when(broken_off, "broken").when(stopped, "stopped").when(closed, "closed").otherwise("open")
    return d.withColumn("shape", shape)


def detect(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, source, is_cut, evidence, signs and score of every row.

    signs: "mark" (a sign of the lost rest), "limit" (the length is one of the source's
    limits), "prefix" (the last token is an unknown proper prefix of known words), "open"
    (the sentence goes on).  score is the sum of their WEIGHTS and of what a text starts
    from; a text is cut where it is positive, and evidence is then its heaviest sign, else
    null.  Null, empty and blank texts are not cut, nor are texts that end in a dash, an
    ellipsis or a bracketed interruption below the limit.  Repeated rows are judged alike,
    and as if there were no copies; a null source has its own limits.  Whole texts count, of
    any length.  An empty table gives no rows.
    """
    flat = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    ends = cut(_shape(endings(flat)))
    single = ends.dropDuplicates(["body", "chars"])
    # the one pass over all texts: words, and of the trigrams those whose first two words come before some text's last.
    # copies share one count, so the texts themselves need no shuffle
    copies = ends.groupBy("body").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    whole = join_dictionary(flat.where("text is not null").select(_end(F.col("text")).alias("end")).where("end <> ''").withColumn("body", F.xxhash64("end")), copies, ["body"])
    toks = whole.select((1 / F.coalesce("copies", F.lit(1))).alias("share"), _tokens(F.col("end")).alias("t")).select("share", _words(F.col("t")).alias("w"))
    before = lambda k: F.slice(F.concat(F.array(*[F.lit("")] * k), F.col("w.word")), F.lit(1), F.size("w"))
    lined = toks.select("share", F.explode(F.arrays_zip(F.col("w.word").alias("word"), F.col("w.next").alias("next"), before(1).alias("b1"), before(2).alias("b2"))).alias("g"))
    grams = lined.select("share", "g.word", "g.next", F.xxhash64("g.b2", "g.b1").alias("at"), F.xxhash64("g.b2", "g.b1", "g.word").alias("three"))
    twos = cut(ends.select(F.col("two").alias("at")).distinct().withColumn("ends", F.lit(True)))
    hinted = broadcast_if_small(twos, TWOS)
    grams = grams.join(hinted, "at", "left") if hinted is not twos else join_dictionary(grams, twos, ["at"])
    grams = grams.select("share", "word", "next", F.when(F.col("ends"), F.col("at")).alias("two"), F.when(F.col("ends"), F.col("three")).alias("gram"))
    share = lambda c: F.round(F.sum(c), 3)
    counted = grams.groupBy("word", "two", "gram").agg(share("share").alias("n"), share(F.when(F.col("next") == "¶", F.col("share")).otherwise(0.0)).alias("n_stop"), share(F.when(F.col("next") == "§", F.col("share")).otherwise(0.0)).alias("n_break"))
    counted = cut(counted)
    plain = counted.where("gram is not null").join(ends.select("gram").distinct(), "gram", "left_semi").select("gram", "n", "n_stop", "n_break")
    # longer words with the same two before them, cut to the lengths of the last words that occur there
    open_ends = single.where((F.col("shape") == "open") & (F.col("mark") == ""))
    sizes = open_ends.select("two", F.length("last").alias("size")).distinct().groupBy("two").agg(F.collect_list("size").alias("sizes"))
    longer = counted.join(sizes, "two").select("n", F.explode(F.transform(F.filter("sizes", lambda k: k < F.length("word")), lambda k: F.struct(F.col("two"), F.substring("word", F.lit(1), k).alias("last")))).alias("x"))
    longer = longer.groupBy("x.two", "x.last").agg(F.sum("n").alias("n_longer"))
    longer = longer.join(open_ends.select("two", "last", "gram").distinct(), ["two", "last"]).select("gram", "n_longer")
    # at how many lengths texts end in a trigram
    lengths = open_ends.select("gram", "chars").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("n_lengths"))
    by_gram = cut(plain.join(longer, "gram", "left").join(lengths, "gram", "left"))
    # the trie: a node for each prefix of a known word; only nodes that some text ends in are kept
    words = counted.groupBy("word").agg(F.sum("n").alias("n"))
    last = single.where(F.col("shape").isin("open", "broken")).groupBy("last").agg(F.count(F.lit(1)).alias("n_ends"))
    known = words.join(last.withColumnRenamed("last", "word"), "word", "left").where(F.col("n") - F.coalesce("n_ends", F.lit(0)) >= KNOWN).select("word", "n")
    nodes = known.where(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", F.lit(1), k))).alias("prefix"), "n")
    trie = nodes.join(last.select(F.col("last").alias("prefix")), "prefix", "left_semi").groupBy("prefix").agg(F.sum("n").alias("n_below"))
    is_prefix = cut(last.join(trie.withColumnRenamed("prefix", "last"), "last").join(known.select(F.col("word").alias("last")), "last", "left_anti").select("last", F.lit(True).alias("prefix")))
    limits = field_limits(ends, by_gram)
    # a formula may end a third of all texts: its trigram must not be one task's
    d = join_dictionary(join_dictionary(ends, by_gram, ["gram"]), is_prefix, ["last"])
    for kind in ("chars", "bytes"):
        own = limits.where(F.col("kind") == kind).select(F.col("source").alias(f"s_{kind}"), F.col("size").alias(f"l_{kind}"))
        d = d.join(broadcast_if_small(own), F.col("source").eqNullSafe(F.col(f"s_{kind}")) & (F.col(f"base_{kind}") == F.col(f"l_{kind}")), "left")
    at_limit = F.col("l_chars").isNotNull() | F.col("l_bytes").isNotNull()
    open_end = F.col("shape") == "open"
    goes_on = (open_end & ~_formula()) | ((F.col("shape") == "stopped") & (F.col("n") >= FREQUENT) & (F.col("n_stop") < RARELY * F.col("n")))
    limited = at_limit & ~_formula(anywhere=True)
    given = {
        "mark": (F.col("shape") == "marked") | (limited & (F.col("mark") != "")),
        "limit": limited,
        "prefix": open_end & F.coalesce("prefix", F.lit(False)) & F.col("tail").rlike(r"[\p{L}\p{M}]$"),
        "open": goes_on,
    }
    signs = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in given.items()]))
    score = START + reduce(add, [F.when(c, WEIGHTS[k]).otherwise(0) for k, c in given.items()]) + F.when(F.col("shape").isin("closed", "broken"), BROKEN_OFF).otherwise(0)
    judged = d.select("id", "source", score.alias("score"), signs.alias("signs"))
    blank = flat.where(F.coalesce(_end(F.col("text")), F.lit("")) == "").select("id", "source", F.lit(START).alias("score"), F.array().cast("array<string>").alias("signs"))
    out = judged.union(blank)
    is_cut = F.col("score") > 0
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), is_cut.alias("is_cut"), F.when(is_cut, F.get("signs", F.lit(0))).alias("evidence"), "signs", "score")


def _formula(anywhere: bool = False) -> Column:
    """Whether other texts leave the last trigram without a full stop as a habit; anywhere: also as ends of texts of many other lengths."""
    n_break = F.coalesce("n_break", F.lit(0)) - F.col("own")
    uses = F.coalesce("n", F.lit(1)) - F.col("own") + F.coalesce("n_longer", F.lit(0))
    habit = (F.col("mark") == "") & (n_break >= FORMULA) & (n_break >= FORMULA_SHARE * uses)
    return habit & (F.coalesce("n_lengths", F.lit(0)) > FORMULA) if anywhere else habit


def field_limits(ends: DataFrame, by_gram: DataFrame) -> DataFrame:
    """source, kind (chars, bytes), size: lengths where a source's texts pile up, most of them unfinished.

    Copies count once, and so do a length's unfinished texts that end alike: a limit cuts anywhere.
    """
    d = join_dictionary(ends.dropDuplicates(["source", "body", "chars"]), by_gram, ["gram"]).withColumn("unfinished", ((F.col("shape") == "open") & ~_formula(anywhere=True)) | (F.col("shape") == "marked") | (F.col("mark") != ""))
    sizes = d.select("source", "gram", "unfinished", F.explode(F.array(F.struct(F.lit("chars").alias("kind"), F.col("base_chars").alias("size")), F.struct(F.lit("bytes").alias("kind"), F.col("base_bytes").alias("size")))).alias("x")).select("source", "gram", "unfinished", "x.*")
    alike = sizes.groupBy("source", "kind", "size", "unfinished", "gram").agg(F.count(F.lit(1)).alias("n"))
    per = alike.groupBy("source", "kind", "size").agg(F.sum(F.when(F.col("unfinished"), 1).otherwise(F.col("n"))).alias("n"), F.count(F.when(F.col("unfinished"), 1)).alias("u"))
    per = cut(per)
    # finished texts around tell how many to expect there by chance
    around = per.withColumn("near", F.explode(F.array(*[F.floor((F.col("size") + s) / 100) for s in (-50, 50)]))).groupBy("source", "kind", "near").agg(F.sum(F.col("n") - F.col("u")).alias("usual"))
    mine = per.where((F.col("u") >= PILE) & (F.col("u") * 2 > F.col("n"))).withColumn("near", F.floor((F.col("size") + 50) / 100))
    same = mine.alias("m").join(around.alias("a"), F.col("m.source").eqNullSafe(F.col("a.source")) & (F.col("m.kind") == F.col("a.kind")) & (F.col("m.near") == F.col("a.near")), "left")
    return same.where(F.col("u") >= PILE_RATIO * F.greatest(F.col("usual") / 100, F.lit(0.2))).select("m.source", "m.kind", "m.size")


def rates(detected: DataFrame) -> DataFrame:
    """source, n, n_cut, rate, and of the cut rows how many bear each sign; a null source is one of its own.

    A row may bear several signs; n_open_only counts those that bear no other than "open".
    """
    n, c = F.count(F.lit(1)), F.count(F.when(F.col("is_cut"), 1))
    bears = [F.count(F.when(F.col("is_cut") & F.array_contains("signs", k), 1)).alias(f"n_{k}") for k in WEIGHTS]
    return detected.groupBy("source").agg(n.alias("n"), c.alias("n_cut"), (c / n).alias("rate"), *bears, F.count(F.when(F.col("evidence") == "open", 1)).alias("n_open_only"))
