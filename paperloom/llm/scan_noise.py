"""Noise in text from scanned pages (problem 2).

Lines are labelled as header, body, break (the first line of a paragraph), footer or page
number by a hidden Markov model over layout features and words.  It is trained by hard
expectation-maximization, seeded by repetition at the pages' edges, which is counted over
all pages.  Paragraphs are put together by the labels.  Within lines the corpus' own
vocabulary decides: a broken word is one whose joined form the corpus knows, a misread one
turns into a far more frequent word by undoing one optical confusion.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.common import broadcast_if_small, cut, join_dictionary

#: Texts on which the line model is trained, in expectation, and characters that such a text
#: may have; all texts of any length are labelled, and counted for recurring lines.
SAMPLE, SAMPLE_CHARS = 4_000, 100_000
#: Buckets of hashed words and of layout features, which bound the model's size; most rounds
#: of training, and share of lines under which a change of labels ends it; share of a state's
#: mass that is spread as features are overall.
BUCKETS, LAYOUTS, ROUNDS, SETTLED, SPREAD = 1 << 15, 1 << 11, 12, 0.001, 0.01
#: A misread word's correction must be so frequent, and so many times as frequent.
COMMON, TIMES = 30, 10
#: The same for words with a sign that words don't have.
COMMON_ODD = 3
#: Rows of the dictionary of noisy tokens up to which it is broadcast.
DICTIONARY = 1_000_000

#: What a scanner reads -> what was printed.
CONFUSIONS = (
    ("c", "e"), ("é", "e"), ("ri", "n"), ("+", "t"), ("@", "a"), ("l", "i"), ("0", "o"), ("cl", "d"), ("5", "s"), ("1", "l"), ("1", "i"), ("ii", "u"), ("rn", "m"),
    ("9", "g"), ("b", "h"), ("6", "b"), ("vv", "w"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("h", "li"), ("f", "t"), ("8", "b"), ("|", "l"), ("3", "e"), ("€", "e"), ("$", "s"), ("è", "e"), ("á", "a"), ("à", "a"), ("ó", "o"), ("í", "i"), ("ü", "u"), ("ii", "n"), ("li", "h"), ("e", "c"), ("m", "rn"), ("d", "cl"), ("i", "l"), ("t", "f"), ("u", "n"), ("n", "u"), ("nn", "m"),
)
HYPHENS = "-‐‑­¬–"
#: White space and control characters; signs that mark a broken word's parts.
BLANKS = "\t\r\x00\x01\x02\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
JOINED, CONTINUED = "\x01", "\x02"
STATES = ("header", "body", "break", "footer", "pageno")
#: A text's labels are one letter a line; a blank line has none.
CODES, BLANK = "HBKFP", "-"
_H, _B, _K, _F, _P = range(5)
_PAGENO = re.compile(r"^[\W_]*(?:p(?:a?g)?e?\.?\s*|s(?:eite)?\.?\s*)?(\d{1,5}|[ivxlc]{1,7})(?:\s*(?:of|/|von|de|sur)\s*(\d{1,5}))?[\W_]*$", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_FOLD = str.maketrans({"1": "i", "l": "i", "0": "o", "5": "s", "c": "e", "é": "e", "@": "a", "+": "t", "6": "b", "9": "g", "h": "b", "f": "t"})
_GAP = re.compile(r"\S(?: {2,}| \.{3,} )\S")
_TABLE = re.compile(r"\S(?: {3,}| \.{3,} )\S")
_CENTS, _DASHES = re.compile(r"[.,]?[0-9OlISB]{2}$"), re.compile(r"[—·|]|/ |____")


def _value(s: str) -> int:
    if s.isdigit():
        return int(s)
    v = [_ROMAN[ch] for ch in s.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))


def _word_slot(word: str) -> int:
    w = re.sub(r"#+", "#", re.sub(r"\d{2,}", "#", word).strip(".,;:()[]").translate(_FOLD).replace("rn", "m").replace("ii", "u"))
    return zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS


#: Of a text's lines that recur, by index: whether mostly at edges (null below 5 times), whether at edges and hardly elsewhere.
Marks = dict[int, tuple[bool | None, bool]]
#: A text to label: its lines, page number, whether it is a whole page, marks.
Entry = tuple[list[str], int | None, bool, Marks]


@dataclass
class Lexicon:
    """Slots of words and layouts met so far; a worker's memory, emptied where it grows large."""

    words: dict[str, int] = field(default_factory=dict)
    layouts: dict[tuple, int] = field(default_factory=dict)
    #: feature slots of each layout
    slots: list[list[int]] = field(default_factory=list)

    def layout(self, features: tuple) -> int:
        got = self.layouts.get(features)
        if got is None:
            got = self.layouts[features] = len(self.slots)
            self.slots.append([zlib.crc32(f"{k}:{x}".encode()) % LAYOUTS for k, x in enumerate(features) if x is not None])
        return got


@dataclass
class Lines:
    """Features of the non-blank lines of several texts, one after another."""

    #: lines of each text; place of each line in its text
    sizes: np.ndarray
    places: list[list[int]]
    #: layout of each line; slots of all words, and where each line's begin
    layouts: np.ndarray
    words: np.ndarray
    starts: np.ndarray


def features(entries: Sequence[Entry], lexicon: Lexicon) -> Lines:
    """Layout and all words of every line that isn't blank.  A text that is not a whole page has no edges."""
    known = lexicon.words
    if len(known) > 500_000:
        known.clear()
    sizes, places, layouts, words, starts = [], [], [], [], []
    for lines, page, whole, marks in entries:
        bare = [x.strip() for x in lines]
        filled = [i for i, x in enumerate(bare) if x]
        n = len(filled)
        sizes.append(n)
        places.append(filled)
        # the usual width of a line: short ones end paragraphs
        width = sorted(len(bare[i]) for i in filled)[(3 * n) // 4] if n else 0
        before, before_gap = "", False
        for k, i in enumerate(filled):
            s = bare[i]
            where = "inner" if not whole else "only" if n == 1 else "first" if k == 0 else "last" if k == n - 1 else "last2" if k == n - 2 and n > 2 else "second" if k == 1 else "inner"
            m = _PAGENO.match(s)
            number = None if not m else "page" if page is not None and _value(m[1]) == page else "other"
            caps = s[:3].upper() == s[:3] and (s.isupper() or sum(ch.isupper() for ch in s) > 0.8 * max(1, sum(ch.isalpha() for ch in s)))
            gap = bool(_GAP.search(s))
            tokens = s.lower().split()
            recurs = marks.get(i, (None, False))[0] if marks and len(s) >= 6 else None
            short = bool(before) and len(before) < 0.8 * width
            stopped = before[-1:] in ".:;?!"
            layouts.append(lexicon.layout((
                where, number and (number, where in ("first", "last", "only")), number, caps, gap, s[-1] in ".;,:", "$" in s and bool(_CENTS.search(s)), s[0].islower(), len(s) > 45, min(len(tokens), 6),
                i == 0 or not bare[i - 1], i + 1 == len(lines) or not bare[i + 1], bool(_DASHES.search(s)), recurs, recurs, (short, stopped), (stopped, s[0].isupper()), before_gap, before[-1:] in HYPHENS if before else None,
            )))
            starts.append(len(words))
            for w in tokens:
                slot = known.get(w)
                if slot is None:
                    slot = known[w] = _word_slot(w)
                words.append(slot)
            before, before_gap = s, gap
    return Lines(np.array(sizes, dtype=np.int64), places, np.array(layouts, dtype=np.int64), np.array(words, dtype=np.int64), np.array(starts, dtype=np.int64))


def _line_key(line: Column) -> Column:
    """Hash of a line (in lower case) without digits, spacing and signs for numbers."""
    return F.xxhash64(F.translate(line, "0123456789# " + BLANKS, ""))


def _keyed_lines(texts: DataFrame) -> DataFrame:
    """whole, same (hash of the text), line_no, key, at_edge of the lines that aren't blank."""
    lines = texts.where("text is not null").select("whole", F.xxhash64("text").alias("same"), F.split(F.lower("text"), "\n").alias("ls"))
    filled = F.filter(F.transform("ls", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))), lambda s: F.trim(F.translate(s["line"], BLANKS, "")) != "")
    each = lines.select("whole", "same", filled.alias("ls")).select("whole", "same", F.size("ls").alias("size"), F.posexplode("ls").alias("k", "s"))
    return each.select("whole", "same", "s.line_no", _line_key(F.col("s.line")).alias("key"), ((F.col("k") == 0) | (F.col("k") >= F.col("size") - 2)).alias("at_edge"))


def recurring_lines(texts: DataFrame) -> DataFrame:
    """same (hash of the text), marks of each text with lines that recur.

    Lines are compared without case, digits and spacing, and counted over all whole pages,
    on the map side first.  marks holds an integer a line: four times its number, plus two
    if it occurs 5 times, one if that is mostly at edges, and the negative of that if it is 3
    times at edges and hardly elsewhere.
    """
    lines = _keyed_lines(texts)
    n, edge = F.col("n"), F.col("edge")
    counts = lines.where("whole").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("at_edge"), 1)).alias("edge"))
    seed = (edge >= 3) & (edge > 0.85 * n)
    code = F.when(n >= 5, 2 + (edge > 0.5 * n).cast("int")).otherwise(0)
    counts = cut(counts.where((n >= 5) | seed).select("key", code.alias("code"), F.when(seed, -1).otherwise(1).alias("sign")))
    found = join_dictionary(lines.select("same", "line_no", "key"), counts, ["key"], "inner")
    # a text's marks are as bounded as the text; copies of a text meet before the shuffle
    return found.groupBy("same").agg(F.collect_set(((F.col("line_no") * 4 + F.col("code")) * F.col("sign")).cast("int")).alias("marks"))


def _marks(marks: Iterable[int] | None) -> Marks:
    return {} if marks is None else {abs(x) // 4 - 1: (None if abs(x) % 4 == 0 else abs(x) % 4 == 3, x < 0) for x in marks}


def seed_labels(entries: Sequence[Entry]) -> list[int]:
    """First labels of all lines that aren't blank.

    Edges and lines that recur there tell headers, footers and page numbers; a paragraph
    starts after a blank line, at and after lines of tables, and where a short line ends a sentence.
    """
    out: list[int] = []
    for lines, page, _, marks in entries:
        bare = [x.strip() for x in lines]
        filled = [i for i, x in enumerate(bare) if x]
        n = len(filled)
        width = sorted(len(bare[i]) for i in filled)[(3 * n) // 4] if n else 0
        before = ""
        for k, i in enumerate(filled):
            s, m = bare[i], _PAGENO.match(bare[i])
            label = None
            if k == 0 or k >= n - 2:
                if m and k in (0, n - 1) and (page is None or _value(m[1]) == page):
                    label = _P
                elif n > 3 and marks.get(i, (None, False))[1]:
                    label = _H if k == 0 else _F
            if label is None:
                opens = not before or not bare[i - 1] or _GAP.search(s) or _GAP.search(before) or (len(before) < 0.8 * width and before[-1] in ".:;?!" and not s[0].islower())
                label = _K if opens else _B
                before = s
            out.append(label)
    return out


@dataclass
class LineModel:
    #: log emissions of layout features and words (slot, state), log transitions, log starts
    layout: np.ndarray
    word: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def emissions(self, x: Lines, lexicon: Lexicon) -> np.ndarray:
        table = np.array([self.layout[s].sum(axis=0) for s in lexicon.slots]).reshape(-1, 5)
        own = table[x.layouts] if len(x.layouts) else np.zeros((0, 5))
        if len(x.words):
            # every line has a word, so no start is followed by itself
            own = own + np.add.reduceat(self.word[x.words], x.starts, axis=0)
        return own

    def labels(self, x: Lines, lexicon: Lexicon) -> np.ndarray:
        return viterbi(self.emissions(x, lexicon), x.sizes, self.step, self.start)


def train(entries: Sequence[Entry]) -> LineModel:
    """The line model, by hard EM from the seeds until the labels settle."""
    lexicon = Lexicon()
    x = features(entries, lexicon)
    y = np.array(seed_labels(entries), dtype=np.int8)
    model = _count(x, y, lexicon)
    for _ in range(ROUNDS - 1):
        new = model.labels(x, lexicon)
        moved = (new != y).sum()
        y = new
        model = _count(x, y, lexicon)
        if moved <= SETTLED * len(y):
            break
    return model


def _count(x: Lines, y: np.ndarray, lexicon: Lexicon) -> LineModel:
    y = y.astype(np.int64)
    first = np.zeros(len(y) + 1, dtype=bool)
    first[np.cumsum(x.sizes) - x.sizes] = True
    first = first[: len(y)] if len(y) else first[:0]
    start = np.bincount(y[first], minlength=5) + 0.5
    follows = np.flatnonzero(~first)
    step = np.bincount(5 * y[follows - 1] + y[follows], minlength=25).reshape(5, 5) + 0.5
    per_layout = np.bincount(5 * x.layouts + y, minlength=5 * len(lexicon.slots)).reshape(-1, 5)
    layout = np.zeros((LAYOUTS, 5))
    for slots, n in zip(lexicon.slots, per_layout, strict=True):
        np.add.at(layout, slots, n)
    ends = np.append(x.starts[1:], len(x.words))
    word = np.bincount(5 * x.words + np.repeat(y, ends - x.starts), minlength=5 * BUCKETS).astype(float).reshape(BUCKETS, 5)
    # a paragraph's first line has no words of its own
    word[:, [_B, _K]] = word[:, [_B, _K]].sum(axis=1, keepdims=True)
    return LineModel(_log_shares(layout), _log_shares(word), np.log(step / step.sum(axis=1, keepdims=True)), np.log(start / start.sum()))


def _log_shares(e: np.ndarray) -> np.ndarray:
    """Log shares in each state; what is new to all states decides nothing."""
    usual = (e.sum(axis=1, keepdims=True) + 0.01) / (e.sum() + 0.01 * len(e))
    mass = e.sum(axis=0, keepdims=True) + 1.0
    return np.log(e + SPREAD * mass * usual) - np.log((1 + SPREAD) * mass)


def viterbi(own: np.ndarray, sizes: np.ndarray, step: np.ndarray, start: np.ndarray, cells: int = 200_000) -> np.ndarray:
    """Most likely states of several sequences whose log emissions stand one after another.

    Sequences of like length go together, as many as fill ``cells`` places.
    """
    out = np.empty(len(own), dtype=np.int8)
    order, begins = np.argsort(sizes, kind="stable"), np.cumsum(sizes) - sizes
    order = order[sizes[order] > 0]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * sizes[order[j]] <= cells:
            j += 1
        group = order[i:j]
        longest, rows = int(sizes[group[-1]]), np.arange(len(group))
        there = np.arange(longest) < sizes[group][:, None]
        at = (begins[group][:, None] + np.arange(longest))[there]
        seen = np.zeros((len(group), longest, 5))
        seen[there] = own[at]
        back = np.empty((longest, len(group), 5), dtype=np.int8)
        score = start + seen[:, 0]
        for k in range(1, longest):
            ways = score[:, :, None] + step
            live = there[:, k][:, None]
            back[k] = np.where(live, ways.argmax(axis=1), np.arange(5))
            score = np.where(live, ways.max(axis=1) + seen[:, k], score)
        y, best = score.argmax(axis=1), np.empty((len(group), longest), dtype=np.int8)
        for k in range(longest - 1, 0, -1):
            best[:, k] = y
            y = back[k][rows, y]
        best[:, 0] = y
        out[at] = best[there]
        i = j
    return out


def fit_lines(texts: DataFrame, marked: DataFrame) -> LineModel:
    """The line model, its emissions and transitions trained on about SAMPLE whole pages chosen by hash.

    Their number is counted first, so that no more than twice SAMPLE rows reach the driver,
    whatever the number of tasks.  Expects record_id, page, whole, text.
    """
    fit = texts.where(f"whole and text is not null and length(text) between 1 and {SAMPLE_CHARS}")
    n = max(fit.count(), 1)
    chosen = fit.where(F.pmod(F.xxhash64("record_id", "text"), F.lit(n)) < SAMPLE).select("page", "text", F.xxhash64("text").alias("same")).limit(2 * SAMPLE)
    rows = chosen.collect()
    sampled = texts.sparkSession.createDataFrame([(x,) for x in {r.same for r in rows}], "same long")
    marks = {r.same: _marks(r.marks) for r in marked.join(F.broadcast(sampled), "same", "left_semi").collect()}
    return train([(r.text.split("\n"), r.page, True, marks.get(r.same, {})) for r in sorted(rows, key=lambda r: (r.same, r.page or 0))])


def label_lines(texts: DataFrame, model: LineModel, marked: DataFrame) -> DataFrame:
    """origin, record_id, labels (a letter a line) of each text with words.  marked: of recurring_lines()."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lexicon = shared.value, Lexicon()
        for batch in batches:
            for part in (batch.slice(k, 2_000) for k in range(0, batch.num_rows, 2_000)):
                texts, pages, whole, marks = (part.column(c).to_pylist() for c in ("text", "page", "whole", "marks"))
                entries = [(t.split("\n"), p, bool(w), _marks(x)) for t, p, w, x in zip(texts, pages, whole, marks, strict=True)]
                x = features(entries, lexicon)
                y, out, at = m.labels(x, lexicon), [], 0
                for (lines, _, _, _), places in zip(entries, x.places, strict=True):
                    label = [BLANK] * len(lines)
                    for i, state in zip(places, y[at : at + len(places)].tolist(), strict=True):
                        # a page number is a line that is nothing else; the other way round the words decide
                        label[i] = "H" if state == _P and not _PAGENO.match(lines[i].strip()) else CODES[state]
                    at += len(places)
                    out.append("".join(label))
                yield pa.RecordBatch.from_arrays([part.column("origin"), part.column("record_id"), pa.array(out, pa.string())], names=["origin", "record_id", "labels"])

    known = texts.where(F.col("text").isNotNull() & (F.trim("text") != "")).select("origin", "record_id", F.col("page").cast("int").alias("page"), "whole", "text", F.xxhash64("text").alias("same"))
    return join_dictionary(known, marked, ["same"]).drop("same").mapInArrow(run, "origin string, record_id bigint, labels string")


_EDGE = r"^[^\p{L}\p{N}@+|€]+|[^\p{L}\p{N}@+|€]+$"
#: Amounts, dates and other numbers with separators, in which a letter stands for a digit.
_NUMBER = r"^[($]*(?=[^\s]*[0-9])(?=[^\s]*[OolISB])[0-9OolISB]+(?:[.,/][0-9OolISB]+)+[).,;:%]*$"
_ODD = r"[0-9@+|€$\x{FB01}\x{FB02}éèáàóíü]"


def line_tokens(texts: DataFrame) -> DataFrame:
    """origin, record_id, line_no, token of all words, as they stand between blanks.

    Where a line ends in a hyphen, its last token holds the next line's first one too, after
    the sign JOINED; that one itself begins with CONTINUED.
    """
    marked = F.regexp_replace(F.translate("text", BLANKS, " " * len(BLANKS)), rf"([{HYPHENS}]) *\n *(?=([^ \n]+))", f"$1{JOINED}$2\n{CONTINUED}")
    lines = texts.where("text is not null").select("origin", "record_id", F.posexplode(F.split(marked, "\n")).alias("i", "line"))
    tokens = lines.select("origin", "record_id", (F.col("i") + 1).alias("line_no"), F.explode(F.split("line", " ")).alias("token"))
    return tokens.where("token <> ''")


def misread_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, fixed, at of the given words(word) that undoing one or two optical confusions turns into a common one.

    Of several corrections the most frequent counts, then the alphabetically first; at is
    the place of the first confusion.  A word longer than all common ones by more than two
    confusions can make has none.
    """

    def undo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for w, n in zip(p["word"], p["n"], strict=True):
                for f, at in _undone(w).items():
                    out.append((w, n, f, at))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["word", "n", "fixed", "at"])
                    out = []
            yield pd.DataFrame(out, columns=["word", "n", "fixed", "at"])

    common = vocab.where(F.col("n") >= COMMON_ODD)
    longest = common.agg(F.max(F.length("word"))).first()[0] or 0
    judged = words.where(F.length("word").between(3, longest + 2)).join(vocab, "word", "left").na.fill(0, ["n"])
    tries = judged.mapInPandas(undo, "word string, n bigint, fixed string, at int")
    odd = F.col("word").rlike(_ODD)
    hits = tries.join(common.select(F.col("word").alias("fixed"), F.col("n").alias("m")), "fixed")
    good = hits.where(F.col("m") >= F.when(odd, F.greatest(F.lit(COMMON_ODD), F.col("n"))).otherwise(F.greatest(F.lit(COMMON), TIMES * F.col("n"))))
    best = good.groupBy("word").agg(F.max(F.struct(F.col("m"), F.col("fixed"), F.col("at"))).alias("b"))
    return best.select("word", "b.fixed", "b.at")


def _undone(word: str) -> dict[str, int]:
    """Texts that undoing one confusion makes of a word, or two where it holds a sign words don't have."""
    out: dict[str, int] = {}
    level = {word: -1}
    for _ in range(2):
        new: dict[str, int] = {}
        for w, first in level.items():
            for bad, good in CONFUSIONS:
                k = w.find(bad)
                while k >= 0:
                    f = w[:k] + good + w[k + len(bad) :]
                    if f != word and f not in out:
                        new.setdefault(f, k if first < 0 else min(first, k))
                    k = w.find(bad, k + 1)
        out.update(new)
        level = {w: k for w, k in new.items() if re.search(r"[0-9@+|é]", w)}
        if not level:
            break
    return out


def noisy_tokens(counted: DataFrame) -> DataFrame:
    """token, noise (array of kind, word, fixed, below) of the distinct tokens(token, n) that hold noise.

    All rules meet the distinct tokens only.  below: how many lines under the token's own
    the noise stands.
    """
    is_pair, goes_on = F.col("token").contains(JOINED), F.col("token").startswith(CONTINUED)
    bare = F.lower(F.regexp_replace("token", _EDGE, ""))
    part = F.col("token").rlike(rf"\p{{L}}[{HYPHENS}]$")
    typed = cut(counted.select("token", "n", is_pair.alias("pair"), goes_on.alias("on"), F.when(~is_pair & ~goes_on & ~part & bare.rlike(r"\p{L}"), bare).alias("word")))
    vocab = cut(typed.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    # broken words: letters, a hyphen, and lower-case letters on the next line
    ends = F.split("token", JOINED)
    left = F.regexp_extract(ends[0], rf"([\p{{L}}\p{{N}}@+|'’\-]*\p{{L}}[\p{{L}}@+|0-9]*)[{HYPHENS}]$", 1)
    right = F.regexp_extract(ends[1], r"^([\p{Ll}0-9@+|\x{FB01}\x{FB02}][\p{L}0-9@+|'’\-\x{FB01}\x{FB02}]*)", 1)
    pairs = typed.where("pair").select("token", F.lower(left).alias("left"), F.lower(right).alias("right")).where("left <> '' and right <> ''")
    tail = F.regexp_extract("left", r"([^\-]*)$", 1)
    pairs = cut(pairs.select("token", "left", "right", F.concat("left", "right").alias("joined"), F.concat("left", F.lit("-"), "right").alias("compound"), F.concat(tail, "right").alias("piece")))
    todo = vocab.select("word").union(pairs.select("joined")).union(pairs.select("piece")).distinct()
    wrong = cut(misread_words(todo, vocab))
    # how often the corpus has each form; a form may belong to many pairs, so the pairs are kept distinct here
    n_of = lambda name: vocab.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    seen = pairs
    for name in ("joined", "compound", "piece"):
        seen = seen.join(n_of(name), name, "left")
    seen = seen.join(wrong.select(F.col("word").alias("joined"), F.col("fixed").alias("fix"), "at"), "joined", "left")
    n = lambda name: F.coalesce(f"n_{name}", F.lit(0))
    # a word of the corpus, or a misread one; a compound that the corpus writes with its hyphen keeps it
    whole = (n("joined") + F.when(F.col("fix").isNotNull() & (n("joined") == 0), 1).otherwise(0)) > n("compound")
    seen = seen.where(whole | ((n("piece") > 0) & (F.instr("left", "-") > 0) & (n("compound") == 0)))
    entry = lambda kind, word, fixed, below: F.struct(F.lit(kind).alias("kind"), word.alias("word"), fixed.alias("fixed"), below.cast("int").alias("below"))
    none, here = F.lit(None).cast("string"), F.lit(0)
    # of a broken word that is misread too, the line that holds the place
    inner = F.when(F.col("fix").isNotNull(), entry("char", none, none, F.col("at") >= F.length("left")))
    broken = seen.select("token", F.array_compact(F.array(entry("hyphen", F.col("compound"), F.coalesce("fix", "joined"), here), inner)).alias("noise"))
    # misread words by the dictionary, numbers with letters, and letter-sign-letter tokens that no word of the corpus explains
    alone = typed.where("not pair").join(wrong.drop("at"), "word", "left").withColumn("own", F.ltrim("token", F.lit(CONTINUED)))
    is_number = F.col("own").rlike(_NUMBER)
    strange = F.coalesce(F.col("word").rlike(r"^[\p{L}'\-]*\p{L}[@+|]\p{L}[\p{L}'\-]*$"), F.lit(False))
    as_number = F.col("fixed").isNull() & is_number
    char = entry("char", F.when(as_number, F.lower("own")).otherwise(F.col("word")), F.when(as_number, F.translate("own", "OolISB", "001158")).otherwise(F.col("fixed")), here)
    return broken.union(alone.where(F.col("fixed").isNotNull() | is_number | strange).select("token", F.array(char).alias("noise")))


def find_noise(texts: DataFrame) -> DataFrame:
    """origin, record_id, line_no, kind, word, fixed of each noisy line of texts(origin, record_id, page, whole, text).

    Kinds: header (also footers), pageno, hyphen, char; the first two exclude the others.
    Beside these, break marks the first line of each paragraph.  word and fixed tell what
    was misread or broken, else they are null.  Null, empty and blank texts have no noise;
    texts of any length are read whole; a repeated (origin, record_id) has the noise of each
    of its texts, once.  A line of noise appears once per kind and word.
    """
    marked = cut(recurring_lines(texts))
    labelled = cut(label_lines(texts, fit_lines(texts, marked), marked))
    lines = labelled.select("origin", "record_id", F.posexplode(F.split("labels", "")).alias("i", "label"))
    kind = F.when(F.col("label").isin("H", "F"), "header").when(F.col("label") == "P", "pageno").when(F.col("label") == "K", "break")
    edges = lines.select("origin", "record_id", (F.col("i") + 1).alias("line_no"), kind.alias("kind"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("fixed")).where("kind is not null")
    tokens = line_tokens(texts)
    # the tokens of all texts are read twice, to count them and to look them up; the rules meet the distinct ones
    noisy = cut(noisy_tokens(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))))
    hinted = broadcast_if_small(noisy, DICTIONARY)
    looked = tokens.join(hinted, "token") if hinted is not noisy else join_dictionary(tokens, noisy, ["token"], "inner")
    inline = looked.select("origin", "record_id", "line_no", F.explode("noise").alias("x")).select("origin", "record_id", (F.col("line_no") + F.col("x.below")).alias("line_no"), "x.kind", "x.word", "x.fixed")
    inline = inline.join(edges.where("kind <> 'break'").select("origin", "record_id", "line_no"), ["origin", "record_id", "line_no"], "left_anti")
    return inline.union(edges).distinct()


def texts_of(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """origin, record_id, page, whole, text of page analyses and of degraded blocks, which are parts of pages."""
    page = pages.select(F.lit("page").alias("origin"), F.col("page_id").alias("record_id"), F.col("page_number").alias("page"), F.lit(True).alias("whole"), F.col("raw_text").alias("text"))
    block = blocks.select(F.lit("block").alias("origin"), F.col("block_id").alias("record_id"), F.lit(None).cast("int").alias("page"), F.lit(False).alias("whole"), F.col("partial_text").alias("text"))
    return page.union(block)


def reassemble(text: str, noise: list[tuple[int, str, str | None, str | None]]) -> str:
    """Continuous paragraphs of one text, from its noise and breaks (line_no, kind, word, fixed).

    Headers and page numbers go; broken words are joined; misread words are mended, keeping
    their case; a paragraph is one line and begins where a break is, also if a blank line or
    a page's end stands within it.  Lines of a table (wide gaps, leaders) stay.  Without any
    break blank lines divide.
    """
    by: dict[int, list[tuple[str, str | None, str | None]]] = defaultdict(list)
    for no, kind, word, fixed in noise:
        by[no].append((kind, word, fixed))
    labelled = any(kind == "break" for _, kind, _, _ in noise)
    paragraphs: list[list[str]] = [[]]
    glue = False
    for no, line in enumerate(text.split("\n"), 1):
        kinds = {k for k, _, _ in by[no]}
        if kinds & {"header", "pageno"}:
            continue
        s = line.strip()
        if not s:
            if paragraphs[-1] and not labelled:
                paragraphs.append([])
            glue = glue and labelled
            continue
        for kind, word, fixed in by[no]:
            if kind == "char" and word and fixed:
                s = re.sub(rf"(?<!\w){re.escape(word)}(?!\w)", lambda m, f=fixed: f.upper() if m[0].isupper() and len(m[0]) > 1 else f.capitalize() if m[0][:1].isupper() else f, s, flags=re.I)
        if "hyphen" in kinds:
            s = s.rstrip(HYPHENS + " ")
        if glue and paragraphs[-1]:
            paragraphs[-1][-1] += s
        elif "break" in kinds or _TABLE.search(s) or (paragraphs[-1] and _TABLE.search(paragraphs[-1][-1])):
            paragraphs.append([s])
        else:
            paragraphs[-1].append(s)
        glue = "hyphen" in kinds
    return "\n".join(" ".join(p) for p in paragraphs if p)


def repair(texts: DataFrame, noise: DataFrame) -> DataFrame:
    """origin, record_id, text: each text in readable paragraphs; null stays null, blank becomes empty."""
    own = noise.groupBy("origin", "record_id").agg(F.collect_list(F.struct("line_no", "kind", "word", "fixed")).alias("noise"))
    # a text's noise is as bounded as the text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p["text"] = [None if t is None else reassemble(t, [] if ns is None else [(x["line_no"], x["kind"], x["word"], x["fixed"]) for x in ns]) for t, ns in zip(p["text"], p["noise"], strict=True)]
            yield p[["origin", "record_id", "text"]]

    return texts.join(own, ["origin", "record_id"], "left").select("origin", "record_id", "text", "noise").mapInPandas(run, "origin string, record_id bigint, text string")
