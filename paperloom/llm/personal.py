"""Personal information inside free text (problem 4).

Patterns propose spans; regex, gazetteer and context labelers vote on each.  An
expectation-maximization over the few distinct vote patterns estimates how reliable each
labeler is, and its posteriors train a logistic span classifier that decides; it also
learns which words stand around mentions.  The gazetteer comes from the name fields of the
data.  If its size is proven small it goes to the workers, else it reaches the texts by a join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.common import cut, join_dictionary
from paperloom.functions import keys as K

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
#: Spans on which the classifier is trained, in expectation; all spans are classified.
SAMPLE = 20_000
#: Words of the gazetteer up to which it goes to the workers; each is under 80 characters.
PARTS = 200_000
#: What is believed of labelers before any counts, as shares of silence, votes for and votes
#: against where the span is not personal and where it is, and its weight in spans a span.
BELIEF, WEIGHT = ((0.50, 0.10, 0.40), (0.50, 0.45, 0.05)), 0.5
#: Hashed features beside the votes; steps and rate of the training.
BUCKETS, STEPS, RATE = 1 << 11, 300, 0.5

_D = r"[0-9OlISB]"
_S = r"[ \t]*\n?[ \t]*"
_T = r"(?:[A-Z][a-z0-9@+éﬁ'’]+(?:[A-Z][a-z]+)?(?:[-‐­¬]\n[a-z]+)?|[A-Z][A-Z0-9@+'’]+(?:[-‐­¬]\n[A-Z]+)?)"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Hon|MR|MRS|MS|DR)"
#: Words of streets and of firms.
STREETS = "street st avenue ave road rd lane ln drive dr court ct way boulevard blvd place pl terrace trail circle parkway".split()
FIRMS = "llc inc co corp bank finance lending mortgage loans loan credit union group funding title escrow savings home &".split()
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9]|-\n?(?=[A-Za-z0-9]))*"
#: An address may write its at and dots as words in brackets.
_EMAIL = re.compile(rf"(?<![\w.+\-])[A-Za-z0-9](?:[A-Za-z0-9._%+]|-\n?)*(?:@|\s?[(\[{{]\s?at\s?[)\]}}]\s?){_LABEL}(?:(?:\.(?=[A-Za-z0-9])|\s?[(\[{{]\s?dot\s?[)\]}}]\s?){_LABEL})+(?<=[A-Za-z]{{2}})", re.I)
_PHONE = re.compile(rf"(?<![\w$.,/\-])(?:\+?1[\s.\-]{{1,2}}|\+1)?(?:\({_D}{{3}}\)\s{{0,2}}|{_D}{{3}}[\s.\-]{{0,2}}){_D}{{3}}[\s.\-]{{0,2}}{_D}{{4}}(?![\w\-/])(?:\s?(?:ext\.?|x)\s?\d+)?")
_ID = re.compile(rf"(?<![\w$.,/\-])(?:{_D}{{3}}-\n?{_D}{{2}}-\n?{_D}{{4}}|{_D}{{3}}\s{_D}{{2}}\s{_D}{{4}}|[0-9]{{9}}|[0-9]{{2}}-[0-9]{{7}}|[A-Z]{_D}{{3}}-\n?{_D}{{4}}-\n?{_D}{{2}}|[A-Z]{{2}}{_D}{{7}})(?![\w\-/])")
_WORD = r"[A-Za-z#][\w.@+é'’\-]*"
_ADDRESS = re.compile(
    rf"(?<![\w$.,/\-#])(?:(?:flat|apt\.?|apartment|unit|suite|ste\.?|room|house|no\.?)\s+#?\w{{1,5}},\s+)?(?:p\.?\s?o\.?\s?b[o0]x\s+{_D}{{1,6}}|{_D}{{1,6}}[a-z]?\s+(?:{_WORD}\s+){{0,4}}{_WORD}(?:\s+#\w+)?)"
    rf"(?:,\s+(?:apt\.?|unit|suite|ste\.?|flat|#|no\.?)\s*#?\w{{1,5}})?,\s+(?:{_WORD}\s+){{0,2}}{_WORD},\s+[A-Z]{{2}}\s+{_D}{{5}}(?:-\d{{4}})?(?!\w)", re.I)  # fmt: skip
_NAME = re.compile(
    rf"(?<![\w@.&\-])(?:(?:{_TITLE}\.?\s+)?(?:(?P<l1>{_T}),\s+(?P<f1>{_T})(?:\s+[A-Z]\.?(?![\w.]))?|(?P<f2>{_T})\s+(?:[A-Z]\.?\s+)?(?P<l2>{_T})|[A-Z]\.\s+(?P<l3>{_T}))|{_TITLE}\.?\s+(?P<l4>{_T}))(?![\w@])")
#: Cheap signs of what the patterns need, so that they run only where they may match.
_ZIP = re.compile(rf",\s+[A-Za-z]{{2}}\s+{_D}{{5}}")
_CAPS = re.compile(r"(?<!\w)[A-Z][\w@+'’]+(?:[-‐­¬]\n\w+)?")
_DIGITS, _SPACE, _SPACES, _OBSCURED = re.compile(r"[0-9]"), re.compile(r"\s"), re.compile(r"\s*"), re.compile(r"[(\[{]\s?at\s?[)\]}]", re.I)
_TITLES = frozenset("Mr Mrs Ms Miss Mx Dr Prof Sir Hon MR MRS MS DR".split())
_START = re.compile(rf"^{_TITLE}\.?\s+")
_FOLD = str.maketrans({"1": "l", "0": "o", "5": "s", "@": "a", "+": "t", "é": "e", "6": "b", "9": "g"})

#: Common captions before a mention, and what may follow one; the classifier learns further words.
_BEFORE = {
    "EMAIL": re.compile(r"(?:to|<|mail:?|at|write|contact|:)\s*$"),
    "PHONE": re.compile(r"(?:call|telephone|tel\.?|phone|number|reached at|fax|\bat|mobile|cell)\W*$"),
    "ID": re.compile(r"(?:ssn|s\.s\.n|social security|soc\. ?sec|tax|tin|itin|ein|id|passport|licen[cs]e|document|dl|driver)(?:\W|no|number|num|id|#|nr){0,8}$"),
    "ADDRESS": re.compile(r"(?:address:?|at|to|residing at|mailed to|located at)\s*$"),
    "NAME": re.compile(r"(?:by|borrower:?|signer,?|inquiries:|appraiser|contact|applicant:?|attn:?|name:?)\s*$"),
}
_AFTER = {
    "EMAIL": re.compile(r"^\W*(?:$|\.|/|tel|>)"),
    "PHONE": re.compile(r"^\W*(?:$|or|ext|\.)"),
    "ID": re.compile(r"^\W*(?:$|[A-Z])"),
    "ADDRESS": re.compile(r"^\W*(?:$|,|\.|[A-Z])"),
    "NAME": re.compile(r"^(?:,? ?(?:telephone|phone|e-?mail)| <| and |\.|$)"),
}
_AGAINST = re.compile(r"(?:loan n\S*|\bln-|account|reference|file(?: ref\S*)?|nmls|ref\.?|form|section|doctrack|order|invoice)\W*$")


@lru_cache(maxsize=100_000)
def _fold(s: str) -> str:
    return re.sub(r"[-‐­¬]\n", "", s).translate(_FOLD).lower()


def name_parts(names: DataFrame, column: str) -> DataFrame:
    """part, n_first, n_last of the words of persons' names ("First M. Last", "Last, First", "Mr. Last").

    Values of 80 characters or more are no names, and a word that only one value has is left
    out: misread names would bring words that no person bears.
    """
    s = F.regexp_replace(K.strip(F.col(column)), rf"^{_TITLE}\.?\s+", "")
    s = F.regexp_replace(s, r"(?<=[\s,])[A-Z]\.?(?=\s|$)|^[A-Z]\.\s+", " ")
    s = F.regexp_replace(K.strip(s), r"\s+", " ")
    turned = s.contains(",")
    words = F.split(F.regexp_replace(s, ",", " "), r"\s+")
    first = F.when(turned, F.element_at(words, -1)).when(F.size(words) > 1, words[0])
    last = F.when(turned, words[0]).otherwise(F.element_at(words, -1))
    ok = names.where(K.is_usable(F.col(column)) & (F.length(column) < 80))
    both = ok.select(F.explode(F.array(F.struct(first.alias("part"), F.lit(1).alias("f"), F.lit(0).alias("l")), F.struct(last.alias("part"), F.lit(0).alias("f"), F.lit(1).alias("l")))).alias("x")).select("x.*")
    parts = both.where(F.col("part").rlike(r"^[\p{L}'’\-]{2,}$")).groupBy(F.lower("part").alias("part")).agg(F.sum("f").alias("n_first"), F.sum("l").alias("n_last"))
    return parts.where("n_first + n_last >= 2")


def propose(text: str, first: set[str], last: set[str]) -> list[tuple[str, int, int, str, list[int]]]:
    """Spans of one text: kind, start, end, votes ("+", "-" or "0" of each labeler) and hashed features."""
    taken: list[tuple[int, int]] = []
    out = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def add(kind: str, a: int, b: int, own: str) -> None:
        before = re.sub(r"\s+", " ", text[max(0, a - 60) : a]).translate(_FOLD).lower()
        after = re.sub(r"[ \t\n]+", " ", text[b : b + 30])
        span = text[a:b]
        votes = own + ("+" if _BEFORE[kind].search(before) else "0") + ("+" if _AFTER[kind].search(after) else "0") + ("-" if _AGAINST.search(before) else "0")
        shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]{2,}", "AA", re.sub(r"\d", "9", span)))[:40]
        words = [f"{kind}:s:{shape}", f"{kind}:b:{(before.split() or [''])[-1]}", f"{kind}:a:{(after.lower().split() or [''])[0]}"]
        taken.append((a, b))
        out.append((kind, a, b, votes, [zlib.crc32(w.encode()) % BUCKETS for w in words]))

    sign = lambda yes, no=False: "+" if yes else "-" if no else "0"
    digits = len(_DIGITS.findall(text)) >= 9
    for m in _EMAIL.finditer(text) if "@" in text or "at" in text and _OBSCURED.search(text) else ():
        s = m[0]
        add("EMAIL", *m.span(), sign("@" in s, False) + sign(re.search(r"(?:\.|dot\W{1,3})(?:com|org|net|edu|gov|test|example|invalid|info|io|[a-z]{2})$", s, re.I)) + sign(len(s) >= 8, True))
    for m in _addresses(text) if digits or _ZIP.search(text) else ():
        if free(*m.span()):
            s = m[0].translate(_FOLD).lower()
            words = re.findall(r"[a-z&]+", s)
            add("ADDRESS", *m.span(), sign(any(w in STREETS for w in words) or "box" in words, True) + sign(re.search(r"[A-Z]{2}\s+\d{5}", m[0])) + sign(m[0][:1].isdigit() or "box" in words or words[:1] in (["flat"], ["unit"], ["apt"])))
    for m in _PHONE.finditer(text) if digits else ():
        if free(*m.span()) and sum(c.isdigit() for c in m[0]) >= 9:
            n = len(re.sub(r"\D", "", re.split(r"e?x", m[0])[0]))
            add("PHONE", *m.span(), sign(n in (10, 11)) + sign(re.search(r"[().+\-\s]", m[0])) + "0")
    for m in _ID.finditer(text) if digits or len(_DIGITS.findall(text)) >= 6 else ():
        if free(*m.span()) and sum(c.isdigit() for c in m[0]) >= 6:
            s = m[0]
            add("ID", *m.span(), sign(re.fullmatch(r"\D?\d{3}[-\s]\n?\d{2}[-\s]\n?\d{4}", s)) + sign(re.match(r"[A-Z]", s)) + sign(False, re.fullmatch(r"\d{9}", s) and not _BEFORE["ID"].search(re.sub(r"\s+", " ", text[max(0, m.start() - 60) : m.start()]).lower())))
    for at, end in _name_regions(text, first, last):
        while m := _NAME.search(text, at, end):
            a, b = m.span()
            f, la = m["f1"] or m["f2"], m["l1"] or m["l2"] or m["l3"] or m["l4"]
            known_f, known_l = bool(f) and _fold(f) in first, bool(la) and _fold(la) in last
            t = _START.match(m[0])
            a += t.end() if t else 0
            if t and m["f2"] and not known_l and _fold(f) in last:  # a title and one name; the next word is another sentence's
                b, la, f, known_f, known_l = m.end("f2"), f, None, False, True
            if m["f2"] and f and not known_f and not t:  # "Contact Soumot, Griv": a name of known words after the first one goes first
                other = _NAME.match(text, _SPACES.match(text, m.end("f2")).end())
                if other and any(w and _fold(w) in known for w, known in ((other["l1"] or other["l3"] or other["l2"], last), (other["f1"] or other["f2"], first))):
                    at = other.start()
                    continue
            before = re.sub(r"\s+", " ", text[max(0, a - 60) : a]).translate(_FOLD).lower()
            firm = any(w in FIRMS for w in re.findall(r"[a-z&]+", _fold(text[a : b + 14])))
            street = bool(re.search(r"\d[a-z]?\s+(?:east|upper|north|n\.|west|south|lower)?\s*$", before)) or _fold(la or "") in STREETS
            # a pair of capitalized words of which neither is known may hide a name that starts at its second
            if (known_f or known_l or (t and not firm)) and free(a, b) and not (known_l and not known_f and f and not m["l1"] and not _plain(m[0])):
                add("NAME", a, b, sign(known_f, bool(f) and not known_f and not known_l) + sign(known_l, not known_l and not known_f and not t) + sign(t is not None) + sign(False, firm) + sign(False, street))
                at = b
            elif known_l and not known_f and f and free(a, b):
                add("NAME", a, b, "0" + sign(True) + "0" + sign(False, firm) + sign(False, street))
                at = b
            else:
                at = m.start() + max(1, len(re.match(r"\w+", text[m.start() :])[0]) if re.match(r"\w+", text[m.start() :]) else 1)
    return out


def _addresses(text: str) -> Iterator[re.Match]:
    """Addresses, looked for in front of what looks like a state and postal code."""
    done = 0
    for z in _ZIP.finditer(text):
        m = _ADDRESS.search(text, max(done, z.start() - 160)) if z.end() > done else None
        if m:
            done = m.end()
            yield m


def _name_regions(text: str, first: set[str], last: set[str]) -> list[tuple[int, int]]:
    """Stretches around titles and words of the gazetteer, which every proposed name has."""
    out: list[tuple[int, int]] = []
    for m in _CAPS.finditer(text):
        w = m[0]
        if w in _TITLES or (f := _fold(w)) in last or f in first:
            a, b = max(0, m.start() - 60), m.end() + 60
            space = _SPACE.search(text, b)
            b = space.start() if space else len(text)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def _plain(s: str) -> bool:
    return bool(re.fullmatch(r"[\w.,'’\s\-]+", s))


_SPAN = "origin string, record_id bigint, kind string, start_pos int, end_pos int, votes string, hashed array<int>"


def spans(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """Proposed spans of texts(origin, record_id, text), with votes; positions from 1 in characters."""
    kept = texts.where(F.col("text").isNotNull() & (F.trim("text") != "")).select("origin", "record_id", "text")
    known = parts.limit(PARTS + 1).collect()
    small = texts.sparkSession.sparkContext.broadcast((frozenset(r.part for r in known if r.n_first > 0), frozenset(r.part for r in known if r.n_last > 0))) if len(known) <= PARTS else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            own = [small.value] * len(p) if small else [(set() if f is None else set(f), set() if la is None else set(la)) for f, la in zip(p["first"], p["last"], strict=True)]
            for o, r, t, (first, last) in zip(p["origin"], p["record_id"], p["text"], own, strict=True):
                for kind, a, b, votes, hashed in propose(t, first, last):
                    out.append((o, r, kind, a + 1, b + 1, votes, hashed))
            yield pd.DataFrame(out, columns=["origin", "record_id", "kind", "start_pos", "end_pos", "votes", "hashed"])

    if small:
        return kept.mapInPandas(run, _SPAN)
    # words that start in upper case, folded as the gazetteer is, joined to it; a text has few of them
    kept = kept.withColumn("same", F.xxhash64("text"))
    caps = F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace("text", r"[-‐­¬]\n", ""), F.lit(r"[A-Z][\p{L}0-9@+'’]+"), F.lit(0)), lambda w: F.lower(F.translate(w, "105@+é69", "losatebg"))))
    words = kept.select("origin", "record_id", "same", F.explode(caps).alias("part"))
    found = join_dictionary(words, parts, ["part"], "inner").groupBy("origin", "record_id", "same").agg(F.collect_set(F.when(F.col("n_first") > 0, F.col("part"))).alias("first"), F.collect_set(F.when(F.col("n_last") > 0, F.col("part"))).alias("last"))
    return kept.join(found, ["origin", "record_id", "same"], "left").select("origin", "record_id", "text", "first", "last").mapInPandas(run, _SPAN)


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Posterior of each (kind, vote pattern) by EM on its counts.

    A labeler says "+", "-" or nothing with a probability that depends on whether the span
    is personal.  These have Dirichlet priors of BELIEF, as heavy as WEIGHT times the spans:
    votes are believed to be mostly right, but enough counts turn that round.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = sorted((v, n) for k, v, n in patterns if k == kind)
        n = np.array([c for _, c in rows], dtype=float)
        x = np.array([["0+-".index(c) for c in v] for v, _ in rows])
        labelers = x.shape[1]
        p = np.array([1 / (1 + np.exp(-1.0 - 1.5 * (v.count("+") - 2 * v.count("-")))) for v, _ in rows])
        for _ in range(rounds):
            w = np.stack([n * (1 - p), n * p])
            prior = np.clip((w.sum(axis=1) + 1) / (n.sum() + 2), 0.05, 0.95)
            log = np.log(prior)[:, None] + np.zeros((2, len(rows)))
            for j in range(labelers):
                table = np.stack([np.bincount(x[:, j], weights=w[y], minlength=3) for y in (0, 1)]) + np.array(BELIEF) * (WEIGHT * n.sum() + 1)
                share = np.log(table / table.sum(axis=1, keepdims=True))
                log += share[:, x[:, j]]
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            if np.abs(new - p).max() < 1e-6:
                break
            p = new
        out |= {(kind, v): float(q) for (v, _), q in zip(rows, p, strict=True)}
    return out


def _vector(kind: str, votes: str, hashed: list[int], slots: dict[str, int]) -> list[int]:
    """Active features: kind, each vote, hashed context."""
    named = [slots[k] for k in (kind, *(f"{kind}:{j}:{c}" for j, c in enumerate(votes))) if k in slots]
    return named + [len(slots) + h for h in hashed]


def fit_classifier(rows: list[tuple[str, str, list[int]]], posterior: dict[tuple[str, str], float]) -> tuple[dict[str, int], np.ndarray]:
    """Logistic weights from spans with the posteriors as soft labels."""
    slots: dict[str, int] = {}
    for kind, votes, _ in rows:
        for k in (kind, *(f"{kind}:{j}:{c}" for j, c in enumerate(votes))):
            slots.setdefault(k, len(slots))
    w = np.zeros(len(slots) + BUCKETS)
    if not rows:
        return slots, w
    at = [_vector(*r, slots) for r in rows]
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    col = np.concatenate([np.array(a) for a in at])
    y = np.array([posterior[k, v] for k, v, _ in rows])
    seen = np.bincount(col, minlength=len(w)) + 1.0
    for _ in range(STEPS):
        z = np.bincount(row, weights=w[col], minlength=len(at))
        g = y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        w += RATE * (np.bincount(col, weights=g[row], minlength=len(w)) / seen - 1e-3 * w)
    return slots, w


def find_personal(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """origin, record_id, kind, start_pos, end_pos, score of each mention in texts(origin, record_id, text).

    parts is the gazetteer (name_parts).  Positions count characters from 1; end_pos is
    the one after the last.  Titles and labels are not part of a mention.  Null, empty and
    blank texts have none; whole texts of any length are read; a repeated row has its
    mentions once.
    """
    proposed = cut(spans(texts, parts))
    counts = proposed.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most three to the number of labelers for each kind
    posterior = reliabilities([(r.kind, r.votes, r.n) for r in counts])
    # chosen by hash from counted spans: no more than twice SAMPLE rows reach the driver, whatever the number of tasks
    total = max(sum(r.n for r in counts), 1)
    sample = proposed.where(F.pmod(F.xxhash64("origin", "record_id", "start_pos"), F.lit(total)) < SAMPLE).select("kind", "votes", "hashed").limit(2 * SAMPLE).collect()
    model = fit_classifier([(r.kind, r.votes, list(r.hashed)) for r in sample], posterior)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, w = shared.value
        for p in batches:
            z = np.array([w[_vector(k, v, list(h), slots)].sum() for k, v, h in zip(p["kind"], p["votes"], p["hashed"], strict=True)], dtype=float)
            p["score"] = 1 / (1 + np.exp(-z))
            yield p[["origin", "record_id", "kind", "start_pos", "end_pos", "score"]]

    scored = proposed.mapInPandas(run, "origin string, record_id bigint, kind string, start_pos int, end_pos int, score double")
    return scored.where("score >= 0.5").dropDuplicates(["origin", "record_id", "kind", "start_pos", "end_pos"])


def texts_of(values: DataFrame, pages: DataFrame) -> DataFrame:
    """origin, record_id, text of field evidence and page texts."""
    field = values.select(F.lit("field").alias("origin"), F.col("fv_id").alias("record_id"), F.col("evidence").alias("text"))
    return field.union(pages.select(F.lit("page").alias("origin"), F.col("page_id").alias("record_id"), F.col("raw_text").alias("text")))


#: Fields that hold names of persons.
NAME_FIELDS = ("borrower_name", "co_borrower_name", "appraiser_name")


def gazetteer(values: DataFrame) -> DataFrame:
    return cut(name_parts(values.where(K.clean_field_name(F.col("field")).isin(*NAME_FIELDS)).select("raw_value"), "raw_value"))


def redact(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """origin, record_id, text with [EMAIL], [PHONE], [ID], [ADDRESS] and [NAME] for the mentions."""
    own = mentions.groupBy("origin", "record_id").agg(F.collect_list(F.struct("start_pos", "end_pos", "kind")).alias("found"))
    # replaced from the end backwards, so that positions before stay right
    fold: Column = F.aggregate(
        F.reverse(F.array_sort(F.coalesce("found", F.array().cast("array<struct<start_pos:int,end_pos:int,kind:string>>")))), F.col("text"),
        lambda t, x: F.concat(F.substring(t, F.lit(1), x["start_pos"] - 1), F.lit("["), x["kind"], F.lit("]"), F.substring(t, x["end_pos"], F.length(t))),
    )
    return texts.join(own, ["origin", "record_id"], "left").select("origin", "record_id", fold.alias("text"))
