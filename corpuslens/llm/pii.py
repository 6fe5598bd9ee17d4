"""Personal data by candidate gradient boosting, in DataFrame operations only.

*Base spans* are the matches of four patterns with their checks (email; IPv4 address with
parts up to 255; card number passing Luhn's check; phone number of 9 to 15 digits).
*Generators* with high recall propose further, overlapping spans of each kind, one at every
place where their form begins: spelled-out addresses, quads that are defanged or stand in a
longer row of numbers, card numbers in groups or runs, national phone formats, and whatever
a base match swallowed together with other numbers and then failed.
Boosted trees score each candidate by its format and context. They are fitted here, on cases
of those forms from all documents. Positive cases are the
base spans, recast in the forms that the generators propose (:func:`recast`), in their own
context. Negative ones are spans of the wide patterns that fail their kind's check, recast
alike, proposed candidates that fail it, and phone forms that meet base spans of other kinds. As a
candidate must pass the check before the trees decide, negatives count with the chance that
such a span passes it (``CHANCE``: one in ten numbers passes Luhn's check by luck, which is
one for nine that fail).
A candidate is added if it passes its kind's check and its score reaches the kind's
threshold, which is calibrated for ``PRECISION`` on the half of the documents that the trees
have not seen. Base spans always stay and are masked before candidates are proposed, so that
none overlaps a base span; one inside another accepted one of its kind goes. Accepted candidates that overlap otherwise all stay: any may be the true one.

The fit sees one row for each combination of feature values (a bounded table, counted where
the documents are); the trees become a nested ``CASE`` over a candidate's features.

Patterns are written so that Java's engine neither recurses nor backtracks over long runs
(possessive groups; a run of address characters is entered at its start only). Places come
from running sums and maxima, so that the work grows in line with a text and its spans.
Offsets count code points.

Defined results: a null or empty text has no spans; very long texts are taken whole;
repeated rows are treated separately; an empty table gives an empty result; a table
without labelled candidates adds no spans; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import arrays

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
CONTEXT = 40
#: Stands for the characters of base spans; no pattern has it.
MASK = "\x00"

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind -> expression of the base spans
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: kind -> expression of the forms that carry no label: only the trees decide on these. The
#: form is the group of a lookahead and one character is taken, so that forms may overlap.
LOOSE = {
    "email": rf"(?i)(?<!{_LOCAL})(?=({_LOCAL}{{1,64}}+\x20?[\[({{]\x20?at\x20?[\])}}]\x20?{_LABEL}{{1,63}}+(?:(?:\.|\x20?[\[({{]\x20?dot\x20?[\])}}]\x20?){_LABEL}{{1,63}}+){{1,5}}+)){_LOCAL}",
    "ip": r"(?<![0-9])(?=([0-9]{1,3}(?:(?:\.|\x20?[\[(]\.[\])]\x20?)[0-9]{1,3}){3}(?![0-9])))[0-9]",
    "card": r"(?<![0-9])(?=([0-9]{13,19}|(?:[0-9]{4}[\x20-]){3}[0-9]{4})(?![0-9]))[0-9]",
    "phone": r"(?<![0-9A-Za-z+.,-])(?=((?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4})(?![0-9A-Za-z-]))[+(0-9]",
}
#: kind -> expression that also meets spans failing the check, for negative examples
WIDE = {"email": r"(?:(?<![^\s@])|\G)[^\s@]++@[^\s@]++", "ip": BASE["ip"], "card": BASE["card"], "phone": r"\+[0-9][\x20().0-9-]*+"}
#: cheap conditions without which a text cannot match: a character for the labelled forms, an
#: expression for the others
NEEDS = {"email": "@", "phone": "+"}
LOOSE_NEEDS = {"email": r"[\[({]\x20?[Aa][Tt]\x20?[\])}]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: A text without any of these has no span, candidate or case of any kind.
ANY_NEED = rf"[0-9@]|{LOOSE_NEEDS['email']}"
#: context words by kind
WORDS = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|visa|credit|pay", "phone": "phone|call|tel|fax|mobile"}

#: How often a span that is no case of its kind passes the check, for one that fails it.
CHANCE = {"email": 1.0, "ip": 1.0, "card": 1 / 9, "phone": 1.0}

_SPANS = "array<struct<start:int,end:int,value:string>>"
_DIGITS = "[^0-9]"


def matches(text: Column, pattern: str, when: Column, ahead: bool = False) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>.

    Splitting at the matches gives the gaps between them; running sums over gaps and
    matches are the offsets. With ``ahead`` a match takes one character, and its value is
    the first group, which may reach over later matches.
    """
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(int(ahead))), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    taken = lambda x: F.lit(1) if ahead else F.length(x["hit"])

    def placed(parts: Column) -> Column:
        before = arrays.sums_before(F.transform(parts, lambda x: x["gap"] + F.coalesce(taken(x), F.lit(0))))
        start = lambda x, b: (b + x["gap"]).cast("int")
        found = F.zip_with(parts, before, lambda x, b: F.struct(start(x, b).alias("start"), (start(x, b) + F.length(x["hit"])).alias("end"), x["hit"].alias("value")))
        return F.filter(found, lambda s: s["value"].isNotNull())

    return F.when(when, arrays.let(both, placed)).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _possible(kind: str, text: Column, pattern: str) -> Column:
    seen = F.rlike(text, F.lit(pattern))
    if pattern == LOOSE[kind]:
        return F.rlike(text, F.lit(LOOSE_NEEDS[kind])) & seen
    return F.contains(text, F.lit(NEEDS[kind])) & seen if kind in NEEDS else seen


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at")),
        lambda acc, d: F.struct((acc["sum"] + F.when(acc["at"] % 2 == 0, F.coalesce(d.try_cast("int"), F.lit(0))).otherwise((F.coalesce(d.try_cast("int"), F.lit(0)) * 2) % 10 + F.floor(F.coalesce(d.try_cast("int"), F.lit(0)) / 5).try_cast("int"))).alias("sum"), (acc["at"] + F.when(d == "", 0).otherwise(1)).alias("at")),
        lambda acc: acc["sum"],
    )
    return doubled % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check of a kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(F.regexp_replace(value, r"[^0-9.]", ""), r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).try_cast("int") <= 255))
    digits = F.regexp_replace(value, _DIGITS, "")
    return F.length(digits).between(13, 19) & luhn(digits) if kind == "card" else F.length(digits).between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind], _possible(kind, text, BASE[kind])), lambda s: passes(kind, s["value"]))


def recast(kind: str, value: Column) -> Column:
    """A span in one of the forms that its kind's generator proposes, chosen by hash."""
    digits = F.regexp_replace(value, _DIGITS, "")
    turn = F.pmod(F.crc32(value.cast("binary")), F.lit(3))
    if kind == "email":
        spelled = F.regexp_replace(F.regexp_replace(value, "@", " [at] "), r"\.([A-Za-z0-9-]+)$", " [dot] $1")
        return F.when(turn == 0, F.regexp_replace(value, "@", " (at) ")).otherwise(spelled)
    if kind == "ip":
        return F.when(turn == 0, F.regexp_replace(value, r"\.", "[.]")).otherwise(value)
    if kind == "card":
        grouped = F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1 ")
        return F.when((turn > 0) & (F.length(digits) == 16), grouped).otherwise(digits)
    last = lambda n, size: F.substring(digits, F.length(digits) - n + 1, F.lit(size))
    national = F.when(turn == 0, F.concat(F.lit("("), last(10, 3), F.lit(") "), last(7, 3), F.lit("-"), last(4, 4))).otherwise(F.concat_ws("-", last(10, 3), last(7, 3), last(4, 4)))
    return F.when(F.length(digits) < 10, value).when(turn == 2, F.concat(F.lit("+"), F.substring(digits, F.lit(1), F.greatest(F.lit(1), F.length(digits) - 10)), F.lit(" "), national)).otherwise(national)


#: Names of a candidate's features, all small integers.
FEATURES = ("kind", "digits", "size", "groups", "first", "tail", "before", "after", "word")


def features(parts: Column, kind: str, span: Column, value: Column | None = None) -> Column:
    """The features of a span (or of another value in its place) in a text's ``parts``."""
    value = span["value"] if value is None else value
    digits = F.regexp_replace(value, _DIGITS, "")
    before = arrays.cut(parts, F.greatest(F.lit(0), span["start"] - CONTEXT), F.least(F.lit(CONTEXT), span["start"]))
    after = arrays.cut(parts, span["end"], F.lit(1))
    side = lambda c: F.when(c == "", 0).when(F.rlike(c, F.lit(r"\s")), 1).when(F.rlike(c, F.lit("[A-Za-z]")), 2).when(F.rlike(c, F.lit("[0-9]")), 3).otherwise(4)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        F.least(F.length(digits), F.lit(24)).alias("digits"),
        F.least(F.length(value), F.lit(39)).alias("size"),
        F.least(F.size(F.split(value, "[^A-Za-z0-9]+", -1)), F.lit(8)).alias("groups"),
        F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(-1)).alias("first"),
        F.least(F.length(F.regexp_extract(value, "([A-Za-z]*)$", 1)), F.lit(9)).alias("tail"),
        side(F.substring(before, -1, 1)).alias("before"),
        side(after).alias("after"),
        F.rlike(before, F.lit(f"(?i)(?:{WORDS[kind]})")).try_cast("int").alias("word"),
    )


@dataclass
class Trees:
    """Boosted depth-2 trees over integer features, and a threshold for each kind."""

    trees: list[tuple] = field(default_factory=list)
    start: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, t, low, high in self.trees:
            left = x[:, f] <= t
            for side, (g, u, a, b) in ((left, low), (~left, high)):
                out += side * np.where(x[:, g] <= u, a, b)
        return out

    def score(self, x: Column) -> Column:
        total = F.lit(self.start)
        leaf = lambda n: F.when(x[FEATURES[n[0]]] <= n[1], F.lit(n[2])).otherwise(F.lit(n[3]))
        for f, t, low, high in self.trees:
            total = total + F.when(x[FEATURES[f]] <= t, leaf(low)).otherwise(leaf(high))
        return total

    def accepts(self, kind: str, x: Column) -> Column:
        least = self.thresholds.get(KINDS.index(kind))
        return F.lit(False) if least is None else arrays.let(x, self.score) >= least


def fit_trees(x: np.ndarray, count: np.ndarray, hits: np.ndarray, rounds: int = 20, rate: float = 0.4) -> Trees:
    """Logistic boosting on rows of feature values with their numbers of cases and positives."""
    total, good = count.sum(), hits.sum()
    model = Trees(start=float(np.log((good + 1) / (total - good + 1))))
    score = np.full(len(x), model.start)

    least = x.min(axis=0)
    codes = (x - least).T

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        """The best cut of the rows: (gain, feature, threshold, left value, right value)."""
        all_g, all_h = g[rows].sum(), h[rows].sum()
        value = lambda a, b: float(rate * a / (b + 1.0))
        best = (0.0, 0, 10**6, value(all_g, all_h), 0.0)
        for f in range(x.shape[1]):
            code = codes[f][rows]
            at = np.flatnonzero(np.bincount(code))[:-1]  # the values that occur, but the largest
            lg, lh = (np.cumsum(np.bincount(code, weights=w[rows]))[at] for w in (g, h))
            rg, rh = all_g - lg, all_h - lh
            gains = lg**2 / (lh + 1) + rg**2 / (rh + 1) - all_g**2 / (all_h + 1)
            for i, gain in enumerate(gains.tolist()):
                if gain > best[0] + 1e-9:
                    best = (gain, f, int(at[i] + least[f]), value(lg[i], lh[i]), value(rg[i], rh[i]))
        return best

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = hits - count * p, count * p * (1 - p)
        _, f, t, *_ = split(np.ones(len(x), bool), g, h)
        left = x[:, f] <= t
        low, high = (split(side, g, h)[1:] if side.any() else (0, 10**6, 0.0, 0.0) for side in (left, ~left))
        model.trees.append((f, t, low, high))
        for side, (q, u, a, b) in ((left, low), (~left, high)):
            score += side * np.where(x[:, q] <= u, a, b)
    return model


def calibrate(model: Trees, x: np.ndarray, count: np.ndarray, hits: np.ndarray, precision: float = PRECISION) -> None:
    """For each kind the lowest threshold that keeps the precision, over unseen cases."""
    scores = model.scores(x)
    for kind in range(len(KINDS)):
        rows = np.flatnonzero(x[:, 0] == kind)
        rows = rows[np.argsort(-scores[rows], kind="stable")]
        least = None
        values = scores[rows]
        sure = np.cumsum(hits[rows]) / (np.cumsum(count[rows]) + 1)  # one case against, for small numbers
        for i in range(len(rows)):
            if sure[i] >= precision and (i + 1 == len(rows) or values[i + 1] < values[i]):
                least = float(values[i])
        if least is not None:
            model.thresholds[kind] = least


def proposed(text: Column, kind: str) -> Column:
    return matches(text, LOOSE[kind], _possible(kind, text, LOOSE[kind]), ahead=True)


def _placed(kind: str):
    return lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def masked(text: Column, base: Column) -> Column:
    """The text with the characters of the base spans replaced by one that no form has."""

    def of(rows: Column) -> Column:
        far = arrays.most_before(F.transform(rows, lambda s: s["end"]), 0)
        parts = arrays.parts_of(text)

        def pieces(parts: Column) -> Column:
            runs = F.zip_with(rows, far, lambda s, f: F.concat(arrays.cut(parts, f.cast("int"), F.greatest(F.lit(0), s["start"] - f.cast("int"))), F.repeat(F.lit(MASK), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], f.cast("int"))))))
            end = F.array_max(F.transform(rows, lambda s: s["end"]))
            return F.concat(F.array_join(runs, ""), arrays.cut(parts, end, F.length(text) - end))

        return arrays.let(parts, pieces)

    return F.when(F.size(base) == 0, text).otherwise(arrays.let(F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), of))


def cases(text: Column, kind: str, hidden: Column, own: Column) -> Column:
    """array<struct<x, good>>: the labelled cases of a kind in a text; ``hidden`` is the text
    masked by all base spans, and ``own`` by those of the kind phone only."""

    def of(parts: Column) -> Column:
        wide = matches(text, WIDE[kind], _possible(kind, text, WIDE[kind]))
        good = lambda s: F.rlike(s["value"], F.lit(f"^{BASE['email']}$")) if kind == "email" else passes(kind, s["value"])
        labelled = F.transform(wide, lambda s: F.struct(features(parts, kind, s, recast(kind, s["value"])).alias("x"), good(s).try_cast("int").alias("good")))
        other = F.filter(proposed(text, kind), lambda s: ~passes(kind, s["value"]))
        if kind == "phone":
            other = F.concat(other, F.array_except(proposed(own, kind), proposed(hidden, kind)))
        return F.concat(labelled, F.transform(other, lambda s: F.struct(features(parts, kind, s).alias("x"), F.lit(0).alias("good"))))

    return arrays.let(arrays.parts_of(text), of)


def added(text: Column, kind: str, hidden: Column, model: Trees) -> Column:
    """(kind, start, end) of the accepted candidates of a kind outside the base spans."""
    if KINDS.index(kind) not in model.thresholds:
        return F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    good = lambda parts: F.filter(proposed(hidden, kind), lambda s: passes(kind, s["value"]) & model.accepts(kind, features(parts, kind, s)))
    return arrays.let(F.transform(arrays.let(arrays.parts_of(text), good), _placed(kind)), _outermost)


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> Trees:
    """Trees from the labelled candidates of all documents; the halves are by hash of id."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.rlike("text", F.lit(ANY_NEED))).withColumn("pick", F.pmod(F.xxhash64("doc_id"), F.lit(2**30)))
    body = F.col("text")
    picked = picked.withColumn("base", F.concat(*(F.transform(base_spans(body, kind), _placed(kind)) for kind in KINDS)))
    phones = F.filter("base", lambda b: b["kind"] == KINDS.index("phone"))
    picked = picked.withColumn("hidden", masked(body, F.col("base"))).withColumn("own", masked(body, phones))
    found = F.concat(*(cases(body, kind, F.col("hidden"), F.col("own")) for kind in KINDS))
    cells = picked.select((F.col("pick") % 2).alias("fold"), F.explode(found).alias("c")).groupBy("fold", *(F.col(f"c.x.{f}").alias(f) for f in FEATURES)).agg(F.count("*").alias("n"), F.sum("c.good").alias("good"))
    table = cells.orderBy("fold", *FEATURES).toArrow()  # a row for each combination of feature values
    if not len(table):
        return Trees()
    fold, n, good = (table[c].to_numpy() for c in ("fold", "n", "good"))
    x = np.column_stack([table[f].to_numpy() for f in FEATURES])
    n = good + (n - good) * np.array([CHANCE[k] for k in KINDS])[x[:, 0]]
    seen = fold == 0 if (fold == 0).any() and (fold == 1).any() else np.ones(len(fold), bool)
    held = ~seen if not seen.all() else seen
    model = fit_trees(x[seen], n[seen].astype(float), good[seen].astype(float))
    calibrate(model, x[held], n[held].astype(float), good[held].astype(float))
    return model


def _outermost(spans: Column) -> Column:
    """The spans, ordered by start, that end after all before them."""
    far = arrays.most_before(F.transform(spans, lambda s: s["end"]))
    kept = F.filter(F.zip_with(spans, far, lambda s, f: F.struct(s.alias("s"), f.alias("f"))), lambda x: x["s"]["end"] > x["f"])
    return F.transform(kept, lambda x: x["s"])


def find_spans(docs: DataFrame, model: Trees, *, text: str = "text", base_as: str = "base", spans_as: str = "spans") -> DataFrame:
    """``docs`` with two arrays of (kind, start, end), by kind and start: base spans and all."""
    body, hidden = F.coalesce(F.col(text), F.lit("")), "__hidden"
    while hidden in docs.columns:
        hidden += "_"
    out = docs.withColumn(base_as, F.concat(*(F.transform(base_spans(body, kind), _placed(kind)) for kind in KINDS)))
    out = out.withColumn(hidden, masked(body, F.col(base_as)))
    more = F.concat(*(added(body, kind, F.col(hidden), model) for kind in KINDS))
    return out.withColumn(spans_as, arrays.let(more, lambda m: F.when(F.size(m) == 0, F.col(base_as)).otherwise(F.array_sort(F.concat(F.col(base_as), m))))).drop(hidden)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind's mark."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def of(parts: Column) -> Column:
        def marked(rows: Column) -> Column:
            far = arrays.most_before(F.transform(rows, lambda s: s["end"]), 0)
            first = F.filter(F.zip_with(rows, far, lambda s, f: F.struct(s.alias("s"), f.cast("int").alias("f"))), lambda x: x["s"]["start"] >= x["f"])
            pieces = F.transform(first, lambda x: F.concat(arrays.cut(parts, x["f"], x["s"]["start"] - x["f"]), F.element_at(marks, x["s"]["kind"] + 1)))
            end = F.array_max(F.transform(rows, lambda s: s["end"]))
            return F.concat(F.array_join(pieces, ""), arrays.cut(parts, end, F.length(text) - end))

        return arrays.let(ordered, marked)

    return F.when(F.size(spans) > 0, arrays.let(arrays.parts_of(text), of)).otherwise(text)


def detect(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: Trees | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added) of every
    document; n_added counts the spans that the trees added to the base spans."""
    model = train(docs, doc_id=doc_id, text=text) if model is None else model
    found = find_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model).select("doc_id", "base", "spans")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
