"""Personal data: candidate spans, boosted trees, redaction (DataFrame functions only).

Base rules find e-mail addresses, IPv4 addresses, payment cards and international phone numbers, leftmost and
without overlap per kind; what they accept stays. Each kind has broader generators beside (addresses spelled with
"at" and "dot" or with spaces, dotted numbers with brackets, spaces or commas, runs of digits with any separators, once
as cards and once as phone numbers). Their proposals overlap, within a kind and between kinds. Boosted trees score each from its
format and context; the score less the kind's threshold is its margin. Proposals of a negative margin go, and so do
those that touch a base span or a proposal of a greater margin (ties: the earlier, then the longer one, then kinds as listed).

The trees are trained at the driver on generated examples (TRAIN_SEED), whose proposals and features the same columns
compute: a proposal is right if it is one of the example's spans, of its kind and with its ends. Thresholds are
calibrated on other examples, with words and contexts that training does not see; report() gives the figures on
a third set. The ensemble becomes nested CASE expressions.

Regular expressions are possessive or of bounded depth, and places come from two levels of sums, so that long runs
neither overflow the stack nor take quadratic time. Positions are code points, ends exclusive. Null texts are empty;
empty texts have no spans; repeated rows give repeated rows; an empty table gives none. Other columns stay as they are.
"""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import table

KINDS = ("email", "ip", "card", "phone")
BEFORE, AFTER = 24, 8
TRAIN_SEED, TREES, DEPTH, SHRINK, PRECISION = 5, 40, 2, 0.3, 0.99
_FRESH = r"(?:(?<![{0}])|\G)"  # a run's first character, or what a match left of it
_LOCAL = "A-Za-z0-9._%+-"

#: Base patterns, possessive where the plain pattern could only fail by giving back.
BASE = {
    "email": _FRESH.format(_LOCAL) + f"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": _FRESH.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for its base pattern to be worth a search.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_AT = r"(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)"
_GAP = r"(?:[._/]|\x20{2}|\x20-\x20)"
#: Per kind the generators: (pattern, what a text must contain for it).
WIDE = {
    "email": [
        (f"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}\x20?[A-Za-z0-9-]{{2,24}}){{1,3}}", r"(?i)\bat\b"),
        (f"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}\x20?@\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?\\.\x20?[A-Za-z0-9-]{{2,24}}){{1,3}}", "@"),
    ],
    "ip": [
        (r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?[\[(]\.[\])]\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])", r"[0-9]\x20?[\[(]\."),
        (r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])", r"[0-9]\x20?[.,]\x20?[0-9]"),
    ],
    "card": [
        (f"(?<![0-9A-Za-z])[0-9]{{4}}{_GAP}[0-9]{{4,6}}{_GAP}[0-9]{{4,5}}(?:{_GAP}[0-9]{{3,4}})?(?![0-9A-Za-z])", f"[0-9]{{4}}{_GAP}[0-9]{{4}}"),
        (r"(?<![0-9A-Za-z])[0-9](?:[\x20._/-]{0,3}[0-9]){11,18}(?![0-9A-Za-z])", r"[0-9](?:[\x20._/-]{0,3}[0-9]){11}"),
    ],
    "phone": [
        (r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
        (r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])", r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"),
    ],
}
CUES = {"email": r"(?i)(?:mail|contact|write|reach)", "ip": r"(?i)(?:\bip\b|host|server|addr|node)", "card": r"(?i)(?:card|visa|master|amex|pay|credit)", "phone": r"(?i)(?:phone|tel\b|tel[.:]|call|fax|mobile|cell|dial|ring)"}
_PLACE = "array<struct<s:int,e:int>>"
_SPAN = "array<struct<s:int,e:int,m:string,pre:string,post:string>>"
#: Matches of which one level of sums takes care.
GROUP = 64


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def _ends(lengths: Column) -> Column:
    """Running sums of an array, in two levels, so that the work is GROUP per entry and the square of the groups."""
    none = F.array().cast("array<int>")
    groups = F.ceil(F.size(lengths) / GROUP).cast("int")
    totals = F.when(groups > 0, F.transform(F.sequence(F.lit(0), groups - 1), lambda g: _sum(F.slice(lengths, g * GROUP + 1, GROUP)))).otherwise(none)

    def both(x: Column) -> Column:
        n, t = x["n"], x["t"]
        before = F.transform(t, lambda _, g: _sum(F.slice(t, 1, g)))

        def inside(y: Column) -> Column:
            at = lambda i: F.floor(i / GROUP).cast("int")
            return F.transform(y["n"], lambda _, i: F.get(y["b"], at(i)) + _sum(F.slice(y["n"], at(i) * GROUP + 1, i % GROUP + 1)))

        return F.transform(F.array(F.struct(n.alias("n"), before.alias("b"))), inside)[0]

    return F.transform(F.array(F.struct(lengths.alias("n"), totals.alias("t"))), both)[0]


def spans_of(text: Column, pattern: str, hint: str) -> Column:
    """Each match with its place, what stands before it since the last match, and what follows up to the next."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(x: Column) -> Column:
        widths = F.zip_with(F.slice(x["p"], 1, F.size(x["f"])), x["f"], lambda a, b: F.length(a) + F.length(b))

        def placed(y: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                end = F.get(y["e"], i)
                return F.struct((end - F.length(m)).alias("s"), end.alias("e"), m.alias("m"), F.right(F.get(y["p"], i), F.lit(BEFORE)).alias("pre"), F.left(F.get(y["p"], i + 1), F.lit(AFTER)).alias("post"))

            return F.transform(y["f"], one)

        return F.transform(F.array(F.struct(x["p"].alias("p"), x["f"].alias("f"), _ends(widths).alias("e"))), placed)[0]

    empty = F.array().cast(_SPAN)
    some = lambda x: F.when(F.size(x["f"]) > 0, spans(x)).otherwise(empty)
    return F.when(text.rlike(hint), F.transform(F.array(F.struct(pieces.alias("p"), found.alias("f"))), some)[0]).otherwise(empty)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the check: every second from the right doubled, its digits added, a multiple of ten."""
    every = F.split(F.reverse(number), "")
    total = F.aggregate(every, F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum")), lambda a, d: F.struct((a["n"] + 1).alias("n"), (a["sum"] + _doubled(F.ascii(d) - 48, a["n"])).alias("sum")))["sum"]
    return F.when(F.length(number) > 0, total % 10 == 0).otherwise(F.lit(False))


def _doubled(d: Column, n: Column) -> Column:
    return F.when(n % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the spans that the base rules accept."""
    tests = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["m"].rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"),
        "card": lambda x: luhn(digits(x["m"])),
        "phone": lambda x: F.length(digits(x["m"])).between(9, 15),
    }
    return {k: F.filter(spans_of(text, BASE[k], HINT[k]), tests[k]) for k in KINDS}


#: The features of a proposal, by name.
def features(kind: str, x: Column) -> dict[str, Column]:
    m, pre, post = x["m"], x["pre"], x["post"]
    number = digits(m)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "generator": x["g"],
        "length": F.length(m),
        "groups": F.size(F.split(m, r"[^0-9A-Za-z]+")),
        "ends_digit": flag(m.rlike("[0-9]$")),
        "card_groups": flag(m.rlike(r"^[0-9]{4}([^0-9]+)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}([^0-9]+)[0-9]{6}\2[0-9]{5}$|^[0-9]{13,19}$")),
        "phone_groups": flag(m.rlike(r"^(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}$")),
        "spaced_ip": flag(m.rlike(r"\x20[.,]|,")),
        "digits": F.length(number),
        "kinds_of_digit": F.size(F.array_distinct(F.split(number, ""))),
        "separators": F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")),
        "kinds_of_separator": F.size(F.array_distinct(F.split(F.regexp_replace(m, "[A-Za-z0-9]", ""), ""))),
        "bracket": flag(m.rlike(r"[\[({]")),
        "luhn": flag(luhn(number)),
        "octets": flag(F.regexp_replace(m, r"[^0-9.]", "").rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")),
        "loose_dot": flag(m.rlike(r"\.\s|\s\.")),
        "top_level": flag(m.rlike(r"(?i)[.\])}\s](?:com|org|net|edu|gov|io|info|co|de|fr|es|uk)$")),
        "local_digits": flag(m.rlike(r"^[A-Za-z]*[._%+-]|^[A-Za-z]*[0-9]")),
        "cue": flag(pre.rlike(CUES[kind])),
        "colon": flag(pre.rlike(r"[:=]\s?$")),
        "word_before": flag(pre.rlike(r"[A-Za-z0-9]\s?$")),
        "number_before": flag(pre.rlike(r"[0-9]\W{0,2}$")),
        "number_after": flag(post.rlike(r"^\W{0,2}[0-9]")),
        "unit_after": flag(post.rlike(r"(?i)^\s?(?:kg|km|units?|pcs|usd|eur|[%$€])")),
        "reference": flag(pre.rlike(r"(?i)(?:isbn|order|item|page|version|no\.|ref|sku|id)\W{0,3}$")),
    }


def proposals(text: Column, kind: str) -> Column:
    """What the kind's generators propose: structs with s, e, m, pre, post and g, the generator's number."""

    def numbered(g: int, pattern: str, hint: str) -> Column:
        return F.transform(spans_of(text, pattern, hint), lambda x: F.struct(*[x[c].alias(c) for c in ("s", "e", "m", "pre", "post")], F.lit(g).alias("g")))

    return F.concat(*[numbered(g, pattern, hint) for g, (pattern, hint) in enumerate(WIDE[kind])])


#: Syllables and phrases of the examples: for training, for calibration, for the report.
_SETS = (
    (["an", "re", "ti", "lo", "mer", "sun", "ka"], ["", "and ", "it was "], ["mail ", "e-mail: ", "contact ", "write to ", ""], ["ip ", "host ", "server: ", "addr=", ""], ["card ", "visa: ", "pay with ", ""], ["phone ", "tel. ", "call ", "fax: ", "mobile: "]),
    (["bo", "nu", "si", "gra", "pel", "do", "ve"], ["", "then ", "we saw "], ["reach me: ", "send mail to ", "contact: ", ""], ["node ", "host=", "ip: ", ""], ["credit card ", "amex ", "paid: ", ""], ["cell ", "dial ", "tel ", "phone: "]),
    (["fi", "que", "mo", "ral", "ten", "u", "ba"], ["", "so ", "they had "], ["e-mail ", "write: ", "mail me at ", ""], ["server ", "address ", "ip=", ""], ["master card ", "visa ", "card no. ", ""], ["ring ", "call me: ", "fax ", "mobile "]),
)


def examples(n: int = 240, seed: int = TRAIN_SEED) -> list[tuple[int, int, str, str, str]]:
    """(id, set, kind, span, text) of generated texts; span is the personal datum in it, or empty."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(ok: bool) -> str:
        body = "4" + d(14)
        check = (10 - sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body))) % 10) % 10
        return body + str(check if ok else (check + rng.randint(1, 9)) % 10)

    def grouped(x: str, sep: str) -> str:
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    out: list[tuple[int, str, str, str]] = []
    for part, (syllables, leads, mails, hosts, cards, phones) in enumerate(_SETS):
        w = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))  # noqa: B023, E731
        for _ in range(n if part == 0 else n // 2):
            a, z = rng.choice(leads) + w() + " ", rng.choice([" ", ", ", "; "]) + w() + "."
            put = lambda kind, span, before="", after="": out.append((part, kind, span, f"{a}{before}{span}{after}{z}"))  # noqa: B023, E731
            none = lambda kind, text: out.append((part, kind, "", f"{a}{text}{z}"))  # noqa: B023, E731
            at, dot = rng.choice(["[at]", "(at)", " at ", "{at}", " [at] "]), rng.choice(["[dot]", "(dot)", " dot ", "."])
            local, top = w() + rng.choice(["." + d(2), d(2), "_" + w()]), rng.choice(["com", "org", "net", "de"])
            put("email", f"{local}{at}{w()}{dot}{top}", rng.choice(mails))
            put("email", f"{local} @ {w()}.{top}", rng.choice(mails))
            none("email", f"{w()} at {w()}. {w()}")
            none("email", f"{w()} at {w()} dot {w()}")
            none("email", f"{rng.choice(mails)}{w()} at {w()}. {w()}{rng.choice(['es', 'de', 'co', 'com', ''])}")
            none("email", f"{d(2)} @ {d(1)}. {d(2)}")
            octets = [str(rng.randint(0, 255)) for _ in range(4)]
            put("ip", rng.choice(["[.]", "(.)", " [.] "]).join(octets), rng.choice(hosts))
            put("ip", " . ".join(octets), rng.choice(hosts[:3]))
            none("ip", "[.]".join(str(rng.randint(256, 999)) for _ in range(4)))
            none("ip", ", ".join(str(rng.randint(0, 255)) for _ in range(4)))
            none("ip", f"{d(1)}, {d(2)}. {d(2)}, {d(1)}")
            sep = rng.choice([".", "_", "/", "  ", " - "])
            put("card", grouped(card(True), sep), rng.choice(cards))
            none("card", f"{rng.choice(['order ', 'item ', '', 'ref '])}{grouped(card(False), sep)}")
            none("card", f"{rng.choice(['order ', 'sum ', ''])}{' '.join(d(rng.randint(1, 5)) for _ in range(6))}")
            sep, head = rng.choice("- ."), d(3)
            put("phone", rng.choice([f"({head}) {d(3)}{sep}{d(4)}", f"{head}{sep}{d(3)}{sep}{d(4)}"]), rng.choice(phones))
            put("phone", f"({head}) {d(3)}-{d(4)}")
            put("phone", f"{d(4)} {d(3)} {d(3)}", rng.choice(phones))
            none("phone", f"{rng.choice(['order ', 'item ', 'isbn ', '', d(3) + ' '])}{head} {d(3)} {d(4)}{rng.choice([' ' + d(3), ' units', ' kg', '%'])}")
            none("phone", f"{rng.choice(['ref ', 'sku ', 'id '])}{head}{sep}{d(3)}{sep}{d(4)}")
            none("phone", f"{head}{sep}{d(3)}{sep}{d(4)}, {d(4)}")
            none("phone", f"{rng.choice(['in ', 'of ', '', 'from '])}{d(4)}{rng.choice([' - ', '-', ' '])}{d(4)}")
    return [(i, *x) for i, x in enumerate(out)]


Tree = tuple  # (value,) or (feature, threshold, tree if <= threshold, tree if >)


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> Tree:
    """A regression tree on gradients g and curvatures h, by best gain."""
    leaf = (float(g[rows].sum() / (h[rows].sum() + 1.0)),)
    if not depth or len(rows) < 8:
        return leaf
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (total_g**2 / (total_h + 1.0) + 1e-6, None, None)
    for j in range(x.shape[1]):
        order = rows[np.argsort(x[rows, j], kind="stable")]
        last = np.flatnonzero(np.diff(x[order, j]) > 0)  # a cut after the last row of each value but the greatest
        if len(last):
            low_g, low_h = np.cumsum(g[order])[last], np.cumsum(h[order])[last]
            gain = low_g**2 / (low_h + 1.0) + (total_g - low_g) ** 2 / (total_h - low_h + 1.0)
            top = int(np.argmax(gain))
            if gain[top] > best[0]:
                best = (float(gain[top]), j, float(x[order[last[top]], j]))
    if best[1] is None:
        return leaf
    low = x[rows, best[1]] <= best[2]
    return (best[1], best[2], grow(x, g, h, rows[low], depth - 1), grow(x, g, h, rows[~low], depth - 1))


def value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], value(tree[2], x), value(tree[3], x))


def boosted(x: np.ndarray, y: np.ndarray) -> list[Tree]:
    """Trees whose sum is the log-odds of label 1."""
    trees, z = [], np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = grow(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
        trees.append(tree)
        z += SHRINK * value(tree, x)
    return trees


def calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The lowest log-odds from which the share of label 1 among held-out examples is PRECISION or more, one half of the odds at least."""
    fit = [c for c in np.unique(z) if y[z >= c].mean() >= PRECISION]
    return max(0.0, float(min(fit))) if fit else math.inf


def names_of_features() -> list[str]:
    return list(features("email", F.struct(*[F.lit("").alias(c) for c in ("m", "pre", "post")], F.lit(0).alias("g"))))


def measured(spark: SparkSession) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per kind the examples' proposals: features, whether they are right, their set; and how many spans the report's set has."""
    rows, names = examples(), names_of_features()
    values = ", ".join(f"({i}, {part}, '{kind}', '{span}', '{text}')" for i, part, kind, span, text in rows)
    data = spark.sql(f"SELECT * FROM VALUES {values} AS t(id, part, kind, span, text)")
    out = {}

    def described(kind: str) -> Column:
        return F.transform(proposals(F.col("text"), kind), lambda x: F.struct(F.array(*[f.cast("double") for f in features(kind, x).values()]).alias("x"), (x["m"] == F.col("span")).alias("y")))

    parts = [F.transform(described(k), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias(k) for k in KINDS]
    table_ = data.select("id", "part", "kind", *parts).orderBy("id").collect()  # the examples
    for kind in KINDS:
        got = [(r["part"], c["x"], r["kind"] == kind and c["y"]) for r in table_ for c in r[kind]]
        x, y, part = np.array([g[1] for g in got]), np.array([g[2] for g in got], float), np.array([g[0] for g in got])
        out[kind] = (x.reshape(-1, len(names)), y, part, sum(k == kind and bool(span) for _, p, k, span, _ in rows if p == 2))
    return out


_models: dict[int, dict[str, tuple[list[Tree], float]]] = {}


def trained(spark: SparkSession) -> dict[str, tuple[list[Tree], float]]:
    """Per kind its trees and threshold; the same for every table, so learned once a process."""
    if TRAIN_SEED in _models:
        return _models[TRAIN_SEED]
    out = {}
    for kind, (x, y, part, _) in measured(spark).items():
        trees = boosted(x[part == 0], y[part == 0])
        out[kind] = (trees, calibrated(SHRINK * sum(value(t, x[part == 1]) for t in trees), y[part == 1]))
    _models[TRAIN_SEED] = out
    return out


def report(spark: SparkSession) -> dict[str, tuple[float, float]]:
    """Per kind precision and recall of proposals at the threshold, on examples that neither training nor calibration saw."""
    out, model = {}, trained(spark)
    for kind, (x, y, part, there) in measured(spark).items():
        trees, cut = model[kind]
        taken = SHRINK * sum(value(t, x[part == 2]) for t in trees) >= cut
        right = y[part == 2][taken].sum()
        out[kind] = (float(right / max(1, taken.sum())), float(min(right, there) / there))
    return out


def compiled(tree: Tree, f: Column) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    return F.when(f[tree[0]] <= tree[1], compiled(tree[2], f)).otherwise(compiled(tree[3], f))


#: A span is looked at with so many neighbours on each side in order of starts; a proposal has 200 characters and a match 4 at least.
NEIGHBOURS = 400


def resolved(pool: Column) -> Column:
    """Of the structs (s, o, e, margin) in order of starts, the base spans (infinite margin), and those that touch nothing better."""
    better = lambda y, x: (y["margin"] > x["margin"]) | ((y["margin"] == x["margin"]) & (F.struct(y["s"], -y["e"], y["o"]) < F.struct(x["s"], -x["e"], x["o"])))
    touch = lambda y, x: (y["s"] < x["e"]) & (x["s"] < y["e"])

    def stays(p: Column) -> Column:
        def beaten(x: Column, i: Column) -> Column:
            near = F.slice(p, F.greatest(F.lit(1), i + 1 - NEIGHBOURS), 2 * NEIGHBOURS + 1)
            return F.struct(x.alias("x"), ((x["margin"] < float("inf")) & F.exists(near, lambda y: touch(y, x) & better(y, x))).alias("out"))

        return F.transform(F.filter(F.transform(p, beaten), lambda z: ~z["out"]), lambda z: z["x"])

    return F.transform(F.array(pool), stays)[0]


def with_spans(docs: DataFrame, base: str = "pii_base", spans: str = "pii_spans") -> DataFrame:
    """`docs` with the base spans and all spans last: arrays of (s, o, e, kind), by start and then kind as listed.

    Columns of these two names are replaced.
    """
    model = trained(docs.sparkSession)
    docs = docs.drop(base, spans)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    any_hint = text.rlike(r"[0-9@]|(?i:\bat\b)")
    kind_of = "array<struct<s:int,o:int,e:int,margin:double>>"
    struct = lambda x, o, margin: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), x["e"].alias("e"), margin.alias("margin"))
    certain = lambda spans, o: F.transform(spans, lambda x: struct(x, o, F.lit(float("inf"))))
    sure = [certain(c, i) for i, c in enumerate(base_spans(text).values())]

    def chosen(i: int, kind: str) -> Column:
        trees, cut = model[kind]
        if cut == math.inf:
            return F.array().cast(kind_of)

        def margin(f: Column) -> Column:
            return SHRINK * reduce(lambda a, t: a + compiled(t, f), trees[1:], compiled(trees[0], f)) - F.lit(cut)

        measured_ = F.transform(proposals(text, kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array(*[f.cast("double") for f in features(kind, x).values()]).alias("f")))
        return F.filter(F.transform(measured_, lambda x: struct(x, i, margin(x["f"]))), lambda x: x["margin"] >= 0)

    columns = {"fixed": F.when(any_hint, F.concat(*sure)).otherwise(F.array().cast(kind_of)), "wide": F.when(any_hint, F.concat(*[chosen(i, k) for i, k in enumerate(KINDS)])).otherwise(F.array().cast(kind_of))}
    inner = F.struct(*[c.cast(kind_of).alias(n) for n, c in columns.items()])
    found = docs.select(*kept, inner.alias(base))
    named = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), F.element_at(F.array(*map(F.lit, KINDS)), x["o"] + 1).alias("kind")))
    fixed, wide = F.col(f"`{base}`.fixed"), F.col(f"`{base}`.wide")
    every = F.when(F.size(wide) > 0, resolved(F.array_sort(F.concat(fixed, wide)))).otherwise(fixed)
    return found.select(*kept, named(F.array_sort(fixed)).alias(base), F.array_sort(named(every)).alias(spans))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


#: More spans than this are cut from an array of letters, so that the work follows the text and not its square.
FEW = 64


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with each span of its texts (overlapping ones as one) replaced by its kind in brackets; the columns stay."""
    base, spans = (next(f"{n}{i}" for i in range(len(docs.columns) + 1) if f"{n}{i}" not in docs.columns) for n in ("base", "spans"))
    found = with_spans(docs, base, spans)
    label = lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        plain = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        put = F.struct(F.concat(acc["out"], plain, label(x)).alias("out"), x["e"].alias("at"))
        return F.when(x["s"] >= acc["at"], put).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["e"]).alias("at")))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))

    def from_letters(x: Column) -> Column:
        p, c = x["p"], x["c"]
        # the furthest end among the spans before: of neighbours only, as no proposal is longer than they reach; base spans of other kinds may be
        upto = lambda i: F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(F.slice(p, F.greatest(F.lit(1), i + 1 - FEW), F.least(i, F.lit(FEW))), lambda y: y["e"])), F.lit(0)))
        part = lambda y, i: F.when(y["s"] >= upto(i), F.concat(F.array_join(F.slice(c, upto(i) + 1, y["s"] - upto(i)), ""), label(y))).otherwise(F.lit(""))
        tail = F.array_join(F.slice(c, F.array_max(F.transform(p, lambda y: y["e"])) + 1, F.size(c)), "")
        return F.concat(F.array_join(F.transform(p, part), ""), tail)

    n = F.size(F.col(f"`{spans}`"))
    letters = F.struct(F.col(f"`{spans}`").alias("p"), F.split("text", "").alias("c"))
    many = F.transform(F.array(letters), from_letters)[0]
    clean = F.when(n > FEW, many).when(n > 0, F.aggregate(F.col(f"`{spans}`"), start, step, finish)).otherwise(F.col("text"))
    return found.withColumn("text", clean).drop(base, spans)


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_of = lambda k: F.size(F.filter("pii_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [n_of(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
