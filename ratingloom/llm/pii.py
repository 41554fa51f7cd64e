"""Personal data in texts: base patterns, and candidates that boosted trees choose from.

Everything is a column expression over the row's own text; nothing is shuffled. Base patterns find what
is certain. Generous generators propose further, overlapping spans; each gets features of its format
and its surroundings, a score from gradient-boosted trees, and is taken at its kind's threshold, if no
base span and no better candidate overlaps it. The trees are learnt from made-up sentences whose personal
data are known, in many spellings and next to look-alikes (see examples), and from the candidates of all
documents that base spans confirm or contradict; they are then written out as one CASE
expression for each tree. A model can be kept as JSON and used again.

Patterns are written so that they run in linear time and without recursion on any text: quantified
groups are possessive, and runs are entered at their start or where the match before ended (\\G).
"""

from __future__ import annotations

import dataclasses
import itertools
import json
import math
import random
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
BASE = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_DOT = r"(?:\.|\x20?[\[(](?:\.|dot|DOT|punkt|point|punto)[\])]\x20?|\x20(?:dot|DOT|punto)\x20)"
_AT = r"(?:@|\x20?[\[({](?:@|at|AT|arroba|ARROBA)[\])}]\x20?|\x20(?:at|AT|arroba)\x20)"
GENERATORS = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    r"(?<![0-9])[0-9]{1,4}(?:(?:\.|,|\x20?[\[(](?:\.|dot)[\])]\x20?|\x20\.\x20)[0-9]{1,4}){3}(?![0-9])",
    r"(?<![0-9])[0-9](?:[\x20._-]{0,2}[0-9]){11,18}(?![0-9])",
    r"(?<![0-9A-Za-z])(?:\+|00|\()?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])",
)
FEATURES = ("kind", "size", "digits", "groups", "longest", "shortest", "plus", "paren", "dots", "dashes", "blanks", "at", "letters", "luhn", "octets", "glued_before", "glued_after", "hint", "secret", "zero", "date", "first", "commas", "spelt")
#: Distinct rows of features that a task learns from.
ROWS_A_TASK = 50_000
_CANDIDATE = "array<struct<start:int,kind:int,end:int,s:string,before:string,after:string>>"
_SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclasses.dataclass(frozen=True)
class Model:
    """Trees as nested (feature, threshold, left, right) or leaf values, their weights, and a threshold for each kind."""

    trees: tuple = ()
    weights: tuple[float, ...] = ()
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)

    def to_json(self) -> str:
        return json.dumps({"features": FEATURES, "trees": self.trees, "weights": self.weights, "thresholds": self.thresholds})

    @classmethod
    def from_json(cls, text: str) -> Model:
        held = json.loads(text)
        if tuple(held["features"]) != FEATURES:
            raise ValueError("the model was made with other features")
        node = lambda n: (n[0], n[1], node(n[2]), node(n[3])) if isinstance(n, list) else float(n)
        return cls(tuple(map(node, held["trees"])), tuple(held["weights"]), tuple(held["thresholds"]))


#: Words before a candidate that speak for it, and against it.
HINTS = (
    "tel", "tél", "phone", "call", "fax", "mobile", "cell", "ring", "text", "card", "visa", "amex", "mastercard", "mail", "contact", "write", "reach", "host", "server", "address", "ip", "gateway", "anruf", "rufnummer", "handy", "karte",
    "schreib", "schreiben sie", "telefon", "téléphone", "carte", "appelez", "écrire", "teléfono", "telefono", "móvil", "llame", "llama", "tarjeta", "correo", "courriel",
)
OTHERS = (
    "token", "key", "secret", "hash", "sha", "uuid", "version", "release", "build", "isbn", "order", "invoice", "no", "nr", "ticket", "serial", "item", "part", "bestellung", "rechnung", "pedido", "factura", "commande", "facture", "on", "am",
    "page", "row", "total", "sum", "id", "code", "ref", "tracking", "patent",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda t, i: t + let(digit(i), lambda d: F.when(i % 2 == 1, double(d)).otherwise(d)))
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def octets(s: Column) -> Column:
    """Whether all dotted parts are at most 255."""
    value = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(s, r"\."), lambda p: (F.length(value(p)) <= 3) & (F.coalesce(value(p).try_cast("int"), F.lit(0)) <= 255))


def _valid(kind: int, s: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return octets(s)
    n = F.length(_digits(s))
    return n.between(12, 19) & luhn(_digits(s)) if kind == 2 else n.between(9, 15)


def _hits(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column] | None, kept: str) -> Column:
    """The valid matches of pattern in text, with code point places; ``kept`` is the type of the result."""
    bound = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def walk(v: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            s, before, after = F.get(v["hits"], i), F.get(v["gaps"], i), F.get(v["gaps"], i + 1)
            start = state["at"] + F.length(before)
            end = start + F.length(s)
            fields = [start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")]
            if kept == _CANDIDATE:
                fields += [s.alias("s"), F.right(before, F.lit(24)).alias("before"), F.left(after, F.lit(2)).alias("after")]
            found = F.array(F.struct(*fields)).cast(kept)
            if valid is not None:
                found = F.when(valid(s), found).otherwise(F.array().cast(kept))
            return F.struct(end.alias("at"), F.concat(state["out"], found).alias("out"))

        n = F.size(v["hits"])
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kept).alias("out"))
        return F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), start, step)["out"]

    return let(bound, walk)


def _may_hold(text: Column, kind: int, base: bool) -> Column:
    """A quick test that every match passes."""
    if kind == 0:
        marks = ("@",) if base else ("@", "at", "AT", "arroba", "ARROBA")
        return reduce(Column.__or__, (F.contains(text, F.lit(m)) for m in marks))
    return text.rlike("[0-9]")


def _all(text: Column, patterns: tuple[str, ...], base: bool) -> Column:
    kept = _SPAN if base else _CANDIDATE
    found = [F.when(_may_hold(text, k, base), _hits(text, p, k, (lambda s, k=k: _valid(k, s)) if base else None, kept)).otherwise(F.array().cast(kept)) for k, p in enumerate(patterns)]
    return F.array_sort(F.concat(*found)) if base else F.concat(*found)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the certain finds of a text (a string column that isn't null), by start and kind."""
    return _all(text, BASE, True)


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, s, before, after>> of all generators' proposals, with up to 24 characters before and 2 after."""
    return _all(text, GENERATORS, False)


def features(c: Column) -> Column:
    """The FEATURES of a candidate, as an array of doubles."""
    s, d = c["s"], _digits(c["s"])
    count = lambda chars: F.length(F.regexp_replace(s, f"[^{chars}]", ""))
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: F.length(g) > 0)
    lengths = F.transform(groups, F.length)
    values = [
        c["kind"], F.length(s), F.length(d), F.size(groups), F.coalesce(F.array_max(lengths), F.lit(0)), F.coalesce(F.array_min(lengths), F.lit(0)),
        F.startswith(s, F.lit("+")), F.contains(s, F.lit("(")), count("."), count("-"), count(" "), F.contains(s, F.lit("@")), count("A-Za-z"),
        F.length(d).between(12, 19) & luhn(d), (c["kind"] == 1) & octets(s),
        c["before"].rlike(r"[0-9A-Za-z\"'_=/#.-]$"), c["after"].rlike(r"^[0-9A-Za-z\"'_=/]"),
        c["before"].rlike(rf"(?i)(?:{'|'.join(HINTS)})(?:[^\p{{L}}]{{0,4}}|\x20(?:is|me|at|to|us|under|on|me at|us at|from|ist|es|est|al|a|au|unter|with|an)[:,]?\x20)$"),
        c["before"].rlike(rf"(?i)(?:{'|'.join(OTHERS)})[^\p{{L}}]{{0,6}}$"),
        F.startswith(s, F.lit("0")), d.rlike("^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:[0-2][0-9]|3[01])"), F.coalesce(F.left(d, F.lit(1)).try_cast("int"), F.lit(-1)), count(","),
        s.rlike(rf"(?:{_AT.replace('@|', '', 1)}.*|[\[(]\.[\])].*)(?:[\[(]|\x20(?:dot|DOT|punto)\x20)"),
    ]
    return F.array(*(v.cast("double") for v in values))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _tree(node: tuple | float, f: Column) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    feature, threshold, left, right = node
    return F.when(F.get(f, F.lit(feature)) <= threshold, _tree(left, f)).otherwise(_tree(right, f))


def probability(model: Model, f: Column) -> Column:
    """The trees' probability that a candidate with these features is personal data."""
    margin = F.lit(0.0)
    for weight, tree in zip(model.weights, model.trees):
        margin = margin + F.lit(weight) * _tree(tree, f)
    return 1 / (1 + F.exp(-2 * margin))


def _read_tree(node) -> tuple | float:
    if node.numDescendants() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _read_tree(node.leftChild()), _read_tree(node.rightChild())


def _card(rng: random.Random) -> str:
    """Sixteen (or fifteen) digits that pass the Luhn check."""
    digits = [int(c) for c in rng.choice(("4", "51", "55", "37", "6011"))]
    n = 15 if digits[0] == 3 else 16
    digits += [rng.randrange(10) for _ in range(n - 1 - len(digits))]
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return "".join(map(str, [*digits, -total % 10]))


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randrange(10 ** (n - 1), 10**n))


def _right(rng: random.Random, kind: int) -> str:
    """A made-up piece of personal data in one of many spellings, mostly such as no base pattern finds."""
    pick, digits = rng.choice, lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    if kind == 0:
        name = pick(("ana", "joe", "li", "max", "eva", "omar", "nina", "tom")) + pick(("", ".", "_", "-")) + pick(("ruiz", "berg", "chen", "diaz", "novak", "x")) + pick(("", digits(2)))
        at = pick((" (at) ", "(at)", " [at] ", "[at]", " at ", " (AT) ", " AT ", " (arroba) ", " arroba ", " [@] ", "@", " {at} "))
        dot = pick((" (dot) ", "(dot)", " [dot] ", " [.] ", "[.]", " dot ", " (punto) ", " DOT ", " (point) ")) if at == "@" or rng.random() < 0.75 else "."
        dot = pick((" dot ", " DOT ", " punto ")) if dot == "." and at in (" at ", " AT ", " arroba ") else dot
        return name + at + dot.join(pick((("mail", "example", "org"), ("example", "com"), ("correo", "es"), ("post", "de"), ("host7", "net"))))
    if kind == 1:
        return pick(("[.]", " [.] ", "(.)", "(dot)", "[dot]", ",", " . ")).join(str(rng.randrange(1, 255)) for _ in range(4))
    if kind == 2:
        raw, gap = _card(rng), pick((".", "_", "  ", " - ", "--", ". "))
        cuts = (4, 6, 5) if len(raw) == 15 else (4, 4, 4, 4)
        ends = [sum(cuts[: i + 1]) for i in range(len(cuts))]
        return gap[:2].join(raw[e - c : e] for e, c in zip(ends, cuts))
    area, a, b = _number(rng, 3), digits(3), digits(4)
    return pick((f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"{area} {a} {b}", f"0049 {digits(2)} {digits(7)}", f"0{digits(2)} {digits(3)} {digits(4)}", f"0{_number(rng, 3)} {digits(6)}", f"00{_number(rng, 2)}-{digits(3)}-{digits(6)}", f"1-800-{a}-{b}", f"06 {digits(2)} {digits(2)} {digits(2)} {digits(2)}"))


def _wrong(rng: random.Random, kind: int) -> str:
    """A made-up look-alike, with the words that usually stand before it."""
    pick = rng.choice
    word = lambda: pick(("look", "meet", "arrive", "home", "work", "point", "sold", "stay", "aim", "open"))
    if kind == 0:
        return pick((f"{word()} at {pick(('home', 'noon', 'night', 'once'))}.{word().title()}", f"{word()} at {rng.randrange(24)}.{rng.randrange(10, 60)}", f"{word()} at {pick(('example', 'shop', 'docs'))}.{pick(('com', 'org'))}", f"{word()} at v{rng.randrange(9)}.{rng.randrange(20)}", f"{word()} at section.{rng.randrange(9)}"))
    if kind == 1:
        over = [str(rng.randrange(1, 999)) for _ in range(4)]
        over[rng.randrange(4)] = str(rng.randrange(256, 2000))
        return pick((f"a sum of {rng.randrange(1, 99)},{_number(rng, 3)},{_number(rng, 3)},{_number(rng, 3)}", "version " + ".".join(over), "rows " + ",".join(over), f"build {rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(30)}.{_number(rng, 4)}"))
    if kind == 2:
        raw = _card(rng)
        bad = raw[:-1] + str((int(raw[-1]) + rng.randrange(1, 10)) % 10)
        return pick((f"order {bad}", f"serial {bad[:4]}.{bad[4:8]}.{bad[8:12]}.{bad[12:]}", f"at 20{_number(rng, 2)}0{rng.randrange(1, 10)}1{rng.randrange(10)}{_number(rng, 6)}", f"ISBN 978-{rng.randrange(10)}-{_number(rng, 2)}-{_number(rng, 6)}-{rng.randrange(10)}", f"id {_number(rng, rng.choice((13, 14, 15, 17)))}", f"token {bad}", f"ref {bad[:8]}_{bad[8:]}", bad))
    return pick((f"on 20{_number(rng, 2)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}", f"order {_number(rng, rng.choice((7, 8, 9, 10)))}", f"invoice no {_number(rng, 3)}-{_number(rng, 4)}-{_number(rng, 3)}", f"a total of {rng.randrange(1, 99)} {_number(rng, 3)} {_number(rng, 3)}",
                 f"from 19{_number(rng, 2)} to 20{_number(rng, 2)}, {_number(rng, 7)} of them", f"id {_number(rng, 12)}", f"ISBN 3-{_number(rng, 5)}-{_number(rng, 3)}-{rng.randrange(10)}", f"code {_number(rng, 4)}.{_number(rng, 4)}", f"{rng.randrange(10, 90)}.{_number(rng, 6)}", f"ticket {_number(rng, 8)}"))


def examples(n: int = 4000, seed: int = 11) -> list[tuple[str, list[tuple[int, str]]]]:
    """n made-up sentences, each with the personal data in it as (kind, string): half of them hold some, half only look-alikes."""
    rng, out = random.Random(seed), []
    filler = lambda k: " ".join(rng.choice(("the", "new", "list", "der", "neue", "la", "casa", "et", "puis", "river", "was", "seen", "y", "later", "sur", "ganz")) for _ in range(rng.randint(1, k)))
    leads = (
        ("mail", "write to", "contact", "Correo:", "E-Mail:", "courriel", "reach me at", "or", ""), ("host", "server", "IP:", "from", "gateway", "und", ""),
        ("card", "Visa", "paid with", "Karte", "tarjeta", "carte", ""), ("call", "tel.", "phone:", "Fax", "ring", "Telefon", "móvil", "tél", "llame al", "text", ""),
    )
    for i in range(n):
        kind = i % 4
        if i // 4 % 2:
            held = _right(rng, kind)
            lead = rng.choice(leads[kind])
            out.append((f"{filler(5)} {lead}{' ' * (lead != '')}{held}" + rng.choice((" " + filler(3), ". " + filler(3), ", " + filler(3), "", ".")), [(kind, held)]))
        else:
            out.append((f"{filler(5)} {_wrong(rng, kind)} {filler(3)}", []))
    return out


_NAMED = "array<struct<kind:int,s:string>>"


def _named(docs: DataFrame, made: int, text_col: str) -> DataFrame:
    """(made, half, label, *FEATURES, n): how many candidates of all documents (made 0) and of the examples (made 1) have these features, half and label."""
    empty = F.array().cast(_CANDIDATE)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("text", base_spans(F.col("text")).alias("base"))
    sure = texts.select("base", F.explode(F.when(F.size("base") > 0, candidates(F.col("text"))).otherwise(empty)).alias("c"))
    same = lambda b: (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")) & (b["kind"] == F.col("c.kind"))
    seen = sure.select(F.exists("base", same).alias("right"), F.exists("base", lambda b: _overlaps(b, F.col("c"))).alias("known"), "c").where("known").select("right", "c")
    told = docs.sparkSession.createDataFrame(examples(made), f"text string, data {_NAMED}").select("data", F.explode(candidates(F.col("text"))).alias("c"))
    taught = told.select(F.array_contains("data", F.struct(F.col("c.kind").alias("kind"), F.col("c.s").alias("s"))).alias("right"), "c")
    named = seen.withColumn("made", F.lit(0)).unionByName(taught.withColumn("made", F.lit(1)))
    half = F.pmod(F.xxhash64("c.s", "c.before", "c.start"), F.lit(2)).alias("half")
    rows = named.select("made", half, F.col("right").cast("double").alias("label"), features(F.col("c")).alias("f"))
    rows = rows.select("made", "half", "label", *(F.get("f", F.lit(i)).alias(name) for i, name in enumerate(FEATURES)))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def fit(docs: DataFrame, made: int = 4000, trees: int = 12, depth: int = 4, precision: float = 0.97, text_col: str = "text") -> Model:
    """Trees and thresholds from ``made`` examples and all documents.

    In an example a candidate is right if it is one of the known data, and wrong otherwise. In a document
    a candidate is right if it equals a base span of its kind, and wrong if it only overlaps base spans; of
    others nothing is known, and they teach nothing. All candidates count; those of one kind in documents weigh
    as much as those in examples together, where there are more of them. Half of the candidates fit the trees; on
    the other half, a kind's threshold is the least score from which on ``precision`` of them are right. The driver
    gets trees, and of each kind how many candidates have which score, to four digits.
    """
    rows = _named(docs, made, text_col).persist()
    try:
        if rows.select("half", "label").distinct().count() < 4:
            return Model()
        held = {(int(r["kind"]), r["made"]): r["n"] for r in rows.groupBy("kind", "made").agg(F.sum("n").alias("n")).collect()}
        shares = [min(1.0, held[k, 1] / held[k, 0]) if (k, 0) in held and (k, 1) in held else 1.0 for k in range(len(KINDS))]
        weight = F.col("n") * F.when(F.col("made") == 1, 1.0).otherwise(F.get(F.array(*map(F.lit, shares)), F.col("kind").cast("int")))
        own = rows.where("half = 0")
        n = own.count()
        table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(own.withColumn("weight", weight)).coalesce(max(2, n // ROWS_A_TASK))
        # Spark reads the values that trees may split at from so many rows as the square of maxBins: here, from all.
        gbt = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=max(32, math.isqrt(n) + 1), stepSize=0.3, seed=7, labelCol="label", featuresCol="features", weightCol="weight").fit(table)
        java = list(gbt._java_obj.trees())
        model = Model(tuple(_read_tree(t.rootNode()) for t in java), tuple(float(w) for w in gbt.treeWeights))
        scored = rows.where("half = 1").select("kind", "made", "label", "n", F.floor(probability(model, F.array(*FEATURES)) * 10_000).alias("p"))
        counts = scored.groupBy("kind", "made", "p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right")).collect()
        heavy = lambda r, k: 1.0 if r["made"] else shares[k]
        scores = [[(r["p"], heavy(r, k) * r["n"], heavy(r, k) * r["right"]) for r in counts if r["kind"] == k] for k in range(len(KINDS))]
        return dataclasses.replace(model, thresholds=tuple(_threshold(s, precision) for s in scores))
    finally:
        rows.unpersist()


def _threshold(scores: list[tuple[int, float, float]], precision: float) -> float:
    """The least score, of 0.5 at least, from which on the share of right candidates is ``precision``; above all scores if there is none."""
    least, n, right = 2.0, 0, 0.0
    for p, own in itertools.groupby(sorted(scores, reverse=True), lambda s: s[0]):
        for _, number, good in own:
            n, right = n + number, right + good
        if right >= precision * n:
            least = p / 10_000
    return max(0.5, least)


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, base, spans, *keep): the base spans and all spans of every whole text, by start, kind and end.

    One row for each row of docs; a null text is empty and has none. ``keep`` names columns of docs to
    carry along; they may not be called doc_id, base or spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), *keep, base_spans(text).alias("base"), (candidates(text) if model.trees else F.array().cast(_CANDIDATE)).alias("__c"))
    if not model.trees:
        return found.select("doc_id", "base", F.col("base").alias("spans"), *keep)
    limits = F.array(*map(F.lit, model.thresholds))
    score = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), let(features(c), lambda f: probability(model, f)).alias("p"))
    free = F.filter("__c", lambda c: ~F.exists("base", lambda b: _overlaps(b, c)))
    chosen = F.filter(F.transform(free, score), lambda c: c["p"] >= F.get(limits, c["kind"]))
    better = lambda d, c: (d["p"] > c["p"]) | ((d["p"] == c["p"]) & ((d["start"] < c["start"]) | ((d["start"] == c["start"]) & (d["kind"] < c["kind"]))))
    alone = let(chosen, lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda d: _overlaps(d, c) & better(d, c))))
    added = F.when(F.size("__c") > 0, F.transform(alone, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))).otherwise(F.array()).cast(_SPAN)
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"), *keep)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in square brackets; of overlapping spans the first names the place."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(state: Column, s: Column) -> Column:
        before = F.substr(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when(s["start"] >= state["at"], F.concat(before, F.get(names, s["kind"]))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], mark).alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda st: F.concat(st["out"], F.substr(text, st["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of its texts redacted; rows and columns stay, null texts stay null."""
    names = docs.columns
    held = docs.select(*(F.col(f"`{c}`").alias(f"__d{i}") for i, c in enumerate(names)))
    at = {c: f"__d{i}" for i, c in enumerate(names)}
    found = find(held, model, at[id_col], at[text_col], keep=tuple(at.values()))
    text = F.when(F.col(at[text_col]).isNotNull(), redacted(F.col(at[text_col]), F.col("spans")))
    return found.select(*((text if c == text_col else F.col(at[c])).alias(c) for c in names))
