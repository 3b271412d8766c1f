"""Personal data: a base of exact patterns, and spans that boosted trees select among overlapping proposals.

* **Base.** Email addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers by their patterns, leftmost and
  non-overlapping for each kind; a match that fails its check is dropped. Base spans always stay.
* **Generators** of high recall propose further spans in the rest of the text: written-out addresses ("name [at] host [dot] org"),
  any grouping of digits as a phone or card number, colon-separated or written-out IP addresses, long mixed strings as
  secrets. Proposals may overlap, also those of different kinds; they overlap base spans only where base spans overlap each other.
* **Trees.** Spark's gradient-boosted trees score each proposal by its format (lengths, groups, check digit, character classes,
  shape of a date or version) and its context (a cue word before it, the characters next to it). They are fitted on
  ``LABELLED`` rows that :func:`labelled` makes by rule: wanted spans in many spellings, and look-alikes (dates, order
  numbers, versions, times, hashes of other things). The fit doesn't depend on the corpus.
* **Thresholds.** On rows held out from the fit, each kind's threshold is the lowest score from which at least ``PRECISION``
  of the proposals are right. A proposal that reaches it is a span.

Everything on the rows is one projection of built-in functions: no shuffle, and no state beyond one row. The trees become one
nested CASE expression. Patterns start where a run of their characters starts or the match before ended, and repeat possessively, so
time grows with the text's length also for very long runs.

Cases: a NULL or empty text has no spans; rows that repeat are treated alike; an empty table gives an empty result; all columns of the
input stay in :func:`find`, whatever their names (a column ``spans`` is replaced).
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

KINDS = ("email", "ip", "card", "phone", "secret")

#: Fixed patterns of the contract; the look-ahead, ``\\G`` and the look-behind only keep the search from trying places inside a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all (found without a regular expression).
NEEDS = {"email": ("@",), "ip": (".",), "card": (), "phone": ("+",)}
#: Generators over the text without base spans: (kind, texts of which one must occur, pattern).
_DOT = r" ?(?:\[dot\]|\(dot\)|\{dot\}|\.| dot ) ?"
GENERATORS = (
    ("email", ("@", "[at]", "(at)", "{at}"),
     rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{{at\}}|@) ?[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"),
    ("email", (" dot ",), r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++"),
    ("phone", (), r"(?=[(0-9])(?<![0-9])\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,14}+(?![0-9])"),
    ("card", (), r"(?=[0-9])(?<![0-9])[0-9](?:[ .\-/]{0,2}[0-9]){12,18}+(?![0-9])"),
    ("card", (), r"(?=[0-9])(?<![0-9])[0-9]{13,19}+(?![0-9])"),
    ("ip", (":",), r"(?=[0-9A-Fa-f:])(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("ip", ("[.]", "dot"), r"(?=[0-9])(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\[dot\]|\(dot\)|dot) ?[0-9]{1,3}){3}+(?![0-9])"),
    ("secret", (), r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"),
)
#: Words that announce each kind, in the languages of the corpora at hand.
CUES = {
    "email": "mail|contact|kontakt|contacto|correo|courriel|write to|reach",
    "ip": "ip|host|server|serveur|servidor|address|adresse",
    "card": "card|karte|carte|tarjeta|visa|credit",
    "phone": "phone|call|tel|tél|telefon|téléphone|teléfono|mobile|fax|ruf",
    "secret": "token|key|secret|password|passwort|clave|credential",
}
LABELLED = 6000         # rows made for the fit; a fourth of them is held out for the thresholds
PRECISION = 0.99
FLOOR = 0.7             # no threshold is lower
ROUNDS, DEPTH = 10, 3
CONTEXT = 24            # code points of context before a proposal
FILL = "\x01"           # stands for base spans in the text that the generators see
BLOCK = 256

EMPTY = "array<struct<s:int,e:int,v:string,before:string,after:string>>"


# ------------------------------------------------------------------ matches with places

def _running(lengths: Column) -> Column:
    """Sums of the elements before each one, by blocks (an array that grows by one element at a time would cost its square)."""
    def local(block: Column) -> Column:
        return F.aggregate(block, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    count = F.ceil(F.size(lengths) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), count), lambda b: F.slice(lengths, (b - 1) * BLOCK + 1, F.lit(BLOCK)))
    starts = local(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)))
    return F.flatten(F.zip_with(F.transform(blocks, lambda b: F.slice(local(b), F.lit(1), F.size(b))),
                                F.slice(starts, F.lit(1), count), lambda b, at: F.transform(b, lambda x: x + at)))


def _found(text: Column, needs: tuple[str, ...], pattern: str) -> Column:
    """Leftmost non-overlapping matches; texts that can't hold one aren't searched."""
    all_of = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if not needs:
        return all_of
    return F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needs]), all_of).otherwise(
        F.array().cast("array<string>"))


def _gaps(text: Column, found: Column, pattern: str) -> Column:
    """What stands between the matches; empty if there are none."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def _steps(found: Column, gaps: Column) -> Column:
    """Length of each match with the gap before it."""
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.length(g) + F.length(v))


def _placed(found: Column, gaps: Column, at: Column) -> Column:
    """start, end (code points, end exclusive), value, what stands before and after each match."""
    k = F.size(found)
    zipped = F.arrays_zip(found.alias("v"), at.alias("at"), F.slice(gaps, F.lit(1), k).alias("g"), F.slice(gaps, F.lit(2), k).alias("a"))
    spans = F.transform(zipped, lambda m: F.struct(
        (m["at"] + F.length(m["g"])).alias("s"), (m["at"] + F.length(m["g"]) + F.length(m["v"])).alias("e"), m["v"].alias("v"),
        F.right(m["g"], F.lit(CONTEXT)).alias("before"), F.left(m["a"], F.lit(2)).alias("after")))
    return F.when(k > 0, spans).otherwise(F.array().cast(EMPTY))


def matches(rows: DataFrame, keep: list[str], patterns: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """``keep`` and a column of placed matches in ``t`` for each pattern (name -> what it needs, pattern).

    Each step is a projection of its own: a column that a lambda or several expressions use is then computed once a row."""
    v, g, w = "v_{}".format, "w_{}".format, "x_{}".format
    rows = rows.select(*dict.fromkeys([*keep, "t"]), *[_found(F.col("t"), needs, p).alias(v(k)) for k, (needs, p) in patterns.items()])
    rows = rows.select(*keep, *[v(k) for k in patterns], *[_gaps(F.col("t"), F.col(v(k)), p).alias(g(k))
                                                          for k, (_, p) in patterns.items()])
    rows = rows.select("*", *[_steps(F.col(v(k)), F.col(g(k))).alias(w(k)) for k in patterns])
    return rows.select(*keep, *[_placed(F.col(v(k)), F.col(g(k)), F.when(F.size(w(k)) > 0, _running(F.col(w(k)))).otherwise(
        F.array().cast("array<int>"))).alias(k) for k in patterns])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn sum's last digit (0 for valid numbers) of up to 20 digits."""
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)

    def total(padded: Column) -> Column:
        places = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.substring(padded, i, F.lit(1)).cast("int"))
        return F.aggregate(F.transform(places, lambda d, i: F.when(i % 2 == 0, twice(d)).otherwise(d)), F.lit(0), lambda acc, d: acc + d)

    # the lambda over one element keeps the padded text from being made again for each digit
    return F.get(F.transform(F.array(F.lpad(digits, 20, "0")), total), F.lit(0)) % 10


def holds(kind: str, value: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        digits = digits_of(value)
        return F.when(F.length(digits).between(14, 19), luhn(digits) == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(value)).between(10, 15)
    return F.lit(True)


def _masked(text: Column, kind: str) -> Column:
    """``text`` with each valid match overwritten by as many fill characters."""
    found = F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))
    gaps = F.split(text, BASE[kind], -1)
    parts = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.concat(g, F.when(
        holds(kind, v), F.repeat(F.lit(FILL), F.length(v))).otherwise(v)))
    return F.concat(F.array_join(parts, ""), F.element_at(gaps, -1))


# ------------------------------------------------------------------ features

def announced(kind: str, before: Column) -> Column:
    """Whether a cue word of the kind stands before the proposal."""
    return F.coalesce(before.rlike(rf"(?i)(?:{CUES[kind]})[a-z]{{0,4}}[^A-Za-z]{{0,8}}$"), F.lit(False))


def features(m: Column) -> Column:
    """Numbers that describe the format and context of a proposal (kind, v, before, after, d: digits, cue)."""
    v, before, after, digits = m["v"], m["before"], m["after"], m["d"]
    groups = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
    longest = F.aggregate(groups, F.lit(0), lambda a, g: F.greatest(a, F.length(g)))
    letters = F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
    says = lambda c, p: F.coalesce(c.rlike(p), F.lit(False)).cast("double")
    numbers = [
        F.length(v), F.length(digits), letters, F.length(v) - F.length(digits) - letters, F.size(groups), longest,
        F.when(F.length(digits).between(13, 19), (luhn(digits) == 0).cast("int")).otherwise(-1),
        F.size(F.regexp_extract_all(v, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0))),
        says(v, "[a-z]") + says(v, "[A-Z]") + says(v, "[0-9]"),
        says(v, r"^(?:19|20)[0-9]{2}[ ./-]?[01][0-9][ ./-]?[0-3][0-9]|^[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)?[0-9]{2}(?![0-9])"),
        says(v, r"^\(?0|^\("), says(v, r"^[0-9]+$"), says(v, r"^[0-9a-f]+$|^[0-9A-F]+$"), says(v, r"^[0-9]{1,2}(:[0-9]{2})+$"),
        says(v, r"\[|\(at|\(dot|\{| at .* dot "), says(v, r"(?i)[. \])}](?:com|org|net|edu|de|fr|es|io)$"),
        says(v, r"^\(?[0-9]{2,4}[) ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,4}$"), says(v, r"^[0-9]{4}([ .-]{1,2}[0-9]{4}){3}$"),
        m["cue"],
        says(before, r"""["'=:]\s?$"""), says(before, r"[A-Za-z0-9_./@-]$"), says(after, r"^[A-Za-z0-9_/@-]|^\.[0-9]"),
        says(before, r"(?i)(?:order|isbn|version|invoice|page|total|since|date|commit|sha|id|nr|no)[^A-Za-z]{0,4}$"),
    ]
    return F.array(*[n.cast("double") for n in numbers], *[(m["kind"] == k).cast("double") for k in range(len(KINDS))])


# ------------------------------------------------------------------ labelled rows and the fit

def labelled(spark: SparkSession, n: int = LABELLED, seed: int = 7) -> DataFrame:
    """(id, kind, label, before, v, after): ``n`` rows made by rule, wanted spans (1) and look-alikes (0) in turn."""
    draw = random.Random(seed)
    some = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    code = lambda k: "".join(draw.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(draw.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(k))
    word = lambda: draw.choice("the of und le casa report thing on with river since".split())
    four = lambda c, s: s.join(c[k:k + 4] for k in range(0, 16, 4))
    day = lambda: f"{draw.randrange(1980, 2030)}-{draw.randrange(1, 13):02}-{draw.randrange(1, 29):02}"
    small = lambda: str(draw.randrange(256))

    def card(right: bool) -> str:
        body = draw.choice("345") + some(14)
        check = -sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, body))) % 10
        return body + str(check if right else (check + draw.randrange(1, 10)) % 10)

    def address() -> str:
        at, dot = draw.choice([" [at] ", "(at)", "[at]", " {at} ", " at "]), draw.choice([" [dot] ", "(dot)", " dot ", "."])
        return draw.choice(["anna.smith", "j_doe", "info", "lee"]) + at + draw.choice(["example", "mail7", "acme"]) + (
            " dot " if at == " at " else dot) + draw.choice(["com", "org", "de", "fr", "net"])

    sep = lambda *s: draw.choice(s)
    # (kind, label, whether a cue word of the kind stands before it, value)
    made = [
        ("email", 1, 1, address), ("email", 1, 0, address),
        ("email", 0, 0, lambda: f"{word()}@{word()}. {word()}"), ("email", 0, 1, lambda: f"{word()} at {some(2)} dot {some(2)}"),
        ("phone", 1, 1, lambda: f"({some(3)}) {some(3)}-{some(4)}"), ("phone", 1, 0, lambda: f"({some(3)}) {some(3)}-{some(4)}"),
        ("phone", 1, 1, lambda: sep("-", " ", ".").join([some(3), some(3), some(4)])),
        ("phone", 1, 1, lambda: f"0{some(3)}{sep(' ', '/', '-')}{some(7)}"),
        ("phone", 0, 0, lambda: f"{day()} {some(2)}"), ("phone", 0, 1, day), ("phone", 0, 0, lambda: some(9)),
        ("phone", 0, 0, lambda: f"{some(4)}-{some(4)}"), ("phone", 0, 0, lambda: some(draw.randrange(7, 16))),
        ("phone", 0, 0, lambda: f"{some(draw.randrange(1, 4))} {some(3)} {some(3)}"), ("phone", 0, 0, lambda: f"{some(7)}.{some(2)}"),
        ("phone", 0, 0, lambda: f"{some(3)}.{some(6)}"), ("phone", 0, 1, lambda: some(15)),
        ("phone", 0, 0, lambda: " ".join(some(draw.randrange(1, 4)) for _ in range(6))),
        ("card", 1, 1, lambda: card(True)), ("card", 1, 0, lambda: card(True)), ("card", 1, 0, lambda: four(card(True), sep(".", "  ", " - "))),
        ("card", 0, 0, lambda: card(False)), ("card", 0, 1, lambda: card(False)), ("card", 0, 0, lambda: four(card(False), sep(".", "  "))),
        ("card", 0, 0, lambda: f"{day()} {day()}"), ("card", 0, 0, lambda: f"4{some(12)}0"),
        ("card", 0, 0, lambda: " ".join(some(draw.randrange(1, 4)) for _ in range(9))),
        ("ip", 1, 1, lambda: ":".join(code(4) for _ in range(8))), ("ip", 1, 0, lambda: ":".join(code(4) for _ in range(8))),
        ("ip", 1, 0, lambda: sep("[.]", " [dot] ", "(dot)").join(small() for _ in range(4))),
        ("ip", 0, 0, lambda: ":".join(some(2) for _ in range(3))), ("ip", 0, 1, lambda: ":".join(some(2) for _ in range(3))),
        ("ip", 0, 0, lambda: "::" + some(1)),
        ("secret", 1, 1, lambda: code(40)), ("secret", 1, 1, lambda: mixed(38)), ("secret", 1, 1, lambda: code(32)),
        ("secret", 0, 0, lambda: code(40)), ("secret", 0, 0, lambda: "-".join([word(), word(), word(), "example"])),
        ("secret", 0, 1, lambda: "/".join([word(), word(), word(), some(4), "index"])),
        ("secret", 0, 0, lambda: sep("a", "-", "_", "ha", "=") * draw.randrange(16, 90)), ("secret", 0, 1, lambda: some(17)),
        ("secret", 0, 0, lambda: "".join(word() for _ in range(7))),
    ]
    rows = []
    for i in range(n):
        kind, label, cued, value = made[i % len(made)]
        if cued:
            cue = draw.choice(CUES[kind].split("|")) + sep(" ", ": ", ' = "' if kind == "secret" else " is ")
        else:
            cue = sep("order ", "invoice no ", "version ", "page ", "commit ", "total: ") if not label and draw.random() < 0.5 else word() + " "
        rows.append((i, kind, float(label), f"{word()} {cue}", value(), sep(" ", ".", ", ", "\n", '"')))
    return spark.createDataFrame(rows, "id bigint, kind string, label double, before string, v string, after string")


def described(rows: DataFrame) -> DataFrame:
    """(id, kind, label, f) of labelled rows."""
    cue = reduce(lambda acc, k: acc.when(F.col("kind") == k, announced(k, F.col("before"))), KINDS, F)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    rows = rows.withColumn("m", F.struct(number.alias("kind"), "v", "before", "after", digits_of(F.col("v")).alias("d"), cue.alias("cue")))
    return rows.select("id", "kind", "label", features(F.col("m")).alias("f"))


def _tree(node, f: str) -> str:
    """A fitted tree as an SQL expression over the feature array ``f``."""
    if node.subtreeDepth() == 0:
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return (f"CASE WHEN {f}[{split.featureIndex()}] <= {float(split.threshold())!r}D THEN {_tree(node.leftChild(), f)} "
            f"ELSE {_tree(node.rightChild(), f)} END")


_FITTED: dict[tuple, tuple] = {}


def _fit(spark: SparkSession, n: int, rounds: int, depth: int, precision: float):
    """(score, thresholds): the SQL of a proposal's score, given the name of its feature array, and a threshold for each kind."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    known = (spark.sparkContext.applicationId, n, rounds, depth, precision)
    if known in _FITTED:
        return _FITTED[known]
    rows = staged(described(labelled(spark, n)), "pii-labelled")
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(4)) == 0
    # LABELLED rows at most: one partition keeps the sums of the fit, and so the trees, the same in every run
    fit = rows.where(~held).select("label", array_to_vector("f").alias("features")).coalesce(1)
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, checkpointInterval=-1, minInstancesPerNode=8).fit(fit)
    trees = [(float(w), t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees)]

    def score(f: str) -> str:
        return f"1 / (1 + exp(-2 * ({' + '.join(f'{w!r}D * {_tree(root, f)}' for w, root in trees)})))"

    tested = rows.where(held).select("kind", "label", F.expr(score("f")).alias("p")).collect()    # a fourth of LABELLED rows
    thresholds = {}
    for kind in KINDS:
        # from the highest score down, ties together; no threshold reaches the precision: none of the kind is selected
        ordered = sorted(((r.p, r.label) for r in tested if r.kind == kind), reverse=True)
        right, best = 0.0, 2.0
        for k, (p, label) in enumerate(ordered):
            right += label
            if (k + 1 == len(ordered) or ordered[k + 1][0] < p) and right >= precision * (k + 1):
                best = p
        thresholds[kind] = max(best, FLOOR)
    _FITTED[known] = (score, thresholds)
    return _FITTED[known]


# ------------------------------------------------------------------ interface

def find(docs: DataFrame, n: int = LABELLED, rounds: int = ROUNDS, depth: int = DEPTH, precision: float = PRECISION) -> DataFrame:
    """``docs`` with ``spans``: an array of (s, kind, e, base, score): start, number in ``KINDS``, end, whether of the base."""
    score, thresholds = _fit(docs.sparkSession, n, rounds, depth, precision)
    names = [c for c in docs.columns if c.lower() != "spans"]
    own = [f"c{i}" for i in range(len(names))]                # any names of the input's columns are out of the way
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)], F.coalesce(F.col("text"), F.lit("")).alias("t"))

    def checked(kind: str, column: Column) -> Column:
        return F.filter(column, lambda m: holds(kind, m["v"]))

    def base_of(kind: str) -> Column:
        return F.transform(f"b_{kind}", lambda m: F.struct(m["s"].alias("s"), F.lit(KINDS.index(kind)).alias("kind"),
                                                           m["e"].alias("e"), F.lit(True).alias("base"), F.lit(1.0).alias("score")))

    def proposals(column: str, kind: str) -> Column:
        return F.transform(column, lambda m: F.struct(
            m["s"].alias("s"), F.lit(KINDS.index(kind)).alias("kind"), m["e"].alias("e"), m["v"].alias("v"), m["before"].alias("before"),
            m["after"].alias("after"), digits_of(m["v"]).alias("d"), announced(kind, m["before"]).alias("cue")))

    base = [f"b_{k}" for k in BASE]
    rows = matches(rows, [*own, "t"], {f"b_{k}": (NEEDS[k], p) for k, p in BASE.items()})
    rows = rows.select(*own, "t", *[checked(k, F.col(f"b_{k}")).alias(f"b_{k}") for k in BASE])
    some = reduce(lambda a, b: a | b, [F.size(b) > 0 for b in base])
    for k in BASE:
        rows = rows.withColumn("t", F.when(some, _masked(F.col("t"), k)).otherwise(F.col("t")))
    rows = matches(rows, [*own, *base], {f"g_{i}": (needs, p) for i, (_, needs, p) in enumerate(GENERATORS)})
    rows = rows.select(*own, F.concat(*[base_of(k) for k in BASE]).alias("base"),
                       F.concat(*[proposals(f"g_{i}", k) for i, (k, _, _) in enumerate(GENERATORS)]).alias("proposals"))
    rows = rows.withColumn("proposals", F.transform("proposals", lambda m: F.struct(m["s"].alias("s"), m["kind"].alias("kind"),
                                                                                    m["e"].alias("e"), features(m).alias("f"))))
    rows = rows.withColumn("proposals", F.expr("transform(proposals, m -> named_struct('s', m.s, 'kind', m.kind, 'e', m.e, "
                                               f"'base', false, 'score', {score('m.f')}))"))
    least = F.array(*[F.lit(thresholds[k]) for k in KINDS])
    # two generators of one kind may propose the same span
    added = F.array_distinct(F.filter("proposals", lambda m: m["score"] >= F.element_at(least, m["kind"] + 1)))
    return rows.select(*[F.col(o).alias(c) for o, c in zip(own, names)], F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["s"].cast("string"), s["e"].cast("string"))), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans give one replacement, named
    after the first. A NULL text stays NULL."""
    found = find(docs, **options)
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        fresh = s["s"] >= acc["e"]
        return F.struct(F.when(fresh, F.concat(acc["out"], F.substring("text", acc["e"] + 1, s["s"] - acc["e"]),
                                               F.element_at(names, s["kind"] + 1))).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["e"], s["e"]).alias("e"))

    cut = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("e")), step,
                      lambda acc: F.concat(acc["out"], F.substring("text", acc["e"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("spans") > 0, cut).otherwise(F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.size(F.filter(base, lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))
