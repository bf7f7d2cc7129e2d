"""Secrets by pattern and by a battery of randomness tests, in DataFrame functions only.

Patterns (assign, access, hex) give the base spans.  Offsets come from the pieces between matches: splitting a text
by a pattern and extracting the pattern see the same matches.  Further candidates are all runs of symbols of common
encodings that carry ``LEAST_BITS`` or more if random: length times the logarithm of the alphabet, which is inferred from the
symbols (hex, base32, base36, base62, base64).  The battery asks whether a run looks random in its alphabet:

* chi-squared uniformity over the symbols, over their classes (digits, capitals, small letters) and over vowels and other letters;
* runs: the number of changes between classes;
* serial correlation at lag one.

Classes, vowels and class changes are all but independent in a random run and are combined by Fisher's method, as made-up
names deviate a little in each; the other two are combined with that as independent tests.

What is reported as kind ``random`` is controlled for false secrets.  In each cell of encoding and length (powers of two) the
distinct runs of the whole corpus with p-values above a half tell how many are random, as a share ``HIGH`` of those has
such p-values, and from that the share of others among all above a cut.  The cut is the smallest for which that share is
at most ``ALPHA``; it never exceeds ``MOST_LOST``, the share of random runs that may be given up.  P-values enter in
steps of a twentieth of a decimal order, which bounds the table to the number of cells and steps.  A random run that touches a base
span is not reported.

Null text counts as empty.  Null ids stay, repeated rows give repeated rows, other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # a run from AKIA on is maximal, so a least length drops what a filter would drop
HEX = "[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{14,}+"  # shorter runs carry less than LEAST_BITS in every encoding

# Symbols of the encodings, in order of their value.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_NAMED = ALPHABETS["base64"]
_CLASS_OF = "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "+" for c in _NAMED)
ALPHA = 0.05
MOST_LOST = 0.05
HIGH = 0.67  # the largest share measured over encodings and lengths of 3,000 random runs each; the smallest is 0.56
LEAST_BITS = 80.0
STEPS = 20  # of p-values in a decimal order
LAST_STEP = 400
BLOCK = 256
FAR = (1 << 31) - 1


def running(values: Column, combine, start: int) -> Column:
    """For each element of an array<int> the combination of all elements before it (``start`` for the first).

    ``combine`` is associative.  The array is taken in blocks, as an array that grows by one is copied at every step.
    """
    last = lambda a: F.element_at(a, -1)
    seed = F.array(F.lit(start))

    def scanned(block: Column) -> Column:
        return F.aggregate(block, seed, lambda done, v: F.concat(done, F.array(combine(last(done), v))))

    def whole(bound: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(bound), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda i: scanned(F.slice(bound, i, F.lit(BLOCK))))
        return F.transform(F.array(blocks), _joined)[0]

    def _joined(blocks: Column) -> Column:
        befores = scanned(F.transform(blocks, last))
        each = F.zip_with(blocks, F.slice(befores, F.lit(1), F.size(blocks)), lambda block, before: F.transform(F.slice(block, F.lit(1), F.size(block) - 1), lambda v: combine(before, v)))
        return F.flatten(each)

    return F.transform(F.array(values), lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))[0]


def matches(text: Column, pattern: str, number: int, keep=None) -> Column:
    """array<struct<start, number, end>> of a pattern's matches, leftmost and not overlapping; ``keep`` is an
    array<boolean> in the order of the matches."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    keep = F.transform(sizes, lambda _: F.lit(True)) if keep is None else keep
    steps = F.arrays_zip(sizes.alias("size"), F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), keep.alias("keep"))
    empty = F.array().cast("array<struct<start:int,number:int,end:int>>")

    def placed(x: Column) -> Column:
        ends = running(F.transform(x, lambda s: s["size"] + s["gap"]), lambda a, b: a + b, 0)
        at = F.zip_with(x, ends, lambda s, before: F.struct((before + s["gap"]).alias("start"), s["size"].alias("size"), s["keep"].alias("keep")))
        return F.transform(F.filter(at, lambda s: s["keep"]), lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("number"), (s["start"] + s["size"]).alias("end")))

    return F.when(text.rlike(pattern), F.transform(F.array(steps), placed)[0]).otherwise(empty)


def apart(base: Column, random: Column) -> Column:
    """The spans of ``random`` that overlap none of ``base``."""
    is_base = lambda s: s["number"] < 3

    def checked(spans: Column) -> Column:
        # Behind the farthest end of the base spans that start before, and before the nearest start of those that follow.
        before = running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.greatest, 0)
        after = running(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(FAR))), F.least, FAR)
        bounds = F.zip_with(before, F.reverse(after), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        both = F.zip_with(spans, bounds, lambda s, x: F.struct(s.alias("s"), x.alias("x")))
        free = F.filter(both, lambda y: ~is_base(y["s"]) & (y["x"]["a"] <= y["s"]["start"]) & (y["s"]["end"] <= y["x"]["b"]))
        return F.transform(free, lambda y: y["s"])

    sure = (F.size(base) == 0) | (F.size(random) == 0)
    return F.when(sure, random).otherwise(F.transform(F.array(F.array_sort(F.concat(base, random))), checked)[0])


def base_spans(text: Column) -> Column:
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda value: F.length(value) >= ASSIGN_LEAST)
    return F.concat(matches(text, ASSIGN, 0, long_enough), matches(text, ACCESS, 1), matches(text, HEX, 2))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / (2 * F.pi()) ** 0.5 * series


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def _encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^[a-z0-9]+$"), "lower36").when(token.rlike("^[A-Z0-9]+$"), "upper36")
        .when(token.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
    )


#: Patterns of the symbol classes, and the number of their symbols in an encoding.
_CLASSES = ("[0-9]", "[A-Z]", "[a-z]", "[+/]")
_VOWELS = "[AEIOUaeiou]"
_LETTERS = "[A-Za-z]"


def _share(pattern: str) -> dict[str, float]:
    return {name: len(re.findall(pattern, letters)) / len(letters) for name, letters in ALPHABETS.items()}


def _of(shares: dict[str, float], encoding: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in shares.items() for x in item]), encoding)


def _changing() -> dict[str, tuple[float, float]]:
    """For each encoding: the chance that neighbours differ in class, and that both neighbours of a symbol do."""
    out = {}
    for name, letters in ALPHABETS.items():
        shares = [len(re.findall(c, letters)) / len(letters) for c in _CLASSES]
        out[name] = (1 - sum(s * s for s in shares), sum(s * (1 - s) ** 2 for s in shares))
    return out


def _chi_tail(chi: Column, free: Column) -> Column:
    """The chi-squared distribution's upper tail by Wilson and Hilferty's cube root."""
    cubic = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    return F.when(cubic > 0, upper_tail(cubic)).otherwise(1 - upper_tail(-cubic))


def _deviation(seen: Column, n: Column, share: Column) -> Column:
    """Two-sided p-value of a binomial count, with continuity correction; 1 where nothing can vary."""
    spread = n * share * (1 - share)
    return F.when(spread > 0, _two_sided(F.greatest(F.lit(0.0), F.abs(seen - n * share) - 0.5) / F.sqrt(spread))).otherwise(F.lit(1.0))


def battery(tokens: Column) -> Column:
    """array<struct<token, encoding, n, bits, p>> of an array of candidate runs.

    Each step binds its values once; p combines the tests.
    """
    alphabet = F.create_map(*[F.lit(x) for item in ALPHABETS.items() for x in item])
    changing = _changing()

    def symbols(x: Column) -> Column:
        letters = F.element_at(alphabet, x["encoding"])
        written = F.when(x["encoding"] == "hex", F.lower(x["token"])).when(x["encoding"] == "base64", F.translate(x["token"], "-_", "+/")).otherwise(x["token"])
        values = F.transform(F.split(written, ""), lambda c: F.position(c, letters) - 1)
        classes = F.translate(written, _NAMED, _CLASS_OF)
        return F.struct(
            x["token"].alias("token"), x["encoding"].alias("encoding"), F.length(letters).cast("double").alias("k"), F.length(x["token"]).cast("double").alias("n"),
            values.alias("v"), written.alias("written"), F.split(classes, "").alias("classes"),
        )

    def sums(x: Column) -> Column:
        # In sorted order the r-th equal symbol adds 2r - 1: together the square of the symbol's count.
        start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("squares"))

        def count(s: Column, v: Column) -> Column:
            run = F.when(s["last"] == v, s["run"] + 1).otherwise(F.lit(1))
            return F.struct(v.alias("last"), run.alias("run"), (s["squares"] + 2 * run - 1).alias("squares"))

        squares = F.aggregate(F.array_sort(x["v"]), start, count, lambda s: s["squares"])
        mean = F.aggregate(x["v"], F.lit(0), lambda s, v: s + v) / x["n"]
        rest = F.size(x["v"]) - 1
        pairs = F.zip_with(F.slice(x["v"], F.lit(1), rest), F.slice(x["v"], F.lit(2), rest), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.zip_with(F.slice(x["classes"], F.lit(1), rest), F.slice(x["classes"], F.lit(2), rest), lambda a, b: (a != b).cast("int"))
        changes = F.aggregate(turns, F.lit(0), lambda s, t: s + t).cast("double")
        # Shares of the classes that the encoding has, and the symbols seen of each.
        seen = F.array(*[F.struct((_of(_share(c), x["encoding"]) * x["n"]).alias("e"), F.regexp_count(x["written"], F.lit(c)).cast("double").alias("o")) for c in _CLASSES])
        counts = [F.regexp_count(x["written"], F.lit(c)).cast("double").alias(name) for c, name in ((_LETTERS, "letters"), (_VOWELS, "vowels"))]
        return F.struct(*[x[c].alias(c) for c in ("token", "encoding", "k", "n", "v")], squares.alias("squares"), mean.alias("mean"), pairs.alias("pairs"), changes.alias("changes"), F.filter(seen, lambda s: s["e"] > 0).alias("seen"), *counts)

    def moments(x: Column) -> Column:
        spread = F.aggregate(x["v"], F.lit(0.0), lambda s, v: s + (v - x["mean"]) * (v - x["mean"]))
        joint = F.aggregate(x["pairs"], F.lit(0.0), lambda s, p: s + (p["a"] - x["mean"]) * (p["b"] - x["mean"]))
        classes = _chi_tail(F.aggregate(x["seen"], F.lit(0.0), lambda s, c: s + (c["o"] - c["e"]) * (c["o"] - c["e"]) / c["e"]), (F.size(x["seen"]) - 1).cast("double"))
        among = {name: v / l for (name, v), l in zip(_share(_VOWELS).items(), _share(_LETTERS).values())}
        vowels = _deviation(x["vowels"], x["letters"], _of(among, x["encoding"]))
        # Changes of neighbouring pairs depend on each other by the symbol they share.
        one, two = (_of({name: c[i] for name, c in changing.items()}, x["encoding"]) for i in (0, 1))
        wide = F.sqrt((x["n"] - 1) * one * (1 - one) + 2 * (x["n"] - 2) * (two - one * one))
        runs = _two_sided(F.greatest(F.lit(0.0), F.abs(x["changes"] - (x["n"] - 1) * one) - 0.5) / wide)
        return F.struct(*[x[c].alias(c) for c in ("token", "encoding", "k", "n", "squares")], spread.alias("spread"), joint.alias("joint"), classes.alias("classes"), vowels.alias("vowels"), runs.alias("runs"))

    def tested(x: Column) -> Column:
        uniform = _chi_tail(x["k"] / x["n"] * x["squares"] - x["n"], x["k"] - 1)
        serial = F.when(x["spread"] > 0, _two_sided((x["joint"] / x["spread"] + 1 / x["n"]) * F.sqrt(x["n"]))).otherwise(F.lit(0.0))
        product = [F.greatest(x[c], F.lit(1e-300)) for c in ("classes", "vowels", "runs")]
        half = -sum((F.log(p) for p in product[1:]), F.log(product[0]))
        fisher = F.exp(-half) * (1 + half + half * half / 2)  # the upper tail of chi-squared with six degrees of freedom, exactly
        b = F.least(F.lit(2.0), 2 * fisher, 4 * uniform, 4 * serial)
        p = 1 - (1 - b / 2) * (1 - b / 4) * (1 - b / 4)  # as for three independent tests, of which the first weighs half
        return F.struct(x["token"].alias("token"), x["encoding"].alias("encoding"), x["n"].cast("int").alias("n"), (x["n"] * F.log2(x["k"])).alias("bits"), p.alias("p"))

    named = F.transform(tokens, lambda t: F.struct(t.alias("token"), _encoding(t).alias("encoding")))
    return F.transform(F.transform(F.transform(F.transform(named, symbols), sums), moments), tested)


def _cell(x: Column) -> Column:
    return F.concat(x["encoding"], F.lit(":"), F.floor(F.log2(x["n"])).cast("string"))


def _step(x: Column) -> Column:
    return F.least(F.lit(LAST_STEP), F.floor(-F.log10(F.greatest(x["p"], F.lit(1e-300))) * STEPS)).cast("int")


def _candidates(text: Column) -> Column:
    return F.when(text.rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _heavy(token: Column) -> Column:
    """Whether a run carries LEAST_BITS in its alphabet."""
    least = {name: float(math.ceil(LEAST_BITS / math.log2(len(letters)))) for name, letters in ALPHABETS.items()}
    return F.length(token) >= _of(least, _encoding(token))


def random_from(texts: DataFrame, alpha: float = ALPHA) -> dict[str, int]:
    """For each cell the step of p-values up to which runs are reported.

    A step's p-values are above 10 ** (-(step + 1) / STEPS): reporting it gives up that share of the random runs.
    """
    tokens = texts.select(F.explode(F.array_distinct(F.filter(_candidates(F.col("text")), _heavy))).alias("token")).distinct()
    tested = tokens.select(battery(F.array("token"))[0].alias("x"))
    steps = tested.groupBy(_cell(F.col("x")).alias("cell"), _step(F.col("x")).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("x.p") > 0.5, 1)).alias("high"))
    cell = Window.partitionBy("cell")
    ranked = steps.withColumn("above", F.sum("n").over(cell.orderBy("step"))).withColumn("random", (F.sum("high").over(cell) + 1) / HIGH)
    lost = F.pow(F.lit(10.0), -(F.col("step") + 1) / STEPS)
    fits = (F.col("above") - F.col("random") * (1 - lost) <= alpha * F.col("above")) & (lost <= MOST_LOST)
    found = ranked.groupBy("cell").agg(F.max(F.when(fits, F.col("step"))).alias("step"))
    return {r["cell"]: r["step"] for r in found.filter("step IS NOT NULL").collect()}


def _random(text: Column, reported: dict[str, int]) -> Column:
    """Spans of the candidates that pass the battery."""
    most = math.ceil(-math.log10(MOST_LOST) * STEPS) - 1
    limits = F.create_map(*[F.lit(x) for item in (reported or {"": 0}).items() for x in item])
    checked = F.transform(_candidates(text), lambda t: F.when(_heavy(t), battery(F.array(t))[0]))
    passed = F.transform(checked, lambda x: F.coalesce(_step(x) <= F.greatest(F.lit(most), F.try_element_at(limits, _cell(x))), F.lit(False)))
    return matches(text, CANDIDATE, 3, passed)


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(number: int):
    return lambda s: s["number"] == number


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, alpha: float = ALPHA) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and the number of random ones."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    reported = random_from(texts, alpha)
    found = texts.select("doc_id", F.array_sort(base_spans(F.col("text"))).alias("base"), _random(F.col("text"), reported).alias("random"))
    found = found.withColumn("added", apart(F.col("base"), F.col("random"))).withColumn("every", F.array_sort(F.concat("base", "added")))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("every")).alias("spans"), F.size("added").cast("long").alias("n_random"))
