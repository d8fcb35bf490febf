"""Personal data: wide generators propose spans, boosted trees select, in DataFrame operations only.

The base rules always hold. Where they match nothing, wider patterns propose spans. A boosted forest over their format and context decides: it is fitted on the driver in plain Python to counts of feature combinations, 3,072 at most for each label, and becomes one SQL expression. It learns from two sources of like weight, whatever their size: base matches of the corpus, right if the rule's check passed, and examples written by rule, formats that the base rules leave out and what resembles them but isn't personal. No feature repeats a rule's check. Half of the examples of either source fit the trees; the other half calibrates them: scores become chances by isotonic regression, and a kind's threshold is the least score whose chance reaches ``PRECISION``; a kind without wrong examples there gets none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridge.runtime import written

KINDS = ("email", "ip", "card", "phone")
#: Base rules. A match begins where a run of its first class begins, or where the match before it ended; that and possessive repeats keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",  # shorter runs fail the check anyway
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?@\x20?|\x20?[(\[{](?:at|AT)[)\]}]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[{](?:dot|DOT)[)\]}]\x20?)[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:\x20?\.\x20?[0-9]{1,4}){3}|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9])\+?\(?[0-9]{2,4}\)?(?:[\x20.-]{1,2}\(?[0-9]{2,4}\)?){2,5}+(?![0-9])",
}
#: What a text must contain, at little cost, to be searched at all.
_FIRST = {"email": r"@|[(\[{](?:at|AT)[)\]}]", "ip": r"[0-9]\x20?\.\x20?[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9](?:[\x20._/-]{0,2}[0-9]){12}", "phone": r"\+[0-9]|[0-9]\)?[\x20.-]{1,2}\(?[0-9]{2,4}\)?[\x20.-]{1,2}\(?[0-9]"}
_CUE = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|card|visa|credit|host|server|addr|ip)\W{0,4}$"
FEATURES = ("kind", "digits", "marks", "cue", "glued", "shape", "listed")
TREES, DEPTH, RATE, LEAF_L2, PRECISION = 24, 3, 0.3, 1.0, 0.95
#: Weight of all corpus examples, or all written ones, of a kind.
WEIGHT = 1000.0
#: Code points of context on either side, elements of a block in prefix sums, code points of a chunk of text.
CONTEXT, BLOCK, CHUNK = 24, 64, 1024
_ZIPPED = "array<struct<p:string,h:string>>"
_BLANK = "\ue000"


# -- arrays in time near linear ---------------------------------------------------------------------------------------------------


def _prefixes(items: Column, value: Callable[[Column], Column], op: Callable[[Column, Column], Column]) -> Column:
    """For each of ``items``, a column, ``op`` over the values of all before it, from zero on. An array that grows is copied at each step, so blocks grow apart."""
    n = (F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))
    grown = lambda a, v: F.concat(a, F.array(op(F.element_at(a, -1), v)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: op(a, value(x))))
    starts = F.slice(F.aggregate(totals, F.array(F.lit(0)), grown), F.lit(1), n + 1)
    inner = lambda y: F.slice(F.aggregate(y["b"], F.array(y["o"]), lambda a, x: grown(a, value(x))), F.lit(1), F.size(y["b"]))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("o")), inner))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))


def _piece(chunks: Column, a: Column, b: Column) -> Column:
    """The code points from a up to b of a text in chunks; a place far inside is found without counting from the start."""
    at = lambda x: (x / CHUNK).cast("int")
    get = lambda i, first, n: F.call_function("substring", F.coalesce(F.get(chunks, i), F.lit("")), first, n)
    inside = get(at(a), a % CHUNK + 1, b - a)
    across = F.concat(get(at(a), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, at(a) + 2, F.greatest(at(b) - at(a) - 1, F.lit(0))), ""), get(at(b), F.lit(1), b % CHUNK))
    return F.when(b <= a, "").when(at(a) == at(b), inside).otherwise(across)


def _replaced(chunks: Column, spans: Column, ends: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with ``fill(span, end so far)`` for each of ``spans``, which are sorted by start; ``ends`` are the prefix maxima of their ends."""

    def part(y: Column) -> Column:
        x, before = y["x"], y["o"]
        return F.concat(_piece(chunks, before, F.greatest(x["s"], before)), fill(x, before))

    last = F.array_max(F.transform(spans, lambda x: x["e"]))
    return F.concat(F.array_join(F.transform(F.arrays_zip(spans.alias("x"), ends.alias("o")), part), ""), _piece(chunks, last, F.size(chunks) * CHUNK))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: a generator keeps the optimizer from copying them into every later use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


# -- matches and their features ---------------------------------------------------------------------------------------------------


def _zipped(text: Column, kind: str, pattern: str) -> Column:
    """What stands before each match, and the match; last what follows them all."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))
    return F.when(F.rlike(text, F.lit(_FIRST[kind])), pairs).otherwise(F.array().cast(_ZIPPED))


def _hits(zipped: Column) -> Column:
    """All matches in order: start and end in code points, text, and what stands around them."""
    size = lambda x: F.char_length(x["p"]) + F.coalesce(F.char_length(x["h"]), F.lit(0))
    starts = _prefixes(zipped, size, lambda a, b: a + b)

    def hit(y: Column, i: Column) -> Column:
        s = y["o"] + F.char_length(y["z"]["p"])
        return F.struct(s.alias("s"), (s + F.char_length(y["z"]["h"])).alias("e"), y["z"]["h"].alias("t"), F.right(y["z"]["p"], F.lit(CONTEXT)).alias("before"), F.left(F.get(zipped, i + 1)["p"], F.lit(CONTEXT)).alias("after"))

    pairs = F.slice(F.arrays_zip(zipped.alias("z"), starts.alias("o")), F.lit(1), F.greatest(F.size(zipped) - 1, F.lit(0)))
    return F.transform(pairs, hit)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digits, at most a few dozen, whose Luhn sum ends in zero."""
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.call_function("substring", digits, i, F.lit(1)).cast("int")
        return a + F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    """A base rule's check."""
    n = F.length(_digits(t))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda x: F.length(F.ltrim(x, F.lit("0"))) <= 3) & F.forall(F.split(t, r"\."), lambda x: F.coalesce(F.try_to_number(F.right(x, F.lit(3)), F.lit("999")), F.lit(0)) <= 255)
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(t))).otherwise(False)
    return n.between(8, 15)


def _proposed(kind: str, t: Column) -> Column:
    """What a generator asks of a proposal beyond its pattern."""
    if kind == "card":
        return F.when(F.length(_digits(t)).between(13, 19), _luhn(_digits(t))).otherwise(False)
    if kind == "ip":
        return F.contains(t, F.lit(":")) | _valid("ip", F.regexp_replace(t, r"\x20", ""))
    if kind == "phone":
        return F.length(_digits(t)).between(8, 15)
    return F.lit(True)


def _features(kind: str, x: Column) -> list[Column]:
    """Format: how many digits and marks, whether in the kind's common shape. Context: a word that announces the kind, letters or digits that touch it, a row of numbers around it or in it."""
    t, n = x["t"], F.length(_digits(x["t"]))
    like = lambda c, p: F.rlike(c, F.lit(p)).cast("int")
    shape, listed = {
        "email": (1 - like(t, r"[\x20()\[\]{}]") + like(t, r"[A-Za-z]{2,}$"), like(t, r"@\x20?[0-9]")),
        "ip": (1 - like(t, r"[\x20]") + like(t, r"^(?:[0-9]{2,3}\W|[0-9A-Fa-f]{3,4}:)"), F.greatest(like(x["before"], r"(?i)(?:[0-9][\x20.,]+|\bv(?:er(?:sion)?)?\.?|section|chapter|§)\W?$"), like(x["after"], r"^\x20?\.\x20?[0-9]"))),
        "card": (like(t, r"^[0-9]{4}(\D{1,2}[0-9]{4,6})+") + like(t, r"^(?:3[47]|[4-6])"), F.greatest(like(x["before"], r"[0-9][\x20.,;:/_-]{1,3}$"), like(x["after"], r"^[\x20.,;:/_-]{1,3}[0-9]"))),
        "phone": (2 * like(t, r"^\+") + like(t, r"^\(?0?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$"), F.greatest(like(x["before"], r"[0-9][\x20.,;:/-]{1,3}$"), like(x["after"], r"^[\x20.,;:/-]{1,3}[0-9]"), like(t, r"^(?:(?:1[89]|20)[0-9]{2}\D+)+(?:1[89]|20)?[0-9]{2}\b"))),
    }[kind]
    step = lambda v, *limits: sum((F.when(v > k, 1).otherwise(0) for k in limits), F.lit(0))
    marks = F.length(F.regexp_replace(t, "[A-Za-z0-9]", ""))
    glued = like(x["before"], "[A-Za-z0-9]$").bitwiseOR(like(x["after"], "^[A-Za-z0-9]"))
    values = (F.lit(KINDS.index(kind)), step(n, 6, 9, 12, 15, 19), step(marks, 0, 2, 5), like(x["before"], _CUE), glued, shape, listed)
    return [F.coalesce(v.cast("int"), F.lit(0)).alias(f) for f, v in zip(FEATURES, values, strict=True)]


def find_candidates(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` columns and ``base`` (kind, s, e of matches that pass), ``seen`` (features, half and ``ok`` of all base matches; copies of a match are in one half), ``wide`` (s, e and features of proposals, all apart from base matches)."""
    hidden = [f"__{x}{i}" for x in "zhyx" for i in range(len(KINDS))]
    df = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    df = _once(df, **{f"__z{i}": _zipped(F.col("__text"), k, BASE[k]) for i, k in enumerate(KINDS)})
    df = _once(df, **{f"__h{i}": _hits(F.col(f"__z{i}")) for i in range(len(KINDS))})
    judged = lambda i: lambda x: F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _valid(KINDS[i], x["t"]).alias("ok"), F.struct(*_features(KINDS[i], x), F.pmod(F.crc32(x["t"].cast("binary")), F.lit(2)).cast("int").alias("half")).alias("f"))
    df = _once(df, __all=F.concat(*(F.transform(f"__h{i}", judged(i)) for i in range(len(KINDS)))))
    df = _once(df, __taken=F.array_sort(F.transform("__all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))), __chunks=F.when(F.size("__all") > 0, _chunks(F.col("__text"))))
    df = _once(df, __ends=_prefixes(F.col("__taken"), lambda x: x["e"], F.greatest))
    blank = _replaced(F.col("__chunks"), F.col("__taken"), F.col("__ends"), lambda x, before: F.repeat(F.lit(_BLANK), F.greatest(x["e"] - F.greatest(x["s"], before), F.lit(0))))
    df = _once(df, __rest=F.when(F.size("__all") > 0, blank).otherwise(F.col("__text")))
    df = _once(df, **{f"__y{i}": _zipped(F.col("__rest"), k, WIDE[k]) for i, k in enumerate(KINDS)})
    df = _once(df, **{f"__x{i}": _hits(F.col(f"__y{i}")) for i in range(len(KINDS))})
    described = lambda i: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), *_features(KINDS[i], x))
    gate = lambda i: lambda x: _proposed(KINDS[i], x["t"])
    wide = F.concat(*(F.transform(F.filter(f"__x{i}", gate(i)), described(i)) for i in range(len(KINDS))))
    passed = F.transform(F.filter("__all", lambda x: x["ok"]), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    seen = F.transform("__all", lambda x: F.struct(*(x["f"][f].alias(f) for f in (*FEATURES, "half")), x["ok"].alias("ok")))
    return _once(df, base=passed, seen=seen, wide=wide).drop("__text", "__all", "__taken", "__chunks", "__ends", "__rest", *hidden)


# -- examples written by rule ------------------------------------------------------------------------------------------------------

#: Formats with d for a digit, c for a digit so that all digits together pass the card check, y for a year, o for a number up to 255, w for a word, h for four hexadecimal digits, each in braces. Right ones are personal data that base rules leave out, wrong ones resemble them.
RIGHT = {
    "email": ("mail {w}[at]{w}[dot]com", "contact {w}.{w} (at) {w} (dot) org now", "e-mail: {w} @ {w}.net", "{w}{d}{d} [at] {w} [dot] de", "write to {w}_{w}(at){w}.com", "reach {w} @ {w}.co.uk"),
    "ip": ("host {o} . {o} . {o} . {o} is down", "addr: {h}:{h}:{h}:{h}:{h}:{h}:{h}:{h}", "server {o} .{o} .{o} .{o}", "from {h}:{h}:{h}:{h}:{h}:{h}:{h}:{h} to us", "ip 1{d}{d} . {o} . {o} . {o}"),
    "card": ("card 3{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{c}", "visa 4{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{c}", "credit 5{d}{d}{d}/{d}{d}{d}{d}/{d}{d}{d}{d}/{d}{d}{d}{c}", "card: 4{d}{d}{d}_{d}{d}{d}{d}_{d}{d}{d}{d}_{d}{d}{d}{c}", "visa 3{d}{d}{d} {d}{d}{d}{d}{d}{d} {d}{d}{d}{d}{c}", "paid by 4{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{d}.{d}{d}{d}{c}"),
    "phone": ("call {d}{d}{d}-{d}{d}{d}-{d}{d}{d}{d}", "tel ({d}{d}{d}) {d}{d}{d} {d}{d}{d}{d}", "phone: {d}{d}{d}.{d}{d}{d}.{d}{d}{d}{d} or", "fax 0{d}{d}{d} {d}{d}{d} {d}{d}{d}", "mobile ({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}", "tel 0{d}{d} {d}{d}{d}{d} {d}{d}{d}{d}"),
}
WRONG = {
    "email": ("{d} @ {d}.{d}{d} each", "sold {d}{d} @ {d}.{d} today", "grade {w} @ {d}.{d}", "see {w}[at]{d}.{d}", "{w} {d} @ {d}{d}.{d}{d}"),
    "ip": ("{d}. {d}. {d}. {d}", "section {d} . {d} . {d} . {d}", "version {d} . {d} . {d}{d} . {d}", "{d}{d}:{d}{d}:{d}{d}:{d}{d}:{d}{d}:{d}{d}:{d}{d}:{d}{d}", "steps {d} . {d} . {d} . {d} . {d}", "of {d}. {d}. {d}. {d}. {d}"),
    "card": ("order {d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{c}", "isbn 978-{d}-{d}{d}-{d}{d}{d}{d}{d}{d}-{c}", "{y}.{d}{d}.{d}{d}.{d}{d}.{d}{d}.{d}{c}", "numbers {d}{d}{d} {d}{d}{d} {d}{d}{d} {d}{d}{d} {d}{d}{c}", "{y} {y} {y} {d}{d}{d}{c}", "at 1{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{c}", "row {d}{d}  {d}{d}  {d}{d}  {d}{d}  {d}{d}  {d}{d}  {d}{c}"),
    "phone": ("the scores were {d}00 {d}00 {d}00 {d}00", "{y} {y} {y}", "from {y}-{y}-{y} on", "pages {d}{d} {d}{d} {d}{d} {d}{d} {d}{d}", "{d}{d}{d} {d}{d}{d} {d}{d}{d}", "on {y}-{d}{d}-{d}{d} {d}{d}", "{d}{d}.{d}{d}.{y}", "sizes {d}{d}{d} {d}{d}{d} {d}{d}{d} {d}{d}{d}", "{d}{d}{d}-{d}{d}{d}-{d}{d}{d}{d}-{d}{d}{d}", "{y}/{d}{d} {d}{d}{d}{d} {d}{d}{d}{d}", "{d}{d} {d}{d} {d}{d} {d}{d}"),
}
#: Examples of each format.
EACH = 24


def examples() -> list[tuple[int, bool, int, str]]:
    """(kind, right, number, text): ``EACH`` of every format, the same in every run."""
    state = 20_240_229

    def draw(n: int) -> int:
        nonlocal state
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        return (state >> 33) % n

    def word() -> str:
        return "".join("bcdfghklmnprstvw"[draw(16)] + "aeiou"[draw(5)] for _ in range(2 + draw(3)))

    def filled(form: str) -> str:
        out, digits = [], ""
        for i, part in enumerate(form.replace("}", "{").split("{")):
            if i % 2:
                part = {"d": lambda: str(draw(10)), "y": lambda: str(1950 + draw(80)), "o": lambda: str(draw(256)), "w": word, "h": lambda: f"{draw(1 << 16):04x}", "c": lambda: _check_digit(digits)}[part]()
            out.append(part)
            digits += "".join(x for x in part if x.isdigit())
        return "".join(out)

    return [(KINDS.index(kind), right, n, filled(form)) for right, forms in ((True, RIGHT), (False, WRONG)) for kind in KINDS for form in forms[kind] for n in range(EACH)]


def _check_digit(digits: str) -> str:
    """The digit that makes the card sum end in zero."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


# -- boosted trees over counted feature combinations, in plain Python ------------------------------------------------------------


def _split(rows: list, depth: int):
    """A regression tree on gradients: rows are (features, gradient, curvature)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth:
        for f in range(len(FEATURES)):
            for k in sorted({r[0][f] for r in rows})[:-1]:
                lg, lh = sum(r[1] for r in rows if r[0][f] <= k), sum(r[2] for r in rows if r[0][f] <= k)
                gain = lg * lg / (lh + LEAF_L2) + (g - lg) ** 2 / (h - lh + LEAF_L2) - g * g / (h + LEAF_L2)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, k
    if best is None:
        return round(RATE * g / (h + LEAF_L2), 6)
    _, f, k = best
    return f, k, _split([r for r in rows if r[0][f] <= k], depth - 1), _split([r for r in rows if r[0][f] > k], depth - 1)


def value(tree, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def isotonic(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """(score, chance) from (score, right weight, weight): chances that never fall as scores rise, by pooling neighbours."""
    pools: list[list[float]] = []
    for s, right, weight in sorted(points):
        if pools and pools[-1][3] == s:
            pools[-1][1:3] = pools[-1][1] + right, pools[-1][2] + weight
        else:
            pools.append([s, right, weight, s])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            s0, r, w, _ = pools.pop(-2)
            pools[-1][:3] = s0, pools[-1][1] + r, pools[-1][2] + w
    return [(s, r / w) for s, r, w, _ in pools]


def fit(cells: list[tuple[tuple, bool, float]]) -> list:
    """Trees from (features, label, weight)."""
    cells = sorted(cells)
    forest, score = [], {c[0]: 0.0 for c in cells}
    for _ in range(TREES if cells else 0):
        rows = []
        for x, y, n in cells:
            p = 1 / (1 + math.exp(-score[x]))
            rows.append((x, n * (y - p), n * p * (1 - p)))
        forest.append(tree := _split(rows, DEPTH))
        for x in score:
            score[x] += value(tree, x)
    return forest


def calibrate(forest: list, cells: list[tuple[tuple, bool, float]], precision: float = PRECISION) -> dict[int, float]:
    """A threshold for each kind of which ``cells`` hold right and wrong examples, and that reaches the chance."""
    limits = {}
    for kind in range(len(KINDS)):
        own = [(sum(value(t, x) for t in forest), n if y else 0.0, n) for x, y, n in cells if x[0] == kind]
        if any(r == n for _, r, n in own) and any(r == 0 for _, r, n in own):
            good = [s for s, p in isotonic(own) if p >= precision]
            if good:
                limits[kind] = min(good)
    return limits


def _weighted(rows: list[tuple[tuple, bool, int, int]]) -> list[tuple[tuple, bool, int, float]]:
    """Counts of (features, label, half) as weights of ``WEIGHT`` in all for each kind and half."""
    total: dict[tuple, int] = {}
    for x, _, half, n in rows:
        total[x[0], half] = total.get((x[0], half), 0) + n
    return [(x, y, half, WEIGHT * n / total[x[0], half]) for x, y, half, n in rows]


def train(found: DataFrame) -> tuple[list, dict[int, float]]:
    """Trees and thresholds from all base matches of ``found`` and the written examples; what comes to the driver is one row for each combination of features, label and half."""
    spark = found.sparkSession
    names, label = [F.col(f"w.{f}").alias(f) for f in FEATURES], [F.col("w.ok").alias("ok"), F.col("w.half").alias("half")]
    corpus = found.select(F.explode("seen").alias("w")).select(*names, *label)
    rows = spark.createDataFrame(examples(), "own int, ok boolean, number int, text string")
    proposed = find_candidates(rows, "text", [F.col("own"), F.col("ok"), F.col("number")])
    written_by_rule = proposed.select("own", "ok", "number", F.explode("wide").alias("w")).where("w.kind = own").select(*names, "ok", (F.col("number") % 2).alias("half"))
    cells = []
    for df in (corpus, written_by_rule):
        counted = df.groupBy(*FEATURES, "ok", "half").agg(F.count("*").alias("n")).collect()
        cells += _weighted([(tuple(r[f] for f in FEATURES), r["ok"], r["half"], r["n"]) for r in counted])
    forest = fit([(x, y, n) for x, y, half, n in cells if not half])
    return forest, calibrate(forest, [(x, y, n) for x, y, half, n in cells if half])


def _score(tree, w: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(w[FEATURES[tree[0]]] <= tree[1], _score(tree[2], w)).otherwise(_score(tree[3], w))


def _selected(model: tuple[list, dict[int, float]]) -> Column:
    """Base spans and added ones, sorted by kind and start."""
    forest, limits = model
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("s"), b["e"].alias("e"), F.lit(False).alias("added")))
    if not limits:
        return base

    def takes(w: Column) -> Column:
        limit = F.lit(float("inf"))
        for k, v in limits.items():
            limit = F.when(w["kind"] == k, F.lit(v - 1e-9)).otherwise(limit)
        return sum((_score(t, w) for t in forest), F.lit(0.0)) >= limit

    added = F.transform(F.filter("wide", takes), lambda w: F.struct(w["kind"].alias("kind"), w["s"].alias("s"), w["e"].alias("e"), F.lit(True).alias("added")))
    return F.when(F.size("wide") > 0, F.array_sort(F.concat(base, added))).otherwise(base)


def find(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, spans)`` for every row of ``docs``: spans (kind, s, e, added) in code points, end exclusive, sorted by kind and start.

    Texts are searched whole, in time near linear in their length and matches; null and empty texts have no spans. Added spans lie apart from all base matches, those that fail their check too. Repeated rows are found alike. An empty table gives no rows. Other columns aren't read. The texts are read once; what is written between is the spans and proposals only.
    """
    found = written(find_candidates(docs, text, [F.col(id_col).cast("long").alias("doc_id")]))
    return found.select("doc_id", _selected(train(found)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in square brackets; spans that overlap become the first's. All columns stay; texts without spans stay as they are, nulls too. Texts are searched once; rows are written with what was found."""
    found = written(find_candidates(docs, text, [F.struct(*(F.col(c) for c in docs.columns)).alias("row")]))
    spans = F.array_sort(F.transform(_selected(train(found)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    df = _once(found.select("row", spans.alias("spans")), __chunks=F.when(F.size("spans") > 0, _chunks(F.col(f"row.{text}").cast("string"))))
    df = _once(df, __ends=_prefixes(F.col("spans"), lambda x: x["e"], F.greatest))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    clean = _replaced(F.col("__chunks"), F.col("spans"), F.col("__ends"), lambda x, before: F.when(x["s"] >= before, F.get(names, x["kind"])).otherwise(""))
    return df.select(*(F.when(F.size("spans") > 0, clean).otherwise(F.col(f"row.{c}")).alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in docs.columns))
