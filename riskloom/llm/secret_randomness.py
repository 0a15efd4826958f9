"""Secret scan: fixed patterns plus a battery of randomness tests.

Candidates are maximal runs of 20 or more token characters with a digit and a letter.  The encoding is
inferred from the characters (hex, base32, base36, base64); under it three tests ask whether the
token could be uniform: chi-squared of the alphabet, runs above and below the middle, and lag-one
serial correlation.  The smallest of the three p-values, times three, is the token's p-value:
uniform on 0 to 1 for random tokens, near 0 for words, slugs and numbered names.

False discoveries are controlled by encoding and length class, since short tokens test weakly: in
each class the random tokens are estimated from the upper half of the p-values, and the least
p-value is taken at which the surplus over them is at most `MOST_FALSE` of the tokens taken.  A token
counts once, however often it is copied.  A class of fewer than `LEAST_TOKENS` goes by its encoding, one
whose encoding has fewer by all tokens and as many random ones as a prior.  Only
a histogram of 100 p-values by class (at most 36 classes) leaves the executors.

Everything is DataFrame functions inside the document's own row.  Places count code points.

Defined cases: null text is empty; runs without a digit or without a letter are no candidates;
candidates that overlap a fixed-pattern span are not repeated; repeated rows get equal results; an
empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.functions.plan import computed_once
from riskloom.llm.shared import settled, table, text_or_empty

# Fixed values.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
)
LENGTH_STEP, LENGTH_CLASSES = 8, 9
BUCKETS, BLOCK = 100, 64
MOST_FALSE, LEAST_P = 0.05, 0.01
#: Among so many random tokens, one more in the lower half is within MOST_FALSE.
LEAST_TOKENS = 40


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, zero: int, combine) -> Column:
    """combine() of all values up to each place, itself included.

    In blocks: appending to an array copies it, so one scan over all places would be quadratic.
    """
    empty = F.array().cast("array<int>")
    scan = lambda block, first, out: F.aggregate(
        block, F.struct(first.alias("at"), empty.alias("all")),
        lambda s, x: F.struct(
            combine(s["at"], x).alias("at"), F.concat(s["all"], F.array(out(s["at"], combine(s["at"], x)))).alias("all")
        ),
        lambda s: s["all"],
    )
    start = F.lit(zero).cast("int")

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, start, combine))
        carried = scan(totals, start, lambda before, after: before)
        return F.flatten(F.zip_with(blocks, carried, lambda block, first: scan(block, first, lambda before, after: after)))

    def cut(array: Column) -> Column:
        last = F.floor(F.greatest(F.size(array) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda n: F.slice(array, n * BLOCK + 1, F.lit(BLOCK)))

    return _bound(values, lambda array: _bound(cut(array), of_blocks))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end, value (of `group`) of all matches, leftmost and non-overlapping, in code points."""
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda whole, value: F.struct(F.length(whole).alias("size"), value.alias("value")),
    )
    gaps = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))

    def placed(pairs: Column) -> Column:  # the last one is the rest behind all matches
        ends = _running(F.transform(pairs, lambda x: x["gap"] + x["size"]), 0, lambda a, b: a + b)
        every = F.zip_with(
            pairs, ends,
            lambda x, end: F.struct((end - x["size"]).alias("start"), end.alias("end"), x["value"].alias("value")),
        )
        return F.slice(every, F.lit(1), F.size(every) - 1)

    pairs = F.zip_with(
        gaps, found,
        lambda gap, match: F.struct(
            gap.alias("gap"), F.coalesce(match["size"], F.lit(0)).alias("size"), match["value"].alias("value")
        ),
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), _bound(pairs, placed)).otherwise(empty)


def _apart(tokens: Column, base: Column) -> Column:
    """tokens (start, end, t; sorted, disjoint) that overlap no span of base; one sweep over both, sorted by start."""
    event = lambda x, token: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), token.alias("t")
    )
    nothing = F.lit(None).cast("struct<encoding:int,plain:string>")
    events = F.array_sort(
        F.concat(F.transform(tokens, lambda x: event(x, x["t"])), F.transform(base, lambda x: event(x, nothing))),
        lambda a, b: a["start"] - b["start"],
    )

    def swept(every: Column) -> Column:
        far = F.lit(2**31 - 1)
        reach = _running(F.transform(every, lambda x: F.when(x["t"].isNull(), x["end"]).otherwise(0)), 0, lambda a, b: F.greatest(a, b))
        backwards = F.transform(F.reverse(every), lambda x: F.when(x["t"].isNull(), x["start"]).otherwise(far))
        ahead = F.reverse(_running(backwards, 2**31 - 1, lambda a, b: F.least(a, b)))
        clear = F.zip_with(
            F.zip_with(every, reach, lambda e, r: F.struct(e.alias("e"), r.alias("reach"))), ahead,
            lambda x, following: F.when(
                x["e"]["t"].isNotNull() & (x["reach"] <= x["e"]["start"]) & (following >= x["e"]["end"]), x["e"]
            ),
        )
        return F.filter(clear, lambda x: x.isNotNull())

    return F.when(F.size(tokens) > 0, _bound(events, swept)).otherwise(
        F.array().cast("array<struct<start:int,end:int,t:struct<encoding:int,plain:string>>>")
    )


def _kinded(kind: str, found: Column) -> Column:
    place = KINDS.index(kind)
    return F.transform(
        found, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("kind"), x["end"].alias("end"))
    )


def _spelled(found: Column) -> Column:
    names = F.lit(list(KINDS))
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ","
    )


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic approximation (error below 0.00015)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), z * z * z * 0.07056 + z * 1.5976)))


def _tested(token: Column) -> Column:
    """encoding (number), length and p-value of a token; null encoding: no candidate."""
    plain = F.translate(F.regexp_replace(token, "=+$", ""), "-_=", "+//")
    lowered = F.when(plain.rlike("^[0-9A-F]+$"), F.lower(plain)).otherwise(plain)
    mixed = plain.rlike("[0-9]") & plain.rlike("[A-Za-z]")
    encoding = (
        F.when(~mixed, None)
        .when(lowered.rlike("^[0-9a-f]+$"), 0)
        .when(plain.rlike("^[A-Z2-7]+$"), 1)
        .when(plain.rlike("^[a-z0-9]+$"), 2)
        .otherwise(3)
    )
    return F.struct(encoding.alias("encoding"), lowered.alias("plain"))


def _battery(x: Column) -> Column:
    """p-value of x (encoding, plain, at: positions of the characters in the alphabet)."""
    size = F.get(F.lit([float(len(a)) for _, a in ALPHABETS]), x["encoding"])
    n = F.size(x["at"]).cast("double")
    squares = F.aggregate(
        F.split(F.get(F.lit([a for _, a in ALPHABETS]), x["encoding"]), ""),
        F.lit(0.0),
        lambda s, a: s + F.when(
            a != "", F.pow((F.length(x["plain"]) - F.length(F.replace(x["plain"], a, F.lit("")))).cast("double"), 2)
        ).otherwise(0.0),
    )
    free = size - 1
    chi = F.greatest(squares * size / n - n, F.lit(0.0))
    spread = 2 / (free * 9)
    p_uniform = _tail((F.cbrt(chi / free) - (1 - spread)) / F.sqrt(spread))

    high = lambda v: v * 2 >= size
    pairs = F.zip_with(
        F.slice(x["at"], 1, F.size(x["at"]) - 1), F.slice(x["at"], 2, F.size(x["at"]) - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    n_high = F.size(F.filter(x["at"], high)).cast("double")
    n_low = n - n_high
    changes = F.size(F.filter(pairs, lambda p: high(p["a"]) != high(p["b"]))) + 1
    mean = n_high * n_low * 2 / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(variance > 0, _tail(F.abs(changes - mean) / F.sqrt(variance)) * 2).otherwise(0.0)

    middle = F.aggregate(x["at"], F.lit(0.0), lambda s, v: s + v) / n
    power = F.aggregate(x["at"], F.lit(0.0), lambda s, v: s + (v - middle) * (v - middle))
    along = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - middle) * (p["b"] - middle))
    p_serial = F.when(
        power > 0, _tail(F.abs((along / power + 1 / n) * F.sqrt(n))) * 2
    ).otherwise(0.0)
    return F.least(F.lit(1.0), F.least(p_uniform, p_runs, p_serial) * 3)


def _length_class(length: Column) -> Column:
    return F.least(F.floor(length / LENGTH_STEP).cast("int"), F.lit(LENGTH_CLASSES - 1))


def scanned(documents: DataFrame, *keep: str) -> DataFrame:
    """keep, base (spans of the fixed patterns) and tokens (start, end, class, p, token: its hash) of every text."""
    text = F.col("_text")
    one = computed_once(
        documents.select(*keep, text_or_empty().alias("_text")),
        _assign=F.filter(spans(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGN_LEAST),
        _access=spans(text, ACCESS),
        _hex=spans(text, HEX),
        _tokens=F.transform(
            spans(text, TOKEN),
            lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _tested(x["value"]).alias("t")),
        ),
    ).drop("_text")
    base = F.sort_array(F.concat(_kinded("assign", F.col("_assign")), _kinded("access", F.col("_access")), _kinded("hex", F.col("_hex"))))
    two = computed_once(
        one.select(
            *keep,
            *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
            base.alias("base"), "_tokens",
        ),
        _free=_apart(F.filter("_tokens", lambda x: x["t"]["encoding"].isNotNull()), F.col("base")),
    ).drop("_tokens")
    placed = F.transform(
        "_free",
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["t"]["encoding"].alias("encoding"),
            x["t"]["plain"].alias("plain"),
            F.transform(
                F.filter(F.split(x["t"]["plain"], ""), lambda c: c != ""),
                lambda c: F.position(c, F.get(F.lit([a for _, a in ALPHABETS]), x["t"]["encoding"])) - 1,
            ).alias("at"),
        ),
    )
    three = computed_once(two, _at=placed).drop("_free")
    tokens = F.transform(
        "_at",
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            (x["encoding"] * LENGTH_CLASSES + _length_class(F.size(x["at"]))).alias("class"),
            _battery(x).alias("p"), F.xxhash64(x["plain"]).alias("token"),
        ),
    )
    return three.select(*keep, "n_assign", "n_access", "n_hex", "base", tokens.alias("tokens"))


def _least_bucket(counts: list[float]) -> int | None:
    """counts by bucket.  The least bucket from which on the surplus over random tokens is small enough."""
    random = 2 * sum(counts[BUCKETS // 2 :])
    least, taken = None, 0.0
    for bucket in range(BUCKETS - 1, round(LEAST_P * BUCKETS) - 1, -1):
        taken += counts[bucket]
        if taken and taken - random * (1 - bucket / BUCKETS) <= taken * MOST_FALSE:
            least = bucket
    return least


def least_p(tokens: DataFrame) -> dict[int, float]:
    """tokens: class, p, token.  By class, the least p-value taken; from a histogram of bounded size."""
    bucket = F.least(F.floor(F.col("p") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    each = tokens.groupBy("class", "token").agg(F.min(bucket).alias("bucket"))
    by_class: dict[int, list[float]] = {}
    by_encoding: dict[int, list[float]] = {}
    every = [LEAST_TOKENS / BUCKETS] * BUCKETS
    for r in each.groupBy("class", "bucket").agg(F.count("*").alias("n")).collect():
        encoding = r["class"] // LENGTH_CLASSES
        for counts in (by_class.setdefault(r["class"], [0] * BUCKETS), by_encoding.setdefault(encoding, [0] * BUCKETS), every):
            counts[r["bucket"]] += r["n"]
    out = {}
    for number, counts in by_class.items():
        wider = (counts, by_encoding[number // LENGTH_CLASSES], every)
        least = _least_bucket(next((c for c in wider if sum(c) >= LEAST_TOKENS), every))
        if least is not None:
            out[number] = least / BUCKETS
    return out


def secrets(documents: DataFrame, *keep: str) -> DataFrame:
    """keep, counts, base and found: all spans (start, kind, end) with those of the battery."""
    rows = settled(scanned(documents, *keep))
    limits = least_p(rows.select(F.inline("tokens")).select("class", "p", "token"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    added = none
    if limits:
        by_class = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        random = F.filter("tokens", lambda x: x["p"] >= F.element_at(by_class, x["class"]))
        added = _kinded("random", random)
    return rows.withColumn("found", F.sort_array(F.concat("base", added))).drop("tokens")


def op10_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"), "doc_id")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_spelled(F.col("base")), 256).alias("base_sha256"), _spelled(F.col("found")).alias("spans"),
    )
