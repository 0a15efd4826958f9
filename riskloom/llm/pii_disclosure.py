"""Personal data: fixed patterns, then terms that disclose a protected entity.

The spans of the patterns are the protected entities.  The words of a document that holds an entity,
however far off, are candidate terms.
Over all documents, the pointwise mutual information of term and entity,
log(N n(t,e) / (n(t) n(e))), is compared with the information of the entity, log(N / n(e)): a term
whose share reaches `DISCLOSES` gives the entity away, and each of its occurrences in the documents that
hold the entity becomes a span of kind `term`.  A pair needs `LEAST_SUPPORT` different texts, and near copies are
one text, so copies of one text are no evidence.  Only documents of entities with as many texts are compared
and paired with terms, and only terms rare enough to reach the share.

All counts are aggregates with map-side sums.  The count of terms over all documents is limited to terms
of supported pairs: each partition sums the terms of a broadcast set while they are at most
`BROADCAST_TERMS`, else counts of all words are joined by a shuffle; both give the same rows.

Defined cases: null text is empty; documents without words beside entities disclose nothing; repeated
rows get equal results; an empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from unicodedata import category

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.llm.chosen_path import classified
from riskloom.llm.shared import stored, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[^0-9]")
MARKS = frozenset(c for c in map(chr, (*range(0x300, 0x1F000), *range(0xE0100, 0xE01F0))) if category(c).startswith("M"))
LETTERS = re.compile(r"[^\W\d_]{3,}")
# A set with characters above U+FFFF is searched range by range, so these are looked at only where one stands.
_LOW, _HIGH = ("".join(sorted(c for c in MARKS if (c > "￿") == high)) for high in (False, True))
TERM = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_LOW}]|(?=[\U00010000-\U0010FFFF])[{_HIGH}]){{2,}}")
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

DISCLOSES, LEAST_SUPPORT = 0.8, 3
BROADCAST_TERMS = 200_000


def emails(text: str) -> list[tuple[int, int]]:
    """Every match ends its local part at an @, so only the text before each @ is looked at."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            end = match.end()
        at = text.find("@", max(at + 1, end))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    found = []
    for run in DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in IP.finditer(run[0]):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append((run.start() + m.start(), run.start() + m.end()))
    return found


def passes_luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and passes_luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.sub("", m[0])) <= 15]


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of KINDS, each from left to right."""
    return [emails(text) if "@" in text else [], addresses(text), cards(text), phones(text)]


def spelled(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, found in enumerate(spans) for a, b in found)


def entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{DIGIT.sub('', value) if kind in (2, 3) else value.lower()}"


def terms_in(text: str) -> Iterator[re.Match]:
    """The words of a text that can be terms."""
    return (LETTERS if text.isascii() or MARKS.isdisjoint(text) else TERM).finditer(text)


def free_terms(text: str) -> list[tuple[str, int, int]]:
    """term, start and end of every word that no entity covers."""
    taken = sorted(s for own in base_spans(text) for s in own)
    out, at, end = [], 0, 0  # end: the farthest end of the entities that start before the word does
    for m in terms_in(text):
        while at < len(taken) and taken[at][0] < m.end():
            end = max(end, taken[at][1])
            at += 1
        if end <= m.start():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def _found(rows: DataFrame) -> DataFrame:
    """rows: doc_id, mark, text.  The text is kept where it has entities."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            spans, entities, texts = [], [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text)
                for n in range(4):
                    counts[n].append(len(found[n]))
                spans.append(spelled(found))
                entities.append(sorted({entity(n, text[a:b]) for n, own in enumerate(found) for a, b in own}))
                texts.append(text if entities[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array(spans, pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array(texts, pa.string())],
                ["doc_id", "mark", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "held"],
            )

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, mark long, n_email long, n_ip long, n_card long, n_phone long, base string, "
        f"entities array<string>, held string",
    )


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: in how many documents each of `terms` is.

    Up to `BROADCAST_TERMS` terms go to the tasks, which count those alone; more are joined to
    the counts of all words.  Both read words by TERM, so the counts do not depend on the form.
    """
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    wanted = documents.sparkSession.sparkContext.broadcast(
        frozenset(r["term"] for r in terms.collect()) if few else None
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value

        def counted(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"]
            )

        counts = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    words = {w.lower() for w in {m[0] for m in terms_in(text)}}
                    counts.update(words if known is None else known & words)
            if known is None:
                yield counted(counts)
                counts = Counter()
        if counts:
            yield counted(counts)

    parts = documents.select("text").mapInArrow(run, "term string, n long")
    sums = parts.groupBy("term").agg(F.sum("n").alias("n"))
    return sums if few else sums.join(terms, "term", "left_semi")


def _with_classes(found: DataFrame) -> DataFrame:
    """doc_id, mark, kin, held and entity of the documents that hold an entity of enough texts.

    kin: the class of near copies.  Only these texts are compared.
    """
    content = F.xxhash64("held").alias("content")
    holds = found.filter(F.size("entities") > 0).select("doc_id", "mark", content, F.explode("entities").alias("entity"))
    often = holds.groupBy("entity").agg(F.count_distinct("content").alias("n")).filter(F.col("n") >= LEAST_SUPPORT)
    some = stored(holds.join(often.select("entity"), "entity", "left_semi").distinct())
    texts = found.filter("held IS NOT NULL").select(content, "held").join(
        some.select("content").distinct(), "content", "left_semi"
    )
    texts = stored(texts.groupBy("content").agg(F.first("held").alias("held")))
    kin = classified(texts.select(F.col("content").alias("doc_id"), F.col("held").alias("text")))
    kin = kin.select(F.col("doc_id").alias("content"), F.col("label").alias("kin"))
    return some.join(texts.join(kin, "content"), "content")


def _terms(held: DataFrame) -> DataFrame:
    """The rows with the distinct terms of `held`."""
    names = [c for c in held.columns if c != "held"]
    schema = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t for t, _, _ in free_terms(text)}) for text in batch.column("held").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(terms, pa.list_(pa.string()))], [*names, "terms"]
            )

    return held.mapInArrow(run, f"{schema}, terms array<string>")


def disclosing(documents: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entity, term, share: the pairs in which the term gives the entity away; and doc_id, mark, entity,
    term: where such pairs can be."""
    rows = stored(_with_classes(found))
    n_entity = stored(
        rows.groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct("kin").alias("support"))
        .filter(F.col("support") >= LEAST_SUPPORT).drop("support")
    )
    holders = rows.join(n_entity.select("entity"), "entity", "left_semi").groupBy("doc_id", "mark").agg(
        F.first("kin").alias("kin"), F.first("held").alias("held"), F.collect_set("entity").alias("entities")
    )
    words = stored(_terms(holders).select("doc_id", "mark", "kin", "entities", F.explode("terms").alias("term")))
    total = float(max(documents.count(), 1))
    # n_pair is at most n_entity, and a term is in no fewer documents than it is beside entities in:
    # terms and pairs that these bounds already keep below the threshold are neither paired nor counted.
    most = lambda n: n * F.pow(F.lit(total) / F.col("n_entity"), 1 - DISCLOSES) * (1 + 1e-9)
    reach = n_entity.agg(F.max(most(F.col("n_entity")))).first()[0] or 0.0
    n_near = words.groupBy("term").agg(F.count("*").alias("n_near"), F.count_distinct("kin").alias("support")).filter(
        (F.col("support") >= LEAST_SUPPORT) & (F.col("n_near") <= reach)
    ).drop("support")
    around = words.join(n_near, "term").select("doc_id", "mark", "kin", "term", "n_near", F.explode("entities").alias("entity"))
    around = stored(
        around.join(n_entity, "entity").filter(F.col("n_near") <= most(F.col("n_entity")))
    )
    pairs = stored(
        around.groupBy("entity", "term").agg(
            F.count_distinct("kin").alias("support"), F.count("*").alias("n_pair"),
            F.first("n_entity").alias("n_entity"), F.first("n_near").alias("n_near"),
        ).filter((F.col("support") >= LEAST_SUPPORT) & (F.col("n_near") <= most(F.col("n_pair"))))
    )
    n_term = term_counts(documents, pairs.select("term").distinct())
    both = pairs.join(n_term, "term").withColumn("n", F.greatest("n", "n_pair"))
    information = F.log2(F.lit(total) / F.col("n_entity"))
    shared = F.log2(F.col("n_pair") * total / (F.col("n") * F.col("n_entity")))
    share = F.when(information > 0, shared / information)
    return (
        both.withColumn("share", share).filter(F.col("share") >= DISCLOSES).select("entity", "term", "share"),
        around.select("doc_id", "mark", "entity", "term"),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """rows: doc_id, mark, held, names (terms).  terms: (start, end) of every occurrence."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text, names in zip(batch.column("held").to_pylist(), batch.column("names").to_pylist()):
                own = set(names)
                spans.append([{"start": a, "end": b} for t, a, b in free_terms(text) if t in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_mark"), pa.array(spans, SPANS)], ["_id", "_mark", "terms"]
            )

    return rows.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "held", "names").mapInArrow(
        run, f"_id {kind}, _mark long, terms array<struct<start:int,end:int>>"
    )


def _same(hits: DataFrame, rows: DataFrame) -> Column:
    return rows["doc_id"].eqNullSafe(hits["_id"]) & (rows["mark"] == hits["_mark"])


def protected(documents: DataFrame) -> DataFrame:
    """doc_id, mark, counts, base and terms: (start, end) spans of disclosing terms."""
    rows = documents.select("doc_id", F.xxhash64("doc_id", text_or_empty()).alias("mark"), text_or_empty().alias("text"))
    found = stored(_found(rows))
    pairs, around = disclosing(documents, found)
    names = around.join(pairs, ["entity", "term"]).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.collect_set("term").alias("names")
    )
    holders = found.filter("held IS NOT NULL").select("doc_id", "mark", "held")
    # Rows of equal id and text come more than once.
    named = holders.join(names, _same(names, holders)).dropDuplicates(["doc_id", "mark"])
    hits = stored(_placed(named.select("doc_id", "mark", "held", "names")))
    return found.drop("held", "entities").join(hits, _same(hits, found), "left").select(
        "doc_id", "mark", "n_email", "n_ip", "n_card", "n_phone", "base", "terms"
    )


def sanitised_text(text: str, terms: list[tuple[int, int]]) -> str:
    """Entities become their kind in brackets; capitalised terms become [NAME], others go."""
    spans = [(a, b, f"[{KINDS[k].upper()}]") for k, own in enumerate(base_spans(text)) for a, b in own]
    spans += [(a, b, "[NAME]" if text[a].isupper() else "") for a, b in terms]
    out, at = [], 0
    for a, b, shown in sorted(spans):
        if a >= at:
            out += [text[at:a], shown]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitised(documents: DataFrame) -> DataFrame:
    """The documents, all columns, with entities generalised and disclosing terms generalised or removed."""
    mark = F.xxhash64("doc_id", text_or_empty())
    hits = protected(documents).filter("terms IS NOT NULL").select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("terms").alias("_terms")
    ).distinct()
    joined = documents.join(
        hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), "left"
    ).select(*documents.columns, "_terms")
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if text is None else sanitised_text(text, [(t["start"], t["end"]) for t in terms or []])
                for text, terms in zip(batch.column("text").to_pylist(), batch.column("_terms").to_pylist())
            ]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, documents.schema)


def _term_spans() -> Column:
    terms = F.array_join(
        F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"])), ","
    )
    return F.when(F.col("terms").isNull(), F.col("base")).otherwise(
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), terms)
    )


def op8_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protected(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
        _term_spans().alias("spans"),
    )
