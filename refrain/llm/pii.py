"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that come with them.

The base kinds are found by patterns. What they match are the protected entities. A term discloses an entity as far as
their co-occurrence in the documents of the corpus is informative: PMI(entity; term) / IC(entity), the pointwise mutual
information of the two over the information content of the entity (Sanchez and Batet), 1 where the term never occurs
without the entity. All terms of the documents that hold an entity are weighed. Where the disclosure reaches the threshold,
and chance would hardly put the term there as often, each occurrence of the term in the documents that hold the entity
becomes a span of kind `term`. Sanitising generalises each span to the name of its kind.

Equal texts are one document that counts as often as it occurs, and entities of the same documents are one class, as
every term discloses them alike; so neither copies nor lists of addresses multiply pairs. A pair is only counted where
the numbers of documents of term and class leave the threshold in reach, which leaves out common words.

Only DataFrame functions are used. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.common import fresh, quoted, read, stored

LOCAL = "A-Za-z0-9._%+-"
#: Patterns of the base kinds, in the order in which they are listed. Each finds just the matches of the plain pattern in its
#: comment that hold up, in time linear in the text: it begins where a run of its characters or the last match ends,
#: and never takes back what it has read. None of the plain matches that fail hides the start of one that holds, but
#: for `ip`, whose parts are therefore judged afterwards.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([ -]?[0-9])+ of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    # \+[0-9][ ().0-9-]+[0-9] of 10 to 15 digits
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){9,14}+(?![ ().-]*+[0-9])",
}
KINDS = [*PATTERNS, "term"]
#: What a text must hold for a pattern to match.
NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}
TERM = r"\p{L}{3,}"
NONE = "array<struct<start:int,kind:int,end:int,value:string>>"


@dataclass(frozen=True)
class PiiParams:
    """disclosure: share of the entity's information content from which a term is a span. chance: the most that chance may account
    for a term among all those weighed with the entity."""

    disclosure: float = 0.9
    chance: float = 0.05


def _let(value: Column, then) -> Column:
    """then(value), with value computed once; inside a lambda function, a plain expression is computed again for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(values: Column, start: Column, step) -> Column:
    """Running results of step (which is associative, with `start` neutral): by blocks of 256, so that long arrays take little time."""
    over = lambda xs, first: F.aggregate(xs, first, step)

    def by_block(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(start), lambda a, xs: F.array_append(a, step(F.element_at(a, -1), over(xs, start))))
        within = lambda xs, first: F.transform(xs, lambda x, i: over(F.slice(xs, F.lit(1), i + 1), first))
        return _let(before, lambda sums: F.flatten(F.transform(blocks, lambda xs, b: _let(F.get(sums, b), lambda first: within(xs, first)))))

    return _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / 256).cast("int")), lambda b: F.slice(values, b * 256 + 1, 256)), by_block)


def _sums(lengths: Column) -> Column:
    return _running(lengths, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str, kind: int) -> Column:
    """start, kind, end and value of each match, in order: what lies between matches and the matches themselves give the places."""

    def placed(found: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda a, b: F.length(a) + F.length(b))
        return F.zip_with(_let(sizes, _sums), found, lambda e, v: F.struct((e - F.length(v)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), v.alias("value")))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(NONE))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start, then kind; an empty array for a null or empty text."""
    holds = {
        "ip": lambda s: F.forall(F.split(s["value"], r"\."), lambda x: F.length(F.ltrim(x, F.lit("0"))).between(0, 3) & (F.coalesce(F.substring(F.ltrim(x, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255)),
        "card": lambda s: F.call_function("luhn_check", F.regexp_replace(s["value"], "[ -]", "")),
    }
    parts = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = matches(text, pattern, k)
        spans = F.filter(spans, holds[kind]) if kind in holds else spans
        parts.append(F.when(NEEDS[kind](text), spans).otherwise(F.array().cast(NONE)))
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _key(text: Column) -> Column:
    """Tells texts apart."""
    return F.md5(text.cast("binary"))


def _without_emails(text: Column) -> Column:
    """The text with blanks for its emails, the only base spans that hold letters; every other place stays."""
    parts, found = F.split(text, PATTERNS["email"], -1), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))
    blank = lambda a, b: F.concat(a, F.coalesce(F.repeat(F.lit(" "), F.length(b)), F.lit("")))
    return F.when(NEEDS["email"](text) & text.rlike(PATTERNS["email"]), F.array_join(F.zip_with(parts, found, blank), "")).otherwise(text)


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _entity(span: Column) -> Column:
    own = F.when(span["kind"] == 0, F.lower(span["value"])).otherwise(F.regexp_replace(span["value"], "[^0-9.]", ""))
    return F.concat(span["kind"].cast("string"), F.lit(":"), own)


def _evidence(both: Column) -> Column:
    """-log of the most that chance gives a term to be in `both` or more of the entity's documents, were its own dealt at random
    (Hoeffding's bound of the hypergeometric tail; exact for an entity of one document). 0 for terms met no more often than expected."""
    share, base = both / F.col("with_entity"), F.col("with_term") / F.col("total")
    rest = F.when((share < 1) & (base < 1), (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return F.when(share > base, F.col("with_entity") * (share * F.log(share / base) + rest)).otherwise(0.0)


def _tells(both: Column, p: PiiParams) -> Column:
    """Whether a term that is in `both` of the entity's documents discloses it."""
    content = F.log(F.col("total") / F.col("with_entity"))
    pmi = F.log(both * F.col("total") / (F.col("with_entity") * F.col("with_term")))
    return (content > 0) & (pmi >= p.disclosure * content) & (_evidence(both) >= F.log(F.col("weighed") / F.lit(p.chance)))


def classes(holding: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that the same texts hold are one class: (class, with_entity, weighed) and (class, key). holding: entity, key, n (rows of the text), words (its terms).

    A class is known by the exclusive or of two hashes of its texts' keys and their number.
    """
    every = holding.groupBy("entity").agg(F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.reverse("key"))).alias("y"), F.sum("n").alias("with_entity"), F.sum("words").alias("weighed"), F.count("*").alias("texts"))
    named = stored(every.select("entity", F.struct("x", "y", "texts").alias("class"), "with_entity", "weighed"), "entities")
    held = holding.select("entity", "key").join(named.select("entity", "class"), "entity").select("class", "key").distinct()
    return named.select("class", "with_entity", "weighed").distinct(), held


def disclosing(docs: DataFrame, p: PiiParams) -> DataFrame:
    """(key, placed) of the texts that hold terms which disclose an entity of theirs: the spans (start, kind, end, value) of these terms. docs: text, not null.

    Documents are counted over the whole table: those with the term anywhere, with the entity, and with both.
    """
    found = docs.withColumn("spans", base_spans(F.col("text"))).where("size(spans) > 0")
    found = found.select(_key(F.col("text")).alias("key"), F.array_distinct(F.transform("spans", _entity)).alias("entities"), _without_emails(F.col("text")).alias("rest"))
    held = stored(found.groupBy("key").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("rest").alias("rest")), "held")
    words = held.select("key", "n", F.explode(_words(F.col("rest"))).alias("term"))
    sized = held.select("key", "n", "entities", F.size(_words(F.col("rest"))).alias("words"))
    kinds, members = classes(sized.select("key", "n", "words", F.explode("entities").alias("entity")))
    counted = docs.select(F.explode(_words(_without_emails(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    total = docs.agg(F.count("*").alias("total"))
    asked = members.join(kinds, "class").crossJoin(F.broadcast(total))  # total: one row
    # the others fall short even if one were never met without the other
    met = asked.join(words.join(counted, "term"), "key").where(_tells(F.least("with_entity", "with_term"), p))
    met = stored(met.select("class", "key", "n", "term", "with_entity", "with_term", "weighed", "total").hint("rebalance"), "met")  # few of the joined rows are left
    both = met.groupBy("class", "term", "with_entity", "with_term", "weighed", "total").agg(F.sum("n").alias("both"))
    told = both.where(_tells(F.col("both"), p)).select("class", "term")
    chosen = met.select("class", "term", "key").join(told, ["class", "term"]).select("key", "term").distinct()
    chosen = stored(chosen, "chosen")
    each = held.join(chosen.select("key").distinct(), "key", "left_semi").select("key", F.explode(matches(F.col("rest"), TERM, len(PATTERNS))).alias("t")).withColumn("term", F.lower("t.value"))
    return stored(each.join(chosen, ["key", "term"]).groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("placed")), "placed")


def with_spans(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """docs with `base` and `spans`, arrays of (start, kind, end, value), by start, then kind; kinds count from 0 in KINDS.

    Null texts are as empty ones: no spans. Equal texts get equal spans, whatever their doc_id, and repeated rows count as often as they
    occur. Texts are searched whole, in time linear in their length and entities. Columns other than text stay as they are, under any names; `base`
    and `spans` are replaced. A table without rows gives none.
    """
    keep = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    own = docs.select(*quoted(keep))
    key, placed, plain = (fresh(docs, n) for n in ("term_key", "placed", "base"))
    text = F.coalesce("text", F.lit(""))
    terms = disclosing(docs.select(text.alias("text")), p).select(F.col("key").alias(key), F.col("placed").alias(placed))
    found = own.withColumns({plain: base_spans(text), key: _key(text)}).join(terms, key, "left")
    every = F.when(F.col(placed).isNull(), F.col(plain)).otherwise(F.array_sort(F.concat(plain, placed)))
    return found.select(*quoted(keep), F.col(plain).alias("base"), every.alias("spans"))


#: Code points of the chunks from which parts of a text are taken.
CHUNK = 512


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span generalised to the name of its kind in brackets; what overlaps goes with the earlier span."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def masked(chunks: Column) -> Column:
        def part(low: Column, high: Column) -> Column:
            first = F.floor(low / CHUNK).cast("int")
            some = F.slice(chunks, first + 1, F.floor((high - 1) / CHUNK).cast("int") - first + 1)
            return F.when(low < high, F.substring(F.array_join(some, ""), low - first * CHUNK + 1, high - low)).otherwise("")

        def by_end(ends: Column) -> Column:  # the farthest end of each span and those before
            at = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
            each = F.transform(spans, lambda s, i: F.when(s["start"] >= at(i), F.concat(part(at(i), s["start"]), F.get(names, s["kind"]))).otherwise(""))
            return F.concat(F.array_join(each, ""), part(F.element_at(ends, -1), F.length(text)))

        return _let(_running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x)), by_end)

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), masked))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and spans of every document, a row each, as with_spans finds them.

    Null and empty texts have no spans; repeated rows and null ids are rows of their own; other columns are not looked
    at; a table without rows gives none.
    """
    found = with_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *(count(k) for k in range(len(PATTERNS))), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text sanitised and n_chars counted anew."""
    clash = {c: fresh(docs, f"other_{c.lower()}") for c in docs.columns if c.lower() in ("base", "spans")}
    found = with_spans(docs.withColumnsRenamed(clash)).withColumn("text", sanitised(F.col("text"), F.col("spans"))).drop("base", "spans")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.withColumnsRenamed({new: old for old, new in clash.items()}).select(*quoted(docs.columns))
