"""Personal data: patterns find identifying values, corpus co-occurrence finds the terms that give them away.

Protected entities are the distinct values that the patterns find. A term is a word of letters. Near copies of a document are
one group, so that copies are no evidence. Over all documents, with N documents, df(e) groups that hold entity e, df(t)
documents that hold term t and df(e,t) groups that hold both, wherever they stand in a document,

    IC(e) = ln N / df(e)        PMI(e; t) = ln N df(e,t) / (df(e) df(t))

A term discloses e if PMI(e; t) >= ``threshold`` * IC(e): it then tells a reader at least that share of what the value itself
would. Such terms are spans of their own (kind ``term``) wherever they stand in a document with e, and are generalised with
the values when a text is sanitised. A pair that fewer than ``min_documents`` groups hold is thin evidence: in one document,
every rare word stands with every value. There only words count that begin with a capital letter, as names do, and df(e,t) is
smoothed to how near they stand at best: 1 for the two words next to the value on either side (a name in full), 1/2, 1/3 and so on
for the words beyond, up to ``NEAR`` words away. So a rare name beside an address is found in a single document, and a rare word is
not.

Groups of near copies are found by minwise hashes of a document's shingles of five words, ``PRINTS`` times ``HASHES`` of them
together. A document is in the group of the document, of those that share one of these prints, whose text has the least hash: groups
do not hang on the order of rows, and equal texts are in one group. But for one in 5,000, near copies
of similarity 0.8 do, documents of similarity 0.1 in one of 80 cases. Documents of less than five words have one shingle.

All of it is DataFrame work: patterns run on the JVM, a document's spans are found within its own row, and only counts and
(entity, term) pairs are shuffled, added up before. Patterns are possessive and anchored at the first character a match can
have, so that a text is scanned once, however long its runs of digits or letters are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.skew import common, join_by
from rowtide.sources.shared import cut


KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}+",
    # a whole run of 12 to 19 digits, each after at most one blank or hyphen
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without this character there is no match.
_NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}{2,}"
#: Words on either side of a value in which a term is near it, and the characters in which they are looked for.
NEAR, NEAR_CHARACTERS = 8, 256
PRINTS, HASHES, SHINGLE = 12, 3, 5
#: Matches of a text that are folded at once, at least; more than their square are folded in more at once.
FOLDED = 64
#: Most terms, and most entities, that are broadcast (a few MB); longer lists are joined by shuffle.
MOST_BROADCAST = 100_000


def _let(x: Column, use) -> Column:
    """``use`` of the value of ``x``, which is computed once however often it is used."""
    return F.transform(F.array(x), use)[0]


def _located(text: Column, pattern: Column) -> Column:
    """Array of (start, end, value) of all matches, in code points, end exclusive.

    Matches are folded in chunks of about the root of their number, as a fold copies what it has gathered at each step.
    """
    steps = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["hit"].alias("hit")))

    def chunks(all_: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda k: F.slice(all_, k * size + 1, size))

    def moved(at: Column, x: Column) -> Column:
        return at + x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))

    def begin(starts: Column, part: Column) -> Column:
        return F.array_append(starts, F.aggregate(part, F.element_at(starts, -1), moved))

    def step(acc: Column, x: Column) -> Column:
        to = moved(acc["at"], x)
        hit = F.struct((acc["at"] + x["gap"]).alias("start"), to.alias("end"), x["hit"].alias("value"))
        return F.struct(to.alias("at"), F.when(x["hit"].isNull(), acc["found"]).otherwise(F.array_append(acc["found"], hit)).alias("found"))

    def fold(part: Column, at: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
        return F.aggregate(part, F.struct(at.alias("at"), empty.alias("found")), step, lambda acc: acc["found"])

    def joined(parts: Column) -> Column:
        starts = F.aggregate(parts, F.array(F.lit(0)), begin)
        return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), fold))

    def located(all_: Column) -> Column:
        size = F.greatest(F.lit(FOLDED), F.ceil(F.sqrt(F.size(all_))).cast("int"))
        return F.when(F.size(all_) > FOLDED, _let(_let(size, lambda n: chunks(all_, n)), joined)).otherwise(fold(all_, F.lit(0)))

    return _let(steps, located)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])?"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return digits.between(12, 19) & _luhn(value)
    if kind == "phone":
        return digits.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, rank, end, kind, value) of what the patterns find in ``text``; null text has none."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        may = F.contains(text, F.lit(_NEEDED[kind])) & text.rlike(pattern) if _NEEDED[kind] else text.rlike(pattern)
        good = F.filter(_located(text, F.lit(pattern)), _keeps(kind))
        found.append(F.when(may, F.transform(good, _as_span(rank, kind))).otherwise(none))
    return F.array_sort(F.concat(*found))


def _keeps(kind: str):
    return lambda x: _valid(kind, x["value"])


def _as_span(rank: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["value"]))


def _entities() -> Column:
    return F.array_distinct(F.transform("_base", _entity))


def _common(spread: DataFrame) -> DataFrame:
    """The commonest terms of ``spread``, at most ``MOST_BROADCAST``: all whose count reaches a power of two."""
    sizes = spread.groupBy(F.floor(F.log2("with_term")).alias("power")).count().orderBy(F.desc("power")).collect()
    least, total = 64, 0
    for power, count in sizes:
        total += count
        if total > MOST_BROADCAST:
            break
        least = power
    return spread.where(F.floor(F.log2("with_term")) >= least)


def _words(text: Column) -> Column:
    return _in_case(F.lower(text))


def _in_case(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def copy_groups(held: DataFrame) -> DataFrame:
    """``held`` (_row, text and other columns) with ``_copy_of``, which is the same in a group of near copies."""
    least = lambda shingles, k: F.array_min(F.transform(shingles, _hashed(k)))
    prints = lambda shingles: F.array(*(F.xxhash64(F.lit(k), *(least(shingles, k * HASHES + h) for h in range(HASHES))) for k in range(PRINTS)))
    prints = held.select("_row", F.xxhash64("text").alias("own"), F.explode(_let(_let(_words(F.col("text")), _shingles), prints)).alias("print"))
    prints = cut(prints)
    first = cut(prints.groupBy("print").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n")))
    often = common(first, "print", "n", prints.count())
    of_rows = join_by(prints, "print", first.select("print", "first"), "print", often).groupBy("_row").agg(F.min("first").alias("_copy_of"))
    return held.join(of_rows, "_row")


def _shingles(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - SHINGLE + 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))


def _hashed(k: int):
    return lambda x: F.xxhash64(F.lit(k), x)


def _near(held: DataFrame) -> DataFrame:
    """(entity, term, nearness) of the capitalised words around each value: 1, 1, 1/2, 1/3 and so on by their place."""
    span = F.explode("_base").alias("s")
    rows = held.select("text", span)
    left = F.least(F.col("s.start"), F.lit(NEAR_CHARACTERS))
    before = F.reverse(_in_case(F.substr("text", F.col("s.start") - left + 1, left)))
    # a word that begins at the border may be cut
    before = F.when(F.col("s.start") > NEAR_CHARACTERS, F.slice(before, F.lit(1), F.greatest(F.size(before) - 1, F.lit(0)))).otherwise(before)
    after = _in_case(F.substr("text", F.col("s.end") + 1, F.lit(NEAR_CHARACTERS)))
    cut_off = F.length("text") > F.col("s.end") + NEAR_CHARACTERS
    after = F.when(cut_off, F.slice(after, F.lit(1), F.greatest(F.size(after) - 1, F.lit(0)))).otherwise(after)
    entity = _entity(F.col("s")).alias("entity")
    sides = [rows.select(entity, F.posexplode(F.slice(x, 1, NEAR)).alias("at", "word")) for x in (before, after)]
    words = sides[0].unionByName(sides[1]).where(F.col("word").rlike(r"^\p{Lu}")).select("entity", "at", F.lower("word").alias("term"))
    return words.groupBy("entity", "term").agg((1 / F.greatest(F.min("at"), F.lit(1))).alias("nearness"))


def disclosing_terms(docs: DataFrame, held: DataFrame, threshold: float, min_documents: int) -> DataFrame:
    """(entity, terms): the terms that disclose each entity. ``held``: the documents with spans, as _row, text, ``_base`` and
    ``_copy_of``, the group of near copies.

    As df(e,t) is neither above df(e) nor, but for copies, above df(t), ln N / max(df(e), df(t)) bounds PMI(e; t), so a term t can
    disclose e only if df(t) <= N (df(e) / N)**threshold. A document's words are held against the widest such limit of its entities
    before pairs are made: common words by a broadcast list, the rest by a join that also leaves out the words of fewer than
    ``min_documents`` documents. What stays meets the document's entities within their own limits. That loses nothing; pairs are added
    up before their shuffle.
    """
    n = F.lit(float(docs.count()))
    enough = F.lit(threshold) * F.ln(n / F.col("with_entity"))
    of_rows = held.select("_row", "_copy_of", F.explode(_entities()).alias("entity"))
    in_groups = of_rows.groupBy("entity", "_copy_of").agg(F.count(F.lit(1)).alias("n"))
    entities = cut(in_groups.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"), F.sum("n").alias("rows")))
    often = cut(common(entities, "entity", "rows", entities.agg(F.sum("rows").alias("n")).first().n or 0))
    distinct_words = F.array_distinct(_words(F.col("text")))
    spread = cut(docs.select(F.explode(distinct_words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("with_term")).where("with_term > 1"))
    several = entities.where(F.col("with_entity") >= min_documents).select("entity", "with_entity")
    wanted = join_by(of_rows.select("_row", "entity"), "entity", several, "entity", often)
    limit = n * F.pow(F.col("with_entity") / n, F.lit(threshold)) * (1 + 1e-9)
    wanted = cut(wanted.withColumn("limit", F.greatest(limit, F.col("with_entity").cast("double"))))
    widest = wanted.groupBy("_row").agg(F.max("limit").alias("widest"))
    words = held.join(widest, "_row").select("_row", "_copy_of", "widest", F.explode(distinct_words).alias("term"))
    # groups may count several documents for a term, so only what lies below even then goes
    seldom = _common(spread).withColumnRenamed("with_term", "_often")
    words = words.join(F.broadcast(seldom), "term", "left")
    listed = words.where(F.col("_often") <= F.col("widest")).withColumnRenamed("_often", "with_term")
    others = words.where("_often is null").drop("_often").join(spread.where(F.col("with_term") >= min_documents), "term", "inner" if min_documents > 1 else "left")
    others = others.withColumn("with_term", F.coalesce("with_term", F.lit(1))).where(F.col("with_term") <= F.col("widest"))
    kept = listed.unionByName(others).select("_row", "_copy_of", "term", "with_term")
    pairs = kept.join(wanted, "_row").where(F.col("with_term") <= F.col("limit")).select("_copy_of", "entity", "with_entity", "term")
    together = pairs.groupBy("entity", "with_entity", "term", "_copy_of").agg(F.count(F.lit(1)).alias("n"))
    together = together.groupBy("entity", "with_entity", "term").agg(F.count(F.lit(1)).cast("double").alias("both")).where(F.col("both") >= min_documents)
    near = join_by(_near(held), "entity", entities.select("entity", "with_entity"), "entity", often).select("entity", "with_entity", "term", F.col("nearness").alias("both"))
    known = together.unionByName(near).groupBy("entity", "with_entity", "term").agg(F.max("both").alias("both")).join(spread, "term", "left")
    pmi = F.ln(n * F.col("both") / (F.col("with_entity") * F.coalesce("with_term", F.lit(1))))
    return known.where(pmi >= enough).groupBy("entity").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def find_spans(docs: DataFrame, threshold: float = 0.9, min_documents: int = 2) -> DataFrame:
    """``docs`` with ``_base`` (the patterns' spans) and ``_spans`` (those and the disclosing terms, which overlap no base span).

    Null text is empty and has no span; repeated rows are near copies of each other; equal ids are nothing special; other columns
    stay. Terms of one entity are at most the distinct words that occur with it in ``min_documents`` groups of copies, and those
    near it. An empty table gives an empty result.
    """
    columns = docs.columns
    based = docs.withColumn("_base", base_spans(F.col("text")))
    held = cut(based.where(F.size("_base") > 0).withColumn("_row", F.monotonically_increasing_id()))
    telling = cut(disclosing_terms(docs, cut(copy_groups(held)), threshold, min_documents))
    of_rows = cut(held.select("_row", F.explode(_entities()).alias("entity")))
    often = common(of_rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entity", "n", of_rows.count())
    of_rows = join_by(of_rows, "entity", telling, "entity", often)
    of_rows = of_rows.groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("_terms"))
    marked = held.join(of_rows, "_row", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_terms", "|"), F.lit(r")(?!\p{L})"))
    apart = lambda t: ~F.exists("_base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    added = F.transform(F.filter(_located(F.col("text"), pattern), apart), _as_span(len(PATTERNS), "term"))
    spans = F.when(F.col("_terms").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", added)))
    marked = marked.withColumn("_spans", spans).select(*columns, "_base", "_spans")
    bare = based.where(F.size("_base") == 0).withColumn("_spans", F.col("_base"))
    return marked.unionByName(bare)


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; what two spans share is replaced once."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["start"])
        grown = F.concat(acc["out"], F.substr(text, acc["at"] + 1, begin - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] <= acc["at"], acc["out"]).otherwise(grown).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sanitise(docs: DataFrame, threshold: float = 0.9, min_documents: int = 2) -> DataFrame:
    """``docs`` with values and disclosing terms generalised in ``text``; rows and other columns as they were."""
    found = find_spans(docs, threshold, min_documents)
    return found.withColumn("text", sanitised(F.col("text"), F.col("_spans"))).select(*docs.columns)
