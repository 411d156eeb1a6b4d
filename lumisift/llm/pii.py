"""Personal data by information-theoretic sanitisation, with built-in functions only.

Protected entities are the values of e-mail addresses, IP addresses, card and phone numbers found in the texts.
A term (a run of at least LEAST_LENGTH letters and digits, lower case) that stands anywhere in a document naming an
entity e, however rare e is, discloses it to the degree PMI(e; term) / IC(e), estimated from the whole corpus:
PMI = log2(N n_et / (n_e n_t)) and IC = log2(N / n_e), with n the numbers of documents, repeated rows included. An
entity that every document names has no IC and is disclosed by nothing. In documents that name the entity, terms from
GENERALISE up are replaced by a marker and from REMOVE up removed, wherever they stand outside entities; entities are
replaced by their kind. Other documents are left as they are.

Entities and terms are paired only where n_t lets the term reach GENERALISE with n_et = n_e, so nothing is lost, and
entities that stand in the same documents are paired once. Null text counts as empty; rows alike in doc_id and text
get the same result; other columns are ignored, or kept by sanitised().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumisift.llm.common import discard, table, written

LEAST_LENGTH = 3
GENERALISE, REMOVE = 0.7, 0.9
KINDS = ("email", "ip", "card", "phone")
_SPAN = "array<struct<kind:string,s:int,e:int,v:string>>"
# Runs are entered at their start or where the last match ended, and repeats are possessive: nothing is scanned twice.
PATTERNS = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
VALID = {
    "email": "true",
    "ip": r"forall(split(x.v, '[.]'), p -> length(regexp_replace(p, '^0+(?=[0-9])', '')) <= 3 and cast(right(p, 3) as int) <= 255)",
    "card": r"length(regexp_replace(x.v, '[^0-9]', '')) between 16 and 19 and luhn_check(regexp_replace(x.v, '[^0-9]', ''))",
    "phone": r"length(regexp_replace(x.v, '[^0-9]', '')) between 8 and 15",
}


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


HELD = 128  # spans in hand before they are put by: appending to one list would copy it for each match


def matches(text: str, pattern: str, kind: str) -> str:
    """SQL: spans, in code points, of a pattern's matches: what split() leaves gives the places of what extract gives."""
    span = f"named_struct('kind', '{kind}', 's', a.at + length(x.`1`), 'e', a.at + length(x.`1`) + length(x.`0`), 'v', x.`0`)"
    return f"""aggregate(arrays_zip(regexp_extract_all({text}, {pattern}, 0), split({text}, {pattern}, -1)),
        named_struct('at', 0, 'out', cast(array() as {_SPAN}), 'done', cast(array() as array<{_SPAN}>)),
        (a, x) -> if(x.`0` is null, a, named_struct('at', a.at + length(x.`1`) + length(x.`0`),
            'out', if(size(a.out) = {HELD}, array({span}), concat(a.out, array({span}))),
            'done', if(size(a.out) = {HELD}, concat(a.done, array(a.out)), a.done))),
        a -> concat(flatten(a.done), a.out))"""


def base_spans(text: str = "text") -> Column:
    """Spans of the four kinds, by kind as listed, then by start."""
    parts = []
    for kind in KINDS:
        quick, pattern = PATTERNS[kind]
        parts.append(f"if({text} rlike {_q(quick)}, filter({matches(text, _q(pattern), kind)}, x -> {VALID[kind]}), cast(array() as {_SPAN}))")
    return F.expr(f"concat({', '.join(parts)})")


def _entity(span: str) -> str:
    return f"concat({span}.kind, ':', case {span}.kind when 'email' then lower({span}.v) when 'ip' then {span}.v else regexp_replace({span}.v, '[^0-9]', '') end)"


_WORD, _BREAK = r"'[\\p{L}\\p{N}]+'", r"'[^\\p{L}\\p{N}]+'"
_LOWER = "lower(replace(text, 'İ', 'i'))"  # as long as the text: İ alone has two code points in lower case


def named_terms(once: DataFrame) -> DataFrame:
    """(own, term, ends): the terms of each text of once (own, text), with the places, in code points, where they end."""
    pieces = F.expr(f"arrays_zip(split({_LOWER}, {_WORD}, -1), regexp_extract_all({_LOWER}, {_WORD}, 0))")
    words = once.select("own", F.posexplode(pieces).alias("i", "x"))
    end = F.sum(F.length("x.0") + F.length("x.1")).over(W.partitionBy("own").orderBy("i"))
    placed = words.select("own", F.col("x.1").alias("term"), end.cast("int").alias("end"))
    return placed.where(F.length("term") >= LEAST_LENGTH).groupBy("own", "term").agg(F.collect_list("end").alias("ends"))


def risky_terms(docs: DataFrame, named: DataFrame, once: DataFrame) -> DataFrame | None:
    """(own, term, ends, told): terms of the documents with entities that disclose one of them from GENERALISE up.

    named has each such row (own, base), once each such text (own, text). None without entities.
    """
    held = named.select("own", F.explode(F.expr(f"array_distinct(transform(base, x -> {_entity('x')}))")).alias("entity"))
    held = written(held.groupBy("own", "entity").agg(F.count("*").alias("m")), "entities")
    # entities of the same documents have the same counts with every term: one group, known by two hashes of these
    entities = held.groupBy("entity").agg(F.sum("m").alias("n_e"), F.expr("bit_xor(xxhash64(own))").alias("a"), F.expr("bit_xor(xxhash64(own, 1))").alias("b"))
    groups = written(held.join(entities, "entity").select("own", "m", "n_e", "a", "b").distinct(), "entity-groups")
    discard(held)
    if (most := groups.agg(F.max("n_e")).first()[0]) is None:
        return None
    total = float(docs.count())
    words = docs.select(F.explode(F.expr(f"array_distinct(split({_LOWER}, {_BREAK}))")).alias("term")).where(F.length("term") >= LEAST_LENGTH)
    counts = words.groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") <= (total / most) ** -GENERALISE * total * (1 + 1e-9))
    # an entity and a term may share any number of documents: their counts are sums, and meet the documents by a join
    key = ["term", "n_e", "a", "b"]
    pairs = written(named_terms(once).join(groups.where(F.col("n_e") < total), "own"), "entity-terms")
    both = pairs.groupBy(*key).agg(F.sum("m").alias("n_et")).join(counts, "term")
    told = F.log2(F.lit(total) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log2(F.lit(total) / F.col("n_e"))
    risky = both.withColumn("told", told).where(F.col("told") >= GENERALISE).select(*key, "told")
    return pairs.select("own", "ends", *key).join(risky, key).groupBy("own", "term").agg(F.first("ends").alias("ends"), F.max("told").alias("told"))


def term_spans(docs: DataFrame, named: DataFrame) -> DataFrame:
    """named (own, text, base, ..) with `terms`: spans, outside entities, of the terms that disclose an entity the row names, their action as value."""
    once = written(named.select("own", "text", "base").dropDuplicates(["own"]), "personal-once")
    risky = risky_terms(docs, named, once)
    if risky is None:
        return named.withColumn("terms", F.expr(f"cast(array() as {_SPAN})"))
    act = F.when(F.col("told") >= REMOVE, "remove").otherwise("generalise").alias("v")
    terms = risky.select("own", F.length("term").alias("n"), F.explode("ends").alias("e"), act).select("own", (F.col("e") - F.col("n")).alias("s"), "e", "v")
    entities = once.select("own", F.explode("base").alias("x")).select("own", "x.s", "x.e", F.lit(None).cast("string").alias("v"))
    covered = F.max(F.when(F.col("v").isNull(), F.col("e"))).over(W.partitionBy("own").orderBy("s"))
    free = terms.union(entities).withColumn("covered", covered).where("v is not null and (covered is null or covered < e)")
    lists = free.groupBy("own").agg(F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), "s", "e", "v"))).alias("terms"))
    return named.join(lists, "own", "left").withColumn("terms", F.expr(f"coalesce(terms, cast(array() as {_SPAN}))"))


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without personal data (doc_id), and those with it (doc_id, own, text, base, terms)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = rows.withColumn("base", base_spans())
    some = F.size("base") > 0
    kept = written(spans.select("doc_id", "base", F.when(some, F.col("text")).alias("text"), F.when(some, F.xxhash64("doc_id", "text")).alias("own")), "personal")
    named = kept.where("text is not null").select("doc_id", "own", "text", "base")
    return kept.where("text is null").select("doc_id"), term_spans(rows, named)


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) of every row of docs."""
    clean, named = find(docs)
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    told = named.select("doc_id", *counts, F.size("terms").cast("long").alias("n_term"), F.expr(f"sha2({_joined('base')}, 256)").alias("base_sha256"), F.expr(_joined("concat(base, terms)")).alias("spans"))
    none = clean.select("doc_id", *[F.lit(0).cast("long").alias(f"n_{k}") for k in (*KINDS, "term")], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return told.unionByName(none)


def _redacted() -> str:
    """SQL: the text with its spans replaced, from _wide, the text at four bytes a character, so that a place is reached at once."""
    label = "encode(case when x.v = 'remove' and x.kind = 'term' then '' when x.kind = 'term' then '<TERM>' else concat('<', upper(x.kind), '>') end, 'UTF-32')"
    piece = f"concat(substring(_wide, 4 * a.at + 1, 4 * greatest(x.s - a.at, 0)), if(x.s >= a.at, {label}, x''))"
    none, long = "cast(array() as array<binary>)", f"size(a.out) = {HELD}"
    return f"""decode(aggregate(array_sort(concat(base, terms), (l, r) -> case when l.s != r.s then l.s - r.s else r.e - l.e end),
        named_struct('at', 0, 'out', {none}, 'done', {none}),
        (a, x) -> if(x.e <= a.at, a, named_struct('at', x.e, 'out', if({long}, array({piece}), concat(a.out, array({piece}))),
            'done', if({long}, concat(a.done, array(aggregate(a.out, x'', (l, r) -> concat(l, r)))), a.done))),
        a -> concat(aggregate(concat(a.done, a.out), x'', (l, r) -> concat(l, r)), substring(_wide, 4 * a.at + 1))), 'UTF-32')"""


def sanitised(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with entities and disclosing terms replaced or removed in `text`."""
    cols = docs.columns
    base = F.when(F.col("text").isNull(), F.expr(f"cast(array() as {_SPAN})")).otherwise(base_spans("cast(text as string)"))
    row = docs.select(F.struct(*[F.col(c) for c in cols]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), base.alias("base"))
    named = written(row.where(F.size("base") > 0).withColumn("own", F.xxhash64("doc_id", "text")), "personal")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = term_spans(every, named).withColumn("_wide", F.encode("text", "UTF-32"))
    changed = found.withColumn("_text", F.expr(_redacted())).select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.{c}") for c in cols])
    return changed.unionByName(row.where(F.size("base") == 0).select("_row.*"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
