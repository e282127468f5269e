"""Personal data: four kinds by pattern, and terms that give protected entities away.

Everything on the main path is a DataFrame expression.

1. Email, ip, card and phone spans are found in each text (leftmost, non-overlapping in their kind; spans
   that fail their check are dropped).  Offsets are code points, ends exclusive.
2. An entity is one of its *classes*: itself, its group (an email's host, an ip's first two numbers, a
   card's first six digits, a phone's first four), its kind, and any protected entity.  A term (a word of
   letters outside the spans) *discloses* a class if knowing that a text has the term leaves little doubt
   that it holds one of the class: ``PMI(term; class) / IC(class)`` is the share of the class's
   information ``-log2 P(class)`` that the term gives, with counts of rows of the whole corpus.
3. Evidence is counted in units: for an entity itself its different texts, for wider classes its different
   entities, each in one of its texts (so that copies of one text prove nothing).  A pair of class and
   term is judged if ``support`` units or more have the term and so many come together by chance with a
   probability of at most ``chance`` (the likelihood ratio of the binomial).
4. In all texts, terms whose share is at least ``remove`` are removed and those with at least
   ``generalise`` generalised, to what is left of a word without its letters: that it is a name (it begins
   with a capital) or another word.  Both are spans of the kind ``term``.  Words inside a base span stay with it.

Two broadcasts hold hash buckets, at most ``BUCKETS`` rows whatever the input; they only thin rows out
ahead of the exact joins.

Null text: empty, no spans.  Equal texts get equal spans (rows are matched by two hashes of the text),
so null or repeated ids do no harm.  An empty table gives an empty result.  Other columns are not looked
at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brook.llm._shared import kept

# The kinds in their order, and what a reader sees in their place.
KINDS = ("email", "ip", "card", "phone", "term")
TAGS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<WORD>"}
NAME_TAG = "<NAME>"

# A match starts where its run of characters does, or where the match before it ended (\G): a start inside
# a run fails as the start of the run did.  Possessive repeats keep long runs linear.
LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,}+",  # chains of fewer digits can't pass
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LETTERS = r"\p{L}\p{M}'-"
TERM = rf"\p{{L}}[{LETTERS}]{{2,}}+"
BUCKETS = 1 << 20
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
PLACES = "array<struct<start:int,end:int,value:string>>"


def _positions(text: str, found: str, pattern: str | Column) -> Column:
    """Matches with their places: array of (start, end, value).  Texts between matches come from a split by the same pattern."""
    gaps = F.split(F.col(text), pattern if isinstance(pattern, Column) else F.lit(pattern), -1)
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.col(found), lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("n"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        return F.struct((start + x["n"]).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["m"].alias("value"))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(pieces, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(PLACES))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    double = lambda x: x * 2 - F.when(x > 4, 9).otherwise(0)
    value = lambda i: F.substring(d, i + 1, F.lit(1)).cast("int")
    worth = F.transform(F.sequence(F.lit(0), F.char_length(d) - 1), lambda i: F.when(i % 2 == 1, double(value(i))).otherwise(value(i)))
    total = F.aggregate(worth, F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.char_length(_digits(v)).between(12, 19), _luhn(v)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(v)).between(9, 15)
    return F.lit(True)


def _checked(spans: Column, kind: int) -> Column:
    valid = F.filter(spans, lambda x: _valid(KINDS[kind], x["value"]))
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def base_spans(texts: DataFrame) -> DataFrame:
    """Adds ``e``, an array of (start, kind, end, value) sorted by start and kind, to rows with a text ``t`` that isn't null."""
    base = KINDS[:4]
    keep = texts.columns
    df = texts.select(*keep, *(F.regexp_extract_all("t", F.lit(PATTERNS[k]), F.lit(0)).alias(f"f_{k}") for k in base))
    df = df.select(*keep, *(_positions("t", f"f_{k}", PATTERNS[k]).alias(f"p_{k}") for k in base))
    named = [_checked(F.col(f"p_{k}"), n) for n, k in enumerate(base)]
    return df.select(*keep, F.array_sort(F.concat(*named)).alias("e"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    return df.select("id", "t", F.xxhash64("t").alias("a"), F.xxhash64(F.lit("other"), "t").alias("b"))


def _classes(x: Column) -> Column:
    """Hashes of the classes of a span, the narrowest first."""
    number, parts = _digits(x["value"]), F.split(x["value"], r"\.")
    entity = F.when(x["kind"] >= 2, number).otherwise(F.lower(x["value"]))
    host = F.lower(F.substring_index(x["value"], "@", -1))
    group = F.when(x["kind"] == 0, host).when(x["kind"] == 1, F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).when(x["kind"] == 2, F.substring(number, 1, 6)).otherwise(F.substring(number, 1, 4))
    return F.array(F.xxhash64(F.lit("entity"), x["kind"], entity), F.xxhash64(F.lit("group"), x["kind"], group), F.xxhash64(F.lit("kind"), x["kind"]), F.xxhash64(F.lit("any")))


def _bucket(key: Column) -> Column:
    return F.pmod(key, F.lit(BUCKETS)).cast("int")


def _thinned(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows whose key's bucket is wanted: a semi join with at most BUCKETS broadcast numbers, ahead of an exact join."""
    some = wanted.select(_bucket(wanted_key).alias("_bucket")).distinct()
    return rows.withColumn("_bucket", _bucket(key)).join(F.broadcast(some), "_bucket", "left_semi").drop("_bucket")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _outside(spans: Column) -> Column:
    """What is left of the text ``t`` without its spans."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def between(acc: Column, x: Column) -> Column:
        before = F.substring(F.col("t"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.array_append(acc["out"], before).alias("out"))

    return F.aggregate(spans, zero, between, lambda acc: F.array_join(F.array_append(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.char_length("t"))), "\n"))


def _evidence(found: DataFrame, support: int) -> DataFrame:
    """(class, term, n_class, n_units, together, units) of all pairs with enough support; terms are hashes."""
    held = found.where(F.size("e") > 0).groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.first("e").alias("e"), F.first("w").alias("w"))
    held = kept(held, "held")
    spans = kept(held.select("a", "b", "m", F.explode("e").alias("x")).select("a", "b", "m", _classes(F.col("x")).alias("c")).distinct(), "entities")
    rows = spans.select("a", "b", "m", F.posexplode("c").alias("level", "class")).distinct()
    of_texts = rows.select("a", "b", "m", "class", F.when(F.col("level") == 0, 1).otherwise(0).alias("units"))
    homes = spans.groupBy("c").agg(F.min(F.struct("a", "b", "m")).alias("v")).select("v.*", F.explode(F.slice("c", F.lit(2), F.lit(3))).alias("class"), F.lit(1).alias("units"))
    by_text = kept(of_texts.union(homes).groupBy("a", "b", "class").agg(F.max("m").alias("m"), F.sum("units").alias("units")), "by_text")
    classes = by_text.groupBy("class").agg(F.sum("m").alias("n_class"), F.sum("units").alias("n_units")).where(F.col("n_units") >= support)
    known = by_text.join(kept(classes, "classes"), "class")
    listed = known.groupBy("a", "b").agg(F.collect_list(F.struct("class", "n_class", "n_units", "units")).alias("c"))
    each = held.select("a", "b", "m", "w").join(listed, ["a", "b"]).select("m", "w", F.explode("c").alias("c")).select("m", "c.*", F.explode("w").alias("term"))
    pairs = each.groupBy("class", "term").agg(F.first("n_class").alias("n_class"), F.first("n_units").alias("n_units"), F.sum("m").alias("together"), F.sum("units").alias("units"))
    return pairs.where(F.col("units") >= support)


def disclosing_terms(found: DataFrame, texts: DataFrame, support: int, chance: float, generalise: float, remove: float) -> DataFrame:
    """(term, share, removed) above the thresholds, of the class that a term tells most of; terms are hashes.

    found: a, b, e and the hashed terms w of texts with spans, one row for each of the corpus; texts: t of the whole corpus."""
    total = found.count()
    pairs = kept(_evidence(found, support), "pairs")
    counts = texts.select(F.explode(_terms(F.col("t"))).alias("term")).groupBy(F.xxhash64("term").alias("term")).agg(F.count(F.lit(1)).alias("n_term"))
    n = F.lit(float(max(total, 1)))
    information = F.greatest(F.log2(n / F.col("n_class")), F.lit(1e-9))
    share = F.log2(F.col("together") * n / (F.col("n_term") * F.col("n_class"))) / information
    expected = F.col("n_units") * F.col("n_term") / n
    without = F.col("n_units") - F.col("units")
    ratio = F.col("units") * F.log(F.col("units") / expected) + F.when(without > 0, without * F.log(without / (F.col("n_units") - expected))).otherwise(0.0)
    judged = pairs.join(counts, "term").where((F.col("units") > expected) & (ratio >= -math.log(chance))).select("term", share.alias("share"))
    return judged.groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= generalise).withColumn("removed", F.col("share") >= remove)


def _marks(found: DataFrame, texts: DataFrame, support: int, chance: float, generalise: float, remove: float) -> DataFrame | None:
    """a, b, the places p of marked terms and the removed ones, of each different text that has some."""
    terms = kept(disclosing_terms(found, texts, support, chance, generalise, remove), "terms")
    if terms.isEmpty():
        return None
    words = texts.select("a", "b", F.explode(_terms(F.col("t"))).alias("word")).withColumn("term", F.xxhash64("word"))
    held = _thinned(words, F.col("term"), terms, F.col("term")).join(terms.select("term", "removed"), "term")
    told = kept(held.groupBy("a", "b").agg(F.collect_set("word").alias("words"), F.collect_set(F.when(F.col("removed"), F.col("word"))).alias("removed")), "told")
    once = _thinned(texts.select("t", "a", "b"), F.col("a"), told, F.col("a")).dropDuplicates(["a", "b"]).join(told, ["a", "b"])
    pattern = F.concat(F.lit(rf"(?iu)(?<![{LETTERS}])(?:"), F.array_join(F.sort_array("words", asc=False), "|"), F.lit(rf")(?![{LETTERS}])"))
    once = once.withColumn("pattern", pattern).withColumn("m", F.regexp_extract_all("t", F.col("pattern"), F.lit(0)))
    return kept(once.select("a", "b", _positions("t", "m", F.col("pattern")).alias("p"), "removed"), "placed")


def _found(texts: DataFrame) -> DataFrame:
    """id, a, b, spans e, and of texts with spans the hashes w of their terms."""
    based = base_spans(texts).withColumn("e", F.col("e").cast(SPAN))
    near = F.when(F.size("e") > 0, F.transform(_terms(_outside(F.col("e"))), lambda x: F.xxhash64(x)))
    return kept(based.select("id", "a", "b", "e", near.alias("w")), "found")


def _own(e: str, p: str) -> Column:
    """Places of terms that don't touch a base span."""
    return F.filter(F.coalesce(p, F.array().cast(PLACES)), lambda x: ~F.exists(e, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))


def find_spans(docs: DataFrame, support: int = 3, chance: float = 1e-9, generalise: float = 0.8, remove: float = 0.97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_removed."""
    texts = _keyed(docs, id_col, text_col)
    found = _found(texts)
    placed = _marks(found, texts, support, chance, generalise, remove)
    spans = found.select("id", "a", "b", "e")
    spans = spans.join(placed, ["a", "b"], "left") if placed is not None else spans.select("*", F.lit(None).cast(PLACES).alias("p"), F.array().cast("array<string>").alias("removed"))
    spans = spans.select("id", "e", _own("e", "p").alias("own"), "removed")
    bare = F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    extra = F.transform("own", lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end")))
    gone = F.filter("own", lambda x: F.array_contains("removed", F.lower(x["value"])))
    spans = spans.select("id", bare.alias("base"), F.array_sort(F.concat(bare, extra)).alias("all"), F.size("own").cast("long").alias("n_term"), F.size(gone).cast("long").alias("n_removed"))
    counts = [_count(n) for n in range(4)]
    return spans.select(F.col("id").alias("doc_id"), *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"), "n_term", "n_removed")


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of ``find_spans``: what the patterns alone find."""
    spans = base_spans(_keyed(docs, id_col, text_col)).select("id", F.col("e").alias("base"))
    return spans.select(F.col("id").alias("doc_id"), *(_count(n) for n in range(4)), F.sha2(_written(F.col("base")), 256).alias("base_sha256"))


def _cleaned(text: Column, spans: Column, removed: Column) -> Column:
    """The text with tags for its spans (start, kind, end, value, sorted); overlapping spans become one."""
    tags = F.array(*(F.lit(TAGS[k]) for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        word = F.when(F.array_contains(removed, F.lower(x["value"])), "").when(x["value"].rlike(r"^\p{Lu}"), NAME_TAG).otherwise(TAGS["term"])
        tag = F.when(x["kind"] == 4, word).otherwise(F.get(tags, x["kind"]))
        before = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(before, tag))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame, support: int = 3, chance: float = 1e-9, generalise: float = 0.8, remove: float = 0.97, text_col: str = "text") -> DataFrame:
    """The input with its text cleaned: spans become tags, removed terms go.  Every other column stays as it is; null texts stay null.

    Texts without marked terms are cleaned where they lie; only the others (by their hash's bucket) are shuffled."""
    texts = _keyed(docs.select(F.col(text_col).alias("t"), F.lit(None).alias("id")), "id", "t")
    placed = _marks(_found(texts), texts, support, chance, generalise, remove)
    row = "row"
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row)
    rows = docs.select(own, F.col(text_col).cast("string").alias("t"))

    def written(df: DataFrame, spans: Column, removed: Column) -> DataFrame:
        clean = F.when(F.col("t").isNotNull(), _cleaned(F.col("t"), spans, removed))
        return df.select(*(clean.alias(c) if c == text_col else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns))

    none = F.array().cast("array<string>")
    based = lambda df: base_spans(df).withColumn("e", F.coalesce(F.col("e").cast(SPAN), F.array().cast(SPAN)))
    if placed is None:
        return written(based(rows), F.col("e"), none)
    keyed = rows.select("*", F.xxhash64(F.coalesce("t", F.lit(""))).alias("a"), F.xxhash64(F.lit("other"), F.coalesce("t", F.lit(""))).alias("b"))
    some = placed.select(_bucket(F.col("a")).alias("bucket"), F.lit(True).alias("marked")).distinct()
    keyed = keyed.withColumn("bucket", _bucket(F.col("a"))).join(F.broadcast(some), "bucket", "left")
    plain = written(based(keyed.where("marked is null").select(row, "t")), F.col("e"), none)
    told = based(keyed.where("marked").select(row, "t", "a", "b").join(placed, ["a", "b"], "left"))
    extra = F.transform(_own("e", "p"), lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
    told = told.withColumn("all", F.array_sort(F.concat("e", extra))).withColumn("gone", F.coalesce("removed", none))
    return plain.union(written(told, F.col("all"), F.col("gone")))
