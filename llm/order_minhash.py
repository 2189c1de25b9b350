"""Order MinHash fingerprints of documents. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.shared import stored

#: Words of a k-mer.
KMER = 3
#: Tuples of a fingerprint; a k-mer's hash says which tuple it competes for.
TUPLES = 64
#: Minimal k-mers of a tuple.
TUPLE = 2
#: K-mers kept per tuple before the minimal ones are taken; with fewer left than needed, all are looked at.
KEPT = 12

#: A k-mer is one bigint: hash above, position in the text below.
_POSITION_BITS = 24
_TUPLE_BITS = 6


def _packed(value: Column, position: Column) -> Column:
    top = (1 << _POSITION_BITS) - 1
    return value.bitwiseAND(F.lit(~top)).bitwiseOR(F.least(position.cast("long"), F.lit(top)))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, _POSITION_BITS)


def _position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))


def _tuple(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 64 - _TUPLE_BITS)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as array ``name``; each step is computed once a row.

    K-mers of words are numbered by occurrence: the first keeps its hash, the n-th of an equal k-mer gets
    a hash of it and n. The hash's upper bits choose one of TUPLES tuples; the TUPLE least in each are
    brought into text order and hashed. An entry is (tuple, 32 bits) as one bigint, so that fingerprints of
    any length compare entry by entry. A text of fewer words than a k-mer is one k-mer, without words none.
    """
    keep = [c for c in df.columns if c != name]
    df = df.withColumn("h_", F.transform(
        F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    n = F.size("h_")
    several = F.transform(
        F.sequence(F.lit(0), F.greatest(n - KMER, F.lit(0))),
        lambda i: _packed(F.xxhash64(*(F.get("h_", i + j) for j in range(KMER))), i))
    one = F.array(_packed(F.xxhash64(*(F.get("h_", F.lit(j)) for j in range(KMER))), F.lit(0)))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("s_", F.sort_array(F.when(n >= KMER, several).when(n > 0, one).otherwise(none)))

    again = lambda x, i: (i > 0) & (_hash(F.get("s_", i - 1)) == _hash(x))
    df = df.withColumn("first_", F.filter("s_", lambda x, i: ~again(x, i)))
    df = df.withColumn("start_", F.when(
        F.size("first_") < F.size("s_"),
        F.filter(F.sequence(F.lit(0), F.size("s_") - 1), lambda i: ~again(F.get("s_", i), i)),
    ).otherwise(F.array().cast("array<int>")))
    runs = F.filter(
        F.zip_with("start_", F.slice("start_", 2, F.greatest(F.size("start_"), F.lit(1))),
                   lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.size("s_")).alias("b"))),
        lambda r: r["b"] - r["a"] > 1)
    repeats = F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(r["a"] + 1, r["b"] - 1),
        lambda i: _packed(F.xxhash64(_hash(F.get("s_", i)), i - r["a"]), _position(F.get("s_", i))))))
    df = df.withColumn("k_", F.concat("first_", repeats))

    share = F.lit(KEPT * TUPLES) / F.greatest(F.size("k_"), F.lit(KEPT * TUPLES))
    below = F.floor(share * (1 << 32)).cast("long")
    inner = lambda x: F.shiftrightunsigned(F.shiftleft(x, _TUPLE_BITS), 32)
    df = df.withColumn("low_", below).withColumn("few_", F.sort_array(F.filter("k_", lambda x: inner(x) < F.col("low_"))))

    def least(kmers: Column) -> Column:
        behind = F.concat(F.array_repeat(F.lit(None).cast("long"), TUPLE), kmers)
        marked = F.zip_with(kmers, F.slice(behind, 1, F.greatest(F.size(kmers), F.lit(1))), lambda x, y: F.when(
            y.isNull() | (_tuple(x) != _tuple(y)), x))
        return F.filter(marked, lambda x: x.isNotNull())

    df = df.withColumn("m_", least(F.col("few_")))
    enough = (F.size("m_") == TUPLES * TUPLE) | (F.size("few_") == F.size("k_"))
    df = df.withColumn("m_", F.when(enough, F.col("m_")).otherwise(least(F.sort_array("k_"))))

    def entry(x: Column, i: Column) -> Column:
        """At the first k-mer of a tuple: the tuple's number and the hash of its members in text order."""
        starts = (i == 0) | (_tuple(F.get("m_", i - 1)) != _tuple(x))
        after = F.get("m_", i + 1)
        alone = after.isNull() | (_tuple(after) != _tuple(x))
        forward = _position(x) <= _position(after)
        value = F.when(alone, F.xxhash64(_hash(x))).when(
            forward, F.xxhash64(_hash(x), _hash(after))).otherwise(F.xxhash64(_hash(after), _hash(x)))
        return F.when(starts, F.shiftleft(_tuple(x), 32).bitwiseOR(F.shiftrightunsigned(value, 32)))

    entries = F.filter(F.transform("m_", entry), lambda x: x.isNotNull())
    return df.withColumn(name, F.sort_array(entries)).select(*keep, name)


def as_text(fingerprint: Column) -> Column:
    """Ten hex digits per entry, in order of the tuples."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of tuples that agree, to the power 1 / TUPLE (the scale of shared k-mers)."""
    tuples = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    same = F.size(F.array_intersect(a, b))
    return F.when(tuples == 0, 1.0).otherwise(F.pow(same / tuples, F.lit(1 / TUPLE)))


def _narrow(fingerprint: Column) -> Column:
    """A fingerprint for the way: tuple numbers, which compress, apart from the 32 bits of each."""
    return F.struct(
        F.transform(fingerprint, lambda x: F.shiftright(x, 32).cast("tinyint")).alias("tuples"),
        F.transform(fingerprint, lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")).alias("values"))


def _wide(narrow: str) -> Column:
    return F.zip_with(f"{narrow}.tuples", f"{narrow}.values", lambda t, v: F.shiftleft(t.cast("long"), 32).bitwiseOR(
        v.cast("long").bitwiseAND(F.lit((1 << 32) - 1))))


def _chain(keys: DataFrame) -> DataFrame:
    """For every (doc_id, text_hash): the next one by falling doc_id, and the first after the last.

    Keys are dealt by range and stored, so that a task holds a stretch of the order; the stretches' ends meet
    through one row for each partition.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("text_hash")]
    dealt = stored(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    key = F.struct("doc_id", "text_hash")
    linked = dealt.withColumn("next", F.lead(key).over(inside)).withColumn("nth", F.row_number().over(inside))
    ends = linked.where("nth = 1").select("part", key.alias("head"))
    parts = Window.orderBy("part")  # one row per partition
    around = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = ends.select("part", F.coalesce(F.lead("head").over(parts), F.first("head").over(around)).alias("after"))
    return linked.join(F.broadcast(heads), "part").select(
        "doc_id", "text_hash", "half", F.coalesce("next", "after").alias("next")).select(
        "doc_id", "text_hash", "half", F.col("next.doc_id").alias("next_id"), F.col("next.text_hash").alias("next_hash"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    ``docs`` has doc_id and text. A document's edited text is its own without the last half of its
    characters, then as many of the next document's first. Two shuffles carry text: one by key, where a
    document learns for whom it is the next, one with halves only. Keys are unique, so no task gets more
    than its share; only lengths, ids and one row per partition go anywhere else.

    Null text is empty; without a k-mer two texts are alike (1). Null doc_ids come last; rows of one
    doc_id follow the hash of their text, and wholly equal rows are one document whose result each of them
    gets; a single document is its own next. Further columns are ignored; no rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    chain = stored(_chain(read.select("doc_id", "text_hash", half.alias("half")).distinct()))
    before = chain.select(
        F.col("next_id").alias("doc_id"), F.col("next_hash").alias("text_hash"),
        F.struct(F.col("doc_id"), F.col("text_hash"), F.col("half")).alias("before"))

    # a null id joins as a flag and a number, so that the join stays one by plain keys
    keyed = lambda df: df.withColumn("id_", F.coalesce("doc_id", F.lit(0))).withColumn("null_", F.isnull("doc_id"))
    own = keyed(read).join(keyed(before).drop("doc_id"), ["id_", "null_", "text_hash"])
    own = with_fingerprint(own, "text", "print")
    # a row goes once to its own key and once to the key of the document before it
    own = own.withColumn("print", _narrow(F.col("print")))
    narrow = own.schema["print"].dataType
    kept = F.struct(
        "id_", "null_", "text_hash", F.lit(1).alias("copy"), F.char_length("text").cast("long").alias("n_chars"), "print",
        F.lit(None).cast(narrow).alias("next_print"),
        F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))").alias("kept"),
        F.lit(None).cast("string").alias("given"))
    given = F.struct(
        F.coalesce("before.doc_id", F.lit(0)).alias("id_"), F.isnull("before.doc_id").alias("null_"),
        F.col("before.text_hash").alias("text_hash"), F.lit(None).cast("int").alias("copy"), F.lit(None).cast("long").alias("n_chars"),
        F.lit(None).cast(narrow).alias("print"), F.col("print").alias("next_print"),
        F.lit(None).cast("string").alias("kept"), F.expr("left(text, before.half)").alias("given"))
    sent = own.select(F.explode(F.array(kept, given)).alias("part")).select("part.*")
    both = sent.groupBy("id_", "null_", "text_hash").agg(
        F.count("copy").cast("int").alias("copies"), *(F.max(c).alias(c) for c in ("n_chars", "print", "next_print", "kept", "given")))
    both = both.select(
        F.when(~F.col("null_"), F.col("id_")).alias("doc_id"), "n_chars", _wide("print").alias("print"), _wide("next_print").alias("next_print"), "copies",
        F.concat("kept", "given").alias("edited"))
    both = with_fingerprint(both, "edited", "edited_print")
    return both.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))
