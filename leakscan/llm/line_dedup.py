"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line goes if an earlier line of the corpus (by doc_id, then line number) is equal to it or, where
both have min_words words or more, is one word away: a word replaced, added or left out. The
variants of a line are the line itself and the line without each one of its words, as hashed keys.
Two lines of one length are one word away if they share a variant with the same word left out; two
lines whose lengths differ by one, if the longer one's variant is the shorter line; two lines that only share
a variant with different words left out are two words apart and no partners. So the earliest line
of the right kind under a key is a right partner but for collisions of the hash, and no pairs within
a key are made. Partners are compared word by word at the end; a line whose earliest one fails tries its others.

Lines are first reduced to distinct ones. Two lines one word apart share their first or their last
half of words, so only lines that share a half with another line have variants made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.llm.common import drop_saved, join_hot, release, save

#: Lines of fewer words go only if equal, as one word is much of them: any two lines of one word are one word apart. An argument; 1 compares all lines.
MIN_WORDS = 8
#: Keys with several lines up to this many are sent to each executor (about 50 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def _words(line: Column) -> Column:
    odd = [line.contains(c) for c in "\t\x0b\f\r"]
    plain = F.when(odd[0] | odd[1] | odd[2] | odd[3], F.translate(line, "\t\n\x0b\f\r", "     ")).otherwise(line)
    return F.array_remove(F.split(plain, " "), "")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _scan(a: str) -> str:
    """Inclusive running xor of a short array."""
    return f"aggregate({a}, struct(0L AS l, cast(array() AS array<bigint>) AS a), (s, v) -> struct(s.l ^ v AS l, array_append(s.a, s.l ^ v) AS a), s -> s.a)"


#: Left-out hashes of h: entry i is the xor of hash(word, place) before i and hash(word, place - 1) after i. In pieces of 256, so that a long line stays cheap.
_VARIANTS = [
    ("d", "transform(h, (v, k) -> xxhash64(v, k - 1) ^ if(k > 0, xxhash64(h[greatest(k - 1, 0)], k - 1), 0L))"),
    ("pieces", f"transform(sequence(0, (n - 1) div 256), c -> {_scan('slice(d, c * 256 + 1, 256)')})"),
    ("ends", f"concat(array(0L), {_scan('transform(pieces, p -> element_at(p, -1))')})"),
    ("left", "flatten(zip_with(pieces, slice(ends, 1, size(pieces)), (p, e) -> transform(p, v -> v ^ e)))"),
    ("after", "aggregate(transform(h, (v, k) -> xxhash64(v, k - 1)), 0L, (s, v) -> s ^ v)"),
    ("whole", "aggregate(transform(h, (v, k) -> xxhash64(v, k)), 0L, (s, v) -> s ^ v)"),
]
_KEYS = """concat(
  array(named_struct('key', xxhash64('D', whole, n), 'full', true)),
  flatten(transform(left, (v, k) -> array(
    named_struct('key', xxhash64('D', v ^ after, n - 1), 'full', false),
    named_struct('key', xxhash64('S', v ^ after, n, k), 'full', cast(NULL AS boolean))))))"""


def _one_apart(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (pos, first) whose words (pos, words) differ in one word at most."""
    pair = pairs.join(words.withColumnRenamed("words", "a"), "pos").join(words.select(F.col("pos").alias("first"), F.col("words").alias("b")), "first")
    same = "coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false), 0L) - 1, cast(size(a) AS bigint))"
    pair = pair.withColumn("head", F.expr(same.format(a="a", b="b"))).withColumn("tail", F.expr(same.format(a="reverse(a)", b="reverse(b)")))
    return pair.where("head + tail >= greatest(size(a), size(b)) - 1").select("pos", "first")


def _near(lines: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """(pos, first): distinct lines with the earliest line one word away that is earlier."""
    halves = lines.where(f"n >= {min_words}").select("pos", "e1", "e2", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("pos").alias("p"), F.max("pos").alias("q"), F.count("*").alias("times")).where("p <> q").select("half", "times")
    some = save(join_hot(halves, save(shared, "halves"), ["half"], 2 * lines.count()).select("pos", "e1", "e2").distinct(), "half-lines")
    wanted = some.groupBy(F.col("pos.doc_id").alias("doc_id")).agg(F.collect_set("pos.line_no").alias("wanted"))
    got = docs.join(wanted.hint("merge"), "doc_id").withColumn("lines", F.split("text", "\n", -1))
    # of rows of one doc_id some can be shorter
    got = got.select(F.explode(F.expr("transform(wanted, i -> get(lines, i))")).alias("line")).where("line IS NOT NULL")
    got = got.select(F.xxhash64("line").alias("e1"), F.xxhash64(F.lit(1), "line").alias("e2"), _words(F.col("line")).alias("words"))
    some = save(got.dropDuplicates(["e1", "e2"]).join(some, ["e1", "e2"]).select("pos", "words"), "half-words")
    x = some.select("pos", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.size("words").alias("n"))
    for name, e in _VARIANTS:
        x = x.withColumn(name, F.expr(e))
    x = save(x.select("pos", F.explode(F.expr(_KEYS)).alias("v")).select("pos", "v.key", "v.full"), "variants")
    keys = x.groupBy("key").agg(F.min("pos").alias("p"), F.max("pos").alias("q"), F.min(F.when(F.col("full"), F.col("pos"))).alias("f"), F.min(F.when(~F.col("full"), F.col("pos"))).alias("o"))
    # under an 'S' key (full is null) all go together; under a 'D' key the whole line goes with any variant and a variant only with the line
    keys = save(keys.where("p <> q AND (f IS NOT NULL OR o IS NULL)").drop("q"), "keys")
    few = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    first = F.when(F.col("full").isNull(), F.col("p")).when(F.col("full"), F.col("o")).otherwise(F.col("f"))
    partners = x.join(few, "key").select("pos", first.alias("first")).where("first < pos")
    best = save(partners.groupBy("pos").agg(F.min("first").alias("first")), "partners")
    good = save(_one_apart(best, some), "near")
    failed = best.join(good, "pos", "left_anti").select("pos")
    if not failed.isEmpty():
        others = _one_apart(partners.join(failed, "pos").distinct(), some)
        good = save(good.union(others.groupBy("pos").agg(F.min("first").alias("first"))), "near-others")
    drop_saved(x)
    return good


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines that go from docs (doc_id, text): doc_id, line_no (from 0), first_doc, first_line (the earlier line)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    x = _lines(docs).withColumn("words", _words(F.col("line"))).withColumn("n", F.size("words")).where("n > 0")
    x = x.withColumn("h", F.expr(f"if(n >= {min_words}, transform(words, w -> xxhash64(w)), cast(array() AS array<bigint>))"))
    half = [f"xxhash64({i}, {p}, slice(h, {s}, {p}))" for p in ("(n - 1) div 2", "n div 2") for i, s in ((0, "1"), (1, f"n - {p} + 1"))]
    x = x.withColumn("halves", F.expr(f"if(n >= {min_words}, array_distinct(array({', '.join(half)})), cast(array() AS array<bigint>))"))
    x = save(x.select(F.struct("doc_id", "line_no").alias("pos"), F.xxhash64("line").alias("e1"), F.xxhash64(F.lit(1), "line").alias("e2"), "n", "halves"), "lines", few=False)
    lines = save(x.groupBy("e1", "e2").agg(F.min("pos").alias("pos"), F.max("n").alias("n"), F.max("halves").alias("halves"), F.count("*").alias("times")), "distinct-lines")
    near = save(_near(lines, docs, min_words), "near-lines")
    release(docs.sparkSession)
    first = lines.join(near, "pos", "left").where("times > 1 OR first IS NOT NULL").select("e1", "e2", "times", F.coalesce("first", "pos").alias("first"))
    out = join_hot(x.select("pos", "e1", "e2"), save(first, "first-lines"), ["e1", "e2"], x.count()).where("first < pos")
    return out.select("pos.doc_id", "pos.line_no", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text) with the text's remaining lines: doc_id, n_lines, n_removed, text.

    min_words: lines of fewer words go only if an earlier line is equal. Blank lines stay. Null
    texts stay null with no lines; documents with a null doc_id are neither changed nor compared.
    Rows of one doc_id are one document: equal lines at equal numbers are one line, and a line
    number that goes from one row goes from each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = save(removed_lines(docs, min_words), "removed").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    x = docs.join(gone, "doc_id", "left").withColumn("lines", F.split("text", "\n", -1))
    # what stands between lines that go, so that the work grows with the number of lines
    x = x.withColumn("edges", F.expr("concat(array(-1), sort_array(filter(gone, i -> i < size(lines))), array(size(lines)))"))
    between = F.expr("flatten(transform(sequence(1, size(edges) - 1), j -> slice(lines, edges[j - 1] + 2, edges[j] - edges[j - 1] - 1)))")
    x = x.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(between))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    gone = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size("kept"))
    return x.select("doc_id", n.cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("text"))
