"""Spelling variants: words one edit apart, by a self-join of the vocabulary's trie with active-node sets.

The trie is partitioned by prefix. Two words of at least LEAST code points that are one inserted, deleted or
replaced code point apart share their first START code points or their last START, so one trie
of the words and one of the reversed words, each cut at depth START, hold every pair inside a
partition; the second one reports only pairs with different first START code points. A partition's root has only itself
as active node. A partition of more than CROWD words is cut one level deeper until none is: the
pairs that differ right at its root have one edit behind them, so what follows must be equal, and an
equality join on the rest of the words finds them; all others stay together below. In a partition
a sweep in preorder keeps the active nodes of the path: a node at distance 0, itself, and those
at distance 1, which are made of its parent's; terminal nodes at distance 1 of a terminal are the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm.common import drop_saved, lean, save

#: Least code points of a word, least occurrences, and how much more frequent a form must be.
LEAST, COUNT, FACTOR = 6, 5, 5
#: Depth of the first cut, half of what the shortest words share at least; words of a partition that isn't cut deeper.
START, CROWD = 3, 5000
#: Crowded prefixes up to this many are sent to each executor; more, of CROWD times as many words, are joined by a shuffle.
FEW = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """Every run of letters of docs (doc_id, text), A-Z lower-cased: doc_id, run."""
    low = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.split(low, "[^a-zÀ-ÿ]+", -1)).alias("run"))
    return x.where("run <> ''")


def slipped(x: DataFrame, every: int = 199) -> DataFrame:
    """runs (doc_id, run) as words, with a code point left out where every divides the crc32 of '<doc_id>:<run>' (a null doc_id: ':<run>')."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    word = F.when(h % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return x.select(word.alias("word"))


def vocabulary(words: DataFrame, least: int = LEAST, count: int = COUNT) -> DataFrame:
    """Distinct words of least code points or more that occur count times or more: word, n."""
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


class _Trie:
    """Rests of a partition's words below its prefix, in order."""

    def __init__(self, rests: list[str]):
        self.kids: list[dict] = [{}]
        self.word: list[int] = [-1]
        self.up: list[int] = [-1]
        for i, r in enumerate(rests):
            node = 0
            for c in r:
                nxt = self.kids[node].get(c)
                if nxt is None:
                    nxt = len(self.kids)
                    self.kids[node][c] = nxt
                    self.kids.append({})
                    self.word.append(-1)
                    self.up.append(node)
                node = nxt
            self.word[node] = i

    def near(self) -> Iterator[tuple[int, list[int]]]:
        """Each word with those one edit apart."""
        kids, word, up = self.kids, self.word, self.up
        # (node, its character, active nodes at distance 1 of its parent)
        stack: list = [(0, "", set())]
        while stack:
            node, c, before = stack.pop()
            own = set(kids[node].values())
            if node:
                parent = up[node]
                own.add(parent)
                own.update(kids[parent].values())
                own.update([k[c] for k in map(kids.__getitem__, before) if c in k])
                own.discard(node)
            if word[node] >= 0:
                found = [word[v] for v in own if word[v] >= 0]
                if found:
                    yield word[node], found
            stack.extend((k, x, own) for x, k in kids[node].items())


#: A word's near words in a part of the trie: their number, and the one of largest n (less is -n; ties by code points).
_NEAR = "word string, n_near long, best struct<less: bigint, word: string>"


def _join(backwards: bool, start: int):
    def group(words: list[str], counts: list[int], depth: int) -> list[dict]:
        trie, out = _Trie([(w[::-1] if backwards else w)[depth:] for w in words]), []
        for i, found in trie.near():
            if backwards:
                found = [j for j in found if words[j][:start] != words[i][:start]]
            if found:
                less, word = min((-counts[j], words[j]) for j in found)
                out.append({"word": words[i], "n_near": len(found), "best": {"less": less, "word": word}})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("less", pa.int64()), ("word", pa.string())]))])
        last, words, counts, out = None, [], [], []
        for b in batches:
            for prefix, word, n in zip(b.column("prefix").to_pylist(), b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                if prefix != last:
                    if len(words) > 1:
                        out += group(words, counts, len(last))
                    last, words, counts = prefix, [], []
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                words.append(word)
                counts.append(n)
        if len(words) > 1:
            out += group(words, counts, len(last))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _crowded(x: DataFrame, backwards: bool, start: int) -> DataFrame:
    """Pairs (word, other, m) of crowded partitions (prefix, rest, word, n) that differ right after the prefix."""
    cut = x.where("rest <> ''").select("prefix", F.expr("substring(rest, 2)").alias("rest"), F.col("word").alias("a"), F.col("n").alias("p"), F.substring("rest", 1, 1).alias("lost"))
    # words with one key differ in that code point only, so they are few
    other = cut.select("prefix", "rest", F.col("a").alias("b"), F.col("p").alias("q"))
    pairs = cut.join(other, ["prefix", "rest"]).where("a <> b").select("a", "b", "q")
    # a word that is another one without that code point; if both go on alike, the pair is found below
    shorter = x.select("prefix", "rest", F.col("word").alias("b"), F.col("n").alias("q"))
    both = cut.join(shorter, ["prefix", "rest"]).where(F.col("lost") != F.substring("rest", 1, 1))
    pairs = pairs.unionAll(both.select("a", "b", "q")).unionAll(both.select("b", "a", "p"))
    if backwards:
        pairs = pairs.where(F.substring("a", 1, start) != F.substring("b", 1, start))
    return pairs.toDF("word", "other", "m")


#: Code points that two strings begin with alike.
_ALIKE = "aggregate(sequence(1, least(char_length(lo), char_length(hi)) + 1), 0, (s, i) -> if(s = i - 1 AND i <= least(char_length(lo), char_length(hi)) AND substring(lo, 1, i) = substring(hi, 1, i), i, s))"


def _one_way(words: DataFrame, backwards: bool, start: int, crowd: int) -> DataFrame:
    """Near words within the partitions of one trie, in parts that add up (_NEAR)."""
    turned = F.reverse("word") if backwards else F.col("word")
    x = words.select("word", "n", F.substring(turned, 1, start).alias("prefix"), F.substring(turned, F.lit(start + 1), F.char_length("word")).alias("rest"))
    calm, pairs = None, []
    while True:
        sizes = x.groupBy("prefix").agg(F.count("*").alias("size"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        # one for every crowd words at most
        full = save(sizes.where(F.col("size") > crowd).select("prefix", F.expr(_ALIKE).alias("skip")), "full-prefixes")
        many = full.count()
        full = F.broadcast(full) if many <= FEW else full
        rest = x.join(full, "prefix", "left_anti") if many else x
        calm = rest if calm is None else calm.unionByName(rest)
        if not many:
            break
        deeper = F.substring("rest", F.lit(1), F.col("skip")), F.substring(F.col("rest"), F.col("skip") + 1, F.char_length("rest"))
        hot = save(x.join(full, "prefix").select("word", "n", F.concat("prefix", deeper[0]).alias("prefix"), deeper[1].alias("rest")), "crowded")
        pairs.append(_crowded(hot, backwards, start))
        # a word that ends at the prefix has no pairs below
        x = hot.where("rest <> ''").select("word", "n", F.concat("prefix", F.substring("rest", 1, 1)).alias("prefix"), F.expr("substring(rest, 2)").alias("rest"))
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = calm.select("prefix", "word", "n").repartition(tasks, "prefix").sortWithinPartitions("prefix", "word")
    out = dealt.mapInArrow(lean(_join(backwards, start)), _NEAR)
    for p in pairs:
        out = out.unionAll(p.select("word", F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("m")).alias("less"), F.col("other").alias("word")).alias("best")))
    return out


def near_words(words: DataFrame, least: int = LEAST, crowd: int = CROWD) -> DataFrame:
    """Distinct words (word, n) of least code points or more with others one edit apart: word, n_near, best, best_n."""
    start = min(START, least // 2)
    both = _one_way(words, False, start, crowd).unionAll(_one_way(words, True, start, crowd))
    x = both.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return x.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) without cycles: word, root, by jumps that double."""
    x = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = x.select(F.col("word").alias("root"), F.col("root").alias("next"))
        y = save(x.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_saved(x)
        more = not y.where("moved").isEmpty()
        x = y.select("word", "root")
        if not more:
            return x


def variants(docs: DataFrame, every: int = 199, least: int = LEAST, count: int = COUNT, factor: int = FACTOR, crowd: int = CROWD) -> DataFrame:
    """Words of docs (doc_id, text) with their forms: word, form, root, n, n_near, form_n.

    Words are lower-cased runs of letters with a slip in one of every (slipped). Null and empty texts have no
    words; rows of one doc_id count each. form is the near word of largest n (ties: the smallest in code-point
    order) if that is factor times the word's n at least; root is where the forms from a word on end.
    """
    words = save(vocabulary(slipped(runs(docs), every), least, count), "vocabulary")
    near = save(near_words(words, least, crowd), "near")
    x = words.join(near, "word", "left")
    x = x.withColumn("form", F.when(F.col("best_n") >= factor * F.col("n"), F.col("best")))
    x = save(x.select("word", "form", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "forms")
    ends = roots(x.where("form IS NOT NULL").select("word", "form"))
    return x.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
