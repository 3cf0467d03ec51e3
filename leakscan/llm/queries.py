"""The queries opN_<name> over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from leakscan.llm import decontaminate, embedding_dedup, exact_substrings, line_dedup, mixing, near_dedup, prefix_trie, quality, sharding, spelling, token_output, url_filter, word_table
from leakscan.llm.common import lean, table


def op1_decontaminate(spark, sf_dir):
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op3_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def tokenizer_path() -> str:
    """The byte-level tokenizer's file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_output(spark, sf_dir):
    return token_output.token_table(token_output.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_line_dedup(spark, sf_dir):
    x = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_words=1)
    return x.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op6_shard(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"), 8)


def op7_exact_substrings(spark, sf_dir):
    x = exact_substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark, sf_dir):
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def word_tokenizer_path() -> str:
    """The tokenizer of words, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each row's ids as little-endian 32-bit integers."""
    for b in batches:
        lists = b.column("ids")
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
        own = [hashlib.sha256(flat[i:j]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array((ends[1:] - ends[:-1]).astype("int64")), pa.array(own, pa.string()), b.column("decoded_sha256")], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op11_word_bpe(spark, sf_dir):
    x = word_table.decode(word_table.encode(table(spark, sf_dir, "documents"), word_tokenizer_path()), word_tokenizer_path())
    x = x.select("doc_id", "ids", F.sha2("text", 256).alias("decoded_sha256"))
    return x.mapInArrow(lean(_id_digests), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), family=5, most=9)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_url_filter,
        op3_near_dedup,
        op4_token_output,
        op5_line_dedup,
        op6_shard,
        op7_exact_substrings,
        op8_mix,
        op9_quality,
        op10_embedding_dedup,
        op11_word_bpe,
        op12_spelling,
        op13_prefix_trie,
    )
}

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


def _shingles(name: str, source: str, key: str, k: int) -> str:
    return f"""
{name}_w AS (SELECT {key}, {_WORDS} AS w FROM {source} WHERE text IS NOT NULL),
{name} AS (SELECT DISTINCT {key}, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {k - 1}], ' ') END AS s
  FROM {name}_w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS r(i) WHERE len(w) > 0)"""


_COMPONENTS = """
walk AS (SELECT a AS x, b AS y FROM links UNION SELECT w.x, l.b FROM walk w JOIN links l ON l.a = w.y),
comp AS (SELECT x, min(least(x, y)) AS c FROM walk GROUP BY x)"""



def _crc32_steps(bits: int) -> list[int]:
    """What so many low bits of a CRC-32 become."""
    out = []
    for c in range(1 << bits):
        for _ in range(bits):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: The crc32 of the bytes that a column hx has in hexadecimal: digit by digit, the lower one of a byte first.
_CRC32 = f"""xor(list_reduce(list_concat([4294967295::BIGINT], [CAST(instr('123456789ABCDEF', hx[j + CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END]) AS BIGINT) FOR j IN range(1, strlen(hx) + 1)]),
  lambda c, v: xor(c >> 4, {_crc32_steps(4)}[(xor(c, v) & 15) + 1])), 4294967295)"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)

SQL = {
    "op1_decontaminate": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[j:j + least(len(w), 5) - 1], ' ') AS s FROM i, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(j) WHERE len(w) > 0),
t AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM t, (SELECT DISTINCT k FROM b), unnest(range(1, len(w) - k + 2)) AS r(j)),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM d JOIN b USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item""",
    "op2_url_filter": f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES {_RULES})
SELECT page_id, host, path, arg_max(rh || rp, strlen(rh || rp)) AS rule, coalesce(arg_max(v, strlen(rh || rp)), '{url_filter.DEFAULT}') AS verdict
FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path""",
    "op3_near_dedup": f"""WITH RECURSIVE {_shingles('d', 'documents', 'doc_id', 4)},
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM d x JOIN d y USING (s) JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))), {_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON x = doc_id""",
    "op5_line_dedup": """WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS line, {'d': doc_id, 'l': i - 1} AS pos, regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+') AS w FROM t, unnest(range(1, len(lines) + 1)) AS r(i)),
x AS MATERIALIZED (SELECT line, any_value(w) AS w, min(pos) AS pos FROM l WHERE len(w) > 0 GROUP BY line),
v AS MATERIALIZED (SELECT pos, array_to_string(w, ' ') AS key, -1 AS k, len(w) AS n FROM x
  UNION ALL SELECT pos, array_to_string(list_concat(w[:k - 1], w[k + 1:]), ' '), k, len(w) FROM x, unnest(range(1, len(w) + 1)) AS r(k)),
same AS (SELECT key, k, n, min(pos) AS p FROM v GROUP BY key, k, n HAVING count(*) > 1),
apart AS (SELECT key, min(pos) FILTER (k < 0) AS whole, min(pos) FILTER (k > 0) AS variant FROM v GROUP BY key HAVING bool_or(k < 0) AND bool_or(k > 0)),
near AS (SELECT pos FROM v JOIN same USING (key, k, n) WHERE p < pos UNION SELECT pos FROM v JOIN apart USING (key) WHERE CASE WHEN k < 0 THEN variant ELSE whole END < pos),
g AS (SELECT l.doc_id, l.line_no FROM l JOIN x USING (line) LEFT JOIN near ON near.pos = x.pos WHERE l.pos > x.pos OR near.pos IS NOT NULL),
o AS (SELECT t.doc_id, list(line_no) AS gone FROM t JOIN g USING (doc_id) GROUP BY t.doc_id)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  md5(array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT coalesce(list_contains(gone, i - 1), false)], chr(10))) AS kept_md5 FROM t LEFT JOIN o USING (doc_id)""",
    "op7_exact_substrings": f"""WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, b, substr(h, 2 * b + 1, 2 * (1000 + {exact_substrings.MIN} - 1)) AS s FROM d, unnest(range(0, strlen(h) // 2, 1000)) AS r(b)),
w AS MATERIALIZED (SELECT doc_id, b + j AS i, unhex(substr(s, 2 * j + 1, 2 * {exact_substrings.MIN})) AS s FROM p, unnest(range(0, least(1000, strlen(s) // 2 - {exact_substrings.MIN} + 1))) AS r(j)),
f AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
e AS (SELECT doc_id, i, i > lag(i) OVER o + {exact_substrings.MIN} AS new FROM w JOIN f USING (s) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count_if(coalesce(new, true)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
a AS (SELECT doc_id, span, min(i) AS s, max(i) + {exact_substrings.MIN} AS t FROM c GROUP BY doc_id, span),
k AS (SELECT doc_id, sum(t - s) AS n_removed, count(*) AS n_spans, list({{'s': s, 't': t}} ORDER BY s) AS spans FROM a GROUP BY doc_id)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE array_to_string([substr(h, 2 * CASE WHEN x = 1 THEN 0 ELSE spans[x - 1].t END + 1, 2 * (coalesce(spans[x].s, strlen(h) // 2) - CASE WHEN x = 1 THEN 0 ELSE spans[x - 1].t END)) FOR x IN range(1, len(spans) + 2)], '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op10_embedding_dedup": f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
u AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_dot_product(x.e, y.e) >= 0.9 * x.norm * y.norm), {_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN comp ON x = vec_id""",
    "op12_spelling": f"""WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT run, count(*) AS c, hex(encode(id || ':' || run)) AS hx FROM d GROUP BY id, run),
h AS (SELECT run, c, {_CRC32} AS h FROM g),
v AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
e AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS r(i)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM e a JOIN e b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT e.word, v.word, v.n FROM e JOIN v ON rest = v.word UNION SELECT v.word, e.word, e.n FROM e JOIN v ON rest = v.word),
near AS (SELECT word, count(*) AS n_near, min({{'less': -m, 'word': other}}) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * n THEN best.word END AS form, CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n FROM v LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = root WHERE form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN f ON f.word = root WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)""",
    "op13_prefix_trie": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT conv_id, md5(length(role) || ':' || role || text) AS told, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS p FROM t),
n AS (SELECT conv_id, conv_id - conv_id % 5 AS s, max(p) AS n, hex(encode(CAST(conv_id AS VARCHAR))) AS hx FROM o GROUP BY conv_id),
c AS MATERIALIZED (SELECT conv_id, s, n, {_CRC32} % 9 AS h FROM n),
k AS MATERIALIZED (SELECT c.*, least(h, coalesce(x.n, 0)) AS taken FROM c LEFT JOIN (SELECT conv_id AS s, n FROM c) x USING (s)),
b AS (SELECT conv_id, p - h + taken AS d, told, size FROM o JOIN k USING (conv_id) WHERE p > h
  UNION ALL SELECT k.conv_id, p, told, size FROM o JOIN k ON o.conv_id = s WHERE p <= h),
q AS MATERIALIZED (SELECT conv_id, d, size, list(told) OVER (PARTITION BY conv_id ORDER BY d) AS key FROM b UNION ALL SELECT conv_id, 0, 0, [] FROM k),
l AS (SELECT conv_id, max(d) AS len FROM q GROUP BY conv_id),
node AS MATERIALIZED (SELECT key, any_value(d) AS d, min(conv_id) AS owner, count(*) AS n_convs, max(size) AS size, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len) AS ends FROM q JOIN l USING (conv_id) GROUP BY key),
kids AS (SELECT key[1:d - 1] AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
a AS MATERIALIZED (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
below AS (SELECT key[1:e] AS key, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM a, unnest(range(0, d + 1)) AS r(e) GROUP BY 1)
SELECT a.owner AS conv_id, a.d AS depth, up.owner AS parent_conv_id, a.n_convs, n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM a JOIN below USING (key) LEFT JOIN node up ON a.d > 0 AND up.key = a.key[1:a.d - 1]""",
    "op8_mix": f"""WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS most FROM g),
f AS (SELECT *, coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS whole FROM w
  WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / w, source NULLS LAST)),
l AS (SELECT *, (CAST(whole AS DOUBLE) * 1.5 - before) / open AS own FROM f),
t AS (SELECT source, source_size, coalesce(least(w * (SELECT arg_min(own, CAST(most AS DOUBLE) / w) FROM l WHERE own * w <= most), CAST(most AS DOUBLE)), most) AS target FROM l),
c AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run,
  CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (rounds + CASE WHEN rounds < 2 AND run + size / 2 <= target - rounds * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""",
}
