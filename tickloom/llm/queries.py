"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, embedding_dedup, exact_dedup, fill_middle, hilbert_shards, jaccard_join, line_dedup, matroska, packing, sentencepiece_codec, suffix_dedup, toxicity, warc_fixity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _public("piece_bpe_32k.model")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.octet_length("text").cast("long").alias("text_bytes"), "text_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _public("word_bpe_49k.json"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("kept", "text")


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the archive of all pages against a replica in which every 97th page id has its angle brackets damaged."""
    pages = _table(spark, sf_dir, "pages")
    damaged = F.when(F.pmod("page_id", F.lit(97)) == 0, F.translate("html", "<", "#")).otherwise(F.col("html"))
    return warc_fixity.audit(warc_fixity.archived(pages), warc_fixity.archived(pages, damaged))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_frequent_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(_table(spark, sf_dir, "documents"))


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.store(_table(spark, sf_dir, "documents")))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.owners(_table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.rearrange(_table(spark, sf_dir, "documents")).drop("suffix")
    digests = [F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256")]
    back = fill_middle.restore(made.select("doc_id", "n", "form", *digests, "output"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("text", 256).alias("restored_sha256"))


_OP5 = """
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 4096.0) AS BIGINT) AS archive,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
      || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
      || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) AS head,
    html, CASE WHEN page_id % 97 = 0 THEN replace(html, '<', '#') ELSE html END AS harm, chr(13) || chr(10) || chr(13) || chr(10) AS tail
  FROM pages),
d AS (
  SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY page_id) - 1 AS seq, page_id,
    CAST(octet_length(encode(head || html || tail)) AS BIGINT) AS length, sha256(head || html || tail) AS digest, sha256(head || harm || tail) AS replica_digest
  FROM r)
SELECT archive, seq, page_id,
  CAST(coalesce(sum(length) OVER (PARTITION BY archive ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length, digest, replica_digest, bool_and(digest = replica_digest) OVER (PARTITION BY archive) AS archive_intact, digest = replica_digest AS intact
FROM d
"""

_OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""

_OP6 = r"""
WITH lines AS (
  SELECT doc_id, line, pos FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN hot h ON k.key = h.key GROUP BY k.doc_id
"""


_OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, w[i:i + m - 1] AS p FROM w, range(1, 4) a(m), range(1, len(w) - m + 2) b(i)),
f AS (SELECT lang, m, p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.m, c.p, c.f AS a, k, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f x ON c.lang = x.lang AND x.p = c.p[1:k] JOIN f y ON c.lang = y.lang AND y.p = c.p[k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
gone AS (
  SELECT DISTINCT s.lang, s.p FROM f s JOIN (SELECT lang, f, unnest([p[1:2], p[2:3]]) AS q FROM f WHERE m = 3) t ON s.lang = t.lang AND s.p = t.q
  WHERE s.m = 2 AND 100 * t.f >= 50 * s.f),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.p, ' ')) AS rank, array_to_string(b.p, ' ') AS phrase, a, l, r, n.n, score
  FROM best b ANTI JOIN gone ON b.lang = gone.lang AND b.p = gone.p JOIN n ON n.lang = b.lang)
SELECT * FROM ranked WHERE rank <= 2000
"""

_OP12 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS key FROM documents),
o AS (SELECT *, first_value(doc_id) OVER (PARTITION BY key ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY key) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(key) AS text_sha256 FROM o
"""

_OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
h AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS x FROM t),
c AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS lo, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_packing, op3_hilbert_shards, op4_suffix_dedup, op5_warc_fixity, op6_line_runs, op7_toxicity, op8_jaccard_join, op9_matroska, op10_multi_index, op11_collocations, op12_exact_dedup, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_fixity": _OP5, "op6_line_runs": _OP6, "op10_multi_index": _OP10, "op11_collocations": _OP11, "op12_exact_dedup": _OP12, "op13_fill_middle": _OP13}
