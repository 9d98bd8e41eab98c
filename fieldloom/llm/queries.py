"""The thin queries of the operators over their whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, counts, infill, langid, lattice, media, neardup, packing, quality, secrets, substrings, variants, warc
from .common import written

path = public_tokenizers.path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, weights = langid.train(docs)
    judged = langid.predict(docs.select("doc_id", "text"), names, weights)
    return judged.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, as over a growing history: the first audits half of the versions, the second all of them with the first
    one's ledger, so it scans only the contents that are new to it and joins old findings to old and new paths alike."""
    docs = table(spark, sf_dir, "documents")
    _, ledger = secrets.audit(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    found, _ = secrets.audit(docs, ledger=ledger)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", secrets.kind_name(s["rank"]), s["start"], s["stop"])), ",")
    ranks = F.transform("spans", lambda s: s["rank"])
    counted = [(F.size(ranks) - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counted, F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op6_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are made from all turns of conversations: no table has audio. One row per recording with its class of
    equal ones; the rows that name a class also hold its matches, one row each, if a member is among the queries."""
    ids = ["conv_id", "turn"]
    members, matches = media.search(media.sonified(table(spark, sf_dir, "conversations"), ids), F.col("conv_id") % 100 == 0, ids)
    ends = matches.select(*(F.col(f"class.{c}").alias(c) for c in ids), *(F.col(f"match.{c}").alias(f"match_{c}") for c in ids), "offset", "overlap", "bit_errors")
    names = [members[c].eqNullSafe(members["class"][c]) & members[c].eqNullSafe(ends[c]) for c in ids]
    named = members.join(ends, names[0] & names[1], "left")
    return named.select(*(members[c] for c in ids), *(members["class"][c].alias(f"class_{c}") for c in ids), "copies", "match_conv_id", "match_turn", "offset", "overlap", "bit_errors")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive, audited against a replica. Its records are hashed from their own bytes, of which fixed ones
    have a byte changed; others are lost, and some volumes have a record more at their end. One row for each record, with
    a null page_id for those that only the replica has."""
    r = F.col("record")
    last = F.length(r) - 4  # before the two line ends that close a record
    other = F.when(F.substring(r, last, 1) == "#", "*").otherwise("#")
    damaged = F.when(F.col("id") % 97 == 13, F.overlay(r, other, last)).otherwise(r)
    lost = F.coalesce(F.col("id") % 389 == 7, F.lit(False))
    both = written(warc.archive(table(spark, sf_dir, "pages"), copy=damaged, lost=lost), "archive")
    manifest = both.select("volume", "offset", "length", "sha256", "id")
    replica = both.where("not lost").select("volume", "offset", F.col("copy_length").alias("length"), F.col("copy_sha256").alias("sha256"), "id")
    ends = both.where("volume % 5 = 3").groupBy("volume").agg(F.max(F.col("offset") + F.col("length")).alias("offset"))
    more = F.lit("WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    extra = ends.select("volume", "offset", F.octet_length(more).cast("long").alias("length"), F.sha2(more.cast("binary"), 256).alias("sha256"), F.lit(None).cast(manifest.schema["id"].dataType).alias("id"))
    replica = written(replica.unionByName(extra), "replica")
    found = manifest.join(warc.audit(manifest, replica), ["volume", "offset"], "full")
    return found.select(F.col("id").alias("page_id"), "volume", "offset", "length", "sha256", F.coalesce("status", F.lit("intact")).alias("status"))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.linked(table(spark, sf_dir, "embeddings"))


def op11_nearest_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.word_counts(table(spark, sf_dir, "documents"), change=variants.thinned(97)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("output"), F.col("form"))
    shas = [F.sha2(c.cast("binary"), 256).alias(name) for name, c in (("output_sha256", F.col("output")), ("restored_sha256", back))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *shas)


def queries() -> dict:
    ops = (
        op1_byte_bpe, op2_order_minhash, op3_substring_dedup, op4_language_id, op5_secret_scans, op6_audio_fingerprints, op7_best_fit_packing, op8_token_counts, op9_merkle_fixity,
        op10_lattice, op11_nearest_votes, op12_spelling_variants, op13_fill_in_middle,
    )
    return {f.__name__: f for f in ops}


_ASSIGN = rf"""({secrets.either_case("password|passwd|secret|token|api_?key")})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(rank: int, kind: str, pattern: str, kept: str) -> str:
    """Of each document, the list of spans of one kind: lengths of the pieces between matches and of the matches add up."""
    return f"""
    m{rank} AS (
      SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, g, v FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, string_split_regex(text, '{pattern}') AS g,
          {f"regexp_extract_all(text, '{pattern}', 2)" if kind == "assign" else f"regexp_extract_all(text, '{pattern}', 0)"} AS v FROM docs)),
    s{rank} AS (
      SELECT doc_id, {rank} AS rank, '{kind}' AS kind, length(v[i]) AS judged, length(m[i]) AS size,
        sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM m{rank}),
    k{rank} AS (SELECT doc_id, rank, kind, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM s{rank} WHERE judged >= {kept})"""


_SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_matches(0, "assign", _ASSIGN, "6")},{_matches(1, "access", "AKIA[A-Z0-9]+", "20")},{_matches(2, "hex", "[0-9a-f]+", "24")},
found AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2),
listed AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (doc_id)"""

_SUBSTRINGS = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM docs WHERE len(w) >= 35),
hashed AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM hashed JOIN twice USING (h)),
cut AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM docs),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.k) AS t FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k WHERE gone.k IS NULL GROUP BY words.doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_WARC = r"""
WITH h AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(coalesce(url, '') || ' ' || coalesce(html, '')) AS h, chr(13) || chr(10) AS nl FROM pages),
r AS (
  SELECT page_id, 'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>'
    || nl || 'WARC-Date: 1970-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Length: ' || strlen(html) || nl || nl || html || nl || nl AS r FROM h),
s AS (SELECT page_id, page_id // 1000 AS volume, strlen(r)::BIGINT AS length, sha256(r) AS sha256 FROM r),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY volume ORDER BY page_id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM s)
SELECT page_id, volume::BIGINT AS volume, "offset", length, sha256, CASE WHEN page_id % 389 = 7 THEN 'missing' WHEN page_id % 97 = 13 THEN 'corrupt' ELSE 'intact' END AS status FROM o
UNION ALL SELECT NULL, volume::BIGINT, sum(length)::BIGINT, NULL, NULL, 'extra' FROM s WHERE volume % 5 = 3 GROUP BY volume"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT links.b, reached.low FROM reached JOIN links ON links.a = reached.node WHERE reached.low < links.b),
lows AS (SELECT node, min(low) AS c FROM reached GROUP BY node),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, c = vec_id AS kept
FROM v JOIN lows ON lows.node = vec_id LEFT JOIN degrees ON degrees.a = vec_id"""


#: crc32 byte by byte from a table of its 256 values, which the rule of its polynomial gives.
_VARIANTS = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crc FROM (SELECT unnest(range(256)) AS b)),
runs AS MATERIALIZED (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c // 256, t.crc[1 + xor(c % 256, b)])), 4294967295) AS h FROM bytes, t),
w AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
stars AS (SELECT word, n, k, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS key FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM w)),
fewer AS (SELECT DISTINCT word, n, replace(key, '*', '') AS key FROM stars),
links AS MATERIALIZED (
  SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM stars a JOIN stars b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT f.word, f.n, w.word, w.n FROM fewer f JOIN w ON f.key = w.word
  UNION ALL SELECT w.word, w.n, f.word, f.n FROM fewer f JOIN w ON f.key = w.word),
best AS (SELECT a, count(*) AS n_near FROM links GROUP BY a),
forms AS MATERIALIZED (SELECT a, b, bn FROM links QUALIFY row_number() OVER (PARTITION BY a ORDER BY bn DESC, encode(b)) = 1 AND bn >= 2 * an),
chain AS (SELECT word AS start, word AS low FROM w UNION ALL SELECT chain.start, forms.b FROM chain JOIN forms ON forms.a = chain.low),
ends AS (SELECT start, low AS root FROM chain WHERE NOT EXISTS (SELECT 1 FROM forms WHERE forms.a = chain.low))
SELECT w.word, forms.b AS form, root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, bn AS form_n
FROM w LEFT JOIN best ON best.a = w.word LEFT JOIN forms ON forms.a = w.word JOIN ends ON ends.start = w.word"""

_INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT % (len(u) + 1) AS h1, ('0x' || x[9:16])::BIGINT % (len(u) + 1) AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, array_to_string(u[1 : least(h1, h2)], '') AS p, array_to_string(u[least(h1, h2) + 1 : greatest(h1, h2)], '') AS m, array_to_string(u[greatest(h1, h2) + 1 :], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c"""


def oracle_sql() -> dict[str, str]:
    return {"op12_spelling_variants": _VARIANTS, "op13_fill_in_middle": _INFILL, "op3_substring_dedup": _SUBSTRINGS, "op5_secret_scans": _SECRETS, "op9_merkle_fixity": _WARC, "op10_lattice": _VECTORS}
