"""The registered queries of this subpackage: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import alignment, bottomk, chaining, decontam, langid, licenses, ngramjoin, packing, radix, sharding, simhash, spelling, tokencount


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wording in all documents."""
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return bottomk.compared(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the byte strings that occur earlier."""
    return radix.deduplicated(_table(spark, sf_dir, "documents"))


def op5_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that repeat an earlier one."""
    return chaining.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op8_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return langid.predicted(_table(spark, sf_dir, "documents"))


def op9_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items in all documents."""
    found = decontam.decontaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in full sequences."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of two tokenizers, aligned, with what links them in the corpus."""
    return alignment.aligned(_table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose four-word shingles are alike by 85 of 100."""
    return ngramjoin.linked(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the more frequent words they are near to."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_kd_shards, op2_license_scan, op3_bottom_k, op4_simhash, op5_collinear_chains, op6_token_transducer, op7_suffix_radix, op8_byte_gru, op9_suffix_automaton, op10_mixture_packing, op11_token_alignment, op12_ngram_join, op13_spelling_variants)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    # strings of 100 bytes as hexadecimal digits; runs of removed bytes are islands of their starts
    "op7_suffix_radix": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
      w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
      r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
      i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r),
      g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM i),
      s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, g),
      k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM s),
      t AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS head, max(b) AS last FROM k JOIN d USING (doc_id) GROUP BY doc_id)
      SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
        sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op9_suffix_automaton": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
      iw AS (SELECT DISTINCT item_id, n, w[p : p + n - 1] AS k FROM (SELECT *, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)),
      dw AS (SELECT doc_id, n, p, w[p : p + n - 1] AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
      h AS (SELECT doc_id, item_id, p, n FROM dw JOIN iw USING (n, k)),
      c AS (SELECT doc_id, count(DISTINCT q) AS hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
      l AS (SELECT doc_id, count(*) AS items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)""",
    # documents of equal sets stand for each other; all pairs of the others that share a shingle are counted
    "op12_ngram_join": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 4) - 1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
      t AS (SELECT doc_id, count(*) AS n, md5(string_agg(k, ' ' ORDER BY k)) AS h FROM s GROUP BY doc_id),
      c AS (SELECT h, n, min(doc_id) AS c FROM t GROUP BY h, n),
      e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM (s JOIN c ON doc_id = c) a JOIN (s JOIN c ON doc_id = c) b ON a.k = b.k AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
      l AS (SELECT a, b FROM e JOIN c x ON x.c = a JOIN c y ON y.c = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
      r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
      g AS (SELECT h, n, least_id FROM c JOIN (SELECT a, min(b) AS least_id FROM r GROUP BY a) ON a = c)
      SELECT d.doc_id, coalesce(g.n, 0)::BIGINT AS n_shingles, coalesce(least_id, d.doc_id) AS component_id FROM d LEFT JOIN t USING (doc_id) LEFT JOIN g USING (h, n)""",
}
