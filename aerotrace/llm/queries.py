"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .chat_format import chat_windows, digests
from .common import load
from .exact_dedup import exact_dedup
from .license_scan import license_scan
from .near_dedup import near_duplicates
from .packing import pack
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .source_divergence import divergence
from .substring_dedup import substring_dedup
from .token_alignment import align
from .token_counts import token_counts


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without windows of 20 that also start earlier; a null or empty text has no words and the digest of nothing."""
    return substring_dedup(load(spark, sf_dir, "documents"), window=20, with_text=False)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, with the one of equal texts that stays; null counts as empty, so all null and empty texts are one group."""
    return exact_dedup(load(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, kept or not; a null or empty text has no words and fails the base rules."""
    return quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 1024 tokens; a null or empty text is a piece of its one closing id."""
    return pack(load(spark, sf_dir, "documents"), vocab(), size=1024)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per length that occurs; a null or empty text has length 0, an empty table gives no rows."""
    return token_counts(load(spark, sf_dir, "documents"), vocab())


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null or empty text has no spans and the digest of nothing."""
    found = secret_scan(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per conversation, read back from the formatted windows, and conversation -1 with control strings in its texts; a null text is empty."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(chat_windows(rows.unionByName(more)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; first and last word are null without a phrase of the base; a null or empty text has no labels and score 0."""
    return license_scan(load(spark, sf_dir, "documents")).drop("spans")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null or empty text has no shingles and stays alone."""
    return near_duplicates(load(spark, sf_dir, "documents"), words=2, percent=80)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null or empty text has no ids and the digests of nothing."""
    return bpe.encode(load(spark, sf_dir, "documents"), vocab(), with_ids=False)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every two sources of a language differ, and the ten terms each source has most in excess; null texts, languages and sources are empty."""
    return divergence(load(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, held out or not; a null or empty text is scored like any other."""
    return quality_classifier(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null or empty text, or one that the second tokenizer doesn't give back, has zeros and an empty digest."""
    import public_tokenizers

    return align(load(spark, sf_dir, "documents"), vocab(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_secret_scan": op6_secret_scan,
    "op7_chat_format": op7_chat_format,
    "op8_license_scan": op8_license_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_bpe": op10_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        placed AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM split)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM placed) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, range(20) r(o)),
        kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS said, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM split) w
                 ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
        SELECT s.doc_id, len(s.ws) AS n_words, len(s.ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.said, '')) AS kept_sha256 FROM split s LEFT JOIN kept k USING (doc_id)""",
    "op9_near_dedup": r"""
        WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM split),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        counted AS (SELECT s.doc_id, s.s, z.n FROM shingles s JOIN sizes z USING (doc_id)),
        links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM counted a JOIN counted b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
                  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.other)
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
        FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id, z.n""",
    "op11_source_divergence": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT r) AS d FROM (SELECT r, lang, source, unnest(ts) AS term FROM docs) GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term HAVING sum(d) >= 10),
        langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM groups g LEFT JOIN (SELECT * FROM counts SEMI JOIN kept USING (lang, term)) c USING (lang, source) GROUP BY g.lang, g.source),
        shares AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (t.n + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.n + 2 * l.v) AS q
                   FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)),
        pairs AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        every AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
                  LEFT JOIN pairs p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op3_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        WINDOW g AS (PARTITION BY norm)""",
}
