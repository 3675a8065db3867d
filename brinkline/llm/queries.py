"""Registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinkline.llm import chat, merkle, mixing, quality, tiff, warc
from brinkline.llm import secrets as secret_spans
from brinkline.llm.common import table
from brinkline.llm.ngram_join import ngram_jaccard_join
from brinkline.llm.packing import pack_mixture
from brinkline.llm.pieces import sample_segmentations
from brinkline.llm.pii import surrogate_pii
from brinkline.llm.spelling import spelling_variants
from brinkline.llm.toxicity import toxicity

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WARC_ROLL = 1 << 20
PII_KEY = b"brinkline production key 1"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = "crc32(cast(doc_id AS string)) % 5"
    scored = toxicity(docs, labels.select("doc_id", "toxic"), train=f"{fold} <> 0")
    return scored.select("doc_id", F.expr(f"{fold} = 0").alias("held_out"), "score", "predicted", "n_restored")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"), roll_bytes=WARC_ROLL).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, num=85, den=100)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sample_segmentations(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL, k=2)
    return drawn.select("doc_id", "sample_rank", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"), "log_prob", "perturbed", "inclusion", "decoded")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return chat.digests(chat.format_conversations(rows.union(extra)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of labelled rows: language and quality label."""
    labels, docs = table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(labels, "doc_id").select("doc_id", F.concat_ws("/", "lang", "quality").alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.mix_to_targets(table(spark, sf_dir, "documents").select("doc_id", "text"), labelled_domains(spark, sf_dir))
    return rates.select("doc_id", "n_tokens", "domain", F.array_max("p").alias("p_domain"), "rate", "copies", "residual", "settled")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of whole rows by language; tampering lower-cases the letters A-Z of the texts of every third document."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = merkle.field_digest(*fields, F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle.merkle_manifest(docs, "lang", "doc_id", merkle.field_digest(*fields, F.col("text")), F.when(hit, tampered))
    return found.drop("lang")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of 1024 tokens in the proportions that the sources have of all tokens."""
    pieces = pack_mixture(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i+3], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\])')) AS hits FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, sum(length(role) + length(text) + 20) + sum(hits) AS n, sum(hits) > 0 AS escaped,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars, escaped FROM g
"""

def crc32_sql(byte_list: str) -> str:
    """DuckDB's unsigned CRC-32 of a list of bytes."""
    step = "list_reduce([xor(c, b)] || range(8)::UBIGINT[], lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
    return f"xor(list_reduce([4294967295::UBIGINT] || {byte_list}, lambda c, b: {step}), 4294967295::UBIGINT)"


def tree_sql(nodes: str, walks: str, tree: str, prefix: str, levels: int = 8) -> str:
    """DuckDB CTEs of digest trees over ``nodes`` (the tree's column, ix, digest), up to 8 to the power of ``levels`` a tree.

    ``prefix``_top has each tree's last node; ``prefix``_walk takes ``walks`` (rid, the tree's column, place, proof, now)
    to the top: their siblings are appended to ``proof``, and ``now`` is folded with them.
    """
    ctes = [f"{prefix}0 AS (SELECT {tree}, ix, digest FROM {nodes})", f"{prefix}w0 AS (SELECT rid, {tree}, place, proof, now FROM {walks})"]
    before, behind = "array_to_string(r.parts[1:w.place % 8], '')", "array_to_string(r.parts[w.place % 8 + 2:], '')"
    for k in range(levels):
        same = f"IS NOT DISTINCT FROM x.{tree}"
        ctes += [
            f"{prefix}n{k} AS (SELECT {tree}, count(*) AS n FROM {prefix}{k} GROUP BY ALL)",
            f"{prefix}r{k} AS (SELECT x.{tree}, x.ix // 8 AS run, list(x.digest ORDER BY x.ix) AS parts, any_value(n.n) AS n FROM {prefix}{k} x JOIN {prefix}n{k} n ON n.{tree} {same} GROUP BY ALL)",
            f"{prefix}{k + 1} AS (SELECT {tree}, run AS ix, CASE WHEN n > 1 THEN sha256(array_to_string(parts, '')) ELSE parts[1] END AS digest FROM {prefix}r{k})",
            f"{prefix}w{k + 1} AS (SELECT w.rid, w.{tree}, w.place // 8 AS place, CASE WHEN r.n > 1 THEN w.proof || {before} || {behind} ELSE w.proof END AS proof, "
            f"CASE WHEN r.n > 1 THEN sha256({before} || w.now || {behind}) ELSE w.now END AS now "
            f"FROM {prefix}w{k} w JOIN {prefix}r{k} r ON r.{tree} IS NOT DISTINCT FROM w.{tree} AND r.run = w.place // 8)",
        ]
    return ", ".join([*ctes, f"{prefix}_top AS (SELECT * FROM {prefix}{levels})", f"{prefix}_walk AS (SELECT * FROM {prefix}w{levels})"])


def _field_sql(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


_RUN_BYTES = "flatten(list_transform(range(1, length(run) + 1), lambda i: CASE WHEN ord(run[i]) < 128 THEN [ord(run[i])] ELSE [192 + ord(run[i]) // 64, 128 + ord(run[i]) % 64] END))::UBIGINT[]"
_DIGITS = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i]))::UBIGINT[]"
OP11_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, {crc32_sql(f"coalesce({_DIGITS}, []::UBIGINT[]) || [58::UBIGINT] || {_RUN_BYTES}")} AS h FROM c),
o AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
e AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS v FROM d),
p AS (
  SELECT a.word, b.word AS near FROM e a JOIN e b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
  UNION SELECT e.word, w.word FROM e JOIN w ON e.v = w.word UNION SELECT w.word, e.word FROM e JOIN w ON e.v = w.word
), g AS (SELECT p.word, count(*) AS n_near, arg_min(near, (-b.n, near)) AS near, max(b.n) AS near_n FROM p JOIN w b ON b.word = p.near GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN g ON g.word = w.word),
s(word, last) AS (SELECT word, word FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.last WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, s.last AS root FROM f JOIN s ON s.word = f.word JOIN f t ON t.word = s.last AND t.form IS NULL
"""

_OP12_FIELDS = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR")
_ID_CRC = crc32_sql("list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::UBIGINT)")
OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, lang, {_field_sql(*_OP12_FIELDS, "text")} AS digest, {_ID_CRC} % 3 = 0 AS hit,
    {_field_sql(*_OP12_FIELDS, "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed FROM documents
), l AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, digest, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS ix,
    CASE WHEN hit THEN changed ELSE digest END AS now FROM d
), aw AS (SELECT rid, lang, ix AS place, '' AS proof, now FROM l),
{tree_sql("l", "aw", "lang", "a")},
s AS (SELECT 0 AS one, lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS ix FROM a_top),
bw AS (SELECT w.rid, 0 AS one, s.ix AS place, w.proof, w.now FROM a_walk w JOIN s ON s.lang IS NOT DISTINCT FROM w.lang),
{tree_sql("s", "bw", "one", "b")}
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.now AS folded_root, w.now = t.digest AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN b_walk w ON w.rid = l.rid JOIN b_top t ON t.one = w.one
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_pii": op5_pii,
    "op6_tiff": op6_tiff,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_secrets": op10_secrets,
    "op11_spelling": op11_spelling,
    "op12_merkle": op12_merkle,
    "op13_packing": op13_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": OP3_SQL,
    "op7_chat": OP7_SQL,
    "op11_spelling": OP11_SQL,
    "op12_merkle": OP12_SQL,
}
