"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.chat import format_turns, read_back
from strandline.llm.common import Scratch, stored, table
from strandline.llm.pii import find as find_pii
from strandline.llm.decontamination import leaks
from strandline.llm.divergence import divergence
from strandline.llm.id_planes import token_files
from strandline.llm.jaccard import near_duplicates
from strandline.llm.media import media_columns
from strandline.llm.merkle import manifest
from strandline.llm.pieces import encode_documents
from strandline.llm.sharding import shard_documents
from strandline.llm.token_counts import token_counts
from strandline.llm.toxicity import toxicity
from strandline.llm.warc import marked, read_archives, train_dictionary, write_archives

MODEL, BYTE_MODEL = "piece_bpe_32k.model", "byte_bpe_50k.json"


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), MODEL, ids=False)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionary = train_dictionary(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html")), size=1 << 16)
    return media_columns(docs, dictionary)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    return read_back(format_turns(given.union(probe)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    work = Scratch(spark)
    try:
        archives = work.stored(write_archives(marked(pages, work=work), train_dictionary(pages)), codec="none")
        return stored(read_archives(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:
        work.drop()


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), MODEL, limit=4096)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"), least=30, most=50)


def op13_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), BYTE_MODEL, end=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": op1_pieces,
    "op2_jaccard": op2_jaccard,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_media": op5_media,
    "op6_chat": op6_chat,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_merkle": op11_merkle,
    "op12_divergence": op12_divergence,
    "op13_id_planes": op13_id_planes,
}

#: A control string or backslash gets one character more when it is escaped.
_ESCAPED = r"length(regexp_replace({}, '(\\|<\||\|>|</s>|<s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\1.', 'g'))"

#: The unsigned CRC-32 of a text of ASCII characters: each byte goes in, then eight shifts (marked -1).
_CRC32 = """xor(list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""

_LEAF = "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

# trees are named by their language (sort key: null first); tree -1 is the one above, with the subroots as leaves
_MERKLE = f"""WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang, {_LEAF.format("text")} AS leaf,
   {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low,
   coalesce({_CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0, FALSE) AS hit FROM documents),
 placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang IS NOT NULL, lang) - 1 AS tree,
   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows_),
 nodes AS (
  SELECT tree, CAST(0 AS BIGINT) AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 8),
 subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
 tops AS (
  SELECT CAST(0 AS BIGINT) AS level, tree AS place, digest, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, place // 8),
 every AS (SELECT tree, level, place, digest FROM nodes WHERE n > 1 UNION ALL SELECT -1, level, place, digest FROM tops WHERE n > 1),
 runs AS (SELECT tree, level, place // 8 AS above, list(digest ORDER BY place) AS kids FROM every GROUP BY tree, level, place // 8),
 heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
 walk AS (
  SELECT tree AS own, place AS leaf_place, tree, CAST(0 AS BIGINT) AS level, place, CASE WHEN hit THEN low ELSE leaf END AS held, '' AS proof FROM placed
  UNION ALL
  SELECT w.own, w.leaf_place, CASE WHEN r.kids IS NULL THEN -1 ELSE w.tree END, CASE WHEN r.kids IS NULL THEN 0 ELSE w.level + 1 END,
   CASE WHEN r.kids IS NULL THEN w.own ELSE w.place // 8 END,
   CASE WHEN r.kids IS NULL THEN w.held ELSE sha256(array_to_string(r.kids[:w.place % 8], '') || w.held || array_to_string(r.kids[w.place % 8 + 2:], '')) END,
   CASE WHEN r.kids IS NULL THEN w.proof ELSE w.proof || array_to_string(r.kids[:w.place % 8], '') || array_to_string(r.kids[w.place % 8 + 2:], '') END
  FROM walk w LEFT JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.above = w.place // 8
  WHERE w.tree >= 0 OR r.kids IS NOT NULL),
 done AS (SELECT own, leaf_place, arg_max(held, level) AS held, arg_max(proof, level) AS proof FROM walk WHERE tree = -1 GROUP BY own, leaf_place),
 told AS (
  SELECT p.doc_id, p.leaf, s.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(d.proof) AS proof_sha256, d.held AS folded_root
  FROM placed p JOIN subroots s ON s.tree = p.tree JOIN done d ON d.own = p.tree AND d.leaf_place = p.place)
 SELECT *, folded_root = root AS verified FROM told"""

ORACLE_SQL: dict[str, str] = {
    "op6_chat": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, text), '')) AS loss_sha256,
  CAST(3 + sum(8 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS rewritten_turns
 FROM c GROUP BY conv_id""",
    "op8_warc": """SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN later THEN first END AS refers_to
 FROM (SELECT page_id, html, first, coalesce(strlen(html) >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first, FALSE) AS later
       FROM (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM pages) f) l""",
    "op11_merkle": _MERKLE,
    "op12_divergence": r"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
 o AS (SELECT lang, source, term, row, count(*) AS n FROM (SELECT lang, source, row, unnest(terms) AS term FROM d) GROUP BY ALL),
 kept AS (SELECT lang, term, sum(n) AS n FROM o GROUP BY lang, term HAVING count(*) >= 30),
 langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
 groups AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, sum(o.n) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
 totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN c USING (lang, source) GROUP BY lang, source),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.total + 5 * l.v) AS p,
   1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS q
  FROM totals g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
   ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
 FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 50""",
}
