"""The corpus operators bound to the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.decontamination import leaks
from hearthline.llm.extraction import extracted
from hearthline.llm.language import fit_languages, identified
from hearthline.llm.manifest import digest_of, manifest
from hearthline.llm.neardup import near_classes
from hearthline.llm.packing import pack
from hearthline.llm.passages import shared_passages
from hearthline.llm.pii import find_personal_data
from hearthline.llm.quality import fit_rules, judged
from hearthline.llm.secret_scan import find_secrets
from hearthline.llm.setjoin import linked_sets
from hearthline.llm.spans import count_of, listed
from hearthline.llm.tokencount import count_tokens
from hearthline.llm.variants import spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WORD_BPE = "word_bpe_49k.json"
SEQUENCE_TOKENS = 2048


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and the prefix that fits a sequence."""
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), SEQUENCE_TOKENS)
    return counted.withColumn("over_limit", F.col("n_tokens") > SEQUENCE_TOKENS)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), SEQUENCE_TOKENS)


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _span_digest(find_secrets(docs, into="found"), ("assign", "access", "hex"))


@query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores")
    return _span_digest(find_personal_data(docs, into="found"), ("email", "ip", "card", "phone"), score)


def _span_digest(found: DataFrame, kinds: tuple[str, ...], *more: Column) -> DataFrame:
    """Counts, checksum of the given kinds' spans, all spans as text, and what is asked for besides."""
    base = F.filter(F.col("found"), lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(count_of(F.col("found"), kind).alias(f"n_{kind}") for kind in kinds),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        *more,
    )


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents, by a forest fitted on labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit_rules(docs, table(spark, sf_dir, "labels"))
    return judged(docs, forest, into="judged").select("doc_id", "judged.*")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit_languages(docs.where(~held_out))
    return identified(docs, model, into="guess").select("doc_id", held_out.alias("held_out"), "guess.*")


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extracted(pages, into="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_near_duplicates")
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op1_benchmark_leaks")
def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that stands in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("op4_shared_passages")
def op4_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents share."""
    return shared_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The unsigned CRC-32 of a text, bit by bit over its bytes.
CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, 1 + length(hex(encode({0}))) // 2),
  lambda i: ('0x' || substr(hex(encode({0})), (2 * i - 1)::INT, 2))::UBIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
  lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)), 4294967295::UBIGINT)"""


def _encoded_sql(c: str) -> str:
    return f"coalesce(strlen({c}) || ':' || {c}, '-')"


_LEAF_SQL = "sha256(" + " || ".join(_encoded_sql(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + ")"
MERKLE_SQL = f"""WITH RECURSIVE d AS (
 SELECT doc_id, {_LEAF_SQL.format(text="text")} AS leaf,
  CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 2 = 0 THEN {_LEAF_SQL.format(text="replace(text, chr(10), '')")}
   ELSE {_LEAF_SQL.format(text="text")} END AS claimed,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
t AS (SELECT 0 AS level, tree, pos, n, leaf AS digest FROM d
 UNION ALL SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, tree, pos // 3, n),
s AS (SELECT tree, digest AS subroot, level AS height FROM t WHERE n = 1),
u AS (SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM s) AS n, subroot AS digest FROM s
 UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 3, n),
nodes AS (SELECT tree, level, pos, digest FROM t WHERE n > 1
 UNION ALL SELECT NULL, level, pos, digest FROM u WHERE n > 1),
own AS (SELECT t.tree AS at, 0 AS upper, d.tree, d.pos, l.level, d.pos // pow(3, l.level)::BIGINT AS node
  FROM d JOIN s AS t USING (tree), range(40) AS l(level) WHERE l.level < t.height
 UNION ALL SELECT NULL, 1, d.tree, d.pos, l.level, d.tree // pow(3, l.level)::BIGINT
  FROM d, range(40) AS l(level) WHERE l.level < (SELECT max(level) FROM u)),
sides AS (SELECT o.tree, o.pos, o.upper, o.level,
  coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos < o.node), '') AS l,
  coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos > o.node), '') AS r
 FROM own AS o JOIN nodes AS x ON x.tree IS NOT DISTINCT FROM o.at AND x.level = o.level AND x.pos // 3 = o.node // 3 GROUP BY ALL),
proofs AS (SELECT tree, pos, string_agg(l || r, '' ORDER BY upper, level) AS proof, list(l || '|' || r ORDER BY upper, level) AS steps FROM sides GROUP BY ALL)
SELECT doc_id, leaf, subroot, top.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256,
 list_reduce(list_prepend(claimed, coalesce(steps, [])), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root,
 folded_root = top.digest AS verified
FROM d JOIN s USING (tree) JOIN (SELECT digest FROM u WHERE n = 1) AS top ON true LEFT JOIN proofs USING (tree, pos)"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, root and proof of every document, with a check of rows that were tampered with."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(columns)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = digest_of(*[F.col(c) for c in columns[:-1]], text)
    found = manifest(docs, columns, claimed=claimed)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


VARIANTS_SQL = f"""WITH RECURSIVE r AS (SELECT doc_id::VARCHAR AS k, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT k, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {CRC32.format("(k || ':' || run)")} AS h FROM low),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, range(1, 200) AS t(i) WHERE i <= length(word)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gone AS a JOIN gone AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM gone AS a JOIN w AS b ON a.rest = b.word
 UNION SELECT b.word, a.word, a.n FROM gone AS a JOIN w AS b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
 FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, walk.root FROM f JOIN walk USING (word) JOIN f AS e ON e.word = walk.root WHERE e.form IS NULL"""


@query("op12_spelling_variants", VARIANTS_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their near words, and the form they are a variant of."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


LINKED_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
one AS (SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
e AS (SELECT id, n, unnest(s) AS t FROM one),
links AS (SELECT a.id AS a, b.id AS b FROM e AS a JOIN e AS b ON a.t = b.t AND a.id <> b.id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT id, id AS other FROM one UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s.s) AS n_shingles, coalesce(c.component_id, doc_id) AS component_id
FROM s LEFT JOIN one ON list_sort(s.s) = one.s LEFT JOIN c USING (id)"""


@query("op11_jaccard_join", LINKED_SQL)
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of nearly equal three-word sets."""
    return linked_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))
