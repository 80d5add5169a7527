"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import exact_dedup, mixing, secrets, simhash
from lexspark.llm.common import cut, fold, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and the components of those within three bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all texts, in two runs over one ledger: the second scans only the blobs that the first did not see."""
    docs = table(spark, sf_dir, "documents")
    first = secrets.scan(docs.where(fold(F.col("doc_id"), 2) == 0))
    ledger = (cut(first["scanned"]), cut(first["findings"]))
    out = secrets.report(secrets.scan(docs, ledger))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the schedule takes, and the slot that first reads it."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to."""
    from lexspark.llm import bpe

    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).select("doc_id", "bpe.*")


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest").drop("__same")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all texts, without their tokens."""
    from lexspark.llm import token_count

    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text by a model that sees two thirds of the labelled rows."""
    from lexspark.llm import langid

    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    out = langid.predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score", "language.margin", "language.rejected")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that repeats, with the document that owns it."""
    from lexspark.llm import substring

    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of a label."""
    from lexspark.llm import vectors

    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every text by a model that sees three quarters of the labelled rows."""
    from lexspark.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    out = toxicity.score(docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with the near word that they are most likely a misspelling of."""
    from lexspark.llm import spelling

    return spelling.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from lexspark.llm import main_text

    out = main_text.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with what its subtree would save."""
    from lexspark.llm import prefix_trie

    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_tokens, op3_language, op4_secrets, op5_substrings, op6_vectors, op7_mixing, op8_bpe, op9_toxicity, op10_exact, op11_spelling, op12_pages, op13_prefixes)}

WORDS_SQL = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"

OP4_SQL = r"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES ('assign', 0), ('access', 1), ('hex', 2)) v(kind, ord)),
m AS (
  SELECT doc_id, kind, ord,
    CASE kind WHEN 'assign' THEN string_split_regex(t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
      WHEN 'access' THEN string_split_regex(t, 'AKIA[A-Z0-9]+') ELSE string_split_regex(t, '[0-9a-f]+') END AS gaps,
    CASE kind WHEN 'assign' THEN regexp_extract_all(t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
      WHEN 'access' THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS hits,
    CASE kind WHEN 'assign' THEN regexp_extract_all(t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) END AS vals
  FROM b, k),
e AS (SELECT doc_id, kind, ord, i, length(gaps[i]) AS g, length(hits[i]) AS n, coalesce(length(vals[i]), length(hits[i])) AS v
      FROM m, unnest(range(1, len(hits) + 1)) AS u(i)),
p AS (SELECT *, sum(g + n) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM e),
s AS (SELECT * FROM p WHERE v >= CASE kind WHEN 'assign' THEN 12 WHEN 'access' THEN 18 ELSE 16 END),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || (e - n) || ':' || e, ',' ORDER BY e - n, ord) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM b LEFT JOIN a USING (doc_id)""".replace("\\\\", "\\")

OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, {WORDS_SQL}::BIGINT AS size, substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.0::DOUBLE - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
f AS (SELECT arg_min(level, source_size::DOUBLE / weight) AS level FROM l WHERE level * weight < 3.0::DOUBLE * source_size),
t AS (SELECT w.*, least(3.0::DOUBLE * source_size, coalesce(f.level * weight, 3.0::DOUBLE * source_size)) AS target FROM w LEFT JOIN f ON true),
c AS (SELECT *, greatest(target / greatest(1.0::DOUBLE, ceil(sqrt(sum(target) OVER ()) / 8)), least(target, 64.0::DOUBLE)) AS due FROM t),
e AS (SELECT *, sum(due) OVER () AS everything, sum(due) OVER (ORDER BY source IS NULL, source COLLATE "C" ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") = count(*) OVER () AS last FROM c),
g AS (SELECT *, CASE WHEN everything > 0 THEN ceil(log2(everything))::INT ELSE -1 END AS bits FROM e),
x AS (SELECT source, source_size, target, bits, (upto - due) / everything AS lo, CASE WHEN last THEN 2.0::DOUBLE ELSE upto / everything END AS hi, CASE WHEN due > 0 THEN target / (due / everything * (1::BIGINT << bits)) ELSE 0.0::DOUBLE END AS block FROM g WHERE bits >= 0),
n AS (SELECT max(bits) AS bits FROM x),
u AS (SELECT k, list_sum([((k >> b) & 1) << (bits - 1 - b) for b in range(0, bits)])::DOUBLE / (1::BIGINT << bits) AS u FROM n, unnest(range(0, 1::BIGINT << bits)) AS r(k)),
j AS (SELECT x.source, u.k AS slot, row_number() OVER (PARTITION BY x.source ORDER BY u.k) - 1 AS rank FROM u JOIN x ON coalesce(u.u, 0) >= lo AND coalesce(u.u, 0) < hi WHERE block > 0),
q AS (SELECT t.source, t.source_size, t.target, x.block, least(floor(coalesce(m.n, 0) * x.block)::BIGINT, 3 * t.source_size) AS reads
      FROM t LEFT JOIN x ON t.source IS NOT DISTINCT FROM x.source LEFT JOIN (SELECT source, count(*) AS n FROM j GROUP BY source) m ON t.source IS NOT DISTINCT FROM m.source),
o AS (SELECT d.*, q.source_size, q.target, q.block, coalesce(q.reads, 0) AS reads, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
w2 AS (SELECT *, (CASE WHEN source_size > 0 THEN (reads // source_size) * size + greatest(0, least(reads % source_size - pos, size)) ELSE 0 END)::BIGINT AS taken FROM o)
SELECT doc_id, size, source_size, target, taken, j.slot AS first_slot
FROM w2 LEFT JOIN j ON taken > 0 AND w2.source IS NOT DISTINCT FROM j.source AND j.rank = ceil((pos + 1) / block)::BIGINT - 1"""

OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents"""

OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS node FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.node),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(any_value(n.n_links), 0) AS n_links, min(node) AS component_id, vec_id = min(node) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id"""

#: crc32 of a list of bytes, bit by bit.
CRC_SQL = "xor(list_reduce(list_concat([4294967295::BIGINT], {bytes}), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"

OP11_SQL = f"""
WITH RECURSIVE o AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, c, {CRC_SQL.format(bytes="flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))")} AS h FROM o),
d AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
x AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM w, unnest(range(0, length(word))) AS u(i)),
l AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT x.word, w.word, w.n FROM x JOIN w ON x.rest = w.word UNION SELECT DISTINCT w.word, x.word, x.n FROM x JOIN w ON x.rest = w.word),
f AS (SELECT a AS word, count(*) AS n_near, arg_min({{'b': b, 'n': n}}, {{'k': -n, 'b': b}}) AS best FROM l GROUP BY a),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN best.b END AS form, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n FROM w LEFT JOIN f USING (word)),
r AS (SELECT word, word AS root, 0 AS d FROM g UNION ALL SELECT r.word, g.form, d + 1 FROM r JOIN g ON g.word = r.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, arg_max(r.root, r.d) AS root, g.n, g.n_near, g.form_n FROM g JOIN r USING (word) GROUP BY ALL"""

OP13_SQL = f"""
WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, ({CRC_SQL.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 9)::BIGINT AS h FROM t),
s AS (SELECT h.conv_id, list_concat(CASE WHEN h = 0 OR b.own IS NULL THEN [] ELSE b.own[1:h] END, h.own[h + 1:]) AS seq FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE seq[1:d] END AS node, len(seq) = d AS ends FROM s, unnest(range(0, len(seq) + 1)) AS u(d)),
n AS (SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM p GROUP BY node),
k AS (SELECT CASE WHEN depth = 1 THEN [] ELSE node[1:depth - 1] END AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(node[depth].t) END AS saves FROM n LEFT JOIN k USING (node)),
a AS (SELECT CASE WHEN d = 0 THEN [] ELSE v.node[1:d] END AS node, sum(saves)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM v, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1)
SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, a.n_leaves, a.saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN a USING (node) LEFT JOIN n q ON v.depth > 0 AND q.node = CASE WHEN v.depth = 1 THEN [] ELSE v.node[1:v.depth - 1] END"""

ORACLES: dict[str, str] = {"op11_spelling": OP11_SQL, "op13_prefixes": OP13_SQL, "op6_vectors": OP6_SQL, "op4_secrets": OP4_SQL, "op7_mixing": OP7_SQL, "op10_exact": OP10_SQL}
