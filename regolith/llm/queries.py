"""The corpus operators' queries over the tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm.common import read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from regolith.llm import bpe

    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = bpe.encode(read(spark, sf_dir, "documents"), tokens, decoded=True, digest=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regolith.llm import near_dedup

    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op3_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host is the document's source, its path the source's part in one language: documents have no URL."""
    from regolith.llm import quality_bayes

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    evidence = quality_bayes.train(docs, read(spark, sf_dir, "labels"))
    return quality_bayes.classify(docs, evidence, F.col("source"), F.col("lang"))


def quality_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages by the hosts and directories of their URLs, most of which have few pages: text without tags, evidence learned from the
    labelled documents."""
    from regolith.llm import quality_bayes

    evidence = quality_bayes.train(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    pages = read(spark, sf_dir, "pages").select("page_id", bare.alias("text"), "url")
    return quality_bayes.classify(pages, evidence, *quality_bayes.site_of(F.col("url")), id_col="page_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regolith.llm import quality_rules

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.train(docs, read(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regolith.llm import decontaminate

    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regolith.llm import secrets

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    found = secrets.secret_spans(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regolith.llm import language_id, toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language_id.held_out(parts=4, part=2)
    found = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathlib import Path

    import public_tokenizers

    from regolith.llm import token_files

    definition = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    folder, files = token_files.write(read(spark, sf_dir, "documents"), definition, special=True)
    return token_files.read_files(spark, folder, files)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regolith.llm import language_id

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, ~language_id.held_out())
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regolith.llm import line_dedup

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathlib import Path

    import public_tokenizers

    from regolith.llm import transducer

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    found = transducer.encode(docs, definition, transducer.lexicon(docs, definition), decoded=True, digest=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", "decoded_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regolith.llm import whitening

    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = whitening.fit(rows)
    shares = F.lit([float(x) for x in found.explained]) if found.explained else F.array().cast("array<double>")
    each = whitening.whiten(rows, found).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regolith.llm import merkle

    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = read(spark, sf_dir, "documents").select(*columns)
    now = merkle.leaf(*[merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in columns])
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(docs, columns, "source", "doc_id", F.when(touched, now))


#: All pairs that share a shingle, then all that can be reached: for small tables only.
OP2_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), sizes AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM sets
), items AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * both_have >= 80 * (p.n + q.n - both_have)
), edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN lowest USING (doc_id)
"""

OP10_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), spread AS (
  SELECT key, count(DISTINCT doc_id) AS docs, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(CASE WHEN s.top > k.doc_id THEN 1 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN s.top > k.doc_id THEN NULL ELSE k.line END, chr(10) ORDER BY k.pos), '')) AS kept_sha256
FROM keyed k LEFT JOIN spread s ON k.key = s.key
GROUP BY k.doc_id
"""

#: The columns of op4_quality_rules that are counts and fixed limits; the verdict is beyond SQL.
OP4_BASE_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS times
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM windows, range(8) r(d) WHERE times > 1 GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeated r ON w.doc_id = r.doc_id
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
"""

_ASSIGN = """([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: The columns of op6_secrets that are the fixed patterns' spans; spans of high entropy are beyond SQL.
OP6_BASE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), m AS (
  SELECT doc_id, 'assign' AS kind, 1 AS rank, regexp_extract_all(text, '{_ASSIGN}') AS found, string_split_regex(text, '{_ASSIGN}') AS parts FROM t
  UNION ALL SELECT doc_id, 'access', 2, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL SELECT doc_id, 'hex', 3, regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM t
), each AS (
  SELECT doc_id, kind, rank, unnest(found) AS hit, unnest(list_transform(range(1, len(found) + 1), lambda i: length(array_to_string(parts[1:i], '')) + length(array_to_string(found[1:i - 1], '')))) AS start FROM m
), spans AS (
  SELECT *, start + length(hit) AS stop FROM each
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 6 WHEN 'access' THEN length(hit) >= 20 ELSE length(hit) >= 24 END
)
SELECT t.doc_id, count(CASE WHEN kind = 'assign' THEN 1 END)::BIGINT AS n_assign, count(CASE WHEN kind = 'access' THEN 1 END)::BIGINT AS n_access, count(CASE WHEN kind = 'hex' THEN 1 END)::BIGINT AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '')) AS base_sha256
FROM t LEFT JOIN spans s ON t.doc_id = s.doc_id GROUP BY t.doc_id
"""

def _op13_sql(depth: int = 6) -> str:
    """Trees of at most 16 ** depth leaves, level by level: those of each source, and that of the sources."""

    def fields(text: str) -> str:
        return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", text))

    # The remainder of a bit more of a checksum's division; 3988292384 is its fixed divisor.
    bits = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tables = [
        f"given AS MATERIALIZED (SELECT doc_id, source, sha256({fields('text')}) AS leaf, CASE WHEN xor({bits}, 4294967295) % 5 = 0 THEN sha256({fields(low)}) END AS changed FROM documents)",
        "i0 AS MATERIALIZED (SELECT doc_id, source AS g, leaf AS digest, coalesce(changed, leaf) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS many FROM given)",
    ]

    def climb(name: str) -> None:
        for k in range(1, depth + 1):
            tables.append(f"{name}r{k} AS MATERIALIZED (SELECT g, pos // 16 AS pos, string_agg(digest, '' ORDER BY pos) AS run, (max(many) + 15) // 16 AS many FROM {name}{k - 1} WHERE many > 1 GROUP BY g, pos // 16)")
            tables.append(f"{name}{k} AS MATERIALIZED (SELECT g, pos, many, sha256(run) AS digest FROM {name}r{k})")
        tables.append(f"{name}top AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT g, digest FROM {name}{k} WHERE many = 1" for k in range(depth + 1)) + ")")

    climb("i")
    tables.append("o0 AS MATERIALIZED (SELECT 0 AS g, g AS source, digest, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS many FROM itop)")
    climb("o")
    tables.append("s0 AS (SELECT i0.doc_id, i0.digest AS leaf, i0.h, i0.pos AS ipos, i0.g AS ig, o0.pos AS opos, 0 AS og, o0.digest AS subroot, '' AS beside FROM i0 JOIN o0 ON i0.g IS NOT DISTINCT FROM o0.source)")
    n = 0
    for name in "io":
        for k in range(1, depth + 1):
            at = f"64 * (s.{name}pos // {16 ** (k - 1)} % 16)"
            left, right = f"substr(r.run, 1, {at})", f"substr(r.run, {at} + 65)"
            tables.append(
                f"s{n + 1} AS MATERIALIZED (SELECT s.* EXCLUDE (h, beside), CASE WHEN r.run IS NULL THEN s.h ELSE sha256({left} || s.h || {right}) END AS h, s.beside || coalesce({left} || {right}, '') AS beside "
                f"FROM s{n} s LEFT JOIN {name}r{k} r ON r.g IS NOT DISTINCT FROM s.{name}g AND r.pos = s.{name}pos // {16**k})"
            )
            n += 1
    return f"WITH {', '.join(tables)} SELECT doc_id, leaf, subroot, otop.digest AS root, sha256(beside) AS proof_sha256, h AS folded_root, h = otop.digest AS verified FROM s{n}, otop"


OP13_SQL = _op13_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_bayes": op3_quality_bayes,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_word_bpe": op11_word_bpe,
    "op12_whitening": op12_whitening,
    "op13_merkle": op13_merkle,
    "quality_of_pages": quality_of_pages,
}
SQL: dict[str, str] = {"op2_near_dedup": OP2_SQL, "op10_line_dedup": OP10_SQL, "op13_merkle": OP13_SQL}
