"""The registered queries of this subpackage, and the same results as DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT r, doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, ws FROM d),
win AS (SELECT r, doc_id, pos, array_to_string(ws[pos + 1 : pos + 13], ' ') AS s FROM w WHERE pos + 13 <= len(ws)),
dup AS (SELECT r, pos FROM (SELECT r, doc_id, pos, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
cov AS (SELECT DISTINCT r, pos + k AS pos FROM dup, range(13) t(k)),
kept AS (SELECT w.r, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.pos) AS s FROM w LEFT JOIN cov USING (r, pos) WHERE cov.r IS NULL GROUP BY w.r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import ngram_jaccard

    out = ngram_jaccard(_read(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') AS ws FROM documents),
p AS (SELECT r, doc_id, ws, unnest(range(greatest(len(ws) - 3, 1))) AS i FROM d WHERE len(ws) > 0),
sh AS MATERIALIZED (SELECT DISTINCT r, doc_id, array_to_string(ws[i + 1 : i + 4], ' ') AS s FROM p),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
common AS MATERIALIZED (SELECT a.r AS x, b.r AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
link AS MATERIALIZED (SELECT x, y FROM common JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN reach ON reach.x = d.r JOIN d e ON e.r = reach.y GROUP BY d.r, d.doc_id
"""

#: Byte limit of a shard.
SHARD_BYTES = 1 << 20


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import extendible_shards

    out = extendible_shards(_read(spark, sf_dir, "documents"), SHARD_BYTES)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "depth", "prefix", "part")


OP6_SQL = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 64 AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS h FROM documents),
lv AS (SELECT doc_id, n_bytes, depth, h >> CAST(48 - depth AS INT) AS prefix FROM d, range(25) t(depth)),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS b FROM lv)
SELECT doc_id, any_value(n_bytes) AS n_bytes, CAST(min(depth) AS INTEGER) AS depth, CAST(arg_min(prefix, depth) AS BIGINT) AS prefix, CAST(0 AS BIGINT) AS part
FROM s WHERE b <= {SHARD_BYTES} GROUP BY doc_id
"""

def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(_read(spark, sf_dir, "documents"), size=1024, tokenizer="byte_bpe_50k.json", with_ids=False)
    return out.drop("ids").withColumnRenamed("id", "doc_id")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_trees, read_back, threads

    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_trees(threads(rows))
    turns, loss = read_back(F.col("formatted"), F.col("loss"))
    out = out.select(F.col("tree").alias("conv_id"), "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _op9_sql() -> str:
    from .chat import BODY, CONTROL, END, TURN

    def esc(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for s in CONTROL:
            out = f"replace({out}, '{s}', '{s[0]}\\;{s[1:]}')"
        return out

    fixed = len(TURN) + len(BODY) + len(END)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({esc("role")}) + length({esc("text")}) + {fixed}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


#: All alignments that share a word, so with no seeds: of each, the stretches of an item are counted one by one.
OP10_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT row_number() OVER () AS it, item_id, ws FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark)),
m AS (SELECT a.r, b.it, a.p - b.q AS shift, list(b.q) AS qs FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d) a JOIN (SELECT it, unnest(ws) AS w, unnest(range(len(ws))) AS q FROM t) b USING (w) GROUP BY ALL),
c AS (SELECT d.doc_id, t.item_id, qs, greatest(0, -shift) AS lo, least(len(t.ws), len(d.ws) - shift) AS hi, least(13, len(t.ws)) AS need, CAST(ceil(CAST(0.8 AS DOUBLE) * least(13, len(t.ws))) AS BIGINT) AS enough FROM m JOIN d USING (r) JOIN t USING (it)),
good AS (SELECT *, hi - lo AS n FROM c WHERE hi - lo >= need AND len(qs) >= enough AND len(list_filter(range(lo, hi - need + 1), lambda s: len(list_filter(qs, lambda q: q >= s AND q < s + need)) >= enough)) > 0)
SELECT doc_id, item_id, count(*) AS n_hits, max(len(qs)) AS n_agree, CAST(max(n) AS BIGINT) AS n_aligned FROM good GROUP BY ALL
"""


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, CAST(list_inner_product(CAST(qe AS DOUBLE[]), CAST(e AS DOUBLE[])) AS BIGINT) AS score FROM q JOIN v ON vec_id <> query_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    out = suffix_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


def _op4_sql(length: int = 100) -> str:
    """Strings of ``length`` bytes are told apart by doubling: the class of a string of 2k bytes is that of its halves."""
    steps, k = [], 1
    while 2 * k < length:
        steps.append(f"t{2 * k} AS (SELECT r, doc_id, i, min(g) OVER (PARTITION BY x, y) AS x, g FROM (SELECT r, doc_id, i, g, x, lead(x, {k}) OVER (PARTITION BY r ORDER BY i) AS y FROM t{k}))")
        k *= 2
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents),
b AS MATERIALIZED (SELECT r, doc_id, unnest(bs) AS byte, unnest(range(len(bs))) AS i, len(bs) AS n FROM d),
t1 AS (SELECT r, doc_id, i, dense_rank() OVER (ORDER BY byte) AS x, row_number() OVER () AS g FROM b),
{", ".join(steps)},
w AS (SELECT r, doc_id, i, x, lead(x, {length - k}) OVER (PARTITION BY r ORDER BY i) AS y, lead(i, {length - 1}) OVER (PARTITION BY r ORDER BY i) AS last_ FROM t{k}),
dup AS (SELECT r, i FROM (SELECT r, i, doc_id, min((doc_id, i)) OVER (PARTITION BY x, y) AS first_ FROM w WHERE last_ IS NOT NULL) WHERE (doc_id, i) > first_),
cov AS (SELECT b.r, b.i, b.byte, max(dup.i) OVER (PARTITION BY b.r ORDER BY b.i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM b LEFT JOIN dup ON dup.r = b.r AND dup.i = b.i),
run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS starts FROM cov),
one AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM run GROUP BY r)
SELECT d.doc_id, CAST(len(bs) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN one USING (r)"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxic_documents

    return toxic_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import digest, manifest

    docs = _read(spark, sf_dir, "documents")
    altered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    out = manifest(docs, list(MANIFEST_FIELDS), found={"text": F.translate("text", _UPPER, _UPPER.lower())}, altered=altered)
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return out.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", "verified")


def _op13_sql(levels: int = 6) -> str:
    """Levels of at most 16 to the power of ``levels`` leaves a source."""
    text = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join(text(t if c == "text" else c) for c in MANIFEST_FIELDS) + ")"

    def tree(name: str, nodes: str) -> str:
        """Nodes (tree, i, n, d) of all levels, and the siblings of each: those left of it and right of it."""
        out = [f"{name}0 AS MATERIALIZED ({nodes})"]
        for k in range(levels):
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i // 16 AS i, max((n + 15) // 16) AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 16)")
            out.append(f"{name}s{k} AS MATERIALIZED (SELECT a.tree, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {name}{k} a JOIN {name}{k} b ON b.tree = a.tree AND b.i // 16 = a.i // 16 WHERE a.n > 1 GROUP BY a.tree, a.i)")
        out.append(f"{name}top AS (" + " UNION ALL ".join(f"SELECT tree, d FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")
        return ",\n".join(out)

    def fold(start: str, at: str, key: str, name: str) -> str:
        """Columns p (siblings so far) and f (digest so far) up through one tree, step by step."""
        for k in range(levels):
            start = f"SELECT z.* EXCLUDE (p, f), p || coalesce(s.l || s.r, '') AS p, CASE WHEN s.l IS NULL THEN f ELSE sha256(s.l || f || s.r) END AS f FROM ({start}) z LEFT JOIN {name}s{k} s ON s.tree = z.{key} AND s.i = z.{at} // {16**k}"
        return start

    lower = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    return f"""WITH RECURSIVE crc AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM crc WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM crc WHERE k = 8),
raw AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS leaf, {leaf(lower)} AS low, CAST(doc_id AS VARCHAR) AS s FROM documents),
sums AS (SELECT raw.*, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda j: CAST(ascii(s[j]) AS BIGINT))), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1]))) AS crc FROM raw, tab),
lv AS MATERIALIZED (SELECT doc_id, tree, leaf AS d, CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS now, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM sums),
{tree("a", "SELECT tree, i, n, d FROM lv")},
tops AS MATERIALIZED (SELECT tree AS source_, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, '' AS tree FROM atop),
{tree("b", "SELECT tree, i, n, d FROM tops")},
up AS ({fold("SELECT doc_id, tree, i, d, '' AS p, now AS f FROM lv", "i", "tree", "a")}),
most AS (SELECT up.doc_id, up.d AS leaf, tops.d AS subroot, tops.i AS j, '' AS whole, up.p, up.f FROM up JOIN tops ON tops.source_ = up.tree),
done AS ({fold("SELECT * FROM most", "j", "whole", "b")})
SELECT doc_id, leaf, subroot, btop.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = btop.d AS verified FROM done, btop"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    out = whiten(_read(spark, sf_dir, "embeddings"), k=32, scale=64, shift=1_000_000)
    return out.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("long"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import BASE, license_scan

    out = license_scan(_read(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["label"].isin(*BASE))
    return out.select("doc_id", "n_words", "labels", "score", base.alias("base")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).cast("long").alias("first_word"), F.array_max(F.col("base.start")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.round("score", 6).alias("score"),
    )


def _op11_sql() -> str:
    from .licenses import BASE, NOTICES, SLACK, WORD as LICENSE_WORD, templates

    sought = templates(BASE | NOTICES)
    phrases = list(dict.fromkeys(p for t in sought for _, p in t.phrases))
    names = {p: f"s{k}" for k, p in enumerate(phrases)}
    starts = ", ".join(f"CASE WHEN contains(s, ' {' '.join(p)} ') THEN list_filter(range(len(ws)), lambda i: ws[i + 1 : i + {len(p)}] = {list(p)}) ELSE [] END AS {c}" for p, c in names.items())
    vocabulary = ", ".join(f"('{w}')" for w in sorted({w for p in phrases for w in p}))
    step = lambda at, c: f"list_transform({c}, lambda s: CAST(floor((s - {at}) / {SLACK}.0) AS BIGINT))"
    wide = lambda x: f"flatten(list_transform({x}, lambda b: [b - 1, b, b + 1]))"

    def label(t) -> str:
        (at, p), *rest = t.phrases
        if not rest:
            return f"CASE WHEN len({names[p]}) > 0 THEN '{t.label}' END"
        both = wide(step(at, names[p]))
        for at, p in rest:
            both = f"list_intersect({both}, {step(at, names[p])})"
        return f"CASE WHEN len({both}) > 0 THEN '{t.label}' END"

    weight = lambda p: " + ".join(f"f['{w}']" for w in p)
    share = lambda t: "(" + " + ".join(f"CASE WHEN len({names[p]}) > 0 THEN {weight(p)} ELSE 0 END" for _, p in t.phrases) + ") / (" + " + ".join(weight(p) for _, p in t.phrases) + ")"
    base = {t.label: names[t.phrases[0][1]] for t in sought if t.label in BASE}
    every = f"list_concat({', '.join(base.values())})"
    text = lambda items: f"coalesce(array_to_string(list_sort(list_filter([{items}], lambda x: x IS NOT NULL)), ','), '')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{LICENSE_WORD}') AS ws FROM documents),
v(w) AS (VALUES {vocabulary}),
seen AS (SELECT w, count(*) AS n FROM (SELECT DISTINCT r, unnest(ws) AS w FROM d) GROUP BY w),
idf AS MATERIALIZED (SELECT map_from_entries(list((v.w, ln(((SELECT count(*) FROM d) + 1e0) / (coalesce(n, 0) + 1e0)) + 1e0))) AS f FROM v LEFT JOIN seen USING (w)),
p AS MATERIALIZED (SELECT doc_id, len(ws) AS n_words, {starts} FROM (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS s FROM d))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base, list_min({every}) AS first_word, list_max({every}) AS last_word,
  {text(', '.join(f"CASE WHEN len({c}) > 0 THEN '{b}' END" for b, c in base.items()))} AS base_labels, {text(', '.join(map(label, sought)))} AS labels,
  round(greatest({', '.join(map(share, sought))}), 6) AS score FROM p, idf"""


QUERIES = {"op3_toxicity": op3_toxicity, "op5_language_id": op5_language_id, "op4_suffix_array_dedup": op4_suffix_array_dedup, "op1_exact_top_k": op1_exact_top_k, "op9_chat_formatting": op9_chat_formatting, "op10_decontamination": op10_decontamination, "op7_best_fit_packing": op7_best_fit_packing, "op6_sharding": op6_sharding, "op8_ngram_jaccard": op8_ngram_jaccard, "op2_substring_dedup": op2_substring_dedup, "op13_merkle_manifest": op13_merkle_manifest, "op12_embedding_whitening": op12_embedding_whitening, "op11_license_scan": op11_license_scan}
ORACLE_SQL = {"op1_exact_top_k": OP1_SQL, "op9_chat_formatting": _op9_sql(), "op6_sharding": OP6_SQL, "op8_ngram_jaccard": OP8_SQL, "op2_substring_dedup": OP2_SQL, "op13_merkle_manifest": _op13_sql(), "op11_license_scan": _op11_sql(), "op4_suffix_array_dedup": _op4_sql(), "op10_decontamination": OP10_SQL}
