"""Queries ``opN_<name>`` over whole tables and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F  # noqa: F401

from retailforge.llm import common

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            common.prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@query("op8_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
           FROM documents),
r AS (SELECT doc_id, t, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k,
             count(*) OVER (PARTITION BY t) AS group_size
      FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r""")
def op8_exact_dedup(spark, sf_dir):
    """Equal texts of documents by content sort."""
    from retailforge.llm.exactdedup import exact_duplicates
    return exact_duplicates(common.table(spark, sf_dir, "documents"))


@query("op2_decontamination", r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
grams AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
          FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)),
hit AS (SELECT g.doc_id, g.i, g.m, win.item_id FROM grams g JOIN win ON g.g = win.g AND g.m = win.m),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op2_decontamination(spark, sf_dir):
    """Hit words and items of every document against the whole benchmark."""
    from retailforge.llm import decontam as D
    found = D.contamination(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    return (found.withColumn("n_hit", D.hit_words())
            .select("row.doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), D.contaminated().alias("contaminated")))


@query("op7_line_dedup", r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
             FROM documents WHERE text IS NOT NULL),
spaced AS (SELECT doc_id, i, l, trim(regexp_replace(l, '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS s FROM raw),
tok AS (SELECT *, string_split(m, ' ') AS t, replace(replace(m, '<*>', ''), ' ', '') = '' AS literal
        FROM (SELECT *, regexp_replace(s, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM spaced WHERE s <> '')),
path AS (SELECT doc_id, i, l, t, len(t) AS n, CASE WHEN literal THEN s ELSE array_to_string(t[1:3], ' ') END AS ld,
                CASE WHEN literal THEN s ELSE m END AS line FROM tok),
rep AS (SELECT doc_id, string_agg(DISTINCT line, chr(10) ORDER BY line) AS rep FROM path GROUP BY doc_id),
lns AS (SELECT DISTINCT rep, n, ld, line FROM path JOIN rep USING (doc_id)),
leaves AS (SELECT n, ld, count(*) AS total FROM lns WHERE n > 3 GROUP BY n, ld HAVING count(DISTINCT line) > 1 AND count(*) >= 3),
variants AS (SELECT n, ld, line, string_split(line, ' ') AS t, any_value(total) AS total, count(*) AS m FROM lns JOIN leaves USING (n, ld) GROUP BY n, ld, line),
votes AS (SELECT n, ld, p, token FROM (SELECT n, ld, total, m, unnest(t) AS token, unnest(range(1, n + 1)) AS p FROM variants)
          WHERE p > 3 GROUP BY n, ld, total, p, token HAVING sum(m) * 2 > total),
agreed AS (SELECT v.n, v.ld, v.line FROM (SELECT n, ld, line, unnest(t) AS token, unnest(range(1, n + 1)) AS p FROM variants) v
           JOIN votes USING (n, ld, p, token) GROUP BY v.n, v.ld, v.line HAVING count(*) + 3 >= v.n * 0.7::DOUBLE),
named AS (SELECT c.*, CASE WHEN a.line IS NOT NULL THEN '' ELSE c.line END AS template
          FROM lns c LEFT JOIN agreed a ON c.n = a.n AND c.ld = a.ld AND c.line = a.line),
same AS (SELECT rep, string_agg(DISTINCT n || '|' || ld || '|' || template, chr(10) ORDER BY n || '|' || ld || '|' || template) AS same FROM named GROUP BY rep),
recurring AS (SELECT n, ld, template FROM named JOIN same USING (rep) GROUP BY n, ld, template
              HAVING count(DISTINCT same) >= CASE WHEN n <= 3 THEN 10 ELSE 3 END),
hits AS (SELECT rep, named.line, recurring.n IS NOT NULL AS hit FROM named LEFT JOIN recurring USING (n, ld, template)),
partly AS (SELECT rep FROM hits GROUP BY rep HAVING NOT bool_and(hit)),
gone AS (SELECT DISTINCT doc_id, line FROM hits JOIN partly USING (rep) JOIN rep USING (rep) WHERE hit),
kept AS (SELECT r.doc_id, count(*) AS n_lines, count(g.line) AS n_dropped,
                coalesce(string_agg(r.l, chr(10) ORDER BY r.i) FILTER (g.line IS NULL), '') AS kept
         FROM raw r LEFT JOIN path p ON r.doc_id = p.doc_id AND r.i = p.i LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.line = g.line
         GROUP BY r.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped,
       CAST(length(kept) AS INTEGER) AS kept_chars, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)""")
def op7_line_dedup(spark, sf_dir):
    """Lines of recurring templates left out of every document."""
    from retailforge.llm.linededup import deduplicate_lines
    out = deduplicate_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.length("kept_text").alias("kept_chars"),
                      F.sha2("kept_text", 256).alias("kept_sha256"))


VOCABULARY = "byte_bpe_50k.json"


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    """Exact token count of every document, and the longest prefix within the limit."""
    from retailforge.llm.tokencount import token_counts
    out = token_counts(common.table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, limit=1024)
    return out.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fit_chars")


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 1024 tokens."""
    from retailforge.llm.packing import pack_documents
    return pack_documents(common.table(spark, sf_dir, "documents"), VOCABULARY)


_ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
           + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")


def _duck_spans(kind: str, order: int, pattern: str, test: str) -> str:
    return (f"SELECT doc_id, {order} AS o, '{kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x))) "
            f"+ coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, m[i] AS hit "
            f"FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, "
            f"regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)) WHERE {test}")


@query("op1_secret_scan", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_duck_spans('assign', 0, _ASSIGN, f"length(regexp_extract(m[i], '{_ASSIGN}', 2)) >= 6")}
UNION ALL {_duck_spans('access', 1, 'AKIA[A-Z0-9]+', 'length(m[i]) >= 20')}
UNION ALL {_duck_spans('hex', 2, '[0-9a-f]+', 'length(m[i]) >= 24')}
UNION ALL {_duck_spans('github', 3, 'gh[pousr]_[A-Za-z0-9]{36,}', 'TRUE')}
UNION ALL {_duck_spans('pem', 4, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 'TRUE')}),
named AS (SELECT doc_id, o, kind, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(hit) AS BIGINT) AS x FROM found),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, string_agg(x, ',' ORDER BY s, o) FILTER (o < 3) AS base,
             string_agg(x, ',' ORDER BY s, o) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)""")
def op1_secret_scan(spark, sf_dir):
    """Secrets of every document."""
    from retailforge.llm import secrets as S
    out = S.scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", *[S.count_of("base_spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                      F.sha2(S.listed("base_spans"), 256).alias("base_sha256"), S.listed("all_spans").alias("spans"))


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    """Language of every document."""
    from retailforge.llm import langid as L
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = L.identify(docs.select("doc_id", "text"), L.fit(docs))
    out = out.select("row.doc_id", "lang_pred", "score")
    return out.select("doc_id", L.is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op4_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, string_agg(g, '|' ORDER BY g) AS s FROM g GROUP BY doc_id),
c AS (SELECT s, min(doc_id) AS class_id, count(*) AS copies, any_value(n) AS n FROM n GROUP BY s),
cg AS (SELECT g.g, c.class_id, c.n, c.copies FROM c JOIN g ON g.doc_id = c.class_id),
p AS (SELECT a.class_id AS x, b.class_id AS y, any_value(b.copies) AS copies
      FROM cg a JOIN cg b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id
      HAVING count(*) * 5 >= 4 * (any_value(a.n) + any_value(b.n) - count(*))),
r(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
grp AS (SELECT x, min(y) AS y FROM r GROUP BY x),
l AS (SELECT x, count(*) AS links, sum(copies) AS docs FROM p GROUP BY x)
SELECT w.doc_id, coalesce(c.class_id, w.doc_id) AS class_id, coalesce(least(c.class_id, grp.y), w.doc_id) AS group_id,
       CAST(coalesce(l.docs, 0) + coalesce(c.copies, 1) - 1 AS BIGINT) AS n_links, coalesce(l.links, 0) AS n_near_classes
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON n.s = c.s LEFT JOIN l ON l.x = c.class_id LEFT JOIN grp ON grp.x = c.class_id""")
def op4_jaccard_join(spark, sf_dir):
    """Near duplicates of all documents: class, group and number of links of each."""
    from retailforge.llm.jaccard import similar_documents
    return similar_documents(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_id", "n_links", "n_near_classes")


@query("op10_html_extraction")
def op10_html_extraction(spark, sf_dir):
    """Main text of every page."""
    from retailforge.llm.wrapper import extract
    out = extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_lm_scoring")
def op5_lm_scoring(spark, sf_dir):
    """Log probability of every document under the interpolated model and under the unigram base."""
    from retailforge.llm.lm import score_texts
    out = score_texts(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _code_sql(parts: int = 4, length: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd rounds written out: c0, c1, ... are the codebooks, a0, a1, ... the assignments."""
    x, c = f"range(1, {length + 1})", "CAST(floor(sum(x[i]) / count(*)) AS BIGINT)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, m, any_value(x) AS x, min(d * 256 + k) AS dk
 FROM (SELECT vec_id, p.m, x, k, CAST(list_sum(list_transform({x}, lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d
       FROM p JOIN c{r} USING (m)) GROUP BY vec_id, m)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.m, o.k, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN
 (SELECT m, k, list(s ORDER BY i) AS c FROM (SELECT m, dk % 256 AS k, i, {c} AS s FROM a{r}, {x} t(i) GROUP BY ALL) GROUP BY m, k) n
 ON o.m = n.m AND o.k = n.k)""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS MATERIALIZED (SELECT vec_id, m, list_slice(e, m * {length} + 1, m * {length} + {length}) AS x FROM v, range({parts}) t(m)),
c0 AS MATERIALIZED (SELECT m, k, x AS c FROM (SELECT m, x, row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1 AS k FROM p) WHERE k < {entries}),
{", ".join(steps)},
done AS (SELECT vec_id, string_agg(printf('%02x', dk % 256), '' ORDER BY m) AS code, CAST(sum(dk // 256) AS BIGINT) AS error
         FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY m, k)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM done JOIN v USING (vec_id), book"""


@query("op11_vector_codes", _code_sql())
def op11_vector_codes(spark, sf_dir):
    """Product codes of all embeddings and the errors summed per label."""
    from retailforge.llm import vectorcode as C
    from retailforge.session import stage
    out, books = C.compress(common.table(spark, sf_dir, "embeddings"))
    out = stage(out.select(F.col("row.vec_id").alias("vec_id"), F.col("row.label").alias("label"), "codes", "error"), "vector-codes")
    total = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    total = F.broadcast(total) if common.small_enough(total, 1_000_000) else total
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code")
    return (out.join(total, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", code, "error", "label_error", F.lit(C.codebooks_sha256(books)).alias("codebooks_sha256")))


@query("op12_embedding_near_dedup", r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
u AS MATERIALIZED (SELECT vec_id, v, len(v) AS d, sqrt(list_dot_product(v, v)) AS n FROM v WHERE list_dot_product(v, v) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.d = b.d
                   WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9::DOUBLE),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(c.y, e.vec_id), e.vec_id) AS component_id,
       coalesce(least(c.y, e.vec_id), e.vec_id) = e.vec_id AS kept, 1.0::DOUBLE AS audit_recall
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id""")
def op12_embedding_near_dedup(spark, sf_dir):
    """Links and components of all embeddings at cosine 0.9."""
    from retailforge.llm.neargraph import near_duplicates
    out = near_duplicates(common.table(spark, sf_dir, "embeddings"))
    out = out.select("row.vec_id", "n_links", "component_id", "audit_recall")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd rounds written out: c0, c1, ... are the centroids, a0, a1, ... the assignments."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(d * 64 + k) AS dk
 FROM (SELECT vec_id, x, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM v, c{r})
 GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN
 (SELECT k, list(s ORDER BY i) AS c FROM (SELECT dk % 64 AS k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS s FROM a{r}, range(1, 65) t(i)
  GROUP BY ALL) GROUP BY k) n ON o.k = n.k)""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x AS c FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v) ORDER BY h LIMIT {k}),
{", ".join(steps)},
f AS (SELECT vec_id, CAST(dk % 64 AS INTEGER) AS cluster, dk // 64 AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN c{rounds} ON cluster = k"""


@query("op13_centroid_clustering", _cluster_sql())
def op13_centroid_clustering(spark, sf_dir):
    """All embeddings in 40 clusters."""
    from retailforge.llm import clustering as C
    out, centroids = C.cluster_vectors(common.table(spark, sf_dir, "embeddings"), 40)
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per cluster
    per = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))]) if len(centroids) else F.array(F.lit(0).cast("long"))
    sha = F.array(*[F.lit(h) for h in C.centroid_sha256(centroids)]) if len(centroids) else F.array(F.lit(""))
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", per[F.col("cluster")].alias("cluster_inertia"),
                      F.lit(sum(sums.values())).cast("long").alias("inertia"), sha[F.col("cluster")].alias("centroid_sha256"))


@query("pipeline")
def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
