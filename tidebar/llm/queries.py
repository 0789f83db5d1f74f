"""The operators applied to the whole test tables: one query for each, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat_repair, class_lm, decontaminate, manifest, mixing, near_dedup, near_vectors, secrets, suffix_dedup, toxicity, training_order, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(table(spark, sf_dir, "documents"))


def op5_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), columns=["doc_id"]).drop("copies")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_class_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(table(spark, sf_dir, "documents"), folds=10)


def op8_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op9_cross_polytope_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified_rows(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_toxicity, op3_minhash_near_dedup, op4_training_order, op5_weighted_fair_mix, op6_secret_scan, op7_class_lm_scores, op8_chat_role_repair, op9_cross_polytope_near_dedup, op10_suffix_dedup, op11_merkle_manifest, op12_vector_codes, op13_collision_search)}
#: Fixed value: a word, for DuckDB.
WORD = r"[^\x20\x09-\x0D]+"

MIX_CTE = rf"""
    d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM DOCS),
    s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
    w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
    f AS (SELECT *, total * 2.0::DOUBLE AS cap, (sum(total) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM w),
    r AS (SELECT 0 AS k, source, total, weight, cap, budget, budget / sum(weight) OVER () AS level, false AS done FROM f
        UNION ALL
        SELECT k + 1, source, total, weight, cap, budget, (budget - coalesce(sum(cap) FILTER (WHERE above) OVER (), 0)) / sum(weight) FILTER (WHERE NOT above) OVER (), above FROM (SELECT *, done OR level * weight > cap AS above, bool_or(NOT done AND level * weight > cap) OVER () AS go_on FROM r) WHERE go_on),
    t AS (SELECT source, total, weight, budget, CASE WHEN done THEN cap ELSE level * weight END AS target FROM r QUALIFY k = max(k) OVER ()),
    q AS (SELECT doc_id, d.source, size, h, total, target, weight, budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    i AS (SELECT *, ((upto + total * k)::DOUBLE / weight) AS v FROM q, (VALUES (0), (1)) p(k)),
    c AS (SELECT *, sum(size) OVER (ORDER BY v, h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 <= budget AS within FROM i),
    m AS (SELECT doc_id, size, total AS source_size, target, h, sum(CASE WHEN within THEN 1 ELSE 0 END)::BIGINT AS copies FROM c GROUP BY ALL)
"""

#: Words and shingles of documents and items, as op1 takes them.
CONTAINED = rf"""
    d0 AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM DOCS),
    i0 AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM benchmark),
    i1 AS (SELECT item_id, least(len(w), 5) AS k, w FROM i0 WHERE len(w) > 0),
    i2 AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS sh FROM i1),
    i3 AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_item FROM i2),
    d1 AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS sh FROM d0, (SELECT DISTINCT k FROM i1)),
    pairs AS (SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n_item::BIGINT AS n_item FROM d1 JOIN i3 USING (k, sh) GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(n_item * 0.8 - 1e-9))
"""

#: Spans of one kind from the pieces between the matches.
SPANS = """list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT, 'k': {k}, 'e': (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))::INT, 'kind': '{kind}', 'v': v[i]}}), lambda x: length(x.v) >= {least})"""


def secrets_sql() -> str:
    parts = []
    for k, (kind, (_, group, least)) in enumerate(secrets.KINDS.items()):
        pattern = secrets.SEARCH[kind].replace("'", "''")
        parts.append(f"t{k} AS (SELECT doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS v FROM d)")
        parts.append(f"x{k} AS (SELECT doc_id, {SPANS.format(k=k, kind=kind, least=least)} AS l{k} FROM t{k})")
    mixed = lambda v: f"(regexp_matches({v}, '[0-9]') AND regexp_matches({v}, '[A-Za-z]'))"
    share = "((length(v) - length(replace(v, c, ''))) / length(v))"
    entropy = f"round(list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -{share} * log2({share}))), 9)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents), {', '.join(parts)},
    b AS (SELECT doc_id, owner, repo, l0, l1, l2, list_sort(l0 || l1 || l2) AS base FROM d JOIN x0 USING (doc_id) JOIN x1 USING (doc_id) JOIN x2 USING (doc_id)),
    u AS (SELECT doc_id, owner, repo, unnest(base) AS x FROM b),
    h AS (SELECT x.v AS v, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM u GROUP BY x.v),
    o AS (SELECT v, owners <= {secrets.MAX_OWNERS} AND repos <= {secrets.MAX_REPOS} AND {mixed('v')} AND NOT regexp_matches(lower(v), '{secrets.PLACEHOLDER}') AND {entropy} >= {secrets.MIN_ENTROPY} AS live FROM h),
    n AS (SELECT doc_id, count_if(live) AS n_live, count_if(NOT live) AS n_copied FROM u JOIN o ON u.x.v = o.v GROUP BY doc_id),
    sh AS (SELECT DISTINCT rtrim(v, '.=') AS v FROM o WHERE live),
    wanted AS (SELECT v FROM o WHERE live UNION SELECT v FROM sh WHERE length(v) >= {secrets.LEAST_TOKEN} AND {mixed('v')} AND v NOT IN (SELECT v FROM o)),
    tb AS (SELECT doc_id, string_split_regex(text, '{secrets.RUN}') AS g, regexp_extract_all(text, '{secrets.RUN}', 0) AS m, regexp_extract_all(text, '{secrets.RUN}', 0) AS v FROM d WHERE regexp_matches(text, '{secrets.BARE_NEEDS}')),
    tk AS (SELECT doc_id, x.s AS run, x.v AS v FROM (SELECT doc_id, unnest({SPANS.format(k=3, kind='owned', least=0)}) AS x FROM tb) WHERE {mixed('x.v')}),
    p0 AS (SELECT doc_id, run, v, string_split(v, '=') AS w, unnest(range(1, len(string_split(v, '=')) + 1)) AS k FROM tk),
    p1 AS (SELECT doc_id, run, v, coalesce(list_sum(list_transform(w[1:k - 1], lambda y: length(y) + 1)), 0)::INT AS off FROM p0 WHERE k = 1 OR w[k] <> ''),
    p2 AS (SELECT DISTINCT doc_id, run, run + off AS s, unnest([substr(v, off + 1), rtrim(substr(v, off + 1), '.=')]) AS f FROM p1),
    p3 AS (SELECT p2.doc_id, run, {{'s': s::INT, 'k': 3, 'e': (s + length(f))::INT, 'kind': 'owned', 'v': f}} AS x FROM p2 JOIN wanted ON f = wanted.v WHERE length(f) >= {secrets.LEAST_TOKEN} AND {mixed('f')}),
    p4 AS (SELECT p3.* FROM p3 JOIN b USING (doc_id) WHERE len(list_filter(b.base, lambda y: y.s < p3.x.e AND y.e > p3.x.s)) = 0 QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY p3.x.s, p3.x.e DESC) = 1),
    m AS (SELECT doc_id, list(x) AS more FROM p4 GROUP BY doc_id)
SELECT b.doc_id, len(l0)::BIGINT AS n_assign, len(l1)::BIGINT AS n_access, len(l2)::BIGINT AS n_hex,
    sha256(array_to_string(list_transform(base, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')) AS base_sha256,
    array_to_string(list_transform(list_sort(base || coalesce(more, [])), lambda x: x.kind || ':' || x.s || ':' || x.e), ',') AS spans,
    coalesce(len(more), 0)::BIGINT AS n_added, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM b LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def levels_sql(name: str, source: str, grp: str, levels: int) -> str:
    """Nodes (grp, pos, n, h) of all levels of eight-ary trees as CTEs name0, name1, ...; n is the number of nodes of a group on the level."""
    parts = [f"{name}0 AS (SELECT {grp} AS grp, pos, n, h FROM {source})"]
    for k in range(levels):
        parts.append(f"{name}{k + 1} AS (SELECT grp, pos // 8 AS pos, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
    return ", ".join(parts)


def manifest_sql(levels: int = 7, top: int = 3) -> str:
    """Enough for 8^levels rows of a language and 8^top languages."""
    frame = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*(frame(c) for c in ("doc_id", "source", "lang", "n_chars")), frame(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 by its definition, bit by bit.
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    ctes = [
        f"b AS (SELECT doc_id, lang, {leaf('text')} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS seen FROM documents)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS grp FROM b)",
        levels_sql("t", "l", "grp", levels),
        "sr AS (" + " UNION ALL ".join(f"SELECT grp, h FROM t{k} WHERE n = 1" for k in range(levels + 1)) + ")",
        "s AS (SELECT 0 AS z, grp AS pos, count(*) OVER () AS n, h FROM sr)",
        levels_sql("g", "s", "z", top),
        "rt AS (" + " UNION ALL ".join(f"SELECT h FROM g{k} WHERE n = 1" for k in range(top + 1)) + ")",
        "f0 AS (SELECT doc_id, l.grp, pos, l.h AS leaf, sr.h AS subroot, seen AS f, '' AS proof FROM l JOIN sr USING (grp))",
    ]
    step = 0
    for name, count, group, place in (("t", levels, "x.grp", "x.pos"), ("g", top, "0", "x.grp")):
        for k in range(count):
            at = f"{place} // {8**k}"
            sides = f"SELECT p.grp, p.pos, coalesce(string_agg(q.h, '' ORDER BY q.pos) FILTER (WHERE q.pos < p.pos), '') AS a, coalesce(string_agg(q.h, '' ORDER BY q.pos) FILTER (WHERE q.pos > p.pos), '') AS z FROM {name}{k} p JOIN {name}{k} q ON p.grp = q.grp AND p.pos // 8 = q.pos // 8 WHERE p.n > 1 GROUP BY p.grp, p.pos"
            ctes.append(f"f{step + 1} AS (SELECT x.* EXCLUDE (f, proof), CASE WHEN y.a IS NULL THEN f ELSE sha256(y.a || f || y.z) END AS f, CASE WHEN y.a IS NULL THEN proof ELSE proof || y.a || y.z END AS proof FROM f{step} x LEFT JOIN ({sides}) y ON y.grp = {group} AND y.pos = {at})")
            step += 1
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, (SELECT h FROM rt) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT h FROM rt) AS verified FROM f{step}"


#: Vectors with finite components only, in double precision.
VECTORS = "SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def codes_sql() -> str:
    """Squared distances of all parts to all entries, each round anew."""
    ctes = [
        f"r AS ({VECTORS})",
        "x AS MATERIALIZED (SELECT r, vec_id, label, (j - 1) // (len(v) // 4) AS part, (j - 1) % (len(v) // 4) AS i, floor(v[j] * 1024)::BIGINT AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS j FROM r))",
        "b0 AS MATERIALIZED (SELECT part, r - 1 AS e, i, x AS c FROM x WHERE r <= 256)",
    ]
    for k in range(vector_codes.ROUNDS + 1):
        ctes.append(f"n{k} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'e': e}}) AS m FROM (SELECT r, x.part, e, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN b{k} b ON x.part = b.part AND x.i = b.i GROUP BY ALL) GROUP BY ALL)")
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, b.i, coalesce(floor(s / n)::BIGINT, c) AS c FROM b{k} b LEFT JOIN (SELECT x.part, m.e AS e, i, sum(x)::DOUBLE AS s, count(*) AS n FROM x JOIN n{k} USING (r, part) GROUP BY ALL) y USING (part, e, i))")
    last = vector_codes.ROUNDS
    return f"WITH {', '.join(ctes[:-1])}, o AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM n{last} GROUP BY r) SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, e, i)) FROM b{last}) AS codebooks_sha256 FROM o JOIN r USING (r)"


ORACLES: dict[str, str] = {
    "op12_vector_codes": codes_sql(),
    "op11_merkle_manifest": manifest_sql(),
    "op1_benchmark_decontamination": f"WITH {CONTAINED.replace('DOCS', 'documents')} SELECT * FROM pairs",
    "op6_secret_scan": secrets_sql(),
    "op5_weighted_fair_mix": f"WITH RECURSIVE {MIX_CTE.replace('DOCS', 'documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM m",
}
