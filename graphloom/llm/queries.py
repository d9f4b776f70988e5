"""One query for each operator, over whole tables, and DuckDB SQL where it can express one.

The queries are thin: they apply an operator with production parameters and derive the
contract's digest columns from its output.
"""

from __future__ import annotations

import public_tokenizers

from graphloom.llm import bpe, clustering, decontamination, exact_dedup, importance, language, minhash_dedup, packing, pii, secrets, substring_dedup, token_counts, token_files
from graphloom.llm.shared import scratch

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_substring_dedup(spark, sf_dir):
    index = substring_dedup.FingerprintIndex(spark, scratch(spark, "fingerprints"))
    return substring_dedup.report(table(spark, sf_dir, "documents"), index)


def op3_decontamination(spark, sf_dir):
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op5_token_files(spark, sf_dir):
    path = scratch(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), BYTE_BPE, path)
    return token_files.documents(spark, path)


def op6_language(spark, sf_dir):
    return language.report(table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.counts(table(spark, sf_dir, "documents"), PIECE_BPE)


def op10_minhash_dedup(spark, sf_dir):
    return minhash_dedup.components(table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_packing(spark, sf_dir):
    path = scratch(spark, "packing")
    packing.write(table(spark, sf_dir, "documents"), BYTE_BPE, path)
    return packing.pieces(spark, path)


def op12_clustering(spark, sf_dir):
    return clustering.report(table(spark, sf_dir, "embeddings"))


def op13_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_files": op5_token_files,
    "op6_language": op6_language,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_token_counts": op9_token_counts,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_packing": op11_packing,
    "op12_clustering": op12_clustering,
    "op13_importance": op13_importance,
}

def _rounds(rounds: int) -> str:
    """SQL of some rounds of clustering: assignments a0, a1, ... and centroids c0, c1, ..."""
    assign = """a{n} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min({{'d': d, 'k': k}}) AS best FROM (
            SELECT vec_id, kept.x, k, list_sum(list_transform(list_zip(kept.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{n} c) GROUP BY vec_id)"""
    move = """s{n} AS (SELECT best.k AS k, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{n}),
        m{n} AS (SELECT k, pos, sum(v)::BIGINT AS s, count(*) AS n FROM s{n} GROUP BY k, pos),
        c{next} AS MATERIALIZED (SELECT c.k, coalesce(new.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x FROM m{n} GROUP BY k) new USING (k))"""
    return ",\n        ".join([*(part.format(n=n, next=n + 1) for n in range(rounds) for part in (assign, move)), assign.format(n=rounds)])


ORACLES = {
    "op13_importance": r"""
        WITH RECURSIVE bits(i, j, c) AS (SELECT i, 0, i FROM range(256) x(i) UNION ALL SELECT i, j + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE j < 8),
        crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE j = 8),
        texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
        w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
        f AS MATERIALIZED (SELECT side, id, array_to_string(words[i:i + n - 1], ' ') AS feature, count(*) AS n FROM w, range(1, 4) g(n), UNNEST(range(1, len(words) - n + 2)) AS t(i) GROUP BY ALL),
        h AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)),
        k AS MATERIALIZED (SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1:2 * i])::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM h, crc),
        s AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM f JOIN k USING (feature) GROUP BY bucket),
        gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM s),
        o AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN k USING (feature) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
        p AS (SELECT id AS doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT AS h FROM w LEFT JOIN o USING (id) WHERE side = 0),
        q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM p),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM q WHERE n_words >= 20)
        SELECT q.doc_id, n_features, weight, score, CASE WHEN place <= floor(5 * n / 100) THEN place END AS rank FROM q LEFT JOIN ranked USING (doc_id)""",
    "op12_clustering": f"""
        WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x FROM kept QUALIFY k < 16),
        {_rounds(3)}
        SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
        FROM a3 JOIN c3 ON c3.k = best.k""",
    "op2_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        k AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS seq FROM w, UNNEST(range(1, len(words) - 48)) AS t(i) WHERE len(words) >= 50),
        f AS (SELECT seq, min(doc_id) AS first FROM k GROUP BY seq),
        gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i FROM k JOIN f USING (seq) WHERE doc_id > first), UNNEST(range(0, 50)) AS t(j)),
        p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
        r AS (SELECT doc_id, count(*) AS n_words, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE gone.pos IS NULL) AS kept
              FROM p LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN r USING (doc_id)""",
    "op3_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split(translate(lower(coalesce(text, '')), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || PUNCTUATION, '     '), ' '), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(string_split(translate(lower(coalesce(text, '')), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || PUNCTUATION, '     '), ' '), lambda x: x <> '') AS v FROM benchmark),
        dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        bw AS (SELECT item_id, len(v) AS n_words, unnest(v) AS word, generate_subscripts(v, 1) AS q FROM b),
        a AS (SELECT doc_id, item_id, n_words, p - q AS start, q FROM dw JOIN bw USING (word)),
        s AS (SELECT doc_id, item_id, n_words, start, count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS hits FROM a),
        best AS (SELECT doc_id, item_id, start, n_words, CAST(max(hits) AS DOUBLE) / least(n_words, 13) AS score FROM s GROUP BY ALL)
        SELECT doc_id, item_id, start, n_words, score FROM best WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, start) = 1""".replace(
        "PUNCTUATION", "'" + decontamination.PUNCTUATION.replace("'", "''") + "'"
    ),
    "op10_minhash_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        sh AS (SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS s FROM w, UNNEST(range(1, greatest(len(words), 2))) AS t(i) WHERE len(words) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
        e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        r AS (SELECT x AS doc_id, x AS node FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.node),
        c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
