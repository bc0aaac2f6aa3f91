"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, brown, chat, exact, licenses, merkle, neighbours, packing, quality, secrets, simhash, toxicity, whitening
from .common import table


def op1_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op2_secrets(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark, sf_dir):
    return neighbours.near_groups(table(spark, sf_dir, "embeddings"))


def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_simhash_dedup(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    found = chat.recover_roles(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "block", "role", "found_role", F.sha2("rendered", 256).alias("rendered_sha256"))


def op8_licenses(spark, sf_dir):
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op9_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op10_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_lm_scores(spark, sf_dir):
    return brown.score_texts(table(spark, sf_dir, "documents"))


def op13_merkle(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality, op2_secrets, op3_exact_dedup, op4_embedding_dedup, op5_packing, op6_simhash_dedup, op7_chat_format, op8_licenses, op9_bpe, op10_toxicity, op11_whitening, op12_lm_scores, op13_merkle, pipeline)}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)""",
    "op8_licenses": r"""
        WITH t(license, notice) AS (VALUES %s),
        src AS (SELECT license, notice AS text, NULL::BIGINT AS doc_id FROM t UNION ALL SELECT NULL, text, doc_id FROM documents),
        w AS (SELECT license, doc_id, row_number() OVER () AS r, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM src),
        s AS (SELECT license, doc_id, r, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS sh
              FROM (SELECT *, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 4)),
        p AS (SELECT license, sh FROM s WHERE license IS NOT NULL GROUP BY ALL),
        n AS (SELECT license, count(*) AS n FROM p GROUP BY 1),
        d AS (SELECT doc_id, r, sh, min(i) - 1 AS place FROM s WHERE license IS NULL GROUP BY ALL),
        short AS (SELECT license, ' ' || array_to_string(ws, ' ') || ' ' AS run FROM w WHERE license IS NOT NULL AND len(ws) BETWEEN 1 AND 4),
        l AS (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM w WHERE license IS NULL)
        SELECT doc_id, license, round(count(*) / max(n.n), 6) AS share, CAST(min(place) AS INTEGER) AS first_word
        FROM d JOIN p USING (sh) JOIN n USING (license) GROUP BY doc_id, r, license HAVING count(*) / max(n.n) >= 0.8
        UNION ALL
        SELECT doc_id, license, 1.0::DOUBLE, CAST(len(string_split(left(line, strpos(line, run)), ' ')) - 2 AS INTEGER) FROM l JOIN short ON contains(line, run)"""
    % ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in sorted(licenses.ALL.items())),
    "op13_merkle": r"""
        WITH RECURSIVE
        c AS (SELECT doc_id AS id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
              lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS state
              FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
        t AS (SELECT *, CASE WHEN xor(state, 4294967295) %% 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low
              FROM documents LEFT JOIN c ON id = doc_id),
        d AS (SELECT row_number() OVER () AS r, doc_id, source, %s AS leaf, %s AS other FROM t),
        n1 AS (SELECT source AS s, 0 AS lvl, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n, r FROM d
               UNION ALL SELECT s, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), max(n + 15) // 16, NULL FROM n1 WHERE n > 1 GROUP BY s, lvl, i // 16),
        k1 AS (SELECT s, lvl, i // 16 AS p, list(h ORDER BY i) AS k FROM n1 WHERE n > 1 GROUP BY ALL),
        f1 AS (SELECT r, s, lvl, i, '' AS proof, other AS fold FROM n1 JOIN d USING (r)
               UNION ALL SELECT r, f1.s, f1.lvl + 1, p, proof || array_to_string(k[1:i %% 16], '') || array_to_string(k[i %% 16 + 2:], ''),
                                sha256(array_to_string(k[1:i %% 16], '') || fold || array_to_string(k[i %% 16 + 2:], ''))
               FROM f1 JOIN k1 ON k1.s IS NOT DISTINCT FROM f1.s AND k1.lvl = f1.lvl AND p = i // 16),
        n2 AS (SELECT s, lvl AS own, 0 AS lvl, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM n1 WHERE n = 1
               UNION ALL SELECT NULL, NULL, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), max(n + 15) // 16 FROM n2 WHERE n > 1 GROUP BY lvl, i // 16),
        k2 AS (SELECT lvl, i // 16 AS p, list(h ORDER BY i) AS k FROM n2 WHERE n > 1 GROUP BY ALL),
        f2 AS (SELECT r, n2.h AS subroot, 0 AS lvl, n2.i, proof, fold FROM f1 JOIN n2 ON f1.s IS NOT DISTINCT FROM n2.s AND f1.lvl = own AND n2.lvl = 0
               UNION ALL SELECT r, subroot, f2.lvl + 1, p, proof || array_to_string(k[1:i %% 16], '') || array_to_string(k[i %% 16 + 2:], ''),
                                sha256(array_to_string(k[1:i %% 16], '') || fold || array_to_string(k[i %% 16 + 2:], ''))
               FROM f2 JOIN k2 ON k2.lvl = f2.lvl AND p = i // 16)
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
        FROM f2 JOIN (SELECT lvl, h FROM n2 WHERE n = 1) USING (lvl) JOIN d USING (r)"""
    % tuple("sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", last)) + ")" for last in ("text", "low")),
}
