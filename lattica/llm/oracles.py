"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

#: The 256 remainders of CRC-32, as a list.
CRC_TABLE = (
    "(SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b: "
    "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"
)


def crc32_sql(text: str, table: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; ``table`` is a column with the remainders."""
    digit = lambda h: f"(instr('0123456789ABCDEF', {h}) - 1)"
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: 16 * {digit('h[1]')} + {digit('h[2]')})"
    return f"xor(4294967295, list_reduce({codes}, lambda a, b: xor(a >> 8, {table}[1 + xor(a & 255, b)]), 4294967295::BIGINT))"


def centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds unrolled: a table of centroids and one of assignments for each."""
    dims = "generate_series(1, 64)"
    parts = [
        "v AS (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS (SELECT row_id, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.row_id, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d"
            f" FROM v, c{i} c) GROUP BY row_id)"
        )
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, k, floor(sum(x[k])::DOUBLE / count(*))::BIGINT AS m FROM v JOIN a{i} USING (row_id), {dims} g(k) GROUP BY c, k)")
            parts.append(f"m{i} AS (SELECT c, list(m ORDER BY k) AS x FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))")
    return (
        "WITH " + ", ".join(parts) + f" SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,"
        f" (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (row_id) JOIN c{rounds} USING (c)"
    )


APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def importance_sql() -> str:
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(string_split_regex({lower.format('coalesce(text, $$$$)')}, '{APART}'), lambda w: w <> '')"
    return f"""WITH t AS (SELECT {CRC_TABLE} AS crcs),
d AS (SELECT row_number() OVER () AS row_id, doc_id, {words} AS ws FROM documents),
dw AS (SELECT row_id, unnest(ws) AS w FROM d),
bw AS (SELECT unnest({words}) AS w FROM benchmark),
h AS MATERIALIZED (SELECT w, {crc32_sql('w', 'crcs')} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), t),
s AS (SELECT b, count(*) AS n FROM dw JOIN h USING (w) GROUP BY b),
g AS (SELECT b, count(*) AS n FROM bw JOIN h USING (w) GROUP BY b),
gains AS (SELECT b, floor(1000 * ln((coalesce(g.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000.0::DOUBLE)
  / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM g) + 10000.0::DOUBLE))))::BIGINT AS gain FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN g USING (b)),
x AS (SELECT row_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN h USING (w) JOIN gains USING (b) GROUP BY row_id),
y AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN x USING (row_id))
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) * 10 // 100 FROM y WHERE n_features >= 20) THEN place END::BIGINT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM y)"""


def shards_sql() -> str:
    def shard(n: int) -> str:
        bids = ", ".join(f"(-1.0::DOUBLE / ln((('0x' || md5(key || ':{i}')[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496), {i})" for i in range(n))
        return f"greatest({bids})[2]::INTEGER"

    return f"""WITH t AS (SELECT {CRC_TABLE} AS crcs),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(text, '') AS x FROM documents),
h AS (SELECT doc_id, strlen(x)::BIGINT + 1 AS size, {crc32_sql('x', 'crcs')} AS text_crc32, {shard(16)} AS shard, {shard(17)} AS grown_shard FROM d, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM h"""
