"""SQL twins of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: Shards: the order by digest and id, cut at equal targets; crc32 by the usual table.
SHARDING = """
WITH RECURSIVE steps(i, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
rows_ AS (
    SELECT doc_id, md5(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) + 8 AS size,
        hex(encode(coalesce(text, ''))) AS h FROM documents),
placed AS (
    SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS pos FROM rows_
    WINDOW w AS (ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING)),
grouped AS (
    SELECT *, sum(size) OVER g AS group_bytes, min(upto - size) OVER g AS group_from, sum(size) OVER () AS total
    FROM placed WINDOW g AS (PARTITION BY digest)),
sharded AS (
    SELECT *, least(floor((CASE WHEN group_bytes <= total * 0.002 / 24 THEN group_from ELSE upto - size END)
        / (total / 24)), 23)::INT AS shard FROM grouped)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(
        range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
    'bytes' AS law, shard, pos - min(pos) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM sharded, crc
"""

#: The mix: water filling, the golden-ratio schedule, equal blocks of 32 words or less by hash order.
MIXING = """
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM docs GROUP BY source),
weighed AS (
    SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total
    FROM sources),
levels AS (
    SELECT *, row_number() OVER w AS place, (total - coalesce(sum(cap) OVER (
        ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed WINDOW w AS (ORDER BY cap / weight, rank)),
common AS (SELECT min_by(level, place) AS level FROM levels WHERE cap > level * weight),
targets AS (
    SELECT source, source_size, rank, greatest(ceil(source_size / 32)::BIGINT, least(source_size, 64)) AS blocks,
        least(cap::DOUBLE, coalesce((SELECT level FROM common), 'inf'::DOUBLE) * weight) AS target, total FROM levels),
shares AS (
    SELECT rank, blocks, sum(need) OVER () AS slots, CASE WHEN rank = max(rank) OVER () THEN 4611686018427387904
        ELSE round(sum(need) OVER (ORDER BY rank) / sum(need) OVER () * 4611686018427387904)::BIGINT END AS hi
    FROM (SELECT *, target * blocks / source_size AS need FROM targets WHERE target > 0)),
ranges AS (SELECT *, lag(hi, 1, 0) OVER (ORDER BY rank) AS lo FROM shares),
slots AS (
    SELECT range AS slot, range::HUGEINT * 2850178704830799621 % 4611686018427387904 AS point
    FROM range(0, (SELECT ceil(round(max(slots), 6))::BIGINT FROM shares))),
turns AS (
    SELECT rank, blocks, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS turn
    FROM slots JOIN ranges ON point >= lo AND point < hi),
times AS (
    SELECT rank, turn % blocks AS block, count(*) AS times FROM turns WHERE turn < 3 * blocks GROUP BY ALL),
stream AS (
    SELECT doc_id, size, source_size, target, rank, sum(size) OVER (
        PARTITION BY rank ORDER BY md5(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
    FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
placed AS (
    SELECT *, upto - size AS start, longer * (width + 1) AS edge
    FROM stream JOIN (SELECT rank, source_size // blocks AS width, source_size % blocks AS longer
        FROM targets WHERE target > 0) USING (rank) WHERE size > 0),
pieces AS (
    SELECT doc_id, rank, start, upto, width, longer, unnest(range(
        CASE WHEN start < edge THEN start // (width + 1) ELSE longer + (start - edge) // width END,
        CASE WHEN upto - 1 < edge THEN (upto - 1) // (width + 1) ELSE longer + (upto - 1 - edge) // width END + 1)) AS block
    FROM placed),
taken AS (
    SELECT doc_id, sum((least(upto, (block + 1) * width + least(block + 1, longer))
        - greatest(start, block * width + least(block, longer))) * times)::BIGINT AS taken
    FROM pieces JOIN times USING (rank, block) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM stream LEFT JOIN taken USING (doc_id)
"""

#: Base32 takes the 40 hex digits of the digest five at a time, four characters each.
WARC = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT
        >> (15 - 5 * (i % 4))) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM p
"""

#: Words removed where a window of 35 words starts at two places or more.
SUBSTRINGS = """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
windows AS (
    SELECT r, s, array_to_string(list_slice(w, s, s + 34), ' ') AS h
    FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM docs WHERE len(w) >= 35)),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM windows JOIN twice USING (h)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

#: Two trees by recursion; a proof is the list of siblings by level, marked left or right.
MERKLE = """
WITH RECURSIVE steps(i, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
fields AS (
    SELECT doc_id, n_chars, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS front,
        coalesce(strlen(text) || ':' || text, '-') AS back,
        xor(list_reduce(list_prepend(4294967295, list_transform(
            range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS sum
    FROM documents, crc),
docs AS (
    SELECT doc_id, g, sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
        sha256(front || coalesce(strlen((n_chars + c)::VARCHAR) || ':' || (n_chars + c), '-') || back) AS shown,
        row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST) - 1 AS pos
    FROM (SELECT *, CASE WHEN sum % 7 = 0 THEN 1 ELSE 0 END AS c FROM fields)),
up AS (
    SELECT 0 AS level, g, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM docs
    UNION ALL
    SELECT level + 1, g, pos // 2, sha256(h || coalesce(next, '')), (n + 1) // 2
    FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY pos) AS next FROM up WHERE n > 1) WHERE pos % 2 = 0),
subroots AS (SELECT g, h AS subroot, level AS height FROM up WHERE n = 1),
top AS (
    SELECT 0 AS level, g AS pos, subroot AS h, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(h || coalesce(next, '')), (n + 1) // 2
    FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS next FROM top WHERE n > 1) WHERE pos % 2 = 0),
root AS (SELECT h AS root, level AS above FROM top WHERE n = 1),
low AS (SELECT *, unnest(range(height)) AS level FROM docs JOIN subroots USING (g)),
high AS (SELECT *, unnest(range(above)) AS level FROM docs JOIN subroots USING (g), root),
sides AS (
    SELECT low.doc_id, low.g, low.pos, low.level AS place, (low.pos >> low.level) & 1 AS odd, up.h
    FROM low LEFT JOIN up ON up.g = low.g AND up.level = low.level AND up.pos = xor(low.pos >> low.level, 1)
    UNION ALL
    SELECT high.doc_id, high.g, high.pos, height + high.level, (high.g >> high.level) & 1, top.h
    FROM high LEFT JOIN top ON top.level = high.level AND top.pos = xor(high.g >> high.level, 1)),
proofs AS (
    SELECT g, pos, string_agg(coalesce(h, ''), '' ORDER BY place) AS siblings,
        list(CASE WHEN odd = 1 THEN 'L' ELSE 'R' END || coalesce(h, '') ORDER BY place) AS sides
    FROM sides GROUP BY g, pos)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded AS folded_root,
    folded = root AS verified
FROM (
    SELECT *, list_reduce(list_prepend(shown, coalesce(sides, [])), lambda a, b: sha256(CASE
        WHEN substr(b, 1, 1) = 'L' THEN substr(b, 2) || a ELSE a || substr(b, 2) END)) AS folded
    FROM docs JOIN subroots USING (g) LEFT JOIN proofs USING (g, pos), root)
"""
