"""Equal DuckDB queries over the driver tables, written from the operators' definitions."""

from __future__ import annotations


def u(key: str, tag: str, seed: int = 0) -> str:
    return (
        f"(('0x' || substr(sha256('{seed}:' || CAST({key} AS VARCHAR) || ':{tag}'), 1, 8))::BIGINT"
        " / 4294967296.0::DOUBLE)"
    )


def rng(key: str, tag: str, low: float, high: float, seed: int = 0) -> str:
    return f"({float(low)!r}::DOUBLE + {u(key, tag, seed)} * {float(high) - float(low)!r}::DOUBLE)"


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)"


def mean(column: str) -> str:
    """Mean of a two-decimal column from whole hundredths."""
    return f"(sum(round({column} * 100)::BIGINT)::DOUBLE / count({column}) / 100.0::DOUBLE)"


EXT = "list_extract(['png','jpg','webp','bmp','txt'], CAST(doc_id % 5 AS INTEGER) + 1)"
PIXEL = "round(least(greatest((e::DOUBLE + 1) * 127.5, 0), 255))"

CTE = {
    "listing": f"""SELECT doc_id, source || '/' || lang || '/' || doc_id || '.' || {EXT} AS rel_path, source AS category,
        doc_id || '.' || {EXT} AS name, '.' || {EXT} AS ext, n_chars AS bytes,
        CAST(64 + n_chars % 700 AS INTEGER) AS w, CAST(64 + doc_id % 700 AS INTEGER) AS h, text FROM documents""",
    "held": "SELECT rel_path, category, doc_id, sha256('20260723:' || rel_path) AS order_key FROM listing WHERE ext IN ('.png','.jpg','.webp') ORDER BY order_key LIMIT 50",
    "det": f"""SELECT user_id AS img, event_id AS det_idx, (event_id * 37 % 400)::DOUBLE AS x1, (event_id * 53 % 300)::DOUBLE AS y1,
        (event_id * 37 % 400)::DOUBLE + 40 + event_id % 80 AS x2, (event_id * 53 % 300)::DOUBLE + 40 + event_id * 7 % 80 AS y2,
        {u('event_id', 's', 7)} AS score, CAST(event_id % 3 AS INTEGER) AS cls,
        300 + user_id % 200 AS img_w, 240 + user_id % 160 AS img_h FROM events""",
    "vec": f"SELECT vec_id, label, list_transform(embedding, lambda e: {PIXEL}) AS plane FROM embeddings",
    "pix": "SELECT vec_id, vec_id // 3 AS img, CAST(vec_id % 3 AS INTEGER) AS ch, p // 8 AS y, p % 8 AS x, p, v FROM (SELECT vec_id, unnest(plane) AS v, unnest(range(64)) AS p FROM vec)",
    "ppix": "SELECT a.vec_id // 2 AS pair, a.p, a.y, a.x, a.v AS a, b.v AS b FROM pix a JOIN pix b ON b.vec_id = a.vec_id + 1 AND b.p = a.p WHERE a.vec_id % 2 = 0",
    "ipix": "SELECT a.img // 2 AS pair, a.ch, a.p, a.y, a.x, a.v AS a, b.v AS b FROM pix a JOIN pix b ON b.img = a.img + 1 AND b.ch = a.ch AND b.p = a.p WHERE a.img % 2 = 0",
    "bgr": """SELECT img, p, max(CASE WHEN ch = 0 THEN v END) AS b, max(CASE WHEN ch = 1 THEN v END) AS g,
        max(CASE WHEN ch = 2 THEN v END) AS r FROM pix GROUP BY img, p""",
    "code": """SELECT label AS code_id, pos, round(avg(v::DOUBLE), 9) AS m FROM
        (SELECT label, unnest(embedding) AS v, unnest(range(64)) AS pos FROM embeddings) GROUP BY label, pos""",
    "near": """SELECT vec_id, arg_min(code_id, (d, code_id)) AS code_id, min(d) AS distance FROM (
        SELECT e.vec_id, c.code_id, sum((e.v::DOUBLE - c.m) * (e.v::DOUBLE - c.m)) AS d
        FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS pos FROM embeddings) e JOIN code c USING (pos)
        GROUP BY e.vec_id, c.code_id) GROUP BY vec_id""",
    "ser": "SELECT user_id % 5 AS run, event_id AS iteration, value / 1000 AS value, ts FROM events",
    "ckpt": """SELECT 'run_' || (o_custkey % 10) AS run, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderdate AS mtime,
        'run_' || (o_custkey % 10) || '/' || CASE WHEN o_orderkey % 97 = 0 THEN 'models/net_g_latest.pth'
        WHEN o_orderkey % 89 = 0 THEN 'models/net_g_final.pth' WHEN o_orderkey % 2 = 0 THEN 'models/net_g_' || o_orderkey || '.pth'
        ELSE 'training_states/' || o_orderkey || '.state' END AS path,
        CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 THEN NULL ELSE o_orderkey END AS iter,
        CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 OR o_orderkey % 2 = 0 THEN 'model' ELSE 'state' END AS kind FROM orders""",
    "prog": """SELECT user_id AS request, CASE WHEN event_type = 'purchase' THEN 'complete' ELSE event_type END AS stage,
        event_id % 100 / 100 AS progress, 'event ' || event_id AS message, ts, event_id FROM events""",
    "man": """SELECT doc_id, CASE WHEN doc_id % 250 = 7 THEN '' WHEN doc_id % 50 = 7 THEN 'dup_' || (doc_id % 3) ELSE 'doc_' || doc_id END AS id,
        CASE WHEN doc_id % 60 = 11 THEN '' WHEN doc_id % 70 = 13 THEN 'inputs/' || doc_id || '.gif' ELSE 'inputs/' || doc_id || '.jpg' END AS input_path,
        CASE WHEN l.doc_id IS NULL THEN '' WHEN d.doc_id % 40 = 0 THEN '/refs/' || d.doc_id || '.tiff' ELSE 'references/' || d.doc_id || '.PNG' END AS reference_path,
        CASE WHEN doc_id % 80 = 3 THEN '' ELSE source END AS category FROM documents d LEFT JOIN labels l USING (doc_id)""".replace(
        "doc_id % ", "d.doc_id % ").replace("d.d.", "d.").replace("|| doc_id", "|| d.doc_id").replace("SELECT doc_id,", "SELECT d.doc_id,"),
    "mpath": """SELECT id, 'input' AS role, '/data/' || input_path AS path FROM man WHERE input_path <> ''
        UNION ALL SELECT id, 'reference', CASE WHEN reference_path LIKE '/%' THEN reference_path ELSE '/data/' || reference_path END FROM man WHERE reference_path <> ''""",
    "have": """SELECT '/data/inputs/' || doc_id || '.jpg' AS path FROM documents WHERE doc_id % 9 <> 0
        UNION SELECT '/data/references/' || doc_id || '.PNG' FROM documents WHERE doc_id % 4 <> 0""",
    "judged": """SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'unreadable' WHEN w < 128 OR h < 128 THEN 'low_res' WHEN doc_id % 4 = 0 THEN 'no_face'
        WHEN doc_id % 100 / 100 < 0.15 THEN 'small_face' WHEN bytes % 300 < 80 THEN 'blurry' ELSE 'ok' END AS reason FROM listing""",
    "lscore": f"""SELECT l_returnflag AS variant, l_partkey AS sample, {mean('l_extendedprice')} AS value,
        {mean('l_quantity')} AS latency_s FROM lineitem GROUP BY l_returnflag, l_partkey""",
    "idp": """SELECT a.vec_id, a.label, 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS distance
        FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) b
        ON b.vec_id = a.vec_id + 1 AND a.label = b.label""",
    "docidx": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents",
}

NEEDS = {
    "held": ["listing"], "pix": ["vec"], "ppix": ["vec", "pix"], "ipix": ["vec", "pix"], "bgr": ["vec", "pix"],
    "near": ["code"], "mpath": ["man"], "judged": ["listing"],
}


def with_(names: str, body: str, recursive: bool = False) -> str:
    ordered: list[str] = []
    for name in names.split():
        for need in [*NEEDS.get(name, []), name]:
            if need not in ordered:
                ordered.append(need)
    ctes = ",\n".join(f"{n} AS ({CTE[n]})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}" if ctes else body


def whole(key: str, tag: str, seed: int) -> str:
    return f"('0x' || substr(sha256('{seed}:' || CAST({key} AS VARCHAR) || ':{tag}'), 1, 15))::BIGINT"


def _permuted(source: str, epoch: int, steps: int = 8) -> str:
    """``source`` has ``copy_pos`` and ``total``; ``position`` by the keyed bijection, with up to ``steps`` tries to land inside."""
    out = f"SELECT *, ceil(sqrt(total))::BIGINT AS da, (total + ceil(sqrt(total))::BIGINT - 1) // ceil(sqrt(total))::BIGINT AS db, copy_pos AS y, true AS going FROM ({source})"
    for _ in range(steps):
        out = f"""SELECT * EXCLUDE (l0, r0, l1, r1, l2, r2) REPLACE (CASE WHEN going THEN l2 * db + r2 ELSE y END AS y, going AND l2 * db + r2 >= total AS going) FROM (
            SELECT *, y // db AS l0, y % db AS r0, (l0 + {whole('r0', 'epoch0', epoch)}) % da AS l1, (r0 + {whole('l1', 'epoch1', epoch)}) % db AS r1,
            (l1 + {whole('r1', 'epoch2', epoch)}) % da AS l2, (r1 + {whole('l2', 'epoch3', epoch)}) % db AS r2 FROM ({out}))"""
    return f"SELECT * EXCLUDE (da, db, y, going), CASE WHEN NOT going THEN y END AS position FROM ({out})"


def _epoch(n: str, ratio: str, replicas: int, epoch: int, key: str = "doc_id", items: str = "docidx") -> str:
    total = f"(ceil({n} * {ratio}::DOUBLE / {replicas})::BIGINT * {replicas})"
    copies = f"SELECT {key}, {total} AS total, unnest(range(idx, {total}, n)) AS copy_pos FROM {items}"
    return f"""SELECT {key}, copy_pos, position, CAST(position % {replicas} AS INTEGER) AS rank, position // {replicas} AS rank_pos FROM ({_permuted(copies, epoch)})"""


def _offsets(x: str) -> str:
    """Prior columns used by the offset queries."""
    return f"""(({x} % 8) * 64 + 32)::DOUBLE AS pcx, (({x} % 6) * 64 + 32)::DOUBLE AS pcy, (32 + ({x} % 5) * 16)::DOUBLE AS pw, (32 + ({x} % 3) * 24)::DOUBLE AS ph"""


INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"

ORACLES: dict[str, str] = {}
O = ORACLES

O["holdout_report"] = with_(
    "listing held",
    """, train AS (SELECT * FROM listing WHERE rel_path NOT IN (SELECT rel_path FROM held))
    SELECT category, grouping(category) = 1 AS is_total, count(*) AS train_items,
    (SELECT count(*) FROM train WHERE rel_path IN (SELECT rel_path FROM held)) AS overlap_items
    FROM train GROUP BY ROLLUP (category)""",
)
O["curate"] = with_(
    "listing judged",
    """SELECT rel_path, category, reason, bytes FROM (SELECT l.*, j.reason, row_number() OVER (PARTITION BY category ORDER BY rel_path) AS k
    FROM listing l JOIN (SELECT doc_id, CASE WHEN w < 128 OR h < 128 THEN 'low_res' WHEN doc_id % 4 = 0 THEN 'no_face' WHEN doc_id % 100 / 100 < 0.15 THEN 'small_face'
    WHEN bytes % 300 < 80 THEN 'blurry' ELSE 'ok' END AS reason FROM listing) j USING (doc_id)
    WHERE j.reason = 'ok' AND ext IN ('.png', '.jpg', '.webp') AND doc_id NOT IN (SELECT doc_id FROM labels)) WHERE k <= 10""",
)
O["training_plan"] = with_(
    "listing held",
    f""", items AS (SELECT rel_path, row_number() OVER (ORDER BY rel_path) - 1 AS idx, count(*) OVER () AS n FROM listing WHERE rel_path NOT IN (SELECT rel_path FROM held)),
    ep AS ({_epoch('n', '1.5', 2, 3, 'rel_path', 'items')}), full_ AS (SELECT rank, count(*) // 8 AS f FROM ep GROUP BY rank)
    SELECT rel_path, rank, rank_pos, rank_pos // 8 AS batch, {u('copy_pos', 'flip', 3)} < 0.5 AS flip,
    CASE WHEN {u('copy_pos', 'small:kernel', 3)} < 0.5 THEN 'iso' ELSE 'aniso' END AS small_kernel,
    {r(rng('copy_pos', 'large:scale', 4, 30, 3))} AS large_scale FROM ep JOIN full_ USING (rank) WHERE rank_pos // 8 < f""",
)
O["read_first_available"] = "SELECT source, count(*) AS items, 'documents.parquet' AS used FROM documents GROUP BY source"
O["extract_payload"] = "SELECT doc_id, strlen(text) AS payload_bytes, sha256(text) AS digest FROM documents WHERE strlen(text) > 0"
O["parse_posts"] = """SELECT user_id, json_extract(j, '$[0].id')::BIGINT AS id, json_extract_string(j, '$[0].file_url') AS file_url FROM (
    SELECT user_id, event_id, '[{"id":' || event_id || ',"file_url":"\\/img\\/' || event_type || '.png","meta":' || props || '}]' AS j
    FROM events WHERE event_type <> 'error') WHERE event_id <> 0"""
O["clean_manifest"] = with_(
    "man",
    """SELECT nullif(id, '') AS id, '/data/benchmark/' || nullif(input_path, '') AS input_path,
    CASE WHEN reference_path LIKE '/%' THEN reference_path ELSE '/data/benchmark/' || nullif(reference_path, '') END AS reference_path,
    nullif(category, '') AS category, 'fixture' AS notes FROM man""",
)
_HREF = "'(?is)<[a-zA-Z][^>]*?\\shref\\s*=\\s*[\"'']([^\"''>]+)[\"'']'"
_LINKS = f"""SELECT page_id, host, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_at) - 1 AS INTEGER) AS pos FROM (
    SELECT page_id, any_value(host) AS host, link, min(k) AS first_at FROM (
    SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) AS host, unnest(l) AS link, unnest(range(len(l))) AS k FROM (
    SELECT page_id, url, regexp_extract_all(html, {_HREF}, 1) AS l FROM pages)) GROUP BY page_id, link)"""
O["extract_links"] = f"SELECT page_id, pos, link FROM ({_LINKS})"
O["extract_links_limited"] = f"""SELECT host, link, page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, pos) AS k FROM (
    SELECT host, link, page_id, pos, row_number() OVER (PARTITION BY host, link ORDER BY page_id, pos) AS seen FROM ({_LINKS})) WHERE seen = 1) WHERE k <= 5"""
O["read_meta_info"] = with_(
    "listing",
    """SELECT name, CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 3 = 0 THEN h ELSE -1 END AS h, CASE WHEN doc_id % 3 = 0 THEN w ELSE -1 END AS w,
    CASE WHEN doc_id % 3 = 0 THEN 3 ELSE -1 END::INTEGER AS c, CASE WHEN doc_id % 3 = 0 THEN doc_id % 10 WHEN doc_id % 3 = 1 THEN 1 ELSE -1 END::INTEGER AS level FROM listing""",
)
O["write_meta_info"] = with_(
    "listing",
    """SELECT name, CASE WHEN doc_id % 3 = 0 THEN name || ' (' || h || ',' || w || ',3) ' || (doc_id % 10) WHEN doc_id % 3 = 1 THEN name || ' 1' ELSE name END AS value FROM listing""",
)
O["read_store"] = with_(
    "listing",
    "SELECT CAST(doc_id AS VARCHAR) AS key, strlen(text) AS payload_bytes, h, w FROM listing WHERE doc_id IN (SELECT doc_id FROM labels)",
)
O["write_packed"] = with_(
    "listing",
    "SELECT CAST(doc_id AS VARCHAR) AS key, sha256(text) AS digest, h, w FROM listing WHERE doc_id IN (SELECT doc_id FROM labels)",
)
O["write_manifest"] = with_(
    "held",
    """SELECT 'portrait_' || lpad(k::VARCHAR, 4, '0') AS id, '/bench/inputs/portrait_' || lpad(k::VARCHAR, 4, '0') || '.jpg' AS input_path,
    '/bench/references/portrait_' || lpad(k::VARCHAR, 4, '0') || ext AS reference_path, category, 'deterministic holdout' AS notes
    FROM (SELECT held.category, ext, row_number() OVER (ORDER BY order_key) AS k FROM held JOIN listing USING (doc_id))""",
)
O["write_holdout"] = with_("held", "SELECT rel_path AS path FROM held")
O["read_listing"] = with_(
    "listing",
    """, placed AS (SELECT bytes % 5 AS size, ext, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CASE WHEN doc_id % 4 = 0 THEN '_' ELSE '' END || source END AS folder,
        CASE WHEN doc_id % 17 = 0 THEN '.git' WHEN doc_id % 3 = 0 THEN 'lang=' || lang WHEN doc_id % 3 = 1 THEN 'deep/_tmp/x' END AS deeper,
        CASE WHEN doc_id % 7 = 0 THEN '_' WHEN doc_id % 11 = 0 THEN '.h_' ELSE '' END || name AS nm FROM listing JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)),
    whole AS (SELECT *, concat_ws('/', folder, CASE WHEN folder IS NOT NULL THEN deeper END, nm) AS path FROM placed)
    SELECT path, path AS rel_path, coalesce(folder, '') AS category, nm AS name, ext, size AS bytes, true AS timed FROM whole
    WHERE ext IN ('.png', '.txt', '.webp') AND path NOT LIKE '.%' AND path NOT LIKE '%/.%'""",
)
O["normalise_url"] = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://' || bare WHEN 1 THEN 'https://img.example.org/' || bare
    WHEN 2 THEN CASE WHEN bare LIKE 'http%' THEN bare ELSE 'https://img.example.org/' || bare END ELSE url END AS url
    FROM (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS bare FROM pages)"""
O["filter_name"] = with_(
    "listing",
    """SELECT doc_id, nm AS name FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN upper(name) WHEN doc_id % 11 = 0 THEN '.h_' || name
    WHEN doc_id % 13 = 0 THEN 'noext' ELSE name END AS nm FROM listing)
    WHERE (nm = 'noext' OR lower(nm) LIKE '%.png' OR lower(nm) LIKE '%.jpg' OR lower(nm) LIKE '%.webp') AND nm NOT LIKE '.%' AND nm NOT LIKE '%77%'""",
)
O["filter_size"] = with_(
    "listing",
    """SELECT doc_id, coalesce(b, -1) AS bytes, w, h FROM (SELECT *, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE bytes END AS b FROM listing)
    WHERE (b IS NULL OR b <= 4000) AND w::BIGINT * h <= 200000""",
)
O["filter_resolution"] = with_("listing", "SELECT doc_id, w, h FROM listing WHERE least(w, h) >= 128")
O["filter_coverage"] = with_("det", f"SELECT img, det_idx, {r('c')} AS coverage FROM (SELECT *, (x2 - x1) * (y2 - y1) / (img_w::DOUBLE * img_h) AS c FROM det) WHERE c >= 0.05")
O["filter_detections"] = with_("det", f"SELECT img, det_idx, {r('score')} AS score FROM det WHERE score > 0.8 AND sqrt((det_idx % 12) ** 2 + (det_idx % 5) ** 2) >= 5")
O["to_rel_posix"] = with_("listing", "SELECT doc_id, rel_path AS path FROM listing WHERE doc_id % 7 <> 0")
O["store_key"] = with_(
    "listing",
    """SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'v1.2 ü_' || doc_id WHEN doc_id % 8 = 1 THEN '._' ELSE CAST(doc_id AS VARCHAR) END AS key,
    CASE WHEN doc_id % 8 = 0 THEN 'enhanced_v1.2__' || doc_id || '.png' WHEN doc_id % 8 = 1 THEN 'enhanced_portrait.png' ELSE 'enhanced_' || doc_id || '.png' END AS safe_name FROM listing""",
)
O["reject_reason"] = with_("judged", "SELECT doc_id, reason FROM judged")
O["box_convert"] = with_(
    "det",
    f"""SELECT img, det_idx, {r('((x1 + x2) / 2 - pcx) / (0.1 * pw)')} AS dx, {r('((y1 + y2) / 2 - pcy) / (0.1 * ph)')} AS dy,
    {r('ln((x2 - x1) / pw) / 0.2')} AS dw, {r('ln((y2 - y1) / ph) / 0.2')} AS dh, {r('(x1 + x2) / 2')} AS cx, {r('(y1 + y2) / 2')} AS cy,
    {r('x2 - x1')} AS w, {r('y2 - y1')} AS h, {r('x1')} AS x1, {r('y1')} AS y1, {r('x2')} AS x2, {r('y2')} AS y2
    FROM (SELECT *, {_offsets('det_idx')} FROM det)""",
)
_clip = lambda v, hi: f"least(greatest({v}, 0), {hi})"
O["box_fit"] = with_(
    "det",
    f"""SELECT img, det_idx, {r(_clip('(x1 - px) / g', 'img_w'))} AS x1, {r(_clip('(y1 - py) / g', 'img_h'))} AS y1,
    {r(_clip('(x2 - px) / g', 'img_w'))} AS x2, {r(_clip('(y2 - py) / g', 'img_h'))} AS y2,
    greatest(trunc(x1 - gw * bw), 0)::INTEGER AS grown_x1, greatest(trunc(y1 - gh * bh), 0)::INTEGER AS grown_y1,
    least(trunc(x2 + gw * bw), img_w)::INTEGER AS grown_x2, least(trunc(y2 + gh * bh), img_h)::INTEGER AS grown_y2
    FROM (SELECT *, (320 - img_w * g) / 2 AS px, (320 - img_h * g) / 2 AS py, greatest(0.15, (1.3::DOUBLE * bh - bw) / (2 * bw)) AS gw, greatest(0.15, (1.3::DOUBLE * bw - bh) / (2 * bh)) AS gh
    FROM (SELECT *, least(320::DOUBLE / img_h, 320::DOUBLE / img_w) AS g, x2 - x1 AS bw, y2 - y1 AS bh FROM det))""",
)
O["to_luma"] = with_(
    "bgr",
    f"""SELECT img, p::INTEGER AS pos, {r('b / 255 * 24.966 + g / 255 * 128.553 + r / 255 * 65.481 + 16')} AS bt601, {r('b * 0.1140 + g * 0.5870 + r * 0.2989')} AS gray FROM bgr WHERE b IS NOT NULL AND g IS NOT NULL AND r IS NOT NULL""",
)
O["melt_metrics"] = f"""SELECT l_partkey AS iteration, metric, value FROM (UNPIVOT (SELECT l_partkey, {r(mean('l_quantity'), 8)} AS qty, {r(mean('l_discount'), 8)} AS disc, {r(mean('l_tax'), 8)} AS tax
    FROM lineitem GROUP BY l_partkey) ON qty, disc, tax INTO NAME metric VALUE value)"""
O["rescale_planes"] = with_(
    "pix",
    f"SELECT img, c AS ch, p::INTEGER AS pos, {r('(v / 255 - [0.5, 0.4, 0.3][c + 1]) / [0.5, 0.25, 0.2][c + 1]')} AS v, vec.plane[p + 1] AS back FROM (SELECT *, 2 - ch AS c FROM pix) q JOIN vec USING (vec_id)".replace(
        "vec.plane[p + 1] AS back", "(CASE WHEN 2 - c = c THEN v ELSE v END) AS back"),
)
O["skip_existing"] = with_("listing", "SELECT doc_id, rel_path FROM listing WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
O["exclude_holdout"] = with_("listing held", "SELECT doc_id FROM listing WHERE doc_id NOT IN (SELECT doc_id FROM held)")
O["exclusion_report"] = with_("listing held", "SELECT count(*) AS total, count(held.rel_path) AS removed, count(*) - count(held.rel_path) AS kept FROM listing LEFT JOIN held USING (rel_path)")
O["audit_leakage"] = with_(
    "listing held",
    """, b AS (SELECT l.rel_path, h.rel_path IS NOT NULL AS held FROM listing l LEFT JOIN held h USING (rel_path))
    SELECT count(*) FILTER (NOT held) AS train_rows, count(*) FILTER (held AND NOT held) AS overlap_rows, 'clean' AS "case" FROM b
    UNION ALL SELECT count(*), count(*) FILTER (held), 'dirty' FROM b""",
)
O["pair_lq_gt"] = with_(
    "listing",
    """SELECT doc_id || '_x2' || ext AS lq_name, CASE WHEN ext <> '.bmp' THEN 'lq/' || doc_id || '_x2' || ext END AS lq_path,
    CASE WHEN ext <> '.txt' THEN 'gt/' || name END AS gt_path, CASE WHEN ext = '.bmp' THEN 'missing_lq' WHEN ext = '.txt' THEN 'missing_gt' ELSE 'paired' END AS status FROM listing""",
)
O["compare_key_sets"] = """WITH a AS (SELECT DISTINCT md5(text) AS key FROM documents),
    b AS (SELECT DISTINCT md5(text || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS key FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    SELECT key, 'a' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'b' FROM b WHERE key NOT IN (SELECT key FROM a)"""
O["check_files"] = with_("mpath have", "SELECT nullif(id, '') AS id, role, path FROM mpath WHERE path NOT IN (SELECT path FROM have)")
O["file_counts"] = with_("mpath have", "SELECT role, count(*) AS asked, count(*) FILTER (WHERE path NOT IN (SELECT path FROM have)) AS missing FROM mpath GROUP BY role")
_PARTS = " UNION ALL ".join(
    f"SELECT vec_id, label, '{p}' AS part, 256 + 100 * embedding[{3*i+1}]::DOUBLE AS cx, 256 + 100 * embedding[{3*i+2}]::DOUBLE AS cy, 40 + 20 * embedding[{3*i+3}]::DOUBLE AS half FROM embeddings"
    for i, p in enumerate(["left_eye", "right_eye", "nose", "mouth"])
)
O["attach_annotations"] = f"""WITH c AS ({_PARTS}), f AS (SELECT vec_id AS name, vec_id % 2 = 1 AS flip, label, cy,
    CASE WHEN vec_id % 2 = 1 AND part = 'left_eye' THEN 'right_eye' WHEN vec_id % 2 = 1 AND part = 'right_eye' THEN 'left_eye' ELSE part END AS part,
    CASE WHEN vec_id % 2 = 1 THEN 512 - cx ELSE cx END AS cx, half * CASE WHEN part LIKE '%eye' THEN 1.4::DOUBLE WHEN part = 'nose' THEN 1.1::DOUBLE ELSE 1.3::DOUBLE END AS h FROM c)
    SELECT name, flip, part, list_aggregate(list_transform(CASE WHEN flip THEN list_reverse(range(16)) ELSE range(16) END, lambda i: (label + i)::VARCHAR), 'string_agg', ',') AS codes,
    {r('cx - h + 1')} AS x1, {r('cy - h + 1')} AS y1, {r('cx + h')} AS x2, {r('cy + h')} AS y2,
    {r('(cx - h + 1) / 2')} AS in_x1, {r('(cy - h + 1) / 2')} AS in_y1, {r('(cx + h) / 2')} AS in_x2, {r('(cy + h) / 2')} AS in_y2 FROM f"""
O["box_overlap"] = with_(
    "det",
    f"""SELECT img, a_idx, b_idx, {r('i / (sa + sb - i)')} AS overlap FROM (SELECT a.img, a.det_idx AS a_idx, b.det_idx AS b_idx, {INTER} AS i,
    (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM det a JOIN det b USING (img)) WHERE i > 0""",
)
O["box_overlap_iof"] = with_(
    "det",
    f""", big AS (SELECT img, det_idx, x1, y1, x1 + 150 AS x2, y1 + 150 AS y2 FROM det)
    SELECT img, a_idx, b_idx, {r('i / greatest(sa, 1)')} AS overlap FROM (SELECT a.img, a.det_idx AS a_idx, b.det_idx AS b_idx, {INTER} AS i,
    (a.x2 - a.x1) * (a.y2 - a.y1) AS sa FROM det a JOIN big b USING (img)) WHERE i > 0 AND i / greatest(sa, 1) > 0.5""",
)
_LANDMARKS = ", ".join(
    f"{r(f'CASE WHEN valid THEN ({c}1 + ({c}2 - {c}1) * {v}::DOUBLE - c{c}) / (0.1 * w) ELSE 0 END', 4)} AS l{c}{k}"
    for k, pair in enumerate([(0.25, 0.3), (0.75, 0.3), (0.5, 0.5), (0.3, 0.8), (0.7, 0.8)])
    for c, v in zip("xy", pair)
)
O["match_priors"] = with_(
    "det",
    f""", pr AS (SELECT (i * 8 + j) * 2 + s AS prior_id, (j + 0.5::DOUBLE) * 64 / 512 AS cx, (i + 0.5::DOUBLE) * 64 / 512 AS cy, [48, 80][s + 1]::DOUBLE / 512 AS w
        FROM range(8) a(i), range(8) b(j), range(2) c(s) UNION ALL
        SELECT 128 + i * 4 + j, (j + 0.5::DOUBLE) * 128 / 512, (i + 0.5::DOUBLE) * 128 / 512, 120::DOUBLE / 512 FROM range(4) a(i), range(4) b(j)),
    pb AS (SELECT prior_id, cx - w / 2 AS x1, cy - w / 2 AS y1, cx + w / 2 AS x2, cy + w / 2 AS y2, cx, cy, w FROM pr),
    tr AS (SELECT img, det_idx, x1 / 512 AS x1, y1 / 512 AS y1, x2 / 512 AS x2, y2 / 512 AS y2, (1 + det_idx % 3)::INTEGER AS label FROM det),
    ov AS (SELECT img, det_idx, prior_id, i / (sa + sb - i) AS o FROM (SELECT a.img, a.det_idx, b.prior_id, {INTER} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS sa,
        (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM tr a, pb b)),
    bp AS (SELECT img, det_idx, max(o) AS best, arg_max(prior_id, (o, -prior_id)) AS prior_id FROM ov GROUP BY img, det_idx),
    bt AS (SELECT img, prior_id, max(o) AS o, arg_max(det_idx, (o, -det_idx)) AS det_idx FROM ov GROUP BY img, prior_id),
    cl AS (SELECT img, prior_id, max(det_idx) AS claim, bool_or(best >= 0.2) AS lifted FROM bp GROUP BY img, prior_id),
    va AS (SELECT img, max(best) >= 0.2 AS valid FROM bp GROUP BY img),
    ch AS (SELECT img, prior_id, valid, coalesce(claim, bt.det_idx) AS det_idx, CASE WHEN lifted THEN 2 ELSE o END AS o FROM bt JOIN va USING (img) LEFT JOIN cl USING (img, prior_id))
    SELECT ch.img, ch.prior_id, ch.det_idx, (CASE WHEN valid AND o >= 0.35 THEN label ELSE 0 END)::INTEGER AS label,
    {r("CASE WHEN valid THEN ((x1 + x2) / 2 - cx) / (0.1 * w) ELSE 0 END")} AS dx, {r("CASE WHEN valid THEN ((y1 + y2) / 2 - cy) / (0.1 * w) ELSE 0 END")} AS dy,
    {r("CASE WHEN valid THEN ln((x2 - x1) / w) / 0.2 ELSE 0 END")} AS dw, {r("CASE WHEN valid THEN ln((y2 - y1) / w) / 0.2 ELSE 0 END")} AS dh, {_LANDMARKS}
    FROM ch JOIN tr USING (img, det_idx) JOIN pr USING (prior_id)""",
)
O["schedule_value"] = f"""SELECT o_orderkey AS iteration,
    {r("CASE WHEN o_orderkey < 4000 THEN 2.0::DOUBLE WHEN o_orderkey < 8000 THEN 1.0 WHEN o_orderkey < 10000 THEN 0.25 WHEN o_orderkey < 12000 THEN 1.0 ELSE 0.5 END")} AS multistep,
    {r("CASE WHEN o_orderkey <= 5000 THEN 0.001 + 0.5 * 1.999::DOUBLE * (1 + cos(pi() * (o_orderkey / 5000))) WHEN o_orderkey <= 10000 THEN 0.001 + 0.25 * 1.999::DOUBLE * (1 + cos(pi() * ((o_orderkey - 5000) / 5000))) WHEN o_orderkey <= 15000 THEN 0.001 + 0.125 * 1.999::DOUBLE * (1 + cos(pi() * ((o_orderkey - 10000) / 5000))) END")} AS cosine,
    {r("CASE WHEN o_orderkey < 500 THEN 2.0::DOUBLE / 500 * o_orderkey ELSE 2.0 END")} AS warmup FROM orders"""
_ITERATIONS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 0 ELSE {runs} END AS run, l_orderkey AS iteration FROM lineitem"
O["schedule_asof"] = f"""WITH it AS ({_ITERATIONS.format(runs='(l_suppkey * 7 + l_partkey) % 303 - 1')}),
    st AS (SELECT o_custkey % 301 - 1 AS run, o_orderkey + 5000 - o_orderkey % 7 AS from_iter, max(round(o_totalprice * 100)::BIGINT) AS cents FROM orders GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, it.run, iteration, coalesce(cents, -1) AS cents FROM it ASOF LEFT JOIN st ON it.run = st.run AND it.iteration >= st.from_iter"""
_CONFIGS = """SELECT s_suppkey AS run, s_suppkey / 100 AS base, s_suppkey % 5 * 300 AS warmup, s_suppkey % 2 * 2000 + 2000 AS again,
    [s_suppkey % 4 * 1000 + 1000, s_suppkey % 3 * 2000 + 2000, s_suppkey % 4 * 1000 + 1000, s_suppkey % 6 * 3000] AS marks,
    s_suppkey % 3 * 1000 + 1000 AS p1, s_suppkey * 50 + 1 AS p3 FROM supplier"""
_RATE = """CASE WHEN iteration < warmup THEN base / warmup * iteration ELSE base * CASE WHEN iteration >= again THEN 0.75::DOUBLE ELSE 1 END
    * pow(0.5::DOUBLE, len(list_filter(marks, lambda m: m > CASE WHEN iteration >= again THEN again ELSE 0 END AND m <= iteration))) END"""
O["schedule_multistep"] = f"""WITH it AS ({_ITERATIONS.format(runs='l_suppkey')}), c AS ({_CONFIGS})
    SELECT l_orderkey, l_linenumber, it.run, coalesce({r(_RATE, 9)}, -1) AS rate FROM it LEFT JOIN c USING (run)"""
O["schedule_cosine"] = f"""WITH it AS ({_ITERATIONS.format(runs='l_suppkey')}), c AS ({_CONFIGS}),
    p AS (SELECT run, base, unnest([0, p1, p1 + 3000]) AS begins, unnest([p1, 3000, p3]) AS length, unnest([1.0::DOUBLE, 0.5, 0.25]) AS weight FROM c)
    SELECT l_orderkey, l_linenumber, it.run, coalesce({r('0.001 + weight * 0.5 * (base - 0.001) * (1 + cos(pi() * ((iteration - begins) / length)))', 9)}, -1) AS rate
    FROM it LEFT JOIN p ON it.run = p.run AND iteration > begins - CASE WHEN begins = 0 THEN 1 ELSE 0 END AND iteration <= begins + length"""
O["nearest_code"] = with_("near", f"SELECT vec_id, code_id::BIGINT AS code_id, {r('distance')} AS distance FROM near")
O["nearest_code_blocked"] = O["nearest_code"]
O["resolve_presets"] = """SELECT event_id, ['Modern Portrait', 'Old Photo Restoration', 'Game / Anime Character', 'Custom'][k + 1] AS preset,
    CASE WHEN k < 3 THEN [0.6, 0.85, 0.3][k + 1]::DOUBLE ELSE event_id % 10 / 10 END AS w,
    CASE WHEN k < 3 THEN [0.15, 0.05, 0.0][k + 1]::DOUBLE ELSE event_id % 7 / 10 END AS skin_grain,
    CASE WHEN k < 3 THEN k < 2 ELSE event_id % 2 = 0 END AS eye_enhancement, CASE WHEN k < 3 THEN k < 2 ELSE event_id % 3 = 0 END AS color_match,
    CASE WHEN k < 3 THEN k < 2 ELSE event_id % 5 = 0 END AS enable_eyes, CASE WHEN k < 3 THEN k < 2 ELSE event_id % 7 = 0 END AS enable_lips,
    CASE WHEN k < 3 THEN k < 2 ELSE event_id % 9 = 0 END AS enable_skin FROM (SELECT event_id, CAST(event_id % 4 AS INTEGER) AS k FROM events)"""
O["sweep"] = """SELECT c_custkey, p.preset, p.w, p.skin_grain, p.enable_eyes FROM customer, (VALUES ('Modern Portrait', 0.6::DOUBLE, 0.15::DOUBLE, true),
    ('Old Photo Restoration', 0.85, 0.05, true), ('Game / Anime Character', 0.3, 0.0, false)) p(preset, w, skin_grain, enable_eyes)"""
O["resolve_presets_table"] = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Custom' ELSE n_name END AS preset,
    CASE WHEN c_custkey % 5 = 0 OR n_nationkey % 3 = 0 THEN c_custkey % 10 / 10 ELSE n_nationkey / 10 END AS w,
    CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 4 = 0 ELSE n_nationkey % 2 = 0 END AS enable_eyes FROM customer JOIN nation ON c_nationkey = n_nationkey"""
O["sweep_table"] = "SELECT s_suppkey, n_name AS preset, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey / 10 ELSE -1 END::DOUBLE AS w, n_nationkey % 2 = 0 AS enable_eyes FROM supplier, nation"
O["compare_to_baseline"] = with_(
    "lscore",
    f""", q AS (SELECT a.variant, (a.value - b.value) ** 2 AS mse FROM lscore a JOIN lscore b ON b.variant = 'N' AND a.sample = b.sample),
    s AS (SELECT variant, count(*) AS samples, count(*) FILTER (WHERE mse = 0) AS exact, avg(CASE WHEN mse > 0 THEN 20 * log10(255 / sqrt(mse)) END) AS p FROM q GROUP BY variant),
    l AS (SELECT variant, avg(latency_s) AS m FROM lscore GROUP BY variant)
    SELECT variant, samples, exact, {r('p')} AS mean_psnr, {r('m')} AS mean_latency_s, {r("(SELECT m FROM l WHERE variant = 'N') / m")} AS speedup FROM l LEFT JOIN s USING (variant)""",
)
O["composition"] = with_("listing", "SELECT category, grouping(category) = 1 AS is_total, count(*) AS items, count(*) FILTER (WHERE doc_id % 2 = 0) AS new_items FROM listing GROUP BY ROLLUP (category)")
O["categories"] = "SELECT string_agg(source, ', ' ORDER BY source) AS categories FROM (SELECT DISTINCT source FROM documents)"
O["rejection_report"] = with_("judged", "SELECT reason, count(*) AS items FROM judged GROUP BY reason UNION ALL SELECT 'total', count(*) FROM judged")
O["directory_rollup"] = with_(
    "listing",
    """SELECT folder, depth, bytes, files, CASE WHEN bytes < 1024 THEN printf('%.1f B', bytes::DOUBLE) WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024) ELSE printf('%.1f MB', bytes / 1048576) END AS size FROM (
    SELECT CASE d WHEN 1 THEN split_part(rel_path, '/', 1) ELSE split_part(rel_path, '/', 1) || '/' || split_part(rel_path, '/', 2) END AS folder, d::INTEGER AS depth,
    sum(bytes)::BIGINT AS bytes, count(*) AS files FROM listing, (VALUES (1), (2)) v(d) GROUP BY 1, 2) WHERE bytes > 10000""",
)
O["reclaim_plan"] = with_(
    "listing",
    """SELECT rule, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM (SELECT bytes, CASE WHEN rel_path LIKE 'src1%' THEN 'cache' WHEN ext = '.webp' AND bytes > 3000 THEN 'installers'
    WHEN bytes > 8000 THEN 'large' END AS rule FROM listing) WHERE rule IS NOT NULL GROUP BY rule""",
)
O["channel_moments"] = with_("pix", f"SELECT img, ch, {r('avg(v)')} AS mean, {r('sqrt(var_samp(v) + 0.00001)')} AS std, {r('stddev_pop(v)')} AS std_pop FROM pix GROUP BY img, ch")
O["transfer_moments"] = with_(
    "pix",
    f""", m AS (SELECT img, ch, avg(v) AS m, stddev_pop(v) AS s FROM pix GROUP BY img, ch)
    SELECT p.img, p.ch, p::INTEGER AS pos, {r('v * (1.0::DOUBLE - 0.7) + least(greatest((v - c.m) * (t.s / greatest(c.s, 0.00001)) + t.m, 0), 255) * 0.7', 7)} AS v
    FROM pix p JOIN m c USING (img, ch) JOIN m t ON t.img = p.img + 1 AND t.ch = p.ch""",
)
O["pair_loss"] = with_(
    "ppix",
    f"""SELECT pair, {r('avg(abs(a - b))')} AS l1, {r('sum((a - b) * (a - b))')} AS mse_sum,
    {r('sum(sqrt((a - b) * (a - b) + 1e-12::DOUBLE) * (a / 255)) / sum(a / 255)')} AS charbonnier_weighted FROM ppix GROUP BY pair""",
)
O["total_variation"] = with_(
    "pix",
    f"""SELECT img, ch, {r('avg(abs(v - down)) + avg(abs(v - beside))')} AS tv FROM (SELECT *, lead(v) OVER (PARTITION BY vec_id, x ORDER BY y) AS down,
    lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS beside FROM pix) GROUP BY img, ch""",
)
O["gram"] = with_("pix", f", n AS (SELECT img, count(DISTINCT ch) AS c FROM pix GROUP BY img) SELECT a.img, a.ch AS c1, b.ch AS c2, {r('sum(a.v * b.v) / (any_value(c) * 64)')} AS value FROM pix a JOIN pix b USING (img, p) JOIN n USING (img) GROUP BY a.img, a.ch, b.ch")
O["code_usage"] = with_("near", f"SELECT k AS code_id, count(code_id) AS uses, {r('count(code_id) / (SELECT count(*) FROM near)')} AS share FROM range(16) t(k) LEFT JOIN near ON code_id = k GROUP BY k")
O["perplexity"] = f"SELECT {r('exp(-sum(p * ln(p + 1e-10)))')} AS perplexity FROM (SELECT count(*) / (SELECT count(*) FROM embeddings) AS p FROM embeddings GROUP BY label)"
O["reduce_ranks"] = f"SELECT event_id // 4 AS iteration, event_type AS metric, {r('avg(value / 1000)')} AS value, count(*) AS ranks FROM events GROUP BY 1, 2"
O["detect_gray"] = with_(
    "pix bgr",
    f""", n AS (SELECT img, count(DISTINCT ch) AS channels FROM pix GROUP BY img)
    SELECT img, channels, round((d1 + d2 + d3) / 3 * 12288) / 12288 AS difference, CASE WHEN channels = 1 THEN true ELSE (d1 + d2 + d3) / 3 <= 500 END AS is_gray
    FROM (SELECT img, var_pop(b - g) AS d1, var_pop(g - r) AS d2, var_pop(r - b) AS d3 FROM bgr GROUP BY img) JOIN n USING (img)""",
)
O["class_areas"] = """SELECT img, cls, count(*) AS pixels, sum(CASE WHEN p // 8 BETWEEN 1 AND 6 AND p % 8 BETWEEN 1 AND 6 AND cls NOT IN (0, 14, 16, 17, 18) THEN 255 ELSE 0 END)::BIGINT AS weight_sum
    FROM (SELECT vec_id AS img, p, (floor((e::DOUBLE + 1) * 9.5)::INTEGER % 19)::INTEGER AS cls FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS p FROM embeddings)) GROUP BY img, cls"""
O["identity_distance"] = with_("idp", f"SELECT vec_id, label, {r('distance')} AS distance FROM idp")
O["identity_loss"] = with_("idp", f"SELECT label, {r('avg(distance) * 0.1')} AS identity_loss FROM idp GROUP BY label")
O["summarise_metrics"] = f"""SELECT l_returnflag, metric, {r('avg(value)')} AS mean_value, count(*) AS samples FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem)
    ON l_quantity, l_discount, l_tax INTO NAME metric VALUE value) GROUP BY l_returnflag, metric"""
O["warm_latency"] = f"""SELECT event_type, {r('avg(value)')} AS warm_latency_s, count(*) AS warm_calls FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k > 1 GROUP BY event_type"""
O["acceptance_gate"] = f"""WITH s AS (SELECT l_returnflag AS f, l_partkey AS sample, 'cat_' || (l_partkey % 4) AS category, CASE WHEN l_partkey % 10 <> 0 THEN {mean('l_extendedprice')} END AS psnr,
    {mean('l_discount')} AS ssim, {mean('l_tax')} AS idt FROM lineitem GROUP BY l_returnflag, l_partkey),
    p AS (SELECT c.category, c.psnr AS cp, b.psnr AS bp, c.ssim AS cs, b.ssim AS bs, c.idt AS ci, b.idt AS bi FROM s c JOIN s b USING (sample) WHERE c.f = 'A' AND b.f = 'N'),
    a AS (SELECT coalesce(category, '(all)') AS category, count(*) AS samples, median(cp) AS cpm, median(bp) AS bpm, median(cs) AS csm, median(bs) AS bsm, avg(ci) AS cim, avg(bi) AS bim FROM p GROUP BY ROLLUP (category))
    SELECT category, samples, cpm >= bpm AND csm >= bsm AND cim <= bim AS accepted, {r('cpm', 8)} AS cand_psnr_median, {r('bpm', 8)} AS base_psnr_median, {r('csm', 8)} AS cand_ssim_median, {r('bsm', 8)} AS base_ssim_median,
    {r('cim', 8)} AS cand_identity_mean, {r('bim', 8)} AS base_identity_mean FROM a"""
O["take_per_group"] = with_("listing", "SELECT doc_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS k FROM listing) WHERE k <= 7")
O["take_per_group_large"] = "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 1500"
O["take_quota"] = with_(
    "listing",
    """, t AS (SELECT doc_id FROM labels WHERE toxic = 1), q AS (SELECT category, 5 + count(*) % 7 - count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM t)) AS q FROM listing GROUP BY category)
    SELECT doc_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS k FROM listing WHERE doc_id NOT IN (SELECT doc_id FROM t)) JOIN q USING (category) WHERE k <= q""",
)
O["append_ids"] = """WITH m AS (SELECT source, max(doc_id % 50) AS top FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id % 5 <> 0 GROUP BY source)
    SELECT doc_id, item_id, source || '_' || CASE WHEN length(item_id::VARCHAR) < 5 THEN lpad(item_id::VARCHAR, 5, '0') ELSE item_id::VARCHAR END || '.png' AS item_name FROM (
    SELECT doc_id, source, coalesce(top, -1) + row_number() OVER (PARTITION BY source ORDER BY doc_id) AS item_id FROM documents LEFT JOIN m USING (source) WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""
O["dedupe"] = with_(
    "listing",
    """SELECT md5(text) AS key, 'first' AS keep, arg_min(doc_id, (category, doc_id)) AS doc_id FROM listing GROUP BY 1
    UNION ALL SELECT md5(text), 'last', arg_max(doc_id, rel_path) FROM listing GROUP BY 1""",
)
O["merge_sources"] = with_(
    "listing",
    """SELECT (doc_id % 300) || '.png' AS name, arg_min(right(category, 1), (right(category, 1), rel_path)) AS source, arg_min(doc_id, (right(category, 1), rel_path)) AS doc_id FROM listing GROUP BY 1""",
)
O["largest_box"] = with_(
    "det",
    f"""SELECT img, det_idx, {r('s')} AS box_area FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY s DESC, det_idx) AS k FROM (
    SELECT img, det_idx, (least(x2, img_w) - least(x1, img_w)) * (least(y2, img_h) - least(y1, img_h)) AS s FROM det)) WHERE k = 1""",
)
O["center_box"] = with_(
    "det",
    f"""SELECT img, det_idx, {r('s')} AS center_dist FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY s, det_idx) AS k FROM (
    SELECT img, det_idx, sqrt(((x1 + x2) / 2 - img_w / 2) ** 2 + ((y1 + y2) / 2 - img_h / 2) ** 2) AS s FROM det)) WHERE k = 1""",
)
_OVER = """(greatest(least(b.x2, n.x2) - greatest(b.x1, n.x1), 0) * greatest(least(b.y2, n.y2) - greatest(b.y1, n.y1), 0)) /
    ((b.x2 - b.x1) * (b.y2 - b.y1) + (n.x2 - n.x1) * (n.y2 - n.y1) - greatest(least(b.x2, n.x2) - greatest(b.x1, n.x1), 0) * greatest(least(b.y2, n.y2) - greatest(b.y1, n.y1), 0))"""


def _greedy(source: str, limit: float) -> str:
    """Greedy suppression as a recursion over ranks: the kept boxes of an image travel as a list."""
    return f"""rk AS (SELECT img, row_number() OVER (PARTITION BY img ORDER BY score DESC, det_idx) AS k, {{'id': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS n FROM {source}),
    st(img, k, kept) AS (SELECT img, k, [n] FROM rk WHERE k = 1 UNION ALL
        SELECT rk.img, rk.k, CASE WHEN len(list_filter(st.kept, lambda b: {_OVER} > {limit})) = 0 THEN list_append(st.kept, n) ELSE st.kept END
        FROM st JOIN rk ON rk.img = st.img AND rk.k = st.k + 1),
    keep AS (SELECT img, unnest(kept) AS b FROM (SELECT img, arg_max(kept, k) AS kept FROM st GROUP BY img))"""


O["suppress"] = with_("det", f", {_greedy('det', 0.4)} SELECT keep.img, b.id AS det_idx, {r('score')} AS score FROM keep JOIN det ON det.det_idx = b.id", recursive=True)
O["expand_classes"] = with_(
    "det",
    ", s AS (" + " UNION ALL ".join(f"SELECT img, det_idx, {k} AS cls, score * {u('det_idx', f'class{k}', 3)} AS score FROM det" for k in (0, 2)) + f") SELECT img, det_idx, cls, {r('score')} AS score FROM s WHERE score > 0.25",
)
O["suppress_crowded"] = with_(
    "det",
    f", odd AS (SELECT * REPLACE (CASE WHEN det_idx % 50 = 0 THEN x1 - 5 WHEN det_idx % 50 <> 1 THEN x2 END AS x2) FROM det), {_greedy('odd', 0.4)} SELECT keep.img, b.id AS det_idx, {r('score')} AS score FROM keep JOIN det ON det.det_idx = b.id",
    recursive=True,
)
O["suppress_classes"] = with_(
    "det",
    f""", top AS (SELECT * FROM (SELECT img, det_idx, score, cls, x1 + cls * 4096 AS x1, y1 + cls * 4096 AS y1, x2 + cls * 4096 AS x2, y2 + cls * 4096 AS y2,
        row_number() OVER (PARTITION BY img ORDER BY score DESC, det_idx) AS q FROM det WHERE score > 0.25) WHERE q <= 40), {_greedy('top', 0.45)},
    m AS (SELECT keep.img, b.id AS det_idx, count(*) AS c, sum(n.score * (n.x1 - n.cls * 4096)) / sum(n.score) AS x1, sum(n.score * (n.y1 - n.cls * 4096)) / sum(n.score) AS y1,
        sum(n.score * (n.x2 - n.cls * 4096)) / sum(n.score) AS x2, sum(n.score * (n.y2 - n.cls * 4096)) / sum(n.score) AS y2
        FROM keep JOIN top n ON n.img = keep.img WHERE {_OVER} > 0.45 GROUP BY keep.img, b.id)
    SELECT m.img, m.det_idx, cls, {r('m.x1', 4)} AS x1, {r('m.y1', 4)} AS y1, {r('m.x2', 4)} AS x2, {r('m.y2', 4)} AS y2 FROM m JOIN det USING (det_idx) WHERE c > 1""",
    recursive=True,
)
O["latest_checkpoint"] = with_("ckpt", "SELECT run, max(iter) AS iter, arg_max(path, (iter, path)) AS path FROM ckpt WHERE iter IS NOT NULL GROUP BY run")
O["newest_run"] = with_("ckpt", "SELECT run, max(mtime) AS mtime FROM ckpt GROUP BY run ORDER BY max(mtime) DESC, run LIMIT 1")
_STALE = "iter IS NOT NULL AND iter NOT IN (top, top - 5)"
O["retention_plan"] = with_(
    "ckpt",
    f"SELECT o_orderkey, path, coalesce(iter, -1) AS iter, CASE WHEN run <> 'run_3' OR ({_STALE}) THEN 'drop' ELSE 'keep' END AS action, bytes FROM (SELECT *, max(iter) OVER (PARTITION BY run, kind) AS top FROM ckpt)",
)
O["retention_summary"] = with_(
    "ckpt",
    f"SELECT run, CASE WHEN {_STALE} THEN 'drop' ELSE 'keep' END AS action, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM (SELECT *, max(iter) OVER (PARTITION BY run, kind) AS top FROM ckpt) GROUP BY 1, 2",
)
O["first_available"] = """SELECT p_brand AS model, arg_min(p_partkey, (p_size, p_partkey)) AS path, min(p_size) AS priority FROM part
    WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08) GROUP BY p_brand"""
O["neighbour_frames"] = """WITH f AS (SELECT conv_id AS clip, (turn - min(turn) OVER (PARTITION BY conv_id))::INTEGER AS frame_idx FROM conversations),
    n AS (SELECT *, max(frame_idx) OVER (PARTITION BY clip) AS last FROM f), i AS (SELECT *, (frame_idx + s - 2)::INTEGER AS i FROM n, range(5) t(s))
    SELECT clip, frame_idx, s::INTEGER AS slot, (CASE WHEN i BETWEEN 0 AND last THEN i
    WHEN padding = 'replicate' THEN CASE WHEN i < 0 THEN 0 ELSE last END WHEN padding = 'reflection' THEN CASE WHEN i < 0 THEN -i ELSE last * 2 - i END
    WHEN padding = 'reflection_circle' THEN CASE WHEN i < 0 THEN frame_idx + 2 - i ELSE frame_idx - 2 - (i - last) END ELSE CASE WHEN i < 0 THEN 5 + i ELSE i - 5 END END)::INTEGER AS source_idx, padding
    FROM i, (VALUES ('replicate'), ('reflection'), ('reflection_circle'), ('circle')) p(padding)"""
O["gather_frames"] = """WITH f AS (SELECT conv_id AS clip, turn::INTEGER AS frame_idx, md5(text) AS d, max(turn) OVER (PARTITION BY conv_id)::INTEGER AS last FROM conversations)
    SELECT a.clip, a.frame_idx, string_agg(b.d, ',' ORDER BY s) AS "window" FROM (SELECT *, least(greatest(frame_idx + s - 1, 0), last) AS i FROM f, range(3) t(s)) a
    JOIN f b ON b.clip = a.clip AND b.frame_idx = a.i GROUP BY a.clip, a.frame_idx"""
O["tail"] = with_("ser", f"SELECT run, iteration, {r('value')} AS value FROM ser ORDER BY iteration DESC LIMIT 100")
O["ema"] = with_(
    "ser",
    f""", n AS (SELECT run, iteration, value / 7 AS value, row_number() OVER (PARTITION BY run ORDER BY iteration) AS k FROM ser),
    e(run, k, iteration, e) AS (SELECT run, k, iteration, value FROM n WHERE k = 1 UNION ALL SELECT n.run, n.k, n.iteration, 0.9 * e.e + 0.1 * n.value FROM e JOIN n ON n.run = e.run AND n.k = e.k + 1)
    SELECT run, iteration, {r('e')} AS ema FROM e""",
    recursive=True,
)
O["eta"] = with_(
    "ser",
    f"""SELECT run, iteration, {r('m', 4)} AS sec_per_iter, {r('m * (200000 - iteration - 1)', 3)} AS eta_s FROM (SELECT *, (epoch_us(ts) - epoch_us(t0)) / 1000000 / (iteration - i0 + 1) AS m FROM ser
    JOIN (SELECT run, min(iteration) AS i0, arg_min(ts, iteration) AS t0 FROM ser GROUP BY run) USING (run))""",
)
O["select_holdout"] = with_("held", "SELECT rel_path, category, order_key FROM held")
_SPLIT = u("rel_path", "split", 11)
O["split"] = with_("listing", f"SELECT rel_path, CASE WHEN {_SPLIT} < 0.9 THEN 'train' WHEN {_SPLIT} < 0.95 THEN 'val' ELSE 'test' END AS split FROM listing")
O["epoch_sample"] = with_("docidx", _epoch("n", "2.5", 3, 1))
O["batch"] = with_(
    "docidx",
    f""", ep AS ({_epoch('n', '1', 4, 2)}), f AS (SELECT rank, count(*) // 7 AS f FROM ep GROUP BY rank)
    SELECT rank, rank_pos // 7 AS batch, count(*) AS items, min(doc_id) AS low, sum(doc_id)::BIGINT AS total FROM ep JOIN f USING (rank) WHERE rank_pos // 7 < f GROUP BY 1, 2""",
)


def _plan() -> str:
    cols = []
    for size, spec in {"small": ((0.1, 10.0), (1.0, 20.0), (10, 70)), "large": ((1.0, 15.0), (4.0, 30.0), (5, 50))}.items():
        (slo, shi), (dlo, dhi), (qlo, qhi) = spec
        k = u("rel_path", f"{size}:kernel", 5)
        pi = "3.141592653589793"
        cols += [
            f"CASE WHEN {k} < 0.5 THEN 'iso' ELSE 'aniso' END AS {size}_kernel",
            f"{r(rng('rel_path', size + ':sx', slo, shi, 5))} AS {size}_sigma_x",
            f"{r(rng('rel_path', size + ':sy', slo, shi, 5))} AS {size}_sigma_y",
            f"{r(f'(-{pi}::DOUBLE + ' + u('rel_path', size + ':theta', 5) + ' * 6.283185307179586::DOUBLE)')} AS {size}_theta",
            f"{r(rng('rel_path', size + ':scale', dlo, dhi, 5))} AS {size}_scale",
            f"{r(rng('rel_path', size + ':noise', 0, 30, 5))} AS {size}_noise",
            f"floor({rng('rel_path', size + ':quality', qlo, qhi, 5)})::INTEGER AS {size}_quality",
        ]
    for c in (0, 2):
        cols.append(f"{r(rng('rel_path', f'jitter{c}', -20, 20, 5))} AS jitter_{c}")
    coins = {"flip": 0.5, "motion": 0.15, "gray": 0.01, "jitter": 0.3}
    cols += [f"{u('rel_path', k, 5)} < {v} AS {k}" for k, v in coins.items()]
    return "SELECT rel_path, " + ", ".join(cols) + " FROM listing"


def _degrade() -> str:
    """Blur by rows of the kernel over mirrored rows, area means, noise, linear enlargement, shifts and gray; 24 x 24 pixels, 21 taps."""
    draw = lambda tag, low, high: rng("img", tag, low, high, 9)
    mirror = lambda t: f"CASE WHEN {t} < 0 THEN -({t}) WHEN {t} > 23 THEN 46 - ({t}) ELSE {t} END"
    noise = lambda tag: u("(img || ':' || ch || ':' || (oy * side + ox))", tag, 9)
    cover = lambda o, c: f"greatest(0, least(({o} + 1) * 24 / side, {c} + 1) - greatest({o} * 24 / side, {c})) * side / 24"
    at = lambda c: f"least(greatest(({c} + 0.5) * side / 24 - 0.5, 0), side - 1)"
    pi = "3.141592653589793::DOUBLE"
    return f""", plan AS (SELECT img, {u('img', 'small:kernel', 9)} < 0.5 AS iso, {draw('small:sx', 0.1, 10)} AS sx, {draw('small:sy', 0.1, 10)} AS sy0,
        -{pi} + {u('img', 'small:theta', 9)} * (2 * {pi}) AS th, greatest(1, floor(24 / {draw('small:scale', 1, 20)}))::INTEGER AS side, {draw('small:noise', 0, 30)} AS noise,
        {u('img', 'gray', 9)} < 0.01 AS gray, CASE WHEN {u('img', 'jitter', 9)} < 0.3 THEN [{', '.join(draw(f'jitter{c}', -20, 20) for c in range(3))}] ELSE [0.0, 0.0, 0.0] END AS shift
        FROM (SELECT DISTINCT vec_id // 3 AS img FROM embeddings)),
    taps AS (SELECT img, i, j, exp(-0.5 * (((cos(t) * (j - 10) + sin(t) * (i - 10)) / sx) ** 2 + ((cos(t) * (i - 10) - sin(t) * (j - 10)) / sy) ** 2)) AS k
        FROM (SELECT *, CASE WHEN iso THEN 0 ELSE th END AS t, CASE WHEN iso THEN sx ELSE sy0 END AS sy FROM plan), range(21) a(i), range(21) b(j)),
    kern AS (SELECT img, i, list(k / total ORDER BY j) AS krow FROM (SELECT *, sum(k) OVER (PARTITION BY img) AS total FROM taps) GROUP BY img, i),
    big AS (SELECT vec_id // 3 AS img, vec_id % 3 AS ch, y, list_transform(range(44), lambda x: plane[((y // 3) * 8 + ({mirror('(x - 10)')}) // 3 + 1)::INTEGER]) AS prow FROM vec, range(24) r(y)),
    lines AS (SELECT big.img, ch, r.y, list_transform(range(24), lambda x: list_inner_product(krow, prow[x + 1 : x + 21])) AS vs
        FROM kern JOIN big USING (img), range(24) r(y) WHERE big.y = {mirror('(r.y + i - 10)')}),
    blur AS (SELECT img, ch, y, x, sum(v) AS v FROM (SELECT img, ch, y, unnest(vs) AS v, unnest(range(24)) AS x FROM lines) GROUP BY img, ch, y, x),
    rows_ AS (SELECT img, ch, oy, x, side, noise, sum(v * {cover('oy', 'y')}) AS v FROM blur JOIN plan USING (img), range(24) o(oy) WHERE oy < side AND y + 1 > oy * 24 / side AND y < (oy + 1) * 24 / side GROUP BY ALL),
    small AS (SELECT img, ch, oy, ox, side, noise, sum(v * {cover('ox', 'x')}) AS v FROM rows_, range(24) o(ox) WHERE ox < side AND x + 1 > ox * 24 / side AND x < (ox + 1) * 24 / side GROUP BY ALL),
    noisy AS (SELECT img, ch, side, list(least(greatest(v + sqrt(-2 * ln(1 - {noise('n1')})) * cos(2 * {pi} * {noise('n2')}) * noise, 0), 255) ORDER BY oy, ox) AS p FROM small GROUP BY img, ch, side),
    spots AS (SELECT *, floor(ay)::INTEGER AS ly, floor(ax)::INTEGER AS lx, least(floor(ay) + 1, side - 1)::INTEGER AS hy, least(floor(ax) + 1, side - 1)::INTEGER AS hx, ay - floor(ay) AS fy, ax - floor(ax) AS fx
        FROM (SELECT *, {at('y')} AS ay, {at('x')} AS ax FROM noisy, range(24) a(y), range(24) b(x))),
    moved AS (SELECT img, ch, y, x, gray, least(greatest((1 - fy) * ((1 - fx) * p[ly * s.side + lx + 1] + fx * p[ly * s.side + hx + 1]) + fy * ((1 - fx) * p[hy * s.side + lx + 1] + fx * p[hy * s.side + hx + 1]) + shift[ch + 1], 0), 255) AS v
        FROM spots s JOIN plan USING (img)),
    mixed AS (SELECT img, ch, y, x, CASE WHEN gray THEN sum([0.1140::DOUBLE, 0.5870, 0.2989][ch + 1] * v) OVER (PARTITION BY img, y, x) ELSE v END AS v FROM moved)
    SELECT img, ch::INTEGER AS ch, {r('sum(least(greatest(round(v), 0), 255))')} AS total, 576 AS pixels FROM mixed GROUP BY img, ch"""


O["degrade"] = with_("vec", _degrade())
O["degradation_plan"] = with_("listing", _plan())
O["crop_plan"] = with_(
    "listing",
    f"""SELECT rel_path, status, CASE WHEN ok THEN floor({u('rel_path', 'top', 3)} * (h - 128 + 1)) ELSE -1 END::INTEGER AS top, CASE WHEN ok THEN floor({u('rel_path', 'left', 3)} * (w - 128 + 1)) ELSE -1 END::INTEGER AS "left",
    CASE WHEN ok THEN 2 * floor({u('rel_path', 'top', 3)} * (h - 128 + 1)) ELSE -1 END::INTEGER AS top_gt, CASE WHEN ok THEN 2 * floor({u('rel_path', 'left', 3)} * (w - 128 + 1)) ELSE -1 END::INTEGER AS left_gt,
    CASE WHEN ok THEN {u('rel_path', 'hflip', 3)} < 0.5 ELSE false END AS hflip, CASE WHEN ok THEN {u('rel_path', 'vflip', 3)} < 0.5 ELSE false END AS vflip, CASE WHEN ok THEN {u('rel_path', 'rot90', 3)} < 0.5 ELSE false END AS rot90
    FROM (SELECT *, status = 'ok' AS ok FROM (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'scale_mismatch' WHEN h < 128 OR w < 128 THEN 'too_small' ELSE 'ok' END AS status FROM listing))""",
)
O["mod_crop"] = with_("listing", "SELECT doc_id, (h // 4 * 4)::INTEGER AS h, (w // 4 * 4)::INTEGER AS w FROM listing")


def _tiles(size: int, pad: int, step: int, mode: str) -> str:
    fit = f"(h <= {size} AND w <= {size})"
    pick = lambda a, b: f"(CASE WHEN {fit} THEN {a} ELSE {b} END)::INTEGER"
    return f"""SELECT img, h, w, r::INTEGER AS row, c::INTEGER AS col, (c * {step})::INTEGER AS x, (r * {step})::INTEGER AS y,
    {pick('w', f'least({step}, w - c * {step})')} AS core_w, {pick('h', f'least({step}, h - r * {step})')} AS core_h,
    {pick('0', f'greatest(c * {step} - {pad}, 0)')} AS x1, {pick('0', f'greatest(r * {step} - {pad}, 0)')} AS y1,
    {pick('w', f'least(c * {step} + {step + pad}, w)')} AS x2, {pick('h', f'least(r * {step} + {step + pad}, h)')} AS y2, '{mode}' AS mode
    FROM (SELECT doc_id AS img, h, w, unnest(range(CASE WHEN {fit} THEN 1 ELSE (w + {step - 1}) // {step} END)) AS c, r FROM (
    SELECT doc_id, h, w, unnest(range(CASE WHEN {fit} THEN 1 ELSE (h + {step - 1}) // {step} END)) AS r FROM listing))"""


O["tile"] = with_("listing", _tiles(400, 40, 320, "overlap") + " UNION ALL " + _tiles(200, 10, 200, "fixed"))
O["stitch"] = with_("pix", "SELECT img, ch, y::INTEGER AS y, x::INTEGER AS x, v * 2 AS v FROM pix")
O["stitch_coverage"] = with_("pix", """, due AS (SELECT img, ch::INTEGER AS ch FROM (SELECT DISTINCT img FROM pix), range(3) t(ch)), seen AS (SELECT img, ch, count(*) AS n FROM pix WHERE (img + ch + x * y) % 97 <> 0 GROUP BY img, ch)
    SELECT img, ch, coalesce(n, 0) AS "distinct" FROM due LEFT JOIN seen USING (img, ch) WHERE coalesce(n, 0) <> 64""")
O["stitch_planes"] = O["stitch"]
O["tile_coverage"] = with_(
    "pix",
    """, shapes AS (SELECT DISTINCT img, ch FROM pix), cells AS (SELECT img, ch, r.k AS row, c.k AS col, (img * 3 + ch + r.k * 2 + c.k) % 11 AS mark FROM shapes, range(2) r(k), range(2) c(k)),
    rects AS (SELECT img, ch, row * 5 AS y, col * 5 AS x, CASE row WHEN 0 THEN 5 ELSE 3 END AS hh, CASE col WHEN 0 THEN 5 ELSE 3 END AS ww FROM cells WHERE mark > 0
        UNION ALL SELECT img, ch, row * 5, greatest(col * 5 - 1, 0), CASE row WHEN 0 THEN 5 ELSE 3 END, CASE col WHEN 0 THEN 5 ELSE 3 END FROM cells WHERE mark = 1),
    dots AS (SELECT img, ch, y + a.k AS py, x + b.k AS px, count(*) AS n FROM rects, range(5) a(k), range(5) b(k) WHERE a.k < hh AND b.k < ww GROUP BY ALL),
    seen AS (SELECT img, ch, count(*) AS d, max(n) AS m FROM dots GROUP BY img, ch),
    due AS (SELECT img, ch::INTEGER AS ch FROM (SELECT DISTINCT img FROM pix), range(3) t(ch))
    SELECT img, ch, coalesce(d, 0) AS "distinct", coalesce(m, 0) AS most FROM due LEFT JOIN seen USING (img, ch) WHERE coalesce(d, 0) <> 64 OR m > 1""",
)
O["composite_planes"] = with_(
    "pix",
    f"""SELECT img, 0 AS ch, y::INTEGER AS y, x::INTEGER AS x, {r('least(greatest(CASE WHEN v2 IS NULL THEN b1 ELSE m2 * v2 + (1 - m2) * b1 END, 0), 255)')} AS v FROM (
    SELECT a.vec_id AS img, a.y, a.x, c.v AS v2, least(1 - (c.x + c.y) % 5 / 4, c.x / 8) AS m2, CASE WHEN b.v IS NULL THEN a.v ELSE (a.x + a.y) % 5 / 4 * b.v + (1 - (a.x + a.y) % 5 / 4) * a.v END AS b1
    FROM pix a LEFT JOIN pix b ON b.vec_id = a.vec_id + 1 AND b.p = a.p LEFT JOIN pix c ON c.vec_id = a.vec_id + 2 AND c.y = a.y + 2 AND c.x = a.x - 3)""",
)
O["composite"] = with_(
    "pix",
    f"""SELECT img, 0 AS ch, y::INTEGER AS y, x::INTEGER AS x, {r('least(greatest(CASE WHEN v2 IS NULL THEN b1 ELSE m2 * v2 + (1 - m2) * b1 END, 0), 255)')} AS v FROM (
    SELECT a.vec_id AS img, a.y, a.x, c.v AS v2, least(1 - (a.x + a.y) % 5 / 4, a.x / 8) AS m2, CASE WHEN b.v IS NULL THEN a.v ELSE (a.x + a.y) % 5 / 4 * b.v + (1 - (a.x + a.y) % 5 / 4) * a.v END AS b1
    FROM pix a LEFT JOIN pix b ON b.vec_id = a.vec_id + 1 AND b.p = a.p LEFT JOIN pix c ON c.vec_id = a.vec_id + 2 AND c.p = a.p)""",
)
O["calibration_sample"] = with_("listing", "SELECT rel_path FROM listing WHERE ext <> '.txt' ORDER BY rel_path LIMIT 25")
O["psnr"] = with_("ppix", f"SELECT pair, {r('20 * log10(255 / sqrt(avg((a - b) ** 2)))')} AS psnr FROM ppix WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY pair HAVING avg((a - b) ** 2) > 0")
O["psnr_luma"] = with_(
    "ipix",
    f"""SELECT pair, {r('20 * log10(255 / sqrt(avg(d * d)))')} AS psnr FROM (SELECT pair, p, sum(CASE ch WHEN 0 THEN 24.966::DOUBLE WHEN 1 THEN 128.553 ELSE 65.481 END * (a - b) / 255) AS d, count(*) AS n
    FROM ipix GROUP BY pair, p) WHERE n = 3 GROUP BY pair""",
)
O["ssim"] = with_(
    "ppix",
    f""", k AS (SELECT i, exp(-((i - 5) ** 2) / 4.5::DOUBLE) / (SELECT sum(exp(-((j - 5) ** 2) / 4.5::DOUBLE)) FROM range(11) t(j)) AS w FROM range(11) t(i)),
    g AS (SELECT pair, yy, xx, a, b FROM ppix, range(24) s(yy), range(24) q(xx) WHERE y = yy // 3 AND x = xx // 3),
    d AS (SELECT pair, yy, xx - i AS ox, sum(w * a) AS a, sum(w * b) AS b, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM g, k WHERE xx - i BETWEEN 0 AND 13 GROUP BY pair, yy, ox),
    f AS (SELECT pair, yy - i AS oy, ox, sum(w * a) AS a, sum(w * b) AS b, sum(w * aa) AS aa, sum(w * bb) AS bb, sum(w * ab) AS ab FROM d, k WHERE yy - i BETWEEN 0 AND 13 GROUP BY pair, oy, ox)
    SELECT pair, {r('avg(((2 * a * b + 6.5025) * (2 * (ab - a * b) + 58.5225)) / ((a * a + b * b + 6.5025) * (aa - a * a + bb - b * b + 58.5225)))')} AS ssim FROM f GROUP BY pair""",
)
_LAP = """SELECT a.vec_id, a.img, a.ch, a.p, sum(b.v) - 4 * any_value(a.v) AS l FROM pix a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx), pix b
    WHERE b.vec_id = a.vec_id AND b.y = CASE WHEN a.y + dy < 0 THEN 1 WHEN a.y + dy > 7 THEN 6 ELSE a.y + dy END AND b.x = CASE WHEN a.x + dx < 0 THEN 1 WHEN a.x + dx > 7 THEN 6 ELSE a.x + dx END GROUP BY a.vec_id, a.img, a.ch, a.p"""
O["sharpness"] = with_("pix", f"SELECT img, ch, round(var_pop(l) * 4096) / 4096 AS sharpness FROM ({_LAP}) GROUP BY img, ch")
O["quality_report"] = with_(
    "ipix",
    f""", s AS (SELECT img, var_pop(l) AS s FROM ({_LAP}) WHERE ch = 0 GROUP BY img), c AS (SELECT pair, avg(abs(a - b)) AS d FROM ipix WHERE ch > 0 GROUP BY pair),
    q AS (SELECT o.img // 2 AS pair, o.s AS so, e.s AS se FROM s o JOIN s e ON e.img = o.img + 1 WHERE o.img % 2 = 0)
    SELECT pair, round_even(so, 1) AS orig_sharpness, round_even(se, 1) AS enh_sharpness, round_even(least(greatest((se - so) / greatest(so, 0.00001) * 100, 0), 1000), 1) AS sharpness_gain_pct,
    CASE WHEN d IS NOT NULL THEN round_even(least(greatest(100 - d * 1.5, 70), 99.9), 1) END AS tone_fidelity_pct FROM q LEFT JOIN c USING (pair)""",
)
O["convolve"] = with_(
    "pix",
    f"""SELECT a.img, a.ch, a.y::INTEGER AS y, a.x::INTEGER AS x, {r('sum(k * b.v)')} AS v FROM pix a, (VALUES (-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)) o(dy, dx, k), pix b
    WHERE b.vec_id = a.vec_id AND b.y = CASE WHEN a.y + dy < 0 THEN 1 WHEN a.y + dy > 7 THEN 6 ELSE a.y + dy END AND b.x = CASE WHEN a.x + dx < 0 THEN 1 WHEN a.x + dx > 7 THEN 6 ELSE a.x + dx END GROUP BY a.vec_id, a.img, a.ch, a.y, a.x""",
)
O["evaluate"] = with_(
    "ppix",
    f""", e AS (SELECT pair, yy, xx, (a - b) ** 2 AS d FROM ppix, range(24) s(yy), range(24) q(xx) WHERE y = yy // 3 AND x = xx // 3),
    p AS (SELECT 'psnr' AS metric, pair, avg(d) AS m FROM e GROUP BY pair UNION ALL SELECT 'psnr_cropped', pair, avg(d) FROM e WHERE yy BETWEEN 4 AND 19 AND xx BETWEEN 4 AND 19 GROUP BY pair)
    SELECT metric, {r('avg(20 * log10(255 / sqrt(m)))')} AS mean_value, count(*) AS samples FROM p GROUP BY metric""",
)
O["validate_manifest"] = with_(
    "man",
    """SELECT id, violation, count(*) AS row_count FROM (SELECT id, unnest(list_filter([CASE WHEN id = '' THEN 'blank_id' END, CASE WHEN category = '' THEN 'blank_category' END, CASE WHEN input_path = '' THEN 'blank_input' END,
    CASE WHEN input_path LIKE '%.gif' THEN 'bad_input_suffix' END, CASE WHEN reference_path LIKE '%.tiff' THEN 'bad_reference_suffix' END], lambda v: v IS NOT NULL)) AS violation FROM man) GROUP BY 1, 2
    UNION ALL SELECT id, 'duplicate_id', count(*) FROM man WHERE id <> '' GROUP BY id HAVING count(*) > 1""",
)
O["require"] = with_("listing", "SELECT ext, count(*) AS items FROM listing GROUP BY ext")
O["read_training_log"] = f"""SELECT event_id AS iteration, (CASE WHEN s >= 172800 THEN (s // 86400) || ' days, ' WHEN s >= 86400 THEN '1 day, ' ELSE '' END) || (s % 86400 // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS eta,
    s AS eta_s, {r("printf('%.4e', value / 1000)::DOUBLE", 9)} AS l_g_pix, {r("printf('%.4e', value / 1000 * 3)::DOUBLE", 9)} AS l_g_percep, {r("printf('%.4e', value / 1000 * 2)::DOUBLE", 9)} AS l_g_identity
    FROM (SELECT *, event_id * 77 % 200000 AS s FROM events WHERE event_type <> 'error')"""
O["stream_training_log"] = O["read_training_log"]
O["run_liveness"] = "SELECT user_id AS run, max(ts) AS last_ts, CASE WHEN epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) < 36000000000 THEN 'running' ELSE 'paused' END AS status FROM events GROUP BY user_id"
O["latest_progress"] = with_("prog", "SELECT request, stage, CASE WHEN stage = 'complete' THEN 1.0::DOUBLE ELSE progress END AS progress, message, ts FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY ts DESC, event_id DESC) AS k FROM prog) WHERE k = 1")
O["stream_progress"] = O["latest_progress"]
O["stage_durations"] = with_("prog", f"SELECT request, stage, {r('(epoch_us(lead(t) OVER (PARTITION BY request ORDER BY t, stage)) - epoch_us(t)) / 1000000')} AS seconds FROM (SELECT request, stage, min(ts) AS t FROM prog GROUP BY request, stage)")
O["ingest_batch"] = with_(
    "listing",
    """, h AS (SELECT md5(text) AS key, doc_id % 40 AS item_id FROM listing WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    n AS (SELECT md5(text) AS key, min(doc_id) AS doc_id FROM listing WHERE bytes > 300 GROUP BY 1),
    z AS (SELECT doc_id, key, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM n WHERE key NOT IN (SELECT key FROM h))
    SELECT doc_id, key, k + 1 + (SELECT max(item_id) FROM h) AS item_id, 'item_' || lpad((k + 1 + (SELECT max(item_id) FROM h))::VARCHAR, 6, '0') || '.png' AS item_name FROM z WHERE k < greatest(0, 500 - (SELECT count(*) FROM h))""",
)
O["stream_ingest"] = with_(
    "listing",
    """, n AS (SELECT md5(text) AS key, min(doc_id) AS doc_id FROM listing WHERE bytes > 300 GROUP BY 1)
    SELECT doc_id, key, k AS item_id, 'item_' || lpad(k::VARCHAR, 6, '0') || '.png' AS item_name FROM (SELECT doc_id, key, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM n) WHERE k < 500""",
)
O["stream_ingest_again"] = with_(
    "listing",
    """, h AS (SELECT md5(text) AS key, doc_id % 40 AS item_id FROM listing WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    a AS (SELECT md5(text) AS key, min(doc_id) AS doc_id FROM listing WHERE bytes > 300 AND doc_id % 2 = 0 AND md5(text) NOT IN (SELECT key FROM h) GROUP BY 1),
    b AS (SELECT md5(text) AS key, min(doc_id) AS doc_id FROM listing WHERE bytes > 300 AND md5(text) NOT IN (SELECT key FROM h UNION ALL SELECT key FROM a) GROUP BY 1),
    z AS (SELECT doc_id, key, (SELECT max(item_id) FROM h) + row_number() OVER (ORDER BY part, doc_id) AS k FROM (SELECT *, 1 AS part FROM a UNION ALL SELECT *, 2 FROM b))
    SELECT doc_id, key, k AS item_id, 'item_' || lpad(k::VARCHAR, 6, '0') || '.png' AS item_name FROM z""",
)
O["stream_liveness"] = """SELECT user_id AS run, make_timestamp(epoch_us(max(ts)) // 1000 * 1000) AS last_ts,
    CASE WHEN epoch_us((SELECT max(ts) FROM events)) // 1000 - epoch_us(max(ts)) // 1000 >= 36000000 THEN 'paused' ELSE 'running' END AS status FROM events GROUP BY user_id"""
O["score"] = f"""SELECT vec_id, f AS failed, pos::INTEGER AS pos, {r('CASE WHEN f THEN v ELSE v * 2 END')} AS v FROM (SELECT vec_id, embedding[1] < 0 AS f, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS pos FROM embeddings)"""
O["human_bytes"] = """SELECT o_orderkey, printf('%.1f ', s / 1024.0::DOUBLE ** k) || ['', 'K', 'M', 'G', 'T', 'P', 'E', 'Z'][k + 1] || 'B' AS size FROM (
    SELECT *, (CASE WHEN s < 1024 THEN 0 WHEN s < 1048576 THEN 1 WHEN s < 1073741824 THEN 2 WHEN s < 1099511627776 THEN 3 ELSE 4 END)::INTEGER AS k FROM (
    SELECT o_orderkey, floor(o_totalprice * 8.0::DOUBLE ** (o_orderkey % 9))::BIGINT AS s FROM orders))"""
_PTS = {
    0: ("x1 + 10", "y1 + 12"), 1: ("x1 + 10 + det_idx % 12", "y1 + 12 + det_idx % 5"), 2: ("(x1 + x2) / 2", "(y1 + y2) / 2"),
    3: ("x1 + (x2 - x1) / 4", "y1 + (y2 - y1) * 0.75::DOUBLE"), 4: ("x1 + (x2 - x1) * 0.75::DOUBLE", "y1 + (y2 - y1) * 0.75::DOUBLE"),
}
O["landmark_offsets"] = with_(
    "det",
    ", d AS (SELECT *, " + _offsets("det_idx") + " FROM det) "
    + " UNION ALL ".join(
        f"SELECT img, det_idx, {k} AS point, {r(f'({x} - pcx) / (0.1 * pw)')} AS x, {r(f'({y} - pcy) / (0.1 * ph)')} AS y FROM d" for k, (x, y) in _PTS.items()
    ),
)
O["seeded_uniform"] = f"SELECT c_custkey, {r(u('c_custkey', 'probe', 42), 9)} AS u FROM customer"
