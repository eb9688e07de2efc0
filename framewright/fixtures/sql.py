"""DuckDB text of the derived collections, for the oracle."""

from __future__ import annotations

_VIEWS = {
    # one row per pixel
    "thumbs": """
SELECT vec_id*4+k AS image_id, vec_id % 5 AS folder,
       'img_' || lpad(CAST(vec_id*4+k AS VARCHAR), 7, '0') || '.png' AS name,
       CAST(i // 9 AS INT) AS y, CAST(i % 9 AS INT) AS x,
       CAST(least(255, greatest(0, CASE k WHEN 0 THEN b WHEN 1 THEN b + (i*7+vec_id) % 3 - 1
            WHEN 2 THEN b + CASE WHEN vec_id % 9 = 0 THEN -140 ELSE 40 END
            ELSE floor(b/16) + 8 + vec_id % 12 END)) AS INT) AS v
FROM (SELECT vec_id, i, floor((CAST(list_extract(embedding, CAST(i % 64 + 1 AS INT)) AS DOUBLE)+0.6)*210) AS b
      FROM embeddings CROSS JOIN range(0,72) AS r(i)) AS e
CROSS JOIN (VALUES (0),(1),(2),(3)) AS u(k)""",
    # one row per pixel and channel, blue green red
    "colour": """
SELECT image_id, folder, name, y, x, c,
       CASE WHEN v = 0 THEN 0 WHEN c = 0 THEN 255 - v WHEN c = 1 THEN v * 2 % 256 ELSE v END AS s
FROM thumbs CROSS JOIN (VALUES (0),(1),(2)) AS ch(c)""",
    "measures": """
SELECT t.image_id, any_value(folder) AS folder, any_value(name) AS name, any_value(l.var_laplacian) AS var_laplacian,
       CAST(sum(v) AS DOUBLE) / 72 AS mean_luma
FROM thumbs t JOIN (
  SELECT image_id, CAST(sum(d*d) AS DOUBLE) / count(*) - (CAST(sum(d) AS DOUBLE) / count(*)) * (CAST(sum(d) AS DOUBLE) / count(*)) AS var_laplacian
  FROM (SELECT image_id, x, y,
          lag(v) OVER r + lead(v) OVER r + lag(v) OVER c + lead(v) OVER c - 4*v AS d
        FROM thumbs WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y))
  WHERE x BETWEEN 1 AND 7 AND y BETWEEN 1 AND 6 GROUP BY image_id) l USING (image_id)
GROUP BY t.image_id""",
    "bits": """
SELECT image_id, y*8+x AS pos, CASE WHEN v > nxt THEN 1 ELSE 0 END AS bit
FROM (SELECT image_id, x, y, v, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS nxt FROM thumbs) WHERE x < 8""",
    "pairs": """
SELECT folder, a_image_id, a_name, image_id AS b_image_id, name AS b_name
FROM (SELECT *, lag(image_id) OVER w AS a_image_id, lag(name) OVER w AS a_name
      FROM (SELECT DISTINCT image_id, folder, name FROM thumbs)
      WINDOW w AS (PARTITION BY folder ORDER BY lower(name), name)) WHERE a_image_id IS NOT NULL""",
    "distances": """
SELECT p.folder, p.a_image_id, p.a_name, p.b_image_id, p.b_name, CAST(sum(CASE WHEN a.bit <> b.bit THEN 1 ELSE 0 END) AS INT) AS distance
FROM pairs p JOIN bits a ON a.image_id = p.a_image_id JOIN bits b ON b.image_id = p.b_image_id AND a.pos = b.pos
GROUP BY ALL""",
    "frames": """
SELECT user_id AS video_id, event_id AS frame_id,
       CAST(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS DOUBLE) / 1000000 AS pts_s,
       value / 2 AS y_avg, CAST(event_id * 37 % 100 AS DOUBLE) / 1000 AS scene
FROM events""",
    "segments": """
SELECT user_id AS video_id, n AS seg,
       CAST(CASE WHEN user_id % 10 = 0 THEN -1 WHEN n = 1 THEN (user_id % 10) * 86400 ELSE 20 * 86400 END AS INT) AS start_s,
       CAST(CASE WHEN user_id % 10 = 0 THEN -1 WHEN n = 1 THEN (user_id % 10 + 5) * 86400 ELSE 30 * 86400 END AS INT) AS end_s,
       'Frame_' AS prefix
FROM (SELECT DISTINCT user_id FROM events) AS e CROSS JOIN (VALUES (1),(2)) AS u(n)
WHERE user_id % 10 <> 0 OR n = 1""",
    "matched": """
SELECT f.video_id, f.frame_id, f.pts_s, s.seg, s.start_s, s.end_s FROM frames f JOIN segments s ON f.video_id = s.video_id
 AND (s.start_s < 0 OR s.end_s < 0 OR (f.pts_s >= s.start_s AND f.pts_s <= s.end_s))""",
    "decoder_log": """
SELECT user_id AS video_id, event_id AS line_no,
       CASE WHEN event_type = 'error' THEN '[mpdecimate] drop pts:' || event_id || ' drop_count: ' || (event_id % 4)
            ELSE 'frame=' || event_id END AS line
FROM events""",
    "catalog": """
SELECT doc_id AS image_id, '/ds/' || source || '/img_' || doc_id ||
         CASE doc_id % 7 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.JPEG' WHEN 3 THEN '.bmp'
                         WHEN 4 THEN '.gif' WHEN 5 THEN '.txt' ELSE '.dcm' END AS path,
       source AS folder, CAST(64 + n_chars % 960 AS INT) AS width, CAST(64 + n_chars * 7 % 720 AS INT) AS height,
       n_chars AS bytes, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE lang END AS annotation
FROM documents""",
    "crop_requests": """
SELECT l_suppkey AS manifest_id, l_orderkey, l_linenumber, l_partkey AS image_id, l_extendedprice AS tiebreak,
       CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(l_orderkey % 900 - 20 AS INT) END AS x1,
       CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(l_orderkey * 3 % 700 AS INT) END AS y1,
       CASE WHEN l_orderkey % 4 = 1 THEN CAST(l_quantity * 5 AS INT) END AS w,
       CASE WHEN l_orderkey % 4 = 1 THEN CAST(l_quantity * 4 AS INT) END AS h,
       CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_orderkey % 300 AS INT) END AS tl_x,
       CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_orderkey % 200 AS INT) END AS tl_y,
       CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_orderkey % 300 + 127 AS INT) END AS br_x,
       CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_orderkey % 200 + 63 AS INT) END AS br_y,
       CASE WHEN l_linenumber = 3 THEN ' ' ELSE l_returnflag || ' ' || l_linestatus END AS annotation
FROM lineitem""",
    "crops": """
SELECT manifest_id, l_orderkey, l_linenumber, image_id, tiebreak, annotation,
       coalesce(x1, tl_x) AS x, coalesce(y1, tl_y) AS y,
       coalesce(w, br_x - coalesce(x1, tl_x) + 1, 256) AS w, coalesce(h, br_y - coalesce(y1, tl_y) + 1, 128) AS h
FROM crop_requests""",
    "outcomes": """
SELECT c.*, i.width AS image_width, i.height AS image_height,
       CASE WHEN x IS NULL OR y IS NULL THEN 'incomplete' WHEN i.image_id IS NULL THEN 'no image'
            WHEN w > 0 AND h > 0 AND x >= 0 AND y >= 0 AND x + w <= i.width AND y + h <= i.height THEN 'done'
            ELSE 'out of bounds' END AS outcome
FROM crops c LEFT JOIN catalog i USING (image_id)""",
    "manifests": """
SELECT s_suppkey AS manifest_id, '/meta/' || s_nationkey || '/crop_metadata_' || s_suppkey || '.json' AS path,
       s_suppkey % 5 = 0 AS done, s_suppkey % 13 <> 0 AS has_crops
FROM supplier""",
    "existing_files": """
SELECT '/sink/' || o_orderstatus AS sink,
       CASE WHEN o_orderkey % 4 = 0 THEN lower(substr(o_orderpriority, 3, 4)) ELSE substr(o_orderpriority, 3, 4) END || '_' || CASE o_custkey % 3 WHEN 0 THEN '64x64' WHEN 1 THEN '128x64' ELSE '200x160' END
         || '_' || lpad(CAST(o_orderkey % 9000 * 3 AS VARCHAR), 5, '0')
         || CASE WHEN o_orderkey % 17 = 0 THEN '.txt' WHEN o_orderkey % 5 = 0 THEN '.PNG' ELSE '.png' END AS name
FROM orders""",
    # one row per voxel
    "voxels": """
SELECT vec_id // 64 AS volume_id, CAST(vec_id % 64 AS INT) AS z, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
  CASE WHEN vec_id % 64 % 10 = 9 THEN CAST(7 AS DOUBLE)
       WHEN vec_id % 64 % 10 = 8 THEN CASE WHEN i = 5 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
       WHEN (vec_id*64+i) % 97 = 0 THEN CAST('NaN' AS DOUBLE)
       ELSE CAST(list_extract(embedding, CAST(i + 1 AS INT)) AS DOUBLE) * 1000 END AS v
FROM embeddings CROSS JOIN range(0,64) AS r(i)""",
    "view_voxels": """
SELECT volume_id, 'axial' AS view, z AS idx, y AS r, x AS c, v FROM voxels
UNION ALL SELECT volume_id, 'coronal', y, z, x, v FROM voxels
UNION ALL SELECT volume_id, 'sagittal', x, z, y, v FROM voxels""",
    "normalised": """
SELECT volume_id, view, idx, r, c,
  CASE WHEN hi IS NULL OR hi = lo OR isnan(v) THEN 0.5 ELSE (v - lo) / (hi - lo) END AS n
FROM (SELECT *, min(CASE WHEN NOT isnan(v) THEN v END) OVER w AS lo, max(CASE WHEN NOT isnan(v) THEN v END) OVER w AS hi
      FROM view_voxels WINDOW w AS (PARTITION BY volume_id, view, idx))""",
    "gray": """
SELECT volume_id, view, idx, r, c, CAST(trunc(n * 255) AS INT) AS p FROM normalised""",
    "volume_headers": """
SELECT '/vol/' || source || '/scan_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.nii.gz' WHEN 1 THEN '.NII' ELSE '.nii' END AS path,
  doc_id, n_chars, nd AS ndim, 16 + n_chars % 500 AS d1, CASE WHEN nd >= 2 THEN 16 + n_chars * 3 % 400 ELSE 1 END AS d2,
  CASE WHEN nd >= 3 THEN 1 + n_chars % 90 ELSE 1 END AS d3, CASE WHEN nd >= 4 THEN 2 ELSE 1 END AS d4,
  CASE doc_id % 6 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 WHEN 3 THEN 32 WHEN 4 THEN 64 ELSE 16 END AS bitpix
FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 1 END AS nd FROM documents)""",
    "view_list": """
SELECT path, CASE WHEN ndim >= 3 THEN view ELSE 'axial' END AS view,
  CASE WHEN ndim = 2 THEN d2 WHEN view = 'axial' THEN d3 WHEN view = 'coronal' THEN d2 ELSE d1 END AS n_slices,
  CASE WHEN ndim = 2 THEN d1 WHEN view = 'sagittal' THEN d2 ELSE d1 END AS slice_w,
  CASE WHEN ndim = 2 THEN 1 WHEN view = 'axial' THEN d2 ELSE d3 END AS slice_h
FROM volume_headers CROSS JOIN (VALUES ('axial'),('coronal'),('sagittal')) AS u(view)
WHERE ndim >= 3 OR (ndim = 2 AND view = 'axial')""",
    "dicom_tags": """
SELECT vec_id AS file_id, '/dcm/d' || (vec_id % 7) || '/' || vec_id || '.dcm' AS path, '/dcm/d' || (vec_id % 7) AS parent,
       CASE WHEN vec_id % 17 = 0 THEN '' ELSE '1.2.3.' || label END AS series_uid,
       CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(list_extract(embedding, 1) AS DOUBLE) END AS slice_location,
       CASE WHEN vec_id % 10 = 0 THEN NULL ELSE CAST(list_extract(embedding, 2) AS DOUBLE) END AS position_z
FROM embeddings""",
    "heads": """
SELECT '/in/' || source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.DCM' WHEN 3 THEN '.bin' ELSE '.dcm' END AS path,
       source AS folder, n_chars AS length, doc_id % 3 = 0 AS magic
FROM documents""",
    "objects": """
SELECT CASE WHEN page_id % 4 = 0 THEN 'raw/' ELSE 'Images/' END || (page_id % 9) || '/p' || page_id ||
              CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' ELSE '.html' END AS key,
       CAST(length(html) AS BIGINT) AS size, page_id % 2 = 0 AS mirrored,
       CASE WHEN page_id % 6 = 0 THEN 0 ELSE CAST(length(html) AS BIGINT) END AS local_size
FROM pages""",
    "angles": "SELECT CAST(a AS INT) AS angle FROM range(0, 91, 10) AS r(a)",
    "geometry": """
SELECT *, x2s AS x2 FROM (
 SELECT *, Xb - CASE WHEN angle <= 45 THEN h1 ELSE dy END AS x2s,
   Ya - CASE WHEN angle <= 45 THEN dy ELSE h1 END AS y1, x1 AS y2,
   CASE WHEN angle <= 45 THEN Xb - dy ELSE Xb - dy + cw END AS xmax,
   (iw * co + ih * si) - x1 - cw AS x3, Yc - CASE WHEN angle <= 45 THEN h1 ELSE dy END AS y3,
   Xd - CASE WHEN angle <= 45 THEN dy ELSE h1 END AS x4, Yd - x1 - chh AS y4, Yd - x1 AS ymax
 FROM (SELECT *, CASE WHEN angle <= 45 THEN x1 * ta ELSE chh - h1 END AS dy FROM (
   SELECT *, CASE WHEN angle <= 45 THEN h * co ELSE h * si END AS h1, CASE WHEN angle <= 45 THEN h * si ELSE h * co END AS x1 FROM (
    SELECT *, CASE WHEN angle <= 45 THEN chh * co ELSE chh * si END AS h, iw * si AS Ya, iw * co AS Xb, ih * co AS Yc, ih * si AS Xd,
      iw * si + ih * co AS Yd, CASE WHEN angle <= 45 THEN cw * ta ELSE chh / ta END AS x0 FROM (
     SELECT image_id, width, height, angle, CAST(width AS DOUBLE) AS iw, CAST(height AS DOUBLE) AS ih, 128.0::DOUBLE AS cw, 96.0::DOUBLE AS chh,
       sin(radians(angle)) AS si, cos(radians(angle)) AS co, tan(radians(angle)) AS ta
     FROM catalog CROSS JOIN angles)))))""",
    "regions": """
SELECT image_id, angle, j, i, corner, nh, nv,
  CASE corner WHEN 1 THEN x1 + j*jx + i*ix WHEN 2 THEN x2 + j*jx - i*ix WHEN 3 THEN x3 - j*jx - i*ix ELSE x4 - j*jx + i*ix END AS x,
  CASE corner WHEN 1 THEN y1 + j*jy - i*iy WHEN 2 THEN y2 + j*jy + i*iy WHEN 3 THEN y3 - j*jy + i*iy ELSE y4 - j*jy - i*iy END AS y,
  CAST(trunc(iw * abs(co) + ih * abs(si)) AS INT) AS ow, CAST(trunc(iw * abs(si) + ih * abs(co)) AS INT) AS oh
FROM (SELECT *, CASE WHEN angle <= 45 THEN x0 ELSE cw END AS jx, CASE WHEN angle <= 45 THEN cw ELSE x0 END AS ix,
        CASE WHEN angle <= 45 THEN chh ELSE x0 END AS jy, CASE WHEN angle <= 45 THEN x0 ELSE chh END AS iy,
        CAST(trunc(CASE WHEN angle <= 45 THEN (xmax - x1) / cw ELSE (y1 + chh - y2) / chh END) AS INT) AS nh,
        CAST(trunc(CASE WHEN angle <= 45 THEN (ymax - y1) / cw ELSE (x4 + chh - x1) / cw END) AS INT) AS nv FROM geometry) g,
  range(0, greatest(nv, 0)) AS rj(j), range(0, greatest(nh, 0)) AS ri(i), (VALUES (1),(2),(3),(4)) AS cc(corner)""",
}

_NEEDS = {
    "colour": ["thumbs"], "measures": ["thumbs"], "bits": ["thumbs"], "pairs": ["thumbs"], "distances": ["pairs", "bits"],
    "matched": ["frames", "segments"], "crops": ["crop_requests"], "outcomes": ["crops", "catalog"],
    "view_voxels": ["voxels"], "normalised": ["view_voxels"], "gray": ["normalised"], "view_list": ["volume_headers"],
    "geometry": ["catalog", "angles"], "regions": ["geometry"],
}


def with_views(names: str, body: str) -> str:
    """``body`` behind the named views and all they build on."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n].strip()})" for n in ordered) + "\n" + body.strip()
